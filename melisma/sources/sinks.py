"""Writers: tables, contours, TextGrid, Partitur, tier XML, and a read script."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Columns that name things rather than measure them.
FACTOR_PREFIXES, FACTORS = ("grp_", "lab", "tier", "is_", "class"), ("fi", "ci", "si", "gi", "stm", "spk")


def is_factor(column: str) -> bool:
    return column in FACTORS or column.startswith(FACTOR_PREFIXES)


def write_table(df: DataFrame, path: str, separator: str = ",", quote_text: bool = False) -> None:
    """CSV with a header, ``NA`` for nulls and the columns in alphabetical order."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("header", True).option("sep", separator).option("nullValue", "NA").option("emptyValue", "").option("quoteAll", quote_text).csv(path)


def r_script(df: DataFrame, path: str, separator: str = ",") -> str:
    """A script that reads the table with its factors and numbers."""
    kinds = [f"{c}='{'factor' if is_factor(c) else 'numeric'}'" for c in sorted(df.columns)]
    return f"d <- read.table(\"{path}\", header=T, fileEncoding=\"UTF-8\", sep=\"{separator}\",\n  colClasses=c({', '.join(kinds)}))\n"


def contour_lines(df: DataFrame, channels: int = 1) -> DataFrame:
    """``fi, line`` in order of time: the time and a value per channel, two decimals."""
    wide = df.groupBy("fi", "t").agg(*(F.first(F.when(F.col("ci") == c, F.col("y")), ignorenulls=True).alias(f"y{c}") for c in range(channels)))
    cells = [F.format_string("%.2f", F.col("t").cast("double")), *(F.format_string("%.2f", F.coalesce(F.col(f"y{c}").cast("double"), F.lit(0.0))) for c in range(channels))]
    return wide.orderBy("fi", "t").select("fi", F.concat_ws(" ", *cells).alias("line"))


def _quoted(c: str) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def _number(c: str) -> Column:
    return F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")


def textgrid(items: DataFrame, short: bool = False) -> DataFrame:
    """``path, content`` of tier items (``path, tier, class, xmin, xmax, label,
    file_end``): one text per file, tiers in order of name."""
    points = F.col("class") == "TextTier"
    w = Window.partitionBy("path", "tier").orderBy("xmin", "xmax", "label")
    i = F.row_number().over(w).cast("string")
    if short:
        item = F.when(points, F.concat_ws("\n", _number("xmin"), _quoted("label"))).otherwise(F.concat_ws("\n", _number("xmin"), _number("xmax"), _quoted("label")))
    else:
        pad = "            "
        item = F.when(points, F.concat(F.lit("        points ["), i, F.lit(f"]:\n{pad}number = "), _number("xmin"), F.lit(f"\n{pad}mark = "), _quoted("label"))).otherwise(
            F.concat(F.lit("        intervals ["), i, F.lit(f"]:\n{pad}xmin = "), _number("xmin"), F.lit(f"\n{pad}xmax = "), _number("xmax"), F.lit(f"\n{pad}text = "), _quoted("label")))
    rows = items.withColumn("__item", item).withColumn("__k", F.row_number().over(w))
    tiers = rows.groupBy("path", "tier", "class").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__k", "__item"))), lambda s: s["__item"]), "\n").alias("body"), F.count(F.lit(1)).alias("n"), F.max("file_end").alias("end"))
    end = F.max("end").over(Window.partitionBy("path"))
    tiers = tiers.withColumn("end", end).withColumn("__t", F.row_number().over(Window.partitionBy("path").orderBy("tier")).cast("string"))
    word = F.when(F.col("class") == "TextTier", "points").otherwise("intervals")
    if short:
        block = F.concat_ws("\n", _quoted("class"), _quoted("tier"), F.lit("0"), _number("end"), F.col("n").cast("string"), "body")
    else:
        block = F.concat(F.lit("    item ["), "__t", F.lit("]:\n        class = "), _quoted("class"), F.lit("\n        name = "), _quoted("tier"), F.lit("\n        xmin = 0\n        xmax = "), _number("end"), F.lit("\n        "), word, F.lit(": size = "), F.col("n").cast("string"), F.lit("\n"), "body")
    files = tiers.withColumn("block", block).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tier", "block"))), lambda s: s["block"]), "\n").alias("blocks"), F.count(F.lit(1)).cast("string").alias("n"), F.max("end").alias("end"))
    start = 'File type = "ooTextFile"\nObject class = "TextGrid"\n\n'
    if short:
        head = F.concat(F.lit(start + "0\n"), _number("end"), F.lit("\n<exists>\n"), "n", F.lit("\n"))
    else:
        head = F.concat(F.lit(start + "xmin = 0\nxmax = "), _number("end"), F.lit("\ntiers? <exists>\nsize = "), "n", F.lit("\nitem []:\n"))
    return files.select("path", F.concat(head, "blocks", F.lit("\n")).alias("content"))


def tier_xml(items: DataFrame) -> DataFrame:
    """``path, content`` as tier XML with escaped labels; an empty label is ``x``."""
    text = F.when(F.coalesce(F.col("label"), F.lit("")) == "", "x").otherwise(F.col("label"))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    times = F.when(F.col("class") == "TextTier", F.concat(F.lit("<t>"), F.col("xmin").cast("string"), F.lit("</t>"))).otherwise(F.concat(F.lit("<t_start>"), F.col("xmin").cast("string"), F.lit("</t_start><t_end>"), F.col("xmax").cast("string"), F.lit("</t_end>")))
    rows = items.withColumn("__item", F.concat(F.lit("<item><label>"), text, F.lit("</label>"), times, F.lit("</item>")))
    tiers = rows.groupBy("path", "tier").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("xmin", "xmax", "__item"))), lambda s: s["__item"]), "").alias("body"))
    tiers = tiers.withColumn("block", F.concat(F.lit("<tier><name>"), "tier", F.lit("</name><items>"), "body", F.lit("</items></tier>")))
    files = tiers.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tier", "block"))), lambda s: s["block"]), "\n").alias("b"))
    return files.select("path", F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<annotation><tiers>'), "b", F.lit("</tiers></annotation>\n")).alias("content"))


def partitur(items: DataFrame, rate: int) -> DataFrame:
    """``path, content``: a header and a line per item, times cut to samples."""
    on, off = (F.col("xmin") * rate).cast("bigint"), (F.col("xmax") * rate).cast("bigint")
    fields = F.when(F.col("class") == "TextTier", F.concat_ws("\t", on.cast("string"), F.lit("-1"), "label")).otherwise(F.concat_ws("\t", on.cast("string"), (off - on + 1).cast("string"), F.lit("-1"), "label"))
    rows = items.withColumn("__line", F.concat("tier", F.lit(":\t"), fields))
    files = rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tier", "xmin", "xmax", "__line"))), lambda s: s["__line"]), "\n").alias("b"))
    return files.select("path", F.concat(F.lit(f"LHD: Partitur 1.3\nSAM: {rate}\nLBD:\n"), "b", F.lit("\n")).alias("content"))


def write_contents(files: DataFrame, path: str) -> None:
    """One text per row, dealt by file, so that a file's text is never split."""
    files.select("content").write.mode("overwrite").option("lineSep", "\n").text(path)
