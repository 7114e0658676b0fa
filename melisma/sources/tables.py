"""Plain-text tables: contours, pulses, label lists, key-value files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import name_part, stem
from .sinks import is_factor


def _lines(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("line")).where("line <> ''")


def recordings(files: DataFrame, groups: list[str] | None = None, separator: str = "_") -> DataFrame:
    """``path, stem, fi`` and ``grp_<name>`` from the parts of the stem.

    ``fi`` numbers the files by path; there is one row per file, which is what the
    single ordered window over it sees.
    """
    rows = files.select("path").distinct().withColumn("stem", stem("path"))
    rows = rows.withColumn("fi", F.row_number().over(Window.orderBy("path")) - 1)
    for i, g in enumerate(groups or []):
        rows = rows.withColumn(f"grp_{g}", name_part("stem", separator, i))
    return rows


def read_contour(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``path, ci, t, y`` from rows ``time value [value of channel 2 ...]``, both to two decimals."""
    parts = F.transform(F.split("line", r"\s+"), lambda x: x.try_cast("double"))
    rows = _lines(spark, path, glob).withColumn("v", parts)
    rows = rows.select("path", F.round(F.get("v", F.lit(0)), 2).alias("t"), F.posexplode(F.slice("v", F.lit(2), F.greatest(F.size("v") - 1, F.lit(0)))).alias("ci", "y"))
    return rows.where("t IS NOT NULL").select("path", "ci", "t", F.round(F.coalesce(F.nanvl("y", F.lit(0.0)), F.lit(0.0)), 2).alias("y"))


def read_pulses(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``path, ci, t`` from a column of pulse times per channel; values up to 0 pad."""
    rows = _lines(spark, path, glob).select("path", F.posexplode(F.split("line", r"\s+")).alias("ci", "v"))
    return rows.select("path", "ci", F.col("v").try_cast("double").alias("t")).where("t > 0")


def read_labels(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``path, xmin, xmax, label`` from rows ``on off label ...``."""
    parts = F.split("line", r"\s+", 3)
    return _lines(spark, path, glob).select("path", F.get(parts, F.lit(0)).try_cast("double").alias("xmin"), F.get(parts, F.lit(1)).try_cast("double").alias("xmax"), F.coalesce(F.get(parts, F.lit(2)), F.lit("")).alias("label"))


def read_key_values(spark: SparkSession, path: str, separator: str = r"\s+", glob: str | None = None) -> DataFrame:
    """``path, key, value``; rows without a value are left out."""
    parts = F.split("line", separator, 2)
    return _lines(spark, path, glob).where(F.size(parts) == 2).select("path", F.get(parts, F.lit(0)).alias("key"), F.get(parts, F.lit(1)).alias("value"))


def read_lines(spark: SparkSession, path: str, separator: str | None = None, glob: str | None = None) -> DataFrame:
    """``path, item``: trimmed lines, or with a separator (a pattern) their parts as an array."""
    rows = _lines(spark, path, glob)
    return rows.select("path", (F.col("line") if separator is None else F.split("line", separator)).alias("item"))


def read_export(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """A table written by ``sinks.write_table``: ``NA`` is null, factors are text, other
    columns numbers."""
    raw = spark.read.option("header", True).option("sep", separator).option("nullValue", "NA").csv(path)
    return raw.select(*(F.col(f"`{c}`") if is_factor(c) else F.col(f"`{c}`").try_cast("double").alias(c) for c in raw.columns))
