"""Small cases and brute-force versions of the corpus operators."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from melisma.llm import chat_format, common, decontaminate, exact_dedup, graph, language_id, minhash, mixing, sharding, suffix_dedup, textvec, token_counts, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, __text string, score string"


def words(n, seed, pool=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(pool)}x" for _ in range(n))


def docs_of(spark, rows):
    """Rows of (doc_id, text, lang, source) with columns whose names clash."""
    return spark.createDataFrame([(*r, 7, 1, "x", "y") for r in rows], DOCS)


ODD = [
    (1, None, "en", "a"), (2, "", None, None), (3, "  \n\t ", "en", "b"), (None, "no id here", "en", "a"), (None, None, None, None),
    (5, "same text of some words", "en", "a"), (5, "same text of some words", "en", "a"), (6, "SAME text of some words", "fr", None), (7, "x" * 300_000, "en", "b"), (8, "é" * 50 + " ü 😀 <|endoftext|> it's", "de", "c"),
    (9, words(9000, 1), "en", "a"), (10, "a\u0000b \u0000", "en", "a"),
]


def test_token_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [*ODD, (11, " \n  a   b\n\n" * 20_000 + "it's <|endoftext|>" * 3000, "en", "a"), (12, "漢字、かな。" * 5000 + "a\tb" * 2000, "ja", "a")]
    got = token_counts.count_tokens(docs_of(spark, rows), part_bytes=1000, batch_bytes=5000).collect()
    want = sorted((r[0] or 0, len((r[1] or "").encode()), len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert token_counts.count_tokens(docs_of(spark, [])).count() == 0
    for _, text, *_ in rows[-2:]:
        parts = token_counts.safe_parts(text, 77)
        assert "".join(parts) == text and max(map(len, parts)) < 200
    assert max(len(p.encode()) for p in token_counts.safe_parts("漢字、" * 30_000, 1000)) < 1100


def test_safe_parts_of_any_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice(["漢", "な", "。", "，", "「", "」", "a", "B", " ", "1", "½", "\t", "\n", "'", "é", "<|endoftext|>", "s", "…", "_", "\u3000", "\u0301"]) for _ in range(rng.randint(1, 60)))
        parts = token_counts.safe_parts(text, rng.randint(1, 20))
        assert sum(len(e.ids) for e in t.encode_batch(parts, add_special_tokens=False)) == len(t.encode(text, add_special_tokens=False).ids)


def test_slices_are_bounded_by_bytes():
    sizes = [token_counts.n_bytes(x) for x in ("漢" * 100, "a" * 100, "é" * 100, "", "b" * 700)]
    assert sizes == [300, 100, 200, 0, 700]
    assert list(token_counts.slices(["x"] * 5, sizes, 600)) == [(0, 4), (4, 5)]


def lowered(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


@pytest.mark.parametrize("bits", [256, 8])
def test_exact_dedup(spark, tmp_path, bits):
    rows = ODD + [(100 + i, f"T{i % 40}É" if i % 3 else f"t{i % 40}É", "en", "a") for i in range(120)]
    docs_of(spark, rows).repartition(3).write.parquet(str(tmp_path / "d"))
    got = exact_dedup.exact_dedup(spark, str(tmp_path / "d"), digest_bits=bits, max_bytes_per_trigger=1).collect()
    groups = {}
    for r in rows:
        groups.setdefault(lowered(r[1]), []).append(r[0])
    want = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        # Of repeated rows with the id that stays, one is kept.
        want += [(i, keep, len(ids), i == keep and k == ids.index(i), hashlib.sha256(text.encode()).hexdigest()) for k, i in enumerate(ids)]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    docs_of(spark, []).write.parquet(str(tmp_path / "e"))
    assert exact_dedup.exact_dedup(spark, str(tmp_path / "e")).count() == 0


def test_exact_dedup_goes_on_from_kept_state(spark, tmp_path):
    """A second call reads the new files only and finds copies of the first ones'."""
    path, state = str(tmp_path / "some docs"), str(tmp_path / "state")
    texts = {}
    for start in (0, 100):
        rows = [(start + i, f"text {i % 30} {'x' * (i % 3) * start}", "en", "a") for i in range(60)]
        texts |= {r[0]: r[1] for r in rows}
        docs_of(spark, rows).repartition(2).write.mode("append").parquet(path)
        got = exact_dedup.exact_dedup(spark, path + "/", state=state).collect()
        with pytest.raises(ValueError, match="pattern"):
            exact_dedup.exact_dedup(spark, path + "[1]")
        assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in got} == {
            i: ((k := max(j for j in texts if texts[j] == x)), sum(y == x for y in texts.values()), i == k) for i, x in texts.items()
        }


def test_chat_format_round_trip(spark):
    rows = [(1, 0, "user", "a <b> \\l \\b </turn>\n"), (1, 1, "assistant", "<turn:user>\\"), (1, 1, "assistant", "<turn:user>\\"), (1, None, None, None), (2, 5, "as>si\\st", "é😀"), (None, 0, "assistant", "")]
    turns = spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, head string")
    back = {r["conv"]: r for r in chat_format.read_back(chat_format.format_conversations(turns, conv="conv_id")).collect()}
    assert [tuple(t) for t in back[1]["turns"]] == [("", ""), ("user", "a <b> \\l \\b </turn>\n"), ("assistant", "<turn:user>\\"), ("assistant", "<turn:user>\\")]
    assert back[1]["loss"] == ["<turn:user>\\"] * 2
    assert [tuple(t) for t in back[2]["turns"]] == [("as>si\\st", "é😀")] and back[2]["loss"] == []
    assert [tuple(t) for t in back[None]["turns"]] == [("assistant", "")]
    assert chat_format.format_conversations(turns.limit(0), conv="conv_id").count() == 0


def test_chat_parts(spark):
    parts = "[{'kind':'text','text':'see <'},{'kind':'image','ref':'i.png','width':30,'height':14},{'kind':'audio','ref':'a.wav','seconds':1.5},null,{'kind':'text','text':'!'},{'kind':'document','ref':'d.pdf','pages':2}]".replace("'", '"')
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None)], "conv_id bigint, turn bigint, role string, raw string")
    got = chat_format.format_conversations(df, conv="conv_id", parts=F.from_json("raw", chat_format.PARTS)).first()
    assert got["formatted"] == "<turn:assistant>see \\l<image:1><audio:2>!<document:3></turn>\n<turn:user></turn>\n"
    assert [(a["k"], a["kind"], a["ref"], a["tokens"]) for a in got["attachments"]] == [(1, "image", "i.png", 3), (2, "audio", "a.wav", 38), (3, "document", "d.pdf", 1000)]
    assert got["n_tokens_attached"] == 1041


def test_mixing(spark):
    assert mixing.target_sizes({"a": 10, "b": 100, "c": 0}, {"a": 3, "b": 1, "c": 2}, 1.5, 2.0) == {"a": 20.0, "c": 0.0, "b": 145.0}
    rows = ODD + [(1000 + i, words(5 + i % 70, i), "en", "abc"[i % 7 % 3]) for i in range(600)]
    docs = docs_of(spark, rows)
    runs = [sorted(mixing.mix(docs, [3, 1, 2], bucket_rows=n).collect(), key=str) for n in (50, 50, 20_000)]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
    for run, near in ((runs[0], 4500), (runs[2], 60)):  # with small buckets, half the largest text
        check_mix(run, near)
    assert mixing.mix(docs_of(spark, []), [3, 1, 2]).count() == 0


def test_mixing_of_one_repeated_row(spark, monkeypatch):
    """100,000 identical rows with one id: no bucket holds more than its share, and
    half of them are taken twice."""
    monkeypatch.setattr(common, "REPEATS", 7000)
    docs = docs_of(spark, [(5, "a b c", "en", "a")]).crossJoin(spark.range(100_000)).drop("id")
    docs = docs.unionByName(docs_of(spark, [(7, "d e f", "en", "b"), (7, "d e f", "en", "b")]))
    got = mixing.mix(docs, {"a": 1, "b": 0.0}).groupBy("doc_id", "taken").count().collect()
    assert {tuple(r) for r in got if r["doc_id"] == 5} == {(5, 3, 50_000), (5, 6, 50_000)} or sum(r["taken"] * r["count"] for r in got) == pytest.approx(1.5 * 300_006, rel=1e-3)
    cells = sharding.shard_rows(docs).groupBy("doc_id", "shard").count().collect()
    assert sum(r["count"] for r in cells) == 100_002
    assert max(sum(r["count"] for r in cells if r["shard"] == j) for j in range(24)) <= 4168


def check_mix(run, near):
    taken = {}
    for r in run:
        assert 0 <= r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        t = taken.setdefault(r["source"], [0, r["target"], 0, r["source_size"]])
        t[0] += r["taken"]
        t[2] += r["size"]
    for got, target, size, stated in taken.values():
        assert size == stated and abs(got - target) <= near


def test_flight_keeps_both_sums():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.choice([2, 3, 3, 10, 200])
        p, size = np.array([rng.uniform(0.05, 0.95) for _ in range(n)]), np.array([rng.choice([3, 3, 8, 50]) for _ in range(n)], dtype=float)
        if n == 2:
            size[:] = 7
        before = (p.sum(), (p * size).sum())
        assert mixing.fly(p, size, rng)
        assert (p * (1 - p) == 0).any() and np.allclose(before, (p.sum(), (p * size).sum()))
    assert not mixing.fly(np.array([0.5, 0.5]), np.array([1.0, 2.0]), rng)


@pytest.mark.parametrize("n", [10, 50, 400, 2000])
def test_nearly_all_units_fly(monkeypatch, n):
    """Few units are left to land; words and documents come out as expected, and
    each unit as often as its probability says."""
    flights, fly = [], mixing.fly
    monkeypatch.setattr(mixing, "fly", lambda *a: flights.append(1) or fly(*a))
    sizes = random.Random(n).choices(range(1, 400), k=n)
    taken, runs = np.zeros(n), 100 if n < 1000 else 20
    for seed in range(runs):
        rng = random.Random(seed)
        units = [[0.37, s, i] for i, s in enumerate(sizes)]
        still = mixing.fly_all(units, rng, mixing.LANDED)
        assert len(still) <= min(mixing.LANDED, max(6, n // 3)) and all(x[0] in (0, 1) for x in units if x not in still)
        mixing.land(still, rng)
        assert n < 50 or abs(sum(x[0] for x in units) - 0.37 * n) <= 1.01
        assert n < 50 or abs(sum(x[0] * x[1] for x in units) - 0.37 * sum(sizes)) <= 60
        for x in units:
            taken[x[2]] += x[0]
    assert len(flights) >= runs * (n - mixing.LANDED) * 0.9
    assert len(flights) > 0
    assert n < 50 or abs(taken / runs - 0.37).mean() < 0.15


def test_sharding(spark):
    rows = ODD + [(1000 + i, f"copy {i // 4}" if i < 200 else f"hot" if i < 500 else f"single {i}", "en", "a") for i in range(900)]
    got = sharding.shard_rows(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    shards = {}
    for r in got:
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(shards) == list(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    small = {}
    for r in got:
        if r["doc_id"] and 1000 <= r["doc_id"] < 1200:
            small.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert sum(len(s) > 1 for s in small.values()) <= 2
    assert sharding.shard_rows(docs_of(spark, [])).count() == 0
    assert sorted(r["slot"] for r in sharding.shard_rows(docs_of(spark, ODD[:3])).collect()) == [0, 0, 0]


@pytest.mark.parametrize("kind", ["fours", "mixed"])
def test_sharding_of_mostly_copies(spark, kind):
    """Nine tenths of the rows in groups of four, or a hot text and 30 large groups
    among small ones: groups that fit a shard stay whole."""
    if kind == "fours":
        texts = [f"copy {i // 4}" for i in range(10_800)] + [f"single {i}" for i in range(1200)]
    else:
        texts = ["hot"] * 4000 + [f"large {i % 30}" for i in range(3000)] + [f"small {i // 3}" for i in range(3000)] + [f"single {i}" for i in range(2000)]
    got = sharding.shard_rows(docs_of(spark, [(i, x, "en", "a") for i, x in enumerate(texts)])).collect()
    shards, groups = {}, {}
    for r in got:
        shards.setdefault(r["shard"], []).append(r["slot"])
        groups.setdefault(texts[r["doc_id"]], []).append(r["shard"])
    assert len(got) == len(texts) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert [x for x, s in groups.items() if x != "hot" and len(set(s)) > 1] == []


def fake_language(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    sounds = {"en": ["th", "ing", "wh", "ea"], "de": ["sch", "ung", "ü", "ei"]}[lang]
    return " ".join("".join(rng.choice(sounds) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_id(spark):
    rows = [(i, fake_language("en" if i % 2 else "de", 40, i), "en" if i % 2 else "de", "a") for i in range(400)]
    docs = docs_of(spark, rows)
    model = language_id.learn(docs)
    got = language_id.identify(docs.select("doc_id", "lang", "text"), model).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 50 and all(r["lang"] == r["lang_pred"] and 0.5 < r["score"] <= 1 for r in held)
    odd = language_id.identify(docs_of(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all((r["lang_pred"] == "und") == (r["doc_id"] in (1, 2, 3) or r["doc_id"] is None and r["lang"] is None) for r in odd)
    assert {r["lang_pred"] for r in language_id.identify(docs, None).collect()} == {"und"}
    assert language_id.identify(docs_of(spark, []), model).count() == 0
    assert model.positions("thing").shape == (5, 2)
    one = language_id.train([("en", "some text")])
    assert one.langs == ["en"] and language_id.train([]) is None


def test_language_id_learns_every_language(spark):
    """70 languages, the smallest of them with one training row."""
    train = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(i, f"text {i}", f"l{min(k, 69):02}", "a") for k, i in enumerate(train[:70])]
    rows += [(i, f"text {i}", f"l{k % 69:02}", "a") for k, i in enumerate(train[70:700])]
    classes = docs_of(spark, rows).select("doc_id", F.col("lang").alias("y"))
    got = common.training_sample(docs_of(spark, rows), classes, 400, 4000)
    assert sorted(got) == sorted((r[2], r[1]) for r in rows)
    assert language_id.learn(docs_of(spark, rows)).langs == [f"l{k:02}" for k in range(70)]


def test_gru_gradient():
    rng = np.random.default_rng(0)
    d = language_id.Direction(*(rng.normal(size=s) * 0.4 for s in ((6, 256), (6, 2), (2, 1))))
    ids, weight = rng.integers(0, 256, (5, 3)), rng.normal(size=(5, 2, 3))
    loss = lambda: (d.forward(ids)[0].astype(float) * weight).sum()
    grads = d.backward(ids, d.forward(ids)[1], weight)
    for w, g, at in ((d.inner, grads[1], (3, 1)), (d.bias, grads[2], (1, 0)), (d.table, grads[0], (4, int(ids[2, 0])))):
        old = w[at]
        w[at] = old + 1e-3
        up = loss()
        w[at] = old - 1e-3
        down = loss()
        w[at] = old
        assert abs((up - down) / 2e-3 - g[at]) < 2e-2


def test_toxicity(spark):
    bad = ["grotty", "vexing", "lousier"]
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(500):
        toxic = i % 5 == 0
        body = words(60, i, 3000).split()
        if toxic:
            for _ in range(3):
                body.insert(rng.randrange(60), rng.choice(bad))
        rows.append((i, " ".join(body), "en", "a"))
        labels.append((i, 1, int(toxic), 3))
    docs = docs_of(spark, rows)
    field = toxicity.learn(docs, spark.createDataFrame([*labels, (None, 1, 1, 3), (3, None, None, 3)], "doc_id bigint, quality int, toxic int, text int"))
    got = toxicity.score(docs, field).collect()
    for r in got:
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2:
            assert (r["score"] >= 0.3) == (r["doc_id"] % 5 == 0)
            text = rows[r["doc_id"]][1].encode()
            assert {text[s["start"] : s["end"]].decode() for s in r["spans"]} <= set(bad)
    odd = toxicity.score(docs_of(spark, ODD), field).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] < 0.3 and r["spans"] == [] for r in odd)
    assert toxicity.score(docs_of(spark, []), field).count() == 0
    nothing = toxicity.train([])
    assert all(r["score"] < 0.3 for r in toxicity.score(docs_of(spark, ODD), nothing).collect())


def test_toxicity_sample_takes_long_texts_whole(spark, monkeypatch):
    """3,000 documents of one label and one of over 80,000 characters all go in whole."""
    ids = [i for i in range(6000) if zlib.crc32(str(i).encode()) % 4 != 2][:3001]
    texts = {i: f"text {i}" for i in ids[1:]} | {ids[0]: words(90_000 // 6, 1)[:90_000]}
    docs = docs_of(spark, [(i, x, "en", "a") for i, x in texts.items()])
    labels = spark.createDataFrame([(i, int(i == ids[0])) for i in ids], "doc_id bigint, toxic int")
    monkeypatch.setattr(toxicity, "train", lambda sample: sample)
    assert sorted(toxicity.learn(docs, labels)) == sorted((int(i == ids[0]), x) for i, x in texts.items())


def test_crf_marginals_against_all_paths():
    rng = np.random.default_rng(2)
    field = toxicity.Field(np.zeros(0, np.uint64), np.zeros((3, 0)), 0.0, rng.normal(size=(2, 2)))
    emit, size = rng.normal(size=(5, 2)), np.array([5, 3])
    p, joint, clean = field.marginals(emit, size)
    for s, n in enumerate(size):
        total, ones, none = 0.0, np.zeros(n), 0.0
        pair = np.zeros((2, 2))
        for path in range(1 << n):
            y = [path >> i & 1 for i in range(n)]
            v = np.exp(sum(emit[i, s] * y[i] for i in range(n)) + sum(field.chain[a, b] for a, b in zip(y, y[1:])))
            total += v
            none += v * (not any(y))
            ones += v * np.array(y)
            for a, b in zip(y, y[1:]):
                pair[a, b] += v
        assert np.allclose(p[:n, s], ones / total) and np.allclose(joint[:, :, s], pair / total)
        assert np.allclose(clean[s], np.log(none / total))


def test_toxicity_beats_the_word_list(spark):
    """On held-out documents the field is right more often than "has a word that the
    likelihood-ratio test names", the labels it began with."""
    bad, rng, sample = [f"bad{i}ly" for i in range(12)], random.Random(8), []
    for i in range(3000):
        body = words(60, i, 1500).split()
        toxic = rng.random() < 0.15
        for _ in range(rng.randint(1, 3) if toxic else 0):
            body[rng.randrange(60)] = rng.choice(bad)
        if not toxic and rng.random() < 0.02:  # a wrong label
            toxic = True
        sample.append((int(toxic), " ".join(body)))
    train, held = sample[:2000], sample[2000:]
    y = np.array([k for k, _ in held])
    rows, first, toxic = toxicity.prepare(train)
    named = np.unique(rows[0][toxicity.mark(rows, np.repeat(np.arange(len(toxic)), np.diff(first)), toxic)])
    w, own = toxicity.features(pa.array([x for _, x in held]))
    listed = np.bincount(w.text_of(), weights=np.isin(own[0], named), minlength=len(held)) > 0
    field = toxicity.train(train)
    docs = spark.createDataFrame([(i, x) for i, (_, x) in enumerate(held)], "doc_id bigint, text string")
    scores = np.array([r["score"] for r in toxicity.score(docs, field).orderBy("doc_id").collect()])
    loss = lambda q: -np.log(np.where(y == 1, q, 1 - q).clip(0.01, 0.99)).mean()
    assert ((scores >= 0.3) == y).mean() >= (listed == y).mean() and loss(scores) < loss(listed)


def test_document_gradient():
    """The pull on a word is the derivative of the label's log likelihood."""
    rng = np.random.default_rng(3)
    field = toxicity.Field(np.zeros(0, np.uint64), np.zeros((3, 0)), 0.0, rng.normal(size=(2, 2)))
    emit, size = rng.normal(size=(6, 2)) - 1, np.array([6, 4])
    sure = 1 - 2 * toxicity.NOISE

    def likelihood(y):
        none = np.exp(field.marginals(emit, size)[2].sum())
        some = toxicity.NOISE + sure * (1 - none)
        return np.log(some if y else 1 - some), (sure * none / some if y else -sure * none / (1 - some))

    for y in (0, 1):
        p, joint, _ = field.marginals(emit, size)
        pull = likelihood(y)[1]
        for at in ((2, 0), (0, 1)):
            emit[at] += 1e-5
            up = likelihood(y)[0]
            emit[at] -= 2e-5
            down = likelihood(y)[0]
            emit[at] += 1e-5
            assert np.isclose((up - down) / 2e-5, pull * p[at], atol=1e-5)
        field.chain[0, 0] += 1e-5
        up = likelihood(y)[0]
        field.chain[0, 0] -= 2e-5
        down = likelihood(y)[0]
        field.chain[0, 0] += 1e-5
        assert np.isclose((up - down) / 2e-5, pull * (joint[0, 0].sum() - (size - 1).sum()), atol=1e-5)


def brute_spans(texts):
    seen, out = set(), []
    for t in texts:
        covered = bytearray(len(t))
        for s in range(len(t) - 99):
            w = t[s : s + 100]
            if w in seen:
                covered[s : s + 100] = b"\1" * 100
            seen.add(w)
        out.append(covered)
    return out


def test_suffix_dedup(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "RUN_ROWS", 40)
    rng = random.Random(3)
    shared = [words(40, 100 + i) for i in range(4)]
    rows = [(i, " ".join([words(rng.randint(0, 60), 1000 + i), rng.choice(shared)[rng.randint(0, 60) :], words(rng.randint(0, 40), 2000 + i), rng.choice([shared[0], ""])]), "en", "a") for i in range(60)]
    rows += [(70, "ab" * 400, "en", "a"), (71, "z" + "ab" * 300, "en", "a"), (72, "x" * 99, "", ""), (73, "x" * 99, "", ""), (74, rows[3][1], "", ""), (75, None, "", ""), (76, "\0" * 250, "", ""), (77, "\0" * 150 + "é" * 60, "", ""), (78, rows[5][1] + rows[6][1], "", "")]
    for extra in ([], [(None, rows[0][1] + "tail", "", ""), (3, rows[8][1][:300] + words(30, 5), "", ""), (70, "ab" * 400, "", "")]):
        every = rows + extra
        got = {}
        for r in suffix_dedup.suffix_dedup(docs_of(spark, every)).collect():
            got.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
        unique = sorted({(r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest(), (r[1] or "").encode()) for r in every})
        want = {}
        for u, c in zip(unique, brute_spans([u[3] for u in unique]), strict=True):
            key, text = None if u[0] else u[1], u[3]
            times = sum(r[0] == key and (r[1] or "").encode() == text for r in every)
            kept = bytes(b for b, x in zip(text, c) if not x)
            spans = sum(1 for k in range(len(c)) if c[k] and (k == 0 or not c[k - 1]))
            want.setdefault(key, []).extend([(len(text), sum(c), spans, hashlib.sha256(kept).hexdigest())] * times)
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert suffix_dedup.suffix_dedup(docs_of(spark, [])).count() == 0


def test_loser_tree_merge():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 3, (300, suffix_dedup.KEY)).astype(np.uint8)
    keys[:, :160] = keys[rng.integers(0, 9, 300)][:, :160]
    runs, rows = [], []
    for part in np.array_split(keys, 7):
        part = part[suffix_dedup.sorted_keys(part)]
        blob = suffix_dedup.front_code(part, np.arange(len(part)), np.arange(len(part)))
        decoded, shared, ids, _ = suffix_dedup.front_decode(blob)
        assert decoded == [x.tobytes() for x in part] and list(ids) == list(range(len(part)))
        runs.append((decoded, shared))
    order, shared = suffix_dedup.merge_runs(runs)
    rows = [runs[r][0][i] for r, i in order]
    assert rows == sorted(x.tobytes() for x in keys)
    assert shared[1:] == suffix_dedup.shared_prefix(np.array([list(x) for x in rows], np.uint8)).tolist()[1:]


def exact_classes(rows):
    """Components of pairs of weighted Jaccard similarity 0.8 or more."""
    sets = []
    for text in rows:
        w = textvec.words_of(pa.array([text or ""]))
        e, c, _ = minhash.weighted_sets(*textvec.shingles(w, 5))
        sets.append((e, c, (text or "") if not len(e) else w.hash.tobytes()))
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a[2] == b[2] or minhash.similarity(a[0], a[1], b[0], b[1]) >= 0.8:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("block", [1500, 5])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", block)
    rng = random.Random(9)
    texts = [words(rng.choice([3, 30, 120, 300]), i) for i in range(25)]
    for i in range(60):
        body = rng.choice(texts[:12]).split()
        for _ in range(rng.choice([0, 1, 1, 3])):
            body[rng.randrange(len(body))] = f"new{i}"
        texts.append(" ".join(body))
    texts += [None, "", " ", "...", "!!!", "one two"]
    rows = [(500 - i, t, "en", "a") for i, t in enumerate(texts)]
    got = {r["doc_id"]: (r["class_id"], r["kept"]) for r in minhash.near_duplicates(docs_of(spark, [*rows, (None, texts[0], "", "")])).collect()}
    root = exact_classes(texts)
    for i, (doc, *_ ) in enumerate(rows):
        least = min(rows[j][0] for j in range(len(rows)) if root[j] == root[i])
        assert got[doc] == (least, least == doc)
    least = min(rows[j][0] for j in range(len(rows)) if root[j] == root[0])
    assert got[None] == (least, False)  # a copy like any other
    assert minhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_near_duplicates_of_repeated_rows_and_shared_ids(spark):
    a, b, c = words(40, 1), words(40, 2), words(40, 3)
    rows = [(0, a), (1, a + " end"), (1, b), (7, c), (7, c), (None, a), (None, b.upper()), (None, "alone here"), (None, "alone here")]
    got = minhash.near_duplicates(docs_of(spark, [(*r, "en", "a") for r in rows]).withColumn("nth", F.monotonically_increasing_id()), keep=("text", "nth")).collect()
    assert len(got) == len(rows) and len({r["nth"] for r in got}) == len(rows)
    assert sorted((str(r["doc_id"]), r["text"], r["class_id"]) for r in got if r["kept"]) == sorted([("0", a, 0), ("1", b, 1), ("7", c, 7), ("None", "alone here", None)])
    assert {r["class_id"] for r in got if r["text"].lower() == b} == {1}


def test_a_large_cluster_is_verified_by_its_leads(spark, monkeypatch):
    """1,200 near copies of one text: each is compared with a few leads, not with
    all others, and all are one class."""
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", 50)
    base, rng, rows = words(200, 1, 10**6).split(), random.Random(2), []
    for i in range(1200):
        body = list(base)
        for _ in range(2):
            body[rng.randrange(200)] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(body), "en", "a"))
    rows.insert(600, (5000, " ".join(base), "en", "a"))
    calls = []
    monkeypatch.setattr(minhash, "_large_components", lambda placed, sizes, texts, path, real=minhash._large_components: calls.append(path) or real(placed, sizes, texts, path))
    got = minhash.near_duplicates(docs_of(spark, rows)).collect()
    assert {r["class_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1
    pairs = spark.read.parquet(f"{calls[0]}/pairs").count()
    assert pairs < 8 * len(rows)  # all pairs would be 600 a row


def test_dart_signatures_estimate_weighted_similarity():
    base, agree, want = words(400, 1, 10**6).split(), [], []
    for n in (4, 10, 30):
        other = list(base)
        for i in range(n):
            other[i * 13] = f"z{n}_{i}"
        e, c, bound = minhash.weighted_sets(*textvec.shingles(textvec.words_of(pa.array([" ".join(base * 3), " ".join(other * 3)])), 5))
        s = minhash.signatures(e, c, bound)
        agree.append((s[0] == s[1]).mean())
        want.append(minhash.similarity(e[bound[0] : bound[1]], c[bound[0] : bound[1]], e[bound[1] :], c[bound[1] :]))
    assert np.allclose(agree, want, atol=0.13)


def test_signing_short_texts_takes_little_memory(monkeypatch):
    """5,000 texts of one shingle have 5 million cells; some heavy sets, a few more.  The same signatures at any bound."""
    import tracemalloc

    of = lambda texts: minhash.weighted_sets(*textvec.shingles(textvec.words_of(pa.array(texts)), 5))
    short = of([f"w{i}" for i in range(5000)])
    tracemalloc.start()
    try:
        minhash.signatures(*short)
        assert tracemalloc.get_traced_memory()[1] < 50 << 20
    finally:
        tracemalloc.stop()
    mixed = of(["", "a b", words(3000, 1), "x y " * 2000, *(words(n, n) for n in range(1, 60))])
    want = minhash.signatures(*mixed)
    for cells in (1, 1000, 1 << 40):
        monkeypatch.setattr(minhash, "CELLS", cells)
        assert (minhash.signatures(*mixed) == want).all()


def test_connected_components(spark, tmp_path):
    pairs = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (200, 200)]
    got = {r["node"]: r["comp"] for r in graph.connected_components(spark.createDataFrame(pairs, "a bigint, b bigint"), str(tmp_path / "g")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 102: 100}


def test_decontamination(spark):
    bench = spark.createDataFrame([(i, words(25 + i, 50 + i, 5000), 0) for i in range(30)] + [(30, None, 0), (31, "", 0), (None, "x", 0)], "item_id bigint, text string, doc_id int")
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    rng, rows, want = random.Random(1), [], set()
    for i in range(120):
        body = words(rng.randint(0, 150), 900 + i, 5000).split()
        at = rng.randint(0, len(body))
        if i % 4 == 0:
            part = items[i % 30].split()
            if i % 8 == 0:  # a paraphrase: every sixth word another one
                part = [f"other{j}" if j % 6 == 1 else x for j, x in enumerate(part)]
            body[at:at] = part
            want.add((i, i % 30))
        rows.append((i, " ".join(body).upper() if i % 3 else " ".join(body), "en", "a"))
    got = decontaminate.leaks(docs_of(spark, rows + ODD), bench)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
    assert decontaminate.leaks(docs_of(spark, []), bench).count() == 0
    assert decontaminate.leaks(docs_of(spark, rows), bench.limit(0)).count() == 0


@pytest.mark.parametrize("n, values", [(200, 8_000_000), (1000, 1), (5000, 8_000_000)])
def test_decontamination_of_many_items(spark, monkeypatch, n, values):
    """Far more pieces than the latent space has dimensions: every copy is found."""
    monkeypatch.setattr(decontaminate, "SEARCH_VALUES", values, raising=False)
    items = [words(15 + i % 45, 10_000 + i, 3000) for i in range(n)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    told = range(0, n, 1 + n // 1000)
    rows = [(i, f"{words(i % 70, 20_000 + i, 3000)} {items[i]} {words(i % 50, 30_000 + i, 3000)}", "en", "a") for i in told]
    rows += [(5000 + i, words(80, 40_000 + i, 3000), "en", "a") for i in range(300)]
    got = decontaminate.leaks(docs_of(spark, rows), bench)
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(i, i) for i in told]


@pytest.mark.parametrize("n", [200, 1000])
def test_decontamination_of_many_paraphrases(spark, n):
    """Every sixth word another one, two others swapped: 0.9 are found at least, and
    nothing else."""
    items, rows = [words(20 + i % 40, 60_000 + i, 3000) for i in range(n)], []
    for i, x in enumerate(items):
        part = [f"other{j}" if j % 6 == 1 else w for j, w in enumerate(x.split())]
        part[3], part[4] = part[4], part[3]
        rows.append((i, f"{words(i % 70, 70_000 + i, 3000)} {' '.join(part)} {words(i % 50, 80_000 + i, 3000)}", "en", "a"))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = [(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs_of(spark, rows), bench).collect()]
    assert all(a == b for a, b in got) and len(got) >= 0.9 * n


def test_decontamination_over_a_cut(spark):
    """75 words in a row of a long item are found wherever they begin."""
    item = [f"w{i}" for i in range(256)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    rows = [(i, f"{words(40, i, 5000)} {' '.join(item[i : i + 75])} {words(40, 500 + i, 5000)}", "en", "a") for i in range(182)]
    assert sorted(r["doc_id"] for r in decontaminate.leaks(docs_of(spark, rows), bench).collect()) == list(range(182))


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(50):
        a, b = [rng.randrange(4) for _ in range(rng.randint(1, 12))], [rng.randrange(4) for _ in range(rng.randint(0, 12))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.common_subsequence(a, b) == t[-1][-1]


def test_randomised_svd_spans_the_passages(spark):
    rng = np.random.default_rng(1)
    vocab = np.sort(rng.integers(1, 2**60, 80).astype(np.uint64))
    p = decontaminate.Pieces(np.arange(12), [rng.choice(vocab, 15) for _ in range(12)], vocab, rng.uniform(1, 5, 80))
    basis = decontaminate.randomised_svd(spark, p, rank=12)
    full = np.zeros((12, 80))
    for i, (place, weight) in enumerate(decontaminate._rows(p.words, vocab, p.idf)):
        full[i, place] = weight
    assert np.allclose(full @ basis @ basis.T, full, atol=1e-6)


def test_only_keys_beyond_the_bound(spark):
    a, b = spark.range(100), spark.range(50, 200)
    assert common.only_keys(a, b, ["id"], bound=10).count() == common.only_keys(a, b, ["id"]).count() == 50


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    bench = [(i, fake_language("en", 30, 900 + i)) for i in range(5)]
    rows = [(i, fake_language("en" if i % 2 else "de", rng.randint(30, 90), i), "en" if i % 2 else "de", f"s{i % 3}") for i in range(150)]
    rows += [(200 + i, rows[i][1] + " the end", rows[i][2], "s0") for i in range(20)]
    rows += [(300 + i, f"{fake_language('en', 40, 700 + i)} {bench[i][1]} {fake_language('en', 40, 800 + i)}", "en", "s1") for i in range(5)]
    rows += [(400, None, None, None), (401, "123 456", "en", "s2")]
    docs_of(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, str(tmp_path)), str(tmp_path / name))
        kept[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
    every = {r[0] for r in rows}
    assert set(kept["language_id"]) == every - {400, 401}
    assert set(kept["near_dedup"]) == set(kept["language_id"]) - set(range(200, 220))
    assert set(kept["decontamination"]) == set(kept["near_dedup"]) - set(range(300, 305))
    assert len(kept["mixing"]) > len(set(kept["mixing"])) and sorted(kept["sharding"]) == sorted(kept["mixing"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["sharding"])


def test_pipeline_decides_by_row(spark, tmp_path):
    """Rows that share an id or have none, repeated rows, columns with the operators'
    names, and empty tables."""
    import corpus_pipeline

    a, b, c = (fake_language("en", 60, k) for k in "abc")
    rows = [(0, a), (1, a + " end"), (1, b), (7, c), (7, c), (None, a), (None, None), (3, "")]
    docs_of(spark, [(*r, "en", None if r[0] == 7 else "s") for r in rows]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(b.split()[10:50]))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    near = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert near.columns == docs.columns
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in near.collect())
    assert kept == sorted([("0", a), ("1", b), ("7", c), ("3", "")])
    clean = corpus_pipeline.drop_benchmark(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and clean.count() == len(rows) - 1
    assert b not in {r["text"] for r in clean.collect()} and "1" in {str(r["doc_id"]) for r in clean.collect()}
    mixed = corpus_pipeline.mix_sources(spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns and {(r["doc_id"], r["text"]) for r in mixed.where("text IS NULL OR text = ''").collect()} == {(None, None), (3, "")}
    sizes = {r: len((r[1] or "").split()) for r in rows}
    assert abs(sum(len((r["text"] or "").split()) for r in mixed.collect()) - 1.5 * sum(sizes[r] for r in rows)) <= 60
    assert corpus_pipeline.place_in_shards(spark, docs, str(tmp_path)).count() == len(rows)
    assert {r["text"] for r in corpus_pipeline.keep_languages(spark, docs, str(tmp_path)).collect()} == {r[1] for r in rows if r[1]}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_queries_return_their_contract(spark):
    """Columns that the thin queries add, on the smallest tables."""
    from melisma.llm import registry

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in docs}
    got = {name: query(spark, sf).collect() for name, query in registry.QUERIES.items()}
    for name in ("op2_token_counts", "op3_exact_dedup", "op4_mixing", "op5_sharding", "op7_language_id", "op8_suffix_dedup", "op9_toxicity", "op10_minhash"):
        assert sorted(r["doc_id"] for r in got[name]) == sorted(docs), name
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) and r["n_bytes"] == len((docs[r["doc_id"]] or "").encode()) for r in got["op2_token_counts"])
    assert all(r["held_out"] == held[r["doc_id"]] and 0 <= r["score"] <= 1 for name in ("op7_language_id", "op9_toxicity") for r in got[name])
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got["op9_toxicity"])
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got["op4_mixing"])
    assert {r["law"] for r in got["op5_sharding"]} == {"rows"} and {r["grown_shard"] for r in got["op5_sharding"]} == {None}
    assert set(got["op1_decontaminate"][0].asDict()) >= {"doc_id", "item_id"}
    own = next(r for r in got["op6_chat_format"] if r["conv_id"] == -7)
    said = "\\### Assistant: </turn> ok"
    assert (own["n_turns"], own["loss_chars"]) == (2, len(said))
    assert own["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert own["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_cut_edges(spark):
    """No group that fits a shard is cut; the measure counts pairs in two shards."""
    texts = [f"copy {i // 5}" for i in range(2000)] + [f"single {i}" for i in range(500)]
    placed = sharding.shard_rows(docs_of(spark, [(i, x, "en", "a") for i, x in enumerate(texts)]))
    assert tuple(sharding.cut_edges(placed, ["text_crc32", "size"]).first()) == (4000.0, 0.0)
    apart = spark.createDataFrame([(1, 0), (1, 0), (1, 3), (2, 4)], "g int, shard int")
    assert tuple(sharding.cut_edges(apart, ["g"]).first()) == (3.0, 2.0)
