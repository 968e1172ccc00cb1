import random
import zlib

from clickweave.llm.compression_classifier import quality_scores, train


def text(rng, good):
    words = ["river", "stone", "walking", "green", "under", "morning", "quiet", "letter", "window", "sailing"]
    out = [rng.choice(words) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(20, 120))]
    return " ".join(out) if good else " ".join(w.upper() + "$$%" for w in out)


def corpus(make_docs, spark, n=300):
    rng = random.Random(17)
    quality = {i: int(rng.random() < 0.7) for i in range(n)}
    docs = [(i, text(rng, quality[i])) for i in range(n)]
    labels = spark.createDataFrame([(i, q, 0) for i, q in quality.items()], "doc_id long, quality int, toxic int")
    return docs, labels, quality


def test_held_out_accuracy_and_columns(make_docs, spark):
    docs, labels, quality = corpus(make_docs, spark)
    odd = [(1000, None), (1001, ""), (None, "river"), (1002, "x"), (1003, "river " * 20_000), (5, docs[5][1])]
    got = quality_scores(make_docs(docs + odd, extra=("saved", "bytes", "quality")), labels).collect()
    assert len(got) == len(docs) + len(odd)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    out = [r for r in got if r.held_out and r.doc_id in quality]
    assert len(out) > 50 and sum(r.predicted == quality[r.doc_id] for r in out) > 0.95 * len(out)


def test_held_out_labels_are_not_learned_from(make_docs, spark):
    docs, labels, quality = corpus(make_docs, spark, 150)
    other = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - quality else quality end as quality", "toxic")
    assert train(make_docs(docs), labels) == train(make_docs(docs), other)


def test_without_labels_of_both_classes(make_docs, spark):
    none = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_scores(make_docs([(1, "a b"), (2, None)]), none).collect()} == {0.5}
    assert quality_scores(make_docs([]), none).collect() == []


def test_a_class_of_short_texts_is_learned(make_docs, spark):
    docs, _, quality = corpus(make_docs, spark)
    rng = random.Random(19)
    for least in (1, 4):
        short = [(i, t if quality[i] else " ".join(f"BUY{rng.randint(0, 9)}$$" for _ in range(rng.randint(least, 6)))) for i, t in docs]
        assert all(len(t) < 64 for i, t in short if not quality[i])
        labels = spark.createDataFrame([(i, q, 0) for i, q in quality.items()], "doc_id long, quality int, toxic int")
        got = [r for r in quality_scores(make_docs(short), labels).collect() if r.held_out]
        assert len(got) > 50 and sum(r.predicted == quality[r.doc_id] for r in got) > 0.9 * len(got)
    # one tiny text
    few = [(i, t) for i, t in docs if quality[i]] + [(i, "B") for i, _ in docs if not quality[i]]
    assert all(0 <= r.score <= 1 for r in quality_scores(make_docs(few), labels).collect())


def test_scores_and_calibration_equal_brute_force(make_docs, spark):
    """Sizes by a plain compressor, block by block; the logistic curve is the likeliest one of the rows that
    calibrate it."""
    import math

    import zstandard
    from pyspark.sql import functions as F

    docs, labels, quality = corpus(make_docs, spark)
    docs += [(1000, None), (1001, ""), (1002, "x"), (1003, "river stone " * 9000), (None, "green")]
    m = train(make_docs(docs), labels)

    def difference(t):
        t = (t or "").encode()
        size = {}
        for name in ("good", "bad"):
            packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(getattr(m, name)), write_content_size=False, write_dict_id=False)
            size[name] = sum(len(packer.compress(t[i:i + m.block])) for i in range(0, len(t), m.block))
        return (size["bad"] - size["good"] + m.usual * 32) / (len(t) + 32)

    want = {i: 1 / (1 + math.exp(-(difference(t) * m.slope + m.offset))) for i, t in docs}
    got = {r.doc_id: r.score for r in quality_scores(make_docs(docs), labels, model=m).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    ids = spark.createDataFrame([(i,) for i in quality], "i long").where(F.pmod(F.xxhash64(F.lit("part"), "i"), F.lit(5)) == 4)
    used = [r.i for r in ids.collect() if zlib.crc32(str(r.i).encode()) % 3 != 1]
    text_of = dict(docs)
    bins = [(math.floor(difference(text_of[i]) * 1000 + 0.5) / 1000, quality[i]) for i in used]
    off = [(x, y - 1 / (1 + math.exp(-max(-500, min(500, m.slope * x + m.offset))))) for x, y in bins]
    assert len(bins) > 20 and abs(sum(e for _, e in off)) < 1e-4 and abs(sum(e * x for x, e in off) - 1e-4 * m.slope) < 1e-4
