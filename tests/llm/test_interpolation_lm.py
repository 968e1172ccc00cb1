import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute

from clickweave.llm.interpolation_lm import _answers, _asked, _chunk_counts, _packed, _unpacked, learned_weights, lm_scores


def rows(n=400):
    rng = random.Random(15)
    nouns, verbs = [f"n{i}" for i in range(30)], [f"v{i}" for i in range(15)]
    texts = [" ".join(f"the {rng.choice(nouns)} {rng.choice(verbs)}" for _ in range(rng.randint(1, 12))) for _ in range(n)]
    return list(enumerate(texts)) + [(1000, None), (1001, ""), (1002, "The THE É é"), (1003, "rare " + "x" * 5000), (1004, "long " * 4000), (None, "the n1"),
                                     (1005, "the n2 v3"), (1005, "the n2 v3")]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def test_counts_and_base_scores_equal_brute_force(make_docs):
    data = rows()
    tokens = [(i, (t or "").encode().lower().split() + [None]) for i, t in data]
    c = Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    docs = make_docs(data, extra=("chunk", "learn", "score"))
    for chunk_rows in (50, 4096):
        got = lm_scores(docs, chunk_rows=chunk_rows).collect()
        want = sorted((repr(i), held(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + .1) / (n + .1 * (v + 1))) for w in t), 6))
                      for i, t in tokens)
        assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want


def test_scores_do_not_depend_on_chunks_and_beat_the_base_on_held_out_texts(make_docs):
    docs = make_docs([r for r in rows() if r[0] is not None and r[0] != 1005])
    a = {r.doc_id: r for r in lm_scores(docs, chunk_rows=30).collect()}
    b = {r.doc_id: r for r in lm_scores(docs, chunk_rows=4096).collect()}
    assert all(abs(a[i].score - b[i].score) < 1e-6 for i in a)
    out = [r for r in a.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 50
    assert all(r.score < 0 for r in a.values())


def test_expectation_maximisation_finds_the_mixture():
    events = [(3, 2, 10, 700), (3, -1, 4, 200), (3, -1, 30, 100)]
    w = learned_weights(events, 1 << 12)
    assert all(abs(sum(x) - 1) < 1e-9 and min(x[1:]) > 0 for x in w) and w[0][0] == 0

    def likelihood(x):
        return sum(n * math.log(x[0] * (0.5 ** (a / 2) if a >= 0 else 0) + x[1] * 0.5 ** (b / 2) + x[2] / 4097) for _, a, b, n in events)

    rng = random.Random(16)
    for _ in range(300):
        p = [rng.expovariate(1) for _ in range(3)]
        assert likelihood([x / sum(p) for x in p]) <= likelihood(w[3]) + 1e-3


def test_counts_beyond_32_bits():
    # a text learned 3,000,000,000 times in each of two chunks, the second one deleted
    text, times = b"the cat the", 3_000_000_000
    asked = pa.Table.from_batches([b for chunk in (0, 1) for b in _asked(chunk, [text], [times], 0)])
    told = pa.concat_tables([_answers(asked.filter(pa.compute.equal(asked["kind"], kind))) for kind in (0, 1)])
    facts = [sum(told[c].to_pylist()) for c in ("types", "tokens", "deleted", "ends")]
    assert facts == [3, 8 * times, 4 * times, 2 * times]
    told = told.filter(pa.compute.equal(told["chunk"], 1))
    own, pair, _, _ = _chunk_counts([text], told, "all")
    assert own.tolist() == [4 * times, 2 * times, 4 * times, 2 * times] and pair.tolist() == [2 * times] * 4
    own, pair, _, _ = _chunk_counts([text], told, "kept")
    assert own.tolist() == [2 * times, times, 2 * times, times] and pair.tolist() == [times] * 4


def test_byte_planes_round_trip():
    for kind in (np.uint32, np.uint64):
        x = np.random.default_rng(2).integers(0, 1 << 31, 1000).astype(kind)
        assert (_unpacked(_packed(x), kind) == x).all()


def test_no_rows_and_no_training_rows(make_docs):
    assert lm_scores(make_docs([])).collect() == []
    only = next(i for i in range(100) if held(i))
    got = lm_scores(make_docs([(only, "a b")])).collect()[0]
    assert (got.n_tokens, got.n_known, got.train_tokens) == (3, 0, 0) and math.isfinite(got.score) and math.isfinite(got.base_score)


def test_chunks_are_bounded_in_bytes(spark, make_docs):
    """A stretch of long texts is cut into more chunks; a giant one is alone; and nothing else changes."""
    from pyspark.sql import functions as F

    from clickweave.llm.interpolation_lm import chunk_ids

    rng = random.Random(17)
    sizes = [rng.choice([0, 1, 10, 4096, 4097, 9000, 40_000, 300_000]) for _ in range(200)]
    rows = [(i, ("word " * (n // 5 + 1))[:n]) for i, n in enumerate(sizes)]
    docs = make_docs(rows).coalesce(1)
    got = docs.select("doc_id", F.octet_length("text").alias("n"), chunk_ids(F.octet_length("text"), F.col("doc_id") % 3 == 0, 16).alias("c")).collect()
    per = {}
    for r in got:
        per.setdefault(r.c, []).append(r.n)
        assert (r.c & 1) == (r.doc_id % 3 == 0)
    assert all(sum(ns) <= 2 * 16 * 4096 or len(ns) == 1 for ns in per.values()) and any(len(ns) > 5 for ns in per.values())
    a, b = (sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm_scores(docs, chunk_rows=k).collect()) for k in (2, 4096))
    assert a == b


def test_scores_equal_brute_force(spark, make_docs):
    """Counts, deleted texts, event table, weights and mixture from the definitions."""
    from pyspark.sql import functions as F

    data = [r for r in rows(300) if r[0] is not None and r[0] != 1005]
    gone = spark.createDataFrame([(i,) for i, _ in data], "i long").where(F.pmod(F.xxhash64(F.lit("deleted"), "i"), F.lit(10)) == 0)
    gone = {r.i for r in gone.collect() if not held(r.i)}
    assert len(gone) > 10
    texts = {i: (t or "").encode().lower().split() + [None] for i, t in data}
    count = {}
    for name, ids in (("all", [i for i in texts if not held(i)]), ("kept", [i for i in texts if not held(i) and i not in gone])):
        words, pairs = Counter(), Counter()
        for i in ids:
            words.update(texts[i])
            pairs.update(zip(["start", *texts[i]], texts[i]))
        count[name] = words, pairs, sum(words.values()), len(ids)
    types = len(count["all"][0])

    def estimates(i, name, ends):
        words, pairs, n, _ = count[name]
        for k, w in enumerate(texts[i]):
            before = texts[i][k - 1] if k else "start"
            context = words[before] if k else ends
            bucket = 1 + min(int(math.log2(context)), 21) if context else 0
            yield bucket, pairs[before, w] / context if context else 0.0, words[w] / n

    def octave(x):
        return min(round(-math.log2(x) * 2), 127) if x else -1

    ends = round(count["all"][3] * 0.9)
    events = Counter((b, octave(x), octave(y)) for i in gone for b, x, y in estimates(i, "kept", ends))
    weights = learned_weights(sorted((*k, n) for k, n in events.items()), types)
    got = {r.doc_id: r.score for r in lm_scores(make_docs(data), chunk_rows=37).collect()}
    for i in texts:
        want = sum(math.log10(weights[b][0] * x + weights[b][1] * y + weights[b][2] / (types + 1)) for b, x, y in estimates(i, "all", count["all"][3]))
        assert abs(got[i] - want) <= 1e-6 * max(1.0, abs(want)), i
