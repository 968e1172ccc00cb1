"""The pipeline against each stage's brute force on its own input, and the registered queries."""

import random

import duckdb
import pytest
import sentencepiece

import __spark_entry__
import corpus_pipeline
from clickweave.llm.common import written
from clickweave.llm.queries import ORACLE, QUERIES, piece_model

SF = "/root/testdata/sf0.001"


def test_names():
    assert [n for n in QUERIES] == sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0])) and len(QUERIES) == 13
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracles(spark, name):
    con = duckdb.connect()
    for name_ in ("documents", "pages"):
        con.execute(f"create view {name_} as select * from read_parquet('{SF}/{name_}.parquet')")
    want = con.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF).select(*columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_stages(spark, make_docs, table):
    from test_hyperminhash import brute as near
    from test_quality_rules import brute as rules

    rng = random.Random(18)
    words = [f"{a}{b}" for a in ("walk", "stone", "river", "green", "letter", "quiet") for b in ("s", "ed", "ing", "er", "ly", "")]
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(30, 90))) for _ in range(160)]
    rows = [(i, t, "en", rng.choice("ab")) for i, t in enumerate(prose)]
    rows += [(200 + i, prose[i], "en", "a") for i in range(20)]  # copies
    rows += [(300 + i, prose[30 + i] + " more", "en", "b") for i in range(20)]  # near copies
    rows += [(400 + i, "short", "en", "a") for i in range(5)] + [(500, None, "en", None), (501, "", None, "a")]
    docs = table(make_docs(rows, extra=("rid", "size")))
    stages = dict(corpus_pipeline.STAGES)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "test-stage")
        seen[name] = docs
    ids = {n: sorted(r.doc_id for r in d.select("doc_id").collect()) for n, d in seen.items()}
    good = [r for r in rows if not rules(r[1])[-1]]
    assert ids["quality rules"] == sorted(r[0] for r in good)  # prose without outliers
    last = {t: i for i, t, *_ in good}
    assert ids["exact dedup"] == sorted(max(r[0] for r in good if r[1] == t) for t in last)
    left = [(r.doc_id, r.text) for r in seen["exact dedup"].collect()]
    assert ids["MinHash near-dedup"] == sorted(i for i, _, _, kept in near(left, 5) if kept)
    assert all(seen[n].columns == seen["quality rules"].columns for n in list(stages)[:4])
    sizes, mixed = {}, {}
    for r in seen["MinHash near-dedup"].collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    for r in seen["mixing sources"].collect():
        mixed[r.source] = mixed.get(r.source, 0) + len(r.text.split())
    total = sum(sizes.values())
    assert abs(mixed["a"] - min(total * 5 / 7, 3 * sizes["a"])) <= 1 and abs(sum(mixed.values()) - total) <= 2
    library = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    assert sorted((r.doc_id, list(r.ids)) for r in seen["SentencePiece encoding"].collect()) == sorted(
        (r.doc_id, library.encode(r.text)) for r in seen["mixing sources"].collect())


def test_stages_of_an_empty_table(spark, make_docs, table):
    docs = table(make_docs([]))
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "test-stage")
        assert docs.count() == 0, name
    assert {"doc_id", "ids", "decoded_sha256"} <= set(docs.columns)


def test_a_giant_text_goes_through_all_stages(spark, make_docs, table):
    rng = random.Random(20)
    words = [f"{a}{b}" for a in ("walk", "stone", "river", "green", "letter", "quiet") for b in ("s", "ed", "ing", "er", "ly", "")]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(30, 90))), "en", "a") for i in range(120)]
    giant = " ".join(rng.choice(words) for _ in range(60_000))
    rows += [(900, giant, "en", "a"), (901, giant, "en", "a"), (902, giant + " more", "en", None), (903, None, None, None), (None, "short", None, "a")]
    docs = table(make_docs(rows))
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "test-stage")
    got = docs.where("n_chars > 300000").collect()
    # a copy and a near copy go: one giant text is left
    assert len({r.doc_id for r in got}) == 1
    library = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    texts = {901: giant, 902: giant + " more", 900: giant}
    whole = [r for r in got if r.n_chars == len(texts[r.doc_id])]
    assert whole and all(list(r.ids) == library.encode(texts[r.doc_id]) and r.n_chunks > 1 for r in whole)
