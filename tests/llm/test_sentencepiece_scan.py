import random

import numpy as np
import pytest
import sentencepiece

from clickweave.llm.queries import piece_model
from clickweave.llm.sentencepiece_scan import Lattice, decode, encode, marked, product, states, with_digests

MODEL = piece_model()
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)


@pytest.fixture(scope="module")
def lattice():
    return Lattice(MODEL)


ODD = [(1, None), (2, ""), (3, " "), (4, "  a  b "), (5, "x" * 3000), (6, "日本語" * 500), (7, "é\n\r\n\x00a ;\r" * 200), (8, "<s> </s> <unk> <0x41>"),
       (9, "😀" * 300 + " end"), (10, "the theater's  walking " * 200), (None, "n"), (11, "aaaa" * 700), (12, "ab\x01\x02" * 300)]


def test_ids_are_the_librarys_and_decode_back(spark, make_docs):
    docs = make_docs(ODD, extra=("ids", "huge", "rid"))
    for chunk in (100, 16_384):
        encoded = encode(docs, MODEL, chunk=chunk)
        got = {r.doc_id: r for r in encoded.collect()}
        for i, t in ODD:
            assert list(got[i].ids) == LIBRARY.encode(t or ""), (i, chunk)
            assert (got[i].n_pieces, got[i].n_chars) == (len(got[i].ids), len(t or ""))
        assert (max(r.n_chunks for r in got.values()) > 40) == (chunk == 100)
    assert {r.doc_id: r.text for r in decode(encoded, MODEL).collect()} == {i: t or "" for i, t in ODD}
    assert encode(make_docs([]), MODEL).collect() == []


def test_stretches_without_certain_boundaries(lattice):
    """Chunks cut anywhere, inside pieces too: the states at the edges give the library's ids."""
    rng = random.Random(14)
    steps = ["the", "in", "er", "on", "a", "tion", "th", "ing", "日", "é", "st", " ", "  ", ".\n", "\x00"]
    for k in range(40):
        text = "".join(rng.choice(steps[:(6, 10, 12, 15)[k % 4]]) for _ in range(120))
        mk, size, around = marked(text), rng.choice([33, 50, 64]), 32
        edges = [0, *range(size, len(mk) - size + 1, size)]
        chunks = [(mk[max(0, a - around):e + around], a - max(0, a - around), e - max(0, a - around)) for a, e in zip(edges, [*edges[1:], len(mk)])]
        matrices = [lattice.transfer(*c) for c in chunks]
        at = states(matrices, 0, 0)
        ids = np.frombuffer(b"".join(lattice.trace(*c, at[i], at[i + 1]) for i, c in enumerate(chunks)), np.int32).tolist()
        assert ids == LIBRARY.encode(text)
        # any bracketing gives the same product, and it is the sum of the scores
        left = matrices[0]
        for m in matrices[1:]:
            left = product(left, m)
        right = matrices[-1]
        for m in matrices[-2::-1]:
            right = product(m, right)
        assert (left == right).all() and left[0, 0] == lattice.scores[ids].sum()


def test_many_blocks_of_chunks(make_docs):
    from clickweave.llm import sentencepiece_scan as s

    text = "the walking river " * 900
    docs = make_docs([(1, text)]).selectExpr("doc_id as rid", "text")
    got = s.scan_giants(docs, MODEL, 40, block=16).collect()
    assert list(got[0].ids) == LIBRARY.encode(text) and got[0].n_chunks > 256


def test_query_decodes_every_document(spark, make_docs, monkeypatch):
    import hashlib

    from clickweave.llm import sentencepiece_scan as s
    from clickweave.llm.queries import op4_sentencepiece_scan

    def digest(text):
        return hashlib.sha256((text or "").replace("\u2581", " ").encode()).hexdigest()

    sf = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = op4_sentencepiece_scan(spark, sf).select("doc_id", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted((r.doc_id, digest(r.text)) for r in texts)
    marks = [*ODD, (13, "a\u2581b \u2581"), (14, "😀\x01é" * 12_000)]
    got = s.with_digests(encode(make_docs(marks), MODEL), MODEL).collect()
    assert {r.doc_id: r.decoded_sha256 for r in got} == {i: digest(t) for i, t in marks}
    # in parts that would cut a character's bytes
    lattice = Lattice(MODEL)
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(s, "_DECODED", size)
        for _, t in marks:
            ids = LIBRARY.encode((t or "")[:400])
            assert s._digest(lattice, s.pa.array(ids, s.pa.int32())) == digest((t or "")[:400])


def test_digests_in_the_encoding_pass(make_docs):
    """Those of the ids decoded one by one, whatever the texts hold."""
    rng = random.Random(31)
    odd = ["", " ", "  a  b ", "\u2581mark \u2581", "naïve café \U0001f600\U0001f600 \x00\x01", "日本語 テキスト", "x" * 5000, "\n\t tabs\r\n", "a\u2581b c", None]
    rows = [(i, t) for i, t in enumerate(odd)] + [(100 + i, " ".join(rng.choice(["the", "of", "élan", "zürich", "\u0301x", "12,5", "\U0001f1e9\U0001f1ea"]) for _ in range(rng.randint(1, 400))))
                                                  for i in range(40)]
    docs = make_docs(rows)
    for chunk in (16_384, 300):
        one, two = encode(docs, MODEL, chunk, digests=True), with_digests(encode(docs, MODEL, chunk), MODEL)
        assert one.columns == two.columns and sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
