import sentencepiece

from clickweave.llm.queries import piece_model
from clickweave.llm.token_counts import Pieces, token_counts

MODEL = piece_model()
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
ODD = [(1, None), (2, ""), (3, "  a  b "), (4, "x" * 5000), (5, "日本語" * 900), (6, "é\n\r\n\x00a▁b " * 300), (7, "<s> </s> <unk> a" * 200),
       (8, " lead"), (9, "😀" * 700 + " end"), (10, "aaaa  bb" * 400), (None, "n"), (11, "walking the river " * 300), (12, "twice"), (12, "twice")]


def test_counts_are_the_librarys(make_docs):
    for params in ({}, {"chunk": 300, "overlap": 4}, {"chunk": 1000, "overlap": 64}):
        got = token_counts(make_docs(ODD, extra=("rid", "huge", "n_tokens")), MODEL, limit=600, **params).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(
            repr((i, len((t or "").encode()), n, n > 600)) for i, t in ODD for n in [len(LIBRARY.encode(t or ""))])
    assert token_counts(make_docs([]), MODEL).collect() == []


def test_overlaps_widen_until_chunks_align(make_docs):
    """A text without any stable boundary is counted whole in the end."""
    pieces = Pieces(MODEL)
    text = "a" * 3000
    assert pieces.first_stable(text, 1, len(text)) == -1
    got = token_counts(make_docs([(1, text)]), MODEL, chunk=200, overlap=2).collect()
    assert got[0].n_tokens == len(LIBRARY.encode(text))
