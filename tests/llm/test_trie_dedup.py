import hashlib
import random

from hypothesis import given, settings, strategies as st

from clickweave.llm.trie_dedup import Trie, _key_owners, deduplicate, trie_owners


@settings(deadline=None, derandomize=True, max_examples=60)
@given(st.lists(st.binary(max_size=6), max_size=40))
def test_trie_holds_exactly_its_keys(keys):
    trie = Trie()
    for k in keys:
        node = trie.at(k)
        node[2] = (node[2] or 0) + 1
    assert dict(trie.items()) == {k: keys.count(k) for k in keys}


def test_spilled_subtrees_give_the_same_owners():
    rng = random.Random(4)
    rows = [(bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 9))), i, rng.choice([None, i % 50]), 1 + i % 3) for i in range(2000)]
    assert sorted(map(repr, _key_owners(iter(rows), 1 << 40))) == sorted(map(repr, _key_owners(iter(rows), 2000)))


ROWS = [(1, "a"), (2, "a"), (3, "a "), (4, None), (5, ""), (6, "A"), (7, "é"), (8, "é"), (None, "a"), (None, "only"), (9, "x" * 300_000),
        (10, "x" * 300_000), (11, "x" * 299_999 + "y"), (12, "twice"), (12, "twice"), (12, "other")]


def test_owners_and_groups(make_docs):
    got = trie_owners(make_docs(ROWS, extra=("handle", "kept", "ids")).repartition(3)).collect()
    by_text = {}
    for i, t in ROWS:
        by_text.setdefault(t or "", []).append(i)
    want = sorted((repr(i), repr(max((x for x in by_text[t or ""] if x is not None), default=None)), len(by_text[t or ""]),
                   hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ROWS)
    assert sorted((repr(r.doc_id), repr(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(by_text)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_tries_that_overflow_change_nothing(make_docs):
    docs = make_docs([(i, f"text {i % 37}") for i in range(300)]).repartition(2)
    a, b = trie_owners(docs), trie_owners(docs, budget=500)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_one_row_of_each_text_stays(make_docs, table):
    docs = table(make_docs(ROWS, extra=("_id", "_sha")))
    left = deduplicate(docs)
    assert left.columns == docs.columns
    assert sorted(repr((r.doc_id, r.text or "")) for r in left.collect()) == sorted(
        repr((i, t)) for i, t in {(2, "a"), (3, "a "), (5, ""), (6, "A"), (7, "é"), (8, "é"), (None, "only"), (10, "x" * 300_000),
                                  (11, "x" * 299_999 + "y"), (12, "twice"), (12, "other")})


def test_no_rows(make_docs):
    assert trie_owners(make_docs([])).collect() == []
