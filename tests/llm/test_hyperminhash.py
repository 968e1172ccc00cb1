import random
from collections import Counter

import numpy as np

from clickweave.llm.components import connected_components
from clickweave.llm.hyperminhash import EMPTY, band_keys, near_duplicates, one_of_each, registers, shingle_set


def brute(rows, k=4):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        n = min(k, len(w))
        sets[i] = frozenset(tuple(w[p:p + n]) for p in range(len(w) - n + 1)) if w else frozenset()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = {}
    for i, s in sets.items():
        for g in s:
            having.setdefault(g, []).append(i)
    for i in sets:
        common = Counter(j for g in sets[i] for j in having[g] if j != i)
        for j, n in common.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return sorted((i, len(sets[i]), root(i), i == root(i)) for i in sets)


def got(docs):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect())


def family(rng, size, edits, n=120, vocabulary=3000):
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(n)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_components_equal_brute_force(make_docs):
    rng = random.Random(10)
    texts = [t for edits in (1, 2, 3, 4, 5, 6) for t in family(rng, 12, edits)]
    texts += [t for n in (1, 2, 3, 4, 5, 7, 9, 14) for t in family(rng, 4, 1, n)]
    texts += ["", " \n", "Same Words", "same words", "same\twords", "one", "ONE", "É é x y", "é é x y", "x " * 2000, "x " * 30]
    rng.shuffle(texts)
    rows = [(7 * i % 1009, t) for i, t in enumerate(texts)] + [(2000, None)]
    assert got(make_docs(rows, extra=("id", "n", "digest", "rid"))) == brute(rows)


def test_a_chain_links_through_members_that_are_not_leaders(make_docs):
    """Texts that drift: neighbours are near, ends are not, and the smallest id is at an end."""
    rng = random.Random(11)
    words, rows = [f"w{i}" for i in range(200)], []
    for i in range(60):
        rows.append((i if i % 2 else 500 - i, " ".join(words)))
        words = list(words)
        for _ in range(3):
            words[rng.randrange(200)] = f"n{rng.randrange(10**6)}"
    want = brute(rows)
    assert len({c for _, _, c, _ in want}) < 20
    assert got(make_docs(rows)) == want


def test_a_large_group_of_near_copies(make_docs):
    rng = random.Random(12)
    rows = list(enumerate(family(rng, 400, 4, 150)))
    assert got(make_docs(rows)) == brute(rows)


def test_blocks_of_a_bucket(make_docs, monkeypatch):
    """Blocks of three members give what one block gives."""
    from clickweave.llm import hyperminhash

    monkeypatch.setattr(hyperminhash, "BLOCK", 3)
    rng = random.Random(13)
    rows = list(enumerate(t for _ in range(4) for t in family(rng, 40, 14)))
    rng.shuffle(rows)
    want = brute(rows)
    assert 10 < len({c for _, _, c, _ in want}) < 150
    assert got(make_docs(rows)) == want


def test_null_and_repeated_ids(make_docs, table):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, None), (2, "other text here now")]
    docs = table(make_docs(rows))
    r = sorted((repr(x.doc_id), x.n_shingles, x.component_id, x.kept) for x in near_duplicates(docs).collect())
    assert r == sorted([("None", 3, None, True), ("1", 3, 1, True), ("1", 3, 1, True), ("2", 3, 1, False), ("None", 0, None, True), ("2", 1, 2, True)])
    left = one_of_each(docs, words=4)
    assert left.columns == docs.columns
    assert sorted(repr((x.doc_id, x.text)) for x in left.collect()) == sorted(
        repr(x) for x in [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (None, None), (2, "other text here now")])
    assert near_duplicates(make_docs([])).collect() == []


def test_sets_that_share_an_id(make_docs):
    rng = random.Random(19)
    a, b = family(rng, 30, 12), family(rng, 30, 12)
    rows = [(i, t) for i, t in enumerate(a)] + [(i, t) for i, t in enumerate(b)]
    assert len(near_duplicates(make_docs(rows)).collect()) == 60


def test_registers_hold_leading_zeros_and_mantissa():
    s = np.sort(np.random.default_rng(3).integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    r = registers(s, 7)
    for bucket in (0, 1, 77, 127):
        bits = min(format(int(h) & ((1 << 57) - 1), "057b") for h in s if int(h) >> 57 == bucket)
        zeros = len(bits) - len(bits.lstrip("0"))
        assert r[bucket] == zeros << 10 | int(bits[zeros + 1:zeros + 11].ljust(10, "0"), 2)
    assert (registers(s[:1], 9) != EMPTY).sum() == 1 and len(band_keys(registers(s[:1], 7))) == 32


def test_shingles_of_short_texts():
    assert len(shingle_set(b"", 4)) == 0 and len(shingle_set(b"a b", 4)) == 1
    assert shingle_set(b"A b", 4).tolist() == shingle_set(b"a\n B", 4).tolist()
    assert len(shingle_set(b"a b c d a b c d a b c d", 4)) == 4


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(13)
    edges = [(i, i + 1) for i in range(0, 60)] + [(500, i) for i in range(100, 160)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(7, 7), (900, 901), (901, 900)]
    rng.shuffle(edges)
    found = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{i: 100 for i in [*range(100, 160), 500]}, **{200 + i: 200 for i in range(9)}, 900: 900, 901: 900}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_rows_of_apart_members_grow_with_the_members(spark, make_docs, monkeypatch):
    """Families whose members are all a little under the threshold: what leaves the block tasks is a few rows a
    member, not the pairs."""
    import clickweave.llm.hyperminhash as H

    real, sizes = H.written, {}

    def written(df, name):
        out = real(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(H, "written", written)
    for n in (60, 120):
        rng = random.Random(5)
        base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        rows = []
        for i in range(n):
            words = list(base)
            for k in rng.sample(range(150), 4):
                words[k] = f"e{i}-{k}"
            rows.append((i, " ".join(words)))
        got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(make_docs(rows)).collect())
        assert got == brute(rows)
        # a row per member and mixed bucket, of which a member has at most one per band
        assert 60 < sizes["near-questions"] <= sizes["near-blocks"] <= 32 * n
        assert sizes["near-more"] < n and sizes["near-pairs"] == 0
