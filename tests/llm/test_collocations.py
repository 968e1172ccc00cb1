"""Summaries against their guarantee, and phrases against a brute force over all of them."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from clickweave.llm import collocations as C


@settings(deadline=None, derandomize=True, max_examples=100)
@given(st.lists(st.lists(st.integers(0, 40), max_size=60), min_size=1, max_size=8), st.integers(1, 12))
def test_summary_keeps_its_bounds(parts, capacity):
    summary, mass = C.MisraGries(capacity), 0
    for p in parts:
        c = Counter(p)
        mass += len(p)
        summary.merge(np.array(list(c), np.uint64), np.array(list(c.values()), np.int64))
        assert len(summary.keys) <= capacity
    true = Counter(x for p in parts for x in p)
    held = dict(zip(summary.keys.tolist(), summary.counts.tolist()))
    assert summary.error * (capacity + 1) <= mass
    assert all(held.get(k, 0) <= n <= held.get(k, 0) + summary.error for k, n in true.items())
    assert {k for k, n in true.items() if n * (capacity + 1) > mass} <= set(held)


def test_two_summaries_merge():
    rng = random.Random(1)
    one, two, true = C.MisraGries(20), C.MisraGries(20), Counter()
    for s in (one, two):
        for _ in range(10):
            x = [int(rng.paretovariate(0.7)) % 500 for _ in range(300)]
            true.update(x)
            keys, counts = np.unique(np.array(x, np.uint64), return_counts=True)
            s.merge(keys, counts)
    one.merge(two.keys, two.counts, two.error)
    assert one.error * 21 <= 6000 and {k for k, n in true.items() if n >= 300} <= set(one.at_least(300).tolist())


def test_packing():
    keys = np.sort(np.random.default_rng(2).integers(0, 1 << 48, 1000).astype(np.uint64))
    counts = np.arange(1, 1001) ** 2
    got = C._unpacked(C._packed(keys, counts))
    assert (got[0] == keys).all() and (got[1] == counts).all()


def brute(rows, threshold=30, top=2000):
    """lang, rank, phrase, a, l, r, n, score by counting everything."""
    f, n = {}, Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        c = f.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                c.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= threshold}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()):
                continue
            s, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-s, -a, " ".join(p).encode(), a, c[p[:k]], c[p[k:]], n[lang], s))
        out += [(lang, i + 1, r[2].decode(), *r[3:]) for i, r in enumerate(sorted(rows)[:top])]
    return sorted(out)


def corpus(rng, n=500):
    vocabulary = [f"w{i}" for i in range(60)] + ["The", "the", "été", "ÉTÉ", "a-b", "x\x00y"]
    fixed = ["new york city hall", "of the", "Of The people", "ping pong", "été indien", "to be or not"]
    rows = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 40)):
            words.append(rng.choice(fixed) if rng.random() < 0.3 else vocabulary[min(len(vocabulary) - 1, int(rng.paretovariate(0.6)))])
            if rng.random() < 0.15:
                words[-1] += rng.choice([".", ",", "!", "\n", ";", " ? ", "\x0b"])
        rows.append((rng.choice([" ", "  ", "\t"]).join(words), rng.choice(["en", "en", "en", "fr", None])))
    return rows + [(None, "en"), ("", "de"), ("....", "es"), ("no no " * 200, "it"), ("ha " * 1000, None), ("yes\n" * 100, "it"), ("und so", "und")]


@pytest.mark.parametrize("chunk,partition,top", [(4 << 20, 6 << 20, 2000), (2000, 1000, 7)])
def test_equals_brute_force(make_docs, monkeypatch, chunk, partition, top):
    monkeypatch.setattr(C, "CHUNK", chunk)
    monkeypatch.setattr(C, "PARTITION", partition)
    rows = corpus(random.Random(4))
    docs = make_docs([(i, t, g) for i, (t, g) in enumerate(rows)], extra=("a", "f", "words", "key")).repartition(3)
    got = sorted(map(tuple, C.collocations(docs, top=top).collect()))
    assert got == brute(rows, top=top) and len(got) > 7


def test_a_full_filter_loses_nothing(make_docs, monkeypatch):
    monkeypatch.setattr(C, "LEAST_BITS", 15)
    monkeypatch.setattr(C, "MOST_BITS", 15)
    rows = corpus(random.Random(6), 200)
    docs = make_docs([(i, t, g) for i, (t, g) in enumerate(rows)])
    assert sorted(map(tuple, C.collocations(docs, threshold=3, slack=1).collect())) == brute(rows, threshold=3)


def test_scores_past_64_bits(spark):
    a, both = 9_000_000_000_000_000, 18_000_000_000_000_001
    got = spark.range(1).selectExpr(f"cast(cast({a}L as decimal(28,0)) * cast(2000000 as decimal(10,0)) div cast({both} as decimal(38,0)) as long) as s").first().s
    assert got == 2_000_000 * a // both


def test_no_rows(make_docs):
    assert C.collocations(make_docs([])).collect() == []
