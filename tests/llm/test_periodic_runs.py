"""Runs against a brute force that tries every period and start."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from clickweave.llm import periodic_runs as P


def brute(w, least=12):
    """Every maximal stretch of its smallest period, straight from the definition."""
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                best.setdefault((i, j + q), q)
            i = j
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def words(text):
    return [c.encode() for c in text]


def near_periodic(rng, n):
    """Nested and neighbouring repetitions over few words, with some words changed."""
    out = []
    while len(out) < n:
        root = [rng.choice("ab") for _ in range(rng.randint(1, 6))]
        part = root * rng.randint(1, 40)
        part = part + [rng.choice("abc") for _ in range(rng.randint(0, 2))]
        out += part * rng.choice([1, 1, 2, 3])
    out = out[:n]
    for _ in range(rng.randint(0, 4)):
        out[rng.randrange(len(out))] = rng.choice("abcd")
    return [x.encode() for x in out]


@pytest.fixture(params=[4, 16, 64])
def short(request, monkeypatch):
    """Scales from small lags on, so that small texts meet them."""
    monkeypatch.setattr(P, "SHORT", request.param)


def test_every_run_of_crafted_texts(short):
    rng = random.Random(3)
    docs = [near_periodic(rng, rng.randint(1, 500)) for _ in range(120)]
    docs += [words("ab" * 30 + "a" + "ab" * 30), words("a" * 300), words("a" * 100 + "b" + "a" * 100 + "b" + "a" * 60), [], words("abc"), words("x" * 11), words("x" * 12)]
    docs += [words(("ab" * 20 + "c" + "ab" * 20 + "d") * 4), words("".join(rng.choice("abcdefgh") for _ in range(150)) * 3)]
    assert P.runs_of(docs) == [brute(d) for d in docs]


@settings(deadline=None, derandomize=True, max_examples=150)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=9), st.integers(1, 30)), min_size=1, max_size=6), st.sampled_from([4, 8, 32]))
def test_every_run_of_repeated_roots(parts, least_lag):
    w = words("".join(root * n for root, n in parts))
    before, P.SHORT = P.SHORT, least_lag
    try:
        assert P.runs_of([w, w[:20]]) == [brute(w), brute(w[:20])]
    finally:
        P.SHORT = before


def test_long_periods_at_the_real_scales():
    rng = random.Random(8)
    vocabulary = [f"w{i}".encode() for i in range(3000)]
    docs = []
    for q in (63, 64, 65, 127, 128, 129, 700, 1500):
        root = [rng.choice(vocabulary) for _ in range(q)]
        head = [rng.choice(vocabulary) for _ in range(rng.randint(0, 90))]
        docs += [head + root * 2, head + (root * 4)[:3 * q + q // 3] + head, root + root[:-1]]
    got = P.runs_of(docs)
    assert got == [brute(d) for d in docs]
    assert {r[2] for d in got for r in d} >= {63, 64, 65, 127, 128, 129, 700, 1500}


def test_a_giant_document_of_one_word_or_two():
    w = words("ab") * 150_000
    assert P.runs_of([w, [b"a"] * 200_000]) == [[(0, 300_000, 2)], [(0, 200_000, 1)]]


def planted(i, w):
    h, n = zlib.crc32(str(i).encode()), len(w)
    if i is None or h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[x] if x < a else w[a + (x - a) % p] for x in range(n)]


def test_report_equals_brute_force(make_docs):
    rng = random.Random(5)
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choice(["the", "of", "é", "Ä", "cat", "dog"]) for _ in range(rng.randint(0, 160)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (None, "a b " * 20), (303, "x " * 5000), (304, "same " * 30), (304, "same " * 30), (305, "no break " * 12)]
    got = P.run_report(P.periodic_runs(make_docs(rows, extra=("runs", "best", "collapsed")).repartition(3), prepare=P.planted)).collect()
    want = []
    for i, t in rows:
        w = planted(i, (t or "").encode().split())
        runs = brute(w)
        top = min(((-n, s, q) for s, n, q in runs), default=None)
        gone = {x for s, n, q in runs for x in range(s + q, s + n)}
        want.append((i, len(runs), *((top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4),
                     hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
                     hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest(), len(w)))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert sum(r.n_runs > 0 for r in got) > 25


def test_no_rows_and_no_text(make_docs):
    assert P.run_report(P.periodic_runs(make_docs([]))).collect() == []
    r = P.run_report(P.periodic_runs(make_docs([(1, None)]))).first()
    empty = hashlib.sha256(b"").hexdigest()
    assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == (0, None, None, None, None, empty, empty)
