import random
import re
import string

from clickweave.llm.license_scan import BASE, NOTICES, Template, license_scan

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(i, t.label) for t in BASE for p in [t.text.split()] for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


ROWS = [(1, None), (2, ""), (3, "CC"), (4, "cc-by cc BY cc by"), (5, "GNU General Public License; All rights reserved."),
        (6, "all rights reserved all rights reserved " * 40), (7, "É CC ÉBY cc_by"), (8, "x" * 5000 + " cc by"), (None, "cc by"),
        (9, "cc by"), (9, "cc by"), (10, "Allrights reserved all rights"), (11, "the " * 3000)]


def test_base_places_equal_brute_force(make_docs):
    got = license_scan(make_docs(ROWS, extra=("n", "rid", "labels", "score"))).collect()
    assert sorted(map(repr, ((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got))) == \
        sorted(map(repr, ((i, *brute(t)) for i, t in ROWS)))
    assert all(0 <= r.score <= 1 for r in got)


def test_long_notice_with_a_changed_and_a_missing_word(make_docs):
    notice = next(t.text for t in NOTICES if t.label == "bsd").split()
    bent = notice[:9] + ["twisted"] + notice[10:15] + notice[16:]
    got = {r.doc_id: r for r in license_scan(make_docs([(1, " ".join(["a"] * 30 + notice)), (2, " ".join(bent)),
                                                        (3, " ".join(notice[:8]))])).collect()}
    assert (got[1].labels, got[1].score) == ("bsd", 1.0)
    assert got[2].labels == "" or got[2].score >= 0.5
    assert got[3].labels == ""


def test_neighbouring_diagonals_are_merged(make_docs):
    t = (Template("x", "a b c d e f g h i j k l m n o p", 0.7, 2),)
    got = {r.doc_id: r for r in license_scan(make_docs([(1, "a b c d e f g h zz i j k l m n o p"), (2, "a b c d e f g h")]), t).collect()}
    assert got[1].labels == "x" and 0.8 < got[1].score < 1 and got[2].labels == ""


def test_no_rows(make_docs):
    assert license_scan(make_docs([])).collect() == []


def brute_spans(text, templates):
    """Labels and the best coverage, by comparing every place with every template position."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    labels, best = set(), 0.0
    for t in templates:
        want = t.text.split()
        k, grams = min(3, len(want)), max(1, len(want) - 2)
        votes = {}
        for p in range(len(words) - k + 1):
            for o in range(len(want) - k + 1):
                if words[p:p + k] == want[o:o + k]:
                    votes.setdefault(p - o, set()).add(o)
        chains = []
        for d in sorted(votes):
            if chains and d - chains[-1][-1] <= t.drift:
                chains[-1].append(d)
            else:
                chains.append([d])
        for chain in chains:
            lo, n = chain[0], len(want)
            parts = [chain] if chain[-1] - lo <= n else [[d for d in chain if (d - lo) // n in (w, w + 1)] for w in range(-1, (chain[-1] - lo) // n + 1)]
            for part in parts:
                share = len(set().union(*(votes[d] for d in part))) / grams
                if share >= t.need:
                    labels.add(t.label)
                    best = max(best, share)
    return ",".join(sorted(labels)), best


def noisy(rng, notice):
    out = []
    for w in notice:
        x = rng.random()
        out += [] if x < 0.05 else [w, "zz"] if x < 0.1 else ["qq"] if x < 0.13 else [w]
    return out


def notices(rng):
    texts = ["redistribution and use " * 14, "the license " * 500, "you may not use this file " * 60]
    for t in NOTICES:
        w = t.text.split()
        texts += [" ".join(w), " ".join(w * 3), " ".join(["and", "use", "in"] * 30 + noisy(rng, w) + ["the", "license"] * 30), " ".join(noisy(rng, w)), " ".join(w[::2])]
    rep = next(t.text for t in NOTICES if t.label == "bsd").split()
    texts.append(" ".join(["redistribution", "and", "use"] * 40 + rep + ["redistribution", "and", "use"] * 40))  # inside a chain
    return list(enumerate(texts))


def test_labels_and_scores_equal_brute_force(make_docs):
    rows = notices(random.Random(12))
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in license_scan(make_docs(rows)).collect()}
    want = {i: brute_spans(t, BASE + NOTICES) for i, t in rows}
    assert got == {i: (x, round(s, 9)) for i, (x, s) in want.items()}
    assert got[0] == ("", 0.0) and "bsd" in got[len(rows) - 1][0]


def test_templates_from_a_table(spark, make_docs, monkeypatch):
    import clickweave.llm.common as common

    rows = notices(random.Random(13))
    table = spark.createDataFrame([(t.label, t.text.upper(), t.need, t.drift, t.base) for t in BASE + NOTICES] * 2 + [("one", "word", 1.0, 0, None), ("none", None, 1.0, 0, None)],
                                  "label string, text string, need double, drift int, base boolean")
    want = sorted(map(tuple, license_scan(make_docs(rows)).collect()))
    assert sorted(map(tuple, license_scan(make_docs(rows), table).collect())) == want
    monkeypatch.setattr(common.bounded, "__defaults__", (None, 0))  # too many to be broadcast
    assert sorted(map(tuple, license_scan(make_docs(rows), table).collect())) == want
