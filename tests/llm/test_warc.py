"""Archives written and read back, and the salvage of damaged ones."""

import base64
import hashlib
import random

import pytest

from clickweave.config import new_shared_path
from clickweave.llm import warc as W

PAGES = "page_id long, url string, html string"
ROWS = [(1, "http://a/ b\n", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://c", "<p>zwei é</p>"), (4, "http://d", None), (5, "http://e", ""),
        (6, "http://f", "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"), (7, "http://g", "x" * (17 << 20)), (None, "http://h", "<p>one</p>"),
        (None, "http://i", "alone"), (None, "http://j", "alone"), (9, "http://k", "twice"), (9, "http://k", "twice"), (8, "http://l", "twice"),
        (10, "http://m", "tail\r\n\r\n")]


def brute(rows, least=0):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "")]
        top = max((j for j in same if j is not None), default=None)
        visit = len(same) > 1 and top is not None and i != top and len(data) >= least
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if visit else "response", top if visit else None))
    return sorted(map(repr, out))


@pytest.mark.parametrize("compressed,torn", [(True, 0), (True, 2), (False, 0), (False, 3)])
def test_round_trip(spark, compressed, torn):
    path = new_shared_path(spark, "test-warc")
    pages = spark.createDataFrame(ROWS, PAGES).selectExpr("*", "1 as owner", "'x' as key", "2 as part").repartition(2)
    W.write_archives(pages, path, compressed=compressed, torn_every=torn, archive_bytes=20_000)
    read = W.read_archives(spark, path)
    assert sorted(map(repr, map(tuple, W.page_report(read).collect()))) == brute(ROWS)
    by_id = {r.record_id: r for r in read.where("record_type = 'response' and record_id <> '<urn:page:>'").collect()}
    assert {k: bytes(r.payload) for k, r in by_id.items()} == {
        f"<urn:page:{i}>": (next(h for j, _, h in ROWS if j == i) or "").encode() for i in (2, 3, 5, 6, 7, 9, 10)}
    assert by_id["<urn:page:6>"].target_uri == "http://f" and by_id["<urn:page:2>"].target_uri is None
    gaps = W.quarantined(read).collect()
    assert (len(gaps) > 0) == bool(torn) and all(g.end > g.start and g.reason for g in gaps)


def test_a_size_under_which_all_are_responses(spark):
    path = new_shared_path(spark, "test-warc")
    W.write_archives(spark.createDataFrame(ROWS, PAGES), path, least_bytes=6)
    assert sorted(map(repr, map(tuple, W.page_report(W.read_archives(spark, path)).collect()))) == brute(ROWS, 6)


def test_no_pages(spark):
    path = new_shared_path(spark, "test-warc")
    W.write_archives(spark.createDataFrame([], PAGES), path)
    assert W.page_report(W.read_archives(spark, path)).collect() == []


def records(n, compressed, rng):
    plain = [W.page_record(i, f"http://x/{i}", bytes(rng.choices(b"abc <>\r\n", k=rng.randint(0, 900))), None, "2024-01-01T00:00:00Z") for i in range(n)]
    return [W.member(r) if compressed else r for r in plain]


def ids(found):
    return [x[2]["warc-record-id"] for x in found if len(x) == 5]


@pytest.mark.parametrize("compressed", [True, False])
def test_damage_costs_the_records_that_it_hits_only(compressed):
    rng = random.Random(2)
    for trial in range(150):
        parts = records(12, compressed, rng)
        hit = set(rng.sample(range(12), rng.randint(1, 4)))
        data, spans, at = b"", [], 0
        for i, p in enumerate(parts):
            if i in hit:
                way = trial % 4
                k = rng.randrange(20, len(p) - 4)
                if way == 0:  # a changed byte
                    p = p[:k] + bytes([p[k] ^ 0x55]) + p[k + 1:]
                elif way == 1:  # cut short
                    p = p[:k]
                elif way == 2:  # zeros
                    p = p[:k] + b"\0" * 4 + p[k + 4:]
                    p = p if p != parts[i] else b"\0" + p[1:]
                else:  # no start
                    p = p[9:]
            spans.append((at, at + len(p)))
            data, at = data + p, at + len(p)
        found = list(W.salvage(data))
        assert {f"<urn:page:{i}>" for i in range(12) if i not in hit} <= set(ids(found))
        # everything is either a record or in a gap, once and in order
        places = []
        for x in found:
            if not places or (x[0], x[1]) != places[-1]:
                places.append((x[0], x[1]))
        assert places[0][0] == 0 and places[-1][1] == len(data)
        assert all(a[1] == b[0] for a, b in zip(places, places[1:]))
        whole = [s for i, s in enumerate(spans) if i not in hit]
        assert all(not any(g[0] < e and s < g[1] for s, e in whole) for g in found if len(g) == 3)


def test_reasons_and_odd_archives():
    good = W.page_record(1, "u", b"body", None, "d")
    assert list(W.salvage(b"")) == []
    assert [len(x) for x in W.salvage(b"junk" + good + b"junk")] == [3, 5, 3]
    assert ids(W.salvage(W.member(good + good.replace(b"page:1", b"page:2")))) == ["<urn:page:1>", "<urn:page:2>"]  # two records in a member
    assert ids(W.salvage(W.member(good) + good)) == ["<urn:page:1>"] * 2  # members and plain records in one file
    reason = {name: next(x[2] for x in W.salvage(data) if len(x) == 3) for name, data in {
        "digest": good.replace(b"body", b"bodi"), "length": good.replace(b"Content-Length: 8", b"Content-Length: 7", 1) + good,
        "cut": W.member(good)[:-3], "crc": W.member(good)[:-8] + b"1234" + W.member(good)[-4:], "none": b"\x1f\x8b" + b"0" * 50}.items()}
    for k in range(1, len(good)):  # a torn record before the whole one, cut anywhere
        assert [(len(x), x[0]) for x in W.salvage(good[:k] + good)] == [(3, 0), (5, k)]
    assert reason["digest"] == "block digest differs" and reason["cut"] == "member cut short"
    assert reason["crc"] == reason["none"] == "member fails its checks"


def test_many_false_starts_are_passed_over():
    good = W.page_record(1, "u", b"body", None, "d")
    data = b"WARC/1.1\r\nContent-Length: 99\r\n\r\n" * 3000 + b"\x1f\x8b\x08\x00" * 3000 + W.member(good)
    found = list(W.salvage(data))
    assert [len(x) for x in found] == [3, 5]
