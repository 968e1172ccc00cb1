"""Periodic runs of words (operator 12).

A run is a stretch of consecutive words whose smallest period is q (words q apart are identical), of
at least ``max(least, 2 * q)`` words, that no neighbouring word extends. Collapsing a run keeps its
first q words. For a lag q, a run of n words is a maximal stretch of n - q places whose word equals
the one q places on; of stretches that cover the same words the smallest lag is the period.

1. Periods under ``SHORT`` are too short for windows: each lag is scanned directly. A stretch as long
   as it must be holds a place that is a multiple of that length, so only those places are tried.
2. Longer ones, by scales of periods from A to 2A. The minimizer of a window is the leftmost smallest
   hash among A/2 neighbouring sequences of A/2 words. A window spans under A words, so in a run of
   period q >= A some window and the one q places on lie inside; they hold the same words, and their
   minimizers are equal and q apart. Every pair of equal minimizers from A to 2A apart is a seed.
3. Equal minimizers at most A/4 apart lie in a stretch of a smaller period, which is known already.
   They are one cluster. Pairs inside a cluster have multiples of its period as lags and yield the
   known run again; two clusters yield each of their lags once. Sequences equal and further apart than
   A/4 are at most eight in 2A words, so the seeds of a scale are a few per minimizer.
4. A seed is extended both ways, word by word, once for each stretch.

Nothing is sampled or capped: every run is found. Hashes only select places; words are compared by
codes that are exact in their block. Documents are independent of each other and are dealt to tasks
by Spark's scan; a task works on blocks of about ``BLOCK`` words, a longer document alone.

Defined cases: NULL, empty and blank texts have no words and no runs; a NULL id changes nothing;
equal rows have equal results; no rows, no result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from clickweave.llm.common import text_or_empty

SHORT, LEAST, BLOCK = 64, 12, 400_000
_C = np.uint64(0x9E3779B97F4A7C15)
Prepare = Callable[[int | None, list[bytes]], list[bytes]]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _block_codes(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all documents as one array of codes, and where each document starts. Between
    documents, and SHORT * 2 times at both ends, stand codes that occur once."""
    flat = [w for words in docs for w in words]
    codes = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int32)
    sizes = np.array([len(d) for d in docs], np.int64)
    pad = 2 * SHORT
    starts = pad + np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    out = -1 - np.arange(2 * pad + sizes.sum() + len(docs), dtype=np.int32)
    if len(codes):
        out[np.arange(len(codes)) + np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)] = codes
    return out, starts


def _matches(w: np.ndarray, i: int, j: int, way: int) -> int:
    """How many words from i and from j on, rightwards or leftwards, are equal pair by pair."""
    done, size = 0, 64
    while True:
        if way > 0:
            n = min(size, len(w) - j - done)
            differ = w[i + done:i + done + n] != w[j + done:j + done + n]
        else:
            n = min(size, i + 1 - done)
            differ = (w[i - done - n + 1:i - done + 1] != w[j - done - n + 1:j - done + 1])[::-1]
        if n <= 0:
            return done
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done, size = done + n, min(size * 4, 1 << 16)


class _Found:
    """Runs by (start, end), each with its smallest lag so far."""

    def __init__(self, w: np.ndarray, least: int):
        self.w, self.least, self.runs = w, least, {}

    def extend(self, p: int, q: int) -> int:
        """The end of the stretch of places that match at lag q around p, which is noted if it is a run."""
        left, right = _matches(self.w, p - 1, p - 1 + q, -1), _matches(self.w, p, p + q, 1)
        if left + right >= max(q, self.least - q):
            span = (p - left, p + right + q)
            self.runs[span] = min(q, self.runs.get(span, q))
        return p + right


def _scan_short(found: _Found, longest: int) -> None:
    """Every lag under SHORT (and no longer than half the longest document)."""
    w = found.w
    for q in range(1, min(SHORT, longest // 2 + 1)):
        need = max(q, found.least - q)
        at = np.arange(2 * SHORT, len(w) - 2 * SHORT, need)
        at = at[w[at] == w[at + q]]
        if not len(at):
            continue
        size = np.ones(len(at), np.int64)
        for way in (1, -1):
            alive = np.arange(len(at))
            for t in range(1, need):
                alive = alive[w[at[alive] + way * t] == w[at[alive] + way * t + q]]
                if not len(alive):
                    break
                size[alive] += 1
        end = -1
        for p in at[size >= need].tolist():
            if p >= end:
                end = found.extend(p, q)


def _smallest(h: np.ndarray, width: int) -> np.ndarray:
    """The place of the leftmost smallest value of each window of ``width`` (a power of two) values."""
    value, place, have = h, np.arange(len(h)), 1
    while have < width:
        right = value[have:] < value[:-have]
        value = np.where(right, value[have:], value[:-have])
        place = np.where(right, place[have:], place[:-have])
        have *= 2
    return place


def _seeds(equal: list[int], scale: int) -> Iterator[tuple[int, int]]:
    """(lag, place) of the pairs of equal minimizers, each lag of two clusters once."""
    clusters: list[list[int]] = []  # first, last, step
    for p in equal:
        if clusters and p - clusters[-1][1] <= scale // 4:
            c = clusters[-1]
            c[1], c[2] = p, gcd(c[2], p - c[1])
        else:
            clusters.append([p, p, 0])
    for x, (first, last, step) in enumerate(clusters):
        for first2, last2, step2 in clusters[x + 1:]:
            if first2 - last >= 2 * scale:
                break
            g, base = gcd(step, step2), first2 - first
            if not g:
                if scale <= base < 2 * scale:
                    yield base, first
                continue
            for q in range(base % g, 2 * scale, g):
                if q >= scale and base - (last - first) <= q <= base + (last2 - first2):
                    yield q, first + max(0, base - q)


def _scan_scales(found: _Found, starts: np.ndarray, sizes: np.ndarray) -> None:
    """Lags from SHORT on."""
    w = found.w
    place = np.arange(len(w))  # of the words still looked at
    h, grams, scale = _mixed((w.astype(np.int64).view(np.uint64) + np.uint64(1)) * _C), 1, SHORT
    owner = np.repeat(np.arange(len(starts) + 1), np.diff(np.concatenate([[0], starts, [len(w)]]))) - 1
    while True:
        long = sizes >= 2 * scale
        if not long.any():
            return
        stays = np.concatenate([long, [False]])[owner]  # the padding in front counts as no document
        place, h, owner = place[stays], h[stays], owner[stays]
        while grams < scale // 2:
            h = _mixed(h[:-grams] * _C + h[grams:])
            grams *= 2
        chosen = _smallest(h, scale // 2)
        chosen = chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])]
        key, doc, at = h[chosen], owner[:len(h)][chosen], place[:len(h)][chosen]
        order = np.argsort(key, kind="stable")
        key, doc, at = key[order], doc[order], at[order]
        same = (key[1:] == key[:-1]) & (doc[1:] == doc[:-1])
        seeds: list[tuple[int, int]] = []
        for i in np.flatnonzero(same & ~np.concatenate([[False], same[:-1]])).tolist():
            j = i + 1
            while j < len(same) and same[j]:
                j += 1
            seeds += _seeds(at[i:j + 1].tolist(), scale)
        end, lag = -1, -1
        for q, p in sorted(seeds):
            if q != lag:
                lag, end = q, -1
            if p >= end:
                end = found.extend(p, q)
        # arrays of equal length again: the last places have no sequence of their own
        place, owner = place[:len(h)], owner[:len(h)]
        scale *= 2


def runs_of(docs: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """Per document its runs (start, length, period), by start, then period."""
    w, starts = _block_codes(docs)
    sizes = np.array([len(d) for d in docs], np.int64)
    found = _Found(w, least)
    if len(docs) and sizes.max() >= least:
        _scan_short(found, int(sizes.max()))
        _scan_scales(found, starts, sizes)
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    for (s, e), q in found.runs.items():
        d = int(np.searchsorted(starts, s, "right")) - 1
        out[d].append((s - int(starts[d]), e - s, q))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that are in no run, or among the first period's words of every run that they are in."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        change[s + q] += 1
        change[s + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUNS_DDL = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _found_runs(batches: Iterable[pa.RecordBatch], least: int, prepare: Prepare | None) -> Iterator[pa.RecordBatch]:
    def block(ids: list, docs: list[list[bytes]]) -> pa.RecordBatch:
        runs = runs_of(docs, least)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
        columns = [pa.array(c, pa.int64()) for c in (zip(*[x for r in runs for x in r]) if offsets[-1] else ([], [], []))]
        texts = pa.array([b" ".join(collapsed(w, r)) for w, r in zip(docs, runs)], pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(w) for w in docs], pa.int64()),
             pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=list(_RUN))), texts.cast(pa.string())],
            names=["doc_id", "n_words", "runs", "collapsed"])

    for batch in batches:
        ids, docs, n = [], [], 0
        for i, text in zip(batch.column(0), batch.column(1)):
            words = text.as_buffer().to_pybytes().split()  # at ASCII white space alone
            i = i.as_py()
            words = prepare(i, words) if prepare else words
            if docs and n + len(words) > BLOCK:
                yield block(ids, docs)
                ids, docs, n = [], [], 0
            ids.append(i)
            docs.append(words)
            n += len(words)
        if docs:
            yield block(ids, docs)


def periodic_runs(docs: DataFrame, least: int = LEAST, prepare: Prepare | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (start, length, period; by start, then
    period) and the collapsed text, words joined by one space. ``prepare(doc_id, words)`` may give
    other words in place of a document's own."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    return texts.mapInArrow(lambda b: _found_runs(b, least, prepare), _RUNS_DDL)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of all documents, by the crc32 of their ids, repeats a stretch of its words to its end."""
    h, n = (zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a]


def run_report(found: DataFrame) -> DataFrame:
    """Of :func:`periodic_runs`: the number of runs, the longest one, and digests of runs and text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")

    def digest(text: Column) -> Column:
        return F.sha2(text.cast("binary"), 256)

    return (found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.n")).alias("length"),
        F.col("best.p").alias("period"), F.expr("-best.n * 1000 div best.p").alias("exponent_milli"),
        digest(lines).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"), "n_words"))
