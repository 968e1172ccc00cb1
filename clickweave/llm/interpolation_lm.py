"""Language-model scoring by deleted interpolation (operator 8).

A token's probability mixes three estimates, its maximum-likelihood share after the word before it,
its share of all tokens, and an even share of the vocabulary, with weights that depend on how often
the context word was seen (buckets by powers of two). A tenth of the training texts is deleted from
the counts while the weights are learned on it by expectation-maximisation; the final counts use
all training texts.

Counts at scale. Texts are taken in chunks of ``chunk_rows`` rows of a scan task (the deleted texts
in chunks of their own). A chunk asks for the corpus counts of its distinct words and word pairs:
sorted 64-bit hashes with the chunk's own training counts, cut by hash range and dealt by range.
Per range the requests of all chunks are added up, which is the whole corpus's count of every word
and pair, and each chunk gets its totals back in the order in which it asked, so no hash travels
twice. Then chunk texts and answers meet once, by chunk. A frequent word or pair is one entry per
chunk; ranges are even, as hashes are. Nothing is pruned or sampled: every pair's count is exact (up
to 64-bit hash collisions), added up and kept in 64 bits. Scans of the same table must deal it alike, as Spark's file scans do.

Learning reads a table of event counts: deleted tokens by context bucket and by the half octaves of
the two estimates, at most 24 x 130 x 130 rows, on the driver.

Defined cases: NULL and empty texts are one end token; NULL ids are not held out and are learned
from; repeated rows count as often as they stand; without training texts every token has an even
share; no rows, no result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from clickweave.llm.common import fold, text_or_empty, written

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))
#: The tokens that no word can be: words have no white space.
END, START = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" end", b" start"))
TOP_BUCKET, OCTAVE = 22, 2
WORDS, PAIRS = 0, 1


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, one after the other, and where each text begins."""
    parts, starts, n = [], [], 0
    for text in texts:
        words = text.lower().split()
        h = np.empty(len(words) + 1, np.uint64)
        h[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        h[-1] = END
        parts.append(h)
        starts.append(n)
        n += len(h)
    return np.concatenate(parts), np.array(starts)


def _pairs(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it."""
    before = np.concatenate([[START], tokens[:-1]]).astype(np.uint64)
    before[starts] = START
    x = (before * _MIX[0]) ^ (tokens >> np.uint64(17)) ^ (tokens << np.uint64(47))
    x = (x ^ (x >> np.uint64(31))) * _MIX[1]
    return x ^ (x >> np.uint64(29))


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers as byte planes, so that the shuffle's compression finds the empty ones."""
    width = values.dtype.itemsize
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes()


def _unpacked(blob: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


_ASK = pa.schema([("kind", pa.int32()), ("range", pa.int32()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
_ASK_DDL = "kind int, range int, chunk long, hashes binary, counts binary"


def _asked(chunk: int, texts: list[bytes], learn: list[bool], bits: int) -> Iterator[pa.RecordBatch]:
    """The request rows of one chunk."""
    tokens, starts = _tokens(texts)
    weights = np.repeat(np.array(learn, np.float64), np.diff(np.append(starts, len(tokens))))
    for kind, keys in ((WORDS, tokens), (PAIRS, _pairs(tokens, starts))):
        distinct, place = np.unique(keys, return_inverse=True)
        counts = np.bincount(place, weights, len(distinct)).astype(np.uint64)
        edges = np.searchsorted(distinct, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        edges = np.append(edges, len(distinct))
        rows = [(kind, r, chunk, _packed(np.diff(distinct[a:b], prepend=np.uint64(0))), _packed(counts[a:b]))
                for r, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ASK)], schema=_ASK)


def _requests(batches: Iterable[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, learn, text) in scan order; deleted texts, and texts of each size, have chunk ids of
    their own."""
    open_: dict[tuple[int, int], tuple[int, list[bytes], list[bool]]] = {}
    for b in batches:
        for chunk, learn, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            kind = (chunk & 1, chunk >> _SIZE_BIT)
            if kind in open_ and open_[kind][0] != chunk:
                yield from _asked(*open_.pop(kind), bits)
            _, texts, learns = open_.setdefault(kind, (chunk, [], []))
            texts.append(text.as_buffer().to_pybytes())
            learns.append(learn)
    for left in open_.values():
        yield from _asked(*left, bits)


_TOLD = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("range", pa.int32()), ("all", pa.binary()), ("kept", pa.binary()),
                   ("types", pa.int64()), ("tokens", pa.int64()), ("deleted", pa.int64()), ("ends", pa.int64())])
_TOLD_DDL = "chunk long, kind int, range int, all binary, kept binary, types long, tokens long, deleted long, ends long"


def _answers(table: pa.Table) -> pa.Table:
    """All requests of one range: corpus totals for each, and totals without the deleted texts for
    the chunks of those. The first row carries the range's vocabulary figures."""
    kind, span = table["kind"][0].as_py(), table["range"][0].as_py()
    chunks = table["chunk"].to_pylist()
    hashes = [np.cumsum(_unpacked(h.as_buffer(), np.uint64), dtype=np.uint64) for h in table["hashes"]]
    counts = [_unpacked(c.as_buffer(), np.uint64) for c in table["counts"]]
    deleted = [np.full(len(h), c & 1, bool) for h, c in zip(hashes, chunks)]
    distinct, place = np.unique(np.concatenate(hashes), return_inverse=True)
    n, gone = np.concatenate(counts), np.concatenate(deleted)
    total, kept = np.zeros(len(distinct), np.uint64), np.zeros(len(distinct), np.uint64)
    np.add.at(total, place, n)  # whole numbers: a corpus may hold a word more than 2^32 times
    np.add.at(kept, place[~gone], n[~gone])
    rows, at = [], 0
    for i, (chunk, h) in enumerate(zip(chunks, hashes)):
        p = place[at:at + len(h)]
        at += len(h)
        facts = (int((total > 0).sum()), int(total.sum()), int((total - kept).sum()),
                 int(total[distinct == END].sum())) if kind == WORDS and i == 0 else (0, 0, 0, 0)
        rows.append((chunk, kind, span, _packed(total[p]), _packed(kept[p]) if chunk & 1 else b"", *facts))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _TOLD)], schema=_TOLD)


@dataclass(frozen=True)
class Model:
    tokens: int
    types: int
    ends: int
    weights: tuple[tuple[float, float, float], ...] = ()


def _chunk_counts(texts: list[bytes], told: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per token of a chunk: its count, its count after the token before it, whether a text begins
    here; and where the texts begin."""
    tokens, starts = _tokens(texts)
    found = []
    for kind, keys in ((WORDS, tokens), (PAIRS, _pairs(tokens, starts))):
        rows = sorted((r, i) for i, (k, r) in enumerate(zip(told["kind"].to_pylist(), told["range"].to_pylist())) if k == kind)
        counts = np.concatenate([_unpacked(told[column][i].as_buffer(), np.uint64) for _, i in rows])
        found.append(counts[np.unique(keys, return_inverse=True)[1]].astype(np.float64))
    begins = np.zeros(len(tokens), bool)
    begins[starts] = True
    return found[0], found[1], begins, starts


def _estimates(own: np.ndarray, pair: np.ndarray, begins: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context bucket, share after the context, share of all tokens); a text begins after START,
    which stands as often as END."""
    context = np.concatenate([[0.0], own[:-1]])
    context[begins] = model.ends
    bucket = np.where(context > 0, 1 + np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64), TOP_BUCKET - 1), 0)
    return bucket, np.where(context > 0, pair / np.maximum(context, 1), 0.0), own / max(model.tokens, 1)


def _event_bins(share: np.ndarray) -> np.ndarray:
    """Half octaves below 1; -1 for a share of 0."""
    with np.errstate(divide="ignore"):
        return np.where(share > 0, np.minimum(np.rint(-np.log2(np.where(share > 0, share, 1)) * OCTAVE), 127), -1).astype(np.int64)


def _events(texts: pa.Table, told: pa.Table, model: Model) -> pa.Table:
    """Deleted tokens counted by (bucket, bin of the pair's share, bin of the word's share)."""
    if not texts.num_rows:
        keys, n = np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
    else:
        own, pair, begins, _ = _chunk_counts([t.as_buffer().to_pybytes() for t in texts["text"]], told, "kept")
        bucket, after, alone = _estimates(own, pair, begins, model)
        keys, n = np.unique(np.stack([bucket, _event_bins(after), _event_bins(alone)], axis=1), axis=0, return_counts=True)
    return pa.table({"bucket": pa.array(keys[:, 0], pa.int64()), "after": pa.array(keys[:, 1], pa.int64()),
                     "alone": pa.array(keys[:, 2], pa.int64()), "n": pa.array(n, pa.int64())})


def learned_weights(events: list[tuple[int, int, int, int]], types: int, rounds: int = 100) -> tuple[tuple[float, float, float], ...]:
    """Expectation-maximisation per context bucket on (bucket, bin, bin, count). A bucket's start,
    and its weights if it has no events, are those of the bucket below; every estimate keeps a
    ten-thousandth."""
    even, out, before = 1.0 / (types + 1), [], np.array([0.2, 0.7, 0.1])
    table = np.array(events, np.float64).reshape(-1, 4)
    for bucket in range(TOP_BUCKET + 1):
        rows = table[table[:, 0] == bucket]
        w = before
        if len(rows):
            shares = [np.where(rows[:, i] >= 0, 2.0 ** (-rows[:, i] / OCTAVE), 0.0) for i in (1, 2)]
            p = np.stack([*shares, np.full(len(rows), even)], axis=1)
            for _ in range(rounds):
                parts = p * w
                w = (parts / parts.sum(axis=1, keepdims=True) * rows[:, 3:]).sum(axis=0) / rows[:, 3].sum()
                w = np.maximum(w, 1e-4) / np.maximum(w, 1e-4).sum()
            before = w
        if bucket == 0:  # an unseen context has no estimate of its own
            w = np.array([0.0, w[1] + w[0] * w[1] / (w[1] + w[2]), w[2] + w[0] * w[2] / (w[1] + w[2])])
        out.append(tuple(map(float, w)))
    return tuple(out)


_SCORED = "doc_id long, learn boolean, n_tokens long, n_known long, base_score double, score double"


def _scored(texts: pa.Table, told: pa.Table, model: Model) -> pa.Table:
    if not texts.num_rows:
        return pa.table({"doc_id": pa.array([], pa.int64()), "learn": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()),
                         "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
    own, pair, begins, starts = _chunk_counts([t.as_buffer().to_pybytes() for t in texts["text"]], told, "all")
    bucket, after, alone = _estimates(own, pair, begins, model)
    base = np.log10((own + 0.1) / (model.tokens + 0.1 * (model.types + 1)))
    w = np.array(model.weights)[bucket]
    p = w[:, 0] * after + w[:, 1] * alone + w[:, 2] / (model.types + 1)
    return pa.table({
        "doc_id": texts["doc_id"], "learn": texts["learn"],
        "n_tokens": pa.array(np.diff(np.append(starts, len(own))), pa.int64()),
        "n_known": pa.array(np.add.reduceat((own > 0).astype(np.int64), starts), pa.int64()),
        "base_score": pa.array(np.add.reduceat(base, starts)), "score": pa.array(np.add.reduceat(np.log10(p), starts))})


#: The bit of a chunk id above which its texts' size stands; texts up to so many bytes are of size 0.
_SIZE_BIT, _SMALL = 55, 4096


def chunk_ids(size: Column, deleted: Column, chunk_rows: int) -> Column:
    """Chunks of neighbouring rows: ``chunk_rows`` of texts up to 4 KB, half as many of texts up to twice as
    long, and so on, so that no chunk has over 2 * chunk_rows * 4 KB (a longer text is a chunk alone)."""
    kind = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(size, F.lit(1)) / _SMALL))).cast("int")
    rows = F.greatest(F.lit(1).cast("long"), F.floor(chunk_rows / F.pow(F.lit(2.0), kind)))
    return kind.cast("long") * (1 << _SIZE_BIT) + F.floor(F.monotonically_increasing_id() / rows) * 2 + deleted.cast("long")


def lm_scores(docs: DataFrame, folds: int = 10, chunk_rows: int = 4096, delete: int = 10) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    Rows whose crc32(doc_id as text) modulo ``folds`` is 0 are held out; one of ``delete`` others is
    deleted while the weights are learned."""
    spark = docs.sparkSession
    held_out = F.coalesce(fold(F.col("doc_id"), folds) == 0, F.lit(False))
    deleted = ~held_out & (F.pmod(F.xxhash64(F.lit("deleted"), "doc_id"), F.lit(delete)) == 0)
    chunk = chunk_ids(F.octet_length(text_or_empty()), deleted, chunk_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~held_out).alias("learn"), chunk.cast("long").alias("chunk"),
                       text_or_empty().cast("binary").alias("text"))
    bits = max(8, math.ceil(math.log2(int(spark.conf.get("spark.sql.shuffle.partitions")))) + 1)
    asked = rows.select("chunk", "learn", "text").mapInArrow(lambda b: _requests(b, bits), _ASK_DDL)
    told = written(asked.groupBy("kind", "range").applyInArrow(_answers, _TOLD_DDL), "lm-counts")
    facts = told.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("types", "tokens", "deleted", "ends")]).first()
    answers = told.select("chunk", "kind", "range", "all", "kept")

    # the weights: counts without the deleted texts. START stands about as often among the kept texts as END
    less = Model(facts["tokens"] - facts["deleted"], facts["types"], round(facts["ends"] * (1 - 1 / delete)))
    events = (rows.where("chunk % 2 = 1").select("chunk", "text").groupBy("chunk")
              .cogroup(answers.where("chunk % 2 = 1").groupBy("chunk"))
              .applyInArrow(lambda a, b: _events(a, b, less), "bucket long, after long, alone long, n long")
              .groupBy("bucket", "after", "alone").agg(F.sum("n").alias("n")).collect())
    model = Model(facts["tokens"], facts["types"], facts["ends"],
                  learned_weights(sorted(tuple(e) for e in events), facts["types"]))
    scored = (rows.groupBy("chunk").cogroup(answers.groupBy("chunk"))
              .applyInArrow(lambda a, b: _scored(a, b, model), _SCORED))
    return scored.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known",
                         F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
