"""Quality classifier by compression (operator 3).

Two zstandard dictionaries are built, one from good and one from bad labelled text. A text is cut
into blocks of ``block`` bytes, each compressed with either dictionary (blocks, as in a long text the
text itself would soon be the better dictionary); the normalised difference of the two total sizes,
(bad - good) / bytes of text (short texts being drawn to the mean), says which it is closer to. Endless repetition compresses with either
to nothing, so its difference is near 0, less than that of good text. A logistic curve fitted to labelled texts
that the dictionaries have not seen makes it a score from 0 to 1.

Learning. Labelled rows whose crc32(doc_id as text) modulo ``folds`` is ``held_out`` are never used.
Of the others, four of five (by a hash of the id) feed the dictionaries and one of five the
calibration. The dictionaries are trained on a bounded sample: per class the ``sample`` distinct
blocks of whole texts with the smallest hashes (the documented bound: 2 x 1,500 blocks of 2 KB; about
twice as many reach the driver, chosen by a hash bound that follows from their number). Calibration
counts all of its rows in bins of the difference, a table of at most 2 x 2,001 counts. Labels, language, source and ids enter no score.

Defined cases: NULL and empty texts get the score of the mean difference; NULL ids are not
held out and never learned from; repeated rows are rows of their own (a repeated label row counts
again in calibration); blocks under 64 bytes feed a dictionary only where its class has no others;
without labels of both classes, or where the texts of a class that feed its dictionary are all empty,
every score is 0.5; no rows, no result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from clickweave.llm.common import bounded, fold, text_or_empty, written

BLOCK, SAMPLE, DICTIONARY, LEVEL = 2048, 1500, 64 << 10, 3
_BINS = 1000
#: Bytes of usual text that every text is taken to hold besides its own.
_SHORT = 32


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    usual: float = 0.0
    block: int = BLOCK


def _compressors(good: bytes, bad: bytes) -> list[zstandard.ZstdCompressor]:
    made = []
    for d in (good, bad):
        dictionary = zstandard.ZstdCompressionDict(d)
        dictionary.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(dict_data=dictionary, level=LEVEL, write_content_size=False, write_dict_id=False))
    return made


def saved(text: bytes, compressors: list[zstandard.ZstdCompressor], block: int) -> int:
    """Bytes that the good dictionary saves against the bad one, over the blocks of the whole text."""
    good, bad = compressors
    parts = (text[at:at + block] for at in range(0, len(text), block))
    return sum(len(bad.compress(p)) - len(good.compress(p)) for p in parts)


def _saved(batches: Iterable[pa.RecordBatch], good: bytes, bad: bytes, block: int) -> Iterator[pa.RecordBatch]:
    """The first column, and of the last one, the text, ``saved`` and its bytes."""
    compressors = _compressors(good, bad)
    for b in batches:
        texts = [t.as_buffer().to_pybytes() for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([saved(t, compressors, block) for t in texts], pa.int64()),
                                          pa.array([len(t) for t in texts], pa.int64())], names=[b.schema.names[0], "saved", "bytes"])


def _difference(usual: float) -> Column:
    """Normalised difference; short texts, which say little, are drawn to the usual one."""
    return (F.col("saved") + usual * _SHORT) / (F.col("bytes") + _SHORT)


def _blocks(batches: Iterable[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """(quality, block) of whole texts."""
    for b in batches:
        for quality, text in zip(b.column(0).to_pylist(), b.column(1)):
            text = text.as_buffer().to_pybytes()
            parts = [text[i:i + block] for i in range(0, len(text), block)]
            yield pa.RecordBatch.from_arrays([pa.array([quality] * len(parts), pa.int32()), pa.array(parts, pa.binary())], names=["quality", "block"])


def _fitted(counts: list[tuple[int, int, int]]) -> tuple[float, float]:
    """Slope and offset of the logistic curve by Newton's method on (bin, label, count), with a
    slight pull of the slope to 0 that keeps it finite for classes without overlap."""
    a, b = 0.0, 0.0
    for _ in range(100):
        ga = gb = haa = hab = hbb = 0.0
        for bin_, y, n in counts:
            x = bin_ / _BINS
            p = 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, a * x + b))))
            ga, gb = ga + n * (y - p) * x, gb + n * (y - p)
            w = n * p * (1 - p)
            haa, hab, hbb = haa + w * x * x, hab + w * x, hbb + w
        ga, haa, hbb = ga - 1e-4 * a, haa + 1e-4, hbb + 1e-9
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 50.0 / max(abs(da), abs(db), 1e-12))
        a, b = a + step * da, b + step * db
        if max(abs(da), abs(db)) < 1e-9:
            break
    return a, b


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, block: int = BLOCK, sample: int = SAMPLE) -> Model | None:
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("l_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(fold(F.col("l_id"), folds) != held_out)
    texts = docs.select(F.col("doc_id").cast("long").alias("l_id"), text_or_empty().cast("binary").alias("text"))
    part = F.pmod(F.xxhash64(F.lit("part"), "l_id"), F.lit(5))
    rows = texts.join(bounded(known, limit=2_000_000), "l_id").withColumn("part", part)
    blocks = rows.where("part < 4").select("quality", "text").mapInArrow(lambda b: _blocks(b, block), "quality int, block binary")
    # distinct blocks by hash: first how many, then those whose hash is low enough for twice the sample
    blocks = blocks.withColumn("key", F.xxhash64("block"))
    # blocks under 64 bytes say too little, unless a class has no others
    blocks = blocks.withColumn("long", F.length("block") >= 64)
    sizes = {(r[0], r[1]): r[2] for r in blocks.groupBy("quality", "long").agg(F.approx_count_distinct("key")).collect()}
    low = F.lit(False)
    for (q, long), n in sizes.items():
        if not long and (q, True) in sizes:
            continue
        low = low | ((F.col("quality") == q) & (F.col("long") == long) & (F.col("key") <= F.lit(-2**63 + (2**64 - 1) * min(2 * sample, max(n, 1)) // max(n, 1))))
    found = blocks.where(low).groupBy("quality", "key").agg(F.min("block").alias("block")).collect()
    samples = {q: [bytes(r.block) for r in sorted((r for r in found if r.quality == q), key=lambda r: r.key)[:sample]] for q in (0, 1)}
    if not all(samples.values()):
        return None
    good, bad = (_dictionary(samples[q]) for q in (1, 0))
    seen = written(rows.where("part = 4").select("quality", "text")
                   .mapInArrow(lambda b: _saved(b, good, bad, block), "quality int, saved long, bytes long"), "zstd-calibration")
    usual = seen.agg(F.sum("saved") / F.greatest(F.sum("bytes"), F.lit(1))).first()[0] or 0.0
    counts = seen.groupBy(F.round(_difference(usual) * _BINS).cast("int").alias("bin"), "quality").count().orderBy("bin", "quality").collect()
    slope, offset = _fitted([tuple(r) for r in counts]) if len({r[1] for r in counts}) == 2 else (50.0, 0.0)
    return Model(good, bad, slope, offset, usual, block)


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or where there is too little text to train one, the text itself."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, model: Model | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, difference."""
    model = model or train(docs, labels, folds, held_out) or Model(b"", b"", 0.0, 0.0)
    good, bad, block = model.good, model.bad, model.block
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    scored = (rows.mapInArrow(lambda b: _saved(b, good, bad, block), "doc_id long, saved long, bytes long")
              .withColumn("difference", _difference(model.usual)))
    z = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.col("difference") * model.slope + model.offset))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"),
                         score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "difference")
