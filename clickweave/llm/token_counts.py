"""Token counts by overlap resynchronisation (operator 7).

Counts are those of the sentencepiece library on the whole text. A place between two characters
that no piece of the vocabulary has side by side is a stable boundary: whatever stands around it, no
merge can cross it, so the tokens left and right of it are those of the parts encoded alone. In a
model whose pieces begin with the space mark these are, among others, the places before spaces.

Huge texts (over ``chunk`` characters) are cut into chunks that overlap by ``overlap`` characters,
dealt out over the cluster and encoded with offsets. Neighbours are spliced at the first stable
boundary of their overlap, at which both encodings must have a token boundary; a text for which one
pair finds none is encoded again with overlaps four times as wide, and so on until the overlap is
the whole text. Other texts are split at spaces and their parts' counts looked up in a table of the
task (bounded, it is begun anew when full), the library being called for parts not seen yet.

The stable-boundary proof needs a model that keeps text as it is but for the space mark (identity
normalisation, a mark put before the text, no squeezing of spaces); with any other model texts are
given whole to the library.

Defined cases: NULL and empty texts have no bytes and no tokens; NULL ids stay; repeated rows are
rows of their own; no rows, no result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from clickweave.llm.common import bounded, text_or_empty, written

MARK = "▁"
#: Parts that a Python worker remembers, none longer than _LONG characters.
_CACHE, _LONG = 600_000, 48


class Pieces:
    """What is read from a model file: the library's processor and the stable boundaries."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = pb.ModelProto.FromString(model)
        n = spec.normalizer_spec
        self.plain = (not n.precompiled_charsmap and n.add_dummy_prefix and not n.remove_extra_whitespaces
                      and n.escape_whitespaces and not spec.trainer_spec.treat_whitespace_as_suffix)
        pieces = [p.piece for p in spec.pieces if p.type in (1, 4)]
        #: Pairs of characters that some piece has side by side; a space counts as the mark.
        self.inner = {a + b for p in pieces for a, b in zip(p, p[1:])}
        #: No piece has a mark after another character: every word that follows a space begins anew.
        self.by_space = self.plain and not any(a != MARK and b == MARK for a, b in self.inner)
        self.counts: dict[str, int] = {}

    def stable(self, left: str, right: str) -> bool:
        pair = (left + right).replace(" ", MARK)
        return self.plain and pair not in self.inner

    def first_stable(self, text: str, start: int, end: int) -> int:
        """The first p in [start, end) with a stable boundary before text[p], or -1."""
        for p in range(max(1, start), min(end, len(text))):
            if self.stable(text[p - 1], text[p]):
                return p
        return -1

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each whole text."""
        if not self.by_space:
            return [len(x) for x in self.library.encode(texts, num_threads=1)]
        out = []
        for text in texts:
            if not text:
                out.append(0)
            elif "  " in text or text[0] == " " or text[-1] == " " or MARK in text:
                out.append(len(self.library.encode(text)))  # runs of spaces have pieces of their own
            else:
                out.append(self._count_parts(text.split(" ")))
        return out

    def _count_parts(self, parts: list[str]) -> int:
        counts = self.counts
        if len(counts) > _CACHE:
            counts.clear()
        long = [p for p in parts if len(p) > _LONG]
        if long:
            parts = [p for p in parts if len(p) <= _LONG]
        new = list(set(parts).difference(counts))
        counts.update(zip(new, map(len, self.library.encode(new, num_threads=1))))
        return sum(map(counts.__getitem__, parts)) + sum(map(len, self.library.encode(long, num_threads=1)))

    def boundaries(self, text: str) -> list[int]:
        """Where the tokens of ``text`` begin, in UTF-8 bytes, and its length."""
        spans = self.library.encode(text, return_type="proto").pieces
        return [p.begin for p in spans] + [spans[-1].end if spans else 0]


_LOADED: dict[int, Pieces] = {}


def pieces_of(model: bytes) -> Pieces:
    """The model, read once per Python worker."""
    key = hash(model)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


_USUAL = "rid long, doc_id long, n_bytes long, n_tokens long, huge string"


def _usual(batches: Iterable[pa.RecordBatch], model: bytes, most: int) -> Iterator[pa.RecordBatch]:
    """Counts texts of at most ``most`` characters; the others go on as ``huge``."""
    pieces = pieces_of(model)
    for b in batches:
        texts = b.column(3).to_pylist()
        n = iter(pieces.count([t for t in texts if len(t) <= most]))
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:3], pa.array([next(n) if len(t) <= most else None for t in texts], pa.int64()),
             pa.array([t if len(t) > most else None for t in texts], pa.string())], names=["rid", "doc_id", "n_bytes", "n_tokens", "huge"])


def _chunks(batches: Iterable[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """(rid, c, of, text): chunk c holds the characters from c * chunk to the next chunk's overlap."""
    for b in batches:
        for rid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            of = 1 if overlap >= len(text) else -(-len(text) // chunk)
            for c in range(of):
                part = text if of == 1 else text[c * chunk:(c + 1) * chunk + overlap]
                yield pa.RecordBatch.from_arrays([pa.array([rid], pa.int64()), pa.array([c], pa.int32()), pa.array([of], pa.int32()),
                                                  pa.array([part], pa.large_string() if len(part) > 1 << 28 else pa.string())],
                                                 names=["rid", "c", "of", "text"])


def _spliced(batches: Iterable[pa.RecordBatch], model: bytes, chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """(rid, c, of, left, right, n): the chunk's splice points (-1: none) and its tokens between."""
    pieces = pieces_of(model)
    for b in batches:
        rows = []
        for rid, c, of, text in zip(*(b.column(i).to_pylist() for i in range(4))):
            if of == 1:
                rows.append((rid, c, of, 0, 0, len(pieces.library.encode(text))))
                continue
            at = pieces.boundaries(text)
            # the splice point of a pair lies in what both have: the first ``overlap`` characters of the right one
            left = 0 if c == 0 else pieces.first_stable(text, 1, overlap)
            right = len(text) if c == of - 1 else pieces.first_stable(text, chunk + 1, min(chunk + overlap, len(text)))
            met, tokens = False, 0
            if left >= 0 and right >= left:
                lo, hi = (len(text[:p].encode()) for p in (left, right))
                i, j = bisect.bisect_left(at, lo), bisect.bisect_left(at, hi)
                met, tokens = at[i] == lo and at[j] == hi, j - i
            rows.append((rid, c, of, c * chunk + left if met else -1, c * chunk + right if met else -1, tokens))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * 6,
                                         names=["rid", "c", "of", "left", "right", "n"])


def _huge_counts(huge: DataFrame, model: bytes, chunk: int, overlap: int) -> DataFrame:
    """(rid, n_tokens) of huge texts; n_tokens is NULL where the overlap was too narrow."""
    parts = (huge.mapInArrow(lambda b: _chunks(b, chunk, overlap), "rid long, c int, of int, text string")
             .repartition("rid", "c"))
    got = parts.mapInArrow(lambda b: _spliced(b, model, chunk, overlap), "rid long, c long, of long, left long, right long, n long")
    after = F.lead("left").over(Window.partitionBy("rid").orderBy("c"))
    met = (F.col("of") == 1) | ((F.col("left") >= 0) & ((F.col("c") == F.col("of") - 1) | (F.col("right") == after)))
    return (got.withColumn("met", F.coalesce(met, F.lit(False))).groupBy("rid")
            .agg(F.when(F.every("met"), F.sum("n")).alias("n_tokens")))


def token_counts(docs: DataFrame, model: bytes, limit: int = 4096, chunk: int = 32_768, overlap: int = 512) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), text_or_empty().alias("text"))
    table = written(rows.mapInArrow(lambda b: _usual(b, model, 2 * chunk), _USUAL), "token-usual")
    todo, done = table.where("huge is not null").select("rid", F.col("huge").alias("text")), []
    left = todo.count()
    while left:
        got = written(_huge_counts(todo, model, chunk, overlap), "token-huge")
        done.append(got.where("n_tokens is not null"))
        failed = got.where("n_tokens is null").select("rid")
        left, overlap = failed.count(), overlap * 4
        todo = todo.join(bounded(failed, left), "rid", "left_semi")
    out = table.select("rid", "doc_id", "n_bytes", "n_tokens")
    if done:
        huge = reduce(DataFrame.unionAll, done).withColumnRenamed("n_tokens", "more")
        out = out.join(bounded(huge), "rid", "left").withColumn("n_tokens", F.coalesce("n_tokens", "more"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
