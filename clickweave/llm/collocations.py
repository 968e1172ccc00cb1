"""Phrase collocations (operator 13).

Texts in lower case (A-Z) are cut into pieces at ``.,;:!?`` and line ends, and pieces into words at
blanks and tabs. Everything is counted per language. A phrase of two to four words found at least
``threshold`` times is scored by the cut that explains it best: a / (l + r) of its count and those of
the two parts, the lowest of all cuts. Phrases that stand inside a longer one nearly as frequent go.

1. First pass: Misra-Gries summaries. Each task turns some megabytes of text into hashes of all
   phrases of one to four words and their counts, which go to hash partitions (ranges of the hash).
   Per partition the counts are merged into one summary: whenever it has more entries than its
   capacity, what the first entry too many counts is taken off all of them. The capacity is ``SLACK``
   times the partition's mass over the threshold, so that what was taken off in all is under
   threshold / SLACK; every phrase that may reach the threshold survives.
2. The survivors' hashes are bits of a filter of at most 16 MB (a fixed bound; a fuller filter lets more
   phrases pass, and no frequent one is ever lost), which is sent to all tasks.
3. Second pass: what the filter lets pass is counted exactly, by its words, and added up by Spark.
4. The exact counts are joined with themselves for parts and for longer phrases. A frequent phrase's
   parts are frequent, so their counts are all there.

Counts are pre-aggregated in every task, so a pair of words that is a third of all pairs is one
entry per task. A partition holds what about 6 MB of text brings, however large the table is. Scores
are exact: products and quotients are decimals of 38 digits.

Defined cases: a NULL text is empty, a NULL language is ``und``; texts without words count nothing;
repeated rows count again; ties go by count, then by the phrase's bytes; no rows, no result; ids and
extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from clickweave.llm.common import bounded, written

LONGEST, THRESHOLD, TOP = 4, 30, 2000
#: How much wider a summary is than the guarantee asks for.
SLACK = 4
#: Bytes of text that a task counts at a time, and that bring what one hash partition holds.
CHUNK, PARTITION = 4 << 20, 6 << 20
#: Bits of the filter: enough for few survivors, and never more.
LEAST_BITS, MOST_BITS = 20, 27
_BITMAP = 1 << 15  # bits of one of Spark's bitmaps
_C = np.uint64(0x9E3779B97F4A7C15)
#: A byte that no UTF-8 text has marks the end of a piece.
_END = b"\xff"
_CUTS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", _END * 10)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Chunk:
    """The words of some texts as codes, language by language, with the ends of pieces marked."""

    def __init__(self, texts: dict[str, list[bytes]]):
        self.langs = sorted(texts)
        words: list[bytes] = []
        sizes = []
        for lang in self.langs:
            found = (b" \xff ".join(t.lower().translate(_CUTS).replace(_END, b" \xff ") for t in texts[lang]) + b" \xff").split()
            words += found
            sizes.append(len(found))
            del found
        coded = pa.array(words, pa.binary()).dictionary_encode()
        del words
        self.codes = coded.indices.to_numpy().astype(np.int64)
        self.words = coded.dictionary.to_pylist()
        self.lang = np.repeat(np.arange(len(self.langs)), sizes)
        ends = np.flatnonzero(self.codes == self.words.index(_END)) if _END in self.words else np.zeros(0, np.int64)
        place = np.arange(len(self.codes))
        #: words from a place to its piece's end
        self.left = ends[np.searchsorted(ends, place)] - place if len(ends) else place
        by_word = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        self.word_hash = by_word[self.codes]
        self.seed = np.array([xxhash.xxh3_64_intdigest(x.encode(), 1) for x in self.langs], np.uint64)[self.lang] if len(self.langs) else np.zeros(0, np.uint64)

    def phrases(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per number of words: the places where such phrases begin, and their hashes of 48 bits."""
        h = self.seed
        for n in range(1, LONGEST + 1):
            size = len(self.codes) - n + 1
            if size <= 0:
                return
            h = _mixed((h[:size] + np.uint64(n)) * _C + self.word_hash[n - 1:])
            at = np.flatnonzero(self.left[:size] >= n)
            yield n, at, h[at] >> np.uint64(16)


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[Chunk]:
    texts: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            data = text.as_buffer().to_pybytes()
            if size and size + len(data) > CHUNK:
                yield Chunk(texts)
                texts, size = {}, 0
            texts.setdefault(lang.as_py(), []).append(data)
            size += len(data) + 1
    if texts:
        yield Chunk(texts)


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted 48-bit keys and 32-bit counts as planes of bytes; the upper ones compress well."""
    planes = np.empty((10, len(keys)), np.uint8)
    planes[:6] = keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].T
    planes[6:] = counts.astype(">u4").view(np.uint8).reshape(-1, 4).T
    return planes.tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(data, np.uint8).reshape(10, -1)
    keys = np.zeros((planes.shape[1], 8), np.uint8)
    keys[:, 2:] = planes[:6].T
    counts = np.ascontiguousarray(planes[6:].T)
    return keys.view(">u8").ravel().astype(np.uint64), counts.view(">u4").ravel().astype(np.int64)


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class MisraGries:
    """At most ``capacity`` keys with counts. A key's true count is its own here (0 if it is not held)
    and at most ``error`` more; the error is at most the mass over capacity + 1."""

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray, error: int = 0) -> None:
        self.keys, self.counts = _added(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        self.error += error
        extra = len(self.keys) - self.capacity
        if extra > 0:
            off = int(np.partition(self.counts, extra - 1)[extra - 1])  # of the first entry too many
            kept = self.counts > off
            self.keys, self.counts, self.error = self.keys[kept], self.counts[kept] - off, self.error + off

    def at_least(self, threshold: int) -> np.ndarray:
        """Every key whose true count may be the threshold or more."""
        return self.keys[self.counts + self.error >= threshold]


def _partials(batches: Iterable[pa.RecordBatch], partitions: int) -> Iterator[pa.RecordBatch]:
    for chunk in _chunks(batches):
        keys = np.concatenate([h for _, _, h in chunk.phrases()] or [np.zeros(0, np.uint64)])
        keys.sort()
        del chunk
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        counts, keys = np.diff(np.concatenate([first, [len(keys)]])).astype(np.uint32), keys[first]
        del first
        # the partitions' ranges of the key's upper 32 bits
        edges = np.array([-(-(p << 32) // partitions) << 16 for p in range(partitions + 1)], np.uint64)
        cuts = np.searchsorted(keys, edges).tolist()
        parts = [p for p in range(partitions) if cuts[p] < cuts[p + 1]]
        for at in range(0, len(parts), 64):
            some = parts[at:at + 64]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(
                [_packed(keys[cuts[p]:cuts[p + 1]], counts[cuts[p]:cuts[p + 1]]) for p in some], pa.binary())], names=["part", "entries"])


def _survivors(table: pa.Table, threshold: int, slack: int) -> pa.Table:
    """The keys of a hash partition that may reach the threshold. Tasks' counts are merged a summary's
    worth at a time."""
    parts = [x.as_buffer() for x in table["entries"].combine_chunks()]
    mass = sum(int(_unpacked(x)[1].sum()) for x in parts)
    summary = MisraGries(slack * mass // threshold + 1)
    waiting, size = [], 0
    for i, part in enumerate(parts):
        waiting.append(_unpacked(part))
        size += len(waiting[-1][0])
        if size >= summary.capacity or i == len(parts) - 1:
            summary.merge(*(np.concatenate(x) for x in zip(*waiting)))
            waiting, size = [], 0
    if summary.error >= threshold:
        raise AssertionError("a summary lost more than its capacity allows")
    return pa.table({"key": pa.array(summary.at_least(threshold).astype(np.int64), pa.int64())})


def _exact(batches: Iterable[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts, by words, of the phrases that the filter lets pass; and of all words, without a phrase."""
    mask = np.uint64(len(bits) * 8 - 1)
    for chunk in _chunks(batches):
        d = len(chunk.words)
        langs, phrases, sizes, counts = [], [], [], []
        for n, at, key in chunk.phrases():
            if n == 1:
                per_lang = np.bincount(chunk.lang[at], minlength=len(chunk.langs))
                langs += chunk.langs
                phrases += [None] * len(chunk.langs)
                sizes += [0] * len(chunk.langs)
                counts += per_lang.tolist()
            key &= mask
            at = at[(bits[key >> np.uint64(3)] >> (key & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            if not len(at):
                continue
            group = chunk.lang[at]
            for i in range(n):
                _, group = np.unique(group * d + chunk.codes[at + i], return_inverse=True)
            _, first, found = np.unique(group, return_index=True, return_counts=True)
            start = at[first]
            spelled = [[chunk.words[c] for c in chunk.codes[start + i].tolist()] for i in range(n)]
            phrases += [b" ".join(p) for p in zip(*spelled)]
            langs += [chunk.langs[x] for x in chunk.lang[start].tolist()]
            sizes += [n] * len(start)
            counts += found.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int32()),
                                          pa.array(counts, pa.int64())], names=["lang", "phrase", "words", "f"])


def _filter_bits(keys: DataFrame) -> np.ndarray:
    """The survivors' filter, at most 16 MB however many they are; it is put together by Spark and only
    its bits reach the driver."""
    n = keys.count()
    size = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))
    place = F.col("key").bitwiseAND(F.lit((1 << size) - 1)) + 1  # Spark's bitmaps number bits from 1
    maps = keys.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bits = np.zeros((1 << size) // 8, np.uint8)
    for bucket, found in maps.collect():
        at = (bucket - 1) * (_BITMAP // 8)
        bits[at:at + _BITMAP // 8] = np.frombuffer(bytes(found), np.uint8)
    return bits


def frequent_phrases(docs: DataFrame, threshold: int = THRESHOLD, slack: int = SLACK) -> DataFrame:
    """lang, phrase, words, f: the exact counts of all phrases of one to four words that occur
    ``threshold`` times or more, and a row per language without a phrase that counts all its words."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(8, -(-size // PARTITION))
    summaries = (texts.mapInArrow(lambda b: _partials(b, partitions), "part long, entries binary")
                 .groupBy("part").applyInArrow(lambda t: _survivors(t, threshold, slack), "key long"))
    bits = _filter_bits(written(summaries, "phrase-survivors"))
    counted = (texts.mapInArrow(lambda b: _exact(b, bits), "lang string, phrase string, words int, f long")
               .groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")))
    return written(counted.where((F.col("words") == 0) | (F.col("f") >= threshold)), "phrase-counts")


def _exact_product(a: Column, b: int) -> Column:
    return a.cast("decimal(20,0)") * F.lit(b).cast("decimal(10,0)")


def collocations(docs: DataFrame, threshold: int = THRESHOLD, top: int = TOP, cover: int = 80, slack: int = SLACK) -> DataFrame:
    """Per language its ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    counts = frequent_phrases(docs, threshold, slack)
    known = counts.where("words > 0")
    candidates = known.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    # what stands inside a longer phrase nearly as frequent
    sizes = F.sequence(F.lit(2), F.col("words") - 1)
    inner = candidates.where("words > 2").select("lang", "a", "words", "w", F.explode(sizes).alias("k"))
    inner = (inner.select("lang", "a", "w", "k", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("k") + 1)).alias("at"))
             .select("lang", F.array_join(F.slice("w", F.col("at"), F.col("k")), " ").alias("phrase"), "a"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    covered = F.col("most").isNotNull() & (_exact_product(F.col("most"), 100) >= _exact_product(F.col("a"), cover))
    left = candidates.join(longer, ["lang", "phrase"], "left").where(~covered).drop("most")

    parts = known.select("lang", F.col("phrase").alias("part"), "f")
    cuts = (left.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
            .withColumns({"first": F.array_join(F.slice("w", F.lit(1), F.col("k")), " "),
                          "rest": F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ")}))
    cuts = (cuts.join(bounded(parts).withColumnsRenamed({"part": "first", "f": "l"}), ["lang", "first"])
            .join(bounded(parts).withColumnsRenamed({"part": "rest", "f": "r"}), ["lang", "rest"]))
    # a double would round: the numerator may pass 64 bits
    score = F.expr("cast(a as decimal(28,0)) * cast(2000000 as decimal(10,0)) div (cast(l as decimal(38,0)) + cast(r as decimal(38,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    per_lang = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(bounded(per_lang), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
        F.col("cut.score").cast("long").alias("score"))
