"""Near-duplicates by HyperMinHash (operator 5).

A document's set holds the 64-bit hashes of its distinct ``words``-word shingles (texts with fewer
words: the whole sequence). Each hash falls into a bucket by its first bits; of the smallest rest in
each bucket 16 bits stay, the count of leading zeros (six bits) and the ten mantissa bits after the
first one. 128 buckets serve the bands and 512 the estimate. Equal sets are one node from here on.

Bands of four registers are the candidate search, an empty register borrowing from a filled one
that its bucket ranks first: two sets of similarity 0.8 or more share one of 32 bands with a
probability over 1 - 1e-7. In every band bucket all members are first compared with its leader, the
smallest id; groups of near copies mostly fall together here, by one pair a member. Members of a
bucket that are still in different components are then compared by their registers in blocks of
1,000 against 1,000, each pair in its first common band only. Members are blocked by component, and
blocks that hold nothing but one component don't meet. No pair leaves a task: the members with an
estimate near the threshold come again with their full sets, are confirmed there, and only a link that
joins two components leaves, at most one a member. (Pairs with a set of over 16,384 shingles do leave, and
are joined with their sets, so that a task's memory is bounded.) So the exact way is taken for whatever
the leaders have not joined, with no cap, and no task holds more than two blocks of a bucket.

The estimate is the share of equal registers, corrected for registers equal by accident. Pairs go if
it is more than six standard errors under the threshold (of a sample without replacement, one
shingle a bucket). The others are confirmed on the full sets.

Defined cases: NULL, empty and blank texts have empty sets and no links; a NULL id is linked with
nothing; rows that share an id go each by its own set, and sets whose smallest id is the same are
one node; no rows, no result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from clickweave.llm.common import bounded, text_or_empty, without_rows, written
from clickweave.llm.components import connected_components

BAND_BITS, ESTIMATE_BITS, MANTISSA = 7, 9, 10
BUCKETS, BAND = 1 << BAND_BITS, 4
EMPTY = 0xFFFF
#: Members of a bucket that a task compares with as many others.
BLOCK = 1000
#: Shingles that a set may have to be confirmed in such a task.
SET_ROWS = 1 << 14
#: Ids that may be broadcast as one column (16 MB).
ID_ROWS = 2_000_000
_C = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C[1]
    x = (x ^ (x >> np.uint64(27))) * _C[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text in lower case; bytes.lower() and
    bytes.split() touch A-Z and ASCII white space alone."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    k = min(words, len(h))
    mixed = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        mixed = _mixed(mixed * _C[0] + h[i:len(h) - k + 1 + i])
    return np.unique(mixed)


def registers(hashes: np.ndarray, bits: int) -> np.ndarray:
    """2 ** bits registers (EMPTY where a bucket has no hash) of a sorted set."""
    out = np.full(1 << bits, EMPTY, np.uint16)
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    rest = hashes[first] << np.uint64(bits)
    # leading zeros by the float exponent of the upper 53 bits, exact for these whole numbers
    high = rest >> np.uint64(11)
    zeros = np.where(high > 0, 53 - np.frexp(high.astype(np.float64))[1], 53).astype(np.uint64)
    mantissa = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out[bucket[first]] = ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
    return out


def _ranks() -> np.ndarray:
    """Which filled bucket an empty one would rather borrow from: a fixed random order per bucket."""
    return _mixed(np.arange(1, BUCKETS * BUCKETS + 1, dtype=np.uint64) * _C[0]).reshape(BUCKETS, BUCKETS)


_RANKS = _ranks()


def densified(regs: np.ndarray) -> np.ndarray:
    """Registers whose empty buckets hold what a random filled one has, so that bands of small sets,
    too, agree as often as four independent minima would."""
    filled = np.flatnonzero(regs != EMPTY)
    if len(filled) in (0, BUCKETS):
        return regs
    empty = np.flatnonzero(regs == EMPTY)
    out = regs.copy()
    out[empty] = regs[filled[_RANKS[np.ix_(empty, filled)].argmin(axis=1)]]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key per band of a set that is not empty, the band's number included."""
    bands = densified(regs).reshape(-1, BAND)
    key = np.arange(1, len(bands) + 1, dtype=np.uint64)
    for i in range(BAND):
        key = _mixed(key * _C[0] + bands[:, i].astype(np.uint64))
    return key


_SKETCH = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("regs", pa.binary()),
                     ("bands", pa.list_(pa.int64()))])
_SKETCH_DDL = "rid long, doc_id long, n long, digest binary, regs binary, bands array<long>"


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _sketches(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            n, digests, regs, bands = [], [], [], []
            for text in part.column(2):
                s = shingle_set(text.as_buffer().to_pybytes(), words)
                n.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                regs.append(registers(s, ESTIMATE_BITS).tobytes() if len(s) else b"")
                bands.append(band_keys(registers(s, BAND_BITS)) if len(s) else np.zeros(0, np.uint64))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()),
                                              pa.array(regs, pa.binary()), _lists(bands)], schema=_SKETCH)


def _sets(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            found = [shingle_set(t.as_buffer().to_pybytes(), words) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(found)], names=["id", "s"])


def may_be_near(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of the register arrays a and b, of sets of na and nb shingles, sizes and registers
    don't rule out. Two different minima agree in their leading zeros a third of the time and then
    in the mantissa once in 2 ** MANTISSA."""
    t, accident = percent / 100, 2.0 ** -MANTISSA / 3
    same = ((a == b) & (a != EMPTY)).sum(axis=1)
    filled = np.maximum(((a != EMPTY) | (b != EMPTY)).sum(axis=1), 1)
    estimate = (same / filled - accident) / (1 - accident)
    union = (na + nb) / (1 + t)  # at the threshold
    left_out = np.clip(1 - filled / np.maximum(union, 1), 0.02, 1.0)
    error = 6 * np.sqrt(t * (1 - t) * left_out / filled) + 2 / filled
    return (estimate >= t - error) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))


def _register_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in column), np.uint16).reshape(len(column), -1)


def _near_pairs(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            near = may_be_near(_register_rows(b["ra"]), _register_rows(b["rb"]), b["na"].to_numpy(), b["nb"].to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([b["a"], b["b"]], names=["a", "b"]).filter(pa.array(near))


def _apart(table: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Two blocks (i, j) of a band's members, or one block with itself: a row and the rows of other
    components that may be near it, in the first band that they share."""
    at, band = table["block"].to_numpy(), table["band"][0].as_py()
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    ids, c, n = (table[x].to_numpy() for x in ("id", "c", "n"))
    regs = _register_rows(table["regs"].combine_chunks())
    bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    place = int(np.argwhere(bands == band)[0, 1])  # a row may be of another set of the same id
    left, right = np.flatnonzero(at == i), np.flatnonzero(at == j)
    for m in left.tolist():
        x = right[(c[right] != c[m]) & ((ids[right] > ids[m]) if i == j else True)]
        x = x[(bands[x, :place] != bands[m, :place]).all(axis=1)]
        if len(x):
            x = x[may_be_near(regs[x], regs[m][None, :], n[x], n[m], percent)]
        if len(x):
            yield m, x


_QUESTION = "band long, i int, j int, block int, id long, c long, other long"


def _in_question(table: pa.Table, percent: int, set_rows: int) -> pa.Table:
    """The members that have someone to be compared with on full sets; pairs with a large set as pairs."""
    n, ids = table["n"].to_numpy(), table["id"].to_numpy()
    flagged, pairs = np.zeros(len(ids), bool), []
    for m, x in _apart(table, percent):
        small = (n[x] <= set_rows) & (n[m] <= set_rows)
        flagged[x[small]] = True
        flagged[m] |= bool(small.any())
        pairs += [(m, y) for y in x[~small].tolist()]
    rows = np.concatenate([np.flatnonzero(flagged), np.array([m for m, _ in pairs], np.int64)])
    others = pa.array([None] * int(flagged.sum()) + [int(ids[y]) for _, y in pairs], pa.int64())
    return table.select(["band", "i", "j", "block", "id", "c"]).take(pa.array(rows)).append_column("other", others)


def _joining_links(table: pa.Table, percent: int) -> pa.Table:
    """Links between components, confirmed on the full sets; none between what a link has joined already."""
    ids, c = table["id"].to_pylist(), table["c"].to_pylist()
    flat = table["s"].combine_chunks()
    ends, values = flat.offsets.to_numpy(), flat.values.to_numpy()
    sets = [values[ends[k]:ends[k + 1]] for k in range(len(ids))]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    out: list[tuple[int, int]] = []
    for m, found in _apart(table, percent):
        for x in found.tolist():
            a, b = find(c[m]), find(c[x])
            if a != b:
                common = len(np.intersect1d(sets[m], sets[x], assume_unique=True))
                if 100 * common >= percent * (len(sets[m]) + len(sets[x]) - common):
                    root[a] = b
                    out.append((min(ids[m], ids[x]), max(ids[m], ids[x])))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _near(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and registers don't rule out."""
    one = nodes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    two = nodes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    return pairs.join(two, "b").join(one, "a").mapInArrow(lambda x: _near_pairs(x, percent), "a long, b long").distinct()


def _full_sets(ids: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The full sets (id, s) of the documents in ``ids`` (doc_id), sorted; as many rows per id as it has rows."""
    return written(texts.join(bounded(ids, limit=ID_ROWS), "doc_id", "left_semi")
                   .mapInArrow(lambda b: _sets(b, words), "id long, s array<long>"), "near-sets")


def _linked(near: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs that are links, confirmed on the full sets of the documents that are in question."""
    near = written(near, "near-pairs")
    sets = _full_sets(near.select(F.col("a").alias("doc_id")).unionByName(near.select(F.col("b").alias("doc_id"))).distinct(), texts, words)
    full = (near.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
            .join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a"))
    common = F.size(F.array_intersect("sa", "sb"))
    return written(full.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b").distinct(), "near-links")


def _block_pairs(ordered: DataFrame) -> DataFrame:
    """band, block, i, j: which pairs of blocks of a band to compare, for both of their blocks. Blocks follow
    the components, so those that hold one component alone are neighbours; they don't meet."""
    band, alone = Window.partitionBy("band"), Window.partitionBy("band", "lo", "pure")
    blocks = (ordered.groupBy("band", "block").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
              .withColumn("pure", F.col("lo") == F.col("hi")))
    blocks = blocks.select("band", "block", "pure", F.max("block").over(band).alias("last"),
                           F.min("block").over(alone).alias("from"), F.max("block").over(alone).alias("to"))
    pairs = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last")))).where("not (pure and other between from and to)")
    return pairs.select("band", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: rid (the scan's row number), doc_id, n_shingles, component_id, kept."""
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
                           text_or_empty().cast("binary").alias("text"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    sketches = written(numbered.mapInArrow(lambda b: _sketches(b, words), _SKETCH_DDL), "near-sketches")
    owners = written(sketches.where("doc_id is not null and n > 0").groupBy("digest").agg(F.min("doc_id").alias("id")), "near-owners")
    nodes = written(sketches.join(owners.select(F.col("digest").alias("d_"), "id"), (F.col("digest") == F.col("d_")) & (F.col("doc_id") == F.col("id")))
                    .dropDuplicates(["digest"]).select("id", "n", "regs", "bands"), "near-nodes")

    banded = nodes.select("id", F.explode("bands").alias("band"))
    # written before it is joined: Spark splits a skewed key only between sides that come from a shuffle
    shared = written(banded.groupBy("band").agg(F.min("id").alias("least"), F.max("id").alias("most"))
                     .where("least < most").select("band", "least"), "near-bands")
    members = written(banded.join(shared, "band").distinct(), "near-members")
    stars = members.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    links = _linked(_near(stars, nodes, percent), texts, words, percent)
    found = connected_components(links, "near-components")

    # what the leaders have not joined
    placed = members.select("band", "id").join(found, "id", "left").select("band", "id", F.coalesce("component", "id").alias("c"))
    mixed = placed.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("of"))
    rank = F.row_number().over(Window.partitionBy("band").orderBy("c", "id"))
    ordered = written(placed.join(mixed.where("lo < hi and of > 2").select("band"), "band")
                      .withColumn("block", F.floor((rank - 1) / BLOCK).cast("int")), "near-blocks")
    nodes = written(nodes.join(bounded(ordered.select("id").distinct(), limit=ID_ROWS), "id", "left_semi"), "near-apart-nodes")
    blocks = (ordered.join(_block_pairs(ordered), ["band", "block"]).select("band", "id", "c", "block", "i", "j").join(nodes, "id"))
    asked = written(blocks.groupBy("band", "i", "j").applyInArrow(lambda t: _in_question(t, percent, SET_ROWS), _QUESTION), "near-questions")
    large = asked.where("other is not null").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    small = asked.where("other is null").drop("other")
    sets = _full_sets(small.select(F.col("id").alias("doc_id")).distinct(), texts, words)
    confirmed = (small.join(nodes, "id").join(sets, "id").groupBy("band", "i", "j")
                 .applyInArrow(lambda t: _joining_links(t, percent), "a long, b long"))
    more = written(confirmed, "near-more").unionByName(_linked(large, texts, words, percent))
    if not more.isEmpty():
        found = connected_components(links.unionByName(more), "near-components")

    named = owners.join(found, "id", "left").select(F.col("digest").alias("d_"), F.coalesce("component", "id").alias("by_set"))
    rows = sketches.select("rid", "doc_id", "n", "digest").join(named, F.col("digest") == F.col("d_"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("by_set", "doc_id"))
    return rows.select("rid", "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                       F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` (a table) without near-duplicates: of each component the row of its
    smallest id stays."""
    return without_rows(docs, near_duplicates(docs, words, percent).where("not kept").select("rid"))
