"""Exact dedup by Patricia-trie owners (operator 9).

Texts are compared byte for byte. Every scan task inserts its texts into a compressed radix trie
and emits each distinct one once, with the ids that have it (so a group of copies leaves a task as
one row, however large it is). These rows are dealt by (length, content hash) and sorted by it; for
each such key a second trie takes the full byte strings and its terminal nodes store the owner, the
row that stays. What returns from it are small rows (handle of the task's text -> owner, size), and
the ids join them by handle; a handle's ids come from one task, so no key of that join is hot.

A trie holds at most ``budget`` bytes. In the scan, a full trie is emitted and begun anew. For one
(length, hash) key, which holds one text unless hashes collide, the subtrees that do not fit wait in
unnamed temporary files of the task and are taken one by one.

Defined cases: NULL text counts as empty; a NULL id is smaller than any other; of rows equal in text
and id one is kept; no rows, no result; extra columns are ignored by :func:`trie_owners` and stay in
:func:`deduplicate`. Texts of any length are compared whole.
"""

from __future__ import annotations

import hashlib
import itertools
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from clickweave.llm.common import bounded, free_name, text_or_empty, written

BUDGET = 64 << 20


class Trie:
    """Compressed radix trie of byte strings. A node is [label, children by first byte, value]."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]
        self.bytes = 0

    def at(self, key: bytes) -> list:
        """The terminal node of ``key``, made where it is missing."""
        node, i = self.root, 0
        while i < len(key):
            child = node[1].get(key[i])
            if child is None:
                child = [key[i:], {}, None]
                node[1][key[i]] = child
                self.bytes += len(key) - i + 200
                return child
            label = child[0]
            if not key.startswith(label, i):
                n = _common(key, i, label)
                upper = [label[:n], {label[n]: child}, None]
                child[0] = label[n:]
                node[1][key[i]] = child = upper
                self.bytes += 200
            i += len(child[0])
            node = child
        return node

    def items(self) -> Iterator[tuple[bytes, object]]:
        todo = [(b"", self.root)]
        while todo:
            before, node = todo.pop()
            here = before + node[0]
            if node[2] is not None:
                yield here, node[2]
            todo += [(here, c) for c in node[1].values()]


def _common(key: bytes, i: int, label: bytes) -> int:
    """Length of the common prefix of key[i:] and label, which differ."""
    lo, hi = 0, min(len(key) - i, len(label))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if key[i:i + mid] == label[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


_TEXTS = pa.schema([("handle", pa.int64()), ("text", pa.binary()), ("length", pa.int64()), ("hash", pa.int64()),
                    ("keep_id", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int64())), ("sha", pa.binary())])
_TEXTS_DDL = "handle long, text binary, length long, hash long, keep_id long, n long, ids array<long>, sha binary"
_LEAST = -(1 << 63)


def _rank(doc_id: int | None) -> int:
    return _LEAST if doc_id is None else doc_id


def _local(batches: Iterable[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Distinct texts of a task with their ids in ascending order."""
    base, made = TaskContext.get().partitionId() << 33, 0

    def emit(trie: Trie) -> Iterator[pa.RecordBatch]:
        nonlocal made
        rows: list[tuple] = []
        held = 0
        for text, ids in trie.items():
            ids = sorted(ids, key=_rank)
            rows.append((base + made, text, len(text), xxhash.xxh3_64_intdigest(text) - (1 << 63), ids[-1], len(ids), ids,
                         hashlib.sha256(text).digest()))
            made, held = made + 1, held + len(text)
            if held > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _TEXTS)], schema=_TEXTS)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _TEXTS)], schema=_TEXTS)

    trie = Trie()
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for doc_id, text in zip(ids, batch.column(1)):
            node = trie.at(text.as_buffer().to_pybytes())
            if node[2] is None:
                node[2] = []
            node[2].append(doc_id)
            if trie.bytes > budget:
                yield from emit(trie)
                trie = Trie()
    yield from emit(trie)


def _key_owners(rows: Iterable[tuple], budget: int) -> Iterator[tuple]:
    """rows: (text, handle, keep_id, n) of one (length, hash). Gives (handle, keep_id, owner's
    handle, group size). Once the trie is full, rows of texts that it lacks are spilled by the
    subtree of their first byte, and the subtrees are taken one after the other."""
    trie, spilled = Trie(), {}
    for row in rows:
        node = trie.at(row[0]) if trie.bytes <= budget else _find(trie, row[0])
        if node is None:
            if row[0][0] not in spilled:
                spilled[row[0][0]] = tempfile.TemporaryFile()
            pickle.dump(row, spilled[row[0][0]])
            continue
        if node[2] is None:
            node[2] = []
        node[2].append(row[1:])
    for _, members in trie.items():
        owner = max(members, key=lambda m: (_rank(m[1]), m[0]))
        size = sum(m[2] for m in members)
        for handle, _, _ in members:
            yield handle, owner[1], owner[0], size
    del trie
    for subtree in spilled.values():
        with subtree:
            subtree.seek(0)
            yield from _key_owners(_pickled(subtree), budget)


def _find(trie: Trie, key: bytes) -> list | None:
    node, i = trie.root, 0
    while i < len(key):
        child = node[1].get(key[i])
        if child is None or not key.startswith(child[0], i):
            return None
        i += len(child[0])
        node = child
    return node if node[2] is not None else None


def _pickled(file) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


_OWNERS = pa.schema([("handle", pa.int64()), ("keep_id", pa.int64()), ("keep_handle", pa.int64()), ("group_size", pa.int64())])


def _global(batches: Iterable[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (length, hash): one trie after the other."""
    def rows() -> Iterator[tuple]:
        for b in batches:
            yield from zip(b["length"].to_pylist(), b["hash"].to_pylist(), (t.as_buffer().to_pybytes() for t in b["text"]),
                           b["handle"].to_pylist(), b["keep_id"].to_pylist(), b["n"].to_pylist())

    def owners() -> Iterator[tuple]:
        for _, same in itertools.groupby(rows(), key=lambda r: r[:2]):
            yield from _key_owners((r[2:] for r in same), budget)

    out: list[tuple] = []
    for row in owners():
        out.append(row)
        if len(out) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=_OWNERS)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=_OWNERS)


def trie_owners(docs: DataFrame, text: Column | None = None, budget: int = BUDGET) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256. Of equal texts
    (NULL is empty) the row with the largest doc_id stays."""
    text = F.coalesce(F.col("text") if text is None else text, F.lit(""))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"))
    local = written(src.mapInArrow(lambda b: _local(b, budget), _TEXTS_DDL), "trie-local")
    dealt = (local.select("handle", "text", "length", "hash", "keep_id", "n").repartition("length", "hash")
             .sortWithinPartitions("length", "hash"))
    owners = dealt.mapInArrow(lambda b: _global(b, budget), "handle long, keep_id long, keep_handle long, group_size long")
    ids = local.select(F.col("handle").alias("own"), "ids", "sha")
    each = ids.join(owners, F.col("own") == F.col("handle")).select(
        "*", F.size("ids").alias("of"), F.posexplode("ids").alias("at", "doc_id"))
    # of rows equal in text and id, the last one of the owner's task stays
    kept = (F.col("own") == F.col("keep_handle")) & (F.col("at") == F.col("of") - 1)
    return each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicate(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The rows of ``docs`` that stay, all columns. What goes is looked up by (doc_id, sha256 of the
    text), broadcast if it is counted to be small; rows that repeat a kept one, if there are any,
    are dropped by a shuffle on both."""
    seen = written(trie_owners(docs, budget=budget).where("not kept"), "trie-dropped")
    id_, sha = free_name(docs, "_id"), free_name(docs, "_sha")
    same = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    gone = seen.where(~same).select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha))
    mine = F.sha2(text_or_empty(), 256)
    rest = docs.join(bounded(gone), F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (mine == F.col(sha)), "left_anti")
    repeats = not seen.where(same).isEmpty()
    return rest.dropDuplicates(["doc_id", "text"]) if repeats else rest
