"""SentencePiece encoding and decoding by a max-plus scan (operator 4).

The ids are the sentencepiece library's for the given model file, without begin and end tokens.
Between two characters that no piece has side by side every segmentation has a boundary. Texts of usual
length, and stretches between two such boundaries, are encoded and decoded by the library.

Giant texts (over two chunks) are a max-plus product. The state of a chunk's edge is the step, a
piece or a character without one, that begins last before the edge: where it begins and ends. A
chunk's transfer matrix has the best sum of scores over the paths of steps from each entry state to
each exit state; in a byte-pair model two steps follow each other only if the library cuts their
joint text so, which leaves the library's segmentation as the only path through the whole text.
Matrices are multiplied associatively, in blocks of 256 chunks and then over the blocks, which gives
the state at every block edge; with these every block finds the states at its chunks' edges, and
every chunk is traced back on its own. Chunk edges are moved to a certain boundary if there is one
within 1,024 characters; the edge has one state then, and inside a chunk paths are followed only
between its edges and the nearest certain boundaries.

Scores are whole numbers (files with fractions: millionths), so sums are exact in any order.

Defined cases: NULL and empty texts have no pieces; NULL ids stay; repeated rows are rows of their
own; no rows, no result; extra columns are ignored. Decoding gives back the text, but for marks
(U+2581) in it, which come back as spaces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from clickweave.llm.common import text_or_empty, written

MARK = "▁"
NEVER = -(1 << 61)
#: Pairs of steps that a Python worker remembers.
_CACHE = 400_000
_SEEK, _BLOCK = 1024, 256
#: Ids decoded at a time for a digest.
_DECODED = 1 << 18


class Lattice:
    """Pieces of a model file, the library's segmentation of short stretches, and paths of pieces."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto.FromString(model)
        n = spec.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or not n.escape_whitespaces:
            raise ValueError("only models that keep texts as they are but for marks")
        n.add_dummy_prefix = False  # stretches come with their marks
        self.library = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        self.byte_pair = spec.trainer_spec.model_type == 2
        scale = 1 if all(p.score == int(p.score) for p in spec.pieces) else 1_000_000
        self.scores = np.array([round(p.score * scale) for p in spec.pieces], np.int64)
        self.text = [p.piece for p in spec.pieces]
        self.known = {p.piece for p in spec.pieces if p.type in (1, 4)}
        self.byte_of = {i: int(p.piece[1:-1], 16) for i, p in enumerate(spec.pieces) if p.type == 6}
        self.control = {i for i, p in enumerate(spec.pieces) if p.type in (2, 3)}
        self.longest = max(map(len, self.known))
        self.inner = {a + b for p in self.known for a, b in zip(p, p[1:])}
        self.pairs: dict[tuple[str, str], bool] = {}

    def apart(self, text: str, p: int) -> bool:
        """Whether every segmentation has a boundary before text[p]."""
        return p <= 0 or p >= len(text) or text[p - 1:p + 1] not in self.inner

    def solve(self, stretches: list[str]) -> list[bytes]:
        """Ids (32 bit) of stretches that stand between certain boundaries."""
        return [np.array(ids, np.int32).tobytes() for ids in self.library.encode(stretches, num_threads=1)]

    def ids(self, text: str) -> bytes:
        """Ids of a marked text between certain boundaries."""
        return self.solve([text])[0]

    def spelled(self, ids: list[list[int]]) -> list[str]:
        """Texts from their ids, the space before the first word included."""
        return self.library.decode(ids, num_threads=1)

    def decode(self, ids: list[int]) -> str:
        return self.joined(ids)[1:]

    def joined(self, ids: list[int]) -> str:
        """The text of some of a text's ids, the space before its first word included."""
        pieces, bytes_, out = self.text, self.byte_of, []
        if bytes_.keys().isdisjoint(ids) and self.control.isdisjoint(ids):
            out = map(pieces.__getitem__, ids)
        else:
            run = bytearray()
            for i in ids:
                if i in bytes_:
                    run.append(bytes_[i])
                elif i not in self.control:
                    out += [run.decode("utf-8", "replace"), pieces[i]]
                    run.clear()
            out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")

    # Paths of pieces, for chunk edges and for stretches without a certain boundary

    def piece(self, text: str) -> bool:
        """Whether ``text`` can be one step of a path: a piece that stays whole, or one character."""
        if text not in self.known:
            return len(text) == 1
        return len(text) == 1 or self.follows("", text)

    def follows(self, left: str, right: str) -> bool:
        """Whether two steps can stand side by side. In a byte-pair model they can if the library cuts
        their text just so; a path all of whose neighbours can is the library's segmentation, as the
        first merge over one of its boundaries would be made in the text of those two alone too."""
        if not self.byte_pair or (left and left[-1] + right[0] not in self.inner):
            return True
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) > _CACHE:
                self.pairs.clear()
            want = [self.library.encode(x) for x in (left, right) if x]
            found = self.library.encode(left + right) == sum(want, []) and (bool(left) or len(want[0]) == 1)
            self.pairs[left, right] = found
        return found

    def edge(self, text: str, p: int) -> list[tuple[int, int]]:
        """States of an edge at text[p]: where the last step that begins before it begins and ends. One
        state, (0, 0), if every segmentation has a boundary there."""
        if self.apart(text, p):
            return [(0, 0)]
        reach = self.longest
        return [(s - p, e - p) for s in range(max(0, p - reach), p) for e in range(p, min(s + reach, len(text)) + 1) if self.piece(text[s:e])]

    def paths(self, text: str, start: int, entry: tuple[int, int], stop: int) -> dict[int, dict[int, tuple[int, int]]]:
        """Steps by end and begin: (best sum, begin of the step before). They begin at ``start``, after
        the step that the state ``entry`` names, and before ``stop``."""
        first = start + entry[1]
        found: dict[int, dict[int, tuple[int, int]]] = {first: {start + entry[0]: (0, -1)}}
        for at in range(first, stop):
            for begin, (best, _) in found.get(at, {}).items():
                left = text[begin:at]
                for end in range(at + 1, min(at + self.longest, len(text)) + 1):
                    right = text[at:end]
                    if not self.piece(right) or (left and not self.follows(left, right)):
                        continue
                    total = best + int(self.scores[self.library.encode(right)].sum())
                    steps = found.setdefault(end, {})
                    if at not in steps or total > steps[at][0]:
                        steps[at] = (total, begin)
        return found

    def _ends(self, found: dict[int, dict[int, tuple[int, int]]], stop: int, state: tuple[int, int], free: bool) -> list[tuple[int, int, int]]:
        """(sum, begin, end) of the steps that leave a chunk in ``state``."""
        if free:
            return [(v[0], s, stop) for s, v in found.get(stop, {}).items()]
        s, e = stop + state[0], stop + state[1]
        return [(found[e][s][0], s, e)] if s in found.get(e, {}) else []

    def _bounds(self, text: str, lo: int, hi: int) -> tuple[int, int]:
        """First and last certain boundary of a chunk that no edge state passes by; (-1, -1): none."""
        first = lo if self.apart(text, lo) else next((p for p in range(lo + self.longest, hi + 1) if self.apart(text, p)), -1)
        last = hi if self.apart(text, hi) else next((p for p in range(hi - 1, max(first, 0), -1) if self.apart(text, p)), -1)
        return (first, last) if 0 <= first <= last else (-1, -1)

    def transfer(self, text: str, lo: int, hi: int) -> np.ndarray:
        """Best sums of the chunk text[lo:hi] from each entry state to each exit state."""
        entries, exits = self.edge(text, lo), self.edge(text, hi)
        free = self.apart(text, hi)
        first, last = self._bounds(text, lo, hi)

        def best(start: int, entry: tuple[int, int], stop: int, state: tuple[int, int], open_: bool) -> int:
            return max((x[0] for x in self._ends(self.paths(text, start, entry, stop), stop, state, open_)), default=NEVER)

        if first < 0:
            out = np.full((len(entries), len(exits)), NEVER, np.int64)
            for i, entry in enumerate(entries):
                found = self.paths(text, lo, entry, hi)
                out[i] = [max((x[0] for x in self._ends(found, hi, state, free)), default=NEVER) for state in exits]
            return out
        left = [0 if first == lo else best(lo, entry, first, (0, 0), True) for entry in entries]
        middle = int(self.scores[np.frombuffer(self.ids(text[first:last]), np.int32)].sum())
        found = {} if last == hi else self.paths(text, last, (0, 0), hi)
        right = [0 if last == hi else max((x[0] for x in self._ends(found, hi, state, free)), default=NEVER) for state in exits]
        total = np.array(left, np.int64)[:, None] + np.array(right, np.int64)[None, :] + middle
        return np.where((np.array(left)[:, None] > NEVER) & (np.array(right)[None, :] > NEVER), total, NEVER)

    def _traced(self, text: str, start: int, entry: tuple[int, int], stop: int, state: tuple[int, int], free: bool) -> bytes:
        found = self.paths(text, start, entry, stop)
        _, begin, end = max(self._ends(found, stop, state, free))
        steps = []
        while end > start + entry[1]:
            steps.append(text[begin:end])
            begin, end = found[end][begin][1], begin
        return b"".join(self.solve(steps[::-1]))

    def trace(self, text: str, lo: int, hi: int, entry: int, exit_: int) -> bytes:
        """Ids of the steps of the best path that begin in the chunk."""
        came, goes = self.edge(text, lo)[entry], self.edge(text, hi)[exit_]
        free = self.apart(text, hi)
        first, last = self._bounds(text, lo, hi)
        if first < 0:
            return self._traced(text, lo, came, hi, goes, free)
        left = b"" if first == lo else self._traced(text, lo, came, first, (0, 0), True)
        right = b"" if last == hi else self._traced(text, last, (0, 0), hi, goes, free)
        return left + self.ids(text[first:last]) + right

    def encode(self, text: str) -> bytes:
        return self.ids(marked(text))


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), NEVER)


def states(matrices: list[np.ndarray], entry: int, exit_: int) -> list[int]:
    """The states (their numbers) at all edges of the best path from ``entry`` to ``exit_``."""
    vectors = [np.full(len(matrices[0]), NEVER, np.int64)]
    vectors[0][entry] = 0
    for m in matrices:
        vectors.append(np.maximum((vectors[-1][:, None] + m).max(axis=0), NEVER))
    out = [exit_]
    for v, m in zip(reversed(vectors[:-1]), reversed(matrices)):
        out.append(int((v + m[:, out[-1]]).argmax()))
    return out[::-1]


_LOADED: dict[int, Lattice] = {}


def lattice_of(model: bytes) -> Lattice:
    """The model, read once per Python worker."""
    key = hash(model)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Lattice(model)
    return _LOADED[key]


def _id_lists(blobs: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in blobs])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(blobs), np.int32)))


def _encoded(batches: Iterable[pa.RecordBatch], model: bytes, digests: bool) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) of usual texts."""
    lattice = lattice_of(model)
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = part.column(1).to_pylist()
            found = lattice.library.encode([marked(t) for t in texts], num_threads=1)
            columns = [part.column(0), pa.array([len(t) for t in texts], pa.int64()), _id_lists([np.array(i, np.int32).tobytes() for i in found])]
            names = ["doc_id", "n_chars", "ids"]
            if digests:
                columns.append(pa.array([hashlib.sha256(t[1:].encode()).hexdigest() for t in lattice.spelled(found)], pa.string()))
                names.append("decoded_sha256")
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _cut(batches: Iterable[pa.RecordBatch], model: bytes, chunk: int) -> Iterator[pa.RecordBatch]:
    """(rid, c, lo, hi, text): chunk c is text[lo:hi]; around it is what steps over its edges need."""
    lattice = lattice_of(model)
    for b in batches:
        for rid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            text, edges, around = marked(text), [0], 2 * lattice.longest
            for nominal in range(chunk, len(text) - chunk + 1, chunk):
                seek = range(nominal, min(nominal + _SEEK, nominal + chunk // 2))
                edges.append(next((p for p in seek if lattice.apart(text, p)), nominal))
            for c, (a, e) in enumerate(zip(edges, [*edges[1:], len(text)])):
                lo = max(0, a - around)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rid], pa.int64()), pa.array([c], pa.int32()), pa.array([a - lo], pa.int32()), pa.array([e - lo], pa.int32()),
                     pa.array([text[lo:e + around]], pa.string())], names=["rid", "c", "lo", "hi", "text"])


def _transfers(batches: Iterable[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    lattice = lattice_of(model)
    for b in batches:
        found = [lattice.transfer(*row) for row in zip(*(b[x].to_pylist() for x in ("text", "lo", "hi")))]
        yield pa.RecordBatch.from_arrays([b["rid"], b["c"], pa.array([len(m) for m in found], pa.int32()),
                                          pa.array([m.tobytes() for m in found], pa.binary())], names=["rid", "c", "rows", "m"])


def _matrices(table: pa.Table, by: str) -> list[np.ndarray]:
    rows = sorted(zip(table[by].to_pylist(), table["rows"].to_pylist(), table["m"]), key=lambda x: x[0])
    return [np.frombuffer(m.as_buffer(), np.int64).reshape(n, -1) for _, n, m in rows]


def _multiplied(table: pa.Table) -> pa.Table:
    out, *rest = _matrices(table, "c")
    for m in rest:
        out = product(out, m)
    return pa.table({"rid": table["rid"][:1], "block": table["block"][:1], "rows": pa.array([len(out)], pa.int32()),
                     "m": pa.array([out.tobytes()], pa.binary())})


def _block_states(table: pa.Table) -> pa.Table:
    """All blocks of a text (at most 2**31 / chunk / 256): the states at their edges."""
    at = states(_matrices(table, "block"), 0, 0)
    return pa.table({"rid": table["rid"], "block": pa.array(sorted(table["block"].to_pylist()), pa.int32()),
                     "entry": pa.array(at[:-1], pa.int32()), "exit": pa.array(at[1:], pa.int32())})


def _chunk_states(chunks: pa.Table, block: pa.Table) -> pa.Table:
    at = states(_matrices(chunks, "c"), block["entry"][0].as_py(), block["exit"][0].as_py())
    return pa.table({"rid": chunks["rid"], "c": pa.array(sorted(chunks["c"].to_pylist()), pa.int32()),
                     "entry": pa.array(at[:-1], pa.int32()), "exit": pa.array(at[1:], pa.int32())})


def _traces(batches: Iterable[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    lattice = lattice_of(model)
    for b in batches:
        blobs = [lattice.trace(*row) for row in zip(*(b[x].to_pylist() for x in ("text", "lo", "hi", "entry", "exit")))]
        yield pa.RecordBatch.from_arrays([b["rid"], b["c"], _id_lists(blobs)], names=["rid", "c", "part"])


def scan_giants(giants: DataFrame, model: bytes, chunk: int, block: int = _BLOCK) -> DataFrame:
    """(rid, text) -> (rid, n_chunks, ids)."""
    chunks = written(giants.mapInArrow(lambda b: _cut(b, model, chunk), "rid long, c int, lo int, hi int, text string")
                     .repartition("rid", "c"), "pieces-chunks")
    of = F.floor(F.col("c") / block).cast("int").alias("block")
    steps = written(chunks.mapInArrow(lambda b: _transfers(b, model), "rid long, c int, rows int, m binary").select("*", of), "pieces-transfers")
    blocks = steps.groupBy("rid", "block").applyInArrow(_multiplied, "rid long, block int, rows int, m binary")
    edges = blocks.groupBy("rid").applyInArrow(_block_states, "rid long, block int, entry int, exit int")
    at = steps.groupBy("rid", "block").cogroup(edges.groupBy("rid", "block")).applyInArrow(
        _chunk_states, "rid long, c int, entry int, exit int")
    parts = chunks.join(at, ["rid", "c"]).mapInArrow(lambda b: _traces(b, model), "rid long, c int, part array<int>")
    whole = F.sort_array(F.collect_list(F.struct("c", "part")))
    return parts.groupBy("rid").agg(F.count(F.lit(1)).alias("n_chunks"), whole.alias("w")).select(
        "rid", "n_chunks", F.flatten(F.col("w.part")).alias("ids"))


def encode(docs: DataFrame, model: bytes, chunk: int = 16_384, digests: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, n_chunks, n_pieces, ids; and with ``digests``
    decoded_sha256 as :func:`with_digests` has it, usual texts being decoded in the pass that encodes them."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    giant = F.length("text") > 2 * chunk
    ddl = "doc_id long, n_chars long, ids array<int>" + ", decoded_sha256 string" * digests
    columns = ["doc_id", "n_chars", "n_chunks", "ids", *["decoded_sha256"] * digests]
    out = (rows.where(~giant).select("doc_id", "text").mapInArrow(lambda b: _encoded(b, model, digests), ddl)
           .withColumn("n_chunks", F.lit(1).cast("long")).select(*columns))
    giants = written(rows.where(giant).withColumn("n_chars", F.length("text").cast("long")), "pieces-giants")
    if not giants.isEmpty():
        found = scan_giants(giants.select("rid", "text"), model, chunk)
        found = giants.select("rid", "doc_id", "n_chars").join(with_digests(found, model) if digests else found, "rid")
        out = out.unionByName(found.select(*columns))
    return out.withColumn("n_pieces", F.size("ids").cast("long")).select("doc_id", "n_chars", "n_chunks", "n_pieces", "ids", *["decoded_sha256"] * digests)


def _decoded(batches: Iterable[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    """The last column, ids, as text."""
    lattice = lattice_of(model)
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = [lattice.decode(i) for i in part.column(part.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*part.schema.names[:-1], "text"])


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text)."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda b: _decoded(b, model), "doc_id long, text string")


def _digest(lattice: Lattice, ids: pa.Array) -> str:
    """sha256 of the text that ``ids`` decode to, part by part; a character's bytes stay in one part."""
    digest, held, start = hashlib.sha256(), [], True
    for at in range(0, len(ids), _DECODED):
        part = held + ids.slice(at, _DECODED).to_pylist()
        cut = len(part)
        while at + _DECODED < len(ids) and cut and (part[cut - 1] in lattice.byte_of or part[cut - 1] in lattice.control):
            cut -= 1
        text, held = lattice.joined(part[:cut]), part[cut:]
        digest.update(text[int(start):].encode())
        start = start and not text
    return digest.hexdigest()


def _digests(batches: Iterable[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    lattice = lattice_of(model)
    for batch in batches:
        found = [_digest(lattice, ids.values) for ids in batch["ids"]]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "decoded_sha256"])


def with_digests(encoded: DataFrame, model: bytes) -> DataFrame:
    """``encoded`` and decoded_sha256, of the UTF-8 text that its ids decode to: that of the input with
    marks (U+2581) as spaces."""
    return encoded.mapInArrow(lambda b: _digests(b, model), T.StructType([*encoded.schema.fields, T.StructField("decoded_sha256", T.StringType())]))
