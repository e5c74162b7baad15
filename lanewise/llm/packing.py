"""Packed token ids: best-fit-decreasing packing of documents into fixed-length rows.

Documents become token ids (byte-level BPE ranks); a document longer than ``length`` is split into
consecutive chunks, so no token is lost or added. Each task packs its own partition, in blocks of at most
``block_tokens`` tokens: chunks in decreasing length go to the open row with the least room that still
holds them, found by a segment tree over capacities. Nothing is shuffled, so neither a hot key nor copies
matter, memory is bounded by the block, and a lost task is redone from its input split alone. A
block leaves a few part-filled rows, a fraction of a percent of a whole block; partitions of far fewer tokens than a
block cost more (200 of some 20,000 tokens each were filled to 0.88), so tables of many small files are coalesced first.

A packed row has the ids padded to ``length`` (little-endian unsigned 32-bit), cumulative segment
lengths from 0, position ids that restart at each segment, and which (document, chunk) each
segment is.

``write_packed`` writes the rows as files of a table, ``matrices`` gives them to a trainer as id and position
matrices with cumulative lengths, and ``unpacked`` turns rows back into each document's ids.

Defined cases: null and empty texts have no tokens and take no room; repeated documents are packed
each; ties in length go by order of arrival; very long texts are split into chunks and lose no token; columns beside
key and text, whatever their names, are not read; an empty table gives no rows; a document id may be null.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.llm.common import load

LENGTH, BLOCK_TOKENS, PAD = 2048, 4_000_000, 0

_ROW = T.StructType(
    [
        T.StructField("pack_id", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("chunks", T.ArrayType(T.IntegerType())),
        T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
        T.StructField("ids", T.BinaryType()),
        T.StructField("positions", T.BinaryType()),
    ]
)
_SCHEMA = pa.schema([("pack_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("chunks", pa.list_(pa.int32())), ("cu_seqlens", pa.list_(pa.int32())), ("ids", pa.binary()), ("positions", pa.binary())])


class Capacities:
    """Which rooms from 0 to most have an open row: least room of at least some size in log time."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.tree[at] += by
            at >>= 1

    def least(self, need: int) -> int:
        """The least room >= need with an open row; -1 if there is none."""
        at, tree = need + self.size, self.tree
        if tree[at]:
            return need
        while at > 1:
            if not at & 1 and tree[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if tree[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return -1


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Indices of the sizes in each row; ties go by index, rows with the same room last in first out."""
    open_, rooms, rows = Capacities(length), [[] for _ in range(length + 1)], []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        need = sizes[k]
        room = open_.least(need)
        if room < 0:
            row, room = len(rows), length
            rows.append([])
        else:
            row = rooms[room].pop()
            open_.add(room, -1)
        rows[row].append(k)
        if left := room - need:
            rooms[left].append(row)
            open_.add(left, 1)
    return rows


_TOKENIZERS: dict = {}


def _tokenizer(held):
    import tiktoken

    pattern, ranks = held.value
    key = hashlib.sha256(ranks).hexdigest()
    if key not in _TOKENIZERS:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _TOKENIZERS[key] = tiktoken.Encoding(key[:8], pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _TOKENIZERS[key]


def vocabulary(spark: SparkSession, path: str | None = None):
    """(pattern, rank file) for all tasks: a vocabulary, which never grows with the data."""
    import public_tokenizers as P

    with open(path or P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return spark.sparkContext.broadcast((P.PATTERN, f.read()))


def _packed(chunks: list[tuple], length: int) -> Iterator[tuple]:
    for row in best_fit_decreasing([len(c[2]) for c in chunks], length):
        own = [chunks[k] for k in row]
        cuts = np.concatenate([[0], np.cumsum([len(c[2]) for c in own])]).astype(np.int32)
        ids = np.full(length, PAD, "<u4")
        ids[: cuts[-1]] = np.concatenate([c[2] for c in own])
        positions = np.zeros(length, "<u4")
        positions[: cuts[-1]] = np.arange(cuts[-1]) - np.repeat(cuts[:-1], np.diff(cuts))
        yield [c[0] for c in own], [c[1] for c in own], cuts.tolist(), ids.tobytes(), positions.tobytes()


def _packer(held, length: int, block_tokens: int, shape=None):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = _tokenizer(held).encode_ordinary
        first, made, chunks, held_tokens = TaskContext.get().partitionId() << 33, 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            rows = []
            for row in _packed(chunks, length):
                rows.append((first + made, *row))
                made += 1
                if len(rows) == 1024:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            if shape:
                return shape(rows)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if not (text := text.as_py()):
                    continue
                ids, doc_id = np.array(encode(text), "<u4"), doc_id.as_py()
                for k, at in enumerate(range(0, len(ids), length)):
                    chunks.append((doc_id, k, ids[at : at + length]))
                    held_tokens += len(chunks[-1][2])
                    if held_tokens >= block_tokens:
                        yield from flush()
                        chunks, held_tokens = [], 0
        yield from flush()

    return pack


def pack(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, block_tokens: int = BLOCK_TOKENS, path: str | None = None) -> DataFrame:
    """(pack_id, doc_ids, chunks, cu_seqlens, ids, positions), a row a packed sequence."""
    held = vocabulary(docs.sparkSession, path)
    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(_packer(held, length, block_tokens), _ROW)


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """pack() as Parquet below path: a row a packed sequence, ids and positions as fixed-length binary."""
    pack(docs, **options).write.parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_ROW).parquet(path)


def matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(id matrix, position matrix, cumulative lengths of each row) of record batches of packed rows."""
    for batch in batches:
        columns = dict(zip(batch.schema.names, batch.columns, strict=True))
        ids, positions = (np.frombuffer(b"".join(columns[c].to_pylist()), "<u4").reshape(batch.num_rows, -1) for c in ("ids", "positions"))
        yield ids, positions, [np.array(x, np.int32) for x in columns["cu_seqlens"].to_pylist()]


def unpacked(packed: DataFrame) -> DataFrame:
    """(doc_id, ids: little-endian unsigned 32-bit) of every document with tokens: its chunks joined in order.

    A document id that repeats, or is null, gives one row of all that was packed under it.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, chunks, parts = [], [], []
            for doc_ids, own, cuts, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                docs += doc_ids
                chunks += own
                parts += [ids[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64()), "chunk": pa.array(chunks, pa.int32()), "part": pa.array(parts, pa.binary())})

    rows = packed.select("doc_ids", "chunks", "cu_seqlens", "ids").mapInArrow(cut, "doc_id long, chunk int, part binary")
    joined = F.aggregate(F.sort_array(F.collect_list(F.struct("chunk", "part"))), F.lit(b""), lambda acc, x: F.concat(acc, x["part"]))
    return rows.groupBy("doc_id").agg(joined.alias("ids"))


def _digest(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "pack_id": pa.array([r[0] for r in rows], pa.int64()),
            "n_segments": pa.array([len(r[1]) for r in rows], pa.int64()),
            "n_tokens": pa.array([r[3][-1] for r in rows], pa.int64()),
            "doc_ids": pa.array([r[1] for r in rows], pa.list_(pa.int64())),
            "chunks": pa.array([r[2] for r in rows], pa.list_(pa.int32())),
            "cu_seqlens": pa.array([r[3] for r in rows], pa.list_(pa.int32())),
            "ids_sha256": pa.array([hashlib.sha256(r[4]).hexdigest() for r in rows], pa.string()),
            "positions_sha256": pa.array([hashlib.sha256(r[5]).hexdigest() for r in rows], pa.string()),
        }
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed rows with their binary columns as digests."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    shape = "pack_id long, n_segments long, n_tokens long, doc_ids array<long>, chunks array<int>, cu_seqlens array<int>, ids_sha256 string, positions_sha256 string"
    return docs.mapInArrow(_packer(vocabulary(spark), LENGTH, BLOCK_TOKENS, _digest), shape)
