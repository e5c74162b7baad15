"""Trace columns as compact blobs, and the indexed file of them.

A blob: a magic byte, the kind, warp size and length as varints, an all-active flag, the mask if not all are
active, then per warp either base and fixed-width residuals or raw words, whichever is smaller. The
table form, Parquet by site, is the native store; blobs serve exchange with other readers.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC, FILE_MAGIC = 0xC0, b"OTR1"
KINDS = ("U32", "F32")


def _varint(x: int) -> bytes:
    out = bytearray()
    while x >= 0x80:
        out.append(x & 0x7F | 0x80)
        x >>= 7
    return bytes([*out, x])


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        b = data[at]
        x |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return x, at


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    """values as rows of width bits, least significant first."""
    return (values[:, None] >> np.arange(width, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel()


def encode(bits: np.ndarray, active: np.ndarray | None = None, kind: str = "U32", warp_size: int = 32) -> bytes:
    bits = np.asarray(bits, np.uint64)
    out = bytearray([MAGIC, KINDS.index(kind)]) + _varint(warp_size) + _varint(len(bits))
    out.append(active is None)
    if active is not None:
        out += np.packbits(np.asarray(active, bool), bitorder="little").tobytes()
    warp, pieces = warp_size or 1, []
    for at in range(0, len(bits), warp):
        own = bits[at : at + warp]
        if active is not None:
            own = own[np.asarray(active[at : at + warp], bool)]
        base = np.uint64(0) if not len(own) else own[0] if kind == "F32" else own.min()
        rest = own ^ base if kind == "F32" else own - base
        width = int(rest.max()).bit_length() if len(rest) else 0
        if 1 + 32 * len(own) < 39 + len(own) * width:
            pieces += [np.ones(1, np.uint8), _bits(own, 32)]
        else:
            pieces += [np.zeros(1, np.uint8), _bits(np.array([base]), 32), _bits(np.array([width], np.uint64), 6), _bits(rest, width)]
    return bytes(out) + (np.packbits(np.concatenate(pieces), bitorder="little").tobytes() if pieces else b"")


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray | None, str, int]:
    """(bits, active or None, kind, warp size); lanes that are not active are 0."""
    if len(data) < 2 or data[0] != MAGIC:
        raise ValueError("not a trace column")
    kind, at = KINDS[data[1]], 2
    warp_size, at = _read_varint(data, at)
    n, at = _read_varint(data, at)
    full, at = data[at], at + 1
    active = None
    if not full:
        size = (n + 7) // 8
        active = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little")[:n].astype(bool)
        at += size
    stream = np.unpackbits(np.frombuffer(data, np.uint8, offset=at), bitorder="little").astype(np.uint64)
    out, pos = np.zeros(n, np.uint64), 0

    def take(count: int, width: int) -> np.ndarray:
        nonlocal pos
        rows = stream[pos : pos + count * width].reshape(count, width)
        pos += count * width
        return (rows << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    for w in range(0, n, warp_size or 1):
        lanes = np.arange(w, min(n, w + (warp_size or 1)))
        if active is not None:
            lanes = lanes[active[lanes]]
        if take(1, 1)[0]:
            out[lanes] = take(len(lanes), 32)
        else:
            base, width = take(1, 32)[0], int(take(1, 6)[0])
            rest = take(len(lanes), width)
            out[lanes] = rest ^ base if kind == "F32" else rest + base
    return out, active, kind, warp_size


def pack_file(columns: list[tuple[int, int, bytes]]) -> bytes:
    """The indexed file of (site, length, blob)."""
    at, directory = 8 + 32 * len(columns), b""
    for site, n, blob in columns:
        directory += struct.pack("<IIQQQ", site, 0, at, len(blob), n)
        at += len(blob)
    return FILE_MAGIC + struct.pack("<I", len(columns)) + directory + b"".join(b for *_, b in columns)


def unpack_file(data: bytes) -> list[tuple[int, int, bytes]]:
    if data[:4] != FILE_MAGIC:
        raise ValueError("not a trace file")
    out = []
    for k in range(struct.unpack_from("<I", data, 4)[0]):
        site, _, at, size, n = struct.unpack_from("<IIQQQ", data, 8 + 32 * k)
        if at + size > len(data):
            raise ValueError(f"column {k} ends beyond the file")
        out.append((site, n, data[at : at + size]))
    return out


def encode_sites(trace: DataFrame, kind: str = "U32", warp_size: int = 32, masked: bool = False) -> DataFrame:
    """(site, n, blob): a column a site; a column is one blob, so a site is one task's."""

    def make(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table["lane"].to_numpy())
        active = table["active"].to_numpy(zero_copy_only=False)[order] if masked else None
        blob = encode(table["bits"].to_numpy()[order], active, kind, warp_size)
        return pa.table({"site": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([len(order)], pa.int64()), "blob": pa.array([blob], pa.binary())})

    return trace.groupBy("site").applyInArrow(make, "site long, n long, blob binary")


def decode_sites(blobs: DataFrame) -> DataFrame:
    """(site, lane, bits, active) of (site, blob)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for site, blob in zip(batch.column(0), batch.column(1), strict=True):
                bits, active, _, _ = decode(blob.as_py())
                n = len(bits)
                yield pa.RecordBatch.from_pydict({"site": pa.array([site.as_py()] * n, pa.int64()), "lane": pa.array(np.arange(n), pa.int64()), "bits": pa.array(bits.astype(np.int64)), "active": pa.array(np.ones(n, bool) if active is None else active)})

    return blobs.select(F.col("site").cast("long"), "blob").mapInArrow(read, "site long, lane long, bits long, active boolean")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, position, site, n, blob) of every column of the indexed files at path."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                rows = unpack_file(data.as_py())
                yield pa.RecordBatch.from_pydict({"path": pa.array([name.as_py()] * len(rows), pa.string()), "position": pa.array(range(len(rows)), pa.int32()), "site": pa.array([r[0] for r in rows], pa.int64()), "n": pa.array([r[1] for r in rows], pa.int64()), "blob": pa.array([r[2] for r in rows], pa.binary())})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(split, "path string, position int, site long, n long, blob binary")


def column_by_site(columns: DataFrame, site: int) -> DataFrame:
    """The first column of a site in each file; no row if it has none."""
    return columns.where(F.col("site") == site).groupBy("path").agg(F.min_by(F.struct("site", "n", "blob"), "position").alias("c")).select("path", "c.*")


def column_by_index(columns: DataFrame, position: int) -> DataFrame:
    """The column at a position of each file; no row if it has none."""
    return columns.where(F.col("position") == position).select("path", "site", "n", "blob")
