"""One-dimensional unsigned 16- and 32-bit .npy streams, PPM images and run configuration."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def npy_bytes(values: np.ndarray, code: str = "<u2") -> bytes:
    """A version 1.0 file whose data starts at a multiple of 64."""
    head = f"{{'descr': '{code}', 'fortran_order': False, 'shape': ({len(values)},), }}"
    head += " " * (-(len(head) + 11) % 64) + "\n"
    return b"\x93NUMPY\1\0" + struct.pack("<H", len(head)) + head.encode() + np.asarray(values).astype(code).tobytes()


def npy_values(data: bytes) -> np.ndarray:
    if data[:6] != b"\x93NUMPY":
        raise ValueError("not an array file")
    size = struct.unpack_from("<H", data, 8)[0]
    head = data[10 : 10 + size].decode()
    code = next((c for c in ("<u2", "<u4") if f"'{c}'" in head), None)
    if code is None:
        raise ValueError("not an unsigned 16- or 32-bit array")
    n = int(head.split("'shape': (")[1].split(",")[0])
    out = np.frombuffer(data, code, offset=10 + size)
    if len(out) < n:
        raise ValueError("the array is cut off")
    return out[:n]


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, token) of every file at path."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                values = npy_values(data.as_py())
                for at in range(0, len(values), 1 << 20):
                    part = values[at : at + (1 << 20)]
                    yield pa.RecordBatch.from_pydict({"path": pa.array([name.as_py()] * len(part), pa.string()), "pos": pa.array(np.arange(at, at + len(part)), pa.int64()), "token": pa.array(part.astype(np.int64))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, "path string, pos long, token long")


def npy_shards(tokens: DataFrame, by: str, vocab: int = 1 << 16) -> DataFrame:
    """(by, content): an array file a shard of (by, pos, token)."""
    code = "<u2" if vocab <= 1 << 16 else "<u4"

    def make(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table["pos"].to_numpy())
        return pa.table({by: pa.array([key[0].as_py()], pa.int64()), "content": pa.array([npy_bytes(table["token"].to_numpy()[order], code)], pa.binary())})

    return tokens.select(F.col(by).cast("long").alias(by), "pos", "token").groupBy(by).applyInArrow(make, f"`{by}` long, content binary")


def ppm_images(pixels: DataFrame) -> DataFrame:
    """(img, content): a binary PPM of (img, x, y, r, g, b) with components clamped to [0, 1]."""

    def make(key: tuple, table: pa.Table) -> pa.Table:
        x, y = table["x"].to_numpy(), table["y"].to_numpy()
        w, h = int(x.max()) + 1, int(y.max()) + 1
        image = np.zeros((h, w, 3), np.uint8)
        for k, c in enumerate("rgb"):
            image[y, x, k] = np.floor(np.clip(table[c].to_numpy(), 0, 1) * 255 + 0.5)
        return pa.table({"img": pa.array([key[0].as_py()], pa.int64()), "content": pa.array([b"P6\n%d %d\n255\n" % (w, h) + image.tobytes()], pa.binary())})

    return pixels.groupBy("img").applyInArrow(make, "img long, content binary")


def read_config(spark: SparkSession, path: str, defaults: dict[str, str]) -> DataFrame:
    """(key, value) of 'key = value' or 'key value' lines over the defaults; # starts a comment."""
    line = F.trim(F.regexp_replace("value", r"#.*$", ""))
    parts = F.regexp_extract(line, r"^(\S+?)\s*(?:=|\s)\s*(.*)$", 1), F.regexp_extract(line, r"^(\S+?)\s*(?:=|\s)\s*(.*)$", 2)
    own = spark.read.text(path).select(parts[0].alias("key"), F.trim(parts[1]).alias("own"), F.monotonically_increasing_id().alias("at")).where("key != ''")
    own = own.groupBy("key").agg(F.max_by("own", "at").alias("own"))
    base = spark.createDataFrame(list(defaults.items()), "key string, base string")
    return base.join(own, "key", "full").select("key", F.coalesce("own", "base").alias("value"))


def first_error_line(log: Column) -> Column:
    """Line number of a compiler log's first error; null without one."""
    found = F.regexp_extract(log, r"ERROR: [^:]*:(\d+):", 1)
    return F.when(found != "", found.cast("int"))
