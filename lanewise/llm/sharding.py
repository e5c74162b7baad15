"""Sharding by histogram sort: shards of near-equal bytes, contiguous in a sort key.

Native throughout: DataFrame functions only. Rows are ordered by ``key`` (an integer; null first) and,
among equal keys, by a hash of size and text. A text key is ordered by its first 8 bytes, any other kind by its hash; null and an empty text tie. Splitter j is the first row before which at least
j/n of all bytes lie. The search for the splitters never sorts: each round counts, in every
partition, the exact bytes and rows in ``probes`` equal intervals of each still open bracket (a
partial aggregation, so a task sends at most probes x open brackets rows), and keeps the one
interval that holds the splitter, until a boundary is within ``tolerance`` of a shard's size or no
key lies between. When a single key is larger than that, its bracket goes on in the hash, and rows
equal in both are divided by their number, so a hot key or identical rows cannot make a shard
large. What the driver sees is (probes x shards) counts a round, at any size.

Rows are then exchanged once, by (shard, first-round interval); slots are numbered in those pieces and
shifted by the counts of the earlier pieces, so parallelism is not limited to the shard count.

Law: ``bytes``. Tolerance 0 gives the exact splitters, which any other order of work reproduces.

Defined cases: null text has size 8 (its 0 bytes plus 8); null keys come first; repeated rows are
placed one after the other; an empty table gives no rows; very long texts count by their bytes and are not copied;
other columns travel along unread, but one named like an output (``names``, in any case) is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.llm.common import durable, free_name, load, utf8_bytes

SHARDS, OVERHEAD, PROBES = 24, 8, 4096
OUT = ("size", "shard", "slot")
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def size_of(text: Column) -> Column:
    return utf8_bytes(text) + OVERHEAD


def key_of(df: DataFrame, key: str) -> Column:
    """The sort key as a long, in the order of integers or of a text's first 8 bytes; null is the lowest."""
    kind, c = df.schema[key].dataType, F.col(key)
    if isinstance(kind, T.IntegralType):
        out = c.cast("long")
    elif isinstance(kind, T.StringType):
        first = F.rpad(F.hex(F.substring(F.encode(c, "utf-8"), 1, 8)), 16, "0")
        out = (F.conv(first, 16, 10).cast("decimal(20,0)") + F.lit(_LOW).cast("decimal(20,0)")).cast("long")
    else:
        out = F.when(c.isNotNull(), F.xxhash64(c))
    return F.coalesce(out, F.lit(_LOW))


def _refine(rows: DataFrame, column: str, open_: dict[int, tuple], probes: int) -> dict[int, list]:
    """For each bracket (id: (low, high, condition)): [(interval's low, bytes, rows)] in order."""
    found: dict[int, list] = {}
    shape: dict[tuple, list[int]] = {}
    for j, bracket in open_.items():
        shape.setdefault(bracket, []).append(j)
    which, start, where = None, None, None
    marks = []
    for b, (low, high, only) in enumerate(shape):
        width = max(1, -(-(high - low + 1) // probes))
        inside = F.col(column).between(F.lit(low), F.lit(high))
        if only is not None:
            inside &= F.col("k1") == F.lit(only)
        # differences of a bracket wider than a long is are taken in decimals
        gap = (F.col(column).cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) if high - low > _HIGH else F.col(column) - F.lit(low)
        at = F.floor(gap / F.lit(width).cast("decimal(20,0)")) if high - low > _HIGH else F.expr(f"`{column}` div {width}L") if low == 0 else (gap - F.pmod(gap, F.lit(width))) / F.lit(width)
        marks.append((inside, F.lit(b), at.cast("int")))
    for inside, b, at in marks:
        which = F.when(inside, b) if which is None else which.when(inside, b)
        start = F.when(inside, at) if start is None else start.when(inside, at)
    counted = rows.select(which.alias("b"), start.alias("i"), "size").where("b is not null").groupBy("b", "i").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    by: dict[int, list] = {}
    for r in counted:
        by.setdefault(r.b, []).append((r.i, r.bytes, r.n))
    for b, ((low, high, _), ids) in enumerate(shape.items()):
        width = max(1, -(-(high - low + 1) // probes))
        found |= {j: [(low + i * width, min(high, low + (i + 1) * width - 1), nbytes, n) for i, nbytes, n in sorted(by.get(b, []))] for j in ids}
    return found


def splitters(rows: DataFrame, shards: int, *, tolerance: float = 0.0, probes: int = PROBES) -> tuple[list[tuple], int]:
    """(k1, k2, rows of that pair that stay below) of each splitter, and the total of bytes.

    rows: k1 and k2 (long, not null) and size. A row (k1, k2) is at or above a splitter if it is
    above the pair, or is one of the pair's rows beyond those that stay below.
    """
    total, low, high = rows.agg(F.sum("size"), F.min("k1"), F.max("k1")).first()
    if not total:
        return [], 0
    slack = int(tolerance * total / shards)
    # state of splitter j: bytes below its bracket, the bracket, its column
    state = {j: (0, low, high, None) for j in range(1, shards)}
    done: dict[int, tuple] = {}
    while state:
        for column in ("k1", "k2"):
            mine = {j: (s[1], s[2], s[3]) for j, s in state.items() if (s[3] is not None) == (column == "k2")}
            if not mine:
                continue
            for j, intervals in _refine(rows, column, mine, probes).items():
                below, _, _, only = state.pop(j)
                for a, b, nbytes, n in intervals:
                    # the first row with bytes before it >= j/shards of the total
                    if below * shards >= j * total - slack * shards:
                        done[j] = (a, _LOW, 0) if only is None else (only, a, 0)
                        break
                    if (below + nbytes) * shards >= j * total:
                        if a < b:
                            state[j] = (below, a, b, only)
                        elif only is None:
                            if n == 1 or (below + nbytes) * shards <= j * total + slack * shards:
                                done[j] = (a, _HIGH, 1 << 62)
                            else:
                                state[j] = (below, _LOW, _HIGH, a)
                        else:  # rows equal in both: of one size, so their number divides them
                            each = nbytes // n
                            done[j] = (only, a, -(-(j * total - below * shards) // (shards * each)))
                        break
                    below += nbytes
                else:
                    done[j] = (_HIGH, _HIGH, 1 << 62)
    return [done[j] for j in range(1, shards)], total


def shard(df: DataFrame, shards: int = SHARDS, *, key: str = "doc_id", text: str = "text", tolerance: float = 0.0, probes: int = PROBES, out: tuple[str, str, str] = OUT) -> DataFrame:
    """df with size, shard and slot (gapless from 0 in each shard, in key order), named as in ``out``."""
    names = {n: free_name(df, f"__{n}") for n in ("k1", "k2", "piece", "copy", "size", "shard", "slot", "before")}
    t = F.col(text).cast("string")
    keyed = df.withColumns({names["k1"]: key_of(df, key), names["k2"]: F.xxhash64(utf8_bytes(t), t), names["size"]: size_of(t)})
    narrow = durable(keyed.select(F.col(names["k1"]).alias("k1"), F.col(names["k2"]).alias("k2"), F.col(names["size"]).alias("size")))
    cuts, total = splitters(narrow, shards, tolerance=tolerance, probes=probes)
    k1, k2, copy = F.col(names["k1"]), F.col(names["k2"]), F.col(names["copy"])
    low, high = narrow.agg(F.min("k1"), F.max("k1")).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // probes))
    # only pairs that a splitter divides need a number for each of their rows
    inner = [c for c in cuts if 0 < c[2] < 1 << 62]
    divided = F.lit(False)
    for a, b, _ in set(inner):
        divided |= (k1 == F.lit(a)) & (k2 == F.lit(b))
    keyed = keyed.withColumn(names["copy"], F.when(divided, F.lit(None).cast("long")).otherwise(F.lit(0).cast("long")))
    if inner:
        numbered = keyed.where(divided).withColumn(names["copy"], F.row_number().over(Window.partitionBy(names["k1"], names["k2"]).orderBy(names["k1"])).cast("long") - 1)
        keyed = keyed.where(~divided).unionByName(numbered)
    at = F.lit(0)
    for a, b, n in cuts:
        above = (k1 > F.lit(a)) | ((k1 == F.lit(a)) & ((k2 > F.lit(b)) | ((k2 == F.lit(b)) & (copy >= F.lit(n)))))
        at = at + above.cast("int")
    piece = F.floor((k1.cast("decimal(20,0)") - F.lit(low or 0).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")).cast("long")
    placed = keyed.withColumns({names["shard"]: at.cast("int"), names["piece"]: piece})
    # counts of (shard, piece): at most probes + shards - 1 rows, as both follow the key
    of = [names["shard"], names["piece"]]
    counts = placed.groupBy(*of).agg(F.count("*").alias("n"))
    before = counts.select(*of, (F.sum("n").over(Window.partitionBy(names["shard"]).orderBy(names["piece"])) - F.col("n")).alias(names["before"]))
    order = Window.partitionBy(*of).orderBy(names["k1"], names["k2"], names["copy"])
    ranked = placed.withColumn(names["slot"], F.row_number().over(order).cast("long") - 1).join(F.broadcast(before), of)
    own = {c.lower() for c in out}
    made = F.col(names["size"]), F.col(names["shard"]), F.col(names["slot"]) + F.col(names["before"])
    return ranked.select(*[c for c in df.columns if c.lower() not in own], *[c.alias(n) for c, n in zip(made, out, strict=True)])


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, **options) -> None:
    """Parquet, a folder a shard; the exchange of shard() is the only one."""
    shard(df, shards, **options).write.partitionBy(options.get("out", OUT)[1]).parquet(path)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    # text is not needed beyond this point: only its sizes, hash and checksum are exchanged
    out = shard(docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
