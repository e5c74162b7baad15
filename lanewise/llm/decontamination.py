"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z become a-z. A benchmark item
gives every window of ``window`` consecutive words; an item with fewer words (but some) is one
window. Windows of one length share one matcher: a SHIFT table over blocks of two words skips
positions where no window can end, the bucket of the last block (with a hash on the first two
words) selects windows, and a direct comparison confirms each occurrence.

The benchmark is the side that is sent to every task. Its windows are counted first; items are cut into
segments of at most ``SEGMENT`` windows (a long item's segments overlap by a window less one word), and beyond
``block_windows`` the segments are dealt into blocks of about that many windows. Documents pass one block after
the other, each pass cut by a checkpoint, so memory never follows the benchmark. A window is held as a place in
its segment's words under one key of four words, some 300 bytes, so a block is about 120 MB in a worker.

Defined cases: a null or wordless document has no words, no hits, contaminated = false; null and
wordless items match nothing; an item whose id is null still marks words but is not listed; items
that repeat an id count once; items and documents of any length are searched whole; repeated documents are judged
one by one. An existing column named like ``out`` (in any case) is replaced; all other columns stay.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.llm.common import durable, free_name, load

WINDOW = 10
#: About how many windows one pass holds in each worker, and how many a segment of an item has at most.
BLOCK_WINDOWS, SEGMENT = 400_000, 20_000

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_STATE = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.BinaryType()),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_TABLE).split()


class WuManber:
    """Windows of one length, over words; a window is (item id, its segment's words, place)."""

    def __init__(self, length: int, segments: list[tuple[str | None, list[bytes]]]) -> None:
        self.length, self.block = length, min(2, length)
        self.most = length - self.block + 1
        self.segments = segments
        self.shift: dict[tuple[bytes, ...], int] = {}
        # the last block and the first words of a window -> places, as segment << 32 | first word
        self.buckets: dict[tuple[bytes, ...], int | list[int]] = {}
        b, last, shift = self.block, length - self.block, self.shift
        for k, (_, words) in enumerate(segments):
            n = len(words) - length + 1  # windows
            for at in range(len(words) - b + 1):
                # a block that ends a window allows no skip, one at the segment's start ends no window yet
                key, skip = tuple(words[at : at + b]), 0 if at >= last else last - at
                if skip < shift.get(key, self.most):
                    shift[key] = skip
            for at in range(n):
                key, place = (*words[at + last : at + length], *words[at : at + b]), k << 32 | at
                held = self.buckets.setdefault(key, place)
                if isinstance(held, list):
                    held.append(place)
                elif held != place:
                    self.buckets[key] = [held, place]

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set]]:
        """(start, item ids) of every occurrence."""
        n, size, b, most, shift, buckets = len(words), self.length, self.block, self.most, self.shift.get, self.buckets.get
        at = size - 1
        while at < n:
            block = tuple(words[at - b + 1 : at + 1])
            skip = shift(block, most)
            if skip:
                at += skip
                continue
            start = at - size + 1
            places = buckets((*block, *words[start : start + b]))
            if places is not None:
                found = set()
                for place in places if isinstance(places, list) else (places,):
                    item, held = self.segments[place >> 32]
                    first = place & 0xFFFFFFFF
                    if item not in found and words[start : at + 1] == held[first : first + size]:
                        found.add(item)
                if found:
                    yield start, found
            at += 1


def matchers_of(segments: Iterable[tuple[object, list[bytes]]], window: int = WINDOW) -> list[WuManber]:
    """A matcher for each length of windows. segments: (item id, words)."""
    one: dict[bytes, bytes] = {}  # equal words share one object
    by: dict[int, list[tuple[str | None, list[bytes]]]] = {}
    for item_id, words in segments:
        if words:
            by.setdefault(min(window, len(words)), []).append((None if item_id is None else str(item_id), [one.setdefault(w, w) for w in words]))
    return [WuManber(size, found) for size, found in sorted(by.items())]


def matchers(items: Iterable[tuple[object, str | None]], window: int = WINDOW) -> list[WuManber]:
    """matchers_of() the whole texts of items (item id, text)."""
    return matchers_of(((k, words_of((text or "").encode())) for k, text in items), window)


def segments_of(items: DataFrame, window: int = WINDOW, most: int = SEGMENT) -> DataFrame:
    """(item, words, windows) of items (item, text): cut where an item has more than ``most`` windows."""
    low = F.translate(F.col("text"), string.ascii_uppercase, string.ascii_lowercase)
    words = items.select("item", F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)).alias("all")).where(F.size("all") > 0)
    whole = F.greatest(F.lit(1), F.size("all") - (window - 1))
    cut = words.select("item", "all", F.explode(F.sequence(F.lit(0), whole - 1, F.lit(most))).alias("at"), whole.alias("whole"))
    own = F.least(F.lit(most), F.col("whole") - F.col("at"))
    return cut.select("item", F.slice("all", F.col("at") + 1, own + window - 1).alias("words"), own.cast("long").alias("windows"))


def _marker(held):
    @F.arrow_udf(_STATE)
    def mark(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        search = held.value
        for texts, before in batches:
            rows = []
            for text, old in zip(texts.cast(pa.binary()), before, strict=True):
                words = words_of(text.as_py() or b"")
                old = old.as_py() or {}
                hits, items = old.get("hits"), set(old.get("items") or ())
                for m in search:
                    for start, ids in m.search(words):
                        if hits is None:
                            hits = bytearray(len(words))
                        elif isinstance(hits, bytes):
                            hits = bytearray(hits)
                        hits[start : start + m.length] = b"\1" * m.length
                        items |= ids
                rows.append({"n_words": len(words), "hits": None if hits is None else bytes(hits), "items": sorted(items - {None})})
            yield pa.array(rows, type=pa.struct([("n_words", pa.int64()), ("hits", pa.binary()), ("items", pa.list_(pa.string()))]))

    return mark


def mark_contamination(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS, out: str = "contamination"
) -> DataFrame:
    """docs with ``out``: struct(n_words, hits: a byte a word (null: none), items: sorted ids)."""
    spark = docs.sparkSession
    items = segments_of(benchmark.select(F.col(item_id).alias("item"), F.col(item_text).cast("string").alias("text")), window, min(SEGMENT, block_windows))
    # repeated texts make windows of their own: they may have other ids
    size = items.agg(F.sum("windows")).first()[0] or 0
    blocks = max(1, math.ceil(size / block_windows))
    state = free_name(docs, "__state")
    df = docs.withColumn(state, F.lit(None).cast(_STATE))
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("words", "item"), F.lit(blocks)) == k) if blocks > 1 else items
        held = spark.sparkContext.broadcast(matchers_of(((r.item, [w.encode() for w in r.words]) for r in part.toLocalIterator()), window))
        df = df.withColumn(state, _marker(held)(F.col(text).cast("string"), F.col(state)))
        if blocks > 1:
            df = durable(df)
    if any(c.lower() == out.lower() for c in docs.columns):
        df = df.drop(out)
    return df.withColumnRenamed(state, out)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = mark_contamination(docs, load(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("contamination.n_words").alias("n_words"),
        _n_hits(F.col("contamination.hits")).alias("n_hit"),
        F.size("contamination.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("contamination.items", ",").cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.col("n_hit") > 0)


def _n_hits(hits):
    """Count of 01 bytes: as text, each is one character that translate() removes."""
    return F.when(hits.isNull(), F.lit(0)).otherwise(F.octet_length(hits) - F.octet_length(F.translate(hits.cast("string"), "\1", ""))).cast("long")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents without a word inside an occurrence of a benchmark window; columns as given."""
    out = free_name(docs, "__contamination")
    return mark_contamination(docs, benchmark, out=out, **options).where(F.col(f"{out}.hits").isNull()).drop(out)


#: Window containment, counted in SQL over whole tables: every occurrence by an equi-join on the
#: window's text, every hit word once.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
bl AS (SELECT item_id, w, least(10, len(w)) size FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, size, array_to_string(w[p:p + size - 1], ' ') win FROM (SELECT item_id, w, size, unnest(generate_series(1, len(w) - size + 1)) p FROM bl)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') win FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) p FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT dw.doc_id, dw.p, dw.size, bw.item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win),
hw AS (SELECT doc_id, count(DISTINCT q) n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + size - 1)) q FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
  sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN hi ON d.doc_id = hi.doc_id
"""
