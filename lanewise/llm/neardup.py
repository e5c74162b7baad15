"""Near-duplicates by Order MinHash, verified by banded alignment.

Words are runs of ``[^\\x20\\x09-\\x0D]``, lower-cased; a document is its sequence of five-word shingles
(fewer words, but some: one shingle). Two texts are linked if, with L the longest common subsequence of
their shingle sequences of A and B shingles, L / (A + B - L) >= 0.8: Jaccard similarity that also
respects order. Equal texts always share a class. Classes are the connected components.

Sketch. For each of several random orders, the ``l`` smallest shingles, labelled by occurrence, are put
back into text order and hashed to one key, which makes keys sensitive to edits and not only to sets. Texts
of more than 80 shingles have 24 keys of l = 6, texts below 64 have 24 of l = 4, those between have
both, so any two texts that can be linked share a family. A pair at exactly 0.8 shares a key with
probability 0.99 to 0.999; the miss falls below 1e-5 at 0.9. No bucket is capped.

Linking without all pairs, by one rule for buckets of every size. Each bucket first tests its members only
against its leader (the member whose buckets are largest, so that buckets agree on it). Members of one
component need no further test, as more links could not change a class. Buckets that still hold several
components test the members outside their largest component against one member of it, which differs by
bucket; a bucket of n costs n tests in either round. All members of buckets that hold several components
after that meet in an exact prefix join on their rarest shingles, which finds every pair that can reach
0.8. A component never meets itself in it: for each shingle, members outside the component that has it
most often meet the others, so a group of N with one outlier makes N rows. Shingles that only
one component has take no part. No link that matters to a class is lost.

Tests put the text of the endpoint with many pairs (a leader) under several keys, ``CHUNK`` pairs each, so no task
holds all pairs of a large group.

Alignment is a bit-parallel LCS in a band: similarity 0.8 allows at most (A + B) / 9 insertions and
deletions, so cells further from the diagonals cannot matter and the decision is exact. Only positions inside
the band become bits, so a pair of n words takes memory in proportion to n and n^2 / 64 bit operations at most.

Defined cases: a null text is a class of its own with class_id = its id; texts without words are
linked to equal texts only; repeated rows and ids are fine (an id per row is returned); a class's id
is its smallest non-null document id; very long texts are sketched and aligned whole; ties between leaders
go by id; other columns, whatever their names, are not read; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.llm.common import discard, durable, free_name, load, small_batches, written

WORDS = 5
LONG, SHORT = (24, 6), (24, 4)
SHORT_ONLY, LONG_ONLY = 63, 80
_MEMO = 100_000

_SKETCH = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType()))])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Lower-cased words; only the six ASCII white-space characters separate."""
    text = text.lower()
    return text.split() if text.isascii() and not _OTHER.search(text) else _WORD.findall(text)


#: What split() would also part at, in ASCII texts.
_OTHER = re.compile("[\x1c-\x1f]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode())
        return value


_HASHES = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each shingle, in text order."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    k = min(WORDS, len(words))
    out = h[: len(words) - k + 1].copy()
    for j in range(1, k):
        out = _mix(out) + h[j : len(words) - k + 1 + j]
    return _mix(out)


def _seeds(count: int, salt: int) -> np.ndarray:
    return _mix((np.arange(1, count + 1, dtype=np.uint64) + np.uint64(salt)) * _ODD)


_FAMILIES = {f: _seeds(f[0], 1000 * f[1]) for f in (LONG, SHORT)}
_BYTES = 1 << 22
_PLACES = _mix(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)
#: Pairs and join rows that one key of a hot text or shingle serves.
CHUNK = 256
#: From so many positions on, a shingle's places are held as a bit set of their own.
DENSE = 64
#: Up to so many edges between components are joined in one task.
SMALL = 200_000


def labelled(s: np.ndarray) -> np.ndarray:
    """The shingles, told apart by how often they came before."""
    ordered = np.sort(s)
    if not (ordered[1:] == ordered[:-1]).any():
        return s
    n, order = len(s), np.argsort(s, kind="stable")
    again = s[order][1:] == s[order][:-1]
    run = np.arange(n) - np.maximum.accumulate(np.where(np.concatenate([[True], ~again]), np.arange(n), 0))
    occurrence = np.empty(n, np.uint64)
    occurrence[order] = run
    return np.where(occurrence == 0, s, _mix(s + occurrence * _ODD))


def order_min_hashes(s: np.ndarray, family: tuple[int, int]) -> list[int]:
    """The family's keys of a shingle sequence."""
    count, size = family
    n, marked = len(s), labelled(s)
    size, out = min(size, n), []
    step = max(1, _BYTES // (8 * n))
    # a hash's low bits make room for the position, so selecting values selects places
    bits = np.uint64(max(20, n.bit_length()))
    places = np.arange(n, dtype=np.uint64)
    for at in range(0, count, step):
        seeds = _FAMILIES[family][at : at + step]
        x = (marked[None, :] ^ seeds[:, None]) * _ODD
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x >>= bits
        x <<= bits
        x |= places
        if size < n:
            x = np.partition(x, size - 1, axis=1)[:, :size]
        chosen = np.sort(x & ((np.uint64(1) << bits) - np.uint64(1)), axis=1).astype(np.int64)
        key = (s[chosen] * _PLACES[:size]).sum(axis=1, dtype=np.uint64)
        out += _mix(key ^ (seeds + np.uint64(n if n < 4 else 0))).view(np.int64).tolist()
    return out


@F.arrow_udf(_SKETCH)
def _sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        sizes, keys = [], []
        for text in texts:
            s = shingles(words_of(text.as_py() or ""))
            n = len(s)
            sizes.append(n)
            own: list[int] = []
            if 0 < n <= LONG_ONLY:
                own += order_min_hashes(s, SHORT)
            if n > SHORT_ONLY:
                own += order_min_hashes(s, LONG)
            keys.append(own)
        yield pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["n", "keys"])


def similar(a: list[int], b: list[int]) -> bool:
    """Whether the common subsequence L of a and b has 9 L >= 4 (A + B)."""
    need = 4 * (len(a) + len(b))
    low = 0
    most = min(len(a), len(b))
    if 9 * most < need:
        return False
    while low < most and a[low] == b[low]:
        low += 1
    high = 0
    while high < most - low and a[-1 - high] == b[-1 - high]:
        high += 1
    apart = (len(a) + len(b)) // 9
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    return 9 * (low + high + band_lcs(a, b, apart)) >= need


def band_lcs(a: list[int], b: list[int], apart: int) -> int:
    """Longest common subsequence of a and b if they are at most ``apart`` insertions and deletions apart."""
    na, nb = len(a), len(b)
    if not na or not nb:
        return 0
    where: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        where.setdefault(x, []).append(i)
    dense: dict[int, list[int]] = {}  # of frequent shingles: bits from a start on, that start, positions taken in
    shift = na - nb
    first, last = -((apart - shift) // 2), (apart + shift) // 2
    start = end = zeros = 0
    row = 0
    for j, y in enumerate(b):
        s, e = min(na, max(0, j + first)), min(na, max(0, j + last + 1))
        if s > start:
            gone = min(s, end) - start
            zeros += gone - (row & ((1 << gone) - 1)).bit_count()
            row >>= s - start
            start, end = s, max(end, s)
        if e > end:
            row |= ((1 << (e - end)) - 1) << (end - start)
            end = e
        places = where.get(y)
        if not places:
            continue
        if len(places) < DENSE:
            hits = 0
            for p in places:
                if start <= p < end:
                    hits |= 1 << (p - start)
        else:
            held = dense.setdefault(y, [0, 0, 0])
            hits, n = held[0] >> (start - held[1]), held[2]
            while n < len(places) and places[n] < end:
                if places[n] >= start:
                    hits |= 1 << (places[n] - start)
                n += 1
            held[:] = hits, start, n
        if u := row & hits:
            row = ((row + u) | (row - u)) & ((1 << (end - start)) - 1)
    return zeros + (end - start) - row.bit_count()


@F.arrow_udf(T.BooleanType())
def _similar(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The left texts come in runs, so the last one is kept split."""
    text, left = None, []
    for lefts, rights in batches:
        out = []
        for x, y in zip(lefts, rights, strict=True):
            x = x.as_py()
            if x != text:
                text, left = x, shingles(words_of(x)).tolist()
            out.append(similar(left, shingles(words_of(y.as_py())).tolist()))
        yield pa.array(out, type=pa.bool_())


@F.arrow_udf(T.ArrayType(T.LongType()))
def _marked(texts: pa.Array) -> pa.Array:
    return pa.array([labelled(shingles(words_of(t.as_py()))).view(np.int64).tolist() for t in texts], type=pa.list_(pa.int64()))


def node_of(text: Column) -> Column:
    """16 bytes that stand for a text; null for null."""
    return F.unhex(F.md5(text.cast("binary")))


def _salted(node: Column, salt: Column) -> Column:
    """A text's key: the node itself for salt 0, else the node with the salt behind it."""
    return F.when(salt > 0, F.concat(node, F.unhex(F.lpad(F.hex(salt), 8, "0")))).otherwise(node)


def _tested(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar. texts: (node, text), a row a node."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.ceil(F.count("*") / CHUNK).alias("keys"))
    hot = durable(ends.where("keys > 1"))
    keyed = texts.select(F.col("node").alias("key"), "text").unionByName(
        texts.join(hot, "node").select(F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.col("keys") - 1), lambda k: _salted(F.col("node"), k))).alias("key"), "text")
    )
    for side in "ab":
        pairs = pairs.join(hot.select(F.col("node").alias(side), F.col("keys").alias(f"keys{side}")), side, "left").withColumn(f"keys{side}", F.coalesce(f"keys{side}", F.lit(1)))
    swap = F.expr("keysa > keysb")
    hub, member = F.when(swap, F.col("a")).otherwise(F.col("b")), F.when(swap, F.col("b")).otherwise(F.col("a"))
    dealt = pairs.select("a", "b", member.alias("member"), _salted(hub, F.pmod(F.xxhash64(member), F.greatest("keysa", "keysb"))).alias("hub"))
    one = dealt.join(keyed.select(F.col("key").alias("member"), F.col("text").alias("right")), "member")
    both = one.join(keyed.select(F.col("key").alias("hub"), F.col("text").alias("left")), "hub")
    return durable(both.where(_similar("left", "right")).select("a", "b"))


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all edges (a, b) of the task: (node, root), root the smallest node."""
    up: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        top = x
        while (above := up.setdefault(top, top)) != top:
            top = above
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            low, high = sorted((root(a), root(b)))
            up[high] = low
    if up:
        yield pa.RecordBatch.from_pydict({"node": pa.array(list(up), pa.binary()), "root": pa.array([root(x) for x in up], pa.binary())})


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, root) of a round of hooking, the edges left between roots).

    Each node hooks to its smallest neighbour. The only cycles are of two nodes, whose smaller one
    is the root, so at most half of the nodes are roots. Pointers are then doubled to the roots.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hook = durable(both.groupBy("a").agg(F.min("b").alias("up")).withColumnRenamed("a", "node"))
    first = True
    while True:
        above = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
        cycle = F.col("top") == F.col("node")
        to = F.when(cycle, F.least("node", "up")).otherwise(F.col("up" if first else "top"))
        step = durable(hook.join(above, "up").select("node", to.alias("to"), (to != F.col("up")).alias("moved")))
        hook = step.select("node", F.col("to").alias("up"))
        if not first and not step.where("moved").head(1):
            break
        first = False
    roots = hook.withColumnRenamed("up", "root")
    for side in "ab":
        edges = edges.join(roots.select(F.col("node").alias(side), "root"), side).drop(side).withColumnRenamed("root", side)
    return roots, durable(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def components(links: DataFrame, *, small: int = SMALL) -> DataFrame:
    """(node, root) of every linked node; root is one of the component's nodes.

    Rounds of contraction, each at least halving the nodes, until at most ``small`` edges are left;
    one task then ends the work, of a size that does not depend on the input.
    """
    edges, layers = links.select("a", "b"), []
    while edges.count() > small:
        roots, edges = _contracted(edges)
        layers.append(roots)
    found = durable(edges.coalesce(1).mapInArrow(_rooted, "node binary, root binary"))
    for roots in reversed(layers):
        found = durable(roots.join(found.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root")))
    return found


def _prefixes(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, n, root, at, s): the shingles of each member that a pair of 0.8 can rest on.

    members: (node, n, root). With all shingles ordered by how many members have them, texts of A and
    B shingles with C = ceil(4 (A + B) / 9) in common share one among the first A - C + 1 of the one
    and the first B - C + 1 of the other. Shingles that a large group has in common come last.
    """
    each = durable(members.join(texts, "node").select("node", "n", "root", F.explode(_marked("text")).alias("s")))
    ranked = each.join(each.groupBy("s").agg(F.count("*").alias("df")), "s").groupBy("node", "n", "root").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("all"))
    first = ranked.select("node", "n", "root", F.posexplode(F.expr("slice(all, 1, n - ceil(0.8D * n - 1e-9D) + 1)")).alias("at", "x"))
    return durable(first.where("x.df > 1").select("node", "n", "root", "at", F.col("x.s").alias("s")))


def _met(first: DataFrame) -> DataFrame:
    """Rows of first that share s, of different roots: those outside the root that has s most often with all others.

    Shingles of a single root are left out before anything meets; a frequent one is dealt to several keys.
    """
    by_root = first.groupBy("s", "root").agg(F.count("*").alias("c"))
    shared = by_root.groupBy("s").agg(F.max(F.struct("c", "root")).alias("most"), F.sum("c").alias("all"), F.count("*").alias("roots"))
    shared = shared.where("roots > 1").select("s", F.col("most.root").alias("major"), F.ceil(F.col("all") / CHUNK).alias("keys"))
    held = durable(first.join(shared, "s"))
    left, right = (held.select("s", "major", "keys", *[F.col(c).alias(c + side) for c in ("node", "n", "root", "at")]) for side in "ab")
    left = left.where("roota != major").select("s", "nodea", "na", "roota", "ata", F.explode(F.sequence(F.lit(0).cast("long"), F.col("keys") - 1)).alias("key"))
    right = right.select("s", "nodeb", "nb", "rootb", "atb", F.pmod(F.xxhash64("nodeb"), "keys").alias("key"))
    return left.join(right, ["s", "key"])


def _prefix_pairs(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b), a < b, of different roots that can be similar: an exact join by rare shingles."""
    common = "ceil(4 * (na + nb) / 9D - 1e-9D)"
    fits = F.expr(f"roota != rootb and ata <= na - {common} and atb <= nb - {common}")
    return _met(_prefixes(members, texts)).where(fits & _sizes_fit("na", "nb")).select(F.least("nodea", "nodeb").alias("a"), F.greatest("nodea", "nodeb").alias("b")).distinct()


def _sizes_fit(a: str, b: str) -> Column:
    return 9 * F.least(a, b) >= 4 * (F.col(a) + F.col(b))


def classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, node, class_id, head) of every row; head: whether the row has its class's id and text."""
    with small_batches(docs.sparkSession):
        return _classes(docs, key, text)


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) once links (a, b) between nodes of different components are added."""
    for side in "ab":
        links = links.join(roots.select(F.col("node").alias(side), "root"), side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
    links = durable(links.where("a != b").distinct())
    if not links.head(1):
        return roots
    top = components(links)
    own = top.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return durable(roots.unionByName(top.join(roots, "node", "left_anti")).join(own, "root", "left").select("node", F.coalesce("top", "root").alias("root")))


def _placed(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, n, root, bucket, members) of buckets that hold several components."""
    at = shared.join(roots, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"), F.explode("at").alias("at")).select("node", "n", "root", "at.*")
    mixed = at.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("bucket")
    return durable(at.join(mixed, "bucket"))


def _outsiders(placed: DataFrame) -> DataFrame:
    """(a, b): in each bucket, who is outside its largest component with one of it, chosen by hash and so not alike in all buckets."""
    by_root = placed.groupBy("bucket", "root").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("node", "bucket").alias("h"), "node", "n")).alias("one"))
    major = by_root.groupBy("bucket").agg(F.max(F.struct("c", "root", "one")).alias("m")).select("bucket", F.col("m.root").alias("major"), F.col("m.one.node").alias("one"), F.col("m.one.n").alias("m"))
    apart = placed.join(major, "bucket").where(F.expr("root != major") & _sizes_fit("n", "m"))
    return apart.select(F.least("node", "one").alias("a"), F.greatest("node", "one").alias("b")).distinct()


def _classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    t = F.col(text).cast("string")
    rows = durable(docs.select(F.col(key).alias("id"), node_of(t).alias("node"), _sketch(t).alias("s")))
    nodes = durable(rows.where("node is not null").groupBy("node").agg(F.min("id").alias("first"), F.any_value("s").alias("s")))
    bands = nodes.where("s.n > 0").select("node", "first", F.col("s.n").alias("n"), F.explode("s.keys").alias("bucket"))
    buckets = bands.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    # a row a node that shares a bucket; at most 48 buckets each
    shared = durable(bands.join(buckets, "bucket").groupBy("node", "first", "n").agg(F.collect_list(F.struct("bucket", "members")).alias("at"), F.sum("members").alias("weight")))
    # the leader is who shares most: the centre of a group, so that buckets agree on it
    spread = shared.select("node", "n", "weight", F.explode("at.bucket").alias("bucket"))
    leaders = spread.groupBy("bucket").agg(F.max(F.struct("weight", "node", "n")).alias("l")).select("bucket", F.col("l.node").alias("lead"), F.col("l.n").alias("m"))
    lead = durable(spread.join(leaders, "bucket").where(F.expr("node != lead") & _sizes_fit("n", "m")).select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct())
    # id and text together are the key of this join, so copies of one text do not meet in one task
    source = docs.select(F.xxhash64(F.col(key)).alias("at"), node_of(t).alias("node"), t.alias("text")).where("node is not null")
    wanted = shared.select("node", F.xxhash64("first").alias("at"))
    texts = written(source.join(wanted, ["node", "at"]).groupBy("node", "at").agg(F.any_value("text").alias("text")).select("node", "text"), "texts")
    roots = components(_tested(lead, texts))
    placed = _placed(shared, roots)
    if placed.head(1):
        more = durable(_outsiders(placed).join(lead, ["a", "b"], "left_anti"))
        roots = _joined(roots, _tested(more, texts))
        # two members of a bucket have met by now
        many = durable(_placed(shared, roots).where("members > 2").select("node", "n", "root").distinct())
        if many.head(1):
            tried = lead.unionByName(more)
            roots = _joined(roots, _tested(durable(_prefix_pairs(many, texts).join(tried, ["a", "b"], "left_anti")), texts))
    named = nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = named.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), F.col("first"), F.col("node"))).alias("h"))
    of = durable(named.join(heads, "root").select("node", F.col("h.first").alias("class_id"), (F.col("h.node") == F.col("node")).alias("has_head")))
    discard(texts)
    known = rows.select("id", "node").join(of, "node", "left")
    alone = F.col("node").isNull()
    return known.select(
        F.col("id").alias(key),
        "node",
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        (alone | (F.col("has_head") & F.col("id").eqNullSafe(F.col("class_id")))).alias("head"),
    )


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id")


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class (the smallest id; of repeated rows one); null texts stay."""
    found = classes(docs, key=key, text=text).where("head and node is not null").groupBy("node").agg(F.min("class_id").alias("id"), F.count("*").alias("copies"))
    row, node = free_name(docs, "__row"), "node"
    kept = docs.select(F.struct("*").alias(row), F.col(key).alias("own"), node_of(F.col(text).cast("string")).alias(node))
    heads = kept.join(durable(found), node).where(F.col("own").eqNullSafe(F.col("id")))
    single = heads.where("copies = 1").select(row)
    repeated = heads.where("copies > 1").groupBy(node).agg(F.any_value(row).alias(row)).select(row)
    return single.unionByName(repeated).unionByName(kept.where("node is null").select(row)).select(f"{row}.*")
