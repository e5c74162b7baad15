"""Personal data: base rules per kind, and contextual extraction bootstrapped from what they find.

Base spans (leftmost, non-overlapping per kind, failing matches dropped without retry): email, ip
(parts at most 255), card (12 to 19 digits passing Luhn), phone (9 to 15 digits). Offsets are code
points, ends exclusive.

Bootstrapping. Seed instances are the base entities and key-shaped candidates: 32, 40 or 64 hexadecimal
digits with a letter and a digit among them. Every mention of a seed or of an identifier-shaped candidate (6
to 64 of ``[A-Za-z0-9_-]`` with a digit, touching no base span) gives two lexical patterns: the lower-cased
word before it, and the two words before it, where words are runs without white space of at most ``WORD``
code points (a longer one makes no pattern). Spark aggregates (pattern, instance) edges, counts how often
each pattern's slot occurs over all words of the corpus, and then scores the graph in rounds: a pattern's
confidence is the score-weighted share of its slots that instances fill, an instance's score is the
noisy-or of its patterns (1 for seeds). Patterns of at least ``support`` distinct scored instances and
confidence ``confidence`` are high; candidates in their slots become spans of kind ``identifier``, be they
seeds or not. Base spans always stay.

Only patterns with ``support`` instances and a candidate, which alone can find something, are
counted; they go to the tasks in blocks of ``block`` patterns of at most 2 ``WORD`` + 1 code points, so memory is
bounded in bytes for any corpus.

Defined cases: null text is empty; empty tables give no rows; texts are scanned whole and in linear
time, whatever their length; ties need no order, as all patterns at the bound are high; repeated rows are scanned one by
one; an existing column named like ``out`` is replaced, all others stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.llm.common import durable, free_name, load

KINDS = ("email", "ip", "card", "phone", "identifier")
SUPPORT, CONFIDENCE, ROUNDS = 3, 0.5, 3
#: Patterns that one pass holds in each worker.
BLOCK = 200_000
#: Code points of the longest word that a pattern is made of.
WORD = 64

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DIGIT_ON = re.compile(r"[0-9][A-Za-z0-9_-]*")
_WORDS = re.compile(r"\S+")
_KEY = re.compile(r"(?=.*[0-9])(?=.*[A-Fa-f])(?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64})")
_HEAD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_-")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)

_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_MENTIONS = T.ArrayType(T.StructType([T.StructField("pattern", T.StringType()), T.StructField("value", T.StringType()), T.StructField("seed", T.BooleanType()), T.StructField("candidate", T.BooleanType())]))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        total += _DOUBLED[int(c)] if k & 1 else int(c)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index in KINDS, end), sorted."""
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        if m := _DOMAIN.match(text, at):
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                done = m.end()
                found.append((start, 0, done))
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255 for part in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    found.sort()
    return found


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Identifier-shaped pieces that touch no base span, by start. base: by start, of any overlap."""
    covered: list[list[int]] = []
    for s, _, e in base:
        if covered and s <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    done, k = 0, 0
    for m in _DIGIT_ON.finditer(text):
        start, end = m.span()
        if start < done:
            continue
        while start > done and text[start - 1] in _HEAD:
            start -= 1
        done = end
        if not 6 <= end - start <= 64:
            continue
        while k < len(covered) and covered[k][1] <= start:
            k += 1
        if k == len(covered) or covered[k][0] >= end:
            yield start, end


def contexts(text: str, spans: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, patterns) of spans by start: the word and the two words before the white-space-delimited token at start, lower-cased.

    The words are walked once for all spans.
    """
    words, before = _WORDS.finditer(text), [None, None]
    word = next(words, None)
    for start, end in spans:
        while word is not None and word.end() <= start:
            before = [before[1], word]
            word = next(words, None)
        near = [w[0].lower() if w is not None and w.end() - w.start() <= WORD else None for w in before]
        yield start, end, [] if near[1] is None else [near[1]] if near[0] is None else [near[1], f"{near[0]} {near[1]}"]


def mentions(text: str) -> Iterator[tuple[str, str, bool, bool]]:
    """(pattern, value, whether a seed, whether a candidate) of every base span and candidate."""
    base = base_spans(text)
    for s, e, patterns in contexts(text, ((s, e) for s, _, e in base)):
        yield from ((p, text[s:e], True, False) for p in patterns)
    for s, e, patterns in contexts(text, candidates(text, base)):
        if patterns:
            seed = _KEY.fullmatch(text, s, e) is not None
            yield from ((p, text[s:e], seed, True) for p in patterns)


@F.arrow_udf(_MENTIONS)
def _mentions(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("pattern", pa.string()), ("value", pa.string()), ("seed", pa.bool_()), ("candidate", pa.bool_())]))
    for texts in batches:
        rows = [[{"pattern": p, "value": v, "seed": x, "candidate": c} for p, v, x, c in mentions(text.as_py() or "")] for text in texts]
        yield pa.array(rows, type=kind)


def _slot_counter(held):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = held.value
        total: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                words = (text.as_py() or "").lower().split()
                if len(words) > 1:
                    seen = Counter(words)
                    seen[words[-1]] -= 1  # a slot is the word after
                    for w in seen.keys() & one:
                        total[w] += seen[w]
                    if two:
                        for pair in zip(words, words[1:-1], strict=False):
                            if pair in two:
                                total[" ".join(pair)] += 1
        if total:
            yield pa.RecordBatch.from_pydict({"pattern": list(total), "n": pa.array(total.values(), pa.int64())})

    return count


def _shared(spark: SparkSession, patterns: list[str]):
    return spark.sparkContext.broadcast((frozenset(p for p in patterns if " " not in p), frozenset(tuple(p.split(" ")) for p in patterns if " " in p)))


def high_patterns(texts: DataFrame, *, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """Patterns (pattern, confidence) of a one-column table of texts."""
    spark = texts.sparkSession
    edges = texts.select(F.explode(_mentions(F.col(texts.columns[0]).cast("string"))).alias("m")).groupBy("m.pattern", "m.value").agg(F.max("m.seed").alias("seed"), F.max("m.candidate").alias("candidate"), F.count("*").alias("n"))
    edges = durable(edges)
    able = edges.groupBy("pattern").agg(F.count("*").alias("instances"), F.bool_or("candidate").alias("open")).where((F.col("instances") >= support) & F.col("open")).select("pattern")
    edges = durable(edges.join(able, "pattern"))
    able = edges.select("pattern").distinct()
    # without a seed in any such pattern no score ever leaves zero
    if not edges.where("seed").head(1):
        return spark.createDataFrame([], "pattern string, confidence double")
    blocks = max(1, math.ceil(able.count() / block))
    totals = None
    for k in range(blocks):
        part = able.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == k)
        held = _shared(spark, [r.pattern for r in part.toLocalIterator()])
        counted = texts.select(F.col(texts.columns[0]).cast("string").alias("text")).mapInArrow(_slot_counter(held), "pattern string, n long")
        totals = counted if totals is None else totals.unionByName(counted)
    totals = durable(totals.groupBy("pattern").agg(F.sum("n").alias("slots")))
    scored = edges.withColumn("score", F.col("seed").cast("double"))
    for _ in range(rounds):
        patterns = (
            scored.groupBy("pattern")
            .agg(F.sum(F.col("n") * F.col("score")).alias("mass"), F.count_if(F.col("score") >= confidence).alias("backed"))
            .join(totals, "pattern")
            .select("pattern", F.when(F.col("backed") >= support, F.least(F.lit(1.0), F.col("mass") / F.greatest("slots", F.lit(1)))).otherwise(0.0).alias("confidence"))
        )
        patterns = durable(patterns)
        instances = edges.join(patterns, "pattern").groupBy("value").agg(F.max("seed").alias("is_seed"), F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999999)))).alias("miss"))
        scored = durable(edges.join(instances.select("value", F.when(F.col("is_seed"), 1.0).otherwise(1 - F.exp("miss")).alias("score")), "value"))
    return patterns.where(F.col("confidence") >= confidence)


def _finder(held):
    @F.arrow_udf(T.ArrayType(_SPAN))
    def find(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        one, two = held.value
        for texts, before in batches:
            rows = []
            for text, old in zip(texts, before, strict=True):
                text = text.as_py() or ""
                base = base_spans(text)
                spans = set(base)
                for x in old.as_py() or ():
                    spans.add((x["start"], KINDS.index(x["kind"]), x["end"]))
                if one or two:
                    for s, e, left in contexts(text, candidates(text, base)):
                        if left and (left[0] in one or len(left) > 1 and tuple(left[1].split(" ")) in two):
                            spans.add((s, 4, e))
                rows.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(spans)])
            yield pa.array(rows, type=_ARROW_SPANS)

    return find


def find_personal_data(docs: DataFrame, *, text: str = "text", out: str = "personal", block: int = BLOCK, **options) -> DataFrame:
    """docs with ``out``: array of struct(kind, start, end) by start, then kind as in KINDS."""
    spark = docs.sparkSession
    high = high_patterns(docs.select(F.col(text).alias("text")), block=block, **options).select("pattern")
    blocks = max(1, math.ceil(high.count() / block))
    spans = free_name(docs, "__spans")
    df = docs.withColumn(spans, F.lit(None).cast(T.ArrayType(_SPAN)))
    for k in range(blocks):
        part = high.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == k)
        df = df.withColumn(spans, _finder(_shared(spark, [r.pattern for r in part.toLocalIterator()]))(F.col(text).cast("string"), F.col(spans)))
        if blocks > 1:
            df = durable(df)
    if any(c.lower() == out.lower() for c in docs.columns):
        df = df.drop(out)
    return df.withColumnRenamed(spans, out)


@F.arrow_udf(T.StringType())
def redacted(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Each text with every span as <KIND>; spans that overlap become one, of the first's kind."""
    rows = []
    for text, found in zip(texts, spans, strict=True):
        text, pieces, at = text.as_py(), [], 0
        merged: list[list] = []
        for x in found.as_py() or ():
            if merged and x["start"] < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], x["end"])
            else:
                merged.append([x["start"], x["end"], x["kind"]])
        if text is not None and merged:
            for s, e, kind in merged:
                pieces += [text[at:s], f"<{kind.upper()}>"]
                at = e
            text = "".join([*pieces, text[at:]])
        rows.append(text)
    return pa.array(rows, type=pa.string())


def redact(docs: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """docs, columns as given, with personal data in ``text`` replaced; null texts stay null."""
    out = free_name(docs, "__personal")
    return find_personal_data(docs, text=text, out=out, **options).withColumn(text, redacted(F.col(text).cast("string"), F.col(out))).drop(out)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(load(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("personal", lambda x: x["kind"] != KINDS[4])

    def count(kind: str):
        return F.size(F.filter("personal", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    return found.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("personal")).alias("spans"))
