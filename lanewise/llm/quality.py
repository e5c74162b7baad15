"""Quality rules: fixed text rules, and a hashed n-gram log-likelihood ratio against the raw corpus.

Native throughout: DataFrame functions only. Words are runs of ``[^\\x20\\x09-\\x0D]``.

Model. Unigrams and bigrams of tokens (words, with trailing runs of symbols apart) are hashed into ``buckets``. Two multinomials are counted: the raw corpus
over all documents, and the trusted target over all documents that the labels call good and not
toxic, both with add-``smoothing`` counts, and each bucket weighs the rounded log ratio in
millionths of a nat. A document's score is the sum of its n-grams' weights over their number; it is
kept if base rules hold and score >= ``threshold``. Unless one is given, the threshold is learnt from every labelled
document by cross-fitting: documents fall into ``HELD`` folds (by hash of the id), and each is scored with the weights whose
target lacks its fold. Among the cuts that keep ``KEEP`` of the
good ones that pass the base rules, the one that parts good from bad best is taken, in the middle between its
neighbours' scores; without good or without bad ones it is ``THRESHOLD``. Weights are integers, so neither the order of
rows nor the partitioning can change a verdict. The model has ``buckets`` weights at any corpus size (``HELD`` + 1 times as many while the
threshold is learnt) and reaches the tasks as the value of a scalar subquery. Labels meet documents in shuffled joins, so nothing
that grows with the corpus is broadcast.

Repeated three-word windows are found by hash in the row itself; only texts whose windows are not
all different are sorted (n log n), so there is no shuffle and no quadratic step.

Defined cases: null and empty texts have no words and fail the base rules; without labelled
documents the weights are 0 and the model keeps everything; labels that repeat or disagree about a
document count as trusted if any row says so; repeated documents are judged one by one; clashing
output columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.common import SPACE, durable, free_name, load

BUCKETS, SMOOTHING, SCALE = 1 << 14, 1.0, 1_000_000
#: Mean nats a n-gram below which a document is unlike the target, where no labels tell.
THRESHOLD = -0.4
#: Folds of the labelled documents, each scored without its own part of the target for the threshold; the share of good ones to keep.
HELD, KEEP = 5, 0.995
MIN_WORDS, MOST_REPEATED = 50, 50
_SYMBOLS = "#*$%&|<>!=@~^"
RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_ADDED = (*RULES, "base_failed", "score", "kept")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def tokens_of(text: Column) -> Column:
    """The model's tokens: words, with a run of symbols after a word cut off as a token of its own."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), rf"{SPACE}|(?<=[^\x20\x09-\x0D{_SYMBOLS}])(?=[{_SYMBOLS}])", -1), "")


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _windows(words: Column) -> Column:
    return F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column) -> Column:
    """Words inside windows (by hash, in order) that occur twice or more."""

    def repeated(ordered: Column) -> Column:
        same = lambda x, k: F.get(ordered, k)["hash"] == x["hash"]
        return F.transform(F.filter(ordered, lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False))), lambda x: x["at"])

    ordered = F.sort_array(F.transform(windows, lambda x, k: F.struct(x.alias("hash"), k.alias("at"))))
    starts = F.sort_array(_let(ordered, repeated))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    return F.aggregate(starts, zero, lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n"), x.alias("last")), lambda acc: acc["n"])


def _rule_columns(text: Column, words: Column, windows: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.size(F.split(text, r"[#*$%&|<>]", -1)) - 1).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(_covered(windows)),
    }


def _failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _features(words: Column, buckets: int) -> Column:
    """Bucket of each unigram and bigram: 2n - 1 of them. words: a plain column, as lambdas read it per element."""
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    two = F.when(F.size(words) >= 2, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.pmod(F.xxhash64(F.get(words, i - 1), F.get(words, i)), F.lit(buckets)).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.concat(one, two)


def weights(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, smoothing: float = SMOOTHING, held_out: bool = False) -> DataFrame:
    """One row: w, the integer weight of each bucket, from counts over all documents; held_out: behind them those of each fold, whose target lacks it."""
    folds = HELD if held_out else 1
    trusted = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col(key).alias("__key")).distinct().withColumn("__trusted", F.lit(1))
    # shuffled, as the ids grow with the labels
    marked = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text")).join(trusted.hint("shuffle_hash"), "__key", "left")
    seen = (
        marked.select(F.when(F.col("__trusted").isNotNull(), _fold(F.col("__key"), folds)).alias("__fold"), tokens_of(F.col("__text")).alias("__words"))
        .select("__fold", F.explode(_features(F.col("__words"), buckets)).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.array(*[F.count_if(F.col("__fold") == k) for k in range(folds)]).alias("own"))
    )
    unseen = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("raw"), F.array_repeat(F.lit(0).cast("long"), folds).alias("own"))
    counts = seen.unionByName(unseen).groupBy("bucket").agg(F.sum("raw").alias("raw"), *[F.sum(F.col("own")[k]).alias(f"own{k}") for k in range(folds)])
    counts = counts.withColumn("target", sum((F.col(f"own{k}") for k in range(1, folds)), F.col("own0")))
    models = ["target", *[f"target{k}" for k in range(folds) if held_out]]
    counts = counts.select("bucket", "raw", "target", *[(F.col("target") - F.col(f"own{k}")).alias(f"target{k}") for k in range(folds)])
    packed = counts.groupBy().agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", *models))).alias("d"), F.sum("raw").alias("raw_sum"), *[F.sum(m).alias(f"{m}_sum") for m in models])
    spread = F.lit(buckets * smoothing)

    def logs(m: str) -> Column:
        ratio = lambda x: F.log((x[m] + smoothing) / (F.col(f"{m}_sum") + spread)) - F.log((x["raw"] + smoothing) / (F.col("raw_sum") + spread))
        return F.transform("d", lambda x: F.when(F.col(f"{m}_sum") > 0, F.round(ratio(x) * SCALE)).otherwise(0).cast("long"))

    return packed.select(F.concat(*map(logs, models)).alias("w"))


def _fold(key: Column, folds: int = HELD) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(folds)).cast("int")


def _is_held(key: Column, fold: int = 0) -> Column:
    return _fold(key) == fold


def _scored(docs: DataFrame, model: DataFrame, text: str, buckets: int, key: str | None = None, held: str = "__held_score") -> DataFrame:
    """docs with the base rules' columns, base_failed and score; key: and held, the score by the weights without the row's fold. model: one row w."""
    words, tokens, feats, windows, size, w, sums = (free_name(docs, x) for x in ("__words", "__tokens", "__features", "__windows", "__size", "__weights", "__sums"))
    t = F.col(text).cast("string")
    df = docs.withColumns({words: words_of(t), tokens: tokens_of(t)})
    df = df.withColumns({feats: _features(F.col(tokens), buckets), windows: _windows(F.col(words))})
    df = df.withColumns(_rule_columns(F.coalesce(t, F.lit("")), F.col(words), F.col(windows)) | {size: F.size(feats)}).drop(words, tokens, windows)
    # the optimizer puts the subquery where w is used, as that is in one place, so that no row holds the weights
    starts = F.array(F.lit(0), *([(_fold(F.col(key)) + 1) * buckets] if key else []))
    total = lambda at: F.aggregate(feats, F.lit(0).cast("long"), lambda acc, b: acc + F.get(F.col(w), b + at))
    df = df.withColumn(w, model.scalar()).withColumn(sums, F.transform(starts, total)).drop(feats, w)
    mean = lambda k: F.when(F.col(size) > 0, F.get(sums, F.lit(k)) / F.col(size)).otherwise(0.0)
    df = df.withColumns({"score": mean(0)} | ({held: mean(1)} if key else {}))
    return df.withColumn("base_failed", _failed()).drop(size, sums)


def best_cut(bins: list[tuple[int, int, int]], keep: float = KEEP) -> float | None:
    """The cut between bins (k: scores from k up to k + 1, good, bad) that parts best; None without good or bad ones."""
    bins = sorted(bins)
    good, bad = sum(g for _, g, _ in bins), sum(b for *_, b in bins)
    if not good or not bad:
        return None
    best, cut, lost, gone = -1.0, None, 0, 0
    for k, (at, g, b) in enumerate(bins):  # what lies below this bin goes
        if good - lost >= keep * good and (part := (good - lost) / good + gone / bad) > best:
            best, cut = part, (bins[k - 1][0] + 1 + at) / 2 if k else float(at)
        lost, gone = lost + g, gone + b
    return cut


def _known(labels: DataFrame, key: str) -> DataFrame:
    """(__key, __good) of every labelled document."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return labels.where("quality is not null").groupBy(F.col(key).alias("__key")).agg(F.max(good).alias("__good"))


def _cut(known: DataFrame, held: str = "__held_score") -> float:
    """Mean nats a n-gram from rows (base_failed, held, __good), in steps of a hundredth."""
    # exploded, as a filter or an aggregate above would be pushed below the projections that hold the words
    passed = known.select(F.explode(F.when(~F.col("base_failed"), F.array(F.struct(F.floor(F.col(held) / (SCALE / 100)).alias("at"), F.col("__good").alias("good"))))).alias("x")).select("x.*")
    bins = passed.groupBy("at").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).collect()  # a row a hundredth of a nat
    cut = best_cut([(r["at"], r.good, r.bad) for r in bins])
    return THRESHOLD if cut is None else cut / 100


def learnt_threshold(docs: DataFrame, labels: DataFrame, model: DataFrame, *, key: str, text: str, buckets: int) -> float:
    """The cut over every labelled document, each scored by the weights without its fold. model: of held_out weights."""
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(_known(labels, key).hint("shuffle_hash"), "__key")
    return _cut(_scored(rows, model, "__text", buckets, "__key"))


def judge(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float | None = None, buckets: int = BUCKETS, smoothing: float = SMOOTHING, columns: list[str] | None = None
) -> DataFrame:
    """docs (or these columns of it) with the base rules' columns, score (millionths of a nat a n-gram) and kept.

    With columns, rows are scored once and held without the text while the threshold is learnt; else labelled ones are scored twice.
    """
    model = durable(weights(docs, labels, key=key, text=text, buckets=buckets, smoothing=smoothing, held_out=threshold is None))
    once = threshold is None and columns is not None
    if threshold is None and not once:
        threshold = learnt_threshold(docs, labels, model, key=key, text=text, buckets=buckets)
    given = [c for c in (docs.columns if columns is None else columns) if c.lower() not in _ADDED]
    own, held = free_name(docs, "__key"), free_name(docs, "__held_score")
    df = _scored(docs.withColumn(own, F.col(key)), model, text, buckets, own if once else None, held)
    if once:
        df = durable(df.select(*given, *RULES, "base_failed", "score", own, held))
        threshold = _cut(df.join(_known(labels, key).withColumnRenamed("__key", own), own), held)
    return df.select(*given, *RULES, "base_failed", "score").withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold * SCALE))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "labels"), columns=["doc_id"])
    return judged.select("doc_id", *RULES, "base_failed", "kept", "score")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that judge() keeps; columns as given."""
    held = free_name(docs, "__row")
    text, key = options.get("text", "text"), options.get("key", "doc_id")
    judged = judge(docs.select(F.struct("*").alias(held), F.col(key), F.col(text)), labels, **options)
    # a filter would be pushed below the projections that hold the words, and compute them an element at a time
    return judged.select(F.explode(F.when(F.col("kept"), F.array(held))).alias(held)).select(f"{held}.*")
