"""Secret scan: candidates by rule, false positives removed by a random forest.

A candidate is a run of 16 or more of ``[A-Za-z0-9+/=_-]`` with a digit and a letter or of at least 16
digits, the quoted value of an assignment (``name = "value"``) of 6 to 512 without white space, or the
unquoted value of 6 or more of an assignment to a secret's name (``password=value``). Runs and unquoted
values of over 512 are judged in pieces of 512, the last with a tail of under 16; a secret across two pieces is judged in two.
Features: length; character transitions (switches between digit, lower, upper and other, mean
log-probability of its letter pairs under the corpus's dictionary words, entropy); dictionary
coverage (share of characters inside dictionary words of 4 or more letters); path (hash bucket of
``path``); neighbouring words (whether the words before name a secret, an example or a hash, whether an
assignment or quote stands before, hash buckets of the words before and after).

The forest (``pyspark.ml``) is trained from all labelled findings: a table (value, before, after, path, label).
Where a corpus has none, ``examples`` makes
them: credentials of many shapes and what is mistaken for them (digests, ids, numbers, names, paths,
placeholders), each in contexts of its kind. Their labels come from how they are made and not from any feature.

The dictionary is every word of 4 to 16 letters beside the labelled findings and beside all candidates, so
that it speaks the corpus's languages. It is a table at any size: the letter runs inside candidates meet it in a join, and
each candidate brings the words found in it. Only the counts of letter pairs, bounded by the square of the alphabet, are broadcast.

Every candidate is returned with its score and ``is_secret``. Defined cases: null text has no candidates;
labelled rows that are all alike score every candidate as that label (none: 0); equal candidates get
equal scores; repeated rows are scanned each; texts are scanned whole, in linear time; columns of the findings named
``score`` or ``is_secret`` (in any case) are replaced, all others stay.
"""

from __future__ import annotations

import math
import random
import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.llm.common import durable, free_name, load

EXAMPLES, BUCKETS = 6_000, 8
#: Training rows a partition.
ROWS = 20_000
TREES, DEPTH, SEED, CUTOFF = 20, 6, 7, 0.5

_RUN = re.compile(r"[A-Za-z0-9+/=_-]{16,}")
_ASSIGNED = re.compile(r"[\"']([^\s\"']{6,512})[\"']")
_BARE = re.compile(
    r"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth(?!ors?\b))[\w-]{0,64}[\"']?\]?[ \t]{0,8}[=:](?!=)[ \t]{0,8}"
    r"((?!=)(?:(?!&\w{1,64}=)[^\s\"',;()\[\]{}<>]){6,})",
    re.I,
)
_NAME = re.compile(r"(token|secret|passw(or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)", re.I)
_HASH = re.compile(r"(sha1|sha256|md5|commit|digest|checksum|uuid|hash)", re.I)
_FAKE = re.compile(r"(example|sample|dummy|placeholder|changeme|xxxx|0000|your[_-])", re.I)
_WORD = re.compile(r"[^\W\d_]{4,16}")
_LETTERS = re.compile(r"[^\W\d_]{4,}")

_FINDING = T.ArrayType(
    T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("value", T.StringType()), T.StructField("before", T.StringType()), T.StructField("after", T.StringType())])
)
_ARROW_FINDING = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("before", pa.string()), ("after", pa.string())]))


def _pieces(start: int, end: int) -> Iterator[tuple[int, int]]:
    """start to end in pieces of 512, so that all of it is judged; a tail too short for a candidate joins the last."""
    while end - start >= 512 + 16:
        yield start, start + 512
        start += 512
    yield start, end


def _judged(run: str) -> bool:
    return len(run) >= 16 and any(map(str.isdigit, run)) and (any(map(str.isalpha, run)) or sum(map(str.isdigit, run)) >= 16)


def find(text: str) -> list[tuple[int, int]]:
    """Candidate spans (code points), by start, without overlaps: assignments before runs."""
    spans = []
    if '"' in text or "'" in text:
        for m in _ASSIGNED.finditer(text):
            if text[max(0, m.start() - 3) : m.start()].rstrip()[-1:] in ("=", ":"):
                spans.append(m.span(1))
    quoted, k = list(spans), 0
    for m in _BARE.finditer(text):
        while k < len(quoted) and quoted[k][1] <= m.start(1):
            k += 1
        if k == len(quoted) or quoted[k][0] >= m.end(1):
            spans += _pieces(*m.span(1))
    taken, k = sorted(spans), 0
    for m in _RUN.finditer(text):
        at = m.start()
        while k < len(taken) and taken[k][1] <= at:
            k += 1
        gaps, j = [], k
        while j < len(taken) and taken[j][0] < m.end():  # what assignments leave of the run
            gaps.append((at, taken[j][0]))
            at, j = taken[j][1], j + 1
        for start, end in [*gaps, (at, m.end())]:
            if _judged(text[start:end]):
                spans += _pieces(start, end)
    return sorted(spans)


def _near(text: str, start: int, end: int) -> tuple[str, str]:
    """Up to three pieces before (with what is glued on) and two after, within 80 characters."""
    return " ".join(text[max(0, start - 80) : start].split()[-3:]), " ".join(text[end : end + 80].split()[:2])


@F.arrow_udf(_FINDING)
def _findings(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        rows = []
        for text in texts:
            text, own = text.as_py() or "", []
            for s, e in find(text):
                before, after = _near(text, s, e)
                own.append({"start": s, "end": e, "value": text[s:e], "before": before, "after": after})
            rows.append(own)
        yield pa.array(rows, type=_ARROW_FINDING)


def findings(docs: DataFrame, *, key: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """(key, start, end, value, before, after, path) of every candidate."""
    own = F.col(path).cast("string") if path else F.lit(None).cast("string")
    return docs.select(F.col(key), own.alias("path"), F.explode(_findings(F.col(text).cast("string"))).alias("f")).select(key, "f.*", "path")


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def features(value: str, before: str, after: str, path: str, dictionary: frozenset, pairs: dict[str, float], floor: float) -> list[float]:
    low, n = value.lower(), max(1, len(value))
    switches = sum(_kind(a) != _kind(b) for a, b in zip(value, value[1:], strict=False))
    letters = [low[k : k + 2] for k in range(len(low) - 1) if low[k : k + 2].isalpha()]
    likely = sum(pairs.get(p, floor) for p in letters) / len(letters) if letters else floor
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    covered, at = 0, 0
    while at < len(low):  # longest dictionary word first
        size = next((k for k in range(min(16, len(low) - at), 3, -1) if low[at : at + k] in dictionary), 0)
        covered += size
        at += size or 1
    words = before.split()
    return [
        float(len(value)),
        switches / n,
        likely,
        entropy,
        covered / n,
        sum(map(str.isdigit, value)) / n,
        float(zlib.crc32(path.encode()) % BUCKETS),
        float(bool(_NAME.search(before))),
        float(bool(_HASH.search(before))),
        float(bool(_FAKE.search(value) or _FAKE.search(before))),
        float(any(x in before[-4:] for x in "=:")),
        float(before[-1:] in ("'", '"')),
        float(zlib.crc32(words[-1].lower().encode()) % BUCKETS) if words else -1.0,
        float(zlib.crc32(after.split()[0].lower().encode()) % BUCKETS) if after.split() else -1.0,
    ]


def _featurizer(held):
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def make(values: pa.Array, befores: pa.Array, afters: pa.Array, paths: pa.Array, knowns: pa.Array) -> pa.Array:
        pairs, floor = held.value
        columns = (x.to_pylist() for x in (values, befores, afters, paths, knowns))
        rows = [features(v or "", b or "", a or "", p or "", frozenset(k or ()), pairs, floor) for v, b, a, p, k in zip(*columns, strict=True)]
        return pa.array(rows, type=pa.list_(pa.float64()))

    return make


@F.arrow_udf(T.ArrayType(T.StringType()))
def _beside(befores: pa.Array, afters: pa.Array) -> pa.Array:
    """The different words of 4 to 16 letters around a finding."""
    return pa.array([sorted(set(_WORD.findall(f"{b} {a}".lower()))) for b, a in zip(befores.to_pylist(), afters.to_pylist(), strict=True)], type=pa.list_(pa.string()))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _inside(values: pa.Array) -> pa.Array:
    """What of a value could be a dictionary word: the different pieces of 4 to 16 letters."""
    out = []
    for v in values.to_pylist():
        runs = _LETTERS.findall((v or "").lower())
        out.append(sorted({x[k : k + n] for x in runs for k in range(len(x) - 3) for n in range(4, min(16, len(x) - k) + 1)}))
    return pa.array(out, type=pa.list_(pa.string()))


def labelled_findings(found: DataFrame) -> DataFrame:
    """Weak labels by rule for a corpus of its own: found with label (1 secret, 0 not) where a rule is sure. Not what the query trains on."""
    value, before = F.col("value"), F.col("before")
    named = before.rlike(rf"(?i){_NAME.pattern}[\w\]\"']*\s*[=:]\s*[\"']?$")
    fake = value.rlike(rf"(?i){_FAKE.pattern}") | before.rlike(rf"(?i){_FAKE.pattern}")
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.length(value) >= 12)
    plain = value.rlike(r"^[0-9 -]+$") | value.rlike("^[A-Za-z]+$") | before.rlike(rf"(?i){_HASH.pattern}[\w]*\s*[=:]?\s*[\"']?$")
    label = F.when(fake | (plain & ~named), 0.0).when(named & mixed, 1.0).when(~named & value.rlike("[a-z]{4,}"), 0.0)
    return found.withColumn("label", label).where("label is not null")


_HEX, _ALNUM = "0123456789abcdef", string.ascii_letters + string.digits


def examples(count: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, str, str, str, float]]:
    """Labelled findings (value, before, after, path, label) made by rule, half of them credentials."""
    r = random.Random(seed)
    some = lambda alphabet, *sizes: "".join(r.choices(alphabet, k=r.choice(sizes)))
    prose = lambda n: " ".join(some("etaoinshrdlu", 2, 3, 5, 8) for _ in range(n))
    word = lambda: some("etaoinshrdlucm", 4, 5, 7, 9)

    def credential() -> tuple[str, str]:
        value = r.choice(
            [
                lambda: some(_HEX, 32, 40, 64),
                lambda: some(_ALNUM + "-_", 20, 32, 43, 64),
                lambda: some(_ALNUM + "+/", 22, 40, 86) + r.choice(["", "=", "=="]),
                lambda: some(string.ascii_lowercase, 2, 3, 4) + r.choice("_-") + some(_ALNUM, 24, 36, 40),
                lambda: some(string.ascii_uppercase, 4) + some(string.ascii_uppercase + string.digits, 16),
                lambda: some(_ALNUM + "!#%&*?", 8, 10, 14),
                lambda: word().capitalize() + some(string.digits, 2, 4) + r.choice("!#*?_"),
            ]
        )()
        name = r.choice(["", "db_", "my", "client_", word() + "_"]) + r.choice(["token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "auth_token", "private_key", "credential", "secret_key"])
        name = r.choice([name, name.upper()])
        return value, r.choice([f'{name} = "', f"{name} = '", f'{name}: "', f'"{name}": "', f"export {name}=", f"{name}=", f"--{name} ", f"{name}: ", "Authorization: Bearer "])

    def mistaken() -> tuple[str, str]:
        digest = lambda: (some(_HEX, 32, 40, 64), r.choice(["commit ", "sha256: ", "md5 = ", 'checksum: "', 'digest = "', "rev ", 'etag: "', "tree ", "index ", prose(1) + " "]))
        number = lambda: (some(string.digits, 16, 18, 24), r.choice(["", "order ", "no. ", "id: ", "at "]))
        uuid = lambda: ("-".join(some(_HEX, n) for n in (8, 4, 4, 4, 12)), r.choice(["uuid: ", 'id = "', "", "node ", 'request_id: "']))
        name = lambda: (r.choice("_-/").join(word() for _ in range(4)) + some(string.digits, 1, 2), r.choice(["import ", "call ", 'name = "', "", 'path: "', "see "]))
        fake = lambda: (r.choice(["your-token-here", "changeme", "example-key-123", "x" * 16 + "1", "<" + word() + ">", "test" + some(string.digits, 3), "0" * 20]), r.choice(['token = "', "password: ", 'api_key = "', "secret="]))
        value = lambda: (word() + r.choice(["", "-", ".", "_"]) + word(), r.choice(['name = "', 'title: "', 'type = "', 'lang: "', 'label = "']))
        code = lambda: (r.choice(["get", "load", "read"]) + word().capitalize() + word().capitalize(), r.choice(["token = ", "secret: ", "password = ", "auth="]))
        return r.choice([digest, number, uuid, name, fake, value, code])()

    rows = []
    for k in range(count):
        value, own = credential() if k % 2 else mistaken()
        close = own[-1] if own[-1:] in ("'", '"') else ""
        rows.append((value, " ".join(f"{prose(3)} {own}".split()[-3:]), " ".join(f"{close} {prose(2)}".split()[:2]), f"{word()}/{word()}", float(k % 2)))
    return rows


def labelled_examples(spark: SparkSession, count: int = EXAMPLES, seed: int = SEED) -> DataFrame:
    return spark.createDataFrame(examples(count, seed), "value string, before string, after string, path string, label double")


def language(beside: DataFrame) -> tuple[DataFrame, dict[str, float], float]:
    """(word) of all words beside rows (before, after), the log-probability of their letter pairs, and that of an unseen pair."""
    words = durable(beside.select(F.explode(_beside("before", "after")).alias("word")).distinct())
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.substr("word", k, F.lit(2)))).alias("pair"))
    counts = {r.pair: r["count"] for r in pairs.groupBy("pair").count().collect()}  # at most the square of the alphabet
    total = sum(counts.values()) + 676
    return words, {p: math.log((c + 1) / total) for p, c in counts.items()}, math.log(1 / total)


def with_known(found: DataFrame, words: DataFrame, name: str) -> DataFrame:
    """found with a column of the dictionary words inside value (null: none)."""
    key = free_name(found, "__key")
    of = F.unhex(F.md5(F.col("value").cast("binary")))
    parts = found.select("value").distinct().select(of.alias(key), F.explode(_inside("value")).alias("word"))
    known = parts.join(words, "word", "left_semi").groupBy(key).agg(F.collect_list("word").alias(name))
    return found.withColumn(key, of).join(known, key, "left").drop(key)


def score(found: DataFrame, labelled: DataFrame, *, trees: int = TREES, depth: int = DEPTH, cutoff: float = CUTOFF) -> DataFrame:
    """found with score and is_secret, by a forest trained on labelled (value, before, after, path, label)."""
    spark = found.sparkSession
    kept = [c for c in found.columns if c.lower() not in ("score", "is_secret")]
    found = found.select(*kept)
    columns = ["value", "before", "after", "path", "label"]
    rows = durable(labelled.where("label is not null").select(*columns).distinct())
    sides = rows.agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).first()
    if sides.low == sides.high:
        alone = float(sides.high or 0.0)
        return found.withColumn("score", F.lit(alone)).withColumn("is_secret", F.lit(alone >= cutoff))
    words, *pairs = language(rows.select("before", "after").unionByName(found.select("before", "after").distinct()))
    make, known = _featurizer(spark.sparkContext.broadcast(tuple(pairs))), free_name(found, "__known")
    inputs = ["value", "before", "after", "path"]
    train = with_known(rows, words, known).select(*columns, F.col("label").cast("double").alias("y"), make(*inputs, known).alias("x"))
    # the rows alone decide where a row stands, so that the forest is the same for any partitioning of the input
    train = durable(train.repartition(math.ceil(sides.n / ROWS), *columns).sortWithinPartitions(F.xxhash64(*columns), *columns).select(F.col("y").alias("label"), "x"))
    train = train.select("label", array_to_vector("x").alias("features"))
    names = {n: free_name(found, f"__{n}") for n in ("features", "prediction", "probability", "rawPrediction")}
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, subsamplingRate=0.8).fit(train)
    model = model.setFeaturesCol(names["features"]).setPredictionCol(names["prediction"]).setProbabilityCol(names["probability"]).setRawPredictionCol(names["rawPrediction"])
    scored = model.transform(with_known(found, words, known).withColumn(names["features"], array_to_vector(make(*inputs, known))))
    out = scored.withColumn("score", F.round(F.element_at(vector_to_array(names["probability"]), 2), 9)).withColumn("is_secret", F.col("score") >= cutoff)
    return out.select(*kept, "score", "is_secret")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = durable(findings(load(spark, sf_dir, "documents").select("doc_id", "text", "source")))
    scored = score(found, labelled_examples(spark))
    return scored.select("doc_id", "start", "end", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), "score", "is_secret")
