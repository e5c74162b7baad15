"""Corpus sources: each gives (id, name, desc, tags, code, source); rows without code are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.operators.corpus import SIGNATURES, header_record, join_passes, parse_tags
from lanewise.operators.corpus import stripped as _strip

_FENCE = r"(?s)```(?:glsl|c|cpp)?\s*(.*?)```"
CODE_FIELDS = ("common", "image", "buffer_a", "buffer_b", "buffer_c", "buffer_d", "sound")


def _fenced(text: Column) -> Column:
    return _strip(F.when(text.rlike(_FENCE), F.regexp_extract(text, _FENCE, 1)).otherwise(text))


def _shape(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    base = {"id": F.lit(None).cast("string"), "name": F.lit("untitled"), "desc": F.lit(""), "tags": F.array().cast("array<string>")} | columns
    return df.select(*[c.alias(n) for n, c in base.items()], F.lit(source).alias("source")).where("code is not null and code != ''")


def many_fields(spark: SparkSession, path: str, source: str, fields: tuple[str, ...] = CODE_FIELDS) -> DataFrame:
    """JSON lines whose code is spread over fields; malformed lines are skipped."""
    shape = "id string, title string, description string, tags string, " + ", ".join(f"`{f}` string" for f in fields)
    rows = spark.read.schema(shape).option("mode", "DROPMALFORMED").json(path)
    parts = F.filter(F.array(*map(F.col, fields)), lambda x: x.isNotNull() & (_strip(x) != ""))
    return _shape(rows, source, id=F.col("id"), name=F.coalesce("title", F.lit("untitled")), desc=F.coalesce("description", F.lit("")), tags=parse_tags(F.col("tags")), code=F.array_join(parts, "\n\n"))


def chat_lines(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Chat JSON lines: the first user text describes, the first assistant text without thoughts is code."""
    rows = spark.read.schema("messages array<struct<role:string,content:string>>").option("mode", "DROPMALFORMED").json(path)
    said = lambda role: F.coalesce(F.get(F.filter("messages", lambda m: m["role"] == role), F.lit(0))["content"], F.lit(""))
    code = _fenced(F.regexp_replace(said("assistant"), r"(?s)<think>.*?</think>", ""))
    sid = F.regexp_extract(code, r"//\s*ID:\s*([A-Za-z0-9]+)", 1)
    title = _strip(F.regexp_extract(code, r"//\s*(?:Shadertoy|Shader|Title):\s*(.+)", 1))
    user = said("user")
    name = F.when(title != "", title).when(user != "", F.left(user, F.lit(60))).otherwise("untitled")
    return _shape(rows, source, id=F.when(sid != "", sid), name=name, desc=_strip(user), code=code)


def described(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Parquet of code and description; the name is the first sentence, up to 60 characters."""
    rows = spark.read.parquet(path).select("code", "description")
    first = F.left(F.trim(F.split_part(F.coalesce("description", F.lit("")), F.lit("."), F.lit(1))), F.lit(60))
    return _shape(rows, source, name=F.when(first != "", first).otherwise("untitled"), desc=F.coalesce("description", F.lit("")), code=F.col("code"))


def chat_parquet(spark: SparkSession, path: str, source: str, column: str = "messages") -> DataFrame:
    """Parquet whose messages, in whatever nesting, hold a fence."""
    rows = spark.read.parquet(path)
    kind = dict(rows.dtypes)[column]
    text = F.col(column) if kind == "string" else F.replace(F.replace(F.to_json(column), F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"'))
    return _shape(rows.where(text.rlike(_FENCE)), source, code=_fenced(text))


def is_language(code: Column, language: str, mode: str = "all") -> Column:
    """Whether code is long enough and shows the language's signature; mode 'fragment' asks for a fragment shader."""
    fragment = mode == "fragment" and language == "glsl"
    shown = (F.length(code) >= 80) & code.rlike("mainImage|gl_FragColor|gl_FragCoord" if fragment else SIGNATURES.get(language, ""))
    return shown & ~code.rlike(r"ShaderLab|UNITY_|#pragma surface|UnityObject") if language == "glsl" else shown


def code_parquet(spark: SparkSession, path: str, language: str, mode: str = "all", source: str | None = None) -> DataFrame:
    """Code files of one language by its signature; mode 'fragment' keeps fragment shaders only."""
    rows = spark.read.parquet(path).select("content", "max_stars_repo_path")  # two columns reach the scan
    code, keep = F.col("content"), is_language(F.col("content"), language, mode)
    stem = F.left(F.regexp_replace(F.element_at(F.split("max_stars_repo_path", "/"), -1), r"\.[^.]*$", ""), F.lit(60))
    return _shape(rows.where(keep), source or f"thestack-{language}", name=F.when(stem != "", stem).otherwise("untitled"), code=code)


def text_files(spark: SparkSession, path: str, source: str, pattern: str = "*") -> DataFrame:
    """A file a row, folders included; the id is the file's name up to its first dot."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    name = F.split_part(F.col("_metadata.file_name"), F.lit("."), F.lit(1))
    return _shape(rows.select("value", name.alias("stem")), source, id=F.col("stem"), name=F.col("stem"), code=F.col("value"))


def api_records(spark: SparkSession, path: str, known: DataFrame | None = None, *, min_likes: int = 0, min_length: int = 40) -> DataFrame:
    """(file, code, record, hash) of a folder of program JSON files, the first file by name of each code.

    Code is the passes in order, its hash the SHA-1 of its bytes. Left out: malformed files, programs with
    fewer likes, codes that are short or in ``known`` (a column text).
    """
    shape = "info struct<name:string,description:string,tags:array<string>,likes:int>, renderpass array<struct<type:string,code:string>>"
    rows = spark.read.schema(shape).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    code = join_passes(F.coalesce("renderpass", F.array().cast("array<struct<type:string,code:string>>")))
    made = rows.where(F.coalesce("info.likes", F.lit(0)) >= min_likes).select(F.col("_metadata.file_name").alias("file"), "info", code.alias("code"))
    made = made.select("file", "code", header_record(F.col("info.name"), F.col("info.description"), F.col("info.tags"), F.col("code")).alias("record"), F.sha1(F.col("code").cast("binary")).alias("hash"))
    made = made.where(F.col("record").isNotNull() & (F.length("code") >= min_length))
    if known is not None:
        made = made.join(known.select(F.sha1(F.col("text").cast("binary")).alias("hash")), "hash", "left_anti")
    first = made.groupBy("hash").agg(F.min_by(F.struct("file", "code", "record"), "file").alias("r"))
    return first.select("r.*", "hash")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(file, metric, value) of JSON files of one flat object each; values that are no numbers are left out."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", "map<string,string>").alias("m"))
    return rows.select("file", F.explode("m").alias("metric", "text")).select("file", "metric", F.expr("try_cast(text as double)").alias("value")).where("value is not null")


def in_order(*sources: DataFrame) -> DataFrame:
    """The sources one after the other, with seq: a total order in which earlier ones win."""
    out = None
    for k, df in enumerate(sources):
        own = df.withColumn("seq", F.monotonically_increasing_id() + F.lit(k << 52))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def write_corpus(split: DataFrame, path: str) -> None:
    """train text with end marks, train and val JSON lines, and one line of statistics."""
    train = split.where("not is_val")
    by_source = F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "n"))))
    counts = split.groupBy("source").agg(F.count("*").alias("n"), F.count_if("is_val").alias("v"), F.sum(F.length("record")).alias("c"))
    stats = counts.agg(F.sum("n").alias("kept"), by_source.alias("by_source"), F.sum(F.col("n") - F.col("v")).alias("train"), F.sum("v").alias("val"), F.sum("c").alias("chars"), F.round(F.sum("c") / 3.7).cast("long").alias("est_tokens"))
    stats.coalesce(1).write.json(f"{path}/stats.json")  # a row
    train.select(F.concat("record", F.lit("<|endoftext|>")).alias("value")).write.text(f"{path}/corpus.txt")
    for name, rows in (("train", train), ("val", split.where("is_val"))):
        rows.select("prompt", "code", "name", "source", "id").write.json(f"{path}/{name}.jsonl")
