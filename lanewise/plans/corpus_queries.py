"""Corpus queries: code is a document's text; an entry point is any sentence with 'the' or 'de'."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanewise.operators import corpus as co
from lanewise.plans.registry import query, table

_ENTRY = r"\bthe\b|\bde\b|\bder\b"
_RSN = f"r AS (SELECT doc_id, text, source, lang, CASE WHEN length(text) < 60 THEN 'thin' WHEN NOT regexp_matches(text, '{_ENTRY}') THEN 'no_entry' END reason FROM documents)"
_SQ = "trim(regexp_replace(text, '[\\x09-\\x0D\\x20\\x1C-\\x1F]+', ' ', 'g'), ' ')"
_KEPT = f"{_RSN}, h AS (SELECT *, sha1({_SQ}) hash FROM r WHERE reason IS NULL), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id) rn FROM h) WHERE rn = 1)"


def reasons(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.col("doc_id").alias("id"), F.col("text").alias("code"), "source", "lang")
    return co.reason(rows, entry=F.col("code").rlike(_ENTRY))


def hashed(spark, d):
    return reasons(spark, d).where("reason is null").withColumn("hash", co.code_hash(F.col("code")))


def kept(spark, d):
    return co.dedup(hashed(spark, d))


@query(f"WITH {_RSN} SELECT coalesce(reason, 'ok') reason, count(*) n FROM r GROUP BY 1")
def corpus_filter_reason(spark, d):
    return reasons(spark, d).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, sha1({_SQ}) hash FROM documents")
def corpus_norm_sha1(spark, d):
    return table(spark, d, "documents").select("doc_id", co.code_hash(F.col("text")).alias("hash"))


@query(f"WITH {_KEPT} SELECT doc_id, hash FROM k")
def corpus_dedup(spark, d):
    return kept(spark, d).select(F.col("id").alias("doc_id"), "hash")


_NAMED = f"{_KEPT}, s AS (SELECT doc_id, source, sha1(CAST(doc_id AS VARCHAR) || source) split_key FROM k), v AS (SELECT *, row_number() OVER (ORDER BY split_key, doc_id) <= (SELECT floor(count(*) * 0.02) FROM k) is_val FROM s)"


@query(f"WITH {_NAMED} SELECT doc_id, split_key, is_val FROM v")
def corpus_split(spark, d):
    return co.deterministic_split(kept(spark, d).withColumn("name", F.col("source")), 0.02).select(F.col("id").alias("doc_id"), "split_key", "is_val")


@query(f"""WITH {_KEPT} SELECT (SELECT count(*) FROM k) kept, (SELECT count(*) FROM h) - (SELECT count(*) FROM k) dup, (SELECT count(*) FROM r WHERE reason = 'thin') thin, (SELECT count(*) FROM r WHERE reason = 'no_entry') no_entry,
(SELECT CAST(sum(length(text)) AS BIGINT) FROM k) chars, (SELECT CAST(round(sum(length(text)) / 3.7::DOUBLE) AS BIGINT) FROM k) est_tokens""")
def corpus_stats(spark, d):
    rows = reasons(spark, d)
    held = hashed(spark, d)
    counted = rows.agg(F.count_if(F.col("reason") == "thin").alias("thin"), F.count_if(F.col("reason") == "no_entry").alias("no_entry"), F.count_if(F.col("reason").isNull()).alias("ok"))
    own = co.dedup(held).agg(F.count("*").alias("kept"), F.sum(F.length("code")).alias("chars"))
    both = own.select("*", *[counted.select(c).scalar().alias(c) for c in ("thin", "no_entry", "ok")])  # scalars of one row
    return both.select("kept", (F.col("ok") - F.col("kept")).alias("dup"), "thin", "no_entry", "chars", F.round(F.col("chars") / 3.7).cast("long").alias("est_tokens"))


@query(f"WITH {_KEPT} SELECT source, count(*) n FROM k GROUP BY source")
def corpus_by_source(spark, d):
    return kept(spark, d).groupBy("source").agg(F.count("*").alias("n"))


@query(r"""WITH x AS (SELECT doc_id, source, lang, text, regexp_replace(text, '^[\x09-\x0D\x20\x1C-\x1F]+|[\x09-\x0D\x20\x1C-\x1F]+$', '', 'g') s FROM documents),
p AS (SELECT doc_id, text, '// Shader: ' || left(source, 120) || chr(10) || CASE WHEN s = '' THEN '' ELSE '// ' || left(split_part(s, chr(10), 1), 200) || chr(10) END || '// tags: ' || left(lang || ', ' || source, 200) || chr(10) prompt FROM x)
SELECT doc_id, sha1(prompt) prompt_sha1, CAST(length(prompt || regexp_replace(text, '[\x09-\x0D\x20\x1C-\x1F]+$', '') || chr(10)) AS BIGINT) record_chars FROM p""")
def corpus_records(spark, d):
    docs = table(spark, d, "documents")
    record, prompt = co.record_of(F.col("source"), F.col("text"), F.array("lang", "source"), F.col("text"))
    return docs.select("doc_id", F.sha1(prompt.cast("binary")).alias("prompt_sha1"), F.length(record).cast("long").alias("record_chars"))


_UNION = "u AS (SELECT 'documents' source, doc_id id, text code, 0 s FROM documents UNION ALL SELECT 'benchmark', item_id, text, 1 FROM benchmark UNION ALL SELECT 'pages', page_id, html, 2 FROM pages)"


def union(spark, d):
    docs = table(spark, d, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), F.col("text").alias("code"))
    bench = table(spark, d, "benchmark").select(F.lit("benchmark").alias("source"), F.col("item_id").alias("id"), F.col("text").alias("code"))
    pages = table(spark, d, "pages").select(F.lit("pages").alias("source"), F.col("page_id").alias("id"), F.col("html").alias("code"))
    return docs.unionByName(bench).unionByName(pages)


@query(f"WITH {_UNION} SELECT source, count(*) n, CAST(sum(length(code)) AS BIGINT) chars, count(DISTINCT sha1(code)) n_distinct FROM u GROUP BY source")
def corpus_source_union(spark, d):
    return union(spark, d).withColumn("h", F.sha1(F.col("code").cast("binary"))).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("code")).alias("chars"), F.countDistinct("h").alias("n_distinct"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE sha1(b.text) = sha1(d.text))")
def seed_antijoin_benchmark(spark, d):
    seeds = table(spark, d, "benchmark").select(F.sha1(F.col("text").cast("binary")).alias("h")).distinct()
    return table(spark, d, "documents").withColumn("h", F.sha1(F.col("text").cast("binary"))).join(seeds, "h", "left_anti").select("doc_id")


@query("""SELECT conv_id, arg_min(text, turn) FILTER (WHERE "role" = 'user') "user", arg_min(text, turn) FILTER (WHERE "role" = 'assistant') assistant FROM conversations GROUP BY conv_id""")
def chat_first_turns(spark, d):
    return co.first_turns(table(spark, d, "conversations"))


@query("SELECT r_name || ' | ' || n_name || ' | ' || p_type prompt FROM region, nation, (SELECT DISTINCT p_type FROM part) ORDER BY 1")
def prompt_product(spark, d):
    # three dimension tables of fixed size: the product is their list of combinations
    a, b, c = table(spark, d, "region").select("r_name"), table(spark, d, "nation").select("n_name"), table(spark, d, "part").select("p_type").distinct()
    return a.crossJoin(b).crossJoin(c).select(F.concat_ws(" | ", "r_name", "n_name", "p_type").alias("prompt")).orderBy("prompt")


@query(r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) title, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) lang, CAST(length(html) AS BIGINT) n_chars FROM pages WHERE length(html) >= 80".replace('\\"', '"'))
def pages_ingest(spark, d):
    return table(spark, d, "pages").where(F.length("html") >= 80).select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"), F.length("html").cast("long").alias("n_chars"))


_RAW = [(1, "Sure!\n```glsl\nvoid main() { }\n```\nbye"), (2, "Here you go\nfloat x = 1.;\n  y"), (3, "  plain words  "), (4, "```c\nvec3 a;```"), (5, "no fence ``` open")]
_VALUES = ", ".join(f"({k}, '{t}')".replace("\n", "' || chr(10) || '") for k, t in _RAW)


@query(rf"""WITH v(id, raw) AS (VALUES {_VALUES}), l AS (SELECT *, string_split(raw, chr(10)) ls FROM v),
a AS (SELECT *, (SELECT min(k) FROM (SELECT unnest(generate_series(1, len(ls))) k) WHERE regexp_matches(ls[k], '\b(void\s+main|mainImage|#define|vec[234]\b|float\b|const\b)')) fl FROM l)
SELECT id, CASE WHEN regexp_matches(raw, '(?s)```(?:glsl|c)?\s*(.*?)```') THEN regexp_replace(regexp_extract(raw, '(?s)```(?:glsl|c)?\s*(.*?)```', 1), '^\s+|\s+$', '', 'g')
WHEN fl IS NOT NULL THEN regexp_replace(array_to_string(ls[fl:], chr(10)), '^\s+|\s+$', '', 'g') ELSE regexp_replace(raw, '^\s+|\s+$', '', 'g') END code FROM a""")
def extract_code(spark, d):
    return spark.createDataFrame(_RAW, "id int, raw string").select("id", co.extract_code(F.col("raw")).alias("code"))


@query("SELECT doc_id FROM documents WHERE length(regexp_replace(text, '^[\\x09-\\x0D\\x20]+|[\\x09-\\x0D\\x20]+$', '', 'g')) >= 20 AND regexp_matches(text, '[;{=]|vec|float')")
def meaningful_documents(spark, d):
    return table(spark, d, "documents").where(co.is_meaningful(F.col("text"))).select("doc_id")


@query("WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 k FROM documents) SELECT k % 5 task, count(*) n FROM o GROUP BY 1")
def task_allocation(spark, d):
    total = table(spark, d, "documents").count()
    shares = co.allocate(total, ["0", "1", "2", "3", "4"])
    return spark.createDataFrame([(int(k), n) for k, n in shares.items()], "task long, n long")
