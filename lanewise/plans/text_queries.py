"""Text queries: harnesses, answers, prompts and records; code is made from every document's text."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanewise.operators import corpus as co
from lanewise.operators import prompts as pr
from lanewise.operators import timings
from lanewise.operators import tokens as tk
from lanewise.plans.registry import query, table
from lanewise.sources import corpora

_HEADS = ("void mainImage(out vec4 c) {", "void main() { ", "out vec4 o; void main() {", "float4 x; ", "#version 450\nvoid main () {", "vec3 col; ")


def _text(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_HEAD = "CASE doc_id % 6 " + " ".join(f"WHEN {k} THEN {_text(h)}" for k, h in enumerate(_HEADS)) + " END"
_CODE = f"k AS (SELECT doc_id, source, lang, n_chars, text, {_HEAD} || text code FROM documents WHERE text IS NOT NULL)"
_TRIM = r"regexp_replace({}, '^[\x09-\x0D\x20\x1C-\x1F]+|[\x09-\x0D\x20\x1C-\x1F]+$', '', 'g')"
_MAIN = r"regexp_matches(code, '\bvoid\s+main\s*\(')"


def programs(spark, d):
    head = F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("doc_id") % len(_HEADS) + 1).cast("int"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", "source", "lang", "n_chars", "text", F.concat(head, "text").alias("code"))


def _sha1(c):
    return F.sha1(c.cast("binary"))


_HARNESS = _text(pr.VERSION + pr.OUTPUT + pr.UNIFORMS)


def _wrapped(style: str, own: str) -> str:
    return f"CASE WHEN contains(code, 'mainImage') THEN {_HARNESS} || code || {_text(pr.CALL)} WHEN {_MAIN} THEN {own} ELSE {_HARNESS} || {_text(pr.OPEN[style])} || code || {_text(pr.CLOSE)} END"


@query(f"WITH {_CODE} SELECT doc_id, sha1({_wrapped('eval', f'CASE WHEN contains(code, {_text("out vec4")}) THEN code ELSE {_text(pr.VERSION + pr.OUTPUT)} || code END')}) sha FROM k")
def wrap_for_evaluation(spark, d):
    return programs(spark, d).select("doc_id", _sha1(pr.wrapped(F.col("code"))).alias("sha"))


@query(f"WITH {_CODE} SELECT doc_id, sha1({_wrapped('label', f'CASE WHEN starts_with(ltrim(code), {_text("#version")}) THEN code ELSE {_text(pr.VERSION)} || code END')}) sha FROM k")
def wrap_for_labels(spark, d):
    return programs(spark, d).select("doc_id", _sha1(pr.wrapped(F.col("code"), "label")).alias("sha"))


@query(rf"WITH {_CODE} SELECT doc_id, CASE WHEN length(code) < 60 THEN 'thin' WHEN NOT regexp_matches(code, 'mainImage|\bvoid\s+main\s*\(') THEN 'no_entry' END reason FROM k")
def entry_point_gate(spark, d):
    return co.reason(programs(spark, d)).select("doc_id", "reason")


_SIGNS = {k: v.replace("'", "''") for k, v in co.SIGNATURES.items()}


@query(f"WITH {_CODE} SELECT doc_id, {', '.join(f"length(code) >= 80 AND regexp_matches(code, '{v}') {k}" for k, v in _SIGNS.items())}, length(code) >= 80 AND regexp_matches(code, 'mainImage|gl_FragColor|gl_FragCoord') fragment FROM k")
def language_signature(spark, d):
    code = F.col("code")
    return programs(spark, d).select("doc_id", *[corpora.is_language(code, k).alias(k) for k in co.SIGNATURES], corpora.is_language(code, "glsl", "fragment").alias("fragment"))


_ANSWER = "'Here it is: ```' || CASE WHEN n_chars % 2 = 0 THEN 'glsl' ELSE 'c' END || chr(10) || code || chr(10) || '```' || chr(10) || 'Done ```'"


@query(f"WITH {_CODE}, a AS (SELECT doc_id, {_TRIM.format('code')} code FROM k) SELECT doc_id, CASE WHEN contains(code, 'mainImage') AND length(code) > 60 THEN sha1(code) END generated, sha1(code) repaired FROM a")
def answers_cut_out(spark, d):
    answer = F.concat(F.lit("Here it is: ```"), F.when(F.col("n_chars") % 2 == 0, "glsl").otherwise("c"), F.lit("\n"), "code", F.lit("\n```\nDone ```"))
    rows = programs(spark, d).withColumn("answer", answer)
    return rows.select("doc_id", _sha1(pr.generated_code(F.col("answer"))).alias("generated"), _sha1(pr.fenced_code(F.col("answer"))).alias("repaired"))


def _template(template: str, **values: str) -> str:
    out = _text(template)
    for name, value in values.items():
        out = out.replace("{" + name + "}", f"' || {value} || '")
    return out


@query(f"""WITH {_CODE}, s AS (SELECT * FROM k WHERE contains(code, 'mainImage') AND source <> '') SELECT doc_id, sha1({_template(pr.FIX, prompt='source', code='code')}) fix, sha1({_template(pr.EXPLAIN, code='code')}) explain,
sha1({_template(pr.MODIFY, prompt='source', change='lang', code='code')}) modify, sha1({_template(pr.OPTIMIZE, code='code')}) optimize, sha1({_template(pr.WRITE, idea='source')}) "write" FROM s""")
def task_prompts(spark, d):
    rows = pr.seed_rows(programs(spark, d).withColumn("prompt", F.col("source")))
    code, prompt = F.col("code"), F.col("prompt")
    made = {"fix": pr.filled(pr.FIX, prompt=prompt, code=code), "explain": pr.filled(pr.EXPLAIN, code=code), "modify": pr.filled(pr.MODIFY, prompt=prompt, change=F.col("lang"), code=code), "optimize": pr.filled(pr.OPTIMIZE, code=code), "write": pr.filled(pr.WRITE, idea=prompt)}
    return rows.select("doc_id", *[_sha1(c).alias(n) for n, c in made.items()])


@query(f"""WITH {_CODE} SELECT doc_id, {_text(pr.REPAIRER)} "system", sha1({_template(pr.REPAIR, code='code', error='left(text, 600)')}) "user",
sha1('The shader failed to compile:' || chr(10) || text || CASE WHEN doc_id % 3 > 0 THEN chr(10) || '(error near line ' || (doc_id % 3) || ')' ELSE '' END) feedback FROM k""")
def repair_prompts(spark, d):
    asked = pr.repair_conversation(F.col("code"), F.col("text"))
    line = F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 3).otherwise(-1)
    rows = programs(spark, d).select("doc_id", asked.alias("asked"), pr.feedback(F.col("text"), line).alias("told"))
    return rows.select("doc_id", F.get("asked", F.lit(0))["content"].alias("system"), _sha1(F.get("asked", F.lit(1))["content"]).alias("user"), _sha1(F.col("told")).alias("feedback"))


@query(f"""WITH {_CODE} SELECT k.doc_id, source prompt, coalesce(quality = 1, false) compiles, CASE WHEN quality IS NULL THEN 'no verdict' WHEN quality = 1 THEN '' ELSE left(text, 600) END error FROM k LEFT JOIN labels l ON k.doc_id = l.doc_id""")
def compile_labels(spark, d):
    rows = programs(spark, d).withColumn("prompt", F.col("source"))
    verdicts = table(spark, d, "labels").join(rows.select("doc_id", F.col("text").alias("log")), "doc_id").select("doc_id", (F.col("quality") == 1).alias("ok"), "log")
    return pr.labelled(rows, verdicts.where("ok is not null"), "doc_id").drop("code")


_ESCAPED = "replace(replace(text, '\\', '\\\\'), '\"', '\\\"')"
for _c, _as in [("10", "\\n"), ("13", "\\r"), ("9", "\\t"), *((str(k), f"\\u{k:04x}") for k in range(1, 32) if k not in (9, 10, 13))]:
    _ESCAPED = f"replace({_ESCAPED}, chr({_c}), '{_as}')"


@query(f"SELECT doc_id, sha1({_ESCAPED}) sha FROM documents")
def json_escaped_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", _sha1(pr.json_escaped(F.col("text"))).alias("sha"))


_MARK = "'<|endoftext|>'"


@query(f"""WITH j AS (SELECT doc_id, text || {_MARK} || '  ' || {_MARK} || source || {_MARK} x FROM documents), s AS (SELECT doc_id, string_split(x, {_MARK}) p FROM j), u AS (SELECT doc_id, unnest(p) doc, generate_subscripts(p, 1) - 1 pos FROM s)
SELECT doc_id, CAST(pos AS INTEGER) "at", sha1(doc) sha FROM u WHERE {_TRIM.format('doc')} <> ''""")
def documents_by_end_mark(spark, d):
    joined = F.concat(F.col("text"), F.lit(co.EOT + "  " + co.EOT), F.col("source"), F.lit(co.EOT))
    return co.split_documents(table(spark, d, "documents").select("doc_id", joined.alias("text"))).select("doc_id", "at", _sha1(F.col("doc")).alias("sha"))


_PRINTABLE = "[" + ", ".join(str(ord(c)) for c in tk.printable_bytes()) + "]"


@query(f"""WITH x AS (SELECT item_id, hex(encode(text)) h FROM benchmark), b AS (SELECT item_id, h, unnest(generate_series(1, CAST(length(h) / 2 AS BIGINT))) p FROM x)
SELECT item_id, string_agg(chr(({_PRINTABLE})[1 + CAST(('0x' || substr(h, CAST(2 * p - 1 AS BIGINT), 2)) AS INTEGER)]), '' ORDER BY p) spelled FROM b GROUP BY item_id""")
def byte_level_spelling(spark, d):
    return table(spark, d, "benchmark").where("text != ''").select("item_id", tk.spelled_bytes(F.col("text")).alias("spelled"))


@query("SELECT l_linestatus status, min(l_extendedprice) \"min\", list_sort(list(l_extendedprice))[count(*) // 2 + 1] median, round(avg(l_extendedprice), 6) mean, max(l_extendedprice) \"max\", count(*) n FROM lineitem GROUP BY 1")
def sample_statistics(spark, d):
    out = timings.sample_stats(table(spark, d, "lineitem"), "l_linestatus", "l_extendedprice")
    return out.select(F.col("l_linestatus").alias("status"), "min", "median", F.round("mean", 6).alias("mean"), "max", "n")


@query("""WITH s AS (SELECT event_type, min(value) a, list_sort(list(value))[count(*) // 2 + 1] b, avg(value) c, max(value) d FROM events GROUP BY 1)
SELECT 'events' suite, event_type "name", unnest(['min', 'median', 'mean', 'max']) metric, round(unnest([a, b, c, d]), 6) "value", 'units' unit FROM s""")
def suite_records(spark, d):
    stats = timings.sample_stats(table(spark, d, "events"), "event_type", "value")
    return timings.records(stats, "events", "event_type", "units").withColumn("value", F.round("value", 6))


@query(f"""WITH {_CODE}, t AS (SELECT doc_id, {_TRIM.format('source')} "name", {_TRIM.format("regexp_extract(text, '^[^\\n]*')")} first, left(lang || ', ' || source, 200) tags, code FROM k)
SELECT doc_id, CASE WHEN "name" <> '' AND length(code) >= 40 THEN sha1('// Shader: ' || "name" || chr(10) || CASE WHEN first = '' THEN '' ELSE '// ' || left(first, 200) || chr(10) END || '// tags: ' || tags || chr(10) || code) END record FROM t""")
def header_records(spark, d):
    desc = F.regexp_extract("text", "^[^\n]*", 0)
    return programs(spark, d).select("doc_id", _sha1(co.header_record(F.col("source"), desc, F.array("lang", "source"), F.col("code"))).alias("record"))
