"""Texts around code: harnesses that make a snippet compile, task prompts, feedback, and what is cut from answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.operators.corpus import SPACE, stripped

# A harness is what a compiler is given, a template what a model was trained on.
VERSION = "#version 450\n"
OUTPUT = "layout(location=0) out vec4 _O;\n"
UNIFORMS = """layout(push_constant) uniform U { vec3 iResolution; float iTime; vec4 iMouse; int iFrame; float iTimeDelta; } u;
#define iResolution u.iResolution
#define iTime u.iTime
#define iMouse u.iMouse
#define iFrame u.iFrame
#define iTimeDelta u.iTimeDelta
"""
CALL = "\nvoid main(){ vec4 c=vec4(0.); mainImage(c, gl_FragCoord.xy); _O=c; }\n"
OPEN = {
    "eval": "void main(){ vec2 fragCoord=gl_FragCoord.xy; vec2 uv=fragCoord/iResolution.xy; vec3 col=vec3(0.);\n",
    "label": "void main(){ vec2 fragCoord=gl_FragCoord.xy; vec2 uv=fragCoord/iResolution.xy; vec3 col=vec3(0.);\n",
}
CLOSE = "\n_O=vec4(col,1.); }\n"
WRITE = "Write a Shadertoy shader: {idea}."
FIX = 'The following Shadertoy GLSL shader (originally described as "{prompt}") may contain bugs. Find and fix any issues so it compiles and runs correctly.\n\n```glsl\n{code}\n```'
EXPLAIN = "Explain what the following Shadertoy GLSL shader renders and the techniques it uses.\n\n```glsl\n{code}\n```"
MODIFY = 'Given this Shadertoy GLSL shader (originally: "{prompt}"), apply the following change and return the complete modified shader.\n\nRequested change: {change}\n\n```glsl\n{code}\n```'
OPTIMIZE = "Optimize the following Shadertoy GLSL shader for performance and code clarity while preserving its visual output exactly.\n\n```glsl\n{code}\n```"
REPAIR = "The following GLSL shader fails to compile:\n\n```glsl\n{code}\n```\n\nCompiler error:\n{error}\n\nPlease provide the corrected shader."
REPAIRER = "You are a GLSL shader debugging expert. Fix the shader so it compiles. Output only the corrected ```glsl code block."
FENCE = r"(?s)```(?:glsl|c)?\s*(.*?)```"
ERROR_CHARS, GENERATED_CHARS = 600, 60


def wrapped(code: Column, style: str = "eval") -> Column:
    """A compilable fragment program around a snippet. Styles differ in what a program with its own main() gets."""
    bare = code.rlike(r"\bvoid\s+main\s*\(")
    if style == "eval":
        own = F.when(code.contains("out vec4"), code).otherwise(F.concat(F.lit(VERSION + OUTPUT), code))
    else:
        own = F.when(F.regexp_replace(code, rf"^{SPACE}", "").startswith("#version"), code).otherwise(F.concat(F.lit(VERSION), code))
    head = F.lit(VERSION + OUTPUT + UNIFORMS)
    return F.when(code.contains("mainImage"), F.concat(head, code, F.lit(CALL))).when(bare, own).otherwise(F.concat(head, F.lit(OPEN[style]), code, F.lit(CLOSE)))


def fenced_code(text: Column) -> Column:
    """The first fence's content, or the whole text, trimmed: a repair's answer."""
    return stripped(F.when(text.rlike(FENCE), F.regexp_extract(text, FENCE, 1)).otherwise(text))


def generated_code(text: Column, least: int = GENERATED_CHARS) -> Column:
    """fenced_code() of a generated answer; null if it has no entry point or is not longer than ``least``."""
    code = fenced_code(text)
    return F.when(code.contains("mainImage") & (F.length(code) > least), code)


def seed_rows(rows: DataFrame) -> DataFrame:
    """Rows that can seed a task: prompt and code are there, and the code has an entry point."""
    return rows.where((F.coalesce("prompt", F.lit("")) != "") & F.coalesce("code", F.lit("")).contains("mainImage"))


def filled(template: str, **values: Column) -> Column:
    """A template with its {names} replaced by columns; null counts as empty."""
    parts, at = [], 0
    names = sorted(((template.index("{" + n + "}"), n) for n in values), key=lambda x: x[0])
    for start, name in names:
        parts += [F.lit(template[at:start]), F.coalesce(values[name].cast("string"), F.lit(""))]
        at = start + len(name) + 2
    return F.concat(*parts, F.lit(template[at:]))


def repair_conversation(code: Column, error: Column) -> Column:
    """array<struct<role, content>> that asks for a repair; the error is cut as labels cut it."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", F.lit(REPAIRER)), turn("user", filled(REPAIR, code=code, error=F.left(error, F.lit(ERROR_CHARS)))))


def feedback(log: Column, line: Column) -> Column:
    """What the next attempt is told; a line below 0 or null is not named."""
    near = F.when(line >= 0, F.concat(F.lit("\n(error near line "), line.cast("string"), F.lit(")"))).otherwise("")
    return F.concat(F.lit("The shader failed to compile:\n"), F.coalesce(log, F.lit("")), near)


def labelled(rows: DataFrame, verdicts: DataFrame, key: str = "id") -> DataFrame:
    """(key, prompt, code, compiles, error) from a compiler's recorded verdicts (key, ok, log); no verdict counts as a failure."""
    told = verdicts.select(key, F.col("ok").alias("compiles"), F.when(F.col("ok"), "").otherwise(F.left("log", F.lit(ERROR_CHARS))).alias("error"))
    out = rows.select(key, F.coalesce("prompt", F.lit("")).alias("prompt"), "code").join(told, key, "left")
    return out.select(key, "prompt", "code", F.coalesce("compiles", F.lit(False)).alias("compiles"), F.coalesce("error", F.lit("no verdict")).alias("error"))


def json_escaped(text: Column) -> Column:
    """The inside of a JSON string: quotes, backslashes and control characters escaped, all else as it is."""
    short = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    out = F.replace(text, F.lit("\\"), F.lit(short.pop("\\")))
    for c in [*short, *(chr(k) for k in range(0x20) if chr(k) not in short)]:
        out = F.replace(out, F.lit(c), F.lit(short.get(c, f"\\u{ord(c):04x}")))
    return out


def sampled(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows by the smallest hash of (seed, key), ties by key; fewer rows than n are repeated, as evenly as can be.

    The top-n is taken in every partition first. ``n`` is the caller's wish, so it may be large: rows go
    through one task only where the result itself is that large.
    """
    first = rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)
    have = first.count()
    if not 0 < have < n:
        return first
    times = F.lit(n // have) + (F.col("__at") < n % have).cast("int")
    spread = first.withColumn("__at", F.row_number().over(_by_hash(seed, key)) - 1)
    return spread.withColumn("__copy", F.explode(F.sequence(F.lit(1), times))).drop("__at", "__copy")


def _by_hash(seed: int, key: str):
    from pyspark.sql import Window

    return Window.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)  # over fewer rows than were asked for
