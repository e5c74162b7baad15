"""Chat formatting over reply trees.

Native throughout: DataFrame functions only. A tree is rows (tree, node, parent, role, text, score).
Root-to-leaf paths are enumerated by iterative self-joins with doubling jumps. Round k joins every node with
its 2^k-th ancestor and adds up the scores between, so after log2(depth) joins of one row a node each leaf
knows its branch's sum and size. Branches are ranked by the mean score of their nodes (ties: the longer, then
the smaller leaf); only the chosen leaves are then walked up through the same jumps, and each chosen path is
formatted as one conversation. No list of a path travels, and a chain with a leaf at each node costs no square.

Template. A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside texts and roles
(``<|``, ``<s>``, ``</s>``, ``<<SYS>>``, ``<</SYS>>``, ``[INST]``, ``[/INST]``) get a backslash after their
first character; one that already has k backslashes there gets one more, so unescaping is exact. In
roles, backslashes and newlines are escaped as well. The loss mask is a list of [start, end) code
points over the assistant texts of the formatted string, and ``read_back`` rebuilds every turn and
the trained text from the formatted string and its mask alone.

Defined cases: null roles and texts are empty; rows that share a turn follow each other in role and
text order, and none is lost; a null tree (a null conv_id) is one tree like any other, as GROUP BY
has it; a node whose parent is absent is a root; a leaf that reaches no root (above a cycle) and a pure
cycle have no path; null scores count as none in a mean; clashing columns do not matter, as only the named ones are
read; very long texts are escaped and masked whole; empty tables give no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.llm.common import durable, load

START, END = "<|im_start|>", "<|im_end|>\n"
_CONTROL = r"(?:\||/?s>|<SYS>>|</SYS>>)"
_INST = r"/?INST\]"


def escape(text: Column) -> Column:
    once = F.regexp_replace(text, rf"<(\\*)({_CONTROL})", r"<\\$1$2")
    return F.regexp_replace(once, rf"\[(\\*)({_INST})", r"[\\$1$2")


def unescape(text: Column) -> Column:
    once = F.regexp_replace(text, rf"<\\(\\*)({_CONTROL})", r"<$1$2")
    return F.regexp_replace(once, rf"\[\\(\\*)({_INST})", r"[$1$2")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    # a doubled backslash is set aside while \n is undone
    aside = F.replace(unescape(role), F.lit("\\\\"), F.lit("\0\\"))
    return F.replace(F.replace(aside, F.lit("\\n"), F.lit("\n")), F.lit("\0\\"), F.lit("\\"))


def chains(conversations: DataFrame) -> DataFrame:
    """Conversations by turn as trees of one branch: (tree, node, parent, role, text, score)."""
    rows = conversations.select(F.col("conv_id").alias("tree"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    at = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    return rows.select("tree", at.alias("node"), "role", "text").select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _joined(a: DataFrame, b: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """a with b on (tree, key), null trees being equal."""
    other = b.withColumnsRenamed({"tree": "_tree", key: "_key"})
    return a.join(other, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col(key) == F.col("_key")), how).drop("_tree", "_key")


def _climbed(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """((tree, leaf, total, scored, size) of each leaf's branch, [(tree, node, above): 2^k-th ancestors])."""
    one = nodes.groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("total"), F.count("score").alias("scored"), F.count("*").alias("size"))
    known = one.select("tree", F.col("node").alias("parent"), F.col("node").alias("above"))
    sums = durable(_joined(one, known, "parent", "left").select("tree", "node", "above", "total", "scored", "size"))
    inner = sums.where("above is not null").select("tree", F.col("above").alias("node")).distinct()
    leaves = _joined(sums.select("tree", "node"), inner, "node", "left_anti")
    hops, most, whole, rest = [], None, sums.where("above is null"), sums.where("above is not null")
    while rest.head(1):
        most = sums.count() if most is None else most
        if 1 << len(hops) > most:  # a cycle: no path is longer than there are nodes
            break
        hops.append(rest.select("tree", "node", "above"))
        # only nodes that have not reached their root take part
        further = rest.unionByName(whole).select("tree", F.col("node").alias("above"), F.col("above").alias("top"), *[F.col(c).alias(f"{c}_up") for c in ("total", "scored", "size")])
        grown = [(F.col(c) + F.col(f"{c}_up")).alias(c) for c in ("total", "scored", "size")]
        step = durable(_joined(rest, further, "above").select("tree", "node", F.col("top").alias("above"), *grown))
        whole, rest = whole.unionByName(step.where("above is null")), step.where("above is not null")
    branches = _joined(whole, leaves, "node", "left_semi")
    return branches.select("tree", F.col("node").alias("leaf"), "total", "scored", "size"), hops


def _walked(leaves: DataFrame, hops: list[DataFrame]) -> DataFrame:
    """leaves (tree, leaf, ...) with (node, up) for every node above them, the leaf itself included."""
    own = [c for c in leaves.columns if c != "tree"]
    found = durable(leaves.select("tree", *own, F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up")))
    for k, hop in enumerate(hops):
        above = _joined(found, hop.withColumnRenamed("above", "next"), "node").select("tree", *own, F.col("next").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        found = durable(found.unionByName(above))
    return found


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up) for every node on a root-to-leaf path; up: steps above the leaf."""
    branches, hops = _climbed(nodes)
    return _walked(branches.select("tree", "leaf"), hops)


def best_paths(nodes: DataFrame, *, keep: int = 1) -> DataFrame:
    """The nodes of the ``keep`` best branches of each tree, with leaf, up and rank."""
    branches, hops = _climbed(nodes)
    order = Window.partitionBy("tree").orderBy(F.desc("mean"), F.desc("size"), "leaf")
    mean = F.when(F.col("scored") > 0, F.col("total") / F.col("scored"))
    chosen = branches.withColumn("mean", mean).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep).select("tree", "leaf", "rank")
    return _joined(_walked(chosen, hops), nodes, "node")


def format_paths(along: DataFrame, *, trained: str = "assistant") -> DataFrame:
    """(tree, leaf, formatted, mask) of each path; mask: array of struct(start, end)."""
    turn = along.select("tree", "leaf", F.struct((-F.col("up")).alias("at"), (F.col("role") == trained).alias("trained"), F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body")).alias("t"))
    turns = turn.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))

    def grow(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(t["head"])
        end = start + F.length(t["body"])
        mine = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(END)).alias("at"), F.when(t["trained"], F.concat(acc["mask"], mine)).otherwise(acc["mask"]).alias("mask"))

    return turns.select("tree", "leaf", text.alias("formatted"), F.aggregate("turns", zero, grow, lambda acc: acc["mask"]).alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with turns (array of struct(role, text)) and trained (the text under the mask)."""
    body = F.transform(F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda x: x != ""), lambda x: F.substring(x, len(START) + 1, 2147483647))
    turns = F.transform(body, lambda x: F.struct(_unescape_role(F.substring_index(x, "\n", 1)).alias("role"), unescape(F.substr(x, F.instr(x, "\n") + 1)).alias("text")))
    trained = F.array_join(F.transform("mask", lambda m: unescape(F.substr(F.col("formatted"), m["start"] + 1, m["end"] - m["start"]))), "")
    return formatted.select("*", turns.alias("turns"), trained.alias("trained"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask) of conversations by turn."""
    return format_paths(best_paths(durable(chains(conversations)))).select(F.col("tree").alias("conv_id"), "formatted", "mask")


_PLANTED = "</s>[INST] ok [/INST]"


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.sql(f"SELECT -7L AS conv_id, t AS turn, r AS role, '{_PLANTED}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    back = read_back(format_conversations(rows.unionByName(planted)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') "role", coalesce(text, '') text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{_PLANTED}'),
e AS (SELECT *, length(text) + length(regexp_replace(text, '(<\\*(\||/?s>|<SYS>>|</SYS>>)|\[\\*/?INST\])', '\1\\', 'g')) - length(text)
  + length(regexp_replace(replace(replace("role", '\', '\\'), chr(10), '\n'), '(<\\*(\||/?s>|<SYS>>|</SYS>>)|\[\\*/?INST\])', '\1\\', 'g')) + {len(START) + 1 + len(END)} n FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) n_turns,
  sha256(string_agg("role" || chr(10) || text || chr(10), '' ORDER BY turn, "role", text)) turns_sha256,
  CAST(sum(CASE WHEN "role" = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) loss_chars,
  sha256(coalesce(string_agg(CASE WHEN "role" = 'assistant' THEN text END, '' ORDER BY turn, "role", text), '')) loss_sha256,
  CAST(sum(n) AS BIGINT) formatted_chars
FROM e GROUP BY conv_id
"""
