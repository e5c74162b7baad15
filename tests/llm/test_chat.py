from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lanewise.llm import chat

PIECE = st.sampled_from(["<|", "<\\|", "</s>", "<s>", "[INST]", "[\\/INST]", "<<SYS>>", "<</SYS>>", "\\", "<", "[", "|", "\n", "x", "im_end|>", "é"])
TEXT = st.lists(PIECE, max_size=8).map("".join)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), min_size=30, max_size=30))
def test_round_trip(spark, turns):
    rows = [(k // 3, k % 3, ["user", "assistant", r][k % 3], t) for k, (r, t) in enumerate(turns)]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in chat.read_back(made).collect():
        own = [x for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == [(x[2], x[3]) for x in own]
        assert r.trained == "".join(x[3] for x in own if x[2] == "assistant")
        assert r.formatted.count("<|") == 2 * len(own)
        assert not any(c in r.formatted.replace("<|im_start|>", "").replace("<|im_end|>", "") for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_trees_rank_branches(spark):
    # root 1 with replies 2 and 3; 3 has 4 and 5; tree 9 has a missing parent and no replies
    nodes = [(0, 1, None, "user", "q", 1.0), (0, 2, 1, "assistant", "a", 0.5), (0, 3, 1, "assistant", "b", 0.4), (0, 4, 3, "user", "c", 0.9), (0, 5, 3, "user", "d", 0.2), (9, 7, 8, "user", "alone", 0.0), (5, 1, 1, "user", "cycle", 0.0)]
    nodes = spark.createDataFrame(nodes, "tree long, node long, parent long, role string, text string, score double")
    all_ = {(r.tree, r.leaf): r.up for r in chat.paths(nodes).groupBy("tree", "leaf").agg(F.max("up").alias("up")).collect()}
    assert all_ == {(0, 2): 1, (0, 4): 2, (0, 5): 2, (9, 7): 0}
    best = {(r.tree, r.rank, r.leaf) for r in chat.best_paths(nodes, keep=2).collect()}
    assert best == {(0, 1, 4), (0, 2, 2), (9, 1, 7)}
    text = {r.leaf: r.formatted for r in chat.format_paths(chat.best_paths(nodes)).collect()}
    assert text[4] == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"


def test_long_chain_nulls_and_repeats(spark):
    rows = [(1, k, "user", f"t{k}") for k in range(70)] + [(2, 0, None, None), (2, 0, None, None), (2, None, "assistant", "x")]
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got[1] == [("user", f"t{k}") for k in range(70)]
    assert got[2] == [("assistant", "x"), ("", ""), ("", "")]
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_null_conversation(spark, tmp_path):
    rows = [(None, 0, "user", "q"), (None, 1, "assistant", "a"), (None, 2, "user", None), (4, 0, "user", "other")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.format_conversations(frame)).collect()}
    assert got == {None: [("user", "q"), ("assistant", "a"), ("user", "")], 4: [("user", "other")]}
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    assert {(r.conv_id, r.n_turns, r.loss_chars) for r in chat.op6_chat(spark, str(tmp_path)).collect()} == {(None, 3, 1), (4, 1, 0), (-7, 2, len(chat._PLANTED))}


def test_null_tree_ranks_branches(spark):
    nodes = [(None, 1, None, "user", "q", 1.0), (None, 2, 1, "assistant", "a", 0.5), (None, 3, 1, "assistant", "b", 0.4), (None, 4, 3, "user", "c", 0.9), (0, 1, None, "user", "q", 1.0)]
    nodes = spark.createDataFrame(nodes, "tree long, node long, parent long, role string, text string, score double")
    best = {(r.tree, r.rank, r.leaf, r.node, r.up) for r in chat.best_paths(nodes, keep=2).collect()}
    assert best == {(None, 1, 4, 4, 0), (None, 1, 4, 3, 1), (None, 1, 4, 1, 2), (None, 2, 2, 2, 0), (None, 2, 2, 1, 1), (0, 1, 1, 1, 0)}


def test_comb_costs_no_square(spark, monkeypatch):
    """A chain of 300 with a leaf at each node: the chosen path alone is written out."""
    n, seen = 300, []
    rows = [(1, k, k - 1 if k else None, "user", f"t{k}", 0.5) for k in range(n)] + [(1, 1000 + k, k, "assistant", f"l{k}", 0.9 if k == 200 else 0.1) for k in range(n)]
    durable = chat.durable

    def counted(df):
        out = durable(df)
        seen.append(out.count())
        return out

    monkeypatch.setattr(chat, "durable", counted)
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got = {r.node: r.up for r in chat.best_paths(nodes).collect()}
    score = {x[1]: x[5] for x in rows}
    branch = lambda k: [1000 + k, *range(k, -1, -1)]
    best = min(range(n), key=lambda k: (-sum(score[x] for x in branch(k)) / (k + 2), -(k + 2)))
    assert got == {x: up for up, x in enumerate(branch(best))}
    assert max(seen) <= 2 * n


def test_leaf_above_a_cycle_has_no_path(spark):
    rows = [(1, 1, 2, "user", "a", 1.0), (1, 2, 1, "user", "b", 1.0), (1, 3, 2, "user", "leaf", 1.0), (1, 4, None, "user", "root", None), (1, 5, 4, "user", "reply", None)]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    assert {(r.leaf, r.node, r.up) for r in chat.paths(nodes).collect()} == {(5, 5, 0), (5, 4, 1)}
    assert {r.node for r in chat.best_paths(nodes).collect()} == {4, 5}
