import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lanewise.llm import pii

NAIVE = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def naive(text):
    spans = []
    for k, rule in enumerate(NAIVE):
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if k == 2 and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if k == 3 and not 9 <= len(digits) <= 15:
                continue
            spans.append((m.start(), k, m.end()))
    return sorted(spans)


def luhn(digits):
    total = 0
    for k, c in enumerate(digits[::-1]):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aZ9@.-+ ()%_5é0", max_size=40))
def test_base_equals_plain_regexes(text):
    assert pii.base_spans(text) == naive(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a.b@c.d", "4111111111111111", "4111 1111-1111 1111", "1.2.3.4", "+1 (017) 555-7713", "256.1.1.1", "x", " ", "@", "9"]), max_size=8))
def test_base_on_pieces(pieces):
    text = "".join(pieces)
    assert pii.base_spans(text) == naive(text)


def test_long_runs_stay_linear():
    text = "a" * 200_000 + "1" * 200_000 + "." * 1000 + "@" * 1000
    assert pii.base_spans(text) == []


def test_commas_and_long_words_stay_linear():
    """One white-space-free megabyte of identifiers, and a megabyte-long word before many candidates."""
    for text in ("ab12cd," * 150_000, "x" * 1_000_000 + " id77777" * 20_000, "a.b@c.de,id12345," * 60_000):
        began = time.perf_counter()
        found = [*pii.mentions(text)]
        assert time.perf_counter() - began < 60
        assert all(len(p) <= 2 * pii.WORD + 1 for p, *_ in found)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a.b@c.de", "4111 1111 1111 1111", "1.2.3.4", "id12345", "x_99-77", "é", " ", "\n", ",", "Ref:", "=", "y" * 70]), max_size=14))
def test_contexts_and_candidates_equal_plain_walks(pieces):
    text = "".join(pieces)
    base = pii.base_spans(text)
    got = [*pii.candidates(text, base)]
    assert all(6 <= e - s <= 64 and not any(bs < e and be > s for bs, _, be in base) for s, e in got)
    free = [m.span() for m in re.finditer(r"[A-Za-z0-9_-]*[0-9][A-Za-z0-9_-]*", text)]
    assert got == [(s, e) for s, e in free if 6 <= e - s <= 64 and not any(bs < e and be > s for bs, _, be in base)]
    for s, _, near in pii.contexts(text, got):
        before = text[:s].split() if s == 0 or text[s - 1].isspace() else text[:s].split()[:-1]
        last = [w.lower() if len(w) <= pii.WORD else None for w in before[-2:]]
        want = [] if not last or last[-1] is None else [last[-1]] + ([" ".join(last)] if len(last) == 2 and last[0] else [])
        assert near == want


def brute_patterns(texts, support=pii.SUPPORT, confidence=pii.CONFIDENCE, rounds=pii.ROUNDS):
    """The pattern-instance graph in plain loops: {pattern: confidence} of the high ones."""
    count, seeds, slots, open_ = {}, set(), {}, set()
    for text in texts:
        for p, v, seed, candidate in pii.mentions(text or ""):
            count[p, v] = count.get((p, v), 0) + 1
            if candidate:
                open_.add(p)
            if seed:
                seeds.add((p, v))
        words = (text or "").lower().split()
        for k in range(len(words) - 1):
            for p in (words[k], " ".join(words[k - 1 : k + 1])) if k else (words[k],):
                slots[p] = slots.get(p, 0) + 1
    of = {}
    for p, v in count:
        of.setdefault(p, set()).add(v)
    able = {p for p, vs in of.items() if len(vs) >= support and p in open_}
    edges = {k: n for k, n in count.items() if k[0] in able}
    score = {k: float(k in seeds) for k in edges}
    sure = {v for p, v in edges if (p, v) in seeds}
    if not sure:
        return {}
    for _ in range(rounds):
        own = {}
        for p in able:
            mine = [k for k in edges if k[0] == p]
            backed = sum(score[k] >= confidence for k in mine)
            own[p] = min(1.0, sum(edges[k] * score[k] for k in mine) / max(1, slots.get(p, 0))) if backed >= support else 0.0
        for p, v in edges:
            miss = 1.0
            for q in able:
                if (q, v) in edges:
                    miss *= 1 - min(own[q], 0.999999)
            score[p, v] = 1.0 if v in sure else 1 - miss
    return {p: c for p, c in own.items() if c >= confidence}


@pytest.mark.parametrize("seed", range(3))
def test_graph_rounds_equal_brute_force(spark, seed):
    r = random.Random(seed)
    values = ["a.b@c.de", "x@y.org", "4111111111111111", "10.0.0.7", "id1234", "id9999", "zz-12-zz", *(r.randbytes(16).hex() for _ in range(4))]
    texts = [" ".join(r.choice(["ref", "no", "the", "user", *values]) for _ in range(r.randint(0, 14))) for _ in range(60)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {x.pattern: x.confidence for x in pii.high_patterns(docs).collect()}
    assert got == pytest.approx(brute_patterns(texts))
    assert got


def test_recall_on_planted_contexts(spark):
    """Identifiers of a shape that no rule knows, in slots that keys also fill: found; the same shapes elsewhere: left alone."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("aehinorst") for _ in range(r.randint(2, 7)))
    texts, planted = [], {}
    for k in range(400):
        body = [word() for _ in range(60)]
        if k % 4 == 0:
            value = r.randbytes(20).hex() if k % 8 == 0 else f"K{r.randrange(10**7):07d}-{word()}"
            body[20:20] = ["session", "key", "is", value]
            planted[k] = value
        elif k % 4 == 1:
            body.insert(30, f"K{r.randrange(10**7):07d}-{word()}")
        texts.append(" ".join(body))
    found = rows(spark, texts)
    assert {k: [v for _, v in x] for k, x in found.items() if x} == {k: [v] for k, v in planted.items()}


def test_keys_alone_make_a_pattern(spark):
    keys = [random.Random(k).randbytes(20).hex() for k in range(3)]
    found = rows(spark, [f'a token = "{k}" b' for k in keys] + [f"see {keys[0]} there"])
    assert [found[k] for k in range(4)] == [[("identifier", keys[0])], [("identifier", keys[1])], [("identifier", keys[2])], []]


def rows(spark, texts, **options):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: [(x.kind, docs_text[x.start : x.end]) for x in r.personal] for r in pii.find_personal_data(docs, **options).collect() for docs_text in [texts[r.doc_id] or ""]}


def test_bootstrapping_discovers_what_seeds_imply(spark):
    cards = ["4111111111111111", "5500000000000004", "340000000000009"]
    texts = [f"payment ref {c} was taken" for c in cards] + ["payment ref AB-99-1234 was taken", "the 123456 is a number", None, ""]
    found = rows(spark, texts)
    assert found[3] == [("identifier", "AB-99-1234")]
    assert found[4] == found[5] == found[6] == []
    assert found[0] == [("card", cards[0])]


def test_common_words_are_no_patterns(spark):
    texts = ["the 4111111111111111", "the 5500000000000004", "the 340000000000009"] + ["the cat the dog the 123456"] * 4
    assert all(k < 3 or v == [] for k, v in rows(spark, texts).items())


def test_blocks_of_patterns_change_nothing(spark):
    cards = ["4111111111111111", "5500000000000004", "340000000000009"]
    texts = [f"payment ref {c} ok" for c in cards] + ["payment ref AB-99-1234 ok"]
    assert rows(spark, texts) == rows(spark, texts, block=1)


def test_redaction_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c.de now", "x"), (2, None, "y"), (2, None, "y")], "doc_id long, text string, __personal string")
    got = pii.redact(docs)
    assert got.columns == docs.columns
    assert sorted(r.text or "" for r in got.collect()) == ["", "", "mail <EMAIL> now"]
    assert "Personal" not in pii.find_personal_data(docs.withColumnRenamed("__personal", "Personal")).columns


def test_empty_table(spark):
    assert pii.find_personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0
