import math
import random
import time

from lanewise.llm import secrets as s


def corpus(n, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ba", "ne", "tor", "li", "mun", "sa"]) for _ in range(r.randint(1, 4)))
    key = lambda k: "".join(r.choice("0123456789abcdefABCDEF") for _ in range(k))
    rows = []
    for _ in range(n):
        near = [word() for _ in range(6)]
        for value, before, label in (
            (key(40), f"{near[0]} token = \"", 1.0),
            (key(32), f"{near[1]} api_key: '", 1.0),
            (key(40), f"{near[2]} commit ", 0.0),
            ("your-token-" + key(8), "password = \"", 0.0),
            ("".join(r.choice("0123456789") for _ in range(16)), near[3], 0.0),
            ("-".join([*near, "2"]), near[4], 0.0),
        ):
            rows.append((value, before.strip(), near[5], "src/a", label))
    return rows


SHAPE = "value string, before string, after string, path string, label double"


def test_held_out_accuracy(spark):
    train, held = spark.createDataFrame(corpus(60, 1), SHAPE), spark.createDataFrame(corpus(40, 2), SHAPE)
    got = s.score(held, train).collect()
    assert sum(r.is_secret == (r.label == 1) for r in got) >= 0.95 * len(got)


def test_candidates():
    hexes = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    text = f'so token = "{hexes}" and 4111111111111111 or plainwordswithoutdigits and pw = "hunter2!"'
    assert [text[a:b] for a, b in s.find(text)] == [hexes, "4111111111111111", "hunter2!"]
    assert s.find("") == [] and s.find("a1" * 600) == [(0, 512), (512, 1024), (1024, 1200)]


def test_weak_labels_one_side_and_empty(spark):
    docs = spark.createDataFrame([(1, 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y', "a"), (2, "of 4111111111111111 the", "b"), (3, None, None), (3, None, None)], "doc_id long, text string, source string")
    found = s.findings(docs)
    labels = {r.value: r.label for r in s.labelled_findings(found).collect()}
    assert labels == {"04dbebab91ab85687d33eeaaf9ac699e1188f962": 1.0, "4111111111111111": 0.0}
    none = s.labelled_findings(found).limit(0)
    assert {r.is_secret for r in s.score(found, none).collect()} == {False}
    assert s.score(found.limit(0), s.labelled_findings(found)).count() == 0


def test_no_tail_is_dropped():
    for n in (512, 513, 527, 528, 1024, 1030, 1200):
        spans = s.find(("a1" * 700)[:n])
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert s.find(("a1" * 700)[:1030]) == [(0, 512), (512, 1030)]


def test_unquoted_assignments():
    values = lambda text: [text[a:b] for a, b in s.find(text)]
    assert values("password=hunter2 and then") == ["hunter2"]
    assert values("export API_KEY: correcthorsebatterystaple\nx") == ["correcthorsebatterystaple"]
    assert values("get /x?token=abc123&user=bob") == ["abc123"] and values("secret=" + "q" * 520) == ["q" * 520]
    assert values("author: Somebody, colour=magenta, if token == other") == []
    assert values('x = "password=hunter2"') == ["password=hunter2"]
    # the rest of a run around an assignment stays a candidate
    assert values("0123456789abcdef0123/password=hunter2") == ["0123456789abcdef0123/password=", "hunter2"]


def planted(n, seed):
    """(text, {secret values}) in shapes of its own: other names, values and prose than the examples have."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["gra", "von", "ub", "il", "ket", "sso"]) for _ in range(r.randint(1, 4)))
    out = []
    for k in range(n):
        body, true = [word() for _ in range(40)], set()
        if k % 2:
            value = r.choice(["{:040x}".format(r.getrandbits(160)), "tok-" + "".join(r.choice("BCDFGHJKLMNPQRSTVWXZbcdfghjkl23456789") for _ in range(30))])
            body.insert(20, r.choice(['webhook_token: "{}"', "SERVICE_SECRET='{}'", 'repo_password = "{}"', 'deploy.token="{}"']).format(value))
            true.add(value)
        else:
            value = r.choice(["{:040x}".format(r.getrandbits(160)), "".join(r.choice("0123456789") for _ in range(17)), "_".join([word(), word(), word(), "v2"])])
            body.insert(20, r.choice(["build {}", "merged commit {}", "serial {}", "{}"]).format(value))
        out.append((" ".join(body), true))
    return out


def test_false_positives_go_on_an_unseen_generator(spark):
    docs = planted(300, 4)
    table = spark.createDataFrame([(k, t, "src") for k, (t, _) in enumerate(docs)], "doc_id long, text string, source string")
    got = s.score(s.findings(table), s.labelled_examples(spark)).collect()
    right = [r.is_secret == (r.value in docs[r.doc_id][1]) for r in got]
    missed = {v for _, true in docs for v in true} - {r.value for r in got}
    assert not missed and len(right) >= 250 and sum(right) >= 0.95 * len(right)


def test_query_equals_plain_loops(spark, tmp_path):
    """The query against find() on each text and the features, trees and votes of one plain run."""
    texts = [t for t, _ in planted(60, 9)] + [None, "", 'token = "' + "ab12" * 10 + '"'] * 2
    table = spark.createDataFrame([(k, t, None if k % 5 else "p") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.start, r.end): r for r in s.op2_secrets(spark, str(tmp_path)).collect()}
    assert set(got) == {(k, a, b) for k, t in enumerate(texts) for a, b in s.find(t or "")}
    one = s.score(s.findings(table).coalesce(1), s.labelled_examples(spark)).collect()
    assert {(r.doc_id, r.start, r.end): (r.score, r.is_secret) for r in one} == {k: (r.score, r.is_secret) for k, r in got.items()}
    assert got[len(texts) - 1, 9, 49].score == got[len(texts) - 4, 9, 49].score


def test_features_by_hand():
    dictionary = frozenset({"hello"})
    x = s.features("hello12", 'my token = "', '" x', "", dictionary, {"he": -1.0}, -5.0)
    assert x[0] == 7 and x[1] == 1 / 7 and x[2] == (-1.0 - 5 * 3) / 4 and x[4] == 5 / 7 and x[5] == 2 / 7
    assert math.isclose(x[3], -(2 / 7 * math.log2(2 / 7) + 5 / 7 * math.log2(1 / 7)))
    assert x[7:12] == [1.0, 0.0, 0.0, 1.0, 1.0]


def test_columns_that_clash_and_very_long_texts(spark):
    docs = spark.createDataFrame([(1, 'token = "' + "ab12" * 10 + '"', "a", 7)], "doc_id long, text string, source string, prediction int")
    found = s.findings(docs).selectExpr("*", "7 as prediction", "8 as probability", "9 as rawPrediction", "10 as __features", "11 as Score")
    got = s.score(found, s.labelled_examples(spark)).first()
    assert (got.prediction, got.probability, got.rawPrediction, got["__features"]) == (7, 8, 9, 10) and got.is_secret and "Score" not in got.asDict()
    began = time.perf_counter()
    assert len(s.find("a1b2c3d4e5f6g7h8i9," * 50_000)) == 50_000 and len(s.find('k = "v1234567",' * 60_000)) == 60_000
    assert time.perf_counter() - began < 60


def test_dictionary_is_whole(spark):
    """Words beside every candidate, however many, and their letter pairs; what of them is inside a value, against plain loops."""
    word = lambda k: "".join("abcdefghij"[int(d)] for d in f"{k:05d}")
    beside = spark.createDataFrame([(word(k), f"of {word(k)}") for k in range(25_000)], "before string, after string")
    words, pairs, floor = s.language(beside)
    every = {word(k) for k in range(25_000)}
    assert {r.word for r in words.collect()} == every
    counts = s.Counter(w[k : k + 2] for w in every for k in range(4))
    assert pairs == {p: math.log((c + 1) / (100_000 + 676)) for p, c in counts.items()} and floor == math.log(1 / 100_676)
    values = [word(7) + "9" + word(24_999).upper(), "x" + word(300) + "-jjjjj", "1234567890123456", word(7) + "9" + word(24_999).upper(), None]
    found = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id int, value string")
    got = {r.id: r.known for r in s.with_known(found, words, "known").collect()}
    assert {k: set(v or ()) for k, v in got.items()} == {k: {w for w in every if w in (v or "").lower()} for k, v in enumerate(values)}
