import hashlib
import os
import random
import struct

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer


def table(spark, path, rows, shape):
    spark.createDataFrame(rows, shape).write.parquet(str(path))


def test_stages_by_hand(spark, tmp_path):
    """Every decision that the five stages have to take, and the library's ids of what is left."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("aehinorstl") for _ in range(r.randint(2, 8)))
    body = lambda: [word() for _ in range(120)]
    passage = [word() for _ in range(15)]
    good, one, leak, mail = body(), body(), body(), body()
    near = [*good[:60], "changed", *good[61:]]
    leak[40:40] = passage
    mail[50:50] = ["a.b@c.de"]
    texts = {0: good, 1: good, 2: near, 3: one, 4: leak, 5: mail, 6: one[:30], 7: ["same"] * 80}
    rows = [(k, " ".join(w), "en", "src", 7) for k, w in texts.items()] + [(8, None, "en", "src", 0), (9, "", None, None, None)]
    table(spark, tmp_path / "documents.parquet", rows, "doc_id long, text string, lang string, source string, n_chars int")
    table(spark, tmp_path / "benchmark.parquet", [(1, " ".join(passage))], "item_id long, text string")
    table(spark, tmp_path / "labels.parquet", [], "doc_id long, quality int, toxic int")
    folder = spark.conf.get("spark.checkpoint.dir")
    before = {x for x in os.listdir(folder) if x.startswith("lanewise-")}
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {0: good, 3: one, 5: [w if w != "a.b@c.de" else "<EMAIL>" for w in mail]}
    assert got.keys() == want.keys()
    for k, words in want.items():
        ids = library.encode(" ".join(words), add_special_tokens=False).ids
        assert got[k].n_tokens == len(ids) and got[k].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    # the last written stage alone stays
    assert [x.split("-")[1] for x in os.listdir(folder) if x.startswith("lanewise-") and x not in before] == ["personal_data"]


def test_stages_keep_the_columns(spark, tmp_path):
    shape = "doc_id long, text string, lang string, source string, n_chars int"
    docs = spark.createDataFrame([], shape)
    table(spark, tmp_path / "benchmark.parquet", [], "item_id long, text string")
    table(spark, tmp_path / "labels.parquet", [], "doc_id long, quality int, toxic int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in spark.createDataFrame([], shape).schema]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0
