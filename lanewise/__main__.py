"""Command line: python -m lanewise COMMAND ...

query NAME DIR OUT          a named query over the Parquet tables in DIR, written to OUT
reward IN OUT               rewards of candidates (JSON lines), written as JSON lines
probe IN OUT                variance, finiteness and reward of executed colours (JSON lines: id, rgb)
corpus DIR OUT              builds a corpus from the text files in DIR
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.operators import corpus, interp, scoring
from lanewise.sources import corpora

CANDIDATE = "id string, compiled boolean, executed boolean, divergence double, numerical_error double, visual_match double, perf_penalty double"


def rewards(spark: SparkSession, path: str) -> DataFrame:
    """Candidates with their reward's parts; a missing measurement is 0, a missing verdict false."""
    rows = spark.read.schema(CANDIDATE).json(path)
    filled = rows.fillna(False, ["compiled", "executed"]).fillna(0.0, ["divergence", "numerical_error", "visual_match", "perf_penalty"])
    return scoring.reward(filled).withColumn("verdict", scoring.verdict(F.col("total")))


def probes(spark: SparkSession, path: str) -> DataFrame:
    """Executed programs scored by what they show: a constant image earns no visual credit."""
    seen = interp.probe(spark.read.schema("id string, rgb array<double>").json(path), ["id"])
    ran = seen.select("id", "samples", "variance", F.lit(True).alias("compiled"), F.col("finite").alias("executed"), *[F.lit(0.0).alias(c) for c in ("divergence", "numerical_error", "perf_penalty")])
    return scoring.reward(ran.withColumn("visual_match", scoring.visual_credit(F.col("executed"), F.col("variance"))))


def build_corpus(spark: SparkSession, folder: str, out: str, fraction: float = 0.02) -> None:
    """Files to records: reasons, dedup by id and normalised hash, split, text, JSON lines and statistics."""
    rows = corpora.in_order(corpora.text_files(spark, folder, "files"))
    kept = corpus.dedup(corpus.reason(rows).where("reason is null").withColumn("hash", corpus.code_hash(F.col("code"))))
    record, prompt = corpus.record_of(F.col("name"), F.col("desc"), F.col("tags"), F.col("code"))
    corpora.write_corpus(corpus.deterministic_split(kept, fraction).withColumns({"record": record, "prompt": prompt}), out)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lanewise", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, words in (("query", ("name", "tables", "out")), ("reward", ("source", "out")), ("probe", ("source", "out")), ("corpus", ("source", "out"))):
        own = commands.add_parser(name)
        for word in words:
            own.add_argument(word)
    told = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("lanewise").getOrCreate()
    if told.command == "query":
        from lanewise.plans import QUERIES

        if told.name not in QUERIES:
            parser.error(f"no query {told.name}; there are: {', '.join(sorted(QUERIES))}")
        QUERIES[told.name](spark, told.tables).write.parquet(told.out)
    elif told.command == "corpus":
        build_corpus(spark, told.source, told.out)
    else:
        {"reward": rewards, "probe": probes}[told.command](spark, told.source).write.json(told.out)


if __name__ == "__main__":
    main()
