"""Straight-line program execution: the instruction table becomes one expression chain per lane.

The driver reads the program (it is code: tiny), not the lanes. Branches do not steer; an opcode without
a meaning here gives a zero scalar, and execution ends at the first return.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions.opcodes import EXECUTED, EXPRESSIONS


def run(lanes: DataFrame, program: list[dict], constants: dict[int, list[float]] | None = None, inputs: dict[str, str] | None = None) -> DataFrame:
    """lanes with one array column a Store, named by its target, and tap_<site> columns.

    program: dicts (op, result, operands, imm, line); Load's operand and Store's target are names.
    inputs: name of a global -> column of lanes (an array); AccessChain picks a component of one.
    """
    inputs = inputs or {}
    named: dict[object, Column] = {k: F.array(*[F.lit(float(x)).cast("float") for x in c]) for k, c in (constants or {}).items()}
    df, n = lanes, 0
    zero = F.array(F.lit(0.0).cast("float"))
    where: dict[object, tuple[str, int | None]] = {}
    for inst in program:
        op, args = inst["op"], inst.get("operands", [])
        value: Column | None = None
        if op in ("Return", "ReturnValue"):
            break
        if op == "AccessChain":
            where[inst["result"]] = (args[0], inst.get("imm", 0))
            continue
        if op == "Load":
            name, part = where.get(args[0], (args[0], None))
            if name not in inputs:
                raise ValueError(f"no input for {name}")
            value = F.col(inputs[name])
            value = value if part is None else F.array(F.get(value, F.lit(part)))
        elif op == "Store":
            df = df.withColumn(args[0], named.get(args[1], zero))
            continue
        elif op == "TraceTap":
            df = df.withColumn(f"tap_{inst['imm']}", named.get(args[0], zero))
            continue
        elif op in EXECUTED:
            own = [named.get(a, zero) for a in args]
            value = EXPRESSIONS[op](*own, inst.get("imm", 0)) if op == "CompositeExtract" else EXPRESSIONS[op](*own)
        elif "result" not in inst:
            continue
        # each result is a column of its own, so shared operands are computed once
        name = f"__v{n}"
        n += 1
        df = df.withColumn(name, zero if value is None else value)
        named[inst["result"]] = F.col(name)
    return df.drop(*[f"__v{k}" for k in range(n)])


def grid(spark, n: int) -> DataFrame:
    """(gx, gy, lane, uv) of an n by n grid of fragment coordinates, at pixel centres."""
    lanes = spark.range(n * n).withColumnRenamed("id", "lane")
    x, y = F.col("lane") % n, F.floor(F.col("lane") / n)
    return lanes.select("lane", x.alias("gx"), y.alias("gy"), F.array(((x + 0.5) / n).cast("float"), ((y + 0.5) / n).cast("float")).alias("uv"))


def probe(samples: DataFrame, by: list[str], rgb: str = "rgb") -> DataFrame:
    """(by..., samples, finite, variance) of executed colours: population variance of luminance."""
    from lanewise.functions.values import finite, luminance

    at = [F.get(rgb, F.lit(k)).cast("double") for k in range(3)]
    ok = finite(at[0]) & finite(at[1]) & finite(at[2])
    rows = samples.select(*by, luminance(*at).alias("y"), ok.alias("ok"))
    return rows.groupBy(*by).agg(F.count("*").alias("samples"), F.bool_and("ok").alias("finite"), F.when(F.count("*") < 2, 0.0).otherwise(F.var_pop("y")).alias("variance"))
