"""The program tables' opcodes as Column expressions.

A value is an array of 1 to 4 components: floats for float operations, ints otherwise. Booleans are
ints 0 and 1. EXPRESSIONS maps an opcode to a function of its operands' arrays; names without an
expression (memory, control flow, images) are in STRUCTURAL with what they mean to the table plans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise.functions.values import U32, bits_float, ieee_divide, unsigned, wrap32

Expression = Callable[..., Column]


def _f(x: Column) -> Column:
    return x.cast("float")


def broadcast_zip(a: Column, b: Column, use: Callable[[Column, Column], Column]) -> Column:
    """use over components; a right operand of one component serves all."""
    return F.transform(a, lambda x, k: use(x, F.when(F.size(b) == 1, F.get(b, F.lit(0))).otherwise(F.get(b, k))))


def _floats(use: Callable[[Column, Column], Column]) -> Expression:
    return lambda a, b: broadcast_zip(a, b, lambda x, y: _f(use(x, y)))


def _one(use: Callable[[Column], Column]) -> Expression:
    return lambda a: F.transform(a, lambda x: _f(use(x)))


def _ints(use: Callable[[Column, Column], Column]) -> Expression:
    return lambda a, b: F.zip_with(a, b, lambda x, y: wrap32(use(x.cast("long"), y.cast("long"))))


def _test(use: Callable[[Column, Column], Column], *, mask: bool = False, ordered: bool = False) -> Expression:
    def test(x: Column, y: Column) -> Column:
        told = use(unsigned(x), unsigned(y)) if mask else use(x, y)
        return F.when(told & (~F.isnan(x) & ~F.isnan(y) if ordered else F.lit(True)), 1).otherwise(0)

    return lambda a, b: F.zip_with(a, b, test)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: _f(x * y)), F.lit(0.0).cast("float"), lambda acc, x: _f(acc + x))


def _length(a: Column) -> Column:
    return _f(F.sqrt(_dot(a, a)))


def _cross(a: Column, b: Column) -> Column:
    at = lambda v, k: F.get(v, F.lit(k))
    return F.array(*[_f(at(a, i) * at(b, j) - at(a, j) * at(b, i)) for i, j in ((1, 2), (2, 0), (0, 1))])


def _smoothstep(lo: Column, hi: Column, x: Column) -> Column:
    t = broadcast_zip(broadcast_zip(x, lo, lambda p, q: p - q), broadcast_zip(hi, lo, lambda p, q: p - q), lambda p, q: F.greatest(F.lit(0.0), F.least(F.lit(1.0), ieee_divide(p, q))))
    return F.transform(t, lambda u: _f(u * u * (3 - 2 * u)))


def _log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))


EXPRESSIONS: dict[str, Expression] = {
    "Undef": lambda: F.array(F.lit(0.0).cast("float")),
    "IAdd": _ints(lambda x, y: x + y),
    "ISub": _ints(lambda x, y: x - y),
    "IMul": lambda a, b: F.zip_with(a, b, lambda x, y: wrap32(F.pmod(x.cast("decimal(20,0)") * y.cast("decimal(20,0)"), F.lit(U32).cast("decimal(20,0)")).cast("long"))),
    "SDiv": _ints(lambda x, y: F.when(y == 0, F.lit(0)).otherwise(F.floor(F.abs(x) / F.abs(y)) * F.signum(x) * F.signum(y)).cast("long")),
    "UDiv": _ints(lambda x, y: F.when(y == 0, F.lit(0)).otherwise(F.floor(unsigned(x) / unsigned(y))).cast("long")),
    "SMod": _ints(lambda x, y: F.when(y == 0, F.lit(0)).otherwise(x - y * F.floor(x / y)).cast("long")),
    "UMod": _ints(lambda x, y: F.when(y == 0, F.lit(0)).otherwise(F.pmod(unsigned(x), unsigned(y)))),
    "SNegate": lambda a: F.transform(a, lambda x: wrap32(-x.cast("long"))),
    "FAdd": _floats(lambda x, y: x + y),
    "FSub": _floats(lambda x, y: x - y),
    "FMul": _floats(lambda x, y: x * y),
    "FDiv": _floats(ieee_divide),
    "FNegate": _one(lambda x: -x),
    "FRem": _floats(lambda x, y: F.when(y == 0, F.lit(float("nan"))).otherwise(x % F.when(y == 0, F.lit(1.0)).otherwise(y))),
    "IEqual": _test(lambda x, y: x == y),
    "INotEqual": _test(lambda x, y: x != y),
    "SLessThan": _test(lambda x, y: x < y),
    "SGreaterThan": _test(lambda x, y: x > y),
    "SLessThanEqual": _test(lambda x, y: x <= y),
    "SGreaterThanEqual": _test(lambda x, y: x >= y),
    "ULessThan": _test(lambda x, y: x < y, mask=True),
    "UGreaterThan": _test(lambda x, y: x > y, mask=True),
    "ULessThanEqual": _test(lambda x, y: x <= y, mask=True),
    "UGreaterThanEqual": _test(lambda x, y: x >= y, mask=True),
    "FOrdEqual": _test(lambda x, y: x == y, ordered=True),
    "FOrdNotEqual": _test(lambda x, y: x != y, ordered=True),
    "FOrdLessThan": _test(lambda x, y: x < y, ordered=True),
    "FOrdGreaterThan": _test(lambda x, y: x > y, ordered=True),
    "FOrdLessThanEqual": _test(lambda x, y: x <= y, ordered=True),
    "FOrdGreaterThanEqual": _test(lambda x, y: x >= y, ordered=True),
    "LogicalAnd": _test(lambda x, y: (x != 0) & (y != 0)),
    "LogicalOr": _test(lambda x, y: (x != 0) | (y != 0)),
    "LogicalNot": lambda a: F.transform(a, lambda x: F.when(x == 0, 1).otherwise(0)),
    "LogicalEqual": _test(lambda x, y: (x != 0) == (y != 0)),
    "BitwiseAnd": _ints(lambda x, y: x.bitwiseAND(y)),
    "BitwiseOr": _ints(lambda x, y: x.bitwiseOR(y)),
    "BitwiseXor": _ints(lambda x, y: x.bitwiseXOR(y)),
    "Not": lambda a: F.transform(a, lambda x: F.bitwise_not(x.cast("int"))),
    "ShiftLeftLogical": _ints(lambda x, y: F.pmod(unsigned(x) * F.pow(F.lit(2.0), F.pmod(y, F.lit(32))).cast("decimal(20,0)"), F.lit(U32)).cast("long")),
    "ShiftRightLogical": _ints(lambda x, y: F.floor(unsigned(x) / F.pow(F.lit(2.0), F.pmod(y, F.lit(32)))).cast("long")),
    "ShiftRightArithmetic": _ints(lambda x, y: F.floor(x / F.pow(F.lit(2.0), F.pmod(y, F.lit(32)))).cast("long")),
    "ConvertSToF": _one(lambda x: x),
    "ConvertUToF": _one(unsigned),
    "ConvertFToS": lambda a: F.transform(a, lambda x: wrap32(F.when(F.isnan(x), F.lit(0.0)).otherwise(F.greatest(F.lit(-(2.0**31)), F.least(F.lit(2.0**31 - 1), x.cast("double")))).cast("long"))),
    "ConvertFToU": lambda a: F.transform(a, lambda x: wrap32(F.when(F.isnan(x), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(2.0**32 - 1), x.cast("double")))).cast("long"))),
    "Bitcast": lambda a: F.transform(a, lambda x: bits_float(unsigned(x))),
    "CompositeConstruct": lambda *parts: F.slice(F.concat(*parts), 1, 4),
    "CompositeExtract": lambda a, k=0: F.array(F.get(a, F.lit(k if k < 4 else 0))),
    "CompositeInsert": lambda a, x, k=0: F.transform(a, lambda v, i: F.when(i == k, F.get(x, F.lit(0))).otherwise(v)),
    "VectorShuffle": lambda a, b, *ks: F.array(*[F.get(F.concat(a, b), F.lit(k)) for k in ks]),
    "VectorTimesScalar": lambda a, s: F.transform(a, lambda x: _f(x * F.get(s, F.lit(0)))),
    "Select": lambda c, a, b: F.transform(a, lambda x, k: F.when(F.coalesce(F.get(c, k), F.get(c, F.lit(0))) != 0, x).otherwise(F.get(b, k))),
    "Dot": lambda a, b: F.array(_dot(a, b)),
    "Cross": _cross,
    "Normalize": lambda a: F.transform(a, lambda x: _f(ieee_divide(x, _length(a)))),
    "Length": lambda a: F.array(_length(a)),
    "Distance": lambda a, b: F.array(_length(F.zip_with(a, b, lambda x, y: _f(x - y)))),
    "Reflect": lambda i, n: F.zip_with(i, n, lambda x, y: _f(x - 2 * _dot(n, i) * y)),
    "FMin": _floats(F.least),
    "FMax": _floats(F.greatest),
    "FClamp": lambda a, lo, hi: broadcast_zip(broadcast_zip(a, lo, F.greatest), hi, F.least),
    "FMix": lambda a, b, t: F.zip_with(a, broadcast_zip(F.zip_with(b, a, lambda y, x: y - x), t, lambda d, u: d * u), lambda x, d: _f(x + d)),
    "Pow": _floats(F.pow),
    "Exp": _one(F.exp),
    "Exp2": _one(lambda x: F.pow(F.lit(2.0), x)),
    "Log": _one(_log),
    "Log2": _one(lambda x: _log(x) / F.ln(F.lit(2.0))),
    "Sin": _one(F.sin),
    "Cos": _one(F.cos),
    "Tan": _one(F.tan),
    "Sqrt": _one(F.sqrt),
    "InverseSqrt": _one(lambda x: ieee_divide(F.lit(1.0), F.sqrt(x))),
    "FAbs": _one(F.abs),
    "Floor": _one(F.floor),
    "Ceil": _one(F.ceil),
    "Fract": _one(lambda x: x - F.floor(x)),
    "Step": lambda edge, x: broadcast_zip(x, edge, lambda v, e: F.when(v < e, F.lit(0.0)).otherwise(F.lit(1.0)).cast("float")),
    "SmoothStep": _smoothstep,
}

#: Opcodes that are structure and not values.
STRUCTURAL = {
    "Nop": "no row",
    "Variable": "a column",
    "Load": "reads a column",
    "Store": "replaces a column",
    "AccessChain": "a component of a column",
    "DPdx": "difference of the two lanes of a quad row",
    "DPdy": "difference of the two rows of a quad",
    "Fwidth": "sum of the two differences' sizes",
    "ImageSampleImplicitLod": "out of scope: needs an image",
    "ImageSampleExplicitLod": "out of scope: needs an image",
    "Phi": "value by predecessor",
    "Branch": "an edge",
    "BranchConditional": "two edges",
    "Switch": "no edge",
    "LoopMerge": "metadata",
    "SelectionMerge": "metadata",
    "Return": "ends the lane",
    "ReturnValue": "ends the lane",
    "Kill": "no effect here",
    "Unreachable": "no effect here",
    "FunctionCall": "inlined",
    "TraceTap": "a row of the trace",
}
TERMINATORS = ("Branch", "BranchConditional", "Switch", "Return", "ReturnValue", "Kill", "Unreachable")
OPCODES = [*EXPRESSIONS, *STRUCTURAL]
#: What the interpreter of straight-line programs computes; all else gives a zero scalar.
EXECUTED = ("FAdd", "FSub", "FMul", "FDiv", "VectorTimesScalar", "IAdd", "ISub", "IMul", "Dot", "CompositeConstruct", "CompositeExtract")


def quad_derivatives(lanes, value: str = "value", lane: str = "lane", by: tuple[str, ...] = ()):
    """lanes with dpdx, dpdy and fwidth; a quad is four consecutive lanes, two by two."""
    from pyspark.sql import Window

    quad = Window.partitionBy(*by, F.floor(F.col(lane) / 4))
    at = [F.max(F.when(F.pmod(F.col(lane), F.lit(4)) == k, F.col(value))).over(quad) for k in range(4)]
    row = F.floor(F.pmod(F.col(lane), F.lit(4)) / 2)
    col = F.pmod(F.col(lane), F.lit(2))
    dx = F.when(row == 0, at[1] - at[0]).otherwise(at[3] - at[2])
    dy = F.when(col == 0, at[2] - at[0]).otherwise(at[3] - at[1])
    return lanes.withColumns({"dpdx": dx, "dpdy": dy, "fwidth": F.abs(dx) + F.abs(dy)})
