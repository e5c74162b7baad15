"""Numeric kernels with a relational form: norms, softmax, cross-entropy, sampling cut-offs, updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.operators.rounds import durable
from lanewise.operators.trace import FEW, PIECE


def _sum(values: Column, use=lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + use(x.cast("double")))


def rms_norm(values: Column, eps: float = 1e-6) -> Column:
    scale = 1 / F.sqrt(_sum(values, lambda x: x * x) / F.size(values) + eps)
    return F.transform(values, lambda x: x.cast("double") * scale)


def residual_rms_norm(values: Column, residual: Column, eps: float = 1e-6) -> Column:
    return rms_norm(F.zip_with(values, residual, lambda x, r: x + r), eps)


def rms_norm_gradient(values: Column, weight: Column, grad: Column, eps: float = 1e-6) -> Column:
    """Gradient of weight * rms_norm(values) with respect to values."""
    n = F.size(values)
    scale = 1 / F.sqrt(_sum(values, lambda x: x * x) / n + eps)
    weighed = F.zip_with(weight, grad, lambda w, g: w.cast("double") * g.cast("double"))
    along = dot(values, weighed) * scale * scale * scale / n
    return F.zip_with(values, weighed, lambda x, wg: wg * scale - along * x.cast("double"))


def rms_norm_weight_gradient(rows: DataFrame, values: str, grad: str, eps: float = 1e-6) -> DataFrame:
    """(j, v): gradient with respect to the weights, summed over rows."""
    own = rows.select(F.posexplode(F.zip_with(rms_norm(F.col(values), eps), grad, lambda y, g: y * g.cast("double"))).alias("j", "v"))
    return own.groupBy("j").agg(F.sum("v").alias("v"))


def log_sum_exp(values: Column) -> Column:
    top = F.array_max(values).cast("double")
    return top + F.ln(_sum(values, lambda x: F.exp(x - top)))


def softmax(values: Column) -> Column:
    lse = log_sum_exp(values)
    return F.transform(values, lambda x: F.exp(x.cast("double") - lse))


def cross_entropy(logits: Column, target: Column) -> Column:
    """-log softmax[target]; null for a target out of range (an ignored one)."""
    return F.when((target >= 0) & (target < F.size(logits)), log_sum_exp(logits) - F.get(logits, target).cast("double"))


def mean_cross_entropy(rows: DataFrame, logits: str, target: str, ignored: int = -100) -> DataFrame:
    """(loss, n): mean over the rows whose target is neither ``ignored`` nor out of range; 0 over none."""
    own = rows.where(F.col(target) != ignored).select(cross_entropy(F.col(logits), F.col(target)).alias("x"))
    return own.agg(F.coalesce(F.avg("x"), F.lit(0.0)).alias("loss"), F.count("x").alias("n"))


def argmax(values: Column) -> Column:
    """Index of the largest value, the first of equals."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def silu_mul(gate: Column, up: Column) -> Column:
    return F.zip_with(gate, up, lambda g, u: g.cast("double") / (1 + F.exp(-g.cast("double"))) * u.cast("double"))


def gumbel_argmax(values: Column, seed: Column, temperature: float = 1.0) -> Column:
    """argmax of logit/T - ln(-ln u), with u hashed from (seed, index)."""
    u = lambda k: (F.pmod(F.xxhash64(seed, k), F.lit(1 << 30)) + 0.5) / (1 << 30)
    return argmax(F.transform(values, lambda x, k: x.cast("double") / temperature - F.ln(-F.ln(u(k)))))


def dequantise_int4(packed: Column, scale: Column) -> Column:
    """Eight signed 4-bit values of a 32-bit integer, low nibble first."""
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: (F.pmod(F.floor(F.pmod(packed.cast("long"), F.lit(1 << 32)) / F.pow(F.lit(16.0), k)) + 8, F.lit(16)) - 8) * scale)


def dequantise_int4_groups(packed: Column, scales: Column, group: int) -> Column:
    """Signed 4-bit values of an array of bytes, low nibble first, by the scale of their group of ``group`` values."""
    nibbles = F.flatten(F.transform(packed, lambda b: F.array(F.pmod(b.cast("int"), F.lit(16)), F.pmod(F.shiftright(F.pmod(b.cast("int"), F.lit(256)), 4), F.lit(16)))))
    return F.transform(nibbles, lambda x, k: (F.pmod(x + 8, F.lit(16)) - 8) * F.get(scales, F.floor(k / group).cast("int")))


def dequantise_fp8(code: Column, scale: Column | float = 1.0) -> Column:
    """The value of an 8-bit float with 4 bits of exponent and 3 of mantissa: no infinities, one NaN a sign."""
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    exponent, mantissa = F.shiftright(code, 3).bitwiseAND(15), code.bitwiseAND(7)
    size = F.when(exponent == 0, mantissa * 2.0**-9).otherwise((1 + mantissa / 8) * F.pow(F.lit(2.0), exponent - 7))
    signed = F.when(F.shiftright(code, 7).bitwiseAND(1) == 1, -size).otherwise(size)
    return F.when((exponent == 15) & (mantissa == 7), F.lit(float("nan"))).otherwise(signed.cast("double") * scale)


def gathered(ids: DataFrame, table: DataFrame) -> DataFrame:
    """(i, row) of ids (i, id) from an embedding table (id, row)."""
    return ids.join(table, "id").select("i", "row")


def scatter_added(ids: DataFrame, grads: DataFrame) -> DataFrame:
    """(id, j, v): gradients (i, j, v) summed by the id of their position (i, id); partial sums come before the exchange."""
    return grads.join(ids, "i").groupBy("id", "j").agg(F.sum(F.col("v").cast("double")).alias("v"))


def heads_repeated(heads: DataFrame, group: int) -> DataFrame:
    """(b, h, s, d, v) for query heads: each key-value head (b, h, s, d, v) ``group`` times, side by side."""
    return heads.withColumn("h", F.explode(F.sequence(F.col("h") * group, F.col("h") * group + (group - 1))))


def heads_reduced(heads: DataFrame, group: int) -> DataFrame:
    """(b, h, s, d, v): the sum over the ``group`` query heads of each key-value head."""
    return heads.withColumn("h", F.floor(F.col("h") / group)).groupBy("b", "h", "s", "d").agg(F.sum("v").alias("v"))


def transposed(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def axpy(alpha: float, x: DataFrame, y: DataFrame) -> DataFrame:
    """(i, j, v) of alpha x + y for coordinate matrices; a missing cell is 0."""
    both = x.select("i", "j", (alpha * F.col("v")).alias("v")).unionByName(y.select("i", "j", F.col("v").cast("double").alias("v")))
    return both.groupBy("i", "j").agg(F.sum("v").alias("v"))


def bias_added(matrix: DataFrame, bias: DataFrame) -> DataFrame:
    """(i, j, v) with bias (j, v) added to each row; a missing bias is 0."""
    return matrix.join(bias.select("j", F.col("v").alias("__b")), "j", "left").select("i", "j", (F.col("v") + F.coalesce("__b", F.lit(0.0))).alias("v"))


def top_blocks(query: DataFrame, keys: DataFrame, block: int, k: int) -> DataFrame:
    """(q, block, score, rank): each query's ``k`` blocks of ``block`` consecutive keys with the largest mean dot product.

    query: (q, g, vector), whose vectors are averaged over g first; keys: (q, t, vector). Ties go to the earlier block.
    """
    lanes = query.select("q", "g", F.posexplode("vector").alias("d", "x"))
    mean = lanes.groupBy("q", "d").agg((F.sum(F.col("x").cast("double")) / F.countDistinct("g")).alias("x"))
    cells = keys.select("q", F.floor(F.col("t") / block).alias("block"), "t", F.posexplode("vector").alias("d", "y"))
    scored = cells.join(mean, ["q", "d"]).groupBy("q", "block").agg((F.sum(F.col("x") * F.col("y")) / F.countDistinct("t")).alias("score"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "block")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def adamw(params: DataFrame, step: int, lr: float = 1e-3, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8, decay: float = 0.01) -> DataFrame:
    """params (w, g, m, v) after one step."""
    m, v = b1 * F.col("m") + (1 - b1) * F.col("g"), b2 * F.col("v") + (1 - b2) * F.col("g") * F.col("g")
    moved = params.withColumns({"m": m, "v": v})
    return moved.withColumn("w", F.col("w") * (1 - lr * decay) - lr * (F.col("m") / (1 - b1**step)) / (F.sqrt(F.col("v") / (1 - b2**step)) + eps))


def clip_by_norm(grads: DataFrame, most: float, value: str = "g") -> DataFrame:
    """grads scaled so that their global norm is at most ``most``; the norm is one scalar."""
    norm = grads.agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("n")).scalar()
    return grads.withColumn(value, F.col(value) * F.least(F.lit(1.0), F.lit(most) / (norm + 1e-6)))


BUCKETS = 16


def top_p(probs: DataFrame, p: float, min_p: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """probs (by..., token, p) that stay, renormalised: whole log2 buckets up to the one that reaches p."""
    by = by or []
    bucket = F.least(F.lit(BUCKETS - 1), F.greatest(F.lit(0), F.floor(-F.log2("p")))).cast("int")
    able = probs.where(F.col("p") > min_p).withColumn("bucket", bucket)
    mass = able.groupBy(*by, "bucket").agg(F.sum("p").alias("mass"))
    below = F.sum("mass").over(Window.partitionBy(*by).orderBy("bucket")) - F.col("mass")
    kept = mass.withColumn("below", below).where(F.round("below", 12) < p).select(*by, "bucket")
    held = able.join(kept, [*by, "bucket"])
    total = held.groupBy(*by).agg(F.sum("p").alias("total"))
    out = held.join(total, by) if by else held.crossJoin(total)
    return out.withColumn("q", F.col("p") / F.col("total")).drop("total")


def column_norms(matrix: DataFrame) -> DataFrame:
    """(j, norm) of a coordinate matrix (i, j, v)."""
    return matrix.groupBy("j").agg(F.sqrt(F.sum(F.col("v").cast("double") * F.col("v").cast("double"))).alias("norm"))


def _beside(table: DataFrame) -> DataFrame:
    """table, sent to all tasks where it is small: a join by its few keys would deal the other side's rows to as few tasks."""
    kept = durable(table)
    return F.broadcast(kept) if kept.count() <= FEW else kept


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) of the product of coordinate matrices."""
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("w"))
    return a.select("i", F.col("j").alias("k"), "v").join(_beside(right), "k").groupBy("i", "j").agg(F.sum(F.col("v").cast("double") * F.col("w").cast("double")).alias("v"))


def dora_weight(base: DataFrame, b: DataFrame, a: DataFrame, magnitude: DataFrame) -> DataFrame:
    """(i, j, v): columns of base + B A, scaled to the magnitudes (j, m); a zero column stays zero."""
    # rows meet in pieces whose number grows with the cells, so that what a task sums does not
    n, most = base.count(), int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(n // PIECE + 1, min(most, n // FEW + 1))
    moved = base.unionByName(matmul(b.repartition(parts, "i"), a)).repartition(parts, "i").groupBy("i", "j").agg(F.sum("v").alias("v"))
    scaled = moved.join(_beside(column_norms(moved).join(magnitude, "j")), "j")
    return scaled.select("i", "j", F.when(F.col("norm") > 0, F.col("v") * F.col("m") / F.col("norm")).otherwise(0.0).alias("v"))


def dora_forward(weight: DataFrame, x: DataFrame) -> DataFrame:
    """(i, y) of weight times x (j, x)."""
    return weight.join(x, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("y"))


def dora_trainable(d: int, k: int, r: int) -> int:
    return r * (d + k) + k


def bigram_loss(pairs: DataFrame, vocab: int = 258, smoothing: float = 1.0) -> DataFrame:
    """Mean -log p(b | a) of a counted bigram model over (a, b, n); tokens out of the vocabulary are left out."""
    own = pairs.where((F.col("a") < vocab) & (F.col("b") < vocab))
    totals = own.groupBy("a").agg(F.sum("n").alias("t"))
    p = (F.col("n") + smoothing) / (F.col("t") + smoothing * vocab)
    return own.join(totals, "a").agg((F.sum(-F.col("n") * F.ln(F.greatest(p, F.lit(1e-12)))) / F.sum("n")).alias("loss"))


def bigram_predict(pairs: DataFrame) -> DataFrame:
    """(a, b): the likeliest next token, the smallest of equals."""
    return pairs.groupBy("a").agg(F.min_by("b", F.struct((-F.col("n")).alias("n"), F.col("b"))).alias("b"))


def tiny_model(tokens: DataFrame, vocab: int, dim: int, epochs: int, rate: float, seed: int = 1) -> DataFrame:
    """(epoch, loss): next-token training of an embedding and an output matrix, one token after the other.

    tokens: (pos, token). Each step needs the weights after the one before, so one task does it all and holds
    the tokens (4 bytes each); it is for small corpora. No tokens, no rows. bigram_loss() is the counted model for large ones.
    """
    import numpy as np
    import pyarrow as pa

    def train(batches):
        pos, token = [], []
        for batch in batches:
            pos.append(batch.column(0).to_numpy())
            token.append(batch.column(1).to_numpy().astype(np.int32))
        if not pos:
            return
        own = np.concatenate(token)[np.argsort(np.concatenate(pos), kind="stable")]
        state, draws = seed or 1, np.empty(2 * vocab * dim, np.float32)
        for k in range(len(draws)):
            state = (state * 6364136223846793005 + 1) & ((1 << 64) - 1)
            draws[k] = (state >> 40) / (1 << 24) * 2 - 1
        rows, out = (0.1 * draws).reshape(2, vocab, dim).astype(np.float32)
        bias = np.zeros(vocab, np.float32)
        pairs = [(a, b) for a, b in zip(own, own[1:], strict=False) if a < vocab and b < vocab]
        for epoch in range(epochs):
            total = 0.0
            for a, b in pairs:
                h = rows[a].copy()
                z = (out @ h + bias).astype(np.float64)
                p = np.exp(z - z.max())
                p /= p.sum()
                total -= np.log(max(p[b], 1e-12))
                dz = p.astype(np.float32)
                dz[b] -= 1
                back = dz @ out
                out -= rate * np.outer(dz, h)
                bias -= rate * dz
                rows[a] = h - rate * back
            yield pa.RecordBatch.from_pydict({"epoch": pa.array([epoch], pa.int32()), "loss": pa.array([total / len(pairs) if pairs else 0.0], pa.float64())})

    return tokens.select(F.col("pos").cast("long"), F.col("token").cast("int")).repartition(1).mapInArrow(train, "epoch int, loss double")
