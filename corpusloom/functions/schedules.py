"""Schedules and budgets as closed forms over a column of steps or a table of presets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _cosine(progress: Column) -> Column:
    return 0.5 * (1.0 + F.cos(F.pi() * progress))


def warm_cosine(step: Column, peak: float, least: float, warmup: int, total: int) -> Column:
    """Linear warm-up from 0, cosine to ``least``, constant from ``total`` on."""
    rising = F.lit(peak) * (step / F.lit(max(1, warmup)))
    falling = least + _cosine((step - warmup) / max(1, total - warmup)) * (peak - least)
    return F.when(step < warmup, rising).when(step >= total, F.lit(least)).otherwise(falling)


def _share(step: Column, start: int, length: int) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - start) / max(1, length)))


def warm_stable_decay(step: Column, warmup: int, total: int, decay: int, least: float, form: str = "sqrt") -> Column:
    """Multiplier that is never 0 in warm-up, 1 until the decay and then falls by ``form``: linear, sqrt or cosine."""
    start = total - decay
    p = _share(step, start, decay)
    fall = {"linear": 1 - p, "sqrt": 1 - F.sqrt(p), "cosine": _cosine(p)}[form]
    stable = step < start if decay else F.lit(True)
    return F.when(step < warmup, (step + 1) / max(1, warmup)).when(stable, F.lit(1.0)).otherwise(least + (1 - least) * fall)


def cosine_multiplier(step: Column, warmup: int, total: int, least: float) -> Column:
    return F.when(step < warmup, (step + 1) / max(1, warmup)).otherwise(least + (1 - least) * _cosine(_share(step, warmup, total - warmup)))


def tuning_multiplier(step: Column, kind: str, warmup: int, total: int, least: float) -> Column:
    """Multipliers for tuning: cosine, linear or constant after a warm-up that starts at 1e-8."""
    progress = (step - warmup) / max(1, total - warmup)
    after = {"cosine": least + (1 - least) * _cosine(F.least(progress, F.lit(1.0))), "linear": F.greatest(F.lit(least), 1 - progress), "constant": F.lit(1.0)}[kind]
    return F.when(step < warmup, F.greatest(F.lit(1e-8), step / max(1, warmup))).otherwise(after) if warmup > 0 else after


def budget_verdict(epochs: Column) -> Column:
    return F.when(epochs <= 1.5, "data-rich").when(epochs <= 5.0, "well matched").otherwise("data-starved")


def model_sizes(df):
    """Adds parameters, cache bytes and FLOPs per token to a table of presets.

    Columns used: vocab, width, layers, heads, kv_heads, head_dim, context.
    """
    c = F.col
    hidden = F.floor((F.floor(c("width") * 8 / 3) + 63) / 64) * 64
    kv = c("kv_heads") * c("head_dim")
    attention = 2 * c("width") * c("heads") * c("head_dim") + 2 * c("width") * kv + 2 * c("head_dim")
    layer = attention + 3 * c("width") * hidden + 2 * c("width")
    out = df.withColumn("blocks", (layer * c("layers")).cast("long")).withColumn("embedding", (c("vocab") * c("width")).cast("long"))
    out = out.withColumn("total", c("embedding") + c("blocks") + c("width"))
    return out.withColumn("kv_bytes", (2 * c("layers") * c("context") * kv * 2).cast("long")).withColumn("flops_per_token", (6 * (c("total") - c("embedding")) + 12 * c("layers") * c("width") * c("context")).cast("long"))
