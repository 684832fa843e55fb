"""Evaluation results: losses, multiple choice, generated answers and suites."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import END_TOOL, IGNORE, TOOL_CALL
from ..functions.sampling import argmax
from .prefix import least_before


def token_scores(scores: DataFrame, by: list[str]) -> DataFrame:
    """Weighted by tokens: loss, perplexity, bits per token, top-1 and top-5 accuracy of rows with nll and rank."""
    row = scores.groupBy(*by).agg(F.count("*").alias("n_tokens"), (F.sum("nll") / F.count("*")).alias("loss"), (F.count_if(F.col("rank") <= 1) / F.count("*")).alias("top1"), (F.count_if(F.col("rank") <= 5) / F.count("*")).alias("top5"))
    return row.select("*", F.exp("loss").alias("perplexity"), (F.col("loss") / F.log(F.lit(2.0))).alias("bits_per_token"))


def target_loss(total: Column, n: Column, cap: float = 20.0) -> tuple[Column, Column]:
    """(loss, perplexity) of a sum over n targets; both infinite without targets."""
    loss = F.when(n > 0, total / n).otherwise(F.lit(float("inf")))
    return loss, F.when(n > 0, F.exp(F.least(loss, F.lit(cap)))).otherwise(F.lit(float("inf")))


def weighted_batches(batches: DataFrame) -> DataFrame:
    """Mean loss and accuracy of batches (loss, accuracy, n_targets) by their targets; batches without targets don't count."""
    some = batches.where("n_targets > 0")
    return some.agg(F.sum("n_targets").alias("n_targets"), (F.sum(F.col("loss") * F.col("n_targets")) / F.sum("n_targets")).alias("loss"), (F.sum(F.floor(F.col("accuracy") * F.col("n_targets"))) / F.sum("n_targets")).alias("accuracy"))


def mean_of_batches(batches: DataFrame) -> DataFrame:
    """Every batch counts the same; NaN without batches."""
    return batches.agg(F.coalesce(F.avg("loss"), F.lit(float("nan"))).alias("loss"))


def choose(scores: DataFrame, normalised: bool) -> DataFrame:
    """item_id, choice: the first best sum of log probabilities, per token if ``normalised``."""
    sums = scores.groupBy("item_id", "choice").agg(F.sum("logprob").alias("s"), F.count("*").alias("n"))
    return argmax(sums.withColumn("v", F.col("s") / F.col("n") if normalised else F.col("s")), "item_id", "v", "choice").select("item_id", "choice")


def throughput(timed: DataFrame, by: str, seconds: str) -> DataFrame:
    """by, n, per_second: items over the seconds they took, by group and in total (by = null); null if no time passed."""
    rows = timed.select(F.coalesce(by, F.lit("unknown")).alias(by), seconds)
    return rows.rollup(by).agg(F.count("*").alias("n"), (F.count("*") / F.nullif(F.sum(seconds), F.lit(0.0))).alias("per_second"))


def accuracy(scores: DataFrame, labels: DataFrame, by: str) -> DataFrame:
    """by, n, acc, acc_norm by group, and the total with by = null, in one pass of grouping sets."""
    raw = choose(scores, False).withColumnRenamed("choice", "raw")
    norm = choose(scores, True).withColumnRenamed("choice", "norm")
    judged = labels.join(raw, "item_id").join(norm, "item_id").select(F.coalesce(by, F.lit("unknown")).alias(by), (F.col("raw") == F.col("label")).cast("int").alias("r"), (F.col("norm") == F.col("label")).cast("int").alias("m"))
    return judged.rollup(by).agg(F.count("*").alias("n"), F.avg("r").alias("acc"), F.avg("m").alias("acc_norm"))


def matches(generated: Column, reference: Column, mode: Column, ids: Column | None = None, expected: Column | None = None, decode: Callable[[Column], Column] | None = None) -> Column:
    """exact: the same after trimming; tool: the generated ``ids`` hold a valid call, of the ``expected`` tool if there is one; else the reference in the text, whatever the case.

    Without ids and their decoder no tool answer matches.
    """
    text = F.when(mode == "exact", F.trim(generated) == F.trim(reference))
    call = valid_call(decode(tool_call_body(ids)), expected) if ids is not None and decode is not None else F.lit(False)
    return text.when(mode == "tool", call).otherwise(F.contains(F.lower(generated), F.lower(F.trim(reference))))


def tool_call_body(ids: Column) -> Column:
    """Ids between the call's opening and closing token; null without both in this order."""
    a = F.array_position(ids, TOOL_CALL)
    rest = F.slice(ids, (a + 1).cast("int"), F.size(ids))
    b = F.array_position(rest, END_TOOL)
    return F.when((a > 0) & (b > 0), F.slice(rest, 1, (b - 1).cast("int")))


def valid_call(payload: Column, expected: Column) -> Column:
    """Whether the text is a JSON object with a name, the expected one if given."""
    name = F.get_json_object(payload, "$.name")
    return F.coalesce(F.try_parse_json(payload).isNotNull() & name.isNotNull() & (expected.isNull() | (name == expected)), F.lit(False))


def suite(tasks: DataFrame) -> DataFrame:
    """Macro average of correct / n over tasks with items that aren't perplexity tasks."""
    return tasks.where("metric <> 'ppl' and n > 0").agg(F.count("*").alias("n_tasks"), F.avg(F.col("correct") / F.col("n")).alias("average"))


def chance_corrected(score: Column, chance: Column) -> Column:
    return F.greatest(F.lit(0.0), (score - chance) / (1 - chance))


def cross_entropy(logits: Column, target: Column, z: float = 0.0) -> Column:
    """-log softmax at the 0-based target, plus z times the squared log normaliser; null for ignored targets."""
    top = F.array_max(logits)
    lse = top + F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    return F.when(target != IGNORE, lse - F.element_at(logits, target + 1) + z * lse * lse)


def masked_cross_entropy(rows: DataFrame, logits: str, target: str, z: float = 0.0) -> DataFrame:
    """One row: n_targets and the mean loss over the targets that aren't ignored. Without any the query fails, as the mean of none is no loss."""
    some = rows.agg(F.count_if(F.col(target) != IGNORE).alias("n_targets"), F.avg(cross_entropy(F.col(logits), F.col(target), z)).alias("loss"))
    return some.select("n_targets", F.when(F.col("n_targets") == 0, F.raise_error(F.lit("all targets are ignored")).cast("double")).otherwise(F.col("loss")).alias("loss"))


def repeated_best(values: DataFrame, order: str, loss: str) -> DataFrame:
    """Adds is_best: the loss is below every one before."""
    return least_before(values, order, loss, "_before").withColumn("is_best", F.coalesce(F.col(loss) < F.col("_before"), F.lit(True))).drop("_before")
