"""Reject reasons, normalisation and validation of records and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import IGNORE, MAX_FIELD_CHARS, ROLES
from ..functions.text import strip


def blank(text: Column) -> Column:
    """Null or only white space."""
    return F.coalesce(strip(text) == "", F.lit(True))


def rejects_by_reason(classified: DataFrame, reason: str = "reason") -> DataFrame:
    """reason, n: every reject once, grouped by the part before a colon; most frequent first."""
    return classified.where(F.col(reason).isNotNull()).groupBy(F.split(reason, ":")[0].alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def is_conversation(sample: Column) -> Column:
    """For a variant: whether it has messages; they win over an instruction."""
    return F.coalesce(F.schema_of_variant(sample).startswith("OBJECT") & F.schema_of_variant(sample).rlike(r"OBJECT<(?:[^<>]*, )?messages:"), F.lit(False))


def alpaca_errors(instruction: Column, extra: Column, output: Column) -> Column:
    """Errors of a sample of three strings; a null input is none."""
    return F.filter(
        F.array(
            F.when(instruction.isNull(), "instruction missing").when(blank(instruction), "instruction empty"),
            F.when(output.isNull(), "output missing").when(blank(output), "output empty"),
        ),
        lambda e: e.isNotNull(),
    )


def long_fields(**fields: Column) -> Column:
    """Names of fields over the length limit, in order; they are warnings only."""
    return F.filter(F.array(*(F.when(F.length(c) > MAX_FIELD_CHARS, F.lit(n)) for n, c in fields.items())), lambda e: e.isNotNull())


def conversation_errors(messages: Column) -> Column:
    """All errors of a conversation, in order of the messages, then missing roles. Null or empty messages have one error."""
    per_message = F.flatten(
        F.transform(
            messages,
            lambda m, i: F.filter(
                F.array(
                    F.when(~F.coalesce(m["role"].isin(*ROLES), F.lit(False)), F.concat(F.lit("messages["), i.cast("string"), F.lit("] unknown role"))),
                    F.when(blank(m["content"]), F.concat(F.lit("messages["), i.cast("string"), F.lit("] empty content"))),
                ),
                lambda e: e.isNotNull(),
            ),
        )
    )
    lacks = lambda role: ~F.exists(messages, lambda m: F.coalesce(m["role"] == role, F.lit(False)))
    missing = F.filter(F.array(F.when(lacks("user"), "no user turn"), F.when(lacks("assistant"), "no assistant turn")), lambda e: e.isNotNull())
    return F.when(messages.isNull() | (F.size(messages) == 0), F.array(F.lit("messages missing or empty"))).otherwise(F.concat(per_message, missing))


def validate(samples: DataFrame, errors: Column, strict: bool = False, index: str | None = None) -> DataFrame:
    """Adds errors and valid. Strict mode raises at the smallest invalid index when the result is computed."""
    out = samples.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)
    if not strict:
        return out
    first = out.where(~F.col("valid")).agg(F.min(index).alias("_bad"))
    checked = out.crossJoin(F.broadcast(first))
    guard = F.when(F.col("_bad").isNotNull(), F.raise_error(F.concat(F.lit("invalid sample at index "), F.col("_bad").cast("string"))).cast("boolean")).otherwise(F.col("valid"))
    return checked.withColumn("valid", guard).drop("_bad")


def validation_report(validated: DataFrame, index: str) -> DataFrame:
    """total, valid, invalid, dropped_pct and first_dropped; ``dropped_indices`` lists the dropped ones."""
    return validated.agg(
        F.count("*").alias("total"),
        F.count_if("valid").alias("valid"),
        F.count_if(~F.col("valid")).alias("invalid"),
        F.coalesce(F.count_if(~F.col("valid")) * 100.0 / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("dropped_pct"),
        F.min(F.when(~F.col("valid"), F.col(index))).alias("first_dropped"),
    )


def dropped_indices(validated: DataFrame, index: str) -> DataFrame:
    """index, first_error of the invalid samples: a row each, as they may be many."""
    return validated.where(~F.col("valid")).select(index, F.try_element_at("errors", F.lit(1)).alias("first_error"))


def trainable(labels: Column) -> Column:
    """Whether any label isn't ignored."""
    return F.exists(labels, lambda x: x != IGNORE)
