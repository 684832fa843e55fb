"""Scans of JSON lines: every line is classified, none is lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line string of text files. Order within a file isn't part of the result; number lines by a key of the data."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def _kind(value: Column) -> Column:
    """Type of a variant: OBJECT, ARRAY, STRING, VOID, ... in upper case without parameters."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


_NAMES = {"BIGINT": "int", "DECIMAL": "float", "DOUBLE": "float", "BOOLEAN": "bool", "ARRAY": "list", "OBJECT": "dict"}


def _type_name(kind: Column) -> Column:
    out = F.lit("other")
    for k, v in _NAMES.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def corpus_records(lines: DataFrame) -> DataFrame:
    """Adds text (trimmed) and reason for corpus lines; empty lines are left out, reason is null for valid ones.

    The first of these counts: json_error, not_a_dict, missing_text_field (also
    null), text_not_string with the type, empty_text.  Repeated keys and NaN
    are JSON errors.
    """
    v = F.try_parse_json("line")
    kind = _kind(v)
    text = F.try_variant_get(v, "$.text", "string")
    field = F.try_variant_get(v, "$.text", "variant")
    inner = _kind(field)
    reason = (
        F.when(v.isNull(), "json_error")
        .when(kind != "OBJECT", "not_a_dict")
        .when(field.isNull() | (inner == "VOID"), "missing_text_field")
        .when(inner != "STRING", F.concat(F.lit("text_not_string: "), _type_name(inner)))
        .when(strip(text) == "", "empty_text")
    )
    return lines.where("line <> ''").withColumn("reason", reason).withColumn("text", F.when(F.col("reason").isNull(), strip(text)))


def extracted(lines: DataFrame) -> DataFrame:
    """Adds text and reason under the rules of tokenizer corpora: text isn't trimmed, may be empty, and null is a wrong type.

    ``line`` may be binary; bytes that aren't UTF-8 are invalid_unicode.  Blank
    lines have the reason blank.
    """
    line = F.col("line")
    decoded = F.try_validate_utf8(line.cast("string"))
    v = F.try_parse_json(decoded)
    field = F.try_variant_get(v, "$.text", "variant")
    inner = _kind(field)
    reason = (
        F.when(decoded.isNull(), "invalid_unicode")
        .when(strip(decoded) == "", "blank")
        .when(v.isNull(), "invalid_json")
        .when((_kind(v) != "OBJECT") | field.isNull(), "missing_text_field")
        .when(inner != "STRING", "invalid_text_type")
    )
    return lines.withColumn("reason", reason).withColumn("text", F.when(F.col("reason").isNull(), F.try_variant_get(v, "$.text", "string")))


def loose_texts(lines: DataFrame) -> DataFrame:
    """text from the string under text, else under content; line breaks become spaces; blank results and broken lines are skipped."""
    v = F.try_parse_json("line")

    def pick(k: str) -> Column:
        found = F.when(_kind(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING", F.try_variant_get(v, f"$.{k}", "string"))
        return F.nullif(found, F.lit(""))

    text = strip(F.replace(F.coalesce(pick("text"), pick("content"), F.lit("")), F.lit("\n"), F.lit(" ")))
    return lines.select("*", text.alias("text")).where("text <> ''")


def samples(lines: DataFrame, order: str, limit: int | None = None) -> DataFrame:
    """Adds format, instruction, input, output and messages of usable sample lines.

    Skipped: blank lines, lines that start with #, broken JSON and samples of
    neither form.  messages win over instruction and output; ``limit`` counts
    usable samples in the given order.
    """
    messages_type = "array<struct<role:string,content:string>>"
    v = F.try_parse_json("line")
    get = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    has = lambda k: F.try_variant_get(v, f"$.{k}", "variant").isNotNull()
    messages = F.try_variant_get(v, "$.messages", messages_type)
    whole = (F.size(messages) > 0) & F.forall(messages, lambda m: m["role"].isNotNull() & m["content"].isNotNull())
    form = F.when(has("messages"), F.when(F.coalesce(whole, F.lit(False)), "conversation")).when(has("instruction") & has("output"), "alpaca")
    kept = lines.where((strip("line") != "") & ~F.startswith(F.ltrim("line"), F.lit("#"))).withColumn("format", form).where("format is not null")
    alpaca = F.col("format") == "alpaca"
    out = kept.withColumn("messages", F.when(~alpaca, messages)).withColumn("instruction", F.when(alpaca, strip(F.coalesce(get("instruction"), F.lit(""))))).withColumn("input", F.when(alpaca, strip(F.coalesce(get("input"), F.lit(""))))).withColumn("output", F.when(alpaca, strip(F.coalesce(get("output"), F.lit("")))))
    return out if limit is None else out.orderBy(order).limit(limit)


def merge_domains(parts: dict[str, DataFrame]) -> DataFrame:
    """One corpus of several; the domain is kept, columns that some lack are null."""
    merged = None
    for domain, df in sorted(parts.items()):
        named = df.withColumn("domain", F.lit(domain))
        merged = named if merged is None else merged.unionByName(named, allowMissingColumns=True)
    return merged
