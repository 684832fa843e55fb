"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import WHITESPACE
from ..functions.tokens import marked, stub_ids
from ..session import read_table

WS = "'" + WHITESPACE + "'"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, sf, name)


def tokenized(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, tokens of all documents under the tokenizer for tests, with an end token."""
    return table(spark, sf, "documents").select("doc_id", marked(stub_ids("text")).alias("tokens"))


#: The same in SQL.
TOKENIZED = "(select doc_id, list_append(list_transform(string_split(text, ''), lambda c: unicode(c) % 500 + 3), 3) as tokens from documents)"


def alpaca(spark: SparkSession, sf: str) -> DataFrame:
    """Instruction samples, a delivery each."""
    return table(spark, sf, "alpaca_samples").select("sample_id", "source", "instruction", "input", "output").distinct()


ALPACA = "(select distinct sample_id, source, instruction, input, output from alpaca_samples)"


def chats(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations, a delivery each: found by the id and a hash of the content, as whole conversations need not be shuffled for it."""
    return table(spark, sf, "chat_samples").select("sample_id", "source", "messages").dropDuplicates(["sample_id"])


CHATS = "(select sample_id, any_value(source) as source, any_value(messages) as messages from chat_samples group by sample_id)"

#: A valid conversation in SQL.
VALID_CHAT = f"""(messages is not null and len(messages) > 0
 and len(list_filter(messages, lambda m: coalesce(m.role not in ('system','user','assistant'), true))) = 0
 and len(list_filter(messages, lambda m: coalesce(trim(m.content, {WS}) = '', true))) = 0
 and len(list_filter(messages, lambda m: m.role = 'user')) > 0
 and len(list_filter(messages, lambda m: m.role = 'assistant')) > 0)"""


def digest(items: Column) -> Column:
    """One string for a list of numbers, for comparing with SQL."""
    return F.md5(F.array_join(items.cast("array<string>"), ","))


def sql_digest(items: str) -> str:
    return f"md5(array_to_string({items}, ','))"


def score(*parts: str) -> Column:
    """A number from 0 to 1 by hash, as stand-in for a model's score."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(F.col(p).cast("string") for p in parts))), 1, 6), 16, 10).cast("double") / 16777216.0


def sql_score(*parts: str) -> str:
    joined = ", ".join(f"cast({p} as varchar)" for p in parts)
    return f"(cast(('0x' || substr(md5(concat_ws('|', {joined})), 1, 6)) as bigint) / 16777216.0)"
