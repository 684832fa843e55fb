"""Tokenizers: an expression for tests and SQL, and subword models in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BOS, EOS, TOKEN_MAX
from .text import strip


def stub_ids(text: Column | str) -> Column:
    """One token per code point: code point modulo 500, plus 3. Null for null."""
    col = F.col(text) if isinstance(text, str) else text
    ids = F.transform(F.split(col, ""), lambda c: F.ascii(c) % 500 + 3)
    return F.when(col == "", F.array().cast("array<int>")).otherwise(ids)


def marked(ids: Column, bos: bool = False, eos: bool = True) -> Column:
    """With the begin and end token around."""
    parts = [F.array(F.lit(BOS))] * bos + [ids] + [F.array(F.lit(EOS))] * eos
    return F.concat(*parts)


def in_range(ids: Column) -> Column:
    """Whether all ids fit the two bytes of the token cache."""
    return F.forall(ids, lambda i: i.between(0, TOKEN_MAX))


def _lists(found: list[list[int] | None]) -> pa.Array:
    """Lists of ids as one Arrow array, without a Python object for each id on the way back."""
    sizes = np.fromiter((0 if x is None else len(x) for x in found), np.int64, len(found))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    flat = np.fromiter(chain.from_iterable(x for x in found if x is not None), np.int32, int(offsets[-1]))
    null = pa.array([x is None for x in found]) if None in found else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=null)


def batched_encoder(load: Callable[[], Callable[[list[str]], list[list[int]]]]):
    """A vectorised function text -> ids: ``load`` makes an encoder of many texts, once in each Python worker; a null text has null ids."""

    @F.arrow_udf("array<int>")
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        many = load()
        for part in texts:
            given = part.to_pylist()
            ids = iter(many([t for t in given if t is not None]))
            yield _lists([None if t is None else next(ids) for t in given])

    return encode


def piece_encoder(path: str):
    """A vectorised function text -> ids of a subword model; one model per Python worker."""

    def load():
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: model.encode(texts, num_threads=1)

    return batched_encoder(load)


def piece_decoder(path: str):
    """A vectorised function ids -> text of a subword model."""

    @F.pandas_udf("string")
    def decode(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for part in ids:
            yield pd.Series([None if i is None else model.decode([int(x) for x in i]) for i in part])

    return decode


def load_byte_model(path: str):
    """A byte-level vocabulary of ranks; the pattern that cuts words is beside it."""
    import base64
    import importlib.util
    from pathlib import Path

    import tiktoken

    spec = importlib.util.spec_from_file_location("public_tokenizers", Path(path).parent / "__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})


def byte_encoder(path: str):
    """A vectorised function text -> ids of a byte-level vocabulary of ranks."""

    def load():
        model = load_byte_model(path)
        return lambda texts: [model.encode_ordinary(t) for t in texts]

    return batched_encoder(load)


def byte_decoder(path: str):
    """A vectorised function ids -> text of a byte-level vocabulary of ranks."""

    @F.pandas_udf("string")
    def decode(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_byte_model(path)
        for part in ids:
            yield pd.Series([None if i is None else model.decode([int(x) for x in i]) for i in part])

    return decode


def json_encoder(path: str):
    """A vectorised function text -> ids of a tokenizer file in JSON; texts that look like special tokens are ordinary text."""

    def load():
        from tokenizers import Tokenizer as JsonTokenizer

        model = JsonTokenizer.from_file(path)
        model.encode_special_tokens = True
        return lambda texts: [model.encode(t, add_special_tokens=False).ids for t in texts]

    return batched_encoder(load)


@dataclass(frozen=True)
class Tokenizer:
    """What encoding needs of a tokenizer: column functions, the number of ids and the end token."""

    encode: Callable[[Column], Column]
    size: int
    eos: int | None
    decode: Callable[[Column], Column] | None = None

    def __post_init__(self) -> None:
        if self.eos is None or not 0 <= self.eos < self.size:
            raise ValueError("a tokenizer needs an end token among its ids")

    def ids(self, text: Column, bos: int | None = None, eos: bool = False) -> Column:
        parts = ([F.array(F.lit(bos))] if bos is not None else []) + [self.encode(text)] + ([F.array(F.lit(self.eos))] if eos else [])
        return F.concat(*parts)


def stub_tokenizer() -> Tokenizer:
    return Tokenizer(stub_ids, 503, EOS)


def piece_tokenizer(path: str) -> Tokenizer:
    """A subword model of a public vocabulary file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return Tokenizer(piece_encoder(path), model.get_piece_size(), model.eos_id() if model.eos_id() >= 0 else None, piece_decoder(path))


def training_lines(docs: DataFrame, text: str = "text", most_bytes: int = 16_384, lines: int = 20_000_000, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """Lines that a tokenizer would be trained on: one per text, line breaks as spaces, none blank or over the byte cap.

    ``lines`` is the sample a trainer takes; it is drawn by hash, so it is the
    same on every run.  Training itself is no job of this library.
    """
    flat = docs.select(key, strip(F.regexp_replace(text, "[\r\n]+", " ")).alias("line")).where("line <> ''").where(F.octet_length("line") <= most_bytes)
    total = flat.agg(F.count("*").alias("_n"))
    share = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) * 1.0 / (1 << 30)
    return flat.crossJoin(F.broadcast(total)).where(share < F.lit(float(lines)) / F.col("_n")).drop("_n")
