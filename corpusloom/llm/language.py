"""A language classifier trained on labelled documents: hashed words, and hashed letter triples of words it doesn't know.

Labels may be spelled unevenly, missing or wrong now and then: the part before
a hyphen counts, in lower case; labels that aren't two or three letters, or
that few documents have, teach nothing.  Counts are smoothed towards the mean
of the languages, so a word that no language prefers says nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD_BITS, GRAM_BITS = 17, 15
#: Labelled documents the classifier is trained on, about.
SAMPLE = 4000
#: Share of the labelled documents below which a label is taken for a mistake.
RARE_LABEL = 0.005
#: Occurrences from which a word is known by itself.
KNOWN = 5
#: Words that smoothing is worth.
MASS = 20_000.0

#: Marks beside words; with others a token is no word.
_BESIDE = ".,;:!?…\"“”„«»()¿¡"
_PUNCT = "!\"#$%&()*+,./:;<=>?@[\\]^`{|}~“”„«»…–—¿¡‘"


def _cell(text: str, bits: int) -> int:
    return xxhash.xxh64_intdigest(text) >> (64 - bits)


def _grams(word: str) -> list[int]:
    w = f" {word} "
    return [_cell(w[i : i + 3], GRAM_BITS) for i in range(len(w) - 2)]


def coded_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(row of each token, id of each token, tokens by id): tokens in lower case between white space and apostrophes."""
    arr = pc.replace_substring_regex(pc.utf8_lower(pa.array(texts, pa.string())), "['’]", " ")
    parts = pc.utf8_split_whitespace(arr)
    rows = np.repeat(np.arange(len(parts), dtype=np.int64), np.diff(parts.offsets.to_numpy()))
    coded = parts.flatten().dictionary_encode()
    return rows, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


@dataclass
class LanguageModel:
    """Log probabilities by cell and language, less their mean over the languages, and how often each word cell was seen."""

    languages: tuple[str, ...]
    words: np.ndarray
    grams: np.ndarray
    seen: np.ndarray
    #: the counts it was fitted on: label, kind, cell, n
    table: pd.DataFrame | None = field(default=None, repr=False)
    _known: dict[str, int] = field(default_factory=dict, repr=False)
    _rows: list[np.ndarray] = field(default_factory=list, repr=False)

    def state(self) -> tuple:
        return self.languages, self.words, self.grams, self.seen

    def _vector(self, token: str) -> int:
        """Place of the token's evidence (by words, by letters, 1); 0 is that of tokens that are no words: identifiers, addresses and numbers speak no language."""
        word = token if token.isalpha() else token.strip(_BESIDE)
        if not word.isalpha():
            return 0
        at = self._known.get(word)
        if at is None:
            by_gram = np.clip(0.5 * self.grams[_grams(word)].sum(axis=0), -4, 4)
            cell = _cell(word, WORD_BITS)
            by_word = np.clip(self.words[cell], -6, 6) if self.seen[cell] >= KNOWN else by_gram
            at = self._known[word] = len(self._rows)
            self._rows.append(np.concatenate([by_word, by_gram, [1.0]]))
        return at

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(evidence by text and language, the same by letters alone, number of words)."""
        n, k = len(texts), len(self.languages)
        if not n or not k:
            return np.zeros((n, k)), np.zeros((n, k)), np.zeros(n)
        if len(self._rows) > 200_000 or not self._rows:
            self._known.clear()
            self._rows[:] = [np.zeros(2 * k + 1)]
        rows, ids, tokens = coded_words(texts)
        at = np.array([self._vector(t) for t in tokens], np.int64)
        if not len(at):
            return np.zeros((n, k)), np.zeros((n, k)), np.zeros(n)
        table = np.stack([self._rows[i] for i in at])
        sums = np.stack([np.bincount(rows, weights=table[ids, j], minlength=n) for j in range(2 * k + 1)], axis=1)
        return sums[:, :k], sums[:, k : 2 * k], sums[:, 2 * k]


def leading(scores: np.ndarray, least: float) -> np.ndarray:
    """Index of the language that leads by ``least`` or more in each row, -1 if none does."""
    if scores.shape[1] < 2:
        return np.full(len(scores), -1)
    order = np.sort(scores, axis=1)
    return np.where(order[:, -1] - order[:, -2] >= least, scores.argmax(axis=1), -1)


def no_languages() -> LanguageModel:
    return LanguageModel((), np.zeros((1 << WORD_BITS, 0)), np.zeros((1 << GRAM_BITS, 0)), np.zeros(1 << WORD_BITS))


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of words (kind 0), letter triples (1) and documents (2) by label."""
    out: dict[tuple[str, int, int], int] = {}
    for b in batches:
        rows, ids, tokens = coded_words(b["text"].tolist())
        labels = b["label"].tolist()
        words = [t.strip(_PUNCT) for t in tokens]
        cells = [(_cell(w, WORD_BITS), _grams(w)) if w.isalpha() else None for w in words]
        for label in set(labels):
            out[label, 2, 0] = out.get((label, 2, 0), 0) + labels.count(label)
            mine = np.isin(rows, [i for i, x in enumerate(labels) if x == label])
            n = np.bincount(ids[mine], minlength=len(tokens))
            for i in np.flatnonzero(n).tolist():
                if cells[i] is not None:
                    key = (label, 0, cells[i][0])
                    out[key] = out.get(key, 0) + int(n[i])
                    for g in cells[i][1]:
                        out[label, 1, g] = out.get((label, 1, g), 0) + int(n[i])
    yield pd.DataFrame([(*k, n) for k, n in out.items()], columns=["label", "kind", "cell", "n"]).astype({"kind": "int32", "cell": "int32", "n": "int64"})


def fit_languages(labelled: DataFrame, sample: int = SAMPLE, seed: int = 13) -> LanguageModel:
    """Fit on (id, text, lang); about ``sample`` documents are used, drawn by a share of the id hashes.

    Null labels, ids and texts are left out; without two languages the model
    knows none and every vote by it abstains.
    """
    label = F.regexp_extract(F.lower(F.trim("lang")), "^([a-z]{2,3})(?:-.*)?$", 1).alias("label")
    parts = 1 << 30
    share = min(parts, int(parts * sample / max(1, labelled.count())) + 1)
    drawn = labelled.where("id is not null and text is not null and lang is not null").where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(parts)) < share).select(label, "text").where("label <> ''")
    return _fitted(_counted(drawn))


def _counted(drawn: DataFrame) -> pd.DataFrame:
    """Counts of (label, text) of a sample, which bounds what comes to the driver."""
    return drawn.mapInPandas(_counts, "label string, kind int, cell int, n long").groupBy("label", "kind", "cell").agg(F.sum("n").alias("n")).toPandas()


def _fitted(table: pd.DataFrame) -> LanguageModel:
    docs = table[table["kind"] == 2].set_index("label")["n"]
    kept = tuple(sorted(x for x in docs.index if docs[x] >= RARE_LABEL * docs.sum()))
    if len(kept) < 2:
        return no_languages()
    found = []
    for kind, bits in ((0, WORD_BITS), (1, GRAM_BITS)):
        c = np.zeros((1 << bits, len(kept)))
        for j, x in enumerate(kept):
            mine = table[(table["kind"] == kind) & (table["label"] == x)]
            c[mine["cell"].to_numpy(), j] = mine["n"].to_numpy()
        total = np.maximum(c.sum(axis=0), 1)
        mean = (c / total).mean(axis=1, keepdims=True)
        logp = np.log((c + MASS * mean + 1e-3) / (total + MASS))
        found.append((c, (logp - logp.mean(axis=1, keepdims=True)) * (c.sum(axis=1, keepdims=True) > 0)))
    return LanguageModel(kept, found[0][1].astype(np.float32), found[1][1].astype(np.float32), found[0][0].sum(axis=1).astype(np.int32), table)


def taught(model: LanguageModel, pairs: DataFrame, least: float = 8.0) -> LanguageModel:
    """The model fitted once more, with the texts ``a`` of a sample of (a, b) labelled by the language of ``b`` where that is clear.

    Prompts and answers have words of their own that documents lack; most are of
    one language, and the few that aren't are too few to mislead.
    """
    if len(model.languages) < 2:
        return model
    shared = pairs.sparkSession.sparkContext.broadcast(model.state())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = LanguageModel(*shared.value)
        for b in batches:
            best = leading(own.score(b["b"].tolist())[0], least)
            yield from _counts(iter([pd.DataFrame({"label": [own.languages[i] for i in best[best >= 0]], "text": b["a"][best >= 0].tolist()})]))

    more = pairs.mapInPandas(run, "label string, kind int, cell int, n long").groupBy("label", "kind", "cell").agg(F.sum("n").alias("n")).toPandas()
    return _fitted(pd.concat([model.table, more[more["kind"] != 2]]).groupby(["label", "kind", "cell"], as_index=False)["n"].sum())
