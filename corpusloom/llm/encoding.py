"""Text decoded with a wrong character encoding: find it, name the chain, undo it.

A chain is one or two steps "written as A, read as B".  A multinomial
classifier over hashed byte bigrams, trained on words of the corpus garbled by
every chain, predicts the chain of each word that is not ASCII (ASCII is the
same under all chains).  A prediction counts only if the chain can be inverted
strictly and the inverted word is likelier as intact text than the word itself:
by its bytes, and by how often either form occurs in all documents, which a
count sketch of fixed size tells.  U+FFFD in place of a part of a word marks
text that is lost for good; by itself or in quotation marks it is quoted.
"""

from __future__ import annotations

import codecs
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Single-byte code pages that text is commonly misread as.
PAGES = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1254", "iso8859-2", "iso8859-15", "cp437", "cp850", "cp866", "koi8-r", "mac-roman")

#: Fixed values: (written as, read as), repeated for text that went wrong twice.
CHAINS: tuple[tuple[tuple[str, str], ...], ...] = (
    *((("utf-8", page),) for page in PAGES),
    (("utf-8", "cp1252"), ("utf-8", "cp1252")),
    (("utf-8", "latin-1"), ("utf-8", "latin-1")),
    (("utf-8", "latin-1"), ("utf-8", "cp1252")),
    (("utf-8", "cp1252"), ("utf-8", "latin-1")),
    *((("cp1252", page),) for page in ("cp1250", "cp1251", "cp437", "cp850", "mac-roman", "koi8-r")),
    *((("cp1251", page),) for page in ("cp1252", "cp866", "koi8-r", "mac-roman", "cp437")),
    *((("koi8-r", page),) for page in ("cp1251", "cp1252", "cp866")),
    *((("cp866", page),) for page in ("cp1251", "cp1252", "koi8-r")),
    *((("mac-roman", page),) for page in ("cp1252",)),
    *((("cp850", page),) for page in ("cp1252",)),
    *((("cp437", page),) for page in ("cp1252",)),
)

CELLS = 1 << 13
#: Cells of each of the two rows of the count sketch.
COUNT_BITS = 20
_WORD = re.compile(r"[^ \t\r\n\v\f]*[^\x00-\x7f \t\r\n\v\f][^ \t\r\n\v\f]*")
_LOST = "�"
_BROKEN_WORD = re.compile(r"[^\W_]�|�[^\W_]")
_MARKS = re.compile("[‘’“”„«»…–—•]")
_PUNCT = string.punctuation


def _page(name: str) -> tuple[str, dict[int, int]]:
    """Decoding table of a page, undefined bytes read as the control of that number, and its inverse."""
    table = "".join(bytes([b]).decode(name, "ignore") or chr(b) for b in range(256))
    return table, {ord(c): b for b, c in reversed(list(enumerate(table)))}


_TABLES = {name: _page(name) for name in PAGES}


def garble(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text after the chain went wrong; None if it can't be written that way."""
    try:
        for written, read in chain:
            data = text.encode("utf-8") if written == "utf-8" else codecs.charmap_encode(text, "strict", _TABLES[written][1])[0]
            text = codecs.charmap_decode(data, "strict", _TABLES[read][0])[0]
        return text
    except UnicodeError:
        return None


def as_bytes(text: str, page: str) -> bytes | None:
    """The bytes that the page reads as the text, None if there are none."""
    try:
        return codecs.charmap_encode(text, "strict", _TABLES[page][1])[0]
    except UnicodeError:
        return None


def restore(text: str, chain: tuple[tuple[str, str], ...], first: bytes | None = None) -> str | None:
    """The text before the chain; None unless every step decodes strictly. ``first`` are the bytes of the last step if known."""
    try:
        for written, read in reversed(chain):
            data = first if first is not None else codecs.charmap_encode(text, "strict", _TABLES[read][1])[0]
            first = None
            text = data.decode("utf-8") if written == "utf-8" else codecs.charmap_decode(data, "strict", _TABLES[written][0])[0]
        return text
    except UnicodeError:
        return None


def _cells(word: str) -> np.ndarray:
    b = np.frombuffer(f" {word} ".encode("utf-8", "replace"), np.uint8).astype(np.int64)
    return (b[:-1] * 8923 + b[1:] * 3571) % CELLS


@dataclass
class EncodingModel:
    """Log probabilities by cell and class, and log priors of the classes among words; class 0 is intact text, class k chain k - 1."""

    logp: np.ndarray
    prior: np.ndarray
    #: counts of words of all documents, without ASCII punctuation around them: two rows of a count sketch
    counts: np.ndarray
    #: log odds that a run of words of one chain must reach against intact text
    margin: float = 7.0
    #: weight of the classifier's odds where the chain has no UTF-8 step: any bytes decode then, and the bytes of a character aren't independent
    temper: float = 0.4
    known: dict[str, dict[int, tuple[float, str | None]]] = field(default_factory=dict, repr=False)
    #: by word, the chains whose odds are positive
    likely: dict[str, list[tuple[int, float]]] = field(default_factory=dict, repr=False)

    def count(self, word: str) -> int:
        """How often the word occurs in all documents, or more; words that look garbled count as none."""
        core = word.strip(_PUNCT)
        if not core or _suspect(core):
            return 0
        a, b = _count_cells(core)
        return int(min(self.counts[0, a], self.counts[1, b]))

    def word(self, word: str) -> dict[int, tuple[float, str | None]]:
        """By class, the log odds against intact text and the restored word.

        None instead of the word if it can't be restored; then the odds are at
        most 0.  Chains that leave the word as it is are left out.
        """
        found = self.known.get(word)
        if found is None:
            cells = _cells(word)
            scores = self.logp[cells].sum(axis=0) + self.prior
            found = {}
            own = np.log(self.count(word) + 0.5)
            data = {page: as_bytes(word, page) for page in PAGES}
            for k, chain in enumerate(CHAINS, 1):
                back = None if data[chain[-1][1]] is None else restore(word, chain, data[chain[-1][1]])
                if back == word:
                    continue
                odds = float(scores[k] - scores[0]) * (1.0 if _strict(chain) else self.temper)
                if back is None or _controls(back):
                    found[k] = (min(odds, -2.0), None)
                else:
                    # checked: the restored word has to be likelier than the word, per byte as lengths differ
                    gain = float(self.logp[_cells(back), 0].mean() - self.logp[cells, 0].mean())
                    odds += float(np.clip(np.log(self.count(back) + 0.5) - own, -6, 6))
                    if not _strict(chain):
                        odds += 4.0 * (_plain(back) - _plain(word))
                    found[k] = (odds, back) if gain > 0 else (min(odds, -1.0), None)
            if len(self.known) > 200_000:
                self.known.clear()
                self.likely.clear()
            self.known[word] = found
            self.likely[word] = [(k, odds) for k, (odds, _) in found.items() if odds > 0]
        return found

    def runs(self, words: list[str]) -> list[tuple[int, int, int, float]]:
        """Runs (first, last, class, odds) of words garbled by one chain, the likeliest first, without overlaps."""
        best: list[tuple[float, int, int, int]] = []
        by_chain: dict[int, list[tuple[int, float]]] = {}
        # a run has no more than the positive odds of its words, each once: other chains have no run
        most: Counter[int] = Counter()
        for w in set(words):
            self.word(w)
            for k, odds in self.likely[w]:
                most[k] += odds
        for k in sorted(k for k, odds in most.items() if odds >= self.margin):
            by_chain[k] = [(i, self.word(w)[k][0]) for i, w in enumerate(words) if k in self.word(w)]
        for k, odds in by_chain.items():
            total, start, top, span = 0.0, 0, 0.0, None
            counted: set[str] = set()  # a word that recurs in a run is no further evidence for it
            for i, o in [*odds, (len(words), -1e9)]:
                if total <= 0:
                    total, start = 0.0, i
                    counted.clear()
                if i == len(words) or o < 0 or words[i] not in counted:
                    total += o
                    counted.add(words[i] if i < len(words) else "")
                if total > top:
                    top, span = total, (start, i)
                if total <= 0 or top - total > self.margin:
                    if span and top >= self.margin:
                        best.append((top, *span, k))
                    total, top, span = 0.0, 0.0, None
        out: list[tuple[int, int, int, float]] = []
        for top, a, b, k in sorted(best, reverse=True):
            if all(b < x or a > y for x, y, _, _ in out):
                out.append((a, b, k, top))
        return out

    def _quoted(self, word: str, k: int) -> bool:
        """A sequence that stands for one letter or quotation mark and is no part of a word."""
        back = self.word(word).get(k, (0, None))[1]
        core = (back or "").strip(_PUNCT + "“”«»„")
        return back is None or len(core) == 0 and len(back.strip(_PUNCT)) <= 1 and back.strip(_PUNCT) in "“”«»„" or len(core) == 1 and (core.isalpha() or core in "‘’")

    def document(self, text: str) -> tuple[bool, list[str], str | None]:
        """(is garbled, chains, restored text or None if something is lost)."""
        if text.isascii():
            return False, [], text
        words = _WORD.findall(text)
        runs, lost = self.runs(words), _LOST in text and bool(_BROKEN_WORD.search(text))
        if all(self._quoted(words[i], k) for a, b, k, _ in runs for i in range(a, b + 1)):
            runs = []  # the text shows such sequences but isn't garbled itself
        if not runs and not lost:
            return False, [], text
        back = list(words)
        for a, b, k, _ in runs:
            for i in range(a, b + 1):
                back[i] = self.word(words[i]).get(k, (0, None))[1] or words[i]
        fixed = iter(back)
        chains = sorted({name(CHAINS[k - 1]) for _, _, k, _ in runs} | ({"lost"} if lost else set()))
        return True, chains, None if lost else _WORD.sub(lambda _: next(fixed), text)


def _plain(word: str) -> bool:
    """ASCII but for typographic marks."""
    return _MARKS.sub("", word).isascii()


def _strict(chain: tuple[tuple[str, str], ...]) -> bool:
    return any(written == "utf-8" for written, _ in chain)


def _controls(text: str) -> bool:
    return any("\x7f" <= c <= "\x9f" or c < " " for c in text)


def name(chain: tuple[tuple[str, str], ...]) -> str:
    return ", ".join(f"{a} as {b}" for a, b in chain)


def _suspect(word: str) -> bool:
    """Words left out of the intact training words: they invert from UTF-8, hold controls or mix alphabets."""
    if _LOST in word or _controls(word) or re.search(r"[A-Za-zÀ-ɏ][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-zÀ-ɏ]", word):
        return True
    return any(restore(word, chain) not in (None, word) for chain in CHAINS if chain[0][0] == "utf-8")


def train(words: list[tuple[str, int]], counts: np.ndarray | None = None) -> EncodingModel:
    """Fit on (word, count) of words that are mostly intact. Words all in capitals are added with a tenth of the weight.

    ``counts`` are the sketch of all documents; of these words alone if there are none.
    """
    by_cell = np.full((CELLS, len(CHAINS) + 1), 0.02)
    mass = np.full(len(CHAINS) + 1, 1e-3)
    own = np.zeros((2, 1 << COUNT_BITS), np.int64)
    for word, n in words:
        if _suspect(word):
            continue
        if core := word.strip(_PUNCT):
            a, b = _count_cells(core)
            own[0, a] += n
            own[1, b] += n
        for form, w in ((word, n), (word.upper(), n * 0.1)):
            np.add.at(by_cell[:, 0], _cells(form), w)
            mass[0] += w
            for k, chain in enumerate(CHAINS, 1):
                bad = garble(form, chain)
                if bad is not None and bad != form and restore(bad, chain) == form:
                    np.add.at(by_cell[:, k], _cells(bad), w)
                    mass[k] += w
    return EncodingModel(np.log(by_cell / by_cell.sum(axis=0)), np.log(mass / mass[0]), own if counts is None else counts)


def _count_cells(word: str) -> tuple[int, int]:
    h = xxhash.xxh64_intdigest(word)
    return h >> (64 - COUNT_BITS), h & ((1 << COUNT_BITS) - 1)


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: Counter[str] = Counter()
        for text in batch["text"]:
            counts.update(_WORD.findall(text))
        yield pd.DataFrame({"word": list(counts.keys()), "n": list(counts.values())}, columns=["word", "n"])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of this task's words by cell of both rows."""
    total = np.zeros(2 << COUNT_BITS, np.int64)
    for b in batches:
        parts = pc.ascii_split_whitespace(b.column("text"))
        coded = parts.flatten().dictionary_encode()
        n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
        bare = pc.ascii_trim(coded.dictionary, characters=_PUNCT).to_pylist()
        h = np.fromiter((xxhash.xxh64_intdigest(w) for w in bare), np.uint64, len(bare))
        for cells in ((h >> np.uint64(64 - COUNT_BITS)).astype(np.int64), (h & np.uint64((1 << COUNT_BITS) - 1)).astype(np.int64) + (1 << COUNT_BITS)):
            total += np.bincount(cells, weights=n, minlength=len(total)).astype(np.int64)
    cells = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], names=["cell", "n"])


def word_counts(documents: DataFrame) -> np.ndarray:
    """The count sketch of the words of all documents; as many cells come to the driver as the sketch has, whatever the data."""
    table = documents.select(F.col("text").cast("string").alias("text")).where("text is not null").mapInArrow(_sketch, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 << COUNT_BITS, np.int64)
    out[table["cell"].to_numpy()] = table["n"].to_numpy()
    return out.reshape(2, -1)


def fit_encoding(documents: DataFrame, sample_docs: int = 4000, sample_words: int = 20_000) -> EncodingModel:
    """Counts of words over all documents; the classifier is trained on the ``sample_words`` most frequent words of about ``sample_docs`` documents.

    The sample is drawn by a share of the id hashes, in every task by itself.
    """
    parts = 1 << 30
    share = min(parts, int(parts * sample_docs / max(1, documents.count())) + 1)
    sample = documents.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(parts)) < share).select("text").where("text is not null and text rlike '[^\\\\x00-\\\\x7F]'")
    words = sample.mapInPandas(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(sample_words)
    return train([(r["word"], r["n"]) for r in words.collect()], word_counts(documents))


def garbled(documents: DataFrame, model: EncodingModel) -> DataFrame:
    """doc_id, chains array<string>, restored string (null where something was lost) of the affected documents.

    Null and empty texts are intact.  Other columns are not read; rows with the
    same doc_id and text come out once.
    """

    shared = documents.sparkSession.sparkContext.broadcast((model.logp, model.prior, model.counts, model.margin, model.temper))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = EncodingModel(*shared.value)
        for batch in batches:
            rows = [(i, *found[1:]) for i, text in zip(batch["doc_id"], batch["text"], strict=True) if (found := model.document(text))[0]]
            yield pd.DataFrame(rows, columns=["doc_id", "chains", "restored"])

    odd = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null and text rlike '[^\\\\x00-\\\\x7F]'")
    return odd.mapInPandas(run, "doc_id long, chains array<string>, restored string").distinct()
