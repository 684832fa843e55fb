"""Defective prompt and answer pairs: labelling functions and a label model.

Several noisy labelling functions vote on each defect of an answer: 1 for, -1
against, 0 no opinion.  Votes are counted by pattern over all answers; an
expectation-maximization label model estimates from these counts how reliable
each function is and how probable the defect is given each pattern.  A pair
keeps every defect whose posterior exceeds its cutoff; cutoffs are validated on
all answers, made defective on purpose.  Both are voted on in one pass, which
reads the words and the languages of a text once.

Three of the voters are trained: the truncation classifier, a language
classifier (``language``), and a classifier of refusals, which learns from
bounded samples what answers that phrases give away have in common besides
these phrases.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_table, persist_table
from .language import LanguageModel, fit_languages, leading, no_languages, taught
from .leakage import common_sequence
from .truncation import WEIGHT_BITS, TruncationModel, _CLOSED, _DIGIT, logistic

DEFECTS = ("empty", "truncated", "refusal", "copy", "language")
#: Labelling functions of each defect.
VOTERS = {"empty": 4, "truncated": 3, "refusal": 5, "copy": 3, "language": 3}
#: Pairs the refusal classifier is trained on, about.
SAMPLE = 24_000

# Marks that stand for no content, without brackets and in lower case.
PLACEHOLDERS = frozenset(
    "none null nil nan n/a na n.a tbd tba todo empty blank undefined missing void"
    " no_response no_answer no_output no_content not_available not_applicable no_reply"
    " keine_antwort leer kein_inhalt sin_respuesta vacío vacio"
    " sans_réponse pas_de_réponse vide aucune_réponse sem_resposta vazio"
    " нет_ответа пусто".split()
)
# Words that are such marks in brackets only, as they answer questions.
BRACKETED = frozenset("keine ninguno ninguna aucun aucune nenhum нет no".split())

# Phrases by which an answer is declined.
REFUSALS = (
    r"\b(?:i|we)(?: (?:just|simply|really|also|must|will|would|do|may|shall))*(?:['’]m| am| are)? (?:not able|unable|not allowed|not permitted|not comfortable|not going|not in a position) to\b",
    r"\b(?:i|we) (?:can(?:no|['’])t|can not|cannot|won['’]t|will not|may not|must not|should not|shouldn['’]t|could not|am unable to|must decline|have to (?:decline|pass)|decline|refuse|prefer not|would rather not) ?(?:to )?(?:help|assist|answer|provide|discuss|comment|share|describe|support|do|respond|give|talk|explain|continue|fulfil|comply|disclose|on|this|that|with)?",
    r"\bno (?:answer|comment|help|details?|information) (?:can|will|may|on|is|could)\b",
    r"\bnot something (?:i|we) (?:can|could|will|may|want)\b",
    r"\b(?:i|we)['’]d (?:rather|prefer) not\b",
    r"\b(?:my|our|the) (?:guidelines|rules|policy|policies|instructions)\b.{0,40}\b(?:keep|prevent|forbid|follow|stop|do not allow|don['’]t allow)",
    r"\b(?:falls?|is|are|lies) (?:outside|off limits|beyond)\b",
    r"\bdo(?:n['’]t| not) feel comfortable\b",
    r"\blook elsewhere\b",
    r"\btalk about something (?:different|else)\b",
    r"\b(?:request|question) (?:has been |was |is |will )?(?:declined|denied|refused|rejected|not be (?:fulfilled|answered))\b",
    r"\bnot going to (?:walk|help|tell|explain|answer)\b",
    r"\b(?:would be|is) irresponsible\b",
    r"\bagainst (?:the|my|our) (?:rules|policy|policies|guidelines)\b",
    r"\b(?:kann|darf|möchte|werde|will|können|dürfen)\b.{0,60}\b(?:nicht|keine?n?)\b.{0,40}\b(?:helfen|beantworten|geben|antworten|sagen|auskunft|unterstützen|dienen|äußern|sprechen)",
    r"\b(?:nicht|keine?) (?:gestattet|erlaubt|möglich|befugt)\b",
    r"\bkeine (?:auskunft|antwort|angaben)\b|\b(?:mir|uns) (?:\w+ ){0,3}(?:verboten|untersagt)\b|\b(?:verboten|untersagt)\b.{0,30}\b(?:beantworten|sprechen|sagen|geben)",
    r"\bje (?:ne (?:peux|suis|souhaite|veux|dois|puis)|préfère ne)\b",
    r"\b(?:n['’]ai pas le droit|hors de mes|refuse de)\b|\bm['’](?:est|a été) (?:interdit|impossible|défendu)\b",
    r"\b(?:me (?:está|es|resulta) (?:prohibido|imposible|vedado)|tengo prohibido|me é (?:proibido|vedado)|estou proibid[oa])\b",
    r"\b(?:no (?:puedo|tengo permiso|me es posible|estoy autorizad[oa]|debo|voy a)|prefiero no)\b",
    r"\b(?:não (?:posso|tenho permissão|estou autorizad[oa]|devo|vou|consigo)|prefiro não)\b",
    r"(?:не могу|не стану|не буду|не имею права|не вправе|предпочитаю не|отказываюсь)",
)
OPENERS = (
    r"^\W*(?:i['’]?m (?:so |very |really )?sorry|sorry|i apologi[sz]e|(?:my |our )?apologies|unfortunately|regrettably|thanks? (?:you )?for asking|to be (?:direct|honest|clear)|after thinking about it|as (?:an? )?(?:language|ai|virtual|digital)\w* (?:assistant|model)|nope"
    r"|leider|es tut mir leid|tut mir leid|entschuldig\w*|verzeihung|bedaure|als (?:sprach|ki-)?(?:assistent\w*|modell\w*)"
    r"|désolée?|je suis désolée?|malheureusement|pardon|navrée?|en tant qu['’]|toutes mes excuses"
    r"|lo siento|disculp\w*|perdón|lamentablemente|por desgracia|como asistente"
    r"|desculp\w*|sinto muito|infelizmente|lamento|como assistente|извините|простите|к сожалению|сожалею|как помощник)"
)
_REFUSAL = re.compile("|".join(REFUSALS), re.I)
# Every refusal phrase holds one of these.
_STEMS = (
    "can't", "can’t", "cannot", "can not", "won't", "won’t", "will not", "may not", "must not", "should not", "shouldn", "could not", "unable", "declin", "refus", "have to pass", "prefer not",
    "rather not", "not able", "not allowed", "not permitted", "not comfortable", "not going", "not in a position", "not something", "not be ", "no answer", "no comment", "no help", "no detail",
    "no information", "my guidelines", "our guidelines", "the guidelines", "my rules", "our rules", "the rules", "my polic", "our polic", "the polic", "my instruction", "our instruction",
    "the instruction", "outside", "off limits", "beyond", "feel comfortable", "elsewhere", "about something", "denied", "reject", "irresponsible", "nicht", "kein", "verboten", "untersagt", "je ne", "préfère",
    "n'ai pas", "n’ai pas", "hors de mes", "m'est", "m’est", "m'a", "m’a", "no puedo", "no tengo", "no me es", "no estoy", "no debo", "no voy", "prefiero", "prohib", "imposib", "vedad", "não",
    "prefiro", "proibid", "не ", "отказ",
)
_ANY_STEM = "|".join(map(re.escape, _STEMS))
_OPENER = re.compile(OPENERS, re.I)
#: Words above which a refusal is told by the shares of its sentences, and up to which the classifier votes.
LONG, SHORT = 32, 70

# Phrases around a refusal that answer nothing: reasons by rules, sympathy, thanks, offers of something else.
COURTESIES = (
    r"\b(?:i|we) (?:\w+ )?(?:understand|appreciate|realize|realise|recognize|hope|regret|apologi[sz]e)\b",
    r"\b(?:my|our|these|this|those|the) (?:\w+ ){0,2}(?:policy|policies|guidelines|rules|instructions|terms)\b",
    r"\b(?:i|we)(?:['’]d| would|['’]ll| will| can|['’]m| am| are) (?:\w+ )?(?:happy|glad|pleased|gladly|happily|still|instead|suggest|encourage|recommend)\b",
    r"\b(?:feel free|let (?:me|us) know|please (?:reach|contact|ask|consult|understand)|hesitate to|thank you|thanks for|anything else|something else|patience|for (?:your|the) understanding|inconvenience)\b",
    r"\b(?:other|another|different) (?:\w+ )?(?:topics?|questions?|subjects?|requests?|matters?)\b",
    r"\b(?:verständnis|gerne|stattdessen|andere[nrsm]? (?:themen?|fragen?|anliegen)|richtlinien?|vorgaben|wenden sie sich|vielen dank|melden sie sich|zur verfügung)\b",
    r"\b(?:compréhension|volontiers|autres? (?:sujets?|questions?|demandes?)|n['’]hésitez pas|merci|à (?:votre|ta) disposition|(?:mes|nos|les) (?:règles|consignes)|avec plaisir|je comprends)\b",
    r"\b(?:comprensión|gracias|con gusto|otr[oa]s? (?:temas?|preguntas?|consultas?|asuntos?)|no dud(?:e|es)|encantad[oa]|a su disposición|(?:mis|nuestras|las) (?:normas|políticas|reglas)|entiendo|comprendo)\b",
    r"\b(?:compreensão|obrigad[oa]|outr[oa]s? (?:temas?|perguntas?|assuntos?|questões)|com prazer|à disposição|(?:minhas|nossas|as) (?:regras|diretrizes|políticas)|entendo|compreendo|não hesite)\b",
    r"(?:понимани|спасибо|с удовольствием|друг(?:ой|ие|им|ую|ому) (?:тем|вопрос)|обращайтесь|(?:мои|наши|эти) правила|понимаю)",
)
_COURTESY = re.compile("|".join(COURTESIES), re.I)
# Prompts that ask for a text that declines.
_ASKS_REFUSAL = re.compile(r"\b(?:declin(?:e|es|ing)|refus(?:e|es|al|ing)|reject(?:s|ion|ing)?|turn(?:ing)? down|ablehn\w*|absage\w*|refuser|refus|décliner|rechaz\w+|recus\w+)\b|отказ", re.I)

# Names of languages and requests for another wording.
_ASKS_LANGUAGE = re.compile(
    r"\b(?:translat\w+|übersetz\w*|überset\w*|tradui\w*|traduc\w*|tradu[zçz]\w*|перевед\w*|перевод\w*)\b"
    r"|\b(?:in|into|to|auf|ins|en|in the|al|em|para o|na|на)\s+(?:(?:plain|simple|good|fluent)\s+)?(?:english|german|french|spanish|portuguese|russian|deutsche?n?|englische?n?|französische?n?|spanische?n?|russische?n?|portugiesische?n?|anglais|allemand|français|espagnol|portugais|russe|inglés|alemán|francés|español|portugués|ruso|inglês|alemão|francês|espanhol|português|русск\w+|английск\w+|немецк\w+|французск\w+|испанск\w+)\b"
    r"|\b(?:answer|reply|respond|write|antworte\w*|réponds?\w*|responde\w*)\b.{0,30}\b(?:english|german|french|spanish|portuguese|russian|deutsch|englisch|französisch|spanisch|anglais|allemand|français|espagnol|inglés|alemán|francés|español)\b",
    re.I,
)
# Every request for a language holds one of these.
_LANGUAGE_STEMS = (
    "translat|überset|tradu|перевед|перевод|english|german|french|spanish|portuguese|russian|deutsch|englisch|französisch|spanisch|russisch|portugiesisch"
    "|anglais|allemand|français|espagnol|portugais|russe|inglés|alemán|francés|español|portugués|ruso|inglês|alemão|francês|espanhol|português|русск|английск|немецк|французск|испанск"
)
# "i" has case forms that only Python takes for one letter
_ANY_LANGUAGE_STEM = "(?i)" + _LANGUAGE_STEMS.replace("i", "[iıİ]")
_ASKS_REWORDING = re.compile(
    r"\b(?:rewrite|rephrase|reword|paraphrase|polish|proofread|correct (?:the|spelling|this|grammar|all)|correct spelling|fix (?:the )?(?:spelling|grammar|typos|punctuation|text)|improve the (?:style|wording|text)|repeat|copy (?:the|this)|translate|capital letters|punctuat\w+|edit (?:the|this)|clean up|reformat|convert|shorten|simplify"
    r"|formuliere|korrigiere|verbessere|überarbeite|übersetze|wiederhole|schreibe .{0,20}um|reformule|corrige|améliore|traduis|répète|récris|réécris|reescribe|reformula|corrige|mejora|traduce|repite|reescreva|reformule|corrija|melhore|traduza|repita|исправь|перепиши|переформулируй|переведи|повтори)\b",
    re.I,
)
_CODE = re.compile(r"```.*?(?:```|$)", re.S)
_QUOTE = re.compile(r"“[^”]*”|«[^»]*»|„[^“”]*[“”]|\"[^\"\n]{12,}\"")
_INVISIBLE = re.compile(r"[\s​-‏ -‮⁠-⁤﻿­\u0000-\u001f]+")
_LABEL = re.compile(r"^\W*(?:q|question|user|prompt|instruction|input|human|frage|pregunta|question|you asked|you wrote|sie fragten|vous avez demandé|has preguntado|usted preguntó)\s*[:：]\s*", re.I)
_WORDS = re.compile(r"[^\W_]+")


_SKIP_LINE = re.compile(r"\s*(?:\d{4}-\d\d-\d\dT|\$ |https?://|[{\[])")


def prose(text: str) -> str:
    """The text without code, log lines and long quotations."""
    if "```" in text:
        text = _CODE.sub(" ", text)
    if '"' in text or "“" in text or "«" in text or "„" in text:
        text = _QUOTE.sub(" ", text)
    if "\n" in text:
        return "\n".join(line for line in text.split("\n") if not _SKIP_LINE.match(line))
    return text


_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")


def asked_languages(model: LanguageModel, prompts: list[str], extras: list[str], least: float = 3.0) -> tuple[np.ndarray, ...]:
    """(language that a prompt sets, the same by letters, that of the prompt itself).

    A text to be reworded sets the language instead of the prompt.
    """
    own, own_letters, _ = model.score([prose(p) for p in prompts])
    spoken = leading(own, least)
    reworded = [i for i, (p, x) in enumerate(zip(prompts, extras, strict=True)) if x.strip() and _ASKS_REWORDING.search(p)]
    wanted, letters = spoken.copy(), leading(own_letters, least)
    if reworded:
        by_word, by_letter, _ = model.score([prose(extras[i]) for i in reworded])
        wanted[reworded], letters[reworded] = leading(by_word, least), leading(by_letter, least)
    return wanted, letters, spoken


def given_languages(model: LanguageModel, answers: list[str], least: float = 3.0) -> tuple[np.ndarray, ...]:
    """(language of an answer, the same by letters, number of its words, words in sentences of each language)."""
    parts = [[x for x in _SENTENCE.split(prose(a)) if x] for a in answers]
    owner = np.repeat(np.arange(len(answers)), [len(x) for x in parts])
    by_word, by_letter, n = model.score([x for part in parts for x in part])
    total = lambda v: np.stack([np.bincount(owner, weights=v[:, j], minlength=len(answers)) for j in range(v.shape[1])], axis=1)
    of_sentence = leading(by_word, 2.0)
    told = np.stack([np.bincount(owner, weights=(of_sentence == j) * n, minlength=len(answers)) for j in range(len(model.languages))], axis=1)
    return leading(total(by_word), least), leading(total(by_letter), least), np.bincount(owner, weights=n, minlength=len(answers)), told


def compared_languages(asked: tuple[np.ndarray, ...], given: tuple[np.ndarray, ...], words: int = 3) -> np.ndarray:
    """Votes by the whole text, by its letters, and by the share of words in sentences of another language; abstains on answers of fewer than ``words`` words."""
    (wanted, wanted_letters), (spoken, spoken_letters, sizes, told) = asked[:2], given
    all_told = told.sum(axis=1)
    share = (all_told - told[np.arange(len(told)), wanted]) / np.maximum(all_told, 1)

    def vote(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where((a < 0) | (b < 0) | (sizes < words), 0, np.where(a != b, 1, -1))

    three = np.where((wanted < 0) | (all_told < words), 0, np.where(share >= 0.7, 1, np.where(share <= 0.5, -1, 0)))
    return np.stack([vote(wanted, spoken), vote(wanted_letters, spoken_letters), three], axis=1)


def votes_language(model: LanguageModel, prompts: list[str], extras: list[str], answers: list[str], least: float = 3.0, words: int = 3) -> list[tuple[int, int, int]]:
    """Votes on each pair; a prompt that asks for a language excuses any."""
    if not model.languages:
        return [(0, 0, 0)] * len(prompts)
    return _excused(compared_languages(asked_languages(model, prompts, extras, least), given_languages(model, answers, least), words), prompts)


def _excused(votes: np.ndarray, prompts: list[str]) -> list[tuple[int, int, int]]:
    for i in np.flatnonzero((votes > 0).any(axis=1)).tolist():
        if _ASKS_LANGUAGE.search(prompts[i]):
            votes[i] = -1
    return [tuple(v) for v in votes.tolist()]


@lru_cache(maxsize=1024)
def votes_empty(answer: str | None) -> tuple[int, int, int, int]:
    if answer is None:
        return 1, 1, 1, 1
    if len(answer) > 80 and _WORDS.search(answer):
        return -1, -1, -1, -1
    bare = _INVISIBLE.sub(" ", answer).strip()
    words = _WORDS.findall(bare)
    core = re.sub(r"^[\s<>\[\](){}\"'“”*_.\-–—:]+|[\s<>\[\](){}\"'“”*_.\-–—:]+$", "", bare).lower()
    listed = core.replace(" ", "_") in PLACEHOLDERS or core in BRACKETED and bare[:1] in "<[({"
    # "No" and the like answer a question, "none" in brackets or alone doesn't
    bracketed = bool(re.fullmatch(r"[<\[({].{0,24}[>\])}]", bare)) and len(words) <= 3 and not any(w[0].isdigit() for w in words)
    if not bare:
        return 1, 1, 1, 1
    return -1, 1 if not words else -1, 1 if listed or not words else -1, 1 if bracketed or not words else 1 if listed and len(words) <= 3 else -1


_CLAUSE, _CLAUSE_OR_LINE = re.compile(r"(?<=[.!?…;])\s+"), re.compile(r"(?<=[.!?…;])\s+|\n+")
_FIGURE = re.compile(r"\d|[`_/]|\b[A-Z][a-z]+[A-Z]")
_REFUSAL_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?]")
_MASK = (1 << WEIGHT_BITS) - 1


def _refusal_words(answer: str) -> tuple[set[str], set[tuple[str, str]]] | None:
    """Words and word pairs of an answer of at most ``SHORT`` words, None of longer ones."""
    # white space alone tells that most long answers are too long
    if answer.count(" ") > SHORT and len(answer.split()) > SHORT:
        return None
    words = _REFUSAL_WORD.findall(answer.lower())
    if len(words) > SHORT:
        return None
    words = ["<", *words, ">"]
    return set(words), set(zip(words, words[1:]))


def refusal_features(answer: str) -> list[int] | None:
    """The same, hashed."""
    found = _refusal_words(answer)
    return None if found is None else sorted({xxhash.xxh32_intdigest(w) & _MASK for w in found[0]} | {xxhash.xxh32_intdigest(f"{a} {b}") & _MASK for a, b in found[1]})


class _Weights(dict):
    """Weights of words and word pairs, looked up once each."""

    def __init__(self, weights: np.ndarray) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, w: str | tuple[str, str]) -> float:
        v = self[w] = float(self.weights[xxhash.xxh32_intdigest(w if isinstance(w, str) else f"{w[0]} {w[1]}") & _MASK])
        return v


@dataclass
class RefusalModel:
    """A hashed logistic regression; without weights it abstains."""

    weights: np.ndarray | None = None
    bias: float = 0.0
    _known: _Weights | None = field(default=None, repr=False)
    _voted: dict[str, int] = field(default_factory=dict, repr=False)

    def vote(self, answer: str) -> int:
        if self.weights is None:
            return 0
        out = self._voted.get(answer)
        if out is None:
            if len(self._voted) > 1000:
                self._voted.clear()
            out = self._voted[answer] = self._vote(answer)
        return out

    def _vote(self, answer: str) -> int:
        found = _refusal_words(answer)
        if found is None:
            return 0
        if self._known is None or len(self._known) > 300_000:
            self._known = _Weights(self.weights)
        weight = self._known.__getitem__
        odds = self.bias + sum(map(weight, found[0])) + sum(map(weight, found[1]))
        return 1 if odds > 1 else -1 if odds < -1 else 0


def fit_refusals(drawn: DataFrame) -> RefusalModel:
    """Fit on a sample of (prompt, answer): answers that the phrases give away against a quarter of the others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, y = [], []
            for p, a in zip(b["prompt"], b["answer"], strict=True):
                refused = sum(votes_refusal(p or "", a)) > 0
                if (refused or xxhash.xxh32_intdigest(a) % 4 == 0) and (found := refusal_features(a)) is not None:
                    x.append(found)
                    y.append(int(refused))
            yield pd.DataFrame({"x": pd.Series(x, dtype=object), "y": pd.Series(y, dtype="int32")})

    got = drawn.select("prompt", "answer").mapInPandas(run, "x array<int>, y int").toPandas()
    y = got["y"].to_numpy().astype(float)
    if not len(y) or not 0 < y.sum() < len(y):
        return RefusalModel()
    return RefusalModel(*logistic([list(x) for x in got["x"]], y, epochs=6, l2=1e-4))


@lru_cache(maxsize=64)
def all_words(text: str) -> list[str]:
    """Words in lower case; the list is shared."""
    return _WORDS.findall(text.lower())


def stemmed(answers: list[str]) -> tuple[list[str], list[bool]]:
    """The answers with single blanks, and whether they hold a stem of a refusal phrase."""
    flat = [" ".join(a.split()) for a in answers]
    return flat, pc.match_substring_regex(pa.array([x.lower() for x in flat], pa.string()), _ANY_STEM).to_pylist()


def _votes_unstemmed(flat: str) -> tuple[int, int, int, int]:
    return -1, 1 if len(flat) < 160 and _OPENER.match(flat) and not _DIGIT.search(flat) else -1, -1, -1


def votes_refusal(prompt: str, answer: str) -> tuple[int, int, int, int]:
    votes, content, lone = _refusal_traits(answer)
    if content is None:
        return (-1, -1, -1, -1) if votes[0] > 0 and _ASKS_REFUSAL.search(prompt) else votes
    about = content.intersection(all_words(prompt))
    return votes[0], votes[1], 1 if lone and not about else -1 if len(about) >= 2 else 0, votes[3]


@lru_cache(maxsize=64)
def _refusal_traits(answer: str) -> tuple[tuple[int, int, int, int], set[str] | None, bool]:
    """(votes by the answer alone, long words of a short answer, whether only these can speak against the third vote)."""
    # blanks and line breaks in a row are one blank
    flat = " ".join(answer.split())
    low = flat.lower()
    stems = [s for s in _STEMS if s in low]
    if not stems:
        return _votes_unstemmed(flat), None, False
    words = _WORDS.findall(low)
    if len(words) > LONG:
        return _votes_long_refusal(answer, stems), None, False
    sentences = [x for x in _CLAUSE.split(flat) if x]
    declined = [any(map(x.lower().__contains__, stems)) and bool(_REFUSAL.search(x)) for x in sentences]
    # a polite sentence beside it answers no more
    idle = [no or bool(_COURTESY.search(x)) for no, x in zip(declined, sentences, strict=True)] if any(declined) else declined
    figures = _FIGURE.search(flat)
    votes = (
        1 if any(declined) else -1,
        -1 if figures else 1 if _OPENER.match(flat) and len(words) <= 24 else 0,
        0,
        1 if sentences and sum(idle) >= 0.5 * len(sentences) else -1,
    )
    return votes, {w for w in words if len(w) > 4}, 3 < len(words) <= 24 and len(sentences) <= 2 and not figures and any(declined)


def _votes_long_refusal(answer: str, stems: list[str]) -> tuple[int, int, int, int]:
    """By a declined sentence, by how the answer begins, and by the shares of words and of sentences that only decline or are polite about it."""
    sentences = [" ".join(x.split()) for x in _CLAUSE_OR_LINE.split(answer) if x.strip()]
    declined = [any(map(x.lower().__contains__, stems)) and bool(_REFUSAL.search(x)) for x in sentences]
    if not any(declined):
        return -1, -1, -1, -1
    idle = [no or bool(_COURTESY.search(x) or _OPENER.search(x)) for no, x in zip(declined, sentences, strict=True)]
    sizes = [len(_WORDS.findall(x)) for x in sentences]
    share = sum(n for n, x in zip(sizes, idle, strict=True) if x) / max(1, sum(sizes))
    begins = all(idle[: declined.index(True)]) or any(declined[:2])
    return (
        1,
        -1 if share < 0.5 or "```" in answer else 1 if begins else 0,
        1 if share >= 0.6 and begins else -1 if share < 0.5 else 0,
        1 if sum(idle) >= 0.5 * len(idle) and share >= 0.5 else -1,
    )


def bare_words(text: str) -> list[str]:
    low = text.lower()
    label = _LABEL.match(low)
    return _WORDS.findall(low[label.end() :]) if label else all_words(text)


def once(words: list[str]) -> list[str]:
    """The words, or the part of them that is all they repeat."""
    for k in range(2, 6):
        n, rest = divmod(len(words), k)
        if n and not rest and words == words[:n] * k:
            return words[:n]
    return words


# Numbers in words.
_NUMBERS = frozenset("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split())


def particulars(text: str) -> set[str]:
    """Numbers, identifiers and the like, which statements of one pattern differ in."""
    return {w for w in re.findall(r"[\w.-]*\w", text.lower()) if w in _NUMBERS or re.search(r"\d|_", w)}


def likeness(answer: list[str], source: list[str]) -> float:
    """Words shared in order over those of the longer text; 0 unless at least 60 % are shared in any order."""
    longer = max(len(answer), len(source))
    if min(len(answer), len(source)) < 0.6 * longer:
        return 0.0
    if answer == source:
        return 1.0
    # words known at all are no fewer than those shared as often as they come
    if sum(map(set(source).__contains__, answer)) < 0.6 * longer or sum((Counter(answer) & Counter(source)).values()) < 0.6 * longer:
        return 0.0
    return common_sequence(answer, source) / longer


def votes_copy(prompt: str, extra: str, answer: str) -> tuple[int, int, int]:
    """prompt: instruction or user turn; extra: input. Every combination may be given back.

    By words in order, by letters alone, and by new words.
    """
    a = once(bare_words(answer))
    if len(a) < 3:
        return -1, -1, -1
    sources = [(prompt, bare_words(prompt))]
    if a == sources[0][1]:
        return 1, 1, 1
    if extra.strip():
        sources += [(extra, bare_words(extra)), (f"{prompt} {extra}", bare_words(prompt) + bare_words(extra))]
    scored = [(likeness(a, w), t, w) for t, w in sources if w]
    best, text, words = max(scored, key=lambda x: x[0], default=(0.0, "", []))
    if best < 0.6:
        return -1, -1, -1
    if text is not prompt:
        if _ASKS_REWORDING.search(prompt):
            return -1, -1, -1
        if text is extra and best < 0.97 and (particulars(text) != particulars(answer) or best < 0.85):
            return -1, -1, -1
    flat = ["".join(a), "".join(bare_words(text))]
    new = sum((Counter(a) - Counter(words)).values())
    covered = sum((Counter(a) & Counter(words)).values()) / len(words)
    return 1 if best >= 0.72 else -1, 1 if flat[0] == flat[1] else 0 if best >= 0.7 else -1, 1 if new <= max(3, 0.2 * len(a)) and covered >= 0.72 else -1


def votes_truncated(odds: float, answer: str) -> tuple[int, int, int]:
    # a closing mark inside a token (4.|16) doesn't speak against a cut that the classifier, which sees the mark, has found
    closed = _CLOSED.search(answer[-12:]) and answer.count("```") % 2 == 0
    return 1 if odds > 0.5 else -1, 1 if odds > 2.5 else -1 if odds < -1 else 0, (0 if odds > 0.5 else -1) if closed else 1 if odds > 0.5 else 0


def pairs(alpaca: DataFrame, chat: DataFrame) -> DataFrame:
    """sample_id, turn, source, prompt, extra, answer.

    Outputs with their instruction (turn -1) and assistant turns with the user
    turn directly before.  Other turns, and samples without an id, are no pairs.
    """
    a = alpaca.select("sample_id", F.lit(-1).alias("turn"), "source", F.col("instruction").alias("prompt"), F.col("input").alias("extra"), F.col("output").alias("answer"))
    m = F.transform("messages", lambda x, i: F.struct(i.alias("turn"), x["role"].alias("role"), F.element_at("messages", F.when(i > 0, i).otherwise(1)).alias("before"), x["content"].alias("answer")))
    c = chat.select("sample_id", "source", F.explode(F.filter(m, lambda x: (x["turn"] > 0) & (x["role"] == "assistant") & (x["before"]["role"] == "user"))).alias("p"))
    c = c.select("sample_id", "p.turn", "source", F.col("p.before.content").alias("prompt"), F.lit(None).cast("string").alias("extra"), "p.answer")
    return a.unionByName(c).where("sample_id is not null")


@dataclass
class Voters:
    """The trained voters."""

    truncation: TruncationModel
    languages: LanguageModel
    refusals: RefusalModel

    def state(self) -> tuple:
        return self.truncation.state(), self.languages.state(), (self.refusals.weights, self.refusals.bias)

    @staticmethod
    def of(state: tuple) -> Voters:
        return Voters(TruncationModel(**state[0]), LanguageModel(*state[1]), RefusalModel(*state[2]))

    def votes(self, sources: list[str | None], prompts: list[str | None], extras: list[str | None], answers: list[str | None]) -> list[dict[str, tuple[int, ...]]]:
        """Votes on every defect of each pair; where nothing is there no other defect is, and a missing prompt excludes the language."""
        prompts, extras = [p or "" for p in prompts], [x or "" for x in extras]
        return list(self._votes(sources, prompts, extras, answers, votes_language(self.languages, prompts, extras, [a or "" for a in answers])))

    def _votes(self, sources: list[str | None], prompts: list[str], extras: list[str], answers: list[str | None], spoken: list[tuple[int, ...]]) -> Iterator[dict[str, tuple[int, ...]]]:
        flat, stems = stemmed([a or "" for a in answers])
        for s, p, x, a, lang, f, stem in zip(sources, prompts, extras, answers, spoken, flat, stems, strict=True):
            empty = votes_empty(a)
            if empty[2] == 1 or not a:
                yield {"empty": empty, **{d: (-1,) * VOTERS[d] for d in DEFECTS[1:]}}
                continue
            yield {"empty": empty, **{d: self._vote(d, s, p, x, a, lang) for d in DEFECTS[1:] if stem or d != "refusal"}} | ({} if stem else {"refusal": (*_votes_unstemmed(f), self.refusals.vote(a))})

    def votes_on(self, defects: list[str], sources: list[str | None], prompts: list[str | None], extras: list[str | None], answers: list[str]) -> list[tuple[int, ...]]:
        """Of these votes those on one defect of each pair."""
        prompts, extras = [p or "" for p in prompts], [x or "" for x in extras]
        of = [i for i, d in enumerate(defects) if d == "language"]
        spoken = dict(zip(of, votes_language(self.languages, [prompts[i] for i in of], [extras[i] for i in of], [answers[i] for i in of]), strict=True))
        return [self._vote_on(d, s, p, x, a, spoken.get(i, (0, 0, 0))) for i, (d, s, p, x, a) in enumerate(zip(defects, sources, prompts, extras, answers, strict=True))]

    def _vote_on(self, defect: str, source: str | None, prompt: str, extra: str, answer: str, spoken: tuple[int, ...]) -> tuple[int, ...]:
        empty = votes_empty(answer)
        if defect == "empty":
            return empty
        return (-1,) * VOTERS[defect] if empty[2] == 1 or not answer else self._vote(defect, source, prompt, extra, answer, spoken)

    def votes_and_spoiled(self, sources: list[str | None], prompts: list[str | None], extras: list[str | None], answers: list[str | None]) -> Iterator[tuple[dict[str, tuple[int, ...]], dict[str, tuple[int, ...]]]]:
        """The votes of each pair, and by defect those on that defect of its spoiled answer; a null prompt or answer isn't spoiled.

        An answer of another language is one of the next pairs of the batch, so
        its languages are known.
        """
        whole = [i for i, (p, a) in enumerate(zip(prompts, answers, strict=True)) if p is not None and a is not None]
        prompts, extras = [p or "" for p in prompts], [x or "" for x in extras]
        spoken: list[tuple[int, ...]] = [(0, 0, 0)] * len(prompts)
        far: dict[int, tuple[str, tuple[int, ...]]] = {}
        if self.languages.languages:
            asked, given = asked_languages(self.languages, prompts, extras), given_languages(self.languages, [a or "" for a in answers])
            spoken = _excused(compared_languages(asked, given), prompts)
            asks = pc.match_substring_regex(pa.array(prompts, pa.string()), _ANY_LANGUAGE_STEM).to_pylist()
            after = next_other(asked[2][whole], given[0][whole])
            chosen = [(i, whole[j]) for i, j in zip(whole, after.tolist(), strict=True) if j >= 0 and not (asks[i] and _ASKS_LANGUAGE.search(prompts[i]))]
            i, j = np.array(chosen, np.int64).reshape(-1, 2).T
            for (at, other), v in zip(chosen, compared_languages(tuple(x[i] for x in asked), tuple(x[j] for x in given)).tolist(), strict=True):
                far[at] = answers[other], tuple(v)
        spoil_at = set(whole)
        for k, votes in enumerate(self._votes(sources, prompts, extras, answers, spoken)):
            p, x, a = prompts[k], extras[k], answers[k]
            other, heard = far.get(k, ("", (0, 0, 0)))
            made = spoil(p, a, other, random.Random(f"{p}/{a}")) if k in spoil_at else []
            yield votes, {d: self._vote_on(d, sources[k], p, x, bad, heard) for d, bad in made}

    def _vote(self, defect: str, source: str | None, prompt: str, extra: str, answer: str, spoken: tuple[int, ...]) -> tuple[int, ...]:
        if defect == "truncated":
            return votes_truncated(self.truncation.score(source, answer), answer)
        if defect == "refusal":
            return *votes_refusal(prompt, answer), self.refusals.vote(answer)
        if defect == "copy":
            return votes_copy(prompt, extra, answer)
        return spoken if prompt.strip() else (0, 0, 0)


def code(votes: tuple[int, ...]) -> int:
    """A pattern of votes as one number."""
    out = 0
    for v in votes:
        out = out * 3 + v + 1
    return out


def decode(pattern: int, voters: int) -> list[int]:
    out = []
    for _ in range(voters):
        pattern, v = divmod(pattern, 3)
        out.append(v - 1)
    return out[::-1]


def label_model(counts: dict[int, float], voters: int, steps: int = 200, prior: float = 0.02) -> dict[int, float]:
    """Posterior probability of the defect by pattern, by expectation-maximization.

    Votes are independent given the truth; abstaining says nothing.  A start
    from the majority and weak pseudo-counts keep class 1 the one that is voted
    for.  Patterns without a vote for the defect have none.
    """
    patterns = list(counts)
    if not patterns:
        return {}
    votes = np.array([decode(p, voters) for p in patterns])
    n = np.array([counts[p] for p in patterns], float)
    backed = (votes == 1).any(axis=1)
    post = np.where(backed, np.clip(votes.sum(axis=1) / voters, 0, 1) * 0.9 + 0.05, 0.0)
    for _ in range(steps):
        pi = ((post * n).sum() + prior * 20) / (n.sum() + 20)
        logp = np.full((len(patterns), 2), np.log([1 - pi, pi]))
        for j in range(voters):
            for y, w in ((0, (1 - post) * n), (1, post * n)):
                no, yes = w[votes[:, j] == -1].sum(), w[votes[:, j] == 1].sum()
                p = (yes + (0.2 if y == 0 else 8.0)) / (no + yes + (8.2 if y == 0 else 10.0))
                logp[:, y] += np.select([votes[:, j] == 1, votes[:, j] == -1], [np.log(p), np.log(1 - p)], 0.0)
        new = 1 / (1 + np.exp(np.clip(logp[:, 0] - logp[:, 1], -50, 50)))
        new = np.where(backed, new, 0.0)
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    return dict(zip(patterns, post.tolist(), strict=True))


# Refusals longer than ``LONG`` words, for validation.
_LONG_REFUSALS = (
    "I'm sorry, but I can't help with that. The guidelines that I work under do not allow me to go into this subject, whatever the reason for the question may be. I understand that this isn't what you hoped for. If there is anything else on your mind, I would be glad to talk about it, so please feel free to ask about other topics.",
    "Leider kann ich diese Frage nicht beantworten. Unsere Richtlinien erlauben es mir nicht, auf dieses Thema einzugehen, auch wenn die Frage sicher gut gemeint ist und Sie einen Grund dafür haben. Ich bitte um Ihr Verständnis. Gerne spreche ich stattdessen mit Ihnen über andere Themen, und für weitere Fragen stehe ich Ihnen jederzeit zur Verfügung.",
)


_SHORT_REFUSALS = ("I'm sorry, but I can't help with that.", "Sorry, I am not able to assist with this request.", "Leider kann ich diese Frage nicht beantworten.", "Je ne peux pas répondre à cette demande.", "Lo siento, no puedo ayudar con eso.", "I won't provide that information.")


def next_other(of_prompt: np.ndarray, of_answer: np.ndarray, reach: int = 40) -> np.ndarray:
    """By pair the nearest pair less than ``reach`` after it whose answer is known to be of another language than its prompt, -1 if there is none."""
    n = len(of_prompt)
    at = np.arange(n)
    out = np.full(n, -1)
    for lang in np.unique(of_prompt[of_prompt >= 0]):
        other = np.where((of_answer >= 0) & (of_answer != lang), at, n)
        after = np.append(np.minimum.accumulate(other[::-1])[::-1], n)[1:]
        out = np.where((of_prompt == lang) & (after < np.minimum(n, at + reach)), after, out)
    return out


def spoil(prompt: str, answer: str, other: str, rng: random.Random) -> list[tuple[str, str]]:
    """(defect, answer made defective) for validation; ``other`` is an answer of another language that the prompt doesn't ask for, or empty."""
    out = [("empty", rng.choice(["", "   ", "n/a", "[no response]", "-", "None", "<blank>"]))]
    if len(prompt.split()) >= 5:
        out.append(("copy", rng.choice([prompt, prompt.upper(), f"Q: {prompt}", f"> {prompt}", prompt.lower().replace(",", "")])))
    if other:
        out.append(("language", other))
    if len(answer) > 60:
        cut = rng.randrange(30, len(answer) - 10)
        if answer[cut - 1].isalnum() and answer[cut].isalnum():
            out.append(("truncated", answer[:cut]))
    out.append(("refusal", rng.choice([*_SHORT_REFUSALS, *_LONG_REFUSALS])))
    return out


def drawn_share(rows: DataFrame, total: int, size: int, seed: int) -> DataFrame:
    """About ``size`` of ``total`` rows, by a share of the hashes of their keys: every task draws by itself."""
    parts = 1 << 30
    share = min(parts, int(parts * size / max(1, total)) + 1)
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), "sample_id", "turn"), F.lit(parts)) < share)


def fit_voters(alpaca: DataFrame, chat: DataFrame, truncation: TruncationModel, labelled: DataFrame | None = None, sample: int = SAMPLE) -> Voters:
    """The trained voters; ``labelled`` holds (id, text, lang), without it no language is judged.

    About ``sample`` pairs teach the refusal classifier, and a quarter of them
    the language classifier the words of prompts and answers.
    """
    spark = alpaca.sparkSession
    base = pairs(alpaca, chat).where("answer is not null")
    drawn = persist_table(drawn_share(base, base.count(), sample, 17).repartition(spark.sparkContext.defaultParallelism))
    languages = no_languages() if labelled is None else fit_languages(labelled)
    asks = f"prompt rlike '(?i){_SQL_ASKS}'"
    plain = drawn_share(drawn.where("prompt is not null").where(~F.expr(asks)), 4, 1, 19)
    languages = taught(languages, plain.select(F.col("prompt").alias("a"), F.col("answer").alias("b")).unionByName(plain.select(F.col("answer").alias("a"), F.col("prompt").alias("b"))))
    voters = Voters(truncation, languages, fit_refusals(drawn))
    drop_table(drawn)
    return voters


#: Prompts that may ask for a language or a rewording teach no language.
_SQL_ASKS = "translat|übersetz|tradu|перевед|english|german|french|spanish|portug|russian|deutsch|français|español|rewrite|rephrase|correct|polish|spelling|paraphras"


#: Columns of the votes on the spoiled answers of a pair.
_SPOILED = tuple(f"spoiled_{d}" for d in DEFECTS)


def find_defects(alpaca: DataFrame, chat: DataFrame, voters: Voters, keep: float = 0.97) -> tuple[DataFrame, dict[str, float]]:
    """(sample_id, turn, defect, posterior of each defective pair; cutoff by defect).

    Cutoffs are the highest of a fixed row that keep the share ``keep`` of
    spoiled answers, made of all pairs.  A null answer is empty;
    a null prompt excludes only the language defect; repeated rows count once.
    """
    shared = alpaca.sparkSession.sparkContext.broadcast(voters.state())

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Voters.of(shared.value)
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("source", "prompt", "extra", "answer")]
            rows = [[*(code(v[d]) for d in DEFECTS), *(code(bad[d]) if d in bad else None for d in DEFECTS)] for v, bad in own.votes_and_spoiled(*columns)]
            patterns = [pa.array(x, pa.int32()) for x in (zip(*rows, strict=True) if rows else [[]] * 2 * len(DEFECTS))]
            yield pa.RecordBatch.from_arrays([b.column("sample_id"), b.column("turn"), *patterns], names=["sample_id", "turn", *DEFECTS, *_SPOILED])

    base = pairs(alpaca, chat).select(F.col("sample_id").cast("long"), F.col("turn").cast("int"), *(F.col(c).cast("string") for c in ("source", "prompt", "extra", "answer")))
    rows = persist_table(base.mapInArrow(vote, "sample_id long, turn int, " + ", ".join(f"{c} int" for c in (*DEFECTS, *_SPOILED))))
    voted = rows.select("sample_id", "turn", *DEFECTS)
    grouped = voted.distinct().groupBy(*DEFECTS).count().toPandas()  # at most 3 to the number of voters rows
    posterior = {d: label_model(grouped.groupby(d)["count"].sum().to_dict(), VOTERS[d]) for d in DEFECTS}
    cutoffs = _validated(rows, posterior, keep)
    named = [
        F.struct(F.lit(d).alias("defect"), F.coalesce(_lookup(F.col(d), posterior[d]), F.lit(0.0)).alias("posterior"), F.lit(cutoffs[d]).alias("cutoff"))
        for d in DEFECTS
    ]
    found = voted.select("sample_id", "turn", F.explode(F.array(*named)).alias("x")).where("x.posterior > x.cutoff")
    return found.groupBy("sample_id", "turn", "x.defect").agg(F.max("x.posterior").alias("posterior")), cutoffs


def _lookup(col, table: dict[int, float]):
    likely = {k: v for k, v in table.items() if v > 0.01}
    if not likely:
        return F.lit(None).cast("double")
    return F.create_map(*(x for k, v in likely.items() for x in (F.lit(int(k)), F.lit(float(v)))))[col]


def _validated(rows: DataFrame, posterior: dict[str, dict[int, float]], keep: float) -> dict[str, float]:
    """Cutoff by defect, from the patterns of the spoiled answers of all pairs: at most 3 to the number of voters a defect."""
    spoiled = F.explode(F.array(*(F.struct(F.lit(d).alias("defect"), F.col(c).alias("pattern")) for d, c in zip(DEFECTS, _SPOILED, strict=True)))).alias("x")
    made = rows.select(spoiled).where("x.pattern is not null").groupBy("x.defect", "x.pattern").count().toPandas()
    out = {}
    for d in DEFECTS:
        mine = made[made["defect"] == d]
        p = np.array([posterior[d].get(int(k), 0.0) for k in mine["pattern"]])
        n = mine["count"].to_numpy(float)
        out[d] = 0.5
        for c in (0.6, 0.7, 0.8, 0.9):
            if n.sum() and n[p > c].sum() >= keep * n.sum():
                out[d] = c
    return out
