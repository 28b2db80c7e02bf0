"""Screening of texts against a list of terms: reading of disguised letters, word forms, exceptions, the gate and its journal."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_CHARS = 200_000  # a longer text is withheld unread
MOST_FINDINGS = 8
MOST_LINES, MOST_WORDS, MOST_LETTERS = 200, 6, 60  # of a list
JOINED, SHORT = 7, 3  # so many further tokens of so few signs are read together

# Latin letters and digits that are read as Cyrillic ones.
LOOKALIKES = {
    "a": "а", "b": "в", "c": "с", "e": "е", "h": "н", "k": "к", "m": "м", "o": "о", "p": "р", "t": "т", "x": "х", "y": "у",
    "0": "о", "1": "и", "3": "з", "4": "ч", "6": "б", "9": "я",
}
# Endings that a word's own ending is replaced by, the first group that fits counts.
PARADIGMS = (
    (("ый", "ий", "ой"), "ый ий ой ого его ому ему ым им ом ем ая яя ую юю ое ее ые ие ых их ыми ими"),
    (("а",), "а ы и е у ой ою - ам ами ах"),
    (("я",), "я и е ю ей ею ь ям ями ях"),
    (("о",), "о а у ом е ам ами ах"),
    (("е",), "е я ю ем и ям ями ях"),
    (("ать",), "ать аю аешь ает аем аете ают ал ала ало али ай айте"),
    (("ь",), "ь и ью ей ям ями ях"),
    (("",), "- а у ом ем е ы и ов ев ей ам ям ами ями ах ях"),
)
LATIN_ENDINGS = ("", "s", "es", "ed", "ing")
IRREGULAR = {
    "заткнись": ("заткнись", "заткнитесь", "заткнулся", "заткнулась", "заткнулись"),
    "заткни": ("заткни", "заткните"),
    "иди": ("иди", "идите"),
    "пошел": ("пошел", "пошла", "пошли", "пошло"),
}
_FOLD = str.maketrans(LOOKALIKES)
_MASK = "*#?"
_ENTITY = re.compile(r"&(?:#(x[0-9a-f]{1,6}|[0-9]{1,7})|(nbsp|shy|zwj|zwnj|zerowidthspace));", re.IGNORECASE)
_EMPHASIS = (re.compile(r"\*\*([^*\n]+)\*\*"), re.compile(r"__([^_\n]+)__"), re.compile(r"\*([^*\n]+)\*"))
_UNSEEN, _RUN = regex.compile(r"[\p{Cf}\p{M}]"), re.compile(r"[*#?]{2,}")
_TOKENS = re.compile(r"[*#?]*[^\W_]+(?:[*#?]+[^\W_]+)*[*#?]*")
_GLUE = re.compile(r"[\s._*#?-]{1,3}")
_MASKED = re.compile(r"[*#?]")


def _character(m: re.Match) -> str:
    if m[2]:
        return " " if m[2].lower() == "nbsp" else ""
    code = int(m[1][1:], 16) if m[1][0] in "xX" else int(m[1])
    return chr(code) if 0 < code <= 0x10FFFF else m[0]


def read_as(text: str) -> str:
    """A text in the letters in which it is compared: entities and emphasis undone, nothing invisible, look-alikes folded, masks shortened."""
    if "&" in text:
        text = _ENTITY.sub(_character, text)
    if "*" in text or "_" in text:
        for pattern in _EMPHASIS:
            text = pattern.sub(r"\1", text)
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKC", text).lower().replace("ё", "е"))
    return _RUN.sub("*", text.lower().translate(_FOLD))


def list_lines(text: str) -> list[str]:
    """The distinct filled lines of a list, on single spaces, in order."""
    return list(dict.fromkeys(" ".join(line.split()) for line in text.splitlines() if line.strip()))


def is_valid_list(text: str, stems: bool = True) -> bool:
    """Whether a list has at most 200 lines of at most six words of letters and digits, a star only at the end of a word and only if ``stems``."""
    lines = list_lines(text)
    if len(lines) > MOST_LINES:
        return False
    for words in (line.split() for line in lines):
        for w in words:
            literal = w[:-1] if stems and w.endswith("*") else w
            least = 2 if len(words) == 1 or w.endswith("*") else 1
            if not least <= len(literal) <= MOST_LETTERS or not all(c.isalnum() for c in literal):
                return False
        if len(words) > MOST_WORDS:
            return False
    return True


def word_forms(word: str) -> list[str]:
    """The forms of a word that a rule for it also means."""
    word = word.lower().replace("ё", "е")
    if word in IRREGULAR:
        return list(IRREGULAR[word])
    if len(word) <= 2:
        return [word]
    if not re.fullmatch("[а-я]+", word):
        return [word + e for e in LATIN_ENDINGS]
    for own, endings in PARADIGMS:
        fit = next((e for e in own if word.endswith(e)), None)
        if fit is not None:
            stem = word[: len(word) - len(fit)]
            return list(dict.fromkeys([*([word] if len(own) > 1 else []), *(stem + e.strip("-") for e in endings.split())]))
    return [word]


class _Word(NamedTuple):
    """One word of a rule: the forms it may have or the beginning it must have."""

    forms: frozenset[str]
    beginning: str | None

    def matches(self, token: str, masked: bool) -> bool:
        if self.beginning is not None:
            return _under(self.beginning, token[: len(self.beginning)]) if masked else token.startswith(self.beginning)
        return any(len(f) == len(token) and _under(f, token) for f in self.forms) if masked else token in self.forms


def _under(form: str, token: str) -> bool:
    return len(form) == len(token) and all(a == b or b in _MASK for a, b in zip(form, token))


class TermList:
    """A list of terms made ready for matching: rules of one word are looked up by form or beginning, longer ones by their first word."""

    def __init__(self, terms: tuple[str, ...], exceptions: tuple[str, ...] = ()):
        listed = sorted(dict.fromkeys(" ".join(t.split()) for t in terms if t.strip()), key=lambda t: -len(t.split()))
        self.terms = listed
        self.words = [[self._word(w) for w in t.split()] for t in listed]
        self.exceptions = [read_as(" ".join(e.split())).split() for e in exceptions if e.strip()]
        self.by_form: dict[str, list[int]] = {}
        self.by_beginning: dict[str, list[int]] = {}
        for i, ws in enumerate(self.words):
            first = ws[0]
            if first.beginning is not None:
                self.by_beginning.setdefault(first.beginning, []).append(i)
            for f in first.forms:
                self.by_form.setdefault(f, []).append(i)
        self.lengths = sorted({len(b) for b in self.by_beginning})

    @staticmethod
    def _word(w: str) -> _Word:
        return _Word(frozenset(), read_as(w[:-1])) if w.endswith("*") else _Word(frozenset(map(read_as, word_forms(w))), None)

    def candidates(self, token: str, masked: bool) -> list[int]:
        """The rules whose first word a token may be."""
        if masked:
            return [i for i, ws in enumerate(self.words) if ws[0].matches(token, True)]
        found = list(self.by_form.get(token, ()))
        for n in self.lengths:
            if n > len(token):
                break
            found += self.by_beginning.get(token[:n], ())
        return found


class Finding(NamedTuple):
    blocked: bool
    rules: list[str]
    reason: str | None


def _visible(token: str) -> bool:
    """Two letters, or three if the token begins or ends with a mask."""
    letters = sum(map(str.isalpha, token))
    return letters >= (3 if token[0] in _MASK or token[-1] in _MASK else 2)


def inspect(text: str, listed: TermList) -> Finding:
    """The terms in a text, longest phrases first, at most eight; a text over 200,000 characters is blocked unread.

    Any letter may be masked if two stay visible, look-alike letters count, single letters with signs between are read
    together, and what stands within an exception is none.
    """
    if len(text) > MOST_CHARS:
        return Finding(True, [], "too_long")
    read = read_as(text)
    spans = [(m[0], m.start(), m.end()) for m in _TOKENS.finditer(read)]
    tokens = [t for t, _, _ in spans]
    allowed: set[int] | None = None
    found: set[int] = set()

    def excepted(a: int, b: int) -> bool:
        nonlocal allowed
        if allowed is None:
            allowed = {
                i + k for e in listed.exceptions for i in range(len(tokens) - len(e) + 1) if tokens[i : i + len(e)] == e for k in range(len(e))
            }
        return all(i in allowed for i in range(a, b + 1))

    for i, token in enumerate(tokens):
        masked = _MASKED.search(token) is not None
        for rule in listed.candidates(token, masked):
            words = listed.words[rule]
            if rule in found:
                continue
            if len(words) == 1:
                if _visible(token) and not excepted(i, i):
                    found.add(rule)
            elif i + len(words) <= len(tokens) and all(w.matches(t, _MASKED.search(t) is not None) for w, t in zip(words[1:], tokens[i + 1 :])) and not excepted(i, i + len(words) - 1):
                found.add(rule)
        if len(token) <= SHORT:
            joined = token
            for end in range(i + 1, min(len(tokens), i + 1 + JOINED)):
                if len(tokens[end]) > SHORT or not _GLUE.fullmatch(read, spans[end - 1][2], spans[end][1]):
                    break
                joined += tokens[end]
                if len(joined) >= SHORT and _visible(joined):
                    for rule in listed.candidates(joined, _MASKED.search(joined) is not None):
                        if rule not in found and len(listed.words[rule]) == 1 and not excepted(i, end):
                            found.add(rule)
    rules = [listed.terms[i] for i in sorted(found)][:MOST_FINDINGS]
    return Finding(bool(rules), rules, "term" if rules else None)


@functools.lru_cache(maxsize=16)
def term_list(terms: tuple[str, ...], exceptions: tuple[str, ...] = ()) -> TermList:
    return TermList(terms, exceptions)


def scan(df: DataFrame, id_col: str, text_col: str, terms: list[str], exceptions: list[str] | None = None) -> DataFrame:
    """``<id_col>, rules, reason``: the texts that are blocked, by which terms, joined by bars. Null texts contain none; repeated rows stay."""
    listed, except_ = tuple(terms), tuple(exceptions or ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = term_list(listed, except_)
        for b in batches:
            hits = [(i, f) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t and (f := inspect(t, rules)).blocked]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in hits], b.column(0).type), pa.array(["|".join(f.rules) for _, f in hits], pa.string()), pa.array([f.reason for _, f in hits], pa.string())],
                [id_col, "rules", "reason"],
            )

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, rules string, reason string")


def gate(df: DataFrame, id_col: str, text_col: str, labels: list[str], terms: str, fallback: str, *, exceptions: str = "", enabled: bool = True) -> DataFrame:
    """``df`` with what must not be shown replaced: the text by ``fallback``, its ``labels`` by null; with ``blocked, rules, reason``.

    A text is checked together with its labels (names of sources and attachments): the first that is blocked counts, and
    when they come to more than 200,000 characters together the answer is too long. A list that is not valid withholds
    every answer (``settings_error``); a list that is not enabled none. Each row once for each ``id_col``.
    """
    rows = df.dropDuplicates([id_col])
    none = F.lit(None).cast("string")
    if not enabled:
        return rows.withColumns({"blocked": F.lit(False), "rules": none, "reason": none})
    if not is_valid_list(terms) or not is_valid_list(exceptions, stems=False):
        return _withheld(rows.withColumns({"blocked": F.lit(True), "rules": F.lit(""), "reason": F.lit("settings_error")}), text_col, labels, fallback)
    parts = F.posexplode(F.array(*(F.coalesce(c, F.lit("")) for c in (text_col, *labels)))).alias("place", "part")
    length = _sum(*(F.coalesce(F.length(c), F.lit(0)) for c in (text_col, *labels)))
    narrow = df.select(id_col, length.alias("total"), *(F.col(c) for c in (text_col, *labels)))
    shown = narrow.select(id_col, parts).select(F.struct(F.col(id_col).alias("id"), "place").alias("key"), "part")
    hits = scan(shown, "key", "part", list_lines(terms), list_lines(exceptions))
    first = hits.groupBy(F.col("key.id").alias(id_col)).agg(F.min(F.struct("key.place", "rules", "reason")).alias("f"))
    long = narrow.where(F.col("total") > MOST_CHARS).select(id_col, F.lit("").alias("r2"), F.lit("too_long").alias("too_long")).distinct()
    both = rows.join(first, id_col, "left").join(long, id_col, "left")
    reason = F.coalesce("f.reason", "too_long")
    marked = both.withColumns({"blocked": reason.isNotNull(), "rules": F.coalesce("f.rules", "r2"), "reason": reason}).drop("f", "r2", "too_long")
    return _withheld(marked, text_col, labels, fallback)


def _sum(*columns: Column) -> Column:
    return functools.reduce(Column.__add__, columns)


def _withheld(df: DataFrame, text_col: str, labels: list[str], fallback: str) -> DataFrame:
    shown = {c: F.when(~F.col("blocked"), F.col(c)) for c in labels}
    return df.withColumns({text_col: F.when(F.col("blocked"), F.lit(fallback)).otherwise(F.col(text_col)), **shown})


def journal(blocked: DataFrame, text_col: str, at: str) -> DataFrame:
    """``<at>, reason, rules, digest``: what is kept of blocked answers, their SHA-256 instead of their text, and at most eight rules."""
    rules = F.array_join(F.slice(F.split("rules", r"\|"), 1, MOST_FINDINGS), "|")
    return blocked.select(at, "reason", rules.alias("rules"), F.sha2(F.col(text_col).cast("binary"), 256).alias("digest"))


def retained(journal: DataFrame, at: str, days: int = 30, most: int = 100) -> DataFrame:
    """The newest ``most`` entries of a journal, of those not older than ``days`` before its last one."""
    last = journal.agg(F.max(at).alias("_last"))
    recent = journal.join(F.broadcast(last), F.col(at) >= F.col("_last") - F.expr(f"interval {days} days")).drop("_last")
    return recent.orderBy(F.desc(at), "id").limit(most)


def last_per_key(journal: DataFrame, key: str, at: str, most: int) -> DataFrame:
    """The newest ``most`` entries of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(at), "id")
    return journal.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
