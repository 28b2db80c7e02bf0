"""Template residue and error-page text.

Labelled exemplars of residue, and of sentences that only speak about such things, are indexed by their terms. Terms are
weighted by how few documents of the whole corpus have them. A document's terms retrieve the exemplars through the
inverted index; for each retrieved one the passage window with the highest TF-IDF containment is sought, and a window of
high containment is residue unless its sentence contains more of an exemplar that speaks about such things.

Three sorts of exemplars are told apart by what is their window. Of a sentence it is a run of words, and containment is the
weight of the exemplar's terms found there over its whole weight. Of a placeholder it is a bracketed group of any length,
whose terms are its brackets and what they hold (a name, a number, a word that asks for something). Of running filler,
longer than a window, it is a run of six words, and containment is the share of their weight that the exemplar has.

Terms are matched with one typing error and other endings; words of one meaning, whatever their language, are one term,
and so are all numbers. An index entry is kept only for an exemplar's rarest terms, of which a match must have one.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvasir.llm.residue_exemplars import ASKING, LATIN_FILLER, LEGIT, MEANINGS, PLACEHOLDERS, RESIDUE

SLOT, NUM = "slot", "num"
_MARK = "\ue000"  # stands for a placeholder while a text is cut
RUN = 6  # words of a window of running filler
LEAST_RUN = 4
_KEEP = 300_000  # words that a worker remembers

_GROUPS = re.compile(
    r"\{\{[^{}\n]+\}\}|\$\{[^{}\n]+\}|<%[^%\n]+%>|\[\[[^\[\]\n]+\]\]|@@[^@\n]+@@|%\([^()\n]+\)[sdif]|%[^\W\d][\w.]+%|#[^\W\d][\w.]+#"
    r"|(?<!\w)__[^\W_][\w.]*?__(?!\w)|\$[^\W\d][\w.]+\$|\{[^{}\n]+\}|<[^<>\n]+>|\[[^\[\]\n]+\]"
)
_OPENERS = re.compile(r"[{$<\[@%#_]")
_HOLDERS = ("{{", "${", "<%", "[[", "@@", "%(", "%", "#", "__", "$", "{", "<", "[")
_NAME = re.compile(r"\s*[^\W\d][\w.]*\s*")
_PLAIN = re.compile(r"[^\W\d_]+(?:['\u0300-\u036f][^\W\d_]+)*")
_WORDS = re.compile(_MARK + r"|\d[\d.,]*|[^\W\d_]+(?:['\u0300-\u036f][^\W\d_]+)*|(?<=[.!?…:;])\s|\n")
_DIGIT = re.compile(r"\d")
_HIDDEN = regex.compile(r"[\p{Cf}]")
_CYRILLIC = re.compile(r"[а-яА-ЯёЁ][а-яА-ЯёЁ _-]+")


def folded(text: str) -> str:
    """Lower case, compatibility forms composed, invisible characters dropped, one sign for apostrophes and for е and ё."""
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text)).replace("’", "'")
    return text.lower().replace("ё", "е")


def group_terms(group: str) -> list[str]:
    """The terms of a bracketed group: its brackets, and ``name``, ``index``, ``label`` or ``asks`` for what they hold."""
    mark = next(m for m in _HOLDERS if group.startswith(m))
    inner = group[len(mark) : len(group) - (2 if mark in ("%(", "<%") else 1 if mark == "${" else len(mark))]
    terms = [mark]
    if mark in ("#", "__") and inner.upper() != inner:
        return terms
    if mark == "<":
        if any(c in inner for c in "|/="):
            return []
        words = _PLAIN.findall(folded(inner))
        if _CYRILLIC.fullmatch(inner):
            terms.append("label")
        elif len(words) < 2 and not any(w in ("tbd", "todo") for w in words):
            return []
    elif inner.strip().isdecimal() and len(inner.strip()) <= 2:
        terms.append("index")
    elif _NAME.fullmatch(inner):
        terms.append("name")
    if any(asks(w) for w in _PLAIN.findall(folded(inner))):
        terms.append("asks")
    return terms


@functools.lru_cache(maxsize=50_000)
def asks(word: str) -> bool:
    """Whether a word within brackets asks for something to be filled in, or names what is to be filled in."""
    return word.startswith(ASKING[0]) or word in ASKING[1]


def sequence(text: str) -> list[str]:
    """The words of a text with ``slot``, ``num`` and, between sentences and lines, empty strings."""
    out = []
    for w in _WORDS.findall(folded(text)):
        if w == _MARK:
            out.append(SLOT)
        elif w[0].isdecimal():
            out.append(NUM)
        elif w.isspace():
            out.append("")
        else:
            out.append(w)
    return out


def _near(a: str, b: str) -> bool:
    """At most one letter changed, left out, put in or swapped with its neighbour."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


def _stem(word: str) -> str:
    return word if len(word) < 6 else word[: max(5, len(word) - 2)]


def _meaning(word: str) -> str | None:
    """The meaning of a word: that of a listed beginning, with an ending of up to four letters."""
    for n in range(min(len(word), 12), 1, -1):
        if len(word) - n <= (4 if n > 3 else 0) and (found := MEANINGS.get(word[:n])):
            return found
    return None


class Exemplars:
    """The labelled exemplars and the terms of their words."""

    def __init__(self) -> None:
        lines = [(kind, line) for kind, block in RESIDUE.items() for line in block.strip().split("\n")]
        lines += [("", line) for line in LEGIT.strip().split("\n")]
        words = [_PLAIN.findall(folded(line)) for _, line in lines]
        names = {*MEANINGS.values()}  # may stand in an exemplar for any of their words
        self.vocabulary: dict[str, str] = {SLOT: SLOT, NUM: NUM}  # word -> term
        for ws in words:
            for w in ws:
                self.vocabulary.setdefault(w, w if w in names else _meaning(w) or _stem(w))
        self.stems = set(self.vocabulary.values())
        self.filler = set(LATIN_FILLER.split())
        bags: dict[tuple[str, frozenset], list[str]] = {}
        for (kind, _), ws in zip(lines, words):  # exemplars of the same terms are one
            own = [self.vocabulary[w] for w in ws]
            bags.setdefault((kind, frozenset(Counter(own).items())), own)
        self.kinds = [kind for kind, _ in bags]
        self.terms = [Counter(own) for own in bags.values()]
        self.lengths = [len(own) for own in bags.values()]
        self.by_part: dict[str, list[str]] = {}
        for w in {*self.vocabulary, *self.filler}:
            if len(w) > 4:
                for part in {w[:2], w[2:4], w[-3:]}:
                    self.by_part.setdefault(part, []).append(w)
        self.known: dict[str, tuple[str | None, str | None]] = {}

    def near(self, word: str) -> list[str]:
        """The listed words of five letters or more within one typing error."""
        if len(word) < 5:
            return []
        return sorted({w for part in {word[:2], word[2:4], word[-3:]} for w in self.by_part.get(part, ()) if _near(word, w)})

    def terms_of(self, word: str) -> tuple[str | None, str | None]:
        """The term of the sentences' exemplars and the word of the running filler that a word stands for."""
        found = self.known.get(word)
        if found is None:
            term, filler = self.vocabulary.get(word), word if word in self.filler else None
            if term is None and (meaning := _meaning(word)) in self.stems:
                term = meaning
            if term is None and len(word) > 5 and _stem(word) in self.stems:
                term = _stem(word)
            if term is None and filler is None:
                near = self.near(word)
                term = next((self.vocabulary[w] for w in near if w in self.vocabulary), None)
                filler = next((w for w in near if w in self.filler and len(w) > 5 and len(word) > 5), None)
            if len(self.known) > _KEEP:
                self.known.clear()
            found = self.known[word] = (term, filler)
        return found


@functools.lru_cache(maxsize=1)
def exemplars() -> Exemplars:
    """This process's exemplars."""
    return Exemplars()


def _groups(text: str) -> list[tuple[int, int, list[str]]]:
    """The bracketed groups of a text with their terms, each told from words by a sign before it."""
    if not _OPENERS.search(text):
        return []
    found = [(m.start(), m.end(), group_terms(m[0])) for m in _GROUPS.finditer(text)]
    return [(a, b, ["<>" + t for t in terms]) for a, b, terms in found if terms]


class Scanner:
    """Judges texts with the term weights of a corpus."""

    def __init__(self, weights: dict[str, float], most: float, threshold: float):
        self.x, self.most, self.threshold = exemplars(), most, threshold
        x = self.x
        self.weight = {t: weights.get(t, most) for t in {t for own in x.terms for t in own}}
        self.total = [sum(self.weight[t] * n for t, n in own.items()) for own in x.terms]
        self.filler = {w: weights.get("~" + w, most) for w in x.filler}
        self.holders = []  # the exemplars of placeholders, as sets of terms with their weights
        for line in PLACEHOLDERS.strip().split("\n"):
            own = {t: weights.get(t, most) for t in ("<>" + t for t in line.split())}
            self.holders.append((own, sum(own.values())))
        # A window of high containment lacks less than the rest of the weight, so it has one of the rarest terms.
        self.index: dict[str, list[int]] = {}
        for e, own in enumerate(x.terms):
            if x.kinds[e]:
                seen = 0.0
                for t in sorted(own, key=lambda t: (-self.weight[t], t)):
                    if seen > (1 - threshold) * self.total[e]:
                        break
                    self.index.setdefault(t, []).append(e)
                    seen += self.weight[t] * own[t]
        self.legit = [e for e, kind in enumerate(x.kinds) if not kind]

    def best_window(self, e: int, terms: list[str | None], lo: int, hi: int) -> tuple[float, int, int]:
        """The highest containment of exemplar ``e`` in a window between two places, and the window."""
        own = self.x.terms[e]
        size = self.x.lengths[e] + max(1, self.x.lengths[e] // 3)
        spots = [i for i in range(lo, hi) if terms[i] in own]
        best, at = 0.0, (lo, lo)
        for k, i in enumerate(spots):
            left: Counter = Counter()
            got, last = 0.0, i
            for j in spots[k:]:
                if j >= i + size:
                    break
                t = terms[j]
                if left[t] < own[t]:
                    left[t] += 1
                    got += self.weight[t]
                    last = j
            if got > best:
                best, at = got, (i, last + 1)
        return best / self.total[e] if self.total[e] else 0.0, *at

    def holds(self, terms: list[str]) -> bool:
        """Whether a bracketed group contains enough of an exemplar of placeholders."""
        return any(sum(w for t, w in own.items() if t in terms) >= self.threshold * total for own, total in self.holders)

    def scan(self, text: str | None) -> tuple[float, str | None]:
        """The highest containment of residue in the text and its kind; 0 and None if there is none."""
        if not text:
            return 0.0, None
        groups = [(a, b) for a, b, terms in _groups(text) if self.holds(terms)]
        if groups:
            ends = [0, *(b for _, b in groups)]
            starts = [*(a for a, _ in groups), len(text)]
            text = f" {_MARK} ".join(text[a:b] for a, b in zip(ends, starts))
        words = _PLAIN.findall(folded(text))
        both = [self.x.terms_of(w) for w in words]
        have = Counter([t for t, _ in both if t])
        have[NUM] = 8  # as many as any exemplar asks for
        if groups:
            have[SLOT] = len(groups)
        latin = sum(1 for _, f in both if f) >= LEAST_RUN - 1
        hits = {e for t in have for e in self.index.get(t, ())}
        hits = {e for e in hits if sum(self.weight[t] * min(n, have[t]) for t, n in self.x.terms[e].items()) >= self.threshold * self.total[e]}
        broken = not hits and self._mended(words)
        if not (hits or latin or broken):
            return 0.0, None
        words = sequence(text)
        if broken:
            words = self._mend(words)
            terms = [self.x.terms_of(w)[0] if w else None for w in words]
            have = Counter(t for t in terms if t)
            hits = {e for t in have for e in self.index.get(t, ())}
        else:
            terms = [self.x.terms_of(w)[0] if w else None for w in words]
        best, kind = self._running(words) if latin else 0.0, "filler"
        for e in sorted(hits, key=lambda e: (-self.total[e], e)):
            for score, lo, hi in self._windows(e, terms):
                if score > best and not self._spoken_about(words, terms, e, score, lo, hi):
                    best, kind = score, self.x.kinds[e]
        return (best, kind) if best > 0 else (0.0, None)

    def _mended(self, words: list[str]) -> bool:
        """Whether a letter moved over the space between two words gives a rare term that an exemplar is found by."""
        for a, b in zip(words, words[1:]):
            for w in (a + b[0], a[-1] + b):
                if len(w) > 4 and w in self.x.vocabulary and self.x.vocabulary[w] in self.index:
                    return True
        return False

    def _mend(self, words: list[str]) -> list[str]:
        """The words with letters that were moved over a space put back."""
        out = list(words)
        for i in range(len(out) - 1):
            a, b = out[i], out[i + 1]
            if a and b and SLOT not in (a, b) and NUM not in (a, b):
                for x, y in ((a + b[0], b[1:]), (a[:-1], a[-1] + b)):
                    if (len(x) > 4 and x in self.x.vocabulary and a not in self.x.vocabulary) or (len(y) > 4 and y in self.x.vocabulary and b not in self.x.vocabulary):
                        out[i], out[i + 1] = x or NUM, y or NUM
                        break
        return out

    def _windows(self, e: int, terms: list[str | None]) -> Iterator[tuple[float, int, int]]:
        """All windows that reach the threshold, one after the other."""
        at = 0
        while at < len(terms):
            spot = next((i for i in range(at, len(terms)) if terms[i] in self.x.terms[e]), None)
            if spot is None:
                return
            end = min(len(terms), spot + self.x.lengths[e] + max(1, self.x.lengths[e] // 3))
            score, lo, hi = self.best_window(e, terms, spot, end)
            if score >= self.threshold:
                yield score, lo, hi
                at = hi
            else:
                at = spot + 1

    def _spoken_about(self, words: list[str], terms: list[str | None], e: int, score: float, lo: int, hi: int) -> bool:
        """Whether the sentence around a window contains an exemplar that speaks about residue, or too little besides a brief one."""
        a, b = lo, hi
        while a > 0 and words[a - 1]:
            a -= 1
        while b < len(words) and words[b]:
            b += 1
        near = Counter(t for t in terms[max(0, a - 1) : b + 41] if t)
        for other in self.legit:
            if sum(self.weight[t] * min(n, near[t]) for t, n in self.x.terms[other].items()) >= 0.5 * self.total[other]:
                size = self.x.lengths[other]
                s, _, _ = self.best_window(other, terms, max(0, a - 1), min(len(words), max(b, a + size) + 1))
                if s * self.total[other] > score * self.total[e] and s >= 0.55:
                    return True
        if self.x.kinds[e] == "placeholder":
            return False
        # A brief exemplar must be most of its sentence; a long one is specific enough by itself.
        if self.x.lengths[e] <= 3:
            return sum(1 for w in words[a:b] if w) > 2 * self.x.lengths[e] + 2
        return False

    def _running(self, words: list[str]) -> float:
        """The highest share of running filler in the weight of a window within a sentence, 0 below the threshold."""
        best, at = 0.0, 0
        while at < len(words):
            end = next((i for i in range(at, len(words)) if not words[i]), len(words))
            flags = []
            for w in words[at:end]:
                if w != NUM:
                    term, filler = self.x.terms_of(w)
                    flags.append((self.filler[filler], True) if filler else (self.weight.get(term, self.most) if term else self.most, False))
            for i in range(max(1, len(flags) - RUN + 1)):
                own = flags[i : i + RUN]
                got = sum(w for w, f in own if f)
                rest = sum(w for w, f in own if not f) + self.most * max(0, LEAST_RUN - len(own))
                if sum(f for _, f in own) >= LEAST_RUN - 1 and got >= self.threshold * (got + rest) * 0.999:
                    best = max(best, got / (got + rest))
            at = end + 1
        return best


def term_weights(df: DataFrame, text_col: str = "text") -> tuple[dict[str, float], float]:
    """The inverse document frequency of each exemplar term over all documents, and that of a term no document has.

    Every task counts the exemplars' terms alone, so what reaches the driver doesn't grow with the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, df_of, n = exemplars(), Counter(), 0
        for b in batches:
            for text in b.column(0).to_pylist():
                n += 1
                if text:
                    own = set()
                    for w in set(_PLAIN.findall(folded(text))):
                        term, filler = x.terms_of(w)
                        if term:
                            own.add(term)
                        if filler:
                            own.add("~" + filler)
                    for _, _, terms in _groups(text):
                        own.update((SLOT, *terms))
                    if _DIGIT.search(text):
                        own.add(NUM)
                    df_of.update(own)
        df_of[""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(df_of), pa.string()), pa.array(list(df_of.values()), pa.int64())], ["term", "n"])

    rows = df.select(text_col).mapInArrow(count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n_of = {r.term: r.n for r in rows}
    n = n_of.pop("", 0)
    return {t: math.log((n + 1) / (k + 1)) + 0.1 for t, k in n_of.items()}, math.log(n + 1) + 0.1


def residue_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.75) -> DataFrame:
    """``<id_col>, score, kind``: how much residue each document has, and of which kind.

    ``score`` is the highest containment of an exemplar in a window of the whole text, 0 below ``threshold``; ``kind``
    is ``placeholder``, ``filler``, ``error`` or ``scripts``, or null. Null, empty and blank texts score 0. Rows that
    are repeated stay repeated; further columns are not read; an empty table gives no rows.
    """
    weights, most = term_weights(df, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(weights, most, threshold)
        for b in batches:
            found = [scanner.scan(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([k for _, k in found], pa.string())], [id_col, "score", "kind"]
            )

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, score double, kind string")


def without_residue(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``df`` whose text has no residue."""
    bad = residue_scores(df, id_col, text_col, **params).where("score > 0").select(id_col).distinct()
    return df.join(bad, id_col, "left_anti")
