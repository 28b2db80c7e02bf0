"""Defective pairs of prompt and response.

Two models are fitted on all rows. A character n-gram naive Bayes gives the posterior of each language for the prompt and
for the response; its counts come from the corpus of documents and their language marks. An end-of-text model counts, for
the one to three words before any place in a response, how often a sentence, line or list item ends there: a response
whose last words are followed by an end too seldom breaks off. Refusals are told by a naive Bayes of the same kind whose
classes are labelled sentences and, as their background, all sentences of all responses.

The grams' counts are kept in a fixed number of hashed buckets. The contexts of the end-of-text model are counted exactly,
but only those are counted that some response without a full stop ends with: they are told first, a bitmap of fixed size
keeps the others out of the counting, and the counts are a distributed table that meets the responses in a join.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvasir.functions.blank import is_blank
from kvasir.operators.joins import skew_left_join
from kvasir.sources.tables import cut
from kvasir.llm.defect_exemplars import ECHO_WORDS, LANGUAGE_NAMES, POLITE, REFUSAL

GRAM_BITS = 15  # buckets of character n-grams
PHRASE_BITS = 19  # buckets of longer ones
ASKED_BITS = 23  # of the bitmap of word contexts that are asked for
LEAST_ROWS = 20  # of a language mark, which must also be more frequent than any malformed mark
LEAST_SEEN = 3  # times a context must have come
_KEEP = 100_000  # sentences that a worker remembers
LEAST_LETTERS = 5  # texts with fewer letters have no language
REFUSES = 0.27  # log odds a gram from which a sentence refuses
SURE = 4.0  # log odds from which a language is taken as known
# Over lower-case text; the standard library's patterns are the faster ones.
_CODE = re.compile(r"https?://\S+|\b[^\W\d_]{1,4}-\d[\d-]*|\d+(?:[.,]\d+)*")
_LETTERS = re.compile(r"[^\W\d_][^\W\d_'’\u0300-\u036f]*(?:['’\u0300-\u036f][^\W\d_]*)*")
_TOKENS = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f'’-])*|0|[^\s\w]|_|\n")
_ENDS = frozenset(".!?…\n")
_STOP = "\ue001"  # between texts that are read together
_HIDDEN = regex.compile(r"\p{Cf}")
_SENTENCES = re.compile(r"(?<=[.!?…])\s+|\n+")
_CLOSERS = "»”“\"')]"
_SIGNATURE = regex.compile(r"^\W*(с уважением|kind regards|best regards|regards|mit freundlichen gr|viele grüße|cordialement|bien à vous|ваш[аи]? )", regex.IGNORECASE)
_LINK = regex.compile(r"https?://\S+$|www\.\S+$", regex.IGNORECASE)
_ARTICLE = regex.compile(r"^\W*\p{L}[\p{L} .№]{0,24}\s*[:№]\s*[\p{L}\d][\p{L}\d./-]*\d$")
_LIST = regex.compile(r"^\s*(?:[-–•*]|\d{1,3}[.)])\s+")


def plain(text: str) -> str:
    """Compatibility forms composed, invisible characters dropped."""
    return text if text.isascii() else _HIDDEN.sub("", unicodedata.normalize("NFKC", text))


def coded(text: str) -> str:
    """A text in lower case with ``0`` for every number, product code and link."""
    return _CODE.sub(" 0 ", text.lower())


_seen: dict[str, str] = {}  # the words of sentences, as many come again


def sentences(text: str) -> list[str]:
    """The sentences and lines of a text, each as its words in lower case; codes, numbers and links are left out."""
    return _sentences(coded(text))


def _sentences(ready: str) -> list[str]:
    found = []
    for part in _SENTENCES.split(ready):
        words = _seen.get(part)
        if words is None:
            if len(_seen) > _KEEP:
                _seen.clear()
            words = _seen[part] = " ".join(_LETTERS.findall(part))
        if words:
            found.append(words)
    return found


def grams(words: str, least: int = 1, most: int = 3, bits: int = GRAM_BITS) -> np.ndarray:
    """The buckets of the letter grams of a sentence from :func:`sentences`, within and across words."""
    c = np.frombuffer(f" {words} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    h, found = np.zeros(len(c), np.int64), []
    for n in range(1, min(most, len(c)) + 1):
        h = (h[: len(c) - n + 1] * 1_000_003 + c[n - 1 :]) & 0x7FFFFFFFFFF
        if n >= least:
            found.append((h + n) * 0x9E3779B97F4A7C1 & 0x7FFFFFFFFFFFFFFF)
    return np.concatenate(found or [h[:0]]) >> (63 - bits)


def phrase(words: str) -> np.ndarray:
    """The longer grams, by which phrases are told apart."""
    return grams(words, 3, 6, PHRASE_BITS)


class Bayes:
    """Naive Bayes over hashed character grams. The scores of sentences are remembered, as many come again."""

    def __init__(self, names: list[str], counts: np.ndarray, smooth: float = 0.3, take=grams):
        self.names, self.take = names, take
        self.log = np.log((counts + smooth) / (counts.sum(1, keepdims=True) + smooth * counts.shape[1]))
        self.known: dict[str, tuple[float, ...]] = {}
        self.size: dict[str, int] = {}

    def scores(self, words: str) -> tuple[float, ...]:
        """The log likelihood of each class for a sentence; a third of the grams' sum, as grams of several lengths overlap."""
        found = self.known.get(words)
        if found is None:
            g = self.take(words)
            if len(self.known) > _KEEP:
                self.known.clear()
                self.size.clear()
            found = self.known[words] = tuple((self.log[:, g].sum(1) / 3).tolist())
            self.size[words] = len(g)
        return found

    def sure(self, parts: list[str]) -> str | None:
        """The class of a text, given by its sentences, if it is known."""
        if len(self.names) < 2 or sum(map(len, parts)) < LEAST_LETTERS:
            return None
        total = [sum(x) for x in zip(*map(self.scores, parts))]
        first = max(range(len(total)), key=total.__getitem__)
        second = max(x for i, x in enumerate(total) if i != first)
        return self.names[first] if total[first] - second >= SURE else None


def _buckets(df: DataFrame, columns: list[str], count) -> dict:
    """Sums over all rows of what ``count`` gives for a batch, a counter of ``(key, bucket)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            count(total, *(c.to_pylist() for c in b.columns))
        keys, buckets = [k for k, _ in total], [i for _, i in total]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(buckets, pa.int32()), pa.array(list(total.values()), pa.int64())], ["key", "bucket", "n"])

    rows = df.select(*columns).mapInArrow(run, "key string, bucket int, n bigint").groupBy("key", "bucket").agg(F.sum("n").alias("n")).toArrow()
    return {(k, b): n for k, b, n in zip(rows["key"].to_pylist(), rows["bucket"].to_pylist(), rows["n"].to_pylist())}


def _weighted(own: Counter, take) -> tuple[np.ndarray, np.ndarray]:
    """The grams of counted sentences, and how often each comes."""
    each = [take(w) for w in own]
    return np.concatenate(each), np.repeat(list(own.values()), [len(g) for g in each])


def _add(total: Counter, key: str, buckets: np.ndarray, weights: np.ndarray | None = None) -> None:
    own, back = np.unique(buckets, return_inverse=True)
    for i, k in zip(own.tolist(), np.bincount(back, weights).tolist()):
        total[key, i] += int(k)


def fit_languages(corpus: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Bayes:
    """The language model of a corpus with language marks, some of which may be absent or wrong."""
    mark = F.lower(F.trim(lang_col))
    marks = corpus.where(mark != "").groupBy(mark.alias("m")).agg(F.count(F.lit(1)).alias("n"))
    sound = F.col("m").rlike("^[a-z]{2,3}$")  # which bounds their number
    noise = marks.where(~sound).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    names = sorted(r.m for r in marks.where(sound & (F.col("n") >= LEAST_ROWS) & (F.col("n") > noise)).collect())
    known = set(names)

    def count(total: Counter, texts: list, langs: list) -> None:
        by: dict[str, Counter] = {}
        for t, m in zip(texts, langs):
            if t and m in known:
                by.setdefault(m, Counter()).update(sentences(plain(t)))
        for n, own in by.items():
            _add(total, n, *_weighted(own, grams))

    counts = np.zeros((len(names), 1 << GRAM_BITS))
    if names:
        for (n, i), k in _buckets(corpus.withColumn(lang_col, mark), [text_col, lang_col], count).items():
            counts[names.index(n), i] = k
    return Bayes(names, counts)


def words_of(text: str) -> list[str]:
    """The tokens of a text in lower case; every number and product code is ``0``."""
    return _TOKENS.findall(coded(text))


class _Numbers(dict):
    """A number for each word, the same in every process."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        n = self[word] = zlib.crc32(word.encode())
        return n


_numbers = _Numbers()
_END_NUMBERS = np.array(sorted(zlib.crc32(w.encode()) for w in _ENDS), np.int64)
_CUT_NUMBERS = np.array(sorted(zlib.crc32(w.encode()) for w in (_STOP, "|")), np.int64)


def _contexts(h: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The keys of the one, two and three words up to each place, and where they lie within one sentence and line."""
    found, key, good = [], np.zeros(len(h), np.int64), np.ones(len(h), bool)
    for n in range(3):
        if n >= len(h):
            break
        back, open_ = np.roll(h, n), np.roll(~ends, n)
        back[:n], open_[:n] = 0, False
        good = good & (open_ | (n == 0))
        key = (key * 1_000_003 + back) & 0x7FFFFFFFFFF
        found.append(((key + n) * 0x9E3779B97F4A7C1 & 0x7FFFFFFFFFFFFFFF, good))
    return found


def last_contexts(words: list[str]) -> list[int]:
    """The keys of the last one, two and three words, as in :func:`_contexts`, within the last sentence and line."""
    key, found = 0, []
    for n, w in enumerate(reversed(words[-3:])):
        if n and (w in _ENDS or w == "|"):
            break
        key = (key * 1_000_003 + _numbers[w]) & 0x7FFFFFFFFFF
        found.append((key + n) * 0x9E3779B97F4A7C1 & 0x7FFFFFFFFFFFFFFF)
    return found


def _count_ends(seen: Counter, ended: Counter, ready: list[str], asked: np.ndarray) -> None:
    words = _TOKENS.findall(_STOP.join(ready))
    if len(words) < 2:
        return
    h = np.fromiter(map(_numbers.__getitem__, words), np.int64, len(words))
    cut_ = np.isin(h, _CUT_NUMBERS)
    ends = np.isin(h, _END_NUMBERS) | cut_
    counted = ~ends[:-1] & ~cut_[1:]  # the end of a text counts neither way, it may be a broken one
    for key, good in _contexts(h, ends):
        key, where = key[:-1], counted & good[:-1]
        where &= asked[key >> (63 - ASKED_BITS)]
        for total, at in ((seen, where), (ended, where & ends[1:])):
            own, n = np.unique(key[at], return_counts=True)
            for k, c in zip(own.tolist(), n.tolist()):
                total[k] += c


def unfinished(df: DataFrame, id_col: str, response_col: str) -> DataFrame:
    """``<id_col>, sure, least, keys``: responses that break off for sure, or if their last words end something too seldom.

    ``keys`` are the contexts to look up, the longest last; ``least`` is the share of ends from which nothing is missing.
    A response whose last sign ends a sentence is left out without leaving the JVM, unless digits or emphasis come before.
    """
    whole = F.substring(F.rtrim(response_col), -2, 2).rlike(r"^[^0-9*_\s][.!?…]$")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *t) for i, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (t := breaks_off(plain(a))) is not None]
            ids, least, keys = ([r[j] for r in rows] for j in range(3))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, b.column(0).type), pa.array([not k for k in keys], pa.bool_()), pa.array(least, pa.float64()), pa.array(keys, pa.list_(pa.int64()))],
                [id_col, "sure", "least", "keys"],
            )

    rows = df.select(id_col, response_col).where(~whole & ~is_blank(F.col(response_col)))
    return rows.mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, sure boolean, least double, keys array<bigint>")


def fit_responses(df: DataFrame, text_col: str, open_ends: DataFrame) -> tuple[DataFrame, Bayes]:
    """In one pass over a column: how often its contexts that ``open_ends`` asks for come and end something (``key, seen, ended``), and the classes of refusals, polite phrases and, as background, all texts."""
    bit = F.shiftright("key", 63 - ASKED_BITS).cast("int")
    asked = np.zeros(1 << ASKED_BITS, bool)
    asked[open_ends.select(F.explode("keys").alias("key")).select(bit.alias("bit")).distinct().toArrow()["bit"].to_numpy()] = True
    packed = np.packbits(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(packed).astype(bool)
        seen, ended, answer = Counter(), Counter(), Counter()
        for b in batches:
            ready = [coded(plain(t)) for t in b.column(0).to_pylist() if t]
            _count_ends(seen, ended, ready, wanted)
            own: Counter = Counter()
            for t in ready:
                own.update(_sentences(t))
            if own:
                _add(answer, "answer", *_weighted(own, phrase))
        n = len(seen)
        kind = np.r_[np.zeros(n, bool), np.ones(len(answer), bool)]
        key = np.array([*seen, *(i for _, i in answer)], np.int64)
        count = np.array([*seen.values(), *answer.values()], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key), pa.array(count), pa.array([ended[k] for k in seen] + [0] * (len(key) - n), pa.int64())], ["gram", "key", "n", "ended"])

    both = cut(df.select(text_col).mapInArrow(run, "gram boolean, key bigint, n bigint, ended bigint"))
    counts = np.zeros((3, 1 << PHRASE_BITS))
    grams_of = both.where("gram").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    counts[0, grams_of["key"].to_numpy()] = grams_of["n"].to_numpy()
    for row, block in ((1, REFUSAL), (2, POLITE)):
        for line in block.strip().split("\n"):
            for words in sentences(line):
                counts[row] += np.bincount(phrase(words), minlength=1 << PHRASE_BITS)
    # Labelled sentences are few: what they don't say is half the time said as in the background.
    share = (counts + 0.05) / (counts + 0.05).sum(1, keepdims=True)
    share[1:] = (counts[1:] / counts[1:].sum(1, keepdims=True) + share[0]) / 2
    ends = both.where("not gram").groupBy("key").agg(F.sum("n").alias("seen"), F.sum("ended").alias("ended"))
    return ends, Bayes(["answer", "refusal", "polite"], share, 0.0, phrase)


def truncated(open_ends: DataFrame, ends: DataFrame, id_col: str) -> DataFrame:
    """``<id_col>``: the responses of :func:`unfinished` that break off, by the longest context seen often enough; each once."""
    asked = open_ends.where("not sure").select(id_col, "least", F.posexplode("keys").alias("size", "key"))
    known = skew_left_join(asked, ends.where(F.col("seen") >= LEAST_SEEN), "key")
    best = F.max(F.when(F.col("seen").isNotNull(), F.struct("size", (F.col("ended") / F.col("seen")).alias("share"))))
    judged = known.groupBy(id_col).agg(F.first("least").alias("least"), best["share"].alias("share"))
    late = judged.where(F.coalesce("share", F.lit(0.0)) < F.col("least")).select(id_col)
    return open_ends.where("sure").select(id_col).unionByName(late).distinct()


def is_copy(prompt: str, response: str) -> bool:
    """Whether a response is the prompt, once or repeatedly, with nothing else but words that introduce it."""
    ours = prompt.lower()
    word = _LETTERS_OR_DIGITS.search(ours)
    if word is None or len(response) < len(word[0]):
        return False
    low = response.lower()
    if word[0] not in low and "".join(ours[word.start() :].split())[:8] not in "".join(low.split()):
        return False
    want = _LETTERS_OR_DIGITS.findall(ours)
    have = _LETTERS_OR_DIGITS.findall(low)
    rest, i, found = [], 0, False
    while i < len(have):
        if have[i : i + len(want)] == want:
            i, found = i + len(want), True
        else:
            rest.append(have[i])
            i += 1
    if found:
        return len(rest) <= 6 and all(w in ECHO_WORDS for w in rest)
    whole, echo = "".join(want), "".join(w for w in have)
    return len(whole) >= 8 and echo.endswith(whole) and len(have) - len(want) <= 6 and all(w in ECHO_WORDS for w in have[: max(0, len(have) - len(want))])


_LETTERS_OR_DIGITS = re.compile(r"[^\W_]+")


def is_refusal(parts: list[str], model: Bayes) -> bool:
    """Whether a response, given by its sentences, has a refusing one and none that answers."""
    refused = False
    for words in parts:
        answer, refusal, polite = model.scores(words)
        n = model.size[words]
        if n < 9:
            continue
        if refusal - answer >= REFUSES * n and refusal > polite:
            refused = True
        elif polite <= answer:
            return False
    return refused


def breaks_off(response: str, least: float = 0.3) -> tuple[float, list[int]] | None:
    """The least share of ends and the contexts to look up, none for a response that breaks off for sure; None for a whole one."""
    end = len(response)
    while end and (response[end - 1] in "*_\ufe0f" or response[end - 1].isspace() or unicodedata.category(response[end - 1]) in ("So", "Sk", "Cf")):
        end -= 1
    text = response[:end]
    if text[-1:] in (".", "!", "?", "…") and not text[-2:-1].isdecimal():
        return None
    lines = [line for line in text.split("\n") if line.strip()]
    if not lines:
        return None
    last = lines[-1].strip()
    if last.startswith("|"):
        rows = [line.strip() for line in lines if line.strip().startswith("|")]
        bars = rows[0].count("|")
        return (least, []) if not last.endswith("|") or last.count("|") < bars or len(rows) < 3 else None
    bare = last.rstrip(_CLOSERS).rstrip()
    if len(bare) > 1 and bare[-1] == "." and bare[-2].isdecimal():  # a sentence's end, or a broken decimal number
        return least / 2, last_contexts(words_of(bare[:-1]))
    if not bare or bare[-1] in ".!?…":
        return None
    if bare[-1] in ":,;—–-(«„/=":
        return least, []
    if _SIGNATURE.match(last) or _LINK.search(last) or _ARTICLE.match(last):
        return None
    words = words_of(bare)
    return (least, last_contexts(words)) if words else None


def asked_language(prompt: str) -> set[str]:
    """The languages that a prompt names."""
    low = prompt.lower()
    return {lang for lang, names in LANGUAGE_NAMES.items() if any(n in low for n in names)}


def is_other_language(prompt: str, parts: list[str], languages: Bayes) -> bool:
    """Whether the language of a response, given by its sentences, is known and neither the prompt's known one nor one that it names."""
    ours = languages.sure(sentences(prompt))
    if ours is None:
        return False
    theirs = languages.sure(parts)
    return theirs is not None and theirs != ours and theirs not in asked_language(prompt)


def defective_pairs(
    df: DataFrame, corpus: DataFrame, *, id_col: str = "id", prompt_col: str = "query", response_col: str = "response"
) -> DataFrame:
    """``<id_col>, defect``: one row per record whose response is a bad answer, with the first defect that holds.

    In this order: ``empty`` (null, blank, or a word for a missing value), ``copy`` (the prompt and nothing more),
    ``refusal`` (declines or has no information, and answers nothing), ``other_language`` (unless the prompt asks for it
    or has no language itself), ``truncated``. A null or blank prompt can only have an empty, refusing or truncated
    response. Records delivered twice count once, ``corpus`` may be empty (then no language is known), texts are judged
    whole, further columns are not read.
    """
    rows = df.select(id_col, prompt_col, response_col, is_blank(F.col(response_col)).alias("_empty"))
    open_ends = cut(unfinished(df, id_col, response_col))
    languages, (ends, refusals) = fit_languages(corpus), fit_responses(df, response_col, open_ends)

    def judge(prompt: str | None, response: str) -> str | None:
        prompt, response = plain(prompt or ""), plain(response)
        if is_copy(prompt, response):
            return "copy"
        parts = sentences(response)
        if is_refusal(parts, refusals):
            return "refusal"
        return "other_language" if is_other_language(prompt, parts, languages) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, kinds = [], []
            for i, q, a, empty in zip(*(c.to_pylist() for c in b.columns)):
                kind = "empty" if empty else judge(q, a)
                if kind:
                    ids.append(i)
                    kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(kinds, pa.string())], [id_col, "defect"])

    # Few rows have a defect, so repeated records are taken out afterwards and no text is shuffled.
    found = rows.mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, defect string")
    found = found.unionByName(truncated(open_ends, ends, id_col).withColumn("defect", F.lit("truncated")))
    return found.groupBy(id_col).agg(F.min_by("defect", F.when(F.col("defect") == "truncated", 1).otherwise(0)).alias("defect"))
