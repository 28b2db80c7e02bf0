"""Abusive, hateful or sexual content.

A bidirectional gated recurrent network with attention pooling, trained here in numpy on reviewers' verdicts, scores all
overlapping windows of every text; a text's score is that of its worst window. A word enters as the sum of an embedding
of itself and the mean of those of its character grams, after letters that are spaced out, masked, repeated or replaced
by look-alikes have been put right.

A verdict concerns a whole text, so of a long abusive text one window is trained as abusive: at first the one whose words
come most often in abusive and least in clean texts, later the one that the network finds worst. Of the windows of clean
texts, those that the network finds worst are trained most.
Verdicts that are contrary to what the network has learnt from the others in its first rounds are taken as wrong and left out.
"""

from __future__ import annotations

import hashlib
import io
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvasir.sources.tables import shared_folder

LABELS = ("clean", "abuse", "hate", "sexual")
WINDOW, STRIDE = 14, 7  # words
DIM, HIDDEN = 32, 24
WORD_BUCKETS, GRAM_BUCKETS = 1 << 13, 1 << 14
LEAST_HELD = 20  # held-out cases that a threshold is set by; with fewer it is the highest
PRECISION, LEAST_THRESHOLD, MOST_THRESHOLD = 0.95, 0.75, 0.99  # how the threshold is set
CONTRADICTED = (0.1, 0.9)  # held-out scores of an abusive verdict below, and of a clean one above, that make it a wrong one
LABEL_ROWS = 12_000  # verdicts that the network is fitted on at most
SEED = 11
VERSION = 2  # of the way a model is fitted
DOUBTS = {2: 0.1, 4: 0.2, 7: 0.3}  # after which twelfths of the rounds verdicts are doubted, and below what chance
LEAST_STEPS, MOST_ROUNDS = 240, 60
WORST_FROM, HARD_FROM, HARD = 4, 3, 0.1  # the rounds from which the worst windows are taken, and what is hard
_KEEP = 200_000  # words that a worker remembers

_HIDDEN = re.compile("[\x00-\x08\x0b-\x1f\x7f-\x9f\xad؀-؅؜۝܏᠎​-‏‪-‮⁠-⁤⁦-⁯﻿￹-￻]")
_SPACED = re.compile(r"(?<![^\W_])(?:(?:[^\W_]|[@$#*])[\s._*•-]{1,2}){3,}(?:[^\W_]|[@$])(?![^\W_])")
_BROKEN = re.compile(r"(?:[^\W\d_][-_.])+[^\W\d_]{1,2}|[^\W\d_]+[-_][^\W\d_]{1,2}")
_BREAK = re.compile(r"(?<=[^\W\d_])[-_.](?=[^\W\d_])")
_CYRILLIC = re.compile("[Ѐ-ԯ]")
_CODE = re.compile(r"https?://\S+|\b[^\W\d_]{1,4}-\d[\d-]*|\b\d[\d.,]*(?!(?:[^\W\d_]|[@$]))")
_WORDS = re.compile(r"(?:[^\W]|[@$#*])(?:\w|[̀-ͯ@$#*'’-])*|[!?]+")
_REPEAT = re.compile(r"(.)\1{2,}")
# Latin letters and signs that look like Cyrillic ones, and signs that stand for Latin letters.
_TO_CYRILLIC = str.maketrans("aceopxykmhtbiur3406@", "асеорхукмнтвиигзчоба")
_TO_LATIN = str.maketrans("@$013457", "asoieast")


_words: dict[str, str] = {}  # tokens as words, as most come again


def _word(raw: str) -> str:
    """A token as a word; empty if nothing is left."""
    w = raw.lower().replace("ё", "е").strip("_'’-*")
    if w and any(map(str.isalpha, w)):
        if _BROKEN.fullmatch(w):
            w = _BREAK.sub("", w)
        if _CYRILLIC.search(w):
            w = w.translate(_TO_CYRILLIC)
        elif len(w) > 2:
            w = w.translate(_TO_LATIN)
        w = _REPEAT.sub(r"\1", w)
    return w


def words_of(text: str) -> list[str]:
    """The words of a text in lower case, with obfuscation undone; codes and numbers are ``0``."""
    text = _HIDDEN.sub("", text if text.isascii() else unicodedata.normalize("NFKC", text))
    text = _SPACED.sub(lambda m: "".join(c for c in m[0] if c not in " ._*•-\t\n\xa0"), text)
    out = []
    for raw in _WORDS.findall(_CODE.sub(" 0 ", text)):
        w = _words.get(raw)
        if w is None:
            if len(_words) > _KEEP:
                _words.clear()
            w = _words[raw] = _word(raw)
        if w:
            out.append(w)
    return out


def grams_of(word: str) -> list[int]:
    """The buckets of a word's character grams."""
    w = f"<{word}>"
    return sorted({zlib.crc32(w[i : i + n].encode()) % GRAM_BUCKETS for n in (2, 3, 4) for i in range(len(w) - n + 1)})


def windows_of(words: list[str]) -> list[list[str]]:
    """All overlapping windows of a text; at least one, and the last reaches the end."""
    if len(words) <= WINDOW:
        return [words]
    starts = [*range(0, len(words) - WINDOW, STRIDE), len(words) - WINDOW]
    return [words[i : i + WINDOW] for i in starts]


class _Features:
    """Words as numbers, each with its bucket and those of its grams in one flat list."""

    def __init__(self) -> None:
        self.of: dict[str, int] = {}
        self.bucket: list[int] = []
        self.grams: list[list[int]] = []

    def add(self, word: str) -> int:
        i = self.of.get(word)
        if i is None:
            i = self.of[word] = len(self.bucket)
            self.bucket.append(zlib.crc32(word.encode()) % WORD_BUCKETS)
            self.grams.append(grams_of(word))
        return i


def _sum_by(where: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of ``where`` and the sums of their rows."""
    order = np.argsort(where, kind="stable")
    own = where[order]
    begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    return own[begin], np.add.reduceat(rows[order], begin, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """The network's parameters, its forward and its backward pass."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        f = np.float32

        def normal(scale: float, *shape: int) -> np.ndarray:
            return (r.normal(size=shape) * scale).astype(f)

        self.p = {"word": normal(0.1, WORD_BUCKETS, DIM), "gram": normal(0.3, GRAM_BUCKETS, DIM)}
        for d in "fb":
            self.p |= {f"{d}x": normal(DIM**-0.5, DIM, 3 * HIDDEN), f"{d}h": normal(HIDDEN**-0.5, HIDDEN, 3 * HIDDEN), f"{d}0": np.zeros(3 * HIDDEN, f)}
        self.p |= {"att": normal(0.3, 2 * HIDDEN, 16), "att0": np.zeros(16, f), "attv": normal(0.3, 16)}
        self.p |= {"out": normal(0.3, 2 * HIDDEN, len(LABELS)), "out0": np.zeros(len(LABELS), f)}

    def represent(self, bucket: np.ndarray, flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The vectors of words from their buckets and their grams' (``flat``, from ``begin`` on for each word)."""
        size = np.diff(np.r_[begin, len(flat)])[:, None]
        return self.p["word"][bucket] + np.add.reduceat(self.p["gram"][flat], begin, axis=0) / size

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """One direction over ``x``, the projected inputs (batch, time, 3 * HIDDEN)."""
        n, t, _ = x.shape
        h, out = np.zeros((n, HIDDEN), np.float32), np.zeros((n, t, HIDDEN), np.float32)
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            hh = h @ self.p[f"{d}h"]
            z = _sigmoid(x[:, i, :HIDDEN] + hh[:, :HIDDEN])
            g = _sigmoid(x[:, i, HIDDEN : 2 * HIDDEN] + hh[:, HIDDEN : 2 * HIDDEN])
            c = np.tanh(x[:, i, 2 * HIDDEN :] + g * hh[:, 2 * HIDDEN :])
            m = mask[:, i, None]
            new = m * ((1 - z) * h + z * c) + (1 - m) * h
            if keep is not None:
                keep.append((i, h, hh, z, g, c, m))
            h = out[:, i] = new
        return out

    def forward(self, xf: np.ndarray, xb: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Class probabilities of windows from the projected inputs of both directions."""
        runs = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
        s = np.concatenate([self._run("f", xf, mask, runs["f"]), self._run("b", xb, mask, runs["b"])], axis=2)
        u = np.tanh(s @ self.p["att"] + self.p["att0"])
        e = u @ self.p["attv"] - 1e9 * (1 - mask)
        a = np.exp(e - e.max(1, keepdims=True))
        a /= a.sum(1, keepdims=True)
        v = (a[:, :, None] * s).sum(1)
        o = v @ self.p["out"] + self.p["out0"]
        q = np.exp(o - o.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        if keep is not None:
            keep |= {"runs": runs, "s": s, "u": u, "a": a, "v": v}
        return q

    def gradients(self, x: np.ndarray, mask: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the weighted cross entropy, those of the inputs ``x`` (batch, time, DIM) last."""
        k: dict = {}
        q = self.forward(x @ self.p["fx"] + self.p["f0"], x @ self.p["bx"] + self.p["b0"], mask, k)
        do = (q - target) * weight[:, None] / len(x)
        g = {"out": k["v"].T @ do, "out0": do.sum(0)}
        dv = do @ self.p["out"].T
        ds = k["a"][:, :, None] * dv[:, None, :]
        da = (k["s"] * dv[:, None, :]).sum(2)
        de = k["a"] * (da - (k["a"] * da).sum(1, keepdims=True))
        g["attv"] = np.einsum("bt,btk->k", de, k["u"])
        du = de[:, :, None] * self.p["attv"] * (1 - k["u"] ** 2)
        flat = du.reshape(-1, du.shape[2])
        g["att"], g["att0"] = k["s"].reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(0)
        ds += du @ self.p["att"].T
        dx = np.zeros_like(x)
        for d, at in (("f", 0), ("b", HIDDEN)):
            dh = np.zeros((len(x), HIDDEN), np.float32)
            dwh, dxx = np.zeros_like(self.p[f"{d}h"]), np.zeros((*x.shape[:2], 3 * HIDDEN), np.float32)
            for i, h, hh, z, r, c, m in reversed(k["runs"][d]):
                dn = dh + ds[:, i, at : at + HIDDEN]
                dm = dn * m
                dz, dc = dm * (c - h) * z * (1 - z), dm * z * (1 - c * c)
                dr = dc * hh[:, 2 * HIDDEN :] * r * (1 - r)
                dxx[:, i] = np.concatenate([dz, dr, dc], axis=1)
                dhh = np.concatenate([dz, dr, dc * r], axis=1)
                dwh += h.T @ dhh
                dh = dn * (1 - m) + dm * (1 - z) + dhh @ self.p[f"{d}h"].T
            g[f"{d}h"] = dwh
            two = dxx.reshape(-1, 3 * HIDDEN)
            g[f"{d}x"], g[f"{d}0"] = x.reshape(-1, DIM).T @ two, two.sum(0)
            dx += dxx @ self.p[f"{d}x"].T
        return g, dx


def _flat(grams: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    begin = np.cumsum([0] + [len(x) for x in grams[:-1]])
    return np.array([i for x in grams for i in x]), begin


def _noisy(word: str, rng: random.Random) -> str:
    """A word as someone might misspell it: a letter masked, dropped, doubled or swapped."""
    if len(word) < 4:
        return word
    i = rng.randrange(1, len(word) - 1)
    return rng.choice([word[:i] + rng.choice("*#_") + word[i + 1 :], word[:i] + word[i + 1 :], word[:i] + word[i] + word[i:], word[: i - 1] + word[i] + word[i - 1] + word[i + 1 :]])


class Model(NamedTuple):
    """A fitted network and the score from which a text is a case."""

    net: Network
    threshold: float


def train(samples: list[tuple[str, str]], *, rounds: int = 12, seed: int = SEED) -> Model:
    """A network fitted on ``(text, label)`` verdicts, with its threshold; equal texts count once, with their most frequent label.

    Two networks are fitted first, each on one half of the texts, and judge the other half. A verdict that they contradict
    is taken as wrong and left out. The threshold is the lowest score at which these held-out verdicts reach
    :data:`PRECISION`, but not below :data:`LEAST_THRESHOLD`, or :data:`MOST_THRESHOLD` if none does.
    """
    votes: dict[tuple[str, ...], Counter] = defaultdict(Counter)
    for text, label in samples:
        if label in LABELS and (words := tuple(words_of(text))):
            votes[words][label] += 1
    texts = sorted((w, LABELS.index(max(v, key=lambda x: (v[x], -LABELS.index(x))))) for w, v in votes.items())
    half = [zlib.crc32(" ".join(w).encode()) & 1 for w, _ in texts]
    held = np.zeros(len(texts))
    for h in (0, 1):
        mine = [t for t, own in zip(texts, half) if own != h]
        if any(y for _, y in mine):
            at = [i for i, own in enumerate(half) if own == h]
            held[at] = Scorer(fit(mine, rounds=rounds * 2 // 3, seed=seed + h)).scores([list(texts[i][0]) for i in at]).sum(1)
    bad = np.array([y > 0 for _, y in texts])
    wrong = np.where(bad, held < CONTRADICTED[0], held > CONTRADICTED[1])
    grid = np.arange(LEAST_THRESHOLD, MOST_THRESHOLD, 0.02)
    good = [t for t in grid if (held >= t).sum() >= LEAST_HELD and (bad | wrong)[held >= t].mean() >= PRECISION]
    kept = [t for t, w in zip(texts, wrong) if not w]
    if not any(y for _, y in kept):  # too few verdicts to tell wrong ones
        kept = texts
    return Model(fit(kept, rounds=rounds, seed=seed), float(good[0]) if good else MOST_THRESHOLD)


def fit(texts: list[tuple[tuple[str, ...], int]], *, rounds: int = 12, batch: int = 192, rate: float = 0.005, least_clean: int = 3000, seed: int = SEED) -> Network:
    """A network fitted on texts, given by their words, and the numbers of their labels.

    Each round sees all abusive texts and, drawn anew, ``least_clean`` distinct windows of clean texts or six times as many
    as of abusive ones, whichever are more, and the clean windows that look worst.
    """
    net, f, rng, gen = Network(seed), _Features(), random.Random(seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    step, trust = 0, np.ones(len(texts), np.float32)
    n_bad = max(1, sum(y > 0 for _, y in texts))
    # Distinct windows of clean texts, and in how many texts each is.
    seen: dict[tuple[str, ...], list[int]] = {}
    for i, (w, y) in enumerate(texts):
        if y == 0:
            for s in dict.fromkeys(map(tuple, windows_of(list(w)))):
                seen.setdefault(s, [i, 0])[1] += 1
    usual = [(list(s), 0, i, min(4.0, n**0.5)) for s, (i, n) in seen.items() if n > 2]
    single = [(list(s), 0, i, 1.0) for s, (i, n) in seen.items() if n <= 2]
    n_clean = min(len(single), max(least_clean, 6 * n_bad))
    first = _telling_windows(texts)
    up = min(4.0, max(1.0, (n_clean + len(usual)) / n_bad / 6))  # the classes' weights, so that rare abuse counts
    # Few verdicts are gone through more often, so that the network has learnt something before any is doubted.
    each = -(-(len(usual) + n_clean + 2 * n_bad) // batch)
    rounds = max(rounds, min(MOST_ROUNDS, -(-LEAST_STEPS // each)))
    doubts = {rounds * part // 12: chance for part, chance in DOUBTS.items()}
    for turn in range(rounds):
        rows = usual + rng.sample(single, n_clean)
        if turn >= HARD_FROM:  # the clean windows that look worst, of texts that aren't doubted
            every = usual + single
            looks = 1 - Scorer(net, f).windows([s for s, *_ in every])[:, 0]
            hard = [i for i in np.argsort(-looks, kind="stable").tolist() if trust[every[i][2]]][: max(1, n_clean // 4)]
            rows += [every[i] for i in hard if looks[i] > HARD]
        worst = _worst_windows(Scorer(net, f), texts) if turn >= WORST_FROM else first
        for i, (words, y) in enumerate(texts):
            if y:
                spans = windows_of(list(words))
                s = spans[worst.get(i, rng.randrange(len(spans)))]
                rows.append((s, y, i, up))
                rows.append(([_noisy(w, rng) if rng.random() < 0.2 else w for w in s], y, i, up))
        rng.shuffle(rows)
        lr = rate * (1 - turn / rounds) + 1e-4
        for at in range(0, len(rows), batch):
            part = rows[at : at + batch]
            ids = np.zeros((len(part), WINDOW), np.int64)
            mask = np.zeros((len(part), WINDOW), np.float32)
            for r, (s, *_) in enumerate(part):
                ids[r, : len(s)] = [f.add(w) for w in s]
                mask[r, : len(s)] = 1
            own, inverse = np.unique(ids, return_inverse=True)
            flat, begin = _flat([f.grams[i] for i in own])
            bucket = np.array([f.bucket[i] for i in own])
            vec = net.represent(bucket, flat, begin)
            drop = (gen.random(vec.shape) > 0.15).astype(np.float32) / 0.85
            x = (vec * drop)[inverse.reshape(ids.shape)] * mask[:, :, None]
            y = np.array([c for _, c, _, _ in part])
            target = np.full((len(part), len(LABELS)), 0.02 / 3, np.float32)
            target[np.arange(len(part)), y] = 0.98
            weight = trust[[i for _, _, i, _ in part]] * np.array([w for *_, w in part], np.float32)
            g, dx = net.gradients(x.astype(np.float32), mask, target, weight)
            dvec = _sum_by(inverse.reshape(-1), (dx * mask[:, :, None]).reshape(-1, DIM))[1] * drop
            size = np.diff(np.r_[begin, len(flat)])
            step += 1
            fix = (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for key, where, grad in (("word", bucket, dvec), ("gram", flat, np.repeat(dvec / size[:, None], size, axis=0))):
                rows_, total = _sum_by(where, grad)
                m[key][rows_] = 0.9 * m[key][rows_] + 0.1 * total
                v2[key][rows_] = 0.999 * v2[key][rows_] + 0.001 * total * total
                net.p[key][rows_] -= lr * fix * m[key][rows_] / (np.sqrt(v2[key][rows_]) + 1e-8)
            for key, grad in g.items():
                grad = np.clip(grad, -1, 1)
                m[key] = 0.9 * m[key] + 0.1 * grad
                v2[key] = 0.999 * v2[key] + 0.001 * grad * grad
                net.p[key] -= (lr * fix * m[key] / (np.sqrt(v2[key]) + 1e-8)).astype(np.float32)
        if turn in doubts:
            s = Scorer(net, f).scores([list(w) for w, _ in texts]).sum(1)
            bad = np.array([y > 0 for _, y in texts])
            trust = np.where(bad, s > doubts[turn], s < 1 - doubts[turn] / 4).astype(np.float32)
    return net


def _telling_windows(texts: list[tuple[tuple[str, ...], int]]) -> dict[int, int]:
    """The window of each longer abusive text whose words tell abusive from clean texts best."""
    n = [Counter(), Counter()]
    for words, y in texts:
        n[y > 0].update(set(words))
    size = [1 + sum(y == 0 for _, y in texts), 1 + sum(y > 0 for _, y in texts)]
    odds = lambda w: np.log((n[1][w] + 0.05) / size[1]) - np.log((n[0][w] + 0.5) / size[0])
    known: dict[str, float] = {}
    best = {}
    for i, (words, y) in enumerate(texts):
        if y and len(words) > WINDOW:
            for w in words:
                if w not in known:
                    known[w] = float(odds(w))
            sums = [sum(sorted((known[w] for w in set(s)), reverse=True)[:4]) for s in windows_of(list(words))]
            best[i] = int(np.argmax(sums))
    return best


def _worst_windows(scorer: Scorer, texts: list[tuple[tuple[str, ...], int]]) -> dict[int, int]:
    """The window of each longer abusive text that fits its label best."""
    own, flat = [], []
    for i, (words, y) in enumerate(texts):
        if y and len(words) > WINDOW:
            spans = windows_of(list(words))
            own += [(i, k, y) for k in range(len(spans))]
            flat += spans
    best: dict[int, tuple[float, int]] = {}
    for (i, k, y), q in zip(own, scorer.windows(flat) if flat else []):
        if q[y] > best.get(i, (-1.0, 0))[0]:
            best[i] = (float(q[y]), k)
    return {i: k for i, (_, k) in best.items()}


class Scorer:
    """Scores texts with a fitted network; words' projected vectors are computed once."""

    def __init__(self, net: Network, features: _Features | None = None):
        self.net, self.f = net, features or _Features()  # words may be known already
        self.table = np.zeros((0, 6 * HIDDEN), np.float32)

    def _extend(self) -> None:
        have, want = len(self.table), len(self.f.bucket)
        if want > have:
            flat, begin = _flat(self.f.grams[have:])
            vec = self.net.represent(np.array(self.f.bucket[have:]), flat, begin).astype(np.float32)
            p = self.net.p
            self.table = np.vstack([self.table, np.hstack([vec @ p["fx"] + p["f0"], vec @ p["bx"] + p["b0"]])])

    def windows(self, spans: list[list[str]]) -> np.ndarray:
        """Class probabilities of windows."""
        if len(self.f.bucket) > _KEEP:
            self.f, self.table = _Features(), self.table[:0]
        out = []
        for at in range(0, len(spans), 1024):
            part = spans[at : at + 1024]
            ids, mask = np.zeros((len(part), WINDOW), np.int64), np.zeros((len(part), WINDOW), np.float32)
            for r, s in enumerate(part):
                ids[r, : len(s)] = [self.f.add(w) for w in s]
                mask[r, : len(s)] = 1
            self._extend()
            if not len(self.table):
                out.append(np.eye(len(LABELS), dtype=np.float32)[np.zeros(len(part), int)])
                continue
            x = self.table[ids]
            out.append(self.net.forward(x[:, :, : 3 * HIDDEN], x[:, :, 3 * HIDDEN :], mask))
        return np.concatenate(out) if out else np.zeros((0, len(LABELS)), np.float32)

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        """Of each text the highest probability of abuse, hate and sexual content among its windows; 0 for one without words."""
        spans, first = [], []
        for words in texts:
            first.append(len(spans))
            spans += windows_of(words) if words else [["0"]]
        if not spans:
            return np.zeros((0, len(LABELS) - 1), np.float32)
        q = self.windows(spans)
        best = np.maximum.reduceat(q[:, 1:], first, axis=0)
        worst = np.maximum.reduceat(1 - q[:, :1], first, axis=0)
        best *= worst / np.maximum(best.sum(1, keepdims=True), 1e-9)  # the classes share the chance that it isn't clean
        best[[not w for w in texts]] = 0
        return best


def verdicts(chat: DataFrame, labels: DataFrame, fields: tuple[str, ...] = ("query", "response"), most: int = LABEL_ROWS) -> list[tuple[str, str]]:
    """At most ``most`` labelled texts, chosen by a hash of the record and field."""
    rows = labels.select(F.col("chatId").alias("id"), "field", "label").where(F.col("field").isin(*fields) & F.col("label").isin(*LABELS) & F.col("id").isNotNull())
    rows = rows.distinct().orderBy(F.xxhash64("id", "field"), "id", "field", "label").limit(most)
    text = F.coalesce(*(F.when(F.col("field") == f, F.col(f)) for f in fields))
    found = chat.select("id", *fields).join(F.broadcast(rows), "id").select("id", "field", "label", text.alias("text")).where("text is not null")
    return sorted((r.text, r.label) for r in found.dropDuplicates(["id", "field", "label"]).collect())


def fit_abuse(chat: DataFrame, labels: DataFrame, fields: tuple[str, ...] = ("query", "response"), most: int = LABEL_ROWS) -> Model | None:
    """The model of at most ``most`` verdicts, or None if none of them is of abuse.

    It is kept in the shared folder under a digest of the verdicts, so that it is fitted once for all queries.
    """
    samples = verdicts(chat, labels, fields, most)
    if not {y for _, y in samples} - {"clean"}:
        return None
    spark = chat.sparkSession
    name = hashlib.sha256(repr((VERSION, samples)).encode()).hexdigest()[:24]
    path = f"{shared_folder(spark)}/abuse-model-{name}"
    try:
        raw, threshold = spark.read.parquet(path).first()
        net = Network()
        with np.load(io.BytesIO(raw)) as stored:
            net.p = {k: stored[k] for k in stored.files}
        return Model(net, threshold)
    except (AnalysisException, TypeError):  # not there, or not written to the end
        model = train(samples)
    buffer = io.BytesIO()
    np.savez(buffer, **model.net.p)
    spark.createDataFrame([(bytearray(buffer.getvalue()), model.threshold)], "net binary, threshold double").coalesce(1).write.mode("overwrite").parquet(path)
    return model


def abuse_scores(chat: DataFrame, model: Model | None, fields: tuple[str, ...] = ("query", "response"), *, keep: tuple[str, ...] = ("source",)) -> DataFrame:
    """``id, field, <keep>, abuse, hate, sexual, score``: the chances that a window of a text has such content.

    One row per record and field, records delivered twice once. ``score`` is the chance of any of the three. Null and
    empty texts, and texts without words, score 0; texts are scored whole. Without a model, of :func:`fit_abuse`, nothing
    is known and all texts score 0. Further columns are not read.
    """
    net = model.net if model else None
    rows = chat.select("id", *keep, *fields)
    types = dict(chat.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net) if net else None
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                head = part.columns[: 1 + len(keep)]
                for f, column in zip(fields, part.columns[1 + len(keep) :]):
                    texts = [words_of(t) if t else [] for t in column.to_pylist()]
                    s = scorer.scores(texts).astype(np.float64) if scorer else np.zeros((len(texts), 3))
                    marks = pa.array([f] * part.num_rows, pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [head[0], marks, *head[1:], *(pa.array(s[:, i]) for i in range(3)), pa.array(s.sum(1))],
                        ["id", "field", *keep, *LABELS[1:], "score"],
                    )

    schema = ", ".join([f"id {types['id']}", "field string", *(f"`{c}` {types[c]}" for c in keep), "abuse double, hate double, sexual double, score double"])
    # Repeated records are taken out of the narrow result, so that no text is shuffled.
    return rows.mapInArrow(run, schema).dropDuplicates(["id", "field"])


def abuse_rates(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``source, field, texts, cases, rate``: how many texts of each source score ``threshold`` or more."""
    case = F.sum(F.when(F.col("score") >= threshold, 1).otherwise(0))
    return scores.groupBy("source", "field").agg(F.count(F.lit(1)).alias("texts"), case.alias("cases"), F.round(case / F.count(F.lit(1)), 6).alias("rate"))
