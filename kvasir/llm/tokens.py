"""Encoding of a corpus with a public byte-level BPE tokenizer.

The vocabulary file (base64 token and rank per line) is serialised as a sentencepiece BPE model: every token, its bytes
mapped to printable characters, is a piece scored by its negative rank, and the normaliser is the identity. Texts are cut
into pre-tokens by the tokenizer's public pattern and each pre-token is encoded by sentencepiece, which merges the pair of
the best score first, that is of the lowest rank. Decoding is the inverse mapping of pieces to bytes.
"""

from __future__ import annotations

import base64
import functools
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = os.environ.get("KVASIR_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: how the public tokenizer cuts a text before merging.
PRE_TOKENS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LONG = 4096  # pre-tokens beyond this many bytes are not remembered
_KEEP = 200_000  # pre-tokens that a worker remembers


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where it is visible Latin-1, else the next code point from 256."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    letters = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


def read_vocabulary(path: str) -> list[bytes]:
    """The tokens by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def _field(number: int, kind: int, payload: bytes) -> bytes:
    return _varint(number << 3 | kind) + (_varint(len(payload)) if kind == 2 else b"") + payload


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def model_bytes(tokens: list[bytes]) -> bytes:
    """A sentencepiece model (its public protocol buffer) whose piece ids are the ranks, with one unknown piece after them."""
    letters = byte_letters()
    out = bytearray()
    normal, unknown = 1, 2
    for rank, token in enumerate(tokens):
        piece = "".join(letters[b] for b in token).encode()
        out += _field(1, 2, _field(1, 2, piece) + _field(2, 5, struct.pack("<f", -float(rank))) + _field(3, 0, _varint(normal)))
    out += _field(1, 2, _field(1, 2, b"<unk>") + _field(2, 5, struct.pack("<f", 0.0)) + _field(3, 0, _varint(unknown)))
    bpe = 2
    absent = _varint(-1)
    trainer = _field(3, 0, _varint(bpe)) + _field(4, 0, _varint(len(tokens) + 1)) + _field(40, 0, _varint(len(tokens)))
    trainer += b"".join(_field(n, 0, absent) for n in (41, 42, 43))  # no begin, end or padding piece
    normaliser = _field(1, 2, b"identity") + b"".join(_field(n, 0, _varint(0)) for n in (3, 4, 5))
    return bytes(out + _field(2, 2, trainer) + _field(3, 2, normaliser))


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str = VOCABULARY):
        import sentencepiece

        self.tokens = read_vocabulary(path)
        self.letters = byte_letters()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.tokens))
        self.pattern = regex.compile(PRE_TOKENS)
        self.table = {b: c for b, c in enumerate(self.letters)}
        self.known: dict[str, list[int]] = {}

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; none for an empty or null one. Lone surrogates are read as the replacement character."""
        known = self.known
        if len(known) > _KEEP:
            known.clear()
        cut = [self.pattern.findall(t) if t else [] for t in texts]
        new = list({w for words in cut for w in words if w not in known})
        shown = [w.encode("utf-8", "replace").decode("latin-1").translate(self.table) for w in new]
        brief: dict[str, list[int]] = {}
        for w, ids in zip(new, self.model.encode(shown, num_threads=1) if new else []):
            (known if len(w) <= _LONG else brief)[w] = ids
        return [[i for w in words for i in (known.get(w) or brief[w])] for words in cut]

    def decode(self, ids: list[int]) -> str:
        """The text of token ids."""
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def codec(path: str = VOCABULARY) -> Codec:
    """This process's codec for a vocabulary file."""
    return Codec(path)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``<id_col>, ids``: the token ids of each row's whole text, without special tokens.

    Empty and null texts have no tokens, an empty list. Strings that look like special tokens are plain text. Rows that
    are repeated stay repeated; further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                ids = coder.encode_all(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, ids array<int>")


def count_tokens(df: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ("doc_id", "source"), name: str = "tokens") -> DataFrame:
    """The columns ``keep`` and the number of tokens of each row's text."""
    types = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                n = [len(ids) for ids in coder.encode_all(part.column(0).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(n, pa.int64())], [*keep, name])

    return df.select(text_col, *keep).mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + f", `{name}` bigint")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``<id_col>, text``: the texts of token ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([coder.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], [id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, text string")
