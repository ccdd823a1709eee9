"""Byte-level BPE encoding and decoding (operator 5).

A sentencepiece BPE model is written straight from the rank file: every byte is one character of a fixed block, a
token is the string of its bytes' characters, its score is the negative rank, and nothing is normalised. Sentencepiece
then merges the best-scored adjacent pair first, which is the pair of lowest rank. Each pre-token is encoded by itself.
Decoding maps ids back to the bytes of their tokens.

Null text: as an empty one, no ids, no bytes. Texts are never cut; equal rows give equal results."""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame

from .batches import Ragged, per_text
from .pretokens import Memory, byte_level

#: Byte b is the character _BLOCK + b in the model: letters that no normaliser of the library touches.
_BLOCK = 0x100
# Numbers that the format of sentencepiece models fixes.
_NORMAL, _UNKNOWN, _BPE = 1, 2, 2


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _blob(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def model_of(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model; its piece i + 1 is the token of rank i, piece 0 stands for unknown ones."""

    def piece(text: str, score: float, kind: int) -> bytes:
        return _blob(1, _blob(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))

    tokens = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must count from 0 without a gap")
    pieces = [piece("<unk>", 0, _UNKNOWN), *(piece("".join(chr(_BLOCK + b) for b in t), -float(r), _NORMAL) for r, t in enumerate(tokens))]
    trainer = _number(3, _BPE) + _number(4, len(pieces)) + _number(40, 0) + b"".join(_number(f, -1) for f in (41, 42, 43))
    normalizer = _blob(1, b"identity") + b"".join(_number(f, 0) for f in (3, 4, 5))
    return b"".join(pieces) + _blob(2, trainer) + _blob(3, normalizer)


class Codec:
    """encode() gives ids as an array, decode() the bytes of ids, digits() their decimal numbers joined by one space."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_of(self.ranks))
        tokens = sorted(self.ranks, key=self.ranks.get)
        self.kind = np.uint16 if len(tokens) <= 1 << 16 else np.uint32
        self.tokens, self.numbers = Ragged(tokens), Ragged([b"%d " % i for i in range(len(tokens))])
        self.known = Memory(self._find)

    def _find(self, pre_tokens: list[str]) -> list[bytes]:
        """The packed ids of each: that of a whole token, else those that the model merges it to."""
        whole = [self.ranks.get(p.encode()) for p in pre_tokens]
        rest = ["".join(chr(_BLOCK + b) for b in p.encode()) for p, w in zip(pre_tokens, whole, strict=True) if w is None]
        merged = iter(self.model.encode(rest, num_threads=1) if rest else [])
        return [(np.array(next(merged), self.kind) - self.kind(1) if w is None else np.array([w], self.kind)).tobytes() for w in whole]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.known.of(byte_level(text))), self.kind)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.tokens.joined(ids)

    def digits(self, ids: np.ndarray) -> bytes:
        return self.numbers.joined(ids)[:-1]


@lru_cache(2)
def codec(path: str) -> Codec:
    """One codec for all tasks of a worker."""
    return Codec(path)


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids array<int> of each row."""

    def make():
        c = codec(path)
        return lambda texts: ([c.encode(t or "").astype(np.int32) for t in texts],)

    return per_text(docs, make, "ids array<int>", key, text)


def round_trips(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens long, ids_sha256 (of the decimal ids joined by one space) and decoded_sha256 (of the decoded bytes)."""

    def make():
        c = codec(path)

        def work(texts):
            n, ids_sha, decoded_sha = [], [], []
            for t in texts:
                ids = c.encode(t or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(c.digits(ids)).hexdigest())
                decoded_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            return n, ids_sha, decoded_sha

        return work

    return per_text(docs, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", key, text)
