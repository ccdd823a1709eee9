"""Cross-tokenizer alignment (operator 12): which tokens of two vocabularies cover the same bytes of a text.

Texts are tokenised and aligned in one Arrow pass. The ends that both vocabularies have cut the tokens into groups. Two
tokens overlap in one stretch of bytes without any end inside, so each end of either vocabulary stands for one link: of the
tokens that it ends, or that go on over it. Running counts of both vocabularies' ends over a text's bytes say which these
are, and where in its groups' text each token stands. Everything is whole arrays, in proportion to the bytes.

A pair of ids is counted once for each document that links it. Documents take the counts back by a broadcast of the pairs
where these are few enough, which is looked at, else by a shuffled join in which hot pairs go apart.

Null and empty texts, and those whose tokens don't spell them (a vocabulary may change or drop characters), have no
tokens: zeros, and an empty groups_sha256. Equal rows count each for itself. Columns other than key and text are ignored."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import Ragged, per_text
from .common import HOT, stored
from .pretokens import BYTE_PATTERN
from .token_counts import _byte_letters

ROW = "_aligned_row"
#: Pairs of ids that are broadcast; beyond it they are joined by a shuffle.
BROADCAST = 2_000_000
#: Characters tokenised at once.
_AT_ONCE = 1 << 20
_LONG_BLANK = re.compile(r"\s{1000}")


class Tokenizers:
    """Both vocabularies: ids and byte ends of a text, or nothing where the tokens don't spell it."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        with open(byte_level, encoding="utf-8") as f:
            held = json.load(f)
        byte_of = {letter: b for b, letter in enumerate(_byte_letters())}
        spelled = {i: t for t, i in held["model"]["vocab"].items()}
        self.a_tokens = Ragged([bytes(byte_of[c] for c in spelled.get(i, "") if c in byte_of) for i in range(max(spelled) + 1)])
        self.b_tokens = Ragged([self._piece(i) for i in range(self.b.get_piece_size())])
        self.numbers = _numbers(max(len(self.a_tokens.length), len(self.b_tokens.length)))
        #: The same vocabulary in another library, many times faster, where its ranks are its ids and its pre-tokens usual ones.
        self.fast = self._by_rank(held, byte_of)

    @staticmethod
    def _by_rank(held: dict, byte_of: dict[str, int]) -> tiktoken.Encoding | None:
        split, vocab = held.get("pre_tokenizer") or {}, held["model"]["vocab"]
        merged = ("".join(m.split(" ")) if isinstance(m, str) else "".join(m) for m in held["model"]["merges"])
        usual = [split.get(k) for k in ("type", "add_prefix_space", "use_regex")] == ["ByteLevel", False, True] and not held.get("normalizer")
        if not usual or any(vocab.get(t) != i for i, t in enumerate(merged, 256)):
            return None
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if all(c in byte_of for c in t)}
        ranks = {b: i for b, i in ranks.items() if i < 256 + len(held["model"]["merges"])}  # without special tokens
        return tiktoken.Encoding("by rank", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _ids_a(self, texts: list[str]) -> list[np.ndarray]:
        def by_library(some: list[str]) -> list[np.ndarray]:
            return [np.array(e.ids, np.int32) for e in self.a.encode_batch_fast(some, add_special_tokens=False)]

        if not self.fast:
            return by_library(texts)
        # the other library gives up on very long blanks
        return [by_library([t])[0] if _LONG_BLANK.search(t) else np.array(self.fast.encode_ordinary(t), np.int32) for t in texts]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    @staticmethod
    def _ends(ids: np.ndarray, spelling: Ragged, text: bytes) -> np.ndarray | None:
        return np.cumsum(spelling.length[ids]) if spelling.joined(ids) == text else None

    def both(self, texts: list[str]) -> list[tuple]:
        """ids and ends by A, ids and ends by B of each text, which isn't empty."""
        out = []
        for text, a, b in zip(texts, self._ids_a([" " + t for t in texts]), self.b.encode(texts, num_threads=1), strict=True):
            b, whole = np.array(b, np.int32), b" " + text.encode()
            ends_a, ends_b = self._ends(a, self.a_tokens, whole), self._ends(b, self.b_tokens, whole)
            out.append(([], [], [], []) if ends_a is None or ends_b is None else (a, ends_a, b, ends_b))
        return out


@lru_cache(2)
def tokenizers(byte_level: str, pieces: str) -> Tokenizers:
    """One pair for all tasks of a worker."""
    return Tokenizers(byte_level, pieces)


def _of_both(t: Tokenizers, texts: list[str | None]) -> list[tuple]:
    """t.both of each text, about _AT_ONCE characters at a time."""
    rows: list[tuple] = [([], [], [], [])] * len(texts)
    some, size = [], 0
    for i, x in enumerate(texts):
        if x:
            some.append(i)
            size += len(x)
        if some and (size >= _AT_ONCE or i == len(texts) - 1):
            for j, found in zip(some, t.both([texts[j] for j in some]), strict=True):
                rows[j] = found
            some, size = [], 0
    return rows


def tokenised(docs: DataFrame, byte_level: str, pieces: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, a and b (ids), ends_a and ends_b (the byte behind each token) of each row."""

    def make():
        t = tokenizers(byte_level, pieces)
        return lambda texts: tuple(zip(*_of_both(t, texts))) if texts else ([], [], [], [])

    return per_text(docs, make, "a array<int>, ends_a array<int>, b array<int>, ends_b array<int>", key, text)


def _numbers(most: int) -> np.ndarray:
    """The decimals of 0 to most - 1 before a comma, then before a bar, then before a semicolon."""
    decimals = np.arange(most).astype(f"S{len(str(most))}")
    return np.concatenate([np.char.add(decimals, behind) for behind in (b",", b"|", b";")])


def _groups(a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray, numbers: np.ndarray) -> tuple:
    """n_a, n_b, n_groups, n_single, groups and links of the tokens of a text, see aligned."""
    if not len(a):
        return 0, 0, 0, 0, b"", []
    in_a, in_b = np.zeros(ends_a[-1] + 1, bool), np.zeros(ends_a[-1] + 1, bool)
    in_a[ends_a], in_b[ends_b] = True, True
    upto_a, upto_b = np.cumsum(in_a, dtype=np.int32), np.cumsum(in_b, dtype=np.int32)
    ends, cuts = np.flatnonzero(in_a | in_b), np.flatnonzero(in_a & in_b)
    links = (a[upto_a[ends] - in_a[ends]].astype(np.int64) << 32) + b[upto_b[ends] - in_b[ends]]
    after_a, after_b = upto_a[cuts], upto_b[cuts]
    size_a, size_b = np.diff(after_a, prepend=0), np.diff(after_b, prepend=0)
    # tokens of A stand behind those of B of all groups before, tokens of B behind those of A of their own group too
    place_a, place_b = np.arange(len(a)) + np.repeat(after_b - size_b, size_a), np.arange(len(b)) + np.repeat(after_a, size_b)
    which, most = np.empty(len(a) + len(b), np.int64), len(numbers) // 3
    which[place_a], which[place_b] = a, b
    which[place_a[after_a - 1]] += most
    which[place_b[after_b - 1]] += 2 * most
    return len(a), len(b), len(cuts), int(((size_a == 1) & (size_b == 1)).sum()), numbers[which].tobytes().translate(None, b"\0")[:-1], links


def aligned(docs: DataFrame, byte_level: str, pieces: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_a, n_b, n_groups, n_single (groups of one token each), groups (`a1,a2|b1;a3|b2,b3`) and links (pairs of ids,
    A's in the upper half of a long, in order) of each row."""

    def make():
        t = tokenizers(byte_level, pieces)
        return lambda texts: tuple(zip(*(_groups(*found, t.numbers) for found in _of_both(t, texts)))) if texts else ([], [], [], [], [], [])

    return per_text(docs, make, "n_a int, n_b int, n_groups int, n_single int, groups string, links array<bigint>", key, text)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, docs (how many rows have it linked) and best (whether no pair of the same A id has more)."""
    counted = rows.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))
    most = F.max("docs").over(Window.partitionBy(F.shiftright("pair", 32)))  # ids of B at most
    return counted.select("pair", "docs", (F.col("docs") == most).alias("best"))


def _with_counts(each: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """each (ROW, pair) with docs and best. Pairs of a thousandth of the rows or more are broadcast, the rest shuffled."""
    if counts.count() <= BROADCAST:
        return each.join(F.broadcast(counts), "pair")
    hot = F.col("docs") * HOT >= total  # a document links hundreds of pairs or more: bounded by HOT times that
    few = counts.where(hot)
    return each.join(F.broadcast(few), "pair").unionByName(each.join(F.broadcast(few.select("pair")), "pair", "left_anti").join(counts.where(~hot), "pair"))


def digest(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and n_single of each row of docs."""
    found = aligned(docs, byte_level, pieces).withColumn(ROW, F.monotonically_increasing_id())
    digested = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    rows = stored(found.select(ROW, "doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("n_a", "n_b", "n_groups", "n_single")], digested.alias("groups_sha256"), "links"), "aligned")
    counts = stored(pair_counts(rows), "aligned-pairs")
    each = _with_counts(rows.select(ROW, F.explode("links").alias("pair")), counts, rows.count())
    sums = each.groupBy(ROW).agg(F.sum("docs").alias("count_sum"), F.sum(F.col("best").cast("bigint")).alias("n_best"), F.count(F.lit(1)).alias("n_links"))
    counted = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_links", "n_best", "count_sum")]
    return rows.drop("links").join(sums, ROW, "left").select("doc_id", "n_a", "n_b", "n_groups", *counted, "groups_sha256", "n_single")
