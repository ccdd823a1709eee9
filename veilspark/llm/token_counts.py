"""Token counts (operator 7): how many tokens the word vocabulary makes of a text, without making ids.

Each piece that the vocabulary merges inside starts as one symbol a byte, the last one marked as a word's end. A heap
holds the adjacent pairs that the vocabulary merges, by rank and then place; symbols are a linked list. The lowest pair
is merged again and again, and the count is the number of symbols at first less the merges.

Special strings in a text count as one token each, as the library does by default. Null text: no tokens. Whole texts
are counted, of any length; equal rows give equal counts."""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache
from os.path import commonprefix

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import per_text
from .pretokens import WordMemory


def _byte_letters() -> list[str]:
    """The letter of each byte in byte-level vocabularies: itself where it can be seen, else the next free one from 256."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in seen]
    return [chr(b) if b in seen else chr(256 + hidden.index(b)) for b in range(256)]


class Counter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(held["model"]["merges"])}
        self.end = held["model"]["end_of_word_suffix"]
        self.letters = _byte_letters()
        special = [t["content"] for t in held["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.mark = commonprefix(special)  # asked for first, as it is cheap
        self.known = WordMemory(lambda pieces: map(self.piece, pieces), sum)

    def piece(self, piece: str) -> int:
        """Tokens of one piece."""
        symbols: list[str | None] = [self.letters[b] for b in piece.encode()]
        symbols[-1] += self.end
        n = count = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        ranks = self.ranks
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = a + b, None
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((a + b, symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, a + b, symbols[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get((symbols[h], a + b))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], a + b))
        return count

    def text(self, text: str) -> int:
        if self.special and self.mark in text:
            parts = self.special.split(text)
            return len(parts) - 1 + sum(sum(self.known.of(p)) for p in parts)
        return sum(self.known.of(text))


@lru_cache(2)
def counter(path: str) -> Counter:
    """One counter for all tasks of a worker."""
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes long (UTF-8), n_tokens long and over_limit boolean (more than limit tokens) of each row."""

    def make():
        c = counter(path)
        return lambda texts: ([len((t or "").encode()) for t in texts], [c.text(t or "") for t in texts])

    return per_text(docs, make, "n_bytes bigint, n_tokens bigint", key, text).withColumn("over_limit", F.col("n_tokens") > limit)
