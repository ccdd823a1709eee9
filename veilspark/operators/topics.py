"""Sentences, and topic flags of sentences."""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from .rules import BLANKS, Text, places, sentence_ends
from .words import KEYWORDS

FLAG = "struct<topic:string,start:int,end:int,sentence:string,keywords:array<string>>"
# By a keyword's first word: (topic, place in its list, keyword, all its words), words as the cheap test needs them.
_BY_FIRST: dict[bytes, list[tuple[str, int, str, frozenset[bytes]]]] = {}
for _kind, _words in KEYWORDS.items():
    for _i, _w in enumerate(_words.split("|")):
        _BY_FIRST.setdefault(_w.split()[0].encode(), []).append((_kind, _i, _w, frozenset(_w.encode().split())))
_FIRST = frozenset(_BY_FIRST)


def hits(t: Text) -> dict[str, list[tuple[int, str]]]:
    """For each topic the places and keywords, whole words only, without overlaps; of keywords at one place the first listed."""
    starts: dict[str, list[tuple[int, int, str]]] = {}
    for first in _FIRST & t.words:
        for kind, i, w, parts in _BY_FIRST[first]:
            if len(parts) == 1 or parts <= t.words:
                starts.setdefault(kind, []).extend((at, i, w) for at in places(t.lowered, (w,)) if _whole(t.lowered, at, at + len(w)))
    out: dict[str, list[tuple[int, str]]] = {}
    for kind, some in starts.items():
        end = 0
        for at, _, w in sorted(some):
            if at >= end:
                out.setdefault(kind, []).append((at, w))
                end = at + len(w)
    return out


def _whole(text: str, start: int, end: int) -> bool:
    part = lambda c: c == "_" or (c.isascii() and c.isalnum())
    return not part(text[start - 1 : start]) and not part(text[end : end + 1])


def flags(t: Text) -> list[dict]:
    """A flag for each sentence and topic with a keyword: the distinct keywords in lower case, as they are met. Blanks at
    a sentence's front belong to it. Each keyword whose words the text has is looked for by itself."""
    by_kind = hits(t)
    if not by_kind:
        return []
    met: dict[tuple[int, int], dict[str, None]] = {}
    ends, kinds = sentence_ends(t.text), list(KEYWORDS)
    for kind, some in by_kind.items():
        for at, word in some:
            met.setdefault((bisect_right(ends, at), kinds.index(kind)), {})[word] = None
    out = []
    for (i, k), words in sorted(met.items()):
        low = ends[i - 1] if i else 0
        out.append({"topic": kinds[k], "start": low, "end": ends[i], "sentence": t.text[low : ends[i]], "keywords": list(words)})
    return out


def sentences(text: str) -> list[tuple[int, int, str]]:
    """start, end and sentence of each one that isn't blank."""
    ends = sentence_ends(text)
    return [(a, b, text[a:b]) for a, b in zip([0, *ends], ends) if text[a:b].strip(BLANKS)]


def flag_column(per_row: list[list[dict]]) -> pa.Array:
    kind = pa.struct([("topic", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("sentence", pa.string()), ("keywords", pa.list_(pa.string()))])
    return pa.array(per_row, pa.list_(kind))


def topics(text: Column) -> Column:
    """The flags of a column of texts; none of a null text."""

    @arrow_udf(f"array<{FLAG}>")
    def scan(column: pa.Array) -> pa.Array:
        return flag_column([flags(Text(x)) if x else [] for x in column.to_pylist()])

    return scan(text)
