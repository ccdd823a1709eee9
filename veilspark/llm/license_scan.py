"""License scans (operator 8): short notices found exactly, and with a bounded number of errors.

Texts become words, joined by one space. A notice of n letters may hold n // 14 errors k, so of k + 1 pieces of it one
stands unharmed in any match (pigeonhole): pieces are searched for all at once, each hit gives a window, and the regex
library's bounded-error matching verifies the notice there. Numbers, and the words that only a notice's own label has
beside notices much like it, must stand in a match as they are: errors are for the rest. Of matches that overlap the one
with the fewest errors stays; where one of another label has as few over the same words, none does. Base phrases are searched for word by word, without errors.

Null text: no words, no places. Whole texts are searched, of any length; equal rows give equal results."""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import per_text

#: Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Short notices, as words, and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2": "apache-2",
    "licensed under cc by nc 4": "cc-by-nc",
    "licensed under cc by sa 4": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "licensed under the gnu general public license version 2": "gpl-2",
    "licensed under the gnu general public license version 3": "gpl-3",
    "licensed under the gnu lesser general public license version 3": "lgpl-3",
    "licensed under the gnu affero general public license version 3": "agpl-3",
    "subject to the terms of the mozilla public license": "mpl-2",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
LETTERS_PER_ERROR = 14
_WORDS = bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 128 else b if b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of ASCII letters and digits and of any other characters beyond ASCII, with A-Z lowered."""
    return (text or "").encode().translate(_WORDS).split()


def telling(notices: dict[str, str]) -> dict[str, frozenset[str]]:
    """For each notice the words that tell its label from others: its numbers, and of its words that a notice of another
    label with half of its words or more lacks, those that no other label has."""
    split = {n: frozenset(n.split()) for n in notices}
    out = {}
    for n, words in split.items():
        others = [w for m, w in split.items() if notices[m] != notices[n]]
        like = [w for w in others if 2 * len(w & words) >= min(len(w), len(words))]
        own = words - frozenset().union(*others)
        out[n] = frozenset(w for w in words if w.isdigit() or (w in own and any(w not in o for o in like)))
    return out


class Scanner:
    def __init__(self, phrases: dict[str, str], notices: dict[str, str]):
        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases.items()]
        self.notices = []
        self.seeds = ahocorasick.Automaton()
        seeds: dict[str, list[tuple[int, int]]] = {}
        self.telling = list(telling(notices).values())
        self.whole = list(notices)
        for i, (notice, label) in enumerate(notices.items()):
            k = len(notice) // LETTERS_PER_ERROR
            self.notices.append((len(notice), k, label, regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={k}}}")))
            cuts = [len(notice) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(notice[a:b], []).append((i, a))
        for seed, places in seeds.items():
            self.seeds.add_word(seed, (len(seed), places))
        self.seeds.make_automaton()

    @staticmethod
    def _end(joined: str, at: int) -> int:
        """Where the word ends that at is in or behind."""
        blank = joined.find(" ", max(0, at - 1))
        return len(joined) if blank < 0 else blank

    def base(self, joined: bytes) -> list[tuple[str, int]]:
        """(label, number of its first word) of each place of each phrase."""
        padded, found = b" " + joined + b" ", []
        for phrase, label in self.phrases:
            at, seen, words = padded.find(phrase), 0, -1
            while at >= 0:
                words += padded.count(b" ", seen, at + 1)  # of the part since the last place only
                seen = at + 1
                found.append((label, words))
                at = padded.find(phrase, at + 1)
        return found

    def fuzzy(self, joined: str) -> list[tuple[str, int, int, int, int]]:
        """(label, first word, last word, errors, letters of the notice) of each match."""
        tried, found = set(), []
        for end, (n, places) in self.seeds.iter(joined):
            for i, a in places:
                start = end + 1 - n - a
                if (i, start) in tried:
                    continue
                tried.add((i, start))
                size, k, _, pattern = self.notices[i]
                low, high = max(0, start - k), min(len(joined), start + size + k)
                if start >= 0 and joined.startswith(self.whole[i], start):
                    a, b, errors = start, start + size, 0
                elif all(joined.find(w, low, high + 1) >= 0 for w in self.telling[i]) and (m := pattern.search(joined, low, high)):
                    a, b, errors = m.start(), m.end(), sum(m.fuzzy_counts)
                else:
                    continue
                if self.telling[i] <= set(joined[joined.rfind(" ", 0, a + 1) + 1 : self._end(joined, b)].split()):
                    found.append((errors, -size, a, b, i))
        starts: list[int] = []
        kept: list[tuple[int, int, int, int, int]] = []  # by start, without overlaps
        tied: set[int] = set()  # starts of what another label matches as well
        for x in sorted(set(found)):
            at = bisect_left(starts, x[2])
            clash = [k for k in kept[max(0, at - 1) : at + 1] if k[2] < x[3] and x[2] < k[3]]
            if not clash:
                starts.insert(at, x[2])
                kept.insert(at, x)
            tied |= {k[2] for k in clash if k[0] == x[0] > 0 and self.notices[k[4]][2] != self.notices[x[4]][2]}
        out, seen, first = [], 0, 0
        for errors, size, start, end, i in kept:
            if start in tied:
                continue
            to = start + (joined[start] == " ")
            first += joined.count(" ", seen, to)
            seen = to
            out.append((self.notices[i][2], first, first + joined[start:end].strip().count(" "), errors, -size))
        return out


@lru_cache(4)
def scanner(phrases: tuple, notices: tuple) -> Scanner:
    return Scanner(dict(phrases), dict(notices))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, base (label and first word of each place of a phrase) and found (label, first and last word,
    errors and score of each match of a notice)."""
    held = (tuple(phrases.items()), tuple(notices.items()))

    def make():
        s = scanner(*held)

        def work(texts):
            n, base, found = [], [], []
            for t in texts:
                w = words_of(t)
                joined = b" ".join(w)
                n.append(len(w))
                base.append([{"label": a, "word": b} for a, b in s.base(joined)])
                found.append([{"label": a, "first": b, "last": c, "errors": e, "score": 1 - e / size} for a, b, c, e, size in s.fuzzy(joined.decode())])
            return n, base, found

        return work

    schema = "n_words bigint, base array<struct<label:string,word:bigint>>, found array<struct<label:string,first:bigint,last:bigint,errors:int,score:double>>"
    return per_text(docs, make, schema, key, text)


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """One flat row for each scanned text: labels are distinct, sorted and comma-joined."""
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    words, base = F.transform("base", lambda x: x["word"]), F.transform("base", lambda x: x["label"])
    return scanned.select(
        key,
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.concat(base, F.transform("found", lambda x: x["label"]))).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0))).alias("score"),
        F.transform("found", lambda x: F.concat_ws(":", x["label"], x["first"].cast("string"), x["last"].cast("string"), x["errors"].cast("string"))).alias("spans"),
    )
