"""Splitting texts into pre-tokens as the public tokenizers do, and ids per pre-token.

Both vocabularies merge inside one pre-token only, so a text's ids are those of its pre-tokens in a row.
A worker keeps what it has found for a pre-token; the memory has a bound and starts anew beyond it, so it
costs time and never changes a result."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable

import regex

#: Characters below this are unchanged by NFC, and lower-case one by one.
_PLAIN_END = 0x300
_NOT_PLAIN = re.compile(f"[{chr(_PLAIN_END)}-\U0010ffff]")
#: Where str.split() would part words otherwise than white space does, besides.
_NOT_SPLIT = re.compile(f"[\x1c-\x1f{chr(_PLAIN_END)}-\U0010ffff]")
#: White space of Unicode, without the four separators 1C-1F that Python's own classes add.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _class(kind: str) -> str:
    """The characters below _PLAIN_END whose general category starts with kind, as the inside of a class."""
    runs: list[list[int]] = []
    for c in range(_PLAIN_END):
        if unicodedata.category(chr(c)).startswith(kind):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)


_L, _N, _S = _class("L"), _class("N"), r"\t-\r \x85\xa0"

# Patterns that public vocabularies fix.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _both(pattern: str) -> tuple[Callable[[str], list[str]], Callable[[str], list[str]]]:
    """The pattern's findall for texts below _PLAIN_END, by re, and for any text, by regex."""

    def filled(space: str, letters: str, numbers: str) -> str:
        p = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]")
        p = p.replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}").replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]")
        return p if letters == r"\p{L}" else p.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")

    return re.compile(filled(_S, _L, _N)).findall, regex.compile(filled(SPACE, r"\p{L}", r"\p{N}")).findall


_WORD_PLAIN, _WORD_ANY = _both(WORD_PATTERN)
_BYTE_PLAIN, _BYTE_ANY = _both(BYTE_PATTERN)


def byte_level(text: str) -> list[str]:
    """The matches of BYTE_PATTERN."""
    return (_BYTE_ANY if _NOT_PLAIN.search(text) else _BYTE_PLAIN)(text)


def word_level(text: str) -> list[str]:
    """The pieces that the word vocabulary merges inside: NFC, lower case, then the matches of WORD_PATTERN."""
    if _NOT_PLAIN.search(text):
        return _WORD_ANY("".join(map(str.lower, unicodedata.normalize("NFC", text))))
    return _WORD_PLAIN(text.lower())


class Memory:
    """find(keys) for keys not met before, then remembered; emptied when it holds `most` entries."""

    def __init__(self, find: Callable[[list[str]], Iterable], most: int = 600_000):
        self.find, self.most, self.found = find, most, {}

    def __len__(self) -> int:
        return len(self.found)

    def of(self, keys: list[str]) -> map:
        new = list(set(keys).difference(self.found))
        if new:
            if len(self.found) + len(new) > self.most:
                self.found.clear()
                new = list(set(keys))
            self.found.update(zip(new, self.find(new), strict=True))
        return map(self.found.__getitem__, keys)


class WordMemory:
    """What find() gives for the pieces of word_level(text), one after another.

    A piece never spans white space, so whole blank-separated words are remembered too, joined by `join`. Either memory
    holds `most` entries at most, or those of one text."""

    def __init__(self, find: Callable[[list[str]], Iterable], join: Callable[[Iterable], object], most: tuple[int, int] = (600_000, 800_000)):
        self.join, self.pieces = join, Memory(find, most[0])
        self.words = Memory(self._whole, most[1])

    def _whole(self, words: list[str]) -> list:
        split = list(map(_WORD_PLAIN, words))
        found = self.pieces.of([p for pieces in split for p in pieces])
        return [self.join([next(found) for _ in pieces]) for pieces in split]

    def of(self, text: str) -> Iterable:
        return self.pieces.of(word_level(text)) if _NOT_SPLIT.search(text) else self.words.of(text.lower().split())
