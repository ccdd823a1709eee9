"""Operator 8's search with errors against a table of edit distances, and versions that it must not mix up."""

import random
import time

import pytest

from veilspark.llm import license_scan
from veilspark.llm.license_scan import LETTERS_PER_ERROR, NOTICES, PHRASES, Scanner, telling, words_of


@pytest.fixture(scope="module")
def scanner():
    return Scanner(PHRASES, NOTICES)


def labels(scanner, text):
    return {m[0] for m in scanner.fuzzy(b" ".join(words_of(text)).decode())}


def least_errors(notice, text):
    """The fewest insertions, deletions and substitutions that make the notice of some part of the text."""
    row = list(range(len(notice) + 1))
    best = row[-1]
    for c in text:
        before, row = row, [0]
        for j, x in enumerate(notice):
            row.append(min(before[j] + (x != c), before[j + 1] + 1, row[j] + 1))
        best = min(best, row[-1])
    return best


def test_matches_are_those_within_the_bound(scanner):
    rng, tell = random.Random(12), telling(NOTICES)
    for _ in range(400):
        notice = rng.choice(list(NOTICES))
        chars = list(notice)
        for _ in range(rng.randint(0, len(notice) // LETTERS_PER_ERROR + 2)):
            at = rng.randrange(len(chars))
            chars[at : at + 1] = rng.choice([[], [rng.choice("xyz")], [chars[at], rng.choice("xyz")]])
        text = " ".join(("before zzz " + "".join(chars) + " zzz after").split())
        bound = len(notice) // LETTERS_PER_ERROR
        within = least_errors(notice, text) <= bound and tell[notice] <= set(text.split())
        possible = {NOTICES[n] for n in NOTICES if least_errors(n, text) <= len(n) // LETTERS_PER_ERROR and tell[n] <= set(text.split())}
        assert labels(scanner, text) <= possible
        if within and len(possible) == 1:
            assert labels(scanner, text) == possible


@pytest.mark.parametrize(
    "text,want",
    [
        ("Licensed under the GNU General Public License version 1.", set()),
        ("licensed under the GNU Lesser General Public License version 2.1", set()),
        ("licensed under cc by nd 4", set()),
        ("Licensed under the Apache License version 1.1", set()),
        ("Licensed under the Apache License, Version 2.0", {"apache-2"}),
        ("Licenced under the GNU Genral Public License, version 3", {"gpl-3"}),
        ("licensed under the gnu affero general public license version 3", {"agpl-3"}),
        ("relased under the MIT licence", {"mit"}),
        ("released under the mat license", set()),
        ("licensed under CC-BY-SA 4.0", {"cc-by-sa"}),
        ("", set()),
    ],
)
def test_versions_are_told_apart(scanner, text, want):
    assert labels(scanner, text) == want


def test_many_notices_in_one_text(scanner):
    text = ". ".join(["Released under the MIT license", "Licensed under the Apache License version 2", "nothing at all here"] * 4000)
    start = time.perf_counter()
    found = scanner.fuzzy(b" ".join(words_of(text)).decode())
    assert len(found) == 8000 and time.perf_counter() - start < 8


def test_telling_words():
    tell = telling(NOTICES)
    assert tell["licensed under cc by nc 4"] == {"nc", "4"} and "mit" in tell["released under the mit license"]
    assert "released" not in tell["released under the mit license"]


def test_base_phrases_are_unchanged(rows_of):
    got = license_scan.digest(license_scan.scan(rows_of(["under the mit license, cc by nc"]))).first()
    assert got["n_base"] == 2 and got["base_labels"] == "cc-by-nc,mit"
