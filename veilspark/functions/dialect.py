"""ECMAScript's patterns for other engines, and spans from matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ECMAScript's white space, as the inside of a class.
WS = r"\t-\r    -     　﻿"
SPAN = "struct<start:int,end:int,value:string,part:string>"
#: Running sums are taken in blocks, so that arrays of any length cost little more than their length.
BLOCK = 256


def python(pattern: str) -> str:
    r"""An ECMAScript pattern for Python's ASCII mode: \s in and outside classes, and $ for the end only."""
    out, inside, i = "", False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two[0] == "\\":
            out += (WS if inside else f"[{WS}]") if two == r"\s" else two
            i += 2
            continue
        inside = two[0] == "[" or (inside and two[0] != "]")
        out += r"\Z" if two[0] == "$" and not inside else two[0]
        i += 1
    return out


def trimmed(c: Column) -> Column:
    """Without ECMAScript white space at both ends."""
    return F.regexp_replace(c, rf"\A[{WS}]+|[{WS}]+\z", "")


#: Python's white space, as the inside of a class.
PYTHON_WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(c: Column) -> Column:
    """Without Python's white space at both ends."""
    return F.regexp_replace(c, rf"\A[{PYTHON_WS}]+|[{PYTHON_WS}]+\z", "")


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value evaluated once however often f names it: expressions in lambdas are not shared otherwise."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running(values: Column, least: int, op: Callable[[Column, Column], Column]) -> Column:
    """op over all values up to each one (an associative op; least is neutral). values: array of int.

    Blocks are folded on their own, then the last values of blocks before them are added."""
    typed = "array<int>"

    def fold(xs: Column) -> Column:
        zero = F.struct(F.lit(least).alias("at"), F.array().cast(typed).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            now = op(acc["at"], x)
            return F.struct(now.alias("at"), F.concat(acc["out"], F.array(now)).alias("out"))

        return F.aggregate(xs, zero, step, lambda acc: acc["out"])

    def based(blocks: Column) -> Column:
        tops = fold(F.transform(blocks, lambda b: F.element_at(b, -1)))
        bases = F.concat(F.array(F.lit(least)), tops)
        return F.flatten(F.zip_with(blocks, F.slice(bases, 1, F.size(blocks)), lambda b, base: F.transform(b, lambda x: op(base, x))))

    def long(xs: Column) -> Column:
        each = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int"))
        return bound(F.transform(each, lambda b: fold(F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)))), based)

    return bound(values, lambda xs: F.when(F.size(xs) == 0, F.array().cast(typed)).when(F.size(xs) <= BLOCK, fold(xs)).otherwise(long(xs)))


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches in order: start and end (code points, from 0), value, and the part that `group` matched.

    Offsets are running sums of the lengths of gaps and matches, so each pattern is evaluated in the JVM only."""
    def placed(found: Column) -> Column:
        parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        lengths = F.zip_with(found, F.slice(F.split(text, pattern, -1), 1, F.size(found)), lambda m, g: F.char_length(m) + F.char_length(g))
        steps = F.arrays_zip(found.alias("m"), running(lengths, 0, lambda a, x: a + x).alias("e"), parts.alias("p"))
        return F.transform(steps, lambda x: F.struct((x["e"] - F.char_length(x["m"])).alias("start"), x["e"].alias("end"), x["m"].alias("value"), x["p"].alias("part")))

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
