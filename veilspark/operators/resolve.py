"""From candidates to findings: type filter, allowlist, and greedy resolution of overlaps, in one row each."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.dialect import bound, running, trimmed
from ..functions.scalars import digits, looked_up, normalize_key
from ..schema import FINDING, NUMERIC, PRIORITIES, RESOLVED, WEIGHTS, Options
from ..sources.files import spread
from .rules import BLANKS, Found, Text, found_column, rules_of
from .topics import FLAG, flag_column, flags

_RESOLVED = pa.struct([*((c, pa.string()) for c in ("id", "type", "value", "key")), ("start", pa.int32()), ("end", pa.int32()), ("severity", pa.string()), ("source", pa.string()), ("confidence", pa.float64()), ("allowlisted", pa.bool_())])


def enabled(found: Column, types: tuple[str, ...]) -> Column:
    """Findings of the given types. Comes before overlaps are resolved: a type that is off takes no one's place."""
    return F.filter(found, lambda f: f["type"].isin(*types))


def allowed(allowlist: tuple[str, ...]) -> tuple[frozenset[str], frozenset[str]]:
    """The entries of an allowlist as keys, and those that are numbers as digits."""
    plain = frozenset(a.lower().strip() for a in allowlist)
    numbers = frozenset("".join(c for c in a if c.isdigit()) for a in allowlist if a and all(c.isdigit() or c.isspace() or c in "+().-" for c in a))
    return plain, numbers


def with_keys(found: Column, allowlist: tuple[str, ...] = ()) -> Column:
    """Findings with id, key and whether the user always allows them; numbers are compared by their digits."""
    plain, numbers = allowed(allowlist)
    among = lambda values, c: F.array_contains(F.array(*map(F.lit, sorted(values))), c) if values else F.lit(False)

    def one(f: Column) -> Column:
        key = normalize_key(f["type"], f["value"])
        allowed = among(plain, key) | (f["type"].isin(*NUMERIC) & among(numbers, digits(f["value"])))
        return F.struct(F.concat_ws(":", f["type"], f["start"].cast("string"), f["end"].cast("string")).alias("id"), f["type"], f["value"], key.alias("key"), f["start"], f["end"], f["severity"], f["source"], f["confidence"], allowed.alias("allowlisted"))

    return F.transform(found, one)


def resolve(found: Column, stopwords: frozenset[str] = frozenset()) -> Column:
    """Findings that don't overlap, by start. Taken greedily: by source, severity, length (all falling), start, type.

    Model findings of one character, or of a stop word, are dropped first. Findings are cut into runs that touch no
    other run, and only those of one run are compared: a text of many findings costs little more than their sorting."""
    stop = F.array(*map(F.lit, sorted(stopwords))).cast("array<string>")
    real = F.filter(found, lambda f: (f["end"] > f["start"]) & ((f["source"] != "ner") | ((F.char_length(trimmed(f["value"])) >= 2) & ~F.array_contains(stop, f["key"]))))
    empty = F.array().cast(f"array<{RESOLVED}>")

    def greedy(some: Column) -> Column:
        ranked = F.array_sort(F.transform(some, lambda f: F.struct((-looked_up(f["source"], PRIORITIES)).alias("p"), (-looked_up(f["severity"], WEIGHTS)).alias("s"), (f["start"] - f["end"]).alias("l"), f["start"].alias("at"), f["type"].alias("t"), f.alias("f"))))

        def take(kept: Column, r: Column) -> Column:
            f = r["f"]
            clash = F.exists(kept, lambda k: (k["start"] < f["end"]) & (f["start"] < k["end"]))
            return F.when(clash, kept).otherwise(F.concat(kept, F.array(f)))

        return F.array_sort(F.aggregate(ranked, empty, take), lambda a, b: a["start"] - b["start"])

    def in_runs(xs: Column) -> Column:
        def cut(tops: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(xs) - 1), lambda i: (i == 0) | (F.get(xs, i)["start"] >= F.get(tops, i - 1)))
            return bound(starts, lambda s: F.zip_with(s, F.concat(F.slice(s, 2, F.size(s)), F.array(F.size(xs))), lambda a, b: F.slice(xs, a + 1, b - a)))

        runs = bound(running(F.transform(xs, lambda f: f["end"]), 0, F.greatest), cut)
        return F.flatten(F.transform(runs, lambda run: F.when(F.size(run) == 1, run).otherwise(greedy(run))))

    by_start = lambda xs: F.array_sort(xs, lambda a, b: a["start"] - b["start"])
    return F.when(F.size(found) == 0, empty).otherwise(bound(real, lambda xs: F.when(F.size(xs) < 2, xs).when(F.size(xs) <= 16, greedy(xs)).otherwise(bound(by_start(xs), in_runs))))


def settler(options: Options) -> Callable[[list[Found], str], list[tuple]]:
    """What enabled, with_keys and resolve do, for the candidates of one text: tuples in the order of RESOLVED.

    The fast path uses it inside its Arrow pass; resolve does the same in the plan, where model findings take part."""
    plain, numbers = allowed(options.allowlist)
    types, numeric = frozenset(options.types), frozenset(NUMERIC)

    def settle(found: list[Found], text: str) -> list[tuple]:
        ranked = sorted((f for f in found if f[0] in types and f[2] > f[1]), key=lambda f: (-PRIORITIES[f[4]], -WEIGHTS[f[3]], f[1] - f[2], f[1], f[0]))
        starts: list[int] = []
        kept: list[tuple] = []
        for type_, start, end, severity, source, confidence in ranked:
            at = bisect_left(starts, start)
            if (at and kept[at - 1][5] > start) or (at < len(starts) and starts[at] < end):
                continue
            value = text[start:end]
            digits = "".join(c for c in value if "0" <= c <= "9") if type_ in numeric else ""
            key = digits if type_ in numeric else value.lower().strip(BLANKS)
            starts.insert(at, start)
            kept.insert(at, (f"{type_}:{start}:{end}", type_, value, key, start, end, severity, source, confidence, key in plain or (type_ in numeric and digits in numbers)))
        return kept

    return settle


def _resolved_column(per_row: list[list[tuple]]) -> pa.Array:
    rows = [f for found in per_row for f in found]
    parts = [pa.array([f[i] for f in rows], field.type) for i, field in enumerate(_RESOLVED)]
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, per_row))], pa.int32()), pa.StructArray.from_arrays(parts, fields=list(_RESOLVED)))


def scanned(text: Column, options: Options, settled: bool = True) -> Column:
    """A struct of found and topics for each text of a column: findings without overlaps, or else all candidates."""
    rules, settle = rules_of(options), settler(options)

    @arrow_udf(f"struct<found:array<{RESOLVED if settled else FINDING}>,topics:array<{FLAG}>>")
    def scan(column: pa.Array) -> pa.Array:
        texts = [x or "" for x in column.to_pylist()]
        met: dict[str, tuple[list, list]] = {"": ([], [])}  # equal texts of a batch, as short messages often are, are scanned once
        for x in texts:
            if x not in met:
                t = Text(x)
                some = [f for rule in rules for f in rule(t)]
                met[x] = settle(some, x) if settled and some else some, flags(t)
        per_row, per_flag = [met[x][0] for x in texts], [met[x][1] for x in texts]
        return pa.StructArray.from_arrays([_resolved_column(per_row) if settled else found_column(per_row, texts), flag_column(per_flag)], names=["found", "topics"])

    # An explode of the findings has Spark infer a filter of non-empty ones and push it down to the texts, where the pass
    # would run once more for it. It isn't pushed past what may differ from one evaluation to the next.
    return scan.asNondeterministic()(text)


def detect(messages: DataFrame, text: str = "text", options: Options = Options(), entities: str | None = None) -> DataFrame:
    """messages with findings and topics: one Arrow pass over the texts, inside the scan's stage.

    entities: a column of model findings (array of type, start, end, score) to take part as well."""
    c = F.coalesce(F.col(text), F.lit(""))
    rows = spread(messages).withColumn("_scan", scanned(c, options, settled=not entities))
    found = F.col("_scan.found")
    if entities:
        from .ner import model_findings

        both = F.when(c == "", found).otherwise(F.concat(found, model_findings(c, F.col(entities), options)))
        # evaluated once: overlap resolution names its input several times
        rows = rows.withColumn("_found", with_keys(enabled(both, options.types), options.allowlist))
        found = resolve(F.col("_found"), options.stopwords)
    return rows.withColumn("findings", found).withColumn("topics", F.col("_scan.topics")).drop("_found", "_scan")


def exploded(detected: DataFrame, *keep: str) -> DataFrame:
    """A row for each finding, with the columns `keep`."""
    return detected.select(*keep, F.posexplode("findings").alias("ord", "f")).select(*keep, "ord", "f.*")


def cached_union(fresh: Column, cached: Column) -> Column:
    """Fresh findings and those cached ones that overlap none of them, by start."""
    old = F.filter(cached, lambda c: ~F.exists(fresh, lambda f: (f["start"] < c["end"]) & (c["start"] < f["end"])))
    return F.array_sort(F.concat(fresh, old), lambda a, b: a["start"] - b["start"])


def full_over_fast(fast: DataFrame, full: DataFrame, keys: list[str], within: int | None = None) -> DataFrame:
    """Results of the slower detector replace those of the fast one where it ran; within: only those that took (a column
    of full, in milliseconds) no longer than that."""
    full = full if within is None else full.where(F.col("took") <= within)
    other = full.select(*keys, F.col("findings").alias("_full"), F.col("topics").alias("_topics"))
    joined = fast.join(other, keys, "left")
    return joined.withColumn("findings", F.coalesce("_full", "findings")).withColumn("topics", F.coalesce("_topics", "topics")).drop("_full", "_topics")


def model_budget(messages: DataFrame, budget: int = 400, longest: int = 3000) -> DataFrame:
    """The newest messages that are worth the model: short, with a word before a capitalised one."""
    worth = (F.char_length("text") < longest) & F.col("text").rlike(r"[A-Za-z]+\s+[A-Z][a-z]+")
    return messages.where(worth).orderBy(F.desc_nulls_last("created_at"), "seq").limit(budget)
