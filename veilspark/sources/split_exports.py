"""Chat exports of any size: files that are one JSON array, read in parts by several tasks.

Spark cuts a file at every closing brace that it meets, whatever it closes, into records that tasks read by byte range, so
no row is larger than an innermost object. Whether a record starts inside a string, and how deep, only the bytes before it
say. So one pass sums up each range for both cases, how many quotes it has and how far it goes up or down, and running
sums over a file's few ranges settle which case holds. A second pass then knows where it stands, and puts out the
elements of the array, and the parts of those that reach over the end of a range. Only these parts are grouped."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .exports import _ROW, read_exports, rows_of

_ESCAPED = re.compile(r"\\.", re.DOTALL)
_MARKS = re.compile(r'["{}\[\],]')
_RANGE = "file string, block bigint, first string, quotes bigint, outside bigint, inside bigint"
_PART = "file string, block bigint, at bigint, part string, cut boolean, commas bigint"


def _records(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """value (text up to a closing brace), file and block (where the range starts), in order inside each task."""
    text = spark.read.option("lineSep", "}").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _levels(text: str, starts_inside: bool) -> int:
    """How many levels the text goes down, less those it goes up, outside its strings. Escaped characters are blanked."""
    outside = text.split('"')[1 if starts_inside else 0 :: 2]
    return sum(t.count("{") + t.count("[") - t.count("}") - t.count("]") for t in outside)


def _ranges(records: DataFrame) -> DataFrame:
    """A row for each range: its file's first character where it is the first, and what it adds up to if it starts
    outside a string, and inside one. A brace that ends a record counts where the record ends outside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "block", "first", "quotes", "outside", "inside"]
        place, quotes, levels, first = None, 0, [0, 0], ""

        def found() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*place, first, quotes, *levels), (pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 3), strict=True)], names=names)

        for b in batches:
            for value, *at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != place:
                    if place:
                        yield found()
                    place, quotes, levels, first = at, 0, [0, 0], value.lstrip("﻿ \t\r\n")[:1] if at[1] == 0 else ""
                text = _ESCAPED.sub("  ", value)
                n = text.count('"')
                for case in (0, 1):
                    inside = (quotes + case) % 2 == 1
                    levels[case] += _levels(text, inside) - (0 if (quotes + case + n) % 2 else 1)
                quotes += n
        if place:
            yield found()

    return records.mapInArrow(run, _RANGE)


def _starts(ranges: DataFrame) -> DataFrame:
    """file, block, inside and depth at the start of each range of files that are arrays."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2
    rows = ranges.withColumn("first", F.max("first").over(Window.partitionBy("file"))).withColumn("starts_inside", inside).where("first = '['")
    rows = rows.withColumn("down", F.when(F.col("starts_inside") == 1, F.col("inside")).otherwise(F.col("outside")))
    return rows.select("file", "block", F.col("starts_inside").alias("inside"), F.coalesce(F.sum("down").over(before), F.lit(0)).alias("depth"))


class _Elements:
    """Follows one range: texts of the array's elements, each with the number of the array's own commas before it."""

    def __init__(self, inside: int, depth: int):
        self.inside, self.depth, self.commas = bool(inside), depth, 0
        self.open: list[str] | None = [] if depth > 1 else None  # parts of an element that has begun
        self.cut = depth > 1  # it began in an earlier range

    def add(self, value: str) -> Iterator[tuple[int, str, bool]]:
        begins = 0
        for m in _MARKS.finditer(_ESCAPED.sub("  ", value)):
            mark = m[0]
            if mark == '"':
                self.inside = not self.inside
            elif self.inside:
                continue
            elif mark in "{[":
                if self.depth == 1:
                    self.open, self.cut, begins = [], False, m.start()
                self.depth += 1
            elif mark in "}]":
                self.depth -= 1
                if self.depth == 1 and self.open is not None:
                    yield self.commas, "".join([*self.open, value[begins : m.end()]]), self.cut
                    self.open = None
            elif self.depth == 1:
                self.commas += 1
        if self.open is not None:
            self.open.append(value[begins:] + "}")
        if not self.inside:  # the brace between records
            self.depth -= 1
            if self.depth == 1 and self.open is not None:
                yield self.commas, "".join(self.open), self.cut
                self.open = None


def _parts(records: DataFrame, starts: DataFrame) -> DataFrame:
    """Elements and parts of elements with their numbers inside the range, and a row with each range's number of commas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _PART.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64()]
        place, state = None, None

        def ended() -> list[tuple]:
            """What a range leaves: the part of an element that goes on in the next one, and its commas."""
            left = [(*place, state.commas, "".join(state.open), True, None)] if state.open else []
            return [*left, (*place, None, None, False, state.commas)]

        for b in batches:
            out: list[tuple] = []
            for value, file, block, inside, depth in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (file, block) != place:
                    if place:
                        out += ended()
                    place, state = (file, block), _Elements(inside, depth)
                out += [(file, block, *e, None) for e in state.add(value)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
        if place:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*ended()), kinds, strict=True)], names=names)

    known = records.join(F.broadcast(starts), ["file", "block"])  # a row for each range: keeps the records' order
    return known.select("value", "file", "block", "inside", "depth").mapInArrow(run, _PART)


def elements(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """file, row (its place in the array) and content of each object or array in the arrays that files at path are."""
    records = _records(spark, path, pattern)
    parts = _parts(records, _starts(_ranges(records)))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.where("commas is not null").select("file", "block", F.coalesce(F.sum("commas").over(before), F.lit(0)).alias("offset"))
    rows = parts.where("commas is null").join(F.broadcast(offsets), ["file", "block"]).withColumn("row", (F.col("offset") + F.col("at")).cast("int"))
    whole = rows.where("not cut").select("file", "row", "block", "part")
    pieces = rows.where("cut").select("file", "row", "block", "part")
    # an element's last part may be whole but for what came before: it is cut, and grouped with its first parts
    joined = pieces.groupBy("file", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part"))), lambda p: p["part"]), "").alias("content"))
    return whole.select("file", "row", F.col("part").alias("content")).unionByName(joined)


def read_rows(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """What exports.rows_of gives for the arrays among the files at path, however large they are."""
    shape = f"struct<{_ROW.replace(' ', ':').replace(',:', ',')}>"
    return elements(spark, path, pattern).select("file", "row", F.from_json("content", shape).alias("r")).select("file", "row", "r.*")


def read_all(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all exports at path: arrays in parts; objects and archives, which are held to 200 MB, each as a whole."""
    arrays = _ranges(_records(spark, path, "*.json")).where("first = '['").select("file").distinct()
    others = read_exports(spark, path).join(F.broadcast(arrays), "file", "left_anti")
    return read_rows(spark, path).unionByName(rows_of(others))
