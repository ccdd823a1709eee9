"""Line dedup (operator 11): lines that many documents share, found by sorted hashes, returned as bitmaps of what stays.

A line's key is the line with blanks stripped at both ends and A-Z lowered. A document sends one row for each of its
distinct keys: a 128-bit hash, its own number, and the places where the key stands. Rows are range-partitioned and sorted
by hash, document and place, so a key's documents lie side by side in order, and one that a third of all documents have
is cut over many tasks. Each task streams its range with the first occurrence of a key held back until the key's
documents are counted. What only a neighbouring range can settle, fewer than min_docs rows for each end of a range, is
settled afterwards by a grouped count of those rows alone.

No text moves with the keys. A document that loses lines gets a compressed bitmap; one without a bitmap keeps all.

Null and empty texts are one empty line. Lines whose key has fewer than min_chars code points (empty ones at least) stay.
Equal rows are different documents. Columns other than key and text are ignored, whatever their names are."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import SLICE, per_text
from .common import dropped, stored
from .simhash import _LOWERED

MIN_DOCS, MIN_CHARS = 10, 1
ROW = "_line_row"
_BLANKS = b" \t\n\x0b\x0c\r"
_KEYS = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), (ROW, pa.int64()), ("at", pa.binary())])
_FOUND = pa.schema([*_KEYS, ("docs", pa.int64())])


def line_keys(text: str | None, min_chars: int = MIN_CHARS) -> dict[bytes, list[int]]:
    """The 128-bit hash of each distinct key of enough code points, with the places of its lines."""
    places: dict[bytes, list[int]] = {}
    for i, line in enumerate((text or "").encode().split(b"\n")):
        key = line.strip(_BLANKS).translate(_LOWERED)
        if key and (min_chars <= 1 or len(key.decode()) >= min_chars):
            places.setdefault(xxhash.xxh3_128_digest(key), []).append(i)
    return places


def _keys(rows: DataFrame, min_chars: int) -> DataFrame:
    """hi, lo, ROW and at (the places, 4 bytes each) of each key of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                b = whole.slice(start, SLICE)
                hashes, own, at = [], [], []
                for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    places = line_keys(text, min_chars)
                    hashes += places
                    own += [row] * len(places)
                    at += [np.array(p, "<i4").tobytes() for p in places.values()]
                both = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(own, pa.int64()), pa.array(at, pa.binary())], schema=_KEYS)

    return rows.select(ROW, "text").mapInArrow(run, f"hi bigint, lo bigint, {ROW} bigint, at binary")


class _Runs:
    """Streams sorted rows of one range, a run of equal hashes after another.

    A run's first row is `head`; its next rows wait until min_docs are there, and pass from then on. At the run's end the
    head passes too, unless first occurrences stay. Runs at an end of the range may go on in the neighbouring one: their
    waiting rows come out with the hash and a count of 1, and the head of one with enough rows with a count of min_docs."""

    def __init__(self, min_docs: int, keep_first: bool):
        self.min_docs, self.keep_first = min_docs, keep_first
        self.key, self.rows, self.n, self.opening = None, [], 0, True
        self.out: list[tuple] = []

    def settled(self, row: int, at: bytes) -> None:
        if at:
            self.out.append((None, None, row, at, None))

    def close(self, closing: bool) -> None:
        if self.key is None:
            return
        many = self.n >= self.min_docs
        if self.opening or closing:
            self.out += [(*self.key, *r, self.min_docs if many else 1) for r in self.rows]
        elif many:
            row, at = self.rows[0]
            self.settled(row, at[4:] if self.keep_first else at)
        self.opening = False

    def add(self, key: tuple[int, int], rows: list[tuple[int, bytes]]) -> None:
        if key != self.key:
            self.close(False)
            self.key, self.rows, self.n = key, [], 0
        self.n += len(rows)
        self.rows += rows
        if self.n >= self.min_docs:
            for row, at in self.rows[1:]:
                self.settled(row, at)
            del self.rows[1:]


def _streamed(keys: DataFrame, min_docs: int, keep_first: bool) -> DataFrame:
    """ROW and at of what goes, and with hi, lo and docs what its range alone can't settle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(min_docs, keep_first)

        def found() -> pa.RecordBatch:
            out, runs.out = runs.out, []
            return pa.RecordBatch.from_pylist([dict(zip(_FOUND.names, r, strict=True)) for r in out], schema=_FOUND)

        for b in batches:
            if not b.num_rows:
                continue
            hi, lo = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            starts = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
            ends = np.append(starts[1:], b.num_rows)
            # runs of too few rows that lie inside the batch settle nothing: they are passed over at once
            looked_at = (ends - starts >= min_docs) | (starts == 0) | (ends == b.num_rows)
            for s, e in zip(starts[looked_at].tolist(), ends[looked_at].tolist(), strict=True):
                part = b.slice(s, e - s)
                runs.add((int(hi[s]), int(lo[s])), list(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)))
            yield found()
        runs.close(True)
        yield found()

    spread = keys.repartitionByRange("hi", "lo", ROW).sortWithinPartitions("hi", "lo", ROW)
    return spread.mapInArrow(run, f"hi bigint, lo bigint, {ROW} bigint, at binary, docs bigint")


def _lost(found: DataFrame, min_docs: int, keep_first: bool) -> DataFrame:
    """ROW and at of all lines that go. Ranges end in two keys each, so the keys looked up are few."""
    open_ = found.where("docs is not null")
    counted = open_.groupBy("hi", "lo").agg(F.sum("docs").alias("n"), F.min(ROW).alias("lead")).where(F.col("n") >= min_docs).drop("n")
    rest = open_.drop("docs").join(F.broadcast(counted), ["hi", "lo"])
    if keep_first:
        rest = rest.withColumn("at", F.when(F.col(ROW) == F.col("lead"), F.expr("substring(at, 5)")).otherwise(F.col("at")))
    return found.where("docs is null").select(ROW, "at").union(rest.select(ROW, "at").where(F.length("at") > 0))


def _bitmaps(lost: DataFrame) -> DataFrame:
    """ROW, n_dropped and keep of each document that loses lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, keep = [], []
            for parts in b.column(1).to_pylist():
                at = np.frombuffer(b"".join(parts), "<i4")
                bits = np.ones((int(at.max()) // 8 + 1) * 8, np.uint8)
                bits[at] = 0
                n.append(len(at))
                keep.append(zlib.compress(np.packbits(bits).tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(keep, pa.binary())], names=[ROW, "n_dropped", "keep"])

    return lost.groupBy(ROW).agg(F.collect_list("at").alias("parts")).mapInArrow(run, f"{ROW} bigint, n_dropped bigint, keep binary")


def keep_bitmaps(rows: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """ROW, n_dropped and keep of each row of `rows` (ROW, text) that loses lines.

    keep: a zlib-compressed bitmap, first line in the highest bit, 1 if the line stays; lines past its end stay.
    Keys of at least min_docs documents lose all their lines, or all but the first one in order of ROW with keep_first."""
    keys = stored(_keys(rows, min_chars), "line-keys")
    found = stored(_streamed(keys, min_docs, keep_first), "line-found")
    dropped(keys)
    bitmaps = stored(_bitmaps(_lost(found, min_docs, keep_first)), "line-bitmaps")
    dropped(found)
    return bitmaps


def kept_lines(text: str | None, keep: bytes | None) -> list[str]:
    lines = (text or "").split("\n")
    if keep is None:
        return lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
    return [x for i, x in enumerate(lines) if i >= len(bits) or bits[i]]


def with_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text and keep (null: all lines stay) of each row of docs."""
    rows = stored(docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.monotonically_increasing_id().alias(ROW)), "line-rows")
    # bitmaps grow with the documents: the join is the same at every size, also where few would fit a broadcast
    found = rows.join(keep_bitmaps(rows, min_docs, min_chars, keep_first).hint("merge"), ROW, "left")
    return found.select(F.col("key").alias(key), F.col("text").alias("text"), "keep")


def _packed(found: DataFrame, key: str) -> DataFrame:
    """One binary column of text and bitmap can't be null: so texts and bitmaps go side by side."""
    return found.select(key, F.struct("text", "keep").alias("both"))


def deduplicated(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the text that stays, of each row of docs (null texts: empty)."""
    found = with_bitmaps(docs, min_docs, min_chars, keep_first, key, text)

    def make():
        return lambda rows: (["\n".join(kept_lines(r["text"], r["keep"])) for r in rows],)

    return per_text(_packed(found, key), make, "text string", key, "both")


def digest(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of each row of docs."""
    found = with_bitmaps(docs, min_docs, min_chars, keep_first)

    def one(text: str | None, keep: bytes | None) -> tuple[int, int, str]:
        kept = kept_lines(text, keep)
        n = (text or "").count("\n") + 1
        return n, n - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()

    def make():
        return lambda rows: zip(*(one(r["text"], r["keep"]) for r in rows)) if rows else ([], [], [])

    return per_text(_packed(found, "doc_id"), make, "n_lines bigint, n_dropped bigint, kept_sha256 string", "doc_id", "both")


#: DuckDB SQL for digest.
ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM each),
gone AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(gone.k) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE gone.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN gone ON keyed.k = gone.k GROUP BY r, doc_id
"""
