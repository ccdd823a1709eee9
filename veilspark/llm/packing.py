"""Mixture-controlled packing (operator 2).

Every source is a queue of tokens. Windows (sequences) of `size` tokens are filled by deficit round robin: in each
window a queue is owed its quantum (its target share of the window); what it is owed but, being a fraction of a token,
does not get is carried to the next window, and what one queue leaves in a window is carried to the next queue. With
the queues in a fixed order, and owed(j, w) what queues 0..j together are owed after w windows, queue j has given
floor(owed(j, w)) - floor(owed(j - 1, w)) tokens. So the carried state at any window is known without the windows
before it, and each task fills its own part of the sequences: no task and no driver sees all windows.

Shares change where a queue runs dry: a phase is a run of windows with the same queues; the last window of a queue is
a phase of its own. A phase has whole totals for its queues, so every window but the last is full.

Shares default to what the sources hold, so all queues run dry together. Sources owed less than one token a window
share one queue, in order of their names; so there are at most `size` queues, and what is broadcast is bounded.

Null text: empty. Null source: the source "". Each row is packed, also equal ones. An empty table gives no rows.
The order of a queue is that of the stored rows, by partition."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import SLICE
from .common import stored
from .pretokens import WordMemory


#: Pieces and words that a worker remembers, and how many where it holds much else. The ids are the same.
REMEMBERED, FEW_REMEMBERED = (600_000, 800_000), (75_000, 100_000)


class WordIds:
    """Ids of whole texts by the library; met words are kept, new ones are encoded many at a time, a space between them."""

    def __init__(self, path: str, remembered: tuple[int, int] = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.mark = commonprefix(special)  # asked for first, as it is cheap
        #: Ids are kept in 16 bits where the vocabulary allows.
        self.kind = np.dtype("<u2" if len(self.ends) <= 1 << 16 else "<u4")
        self.known = WordMemory(self._find, b"".join, remembered)

    def _find(self, words: list[str]) -> list[bytes]:
        found = []
        for at in range(0, len(words), 500):
            ids = np.array(self.library.encode(" ".join(words[at : at + 500]), add_special_tokens=False).ids, self.kind)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            found += [p.tobytes() for p in np.split(ids, cuts[:-1])]
        return found

    def packed(self, text: str) -> bytes:
        """The ids as unsigned numbers of self.kind."""
        if self.special and self.mark in text:
            return b"".join(np.array([self.library.token_to_id(p)], self.kind).tobytes() if n % 2 else b"".join(self.known.of(p)) for n, p in enumerate(self.special.split(text)))
        return b"".join(self.known.of(text))


@lru_cache(2)
def word_ids(path: str, remembered: tuple[int, int]) -> WordIds:
    """One for all tasks of a worker."""
    return WordIds(path, remembered)


def tokenized(docs: DataFrame, path: str, end_id: int = 2, key: str = "doc_id", text: str = "text", source: str = "source", remembered: tuple[int, int] = REMEMBERED) -> DataFrame:
    """doc_id, source, ids (binary, 16 or 32 bits each, the end id last), n tokens, part (its partition) and at (tokens of
    its source before it in the partition)."""
    kind = docs.schema[key].dataType.simpleString()
    src = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, part, so_far = word_ids(path, remembered), TaskContext.get().partitionId(), {}
        end, each = np.array([end_id], w.kind).tobytes(), w.kind.itemsize
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                b = whole.slice(start, SLICE)
                ids = [w.packed(t or "") + end for t in b.column(2).to_pylist()]
                at = []
                for s, i in zip(b.column(1).to_pylist(), ids, strict=True):
                    at.append(so_far.get(s, 0))
                    so_far[s] = at[-1] + len(i) // each
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary()), pa.array([len(i) // each for i in ids], pa.int64()), pa.array([part] * len(ids), pa.int32()), pa.array(at, pa.int64())], names=["doc_id", "source", "ids", "n", "part", "at"])

    return src.mapInArrow(run, f"doc_id {kind}, source string, ids binary, n bigint, part int, at bigint")


def whole_parts(ideal: list[Fraction], total: int) -> list[int]:
    """Whole numbers with the sum total, each next to its ideal one: the floors, and 1 more for the largest remainders."""
    low = [int(x) for x in ideal]
    for j in sorted(range(len(ideal)), key=lambda j: (low[j] - ideal[j], j))[: total - sum(low)]:
        low[j] += 1
    return low


def plan_phases(held: list[int], shares: list[Fraction], size: int) -> list[tuple[int, int, list[int]]]:
    """(first window, number of windows, tokens of each queue) of each phase. held: tokens of each queue."""
    left, window, phases = list(held), 0, []
    while any(left):
        live = [j for j, n in enumerate(left) if n]
        total = sum(left)
        if total <= size:
            windows, given = 1, list(left)
        else:
            weight = sum(shares[j] for j in live)
            ideal = {j: size * shares[j] / weight for j in live}
            fit = min(left[j] / ideal[j] for j in live)
            windows = int(fit)
            given = [0] * len(left)
            if windows:
                for j, n in zip(live, whole_parts([ideal[j] * windows for j in live], size * windows), strict=True):
                    given[j] = n
            else:  # queues with less than their quantum give all in one window, and the others fill it
                windows, room, rest = 1, size, list(live)
                while dry := [j for j in rest if left[j] <= room * shares[j] / sum(shares[i] for i in rest)]:
                    for j in dry:
                        given[j] = left[j]
                        room -= left[j]
                    rest = [j for j in rest if j not in dry]
                weight = sum(shares[j] for j in rest)
                for j, n in zip(rest, whole_parts([room * shares[j] / weight for j in rest], room), strict=True):
                    given[j] = n
            over = 0  # a rounded total may be one more than is held: another queue gives it
            for j in live:
                over += max(0, given[j] - left[j])
                given[j] = min(given[j], left[j])
            for j in live:
                more = min(over, left[j] - given[j])
                given[j] += more
                over -= more
        phases.append((window, windows, given))
        left = [a - b for a, b in zip(left, given, strict=True)]
        window += windows
    return phases


class Schedule:
    """Where a queue's tokens go: pieces(queue, first, count) are (start, length, window, offset) arrays."""

    def __init__(self, phases: list[tuple[int, int, list[int]]]):
        self.first = [p[0] for p in phases]
        self.windows = [p[1] for p in phases]
        self.upto = [np.concatenate([[0], np.cumsum(np.array(p[2], object))]) for p in phases]  # whole totals of queues 0..j-1
        self.before = np.cumsum(np.array([[0] * len(phases[0][2]), *(p[2] for p in phases)], object), axis=0) if phases else None

    def given(self, p: int, j: int, w: np.ndarray) -> np.ndarray:
        """Tokens that queues before the j-th have given after w windows of phase p: object numbers, which don't overflow."""
        return w * self.upto[p][j] // self.windows[p]

    def _after(self, p: int, j: int, tokens: int) -> int:
        """The first number of windows of phase p after which queue j has given more than `tokens`."""
        low, high = 0, self.windows[p]
        while low < high:
            mid = (low + high) // 2
            if self.given(p, j + 1, mid) - self.given(p, j, mid) > tokens:
                high = mid
            else:
                low = mid + 1
        return low

    def pieces(self, j: int, first: int, count: int) -> Iterator[tuple[int, int, int, int]]:
        done, p = 0, int(np.searchsorted(self.before[:, j].astype(np.int64), first, side="right")) - 1
        while done < count:
            at = first + done - self.before[p][j]  # in the phase
            here = min(count - done, self.before[p + 1][j] - self.before[p][j] - at)
            if here <= 0:
                p += 1
                continue
            w = self._after(p, j, at) - 1
            low, high = self.given(p, j, w), self.given(p, j + 1, w)
            end = at + here
            while at < end:
                low2, high2 = self.given(p, j, w + 1), self.given(p, j + 1, w + 1)
                n = min(end, high2 - low2) - at
                if n > 0:
                    yield done, n, self.first[p] + w, low2 - low + at - (high - low)
                    done += n
                    at += n
                low, high, w = low2, high2, w + 1


def queues_of(sources: list[tuple[str, int]], targets: dict[str, float] | None, size: int) -> tuple[list[list[str]], list[Fraction]]:
    """The sources of each queue and the queues' shares: largest first, those below one token a window together, last."""
    total = sum(n for _, n in sources)
    if targets is None:
        share = {s: Fraction(n, total) for s, n in sources}
    else:
        named = {s: Fraction(targets.get(s, 0)).limit_denominator(10**9) for s, _ in sources}
        if min(named.values()) < 0 or not sum(named.values()):
            raise ValueError("targets must not be negative, and one must be over 0")
        share = {s: x / sum(named.values()) for s, x in named.items()}
    own = sorted((s for s, _ in sources if share[s] * size >= 1), key=lambda s: (-share[s], s))
    tiny = sorted(s for s, _ in sources if share[s] * size < 1)
    queues, shares = [[s] for s in own], [share[s] for s in own]
    if tiny:
        rest = sum(share[s] for s in tiny)
        if rest * size >= 1 or not own:
            queues.append(tiny)
            shares.append(rest)
        else:
            queues[-1] += tiny
            shares[-1] += rest
    return queues, shares


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 2, targets: dict[str, float] | None = None, key: str = "doc_id", text: str = "text", source: str = "source", with_ids: bool = True, remembered: tuple[int, int] = REMEMBERED) -> DataFrame:
    """A row for each piece: key, start, length, ids (array<int>), ids_crc32, doc_tokens, sequence_id, offset and source.

    targets: shares of the tokens of a window by source; sources that have none share the smallest queue.
    with_ids=False leaves out the ids. remembered: pieces and words that each worker keeps."""
    spark = docs.sparkSession
    ids = stored(tokenized(docs, tokenizer, end_id, key, text, source, remembered), "packing-ids")
    parts = stored(ids.groupBy("source", "part").agg(F.sum("n").alias("n")), "packing-parts")
    # sources with a token or more in a window: at most `size` rows; the rest is one sum for each source's partitions
    total = parts.agg(F.sum("n")).first()[0] or 0
    by_source = parts.groupBy("source").agg(F.sum("n").alias("n"))
    if targets is None:
        big = [tuple(r) for r in by_source.where(F.col("n") * size >= total).collect()]
        small = by_source.where(F.col("n") * size < total).agg(F.sum("n"), F.min("source")).first()
        held = [*big, *([(small[1], small[0])] if small[0] else [])]
    else:
        named = [s for s in targets if targets[s] > 0]
        if len(named) > size:
            raise ValueError("more targets than tokens in a window")
        big = [tuple(r) for r in by_source.where(F.col("source").isin(named)).collect()]
        small = by_source.where(~F.col("source").isin(named)).agg(F.sum("n"), F.min("source")).first()
        held = [*big, *([(small[1], small[0])] if small[0] else [])]
    kind = ids.schema["doc_id"].dataType.simpleString()
    out = f"`{key}` {kind}, start bigint, length bigint, {"ids array<int>, " if with_ids else ""}ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, source string"
    if not total:
        return spark.createDataFrame([], out)
    own = {s for s, _ in big}
    rest = small[1] if small[0] else None
    queues, shares = queues_of(held, targets if targets is None or any(s in own for s in targets) else None, size)
    queue_of = {s: j for j, q in enumerate(queues) for s in q}
    shared = queue_of[rest] if rest is not None else -1
    before_rest = sum(n for s, n in held if s != rest and queue_of[s] == shared) if rest is not None else 0
    sizes = [sum(n for s, n in held if s in q) for q in queues]
    phases = plan_phases(sizes, shares, size)

    big_names = F.array(*[F.lit(s) for s in sorted(own)]) if own else F.array().cast("array<string>")
    starts = parts.withColumn("big", F.array_contains(big_names, F.col("source")))
    along = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("base", F.coalesce(F.sum("n").over(along), F.lit(0)))
    # sources in the shared queue stand one after another by name; their totals are summed in ranges of names
    tiny = starts.where(~F.col("big")).groupBy("source").agg(F.sum("n").alias("n"))
    names = ranged_sums(tiny, "source", "n").withColumnRenamed("before", "queue_base") if rest is not None else None
    if names is not None:
        starts = starts.join(names.select("source", "queue_base"), "source", "left")
    else:
        starts = starts.withColumn("queue_base", F.lit(0).cast("bigint"))
    starts = starts.select("source", "part", (F.col("base") + F.when(F.col("big"), F.lit(0)).otherwise(F.coalesce(F.col("queue_base"), F.lit(0)) + before_rest)).alias("base"), "big")
    starts = stored(starts, "packing-starts")  # of a known size, so Spark broadcasts it only where it is small
    placed = ids.join(starts, ["source", "part"]).select("doc_id", "source", "ids", "n", (F.col("base") + F.col("at")).alias("first"), "big")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule = Schedule(phases)
        for whole in batches:
            for cut in range(0, whole.num_rows, SLICE):
                d = whole.slice(cut, SLICE).to_pydict()
                rows: list[list] = [[] for _ in range(9)]
                for doc, src, packed, n, first, is_big in zip(*(d[c] for c in ("doc_id", "source", "ids", "n", "first", "big")), strict=True):
                    wide = np.frombuffer(packed, f"<u{len(packed) // n}").astype("<u4")
                    for start, length, window, offset in schedule.pieces(queue_of[src] if is_big else shared, first, n):
                        piece = wide[start : start + length]
                        for column, value in zip(rows, (doc, start, length, piece.astype(np.int32) if with_ids else None, zlib.crc32(piece), n, window, offset, src), strict=True):
                            column.append(value)
                kinds = [whole.schema.field("doc_id").type, *[pa.int64()] * 2, pa.list_(pa.int32()), *[pa.int64()] * 4, pa.string()]
                columns = {name: pa.array(c, k) for name, c, k in zip([key, "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"], rows, kinds, strict=True)}
                if not with_ids:
                    del columns["ids"]
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return placed.mapInArrow(run, out)


def ranged_sums(df: DataFrame, name: str, n: str) -> DataFrame:
    """name, n and `before`: the sum of n over all smaller names. df has one row for each name.

    Ranges of about equal numbers of names are written first; a range's rows are summed in it, and the sums of ranges,
    of which there are as many as shuffle partitions, among each other."""
    ranged = stored(df.select(name, n).repartitionByRange(name).withColumn("range", F.spark_partition_id()), "packing-ranges")
    heads = ranged.groupBy("range").agg(F.sum(n).alias("of"))
    heads = heads.withColumn("base", F.coalesce(F.sum("of").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum(n).over(Window.partitionBy("range").orderBy(name).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("inside", inside).join(heads.select("range", "base"), "range").select(name, n, (F.col("base") + F.col("inside")).alias("before"))
