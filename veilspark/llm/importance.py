"""Target-distribution importance resampling (operator 13): draw the documents that look most like a target text table.

Features are runs of one or more consecutive words, hashed into buckets. Each task counts its buckets in one array, and
the arrays are summed by bucket for both tables; a bucket's gain is a scaled log ratio of the smoothed shares. A
document's weight is the floored mean of its features' gains, looked up in the array of gains, and Gumbel noise made from
its id turns a draw without replacement into a top-k by score.

Scores are integers in a bounded range, so the exact histogram of scores is small. Its counts summed from the highest
score down say how many documents stand before each score, and where the cut is. Only documents at or above that score
are numbered, by doc_id within a score and a range of ids, so that no task gets all documents of a score.

Null and empty texts have no features: weight 0. Ids are integers; null ids get noise made of `7:` alone and come last
among equals, documents of equal id and score are in order of n_features. An empty target or table is allowed. Equal rows
are drawn each for itself. Columns other than key and text are ignored."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import SLICE, per_text
from .common import stored

BUCKETS, WORDS, MIN_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7
#: Ranges of ids that the documents of one score are dealt over.
RANGES = 64
#: Bytes of words: digits, letters, and all of other alphabets; A-Z lowered.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def features(text: str | None, words: int = WORDS, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """How many words the text has, and the bucket of each of its features.

    The CRC of a run goes on from that of the run without its last word."""
    crc = zlib.crc32
    found, runs = [], []
    split = (text or "").encode().translate(_WORD_BYTES).split()
    for w in split:
        spaced = b" " + w
        runs = [crc(w), *[crc(spaced, r) for r in runs[: words - 1]]]
        found += runs
    return len(split), np.array(found, np.uint32).astype(np.int64) % buckets


def bucket_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """bucket and n: how many features of all texts are in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for t in b.column(0):
                n += np.bincount(features(t.as_py())[1], minlength=BUCKETS)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["bucket", "n"])

    return texts.select(text).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket, from the counts of both tables: BUCKETS rows each at most."""

    def array(counts: DataFrame) -> np.ndarray:
        n = np.zeros(BUCKETS, np.float64)
        for bucket, count in counts.collect():
            n[bucket] = count
        return n

    s, t = array(source), array(target)
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_features and weight of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # BUCKETS numbers

    def make():
        own = sent.value

        def one(text: str | None) -> tuple[int, int, int]:
            n, found = features(text)
            return n, len(found), int(own[found].sum()) // len(found) if len(found) else 0

        return lambda texts: zip(*map(one, texts)) if texts else ([], [], [])

    return per_text(docs, make, "n_words bigint, n_features bigint, weight bigint", key, text)


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id, scaled and floored as weights are."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), ), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """scored (stored; with key, score, n_features and eligible) and rank: 1 to k in order of score, then of smaller key; else null."""
    able = scored.where("eligible")
    # one row for each integer between the least and the greatest score; these are bounded by the gains of 64-bit counts
    histogram = able.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stored(histogram.select("score", above.alias("above")), "importance-histogram")
    cut = offsets.where(F.col("above") < k).agg(F.min("score")).first()[0]
    if cut is None:
        return scored.withColumn("rank", F.lit(None).cast("bigint"))
    low, high = able.agg(F.min(key), F.max(key)).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // RANGES))
    part = F.when(F.col(key).isNull(), RANGES + F.pmod("row", F.lit(RANGES))).otherwise(F.floor((F.col(key) - F.lit(low or 0)) / width))
    some = able.where(F.col("score") >= cut).withColumn("part", part.cast("int"))
    cells = some.groupBy("score", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("score").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.join(F.broadcast(offsets), "score").select("score", "part", (F.col("above") + before).alias("before"))
    place = F.row_number().over(Window.partitionBy("score", "part").orderBy(F.col(key).asc_nulls_last(), "n_features", "row"))
    rank = F.col("before") + place
    drawn = some.join(cells, ["score", "part"]).withColumn("rank", F.when(rank <= k, rank))
    others = scored.where(~F.col("eligible") | (F.col("score") < cut)).withColumn("rank", F.lit(None).cast("bigint"))
    return others.unionByName(drawn.select(others.columns))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_features, weight, score and rank of each row of docs.

    Of the N documents with at least min_words words, floor(percent * N / 100) are drawn; others have no rank."""
    gain = gains(bucket_counts(docs, text), bucket_counts(target, text))
    rows = weights(docs, gain, key, text)
    score = F.col("weight") + noise(F.col(key), seed)
    scored = stored(rows.select(key, "n_features", "weight", score.alias("score"), (F.col("n_words") >= min_words).alias("eligible"), F.monotonically_increasing_id().alias("row")), "importance")
    k = percent * scored.where("eligible").count() // 100
    return ranked(scored, k, key).select(key, "n_features", "weight", "score", "rank")
