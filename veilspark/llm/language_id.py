"""Language identification (operator 10): the nearest of several centroids for each language.

A text is a vector of letter trigrams (lower case, everything else a blank), hashed to a fixed number of places, each
weighted (1 + log count) * idf, and scaled to length one. Spherical k-means makes up to CLUSTERS centroids of each
language's training texts. A text takes the language of the centroid of highest cosine, and is rejected when it is
farther from it than nearly all training texts were.

Centroids are fitted on about SAMPLE texts of each language, chosen by a hash of the id (a bounded sample); document
frequencies and everything else cover all rows. Languages are handled in blocks of BLOCK, so a model of any number of
them is never in one place as a whole. Null texts, and texts without a letter, are `und` with score 0. Of equal cosines
the first language by name is taken. Equal texts give equal results; columns other than key and text don't matter. An
empty table, or no training text, gives no language."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import per_text
from .common import stored

SAMPLE, CLUSTERS, PLACES = 400, 4, 1 << 14
#: Languages whose centroids are held at a time: BLOCK * CLUSTERS * PLACES * 4 bytes are 128 MB.
BLOCK = 512
_LETTER = regex.compile(r"\p{L}")


@lru_cache(1)
def _blanked() -> np.ndarray:
    """Of each code point itself if it is a letter or a mark on one, else a blank."""
    return np.array([c if unicodedata.category(chr(c))[0] in "LM" else 32 for c in range(sys.maxunicode + 1)], np.uint32)


def counts(text: str) -> np.ndarray:
    """How often each place is hit by the text's trigrams."""
    c = _blanked()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), "<u4")]
    h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
    return np.bincount((h * np.uint32(0x27D4EB2F)) >> np.uint32(18), minlength=PLACES)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), PLACES), np.float32)
    for row, t in zip(out, texts, strict=True):
        n = counts(t)
        at = np.flatnonzero(n)
        row[at] = (1 + np.log(n[at])) * idf[at]
        row /= np.linalg.norm(row) or 1
    return out


def spherical_means(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Up to k centroids of length one. The first is the vector nearest to the mean, the next the farthest from those so far."""
    at = [int(np.argmax(v @ v.mean(0)))]
    while len(at) < min(k, len(v)):
        at.append(int(np.argmin((v @ v[at].T).max(1))))
    c = v[at]
    for _ in range(rounds):
        own = np.argmax(v @ c.T, axis=1)
        c = np.stack([v[own == j].sum(0) for j in range(len(c)) if (own == j).any()])
        c /= np.linalg.norm(c, axis=1, keepdims=True)
    return c


def fit(docs: DataFrame, trained: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict:
    """The model of the rows for which `trained` holds: idf, and the table of centroids with the number of its blocks.

    trained may name the key column; other columns of docs are not looked at."""
    rows = docs.where(trained & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    million = 1_000_000
    held = stored(rows.groupBy("lang").agg(F.greatest(F.lit(1), F.floor(million * F.least(F.lit(1.0), SAMPLE / F.count(F.lit(1))))).alias("part")), "lang-parts")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(PLACES, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                total += counts(t) > 0
                n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, PLACES), pa.int32()), pa.array([n, *total], pa.int64())], names=["place", "n"])

    # PLACES rows from each partition, and as many in all
    df = dict(map(tuple, rows.select("text").mapInArrow(frequencies, "place int, n bigint").groupBy("place").agg(F.sum("n")).collect()))
    idf = np.log((1 + df.get(-1, 0)) / (1 + np.array([df.get(i, 0) for i in range(PLACES)]))).astype(np.float32) + np.float32(1)
    sample = rows.join(held, "lang").where(F.pmod(F.xxhash64("id", F.lit("lang")), F.lit(million)) < F.col("part")).select("id", "lang", "text")

    def clusters(name: tuple, group: pd.DataFrame) -> pd.DataFrame:
        v = vectors(group.sort_values("id")["text"].tolist(), idf)
        c = spherical_means(v, CLUSTERS)
        near = (v @ c.T).max(1)
        return pd.DataFrame({"lang": [name[0]] * len(c), "n": range(len(c)), "centroid": [x.tobytes() for x in c], "radius": [float(1 - near.min()) * 1.25 + 0.05] * len(c)})

    # a language's sample is about SAMPLE texts, whatever its share of the rows
    found = stored(sample.groupBy("lang").applyInPandas(clusters, "lang string, n int, centroid binary, radius double"), "lang-centroids")
    return {"idf": idf, "centroids": found, "blocks": -(-held.count() // BLOCK)}


def predict(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score (cosine, 0 to 1), rejected (too far from every centroid, or no letter).

    One pass over docs for each block of languages; with more than one, the best of each row is taken by a grouping."""
    blocks = max(1, model["blocks"])
    if blocks == 1:
        return _nearest(docs, model, model["centroids"], key, text)
    rows = stored(docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.monotonically_increasing_id().alias("row")), "lang-rows")
    each = None
    for i in range(blocks):
        part = model["centroids"].where(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == i)
        found = _nearest(rows, model, part, "row", "t")
        each = found if each is None else each.unionByName(found)
    best = each.groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("s"), (F.col("lang_pred") == "und").alias("none"), "lang_pred", "score", "rejected")).alias("b"))
    return rows.select("row", F.col("k").alias(key)).join(best, "row").select(key, "b.lang_pred", "b.score", "b.rejected")


def _nearest(docs: DataFrame, model: dict, centroids: DataFrame, key: str, text: str) -> DataFrame:
    """The prediction of a block of languages."""
    held = sorted(centroids.collect())  # about BLOCK languages at most
    few = {"idf": model["idf"], "langs": [r["lang"] for r in held], "radii": [r["radius"] for r in held]}
    few["centroids"] = np.stack([np.frombuffer(r["centroid"], np.float32) for r in held]) if held else np.zeros((0, PLACES), np.float32)
    sent = docs.sparkSession.sparkContext.broadcast(few)  # about 128 MB at most: see BLOCK

    def make():
        m = sent.value

        def work(texts):
            lang, score, rejected = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
            real = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
            for at in range(0, len(real) if m["langs"] else 0, 64):
                some = real[at : at + 64]
                near = vectors([texts[i] for i in some], m["idf"]) @ m["centroids"].T
                for i, best, cosines in zip(some, near.argmax(1), near, strict=True):
                    lang[i], score[i] = m["langs"][best], float(min(1, max(0, cosines[best])))
                    rejected[i] = bool(1 - cosines[best] > m["radii"][best])
            return lang, score, rejected

        return work

    return per_text(docs, make, "lang_pred string, score double, rejected boolean", key, text)
