"""SimHash near-duplicates by anchor-point covering (operator 4).

Anchors are the words of a covering code: pairs of codewords of the binary Golay code of length 23, over the first and
second 23 bits of a fingerprint. Every 23-bit word is within 3 bits (the covering radius) of exactly one codeword. A
fingerprint lives at its nearest anchor, and is replicated to every anchor whose two halves together are within the
covering radius plus the threshold of it. Of two fingerprints that differ in at most `threshold` bits, the second is
therefore also at the first one's anchor: there they meet once, and the whole 64 bits are compared.

Only distinct fingerprints are compared, so copies cost nothing. A fingerprint has at most 2,080 others within two
bits, however many documents there are. Documents that links join, over any number of them, share a component.

Null and empty texts have the fingerprint zero, linked like any other. Equal rows stay, in one component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import SLICE, per_text
from .common import joined_once, numbered, restored, stored
from .components import components

_LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The generator polynomial of the Golay code.
_GOLAY = 0b101011100011
_BITS = 23
ROW = "_simhash_row"
_RADIUS = 3


def fingerprint(text: str | None, words: int = 3) -> int:
    """Each bit is 1 if it is set in over half the hashes of the text's shingles, repeats included."""
    w = (text or "").encode().translate(_LOWERED).split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, 42) for s in shingles], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fp: the fingerprint as a signed long."""

    def make():
        return lambda texts: ([f - (1 << 64) if f >> 63 else f for f in (fingerprint(t, words) for t in texts)],)

    return per_text(docs, make, "fp bigint", key, text)


class Golay:
    """near(word): the number of its codeword; within(word): the codewords up to `more` bits beyond the covering radius."""

    def __init__(self, more: int):
        code = np.zeros(1 << 12, np.int64)
        for bit in range(12):
            code ^= np.where(np.arange(1 << 12) >> bit & 1, _GOLAY << bit, 0)
        singles = 1 << np.arange(_BITS)
        leaders = {0, *(int(x) for x in singles)}
        for _ in range(_RADIUS - 1):
            leaders |= {x ^ int(s) for x in leaders for s in singles}
        leaders = np.array(sorted(x for x in leaders if x.bit_count() <= _RADIUS))
        self.near, self.leader = np.empty(1 << _BITS, np.int32), np.empty(1 << _BITS, np.int32)
        for i, e in enumerate(leaders):
            self.near[code ^ e] = np.arange(len(code))
            self.leader[code ^ e] = i
        # The code is linear: codewords around a word are its own one plus those around what the word lacks to it.
        self.around = []
        for e in leaders:
            far = np.bitwise_count(code ^ e).astype(np.int64)
            at = np.flatnonzero(far <= _RADIUS + more)
            self.around.append([at[np.maximum(far[at] - _RADIUS, 0) == x] for x in range(more + 1)])

    def within(self, word: int, more: int) -> np.ndarray:
        """Codewords exactly `more` bits beyond the radius; at 0 all those inside it."""
        return self.around[self.leader[word]][more] ^ self.near[word]


def anchored(distinct: DataFrame, threshold: int = 2) -> tuple[DataFrame, DataFrame]:
    """(anchor, fp) of each fingerprint's home, and of all its replicas."""

    def placed(replicate: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            golay, mask = Golay(threshold), (1 << _BITS) - 1
            for whole in batches:
                for start in range(0, whole.num_rows, SLICE * 8):
                    fp = whole.column(0).slice(start, SLICE * 8).to_numpy(zero_copy_only=False).astype(np.int64)
                    one, two = fp & mask, fp >> _BITS & mask
                    if not replicate:
                        anchors, fps = golay.near[one].astype(np.int64) << 12 | golay.near[two], fp
                    else:
                        parts, sizes = [], []
                        for a, b in zip(one, two, strict=True):
                            left = [golay.within(a, x).astype(np.int64) << 12 for x in range(threshold + 1)]
                            right = [golay.within(b, x) for x in range(threshold + 1)]
                            own = [(left[x][:, None] | right[y]).ravel() for x in range(threshold + 1) for y in range(threshold + 1 - x)]
                            parts += own
                            sizes.append(sum(map(len, own)))
                        anchors, fps = np.concatenate(parts) if parts else np.zeros(0, np.int64), np.repeat(fp, sizes)
                    yield pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(fps, pa.int64())], names=["anchor", "fp"])

        return distinct.select("fp").mapInArrow(run, "anchor bigint, fp bigint")

    return placed(False), placed(True)


def links(distinct: DataFrame, threshold: int = 2) -> DataFrame:
    """a and b, each pair of different fingerprints within threshold bits once. distinct: fp, without repeats."""
    home, replicas = anchored(distinct, threshold)
    h, r = home.alias("h"), replicas.alias("r")
    near = (F.col("h.anchor") == F.col("r.anchor")) & (F.col("h.fp") < F.col("r.fp")) & (F.bit_count(F.col("h.fp").bitwiseXOR(F.col("r.fp"))) <= threshold)
    return h.join(r, near).select(F.col("h.fp").alias("a"), F.col("r.fp").alias("b"))


def near_duplicates(docs: DataFrame, threshold: int = 2, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id (the smallest key that links reach) of each row."""
    fps = stored(fingerprints(docs, words, key, text), "simhash")
    distinct = stored(fps.groupBy("fp").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    roots = components(links(distinct, threshold)).withColumnRenamed("node", "fp")
    own = stored(distinct.join(roots, "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    least = own.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("m"))
    of = stored(joined_once(own, least, "root", "m").select("fp", "component_id", "n"), "simhash-components")
    return joined_once(fps, of, "fp", "n").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, threshold: int = 2, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs, with all its columns, of each component: that of the smallest key, null keys last.

    Rows are told apart by a number that is written with them, as keys may be null or repeat."""
    rows, names = numbered(docs, ROW, "simhash-rows")
    fps = stored(fingerprints(rows, words, ROW, names[text]), "simhash")
    order = F.struct(F.col("k").isNull().alias("absent"), F.col("k").alias("k"), F.col(ROW).alias("row"))
    own = stored(fps.join(rows.select(ROW, F.col(names[key]).alias("k")), ROW).groupBy("fp").agg(F.min(order).alias("first")), "simhash-distinct")
    roots = components(links(own, threshold)).withColumnRenamed("node", "fp")
    least = own.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    gone = stored(fps.select(ROW).join(least.select(F.col("first.row").alias(ROW)), ROW, "left_anti"), "simhash-gone")
    return restored(rows.join(gone, ROW, "left_anti"), docs)
