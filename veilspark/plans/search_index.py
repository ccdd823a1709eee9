"""A stored index of policy pieces: BM25 search that reads the postings it needs, and refreshes that write what has changed.

The index is a table of segments, each added by one commit. A segment holds its pieces with their terms, the postings of
each term in blocks, best ones first, and by how much the number of pieces that hold a term has changed. A block names the
most often and the shortest piece in it, which bound the weight of all its postings whatever the corpus has become since.
A piece counts in its last segment only; older postings of it are passed over.

A search first reads the first block of each term and takes the n-th best of what it finds as the least a result must
have. Terms that even together can't reach it bring no candidates, and of the other terms only blocks are read that,
with the most that the question's other terms can add, may reach it. Candidates are then scored by their own terms."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.versions import Versions
from .policy import B, K1, TOP, terms

#: Postings in a block.
BLOCK = 128
#: Scores are compared as rounded to six places.
_ROUNDED = 2e-6


def _saturated(tf: Column, n: Column, mean: Column) -> Column:
    """What a term's number in a piece of n words adds, without idf: more for greater tf, less for greater n."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / mean))


class SearchIndex:
    """key: the columns that name a piece. buckets: folders that postings are dealt over by tool and term, the same for all
    refreshes; a search reads those of its terms."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 64):
        self.spark, self.key, self.buckets, self.table = spark, key, buckets, Versions(spark, path)

    def _part(self, name: str, columns: list[str] | None = None) -> DataFrame:
        """A part of all segments, with the segment's number."""
        frames = []
        for i, segment in enumerate(self.table.current()["parts"]):
            rows = self.spark.read.parquet(f"{self.table.path}/{segment}/{name}")
            frames.append((rows if columns is None else rows.select(*columns)).withColumn("segment", F.lit(i)))
        whole = frames[0]
        for f in frames[1:]:
            whole = whole.unionByName(f)
        return whole

    def _pieces(self) -> DataFrame:
        """Each piece as its last segment has it; removed ones have no words."""
        return self._part("pieces").groupBy(*self.key).agg(F.max_by(F.struct("segment", "tool_id", "n", "tf"), "segment").alias("p")).select(*self.key, "p.*")

    def refresh(self, changed: DataFrame, removed: DataFrame | None = None) -> None:
        """Pieces (key, tool_id, chunk_text) that are new or have changed, and keys of those that are gone."""
        segment, before = f"part-{uuid.uuid4().hex}", self.table._numbers()
        held = self.table.current()["parts"]
        folder = f"{self.table.path}/{segment}"
        words = changed.select(*self.key, "tool_id", terms(F.col("chunk_text")).alias("w"))
        counted = words.select(*self.key, "tool_id", F.size("w").cast("bigint").alias("n"), F.explode_outer("w").alias("term")).groupBy(*self.key, "tool_id", "n", "term").agg(F.count(F.lit(1)).alias("c"))
        rows = counted.groupBy(*self.key, "tool_id", "n").agg(F.map_from_entries(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "c")))).alias("tf"))
        if removed is not None:
            nothing = F.lit(None)
            rows = rows.unionByName(removed.select(*self.key, nothing.cast("string").alias("tool_id"), nothing.cast("bigint").alias("n"), nothing.cast("map<string,bigint>").alias("tf")))
        rows.write.parquet(f"{folder}/pieces")
        new = self.spark.read.parquet(f"{folder}/pieces")
        present = new.where("n is not null")

        mean = present.agg(F.avg("n")).first()[0] or 1.0
        postings = present.select(*self.key, "tool_id", "n", F.explode("tf").alias("term", "tf"))
        best = Window.partitionBy("tool_id", "term").orderBy(F.desc(_saturated(F.col("tf"), F.col("n"), F.lit(mean))), *self.key)
        placed = postings.withColumn("block", F.floor((F.row_number().over(best) - 1) / BLOCK))
        blocks = placed.groupBy("tool_id", "term", "block").agg(F.max("tf").alias("most"), F.min("n").alias("least"), F.collect_list(F.struct(*self.key, "n", "tf")).alias("postings"))
        blocks = blocks.withColumn("bucket", F.pmod(F.xxhash64("tool_id", "term"), F.lit(self.buckets)).cast("int")).withColumn("tier", F.least("block", F.lit(1)).cast("int"))
        blocks.repartition("bucket").sortWithinPartitions("tier", "bucket", "tool_id", "term").write.partitionBy("tier", "bucket").parquet(f"{folder}/blocks")

        def totals(pieces: DataFrame, sign: int) -> DataFrame:
            each = pieces.select(F.explode("tf").alias("term", "tf")).groupBy("term").agg((sign * F.count(F.lit(1))).alias("pieces"), F.lit(0).cast("bigint").alias("words"))
            return each.unionByName(pieces.agg(F.lit(None).cast("string").alias("term"), (sign * F.count(F.lit(1))).alias("pieces"), (sign * F.coalesce(F.sum("n"), F.lit(0))).alias("words")))

        change = totals(present, 1)
        if held:
            change = change.unionByName(totals(self._pieces().where("n is not null").join(new.select(*self.key), self.key, "left_semi"), -1))
        change.groupBy("term").agg(F.sum("pieces").alias("pieces"), F.sum("words").alias("words")).write.parquet(f"{folder}/terms")
        self.table._committed(max(before, default=0), [*held, segment], {})

    def _asked(self, questions: DataFrame) -> DataFrame:
        """question_id, tool_id, term, idf and mean of each different term of the questions that some piece holds."""
        counts = self._part("terms").groupBy("term").agg(F.sum("pieces").alias("pieces"), F.sum("words").alias("words"))
        about = counts.where("term is null").select(F.col("pieces").alias("all"), (F.col("words") / F.col("pieces")).alias("mean"))
        each = questions.select("question_id", "tool_id", F.explode(F.array_distinct(terms(F.col("question")))).alias("term"))
        found = each.join(counts.where("pieces > 0"), "term").crossJoin(F.broadcast(about))  # one row
        return found.select("question_id", "tool_id", "term", F.log(1 + (F.col("all") - F.col("pieces") + 0.5) / (F.col("pieces") + 0.5)).alias("idf"), "mean")

    def _postings(self, blocks: DataFrame, live: DataFrame) -> DataFrame:
        """Weights of the postings of blocks (with question and idf) whose piece is still that of the block's segment."""
        weight = F.col("idf") * _saturated(F.col("p.tf"), F.col("p.n"), F.col("mean"))
        rows = blocks.select("question_id", "tool_id", "segment", F.explode("postings").alias("p"), "idf", "mean").select("question_id", "tool_id", "segment", *[f"p.{k}" for k in self.key], weight.alias("weight"))
        return rows.join(live, [*self.key, "segment"], "left_semi")

    def needed(self, questions: DataFrame, n: int = TOP) -> tuple[DataFrame, DataFrame]:
        """The asked terms, and the blocks that may hold one of the n best pieces of a question, without their postings."""
        asked = self._asked(questions)
        live = self._pieces().where("n is not null").select(*self.key, "segment")
        first = self._part("blocks").where("tier = 0").drop("bucket", "tier")
        partial = self._postings(first.join(asked, ["tool_id", "term"]), live).groupBy("question_id", "tool_id", *self.key).agg(F.sum("weight").alias("score"))
        nth = Window.partitionBy("question_id", "tool_id").orderBy(F.desc("score"))
        least = partial.withColumn("r", F.row_number().over(nth)).where(F.col("r") <= n).groupBy("question_id", "tool_id").agg(F.when(F.count(F.lit(1)) == n, F.min("score")).otherwise(0.0).alias("least_score"))
        heads = self._part("blocks", ["tool_id", "term", "block", "most", "least", "bucket", "tier"]).join(asked, ["tool_id", "term"])
        heads = heads.withColumn("bound", F.col("idf") * _saturated(F.col("most"), F.col("least"), F.col("mean")))
        tops = heads.groupBy("question_id", "tool_id", "term").agg(F.max("bound").alias("top"))
        upto = Window.partitionBy("question_id", "tool_id").orderBy("top", "term")  # the terms of one question
        every = Window.partitionBy("question_id", "tool_id")
        tops = tops.withColumn("together", F.sum("top").over(upto)).withColumn("all_tops", F.sum("top").over(every))
        chosen = heads.join(tops, ["question_id", "tool_id", "term"]).join(least, ["question_id", "tool_id"], "left")
        bar = F.coalesce("least_score", F.lit(0.0)) - _ROUNDED
        return asked, chosen.where((F.col("together") >= bar) & (F.col("bound") + F.col("all_tops") - F.col("top") >= bar)).select("question_id", "tool_id", "term", "segment", "block", "bucket", "tier", "idf", "mean")

    def search(self, questions: DataFrame, n: int = TOP) -> DataFrame:
        """The n best pieces for each question (question_id, tool_id, question); ties by key. As policy.search gives."""
        asked, chosen = self.needed(questions, n)
        folders = chosen.select("tier", "bucket").distinct().collect()  # 2 * buckets at most: only these folders are read
        read = [F.col("tier") == t for t in {r[0] for r in folders}]
        stored = self._part("blocks").where(F.col("bucket").isin([r[1] for r in folders]) & (read[0] if len(read) == 1 else F.lit(bool(read))))
        pieces = self._pieces().where("n is not null").drop("tool_id")
        blocks = stored.join(chosen.drop("bucket", "tier", "idf", "mean"), ["tool_id", "term", "segment", "block"])
        candidates = blocks.select("question_id", "tool_id", "segment", F.explode("postings").alias("p")).select("question_id", "tool_id", "segment", *[f"p.{k}" for k in self.key]).distinct()
        weighed = asked.groupBy("question_id", "tool_id").agg(F.collect_list(F.struct("term", "idf")).alias("asked"), F.first("mean").alias("mean"))
        rows = candidates.join(pieces, [*self.key, "segment"]).join(weighed, ["question_id", "tool_id"])
        mine = F.transform("asked", lambda t: F.coalesce(t["idf"] * _saturated(F.element_at("tf", t["term"]), F.col("n"), F.col("mean")), F.lit(0.0)))
        scores = rows.select("question_id", "tool_id", *self.key, F.round(F.aggregate(mine, F.lit(0.0), lambda a, x: a + x), 6).alias("score"))
        w = Window.partitionBy("question_id", "tool_id").orderBy(F.desc("score"), *self.key)
        return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
