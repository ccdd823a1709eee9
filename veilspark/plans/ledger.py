"""The ledger of disclosures: records that are written once, totals, and the recovering score."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..functions.scalars import conversation_hash, cost_of, message_hash, normalize_prompt
from ..schema import ACTIONS, ENTITY_TYPES, SITES, SOURCES
from .order import numbered_within, same_key_join

# Fixed values.
MOST_COUNT, KEPT_EVENTS, MOST_RECORDS, SCORE_DAYS, DAILY_GAIN, FULL = 10_000, 5_000, 20_000, 30, 2, 100
# End of fixed values.
#: How many lengths of a window are one stretch of a key's times.
RANGE = 1024


def valid_event() -> Column:
    return F.col("type").isin(*ENTITY_TYPES) & F.col("site").isin(*SITES) & F.col("source").isin(*SOURCES) & F.col("action").isin(*ACTIONS) & F.col("ts").isNotNull()


def valid_events(events: DataFrame, now: str | None = None, since: str | None = None) -> DataFrame:
    """Events of known kinds, not later than now and later than since."""
    rows = events.where(F.coalesce(valid_event(), F.lit(False)))
    rows = rows if now is None else rows.where(F.col("ts") <= F.lit(now).cast("timestamp"))
    return rows if since is None else rows.where(F.col("ts") > F.lit(since).cast("timestamp"))


def validated(records: DataFrame, strict: bool = True, most: int | None = None) -> DataFrame:
    """Records with right ids, sites, times and counts (whole, 0 to MOST_COUNT), then without counts of 0.

    strict: a wrong one is an error, else it is left out. most: more records than that are an error."""
    hash_like = lambda c: F.col(c).rlike(r"\A[a-f0-9]{64}\z")
    right = F.forall(F.map_entries("counts"), lambda e: e["key"].isin(*ENTITY_TYPES) & e["value"].between(0, MOST_COUNT))
    good = F.coalesce(hash_like("id") & hash_like("conversation") & F.col("site").isin(*SITES) & (F.col("ts") >= F.timestamp_millis(F.lit(0))) & right, F.lit(False))
    # the counts are looked at as they came: the test stands on the input, below the map without zeros
    rows = records.withColumn("_good", good).withColumn("counts", F.map_filter("counts", lambda k, v: v > 0))
    if most is not None:
        total = records.agg((F.count(F.lit(1)) > most).alias("_over"))
        rows = rows.crossJoin(F.broadcast(total)).withColumn("_good", F.when(F.col("_over"), F.raise_error(f"more than {most} records").cast("boolean")).otherwise(F.col("_good"))).drop("_over")  # one row
    if not strict:
        return rows.where("_good").drop("_good")
    return rows.withColumn("id", F.when(F.col("_good"), F.col("id")).otherwise(F.raise_error("invalid activity record").cast("string"))).drop("_good")


def identified(messages: DataFrame) -> DataFrame:
    """id, conversation (both hashed), site, ts and how often the same text came before in its conversation."""
    text = normalize_prompt(F.col("text"))
    rows = messages.withColumn("_t", F.sha2(text, 256))
    rows = numbered_within(rows, ["site", "conversation_id", "_t"], ["ts", "seq"], "_nth")
    rows = rows.withColumn("occurrence", F.col("_nth") - 1).withColumn("conversation", conversation_hash(F.col("site"), F.col("conversation_id")))
    return rows.withColumn("id", message_hash(F.col("conversation"), F.col("text"), F.col("occurrence"))).drop("_t", "_nth")


def history_records(detected: DataFrame) -> DataFrame:
    """Records of imported user messages: findings of each type. detected: site, conversation_id, seq, text, ts, findings."""
    types = F.transform("findings", lambda f: f["type"])
    distinct = F.array_sort(F.array_distinct(types))
    counts = F.map_from_arrays(distinct, F.transform(distinct, lambda t: F.size(F.filter(types, lambda x: x == t))))
    return identified(detected).select("id", "conversation", "site", counts.alias("counts"), "ts")


def added(ledger: DataFrame, incoming: DataFrame, epoch: str) -> DataFrame:
    """Incoming records whose id is new, each once. Another epoch than the ledger's is an error (both have epoch)."""
    same = F.when(F.col("epoch") == epoch, F.col("id")).otherwise(F.raise_error("activity was reset").cast("string"))
    new = validated(incoming).withColumn("id", same).dropDuplicates(["id"])  # in the key, so that no row skips it
    return new.join(ledger.select("id"), "id", "left_anti")


def merged(ledger: DataFrame, incoming: DataFrame, epoch: str, most: int | None = None) -> DataFrame:
    """The ledger with what is new; what is there already stays. most: a ledger of more records (for one person's, MOST_RECORDS) is an error."""
    whole = ledger.unionByName(added(ledger, incoming, epoch).select(ledger.columns))
    if most is None:
        return whole
    total = whole.agg((F.count(F.lit(1)) > most).alias("_over"))
    full = F.when(F.col("_over"), F.raise_error(f"the ledger would hold more than {most} records").cast("string")).otherwise(F.col("id"))
    return whole.crossJoin(F.broadcast(total)).withColumn("id", full).drop("_over")  # one row


def activity_stats(records: DataFrame) -> DataFrame:
    """One row: conversations, messages, shared, categories, cost, score, counts."""
    about = records.agg(F.count_distinct("conversation").alias("conversations"), F.count(F.lit(1)).alias("messages"))
    each = records.select(F.explode("counts").alias("type", "n")).groupBy("type").agg(F.sum("n").alias("n"))
    total = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("shared"), F.count(F.lit(1)).alias("categories"), F.coalesce(F.sum(F.col("n") * cost_of(F.col("type"))), F.lit(0)).alias("cost"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("counts"))
    return about.crossJoin(total).withColumn("score", F.greatest(F.lit(0), FULL - F.col("cost")))  # one row each


def live_stats(events: DataFrame, prompts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """What was shared and what protected; prompts: id and conversation of sent prompts."""
    keys = by or []
    shared = F.col("action") == "as_is"
    e = events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("findings"), F.count_if(shared).alias("shared"), F.count_if(F.col("action") == "renamed").alias("protected"),
        F.sort_array(F.collect_set(F.when(shared, F.col("type")))).alias("categories"), F.coalesce(F.sum(F.when(shared, cost_of(F.col("type")))), F.lit(0)).alias("cost"),
    )
    p = prompts.groupBy(*keys).agg(F.count(F.lit(1)).alias("prompts"), F.count_distinct("conversation").alias("conversations"))
    return e.join(p, keys, "full_outer") if keys else e.crossJoin(p)  # one row each


def newest(events: DataFrame, n: int = KEPT_EVENTS, by: str = "user_id") -> DataFrame:
    """The last n events of each user. Spark keeps n rows of a user in each task before any are moved."""
    w = Window.partitionBy(by).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def score_replay(events: DataFrame, now: str, by: str = "user_id", order: str = "event_id") -> DataFrame:
    """by, date and score of each of the last SCORE_DAYS days, today among them.

    A score starts at 100; each thing shared as it is costs, down to 0; each day without any between the first day and
    today gives 2 back, up to 100. Clamped steps x -> min(u, max(l, x + d)) are closed under composition. So each day's
    events are first folded into one such step (partial sums don't do, the floor counts after each event), and then the
    days of a user, of which there are few, in order. Ties in time are in the order of `order`."""
    today = F.datediff(F.lit(now).cast("timestamp").cast("date"), F.lit("1970-01-01"))
    rows = events.where(F.col("ts") <= F.lit(now).cast("timestamp")).withColumn("day", F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01")))
    # Inside a day only costs come, so the floor at 0 after each equals one floor after all.
    days = rows.groupBy(by, "day").agg(F.coalesce(F.sum(F.when(F.col("action") == "as_is", cost_of(F.col("type")))), F.lit(0)).alias("lost"), F.max((F.col("action") == "as_is").cast("int")).alias("leaked"))
    users = days.groupBy(by).agg(F.min("day").alias("first"), F.array_sort(F.collect_list(F.struct("day", "lost", "leaked"))).alias("days"))
    recent = F.transform(F.sequence(today - (SCORE_DAYS - 1), today), lambda d: F.struct(d.alias("day"), F.lit(0).cast("bigint").alias("lost"), F.lit(0).alias("leaked")))
    missing = F.filter(recent, lambda r: ~F.exists("days", lambda d: d["day"] == r["day"]))
    typed = F.transform("days", lambda d: F.struct(d["day"].alias("day"), d["lost"].cast("bigint").alias("lost"), d["leaked"].alias("leaked")))
    all_days = F.array_sort(F.concat(typed, missing))
    first = F.col("first")
    start = F.struct(F.lit(FULL).cast("bigint").alias("score"), (first - 1).alias("before"), F.array().cast("array<struct<day:int,score:bigint>>").alias("out"))

    def step(acc: Column, d: Column) -> Column:
        day = d["day"]
        idle = F.greatest(F.lit(0), day - F.greatest(acc["before"], first) - 1)
        score = F.when(day > first, F.least(F.lit(FULL), acc["score"] + DAILY_GAIN * idle)).otherwise(acc["score"])
        score = F.greatest(F.lit(0), score - d["lost"])
        score = F.when((day > first) & (day < today) & (d["leaked"] == 0), F.least(F.lit(FULL), score + DAILY_GAIN)).otherwise(score).cast("bigint")
        out = F.when(day >= today - (SCORE_DAYS - 1), F.concat(acc["out"], F.array(F.struct(day.alias("day"), score.alias("score"))))).otherwise(acc["out"])
        return F.struct(score.alias("score"), day.alias("before"), out.alias("out"))

    folded = users.select(by, F.aggregate(all_days, start, step, lambda acc: acc["out"]).alias("daily"))
    return folded.select(by, F.explode("daily").alias("d")).select(by, F.date_add(F.lit("1970-01-01").cast("date"), F.col("d.day")).cast("string").alias("date"), F.col("d.score").alias("score"))


def rate_limited(requests: DataFrame, limit: int, seconds: int = 60, key: str = "key", order: str = "event_id") -> DataFrame:
    """requests with window_start and denied. A window opens at a key's first request after the last one closed; refused
    requests count too.

    Windows of a key follow from each other, so its times are cut first where one opens for certain: after a gap of a
    window's length. Gaps are found inside stretches of RANGE windows, and stretches joined by what their ends say, so
    no task sorts all times of a hot key. What lies between two gaps is gone through in order, as a stream of Arrow
    batches that remembers one window: nothing is held whole."""
    length = seconds * 1000
    t = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = requests.withColumn("_t", t).withColumn("_b", F.floor(F.col("_t") / (length * RANGE)))
    inside, across = Window.partitionBy(key, "_b").orderBy("_t", order), Window.partitionBy(key).orderBy("_b")
    ends = rows.groupBy(key, "_b").agg(F.max("_t").alias("_last")).withColumn("_before", F.lag("_last").over(across)).drop("_last")
    rows = same_key_join(rows, ends, [key, "_b"])
    gap = F.col("_t") - F.coalesce(F.lag("_t").over(inside), F.col("_before")) >= length
    rows = rows.withColumn("_open", F.when(F.coalesce(gap, F.lit(True)), F.col("_t")))
    opened = rows.groupBy(key, "_b").agg(F.max("_open").alias("_last")).withColumn("_carried", F.max("_last").over(across.rowsBetween(Window.unboundedPreceding, -1))).drop("_last")
    rows = same_key_join(rows, opened, [key, "_b"])
    rows = rows.withColumn("_segment", F.coalesce(F.max("_open").over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("_carried")))
    columns = requests.columns
    names = [*columns, "_segment", "_t"]
    at_key = names.index(key)
    schema = StructType([*requests.schema.fields, StructField("_start", LongType()), StructField("denied", BooleanType())])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, start, n = None, 0, 0
        for b in batches:
            starts, denied = [], []
            for k, segment, t in zip(*(b.column(i).to_pylist() for i in (at_key, len(names) - 2, len(names) - 1)), strict=True):
                if now != (k, segment) or t >= start + length:
                    now, start, n = (k, segment), t, 0
                n += 1
                starts.append(start)
                denied.append(n > limit)
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(starts, pa.int64()), pa.array(denied, pa.bool_())], names=[*columns, "_start", "denied"])

    # segments are whole in a partition and in order there, so a hot key's segments spread over all tasks
    placed = rows.select(*names).repartition(key, "_segment").sortWithinPartitions(key, "_segment", "_t", order)
    return placed.mapInArrow(windows, schema).withColumn("window_start", F.timestamp_millis("_start")).drop("_start")


def scores_on(changes: DataFrame, now: str, by: str = "user_id") -> DataFrame:
    """by, date and score as score_replay gives, from the rows of a stream of scores (live.score_changes).

    The last row of a day has the score at its end. From there on each day without a loss gives DAILY_GAIN, so any later
    day's score follows from the last row before it; no event is looked at again."""
    today = F.datediff(F.lit(now).cast("timestamp").cast("date"), F.lit("1970-01-01"))
    days = changes.where(F.col("day") <= today).groupBy(by, "day").agg(F.max_by(F.struct("score", "leaked"), F.struct("at", "place")).alias("l"), F.min("first").alias("first"))
    closed = F.when((F.col("day") > F.col("first")) & (F.col("day") < today) & (F.col("l.leaked") == 0), F.least(F.lit(FULL), F.col("l.score") + DAILY_GAIN)).otherwise(F.col("l.score"))
    until = F.lead("day").over(Window.partitionBy(by).orderBy("day"))  # days with rows, of which a user has few
    spans = days.select(by, "day", "first", closed.alias("score"), F.coalesce(until - 1, today).alias("until"))
    spans = spans.where(F.col("until") >= today - (SCORE_DAYS - 1)).select(by, "score", "day", F.explode(F.sequence(F.greatest("day", today - (SCORE_DAYS - 1)), F.col("until"))).alias("on"))
    later = F.least(F.lit(FULL), F.col("score") + DAILY_GAIN * (F.col("on") - F.col("day") - (F.col("on") == today).cast("int")))
    known = spans.select(by, F.col("on"), F.when(F.col("on") == F.col("day"), F.col("score")).otherwise(later).cast("bigint").alias("score"))
    early = days.groupBy(by).agg(F.min("day").alias("first")).where(F.col("first") > today - (SCORE_DAYS - 1))
    early = early.select(by, F.explode(F.sequence(today - (SCORE_DAYS - 1), F.col("first") - 1)).alias("on"), F.lit(FULL).cast("bigint").alias("score"))
    return known.unionByName(early).select(by, F.date_add(F.lit("1970-01-01").cast("date"), F.col("on").cast("int")).cast("string").alias("date"), "score")
