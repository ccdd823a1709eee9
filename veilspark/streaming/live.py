"""Structured Streaming: the event log, the idempotent ledger, totals, sends that are confirmed, limits and caches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalars import cost_of
from ..plans.ledger import DAILY_GAIN, FULL, SCORE_DAYS, valid_events
from ..sources.files import scratch
from ..sources.versions import Versions

_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Fixed values, in milliseconds.
SEND_EXPIRY, GATE_EXPIRY, FRESH, FAILED = 15_000, 600_000, 24 * 3_600_000, 60_000
#: Groups of keys without timers. A stream keeps to it, as its states lie by bucket.
BUCKETS = 1 << 15


def event_stream(spark: SparkSession, path: str, schema: str, files_a_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def ledger_stream(records: DataFrame, late: str | None = None) -> DataFrame:
    """Each record once by id. Without `late` nothing is ever forgotten, as a ledger needs; with it (a watermark on ts)
    the state is bounded, and a copy that comes later than that is taken again."""
    return records.dropDuplicates(["id"]) if late is None else records.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


def live_totals(events: DataFrame, by: str = "user_id", since: str | None = None) -> DataFrame:
    """Running totals of each user; for output mode update or complete."""
    shared = F.col("action") == "as_is"
    return valid_events(events, since=since).groupBy(by).agg(
        F.count(F.lit(1)).alias("findings"), F.count_if(shared).alias("shared"), F.count_if(F.col("action") == "renamed").alias("protected"), F.coalesce(F.sum(F.when(shared, cost_of(F.col("type")))), F.lit(0)).alias("cost")
    )


def fresh_results(events: DataFrame, late: str | None = None) -> DataFrame:
    """editor, version and findings of results that are not stale. events: editor, kind (edit, result), version, findings, ts.

    A result counts only if no edit of a later version came before it."""

    def step(row: dict, held):
        newest = held[0] if held else -1
        if row["kind"] == "edit":
            return None, (max(newest, row["version"]), row["_us"] // 1000)
        return ((row["version"], row["findings"]) if row["version"] >= newest else None), held

    return _stateful(events.select("editor", "kind", "version", "findings", "ts"), "editor", step, "version long, findings string", "newest long, at long", "string", late, lambda held: held[1] + GATE_EXPIRY)


def debounced(edits: DataFrame, gap: str = "300 milliseconds", late: str = "10 seconds") -> DataFrame:
    """The last text of each burst of edits (editor, version, ts, text)."""
    return edits.withWatermark("ts", late).groupBy("editor", F.session_window("ts", gap)).agg(F.max("version").alias("version"), F.max_by("text", "version").alias("text")).select("editor", "version", "text")


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now, and gives the table of its results.

    Batches are committed to a table beside the checkpoint: each adds its rows, or with mode complete replaces them all."""
    table = Versions(df.sparkSession, f"{checkpoint}-results")

    def write(batch: DataFrame, batch_id: int) -> None:
        if mode == "complete":
            table.replace(batch)
        else:
            table.append(batch, (name, batch_id))

    df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = table.read()
    return df.sparkSession.createDataFrame([], df.schema) if rows is None else rows


def collected(df: DataFrame, mode: str = "append") -> DataFrame:
    """run_available with a checkpoint of its own, below the session's spark.checkpoint.dir."""
    return run_available(df, "collected", scratch(df.sparkSession, "stream"), mode)


def logged(events: DataFrame) -> DataFrame:
    """Events with the time at which they came in place of their own."""
    return events.withColumn("ts", F.current_timestamp())


def appended(target: str, stream: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows of a stream without repeats, as ledger_stream gives, go to the table at `target`.

    A batch that is run again adds nothing, by its number; nothing of the table is read."""
    return lambda batch, batch_id: Versions(batch.sparkSession, target).append(batch, (stream, batch_id)) and None


def upsert(target: str, keys: list[str], stream: str = "upsert", buckets: int = 256) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows whose key isn't in the table at `target` are added. A batch that is run again adds nothing.

    Rows lie in buckets by their key, and a batch reads the keys of its own buckets only."""

    def write(batch: DataFrame, batch_id: int) -> None:
        new = batch.dropDuplicates(keys).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        table = Versions(batch.sparkSession, target)
        held = table.read()
        if held is not None:
            own = [r[0] for r in new.select("bucket").distinct().collect()]  # `buckets` at most
            new = new.join(held.where(F.col("bucket").isin(own)).select(*keys), keys, "left_anti")
        table.append(new, (stream, batch_id), by=("bucket",))

    return write


def compacted(spark: SparkSession, target: str, most: int, by: str = "ts") -> None:
    """The newest `most` rows of the table at `target`, in one part."""
    Versions(spark, target).compact(lambda rows: rows.orderBy(F.desc(by)).limit(most))


class _Keyed(StatefulProcessor):
    """Rows of a key in the order of time, with one state between them that a timer ends."""

    def __init__(self, step: Callable, state: str, expiry: Callable, expired: Callable, names: list[str]):
        self.step, self.state, self.expiry, self.expired, self.names = step, state, expiry, expired, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.state)

    def _made(self, key: tuple, values: tuple) -> Row:
        return Row(**dict(zip(self.names, (key[0], *values), strict=True)))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        now = self.held.get()
        for row in sorted(rows, key=lambda r: r["_us"]):  # a batch's rows of one key
            made, now = self.step(row.asDict(), now)
            if made is not None:
                yield self._made(key, made)
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        if now is None:
            self.held.clear()
            return
        self.held.update(now)
        self.handle.registerTimer(max(self.expiry(now), timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        made = self.expired(tuple(self.held.get())) if self.held.exists() else None
        self.held.clear()
        if made is not None:
            yield self._made(key, made)

    def close(self) -> None:
        pass


class _Bucketed(StatefulProcessor):
    """Rows of a bucket of keys, each key's in the order of time, with a state of each key between them.

    What a group costs by itself (a batch of results, the calls that set its key) is shared by the bucket's keys; a key
    costs one call where its state has changed, and one to read it where the bucket has states."""

    def __init__(self, key: str, key_type: str, step: Callable, state: str, names: list[str]):
        self.key, self.key_type, self.step, self.state, self.names = key, key_type, step, state, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", f"{self.key} {self.key_type}", self.state)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        made_row, by_key = Row(*self.names), {}
        for row in rows:  # a batch's rows of one bucket
            by_key.setdefault(row[self.key], []).append(row)
        any_held = self.held.exists()
        for own, some in by_key.items():
            before = now = tuple(self.held.getValue((own,))) if any_held and self.held.containsKey((own,)) else None
            for row in sorted(some, key=lambda r: r["_us"]):
                made, now = self.step(row.asDict(), now)
                if made is not None:
                    yield made_row(own, *made)
            if now is not None and now != before:
                self.held.updateValue((own,), now)
            elif now is None and before is not None:
                self.held.removeKey((own,))

    def close(self) -> None:
        pass


def _stateful(events: DataFrame, key: str, step: Callable, output: str, state: str, key_type: str, late: str | None = None, expiry: Callable = lambda held: None, expired: Callable = lambda held: None) -> DataFrame:
    """Rows of a key in the order of ts, with a state between them: step(row, state) -> (output or None, state).
    A row's time is in _us, microseconds.

    late: how late rows may come. With it the state ends by itself once the stream's time has passed expiry(state), in
    milliseconds, and expired(state) is put out; so no state stays for ever. Without it, it ends at the key's next row,
    no key needs a timer, and keys are grouped in BUCKETS buckets: as many groups at most, however many keys.
    State is in RocksDB, on disk, not in an executor's heap."""
    spark = events.sparkSession
    if spark.conf.get(_STORE, None) != _ROCKS:
        spark.conf.set(_STORE, _ROCKS)
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("_us", F.unix_micros("ts"))
    names = [key, *(x.strip().split()[0] for x in output.split(","))]
    if late is None:
        dealt = timed.drop("ts").withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
        return dealt.groupBy("_bucket").transformWithState(_Bucketed(key, key_type, step, state, names), f"{key} {key_type}, {output}", "append", "none")
    processor = _Keyed(step, state, expiry, expired, names)
    return timed.withWatermark("ts", late).groupBy(key).transformWithState(processor, f"{key} {key_type}, {output}", "append", "eventTime")


def confirmed_sends(events: DataFrame, late: str | None = None) -> DataFrame:
    """draft_id, conversation, prompt and sent_at of drafts that were sent.

    events: draft_id, kind (draft, edit, move, bubble), conversation, text, bubbles, ts. A draft is sent when more
    bubbles hold its text than when it was checked; an edit to another text, a move to another conversation, or 15
    seconds end the waiting. Times are the events' own."""

    def step(row: dict, held):
        t = row["_us"] // 1000
        text = " ".join((row["text"] or "").split())
        if row["kind"] == "draft":
            return None, (row["conversation"], text, int(row["bubbles"]), t + SEND_EXPIRY)
        if held is None:
            return None, None
        conversation, expected, before, expiry = held
        gone = t > expiry or (conversation != "new" and row["conversation"] != conversation)
        if gone or (row["kind"] == "edit" and text and text != expected):
            return None, None
        if row["kind"] == "bubble" and expected in text and int(row["bubbles"]) > before:
            return (row["conversation"], expected, row["_us"]), None
        return None, held

    sent = _stateful(events.select("draft_id", "kind", "conversation", "text", "bubbles", "ts"), "draft_id", step, "conversation string, prompt string, sent_at long", "conversation string, expected string, bubbles long, expiry long", "string", late, lambda held: held[3] + 1)
    return sent.withColumn("sent_at", F.timestamp_micros("sent_at"))


def score_changes(events: DataFrame, by: str = "user_id", order: str = "event_id", late: str | None = None) -> DataFrame:
    """by, day, score, leaked, first, at and place after each event (see ledger.scores_on), from one small state of each
    user: score, first day, last day, whether something leaked on it."""
    rows = valid_events(events).select(F.col(by).cast("string").alias("_by"), "ts", F.col(order).alias("place"), (F.col("action") == "as_is").cast("int").alias("leak"), F.coalesce(cost_of(F.col("type")), F.lit(0)).cast("bigint").alias("cost"))

    def step(row: dict, held):
        day = row["_us"] // 86_400_000_000
        score, first, last, leaked = held or (FULL, day, day, 0)
        if day > last:
            idle = day - last - 1 + (1 if last > first and not leaked else 0)
            score, leaked = min(FULL, score + DAILY_GAIN * idle), 0
        if row["leak"]:
            score, leaked = max(0, score - row["cost"]), 1
        return (day, score, leaked, first, row["_us"], row["place"]), (score, first, day, leaked)

    out = _stateful(rows, "_by", step, "day long, score long, leaked long, first long, at long, place long", "score long, first long, day long, leaked long", "string", late, lambda held: held[2] * 86_400_000 + FRESH * SCORE_DAYS)
    return out.withColumn(by, F.col("_by").cast(events.schema[by].dataType)).drop("_by")


def rate_limits(requests: DataFrame, limit: int, seconds: int = 60, late: str | None = None) -> DataFrame:
    """key, request_id, denied of requests (key, request_id, ts): a window opens at the first request after the last one closed."""

    def step(row: dict, held):
        t = row["_us"] // 1000
        start, n = held if held is not None and t < held[0] + seconds * 1000 else (t, 0)
        return (int(row["request_id"]), n + 1 > limit), (start, n + 1)

    return _stateful(requests.select("key", "request_id", "ts"), "key", step, "request_id long, denied boolean", "start long, n long", "string", late, lambda held: held[0] + seconds * 1000)


def cached_answers(requests: DataFrame, answer: Callable[[str], str | None], late: str | None = None) -> DataFrame:
    """key, request_id, answer, fresh of requests (key, request_id, ts): an answer is kept for a day, a failure (None) for
    a minute; requests at the same time share one call, being rows of one key."""

    def step(row: dict, held):
        t = row["_us"] // 1000
        if held is None or t >= held[1]:
            value = answer(row["key"])
            held = (value if value is not None else "", t + (FRESH if value is not None else FAILED), value is not None)
            return (int(row["request_id"]), held[0], True), held
        return (int(row["request_id"]), held[0], False), held

    return _stateful(requests.select("key", "request_id", "ts"), "key", step, "request_id long, answer string, called boolean", "answer string, until long, good boolean", "string", late, lambda held: held[1])


def pending_reviews(events: DataFrame, late: str | None = None) -> DataFrame:
    """tab, review_id and outcome (decided, replaced, expired) of reviews (tab, review_id, kind open or decide, ts): a new one
    replaces the one before it in its tab, and ten minutes end it."""

    def step(row: dict, held):
        t = row["_us"] // 1000
        if row["kind"] == "open":
            ended = None if held is None else (held[0], "replaced" if t <= held[1] else "expired")
            return ended, (int(row["review_id"]), t + GATE_EXPIRY)
        if held is None or held[0] != int(row["review_id"]):
            return None, held
        return (held[0], "decided" if t <= held[1] else "expired"), None

    return _stateful(events.select("tab", "review_id", "kind", "ts"), "tab", step, "review_id long, outcome string", "review_id long, expiry long", "string", late, lambda held: held[1] + 1, lambda held: (held[0], "expired"))
