"""Placeholders, redaction, approvals and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import last_after, mask_value, prefix_of
from ..plans.order import numbered_within


def placeholder(type_: Column, value: Column, n: Column) -> Column:
    """PREFIX_n; an email address keeps its domain."""
    return F.concat(prefix_of(type_), F.lit("_"), n.cast("string"), F.when(type_ == "EMAIL", F.concat(F.lit("@"), last_after(value, "@"))).otherwise(""))


def allocate(findings: DataFrame, existing: DataFrame | None = None, conversation: str = "conversation_id") -> DataFrame:
    """conversation, type, key, n, placeholder: one for each value of a conversation, counted by type in reading order.

    findings: exploded, with seq and start. existing: what was given out before; its numbers are continued. Rows that
    the user always allows get none. One grouping by conversation, type and key; places are counted by ranges of seq, so a
    conversation of any size is numbered by many tasks."""
    wanted = findings.where("not allowlisted")
    first = wanted.groupBy(conversation, "type", "key").agg(F.min(F.struct("seq", "start", "value")).alias("first"))
    most = F.lit(0)
    if existing is not None:
        first = first.join(existing.select(conversation, "type", "key"), [conversation, "type", "key"], "left_anti")
        top = existing.groupBy(conversation, "type").agg(F.max("n").alias("_most"))
        first = first.join(top, [conversation, "type"], "left")
        most = F.coalesce("_most", F.lit(0))
    first = numbered_within(first.withColumn("seq", F.col("first.seq")).withColumn("start", F.col("first.start")), [conversation, "type"], ["seq", "start"], "_place")
    n = most + F.col("_place")
    new = first.select(conversation, "type", "key", n.cast("int").alias("n"), placeholder(F.col("type"), F.col("first.value"), n).alias("placeholder"))
    return new if existing is None else existing.select(new.columns).unionByName(new)


def redacted(text: Column, findings: Column) -> Column:
    """The text with each finding replaced. findings: array of start, end, value, replacement, without overlaps; a slice
    that is not its value, or an overlap, is an error."""
    ordered = F.array_sort(findings, lambda a, b: a["start"] - b["start"])

    def step(acc: Column, f: Column) -> Column:
        wrong = (f["start"] < acc["at"]) | (f["end"] <= f["start"]) | (F.substring(text, f["start"] + 1, f["end"] - f["start"]) != f["value"])
        put = F.concat(acc["out"], F.substring(text, acc["at"] + 1, f["start"] - acc["at"]), f["replacement"])
        return F.struct(F.when(wrong, F.raise_error("findings overlap or don't fit their text").cast("int")).otherwise(f["end"]).alias("at"), put.alias("out"))

    return F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))


def redact(detected: DataFrame, placeholders: DataFrame, conversation: str = "conversation_id") -> DataFrame:
    """seq, conversation and redacted text of each message. Findings meet their placeholders by a join on conversation,
    type and key; messages without findings are not shuffled for it."""
    found = detected.select("seq", conversation, "text", F.filter("findings", lambda f: ~f["allowlisted"]).alias("fs"))
    rows = found.where(F.size("fs") > 0).select("seq", conversation, F.explode("fs").alias("f")).select("seq", conversation, F.col("f.type").alias("type"), F.col("f.key").alias("key"), "f")
    edits = rows.join(placeholders.select(conversation, "type", "key", "placeholder"), [conversation, "type", "key"])
    edits = edits.groupBy("seq", conversation).agg(F.collect_list(F.struct(F.col("f.start").alias("start"), F.col("f.end").alias("end"), F.col("f.value").alias("value"), F.col("placeholder").alias("replacement"))).alias("edits"))
    changed = found.where(F.size("fs") > 0).join(edits, ["seq", conversation]).select("seq", conversation, redacted(F.col("text"), F.col("edits")).alias("text"))
    return changed.unionByName(found.where(F.size("fs") == 0).select("seq", conversation, "text"))


def split_for_prompt(findings: DataFrame, placeholders: DataFrame) -> DataFrame:
    """Findings to ask about and those always allowed (column asked); values that are placeholders themselves are left out."""
    known = placeholders.select(F.lower("placeholder").alias("_p")).distinct()
    return findings.join(known, F.lower("value") == F.col("_p"), "left_anti").withColumn("asked", ~F.col("allowlisted"))


def merged_placeholders(current: DataFrame, incoming: DataFrame, conversation: str = "conversation_id") -> DataFrame:
    """Both maps together; an error where a key would change its placeholder, or a placeholder serve two keys."""
    both = current.unionByName(incoming).distinct()
    by_key, by_value = Window.partitionBy(conversation, "type", "key"), Window.partitionBy(conversation, "placeholder")
    clash = (F.count(F.lit(1)).over(by_key) > 1) | (F.count(F.lit(1)).over(by_value) > 1)
    checked = F.when(clash, F.raise_error("a placeholder would change").cast("string")).otherwise(F.col("placeholder"))
    return both.withColumn("_checked", checked).withColumn("placeholder", F.col("_checked")).drop("_checked")


def approvals(changes: DataFrame, conversation: str = "conversation_id") -> DataFrame:
    """The values approved in each conversation after all changes (value, added, seq): the last change of a value counts."""
    last = changes.groupBy(conversation, "value").agg(F.max_by("added", "seq").alias("added"))
    return last.where("added").select(conversation, "value")


def review_payload(findings: DataFrame, placeholders: DataFrame, dimension: DataFrame, conversation: str = "conversation_id") -> DataFrame:
    """What a user sees of each finding: label, masked value and the placeholder that would stand for it."""
    rows = findings.join(F.broadcast(dimension.select("type", "label")), "type")  # one row for each type and topic
    rows = rows.join(placeholders.select(conversation, "type", "key", "placeholder"), [conversation, "type", "key"], "left")
    return rows.select(conversation, "seq", "type", "label", mask_value(F.col("type"), F.col("value")).alias("masked"), "placeholder", "start")


def disclosure(findings: DataFrame, placeholders: DataFrame, conversation: str = "conversation_id") -> DataFrame:
    """Findings with action: allowlisted, renamed where a placeholder took its place, else as_is."""
    known = placeholders.select(conversation, "type", "key", F.lit(True).alias("_renamed"))
    rows = findings.join(known, [conversation, "type", "key"], "left")
    return rows.withColumn("action", F.when(F.col("allowlisted"), "allowlisted").when(F.col("_renamed"), "renamed").otherwise("as_is")).drop("_renamed")
