"""Chat exports: files and archives to one table of messages.

seq is the place of a message: struct of file, row and node. Its order is the order of the input, whatever the partitions."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dialect import WS, trimmed
from ..functions.scalars import epoch_time, fnv1a, iso_time, json_string, url_component

# Fixed values.
MOST_BYTES = 200 * 1024 * 1024
INVALID = "no supported chat messages found"
MANIFEST = "this file lists downloads and holds no messages"
PRODUCTS = ("Gemini Apps", "Gemini", "Bard")
PROMPTED = rf"(?i)\APrompted[{WS}]+"
LONGEST, MOST_MESSAGES = 100_000, 20_000
# End of fixed values.

_ROW = "conversation_id string, id string, title string, create_time string, mapping map<string,string>, uuid string, created_at string, chat_messages array<string>, products array<string>, time string, titleUrl string"
_NODE = "id string, message struct<id:string,author:struct<role:string>,create_time:string,content:struct<content_type:string,parts:string>>"
_TURN = "uuid string, id string, sender string, text string, created_at string, content array<struct<type:string,text:string>>"


def read_exports(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """file and content of each JSON file, and of each JSON entry at any depth of each archive; larger ones are an error.

    Archives are opened by tasks, one entry at a time."""
    files = spark.read.format("binaryFile").load(path).where(F.lower("path").rlike(r"\.(json|zip)\z"))
    checked = F.when(F.col("length") > most_bytes, F.raise_error("an export is larger than 200 MB").cast("string")).otherwise(F.col("path"))
    files = files.select(checked.alias("file"), "content")

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["file"], b["content"], strict=True):
                total = 0
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for entry in z.infolist():
                        if entry.is_dir() or not entry.filename.lower().endswith(".json"):
                            continue
                        total += entry.file_size
                        if total > most_bytes:
                            raise ValueError("an expanded export is larger than 200 MB")
                        yield pd.DataFrame({"file": [f"{name}!{entry.filename}"], "content": [z.read(entry).decode("utf-8", "replace")]})

    plain = files.where(F.lower("file").endswith(".json")).select("file", F.col("content").cast("string").alias("content"))
    return plain.unionByName(files.where(F.lower("file").endswith(".zip")).mapInPandas(expand, "file string, content string"))


def rows_of(exports: DataFrame) -> DataFrame:
    """A row for each conversation or activity: the elements of the array, of its `conversations`, or the object itself."""
    v = F.try_parse_json("content")
    whole = F.try_variant_get(v, "$", "array<variant>")
    inner = F.try_variant_get(v, "$.conversations", "array<variant>")
    own = F.when(F.try_variant_get(v, "$.chat_messages", "array<variant>").isNotNull(), F.col("content"))
    source = F.when(whole.isNotNull(), F.col("content")).when(inner.isNotNull(), F.get_json_object("content", "$.conversations")).when(own.isNotNull(), F.concat(F.lit("["), own, F.lit("]")))
    # text, not a variant, is taken apart: a variant would sort the nodes of a conversation by their names
    parsed = F.from_json(source, f"array<struct<{_ROW.replace(' ', ':').replace(',:', ',')}>>")
    return exports.select("file", F.posexplode(parsed).alias("row", "r")).select("file", "row", "r.*")


def _joined_strings(parts: Column) -> Column:
    values = F.try_variant_get(F.try_parse_json(parts), "$", "array<variant>")
    strings = F.filter(F.transform(values, lambda x: F.struct(F.schema_of_variant(x).alias("k"), F.try_variant_get(x, "$", "string").alias("s"))), lambda x: x["k"] == "STRING")
    return F.array_join(F.transform(strings, lambda x: x["s"]), "\n")


def tree_messages(rows: DataFrame) -> DataFrame:
    """Messages of exports whose conversations map node ids to nodes."""
    nodes = rows.withColumn("cid", F.coalesce("conversation_id", "id")).where(F.col("mapping").isNotNull() & (F.col("cid") != ""))
    nodes = nodes.select("file", "row", "cid", "title", "create_time", F.posexplode(F.map_entries("mapping")).alias("node", "e"))
    nodes = nodes.withColumn("n", F.from_json("e.value", _NODE)).withColumn("m", F.col("n.message"))
    text = trimmed(_joined_strings(F.col("m.content.parts")))
    good = F.col("m.author.role").isin("user", "assistant") & F.col("m.content.content_type").isin("text", "multimodal_text")
    return nodes.where(good).select(
        F.struct("file", "row", "node").alias("seq"),
        F.lit("chatgpt").alias("provider"),
        F.col("cid").alias("conversation_id"),
        F.coalesce("title", F.lit("Untitled chat")).alias("conversation_title"),
        F.concat(F.lit("https://chatgpt.com/c/"), url_component(F.col("cid"))).alias("conversation_url"),
        F.coalesce("m.id", "n.id").alias("message_id"),
        F.col("m.author.role").alias("role"),
        epoch_time(F.coalesce("m.create_time", "create_time")).alias("created_at"),
        text.alias("text"),
    ).where("message_id <> '' and text <> ''")


def list_messages(rows: DataFrame) -> DataFrame:
    """Messages of exports whose conversations hold a list of turns."""
    turns = rows.withColumn("cid", F.coalesce("uuid", "id")).where(F.col("mapping").isNull() & F.col("cid").isNotNull() & F.col("chat_messages").isNotNull())
    turns = turns.select("file", "row", "cid", "created_at", F.posexplode("chat_messages").alias("node", "j")).withColumn("m", F.from_json("j", _TURN))
    blocks = F.transform(F.filter(F.col("m.content"), lambda b: (b["type"] == "text") & (b["text"] != "")), lambda b: b["text"])
    text = F.when(trimmed(F.col("m.text")) != "", F.col("m.text")).otherwise(F.coalesce(F.array_join(blocks, "\n"), F.lit("")))
    return turns.where(F.col("m.sender").isin("human", "assistant")).select(
        F.struct("file", "row", "node").alias("seq"),
        F.lit("claude").alias("provider"),
        F.concat(F.lit("claude:"), "cid").alias("conversation_id"),
        F.lit("Claude conversation").alias("conversation_title"),
        F.concat(F.lit("https://claude.ai/chat/"), url_component(F.col("cid"))).alias("conversation_url"),
        F.coalesce("m.uuid", "m.id", F.col("node").cast("string")).alias("message_id"),
        F.when(F.col("m.sender") == "human", "user").otherwise("assistant").alias("role"),
        iso_time(F.coalesce("m.created_at", "created_at")).alias("created_at"),
        text.alias("text"),
    ).where(trimmed(F.col("text")) != "")


def activity_messages(rows: DataFrame) -> DataFrame:
    """Prompts of activity records; others of their titles are no prompts."""
    some = rows.where(F.col("mapping").isNull() & F.col("chat_messages").isNull() & F.exists("products", lambda p: p.isin(*PRODUCTS)) & F.col("time").isNotNull() & F.col("title").rlike(PROMPTED))
    some = some.withColumn("text", trimmed(F.regexp_replace("title", PROMPTED, ""))).withColumn("mark", fnv1a(F.col("text")))
    url = F.regexp_extract(F.coalesce("titleUrl", F.lit("")), r"\A(https://gemini\.google\.com/app/[a-zA-Z0-9_-]+)(?:[?#].*)?\z", 1)
    some = some.withColumn("url", url)
    return some.select(
        F.struct("file", "row", F.lit(0).alias("node")).alias("seq"),
        F.lit("gemini").alias("provider"),
        F.concat(F.lit("gemini:"), F.when(F.col("url") != "", F.col("url")).otherwise(F.concat(F.lit("activity:"), "time", F.lit(":"), "mark"))).alias("conversation_id"),
        F.lit("Gemini activity").alias("conversation_title"),
        F.when(F.col("url") != "", F.col("url")).otherwise("https://myactivity.google.com/product/gemini").alias("conversation_url"),
        F.concat(F.lit("["), json_string(F.col("time")), F.lit(","), json_string(F.col("mark")), F.lit("]")).alias("message_id"),
        F.lit("user").alias("role"),
        iso_time(F.col("time")).alias("created_at"),
        "text",
    ).where("text <> ''")


def first_of_each(messages: DataFrame) -> DataFrame:
    """Of a message that one file holds twice, the first."""
    w = Window.partitionBy("seq.file", "conversation_id", "message_id").orderBy("seq")
    return messages.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def last_at_first_place(messages: DataFrame) -> DataFrame:
    """Of a message that several files hold, the last one, at the place of the first."""
    keys = ["conversation_id", "message_id"]
    rest = [c for c in messages.columns if c not in (*keys, "seq")]
    whole = messages.groupBy(*keys).agg(F.min("seq").alias("seq"), F.max_by(F.struct(*rest), F.col("seq")).alias("v"))
    return whole.select("seq", *keys, "v.*").select(messages.columns)


def messages_of(rows: DataFrame) -> DataFrame:
    """Messages of the rows of all dialects, each once."""
    found = tree_messages(rows).unionByName(list_messages(rows)).unionByName(activity_messages(rows))
    return last_at_first_place(first_of_each(found))


def parse_exports(exports: DataFrame, strict: bool = False) -> DataFrame:
    """Messages of all exports, each once. strict: exports without any message are an error, a manifest of its own kind."""
    messages = messages_of(rows_of(exports))
    if not strict:
        return messages
    manifest = exports.agg(F.coalesce(F.bool_or(is_manifest(F.col("content"))), F.lit(False)).alias("manifest"))
    empty = messages.agg(F.count(F.lit(1)).alias("n")).crossJoin(manifest).where("n = 0")  # one row each
    return messages.unionByName(failing(empty, messages, F.when(F.col("manifest"), MANIFEST).otherwise(INVALID)))


def failing(bad: DataFrame, like: DataFrame, message: str | Column) -> DataFrame:
    """A table with the columns of `like` that has no rows where bad has none, and else is an error."""
    told = F.lit(message) if isinstance(message, str) else message
    return bad.select(*[F.raise_error(told).cast(f.dataType).alias(f.name) for f in like.schema.fields])


def is_manifest(content: Column) -> Column:
    return F.coalesce(F.try_variant_get(F.try_parse_json(content), "$.data_files", "array<variant>").isNotNull(), F.lit(False))


def ledger_messages(messages: DataFrame, longest: int | None = LONGEST, most: int | None = MOST_MESSAGES) -> DataFrame:
    """The second dialect of the same files, for the ledger: user messages under plain ids, by time. A message over
    longest is an error, and so is a file of more messages than most."""
    rows = messages.where("role = 'user'")
    bare = F.regexp_replace(F.regexp_replace("conversation_id", r"\A(?:claude|gemini):", ""), r"\Ahttps://gemini\.google\.com/app/", "")
    text = F.col("text")
    if longest is not None:
        text = F.when(F.char_length(text) > longest, F.raise_error("a message is too large to scan").cast("string")).otherwise(text)
    out = rows.select("seq", F.col("provider").alias("site"), bare.alias("conversation_id"), "message_id", text.alias("text"), F.col("created_at").alias("ts"))
    if most is not None:
        over = rows.groupBy("seq.file").count().where(F.col("count") > most)
        out = out.unionByName(failing(over, out, f"a file holds more than {most} messages"))
    return out.orderBy("ts", "seq")


def manifest_links(exports: DataFrame) -> DataFrame:
    """file, filename and url of the downloads that a manifest names: conversations, by https, at the provider's host."""
    files = F.from_json("content", "struct<data_files:array<struct<category:string,filename:string,export_url:string>>>")["data_files"]
    rows = exports.select("file", F.explode(files).alias("d")).select("file", "d.category", "d.filename", F.col("d.export_url").alias("url"))
    host = F.try_parse_url("url", F.lit("HOST"))
    return rows.where((F.col("category") == "conversations") & F.col("url").startswith("https://") & (host == "claude.ai") & F.try_parse_url("url", F.lit("USERINFO")).isNull()).select("file", "filename", "url")


def to_list_export(messages: DataFrame) -> DataFrame:
    """One JSON object for each conversation, in the list dialect: turns by time."""
    turn = F.struct(F.col("message_id").alias("uuid"), F.when(F.col("role") == "user", "human").otherwise("assistant").alias("sender"), F.col("text"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created_at"))
    grouped = messages.groupBy("conversation_id").agg(F.min_by("conversation_title", "seq").alias("name"), F.min("created_at").alias("created_at"), F.array_sort(F.collect_list(F.struct("created_at", "seq", turn.alias("t")))).alias("ts"))
    return grouped.select("conversation_id", F.to_json(F.struct(F.col("conversation_id").alias("uuid"), "name", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created_at"), F.transform("ts", lambda x: x["t"]).alias("chat_messages"))).alias("content"))
