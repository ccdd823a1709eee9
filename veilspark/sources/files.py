"""Text of documents, sample events, and tables as messages."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ACTIONS, ENTITY_TYPES, SITES, SOURCES

# Fixed values.
MOST_BYTES = 15 * 1024 * 1024
PLAIN = "txt md csv tsv json jsonl xml html htm log yaml yml toml ini env py js ts jsx tsx java c cpp h cs go rs rb php sql sh".split()
_DOCX = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """The paragraphs of a word-processing document, one to a line."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_DOCX}t")) for p in root.iter(f"{_DOCX}p"))


def extract(files: DataFrame, pdf_pages: Callable[[bytes], list[str]] | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """path, status (ok, empty, unsupported, error), text and reason of files (path, length, content).

    pdf_pages gives the pages of a PDF, and raises PermissionError where it needs a password; without it PDFs are
    unsupported. No exception leaves a file's row."""

    def one(path: str, length: int, content: bytes) -> tuple[str, str | None, str | None]:
        kind = path.rpartition(".")[2].lower()
        if length > most_bytes:
            return "unsupported", None, "larger than 15 MB"
        try:
            if kind in PLAIN:
                text = content.decode("utf-8", "replace")
            elif kind == "docx":
                text = docx_text(content)
            elif kind == "pdf" and pdf_pages is not None:
                pages = pdf_pages(content)
                text = "\n\n".join(pages)
                if len(pages) > 1 and len(re.sub(r"\s", "", text)) < 20:
                    return "unsupported", None, "scanned"
            else:
                return "unsupported", None, "unknown kind"
        except PermissionError:
            return "unsupported", None, "password"
        except Exception:  # a file that can't be read is a result, not a failure of the job
            return "error", None, "can't be read"
        return ("ok", text, None) if text.strip() else ("empty", None, "no text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *one(p, n, c)) for p, n, c in zip(b["path"], b["length"], b["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "status", "text", "reason"])

    return files.select("path", "length", "content").mapInPandas(run, "path string, status string, text string, reason string")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it is read from few files that are small together.

    A file of one row group is one task whatever its size, so work that costs much more than reading is shared out by a
    round-robin exchange first. Tables of as many files as there are cores, or large enough for a split of the usual size
    for each core, are left as they are; so is what has no files of its own, or has been dealt out already."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if not 0 < len(df.inputFiles()) < cores:
        return df
    plan = df._jdf.queryExecution().analyzed()
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    large = int(str(plan.stats().sizeInBytes())) >= cores * split
    return df if large or "Repartition" in plan.toString() else df.repartition(cores)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share, spark.checkpoint.dir of the session.

    Only in a local session without that setting, as in tests, it is in a temporary folder; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='veilspark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again, so that it is made once and its size is known."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sample_events(spark: SparkSession, end: str = "2024-01-31 00:00:00", n: int = 60) -> DataFrame:
    """n disclosure events, eight hours apart up to end, cycling through types, sites, sources (three of each) and actions
    (renamed twice as often as the others)."""
    cycle = lambda values, each=1: F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col("id") / each) % len(values) + 1).cast("int"))
    ts = F.timestamp_millis(F.unix_millis(F.lit(end).cast("timestamp")) - (n - 1 - F.col("id")) * 8 * 3_600_000)
    actions = (ACTIONS[0], *ACTIONS)
    return spark.range(n).select(F.col("id").alias("event_id"), cycle(ENTITY_TYPES).alias("type"), cycle(SITES).alias("site"), cycle(SOURCES, 3).alias("source"), cycle(actions).alias("action"), ts.alias("ts"))


def documents_as_messages(documents: DataFrame) -> DataFrame:
    """Documents as user messages: the source is the conversation."""
    return documents.select(
        F.col("doc_id").alias("seq"), F.lit("chatgpt").alias("provider"), F.col("source").alias("conversation_id"), F.lit("").alias("conversation_title"), F.lit(None).cast("string").alias("conversation_url"),
        F.col("doc_id").cast("string").alias("message_id"), F.lit("user").alias("role"),
        F.when(F.col("doc_id") % 7 != 0, F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") % 400 * 86_400)).alias("created_at"), "text",
    )


def conversations_as_messages(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.struct("conv_id", "turn").alias("seq"), F.lit("chatgpt").alias("provider"), F.col("conv_id").cast("string").alias("conversation_id"), F.lit("").alias("conversation_title"), F.lit(None).cast("string").alias("conversation_url"),
        F.col("turn").cast("string").alias("message_id"), "role", F.lit(None).cast("timestamp").alias("created_at"), "text",
    )


def events_as_disclosures(events: DataFrame) -> DataFrame:
    """Events as disclosures: the kind of the event gives the action, k of its properties the type of what was shared."""
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    types = F.array(*map(F.lit, ENTITY_TYPES))
    action = F.when(F.col("event_type").isin("error", "purchase"), "as_is").when(F.col("event_type") == "click", "renamed").otherwise("allowlisted")
    return events.select("event_id", "user_id", "ts", F.element_at(types, F.pmod(k, F.lit(len(ENTITY_TYPES))) + 1).alias("type"), F.element_at(F.array(*map(F.lit, SITES)), (F.col("event_id") % 3 + 1).cast("int")).alias("site"), F.element_at(F.array(*map(F.lit, SOURCES)), (F.col("event_id") % 3 + 1).cast("int")).alias("source"), action.alias("action"))
