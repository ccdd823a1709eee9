"""Where results go. No sink but that of redacted text holds a value or a title of an export."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.policy import UNKNOWN, publishable
from .versions import Versions

ANSWERS = "tool_id string, answers array<struct<question_id:string,question:string,answer:string,citations:array<struct<url:string,title:string>>>>, generated_at string, source string"
#: Columns that hold what users wrote; no report may have one of them.
PRIVATE = frozenset({"text", "value", "key", "conversation_title", "sentence"})


def _names(schema) -> set[str]:
    """All names in a schema, those inside structs too."""
    return set(re.findall(r'"name":"([^"]*)"', schema.json()))


def write_report(parts: dict[str, DataFrame], folder: str) -> None:
    """Each part of a report as JSON lines in a folder of its name, in place of what was there."""
    for name, part in parts.items():
        if private := PRIVATE & _names(part.schema):
            raise ValueError(f"{name} would hold {sorted(private)}")
        part.write.mode("overwrite").json(f"{folder}/{name}")


def redacted_name(path: Column) -> Column:
    """The name of a file's redacted text."""
    return F.concat(F.regexp_replace(F.regexp_extract(path, r"([^/]*)\z", 1), r"\.[^.]+\z", ""), F.lit("-redacted.txt"))


def write_redacted(redacted: DataFrame, folder: str, path: str = "path", text: str = "text") -> None:
    """The redacted text of each file, in a folder of the name that the redacted file has."""
    named = redacted.select(redacted_name(F.col(path)).alias("file"), F.col(text).alias("value"))
    named.write.mode("overwrite").partitionBy("file").option("lineSep", "\n").text(folder)


def replace_table(rows: DataFrame, target: str) -> None:
    """All rows of a table at once: a job that fails, or is killed, or reads the table itself, leaves the old rows."""
    Versions(rows.sparkSession, target).replace(rows)


def read_table(spark: SparkSession, target: str) -> DataFrame | None:
    """The rows that replace_table committed last."""
    return Versions(spark, target).read()


def write_answers(answers: DataFrame, generated_at: str, target: str) -> None:
    """The answers (tool_id, question_id, question, answer, citations) of tools that have four good ones, as one JSON
    object for each tool; tools without keep what was there. Readers see the old answers or the new ones."""
    good = publishable(answers.where(~F.col("answer").startswith("SAMPLE"))).groupBy("tool_id").agg(F.array_sort(F.collect_list(F.struct("question_id", "question", "answer", "citations"))).alias("answers"))
    new = good.select("tool_id", "answers", F.lit(generated_at).alias("generated_at"), F.lit("fallback").alias("source"))
    table = Versions(answers.sparkSession, target, "json")
    table.replace(new.unionByName(table.read(ANSWERS).join(good.select("tool_id"), "tool_id", "left_anti")))


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """tool_id, question_id, question, answer and citations of stored answers; a tool without four different questions is an error."""
    table = Versions(spark, path, "json")
    rows = table.read(ANSWERS) if table.current()["parts"] else spark.read.schema(ANSWERS).json(path)  # or files that came with the program
    four = F.size(F.array_distinct(F.transform("answers", lambda a: a["question_id"]))) == 4
    checked = F.when(F.coalesce(four & (F.size("answers") == 4), F.lit(False)), True).otherwise(F.raise_error("stored answers are not as they should be").cast("boolean"))
    return rows.where(checked).select("tool_id", F.explode("answers").alias("a")).select("tool_id", "a.*").withColumn("known", F.col("answer") != UNKNOWN)
