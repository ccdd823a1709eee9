"""What several operators share: the shared folder for intermediate tables, and reading inputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import spread

#: A key is hot that has one of so many parts of all rows.
HOT = 1000
#: Whether Spark removes shuffle files when the query that wrote them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer files than cores is shared out over all cores first."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir` of the session.

    Only in a local session without that setting, as in tests, a temporary folder is made and set; on a cluster it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='veilspark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path of its own below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts the lineage, and survives lost executors.

    Shuffle files of the write are of no use once the table is there, so they are removed with its end."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Removes stored tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def joined_once(rows: DataFrame, each: DataFrame, key: str, n: str) -> DataFrame:
    """rows with the columns of each but n, which has one row for each key and n, how many of rows have it.

    Keys of a thousandth of all rows or more, of which there are a thousand at most, are broadcast, so that no task gets
    all rows of a hot key; the rest is shuffled."""
    total = each.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) * HOT >= total
    few, many = each.where(hot).drop(n), each.where(~hot).drop(n)
    keys = few.select(key)
    return rows.join(F.broadcast(few), key).unionByName(rows.join(F.broadcast(keys), key, "left_anti").join(many, key))


def numbered(docs: DataFrame, row: str, name: str) -> tuple[DataFrame, dict[str, str]]:
    """docs written with a number of each row, and what its columns are called there: names that clash with no other."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return stored(docs.toDF(*names.values()).withColumn(row, F.monotonically_increasing_id()), name), names


def restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of numbered under the names of docs."""
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def ascii_lower(c: Column) -> Column:
    """A-Z lowered, every other character kept."""
    return F.translate(c, UPPER, LOWER)


def doc_hash(c: Column) -> Column:
    """crc32 of a document's id as text: splits documents into training and held-out ones."""
    return F.crc32(c.cast("string"))


def thinned(df: DataFrame, key: Column, rows: int, bound: int) -> DataFrame:
    """About `bound` of df's `rows` rows, chosen by a hash of key and so the same at every run; all rows if there are no more."""
    if rows <= bound:
        return df
    million = 1_000_000
    return df.where(F.pmod(F.xxhash64(key, F.lit("thinned")), F.lit(million)) < int(million * bound / rows))
