"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Word separators: blank, tab to carriage return.
WHITE = "\\x20\\x09-\\x0D"
#: Copies of one row that a task makes at once.
RUN = 20_000
#: Kept rows that a task reads at least, where there are as many.
READ_ROWS = 10_000


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors share: the one in ``spark.checkpoint.dir``. Only
    where the session names none and is a local one, as in tests, a folder of its own is made."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tillwise-llm-"))
    return context.getCheckpointDir()


def keep(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder; later steps read that."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def keep_few(df: DataFrame) -> DataFrame:
    """As ``keep``, where few rows may lie in many partitions: later steps read as many in a task as hold
    about ``READ_ROWS``, so the tasks grow with the rows; fewer rows than that are read by one task."""
    kept = keep(df)
    return kept.coalesce(kept.count() // READ_ROWS + 1)


def store(df: DataFrame) -> DataFrame:
    """As ``keep``, for many rows: written as Parquet, which is columnar and compressed."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_key(text: str = "text") -> Column:
    """Tells rows apart that have one doc_id and different texts."""
    return F.xxhash64(F.col(text))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column; names differ by more than case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def expanded(df: DataFrame, n: str) -> DataFrame:
    """Each row as often as its column ``n`` says, which gives way to ``copy``, a running number
    from 0. A row with many copies is cut into runs that are dealt over the tasks."""
    few = df.where(F.col(n) <= RUN).withColumn("copy", F.explode(F.expr(f"sequence(0L, {n} - 1)")))
    runs = df.where(F.col(n) > RUN).withColumn("run", F.explode(F.expr(f"sequence(0L, ({n} - 1) div {RUN})")))
    ends = f"least({n} - 1, (run + 1) * {RUN} - 1)"
    many = runs.repartition("run").withColumn("copy", F.explode(F.expr(f"sequence(run * {RUN}, {ends})")))
    return few.drop(n).unionByName(many.drop(n, "run"))


def same_document(left: DataFrame, right: DataFrame) -> Column:
    """Join condition on (doc_id, text_key); a null doc_id is a value like any other."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_key"] == right["text_key"])


def words_column(text: str = "text") -> Column:
    """The words of a text between white space; none for a null text."""
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"[^{WHITE}]+"), F.lit(0))


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``number``, its place from 0 in the order given, without sorting in one task:
    ranges are numbered each by itself, and the driver adds up the ranges' row counts only."""
    ranges = keep(df.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id()))
    counts = {r["range_no"]: r["count"] for r in ranges.groupBy("range_no").count().collect()}
    before, offsets = 0, []
    for n in sorted(counts):
        offsets.append(F.struct(F.lit(n).alias("range_no"), F.lit(before).cast("long").alias("before")))
        before += counts[n]
    if not offsets:
        return ranges.drop("range_no").withColumn("number", F.lit(0).cast("long"))
    starts = df.sparkSession.range(1).select(F.explode(F.array(*offsets)).alias("o")).select("o.*")
    place = F.row_number().over(Window.partitionBy("range_no").orderBy(*order))
    return (
        ranges.join(F.broadcast(starts), "range_no")  # a row for each range
        .withColumn("number", F.col("before") + place - 1)
        .drop("range_no", "before")
    )
