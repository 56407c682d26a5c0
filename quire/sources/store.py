"""Tables of records at rest: keyed writes where the last one wins, deletes by run, and an append log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.session import checkpointed, met


def upserted(base: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Base and changes, of equal keys the row with the greatest ``order`` (ties: the change)."""
    cols = base.columns
    x = base.withColumn("_c", F.lit(0)).unionByName(changes.select(*cols).withColumn("_c", F.lit(1)))
    rest = [c for c in cols if c not in keys]
    return x.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, "_c")).alias("r")).select(*keys, "r.*").select(*cols)


def patched(base: DataFrame, changes: DataFrame, keys: list[str], fixed: tuple[str, ...] = ()) -> DataFrame:
    """Base with the columns of changes that aren't null, but for keys and ``fixed`` columns; rows without base are left out."""
    c = changes.select(*keys, *[F.col(x).alias(f"_{x}") for x in changes.columns if x not in keys])
    new = [F.coalesce(F.col(f"_{x}"), F.col(x)).alias(x) if x in changes.columns and x not in keys and x not in fixed else F.col(x) for x in base.columns]
    return base.join(c, keys, "left").select(*new)


def get(base: DataFrame, **key) -> DataFrame:
    """The row of a key; a filter that reaches the Parquet scan."""
    return base.where(_equal(key))


def listed(base: DataFrame, order: list[str] | None = None, **index) -> DataFrame:
    """Rows of one value of an index column (a run, a status), ordered."""
    rows = base.where(_equal(index)) if index else base
    return rows.orderBy(*order) if order else rows


def _equal(values: dict):
    on = F.lit(True)
    for k, v in values.items():
        on &= F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k).eqNullSafe(F.lit(v))
    return on


def without_run(base: DataFrame, runs: DataFrame) -> DataFrame:
    """Base without the rows of some runs."""
    return base.join(runs.select("run_id").distinct(), "run_id", "left_anti")


def removed(base: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, rows): how many rows of each of some runs go; 0 for a run without any."""
    r = runs.select("run_id").distinct()
    n = base.groupBy("run_id").agg(F.count("*").alias("n"))
    return r.join(n, "run_id", "left").select("run_id", F.coalesce("n", F.lit(0)).alias("rows"))


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """Parquet, partitioned by a column of few values if given, so that a run can be replaced or pruned by folder."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(by) if by else w).parquet(path)


def append_log(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Append rows with the next ids after the greatest in the log, in order of their time within the batch.

    Ids are a running number over counts per partition of a range sort, so the batch isn't gathered in one task.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    last = (spark.read.parquet(path).agg(F.max("id")).first()[0] or 0) if there else 0  # any other failure is one
    part = rows.repartitionByRange("ts").sortWithinPartitions("ts").withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id())
    part = checkpointed(part)  # the range bounds are sampled: counts and rows must come from the same partitions
    n = part.groupBy("_p").agg(F.count("*").alias("_n"))
    upto = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    before = n.select("_p", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_b"))
    numbered = met(part, before, ["_p"]).withColumn("id", last + F.col("_b") + F.row_number().over(Window.partitionBy("_p").orderBy("_k")))
    numbered.drop("_p", "_k", "_b").write.mode("append").parquet(path)
