"""Helpers that several training-data operators share."""

from __future__ import annotations

import functools
import gc
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from trajecta.llm.tokens import forget_encoders
from trajecta.operators.lineage import shared_folder


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one in the warehouse, but never a disk of the driver's own beside a cluster: that is an error."""
    return shared_folder(spark)


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "cut", partition_by: tuple[str, ...] = (), files: int | None = None, count: Column | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back.

    It cuts the lineage as checkpoint() does, survives the loss of executors, and computes df
    once where checkpoint() computes it twice. `files` joins the last tasks of a table that is
    known to be small into that many. With `count`, the number of rows where it holds is known
    afterwards (counted) without another job.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    seen = Observation() if count is not None else None
    if seen is not None:
        df = df.observe(seen, F.count(F.when(count, 1)).alias("n"))
    writer = (df.coalesce(files) if files else df).write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._trajecta_path = path
    out._trajecta_count = seen.get["n"] if seen is not None else None
    return out


def counted(df: DataFrame) -> int:
    """The count that materialize() took."""
    return df._trajecta_count


def discard(df: DataFrame) -> None:
    """Delete the files behind a materialized table that no later plan reads."""
    path = getattr(df, "_trajecta_path", None)
    if path is None:
        return
    jvm = df.sparkSession._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def give_back() -> None:
    """Give memory that this process has freed back to the system; the allocator would keep it for later."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(run, encodes: bool = False):
    """A function over batches that, at the end of its task, gives memory that was freed back to the system: a worker is kept for later tasks and stages, beside whose memory it would stand.

    Unless it `encodes`, it first drops the encoders that tasks of an earlier stage left in the worker.
    """

    def with_end(batches):
        try:
            if not encodes:
                forget_encoders()
            yield from run(batches)
        finally:
            give_back()

    return with_end


def frugal_on_driver(run):
    """A function that runs on the driver, such as a fit over a sample, after which the memory of what it held goes back to the system.

    Frames of plans that only cycles of references still hold go too, with what the JVM keeps for them.
    """

    @functools.wraps(run)
    def with_end(*args, **more):
        try:
            return run(*args, **more)
        finally:
            gc.collect()
            give_back()

    return with_end


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dense_rank_slots(
    df: DataFrame, groups: list[str], order: list[str], out: str, rows_per_bucket: int = 50_000, total: int | None = None, by: str | None = None
) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... without putting a group in one task.

    Rows are dealt to hash buckets of about rows_per_bucket rows; bucket counts give each
    (group, bucket) its first number, and a window inside (group, bucket) gives the rest. The
    numbering is gapless and deterministic for distinct `order` values. Rows that share the
    value of the column `by` (all of `order`, where it is not given) share a bucket and, if `by`
    comes first in `order`, lie side by side. df should be cheap to read twice (a materialized
    table).
    """
    total = df.count() if total is None else total
    n_buckets = max(1, -(-total // rows_per_bucket))
    bucket = F.pmod(F.xxhash64(*[F.col(c) for c in ([by] if by else order)]), F.lit(n_buckets)).cast("int")
    dealt = df.withColumn("_bucket", bucket)
    keys = [*groups, "_bucket"]
    counts = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    over = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("_first", F.coalesce(F.sum("_n").over(over), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys).orderBy(*order)
    ranked = dealt.withColumn("_in", F.row_number().over(inside) - 1)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    joined = ranked.alias("a").join(firsts.alias("b"), cond, "left")
    cols = [F.col(f"a.{c}") for c in df.columns]
    return joined.select(*cols, (F.col("b._first") + F.col("a._in")).cast("long").alias(out))


def id_fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo a number: the split of labelled rows into folds."""
    return F.pmod(F.crc32(F.encode(id_col.cast("string"), "UTF-8")), F.lit(modulus))


def hot_keys(rows: DataFrame, key: str, parts: int = 512, least: int = 256) -> list:
    """Values of a column that hold about one part in `parts` of the rows, and `least` rows, or more: at most `parts`, so fit for the driver.

    They come from one sketch of frequent items, merged over the tasks.
    """
    top = rows.agg(F.count(key).alias("n"), F.expr(f"approx_top_k(`{key}`, {parts}, {8 * parts})").alias("top")).first()
    return [r["item"] for r in top["top"] or [] if r["item"] is not None and r["count"] >= least and r["count"] * parts > top["n"]]


def hot_join(rows: DataFrame, table: DataFrame, on: list[str], key: str, hot: list, how: str = "inner", ways: int = 64) -> DataFrame:
    """Join rows to table(*on, ...), one row a key, on the columns `on`; rows of a hot value of `key` are dealt over `ways` tasks."""
    if not hot:
        return rows.join(table, on, how)
    is_hot = F.col(key).isin(hot)
    turn = F.when(is_hot, F.pmod(F.xxhash64(*rows.columns), F.lit(ways)).cast("int")).otherwise(0)
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("_turn", turn).join(table.withColumn("_turn", F.explode(copies)), [*on, "_turn"], how).drop("_turn")


def connected_components(edges: DataFrame, max_rounds: int = 60, files: int | None = None) -> DataFrame:
    """Smallest reachable id for every node of edges(a long, b long): (node, component).

    Each round takes the smallest label among the neighbours, then jumps to the label's own
    label; both are joins and partial minima. Nodes and labels that hold a large share of the
    rows are dealt over many tasks. Lineage is cut every round; `files` bounds the tables'
    files where their size is known.
    """
    every = F.lit(True)
    both = edges.where("a is not null and b is not null and a <> b")
    both = materialize(both.union(both.select("b", "a")).toDF("a", "b").distinct(), "edges", files=files, count=every)
    if not counted(both):
        discard(both)
        return edges.sparkSession.createDataFrame([], "node long, component long")
    hubs = hot_keys(both, "b")
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component"))
    labels = materialize(labels, "labels", files=files)
    for _ in range(max_rounds):
        near = hot_join(both, labels.withColumnRenamed("node", "b"), ["b"], "b", hubs)
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lowered = labels.join(near, "node", "left").select(
            "node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("low")
        )
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("far"))
        far = F.least("low", F.coalesce("far", "low"))
        new = hot_join(lowered, jump, ["low"], "low", hot_keys(labels, "component"), "left").select("node", "old", far.alias("component"))
        new = materialize(new, "labels", files=files, count=F.col("component") != F.col("old"))
        discard(labels)
        labels = new.select("node", "component")
        labels._trajecta_path = new._trajecta_path
        if not counted(new):
            discard(both)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
