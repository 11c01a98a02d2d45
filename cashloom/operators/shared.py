"""The shared folder, saved tables and hot-key joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A group that holds more than this share of all rows is joined by broadcast, the others by shuffle.
HEAVY_SHARE = 256
#: Rows of a small table that one file may have.
FILE_ROWS = 200_000
#: Rows that are worth a task of their own.
TASK_ROWS = 20_000
#: Rows of an index that are summed in one task.
SUM_BLOCK = 1 << 16
#: The driver's JVM collects its garbage when this part of its heap has filled since the last time.
GARBAGE_SHARE = 8
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_MERGING = "spark.sql.adaptive.coalescePartitions.enabled"
#: Names this process's folder of saved tables.
RUN = uuid.uuid4().hex
#: Bytes of the driver's heap in use after the last collection.
_in_use = 0


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share, as spark.checkpoint.dir names it.

    Only where that setting is absent and everything runs in one process (tests) a temporary folder is made
    and set; on a cluster each machine would have its own, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = jvm_dir.get() if jvm_dir.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="cashloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def saved(df: DataFrame, name: str, rows: int | None = None, grows: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: this cuts the lineage.

    ``rows`` tells about how many there are, where that is known: a table of few rows then has few files,
    their number growing with it. It limits nothing. A join that ``grows``, to many more rows than it reads,
    keeps all of its tasks: merging them by the size of what they read would leave a few with all the work.
    The shuffle files of the write go as soon as it has ended, since nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cashloom-{RUN}/{name}-{uuid.uuid4().hex}"
    if rows is not None:
        # Never fewer tasks than the cluster has cores, unless there is next to nothing for each.
        df = df.coalesce(1 + max(rows // FILE_ROWS, min(spark.sparkContext.defaultParallelism, rows // TASK_ROWS)))
    settings = {_CLEANUP: "true"} | ({_MERGING: "false"} if grows else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    settle(spark)
    return spark.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession) -> None:
    """Have the driver's JVM collect its garbage once an eighth of its heap has filled since the last time.

    Hundreds of short plans leave garbage faster than it is collected unasked, so the heap grows towards its
    limit; after a whole collection it shrinks to a few times what is in use.
    """
    global _in_use
    memory = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    used = memory.totalMemory() - memory.freeMemory()
    if used - _in_use > memory.maxMemory() // GARBAGE_SHARE:
        memory.gc()
        used = memory.totalMemory() - memory.freeMemory()
        _in_use = used
    _in_use = min(_in_use, used)


def drop_saved(spark: SparkSession) -> None:
    """Delete all tables that this process has saved; results that still read them are void then."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/cashloom-{RUN}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def running_sums(rows: DataFrame, index: str, sums: dict[str, Column], block: int = SUM_BLOCK) -> DataFrame:
    """``rows`` with columns of sums over the rows of a lower ``index``, a bigint of its own for each row.

    Sums run within blocks of the index, to which the sums of the blocks before are added; only these, a
    row for each block, are in one task.
    """
    rows = rows.select("*", F.floor(F.col(index) / block).alias("_block"), *[v.cast("bigint").alias(f"_v_{k}") for k, v in sums.items()])
    blocks = rows.groupBy("_block").agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in sums])
    before, inside = (w.rowsBetween(W.unboundedPreceding, -1) for w in (W.orderBy("_block"), W.partitionBy("_block").orderBy(index)))
    blocks = blocks.select("_block", *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums])
    own = rows.select("*", *[F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0)).alias(f"_o_{k}") for k in sums]).join(blocks, "_block")
    kept = [c for c in rows.columns if c != "_block" and not c.startswith("_v_")]
    return own.select(*kept, *[(F.col(f"_o_{k}") + F.col(f"_b_{k}")).alias(k) for k in sums])


def lookup(
    rows: DataFrame, table: DataFrame, keys: list[str], size: str, total: int, spread: Column, matched: bool = False
) -> DataFrame:
    """Left join ``rows`` with the group table ``table`` on ``keys``, safely for hot groups.

    ``size`` is the column of ``table`` that has the number of rows of a group, out of ``total``.
    At most HEAVY_SHARE groups can each hold more than total / HEAVY_SHARE rows, so those few table
    rows are broadcast. Rows they answer get a key of their own (``spread``) in the shuffle join of
    the rest, so that no task receives a hot group. ``keys`` are columns without nulls, the first a
    bigint. With ``matched``, rows without a table row are left out.
    """
    values = [c for c in table.columns if c not in keys]
    hot = table.where(F.col(size) * HEAVY_SHARE > F.lit(total))
    cold = table.where(F.col(size) * HEAVY_SHARE <= F.lit(total))
    hot = hot.select(*[F.col(k).alias(f"_h_{k}") for k in keys], *[F.col(v).alias(f"_h_{v}") for v in values])
    cold = cold.select(
        *[F.col(k).alias(f"_c_{k}") for k in keys], *[F.col(v).alias(f"_c_{v}") for v in values],
        F.lit(False).alias("_c_done"),
    )
    on_hot = [F.col(k) == F.col(f"_h_{k}") for k in keys]
    if matched:
        on_cold = [F.col(k) == F.col(f"_c_{k}") for k in keys]
        answered = rows.join(F.broadcast(hot), on_hot).select(*rows.columns, *[F.col(f"_h_{v}").alias(v) for v in values])
        others = rows.join(F.broadcast(hot), on_hot, "left_anti").join(cold, on_cold)
        return answered.unionAll(others.select(*rows.columns, *[F.col(f"_c_{v}").alias(v) for v in values]))
    step = rows.join(F.broadcast(hot), on_hot, "left")
    step = step.withColumn("_done", F.col(f"_h_{size}").isNotNull())
    step = step.withColumn("_k0", F.when(F.col("_done"), spread).otherwise(F.col(keys[0])))
    on_cold = [F.col("_k0") == F.col(f"_c_{keys[0]}")]
    on_cold += [F.col(k) == F.col(f"_c_{k}") for k in keys[1:]]
    on_cold.append(F.col("_done") == F.col("_c_done"))
    step = step.join(cold, on_cold, "left")
    return step.select(
        *rows.columns, *[F.coalesce(F.col(f"_h_{v}"), F.col(f"_c_{v}")).alias(v) for v in values]
    )
