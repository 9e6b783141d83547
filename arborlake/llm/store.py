"""Intermediate tables in the folder that the driver and all executors share.

The folder is the one in ``spark.checkpoint.dir``. Where the session does not set it
(tests), a folder below the warehouse, the storage that the session itself names, is
used; on a cluster that must not be a folder of one machine. A table written there
survives lost executors and cuts the lineage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of numbers that a task takes of a table whose rows are counted.
TASK_ROWS = 50_000
#: Rows of a side of a join that is broadcast; with more of them both sides are shuffled.
BROADCAST_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        on_machine = folder.startswith("file:") or "://" not in folder
        if on_machine and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder.rstrip("/")


def keep(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once, with options of the Parquet writer, and return the written table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}/{name}"
    df.write.options(**options).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._kept_path = path
    return table


def tasks_of(spark: SparkSession, rows: int) -> int:
    """Tasks of ``TASK_ROWS`` rows each, one a core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def in_tasks(df: DataFrame, rows: int) -> DataFrame:
    """Grouped rows, at most ``rows`` as counted, in no more tasks than they ask for.

    A shuffle deals to as many ranges as the session names, however few rows there are; a small
    table would be read and written in as many tasks. Not for the rows of a join that sorts its
    sides, whose sorters hold memory until a task ends: see :func:`dealt`.
    """
    return df.coalesce(tasks_of(df.sparkSession, rows))


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """The same for at most ``rows`` rows of a join, which are shuffled again where they are few."""
    tasks = tasks_of(df.sparkSession, rows)
    return df.repartition(tasks) if 2 * tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def few(table: DataFrame) -> DataFrame:
    """A kept table of some numbers a row as a side of a join, broadcast where it has few rows, as counted."""
    return table.hint("broadcast") if table.count() <= BROADCAST_ROWS else table


def drop(table: DataFrame) -> None:
    """Delete a table that :func:`keep` has written and nothing reads any more."""
    path = getattr(table, "_kept_path", None)
    if path:
        _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(folder.getParent(), True)


def fresh_name(df: DataFrame, *more: DataFrame, stem: str = "added") -> str:
    """A column name that none of the tables has, in any case of its letters."""
    taken = {c.lower() for d in (df, *more) for c in d.columns}
    name, k = f"_{stem}", 0
    while name in taken:
        k += 1
        name = f"_{stem}_{k}"
    return name
