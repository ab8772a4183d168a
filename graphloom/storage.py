"""Stage tables: Parquet tables in the cluster's shared folder that cut lineage.

Loops write each round here and read it back, so a lost executor costs one round at most
and the optimizer plans the next round from the real file sizes (a small frontier is
broadcast, a large one is shuffled).
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_roots: dict[str, str] = {}
_bucketed: dict[str, list[str]] = {}


def work_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="graphloom-")
        root = f"{base.rstrip('/')}/stage-{app}"
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        # Only a folder that exists can be marked; it goes when the application ends.
        files.mkdirs(path)
        files.deleteOnExit(path)
        _roots[app] = root
    return _roots[app]


def drop_stages(spark: SparkSession) -> None:
    """Deletes all stage tables of the application; results read from them are gone with them.

    For long sessions: call it when the results of a job have been written.
    """
    root = _roots.pop(spark.sparkContext.applicationId, None)
    for table in _bucketed.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    if root:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def buckets(spark: SparkSession) -> int:
    """Buckets of a stage table that is stored by a column."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class StageTables:
    """The stage tables of one operator call."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.schemas: dict[str, T.StructType] = {}
        self.tables: dict[str, str] = {}

    def _write(self, df: DataFrame, path: str, metrics: dict[str, Column]) -> dict[str, int]:
        if not metrics:
            df.write.parquet(path)
            return {}
        seen = Observation()
        df.observe(seen, *[c.alias(n) for n, c in metrics.items()]).write.parquet(path)
        values = seen.get
        return {name: int(values.get(name) or 0) for name in metrics}

    def put(self, df: DataFrame, name: str, by: str | None = None, **metrics: Column) -> tuple[DataFrame, dict[str, int]]:
        """Write a table once; returns it and the metrics taken during the write.

        by: a column that the table is bucketed by.  Joins, groupings and windows on it and further
        columns then move no rows.  Its values must have few rows each, as one task takes all of them.
        """
        path = f"{self.root}/{name}"
        if by is not None:
            return self._put_bucketed(df, path, by, metrics)
        values = self._write(df, path, metrics)
        return self.spark.read.schema(df.schema).parquet(path), values

    def _put_bucketed(self, df: DataFrame, path: str, by: str, metrics: dict[str, Column]) -> tuple[DataFrame, dict[str, int]]:
        count = buckets(self.spark)
        seen = Observation()
        spread = df.observe(seen, *[c.alias(n) for n, c in metrics.items()]) if metrics else df
        writer = spread.repartition(count, by).write.format("parquet").bucketBy(count, by)
        table = self.tables.get(path)
        if table is None:
            table = self.tables[path] = f"graphloom_{uuid.uuid4().hex}"
            _bucketed.setdefault(self.spark.sparkContext.applicationId, []).append(table)
            writer = writer.option("path", path)
        writer.mode("append").saveAsTable(table)
        values = seen.get if metrics else {}
        return self.spark.table(table), {name: int(values.get(name) or 0) for name in metrics}

    def put_all(self, parts: list[DataFrame], name: str, by: str | None = None) -> DataFrame:
        """The rows of several tables as one.  With `by`, rows that are where their bucket is stay there,
        which they would not in a union."""
        if by is None:
            return self.put(reduce(DataFrame.unionByName, parts), name)[0]
        return [self.put(part, name, by)[0] for part in parts][-1]

    def drop(self, name: str) -> None:
        """Deletes a table of this call that nothing reads again."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def append(self, df: DataFrame, name: str, round_no: int, by: str | None = None, **metrics: Column) -> tuple[DataFrame, dict[str, int]]:
        """Add one round to a log table; returns just that round.  by: as in `put`, the same for all rounds."""
        if by is not None:
            # One table for all rounds: a union of them would lose the buckets.
            rows, values = self._put_bucketed(df.withColumn("round", F.lit(round_no)), f"{self.root}/{name}", by, metrics)
            return rows.filter(F.col("round") == round_no).drop("round"), values
        self.schemas.setdefault(name, df.schema)
        path = f"{self.root}/{name}/round={round_no}"
        values = self._write(df, path, metrics)
        return self.spark.read.schema(df.schema).parquet(path), values

    def log(self, name: str) -> DataFrame:
        """All rounds of a log table, with their number in column `round`."""
        if f"{self.root}/{name}" in self.tables:
            return self.spark.table(self.tables[f"{self.root}/{name}"])
        schema = T.StructType(list(self.schemas[name].fields) + [T.StructField("round", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
