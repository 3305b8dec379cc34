"""What the operators share: tables in the shared scratch folder, and batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ASCII white space, as the word class ``[^\x20\x09-\x0D]+`` has it.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
#: With this setting Spark deletes a query's shuffle files when the query ends; what is cut is read from its table.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: The struct in which an operator carries further columns of its input to its result.
ROW = "_row"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written to the folder that the cluster shares, to cut lineage.

    A lost executor then costs a re-read, not a recomputation. The folder is
    ``spark.checkpoint.dir`` of the session. Where that is unset a temporary
    folder is made, but only on a local master, as in tests; on a cluster its
    executors would not see it.
    """

    #: All that were opened and not yet closed in this process, so that a caller can close those of a call that is over.
    opened: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not base:
            base = tempfile.mkdtemp(prefix="spark-")
        self.spark = spark
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        self.live: set[str] = set()
        Scratch.opened.append(self)

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}"
        before = self.spark.conf.get(SHUFFLE_CLEANUP, None)
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(SHUFFLE_CLEANUP)
            else:
                self.spark.conf.set(SHUFFLE_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        self.live.add(path)
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing will read again."""
        self._delete(df.scratch_path)
        self.live.discard(df.scratch_path)

    def keep_only(self, df: DataFrame) -> DataFrame:
        """Delete all other tables, and return this one."""
        for path in self.live - {df.scratch_path}:
            self._delete(path)
        self.live = {df.scratch_path}
        return df

    def close(self) -> None:
        self._delete(self.root)
        self.live = set()
        if self in Scratch.opened:
            Scratch.opened.remove(self)

    def _delete(self, path: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(conf).delete(path, True)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def carried(docs: DataFrame, columns: Sequence[str]) -> list[Column]:
    """The named columns as one struct ``_row``, so that no name clashes with an operator's own; nothing if none is named."""
    return [F.struct(*[docs[f"`{c}`"].alias(c) for c in columns]).alias(ROW)] if columns else []


def schema_with_row(ddl: str, own: DataFrame) -> StructType:
    """The schema of a map over ``own`` that adds its ``_row`` as the last column, if it has one."""
    schema = StructType.fromDDL(ddl)
    return schema.add(own.schema[ROW]) if ROW in own.columns else schema
