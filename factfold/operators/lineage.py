"""Lineage cuts for loops and for tables that are read several times."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table that is joined in a loop is sent to all tasks.
MOST_SENT = 20_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or the one that was set as the checkpoint folder, or else one in the warehouse, which all
    executors share too."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/factfold-cuts").rstrip("/")


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """df written once as Parquet in the shared folder and read again; with ``by`` in one folder per value of that column, so that who
    asks for a value reads no other's rows.

    Unlike a checkpoint this forgets the size that the optimizer estimated: estimates of joins multiply, and in a loop of joins their
    digits grow exponentially until planning never ends.
    """
    at = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out.cut_at = at
    return out


def drop(*frames: DataFrame) -> None:
    """Delete what ``cut`` wrote for these frames; whatever was made of them must have been written before."""
    for df in frames:
        if at := getattr(df, "cut_at", None):
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def sized(df: DataFrame, n: int | None = None) -> DataFrame:
    """df as one side of a join: sent to all tasks if it has few rows, counted here or at most n, else merged.

    Left to itself Spark goes by the size of a written file, in which rising numbers take a byte or two, so that each round of a loop sends
    tables of a million rows through the driver.
    """
    return F.broadcast(df) if (df.count() if n is None else n) <= MOST_SENT else df.hint("merge")


class Growing:
    """A table that a loop adds rows to: parts are written as they come, and many parts are made one now and then, so that what is
    written stays in proportion to the table."""

    def __init__(self, first: DataFrame, most: int = 16):
        self.parts, self.added, self.most = [first], [], most

    def add(self, part: DataFrame) -> None:
        """part is a written table of the loop's own."""
        self.parts.append(part)
        self.added.append(part)
        if len(self.parts) > self.most:
            whole = cut(self.rows())
            drop(*self.added[:-1])  # the newest may still be the loop's frontier
            self.parts, self.added, self.most = [whole], [whole], 2 * self.most

    def rows(self) -> DataFrame:
        out = self.parts[0]
        for part in self.parts[1:]:
            out = out.unionByName(part)
        return out
