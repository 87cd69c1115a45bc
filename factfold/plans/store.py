"""A versioned store of several tables that change together.

Each change writes a new directory and then one small pointer file names it, so readers see all tables of one version.
Paths go through Hadoop's file system, so that any store that Spark can write will do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factfold.functions import flags


class Store:
    """One writer at a time; readers need no lock."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _pointer(self) -> dict:
        fs, path = self._fs()
        at = path(f"{self.root}/CURRENT")
        if not fs.exists(at):
            return {"tables": {}, "properties": {}}
        rows = self.spark.read.text(f"{self.root}/CURRENT").collect()
        return json.loads(rows[0].value)

    def property(self, name: str) -> str | None:
        return self._pointer()["properties"].get(name)

    def tables(self) -> list[str]:
        return sorted(self._pointer()["tables"])

    def read_or_none(self, spark: SparkSession, table: str) -> DataFrame | None:
        at = self._pointer()["tables"].get(table)
        return None if at is None else spark.read.parquet(at)

    def read(self, table: str) -> DataFrame:
        df = self.read_or_none(self.spark, table)
        if df is None:
            raise KeyError(f"no table {table}")
        return df

    def replace(self, spark: SparkSession, tables: dict[str, DataFrame], properties: dict[str, str] | None = None) -> None:
        """Write the given tables, then switch to them; tables not given stay as they are. A failed write switches nothing."""
        version = uuid.uuid4().hex
        written = {}
        for name, df in tables.items():
            written[name] = f"{self.root}/versions/{version}/{name}"
            df.write.parquet(written[name])
        before = self._pointer()
        state = {"tables": before["tables"] | written, "properties": before["properties"] | (properties or {})}
        fs, path = self._fs()
        new, at = path(f"{self.root}/.CURRENT-{version}"), path(f"{self.root}/CURRENT")
        out = fs.create(new, True)
        out.write(bytearray((json.dumps(state) + "\n").encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration()) if at.toUri().getScheme() else self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(new, at, options)


def migrate_symbol_flags(symbols: DataFrame) -> DataFrame:
    """Symbols of schema versions that packed semantics into ``flags``, with one column for each."""
    f = F.col("flags")
    fields = [flags.field(f, place, width, names).alias(name) for name, (place, width, names) in flags.SYMBOL_FIELDS.items()]
    return symbols.select(*(c for c in symbols.columns if c != "flags"), *fields, *flags.decode(f, flags.SYMBOL_BITS))
