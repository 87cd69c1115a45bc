"""Sources: compile commands, fixed commands, file trees, optional tables, texts in memory, SQLite files."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from factfold import schema
from factfold.functions import argv, paths

COMMANDS = "directory string, file string, arguments array<string>, command string, output string"


def compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """(directory, file, arguments) of compile_commands.json; a command string is split at white space outside quotes."""
    raw = spark.read.schema(COMMANDS).json(path, multiLine=True)
    words = F.transform(F.regexp_extract_all("command", F.lit(r"(?:[^\s\"']|\"[^\"]*\"|'[^']*')+"), F.lit(0)), lambda w: F.regexp_replace(w, "[\"']", ""))
    return raw.select("directory", "file", F.coalesce("arguments", words).alias("arguments"))


def fixed_commands(spark: SparkSession, directory: str, files: list[str], arguments: list[str]) -> DataFrame:
    """Each file with the same arguments, the file appended."""
    base = spark.createDataFrame([(f,) for f in files], "file string")
    return base.select(F.lit(directory).alias("directory"), "file", F.array(F.lit("clang-tool"), *map(F.lit, arguments), F.col("file")).alias("arguments"))


def select_commands(commands: DataFrame, sources: list[str]) -> DataFrame:
    """The commands of the sources asked for, or all if none is."""
    return commands.where(F.col("file").isin(*sources)) if sources else commands


def commands_for(commands: DataFrame, sources: list[str]) -> DataFrame:
    """The commands whose source is one of the paths asked for, however either is spelled."""
    asked = commands.sparkSession.createDataFrame([(s,) for s in sources], "asked string").select(paths.normalise(F.col("asked")).alias("asked")).distinct()
    return commands.join(asked, paths.normalise(F.col("file"), F.col("directory")) == F.col("asked"), "left_semi")


def file_tree(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, size, modified) of all files below a directory; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def search_directories(commands: DataFrame) -> DataFrame:
    """(directory): where files are looked for: the directories of all sources and the include roots of all commands, each once."""
    source = paths.normalise(F.col("file"), F.col("directory"))
    roots = commands.select(F.explode(argv.include_roots(F.col("arguments"), F.col("directory"))).alias("directory"))
    return commands.select(paths.dirname(source).alias("directory")).unionByName(roots.select(paths.normalise(F.col("directory")).alias("directory"))).distinct()


def discover(commands: DataFrame, trees: DataFrame) -> DataFrame:
    """(path): command sources and tree files, each once."""
    return commands.select(F.col("file").alias("path")).unionByName(trees.select("path")).distinct()


def optional_table(spark: SparkSession, name: str, table: str | None = None) -> DataFrame:
    """A catalogue table, or an empty one of its schema if it is missing."""
    return spark.table(name) if spark.catalog.tableExists(name) else schema.empty(spark, table or name)


def texts(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Sources held in memory as (file, text)."""
    return spark.createDataFrame(list(files.items()), "file string, text string")


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    def __init__(self, columns: StructType, options: dict):
        self.columns, self.path, self.table, self.parts = [f.name for f in columns], options["path"], options["dbtable"], int(options.get("numpartitions", 8))

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True, timeout=10)

    def partitions(self) -> list[InputPartition]:
        with self._open() as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [_Range(0, -1)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, part: _Range) -> Iterator[tuple]:
        names = ", ".join(f'"{c}"' for c in self.columns)
        with self._open() as db:
            yield from db.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (part.low, part.high))


class SqliteSource(DataSource):
    """Reads a table of a SQLite file that every executor can open, in ranges of row ids; the schema is given, not inferred."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(schema, {k.lower(): v for k, v in self.options.items()})


def sqlite(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A fact or registry table of a SQLite file. The file must exist; it is opened read-only."""
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").schema((schema.FACTS | schema.REGISTRY)[table]).option("path", path).option("dbtable", table).load()
