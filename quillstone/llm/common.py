"""What the operators of this subpackage share: column guards, lineage cuts, label folds."""

from __future__ import annotations

import contextlib
import math
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.session import shared_dir, ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _position(df: DataFrame, name: str) -> int:
    """Where a column stands: the first of exactly this name, else the first in another case."""
    for same in (lambda c: c == name, lambda c: c.lower() == name.lower()):
        for i, c in enumerate(df.columns):
            if same(c):
                return i
    raise ValueError(f"no column {name}")


def take(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns, by place: other columns may have any names, the same in another case too."""
    ship(df.sparkSession)
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_c{_position(df, n)}").alias(n) for n in names])


class Rows:
    """A table whose columns have names of their own while whole rows are worked on.

    ``rows`` holds them, ``col(name)`` is a column of it; ``back`` gives a
    result with these columns its names again.
    """

    def __init__(self, df: DataFrame):
        ship(df.sparkSession)
        self.names = df.columns
        self.schema = df.schema
        self._df = df
        self.rows = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])

    def at(self, name: str) -> int:
        return _position(self._df, name)

    def has(self, name: str) -> bool:
        return name in self.names

    def col(self, name: str) -> Column:
        return F.col(f"_c{self.at(name)}")

    def back(self, df: DataFrame) -> DataFrame:
        return df.select(*[f"_c{i}" for i in range(len(self.names))]).toDF(*self.names)


def lower_ascii(column: Column) -> Column:
    """A-Z become a-z, every other character stays."""
    return F.translate(column, UPPER, LOWER)


def cut(df: DataFrame) -> DataFrame:
    """Eager, reliable checkpoint in the shared folder: survives lost executors and ends the lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def spilled(df: DataFrame, like: str) -> Iterator[DataFrame]:
    """Writes df as Parquet in the shared folder and gives the table until the block ends.

    Smaller than a checkpoint and readable column by column. What is built from it
    inside the block must be cut() before the block ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{like}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        remove(spark, path)


def even_parts(rows: int) -> int:
    """Parts for ranks in two steps: their number and the rows in each both grow with the square root of the table."""
    return max(1, rows // max(1000, 10 * math.isqrt(rows)))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; remainder 2 is held out. A null id has no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def learnable(doc_id: Column) -> Column:
    """Rows whose labels may be learned from; a null id never is one."""
    return F.coalesce(fold(doc_id) != 2, F.lit(False))
