"""Tables written to the cluster's shared folder, and small column helpers."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlab.sources.tables import shared_dir

#: The white space of the contracts, ``[\x20\x09-\x0D]``.
WS = " \t\n\x0b\x0c\r"
WS_RUN = r"[\x20\x09-\x0D]+"
#: Bytes of a row group of such tables: what a task holds of them in memory.
ROW_GROUP = 32 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Folders of open scratch scopes, the innermost last.
_SCOPES: list[str] = []


@contextlib.contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[None]:
    """Tables that ``cut`` writes within go to a folder of their own, which is removed at the end: nothing may read them after that."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _SCOPES.append(folder)
    try:
        yield
    finally:
        _SCOPES.remove(folder)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: For tables whose rows have megabytes: a page and a row group end by size after any row.  Parquet looks after 100 rows first, and a reader takes whole row groups.
LARGE_ROWS = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def cut(df: DataFrame, name: str = "t", large_rows: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: what follows reads files that survive the loss of
    any executor, and nothing before it runs twice.
    """
    spark = df.sparkSession
    path = f"{_SCOPES[-1] if _SCOPES else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(LARGE_ROWS if large_rows else {"parquet.block.size": ROW_GROUP})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_apart(spark: SparkSession, make: Callable[[], DataFrame], name: str = "t") -> DataFrame:
    """As ``cut`` of what ``make`` returns; tables that ``make`` writes on the way are removed."""
    path = f"{_SCOPES[-1] if _SCOPES else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with scratch(spark, f"{name}-way"):
        out = make()
        out.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(col, UPPER, UPPER.lower())


def hash128(*cols: Column) -> list[Column]:
    """Two 64-bit hashes that together stand for the value."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit(1), *cols)]


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS_RUN, -1), lambda w: w != "")
