"""Tables several queries start from, written once per session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quantloom.session import cut_lineage

_STAGED: dict[tuple[str, str, str, str], DataFrame] = {}


def files_of(spark: SparkSession, sf: str) -> str:
    """Names, sizes and times of the input's files, so that a changed input is read anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return "|".join(sorted(f"{x.getPath().getName()}:{x.getLen()}:{x.getModificationTime()}" for x in listed))


def staged(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table several queries start from (monthly sums, snapshots, signals), written once.

    It is read back from the shared folder, so dependants neither replan nor recompute what produced it.
    """
    key = (spark.sparkContext.applicationId, sf, name, files_of(spark, sf))
    if key not in _STAGED:
        _STAGED[key] = cut_lineage(build())
    return _STAGED[key]


def forget_staged() -> None:
    _STAGED.clear()
