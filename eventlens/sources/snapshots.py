"""Results that readers see whole: versioned snapshots.

``publish`` writes a result to a new folder below ``path`` and, once it is
complete, announces it by creating one empty file, whose name holds a number and
the folder.  Creating a file is atomic on every store, nothing is overwritten or
renamed, and a reader takes the folder with the largest number.  So during a
write a reader sees the result before, and afterwards the new one, never an
empty or half-written folder; a failed write leaves nothing that is read.  The
last ``keep`` versions stay for readers that have begun; older ones are removed,
their announcement first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from eventlens.sources.files import create_empty, delete, make_folder, names

ANNOUNCED = "_snapshots"
KEEP = 2


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, folder) of the announced versions, in order."""
    found = [n.split(".", 1) for n in names(spark, f"{path}/{ANNOUNCED}")]
    return sorted((int(n[0]), n[1]) for n in found if len(n) == 2 and n[0].isdigit())


def publish(df: DataFrame, path: str, file_format: str = "parquet", keep: int = KEEP,
            options: dict | None = None) -> str:
    """Write ``df`` as the new version of ``path`` and return its folder.  Of two
    writers at once both versions are whole, and the larger name is read."""
    spark, folder = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.format(file_format).options(**(options or {})).mode("error").save(f"{path}/{folder}")
    make_folder(spark, f"{path}/{ANNOUNCED}")
    before = _versions(spark, path)
    number = before[-1][0] + 1 if before else 1
    create_empty(spark, f"{path}/{ANNOUNCED}/{number:012d}.{folder}")
    for old, name in _versions(spark, path)[:-keep]:
        delete(spark, f"{path}/{ANNOUNCED}/{old:012d}.{name}")
        delete(spark, f"{path}/{name}")
    return f"{path}/{folder}"


def current(spark: SparkSession, path: str) -> str | None:
    """Folder of the version to read; None before the first one."""
    found = _versions(spark, path)
    return f"{path}/{found[-1][1]}" if found else None


def read_snapshot(spark: SparkSession, path: str, file_format: str = "parquet", options: dict | None = None) -> DataFrame:
    folder = current(spark, path)
    if folder is None:
        raise FileNotFoundError(f"no snapshot has been published below {path}")
    return spark.read.format(file_format).options(**(options or {})).load(folder)
