"""Published results: readers see the old or the new one, never an empty folder."""

import csv
import glob
import threading

import pytest

from eventlens.sources import publish, read_snapshot, write_csv, write_parquet
from eventlens.sources import snapshots


def value(spark, path):
    return sorted(r.v for r in read_snapshot(spark, path).collect())


def frame(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v long")


def test_reader_between_the_two_steps(spark, tmp_path, monkeypatch):
    """A reader after the data is written and before it is announced sees the old result."""
    path = str(tmp_path / "r")
    with pytest.raises(FileNotFoundError):
        read_snapshot(spark, path)
    publish(frame(spark, 1), path)
    seen = []
    announce = snapshots.create_empty
    monkeypatch.setattr(snapshots, "create_empty", lambda s, p: (seen.append(value(spark, path)), announce(s, p)))
    publish(frame(spark, 2, 3), path)
    assert seen == [[1]] and value(spark, path) == [2, 3]


def test_failed_write_leaves_the_old_result(spark, tmp_path):
    path = str(tmp_path / "r")
    publish(frame(spark, 1), path)
    with pytest.raises(Exception):
        publish(frame(spark, 2).selectExpr("raise_error('x') as v"), path)
    assert value(spark, path) == [1]


def test_versions_are_kept_for_readers_that_have_begun(spark, tmp_path):
    path = str(tmp_path / "r")
    publish(frame(spark, 0), path)
    begun = read_snapshot(spark, path)
    publish(frame(spark, 1), path)
    assert [r.v for r in begun.collect()] == [0]
    for i in range(2, 5):
        publish(frame(spark, i), path)
    assert value(spark, path) == [4]
    assert len(glob.glob(path + "/v-*")) == snapshots.KEEP == len(glob.glob(path + "/_snapshots/0*"))


def test_numbers_order_as_numbers(spark, tmp_path):
    path = str(tmp_path / "r")
    for i in range(11):
        publish(frame(spark, i), path, keep=20)
    assert value(spark, path) == [10]


def test_concurrent_readers_never_see_nothing(spark, tmp_path):
    path = str(tmp_path / "r")
    publish(frame(spark, 0), path)
    stop, bad, reads = threading.Event(), [], []

    def read():
        while not stop.is_set():
            try:
                got = value(spark, path)
                reads.append(got)
                if len(got) != 1:
                    bad.append(got)
            except Exception as e:  # noqa: BLE001
                bad.append(e)
    reader = threading.Thread(target=read)
    reader.start()
    try:
        for i in range(1, 6):
            publish(frame(spark, i), path, keep=10)
    finally:
        stop.set()
        reader.join()
    assert not bad and reads


def test_versioned_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", None), (None, 1)], "k string, v long").coalesce(1)
    write_parquet(df, str(tmp_path / "p"), versioned=True)
    assert read_snapshot(spark, str(tmp_path / "p")).count() == 2
    write_csv(df, str(tmp_path / "c"), versioned=True)
    (part,) = glob.glob(str(tmp_path / "c/v-*/part-*.csv"))
    with open(part) as f:
        assert list(csv.reader(f)) == [["k", "v"], ["a", ""], ["", "1"]]
    with pytest.raises(ValueError):
        write_parquet(df, str(tmp_path / "q"), partition_by="k", versioned=True)
