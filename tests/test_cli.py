"""Command-line runner."""

import glob
import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_cli_writes_csv(spark):
    from eventlens.sources.fixtures import load_fixture
    events, _ = load_fixture(spark, "/root/testdata/sf0.001")
    src = events.inputFiles()[0].split("/event_date=")[0]
    out = tempfile.mkdtemp(prefix="eventlens-cli-", dir=os.environ.get("EVENTLENS_SCRATCH", "/tmp")) + "/inv"
    r = subprocess.run([sys.executable, "-m", "eventlens", "lobby_event_inventory", "--events", src,
                        "--out", out, "--master", "local[2]", "date_from=20231231", "date_to=20240131"],
                       cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert r.returncode == 0, r.stderr[-2000:]
    lines = [ln for f in sorted(glob.glob(out + "/part-*.csv")) for ln in open(f)]
    assert lines[0].strip() == "event_name,event_count"
    assert len(lines) > 1


def test_output_is_asked_for_and_tuples_are_typed():
    from eventlens.__main__ import _coerce, main
    import pytest
    with pytest.raises(SystemExit):
        main(["lobby_event_inventory", "--events", "x"])
    assert _coerce("thresholds", "30", (10, 15)) == (30,)
    assert _coerce("thresholds", "10,30", (10, 15)) == (10, 30)
    assert _coerce("names", "a,b", ("x",)) == ("a", "b")


def test_cluster_conf_values():
    from eventlens import cluster_conf
    c = cluster_conf(4000)
    assert c["spark.sql.shuffle.partitions"] == "12000"
    assert cluster_conf(100)["spark.sql.shuffle.partitions"] == "2000"
    assert cluster_conf(100, input_bytes=100 << 40)["spark.sql.shuffle.partitions"] == str((100 << 40) // (256 << 20))
    assert c["spark.sql.autoBroadcastJoinThreshold"] == "-1"
