"""Files, expert inputs and streams on small folders."""

import datetime as dt
import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from panelspark.operators import experts
from panelspark.sources import files
from panelspark.streaming import jobs

DAY = dt.date(2024, 1, 1)


def test_dated_folder_keeps_the_newest_row_and_grows_columns(spark, tmp_path):
    for day, rows, schema in (("20240101", [(1, 1.0), (2, 2.0)], "k long, v double"), ("20240102", [(1, 9.0, "x")], "k long, v double, note string")):
        spark.createDataFrame(rows, schema).toPandas().to_parquet(tmp_path / f"{day}.parquet", index=False)
    found = {r["k"]: (r["v"], r["note"], r["none"]) for r in files.read_dated_folder(spark, str(tmp_path), ("k",), ("k", "v", "note", "none")).collect()}
    assert found == {1: (9.0, "x", None), 2: (2.0, None, None)}
    later = files.read_dated_folder(spark, str(tmp_path), ("k",), ("k", "v"), since="20240102")
    assert {r["k"]: r["v"] for r in later.collect()} == {1: 9.0}
    assert tuple(files.interface_profile(spark, str(tmp_path)).first()) == (2, 3, "20240101", "20240102")


def test_run_archive_sidecar_and_export(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"run_id": "r", "equity_curve": [{"date": "2024-01-01", "equity": 1.0}, {"date": "2024-01-02", "equity": 2.0}], "trades": [{"name": "a", "pnl": 1.5}, {"name": "b", "pnl": -1.0}]}))
    (tmp_path / "b.json").write_text(json.dumps({"run_id": "s", "equity_curve": [], "trades": []}))
    assert sorted(map(tuple, files.archived_trades(spark, str(tmp_path / "*.json")).select("run_id", "name", "pnl").collect())) == [("r", "a", 1.5), ("r", "b", -1.0)]
    runs, curve = files.read_run_archive(spark, str(tmp_path / "*.json"))
    assert runs.count() == 2 and [r["equity"] for r in curve.orderBy("date").collect()] == [1.0, 2.0]
    a = spark.createDataFrame([(1, DAY, 1.0)], "instrument long, date date, f double")
    b = spark.createDataFrame([(1, DAY, 7.0, 2.0)], "instrument long, date date, f double, g double")
    files.write_sidecar(files.append_factors(a, b), str(tmp_path / "side"))
    assert tuple(spark.read.parquet(str(tmp_path / "side")).first())[2:] == (1.0, 2.0)
    files.export_csv(b, str(tmp_path / "csv"), ("instrument",), 10)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1


def test_verdict(spark):
    rows = [(2020, 1.0, 0.1, 0.5, 0.0, 0.95), (2021, 1.0, 0.1, 0.5, 0.0, 0.9)]
    row = experts.verdict(spark.createDataFrame(rows, "year int, policy_sharpe double, policy_excess double, replay_sharpe double, replay_excess double, copy_ratio double")).first()
    assert row["verdict"] == "better" and row["copies"] and row["years"] == 2


def test_landing_touches_the_days_of_a_batch_alone(spark, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "c"))
    schema = "k long, day date, v double"
    d = lambda n: dt.date(2024, 1, n)

    def land(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        jobs.land(jobs.event_stream(spark, source), target, ("k", "day"), ("v",), "day", check).awaitTermination()
        return {(r["k"], r["day"]): r["v"] for r in spark.read.parquet(target).collect()}

    files = lambda n: sorted(str(p) for p in Path(target, f"day=2024-01-0{n}").glob("*.parquet"))
    want = {(1, d(1)): 1.0, (2, d(1)): 2.0, (1, d(2)): 3.0}
    assert land([(1, d(1), 1.0), (2, d(1), 2.0), (1, d(1), 0.5), (1, d(2), 3.0)]) == want  # the last by v, not the last met
    before = files(1)
    want |= {(1, d(2)): 1.5, (7, d(3)): 9.0}
    assert land([(1, d(2), 1.5), (7, d(3), 9.0)]) == want and files(1) == before  # a later batch wins; the first day is left alone
    want |= {(1, d(1)): 0.25, (3, d(1)): 4.0}
    assert land([(1, d(1), 0.25), (3, d(1), 4.0), (3, d(1), 4.0)]) == want and files(1) != before  # late and repeated rows
    # A batch whose commit was lost is done again and gives the same table.
    last = sorted((Path(check) / "commits").glob("[0-9]*"), key=lambda p: int(p.name))[-1]
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    jobs.land(jobs.event_stream(spark, source), target, ("k", "day"), ("v",), "day", check).awaitTermination()
    assert {(r["k"], r["day"]): r["v"] for r in spark.read.parquet(target).collect()} == want
    with pytest.raises(ValueError):
        jobs.land(jobs.event_stream(spark, source), target, ("k",), ("v",), "day", check)


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        files.shared_folder(Session())


def test_stream_queries_write_files_rather_than_to_the_driver(spark):
    from __spark_entry__ import queries

    for name in ("stream_weekly_bars", "stream_first_of_key"):
        found = queries()[name](spark, "/root/testdata/sf0.001")
        assert found.inputFiles() and all(f.endswith(".parquet") for f in found.inputFiles()) and found.count()


def test_a_session_from_before_the_import_gets_the_package(tmp_path):
    """Workers have no PYTHONPATH of ours: the session is made first, the import comes later, from another folder."""
    import subprocess
    import sys

    root = str(Path(__file__).resolve().parent.parent)
    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.range(10).rdd.map(lambda x: x[0]).count()  # workers are up
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as e
print("rows", e.queries()["ewm_mean"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows " in done.stdout, done.stderr[-2000:]


def test_a_run_archive_is_written_compressed(spark, tmp_path):
    runs = spark.range(40).select(F.col("id").alias("run_id"), F.array(F.struct((F.col("id") * 1.5).alias("equity"))).alias("equity_curve"), F.when(F.col("id") > 3, F.lit("x")).alias("note"))
    files.write_run_archive(runs, str(tmp_path / "a"), per_file=10)
    written = list((tmp_path / "a").rglob("part-*"))
    assert written and all(f.suffix == ".gz" for f in written)
    found, curve = files.read_run_archive(spark, str(tmp_path / "a"), "run_id bigint, note string, equity_curve array<struct<equity: double>>")
    assert sorted((r["run_id"], r["note"]) for r in found.collect()) == [(i, "x" if i > 3 else None) for i in range(40)]
    assert sorted(map(tuple, curve.collect())) == [(i, i * 1.5) for i in range(40)]
