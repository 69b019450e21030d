"""The ledger as a data source: nothing of failed tasks, each commit once, files skipped by time."""

from __future__ import annotations

import os
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusloom.operators import ledger
from corpusloom.sources import ledger_table


def runs(spark, low, high):
    rows = spark.range(low, high, 1, 4).select(F.col("id").alias("run_id"), F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(cast(id AS int))").alias("ts"), F.lit("log").alias("content_type"), (F.col("id") + 10).alias("original_tokens"), F.lit(5).cast("long").alias("cleaned_tokens"))
    return rows.withColumn("savings_pct", ledger.savings_pct(F.col("original_tokens"), F.col("cleaned_tokens")))


def test_commits(spark, tmp_path):
    at = str(tmp_path / "ledger")
    assert ledger_table.read(spark, at).count() == 0 and ledger_table.commits(at) == []
    broken = runs(spark, 0, 40).withColumn("cleaned_tokens", F.when(F.col("run_id") == 39, F.raise_error(F.lit("task fails")).cast("long")).otherwise(F.col("cleaned_tokens")))
    with pytest.raises(PySparkException, match="task fails"):
        ledger_table.write(broken, at, "a")
    assert ledger_table.read(spark, at).count() == 0
    for _ in range(2):
        ledger_table.write(runs(spark, 0, 40), at, "a")
    ledger_table.write(runs(spark, 40, 60), at)
    ledger_table.write(runs(spark, 0, 0), at, "none")
    assert sorted(r.run_id for r in ledger_table.read(spark, at).collect()) == list(range(60))
    assert sorted((c["rows"], len(c["files"])) for c in ledger_table.commits(at)) == [(0, 0), (20, 4), (40, 4)]
    assert ledger.totals(ledger_table.read(spark, at)).first().runs == 60
    with open(f"{at}/data/left.parquet", "wb") as f:  # of an executor that was lost
        f.write(b"x")
    assert ledger_table.read(spark, at).count() == 60
    assert ledger_table.vacuum(at) >= 1 and len(os.listdir(f"{at}/data")) == 8 and ledger_table.read(spark, at).count() == 60


def test_files_are_skipped_by_time(spark, tmp_path):
    at = str(tmp_path / "ledger")
    ledger_table.write(runs(spark, 0, 40), at, "a")
    found = ledger.since_days(ledger_table.read(spark, at), datetime(2024, 2, 5), 5)
    assert sorted(r.run_id for r in found.collect()) == list(range(30, 40))
    assert found.rdd.getNumPartitions() == 1  # of four files, the one of days 30 to 39
    assert ledger.today(ledger_table.read(spark, at), datetime(2024, 1, 8, 5)).count() == 33


def test_only_appends(spark, tmp_path):
    with pytest.raises(PySparkException):
        ledger_table.register(spark)
        runs(spark, 0, 3).write.format(ledger_table.NAME).option("path", str(tmp_path)).mode("overwrite").save()
