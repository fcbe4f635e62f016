"""Commits of the results table: breaks, readers during an overwrite, several writers."""

import pytest
from pyspark.sql import functions as F

from cellshift.operators.normalize import RESULTS_COLUMNS
from cellshift.streaming import results_log
from cellshift.streaming.results_log import ResultsLog

SCHEMA = ", ".join(f"{c} {'string' if c in ('split', 'fold') else 'double'}" for c in RESULTS_COLUMNS)


def _rows(spark, fold, value, n=2, split="held_out_context"):
    rows = [tuple({"split": split, "fold": fold}.get(c, value) for c in RESULTS_COLUMNS)] * n
    return spark.createDataFrame(rows, SCHEMA)


def _values(frame):
    return sorted((r["fold"], r["value"]) for r in frame.select("fold", "value").collect())


def test_a_break_between_write_and_commit_leaves_no_trace(spark, tmp_path, monkeypatch):
    log = ResultsLog(spark, str(tmp_path), "k")
    assert log.read() is None and log.completed() is None
    log.append(_rows(spark, "held_out_context/A", 1.0))
    with monkeypatch.context() as broken:
        broken.setattr(results_log, "rename", lambda *_: (_ for _ in ()).throw(OSError("driver lost")))
        with pytest.raises(OSError):
            log.append(_rows(spark, "held_out_context/A", 2.0))
        with pytest.raises(OSError):
            log.append(_rows(spark, "held_out_context/B", 2.0))
    again = ResultsLog(spark, str(tmp_path), "k")
    assert _values(again.read()) == [("held_out_context/A", 1.0)] * 2
    assert [r["fold"] for r in again.completed().collect()] == ["held_out_context/A"]
    again.append(_rows(spark, "held_out_context/B", 3.0))
    assert _values(again.read()) == [("held_out_context/A", 1.0)] * 2 + [("held_out_context/B", 3.0)] * 2
    assert again.read(["random"]).isEmpty()


def test_a_reader_keeps_its_rows_while_a_fold_is_replaced(spark, tmp_path):
    log = ResultsLog(spark, str(tmp_path), "k")
    both = _rows(spark, "held_out_context/A", 1.0).unionByName(_rows(spark, "held_out_context/B", 1.0, n=1))
    log.append(both)
    reader = log.read()
    name = log.stage(_rows(spark, "held_out_context/A", 5.0, n=3))
    assert _values(log.read()) == _values(reader)  # written, not committed
    log.commit(name)
    assert _values(reader) == [("held_out_context/A", 1.0)] * 2 + [("held_out_context/B", 1.0)]
    assert _values(log.read()) == [("held_out_context/A", 5.0)] * 3 + [("held_out_context/B", 1.0)]
    log.clear()
    assert log.read() is None


def test_two_writers_lose_no_fold(spark, tmp_path, monkeypatch):
    log, other = (ResultsLog(spark, str(tmp_path), "k") for _ in range(2))
    plain, met = results_log.rename, []

    def late(*names):
        if not met:  # the other writer commits first
            met.append(1)
            other.append(_rows(spark, "held_out_context/B", 2.0, n=1))
        return plain(*names)

    monkeypatch.setattr(results_log, "rename", late)
    log.append(_rows(spark, "held_out_context/A", 1.0, n=1))
    assert _values(log.read()) == [("held_out_context/A", 1.0), ("held_out_context/B", 2.0)]
    assert log.read().where(F.col("fold").contains("/")).count() == 2
