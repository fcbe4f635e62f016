"""Predictions that many pairs share are ranked without comparing all with all."""

import numpy as np
from pyspark.sql import functions as F

from cellshift.operators import metrics


def test_shared_predictions_rank_as_blocks_do(spark):
    """Two pools, three shared predictions; ties, equal rows, an undefined value, a repeated and a null id; a missing truth has no rank."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(3, 4)).round(1)
    truths = rng.integers(0, 3, (300, 4)).astype(float)
    truths[7, 2] = np.nan
    rows = [("f" if i % 3 else "g", "t", 0, None if i == 4 else str(i % 288), truths[i].tolist(), [0.0] * 4, int(i % 3)) for i in range(300)]
    base = spark.createDataFrame(rows, "fold string, target string, rep int, cond_id string, truth array<double>, control array<double>, name int").repartition(4)
    named = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "name int, pred array<double>")
    pairs = base.join(named, "name").withColumn("baseline", F.lit("b"))
    read = lambda df: {(r["fold"], r["cond_id"]): r["pert_discrimination"] for r in df.collect()}
    want = read(metrics.pert_discrimination(pairs, base, n_blocks=3, representations=("delta",)))
    assert read(metrics.shared_discrimination(pairs, base, "name")) == want and len(want) == 289
    lost = base.limit(1).withColumn("cond_id", F.lit("lost")).withColumn("truth", F.lit(None).cast("array<double>"))
    more = metrics.shared_discrimination(pairs.unionByName(lost.join(named, "name").withColumn("baseline", F.lit("b"))), base.unionByName(lost), "name")
    found = read(more)
    assert {k: v for k, v in found.items() if k[1] != "lost"} == want and [v for k, v in found.items() if k[1] == "lost"] == [None]
