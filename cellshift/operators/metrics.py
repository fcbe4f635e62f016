"""Scoring of predicted against measured deltas, and the split-half ceiling.

Scoring pairs are rows (fold, baseline, target, rep, cond_id, pred, truth, control, de), the last four
being arrays over the fold's genes. Moments over genes are taken by unnesting and partially
aggregating in place, so nothing long is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellshift.functions import arrays, keyed
from cellshift.session import materialize

# The metrics and the direction in which each improves.
METRIC_DIRECTION = {
    "pearson_r": "higher_better",
    "mae": "lower_better",
    "pearson_r_de": "higher_better",
    "direction_acc_de": "higher_better",
    "pert_discrimination": "lower_better",
}
REPRESENTATIONS = ("delta", "absolute")
FULL, HALF = "full_pseudobulk", "replicate_half"
TARGETS = (HALF, FULL)
CEILING = "ceiling"

KEYS = ["fold", "baseline", "target", "rep", "cond_id"]
BLOCK_ROWS = 256
SHARED_PREDICTIONS = 4096  # so many are measured against every truth at once


def check_representation(representation: str) -> None:
    if representation not in REPRESENTATIONS:
        raise ValueError(f"representation is {representation!r}; expected one of {REPRESENTATIONS}")


def truths(exposures: DataFrame, profiles: DataFrame, de: DataFrame, n_genes: int) -> DataFrame:
    """(fold, cond_id, control, delta, de) of every test condition on its fold's genes; de is 1.0 or 0.0."""
    marks = F.transform("de", lambda g: F.struct(g.alias("at"), F.lit(1.0).alias("one")))
    flags = de.select("cond_id", arrays.densify(marks, "at", "one", n_genes).alias("flags"))
    rows = exposures.select("fold", "cond_id", "genes").join(profiles.select("cond_id", "control", "delta"), "cond_id").join(flags, "cond_id")
    take = lambda c: arrays.gather(F.col(c), F.col("genes"))
    return rows.select("fold", "cond_id", take("control").alias("control"), take("delta").alias("delta"), take("flags").alias("de"))


def half_truths(exposures: DataFrame, halves: DataFrame) -> DataFrame:
    """(fold, cond_id, rep, h0, h1) on the fold's genes; conditions without halves are left out."""
    rows = exposures.select("fold", "cond_id", "genes").join(halves.where("h0 IS NOT NULL"), "cond_id")
    take = lambda c: arrays.gather(F.col(c), F.col("genes"))
    return rows.select("fold", "cond_id", "rep", take("h0").alias("h0"), take("h1").alias("h1"))


def scoring_pairs(predictions: DataFrame | None, truth: DataFrame, half: DataFrame) -> DataFrame:
    """All scoring pairs: predictions against the full delta and against each repetition's second
    half, and, as the ceiling, first halves against second halves."""
    common = ["control", "de"]
    ceiling = half.join(truth.drop("delta"), ["fold", "cond_id"]).select(
        "fold", F.lit(CEILING).alias("baseline"), F.lit(HALF).alias("target"), "rep", "cond_id",
        F.col("h0").alias("pred"), F.col("h1").alias("truth"), *common,
    )
    if predictions is None:
        return ceiling
    pred = predictions.select("fold", "cond_id", "baseline", "pred").join(truth, ["fold", "cond_id"])
    full = pred.select("fold", "baseline", F.lit(FULL).alias("target"), F.lit(-1).alias("rep"), "cond_id", "pred", F.col("delta").alias("truth"), *common)
    replicate = pred.drop("delta").join(half.drop("h0"), ["fold", "cond_id"]).select(
        "fold", "baseline", F.lit(HALF).alias("target"), "rep", "cond_id", "pred", F.col("h1").alias("truth"), *common
    )
    return full.unionByName(replicate).unionByName(ceiling)


def truth_pools(truth: DataFrame, half: DataFrame) -> DataFrame:
    """(fold, target, rep, cond_id, truth, control): the truths a prediction is ranked among."""
    full = truth.select("fold", F.lit(FULL).alias("target"), F.lit(-1).alias("rep"), "cond_id", F.col("delta").alias("truth"), "control")
    replicate = half.join(truth.select("fold", "cond_id", "control"), ["fold", "cond_id"]).select(
        "fold", F.lit(HALF).alias("target"), "rep", "cond_id", F.col("h1").alias("truth"), "control"
    )
    return full.unionByName(replicate)


def _pearson(p: Column, t: Column, n: Column) -> Column:
    """Pearson r from central moments; NULL for fewer than two values or an exactly constant side.

    Two values correlate with exactly +1 or -1, whatever the rounding of the moments.
    """
    constant = (F.min(p) == F.max(p)) | (F.min(t) == F.max(t))
    r = F.try_divide(F.covar_pop(p, t), F.sqrt(F.var_pop(p)) * F.sqrt(F.var_pop(t)))
    return F.when((n == 2) & ~constant, F.signum(F.covar_pop(p, t))).when((n > 2) & ~constant, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def condition_metrics(pairs: DataFrame, representations: tuple[str, ...] = REPRESENTATIONS) -> DataFrame:
    """Per scoring pair and representation: pearson_r, mae, pearson_r_de, direction_acc_de."""
    for representation in representations:
        check_representation(representation)
    zipped = F.arrays_zip("pred", "truth", "control", "de")
    genes = pairs.select(*KEYS, F.explode(zipped).alias("g")).select(
        *KEYS, F.col("g.pred").alias("p"), F.col("g.truth").alias("t"), F.col("g.control").alias("c"), (F.col("g.de") > 0).alias("de")
    )
    aggregates = []
    n, n_de = F.count("*"), F.count_if("de")
    for rep in representations:
        p, t = (F.col("p"), F.col("t")) if rep == "delta" else (F.col("c") + F.col("p"), F.col("c") + F.col("t"))
        pd_, td = F.when(F.col("de"), p), F.when(F.col("de"), t)
        same = F.when(F.col("de"), (F.signum(p) == F.signum(t)).cast("double"))
        aggregates.append(F.struct(
            F.lit(rep).alias("representation"),
            _pearson(p, t, n).alias("pearson_r"),
            F.avg(F.abs(p - t)).alias("mae"),
            _pearson(pd_, td, n_de).alias("pearson_r_de"),
            F.when(n_de >= 2, F.avg(same)).alias("direction_acc_de"),
        ).alias(rep))
    return (
        genes.groupBy(*KEYS).agg(*aggregates)
        .select(*KEYS, F.explode(F.array(*representations)).alias("m"))
        .select(*KEYS, "m.*")
    )


def rank_counts(pred: np.ndarray, own: np.ndarray, truths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per prediction: how many truths are nearer than its own one, and how many are exactly as near.

    Equal predictions are measured once. A matrix product tells all squared distances but for its rounding, whose bound
    settles nearly every comparison; what lies within the bound is measured again on the values themselves, by the
    same kernel as the own truth, so that equal profiles are exactly equally near.
    """

    def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(((a - b) ** 2).sum(axis=1))

    distinct, which = np.unique(pred, axis=0, return_inverse=True)
    which = which.reshape(-1)
    middle = np.nan_to_num(truths.mean(axis=0), posinf=0.0, neginf=0.0)  # distances don't change, products get smaller
    p, t, o = distinct - middle, truths - middle, own - middle
    pp, tt = (p * p).sum(axis=1), (t * t).sum(axis=1)
    rough = pp[:, None] + tt[None, :] - 2 * (p @ t.T)
    mine = ((o - p[which]) ** 2).sum(axis=1)
    slack = 16 * np.finfo(float).eps * (pred.shape[1] + 4) * (pp[which] + tt.max() + (o * o).sum(axis=1) + (middle * middle).sum())
    told = np.isfinite(mine + slack)  # where nothing bounds the rounding all is measured again
    mine, slack = np.where(told, mine, 0.0), np.where(told, slack, np.inf)
    order = np.sort(rough, axis=1)
    nearer, tied = np.zeros(len(pred), np.int64), np.zeros(len(pred), np.int64)
    for k in range(len(distinct)):
        at = np.flatnonzero(which == k)
        low, high = np.searchsorted(order[k], mine[at] - slack[at]), np.searchsorted(order[k], mine[at] + slack[at], "right")
        nearer[at] = low
        if not (high > low).any():
            continue
        by_distance = np.argsort(rough[k], kind="stable")
        rows = np.repeat(at, high - low)
        ends = np.cumsum(high - low)
        cols = by_distance[np.arange(len(rows)) + np.repeat(low - ends + (high - low), high - low)]
        d, limit = exact(truths[cols], pred[rows]), exact(own[rows], pred[rows])
        np.add.at(nearer, rows[d < limit], 1)
        np.add.at(tied, rows[d == limit], 1)
    return nearer, tied


def pert_discrimination(
    pairs: DataFrame, pools: DataFrame, n_blocks: int | None = None, representations: tuple[str, ...] = REPRESENTATIONS
) -> DataFrame:
    """Per scoring pair and representation: the normalised rank of its own truth, among all truths of
    its fold and repetition, by Euclidean distance to its prediction; ties take the average rank.

    The definition compares every prediction with every truth of the fold. Conditions are hashed
    into blocks of about BLOCK_ROWS rows; one task compares one block of predictions with one block
    of truths and returns, per prediction, how many truths are nearer and how many tie (rank_counts). No
    pair is ever a row, and a task's input is two blocks however large the fold is.
    """
    for representation in representations:
        check_representation(representation)
    pool = ["fold", "target", "rep"]
    sizes = pools.groupBy(*pool).agg(F.count("*").alias("n_pool"))
    blocks = F.lit(n_blocks) if n_blocks else F.ceil(F.col("n_pool") / BLOCK_ROWS)
    sized = sizes.withColumn("n_blocks", blocks.cast("int"))
    own_block = F.pmod(F.xxhash64("cond_id"), F.col("n_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    queries = pairs.join(sized, pool).select(*KEYS, "pred", "truth", "control", own_block.alias("qb"), other.alias("tb"))
    candidates = pools.join(sized, pool).select(*pool, "cond_id", "truth", "control", own_block.alias("tb"), other.alias("qb"))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=[*KEYS, "representation", "nearer", "tied"])
        truth, control = np.stack(right.truth.to_list()), np.stack(right.control.to_list())
        own, base, pred = (np.stack(left[c].to_list()) for c in ("truth", "control", "pred"))
        out = []
        for name in representations:
            t, o, p = (truth, own, pred) if name == "delta" else (truth + control, own + base, pred + base)
            nearer, tied = rank_counts(p, o, t)
            out.append(left[KEYS].assign(representation=name, nearer=nearer, tied=tied))
        return pd.concat(out, ignore_index=True)

    counted = queries.groupBy(*pool, "qb", "tb").cogroup(arrays.fresh(candidates).groupBy(*pool, "qb", "tb")).applyInPandas(
        compare, "fold string, baseline string, target string, rep int, cond_id string, representation string, nearer long, tied long"
    )
    rank0 = F.sum("nearer") + (F.sum("tied") - 1) / 2
    return counted.groupBy(*KEYS, "representation").agg(rank0.alias("rank0")).join(sizes, pool).select(
        *KEYS, "representation", F.try_divide(F.col("rank0"), F.col("n_pool") - 1).alias("pert_discrimination")
    )


def shared_discrimination(pairs: DataFrame, pools: DataFrame, name: str) -> DataFrame:
    """`pert_discrimination` of deltas where few predictions are shared by many pairs: column `name` of the pairs names a
    prediction of its pool. Every truth is measured against every prediction once, by the kernel of rank_counts, and a pair's rank is
    read from the distances in order: they are range-partitioned, counted per range and cumulated inside it, so
    the work grows with truths times predictions and no task holds the distances of a prediction. Beyond
    SHARED_PREDICTIONS the pairs are compared in blocks. A missing truth has no rank and is not ranked among.
    """
    pool = ["fold", "target", "rep"]
    unknown = pairs.where("truth IS NULL").select(*KEYS, F.lit("delta").alias("representation"), F.lit(None).cast("double").alias("pert_discrimination"))
    pairs, pools = pairs.where("truth IS NOT NULL"), pools.where("truth IS NOT NULL")
    named = pairs.groupBy(*pool, name).agg(F.first("pred").alias("pred")).limit(SHARED_PREDICTIONS + 1).collect()
    if len(named) > SHARED_PREDICTIONS:
        return pert_discrimination(pairs, pools, representations=("delta",)).unionByName(unknown)
    centres: dict[tuple, list] = {}
    for at, r in enumerate(named):
        centres.setdefault((r["fold"], r["target"], r["rep"]), []).append((at, r[name], np.array(r["pred"], dtype=float)))
    spark = pairs.sparkSession
    shared = spark.sparkContext.broadcast(centres)

    def distances(truths: np.ndarray, pred: np.ndarray) -> np.ndarray:
        return np.sqrt(((truths - pred) ** 2).sum(axis=1))

    def measured(keys: list[str], own: bool):
        """Rows (keys, at, d): the distance of each truth to its own prediction or to all of its pool."""

        def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, 1024):
                    batch = whole.slice(start, 1024)
                    columns = {c: batch.column(c).to_pylist() for c in [*pool, *([name] if own else [])]}
                    truths = np.array(batch.column("truth").to_pylist(), dtype=float)
                    groups: dict[tuple, list[int]] = {}
                    for i, g in enumerate(zip(*(columns[c] for c in pool), strict=True)):
                        groups.setdefault(g, []).append(i)
                    for g, members in groups.items():
                        rows = np.array(members)
                        for at, called, pred in shared.value.get(g, ()):
                            mine = rows[[columns[name][i] == called for i in members]] if own else rows
                            if len(mine):
                                kept = batch.select(keys).take(pa.array(mine))
                                columns_out = [*kept.columns, pa.array(np.full(len(mine), at, np.int32)), pa.array(distances(truths[mine], pred))]
                                yield pa.RecordBatch.from_arrays(columns_out, names=[*keys, "at", "d"])

        return compute

    def fields(df: DataFrame, keys: list[str]) -> str:
        return ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in keys), "at int", "d double"])

    told = ~F.isnan("d")  # an undefined distance is neither nearer nor as near
    all_of = pools.select(*pool, "truth").mapInArrow(measured([], False), fields(pools, [])).where(told)
    hist = materialize(all_of.groupBy("at", "d").agg(F.count("*").alias("tied")), "distances")
    ranged = materialize(hist.repartitionByRange("at", "d").withColumn("part", F.spark_partition_id()), "ranged")
    parts = ranged.groupBy("at", "part").agg(F.sum("tied").alias("n"))
    earlier = Window.partitionBy("at").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = parts.select("at", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("at", "part").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranged.withColumn("inside", F.coalesce(F.sum("tied").over(inside), F.lit(0))).join(offsets, ["at", "part"])
    ranked = ranked.select("at", "d", (F.col("before") + F.col("inside")).alias("nearer"), "tied")
    queries = pairs.select(*KEYS, name, "truth").mapInArrow(measured(KEYS, True), fields(pairs, KEYS))
    counted = queries.join(ranked, ["at", "d"], "left")
    rank0 = F.coalesce(F.sum("nearer"), F.lit(0)) + (F.coalesce(F.sum("tied"), F.lit(0)) - 1) / 2
    sizes = pools.groupBy(*pool).agg(F.count("*").alias("n_pool"))
    ranks = counted.groupBy(*KEYS).agg(rank0.alias("rank0")).join(sizes, pool).select(
        *KEYS, F.lit("delta").alias("representation"), F.try_divide(F.col("rank0"), F.col("n_pool") - 1).alias("pert_discrimination")
    )
    return ranks.unionByName(unknown)


def score_conditions(pairs: DataFrame, pools: DataFrame, representations: tuple[str, ...] = REPRESENTATIONS) -> DataFrame:
    """All five metrics per scoring pair and representation."""
    ranks = pert_discrimination(pairs, pools, representations=representations)
    return condition_metrics(pairs, representations).join(ranks, [*KEYS, "representation"])


def unpivot(scores: DataFrame) -> DataFrame:
    """One row per (pair, representation, metric) with `v`."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRIC_DIRECTION])
    return scores.select(*KEYS, "representation", F.explode(each).alias("m")).select(*KEYS, "representation", "m.metric", "m.v")


def aggregate(values: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Mean, sample deviation (0 for one value), number of defined values and number skipped."""
    n = F.count(value)
    return values.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.when(n == 1, F.lit(0.0)).otherwise(F.stddev_samp(value)).alias("std"),
        n.alias("n"),
        (F.count("*") - n).alias("n_skipped"),
    )


LEAF_RANKS, SHARD_RANKS = 64, 4096  # values drawn among at once, and in one task; a shard is a whole number of leaves, a power of two


def bootstrap_ci(
    values: DataFrame, keys: list[str], order: list[str], seed: int, n_boot: int = 1000, alpha: float = 0.05, value: str = "v"
) -> DataFrame:
    """(keys, ci_low, ci_high): percentile bootstrap interval of the mean of the defined values.

    A group's values are ranked by a keyed digest of their order columns. A binary tree stands over the ranks: its root
    holds as many draws as there are values, every node gives its left half a binomial share, and a leaf deals its draws
    evenly. A node's generator is seeded by (seed, group, node) alone, so every task that needs a node gets the same
    numbers, a value's weight depends on its rank and the group's size only, and shards of any number give
    the sums of one n-of-n resample. Sums add up in a grouped aggregation, no task holds a group. One value gives
    (v, v), none gives NULLs.
    """
    group_id = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    present = values.where(F.col(value).isNotNull()).select(*keys, value, keyed.digest(seed, "bootstrap", *keys, *order).alias("_key"))
    counts = present.groupBy(*keys).agg(F.count("*").alias("n_values"))
    largest = counts.agg(F.max("n_values")).first()[0] or 0
    ranked = keyed.keyed_rank(present, keys, "_key", keyed.prefix_length(largest)).withColumn("shard", F.floor((F.col("rank") - 1) / SHARD_RANKS).cast("int"))
    packed = ranked.groupBy(*keys, "shard").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", value))), lambda e: e[value]).alias("vals"))
    drawn = packed.join(counts, keys).select(*keys, "n_values", F.posexplode(_resampled(n_boot)("vals", "shard", "n_values", group_id)).alias("b", "part"))
    means = drawn.groupBy(*keys, "n_values", "b").agg((F.sum("part") / F.col("n_values")).alias("mean"))
    ends = means.groupBy(*keys).agg(F.sort_array(F.collect_list("mean")).alias("means")).select(
        *keys, _sorted_percentile("means", alpha / 2, n_boot).alias("ci_low"), _sorted_percentile("means", 1 - alpha / 2, n_boot).alias("ci_high")
    )
    return values.select(*keys).distinct().join(ends, keys, "left")


def _sorted_percentile(values: str, p: float, length: int) -> Column:
    """Linearly interpolated percentile of an ascending array of known length."""
    at = p * (length - 1)
    low = math.floor(at)
    a, b = F.get(values, low), F.get(values, min(low + 1, length - 1))
    return a + F.lit(at - low) * (b - a)


def draw_weights(base: int, n: int, n_boot: int, first: int, last: int) -> Iterator[np.ndarray]:
    """How often each resample draws each of the ranks first to last - 1 (from 0) of n, leaf by leaf: n_boot rows, a column per rank."""

    def below(a: int, b: int, draws: np.ndarray) -> Iterator[np.ndarray]:
        """Leaves a to b - 1, which hold `draws` of each resample together."""
        if a * LEAF_RANKS >= last or b * LEAF_RANKS <= first:
            return
        rng = np.random.default_rng([base, a, b])
        if b - a == 1:
            size = min(n, b * LEAF_RANKS) - a * LEAF_RANKS
            yield rng.multinomial(draws, np.full(size, 1 / size))
            return
        half = a + (1 << (b - a - 1).bit_length() - 1)  # left sides are full, so that shards are subtrees
        share = (half - a) * LEAF_RANKS / (min(n, b * LEAF_RANKS) - a * LEAF_RANKS)
        left = rng.binomial(draws, share)
        yield from below(a, half, left)
        yield from below(half, b, draws - left)

    return below(0, -(-n // LEAF_RANKS), np.full(n_boot, n))


def _resampled(n_boot: int):
    @F.pandas_udf("array<double>")
    def sums(vals: pd.Series, shards: pd.Series, sizes: pd.Series, key: pd.Series) -> pd.Series:
        import hashlib

        out = []
        for v, shard, n, k in zip(vals, shards, sizes, key):
            v = np.asarray(v, float)
            if n == 1:
                out.append(np.full(n_boot, v[0]))
                continue
            base, total, at = int(hashlib.md5(k.encode()).hexdigest()[:15], 16), np.zeros(n_boot), 0
            for weights in draw_weights(base, int(n), n_boot, int(shard) * SHARD_RANKS, int(shard) * SHARD_RANKS + len(v)):
                total += weights @ v[at : at + weights.shape[1]]
                at += weights.shape[1]
            out.append(total)
        return pd.Series(out)

    return sums
