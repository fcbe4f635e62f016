"""Train/test regimes as rows (regime, fold, cond_id, role) and the leakage checks on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellshift.functions import keyed
from cellshift.operators.pseudobulk import UNKNOWN

REGIMES = ["random", "held_out_context", "held_out_drug", "held_out_both"]
HOLDOUT_SHARE = 0.2
N_DRUG_FOLDS = 5
_DIGITS = 3  # digest prefix for ranking conditions: 4096 buckets


def make_folds(obs: DataFrame, regime: str, seed: int) -> DataFrame:
    """Fold membership of every condition under one regime."""
    if regime not in REGIMES:
        raise ValueError(f"unknown regime {regime!r}; expected one of {REGIMES}")
    absent = [c for c in ("cell_line", "compound", "dose") if c not in obs.columns]
    if absent:
        raise ValueError(f"conditions lack the columns {absent}")
    makers = {"random": _random, "held_out_context": _context, "held_out_drug": _drug, "held_out_both": _both}
    return makers[regime](obs, seed).select(F.lit(regime).alias("regime"), "fold", "cond_id", "role")


def all_folds(obs: DataFrame, seed: int, regimes: list[str] | None = None) -> DataFrame:
    return reduce(DataFrame.unionByName, [make_folds(obs, r, seed) for r in regimes or REGIMES])


def _role(is_test: Column) -> Column:
    return F.when(is_test, "test").otherwise("train")


def _random(obs: DataFrame, seed: int) -> DataFrame:
    n = obs.agg(F.count("*").alias("n")).scalar()
    n_test = F.greatest(F.lit(1), F.bround(n * F.lit(HOLDOUT_SHARE)).cast("long"))
    ranked = keyed.keyed_rank(
        obs.select("cond_id").withColumn("key", keyed.digest(seed, "random", "cond_id")), [], "key", _DIGITS
    )
    return ranked.select(F.lit("random/holdout").alias("fold"), "cond_id", _role(F.col("rank") <= n_test).alias("role"))


def _lines(obs: DataFrame) -> Column:
    """All cell lines as one array value (its length is the number of folds)."""
    return obs.agg(F.sort_array(F.collect_set("cell_line")).alias("lines")).scalar()


def _context(obs: DataFrame, seed: int) -> DataFrame:
    held = obs.select("cond_id", "cell_line", F.explode(_lines(obs)).alias("held"))
    return held.select(
        F.concat(F.lit("held_out_context/"), "held").alias("fold"), "cond_id", _role(F.col("cell_line") == F.col("held")).alias("role")
    )


def compound_groups(obs: DataFrame) -> DataFrame:
    """(compound, group, available): compounds sharing a known target form one group.

    Compounds without annotation stand alone; if none is annotated every compound does.
    """
    known = F.when(~F.lower("target").isin("", "nan", UNKNOWN), F.col("target")) if "target" in obs.columns else F.lit(None).cast("string")
    per = obs.groupBy("compound").agg(F.min(known).alias("known"))
    available = F.coalesce(per.agg(F.bool_or(F.col("known").isNotNull()).alias("a")).scalar(), F.lit(False))
    alone = F.concat(F.lit("__unknown__"), "compound")
    return per.withColumn("available", available).select(
        "compound", F.when(F.col("available"), F.coalesce("known", alone)).otherwise(F.col("compound")).alias("group"), "available"
    )


def compound_buckets(obs: DataFrame, seed: int) -> DataFrame:
    """(compound, group, available, bucket, n_buckets): groups dealt round-robin in digest order."""
    groups = compound_groups(obs)
    names = groups.select("group").distinct()
    ranked = keyed.keyed_rank(names.withColumn("key", keyed.digest(seed, "drug", "group")), [], "key", _DIGITS)
    n = F.least(F.lit(N_DRUG_FOLDS), names.agg(F.count("*").alias("n")).scalar())
    dealt = ranked.withColumn("n_buckets", n.cast("int")).select(
        "group", "n_buckets", F.pmod(F.col("rank") - 1, F.col("n_buckets")).cast("int").alias("bucket")
    )
    return groups.join(dealt, "group")


def _with_both_roles(folds: DataFrame) -> DataFrame:
    sides = folds.groupBy("fold").agg(F.count_if(F.col("role") == "test").alias("n_test"), F.count_if(F.col("role") == "train").alias("n_train"))
    return folds.join(sides.where("n_test > 0 AND n_train > 0").select("fold"), "fold", "left_semi")


def _drug(obs: DataFrame, seed: int) -> DataFrame:
    tagged = obs.select("cond_id", "compound").join(compound_buckets(obs, seed), "compound")
    held = tagged.select("cond_id", "bucket", F.explode(F.sequence(F.lit(0), F.col("n_buckets") - 1)).alias("held"))
    return _with_both_roles(held.select(
        F.concat(F.lit("held_out_drug/fold"), F.col("held")).alias("fold"), "cond_id", _role(F.col("bucket") == F.col("held")).alias("role")
    ))


def _both(obs: DataFrame, seed: int) -> DataFrame:
    tagged = obs.select("cond_id", "cell_line", "compound").join(compound_buckets(obs, seed), "compound")
    held = tagged.select("cond_id", "cell_line", "bucket", "n_buckets", F.explode(_lines(obs)).alias("line")).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("n_buckets") - 1)).alias("held")
    )
    by_line, by_drug = F.col("cell_line") == F.col("line"), F.col("bucket") == F.col("held")
    # touching exactly one held-out axis puts a condition in neither role
    role = F.when(by_line & by_drug, "test").when(~by_line & ~by_drug, "train")
    return _with_both_roles(
        held.select(F.concat(F.lit("held_out_both/"), "line", F.lit("__fold"), F.col("held")).alias("fold"), "cond_id", role.alias("role"))
        .where(F.col("role").isNotNull())
    )


def fold_meta(obs: DataFrame, folds: DataFrame, seed: int) -> DataFrame:
    """What each fold declares to hold out: cell lines, compounds, and whether targets were annotated."""
    nothing = F.array().cast("array<string>")
    unknown = F.lit(None).cast("boolean")
    lines = obs.select("cell_line").distinct()
    buckets = compound_buckets(obs, seed).groupBy("bucket", "available").agg(F.sort_array(F.collect_set("compound")).alias("compounds"))
    per_line = obs.select(F.explode(_lines(obs)).alias("line")).distinct()
    both = buckets.select("*", F.explode(_lines(obs)).alias("line"))
    declared = (
        lines.limit(1).select(F.lit("random/holdout").alias("fold"), nothing.alias("lines"), nothing.alias("compounds"), unknown.alias("available"))
        .unionByName(per_line.select(
            F.concat(F.lit("held_out_context/"), "line").alias("fold"), F.array("line").alias("lines"), nothing.alias("compounds"), unknown.alias("available")))
        .unionByName(buckets.select(
            F.concat(F.lit("held_out_drug/fold"), F.col("bucket")).alias("fold"), nothing.alias("lines"), "compounds", "available"))
        .unionByName(both.select(
            F.concat(F.lit("held_out_both/"), "line", F.lit("__fold"), F.col("bucket")).alias("fold"), F.array("line").alias("lines"), "compounds", "available"))
    )
    return folds.select("regime", "fold").distinct().join(declared, "fold").select(
        "regime", "fold", F.col("lines").alias("held_out_cell_lines"), F.col("compounds").alias("held_out_compounds"),
        F.col("available").alias("target_annotation_available"),
    )


def leakage_violations(obs: DataFrame, folds: DataFrame, meta: DataFrame) -> DataFrame:
    """One row (regime, fold, check, item) per broken rule; empty when the folds are sound.

    What is held out is derived from the rows themselves and compared with the declaration, so a
    fold that leaks and declares nothing is still caught.
    """
    fold = ["regime", "fold"]
    train, test = F.col("role") == "train", F.col("role") == "test"
    rows = folds.join(obs.select("cond_id", "cell_line", "compound"), "cond_id")

    def sides(column: str) -> DataFrame:
        return rows.groupBy(*fold, F.col(column).alias("item")).agg(F.max(train).alias("in_train"), F.max(test).alias("in_test"))

    lines, compounds = sides("cell_line"), sides("compound")
    said_lines = meta.select(*fold, F.explode("held_out_cell_lines").alias("item"))
    said_compounds = meta.select(*fold, F.explode("held_out_compounds").alias("item"))
    by_line = F.col("regime").isin("held_out_context", "held_out_both")
    by_drug = F.col("regime").isin("held_out_drug", "held_out_both")
    test_lines = lines.where("in_test").select(*fold, "item")
    test_compounds = compounds.where("in_test").select(*fold, "item")
    on = [*fold, "item"]
    checks = {
        "duplicate": folds.groupBy(*fold, F.col("cond_id").alias("item"), "role").agg(F.count("*").alias("n")).where("n > 1"),
        "overlap": folds.groupBy(*fold, F.col("cond_id").alias("item")).agg(F.max(train).alias("a"), F.max(test).alias("b")).where("a AND b"),
        "unknown_condition": folds.join(obs, "cond_id", "left_anti").select(*fold, F.col("cond_id").alias("item")),
        "line_in_both_roles": lines.where(by_line & F.col("in_train") & F.col("in_test")),
        "compound_in_both_roles": compounds.where(by_drug & F.col("in_train") & F.col("in_test")),
        "test_line_not_declared": test_lines.where(by_line).join(said_lines, on, "left_anti"),
        "declared_line_not_in_test": said_lines.where(by_line).join(test_lines, on, "left_anti"),
        "test_compound_not_declared": test_compounds.where(by_drug).join(said_compounds, on, "left_anti"),
        "declared_line_in_train": lines.where("in_train").join(said_lines, on, "left_semi"),
        "declared_compound_in_train": compounds.where("in_train").join(said_compounds, on, "left_semi"),
        "test_line_outside_declared": test_lines.join(said_lines.select(*fold).distinct(), fold, "left_semi").join(said_lines, on, "left_anti"),
    }
    found = [df.select(*fold, F.lit(name).alias("check"), F.col("item").cast("string").alias("item")) for name, df in checks.items()]
    return reduce(DataFrame.unionByName, found).distinct()


def assert_no_leakage(obs: DataFrame, folds: DataFrame, meta: DataFrame) -> int:
    """Raise AssertionError if any fold breaks a rule; returns the number of folds checked."""
    broken = leakage_violations(obs, folds, meta)
    shown = broken.limit(20).collect()
    if shown:
        n_folds = broken.select("fold").distinct().count()
        raise AssertionError(f"leakage in {n_folds} fold(s), among them {[r.asDict() for r in shown]}")
    return folds.select("regime", "fold").distinct().count()
