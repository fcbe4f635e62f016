"""Each of the eleven rules broken on its own."""

import pytest
from pyspark.sql import functions as F

from cellshift.operators import splits
from tests.test_models import grid  # noqa: F401  fixture


def _none():
    return F.array().cast("array<string>")


@pytest.fixture(scope="module")
def sound(grid):  # noqa: F811
    both = splits.make_folds(grid, "held_out_both", 0)
    fold = both.where("role = 'test'").agg(F.min("fold")).first()[0]
    folds = both.where(F.col("fold") == fold).cache()
    return folds, splits.fold_meta(grid, folds, 0).cache()


def _broken(grid, folds, meta):  # noqa: F811
    return {r.check for r in splits.leakage_violations(grid, folds, meta).collect()}


def test_sound_folds_break_nothing(grid, sound):  # noqa: F811
    assert _broken(grid, *sound) == set()


def test_rows(grid, sound):  # noqa: F811
    folds, meta = sound
    test = folds.where("role = 'test'")
    assert _broken(grid, folds.unionByName(test), meta) == {"duplicate"}
    assert _broken(grid, folds.unionByName(test.limit(1).withColumn("cond_id", F.lit("nowhere"))), meta) == {"unknown_condition"}
    leak = test.limit(1).withColumn("role", F.lit("train"))
    assert _broken(grid, folds.unionByName(leak), meta) == {
        "overlap", "line_in_both_roles", "compound_in_both_roles", "declared_line_in_train", "declared_compound_in_train"
    }


def test_held_out_line_and_compound_alone(grid, sound):  # noqa: F811
    """Another compound of the held-out line in training breaks the line's rules alone, and the other way round."""
    folds, meta = sound
    said = meta.first()
    line, compounds = F.col("cell_line") == said.held_out_cell_lines[0], F.col("compound").isin(list(said.held_out_compounds))
    as_train = lambda where: grid.where(where).select(F.lit("held_out_both").alias("regime"), F.lit(said.fold).alias("fold"), "cond_id", F.lit("train").alias("role"))
    assert _broken(grid, folds.unionByName(as_train(line & ~compounds)), meta) == {"line_in_both_roles", "declared_line_in_train"}
    assert _broken(grid, folds.unionByName(as_train(~line & compounds)), meta) == {"compound_in_both_roles", "declared_compound_in_train"}


def test_declarations(grid, sound):  # noqa: F811
    folds, meta = sound
    assert _broken(grid, folds, meta.withColumn("held_out_cell_lines", _none())) == {"test_line_not_declared"}
    assert _broken(grid, folds, meta.withColumn("held_out_compounds", _none())) == {"test_compound_not_declared"}
    assert _broken(grid, folds, meta.withColumn("held_out_cell_lines", F.array(F.lit("elsewhere")))) == {
        "test_line_not_declared", "declared_line_not_in_test", "test_line_outside_declared"
    }
