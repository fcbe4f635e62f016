"""Steps whose work must grow no faster than the input, against the plainer definitions."""

from pyspark.sql import functions as F

from cellshift.functions import keyed
from cellshift.operators import de
from cellshift.session import materialize
from cellshift.sources.assay import assay_from_long


def test_central_cutoffs_equal_those_of_all_buckets(spark):
    """Large and small groups, and groups of equal keys, whose cutoff is far from where a uniform digest has it."""
    rows = [("big", f"{i}") for i in range(4000)] + [("small", f"s{i}") for i in range(3)]
    rows += [("equal", "same")] * 900 + [("equal", f"e{i}") for i in range(50)] + [("twice", f"t{i // 2}") for i in range(600)]
    df = spark.createDataFrame(rows, "g string, id string").withColumn("key", keyed.digest(0, "x", "id")).select("g", "key")
    groups = df.groupBy("g").agg(F.count("*").alias("size")).withColumn("take", F.floor(F.col("size") / 2))
    want = keyed.keyed_cutoff(df.join(groups.select("g", "take"), "g"), ["g"], "key", "take", 2).collect()
    moved = {}

    def keep(table, name):
        stored = materialize(table, name)
        moved[name] = stored.count()
        return stored

    got = keyed.central_cutoff(df, groups, ["g"], "key", 2, keep).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) == 4 and moved == {"cutoffs": 3}


def test_values_are_exchanged_once_to_be_counted(spark):
    """From placed expression to bucket sums no row moves twice."""
    placed = spark.createDataFrame([(1, 2, 3, 0.5), (1, 2, None, 0.5)], "plate_id long, gene_idx int, pair_id long, value double")
    plan = de.bucket_sums(de.value_histogram(placed))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_counts_are_exchanged_once_per_cell(spark):
    """Sums per gene and vectors per cell come from one exchange; counts without a cell go nowhere, cells without counts stay."""
    obs = spark.createDataFrame([(1, "A", "d", 1.0), (2, "A", "control", 0.0), (None, "A", "d", 1.0)], "cell_id long, cell_line string, compound string, dose double")
    counts = spark.createDataFrame([(1, 5, 2), (1, 5, 3), (1, 6, 1), (None, 5, 9)], "cell_id long, gene_id int, count int")
    genes = spark.createDataFrame([(5, "a"), (6, "b")], "gene_id int, gene string")
    cells = assay_from_long(obs, counts, genes).cells
    assert "Exchange hashpartitioning(cell_id#" in (plan := cells._jdf.queryExecution().executedPlan().toString()) and ", gene_id#" not in "".join(
        line for line in plan.splitlines() if "Exchange hashpartitioning" in line
    )
    found = {r["cell_id"]: sorted((f["gene_id"], f["count"]) for f in r["features"]) for r in cells.collect()}
    assert found == {1: [(5, 5.0), (6, 1.0)], 2: [], None: []}
