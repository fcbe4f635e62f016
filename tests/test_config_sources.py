import pytest

from cellshift.config import Config
from cellshift.sources.assay import get_loader, pick_column, register_loader, standardize_cells


def test_yaml_is_strict(tmp_path):
    good = tmp_path / "good.yaml"
    good.write_text("seed: 3\nn_hvg: 10\n")
    assert Config.from_yaml(good).seed == 3
    bad = tmp_path / "bad.yaml"
    bad.write_text("sead: 3\n")
    with pytest.raises(ValueError, match="sead"):
        Config.from_yaml(bad)


def test_config_validation():
    with pytest.raises(ValueError):
        Config(gene_set="top")
    with pytest.raises(ValueError):
        Config(gene_set="hvg", n_hvg=None)


def test_cache_key_follows_content_only():
    base = Config().cache_key("a")
    assert Config(out_dir="x", cache_dir="y").cache_key("a") == base
    for change in ({"seed": 1}, {"n_hvg": 5}, {"gene_set": "all"}, {"de_alpha": 0.1}, {"min_genes": 1}):
        assert Config(**change).cache_key("a") != base
    assert Config().cache_key("b") != base


def test_registry():
    with pytest.raises(KeyError):
        get_loader("unregistered")
    with pytest.raises(KeyError):
        get_loader("nope")
    register_loader("mine", lambda spark, path: path)
    assert get_loader("mine")(None, "p") == "p"


def test_column_detection(spark):
    assert pick_column(["Plate", "Cell_Type"], ["cell_line", "cell_type"]) == "Cell_Type"
    assert pick_column(["x"], ["y"]) is None
    rows = [(1, "A", "DMSO", "oops", None), (2, "A", "drug", "10", "T1")]
    obs = spark.createDataFrame(rows, "cell_id long, celltype string, drug string, dose string, moa string")
    cells, names = standardize_cells(obs)
    got = {r.cell_id: r for r in cells.collect()}
    assert got[1].is_control and not got[2].is_control
    assert got[1].dose == 0.0 and got[2].dose == 10.0
    assert names["batch"] is None and got[1].batch == "__no_batch__"
    with pytest.raises(RuntimeError, match="compound"):
        standardize_cells(obs.drop("drug"))
