"""The runners' rows against the queries they measure."""

import pytest

from tessera import experiments
from tessera.functions.dialect import Spark
from tessera.plans import authenticated
from tessera.plans.queries import QUERIES
from tessera.plans.world import matrix

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("engine", ["lists", "tree"])
def test_cross_range(spark, tmp_path, engine):
    some = f"SELECT * FROM ({matrix(Spark)}) m WHERE side IN (2, 5) AND span = 86400"
    rows = experiments.cross_range(spark, SF, str(tmp_path), engine, windows=some)
    assert len(rows) == 2 and all(len(r) == 22 for r in rows)
    want = {r["query_id"]: r for r in QUERIES["coarse_fine_counts_by_window"](spark, SF).collect()}
    for r in rows:
        cell = want[f"{r['spatial_side_km']}km_86400s"]
        assert (r["candidate_trajectory_count"], r["final_trajectory_count"]) == (cell["n_coarse"], cell["n_exact"])
        assert r["verification_set_count"] >= r["candidate_trajectory_count"] and r["vo_size_bytes"] > 0
    assert spark.read.csv(f"{tmp_path}/cross_range_results", header=True).count() == 2
    assert spark.read.csv(f"{tmp_path}/vo_size_mb_matrix", header=True).columns == ["temporal_seconds", "temporal_label", "2", "5"]


def test_scaling_and_update(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(experiments, "PERCENT", (40, 100))
    monkeypatch.setattr(experiments, "BATCHES", (10,))
    rows = experiments.scaling(spark, SF, str(tmp_path))
    want = {r["pct"]: (r["n_trajectories"], r["n_entries"]) for r in QUERIES["scaling_prefix_counts"](spark, SF).collect()}
    assert {r["pct"]: (r["n_trajectories"], r["n_entries"]) for r in rows} == {p: want[p] for p in (40, 100)}
    assert rows[-1]["root"] == authenticated.l0_root(spark, SF).first()["root"]
    (batch,) = experiments.update(spark, SF, str(tmp_path))
    assert batch["equals_rebuild"] and batch["n_trajectories"] == 1
