"""Models fitted on every row, over one table of signals."""

from __future__ import annotations

from lineament.operators import learning
from lineament.plans import queries


def test_models_are_fitted_on_every_row(spark):
    rows = [(k, "rust", {"rust.idioms.string_concat": 1.0} if k % 3 else {"metric:avg_complexity": -0.5}, "human" if k % 3 else "gpt") for k in range(6000)]
    model = learning.fit(spark.createDataFrame(rows, "unit_id long, language string, features map<string, double>, family string"), "family")
    assert model.metadata.training_samples == 6000 and model.metadata.coverage == {"rust": {"gpt": 2000, "human": 4000}}


def test_vectors_hold_what_is_not_zero(spark):
    rows = spark.createDataFrame([(1, {"b": 2.0, "zz": 9.0}), (2, {"c": -1.0, "a": 3.0}), (3, {})], "unit_id long, features map<string, double>")
    got = {r.unit_id: (list(r._x.toArray()), list(r._n.toArray())) for r in learning.vectors(rows, ["a", "b", "c"]).collect()}
    assert got == {1: ([0, 2, 0], [0, 2, 0]), 2: ([3, 0, -1], [4, 1, 0]), 3: ([0, 0, 0], [0, 0, 0])}


def test_verdicts_are_blended_over_one_table_of_signals(spark):
    d = "/root/testdata/sf0.001"
    got = queries.QUERIES["rescored_verdicts"](spark, d)
    labelled = queries.full_verdicts(spark, d).where("signal_count > 0").count()
    assert got.count() == labelled == got.select("unit_id").distinct().count()
