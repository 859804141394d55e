"""Markov models over whole sequences: the same as by joins."""

from __future__ import annotations

import random

import pytest

from lineament.operators import markov
from lineament.plans import queries


def made(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for s in range(60):
        language, family = f"l{s % 2}", f"f{rnd.randint(0, 3)}"
        rows += [(language, family, s, i, rnd.choice("abcd") if rnd.random() > 0.02 else None) for i in range(rnd.choice([1, 2, 3, 5, 20]))]
    return spark.createDataFrame(rows, "language string, family string, seq_id long, pos int, token string")


def test_counts_of_whole_sequences_are_those_of_places(spark, monkeypatch):
    rows = made(spark, 1)
    monkeypatch.setattr(markov, "MOST_KINDS", 20)
    key = lambda df: sorted(map(str, df.select("language", "family", "order", "context", "next", "count", "total", "prob").collect()))
    assert key(markov.smoothed(markov.counted_orders(markov.whole(rows)), 5)) == key(markov.trained_orders(markov.ngrams(rows), 5))


def test_a_model_sent_along_says_what_joins_say(spark, monkeypatch):
    train, new = made(spark, 2), made(spark, 3).drop("family")
    model = markov.trained_orders(markov.ngrams(train), 6).persist()
    got = {(r.seq_id, r.family): (r.order, r.prob) for r in markov.backed_off(new, model, 6).collect()}
    want = {(r.seq_id, r.family): (r.order, r.prob) for r in markov.joined_orders(new, model, 6).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)
    monkeypatch.setattr(markov, "MOST_SENT", 3)
    assert {(r.seq_id, r.family): r.order for r in markov.backed_off(markov.whole(new), model, 6).collect()} == {k: v[0] for k, v in want.items()}


@pytest.mark.parametrize("name", ["markov_nodes", "markov_backoff"])
def test_sequences_stay_in_their_rows(spark, name):
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
