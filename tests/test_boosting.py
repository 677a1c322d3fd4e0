"""Boosted trees against a plain version that splits a leaf at a time over rows held in one array."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_operators import events_of_days
from tidemark.operators import boosting, models
from tidemark.operators.boosting import Boosting


def plain(bins, y, ids, s):
    """Scores of all rows; those beyond y are carried to the leaves they fall in and take part in no sum."""
    n, score = len(y), np.full(len(bins), y.mean())
    for nth in range(s.trees):
        some = boosting.drawn(ids, s, nth)
        some = np.ones(n, bool) if some is None else some
        use, g = boosting.allowed(bins.shape[1], s, nth), score[:n] - y
        leaves = [np.arange(len(bins))]

        def best(rows):
            own = rows[rows < n]
            own, top = own[some[own]], None
            for j in np.flatnonzero(use):
                for cut in range(s.bins):
                    left = bins[own, j] <= cut
                    a, b = g[own[left]], g[own[~left]]
                    if min(len(a), len(b)) >= s.least:
                        gain = a.sum() ** 2 / (len(a) + s.shrink) + b.sum() ** 2 / (len(b) + s.shrink) - g[own].sum() ** 2 / (len(own) + s.shrink)
                        if gain > 1e-12 and (top is None or gain > top[0] * (1 + boosting.TIE)):
                            top = (gain, j, cut)
            return top

        found = [best(leaves[0])]
        while len(leaves) < s.leaves and any(found):
            i = max((k for k in range(len(leaves)) if found[k]), key=lambda k: found[k][0])
            rows, (_, j, cut) = leaves[i], found[i]
            left = bins[rows, j] <= cut
            leaves[i], found[i] = rows[left], best(rows[left])
            leaves.append(rows[~left])
            found.append(best(rows[~left]))
        for rows in leaves:
            own = rows[rows < n]
            own = own[some[own]]
            score[rows] -= s.step * g[own].sum() / (len(own) + s.shrink)
    return score


@pytest.mark.parametrize("settings", [Boosting(trees=7, leaves=9, bins=16, keep=3, checkpoint=6, step=0.3, local=0), Boosting(trees=4, leaves=31, bins=16, step=0.3, local=60), Boosting(trees=4, leaves=31, bins=16, least=3, step=0.3), Boosting(trees=5, leaves=31, bins=8, least=5, every=2, rows=0.7, step=0.5), Boosting(trees=2, leaves=4, least=10_000)])
def test_trees_are_those_of_a_leaf_at_a_time(spark, settings):
    rows, data = events_of_days(spark, 20)
    start = dt.date(2024, 1, 21)
    train, test = [r for r in rows if r[3] < start - dt.timedelta(7)], [r for r in rows if r[3] >= start]
    got = {r.event_id: r.pred for r in models.walk_forward(data, "gbt", splits=2, boosting=settings).collect()}
    columns = [*models.FEATURES, "dow", "month"]
    edges = boosting.quantile_edges(data.where(f"trade_date < date '{start}' - 7").selectExpr("0 as fold", "*"), columns, settings.bins)[0]
    for k, e in enumerate(edges[:5]):  # about equal bins
        sizes = np.bincount(np.searchsorted(e, np.array([r[5 + k] for r in train], float)))
        assert len(sizes) == settings.bins and abs(sizes - len(train) / settings.bins).max() <= 3

    def binned(rs):
        numbers = [np.searchsorted(e, np.array([r[5 + k] for r in rs], float)) for k, e in enumerate(edges)]
        return np.stack(numbers + [np.array([r[1] == f for r in rs]) for f in "AB"] + [np.array([r[2] == b for r in rs]) for b in ("close", "late", "open")], axis=1).astype(int)

    both = np.vstack([binned(train), binned(test)])
    want = plain(both, np.array([r[4] for r in train]), np.array([r[0] for r in train]), settings)
    assert set(got) == {r[0] for r in test}
    assert np.allclose([got[r[0]] for r in test], want[len(train) :], atol=1e-9)


def predictions(data, settings):
    return {r.event_id: r.pred for r in models.walk_forward(data, "gbt", splits=3, boosting=settings).collect()}


def close(a, b):
    return set(a) == set(b) and np.allclose([a[k] for k in a], [b[k] for k in a], atol=1e-9)


def test_trees_of_a_fold_take_no_job_each(spark):
    _, data = events_of_days(spark, 20)
    spark.sparkContext.setJobGroup("trees", "")
    try:
        predictions(data, Boosting(trees=60, leaves=4))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("trees")) < 60


@pytest.mark.parametrize("settings", [dict(leaves=9, local=0), dict(leaves=31, local=60), dict(leaves=90, least=1, local=0), dict(leaves=9, local=30, every=2, rows=0.7), dict(leaves=31, local=60, block=5000)])
def test_rounds_over_blocks_give_the_trees_of_one_task(spark, monkeypatch, settings):
    _, data = events_of_days(spark, 20)
    monkeypatch.setattr(models, "BLOCK", settings.pop("block", 40))
    settings = dict(trees=5, bins=16, keep=2, checkpoint=2, step=0.5) | settings
    assert close(predictions(data, Boosting(**settings, alone=0)), predictions(data, Boosting(**settings)))


@pytest.mark.parametrize("alone", [0, 1000])
def test_rows_of_the_same_bins_are_one_entry(spark, monkeypatch, alone):
    _, data = events_of_days(spark, 10)
    more = data.unionByName(data.where("event_id % 3 = 0").withColumns({"event_id": F.col("event_id") + 1000, "y": -2 * F.col("y")}))
    monkeypatch.setattr(models, "BLOCK", 50)
    packed = []
    monkeypatch.setattr(boosting, "written", lambda df, name, real=boosting.written: packed.append(real(df, name)) or packed[-1])
    settings = dict(trees=5, leaves=9, bins=16, least=3, step=0.5, local=20)
    got = predictions(more, Boosting(**settings, alone=alone))
    apart = predictions(more, Boosting(**settings, every=1, rows=1 - 1e-12))  # all are drawn, each by its id
    assert close(got, apart)
    merged, single = ({r["fold"]: r["count"] for r in cells.groupBy("fold").count().collect()} for cells in packed)
    assert all(merged[f] < single[f] for f in single)


def test_a_finished_tree_holds_no_entries():
    layout = boosting.Layout(["a"], {0: [np.arange(9.0)]}, [], 10)
    growth = boosting.Growth(Boosting(leaves=4), np.ones(1, bool), 1000, layout)
    growth.take({}, {0: (([np.arange(1000, dtype=np.uint8) % 10], np.arange(1000.0) % 7 * (np.arange(1000) % 10), None, None), None)})
    assert growth.done and len(growth.tree.feature) > 1 and not growth.rows and not growth.hist
