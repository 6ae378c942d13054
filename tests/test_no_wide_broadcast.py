"""Finding F1 of round 4: what grows with the reviews is never broadcast, however small its written file looks."""

import itertools

import pytest

from guestlens.operators import themes
from guestlens.operators.ordering import position
from guestlens.sources.scratch import materialize
from tests.test_themes import mann_kendall, mentions


def first_plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def written(spark, df, name):
    """As ``materialize``, and the plan of what is written."""
    written.plans.append(first_plan(df))
    return materialize(df, name)


def test_trend_broadcasts_nothing(spark):
    """shares, ranges and sizes look like a few KB of Parquet, but have a row per batch and bit."""
    rows = [(place, term, "neutral", b, 1 + (b * place) % 5, 12) for place in range(1, 4) for term in ("desk", "lift") for b in range(0, 12, place)]
    m = materialize(mentions(spark, rows), "m")
    sizes = materialize(spark.createDataFrame([(place, b, 5) for place in range(1, 4) for b in range(12)], "data_id long, batch_id long, n long"), "sizes")
    written.plans = []
    out = themes.theme_trend(m, sizes, 5, reuse=lambda df, name: written(spark, df, name))
    plans = [*written.plans, first_plan(out)]
    assert len(plans) == 3 and not any("Broadcast" in p for p in plans)
    want = {}
    for place, term in itertools.product(range(1, 4), ("desk", "lift")):
        k = {b: n for p, t, _, b, n, _ in rows if (p, t) == (place, term)}
        want[place, term] = (len(k), 12, *mann_kendall([k.get(b, 0) / 5 for b in range(12)]))
    assert {(r.data_id, r.term): (r.n_saying, r.n_place_batches, r.s, r.z) for r in out.collect()} == want


@pytest.mark.parametrize("span", [1, 1000])
def test_positions_broadcast_nothing(spark, span):
    """F1, and every query that numbers reviews: the totals before the ranges are as many as the ranges."""
    from pyspark.sql import functions as F
    rows = materialize(spark.range(50).select((F.col("id") % 3).alias("g"), "id"), "rows")
    out = position(rows, ["g"], ["id"], "at", F.floor(F.col("id") / span))
    assert "Broadcast" not in first_plan(out)
    assert sorted((r.id, r.at) for r in out.collect()) == [(i, i // 3 + 1) for i in range(50)]
