"""The bucketed paths must give what the one-task paths give."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortile.operators import ranks

SMALL = {"rows_per_task": 10**9}
BUCKETS = {"rows_per_task": 60}


@pytest.fixture(scope="module")
def skewed(spark):
    """Three keys, one holding most rows, a third of all values equal, a few NULLs."""
    rng = np.random.default_rng(3)
    n = 900
    key = np.where(rng.random(n) < 0.7, "a", np.where(rng.random(n) < 0.9, "b", "c"))
    value = np.where(rng.random(n) < 0.34, 0.0, np.round(rng.gamma(2, 3, n), 1))
    pdf = pd.DataFrame({"k": key, "id": [f"f{i:04d}" for i in range(n)], "x": value})
    pdf.loc[::97, "x"] = np.nan
    return spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).cache()


def rows(df, *sort):
    return df.toPandas().sort_values(list(sort)).reset_index(drop=True)


def test_average_rank(skewed):
    got = rows(ranks.with_average_rank(skewed, ["k"], "x", **BUCKETS), "id")
    same = rows(ranks.with_average_rank(skewed, ["k"], "x", **SMALL), "id")
    pd.testing.assert_frame_equal(got, same)
    want = got.groupby("k")["x"].rank(method="average")
    assert np.allclose(got["rank"].astype(float), want, equal_nan=True)
    assert len(got) == skewed.count()


def test_position_covers_every_row_once(skewed):
    order = [F.col("x").desc(), F.col("id")]
    full = skewed.filter("x IS NOT NULL")
    got = rows(ranks.with_position(full, ["k"], order, **BUCKETS), "id")
    pd.testing.assert_frame_equal(got, rows(ranks.with_position(full, ["k"], order, **SMALL), "id"))
    for _, part in got.groupby("k"):
        assert sorted(part["pos"]) == list(range(1, len(part) + 1))


def test_quantiles(skewed):
    probs, names = [0.1, 0.25, 0.5, 0.99], ["a", "b", "c", "d"]
    got = rows(ranks.quantiles(skewed, ["k"], "x", probs, names, **BUCKETS), "k")
    pd.testing.assert_frame_equal(got, rows(ranks.quantiles(skewed, ["k"], "x", probs, names, **SMALL), "k"))
    pdf = skewed.toPandas().dropna()
    for k, part in pdf.groupby("k"):
        assert np.allclose(got.loc[got.k == k, names].to_numpy()[0], np.quantile(part["x"], probs))


def brute_bh(p):
    p = np.asarray(p, float)
    ok = ~np.isnan(p)
    n = ok.sum()
    out = np.full(p.size, np.nan)
    for i in np.where(ok)[0]:
        out[i] = min(1, min(q * n / (p[ok] <= q).sum() for q in p[ok] if q >= p[i]))
    return out


def test_bh(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"c": rng.choice(["u", "v"], 400, p=[0.8, 0.2]), "id": range(400),
                        "p_value": np.round(np.where(rng.random(400) < 0.3, 1.0, rng.beta(0.4, 1, 400)), 3)})
    pdf.loc[::50, "p_value"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("p_value", F.when(~F.isnan("p_value"), F.col("p_value")))
    got = rows(ranks.bh_adjust(df, by=["c"], **BUCKETS), "id")
    pd.testing.assert_frame_equal(got, rows(ranks.bh_adjust(df, by=["c"], **SMALL), "id"))
    want = pdf.groupby("c")["p_value"].transform(lambda s: pd.Series(brute_bh(s), index=s.index))
    assert np.allclose(got["adj_p"].astype(float), want, equal_nan=True)
    done = got.dropna()
    assert (done["adj_p"] >= done["p_value"] - 1e-15).all()


def test_without_keys(spark):
    df = spark.range(500).select((F.col("id") % 7).cast("double").alias("x"), "id")
    got = rows(ranks.with_average_rank(df, [], "x", **BUCKETS), "id")
    assert np.allclose(got["rank"], got["x"].rank())
    assert rows(ranks.bh_adjust(df.withColumn("p_value", F.col("x") / 10), **BUCKETS), "id")["adj_p"].notna().all()
