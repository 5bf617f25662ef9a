"""Models on moments against the same models on rows."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pytest

from tidewatch.operators import moments as M
from tidewatch.operators import ridge as R

ALPHAS = [0.1, 10.0, 1000.0]


def sample(n=240, groups=9, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 20, 0.1] + [0, 5, 100]
    g = rng.integers(0, groups, n)
    y0 = x[:, 0] * 2 - x[:, 1] * 0.1 + rng.normal(size=n) + g * 0.2
    return pd.DataFrame({"g": g, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "flat": 7.0, "y0": y0, "y1": rng.normal(size=n), "still": 1.5})


def ridge(x, y, alpha):
    """Plain ridge on standardised columns, as a function of rows."""
    mean, std = x.mean(axis=0), x.std(axis=0)
    std = np.where(std < 1e-9, np.inf, std)
    z = (x - mean) / std
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return lambda new: (new - mean) / std @ w + y.mean()


def fold(g, folds):
    return int(hashlib.md5(str(g).encode()).hexdigest()[:8], 16) % folds


def plain_oof(d, features, target, folds):
    out, chosen = {}, {}
    x, y, g = d[features].to_numpy(), d[target].to_numpy(), d["g"].to_numpy()
    f = np.array([fold(v, folds) for v in g])
    for own in sorted(set(g)):
        rest = g != own
        errors = [sum(((y[rest & (f == k)] - ridge(x[rest & (f != k)], y[rest & (f != k)], a)(x[rest & (f == k)])) ** 2).sum() for k in sorted(set(f[rest]))) for a in ALPHAS]
        chosen[own] = ALPHAS[int(np.argmin(errors))]
        out[own] = ridge(x[rest], y[rest], chosen[own])(x[~rest])
    return out, chosen


def test_leave_group_out_equals_plain_rows(spark):
    d = sample()
    df = spark.createDataFrame(d).repartition(5)
    features, targets = ["a", "b", "c", "flat"], ["y0", "y1", "still"]
    models = R.leave_group_out(df, "g", features, targets, ALPHAS, 4)
    got = {(r["g"], r["target"]): r for r in models.collect()}
    assert len(got) == d["g"].nunique() * 3
    rows = R.out_of_fold(df, models, "g", features, targets).toPandas()
    report = {r["target"]: r for r in R.ridge_report(models).collect()}
    for target in ("y0", "y1"):
        want, chosen = plain_oof(d, features, target, 4)
        assert all(got[g, target]["alpha"] == a for g, a in chosen.items())
        own = rows[rows["target"] == target]
        for g, p in want.items():
            assert np.allclose(np.sort(own[own["g"] == g]["predicted"]), np.sort(p), atol=1e-7)
        assert report[target]["n"] == len(d) and report[target]["groups"] == d["g"].nunique()
        assert abs(report[target]["r"] - np.corrcoef(own["y"], own["predicted"])[0, 1]) < 1e-7
        assert abs(report[target]["mse"] - ((own["y"] - own["predicted"]) ** 2).mean()) < 1e-7
    assert report["still"]["r"] == 0


def test_rows_that_cannot_be_used(spark):
    """Null and infinite components, a null group, one group alone, no rows at all."""
    d = sample(60, 3)
    rows = [tuple(map(float, r)) for r in d[["g", "a", "y0"]].to_numpy()]
    bad = [(0.0, None, 1.0), (0.0, math.nan, 1.0), (1.0, math.inf, 1.0), (1.0, 1.0, None)]
    schema = "g double, a double, y0 double"
    clean = R.leave_group_out(spark.createDataFrame(rows, schema), "g", ["a"], ["y0"], ALPHAS, 2).collect()
    dirty = R.leave_group_out(spark.createDataFrame(rows + bad, schema), "g", ["a"], ["y0"], ALPHAS, 2).collect()
    assert {(r["g"], r["alpha"], round(r["weights"][1], 9)) for r in clean} == {(r["g"], r["alpha"], round(r["weights"][1], 9)) for r in dirty}
    null = R.leave_group_out(spark.createDataFrame([(None if g == 2 else g, a, y) for g, a, y in rows], schema), "g", ["a"], ["y0"], ALPHAS, 2)
    assert {r["g"] for r in null.collect()} == {0.0, 1.0, None}
    assert R.leave_group_out(spark.createDataFrame([(1.0, a, y) for _, a, y in rows], schema), "g", ["a"], ["y0"], ALPHAS, 2).count() == 0
    assert R.ridge_report(R.leave_group_out(spark.createDataFrame([], schema), "g", ["a"], ["y0"], ALPHAS, 2)).count() == 0


def test_one_aggregation_whatever_the_grid(spark):
    df = spark.createDataFrame(sample())
    plan = lambda alphas: R.ridge_report(R.leave_group_out(df, "g", ["a", "b"], ["y0"], alphas, 3))._jdf.queryExecution().executedPlan().toString()
    assert plan([1.0]).count("Exchange") == plan([float(a) for a in range(1, 40)]).count("Exchange")


@pytest.mark.parametrize("replicates", [60])
def test_bootstrap_draws_groups(spark, replicates):
    d = sample()
    d["k"] = d["g"] % 2
    got = {r["k"]: r for r in M.bootstrap_correlation(spark.createDataFrame(d).repartition(6), ["k"], "g", "y0", "a", replicates).collect()}
    for k, own in d.groupby("k"):
        rs = []
        for b in range(replicates):
            u = own["g"].map(lambda g: int(hashlib.md5(f"{g}:{b}".encode()).hexdigest()[:12], 16) / 16**12)  # noqa: B023
            weight = sum((u >= p).astype(int) for p in M.POISSON)
            drawn = own.loc[own.index.repeat(weight)]
            if len(drawn):
                rs.append(np.corrcoef(drawn["y0"], drawn["a"])[0, 1])
        assert abs(got[k]["low"] - np.quantile(rs, 0.025)) < 1e-9 and abs(got[k]["high"] - np.quantile(rs, 0.975)) < 1e-9
        assert abs(got[k]["r"] - np.corrcoef(own["y0"], own["a"])[0, 1]) < 1e-9 and got[k]["n"] == len(own)
    still = M.bootstrap_correlation(spark.createDataFrame(d), [], "g", "still", "a", 20).collect()
    assert [(r["n"], r["r"], r["low"], r["high"]) for r in still] == [(240, 0.0, 0.0, 0.0)]


def test_explained_beyond_a_site_of_many_levels(spark):
    d = sample(150, 20, 8)
    d["twin"] = 2 * d["a"]
    got = {r["target"]: r for r in M.explained_beyond(spark.createDataFrame(d).repartition(4), "g", ["a", "b", "twin"], ["y0", "y1", "still"]).collect()}

    def share(x, y):
        x = np.column_stack([np.ones(len(y)), x])
        return 1 - ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum() / ((y - y.mean()) ** 2).sum()

    site = pd.get_dummies(d["g"]).to_numpy(float)
    for t in ("y0", "y1"):
        y, x = d[t].to_numpy(), d[["a", "b"]].to_numpy()
        full, own = share(np.column_stack([site, x]), y), share(site, y)
        assert abs(got[t]["r2_site"] - own) < 1e-8 and abs(got[t]["r2_features"] - share(x, y)) < 1e-8 and abs(got[t]["r2_beyond"] - (full - own)) < 1e-8
    assert (got["still"]["r2_site"], got["still"]["r2_beyond"], got["still"]["n"]) == (0, 0, 150)
    assert M.explained_beyond(spark.createDataFrame(d).limit(0), "g", ["a"], ["y0"]).count() == 0
