"""Change probability against the recursion with all run lengths."""

import math

import numpy as np

from volspark.operators import regimes


def uncut(x, hazard=1 / 100):
    x = x / x.std()
    p, k, a, b, m, out = np.ones(1), np.ones(1), np.ones(1), np.ones(1), np.zeros(1), []
    for v in x:
        d, s2 = 2 * a, b * (k + 1) / (a * k)
        g = np.array([math.lgamma((z + 1) / 2) - math.lgamma(z / 2) for z in d])
        w = p * np.exp(g - 0.5 * np.log(d * math.pi * s2) - (d + 1) / 2 * np.log1p((v - m) ** 2 / (d * s2)))
        p = np.concatenate([[w.sum() * hazard], w * (1 - hazard)])
        p /= p.sum()
        b = np.concatenate([[1.0], b + k * (v - m) ** 2 / (2 * (k + 1))])
        m = np.concatenate([[0.0], (k * m + v) / (k + 1)])
        k, a = np.concatenate([[1.0], k + 1]), np.concatenate([[1.0], a + 0.5])
        out.append(p[:5].sum())
    return np.array(out)


def test_long_stable_runs_keep_their_mass(spark):
    x = np.concatenate([np.random.default_rng(0).normal(0, 1, 700), np.random.default_rng(1).normal(6, 1, 60)])
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(x)], "asset string, d int, r double")
    found = [r.p_change for r in regimes.bocpd(df, ["asset"], "d", "r").orderBy("d").collect()]
    np.testing.assert_allclose(found, uncut(x), rtol=1e-9, atol=1e-12)
