import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glint.functions import arrays as A
from glint.plans import features as X


def expected(r, rows, cols):
    """The features by numpy."""
    def stats(v, name, entropy_of):
        m, s = v.mean(), v.std()
        o, n, p = np.sort(v), len(v), entropy_of / entropy_of.sum()
        return {f"{name}mean": m, f"{name}std": s, f"{name}min": v.min(), f"{name}max": v.max(), f"{name}median": np.median(v), f"{name}range": np.ptp(v), f"{name}skew": ((v - m) ** 3).mean() / s**3, f"{name}kurtosis": ((v - m) ** 4).mean() / s**4 - 3, f"{name}entropy": -(p * np.log(p)).sum(), f"{name}gini": ((2 * np.arange(1, n + 1) - n - 1) * o).sum() / (n * v.sum())}

    x = r + 1e-10
    i, d, f = np.arange(len(x)), np.diff(x), np.abs(np.fft.fft(x))[: len(x) // 2]
    com = (i * x).sum() / x.sum()
    out = stats(x, "", x) | {"peak_index": x.argmax(), "peak_value": x.max(), "center_of_mass": com, "inertia": ((i - com) ** 2 * x).sum()}
    for k, part in enumerate(np.array_split(x, 3), 1):
        out |= {f"sum_third_{k}": part.sum(), f"mean_third_{k}": part.mean(), f"max_third_{k}": part.max()}
    for k, part in enumerate(np.array_split(x, 5), 1):
        out |= {f"mean_w{k}": part.mean(), f"std_w{k}": part.std(), f"max_w{k}": part.max()}
    out |= {"mean_diff": d.mean(), "std_diff": d.std(), "max_diff": d.max(), "min_diff": d.min(), "n_positive_diff": (d > 0).sum(), "n_negative_diff": (d < 0).sum(), "n_zero_diff": (d == 0).sum()}
    out |= {f"autocorr_lag{k}": np.corrcoef(x[:-k], x[k:])[0, 1] for k in (1, 2, 3)}
    out |= {"fft_peak_freq": f.argmax(), "fft_max": f.max(), "fft_median": np.median(f), "fft_mean": f.mean()}
    grid = r.reshape(rows, cols)
    for name, (a, b) in X.region_bounds(rows, cols).items():
        v = grid[a[0] : a[1], b[0] : b[1]].ravel()
        out |= stats(v, f"{name}_", v + 1e-10)
    for q in X.REGIONS[:4]:
        out |= {f"{q}_center_{s}_diff": out[f"{q}_{s}"] - out[f"center_{s}"] for s in X.DIFF_STATS}
    return out


@pytest.mark.parametrize("rows,cols", [(10, 20), (8, 8)])
def test_all_features_equal_numpy(spark, rows, cols):
    v = [np.random.default_rng(i).gamma(2.0, size=rows * cols) for i in range(2)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, ddm array<double>")
    got = {r.id: r.asDict() for r in X.features(df, "ddm", ["id"], rows, cols).collect()}
    assert len(X.feature_names()) == len(set(X.feature_names())) == 134
    for i, x in enumerate(v):
        want = expected(x, rows, cols)
        for name in X.feature_names():
            assert got[i][name] == pytest.approx(want[name], rel=1e-7, abs=1e-9), name


def test_region_bounds_of_the_native_grid():
    assert X.region_bounds(10, 20)["center"] == ((3, 7), (6, 14))


def test_constant_and_zero_vectors_are_not_finite(spark):
    df = spark.createDataFrame([(1, [1.0] * 64), (2, [0.0] * 64)], "id int, ddm array<double>")
    f = X.features(df, "ddm", ["id"], 8, 8)
    assert f.where(X.finite(X.feature_names())).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 500), st.integers(1, 9))
def test_parts_cover_all(n, k):
    sizes = [len(p) for p in np.array_split(np.arange(n), k)]
    assert [s for _, s in A.parts(n, k)] == sizes
