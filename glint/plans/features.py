"""The 134 features of a power vector of n = R x C cells.

Sub-arrays, then sums and means, then the features are columns of three selects in a row, so nothing is computed twice and no
select is too large for generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glint.functions import arrays as A

REGIONS = ("q1", "q2", "q3", "q4", "center")
REGION_STATS = ("mean", "std", "min", "max", "median", "range", "skew", "kurtosis", "entropy", "gini")
DIFF_STATS = ("mean", "std", "max", "min", "entropy", "gini", "skew", "kurtosis")
FLOOR = 1e-10


def region_bounds(rows: int, cols: int) -> dict[str, tuple[tuple[int, int], tuple[int, int]]]:
    """Quadrants and the centre: from 0.3 to 0.7 of the rows and columns."""
    r, c = rows // 2, cols // 2
    inner = lambda n: (n * 3 // 10, n * 7 // 10)
    return {"q1": ((0, r), (0, c)), "q2": ((0, r), (c, cols)), "q3": ((r, rows), (0, c)), "q4": ((r, rows), (c, cols)), "center": (inner(rows), inner(cols))}


def feature_names() -> list[str]:
    names = ["mean", "std", "min", "max", "median", "range", "skew", "kurtosis", "entropy", "gini", "peak_index", "peak_value", "center_of_mass", "inertia"]
    names += [f"{s}_third_{k}" for k in (1, 2, 3) for s in ("sum", "mean", "max")]
    names += [f"{s}_w{k}" for k in range(1, 6) for s in ("mean", "std", "max")]
    names += ["mean_diff", "std_diff", "max_diff", "min_diff", "n_positive_diff", "n_negative_diff", "n_zero_diff"]
    names += ["autocorr_lag1", "autocorr_lag2", "autocorr_lag3", "fft_peak_freq", "fft_max", "fft_median", "fft_mean"]
    names += [f"{r}_{s}" for r in REGIONS for s in REGION_STATS]
    return names + [f"{r}_center_{s}_diff" for r in REGIONS[:4] for s in DIFF_STATS]


def features(df: DataFrame, ddm: str, keys: list[str], rows: int, cols: int, wanted: list[str] | None = None) -> DataFrame:
    """``keys`` and the wanted features (all by default) of the array column ``ddm`` of rows x cols values."""
    wanted = wanted or feature_names()
    n = rows * cols
    need = lambda *starts: any(w.startswith(starts) for w in wanted)
    arrays = {"r": f"cast({ddm} as array<double>)", "x": f"transform(cast({ddm} as array<double>), v -> v + {FLOOR}D)"}
    df = df.select(*keys, *[F.expr(e).alias(a) for a, e in arrays.items()])
    sub = {"xo": "array_sort(x)"}
    for k, (s, m) in enumerate(A.parts(n, 3), 1):
        sub |= {f"t{k}": A.part("x", s, m)}
    for k, (s, m) in enumerate(A.parts(n, 5), 1):
        sub |= {f"w{k}": A.part("x", s, m)}
    sub |= {"dx": A.differences("x")}
    if need("fft"):
        sub |= {"ft": A.spectrum("x", n)}
    own = [r for r in REGIONS if need(f"{r}_") or (r == "center" and any("_center_" in w for w in wanted))]
    for r in own:
        sub |= {r: A.region("r", cols, *region_bounds(rows, cols)[r])}
    df = df.select("*", *[F.expr(e).alias(f"a_{a}" if a in own else a) for a, e in sub.items()])
    sums = {"x_s": A.total("x"), "x_m": A.mean("x"), "dx_m": A.mean("dx")} | {f"w{k}_m": A.mean(f"w{k}") for k in range(1, 6)}
    for r in own:
        a = f"a_{r}"
        sums |= {f"{r}_s": A.total(a), f"{r}_m": A.mean(a), f"{r}_o": f"array_sort({a})", f"{r}_e": f"transform({a}, v -> v + {FLOOR}D)"}
    if need("fft"):
        sums |= {"ft_o": "array_sort(ft)"}
    df = df.select("*", *[F.expr(e).alias(c) for c, e in sums.items()])
    out = {
        "mean": "x_m", "std": A.std("x", "x_m"), "min": "array_min(x)", "max": "array_max(x)", "median": A.median("xo"), "range": "array_max(x) - array_min(x)",
        "skew": A.skew("x", "x_m"), "kurtosis": A.kurtosis("x", "x_m"), "entropy": A.entropy("x", "x_s"), "gini": A.gini("xo", "x_s"),
        "peak_index": A.argmax("x"), "peak_value": "array_max(x)", "center_of_mass": A.centre_of_mass("x", "x_s"), "inertia": A.inertia("x", A.centre_of_mass("x", "x_s")),
        "mean_diff": "dx_m", "std_diff": A.std("dx", "dx_m"), "max_diff": "array_max(dx)", "min_diff": "array_min(dx)",
        "n_positive_diff": "size(filter(dx, v -> v > 0))", "n_negative_diff": "size(filter(dx, v -> v < 0))", "n_zero_diff": "size(filter(dx, v -> v = 0))",
        "fft_peak_freq": A.argmax("ft"), "fft_max": "array_max(ft)", "fft_median": A.median("ft_o"), "fft_mean": A.mean("ft"),
    }
    for k in (1, 2, 3):
        out |= {f"sum_third_{k}": A.total(f"t{k}"), f"mean_third_{k}": A.mean(f"t{k}"), f"max_third_{k}": f"array_max(t{k})", f"autocorr_lag{k}": A.autocorrelation("x", k)}
    for k in range(1, 6):
        out |= {f"mean_w{k}": f"w{k}_m", f"std_w{k}": A.std(f"w{k}", f"w{k}_m"), f"max_w{k}": f"array_max(w{k})"}
    for r in own:
        a, m = f"a_{r}", f"{r}_m"
        out |= {f"{r}_mean": m, f"{r}_std": A.std(a, m), f"{r}_min": f"array_min({a})", f"{r}_max": f"array_max({a})", f"{r}_median": A.median(f"{r}_o"), f"{r}_range": f"array_max({a}) - array_min({a})", f"{r}_skew": A.skew(a, m), f"{r}_kurtosis": A.kurtosis(a, m), f"{r}_entropy": A.entropy(f"{r}_e", f"({r}_s + {FLOOR}D * size({a}))"), f"{r}_gini": A.gini(f"{r}_o", f"{r}_s")}
    diffs = [w for w in wanted if "_center_" in w]
    used = [w for w in out if w in wanted or any(w in (f"{d.split('_')[0]}_{d.split('_')[2]}", f"center_{d.split('_')[2]}") for d in diffs)]
    df = df.select(*keys, *[F.expr(out[w]).alias(w) for w in used])
    if diffs:
        df = df.select("*", *[(F.col(f"{d.split('_')[0]}_{d.split('_')[2]}") - F.col(f"center_{d.split('_')[2]}")).alias(d) for d in diffs])
    return df.select(*keys, *wanted)


def finite(names: list[str]) -> Column:
    """All values are finite and of less than the largest double's modulus."""
    values = F.array(*[F.col(c).cast("double") for c in names])
    return F.forall(values, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(1.7976931348623157e308)), F.lit(False)))


def only_finite(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """``keys`` and ``names`` of the rows whose values are all finite.

    The values pass a generator first: a test directly on them would be pushed below the staged selects, with every
    feature's whole expression written out in it.
    """
    one = df.select(*keys, F.explode(F.array(F.struct(*names))).alias("f"))
    return one.where(finite([f"f.{c}" for c in names])).select(*keys, *[F.col(f"f.{c}").alias(c) for c in names])
