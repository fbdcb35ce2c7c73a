"""Statistics of array<double> columns as Spark SQL expressions: no row leaves the JVM.

Each function takes SQL for an array (best a plain column name, as it is repeated) and returns SQL. What is
undefined (a moment ratio of a constant, a correlation with a constant) is NULL, which stands for non-finite.
"""

from __future__ import annotations


def total(a: str) -> str:
    return f"aggregate({a}, 0D, (s, v) -> s + v)"


def mean(a: str) -> str:
    return f"try_divide({total(a)}, size({a}))"


def power_sum(a: str, centre: str, k: int) -> str:
    """Sum of (v - centre) ** k."""
    return f"aggregate({a}, 0D, (s, v) -> s + {' * '.join([f'(v - {centre})'] * k)})"


def std(a: str, centre: str) -> str:
    """Population standard deviation around the given mean."""
    return f"sqrt({power_sum(a, centre, 2)} / size({a}))"


def skew(a: str, centre: str) -> str:
    m2 = f"({power_sum(a, centre, 2)} / size({a}))"
    return f"try_divide({power_sum(a, centre, 3)} / size({a}), {m2} * sqrt({m2}))"


def kurtosis(a: str, centre: str) -> str:
    """Excess kurtosis of the population."""
    m2 = f"({power_sum(a, centre, 2)} / size({a}))"
    return f"try_divide({power_sum(a, centre, 4)} / size({a}), {m2} * {m2}) - 3"


def median(ordered: str) -> str:
    """Of an array in ascending order."""
    return f"(({ordered}[(size({ordered}) - 1) div 2] + {ordered}[size({ordered}) div 2]) / 2)"


def entropy(a: str, sum_: str) -> str:
    """Natural-log entropy of the values as shares of their sum."""
    return f"aggregate({a}, 0D, (s, v) -> s - if(v > 0, (v / {sum_}) * ln(v / {sum_}), 0D))"


def gini(ordered: str, sum_: str) -> str:
    """Of an array in ascending order, from its sum."""
    ranked = f"aggregate(transform({ordered}, (v, i) -> (2 * (i + 1) - size({ordered}) - 1) * v), 0D, (s, v) -> s + v)"
    return f"try_divide({ranked}, size({ordered}) * {sum_})"


def argmax(a: str) -> str:
    """Place of the first maximum, from 0."""
    return f"(array_position({a}, array_max({a})) - 1)"


def centre_of_mass(a: str, sum_: str) -> str:
    return f"try_divide({total(f'transform({a}, (v, i) -> i * v)')}, {sum_})"


def inertia(a: str, centre: str) -> str:
    """Sum of (i - centre) ** 2 * v, not normalised."""
    return total(f"transform({a}, (v, i) -> (i - {centre}) * (i - {centre}) * v)")


def parts(n: int, k: int) -> list[tuple[int, int]]:
    """(start, length) of k parts of n values, the first n mod k one longer."""
    sizes = [n // k + (i < n % k) for i in range(k)]
    return [(sum(sizes[:i]), s) for i, s in enumerate(sizes)]


def part(a: str, start: int, length: int) -> str:
    return f"slice({a}, {start + 1}, {length})"


def differences(a: str) -> str:
    return f"zip_with(slice({a}, 2, size({a}) - 1), slice({a}, 1, size({a}) - 1), (v, u) -> v - u)"


def autocorrelation(a: str, lag: int) -> str:
    """Pearson's correlation of the values with those ``lag`` places on; in one pass over pairs."""
    n = f"(size({a}) - {lag})"
    pairs = f"zip_with(slice({a}, 1, {n}), slice({a}, {lag + 1}, {n}), (x, y) -> struct(x as x, y as y))"
    zero = "struct(0D as x, 0D as y, 0D as xx, 0D as yy, 0D as xy)"
    step = "struct(s.x + p.x as x, s.y + p.y as y, s.xx + p.x * p.x as xx, s.yy + p.y * p.y as yy, s.xy + p.x * p.y as xy)"
    end = f"try_divide({n} * s.xy - s.x * s.y, sqrt({n} * s.xx - s.x * s.x) * sqrt({n} * s.yy - s.y * s.y))"
    return f"aggregate({pairs}, {zero}, (s, p) -> {step}, s -> {end})"


def spectrum(a: str, n: int) -> str:
    """Moduli of the first n / 2 terms of the discrete Fourier transform."""
    angle = f"(2 * pi() * k * i / {n})"
    re, im = (total(f"transform({a}, (v, i) -> v * {f}{angle})") for f in ("cos", "sin"))
    return f"transform(sequence(0, {n // 2 - 1}), k -> sqrt(pow({re}, 2) + pow({im}, 2)))"


def region(a: str, columns: int, rows: tuple[int, int], cols: tuple[int, int]) -> str:
    """The cells of a row-major grid in the half-open row and column ranges."""
    return f"filter({a}, (v, i) -> i div {columns} >= {rows[0]} and i div {columns} < {rows[1]} and i % {columns} >= {cols[0]} and i % {columns} < {cols[1]})"
