"""Files written here, byte by byte, and read in several partitions."""

import struct

import numpy as np
import pytest

from glint.sources import netcdf

KIND = {"i1": 1, "S1": 2, "i2": 3, "i4": 4, "f4": 5, "f8": 6, "u1": 7, "u2": 8, "u4": 9, "i8": 10}


def text(s, wide):
    raw = s.encode()
    return struct.pack(">q" if wide else ">i", len(raw)) + raw + b"\0" * (-len(raw) % 4)


def cdf(dims, variables, version=1, records=None, streaming=False):
    """dims: name -> length (0: records). variables: name -> (dims, array, fill)."""
    wide = version == 5
    n = lambda v: struct.pack(">q" if wide else ">i", v)
    names = list(dims)

    def build(begins):
        out = b"CDF" + bytes([version]) + (b"\xff" * (8 if wide else 4) if streaming else n(records or 0))
        out += struct.pack(">i", 10) + n(len(dims)) + b"".join(text(d, wide) + n(k) for d, k in dims.items())
        title = b"made here"
        out += struct.pack(">i", 12) + n(1) + text("title", wide) + struct.pack(">i", 2) + n(len(title)) + title + b"\0" * (-len(title) % 4)
        out += struct.pack(">i", 11) + n(len(variables))
        for v, (ds, x, fill) in variables.items():
            kind = x.dtype.str[1:]
            out += text(v, wide) + n(len(ds)) + b"".join(n(names.index(d)) for d in ds)
            if fill is None:
                out += struct.pack(">i", 0) + n(0)
            else:
                raw = np.asarray([fill], x.dtype.newbyteorder(">")).tobytes()
                out += struct.pack(">i", 12) + n(1) + text("_FillValue", wide) + struct.pack(">i", KIND[kind]) + n(1) + raw + b"\0" * (-len(raw) % 4)
            size = x[0].nbytes if ds and dims[ds[0]] == 0 else x.nbytes
            out += struct.pack(">i", KIND[kind]) + n(size + -size % 4) + (struct.pack(">i", begins[v]) if version == 1 else struct.pack(">q", begins[v]))
        return out

    at = len(build(dict.fromkeys(variables, 0)))
    begins, body = {}, b""
    recorded = [v for v, (ds, *_) in variables.items() if ds and dims[ds[0]] == 0]
    for v, (_, x, _) in variables.items():
        if v not in recorded:
            begins[v] = at + len(body)
            raw = x.astype(x.dtype.newbyteorder(">")).tobytes()
            body += raw + b"\0" * (-len(raw) % 4)
    lone = len(recorded) == 1
    for i, v in enumerate(recorded):
        begins[v] = at + len(body) + sum((b := variables[u][1][0].nbytes) + -b % 4 for u in recorded[:i])
    for r in range(records or 0):
        for v in recorded:
            x = variables[v][1][r]
            raw = np.asarray(x).astype(x.dtype.newbyteorder(">")).tobytes()
            body += raw + (b"" if lone else b"\0" * (-len(raw) % 4))
    return build(begins) + body


def flight(n, seed=1, version=1, **more):
    r = np.random.default_rng(seed)
    counts = r.integers(-9, 9, (n, 3, 2, 2)).astype("i2")
    snr = r.normal(size=(n, 3)).astype("f4")
    snr[1, 1] = -999
    v = {
        "ac_alt": (("sample",), r.normal(size=n), None), "raw_counts": (("sample", "channel", "delay", "doppler"), counts, -9), "ddm_snr": (("sample", "channel"), snr, -999.0),
        "flag": (("sample",), r.integers(0, 5, n).astype("i1"), None), "note": (("sample", "letters"), np.array([list(f"n{i}".ljust(4, "\0")) for i in range(n)]).astype("S1"), None), "table": (("channel",), np.arange(3.0), None),
    }
    dims = {"sample": 0, "channel": 3, "delay": 2, "doppler": 2, "letters": 4}
    return v, cdf(dims, v, version, n, **more)


@pytest.fixture
def nc(spark):
    netcdf.register(spark)
    return spark


@pytest.mark.parametrize("version, more", [(1, {}), (2, {}), (5, {}), (1, {"streaming": True})])
def test_records_are_read_in_partitions(nc, tmp_path, version, more):
    wanted = {}
    for k, n in enumerate((7, 2, 23)):
        v, raw = flight(n, k, version, **more)
        (tmp_path / f"f{k}.nc").write_bytes(raw)
        wanted[f"f{k}.nc"] = v
    (tmp_path / "other.txt").write_text("x")
    df = nc.read.format("netcdf").option("rows", 5).load(str(tmp_path))
    assert df.columns == ["file", "row", "ac_alt", "raw_counts", "ddm_snr", "flag", "note"] and df.rdd.getNumPartitions() == 2 + 1 + 5
    rows = df.collect()
    assert len(rows) == 32
    for r in rows:
        v, i = wanted[r["file"].rsplit("/", 1)[1]], r["row"]
        assert r["ac_alt"] == v["ac_alt"][1][i] and r["flag"] == v["flag"][1][i] and r["note"] == f"n{i}"
        want = [[[None if c == -9 else c for c in d] for d in ch] for ch in v["raw_counts"][1][i].tolist()]
        assert r["raw_counts"] == want
        snr = np.where(v["ddm_snr"][1][i] == -999, np.nan, v["ddm_snr"][1][i])
        assert np.array_equal(np.array(r["ddm_snr"], "f4"), snr, equal_nan=True)


def test_variables_are_chosen_and_missing_ones_named(nc, tmp_path):
    v, raw = flight(9)
    (tmp_path / "a.nc").write_bytes(raw)
    some = nc.read.format("netcdf").option("variables", "flag, ac_alt").option("rows", 4).load(str(tmp_path / "a.nc"))
    assert some.dtypes == [("file", "string"), ("row", "bigint"), ("flag", "tinyint"), ("ac_alt", "double")]
    assert [(r["flag"], r["ac_alt"]) for r in some.orderBy("row").collect()] == list(zip(v["flag"][1].tolist(), v["ac_alt"][1].tolist(), strict=True))
    with pytest.raises(Exception, match="no such variables"):
        nc.read.format("netcdf").option("variables", "table").load(str(tmp_path / "a.nc")).count()


def test_fixed_dimensions_lone_records_and_empty_files(nc, tmp_path):
    x, y = np.arange(12, dtype="i4").reshape(6, 2), np.arange(6, dtype="u2")
    (tmp_path / "fixed.nc").write_bytes(cdf({"time": 6, "k": 2}, {"x": (("time", "k"), x, None), "y": (("time",), y, 3), "z": (("k",), np.zeros(2), None)}, 5))
    got = nc.read.format("netcdf").option("rows", 4).load(str(tmp_path / "fixed.nc")).orderBy("row").collect()
    assert [(r["x"], r["y"]) for r in got] == [(a, None if b == 3 else b) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
    z = nc.read.format("netcdf").option("dimension", "k").load(str(tmp_path / "fixed.nc")).collect()
    assert [r["z"] for r in z] == [0.0, 0.0]
    s = np.arange(5, dtype="i2")
    (tmp_path / "lone.nc").write_bytes(cdf({"t": 0}, {"s": (("t",), s, None)}, 1, 5))
    assert [r["s"] for r in nc.read.format("netcdf").option("rows", 2).load(str(tmp_path / "lone.nc")).orderBy("row").collect()] == s.tolist()
    (tmp_path / "none.nc").write_bytes(cdf({"t": 0}, {"s": (("t",), s, None)}, 1, 0))
    assert nc.read.format("netcdf").load(str(tmp_path / "none.nc")).count() == 0


def test_other_and_broken_files(nc, tmp_path):
    for name, raw, says in (("a", b"\x89HDF\r\n", "HDF5"), ("b", b"hello", "not a classic"), ("c", flight(3)[1][:60], "cut off")):
        (tmp_path / f"{name}.nc").write_bytes(raw)
        with pytest.raises(Exception, match=says):
            nc.read.format("netcdf").load(str(tmp_path / f"{name}.nc")).count()
    (tmp_path / "d.nc").write_bytes(flight(9)[1][:-30])
    with pytest.raises(Exception, match="cut off"):
        nc.read.format("netcdf").load(str(tmp_path / "d.nc")).collect()
