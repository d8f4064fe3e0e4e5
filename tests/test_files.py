"""MAT files, archives and annotations, on files written here byte by byte."""

import struct
import zipfile
import zlib

import numpy as np
import pytest

from sigframe.sources import archives, matfile, timeseries


def _tag(kind, data):
    return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def _mx(name, cls, dims, body):
    head = _tag(6, struct.pack("<II", cls, 0)) + _tag(5, np.array(dims, "<i4").tobytes()) + _tag(1, name.encode())
    return _tag(14, head + body)


def _num(name, x):
    return _mx(name, 6, x.shape, _tag(9, np.asarray(x, "<f8").tobytes(order="F")))


def _text(name, s):
    return _mx(name, 4, (1, len(s)), _tag(4, np.array([ord(c) for c in s], "<u2").tobytes()))


def _cell(name, items):
    return _mx(name, 1, (1, len(items)), b"".join(items))


def _struct(name, fields):
    w = 16
    labels = b"".join(k.encode().ljust(w, b"\0") for k in fields)
    small = struct.pack("<HH", 5, 4) + struct.pack("<i", w)
    return _mx(name, 2, (1, 1), small + _tag(1, labels) + b"".join(fields.values()))


def _mat(*elements, packed=True):
    body = b"".join(struct.pack("<II", 15, len(z)) + z for z in map(zlib.compress, elements)) if packed else b"".join(elements)
    return b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + body


@pytest.mark.parametrize("packed", [True, False])
def test_mat(packed):
    x = np.arange(60.0).reshape(20, 3)
    names = _cell("clab", [_text("", s) for s in ("Fz", "Cz", "Pz")])
    data = _mat(_struct("rec", {"fs": _num("", np.array([[250.0]])), "data": _num("", x), "clab": names}), _text("note", "hello"), packed=packed)
    tree = matfile.load_mat(data)
    assert tree["note"] == "hello" and tree["rec"]["clab"] == ["Fz", "Cz", "Pz"] and np.array_equal(tree["rec"]["data"], x)
    h = matfile.find_recording(data, least_bytes=100)
    assert (h["file_type"], h["channels"], h["sfreq"], h["n_samples"]) == ("matRawData:rec.data", ["Fz", "Cz", "Pz"], 250.0, 20)
    assert np.array_equal(np.array(h["signals"]), x.T)
    with pytest.raises(ValueError):
        matfile.find_recording(data)  # too small to be a recording
    e = matfile.find_recording(_mat(_num("epo", np.arange(24.0).reshape(2, 3, 4)), packed=packed))
    assert e["file_type"] == "matEpochData:epo" and e["epochs"].shape == (2, 3, 4) and e["channels"] == ["Ch1", "Ch2", "Ch3"]


def test_not_mat():
    for bad in (b"", b"x" * 300, b"MATLAB 7.3 MAT-file".ljust(124) + b"\0\2IM"):
        with pytest.raises(ValueError):
            matfile.load_mat(bad)


def test_mat_through_spark(spark, tmp_path):
    (tmp_path / "a.mat").write_bytes(_mat(_num("epo", np.arange(24.0).reshape(2, 3, 4))))
    h = timeseries.read_headers(spark, str(tmp_path)).first()
    assert (h.file_type, h.n_channels, h.n_samples) == ("matEpochData:epo", 3, 4)
    got = {r.ch: r.samples for r in timeseries.read_signals(spark, str(tmp_path)).collect()}
    assert got[0] == [0.0, 1.0, 2.0, 3.0, 12.0, 13.0, 14.0, 15.0]


def test_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.txt", "new")
        z.writestr("there.txt", "old")
    (tmp_path / "there.txt").write_text("mine")
    (tmp_path / "bad.zip").write_bytes(b"nothing")
    rows = archives.zip_members(spark, str(tmp_path)).collect()
    assert [(r.member, bytes(r.content)) for r in rows if r.member] == [("x.txt", b"new")]
    assert [r.error.split(":")[0] for r in rows if r.error] == ["BadZipFile"]


def test_annotations(spark, tmp_path):
    (tmp_path / "b.vhdr").write_text("[Common]\nSamplingInterval=4000\n")
    (tmp_path / "b.vmrk").write_text("[Marker Infos]\nMk1=New Segment,,1,1,0\nMk2=Stimulus,S  1,251,1,0\nMk3=Comment,a\\1b,501,25,0\n")
    tal = b"+0\x14\x14\0+1.5\x152.25\x14sleep\x14\0+3\x14one\x14two\x14\0"
    tal += b"\0" * (-len(tal) % 2)
    n = len(tal) // 2
    pad = lambda s, w: str(s).ljust(w).encode()
    head = pad("0", 8) + pad("", 160) + pad("01.01.20", 8) + pad("00.00.00", 8) + pad(512, 8) + pad("EDF+C", 44) + pad(1, 8) + pad(10, 8) + pad(1, 4)
    for w, v in ((16, "EDF Annotations"), (80, ""), (8, ""), (8, -1), (8, 1), (8, -32768), (8, 32767), (80, ""), (8, n), (32, "")):
        head += pad(v, w)
    (tmp_path / "c.edf").write_bytes(head + tal)
    got = {(r.path.rpartition("/")[2], r.onset, r.duration, r.description) for r in archives.read_annotations(spark, str(tmp_path)).collect()}
    assert got == {
        ("b.vhdr", 1.0, 0.004, "Stimulus/S  1"), ("b.vhdr", 2.0, 0.1, "Comment/a,b"), ("c.edf", 1.5, 2.25, "sleep"), ("c.edf", 3.0, 0.0, "one"), ("c.edf", 3.0, 0.0, "two"),
    }


def _edf_bytes(rows, per, bdf=False, labels=None):
    """An EDF or BDF file of one-second records; ``rows`` are whole numbers, ``per`` the samples of each channel in a record."""
    n, records = len(rows), len(rows[0]) // per[0]
    size = 3 if bdf else 2
    field = lambda v, w: str(v).ljust(w).encode()
    lim = 1 << (8 * size - 1)
    head = (b"\xffBIOSEMI" if bdf else field("0", 8)) + field("X", 80) + field("R", 80) + b"01.01.20" + b"10:00:00" + field(256 * (n + 1), 8) + field("", 44) + field(records, 8) + field(1, 8) + field(n, 4)
    for w, values in ((16, labels or [f"C{i}" for i in range(n)]), (80, [""] * n), (8, ["uV"] * n), (8, [-lim] * n), (8, [lim - 1] * n), (8, [-lim] * n), (8, [lim - 1] * n), (80, [""] * n), (8, per), (32, [""] * n)):
        head += b"".join(field(v, w) for v in values)
    body = b"".join(int(v).to_bytes(size, "little", signed=True) for r in range(records) for i in range(n) for v in rows[i][r * per[i] : (r + 1) * per[i]])
    return head + body


def test_mixed_rates_bdf_and_stated_data_files(spark, tmp_path):
    import numpy as np
    from pyspark.sql import functions as F

    from sigframe.sources import timeseries

    fast, slow = list(range(-100, 100)), list(range(20))
    (tmp_path / "mixed.edf").write_bytes(_edf_bytes([fast, slow], [100, 10]))
    big = [-8_000_000, 8_000_000, 5, -5]
    (tmp_path / "wide.bdf").write_bytes(_edf_bytes([big], [2], bdf=True))
    (tmp_path / "v.vhdr").write_text("[Common]\nDataFile=stated.eeg\nDataOrientation=MULTIPLEXED\nSamplingInterval=4000\n[Binary Infos]\nBinaryFormat=INT_16\n[Channel Infos]\nCh1=Fz,,0.5,mV\nCh2=Cz,,0.1,µV\n", encoding="latin-1", errors="replace")
    (tmp_path / "stated.eeg").write_bytes(np.array([[2, 10], [4, 20]], "<i2").tobytes())
    (tmp_path / "v.eeg").write_bytes(b"\0" * 400)
    (tmp_path / "two.hea").write_text("two 2 100 2\ntwo.dat 16 1 0 0 0 0 0 A\ntwo.dat 212 1 0 0 0 0 0 B\n")
    (tmp_path / "two.dat").write_bytes(b"\0" * 16)
    got = {r.path.rpartition("/")[2]: r for r in timeseries.read_headers(spark, str(tmp_path)).collect()}
    assert (got["mixed.edf"].sfreq, got["mixed.edf"].n_samples) == (100.0, 200) and (got["wide.bdf"].sfreq, got["wide.bdf"].n_samples) == (2.0, 4)
    assert got["v.vhdr"].n_samples == 2 and "Exchange" not in timeseries.read_headers(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    sig = {(r.path.rpartition("/")[2], r.ch): r for r in timeseries.read_signals(spark, str(tmp_path)).collect()}
    assert (sig["mixed.edf", 0].sfreq, sig["mixed.edf", 1].sfreq) == (100.0, 10.0)
    assert sig["mixed.edf", 0].samples == fast and sig["mixed.edf", 1].samples == slow and sig["wide.bdf", 0].samples == big
    assert sig["v.vhdr", 0].samples == [1000.0, 2000.0] and sig["v.vhdr", 1].samples[1] == 2.0
    assert not any(k[0] == "two.hea" for k in sig)
    try:
        timeseries.read_signals(spark, str(tmp_path), errors="raise").where(F.col("ch") >= 0).collect()
        raise AssertionError("the file of two formats was read")
    except Exception as e:  # noqa: BLE001
        assert "different formats" in str(e)


def test_header_reads_no_samples(tmp_path):
    """A file cut off behind its header still has one."""
    from sigframe.sources import timeseries

    whole = _edf_bytes([list(range(200))], [100])
    (tmp_path / "cut.edf").write_bytes(whole[:512])
    assert timeseries._parsed(str(tmp_path / "cut.edf"), False)[1]["n_samples"] == 200
