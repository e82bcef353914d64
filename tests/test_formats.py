"""Readers and writers by round trips and malformed input."""

import gzip
import json
import struct

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from voxelmill.operators.activate import activate, finite_rows, warnings
from voxelmill.sources import packed, ply, read_splats, samples, sinks, splat_format
from voxelmill.sources.adapter import RAW


def test_binary_ply_and_activation(spark, tmp_path):
    rows = samples.shells()
    (tmp_path / "a.ply").write_bytes(ply.splat_ply_bytes(rows))
    df, kind, done = read_splats(spark, str(tmp_path / "a.ply"))
    got = df.orderBy("gid").collect()
    assert (kind, done, len(got)) == ("ply", False, 540)
    assert np.allclose([[r[c] for c in RAW] for r in got], [[r[c] for c in RAW] for r in rows], atol=1e-6)
    a = activate(df).first()
    m = np.array([a[f"r{i}"] for i in range(9)]).reshape(3, 3)
    assert np.allclose(m @ m.T, np.eye(3)) and 0 < a["opacity"] < 1 and a["s0"] > 0


def test_ascii_ply_in_any_column_order(spark, tmp_path):
    (tmp_path / "s.ply").write_text(samples.ascii_sphere())
    assert ply.read_ply(spark, str(tmp_path / "s.ply")).count() == 128
    names = "scale_1 x rot_3 z rot_0 opacity y scale_0 rot_1 scale_2 rot_2 extra".split()
    text = "ply\nformat ascii 1.0\nelement vertex 1\n" + "".join(f"property float {n}\n" for n in names) + "end_header\n0 1 0 0 1 0 2 -1 0 0 0 0\n"
    (tmp_path / "o.ply").write_text(text)
    r = activate(ply.read_ply(spark, str(tmp_path / "o.ply"))).first()
    assert (r["x"], r["y"], r["z"], r["cr"]) == (1, 2, 0, 0.55)


@pytest.mark.parametrize(("change", "says"), [
    (("ply\n", "plx\n"), "not a PLY"), (("binary_little_endian", "binary_big_endian"), "big-endian"), (("binary_little_endian", "other"), "unsupported PLY format"),
    (("property float x\n", "property list uchar int x\n"), "list"), (("property float x\n", "property half x\n"), "unknown property type"),
    (("element vertex 540", "element vertex 0"), "empty"), (("element vertex 540", "element vertex 30000000"), "more than"), (("property float rot_3\n", ""), "missing"),
    (("element vertex", "element face 1\nelement vertex"), "before vertex"), (("end_header", "end"), "header"),
])
def test_malformed_headers(change, says):
    head = ply.splat_ply_bytes(samples.shells()).split(b"end_header")[0].decode() + "end_header\n"
    with pytest.raises(ValueError, match=says):
        ply.parse_header(head.replace(*change, 1).encode())


def test_truncated_body(tmp_path):
    data = ply.splat_ply_bytes(samples.shells())
    (tmp_path / "t.ply").write_bytes(data[:-5])
    reader = ply.PlyReader(str(tmp_path / "t.ply"), ply.parse_header(data[:2000]))
    with pytest.raises(ValueError, match="truncated"):
        [b for p in reader.partitions() for b in reader.read(p)]


def test_non_finite_rows(spark):
    rows = [(0, *[1.0] * 11), (1, float("nan"), *[1.0] * 10), (2, *[1.0] * 10, None), (3, float("inf"), *[1.0] * 10)]
    df = spark.createDataFrame(rows, "gid bigint, " + ", ".join(f"{c} double" for c in RAW[:11]))
    assert [r["gid"] for r in finite_rows(df).collect()] == [0]
    with pytest.raises(ValueError):
        finite_rows(df, on_non_finite="error")


def test_splat_records(spark, tmp_path):
    rec = b"".join(struct.pack("<6f8B", i, 0, 0, 0.1, 0.2, 0.3, 255, 0, 51, 128, 255, 128, 128, 128) for i in range(96))
    (tmp_path / "a.splat").write_bytes(rec)
    df, kind, done = read_splats(spark, str(tmp_path / "a.splat"))
    r = df.orderBy("gid").collect()[5]
    assert (kind, done, df.count()) == ("splat", True, 96)
    assert np.allclose([r["x"], r["s1"], r["opacity"], r["cr"], r["cb"], r["r0"], r["r1"]], [5, 0.2, 128 / 255, 1, 0.2, 1, 0])
    assert packed.from_activated(df, 0.9).isEmpty()


@pytest.mark.parametrize("version", [2, 3])
def test_spz(version):
    n = 3
    pos = b"".join(int(v * 4096).to_bytes(3, "little", signed=True) for v in (1, -2, 0.5) * n)
    turn = bytes([127, 127, 127]) * n if version == 2 else (np.uint32(3) << np.uint32(30)).tobytes() * n
    body = struct.pack("<IIIBBBB", packed.SPZ_MAGIC, version, n, 0, 12, 0, 0) + pos + bytes([255]) * n + bytes([128] * 3) * n + bytes([160] * 3) * n + turn
    p, s, q, o, c = packed.spz_rows(gzip.compress(body))
    assert np.allclose(p, [[1, -2, 0.5]] * n) and np.allclose(s, 1) and np.allclose(o, 1) and np.allclose(np.abs(q[:, 0]), 1, atol=1e-3)
    with pytest.raises(ValueError, match="newer version"):
        packed.spz_rows(body)


def test_unknown_formats(spark):
    assert splat_format("A.PLY") == "ply" and splat_format("x.zip") == "sog"
    with pytest.raises(ValueError):
        splat_format("a.xyz")
    with pytest.raises(NotImplementedError):
        read_splats(spark, "a.ksplat")


def test_sinks(spark, tmp_path):
    from tests.test_engine import small_mesh

    m = small_mesh(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0)], [(0, 1, 2)])
    sinks.write_ply(m, str(tmp_path / "m.ply"))
    data = (tmp_path / "m.ply").read_bytes()
    assert data.startswith(b"ply\nformat binary_little_endian") and data.endswith(struct.pack("<B3I", 3, 0, 1, 2))
    sinks.write_obj(m, str(tmp_path / "m.obj"))
    assert (tmp_path / "m.obj").read_text().splitlines()[-1] == "f 1//1 2//2 3//3"
    sinks.write_glb(m, str(tmp_path / "m.glb"))
    glb = (tmp_path / "m.glb").read_bytes()
    assert glb[:4] == b"glTF" and struct.unpack("<I", glb[8:12])[0] == len(glb) and len(glb) % 4 == 0
    doc = json.loads(glb[20 : 20 + struct.unpack("<I", glb[12:16])[0]])
    assert doc["accessors"][3]["count"] == 3 and doc["materials"][0]["doubleSided"]
    assert sinks.output_name("d/Scene.SPZ", "glb") == "Scene-mesh.glb"


def test_report_summary(spark, tmp_path):
    report = {"schema": sinks.REPORT_SCHEMA, "gpu": None, "result": {"backend": "spark", "dims": [4, 5, 6], "validation": {"maxAbsError": 0.5}}}
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text(json.dumps(report, indent=1))
    r = sinks.summarize_reports(spark, str(tmp_path / "r")).first()
    assert (r["vendor"], r["grid"], r["max_abs_error"], r["file"]) == ("Unknown", "4×5×6", 0.5, "a.json")
    (tmp_path / "r" / "b.json").write_text(json.dumps(report | {"schema": "other"}))
    with pytest.raises(ValueError):
        sinks.summarize_reports(spark, str(tmp_path / "r"))


@given(st.lists(st.floats(-1e6, 1e6, width=32), min_size=14, max_size=14))
def test_ply_rows_survive(values):
    data = ply.splat_ply_bytes([dict(zip(RAW, values, strict=True))])
    h = ply.parse_header(data)
    row = np.frombuffer(data[h.offset :], h.record)[0]
    assert [float(row[c]) for c in RAW] == [float(np.float32(v)) for v in values]


def test_ascii_in_chunks_and_the_vertex_limit(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ply, "CHUNK", 37)
    monkeypatch.setattr(ply, "BATCH", 10)
    text = samples.ascii_sphere()
    (tmp_path / "s.ply").write_text(text)
    head = ply.parse_header(text.encode())
    reader = ply.PlyReader(str(tmp_path / "s.ply"), head)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["gid"] for r in rows] == list(range(128))
    body = [x.split() for x in text.splitlines()[-128:]]
    assert [r["x"] for r in rows] == [float(x[head.names.index("x")]) for x in body]
    (tmp_path / "t.ply").write_text(text.rstrip().rsplit("\n", 1)[0])
    reader = ply.PlyReader(str(tmp_path / "t.ply"), head)
    with pytest.raises(ValueError, match="truncated"):
        [b for p in reader.partitions() for b in reader.read(p)]
    with pytest.raises(ValueError, match="maxVertices"):
        ply.parse_header(text.encode(), 100)
    spark.dataSource.register(ply.PlySource)
    assert spark.read.format("ply").option("maxVertices", 128).load(str(tmp_path / "s.ply")).count() == 128


def scaled(spark, *groups):
    """Rows of scales: (how many, s0, s1, s2)."""
    return spark.createDataFrame([(a, b, c) for n, a, b, c in groups for _ in range(n)], "s0 double, s1 double, s2 double")


@pytest.mark.parametrize(
    ("groups", "kind", "report", "words"),
    [
        (((100, 1.0, 1.0, 1.0),), "ply", {}, []),
        (((100, 1.0, 1.0, 1.0), (5, 101.0, 1.0, 1.0)), "ply", {}, ["median"]),  # five rows: more than four
        (((100, 1.0, 1.0, 1.0), (4, 101.0, 1.0, 1.0)), "ply", {}, []),
        (((495, 1.0, 1.0, 1.0), (5, 100.0, 1.0, 1.0)), "ply", {}, []),  # 100 times is no more than 100 times
        (((995, 1.0, 1.0, 1.0), (5, 101.0, 1.0, 1.0)), "ply", {}, []),  # half a percent
        (((100, 1.0, 1.0, 1.0),), "splat", {}, ["SPLAT"]),
        (((100, 1.0, 1.0, 1.0), (5, 1.0, 1.0, 0.009)), "spz", {}, ["SPZ", "thick"]),
        (((100, 1.0, 1.0, 1.0), (4, 1.0, 1.0, 0.009)), "spz", {}, ["SPZ"]),
        (((100, 1.0, 1.0, 1.0),), "ply", {"rejected_opacity": 101}, ["opacity"]),
        (((100, 1.0, 1.0, 1.0),), "ply", {"rejected_opacity": 50, "rejected_crop": 50}, []),
        (((10, 1.0, 1.0, 1.0),), "ply", {"rejected_crop": 190}, ["crop"]),
        ((), "ply", {"rejected_opacity": 200}, ["opacity"]),
    ],
)
def test_warnings(spark, groups, kind, report, words):
    kept = sum(g[0] for g in groups)
    counts = {"input_count": max(200, kept), "retained_count": kept, "rejected_opacity": 0, "rejected_crop": 0} | report
    told = warnings(counts, scaled(spark, *groups), kind)
    assert len(told) == len(words) and all(w in t for w, t in zip(words, told, strict=True))
