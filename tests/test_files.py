"""Files written and read by many tasks: the same bytes and rows however the work is split."""

import gzip
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.errors import SourceError
from voxelmill.operators.surface import Mesh
from voxelmill.sources import files, layouts, packed, ply, samples, sinks
from voxelmill.sources.adapter import RAW


@pytest.fixture(scope="module")
def big_mesh(spark):
    n = 5000
    v = spark.range(n).select(F.col("id").alias("vid"), *[(F.rand(k) * 10 - 5).alias(c) for k, c in enumerate(("x", "y", "z", "nx", "ny", "nz"))], *[F.rand(k).alias(c) for k, c in enumerate(("cr", "cg", "cb"), 9)])
    v = v.withColumn("nx", F.when(F.col("vid") % 100 > 0, F.col("nx")).otherwise(float("nan"))).repartition(7)
    f = spark.range(2 * n).select(F.col("id").alias("fid"), *[F.pmod(F.hash("id", F.lit(c)), F.lit(n)).cast("bigint").alias(c) for c in "abc"]).repartition(5)
    return Mesh(v, f)


def expected_ply(vertices, faces):
    out = b""
    for r in vertices:
        floats = [r[c] if np.isfinite(r[c]) else 0.0 for c in ("x", "y", "z", "nx", "ny", "nz")]
        out += struct.pack("<6f3B", *floats, *(int(np.floor(r[c] * 255 + 0.5)) for c in ("cr", "cg", "cb")))
    return out + b"".join(struct.pack("<B3I", 3, r["a"], r["b"], r["c"]) for r in faces)


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_mesh_files_do_not_depend_on_the_tasks(spark, big_mesh, tmp_path, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for kind, write in (("ply", sinks.write_ply), ("obj", sinks.write_obj), ("glb", sinks.write_glb)):
            write(big_mesh, str(tmp_path / f"m.{kind}"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["m.glb", "m.obj", "m.ply"]
    vertices, faces = big_mesh.vertices.orderBy("vid").collect(), big_mesh.faces.orderBy("fid").collect()
    head, _, body = (tmp_path / "m.ply").read_bytes().partition(b"end_header\n")
    assert b"element vertex 5000" in head and b"element face 10000" in head and body == expected_ply(vertices, faces)
    lines = (tmp_path / "m.obj").read_text().splitlines()
    assert len(lines) == 1 + 5000 + 5000 + 10_000
    short = lambda v: repr(float(np.float32(v)))
    assert lines[1 + 17] == "v " + " ".join(short(vertices[17][c]) for c in ("x", "y", "z", "cr", "cg", "cb"))
    assert lines[-1] == "f " + " ".join(f"{faces[-1][c] + 1}//{faces[-1][c] + 1}" for c in "abc")
    glb = (tmp_path / "m.glb").read_bytes()
    size = struct.unpack("<I", glb[12:16])[0]
    doc, blob = json.loads(glb[20 : 20 + size]), glb[28 + size :]
    assert struct.unpack("<I", glb[8:12])[0] == len(glb) and len(blob) == doc["buffers"][0]["byteLength"]
    assert np.allclose(np.frombuffer(blob, "<f4", 15_000).reshape(-1, 3), [[r[c] for c in "xyz"] for r in vertices])
    assert np.frombuffer(blob[-120_000:], "<u4").reshape(-1, 3).tolist() == [[r[c] for c in "abc"] for r in faces]
    back, triangles = ply.read_mesh_ply(spark, str(tmp_path / "m.ply"))
    assert [tuple(r) for r in triangles.orderBy("fid").collect()] == [(r["fid"], r["a"], r["b"], r["c"]) for r in faces]
    assert np.allclose([[r[c] for c in "xyz"] for r in back.orderBy("vid").collect()], [[r[c] for c in "xyz"] for r in vertices])


def test_empty_mesh_and_failed_write(spark, big_mesh, tmp_path):
    none = Mesh(big_mesh.vertices.where("false"), big_mesh.faces.where("false"))
    sinks.write_ply(none, str(tmp_path / "e.ply"))
    assert (tmp_path / "e.ply").read_bytes().endswith(b"end_header\n")
    bad = big_mesh.vertices.withColumn("x", F.when(F.col("vid") == 4999, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="lost"):
        files.write_file(bad.withColumn("section", F.lit(0)).withColumn("id", F.col("vid")), str(tmp_path / "f.glb"), "glb", b"")
    assert [p.name for p in tmp_path.iterdir()] == ["e.ply"]


@pytest.mark.parametrize("chunk", [11, 1 << 22])
def test_ascii_ranges_of_any_size(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(ply, "CHUNK", chunk)
    text = samples.ascii_sphere()
    head, body = text.split("end_header\n")
    lines = body.strip().split("\n")
    for name, own in (("lf", "\n".join(lines) + "\n"), ("crlf", "\r\n".join(lines)), ("blank", "\n\n \n" + "\n\n".join(lines) + "\n3 0 1 2\n3 1 2 3\n")):
        path = tmp_path / f"{name}.ply"
        path.write_bytes((head + "end_header\n" + own).encode())
        whole = None
        for split in (64, 1000, 5003, 1 << 25) if chunk > 11 else (997,):
            got = [tuple(r) for r in ply.read_ply(spark, str(path), split).orderBy("gid").collect()]
            whole = whole or got
            assert got == whole and [r[0] for r in got] == list(range(128))
        reader = ply.PlyReader(str(path), ply.parse_header(path.read_bytes()[:2000]))
        assert whole == [tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    (tmp_path / "short.ply").write_text(head + "end_header\n" + "\n".join(lines[:-1]))
    with pytest.raises(SourceError, match="truncated"):
        ply.read_ply(spark, str(tmp_path / "short.ply"), 500)
    (tmp_path / "thin.ply").write_text(head + "end_header\n" + "\n".join([*lines[:-1], "1 2"]))
    with pytest.raises(Exception, match="truncated"):
        ply.read_ply(spark, str(tmp_path / "thin.ply"), 500).collect()


def test_splat_folder_has_one_numbering(spark, tmp_path):
    for k, n in enumerate((96, 1, 250)):
        (tmp_path / f"{k}.splat").write_bytes(b"".join(struct.pack("<6f8B", 1000 * k + i, 0, 0, 0.1, 0.2, 0.3, 255, 0, 51, 128, 255, 128, 128, 128) for i in range(n)))
    (tmp_path / "other.txt").write_text("no splats")
    for records in (7, 100, 10**6):
        got = packed.read_splat(spark, str(tmp_path), records)
        assert got.rdd.getNumPartitions() >= sum(-(-n // records) for n in (96, 1, 250))
        rows = got.select("gid", "x").orderBy("gid").collect()
        assert [tuple(r) for r in rows] == list(enumerate(float(1000 * k + i) for k, n in enumerate((96, 1, 250)) for i in range(n)))
    (tmp_path / "bad.splat").write_bytes(b"x" * 33)
    with pytest.raises(SourceError, match="multiple of 32"):
        packed.read_splat(spark, str(tmp_path))


def test_large_splat_is_many_tasks(spark, tmp_path):
    with open(tmp_path / "l.splat", "wb") as f:
        f.truncate(3 << 30)  # a sparse file of 3 GiB
    assert packed.read_splat(spark, str(tmp_path / "l.splat")).rdd.getNumPartitions() == -(-(3 << 30) // (32 * packed.RECORDS))


def test_spz_files_have_distinct_ids(spark, tmp_path):
    n = 3
    body = struct.pack("<IIIBBBB", packed.SPZ_MAGIC, 2, n, 0, 12, 0, 0) + bytes(9 * n) + bytes([255]) * n + bytes([128] * 3) * n + bytes([160] * 3) * n + bytes([127, 127, 127]) * n
    for name in "ab":
        (tmp_path / f"{name}.spz").write_bytes(gzip.compress(body))
    assert sorted(r["gid"] for r in packed.read_spz(spark, str(tmp_path)).collect()) == [0, 1, 2, *((1 << packed.POINT_BITS) + i for i in range(3))]


def test_splat_writer_round_trips(spark, tmp_path):
    raw = spark.createDataFrame([(r["gid"], *[float(r[c]) for c in RAW]) for r in ({"gid": i, **row} for i, row in enumerate(samples.shells()))], "gid bigint, " + ", ".join(f"{c} double" for c in RAW))
    for layout in ("splat-ply", "splat-ply-ascii"):
        sinks.write_splats(raw.repartition(6), str(tmp_path / f"{layout}.ply"), layout)
        got = ply.read_ply(spark, str(tmp_path / f"{layout}.ply"), 4000).orderBy("gid").collect()
        assert np.array_equal([[r[c] for c in RAW] for r in got], [[float(np.float32(r[c])) for c in RAW] for r in raw.orderBy("gid").collect()])
    assert layouts.as_bytes(np.array([0.0, 1.0, 0.5, 2.0, -1.0])).tolist() == [0, 255, 128, 255, 0]
