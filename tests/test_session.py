"""Errors by their causes, cancelling from another thread, progress within stages."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from voxelmill import errors
from voxelmill.operators import bounds
from voxelmill.params import Params
from voxelmill.session import SplatSession
from voxelmill.sources import read_splats, sinks
from voxelmill.sources.adapter import raw_from_embeddings


@pytest.fixture(scope="module")
def raw(spark):
    return raw_from_embeddings(spark, "/root/testdata/sf0.001/embeddings.parquet")


def test_causes_have_classes_and_advice(spark, raw, tmp_path):
    (tmp_path / "a.ply").write_bytes(b"plx")
    for act, kind in (
        (lambda: read_splats(spark, "a.ksplat"), errors.UnsupportedSource), (lambda: read_splats(spark, "a.xyz"), errors.UnsupportedSource), (lambda: read_splats(spark, str(tmp_path / "a.ply")), errors.SourceError),
        (lambda: bounds.robust_bounds(raw.where("false").withColumns({f"r{k}": F.lit(0.0) for k in range(9)}), 3.0, 0.01), errors.EmptyScene),
        (lambda: SplatSession(spark).start(Params()), errors.NotReady), (lambda: SplatSession(spark).extract(Params()), errors.NotReady), (lambda: SplatSession(spark).load_raw(raw.where("false")), errors.EmptyScene),
    ):
        with pytest.raises(kind) as found:
            act()
        assert found.value.told().startswith(str(found.value)) and isinstance(found.value, errors.ConversionError)
    assert "lower resolution" in errors.GridTooLarge("x").told() and errors.NotReady("x").told() == "x"


def test_no_message_decides_about_a_cause(spark):
    plain = ValueError("memory of a cancelled PLY property")
    assert errors.cause_of(plain) is plain
    assert isinstance(errors.cause_of(plain, cancelled=True), errors.Cancelled)
    try:
        try:
            raise MemoryError
        except MemoryError as inner:
            raise RuntimeError("outer") from inner
    except RuntimeError as outer:
        assert isinstance(errors.cause_of(outer), errors.OutOfMemory)
    with pytest.raises(Exception) as found:  # noqa: PT011
        spark._jvm.java.util.Objects.requireNonNull(None)
    assert errors._jvm_classes(found.value) == ["java.lang.NullPointerException"] and errors.cause_of(found.value) is found.value


def test_cancel_from_another_thread(spark, raw):
    session = SplatSession(spark)
    slow = raw.withColumn("x", F.col("x") + F.expr("IF(java_method('java.lang.Thread', 'sleep', 30L) IS NULL, 0D, 0D)"))
    threading.Thread(target=lambda: (time.sleep(1.5), session.cancel())).start()
    with pytest.raises(errors.Cancelled):
        session.load_raw(slow.repartition(64))
    assert session.load_raw(raw)["retained_count"] > 0
    session.dispose()


def test_progress_follows_the_tasks(spark, raw):
    told = []
    session = SplatSession(spark, lambda *t: told.append(t), watch_every=0.02)
    slow = raw.repartition(32).withColumn("x", F.col("x") + F.expr("IF(java_method('java.lang.Thread', 'sleep', 5L) IS NULL, 0D, 0D)"))
    session.load_raw(slow)
    session.dispose()
    within = [share for stage, share, _ in told if stage == "parsing"]
    assert len(within) > 2 and within == sorted(within) and within[0] == 0 and within[-1] < 1
    assert [w for *_, w in told] == sorted(w for *_, w in told)


def test_report_of_a_conversion(spark, raw, tmp_path):
    session = SplatSession(spark)
    session.load_raw(raw)
    params = Params(resolution=12)
    result = session.start(params)
    text = sinks.benchmark_report(result, "scene.ply", 1234, {"total": 5.0}, {"resolution": 12})
    told = json.loads(text)
    assert told["source"] == {"name": "scene.ply", "bytes": 1234, "format": result.report["source_format"], "inputGaussians": raw.count(), "retainedGaussians": result.report["retained_count"]}
    assert told["result"]["dims"] == list(result.grid.dims) and told["result"]["voxelCount"] == result.grid.voxels
    assert told["result"]["triangles"] == result.mesh.faces.count() and told["result"]["topology"] == result.quality.first().asDict()
    low, high = told["result"]["densityRange"]
    assert low == 0 < high and told["params"] == {"resolution": 12} and told["gpu"] is None
    (tmp_path / "scene.json").write_text(text)
    row = sinks.summarize_reports(spark, str(tmp_path)).first()
    assert (row["vendor"], row["backend"], row["grid"], row["max_abs_error"]) == ("Unknown", "spark", "×".join(map(str, result.grid.dims)), 0.0)
    session.dispose()
