"""Every query with SQL gives DuckDB's rows."""

from pathlib import Path

import duckdb
import pytest

from voxelmill.plans import files, registry  # noqa: F401  files adds its queries

FAST = ["activated", "filter_report", "preview_sample", "scale_ratio_quantiles", "tile_candidates", "density_tilejoin", "auto_iso", "denoise", "enclosed_voids", "signed_distance", "mesh_faces", "vertex_colors", "components_by_edge", "compact_ids", "smoothed", "cluster_decimated", "face_dedup", "vertex_quadrics", "quadric_edge_costs", "hole_loops", "holes_filled", "welded", "finite_report", "robust_bounds", "diagnostic_anisotropic", "diagnostic_crop", "inspection", "topology", "quadric_decimated", "ply_source", "ply_ascii_source", "splat_source", "obj_sink", "reclassified", "session_conversion", "slab_voids", "slab_distance", "stream_histogram"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return round(float(v), 5) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", FAST)
def test_query_against_sql(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    own = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert own == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=str)


def test_every_query_is_callable():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
