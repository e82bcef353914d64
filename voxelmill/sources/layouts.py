"""How rows become bytes: an encoder for each section of a file, over an Arrow batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .adapter import RAW
from .files import floats

VERTEX, NORMAL, COLOR, CORNERS = ("x", "y", "z"), ("nx", "ny", "nz"), ("cr", "cg", "cb"), ("a", "b", "c")
PLY_VERTEX = np.dtype([("p", "<f4", 6), ("c", "u1", 3)])
PLY_FACE = np.dtype([("n", "u1"), ("i", "<u4", 3)])
#: A record of the SPLAT format: position, scales, color and opacity, rotation (w, x, y, z).
SPLAT = np.dtype([("p", "<f4", 3), ("s", "<f4", 3), ("c", "u1", 4), ("q", "u1", 4)])


def as_bytes(share: np.ndarray) -> np.ndarray:
    """Shares of one as bytes, halves up."""
    return np.clip(np.floor(share.astype(np.float64) * 255 + 0.5), 0, 255).astype("u1")


def integers(batch: pa.RecordBatch, *names: str) -> np.ndarray:
    return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names]).astype("<u4")


def doubles(batch: pa.RecordBatch, *names: str) -> np.ndarray:
    return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in names])


def lines(mark: str, rows: np.ndarray) -> bytes:
    return "".join(f"{mark}{' '.join(map(repr, r))}\n" for r in rows.tolist()).encode()


def short(table: np.ndarray) -> np.ndarray:
    """Singles as the doubles whose digits Python prints."""
    return table.astype(np.float32).astype(np.float64)


def ply_vertex(batch: pa.RecordBatch) -> bytes:
    out = np.zeros(batch.num_rows, PLY_VERTEX)
    out["p"], out["c"] = floats(batch, *VERTEX, *NORMAL), as_bytes(doubles(batch, *COLOR))
    return out.tobytes()


def ply_face(batch: pa.RecordBatch) -> bytes:
    out = np.zeros(batch.num_rows, PLY_FACE)
    out["n"], out["i"] = 3, integers(batch, *CORNERS)
    return out.tobytes()


def obj_face(batch: pa.RecordBatch) -> bytes:
    return "".join(f"f {a}//{a} {b}//{b} {c}//{c}\n" for a, b, c in (integers(batch, *CORNERS).astype(np.int64) + 1).tolist()).encode()


def splat_record(batch: pa.RecordBatch) -> bytes:
    out = np.zeros(batch.num_rows, SPLAT)
    out["p"], out["s"] = floats(batch, *VERTEX), floats(batch, "s0", "s1", "s2")
    out["c"] = as_bytes(doubles(batch, *COLOR, "opacity"))
    out["q"] = np.clip(np.floor(doubles(batch, "q0", "q1", "q2", "q3") * 128 + 128.5), 0, 255)
    return out.tobytes()


#: Encoders by layout, in the order of the file's sections.
SECTIONS = {
    "ply": [ply_vertex, ply_face],
    "obj": [lambda b: lines("v ", short(doubles(b, *VERTEX, *COLOR))), lambda b: lines("vn ", short(doubles(b, *NORMAL))), obj_face],
    "glb": [*(lambda b, names=names: floats(b, *names).tobytes() for names in (VERTEX, NORMAL, COLOR)), lambda b: integers(b, *CORNERS).tobytes()],
    "splat": [splat_record],
    "splat-ply": [lambda b: floats(b, *RAW).tobytes()],
    "splat-ply-ascii": [lambda b: lines("", short(doubles(b, *RAW)))],
}
