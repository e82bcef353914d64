"""Scalar SQL of a Gaussian: text that any SQL engine with doubles reads, made of column names."""

from __future__ import annotations

# Fixed value: the constant of the first spherical harmonic.
C0 = "0.28209479177387814"
GRAY = (0.55, 0.58, 0.62)
#: The columns of an activated Gaussian after its id.
ACTIVATED = ("x", "y", "z", "s0", "s1", "s2", *(f"r{i}" for i in range(9)), "opacity", "cr", "cg", "cb")


def sigmoid(x: str) -> str:
    """Stable on both sides: only exponentials of negative numbers."""
    return f"(CASE WHEN {x} >= 0 THEN 1 / (1 + exp(-abs({x}))) ELSE exp(-abs({x})) / (1 + exp(-abs({x}))) END)"


def activated_scale(s: str, floor: str = "0.00001") -> str:
    return f"greatest(CAST({floor} AS DOUBLE), exp({s}))"


def activated_color(f: str, gray: float) -> str:
    """A missing or non-finite coefficient gives gray."""
    return f"(CASE WHEN {f} IS NULL OR isnan({f}) OR abs({f}) > 1e308 THEN CAST({gray} AS DOUBLE) ELSE least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), 0.5 + {C0} * {f})) END)"


def rotation(w: str, x: str, y: str, z: str) -> list[str]:
    """Row-major matrix of a unit quaternion."""
    return [
        f"1 - 2 * ({y} * {y} + {z} * {z})", f"2 * ({x} * {y} - {w} * {z})", f"2 * ({x} * {z} + {w} * {y})",
        f"2 * ({x} * {y} + {w} * {z})", f"1 - 2 * ({x} * {x} + {z} * {z})", f"2 * ({y} * {z} - {w} * {x})",
        f"2 * ({x} * {z} - {w} * {y})", f"2 * ({y} * {z} + {w} * {x})", f"1 - 2 * ({x} * {x} + {y} * {y})",
    ]


def half_extent(axis: int, sigma: float) -> str:
    """Half the side of the box that holds the support, along one axis."""
    return f"{sigma} * (" + " + ".join(f"abs(r{3 * axis + k}) * s{k}" for k in range(3)) + ")"


def distance2(px: str, py: str, pz: str) -> str:
    """Squared distance of a point from the Gaussian, in units of its scales."""
    rows = []
    for k in range(3):
        u = f"(r{k} * ({px} - x) + r{3 + k} * ({py} - y) + r{6 + k} * ({pz} - z)) / s{k}"
        rows.append(f"({u}) * ({u})")
    return "(" + " + ".join(rows) + ")"
