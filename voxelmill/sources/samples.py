"""Deterministic samples: three shells of splats, and a small ASCII sphere."""

from __future__ import annotations

import math
from collections.abc import Iterator

from .adapter import RAW

# Seed and constants of the sample's number sequence, shells and points.
SEED, FACTOR, STEP = 0x3D9F2A17, 1664525, 1013904223
SHELLS, POINTS = 3, 180


def sequence(seed: int = SEED) -> Iterator[float]:
    while True:
        seed = (FACTOR * seed + STEP) % 2**32
        yield seed / 2**32


def quaternion(yaw: float, pitch: float, roll: float) -> tuple[float, float, float, float]:
    (cr, sr), (cp, sp), (cy, sy) = ((math.cos(a / 2), math.sin(a / 2)) for a in (roll, pitch, yaw))
    return cr * cp * cy + sr * sp * sy, sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy


def shells() -> list[dict[str, float]]:
    """Raw rows; draws come in the order jitter, yaw, pitch, roll, size, opacity, the three scales."""
    draw, out, golden = sequence(), [], math.pi * (3 - math.sqrt(5))
    for shell in range(SHELLS):
        for i in range(POINTS):
            jitter, a, b, c, size, o, *three = (next(draw) for _ in range(9))
            y = 1 - 2 * (i + 0.5) / POINTS
            ring, angle = math.sqrt(max(0.0, 1 - y * y)), golden * i + 0.35 * shell
            p = (math.cos(angle) * ring, y, math.sin(angle) * ring)
            turn = quaternion(math.atan2(p[2], p[0]) + (a - 0.5) * 0.3, math.asin(y) + (b - 0.5) * 0.25, (c - 0.5) * 0.7)
            scale = 0.14 + 0.012 * shell + 0.025 * size
            scales = [math.log(scale * (low + wide * t)) for (low, wide), t in zip(((0.9, 0.2), (0.8, 0.2), (1.1, 0.25)), three, strict=True)]
            place = [v * (0.46 + 0.24 * shell) + (jitter - 0.5) * 0.015 for v in p]
            out.append(dict(zip(RAW, [*place, 1.65 + (o - 0.5) * 0.2, *scales, *turn, *((v + 1) * 1.6 - 0.8 for v in p)], strict=True)))
    return out


def ascii_sphere(n: int = 128) -> str:
    """An ASCII PLY of ``n`` splats on the unit sphere, colored by position."""
    head = ["ply", "format ascii 1.0", f"element vertex {n}", *(f"property float {c}" for c in RAW), "end_header"]
    golden, rows = math.pi * (3 - math.sqrt(5)), []
    for i in range(n):
        y = 1 - 2 * (i + 0.5) / n
        ring = math.sqrt(1 - y * y)
        p = (ring * math.cos(golden * i), y, ring * math.sin(golden * i))
        rows.append(" ".join(f"{v:.8g}" for v in (*p, 3.5, *map(math.log, (0.22, 0.14, 0.18)), 1, 0, 0, 0, *p)))
    return "\n".join([*head, *rows]) + "\n"
