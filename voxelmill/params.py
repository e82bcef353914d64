"""Parameters of a conversion, presets, and the policy for large inputs."""

from __future__ import annotations

import math

from dataclasses import dataclass, replace

# Resolution, opacity threshold and support radius of the presets.
PRESETS = {"fast": (64, 0.035, 3.0), "balanced": (96, 0.02, 3.0), "detailed": (160, 0.012, 3.0)}
# Limits of the dense grid.
MAX_AXIS = 512
MAX_GRID_BYTES = 640 * 1024 * 1024
MIB = 1024 * 1024


@dataclass(frozen=True)
class Params:
    resolution: int = 96
    opacity_threshold: float = 0.02
    sigma_radius: float = 3.0
    bounds_quantile: float = 0.01
    crop_enabled: bool = False
    crop_min: tuple[float, float, float] = (0.0, 0.0, 0.0)
    crop_max: tuple[float, float, float] = (1.0, 1.0, 1.0)
    iso: float | None = None
    keep_largest: bool = True
    min_component_faces: int = 16
    smoothing: int = 1
    taubin_classic: bool = False
    decimation_ratio: float = 1.0
    decimation_method: str = "quadric"
    denoise: int = 0
    fill_voids: bool = False
    surface_field: str = "density"
    distance_band: int = 4
    max_hole_edges: int = 0
    slab_mode: bool = False
    slab_depth: int = 24


def with_preset(name: str, params: Params = Params()) -> Params:
    resolution, opacity, sigma = PRESETS[name]
    return replace(params, resolution=resolution, opacity_threshold=opacity, sigma_radius=sigma)


def suggest(n_gaussians: int, n_bytes: int, params: Params = Params()) -> Params:
    """Large inputs get the fast preset; very large ones run slab by slab too."""
    if n_bytes >= 100 * MIB or n_gaussians >= 500_000:
        params = with_preset("fast", params)
    if n_bytes >= 250 * MIB or n_gaussians >= 1_000_000:
        params = replace(params, slab_mode=True)
    return params


def format_bytes(n: float) -> str:
    """Whole bytes below a KiB; above, the largest fitting unit up to GiB, with one digit below 10."""
    if math.isnan(n) or math.isinf(n) or n < 0:
        return "—"
    power = min(3, int(math.log2(n) // 10)) if n >= 1 else 0
    size = n / 1024**power
    return f"{size:.{1 if power and size < 10 else 0}f} {('B', 'KiB', 'MiB', 'GiB')[power]}"
