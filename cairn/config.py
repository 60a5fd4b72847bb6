"""Settings of a reconstruction, with named presets."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Config:
    max_image_size: int = 1600
    features: int = 8000
    contrast_threshold: float = 0.004
    edge_threshold: float = 10.0
    ratio_test: float = 2.0
    min_matches: int = 8
    max_reproj_px: float = 4.0
    pnp_threshold_px: float = 4.0
    init_min_inliers: int = 80
    init_probe_pairs: int = 40
    min_track_length: int = 2
    ba_every: int = 1
    ba_iterations: int = 30
    ba_ftol: float = 1e-4
    ba_huber_px: float = 2.0
    refine_intrinsics: bool = True
    focal_factor: float = 1.2
    dense_max_size: int = 1200
    dense_neighbors: int = 4
    dense_max_angle: float = 30.0
    block_size: int = 5
    uniqueness: int = 5
    sor_k: int = 16
    sor_std_ratio: float = 2.0
    voxel_size: float = 0.0
    dense_max_points: int = 5_000_000
    seed: int = 42


#: max_image_size, features, dense_max_size, dense_neighbors of each preset, fixed values.
PRESETS = {
    "fast": (1000, 4000, 800, 2),
    "balanced": (1600, 8000, 1200, 4),
    "high": (2400, 12000, 1800, 6),
    "ultra": (3200, 20000, 2600, 8),
}


def build_config(preset: str | None = None, **given: object) -> Config:
    """Defaults, overridden by a preset (an unknown one is `balanced`), overridden by what is given.

    None, and zero for voxel_size and max_image_size, mean "not given".
    """
    config = Config()
    if preset is not None:
        names = ("max_image_size", "features", "dense_max_size", "dense_neighbors")
        config = replace(config, **dict(zip(names, PRESETS.get(preset, PRESETS["balanced"]), strict=True)))
    kept = {k: v for k, v in given.items() if v is not None and not (k in ("voxel_size", "max_image_size") and v == 0)}
    return replace(config, **kept)


def ratio_threshold(ratio: float) -> float:
    """The ratio test's factor: above 1 its inverse (2.0 is 0.5); 0.75 where that is not below 1."""
    factor = 1.0 / ratio if ratio > 1.0 else ratio
    return 0.75 if factor >= 1.0 else factor
