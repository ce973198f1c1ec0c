"""Settings of the mosaic pipeline. Lengths are shares of the field of view's diameter."""

from __future__ import annotations

import dataclasses
import json


@dataclasses.dataclass(frozen=True)
class Settings:
    # Names and defaults of all settings.
    mask_margin: float = 0.04
    analysis_fps: float = 10.0
    min_sharpness: float = 0.6
    min_sharpness_abs: float = 0.0
    keyframe_min_shift: float = 0.2
    expected_overlap: float = 0.3  # accepted, and used by nothing
    max_rotation_deg: float = 0.0
    lost_patience: int = 3
    work_diameter: int = 640
    coarse_diameter: int = 256
    min_ncc: float = 0.2
    max_peak_ratio: float = 0.9
    min_quality: float = 0.5
    min_overlap_area: float = 0.1
    loop_closure: bool = True
    max_neighbours: int = 8
    outlier_threshold: float = 0.01
    link_min_matches: int = 3
    link_samples: int = 12
    link_candidates_per_sample: int = 3
    link_tolerance: float = 0.03
    link_edge_band: float = 0.05
    link_min_content: float = 0.15
    link_dark_level: float = 25.0
    link_verify_pairs: int = 4
    link_verify_min: int = 2
    link_gap_window: float = 0.35
    link_gap_keyframes: int = 3
    link_diagnostics: bool = True
    save_unlinked: bool = True
    min_component_keyframes: int = 3
    keep_merge_data: bool = True
    manual_min_pairs: int = 2
    blending: str = "multiband"
    blend_levels: int = 5
    feather_power: float = 1.5
    flat_field: bool = True
    interpolation: str = "cubic"
    tile_size: int = 2048
    tiff_compression: str = "zlib"
    preview_max_size: int = 2400
    jpeg_quality: int = 92
    cache_dir: str | None = None
    keep_cache: bool = False
    threads: int = 0

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), indent=2)

    @classmethod
    def from_json(cls, text: str) -> Settings:
        """Keys that are no settings are ignored."""
        known = {f.name for f in dataclasses.fields(cls)}
        return cls(**{k: v for k, v in json.loads(text).items() if k in known})

    def replace(self, **changes) -> Settings:
        return dataclasses.replace(self, **changes)
