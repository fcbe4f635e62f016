"""Run configuration: a frozen dataclass, strict YAML loading and a content key for derived tables."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, fields

import yaml

from cellshift import __version__

# A gene must be detected in at least this share of all cells (and in at least MIN_DETECTED_CELLS).
DETECTION_FRACTION = 0.01
MIN_DETECTED_CELLS = 3

# Fields that do not change what is computed, only where it is put.
_LOCATION_FIELDS = {"cache_dir", "out_dir"}


# Names and defaults of the benchmark's settings.
@dataclass(frozen=True)
class Config:
    dataset: str = "sciplex3"
    seed: int = 0
    min_genes: int = 200
    max_pct_mito: float = 50.0
    min_cells_per_condition: int = 30
    n_hvg: int | None = 2000
    gene_set: str = "hvg"
    n_ceiling_reps: int = 10
    cache_dir: str = "cache"
    out_dir: str = "outputs"
    de_alpha: float = 0.05

    def __post_init__(self) -> None:
        if self.gene_set not in ("hvg", "all"):
            raise ValueError(f"gene_set is {self.gene_set!r}; expected 'hvg' or 'all'")
        if self.gene_set == "hvg" and self.n_hvg is None:
            raise ValueError("n_hvg must be set when gene_set is 'hvg'")

    @classmethod
    def from_yaml(cls, path) -> "Config":
        with open(path) as handle:
            given = yaml.safe_load(handle) or {}
        extra = sorted(set(given) - {f.name for f in fields(cls)})
        if extra:
            raise ValueError(f"{path}: unknown configuration keys {extra}")
        return cls(**given)

    def to_dict(self) -> dict:
        return asdict(self)

    def cache_key(self, source: str = "") -> str:
        """Key of the derived tables: every content field, the input location and the code version."""
        content = {k: v for k, v in asdict(self).items() if k not in _LOCATION_FIELDS}
        content.update(source=source, version=__version__, detection=DETECTION_FRACTION)
        return hashlib.sha256(json.dumps(content, sort_keys=True).encode()).hexdigest()[:16]
