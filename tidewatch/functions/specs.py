"""Named feature layouts, and columns picked by feature name."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FeatureSpec:
    name: str
    reducers: tuple[str, ...]
    subcortical: str = "none"
    n_subcortical: int = 0
    window: int = 1

    def names(self, regions: list[str]) -> list[str]:
        """Region by region, its reducers in turn, then the sub-cortical ones."""
        return [f"{r}:{m}" for r in regions for m in self.reducers] + [f"sub:{i}" for i in range(self.n_subcortical)]


# The layouts that models are stored under.
SPECS = {
    s.name: s
    for s in (
        FeatureSpec("cortical_mean400", ("mean",)),
        FeatureSpec("cortical_mean_std800", ("mean", "std")),
        FeatureSpec("subcortical_fake8", (), "fake8", 8),
        FeatureSpec("subcortical_real16", (), "real16", 16),
        FeatureSpec("subcortical_pca32", (), "pca32", 32),
        FeatureSpec("fused_v1", ("mean", "std"), "fake8", 8),
        FeatureSpec("fused_v2", ("mean", "std"), "real16", 16),
    )
}


def resolve_spec(name: str, window: int | None = None) -> FeatureSpec:
    if name not in SPECS:
        raise ValueError(f"unknown feature layout: {name}")
    spec = SPECS[name]
    return spec if window is None else FeatureSpec(spec.name, spec.reducers, spec.subcortical, spec.n_subcortical, window)


#: Where heat maps come from, by name; the first where nothing else is said. Fixed values.
HEATMAP_BACKENDS = ("deepgaze_msdb", "modal", "visual_saliency", "uniform")
_BACKEND_VARIABLE = "PIPELINE_HEATMAP_BACKEND"


def resolve_backend(requested: str | None = None, environ: Mapping[str, str] | None = None) -> str:
    """The backend asked for, else the environment's, else the default; an unknown one is an error."""
    name = (requested or (os.environ if environ is None else environ).get(_BACKEND_VARIABLE) or HEATMAP_BACKENDS[0]).strip().lower()
    if name not in HEATMAP_BACKENDS:
        raise ValueError(f"unknown backend {name!r}, known are {', '.join(HEATMAP_BACKENDS)}")
    return name


def pick(vec: Column, names: list[str], wanted: list[str]) -> Column:
    """The wanted features of a vector, by name."""
    at = {n: i for i, n in enumerate(names)}
    return F.array(*[F.get(vec, F.lit(at[w])) for w in wanted])
