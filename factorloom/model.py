"""Parameters, schemas and results of a factorisation."""

from __future__ import annotations

import json
import math
import time
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = "i long, j long, value double"
FACTOR = "axis string, idx long, name string, k int, mean double, sd double"
TRACE = "set_id int, stage int, phase string, iter int, chisq double, atoms_a int, atoms_p int"


@dataclass(frozen=True)
class Params:
    """Everything that decides a run.  ``alpha`` and ``max_gibbs_mass`` set both sides in :meth:`with_`."""

    n_patterns: int
    n_iterations: int = 50_000
    alpha_a: float = 0.01
    alpha_p: float = 0.01
    max_gibbs_mass_a: float = 100.0
    max_gibbs_mass_p: float = 100.0
    seed: int = field(default_factory=lambda: int(time.time() * 1000) % 1_000_000 or 1)
    sparse: bool = False
    distributed: str | None = None
    n_sets: int = 4
    cut: int | None = None
    min_ns: int | None = None
    max_ns: int | None = None
    explicit_sets: tuple[tuple, ...] | None = None
    sampling_annotation: tuple[str, ...] | None = None
    sampling_weight: Mapping[str, float] | None = None
    subset_indices: tuple[int, ...] | None = None
    subset_dim: int = 0
    gene_names: tuple[str, ...] | None = None
    sample_names: tuple[str, ...] | None = None
    checkpoint_interval: int = 0
    checkpoint_path: str | None = None
    fixed: str = "N"
    pump: bool = False
    output_frequency: int = 1000
    n_snapshots: int = 0
    snapshot_phase: str = "sampling"

    def __post_init__(self) -> None:
        mode = None if self.distributed in (None, "none") else self.distributed
        object.__setattr__(self, "distributed", mode)
        object.__setattr__(self, "cut", self.n_patterns if self.cut is None else self.cut)
        least = math.ceil(self.n_sets / 2) if self.min_ns is None else self.min_ns
        object.__setattr__(self, "min_ns", least)
        object.__setattr__(self, "max_ns", least + self.n_sets if self.max_ns is None else self.max_ns)
        positive = {"n_patterns": self.n_patterns, "n_iterations": self.n_iterations, "alpha_a": self.alpha_a, "alpha_p": self.alpha_p, "max_gibbs_mass_a": self.max_gibbs_mass_a, "max_gibbs_mass_p": self.max_gibbs_mass_p, "seed": self.seed, "n_sets": self.n_sets, "cut": self.cut, "min_ns": self.min_ns}
        for name, value in positive.items():
            if value <= 0:
                raise ValueError(f"{name} must be positive")
        if mode not in (None, "genome-wide", "single-cell"):
            raise ValueError(f"unknown distributed mode {mode}")
        if self.max_ns <= self.min_ns:
            raise ValueError("max_ns must be greater than min_ns")
        if self.fixed not in ("N", "A", "P"):
            raise ValueError("fixed must be A, P or N")
        if self.subset_dim not in (0, 1, 2):
            raise ValueError("subset_dim must be 0, 1 or 2")
        if self.snapshot_phase not in ("equilibration", "sampling", "all"):
            raise ValueError("unknown snapshot phase")
        if self.explicit_sets is not None:
            if len(self.explicit_sets) != self.n_sets:
                raise ValueError("n_sets must be the number of explicit sets")
            kinds = {isinstance(x, str) for s in self.explicit_sets for x in s}
            if len(kinds) > 1:
                raise ValueError("explicit sets are all names or all indices")
        if self.sampling_weight is not None and self.sampling_annotation is not None and not set(self.sampling_annotation) >= set(self.sampling_weight):
            raise ValueError("weights name groups that the annotation lacks")

    def with_(self, **changes: Any) -> Params:
        """A changed copy; fewer patterns lower ``cut``, and dependent set sizes follow ``n_sets``."""
        for both in ("alpha", "max_gibbs_mass"):
            if both in changes:
                value = changes.pop(both)
                changes |= {f"{both}_a": value, f"{both}_p": value}
        unknown = set(changes) - {f.name for f in fields(self)}
        if unknown:
            raise TypeError(f"unknown parameters {sorted(unknown)}")
        if "n_patterns" in changes and "cut" not in changes:
            changes["cut"] = min(self.cut, changes["n_patterns"])
        return replace(self, **changes)

    def with_distributed(self, n_sets: int = 4, cut: int | None = None, min_ns: int | None = None, max_ns: int | None = None) -> Params:
        return replace(self, n_sets=n_sets, cut=cut, min_ns=min_ns, max_ns=max_ns)

    def with_annotation(self, annotation: Sequence[str], weights: Mapping[str, float]) -> Params:
        return replace(self, sampling_annotation=tuple(annotation), sampling_weight=dict(weights))

    def get(self, name: str) -> Any:
        return getattr(self, name)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Params:
        raw = json.loads(text)
        for name in ("explicit_sets", "sampling_annotation", "subset_indices", "gene_names", "sample_names"):
            if raw.get(name) is not None:
                raw[name] = tuple(tuple(x) if isinstance(x, list) else x for x in raw[name])
        return Params(**raw)

    def __repr__(self) -> str:
        lines = [f"patterns {self.n_patterns}, iterations {self.n_iterations}, seed {self.seed}, {'sparse' if self.sparse else 'dense'}"]
        lines.append(f"alpha {self.alpha_a}, {self.alpha_p}; largest Gibbs mass {self.max_gibbs_mass_a}, {self.max_gibbs_mass_p}")
        if self.distributed:
            lines.append(f"{self.distributed}: {self.n_sets} sets, cut {self.cut}, clusters of {self.min_ns} to {self.max_ns}")
        return "Params(" + "; ".join(lines) + ")"


@dataclass
class Result:
    """Two factor tables (axis A: genes, P: samples), the trace, and what describes the run.

    ``factors`` follows ``FACTOR``.  In a run with a fixed side that side is returned as
    it was given, with standard deviation 0.
    """

    factors: DataFrame
    trace: DataFrame
    params: Params
    mean_chisq: float
    metadata: dict = field(default_factory=dict)

    def _side(self, axis: str) -> DataFrame:
        return self.factors.where(F.col("axis") == axis)

    @property
    def feature_loadings(self) -> DataFrame:
        return self._side("A")

    amplitude_matrix = feature_loadings

    @property
    def sample_factors(self) -> DataFrame:
        return self._side("P")

    pattern_matrix = sample_factors

    def _distributed_only(self, name: str) -> Any:
        if name not in self.metadata:
            warnings.warn(f"{name}: only distributed runs have it", stacklevel=3)
            return None
        return self.metadata[name]

    @property
    def unmatched_patterns(self) -> Any:
        return self._distributed_only("unmatched_patterns")

    @property
    def clustered_patterns(self) -> Any:
        return self._distributed_only("clustered_patterns")

    @property
    def correlation_to_mean(self) -> Any:
        return self._distributed_only("correlation_to_mean")

    @property
    def subsets(self) -> Any:
        return self._distributed_only("subsets")

    @property
    def version(self) -> str:
        from . import __version__

        return __version__

    def __repr__(self) -> str:
        return f"Result({self.metadata.get('n_genes', '?')} genes x {self.metadata.get('n_samples', '?')} samples, {self.params.n_patterns} patterns, chi-square {self.mean_chisq:.4g})"


def build_report() -> str:
    """Versions of what a run depends on."""
    import numpy
    import pyarrow
    import pyspark

    from . import __version__

    return f"factorloom {__version__}; spark {pyspark.__version__}; numpy {numpy.__version__}; arrow {pyarrow.__version__}; checkpoints on; parallel over sets and chains"
