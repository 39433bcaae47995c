"""Parameter records and their checks."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

WAVELETS = ("db4", "sym2", "sym4", "coif1")
DECOMPOSITIONS = {"modwt": "modwt", "swt": "modwt", "dwt": "dwt", "wavedec": "dwt"}
REDUCERS = ("max", "mean", "median", "geometric")
SWEEP_LEVELS, SWEEP_INFLATION = (2, 6), (1.2, 2.8)


@dataclass(frozen=True)
class Params:
    """Settings of one run; construction checks them."""

    wavelet: str = "db4"
    level: int = 4
    decomposition: str = "modwt"
    winsor_low: float = 0.03
    winsor_high: float = 0.03
    zscore: bool = True
    sparse_ratio: float = 0.5
    rolling_window: int = 0
    quantile: float = 0.9
    layer_step: float = 1.5
    negative_weight: float = 1.25
    reducer: str = "max"
    layer_weighting: bool = True
    inflation: float = 1.8
    expansion: int = 2
    pruning: float = 1e-3
    iterations: int = 100
    seed: int = 42

    def __post_init__(self):
        if self.wavelet not in WAVELETS:
            raise ValueError(f"wavelet must be one of {WAVELETS}")
        if self.decomposition not in DECOMPOSITIONS:
            raise ValueError(f"decomposition must be one of {tuple(DECOMPOSITIONS)}")
        if not 1 <= self.level <= 6:
            raise ValueError("level must be between 1 and 6")
        if not 0 <= self.quantile <= 1:
            raise ValueError("quantile must be between 0 and 1")
        if min(self.winsor_low, self.winsor_high) < 0 or self.winsor_low + self.winsor_high >= 1:
            raise ValueError("winsor limits must be at least 0 and add up to less than 1")
        check_signed(self.layer_step, self.negative_weight, self.reducer, self.layer_weighting)


def check_signed(layer_step: float, negative_weight: float, reducer: str, layer_weighting: bool, interaction: str = "sqrt") -> None:
    if reducer not in REDUCERS:
        raise ValueError(f"reducer must be one of {REDUCERS}")
    if interaction != "sqrt":
        raise ValueError("interaction must be sqrt")
    if not isinstance(layer_weighting, bool):
        raise ValueError("layer_weighting must be a boolean")
    for name, v in (("layer_step", layer_step), ("negative_weight", negative_weight)):
        if not math.isfinite(v) or v < 0:
            raise ValueError(f"{name} must be finite and at least 0")


def check_sweep(level: int, inflation: float) -> None:
    if not SWEEP_LEVELS[0] <= level <= SWEEP_LEVELS[1]:
        raise ValueError(f"level must be in {SWEEP_LEVELS}")
    if not SWEEP_INFLATION[0] <= inflation <= SWEEP_INFLATION[1]:
        raise ValueError(f"inflation must be in {SWEEP_INFLATION}")


def from_dict(values: dict) -> Params:
    """Params from a configuration's values; unknown names are an error."""
    known = {f.name for f in fields(Params)}
    if extra := set(values) - known:
        raise ValueError(f"unknown parameters: {sorted(extra)}")
    return Params(**values)


def band_names(level: int) -> list[str]:
    """Names of the bands in order: the approximation, then details from coarse to fine."""
    return [f"CA{level}", *(f"CD{j}" for j in range(level, 0, -1))]
