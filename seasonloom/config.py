"""Settings of fits, tuning and forecasts, checked when made."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

DOYS = 366
#: Fixed defaults of the model: the five features of the standard recipe, and the pool that selection draws from.
STANDARD = ("const", "TMIN_anom", "TD_anom_lag1", "TD_anom_lag2", "TMIN_anom_lag1")
POOL = ("const", "TMIN_anom", "TMIN_anom_lag1", "TMIN_anom_lag2", "TMIN_anom_lag7", "TMIN_anom_lag30", "TD_anom_lag1", "TD_anom_lag2", "TD_anom_lag3", "TD_anom_lag7", "TD_anom_lag30")
KERNELS = ("Tricube", "Gaussian")


@dataclass(frozen=True)
class Feature:
    """One regressor: const, <VAR>_anom or <VAR>_anom_lag<k>."""

    name: str

    def __post_init__(self):
        if self.name != "const" and not re.fullmatch(r"[A-Za-z][A-Za-z0-9]*_anom(_lag[1-9][0-9]*)?", self.name):
            raise ValueError(f"not a feature: {self.name!r}")

    @property
    def var(self) -> str | None:
        return None if self.name == "const" else self.name.split("_anom")[0]

    @property
    def lag(self) -> int:
        return int(self.name.rpartition("_lag")[2]) if "_lag" in self.name else 0


def features(names) -> tuple[Feature, ...]:
    """Parsed features: const first, none twice."""
    found = tuple(Feature(n) for n in names)
    if not found or found[0].name != "const":
        raise ValueError("const must come first")
    if len({f.name for f in found}) < len(found):
        raise ValueError("a feature comes twice")
    if any(f.var == "TD" and f.lag == 0 for f in found):
        raise ValueError("the target can't be a regressor of itself")
    return found


def max_lag(names) -> int:
    """The longest lag among features."""
    return max((f.lag for f in features(names)), default=0)


@dataclass(frozen=True)
class FitConfig:
    """Settings of a seasonal fit."""

    h: int = 11
    kernel: str = "Tricube"
    min_samples: int = 15
    features: tuple[str, ...] = STANDARD
    train_years: tuple[int, int] | None = None

    def __post_init__(self):
        if not 0 < self.h <= 182:
            raise ValueError("h must be 1 to 182 days")
        if self.kernel not in KERNELS:
            raise ValueError(f"kernel must be one of {KERNELS}")
        if self.min_samples < 1:
            raise ValueError("min_samples must be positive")
        features(self.features)
        if self.train_years and self.train_years[0] > self.train_years[1]:
            raise ValueError("train_years are in the wrong order")


@dataclass(frozen=True)
class TuningConfig:
    """Settings of feature and bandwidth selection."""

    base: FitConfig = field(default_factory=FitConfig)
    pool: tuple[str, ...] = POOL
    h_grid: tuple[int, ...] = (7, 11, 15, 21)
    tol: float = 0.01
    granularity: str = "doy"
    per_zone_n: int = 2000
    seed: int = 0

    def __post_init__(self):
        features(self.pool)
        if self.granularity not in ("doy", "zone"):
            raise ValueError("granularity is doy or zone")
        if not self.h_grid:
            raise ValueError("h_grid is empty")


#: Fixed values of the model, as are the defaults of FitConfig and TuningConfig: last training year and holdout years by lead.
SPLITS = {"ll1": (2015, (2016, 2016)), "ll2": (2014, (2015, 2016)), "ll4": (2012, (2013, 2016))}


def doy_list(doys, drop: bool = False) -> list[int]:
    """Days of year to work on: 1 to 366, sorted, once each; anything else is an error, or with drop left out."""
    found = sorted({int(d) for d in doys if not drop or 1 <= int(d) <= DOYS})
    if not found or found[0] < 1 or found[-1] > DOYS:
        raise ValueError("days of year must be 1 to 366, at least one")
    return found


def id_list(spec: str) -> list[int]:
    """Numbers of a spec: comma-separated ones, or first:last inclusive."""
    if ":" in spec:
        first, last = (int(x) for x in spec.split(":"))
        return list(range(first, last + 1))
    return [int(x) for x in spec.split(",") if x.strip()]
