"""Frozen run parameters. Every threshold a job uses is a field here."""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass, field, replace

from reprise import fixed_values as fv

DAYS_PER_YEAR = 365.25
DAYS_PER_MONTH = 30.44


@dataclass(frozen=True)
class WindowParams:
    cycle_days: int = 365
    km_interval: float = 16000.0
    km_by_generation: tuple = tuple(fv.KM_BY_GENERATION.items())
    lead_days: int = 30
    horizon_days: int = 90
    min_gap_days: int = 90
    first_due_days: int = 300
    anchor: str = "last_maintenance"      # or "plan"
    km_source: str = "current"            # or "km": the extraction snapshot, leak demonstration only
    min_history_days: int = 0
    split_visit_days: int = 30
    label_margin_days: int = 30
    label_mode: str = "ventana"           # or "mes_calendario"

    def __post_init__(self):
        if isinstance(self.km_by_generation, dict):
            object.__setattr__(self, "km_by_generation", tuple(self.km_by_generation.items()))
        if self.anchor not in ("last_maintenance", "plan"):
            raise ValueError(f"unknown anchor: {self.anchor}")
        if self.km_source not in ("current", "km"):
            raise ValueError(f"unknown km_source: {self.km_source}")
        if self.label_mode not in ("ventana", "mes_calendario"):
            raise ValueError(f"unknown label_mode: {self.label_mode}")

    def with_(self, **changes) -> "WindowParams":
        return replace(self, **changes)


@dataclass(frozen=True)
class DataSpan:
    """First day of the observed data and the extraction cut-off."""

    start: dt.date = dt.date(2024, 1, 1)
    cutoff: dt.date = dt.date(2026, 8, 25)


@dataclass(frozen=True)
class SaleRules:
    """What counts as a valid sale, and how a model code maps to a generation."""

    status: str = fv.SALE_STATUS_VALID
    model: str = fv.SALE_MODEL_VALID
    min_delivery: str = fv.SALE_MIN_DELIVERY
    generation_new: str = fv.GENERATION_NEW
    generation_old: str = fv.GENERATION_OLD


@dataclass(frozen=True)
class SplitParams:
    train_end: dt.date = dt.date(2025, 9, 30)
    valid_end: dt.date = dt.date(2025, 12, 31)


@dataclass(frozen=True)
class SegmentParams:
    top_high: float = 0.2
    top_medium: float = 0.3


@dataclass(frozen=True)
class BusinessParams:
    uplift: float = 0.15
    retention_value: float = 250.0
    contact_cost: float = 3.0
    monthly_capacity: int = 3000

    @property
    def break_even_probability(self) -> float:
        return self.contact_cost / (self.uplift * self.retention_value)


@dataclass(frozen=True)
class ContactPolicy:
    groups: tuple = ("Alto", "Medio")
    min_days_left: float = 14
    max_days_recent: float = 730
    capacity: int = 3000
    actionable: tuple = field(default_factory=lambda: tuple(fv.ACTIONABLE_FEATURES))

    def __post_init__(self):
        if set(self.groups) != {"Alto", "Medio"}:
            raise ValueError("the contact stage takes exactly the groups Alto and Medio")
        for name in ("min_days_left", "max_days_recent"):
            v = getattr(self, name)
            if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v) or v < 0:
                raise ValueError(f"{name} must be a finite non-negative number")
        if isinstance(self.capacity, bool) or not isinstance(self.capacity, int) or self.capacity < 0:
            raise ValueError("capacity must be a non-negative integer")
