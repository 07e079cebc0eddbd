"""Constants of the retail domain, in one place. The values are fixed values: results depend on them as they are."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Domain:
    """Accepted values of the raw tables."""

    years: tuple[int, ...] = (1996, 1997, 1998, 1999, 2000)
    months: tuple[int, ...] = tuple(range(1, 13))
    positive: float = 1e-9
    labels: tuple[str, ...] = ("Favorable", "Moderate", "Un-Favorable")
    sizes: tuple[str, ...] = ("Small", "Medium", "Large", "Extra Large")
    types: tuple[str, ...] = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    typos: dict = field(default_factory=lambda: {"MACHNERY": "MACHINERY", "BUILDNG": "BUILDING", "FURNITRE": "FURNITURE"})
    null_tokens: tuple[str, ...] = ("", "NA", "NaN", "nan", "null", "None", "N/A")
    box: tuple[float, float, float, float] = (5.9, 9.9, 79.5, 82.0)
    provinces: tuple[tuple[str, str], ...] = (("DIST_W", "Western"), ("DIST_C", "Central"), ("DIST_NW", "North-Western"), ("DIST_S", "Southern"))


@dataclass(frozen=True)
class Decay:
    """Points of interest: ring radii in metres, decay lengths and weights by type, the rivals' kernel."""

    rings: tuple[int, ...] = (500, 1000, 2000)
    midpoints: tuple[float, ...] = (250.0, 750.0, 1500.0)
    types: tuple[str, ...] = ("school", "university", "bus_station", "hospital", "place_of_worship", "marketplace", "restaurant", "tourism")
    lengths: tuple[float, ...] = (250.0, 450.0, 180.0, 500.0, 300.0, 300.0, 200.0, 500.0)
    weights: tuple[float, ...] = (2.0, 1.0, 3.0, 2.0, 1.0, 1.0, 1.0, 1.0)
    power: float = 1.5
    radius: float = 500.0
    rival_length: float = 250.0
    earth: float = 6_371_000.0


@dataclass(frozen=True)
class Potential:
    """The combining formula, the physical ceiling and the labels' thresholds."""

    floor: float = 1.05
    ceiling: float = 1.5
    uplift: float = 0.25
    supply_bound: float = 0.12
    litres: float = 350.0
    turns: float = 4.0
    no_cooler: float = 120.0
    season: dict = field(default_factory=lambda: {"Favorable": 1.3, "Moderate": 1.0, "Un-Favorable": 0.7})


@dataclass(frozen=True)
class Budget:
    """Spend by outlet under diminishing returns."""

    province: str = "Western"
    total: float = 5_000_000.0
    cap: float = 50_000.0
    step: float = 1_000.0
    k_supply: float = 9e-5
    k_demand: float = 4.5e-5


DOMAIN, DECAY, POTENTIAL, BUDGET = Domain(), Decay(), Potential(), Budget()
