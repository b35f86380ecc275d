"""Domain settings: code maps, thresholds and rules the plans take as parameters."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SeasonRule:
    region: str
    months: tuple[int, ...]
    factor: float


@dataclass(frozen=True)
class DomainConfig:
    brands: tuple[str, ...]
    brand_codes: dict[str, int]
    channel_codes: dict[str, int]
    loyalty_codes: dict[str, int]
    region_codes: dict[str, int]
    season_rules: tuple[SeasonRule, ...]
    # (window longer than, factor), most generous first
    early_bird: tuple[tuple[int, float], ...] = ((180, 0.85), (90, 0.92))
    # (segment, lifetime value at least), highest first
    ltv_segments: tuple[tuple[str, int], ...] = (
        ("Platinum", 50000),
        ("Gold", 20000),
        ("Silver", 5000),
    )
    ltv_floor: str = "Bronze"
    price_band: float = 0.05
    min_occupancy: float = 70.0
    max_cancellation: float = 15.0
    scan_limit: int = 20
    peak_months: tuple[int, ...] = (6, 7, 8, 12)
    weekend_days: tuple[int, ...] = (4, 5)  # Monday is 0
    spend_categories: tuple[str, ...] = field(
        default=("dining", "spa", "excursions", "beverage", "casino", "retail")
    )


# Names and codes of the cruise data model; models and checks depend on them.
CRUISE = DomainConfig(
    brands=("Norwegian", "Oceania", "Regent"),
    brand_codes={"Norwegian": 0, "Oceania": 1, "Regent": 2},
    channel_codes={"Direct Web": 0, "Travel Agent": 1, "OTA": 2, "Group": 3, "Loyalty": 4},
    loyalty_codes={"None": 0, "Latitudes": 1, "Gold": 2, "Platinum": 3, "Ambassador": 4},
    region_codes={
        "Caribbean": 0,
        "Alaska": 1,
        "Mediterranean": 2,
        "Europe": 3,
        "Americas": 4,
        "Bermuda": 5,
        "Hawaii": 6,
        "Asia": 7,
    },
    season_rules=(
        SeasonRule("Caribbean", (12, 1, 2, 3), 1.25),
        SeasonRule("Alaska", (6, 7, 8), 1.30),
        SeasonRule("Mediterranean", (7, 8), 1.35),
        SeasonRule("Europe", (6, 7, 8), 1.20),
    ),
)
