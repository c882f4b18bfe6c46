"""Column names and fixed values.

The jobs are generic; a :class:`ListingConfig` names the columns of a listings
table and a :class:`DamageRules` holds the weights of the rule-based risk score.
Defaults describe the used-car listings the library was designed for.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values. These must stay exactly as written for results to match the
# behaviour being reproduced (labels shown to users, weights of the score).
# ---------------------------------------------------------------------------

# Filter value meaning "no filter" (Turkish for "All").
ALL_TOKEN = "Tümü"

# Damage chart: (label, column stem) in display order; each part sums
# "{stem}_degisen" (replaced) and "{stem}_boyali" (painted).
DAMAGE_PARTS = (
    ("Kaput", "kaput"),
    ("Tavan", "tavan"),
    ("Bagaj", "bagaj"),
    ("Sol Ön Çamurluk", "fender_fl"),
    ("Sağ Ön Çamurluk", "fender_fr"),
    ("Sol Ön Kapı", "door_fl"),
    ("Sağ Ön Kapı", "door_fr"),
    ("Sol Arka Kapı", "door_rl"),
    ("Sağ Arka Kapı", "door_rr"),
    ("Sol Arka Çamurluk", "fender_rl"),
    ("Sağ Arka Çamurluk", "fender_rr"),
)
DAMAGE_SUFFIXES = ("_degisen", "_boyali")

# Radar chart axes: (indicator name, measure) in display order.
RADAR_AXES = (
    ("Fiyat", "price"),
    ("KM", "mileage"),
    ("Beygir Gücü", "power"),
    ("Yakıt Tüketimi", "fuel_consumption"),
)
RADAR_HEADROOM = 1.1
RADAR_MAX_GROUPS = 5

# Part statuses and their scores: roof, hood, trunk.
STATUS_ORIGINAL = "Orjinal"
STATUS_PAINTED = "Boyalı"
STATUS_REPLACED = "Değişen"
STATUS_LOCAL_PAINT = "Lokal Boyalı"
ROOF_WEIGHTS = {STATUS_REPLACED: 150.0, STATUS_PAINTED: 75.0, STATUS_LOCAL_PAINT: 40.0}
HOOD_WEIGHTS = {STATUS_REPLACED: 60.0, STATUS_PAINTED: 30.0, STATUS_LOCAL_PAINT: 15.0}
TRUNK_WEIGHTS = {STATUS_REPLACED: 40.0, STATUS_PAINTED: 20.0, STATUS_LOCAL_PAINT: 10.0}
# Counted panels: weight per replaced / painted / locally painted panel.
DOOR_WEIGHTS = (10.0, 5.0, 2.0)
FENDER_WEIGHTS = (8.0, 4.0, 2.0)

# Scoring output.
BAND_LOW_FACTOR = 0.98
BAND_HIGH_FACTOR = 1.02
CURRENCY = "TL"

# Drift report.
DRIFT_P_THRESHOLD = 0.05
DRIFT_EMD_THRESHOLD = 0.1
DRIFT_CONSTANT_SENTINEL = 999.0
HISTOGRAM_BINS = 20
KS_EXACT_MAX_N = 10000


@dataclass(frozen=True)
class ListingConfig:
    """Names of the listing columns the dashboard and option lists use."""

    brand: str = "brand"
    series: str = "series"
    model: str = "model"
    price: str = "price"
    year: str = "kb_year"
    mileage: str = "kb_mileage"
    fuel: str = "kb_fuel"
    power: str = "power_hp_val"
    fuel_consumption: str = "kb_fuel_cons_avg"
    damage_parts: tuple = DAMAGE_PARTS
    damage_suffixes: tuple = DAMAGE_SUFFIXES
    all_token: str = ALL_TOKEN
    radar_max_groups: int = RADAR_MAX_GROUPS

    def schema(self) -> str:
        """The columns that charts and option lists read, as DDL: of a listings table that is not there."""
        text, whole = (self.brand, self.series, self.model, self.fuel), (self.year, self.mileage, self.power)
        cols = [f"`{c}` string" for c in text] + [f"`{c}` bigint" for c in whole]
        cols += [f"`{c}` double" for c in (self.price, self.fuel_consumption)]
        return ", ".join(cols + [f"`{c}` int" for _, group in self.damage_columns() for c in group])

    def radar_measures(self) -> list[tuple[str, str]]:
        """(indicator name, column) pairs of the radar chart."""
        return [(name, getattr(self, attr)) for name, attr in RADAR_AXES]

    def damage_columns(self) -> list[tuple[str, list[str]]]:
        return [(label, [f"{stem}{sfx}" for sfx in self.damage_suffixes])
                for label, stem in self.damage_parts]


@dataclass(frozen=True)
class DamageRules:
    """Weights of the rule-based risk score (unknown statuses score 0)."""

    roof: dict = field(default_factory=lambda: dict(ROOF_WEIGHTS))
    hood: dict = field(default_factory=lambda: dict(HOOD_WEIGHTS))
    trunk: dict = field(default_factory=lambda: dict(TRUNK_WEIGHTS))
    doors: tuple = DOOR_WEIGHTS
    fenders: tuple = FENDER_WEIGHTS
    default_status: str = STATUS_ORIGINAL


# Object names of a storage folder (per version, except the first two).
LISTINGS_FILE = "car_listings.parquet"
REGISTRY_FILE = "registry.json"
SNAPSHOT_FILE = "train_data.parquet"
SHAP_FILE = "shap_summary.png"
