"""Fixed values of the screening method, and the parameters that runs may vary."""

from __future__ import annotations

from dataclasses import asdict, dataclass

# Fixed values
CRS_GEOGRAPHIC, CRS_PROJECTED = 4326, 2263
BOUNDS_FT = (900_000.0, 110_000.0, 1_090_000.0, 280_000.0)
TRAIN_YEARS, HOLDOUT_YEARS = (2019, 2023), (2024, 2025)
TRAILING_MONTHS = (12, 24, 36)
STRATUM_SHARES = {"corridor": 0.50, "intersection": 0.15}
BOROUGH_CODES = {"1": "MANHATTAN", "2": "BRONX", "3": "BROOKLYN", "4": "QUEENS", "5": "STATEN ISLAND"}
MIN_LIFT_PP, BOOTSTRAP_ITERATIONS, BOOTSTRAP_LEVEL, BOOTSTRAP_SEED = 5.0, 10_000, 0.95, 20260812
MIN_DISPERSION, MIN_LENGTH_FT, MIN_PREDICTION = 1e-8, 1.0, 1e-9
MAX_DEGENERATE_SHARE = 0.10
PREDICTORS = ("posted_speed", "number_travel_lanes", "streetwidth", "is_highway", "road_attrs_imputed")
ROAD_ATTRIBUTES = ("posted_speed", "number_travel_lanes", "streetwidth")
FACTORS = ("Driver Inattention/Distraction", "Failure to Yield Right-of-Way", "Unsafe Speed", "Traffic Control Disregarded", "Alcohol Involvement")
SWEEP = {"join_ft": (100.0, 250.0), "node_ft": (50.0, 150.0), "label_ft": (25.0, 100.0)}
ZERO_BUDGETS, ZERO_DRAWS, ZERO_SEED = (100, 500, 2000), 2000, 20260813
TREATMENT_DATE_COLUMNS = ("end_date", "completion_date", "comp_date", "date_complete")
SCORED_COLUMNS = ("unit_id", "unit_type", "borough", "casualties_36mo", "holdout_casualties", "spf_prediction", "eb_estimate", "is_priority", "treated", "treatment_date")
TREATMENT_FT = 50.0


@dataclass(frozen=True)
class Radii:
    """Distances in feet: point to segment, point to node, and label to unit."""

    join_ft: float = 150.0
    node_ft: float = 100.0
    label_ft: float = 50.0

    @property
    def tag(self) -> str:
        return f"j{self.join_ft:g}-i{self.node_ft:g}-v{self.label_ft:g}"

    def as_dict(self) -> dict[str, float]:
        return asdict(self)


DEFAULT_RADII = Radii()
