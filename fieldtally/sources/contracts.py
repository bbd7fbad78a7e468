"""Data contracts: what columns a log has, which of them tell conditions apart,
and how many rows its experiment should have produced.

Group keys come from the contract of a log and not from a list kept beside it,
so a newly swept column can never be averaged away unnoticed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally import fixed
from fieldtally.functions.keys import run_strategy

# Column types of all logs (fixed values); columns not listed are doubles.
_TYPES = {
    T.StringType(): (
        "run_id", "strategy", "pesticide_choice", "plot_strategy", "plot_pesticide",
        "plot_position", "rotation_pattern",
    ),
    T.IntegerType(): (
        "season", "plot_x", "plot_y", "spray_count", "calendar_interval", "strategyswap_count",
        "cycle", "days_since_last_spray", "days_above_threshold",
    ),
    T.BooleanType(): (
        "adaptive_profit_mode", "adaptive_escalate_mode", "rotation_reactive", "rotation_mode",
        "adaptive_strategyswap_profit_mode", "adaptive_strategyswap_resistance_mode",
    ),
}
_TYPE_OF = {name: kind for kind, names in _TYPES.items() for name in names}

GRID_CORE = (
    "season", "plot_x", "plot_y", "grain_tha", "pest_loss_tha", "spray_count",
    "resistant_fraction", "cost_per_spray",
)
PLOT_CORE = ("season", "grain_tha", "pest_loss_tha", "spray_count", "end_money", "cost_per_spray")
DAILY_COLUMNS = (
    "cycle", "season", "strategy", "pest_load", "k_pest", "spray_count", "days_since_last_spray",
    "biomass", "cumulative_pest_exposure", "days_above_threshold",
)
MEASURES = (
    "grain_tha", "pest_loss_tha", "resistant_fraction", "spray_count", "cost_per_spray",
    "pest_load", "end_money",
)
INITIAL_STRATEGY = "initial_strategy"
#: Columns logged live by adaptive runs: they are outcomes, not conditions.
LIVE_COLUMNS = (
    "strategy", "pesticide_choice", "calendar_interval", "pesticide_threshold", "strategyswap_count",
)


def column_type(name: str) -> T.DataType:
    return _TYPE_OF.get(name, T.DoubleType())


@dataclass(frozen=True)
class Contract:
    """One log: its columns in file order, its condition columns and its design."""

    name: str
    columns: tuple[str, ...]
    id_columns: tuple[str, ...] = ()
    live_columns: tuple[str, ...] = ()
    sweep: Mapping[str, Sequence] = field(default_factory=dict)
    repeats: int = 0
    seasons: int = 0
    plots: int = 1
    #: Conditions that the file does not spell out, but its run identifiers do.
    derived: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, column_type(c), True) for c in self.columns])

    @property
    def measures(self) -> tuple[str, ...]:
        return tuple(c for c in self.columns if c in MEASURES)

    @property
    def keys(self) -> tuple[str, ...]:
        """Condition columns that stay constant over a run, derived ones last."""
        return tuple(c for c in self.id_columns if c not in self.live_columns) + self.derived

    @property
    def conditions(self) -> int:
        return prod(len(values) for values in self.sweep.values()) if self.sweep else 1

    @property
    def expected_rows(self) -> int:
        return self.conditions * self.repeats * self.seasons * self.plots


# Swept values (fixed values).
_ALL = fixed.STRATEGIES
_CAL, _THR, _BOTH = ("calendar",), ("threshold",), ("calendar", "threshold")
_SWAP = ("calendar", "threshold", "none")
INTERVALS = (1, 3, 5, 7, 10, 14, 21, 28)
PLOT_INTERVALS = (7, 10, 14, 21, 28)
THRESHOLDS = (0.1, 0.2, 0.3, 0.4, 0.5)
IMMIGRATION_LOW = (0.0, 0.01, 0.05, 0.10, 0.20)
IMMIGRATION_HIGH = (0.30, 0.50, 0.70, 0.90, 1.00)
IMMIGRATION_CROSS = (0.05, 0.10, 0.20, 0.30, 0.40, 0.50, 0.70, 0.90)
IMMIGRATION_ADAPTIVE = (0.05, 0.20, 0.40, 0.70)
FITNESS_COSTS = (0.0, 0.01, 0.02, 0.05, 0.10)
GROWTH_RATES = (0.0, 0.0165, 0.033038, 0.05, 0.10)
ON_OFF = (True, False)


def pattern_names(longest: int = 4) -> tuple[str, ...]:
    """Patterns of ``A`` and ``B`` that use both letters and repeat no shorter one."""
    names = []
    for length in range(2, longest + 1):
        for number in range(2**length):
            text = format(number, f"0{length}b").replace("0", "A").replace("1", "B")
            # A text lies inside its own doubling, ends cut off, only if it repeats a shorter one.
            if text not in (text + text)[1:-1]:
                names.append(text)
    return tuple(names)


SEQUENCES = (*pattern_names(), fixed.REACTIVE)

# Grid logs: name, condition columns after run_id, swept values, repeats, seasons (fixed values).
_S, _P, _I, _T, _M = (
    "strategy", "pesticide_choice", "calendar_interval", "pesticide_threshold", "immigration_rate",
)
_GRID = (
    ("harvest_grid_output", (_S,), {_S: _ALL}, 40, 3),
    ("sensitivity_output_interval_grid", (_S, _I), {_S: _CAL, _I: INTERVALS}, 40, 30),
    ("sensitivity_output_threshold_grid", (_S, _T), {_S: _THR, _T: THRESHOLDS}, 40, 30),
    ("sensitivity_output_threshold_grid_etofenprox", (_S, _T), {_S: _THR, _T: THRESHOLDS}, 40, 6),
    ("sensitivity_output_threshold_grid_neonic", (_S, _T), {_S: _THR, _T: THRESHOLDS}, 40, 6),
    ("harvest_grid_output_etofenprox", (_S,), {_S: _ALL}, 40, 3),
    ("harvest_grid_output_neonic", (_S,), {_S: _ALL}, 40, 3),
    ("harvest_grid_output_longterm", (_S, _P), {_S: _ALL, _P: fixed.COMPOUNDS}, 40, 30),
    ("harvest_grid_output_rotation", (_S, _P), {_S: _ALL}, 40, 30),
    ("harvest_grid_output_heterogeneous", ("plot_strategy", "plot_pesticide"), {}, 40, 30),
    ("harvest_grid_output_spatial", (_S, "plot_position"), {_S: _ALL}, 40, 3),
    ("sensitivity_output_immigration_grid", (_S, _M), {_S: _CAL, _M: IMMIGRATION_LOW}, 40, 30),
    ("sensitivity_output_immigration_grid_extended", (_S, _M), {_S: _CAL, _M: IMMIGRATION_HIGH}, 40, 30),
    ("sensitivity_output_decay_grid", (_S, "resistance_fitness_cost"),
     {_S: _BOTH, "resistance_fitness_cost": FITNESS_COSTS}, 40, 30),
    ("sensitivity_output_reproduction_grid", (_S, "pest_growth_rate"),
     {_S: _BOTH, "pest_growth_rate": GROWTH_RATES}, 40, 30),
    ("sensitivity_output_interval_grid_rotation", (_S, _I, _P), {_S: _CAL, _I: INTERVALS}, 40, 30),
    ("sensitivity_output_threshold_grid_rotation", (_S, _T, _P), {_S: _THR, _T: THRESHOLDS}, 40, 30),
    ("sensitivity_output_compound_sequence_grid_calendar", (_S, "rotation_pattern", _P),
     {_S: _CAL, "rotation_pattern": SEQUENCES}, 20, 30),
    ("sensitivity_output_compound_sequence_grid_threshold", (_S, "rotation_pattern", _P),
     {_S: _THR, "rotation_pattern": SEQUENCES}, 20, 30),
    ("sensitivity_output_interval_immigration_grid", (_S, _I, _M),
     {_S: _CAL, _I: INTERVALS, _M: IMMIGRATION_CROSS}, 15, 30),
    ("sensitivity_output_threshold_immigration_grid", (_S, _T, _M),
     {_S: _THR, _T: THRESHOLDS, _M: IMMIGRATION_CROSS}, 15, 30),
    ("sensitivity_output_rotation_immigration_grid", (_S, _P, _M), {_S: _ALL, _M: IMMIGRATION_CROSS}, 15, 30),
    ("sensitivity_output_adaptive_farmer_grid",
     (_S, "adaptive_profit_mode", "rotation_reactive", _I, _T, _P),
     {_S: _BOTH, "adaptive_profit_mode": ON_OFF, "rotation_reactive": ON_OFF}, 40, 30),
    ("sensitivity_output_adaptive_farmer_immigration_grid", (_S, "adaptive_profit_mode", _M, _I, _P),
     {_S: _CAL, "adaptive_profit_mode": ON_OFF, _M: IMMIGRATION_ADAPTIVE}, 40, 30),
    ("sensitivity_output_adaptive_farmer_longhorizon",
     (_S, "adaptive_profit_mode", "rotation_reactive", _I, _T, _P), {_S: _CAL}, 40, 120),
    ("sensitivity_output_adaptive_farmer_rotation_grid", (_S, "adaptive_profit_mode", "rotation_mode", _I, _P),
     {_S: _CAL, "adaptive_profit_mode": ON_OFF, "rotation_mode": ON_OFF}, 40, 30),
    ("sensitivity_output_adaptive_farmer_escalate_grid",
     (_S, "adaptive_escalate_mode", "rotation_reactive", _I, _T, _P),
     {_S: _BOTH, "adaptive_escalate_mode": ON_OFF, "rotation_reactive": ON_OFF}, 40, 30),
    ("sensitivity_output_strategyswap_grid_profit",
     (_S, "adaptive_strategyswap_profit_mode", "adaptive_strategyswap_resistance_mode", "strategyswap_count"),
     {_S: _SWAP, "adaptive_strategyswap_profit_mode": ON_OFF}, 40, 30),
    ("sensitivity_output_strategyswap_grid_resistance",
     (_S, "adaptive_strategyswap_profit_mode", "adaptive_strategyswap_resistance_mode", "strategyswap_count"),
     {_S: _SWAP, "adaptive_strategyswap_resistance_mode": ON_OFF}, 40, 30),
)

# One-plot sensitivity logs: compound, efficacy %, increment %, whole cost (fixed values).
_PLOT_SWEEPS = (
    ("starfarm", 60, 3, 100),
    ("starfarm", 90, 3, 100),
    ("starfarm", 80, 5, 100),
    ("starfarm", 80, 10, 100),
    ("etofenprox", 70, 3, 110),
    ("neonicotinoid", 80, 3, 100),
    ("starfarm", 80, 3, 50),
    ("starfarm", 80, 3, 150),
)


def config_file_name(compound: str, efficacy: int, increment: int, cost: int) -> str:
    return f"sensitivity_output_{compound}_eff{efficacy}_inc{increment}_cost{cost}"


def _live(name: str, ids: tuple[str, ...]) -> tuple[str, ...]:
    if "strategyswap" in name:
        live = ("strategy", "strategyswap_count")
    elif "adaptive_farmer" in name:
        live = ("pesticide_choice", "calendar_interval", "pesticide_threshold")
    elif "rotation" in name or "compound_sequence" in name:
        live = ("pesticide_choice",)
    else:
        live = ()
    return tuple(c for c in live if c in ids)


def _build() -> dict[str, Contract]:
    plots = fixed.GRID_WIDTH * fixed.GRID_HEIGHT
    found: list[Contract] = []
    for name, ids, sweep, repeats, seasons in _GRID:
        core = list(GRID_CORE)
        if name.endswith("longterm"):
            core.insert(core.index("pest_loss_tha"), "pest_load")
        found.append(
            Contract(
                name, ("run_id", *ids, *core), ids, _live(name, ids), sweep, repeats, seasons, plots,
                # The strategy a run starts with is swept, the logged one changes.
                (INITIAL_STRATEGY,) if "strategyswap" in name else (),
            )
        )
    found.append(
        Contract("harvest_output", ("run_id", "strategy", *PLOT_CORE), ("strategy",), (), {_S: _ALL}, 40, 3)
    )
    for config in _PLOT_SWEEPS:
        ids = ("strategy", "efficacy", "increment")
        found.append(
            Contract(config_file_name(*config), ("run_id", *ids, *PLOT_CORE), ids, (), {_S: _ALL}, 40, 3)
        )
    for name, swept, values, plan in (
        ("sensitivity_output_interval", _I, PLOT_INTERVALS, _CAL),
        ("sensitivity_output_threshold", _T, THRESHOLDS, _THR),
    ):
        ids = ("strategy", swept)
        found.append(Contract(name, ("run_id", *ids, *PLOT_CORE), ids, (), {_S: plan, swept: values}, 40, 3))
    for strategy in fixed.STRATEGIES:
        found.append(Contract(f"daily_{strategy}", DAILY_COLUMNS, ("strategy",)))
    return {c.name: c for c in found}


CONTRACTS: dict[str, Contract] = _build()


def contract(name: str) -> Contract:
    try:
        return CONTRACTS[name]
    except KeyError:
        raise KeyError(f"no contract named {name!r}") from None


def register(new: Contract) -> Contract:
    """Add a contract of the user's own."""
    CONTRACTS[new.name] = new
    return new


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def present_keys(df: DataFrame, log: Contract) -> list[str]:
    """Condition columns of the contract that the frame has; live ones are none."""
    return [c for c in log.keys if c in df.columns]


def with_derived(df: DataFrame, log: Contract) -> DataFrame:
    """Add the conditions that run identifiers spell out."""
    if INITIAL_STRATEGY in log.derived and INITIAL_STRATEGY not in df.columns:
        return df.withColumn(INITIAL_STRATEGY, run_strategy("run_id"))
    return df


def conform(df: DataFrame, log: Contract) -> DataFrame:
    """Project to the contract: its columns, order and types; absent condition
    columns become nulls, absent measures are an error."""
    require_columns(df, [c for c in log.columns if c not in log.id_columns and c not in ("plot_x", "plot_y")])

    def typed(name: str) -> Column:
        source = F.col(name) if name in df.columns else F.lit(None)
        return source.cast(column_type(name)).alias(name)

    return df.select(*[typed(c) for c in log.columns])


def common_columns(logs: Sequence[Contract] | None = None) -> tuple[str, ...]:
    """Columns of a table that can hold all grid logs: run, every condition
    column, then the measures."""
    chosen = [c for c in CONTRACTS.values() if c.plots > 1] if logs is None else logs
    ids = dict.fromkeys(c for log in chosen for c in log.id_columns)
    rest = dict.fromkeys(c for log in chosen for c in log.columns if c not in ids and c != "run_id")
    return ("run_id", *ids, *rest)


def to_common(df: DataFrame, log: Contract) -> DataFrame:
    """A log in the form shared by all grid logs, with its name in ``dataset``;
    columns it lacks are null.  Partition such a table by ``dataset``."""
    own = conform(df, log)
    return own.select(
        F.lit(log.name).alias("dataset"),
        *[
            F.col(c) if c in own.columns else F.lit(None).cast(column_type(c)).alias(c)
            for c in common_columns()
        ],
    )
