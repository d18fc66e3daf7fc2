"""All numbers of the engine in one immutable place.

Every threshold below is a fixed value that results depend on; operators take a Config and read no global.
"""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from pathlib import Path

DAY_MS, HOUR_MS = 86_400_000, 3_600_000


@dataclass(frozen=True)
class Universe:
    min_quote_volume: float = 20_000_000
    min_trades: int = 50_000
    min_price: float = 0.0001
    new_listing_days: int = 14
    top: int = 130
    # fixed values: base assets pegged to a currency, and the ending of leveraged symbols
    stable_bases: tuple = ("USDT", "USDC", "BUSD", "TUSD", "DAI", "FDUSD", "USDP", "UST", "USTC", "EUR", "GBP", "AEUR")
    leveraged: str = "(UP|DOWN|BULL|BEAR)USDT$"
    majors: tuple = ("BTC", "ETH", "BNB", "SOL", "XRP", "DOGE")


@dataclass(frozen=True)
class Candidate:
    min_bars: int = 30
    drop_6h: float = -1.5
    drop_24h: float = -8
    surge_24h_exclude: float = 45
    rsi_long_max: float = 60
    near_low: float = 8
    counter_6h: float = 3
    surge_6h: float = 1.5
    rsi_short_min: float = 40
    near_high: float = 8
    crash_24h_exclude: float = -45
    keep: int = 50


@dataclass(frozen=True)
class Noise:
    period: int = 14
    choppiness_max: float = 61.8
    min_rel_vol: float = 0.6


@dataclass(frozen=True)
class Early:
    box: int = 60
    squeeze: int = 100
    vol_recent: int = 20
    vol_prior: int = 60
    min_quote_volume: float = 5_000_000
    top: int = 200
    keep: int = 50
    momentum_bars: int = 84
    dead_zone: float = 15
    momentum_full: float = 60
    change_min: float = 5
    change_full: float = 20
    fresh_full: float = 200
    fresh_zero: float = 800
    default_age: float = 400
    stop_atr: float = 4
    target_r: float = 4
    hold: int = 90
    partial_r: float = 1
    partial_share: float = 0.5
    breakout_rel_vol: float = 2
    breakout_max_run: float = 15
    pumped: float = 40
    weight_momentum: float = 45
    weight_change: float = 32
    weight_fresh: float = 23
    thin: float = -10
    min_score: float = 40
    keep_top: int = 3
    grades: tuple = ((70, "strong", 29), (55, "watch", 16), (40, "observe", 12), (25, "weak", 7), (0, "excluded", 2))
    base_rate: float = 3.57


@dataclass(frozen=True)
class Structure:
    pivot: int = 5
    equal_tolerance: float = 0.1
    skip_last: bool = True
    sweep_lookback: int = 6
    gap_min_atr: float = 0.05
    gap_min_pct: float = 0.15
    block_lookback: int = 12
    min_bars: int = 40


@dataclass(frozen=True)
class Retest:
    cross: int = 60
    impulse: int = 30
    impulse_margin: float = 5
    zone_atr: float = 1.5
    wick: float = 0.3
    close_pos: float = 0.5


WEIGHTS = {
    "dropAndOversold": 10, "volumeLiquidity": 10, "lowLiquiditySweep": 15, "sweepPriceRecovery": 10, "sellAbsorption": 10,
    "structureShift1h": 15, "fvgObOverlap": 10, "volumeDeltaShift": 10, "entryTrigger5m": 5, "riskReward": 5,
}
PENALTIES = ("overExtended15m", "farFromLowAtr", "strongResistanceAbove", "shortTargetDistance", "tooLowVolume", "strongDowntrend4h", "newListingThin", "poorRiskReward")
#: Fixed values by strictness level: smallest score shown, and the penalties in the order of PENALTIES.
STRICTNESS = {
    1: (20, (-5, -4, -3, -3, -4, -3, -2, -4)),
    2: (25, (-7, -6, -5, -5, -6, -5, -4, -6)),
    3: (30, (-12, -10, -8, -8, -10, -8, -6, -10)),
    4: (40, (-16, -13, -10, -10, -13, -10, -8, -13)),
    5: (55, (-19, -16, -13, -13, -16, -13, -10, -16)),
}


def strictness(level: int) -> tuple[int, dict[str, int]]:
    """Smallest score and penalties; an unknown level is 3."""
    least, values = STRICTNESS.get(level, STRICTNESS[3])
    return least, dict(zip(PENALTIES, values, strict=True))


@dataclass(frozen=True)
class Reversal:
    penalty_group: tuple = ("strongResistanceAbove", "shortTargetDistance", "poorRiskReward")
    core: tuple = ("lowLiquiditySweep", "sweepPriceRecovery", "structureShift1h", "fvgObOverlap")
    core_min: float = 40
    keep_top: int = 5
    grades: tuple = ((55, "strong"), (40, "watch"), (30, "observe"), (20, "weak"), (0, "excluded"))
    near_ema200: float = 0.5
    stop_atr: float = 0.5
    min_stop_pct: float = 0.5
    strictness: int = 3


@dataclass(frozen=True)
class Costs:
    round_trip_pct: float = 0.2
    maintenance_pct: float = 0.5
    leverage: tuple = (1, 2, 3, 5, 10, 20)


@dataclass(frozen=True)
class Config:
    universe: Universe = field(default_factory=Universe)
    candidate: Candidate = field(default_factory=Candidate)
    noise: Noise = field(default_factory=Noise)
    early: Early = field(default_factory=Early)
    structure: Structure = field(default_factory=Structure)
    retest: Retest = field(default_factory=Retest)
    reversal: Reversal = field(default_factory=Reversal)
    costs: Costs = field(default_factory=Costs)
    correlation_bars: int = 42
    correlation_min: float = 0.7
    bar_limits: tuple = (("4h", 240), ("1h", 260), ("15m", 200), ("5m", 160))
    refresh_ms: int = 90_000
    refresh_min_ms: int = 30_000
    background_factor: int = 4


def merged(stored: dict, base: Config | None = None) -> Config:
    """base with stored values laid over it; names it doesn't know are ignored."""
    base = base or Config()

    def lay(obj, values):
        known = {f.name: f for f in dataclasses.fields(obj)}
        out = {}
        for name, value in values.items():
            if name in known:
                old = getattr(obj, name)
                out[name] = lay(old, value) if dataclasses.is_dataclass(old) and isinstance(value, dict) else tuple(tuple(x) if isinstance(x, list) else x for x in value) if isinstance(value, list) else value
        return dataclasses.replace(obj, **out)

    return lay(base, stored)


def load(path: str) -> Config:
    """Settings from a JSON file over the defaults; a missing or broken file gives the defaults."""
    try:
        return merged(json.loads(Path(path).read_text()))
    except (OSError, ValueError):
        return Config()


def save(config: Config, path: str) -> None:
    Path(path).write_text(json.dumps(dataclasses.asdict(config), indent=1))


def refresh_delay_ms(interval_ms: int, background: bool, config: Config | None = None) -> int:
    c = config or Config()
    return max(interval_ms, c.refresh_min_ms) * (c.background_factor if background else 1)
