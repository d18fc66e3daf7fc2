"""Scalar expressions: column in, column out, no state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wickframe.config import Config, Costs


def r(x, digits: int = 6) -> Column:
    """Rounded half up: floor(x * 10**digits + 0.5) / 10**digits."""
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x * float(10**digits) + 0.5) / float(10**digits)


def r0(x: Column) -> Column:
    return F.floor(x + 0.5)


def div(a: Column, b: Column) -> Column:
    """Null where the divisor is 0."""
    return F.try_divide(a, b)


def pct(a: Column, b: Column) -> Column:
    """Change from b to a, in per cent; null unless b > 0."""
    return F.when(b > 0, (a - b) / b * 100)


def span(high: Column, low: Column) -> Column:
    """high - low, or a tiny number for a flat bar."""
    return F.when(high == low, 1e-9).otherwise(high - low)


def ramp(v: Column, lo: float, hi: float) -> Column:
    """0 at lo, 1 at hi, straight between; null gives 0."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - lo) / (hi - lo))), F.lit(0.0))


def upper_wick() -> Column:
    return (F.col("high") - F.greatest("open", "close")) / span(F.col("high"), F.col("low"))


def lower_wick() -> Column:
    return (F.least("open", "close") - F.col("low")) / span(F.col("high"), F.col("low"))


def close_pos() -> Column:
    return (F.col("close") - F.col("low")) / span(F.col("high"), F.col("low"))


def sell_ratio() -> Column:
    return F.when(F.col("volume") > 0, F.col("taker_sell_base") / F.col("volume")).otherwise(0.0)


def grade(score: Column, grades: tuple, place: int = 1) -> Column:
    """The first band whose minimum the score reaches; else the last."""
    out = F.lit(grades[-1][place])
    for band in reversed(grades):
        out = F.when(score >= band[0], F.lit(band[place])).otherwise(out)
    return out


def new_listing(onboard_ms: Column, as_of_ms: Column, days: int) -> Column:
    return F.coalesce((onboard_ms > 0) & ((as_of_ms - onboard_ms) / 86_400_000 < days), F.lit(False))


def age_days(onboard_ms: Column, as_of_ms: Column) -> Column:
    return F.when(onboard_ms > 0, (as_of_ms - onboard_ms) / 86_400_000)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Whether two ranges meet; null if one isn't there."""
    return (a0 <= b1) & (b0 <= a1)


def r_multiple(fill: Column, price: Column, risk: Column, cost: float) -> Column:
    return ((price - fill) / fill - cost) / (risk / fill)


def position_money(entry: Column, stop: Column, target: Column, valid: Column, seed: float, costs: Costs, leverage: int = 1, share: float = 0.5, at_r: float = 1.0) -> Column:
    """What a plan is worth on a margin of `seed`: a struct, null for an invalid plan or no seed.  A loss stops at the
    margin; at leverage 1 there's no liquidation."""
    if not seed > 0:
        return F.lit(None).cast("struct<notional:double>")
    lev = max(1, leverage)
    notional = float(seed * lev)
    cost = notional * costs.round_trip_pct / 100
    loss_pct, gain_pct = F.abs((entry - stop) / entry) * 100, F.abs((target - entry) / entry) * 100
    drop = 100 / lev - costs.maintenance_pct if lev > 1 else 100.0
    partial = loss_pct * (share * at_r)
    full = partial + gain_pct * (1 - share)
    fields = {
        "notional": F.lit(notional),
        "loss": F.greatest(-(loss_pct * notional / 100 + cost), F.lit(-float(seed))),
        "partial": partial * notional / 100 - cost,
        "gain": full * notional / 100 - cost,
        "loss_pct": loss_pct,
        "gain_pct": gain_pct,
        "liquidation_price": entry * (1 - drop / 100) if lev > 1 else F.lit(None).cast("double"),
        "liquidated": loss_pct >= drop,
        "max_safe_leverage": F.greatest(F.lit(1), F.floor(100 / (loss_pct + costs.maintenance_pct))).cast("int"),
    }
    return F.when(valid, F.struct(*[v.alias(k) for k, v in fields.items()]))


def price_text(x: Column) -> Column:
    """A price with as many decimals as its size asks for."""
    a = F.abs(x)
    digits = F.when(a < 0.001, 8).when(a < 0.1, 6).when(a < 1, 5).when(a < 100, 3).otherwise(2)
    out = F.lit("-")
    for d in (8, 6, 5, 3, 2):
        out = F.when(digits == d, F.format_number(x, d)).otherwise(out)
    return F.when(x.isNull() | F.isnan(x), "-").otherwise(out)


def pct_text(x: Column, digits: int = 2) -> Column:
    """Rounded, then signed: what rounds to zero has no sign."""
    shown = r(x, digits)
    return F.when(x.isNull() | F.isnan(x), "-").otherwise(F.concat(F.when(shown > 0, "+").otherwise(""), F.format_string(f"%.{digits}f", shown), F.lit("%")))


def volume_text(x: Column) -> Column:
    a = F.abs(x)
    out = F.when(a >= 1e9, F.format_string("%.2fB", r(x / 1e9, 2))).when(a >= 1e6, F.format_string("%.2fM", r(x / 1e6, 2))).when(a >= 1e3, F.format_string("%.1fK", r(x / 1e3, 1)))
    return F.when(x.isNull() | F.isnan(x), "-").otherwise(out.otherwise(r0(x).cast("string")))


def base_asset(symbol: Column, quote: str = "USDT") -> Column:
    return F.regexp_replace(symbol, f"{quote}$", "")


def html_escaped(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def chart_url(base: str, symbol: Column, suffix: str = "") -> Column:
    return F.concat(F.lit(base), F.url_encode(F.concat(symbol, F.lit(suffix))))


def odds(hit_rate: Column, config: Config) -> Column:
    return r(hit_rate / config.early.base_rate, 2)
