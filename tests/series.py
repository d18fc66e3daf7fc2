"""Small bar series, and sequential definitions that the window forms must agree with."""

from __future__ import annotations

import random

START, STEP = 1_700_000_000_000, 3_600_000


def from_closes(closes, spread=0.5, buy=0.5, volume=100.0, symbol="X"):
    rows, prev = [], closes[0]
    for i, c in enumerate(closes):
        rows.append((symbol, "1h", START + i * STEP, float(prev), c + spread, c - spread, float(c), float(volume), float(c * volume), 10, volume * buy))
        prev = c
    return rows


def zigzag(anchors, leg=4):
    out = [float(anchors[0])]
    for a, b in zip(anchors, anchors[1:], strict=False):
        out += [a + (b - a) * k / leg for k in range(1, leg + 1)]
    return out


def walk(n, seed, symbol="W"):
    rng, rows, px = random.Random(seed), [], 100.0
    for i in range(n):
        o, px = px, max(1.0, px * (1 + rng.gauss(0, 0.03)))
        hi, lo = max(o, px) * (1 + abs(rng.gauss(0, 0.01))), min(o, px) * (1 - abs(rng.gauss(0, 0.01)))
        v = rng.uniform(50, 150)
        rows.append((symbol, "1h", START + i * STEP, o, hi, lo, px, v, v * px, rng.randint(1, 50), v * rng.random()))
    return rows


def frame(spark, rows):
    from wickframe.sources.bars import BAR, indexed

    return indexed(spark.createDataFrame(rows, BAR))


def column(df, name):
    return [r[name] for r in df.orderBy("symbol", "tf", "bar_idx").collect()]


# ---------------------------------------------------------------- sequential definitions
def ema(values, p):
    out, e = [None] * len(values), None
    for i, v in enumerate(values):
        if i == p - 1:
            e = sum(values[:p]) / p
        elif i >= p:
            e += (v - e) * 2 / (p + 1)
        out[i] = e
    return out


def wilder(values, p):
    out, e = [None] * len(values), None
    for i, v in enumerate(values):
        if i == p:
            e = sum(values[1 : p + 1]) / p
        elif i > p:
            e = (e * (p - 1) + v) / p
        out[i] = e
    return out


def rsi(closes, p=14):
    step = [0.0] + [b - a for a, b in zip(closes, closes[1:], strict=False)]
    up, down = wilder([max(s, 0) for s in step], p), wilder([max(-s, 0) for s in step], p)
    return [None if u is None else 100.0 if d == 0 else 100 - 100 / (1 + u / d) for u, d in zip(up, down, strict=True)]


def pivots(rows, length=5):
    out = []
    for i in range(length, len(rows) - length):
        around = [rows[j] for j in range(i - length, i + length + 1) if j != i]
        if all(r[4] < rows[i][4] for r in around):
            out.append((i, "high", rows[i][4]))
        if all(r[5] > rows[i][5] for r in around):
            out.append((i, "low", rows[i][5]))
    return out


def structure_events(rows, length=5):
    found, refs, last, out = pivots(rows, length), {}, None, []
    if len(found) < 3:
        return out
    by_bar = {}
    for i, kind, price in found:
        by_bar.setdefault(i, []).append((kind, price))
    for i in range(len(rows) - 1):
        close = rows[i][6]
        for kind, side, beyond in (("high", "bullish", 1), ("low", "bearish", -1)):
            if kind in refs and (close - refs[kind]) * beyond > 0:
                out.append((i, side + ("_choch" if last not in (None, side) else "_bos"), refs.pop(kind)))
                last = side
        for kind, price in by_bar.get(i, []):
            refs[kind] = price
    return out


def partial_exit(rows, i, risk, hold, target_r=4.0, cost=0.002):
    fill = rows[i + 1][3]
    value = lambda px: ((px - fill) / fill - cost) / (risk / fill)
    stop, taken = fill - risk, False
    for k in range(i + 1, min(len(rows), i + 1 + hold)):
        if rows[k][5] <= stop:
            return (0.5 + 0.5 * value(stop), "even", k) if taken else (value(stop), "stop", k)
        if not taken and rows[k][4] >= fill + risk:
            taken, stop = True, fill
        if taken and rows[k][4] >= fill + risk * target_r:
            return 0.5 + 0.5 * value(fill + risk * target_r), "target", k
    k = min(len(rows) - 1, i + hold)
    return (0.5 + 0.5 * value(rows[k][6]) if taken else value(rows[k][6])), "time", k


def trailing_exit(rows, i, risk, hold, cost=0.002):
    fill, peak = rows[i + 1][3], 0.0
    value = lambda px: ((px - fill) / fill - cost) / (risk / fill)
    for k in range(i + 1, min(len(rows), i + 1 + hold)):
        peak = max(peak, (rows[k][4] - fill) / risk)
        level = fill + (peak - 1) * risk if peak >= 2 else fill - risk
        if rows[k][5] <= level:
            return value(level), "trail" if peak >= 2 else "stop", k
    k = min(len(rows) - 1, i + hold)
    return value(rows[k][6]), "time", k
