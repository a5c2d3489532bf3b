"""Rules that find lasting changes in a series of window values; None and NaN are untested windows."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

#: Fixed values of the rules.
BASELINE, LEAST_BASELINE, FLAG_AT, MAD_SCALE, MEAN_SCALE, LEVEL_SHARE = 8, 4, 3.5, 1.4826, 1.2533, 0.05
CUSUM_SLACK, CUSUM_LIMIT, CUSUM_DETECT = 0.5, 5.0, 6.0
#: Stricter thresholds where many series are scanned: (robust, cusum).
THRESHOLDS = {"network": (FLAG_AT, CUSUM_DETECT), "group": (4.5, 9.0), "node": (5.0, 12.0)}
LEAST_COVERAGE, QUIET_SHARE = 0.6, 0.4

Noise = Callable[[int, float], float] | None


def scale_of(base: np.ndarray, count: bool, noise: float = 0.0) -> tuple[float, float]:
    """(median, scale) of baseline values; the scale has floors so that a flat baseline doesn't make every change infinite."""
    median = float(np.median(base))
    off = np.abs(base - median)
    floors = [MAD_SCALE * float(np.median(off)), MEAN_SCALE * float(off.mean()), LEVEL_SHARE * abs(median), noise, 1e-9]
    if count:
        floors.append(math.sqrt(max(median, 1.0)))
    return median, max(floors)


def persistence(x: list[float], first: int, last: int, baseline: float, direction: str) -> dict:
    """How long a shift held: each later window is nearer the baseline before it or nearer the level of the flagged run."""
    run = [v for v in x[first : last + 1] if math.isfinite(v)]
    level = sum(run) / len(run) if run else math.nan
    middle = (level + baseline) / 2
    near = [(t, (v > middle) if direction == "up" else (v < middle)) for t, v in enumerate(x) if t >= first and math.isfinite(v)]
    unbroken = next((i for i, (_, ok) in enumerate(near) if not ok), len(near))
    held = sum(ok for _, ok in near)
    return {"level": level, "held": held, "span": len(near), "held_to_end": bool(near) and held == len(near), "last_held": near[unbroken - 1][0] if unbroken else first}


def robust(x: list[float], threshold: float = FLAG_AT, baseline: int = BASELINE, least: int = LEAST_BASELINE, count: bool = False, noise: Noise = None) -> list[dict]:
    """Runs of windows far from the median of the windows before; neighbours in one direction are one shift, its z that of its peak."""
    out: list[dict] = []
    for t in range(least, len(x)):
        base = np.array([v for v in x[max(0, t - baseline) : t] if math.isfinite(v)])
        if len(base) < least or not math.isfinite(x[t]):
            continue
        median, _ = scale_of(base, count)
        median, scale = scale_of(base, count, (noise(t, median) or 0.0) if noise else 0.0)
        z = (x[t] - median) / scale
        if abs(z) < threshold:
            continue
        direction = "up" if z > 0 else "down"
        run = out[-1] if out else None
        if run and run["end"] == t - 1 and run["direction"] == direction:
            run["end"], run["length"] = t, run["length"] + 1
            if abs(z) > abs(run["z"]):
                run["z"], run["peak"] = z, t
        else:
            out.append({"window": t, "end": t, "length": 1, "value": x[t], "baseline": median, "z": z, "peak": t, "direction": direction})
    return [r | persistence(x, r["window"], r["end"], r["baseline"], r["direction"]) for r in out]


def cusum(x: list[float], limit: float = CUSUM_LIMIT, slack: float = CUSUM_SLACK, baseline: int = BASELINE, count: bool = False, noise: Noise = None) -> list[dict]:
    """Two-sided cumulative sums of values standardised by the first windows; a signal starts its side again from 0."""
    base = np.array([v for v in x[:baseline] if math.isfinite(v)])
    if len(base) < 3:
        return []
    median, _ = scale_of(base, count)
    median, scale = scale_of(base, count, (noise(baseline // 2, median) or 0.0) if noise else 0.0)
    out: list[dict] = []
    sums, starts = {"up": 0.0, "down": 0.0}, {"up": baseline, "down": baseline}
    for t in range(baseline, len(x)):
        if not math.isfinite(x[t]):
            continue
        z = (x[t] - median) / scale
        for side, sign in (("up", 1), ("down", -1)):
            if sums[side] == 0:
                starts[side] = t
            sums[side] = max(0.0, sums[side] + sign * z - slack)
        for side in ("up", "down"):
            if sums[side] > limit:
                out.append({"window": starts[side], "end": t, "direction": side, "z": sums[side], "baseline": median, "value": x[t], "peak": t, "length": t - starts[side] + 1})
                sums[side] = 0.0
    return [r | persistence(x, r["window"], r["end"], r["baseline"], r["direction"]) for r in out]


def quiet_weekends(weekday: list[int], totals: list[float], coverage: list[float]) -> bool:
    """Whether Saturdays and Sundays (6, 7) have less than 40 % of a weekday's activity, judged on whole days, two and five at least."""
    known = [(d, v) for d, v, c in zip(weekday, totals, coverage) if math.isfinite(v) and c >= LEAST_COVERAGE]
    ends, days = [v for d, v in known if d > 5], [v for d, v in known if d <= 5]
    if len(ends) < 2 or len(days) < 5 or sum(days) <= 0:
        return False
    return sum(ends) / len(ends) < QUIET_SHARE * sum(days) / len(days)


def between_edges(x: list[float], edges: list[int], find: Callable[[list[float], int], list[dict]]) -> list[dict]:
    """Shifts of the parts of a series between windows where a source starts or ends; those windows and their neighbours aren't tested."""
    out, start = [], 0
    for edge in [*sorted(edges), None]:
        stop = len(x) if edge is None else max(start, edge - 1)
        if stop - start >= 2:
            for found in find(x[start:stop], start):
                out.append(found | {k: found[k] + start for k in ("window", "end", "peak", "last_held")})
        start = len(x) if edge is None else max(start, edge + 2)
    return out


def noise_floor(metric: str, ties: list[float]) -> Noise:
    """Sampling noise of shares of few ties: mutual ties come in pairs, a triangle closes three triples; density's is Poisson."""
    part = {"reciprocity": 2, "transitivity": 3, "tie_retention": 1, "cross_share": 1}.get(metric)
    at = lambda t: max(1.0, ties[t] if t < len(ties) and math.isfinite(ties[t]) else 0.0)
    if metric == "density":
        return lambda t, median: abs(median) / math.sqrt(at(t))
    if part is None:
        return None

    def floor(t: int, median: float) -> float:
        p = min(0.95, max(0.05, median))
        return math.sqrt(p * (1 - p) / max(1.0, at(t) / part))

    return floor


def holm(p: list[float]) -> list[float]:
    """Adjusted p-values, step down."""
    order = sorted(range(len(p)), key=lambda i: p[i])
    out, most = [0.0] * len(p), 0.0
    for place, i in enumerate(order):
        most = max(most, min(1.0, (len(p) - place) * p[i]))
        out[i] = most
    return out
