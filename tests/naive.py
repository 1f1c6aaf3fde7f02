"""Plain restatements of definitions, used as brute-force checks on small series."""

from __future__ import annotations

import statistics


def bounces(closes):
    """Proven bounces in the last 1095 closes: (touches, count, mean gain percent)."""
    s = closes[-1095:]
    if len(s) < 150:
        return 0, 0, None
    gains, i = [], 30
    while i < len(s):
        start = max(0, i - 120)
        trough = min(s[start : i + 1])
        at = start + s[start : i + 1].index(trough)
        top = s[i] >= max(s[i - 30 : i + 1])
        if top and trough <= min(s[: at + 1]) * 1.15 and s[i] / trough - 1.0 >= 0.3:
            gains.append(s[i] / trough - 1.0)
            i += 45
        else:
            i += 1
    near = s[-1] <= min(s) * 1.15
    return len(gains) + near, len(gains), round(100.0 * sum(gains) / len(gains), 1) if gains else None


def stats(closes, lows):
    """A few of the statistics, as defined."""
    n, c = len(closes), closes[-1]
    out = {"history_days": n}
    share = lambda w: round(100.0 * sum(x <= c for x in w) / len(w), 1)
    out["valuation_pct_1y"] = share(closes[-365:]) if n >= 180 else None
    out["valuation_pct_all"] = share(closes) if n >= 180 else None
    out["valuation_pct_3y"] = share(closes[-1095:]) if n >= 400 else None
    med = statistics.median(closes[-1095:])
    out["median_dist_3y"] = round((c - med) / med * 100, 1) if n >= 400 else None
    out["days_since_atl"] = n - 1 - lows.index(min(lows)) if n >= 30 else None
    year = sorted(closes[-365:])
    floor = year[max(0, int(0.25 * len(year)) - 1)]
    last = closes[-90:]
    out["basing_pct_90d"] = round(100.0 * sum(x <= floor for x in last) / len(last), 1) if n >= 180 else None
    out["trend_30d"] = round((c / closes[-31] - 1) * 100, 1) if n >= 31 else None
    window = closes[-200:]
    out["above_sma200"] = c > sum(window) / len(window) if n >= 60 else None
    touches, count, mean = bounces(closes)
    out.update(dip_touches=touches, dip_bounces=count, dip_bounce_avg=mean)
    return out


def average_ranks(values):
    ordered = sorted(values)
    return [(ordered.index(v) + len(ordered) - 1 - ordered[::-1].index(v)) / 2 for v in values]
