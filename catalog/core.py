"""Panel and score queries."""

from __future__ import annotations

from catalog.registry import EVENT, Workspace, query
from tidemark.operators.lookback import EXTRAS, STATS, lookback_stats

STAT_TYPES = {
    "days_since_atl": "i", "history_days": "i", "above_sma200": "b", "above_p75_3y": "i", "below_p25_3y": "i",
    "dip_touches": "i", "dip_bounces": "i", "range_position": "f3", "band_iqr_width_3y": "f3",
    "band_span_width_3y": "f3", "volatility_30d": "f6", "volatility_90d": "f6", "drawdown_from_ath": "f6",
    "days_since_ath": "i", "dollar_volume_30d": "f5",
}


def spec(*names: str) -> str:
    return " ".join(f"{n}:{STAT_TYPES.get(n, 'f1')}" for n in names)


PANEL_SPEC = f"anchor:d symbol:s score:f1 distance:f4 price:f8 cap:f4 volume:f4 {spec(*STATS, *EXTRAS)}"
for _f in ("monthly", "weekly", "quarterly"):
    _s = _f[0]
    query(f"point_in_time_panel_{_f}", PANEL_SPEC, f"SELECT * FROM panel_{_s}")(lambda ws, f=_f: ws.panel(f))
