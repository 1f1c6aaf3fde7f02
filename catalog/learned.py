"""Learned-score queries (I5, I6, K9 to K15, A6)."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from catalog.registry import EVENT, UNIVERSE, query
from catalog.sqlbase import CTES, r1, rank0
from catalog.strategies import cal, regime
from tidemark import params as P
from tidemark.operators import learned as K
from tidemark.operators.score import learned_score
from tidemark.plans.panel import panel_inputs, point_in_time_panel
from tidemark.operators.research import walk_forward_folds
from tidemark.session import shared_dir
from tidemark.sources.payloads import load_score_artifact


def _feature_sql(source: str, keys: str) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT {keys}, symbol, '{n}' AS name, {d} AS sgn, CAST({'abs(median_dist_3y)' if n == 'abs_median_dist_3y' else n} AS DOUBLE) AS v FROM {source}"
        for n, d in P.FEATURE_DIRECTIONS.items()
    )


def _oriented(prefix: str, source: str, key: str) -> None:
    CTES[f"{prefix}_long"] = _feature_sql(source, key)
    CTES[f"{prefix}_filled"] = f"""
SELECT l.{key}, l.symbol, l.name, l.sgn, coalesce(l.v, m.med, 0.0) AS v FROM {prefix}_long l LEFT JOIN (
  SELECT {key}, name, list_sort(list(v))[count(*) // 2 + 1] AS med FROM {prefix}_long WHERE v IS NOT NULL GROUP BY 1, 2) m USING ({key}, name)"""
    CTES[f"{prefix}_x"] = f"""
SELECT {key}, symbol, name, CASE WHEN sgn > 0 THEN r ELSE 1.0 - r END AS x FROM (
  SELECT *, CASE WHEN count(*) OVER (PARTITION BY {key}, name) > 1 THEN 1.0 * {rank0(f"{key}, name", "v")} / (count(*) OVER (PARTITION BY {key}, name) - 1) ELSE 0.5 END AS r
  FROM {prefix}_filled)"""


_oriented("panel_features", "rows_m", "anchor")
# A fixed linear artifact: weights falling with the feature's position.
CTES["toy_weights"] = "\nUNION ALL\n".join(
    f"SELECT '{n}' AS name, CAST({round(1.0 / (i + 2), 6)} AS DOUBLE) AS weight, CAST({0.4 + 0.01 * i:.2f} AS DOUBLE) AS mean, CAST({0.25 + 0.005 * i:.3f} AS DOUBLE) AS scale"
    for i, n in enumerate(P.FEATURE_DIRECTIONS)
)


def toy_weights(ws):
    rows = [
        (n, round(1.0 / (i + 2), 6), float(f"{0.4 + 0.01 * i:.2f}"), float(f"{0.25 + 0.005 * i:.3f}"))
        for i, n in enumerate(P.FEATURE_DIRECTIONS)
    ]
    return ws.spark.createDataFrame(rows, "name string, weight double, mean double, scale double")


CTES["learned_raw"] = """
SELECT anchor, symbol, round(sum(weight * ((x - mean) / scale)), 12) AS raw FROM panel_features_x JOIN toy_weights USING (name) GROUP BY 1, 2"""
_LEARNED = f"""SELECT anchor, symbol, {r1("greatest(0.0, least(100.0, CASE WHEN count(*) OVER (PARTITION BY anchor) > 1 THEN 1.0 * " + rank0("anchor", "raw") + " / (count(*) OVER (PARTITION BY anchor) - 1) ELSE 0.5 END * 100.0))")} AS score FROM learned_raw"""
query("learned_score", "anchor:d symbol:s score:f1", _LEARNED)(
    lambda ws: learned_score(ws.keep("panel_inputs", lambda: panel_inputs(ws.candles, ws.market_history, ws.coins, cal(ws), EVENT)), toy_weights(ws))
)

CTES["sample_pairs"] = f"""
SELECT * FROM (SELECT a.*, b.price / a.price - 1.0 AS ret, count(*) OVER (PARTITION BY a.idx) AS un
  FROM panel_m a JOIN panel_m b ON b.symbol = a.symbol AND b.idx = a.idx + 1) WHERE un >= {UNIVERSE}"""
CTES["sample_labels"] = f"""
SELECT dense_rank() OVER (ORDER BY idx) - 1 AS pos, idx, anchor, symbol, score AS baseline, ret,
  {rank0("idx", "ret")} / (un - 1) - 0.5 AS y FROM sample_pairs"""
_oriented("sample", "sample_pairs", "idx")


def samples(ws):
    if "samples" not in ws._kept:
        labels, features = K.training_samples(ws.panel(), cal(ws), regime(ws), 1, UNIVERSE)
        ws._kept["samples"] = (ws.keep("labels", lambda: labels), ws.keep("features", lambda: features))
    return ws._kept["samples"]


def folds(ws):
    return walk_forward_folds(samples(ws)[0].select("pos").distinct())


def weights(ws):
    return ws.keep("fold_weights", lambda: K.fit_folds(K.gram_blocks(K.sample_vectors(*samples(ws))), folds(ws)))


query("training_samples", "idx:i symbol:s name:s x:f8 y:f8 baseline:f1 ret:f8", "SELECT * FROM sample_x JOIN sample_labels USING (idx, symbol)")(
    lambda ws: samples(ws)[1].join(samples(ws)[0], ["idx", "symbol"])
)
CTES["sample_folds"] = """
SELECT row_number() OVER (ORDER BY t) - 1 AS fold, t - 2 AS train_end, t AS test_start, least(n, t + 12) AS test_end
FROM (SELECT unnest(generate_series(26, n - 1, 12)) AS t, n FROM (SELECT max(pos) + 1 AS n FROM sample_labels))"""
query(
    "standardize",
    "fold:i name:s mean:f8 scale:f8",
    """SELECT fold, name, avg(x) AS mean, CASE WHEN coalesce(stddev_samp(x), 0) < 1e-12 THEN 1.0 ELSE stddev_samp(x) END AS scale
    FROM sample_x JOIN sample_labels USING (idx, symbol) JOIN sample_folds ON pos < train_end GROUP BY 1, 2""",
)(lambda ws: K.standardize(samples(ws)[1], samples(ws)[0], folds(ws)))


def _fit(prefix: str, folds_sql: str) -> None:
    """Check SQL of the fit: standardised products of all pairs of features, then 60 sweeps over the coordinates, a row of
    the recursion each; inside a sweep the weights pass from one coordinate to the next."""
    names = ", ".join(f"('{n}', {i})" for i, n in enumerate(P.FEATURE_DIRECTIONS, 1))
    CTES[f"{prefix}_folds"] = folds_sql
    CTES[f"{prefix}_std"] = f"""
SELECT fold, name, i, avg(x) AS mean, CASE WHEN coalesce(stddev_samp(x), 0) < 1e-12 THEN 1.0 ELSE stddev_samp(x) END AS scale, count(*) AS n
FROM sample_x JOIN sample_labels USING (idx, symbol) JOIN {prefix}_folds ON pos < train_end JOIN (VALUES {names}) f(name, i) USING (name) GROUP BY 1, 2, 3"""
    CTES[f"{prefix}_z"] = f"""
SELECT fold, idx, symbol, i, y, (x - mean) / scale AS z FROM sample_x JOIN sample_labels USING (idx, symbol) JOIN {prefix}_folds ON pos < train_end
JOIN {prefix}_std USING (fold, name)"""
    CTES[f"{prefix}_gram"] = f"""
SELECT fold, list(g ORDER BY i) AS g, list(t ORDER BY i) AS t FROM (
  SELECT fold, i, list(v ORDER BY j) AS g FROM (SELECT a.fold, a.i, b.i AS j, sum(a.z * b.z) AS v FROM {prefix}_z a JOIN {prefix}_z b USING (fold, idx, symbol) GROUP BY 1, 2, 3) GROUP BY 1, 2)
JOIN (SELECT fold, i, sum(z * y) AS t FROM {prefix}_z GROUP BY 1, 2) USING (fold, i) GROUP BY 1"""
    CTES[f"{prefix}_fit"] = f"""
WITH RECURSIVE r AS (
  SELECT fold, 0 AS sweep, list_transform(t, lambda x: 0.0::DOUBLE) AS w FROM {prefix}_gram
  UNION ALL
  SELECT fold, sweep + 1, list_reduce(list_prepend(w, list_transform(range(1, len(t) + 1), lambda k: [k::DOUBLE])), lambda a, k:
    list_transform(a, lambda v, i: CASE WHEN i = k[1] THEN greatest(0.0, (t[i] - list_dot_product(g[i], a) + g[i][i] * v) / (0.05 * n + g[i][i])) ELSE v END))
  FROM r JOIN {prefix}_gram USING (fold) JOIN (SELECT fold, max(n) AS n FROM {prefix}_std GROUP BY 1) USING (fold) WHERE sweep < 60)
SELECT s.fold, s.name, r.w[s.i] AS weight, s.mean, s.scale, s.n FROM r JOIN {prefix}_std s USING (fold) WHERE sweep = 60"""


_fit("fold", "SELECT fold, train_end FROM sample_folds WHERE train_end >= 6")
query("fit_nonnegative", "fold:i name:s weight:f6 mean:f8 scale:f8 n:i", "SELECT * FROM fold_fit")(weights)
query("evaluate_model", "section:s metric:s value:f6")(
    lambda ws: K.evaluate_model(K.predictions(*samples(ws), folds(ws), weights(ws)), weights=weights(ws))
)


def artifact(ws):
    if "artifact" not in ws._kept:
        path = f"{shared_dir(ws.spark)}/artifact-{uuid.uuid4().hex}"
        K.export_artifact(*samples(ws), dt.date(2000, 12, 31), "learned_v1", path)
        ws._kept["artifact"] = path
    return load_score_artifact(ws.spark, ws._kept["artifact"], "learned_v1", list(P.FEATURE_DIRECTIONS))


_fit("final", "SELECT 0 AS fold, max(pos) + 1 AS train_end FROM sample_labels WHERE anchor <= DATE '2000-12-31'")
_SIGNS = ", ".join(f"('{n}', {int(d)})" for n, d in P.FEATURE_DIRECTIONS.items())
CTES["artifact"] = f"SELECT name, weight, mean, scale, direction FROM final_fit JOIN (VALUES {_SIGNS}) f(name, direction) USING (name)"
query("export_artifact", "name:s weight:f6 mean:f6 scale:f6 direction:i", "SELECT * FROM artifact")(artifact)
query("load_score_artifact", "name:s weight:f6 direction:i", "SELECT * FROM artifact")(artifact)
_RULE = ", ".join(f"('{k}', CAST({v} AS DOUBLE), {K.RULE_SIGNS[k]})" for k, v in P.SCORE_WEIGHTS.items())
query(
    "score_model_catalog",
    "version:s label:s description:s name:s weight:f6 direction:i",
    f"""SELECT 'rule' AS version, '{K.MODEL_LABELS["rule"][0]}' AS label, '{K.MODEL_LABELS["rule"][1]}' AS description, name, weight, direction
      FROM (VALUES {_RULE}) r(name, weight, direction)
    UNION ALL SELECT 'learned_v1', '{K.MODEL_LABELS["learned"][0]}', '{K.MODEL_LABELS["learned"][1]}', name, weight, direction FROM artifact""",
)(lambda ws: K.model_catalog(artifact(ws), "learned_v1"))
CTES["artifact_raw"] = """
SELECT anchor, symbol, round(sum(weight * ((x - mean) / scale)), 12) AS raw FROM panel_features_x JOIN artifact USING (name) GROUP BY 1, 2"""
query(
    "learned_panel",
    "anchor:d symbol:s score:f1 price:f8",
    f"SELECT s.*, r.price FROM ({_LEARNED.replace('learned_raw', 'artifact_raw')}) s JOIN rows_m r USING (anchor, symbol)",
)(
    lambda ws: point_in_time_panel(ws.candles, ws.market_history, ws.coins, cal(ws), EVENT, artifact(ws))
)
