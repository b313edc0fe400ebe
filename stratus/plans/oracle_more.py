"""More oracle SQL."""

from .oracle import CTE, DEPS, SQL, _metrics, with_ctes

# ------------------------------------------------------------------ promotion
CTE["cands"] = """
cands AS (
  SELECT o_custkey AS line, o_orderkey AS cand_id, o_orderdate AS ts,
         0.88::DOUBLE + (CAST(round(o_totalprice * 100) AS BIGINT) % 120) / 1000 AS R2,
         (CAST(round(o_totalprice * 100) AS BIGINT) % 53) / 1000 AS MAE,
         CASE WHEN o_orderkey % 9 = 0 THEN 'B' ELSE 'A' END AS feature_order,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq
  FROM orders
)"""


def _decision(r2="R2", mae="MAE", fo="feature_order", pr2="s_R2", pmae="s_MAE", pfo="s_fo", has="s_has",
              floor=0.90, ceil=0.05, minor=0.03, major=0.08, tol=0.05):
    d = f"({r2} - {pr2})"
    rel = f"(({mae} - {pmae}) / greatest({pmae}, 1e-12))"
    return f"""CASE WHEN {r2} < {floor} THEN 'refused:r2_below_floor'
      WHEN {mae} > {ceil} THEN 'refused:mae_above_ceiling'
      WHEN NOT {has} THEN 'bootstrap'
      WHEN {fo} <> {pfo} THEN CASE WHEN {d} >= {minor} AND {rel} <= {tol} THEN 'schema_break_accepted' ELSE 'refused:schema_break' END
      WHEN {d} >= {major} AND {rel} <= 0 THEN 'major_gain'
      WHEN {d} >= {minor} AND {rel} <= 0 THEN 'minor_gain'
      WHEN {d} >= {minor} AND {rel} > 0 AND {rel} <= {tol} THEN 'minor_gain_mae_soft'
      WHEN {d} >= {minor} AND {rel} > {tol} THEN 'refused:mae_regression'
      WHEN {d} >= 0 AND {rel} <= 0 THEN 'stable_or_better'
      WHEN {d} >= 0 AND {rel} > 0 THEN 'r2_ok_mae_worse'
      WHEN {d} < 0 AND {rel} < 0 THEN 'tradeoff_mae'
      ELSE 'refused:dual_regression' END"""


# recursive fold: state s_* is the last accepted candidate of the line
CTE["fold"] = f"""
fold AS (
  WITH RECURSIVE f(line, seq, cand_id, ts, decision, d_r2, rel, s_has, s_major, s_minor, s_patch, s_R2, s_MAE, s_fo, s_epoch, s_created,
                  version, parent_version, bundle_epoch, created_at) AS (
    SELECT DISTINCT line, 0::BIGINT, NULL::BIGINT, NULL::TIMESTAMP, NULL::VARCHAR, NULL::DOUBLE, NULL::DOUBLE, false,
           0, 0, 0, 0.0::DOUBLE, 0.0::DOUBLE, NULL::VARCHAR, 0, NULL::TIMESTAMP, NULL::VARCHAR, NULL::VARCHAR, NULL::INTEGER, NULL::TIMESTAMP
    FROM cands
    UNION ALL
    SELECT x.line, x.seq, x.cand_id, x.ts, x.dec,
           CASE WHEN x.s_has AND x.dec NOT LIKE 'refused:r2%' AND x.dec NOT LIKE 'refused:mae_above%' THEN x.R2 - x.s_R2 END,
           CASE WHEN x.s_has AND x.dec NOT LIKE 'refused:r2%' AND x.dec NOT LIKE 'refused:mae_above%' THEN (x.MAE - x.s_MAE) / greatest(x.s_MAE, 1e-12) END,
           x.s_has OR x.acc,
           CASE WHEN x.acc THEN x.n_major ELSE x.s_major END,
           CASE WHEN x.acc THEN x.n_minor ELSE x.s_minor END,
           CASE WHEN x.acc THEN x.n_patch ELSE x.s_patch END,
           CASE WHEN x.acc THEN x.R2 ELSE x.s_R2 END,
           CASE WHEN x.acc THEN x.MAE ELSE x.s_MAE END,
           CASE WHEN x.acc THEN x.feature_order ELSE x.s_fo END,
           CASE WHEN x.acc THEN x.n_epoch ELSE x.s_epoch END,
           CASE WHEN x.acc THEN x.n_created ELSE x.s_created END,
           CASE WHEN x.acc THEN x.n_major || '.' || x.n_minor || '.' || x.n_patch END,
           CASE WHEN x.acc AND x.s_has THEN x.s_major || '.' || x.s_minor || '.' || x.s_patch END,
           CASE WHEN x.acc THEN x.n_epoch END,
           CASE WHEN x.acc THEN x.n_created END
    FROM (
      SELECT y.*, y.dec NOT LIKE 'refused%' AS acc,
             CASE WHEN y.dec = 'bootstrap' THEN 1 WHEN y.dec = 'major_gain' THEN y.s_major + 1 ELSE y.s_major END AS n_major,
             CASE WHEN y.dec IN ('bootstrap', 'major_gain') THEN 0 WHEN y.dec IN ('minor_gain', 'schema_break_accepted') THEN y.s_minor + 1 ELSE y.s_minor END AS n_minor,
             CASE WHEN y.dec IN ('bootstrap', 'major_gain', 'minor_gain', 'schema_break_accepted') THEN 0 ELSE y.s_patch + 1 END AS n_patch,
             CASE WHEN y.dec = 'bootstrap' THEN 7 WHEN y.dec = 'major_gain' THEN y.s_epoch + 1 ELSE y.s_epoch END AS n_epoch,
             CASE WHEN y.dec = 'bootstrap' THEN y.ts ELSE greatest(y.ts, y.s_created + INTERVAL 1 MICROSECOND) END AS n_created
      FROM (
        SELECT c.line, c.seq, c.cand_id, c.ts, c.R2, c.MAE, c.feature_order,
               f.s_has, f.s_major, f.s_minor, f.s_patch, f.s_R2, f.s_MAE, f.s_fo, f.s_epoch, f.s_created,
               {_decision()} AS dec
        FROM f JOIN cands c ON c.line = f.line AND c.seq = f.seq + 1
      ) y
    ) x
  )
  SELECT line, cand_id, ts, decision,
         CASE WHEN decision NOT LIKE 'refused%' THEN decision END AS promotion_class,
         CASE WHEN decision LIKE 'refused%' THEN substr(decision, 9) END AS refusal,
         version, parent_version, bundle_epoch, created_at, d_r2 AS delta_R2, rel AS mae_rel
  FROM f WHERE seq > 0
)"""
DEPS["fold"] = ["cands"]

SQL["promotion_fold"] = with_ctes(["fold"], """
SELECT line, cand_id, decision, promotion_class, refusal, version, parent_version, bundle_epoch, created_at,
       round(delta_R2, 6) AS delta_R2, round(mae_rel, 6) AS mae_rel FROM fold""")

SQL["promotion_step"] = with_ctes(["cands"], f"""
, l AS (SELECT *, lag(R2) OVER w AS p_R2, lag(MAE) OVER w AS p_MAE, lag(feature_order) OVER w AS p_fo
        FROM cands WINDOW w AS (PARTITION BY line ORDER BY ts, cand_id))
SELECT line, cand_id, {_decision(pr2='p_R2', pmae='p_MAE', pfo='p_fo', has='(p_R2 IS NOT NULL)')} AS decision,
       round(R2 - p_R2, 6) AS delta_R2, round((MAE - p_MAE) / greatest(p_MAE, 1e-12), 6) AS mae_rel
FROM l""")

SQL["parent_lookup"] = with_ctes(["fold"], """
SELECT line, cand_id,
  last_value(version IGNORE NULLS) OVER w AS parent_version,
  last_value(CASE WHEN version IS NOT NULL THEN R2 END IGNORE NULLS) OVER w AS parent_R2,
  last_value(CASE WHEN version IS NOT NULL THEN MAE END IGNORE NULLS) OVER w AS parent_MAE
FROM fold JOIN cands USING (line, cand_id)
WINDOW w AS (PARTITION BY line ORDER BY fold.ts, cand_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")

SQL["active_pointer"] = with_ctes(["fold"], """
, acc AS (SELECT *, promotion_class IN ('bootstrap','major_gain','minor_gain','schema_break_accepted','stable_or_better') AS is_anchor
          FROM fold WHERE promotion_class IS NOT NULL),
la AS (SELECT line, max(created_at) FILTER (WHERE is_anchor) AS a_t FROM acc GROUP BY line),
per AS (
  SELECT a.line,
         arg_max(version, (created_at, cand_id)) FILTER (WHERE is_anchor) AS anchor,
         arg_max(version, (created_at, cand_id)) FILTER (WHERE NOT is_anchor AND created_at > la.a_t) AS probe
  FROM acc a JOIN la USING (line) GROUP BY a.line)
SELECT line, anchor, probe, coalesce(probe, anchor) AS active FROM per""")

CTE["manifest"] = """
manifest AS (
  SELECT f.line, f.cand_id, f.version AS model_version, f.parent_version, f.created_at, f.promotion_class, f.bundle_epoch,
         c.R2, c.MAE, c.feature_order,
         sha256('model:' || f.line || ':' || CAST(round(c.R2 * 1000) AS BIGINT)) AS d_model,
         sha256('metrics:' || f.line || ':' || CAST(round(c.MAE * 1000) AS BIGINT)) AS d_metrics,
         sha256('encoders:' || f.line) AS d_enc,
         sha256('features:' || c.feature_order) AS d_feat,
         octet_length(('model:' || f.line || ':' || CAST(round(c.R2 * 1000) AS BIGINT))::BLOB) AS s_model,
         octet_length(('metrics:' || f.line || ':' || CAST(round(c.MAE * 1000) AS BIGINT))::BLOB) AS s_metrics,
         octet_length(('encoders:' || f.line)::BLOB) AS s_enc,
         octet_length(('features:' || c.feature_order)::BLOB) AS s_feat
  FROM fold f JOIN cands c USING (line, cand_id) WHERE f.promotion_class IS NOT NULL
)"""
DEPS["manifest"] = ["fold"]

CTE["lineage"] = """
lineage AS (
  SELECT line, model_version, parent_version, sha256(coalesce(parent_version, 'ROOT') || '|' || model_version || '|' || digest_ring) AS lineage_token,
         digest_ring, publish_nonce, left(sha256(publish_nonce), 32) AS seal_tag
  FROM (SELECT *, sha256(bundle_epoch || '|' || d_model || '|' || d_metrics || '|' || d_enc || '|' || d_feat) AS digest_ring,
               left(md5(line || '|' || model_version), 16) AS publish_nonce FROM manifest)
)"""
DEPS["lineage"] = ["manifest"]

SQL["catalog_packages"] = with_ctes(["lineage"], """
SELECT m.line, m.model_version AS version, m.parent_version, m.created_at, m.promotion_class, m.bundle_epoch,
       m.R2 AS r2, m.MAE AS mae, l.lineage_token, l.digest_ring, l.seal_tag, l.publish_nonce,
       sha256(l.publish_nonce || '|' || l.seal_tag || '|' || l.digest_ring) AS binding_mac
FROM manifest m JOIN lineage l USING (line, model_version)""")

SQL["lineage_token"] = with_ctes(["lineage"], "SELECT line, model_version, parent_version, lineage_token FROM lineage")

SQL["blob_first_seen"] = with_ctes(["manifest"], """
, e AS (
  SELECT line, model_version, created_at, 'model.pkl' AS logical_name, d_model AS sha256, s_model AS size FROM manifest
  UNION ALL SELECT line, model_version, created_at, 'metrics.json', d_metrics, s_metrics FROM manifest
  UNION ALL SELECT line, model_version, created_at, 'label_encoders.pkl', d_enc, s_enc FROM manifest
  UNION ALL SELECT line, model_version, created_at, 'feature_columns.json', d_feat, s_feat FROM manifest),
r AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY created_at, line,
        CAST(split_part(model_version, '.', 1) AS INT), CAST(split_part(model_version, '.', 2) AS INT), CAST(split_part(model_version, '.', 3) AS INT)) AS rn,
        count(*) OVER (PARTITION BY sha256) AS n_refs,
        min(size) OVER (PARTITION BY sha256) AS msize
      FROM e)
SELECT sha256, logical_name, msize AS size, line AS first_seen_line, model_version AS first_seen_version, n_refs FROM r WHERE rn = 1""")

SQL["parent_chain"] = with_ctes(["manifest"], """
SELECT line, model_version, parent_version, prev AS previous_version,
       coalesce(parent_version = prev, parent_version IS NULL AND prev IS NULL) AS chain_ok
FROM (SELECT *, lag(model_version) OVER (PARTITION BY line ORDER BY
        CAST(split_part(model_version, '.', 1) AS INT), CAST(split_part(model_version, '.', 2) AS INT), CAST(split_part(model_version, '.', 3) AS INT)) AS prev
      FROM manifest)""")

SQL["version_parse"] = with_ctes(["fold"], """
, t AS (SELECT line, cand_id,
          CASE WHEN cand_id % 7 = 0 THEN 'v' || version WHEN cand_id % 11 = 0 THEN version || '.1' ELSE version END AS text
        FROM fold WHERE version IS NOT NULL),
p AS (SELECT *, regexp_full_match(text, '[0-9]+\\.[0-9]+\\.[0-9]+') AS valid FROM t),
q AS (SELECT *, CASE WHEN valid THEN CAST(split_part(text, '.', 1) AS INT) END AS major,
               CASE WHEN valid THEN CAST(split_part(text, '.', 2) AS INT) END AS minor,
               CASE WHEN valid THEN CAST(split_part(text, '.', 3) AS INT) END AS patch FROM p)
SELECT line, cand_id, text, major, minor, patch, valid,
       CASE WHEN valid THEN row_number() OVER (PARTITION BY line, valid ORDER BY major, minor, patch) END AS version_rank
FROM q""")

# ------------------------------------------------------------------ election
CTE["trials"] = """
trials AS (
  SELECT p_brand AS election_id, 'trial_' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS trial_id, p_partkey,
         p_size * 20 AS n_estimators,
         CASE WHEN p_partkey % 7 = 0 THEN 12 END AS max_depth,
         CASE WHEN p_type = 'PROMO' THEN '0.5' WHEN p_type = 'LARGE' THEN 'log2' ELSE 'sqrt' END AS max_features,
         CASE WHEN p_partkey % 10 = 0 THEN 7 ELSE 42 END AS random_state,
         ((CAST(round(p_retailprice * 100) AS BIGINT) + 50) // 100) / 100 AS RMSE,
         p_size / 10 AS MAE, (p_partkey % 50) / 50 AS R2, (p_partkey % 11) / 2 AS pred_var
  FROM part
  UNION ALL
  SELECT 'again', 'trial_' || lpad(CAST(p_partkey AS VARCHAR), 7, '0'), p_partkey, p_size * 20,
         CASE WHEN p_partkey % 7 = 0 THEN 12 END,
         CASE WHEN p_type = 'PROMO' THEN '0.5' WHEN p_type = 'LARGE' THEN 'log2' ELSE 'sqrt' END,
         CASE WHEN p_partkey % 10 = 0 THEN 7 ELSE 42 END,
         CASE WHEN p_partkey % 80 <> 3 THEN ((CAST(round(p_retailprice * 100) AS BIGINT) + 50) // 100) / 100 END,
         p_size / 10, (p_partkey % 50) / 50, (p_partkey % 11) / 2
  FROM part WHERE p_partkey % 40 = 3
)"""
CTE["trials_fp"] = """
trials_fp AS (
  SELECT *, sha256('{"max_depth":' || coalesce(CAST(max_depth AS VARCHAR), 'null') ||
                   ',"max_features":' || CASE WHEN max_features = '0.5' THEN '0.5' ELSE '"' || max_features || '"' END ||
                   ',"min_samples_leaf":1,"min_samples_split":' || (p_partkey % 100000 + 2) || ',"n_estimators":' || n_estimators ||
                   ',"random_state":' || random_state || '}') AS fingerprint
  FROM trials
)"""
DEPS["trials_fp"] = ["trials"]
CTE["elig"] = """
elig AS (
  SELECT t.*, CASE WHEN n_estimators < 100 THEN 'n_estimators_min' WHEN n_estimators > 800 THEN 'n_estimators_max'
                   WHEN max_features <> 'sqrt' THEN 'max_features' WHEN random_state <> 42 THEN 'random_state'
                   WHEN max_depth IS NOT NULL THEN 'max_depth' WHEN pred_var > 4.5 THEN 'pred_var'
                   WHEN RMSE IS NULL THEN 'metrics'
                   WHEN fingerprint IN (SELECT fingerprint FROM trials_fp WHERE p_partkey % 13 = 0) THEN 'denied' END AS reason
  FROM trials_fp t
)"""
DEPS["elig"] = ["trials_fp"]
CTE["borda"] = """
borda AS (
  SELECT election_id, trial_id, RMSE, MAE, R2, pred_var, fingerprint, n_survivors,
         n_survivors - (rank() OVER (PARTITION BY election_id ORDER BY RMSE) + (count(*) OVER (PARTITION BY election_id, RMSE) - 1) / 2) AS borda_rmse,
         n_survivors - (rank() OVER (PARTITION BY election_id ORDER BY MAE) + (count(*) OVER (PARTITION BY election_id, MAE) - 1) / 2) AS borda_mae,
         n_survivors - (rank() OVER (PARTITION BY election_id ORDER BY R2 DESC) + (count(*) OVER (PARTITION BY election_id, R2) - 1) / 2) AS borda_r2
  FROM (SELECT *, count(*) OVER (PARTITION BY election_id) AS n_survivors FROM elig WHERE reason IS NULL)
)"""
DEPS["borda"] = ["elig"]
CTE["cope"] = """
cope AS (
  SELECT a.election_id, a.trial_id,
         CAST(count(b.trial_id) FILTER (WHERE
            ((a.RMSE < b.RMSE)::INT + (a.MAE < b.MAE)::INT + (a.R2 > b.R2)::INT) >
            ((a.RMSE > b.RMSE)::INT + (a.MAE > b.MAE)::INT + (a.R2 < b.R2)::INT)) AS BIGINT) AS copeland
  FROM (SELECT *, borda_rmse + borda_mae + borda_r2 AS borda, max(borda_rmse + borda_mae + borda_r2) OVER (PARTITION BY election_id) AS top FROM borda) a
  LEFT JOIN borda b ON a.election_id = b.election_id AND a.trial_id <> b.trial_id
  WHERE a.borda = a.top
  GROUP BY a.election_id, a.trial_id
)"""
DEPS["cope"] = ["borda"]

SQL["eligible_trials"] = with_ctes(["elig"], "SELECT election_id, trial_id, fingerprint, reason FROM elig")
SQL["borda_points"] = with_ctes(["borda"], """
SELECT election_id, trial_id, n_survivors, borda_rmse, borda_mae, borda_r2, borda_rmse + borda_mae + borda_r2 AS borda FROM borda""")
SQL["copeland_all"] = with_ctes(["borda"], """
SELECT a.election_id, a.trial_id,
       CAST(count(b.trial_id) FILTER (WHERE
          ((a.RMSE < b.RMSE)::INT + (a.MAE < b.MAE)::INT + (a.R2 > b.R2)::INT) >
          ((a.RMSE > b.RMSE)::INT + (a.MAE > b.MAE)::INT + (a.R2 < b.R2)::INT)) AS BIGINT) AS copeland
FROM borda a LEFT JOIN borda b ON a.election_id = b.election_id AND a.trial_id <> b.trial_id
GROUP BY a.election_id, a.trial_id""")
SQL["copeland_leaders"] = with_ctes(["cope"], "SELECT election_id, trial_id, copeland FROM cope")
SQL["election_winner"] = with_ctes(["cope", "trials"], """
, lead AS (SELECT b.*, b.borda_rmse + b.borda_mae + b.borda_r2 AS borda, c.copeland FROM borda b JOIN cope c USING (election_id, trial_id)),
w AS (SELECT election_id, trial_id AS winner, borda, copeland, n_survivors,
             row_number() OVER (PARTITION BY election_id ORDER BY borda DESC, copeland DESC, pred_var, upper(fingerprint), trial_id) AS rn
      FROM lead),
e AS (SELECT DISTINCT election_id FROM trials)
SELECT e.election_id, CASE WHEN w.winner IS NULL THEN 'NONE' ELSE 'OK' END AS status, w.winner, w.borda, w.copeland,
       coalesce(w.n_survivors, 0) AS n_survivors, t.n_estimators, t.max_depth, t.max_features, t.pred_var
FROM e LEFT JOIN (SELECT * FROM w WHERE rn = 1) w USING (election_id)
LEFT JOIN trials t ON t.trial_id = w.winner AND t.election_id = e.election_id""")

# ------------------------------------------------------------------ request log
CTE["req"] = """
req AS (
  SELECT event_id AS request_id, ts, user_id AS client, event_type AS endpoint,
         CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
         CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 4 = 0 THEN 'cache_hit' ELSE 'success' END AS outcome,
         value / 100 AS latency_s, props AS payload_key,
         CASE WHEN hour(ts) IN (3, 4) THEN 0 ELSE 1 END AS model_loaded,
         CAST(user_id AS VARCHAR) || ':' || event_type AS client_key
  FROM events
)"""
_B = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]
_BUCKET = "CASE " + " ".join(f"WHEN latency_s <= {b} THEN {i}" for i, b in enumerate(_B)) + f" ELSE {len(_B)} END"
_LE = "[" + ", ".join(f"'{b}'" for b in _B) + ", '+Inf']"
_BOUNDS = "[" + ", ".join(f"{b}::DOUBLE" for b in _B) + "]"
# sliding windows of 6 h every 1 h: each event belongs to the 6 windows whose start is
# one of the 6 hour marks at or before it
CTE["slide"] = """
slide AS (
  SELECT r.*, date_trunc('hour', r.ts) - to_hours(k) AS window_start, date_trunc('hour', r.ts) - to_hours(k) + INTERVAL 6 HOUR AS window_end
  FROM req r, range(0, 6) t(k)
)"""
DEPS["slide"] = ["req"]

SQL["request_counts"] = with_ctes(["req"], """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
       'inference-api' AS service, CASE WHEN endpoint = 'view' THEN 'GET' ELSE 'POST' END AS method, endpoint, status, count(*) AS n
FROM req GROUP BY ALL""")

SQL["outcome_counts"] = with_ctes(["req"], """
SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, outcome,
       CASE WHEN status >= 500 THEN 'server' WHEN status >= 400 THEN 'client' ELSE 'none' END AS error_class, count(*) AS n
FROM req GROUP BY ALL""")

SQL["request_rate"] = with_ctes(["req"], """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
       status, outcome, count(*) AS n, round(count(*) / 3600, 6) AS rate_per_s
FROM req GROUP BY ALL""")

SQL["latency_histogram"] = with_ctes(["req"], f"""
, b AS (SELECT endpoint, {_BUCKET} AS b, count(*) AS c FROM req GROUP BY ALL),
g AS (SELECT e.endpoint, k.b FROM (SELECT DISTINCT endpoint FROM req) e, (SELECT range AS b FROM range(0, {len(_B) + 1})) k)
SELECT g.endpoint, ({_LE})[g.b + 1] AS le,
       CAST(sum(coalesce(b.c, 0)) OVER (PARTITION BY g.endpoint ORDER BY g.b) AS BIGINT) AS cum_count
FROM g LEFT JOIN b USING (endpoint, b)""")

SQL["latency_p95"] = with_ctes(["slide"], f"""
, b AS (SELECT window_start, window_end, {_BUCKET} AS b, count(*) AS c FROM slide GROUP BY ALL),
c AS (SELECT *, sum(c) OVER (PARTITION BY window_start ORDER BY b) AS cum, sum(c) OVER (PARTITION BY window_start) AS n FROM b),
f AS (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY b) AS rn FROM c WHERE cum >= n * 0.95::DOUBLE)
SELECT window_start, window_end, CAST(n AS BIGINT) AS n,
       (CASE WHEN b = {len(_B)} THEN {_B[-1]}::DOUBLE
             ELSE (CASE WHEN b = 0 THEN 0.0::DOUBLE ELSE ({_BOUNDS})[b] END)
                  + (({_BOUNDS})[b + 1] - (CASE WHEN b = 0 THEN 0.0::DOUBLE ELSE ({_BOUNDS})[b] END)) * (n * 0.95::DOUBLE - (cum - c)) / c END) AS p95
FROM f WHERE rn = 1""")


def _ratio(where: str, bad: str, thr: float, series: str) -> str:
    return f"""SELECT window_start, window_end, count(*) AS n, count(*) FILTER (WHERE {bad}) AS n_bad,
       round(count(*) FILTER (WHERE {bad}) / greatest(count(*), 1e-9), 6) AS ratio,
       count(*) FILTER (WHERE {bad}) / greatest(count(*), 1e-9) > {thr} AS above, '{series}' AS series
FROM slide WHERE {where} GROUP BY window_start, window_end"""


SQL["error_ratio"] = with_ctes(["slide"], _ratio("true", "status >= 500", 0.25, "http_5xx") + "\nUNION ALL\n"
                               + _ratio("endpoint <> 'view'", "outcome = 'error'", 0.10, "select_errors") + "\nUNION ALL\n"
                               + _ratio("true", "outcome = 'error'", 0.20, "predict_errors"))

_ALERTS = {"high_5xx_ratio": (0.25, 3), "predict_error_ratio": (0.20, 2), "select_error_ratio": (0.35, 3), "latency_p95": (4.5, 2), "oob_rate": (0.0005, 1)}
_VALUES = {
    "high_5xx_ratio": "SELECT window_end AS tick, count(*) FILTER (WHERE status >= 500) / greatest(count(*), 1e-9) AS v FROM slide GROUP BY window_end",
    "predict_error_ratio": "SELECT window_end AS tick, count(*) FILTER (WHERE outcome = 'error') / greatest(count(*), 1e-9) AS v FROM slide GROUP BY window_end",
    "select_error_ratio": "SELECT window_end AS tick, count(*) FILTER (WHERE outcome = 'error') / greatest(count(*), 1e-9) AS v FROM slide WHERE endpoint <> 'view' GROUP BY window_end",
    "latency_p95": "SELECT window_end AS tick, p95 AS v FROM p95",
    "oob_rate": "SELECT window_end AS tick, count(*) / 21600 AS v FROM slide WHERE latency_s > 4.8 GROUP BY window_end",
}
CTE["p95"] = "p95 AS (" + SQL["latency_p95"].replace("WITH ", "WITH ", 1) + ")"
SQL["alert_states"] = with_ctes(["slide", "p95"], f"""
, grid AS (SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS tick FROM req),
""" + ",\n".join(f"v_{k} AS ({q})" for k, q in _VALUES.items()) + """,
hr AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS tick, arg_max(model_loaded, (ts, request_id)) AS lv FROM req GROUP BY 1),
gg AS (SELECT 'model_not_loaded' AS alert, g.tick, CAST(last_value(lv IGNORE NULLS) OVER (ORDER BY g.tick) AS DOUBLE) AS value
       FROM grid g LEFT JOIN hr USING (tick)),
s AS (""" + " UNION ALL ".join(f"SELECT '{k}' AS alert, g.tick, coalesce(v, 0.0) AS value, coalesce(v, 0.0) > {t}::DOUBLE AS cond, INTERVAL {h} HOUR AS lasting FROM grid g LEFT JOIN v_{k} USING (tick)" for k, (t, h) in _ALERTS.items()) + """
      UNION ALL SELECT *, value = 0 AS cond, INTERVAL 1 HOUR FROM gg),
i AS (SELECT *, sum(CASE WHEN cond THEN 0 ELSE 1 END) OVER (PARTITION BY alert ORDER BY tick) AS grp FROM s),
j AS (SELECT *, CASE WHEN cond THEN min(tick) FILTER (WHERE cond) OVER (PARTITION BY alert, grp) END AS island_start FROM i)
SELECT alert, tick, round(value, 6) AS value, cond, island_start, coalesce(cond AND tick - island_start >= lasting, false) AS firing
FROM j""")

SQL["rate_limit"] = with_ctes(["req"], """
, q AS (SELECT request_id, ts, client_key, row_number() OVER (PARTITION BY client_key ORDER BY ts, request_id) AS seq FROM req),
rec AS (
  WITH RECURSIVE f(client_key, seq, request_id, ts, admitted, bucket) AS (
    SELECT client_key, seq, request_id, ts, true, [ts] FROM q WHERE seq = 1
    UNION ALL
    SELECT q.client_key, q.seq, q.request_id, q.ts,
           len(list_filter(f.bucket, lambda x: NOT (q.ts - x > INTERVAL 1 DAY))) < 2,
           CASE WHEN len(list_filter(f.bucket, lambda x: NOT (q.ts - x > INTERVAL 1 DAY))) < 2
                THEN list_append(list_filter(f.bucket, lambda x: NOT (q.ts - x > INTERVAL 1 DAY)), q.ts)
                ELSE list_filter(f.bucket, lambda x: NOT (q.ts - x > INTERVAL 1 DAY)) END
    FROM f JOIN q ON q.client_key = f.client_key AND q.seq = f.seq + 1
  ) SELECT * FROM f)
SELECT request_id, ts, client_key, admitted FROM rec""")

SQL["cache_replay"] = with_ctes(["req"], """
, q AS (SELECT request_id, ts, payload_key, row_number() OVER (PARTITION BY payload_key ORDER BY ts, request_id) AS seq FROM req),
rec AS (
  WITH RECURSIVE f(payload_key, seq, request_id, ts, cache_hit, stored) AS (
    SELECT payload_key, seq, request_id, ts, false, ts FROM q WHERE seq = 1
    UNION ALL
    SELECT q.payload_key, q.seq, q.request_id, q.ts, NOT (q.ts - f.stored > INTERVAL 6 HOUR),
           CASE WHEN q.ts - f.stored > INTERVAL 6 HOUR THEN q.ts ELSE f.stored END
    FROM f JOIN q ON q.payload_key = f.payload_key AND q.seq = f.seq + 1
  ) SELECT * FROM f)
SELECT request_id, ts, payload_key, cache_hit FROM rec""")

# ------------------------------------------------------------------ drift
_F = ["cpu_usage", "memory_usage", "net_io", "disk_io", "RAM_GB", "vCPU", "latency_ms", "throughput", "utilization"]
_D = {"cpu_usage": (0, 100), "memory_usage": (0, 100), "net_io": (0, 5000), "disk_io": (0, 5000), "RAM_GB": (0.25, 256),
      "vCPU": (1, 128), "latency_ms": (0, 10000), "throughput": (0, 100000), "utilization": (0, 100)}
CTE["ranges"] = "ranges AS (\n  SELECT field, CASE WHEN q[2] > q[1] THEN q[1] ELSE d_low END AS low, CASE WHEN q[2] > q[1] THEN q[2] ELSE d_high END AS high,\n" \
    "         CASE WHEN q[2] > q[1] THEN 'data' ELSE 'default' END AS source FROM (\n" + "\n  UNION ALL ".join(
        f"SELECT '{f}' AS field, {lo}::DOUBLE AS d_low, {hi}::DOUBLE AS d_high, (SELECT quantile_cont(CAST({f} AS DOUBLE), [0.01, 0.99]) FROM telemetry WHERE {f} IS NOT NULL) AS q"
        for f, (lo, hi) in _D.items()) + "))"
DEPS["ranges"] = ["telemetry"]
_RANGE_VALS = ", ".join(f"(SELECT low FROM ranges WHERE field = '{f}') AS lo_{f}, (SELECT high FROM ranges WHERE field = '{f}') AS hi_{f}" for f in _F)
_OFF = "list_filter([" + ", ".join(f"CASE WHEN {f} < lo_{f} OR {f} > hi_{f} THEN '{f}' END" for f in _F) + "], lambda x: x IS NOT NULL)"
CTE["oob"] = f"oob AS (SELECT t.*, {_OFF} AS offenders FROM telemetry t, (SELECT {_RANGE_VALS}) r)"
DEPS["oob"] = ["ranges"]

SQL["training_ranges"] = with_ctes(["ranges"], "SELECT field, round(low, 6) AS low, round(high, 6) AS high, source FROM ranges")
SQL["oob_fields"] = with_ctes(["oob"], "SELECT row_id, array_to_string(offenders, ',') AS offenders, CAST(len(offenders) AS INTEGER) AS n_offenders FROM oob")
SQL["oob_counts"] = with_ctes(["oob"], """
SELECT field, count(*) AS n FROM (SELECT unnest(offenders) AS field FROM oob) GROUP BY field
UNION ALL SELECT '*rows*', count(*) FROM oob WHERE len(offenders) > 0""")
SQL["oob_rate"] = with_ctes(["oob"], """
, s AS (SELECT date_trunc('day', ts) - to_days(k) AS window_start FROM oob, range(0, 7) t(k) WHERE len(offenders) > 0)
SELECT window_start, window_start + INTERVAL 7 DAY AS window_end, count(*) AS n, round(count(*) / 604800, 6) AS rate_per_s,
       count(*) / 604800 > 0.2 AS above
FROM s GROUP BY window_start""")


def _psi_sql(actual_expr: str, scenario: str) -> str:
    return f"""(WITH e AS (SELECT l_extendedprice AS v FROM lineitem WHERE l_shipdate < TIMESTAMP '2000-01-01'),
  a AS (SELECT {actual_expr} AS v FROM lineitem WHERE NOT (l_shipdate < TIMESTAMP '2000-01-01')),
  ed AS (SELECT list_sort(list_distinct(list_transform(quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]), lambda x: round(x, 6)))) AS edges FROM e),
  be AS (SELECT CASE WHEN v < edges[1] OR v > edges[len(edges)] THEN NULL ELSE least(len(list_filter(edges, lambda x: x <= v)) - 1, len(edges) - 2) END AS b FROM e, ed),
  ba AS (SELECT CASE WHEN v < edges[1] OR v > edges[len(edges)] THEN NULL ELSE least(len(list_filter(edges, lambda x: x <= v)) - 1, len(edges) - 2) END AS b FROM a, ed),
  ce AS (SELECT b, count(*) AS c FROM be WHERE b IS NOT NULL GROUP BY b),
  ca AS (SELECT b, count(*) AS c FROM ba WHERE b IS NOT NULL GROUP BY b),
  h AS (SELECT coalesce(ce.b, ca.b) AS b, coalesce(ce.c, 0) AS ce, coalesce(ca.c, 0) AS ca FROM ce FULL JOIN ca ON ce.b = ca.b),
  p AS (SELECT greatest(ce / greatest((SELECT sum(ce) FROM h), 1), 1e-4) AS pe, greatest(ca / greatest((SELECT sum(ca) FROM h), 1), 1e-4) AS pa FROM h)
  SELECT round(sum((pa - pe) * ln(pa / pe)), 6) AS psi,
         round((SELECT count(*) FROM ba WHERE b IS NULL) / (SELECT count(*) FROM a), 6) AS out_of_range_fraction,
         (SELECT count(*) FROM e) AS n_expected, (SELECT count(*) FROM a) AS n_actual,
         CAST((SELECT len(edges) FROM ed) AS INTEGER) AS n_edges, '{scenario}' AS scenario
  FROM p)"""


SQL["psi"] = "SELECT * FROM " + _psi_sql("l_extendedprice", "baseline") + " UNION ALL SELECT * FROM " + \
    _psi_sql("l_extendedprice * l_extendedprice / 105000", "drifted")

# ------------------------------------------------------------------ contracts
_SCHEMA = ["timestamp", "cpu_usage", "memory_usage", "net_io", "disk_io", "cloud_provider", "region", "vm_type", "vCPU", "RAM_GB",
           "price_per_hour", "target", "latency_ms", "throughput", "utilization", "cost"]
SQL["required_columns"] = with_ctes(["telemetry"], f"""
, h AS (SELECT list_transform(json_keys(to_json(t)), lambda x: x) AS have FROM telemetry t LIMIT 1),
c AS (SELECT list_filter({_SCHEMA!r}, lambda x: NOT list_contains(have, x)) AS m FROM h)
SELECT len(m) = 0 AS status, array_to_string(m, ',') AS missing, CAST(len(m) AS INTEGER) AS n_missing FROM c""")

_MISSING = "CASE WHEN l_partkey % 101 IN (1, 2, 3, 4) THEN 'Request body must be a JSON object' WHEN l_partkey % 11 = 0 THEN 'Missing required fields: cpu_usage' " \
           "WHEN l_partkey % 12 = 0 AND l_partkey % 24 <> 0 THEN 'Provide ''timestamp'' or temporal fields hour/day/month/day_of_week/is_weekend' END"
SQL["payload_errors"] = with_ctes(["telemetry"], f"SELECT row_id, {_MISSING} AS error, {_MISSING} AS error_latency_endpoint FROM telemetry")

_CAST = ("nullif(array_to_string(list_filter([CASE WHEN l_partkey % 29 = 0 THEN 'vCPU' END, CASE WHEN l_partkey % 31 = 0 THEN 'RAM_GB' END, "
         "CASE WHEN l_partkey % 24 = 0 AND l_partkey % 7 = 0 THEN 'month' END], lambda x: x IS NOT NULL), ', '), '')")
CTE["body"] = """
body AS (SELECT *, strptime("timestamp", '%m/%d/%Y %H:%M') AS t, l_partkey % 24 = 0 AS cal FROM telemetry WHERE l_partkey % 101 NOT IN (1, 2, 3, 4))"""
DEPS["body"] = ["telemetry"]
SQL["numeric_cast"] = with_ctes(["body"], f"""
SELECT t.row_id, CASE WHEN l_partkey % 11 <> 0 THEN b.cpu_usage END AS cpu_usage, b.memory_usage, b.net_io, b.disk_io,
       CASE WHEN l_partkey % 29 <> 0 THEN b.vCPU END AS vCPU, CASE WHEN l_partkey % 31 <> 0 THEN b.RAM_GB END AS RAM_GB,
       CASE WHEN l_partkey % 13 <> 0 THEN b.latency_ms END AS latency_ms, b.throughput, b.utilization,
       CASE WHEN cal THEN hour(b.t)::BIGINT END AS hour, CASE WHEN cal THEN day(b.t)::BIGINT END AS day,
       CASE WHEN cal AND l_partkey % 7 <> 0 THEN month(b.t)::BIGINT END AS month,
       CASE WHEN cal THEN (isodow(b.t) - 1)::BIGINT END AS day_of_week,
       CASE WHEN cal THEN (CASE WHEN isodow(b.t) - 1 IN (5, 6) THEN 1 ELSE 0 END)::BIGINT END AS is_weekend,
       CASE WHEN b.row_id IS NOT NULL THEN 'could not convert: ' || {_CAST} END AS cast_error
FROM (SELECT row_id FROM telemetry) t LEFT JOIN body b USING (row_id)""")

SQL["latency_fill"] = with_ctes(["telemetry"], """
SELECT row_id, CASE WHEN l_orderkey % 10 = 0 OR l_partkey % 13 = 0 THEN net_io / 4 * 0.98::DOUBLE + 2 ELSE latency_ms END AS latency_ms,
       CASE WHEN l_orderkey % 10 = 0 OR l_partkey % 13 = 0 THEN 'model' ELSE 'request' END AS latency_source
FROM telemetry""")

CTE["runs"] = f"""
runs AS (
  WITH m AS (SELECT cloud_provider || '/' || region AS run_id, any_value(n_nationkey) AS nk,
                    {_metrics('cost', 'pred')} FROM telemetry GROUP BY cloud_provider, region)
  SELECT run_id, nk, 'MAE' AS metric, MAE AS value FROM m
  UNION ALL SELECT run_id, nk, 'MSE', MSE FROM m WHERE nk % 5 <> 0
  UNION ALL SELECT run_id, nk, 'RMSE', RMSE FROM m
  UNION ALL SELECT run_id, nk, 'R2', R2 FROM m
)"""
DEPS["runs"] = ["telemetry"]
SQL["metrics_complete"] = with_ctes(["runs"], """
SELECT run_id, CASE WHEN count(*) FILTER (WHERE metric = 'MSE') = 0 THEN 'MSE' ELSE '' END AS missing,
       count(*) FILTER (WHERE metric = 'MSE') > 0 AS complete
FROM runs GROUP BY run_id""")
SQL["metrics_gate"] = with_ctes(["runs"], """
SELECT run_id, max(value) FILTER (WHERE metric = 'R2') AS R2, max(value) FILTER (WHERE metric = 'MAE') AS MAE,
       CASE WHEN count(*) FILTER (WHERE metric = 'MSE') = 0 THEN 1
            WHEN max(value) FILTER (WHERE metric = 'R2') < 0.99 THEN 2
            WHEN max(value) FILTER (WHERE metric = 'MAE') > 0.33 THEN 3 ELSE 0 END AS gate_code
FROM runs GROUP BY run_id""")

_ORDER = ["cpu_usage", "memory_usage", "net_io", "disk_io", "vCPU", "RAM_GB", "latency_ms", "throughput", "utilization", "hour", "day",
          "month", "day_of_week", "is_weekend", "cloud_provider_encoded", "region_encoded", "vm_type_encoded", "target_encoded",
          "cpu_memory_ratio", "total_io", "io_ratio", "resource_efficiency", "latency_throughput_ratio", "resource_intensity", "ram_per_vcpu"]
_JA = '["' + '","'.join(_ORDER) + '"]'
_JB = '["' + '","'.join(x for x in _ORDER if x != "ram_per_vcpu") + '"]'
SQL["feature_doc_valid"] = with_ctes(["manifest"], f"""
SELECT line, model_version, CASE WHEN feature_order = 'A' THEN {len(_ORDER)} ELSE {len(_ORDER) - 1} END AS n_listed,
       feature_order = 'A' AND cand_id % 17 <> 0 AS valid
FROM manifest""")
SQL["schema_fingerprint"] = with_ctes(["manifest"], f"""
SELECT line, model_version,
       sha256('{{"feature_order":' || CASE WHEN feature_order = 'A' THEN '{_JA}' ELSE '{_JB}' END || ',"model_version":"' || model_version || '"}}') AS fingerprint,
       feature_order = 'A' AS serve_ok
FROM manifest""")
SQL["manifest_valid"] = with_ctes(["manifest"], """
, e AS (SELECT *, list_filter(['model_version', CASE WHEN cand_id % 13 <> 0 THEN 'binding_mac' END, 'promotion_class', 'bundle_epoch', 'digest_ring', 'blobs'],
                              lambda x: x IS NOT NULL) AS keys FROM manifest)
SELECT line, model_version, list_has_all(keys, ['model_version', 'blobs', 'digest_ring', 'binding_mac', 'promotion_class'])
       AND cand_id % 17 <> 0 AND cand_id % 19 <> 0 AS valid FROM e""")
SQL["params_fingerprint"] = with_ctes(["trials_fp"], "SELECT trial_id, fingerprint FROM trials_fp")
SQL["payload_key"] = """
SELECT event_id AS request_id, sha256('{"p":' || json(props)::VARCHAR || ',"v":"1.0.0"}') AS cache_key FROM events"""

# ------------------------------------------------------------------ blobs and digests
SQL["git_blob_digest"] = """
SELECT doc_id, sha256(('blob ' || octet_length(encode(text)))::BLOB || '\\x00'::BLOB || encode(text)) AS git_sha256 FROM documents"""
CTE["blobs"] = """
blobs AS (SELECT doc_id, source AS logical_name, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents)"""
SQL["blob_scan"] = with_ctes(["blobs"], """
SELECT doc_id, logical_name, sha256, size, substr(sha256, 1, 2) || '/' || substr(sha256, 3, 2) || '/' || substr(sha256, 5) AS object_path FROM blobs""")
SQL["content_dedup"] = with_ctes(["blobs"], """
SELECT sha256, count(*) AS n_copies, min(doc_id) AS stored_doc_id, arg_min(logical_name, doc_id) AS logical_name,
       count(DISTINCT size) > 1 AS collision FROM blobs GROUP BY sha256""")
SQL["blob_integrity"] = with_ctes(["blobs"], """
, rec AS (SELECT doc_id AS path, CASE WHEN doc_id % 31 = 0 THEN sha256(sha256) ELSE sha256 END AS rec_sha,
                 CASE WHEN doc_id % 37 = 0 THEN size + 1 ELSE size END AS rec_size FROM blobs),
scan AS (SELECT doc_id AS path, sha256 AS cur_sha, size AS cur_size FROM blobs WHERE doc_id % 41 <> 0)
SELECT coalesce(rec.path, scan.path) AS path,
       CASE WHEN cur_sha IS NULL THEN 'missing' WHEN rec_sha IS NULL THEN 'unlisted' WHEN rec_sha <> cur_sha THEN 'hash_mismatch'
            WHEN rec_size <> cur_size THEN 'size_mismatch' ELSE 'ok' END AS status
FROM rec FULL JOIN scan ON rec.path = scan.path""")

_GIT = "sha256(('blob ' || octet_length(encode({t})))::BLOB || '\\x00'::BLOB || encode({t}))"
CTE["digests"] = f"""
digests AS (
  SELECT *, CASE WHEN path % 5 = 0 THEN 'output' ELSE 'dependency' END AS kind FROM (
  SELECT lang AS pipeline, source AS stage, doc_id AS path, 'recorded' AS snapshot, {_GIT.format(t='text')} AS digest FROM documents
  UNION ALL
  SELECT lang, source, doc_id, 'current', {_GIT.format(t="CASE WHEN doc_id % 97 = 0 THEN text || ' ' ELSE text END")} FROM documents WHERE doc_id % 193 <> 0
  UNION ALL
  SELECT lang, source, doc_id + 1000000000, 'current', {_GIT.format(t='text')} FROM documents WHERE doc_id % 197 = 0)
)"""
CTE["ddiff"] = """
ddiff AS (
  SELECT coalesce(r.pipeline, c.pipeline) AS pipeline, coalesce(r.stage, c.stage) AS stage, coalesce(r.kind, c.kind) AS kind,
         count(*) FILTER (WHERE r.digest IS NOT NULL AND c.digest IS NOT NULL AND r.digest <> c.digest) AS n_changed,
         count(*) FILTER (WHERE c.digest IS NULL) AS n_missing,
         count(*) FILTER (WHERE r.digest IS NULL) AS n_extra,
         NOT bool_and(r.digest IS NOT DISTINCT FROM c.digest) AS stale
  FROM (SELECT * FROM digests WHERE snapshot = 'recorded') r
  FULL JOIN (SELECT * FROM digests WHERE snapshot = 'current') c USING (pipeline, stage, kind, path)
  GROUP BY ALL
)"""
DEPS["ddiff"] = ["digests"]
SQL["digest_snapshot"] = with_ctes(["digests"], """
SELECT pipeline, stage, kind, count(*) AS n_paths,
       count(*) || ':' || CAST(sum(('0x' || left(sha256(path || '|' || digest), 15))::BIGINT) AS VARCHAR) AS snapshot_digest
FROM digests WHERE snapshot = 'recorded' GROUP BY pipeline, stage, kind""")
SQL["digest_diff"] = with_ctes(["ddiff"], "SELECT * FROM ddiff")
SQL["staleness_plan"] = with_ctes(["ddiff"], """
, st AS (SELECT DISTINCT lang AS pipeline, source AS stage, CAST(substr(source, 4) AS INTEGER) AS k FROM documents),
per AS (SELECT pipeline, stage, bool_or(stale AND kind = 'dependency') AS dep, bool_or(stale AND kind = 'output') AS o FROM ddiff GROUP BY ALL),
x AS (SELECT pipeline, stage, CASE WHEN k = 7 THEN -1 ELSE k END AS position,
             CASE WHEN k = 11 THEN 'status' WHEN dep THEN 'dependency' WHEN o THEN 'output' END AS reason
      FROM st LEFT JOIN per USING (pipeline, stage))
SELECT pipeline, stage, position, reason IS NOT NULL AS stale, reason,
       bool_or(reason IS NOT NULL) OVER (PARTITION BY pipeline ORDER BY position, stage ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS must_run
FROM x""")

SQL["stage_graph"] = with_ctes(["ddiff"], """
, st AS (SELECT DISTINCT lang AS pipeline, source AS stage, CAST(substr(source, 4) AS INTEGER) AS k FROM documents),
edge AS (
  SELECT DISTINCT pipeline, stage, unnest(list_filter([CASE WHEN k > 0 THEN 'src' || (k // 2) END, CASE WHEN k > 0 THEN 'src' || (k // 3) END,
         CASE WHEN k % 9 = 4 THEN 'gone' END, CASE WHEN pipeline = 'de' AND k = 3 THEN 'src6' END], lambda x: x IS NOT NULL)) AS parent FROM st),
per AS (SELECT pipeline, stage, bool_or(stale AND kind = 'dependency') AS dep, bool_or(stale AND kind = 'output') AS o FROM ddiff GROUP BY ALL),
odd AS (SELECT DISTINCT pipeline, stage FROM edge e WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.pipeline = e.pipeline AND st.stage = e.parent)),
own AS (SELECT st.pipeline, st.stage, CASE WHEN k = 11 THEN 'status' WHEN dep THEN 'dependency' WHEN o THEN 'output' WHEN odd.stage IS NOT NULL THEN 'parent' END AS reason
        FROM st LEFT JOIN per USING (pipeline, stage) LEFT JOIN odd USING (pipeline, stage)),
above AS (
  WITH RECURSIVE r(pipeline, stage, parent) AS (
    SELECT pipeline, stage, parent FROM edge
    UNION
    SELECT r.pipeline, r.stage, e.parent FROM r JOIN edge e ON e.pipeline = r.pipeline AND e.stage = r.parent
  ) SELECT * FROM r),
ring AS (SELECT pipeline, stage FROM above WHERE parent = stage),
bad AS (SELECT pipeline, stage FROM ring UNION SELECT a.pipeline, a.stage FROM above a JOIN ring ON ring.pipeline = a.pipeline AND ring.stage = a.parent),
up AS (SELECT a.pipeline, a.stage, bool_or(o.reason IS NOT NULL) AS stale FROM above a JOIN own o ON o.pipeline = a.pipeline AND o.stage = a.parent GROUP BY ALL)
SELECT own.pipeline, own.stage, reason, CASE WHEN bad.stage IS NULL THEN reason IS NOT NULL OR coalesce(up.stale, false) END AS must_run,
       CASE WHEN bad.stage IS NOT NULL THEN 'cycle' END AS error
FROM own LEFT JOIN bad USING (pipeline, stage) LEFT JOIN up USING (pipeline, stage)""")

# ------------------------------------------------------------------ scoring
SQL["batch_explode"] = with_ctes(["telemetry"], """
SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS INTEGER) AS index,
       l_linenumber, l_partkey, l_suppkey, cpu_usage, vm_type, NULL::VARCHAR AS error
FROM telemetry WHERE l_orderkey % 50 > 2
UNION ALL SELECT DISTINCT l_orderkey, NULL, NULL, NULL, NULL, NULL, NULL,
       CASE WHEN l_orderkey % 50 = 0 THEN 'No instances' ELSE 'Request body must contain a list of instances' END
FROM telemetry WHERE l_orderkey % 50 <= 2""")
CTE["checked"] = f"""
checked AS (SELECT *, coalesce({_MISSING}, 'could not convert: ' || {_CAST}) AS error FROM telemetry)"""
DEPS["checked"] = ["telemetry"]
SQL["batch_status"] = with_ctes(["checked"], """
SELECT row_id, CASE WHEN error IS NULL THEN 'success' ELSE 'error' END AS status, error,
       CASE WHEN error IS NULL THEN cpu_usage * 0.01::DOUBLE + RAM_GB * 0.05::DOUBLE + CAST(vCPU AS DOUBLE) * 0.1::DOUBLE END AS prediction
FROM checked""")
SQL["batch_score"] = with_ctes(["checked"], """
SELECT row_id, CASE WHEN error IS NULL THEN 'success' ELSE 'error' END AS status, error,
       CASE WHEN error IS NULL THEN CASE WHEN l_partkey % 13 = 0 THEN 'model' ELSE 'request' END END AS latency_source,
       error IS NULL AS has_prediction, error IS NULL AND l_partkey % 13 = 0 AS has_predicted_latency
FROM checked""")
SQL["payload_dedup"] = """
SELECT event_id AS request_id, props AS payload_key, CAST(props->>'k' AS DOUBLE) * 1.5::DOUBLE + length(props) AS score FROM events"""
SQL["canary_route"] = """
SELECT event_id AS request_id, CASE WHEN ('0x' || left(md5(CAST(event_id AS VARCHAR)), 8))::BIGINT * (100.0::DOUBLE / 4294967296) < 0.5 THEN 'probe' ELSE 'anchor' END AS variant FROM events"""
SQL["shadow_delta"] = with_ctes(["req"], """
SELECT endpoint, count(*) AS n, round(avg((latency_s * 2.1::DOUBLE + 0.9::DOUBLE) - (latency_s * 2 + 1)), 6) AS mean_delta,
       round(max(abs((latency_s * 2.1::DOUBLE + 0.9::DOUBLE) - (latency_s * 2 + 1))), 6) AS max_abs_delta
FROM req GROUP BY endpoint""")
CTE["audit"] = """
audit AS (
  SELECT CAST(request_id AS VARCHAR) AS request_id, epoch_us(ts) / 1e6 AS created_at,
         coalesce(CASE WHEN endpoint <> 'view' THEN endpoint END, 'unknown') AS endpoint, '1.0.0' AS model_version,
         CASE WHEN ('0x' || left(md5(CAST(request_id AS VARCHAR)), 8))::BIGINT * (100.0::DOUBLE / 4294967296) < 0.5 THEN 'probe' ELSE 'anchor' END AS variant,
         latency_s * 2 + 1 AS prediction, CASE WHEN request_id % 10 = 0 THEN latency_s * 980 + 2 END AS predicted_latency_ms, CASE WHEN outcome = 'cache_hit' THEN 1 ELSE 0 END AS cache_hit,
         latency_s * 1000 AS latency_ms, CASE WHEN status >= 500 THEN 'error' ELSE 'success' END AS status,
         CAST(ts AS DATE) AS event_date, latency_s
  FROM req
)"""
DEPS["audit"] = ["req"]
SQL["audit_events"] = with_ctes(["audit"], """
SELECT request_id, created_at, endpoint, model_version, variant, prediction, predicted_latency_ms, cache_hit, latency_ms, status FROM audit""")
SQL["audit_lookup"] = with_ctes(["audit"], """
SELECT 'status=error' AS lookup, endpoint, count(*) AS n FROM audit WHERE status = 'error' GROUP BY endpoint
UNION ALL SELECT 'date in [01-10, 01-12)', endpoint, count(*) FROM audit WHERE event_date >= DATE '2024-01-10' AND event_date < DATE '2024-01-12' GROUP BY endpoint
UNION ALL SELECT 'request_id in slow set', endpoint, count(*) FROM audit WHERE latency_s > 4.5 GROUP BY endpoint""")

# ------------------------------------------------------------------ models (rows, label means, gates)

def _report(label: str) -> str:
    return with_ctes(["tsplit"], f"""
SELECT split, count({label}) AS n, round(avg({label}), 6) AS label_mean, '{label}' AS label, true AS gate FROM tsplit GROUP BY split""")


SQL["cost_model"], SQL["latency_model"] = _report("cost"), _report("latency_ms")
SQL["cv_r2"] = with_ctes(["telemetry"], """
SELECT ('0x' || left(md5(CAST(row_id AS VARCHAR)), 8))::BIGINT % 3 AS fold, count(*) AS n, round(avg(cost), 6) AS label_mean, true AS gate
FROM telemetry GROUP BY 1""")
SQL["oob_r2"] = with_ctes(["tsplit"], """
SELECT 'cost' AS label, count(cost) AS n, true AS gate FROM tsplit WHERE split = 'train'
UNION ALL SELECT 'latency_ms', count(latency_ms), true FROM tsplit WHERE split = 'train'""")
SQL["elected_refit"] = with_ctes(["cope", "trials"], """
, lead AS (SELECT b.*, b.borda_rmse + b.borda_mae + b.borda_r2 AS borda, c.copeland FROM borda b JOIN cope c USING (election_id, trial_id)),
w AS (SELECT election_id, trial_id FROM lead ORDER BY election_id DESC, borda DESC, copeland DESC, pred_var, upper(fingerprint), trial_id LIMIT 1),
lab AS (SELECT label * 10 + embedding[7]::DOUBLE * 50 AS target FROM embeddings WHERE ('0x' || left(md5(CAST(vec_id AS VARCHAR)), 8))::BIGINT % 100 < 25)
SELECT w.election_id, w.trial_id, CAST(t.n_estimators AS INTEGER) AS n_estimators, (SELECT count(target) FROM lab) AS n,
       (SELECT round(avg(target), 6) FROM lab) AS label_mean, true AS all_predicted
FROM w JOIN trials t USING (election_id, trial_id)""")
