"""DuckDB oracle SQL, one statement per registered query.

Written independently of the Spark code, straight from the adapter rules in
FIXTURES.md, over the pre-registered driver tables.  Doubles from
aggregates are rounded to 6 places on both sides.
"""

from __future__ import annotations

CTE: dict[str, str] = {}

CTE["telemetry"] = """
telemetry AS (
  SELECT concat_ws('|', l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey,
                   CAST(round(l.l_extendedprice * 100) AS BIGINT), strftime(l.l_shipdate, '%Y%m%d')) AS row_id,
         l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice, l.l_shipdate,
         n.n_nationkey,
         l.l_shipdate + to_hours(3 * l.l_linenumber) AS ts,
         strftime(l.l_shipdate + to_hours(3 * l.l_linenumber), '%-m/%-d/%Y %-H:%M') AS "timestamp",
         l.l_quantity * 2 AS cpu_usage,
         l.l_discount * 1000 AS memory_usage,
         l.l_extendedprice / 25 AS net_io,
         p.p_retailprice AS disk_io,
         r.r_name AS cloud_provider, n.n_name AS region, p.p_type AS vm_type, l.l_returnflag AS target,
         CAST(p.p_size AS BIGINT) AS vCPU,
         CAST(p.p_size * 2 AS DOUBLE) AS RAM_GB,
         p.p_retailprice / 1000 AS price_per_hour,
         l.l_extendedprice / 100 AS latency_ms,
         CAST(l.l_partkey + 100 AS DOUBLE) AS throughput,
         l.l_tax * 1000 AS utilization,
         l.l_extendedprice * (1 - l.l_discount) / 10000 AS cost,
         l.l_extendedprice * (1 - l.l_discount) / 10000 * 0.9::DOUBLE + CAST(p.p_size AS BIGINT) / 100 AS pred
  FROM lineitem l
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

# temporal split: first floor(0.8 n) rows in (ts, row key) order are train
CTE["tsplit"] = """
tsplit AS (
  SELECT *, CASE WHEN row_number() OVER (ORDER BY ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)
                      <= floor(count(*) OVER () * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split
  FROM telemetry
)"""

CTE["hsplit"] = """
hsplit AS (
  SELECT *, CASE WHEN ('0x' || left(md5(row_id), 8))::BIGINT % 100 < 20 THEN 'test' ELSE 'train' END AS split
  FROM telemetry
)"""

CTE["cats"] = """
cats AS (
  SELECT 'cloud_provider' AS "column", cloud_provider AS value FROM telemetry
  UNION ALL SELECT 'region', region FROM telemetry
  UNION ALL SELECT 'vm_type', vm_type FROM telemetry
  UNION ALL SELECT 'target', target FROM telemetry
)"""

CTE["dict"] = """
dict AS (
  SELECT "column", value, CAST(row_number() OVER (PARTITION BY "column" ORDER BY value) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT "column", value FROM cats WHERE value IS NOT NULL)
)"""

DEPS = {"tsplit": ["telemetry"], "hsplit": ["telemetry"], "cats": ["telemetry"], "dict": ["cats"]}


def with_ctes(names: list[str], body: str) -> str:
    order: list[str] = []

    def add(n: str) -> None:
        for d in DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(CTE[n] for n in order) + "\n" + body


def _metrics(y: str, p: str, prefix: str = "", digits: bool = True) -> str:
    r = (lambda e: f"round({e}, 6)") if digits else (lambda e: e)
    y, p = f"({y})", f"({p})"
    n = f"count({y})"
    sse = f"sum(({y} - {p}) * ({y} - {p}))"
    sst = f"(var_pop({y}) * count({y}))"
    r2 = (f"CASE WHEN {n} < 2 THEN 'nan'::DOUBLE WHEN {sst} = 0 THEN (CASE WHEN {sse} = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) "
          f"ELSE 1 - {sse} / {sst} END")
    return (f"{n} AS {prefix}n, {r(f'avg(abs({y} - {p}))')} AS {prefix}MAE, {r(f'avg(({y} - {p}) * ({y} - {p}))')} AS {prefix}MSE, "
            f"{r(f'sqrt(avg(({y} - {p}) * ({y} - {p})))')} AS {prefix}RMSE, {r(r2)} AS {prefix}R2")


SQL: dict[str, str] = {}

SQL["flagship_metrics"] = with_ctes(["tsplit"], f"""
, m AS (SELECT avg(cost) AS mu FROM tsplit WHERE split = 'train')
SELECT split, {_metrics('cost', 'pred')},
       round(avg(abs(cost - mu)), 6) AS baseline_MAE,
       round(avg(abs(cost - mu)) - avg(abs(cost - pred)), 6) AS lift_MAE
FROM tsplit, m GROUP BY split""")

SQL["temporal_features"] = with_ctes(["telemetry"], """
, p AS (SELECT row_id, strptime("timestamp", '%m/%d/%Y %H:%M') AS t FROM telemetry)
SELECT row_id, CAST(hour(t) AS INTEGER) AS hour, CAST(day(t) AS INTEGER) AS day, CAST(month(t) AS INTEGER) AS month,
       CAST(isodow(t) - 1 AS INTEGER) AS day_of_week, CASE WHEN isodow(t) - 1 IN (5, 6) THEN 1 ELSE 0 END AS is_weekend
FROM p""")

SQL["ratio_features"] = with_ctes(["telemetry"], """
SELECT row_id,
       cpu_usage / nullif(memory_usage + 1, 0) AS cpu_memory_ratio,
       net_io + disk_io AS total_io,
       net_io / nullif(disk_io + 1, 0) AS io_ratio,
       throughput / nullif(cpu_usage + memory_usage + 1, 0) AS resource_efficiency,
       latency_ms / nullif(throughput + 1, 0) AS latency_throughput_ratio,
       cpu_usage * memory_usage * utilization AS resource_intensity,
       RAM_GB / nullif(vCPU, 0) AS ram_per_vcpu
FROM telemetry""")

SQL["encoder_fit"] = with_ctes(["dict"], 'SELECT "column", value, code FROM dict')

SQL["encoder_apply"] = with_ctes(["dict"], """
SELECT t.row_id,
  coalesce((SELECT code FROM dict d WHERE d."column" = 'cloud_provider' AND d.value = t.cloud_provider), 0) AS cloud_provider_encoded,
  coalesce((SELECT code FROM dict d WHERE d."column" = 'region' AND d.value = t.region), 0) AS region_encoded,
  coalesce((SELECT code FROM dict d WHERE d."column" = 'vm_type' AND d.value = t.vm_type), 0) AS vm_type_encoded,
  coalesce((SELECT code FROM dict d WHERE d."column" = 'target' AND d.value = t.target), 0) AS target_encoded
FROM telemetry t""")

SQL["encoder_unknowns"] = with_ctes(["cats", "telemetry"], """
, fitc AS (
  SELECT 'cloud_provider' AS "column", cloud_provider AS value FROM telemetry WHERE ts < TIMESTAMP '1999-01-01' AND vm_type <> 'PROMO'
  UNION ALL SELECT 'region', region FROM telemetry WHERE ts < TIMESTAMP '1999-01-01' AND vm_type <> 'PROMO'
  UNION ALL SELECT 'vm_type', vm_type FROM telemetry WHERE ts < TIMESTAMP '1999-01-01' AND vm_type <> 'PROMO'
  UNION ALL SELECT 'target', target FROM telemetry WHERE ts < TIMESTAMP '1999-01-01' AND vm_type <> 'PROMO'
)
SELECT c."column", count(*) AS unknown_rows, count(DISTINCT c.value) AS unknown_values
FROM cats c WHERE NOT EXISTS (SELECT 1 FROM fitc f WHERE f."column" = c."column" AND f.value = c.value)
GROUP BY c."column\"""")

SQL["feature_matrix"] = with_ctes(["dict"], """
, p AS (SELECT *, strptime("timestamp", '%m/%d/%Y %H:%M') AS t FROM telemetry)
SELECT row_id, cpu_usage, memory_usage, net_io, disk_io, vCPU, RAM_GB, latency_ms, throughput, utilization,
       CAST(hour(t) AS INTEGER) AS hour, CAST(day(t) AS INTEGER) AS day, CAST(month(t) AS INTEGER) AS month,
       CAST(isodow(t) - 1 AS INTEGER) AS day_of_week,
       CASE WHEN isodow(t) - 1 IN (5, 6) THEN 1 ELSE 0 END AS is_weekend,
       coalesce((SELECT code FROM dict d WHERE d."column" = 'cloud_provider' AND d.value = p.cloud_provider), 0) AS cloud_provider_encoded,
       coalesce((SELECT code FROM dict d WHERE d."column" = 'region' AND d.value = p.region), 0) AS region_encoded,
       coalesce((SELECT code FROM dict d WHERE d."column" = 'vm_type' AND d.value = p.vm_type), 0) AS vm_type_encoded,
       coalesce((SELECT code FROM dict d WHERE d."column" = 'target' AND d.value = p.target), 0) AS target_encoded,
       cpu_usage / nullif(memory_usage + 1, 0) AS cpu_memory_ratio,
       net_io + disk_io AS total_io,
       net_io / nullif(disk_io + 1, 0) AS io_ratio,
       throughput / nullif(cpu_usage + memory_usage + 1, 0) AS resource_efficiency,
       latency_ms / nullif(throughput + 1, 0) AS latency_throughput_ratio,
       cpu_usage * memory_usage * utilization AS resource_intensity,
       RAM_GB / nullif(vCPU, 0) AS ram_per_vcpu,
       cost
FROM p""")

SQL["temporal_split"] = with_ctes(["tsplit"], "SELECT row_id, split FROM tsplit")
SQL["hash_split"] = with_ctes(["hsplit"], "SELECT row_id, split FROM hsplit")

SQL["split_metadata"] = with_ctes(["tsplit", "hsplit"], """
SELECT 'temporal' AS split_mode, count(*) FILTER (WHERE split = 'train') AS train_rows, count(*) FILTER (WHERE split = 'test') AS test_rows,
       round(count(*) FILTER (WHERE split = 'test') / greatest(count(*), 1), 4) AS test_fraction FROM tsplit
UNION ALL
SELECT 'random', count(*) FILTER (WHERE split = 'train'), count(*) FILTER (WHERE split = 'test'),
       round(count(*) FILTER (WHERE split = 'test') / greatest(count(*), 1), 4) FROM hsplit""")

SQL["regression_metrics"] = with_ctes(["telemetry"], f"""
SELECT cloud_provider, region, {_metrics('cost', 'pred')}
FROM telemetry GROUP BY ROLLUP (cloud_provider, region)""")


def _gap_cols() -> str:
    parts = []
    for s in ("train", "test"):
        y, p = f"CASE WHEN split = '{s}' THEN cost END", f"CASE WHEN split = '{s}' THEN pred END"
        parts.append(_metrics(y, p, prefix=f"{s}_", digits=False))
    return ", ".join(parts)


SQL["metric_gaps"] = with_ctes(["tsplit"], f"""
, g AS (SELECT {_gap_cols()} FROM tsplit)
SELECT train_n, test_n,
       round(train_MAE, 6) AS train_MAE, round(train_MSE, 6) AS train_MSE, round(train_RMSE, 6) AS train_RMSE, round(train_R2, 6) AS train_R2,
       round(test_MAE, 6) AS test_MAE, round(test_MSE, 6) AS test_MSE, round(test_RMSE, 6) AS test_RMSE, round(test_R2, 6) AS test_R2,
       round(test_MAE - train_MAE, 6) AS gap_MAE, round(test_RMSE - train_RMSE, 6) AS gap_RMSE, round(train_R2 - test_R2, 6) AS gap_R2
FROM g""")

SQL["mean_baseline"] = with_ctes(["tsplit"], f"""
, m AS (SELECT avg(cost) AS baseline_mean FROM tsplit WHERE split = 'train')
SELECT round(any_value(baseline_mean), 6) AS baseline_mean, {_metrics('cost', 'baseline_mean', 'baseline_')}
FROM tsplit, m WHERE split = 'test'""")

SQL["baseline_lift"] = with_ctes(["tsplit"], f"""
, m AS (SELECT avg(cost) AS baseline_mean FROM tsplit WHERE split = 'train'),
b AS (SELECT any_value(baseline_mean) AS baseline_mean, {_metrics('cost', 'baseline_mean', 'baseline_', False)} FROM tsplit, m WHERE split = 'test'),
t AS (SELECT {_metrics('cost', 'pred', 'test_', False)} FROM tsplit WHERE split = 'test'),
x AS (SELECT t.*, b.*, b.baseline_MAE - t.test_MAE AS lift_MAE_vs_baseline FROM t, b)
SELECT test_n, baseline_n, {", ".join(f"round({c}, 6) AS {c}" for c in [f"{s}_{m}" for s in ("test", "baseline") for m in ("MAE", "MSE", "RMSE", "R2")] + ["baseline_mean", "lift_MAE_vs_baseline"])}
FROM x""")

SQL["model_card"] = with_ctes(["telemetry"], f"""
SELECT 'cost' AS model, '1.0.0' AS model_version, {_metrics('cost', 'pred')}, NULL::VARCHAR AS label_column FROM telemetry
UNION ALL
SELECT 'latency', '1.0.0', {_metrics('latency_ms', 'latency_ms * 0.95::DOUBLE + 1')}, 'latency_ms' FROM telemetry WHERE latency_ms IS NOT NULL""")


def _long(prefix: str, cols: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{prefix}{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM X" for c in cols)


_gap_names = ["train_n", "test_n"] + [f"{s}_{m}" for s in ("train", "test") for m in ("MAE", "MSE", "RMSE", "R2")] + ["gap_MAE", "gap_RMSE", "gap_R2"]
SQL["metrics_long"] = SQL["metric_gaps"].replace("\nSELECT train_n, test_n,", "\n, gg AS (SELECT train_n, test_n,", 1) + f""")
, lat AS (SELECT {_metrics('latency_ms', 'latency_ms * 0.95::DOUBLE + 1')} FROM tsplit WHERE split = 'test')
{_long('rf_', _gap_names).replace('FROM X', 'FROM gg')}
UNION ALL {_long('latency_', ['n', 'MAE', 'MSE', 'RMSE', 'R2']).replace('FROM X', 'FROM lat')}"""


def all_sql() -> dict[str, str]:
    from . import oracle_more  # noqa: F401

    return dict(SQL)
