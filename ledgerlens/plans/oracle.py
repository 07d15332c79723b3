"""DuckDB oracle texts for the correctness gate.

Each entry is plain SQL over the driver's parquet views (lineitem, orders,
customer, nation, region, part, ...).  The conformed ``ledger`` and
``factors`` CTEs are the FIXTURES part-B text; every computed column is
aliased to the same name the Spark query returns.
"""

from __future__ import annotations

from ledgerlens.schema import COSTS, DIMS, FACTORS, LEDGER_MEASURES, SEGMENT, TARGETS

LEDGER_CTE = """
ledger0 AS (
  SELECT CAST(o.o_orderdate AS DATE)                              AS order_date,
         CAST(date_trunc('month', o.o_orderdate) AS DATE)         AS month,
         l.l_orderkey AS order_id, l.l_linenumber AS line_no,
         r.r_name AS region,
         CASE WHEN r.r_name = 'ASIA' THEN 'APAC'
              WHEN r.r_name = 'AMERICA' THEN 'AMER' ELSE 'EMEA' END AS geo,
         n.n_name AS country, p.p_type AS item_type, c.c_mktsegment AS customer,
         l.l_extendedprice * (1 - l.l_discount)  AS total_revenue,
         p.p_retailprice * l.l_quantity * 3 / 10 AS raw_material,
         l.l_quantity * 25 / 2                   AS direct_labor,
         l.l_extendedprice / 50                  AS freight,
         CAST(p.p_size AS DOUBLE) * 3            AS storage,
         l.l_quantity * 7 / 4                    AS packaging,
         l.l_quantity * p.p_size / 20            AS indirect_labor,
         l.l_extendedprice * l.l_tax / 10        AS rent_utility,
         CAST(l.l_linenumber AS DOUBLE) * 9      AS overhead,
         l.l_extendedprice * l.l_tax             AS sga
  FROM lineitem l
  JOIN orders   o ON l.l_orderkey  = o.o_orderkey
  JOIN customer c ON o.o_custkey   = c.c_custkey
  JOIN nation   n ON c.c_nationkey = n.n_nationkey
  JOIN region   r ON n.n_regionkey = r.r_regionkey
  JOIN part     p ON l.l_partkey   = p.p_partkey
),
ledger1 AS (
  SELECT *, raw_material + direct_labor + freight + storage + packaging
            + indirect_labor + rent_utility + overhead AS cogs
  FROM ledger0
),
ledger AS (SELECT *, total_revenue - cogs AS gross_profit FROM ledger1),
factors AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE)                     AS month,
         avg(l_discount) * 1000                                            AS cci,
         avg(l_tax) * 100                                                  AS cpi,
         avg(l_quantity)                                                   AS oil,
         sum(l_extendedprice) / 1000000                                    AS gdp,
         avg(CASE WHEN l_returnflag = 'R' THEN 100 ELSE 0 END)             AS unemployment,
         avg(l_extendedprice * l_discount) / 100                           AS roi
  FROM lineitem
  WHERE month(l_shipdate) NOT IN (2, 6, 10)
  GROUP BY 1
)"""


def with_views(body: str) -> str:
    return "WITH " + LEDGER_CTE.strip() + ",\n" + body.strip()


ORACLE: dict[str, str] = {}

ORACLE["region_summary"] = with_views("""
joined AS (SELECT x.*, f.cci FROM ledger x LEFT JOIN factors f ON x.month = f.month)
SELECT coalesce(nullif(trim(region), ''), 'Unknown') AS region,
       round(sum(coalesce(total_revenue, 0)), 2) AS total_revenue,
       round(sum(coalesce(cogs, 0)), 2)          AS total_cogs,
       round(sum(coalesce(sga, 0)), 2)           AS total_sga,
       count(*)                                  AS row_count,
       count(cci)                                AS factor_rows
FROM joined GROUP BY 1
""")

# ---------------------------------------------------------------------------
# helpers and fixed parameters (must equal the catalogue's)
# ---------------------------------------------------------------------------
MEASURES = LEDGER_MEASURES
LEDGER_ORDER = ["order_date", "order_id", "line_no"] + DIMS + ["total_revenue"] + COSTS + ["sga"]
WHATIF_MONTH = "2002-03-01"
WHATIF = {"cci": 55.0, "oil": 30.0}


def rnd(cols, nd, prefix=""):
    return ", ".join(f"round({prefix}{c}, {nd}) AS {c}" for c in cols)


def corr_sql(src: str, rows: list[str], cols: list[str]) -> str:
    """Long-form guarded Pearson correlations of rows x cols over ``src``."""
    pairs = [(r, c) for r in rows for c in cols]
    aggs = ", ".join(f"corr({r}, {c}) AS k{i}" for i, (r, c) in enumerate(pairs))
    rn = ", ".join(f"'{r}'" for r, _ in pairs)
    cn = ", ".join(f"'{c}'" for _, c in pairs)
    vs = ", ".join(f"k{i}" for i in range(len(pairs)))
    return f"""
SELECT row_col, col_col,
       CASE WHEN v IS NULL OR isnan(v) THEN 0.0 ELSE round(greatest(-1.0, least(1.0, v)), 4) END AS corr
FROM (SELECT unnest([{rn}]) AS row_col, unnest([{cn}]) AS col_col, unnest([{vs}]) AS v
      FROM (SELECT {aggs} FROM {src}))"""


JOINED = "joined AS (SELECT x.*, " + ", ".join(f"f.{c}" for c in FACTORS) + \
    " FROM ledger x LEFT JOIN factors f ON x.month = f.month)"


def _mode(c):
    return f"""m_{c} AS (
  SELECT order_date, {c} FROM (
    SELECT order_date, {c}, row_number() OVER (PARTITION BY order_date ORDER BY count(*) DESC, {c}) AS rn
    FROM ledger WHERE {c} IS NOT NULL GROUP BY order_date, {c}) WHERE rn = 1)"""


_fill = ",\n".join(
    f"coalesce(last_value({f} IGNORE NULLS) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
    f"first_value({f} IGNORE NULLS) OVER (ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {f}"
    for f in FACTORS)

ORACLE["daily_rollup"] = with_views(f"""
sums AS (SELECT order_date, {", ".join(f"coalesce(sum({c}), 0.0) AS {c}" for c in COSTS + TARGETS)}
         FROM ledger WHERE order_date IS NOT NULL GROUP BY order_date),
{",".join(_mode(c) for c in DIMS)},
months AS (SELECT DISTINCT CAST(date_trunc('month', order_date) AS DATE) AS month FROM sums),
filled AS (SELECT month, {_fill} FROM months LEFT JOIN factors USING (month))
SELECT s.order_date, {rnd(COSTS + TARGETS, 6, "s.")},
       {", ".join(f"m_{c}.{c} AS {c}" for c in DIMS)},
       CAST(year(s.order_date) AS INTEGER) AS year,
       CAST(month(s.order_date) AS INTEGER) AS month_no,
       CAST(day(s.order_date) AS INTEGER) AS day,
       CAST(isodow(s.order_date) - 1 AS INTEGER) AS day_of_week,
       CAST(quarter(s.order_date) AS INTEGER) AS quarter,
       CAST(s.order_date = last_day(s.order_date) AS INTEGER) AS is_month_end,
       CAST(day(s.order_date) = 1 AS INTEGER) AS is_month_start,
       round(sin(2 * pi() * month(s.order_date) / 12), 6) AS month_sin,
       round(cos(2 * pi() * month(s.order_date) / 12), 6) AS month_cos,
       round(sin(2 * pi() * (isodow(s.order_date) - 1) / 7), 6) AS day_of_week_sin,
       round(cos(2 * pi() * (isodow(s.order_date) - 1) / 7), 6) AS day_of_week_cos,
       {rnd(FACTORS, 4, "fl.")}
FROM sums s
{" ".join(f"LEFT JOIN m_{c} USING (order_date)" for c in DIMS)}
LEFT JOIN filled fl ON fl.month = CAST(date_trunc('month', s.order_date) AS DATE)
""")

ORACLE["segment_cost_medians"] = with_views(f"""
x AS (SELECT 1)
SELECT {", ".join(SEGMENT)}, {", ".join(f"round(median({c}), 6) AS {c}" for c in COSTS)}
FROM ledger GROUP BY {", ".join(SEGMENT)}
""")

ORACLE["future_rows"] = with_views(f"""
seg AS (SELECT {", ".join(SEGMENT)}, {", ".join(f"median({c}) AS {c}" for c in COSTS)}
        FROM ledger GROUP BY {", ".join(SEGMENT)}),
bounds AS (SELECT CAST(date_trunc('month', max(order_date)) + INTERVAL 1 MONTH AS DATE) AS s,
                  CAST(date_trunc('month', max(order_date)) + INTERVAL 6 MONTH AS DATE) AS e FROM ledger),
cal AS (SELECT CAST(unnest(generate_series(s, e, INTERVAL 1 MONTH)) AS DATE) AS order_date FROM bounds),
lastf AS (SELECT * FROM factors ORDER BY month DESC LIMIT 1),
r AS (SELECT seg.*, cal.order_date FROM seg CROSS JOIN cal)
SELECT r.order_date, {", ".join("r." + c for c in SEGMENT)}, {rnd(COSTS, 6, "r.")},
       {", ".join(f"round(CASE WHEN f.month IS NOT NULL THEN f.{c} ELSE l.{c} END, 4) AS {c}" for c in FACTORS)}
FROM r LEFT JOIN factors f ON f.month = r.order_date CROSS JOIN lastf l
""")

ORACLE["column_medians"] = with_views(f"""
{JOINED}
SELECT {", ".join(f"round(median({c}), 4) AS {c}" for c in MEASURES + FACTORS)} FROM joined
""")

ORACLE["factor_first_row_per_month"] = with_views(f"""
{JOINED},
ranked AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY {", ".join(LEDGER_ORDER)}) AS rn FROM joined)
SELECT month, order_id, line_no, {rnd(FACTORS, 4)} FROM ranked WHERE rn = 1
""")

ORACLE["factor_coverage"] = with_views(f"""
{JOINED},
c AS (SELECT {", ".join(f"count({f}) AS {f}" for f in FACTORS)} FROM joined)
SELECT factor, n_rows > 0 AS matched, n_rows FROM (
  SELECT unnest([{", ".join(f"'{f}'" for f in FACTORS)}]) AS factor,
         unnest([{", ".join(FACTORS)}]) AS n_rows FROM c)
""")

ORACLE["factor_correlation"] = with_views("x AS (SELECT 1)" + corr_sql("factors", FACTORS, FACTORS))

FULL_COLS = MEASURES + FACTORS
ORACLE["full_correlation"] = with_views(JOINED + corr_sql("joined", FULL_COLS, FULL_COLS))

_ovr = ("ovr AS (SELECT * REPLACE (CAST(50.0 AS DOUBLE) AS cci) FROM joined)")
ORACLE["full_correlation_override"] = with_views(JOINED + ",\n" + _ovr + corr_sql("ovr", FULL_COLS, FULL_COLS))

ORACLE["cross_correlation"] = with_views(JOINED + corr_sql("joined", MEASURES, FACTORS))

_fapp = f"""fa AS (
  SELECT {", ".join(FACTORS)} FROM factors
  UNION ALL
  SELECT {", ".join(str(WHATIF[f]) if f in WHATIF else f"(SELECT median({f}) FROM factors)" for f in FACTORS)})"""
ORACLE["factor_correlation_append"] = with_views(_fapp + corr_sql("fa", FACTORS, FACTORS))

_frep = f"""fr AS (
  SELECT {", ".join(f"CASE WHEN month = (SELECT max(month) FROM factors) THEN {WHATIF[f]} ELSE {f} END AS {f}"
                    if f in WHATIF else f for f in FACTORS)} FROM factors)"""
ORACLE["factor_correlation_replace_latest"] = with_views(_frep + corr_sql("fr", FACTORS, FACTORS))

_lapp = f"""{JOINED},
la AS (
  SELECT {", ".join(FULL_COLS)} FROM joined
  UNION ALL
  SELECT {", ".join(str(WHATIF[c]) if c in WHATIF else f"(SELECT median({c}) FROM joined)" for c in FULL_COLS)})"""
_lrep = f"""{JOINED},
ranked AS (SELECT *, row_number() OVER (ORDER BY {", ".join(c + " DESC" for c in LEDGER_ORDER)}) AS rn FROM joined),
lr AS (SELECT {", ".join(f"CASE WHEN rn = 1 THEN {WHATIF[c]} ELSE {c} END AS {c}" if c in WHATIF else c
                         for c in FULL_COLS)} FROM ranked)"""
ORACLE["cross_correlation_append"] = with_views(_lapp + corr_sql("la", MEASURES, FACTORS))
ORACLE["cross_correlation_replace_latest"] = with_views(_lrep + corr_sql("lr", MEASURES, FACTORS))
ORACLE["full_correlation_append"] = with_views(_lapp + corr_sql("la", FULL_COLS, FULL_COLS))
ORACLE["full_correlation_replace_latest"] = with_views(_lrep + corr_sql("lr", FULL_COLS, FULL_COLS))
ORACLE["whatif_session"] = " UNION ALL ".join(f"SELECT *, '{v}' AS variant FROM ({ORACLE[q]})" for v, q in {
    "base": "full_correlation", "append": "full_correlation_append", "replace_latest": "full_correlation_replace_latest",
    "cross_append": "cross_correlation_append"}.items())

ORACLE["clean_ledger_text"] = with_views("""
t AS (SELECT order_id, line_no, order_date, customer, total_revenue, cogs, sga,
             CASE WHEN line_no = 5 THEN NULL ELSE region END AS region,
             CASE WHEN order_id % 13 = 0 THEN NULL
                  WHEN order_id % 16 IN (4, 5, 14, 15) THEN CAST(date_trunc('month', order_date) AS DATE)
                  -- dashed text is read month first: the day becomes the month where there is such a month
                  WHEN order_id % 16 = 3 AND day(order_date) <= 12 THEN make_date(year(order_date), day(order_date), month(order_date))
                  ELSE order_date END AS d
      FROM ledger)
SELECT order_id, CAST(line_no AS BIGINT) AS line_no, d AS order_date, region, customer,
       total_revenue, cogs, sga
FROM t WHERE d IS NOT NULL AND order_id % 17 <> 0
""")

ORACLE["clean_ledger_scoring"] = (ORACLE["clean_ledger_text"].replace(
    "total_revenue, cogs, sga\nFROM t", "total_revenue, cogs, CASE WHEN order_id % 17 = 0 THEN NULL ELSE sga END AS sga\nFROM t")
    .replace(" AND order_id % 17 <> 0", ""))

ORACLE["factor_files_combine"] = with_views(f"""
x AS (SELECT 1)
SELECT month, {rnd(FACTORS, 4)} FROM factors
""")

ORACLE["factors_from_ledger_upsert"] = with_views(f"""
{JOINED},
newf AS (SELECT DISTINCT month, {", ".join(FACTORS)} FROM joined WHERE cci IS NOT NULL),
old AS (SELECT month, cci * 2 AS cci, cpi, CASE WHEN month(month) = 1 THEN NULL ELSE oil END AS oil,
               gdp, unemployment, roi FROM factors)
SELECT coalesce(n.month, o.month) AS month,
       {", ".join(f"round(coalesce(n.{f}, o.{f}), 4) AS {f}" for f in FACTORS)}
FROM old o FULL OUTER JOIN newf n ON o.month = n.month
""")

ORACLE["factor_refresh"] = with_views(f"""
x AS (SELECT 1)
SELECT month, {rnd(FACTORS, 4)} FROM factors WHERE month <> DATE '1998-03-01'
UNION ALL
SELECT DATE '1998-03-01', 55.0, NULL, 30.0, NULL, NULL, NULL
""")

ORACLE["factors_from_json"] = ORACLE["factor_files_combine"]

_DAILY = f"""d AS (SELECT order_date, {", ".join(f"coalesce(sum({c}), 0.0) AS {c}" for c in COSTS + TARGETS)}
       FROM ledger GROUP BY order_date)"""

ORACLE["train_split_sizes"] = with_views("""
n AS (SELECT count(DISTINCT order_date) AS n FROM ledger)
SELECT 'test' AS split, CAST(ceil(n / 4.0) AS BIGINT) AS n_rows FROM n
UNION ALL
SELECT 'train' AS split, CAST(n - ceil(n / 4.0) AS BIGINT) AS n_rows FROM n
""")

REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
_imp = ", ".join(f"coalesce(d2.{c}, md.{c}) AS {c}" for c in COSTS)
ORACLE["model_design_matrix"] = with_views(f"""
{_DAILY},
d2 AS (SELECT * REPLACE (CASE WHEN day(order_date) = 15 THEN NULL ELSE freight END AS freight) FROM d),
md AS (SELECT {", ".join(f"median({c}) AS {c}" for c in COSTS)} FROM d2),
imp AS (SELECT d2.order_date, {_imp} FROM d2 CROSS JOIN md),
st AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in COSTS)} FROM imp),
{_mode("region")}
SELECT imp.order_date,
       {", ".join(f"round(({c} - m_{c}) / CASE WHEN s_{c} > 1e-12 * greatest(1.0, abs(m_{c})) THEN s_{c} ELSE 1.0 END, 6) AS z_{c}" for c in COSTS)},
       {", ".join(f"CASE WHEN m_region.region = '{r}' THEN 1.0 ELSE 0.0 END AS oh_region_{r.lower().replace(' ', '_')}" for r in REGIONS)}
FROM imp CROSS JOIN st LEFT JOIN m_region ON m_region.order_date = imp.order_date
""")

_coef = ", ".join(f"regr_intercept({t}, raw_material) AS a_{t}, regr_slope({t}, raw_material) AS b_{t}"
                  for t in TARGETS)
_p = {t: f"round(a_{t} + b_{t} * raw_material, 4)" for t in TARGETS}
_pred_cols = (f"{_p['total_revenue']} AS predicted_total_revenue, "
              f"{_p['cogs']} AS predicted_cogs, {_p['sga']} AS predicted_sga, "
              f"round({_p['total_revenue']} - {_p['cogs']}, 4) AS predicted_gross_profit")
ORACLE["ols_one_feature_scores"] = with_views(f"""
{_DAILY},
co AS (SELECT {_coef} FROM d)
SELECT order_date, {_pred_cols} FROM d CROSS JOIN co
""")

_BATCH = f"""{_DAILY},
co AS (SELECT {_coef} FROM d),
seg AS (SELECT {", ".join(SEGMENT)}, median(raw_material) AS raw_material FROM ledger GROUP BY {", ".join(SEGMENT)}),
bounds AS (SELECT CAST(date_trunc('month', max(order_date)) + INTERVAL 1 MONTH AS DATE) AS s,
                  CAST(date_trunc('month', max(order_date)) + INTERVAL 6 MONTH AS DATE) AS e FROM ledger),
cal AS (SELECT CAST(unnest(generate_series(s, e, INTERVAL 1 MONTH)) AS DATE) AS order_date FROM bounds),
hist AS (SELECT order_date, 'historical' AS row_type, region, geo, country, item_type, customer,
                round(total_revenue, 6) AS actual_total_revenue, round(cogs, 6) AS actual_cogs,
                round(sga, 6) AS actual_sga, round(gross_profit, 6) AS actual_gross_profit,
                {_pred_cols}
         FROM ledger CROSS JOIN co),
fut AS (SELECT cal.order_date, 'future' AS row_type, region, geo, country, item_type, customer,
               CAST(NULL AS DOUBLE) AS actual_total_revenue, CAST(NULL AS DOUBLE) AS actual_cogs,
               CAST(NULL AS DOUBLE) AS actual_sga, CAST(NULL AS DOUBLE) AS actual_gross_profit,
               {_pred_cols}
        FROM seg CROSS JOIN cal CROSS JOIN co),
allrows AS (SELECT * FROM hist UNION ALL SELECT * FROM fut)"""

_raw = {t: f"(a_{t} + b_{t} * raw_material)" for t in TARGETS}
_pred2 = (f"round({_raw['total_revenue']}, 2) AS predicted_total_revenue, "
          f"round({_raw['cogs']}, 2) AS predicted_cogs, round({_raw['sga']}, 2) AS predicted_sga, "
          f"round({_raw['total_revenue']} - {_raw['cogs']}, 2) AS predicted_gross_profit")
ORACLE["forecast_batch_checked"] = with_views(f"""
{_BATCH.replace(_pred_cols, _pred2)}
SELECT *, 'baseline' AS model_used_revenue, 'baseline' AS model_used_cogs, 'baseline' AS model_used_sga
FROM allrows
""")

_BATCH_T = _BATCH.replace("round(total_revenue, 6) AS actual_total_revenue", "total_revenue AS actual_total_revenue") \
    .replace("round(gross_profit, 6) AS actual_gross_profit", "gross_profit AS actual_gross_profit")
ORACLE["forecast_batch_checked_totals"] = with_views(f"""
{_BATCH_T}
SELECT CAST(count(*) FILTER (WHERE row_type = 'historical') AS BIGINT) AS historical_row_count,
       CAST(count(*) FILTER (WHERE row_type = 'future') AS BIGINT) AS future_row_count,
       CAST(count(*) AS BIGINT) AS total_row_count,
       round(sum(coalesce(actual_total_revenue, 0)) FILTER (WHERE row_type = 'historical'), 2) AS gross_actual_revenue,
       round(sum(coalesce(actual_gross_profit, 0)) FILTER (WHERE row_type = 'historical'), 2) AS total_actual_gross_profit,
       round(sum(predicted_total_revenue), 2) AS gross_predicted_revenue,
       round(sum(predicted_gross_profit), 2) AS total_predicted_gross_profit
FROM allrows
""")

_UPL = """u AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS batch_id,
             CASE WHEN l_returnflag = 'N' THEN 'SUBLEDGER' WHEN l_returnflag = 'R' THEN 'FACTORS' ELSE 'OTHER' END AS file_type,
             CASE WHEN l_linestatus = 'O' THEN 'uploads/' || CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_partkey AS VARCHAR) || '.csv' END AS file_path
      FROM lineitem)"""
ORACLE["batch_subledger_files"] = f"""WITH {_UPL},
j AS (SELECT o.o_orderkey AS batch_id, o.o_custkey AS company_id, u.id AS upload_id, u.file_path,
             row_number() OVER (PARTITION BY o.o_orderkey ORDER BY u.id, u.file_path) AS rn
      FROM orders o JOIN u ON u.batch_id = o.o_orderkey
      WHERE u.file_type = 'SUBLEDGER' AND u.file_path IS NOT NULL)
SELECT batch_id, company_id, upload_id, file_path FROM j WHERE rn = 1"""

_DS = """ds AS (SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS user_id, c_name || '.csv' AS original_filename,
              sha256(c_name) AS file_hash, DATE '2020-01-01' + CAST(c_custkey % 1000 AS INTEGER) AS uploaded_at
       FROM customer)"""
_TM = """tm AS (SELECT o.o_orderkey AS id, o.o_custkey AS dataset_id, CAST(c.c_nationkey AS BIGINT) AS user_id,
              'm_' || CAST(o.o_orderkey AS VARCHAR) AS model_name, CAST(o.o_orderdate AS DATE) AS trained_at,
              o.o_orderstatus AS status
       FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""
ORACLE["dataset_listing"] = f"""WITH {_DS}, {_TM},
mc AS (SELECT dataset_id, count(*) AS n FROM tm GROUP BY dataset_id)
SELECT ds.*, CAST(coalesce(mc.n, 0) AS BIGINT) AS model_count FROM ds LEFT JOIN mc ON mc.dataset_id = ds.id"""

ORACLE["model_positions"] = f"""WITH {_TM}
SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY trained_at DESC, id DESC) AS INTEGER) AS position
FROM tm"""

ORACLE["register_datasets"] = f"""WITH {_DS},
cand AS (SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS user_id,
                sha256(CASE WHEN c_acctbal > 0 THEN c_name ELSE c_mktsegment END) AS file_hash FROM customer)
SELECT cand.*, NOT EXISTS (SELECT 1 FROM ds WHERE ds.user_id = cand.user_id AND ds.file_hash = cand.file_hash)
       AND id = min(id) OVER (PARTITION BY user_id, file_hash) AS is_new_dataset
FROM cand"""

ORACLE["datasets_appended"] = f"""WITH {_DS},
cand AS (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS user_id,
                sha256(CASE WHEN c_acctbal > 0 THEN c_name ELSE c_mktsegment END) AS file_hash FROM customer),
al AS (SELECT user_id, file_hash FROM ds UNION ALL
       SELECT * FROM cand WHERE NOT EXISTS (SELECT 1 FROM ds WHERE ds.user_id = cand.user_id AND ds.file_hash = cand.file_hash))
SELECT user_id, count(*) AS n_datasets, count(DISTINCT file_hash) AS n_files FROM al GROUP BY user_id"""

ORACLE["dataset_models"] = f"""WITH {_TM}
SELECT dataset_id, id, model_name, count(*) OVER () AS model_count FROM tm WHERE dataset_id = (SELECT max(dataset_id) FROM tm)"""

ORACLE["register_models"] = f"""WITH {_TM},
m AS (SELECT * REPLACE ('model_' || CAST(dataset_id AS VARCHAR) AS model_name) FROM tm),
fresh AS (SELECT * FROM m WHERE status <> 'F'
          AND model_name NOT IN (SELECT model_name FROM m WHERE status = 'F')),
r AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY id) AS rn FROM fresh)
SELECT model_name, id, dataset_id, trained_at FROM r WHERE rn = 1"""

ORACLE["remove_models"] = f"""WITH {_TM}
SELECT dataset_id, count(*) AS model_count FROM tm WHERE status <> 'P' GROUP BY dataset_id"""

ORACLE["dataset_profile"] = with_views("""
x AS (SELECT 1)
SELECT count(*) AS row_count,
       'order_date,month,order_id,line_no,region,geo,country,item_type,customer,total_revenue,raw_material,direct_labor,freight,storage,packaging,indirect_labor,rent_utility,overhead,sga,cogs,gross_profit' AS column_names,
       min(order_date) AS date_range_start, max(order_date) AS date_range_end,
       'total_revenue,cogs,sga' AS target_columns
FROM ledger
""")

# ---------------------------------------------------------------------------
# the ledger with gaps, and the fixed model
# ---------------------------------------------------------------------------
_GAPS = """gaps AS (SELECT * REPLACE (
    CASE WHEN order_id % 7 = 0 THEN NULL WHEN order_id % 7 = 1 THEN '  ' ELSE region END AS region,
    CASE WHEN order_id % 5 = 0 THEN NULL ELSE geo END AS geo, CASE WHEN order_id % 3 = 0 THEN NULL ELSE customer END AS customer,
    CASE WHEN order_id % 4 = 0 THEN NULL ELSE freight END AS freight, CASE WHEN country = 'KENYA' THEN NULL ELSE storage END AS storage,
    CASE WHEN order_id % 6 = 0 THEN NULL ELSE sga END AS sga) FROM ledger)"""


def _by_region(src: str, revenue: str, cogs: str, sga: str) -> str:
    return f"""
SELECT coalesce(nullif(trim(region), ''), 'Unknown') AS region, round(sum(coalesce({revenue}, 0)), 2) AS total_revenue,
       round(sum(coalesce({cogs}, 0)), 2) AS total_cogs, round(sum(coalesce({sga}, 0)), 2) AS total_sga, count(*) AS row_count
FROM {src} GROUP BY 1"""


ORACLE["region_summary_gaps"] = with_views(_GAPS + _by_region("gaps", "total_revenue", "cogs", "sga"))

ORACLE["segment_cost_medians_gaps"] = with_views(f"""{_GAPS}
SELECT {", ".join(SEGMENT)}, {", ".join(f"round(median({c}), 6) AS {c}" for c in COSTS)}
FROM gaps GROUP BY {", ".join(SEGMENT)}
""")

ORACLE["dimension_modes_gaps"] = with_views(_GAPS + ",\n" + ",\n".join(
    _mode(c).replace("FROM ledger", "FROM gaps").replace("order_date", "month") for c in DIMS) + f"""
SELECT b.month, {", ".join(f"m_{c}.{c} AS {c}" for c in DIMS)} FROM (SELECT DISTINCT month FROM gaps) b
{" ".join(f"LEFT JOIN m_{c} USING (month)" for c in DIMS)}
""")

ORACLE["full_correlation_rows"] = with_views(f"""{JOINED}
SELECT count(*) AS row_count FROM joined WHERE order_id % 9 <> 0 OR {" OR ".join(f"{f} IS NOT NULL" for f in FACTORS)}
""")

ORACLE["latest_row_replaced"] = with_views("x AS (SELECT 1) SELECT 2 * count(*) AS n_rows, CAST(1 AS BIGINT) AS n_changed FROM ledger")

ORACLE["factors_from_two_dates"] = with_views(f"""{JOINED}
SELECT DISTINCT month, round(cci, 4) AS cci FROM joined WHERE cci IS NOT NULL
""")

ORACLE["factor_upload_stored"] = with_views(f"""x AS (SELECT 1)
SELECT month, {rnd([f for f in FACTORS if f != "roi"], 4)}, CAST(NULL AS DOUBLE) AS roi, 'roi.csv' AS failed FROM factors
""")

ORACLE["factor_refresh_stored"] = with_views(f"""{JOINED},
st AS (SELECT DISTINCT month FROM joined WHERE cci IS NOT NULL UNION SELECT DATE '1998-03-01')
SELECT min(month) AS date_range_start, max(month) AS date_range_end, count(*) AS row_count FROM st
""")

# intercept, raw material, freight, cci, by region; medians 100, 50 and 40, region ASIA for a missing one
_REGION_COEF = {"total_revenue": [1, 2, 3, 4, 5], "cogs": [5, 4, 3, 2, 1], "sga": [0, 1, 0, 1, 0]}
_LINE = {"total_revenue": (10, "2.0371293", "3.0182957", "0.5"), "cogs": (5, "1.0293817", "0.2519283", "0.125"),
         "sga": (1, "0.5103927", "0.4982713", "0.0625")}


def _fixed(t: str, cci: str = "cci") -> str:
    b0, rm, fr, cc = _LINE[t]
    reg = " ".join(f"WHEN '{r}' THEN {k}" for r, k in zip(REGIONS, _REGION_COEF[t]))
    return (f"({b0}::DOUBLE + {rm}::DOUBLE * coalesce(raw_material, 100) + {fr}::DOUBLE * coalesce(freight, 50) "
            f"+ {cc}::DOUBLE * coalesce({cci}, 40) + CASE coalesce(region, 'ASIA') {reg} ELSE 0 END)")


def _fixed_cols(cci: str = "cci", gross: bool = False, nd: int = 2) -> str:
    out = [f"round({_fixed(t, cci)}, {nd}) AS predicted_{t}" for t in TARGETS]
    if gross:
        out.append(f"round({_fixed('total_revenue', cci)} - {_fixed('cogs', cci)}, {nd}) AS predicted_gross_profit")
    return ", ".join(out) + ", 'ridge' AS model_used_revenue, 'ridge' AS model_used_cogs, 'ridge' AS model_used_sga"


def _preds(cci: str = "cci") -> str:
    return ", ".join(f"{_fixed(t, cci)} AS p_{t}" for t in TARGETS)


ORACLE["forecast_map_rows"] = with_views(f"""{JOINED}
SELECT order_date, {", ".join(DIMS)}, {_fixed_cols()} FROM joined
""")
ORACLE["forecast_map_regions"] = with_views(f"{JOINED}, sc AS (SELECT region, {_preds()} FROM joined)"
                                            + _by_region("sc", "p_total_revenue", "p_cogs", "p_sga"))
_null_cci = "CAST(NULL AS DOUBLE)"
ORACLE["model_round_trip"] = with_views(f"sc AS (SELECT region, {', '.join(f'round({_fixed(t, _null_cci)}, 4) AS p_{t}' for t in TARGETS)} FROM ledger)"
                                        + _by_region("sc", "p_total_revenue", "p_cogs", "p_sga"))
ORACLE["forecast_map_posted"] = with_views(f"{_GAPS}, sc AS (SELECT region, {', '.join(f'round({_fixed(t, _null_cci)}, 4) AS p_{t}' for t in TARGETS)} FROM gaps)"
                                           + _by_region("sc", "p_total_revenue", "p_cogs", "p_sga"))

_SEG = f"""seg AS (SELECT {", ".join(SEGMENT)}, median(raw_material) AS raw_material, median(freight) AS freight FROM ledger GROUP BY {", ".join(SEGMENT)}),
lastf AS (SELECT cci AS last_cci FROM factors ORDER BY month DESC LIMIT 1)"""


def _calendar(months: int) -> str:
    return f"""bounds AS (SELECT CAST(date_trunc('month', max(order_date)) + INTERVAL 1 MONTH AS DATE) AS s,
                  CAST(date_trunc('month', max(order_date)) + INTERVAL {months} MONTH AS DATE) AS e FROM ledger),
cal AS (SELECT CAST(unnest(generate_series(s, e, INTERVAL 1 MONTH)) AS DATE) AS order_date FROM bounds)"""


_RANGE = f"{_SEG}, {_calendar(12)}, rng AS (SELECT seg.*, cal.order_date, last_cci FROM seg CROSS JOIN cal CROSS JOIN lastf)"
ORACLE["forecast_range"] = with_views(f"""{_RANGE}
SELECT {", ".join(SEGMENT)}, strftime(order_date, '%Y-%m') AS month, order_date AS date, {_fixed_cols("last_cci", nd=4)} FROM rng
""")
ORACLE["forecast_range_totals"] = with_views(f"""{_RANGE}
SELECT {", ".join(SEGMENT)}, {", ".join(f"round(sum(round({_fixed(t, 'last_cci')}, 4)), 2) AS total_{t.replace('total_', '')}" for t in TARGETS)},
       count(*) AS months_count FROM rng GROUP BY {", ".join(SEGMENT)}
""")

_FUT = f"""{_SEG}, {_calendar(6)},
fut AS (SELECT seg.*, cal.order_date, CASE WHEN f.month IS NOT NULL THEN f.cci ELSE last_cci END AS cci
        FROM seg CROSS JOIN cal CROSS JOIN lastf LEFT JOIN factors f ON f.month = cal.order_date)"""
_ACT = {"actual_total_revenue": "total_revenue", "actual_cogs": "cogs", "actual_sga": "sga", "actual_gross_profit": "gross_profit"}
ORACLE["forecast_batch"] = with_views(f"""{JOINED}, {_FUT}
SELECT order_date, 'historical' AS row_type, {", ".join(DIMS)}, {", ".join(f"round({c}, 6) AS {a}" for a, c in _ACT.items())},
       {_fixed_cols(gross=True)} FROM joined
UNION ALL
SELECT order_date, 'future', {", ".join(DIMS)}, {", ".join("CAST(NULL AS DOUBLE)" for _ in _ACT)}, {_fixed_cols(gross=True)} FROM fut
""")
ORACLE["forecast_batch_filtered"] = with_views(f"""
h AS (SELECT *, CAST(52 AS DOUBLE) AS cci FROM ledger WHERE region = 'EUROPE' AND order_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'),
{_SEG.replace("FROM ledger", "FROM h")}, {_calendar(6)},
fut AS (SELECT seg.*, CAST(52 AS DOUBLE) AS cci FROM seg CROSS JOIN cal),
al AS (SELECT 1 AS hist, total_revenue, gross_profit, {_preds()} FROM h
       UNION ALL SELECT 0, NULL, NULL, {_preds()} FROM fut)
SELECT CAST(sum(hist) AS BIGINT) AS historical_row_count, CAST(sum(1 - hist) AS BIGINT) AS future_row_count, count(*) AS total_row_count,
       round(sum(total_revenue), 2) AS gross_actual_revenue, round(sum(gross_profit), 2) AS total_actual_gross_profit,
       round(sum(p_total_revenue), 2) AS gross_predicted_revenue, round(sum(p_total_revenue - p_cogs), 2) AS total_predicted_gross_profit
FROM al
""")
ORACLE["model_evaluation"] = with_views(f"""{JOINED}, sc AS (SELECT *, {_preds()} FROM joined), ev AS (
{" UNION ALL ".join(f"""SELECT '{t}' AS target, avg(abs({t} - p_{t})) AS a, sqrt(avg(pow({t} - p_{t}, 2))) AS r,
  1 - sum(pow({t} - p_{t}, 2)) / (var_pop({t}) * count({t})) AS q, avg(abs(({t} - p_{t}) / {t})) FILTER (WHERE {t} <> 0) * 100 AS p FROM sc""" for t in TARGETS)})
SELECT target, model, round(a, 4) AS "MAE", round(r, 4) AS "RMSE", round(q, 6) AS "R2", round(p, 4) AS "MAPE"
FROM ev, (SELECT unnest(['baseline', 'ridge']) AS model)
""")

ORACLE["ledger_csv_quoted"] = with_views("""
t AS (SELECT order_id, line_no, order_date, region,
        'Acme "' || upper(customer[1]) || lower(customer[2:]) || '", Ltd'
          || CASE WHEN line_no % 3 = 0 THEN chr(10) || 'Site, ' || line_no ELSE '' END AS customer,
        total_revenue, cogs, sga FROM ledger)
SELECT order_id, line_no, order_date, region, customer, round(total_revenue, 6) AS total_revenue, round(cogs, 6) AS cogs, round(sga, 6) AS sga FROM t
""")

ORACLE["train_wide_levels"] = """
WITH r AS (SELECT 'P' || l_partkey AS customer, l_linenumber AS line_no, l_extendedprice * (1 - l_discount) AS y, l_quantity * 25 / 2 AS x FROM lineitem),
s AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx FROM r),
z AS (SELECT r.*, (x - mx) / sx AS zx FROM r, s),
g AS (SELECT customer, count(*)::DOUBLE AS n, sum(zx) AS z1, sum(y) AS y1 FROM z GROUP BY 1),
w AS (SELECT sum((zx - z1 / n) * (y - y1 / n)) / sum((zx - z1 / n) * (zx - z1 / n)) AS b FROM z JOIN g USING (customer)),
t AS (SELECT count(*)::DOUBLE AS n, sum(zx) AS z1, sum(zx * zx) AS zz, sum(y) AS y1, sum(zx * y) AS zy FROM z),
e AS (SELECT sum(n * n / (n + 10)) AS nn, sum(n * z1 / (n + 10)) AS nz, sum(z1 * z1 / (n + 10)) AS zz,
             sum(n * y1 / (n + 10)) AS ny, sum(z1 * y1 / (n + 10)) AS zy FROM g),
c AS (SELECT t.n - e.nn AS s00, t.z1 - e.nz AS s01, t.zz + 10 - e.zz AS s11, t.y1 - e.ny AS r0, t.zy - e.zy AS r1 FROM t, e),
b AS (SELECT (s11 * r0 - s01 * r1) / (s00 * s11 - s01 * s01) AS b0, (s00 * r1 - s01 * r0) / (s00 * s11 - s01 * s01) AS b1 FROM c)
SELECT z.customer, count(*) AS row_count, round(sum((y1 / n + b * (zx - z1 / n)) * line_no), 2) AS baseline_total,
       round(sum((b0 + b1 * zx + (y1 - n * b0 - z1 * b1) / (n + 10)) * line_no), 2) AS ridge_total
FROM z JOIN g USING (customer), w, b GROUP BY 1
"""

ORACLE["train_split_sizes_by_grain"] = with_views(f"""
g AS (SELECT 'row' AS grain, count(*) AS n FROM ledger
      UNION ALL SELECT 'day_segment', count(*) FROM (SELECT DISTINCT order_date, {", ".join(DIMS)} FROM ledger)
      UNION ALL SELECT 'row_by_date', count(*) FROM ledger)
SELECT grain, 'test' AS split, CAST(ceil(n / 4.0) AS BIGINT) AS n_rows FROM g
UNION ALL
SELECT grain, 'train' AS split, CAST(n - ceil(n / 4.0) AS BIGINT) AS n_rows FROM g
""")

# two-digit years are of this century
ORACLE["stored_factors_monthly"] = with_views(f"""
x AS (SELECT 1)
SELECT CAST(CASE WHEN year(month) < 2000 THEN month + INTERVAL 100 YEAR ELSE month END AS DATE) AS month, {rnd([f for f in FACTORS if f != "unemployment"], 4)} FROM factors
""")

ORACLE["factors_from_batch"] = with_views(f"""{JOINED}
SELECT DISTINCT month, {rnd(FACTORS, 4)}, '{",".join(FACTORS)}' AS found FROM joined WHERE cci IS NOT NULL
""")

ORACLE["year_month_dates"] = with_views("""x AS (SELECT 1)
SELECT CASE WHEN order_id % 17 = 0 OR order_id % 11 = 0 THEN NULL ELSE month END AS month, count(*) AS row_count FROM ledger GROUP BY 1
""")

ORACLE["numeric_columns"] = with_views("""x AS (SELECT 1)
SELECT order_id, line_no, CAST(line_no AS DOUBLE) AS units, CASE WHEN order_id % 7 <> 0 THEN CAST(order_id AS DOUBLE) END AS reference,
       CAST(line_no AS VARCHAR) || CASE WHEN order_id % 32 = 0 THEN 'b' ELSE '' END AS code
FROM ledger
""")

ORACLE["dataset_order"] = f"""WITH {_DS}
SELECT id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY uploaded_at DESC, id DESC) AS INTEGER) AS position FROM ds"""

ORACLE["region_order"] = with_views("""x AS (SELECT 1)
SELECT region, CAST(row_number() OVER (ORDER BY sum(total_revenue) DESC) AS INTEGER) AS position FROM ledger GROUP BY region
""")

ORACLE["factor_month_order"] = with_views("""x AS (SELECT 1)
SELECT month, CAST(row_number() OVER (ORDER BY month) AS INTEGER) AS position FROM factors
""")
