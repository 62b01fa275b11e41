"""DuckDB SQL equivalents of the catalogue queries (the correctness oracle).

Written independently from SURVEY §2 semantics over the raw test tables:
the adapter (FIXTURES §4) is a chain of CTEs, then each query is plain SQL.
Sums of money over detail rows use DECIMAL(28,6), as the Spark side does.
"""

from __future__ import annotations

# --- fixed values mirrored from the adapter / config ------------------------
M_START, M_END = "DATE '1998-06-01'", "DATE '1998-07-01'"
R_START, F_START = "DATE '1997-12-01'", "DATE '1997-06-01'"
DAYS, RECENT_DAYS, FALLBACK_DAYS = 30, 182, 183
# model parameters: month, windows (start / inclusive end), day counts, toggles
P_JUNE = dict(m_start="1998-06-01", m_end="1998-07-01", r_start="1997-12-01", r_end="1998-05-31",
              f_start="1997-06-01", f_end="1997-11-30", days=30, rdays=182, fdays=183,
              live_only=True, zero_rule=True)
P_TOGGLES_OFF = dict(P_JUNE, live_only=False, zero_rule=False)
P_FEB = dict(m_start="1998-02-01", m_end="1998-03-01", r_start="1997-08-01", r_end="1998-01-31",
             f_start="1997-02-01", f_end="1997-07-31", days=28, rdays=184, fdays=181,
             live_only=True, zero_rule=True)
TH_SITES = ("wh-bkk", "bkk-out", "dmk-out", "hkt-out", "cnx-out", "bs-hkt", "bs-cnx",
            "mjets-out")
REGION_SITES = ("africa", "america", "asia", "europe", "middle-east")
# ---------------------------------------------------------------------------

SIGN_R = "(CASE WHEN l_returnflag='R' THEN -1 ELSE 1 END)"
SIGN_F = "(CASE WHEN l_linestatus='F' THEN 1 ELSE -1 END)"


def clean_id(x: str) -> str:
    s = f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    s = f"translate({s}, '\"''=', '')"
    s = f"regexp_replace({s}, '\\.0$', '')"
    return f"regexp_replace({s}, '\\s+', '', 'g')"


BASE = f"""
sku_part AS (
  SELECT p_partkey, concat(CASE WHEN p_type='PROMO' THEN 'P' ELSE 'K' END, CAST(p_partkey AS VARCHAR)) AS sku,
         p_name, p_type, p_size, p_brand
  FROM part),
sup_region AS (
  SELECT s_suppkey, s_acctbal, n_name, r_name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
site_map_raw AS (
  SELECT replace(r_name, ' ', '-') AS virtual_location, CAST(s_suppkey AS VARCHAR) AS site,
         CASE WHEN s_acctbal >= 1000 THEN 'X' WHEN s_acctbal >= 500 THEN ' x ' ELSE '' END AS active
  FROM sup_region),
active_clean AS (
  SELECT {clean_id('site')} AS site_code, lower(trim(virtual_location)) AS virtual_site
  FROM site_map_raw WHERE upper(trim(active)) = 'X'),
site_map AS (
  SELECT DISTINCT 'tpch' AS channel, site_code, virtual_site FROM active_clean
  WHERE site_code <> '' AND virtual_site <> ''),
site_map2 AS (
  SELECT DISTINCT channel, site_code, virtual_site FROM (
    SELECT 'tpch' AS channel, site_code, virtual_site FROM active_clean
    UNION ALL SELECT 'tpch2', site_code, virtual_site FROM active_clean
    UNION ALL SELECT 'tpch2', site_code, 'asia-online' FROM active_clean WHERE virtual_site = 'asia')
  WHERE site_code <> '' AND virtual_site <> ''
    AND (channel = 'tpch' OR virtual_site IN ('asia', 'asia-online', 'europe'))),
product AS (
  SELECT sku, p_name AS product_name, CASE WHEN p_size % 3 = 0 THEN 'hide' ELSE 'live' END AS status,
         lower(sku) LIKE 'p%' AS excluded_prefix_p
  FROM sku_part),
orders_n AS (
  SELECT CAST(o_orderdate AS DATE) AS purchase_date, sp.sku, lower(replace(r_name, ' ', '-')) AS stock_code,
         {SIGN_R} * CAST(l_quantity AS DECIMAL(18,2)) AS quantity,
         {SIGN_R} * CAST(l_extendedprice AS DECIMAL(18,2)) AS gross,
         CAST({SIGN_R} * CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
              AS DECIMAL(18,4)) AS net,
         sp.p_name AS product_name, lower(sp.sku) LIKE 'p%' AS excluded_prefix_p
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN sku_part sp ON l_partkey = sp.p_partkey
       JOIN sup_region ON l_suppkey = s_suppkey),
stock_n AS (
  SELECT CAST(l_shipdate AS DATE) AS posting_date, CAST(l_suppkey AS VARCHAR) AS site_code, sp.sku,
         {SIGN_F} * CAST(l_quantity AS DECIMAL(18,2)) AS stock_balance,
         lower(sp.sku) LIKE 'p%' AS excluded_prefix_p
  FROM lineitem JOIN sku_part sp ON l_partkey = sp.p_partkey),
universe AS (
  SELECT DISTINCT sku, product_name FROM product
  WHERE NOT excluded_prefix_p
    AND (status = 'live' OR NOT EXISTS (SELECT 1 FROM product WHERE NOT excluded_prefix_p AND status = 'live'))),
window_sales AS (
  SELECT sku, stock_code AS virtual_site,
    CAST(coalesce(sum(quantity) FILTER (WHERE purchase_date >= {R_START} AND purchase_date < {M_START}), 0) AS DOUBLE) AS recent_qty,
    CAST(coalesce(sum(quantity) FILTER (WHERE purchase_date >= {F_START} AND purchase_date < {R_START}), 0) AS DOUBLE) AS fallback_qty,
    CAST(coalesce(sum(quantity) FILTER (WHERE purchase_date >= {M_START} AND purchase_date < {M_END}), 0) AS DOUBLE) AS actual_qty_jan,
    count(*) FILTER (WHERE purchase_date >= {R_START} AND purchase_date < {M_START}) AS recent_rows,
    count(*) FILTER (WHERE purchase_date >= {F_START} AND purchase_date < {R_START}) AS fallback_rows
  FROM orders_n WHERE NOT excluded_prefix_p AND purchase_date >= {F_START} AND purchase_date < {M_END}
  GROUP BY sku, stock_code)
"""


def baseline_cols(q: str = "", p: dict = P_JUNE) -> str:
    """Baseline choice columns from recent_qty / fallback_qty (prefix ``q``)."""
    r, f = f"{q}recent_qty", f"{q}fallback_qty"
    use_r = f"({r} > 0)"
    use_f = f"(NOT ({r} > 0) AND {f} > 0)"
    days = (f"CAST(CASE WHEN {use_r} THEN {p['rdays']} WHEN {use_f} THEN {p['fdays']} "
            f"ELSE 0 END AS INTEGER)")
    qty = f"(CASE WHEN {use_r} THEN {r} WHEN {use_f} THEN {f} ELSE 0.0 END)"
    return f"""
    'rolling_6m_with_6m_fallback' AS baseline_method,
    CASE WHEN {use_r} THEN 'recent_6m' WHEN {use_f} THEN 'fallback_prev_6m' ELSE 'no_history' END AS baseline_source,
    CASE WHEN {use_r} THEN '{p['r_start']}' WHEN {use_f} THEN '{p['f_start']}' ELSE '' END AS baseline_window_start,
    CASE WHEN {use_r} THEN '{p['r_end']}' WHEN {use_f} THEN '{p['f_end']}' ELSE '' END AS baseline_window_end,
    {days} AS baseline_window_days,
    {qty} AS baseline_qty_window,
    CASE WHEN {days} > 0 THEN {qty} / {days} ELSE 0.0 END AS baseline_daily_qty"""


def model_ctes(site_map: str = "site_map", p: dict = P_JUNE) -> str:
    """site_sales / price / day_bal / day_counts / detail for parameters ``p``."""
    ms, me = f"DATE '{p['m_start']}'", f"DATE '{p['m_end']}'"
    rs, fs = f"DATE '{p['r_start']}'", f"DATE '{p['f_start']}'"
    days = p["days"]
    live = ("AND (status = 'live' OR NOT EXISTS (SELECT 1 FROM product "
            "WHERE NOT excluded_prefix_p AND status = 'live'))") if p["live_only"] else ""
    lost = ("CASE WHEN actual_qty_jan <= 0.0 THEN baseline_daily_qty * oos_days_jan ELSE 0.0 END"
            if p["zero_rule"] else "baseline_daily_qty * oos_days_jan")
    return f"""
site_sales AS (
  SELECT sku, stock_code AS virtual_site,
    CAST(coalesce(sum(quantity) FILTER (WHERE purchase_date >= {rs} AND purchase_date < {ms}), 0) AS DOUBLE) AS recent_qty,
    CAST(coalesce(sum(quantity) FILTER (WHERE purchase_date >= {fs} AND purchase_date < {rs}), 0) AS DOUBLE) AS fallback_qty,
    CAST(coalesce(sum(quantity) FILTER (WHERE purchase_date >= {ms} AND purchase_date < {me}), 0) AS DOUBLE) AS actual_qty_jan,
    sum(quantity) AS tq, sum(gross) AS tg, sum(net) AS tn, min(product_name) AS first_name
  FROM orders_n WHERE NOT excluded_prefix_p GROUP BY sku, stock_code),
price AS (
  SELECT sku, min(first_name) AS product_name,
    CASE WHEN CAST(sum(tq) AS DOUBLE) > 0 THEN CAST(sum(tg) AS DOUBLE) / CAST(sum(tq) AS DOUBLE) ELSE 0.0 END AS gross_per_unit,
    CASE WHEN CAST(sum(tq) AS DOUBLE) > 0 THEN CAST(sum(tn) AS DOUBLE) / CAST(sum(tq) AS DOUBLE) ELSE 0.0 END AS net_per_unit
  FROM site_sales GROUP BY sku),
uni_m AS (
  SELECT DISTINCT sku, product_name FROM product WHERE NOT excluded_prefix_p {live}),
day_bal AS (
  SELECT m.channel, s.posting_date, s.sku, m.virtual_site, sum(s.stock_balance) AS stock_balance
  FROM stock_n s JOIN {site_map} m ON s.site_code = m.site_code
  WHERE s.posting_date >= {ms} AND s.posting_date < {me} AND NOT s.excluded_prefix_p
  GROUP BY m.channel, s.posting_date, s.sku, m.virtual_site),
day_counts AS (
  SELECT channel, sku, virtual_site,
         CAST(count(*) FILTER (WHERE stock_balance > 0) AS INTEGER) AS in_stock_days,
         CAST(count(*) AS INTEGER) AS recorded_days
  FROM day_bal GROUP BY channel, sku, virtual_site),
grid AS (
  SELECT s.channel, u.sku, coalesce(u.product_name, p.product_name) AS product_name, s.virtual_site,
         coalesce(p.gross_per_unit, 0.0) AS gross_per_unit, coalesce(p.net_per_unit, 0.0) AS net_per_unit
  FROM uni_m u LEFT JOIN price p ON u.sku = p.sku
  CROSS JOIN (SELECT DISTINCT channel, virtual_site FROM {site_map}) s),
d0 AS (
  SELECT g.*, coalesce(c.in_stock_days, 0) AS in_stock_days, coalesce(c.recorded_days, 0) AS recorded_days,
         coalesce(ss.recent_qty, 0.0) AS recent_qty, coalesce(ss.fallback_qty, 0.0) AS fallback_qty,
         coalesce(ss.actual_qty_jan, 0.0) AS actual_qty_jan
  FROM grid g
  LEFT JOIN day_counts c ON c.channel = g.channel AND c.sku = g.sku AND c.virtual_site = g.virtual_site
  LEFT JOIN site_sales ss ON ss.sku = g.sku AND ss.virtual_site = g.virtual_site),
d1 AS (
  SELECT *, {days} AS observed_days_jan, CAST(greatest({days} - in_stock_days, 0) AS INTEGER) AS oos_days_jan,
         {baseline_cols("", p)}
  FROM d0),
d2 AS (
  SELECT *, CAST(oos_days_jan AS DOUBLE) / CAST(observed_days_jan AS DOUBLE) AS oos_ratio_jan,
         baseline_daily_qty * {days} AS expected_qty_jan,
         actual_qty_jan <= 0.0 AS is_actual_zero_jan,
         {lost} AS lost_qty_raw
  FROM d1),
detail_c AS (
  SELECT channel, sku, product_name, virtual_site, observed_days_jan, recorded_days, in_stock_days,
         oos_days_jan, oos_ratio_jan, baseline_method, baseline_source, baseline_window_start,
         baseline_window_end, baseline_window_days, recent_qty, fallback_qty, baseline_qty_window,
         baseline_daily_qty, expected_qty_jan, actual_qty_jan, is_actual_zero_jan,
         greatest(expected_qty_jan - actual_qty_jan, 0) AS qty_gap_jan, lost_qty_raw,
         gross_per_unit, net_per_unit,
         lost_qty_raw * gross_per_unit AS lost_value_gross_raw,
         lost_qty_raw * net_per_unit AS lost_value_net_raw,
         lost_qty_raw AS lost_qty, lost_qty_raw * gross_per_unit AS loss_gross,
         lost_qty_raw * net_per_unit AS loss_net
  FROM d2),
detail AS (SELECT * EXCLUDE (channel) FROM detail_c),
unmapped AS (
  SELECT s.site_code, count(*) AS "rows" FROM stock_n s
  WHERE s.posting_date >= {ms} AND s.posting_date < {me} AND NOT s.excluded_prefix_p
    AND NOT EXISTS (SELECT 1 FROM {site_map} m WHERE m.site_code = s.site_code)
  GROUP BY s.site_code)
"""


def xsum(c: str) -> str:
    return f"CAST(sum(CAST({c} AS DECIMAL(28,6))) AS DOUBLE)"


MEASURES = ["lost_qty_raw", "lost_value_gross_raw", "lost_value_net_raw", "loss_gross", "loss_net"]

REPORT_CTES = f"""
summary_total AS (
  SELECT 'Total Lost Qty Raw' AS metric, coalesce({xsum('lost_qty_raw')}, 0.0) AS value FROM detail
  UNION ALL SELECT 'Total Lost Value Gross Raw', coalesce({xsum('lost_value_gross_raw')}, 0.0) FROM detail
  UNION ALL SELECT 'Total Lost Value Net Raw', coalesce({xsum('lost_value_net_raw')}, 0.0) FROM detail),
summary_site AS (
  SELECT virtual_site, count(*) AS sku_site_rows_eval,
         CAST(sum(oos_days_jan) AS DOUBLE) / CAST(count(*) AS DOUBLE) / max(observed_days_jan) AS avg_oos_ratio,
         {', '.join(f'{xsum(m)} AS {m}' for m in MEASURES)}
  FROM detail GROUP BY virtual_site),
summary_sku AS (
  SELECT sku, min(product_name) AS product_name,
         {', '.join(f'{xsum(m)} AS {m}' for m in MEASURES)},
         {', '.join(f'coalesce(sum(CASE WHEN virtual_site = {s!r} THEN loss_net END), 0.0) AS "loss_net_{s}"' for s in REGION_SITES)}
  FROM detail GROUP BY sku),
qa AS (
  SELECT 1 AS seq, 'product_sku_count_all' AS metric, CAST(count(DISTINCT sku) AS DOUBLE) AS value FROM product
  UNION ALL SELECT 2, 'product_sku_count_excl_prefix_p', CAST(count(DISTINCT CASE WHEN NOT excluded_prefix_p THEN sku END) AS DOUBLE) FROM product
  UNION ALL SELECT 3, 'product_sku_count_live_excl_prefix_p', CAST(count(DISTINCT sku) AS DOUBLE) FROM universe
  UNION ALL SELECT 4, 'sku_universe_count', CAST(count(DISTINCT sku) AS DOUBLE) FROM universe
  UNION ALL SELECT 5, 'daily_stock_rows_eval_month', CAST(count(*) AS DOUBLE) FROM day_bal
  UNION ALL SELECT 6, 'mapped_site_codes_count', CAST(count(DISTINCT site_code) AS DOUBLE) FROM site_map
  UNION ALL SELECT 7, 'unmapped_site_code_count', CAST(count(*) AS DOUBLE) FROM unmapped
  UNION ALL SELECT 8, 'detail_rows', CAST(count(*) AS DOUBLE) FROM detail
  UNION ALL SELECT 9, 'config_baseline_recent_months', 6.0
  UNION ALL SELECT 10, 'config_baseline_fallback_months', 6.0
  UNION ALL SELECT 11, 'detail_rows_baseline_recent', CAST(count(*) FILTER (WHERE baseline_source = 'recent_6m') AS DOUBLE) FROM detail
  UNION ALL SELECT 12, 'detail_rows_baseline_fallback', CAST(count(*) FILTER (WHERE baseline_source = 'fallback_prev_6m') AS DOUBLE) FROM detail
  UNION ALL SELECT 13, 'detail_rows_baseline_no_history', CAST(count(*) FILTER (WHERE baseline_source = 'no_history') AS DOUBLE) FROM detail
  UNION ALL SELECT 14, 'detail_rows_actual_zero', CAST(count(*) FILTER (WHERE is_actual_zero_jan) AS DOUBLE) FROM detail
  UNION ALL SELECT 15, 'detail_rows_actual_gt_zero', CAST(count(*) FILTER (WHERE NOT is_actual_zero_jan) AS DOUBLE) FROM detail
  UNION ALL SELECT 16, 'config_loss_only_when_actual_zero', 1.0
  UNION ALL SELECT 17, 'total_lost_value_net_raw', coalesce({xsum('lost_value_net_raw')}, 0.0) FROM detail
  UNION ALL SELECT 18, 'excluded_prefix_p_products', CAST(count(*) FILTER (WHERE excluded_prefix_p) AS DOUBLE) FROM product
  UNION ALL SELECT 19, 'excluded_prefix_p_orders', CAST(count(*) FILTER (WHERE excluded_prefix_p) AS DOUBLE) FROM orders_n
  UNION ALL SELECT 20, 'excluded_prefix_p_daily_stock', CAST(count(*) FILTER (WHERE excluded_prefix_p) AS DOUBLE) FROM stock_n),
calc_top AS (
  SELECT * FROM detail ORDER BY (lost_qty_raw > 0) DESC, loss_net DESC, sku, virtual_site LIMIT 1),
calc AS (
  SELECT 1 AS seq, 'Sample row' AS item, 'highest loss_net row in Detail' AS formula,
         concat('SKU ', sku, ' | Site ', virtual_site) AS value FROM calc_top
  UNION ALL SELECT 2, 'Input: baseline_source', '-', baseline_source FROM calc_top
  UNION ALL SELECT 3, 'Input: recent_qty', '-', printf('%.6f', recent_qty) FROM calc_top
  UNION ALL SELECT 4, 'Input: fallback_qty', '-', printf('%.6f', fallback_qty) FROM calc_top
  UNION ALL SELECT 5, 'Input: baseline_window_qty', '-', printf('%.6f', baseline_qty_window) FROM calc_top
  UNION ALL SELECT 6, 'Input: baseline_window_days', '-', printf('%.6f', CAST(baseline_window_days AS DOUBLE)) FROM calc_top
  UNION ALL SELECT 7, 'Input: observed_days', '-', printf('%.6f', CAST(observed_days_jan AS DOUBLE)) FROM calc_top
  UNION ALL SELECT 8, 'Input: in_stock_days', '-', printf('%.6f', CAST(in_stock_days AS DOUBLE)) FROM calc_top
  UNION ALL SELECT 9, 'Input: actual_qty', '-', printf('%.6f', actual_qty_jan) FROM calc_top
  UNION ALL SELECT 10, 'Step 1 baseline_daily_qty', 'baseline_window_qty / baseline_window_days', printf('%.6f', baseline_daily_qty) FROM calc_top
  UNION ALL SELECT 11, 'Step 2 oos_days', 'observed_days - in_stock_days', printf('%.6f', CAST(oos_days_jan AS DOUBLE)) FROM calc_top
  UNION ALL SELECT 12, 'Step 3 preliminary_lost_qty', 'baseline_daily_qty * oos_days', printf('%.6f', baseline_daily_qty * CAST(oos_days_jan AS DOUBLE)) FROM calc_top
  UNION ALL SELECT 13, 'Step 4 apply actual-zero rule', 'if actual_qty > 0 then lost_qty_raw=0 else keep Step 3', printf('%.6f', lost_qty_raw) FROM calc_top
  UNION ALL SELECT 14, 'Input: net_per_unit', '-', printf('%.6f', net_per_unit) FROM calc_top
  UNION ALL SELECT 15, 'Input: gross_per_unit', '-', printf('%.6f', gross_per_unit) FROM calc_top
  UNION ALL SELECT 16, 'Step 5 loss_net', 'lost_qty_raw * net_per_unit', printf('%.6f', loss_net) FROM calc_top
  UNION ALL SELECT 17, 'Step 6 loss_gross', 'lost_qty_raw * gross_per_unit', printf('%.6f', loss_gross) FROM calc_top
  UNION ALL SELECT 1, 'No sample row', '-', 'Detail sheet is empty' WHERE NOT EXISTS (SELECT 1 FROM detail))
"""

# snapshot adapter + query
SNAPSHOT_CTES = f"""
wh AS (
  SELECT CAST(l_shipdate AS DATE) AS posting_date, CAST(l_suppkey AS VARCHAR) AS site_code, n_name AS location,
         sp.sku AS article_code, sp.p_name AS latest_article_description,
         {SIGN_F} * CAST(l_quantity AS DECIMAL(18,2)) AS stock_balance
  FROM lineitem JOIN sku_part sp ON l_partkey = sp.p_partkey
       JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
ch_sites AS (
  SELECT DISTINCT lower(replace(r_name, ' ', '-')) AS channel, CAST(s_suppkey AS VARCHAR) AS site_code
  FROM sup_region),
sku_f AS (
  SELECT DISTINCT trim(sku) AS article_code FROM product WHERE status = 'live' AND trim(sku) <> ''),
snap AS (
  SELECT c.channel, w.posting_date, w.site_code, w.location, w.article_code, w.latest_article_description,
         CAST(sum(w.stock_balance) AS DOUBLE) AS stock_balance
  FROM wh w JOIN ch_sites c ON w.site_code = c.site_code
  WHERE w.posting_date BETWEEN DATE '1998-06-01' AND DATE '1998-06-30'
    AND w.article_code IN (SELECT article_code FROM sku_f)
  GROUP BY c.channel, w.posting_date, w.site_code, w.location, w.article_code, w.latest_article_description)
"""


def sql(final: str, site_map: str = "site_map", extra: str = "", p: dict = P_JUNE) -> str:
    parts = [BASE, model_ctes(site_map, p), REPORT_CTES, SNAPSHOT_CTES]
    if extra:
        parts.append(extra)
    return "WITH " + ",\n".join(p.strip().rstrip(",") for p in parts) + "\n" + final


MSG = {
    "multi": "Detected data from multiple months in the uploaded file.",
    "empty": "The file parsed successfully but contains no data rows.",
    "near": "The file parsed successfully but contains very few rows.",
    "no_active": "The site-mapping file does not contain any active rows marked with 'X'.",
    "no_channel_th": ("The site-mapping file does not contain any active TH virtual locations. "
                      "Check that the uploaded workbook matches the selected channel."),
}

FINDINGS_CTE = f"""
findings AS (
  SELECT 'sales' AS dataset, 'warning' AS severity, 'empty_dataset' AS code, '{MSG['empty']}' AS message
    WHERE (SELECT count(*) FROM orders_n) = 0
  UNION ALL SELECT 'sales', 'warning', 'near_empty_dataset', '{MSG['near']}' WHERE (SELECT count(*) FROM orders_n) = 1
  UNION ALL SELECT 'sales', 'warning', 'multiple_month_hints', '{MSG['multi']}'
    WHERE (SELECT count(DISTINCT strftime(purchase_date, '%Y-%m')) FROM orders_n) > 1
  UNION ALL SELECT 'stock', 'warning', 'empty_dataset', '{MSG['empty']}' WHERE (SELECT count(*) FROM stock_n) = 0
  UNION ALL SELECT 'stock', 'warning', 'near_empty_dataset', '{MSG['near']}' WHERE (SELECT count(*) FROM stock_n) = 1
  UNION ALL SELECT 'stock', 'warning', 'multiple_month_hints', '{MSG['multi']}'
    WHERE (SELECT count(DISTINCT strftime(posting_date, '%Y-%m')) FROM stock_n) > 1
  UNION ALL SELECT 'sku_live', 'warning', 'empty_dataset', '{MSG['empty']}' WHERE (SELECT count(*) FROM product) = 0
  UNION ALL SELECT 'sku_live', 'warning', 'near_empty_dataset', '{MSG['near']}' WHERE (SELECT count(*) FROM product) = 1
  UNION ALL SELECT 'site_mapping', 'error', 'site_mapping_no_active_rows', '{MSG['no_active'].replace("'", "''")}'
    WHERE (SELECT count(*) FROM site_map_raw WHERE upper(trim(active)) = 'X') = 0
  UNION ALL SELECT 'site_mapping', 'warning', 'near_empty_dataset', '{MSG['near']}'
    WHERE (SELECT count(*) FROM site_map_raw WHERE upper(trim(active)) = 'X') > 0
      AND (SELECT count(*) FROM site_map_raw) <= 1
  UNION ALL SELECT 'site_mapping_th', 'error', 'site_mapping_no_active_rows', '{MSG['no_active'].replace("'", "''")}'
    WHERE (SELECT count(*) FROM site_map_raw WHERE upper(trim(active)) = 'X') = 0
  UNION ALL SELECT 'site_mapping_th', 'error', 'site_mapping_no_channel_rows', '{MSG['no_channel_th']}'
    WHERE (SELECT count(*) FROM site_map_raw WHERE upper(trim(active)) = 'X') > 0
      AND (SELECT count(*) FROM site_map_raw WHERE upper(trim(active)) = 'X'
           AND lower(trim(virtual_location)) IN {TH_SITES!r}) = 0
  UNION ALL SELECT 'site_mapping_th', 'warning', 'near_empty_dataset', '{MSG['near']}'
    WHERE (SELECT count(*) FROM site_map_raw WHERE upper(trim(active)) = 'X'
           AND lower(trim(virtual_location)) IN {TH_SITES!r}) > 0
      AND (SELECT count(*) FROM site_map_raw) <= 1)
"""


BROKEN_CTE = f"""
broken AS (
  SELECT * FROM findings WHERE dataset IN ('site_mapping', 'site_mapping_th')
  UNION ALL SELECT 'sales', 'warning', 'multiple_month_hints', '{MSG['multi']}'
    WHERE (SELECT count(DISTINCT strftime(purchase_date, '%Y-%m')) FROM orders_n WHERE quantity >= 0) > 1
  UNION ALL SELECT 'sales', 'warning', 'unparsed_dates',
         (SELECT CAST(count(*) AS VARCHAR) FROM orders_n WHERE quantity < 0)
         || ' value(s) of Purchase Date are no date in any accepted layout.'
    WHERE (SELECT count(*) FROM orders_n WHERE quantity < 0) > 0
  UNION ALL SELECT 'stock', 'error', 'missing_required_columns', 'Missing required columns: article_code'
  UNION ALL SELECT 'suppliers', 'error', 'unknown_slot', 'Validation does not support upload slot ''suppliers''.')
"""


def months_text(table: str, col: str) -> str:
    return (f"(SELECT coalesce(string_agg(m, ',' ORDER BY m), '') FROM "
            f"(SELECT DISTINCT strftime({col}, '%Y-%m') AS m FROM {table} WHERE {col} IS NOT NULL))")


def _b6(x: str) -> str:
    v = f"TRY_CAST(replace({x}, ',', '') AS DOUBLE)"
    return f"coalesce(CASE WHEN isnan({v}) THEN 0.0 ELSE {v} END, 0.0)"


def _b7(x: str) -> str:
    v = f"TRY_CAST({x} AS DOUBLE)"
    return f"coalesce(CASE WHEN isnan({v}) THEN 0.0 ELSE {v} END, 0.0)"


def _best_date(table: str, x: str, mf: str, df: str) -> str:
    a, b = f"try_strptime({x}, '{mf}')", f"try_strptime({x}, '{df}')"
    return (f"CAST(CASE WHEN (SELECT count({b}) > count({a}) FROM {table}) THEN {b} ELSE {a} END AS DATE)")


PARSE_DATES = f"""
WITH raw AS (
  SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS day_first_text,
         strftime(o_orderdate, '%m/%d/%Y') AS month_first_text FROM orders)
SELECT o_orderkey, day_first_text, month_first_text,
       {_best_date('raw', 'day_first_text', '%m.%d.%Y', '%d.%m.%Y')} AS day_first_date,
       {_best_date('raw', 'month_first_text', '%m/%d/%Y', '%d/%m/%Y')} AS month_first_date
FROM raw
"""

PARSE_NUMBERS = f"""
SELECT l_orderkey, l_linenumber, raw_text, {_b6('raw_text')} AS value_commas_removed,
       {_b7('raw_text')} AS value_plain
FROM (SELECT l_orderkey, l_linenumber,
             CASE WHEN l_returnflag = 'R' THEN 'nan'
                  ELSE concat('1,', lpad(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), 3, '0')) END AS raw_text
      FROM lineitem)
"""

_RANK = ("row_number() OVER (PARTITION BY sku ORDER BY "
         "CASE status WHEN 'live' THEN 2 WHEN 'hide' THEN 1 ELSE 0 END DESC, "
         "CASE WHEN trim(coalesce(product_name, '')) <> '' THEN 1 ELSE 0 END DESC, sheet_name ASC)")


def _name_choice(table: str, cands: list[str]) -> str:
    """B15 in SQL: the first candidate column with any non-blank value."""
    expr = "''"
    for c in reversed(cands):
        expr = (f"CASE WHEN (SELECT bool_or(trim(coalesce({c}, '')) <> '') FROM {table}) "
                f"THEN coalesce({c}, '') ELSE {expr} END")
    return expr


def queries_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["clean_ids"] = sql(f"""
SELECT p_partkey AS part_key, raw_id, {clean_id('raw_id')} AS sku,
       lower({clean_id('raw_id')}) LIKE 'p%' AS excluded_prefix_p
FROM (SELECT p_partkey, concat('="', sku, '.0" ') AS raw_id FROM sku_part)""")
    q["parse_numbers"] = PARSE_NUMBERS
    q["parse_dates_best"] = PARSE_DATES
    q["site_map"] = sql("SELECT site_code, virtual_site FROM site_map")
    q["site_map_expanded"] = sql(
        "SELECT site_code, virtual_site FROM site_map2 WHERE channel = 'tpch2'")
    q["site_map_status"] = sql("""
SELECT count(*) > 0 AS is_ready, count(*) AS active_mapping_rows,
       count(DISTINCT site_code) AS site_count, count(DISTINCT virtual_site) AS virtual_site_count,
       coalesce((SELECT string_agg(virtual_site, ',' ORDER BY virtual_site) FROM
                 (SELECT DISTINCT virtual_site FROM site_map ORDER BY virtual_site LIMIT 5)), '')
         AS sample_virtual_sites
FROM site_map""")
    q["product_first"] = sql("SELECT sku, product_name, status, excluded_prefix_p FROM product")
    q["product_ranked_merge"] = sql(f"""
SELECT sku, product_name, status, lower(sku) LIKE 'p%' AS excluded_prefix_p FROM (
  SELECT *, {_RANK} AS rn FROM (
    SELECT sku, p_name AS product_name,
           CASE WHEN p_size % 3 = 0 THEN 'hide' ELSE 'live' END AS status, 'click&collect' AS sheet_name
    FROM sku_part
    UNION ALL
    SELECT sku, CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN '' ELSE concat(p_name, ' HD') END,
           CASE WHEN p_type IN ('SMALL', 'LARGE') THEN 'live' ELSE 'hide' END, 'HomeDelivery'
    FROM sku_part WHERE p_size > 25))
WHERE rn = 1""")
    q["product_name_column"] = sql(f"""
SELECT 'sheet_x' AS sheet_name, sku, {_name_choice('sheet_x', ['c_cn', 'description', 'c_en'])} AS product_name
FROM sheet_x
UNION ALL
SELECT 'sheet_y', sku, {_name_choice('sheet_y', ['c_zh', 'description'])} FROM sheet_y""",
        extra="""
sheet_x AS (SELECT sku, '' AS c_cn, p_name AS description, upper(p_name) AS c_en FROM sku_part),
sheet_y AS (SELECT sku, p_brand AS c_zh, p_name AS description FROM sku_part)""")
    q["orders_norm"] = sql("""
SELECT purchase_date, sku, stock_code, CAST(quantity AS DOUBLE) AS quantity, CAST(gross AS DOUBLE) AS gross,
       CAST(net AS DOUBLE) AS net, product_name, excluded_prefix_p
FROM orders_n""")
    q["orders_append_distinct"] = sql("""
SELECT DISTINCT purchase_date, sku, stock_code, CAST(quantity AS DOUBLE) AS quantity,
       CAST(gross AS DOUBLE) AS gross, CAST(net AS DOUBLE) AS net, product_name, excluded_prefix_p
FROM orders_n""")
    q["universe"] = sql("SELECT sku, product_name FROM universe")
    q["universe_no_live"] = sql(
        "SELECT DISTINCT sku, product_name FROM product WHERE NOT excluded_prefix_p")
    q["day_balance"] = sql("""
SELECT posting_date, sku, virtual_site, CAST(stock_balance AS DOUBLE) AS stock_balance FROM day_bal""")
    q["oos_days"] = sql("""
SELECT sku, virtual_site, observed_days_jan, recorded_days, in_stock_days, oos_days_jan, oos_ratio_jan
FROM detail""")
    q["window_sales"] = sql(
        "SELECT sku, virtual_site, recent_qty, fallback_qty, actual_qty_jan FROM window_sales")
    q["baseline"] = sql(f"""
SELECT sku, virtual_site, {baseline_cols()}, recent_qty, fallback_qty
FROM window_sales WHERE recent_rows + fallback_rows > 0""")
    q["unit_price"] = sql("SELECT sku, product_name, gross_per_unit, net_per_unit FROM price")
    q["loss_detail"] = sql("SELECT * FROM detail")
    q["loss_detail_two_channels"] = sql("SELECT * FROM detail_c", site_map="site_map2")
    q["loss_detail_toggles_off"] = sql("SELECT * FROM detail", p=P_TOGGLES_OFF)
    q["loss_detail_feb"] = sql("SELECT * FROM detail", p=P_FEB)
    q["unmapped_sites"] = sql('SELECT site_code, "rows" FROM unmapped')
    q["summary_total"] = sql("SELECT metric, value FROM summary_total")
    q["summary_site"] = sql("SELECT * FROM summary_site")
    q["summary_sku_pivot"] = sql("SELECT * FROM summary_sku")
    q["top_sites"] = sql(
        "SELECT * FROM summary_site ORDER BY lost_value_net_raw DESC, virtual_site LIMIT 5")
    q["top_skus"] = sql("SELECT * FROM summary_sku ORDER BY lost_value_net_raw DESC, sku LIMIT 5")
    q["calc_example"] = sql("SELECT seq, item, formula, value FROM calc")
    q["qa_summary"] = sql("SELECT seq, metric, value FROM qa")
    q["input_profile"] = sql(f"""
SELECT 'sales' AS dataset, count(*) AS row_count, 'Purchase Date' AS date_field,
       min(purchase_date) AS min_date, max(purchase_date) AS max_date,
       {months_text('orders_n', 'purchase_date')} AS month_hints FROM orders_n
UNION ALL
SELECT 'stock', count(*), 'posting_date', min(posting_date), max(posting_date),
       {months_text('stock_n', 'posting_date')} FROM stock_n""")
    q["input_findings"] = sql("SELECT dataset, severity, code, message FROM findings",
                              extra=FINDINGS_CTE)
    q["quality_gate"] = sql(GATE, extra=FINDINGS_CTE.rstrip() + "," + gate_ctes(
        "findings", [("sales", 1), ("stock", 1), ("sku_live", 1), ("site_mapping", 1), ("site_mapping_th", 1)]))
    q["input_findings_broken"] = sql("SELECT dataset, severity, code, message FROM broken",
                                     extra=FINDINGS_CTE.rstrip() + "," + BROKEN_CTE)
    q["quality_gate_broken"] = sql(GATE, extra=FINDINGS_CTE.rstrip() + "," + BROKEN_CTE.rstrip() + "," + gate_ctes(
        "broken", [("sales", 1), ("stock", 1), ("sku_live", 0), ("site_mapping", 1), ("suppliers", 1)]))
    q["month_suggestion"] = sql("""
SELECT CASE WHEN n = 1 THEN CAST(substr(hints, 1, 4) AS INTEGER) END AS eval_year,
       CASE WHEN n = 1 THEN CAST(substr(hints, 6, 2) AS INTEGER) END AS eval_month,
       n = 1 AS is_confident, hints AS month_hints,
       CASE WHEN n = 1 THEN 'Detected one calendar month in the staged stock file.'
            WHEN n = 0 THEN 'The staged stock file did not contain any parseable posting dates.'
            ELSE 'The staged stock file spans multiple months. Choose the evaluation month manually.' END AS reason
FROM (SELECT count(*) AS n, coalesce(string_agg(m, ',' ORDER BY m), '') AS hints
      FROM (SELECT DISTINCT strftime(posting_date, '%Y-%m') AS m FROM stock_n))""")
    totals = """
SELECT (SELECT value FROM summary_total WHERE metric = 'Total Lost Qty Raw') AS total_lost_qty_raw,
       (SELECT value FROM summary_total WHERE metric = 'Total Lost Value Gross Raw') AS total_lost_value_gross_raw,
       (SELECT value FROM summary_total WHERE metric = 'Total Lost Value Net Raw') AS total_lost_value_net_raw"""
    q["overview_totals"] = sql(totals)
    q["overview_trust"] = sql("""
SELECT '1998-06' AS period, (SELECT count(*) FROM detail) AS detail_row_count,
       (SELECT count(*) FROM qa) AS qa_summary_row_count, (SELECT count(*) FROM unmapped) AS unmapped_site_count,
       (SELECT coalesce(CAST(sum(CAST(lost_value_net_raw AS DECIMAL(28,6))) AS DOUBLE), 0.0) FROM detail) AS lost_value_net_raw,
       t.*, w.n AS warning_count, true AS is_current,
       concat_ws('; ',
         CASE WHEN w.n > 0 THEN concat(CAST(w.n AS VARCHAR), ' upload warning(s)') END,
         CASE WHEN (SELECT count(*) FROM unmapped) > 0
              THEN concat(CAST((SELECT count(*) FROM unmapped) AS VARCHAR), ' unmapped site row(s)') END)
         AS trust_reasons
FROM (""" + totals + """) t, (SELECT count(*) FILTER (WHERE severity = 'warning') AS n FROM findings) w""",
        extra=FINDINGS_CTE)
    q["run_record"] = sql("""
SELECT 'tpch' AS channel, '1998-06' AS period, true AS ok, 'success' AS status,
       CAST(NULL AS VARCHAR) AS error_type, CAST(NULL AS VARCHAR) AS error_message,
       (SELECT count(*) FROM detail) AS detail_row_count, (SELECT count(*) FROM qa) AS qa_summary_row_count,
       (SELECT count(*) FROM unmapped) AS unmapped_site_count,
       (SELECT coalesce(CAST(sum(CAST(lost_value_net_raw AS DECIMAL(28,6))) AS DOUBLE), 0.0) FROM detail)
         AS lost_value_net_raw""")
    q["stock_snapshot"] = sql("SELECT * FROM snap")
    q["snapshot_summary"] = sql("""
SELECT c.channel, upper(c.channel) AS label, 'Live SKUs' AS sheet_name, 'part' AS input_path,
       concat('snapshot/rows/channel=', c.channel) AS output_csv_path, CAST((SELECT count(*) FROM sku_f) AS BIGINT) AS sku_count,
       CAST(c.site_code_count AS BIGINT) AS site_code_count, CAST(coalesce(r.row_count, 0) AS BIGINT) AS row_count
FROM (SELECT channel, count(*) AS site_code_count FROM ch_sites GROUP BY channel) c
LEFT JOIN (SELECT channel, count(*) AS row_count FROM snap GROUP BY channel) r ON r.channel = c.channel""")
    def contents(dataset: str, table: str, measure: str) -> str:
        return (f"SELECT '{dataset}' AS dataset, count(*) AS \"rows\", "
                f"CAST(sum(CAST(round(CAST({measure} AS DOUBLE), 6) AS DECIMAL(28,6))) AS DOUBLE) AS total FROM {table}")

    q["results_round_trip"] = sql(" UNION ALL ".join(contents(*x) for x in [
        ("detail", "detail", "lost_value_net_raw"), ("unmapped_sites", "unmapped", '"rows"'),
        ("summary_total", "summary_total", "value"), ("summary_site", "summary_site", "lost_value_net_raw"),
        ("summary_sku", "summary_sku", "loss_net"), ("calculation_example", "calc", "seq"),
        ("qa_summary", "qa", "value")]))
    q["loss_detail_own_inputs"] = (
        "SELECT * FROM (" + sql("SELECT * FROM detail_c WHERE channel = 'tpch'", site_map="site_map2")
        + ") UNION ALL SELECT * FROM (" + second_channel() + ")")
    q["unmapped_sites_two_channels"] = sql("""
SELECT c.channel, s.site_code, count(*) AS "rows"
FROM stock_n s, (SELECT DISTINCT channel FROM site_map2) c
WHERE s.posting_date >= DATE '1998-06-01' AND s.posting_date < DATE '1998-07-01' AND NOT s.excluded_prefix_p
  AND NOT EXISTS (SELECT 1 FROM site_map2 m WHERE m.channel = c.channel AND m.site_code = s.site_code)
GROUP BY c.channel, s.site_code""")
    q["channel_keys"] = """
SELECT p_partkey, name, CASE WHEN name IN ('TH') THEN 'th' WHEN name = 't/h t' THEN 'tht'
       WHEN name IN (' king-power CN', 'King_Power_CN', 'KPCN', 'cn') THEN 'kingpowercn' END AS channel
FROM (SELECT p_partkey, ['TH', ' king-power CN', 'King_Power_CN', 't/h t', 'KPCN', 'cn', '', 'lotus', 'th2']
             [p_partkey % 9 + 1] AS name FROM part)"""
    q["text_round_trip"] = sql("""
SELECT s.sku, concat('12", "', p.product_name, '", big') AS product_name, p.status, s.posting_date,
       CAST(sum(s.stock_balance) AS DOUBLE) AS balance
FROM stock_n s JOIN product p ON p.sku = s.sku GROUP BY ALL""")
    place = "CAST(row_number() OVER (ORDER BY {by}) AS BIGINT) AS place"
    q["report_order"] = sql(f"""
SELECT 'detail' AS dataset, {place.format(by='lost_value_net_raw DESC, sku, virtual_site')},
       concat(sku, ' | ', virtual_site) AS item FROM detail
UNION ALL SELECT 'summary_site', {place.format(by='lost_value_net_raw DESC, virtual_site')}, virtual_site FROM summary_site
UNION ALL SELECT 'summary_sku', {place.format(by='lost_value_net_raw DESC, sku')}, sku FROM summary_sku
UNION ALL SELECT 'unmapped_sites', {place.format(by='"rows" DESC, site_code')}, site_code FROM unmapped""")
    appended = sql("SELECT * FROM detail").replace(
        "FROM orders_n WHERE NOT excluded_prefix_p GROUP BY sku, stock_code)",
        "FROM (SELECT DISTINCT * FROM orders_n) WHERE NOT excluded_prefix_p GROUP BY sku, stock_code)")
    q["append_then_model"] = q["append_then_model_by_month"] = appended
    q["orders_export_utf16"] = sql("""
SELECT purchase_date, sku, stock_code, CAST(quantity AS DOUBLE) AS quantity, CAST(gross AS DOUBLE) AS gross,
       CAST(net AS DOUBLE) AS net,
       concat('12"', chr(9), product_name, chr(10), '"second" line', chr(10), 'กระเป๋า') AS product_name, excluded_prefix_p
FROM orders_n""")
    q["workbook_inputs"] = sql("""
SELECT p.sku, p.product_name, 'unknown' AS status, o.lines, CAST(o.quantity AS DOUBLE) AS quantity, o.sites,
       CAST((SELECT count(DISTINCT strftime(posting_date, '%Y-%m')) FROM stock_n) AS INTEGER) AS stock_months
FROM product p JOIN (
  SELECT sku, count(*) AS lines, sum(quantity) AS quantity, count(DISTINCT stock_code) AS sites FROM orders_n
  WHERE stock_code IN (SELECT virtual_site FROM site_map) GROUP BY sku) o ON o.sku = p.sku""")
    q["snapshot_files"] = sql("""
SELECT c.channel, upper(c.channel) AS label, 'Live SKUs' AS sheet_name, 'sku list' AS input_path,
       CAST((SELECT count(*) FROM sku_f) AS BIGINT) AS sku_count, CAST(c.site_code_count AS BIGINT) AS site_code_count,
       CAST(coalesce(r.row_count, 0) AS BIGINT) AS row_count, CAST(coalesce(r.row_count, 0) AS BIGINT) AS file_rows,
       CAST(coalesce(r.balance, 0) AS DOUBLE) AS balance, CASE WHEN r.row_count > 0 THEN true END AS in_order,
       'daily_stock - 1998-06-01_to_1998-06-30' AS folder, true AS named_by_dates
FROM (SELECT channel, count(*) AS site_code_count FROM ch_sites GROUP BY channel) c
LEFT JOIN (SELECT channel, count(*) AS row_count, sum(CAST(stock_balance AS DECIMAL(38,2))) AS balance FROM snap GROUP BY channel) r
  ON r.channel = c.channel""")
    q["summary_csv"] = sql("""
SELECT 'OOS_Opportunity_Lost_TPCH_1998-06_V5' AS run, virtual_site, CAST(sku_site_rows_eval AS DOUBLE) AS sku_site_rows_eval,
       * EXCLUDE (virtual_site, sku_site_rows_eval) FROM summary_site""")
    q["input_findings_paths"] = sql("""
SELECT 'absent' AS "case", 'sales' AS dataset, 'error' AS severity, 'missing_staged_path' AS code
UNION ALL SELECT 'absent', 'sku_live', 'error', 'missing_staged_file'
UNION ALL SELECT 'broken', 'sales', 'error', 'unsupported_format'
UNION ALL SELECT 'broken', 'sku_live', 'error', 'unreadable_file'
UNION ALL SELECT c, 'stock', 'warning', 'multiple_month_hints' FROM (VALUES ('absent'), ('broken')) v(c)
  WHERE (SELECT count(DISTINCT strftime(posting_date, '%Y-%m')) FROM stock_n) > 1""")
    q["loss_detail_bucketed"] = q["loss_detail"]
    kinds = "(VALUES (0, 'short'), (1, 'long'), (2, 'undecodable')) k(k, state)"
    q["rejected_lines"] = sql(f"""
SELECT 'stock' AS dataset, 'warning' AS severity, 'rejected_lines_' || state AS code,
       CAST(count(*) AS VARCHAR) || ' line(s) were set aside: ' || state || '.' AS message
FROM stock_n JOIN {kinds} ON CAST(site_code AS INTEGER) % 10 = k GROUP BY state""")
    q["day_balance_checked"] = sql("""
SELECT s.posting_date, s.sku, m.virtual_site, CAST(sum(s.stock_balance) AS DOUBLE) AS stock_balance
FROM stock_n s JOIN site_map m ON s.site_code = m.site_code
WHERE s.posting_date >= DATE '1998-06-01' AND s.posting_date < DATE '1998-07-01' AND NOT s.excluded_prefix_p
  AND CAST(s.site_code AS INTEGER) % 10 > 2 GROUP BY 1, 2, 3""")
    q["failed_run"] = sql("""
SELECT 'th' AS channel, '1998-06' AS period, false AS ok, 'failed' AS status, 0 AS detail_row_count,
       0 AS qa_summary_row_count, 0 AS unmapped_site_count, 0.0 AS lost_value_net_raw, 'ValueError' AS error_type,
       'the site map has no active row for channel TH' AS error_message
FROM (SELECT 1) WHERE (SELECT count(*) FROM site_map WHERE virtual_site IN (""" + ", ".join(f"'{x}'" for x in TH_SITES) + """)) = 0""")
    q["input_fingerprint"] = sql(" UNION ALL ".join([
        fingerprint("sales", "orders_n", ["purchase_date", "sku", "stock_code", "CAST(quantity AS DECIMAL(18,2))",
                                          "CAST(gross AS DECIMAL(18,2))", "CAST(net AS DECIMAL(18,4))",
                                          "product_name"]),
        fingerprint("stock", "stock_n", ["posting_date", "site_code", "sku", "CAST(stock_balance AS DECIMAL(18,2))"]),
        fingerprint("sku_live", "(SELECT p.*, s.p_partkey FROM product p JOIN sku_part s ON s.sku = p.sku)",
                    ["sku", "product_name", "status", "p_partkey"]),
        fingerprint("site_mapping", "site_map_raw", ["virtual_location", "site", "active"])]))
    q["input_staleness"] = sql("""
SELECT 'sales' AS dataset, false AS changed UNION ALL SELECT 'stock', false
UNION ALL SELECT 'sku_live', (SELECT count(*) > 0 FROM product WHERE status <> upper(status))
UNION ALL SELECT 'site_mapping', true""")
    return q


def fingerprint(dataset: str, table: str, columns: list[str]) -> str:
    """Sums of the halves of the md5 digests of rows written with lengths and null marks."""
    row = " || ".join(f"coalesce(CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
                      for c in columns)
    half = "CAST(coalesce(sum(CAST('0x' || substr(md5(r), {at}, 15) AS BIGINT)), 0) AS VARCHAR)"
    return (f"SELECT '{dataset}' AS dataset, count(*) AS row_count, {half.format(at=1)} AS hash_a, "
            f"{half.format(at=16)} AS hash_b FROM (SELECT {row} AS r FROM {table})")


def second_channel() -> str:
    """The detail of the second channel: its orders lack one site and have other prices, its
    products are all hidden, upper-cased and without the SKUs that end in 7."""
    text = sql("SELECT * FROM detail_c WHERE channel = 'tpch2'", site_map="site_map2", extra="last_cte AS (SELECT 1)")
    start = text.index("universe AS (")
    head, rest = text[:start], text[start:]
    own = """orders_2 AS (
  SELECT purchase_date, sku, stock_code, quantity, gross + gross AS gross, net + gross AS net, product_name,
         excluded_prefix_p FROM orders_n WHERE stock_code <> 'europe'),
product_2 AS (
  SELECT sku, CASE WHEN sku NOT LIKE '%3' THEN upper(product_name) END AS product_name, 'hide' AS status, excluded_prefix_p
  FROM product WHERE sku NOT LIKE '%7'),
"""
    return head + own + rest.replace("FROM orders_n", "FROM orders_2").replace("FROM product ", "FROM product_2 ")


GATE = """
SELECT dataset, error_count, warning_count, is_ready, blocking_messages FROM gate
UNION ALL
SELECT 'ALL', CAST(sum(error_count) AS BIGINT), CAST(sum(warning_count) AS BIGINT),
       sum(CAST(is_ready AS INTEGER)) = count(*),
       coalesce(string_agg(blocking_messages, '; ' ORDER BY dataset) FILTER (WHERE blocking_messages <> ''), '')
FROM gate"""


def gate_ctes(findings: str, datasets: list[tuple[str, int]]) -> str:
    """The readiness gate over (dataset, whether it was supplied)."""
    labels = {"sales": "Sales", "stock": "Stock", "sku_live": "SKU Live", "site_mapping": "Site Mapping"}
    rows = ", ".join(f"('{d}', '{labels.get(d, d)}', {have})" for d, have in datasets)
    return f"""
gate AS (
  SELECT d.dataset, CAST(count(f.code) FILTER (WHERE f.severity = 'error') AS BIGINT) AS error_count,
         CAST(count(f.code) FILTER (WHERE f.severity = 'warning') AS BIGINT) AS warning_count,
         count(f.code) FILTER (WHERE f.severity = 'error') = 0 AND d.have = 1 AS is_ready,
         concat_ws('; ', CASE WHEN d.have = 0 THEN d.label || ': upload required.' END,
                   string_agg(d.label || ': ' || f.message, '; ' ORDER BY f.message)
                     FILTER (WHERE f.severity = 'error')) AS blocking_messages
  FROM (VALUES {rows}) d(dataset, label, have) LEFT JOIN {findings} f ON f.dataset = d.dataset
  GROUP BY d.dataset, d.label, d.have)"""
