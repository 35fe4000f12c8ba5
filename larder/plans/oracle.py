"""SQL that gives the same rows as the queries, for a second engine to check them.

``CTES`` builds the panel and all that hangs on it, step by step; each query ends
in one SELECT over these names.
"""

from __future__ import annotations

import re

from larder.config import STANDARD as S

W = S.windows
_D = lambda d: f"DATE '{d.isoformat()}'"
CAL, CAL_END, FINAL = _D(W.calibration_start), _D(W.calibration_end), _D(W.final_start)
SEL, SEL_END = _D(W.selection_start), _D(W.selection_end)


def r(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 4) + 0.0 AS {name}"


def i(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


def _map(values: dict, by: str) -> str:
    return f"CASE {by} " + " ".join(f"WHEN '{k}' THEN {float(v)!r}" for k, v in values.items()) + " END"


_POLICY = "lead_time, order_quantity, rop, safety_stock, unit_cost, unit_price"

CTES: dict[str, str] = {
    "days": "SELECT CAST(unnest(range(DATE '1999-01-01', DATE '2001-01-01', INTERVAL 1 DAY)) AS DATE) AS date",
    "brands": """SELECT p_brand AS sku_id, CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) AS n, round(avg(p_retailprice), 2) AS unit_price FROM part GROUP BY p_brand""",
    "sold": """SELECT p_brand AS sku_id, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS demand, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS sold
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1999-01-01' AND l_shipdate < TIMESTAMP '2001-01-01' GROUP BY 1, 2""",
    "grid0": """SELECT b.sku_id, d.date, b.n, b.unit_price, coalesce(s.demand, 0) AS demand, coalesce(s.sold, 0) AS sold FROM brands b CROSS JOIN days d LEFT JOIN sold s ON s.sku_id = b.sku_id AND s.date = d.date""",
    "grid1": """SELECT *, CASE WHEN isodow(date) = 1 THEN coalesce(sum(sold) OVER (PARTITION BY sku_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0) ELSE 0 END AS received FROM grid0""",
    "grid2": f"""SELECT *, sum(received - sold) OVER (PARTITION BY sku_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS run,
        avg(CASE WHEN date < {FINAL} THEN demand END) OVER (PARTITION BY sku_id) AS mean, CASE n % 5 WHEN 0 THEN 3 WHEN 1 THEN 5 WHEN 2 THEN 7 WHEN 3 THEN 10 ELSE 14 END AS lead FROM grid1""",
    "panel": """SELECT sku_id, date, CAST(demand AS BIGINT) AS demand, CAST(sold AS BIGINT) AS sales_quantity, CAST(run - least(min(run) OVER (PARTITION BY sku_id), 0) AS BIGINT) AS inventory_level, CAST(received AS BIGINT) AS order_received,
        'group' || (n % 4) AS category, CAST(lead AS BIGINT) AS lead_time, CAST(ceil(mean * CAST(lead AS DOUBLE) * CAST(0.2 AS DOUBLE)) AS BIGINT) AS safety_stock, CAST(ceil(mean * CAST(lead AS DOUBLE) * CAST(1.2 AS DOUBLE)) AS BIGINT) AS reorder_point,
        CAST(ceil(mean * CAST(14 AS DOUBLE)) AS BIGINT) AS order_quantity, round(unit_price * (CAST(0.5 AS DOUBLE) + CAST(0.04 AS DOUBLE) * (n % 5)), 2) AS unit_cost, unit_price FROM grid2""",
    "value": f"SELECT sku_id, sum(demand * greatest(unit_price - unit_cost, 0)) AS value FROM panel WHERE date < {CAL} GROUP BY sku_id",
    "shares": "SELECT sku_id, value, sum(value) OVER (ORDER BY value DESC, sku_id ROWS UNBOUNDED PRECEDING) / nullif(sum(value) OVER (), 0) AS share FROM value",
    "abc": f"SELECT *, CASE WHEN share <= {S.a_share!r} THEN 'A' WHEN share <= {S.b_share!r} THEN 'B' ELSE 'C' END AS abc FROM shares",
    "base": f"""SELECT *, CAST(lag(demand) OVER w AS DOUBLE) AS "Naive", CAST(lag(demand, {W.season}) OVER w AS DOUBLE) AS "SeasonalNaive",
        avg(demand) OVER (PARTITION BY sku_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS "HistoricMean" FROM panel WINDOW w AS (PARTITION BY sku_id ORDER BY date)""",
    "sel": f"SELECT * FROM base WHERE date BETWEEN {SEL} AND {SEL_END} AND date > {SEL_END} - {W.selection_days}",
    "sel_long": """SELECT sku_id, demand, 'Naive' AS model, 1 AS pos, "Naive" AS forecast FROM sel UNION ALL SELECT sku_id, demand, 'SeasonalNaive', 2, "SeasonalNaive" FROM sel UNION ALL SELECT sku_id, demand, 'HistoricMean', 3, "HistoricMean" FROM sel""",
    "cand": "SELECT model, pos, sum(abs(demand - forecast)) / nullif(sum(abs(demand)), 0) AS wape, avg(abs(demand - forecast)) AS mae, count(*) AS n_obs FROM sel_long WHERE forecast IS NOT NULL GROUP BY 1, 2",
    "best": "SELECT model FROM cand ORDER BY wape ASC NULLS LAST, pos LIMIT 1",
    "nmae": "SELECT sku_id, avg(abs(demand - forecast)) AS mae, avg(demand) AS mean_demand FROM sel_long WHERE model = (SELECT model FROM best) GROUP BY sku_id HAVING avg(demand) > 0",
    "xyz": f"""SELECT sku_id, mae, mean_demand, mae / mean_demand AS nmae,
        CASE WHEN mae / mean_demand <= (SELECT quantile_cont(mae / mean_demand, {S.x_quantile}) FROM nmae) THEN 'X' WHEN mae / mean_demand <= (SELECT quantile_cont(mae / mean_demand, {S.z_quantile}) FROM nmae) THEN 'Y' ELSE 'Z' END AS xyz FROM nmae""",
    "cls": "SELECT abc.sku_id, abc || xyz AS class FROM abc JOIN xyz ON abc.sku_id = xyz.sku_id",
    "metric": f"""SELECT sku_id, avg(inventory_level) AS avg_inventory, sum(demand) AS total_demand, sum(sales_quantity) AS total_sales, count(DISTINCT date) AS num_days, avg(demand) AS m, stddev_samp(demand) AS sd FROM panel WHERE date < {FINAL} GROUP BY sku_id""",
    "skum": """SELECT sku_id, avg_inventory, total_demand, total_sales, num_days, total_demand / num_days AS daily_demand, avg_inventory / nullif(total_demand / num_days, 0) AS doi,
        total_sales / nullif(total_demand, 0) AS fill_rate, greatest(total_demand - total_sales, 0) AS lost_sales, sd / nullif(m, 0) AS cv FROM metric""",
    "scope0": f"""SELECT class, count(DISTINCT p.sku_id) AS n_sku, sum(demand) AS total_demand, sum(sales_quantity) AS total_sales, sum(greatest(demand - sales_quantity, 0)) AS lost_sales, count(DISTINCT date) AS num_days,
        sum(demand * greatest(unit_price - unit_cost, 0)) AS value FROM panel p JOIN cls c ON p.sku_id = c.sku_id WHERE date < {CAL} GROUP BY class""",
    "scope1": f"""SELECT class, avg(i) AS avg_inventory FROM (SELECT class, date, sum(inventory_level) AS i FROM panel p JOIN cls c ON p.sku_id = c.sku_id WHERE date < {CAL} GROUP BY 1, 2) GROUP BY class""",
    "scope2": """SELECT s.*, avg_inventory, left(s.class, 1) AS abc, total_sales / nullif(total_demand, 0) AS fill_rate, avg_inventory / nullif(total_demand / num_days, 0) AS doi,
        CASE WHEN left(s.class, 1) = 'A' THEN value / nullif(sum(CASE WHEN left(s.class, 1) = 'A' THEN value END) OVER (), 0) END AS a_share FROM scope0 s LEFT JOIN scope1 t ON s.class = t.class""",
    "scope": f"""SELECT *, CASE WHEN abc = 'A' AND a_share >= {S.strategic_share} THEN 'protect_strategic_value' WHEN abc = 'C' AND fill_rate < {S.understock_fill} THEN 'correct_understock'
        WHEN fill_rate >= {S.overstock_fill} AND doi >= (SELECT quantile_cont(doi, {S.overstock_quantile}) FROM scope2) THEN 'reduce_overstock' END AS intervention FROM scope2""",
    "skus": "SELECT sku_id, c.class, intervention FROM cls c JOIN scope s ON c.class = s.class WHERE intervention IS NOT NULL",
    "segs": "SELECT c.sku_id, c.class, coalesce(s.intervention, c.class) AS segment FROM cls c LEFT JOIN scope s ON c.class = s.class",
    "wins0": "SELECT segment, model, pos, sum(abs(demand - forecast)) / nullif(sum(abs(demand)), 0) AS wape, count(*) AS n_obs FROM sel_long l JOIN segs c ON l.sku_id = c.sku_id WHERE forecast IS NOT NULL GROUP BY 1, 2, 3",
    "wins": "SELECT segment, model, wape, n_obs, row_number() OVER (PARTITION BY segment ORDER BY wape ASC NULLS LAST, pos) AS rank FROM wins0",
    "fc": """SELECT b.sku_id, b.date, b.demand, c.class, w.model, CASE w.model WHEN 'Naive' THEN "Naive" WHEN 'SeasonalNaive' THEN "SeasonalNaive" ELSE "HistoricMean" END AS raw FROM base b JOIN segs c ON b.sku_id = c.sku_id JOIN wins w ON c.segment = w.segment AND w.rank = 1""",
    "fcal": f"SELECT sku_id, date, demand, class, model, CASE WHEN raw IS NOT NULL THEN greatest(raw, 0) END AS forecast FROM fc WHERE date BETWEEN {CAL} AND {CAL_END}",
    "ffin": f"SELECT sku_id, date, demand, class, model, CASE WHEN raw IS NOT NULL THEN greatest(raw, 0) END AS forecast FROM fc WHERE date >= {FINAL}",
    "med": f"""SELECT sku_id, median(lead_time) AS lead_time, median(unit_cost) AS unit_cost, median(unit_price) AS unit_price, median(order_quantity) AS order_quantity, median(reorder_point) AS reorder_point, median(safety_stock) AS safety_stock FROM panel WHERE date < {FINAL} GROUP BY sku_id""",
    "res": """SELECT f.sku_id, date, demand - forecast AS e, lead_time, row_number() OVER (PARTITION BY f.sku_id ORDER BY date) AS k FROM fcal f JOIN med m ON f.sku_id = m.sku_id""",
    "sums": "SELECT a.sku_id, a.k, sum(b.e) AS s FROM res a JOIN res b ON a.sku_id = b.sku_id AND b.k > a.k - a.lead_time AND b.k <= a.k WHERE a.k >= a.lead_time GROUP BY 1, 2",
    "fstat": "SELECT sku_id, sqrt(avg((forecast - demand) * (forecast - demand))) AS rmse, avg(forecast) AS mean_forecast, avg(forecast - demand) AS bias FROM fcal GROUP BY sku_id",
    "tgt": f"SELECT sku_id, class, intervention, coalesce({_map(S.service_by_class, 'class')}, {_map(S.service_by_intervention, 'intervention')}) AS target FROM skus",
    "pol": """SELECT t.sku_id, t.class, t.intervention, t.target, m.lead_time, m.unit_cost, m.unit_price, m.order_quantity, f.rmse, f.mean_forecast, f.bias, q.sd AS lead_error_std, q.n AS n_lead_errors, greatest(q.v, 0) AS safety_stock,
        f.mean_forecast * m.lead_time + greatest(q.v, 0) AS rop FROM tgt t JOIN med m ON t.sku_id = m.sku_id JOIN fstat f ON t.sku_id = f.sku_id
        JOIN (SELECT s.sku_id, stddev_samp(s) AS sd, count(*) AS n, list_sort(list(s)) AS l, any_value(target) / 100 AS p,
            list_sort(list(s))[1 + CAST(floor(any_value(target) / 100 * (count(*) - 1)) AS INTEGER)] + (list_sort(list(s))[1 + CAST(ceil(any_value(target) / 100 * (count(*) - 1)) AS INTEGER)] - list_sort(list(s))[1 + CAST(floor(any_value(target) / 100 * (count(*) - 1)) AS INTEGER)])
            * (any_value(target) / 100 * (count(*) - 1) - floor(any_value(target) / 100 * (count(*) - 1))) AS v FROM sums s JOIN tgt t ON s.sku_id = t.sku_id GROUP BY s.sku_id) q ON q.sku_id = t.sku_id""",
    "hist": "SELECT sku_id, lead_time, unit_cost, unit_price, order_quantity, reorder_point AS rop, safety_stock FROM med",
    "rec": f"SELECT sku_id, date, order_received FROM panel WHERE order_received > 0 AND date < {FINAL}",
    "infer": f"""SELECT m.sku_id, m.lead_time, m.unit_cost, m.unit_price, coalesce(q.q, m.order_quantity) AS order_quantity, coalesce(o.r, l.low) AS rop, m.safety_stock FROM med m
        LEFT JOIN (SELECT sku_id, median(order_received) AS q FROM rec GROUP BY 1) q ON q.sku_id = m.sku_id
        LEFT JOIN (SELECT x.sku_id, median(p.inventory_level) AS r FROM (SELECT DISTINCT rec.sku_id, CAST(rec.date - CAST(lead_time AS INTEGER) AS DATE) AS date FROM rec JOIN med ON rec.sku_id = med.sku_id) x JOIN panel p ON p.sku_id = x.sku_id AND p.date = x.date GROUP BY 1) o ON o.sku_id = m.sku_id
        JOIN (SELECT sku_id, quantile_cont(inventory_level, 0.2) AS low FROM panel WHERE date < {FINAL} GROUP BY 1) l ON l.sku_id = m.sku_id""",
    "init_cal": f"SELECT sku_id, arg_max(inventory_level, date) AS initial FROM panel WHERE date < {CAL} GROUP BY 1",
    "init_fin": f"SELECT sku_id, arg_max(inventory_level, date) AS initial FROM panel WHERE date < {FINAL} GROUP BY 1",
}


def simulation(name: str, days: str, runs: str, start: str) -> dict[str, str]:
    """CTEs ``name``_path, ``name``_step and ``name``: traces of ``runs`` (key, sku_id, policy, dyn) over ``days`` (key, date, demand, target)."""
    path = f"""SELECT d.key, r.sku_id, d.date, CAST(d.demand AS DOUBLE) AS demand, CAST(d.target AS DOUBLE) AS target, row_number() OVER (PARTITION BY d.key ORDER BY d.date) AS p, count(*) OVER (PARTITION BY d.key) AS n,
        CAST(r.lead_time AS INTEGER) AS lead, CAST(r.order_quantity AS DOUBLE) AS q, CAST(r.rop AS DOUBLE) AS rop, CAST(r.safety_stock AS DOUBLE) AS ss, r.dyn, CAST(s.initial AS DOUBLE) AS initial
        FROM {days} d JOIN {runs} r ON d.key = r.key JOIN {start} s ON s.sku_id = r.sku_id"""
    step = f"""SELECT key, CAST(0 AS BIGINT) AS p, initial AS inv, list_transform(range(lead), lambda x: CAST(0 AS DOUBLE)) AS ring, CAST(0 AS DOUBLE) AS received, CAST(0 AS DOUBLE) AS sales, CAST(0 AS DOUBLE) AS lost, CAST(NULL AS DOUBLE) AS rop_used, 0 AS ordered, CAST(0 AS DOUBLE) AS position FROM {name}_path WHERE p = 1
        UNION ALL
        SELECT key, p, inv, list_concat(rest, [CAST(CASE WHEN ordered = 1 THEN q ELSE 0 END AS DOUBLE)]), received, sales, lost, rop_used, ordered, inv + open + CASE WHEN ordered = 1 THEN q ELSE 0 END FROM (
          SELECT *, CASE WHEN rop_used IS NOT NULL AND inv + open <= rop_used THEN 1 ELSE 0 END AS ordered FROM (
            SELECT x.key, x.p, x.q, s.ring[1] AS received, least(x.demand, s.inv + s.ring[1]) AS sales, x.demand - least(x.demand, s.inv + s.ring[1]) AS lost, s.inv + s.ring[1] - least(x.demand, s.inv + s.ring[1]) AS inv,
              s.ring[2:] AS rest, coalesce(list_sum(s.ring[2:]), 0) AS open, CASE WHEN x.p = x.n THEN NULL WHEN x.dyn THEN x.target * x.lead + x.ss ELSE x.rop END AS rop_used
            FROM {name}_step s JOIN {name}_path x ON x.key = s.key AND x.p = s.p + 1))"""
    trace = f"""SELECT x.key, x.sku_id, x.date, x.demand, x.p, x.n, CASE WHEN x.p = 1 THEN x.initial END AS initial_inventory, s.received, s.inv AS inventory, s.position AS inventory_position, s.rop_used, s.sales AS sales_quantity, s.lost, s.ordered AS order_placed FROM {name}_step s JOIN {name}_path x ON x.key = s.key AND x.p = s.p"""
    return {f"{name}_path": path, f"{name}_step": step, name: trace}


def metrics(name: str, trace: str, runs: str) -> dict[str, str]:
    """CTE ``name``: service and cost of each run of a trace."""
    cycles = f"SELECT key, cycle, sum(demand) AS demand, sum(sales_quantity) AS sales, sum(lost) AS lost, sum(inventory) AS inventory, count(*) AS days, sum(order_placed) AS orders FROM (SELECT *, sum(CASE WHEN received > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY p ROWS UNBOUNDED PRECEDING) AS cycle FROM {trace}) GROUP BY 1, 2"
    total = f"SELECT key, sum(demand) AS total_demand, sum(sales) AS total_sales, sum(lost) AS total_lost, sum(inventory) / sum(days) AS avg_inventory, count(*) FILTER (WHERE lost = 0) AS ok, count(*) AS num_cycles, sum(orders) AS orders FROM {name}_c GROUP BY 1"
    full = f"""SELECT *, stockout_cost + holding_cost + ordering_cost AS total_cost FROM (SELECT r.*, total_demand, total_sales, total_lost, avg_inventory, ok AS cycles_without_stockout, num_cycles, orders, total_sales / nullif(total_demand, 0) AS fill_rate, ok / num_cycles AS cycle_service_level,
        total_demand / nullif(avg_inventory, 0) AS turnover, avg_inventory / nullif(total_demand / (SELECT count(DISTINCT date) FROM {trace}), 0) AS doi, total_lost * (unit_price - unit_cost) * {S.shortage_multiplier!r} AS stockout_cost,
        avg_inventory * unit_cost * {S.holding_rate!r} * (SELECT count(DISTINCT date) FROM {trace}) / 365 AS holding_cost, orders * {S.ordering_cost!r} AS ordering_cost FROM {name}_t t JOIN {runs} r ON r.key = t.key)"""
    return {f"{name}_c": cycles, f"{name}_t": total, name: full}


_TARGETS = lambda f: f"(SELECT sku_id, CAST(date - 1 AS DATE) AS date, forecast AS target FROM {f})"
CTES |= {
    "cal_days": f"SELECT f.sku_id, f.date, f.demand, t.target FROM fcal f LEFT JOIN {_TARGETS('fcal')} t ON t.sku_id = f.sku_id AND t.date = f.date",
    "fin_days": f"SELECT p.sku_id AS key, p.date, p.demand, t.target FROM panel p LEFT JOIN {_TARGETS('ffin')} t ON t.sku_id = p.sku_id AND t.date = p.date WHERE p.date >= {FINAL}",
    "qs": "SELECT sku_id, list_sort(list(s)) AS l, count(*) AS n FROM sums GROUP BY 1",
    "gr0": f"""SELECT DISTINCT t.sku_id, t.class, t.intervention, t.target, qm.q_multiplier, qq.quantile FROM tgt t CROSS JOIN (SELECT unnest({list(S.quantity_multipliers)}::DOUBLE[]) AS q_multiplier) qm
        JOIN (SELECT sku_id, unnest(list_append({list(S.reorder_quantiles)}::DOUBLE[], target / 100)) AS quantile FROM tgt) qq ON qq.sku_id = t.sku_id""",
    "gr1": """SELECT g.*, m.lead_time, m.unit_cost, m.unit_price, f.mean_forecast, ceil(greatest(m.order_quantity * q_multiplier, 1)) AS order_quantity,
        greatest(l[1 + CAST(floor(quantile * (n - 1)) AS INTEGER)] + (l[1 + CAST(ceil(quantile * (n - 1)) AS INTEGER)] - l[1 + CAST(floor(quantile * (n - 1)) AS INTEGER)]) * (quantile * (n - 1) - floor(quantile * (n - 1))), 0) AS safety_stock
        FROM gr0 g JOIN med m ON g.sku_id = m.sku_id JOIN fstat f ON f.sku_id = g.sku_id JOIN qs ON qs.sku_id = g.sku_id""",
    "gr": "SELECT *, mean_forecast * lead_time + safety_stock AS rop, sku_id || '|' || q_multiplier || '|' || quantile AS key, true AS dyn FROM gr1",
    "gr_days": "SELECT g.key, c.date, c.demand, c.target FROM gr g JOIN cal_days c ON c.sku_id = g.sku_id",
}
CTES |= simulation("gsim", "gr_days", "gr", "init_cal") | metrics("gmet", "gsim", "gr")
CTES |= {
    "audit": f"SELECT *, coalesce({_map(S.floor_by_intervention, 'intervention')}, target / 100) AS service_floor, fill_rate >= coalesce({_map(S.floor_by_intervention, 'intervention')}, target / 100) AS service_floor_met FROM gmet",
    "chosen": """SELECT * FROM (SELECT *, CASE WHEN service_floor_met THEN 'minimum_cost_feasible' ELSE 'no_feasible_candidate_best_service' END AS selection_status, row_number() OVER (PARTITION BY sku_id ORDER BY service_floor_met DESC,
        CASE WHEN service_floor_met THEN total_cost END, CASE WHEN service_floor_met THEN avg_inventory END, fill_rate DESC, total_cost, avg_inventory, q_multiplier, quantile) AS rk FROM audit) WHERE rk = 1""",
    "run_old": f"SELECT h.sku_id AS key, h.sku_id, {_POLICY}, false AS dyn, class FROM hist h JOIN cls c ON c.sku_id = h.sku_id",
    "run_new": f"SELECT sku_id AS key, sku_id, {_POLICY}, true AS dyn, class FROM chosen",
    "run_inf": f"SELECT h.sku_id AS key, h.sku_id, {_POLICY}, false AS dyn, class FROM infer h JOIN cls c ON c.sku_id = h.sku_id",
}
for _p in ("old", "new", "inf"):
    CTES |= simulation(f"sim{_p}", "fin_days", f"run_{_p}", "init_fin") | metrics(f"m{_p}", f"sim{_p}", f"run_{_p}")
CTES |= {
    "old_in": "SELECT o.* FROM mold o WHERE o.sku_id IN (SELECT sku_id FROM chosen)",
    "both_old": "SELECT * FROM mold",
    "both_new": "SELECT sku_id, class, total_demand, total_sales, total_lost, avg_inventory, cycles_without_stockout, num_cycles, stockout_cost, holding_cost, ordering_cost, total_cost FROM mnew UNION ALL SELECT sku_id, class, total_demand, total_sales, total_lost, avg_inventory, cycles_without_stockout, num_cycles, stockout_cost, holding_cost, ordering_cost, total_cost FROM mold WHERE sku_id NOT IN (SELECT sku_id FROM chosen)",
}


def query(select: str, **more: str) -> str:
    """A SELECT over the CTEs that it needs, directly or through others."""
    known = CTES | more
    need, todo = set(), [select]
    while todo:
        for word in set(re.findall(r"\b\w+\b", todo.pop())) & set(known):
            if word not in need:
                need.add(word)
                todo.append(known[word])
    parts = ",\n".join(f"{k} AS {'' if k.endswith('_step') else 'MATERIALIZED '}({v})" for k, v in known.items() if k in need)
    return f"WITH RECURSIVE {parts}\n{select}"
