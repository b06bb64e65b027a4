"""Independent SQL definitions of every registered query, for the DuckDB oracle.

Each query is plain ANSI SQL over the driver's tables (``events``, ``customer``).  The
shared stages are CTE fragments; :func:`sql` stitches the fragments a query needs, in
dependency order, in front of its final SELECT.  Window definitions order by
``date_time`` (nulls last) and ``event_seq``, the same contract as the Spark operators.
"""

from __future__ import annotations

from ..functions.rounding import round_half_even_sql as rhe
from ..functions.rounding import stable_sql
from ..functions.distributions import norm_sf_sql, student_t_cdf_sql
from ..functions.steps import step_num_sql

_CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, body: str, *deps: str) -> None:
    _CTES[name] = (body.strip(), deps)


def sql(select: str, *needs: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in _CTES[name][1]:
            visit(dep)
        order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return select.strip()
    parts = [f"{name} AS (\n{_CTES[name][0]}\n)" for name in order]
    body = select.strip()
    if body[:5].upper() == "WITH ":  # the query's own CTEs follow the shared ones
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


ORD = "date_time ASC NULLS LAST, event_seq ASC"

# -- fixtures (FIXTURES.md section 3) ---------------------------------------------------
cte("ev", """
SELECT CAST(user_id AS BIGINT) AS client_id,
       CAST(user_id AS VARCHAR) || '_' || CASE WHEN event_id % 10 = 0 THEN '1' ELSE '0' END
           AS visitor_id,
       CAST(user_id AS VARCHAR) || '_' || CAST(7 + date_diff('second',
           TIMESTAMP '2024-01-01 00:00:00', ts) // 432000 AS VARCHAR) AS visit_id,
       CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'step_1'
            WHEN 'signup' THEN 'step_2' WHEN 'error' THEN 'step_3'
            WHEN 'purchase' THEN 'confirm' END AS process_step,
       date_trunc('second', ts) AS date_time,
       CAST(event_id AS BIGINT) AS event_seq
FROM events
WHERE NOT (event_type = 'purchase' AND user_id % 4 = 1)
""")
cte("web_pt1", """
SELECT * FROM ev WHERE event_seq % 2 = 0
UNION ALL SELECT * FROM ev WHERE event_seq % 50 = 0
""", "ev")
cte("web_pt2", """
SELECT * FROM ev WHERE event_seq % 2 = 1
UNION ALL SELECT * FROM ev WHERE event_seq % 50 = 25
UNION ALL SELECT * FROM ev WHERE event_seq % 98 = 0
""", "ev")
cte("exper", """
SELECT CAST(c_custkey AS BIGINT) AS client_id,
       CASE WHEN c_custkey % 5 IN (0, 1) THEN 'Control'
            WHEN c_custkey % 5 IN (2, 3) THEN 'Test' END AS variation
FROM customer WHERE c_custkey % 11 <> 10
""")
cte("demo_raw", """
SELECT CAST(c_custkey AS BIGINT) AS client_id,
       CASE WHEN c_custkey % 37 = 5 THEN NULL
            ELSE CAST(2 + c_custkey % 30 AS DOUBLE) END AS clnt_tenure_yr,
       CASE WHEN c_custkey % 41 = 7 THEN NULL
            ELSE CAST(18 + (c_custkey * 7) % 60 AS DOUBLE)
                 + 0.5 * CAST(c_custkey % 2 AS DOUBLE) END AS clnt_age,
       CASE WHEN c_custkey % 53 = 3 THEN 'X' WHEN c_custkey % 3 = 0 THEN 'F'
            WHEN c_custkey % 3 = 1 THEN 'M' ELSE 'U' END AS gendr,
       CAST(c_acctbal AS DOUBLE) AS bal
FROM customer WHERE c_custkey % 29 <> 28
""")

# -- cleaning and joins -----------------------------------------------------------------
cte("web_clean", """
SELECT * FROM (SELECT DISTINCT * FROM web_pt1)
UNION ALL SELECT * FROM (SELECT DISTINCT * FROM web_pt2)
""", "web_pt1", "web_pt2")
cte("wwg", """
SELECT e.client_id, e.variation, w.visitor_id, w.visit_id, w.process_step, w.date_time,
       w.event_seq
FROM exper e JOIN web_clean w ON e.client_id = w.client_id
""", "exper", "web_clean")
cte("demo_c", """
SELECT client_id, clnt_tenure_yr,
       coalesce(clnt_age, (SELECT avg(clnt_age) FROM demo_raw
                           WHERE clnt_tenure_yr IS NOT NULL AND gendr = 'F')) AS clnt_age,
       gendr, bal
FROM demo_raw WHERE clnt_tenure_yr IS NOT NULL
""", "demo_raw")
cte("master_t", """
SELECT client_id, d.clnt_tenure_yr, d.clnt_age, d.gendr, d.bal, w.variation, w.visitor_id,
       w.visit_id, w.process_step, w.date_time, w.event_seq
FROM demo_c d FULL OUTER JOIN wwg w USING (client_id)
""", "demo_c", "wwg")
cte("kpi_pop", """
SELECT * FROM master_t WHERE clnt_age IS NOT NULL AND gendr IS DISTINCT FROM 'X'
""", "master_t")
cte("merged", """
SELECT * REPLACE (coalesce(variation, 'Others') AS variation)
FROM master_t WHERE clnt_age IS NOT NULL
""", "master_t")

# -- sequences --------------------------------------------------------------------------
cte("flags", f"""
SELECT *,
       CASE WHEN visit_id IS NOT NULL THEN step_num - lag(step_num) OVER wv END AS step_diff,
       CASE WHEN visit_id IS NOT NULL
            THEN coalesce(lead(step_num) OVER wv < step_num, false) END AS is_error
FROM (SELECT *, {step_num_sql()} AS step_num FROM kpi_pop)
WINDOW wv AS (PARTITION BY visit_id ORDER BY {ORD})
""", "kpi_pop")
cte("att", f"""
SELECT *, CAST(coalesce(step_num = 0, false)
               AND (prev_step IS NULL OR coalesce(prev_step = 4, false))
               AND coalesce(next_step <> 0, true) AS INTEGER) AS opens
FROM (SELECT *, lag(step_num) OVER wc AS prev_step, lead(step_num) OVER wc AS next_step
      FROM flags WINDOW wc AS (PARTITION BY client_id ORDER BY {ORD}))
""", "flags")
cte("kev", f"""
SELECT * EXCLUDE (prev_step, next_step, opens),
       CAST(sum(opens) OVER (PARTITION BY client_id ORDER BY {ORD}
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS attempt_no,
       coalesce(step_num = 4 AND NOT is_error, false) AS finish
FROM att
""", "att")

# -- KPI stages -------------------------------------------------------------------------
cte("err_step", f"""
SELECT step_num, variation, {rhe('avg(CAST(is_error AS DOUBLE)) * 100', 2)} AS error_rate
FROM kev WHERE variation IN ('Control', 'Test') AND step_num IS NOT NULL
GROUP BY step_num, variation
""", "kev")
cte("err_sum", f"""
SELECT variation, {rhe('avg(error_rate)', 2)} AS error_rate_pct
FROM err_step GROUP BY variation
""", "err_step")
cte("fin_rate", f"""
SELECT variation, clients_finished, total_clients,
       {rhe('CAST(clients_finished AS DOUBLE) / total_clients * 100', 2)} AS finisher_clients_pct
FROM (SELECT variation,
             count(DISTINCT CASE WHEN finish THEN client_id END) AS clients_finished,
             count(DISTINCT client_id) AS total_clients
      FROM kev WHERE variation IN ('Control', 'Test') GROUP BY variation)
WHERE clients_finished > 0
""", "kev")
cte("fin_tot", """
SELECT variation, count(DISTINCT CASE WHEN finish THEN client_id END) AS clients_finished,
       count(DISTINCT client_id) AS total_clients
FROM kev WHERE variation IN ('Control', 'Test') GROUP BY variation
""", "kev")
cte("tot_att", """
SELECT variation, CAST(sum(m) AS BIGINT) AS total_attempts
FROM (SELECT variation, client_id, max(attempt_no) AS m FROM kev
      WHERE variation IN ('Control', 'Test') GROUP BY variation, client_id)
GROUP BY variation
""", "kev")
cte("fin_att", """
SELECT variation, count(*) AS finished_attempts
FROM (SELECT DISTINCT variation, client_id, attempt_no FROM kev
      WHERE variation IN ('Control', 'Test') AND finish)
GROUP BY variation
""", "kev")
cte("compl", f"""
SELECT f.variation, f.finished_attempts, t.total_attempts,
       {rhe('CASE WHEN t.total_attempts = 0 THEN NULL ELSE CAST(f.finished_attempts AS DOUBLE) / t.total_attempts END * 100', 2)}
           AS completion_rate_pct
FROM fin_att f JOIN tot_att t USING (variation)
""", "fin_att", "tot_att")

QUERIES: dict[str, str] = {}


def register(key: str, select: str, *needs: str) -> None:
    QUERIES[key] = sql(select, *needs)


register("web_log_clean", "SELECT * FROM web_clean", "web_clean")
register("web_with_groups", "SELECT * FROM wwg", "wwg")
register("demo_clean", "SELECT * FROM demo_c", "demo_c")
register("master", "SELECT * FROM master_t", "master_t")
register("merged_events", "SELECT * FROM merged", "merged")
register("kpi_population", "SELECT * FROM kpi_pop", "kpi_pop")
register("error_flags", """
SELECT client_id, visit_id, event_seq, step_num, step_diff, is_error FROM kev
""", "kev")
register("error_rate_by_step", "SELECT * FROM err_step", "err_step")
register("error_rate_pivot", """
SELECT step_num,
       max(CASE WHEN variation = 'Control' THEN error_rate END) AS control,
       max(CASE WHEN variation = 'Test' THEN error_rate END) AS test
FROM err_step GROUP BY step_num
""", "err_step")
register("error_summary", "SELECT * FROM err_sum", "err_sum")
register("attempts", "SELECT client_id, event_seq, step_num, attempt_no FROM kev", "kev")
register("attempts_documented", f"""
SELECT client_id, event_seq, step_num,
       CAST(sum(opens) OVER (PARTITION BY client_id ORDER BY {ORD}
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS attempt_no
FROM (SELECT *, CAST(coalesce(step_num = 0, false)
                     AND coalesce(lead(step_num) OVER wc <> 0, true)
                     AND (before_run IS NULL OR before_run IN (4, -1)) AS INTEGER) AS opens
      FROM (SELECT *, last_value(CASE WHEN coalesce(step_num <> 0, true)
                                      THEN coalesce(step_num, -1) END IGNORE NULLS)
                      OVER (PARTITION BY client_id ORDER BY {ORD}
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_run
            FROM flags)
      WINDOW wc AS (PARTITION BY client_id ORDER BY {ORD}))
""", "flags")
register("finishers", """
SELECT client_id, variation, visit_id, date_time, event_seq, attempt_no FROM kev WHERE finish
""", "kev")
register("finisher_rate", "SELECT * FROM fin_rate", "fin_rate")
register("total_attempts", "SELECT * FROM tot_att", "tot_att")
register("finished_attempts", "SELECT * FROM fin_att", "fin_att")
register("completion_rate", "SELECT * FROM compl", "compl")
register("kpi_summary", """
SELECT c.variation, c.finished_attempts, c.total_attempts, c.completion_rate_pct,
       e.error_rate_pct, r.finisher_clients_pct
FROM compl c JOIN err_sum e USING (variation) JOIN fin_rate r USING (variation)
""", "compl", "err_sum", "fin_rate")
register("retry_clients", """
SELECT client_id, variation, max(attempt_no) AS max_attempt FROM kev
WHERE variation IN ('Control', 'Test') AND attempt_no > 2 GROUP BY client_id, variation
""", "kev")

# -- visits, durations, funnel ----------------------------------------------------------
cte("visit_steps", """
SELECT client_id, visit_id, count(DISTINCT process_step) AS n_of_unique_steps
FROM merged WHERE visit_id IS NOT NULL GROUP BY client_id, visit_id
""", "merged")
cte("pd0", """
SELECT m.client_id, m.clnt_age, m.gendr, m.variation, m.visitor_id, m.visit_id, m.date_time,
       m.process_step, m.event_seq, g.n_of_unique_steps, g.last_start_time,
       g.last_step1_time, g.last_step2_time, g.last_step3_time, g.last_confirm_time
FROM merged m LEFT JOIN (
    SELECT client_id, visit_id, count(DISTINCT process_step) AS n_of_unique_steps,
           max(CASE WHEN process_step = 'start' THEN date_time END) AS last_start_time,
           max(CASE WHEN process_step = 'step_1' THEN date_time END) AS last_step1_time,
           max(CASE WHEN process_step = 'step_2' THEN date_time END) AS last_step2_time,
           max(CASE WHEN process_step = 'step_3' THEN date_time END) AS last_step3_time,
           max(CASE WHEN process_step = 'confirm' THEN date_time END) AS last_confirm_time
    FROM merged GROUP BY client_id, visit_id) g
  ON m.client_id = g.client_id AND m.visit_id = g.visit_id
""", "merged")
cte("pd1", """
SELECT *,
       CAST(date_diff('microsecond', lag(date_time) OVER w, date_time) AS DOUBLE) / 1e6
           AS step_sec,
       CAST(date_diff('microsecond', min(date_time) OVER g, max(date_time) OVER g) AS DOUBLE)
           / 1e6 AS all_sec
FROM pd0
WHERE coalesce(date_time >= last_start_time, false)
  AND NOT coalesce(process_step = 'confirm' AND date_time < last_confirm_time, false)
  AND NOT coalesce(process_step = 'step_1' AND date_time < last_step1_time, false)
  AND NOT coalesce(process_step = 'step_2' AND date_time < last_step2_time, false)
  AND NOT coalesce(process_step = 'step_3' AND date_time < last_step3_time, false)
WINDOW w AS (PARTITION BY client_id, visit_id ORDER BY date_time ASC NULLS LAST, event_seq),
       g AS (PARTITION BY client_id, visit_id)
""", "pd0")
cte("pdur", f"""
SELECT client_id, clnt_age, gendr, variation, visitor_id, visit_id, date_time, process_step,
       n_of_unique_steps, last_start_time, last_step1_time, last_step2_time,
       last_step3_time, last_confirm_time,
       step_sec AS step_duration, {rhe('step_sec / 60', 2)} AS step_duration_min,
       step_sec AS step_duration_sec, all_sec AS all_steps_duration,
       {rhe('all_sec / 60', 2)} AS all_steps_dur_min,
       {rhe('all_sec / 3600', 3)} AS all_steps_dur_hr, event_seq
FROM pd1
""", "pd1")
cte("cdur", """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY visit_id DESC,
            date_time IS NULL DESC, date_time DESC, event_seq DESC,
            coalesce(step_duration, CAST('inf' AS DOUBLE)) ASC) AS rn
  FROM pdur WHERE n_of_unique_steps = 5)
WHERE rn = 1
""", "pdur")
cte("last_visit", """
SELECT l.client_id, l.visit_id, l.variation, l.process_step, l.date_time, l.event_seq,
       s.n_of_unique_steps, s.n_of_unique_steps AS last_reached_step
FROM (SELECT * FROM (
        SELECT client_id, visit_id, variation, process_step, date_time, event_seq,
               row_number() OVER (PARTITION BY client_id ORDER BY visit_id DESC,
                   date_time IS NULL DESC, date_time DESC, event_seq DESC) AS rn
        FROM merged WHERE visit_id IS NOT NULL) WHERE rn = 1) l
LEFT JOIN visit_steps s ON l.client_id = s.client_id AND l.visit_id = s.visit_id
""", "merged", "visit_steps")
cte("fun", f"""
SELECT variation, process_step, step_num, n_clients,
       {rhe('CAST(n_clients AS DOUBLE) / first_value(n_clients) OVER w * 100', 2)}
           AS conversion_rate,
       (1 - CAST(n_clients AS DOUBLE) / lag(n_clients) OVER w) * 100 AS dropoff_rate
FROM (SELECT variation, process_step, {step_num_sql()} AS step_num,
             count(DISTINCT client_id) AS n_clients
      FROM merged WHERE {step_num_sql()} IS NOT NULL
      GROUP BY variation, process_step)
WINDOW w AS (PARTITION BY variation ORDER BY step_num)
""", "merged")
cte("step_dist", """
SELECT n_steps, count(*) AS n_clients
FROM (SELECT client_id, count(DISTINCT process_step) AS n_steps FROM merged GROUP BY client_id)
GROUP BY n_steps
""", "merged")

register("steps_by_visit", """
SELECT m.client_id, m.visit_id, m.event_seq, s.n_of_unique_steps,
       CASE WHEN s.n_of_unique_steps = 5 THEN 'Yes' ELSE 'No' END AS completed_steps
FROM merged m LEFT JOIN visit_steps s ON m.client_id = s.client_id AND m.visit_id = s.visit_id
""", "merged", "visit_steps")
register("client_last_visit", "SELECT * FROM last_visit", "last_visit")
register("process_durations", "SELECT * FROM pdur", "pdur")
register("completion_durations", "SELECT * FROM cdur", "cdur")
register("duration_stats", f"""
SELECT variation, {stable_sql('avg(all_steps_dur_min)')} AS avg_min,
       max(all_steps_dur_min) AS max_min, min(all_steps_dur_min) AS min_min
FROM cdur WHERE variation IN ('Control', 'Test') GROUP BY variation
""", "cdur")
register("funnel", "SELECT * FROM fun", "fun")
register("funnel_pivot", """
SELECT process_step, step_num,
  max(CASE WHEN variation = 'Control' THEN conversion_rate END) AS conversion_rate_control,
  max(CASE WHEN variation = 'Others' THEN conversion_rate END) AS conversion_rate_others,
  max(CASE WHEN variation = 'Test' THEN conversion_rate END) AS conversion_rate_test,
  max(CASE WHEN variation = 'Control' THEN dropoff_rate END) AS dropoff_rate_control,
  max(CASE WHEN variation = 'Others' THEN dropoff_rate END) AS dropoff_rate_others,
  max(CASE WHEN variation = 'Test' THEN dropoff_rate END) AS dropoff_rate_test
FROM fun GROUP BY process_step, step_num
""", "fun")
register("step_distribution", "SELECT * FROM step_dist", "step_dist")
register("step_distribution_pct", """
SELECT n_steps, n_clients, CAST(n_clients AS DOUBLE) / sum(n_clients) OVER () AS share
FROM step_dist
""", "step_dist")
register("steps_crosstab", """
SELECT n_steps, control, test,
       CAST(control AS DOUBLE) / (control + test) * 100 AS control_pct,
       CAST(test AS DOUBLE) / (control + test) * 100 AS test_pct
FROM (SELECT n_of_unique_steps AS n_steps,
             count(CASE WHEN variation = 'Control' THEN 1 END) AS control,
             count(CASE WHEN variation = 'Test' THEN 1 END) AS test
      FROM last_visit WHERE variation <> 'Others' GROUP BY n_of_unique_steps)
""", "last_visit")

# -- populations, labels, balance -------------------------------------------------------
cte("assigned", """
SELECT e.client_id, e.variation, d.clnt_tenure_yr, d.clnt_age, d.gendr, d.bal
FROM exper e JOIN demo_c d ON e.client_id = d.client_id
""", "exper", "demo_c")
cte("bal_long", """
SELECT client_id, variation, gendr, 'clnt_age' AS metric, clnt_age AS value
FROM assigned WHERE variation IS NOT NULL
UNION ALL
SELECT client_id, variation, gendr, 'clnt_tenure_yr' AS metric, clnt_tenure_yr AS value
FROM assigned WHERE variation IS NOT NULL
""", "assigned")

register("valid_groups", """
SELECT * FROM master_t WHERE variation IN ('Control', 'Test') AND gendr IS DISTINCT FROM 'X'
""", "master_t")
register("group_labels", f"""
SELECT coalesce(variation, 'no_data') AS label, count(*) AS n_clients,
       {stable_sql('avg(clnt_age)')} AS avg_age, {stable_sql('avg(clnt_tenure_yr)')} AS avg_tenure
FROM assigned GROUP BY 1
""", "assigned")
register("group_fold_sensitivity", f"""
SELECT CASE WHEN variation IS NULL OR variation = 'Control' THEN 'Control' ELSE 'Test' END
           AS label, count(*) AS n_clients,
       {stable_sql('avg(clnt_age)')} AS avg_age, {stable_sql('avg(clnt_tenure_yr)')} AS avg_tenure
FROM assigned GROUP BY 1
""", "assigned")
register("balance_describe", f"""
SELECT variation, metric, count(value) AS count, {rhe('avg(value)', 2)} AS mean,
       {rhe('stddev_samp(value)', 2)} AS std, {rhe('min(value)', 2)} AS min,
       {rhe('quantile_cont(value, 0.25)', 2)} AS q25, {rhe('quantile_cont(value, 0.5)', 2)} AS q50,
       {rhe('quantile_cont(value, 0.75)', 2)} AS q75, {rhe('max(value)', 2)} AS max
FROM bal_long GROUP BY variation, metric
""", "bal_long")
register("gender_crosstab", """
SELECT variation,
       CAST(count(CASE WHEN gendr = 'F' THEN 1 END) AS DOUBLE) / count(*) * 100 AS f_pct,
       CAST(count(CASE WHEN gendr = 'M' THEN 1 END) AS DOUBLE) / count(*) * 100 AS m_pct,
       CAST(count(CASE WHEN gendr = 'U' THEN 1 END) AS DOUBLE) / count(*) * 100 AS u_pct,
       CAST(count(CASE WHEN gendr = 'X' THEN 1 END) AS DOUBLE) / count(*) * 100 AS x_pct
FROM assigned WHERE variation IS NOT NULL AND gendr IS NOT NULL GROUP BY variation
""", "assigned")
register("balance_by_gender", f"""
SELECT variation, gendr, metric, count(value) AS n, {stable_sql('avg(value)')} AS mean,
       {stable_sql('avg(value) - 1.96e0 * stddev_samp(value) / sqrt(count(value))')} AS ci_low,
       {stable_sql('avg(value) + 1.96e0 * stddev_samp(value) / sqrt(count(value))')} AS ci_high
FROM bal_long WHERE gendr IS NOT NULL GROUP BY variation, gendr, metric
""", "bal_long")
register("balance_boxplot", f"""
WITH v AS (SELECT * FROM bal_long WHERE gendr IS NOT NULL AND value IS NOT NULL),
q AS (SELECT variation, gendr, metric, quantile_cont(value, 0.25) AS q25,
             quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75
      FROM v GROUP BY variation, gendr, metric),
j AS (SELECT v.variation, v.gendr, v.metric, v.value, q.q25, q.q50, q.q75,
             v.value >= q.q25 - 1.5e0 * (q.q75 - q.q25)
             AND v.value <= q.q75 + 1.5e0 * (q.q75 - q.q25) AS inside
      FROM v JOIN q ON v.variation = q.variation AND v.gendr = q.gendr AND v.metric = q.metric)
SELECT variation, gendr, metric, {stable_sql('q25')} AS q25, {stable_sql('q50')} AS q50,
       {stable_sql('q75')} AS q75,
       {stable_sql('min(CASE WHEN inside THEN value END)')} AS whisker_low,
       {stable_sql('max(CASE WHEN inside THEN value END)')} AS whisker_high,
       count(CASE WHEN NOT inside THEN 1 END) AS n_outliers
FROM j GROUP BY variation, gendr, metric, q25, q50, q75
""", "bal_long")


def _histogram_sql(metric: str, bins: int = 30) -> str:
    def edge(i: str) -> str:
        return (f"(CASE WHEN {i} >= {bins} THEN hi "
                f"ELSE CAST({i} AS DOUBLE) * ((hi - lo) / {bins}.0e0) + lo END)")
    return f"""
WITH vals AS (SELECT variation, {metric} AS x FROM assigned
              WHERE variation IS NOT NULL AND {metric} IS NOT NULL),
rng AS (SELECT variation,
               CASE WHEN min(x) = max(x) THEN min(x) - 0.5e0 ELSE min(x) END AS lo,
               CASE WHEN min(x) = max(x) THEN max(x) + 0.5e0 ELSE max(x) END AS hi
        FROM vals GROUP BY variation),
f AS (SELECT v.variation, v.x, r.lo, r.hi,
             CAST(least(greatest(floor((v.x - r.lo) * ({bins}.0e0 / (r.hi - r.lo))), 0),
                  {bins - 1}) AS INTEGER) AS f
      FROM vals v JOIN rng r ON v.variation = r.variation),
c AS (SELECT variation,
             CASE WHEN x < {edge('f')} THEN f - 1
                  WHEN x >= {edge('f + 1')} AND f <> {bins - 1} THEN f + 1 ELSE f END AS bin,
             count(*) AS n
      FROM f GROUP BY 1, 2),
g AS (SELECT r.variation, r.lo, r.hi, CAST(b.range AS INTEGER) AS bin
      FROM rng r CROSS JOIN range(0, {bins}) b)
SELECT g.variation, g.bin, {stable_sql(edge('g.bin'))} AS lo,
       {stable_sql(edge('g.bin + 1'))} AS hi, coalesce(c.n, 0) AS n
FROM g LEFT JOIN c ON g.variation = c.variation AND g.bin = c.bin
"""


register("histogram_age", _histogram_sql("clnt_age"), "assigned")
register("histogram_tenure", _histogram_sql("clnt_tenure_yr"), "assigned")
register("age_tenure_relation", f"""
SELECT variation,
       count(CASE WHEN clnt_age IS NOT NULL AND clnt_tenure_yr IS NOT NULL THEN 1 END) AS n,
       {stable_sql('corr(clnt_age, clnt_tenure_yr)')} AS corr
FROM assigned WHERE variation IS NOT NULL GROUP BY variation
""", "assigned")

register("age_tenure_bins", """
SELECT variation, CAST(floor(clnt_age / 10) * 10 AS BIGINT) AS age_bin,
       CAST(floor(clnt_tenure_yr / 5) * 5 AS BIGINT) AS tenure_bin, count(*) AS n
FROM assigned
WHERE variation IS NOT NULL AND clnt_age IS NOT NULL AND clnt_tenure_yr IS NOT NULL
GROUP BY 1, 2, 3
""", "assigned")

# -- dashboards ---------------------------------------------------------------------------
_BAND_RIGHT = ("CASE WHEN clnt_age <= 30 THEN '<=30' WHEN clnt_age <= 50 THEN '30-50' "
               "WHEN clnt_age <= 60 THEN '50-60' WHEN clnt_age > 60 THEN '>60' END")
_BAND_LEFT = ("CASE WHEN clnt_age < 30 THEN '<30' WHEN clnt_age < 50 THEN '30-50' "
              "WHEN clnt_age < 60 THEN '50-60' WHEN clnt_age >= 60 THEN '>=60' END")


def _band_order(labels) -> str:
    arms = " ".join(f"WHEN '{lab}' THEN {pos}" for lab, pos in labels)
    return f"CAST(CASE age_band {arms} END AS INTEGER)"


register("duration_by_age", f"""
SELECT variation, age_band, avg_min,
       {_band_order([('<=30', 1), ('30-50', 2), ('50-60', 3), ('>60', 4)])} AS band_order
FROM (SELECT variation, {_BAND_RIGHT} AS age_band,
             {stable_sql('avg(all_steps_dur_min)')} AS avg_min
      FROM cdur WHERE variation IN ('Control', 'Test') AND ({_BAND_RIGHT}) IS NOT NULL
      GROUP BY 1, 2)
""", "cdur")
register("duration_by_gender", f"""
SELECT variation, gendr, {stable_sql('avg(all_steps_dur_min)')} AS avg_min
FROM cdur WHERE variation IN ('Control', 'Test') AND gendr IN ('F', 'M')
GROUP BY variation, gendr
""", "cdur")
register("step_duration_by_arm", f"""
SELECT variation, process_step, {stable_sql('avg(step_duration_sec)')} AS avg_sec,
       {step_num_sql()} AS step_num
FROM pdur WHERE variation IN ('Control', 'Test') GROUP BY variation, process_step
""", "pdur")
register("step_duration_by_age", f"""
SELECT variation, process_step, age_band, avg_sec,
       {_band_order([('<30', 1), ('30-50', 2), ('50-60', 3), ('>=60', 4)])} AS band_order
FROM (SELECT variation, process_step, {_BAND_LEFT} AS age_band,
             {stable_sql('avg(step_duration_sec)')} AS avg_sec
      FROM pdur WHERE variation IN ('Control', 'Test') AND gendr IN ('F', 'M')
        AND ({_BAND_LEFT}) IS NOT NULL
      GROUP BY 1, 2, 3)
""", "pdur")
register("step_duration_by_gender", f"""
SELECT variation, process_step, gendr, {stable_sql('avg(step_duration_sec)')} AS avg_sec
FROM pdur WHERE variation IN ('Control', 'Test') AND gendr IN ('F', 'M')
GROUP BY variation, process_step, gendr
""", "pdur")
register("duration_log_distribution", f"""
SELECT b.variation, b.log_bin, b.n, m.avg_all
FROM (SELECT variation, CAST(floor(log10(all_steps_dur_min) * 4) AS BIGINT) AS log_bin,
             count(*) AS n
      FROM cdur WHERE variation IN ('Control', 'Test') AND all_steps_dur_min > 0
      GROUP BY 1, 2) b
JOIN (SELECT variation, {stable_sql('avg(all_steps_dur_min)')} AS avg_all FROM cdur
      WHERE variation IN ('Control', 'Test') GROUP BY variation) m
  ON b.variation = m.variation
""", "cdur")

# -- tests --------------------------------------------------------------------------------
def _ztest_sql(counts: str) -> str:
    p_t = "(CAST(x_test AS DOUBLE) / n_test)"
    p_c = "(CAST(x_control AS DOUBLE) / n_control)"
    pooled = "(CAST(x_test + x_control AS DOUBLE) / (n_test + n_control))"
    se = f"sqrt({pooled} * (1 - {pooled}) * (1.0e0 / n_test + 1.0e0 / n_control))"
    z = f"(({p_t} - {p_c}) / {se})"
    return f"""
WITH c AS ({counts}),
one AS (SELECT max(CASE WHEN variation = 'Test' THEN x END) AS x_test,
               max(CASE WHEN variation = 'Control' THEN x END) AS x_control,
               max(CASE WHEN variation = 'Test' THEN n END) AS n_test,
               max(CASE WHEN variation = 'Control' THEN n END) AS n_control FROM c)
SELECT n_test, n_control, x_test, x_control, {stable_sql(p_t)} AS p_test,
       {stable_sql(p_c)} AS p_control, {stable_sql(z)} AS z_stat,
       {stable_sql(norm_sf_sql(z))} AS p_value, {norm_sf_sql(z)} < 0.05 AS reject_h0
FROM one
"""


register("ztest_completion", _ztest_sql(
    "SELECT variation, clients_finished AS x, total_clients AS n FROM fin_tot"), "fin_tot")
register("ztest_error_rate", _ztest_sql("""
SELECT variation, count(CASE WHEN is_error THEN 1 END) AS x,
       count(CASE WHEN step_num IN (1, 2, 3, 4) THEN 1 END) AS n
FROM kev WHERE variation IN ('Control', 'Test') GROUP BY variation"""), "kev")


def _welch_sql() -> str:
    se_t, se_c = "(v_test / n_test)", "(v_control / n_control)"
    t = f"((m_test - m_control) / sqrt({se_t} + {se_c}))"
    dof = (f"(({se_t} + {se_c}) * ({se_t} + {se_c}) / ({se_t} * {se_t} / (n_test - 1) "
           f"+ {se_c} * {se_c} / (n_control - 1)))")
    p = student_t_cdf_sql(t, dof)
    return f"""
WITH w AS (SELECT variation, count(all_steps_dur_hr) AS n, avg(all_steps_dur_hr) AS m,
                  var_samp(all_steps_dur_hr) AS v
           FROM cdur WHERE variation IN ('Control', 'Test') GROUP BY variation),
one AS (SELECT max(CASE WHEN variation = 'Test' THEN n END) AS n_test,
               max(CASE WHEN variation = 'Test' THEN m END) AS m_test,
               max(CASE WHEN variation = 'Test' THEN v END) AS v_test,
               max(CASE WHEN variation = 'Control' THEN n END) AS n_control,
               max(CASE WHEN variation = 'Control' THEN m END) AS m_control,
               max(CASE WHEN variation = 'Control' THEN v END) AS v_control FROM w)
SELECT n_test, n_control, {stable_sql('m_test')} AS mean_test,
       {stable_sql('m_control')} AS mean_control, {stable_sql('v_test')} AS var_test,
       {stable_sql('v_control')} AS var_control, {stable_sql(t)} AS t_stat,
       {stable_sql(dof)} AS df, {stable_sql(p)} AS p_value, {p} < 0.05 AS reject_h0
FROM one
"""


register("welch_duration", _welch_sql(), "cdur")
register("arm_overlap", """
SELECT count(*) AS n_overlap FROM (
  SELECT client_id FROM kev WHERE variation = 'Control'
  INTERSECT SELECT client_id FROM kev WHERE variation = 'Test')
""", "kev")

# -- profiles -----------------------------------------------------------------------------
def _dup_all_cols(table: str, cols: list[str]) -> str:
    keys = ", ".join(cols)
    return f"(SELECT {keys}, count(*) AS c FROM {table} GROUP BY {keys})"


_WEB = ["client_id", "visitor_id", "visit_id", "process_step", "date_time", "event_seq"]
_EXP = ["client_id", "variation"]


def _dup_count(part: str, table: str, cols: list[str]) -> str:
    return (f"SELECT '{part}' AS part, CAST(sum(c) AS BIGINT) AS n_rows, "
            f"CAST(sum(c - 1) AS BIGINT) AS n_duplicates FROM {_dup_all_cols(table, cols)}")


register("duplicate_counts", " UNION ALL ".join([
    _dup_count("web_pt1", "web_pt1", _WEB), _dup_count("web_pt2", "web_pt2", _WEB),
    _dup_count("web_log_clean", "web_clean", _WEB), _dup_count("experiment", "exper", _EXP),
    _dup_count("experiment_client_id", "exper", ["client_id"]),
    _dup_count("demographics_client_id", "demo_c", ["client_id"])]),
    "web_pt1", "web_pt2", "web_clean", "exper", "demo_c")


def _dup_rows(part: str, table: str) -> str:
    on = " AND ".join(f"t.{c} IS NOT DISTINCT FROM d.{c}" for c in _WEB)
    cols = ", ".join(f"t.{c}" for c in _WEB)
    return (f"SELECT '{part}' AS part, {cols}, d.c AS n_copies FROM {table} t "
            f"JOIN (SELECT * FROM {_dup_all_cols(table, _WEB)} WHERE c > 1) d ON {on}")


register("duplicate_rows", _dup_rows("web_pt1", "web_pt1") + " UNION ALL "
         + _dup_rows("web_pt2", "web_pt2"), "web_pt1", "web_pt2")
register("distinct_values", """
SELECT column_name, value, count(*) AS n FROM (
  SELECT 'variation' AS column_name, variation AS value FROM master_t
  UNION ALL SELECT 'process_step', process_step FROM master_t
  UNION ALL SELECT 'gendr', gendr FROM master_t)
GROUP BY column_name, value
""", "master_t")

_PROFILED = {
    "experiment": ("exper", _EXP),
    "demographics": ("demo_raw", ["client_id", "clnt_tenure_yr", "clnt_age", "gendr", "bal"]),
    "web_log_clean": ("web_clean", _WEB),
    "master": ("master_t", ["client_id", "clnt_tenure_yr", "clnt_age", "gendr", "bal",
                            "variation", "visitor_id", "visit_id", "process_step",
                            "date_time", "event_seq"]),
}
register("null_profile", " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, "
    f"count(*) - count({c}) AS n_null FROM {table}"
    for name, (table, cols) in _PROFILED.items() for c in cols),
    "exper", "demo_raw", "web_clean", "master_t")
register("table_profile", " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS n_rows, CAST({len(cols)} AS BIGINT) "
    f"AS n_columns, count(CASE WHEN {' AND '.join(c + ' IS NOT NULL' for c in cols)} "
    f"THEN 1 END) AS n_complete_rows FROM {table}"
    for name, (table, cols) in _PROFILED.items()),
    "exper", "demo_raw", "web_clean", "master_t")
register("null_age_by_arm", """
SELECT variation, count(*) AS n FROM master_t
WHERE clnt_age IS NULL AND variation IS NOT NULL GROUP BY variation
""", "master_t")
register("visitors_per_visit", """
SELECT n_visitors, count(*) AS n_visits FROM (
  SELECT visit_id, count(DISTINCT visitor_id) AS n_visitors FROM kpi_pop
  WHERE visit_id IS NOT NULL GROUP BY visit_id)
GROUP BY n_visitors
""", "kpi_pop")
register("client_trace", """
SELECT client_id, variation, visitor_id, visit_id, process_step, date_time, event_seq,
       step_num, is_error, attempt_no, finish
FROM kev WHERE client_id = (
  SELECT client_id FROM kev GROUP BY client_id ORDER BY count(*) DESC, client_id ASC LIMIT 1)
""", "kev")

# -- exports, sources and sinks -------------------------------------------------------------
_EXPORT = """
SELECT client_id, clnt_tenure_yr, clnt_age, gendr, variation, visit_id, process_step,
       is_error, attempt_no, finish FROM kev
"""
register("tableau_export", _EXPORT, "kev")
register("sink_roundtrip", _EXPORT, "kev")
register("src_csv_typed", "SELECT * FROM web_clean", "web_clean")
register("src_csv_semicolon", "SELECT * FROM pdur", "pdur")

# -- sorted, first and last rows, lookups -----------------------------------------------
register("step_by_step_durations", f"""
SELECT * FROM pdur ORDER BY client_id, visit_id, {ORD}
""", "pdur")
_HEAD = "date_time, event_seq, client_id, visitor_id, visit_id, process_step"
register("web_log_head", f"SELECT {_HEAD} FROM web_clean ORDER BY {_HEAD} LIMIT 20", "web_clean")
register("web_log_tail", f"""
SELECT {_HEAD} FROM web_clean
ORDER BY {', '.join(f'{c} DESC' for c in _HEAD.split(', '))} LIMIT 20
""", "web_clean")
register("client_first_steps", f"""
SELECT * FROM (
  SELECT client_id, date_time, event_seq, process_step,
         CAST(row_number() OVER (PARTITION BY client_id ORDER BY {ORD}) AS INTEGER) AS rank
  FROM wwg)
WHERE rank <= 3
""", "wwg")
_TRACE = ("client_id, variation, visitor_id, visit_id, process_step, date_time, event_seq, "
          "step_num, is_error, attempt_no, finish")
register("client_trace_by_client", f"SELECT {_TRACE} FROM kev WHERE client_id = 6", "kev")
register("client_trace_by_visit", f"SELECT {_TRACE} FROM kev WHERE visit_id = '2_9'", "kev")

# -- sketches: exact counts and quantiles (the sketches are exact at these sizes) -----------
register("step_clients_sketched", """
SELECT variation, process_step, count(DISTINCT client_id) AS n_clients FROM merged
WHERE date_time IS NOT NULL AND process_step IS NOT NULL GROUP BY variation, process_step
""", "merged")
register("daily_clients_sketched", """
SELECT variation, CAST(CAST(date_time AS DATE) AS VARCHAR) AS day,
       count(DISTINCT client_id) AS n_clients
FROM merged WHERE date_time IS NOT NULL GROUP BY 1, 2
""", "merged")
register("finisher_rate_sketched", "SELECT * FROM fin_rate", "fin_rate")
register("arm_overlap_sketched", """
SELECT count(*) AS n_overlap
FROM (SELECT client_id FROM kev WHERE variation = 'Control' AND date_time IS NOT NULL
      INTERSECT SELECT client_id FROM kev WHERE variation = 'Test' AND date_time IS NOT NULL)
""", "kev")


def _inclusive_quantiles(rows: str, value: str, by: str) -> str:
    """The least value with at least the share p of the values at or below it."""
    probs = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}
    picked = ", ".join(f"min(CASE WHEN rn >= {p}e0 * n THEN v END) AS {name}"
                       for name, p in probs.items())
    return f"""
SELECT {by}, n, {picked}
FROM (SELECT {by}, {value} AS v, count(*) OVER (PARTITION BY {by}) AS n,
             row_number() OVER (PARTITION BY {by} ORDER BY {value}) AS rn
      FROM {rows} WHERE {value} IS NOT NULL)
GROUP BY {by}, n
"""


register("balance_quantiles", _inclusive_quantiles(
    "(SELECT * FROM assigned WHERE variation IS NOT NULL)", "bal", "variation"), "assigned")
register("step_duration_quantiles", _inclusive_quantiles(
    "pdur", "step_duration_sec", "variation, process_step"), "pdur")

# -- bootstrap and density ----------------------------------------------------------------
# The Poisson(1) distribution function in units of 1 / 2147483647.
_POISSON = [790015083, 1580030167, 1975037709, 2106706890, 2139624185, 2146207644, 2147304887,
            2147461637, 2147481230, 2147483407, 2147483625]
_WEIGHT = " + ".join(f"CAST(u >= {c} AS BIGINT)" for c in _POISSON)
register("balance_bootstrap", f"""
WITH clients AS (
  SELECT * FROM assigned WHERE variation IS NOT NULL AND gendr IS NOT NULL),
d0 AS (SELECT c.*, r.range AS replicate,
              ((c.client_id % 2147483647) * 48271 + r.range * 69621 + 1) % 2147483647 AS x
       FROM clients c, range(0, 200) r),
d1 AS (SELECT *, (x * x + replicate * 16807 + 12345) % 2147483647 AS y FROM d0),
d2 AS (SELECT * REPLACE ((y * 39373 + x) % 2147483647 AS x) FROM d1),
d3 AS (SELECT *, (x * x + y) % 2147483647 AS u FROM d2),
w AS (SELECT *, {_WEIGHT} AS w FROM d3),
m AS (
  SELECT variation, gendr, 'clnt_age' AS metric,
         sum(w * clnt_age) / nullif(sum(CASE WHEN clnt_age IS NOT NULL THEN w END), 0) AS m
  FROM w GROUP BY variation, gendr, replicate
  UNION ALL
  SELECT variation, gendr, 'clnt_tenure_yr' AS metric,
         sum(w * clnt_tenure_yr) / nullif(sum(CASE WHEN clnt_tenure_yr IS NOT NULL THEN w END), 0) AS m
  FROM w GROUP BY variation, gendr, replicate),
q AS (SELECT variation, gendr, metric, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi
      FROM m GROUP BY variation, gendr, metric),
o AS (SELECT variation, gendr, metric, count(value) AS n, avg(value) AS mean FROM bal_long
      WHERE gendr IS NOT NULL GROUP BY variation, gendr, metric)
SELECT variation, gendr, metric, n, {stable_sql('mean')} AS mean, {stable_sql('lo')} AS ci_low,
       {stable_sql('hi')} AS ci_high
FROM o JOIN q USING (variation, gendr, metric)
""", "assigned", "bal_long")
register("age_tenure_density", f"""
WITH v AS (SELECT variation, metric, value FROM bal_long WHERE value IS NOT NULL),
s AS (SELECT variation, metric, count(*) AS n, min(value) AS lo, max(value) AS hi,
             {stable_sql('stddev_samp(value) * pow(CAST(count(*) AS DOUBLE), -0.2e0)')} AS bandwidth
      FROM v GROUP BY variation, metric),
e AS (SELECT variation, metric, n, bandwidth, {stable_sql('lo - 3 * bandwidth')} AS lo,
             {stable_sql('hi + 3 * bandwidth')} AS hi FROM s WHERE bandwidth > 0),
g AS (SELECT *, (hi - lo) / 127.0e0 AS step FROM e),
a AS (SELECT variation, metric, (value - lo) / step AS pos FROM v JOIN g USING (variation, metric)),
c AS (SELECT variation, metric, bin, sum(w) AS c
      FROM (SELECT variation, metric, floor(pos) AS bin, 1 - (pos - floor(pos)) AS w FROM a
            UNION ALL SELECT variation, metric, floor(pos) + 1, pos - floor(pos) FROM a)
      GROUP BY ALL),
p AS (SELECT g.*, CAST(r.range AS INTEGER) AS point FROM g, range(0, 128) r),
k AS (SELECT variation, metric, point, n, bandwidth, lo, step,
             sum(exp(-0.5e0 * pow((point - bin) * step / bandwidth, 2)) * c) AS k
      FROM p JOIN c USING (variation, metric) GROUP BY ALL)
SELECT variation, metric, point, {stable_sql('lo + point * step')} AS x, n, bandwidth,
       {stable_sql('k / (n * bandwidth * sqrt(2 * pi()))', 9)} AS density
FROM k
""", "bal_long")

# -- sources of mixed dialects, fr_FR ------------------------------------------------------
register("src_csv_dialects", "SELECT * FROM web_clean", "web_clean")
register("src_csv_locale", "SELECT * FROM pdur", "pdur")
