"""Ledger and streaming plans (LED, STR): events are the attempt log."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadgauge.operators import ledger as lg
from threadgauge.plans.estimates import rounded
from threadgauge.plans.registry import Tables, plan
from threadgauge.plans.roles import cte
from threadgauge.streaming import jobs

LOG = f"""attempts AS ({cte('attempts')}), log AS (SELECT run_id, logical_call_id, attempt, seq, question_set, budget_name, body_bytes, started_s, NULL AS ended_s, 'pending' AS cost_class, NULL AS status, NULL AS request_ms, NULL AS input_tokens, NULL AS cost_usd FROM attempts
 UNION ALL SELECT run_id, logical_call_id, attempt, seq, question_set, budget_name, body_bytes, started_s, ended_s, cost_class, status, latency_ms, CASE WHEN cost_class = 'unknown' THEN NULL ELSE tokens END, usd_micros / 1e6 FROM attempts WHERE cost_class <> 'pending'),
 lost AS (SELECT * FROM log l WHERE cost_class = 'pending' AND NOT EXISTS (SELECT 1 FROM log f WHERE f.cost_class <> 'pending' AND f.run_id = l.run_id AND f.logical_call_id = l.logical_call_id AND f.attempt = l.attempt)),
 net AS (SELECT * FROM log WHERE cost_class NOT IN ('pending', 'replay') UNION ALL SELECT * FROM lost)"""


def log(t: Tables):
    rows = t.role("attempts")
    null = F.lit(None)
    keys = ["run_id", "logical_call_id", "attempt", "seq", "question_set", "budget_name", "body_bytes", "started_s"]
    pending = rows.select(
        *keys, null.cast("bigint").alias("ended_s"), F.lit("pending").alias("cost_class"), null.cast("string").alias("status"),
        null.cast("bigint").alias("request_ms"), null.cast("bigint").alias("input_tokens"), null.cast("double").alias("cost_usd"),
    )
    final = rows.filter("cost_class <> 'pending'").select(
        *keys, "ended_s", "cost_class", "status", F.col("latency_ms").alias("request_ms"),
        F.when(F.col("cost_class") != "unknown", F.col("tokens")).alias("input_tokens"), (F.col("usd_micros") / 1e6).alias("cost_usd"),
    )
    return pending.unionByName(final)


@plan("led_01_unresolved_pending", f"WITH {LOG} SELECT run_id, logical_call_id, attempt FROM lost")
def _(t: Tables):
    return lg.unresolved_pending(log(t)).select("run_id", "logical_call_id", "attempt")


def summary_sql(key: str | None) -> str:
    k = f"{key}, " if key else ""
    g = "GROUP BY ALL"

    def at(name: str) -> str:
        return f"JOIN {name} USING ({key})" if key else f"CROSS JOIN {name}"

    left = f"LEFT JOIN rpl USING ({key})" if key else "CROSS JOIN rpl"
    return f"""cl AS (SELECT {k}logical_call_id, count(*) AS n, sum(input_tokens) AS t FROM net {g}), pc AS (SELECT {k}sum(n) AS attempts, count(*) FILTER (n > 1) AS retried_calls, coalesce(sum(t), 0) AS input_tokens FROM cl {g}),
 sn AS (SELECT {k}count(*) FILTER (cost_class IN ('unknown', 'pending')) AS unknown_attempts, coalesce(sum(cost_usd) FILTER (cost_class = 'calculated'), 0) AS calculated_usd, quantile_cont(request_ms::DOUBLE, 0.5) AS p50_ms, quantile_cont(request_ms::DOUBLE, 0.95) AS p95_ms FROM net {g}),
 lc AS (SELECT {k}count(DISTINCT logical_call_id) AS logical_calls FROM log WHERE cost_class = 'replay' OR (run_id, logical_call_id, attempt) IN (SELECT (run_id, logical_call_id, attempt) FROM net) {g}), rpl AS (SELECT {k}count(*) AS replays FROM log WHERE cost_class = 'replay' {g}),
 summary AS (SELECT {k}logical_calls, CAST(attempts AS BIGINT) AS attempts, retried_calls, CAST(input_tokens AS BIGINT) AS input_tokens, unknown_attempts, calculated_usd, coalesce(replays, 0) AS replays, p50_ms, p95_ms FROM lc {at('pc')} {at('sn')} {left})"""


ROUND = "round(calculated_usd, 6) AS calculated_usd, round(p50_ms, 6) AS p50_ms, round(p95_ms, 6) AS p95_ms"


@plan("led_02_summary", f"WITH {LOG}, {summary_sql(None)} SELECT * REPLACE ({ROUND}) FROM summary")
def _(t: Tables):
    return rounded(lg.ledger_summary(log(t)), "calculated_usd", "p50_ms", "p95_ms")


@plan("led_02_summary_by_set", f"WITH {LOG}, {summary_sql('question_set')} SELECT * REPLACE ({ROUND}) FROM summary")
def _(t: Tables):
    return rounded(lg.ledger_summary(log(t), ["question_set"]), "calculated_usd", "p50_ms", "p95_ms")


@plan("led_02_by_status", f"WITH {LOG} SELECT coalesce(status, 'none') AS status, count(*) AS n FROM net GROUP BY 1")
def _(t: Tables):
    return lg.status_counts(log(t))


def caps(t: Tables):
    return t.role("attempts").select("budget_name").distinct().withColumn("cap_usd", F.lit(5000.0))


@plan("led_03_budget_rollup", f"""WITH {LOG}, s AS (SELECT budget_name, coalesce(sum(cost_usd) FILTER (cost_class = 'calculated'), 0) AS u, count(*) FILTER (cost_class IN ('unknown', 'pending')) AS k, 5e3 AS cap FROM net GROUP BY 1)
 SELECT coalesce(budget_name, 'account') AS budget_name, round(sum(u), 6) AS calculated_usd, CAST(sum(k) AS BIGINT) AS unknown_attempts, sum(cap) AS cap_usd, round(sum(u) + sum(k) * 0.01::DOUBLE, 6) AS committed_usd, round(sum(cap) - sum(u) - sum(k) * 0.01::DOUBLE, 6) AS headroom_usd FROM s GROUP BY ROLLUP (budget_name)""")
def _(t: Tables):
    return rounded(lg.budget_rollup(log(t), caps(t), 0.01), "calculated_usd", "committed_usd", "headroom_usd")


@plan("led_04_admission", f"WITH attempts AS ({cte('attempts')}) SELECT seq, budget_name, sum(usd_micros) OVER (PARTITION BY budget_name ORDER BY seq) <= 20000000 AND sum(usd_micros) OVER (ORDER BY seq) <= 60000000 AS admitted FROM attempts")
def _(t: Tables):
    requests = t.role("attempts").select("seq", "budget_name", F.col("usd_micros").alias("cost"))
    limits = requests.select("budget_name").distinct().withColumn("cap", F.lit(20_000_000))
    return lg.admission(requests, limits, 60_000_000).select("seq", "budget_name", "admitted")


PHASES = "ph AS (SELECT DISTINCT run_id, CASE WHEN run_id IN ('run0', 'run1', 'run2') THEN 'pilot' WHEN run_id = 'run3' THEN 'audit' ELSE 'main' END AS phase FROM attempts)"
RUNS = f"""{PHASES}, {summary_sql('run_id')}, wl AS (SELECT run_id, max(ended_s) - min(started_s) AS wall_s FROM log GROUP BY 1), nc AS (SELECT run_id, count(DISTINCT logical_call_id) AS c FROM net GROUP BY 1),
 runs AS (SELECT run_id, phase, logical_calls AS calls, attempts, attempts - c AS retries, unknown_attempts, calculated_usd, wall_s, p50_ms, p95_ms, replays AS cache_hits FROM summary JOIN wl USING (run_id) JOIN nc USING (run_id) JOIN ph USING (run_id))"""


def phases(t: Tables):
    return t.role("attempts").select("run_id").distinct().withColumn("phase", F.expr("case when run_id in ('run0', 'run1', 'run2') then 'pilot' when run_id = 'run3' then 'audit' else 'main' end"))


def runs(t: Tables):
    return lg.run_rows(log(t), phases(t))


@plan("led_05_run_rows", f"WITH {LOG}, {RUNS} SELECT * REPLACE ({ROUND}) FROM runs")
def _(t: Tables):
    return rounded(runs(t), "calculated_usd", "p50_ms", "p95_ms")


BALANCES = "bal AS (SELECT max(event_id) * 259 AS bt, CASE day(ts) % 3 WHEN 0 THEN 500e0 WHEN 1 THEN 470e0 ELSE 465e0 END AS usd FROM events GROUP BY day(ts))"


@plan("led_06_balance_reconciliation", f"""WITH {LOG}, {BALANCES}, st AS (SELECT bt AS start, lead(bt) OVER (ORDER BY bt) AS "end", usd - lead(usd) OVER (ORDER BY bt) AS delta FROM bal), x AS (SELECT start, "end", delta, coalesce(sum(cost_usd) FILTER (cost_class = 'calculated'), 0) AS c,
 count(*) FILTER (cost_class IN ('unknown', 'pending')) AS k FROM st LEFT JOIN net ON coalesce(ended_s, started_s) > start AND coalesce(ended_s, started_s) <= "end" WHERE "end" IS NOT NULL GROUP BY ALL)
 SELECT start, "end", round(delta, 6) AS provider_delta, round(c, 6) AS calculated, k AS unknown_attempts, round(k * 0.2::DOUBLE, 6) AS unknown_worst_usd, round(delta - c, 6) AS difference,
 CASE WHEN abs(delta - c) <= 5e-3 AND k = 0 THEN 'reconciled' WHEN delta - c >= -5e-3 AND delta - c <= k * 0.2::DOUBLE + 5e-3 THEN 'explained_by_unknown' ELSE 'unexplained' END AS status FROM x""")
def _(t: Tables):
    balances = t.events.groupBy(F.day("ts").alias("d")).agg((F.max("event_id") * 259).alias("at")).select("at", F.expr("case d % 3 when 0 then 500d when 1 then 470d else 465d end").alias("usd"))
    return rounded(lg.reconcile(balances, log(t), 0.2), "provider_delta", "calculated", "unknown_worst_usd", "difference")


FIT = "fit AS (SELECT question_set, regr_slope(input_tokens, body_bytes) AS slope, regr_intercept(input_tokens, body_bytes) AS intercept, count(*) AS n FROM log WHERE cost_class = 'calculated' AND input_tokens IS NOT NULL GROUP BY 1)"


@plan("led_07_calibration", f"WITH {LOG}, {FIT} SELECT question_set, round(slope, 6) AS slope, round(intercept, 4) AS intercept, n FROM fit")
def _(t: Tables):
    return rounded(rounded(lg.calibrate(log(t)), "slope"), "intercept", digits=4)


@plan("led_08_cost_estimate", f"""WITH {LOG}, {FIT}, i AS (SELECT CASE WHEN event_id % 4 = 3 THEN 'other' ELSE ['screen', 'facets', 'cards'][event_id % 4 + 1] END AS question_set, 300 + event_id % 5000 AS body_bytes FROM events),
 c AS (SELECT question_set, slope IS NOT NULL AS f, CASE WHEN slope IS NOT NULL THEN greatest(1, ceil(slope * body_bytes + intercept)) ELSE ceil(body_bytes / 3.2::DOUBLE) END AS t FROM i LEFT JOIN fit USING (question_set))
 SELECT question_set, count(*) AS calls, CAST(sum(t) AS BIGINT) AS est_input_tokens, CASE WHEN bool_or(f) THEN 'calibrated' ELSE 'bytes/3.2' END AS method, round(sum(t) * 5e-8, 6) AS est_usd FROM c GROUP BY 1""")
def _(t: Tables):
    rows = t.events.select(F.expr("case event_id % 4 when 0 then 'screen' when 1 then 'facets' when 2 then 'cards' else 'other' end").alias("question_set"), (F.col("event_id") % 5000 + 300).alias("body_bytes"))
    return rounded(lg.estimate_cost(rows, lg.calibrate(log(t)), 5e-8), "est_usd")


@plan("led_08_probe_estimate", "WITH p AS (SELECT ceil((300 + o_orderkey % 5000) / 3.2::DOUBLE) AS t, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT count(*) AS n_probe, round(avg(t), 6) AS mean_tokens, round(avg(t) * any_value(n), 4) AS est_tokens FROM p WHERE i % 40 = 0")
def _(t: Tables):
    rows = t.orders.select(F.col("o_orderkey").alias("comment_id"), (F.col("o_orderkey") % 5000 + 300).alias("body_bytes"))
    return rounded(rounded(lg.probe_estimate(rows, 40), "mean_tokens"), "est_tokens", digits=4)


@plan("led_09_spend_by_phase", f"WITH {LOG}, {RUNS} SELECT phase, CAST(sum(calls) AS BIGINT) AS calls, round(sum(calculated_usd), 6) AS usd, CAST(sum(wall_s) AS BIGINT) AS wall_s, count(*) AS runs FROM runs GROUP BY 1")
def _(t: Tables):
    return rounded(lg.spend_by_phase(runs(t)), "usd")


@plan("led_10_token_stats", f"""WITH {LOG} SELECT question_set, run_id, count(*) AS n, round(avg(input_tokens), 6) AS mean_tokens, round(sum(cost_usd), 6) AS usd, count(DISTINCT logical_call_id) AS calls, max(ended_s) - min(started_s) AS wall_s,
 round(quantile_cont(input_tokens::DOUBLE, 0.5), 6) AS p50_tokens, round(quantile_cont(input_tokens::DOUBLE, 0.95), 6) AS p95_tokens FROM log WHERE cost_class = 'calculated' GROUP BY ALL""")
def _(t: Tables):
    return rounded(lg.token_stats(log(t), ["question_set", "run_id"]), "mean_tokens", "usd", "p50_tokens", "p95_tokens")


def stream(t: Tables):
    return jobs.read_stream(t.spark, t.path("events"))


@plan("led_11_str_01_running_spend", f"WITH attempts AS ({cte('attempts')}) SELECT run_id, CAST(sum(CASE WHEN cost_class = 'calculated' THEN usd_micros ELSE 0 END) AS BIGINT) AS calculated_micros, count(*) AS n_rows FROM attempts GROUP BY 1")
def _(t: Tables):
    from threadgauge.plans.roles import ROLES

    rows = stream(t).selectExpr(*ROLES["attempts"][1]).withColumnRenamed("usd_micros", "cost_micros")
    return jobs.final_state(jobs.drain(jobs.running_spend(rows), "update"), ["run_id"])


def streamed_calls(t: Tables):
    base = stream(t).select(
        F.expr("concat('run', user_id % 10)").alias("run_id"), F.expr("event_id div 3").alias("logical_call_id"), F.expr("event_id % 3 + 1").alias("attempt"),
        F.col("ts").cast("timestamp").alias("ts"), "event_type", "event_id",
    )
    final = base.filter("event_type <> 'purchase'").withColumn("ts", F.col("ts") + F.expr("INTERVAL 5 minutes")).withColumn("cost_class", F.expr("if(event_type = 'error', 'unknown', 'calculated')"))
    return base, final


@plan("str_02_pending_resolution", """WITH e AS (SELECT 'run' || CAST(user_id % 10 AS VARCHAR) AS run_id, event_id // 3 AS logical_call_id, event_id % 3 + 1 AS attempt, ts, event_type FROM events),
 w AS (SELECT least(max(ts), max(ts + INTERVAL 5 MINUTE) FILTER (event_type <> 'purchase')) - INTERVAL 10 MINUTE AS wm FROM e)
 SELECT run_id, logical_call_id, attempt, CASE WHEN event_type = 'purchase' AND ts + INTERVAL 1 HOUR >= wm THEN 'pending' WHEN event_type IN ('purchase', 'error') THEN 'unknown' ELSE 'calculated' END AS cost_class FROM e, w""")
def _(t: Tables):
    pending, final = streamed_calls(t)
    made = t.events.selectExpr("concat('run', user_id % 10) as run_id", "event_id div 3 as logical_call_id", "event_id % 3 + 1 as attempt", "cast(ts as timestamp) as ts")
    out = jobs.with_open_calls(jobs.drain(jobs.pending_resolution(pending, final), "append"), made)
    return out.select("run_id", "logical_call_id", "attempt", "cost_class")


@plan("str_03_latest_label", "SELECT user_id AS comment_id, event_type AS question_id, arg_max(value, event_id) AS value, max(event_id) AS seq FROM events GROUP BY ALL")
def _(t: Tables):
    rows = stream(t).select(F.col("user_id").alias("comment_id"), F.col("event_type").alias("question_id"), "value", F.col("event_id").alias("seq"))
    return jobs.latest_label(rows)


@plan("str_04_period_counts", """WITH b AS (SELECT TIMESTAMP '2024-01-01' + to_seconds(CAST(floor(epoch(ts - TIMESTAMP '2024-01-01') / 216000) AS BIGINT) * 216000) AS period_start, event_type, (SELECT max(ts) FROM events) - INTERVAL 1 DAY AS wm FROM events)
 SELECT period_start, event_type, count(*) AS n, period_start + INTERVAL 60 HOUR <= wm AS closed FROM b GROUP BY ALL""")
def _(t: Tables):
    rows = stream(t).withColumn("ts", F.col("ts").cast("timestamp"))
    closed = jobs.drain(jobs.period_counts(rows, "2024-01-01", 216_000), "append")
    counts = jobs.period_counts(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "2024-01-01", 216_000)
    out = jobs.with_open_periods(closed, counts)
    return out.select(F.col("period_start").cast("timestamp_ntz").alias("period_start"), "event_type", "n", "closed")


@plan("str_05_unique_requests", "SELECT DISTINCT CAST(user_id AS VARCHAR) || ':' || event_type AS request_key FROM events")
def _(t: Tables):
    rows = stream(t).select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("request_key"), F.col("ts").cast("timestamp").alias("ts"))
    return jobs.drain(jobs.unique_requests(rows, "30 days"), "append").select("request_key")
