"""Attempt ledger: summaries, budgets, reconciliation and cost estimates (LED-*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadgauge.operators.spread import exact_quantiles, ordered_rank, require_empty, value_ranks

CALL = ["run_id", "logical_call_id", "attempt"]


def every():
    """Window over a whole table of entities (never over rows)."""
    return Window.partitionBy()


def unresolved_pending(rows: DataFrame) -> DataFrame:
    """Pending rows without a final row for the same call and attempt (LED-1)."""
    final = rows.filter("cost_class <> 'pending'").select(*CALL)
    return rows.filter("cost_class = 'pending'").join(final, CALL, "left_anti")


def network_rows(rows: DataFrame) -> DataFrame:
    """Sends: final rows that are not replays, and unresolved pending ones."""
    return rows.filter(~F.col("cost_class").isin("pending", "replay")).unionByName(unresolved_pending(rows))


def _unknown() -> Column:
    return F.count(F.when(F.col("cost_class").isin("unknown", "pending"), 1))


def _usd() -> Column:
    return F.coalesce(F.sum(F.when(F.col("cost_class") == "calculated", F.col("cost_usd"))), F.lit(0.0))


def latency_percentiles(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact p50 and p95 of request time per group, at any group size."""
    return exact_quantiles(rows.filter("request_ms IS NOT NULL"), by, "request_ms", {"p50_ms": 0.5, "p95_ms": 0.95})


def ledger_summary(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Attempts, calls, retries, USD, unknown, replays, tokens and latency (LED-2)."""
    by = list(by)
    net = network_rows(rows)
    calls = net.groupBy(*by, "logical_call_id").agg(F.count(F.lit(1)).alias("k"), F.sum("input_tokens").alias("t"))
    per_call = calls.groupBy(*by).agg(
        F.sum("k").alias("attempts"), F.count(F.when(F.col("k") > 1, 1)).alias("retried_calls"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("input_tokens"),
    )
    sent = net.groupBy(*by).agg(_unknown().alias("unknown_attempts"), _usd().alias("calculated_usd"))
    replay = rows.filter("cost_class = 'replay'")
    seen = net.select(*by, "logical_call_id").unionByName(replay.select(*by, "logical_call_id")).groupBy(*by).agg(
        F.countDistinct("logical_call_id").alias("logical_calls")
    )
    again = replay.groupBy(*by).agg(F.count(F.lit(1)).alias("replays"))
    ms = latency_percentiles(net, by)
    if by:
        out = seen
        for part in (per_call, sent, again, ms):
            out = out.join(part, by, "left")
        return out.fillna(0, ["attempts", "retried_calls", "input_tokens", "unknown_attempts", "replays"]).fillna(0.0, ["calculated_usd"])
    out = seen
    for part in (per_call, sent, again, ms):
        for c in part.columns:
            out = out.withColumn(c, part.select(c).scalar())
    return out


def status_counts(rows: DataFrame) -> DataFrame:
    """Sends by status, none when there was no response (LED-2)."""
    return network_rows(rows).groupBy(F.coalesce("status", F.lit("none")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def budget_rollup(rows: DataFrame, caps: DataFrame, worst_usd: float) -> DataFrame:
    """Committed spend and headroom per budget name, and the account total (LED-3)."""
    net = network_rows(rows)
    spent = net.groupBy("budget_name").agg(_usd().alias("calculated_usd"), _unknown().alias("unknown_attempts"))
    both = spent.join(caps, "budget_name", "left").rollup("budget_name").agg(
        F.sum("calculated_usd").alias("calculated_usd"), F.sum("unknown_attempts").alias("unknown_attempts"), F.sum("cap_usd").alias("cap_usd")
    )
    committed = F.col("calculated_usd") + F.col("unknown_attempts") * F.lit(worst_usd)
    return both.withColumn("budget_name", F.coalesce("budget_name", F.lit("account"))).withColumn("committed_usd", committed).withColumn(
        "headroom_usd", F.col("cap_usd") - F.col("committed_usd")
    )


def admission(requests: DataFrame, caps: DataFrame, account_cap: float) -> DataFrame:
    """Which requests pass both caps when taken in order (LED-4).

    Running totals come from bucketed prefix sums, so no budget's requests are
    ordered in one task. ``requests``: seq (unique), budget_name, cost; cost in
    whole micro units keeps the sums exact.
    """
    mine = value_ranks(requests, ["budget_name"], "seq", ["cost"]).select("budget_name", "seq", (F.col("cost_below") + F.col("cost")).alias("name_total"))
    whole = value_ranks(requests, [], "seq", ["cost"]).select("seq", (F.col("cost_below") + F.col("cost")).alias("account_total"))
    rows = requests.join(mine, ["budget_name", "seq"]).join(whole, "seq").join(caps, "budget_name", "left")
    return rows.withColumn("admitted", (F.col("name_total") <= F.col("cap")) & (F.col("account_total") <= F.lit(account_cap)))


def run_rows(rows: DataFrame, phases: DataFrame, check: bool = True) -> DataFrame:
    """One row per run: calls, attempts, retries, wall seconds, latency, cache hits (LED-5)."""
    if check:
        require_empty(phases.select("run_id").join(rows.select("run_id"), "run_id", "left_anti"), "run without ledger")
    summary = ledger_summary(rows, ["run_id"])
    wall = rows.groupBy("run_id").agg((F.max("ended_s") - F.min("started_s")).alias("wall_s"))
    sent = network_rows(rows).groupBy("run_id").agg(F.countDistinct("logical_call_id").alias("__c"))
    out = summary.join(wall, "run_id").join(sent, "run_id", "left").join(phases, "run_id")
    return out.select(
        "run_id", "phase", F.col("logical_calls").alias("calls"), "attempts", (F.col("attempts") - F.coalesce("__c", F.lit(0))).alias("retries"),
        "unknown_attempts", "calculated_usd", "wall_s", "p50_ms", "p95_ms", F.col("replays").alias("cache_hits"),
    )


def reconcile(balances: DataFrame, rows: DataFrame, worst_usd: float, epsilon: float = 0.005) -> DataFrame:
    """Consecutive balances against ledger spend in (start, end] (LED-6).

    Balance and spend times are ranked together: the number of balances before a
    time is its interval, found without a range join or a collected list.
    """
    net = network_rows(rows).withColumn("at", F.coalesce("ended_s", "started_s").cast("double"))
    spent = net.groupBy("at").agg(_usd().alias("calculated"), _unknown().alias("unknown_attempts"))
    times = balances.select(F.col("at").cast("double").alias("at"), F.lit(1).alias("i")).unionByName(spent.select("at", F.lit(0).alias("i")))
    before = value_ranks(times, [], "at", sums=["i"]).select("at", F.col("i_below").alias("i"))
    spent = spent.join(before, "at").groupBy("i").agg(F.sum("calculated").alias("calculated"), F.sum("unknown_attempts").alias("unknown_attempts"))
    steps = ordered_rank(balances, [F.col("at").asc(), F.col("usd").desc()], "i")
    after = steps.select((F.col("i") - 1).alias("i"), F.col("at").alias("end"), F.col("usd").alias("next_usd"))
    out = steps.join(after, "i").join(spent, "i", "left").fillna(0.0, ["calculated"]).fillna(0, ["unknown_attempts"])
    delta = F.col("usd") - F.col("next_usd")
    diff = delta - F.col("calculated")
    worst = F.col("unknown_attempts") * F.lit(worst_usd)
    status = F.when((F.abs(diff) <= epsilon) & (F.col("unknown_attempts") == 0), "reconciled").when(
        (diff >= -epsilon) & (diff <= worst + epsilon), "explained_by_unknown"
    ).otherwise("unexplained")
    return out.select(
        F.col("at").alias("start"), "end", delta.alias("provider_delta"), "calculated", "unknown_attempts", worst.alias("unknown_worst_usd"),
        diff.alias("difference"), status.alias("status"),
    )


def calibrate(rows: DataFrame) -> DataFrame:
    """Least squares tokens on bytes per question set; mean ratio when bytes do not vary (LED-7)."""
    used = rows.filter("cost_class = 'calculated' AND input_tokens IS NOT NULL")
    fit = used.groupBy("question_set").agg(
        F.regr_slope("input_tokens", "body_bytes").alias("__s"), F.regr_intercept("input_tokens", "body_bytes").alias("__i"),
        (F.max("body_bytes") > F.min("body_bytes")).alias("__v"), (F.avg("input_tokens") / F.avg("body_bytes")).alias("__r"), F.count(F.lit(1)).alias("n"),
    )
    return fit.select(
        "question_set", F.when(F.col("__v"), F.col("__s")).otherwise(F.col("__r")).alias("slope"),
        F.when(F.col("__v"), F.col("__i")).otherwise(0.0).alias("intercept"), "n",
    )


def estimate_cost(items: DataFrame, calibration: DataFrame, usd_per_token: float) -> DataFrame:
    """Calls, tokens and USD per question set over all items (LED-8)."""
    rows = items.join(calibration.select("question_set", "slope", "intercept"), "question_set", "left")
    fitted = F.greatest(F.lit(1), F.ceil(F.col("slope") * F.col("body_bytes") + F.col("intercept")))
    tokens = F.when(F.col("slope").isNotNull(), fitted).otherwise(F.ceil(F.col("body_bytes") / F.lit(3.2)))
    out = rows.groupBy("question_set").agg(
        F.count(F.lit(1)).alias("calls"), F.sum(tokens).cast("bigint").alias("est_input_tokens"),
        F.max(F.when(F.col("slope").isNotNull(), "calibrated").otherwise("bytes/3.2")).alias("method"),
    )
    return out.withColumn("est_usd", F.col("est_input_tokens") * usd_per_token)


def probe_estimate(items: DataFrame, step: int, key: str = "comment_id") -> DataFrame:
    """Mean tokens of every step-th item in id order, scaled to all items (LED-8)."""
    placed = value_ranks(items.select(key), [], key).select(key, "n_below").filter(F.col("n_below") % step == 0)
    tokens = items.join(placed.select(key), key, "left_semi").select(F.ceil(F.col("body_bytes") / F.lit(3.2)).alias("t"))
    total = items.agg(F.count(F.lit(1))).scalar()
    return tokens.agg(F.count(F.lit(1)).alias("n_probe"), F.avg("t").alias("mean_tokens")).withColumn("est_tokens", F.col("mean_tokens") * total)


def spend_by_phase(runs: DataFrame) -> DataFrame:
    """Calls, USD, wall and runs per phase, largest spend first (LED-9)."""
    return runs.groupBy("phase").agg(
        F.sum("calls").alias("calls"), F.sum("calculated_usd").alias("usd"), F.sum("wall_s").alias("wall_s"), F.count(F.lit(1)).alias("runs")
    ).orderBy(F.col("usd").desc(), "phase")


def token_stats(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """n, mean, p50, p95 of tokens, USD and calls per group (LED-10)."""
    used = rows.filter("cost_class = 'calculated' AND input_tokens IS NOT NULL")
    base = used.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("input_tokens").alias("mean_tokens"), F.sum("cost_usd").alias("usd"),
        F.countDistinct("logical_call_id").alias("calls"), (F.max("ended_s") - F.min("started_s")).alias("wall_s"),
    )
    return base.join(exact_quantiles(used, by, "input_tokens", {"p50_tokens": 0.5, "p95_tokens": 0.95}), list(by))


