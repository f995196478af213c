"""Role tables: the columns an operator needs, derived row by row from the given tables.

Each role is a projection written in SQL that both engines read the same way,
so a plan and its twin start from identical inputs.
"""

from __future__ import annotations


def _pad(expr: str) -> str:
    return f"lpad(cast({expr} as string), 2, '0')"


_CARD = "((o_orderkey * 7 + o_custkey) % 25)"
_GROUP = "((o_orderkey * 7 + o_custkey) % 5)"
_CENTS = "cast(floor(o_totalprice) as bigint)"
_DAYS = "((year(o_orderdate) - 1992) * 372 + (month(o_orderdate) - 1) * 31 + day(o_orderdate) - 1)"


def _prob(mult: int, add: int = 0) -> str:
    return f"(cast((({_CENTS} * {mult} + o_orderkey + {add}) % 101) as double) / 1e2)"


def _pick(names: list[str], expr: str) -> str:
    whens = " ".join(f"when {i} then '{n}'" for i, n in enumerate(names))
    return f"(case {expr} {whens} end)"


DOMAINS = ["web", "data", "hardware", "work", "money", "other"]
ROLE_NAMES = ["developer", "operator", "founder", "student", "unclear"]

ROLES: dict[str, tuple[str, list[str]]] = {
    # One coded problem report per order.
    "problems": ("orders", [
        "o_orderkey as comment_id",
        "o_custkey as story_id",
        "(case when o_orderkey % 41 = 0 then null else concat('u', cast(o_orderkey % 997 as string)) end) as author",
        "o_orderpriority as stratum",
        f"concat('P', {_pad('month(o_orderdate)')}) as period",
        "(case when month(o_orderdate) <= 6 then 'H1' else 'H2' end) as half",
        f"cast({_DAYS} as bigint) * 86400 + o_orderkey % 86400 as time",
        "cast(8 + 4 * (o_custkey % 4) as double) as weight",
        f"(case when o_orderkey % 29 = 0 then null else concat('g', cast({_GROUP} as string)) end) as group_id",
        f"(case when o_orderkey % 29 = 0 then null when o_orderkey % 13 = 0 then 'none' else concat('c', {_pad(_CARD)}) end) as card_id",
        f"{_prob(1)} as card_p",
        f"{_prob(3)} as group_p",
        f"{_prob(7, 5)} as firsthand_p",
        f"(case when o_orderkey % 17 = 0 then null else {_prob(11, 3)} end) as verified_p",
        "(case when o_orderstatus = 'F' then 'neg' else 'pos' end) as phase",
        f"(case when o_orderkey % 7 = 0 then null else {_prob(13)} end) as f_paid",
        f"(case when o_orderkey % 9 = 0 then null else {_prob(17)} end) as f_switched",
        f"(case when o_orderkey % 10 = 0 then null else {_prob(19)} end) as f_abandoned",
        f"(case when o_orderkey % 6 = 0 then null else {_prob(23)} end) as f_workaround",
        f"(case when o_orderkey % 5 = 0 then null else cast(({_CENTS} + o_custkey) % 31 as double) / 1e1 end) as severity",
        f"(case when o_orderkey % 8 = 0 then null else cast(({_CENTS} * 3 + o_custkey) % 31 as double) / 1e1 end) as specificity",
        f"{_pick(DOMAINS, f'(({_CENTS} + o_custkey) % 6)')} as domain",
        f"{_pick(ROLE_NAMES, f'(({_CENTS} + o_orderkey) % 5)')} as role",
        "(case when o_orderkey % 3 = 0 then 'resolved' when o_orderkey % 3 = 1 then 'unresolved' else 'unclear' end) as resolution",
        f"(case when o_orderkey % 4 = 0 then null else {_prob(29)} end) as solved_p",
    ]),
    # Threaded items with injected orphans and two-item cycles.
    "items": ("conversations", [
        "conv_id * 100 + turn as id",
        "(case when turn = 0 then null when turn = 1 and conv_id % 10 = 3 then 900000000 + conv_id"
        " when turn = 1 and conv_id % 10 = 7 then conv_id * 100 + 2 else conv_id * 100 + turn - 1 end) as parent_id",
        "(case when turn > 0 then 'comment' when conv_id % 9 = 4 then 'poll' when conv_id % 9 = 5 then 'job'"
        " when conv_id % 9 = 8 then 'pollopt' else 'story' end) as type",
        "(case when (conv_id + turn) % 23 = 5 then 'null' when (conv_id + turn) % 19 = 3 then 'deleted'"
        " when (conv_id + turn) % 17 = 2 then 'dead' else 'ok' end) as raw_state",
        "1704067200 + conv_id * 21600 + turn * 97 as time",
        "concat((case conv_id % 6 when 0 then 'Ask HN: ' when 1 then 'Show HN: ' when 2 then 'Launch HN: '"
        " when 3 then 'Tell HN: ' else '' end), text) as title",
        "concat(role, cast(conv_id % 13 as string)) as author",
        "text",
        "conv_id",
        "turn",
    ]),
    # Longer reply chains: each user's n-th event answers an earlier event of the same user.
    "event_items": ("events", [
        "event_id as id", "user_id", "event_type", "value", "ts",
    ]),
    # Long answers; repeats of (comment, question) come from event parts.
    "answers": ("events", [
        "cast(floor(event_id / 5) as bigint) as comment_id",
        "event_type as question_id",
        "cast(floor(value * 1e2) as bigint) % 101 / 1e2 as noul",
        "event_id % 7 as part",
        "event_id as seq",
        "user_id as run_id",
        "(case event_id % 3 when 0 then 'a' when 1 then 'b' else 'none' end) as choice",
        "cast(event_id % 4 as double) as score",
    ]),
    # Attempts: one per event, three attempts per logical call.
    "attempts": ("events", [
        "concat('run', cast(user_id % 10 as string)) as run_id",
        "cast(floor(event_id / 3) as bigint) as logical_call_id",
        "event_id % 3 + 1 as attempt",
        "event_id as seq",
        "(case event_type when 'error' then 'unknown' when 'click' then 'calculated' when 'view' then 'calculated'"
        " when 'signup' then 'replay' else 'pending' end) as cost_class",
        "(case when event_type = 'error' then 'error' when event_id % 10 = 0 then 'timeout' else 'ok' end) as status",
        "cast(cast(floor(value * 1e2) as bigint) % 997 as bigint) as latency_ms",
        "cast(cast(floor(value) as bigint) % 500 + 100 as bigint) as tokens",
        "cast(floor(value * 1e2) as bigint) as usd_micros",
        "(case user_id % 3 when 0 then 'screen' when 1 then 'facets' else 'cards' end) as question_set",
        "concat('budget', cast(user_id % 4 as string)) as budget_name",
        "cast(500 + (event_id * 37) % 4000 as bigint) as body_bytes",
        "event_id * 259 as started_s",
        "event_id * 259 + cast(floor(value) as bigint) % 60 as ended_s",
    ]),
    # Two-phase and audit inputs share the document corpus.
    "docs": ("documents", [
        "doc_id", "text", "lang", "source", "n_chars",
    ]),
}


def cte(name: str) -> str:
    """The role as a SELECT for the SQL twin."""
    table, exprs = ROLES[name]
    return f"SELECT {', '.join(exprs)} FROM {table}"


def with_roles(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({cte(n)})" for n in names)


def h60(*parts: str) -> str:
    """Twin of ``hash60``; parts are SQL expressions."""
    joined = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5({joined}), 1, 15) AS BIGINT)"


def h32(*parts: str) -> str:
    joined = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5({joined}), 1, 8) AS BIGINT)"
