"""Release gates: fields, text length, vocabulary, patterns, claims, drift (GATE-*).

Every gate returns its findings as rows; no rows means the table may go out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from threadgauge.operators.cards import union_all

# Field names that never leave, and columns whose length is not audited.
FORBIDDEN = ("text", "text_norm", "text_html", "title", "author", "by", "sentences", "comment", "parent")
LENGTH_EXEMPT = ("url", "probabilities_json")
EXEMPT_SUFFIXES = ("_sha256", "_hash")
MAX_MEDIAN = 80

# Pattern rules of this package (Java syntax; also valid in RE2).
PATTERNS = {
    "url": r"https?://[^\s\"'<>)\]]+",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "local_path": r"/Users/|/home/|[A-Za-z]:\\Users\\",
    "access_key": r"\bAKIA[0-9A-Z]{16}\b",
    "bearer": r"(?i)\bbearer\s+[A-Za-z0-9._-]{20,}",
    "assigned_secret": r"(?i)\b(?:api[_-]?key|secret|password|token)\b\s*[:=]\s*\S{6,}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
}


def field_names(kind: DataType, prefix: str = "") -> Iterator[tuple[str, str]]:
    """(path, name) of every field at any nesting (JSN-3)."""
    if isinstance(kind, StructType):
        for f in kind:
            path = f"{prefix}.{f.name}".lstrip(".")
            yield path, f.name
            yield from field_names(f.dataType, path)
    elif isinstance(kind, ArrayType):
        yield from field_names(kind.elementType, prefix)
    elif isinstance(kind, MapType):
        yield from field_names(kind.valueType, prefix)


def _leaves(kind: DataType, path: str, values: Column) -> Iterator[tuple[str, Column, bool]]:
    """(path, string array, is map key) of every string below an array of values."""
    present = F.filter(values, lambda v: v.isNotNull())
    if isinstance(kind, StringType):
        yield path, present, False
    elif isinstance(kind, StructType):
        for f in kind:
            yield from _leaves(f.dataType, f"{path}.{f.name}", F.transform(present, lambda v: v.getField(f.name)))
    elif isinstance(kind, ArrayType):
        yield from _leaves(kind.elementType, path, F.flatten(present))
    elif isinstance(kind, MapType):
        if isinstance(kind.keyType, StringType):
            yield path, F.flatten(F.transform(present, F.map_keys)), True
        yield from _leaves(kind.valueType, path, F.flatten(F.transform(present, F.map_values)))


def string_leaves(df: DataFrame) -> list[tuple[str, Column, bool]]:
    """Every place of a table that holds strings: columns, struct fields, array elements, map keys and values."""
    return [leaf for f in df.schema for leaf in _leaves(f.dataType, f.name, F.array(F.col(f"`{f.name}`")))]


def _tagged(column: str, array: Column, field: str) -> Column:
    """Array elements as (column, field) structs."""
    return F.transform(array, lambda x: F.struct(F.lit(column).alias("column"), x.alias(field)))


def forbidden_fields(name: str, df: DataFrame, banned: Sequence[str] = FORBIDDEN) -> DataFrame:
    """Banned field names in the schema, in map keys and in keys of JSON texts (GATE-1); one row per field.

    A text that starts like JSON is read as JSON, so escaped keys count; when it
    does not parse, its raw keys are looked at.
    """
    hits = [(name, path) for path, field in field_names(df.schema) if field in banned]
    parts = [df.sparkSession.createDataFrame(hits, "table string, field string")]
    keyed = rf'"({"|".join(banned)})"\s*:'
    found = []
    for path, values, is_key in string_leaves(df):
        if is_key:
            keys = F.filter(values, lambda v: v.isin(*banned))
        else:
            texts = F.filter(values, lambda v: v.rlike(r"^\s*[\[{]"))
            bodies = F.transform(texts, lambda v: F.coalesce(F.to_json(F.try_parse_json(v)), v))
            keys = F.flatten(F.transform(bodies, lambda v: F.regexp_extract_all(v, F.lit(keyed), F.lit(1))))
        found.append(F.transform(F.array_distinct(keys), lambda v: F.concat(F.lit(path + "."), v)))
    if found:
        inside = df.select(F.explode(F.concat(*found)).alias("field")).distinct()
        parts.append(inside.select(F.lit(name).alias("table"), "field"))
    return union_all(parts)


def _audited(name: str) -> bool:
    field = name.rsplit(".", 1)[-1]
    return field not in LENGTH_EXEMPT and not field.endswith(EXEMPT_SUFFIXES)


def length_medians(df: DataFrame) -> DataFrame:
    """Exact median length per audited place of strings, arrays flattened and map keys left out.

    Lengths are counted per value first, so the median is taken over a table of
    (column, length, n) and not over the rows.
    """
    cols = [(c, values) for c, values, is_key in string_leaves(df) if _audited(c) and not is_key]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, median double")
    lengths = [_tagged(c, F.transform(values, F.length), "len") for c, values in cols]
    flat = df.select(F.explode(F.concat(*lengths)).alias("x")).select("x.*")
    counted = flat.filter("len IS NOT NULL").groupBy("column", "len").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("column").agg(F.percentile("len", F.lit(0.5), F.col("n")).alias("median"))


def long_text(name: str, df: DataFrame, most: float = MAX_MEDIAN) -> DataFrame:
    """String columns whose median length looks like free text (GATE-2)."""
    return length_medians(df).filter(F.col("median") > most).select(F.lit(name).alias("table"), "column", "median")


# Forms that need no vocabulary entry.
IDENT = r"^[a-z]{1,4}[0-9]{1,6}$"
STAMP = r"^\d{4}-\d{2}-\d{2}"
SHA = r"^[0-9a-f]{64}$"


def unapproved_strings(name: str, df: DataFrame, vocabulary: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Strings outside the approved set and the id, date and hash forms (GATE-3)."""
    cols = [(c, values) for c, values, _ in string_leaves(df) if c not in skip]
    if not cols:
        return df.sparkSession.createDataFrame([], "table string, column string, value string, n bigint")
    pairs = F.concat(*[_tagged(c, values, "value") for c, values in cols])
    found = df.select(F.explode(pairs).alias("x")).select("x.*").filter("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    formed = F.col("value").rlike(IDENT) | F.col("value").rlike(STAMP) | F.col("value").rlike(SHA)
    known = vocabulary.select(F.col("term").alias("value")).distinct()
    return found.filter(~formed).join(known, "value", "left_anti").select(F.lit(name).alias("table"), "column", "value", "n")


def thin_terms(terms: DataFrame, k_comments: int = 20, k_authors: int = 10) -> DataFrame:
    """Published terms under the anonymity floor (GATE-3)."""
    return terms.filter((F.coalesce("n_comments", F.lit(0)) < k_comments) | (F.coalesce("n_authors", F.lit(0)) < k_authors))


def pattern_findings(name: str, df: DataFrame, key: str, rules: dict[str, str] = PATTERNS) -> DataFrame:
    """Rows with secrets, URLs, e-mails or local paths; names rule, column and key only (GATE-4)."""
    parts = []
    for column, values, _ in string_leaves(df):
        hits = [F.when(F.exists(values, lambda v: v.rlike(rx)), F.lit(rule)) for rule, rx in rules.items()]
        parts.append(_tagged(column, F.array_compact(F.array(*hits)), "rule"))
    if not parts:
        return df.select(F.lit(name).alias("table"), F.col(key).alias("row_key"), F.lit("").alias("column"), F.lit("").alias("rule")).limit(0)
    found = df.select(F.col(key).alias("row_key"), F.explode(F.array_distinct(F.concat(*parts))).alias("x"))
    return found.select(F.lit(name).alias("table"), "row_key", "x.column", "x.rule")


# What every claim states, and the lanes a claim may belong to.
CLAIM_FIELDS = (
    "id", "text", "value", "tolerance", "sql", "run_id", "lane", "denominator", "question_set", "weighted",
    "ci_low", "ci_high", "qualifier",
)
LANES = ("breadth", "discovery")


def _number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def _bare_share(c: dict) -> bool:
    """An unweighted share of the breadth lane."""
    return c["lane"] == "breadth" and c["weighted"] is False and isinstance(c["value"], float) and 0 <= c["value"] <= 1


# Rules over a claim with all fields; each names what does not hold.
CLAIM_RULES = {
    "value_number": lambda c: _number(c["value"]),
    "tolerance_number": lambda c: _number(c["tolerance"]) and c["tolerance"] >= 0,
    "interval_or_count": lambda c: type(c["value"]) is int or None not in (c["ci_low"], c["ci_high"]),
    "lane_known": lambda c: c["lane"] in LANES,
    "weighted_flag": lambda c: isinstance(c["weighted"], bool),
    # Fixed value: the words that mark such a denominator.
    "denominator_named": lambda c: not _bare_share(c) or "unweighted count" in str(c["denominator"]).lower(),
}


def claim_faults(claims: Sequence[dict]) -> list[list[str]]:
    """Per claim the names of all rules it breaks (GATE-5); of equal ids the first one is good."""
    out: list[list[str]] = []
    known: set = set()
    for claim in claims:
        gaps = [f"no_{field}" for field in CLAIM_FIELDS if field not in claim]
        if gaps:
            out.append(gaps)
            continue
        broken = [rule for rule, holds in CLAIM_RULES.items() if not holds(claim)]
        out.append(broken + (["id_repeated"] if claim["id"] in known else []))
        known.add(claim["id"])
    return out


def scalar_of(spark: SparkSession, query: str) -> tuple[float | None, str | None]:
    """(value, None) of a query of one row and column, else (None, reason)."""
    try:
        found = spark.sql(query)
        rows = found.limit(2).collect() if len(found.columns) == 1 else []
        if len(rows) != 1:
            return None, "not_scalar"
        return (None, "null_result") if rows[0][0] is None else (float(rows[0][0]), None)
    except Exception as e:  # noqa: BLE001 - a failing query is a finding
        return None, type(e).__name__


def check_claims(spark: SparkSession, claims: Sequence[dict]) -> DataFrame:
    """Each claim's scalar SQL against its value and tolerance (GATE-5).

    Only the claimed scalar of each query reaches the driver.
    """
    rows = []
    for i, (claim, faults) in enumerate(zip(claims, claim_faults(claims))):
        actual, error = (None, ", ".join(faults)) if faults else scalar_of(spark, claim["sql"])
        stated = claim.get("value")
        ok = actual is not None and abs(actual - stated) <= claim["tolerance"]
        rows.append((str(claim.get("id") or f"#{i}"), ok, float(stated) if _number(stated) else None, actual, error))
    return spark.createDataFrame(rows, "id string, ok boolean, expected double, actual double, error string")


def text_drift(expected: DataFrame, fetched: DataFrame) -> DataFrame:
    """Per id: match, changed, missing or failed against the recorded hash (GATE-6)."""
    rows = expected.select("id", "text_sha256").join(fetched.select("id", "state", "text"), "id", "left")
    status = (
        F.when(F.col("state") == "failed", "failed").when(F.col("state").isNull() | (F.col("state") != "ok"), "missing")
        .when(F.sha2("text", 256) == F.col("text_sha256"), "match").otherwise("changed")
    )
    return rows.select("id", status.alias("status"))


def drift_summary(drift: DataFrame) -> DataFrame:
    """Counts by status and the share that no longer matches (GATE-6)."""
    return drift.agg(
        F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("status") == s, 1)).alias(f"n_{s}") for s in ("match", "changed", "missing", "failed")],
        F.avg((F.col("status") != "match").cast("double")).alias("no_longer_matching_share"),
    )


def gate_all(tables: dict[str, DataFrame], gates: Sequence) -> DataFrame:
    """Findings of several gates over several tables as (gate, table, detail)."""
    parts = []
    for gate in gates:
        for name, df in tables.items():
            found = gate(name, df)
            parts.append(found.select(F.lit(gate.__name__).alias("gate"), F.lit(name).alias("table"), F.to_json(F.struct(*found.columns)).alias("detail")))
    return union_all(parts)
