"""Table contracts as Spark schemas, and the cast that makes a frame meet one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string


COMMENTS = (
    "id bigint, time bigint, created_at timestamp, month string, period string, parent_id bigint, "
    "story_id bigint, depth smallint, text_norm string, sentences array<string>, text_sha256 string, "
    "author string, thread_type string, state string, in_window boolean, lang string, word_count int, "
    "eligible boolean, exclusion_reason string"
)
STORIES = (
    "id bigint, time bigint, created_at timestamp, type string, title string, url string, text_norm string, "
    "score int, descendants int, thread_type string, state string, in_window boolean, fetched_at string"
)
CONTEXT = "id bigint, time bigint, type string, parent_id bigint, text_norm string, state string, fetched_at string"
COVERAGE = "dimension string, key string, count bigint"
SAMPLE = (
    "sample_id string, comment_id bigint, story_id bigint, stratum string, inclusion_prob double, "
    "weight double, batch int, draw_order bigint"
)
ANSWERS = (
    "run_id string, comment_id bigint, question_set string, question_id string, qtype string, noul double, "
    "choice string, score double, probabilities_json string, confidence double, model_returned string, "
    "request_id string, logical_call_id string, cache_hit boolean"
)
LABELS = (
    "label_id string, comment_id bigint, label_set string, question_id string, value string, "
    "rubric_version string, reviewer string, started_at string, ended_at string, seconds double"
)
LEDGER = (
    "run_id string, logical_call_id string, attempt int, comment_id bigint, question_set string, "
    "question_count int, input_hash string, model_requested string, model_returned string, request_id string, "
    "started_at string, ended_at string, queue_ms double, request_ms double, backoff_ms double, "
    "http_status int, error_type string, validation string, input_tokens bigint, output_tokens bigint, "
    "cache string, price_version string, cost_usd double, cost_class string"
)
CARDS = (
    "card_id string, group_id string, group_label string, statement string, taxonomy_version string, "
    "status string, author string, created_at string"
)
ASSIGNMENTS = (
    "run_id string, comment_id bigint, taxonomy_version string, group_id string, group_p double, "
    "group_confidence double, card_id string, card_p double, card_confidence double, verified_p double"
)
GOLD_DRAWS = (
    "label_set string, comment_id bigint, draw_stratum string, selection_prob double, seed bigint, purpose string"
)
SCREEN = (
    "comment_id bigint, story_id bigint, stratum string, weight double, half string, firsthand_p double, "
    "packed_id bigint, slot string, model_returned string, request_id string"
)
PHASE2 = (
    "comment_id bigint, story_id bigint, stratum string, half string, phase string, w1 double, p2 double, "
    "weight double, firsthand_p double"
)
UNSOLVED = (
    "comment_id bigint, n_replies bigint, any_solution_named boolean, solution_kinds array<string>, "
    "author_says_solved string, unsolved boolean, solved_p double"
)
MENTIONS = (
    "hit_id bigint, comment_id bigint, problem_id bigint, card_id string, story_id bigint, kind string, "
    "tool string, time bigint"
)
ESTIMATE = "struct<est:double,lo50:double,hi50:double,lo95:double,hi95:double,n:bigint,sparse:boolean>"
RAW_ITEM = (
    "id bigint, state string, http_status int, attempts int, backoff_s double, started_at string, "
    "ended_at string, elapsed_ms double, sha256 string, item struct<id:bigint,type:string,parent:bigint,"
    "time:bigint,by:string,text:string,title:string,url:string,score:int,descendants:int,dead:boolean,"
    "deleted:boolean>, errors array<string>"
)

EXCLUSION_ORDER = ("not_comment", "out_of_window", "deleted", "dead", "empty_text", "non_english")
COST_CLASSES = ("calculated", "unknown", "replay", "pending", "none")


def fields(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Select and cast to a contract; a missing column is an error (SNK-6)."""
    wanted = fields(ddl)
    missing = [f.name for f in wanted if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])
