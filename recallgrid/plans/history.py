"""Queries on messages, bundles and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bundles as B
from ..sources import table
from .common import SQL_BUNDLED, SQL_BUNDLES, SQL_MESSAGES, SQL_POLICY, SQL_SEGMENTS, messages, segments, sql

#: A raw foreground of the test chats, whose messages hold some 90 tokens.
RAW_BUDGET = 1200


def message_policy(spark: SparkSession, d: str) -> DataFrame:
    return B.policy_filter(messages(spark, d, "role", "hidden", "n_tokens")).select("chat_id", "message_index", "role", "n_tokens")


def token_audit(spark: SparkSession, d: str) -> DataFrame:
    return B.token_audit(table(spark, d, "messages"))


def turn_bundles(spark: SparkSession, d: str) -> DataFrame:
    return B.turn_bundles(messages(spark, d, "role", "n_tokens"))


def bundle_hashes(spark: SparkSession, d: str) -> DataFrame:
    return B.bundle_hashes(messages(spark, d))


def bundle_integrity(spark: SparkSession, d: str) -> DataFrame:
    """The first arrived copies of the messages against the last."""
    first = table(spark, d, "messages").withColumn("ingested_at", F.timestamp_micros(-F.unix_micros(F.col("ingested_at").cast("timestamp"))).cast("timestamp_ntz")).withColumn("message_id", -F.col("message_id"))
    return B.bundle_integrity(B.bundle_hashes(B.latest_messages(first)), B.bundle_hashes(messages(spark, d)))


def raw_foreground(spark: SparkSession, d: str) -> DataFrame:
    return B.raw_foreground(B.policy_filter(messages(spark, d, "role", "hidden", "n_tokens")), RAW_BUDGET)


def foreground_summary(spark: SparkSession, d: str) -> DataFrame:
    return B.foreground_summary(raw_foreground(spark, d), RAW_BUDGET)


def compaction_frontier(spark: SparkSession, d: str) -> DataFrame:
    return B.compaction_frontier(B.policy_filter(messages(spark, d, "role", "hidden", "n_tokens")), foreground_summary(spark, d), RAW_BUDGET)


def segment_coverage(spark: SparkSession, d: str) -> DataFrame:
    return B.segment_coverage(segments(spark, d), messages(spark, d, "role"))


def uncovered_islands(spark: SparkSession, d: str) -> DataFrame:
    return B.uncovered_islands(messages(spark, d, "n_tokens"), segments(spark, d).where("status = 'valid'"))


def timeline_page(spark: SparkSession, d: str) -> DataFrame:
    return B.timeline_page(segments(spark, d), 2)


_FOREGROUND = f"""
forced as (select chat_id, coalesce(max(message_index) filter (role = 'user'), max(message_index)) as f from pm group by all),
fg as (select chat_id, message_index, n_tokens, message_index >= f as required
       from (select *, sum(n_tokens) over (partition by chat_id order by message_index desc) as s from pm) join forced using (chat_id)
       where message_index >= f or s <= {RAW_BUDGET})"""
_SUMMARY = f"""
fs as (select *, greatest(0, total_tokens - {RAW_BUDGET})::bigint as overflow_tokens,
         case when total_tokens > {RAW_BUDGET} then 'required_current_turn_exceeds_budget' else 'within_budget' end as reason
       from (select chat_id, min(message_index) as first_index, max(message_index) as last_index, count(*) as n_messages, sum(n_tokens)::bigint as total_tokens from fg group by all))"""
_STORY = r"regexp_replace(regexp_replace(regexp_replace({0}, '\r\n?', chr(10), 'g'), '(?m)[ \t]+$', '', 'g'), '^\s+|\s+$', '', 'g')"


def _hashes(source: str, out: str) -> str:
    bundled = SQL_BUNDLED.replace("from lm", f"from {source}").replace("b0", f"{out}_b0").replace("bundled", f"{out}_b")
    return bundled + f""",
{out}_d as (select chat_id, bundle_no, message_index, md5(concat_ws(chr(31), message_index::varchar, role, name, text, hidden::varchar, swipe_id::varchar)) as e,
  md5(message_index::varchar || chr(31) || role || chr(31) || {_STORY.format('name')} || chr(31) || {_STORY.format('text')}) as n from {out}_b),
{out} as (select chat_id, bundle_no, min(message_index) as first_index, max(message_index) as last_index,
  md5(sum(('0x' || left(e, 13))::hugeint)::varchar || '-' || sum(('0x' || substr(e, 14, 13))::hugeint)::varchar) as exact_hash,
  md5(sum(('0x' || left(n, 13))::hugeint)::varchar || '-' || sum(('0x' || substr(n, 14, 13))::hugeint)::varchar) as narrative_hash
  from {out}_d group by all)"""


_COVERED = "cov as (select chat_id, unnest(range(first_index, last_index + 1))::int as message_index from {0})"

QUERIES = {f.__name__: f for f in (message_policy, token_audit, turn_bundles, bundle_hashes, bundle_integrity, raw_foreground, foreground_summary, compaction_frontier, segment_coverage, uncovered_islands, timeline_page)}

SQL = {
    "message_policy": sql(SQL_MESSAGES, SQL_POLICY, select="select chat_id, message_index, role, n_tokens from pm"),
    "token_audit": """select message_id, token_count::bigint as stored, coalesce(ceil(length(text) / 4), 0)::bigint as counted,
        case when token_count is null then 'missing' when token_count = coalesce(ceil(length(text) / 4), 0) then 'cached' else 'stale' end as status from messages""",
    "turn_bundles": sql(SQL_MESSAGES, SQL_BUNDLED, SQL_BUNDLES, select="select * from bundles"),
    "bundle_hashes": sql(SQL_MESSAGES, _hashes("lm", "h"), select="select * from h"),
    "bundle_integrity": sql(
        SQL_MESSAGES, SQL_MESSAGES.replace("lm as", "fm as").replace("ingested_at desc nulls last, message_id desc", "ingested_at asc nulls last, message_id asc"), _hashes("fm", "e"), _hashes("lm", "a"),
        select="""select *, exact_changed > 0 and narrative_changed = 0 as cosmetic_only from (
          select chat_id, sum((e.first_index is distinct from a.first_index or e.last_index is distinct from a.last_index or e.exact_hash is distinct from a.exact_hash)::int)::bigint as exact_changed,
            sum((e.first_index is distinct from a.first_index or e.last_index is distinct from a.last_index or e.narrative_hash is distinct from a.narrative_hash)::int)::bigint as narrative_changed
          from e full join a using (chat_id, bundle_no) group by all)""",
    ),
    "raw_foreground": sql(SQL_MESSAGES, SQL_POLICY, _FOREGROUND, select="select * from fg"),
    "foreground_summary": sql(SQL_MESSAGES, SQL_POLICY, _FOREGROUND, _SUMMARY, select="select * from fs"),
    "compaction_frontier": sql(
        SQL_MESSAGES, SQL_POLICY, _FOREGROUND, _SUMMARY,
        select=f"""select *, eligible_messages > 0 and utilization >= 0.85 as should_schedule from (
          select chat_id, coalesce(max(first_index) - 1, max(message_index))::int as eligible_through, count(*) filter (first_index is null or message_index < first_index) as eligible_messages,
            coalesce(sum(n_tokens) filter (first_index is null or message_index < first_index), 0)::bigint as eligible_tokens, coalesce(max(total_tokens), 0)::double / {RAW_BUDGET} as utilization
          from pm left join (select chat_id, first_index, total_tokens from fs) using (chat_id) group by all)""",
    ),
    "segment_coverage": sql(
        SQL_MESSAGES, SQL_SEGMENTS, _COVERED.format("sg"),
        select="""select *, n_duplicate = 0 and n_missing = 0 and n_unexpected = 0 as ok from (
          select chat_id, count(*) filter (times > 1) as n_duplicate, count(*) filter (times is null) as n_missing, count(*) filter (there is null) as n_unexpected
          from (select chat_id, message_index, count(*) as times from cov group by all) full join (select chat_id, message_index, 1 as there from lm) using (chat_id, message_index) group by all)""",
    ),
    "uncovered_islands": sql(
        SQL_MESSAGES, SQL_SEGMENTS, _COVERED.format("sg where status = 'valid'"),
        select="""select chat_id, min(message_index) as first_index, max(message_index) as last_index, count(*) as n_messages, sum(n_tokens)::bigint as n_tokens from (
          select *, row_number() over (partition by chat_id order by message_index) - row_number() over (partition by chat_id, c order by message_index) as island
          from (select lm.*, exists (select 1 from cov where cov.chat_id = lm.chat_id and cov.message_index = lm.message_index) as c from lm))
          where not c group by chat_id, island""",
    ),
    "timeline_page": sql(
        SQL_SEGMENTS,
        select="""select chat_id, page, pages, segment_id, first_index from (
          select *, greatest(1, least(2, pages))::int as page from (
            select chat_id, segment_id, first_index, row_number() over (partition by chat_id order by first_index, segment_id) as n, ceil(count(*) over (partition by chat_id) / 10)::int as pages from sg))
          where ceil(n / 10) = page""",
    ),
}
