"""Views over the test tables that several queries start from, and the SQL for the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bundles
from ..sources import table


def messages(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return bundles.latest_messages(table(spark, d, "messages"), *columns)


def segments(spark: SparkSession, d: str) -> DataFrame:
    """The current row of every segment: the last updated, then the last arrived."""
    t = table(spark, d, "segments").where("segment_id is not null")
    order = Window.partitionBy("segment_id").orderBy(F.col("updated_at").desc_nulls_last(), F.col("segment_row_id").desc())
    return t.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


#: The same in SQL: common table expressions to put before a query.
SQL_MESSAGES = """
lm as (select chat_id, message_index, message_id, coalesce(role, 'assistant') as role, coalesce(name, '') as name, coalesce(text, '') as text,
         coalesce(hidden, false) or coalesce(role = 'system', false) as hidden, coalesce(swipe_id, 0) as swipe_id, boundary_hint, send_date,
         coalesce(ceil(length(text) / 4), 0)::bigint as n_tokens
       from messages where chat_id is not null and message_index is not null
       qualify row_number() over (partition by chat_id, message_index order by ingested_at desc nulls last, message_id desc) = 1)"""
SQL_POLICY = "pm as (select * from lm where not hidden and role in ('user', 'assistant'))"
SQL_BUNDLED = """
b0 as (select *, max(case when role = 'user' then message_index end) over w as lu, max(case when role = 'assistant' then message_index end) over w as la
       from lm window w as (partition by chat_id order by message_index rows between unbounded preceding and 1 preceding)),
bundled as (select *, sum(case when role = 'user' and coalesce(la > lu, false) then 1 else 0 end) over (partition by chat_id order by message_index)::bigint as bundle_no from b0)"""
SQL_BUNDLES = """
bundles as (select *, kind <> 'incomplete_user' as complete from (
  select chat_id, bundle_no, min(message_index) as first_index, max(message_index) as last_index, count(*) as n_messages, sum(n_tokens)::bigint as n_tokens,
    case when min(message_index) filter (role = 'user') is null then 'opening'
         when max(message_index) filter (role = 'assistant') > min(message_index) filter (role = 'user') then 'exchange' else 'incomplete_user' end as kind
  from bundled group by all))"""
SQL_SEGMENTS = """
sg as (select * from segments where segment_id is not null
       qualify row_number() over (partition by segment_id order by updated_at desc nulls last, segment_row_id desc) = 1)"""


def sql(*parts: str, select: str) -> str:
    return "with recursive " + ",\n".join(parts) + "\n" + select
