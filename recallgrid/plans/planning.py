"""Queries on segment plans and their cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bundles as B
from ..operators import planning as P
from ..sources import table
from .common import SQL_BUNDLED, SQL_BUNDLES, SQL_MESSAGES, messages, segments, sql
from .history import SQL as HISTORY_SQL
from .history import uncovered_islands

#: Segment budgets at a tenth of the defaults, as the test messages are short.
TARGET, SOFT, HARD = 500, 700, 900


def _bundle_units(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d, "role", "n_tokens", "boundary_hint")
    return P.bundle_units(B.turn_bundles(m), m)


def segment_plan_messages(spark: SparkSession, d: str) -> DataFrame:
    return P.plan_segments(P.message_units(messages(spark, d, "role", "n_tokens", "boundary_hint")), TARGET, SOFT, HARD)


def segment_plan_turns(spark: SparkSession, d: str) -> DataFrame:
    return P.plan_segments(_bundle_units(spark, d), TARGET, SOFT, HARD, atomic_turns=True)


def uncovered_plan(spark: SparkSession, d: str) -> DataFrame:
    """The plan of turns for what no valid segment covers: every island planned by itself."""
    m = B.uncovered_messages(messages(spark, d, "role", "n_tokens", "boundary_hint"), segments(spark, d).where("status = 'valid' and chat_id is not null"))
    m = m.withColumn("chat_id", F.concat_ws("#", F.col("island").cast("string"), "chat_id")).drop("island")
    plan = P.plan_segments(P.bundle_units(B.turn_bundles(m), m), TARGET, SOFT, HARD, atomic_turns=True)
    return plan.withColumn("chat_id", F.regexp_replace("chat_id", "^[0-9]+#", ""))


def adaptive_candidates(spark: SparkSession, d: str) -> DataFrame:
    return P.adaptive_candidates(_bundle_units(spark, d), HARD, input_budget=1000)


def adaptive_plans(spark: SparkSession, d: str) -> DataFrame:
    return P.adaptive_plans(adaptive_candidates(spark, d))


def economic_totals(spark: SparkSession, d: str) -> DataFrame:
    """The cost of the cheapest plan of every chat, out of the four plans."""
    return adaptive_plans(spark, d).where("objective = 'economic'").select("chat_id", F.round("total_tokens", 4).alias("total_tokens"))


def request_budgets(spark: SparkSession, d: str) -> DataFrame:
    return P.request_budgets(uncovered_islands(spark, d), total=4000, essential=120, input_budget=800)


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """The events table as recorded extraction attempts."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, d, "events").select(
        F.col("user_id").alias("session"), F.col("event_id").alias("attempt_id"), F.col("ts"), F.to_date("ts").alias("day"), F.floor(F.col("value") * 100).cast("bigint").alias("source_tokens"), k.alias("output_tokens"),
        F.when(k % 3 == 0, None).otherwise(k * 2).alias("cached_tokens"), F.when(k % 4 != 0, k * 10).alias("duration_ms"), F.when(F.col("event_type") == "error", "replay").otherwise("live").alias("mode"),
        F.when(k % 11 == 0, "format").when(k % 13 == 0, "provider_timeout").alias("failure"),
    )


def calibration(spark: SparkSession, d: str) -> DataFrame:
    out = P.calibration(attempts(spark, d))
    return out.select("session", "n", "n_format_failures", F.round("retry_probability", 9).alias("retry_probability"), F.round("output_ratio", 9).alias("output_ratio"), "median_latency_ms", "confidence")


def usage_projection(spark: SparkSession, d: str) -> DataFrame:
    return P.usage_projection(uncovered_islands(spark, d))


def backfill_report(spark: SparkSession, d: str) -> DataFrame:
    """Per chat: segments by status, uncovered runs and what extracting them would take."""
    s = segments(spark, d)
    by = [F.sum((F.col("status") == x).cast("bigint")).alias(f"n_{x}") for x in ("valid", "stale", "pending", "failed", "excluded")]
    return s.groupBy("chat_id").agg(F.count("*").alias("n_segments"), *by, F.sum(F.coalesce(F.col("pinned"), F.lit(False)).cast("bigint")).alias("n_pinned")).join(usage_projection(spark, d), "chat_id", "left")


SQL_ATTEMPTS = """
ev as (select *, (props ->> '$.k')::bigint as k from events),
attempts as (select user_id as session, event_id as attempt_id, ts, ts::date as day, floor(value * 100)::bigint as source_tokens, k as output_tokens,
  case when k % 3 = 0 then null else k * 2 end as cached_tokens, case when k % 4 <> 0 then k * 10 end as duration_ms,
  case when event_type = 'error' then 'replay' else 'live' end as mode, case when k % 11 = 0 then 'format' when k % 13 = 0 then 'provider_timeout' end as failure from ev)"""
_WEIGHT = """case when boundary_hint like '[%' then (case when boundary_hint like '%"chapter"%' then 4 when boundary_hint like '%"scene"%' then 3 when boundary_hint like '%"time"%' then 2 when boundary_hint like '%"location"%' then 1 else 0 end)
  else (case boundary_hint when 'chapter' then 4 when 'scene' then 3 when 'time' then 2 when 'location' then 1 else 0 end) end"""
_MESSAGE_UNITS = f"""
units as (select chat_id, row_number() over w - 1 as pos, message_index as first_index, message_index as last_index, n_tokens, {_WEIGHT} as nat,
  (role = 'assistant' and coalesce(lead(role) over w = 'user', true))::int as pair from lm window w as (partition by chat_id order by message_index))"""
_BUNDLE_UNITS = f"""
units as (select b.chat_id, bundle_no as pos, first_index, last_index, b.n_tokens, {_WEIGHT} as nat, 1 as pair
  from bundles b join lm on lm.chat_id = b.chat_id and lm.message_index = b.last_index)"""
_CHOICES = f"""
u as (select *, coalesce(sum(n_tokens) over (partition by chat_id order by pos rows between unbounded preceding and 1 preceding), 0) as before, max(pos) over (partition by chat_id) as final_pos from units),
cand as (select s.chat_id, s.pos, e.pos as end_pos, s.first_index, e.last_index, (e.before + e.n_tokens - s.before)::bigint as n_tokens, e.nat, e.pair, e.pos = e.final_pos as is_final
  from u s join u e on e.chat_id = s.chat_id and e.pos >= s.pos and e.before + e.n_tokens - s.before <= {HARD}),
pick as (select *, false as oversized from cand
  qualify row_number() over (partition by chat_id, pos order by (is_final or n_tokens >= {int(TARGET * 0.7)})::int desc,
    nat * 10 + pair * 3 + (case when is_final then 2 else 0 end) - (case when n_tokens > {SOFT} then 100 else 0 end) - abs(n_tokens - {TARGET}) / {float(TARGET)}::double desc, end_pos) = 1
  union all select chat_id, pos, pos, first_index, last_index, n_tokens, nat, pair, false, true from u where n_tokens > {HARD}),
walk as (select * from pick where pos = 0 union all select p.* from walk w join pick p on p.chat_id = w.chat_id and p.pos = w.end_pos + 1)"""
_ISLANDS = HISTORY_SQL["uncovered_islands"]
_RUNS = """
runs as (select chat_id, s.pos as unit_start, e.pos as unit_end, s.first_index, e.last_index, (e.before + e.n_tokens - s.before)::bigint as source_tokens, s.n_tokens as first_tokens, e.nat as boundary
  from u s join u e using (chat_id) where e.pos between s.pos and s.pos + 4)"""

QUERIES = {f.__name__: f for f in (segment_plan_messages, segment_plan_turns, adaptive_candidates, adaptive_plans, economic_totals, request_budgets, calibration, usage_projection, backfill_report)}

_PROJECTION = f"""(select *, (min_tokens + floor(0.75 * (max_tokens - min_tokens) + 0.5))::bigint as likely_tokens from (select *, min_tokens * 3 as max_tokens from (
  select chat_id, count(*) as n_requests, sum(n_tokens + greatest(600, floor(n_tokens * 0.45::double + 0.5)))::bigint as min_tokens from ({_ISLANDS}) group by all)))"""

SQL = {
    "segment_plan_messages": sql(SQL_MESSAGES, _MESSAGE_UNITS, _CHOICES, select=f"""select chat_id, first_index, last_index, n_tokens,
        case when oversized then 'oversized_message' when is_final then 'history_end' when nat > 0 then 'natural_boundary' when pair = 1 then 'pair_boundary' when n_tokens > {SOFT} then 'hard_limit' else 'target_proximity' end as reason, oversized from walk"""),
    "segment_plan_turns": sql(SQL_MESSAGES, SQL_BUNDLED, SQL_BUNDLES, _BUNDLE_UNITS, _CHOICES, select=f"""select chat_id, first_index, last_index, n_tokens,
        case when oversized then 'oversized_turn' when is_final then 'history_end' when nat > 0 then 'natural_boundary' when n_tokens > {SOFT} then 'hard_limit' else 'turn_batch' end as reason, oversized from walk"""),
    "adaptive_candidates": sql(SQL_MESSAGES, SQL_BUNDLED, SQL_BUNDLES, _BUNDLE_UNITS, _CHOICES.split("cand as")[0].rstrip().rstrip(","), _RUNS, select=f"""
        select chat_id, unit_start, unit_end, first_index, last_index, source_tokens, source_tokens as input_tokens, greatest(600, floor(source_tokens * 0.45::double + 0.5))::bigint as output_tokens, 1.24::double as attempts,
          (source_tokens + greatest(600, floor(source_tokens * 0.45::double + 0.5))::bigint) * 1.24::double as total_tokens, 6200.0::double as wall_ms, oversized or source_tokens <= 800 as safe, oversized, boundary
        from (select *, first_tokens > {HARD} or (unit_start = unit_end and source_tokens > 800) as oversized from runs where unit_start = unit_end or source_tokens <= {HARD})"""),
    "request_budgets": f"""select chat_id, first_index, least(800, greatest(own, 4000 - before - behind))::bigint as budget from (
        select chat_id, first_index, least(n_tokens, 120) as own, coalesce(sum(least(n_tokens, 120)) over (partition by chat_id order by first_index rows between 1 following and unbounded following), 0) as behind,
          coalesce(sum(n_tokens) over (partition by chat_id order by first_index rows between unbounded preceding and 1 preceding), 0) as before from ({_ISLANDS}))""",
    "calibration": sql(SQL_ATTEMPTS, select="""select session, n, f as n_format_failures, round(least(greatest((f + 1) / (n + 5), 0.05::double), 0.75::double), 9) as retry_probability,
        round(least(greatest(coalesce(r, 0.45::double), 0.05::double), 1.0::double), 9) as output_ratio, l as median_latency_ms, case when n >= 5 and t >= 3 then 'high' when n >= 5 then 'medium' else 'low' end as confidence
        from (select session, count(*) as n, count(*) filter (failure = 'format') as f, median(case when source_tokens > 0 then output_tokens::double / source_tokens end) as r, median(duration_ms)::double as l, count(duration_ms) as t
          from attempts where mode = 'live' and (failure is null or failure not like 'provider%') group by all)"""),
    "usage_projection": f"select * from {_PROJECTION}",
    "backfill_report": sql(
        "sg as (select * from segments where segment_id is not null qualify row_number() over (partition by segment_id order by updated_at desc nulls last, segment_row_id desc) = 1)",
        select=f"""select * from (select chat_id, count(*) as n_segments, count(*) filter (status = 'valid') as n_valid, count(*) filter (status = 'stale') as n_stale, count(*) filter (status = 'pending') as n_pending,
          count(*) filter (status = 'failed') as n_failed, count(*) filter (status = 'excluded') as n_excluded, count(*) filter (pinned) as n_pinned from sg group by all) left join {_PROJECTION} using (chat_id)""",
    ),
}

#: The cheapest way to every place of a chat, place by place, from those to the five places before.
SQL["economic_totals"] = sql(
    SQL_MESSAGES, SQL_BUNDLED, SQL_BUNDLES, _BUNDLE_UNITS, _CHOICES.split("cand as")[0].rstrip().rstrip(","), _RUNS,
    "safe as (select * from (select *, unit_end - unit_start as len, (source_tokens + greatest(600, floor(source_tokens * 0.45::double + 0.5))) * 1.24::double as cost, first_tokens > %d or (unit_start = unit_end and source_tokens > 800) as oversized "
    "from runs where unit_start = unit_end or source_tokens <= %d) where oversized or source_tokens <= 800)" % (HARD, HARD),
    "ends as (select chat_id, unit_end, max(cost) filter (len = 0) as c0, max(cost) filter (len = 1) as c1, max(cost) filter (len = 2) as c2, max(cost) filter (len = 3) as c3, max(cost) filter (len = 4) as c4 from safe group by all)",
    "way as (select distinct chat_id, 0::bigint as pos, 0::double as b0, null::double as b1, null::double as b2, null::double as b3, null::double as b4 from u "
    "union all select w.chat_id, w.pos + 1, least(w.b0 + c0, w.b1 + c1, w.b2 + c2, w.b3 + c3, w.b4 + c4), w.b0, w.b1, w.b2, w.b3 from way w join u on u.chat_id = w.chat_id and u.pos = w.pos left join ends e on e.chat_id = w.chat_id and e.unit_end = w.pos)",
    select="select chat_id, round(b0, 4) as total_tokens from way join (select chat_id, max(pos) + 1 as n from u group by all) using (chat_id) where pos = n and b0 is not null",
)
