"""Queries on context packing, invalidation, promotion, accounting and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import accounting as A
from ..operators import bundles as B
from ..operators import context as C
from ..operators import maintenance as M
from ..sources import table
from .common import SQL_MESSAGES, SQL_POLICY, SQL_SEGMENTS, messages, segments, sql
from .history import _FOREGROUND, RAW_BUDGET, foreground_summary, raw_foreground
from .planning import SQL as PLAN_SQL
from .planning import SQL_ATTEMPTS, attempts, segment_plan_turns
from .state import SQL as STATE_SQL
from .state import state_projection

BUDGETS, HARD = {"state": 400, "chronological": 500, "associative": 200}, 2600


def context_budgets(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey").cast("bigint")
    config = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), (k * 700).alias("hard"), (8000 - k * 100).alias("raw"), (k * 30).alias("state"), (k * 10).alias("registers"), (k * 100).alias("chronological"), (k * 60).alias("associative"))
    return C.allocate_budgets(config).select("id", "hard", "raw_budget")


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Characters of each chat's raw part, a message a line, with who says it."""
    kept = raw_foreground(spark, d).select("chat_id", "message_index")
    m = messages(spark, d, "role", "name", "text").join(kept, ["chat_id", "message_index"], "left_semi")
    line = F.length("role") + F.length("name") + F.length("text") + 6
    return m.groupBy("chat_id").agg(F.sum(line).alias("raw_chars"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).where("status = 'valid' and chat_id is not null")
    first = foreground_summary(spark, d).select("chat_id", F.col("first_index").alias("raw_first"))
    score = s.where("segment_row_id % 7 = 0").select("segment_id", (F.col("segment_row_id") % 13).cast("double").alias("score"))
    return C.region_candidates(s, score, first)


def context_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("chat_id", "region", "item", "first_index", "last_index", "priority")


def _items(spark: SparkSession, d: str) -> DataFrame:
    """All state items and all of each memory region of a chat, in packing order."""
    state = state_projection(spark, d).select("chat_id", F.lit("state").alias("region"), F.concat_ws(":", "kind", "key").alias("item"), F.length("text").alias("n_chars"), F.col("place"))
    order = Window.partitionBy("chat_id", "region").orderBy(F.col("priority").desc(), F.col("last_index").desc(), "item")
    memory = _candidates(spark, d).withColumn("n", F.row_number().over(order))
    base = F.when(F.col("region") == "chronological", 10**9).otherwise(2 * 10**9).cast("bigint")
    return state.unionByName(memory.select("chat_id", "region", "item", F.length("text").alias("n_chars"), (F.col("n") + base).alias("place")))


def context_pack(spark: SparkSession, d: str) -> DataFrame:
    return C.pack(_items(spark, d), _raw(spark, d), BUDGETS, HARD)


def context_accounting(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    return C.context_accounting(C.pack(items, _raw(spark, d), BUDGETS, HARD), items, _raw(spark, d), HARD)


def omitted_indices(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).withColumn("eligible", F.lit(None).cast("boolean"))
    return C.omitted_indices(s, raw_foreground(spark, d))


def virtualized(spark: SparkSession, d: str) -> DataFrame:
    first = foreground_summary(spark, d).select("chat_id", F.col("first_index").alias("raw_first"))
    return C.virtualize(messages(spark, d, "role"), omitted_indices(spark, d), first)


def external_budget(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("source in ('lorebook', 'author_note', 'character_card') and chat_id is not null")
    return C.external_budget(t.select("chat_id", "text", (F.col("lang") == "xx").alias("excluded")), 4096)


def prompt_audit(spark: SparkSession, d: str) -> DataFrame:
    """The longest message of each chat's raw part looked up in that part, which a budget bounds."""
    kept = raw_foreground(spark, d).select("chat_id", "message_index")
    m = messages(spark, d, "text").join(kept, ["chat_id", "message_index"], "left_semi")
    prompts = m.groupBy("chat_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("message_index", "text"))), lambda x: x["text"]), "\n").alias("prompt"))
    blocks = m.groupBy("chat_id").agg(F.max(F.struct(F.length("text"), "text")).alias("m")).select("chat_id", F.col("m.text").alias("block"))
    return C.prompt_audit(prompts, blocks)


def extraction_history(spark: SparkSession, d: str) -> DataFrame:
    """Each chat's valid segments packed, newest first, into a history budget for extracting what follows."""
    s = segments(spark, d).where("status = 'valid' and chat_id is not null")
    order = Window.partitionBy("chat_id").orderBy(F.col("last_index").desc(), F.col("first_index").desc(), "segment_id")
    items = s.withColumn("place", F.row_number().over(order))
    return C.pack_recent(items.select("chat_id", F.col("segment_id").alias("item"), "place", F.ceil(F.length(F.coalesce("synopsis", F.lit(""))) / 4).alias("n_tokens")), 300)


def _edits(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d, "role").groupBy("chat_id").agg(F.floor(F.max("message_index") * 2 / 3).cast("int").alias("edit_index"))


def invalidated(spark: SparkSession, d: str) -> DataFrame:
    return M.invalidate(segments(spark, d).where("chat_id is not null"), _edits(spark, d))


def shifted_ranges(spark: SparkSession, d: str) -> DataFrame:
    return M.shift_ranges(segments(spark, d), _edits(spark, d))


def branch_select(spark: SparkSession, d: str) -> DataFrame:
    fp = F.md5(F.concat_ws("|", F.col("swipe_id").cast("string"), F.coalesce("text", F.lit(""))))
    raw = table(spark, d, "messages").select("chat_id", "message_index", "message_id", fp.alias("fingerprint"))
    latest = messages(spark, d, "role").select("message_id")
    return M.select_branch(raw.join(latest, "message_id", "left_semi"), raw.join(latest, "message_id", "left_anti"))


def job_guard(spark: SparkSession, d: str) -> DataFrame:
    fp = F.md5(F.concat_ws("|", "chat_id", F.col("first_index").cast("string"), F.col("last_index").cast("string"), F.coalesce(F.col("source_token_count").cast("string"), F.lit(""))))
    jobs = table(spark, d, "segments").where("segment_id is not null").select(F.col("segment_id").alias("job_id"), F.col("segment_row_id").alias("begun"), "chat_id", fp.alias("source_fp"))
    return M.committable(jobs, segments(spark, d).select("chat_id", F.col("segment_id").alias("job_id"), fp.alias("source_fp"))).select("job_id", "begun", "can_commit")


def session_archive(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).where("chat_id is not null")
    order = Window.partitionBy("chat_id").orderBy("first_index", "segment_id")
    return M.archive_session(s.select("chat_id", "segment_id", "status", F.row_number().over(order).alias("place")))


def promoted(spark: SparkSession, d: str) -> DataFrame:
    current = segments(spark, d).where("chat_id is not null").select("chat_id", "segment_id", "first_index", "last_index", F.col("manually_edited").alias("manual"), "status")
    return M.promote(current, segment_plan_turns(spark, d).select("chat_id", "first_index", "last_index"))


def reusable_segments(spark: SparkSession, d: str) -> DataFrame:
    """Over all arrived rows of valid segments of the current prompt version, each row a segment of its own."""
    t = table(spark, d, "segments").where("status = 'valid' and prompt_version = 3 and chat_id is not null")
    return M.reusable_segments(t.select("chat_id", F.col("segment_row_id").alias("segment_id"), "first_index", "last_index", F.col("manually_edited").alias("manual"), "updated_at"))


def rebuild_merge(spark: SparkSession, d: str) -> DataFrame:
    old = segments(spark, d).where("chat_id is not null").select("chat_id", "first_index", "last_index", "synopsis", F.col("manually_edited").alias("manual"))
    new = old.where("not manual or first_index % 2 = 0").select("chat_id", "first_index", "last_index", F.upper("synopsis").alias("synopsis"))
    return M.rebuild_merge(old, new)


def replay_cursor(spark: SparkSession, d: str) -> DataFrame:
    a = attempts(spark, d)
    return M.replay_cursor(a, a.where("output_tokens > 90").groupBy("session").agg(F.count("*").alias("n_consumed")))


def session_summary(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).where("chat_id is not null")
    return M.session_summary(s.select("chat_id", "segment_id", "status", F.col("source_token_count").alias("n_tokens")))


def _usage(spark: SparkSession, d: str) -> DataFrame:
    a = attempts(spark, d)
    j = F.when(F.col("attempt_id") % 3 == 0, F.to_json(F.struct(F.col("source_tokens").alias("prompt_tokens"), F.struct("cached_tokens").alias("prompt_tokens_details"), F.col("output_tokens").alias("completion_tokens"))))
    j = j.when(F.col("attempt_id") % 3 == 1, F.to_json(F.struct(F.col("source_tokens").alias("input_tokens"), F.col("cached_tokens").alias("cached_input_tokens"), F.col("output_tokens").alias("output_tokens"))))
    return A.normalize_usage(a.withColumn("usage", j))


def usage_normalized(spark: SparkSession, d: str) -> DataFrame:
    return _usage(spark, d).select("attempt_id", "nominal", "cached", "uncached", "output")


def attempt_costs(spark: SparkSession, d: str) -> DataFrame:
    out = A.attempt_costs(_usage(spark, d), ["session"])
    return out.withColumn("credits", F.round("credits", 4)).withColumn("replayed_credits", F.round("replayed_credits", 4))


def daily_spend(spark: SparkSession, d: str) -> DataFrame:
    return A.daily_spend(_usage(spark, d)).withColumn("day", F.col("day").cast("string"))


def token_guard(spark: SparkSession, d: str) -> DataFrame:
    """Users are spread over 40 installations, each with a ledger of its own, which is out of order for attempts that failed on format."""
    a = attempts(spark, d).where("mode = 'live'").withColumn("ledger", F.col("session") % 40).withColumn("healthy", F.coalesce(F.col("failure") != "format", F.lit(True)))
    return A.token_guard(a.withColumn("projected", F.col("source_tokens") + 100).withColumn("actual", F.col("source_tokens") + F.col("output_tokens")), 200_000, 30_000)


def percentiles(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("cents", F.floor(F.col("value") * 100).cast("bigint"))
    return A.nearest_rank(e, ["event_type"], "cents", {"p50": 0.5, "p95": 0.95}).withColumn("average", F.round("average", 6))


def profile_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Customers as chats, nations as characters and regions as defaults, each setting some keys."""
    c = table(spark, d, "customer").select(F.concat(F.lit("chat"), F.col("c_custkey").cast("string")).alias("chat_id"), F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    rows = F.array(
        F.struct(F.lit("base").alias("layer"), F.lit("temperature").alias("key"), F.lit("0.7").alias("value")),
        F.struct(F.lit("character").alias("layer"), F.lit("temperature").alias("key"), (F.col("n") / 10).cast("string").alias("value")),
        F.struct(F.lit("chat").alias("layer"), F.lit("top_p").alias("key"), F.when(F.col("k") % 5 == 0, "x").otherwise((F.col("k") % 4 / 2).cast("string")).alias("value")),
        F.struct(F.lit("default").alias("layer"), F.lit("top_p").alias("key"), F.lit("0.9").alias("value")),
    )
    return A.resolve_profiles(c.select("chat_id", F.inline(rows)))


def telemetry_tail(spark: SparkSession, d: str) -> DataFrame:
    return A.last_events(table(spark, d, "events"), ["event_type"], ["ts", "event_id"], 20).select("event_id", "event_type", "user_id")


def masked_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Values of state changes as they would enter a log."""
    t = table(spark, d, "state_changes")
    return t.select("change_id", A.redact_diagnostic(F.concat(F.lit("value "), F.coalesce("value", F.lit("null")), F.lit(" at "), F.coalesce("path", F.lit("null")))).alias("diagnostic"), A.mask_secrets(F.concat(F.lit("api_key: "), "segment_id", F.lit(" sk-"), "chat_id")).alias("masked"))


_RAWC = "rc as (select chat_id, sum(length(role) + length(name) + length(text) + 6)::bigint as raw_chars from lm join fg using (chat_id, message_index) group by all)"
_CAND = """
rf as (select chat_id, min(message_index) as raw_first from fg group by all),
c0 as (select sg.*, row_number() over (partition by sg.chat_id order by last_index desc, first_index desc, segment_id) as n, case when segment_row_id % 7 = 0 then (segment_row_id % 13)::double end as score
       from sg left join rf using (chat_id) where status = 'valid' and sg.chat_id is not null and (raw_first is null or last_index < raw_first) and synopsis <> ''),
cand as (select chat_id, case when n <= 8 then 'chronological' else 'associative' end as region, segment_id as item, first_index, last_index,
    (case when first_index = last_index then '[msg ' || first_index || '] ' else '[msgs ' || first_index || '-' || last_index || '] ' end) || synopsis as text,
    case when n <= 8 then (case when coalesce(pinned, false) then 200 else 60 end) else coalesce(score, 0) + 80 + (case when coalesce(pinned, false) then 200 else 0 end) end::double as priority
  from c0 qualify row_number() over (partition by chat_id, first_index, last_index order by n) = 1)"""
_PACK = f"""
sp as ({STATE_SQL["state_projection"]}),
it as (select chat_id, 'state' as region, kind || ':' || key as item, length(text) as n_chars, place from sp
  union all select chat_id, region, item, length(text), n + case region when 'chronological' then 1000000000 else 2000000000 end
  from (select *, row_number() over (partition by chat_id, region order by priority desc, last_index desc, item) as n from cand)),
seq as (select *, row_number() over (partition by chat_id order by place) as i, case region when 'state' then 1 when 'chronological' then 2 else 3 end as r from it),
fold as (
  select s.chat_id, 0::bigint as i, 0 as c1, 0 as c2, 0 as c3, ceil(coalesce(raw_chars, 0) / 4)::bigint as rt, null::varchar as region, null::varchar as item, 0::bigint as place, false as kept
  from (select distinct chat_id from seq) s left join rc using (chat_id)
  union all
  select chat_id, i, case when fits and r = 1 then g else c1 end, case when fits and r = 2 then g else c2 end, case when fits and r = 3 then g else c3 end, rt, region, item, place, fits from (
    select *, ceil(g / 4) <= lim and ceil(((case when r = 1 then g else c1 end) + (case when r = 2 then g else c2 end) + (case when r = 3 then g else c3 end)
        + 2 * ((case when r = 1 or c1 > 0 then 1 else 0 end) + (case when r = 2 or c2 > 0 then 1 else 0 end) + (case when r = 3 or c3 > 0 then 1 else 0 end) - 1) + 160) / 4) + rt <= {HARD} as fits from (
      select f.chat_id, q.i, q.r, q.region, q.item, q.place, f.c1, f.c2, f.c3, f.rt,
        (case q.r when 1 then (case when f.c1 = 0 then 7 else f.c1 end) when 2 then (case when f.c2 = 0 then 16 else f.c2 end) else (case when f.c3 = 0 then 14 else f.c3 end) end + 1 + q.n_chars)::int as g,
        case q.r when 1 then 400 when 2 then 500 else 200 end as lim
      from fold f join seq q on q.chat_id = f.chat_id and q.i = f.i + 1))),
packed as (select chat_id, region, item, place::bigint as place, kept from fold where i > 0)"""
_PACK_PARTS = (SQL_MESSAGES, SQL_POLICY, _FOREGROUND, SQL_SEGMENTS, _RAWC, _CAND, _PACK)
_OMIT = """
om as (select distinct chat_id, message_index from (select *, unnest(range(first_index, last_index + 1))::int as message_index from sg where status = 'valid' and chat_id is not null) s
  where not exists (select 1 from fg where fg.chat_id = s.chat_id and fg.message_index between s.first_index and s.last_index))"""
_EDITS = "ed as (select chat_id, floor(max(message_index) * 2 / 3)::int as edit_index from lm group by all)"
_USAGE = """
us as (select *, case when attempt_id % 3 < 2 then source_tokens end as nominal, case when attempt_id % 3 < 2 then cached_tokens end as cached,
  case when attempt_id % 3 < 2 and cached_tokens is not null then greatest(0, source_tokens - cached_tokens) end as uncached, case when attempt_id % 3 < 2 then output_tokens end as output from attempts)"""

QUERIES = {
    f.__name__: f
    for f in (
        context_budgets, context_candidates, context_pack, context_accounting, omitted_indices, virtualized, external_budget, prompt_audit, extraction_history, invalidated, shifted_ranges, branch_select, job_guard, session_archive,
        promoted, reusable_segments, rebuild_merge, replay_cursor, session_summary, usage_normalized, attempt_costs, daily_spend, token_guard, percentiles, profile_resolve, telemetry_tail, masked_diagnostics,
    )
}

SQL = {
    "context_budgets": """select id, hard, least(raw, greatest(0, hard - least(hard, state + registers + least(1024, chronological) + least(768, associative), floor(hard * 0.4::double))))::bigint as raw_budget
        from (select n_nationkey as id, n_nationkey::bigint * 700 as hard, 8000 - n_nationkey * 100 as raw, n_nationkey * 30 as state, n_nationkey * 10 as registers, n_nationkey * 100 as chronological, n_nationkey * 60 as associative from nation)""",
    "context_candidates": sql(SQL_MESSAGES, SQL_POLICY, _FOREGROUND, SQL_SEGMENTS, _CAND, select="select chat_id, region, item, first_index, last_index, priority from cand"),
    "context_pack": sql(*_PACK_PARTS, select="select * from packed"),
    "context_accounting": sql(*_PACK_PARTS, select=f"""select chat_id, ceil(a / 4)::bigint as state_tokens, 0::bigint as registers_tokens, ceil(b / 4)::bigint as chronological_tokens, ceil(c / 4)::bigint as associative_tokens, rt as raw_tokens,
        total_tokens, total_tokens / {float(HARD)}::double as utilization, total_tokens > {HARD} as overflow, n_dropped from (
          select *, (case when a + b + c > 0 then ceil((a + b + c + 2 * ((a > 0)::int + (b > 0)::int + (c > 0)::int - 1) + 160) / 4) else 0 end + rt)::bigint as total_tokens from (
            select chat_id, arg_max(c1, i) as a, arg_max(c2, i) as b, arg_max(c3, i) as c, max(rt) as rt, count(*) filter (not kept) as n_dropped from fold where i > 0 group by all))"""),
    "omitted_indices": sql(SQL_MESSAGES, SQL_POLICY, _FOREGROUND, SQL_SEGMENTS, _OMIT, select="select * from om"),
    "virtualized": sql(SQL_MESSAGES, SQL_POLICY, _FOREGROUND, SQL_SEGMENTS, _OMIT, select="""select chat_id, count(*) as n_messages, count(gone) as n_omitted, count(*) filter (gone is null and message_index >= raw_first) as depth
        from lm left join (select *, true as gone from om) using (chat_id, message_index) left join (select chat_id, min(message_index) as raw_first from fg group by all) using (chat_id) group by all"""),
    "external_budget": """select *, least(measured_tokens, 2048) as reserve from (select chat_id, count(*) filter (not coalesce(lang = 'xx', false) and length(text) > 0) as n_entries,
          coalesce(sum(ceil(length(text) / 4)) filter (not coalesce(lang = 'xx', false) and length(text) > 0), 0)::bigint as measured_tokens
        from documents where source in ('lorebook', 'author_note', 'character_card') and chat_id is not null group by all)""",
    "prompt_audit": sql(SQL_MESSAGES, SQL_POLICY, _FOREGROUND, select="""select chat_id, n as occurrences, case when n = 1 then 'verified' when n > 1 then 'mismatch' else 'missing' end as outcome from (
        select chat_id, case when length(block) > 0 then ((length(prompt) - length(replace(prompt, block, ''))) // length(block))::bigint else 0 end as n from (
          select chat_id, string_agg(text, chr(10) order by message_index) as prompt, arg_max(text, (length(text), text)) as block from lm join (select chat_id, message_index from fg) using (chat_id, message_index) group by all))"""),
    "extraction_history": sql(
        SQL_SEGMENTS,
        """eh as (select chat_id, segment_id as item, ceil(length(coalesce(synopsis, '')) / 4)::bigint as t, row_number() over (partition by chat_id order by last_index desc, first_index desc, segment_id) as place from sg where status = 'valid' and chat_id is not null),
        ef as (select chat_id, 0::bigint as place, 0::bigint as total, ''::varchar as item, false as kept from eh group by all union all
               select e.chat_id, e.place, f.total + case when f.total + e.t <= 300 then e.t else 0 end, e.item, f.total + e.t <= 300 from ef f join eh e on e.chat_id = f.chat_id and e.place = f.place + 1)""",
        select="select chat_id, item, kept from ef where place > 0",
    ),
    "invalidated": sql(
        SQL_MESSAGES, SQL_SEGMENTS, _EDITS,
        """s as (select * from sg where chat_id is not null),
        cov as (select s.chat_id, min(first_index) as earliest from s join ed using (chat_id) where edit_index between first_index and last_index group by all),
        st as (select s.chat_id, segment_id, case when edit_index between first_index and last_index then 'covers' else 'suffix' end as reason from s join ed using (chat_id) join cov using (chat_id) where first_index >= earliest or edit_index between first_index and last_index),
        dep as (select chat_id, segment_id from st union select s.chat_id, s.segment_id from s join dep on dep.chat_id = s.chat_id and list_contains(s.dependency_ids, dep.segment_id))""",
        select="""select s.chat_id, s.segment_id, case when dep.segment_id is not null and s.status <> 'excluded' then 'stale' else s.status end as status, coalesce(st.reason, case when dep.segment_id is not null then 'dependency' end) as reason
          from s left join dep using (chat_id, segment_id) left join st using (chat_id, segment_id)""",
    ),
    "shifted_ranges": sql(SQL_MESSAGES, SQL_SEGMENTS, _EDITS, select="""select chat_id, segment_id, least(f, l) as first_index, l as last_index from (
        select sg.chat_id, segment_id, case when first_index > edit_index then first_index - 1 else first_index end as f, case when last_index > edit_index then last_index - 1 else last_index end as l from sg left join ed using (chat_id))"""),
    "branch_select": sql(SQL_MESSAGES, "r as (select chat_id, message_index, message_id, md5(concat_ws('|', swipe_id::varchar, coalesce(text, ''))) as fingerprint from messages)", select="""
        select r.*, exists (select 1 from r o where o.chat_id = r.chat_id and o.message_index = r.message_index and o.fingerprint = r.fingerprint and o.message_id not in (select message_id from lm)) as cache_hit
        from r where message_id in (select message_id from lm)"""),
    "job_guard": sql(SQL_SEGMENTS, "f as (select *, md5(concat_ws('|', chat_id, first_index::varchar, last_index::varchar, coalesce(source_token_count::varchar, ''))) as fp from segments where segment_id is not null), g as (select f.* from f join sg using (segment_row_id))", select="""
        select f.segment_id as job_id, f.segment_row_id as begun, f.segment_row_id = max(f.segment_row_id) over (partition by f.segment_id) and coalesce(f.chat_id = g.chat_id, false) and f.fp = g.fp as can_commit from f join g using (segment_id)"""),
    "session_archive": sql(SQL_SEGMENTS, select="""select chat_id, segment_id, status, place::int as place, case when max((status in ('failed', 'stale'))::int) over (partition by chat_id order by place) = 1 and status = 'valid' then 'stale' else status end as archived_status
        from (select chat_id, segment_id, status, row_number() over (partition by chat_id order by first_index, segment_id) as place from sg where chat_id is not null)"""),
    "promoted": sql(
        SQL_SEGMENTS, f"pl as (select chat_id, first_index, last_index from ({PLAN_SQL['segment_plan_turns']}))", "cu as (select *, coalesce(manually_edited, false) or status = 'excluded' as protected from sg where chat_id is not null)",
        select="""select chat_id, first_index, last_index, 'kept' as origin from cu where protected or not exists (select 1 from pl where pl.chat_id = cu.chat_id and pl.first_index <= cu.last_index and pl.last_index >= cu.first_index)
          union all select chat_id, first_index, last_index, 'promoted' from pl where not exists (select 1 from cu where protected and pl.chat_id = cu.chat_id and pl.first_index <= cu.last_index and pl.last_index >= cu.first_index)""",
    ),
    "reusable_segments": sql(
        """rk as (select chat_id, segment_row_id as segment_id, first_index as f, last_index as l, row_number() over (partition by chat_id order by coalesce(manually_edited, false) desc, first_index, updated_at desc nulls last, segment_row_id desc) as i
          from segments where status = 'valid' and prompt_version = 3 and chat_id is not null and first_index <= last_index)""",
        """wk as (select distinct chat_id, 0::bigint as i, []::struct(f int, l int)[] as taken, null::bigint as segment_id from rk
          union all select chat_id, i, case when ok then list_append(taken, {'f': f, 'l': l}) else taken end, case when ok then segment_id end
          from (select r.chat_id, r.i, r.f, r.l, r.segment_id, w.taken, len(list_filter(w.taken, lambda x: r.f <= x.l and r.l >= x.f)) = 0 as ok from wk w join rk r on r.chat_id = w.chat_id and r.i = w.i + 1))""",
        select="select chat_id, segment_id from wk where segment_id is not null",
    ),
    "rebuild_merge": sql(SQL_SEGMENTS, "o as (select chat_id, first_index, last_index, synopsis, manually_edited as manual from sg where chat_id is not null)", select="""
        select chat_id, first_index, last_index, coalesce(h.s, n.synopsis) as synopsis, h.s is not null as manual from (select chat_id, first_index, last_index, upper(synopsis) as synopsis from o where not manual or first_index % 2 = 0) n
        full join (select chat_id, first_index, last_index, max(synopsis) as s from o where manual group by all) h using (chat_id, first_index, last_index)"""),
    "replay_cursor": sql(SQL_ATTEMPTS, select="""select session, attempt_id, place::int as place from (select *, row_number() over (partition by session order by attempt_id) as place from attempts where mode <> 'replay')
        left join (select session, count(*) as n from attempts where output_tokens > 90 group by all) using (session) where place = coalesce(n, 0) + 1"""),
    "session_summary": sql(SQL_SEGMENTS, select="""select chat_id, count(*) as n_items, count(*) filter (status = 'valid') as n_done, count(*) filter (status = 'failed') as n_failed, sum(source_token_count)::bigint as source_tokens,
        sum(('0x' || left(md5(concat_ws('|', segment_id, status)), 10))::bigint)::bigint as baseline_fingerprint from sg where chat_id is not null group by all"""),
    "usage_normalized": sql(SQL_ATTEMPTS, _USAGE, select="select attempt_id, nominal, cached, uncached, output from us"),
    "attempt_costs": sql(SQL_ATTEMPTS, _USAGE, select="""select session, coalesce(sum(nominal), 0)::bigint as nominal_tokens, coalesce(sum(cached), 0)::bigint as cached_tokens, coalesce(sum(output), 0)::bigint as output_tokens,
        round(coalesce(sum(c) filter (mode <> 'replay'), 0)::double, 4) as credits, round(coalesce(sum(c) filter (mode = 'replay'), 0)::double, 4) as replayed_credits, count(*) filter (mode <> 'replay') as n_live, count(*) filter (mode = 'replay') as n_replay
        from (select *, case when nominal is not null then coalesce(uncached, greatest(0, nominal - coalesce(cached, 0))) * 0.5::double + coalesce(cached, 0) * 0.1::double + coalesce(output, 0) * 0.7::double end as c from us) group by all"""),
    "daily_spend": sql(SQL_ATTEMPTS, _USAGE, select="select day::varchar as day, count(*) as n_requests, sum(coalesce(nominal, 0) + coalesce(output, 0))::bigint as total_tokens from us where mode = 'live' group by all"),
    "token_guard": sql(
        SQL_ATTEMPTS,
        """rq as (select session % 40 as ledger, session, attempt_id, day, source_tokens + 100 as projected, source_tokens + output_tokens as actual, coalesce(failure <> 'format', true) as healthy,
            row_number() over (partition by session % 40 order by ts, attempt_id) as i from attempts where mode = 'live')""",
        """gd as (select distinct ledger, 0::bigint as i, null::bigint as session, null::bigint as attempt_id, null::date as day, 0::bigint as projected, ''::varchar as decision, 0::bigint as spent_before, 0::bigint as day_before, map([]::bigint[], []::bigint[]) as spent, 0::bigint as today from rq
          union all select ledger, i, session, attempt_id, day, projected, d, own, today, case when d = 'sent' then map_concat(spent, map([session], [own + actual])) else spent end, today + case when d = 'sent' then actual else 0 end from (
            select *, case when not healthy then 'ledger_unavailable' when own + projected > 200000 then 'session_cap' when today + projected > 30000 then 'daily_cap' else 'sent' end as d from (
              select r.ledger, r.i, r.session, r.attempt_id, r.day, r.projected, r.actual, r.healthy, g.spent, coalesce(g.spent[r.session], 0) as own, case when g.day = r.day then g.today else 0 end as today
              from gd g join rq r on r.ledger = g.ledger and r.i = g.i + 1)))""",
        select="select ledger, session, attempt_id, day::varchar as day, projected, decision, spent_before, day_before from gd where i > 0",
    ),
    "percentiles": """select event_type, count(*) as n, round(avg(cents), 6) as average, list_sort(list(cents))[greatest(1, ceil(count(*) * 0.5::double))::int] as p50, list_sort(list(cents))[greatest(1, ceil(count(*) * 0.95::double))::int] as p95
        from (select event_type, floor(value * 100)::bigint as cents from events) group by all""",
    "profile_resolve": """select * from (select 'chat' || c_custkey as chat_id, 'temperature' as key, case when c_nationkey / 10 <= 2 then c_nationkey / 10 else 0.7::double end as value, case when c_nationkey / 10 <= 2 then 'character' else 'base' end as source from customer
        union all select 'chat' || c_custkey, 'top_p', case when c_custkey % 5 <> 0 and c_custkey % 4 / 2 <= 1 then c_custkey % 4 / 2 else 0.9::double end, case when c_custkey % 5 <> 0 and c_custkey % 4 / 2 <= 1 then 'chat' else 'default' end from customer)""",
    "telemetry_tail": "select event_id, event_type, user_id from events qualify row_number() over (partition by event_type order by ts desc, event_id desc) <= 20",
    "masked_diagnostics": r"""select change_id, left(regexp_replace(regexp_replace('value ' || coalesce(value, 'null') || ' at ' || coalesce(path, 'null'), '"(?:[^"\\]|\\.)*"', '[redacted]', 'g'), '''(?:[^''\\]|\\.)*''', '[redacted]', 'g'), 160) as diagnostic,
        'api_key: [redacted] [redacted]' as masked from state_changes""",
}
