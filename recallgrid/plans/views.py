"""Queries on views over several families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import normalize_alias
from ..functions.vocabulary import DOMAINS
from ..operators import validation
from ..operators import views as W
from ..sources import table
from .common import SQL_BUNDLED, SQL_BUNDLES, SQL_MESSAGES, SQL_SEGMENTS, messages, segments, sql
from .parsing import _FNV, _HEX, _REGISTRY, alias_registry, materialized_entities
from .parsing import SQL as PARSE_SQL
from .planning import _BUNDLE_UNITS, _CHOICES, uncovered_plan
from .state import SQL as STATE_SQL
from .state import _ORDINALS, commitments, conflicts, segment_ordinals


def segment_sources(spark: SparkSession, d: str) -> DataFrame:
    return W.source_of(segments(spark, d), messages(spark, d, "role", "n_tokens")).groupBy("chat_id", "segment_id").agg(F.count("*").alias("n_messages"), F.sum("n_tokens").alias("n_tokens"))


def combined_plans(spark: SparkSession, d: str) -> DataFrame:
    reused = segments(spark, d).where("status = 'valid' and chat_id is not null").select("chat_id", F.col("source_token_count").alias("n_tokens"))
    return W.combine_plans(uncovered_plan(spark, d), reused)


def qualification(spark: SparkSession, d: str) -> DataFrame:
    return W.qualification(messages(spark, d, "role", "hidden", "n_tokens").where("not hidden"))


def repaired_domains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "episode_events").select("event_row_id", F.array_join(W.repair_domains(F.col("domains")), ",").alias("domain_list"))


def resolved_references(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "entity_mentions").where("proposed_entity_id is null and chat_id is not null").select("mention_id", "chat_id", normalize_alias(F.col("mention")).alias("name")).where("name <> ''")
    return W.resolve_references(q, alias_registry(spark, d))


def conflict_status(spark: SparkSession, d: str) -> DataFrame:
    c = conflicts(spark, d)
    log = c.select("chat_id", "subject", "property", (F.col("seq") + F.col("seq") % 3 - 1).alias("seq"), F.when(F.col("seq") % 2 == 0, "resolved").otherwise("dismissed").alias("action"))
    return W.resolve_conflicts(c, log)


def relationship_inspector(spark: SparkSession, d: str) -> DataFrame:
    return W.inspect_relationships(table(spark, d, "relationship_changes"), segments(spark, d))


def _families(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """What the records of segments say, by family in the order of a summary: segment_id, seq, text."""
    words = lambda *columns: F.concat_ws(" ", *(F.when(c != "", c) for c in columns))
    col = F.col
    parts = {
        "events": ("episode_events", "event_row_id", words(col("description")), None), "state": ("state_changes", "change_id", words(col("subject"), col("path"), col("operation"), col("value")), None),
        "relationships": ("relationship_changes", "rel_change_id", words(F.array_join("participants", " "), col("dimension"), col("operation"), col("value")), None),
        "commitments": ("commitments", "commitment_row_id", words(col("actor"), col("toward"), col("content"), col("transition")), col("transition").isin("made", "active", "unknown")),
        "temporal": ("temporal_marks", "mark_id", words(col("description"), col("kind")), None), "entities": ("entity_mentions", "mention_id", words(col("mention"), col("canonical_name_candidate"), F.array_join("aliases", " ")), None),
    }
    return {k: (table(spark, d, t) if keep is None else table(spark, d, t).where(keep)).select("segment_id", F.col(seq).alias("seq"), text.alias("text")) for k, (t, seq, text, keep) in parts.items()}


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return W.semantic_text(segments(spark, d).where("status = 'valid'"), _families(spark, d))


def semantic_texts(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("segment_id", F.md5("text").alias("digest"), F.length("text").alias("n_chars"))


def record_search(spark: SparkSession, d: str) -> DataFrame:
    """Segments any of whose records holds some words, with the segment's id, state and times."""
    both = segments(spark, d).join(_texts(spark, d), "segment_id").select("chat_id", "segment_id", "status", "text", "source_model")
    return validation.search_records(both, " Unpaid ", ("segment_id", "status", "source_model", "text")).select("chat_id", "segment_id")


def stale_suffix(spark: SparkSession, d: str) -> DataFrame:
    s = segment_ordinals(spark, d).join(segments(spark, d).select("segment_id", "status"), "segment_id")
    return W.stale_suffix(s, validation.source_matches(segments(spark, d), messages(spark, d, "role")))


def replay_status(spark: SparkSession, d: str) -> DataFrame:
    plan = segments(spark, d).where("chat_id is not null").select("chat_id", "segment_id")
    records = table(spark, d, "segments").where("structured_trace is not null").select("segment_id", F.md5(F.coalesce("structured_trace.content", F.lit(""))).alias("payload"))
    return W.replay_status(plan, records)


def status_view(spark: SparkSession, d: str) -> DataFrame:
    return W.status_view(messages(spark, d, "role"), segments(spark, d), materialized_entities(spark, d), commitments(spark, d))


_DOMAINS = ", ".join(f"'{x}'" for x in DOMAINS)
_MATCHES = PARSE_SQL["source_matches"]

QUERIES = {f.__name__: f for f in (segment_sources, combined_plans, qualification, repaired_domains, resolved_references, conflict_status, relationship_inspector, semantic_texts, record_search, stale_suffix, replay_status, status_view)}

#: Messages that no valid segment covers; every run of them counts as a chat of its own.
_OPEN_MESSAGES = """
taken as (select distinct chat_id, unnest(range(first_index, last_index + 1))::int as message_index, 1 as t from sg where status = 'valid' and chat_id is not null),
lm as (select * replace (island::varchar || '#' || chat_id as chat_id) from (
  select every.*, t, coalesce(sum(coalesce(t, 0)) over (partition by every.chat_id order by message_index rows between unbounded preceding and 1 preceding), 0)::bigint as island from every left join taken using (chat_id, message_index)) where t is null)"""

_SAID = "select segment_id, string_agg(w, ' ' order by seq) as {0} from (select segment_id, {1} as seq, nullif(concat_ws(' ', {2}), '') as w from {3}) where w is not null group by all"
_PIECES = (
    ("e1", "event_row_id", "nullif(description, '')", "episode_events"), ("e2", "change_id", "nullif(subject, ''), nullif(path, ''), nullif(operation, ''), nullif(value, '')", "state_changes"),
    ("e3", "rel_change_id", "nullif(array_to_string(participants, ' '), ''), nullif(dimension, ''), nullif(operation, ''), nullif(value, '')", "relationship_changes"),
    ("e4", "commitment_row_id", "nullif(actor, ''), nullif(toward, ''), nullif(content, ''), nullif(transition, '')", "commitments where transition in ('made', 'active', 'unknown')"), ("e5", "mark_id", "nullif(description, ''), nullif(kind, '')", "temporal_marks"),
    ("e6", "mention_id", "nullif(mention, ''), nullif(canonical_name_candidate, ''), nullif(array_to_string(aliases, ' '), '')", "entity_mentions"),
)
_TEXTS = (
    ", ".join(f"f{p[0]} as ({_SAID.format(*p)})" for p in _PIECES) + ", tx as (select segment_id, concat_ws(' ', nullif(coalesce(synopsis, ''), ''), e1, e2, e3, e4, e5, e6) as x from sg "
    + " ".join(f"left join f{p[0]} using (segment_id)" for p in _PIECES) + " where status = 'valid')"
)

SQL = {
    "segment_sources": sql(SQL_MESSAGES, SQL_SEGMENTS, select="select s.chat_id, segment_id, count(*) as n_messages, sum(n_tokens)::bigint as n_tokens from sg s join lm on lm.chat_id = s.chat_id and message_index between first_index and last_index group by all"),
    "combined_plans": sql(SQL_MESSAGES.replace("lm as", "every as"), SQL_SEGMENTS, _OPEN_MESSAGES, SQL_BUNDLED, SQL_BUNDLES, _BUNDLE_UNITS, _CHOICES, "pl as (select regexp_replace(chat_id, '^[0-9]+#', '') as chat_id, n_tokens from walk)", select="""select chat_id, count(*) filter (r = 0) as n_planned, count(*) filter (r = 1) as n_reused, coalesce(sum(t) filter (r = 0), 0)::bigint as planned_tokens, coalesce(max(t), 0)::bigint as most_tokens from (
        select chat_id, n_tokens as t, 0 as r from pl union all select chat_id, source_token_count, 1 from sg where status = 'valid' and chat_id is not null) group by all"""),
    "qualification": sql(SQL_MESSAGES, select="""select *, projected_tokens * 0.5::double as projected_credits from (select *, (source_tokens + greatest(600, floor(source_tokens * 0.45::double + 0.5)))::bigint as projected_tokens from (
        select chat_id, count(*) as n_messages, count(*) filter (role = 'user') as n_user, count(*) filter (role = 'user' and coalesce(nxt <> 'assistant', true)) as isolated_users, sum(n_tokens)::bigint as source_tokens
        from (select *, lead(role) over (partition by chat_id order by message_index) as nxt from lm where not hidden) group by all))"""),
    "repaired_domains": f"""select event_row_id, array_to_string(list_filter(m, lambda x, i: list_position(m, x) = i), ',') as domain_list from (
        select event_row_id, list_transform(list_transform(domains, lambda x: regexp_replace(lower(trim(coalesce(x, ''))), '[\\s-]+', '_', 'g')), lambda x: case when x in ({_DOMAINS}) then x when x = 'boundary' then 'relationship' else 'other' end) as m from episode_events)""",
    "resolved_references": sql(
        _REGISTRY, "so as (select chat_id, alias, min(entity_id) as found from ar group by all having count(distinct entity_id) = 1)",
        f"q as (select mention_id, chat_id, name, 'entity:v1:chat:' || chat_id || ':mention:' || name as j from em where entity_id is null and chat_id is not null and name <> '')", f"qh as (select *, {_FNV.format('j')} as h from q)",
        select=f"select mention_id, coalesce(found, 'ent_' || {_HEX.format('h')}) as resolved_id, found is null as is_new from qh left join so on so.chat_id = qh.chat_id and so.alias = qh.name",
    ),
    "conflict_status": f"select *, case when seq % 3 >= 1 then (case when seq % 2 = 0 then 'resolved' else 'dismissed' end) else 'unresolved' end as status from ({STATE_SQL['conflicts']})",
    "relationship_inspector": sql(SQL_SEGMENTS, select="""select segment_id || ':' || (row_number() over (partition by segment_id order by rel_change_id) - 1) as change_key, chat_id, segment_id, array_to_string(participants, '|') as pair, dimension, operation, value
        from relationship_changes where segment_id in (select segment_id from sg where status = 'valid')"""),
    "semantic_texts": sql(SQL_SEGMENTS, _TEXTS, select="select segment_id, md5(x) as digest, length(x)::int as n_chars from tx"),
    "record_search": sql(SQL_SEGMENTS, _TEXTS, select="select sg.chat_id, sg.segment_id from sg join tx using (segment_id) where contains(lower(concat_ws(' ', sg.segment_id, status, source_model, x)), 'unpaid')"),
    "stale_suffix": sql(SQL_SEGMENTS, _ORDINALS, f"ma as ({_MATCHES})", select="""select chat_id, segment_id, case when b = 1 and status <> 'excluded' then 'stale' else status end as status from (
        select o.chat_id, o.segment_id, sg.status, max((not coalesce(ma.matches, false))::int) over (partition by o.chat_id order by ordinal) as b from ords o join sg using (segment_id) left join ma on ma.segment_id = o.segment_id)"""),
    "replay_status": sql(SQL_SEGMENTS, select="""select chat_id, count(*) as n_planned, count(k) as n_available, count(*) filter (k is null) as n_missing, count(*) filter (k > 1) as n_conflicting from (select * from sg where chat_id is not null) left join (
        select segment_id, count(distinct md5(coalesce(structured_trace.content, ''))) as k from segments where structured_trace is not null group by all) using (segment_id) group by all"""),
    "status_view": sql(SQL_MESSAGES, SQL_SEGMENTS, f"cm as ({STATE_SQL['commitments']})", f"me as ({PARSE_SQL['materialized_entities']})", select="""select chat_id, n_messages, last_index, coalesce(n_valid, 0) as n_valid, coalesce((e + 1) / (last_index + 1), 0)::double as coverage, coalesce(n_entities, 0) as n_entities, coalesce(n_open, 0) as n_open_commitments
        from (select chat_id, count(*) as n_messages, max(message_index) as last_index from lm group by all) left join (select chat_id, count(*) filter (status = 'valid') as n_valid, max(last_index) as e from sg group by all) using (chat_id)
        left join (select chat_id, count(*) as n_entities from me group by all) using (chat_id) left join (select chat_id, count(*) as n_open from cm where status in ('active', 'made', 'unknown') group by all) using (chat_id)"""),
}
