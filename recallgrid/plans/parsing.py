"""Queries on parsing, validation, entities and stored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import fingerprint, normalize_alias
from ..functions.runtime import small
from ..functions.vocabulary import DOMAINS, EVIDENCE, SALIENCE, TERMS
from ..functions.vocabulary import COMMITMENT_TRANSITIONS as TRANSITIONS
from ..functions.vocabulary import aliases as term_aliases
from ..operators import entities as E
from ..operators import extraction as X
from ..operators import store as S
from ..operators import validation as V
from ..operators.changefeed import MOST_SPELLINGS, operation_key, removing_spellings
from ..sources import table
from .common import SQL_MESSAGES, SQL_POLICY, SQL_SEGMENTS, messages, segments, sql
from .history import _FOREGROUND, foreground_summary
from .state import _COMMITMENTS, _FNV, _HEX
from .state import commitments as commitment_state
from .upkeep import _OMIT, omitted_indices

def _outputs(spark: SparkSession, d: str, mode: str) -> DataFrame:
    t = table(spark, d, "segments")
    return t.where(F.col("structured_trace.mode") == mode).select("segment_row_id", "segment_id", F.col("structured_trace.content").alias("content"), F.col("structured_trace.finish_reason").alias("finish_reason"), F.lit(mode).alias("mode"))


def parse_structured(spark: SparkSession, d: str) -> DataFrame:
    return X.parse_structured(_outputs(spark, d, "structured"), "segment_row_id", "content")


def parse_tagged(spark: SparkSession, d: str) -> DataFrame:
    return X.parse_tagged(_outputs(spark, d, "fallback"), "segment_row_id", "content")


def tagged_outcome(spark: SparkSession, d: str) -> DataFrame:
    return X.tagged_outcome(_outputs(spark, d, "fallback"), "segment_row_id", "content")


def tagged_families(spark: SparkSession, d: str) -> DataFrame:
    """Typed rows written as lines of tagged output, one output a row, and read back: how many items of each section and its closed fields are usable."""
    line = lambda section, **fields: F.concat(F.lit(f"[{section}]\n- "), F.concat_ws(" | ", *(F.concat(F.lit(f"{k}="), F.col(v)) for k, v in fields.items())))
    r = table(spark, d, "relationship_changes").withColumn("all", F.array_join("participants", ", "))
    outputs = (
        table(spark, d, "commitments").select(F.col("commitment_row_id").alias("id"), line("COMMITMENTS", actor="actor", toward="toward", transition="transition", content="content", evidence="evidence").alias("content")),
        r.select(F.col("rel_change_id").alias("id"), line("RELATIONSHIPS", participants="all", dimension="dimension", operation="operation", change="value", evidence="evidence").alias("content")),
        table(spark, d, "temporal_marks").select(F.col("mark_id").alias("id"), line("TEMPORAL", description="description", kind="kind").alias("content")),
        table(spark, d, "state_changes").select(F.col("change_id").alias("id"), line("STATE_CHANGES", subject="subject", path="path", operation="operation", value="value", persistence="persistence").alias("content")),
    )
    rows = None
    for part in outputs:
        parsed = X.parse_tagged(part, "id", "content").select("section", "details", "ok")
        rows = parsed if rows is None else rows.unionByName(parsed)
    return rows.groupBy("section", F.when(F.col("ok"), F.col("details")).alias("details")).agg(F.count("*").alias("n"))


def extraction_outcome(spark: SparkSession, d: str) -> DataFrame:
    s = _outputs(spark, d, "structured")
    parsed = s.join(X.parse_structured(s, "segment_row_id", "content").select("segment_row_id", "reason"), "segment_row_id")
    f = _outputs(spark, d, "fallback").withColumn("reason", F.lit("ok"))
    rows = parsed.unionByName(f).where("segment_id is not null")
    return X.extraction_outcome(rows.select("segment_id", F.col("segment_row_id").alias("attempt"), "reason", "finish_reason", "mode"))


#: Free-typed columns by table, with the id of the row and the field whose terms they name.
TYPED = (
    ("commitments", "commitment_row_id", "transition", "commitment_transition"), ("commitments", "commitment_row_id", "transition", "thread_transition"), ("relationship_changes", "rel_change_id", "dimension", "relationship_dimension"),
    ("relationship_changes", "rel_change_id", "operation", "relationship_operation"), ("temporal_marks", "mark_id", "kind", "temporal_kind"), ("temporal_marks", "mark_id", "kind", "location_kind"), ("episode_events", "event_row_id", "salience", "salience"),
    ("state_changes", "change_id", "operation", "state_operation"), ("state_changes", "change_id", "operation", "knowledge_operation"), ("state_changes", "change_id", "persistence", "persistence"), ("relationship_changes", "rel_change_id", "value", "knowledge_kind"),
)


def vocab_normalize(spark: SparkSession, d: str) -> DataFrame:
    """The term each typed value names, field by field."""
    rows = None
    for t, id_, column, field in TYPED:
        part = table(spark, d, t).where(F.col(column).isNotNull()).select(F.col(id_).alias("row_id"), F.lit(field).alias("field"), X.normalize_term(F.col(column), field).alias("term"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def evidence_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "commitments").select("commitment_row_id", X.normalize_evidence(F.col("evidence")).alias("evidence"), X.normalize_evidence(F.col("evidence"), inference=True).alias("inferred"))


def field_sanitize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(X.sanitize(F.col("text"))).alias("sanitized"), F.length(X.sanitize(F.col("text"))).alias("n"))


def literal_types(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "state_changes").where("value is not null")
    return t.groupBy(X.literal_type(F.regexp_replace("value", '^"(.*)"$', "$1")).alias("literal")).agg(F.count("*").alias("n"))


def provider_failures(spark: SparkSession, d: str) -> DataFrame:
    """Errors made up from the events: codes, statuses and messages by their numbers."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, d, "events").select("event_id", F.when(k % 7 == 0, "quota").when(k % 7 == 1, "TOKEN_LIMIT").alias("code"), F.when(k % 5 == 0, k + 400).alias("status"), F.when(k % 3 == 0, F.concat(F.lit("got http "), (k + 450).cast("string"))).alias("message"), F.initcap("event_type").alias("name"))
    out = rows.select("event_id", X.provider_failure(F.col("code"), F.col("status"), F.col("message"), F.col("name")).alias("failure"))
    return out.withColumn("retryable", X.is_retryable(F.col("failure")))


def bounded_regions(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders")
    k = F.col("o_orderkey")
    rows = t.select("o_orderkey", (k % 400).alias("base"), (k % 300).alias("raw"), (k % 700).alias("historical"), (k % 500).alias("chronological"))
    return X.bounded_regions(rows, 900).select("o_orderkey", "raw_kept", "historical_kept", "chronological_kept")


def validate_segments(spark: SparkSession, d: str) -> DataFrame:
    return V.validate_segments(table(spark, d, "segments"))


def validate_commitments(spark: SparkSession, d: str) -> DataFrame:
    return V.validate_commitments(table(spark, d, "commitments"), TRANSITIONS, EVIDENCE)


def validate_events(spark: SparkSession, d: str) -> DataFrame:
    return V.validate_events(table(spark, d, "episode_events"), DOMAINS, EVIDENCE, SALIENCE)


def _eligible(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).withColumn("eligible", F.when(F.col("segment_row_id") % 9 == 0, False)).withColumn("range_fp", F.concat_ws(":", F.col("first_index").cast("string"), F.col("last_index").cast("string")))


def validate_relationships(spark: SparkSession, d: str) -> DataFrame:
    return V.validate_relationships(table(spark, d, "relationship_changes"), TERMS["relationship_dimension"], TERMS["relationship_operation"], EVIDENCE)


def validate_temporal(spark: SparkSession, d: str) -> DataFrame:
    return V.validate_temporal(table(spark, d, "temporal_marks"), TERMS["temporal_kind"], EVIDENCE)


def validate_state_changes(spark: SparkSession, d: str) -> DataFrame:
    return V.validate_state_changes(table(spark, d, "state_changes"), TERMS["state_operation"], TERMS["persistence"], EVIDENCE)


def injectable_segments(spark: SparkSession, d: str) -> DataFrame:
    e = _eligible(spark, d)
    return V.injectable(e, e.where("last_index % 3 > 0").select("range_fp")).select("chat_id", "segment_id")


def source_matches(spark: SparkSession, d: str) -> DataFrame:
    return V.source_matches(segments(spark, d), messages(spark, d, "role"))


def before_raw(spark: SparkSession, d: str) -> DataFrame:
    return V.before_raw(segments(spark, d), foreground_summary(spark, d).select("chat_id", F.col("first_index").alias("raw_first"))).select("chat_id", "segment_id")


def timeline_search(spark: SparkSession, d: str) -> DataFrame:
    return V.search_timeline(segments(spark, d), " Protest ").select("chat_id", "segment_id")


def sensitive_segments(spark: SparkSession, d: str) -> DataFrame:
    return V.sensitive_segments(table(spark, d, "episode_events"))


def message_health(spark: SparkSession, d: str) -> DataFrame:
    return V.message_health(messages(spark, d, "role"), _eligible(spark, d), omitted_indices(spark, d))


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of segment ranges, byte for byte."""
    json = F.concat(F.lit('{"first":'), F.col("first_index").cast("string"), F.lit(',"last":'), F.col("last_index").cast("string"), F.lit(',"segment":"'), "segment_id", F.lit('"}'))
    return segments(spark, d).select("segment_id", fingerprint("source-range", json).alias("fingerprint"))


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entity_mentions").withColumnRenamed("proposed_entity_id", "entity_id")


def normalized_aliases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entity_mentions").select("mention_id", normalize_alias(F.col("mention")).alias("name"))


def entity_ids(spark: SparkSession, d: str) -> DataFrame:
    return E.mention_ids(table(spark, d, "entity_mentions"))


def alias_registry(spark: SparkSession, d: str) -> DataFrame:
    return E.alias_registry(_mentions(spark, d))


def materialized_entities(spark: SparkSession, d: str) -> DataFrame:
    return E.materialize_entities(_mentions(spark, d))


def entity_propose(spark: SparkSession, d: str) -> DataFrame:
    m = _mentions(spark, d)
    q = m.where("entity_id is null and mention is not null").select("mention_id", "chat_id", normalize_alias(F.col("mention")).alias("name"), "sender_id")
    sender = m.where("entity_id is not null").groupBy("chat_id", "entity_id").agg(F.min_by("sender_id", "mention_id").alias("sender_id"))
    return E.propose(q, alias_registry(spark, d).join(sender, ["chat_id", "entity_id"]))


def group_participants(spark: SparkSession, d: str) -> DataFrame:
    return E.group_participants(messages(spark, d, "role", "hidden", "name"))


def speakers(spark: SparkSession, d: str) -> DataFrame:
    return E.speakers(messages(spark, d, "name"), alias_registry(spark, d))


def segment_upsert(spark: SparkSession, d: str) -> DataFrame:
    return S.upsert_segments(table(spark, d, "segments")).select("segment_id", "segment_row_id", "status")


def segment_actions(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d)
    k = F.col("segment_row_id")
    log = s.select("segment_id", F.inline(F.array(
        F.struct(F.lit(1).alias("seq"), F.when(k % 3 == 0, "pin").otherwise("exclude").alias("action"), F.lit(None).cast("string").alias("value")),
        F.struct(F.lit(2).alias("seq"), F.when(k % 4 == 0, "include").when(k % 4 == 1, "unpin").otherwise("edit").alias("action"), F.lit("edited").alias("value")),
    )))
    return S.fold_actions(s, log).select("segment_id", "status", "pinned", F.length("synopsis").alias("n"))


def commitment_retire(spark: SparkSession, d: str) -> DataFrame:
    state = commitment_state(spark, d).select("chat_id", "commitment_id", "status")
    wanted = state.groupBy("chat_id").agg(F.max("commitment_id").alias("target")).unionByName(state.select("chat_id", F.lit("1").alias("target")).distinct())
    return S.retire_commitments(state, wanted)


def attempt_journal(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "segments").where("segment_id is not null").select("segment_id", F.md5(F.coalesce(F.col("structured_trace.content"), F.lit(""))).alias("payload"), "segment_row_id")
    return S.attempt_journal(t, "segment_id", "payload", "segment_row_id")


def kv_last_writes(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "state_changes").where("subject is not null and path is not null")
    removing = removing_spellings(table(spark, d, "canonical_values")).withColumn("deleted", F.lit(True))
    marked = t.withColumn("op_key", operation_key(F.coalesce("operation", F.lit("")))).join(small(removing, MOST_SPELLINGS, "spellings of removals"), "op_key", "left")
    return S.last_writes(marked.select("chat_id", "subject", "path", "change_id", "value", F.coalesce("deleted", F.lit(False)).alias("deleted")), ["chat_id", "subject", "path"], "change_id", "value", "deleted")


def session_pick(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("session"), F.col("o_orderdate").alias("updated"))
    return S.pick_session(o, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("session")), ["customer"])


def content_digest(spark: SparkSession, d: str) -> DataFrame:
    return S.content_digest(messages(spark, d))


def _vocab_sql(row_id: str, table_: str, column: str, field: str) -> str:
    """The aliases as a list of values, joined: a way of its own beside the expressions checked."""
    pairs = ", ".join(f"('{k}', '{v}')" for k, v in [*((t, t) for t in TERMS[field]), *((k, v) for k, v in term_aliases(field).items() if k not in TERMS[field])])
    return f"select {row_id} as row_id, '{field}' as field, term from {table_} left join (values {pairs}) as v (word, term) on word = lower(trim({column})) where {column} is not null"


_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_SANITIZE = r"left(regexp_replace(replace(replace(regexp_replace({0}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '<', '&lt;'), '>', '&gt;'), '^\s+|\s+$', '', 'g'), 2000)"
_ALIAS = "trim(regexp_replace(strip_accents(lower({0})), '[^a-z0-9]+', ' ', 'g'))"
_PARSED = r"""
ps as (select segment_row_id, segment_id, finish_reason, case when valid and (not is_object or len(coalesce(names, [])) = 0) then 'empty_object' when valid and len(miss) > 0 then 'schema_invalid' when valid then 'ok'
    when regexp_matches(t, '^[{\[]') and (unclosed_depth > 0 or unterminated_string or not regexp_matches(t, '[}\]]$')) then 'truncated' else 'invalid_json' end as reason,
    unclosed_depth, unterminated_string, case when valid and is_object then array_to_string(miss, ',') else '' end as missing from (
  select *, greatest(0, length(regexp_replace(outside, '[^{\[]', '', 'g')) - length(regexp_replace(outside, '[^}\]]', '', 'g'))) as unclosed_depth,
    list_filter(['synopsis', 'entities', 'events', 'stateChanges', 'threads', 'salientNegatives'], lambda x: not list_contains(coalesce(names, []), x)) as miss from (
    select *, length(regexp_replace(bare, '[^"]', '', 'g')) % 2 = 1 as unterminated_string, regexp_replace(bare, '(?s)".*$', '') as outside, json_valid(t) and not has_trail as valid, t like '{%' as is_object,
      case when json_valid(t) and not has_trail and t like '{%' then json_keys(t) end as names from (
      select *, regexp_replace(t, '"(?s:[^"\\]|\\.)*"', '', 'g') as bare, regexp_matches(regexp_replace(t, '"(?s:[^"\\]|\\.)*"', 's', 'g'), ',\s*[}\]]') as has_trail from (
        select segment_row_id, segment_id, structured_trace.finish_reason as finish_reason, regexp_replace(structured_trace.content, '^\s+|\s+$', '', 'g') as t from segments where structured_trace.mode = 'structured') where t is not null))))"""


def _field_sql(name: str) -> str:
    return f"nullif({_SANITIZE.format(chr(39).join(['regexp_extract(line, ', f'(?i)(?:^[ ]*-?|[|])[ ]*{name}[ ]*=([^|]*)', ', 1)']))}, '')"


_TAGGED = f"""
li as (select segment_row_id, unnest(string_split_regex(structured_trace.content, '\\r?\\n')) as line, generate_subscripts(string_split_regex(structured_trace.content, '\\r?\\n'), 1) as n from segments where structured_trace.mode = 'fallback'),
tg as (select *, last_value(tag ignore nulls) over (partition by segment_row_id order by n rows between unbounded preceding and current row) as section from (select *, nullif(regexp_extract(line, '^\\s*\\[([A-Z_]+)\\]\\s*$', 1), '') as tag from li)),
im as (select *, row_number() over (partition by segment_row_id, section order by n) as item_no from (
  select *, {_SANITIZE.format("regexp_replace(split_part(line, '|', 1), '^[ ]*-[ ]*', '')")} as plain from tg where tag is null and section in ('ENTITIES', 'EVENTS') and regexp_matches(line, '^\\s*-')) where lower(plain) not in ('none', '(none)', 'empty', 'n/a', 'not applicable'))"""

QUERIES = {
    f.__name__: f
    for f in (
        parse_structured, parse_tagged, tagged_outcome, tagged_families, extraction_outcome, vocab_normalize, evidence_normalize, field_sanitize, literal_types, provider_failures, bounded_regions, validate_segments, validate_commitments, validate_events, validate_relationships, validate_temporal, validate_state_changes, injectable_segments, source_matches,
        before_raw, timeline_search, sensitive_segments, message_health, fingerprints, normalized_aliases, entity_ids, alias_registry, materialized_entities, entity_propose, group_participants, speakers, segment_upsert, segment_actions,
        commitment_retire, attempt_journal, kv_last_writes, session_pick, content_digest,
    )
}

_E = ", ".join(f"'{x}'" for x in EVIDENCE)
_BAD = "case when not coalesce({1}, false) then '{0}' end"
_REGISTRY = f"""
em as (select *, proposed_entity_id as entity_id, {_ALIAS.format('mention')} as name from entity_mentions),
ar as (select chat_id, entity_id, alias, count(distinct segment_id) as n_segments, bool_or(c) as confirmed from (
  select chat_id, entity_id, segment_id, name as alias, coalesce(kind <> 'unknown', false) as c from em union all
  select chat_id, entity_id, segment_id, {_ALIAS.format('a')}, false from (select *, unnest(aliases) as a from em)) where entity_id is not null and alias <> '' group by all)"""
_WORDS = "list_distinct(list_filter(string_split({0}, ' '), lambda x: x <> ''))"

_READ_ITEMS = f"""select *, main is not null and (section = 'ENTITIES' or (coalesce(ev, 'explicit') in ({_E}) and coalesce(sa, 'normal') in ('minor', 'normal', 'important', 'critical') and dm is null)) as good from (
          select *, case section when 'ENTITIES' then coalesce({_field_sql('mention')}, {_field_sql('name')}, nullif(plain, '')) else coalesce({_field_sql('description')}, {_field_sql('event')}, nullif(plain, '')) end as main,
            {_field_sql('evidence')} as ev, {_field_sql('salience')} as sa, {_field_sql('domains')} as dm from im where item_no <= 100)"""
#: A cell written into a line of fields and read back: up to the next bar, blanks around it dropped.
_CELL = "nullif(trim(split_part({0}, '|', 1)), '')"

SQL = {
    "parse_structured": sql(_PARSED, select="select segment_row_id, reason, unclosed_depth::int as unclosed_depth, unterminated_string, missing from ps"),
    "parse_tagged": sql(_TAGGED, select=f"select segment_row_id, section, item_no::int as item_no, main, case when section = 'EVENTS' then 'evidence=' || coalesce(ev, 'explicit') || '; salience=' || coalesce(sa, 'normal') else '' end as details, case when section = 'EVENTS' then coalesce(ev, 'explicit') end as evidence, good as ok from ({_READ_ITEMS})"),
    "tagged_outcome": sql(_TAGGED, select=rf"""select t.segment_row_id, case when coalesce(synopsis, '') = '' then 'missing_synopsis' when not regexp_matches(synopsis, '[.!?]["''’”\])}}]*$') then 'truncated_synopsis' else 'ok' end as reason, coalesce(n_items, 0)::bigint as n_items,
          coalesce(n_items, 0) = 0 as degraded, coalesce(warnings, '') as warnings
        from (select segment_row_id from segments where structured_trace.mode = 'fallback' and structured_trace.content is not null) t
        left join (select segment_row_id, {_SANITIZE.format("string_agg(line, chr(10) order by n)")} as synopsis from tg where section = 'SYNOPSIS' and tag is null group by all) using (segment_row_id)
        left join (select segment_row_id, sum(k) as n_items, string_agg(section || ': discarded invalid line', '; ' order by section) filter (bad) as warnings
          from (select segment_row_id, section, count(*) filter (good) as k, bool_or(not good) as bad from ({_READ_ITEMS}) group by all) group by all) using (segment_row_id)"""),
    "tagged_families": f"""select section, case when ok then details end as details, count(*) as n from (
        select 'COMMITMENTS' as section, 'evidence=' || coalesce({_CELL.format('evidence')}, 'explicit') || '; transition=' || {_CELL.format('transition')} as details,
          {_CELL.format('actor')} is not null and {_CELL.format('content')} is not null and coalesce({_CELL.format('evidence')}, 'explicit') in ({_E}) and coalesce({_CELL.format('transition')} in ('made', 'active', 'kept', 'broken', 'released', 'obsolete', 'superseded', 'unknown'), false) as ok from commitments
        union all select 'RELATIONSHIPS', 'dimension=' || {_CELL.format('dimension')} || '; evidence=' || coalesce({_CELL.format('evidence')}, 'explicit') || '; operation=' || coalesce({_CELL.format('operation')}, 'set'),
          coalesce(len(list_filter(participants, lambda x: trim(x) <> '')) >= 2, false) and {_CELL.format('value')} is not null and coalesce({_CELL.format('evidence')}, 'explicit') in ({_E}) and coalesce({_CELL.format('operation')}, 'set') in ('add', 'set', 'revise', 'remove', 'transition')
          and coalesce({_CELL.format('dimension')} in ('formal_status', 'domestic_status', 'emotional_closeness', 'trust', 'current_conflict', 'romantic_attraction', 'romantic_intent', 'sexual_attraction', 'sexual_intent', 'physical_affection', 'romantic_history', 'sexual_history', 'exclusivity', 'boundary', 'reconciliation'), false) from relationship_changes
        union all select 'TEMPORAL', 'evidence=explicit; kind=' || {_CELL.format('kind')}, {_CELL.format('description')} is not null and coalesce({_CELL.format('kind')} in ('exact', 'relative', 'approximate', 'ordering', 'deadline'), false) from temporal_marks
        union all select 'STATE_CHANGES', 'evidence=explicit; operation=' || coalesce({_CELL.format('operation')}, 'set') || '; persistence=' || coalesce({_CELL.format('persistence')}, 'active'),
          {_CELL.format('subject')} is not null and {_CELL.format('path')} is not null and {_CELL.format('value')} is not null and coalesce({_CELL.format('operation')}, 'set') in ('add', 'set', 'revise', 'remove', 'transition') and coalesce({_CELL.format('persistence')}, 'active') in ('transient', 'active', 'durable', 'historical', 'archived') from state_changes) group by all""",
    "extraction_outcome": sql(_PARSED, select="""select segment_id, count(*) as n_attempts, min(a) filter (reason = 'ok') as first_ok, arg_max(reason, a) filter (reason <> 'ok') as last_failure,
        ['standard', 'compact', 'minimal_fallback', 'tight_fallback'][max(case when mode = 'fallback' and t then 3 when mode = 'fallback' then 2 when t or reason in ('invalid_json', 'schema_invalid', 'empty_object') then 1 else 0 end) + 1] as stage from (
          select segment_id, segment_row_id as a, reason, 'structured' as mode, coalesce(finish_reason = 'length' or reason = 'truncated', reason = 'truncated') as t from ps where segment_id is not null
          union all select segment_id, segment_row_id, 'ok', 'fallback', coalesce(structured_trace.finish_reason = 'length', false) from segments where structured_trace.mode = 'fallback' and segment_id is not null) group by all"""),
    "vocab_normalize": " union all ".join(_vocab_sql(id_, t, column, field) for t, id_, column, field in TYPED),
    "evidence_normalize": f"""select commitment_row_id, case when evidence in ({_E}) then evidence when weak then 'weak_inference' when regexp_matches(low, 'infer|impli|suggest') then 'strong_inference' else 'explicit' end as evidence,
        case when evidence = 'explicit' then 'strong_inference' when evidence in ({_E}) then evidence when weak then 'weak_inference' else 'strong_inference' end as inferred
        from (select *, lower(coalesce(evidence, '')) as low, regexp_matches(lower(coalesce(evidence, '')), 'weak|speculat|possibly|perhaps|uncertain') as weak from commitments)""",
    "field_sanitize": f"select doc_id, md5({_SANITIZE.format('text')}) as sanitized, length({_SANITIZE.format('text')})::int as n from documents",
    "literal_types": f"""select case when regexp_matches(t, '(?i)^(true|false)$') then 'boolean' when regexp_matches(t, '^-?\\d+(\\.\\d+)?$') then 'number' when t like '{{%' and json_valid(t) then 'object' when t like '[%' and json_valid(t) then 'array' else 'string' end as literal, count(*) as n
        from (select {_SANITIZE.format("regexp_replace(value, '^\"(.*)\"$', '\\1')")} as t from state_changes where value is not null) group by all""",
    "provider_failures": """select *, failure like 'provider_%' and failure not in ('provider_quota', 'provider_rate_limit', 'provider_authentication', 'provider_access_denied', 'provider_unavailable', 'provider_moderation', 'provider_token_limit') as retryable from (
        select event_id, case when k % 7 = 0 then 'provider_quota' when k % 7 = 1 then 'token_limit' when k % 5 = 0 and k + 400 <= 599 then 'provider_http_' || (k + 400) when k % 3 = 0 then 'provider_http_' || (k + 450) else 'provider_' || event_type end as failure
        from (select *, (props ->> '$.k')::int as k from events))""",
    "bounded_regions": """select k as o_orderkey, case when b + r + h + c <= 900 then r else 0 end as raw_kept, case when b + h + c <= 900 then h else 0 end as historical_kept, case when b + c <= 900 then c else 0 end as chronological_kept
        from (select o_orderkey as k, o_orderkey % 400 as b, o_orderkey % 300 as r, o_orderkey % 700 as h, o_orderkey % 500 as c from orders)""",
    "validate_segments": "select segment_row_id, errors, errors = '' as ok from (select segment_row_id, concat_ws('; ', " + ", ".join(_BAD.format(m, c) for m, c in (
        ("id must be a segment id", "regexp_matches(segment_id, '^seg_[0-9a-f]{16}$')"), ("source range is invalid", "first_index <= last_index"), ("dependencyIds must be an array", "dependency_ids is not null"), ("sourceTokenCount must be a non-negative integer", "source_token_count >= 0"),
        ("status is unknown", "status in ('pending', 'valid', 'stale', 'failed', 'excluded')"), ("promptVersion is required", "prompt_version >= 1"), ("summary.synopsis is required", "status <> 'valid' or trim(synopsis) <> ''"), ("createdAt is required", "created_at is not null"),
        ("updatedAt is required", "updated_at is not null"), ("manuallyEdited must be boolean", "manually_edited is not null"), ("pinned must be boolean", "pinned is not null"))) + ") as errors from segments)",
    "validate_commitments": "select commitment_row_id, errors, errors = '' as ok from (select commitment_row_id, concat_ws('; ', " + ", ".join(_BAD.format(m, c) for m, c in (
        ("actor must be an EntityId", "regexp_matches(actor, '^ent_[0-9a-f]{16}$')"), ("toward must be an EntityId", "toward is null or regexp_matches(toward, '^ent_[0-9a-f]{16}$')"), ("content is required", "trim(content) <> ''"),
        ("transition is unknown", f"transition in ({', '.join(repr(x) for x in TRANSITIONS)})"), ("evidence is unknown", f"evidence in ({_E})"))) + ") as errors from commitments)",
    "validate_relationships": "select rel_change_id, errors, errors = '' as ok from (select rel_change_id, concat_ws('; ', " + ", ".join(_BAD.format(m, c) for m, c in (
        ("at least two participants are required", "len(participants) >= 2"), ("participants must be EntityIds", "participants is not null and len(list_filter(participants, lambda x: not coalesce(regexp_matches(x, '^ent_[0-9a-f]{16}$'), false))) = 0"),
        ("dimension is unknown", f"dimension in {TERMS['relationship_dimension']}"), ("operation is unknown", f"operation in {TERMS['relationship_operation']}"), ("value is required", "value is not null"), ("evidence is unknown", f"evidence in ({_E})"))) + ") as errors from relationship_changes)",
    "validate_temporal": "select mark_id, errors, errors = '' as ok from (select mark_id, concat_ws('; ', " + ", ".join(_BAD.format(m, c) for m, c in (
        ("description is required", "trim(description) <> ''"), ("kind is unknown", f"kind in {TERMS['temporal_kind']}"), ("evidence is unknown", f"evidence in ({_E})"))) + ") as errors from temporal_marks)",
    "validate_state_changes": "select change_id, errors, errors = '' as ok from (select change_id, concat_ws('; ', " + ", ".join(_BAD.format(m, c) for m, c in (
        ("subject must be an EntityId", "regexp_matches(subject, '^ent_[0-9a-f]{16}$')"), ("path is required", "trim(path) <> ''"), ("operation is unknown", f"operation in {TERMS['state_operation']}"), ("value is required", "value is not null or operation = 'remove'"),
        ("persistence is unknown", f"persistence in {TERMS['persistence']}"), ("evidence is unknown", f"evidence in ({_E})"))) + ") as errors from state_changes)",
    "validate_events": "select event_row_id, errors, errors = '' as ok from (select event_row_id, concat_ws('; ', " + ", ".join(_BAD.format(m, c) for m, c in (
        ("description is required", "trim(description) <> ''"), ("participants must be an array", "participants is not null"), ("evidence is unknown", f"evidence in ({_E})"), ("salience is unknown", f"salience in ({', '.join(repr(x) for x in SALIENCE)})"),
        ("domains are unknown", f"domains is not null and len(list_filter(domains, lambda x: x is null or not list_contains([{', '.join(repr(x) for x in DOMAINS)}], x))) = 0"))) + ") as errors from episode_events)",
    "injectable_segments": sql(SQL_SEGMENTS, select="""select chat_id, segment_id from sg where status = 'valid' and segment_row_id % 9 <> 0
        and first_index::varchar || ':' || last_index::varchar in (select first_index::varchar || ':' || last_index::varchar from sg where last_index % 3 > 0)"""),
    "source_matches": sql(SQL_MESSAGES, SQL_SEGMENTS, select="""select s.chat_id, s.segment_id, count(lm.message_id) as n_present, count(lm.message_id) = any_value(last_index - first_index + 1) as matches
        from sg s left join lm on lm.chat_id = s.chat_id and lm.message_index between first_index and last_index where s.chat_id is not null and first_index <= last_index group by all"""),
    "before_raw": sql(SQL_MESSAGES, SQL_POLICY, _FOREGROUND, SQL_SEGMENTS, select="select chat_id, segment_id from sg join (select chat_id, min(message_index) as rf from fg group by all) using (chat_id) where last_index < rf"),
    "timeline_search": sql(SQL_SEGMENTS, select="select chat_id, segment_id from sg where contains(lower(concat_ws(' ', segment_id, status, synopsis)), 'protest')"),
    "sensitive_segments": "select distinct chat_id, segment_id from episode_events where list_contains(domains, 'romantic') or list_contains(domains, 'sexual')",
    "message_health": sql(SQL_MESSAGES, SQL_POLICY, _FOREGROUND, SQL_SEGMENTS, _OMIT, select="""select chat_id, message_index, segment_id, health, case when health = 'green' and gone then 'summarized' else 'raw' end as context from (
        select lm.chat_id, lm.message_index, s.segment_id, o.message_index is not null as gone,
          case when s.segment_id is null then 'none' when s.status in ('stale', 'excluded') then s.status when s.status = 'valid' and s.segment_row_id % 9 <> 0 then 'green' when s.status in ('pending', 'failed') then 'pending' else 'raw' end as health
        from lm left join (select * from sg where first_index <= last_index) s on s.chat_id = lm.chat_id and lm.message_index between s.first_index and s.last_index left join om o on o.chat_id = lm.chat_id and o.message_index = lm.message_index
        qualify row_number() over (partition by lm.chat_id, lm.message_index order by s.first_index, s.segment_id) = 1)"""),
    "fingerprints": sql(SQL_SEGMENTS, f"""fj as (select segment_id, 'source-range:v1:{{"first":' || first_index || ',"last":' || last_index || ',"segment":"' || segment_id || '"}}' as j from sg), fh as (select segment_id, {_FNV.format('j')} as h from fj)""", select=f"select segment_id, 'fp1_' || {_HEX.format('h')} as fingerprint from fh"),
    "normalized_aliases": f"select mention_id, {_ALIAS.format('mention')} as name from entity_mentions",
    "entity_ids": sql(f"ei as (select mention_id, name, 'entity:v1:chat:' || chat_id || ':mention:' || name as j from (select *, {_ALIAS.format('mention')} as name from entity_mentions) where name <> ''), eh as (select mention_id, name, {_FNV.format('j')} as h from ei)", select=f"select mention_id, name, 'ent_' || {_HEX.format('h')} as entity_id from eh"),
    "alias_registry": sql(_REGISTRY, select="select * from ar"),
    "materialized_entities": "select chat_id, proposed_entity_id as entity_id, arg_min(mention, mention_id) as canonical_name, arg_max(kind, mention_id) as kind, count(*) as n_mentions from entity_mentions where proposed_entity_id is not null and mention is not null group by all",
    "entity_propose": sql(
        _REGISTRY,
        f"""sn as (select chat_id, entity_id, arg_min_null(sender_id, mention_id) as sender_id from em where entity_id is not null group by all),
        pr as (select q.mention_id, r.entity_id, max(case when q.name = r.alias then 1 else len(list_intersect({_WORDS.format('q.name')}, {_WORDS.format('r.alias')})) / greatest(len({_WORDS.format('q.name')}), len({_WORDS.format('r.alias')})) * 0.7::double end)::double as s,
            bool_or(q.name = r.alias) as exact, bool_or(coalesce(q.sender_id = sn.sender_id, false)) as sender
          from em q join ar r on r.chat_id = q.chat_id join sn on sn.chat_id = r.chat_id and sn.entity_id = r.entity_id
          where q.entity_id is null and q.mention is not null and q.name <> '' group by all),
        rkd as (select *, lead(score) over w as nxt, row_number() over w as n from (select *, round(s + 0.2::double + case when sender then 0.5::double else 0 end, 9) as score from pr) window w as (partition by mention_id order by score desc, entity_id))""",
        select="""select q.mention_id, case when not amb and score >= 0.5 then entity_id end as proposed_entity_id, case when exact and not amb then 'high' when entity_id is not null then 'uncertain' else 'new' end as confidence, score as best_score,
          entity_id is null or not coalesce(exact, false) or amb as requires_confirmation from (select mention_id from em where entity_id is null and mention is not null and name <> '') q left join (select mention_id, entity_id, exact, score, coalesce(score - nxt < 0.15, false) as amb from rkd where n = 1) using (mention_id)""",
    ),
    "group_participants": sql(SQL_MESSAGES, select=f"""select chat_id, name, first_index from (select chat_id, {_ALIAS.format('name')} as key, arg_min(trim(name), message_index) as name, min(message_index) as first_index from lm where role = 'assistant' and not hidden group by chat_id, key) where key <> ''"""),
    "speakers": sql(SQL_MESSAGES, _REGISTRY, select=f"""select n.chat_id, n.name, min(entity_id) as entity_id from (select distinct chat_id, name, {_ALIAS.format('name')} as alias from lm) n join (select distinct chat_id, alias, entity_id from ar) r on r.chat_id = n.chat_id and r.alias = n.alias where n.alias <> '' group by n.chat_id, n.name having count(*) = 1"""),
    "segment_upsert": "select segment_id, segment_row_id, status from segments where segment_id is not null qualify row_number() over (partition by segment_id order by coalesce(manually_edited, false) desc, updated_at desc nulls last, segment_row_id desc) = 1",
    "segment_actions": sql(SQL_SEGMENTS, select="""select segment_id, case when k % 4 <> 0 and k % 3 <> 0 then 'excluded' when k % 4 = 0 and status = 'excluded' then (case when coalesce(synopsis, '') <> '' then 'valid' else 'pending' end) else status end as status,
        case when k % 4 = 1 then false when k % 3 = 0 then true else pinned end as pinned, length(case when k % 4 > 1 then 'edited' else synopsis end)::int as n from (select *, segment_row_id as k from sg)"""),
    "commitment_retire": sql(_COMMITMENTS, select="""select chat_id, commitment_id, case when status in ('made', 'active', 'unknown') and (place = 1 or commitment_id = last) then 'obsolete' else status end as status
        from (select *, row_number() over (partition by chat_id order by commitment_id) - 1 as place, max(commitment_id) over (partition by chat_id) as last from cm)"""),
    "attempt_journal": """select segment_id, payload, row_number() over (partition by segment_id order by f)::int as attempt from (select segment_id, md5(coalesce(structured_trace.content, '')) as payload, min(segment_row_id) as f from segments where segment_id is not null group by all)""",
    "kv_last_writes": r"""select chat_id, subject, path, value from (select chat_id, subject, path, arg_max_null(value, change_id) as value, arg_max_null(regexp_replace(regexp_replace(lower(coalesce(operation, '')), '[\s_\-]+', ' ', 'g'), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') in (
          select regexp_replace(lower(unnest(list_append(coalesce(known_spellings, []), canonical))), '[\s_\-]+', ' ', 'g') from canonical_values where field_name = 'state_operation' and canonical = 'remove'), change_id) as deleted
        from state_changes where subject is not null and path is not null group by all) where not coalesce(deleted, false)""",
    "session_pick": """select customer, session, n_attempts from (select o_custkey as customer, o_orderkey as session, coalesce(n, 0) as n_attempts, row_number() over (partition by o_custkey order by coalesce(n, 0) desc, o_orderdate desc, o_orderkey) as r
        from orders left join (select l_orderkey, count(*) as n from lineitem group by all) on l_orderkey = o_orderkey) where r = 1""",
    "content_digest": sql(SQL_MESSAGES, select="select chat_id, count(*) as n_messages, sum(('0x' || left(sha256(concat_ws(chr(31), message_index::varchar, role, name, text)), 13))::hugeint)::varchar as digest from lm group by all"),
}
