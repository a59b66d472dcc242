"""Queries on event-sourced state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.runtime import cut
from ..functions.vocabulary import COMMITMENT_TRANSITIONS as TRANSITIONS
from ..operators import state as S
from ..operators.changefeed import apply_changes, normal_path, operation_key
from ..sources import table
from .common import SQL_SEGMENTS, segments, sql



def changes(spark: SparkSession, d: str) -> DataFrame:
    """One row per (chat_id, change_seq) with its evidence and persistence: that of the highest revision."""
    t = table(spark, d, "state_changes")
    usable = t.select("chat_id", "change_seq", F.coalesce("revision", F.lit(-1)).alias("revision"), "subject", normal_path(F.col("path")).alias("path"), operation_key(F.coalesce("operation", F.lit(""))).alias("op"), "value", "evidence", "persistence")
    usable = usable.where("change_seq is not null and subject is not null and path is not null")
    best = F.max(F.struct("revision", "subject", "path", "op", "value", "evidence", "persistence")).alias("r")
    return usable.groupBy("chat_id", "change_seq").agg(best).select("chat_id", "change_seq", "r.*")


def preference_gate(spark: SparkSession, d: str) -> DataFrame:
    """The gate over the test's paths, three of whose roots stand in for gated ones."""
    roots = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", "^learnedAttributes", "preferences"), "^ongoingActivities", "possessions"), "^localThreads", "identity")
    return S.preference_gate(changes(spark, d).withColumn("path", roots)).select("chat_id", "change_seq", "subject", "path", "repeated", "accepted")


def world_facts(spark: SparkSession, d: str) -> DataFrame:
    return S.last_facts(table(spark, d, "temporal_marks"), "description", "kind", ["stated_at", "mark_id"])


def knowledge(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "relationship_changes").where("dimension is not null").select("chat_id", "rel_change_id", F.element_at("participants", 1).alias("holder"), F.col("dimension").alias("proposition"), F.col("value").alias("kind"), F.col("operation").alias("op"))
    return S.knowledge(rows, ["rel_change_id"])


def relationships(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "relationship_changes").select("chat_id", F.col("rel_change_id").alias("seq"), "participants", "dimension", F.col("operation").alias("op"), "value")
    return S.relationships(rows).select("chat_id", "pair", "dimension", F.array_join("values", ";", "-").alias("value_list"))


def _told(spark: SparkSession, d: str) -> DataFrame:
    """The rows of commitments that name a transition, with the id of the commitment they are about."""
    rows = table(spark, d, "commitments").where(F.col("transition").isin(*TRANSITIONS))
    return rows.select("chat_id", "segment_id", F.col("commitment_row_id").alias("seq"), "actor", "toward", "content", "transition", "evidence", S.commitment_id(F.col("actor"), F.col("toward"), F.col("content")).alias("id"))


def _commitments(spark: SparkSession, d: str, told: DataFrame | None = None) -> DataFrame:
    return S.commitments((_told(spark, d) if told is None else told).drop("segment_id"))


def commitments(spark: SparkSession, d: str) -> DataFrame:
    return _commitments(spark, d)


def threads(spark: SparkSession, d: str) -> DataFrame:
    v = F.regexp_replace("value", '"', "")
    rows = changes(spark, d).where(F.col("path").rlike(r"^localThreads\.[^.]+$") & F.col("value").isNotNull() & ~F.col("value").startswith("{"))
    step = F.when(v == "settled", "resolved").when(v == "disputed", "advanced").when(v == "rejected", "abandoned").otherwise("open")
    return S.threads(rows.select("chat_id", F.col("change_seq").alias("seq"), F.element_at(F.split("path", r"\."), 2).alias("key"), v.alias("description"), step.alias("transition")))


def salient_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Events as propositions that tell their reason themselves; minor ones don't matter to what follows."""
    rows = table(spark, d, "episode_events").select("chat_id", F.col("event_row_id").alias("seq"), F.col("description").alias("proposition"), F.col("description").alias("reason"), (F.col("salience") != "minor").alias("continuity_relevant"))
    return S.salient_negatives(rows)


def conflicts(spark: SparkSession, d: str) -> DataFrame:
    rows = changes(spark, d).where("evidence = 'explicit' and value is not null").where(~F.col("value").startswith("{"))
    return S.conflicts(rows.select("chat_id", F.col("change_seq").alias("seq"), "subject", F.col("path").alias("property"), "value", F.col("op").isin("revise", "update", "amend").alias("superseding")))


def segment_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return S.segment_ordinals(segments(spark, d))


def _touches(told: DataFrame) -> DataFrame:
    return told.select("chat_id", "segment_id", F.lit("commitment").alias("kind"), F.col("id").alias("key"))


def provenance(spark: SparkSession, d: str) -> DataFrame:
    """The latest segment that touched each commitment, relationship, character, thread, world fact and negative."""
    return _origins(spark, d, _negatives(spark, d), _told(spark, d), segment_ordinals(spark, d))


def _aged(spark: SparkSession, d: str, told: DataFrame | None = None, ordinals: DataFrame | None = None) -> DataFrame:
    told = _told(spark, d) if told is None else told
    ordinals = segment_ordinals(spark, d) if ordinals is None else ordinals
    return S.commitment_ageout(_commitments(spark, d, told), S.provenance(_touches(told), ordinals), ordinals, 8)


def commitment_ageout(spark: SparkSession, d: str) -> DataFrame:
    return _aged(spark, d).select("chat_id", "commitment_id", "status", "age_segments", "aged_out")


def _origins(spark: SparkSession, d: str, negatives: DataFrame, told: DataFrame, ordinals: DataFrame) -> DataFrame:
    """Provenance of the state items of all kinds."""
    bonds = table(spark, d, "relationship_changes").where("participants is not null and dimension is not null")
    moves = table(spark, d, "state_changes").where("subject is not null").withColumn("path", normal_path(F.col("path"))).where("path is not null")
    thread = F.col("path").rlike(r"^localThreads\.[^.]+$") & F.col("value").isNotNull() & ~F.col("value").startswith("{")
    touches = _touches(told)
    for kind, rows, key in (
        ("relationship", bonds, F.array_join(F.array_sort("participants"), "|")), ("character", bonds, F.explode("participants")), ("character", moves, F.col("subject")), ("character", told, F.col("actor")), ("character", told, F.col("toward")),
        ("thread", moves.where(thread), F.element_at(F.split("path", r"\."), 2)), ("world_fact", table(spark, d, "temporal_marks").where("description is not null"), F.col("description")), ("salient_negative", negatives, F.col("key")),
    ):
        touches = touches.unionByName(rows.select("chat_id", "segment_id", F.lit(kind).alias("kind"), key.alias("key")))
    return S.provenance(touches.where("key is not null"), ordinals)


def _characters(spark: SparkSession, d: str, aged: DataFrame) -> DataFrame:
    """chat_id, key, text: each character's live attributes, knowledge and commitments by path."""
    raw = table(spark, d, "state_changes")
    refused = S.preference_gate(changes(spark, d)).where("not accepted").select("chat_id", "change_seq")
    refused = cut(refused)  # met by every pass over the feed
    leaves = apply_changes(raw.join(refused, ["chat_id", "change_seq"], "left_anti"), table(spark, d, "canonical_values"), batches=1)  # as a step of a longer plan: no jobs of its own between batches
    plain = F.regexp_replace("value", '^"(.*)"$', "$1")
    rows = leaves.where(plain.isNotNull() & (plain != "")).select("chat_id", F.col("subject").alias("key"), F.concat_ws("=", "path", plain).alias("detail"))
    at = F.concat(F.lit("knowledge."), "dimension")
    known = table(spark, d, "relationship_changes").where("dimension is not null").select(
        "chat_id", "rel_change_id", F.element_at("participants", 1).alias("holder"), F.col("dimension").alias("proposition"), F.col("operation").alias("op"),
        F.concat_ws("; ", F.concat(at, F.lit(".kind="), F.regexp_replace("value", '^"(.*)"$', "$1")), F.concat(at, F.lit(".evidence="), "evidence")).alias("kind"),
    )
    known = S.knowledge(known, ["rel_change_id"]).where("kind <> ''")
    promises = aged.where("not aged_out").select("chat_id", F.col("actor").alias("key"), F.concat(F.lit("commitments."), "commitment_id", F.lit("="), "status").alias("detail"))
    rows = rows.unionByName(known.select("chat_id", F.col("holder").alias("key"), F.col("kind").alias("detail"))).unionByName(promises).where("key is not null")
    details = rows.groupBy("chat_id", "key").agg(F.array_join(F.array_sort(F.collect_list("detail")), "; ").alias("details"))
    return details.select("chat_id", "key", F.concat(F.lit("Character "), "key", F.lit(": "), "details").alias("text"))


def _negatives(spark: SparkSession, d: str, last: int = 6) -> DataFrame:
    """chat_id, key, text, segment_id: the last told of what did not happen."""
    order = Window.partitionBy("chat_id").orderBy(F.col("seq").desc())
    newest = salient_negatives(spark, d).withColumn("n", F.row_number().over(order)).where(F.col("n") <= last)
    found = newest.join(table(spark, d, "episode_events").select(F.col("event_row_id").alias("seq"), "segment_id"), "seq")
    return found.select("chat_id", S.proposition_key(F.col("proposition")).alias("key"), F.concat(F.lit("Did not happen: "), "proposition").alias("text"), "segment_id")


def state_projection(spark: SparkSession, d: str) -> DataFrame:
    """All state items of a chat, ranked. The tables hold no observations told by the narrator only, so of the kinds of `PRIORITY` narrator_fact has no rows."""
    told, ordinals = cut(_told(spark, d)), cut(segment_ordinals(spark, d))  # each used several times
    aged = cut(_aged(spark, d, told, ordinals))
    open_ones = aged.where(F.col("status").isin(*S.OPEN_COMMITMENTS) & ~F.col("aged_out"))
    text = F.concat(F.lit("Commitment ("), "status", F.lit("): "), "actor", F.coalesce(F.concat(F.lit(" to "), "toward"), F.lit("")), F.lit(" — "), "content")
    bonds = relationships(spark, d).groupBy("chat_id", F.col("pair").alias("key")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "dimension", "value_list"))), "; ").alias("dims"))
    negatives = cut(_negatives(spark, d))
    parts = {
        "commitment": open_ones.select("chat_id", F.col("commitment_id").alias("key"), text.alias("text")),
        "relationship": bonds.select("chat_id", "key", F.concat(F.lit("Relationship "), F.regexp_replace("key", r"\|", " ↔ "), F.lit(": "), "dims").alias("text")),
        "character": _characters(spark, d, aged),
        "thread": threads(spark, d).where("status not in ('resolved', 'abandoned')").select("chat_id", "key", F.concat(F.lit("Open thread ("), "status", F.lit("): "), "description").alias("text")),
        "world_fact": world_facts(spark, d).select("chat_id", F.col("fact").alias("key"), F.concat(F.lit("World fact: "), "fact").alias("text")),
        "salient_negative": negatives.select("chat_id", "key", "text"),
    }
    return S.state_items(parts, _origins(spark, d, negatives, told, ordinals)).select("chat_id", "kind", "key", "text", "priority", "place")


def checkpoints(spark: SparkSession, d: str) -> DataFrame:
    valid = segments(spark, d).where("status = 'valid' and synopsis is not null")
    rows = S.segment_ordinals(valid).join(valid.select("segment_id", "status", "updated_at"), "segment_id")
    digest = F.md5(F.concat_ws("|", "segment_id", "status", F.coalesce(F.date_format("updated_at", "yyyyMMddHHmmssSSSSSS"), F.lit(""))))
    return S.checkpoints(rows.withColumn("row_hash", F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")), 5)


def resume_points(spark: SparkSession, d: str) -> DataFrame:
    """Where replay may resume if every chat is to be replayed from its segment 12 on, with chats of odd length changed at their first segment."""
    now = checkpoints(spark, d)
    lasts = now.groupBy("chat_id").agg(F.max("frontier").alias("n"))
    kept = now.join(lasts, "chat_id").withColumn("prefix_fingerprint", F.col("prefix_fingerprint") + F.col("n") % 2).drop("n")
    return S.resume_point(kept, now, lasts.select("chat_id", F.lit(12).alias("start_ordinal")))


def delta_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per chat and family, the records of valid segments."""
    valid = segments(spark, d).where("status = 'valid'").select("segment_id")
    families = ("commitments", "relationship_changes", "temporal_marks", "episode_events", "state_changes", "entity_mentions")
    rows = None
    for f in families:
        part = table(spark, d, f).select("chat_id", "segment_id", F.lit(f).alias("family"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.join(valid, "segment_id", "left_semi").groupBy("chat_id", "family").agg(F.count("*").alias("n"))


_CHANGES = r"""
ch as (select * from (select chat_id, change_seq, coalesce(revision, -1) as revision, subject,
         nullif(array_to_string(list_filter(list_transform(string_split(path, '.'), lambda x: trim(x)), lambda x: x <> ''), '.'), '') as path,
         regexp_replace(regexp_replace(lower(coalesce(operation, '')), '[\s_\-]+', ' ', 'g'), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') as op, value, evidence, persistence from state_changes)
       where change_seq is not null and subject is not null and path is not null
       qualify row_number() over (partition by chat_id, change_seq order by revision desc, subject desc, path desc, op desc, value desc nulls last, evidence desc nulls last, persistence desc nulls last) = 1)"""
_FNV = "list_reduce(list_prepend(14695981039346656037::hugeint, list_transform(range(1, octet_length(encode({0})) + 1), lambda i: ('0x' || substr(hex(encode({0})), (2 * i - 1)::int, 2))::hugeint)), lambda h, b: (xor(h, b) * 1099511628211::hugeint) % 18446744073709551616::hugeint)"
_HEX = "lpad(lower(printf('%x', ({0} // 4294967296)::bigint)), 8, '0') || lpad(lower(printf('%x', ({0} % 4294967296)::bigint)), 8, '0')"
_PROMISE = "(coalesce(actor, '') || '|' || coalesce(toward, '') || '|' || coalesce(content, ''))"
_COMMITTED = f"""
cd as (select *, 'commit_' || {_HEX.format('h')} as commitment_id from (
  select *, {_FNV.format(_PROMISE)} as h from commitments where transition in ('made', 'active', 'kept', 'broken', 'released', 'obsolete', 'superseded', 'unknown')))"""
_COMMITMENTS = _COMMITTED + """,
cm as (select chat_id, commitment_id, actor, toward, content, case when lt = 'made' then 'active' else lt end as status, evidence, touches from (
  select chat_id, commitment_id, any_value(actor) as actor, any_value(toward) as toward, any_value(content) as content,
    arg_max(transition, commitment_row_id) as lt, arg_max_null(evidence, commitment_row_id) as evidence, count(*) as touches from cd group by chat_id, commitment_id))"""
_ORDINALS = """
ords as (select chat_id, segment_id, first_index, last_index, row_number() over (partition by chat_id order by first_index, segment_id) as ordinal from sg where chat_id is not null and first_index is not null)"""
_PROVENANCE = """
prov as (select chat_id, 'commitment' as kind, commitment_id as key, arg_max(segment_id, ordinal) as segment_id, max(ordinal) as ordinal, arg_max(last_index, ordinal) as last_index
         from cd join ords using (chat_id, segment_id) group by all)"""
_AGED = """
aged as (select c.*, case when p.ordinal is not null then greatest(0, n.newest - p.ordinal) end as age_segments, c.status in ('active', 'made', 'unknown') and coalesce(greatest(0, n.newest - p.ordinal) >= 8, false) and p.ordinal is not null as aged_out
  from cm c left join prov p on p.chat_id = c.chat_id and p.key = c.commitment_id left join (select chat_id, max(ordinal) as newest from ords group by all) n on n.chat_id = c.chat_id)"""
_RELATIONS = """
rel as (select chat_id, array_to_string(list_sort(participants), '|') as pair, dimension, rel_change_id as seq, operation as op, value from relationship_changes where participants is not null and dimension is not null),
rst as (select chat_id, pair, dimension, max(seq) filter (op <> 'add') as rs, arg_max_null(op, seq) filter (op <> 'add') as rop, arg_max_null(value, seq) filter (op <> 'add') as rv from rel group by all),
rels as (select * from (select rst.chat_id, rst.pair, rst.dimension,
    case when count(seq) filter (op = 'add' and (rs is null or seq > rs)) > 0 then string_agg(coalesce(value, '-'), ';' order by seq) filter (op = 'add' and (rs is null or seq > rs))
         when any_value(rop) <> 'remove' then coalesce(any_value(rv), '-') end as value_list
  from rel join rst using (chat_id, pair, dimension) group by all) where value_list is not null)"""
_THREADS = """
th as (select chat_id, key, arg_max(v, change_seq) as description, case arg_max(step, change_seq) when 'advanced' then 'active' else arg_max(step, change_seq) end as status from (
  select chat_id, change_seq, split_part(path, '.', 2) as key, replace(value, '"', '') as v,
    case replace(value, '"', '') when 'settled' then 'resolved' when 'disputed' then 'advanced' when 'rejected' then 'abandoned' else 'open' end as step
  from ch where regexp_matches(path, '^localThreads\\.[^.]+$') and value is not null and value not like '{%')
  where lower(key) not in ('love', 'life', 'drama', 'tension') and lower(v) not in ('love', 'life', 'drama', 'tension') group by all)"""
_NEGATIVE = r"""select *, trim(regexp_replace(lower(description), '\s+', ' ', 'g')) as key from episode_events
        where description is not null and coalesce(salience <> 'minor', true) and regexp_matches(description, '(?i)(attempt|explicit|refus|reject|did not|not occur|disqualif|without)')"""
_NEGATIVES = f"""
ngs as (select * from (select chat_id, key, min(event_row_id) as seq, arg_min(description, event_row_id) as proposition, arg_min(segment_id, event_row_id) as segment_id from ({_NEGATIVE}) group by all)
        qualify row_number() over (partition by chat_id order by seq desc) <= 6)"""
_CHARACTERS = rf"""
removals as (select distinct regexp_replace(lower(w), '[\s_\-]+', ' ', 'g') as op from (select unnest(list_append(coalesce(known_spellings, []), canonical)) as w from canonical_values where field_name = 'state_operation' and canonical = 'remove')),
gated as (select *, op in (select op from removals) as removal, coalesce(json_type(try_cast(value as json)) = 'OBJECT', false) as is_object from (
  select *, change_seq > min(change_seq) over (partition by chat_id, subject, path, value) as again from ch)
  where case split_part(path, '.', 1) when 'identity' then coalesce(evidence = 'explicit', false)
          when 'preferences' then coalesce(persistence = 'durable', false) and (coalesce(evidence = 'explicit', false) or (coalesce(evidence = 'strong_inference', false) and again))
          when 'possessions' then coalesce(persistence in ('durable', 'active'), false) and not coalesce(evidence = 'weak_inference', false) else true end),
opened as (
  select chat_id, subject, change_seq, path || '.' || k as path, value -> ('$."' || k || '"') as value from (select chat_id, subject, change_seq, path, value::json as value, unnest(json_keys(value::json)) as k from gated where is_object and not removal)
  union all
  select chat_id, subject, change_seq, path || '.' || k, value -> ('$."' || k || '"') from (select chat_id, subject, change_seq, path, value, unnest(json_keys(value)) as k from opened where json_type(value) = 'OBJECT')),
put as (select chat_id, subject, path, max(change_seq) as seq, arg_max_null(value, change_seq) as value from (
  select chat_id, subject, change_seq, path, value from gated where not is_object and not removal union all select chat_id, subject, change_seq, path, value::varchar from opened where json_type(value) <> 'OBJECT') group by all),
cleared as (select chat_id, subject, path, max(change_seq) as seq from gated where is_object or removal group by all),
leaves as (select chat_id, subject as key, path, regexp_replace(value, '^"(.*)"$', '\1', 's') as plain from put l where not exists (
  select 1 from cleared r where r.chat_id = l.chat_id and r.subject = l.subject and r.seq > l.seq and (r.path = l.path or starts_with(l.path, r.path || '.')))),
known as (select chat_id, participants[1] as key, arg_max_null(concat_ws('; ', 'knowledge.' || dimension || '.kind=' || regexp_replace(value, '^"(.*)"$', '\1'), 'knowledge.' || dimension || '.evidence=' || evidence), rel_change_id) as detail,
    arg_max_null(operation, rel_change_id) as op from relationship_changes where dimension is not null group by chat_id, participants[1], dimension),
details as (select chat_id, key, path || '=' || plain as detail from leaves where plain <> '' union all select chat_id, key, detail from known where op <> 'remove' and detail <> ''
  union all select chat_id, actor, 'commitments.' || commitment_id || '=' || status from aged where not aged_out)"""
_ITEM_ORIGINS = _NEGATIVES + r""",
moved as (select *, nullif(array_to_string(list_filter(list_transform(string_split(path, '.'), lambda x: trim(x)), lambda x: x <> ''), '.'), '') as way from state_changes where subject is not null),
touched as (
  select chat_id, segment_id, 'commitment' as kind, commitment_id as key from cd
  union all select chat_id, segment_id, 'relationship', array_to_string(list_sort(participants), '|') from relationship_changes where participants is not null and dimension is not null
  union all select chat_id, segment_id, 'character', unnest(participants) from relationship_changes where participants is not null and dimension is not null
  union all select chat_id, segment_id, 'character', subject from moved where way is not null
  union all select chat_id, segment_id, 'character', actor from cd union all select chat_id, segment_id, 'character', toward from cd
  union all select chat_id, segment_id, 'thread', split_part(way, '.', 2) from moved where regexp_matches(way, '^localThreads\.[^.]+$') and value is not null and value not like '{%'
  union all select chat_id, segment_id, 'world_fact', description from temporal_marks where description is not null
  union all select chat_id, segment_id, 'salient_negative', key from ngs),
origins as (select chat_id, kind, key, arg_max(segment_id, ordinal) as segment_id, arg_max(last_index, ordinal) as last_index, max(ordinal) as ordinal from touched join ords using (chat_id, segment_id) where key is not null group by all)"""
_FACTS = "wf as (select chat_id, description as fact, arg_max_null(kind, (coalesce(stated_at, timestamp '0001-01-01'), mark_id)) as value from temporal_marks where description is not null group by all)"

_CHECKPOINTS = """select chat_id, ordinal as frontier, segment_id, (s % 2305843009213693951)::bigint as prefix_fingerprint from (
        select *, sum((h * 8191 + ordinal * 131071) % 1099511627689) over (partition by chat_id order by ordinal) as s, max(ordinal) over (partition by chat_id) as last from (
          select chat_id, segment_id, row_number() over (partition by chat_id order by first_index, segment_id) as ordinal,
            ('0x' || left(md5(concat_ws('|', segment_id, status, coalesce(strftime(updated_at, '%Y%m%d%H%M%S%f'), ''))), 12))::bigint as h
          from sg where status = 'valid' and synopsis is not null)) where ordinal % 5 = 0 or ordinal = last"""

QUERIES = {f.__name__: f for f in (preference_gate, world_facts, knowledge, relationships, commitments, threads, salient_negatives, conflicts, segment_ordinals, provenance, commitment_ageout, state_projection, checkpoints, resume_points, delta_counts)}

SQL = {
    "preference_gate": sql(_CHANGES, select="""select chat_id, change_seq, subject, path, repeated, case split_part(path, '.', 1)
          when 'identity' then coalesce(evidence = 'explicit', false)
          when 'preferences' then coalesce(persistence = 'durable', false) and (coalesce(evidence = 'explicit', false) or (coalesce(evidence = 'strong_inference', false) and repeated))
          when 'possessions' then coalesce(persistence in ('durable', 'active'), false) and not coalesce(evidence = 'weak_inference', false) else true end as accepted
        from (select * replace (regexp_replace(regexp_replace(regexp_replace(path, '^learnedAttributes', 'preferences'), '^ongoingActivities', 'possessions'), '^localThreads', 'identity') as path),
          change_seq > min(change_seq) over (partition by chat_id, subject, path, value) as repeated from ch)"""),
    "world_facts": sql(_FACTS, select="select * from wf"),
    "knowledge": """select chat_id, holder, proposition, kind from (
        select chat_id, participants[1] as holder, dimension as proposition, arg_max_null(value, rel_change_id) as kind, arg_max_null(operation, rel_change_id) as op from relationship_changes where dimension is not null group by all) where op <> 'remove'""",
    "relationships": sql(_RELATIONS, select="select * from rels"),
    "commitments": sql(_COMMITMENTS, select="select * from cm"),
    "threads": sql(_CHANGES, _THREADS, select="select * from th"),
    "salient_negatives": f"select chat_id, min(event_row_id) as seq, arg_min(description, event_row_id) as proposition from ({_NEGATIVE}) group by chat_id, key",
    "conflicts": sql(_CHANGES, select="""select chat_id, subject, path as property, max(change_seq) as seq, arg_max(earlier, change_seq) as earlier, arg_max(value, change_seq) as later from (
        select *, lag(value) over (partition by chat_id, subject, path order by change_seq) as earlier from ch where evidence = 'explicit' and value is not null and value not like '{%')
        where earlier is not null and earlier <> value and op not in ('revise', 'update', 'amend') group by all"""),
    "segment_ordinals": sql(SQL_SEGMENTS, _ORDINALS, select="select * from ords"),
    "provenance": sql(SQL_SEGMENTS, _ORDINALS, _COMMITTED, _ITEM_ORIGINS, select="select chat_id, kind, key, segment_id, ordinal, last_index from origins"),
    "commitment_ageout": sql(SQL_SEGMENTS, _ORDINALS, _COMMITMENTS, _PROVENANCE, _AGED, select="select chat_id, commitment_id, status, age_segments, aged_out from aged"),
    "state_projection": sql(
        SQL_SEGMENTS, _ORDINALS, _COMMITMENTS, _PROVENANCE, _AGED, _RELATIONS, _CHANGES, _THREADS, _FACTS, _CHARACTERS, _ITEM_ORIGINS,
        select="""select chat_id, kind, key, text, priority, place::int as place from (
          select i.*, row_number() over (partition by i.chat_id order by priority desc, coalesce(p.last_index, -1) desc, coalesce(p.ordinal, -1) desc, 'state:' || i.kind || ':' || i.key) as place from (
            select chat_id, 'commitment' as kind, commitment_id as key, 'Commitment (' || status || '): ' || actor || coalesce(' to ' || toward, '') || ' — ' || content as text, 140 as priority from aged where status in ('active', 'made', 'unknown') and not aged_out
            union all select chat_id, 'relationship', pair, 'Relationship ' || replace(pair, '|', ' ↔ ') || ': ' || string_agg(dimension || '=' || value_list, '; ' order by dimension || '=' || value_list), 130 from rels group by chat_id, pair
            union all select chat_id, 'character', key, 'Character ' || key || ': ' || string_agg(detail, '; ' order by detail), 120 from details where key is not null group by chat_id, key
            union all select chat_id, 'thread', key, 'Open thread (' || status || '): ' || description, 110 from th where status not in ('resolved', 'abandoned')
            union all select chat_id, 'world_fact', fact, 'World fact: ' || fact, 100 from wf
            union all select chat_id, 'salient_negative', key, 'Did not happen: ' || proposition, 70 from ngs) i
          left join origins p on p.chat_id = i.chat_id and p.kind = i.kind and p.key = i.key)""",
    ),
    "checkpoints": sql(SQL_SEGMENTS, select=_CHECKPOINTS),
    "resume_points": sql(SQL_SEGMENTS, select=f"select chat_id, max(frontier) as frontier from (select *, max(frontier) over (partition by chat_id) as n from ({_CHECKPOINTS})) where n % 2 = 0 and frontier <= 12 group by all"),
    "delta_counts": sql(SQL_SEGMENTS, select="""select chat_id, family, count(*) as n from (
        select chat_id, segment_id, 'commitments' as family from commitments union all select chat_id, segment_id, 'relationship_changes' from relationship_changes union all select chat_id, segment_id, 'temporal_marks' from temporal_marks
        union all select chat_id, segment_id, 'episode_events' from episode_events union all select chat_id, segment_id, 'state_changes' from state_changes union all select chat_id, segment_id, 'entity_mentions' from entity_mentions)
        where segment_id in (select segment_id from sg where status = 'valid') group by all"""),
}
