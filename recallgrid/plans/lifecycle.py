"""Queries on folded logs, claims, recovery and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import accounting as A
from ..operators import extraction as X
from ..operators import lifecycle as L
from ..operators import registers as G
from ..operators import store as S
from ..sources import table
from ..sources.chatlog import from_envelopes, to_envelopes
from .common import SQL_SEGMENTS, segments, sql
from .parsing import _PARSED
from .parsing import SQL as PARSE_SQL
from .retrieval import _RESULTS, _ranked

FAMILIES = ("entity_mentions", "episode_events", "state_changes", "relationship_changes", "commitments", "temporal_marks")


def semantic_counts(spark: SparkSession, d: str) -> DataFrame:
    """Segments of the first prompt version may not stand for their source."""
    s = segments(spark, d).select("segment_id", "status", (F.col("prompt_version") > 1).alias("eligible"))
    return L.semantic_counts(s, {t: table(spark, d, t) for t in FAMILIES})


def local_recovery(spark: SparkSession, d: str) -> DataFrame:
    """Stored raw output of segments that aren't valid, read again under today's rules without a request."""
    t = table(spark, d, "segments").where("status <> 'valid'").select("segment_row_id", F.col("structured_trace.mode").alias("mode"), F.col("structured_trace.content").alias("content"))
    json_ = X.parse_structured(t.where("mode = 'structured'"), "segment_row_id", "content").select("segment_row_id", F.lit("structured").alias("mode"), "reason")
    tagged = X.tagged_outcome(t.where("mode = 'fallback'"), "segment_row_id", "content").select("segment_row_id", F.lit("fallback").alias("mode"), "reason")
    return json_.unionByName(tagged).withColumn("recovered", F.col("reason") == "ok")


def register_log(spark: SparkSession, d: str) -> DataFrame:
    r = _ranked(spark, d).where("position <= 3").select("register", (F.col("event") * 10 + F.col("position")).alias("at"), F.when(F.col("event") > 199400, "race").alias("type"), F.col("event").alias("segment"), "subject")
    return L.register_log(r).select("register", "type", "lifecycle", "policy", "observation_no", "segment", "subject")


def reduced_registers(spark: SparkSession, d: str) -> DataFrame:
    """Registers of a type of one's own, folded by its reducer: the winner of most of a region's months."""

    def most_wins(rows):
        wins = rows.groupby("subject").size()
        return sorted(wins[wins == wins.max()].index)[0]

    G.register_reducer("wins")(most_wins)
    r = _ranked(spark, d).where("position = 1").select("register", F.when(F.col("register") == "ASIA", "unknown").otherwise("wins").alias("type"), F.col("event").alias("seq"), "subject")
    return G.reduce_registers(r)


def relevant_registers(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_name").alias("key"), F.when(F.col("n_regionkey") == 1, "united league").otherwise("other").alias("type"))
    return G.relevant_registers(n, F.array(F.lit("united"), F.lit("germany"), F.lit("iran")))


def chat_preferences(spark: SparkSession, d: str) -> DataFrame:
    """State changes as patches of settings named by the first part of their path."""
    t = table(spark, d, "state_changes").where("chat_id is not null and path is not null")
    return L.fold_preferences(t.select("chat_id", F.col("change_id").alias("seq"), F.lower(F.trim(F.element_at(F.split("path", r"\."), 1))).alias("key"), "value"))


def chat_revisions(spark: SparkSession, d: str) -> DataFrame:
    return L.revisions(table(spark, d, "segments").where("chat_id is not null").select("chat_id", F.col("segment_row_id").alias("seq"), F.col("ingested_at").alias("at")))


def replaced_chats(spark: SparkSession, d: str) -> DataFrame:
    """Chats with a segment of the newest prompt version brought in anew, with those segments only."""
    columns = ("chat_id", "segment_row_id", "status")
    t = table(spark, d, "segments").where("chat_id is not null")
    return L.replace_chats(t.select(*columns), t.where("prompt_version = 3 and status = 'valid'").select(*columns))


def profile_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Orders as edits of profiles: one profile a customer, settings by turns, orders in part removing the profile."""
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(
        F.when(F.col("o_custkey") % 2 == 0, "characters").otherwise("chats").alias("scope"), F.col("o_custkey").cast("string").alias("id"), k.alias("seq"), F.when(F.col("o_orderstatus") == "P", "remove").otherwise("upsert").alias("op"),
        F.element_at(F.array(F.lit("temperature"), F.lit("top_p"), F.lit("max_tokens")), (k % 3 + 1).cast("int")).alias("key"), (k % 25 / 10).cast("string").alias("value"),
    )
    return L.profile_catalog(o, lambda key, value: (value.try_cast("double") <= F.when(key == "top_p", A.UPPER_BOUNDS["top_p"]).when(key == "temperature", A.UPPER_BOUNDS["temperature"]).otherwise(1e9)))


def single_flight(spark: SparkSession, d: str) -> DataFrame:
    """Segments as jobs on their chat, from their creation to their last update."""
    t = table(spark, d, "segments").where("chat_id is not null and created_at is not null")
    return L.single_flight(t.select("chat_id", F.col("segment_row_id").alias("job_id"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("begun"), F.unix_micros(F.col("updated_at").cast("timestamp")).alias("ended")))


def generation_source(spark: SparkSession, d: str) -> DataFrame:
    """Requests for segments, answered by turns live, from records or not at all; recorded is what was stored for the same range."""
    fp = F.md5(F.concat_ws("|", "chat_id", F.col("first_index").cast("string"), F.col("last_index").cast("string")))
    t = table(spark, d, "segments").where("chat_id is not null")
    mode = F.element_at(F.array(F.lit("live"), F.lit("replay"), F.lit("offline")), (F.col("segment_row_id") % 3 + 1).cast("int"))
    recorded = t.where("structured_trace.content is not null and segment_row_id % 4 > 0").select(fp.alias("fingerprint"), F.col("segment_row_id").alias("attempt"), F.md5("structured_trace.content").alias("response"))
    return L.generation_source(t.select(F.col("segment_row_id").alias("request_id"), mode.alias("mode"), fp.alias("fingerprint")), recorded).select("request_id", "mode", "source", "response")


def _letters(texts: list[str]) -> list[list[float]]:
    """A stand-in for a model: how long a text is and how many letters e it holds; it refuses texts without any."""
    if any("e" not in x for x in texts):
        raise ValueError("nothing to embed")
    return [[float(len(x)), float(x.count("e"))] for x in texts]


def embedding_cache(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.md5("text").alias("fingerprint"), "text")
    cache = t.where("doc_id % 3 = 0 and fingerprint is not null").select("fingerprint", F.array(F.lit(-1.0), F.lit(0.0)).alias("embedding"))
    return L.embed_with_cache(t, cache, _letters, ["doc_id"]).select("doc_id", "source", F.get("embedding", F.lit(0)).alias("first"), F.get("embedding", F.lit(1)).alias("second"))


def envelope_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Stored segments written to envelopes of 20 and read back."""
    good, _ = from_envelopes(to_envelopes(segments(spark, d), 20))
    return good.select("chat_id", "segment_id", "first_index", "last_index", "status", F.md5("synopsis").alias("synopsis"), "pinned", "manually_edited")


def private_events(spark: SparkSession, d: str) -> DataFrame:
    """Metrics with a key of story text are held back: state values under the name of their path's last part."""
    t = table(spark, d, "state_changes")
    json_ = F.to_json(F.struct(F.element_at(F.split("path", r"\."), -1).alias("op"), F.when(F.col("change_id") % 5 == 0, F.col("value")).alias("content"), F.col("revision").alias("n")))
    return A.privacy_guard(t.select("change_id", json_.alias("j")), "j").groupBy("allowed").agg(F.count("*").alias("n"))


def latest_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Segment rows as records under session, segment and attempt; the last attempt of each counts."""
    t = table(spark, d, "segments").where("chat_id is not null and segment_id is not null")
    return S.latest_by_prefix(t.select(F.concat_ws(":", F.when(F.col("prompt_version") == 3, "run").otherwise("old"), "chat_id", "segment_id", F.col("segment_row_id").cast("string")).alias("key"), F.col("status").alias("value")), "run")


QUERIES = {f.__name__: f for f in (semantic_counts, local_recovery, register_log, reduced_registers, relevant_registers, chat_preferences, chat_revisions, replaced_chats, profile_catalog, single_flight, generation_source, embedding_cache, envelope_round_trip, private_events, latest_attempts)}

SQL = {
    "semantic_counts": sql(SQL_SEGMENTS, select="select family, count(*) as n from (" + " union all ".join(f"select '{t}' as family, segment_id from {t}" for t in FAMILIES) + ") where segment_id in (select segment_id from sg where status = 'valid' and coalesce(prompt_version > 1, true)) group by all"),
    "local_recovery": sql(_PARSED, f"tagged as ({PARSE_SQL['tagged_outcome']})", select="""select segment_row_id, mode, reason, reason = 'ok' as recovered from (
        select segment_row_id, 'structured' as mode, reason from ps union all select segment_row_id, 'fallback', reason from tagged) where segment_row_id in (select segment_row_id from segments where status <> 'valid')"""),
    "register_log": sql(_RESULTS, select="""select register, first_value(case when event > 199400 then 'race' else 'generic' end) over (partition by register order by event, position) as type, 'active' as lifecycle, 'relevant' as policy,
        row_number() over (partition by register order by event, position) as observation_no, event as segment, subject from rk where position <= 3"""),
    "reduced_registers": sql(_RESULTS, select="""select register, case when register = 'ASIA' then 'unknown' else 'wins' end as type, case when register <> 'ASIA' then subject end as state from (
        select *, row_number() over (partition by register order by wins desc, subject) as n from (select register, subject, count(*) as wins from rk where position = 1 group by register, subject)) where n = 1"""),
    "relevant_registers": """select * from (select n_name as key, case when n_regionkey = 1 then 'united league' else 'other' end as type from nation)
        where len(list_intersect(list_concat(string_split(lower(key), ' '), string_split(type, ' ')), ['united', 'germany', 'iran'])) > 0""",
    "chat_preferences": "select chat_id, lower(trim(split_part(path, '.', 1))) as key, arg_max_null(value, change_id) as value from state_changes where chat_id is not null and path is not null group by chat_id, lower(trim(split_part(path, '.', 1)))",
    "chat_revisions": "select chat_id, count(distinct segment_row_id) as revision, max(ingested_at) as updated from segments where chat_id is not null group by chat_id",
    "replaced_chats": """select chat_id, segment_row_id, status from segments s where chat_id is not null and (coalesce(prompt_version = 3 and status = 'valid', false)
        or not exists (select 1 from segments i where i.chat_id = s.chat_id and i.prompt_version = 3 and i.status = 'valid'))""",
    "profile_catalog": """select scope, id, key, value from (
        select *, row_number() over (partition by scope, id, key order by seq desc) as n from (
          select case when o_custkey % 2 = 0 then 'characters' else 'chats' end as scope, o_custkey::varchar as id, o_orderkey as seq, ['temperature', 'top_p', 'max_tokens'][o_orderkey % 3 + 1] as key, (o_orderkey % 25 / 10)::varchar as value,
            o_orderkey % 25 / 10 as x, max(o_orderkey) filter (o_orderstatus = 'P') over (partition by o_custkey) as reset, o_orderstatus from orders)
        where o_orderstatus <> 'P' and (reset is null or seq > reset) and x <= case key when 'top_p' then 1 when 'temperature' then 2 else 1e9 end) where n = 1""",
    "single_flight": sql(
        "jb as (select chat_id, segment_row_id as job_id, created_at as begun, updated_at as ended, row_number() over (partition by chat_id order by created_at, segment_row_id) as i from segments where chat_id is not null and created_at is not null)",
        """fl as (select distinct chat_id, 0::bigint as i, null::bigint as job_id, null::timestamp as until, true as free, false as granted from jb
          union all select chat_id, i, job_id, case when g then ended else until end, free and not g, g from (
            select j.chat_id, j.i, j.job_id, j.ended, f.until, f.free, f.free or coalesce(j.begun >= f.until, false) as g from fl f join jb j on j.chat_id = f.chat_id and j.i = f.i + 1))""",
        select="select chat_id, job_id, granted from fl where i > 0",
    ),
    "generation_source": sql(
        "rq as (select segment_row_id as request_id, ['live', 'replay', 'offline'][segment_row_id % 3 + 1] as mode, concat_ws('|', chat_id, first_index::varchar, last_index::varchar) as f, structured_trace.content as c from segments where chat_id is not null)",
        "kn as (select f, arg_max(md5(c), request_id) as response from rq where c is not null and request_id % 4 > 0 group by f)",
        select="""select request_id, mode, case when mode = 'live' then 'provider' when mode = 'replay' and kn.f is not null then 'record' when mode = 'replay' then 'replay_missing' else 'unavailable' end as source,
          case when mode = 'replay' then response end as response from rq left join kn using (f)""",
    ),
    "embedding_cache": """select doc_id, case when hit then 'cache' when coalesce(contains(text, 'e'), false) then 'model' else 'failed' end as source, case when hit then -1.0::double when contains(text, 'e') then length(text)::double end as first,
        case when hit then 0.0::double when contains(text, 'e') then (length(text) - length(replace(text, 'e', '')))::double end as second
        from (select *, coalesce(text in (select text from documents where doc_id % 3 = 0 and text is not null), false) as hit from documents)""",
    "envelope_round_trip": sql(SQL_SEGMENTS, select="select chat_id, segment_id, first_index, last_index, status, md5(synopsis) as synopsis, pinned, manually_edited from sg where chat_id is not null and first_index is not null"),
    "private_events": "select not (change_id % 5 = 0 and value is not null) as allowed, count(*) as n from state_changes group by all",
    "latest_attempts": "select chat_id as session, segment_id as segment, max(segment_row_id)::int as attempt, arg_max(status, segment_row_id) as value from segments where chat_id is not null and segment_id is not null and prompt_version = 3 group by all",
}
