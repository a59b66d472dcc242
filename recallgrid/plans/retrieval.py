"""Queries on registers and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import search_tokens
from ..functions.runtime import cut
from ..functions.vocabulary import STOP_WORDS
from ..operators import registers as G
from ..operators import retrieval as R
from ..operators.state import commitment_id
from ..sources import table
from .common import SQL_SEGMENTS, segments, sql
from .state import _FNV, _HEX, _PROMISE

TOP = 5


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of each region by the month's revenue: the line items as race results."""
    li, su, na, re = (table(spark, d, t) for t in ("lineitem", "supplier", "nation", "region"))
    line = li.join(su.select(F.col("s_suppkey").alias("l_suppkey"), "s_name", F.col("s_nationkey").alias("n_nationkey")), "l_suppkey").join(na, "n_nationkey").join(re, na.n_regionkey == re.r_regionkey)
    month = F.date_format("l_shipdate", "yyyyMM").cast("bigint")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint") * F.round((1 - F.col("l_discount")) * 100).cast("bigint")
    sums = line.groupBy(F.col("r_name").alias("register"), month.alias("event"), F.col("s_name").alias("subject")).agg(F.sum(cents).alias("revenue"))
    return sums


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("register", "event").orderBy(F.col("revenue").desc(), "subject")
    return _results(spark, d).withColumn("position", F.row_number().over(order)).withColumn("seq", F.lit(1).cast("bigint"))


def standings(spark: SparkSession, d: str) -> DataFrame:
    r = _ranked(spark, d)
    late = r.where("position = 1 and event % 5 = 0").select("register", "event", "subject", F.lit(4).alias("position"), F.lit(2).cast("bigint").alias("seq"))
    shots = r.where("event = 199403 and position <= 2").select("register", "subject", F.lit(47).alias("points"), F.lit(False).alias("complete"), F.lit(9).cast("bigint").alias("seq"))
    return G.standings(r, late, shots)


def tournaments(spark: SparkSession, d: str) -> DataFrame:
    r = _ranked(spark, d).where("position = 1")
    last = r.groupBy("register").agg(F.max("event").alias("last"))
    m = r.join(last, "register").select("register", F.col("event").alias("match"), F.col("subject").alias("winner"), F.when(F.col("event") == F.col("last"), "final").otherwise("heat").alias("round"), (F.col("register") != "ASIA").alias("complete"), "seq")
    return G.tournaments(m)


def register_text(spark: SparkSession, d: str) -> DataFrame:
    r = _ranked(spark, d).where("position = 1")
    return G.register_text(r.select("register", F.col("event").alias("seq"), F.concat(F.col("event").cast("string"), F.lit(": "), "subject").alias("line")))


def injected_registers(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    lifecycle = F.when(F.col("n_nationkey") % 3 == 0, "archived").otherwise("active")
    policy = F.element_at(F.array(F.lit("always"), F.lit("relevant"), F.lit("manual"), F.lit("archived")), F.col("n_nationkey") % 4 + 1)
    regs = n.select(F.col("n_name").alias("key"), lifecycle.alias("lifecycle"), policy.alias("policy"), "n_regionkey")
    return G.injected_registers(regs.select("key", "lifecycle", "policy"), regs.where("n_regionkey = 1").select("key"), regs.where("n_regionkey = 2").select("key"))


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).where("status = 'valid'")
    return s.select(F.col("segment_row_id").alias("doc_id"), F.col("synopsis").alias("text"), "chat_id", "segment_id", "last_index")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d).where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text", "chat_id")


def lexical_postings(spark: SparkSession, d: str) -> DataFrame:
    return R.postings(_corpus(spark, d))


def query_terms(spark: SparkSession, d: str) -> DataFrame:
    return R.query_terms(_queries(spark, d))


def _bm25(spark: SparkSession, d: str, within: str) -> DataFrame:
    """BM25 of the queries' words, over the documents of the query's group."""
    c = _corpus(spark, d)
    index, terms = cut(R.postings(c)), query_terms(spark, d)  # the index is written once: counted, and met by the queries' terms
    index = index.join(c.select("doc_id", within), "doc_id")
    terms = terms.join(c.select(F.col("doc_id").alias("query_id"), within), "query_id")
    return R.bm25(index, R.document_stats(c), terms, within)


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d).select("doc_id", F.array_join(search_tokens(F.coalesce("text", F.lit(""))), " ").alias("text"))
    c = cut(c)  # the current rows are found and their texts split into words once
    words = c.select("doc_id", F.when(c["text"] != "", F.split("text", " ")).otherwise(F.array().cast("array<string>")).alias("words"))
    terms = R.query_terms(c.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text"))
    return R.bm25_top_k(words, terms, TOP).select("query_id", "doc_id", F.round("score", 6).alias("score"), "matched", "place")


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = e.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    return R.cosine_top_k(e, q, TOP).select("query_id", "doc_id", F.round("score", 6).alias("score"), "place")


def _found_by(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """What segments are found by besides their words, by kind: segment_id, key."""
    return {
        "entity": table(spark, d, "entity_mentions").select("segment_id", F.col("proposed_entity_id").alias("key")),
        "commitment": table(spark, d, "commitments").select("segment_id", commitment_id(F.col("actor"), F.col("toward"), F.col("content")).alias("key")),
        "relationship": table(spark, d, "relationship_changes").where("participants is not null").select("segment_id", F.array_join(F.array_sort("participants"), "|").alias("key")),
        "thread": table(spark, d, "state_changes").where(F.col("path").startswith("localThreads.")).select("segment_id", F.element_at(F.split("path", r"\."), 2).alias("key")),
        "temporal": table(spark, d, "temporal_marks").select("segment_id", F.lower("description").alias("key")),
    }


def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    """The other segments of the query's chat, by words, vectors and what both are about.

    Boosts: entities, threads and commitments of the query's segment, and those who took part in its events. A segment has the vector whose id is its row id, if there is one.
    """
    c, families = _corpus(spark, d), _found_by(spark, d)
    keys = cut(R.keys_of_documents(c, {k: families[k] for k in ("entity", "thread", "commitment")}).join(c.select("doc_id", "chat_id"), "doc_id"))
    q = _queries(spark, d).select("query_id", "chat_id")
    asked = keys.join(q.select(F.col("query_id").alias("doc_id")), "doc_id", "left_semi").withColumnRenamed("doc_id", "query_id")
    took_part = table(spark, d, "episode_events").select("segment_id", F.explode("participants").alias("key"))
    present = R.keys_of_documents(c, {"participant": took_part}).join(q.select(F.col("query_id").alias("doc_id"), "chat_id"), "doc_id").withColumnRenamed("doc_id", "query_id")
    boosts = R.key_boosts(keys, asked.unionByName(present), within="chat_id")
    vectors = c.select("doc_id", "chat_id").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    semantic = R.cosine_within(vectors, vectors.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"), "chat_id")
    out = R.hybrid_top_k(c.select("doc_id", "chat_id", "last_index"), q, _bm25(spark, d, "chat_id"), semantic, boosts, 8)
    return out.select("query_id", "doc_id", F.round("lexical", 6).alias("lexical"), F.round("semantic", 6).alias("semantic"), "boost", F.round("recency", 6).alias("recency"), F.round("score", 6).alias("score"), "place")


def retrieval_quality(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0")
    same = q.select(F.col("vec_id").alias("query_id"), "label").join(e.select(F.col("vec_id").alias("doc_id"), "label"), "label").where("query_id <> doc_id").select("query_id", "doc_id")
    out = R.retrieval_quality(cosine_topk(spark, d), same, q.select(F.col("vec_id").alias("query_id")), TOP)
    return out.select("k", "n_queries", F.round("recall_at_k", 6).alias("recall_at_k"), F.round("precision_at_k", 6).alias("precision_at_k"), F.round("mrr", 6).alias("mrr"))


def document_keys(spark: SparkSession, d: str) -> DataFrame:
    """Lookup by entity, commitment, relationship, thread and time: how many documents hold each key."""
    return R.keys_of_documents(_corpus(spark, d), _found_by(spark, d)).groupBy("kind", "key").agg(F.count("*").alias("n_documents"))


_RESULTS = """
rk as (select *, row_number() over (partition by register, event order by revenue desc, subject) as position from (
  select r_name as register, strftime(l_shipdate, '%Y%m')::bigint as event, s_name as subject, sum(round(l_extendedprice * 100)::bigint * round((1 - l_discount) * 100)::bigint)::bigint as revenue
  from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey group by all))"""
_POINTS = "case position when 1 then 10 when 2 then 8 when 3 then 6 when 4 then 5 when 5 then 4 when 6 then 3 when 7 then 2 when 8 then 1 else 0 end"
_WORDS = "list_filter(string_split(trim(regexp_replace(strip_accents(lower(coalesce(text, ''))), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) > 1)"
_CORPUS = f"""
co as (select segment_row_id as doc_id, synopsis as text, chat_id, segment_id, last_index from sg where status = 'valid'),
cw as (select *, {_WORDS} as words from co),
post as (select doc_id, term, count(*) as tf from (select doc_id, unnest(words) as term from cw) group by all)"""
_TERMS = f"""
qt as (select query_id, term, place from (select *, row_number() over (partition by query_id order by n desc, term) as place from (
  select doc_id as query_id, term, tf as n from post where doc_id % 50 = 0 and term not in ({', '.join(repr(w) for w in STOP_WORDS)}))) where place <= 32)"""
_BM25 = """
st as (select doc_id, len(words) as length from cw),
tot as (select count(*) as n, greatest(1.0, avg(length)) as al from st),
idf as (select term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) as w from post, tot group by term, n),
bm as (select query_id, doc_id, sum(w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / al))) as score, count(*) as matched
       from qt join idf using (term) join post using (term) join st using (doc_id), tot group by all)"""
_COSINE = f"""
cs as (select query_id, doc_id, round(score, 6) as score, place from (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as place from (
  select q.vec_id as query_id, e.vec_id as doc_id, list_cosine_similarity(q.embedding::double[], e.embedding::double[]) as score from embeddings q, embeddings e where q.vec_id % 50 = 0 and e.vec_id <> q.vec_id) where score > 0) where place <= {TOP})"""
_KEYS = "ek as (select distinct doc_id, 'entity' as kind, proposed_entity_id as key from entity_mentions join co using (segment_id) where proposed_entity_id is not null)"

QUERIES = {f.__name__: f for f in (standings, tournaments, register_text, injected_registers, lexical_postings, query_terms, bm25_topk, cosine_topk, hybrid_topk, retrieval_quality, document_keys)}

SQL = {
    "standings": sql(_RESULTS, select=f"""select register, subject, points, row_number() over (partition by register order by points desc, subject)::int as place from (
        select register, subject, coalesce(s.points, p.points)::bigint as points from (
          select register, subject, sum({_POINTS}) as points from (select register, event, subject, case when position = 1 and event % 5 = 0 then 4 else position end as position from rk) group by all) p
        full join (select register, subject, 47 as points from rk where event = 199403 and position <= 2) s using (register, subject))"""),
    "tournaments": sql(_RESULTS, select="""select register, count(*) as n_matches, max(case when register <> 'ASIA' and event = last then subject end) as champion, register = 'ASIA' as final_pending
        from (select *, max(event) over (partition by register) as last from rk where position = 1) group by all"""),
    "register_text": sql(_RESULTS, select="""select register, string_agg(event::varchar || ': ' || subject, chr(10) order by event) filter (n <= 5) as text, count(*) as n_observations
        from (select *, row_number() over (partition by register order by event desc) as n from rk where position = 1) group by all"""),
    "injected_registers": """select key, lifecycle, policy from (select n_name as key, case when n_nationkey % 3 = 0 then 'archived' else 'active' end as lifecycle, ['always', 'relevant', 'manual', 'archived'][n_nationkey % 4 + 1] as policy, n_regionkey = 1 as m, n_regionkey = 2 as r from nation)
        where case when lifecycle = 'archived' then policy = 'archived' and (m or r) when policy = 'always' then true when policy = 'manual' then m when policy = 'relevant' then r else false end""",
    "lexical_postings": sql(SQL_SEGMENTS, _CORPUS, select="select * from post"),
    "query_terms": sql(SQL_SEGMENTS, _CORPUS, _TERMS, select="select query_id, term, place::int as place from qt"),
    "bm25_topk": sql(SQL_SEGMENTS, _CORPUS, _TERMS, _BM25, select=f"select query_id, doc_id, round(score, 6) as score, matched, place::int as place from (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as place from bm) where place <= {TOP}"),
    "cosine_topk": sql(_COSINE, select="select query_id, doc_id, score, place::int as place from cs"),
    "hybrid_topk": sql(
        SQL_SEGMENTS, _CORPUS, _TERMS, _BM25,
        f"""dk as (select doc_id, kind, key from (
          select segment_id, 'entity' as kind, proposed_entity_id as key from entity_mentions union select segment_id, 'commitment', 'commit_' || {_HEX.format('h')} from (select *, {_FNV.format(_PROMISE)} as h from commitments)
          union select segment_id, 'thread', split_part(path, '.', 2) from state_changes where path like 'localThreads.%') join co using (segment_id) where key is not null),
        pk as (select distinct doc_id, key from (select segment_id, unnest(participants) as key from episode_events) join co using (segment_id) where key is not null)""",
        select="""select query_id, doc_id, round(lexical, 6) as lexical, round(semantic, 6) as semantic, boost, round(recency, 6) as recency, round(score, 6) as score, place::int as place from (
          select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as place from (
            select *, lexical + 0.75::double * semantic + boost + 0.15::double * recency as score from (
              select c.query_id, c.doc_id, coalesce(bm.score, 0) as lexical, greatest(0, coalesce(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 0)) as semantic,
                (coalesce(k.boost, 0) + coalesce(p.boost, 0))::double as boost, 1 / (1 + (max(c.last_index) over (partition by c.query_id) - c.last_index) / 200) as recency
              from (select q.doc_id as query_id, e.doc_id, e.last_index from co q join co e on e.chat_id = q.chat_id and e.doc_id <> q.doc_id where q.doc_id % 50 = 0) c
              left join bm using (query_id, doc_id) left join embeddings a on a.vec_id = c.query_id left join embeddings b on b.vec_id = c.doc_id
              left join (select a.doc_id as query_id, b.doc_id, sum(case when kind = 'entity' then 1.5::double else 2 end) as boost from dk a join dk b using (kind, key) where a.doc_id % 50 = 0 group by all) k using (query_id, doc_id)
              left join (select a.doc_id as query_id, b.doc_id, count(*) * 0.5::double as boost from pk a join dk b using (key) where b.kind = 'entity' and a.doc_id % 50 = 0 group by all) p using (query_id, doc_id))
            where lexical + semantic + boost > 0)) where place <= 8""",
    ),
    "retrieval_quality": sql(_COSINE, select=f"""select {TOP} as k, count(*) as n_queries, round(avg(case when expected > 0 then hits / expected else 1 end), 6) as recall_at_k, round(avg(case when returned > 0 then hits / returned else 0 end), 6) as precision_at_k, round(avg(coalesce(1 / first, 0)), 6) as mrr from (
        select q.vec_id, (select count(*) from embeddings e where e.label = q.label and e.vec_id <> q.vec_id) as expected, count(cs.doc_id) as returned, count(cs.doc_id) filter (e.label = q.label) as hits, min(place) filter (e.label = q.label) as first
        from embeddings q left join cs on cs.query_id = q.vec_id left join embeddings e on e.vec_id = cs.doc_id where q.vec_id % 50 = 0 group by q.vec_id, q.label)"""),
    "document_keys": sql(SQL_SEGMENTS, _CORPUS, select=f"""select kind, key, count(*) as n_documents from (
        select segment_id, 'entity' as kind, proposed_entity_id as key from entity_mentions union select segment_id, 'commitment', 'commit_' || {_HEX.format('h')} from (select *, {_FNV.format(_PROMISE)} as h from commitments)
        union select segment_id, 'relationship', array_to_string(list_sort(participants), '|') from relationship_changes where participants is not null union select segment_id, 'thread', split_part(path, '.', 2) from state_changes where path like 'localThreads.%'
        union select segment_id, 'temporal', lower(description) from temporal_marks) join co using (segment_id) where key is not null group by all"""),
}
