"""Entities: proposals for mentions, alias registries, participants and speakers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import entity_id, normalize_alias


def mention_ids(mentions: DataFrame) -> DataFrame:
    """mention_id, name (normal form) and the deterministic id a new entity of that name would get in its chat; mentions without a letter or digit have none."""
    name = normalize_alias(F.col("mention"))
    seed = F.concat(F.lit("chat:"), F.col("chat_id"), F.lit(":mention:"), F.col("name"))
    return mentions.select("mention_id", "chat_id", name.alias("name")).where("name <> ''").select("mention_id", "name", entity_id(seed).alias("entity_id"))


def alias_registry(mentions: DataFrame) -> DataFrame:
    """chat_id, entity_id, alias, n_segments, confirmed: every normal form under which an entity was mentioned or said to be known.

    mentions: chat_id, entity_id, mention, aliases, segment_id, kind. A form counts as confirmed once a mention of a told kind carries it itself.
    """
    own = mentions.select("chat_id", "entity_id", "segment_id", normalize_alias(F.col("mention")).alias("alias"), F.coalesce(F.col("kind") != "unknown", F.lit(False)).alias("c"))
    other = mentions.select("chat_id", "entity_id", "segment_id", F.explode("aliases").alias("a")).select("chat_id", "entity_id", "segment_id", normalize_alias(F.col("a")).alias("alias"), F.lit(False).alias("c"))
    rows = own.unionByName(other).where("entity_id is not null and alias <> ''")
    return rows.groupBy("chat_id", "entity_id", "alias").agg(F.count_distinct("segment_id").alias("n_segments"), F.max("c").alias("confirmed"))


def materialize_entities(mentions: DataFrame) -> DataFrame:
    """chat_id, entity_id, canonical_name (the first mention), kind (the last told), n_mentions."""
    rows = mentions.where("entity_id is not null and mention is not null")
    return rows.groupBy("chat_id", "entity_id").agg(F.min_by("mention", "mention_id").alias("canonical_name"), F.max_by("kind", F.when(F.col("kind").isNotNull(), F.col("mention_id"))).alias("kind"), F.count("*").alias("n_mentions"))


def propose(queries: DataFrame, registry: DataFrame) -> DataFrame:
    """mention_id, proposed_entity_id, confidence, best_score, requires_confirmation for mentions against all entities of their chat.

    queries: mention_id, chat_id, name, sender_id; registry: chat_id, entity_id, alias, sender_id. Score of an entity: 1 for the same
    form, else 0.7 of the words shared (over the longer form), best over its forms; 0.2 for the same chat; 0.5 for the same sender. Proposed if at least 0.8, or 0.5 in the same chat, and 0.15 ahead of the next.
    Only entities with a shared word are paired, by an equi-join. The others score 0.7 (same sender) or 0.2, so their numbers suffice: one count per chat and
    sender and one per chat. Which of several equal ones is best makes no difference, as such a mention is ambiguous.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda x: x != ""))
    q = queries.where("name <> ''").select("mention_id", "chat_id", "name", F.col("sender_id").alias("q_sender"), words(F.col("name")).alias("q_words"))
    r = registry.select("chat_id", "entity_id", "alias", F.col("sender_id").alias("r_sender"), words(F.col("alias")).alias("r_words"))
    pairs = q.withColumn("w", F.explode("q_words")).join(r.withColumn("w", F.explode("r_words")), ["chat_id", "w"]).drop("w").distinct()
    overlap = F.size(F.array_intersect("q_words", "r_words")) / F.greatest(F.size("q_words"), F.size("r_words"))
    exact = F.col("name") == F.col("alias")
    per = pairs.groupBy("mention_id", "entity_id").agg(F.max(F.when(exact, 1.0).otherwise(overlap * 0.7)).alias("s"), F.max(exact).alias("exact"), F.max(F.coalesce(F.col("q_sender") == F.col("r_sender"), F.lit(False))).alias("sender"))
    scored = per.withColumn("score", F.round(F.col("s") + 0.2 + F.when(F.col("sender"), 0.5).otherwise(0.0), 9))
    whole = Window.partitionBy("mention_id")
    order = whole.orderBy(F.col("score").desc(), "entity_id")
    met = scored.select(
        "mention_id", "entity_id", "exact", "score", F.row_number().over(order).alias("n"), F.lead("score").over(order).alias("next"),
        F.count("*").over(whole).alias("n_met"), F.sum(F.col("sender").cast("bigint")).over(whole).alias("n_met_sender"),
    ).where("n = 1")
    in_chat = r.groupBy("chat_id").agg(F.count_distinct("entity_id").alias("n_chat"), F.min("entity_id").alias("any_chat"))
    of_sender = r.groupBy("chat_id", F.col("r_sender").alias("q_sender")).agg(F.count_distinct("entity_id").alias("n_sender"), F.min("entity_id").alias("any_sender"))
    all_ = q.select("mention_id", "chat_id", "q_sender").join(met, "mention_id", "left").join(in_chat, "chat_id", "left").join(of_sender, ["chat_id", "q_sender"], "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    with_sender = count("n_sender") - count("n_met_sender")
    without = count("n_chat") - count("n_met") - with_sender
    top = F.array_sort(F.filter(F.array("score", "next", *(F.when(n > k, v) for n, v in ((with_sender, 0.7), (without, 0.2)) for k in (0, 1))), lambda x: x.isNotNull()))
    ranked = all_.withColumn("top", F.reverse(top)).withColumn("best", F.get("top", F.lit(0))).withColumn("second", F.get("top", F.lit(1)))
    # a sender's entity without a shared word is best, and alone at that, only if no other of that sender has one
    ranked = ranked.withColumn("found", F.when(F.col("score") == F.col("best"), F.col("entity_id")).when(F.col("best") > 0.5, F.col("any_sender")).when(F.col("best").isNotNull(), F.col("any_chat")))
    same = F.coalesce((F.col("score") == F.col("best")) & F.col("exact"), F.lit(False))
    ambiguous = F.coalesce(F.col("best") - F.col("second") < 0.15, F.lit(False))
    return ranked.select(
        "mention_id", F.when(~ambiguous & (F.col("best") >= 0.5), F.col("found")).alias("proposed_entity_id"), F.when(same & ~ambiguous, "high").when(F.col("found").isNotNull(), "uncertain").otherwise("new").alias("confidence"),
        F.col("best").alias("best_score"), (F.col("found").isNull() | ~same | ambiguous).alias("requires_confirmation"),
    )


def group_participants(messages: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """chat_id, name, first_index: assistants who spoke, once per normal form under the first spelling; `wanted` (normal forms) keeps some."""
    spoke = messages.where("role = 'assistant' and not hidden").select("chat_id", "message_index", F.trim("name").alias("name")).withColumn("key", normalize_alias(F.col("name"))).where("key <> ''")
    if wanted:
        spoke = spoke.where(F.col("key").isin(wanted))
    return spoke.groupBy("chat_id", "key").agg(F.min_by("name", "message_index").alias("name"), F.min("message_index").alias("first_index")).select("chat_id", "name", "first_index")


def speakers(messages: DataFrame, registry: DataFrame) -> DataFrame:
    """chat_id, name, entity_id: speakers whose name is a form of exactly one entity of their chat."""
    names = messages.select("chat_id", "name").distinct().withColumn("alias", normalize_alias(F.col("name"))).where("alias <> ''")
    found = names.join(registry.select("chat_id", "alias", "entity_id").distinct(), ["chat_id", "alias"])
    return found.groupBy("chat_id", "name").agg(F.min("entity_id").alias("entity_id"), F.count("*").alias("n")).where("n = 1").drop("n")
