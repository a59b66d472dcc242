"""Registers: standings and tournaments from observation logs, their text, and which are injected."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import search_tokens

#: Points by finishing position.
POINTS = (10, 8, 6, 5, 4, 3, 2, 1)


def points(position: Column) -> Column:
    """Points of a finishing position; 0 beyond the table, for null and for disqualified ones."""
    return F.coalesce(*(F.when(position == i + 1, F.lit(p)) for i, p in enumerate(POINTS)), F.lit(0))


def standings(results: DataFrame, amendments: DataFrame, snapshots: DataFrame) -> DataFrame:
    """register, subject, points, place of championship registers.

    results: register, event, subject, position, seq; the last report of an event counts as a whole. amendments: register, event, subject,
    position, seq; one later than the event's last report replaces a subject's position, the last winning. snapshots: register, subject, points, complete, seq; a snapshot's points
    replace the sum, a complete one also clears subjects it doesn't name. Order: points, then subject.
    """
    last_report = results.groupBy("register", "event").agg(F.max("seq").alias("last_seq"))
    current = results.join(last_report, ["register", "event"]).where("seq = last_seq")
    patch = amendments.join(last_report, ["register", "event"]).where(F.col("seq") > F.col("last_seq")).groupBy("register", "event", "subject").agg(F.max_by("position", "seq").alias("new_position"))
    placed = current.select("register", "event", "subject", "position").join(patch, ["register", "event", "subject"], "full").withColumn("position", F.coalesce("new_position", "position"))
    sums = placed.groupBy("register", "subject").agg(F.sum(points(F.col("position"))).alias("summed"))
    cleared = snapshots.where("complete").groupBy("register").agg(F.max("seq").alias("cleared_at"))
    shown = snapshots.join(cleared, "register", "left").where("cleared_at is null or seq >= cleared_at").groupBy("register", "subject").agg(F.max_by("points", "seq").alias("shown"))
    both = sums.join(shown, ["register", "subject"], "full").join(cleared, "register", "left")
    kept = both.where("cleared_at is null or shown is not null").select("register", "subject", F.coalesce("shown", "summed").cast("bigint").alias("points"))
    order = Window.partitionBy("register").orderBy(F.col("points").desc(), "subject")
    return kept.withColumn("place", F.row_number().over(order))


def tournaments(matches: DataFrame) -> DataFrame:
    """register, n_matches, champion, final_pending: winners by match (the last report), the champion of a complete final.

    matches: register, match, winner, round, complete, seq.
    """
    last = matches.groupBy("register", "match").agg(F.max(F.struct("seq", "winner", "round", "complete")).alias("m")).select("register", "match", "m.*")
    final = (F.col("round") == "final") & F.col("complete")
    return last.groupBy("register").agg(
        F.count("*").alias("n_matches"), F.max_by(F.when(final, F.col("winner")), F.when(final, F.col("seq"))).alias("champion"), ~F.coalesce(F.bool_or(final), F.lit(False)) & F.coalesce(F.bool_or(F.col("round") == "final"), F.lit(False))
    ).toDF("register", "n_matches", "champion", "final_pending")


def injected_registers(registers: DataFrame, manual: DataFrame, relevant: DataFrame) -> DataFrame:
    """The registers that go into a context. registers: key, lifecycle, policy; manual, relevant: key.

    An archived one needs the policy `archived` and a place in either list; of live ones `always` go in, `manual` and `relevant` with a place in their list, `archived` not.
    """
    marked = registers.join(manual.select("key", F.lit(True).alias("m")).distinct(), "key", "left").join(relevant.select("key", F.lit(True).alias("r")).distinct(), "key", "left")
    m, r = F.coalesce("m", F.lit(False)), F.coalesce("r", F.lit(False))
    keep = F.when(F.col("lifecycle") == "archived", (F.col("policy") == "archived") & (m | r)).when(F.col("policy") == "always", True).when(F.col("policy") == "manual", m).when(F.col("policy") == "relevant", r).otherwise(False)
    return marked.where(keep).select("key", "lifecycle", "policy")


def relevant_registers(registers: DataFrame, query_tokens: Column) -> DataFrame:
    """The registers a word of whose key or type is among the query's words (an array column of constants)."""
    return registers.where(F.arrays_overlap(F.concat(search_tokens(F.col("key")), search_tokens(F.col("type"))), query_tokens))


def register_text(observations: DataFrame, last: int = 5) -> DataFrame:
    """register, n_observations, text: the last observations of each register, one a line. observations: register, seq, line."""
    order = Window.partitionBy("register").orderBy(F.col("seq").desc())
    tail = observations.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= last)
    total = observations.groupBy("register").agg(F.count("*").alias("n_observations"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n")
    return tail.groupBy("register").agg(text.alias("text")).join(total, "register")


#: Reducers of register types of one's own: a type's name and a function from the register's observations, in order, to a one-line state.
REDUCERS: dict[str, Callable[[pd.DataFrame], str]] = {}


def register_reducer(kind: str) -> Callable:
    """Decorator: adds a reducer for registers of a type."""

    def add(f: Callable[[pd.DataFrame], str]) -> Callable:
        REDUCERS[kind] = f
        return f

    return add


def reduce_registers(observations: DataFrame) -> DataFrame:
    """register, type, state: each register folded by the reducer of its type; types without one give null. observations: register, type, seq and whatever the reducers read."""
    reducers = dict(REDUCERS)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        f = reducers.get(key[1])
        return pd.DataFrame({"register": [key[0]], "type": [key[1]], "state": [f(rows.sort_values("seq")) if f else None]})

    return observations.groupBy("register", "type").applyInPandas(run, "register string, type string, state string")
