import json
import math
import random

import numpy as np

from recallgrid.llm.truncation import ending, ending_weights, fit_censored, json_state, judge_texts, keys_of_words, long_beginnings, tagged_state, truncation_rates, without_appended

SCHEMA = "segment_row_id bigint, source_model string, synopsis string, structured_trace struct<mode:string,protocol:string,finish_reason:string,content:string>, keys int, kind string"


def table(spark, rows):
    return spark.createDataFrame([(i, m, s, t, 1, "clash") for i, (m, s, t) in enumerate(rows)], SCHEMA)


def test_appended_signs():
    assert without_appended("broke of … \n") == "broke of"
    assert without_appended("broke of [...] ```") == "broke of"
    assert without_appended("broke of (continued") == "broke of"
    assert without_appended("nothing more") == "nothing more"
    assert without_appended(" " * 200_000) == ""


def test_states_of_structured_text():
    assert json_state('x {"a": "}"} note') == ("whole", ["a"])
    assert json_state('{"a": [1, "unfini') == ("open", [])
    assert json_state("no object") == ("none", [])
    assert json_state('{"a": 1,}')[0] == "whole" and json_state("{}") == ("whole", [])
    assert tagged_state("[A_B]\n- x=1 | y=2\n- x=1")[1] == ["A_B", "A_B:x"]


def test_endings():
    for done in ("It ended.", "It ended!”", "It ended. END", "It ended 🙂", "He said “go.”"):
        assert ending(done, None)["kind"] in ("terminal", "closing_sign"), done
    for open_ in ("It ended,", "he said “"):
        assert ending(open_, None)["kind"] == "mid_clause"
    assert ending('```json\n{"a": 1\n```', "structured")["kind"] == "json_open"


def test_censored_fit_sees_beyond_the_limit():
    r = np.random.default_rng(1)
    x = np.exp(r.normal(6.0, 0.5, 20_000)).round()
    lengths, n = np.unique(np.minimum(x, 500), return_counts=True)
    mu, sigma = fit_censored(lengths.astype(float), n.astype(float), 500.0)
    assert abs(mu - 6.0) < 0.03 and abs(sigma - 0.5) < 0.03
    mu, sigma = fit_censored(np.unique(x), np.unique(x, return_counts=True)[1].astype(float), math.inf)
    assert abs(mu - 6.0) < 0.02


WORDS = "the ferry keeper told nobody about a sealed letter from the judge while rain fell over every quay and market hall".split()


def sentence(r):
    return " ".join(r.choice(WORDS) for _ in range(r.randint(6, 14))).capitalize() + " at last."


def corpus(seed=2):
    r = random.Random(seed)
    rows, cut = [], set()
    for i in range(1500):
        model = ("limited", "flaky", "solid", None)[i % 4]
        text = " ".join(sentence(r) for _ in range(r.randint(1, 8)))
        if model == "limited" and len(text) > 300:
            text = text[:300]
            cut.add((i, "synopsis"))
        elif model == "flaky" and r.random() < 0.12:
            text = text[: r.randint(10, len(text) - 12)] + r.choice(["", "\n", " …", " (continued"])
            cut.add((i, "synopsis"))
        elif model == "solid" and r.random() < 0.1:
            text = r.choice(["Interlude", "Evening by the lighthouse", text[:-1] + " 🙂", text + " END"])
        whole = json.dumps({"synopsis": sentence(r), "events": [{"description": sentence(r)}], "threads": []})
        if r.random() < 0.06:
            whole = whole[: r.randint(30, len(whole) - 5)] + r.choice(["", "\n```", "..."])
            cut.add((i, "structured_trace.content"))
        elif r.random() < 0.05:
            whole = json.dumps({"synopsis": sentence(r), "events": [{"description": sentence(r)[:11]}]})
            cut.add((i, "structured_trace.content"))
        elif r.random() < 0.1:
            whole = r.choice(["```json\n" + whole + "\n```", whole + "\n\nNote: done", whole.replace("}]", "},]"), "{}"])
        rows.append((model, text, ("structured", "p", "stop", whole)))
    return rows, cut


def test_planted_cuts_are_found(spark):
    rows, cut = corpus()
    judged = judge_texts(table(spark, rows))
    found = {(r["segment_row_id"], r["field_name"]) for r in judged.where("is_cut").collect()}
    assert len(found & cut) >= 0.95 * len(cut)
    assert len(found & cut) >= 0.97 * len(found)
    rates = {(r["source_model"], r["field_name"]): r for r in truncation_rates(judged).collect()}
    assert rates["limited", "synopsis"]["share_cut"] > 0.3 and rates["solid", "synopsis"]["share_cut"] < 0.02


def test_nulls_blanks_repeats_and_empty_tables(spark):
    rows = [("a", None, None), ("a", "", None), (None, "  ", (None, None, None, None)), ("a", "Done.", ("fallback", None, None, "")), ("a", "Done.", None), ("a", "x" * 300_000, None)]
    judged = judge_texts(table(spark, rows)).collect()
    assert sorted((r["segment_row_id"], r["field_name"]) for r in judged) == [(3, "synopsis"), (4, "synopsis"), (5, "synopsis")]
    assert not any(r["is_cut"] for r in judged if r["segment_row_id"] < 5)
    assert judge_texts(table(spark, rows).limit(0)).count() == 0


def test_names_with_unfinished_sentences_inside_a_closed_object():
    assert json_state('{"a": [{"d": "It was over."}, {"d": "It was ov"}], "e": "one two."}') == ("whole", ["a", "e", "e."])
    assert ending("It was over the cl�", None)["kind"] == "mid_clause"


def test_an_object_closed_after_a_cut_inside_a_sentence(spark):
    whole = [("m", None, ("structured", "p", "stop", json.dumps({"events": [{"description": f"They met at gate {i}."}], "threads": []}))) for i in range(40)]
    cut_ = ("m", None, ("structured", "p", "stop", json.dumps({"events": [{"description": "They met at ga"}], "threads": []})))
    got = {r["segment_row_id"] for r in judge_texts(table(spark, [*whole, cut_])).where("is_cut").collect()}
    assert got == {40}


def test_weights_are_learned_from_texts_at_limits():
    table_ = [("terminal", 1.0, 900.0, -7.0), ("word 3", 99.0, 10.0, 2.5), ("word -1", 30.0, 90.0, -1.0)]
    w = ending_weights(table_)
    assert w["terminal"] < -4 and w["word 3"] > 2.5 and w["word -1"] > -1.0
    assert ending_weights([(e, c / 100, n, g) for e, c, n, g in table_]) == {"terminal": -7.0, "word 3": 2.5, "word -1": -1.0}


def test_long_words_cut_anywhere_are_known_as_half(spark):
    long_word = "Donaudampfschifffahrtsgesellschaftskapitänskajütenschlüssel"
    words = spark.createDataFrame([("p", "der", long_word, 0, 5), ("p", "der", "Donau", 2, 1)], "kind string, behind string, word string, ends bigint, goes_on bigint")
    wanted = spark.createDataFrame([(f"px der {long_word[:k]}",) for k in (3, 24, 25, 40, len(long_word))], "key string")
    counts = keys_of_words(words).join(wanted, "key", "left_semi").unionByName(long_beginnings(words, wanted))
    assert {r["key"].split()[-1]: r["n"] for r in counts.groupBy("key").agg({"goes_on": "sum"}).withColumnRenamed("sum(goes_on)", "n").collect()} == {long_word[:3]: 8, long_word[:24]: 5, long_word[:25]: 5, long_word[:40]: 5}
