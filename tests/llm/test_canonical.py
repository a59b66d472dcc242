from recallgrid.llm.canonical import edits, fold, map_values, matchers, typed_values, unmatched_report

LISTS = [
    ("state", "kept", ["fulfilled", "carried out"]), ("state", "broken", ["gone back on"]), ("state", "active", ["still standing", "in force"]), ("state", "unknown", []),
    ("kind", "deadline", ["due date"]), ("kind", "exact", ["clock time"]), (None, "x", None), ("kind", None, ["y"]),
]


def find(value, field="state"):
    return matchers(LISTS)[field](value)


def test_fold_undoes_disguises():
    assert fold("  Κеpt​_Out ") == "kept out"
    assert fold("stillStanding") == "still standing"
    assert fold("Añadïdo") == "anadido"
    assert fold("???") == ""


def test_edits_counts_swaps_once():
    assert edits("kept", "ketp", 2) == 1
    assert edits("abc", "xyz", 2) == 3
    assert edits("", "ab", 1) == 2


def test_longest_embedded_mention_wins():
    assert find("vow gone back on at last") == "broken"
    assert find("kept, then gone back on") == "broken"
    assert find("STILL-STANDING (mutual)") == "active"


def test_typing_errors_order_and_breaks():
    assert find("flufilled") == "kept"
    assert find("out carried") == "kept"
    assert find("carryied otu") == "kept"
    assert find("stil.") == "active"
    assert find("status: brokn") == "broken"


def test_no_entry_for_foreign_or_unreadable_values():
    assert find("deadline") == ""
    assert find("DUE-DATE") == ""
    assert find("banana") == ""
    assert find("—") == ""
    assert find("42") == ""


def test_very_long_value():
    assert find("zz " * 50_000 + "kept") == "kept"
    assert find("qq " * 50_000) == ""


def table(spark):
    return spark.createDataFrame([r for r in LISTS], "field_name string, canonical string, known_spellings array<string>").withColumnRenamed("x", "y")


def test_map_values_whole_table(spark, as_rows):
    typed = spark.createDataFrame(
        [(1, "kept", "a"), (2, "ketp", "b"), (2, "ketp", "b"), (3, None, "c"), (4, "  ", "d"), (5, "​", "e"), (6, "nonsense", "f"), (None, "in forse", "g")], "id bigint, v string, canonical string"
    )
    values = typed_values(typed, "state", "id", "v")
    got = as_rows(map_values(values, table(spark)), "row_id", "pos", "canonical")
    assert got == sorted([(2, 0, "kept"), (2, 0, "kept"), (6, 0, ""), (None, 0, "active")], key=str)
    assert as_rows(unmatched_report(map_values(values, table(spark), with_value=True))) == [("state", "nonsense", 1)]


def test_map_values_arrays_and_empties(spark, as_rows):
    many = spark.createDataFrame([(1, ["kept", "brokne", None]), (2, []), (3, None)], "id bigint, v array<string>")
    assert as_rows(map_values(typed_values(many, "state", "id", "v"), table(spark)), "row_id", "pos", "canonical") == [(1, 1, "broken")]
    none = spark.createDataFrame([], "id bigint, v string")
    assert map_values(typed_values(none, "state", "id", "v"), table(spark)).count() == 0
    some = spark.createDataFrame([(1, "kpet")], "id bigint, v string")
    assert as_rows(map_values(typed_values(some, "other_field", "id", "v"), table(spark)), "canonical") == [("",)]
    assert as_rows(map_values(typed_values(some, "state", "id", "v"), table(spark).limit(0)), "canonical") == [("",)]
