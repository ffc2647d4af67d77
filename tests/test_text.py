from __future__ import annotations

import random
import uuid

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.functions.ids import name_uuid
from factloom.operators import transcripts as tr
from factloom.operators.fuzzy import names_within


def one(spark, value, expr, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(expr("x").alias("y")).first().y


def test_capitalize_touches_the_first_letter_only(spark):
    assert one(spark, " pEOPLE sap ", tx.normalize_category) == "People sap"
    assert one(spark, "", tx.capitalize) == ""


def test_words_split_at_any_white_space(spark):
    assert one(spark, "a b  c\x1fd\n", tx.words) == ["a", "b", "c", "d"]
    assert one(spark, "", tx.words) == []
    assert one(spark, "  ", tx.words) == []
    assert one(spark, " x y \n", tx.strip) == "x y"


def test_title_key(spark):
    assert one(spark, " Kate ", tx.title_key) == "kate"
    assert one(spark, " ", tx.title_key) == ""
    assert one(spark, "", tx.title_key) is None
    assert one(spark, None, tx.title_key) is None


def test_embedding_input(spark):
    df = spark.createDataFrame([("t", "x"), ("", "x"), (None, "x")], "title string, text string")
    assert [r[0] for r in df.select(tx.embedding_input("title", "text")).collect()] == ["t: x", "x", "x"]


def test_relation_type_and_tags(spark):
    assert one(spark, "works on", tx.relation_type) == "WORKS_ON"
    assert one(spark, " a, ,b ,", tx.tag_list) == ["a", "b"]


def test_alias_list_becomes_map(spark):
    assert one(spark, ["Tim", "Tim", "T."], tx.alias_map_from_list, "array<string>") == {"Tim": "1.0", "T.": "1.0"}


def test_name_uuid_is_version_5(spark):
    for name in ("diary_u_2024-01-01", "", "é"):
        assert one(spark, name, name_uuid) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))


def test_transcript_stats(spark):
    df = spark.createDataFrame([("a b  c\n",), ("",)], "text string")
    rows = tr.transcript_stats(df).collect()
    assert [(r.word_count, r.char_count) for r in rows] == [(3, 7), (0, 0)]


def test_fillers_are_whole_words_in_any_case(spark):
    assert one(spark, "Um, like you know Umbria uh likeé", tr.remove_fillers) == ",   Umbria  likeé"
    assert one(spark, "um um", tr.remove_fillers) == " "


def test_aliases(spark):
    got = one(spark, "Blue Harbor (62.5%), Harbor (40%), Old Pier (100%), Harbor (5%)", tr.parse_aliases)
    assert got == {"Blue Harbor": 0.625, "Harbor": 0.4, "Old Pier": 1.0}


def test_recording_time(spark):
    seen = one(spark, "2024-03-05 14-30-00 weekly.txt", lambda c: F.date_format(tr.recording_time(c), "yyyyMMddHHmmss"))
    assert seen == "20240305143000"
    assert one(spark, "notes.txt", tr.recording_time) is None
    assert one(spark, "2024-13-05 14-30-00.txt", tr.recording_time) is None


def test_transcript_files(spark, tmp_path):
    (tmp_path / "2024-03-05 14-30-00 weekly.txt").write_text("hello\nthere")
    (tmp_path / "notes.txt").write_text("x")
    rows = {r.file_name: (r.recorded_at is not None, r.text) for r in tr.read_transcripts(spark, str(tmp_path)).collect()}
    assert rows["notes.txt"] == (False, "x")
    assert [v for k, v in rows.items() if "weekly" in k] == [(True, "hello\nthere")]


def test_corrections(spark):
    texts = spark.createDataFrame([(1, "teh cat, (teh) tehx"), (2, "fine")], "id int, text string")
    fixes = spark.createDataFrame([("teh", "the"), ("cat", "dog")], "wrong string, right string")
    got = {r.id: r.text for r in tr.apply_corrections(texts, fixes, ["id"]).collect()}
    assert got == {1: "the dog, (the) tehx", 2: "fine"}


def test_relabel_and_lines(spark):
    turns = spark.createDataFrame(
        [(1, 0, "S1", "hi"), (1, 1, "S2", "yes")], "conv_id int, turn int, speaker string, text string"
    )
    names = spark.createDataFrame([(1, "S1", "Ann")], "conv_id int, speaker string, name string")
    lines = tr.speaker_lines(tr.relabel_speakers(turns, names)).orderBy("turn").collect()
    assert [r.line for r in lines] == ["[Ann]: hi", "[S2]: yes"]


def test_direct_addresses(spark):
    turns = spark.createDataFrame(
        [(1, 0, "Ruth, the tide is out! Fine. Paolo Vance, take the oars"), (1, 1, "Then Ruth, no")],
        "conv_id int, turn int, text string",
    )
    people = spark.createDataFrame([(1, "Ruth"), (1, "Paolo Vance"), (2, "Then")], "conv_id int, name string")
    rows = tr.direct_addresses(turns, people).collect()
    assert {(r.turn, r.name) for r in rows} == {(0, "Ruth"), (0, "Paolo Vance")}


def linked(spark, text, *names):
    texts = spark.createDataFrame([("u", 1, text), ("v", 2, text)], "user_id string, id int, text string")
    known = spark.createDataFrame([("u", n) for n in names], "user_id string, name string")
    got = {r.id: r.text for r in tr.link_names(texts, known, ["id"]).collect()}
    assert got[2] == text
    return got[1]


def test_links_take_the_longer_name_once(spark):
    assert linked(spark, "Ruth Vance met Ruth (C++).", "Ruth", "Ruth Vance", "C++") == "[[Ruth Vance]] met [[Ruth]] ([[C++]])."


def test_links_keep_words_and_links_whole(spark):
    assert linked(spark, "Annual talk with Ann, Ann_1, éAnn", "Ann") == "Annual talk with [[Ann]], Ann_1, éAnn"
    assert linked(spark, "[[Ann]] and [[Ann Lee]], Ann Ann", "Ann") == "[[Ann]] and [[Ann Lee]], [[Ann]] [[Ann]]"
    assert linked(spark, "[[ Ann, ]] [Ann] [[]]", "Ann") == "[[ Ann, ]] [[[Ann]]] [[]]"


def test_people_resolution(spark):
    facts = spark.createDataFrame(
        [("u", 1, "People", "Ruth Vance", "x"), ("u", 2, "People", "Ruth B", "x"), ("u", 3, "Tool", "Oar", "x")],
        "user_id string, id int, category string, title string, text string",
    )
    names = spark.createDataFrame([("u", "Ruth"), ("u", "ruth b"), ("u", "Oar"), ("v", "Ruth")], "user_id string, name string")
    got = {(r.user_id, r.name): (r.candidates, r.resolution, r.match_id) for r in tr.resolve_people(names, facts).collect()}
    assert got == {
        ("u", "Ruth"): (2, "multiple", None),
        ("u", "ruth b"): (1, "single", 2),
        ("u", "Oar"): (0, "none", None),
        ("v", "Ruth"): (0, "none", None),
    }


def test_people_by_alias_and_misspelling(spark):
    facts = spark.createDataFrame(
        [("u", 1, "People", "Ruth Vance", "x", {"Ruthie": "0.9"}), ("u", 2, "People", "Bo", "x", {}), ("u", 3, "People", None, "x", None)],
        "user_id string, id int, category string, title string, text string, aliases map<string,string>",
    )
    names = spark.createDataFrame([("u", n) for n in ("Ruth Vanse", "ruthi", "Ruthee", "Bob", "Ann", "")], "user_id string, name string")
    got = {r.name: (r.candidates, r.match_id) for r in tr.resolve_people(names, facts, aliases=True, max_edits=1).collect()}
    assert got == {"Ruth Vanse": (1, 1), "ruthi": (1, 1), "Ruthee": (1, 1), "Bob": (1, 2), "Ann": (0, None), "": (2, None)}
    listed = facts.withColumn("aliases", F.map_keys("aliases"))
    assert tr.resolve_people(names, listed, aliases=True).where("name = 'ruthi'").first().match_id == 1


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, left = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_names_within_edits_equal_all_pairs(spark, most):
    rng = random.Random(most)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(8))) for _ in range(90)]
    asked, known = words[:45] + [None, "aaaaaaaaaaaa"], words[45:] + [None, "aaaaaaaaaaa"]
    left = spark.createDataFrame([("u", w) for w in asked], "user_id string, name string")
    right = spark.createDataFrame([("u", w) for w in known] + [("v", "ab")], "user_id string, pattern string")
    got = sorted((r.name, r.pattern, r.distance) for r in names_within(left, right, most, ["user_id"]).collect())
    want = {(a, b, d) for a in asked for b in known if a is not None and b is not None and (d := edits(a, b)) <= most}
    assert got == sorted(want)


def test_metadata_and_times(spark):
    assert one(spark, '{"a": 1, "b": "x"}', tx.metadata_from_json) == {"a": "1", "b": "x"}
    assert one(spark, "nonsense", tx.metadata_from_json) == {}
    assert one(spark, None, tx.metadata_from_json) == {}
    shown = one(spark, "2024-01-31 08:30:00.5", lambda c: tx.iso_time(F.col(c).cast("timestamp_ntz")))
    assert shown == "2024-01-31T08:30:00.500000"
