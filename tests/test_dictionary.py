"""Tags by a dictionary table: equal to plain Python, whatever the dictionary's size and the texts' length."""

import random

import pytest
from pyspark.sql import functions as F

from almanac.operators import dictionary as dic
from almanac.operators.tags import TAG_SETS

from .test_cases import plain_tags


def found(spark, texts, dictionary, classes):
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = dic.dictionary_tags(docs, ["id"], "text", dictionary, classes).collect()
    assert len(rows) == len(texts)
    return {r["id"]: r for r in rows}


@pytest.mark.parametrize("limit", [dic.BROADCAST_CHARS, 0])
def test_equals_plain_python(spark, monkeypatch, limit):
    """Random Hangul texts with many one-character tags, particles and overlaps, cut into small pieces."""
    monkeypatch.setattr(dic, "PIECE_CHARS", 3)
    monkeypatch.setattr(dic, "BROADCAST_CHARS", limit)
    rng = random.Random(5)
    sets = TAG_SETS | {"overlap": ["abab", "ba", "abababab", "a", "bb", "aba"], "none": ["", "😀x"]}
    parts = [*"벼밀콩무은는이가 \n.ab", "배추", "배", "감자", "소나무", "AI", "abab", "😀x", "😀", "고구마"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(60))) for _ in range(120)] + ["", None, "ab" * 900]
    rows = found(spark, texts, dic.dictionary_frame(spark, sets), list(sets))
    for i, text in enumerate(texts):
        for cls, tags in sets.items():
            assert ", ".join(rows[i][f"tags_{cls}"]) == plain_tags(text or "", [t for t in tags if t]), (text, cls)


def test_hundred_thousand_tags_without_a_regex(spark):
    """Without ranks the longest tag at a place wins; the words of the dictionary stand in no pattern of the plan."""
    rng = random.Random(6)
    tags = sorted({"".join(rng.choices("abcdefgh", k=rng.randrange(4, 12))) for _ in range(125_000)})
    assert len(tags) >= 100_000
    texts = [" ".join(rng.choices(tags, k=30)) + "".join(rng.choices("abcdefgh ", k=300)) for _ in range(40)]
    table = spark.createDataFrame([("x", t) for t in tags], "class string, tag string")
    rows = found(spark, texts, table, ["x"])
    known, longest = set(tags), max(map(len, tags))
    for i, text in enumerate(texts):
        want, at = set(), 0
        while at < len(text):
            tag = next((text[at:at + n] for n in range(longest, 3, -1) if text[at:at + n] in known), None)
            want.add(tag)
            at += len(tag) if tag else 1
        assert set(rows[i]["tags_x"]) == want - {None}
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    plan = dic.dictionary_matches(docs, ["id"], "text", table)._jdf.queryExecution().executedPlan().toString()
    assert tags[0] + "|" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert plan.count("REPARTITION_BY_COL") == 1


def test_edges(spark):
    """Repeated texts under one key, repeated and null tags, empty tables, a long text, no dictionary."""
    table = spark.createDataFrame([("x", "ab", 1), ("x", "ab", 2), ("x", None, 3), ("x", "", 4), ("y", "b", 5)],
                                  "class string, tag string, rank long")
    docs = spark.createDataFrame([(1, "zab"), (1, "zab"), (2, None), (None, "b"), (3, "-" * 300_000 + "ab b")], "id long, text string")
    rows = {r["id"]: (r["tags_x"], r["tags_y"]) for r in dic.dictionary_tags(docs, ["id"], "text", table, ["x", "y"]).collect()}
    assert rows == {1: (["ab"], ["b"]), 2: ([], []), None: ([], ["b"]), 3: (["ab"], ["b"])}
    assert dic.dictionary_tags(docs.limit(0), ["id"], "text", table, ["x"]).count() == 0
    none = dic.dictionary_tags(docs, ["id"], "text", table.limit(0), ["x"]).collect()
    assert len(none) == 4 and not any(r["tags_x"] for r in none)


def test_only_places_of_heads_become_rows(spark):
    """One row per place whose gram is a tag's head, not one per character and class of lengths."""
    tags = dic._prepared(dic.dictionary_frame(spark, {"x": ["thing", "z", "erblegarten"]}))
    docs = spark.createDataFrame([(1, "abcd " * 5000 + "thin thing z", b"x")], "__key0 long, __text string, other binary")
    rows = dic._grams(docs, ["__key0"], [1, 4, 8], dic._bitmap(tags)).collect()
    assert sorted((r["at"], r["before"], r["window"]) for r in rows if r["window"][0] in "tz") == [
        (25001, " ", "thin th"), (25006, " ", "thing z"), (25012, " ", "z")]
    assert len(rows) < 10


def test_texts_that_are_not_utf_8(spark):
    docs = spark.createDataFrame([(1, bytearray(b"\xff\xfe ab \xc3"))], "id long, raw binary").select(
        "id", F.expr("cast(raw AS string)").alias("text"))
    table = spark.createDataFrame([("x", "ab")], "class string, tag string")
    assert dic.dictionary_tags(docs, ["id"], "text", table, ["x"]).first()["tags_x"] == ["ab"]
