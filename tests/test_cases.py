"""The rule cases do make the rules fire."""

import pytest

from almanac.operators.tags import PARTICLES, TAG_SETS
from almanac.plans import QUERIES
from almanac.plans.cases import case_bulletins
from pyspark.sql import functions as F

from .conftest import SF_CHECK


@pytest.fixture(scope="module")
def total(spark):
    return case_bulletins(spark, SF_CHECK).count()


def rows(spark, name):
    return QUERIES[name](spark, SF_CHECK).collect()


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith("q_header_only") and n.endswith("_cases")])
def test_heading_rules_drop_rows(spark, total, name):
    assert total * 0.8 < len(rows(spark, name)) < total


def test_heading_rules_differ(spark):
    kept = {n: frozenset(r["id"] for r in rows(spark, n)) for n in QUERIES
            if n.startswith("q_header_only") and n.endswith("_cases")}
    assert len(kept) == 4 and len(set(kept.values())) == 4


def test_reasons_bands_limits_and_reasons_of_priority(spark):
    reasons = {x for r in rows(spark, "q_reject_reasons_cases") for x in r["reasons"].split(", ")}
    assert reasons == {"", "MOKCHA FILTER", "HEADER FILTER", "NON-MATCH SUMMARY"}
    banded = rows(spark, "q_cosine_banded_cases")
    assert len(banded) == 5 and len({r["band"] for r in banded}) == 2
    assert len(rows(spark, "q_recent_cases")) == 150
    assert {r["reason"] for r in rows(spark, "q_priority_strict_cases")} >= {"Format Err", "ERR", "Weather", "Other"}
    assert {r["tier"] for r in rows(spark, "q_fallback_match_cases")} == {1}


def test_tags_special_characters_and_sections(spark, total):
    found = rows(spark, "q_tags_extract_cases")
    assert any("배, 배추" in r["tags_crop"] and "소" not in r["tags_crop"].split(", ")[:1] for r in found)
    assert len(rows(spark, "q_special_chars_cases")) > total / 48
    assert len(rows(spark, "q_sections_cases")) < total * 0.97
    years = {r["year"] for r in rows(spark, "q_briefing_cases")}
    assert years == {2023, 2024, 2025}
    assert case_bulletins(spark, SF_CHECK).filter(~F.col("year").isin(2023, 2024, 2025)).count() > 0
    assert all(r["tag"] for r in rows(spark, "q_tag_list_cases"))


def plain_tags(text, tags):
    """Tags found from left to right, without overlap: at each place one-character tags that stand
    alone or with a particle come before longer ones, each in the dictionary's order."""
    def hangul(i):
        return 0 <= i < len(text) and "\uac00" <= text[i] <= "\ud7a3"
    found, at = set(), 0
    while at < len(text):
        stop = None
        for t in (t for t in tags if len(t) == 1):
            ends = [at + 1 + len(p) for p in PARTICLES if text.startswith(p, at + 1)] + [at + 1]
            free = [e for e in ends if not hangul(e)]
            if text[at] == t and not hangul(at - 1) and free:
                found.add(t)
                stop = free[0]
                break
        for t in () if stop else (t for t in tags if len(t) > 1):
            if text.startswith(t, at):
                found.add(t)
                stop = at + len(t)
                break
        at = stop or at + 1
    return ", ".join(sorted(found))


@pytest.mark.parametrize("name", ["q_tags_extract_cases", "q_tags_dictionary_cases"])
def test_tags_of_all_rows_equal_plain_python(spark, total, name):
    texts = {r["id"]: r["content_md"] for r in case_bulletins(spark, SF_CHECK).select("id", "content_md").collect()}
    found = rows(spark, name)
    assert len(found) == total
    for r in found:
        for cls, tags in TAG_SETS.items():
            assert (r[f"tags_{cls}"] or "") == plain_tags(texts[r["id"]] or "", tags)
