"""The pipeline's stages, each held against plain Python on its own input."""

import base64
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from almanac.llm.common import written

from ..conftest import SF_CHECK, SF_SMALL
from . import brute
from .test_groups import brute_lines

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def outputs(spark):
    """[(name, input rows, output)] of all stages on the smallest table."""
    docs, out = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, SF_SMALL), f"test-{name}")
        out.append((name, docs.collect(), after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def test_names_and_columns(outputs):
    assert list(outputs) == ["language_id", "line_dedup", "near_dedup", "decontamination", "source_mix"]
    assert all(after.columns == COLUMNS for _, after in outputs.values())
    assert entry.queries()["pipeline"] is corpus_pipeline.run


RUSSIAN = "Все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью"
POLISH = "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem"
FINNISH = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto"


def test_language_stage_rejects_what_was_not_learned(spark):
    """Random letters, base64 and other languages go; clean documents, which the fit never saw, stay."""
    rng = random.Random(3)
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    clean = docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).withColumn("lang", F.lit(None).cast("string"))
    bad = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n))
           for n in (6, 20, 100) for _ in range(15)]
    bad += [base64.b64encode(rng.randbytes(n)).decode() for n in (40, 200, 2000) for _ in range(15)]
    bad += [" ".join(rng.sample(x.split(), k)) for x in (RUSSIAN, POLISH, FINNISH) for k in (8, 10, 12) for _ in range(5)]
    bad += ["", None, "12 34 %%"]
    added = spark.createDataFrame([(-i - 1, t, None, "s", 0) for i, t in enumerate(bad)], docs.schema)
    table = docs.join(clean.select("doc_id"), "doc_id", "left_anti").select(*COLUMNS).unionByName(clean).unionByName(added)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, table, SF_CHECK).select("doc_id").collect()}
    good = {r.doc_id for r in clean.collect() if any(c.isalpha() for c in r.text or "")}
    assert len(good & kept) >= 0.99 * len(good) > 100
    assert len([i for i in kept if i < 0]) <= 0.1 * len(bad)
    assert all(-len(bad) + k not in kept for k in range(3))


def test_line_stage(outputs):
    """Lines go only where edit similarity says so, and nearly all of those do."""
    before, after = outputs["line_dedup"]
    gone = brute_lines([(r.doc_id, r.text) for r in before])
    rows, found = {r.doc_id: r for r in after.collect()}, 0
    for r in before:
        lines = r.text.split("\n")
        least = [x for k, x in enumerate(lines) if (r.doc_id, k) not in gone]
        if r.doc_id not in rows:
            assert not brute.plain_words("\n".join(least))
            found += len(lines) - len(least)
            continue
        kept = rows[r.doc_id].text.split("\n")
        assert len(rows[r.doc_id].text) == rows[r.doc_id].n_chars
        at = iter(lines)
        assert all(x in at for x in kept) and len(kept) >= len(least)      # in order, and no clean line lost
        found += len(lines) - len(kept)
    assert 0.98 * len(gone) <= found <= len(gone) and gone


def test_near_stage(outputs):
    before, after = outputs["near_dedup"]
    groups = brute.near_components([(r.doc_id, r.text) for r in before], 5)
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, (_, c) in groups.items() if i == c)


def test_decontamination_stage(spark, outputs):
    before, after = outputs["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in before if not brute.contamination(r.text, items)[1]}
    assert {r.doc_id for r in after.collect()} == clean and len(clean) < len(before)


def test_mix_stage(outputs):
    before, after = outputs["source_mix"]
    size = {r.doc_id: len(brute.plain_words(r.text)) for r in before}
    rows = after.collect()
    times = {i: sum(r.doc_id == i for r in rows) for i in size}
    assert max(times.values()) <= 2 and {r.doc_id for r in rows} <= set(size)
    total = sum(size.values())
    assert abs(sum(size[r.doc_id] for r in rows) / total - 1.5) < 0.2


def test_edge_rows_pass_and_empty_tables_stay_empty(spark, tmp_path):
    spark.createDataFrame([(1, brute.SENTENCE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = brute.edge_table(spark).withColumns({c: F.lit(c) for c in ("row", "language", "scan", "__language", "doc")})
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.where("false"), str(tmp_path))
        assert empty.count() == 0 and empty.columns == docs.columns, name
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} <= {6, 7, 9, 10, None}
