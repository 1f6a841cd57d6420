import os
import tempfile

from almanac.session import scratch_path
from almanac.streaming.ingest import run_ingest


def _write(d, name, body):
    with open(os.path.join(d, name), "w", encoding="utf-8") as f:
        f.write(body)


def test_stream_ingest_new_files_once(spark):
    src = tempfile.mkdtemp(prefix="almanac-stream-src-")
    table, ckpt = scratch_path(spark, "stream-t"), scratch_path(spark, "stream-c")
    _write(src, "a.md", "# [2024-01-01~2024-01-07] 벼\n본문 a\n# [2024-01-08~2024-01-14] 콩\n본문 b\n")
    run_ingest(spark, src, table, ckpt).awaitTermination()
    assert spark.read.parquet(table).count() == 2
    _write(src, "b.md", "# [2024-02-05~2024-02-11] 양봉\n벌통\n")
    run_ingest(spark, src, table, ckpt).awaitTermination()
    run_ingest(spark, src, table, ckpt).awaitTermination()   # nothing new
    stored = spark.read.parquet(table)
    assert stored.count() == 3
    assert stored.select("id").distinct().count() == 3
    assert sorted(r["month"] for r in stored.collect()) == [1, 1, 2]
