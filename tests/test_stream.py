"""Streams that stop and go on."""

import uuid
from pathlib import Path

from test_stored import buildings

from terrafoot.operators.matching import enrich
from terrafoot.operators.profile import match_summary
from terrafoot.operators.stored import store_lookup
from terrafoot.streaming.enrichment import enrich_stream, stream_results, stream_summary


def test_restarted_stream_keeps_its_totals(spark, tmp_path):
    """Five batches in two runs, the last one tried twice: totals are those of all rows, and no more than two states are left."""
    lookup = buildings(spark, [(10 + i * 1e-3, 52.0, 10 + i * 1e-3 + 4e-4, 52.0005) for i in range(50)])
    stored = store_lookup(lookup, f"stream_{uuid.uuid4().hex}", buckets=2)
    rows = [(i, str(10 + i * 37 % 50000 * 1e-6), "52.0003" if i % 7 else "abc") for i in range(1000)]
    frame = spark.createDataFrame(rows, "k long, lon string, lat string")
    at = {name: str(tmp_path / name) for name in ("in", "out", "summaries", "checkpoint")}

    def run(parts):
        for p in parts:
            frame.where(f"k % 5 = {p}").coalesce(1).write.mode("append").parquet(at["in"])
        stream = spark.readStream.schema("k long, lon string, lat string").option("maxFilesPerTrigger", 1).parquet(at["in"])
        enrich_stream(stream, stored, at["out"], at["summaries"], at["checkpoint"], radius=60.0, key="k").awaitTermination()

    run([0, 1, 2])
    assert stream_summary(spark, at["summaries"]).first()["total_rows"] == 600
    run([3, 4])
    last = max((Path(at["checkpoint"]) / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # as if the query had ended before the last batch was recorded
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run([])
    found = stream_summary(spark, at["summaries"]).first().asDict()
    want = match_summary(enrich(frame, lookup, radius=60.0, key="k")).first().asDict()
    assert {k: round(v, 6) for k, v in found.items()} == {k: round(v, 6) for k, v in want.items()} and found["total_rows"] == 1000
    assert len(list(Path(at["summaries"]).glob("batch=*"))) <= 2
    assert stream_results(spark, at["out"]).count() == 1000
