from __future__ import annotations

from paddock.streaming.ingest import ingest
from tests.test_sources import VBO


def test_drop_folder(spark, tmp_path):
    drop, out = tmp_path / "drop", str(tmp_path / "out")
    drop.mkdir()
    (drop / "a.vbo").write_text(VBO)
    assert ingest(spark, str(drop), out, str(tmp_path / "ck")).awaitTermination(120)
    (drop / "b.vbo").write_text(VBO)
    assert ingest(spark, str(drop), out, str(tmp_path / "ck")).awaitTermination(120)
    samples = spark.read.parquet(f"{out}/samples")
    assert samples.select("recording_id").distinct().count() == 2 and samples.groupBy("recording_id", "channel_idx", "local_idx").count().where("count > 1").count() == 0
