from pathlib import Path

from tapewright.sources import scratch


def test_clear_deletes_what_was_placed(spark, monkeypatch):
    monkeypatch.setattr(scratch, "_placed", [])
    assert scratch.written(spark.range(3), "x").count() == 3
    path = Path(scratch._placed[0].removeprefix("file://"))
    assert path.exists()
    scratch.clear(spark)
    assert not path.exists() and not scratch._placed
