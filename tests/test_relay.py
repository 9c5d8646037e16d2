import json
import time

import pytest

from tallyspark.streaming import turns as T


def write(folder, name, rows):
    (folder.parent / name).write_text("\n".join(json.dumps(dict(zip(("stream", "pos", "text"), r))) for r in rows))
    (folder.parent / name).rename(folder / name)


def test_silent_streams_are_kept_alive_until_they_close(spark, tmp_path):
    folder = tmp_path / "chunks"
    folder.mkdir()
    chunks = spark.readStream.schema("stream string, pos long, text string").json(str(folder))
    out = T.relayed(chunks, ["\nevent: done"], 400, failed=("\nevent: failed",))
    run = out.writeStream.format("memory").queryName("relay_out").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="200 milliseconds").start()

    def rows(stream):
        return [(r.kind, r.text) for r in spark.table("relay_out").filter(f"stream = '{stream}'").collect()]

    def wait(condition):
        end = time.time() + 60
        while not condition():
            assert time.time() < end and run.isActive
            time.sleep(0.3)

    try:
        write(folder, "1.json", [("a", 1, "eve"), ("b", 1, "x"), ("c", 1, "x"), ("c", 2, None)])
        wait(lambda: rows("a").count(("keep-alive", None)) >= 2 and rows("b").count(("keep-alive", None)) >= 2)
        assert rows("c") == [("chunk", "x"), ("truncated", None)]
        write(folder, "2.json", [("a", 3, "ne {}"), ("a", 2, "nt: do"), ("a", 4, None), ("b", 2, ""), ("b", 3, "\nevent: failed\nevent: done"), ("b", 4, None), ("b", 5, "again")])
        wait(lambda: ("done", None) in rows("a") and ("chunk", "again") in rows("b"))
        quiet = len(rows("a"))
        wait(lambda: rows("b")[-1][0] == "keep-alive")
    finally:
        run.stop()
    kinds = [r for r in rows("a") if r[0] != "keep-alive"]
    assert kinds == [("chunk", "eve"), ("chunk", "nt: do"), ("chunk", "ne {}"), ("done", None)]
    assert len(rows("a")) == quiet
    assert [r for r in rows("b") if r[0] != "keep-alive"] == [("chunk", "x"), ("chunk", ""), ("chunk", "\nevent: failed\nevent: done"), ("failed", None), ("chunk", "again")]


def test_a_carry_shorter_than_a_marker_is_refused(spark):
    with pytest.raises(ValueError):
        T.relayed(spark.createDataFrame([], "stream string, pos long, text string"), ["long marker"], 100, carry=4)
