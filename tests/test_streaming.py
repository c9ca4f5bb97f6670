import os
import tempfile

from textlab.streaming.cleanup import start_cleanup


def _run(spark, src, out):
    start_cleanup(spark, src, out).awaitTermination(120)
    return sorted(r.text for r in spark.read.parquet(out).collect())


def test_restart_resumes(spark):
    src, out = (tempfile.mkdtemp(prefix=f"textlab-stream-{x}-") for x in ("in", "out"))
    with open(os.path.join(src, "p.txt"), "w", encoding="utf-8") as f:
        f.write("  a ( b ) 4, 5 %  \ne. g. this\n")
    assert _run(spark, src, out) == ["a (b) 4,5%", "e.g. this"]
    with open(os.path.join(src, "q.txt"), "w", encoding="utf-8") as f:
        f.write("one\ntwo\nthree\n")
    assert _run(spark, src, out) == ["a (b) 4,5%", "e.g. this", "one", "three", "two"]
