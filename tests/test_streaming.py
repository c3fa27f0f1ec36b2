"""Following files that grow, against what was written to them."""

import random

from pyspark.sql import functions as F

from routelens.streaming import jobs, tail


def test_every_line_lies_in_one_range(tmp_path):
    draw = random.Random(1)
    lines = [("x" * draw.choice([0, 1, 5, 60, 400])).encode() + str(i).encode() for i in range(300)]
    file = tmp_path / "a.log"
    file.write_bytes(b"\n".join(lines) + b"\nunfinished")
    size = file.stat().st_size
    for most in (1, 7, 100, 10**6):
        found = [x for part in tail.ranges({}, {str(file): size}, most) for some in tail.lines_ending_in(part) for x in some]
        assert found == lines
    cuts = sorted({0, size, *(draw.randrange(size) for _ in range(40))})
    found = []
    for a, b in zip(cuts, cuts[1:]):  # batches that end anywhere
        for part in tail.ranges({str(file): a}, {str(file): b}, 50):
            found += [x for some in tail.lines_ending_in(part) for x in some]
    assert found == lines


def test_blocks_and_lines_looked_back_for_are_longer_than_what_is_read_at_a_time(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "BLOCK_BYTES", 11)
    monkeypatch.setattr(tail, "BACK_BYTES", 13)
    test_every_line_lies_in_one_range(tmp_path)


def test_ranges_of_truncated_and_new_files():
    got = tail.ranges({"a": 10, "b": 10, "gone": 5}, {"a": 25, "b": 4, "c": 3, "d": 0}, 10)
    assert [(r.path, r.start, r.end) for r in got] == [("a", 10, 20), ("a", 20, 25), ("b", 0, 4), ("c", 0, 3)]


def test_sizes_pass_over_hidden_files(tmp_path):
    for name in ("a.log", "sub/b.log", "_c.log", ".d.log", "_tmp/e.log", "f.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("line\n")
    names = lambda *a: sorted(x.removeprefix(f"file://{tmp_path}/") for x in tail.file_sizes(*a))
    assert names([str(tmp_path)]) == ["a.log", "f.txt", "sub/b.log"]
    assert names([f"file://{tmp_path}"], "*.log") == ["a.log", "sub/b.log"]
    assert names([str(tmp_path / "f.txt"), str(tmp_path / "missing")]) == ["f.txt"]


LINE = "2024-01-01T00:00:00Z GET /api/v1/items/{} 200 5ms"


def test_following_from_the_end_with_restart_truncation_and_new_files(spark, tmp_path):
    logs, state, out = tmp_path / "logs", str(tmp_path / "state"), str(tmp_path / "out")
    logs.mkdir()
    a, b = logs / "a.log", logs / "b.log"
    a.write_text("".join(LINE.format(i) + "\n" for i in range(5)) + LINE.format(900)[:20])
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")

    def follow():
        stream = jobs.tail_logs(spark, str(logs), "generic", as_of)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.path for r in spark.read.parquet(out).collect())

    paths = lambda *ids: sorted(f"/api/v1/items/{i}" for i in ids)
    assert follow() == []  # what was there before does not count
    with a.open("a") as file:
        file.write(LINE.format(900)[20:] + "\n" + LINE.format(6) + "\n")
    b.write_text(LINE.format(7) + "\r\n\n" + LINE.format(8) + "\n")
    assert follow() == paths(900, 6, 7, 8)
    assert follow() == paths(900, 6, 7, 8)
    a.write_text(LINE.format(9) + "\n")  # truncated
    b.unlink()
    assert follow() == paths(900, 6, 7, 8, 9)
    b.write_bytes(b"\xff bad bytes\n" + LINE.format(10).encode() + b"\n")
    assert follow() == paths(900, 6, 7, 8, 9, 10)


def test_ingest_detects_formats_of_followed_files(spark, tmp_path):
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    logs.mkdir()
    nginx = '10.0.0.1 - - [03/Jan/2024:10:15:01 +0000] "GET /a/{} HTTP/1.1" 200 5 "-" "agent" 0.010 ""\n'
    (logs / "n.log").write_text("".join(nginx.format(i) for i in range(3)))
    (logs / "g.log").write_text(LINE.format(1) + "\n")
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    for _ in range(2):
        jobs.ingest_writer(spark, str(logs), out, str(tmp_path / "state"), as_of, once=True, tail="beginning").start().awaitTermination()
        with (logs / "n.log").open("a") as file:
            file.write(nginx.format(9))
    got = sorted((r.path, r.discovery_source) for r in spark.read.parquet(out).collect())
    assert got == [(f"/a/{i}", "log_nginx") for i in (0, 1, 2, 9)] + [("/api/v1/items/1", "log_generic")]
