"""Streams give what the batch passes give, however the input is cut into files."""

import os
import random
import sys
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.append(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_queries import rows_of  # noqa: E402
from test_segments import in_sequence, random_captions
from timesift.operators.segments import rolling_step
from timesift.plans import all_oracles, all_queries
from timesift.streaming import folds, jobs


def stream_of(spark, tmp_path, data, schema, files):
    """Write rows in time order as ``files`` files and read them as a stream, one per trigger."""
    base = tmp_path / f"in-{uuid.uuid4().hex}"
    size = -(-len(data) // files)
    for i in range(files):
        spark.createDataFrame(data[i * size:(i + 1) * size], schema).coalesce(1).write.parquet(str(base / f"part{i}"))
    names = sorted(base.glob("part*/*.parquet"))
    flat = tmp_path / f"flat-{uuid.uuid4().hex}"
    flat.mkdir()
    for i, name in enumerate(names):
        target = flat / f"{i:03d}.parquet"
        target.write_bytes(name.read_bytes())
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken by age
    return jobs.read_stream(spark, str(flat), 1).withColumn("ts", F.timestamp_seconds("t"))


@pytest.mark.parametrize("files", [1, 4])
def test_rolling_captions(spark, tmp_path, files):
    texts = random_captions(30, 9)
    data = [(1, i, 10 + 2 * i, t) for i, t in enumerate(texts)]
    shuffled = [r for i in range(0, 30, 3) for r in random.Random(i).sample(data[i:i + 3], 3)] + [(2, 0, 500, "end")]
    stream = stream_of(spark, tmp_path, shuffled, "source_id int, seg_idx int, t int, text string", files)
    out = folds.stream_fold(stream.withWatermark("ts", "20 seconds"), ["source_id"], "ts", "seg_idx", ["seg_idx", "text"], rolling_step, "keeper int, kept_text string")
    got = sorted((r.seg_idx, r.kept_text) for r in jobs.run_to_end(out, "t").where("source_id = 1 and keeper = seg_idx").collect())
    assert got == in_sequence(texts)


@pytest.mark.parametrize("files", [1, 3])
def test_budget_and_spacing(spark, tmp_path, files):
    rng = random.Random(1)
    data = [(i % 2, i, 10 + i * 5, rng.randrange(1, 30)) for i in range(40)] + [(9, 99, 900, 1)]
    schema = "k int, i int, t int, size int"
    limited = folds.stream_fold(stream_of(spark, tmp_path, data, schema, files).withWatermark("ts", "1 second"), ["k"], "ts", "i", ["size"], folds.budget_step(120, 0), "allowed boolean")
    got = {r.i: r.allowed for r in jobs.run_to_end(limited, "b").where("k < 9").collect()}
    for k in (0, 1):
        step, state = folds.budget_step(120, 0), None
        for row in data[:-1]:
            if row[0] == k:
                out, state = step(state, row[3])
                assert got[row[1]] == out[0]
    spaced = folds.stream_fold(stream_of(spark, tmp_path, data, schema, files).withWatermark("ts", "1 second"), ["k"], "ts", "i", ["t"], folds.spacing_step(25.0), "")
    kept = {}
    for k, i, t, _ in data[:-1]:
        if not kept.get(k) or t - kept[k][-1][1] >= 25:
            kept.setdefault(k, []).append((i, t))
    assert sorted(r.i for r in jobs.run_to_end(spaced, "s").where("k < 9").collect()) == sorted(i for v in kept.values() for i, _ in v)


def test_each_key_lands_once_even_far_apart(spark, tmp_path):
    data = [(i % 10, 10 + 100 * i) for i in range(40)]
    stream = stream_of(spark, tmp_path, data, "key int, t int", 4)
    landed = jobs.ingest_once(stream, "key", str(tmp_path / "table"), str(tmp_path / "cp"))
    assert sorted(r.key for r in landed.collect()) == list(range(10))


def test_sessions_and_blocks(spark, tmp_path):
    data = [(1, t) for t in (10, 15, 20, 31, 40)] + [(2, 999)]
    stream = stream_of(spark, tmp_path, data, "k int, t int", 2)
    found = jobs.run_to_end(jobs.pause_sessions(stream, ["k"], "ts", "10 seconds", "30 seconds"), "p").where("k = 1")
    assert sorted((r.start.timestamp(), r.end.timestamp(), r["items"]) for r in found.collect()) == [(10.0, 30.0, 3), (31.0, 50.0, 2)]
    blocks = jobs.run_to_end(jobs.fixed_blocks(stream_of(spark, tmp_path, data, "k int, t int", 1), ["k"], "ts", "30 seconds", "20 seconds"), "w").where("k = 1")
    assert sorted(r["items"] for r in blocks.collect()) == [1, 2, 2]


def test_late_rows_are_counted(spark, tmp_path):
    # Lateness is judged by the watermark of the batch before.
    data = [(1, 500), (1, 600), (1, 700), (1, 701), (1, 10), (1, 200)]
    stream = jobs.fixed_blocks(stream_of(spark, tmp_path, data, "k int, t int", 3), ["k"], "ts", "5 seconds")
    query = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "late")).trigger(availableNow=True).format(
        "parquet").start(str(tmp_path / "out"))
    query.awaitTermination()
    assert jobs.late_rows(query) == 2


def test_run_to_end_refuses_late_rows(spark, tmp_path):
    data = [(1, 500), (1, 600), (1, 700), (1, 701), (1, 10), (1, 200)]
    stream = jobs.fixed_blocks(stream_of(spark, tmp_path, data, "k int, t int", 3), ["k"], "ts", "5 seconds")
    with pytest.raises(ValueError, match="2 rows"):
        jobs.run_to_end(stream, "late")


def test_a_late_first_arrival_still_lands(spark, tmp_path):
    data = [(i % 3, 100_000 + i) for i in range(6)] + [(7, 5), (8, 1), (7, 6)]
    stream = stream_of(spark, tmp_path, data, "key int, t int", 3)
    landed = jobs.ingest_once(stream, "key", str(tmp_path / "table"), str(tmp_path / "cp"))
    assert sorted(r.key for r in landed.collect()) == [0, 1, 2, 7, 8]


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cut_tables(spark, tmp_path_factory):
    """The smallest event and conversation tables as four files each, split by key."""
    base = tmp_path_factory.mktemp("cut")
    for name, key in (("events", "user_id"), ("conversations", "conv_id")):
        spark.read.parquet(f"{SF}/{name}.parquet").repartitionByRange(4, key).write.parquet(str(base / f"{name}.parquet"))
    return str(base)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("files", ["one", "four"])
@pytest.mark.parametrize("name", ["stream_once", "stream_sessions", "stream_budget", "stream_spacing", "stream_rolling"])
def test_stream_queries_equal_sql_on_any_file_layout(spark, cut_tables, name, files):
    queries, twins = all_queries(), all_oracles()
    con = duckdb.connect()
    for table in ("events", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = queries[name](spark, SF if files == "one" else cut_tables)
    cur = con.execute(twins[name])
    columns = [d[0] for d in cur.description]
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())
