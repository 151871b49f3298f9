"""Live streams: chunks in any order, and sources that are read once."""

import random
from datetime import datetime, timedelta

import pytest

from quillspark.operators import endpoint
from quillspark.streaming import endpointer

CHUNK = "stream string, seq long, ts timestamp, energy double"
START = datetime(2026, 1, 1)


@pytest.fixture
def rocks(spark):
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(conf, before)


def row(stream, seq, energy):
    return (stream, seq, START + timedelta(milliseconds=100 * seq), energy)


def played(spark, tmp_path, name, batches, rules=endpoint.FIXED, **options):
    """The batches, a file and micro-batch each, in their own order."""
    schema = spark.createDataFrame([], CHUNK).schema
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    q = endpointer.endpoints_in_order(live, rules, **options).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    got = spark.sql(f"select * from {name}").collect()
    return sorted((r.stream, r.start, r.complete) for r in got if r.start is not None), sum(r.late for r in got)


def energies(n, seed):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        out += [10.0 + rng.random()] * rng.randint(3, 30) + [30.0 + rng.random()] * rng.randint(1, 15)
    return out[:n]


def in_order(spark, level, rules):
    rows = [(s, i, x) for s, xs in level.items() for i, x in enumerate(xs)]
    return sorted(tuple(r) for r in endpoint.utterances(spark.createDataFrame(rows, "utt string, seq long, energy double"), rules).collect())


@pytest.mark.parametrize("rules", [endpoint.FIXED, endpoint.HELD])
def test_any_order_inside_the_watermark(spark, tmp_path, rocks, rules):
    level = {s: energies(400, s) for s in ("a", "b")}
    want = in_order(spark, level, rules)
    rows = [row(s, i, x) for s, xs in level.items() for i, x in enumerate(xs)]
    rng = random.Random(4)
    # each chunk is at most 80 chunks, 8 seconds, behind the latest; a chunk far ahead ends the play
    rows.sort(key=lambda r: (r[2] + timedelta(milliseconds=rng.uniform(0, 7900))))
    batches = [rows[k : k + 150] for k in range(0, len(rows), 150)] + [[row("end", 9999, 0.0)], [row("end", 10_000, 0.0)]]
    got, late = played(spark, tmp_path, f"shuffled{rules.warm}", batches, rules)
    assert want and got == want and late == 0


def test_late_chunks_and_repeats_are_counted(spark, tmp_path, rocks):
    level = {"a": energies(300, 7)}
    rows = [row("a", i, x) for i, x in enumerate(level["a"])]
    held = rows[:40] + rows[43:]
    batches = [held[:150], held[150:200] + rows[100:105], held[200:], [row("end", 9999, 0.0)], rows[40:43] + rows[:2], [row("end", 10_000, 0.0)]]
    got, late = played(spark, tmp_path, "late", batches)
    chunks = spark.createDataFrame([("a", i, x) for i, x in enumerate(level["a"]) if not 40 <= i < 43], "utt string, seq long, energy double")
    assert got == sorted(tuple(r) for r in endpoint.utterances(chunks, endpoint.FIXED).collect())
    assert late == 5 + 3 + 2


def test_event_time_ends_a_silent_stream(spark, tmp_path, rocks):
    batches = [[row("a", i, 30.0) for i in range(8)] + [(None, 1, START, 30.0), ("b", None, START, 30.0), ("b", 0, None, 30.0)], [row("end", 500, 0.0)], [row("end", 501, 0.0)]]
    got, late = played(spark, tmp_path, "idle", batches, idle=2.0)
    assert got == [("a", 0, 7)] and late == 0
