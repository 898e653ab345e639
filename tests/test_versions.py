"""The table of versions: repeated batches, crashes at every step, bounded reading, undisturbed readers."""

import random

import pytest

from larder.streaming import jobs
from larder.streaming.versions import VersionedTable

ROWS = "k int, v string, pos int"


@pytest.fixture
def table(spark, tmp_path):
    base = spark.createDataFrame([(i, "base", 0) for i in range(20)], ROWS)
    return VersionedTable(spark, str(tmp_path / "t"), ["k"], ["pos"], most=4).create(base)


def held(table):
    return {r.k: r.v for r in table.read().collect()}


def batch(spark, n):
    rng = random.Random(n)
    return [(rng.randrange(30), f"b{n}-{i}", i) for i in range(15)]


def replay(batches):
    out = {i: "base" for i in range(20)}
    for rows in batches:
        for k, v, _ in sorted(rows, key=lambda r: r[2]):
            out[k] = v
    return out


def test_batches_fold_and_reading_stays_bounded(spark, table):
    done = []
    for n in range(11):
        done.append(batch(spark, n))
        table.apply(spark.createDataFrame(done[-1], ROWS), n)
        table.apply(spark.createDataFrame([(1, "again", 99)], ROWS), n)  # repeated number: left alone
        assert len(table.manifest().changes) < 4
    assert held(table) == replay(done)
    assert table.manifest().last_batch == 10
    assert len(table.read().inputFiles()) < 4 * 8 + 8


@pytest.mark.parametrize("step", ["write", "publish", "fold write", "fold publish"])
def test_crash_leaves_the_old_version_and_a_repeat_heals(spark, table, monkeypatch, step):
    done = [batch(spark, n) for n in range(4)]
    for n in range(3):
        table.apply(spark.createDataFrame(done[n], ROWS), n)
    before = held(table)
    real = {"write": table._write, "publish": table._publish}
    calls = {"write": 0, "publish": 0}
    kind = step.split()[-1]
    wanted = 2 if step.startswith("fold") else 1

    def broken(*args):
        calls[kind] += 1
        if calls[kind] == wanted:
            raise OSError("executor lost")
        return real[kind](*args)

    monkeypatch.setattr(table, f"_{kind}", broken)
    with pytest.raises(OSError):
        table.apply(spark.createDataFrame(done[3], ROWS), 3)
    assert held(table) == (replay(done) if step.startswith("fold") else before)
    monkeypatch.undo()
    again = VersionedTable(spark, table.path, ["k"], ["pos"], most=4)
    again.apply(spark.createDataFrame(done[3], ROWS), 3)
    assert held(again) == replay(done)
    again.apply(spark.createDataFrame(batch(spark, 4), ROWS), 4)
    assert held(again) == replay([*done, batch(spark, 4)]) and len(again.manifest().changes) < 4


def test_two_writers_cannot_make_one_version(spark, table):
    now = table.manifest()
    table.apply(spark.createDataFrame([(1, "x", 1)], ROWS), 0)
    with pytest.raises(RuntimeError):
        table._publish(type(now)(now.version + 1, now.base))
    assert held(table)[1] == "x"


def test_a_reader_keeps_its_version(spark, table):
    reader = table.read()
    for n in range(5):
        table.apply(spark.createDataFrame(batch(spark, n), ROWS), n)
    assert {r.v for r in reader.collect()} == {"base"}


def test_stream_in_many_batches(spark, tmp_path):
    done = [batch(spark, n) for n in range(9)]
    for n, rows in enumerate(done):
        spark.createDataFrame([(k, v, n * 100 + p) for k, v, p in rows], ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    base = spark.createDataFrame([(i, "base", 0) for i in range(20)], ROWS)
    got = jobs.upsert_stream(stream, ["k"], ["pos"], base, most=3)
    assert {r.k: r.v for r in got.collect()} == replay(done)
