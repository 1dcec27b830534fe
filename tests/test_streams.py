"""The stream filter with history: late events, higher order, classes, silent states, a restart."""

import datetime as dt
import math
import time

import numpy as np
import pytest

from hiddenpath.operators import decoding
from hiddenpath.plans.catalog import NORMAL, ORDER1, PLAIN, SILENT, SWITCHING
from hiddenpath.streaming import online

START = dt.datetime(2024, 1, 1)
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "user long, ts timestamp, v double, c int"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, tmp_path, batches, model, classes=None, restarts=False):
    """Rows written as files, a file a batch; the query is stopped and started again between two files if wanted."""
    source, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(source)
    for k, rows in enumerate(batches):
        time.sleep(1.1)  # files are taken in the order of their times
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        if not restarts and k < len(batches) - 1:
            continue
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        query = online.online_history(stream, model, "user", "ts", "v", "10 seconds", classes).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
        query.stop()
    return spark.read.parquet(out)


def whole(spark, rows, model, classes=False):
    """The log-likelihood of each user's events up to each, by the batch operator."""
    out = {}
    for user in {r[0] for r in rows}:
        mine = sorted(((r[1], r[2], r[3]) for r in rows if r[0] == user), key=lambda r: r[0])
        parts = [(k, [x[1] for x in mine[: k + 1]], [x[2] for x in mine[: k + 1]]) for k in range(len(mine))]
        d = spark.createDataFrame(parts, "seq_id int, obs array<double>, c array<int>")
        for r in decoding.decode(d, model, ["logp"], classes="c" if classes else None).collect():
            out[user, mine[r.seq_id][0]] = r.logp
    return out


@pytest.mark.parametrize("model,classes,restarts", [(ORDER1, None, True), (SWITCHING, "c", False), (SILENT, None, False)])
def test_equals_the_batch_operator(rocks, tmp_path, model, classes, restarts):
    """Events that come out of order, inside the delay, give what the sorted sequence gives."""
    rng = np.random.default_rng(4)
    rows = [(u, START + dt.timedelta(seconds=k), None if k == 4 else float(rng.integers(0, 5)), int(rng.integers(0, 2))) for u in (1, 2) for k in range(12)]
    mixed = sorted(rows, key=lambda r: r[1].timestamp() + rng.uniform(0, 6))
    end = [(99, START + dt.timedelta(seconds=s), 0.0, 0) for s in (100, 200)]
    got = {(r.user, r.ts): r for r in run(rocks, tmp_path, [mixed[:8], mixed[8:16], [*mixed[16:], end[0]], [end[1]]], model, classes, restarts).collect() if r.user != 99}
    want = whole(rocks, rows, model, classes is not None)
    assert {k: r.logp for k, r in got.items()} == pytest.approx(want)
    assert all(sum(r.alpha) == pytest.approx(1) if math.isfinite(r.logp) else r.alpha == [] for r in got.values())


def test_late_events_are_dropped(rocks, tmp_path):
    first = [(1, START + dt.timedelta(seconds=s), v, 0) for s, v in ((0, 80.0), (40, 200.0))]
    late = [(1, START + dt.timedelta(seconds=1), 400.0, 0), (1, START + dt.timedelta(seconds=50), 90.0, 0)]
    rows = run(rocks, tmp_path, [first, late, [(1, START + dt.timedelta(seconds=300), 80.0, 0)], [(2, START + dt.timedelta(seconds=600), 80.0, 0)]], NORMAL, restarts=True).orderBy("user", "ts").collect()
    assert [(r.ts - START).seconds for r in rows if r.user == 1] == [0, 40, 50, 300]
    kept = [first[0], first[1], late[1], (1, START + dt.timedelta(seconds=300), 80.0, 0)]
    assert [r.logp for r in rows if r.user == 1] == pytest.approx([v for _, v in sorted(whole(rocks, kept, NORMAL).items())])


def test_classes_are_needed(spark):
    with pytest.raises(ValueError, match="classes"):
        online.online_history(spark.createDataFrame([], SCHEMA), SWITCHING, "user", "ts", "v", "1 second")


def test_steps_are_those_of_the_recursion(spark):
    d = spark.createDataFrame([(1, [0, 4, 2, 1])], "seq_id int, obs array<int>")
    from hiddenpath.functions import chain

    alpha, logp = None, 0.0
    for x in [0, 4, 2, 1]:
        alpha, total = chain.advance(PLAIN, alpha, chain.emissions(PLAIN, np.array([[float(x)]]))[0, 0])
        logp += math.log(total)
    assert logp == pytest.approx(decoding.decode(d, PLAIN, ["logp"]).first().logp)
    assert chain.advance(PLAIN, alpha, np.zeros(3))[1] == 0
