import random
import time

import pytest
from pyspark.sql import functions as F

from cuadra.streaming import agent
from cuadra.streaming.blocks import closed_blocks
from cuadra.streaming.lease import Lease, LeaseHeldError

KIND = "doc string, pos long, label string, amount double, terminal boolean, lines long"


def _folded(rows):
    """Blocks of (doc, pos, label, amount, terminal), one document after the other."""
    out, state = [], {}
    for doc, _, label, amount, terminal in sorted(rows, key=lambda r: (r[0], r[1])):
        block, held = state.setdefault(doc, [0, {}])
        if label is not None and amount is not None and amount > 0:
            held[label] = amount
            if terminal:
                out += [(doc, block, k, v) for k, v in held.items()]
                state[doc] = [block + 1, {}]
    return sorted(out)


def _lines(seed, docs=6, n=60):
    rng = random.Random(seed)
    return [(f"d{d}", p, rng.choice(["a", "b", "net", None]), rng.choice([1.0, 2.5, 0.0, -1.0, None, 7.0]), rng.random() < 0.2) for d in range(docs) for p in range(n)]


def _stream(spark, path, batches):
    for rows in batches:
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(path)


def test_lines_out_of_order_in_several_batches(spark, tmp_path):
    rows = _lines(1)
    rng = random.Random(2)
    placed = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 10))  # fewer than 11 lines of a document overtake one
    cut = len(placed) // 4
    batches = [[(*r, 60) for r in placed[k * cut : (k + 1) * cut]] for k in range(4)]
    got = closed_blocks(_stream(spark, str(tmp_path / "in"), batches), slack=11).writeStream.format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    got.awaitTermination(100)
    assert sorted(tuple(r) for r in spark.table("folded").collect()) == _folded(rows)


def test_late_lines_are_given_back(spark, tmp_path):
    batches = [[("d", 5, "a", 1.0, False, None), ("d", 6, "net", 2.0, True, None)], [("d", 1, "late", 3.0, True, None), ("d", 6, "net", 2.0, True, None), ("d", 7, "net", 4.0, True, None)]]
    got = closed_blocks(_stream(spark, str(tmp_path / "in"), batches)).writeStream.format("memory").queryName("lates").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    got.awaitTermination(100)
    assert {tuple(r) for r in spark.table("lates").collect()} == {("d", 0, "a", 1.0), ("d", 0, "net", 2.0), ("d", None, "late", 3.0), ("d", None, "net", 2.0), ("d", 1, "net", 4.0)}


def test_numbers_go_on_after_a_timeout(spark, tmp_path):
    at = str(tmp_path / "in")
    stream = _stream(spark, at, [[("d", 1, "a", 1.0, False, None), ("d", 2, "net", 2.0, True, None), ("d", 3, "b", 5.0, False, None)]])
    run = closed_blocks(stream, timeout="1 second", slack=9).writeStream.format("memory").queryName("paused").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()

    def until(n):
        end = time.time() + 60
        while time.time() < end and spark.table("paused").count() < n:
            time.sleep(0.5)

    try:
        until(2)
        spark.createDataFrame([("d", 4, "net", 3.0, True, None)], KIND).coalesce(1).write.mode("append").parquet(at)
        until(4)
    finally:
        run.stop()
    assert {tuple(r) for r in spark.table("paused").collect()} == {("d", 0, "a", 1.0), ("d", 0, "net", 2.0), ("d", 1, "b", 5.0), ("d", 1, "net", 3.0)}


def _entries(spark, names, status="OK"):
    return spark.createDataFrame([(n, status) for n in names], "name string, status string").select("name", "status", F.current_timestamp().alias("ts"), F.lit("").alias("message"))


def test_batches_are_recorded_once(spark, tmp_path):
    at = str(tmp_path / "ledger")
    assert agent.read_ledger(spark, at).count() == 0
    runs = []

    def process(names, fails=False):
        def run():
            runs.append(names)
            if fails:
                raise RuntimeError("killed")
            return _entries(spark, names)

        return run

    with pytest.raises(RuntimeError):
        agent.record(spark, at, "s", 0, process("ab", fails=True))
    assert agent.record(spark, at, "s", 0, process("ab")) and not agent.record(spark, at, "s", 0, process("cd"))
    assert agent.record(spark, at, "s", 1, process("e")) and agent.record(spark, at, "t", 0, process("f"))
    assert agent.record(spark, at, "s", 2, process("")) and agent.record(spark, at, "s", 2, process("g"))  # an empty batch leaves nothing
    assert sorted(r.name for r in agent.read_ledger(spark, at).collect()) == list("abefg") and runs == ["ab", "ab", "e", "f", "", "g"]


def test_a_write_that_ends_halfway_leaves_nothing(spark, tmp_path):
    at = str(tmp_path / "ledger")
    bad = _entries(spark, "abc").withColumn("message", F.when(F.col("name") == "c", F.raise_error(F.lit("disk"))).otherwise(F.col("name")).cast("string"))
    with pytest.raises(Exception, match="disk"):
        agent.record(spark, at, "s", 0, lambda: bad)
    assert agent.read_ledger(spark, at).count() == 0
    assert agent.record(spark, at, "s", 0, lambda: _entries(spark, "abc")) and agent.read_ledger(spark, at).count() == 3


def test_retention_reads_only_its_days(spark, tmp_path):
    from cuadra.operators.ingest import retained

    at = str(tmp_path / "ledger")
    for k, day in enumerate(["2024-01-01", "2024-01-09", "2024-01-10"]):
        agent.record(spark, at, "s", k, lambda k=k, day=day: _entries(spark, [f"f{k}"]).withColumn("ts", F.lit(f"{day} 10:00:00").cast("timestamp")))
    kept = retained(agent.read_ledger(spark, at), F.lit("2024-01-16 12:00:00").cast("timestamp"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "day" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert [r.name for r in kept.collect()] == ["f2"]


def test_old_days_are_compacted(spark, tmp_path):
    from cuadra.operators.ingest import compacted

    at = str(tmp_path / "ledger")
    rows = [("2024-01-01", "a", "ERROR"), ("2024-01-01", "b", "OK"), ("2024-01-02", "a", "OK"), ("2024-01-03", "c", "OK"), ("2024-01-05", "a", "ERROR"), ("2024-01-05", "d", "OK")]
    for k, day in enumerate(sorted({r[0] for r in rows})):
        agent.record(spark, at, f"s{k % 2}", k, lambda day=day: spark.createDataFrame([r[1:] for r in rows if r[0] == day], "name string, status string").select("*", F.lit(f"{day} 10:00:00").cast("timestamp").alias("ts"), F.lit("").alias("message")))
    before = sorted(map(tuple, agent.read_ledger(spark, at).collect()))
    assert compacted(spark, at, "2024-01-05") == 1 and compacted(spark, at, "2024-01-05") == 0
    after = sorted(map(tuple, agent.read_ledger(spark, at).collect()))
    assert [r for r in before if r not in after] == [r for r in before if (r[0], r[1], str(r[4])) == ("a", "ERROR", "2024-01-01")] and len(after) == 5
    (tmp_path / "ledger" / "_replaced").mkdir()
    (tmp_path / "ledger" / "day=2024-01-03").rename(tmp_path / "ledger" / "_replaced" / "day=2024-01-03")  # a run that ended halfway
    assert compacted(spark, at, "2030-01-01") == 1 and not [n for n in (tmp_path / "ledger").iterdir() if n.name.startswith(("_compacted", "_replaced"))]
    assert sorted((r.name, r.status) for r in agent.read_ledger(spark, at).collect()) == [("a", "ERROR"), ("b", "OK"), ("c", "OK"), ("d", "OK")]


def test_lease(spark, tmp_path):
    at = str(tmp_path / "l")
    a = Lease(spark, at, "a").acquire()
    with pytest.raises(LeaseHeldError):
        Lease(spark, at, "b").acquire()
    a.renew()
    again = Lease(spark, at, "a").acquire()  # the same owner after a crash
    with pytest.raises(LeaseHeldError):
        a.renew()
    b = Lease(spark, at, "b", hours=0).acquire()  # the lease has run out
    with pytest.raises(LeaseHeldError):
        again.renew()
    b.renew()
    b.release()
    c = Lease(spark, at, "c").acquire()
    assert c.number == 4
    with pytest.raises(LeaseHeldError):
        c._create(c._path(5), "d") and c.renew()


def test_of_many_that_try_one_gets_the_lease(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def attempt(k):
        try:
            return Lease(spark, str(tmp_path / "l"), f"o{k}").acquire().owner
        except LeaseHeldError:
            return None

    with ThreadPoolExecutor(8) as pool:
        assert sum(x is not None for x in pool.map(attempt, range(24))) == 1


def test_second_stream_on_a_ledger_is_refused(spark, tmp_path):
    folder, ledger = tmp_path / "in", str(tmp_path / "ledger")
    folder.mkdir()
    process = lambda groups: groups.select("document", F.lit("OK").alias("status"), F.lit("").alias("message"))
    start = lambda name: agent.watch(spark, str(folder), ["pdf"], ledger, str(tmp_path / name), process, interval="1 second")
    first = start("one")
    try:
        with pytest.raises(LeaseHeldError):
            start("two")
    finally:
        first.stop()
    end = time.time() + 30
    while True:  # the lease is given back when the query has ended
        try:
            start("two").stop()
            break
        except LeaseHeldError:
            assert time.time() < end
            time.sleep(0.5)
