"""Running totals, keyed state, intake and reminders across batches, replays and failures."""

import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import assets as A
from tallyspark.operators import changes as M
from tallyspark.streaming import calendar
from tallyspark.streaming import jobs as J

TX = "owner_id BIGINT, tx_id STRING, ts TIMESTAMP, type STRING, amount_minor BIGINT, category_id BIGINT"


def deliver(spark, tmp_path, rows, schema, start):
    """One more file of rows, and the job run to its end."""
    folder = f"{tmp_path}/in"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    query = start(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))
    query.awaitTermination()
    return query


def forget_last_commit(tmp_path):
    """The job ended after its last batch had written, before the batch was committed: it will be replayed."""
    commits = f"{tmp_path}/ck/commits"
    last = max(int(n) for n in os.listdir(commits) if n.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{commits}/{name}"):
            os.remove(f"{commits}/{name}")


def at(day, hour=12):
    return dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=day)


def test_totals_follow_each_delivery(spark, tmp_path):
    out = f"{tmp_path}/out"
    start = lambda df: J.stream_spend(df, out, f"{tmp_path}/ck")
    day = lambda: {(r["owner_id"], r["category_id"], r["day"].day): (r["amount_minor"], r["n_rows"]) for r in J.read_spend(spark, out, "day").collect()}
    deliver(spark, tmp_path, [(1, "a", at(0), "EXPENSE", 5, 1), (1, "b", at(1), "EXPENSE", 7, 1), (1, "i", at(9), "INCOME", 99, 1)], TX, start)
    assert day() == {(1, 1, 1): (5, 1), (1, 1, 2): (7, 1)}
    deliver(spark, tmp_path, [(1, "c", at(1, 1), "EXPENSE", 1, 1), (2, "d", at(4), "EXPENSE", 3, None)], TX, start)
    assert day() == {(1, 1, 1): (5, 1), (1, 1, 2): (8, 2), (2, None, 5): (3, 1)}
    untouched = glob.glob(f"{out}/day/day=2024-01-01/v=*")
    deliver(spark, tmp_path, [(1, "late", at(0), "EXPENSE", 100, 1), (1, "none", None, "EXPENSE", 1000, 1), (1, "e", at(3), "EXPENSE", 2, 1)], TX, start)
    assert day() == {(1, 1, 1): (5, 1), (1, 1, 2): (8, 2), (1, 1, 4): (2, 1), (2, None, 5): (3, 1)}
    assert sorted(r["tx_id"] for r in J.read_late(spark, out).collect()) == ["late", "none"]
    assert {(r["owner_id"], r["month"].month): r["amount_minor"] for r in J.read_spend(spark, out, "month").collect()} == {(1, 1): 15, (2, 1): 3}
    assert glob.glob(f"{out}/day/day=2024-01-01/v=*") == untouched


def test_totals_after_a_replay_and_against_the_batch(spark, tmp_path):
    rng = random.Random(4)
    out, rows = f"{tmp_path}/out", []
    start = lambda df: J.stream_spend(df, out, f"{tmp_path}/ck")
    for k in range(5):
        some = [(rng.randrange(3), f"{k}-{i}", at(k * 2 - rng.randrange(7), rng.randrange(24)), "EXPENSE", rng.randrange(100), rng.randrange(2)) for i in range(40)]
        rows += some
        deliver(spark, tmp_path, some, TX, start)
        before = sorted(map(str, J.read_spend(spark, out).collect()))
        forget_last_commit(tmp_path)
        start(spark.readStream.schema(TX).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")).awaitTermination()
        assert sorted(map(str, J.read_spend(spark, out).collect())) == before
    late = J.read_late(spark, out)
    assert late.count() > 0
    total = J.read_spend(spark, out).agg(F.sum("amount_minor"), F.sum("n_rows")).first()
    assert total[0] + late.agg(F.sum("amount_minor")).first()[0] == sum(r[4] for r in rows) and total[1] + late.count() == len(rows)
    assert max(len(os.listdir(p)) for p in glob.glob(f"{out}/day/day=*")) <= 3  # two versions and the replayed one at most


USE = "owner_id BIGINT, merchant_name STRING, category_id BIGINT, used_at BIGINT, seq BIGINT"


def test_merchant_use_writes_what_changed(spark, tmp_path):
    out = f"{tmp_path}/out"
    start = lambda df: J.stream_merchant_use(df, out, f"{tmp_path}/ck")
    first = [(1, f" Shop  {i} ", 1, i, i) for i in range(300)] + [(1, "  ", 1, 0, 0)]
    deliver(spark, tmp_path, first, USE, start)
    second = [(1, "SHOP 7", 2, 400, 400), (2, "new", 3, 401, 401)]
    deliver(spark, tmp_path, second, USE, start)
    assert spark.read.parquet(f"{out}/v=0").count() == 300 and spark.read.parquet(f"{out}/v=1").count() == 2
    want = M.fold_merchant_use(spark.createDataFrame([], J.MERCHANT_STATE), spark.createDataFrame(first + second, USE))
    got = lambda: sorted(map(str, J.read_latest(spark, out, J.MERCHANT_STATE, J.MERCHANT_KEYS).collect()))
    assert got() == sorted(map(str, want.collect()))
    forget_last_commit(tmp_path)
    start(spark.readStream.schema(USE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")).awaitTermination()
    assert got() == sorted(map(str, want.collect()))


CONFIRM = "owner_id BIGINT, normalized_item STRING, normalized_merchant STRING, category_id BIGINT, ts BIGINT, seq BIGINT"


def test_confirmations_against_the_batch_fold(spark, tmp_path):
    """Runs that go on, restart and end within a batch and across batches; rows of a batch in any order."""
    rng = random.Random(9)
    out, rows, seq = f"{tmp_path}/out", [], 0
    start = lambda df: J.stream_confirmations(df, out, f"{tmp_path}/ck")
    got = lambda: sorted(map(str, J.read_latest(spark, out, J.MAPPING_STATE, J.MAPPING_KEYS).collect()))
    for k in range(4):
        some = []
        for _ in range(120 if k % 2 == 0 else 6):
            seq += 1
            some.append((rng.randrange(2), rng.choice(["milk", "tea", " "]), rng.choice([None, "shop", "-"]), rng.choice([1, 1, 2]), seq, seq))
        rows += some
        deliver(spark, tmp_path, rng.sample(some, len(some)), CONFIRM, start)
        want = sorted(map(str, M.fold_confirmations(spark.createDataFrame([], J.MAPPING_STATE), spark.createDataFrame(rows, CONFIRM)).collect()))
        assert got() == want
    forget_last_commit(tmp_path)
    start(spark.readStream.schema(CONFIRM).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")).awaitTermination()
    assert got() == want
    assert spark.read.parquet(f"{out}/v=3").count() <= 12


def test_confirmations_are_folded_without_python(spark, tmp_path):
    """Only touched buckets get a new version, two of which stay; keys without an owner and times that tie are whole; a mapping is forgotten."""
    out = f"{tmp_path}/out"
    start = lambda df: J.stream_confirmations(df, out, f"{tmp_path}/ck")
    deliver(spark, tmp_path, [(i, "milk", None, 1, i, i) for i in range(40)] + [(None, "milk", None, 3, 1, 1), (7, "tea", None, None, 1, 1)], CONFIRM, start)
    query = deliver(spark, tmp_path, [(None, "milk", None, 3, 5, 5), (3, "milk", None, 2, 9, 9), (3, "milk", None, 1, 9, 9)], CONFIRM, start)
    assert not query.lastProgress["stateOperators"]
    deliver(spark, tmp_path, [(3, "milk", None, 2, 9, 10)], CONFIRM, start)
    got = {r.owner_id: (r.category_id, r.confirmation_count, r.created_at, r.updated_at) for r in J.read_latest(spark, out, J.MAPPING_STATE, J.MAPPING_KEYS).collect()}
    assert got == {i: (1, 1, i, i) for i in range(40)} | {None: (3, 2, 1, 5), 3: (2, 2, 3, 9)}
    assert [spark.read.parquet(f"{out}/v={v}").count() for v in range(3)] == [41, 2, 1]
    kept = sorted(len(os.listdir(p)) for p in glob.glob(f"{out}/state/bucket=*"))
    assert kept[-2:] == [2, 2] and set(kept[:-2]) == {1}
    deliver(spark, tmp_path, [(3, "milk", None, 2, 11, 11)], CONFIRM, lambda df: J.stream_confirmations(df, out, f"{tmp_path}/ck", keep=dt.timedelta(milliseconds=1)))
    assert [r.confirmation_count for r in spark.read.parquet(f"{out}/v=3").collect()] == [1]


PAY = "idempotency_key STRING, amount_minor BIGINT"


def test_intake_looks_up_only_the_buckets_it_touches(spark, tmp_path):
    sink = f"{tmp_path}/sink"
    start = lambda df: J.stream_payments(df, sink, f"{tmp_path}/ck", PAY)
    deliver(spark, tmp_path, [(f"k{i}", i) for i in range(500)] + [("k1", 0), (None, 1), (None, 2)], PAY, start)
    deliver(spark, tmp_path, [("k3", 9), ("fresh", 9), (None, 3)], PAY, start)
    assert sorted(r["idempotency_key"] or "" for r in J.read_versions(spark, sink, PAY).collect()) == sorted(["", "fresh", *[f"k{i}" for i in range(500)]])
    bucket = spark.createDataFrame([("k3",), ("fresh",)], "k STRING").select(F.pmod(F.xxhash64("k"), F.lit(J.BUCKETS)).alias("b"))
    touched = [r["b"] for r in bucket.distinct().collect()]
    found = J.history_of(spark, sink, ["idempotency_key"], PAY, touched, without=1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    read = [r[0] for r in found.select("_metadata.file_path").distinct().collect()]
    assert {int(p.split("bucket=")[1].split("/")[0]) for p in read} <= set(touched) and read and len(touched) == 2


def test_intake_forgets_nothing_beyond_the_state(spark, tmp_path):
    """A new checkpoint has no recent keys; the history still knows them."""
    sink = f"{tmp_path}/sink"
    deliver(spark, tmp_path, [("a", 1), ("b", 2)], PAY, lambda df: J.stream_payments(df, sink, f"{tmp_path}/ck", PAY))
    other = spark.createDataFrame([("b", 5), ("c", 6)], PAY)
    J.append_new(sink, ["idempotency_key"], PAY)(other, 1)
    J.append_new(sink, ["idempotency_key"], PAY)(other, 1)  # a replay
    assert sorted(tuple(r) for r in J.read_versions(spark, sink, PAY).collect()) == [("a", 1), ("b", 2), ("c", 6)]


@pytest.mark.parametrize("lost", ["never", "before the record", "after the record", "while posting", "after posting"])
def test_reminders_arrive_once(spark, tmp_path, monkeypatch, lost):
    """The job is lost between any two steps; the receiver counts each (rule, occurrence) once by its number."""
    outbox, received, posts, broken = f"{tmp_path}/outbox", {}, [], [lost]
    due = [("r1", "o1"), ("r2", "o1"), ("r2", "o1")]

    def fails(where):
        if broken[0] == where:
            broken[0] = "never"
            raise RuntimeError(where)

    def eligible(session, sent):
        fails("before the record")
        frame = session.createDataFrame(due, J.REMINDERS)
        return frame.join(sent, ["rule_id", "occurrence_key"], "left_anti")

    def post(rows):
        fails("after the record")
        got = rows.orderBy("number").collect()
        for i, r in enumerate(got):
            if i == 1:
                fails("while posting")
            posts.append((r["rule_id"], r["occurrence_key"]))
            received.setdefault((r["batch"], r["number"]), (r["rule_id"], r["occurrence_key"]))
        fails("after posting")

    def tick(rows):
        for attempt in range(2):
            try:
                if attempt == 0:
                    deliver(spark, tmp_path, rows, "n BIGINT", lambda df: J.stream_reminders(df, eligible, outbox, f"{tmp_path}/ck", post))
                else:
                    J.stream_reminders(spark.readStream.schema("n BIGINT").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), eligible, outbox, f"{tmp_path}/ck", post).awaitTermination()
                return
            except Exception as e:  # noqa: BLE001
                assert lost in str(e)

    tick([(1,)])
    due.append(("r3", "o2"))
    tick([(2,)])
    forget_last_commit(tmp_path)
    J.stream_reminders(spark.readStream.schema("n BIGINT").parquet(f"{tmp_path}/in"), eligible, outbox, f"{tmp_path}/ck", post).awaitTermination()
    assert sorted(received.values()) == [("r1", "o1"), ("r2", "o1"), ("r3", "o2")]
    assert lost in ("while posting", "after posting") or len(posts) == 3


def test_due_calendar_follows_the_full_list(spark, tmp_path):
    """Day after day the calendar's list is the full one, with events, a removed rule and a repeated tick; few items are evaluated."""
    day = dt.date(2024, 3, 1)
    assets = spark.createDataFrame([(i, 1, 1000 * i, i == 9) for i in range(40)], "asset_id BIGINT, owner_id BIGINT, current_km BIGINT, is_archived BOOLEAN")
    warranties = spark.createDataFrame([(i, i, f"W{i}", day + dt.timedelta(days=i * 3 - 20)) for i in range(40)], "warranty_id BIGINT, asset_id BIGINT, name STRING, end_date DATE")
    rules = [(100 + i, i, f"R{i}", True, ["TIME", "MILEAGE", "EITHER"][i % 3], 1, 5000, day - dt.timedelta(days=20 + i), 900 * i, 5 + i % 3, 200) for i in range(20)]
    schema = "rule_id BIGINT, asset_id BIGINT, title STRING, is_active BOOLEAN, trigger_type STRING, interval_months INT, interval_km BIGINT, baseline_date DATE, baseline_km BIGINT, warning_days INT, warning_km BIGINT"
    checkpoints = spark.createDataFrame([], "checkpoint_id BIGINT, asset_id BIGINT, title STRING, is_active BOOLEAN, due_date DATE, due_km BIGINT, repeat_months INT, repeat_km BIGINT, rescheduled_date DATE, rescheduled_km BIGINT, warning_days INT, warning_km BIGINT")
    event = "event_id BIGINT, rule_id BIGINT, checkpoint_id BIGINT, event_date DATE, created_at BIGINT, km BIGINT"
    events, evaluated = [], []
    for n in range(9):
        today, touched = day + dt.timedelta(days=n + (10 if n > 6 else 0)), list(range(40)) if n == 0 else []
        if n in (2, 5):
            events.append((n, 100 + n, None, today, n, 950 * n))
            touched = [n]
        if n == 4:
            rules = [r if r[0] != 107 else (*r[:3], False, *r[4:]) for r in rules]
            touched = [7]
        own_events = spark.createDataFrame(events, event)
        full = lambda a, d: A.attention(a, warranties, spark.createDataFrame(rules, schema), own_events, checkpoints, own_events, d)  # noqa: B023, E731
        some = spark.createDataFrame([(i,) for i in touched], "asset_id BIGINT")
        evaluate = lambda ids, d: full(assets.join(ids, "asset_id", "left_semi"), d)  # noqa: B023, E731
        evaluated.append(calendar.tick(spark, f"{tmp_path}/c", today, some, evaluate))
        if n == 5:
            assert calendar.tick(spark, f"{tmp_path}/c", today, some, evaluate) == evaluated[-1]
        want = sorted(str(tuple(r)) for r in full(assets, today).select(*calendar.STATUS).collect())
        assert sorted(str(tuple(r)) for r in calendar.attention_list(spark, f"{tmp_path}/c").collect()) == want
    assert evaluated[0] > 50 and max(evaluated[1:7]) < 12
