"""I4: offers per cycle equal a replay in batch; late, early and repeated receipts."""
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from revlens.registry import QUERIES
from revlens.streaming.posting import posting_offers
from revlens.streaming.streams import run_to_table, timers

DAY = timedelta(days=1)


def at(day, hour):
    return datetime(2024, 1, day, hour)


def offered(spark, tmp_path, batches, days=7):
    """Runs the stream over one file per batch: rows (id, is_receipt, time); sorted (id, day) of the offers."""
    schema = "id string, is_receipt boolean, t timestamp"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/n={n}")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    f = s.where("not is_receipt").select("id", F.col("t").alias("created_at"), F.col("t").alias("ready_at"))
    r = s.where("is_receipt").select(F.col("id").alias("finding_id"), F.col("t").alias("received_at"))
    with timers(spark):
        out = run_to_table(posting_offers(f, r, 24, days), "offers", folder=f"{tmp_path}/run").collect()
    assert all(o.offered_at == at(1, 0) + (o.offered_at - at(1, 0)).days * DAY for o in out)
    return sorted((o.id, o.offered_at.day) for o in out), out


def replay(batches, until, days=7):
    """Every cycle in turn over all rows, as a job that looks at tables would see them."""
    made, got = {}, {}
    for name, is_receipt, t in (row for b in batches for row in b):
        if is_receipt:
            got[name] = min(t, got.get(name, t))
        else:
            made.setdefault(name, t)
    cycles = [at(1, 0) + k * DAY for k in range(40)]
    return sorted((name, c.day) for name, t in made.items() for c in cycles
                  if t <= c < t + days * DAY and c < until and not (name in got and got[name] <= c))


def test_offers_until_the_receipt(spark, tmp_path):
    batches = [[("a", False, at(1, 5)), ("b", False, at(1, 6)), ("a", False, at(1, 7))],
               [("a", True, at(3, 7)), ("c", False, at(2, 0)), ("d", True, at(5, 7))],   # d's receipt comes before d
               [("a", True, at(4, 7)), ("d", False, at(4, 5)), ("b", True, at(9, 9)), ("b", True, at(6, 9))],
               [("end", False, at(20, 1))]]
    got, rows = offered(spark, tmp_path, batches)
    assert got == replay(batches, at(20, 1))
    assert [x for x in got if x[0] == "a"] == [("a", 2), ("a", 3)]
    assert sorted(o.cycle for o in rows if o.id == "c") == list(range(7))


def test_receipt_after_the_watermark_stops_what_is_left(spark, tmp_path):
    batches = [[("a", False, at(1, 5))], [("x", False, at(4, 1))], [("y", False, at(4, 2))], [("a", True, at(2, 1))],
               [("end", False, at(20, 1))]]
    got, _ = offered(spark, tmp_path, batches)
    assert [x for x in got if x[0] == "a"] == [("a", 2), ("a", 3), ("a", 4)]


def test_rows_without_id_or_time(spark, tmp_path):
    batches = [[(None, False, at(1, 5)), ("n", False, None), (None, True, at(1, 5)), ("n", True, None)], [("end", False, at(9, 1))]]
    assert offered(spark, tmp_path, batches)[0] == []


def test_query_has_a_row_per_finding_and_cycle(spark, sf_dir):
    out = QUERIES["stream_posting_offers"](spark, sf_dir)
    assert out.count() == out.select("id", "cycle").distinct().count() > 0


def test_findings_of_one_slot(spark, tmp_path, monkeypatch):
    from revlens.streaming import posting
    monkeypatch.setattr(posting, "SLOTS", 2)
    batches = [[(f"f{n}", False, at(1 + n % 5, n % 24)) for n in range(60)],
               [(f"f{n}", True, at(2 + n % 7, 5)) for n in range(0, 60, 3)],
               [("late", False, at(8, 3)), ("f1", False, at(9, 1)), ("f2", True, at(9, 2))], [("end", False, at(25, 1))]]
    got, _ = offered(spark, tmp_path, batches)
    assert got == replay(batches, at(25, 1))


def test_state_is_called_per_slot_not_per_finding():
    calls, stored = [], []

    class Handle:
        def getValueState(self, name, schema):
            return self

        def get(self):
            calls.append("get")
            return stored[-1] if stored else None

        def update(self, value):
            calls.append("update")
            stored.append(value)

        def registerTimer(self, t):
            calls.append(("timer", t))

        def deleteTimer(self, t):
            calls.append(("delete", t))

    class Watermark:
        def getCurrentWatermarkInMs(self):
            return 0

    from pyspark.sql import Row

    from revlens.streaming.posting import HOUR_MS, PostingRetry
    p = PostingRetry(24, 7)
    p.init(Handle())
    rows = [Row(id=f"f{n}", is_receipt=False, ready=n, at_ms=n) for n in range(1, 1001)]
    assert list(p.handleInputRows((0,), iter(rows), Watermark())) == []
    assert calls == ["get", "update", ("timer", 24 * HOUR_MS + 1)]
    assert len(stored[0][0]) == 1000 and len(stored[0][1]) == 4000
