"""Stored tables that are merged in place, and streams whose state is in the stream."""

import datetime

import pytest

from lodestone.sources import shared, tables
from lodestone.streaming import quotes, state

DAY = datetime.date(2024, 1, 1)
KINDS = "symbol string, session date, a double, b string"


def day(n):
    return DAY + datetime.timedelta(days=n)


def rows(table, spark):
    return {(r["symbol"], r["session"]): (r["a"], r["b"]) for r in table.read(spark).collect()}


def test_a_merge_touches_the_partitions_it_has_rows_for(spark, tmp_path):
    made = tables.Table(f"{tmp_path}/t", KINDS, ("symbol", "session"), "month(session)").create(spark)
    old = [(s, day(n), float(n), "old") for s in ("x", "y", None) for n in range(0, 150, 10)]
    assert made.merge(spark.createDataFrame(old, KINDS)) == (45, 0)
    want = {(s, d): (a, b) for s, d, a, b in old}
    assert rows(made, spark) == want
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    new = [("x", day(0), None, None), ("x", day(5), 5.0, "new"), (None, day(10), 1.0, None), ("x", day(100), -1.0, "first"), ("x", day(100), -2.0, "again")]
    batch = spark.createDataFrame(new, KINDS)
    assert made.merge(batch.withColumn("nth", (batch["b"] == "again").cast("int")), "nth") == (1, 3)  # nulls overwrite, the last of a key counts
    want |= {("x", day(0)): (None, None), ("x", day(5)): (5.0, "new"), (None, day(10)): (1.0, None), ("x", day(100)): (-2.0, "again")}
    assert rows(made, spark) == want
    touched = {p.parent.name for p in files if not p.exists()}
    assert touched == {"part=1", "part=4"} and all(p.stat().st_mtime_ns == t for p, t in files.items() if p.exists())
    assert made.merge(batch.limit(0)) == (0, 0) and rows(made, spark) == want
    assert made.merge(batch.where("b = 'new'")) == (0, 1) and rows(made, spark) == want  # tried again
    plan = made.touched(spark, batch.where("b = 'new'").withColumn("part", made.place()))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "part" in plan.split("PartitionFilters")[1].split("]")[0]


def test_a_merge_tells_a_scan_of_many_partitions_by_a_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "LITERAL", 1)
    made = tables.Table(f"{tmp_path}/t", KINDS, ("symbol", "session"), "month(session)").create(spark)
    made.merge(spark.createDataFrame([("x", day(n), 1.0, "o") for n in range(0, 150, 10)], KINDS))
    assert made.merge(spark.createDataFrame([("x", day(0), 2.0, "n"), ("x", day(140), 2.0, "n")], KINDS)) == (0, 2)
    assert sorted(a for a, _ in rows(made, spark).values()) == [1.0] * 13 + [2.0] * 2


TICKS = "symbol string, ts timestamp, event_id long, version int, price double"


def tick(symbol, hours, event, price, version=0):
    return (symbol, datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(hours=hours), event, version, float(price))


def arriving(spark, *batches):
    return state.arriving(spark, [spark.createDataFrame(b, TICKS) for b in batches], 1)


def test_changes_with_replays_late_ticks_and_a_silent_symbol(spark):
    one = [tick("a", 0, 1, 5), tick("a", 1, 2, 5), tick("a", 2, 3, 6), tick("b", 0, 4, 9)]
    two = [tick("a", 2, 3, 6), tick("a", 1, 2, 5), tick("b", 5, 5, 9), tick("b", 4, 6, 8)]  # replayed ones, and b's in time order
    three = [tick("b", 24 * 20, 7, 9)]
    four = [tick("b", 24 * 20 + 1, 8, 7), tick("a", 3, 9, 4)]
    five = [tick("a", 3, 10, 1), tick("a", 24 * 20 + 2, 11, 6), tick("b", 24 * 20 + 3, 12, 7)]  # the first is behind the watermark; a was forgotten
    with state.state_store(spark):
        got = shared.finished(state.changes(arriving(spark, one, two, three, four, five))).collect()
    events = [r["event_id"] for r in got if r["symbol"] == "a"]
    assert sorted(e for e in events if e < 9) == [1, 3] and 10 not in events and 11 in events
    assert sorted(r["event_id"] for r in got if r["symbol"] == "b") == [4, 5, 6, 8]


def test_messages_tell_the_newest_close_and_its_change(spark):
    one = [tick("a", 1, 1, 10), tick("a", 2, 2, 20), tick("a", 25, 3, 30)]
    two = [tick("a", 3, 4, 25)]  # late, of the session before: no message, but the next change is from it
    three = [tick("a", 25, 3, 50, version=1), tick("b", 26, 5, 0)]
    four = [tick("a", 24.5, 6, 1), tick("a", 25, 3, 50, version=1)]  # before the close, and replayed
    five = [tick("b", 49, 7, 3), tick("a", 49, 8, 75)]
    with state.state_store(spark):
        got = sorted((r["symbol"], r["session"], r["close"], r["change_percent"]) for r in shared.finished(state.messages(arriving(spark, one, two, three, four, five))).collect())
    assert got == [
        ("a", "2024-01-02", "30.00", "50.0000"), ("a", "2024-01-02", "50.00", "100.0000"), ("a", "2024-01-03", "75.00", "50.0000"),
        ("b", "2024-01-02", "0.00", None), ("b", "2024-01-03", "3.00", None),
    ]


def test_windows_close_by_the_watermark_and_late_ticks_go(spark):
    batches = [[tick("a", h, h, h) for h in range(0, 30, 3)], [tick("a", 100, 200, 1)], [tick("a", 101, 201, 1)], [tick("a", 1, 202, 99)], [tick("a", 500, 203, 1)]]
    got = {r["start"].day: (r["high"], r["n"]) for r in shared.finished(quotes.bars(arriving(spark, *batches), "1 day")).collect() if r["start"].day < 3}
    assert got == {1: (21.0, 8), 2: (27.0, 2)}  # each written once, without the tick that came after


def test_changes_in_hour_buckets_agree_with_the_stream(spark):
    one = [tick("a", h / 4, h, (h * 7) % 5) for h in range(40)]
    two = [tick("a", 11 + h / 4, 100 + h, (h * 3) % 4) for h in range(20)]
    frames = [spark.createDataFrame(b, TICKS) for b in (one, two)]
    first, last = quotes.changes(frames[0], spark.createDataFrame([], quotes.LAST))
    second, _ = quotes.changes(frames[1], last)
    with state.state_store(spark):
        got = {r["event_id"] for r in shared.finished(state.changes(state.arriving(spark, frames, 1))).collect()}
    assert got == {r["event_id"] for r in first.collect()} | {r["event_id"] for r in second.collect()}


def test_create_keeps_what_is_there(spark, tmp_path):
    made = tables.Table(f"{tmp_path}/t", KINDS, ("symbol",), "symbol").create(spark)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        made.create(spark)


def test_ticks_of_a_day_become_its_close_before_the_state():
    """A symbol's state step gets a row a day and task, not all ticks."""
    at = lambda d, h: state.pd.Timestamp(f"2024-01-0{d} {h:02}:00", tz="UTC")
    rows = [("a", at(1 + i % 2, i % 20), i, 0, float(i)) for i in range(60)] + [("a", at(1, 18), 58, 1, 7.0)]
    frame = state.pd.DataFrame(rows, columns=["symbol", "ts", "event_id", "version", "price"])
    got = [r for b in state.closes(iter(state.pa.RecordBatch.from_pandas(frame.iloc[i : i + 9], preserve_index=False) for i in range(0, len(frame), 9))) for r in b.to_pylist()]
    assert sorted((r["ts"].day, r["event_id"], r["version"], r["price"]) for r in got) == [(1, 58, 1, 7.0), (2, 59, 0, 59.0)]
