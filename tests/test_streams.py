"""Stream jobs that stop, restart, replay and compact."""

import datetime as dt
import os
import shutil

import pytest
from conftest import rows

from panelweave.streaming import jobs as Z, partials as P

QUOTES = "ticker string, ts timestamp_ntz, event_id long, price double, volume long"
NEWS = "doc_id long, ticker string, date string, title string, content string"


def add(spark, path, schema, *files):
    for f in files:
        spark.createDataFrame(f, schema).coalesce(1).write.mode("append").parquet(path)


def quote(i, day=5, volume=10):
    return ("A", dt.datetime(2024, 1, day, 9, 0, i % 60), i, float(i), volume)


def folders(path):
    return [f for f in os.listdir(f"{path}/part") if not f.startswith(".")]


def test_restart_with_another_batch_size_and_new_files(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    add(spark, src, QUOTES, *[[quote(i)] for i in range(6)])
    Z.collect_daily(Z.read_stream(spark, src, 1), out)
    assert rows(Z.daily_table(spark, out), "price", "volume") == [(5.0, 60)]
    Z.collect_daily(Z.read_stream(spark, src, 3), out)  # nothing new
    assert rows(Z.daily_table(spark, out), "price", "volume") == [(5.0, 60)]
    add(spark, src, QUOTES, [quote(7)], [quote(6, volume=1)])
    Z.collect_daily(Z.read_stream(spark, src, 3), out)
    assert rows(Z.daily_table(spark, out), "price", "volume") == [(7.0, 71)]


def test_second_source_of_one_target(spark, tmp_path):
    one, two, out = (str(tmp_path / n) for n in ("one", "two", "out"))
    add(spark, one, QUOTES, [quote(1)], [quote(2)])
    add(spark, two, QUOTES, [quote(9, volume=5)])
    Z.collect_daily(Z.read_stream(spark, one), out)
    Z.collect_daily(Z.read_stream(spark, two), out, name="two")
    assert rows(Z.daily_table(spark, out), "price", "volume") == [(9.0, 25)]


def test_many_batches_leave_few_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "FAN", 3)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    add(spark, src, QUOTES, *[[quote(i, volume=1)] for i in range(29)])
    Z.collect_daily(Z.read_stream(spark, src, 1), out)
    assert rows(Z.daily_table(spark, out), "price", "volume") == [(28.0, 29)]
    live = P.Marker(spark, out).read()["live"]
    assert sorted(k for k, _ in live) == [0, 0, 3] and len(folders(out)) <= 6 and len(os.listdir(f"{out}/_live")) <= 6


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "FAN", 2)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    add(spark, src, QUOTES, *[[quote(i)] for i in range(4)])
    Z.collect_daily(Z.read_stream(spark, src, 1), out)
    commits = f"{out}/_checkpoint/main/commits"
    for name in os.listdir(commits):  # the engine forgets that the last batch ended: it runs again
        if name.lstrip(".").startswith("3"):
            os.remove(f"{commits}/{name}")
    Z.collect_daily(Z.read_stream(spark, src, 1), out)
    assert rows(Z.daily_table(spark, out), "price", "volume") == [(3.0, 40)]


def test_a_crash_between_folder_and_marker(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    add(spark, src, QUOTES, [quote(1)], [quote(2)])

    class Stop(RuntimeError):
        pass

    real = P.Marker.write
    calls = []

    def fails(self, state):
        calls.append(1)
        if len(calls) == 2:
            raise Stop("no marker")
        real(self, state)

    P.Marker.write = fails
    try:
        with pytest.raises(Exception):
            Z.collect_daily(Z.read_stream(spark, src, 1), out)
    finally:
        P.Marker.write = real
    assert rows(Z.daily_table(spark, out), "volume") == [(10,)]  # the half-done batch isn't seen
    with open(f"{out}/_live/2", "w") as f:
        f.write('{"live": [')  # nor is a marker that was cut
    assert rows(Z.daily_table(spark, out), "volume") == [(10,)]
    Z.collect_daily(Z.read_stream(spark, src, 1), out)
    assert rows(Z.daily_table(spark, out), "volume") == [(20,)]


def test_every_article_leaves_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    news = lambda i, text: (i, "A", "2024-01-01", "t", text)
    add(spark, src, NEWS, [news(1, "a"), news(2, "a")], [news(3, "b")], [news(4, "a"), news(5, "c")])
    Z.collect_articles(Z.read_stream(spark, src, 1), out)
    first = rows(Z.first_articles(spark, out), "article_hash")
    assert len(first) == len(set(first)) == 3
    parts = {f for f in os.listdir(out) if f.endswith(".parquet")}
    shutil.copytree(src, str(tmp_path / "kept"))
    for f in os.listdir(src):  # files that were read once aren't needed again
        if f.endswith(".parquet"):
            open(f"{src}/{f}", "wb").close()
    add(spark, src, NEWS, [news(6, "b"), news(7, "d")], [news(8, "d"), news(9, "a")])
    schema = Z.read_stream(spark, str(tmp_path / "kept")).schema
    again = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(src)
    Z.collect_articles(again, out)
    got = rows(Z.first_articles(spark, out), "article_hash")
    assert len(got) == len(set(got)) == 4 and set(first) < set(got)
    assert parts < {f for f in os.listdir(out) if f.endswith(".parquet")}


def test_latest_quotes_fold_over_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "FAN", 2)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    add(spark, src, QUOTES, [("A", dt.datetime(2024, 1, 5, 13, 0), 1, 5.0, 1)], [("A", dt.datetime(2024, 1, 5, 20, 0), 2, 6.0, 2)],
        [("B", dt.datetime(2024, 1, 5, 20, 0), 3, -1.0, 2)], [("B", dt.datetime(2024, 1, 4, 20, 0), 4, 7.0, 2)])
    Z.collect_latest_quotes(Z.read_stream(spark, src, 1), "premarket", out)
    assert rows(Z.latest_quote_now(spark, "premarket", out), "ticker", "price", "event_id") == [("A", 5.0, 1), ("B", 7.0, 4)]


def test_quote_priority_and_its_sql_agree_on_odd_prices(spark, tmp_path):
    import check
    from __spark_entry__ import oracle_sql, queries

    odd = [0.0, -0.5, -1.0, -2.5, None, float("nan"), float("inf"), 3.0]
    rows = [(i, 1, dt.datetime(2024, 1, 5, (i * 5) % 24), "view", odd[i % 8], "{}") for i in range(840)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double, props string").write.parquet(f"{tmp_path}/e")
    con = check.duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/e/*.parquet')")
    spark.read.parquet(f"{tmp_path}/e").write.parquet(f"{tmp_path}/events.parquet")
    ok, note = check.compare(queries()["quote_source_priority"](spark, str(tmp_path)), con, oracle_sql()["quote_source_priority"])
    assert ok, note
