import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tablescope.operators import events as evt
from tablescope.operators import usage as us
from tablescope.streaming import streams as st

T0 = dt.datetime(2024, 1, 1)


def brute_throttle(rows, window):
    kept, last = set(), {}
    for key, at, i in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in last or at - last[key] > window:
            last[key] = at
            kept.add(i)
    return kept


def frame(spark, rows):
    data = [(k, T0 + dt.timedelta(seconds=s), i) for k, s, i in rows]
    return spark.createDataFrame(data, "k string, ts timestamp, id long")


def test_throttle_boundary(spark):
    rows = [("a", s, i) for i, s in enumerate([0, 60, 119, 121, 200, 242])]
    got = {r["id"] for r in evt.throttle(frame(spark, rows), ["k"], "ts", "id").collect()}
    assert got == {0, 3, 5}
    rows = [("a", 0, 0), ("a", 120, 1), ("a", 120.000001, 2)]
    assert {r["id"] for r in evt.throttle(frame(spark, rows), ["k"], "ts", "id").collect()} == {0, 2}


@pytest.mark.parametrize("seed, spread", [(1, 4000), (2, 900), (3, 60000)])
def test_throttle_with_a_hot_key(spark, seed, spread):
    rnd = random.Random(seed)
    rows = [("hot" if i % 3 == 0 else f"k{rnd.randint(0, 20)}", rnd.randint(0, spread), i) for i in range(3000)]
    for window, chunk in ((120, 120), (120, 300), (37, 3600)):
        got = {r["id"] for r in evt.throttle(frame(spark, rows), ["k"], "ts", "id", window, chunk).collect()}
        assert got == brute_throttle(rows, window)


def test_only_page_views_with_an_actor_are_throttled(spark):
    rows = [(0, "page_view", "u", 0), (1, "page_view", "u", 5), (2, "page_view", None, 5), (3, "download", "u", 6), (4, "page_view", "u", 500)]
    df = spark.createDataFrame([(i, t, u, 1, T0 + dt.timedelta(seconds=s)) for i, t, u, s in rows],
                               "event_id long, type string, actor string, story int, created_at timestamp")
    assert {r["event_id"] for r in evt.throttle_page_views(df, "actor", ["story"]).collect()} == {0, 2, 3, 4}


def sessions(spark, segments):
    data = [("a", T0 + dt.timedelta(seconds=s), d, i, v) for i, (s, d, v) in enumerate(segments)]
    df = spark.createDataFrame(data, "k string, at timestamp, ms long, id long, version int")
    out = evt.sessionise(df, ["k"], "at", "ms", "id", "version").orderBy("started_at").collect()
    return [((r["started_at"] - T0).total_seconds(), r["duration_ms"], r["version"]) for r in out]


def test_session_gap_is_strict(spark):
    assert sessions(spark, [(0, 1000, 1), (3600.999, 500, None)]) == [(0, 1500, 1)]
    assert sessions(spark, [(0, 1000, 1), (3601, 500, 2)]) == [(0, 1000, 1), (3601, 500, 2)]


def test_a_long_segment_bridges_later_ones(spark):
    assert sessions(spark, [(0, 8 * 3600 * 1000, 1), (60, 10, 2), (8 * 3600 + 3599, 5, None), (13 * 3600, None, 3)]) == [
        (0, 8 * 3600 * 1000 + 15, 2), (13 * 3600, 0, 3)]


def test_sessions_of_a_hot_key(spark):
    rnd = random.Random(5)
    segments = [(rnd.randint(0, 400000), rnd.randint(0, 900000), rnd.choice([None, 1, 2])) for _ in range(800)]
    want, current = [], None
    for s, d, v in sorted(((s, d, v) for s, d, v in segments), key=lambda x: x[0]):
        if current and s * 1000 - current[1] < 3600000:
            current[1] = max(current[1], s * 1000 + d)
            current[2] += d
        else:
            current = [s, s * 1000 + d, d]
            want.append(current)
    got = sessions(spark, segments)
    assert [(s, d) for s, d, _ in got] == [(w[0], w[2]) for w in want]


def test_asof_keeps_a_null_source(spark):
    rows = [(1, 1, "user", "web", None, 1), (2, 1, "assistant", None, "p", 2), (3, 1, "user", None, None, 3),
            (4, 1, "assistant", None, "q", 4), (5, 1, "user", "mcp", None, 5), (6, 1, "user", "web", None, 6), (7, 1, "assistant", None, None, 7),
            (8, 1, "assistant", None, "r", 8)]
    df = spark.createDataFrame([(i, c, r, s, p, T0 + dt.timedelta(minutes=m)) for i, c, r, s, p, m in rows],
                               "message_id long, chat_id long, role string, source string, provider string, created_at timestamp")
    source = {r["message_id"]: r["usage_source"] for r in us.with_message_source(df, 60).collect()}
    assert source == {1: "web", 2: "web", 3: None, 4: None, 5: "mcp", 6: "web", 7: "web", 8: "web"}
    provider = {r["message_id"]: r["usage_provider"] for r in us.with_message_provider(df, 60).collect()}
    assert provider == {1: "p", 2: "p", 3: "q", 4: "q", 5: None, 6: "r", 7: None, 8: "r"}


@pytest.mark.parametrize("files", [1, 2, 7])
def test_streamed_throttle_takes_events_in_any_order(spark, tmp_path, files):
    """Rows dealt at random over files, one file per batch: the result is the batch operator's, up to the watermark."""
    rnd = random.Random(9)
    rows = [("hot" if i % 3 == 0 else f"k{rnd.randint(0, 5)}", s, i) for i, s in enumerate(rnd.sample(range(9000), 400))]
    # a last event long after the others lets the watermark pass them; it waits itself
    end, path = ("end", 40_000, 1000), str(tmp_path / "in")
    for n in range(files):
        part = [r for r in rows if r[2] % files == n]
        frame(spark, [*part, *([end] if n == files - 1 else [])]).coalesce(1).write.mode("append").parquet(path)
    stream = st.read_stream(spark, path, "k string, ts timestamp, id long", files_per_batch=1)
    kept = [r["event_id"] for r in st.append_to_parquet(st.throttled(stream, ["k"], "ts", "id", delay="3 hours"), "t").collect()]
    assert len(kept) == len(set(kept)) and set(kept) == brute_throttle(rows, 120)
    assert set(kept) == {r["id"] for r in evt.throttle(frame(spark, rows), ["k"], "ts", "id").collect()}


def test_streamed_throttle_drops_what_comes_behind_the_watermark(spark, tmp_path):
    path = str(tmp_path / "in")
    for part in ([("a", 0, 1), ("a", 500, 2)], [("b", 9000, 3)], [("a", 400, 4), ("b", 9100, 5), ("b", 8950, 6)], [("c", 20_000, 7), ("a", 450, 8)]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(path)
    stream = st.read_stream(spark, path, "k string, ts timestamp, id long", files_per_batch=1)
    kept = st.append_to_parquet(st.throttled(stream, ["k"], "ts", "id", delay="10 minutes"), "t")
    # 8 comes a batch after the watermark has passed it; 4 and 6 do not, and decide on 2 and 3, which are newer
    assert {r["event_id"] for r in kept.collect()} == {1, 4, 6, 5}


def test_refresh_reads_new_files_only(spark, tmp_path):
    path, target = tmp_path / "in", str(tmp_path / "out")
    measures = {"n": ("count", F.lit(1)), "total": ("sum", F.col("id")), "low": ("min", F.col("ts")), "ids": ("distinct", F.col("id"))}
    rows = [("a", 1, 1), ("b", 2, 2), ("a", 3, 3), ("a", 3, 3), ("c", 4, 9)]
    for n in range(4):
        frame(spark, rows[n : n + 2]).coalesce(1).write.mode("append").parquet(str(path))
        stream = st.read_stream(spark, str(path), "k string, ts timestamp, id long")
        st.refresh_aggregate(stream, ["k"], measures, target)
        # files read once are not looked at again
        for file in path.glob("part-*"):
            file.write_bytes(b"no longer a file of rows")
    got = {r["k"]: (r["n"], r["total"], r["ids"]) for r in st.refreshed_aggregate(spark, target, measures).collect()}
    all_rows = [r for n in range(4) for r in rows[n : n + 2]]
    want = {k: ([i for x, _, i in all_rows if x == k]) for k in "abc"}
    assert got == {k: (len(v), sum(v), len(set(v))) for k, v in want.items()}
    assert len(list((tmp_path / "out" / "state").glob("version=*"))) == 2


def test_streamed_usage_merges(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i, rnd.randint(0, 30), rnd.choice(["user", "assistant"]), T0 + dt.timedelta(minutes=rnd.randint(0, 4000)), rnd.choice(["p", "q", None]),
             "m", rnd.randint(0, 99)) for i in range(600)]
    schema = ("message_id long, user_id long, role string, created_at timestamp, provider string, model_id string, input_no_cache_tokens long, "
              "input_cache_read_tokens long, input_cache_write_tokens long, output_tokens long")
    rows.sort(key=lambda r: r[3])
    full = [(*r, 0, None, 2 * r[-1]) for r in rows]
    for n in range(3):
        spark.createDataFrame(full[200 * n : 200 * n + 200], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    prices = spark.createDataFrame([("p", "m", 1.0, 0.0, 0.0, 5.0)], "provider string, model_id string, input_no_cache double, "
                                   "input_cache_read double, input_cache_write double, output double")
    stream = st.read_stream(spark, str(tmp_path / "in"), schema, files_per_batch=1)
    hours = st.upsert_batches(st.bucketed_usage(stream, "created_at", ["output_tokens"], prices=prices), ["start"], "u")
    for unit, label in (("hour", "%Y-%m-%d %H:00"), ("day", "%Y-%m-%d")):
        want = {}
        for r in full:
            b = want.setdefault(r[3].strftime(label), [set(), 0, 0, 0.0])
            b[0].add(r[1])
            b[1] += r[2] == "user"
            b[2] += r[9]
            b[3] += (r[6] + 5.0 * r[9]) / 1e6 if r[4] == "p" else 0.0
        got = {r["date"]: (r["users"], r["message_count"], r["output_tokens"], round(r["total_cost"], 9)) for r in st.merged_usage(hours, unit).collect()}
        assert got == {d: (len(b[0]), b[1], b[2], round(b[3], 9)) for d, b in want.items()}


def test_metadata(spark):
    rows = [(1, '{"type":"favorite","favorited":false,"versionNumber":3}'), (2, '{"type":"download","format":"pdf","versionNumber":2,"title":"x"}'), (3, None)]
    got = evt.with_metadata(spark.createDataFrame(rows, "id int, m string"), "m").orderBy("id").collect()
    assert [(r["version"], r["badge"], r["download_title"]) for r in got] == [(None, "removed", None), (2, "pdf", "x"), (None, None, None)]


def test_viewers_fall_back_to_page_views(spark):
    rows = [(1, "page_view", "a", 0, None), (2, "view_duration", "a", 10, 500), (3, "page_view", "b", 5, None), (4, "download", "c", 5, None)]
    df = spark.createDataFrame([(i, t, u, T0 + dt.timedelta(seconds=s), d, None) for i, t, u, s, d in rows],
                               "event_id long, type string, actor string, created_at timestamp, ms long, version int")
    got = evt.viewers(df, "actor", "created_at", "event_id", "created_at", "ms", "version").collect()
    assert {(r["actor_key"], r["duration_ms"], r["total_ms"]) for r in got} == {("a", 500, 500), ("b", None, 0)}
