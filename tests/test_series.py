import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corrolla.functions import series as S
from corrolla.operators import correlation as C, events as E, panel as P, signals as G
from corrolla.sources import tables as T


def frame(spark, values, name="x", kind="double"):
    return spark.createDataFrame([("p", i, v) for i, v in enumerate(values)], f"panel string, rn long, {name} {kind}")


def column(df, c):
    return [x[c] for x in df.orderBy("rn").collect()]


def test_expanding_z_is_pandas(spark):
    x = np.random.default_rng(0).normal(size=80)
    got = column(frame(spark, x.tolist()).withColumn("z", S.expanding_z(F.col("x"), S.series("panel"), 30)), "z")
    s = pd.Series(x)
    want = (s - s.expanding(30).mean()) / s.expanding(30).std()
    assert np.allclose([np.nan if v is None else v for v in got], want, equal_nan=True)


def test_hysteresis_extends_by_four(spark):
    on = [False, True] + [False] * 7 + [True, True, True] + [False] * 6
    got = column(frame(spark, on, "on", "boolean").withColumn("h", S.hysteresis(F.col("on"), S.series("panel"))), "h")
    assert got == [False] + [True] * 5 + [False] * 3 + [True] * 7 + [False] * 2


def test_simulate_against_a_loop(spark):
    rng = np.random.default_rng(5)
    price, e = 100 * np.cumprod(1 + rng.normal(0, 0.02, 60)), rng.normal(size=60)
    df = frame(spark, price.tolist(), "price").join(frame(spark, e.tolist(), "e_div"), ["panel", "rn"])
    run = G.simulate(df, F.col("e_div") >= 0.8, ["panel"]).orderBy("rn").toPandas()
    raw, last, held = e >= 0.8, -99, []
    for i in range(60):
        last = i if raw[i] else last
        held.append(i - last < 5)
    pos, eq, want = [False, *held[:-1]], 1.0, []
    for i in range(60):
        r = 0 if i == 0 or pos[i] else price[i] / price[i - 1] - 1
        eq *= 1 + r - (0.0005 if i and pos[i] != pos[i - 1] else 0)
        want.append(eq)
    assert np.allclose(run["equity"], want)


def test_pad_complete_and_flat_symbols(spark):
    rows = [("a", f"2024-01-{d:02d}", float(d)) for d in range(1, 9)] + [("flat", f"2024-01-{d:02d}", 1.0) for d in range(1, 9)]
    rows += [("gap", f"2024-01-{d:02d}", float(d)) for d in (3, 4, 7, 8)]
    p = spark.createDataFrame(rows, "symbol string, d string, close double").select("symbol", F.to_date("d").alias("date"), "close")
    rets = P.returns(p)
    got = {(x["symbol"], x["rn"]): x["ret"] for x in rets.collect()}
    assert got["gap", 4] == 0.0 and got["gap", 2] is None and got["a", 1] == 1.0
    pairs = C.rolling_pairs(rets, 3).collect()
    assert all(x["r"] is None for x in pairs if "flat" in (x["u"], x["v"]))
    assert min(x["rn"] for x in pairs if x["v"] == "gap") == 5
    assert C.signed_edges(spark.createDataFrame([(0, "a", "b", 0.3), (0, "a", "c", -0.3), (0, "b", "c", 0.29)], "rn long, u string, v string, r double")).count() == 2


def test_as_of_is_inclusive_and_nearest_prefers_later(spark):
    left = spark.createDataFrame([("k", 1), ("k", 5), ("k", 9)], "k string, t int")
    right = spark.createDataFrame([("k", 5, 1.0), ("k", 8, 2.0)], "k string, t int, v double")
    assert [x["v"] for x in E.as_of(left, right, "t", "v", ["k"]).orderBy("t").collect()] == [None, 1.0, 2.0]
    rows = spark.sql("SELECT date'2024-01-01' AS date, 0L AS rn UNION ALL SELECT date'2024-01-03', 1L")
    ev = spark.sql("SELECT date'2024-01-02' AS event_date, 'e' AS label")
    assert E.nearest_rows(ev, rows).first()["rn"] == 1


def test_responses_need_thirty_rows_before(spark):
    got = column(E.responses(frame(spark, [float(i) for i in range(80)], "z"), "z"), "post_pre")
    assert got[29] is None and got[30] == pytest.approx(30.0)


def test_folds_stop_before_a_short_rest(spark):
    got = G.folds(frame(spark, [0.0] * 229), 120, 30).orderBy("fold").collect()
    assert [tuple(x) for x in got] == [(0, 0, 120, 150), (1, 30, 150, 180), (2, 60, 180, 210)]
    assert G.folds(frame(spark, [0.0] * 10), 120, 30).count() == 0


def test_classifier_order_and_trade_table(spark):
    rows = spark.createDataFrame([(0.9, 0.0), (-0.6, 2.0), (0.0, 0.7), (None, 0.1)], "e double, l double")
    assert [x[0] for x in rows.select(S.classify(F.col("e"), F.col("l"))).collect()] == ["policy", "strength", "volatile", "calm"]
    moves = spark.createDataFrame([("calm", "policy"), ("calm", "strength"), ("policy", "calm"), ("calm", "volatile"), ("policy", "policy")], "p string, n string")
    assert [x[0] for x in moves.select(S.trade_action(F.col("p"), F.col("n"))).collect()] == ["close", "open_long", "close_to_neutral", "none", "none"]


def test_sources_round_trip(spark, tmp_path):
    wide = spark.sql("SELECT date'2024-01-01' AS date, 1.0D AS a, double('NaN') AS b UNION ALL SELECT date'2024-01-02', 2.0D, 3.0D")
    long = T.read_wide(wide)
    assert long.count() == 3 and T.to_wide(long, ["a", "b"]).count() == 2
    T.write_rows(long, str(tmp_path / "c"), "csv", decimals=3)
    back = T.read_csv(spark, str(tmp_path / "c"), "date date, symbol string, close double")
    assert back.count() == 3
    bad = spark.createDataFrame([("1.5", "2"), ("x", "1"), ("NaN", "1")], "x string, y string")
    assert T.good_pairs(bad, "x", "y").count() == 1
    assert '"b":null' in T.as_documents(wide.where("b IS NOT NULL AND isnan(b)").select("b")).first()[0]
    v = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, v int, x string")
    assert sorted(tuple(x) for x in T.latest_by_key(v, ["k"], "v").collect()) == [(1, 2, "b"), (2, 1, "c")]


def test_stream_changes_and_upsert(spark, tmp_path):
    from corrolla.streaming import live

    src, schema = str(tmp_path / "in"), "k string, n long, c string"
    spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 1, "x")], schema).coalesce(1).write.parquet(src)
    q = live.changes(live.read_stream(spark, src, schema), "k", "n", "c").writeStream.format("memory").queryName("ch").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(x) for x in spark.sql("SELECT * FROM ch").collect()] == [("a", 3, "x", "y")]
    out = str(tmp_path / "out")
    q = live.read_stream(spark, src, schema).writeStream.foreachBatch(live.upsert(out, ["k"], "n")).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(x) for x in live.current(spark, out).select("k", "n", "c").collect()) == [("a", 3, "y"), ("b", 1, "x")]
