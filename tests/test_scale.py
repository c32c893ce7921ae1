"""What keeps large tables within time and memory: calls to the state store, one-way windows, pages of ranges, size of slices."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigspark.operators import filters, rules, series, windows
from sigspark.operators.scan import run_block
from sigspark.streaming import jobs, stateful


class Store:
    """A state handle that counts its calls."""

    def __init__(self):
        self.calls, self.maps = 0, {}

    def getMapState(self, name, key, value):
        held, store = self.maps.setdefault(name, {}), self

        class Map:
            def __getattribute__(self, call):
                store.calls += 1
                return {
                    "containsKey": lambda k: k in held, "getValue": held.get, "updateValue": held.__setitem__, "removeKey": held.pop,
                    "iterator": lambda: iter(list(held.items())),
                }[call]

        return Map()


def spans(span=10):
    store = Store()
    return store, stateful.Spans(store, T.StructType().add("us", "long").add("id", "long").add("v", "double"), ["us", "id"], span)


def frames(n, size):
    rng = np.random.default_rng(5)
    at = rng.permutation(n)
    df = pd.DataFrame({"us": at // 2, "id": at, "v": at / 3})
    return df.sort_values(["us", "id"], ignore_index=True), [df[i:i + size] for i in range(0, n, size)]


def test_rows_that_fit_in_memory_do_not_go_through_the_state_store():
    store, held = spans()
    whole, parts = frames(400, 30)
    assert sum(held.put(p) for p in parts) == 0
    assert held.put(pd.DataFrame({"us": [1, None], "id": [None, 3], "v": [0.0, 0.0]})) == 2
    taken = list(held.take())
    assert store.calls == 0 and len(taken) == 20
    pd.testing.assert_frame_equal(pd.concat(taken, ignore_index=True), whole)
    assert not list(held.take())
    for p in parts:
        held.put(p)
    pd.testing.assert_frame_equal(next(held.take(whole=True)), whole)


def test_more_rows_than_memory_holds_go_through_the_state_store(monkeypatch):
    monkeypatch.setattr(stateful, "MOST", 100)
    store, held = spans()
    whole, parts = frames(470, 30)
    for p in parts:
        held.put(p)
    taken = list(held.take(whole=True))
    assert store.calls and len(taken) == 24 and not any(store.maps.values())
    pd.testing.assert_frame_equal(pd.concat(taken, ignore_index=True), whole)


def test_trailing_windows_have_no_frame_that_is_summed_anew(spark, capsys):
    df = spark.range(10).select(F.lit(0).alias("dev"), F.col("id").alias("us"), F.col("id").cast("double").alias("value"), F.lit(0.0).alias("filtered"))
    windows.trailing_power(df, ["dev"], "us", 3).explain()
    assert "unboundedfollowing" not in capsys.readouterr().out.lower()


def test_a_range_asks_only_the_pages_that_reach_the_value(spark):
    """A rule per narrow range: a value meets the page it lies in, not all that begin below it."""
    n = 20 * rules.PAGE
    trigger = "named_struct('type', 'property', 'device_id', cast(null as long), 'product_id', cast(null as long), 'identifier', 'value', 'operator', 'between', 'value', concat(id, ',', id + 0.5), 'groups', null)"
    table = spark.range(n).selectExpr("id AS rule_id", f"array({trigger}) AS triggers", "array(named_struct('kind', 'alert', 'target', id)) AS actions")
    table = table.select("rule_id", F.col("triggers").cast(rules.RULES.split(", actions")[0].split("triggers ")[1]).alias("triggers"), "actions")
    index = rules.index_rules(table)
    heads = index.heads.select("lows", "highs").collect()
    assert len(heads) == 1 and len(heads[0].lows) == 20
    assert all(low <= high < low + rules.PAGE + 1 for low, high in zip(heads[0].lows, heads[0].highs))
    msgs = spark.createDataFrame(
        [(i, 1, 1, "thing.property.post", "value", {"value": v}, None, None) for i, v in enumerate(["2000.25", "2000.75", "0", "2559.5", "x", "nan"])],
        "message_id long, device_id long, product_id long, method string, identifier string, params map<string,string>, state string, report_time timestamp")
    assert sorted((r.message_id, r.rule_id) for r in rules.match_rules(msgs, index).collect()) == [(0, 2000), (2, 0), (3, 2559)]


def test_slices_follow_the_rows_not_the_compressed_files(spark, tmp_path):
    path = str(tmp_path / "flat")
    spark.range(200_000).select(F.lit(1).cast("long").alias("dev"), (F.col("id") % 100).alias("us"), F.lit(0.5).alias("v")).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    spark.conf.set("sigspark.sliceBytes", str(4 << 20))
    try:
        assert series.slices_for(df.unionByName(df)) > 1
        assert series.slices_for(spark.range(10)) == 1
    finally:
        spark.conf.unset("sigspark.sliceBytes")


def test_no_row_carries_a_null_list_into_a_scan(spark, capsys):
    """Spark's Arrow writer looks at its size row by row; with null lists each look costs the rows written before."""
    df = spark.range(50).select(F.lit(0).alias("dev"), F.col("id").alias("t"), F.col("id").cast("double").alias("value"))
    filters.apply_filter(df, "IIR", ["dev"], ["t"]).explain()
    plan = capsys.readouterr().out
    fed = next(line for line in plan.splitlines() if "MapInArrow" in line).split(")#")[0]
    assert "__init" not in fed and "__done" not in fed and "null AS __s0" not in plan


def test_a_block_asks_for_its_steps_once():
    calls, scan = [], filters.REGISTRY["KALMAN"]()
    step, scan.step = scan.step, lambda cols: calls.append(1) or step(cols)
    pos, value = np.arange(1000) % 300, np.random.default_rng(1).normal(size=1000)
    _, cur, _ = run_block(scan, {"value": value, "pos": pos}, pos == 0, np.zeros(1))
    k, y = step({"value": np.ones(1000), "pos": pos})[1][:, 0], 0.0
    for i in range(1000):
        y = k[i] * value[i] + (1 - k[i]) * y * (pos[i] > 0)
        assert abs(cur[i, 0] - y) < 1e-9
    assert len(calls) == 1


def test_a_computed_series_is_stored_before_it_is_read_again(spark, capsys):
    df = spark.range(400).select(F.lit(0).alias("dev"), F.col("id").alias("t"), F.col("id").cast("double").alias("value"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("sigspark.sliceBytes", "1000")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        smooth = filters.apply_filter(series.sliced(df, ["dev"], ["t"]), "IIR", ["dev"], ["t"])
        near = series.with_rows(smooth, ["dev"], ["t"], lambda w: {"n": F.lag("filtered").over(w)}, before=1)
        near.explain()
        assert "MapInArrow" not in capsys.readouterr().out
        total = series.running(series.sliced(df, ["dev"], ["t"]), ["dev"], ["t"], total=("sum", "value"))
        total.explain()
        assert "SortMergeJoin" not in capsys.readouterr().out          # a row per slice is broadcast, the series stays where it is
        assert total.agg(F.max("total")).first()[0] == 399 * 200
    finally:
        spark.conf.unset("sigspark.sliceBytes")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


class Memory(Store):
    """A state handle with values too; what it holds must be plain."""

    def getValueState(self, name, kind):
        store = self

        class Value:
            held = None

            def get(self):
                store.calls += 1
                return self.held

            def update(self, value):
                store.calls += 1
                assert all(type(x) in (int, float, str) for part in value for x in (part if isinstance(part, list) else [part]))
                self.held = value

        return Value()


LOT = T.StructType().add("dev", "long").add("us", "long").add("id", "long").add("value", "double").add("filtered", "double").add("key_text", "string").add("key_lot", "integer")


def batches(keys, rows, n=4, seed=8):
    """Rows of many keys, some late, some without a time, some of one instant, in no order; keys come and go."""
    rng = np.random.default_rng(seed)
    for b in range(n):
        dev = rng.integers(0, keys * (b + 1) // n, rows)
        us = rng.integers(b * 300 - 40, (b + 1) * 300, rows)
        df = pd.DataFrame({"dev": dev, "us": np.where(rng.random(rows) < 0.05, np.nan, us), "id": b * rows + np.arange(rows), "value": rng.normal(size=rows)})
        yield df.assign(filtered=df.value * 0.5, key_text=[f"2:{d}" for d in dev], key_lot=7)


def served(processor, df, size):
    out = list(processor.handleInputRows((7,), iter([df[i:i + size] for i in range(0, len(df), size)]), None))
    return pd.concat(out, ignore_index=True) if out else None


@pytest.mark.parametrize("most", [65_536, 150])
@pytest.mark.parametrize("width", [70, 900, 0])
def test_one_call_gives_the_trailing_windows_of_many_keys(monkeypatch, most, width):
    """300 keys, 4 batches: calls to the state store do not grow with the keys, and the samples kept do not grow with the batches."""
    monkeypatch.setattr(stateful, "MOST", most)
    store = Memory()
    processor = stateful.TrailingProcessor(LOT, "us", width, "value", "filtered")
    processor.init(store)
    seen, newest, dropped, count = {}, {}, {}, {}
    for df in batches(300, 900):
        got = served(processor, df, 128).set_index("id")
        assert list(got) == ["dev", "us", "value", "filtered", "raw_power", "filtered_power", "residual_power", "n", "processed", "dropped"]
        before = dict(newest)
        taken = []
        for r in df.itertuples():
            if r.us != r.us or r.us < before.get(r.dev, -1e9):
                dropped[r.dev] = dropped.get(r.dev, 0) + 1
            else:
                taken.append(r)
                newest[r.dev] = max(newest.get(r.dev, -1e9), r.us)
                seen.setdefault(r.dev, []).append((r.us, r.value))
        assert len(got) == len(taken)
        for r in taken:
            near = [v * v for u, v in seen[r.dev] if r.us - width <= u <= r.us]
            x = got.loc[r.id]
            assert x.n == len(near) and abs(x.raw_power - sum(near) / len(near)) < 1e-12
            assert abs(x.filtered_power - x.raw_power / 4) < 1e-12 and abs(x.residual_power - x.raw_power / 4) < 1e-12
            assert x.dropped == dropped.get(r.dev, 0) and x.us == r.us
        for dev, part in got.groupby("dev"):
            assert part.sort_values(["us", "processed"]).processed.tolist() == [count.get(dev, 0) + 1 + i for i in range(len(part))]
            count[dev] = count.get(dev, 0) + len(part)
    assert most < 900 or store.calls < 60
    kept = sum(len(p[0]) for p in store.maps["samples"].values())
    assert kept <= 2 * sum(u // max(width, 1) >= newest[d] // max(width, 1) - 1 for d in seen for u, _ in seen[d]) + 1000


def test_powers_stay_apart_from_large_samples_and_missing_ones():
    """Nothing is subtracted: a large or a missing sample of a key touches neither its neighbour nor a window that has left it."""
    processor = stateful.TrailingProcessor(LOT, "us", 10, "value", "filtered")
    processor.init(Memory())
    value = {1: [1e9] + [1e-4] * 59, 2: [1e-4] * 60, 3: [np.nan] + [1e-4] * 59, 4: [np.inf] + [1e-4] * 59}
    df = pd.DataFrame([(d, u, 100 * d + u, v[u], 0.0, f"1:{d}", 7) for d, v in value.items() for u in range(60)], columns=LOT.names)
    got = served(processor, df, 50)
    assert (abs(got[(got.us > 25) | (got.dev == 2)].raw_power - 1e-8) < 1e-20).all()
    assert got[(got.dev == 3) & (got.us <= 9)].raw_power.isna().all()


def test_keys_that_look_alike_stay_apart(spark):
    rows = [("a", "b:1"), ("a:1", "b"), (None, "-"), ("-", None), (None, None), ("", None), ("1", "1:b")]
    df = spark.createDataFrame(rows, "x string, y string")
    got = stateful.dealt(df, ["x", "y"], 4).collect()
    assert len({r.key_text for r in got}) == len(rows) and {r.key_lot for r in got} <= set(range(4))


@pytest.mark.parametrize("most", [65_536, 150])
@pytest.mark.parametrize("width", [70, 1, 0])
def test_one_call_throttles_many_keys(monkeypatch, most, width):
    monkeypatch.setattr(stateful, "MOST", most)
    store = Memory()
    processor = stateful.ThrottleProcessor(LOT, "us", width)
    processor.init(store)
    last = {}
    for df in batches(300, 900):
        want = []
        for r in df.dropna(subset=["us"]).sort_values("us", kind="stable").itertuples():
            if r.dev not in last or r.us >= last[r.dev] + width:
                last[r.dev] = r.us
                want.append(r.id)
        got = served(processor, df, 128)
        assert list(got) == ["dev", "us", "id", "value", "filtered"] and sorted(got.id) == sorted(want)
    assert most < 900 or store.calls <= 8


def test_streams_deal_their_keys_into_lots(spark, parts_of_keys, tmp_path):
    """Null keys are one key, over two batches; the number of lots changes nothing."""
    df, src = parts_of_keys
    read = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = {}
    for lots in (1, 5):
        sent = jobs.drain(spark, stateful.throttle_stream(read(), ["dev", "ch"], "us", 25, lots), str(tmp_path / f"a{lots}"))
        power = jobs.drain(spark, stateful.trailing_stream(read(), ["dev", "ch"], "us", 25, "value", "value", lots), str(tmp_path / f"b{lots}"))
        assert sent.columns == df.columns and "key_lot" not in power.columns
        got[lots] = sorted(r.id for r in sent.collect()), sorted((r.id, r.n, r.processed) for r in power.collect())
    assert got[1] == got[5]
    last, want = {}, []
    rows = sorted(df.collect(), key=lambda r: r.us)
    for r in rows:
        if r.us - last.get((r.dev, r.ch), -99) >= 25:
            last[r.dev, r.ch] = r.us
            want.append(r.id)
    assert got[1][0] == sorted(want)
    assert [(i, n) for i, n, _ in got[1][1]] == sorted((r.id, sum(q.dev == r.dev and q.ch == r.ch and r.us - 25 <= q.us <= r.us for q in rows)) for r in rows)


@pytest.fixture
def parts_of_keys(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [([None, 1, 2, 2**52][i % 4], ["x", None, "y"][i % 3], i, i, float(i % 7)) for i in range(120)]
    df = spark.createDataFrame(rows, "dev long, ch string, us long, id long, value double")
    for half in ("us < 60", "us >= 60"):
        df.filter(half).coalesce(1).write.mode("append").parquet(src)
    return df, src
