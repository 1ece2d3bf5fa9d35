import math
import random

import pytest
from pyspark.sql import functions as F
from tests.series import Slow, close, frame, load, shown

from tidemark.engine import Engine, Options
from tidemark.errors import InvalidRangeError, MatchError, ParseError, QueryTimeout, SampleLimitError, UnimplementedError
from tidemark.lang import parse
from tidemark.model import Matcher, format_labels
from tidemark.operators.selectors import matching

CPU = "\n".join(['cpu{host="a",dc="eu"} 1 2 3 4 5', 'cpu{host="b",dc="eu"} 10 20 30 40 50', 'mem{host="a"} 100 200 300 400 500'])


def instant(spark, text, query, ts, **options):
    return shown(Engine(frame(spark, load(text)), Options(**options)).instant(query, ts).collect())


CASES = [
    (CPU, "cpu", 4000, [('cpu{dc="eu", host="a"}', 5.0), ('cpu{dc="eu", host="b"}', 50.0)]),
    ("c 1 2 3", "c", 1500, [("c", 2.0)]),
    ("c 1 2 3", "c", 2000 + 300_000, [("c", 3.0)]),
    ("c 1 2 3", "c", 2000 + 300_001, []),
    ("c 1 2 3", "c", -1, []),
    ("c 1 2 3 4 5", "c offset 2s", 4000, [("c", 3.0)]),
    ("r 0 10 20 30 40 50", "rate(r[5s])", 5000, [("{}", 10.0)]),
    ("r 0 10 20 30", "rate(r[20s])", 20000, [("{}", 1.75)]),
    ("r 0 10 20 30 5 15", "increase(r[5s])", 5000, [("{}", 43.75)]),
    ("r 5", "rate(r[5s])", 0, []),
    ("r 0 10 20 100", "irate(r[4s])", 3000, [("{}", 80.0)]),
    ("r 50 10", "idelta(r[4s])", 1000, [("{}", -40.0)]),
    ("r 50 10", "irate(r[4s])", 1000, [("{}", 10.0)]),
    ("v 1 2 3 4 5", "count_over_time(v[4s])", 4000, [("{}", 4.0)]),
    ("v 1 2 3 4 5", "min_over_time(v[5s])", 4000, [("v", 1.0)]),
    ("v nan nan", "min_over_time(v[5s])", 1000, [("v", math.inf)]),
    ("v nan nan", "max_over_time(v[5s])", 1000, [("v", -math.inf)]),
    ("v nan nan 1 nan", "changes(v[9s])", 3000, [("{}", 2.0)]),
    ("v 1 2", "-v % 0", 1000, [("{}", math.nan)]),
    ("v -2.5", "round(v)", 0, [("{}", -2.0)]),
    ("v 1e300", "floor(v)", 0, [("{}", 1e300)]),
    ("v 0", "ln(v)", 0, [("{}", -math.inf)]),
    ("v -1", "log2(v)", 0, [("{}", math.nan)]),
    ("v -4", "sgn(v)", 0, [("{}", -1.0)]),
    ("v nan", "v == v", 0, []),
    ("v nan", "v != bool v", 0, [("{}", 1.0)]),
    ("v nan", "v > 5", 0, []),
    ("v nan", "clamp_min(v, 0)", 0, [("v", math.nan)]),
    ("v 1", "v / 0", 0, [("{}", math.inf)]),
    ("v 1", "1 / -0", 0, [("{}", -math.inf)]),
    ("v 1", "7 % -3 + -7 % 3", 0, [("{}", 0.0)]),
    ("v 1", "1 ^ (0/0)", 0, [("{}", 1.0)]),
    ('v{a="1"} nan\nv{a="2"} 3', "max(v)", 0, [("{}", 3.0)]),
    ('v{a="1"} nan\nv{a="2"} nan', "max(v)", 0, [("{}", math.nan)]),
    ('v{a="1"} nan\nv{a="2"} 3', "topk(1, v)", 0, [('v{a="2"}', 3.0)]),
    ('v{a="1"} nan\nv{a="2"} 3', "quantile(0, v)", 0, [("{}", math.nan)]),
    ('v{a="1"} 1\nv{a="2"} 3', "quantile(2, v)", 0, [("{}", math.inf)]),
    ('v{a="1"} 1\nv{a="2"} 3', "topk(0, v)", 0, []),
    ('v{a="1"} 1\nv{a="2"} 3', "topk(1.9, v)", 0, [('v{a="2"}', 3.0)]),
    ('v{a="1"} 1\nv{a="2"} 3', "bottomk(time() + 1, v)", 0, [('v{a="1"}', 1.0)]),
    ('v{a="1"} 1\nv{a="2"} 3', "2 < v", 0, [('v{a="2"}', 3.0)]),
    ('v{a="1"} 1\nv{a="2"} 3', "v > scalar(v{a='1'})", 0, [('v{a="2"}', 3.0)]),
    ('v{a="1"} 1\nv{a="2"} 3', "scalar(v)", 0, [("{}", math.nan)]),
    ('e{j="x",i="1"} 5\ne{j="x",i="2"} 10\nt{j="x",i="1"} 100\nt{j="x",i="2"} 200\nt{j="x",i="3"} 300', "e / on (i) t", 0, [('{i="1"}', 0.05), ('{i="2"}', 0.05)]),
    ('a{k="1"} 1\na{k="2"} 2\nb{k="2"} 20\nb{k="3"} 30', "a or b", 0, [('a{k="1"}', 1.0), ('a{k="2"}', 2.0), ('b{k="3"}', 30.0)]),
    ("v 1", "vector(42)", 1234, [("{}", 42.0)]),
    ("v 1", "time()", 5000, [("{}", 5.0)]),
    ("v 1", 'absent(nosuch{a="b"})', 0, [("{}", 1.0)]),
    ("v 1", "absent(v)", 0, []),
    ("v 1", "sum(nosuch)", 0, []),
    ("v 1", "nosuch + v", 0, []),
    ("v 1 2", "timestamp(v)", 60_000, [("{}", 60.0)]),
    ('v{a="",b="1"} 1', "sum by (a, b) (v)", 0, [('{b="1"}', 1.0)]),
]


@pytest.mark.parametrize("text,query,ts,want", CASES)
def test_instant(spark, text, query, ts, want):
    got = instant(spark, text, query, ts)
    assert [k for k, _ in got] == [k for k, _ in want] and all(close(a, b) for (_, a), (_, b) in zip(got, want, strict=True)), got


def test_range_vector_and_string(spark):
    engine = Engine(frame(spark, load("c 1 2 3 4 5")))
    rows = engine.instant("c[3s]", 4000).collect()
    assert [(r.t, r.v) for r in rows] == [(2000, 3.0), (3000, 4.0), (4000, 5.0)]
    assert engine.instant('"text"', 0).collect() == ["text"]


def test_many_to_many_is_an_error_even_if_no_value_is_read(spark):
    text = 'e{j="x",i="1"} 5\nt{j="x",i="1"} 100\nt{j="x",i="2"} 200'
    for query in ("e / on (j) t", "count(e / on (j) t)", "nosuch / on (j) t", "t / on (j) e"):
        with pytest.raises(MatchError):
            instant(spark, text, query, 0)
    assert instant(spark, text, "t / on (j) nosuch", 0) == []  # repeated on the left without a partner is fine


def test_unimplemented_and_invalid(spark):
    engine = Engine(frame(spark, load("cpu 1")))
    for query in ("histogram_quantile(0.9, cpu)", 'label_replace(cpu, "a", "b", "c", "d")'):
        with pytest.raises(UnimplementedError):
            engine.instant(query, 0)
    for args in (("cpu", 0, 1000, 0), ("cpu", 0, 1000, -1), ("cpu", 1000, 0, 10), ("cpu", 0, 100_000, 1), ("cpu[5s]", 0, 1000, 10), ('"x"', 0, 1000, 10)):
        with pytest.raises(InvalidRangeError):
            engine.range(*args)


def test_limits(spark):
    series = frame(spark, load("v{a='1'} 1 2 3 4 5 6 7 8 9 10".replace("'", '"')))
    with pytest.raises(SampleLimitError):
        Engine(series, Options(max_samples=5)).instant("v[20s]", 10_000)
    with pytest.raises(QueryTimeout):
        Engine(series, Options(timeout=0)).instant("v", 10_000)
    result = Engine(series).range("v", 0, 9000, 3000)
    assert [(r.ts, r.v) for r in result.collect()] == [(0, 1.0), (3000, 4.0), (6000, 7.0), (9000, 10.0)]
    assert result.stats["steps"] == 4 and result.stats["samplesScanned"] == 10 and result.stats["seriesSelected"] == 1


RANGES = [
    "requests", "requests offset 2s", "rate(requests[4s])", "increase(requests[3s] offset 1s)", "delta(requests[4500ms])", "irate(requests[4s])", "idelta(requests[5s])", "resets(requests[6s])", "changes(requests[3s])", "avg_over_time(requests[4s])", "sum_over_time(requests[2500ms])",
    "min_over_time(requests[4s])", "max_over_time(requests[4s])", "first_over_time(requests[4s])", "last_over_time(requests[4s])", "count_over_time(requests[7s])", "stddev_over_time(requests[4s])", "stdvar_over_time(requests[4s])",
    "sum by (job) (rate(requests[4s]))", "avg without (inst) (requests)", "min(requests)", "max by (job) (requests)", "count(requests)", "group by (inst) (requests)", "stddev(requests)", "stdvar by (job) (requests)", "topk(2, requests)", "bottomk by (job) (1, requests)", "quantile(0.7, requests)", "quantile by (job) (time() / 10, requests)",
    "sum by (job) (requests) / on (job) count by (job) (requests)", "requests > 20", "requests > bool 20", "20 < requests", "requests % 7 - 2 * requests ^ 0.5", "requests and requests > 20", "requests unless requests > 20", "(requests > 20) or requests", "scalar(sum(requests)) + time()", "absent(requests > 60)", "clamp_max(round(requests / 3, 0.5), 9)", "-requests", "timestamp(requests)", "requests * on (job, inst) requests offset 1s",
]


def random_series(seed):
    rng = random.Random(seed)
    out = {}
    for job in ("api", "db", ""):
        for inst in range(3):
            v, samples, t = 0.0, [], rng.randrange(1500)
            for _ in range(14):
                t += rng.choice([400, 700, 1000, 1000, 1000, 2300])
                v = rng.choice([v + rng.randrange(9), v + 5, v + 5, 0.0, v])
                samples.append((t, math.nan if rng.random() < 0.04 and job == "db" else v))
            labels = [("__name__", "requests"), ("inst", str(inst)), *([("job", job)] if job else [])]
            out[tuple(sorted(labels))] = samples
    return out


@pytest.mark.parametrize("query", RANGES)
def test_range_equals_slow_instants(spark, query):
    """Range queries against the slow evaluator at every step: random series with resets, gaps, jitter and NaN."""
    series = random_series(3)
    slow = Slow(series, lookback=3000)
    engine = Engine(frame(spark, series).repartition(3), Options(lookback=3000, max_samples=None))
    got = {}
    for r in engine.range(query, 2000, 16_000, 1500).collect():
        got.setdefault(r.ts, []).append((tuple((x.name, x.value) for x in r.labels), r.v))
    for ts in range(2000, 16_001, 1500):
        want = sorted(slow.at(query, ts).items())
        have = sorted(got.get(ts, []))
        assert [k for k, _ in have] == [k for k, _ in want], ts
        assert all(close(a, b) for (_, a), (_, b) in zip(have, want, strict=True)), (ts, have, want)


@pytest.mark.parametrize("query", ["stddev_over_time(requests[{}ms])", "stdvar_over_time(requests[{}ms])"])
def test_spread_keeps_no_row_for_a_pair_of_summary_and_window(spark, query):
    """Windows are merged where the series' summaries stand: nothing is joined, and after the steps are exploded nothing is sorted, grouped or sent."""
    engine = Engine(frame(spark, random_series(7)), Options(max_samples=None))
    plan = engine.plan(query.format(4500), 2000, 16_000, 1500)._jdf.queryExecution().sparkPlan().toString()
    above, _, below = plan.partition("Generate explode")
    assert below and "Window" in below and "Join" not in plan
    assert not any(x in above for x in ("Aggregate", "Sort", "Window", "Exchange"))


@pytest.mark.parametrize("query", ["stddev_over_time(requests[{}ms])", "stdvar_over_time(requests[{}ms])"])
def test_spread_of_any_width(spark, query):
    """Wide, odd and narrow windows (some samples are in none), sparse series, equal times of many series, a level far above the differences."""
    series = {k: [(t, v + 1e9 * (i % 2)) for t, v in samples if i % 3 or t % 5 < 2] for i, (k, samples) in enumerate(random_series(11).items())}
    slow = Slow(series, lookback=3000)
    engine = Engine(frame(spark, series).repartition(3), Options(lookback=3000, max_samples=None))
    for width in (500, 1500, 4501, 60_000):
        got = {(r.ts, *((x.name, x.value) for x in r.labels)): r.v for r in engine.range(query.format(width), 2000, 17_000, 1500).collect()}
        want = {(ts, *k): v for ts in range(2000, 17_001, 1500) for k, v in slow.at(query.format(width), ts).items()}
        assert got == pytest.approx(want, rel=1e-6, abs=1e-5, nan_ok=True)


@pytest.mark.parametrize("query", ["stddev_over_time(requests[{}ms])", "stdvar_over_time(requests[{}ms])"])
def test_spread_of_values_that_are_missing(spark, query):
    label = {k: (("__name__", "requests"), ("k", k)) for k in "ab"}
    rows = frame(spark, {label["a"]: [(500, 1.0), (1500, 2.0), (1600, 4.0)], label["b"]: [(1500, 2.0)]})
    rows = rows.withColumn("v", F.when(F.col("v") != 2, F.col("v")))  # 2 stands for null
    got = {(r.ts, r.labels[0].value): r.v for r in Engine(rows, Options(max_samples=None)).range(query.format(2000), 1000, 2000, 1000).collect()}
    assert got.pop((2000, "a")) == pytest.approx(1.5 if "stddev" in query else 2.25)
    assert got == {(1000, "a"): 0.0, (2000, "b"): None}


def test_range_equals_instants(spark):
    series = frame(spark, random_series(5))
    engine = Engine(series, Options(lookback=3000, max_samples=None))
    for query in ("sum by (job) (rate(requests[4s]))", "topk(2, requests)"):
        whole = [(r.ts, format_labels(r.labels), r.v) for r in engine.range(query, 4000, 10_000, 2000).collect()]
        single = [(ts, k, v) for ts in range(4000, 10_001, 2000) for k, v in shown(engine.instant(query, ts).collect())]
        assert [(a, b) for a, b, _ in sorted(whole, key=repr)] == [(a, b) for a, b, _ in sorted(single, key=repr)]
        assert all(close(a[2], b[2]) for a, b in zip(sorted(whole, key=repr), sorted(single, key=repr), strict=True))


CORPUS = ['cpu{host="web-1",env="prod"} 0', 'cpu{host="web-2",env="prod"} 1', 'cpu{host="db-1",env="staging"} 2', 'mem{host="web-1",env="prod"} 3', 'mem{host="db-1"} 4']


@pytest.mark.parametrize(
    "matchers,want",
    [
        ([], []),
        ([("__name__", "=", "cpu")], [0, 1, 2]),
        ([("__name__", "=", "cpu"), ("env", "=", "prod")], [0, 1]),
        ([("env", "!=", "prod")], [2, 4]),
        ([("host", "!~", "web-.*")], [2, 4]),
        ([("env", "!=", "")], [0, 1, 2, 3]),
        ([("env", "=", "")], [4]),
        ([("host", "=~", "web-1|web-2")], [0, 1, 3]),
        ([("host", "=~", "web-.*")], [0, 1, 3]),
        ([("host", "=~", ".*")], [0, 1, 2, 3, 4]),
        ([("host", "!=", "web-1"), ("env", "!=", "staging")], [1, 4]),
        ([("__name__", "=~", "c.u")], [0, 1, 2]),
        ([("__name__", "!~", "c.u")], [3, 4]),
    ],
)
def test_matchers(spark, matchers, want):
    rows = frame(spark, load("\n".join(CORPUS)))
    assert sorted(int(r.v) for r in matching(rows, [Matcher(*m) for m in matchers]).collect()) == want


def test_matchers_agree_with_python_on_random_series(spark):
    rng = random.Random(4)
    series = {}
    for k in range(120):
        labels = [("__name__", rng.choice(["a", "b"]))] + [(n, rng.choice(["x", "y-1", "y-2", "", "z\n"])) for n in ("job", "host") if rng.random() > 0.25]
        series[(*sorted(labels), ("k", str(k)))] = [(0, float(k))]
    rows = frame(spark, series).cache()
    tests = [Matcher(n, op, v) for n in ("job", "host", "none") for op, v in (("=", "x"), ("=", ""), ("!=", "y-1"), ("=~", "y-.*"), ("=~", "x|"), ("!~", "y-[12]"), ("!~", ""), ("=~", ".+"), ("=~", "z"))]
    for _ in range(40):
        chosen = rng.sample(tests, rng.randrange(1, 4))
        want = sorted(s[0][1] for key, s in series.items() if all(m.matches(dict(key).get(m.name, "")) for m in chosen))
        assert sorted(r.v for r in matching(rows, chosen).collect()) == want, chosen


def test_lookups(spark):
    engine = Engine(frame(spark, load("\n".join(CORPUS))))
    assert [r.name for r in engine.label_names().collect()] == ["__name__", "env", "host"]
    assert [r.value for r in engine.label_values("env").collect()] == ["prod", "staging"]
    assert [r.value for r in engine.label_values("host", ['cpu{env="prod"}']).collect()] == ["web-1", "web-2"]
    assert engine.series(['cpu{env="prod"}', 'mem{host=~"w.*"}', "cpu offset 1h"]).count() == 4
    assert engine.series(["cpu"], 1, 5).count() == 0
    for bad in ("1 + 1", "cpu[5m]", "sum(cpu)"):
        with pytest.raises(ParseError):
            engine.series([bad])
    with pytest.raises(InvalidRangeError):
        engine.series([])
    with pytest.raises(InvalidRangeError):
        engine.label_values("not-a-name")
    assert len(Engine.functions()) == 33 + 2 and "rate" in Engine.functions()


def test_filters_reach_the_scan_and_windows_stay_in_the_jvm(spark, tmp_path):
    frame(spark, load(CPU)).write.parquet(str(tmp_path / "s"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = Engine(spark.read.parquet(str(tmp_path / "s"))).plan('sum by (host) (rate(cpu{dc="eu"}[5m]))', 0, 600_000, 60_000)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(metric,cpu)" in text and "GreaterThanOrEqual(t," in text
    assert "Python" not in text and "NestedLoop" not in text and "Cartesian" not in text


def test_no_matchers_and_printed_selectors():
    assert str(parse('{__name__=~"a|b", x!=""}')) == '{__name__=~"a|b", x!=""}'
