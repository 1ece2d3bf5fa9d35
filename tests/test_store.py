import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.errors import ClosedError, WriteError
from tidemark.sources.requests import MOST_BYTES, parse_body
from tidemark.sources.store import Block, Store, in_order, later_wins, plan_compaction
from tidemark.streaming.ingest import request_stream, start_ingest


def body(first, last, step=1000, hosts="ab", value=lambda t: float(t)):
    return json.dumps({"series": [{"labels": {"__name__": "cpu", "host": h}, "samples": [{"t": t, "v": value(t)} for t in range(first, last, step)]} for h in hosts]}).encode()


def store(spark, tmp_path, **more):
    return Store(spark, f"file://{tmp_path}/store", **({"block": 10_000, "ladder": (10_000, 30_000, 90_000)} | more))


def test_flush_restart_dedup_and_compaction(spark, tmp_path):
    s = store(spark, tmp_path, retention=50_000)
    assert s.flush() is None and s.compact() is None and s.samples().count() == 0
    assert (s.write_request(body(0, 45_000)).accepted, s.samples().count()) == (90, 90)
    block = s.flush()
    assert (block.min_time, block.max_time, block.samples, block.level, s.floor) == (0, 39_000, 80, 1, 40_000)
    assert s.samples().count() == 90
    again = store(spark, tmp_path)  # a restart reads the manifest
    assert again.samples().count() == 90 and again.floor == 40_000
    late = again.write_request(body(30_000, 31_000))
    assert (late.accepted, late.rejected) == (0, 2) and "floor" in late.errors[0]
    again.write_request(body(45_000, 60_000))
    assert again.flush().max_time == 49_000
    merged = again.compact()
    assert (merged.level, len(merged.parents), len(merged.sources), merged.samples) == (2, 2, 2, 100)
    rows = again.samples().collect()
    assert len(rows) == 120 == len({(str(r.labels), r.t) for r in rows})
    assert [r.v for r in Engine(again.samples()).instant("sum(cpu)", 20_000).collect()] == [40_000.0]
    assert again.samples(5000, 9000).count() == 10
    kept = store(spark, tmp_path, retention=50_000)
    assert kept.retain(99_000) == 0 and kept.retain(100_000) == 1 and kept.samples().count() == 20
    kept.close()
    with pytest.raises(ClosedError):
        kept.samples()


def test_partial_success_and_order(spark, tmp_path):
    s = store(spark, tmp_path)
    request = {
        "series": [
            {"labels": {"__name__": "x"}, "samples": [{"t": 1, "v": 1}, {"t": 2, "v": 2}, {"t": 2, "v": 3}, {"t": 1, "v": 3}, {"t": 3, "v": 4}]},
            {"labels": {"0bad": "y"}, "samples": [{"t": 1, "v": 1}]},
            {"labels": {}, "samples": [{"t": 1, "v": 1}]},
        ]
    }
    got = s.write_request(json.dumps(request).encode())
    assert (got.accepted, got.rejected, len(got.errors)) == (3, 4, 4)
    got = s.write_request(body(0, 60_000, hosts="a", value=float) + b"")
    assert got.accepted == 60
    got = s.write_request(body(0, 60_000, hosts="a"))
    assert (got.accepted, got.rejected, len(got.errors)) == (0, 60, 20) and "aren't listed" in got.errors[-1]


@pytest.mark.parametrize("raw", [b"", b"[]", b'"x"', b'{"x": 1}', b'{"series": [{"labels": {"a": 1}}]}', b'{"series": [{"lbl": {}}]}', b'{"series": [{"labels": {"a": "b"}, "samples": [{"t": "x"}]}]}', b'{"series": [{"labels": {"a": "b"}, "samples": [{"t": 1.5, "v": 1}]}]}'])
def test_bad_bodies(raw):
    with pytest.raises(WriteError):
        parse_body(raw)


def test_large_body():
    with pytest.raises(WriteError):
        parse_body(b" " * (MOST_BYTES + 1))


def test_later_block_wins(spark):
    rng = random.Random(1)
    rows = [("m", [("__name__", "m"), ("k", str(rng.randrange(3)))], rng.randrange(40), rng.random(), seq) for seq in range(4) for _ in range(60)]
    rows = list({(r[1][1], r[2], r[4]): r for r in rows}.values())  # a block holds a series and time once
    want = {}
    for _, labels, t, v, _ in sorted(rows, key=lambda r: r[4]):
        want[labels[1][1], t] = v
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "metric string, labels array<struct<name:string,value:string>>, t long, v double, seq int")
    assert {(r.labels[1].value, r.t): r.v for r in later_wins(df).collect()} == want


def slow_plan(blocks, ladder):
    """Ids of the blocks to merge: overlapping ones as they chain up, else a window of the shortest duration that is due."""
    blocks = sorted(blocks, key=lambda b: b.min_time)
    for k in range(len(blocks)):
        chain = [blocks[k]]
        for b in blocks[k + 1 :]:
            if any(b.min_time <= a.max_time for a in chain):
                chain.append(b)
        if len(chain) > 1:
            return [b.id for b in chain]
    span = lambda b: b.max_time - b.min_time
    for size in ladder:
        # blocks as long as the window part what comes before from what comes after
        place = {b.id: (sum(span(a) >= size and a.min_time < b.min_time for a in blocks), b.min_time // size) for b in blocks if span(b) < size}
        for p in sorted(set(place.values())):
            group = [b for b in blocks if place.get(b.id) == p]
            if len(group) > 1 and 2 * sum(map(span, group)) >= size - size % 2:
                return [b.id for b in group]
    return []


@pytest.mark.parametrize("crowd", [0.3, 0.9, 1.6])
def test_compaction_plan_against_a_slow_one(crowd):
    """Random blocks, apart from each other or not, on a small ladder."""
    rng = random.Random(7)
    due = 0
    for _ in range(400):
        at, blocks = rng.randrange(50), []
        for k in range(rng.randrange(9)):
            long = rng.choice([3, 8, 10, 25, 60])
            blocks.append(Block(str(k), at, at + long, 1, seq=k))
            at += max(1, int(long * crowd)) + (1 if crowd < 1 else rng.randrange(20)) + (long if crowd < 0.5 and rng.random() < 0.9 else 0)
        rng.shuffle(blocks)
        got = [b.id for b in plan_compaction(blocks, (10, 30, 90))]
        assert got == slow_plan(blocks, (10, 30, 90))
        due += bool(got)
    assert due > 20


def test_frames_outlive_what_replaces_their_blocks(spark, tmp_path):
    s = store(spark, tmp_path, retention=1000)
    s.write_request(body(0, 25_000))
    first = s.samples()
    s.flush()
    second = s.samples()
    s.write_request(body(25_000, 42_000))
    s.force_compact()
    third, series = s.samples(), s.series()
    s.retain(10**9)
    assert [x.count() for x in (first, second, third)] == [50, 50, 84] and series.count() > 0 and s.samples().count() == 0
    files = lambda: {p.parent.name for p in (tmp_path / "store" / "blocks").glob("*/*/*.parquet")} and {p.name for p in (tmp_path / "store" / "blocks").iterdir()}
    kept = files()
    assert s.clean() == 0 and files() == kept
    again = store(spark, tmp_path, grace=0)  # a restart knows what to delete
    assert again.clean() == len(kept) and again.clean() == 0
    assert not [p for kind in ("blocks", "series") for p in (tmp_path / "store" / kind).iterdir()]


def test_one_scan_and_look_ups_without_samples(spark, tmp_path):
    s = store(spark, tmp_path)
    for k in range(3):
        s.write_request(body(k * 5000, k * 5000 + 4000, hosts="abc"[k:]))
    plan = s.samples()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1
    engine = Engine(s.samples(), known=s.series)
    values = lambda df: sorted(r[0] for r in df.collect())
    assert values(engine.label_values("host")) == ["a", "b", "c"] and values(engine.label_names()) == ["__name__", "host"]
    assert "v#" not in engine.label_names()._jdf.queryExecution().optimizedPlan().toString()
    plain = Engine(s.samples())
    for first, last in ((0, 4000), (1500, 1600), (4500, 4900), (-5, 10**9), (6500, 20_000), (3000, 5000)):
        for match in (["cpu"], ['cpu{host!="b"}', 'cpu{host=~"c|b"}']):
            want = sorted(str(r.labels) for r in plain.series(match, first, last).collect())
            assert sorted(str(r.labels) for r in engine.series(match, first, last).collect()) == want, (first, last)


def test_order_is_the_same_in_runs(spark):
    rng = random.Random(4)
    rows = [([("__name__", rng.choice("xy"))], k // 3 + rng.randrange(-9, 9), k, "bad" if rng.random() < 0.05 else None) for k in range(400)]
    df = spark.createDataFrame(rows, "labels array<struct<name:string,value:string>>, t long, seq long, reason string")
    newest = spark.createDataFrame([([("__name__", "x")], 12)], "labels array<struct<name:string,value:string>>, newest long")
    top, want = {"x": 12, "y": -(10**9)}, []
    for labels, t, _, bad in rows:
        name = labels[0][1]
        want.append(bad or ("sample is older than the head's floor" if t < 3 else "out of order sample" if t <= top[name] else None))
        top[name] = top[name] if bad else max(top[name], t)
    for runs in (None, F.floor(F.col("seq") / 7)):
        assert [r.reason for r in in_order(df, newest, 3, runs=runs).orderBy("seq").collect()] == want


def test_streaming_ingest_counts_once(spark, tmp_path):
    s = store(spark, tmp_path)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(body(0, 5000).decode() + "\n" + body(4000, 8000).decode() + "\n")
    seen = []

    def run():
        q = start_ingest(request_stream(spark, str(tmp_path / "in")), s, str(tmp_path / "checkpoint"), lambda n, w: seen.append((n, w.accepted, w.rejected)), available_now=True)
        q.awaitTermination()
        assert q.exception() is None

    run()
    (tmp_path / "in" / "2.json").write_text(body(8000, 12_000).decode() + "\n")
    run()
    assert seen == [(0, 16, 2), (1, 8, 0)]
    assert s.samples().count() == 24
    assert s.ingest(spark.createDataFrame([({"a": "b"}, 1, 1.0, 1)], "labels map<string,string>, t long, v double, seq long"), f"{tmp_path}/checkpoint#1").accepted == 0
