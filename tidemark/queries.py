"""Contract queries: expressions over the series of the driver's tables, and the SQL that they are held against.

Each query is evaluated on a fixed grid and shown as plain columns: the series' labels, the time and the value rounded to
four decimals (after adding NUDGE, as the two sides add up in another order and would round exact halves apart). The SQL is written apart from the compiler: it joins samples with the grid by inequalities.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine, Options
from .errors import ParseError
from .model import get_label
from .sources import store, tables

DAY = 86_400_000
STEP = 6 * 3_600_000
START, END = 1_704_153_600_000, 1_706_745_600_000
#: Orders and line items span years.
NUDGE = 1.234567e-6
LONG_START, LONG_END, LONG_STEP, LONG_WINDOW = 788_918_400_000, 1_009_843_200_000, 30 * DAY, 60 * DAY

#: Samples of each series set, in SQL.
SAMPLES = {
    "events_value": "SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) // 1000 AS t, arg_max(value, event_id) AS v FROM events GROUP BY ALL",
    "events_type_value": "SELECT event_type, epoch_us(ts) // 1000 AS t, arg_max(value, event_id) AS v FROM events GROUP BY ALL",
    "events_total": "SELECT event_type, t, CAST(max(r) AS DOUBLE) AS v FROM (SELECT event_type, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events) GROUP BY ALL",
    "events_daily_total": "SELECT event_type, t, CAST(max(r) AS DOUBLE) AS v FROM (SELECT event_type, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS r FROM events) GROUP BY ALL",
    "orders_total": "SELECT o_orderpriority AS priority, epoch_ms(date_trunc('day', o_orderdate)::TIMESTAMP) AS t, sum(o_totalprice) AS v FROM orders GROUP BY ALL",
    "lineitem_qty": "SELECT l_returnflag AS returnflag, l_linestatus AS linestatus, epoch_ms(date_trunc('day', l_shipdate)::TIMESTAMP) AS t, sum(l_quantity) AS v FROM lineitem GROUP BY ALL",
}
LABELS = {"events_value": ["event_type", "user_id"], "orders_total": ["priority"], "lineitem_qty": ["returnflag", "linestatus"]}


@dataclass(frozen=True)
class Query:
    """labels: the label columns of the result. sql gives (labels..., ts, v) and is rounded outside."""

    series: str
    text: str
    labels: tuple[str, ...]
    sql: str
    long: bool = False

    @property
    def grid(self) -> tuple[int, int, int]:
        return (LONG_START, LONG_END, LONG_STEP) if self.long else (START, END, STEP)

    def plan(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(tables.SERIES[self.series](spark, sf_dir), Options(lookback=LONG_WINDOW if self.long else DAY, max_samples=None))
        rows = engine.plan(self.text, *self.grid)
        return rows.select(*[get_label(F.col("labels"), n).alias(n) for n in self.labels], "ts", F.round(F.col("v") + NUDGE, 4).alias("v"))

    @property
    def oracle(self) -> str:
        start, end, step = self.grid
        columns = "".join(f"{n}, " for n in self.labels)
        return f"WITH samples AS ({SAMPLES[self.series]}), steps AS (SELECT unnest(generate_series({start}, {end}, {step})) AS ts), q AS ({self.sql}) SELECT {columns}ts, round(v + {NUDGE}, 4) AS v FROM q"


def _instant(keys: str, where: str = "true", offset: int = 0, lookback: int = DAY) -> str:
    return f"SELECT {keys}, steps.ts, arg_max(s.v, s.t) AS v FROM steps JOIN samples s ON s.t >= steps.ts - {offset} - {lookback} AND s.t <= steps.ts - {offset} WHERE {where} GROUP BY ALL"


def _rows(keys: str, where: str = "true", offset: int = 0, width: int = DAY) -> str:
    """The samples of each window, with the one before in the window."""
    return f"SELECT {keys}, steps.ts, s.t, s.v, lag(s.v) OVER w AS pv, lag(s.t) OVER w AS pt, count(*) OVER (PARTITION BY {keys}, steps.ts) AS n, row_number() OVER (PARTITION BY {keys}, steps.ts ORDER BY s.t DESC) AS back FROM steps JOIN samples s ON s.t > steps.ts - {offset} - {width} AND s.t <= steps.ts - {offset} WHERE {where} WINDOW w AS (PARTITION BY {keys}, steps.ts ORDER BY s.t)"


def _window(keys: str, value: str, where: str = "true", offset: int = 0, width: int = DAY, having: str = "true") -> str:
    return f"SELECT {keys}, ts, {value} AS v FROM ({_rows(keys, where, offset, width)}) GROUP BY {keys}, ts HAVING {having}"


def _extrapolated(counter: bool, per_second: bool, offset: int = 0, width: int = DAY) -> str:
    change = "(arg_max(v, t) - arg_min(v, t))" + (" + sum(CASE WHEN v < pv THEN pv ELSE 0 END)" if counter else "")
    span = "CAST(max(t) - min(t) AS DOUBLE)"
    gap = f"({span} / (count(*) - 1))"
    head, tail = f"(min(t) - (ts - {offset} - {width}))", f"((ts - {offset}) - max(t))"
    near = lambda d: f"(CASE WHEN {d} < 1.1 * {gap} THEN {d} ELSE {gap} / 2 END)"
    v = f"({change}) * (({span} + {near(head)} + {near(tail)}) / {span})"
    return f"{v} / {width / 1000}" if per_second else v


ET, EU = "event_type", "event_type, user_id"


def _queries() -> dict[str, Query]:
    out: dict[str, Query] = {}

    def add(key: str, series: str, text: str, labels: str, sql: str, long: bool = False) -> None:
        out[key] = Query(series, text, tuple(x for x in labels.split(", ") if x), sql, long)

    value, by_type, total, daily = "events_value", "events_type_value", "events_total", "events_daily_total"

    # selectors
    add("sel_instant", value, "events_value", EU, _instant(EU))
    add("sel_lookback", by_type, "events_value", ET, _instant(ET))
    add("sel_offset", value, "events_value offset 12h", EU, _instant(EU, offset=DAY // 2))
    add("sel_offset_negative", by_type, "events_value offset -3h", ET, _instant(ET, offset=-3 * 3_600_000))
    add("sel_eq", value, 'events_value{event_type="click"}', EU, _instant(EU, "event_type = 'click'"))
    add("sel_ne", value, 'events_value{event_type!="click"}', EU, _instant(EU, "event_type <> 'click'"))
    add("sel_re", value, 'events_value{event_type=~"c.*|view"}', EU, _instant(EU, "regexp_full_match(event_type, 'c.*|view')"))
    add("sel_re_set", value, 'events_value{event_type=~"click|error"}', EU, _instant(EU, "event_type IN ('click', 'error')"))
    add("sel_nre", value, 'events_value{user_id!~"1.*"}', EU, _instant(EU, "NOT regexp_full_match(user_id, '1.*')"))
    add("sel_conjunction", value, '{__name__="events_value", event_type!="error", user_id=~"[1-4]"}', EU, _instant(EU, "event_type <> 'error' AND user_id IN ('1', '2', '3', '4')"))
    add("sel_missing_label", value, 'events_value{region="", event_type="view"}', EU, _instant(EU, "event_type = 'view'"))
    add("sel_missing_label_none", value, 'events_value{region!=""}', EU, _instant(EU, "false"))
    add("sel_orders", "orders_total", "orders_total", "priority", _instant("priority", lookback=LONG_WINDOW), True)
    add("sel_lineitem", "lineitem_qty", 'lineitem_qty{returnflag!="N"}', "returnflag, linestatus", _instant("returnflag, linestatus", "returnflag <> 'N'", lookback=LONG_WINDOW), True)

    # windows
    two = "count(*) >= 2"
    add("rate", total, "rate(events_total[1d])", ET, _window(ET, _extrapolated(True, True), having=two))
    add("rate_reset", daily, "rate(events_daily_total[1d])", ET, _window(ET, _extrapolated(True, True), having=two))
    add("rate_offset", daily, "rate(events_daily_total[18h] offset 6h)", ET, _window(ET, _extrapolated(True, True, STEP, 64_800_000), offset=STEP, width=64_800_000, having=two))
    add("rate_odd_width", daily, "rate(events_daily_total[7h11m])", ET, _window(ET, _extrapolated(True, True, 0, 25_860_000), width=25_860_000, having=two))
    add("increase", daily, "increase(events_daily_total[1d])", ET, _window(ET, _extrapolated(True, False), having=two))
    add("delta", by_type, "delta(events_value[1d])", ET, _window(ET, _extrapolated(False, False), having=two))
    last = "SELECT event_type, ts, {} AS v FROM ({}) WHERE back = 1 AND n >= 2"
    add("irate", daily, "irate(events_daily_total[1d])", ET, last.format("(CASE WHEN v < pv THEN v ELSE v - pv END) / ((t - pt) / 1000.0)", _rows(ET)))
    add("idelta", by_type, "idelta(events_value[1d])", ET, last.format("v - pv", _rows(ET)))
    add("resets", daily, "resets(events_daily_total[1d])", ET, _window(ET, "CAST(sum(CASE WHEN v < pv THEN 1 ELSE 0 END) AS DOUBLE)"))
    add("changes", by_type, "changes(events_value[12h])", ET, _window(ET, "CAST(sum(CASE WHEN v <> pv THEN 1 ELSE 0 END) AS DOUBLE)", width=DAY // 2))
    over = {"avg": "avg(v)", "sum": "sum(v)", "min": "min(v)", "max": "max(v)", "count": "CAST(count(*) AS DOUBLE)", "last": "arg_max(v, t)", "first": "arg_min(v, t)", "stddev": "stddev_pop(v)", "stdvar": "var_pop(v)"}
    for name, sql in over.items():
        add(f"{name}_over_time", value, f"{name}_over_time(events_value[1d])", EU, _window(EU, sql))
    add("sum_over_time_tumbling", by_type, "sum_over_time(events_value[6h])", ET, _window(ET, "sum(v)", width=STEP))
    add("sum_over_time_orders", "orders_total", "sum_over_time(orders_total[60d])", "priority", _window("priority", "sum(v)", width=LONG_WINDOW), True)
    add("avg_over_time_lineitem", "lineitem_qty", "avg_over_time(lineitem_qty[60d])", "returnflag, linestatus", _window("returnflag, linestatus", "avg(v)", width=LONG_WINDOW), True)

    # scalar functions
    each = {
        "abs": ("abs(events_value - 100)", "abs(v - 100)"),
        "ceil": ("ceil(events_value / 7)", "ceil(v / 7)"),
        "floor": ("floor(events_value / 7)", "floor(v / 7)"),
        "sqrt": ("sqrt(events_value)", "sqrt(v)"),
        "exp": ("exp(events_value / 100)", "exp(v / 100)"),
        "ln": ("ln(events_value)", "ln(v)"),
        "log2": ("log2(events_value)", "log2(v)"),
        "log10": ("log10(events_value)", "log10(v)"),
        "sgn": ("sgn(events_value - 100)", "CAST(sign(v - 100) AS DOUBLE)"),
        "round": ("round(events_value)", "floor(v + 0.5)"),
        "round_to": ("round(events_value, 5)", "floor(v / 5 + 0.5) * 5"),
        "clamp_min": ("clamp_min(events_value, 50)", "greatest(v, 50.0)"),
        "clamp_max": ("clamp_max(events_value, 50)", "least(v, 50.0)"),
        "timestamp": ("timestamp(events_value)", "ts / 1000.0"),
        "unary_minus": ("-events_value", "-v"),
        "unary_plus": ("+(events_value)", "v"),
    }
    for name, (text, sql) in each.items():
        add(f"fn_{name}" if "unary" not in name else name, by_type, text, ET, f"SELECT event_type, ts, {sql} AS v FROM ({_instant(ET)})")
    add("fn_scalar", by_type, 'scalar(events_value{event_type="click"}) * 2', "", f"SELECT ts, v * 2 AS v FROM steps JOIN ({_instant(ET, chr(39).join(('event_type = ', 'click', '')))}) USING (ts)")
    add("fn_vector", by_type, "vector(3) + 1", "", "SELECT ts, 4.0 AS v FROM steps")
    add("fn_time", by_type, "time() / 60", "", "SELECT ts, ts / 1000.0 / 60 AS v FROM steps")
    add("fn_absent", by_type, 'absent(events_value{event_type="none"})', "", "SELECT ts, 1.0 AS v FROM steps")
    add("fn_absent_sparse", value, 'absent(events_value{event_type="click", user_id="3"})', "", f"SELECT ts, 1.0 AS v FROM steps WHERE ts NOT IN (SELECT ts FROM ({_instant(EU, chr(39).join(('event_type = ', 'click', ' AND user_id = ', '3', '')))}))")
    add("number_literal", by_type, "0x1f + 1.5", "", "SELECT ts, 32.5 AS v FROM steps")

    # aggregations
    grouped = {"sum": "sum(v)", "avg": "avg(v)", "min": "min(v)", "max": "max(v)", "count": "CAST(count(*) AS DOUBLE)", "group": "1.0", "stddev": "stddev_pop(v)", "stdvar": "var_pop(v)"}
    for name, sql in grouped.items():
        add(f"agg_{name}", value, f"{name} by (event_type) (events_value)", ET, f"SELECT event_type, ts, {sql} AS v FROM ({_instant(EU)}) GROUP BY ALL")
    add("agg_sum_without", value, "sum without (user_id) (events_value)", ET, f"SELECT event_type, ts, sum(v) AS v FROM ({_instant(EU)}) GROUP BY ALL")
    add("agg_avg_without", value, "avg(events_value) without (event_type)", "user_id", f"SELECT user_id, ts, avg(v) AS v FROM ({_instant(EU)}) GROUP BY ALL")
    add("agg_sum_global", value, "sum(events_value)", "", f"SELECT ts, sum(v) AS v FROM ({_instant(EU)}) GROUP BY ALL")
    add("agg_count_without_none", by_type, "count without () (events_value)", ET, f"SELECT event_type, ts, CAST(count(*) AS DOUBLE) AS v FROM ({_instant(ET)}) GROUP BY ALL")
    ranks = "SELECT event_type, user_id, ts, v FROM (SELECT *, row_number() OVER (PARTITION BY event_type, ts ORDER BY v {}, event_type, user_id) AS r FROM ({})) WHERE r <= {}"
    add("agg_topk", value, "topk by (event_type) (3, events_value)", EU, ranks.format("DESC", _instant(EU), 3))
    add("agg_bottomk", value, "bottomk(2, events_value) by (event_type)", EU, ranks.format("ASC", _instant(EU), 2))
    add("agg_quantile", value, "quantile by (event_type) (0.9, events_value)", ET, f"SELECT event_type, ts, quantile_cont(v, 0.9) AS v FROM ({_instant(EU)}) GROUP BY ALL")
    add("agg_quantile_global", value, "quantile(0.5, events_value)", "", f"SELECT ts, quantile_cont(v, 0.5) AS v FROM ({_instant(EU)}) GROUP BY ALL")
    add("sum_rate", daily, "sum(rate(events_daily_total[1d]))", "", f"SELECT ts, sum(v) AS v FROM ({_window(ET, _extrapolated(True, True), having=two)}) GROUP BY ALL")

    # binary operators
    a = _instant(ET)
    arithmetic = {"add": ("+", "v + 7.5"), "sub": ("-", "v - 7.5"), "mul": ("*", "v * 7.5"), "div": ("/", "v / 7.5"), "mod": ("%", "v % 7.5"), "pow": ("^", "pow(v, 1.5)")}
    for name, (op, sql) in arithmetic.items():
        add(f"bin_{name}", by_type, f"events_value {op} {1.5 if name == 'pow' else 7.5}", ET, f"SELECT event_type, ts, {sql} AS v FROM ({a})")
    for name, op, test in (("eq", "==", "="), ("ne", "!=", "<>"), ("gt", ">", ">"), ("lt", "<", "<"), ("ge", ">=", ">="), ("le", "<=", "<=")):
        add(f"bin_{name}", by_type, f"round(events_value, 10) {op} 20", ET, f"SELECT event_type, ts, v FROM (SELECT event_type, ts, floor(v / 10 + 0.5) * 10 AS v FROM ({a})) WHERE v {test} 20")
        add(f"bin_{name}_bool", by_type, f"round(events_value, 10) {op} bool 20", ET, f"SELECT event_type, ts, CASE WHEN floor(v / 10 + 0.5) * 10 {test} 20 THEN 1.0 ELSE 0.0 END AS v FROM ({a})")
    add("bin_scalar_left", by_type, "100 - events_value", ET, f"SELECT event_type, ts, 100 - v AS v FROM ({a})")
    add("bin_scalar_left_filter", by_type, "50 < events_value", ET, f"SELECT event_type, ts, v FROM ({a}) WHERE 50 < v")
    add("bin_scalar_scalar", by_type, "(2 + 3 * 4) ^ 2 % 10 - (1 > bool 2)", "", "SELECT ts, 6.0 AS v FROM steps")
    add("bin_scalar_time", by_type, "events_value + time() % 1000", ET, f"SELECT event_type, ts, v + (ts / 1000.0) % 1000 AS v FROM ({a})")
    mean = _window(EU, "avg(v)")
    add("bin_vector", value, "events_value / avg_over_time(events_value[1d])", EU, f"SELECT a.event_type, a.user_id, a.ts, a.v / b.v AS v FROM ({_instant(EU)}) a JOIN ({mean}) b USING (event_type, user_id, ts)")
    add("bin_vector_filter", value, "events_value > avg_over_time(events_value[1d])", EU, f"SELECT a.event_type, a.user_id, a.ts, a.v FROM ({_instant(EU)}) a JOIN ({mean}) b USING (event_type, user_id, ts) WHERE a.v > b.v")
    by_et = lambda f: f"SELECT event_type, ts, {f}(v) AS v FROM ({_instant(EU)}) GROUP BY ALL"
    add("bin_on", value, "sum by (event_type) (events_value) / on (event_type) count by (event_type) (events_value)", ET, f"SELECT a.event_type, a.ts, a.v / b.v AS v FROM ({by_et('sum')}) a JOIN ({by_et('count')}) b USING (event_type, ts)")
    pick = lambda u: _instant(EU, f"user_id = '{u}'")
    add("bin_ignoring", value, 'events_value{user_id="3"} - ignoring (user_id) events_value{user_id="4"}', ET, f"SELECT a.event_type, a.ts, a.v - b.v AS v FROM ({pick(3)}) a JOIN ({pick(4)}) b USING (event_type, ts)")
    big = f"SELECT * FROM ({_instant(EU)}) WHERE v > 40"
    key = "(event_type, user_id, ts)"
    add("set_and", value, 'events_value and events_value{event_type=~"click|view"} > 40', EU, f"SELECT * FROM ({_instant(EU)}) WHERE {key} IN (SELECT {key} FROM ({big}) WHERE event_type IN ('click', 'view'))")
    add("set_unless", value, "events_value unless (events_value > 40)", EU, f"SELECT * FROM ({_instant(EU)}) WHERE {key} NOT IN (SELECT {key} FROM ({big}))")
    add("set_or", value, '(events_value > 40) or events_value{event_type="click"}', EU, f"SELECT event_type, user_id, ts, v FROM ({big}) UNION ALL SELECT event_type, user_id, ts, v FROM ({_instant(EU)}) WHERE event_type = 'click' AND {key} NOT IN (SELECT {key} FROM ({big}))")
    add("set_and_on", value, "events_value and on (user_id) (events_value > 200)", EU, f"SELECT * FROM ({_instant(EU)}) WHERE (user_id, ts) IN (SELECT (user_id, ts) FROM ({_instant(EU)}) WHERE v > 200)")
    return out


QUERIES = _queries()


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(tables.events_value(spark, sf_dir))


def _labels(rows: DataFrame) -> DataFrame:
    return rows.select(*[get_label(F.col("labels"), n).alias(n) for n in ("event_type", "user_id")])


def sel_range_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Engine(tables.events_by_type(spark, sf_dir), Options(lookback=DAY)).plan("events_value[6h] offset 1h", START, END, STEP)
    return rows.select(get_label(F.col("labels"), "event_type").alias("event_type"), "ts", "t", F.round("v", 4).alias("v"))


def dedup_later_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tiers with the same times, of which the later counts."""
    a = tables.events_by_type(spark, sf_dir).withColumn("seq", F.lit(1))
    b = a.where("t % 3 = 0").withColumn("v", F.col("v") * 2).withColumn("seq", F.lit(2))
    return store.later_wins(a.unionByName(b)).select(get_label(F.col("labels"), "event_type").alias("event_type"), "t", F.round("v", 4).alias("v"))


def ingest_reject_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive in the order of user and event; only those above all earlier times of their type are taken."""
    e = tables.events(spark, sf_dir)
    rows = e.select(F.array(F.struct(F.lit("event_type").alias("name"), F.col("event_type").alias("value"))).alias("labels"), "t", "value", "event_id", F.struct(F.col("user_id") % 7, "event_id").alias("seq"), F.lit(None).cast("string").alias("reason"))
    checked = store.in_order(rows, None, START)
    return checked.select("event_id", F.coalesce("reason", F.lit("ok")).alias("reason"))


def _new_store(spark: SparkSession, **options) -> store.Store:
    """An empty store in the folder that driver and executors share; a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
    return store.Store(spark, f"{folder.rstrip('/')}/store-{uuid.uuid4().hex}", **options)


def _as_rows(samples: DataFrame, seq: Column) -> DataFrame:
    """Samples as rows to ingest (labels map, t, v, seq)."""
    return samples.select(F.map_from_entries("labels").alias("labels"), "t", "v", seq.alias("seq"))


def _stored_week(spark: SparkSession, sf_dir: str, **options) -> store.Store:
    """The events in three batches, by START plus 8 and 16 days; after each the head is flushed as far as whole days go."""
    samples = tables.events_by_type(spark, sf_dir)
    kept = _new_store(spark, block=DAY, ladder=(DAY, 3 * DAY, 9 * DAY, 27 * DAY), **options)
    bounds = [START, START + 8 * DAY, START + 16 * DAY, END]
    for first, last in zip(bounds[:-1], bounds[1:], strict=True):
        kept.ingest(_as_rows(samples.where((F.col("t") >= first) & (F.col("t") < last)), F.col("t")), split=True)
        kept.flush()
    return kept


def _listed(spark: SparkSession, blocks: list[store.Block]) -> DataFrame:
    """Blocks as rows: bounds, samples, level, parents and sources in number."""
    return spark.createDataFrame([(b.min_time, b.max_time, b.samples, b.level, len(b.parents)) for b in blocks], "min_time long, max_time long, samples long, level int, parents int")


def flushed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head and blocks after three batches and flushes (level 0 is the head)."""
    return _listed(spark, _stored_week(spark, sf_dir).blocks)


def flushed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples of a store whose blocks were flushed, merged and dropped since the frame was made: a snapshot stays readable."""
    kept = _stored_week(spark, sf_dir, retention=DAY)
    rows = kept.samples()
    kept.force_compact()
    kept.retain(END + 100 * DAY)
    return rows.select(get_label(F.col("labels"), "event_type").alias("event_type"), "t", F.round("v", 4).alias("v"))


def compaction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each block of a store with one block a day is named by the next plan: the first run of one window that fills it by half."""
    samples = tables.events_by_type(spark, sf_dir)
    days = samples.groupBy((F.col("t") - F.pmod("t", F.lit(DAY))).alias("day")).agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count(F.lit(1)).alias("n"))
    blocks = [store.Block(str(r["day"]), r["a"], r["b"], r["n"]) for r in days.collect()]  # a row a day
    named = {b.id for b in store.plan_compaction(blocks, (9 * DAY, 27 * DAY))}
    return spark.createDataFrame([(int(b.id), b.samples, b.id in named) for b in blocks], "day long, samples long, named boolean")


def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one compaction makes of the flushed blocks: the merged block with its level and lineage beside the head."""
    kept = _stored_week(spark, sf_dir)
    late = tables.events_by_type(spark, sf_dir).where((F.col("t") >= START + 2 * DAY) & (F.col("t") < START + 4 * DAY)).withColumn("v", F.col("v") + 1)
    block = kept._write(late, 1, [])
    kept.blocks.append(block)
    kept.compact()
    rows = kept.samples()
    out = rows.groupBy(get_label(F.col("labels"), "event_type").alias("event_type")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("total"))
    merged = max(kept.blocks, key=lambda b: b.level)
    return out.withColumns({"level": F.lit(merged.level), "parents": F.lit(len(merged.parents)), "sources": F.lit(len(merged.sources))})


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that are left by a retention of ten days when ten days after the second batch's end have passed."""
    kept = _stored_week(spark, sf_dir, retention=10 * DAY)
    kept.retain(START + 18 * DAY + 1)
    return _listed(spark, kept.blocks)


def write_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a JSON write request, of which the samples with an even region key come a second time and are refused."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()  # 25 rows
    series = [{"labels": {"__name__": "nation", "name": r["n_name"].strip()}, "samples": [{"t": 1000 + r["n_regionkey"], "v": r["n_nationkey"]}] * (2 - r["n_regionkey"] % 2)} for r in nations]
    kept = _new_store(spark)
    done = kept.write_request(json.dumps({"series": series}).encode())
    rows = kept.samples().select(get_label(F.col("labels"), "name").alias("name"), "t", "v")
    return rows.withColumns({"accepted": F.lit(done.accepted), "rejected": F.lit(done.rejected)})


def match_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which expressions are refused: many-to-many matches when they run, selectors that would take any series when they are read."""
    engine = Engine(tables.events_value(spark, sf_dir), Options(lookback=40 * DAY))
    texts = ["events_value + on (event_type) events_value", "events_value + events_value", "sum by (event_type) (events_value) * on (event_type) events_value", '{event_type=~".*"}', '{event_type!="x"}', '{event_type="click"}']
    out = []
    for text in texts:
        try:
            engine.plan(text, END, END, STEP).agg(F.count("v")).collect()
            out.append((text, "ok"))
        except ParseError:
            out.append((text, "not read"))
        except Exception as e:
            if "many-to-many" not in str(e):
                raise
            out.append((text, "many-to-many"))
    return spark.createDataFrame(out, "query string, outcome string")


_VALUES = f"({SAMPLES['events_value']})"
_BY_TYPE = f"({SAMPLES['events_type_value']})"
#: Three batches; each flush takes the head up to the last whole day and leaves the rest as the head of the next.
_BLOCKS = f"""WITH s AS (SELECT t FROM {_BY_TYPE} WHERE t >= {START} AND t < {END}),
b AS (SELECT max(t) FILTER (t < {START + 8 * DAY}) // {DAY} * {DAY} AS x, max(t) FILTER (t < {START + 16 * DAY}) // {DAY} * {DAY} AS y, max(t) // {DAY} * {DAY} AS z FROM s)
SELECT min(t) AS min_time, max(t) AS max_time, count(*) AS samples, CASE WHEN t < z THEN 1 ELSE 0 END AS level, 0 AS parents
FROM s, b GROUP BY t < x, t < y, t < z, level"""
OTHER: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "sel_range_long": (
        sel_range_long,
        f"WITH steps AS (SELECT unnest(generate_series({START}, {END}, {STEP})) AS ts) SELECT event_type, steps.ts, s.t, round(s.v, 4) AS v FROM steps JOIN {_BY_TYPE} s ON s.t > steps.ts - 3600000 - {STEP} AND s.t <= steps.ts - 3600000",
    ),
    "meta_series": (
        lambda spark, sf_dir: _labels(_engine(spark, sf_dir).series(['events_value{event_type="click"}', 'events_value{user_id=~"1."}'], START, START + 5 * DAY)),
        f"SELECT DISTINCT event_type, user_id FROM {_VALUES} WHERE t BETWEEN {START} AND {START + 5 * DAY} AND (event_type = 'click' OR regexp_full_match(user_id, '1.'))",
    ),
    "meta_label_names": (lambda spark, sf_dir: _engine(spark, sf_dir).label_names(), "SELECT unnest(['__name__', 'event_type', 'user_id']) AS name"),
    "meta_label_values": (lambda spark, sf_dir: _engine(spark, sf_dir).label_values("user_id"), "SELECT DISTINCT CAST(user_id AS VARCHAR) AS value FROM events"),
    "meta_label_values_matched": (lambda spark, sf_dir: _engine(spark, sf_dir).label_values("event_type", ['events_value{user_id="3"}']), "SELECT DISTINCT event_type AS value FROM events WHERE user_id = 3"),
    "dedup_later_wins": (dedup_later_wins, f"SELECT event_type, t, round(CASE WHEN t % 3 = 0 THEN v * 2 ELSE v END, 4) AS v FROM {_BY_TYPE}"),
    "ingest_reject_out_of_order": (
        ingest_reject_out_of_order,
        f"SELECT event_id, CASE WHEN t < {START} THEN 'sample is older than the head''s floor' WHEN t <= m THEN 'out of order sample' ELSE 'ok' END AS reason FROM (SELECT event_id, epoch_us(ts) // 1000 AS t, max(epoch_us(ts) // 1000) OVER (PARTITION BY event_type ORDER BY user_id % 7, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events)",
    ),
    "flushed_blocks": (flushed_blocks, _BLOCKS),
    "flushed_samples": (flushed_samples, f"SELECT event_type, t, round(v, 4) AS v FROM {_BY_TYPE} WHERE t >= {START}"),
    "compaction_plan": (
        compaction_plan,
        f"WITH b AS (SELECT t - t % {DAY} AS day, min(t) AS a, max(t) AS b, count(*) AS n FROM {_BY_TYPE} GROUP BY ALL), w AS (SELECT *, a // {9 * DAY} AS g FROM b), due AS (SELECT g, count(*) AS k, sum(b - a) AS filled FROM w GROUP BY g HAVING count(*) > 1 AND sum(b - a) >= {9 * DAY // 2}) SELECT day, n AS samples, g = (SELECT min(g) FROM due) AS named FROM w",
    ),
    "compacted": (
        compacted,
        f"SELECT event_type, count(*) AS n, round(sum(CASE WHEN t >= {START + 2 * DAY} AND t < {START + 4 * DAY} THEN v + 1 ELSE v END), 2) AS total, 2 AS level, 2 AS parents, 2 AS sources FROM {_BY_TYPE} WHERE t >= {START} GROUP BY ALL",
    ),
    "retention": (retention, f"SELECT * FROM ({_BLOCKS}) WHERE level = 0 OR max_time >= {START + 8 * DAY + 1}"),
    "write_request": (
        write_request,
        "SELECT trim(n_name) AS name, CAST(1000 + n_regionkey AS BIGINT) AS t, CAST(n_nationkey AS DOUBLE) AS v, (SELECT CAST(count(*) AS INTEGER) FROM nation) AS accepted, (SELECT CAST(count(*) AS INTEGER) FROM nation WHERE n_regionkey % 2 = 0) AS rejected FROM nation",
    ),
    "match_errors": (
        match_errors,
        "SELECT unnest(['events_value + on (event_type) events_value', 'events_value + events_value', 'sum by (event_type) (events_value) * on (event_type) events_value', '{event_type=~\".*\"}', '{event_type!=\"x\"}', '{event_type=\"click\"}']) AS query, unnest(['many-to-many', 'ok', 'many-to-many', 'not read', 'not read', 'ok']) AS outcome",
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q.plan for k, q in QUERIES.items()} | {k: f for k, (f, _) in OTHER.items()}


def oracles() -> dict[str, str]:
    return {k: q.oracle for k, q in QUERIES.items()} | {k: sql for k, (_, sql) in OTHER.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a second of each type, over a day, every hour."""
    rows = Engine(tables.events_total(spark, sf_dir), Options(max_samples=None)).plan("sum by (event_type) (rate(events_total[1d]))", START, END, 3_600_000)
    return rows.select(get_label(F.col("labels"), "event_type").alias("event_type"), "ts", "v")


__all__ = ["OTHER", "QUERIES", "flagship", "oracles", "queries"]
