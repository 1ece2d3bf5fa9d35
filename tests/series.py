"""Series in a compact notation, and a slow evaluator to hold the engine against."""

from __future__ import annotations

import math
import re

from tidemark.lang import Aggregate, Binary, Call, Number, Paren, Selector, Unary, ValueType, parse
from tidemark.model import METRIC, SAMPLES_SCHEMA, format_labels

_LINE = re.compile(r"(\w+)(?:\{(.*?)\})?\s+(.*)")


def load(text: str, interval: int = 1000) -> dict[tuple, list[tuple[int, float]]]:
    """Lines `name{a="x"} v0 v1 _ v3`: sample k is at k * interval, _ is a gap."""
    out = {}
    for line in text.strip().splitlines():
        line = line.strip()
        if line and not line.startswith("#"):
            name, labels, values = _LINE.match(line).groups()
            key = tuple(sorted([(METRIC, name), *re.findall(r'(\w+)="([^"]*)"', labels or "")]))
            out[key] = [(k * interval, float(v)) for k, v in enumerate(values.split()) if v != "_"]
    return out


def frame(spark, series: dict):
    rows = [(dict(key)[METRIC], [{"name": a, "value": b} for a, b in key], t, v) for key, samples in series.items() for t, v in samples]
    return spark.createDataFrame(rows, SAMPLES_SCHEMA)


def shown(rows) -> list:
    return [(format_labels(r["labels"]), r["v"]) for r in rows]


def close(a: float, b: float) -> bool:
    if math.isnan(a) or math.isnan(b):
        return math.isnan(a) and math.isnan(b)
    return a == b or abs(a - b) <= 1e-9 * max(1, abs(a), abs(b))


class Slow:
    """One timestamp at a time, over dictionaries: labels -> value."""

    def __init__(self, series: dict, lookback: int = 300_000):
        self.series, self.lookback = series, lookback

    def at(self, query: str, ts: int) -> dict:
        value = self.eval(parse(query), ts)
        return {(): value} if isinstance(value, float) else value

    def chosen(self, node: Selector):
        for key, samples in self.series.items():
            have = dict(key)
            if all(m.matches(have.get(m.name, "")) for m in node.matchers):
                yield key, samples

    def eval(self, node, ts):
        if isinstance(node, Paren):
            return self.eval(node.inner, ts)
        if isinstance(node, Number):
            return node.value
        if isinstance(node, Unary):
            v = self.eval(node.inner, ts)
            return -v if isinstance(v, float) else {nameless(k): -x for k, x in v.items()}
        if isinstance(node, Selector):
            out = {}
            for key, samples in self.chosen(node):
                seen = [(t, v) for t, v in samples if ts - node.offset - self.lookback <= t <= ts - node.offset]
                if seen:
                    out[key] = max(seen)[1]
            return out
        if isinstance(node, Call):
            return self.call(node, ts)
        if isinstance(node, Aggregate):
            return self.aggregate(node, ts)
        assert isinstance(node, Binary)
        return self.binary(node, ts)

    def call(self, node, ts):
        if node.arguments and node.arguments[0].type is ValueType.MATRIX:
            sel = node.arguments[0]
            while isinstance(sel, Paren):
                sel = sel.inner
            out = {}
            for key, samples in self.chosen(sel):
                end = ts - sel.offset
                w = [(t, v) for t, v in samples if end - sel.range < t <= end]
                v = window(node.name, w, end - sel.range, end, sel.range) if w else None
                if v is not None:
                    out[key if node.name in ("min_over_time", "max_over_time", "first_over_time", "last_over_time") else nameless(key)] = v
            return out
        args = [self.eval(a, ts) for a in node.arguments]
        if node.name == "time":
            return ts / 1000
        if node.name == "vector":
            return {(): args[0]}
        if node.name == "scalar":
            return next(iter(args[0].values())) if len(args[0]) == 1 else math.nan
        if node.name == "absent":
            return {} if args[0] else {(): 1.0}
        f = {
            "abs": abs,
            "ceil": lambda v: v if not math.isfinite(v) else float(math.ceil(v)),
            "floor": lambda v: v if not math.isfinite(v) else float(math.floor(v)),
            "sqrt": lambda v: math.nan if v < 0 else math.sqrt(v),
            "exp": math.exp,
            "sgn": lambda v: v if math.isnan(v) or v == 0 else math.copysign(1, v),
            "ln": lambda v: log(v, math.e),
            "timestamp": lambda v: ts / 1000,
            "round": lambda v: rounded(v, args[1] if len(args) > 1 else 1.0),
            "clamp_min": lambda v: math.nan if math.isnan(v) else max(v, args[1]),
            "clamp_max": lambda v: math.nan if math.isnan(v) else min(v, args[1]),
        }[node.name]
        keep = node.name.startswith("clamp")
        return {k if keep else nameless(k): f(v) for k, v in args[0].items()}

    def aggregate(self, node, ts):
        groups: dict = {}
        for key, v in sorted(self.eval(node.inner, ts).items()):
            if node.without:
                g = tuple((a, b) for a, b in key if a not in (*node.labels, METRIC) and b)
            else:
                g = tuple((a, b) for a, b in key if a in node.labels and b)
            groups.setdefault(g, []).append((key, v))
        out = {}
        for g, rows in groups.items():
            vs = [v for _, v in rows]
            real = [v for v in vs if not math.isnan(v)]
            if node.op in ("topk", "bottomk"):
                p = self.eval(node.param, ts)
                rows = sorted(rows, key=lambda r: (math.isnan(r[1]), 0 if math.isnan(r[1]) else (-r[1] if node.op == "topk" else r[1]), r[0]))
                out |= dict(rows[: 0 if math.isnan(p) else max(0, int(p))])
                continue
            if node.op == "quantile":
                out[g] = quantile(self.eval(node.param, ts), vs)
                continue
            mean = sum(vs) / len(vs)
            out[g] = {
                "sum": lambda vs=vs: sum(vs),
                "avg": lambda mean=mean: mean,
                "min": lambda real=real: min(real, default=math.nan),
                "max": lambda real=real: max(real, default=math.nan),
                "count": lambda vs=vs: float(len(vs)),
                "group": lambda: 1.0,
                "stdvar": lambda vs=vs, mean=mean: sum((v - mean) ** 2 for v in vs) / len(vs),
                "stddev": lambda vs=vs, mean=mean: math.sqrt(sum((v - mean) ** 2 for v in vs) / len(vs)),
            }[node.op]()
        return out

    def binary(self, node, ts):
        a, b = self.eval(node.left, ts), self.eval(node.right, ts)
        if isinstance(a, float) and isinstance(b, float):
            return apply(node.op, a, b) if node.op not in TESTS else float(TESTS[node.op](a, b))
        if isinstance(a, float) or isinstance(b, float):
            out = {}
            for k, v in (b if isinstance(a, float) else a).items():
                x, y = (a, v) if isinstance(a, float) else (v, b)
                if node.op not in TESTS:
                    out[nameless(k)] = apply(node.op, x, y)
                elif node.bool_:
                    out[nameless(k)] = float(TESTS[node.op](x, y))
                elif TESTS[node.op](x, y):
                    out[k] = v
            return out
        sig = lambda k: tuple(x for x in k if (x[0] in node.labels if node.on else x[0] not in (*node.labels, METRIC)) and x[1])
        there = {sig(k) for k in b}
        if node.op == "and":
            return {k: v for k, v in a.items() if sig(k) in there}
        if node.op == "unless":
            return {k: v for k, v in a.items() if sig(k) not in there}
        if node.op == "or":
            mine = {sig(k) for k in a}
            return a | {k: v for k, v in b.items() if sig(k) not in mine}
        partner = {sig(k): v for k, v in b.items()}
        assert len(partner) == len(b)
        out = {}
        for k, v in a.items():
            if sig(k) in partner:
                r = partner[sig(k)]
                to = sig(k) if node.on or node.labels else nameless(k)
                if node.op not in TESTS:
                    out[to] = apply(node.op, v, r)
                elif node.bool_:
                    out[to] = float(TESTS[node.op](v, r))
                elif TESTS[node.op](v, r):
                    out[to] = v
        return out


TESTS = {"==": float.__eq__, "!=": float.__ne__, ">": float.__gt__, "<": float.__lt__, ">=": float.__ge__, "<=": float.__le__}


def nameless(key):
    return tuple((a, b) for a, b in key if a != METRIC and b)


def log(v, base):
    return math.nan if math.isnan(v) or v < 0 else -math.inf if v == 0 else math.log(v) / math.log(base)


def rounded(v, n):
    x = apply("/", v, n) + 0.5
    return (float(math.floor(x)) if math.isfinite(x) else x) * n


def apply(op, a, b):
    if op == "/":
        if b == 0:
            return math.nan if a == 0 or math.isnan(a) else math.copysign(math.inf, a) * math.copysign(1, b)
        return a / b
    if op == "%":
        return math.nan if b == 0 or math.isinf(a) or math.isnan(a) or math.isnan(b) else math.fmod(a, b)
    if op == "^":
        try:
            r = a**b
            return math.nan if isinstance(r, complex) else r
        except ZeroDivisionError:
            return math.inf
        except OverflowError:
            return math.inf
    return {"+": a + b, "-": a - b, "*": a * b}[op]


def quantile(phi, vs):
    if math.isnan(phi):
        return math.nan
    if phi < 0 or phi > 1:
        return math.copysign(math.inf, phi - 0.5)
    vs = sorted(vs, key=lambda v: (not math.isnan(v), 0 if math.isnan(v) else v))
    rank = phi * (len(vs) - 1)
    low, high = vs[math.floor(rank)], vs[math.ceil(rank)]
    return low if rank == math.floor(rank) else low * (1 - rank % 1) + high * (rank % 1)


def window(name, w, start, end, width):
    vs = [v for _, v in w]
    pairs = list(zip(w[:-1], w[1:], strict=True))
    real = [v for v in vs if not math.isnan(v)]
    mean = sum(vs) / len(vs)
    if name in ("rate", "increase", "delta"):
        if len(w) < 2:
            return None
        change = vs[-1] - vs[0] + (0 if name == "delta" else sum(a[1] for a, b in pairs if b[1] < a[1]))
        span = w[-1][0] - w[0][0]
        gap = span / (len(w) - 1)
        ext = span + sum(d if d < gap * 1.1 else gap / 2 for d in (w[0][0] - start, end - w[-1][0]))
        return change * (ext / span) / (width / 1000 if name == "rate" else 1)
    if name in ("irate", "idelta"):
        if len(w) < 2:
            return None
        (t0, a), (t1, b) = w[-2:]
        return b - a if name == "idelta" else (b if b - a < 0 else b - a) / ((t1 - t0) / 1000)
    return {
        "resets": lambda: float(sum(b[1] < a[1] for a, b in pairs)),
        "changes": lambda: float(sum(a[1] != b[1] and not (math.isnan(a[1]) and math.isnan(b[1])) for a, b in pairs)),
        "avg_over_time": lambda: mean,
        "sum_over_time": lambda: sum(vs),
        "min_over_time": lambda: min(real, default=math.inf),
        "max_over_time": lambda: max(real, default=-math.inf),
        "count_over_time": lambda: float(len(vs)),
        "last_over_time": lambda: vs[-1],
        "first_over_time": lambda: vs[0],
        "stdvar_over_time": lambda: sum((v - mean) ** 2 for v in vs) / len(vs),
        "stddev_over_time": lambda: math.sqrt(sum((v - mean) ** 2 for v in vs) / len(vs)),
    }[name]()
