"""Names and types of functions and aggregations. What they compute is in the other modules of this package."""

from __future__ import annotations

from dataclasses import dataclass

SCALAR, STRING, VECTOR, MATRIX = "scalar", "string", "instant vector", "range vector"


@dataclass(frozen=True)
class Function:
    name: str
    arguments: tuple[str, ...]
    returns: str = VECTOR
    optional: int = 0
    drops_name: bool = True
    implemented: bool = True


#: Functions over a window that keep the metric's name: their result is one of the window's own values.
_KEEP = ("min_over_time", "max_over_time", "last_over_time", "first_over_time")
_WINDOW = ("rate", "increase", "delta", "irate", "idelta", "resets", "changes", "avg_over_time", "sum_over_time", "min_over_time", "max_over_time", "count_over_time", "last_over_time", "first_over_time", "stddev_over_time", "stdvar_over_time")
_ELEMENT = ("abs", "ceil", "floor", "sqrt", "exp", "ln", "log2", "log10", "sgn")

FUNCTIONS: dict[str, Function] = {
    f.name: f
    for f in (
        *(Function(n, (MATRIX,), drops_name=n not in _KEEP) for n in _WINDOW),
        *(Function(n, (VECTOR,)) for n in _ELEMENT),
        Function("round", (VECTOR, SCALAR), optional=1),
        Function("clamp_min", (VECTOR, SCALAR), drops_name=False),
        Function("clamp_max", (VECTOR, SCALAR), drops_name=False),
        Function("scalar", (VECTOR,), SCALAR),
        Function("vector", (SCALAR,), drops_name=False),
        Function("time", (), SCALAR),
        Function("timestamp", (VECTOR,)),
        Function("absent", (VECTOR,)),
        Function("label_replace", (VECTOR, STRING, STRING, STRING, STRING), implemented=False),
        Function("histogram_quantile", (SCALAR, VECTOR), implemented=False),
    )
}

#: Aggregations, and whether each takes a scalar before its vector.
AGGREGATIONS: dict[str, bool] = {n: n in ("topk", "bottomk", "quantile") for n in ("sum", "avg", "min", "max", "count", "group", "stddev", "stdvar", "topk", "bottomk", "quantile")}
