"""Write requests: {"series": [{"labels": {name: value}, "samples": [{"t": ms, "v": number}]}]}.

Good samples of a request are taken though others are not: each rejected sample keeps its reason.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import WriteError
from ..model import LABELS_TYPE, METRIC, get_label, labels_from_map

# fixed values: limits of a request body and of the reasons that an answer lists
MOST_BYTES = 32 << 20
MOST_ERRORS = 20
REQUEST = "series array<struct<labels:map<string,string>,samples:array<struct<t:bigint,v:double>>>>"


def parse_body(body: bytes) -> list[tuple[dict[str, str], list[tuple[int, float]]]]:
    """The series of one request body; WriteError if it isn't one."""
    if len(body) > MOST_BYTES:
        raise WriteError(f"the request body is larger than {MOST_BYTES} bytes")

    def fields(value: object, known: set[str], what: str) -> dict:
        if not isinstance(value, dict) or set(value) - known:
            raise WriteError(f"decoding the request body: bad {what}")
        return value

    try:
        request = fields(json.loads(body), {"series"}, "request")
        out = []
        for s in request.get("series") or []:
            s = fields(s, {"labels", "samples"}, "series")
            samples = [fields(x, {"t", "v"}, "sample") for x in s.get("samples") or []]
            labels = fields(s.get("labels") or {}, set(s.get("labels") or {}), "labels")
            if not all(isinstance(v, str) for v in labels.values()):
                raise WriteError("decoding the request body: a label's value must be a string")
            out.append((labels, [(_whole(x.get("t", 0)), float(x.get("v", 0))) for x in samples]))
        return out
    except (ValueError, TypeError, AttributeError) as e:
        raise WriteError(f"decoding the request body: {e}") from None


def _whole(t: object) -> int:
    if not isinstance(t, int) or isinstance(t, bool):
        raise WriteError("decoding the request body: t must be a whole number")
    return t


def request_rows(spark: SparkSession, body: bytes) -> DataFrame:
    """Rows (labels map, t, v, seq) of one request body."""
    rows, seq = [], 0
    for labels, samples in parse_body(body):
        for t, v in samples:
            rows.append((labels, t, v, seq))
            seq += 1
    return spark.createDataFrame(rows, "labels map<string,string>, t long, v double, seq long")


def request_files(lines: DataFrame) -> DataFrame:
    """Rows (labels map, t, v, seq) of requests as JSON text (column value), one a row; seq orders a row's own samples."""
    parsed = lines.select(F.from_json("value", REQUEST, {"mode": "FAILFAST"}).alias("r"), F.monotonically_increasing_id().alias("row_"))
    series = parsed.select("row_", F.posexplode("r.series").alias("i", "s"))
    samples = series.select("row_", "i", F.col("s.labels").alias("labels"), F.posexplode("s.samples").alias("j", "x"))
    return samples.select("labels", F.col("x.t").alias("t"), F.col("x.v").alias("v"), F.struct("row_", "i", "j").alias("seq"))


def reason(labels: Column) -> Column:
    """Why a label map can't name a series, null if it can."""
    names = F.map_keys(labels)
    bad = F.filter(names, lambda n: ~n.rlike(r"\A[a-zA-Z_][a-zA-Z0-9_]*\z"))
    invalid = F.exists(F.map_values(labels), lambda v: v.isNull() | ~F.is_valid_utf8(v))
    return (
        F.when(labels.isNull() | (F.size(labels) == 0), F.lit("series has no labels"))
        .when(F.size(bad) > 0, F.concat(F.lit("invalid label name: "), F.get(bad, F.lit(0))))
        .when(invalid, F.lit("label value is not valid UTF-8"))
    )


def as_samples(rows: DataFrame) -> DataFrame:
    """rows (labels map, t, v, seq) as (metric, labels, t, v, seq, reason)."""
    labels = F.when(F.col("labels").isNotNull(), labels_from_map(F.col("labels"))).otherwise(F.array().cast(LABELS_TYPE))
    checked = rows.withColumn("reason", F.coalesce(reason(F.col("labels")), F.when(F.col("t").isNull() | F.col("v").isNull(), F.lit("sample has no time or value"))))
    checked = checked.withColumn("labels", labels)
    return checked.select(get_label(F.col("labels"), METRIC).alias("metric"), "labels", "t", "v", "seq", "reason")
