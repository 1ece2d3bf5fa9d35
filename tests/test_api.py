import json
import threading
import urllib.request

import pytest

from tidemark.api import Api, parse_step, parse_time, serve
from tidemark.engine import Options
from tidemark.errors import InvalidRangeError
from tidemark.sources.store import Store

T0 = 1_700_000_000_000


@pytest.fixture(scope="module")
def api(spark, tmp_path_factory):
    a = Api(Store(spark, f"file://{tmp_path_factory.mktemp('api')}/store"), Options())
    request = {"series": [{"labels": {"__name__": "cpu", "host": f"web-{h}", "job": "api"}, "samples": [{"t": T0 + k * 1000, "v": h * 100 + k} for k in range(10)]} for h in range(3)]}
    status, got = a.request("POST", "/api/v1/write", {}, json.dumps(request).encode())
    assert (status, got["data"]) == (200, {"accepted": 30, "rejected": 0})
    return a


def get(api, path, **parameters):
    return api.request("GET", path, {k: v if isinstance(v, list) else [v] for k, v in parameters.items()})


def test_queries(api):
    at = str((T0 + 9000) / 1000)
    status, got = get(api, "/api/v1/query", query="sum by (job) (cpu)", time=at)
    assert status == 200 and got["data"]["resultType"] == "instant vector"
    assert got["data"]["result"] == [{"labels": {"job": "api"}, "t": T0 + 9000, "v": 327.0}]
    assert get(api, "/api/v1/query", query="1/0", time=at)[1]["data"]["result"] == "+Inf"
    assert get(api, "/api/v1/query", query="cpu / 0 * 0", time=at)[1]["data"]["result"][0]["v"] == "NaN"
    assert get(api, "/api/v1/query", query='"x"', time=at)[1]["data"]["result"] == "x"
    status, got = get(api, "/api/v1/query_range", query='rate(cpu{host="web-1"}[5s])', start=str(T0 / 1000 + 5), end=at, step="2")
    assert [s["t"] - T0 for s in got["data"]["result"][0]["samples"]] == [5000, 7000, 9000] and got["data"]["stats"]["steps"] == 3
    assert len(get(api, "/api/v1/query", query="cpu[3s]", time=at)[1]["data"]["result"][0]["samples"]) == 3


@pytest.mark.parametrize("query,status,kind", [("sum(", 400, "bad_data"), ("rate(cpu)", 400, "bad_data"), ("nosuch(cpu)", 400, "bad_data"), ("", 400, "bad_data"), ("histogram_quantile(0.9, cpu)", 501, "unimplemented"), ("cpu + on (job) cpu", 400, "bad_data")])
def test_error_classes(api, query, status, kind):
    got = get(api, "/api/v1/query", query=query, time=str(T0 / 1000 + 9))
    assert (got[0], got[1]["errorType"]) == (status, kind)


def test_lookups_and_status(api):
    window = {"start": str(T0 / 1000), "end": str(T0 / 1000 + 9)}
    assert len(get(api, "/api/v1/series", **{"match[]": ['cpu{host=~"web-[01]"}', 'cpu{host="web-0"}']}, **window)[1]["data"]) == 2
    assert get(api, "/api/v1/series")[0] == 400
    assert get(api, "/api/v1/labels")[1]["data"] == ["__name__", "host", "job"]
    assert get(api, "/api/v1/label/host/values")[1]["data"] == ["web-0", "web-1", "web-2"]
    assert get(api, "/api/v1/label/no-name/values")[0] == 400
    assert "rate" in get(api, "/api/v1/functions")[1]["data"]
    assert get(api, "/api/v1/status")[1]["data"]["samplesIngested"] == 30
    assert get(api, "/healthz")[1]["data"] == "ok" and get(api, "/none")[0] == 404
    assert api.request("POST", "/api/v1/write", {}, b"{")[0] == 400


def test_times_and_steps():
    assert [parse_time(x, 7) for x in ("", "1700000000", ".5", "2023-11-14T22:13:20Z", "2023-11-14T22:13:20.25+00:00")] == [7, T0, 500, T0, T0 + 250]
    assert [parse_step(x, 7) for x in ("", "30", "1m", "1h30m", "0.5")] == [7, 30_000, 60_000, 5_400_000, 500]
    for bad in ("yesterday", "2023-11-14"):
        with pytest.raises(InvalidRangeError):
            parse_time(bad, 0)
    for bad in ("0", "-5", "abc", "0s"):
        with pytest.raises(InvalidRangeError):
            parse_step(bad, 0)


def test_server(api):
    server = serve(api, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}/api/v1/"
    with urllib.request.urlopen(url + f"query?query=count(cpu)&time={T0 / 1000 + 9}") as r:
        assert json.load(r)["data"]["result"][0]["v"] == 3.0
    with urllib.request.urlopen(url + "query", data=f"query=1%2B1&time={T0 / 1000}".encode()) as r:
        assert json.load(r)["data"]["result"] == 2.0
    server.shutdown()
