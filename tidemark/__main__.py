"""Command line: query a store, or serve one.

    python -m tidemark STORE query 'sum(rate(x[5m]))' [--time T]
    python -m tidemark STORE range 'x' --start T --end T --step 30s
    python -m tidemark STORE write < request.json
    python -m tidemark STORE series|labels|values|status|functions [ARGUMENT...]
    python -m tidemark STORE maintain
    python -m tidemark STORE serve [--port 9090]
"""

from __future__ import annotations

import argparse
import json
import sys
import time


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("store")
    parser.add_argument("command", choices=["query", "range", "write", "series", "labels", "values", "status", "functions", "maintain", "serve"])
    parser.add_argument("argument", nargs="*")
    for name in ("time", "start", "end", "step"):
        parser.add_argument(f"--{name}", default="")
    parser.add_argument("--port", type=int, default=9090)
    args = parser.parse_args(arguments)

    from pyspark.sql import SparkSession

    from .api import Api, serve
    from .sources.store import Store

    spark = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    api = Api(Store(spark, args.store))
    if args.command == "serve":
        serve(api, args.port).serve_forever()
    if args.command == "maintain":
        api.store.maintain(int(time.time() * 1000))
        return 0
    query = args.argument[:1] or [""]
    paths = {"query": "query", "range": "query_range", "values": f"label/{query[0]}/values"}
    parameters = {"query": query, "match[]": args.argument} | {k: [getattr(args, k)] for k in ("time", "start", "end", "step")}
    body = sys.stdin.buffer.read() if args.command == "write" else b""
    status, envelope = api.request("POST" if body else "GET", f"/api/v1/{paths.get(args.command, args.command)}", parameters, body)
    print(json.dumps(envelope.get("data", envelope), indent=2, ensure_ascii=False))
    return int(status >= 400)


if __name__ == "__main__":
    sys.exit(main())
