"""``python -m tarnlake.cli``: query, explain, inspect, schema, write and compact from a shell."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from tarnlake.errors import LakeError
from tarnlake.plans.query import Lake
from tarnlake.plans.sql import run_sql
from tarnlake.sources import readers, writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tarnlake")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("query", "explain"):
        q = sub.add_parser(name)
        q.add_argument("text", help="SQL, or a JSON query")
        q.add_argument("--path", help="what the table input is")
        q.add_argument("--table", action="append", default=[], metavar="NAME=PATH")
        q.add_argument("--param", action="append", default=[], help="the values of $1 and so on, as JSON")
        q.add_argument("--format", choices=("json", "ndjson", "csv"), default="ndjson")
        q.add_argument("--prevent-formulae", action="store_true")
    for name in ("inspect", "schema"):
        sub.add_parser(name).add_argument("source")
    w = sub.add_parser("write")
    w.add_argument("text")
    w.add_argument("out")
    w.add_argument("--path")
    w.add_argument("--table", action="append", default=[], metavar="NAME=PATH")
    w.add_argument("--partition-by", default="")
    w.add_argument("--mode", choices=("overwrite", "create"), default="create")
    c = sub.add_parser("compact")
    c.add_argument("source")
    c.add_argument("out")
    c.add_argument("--target-bytes", type=int, default=64 << 20)
    c.add_argument("--below-bytes", type=int, default=1 << 20)
    return p


def run(argv: list[str], spark: SparkSession, out=sys.stdout) -> int:
    """Run a command; errors go to ``out`` as JSON with their code, and give 1."""
    a = parser().parse_args(argv)
    try:
        _command(a, spark, out)
    except LakeError as e:
        out.write(json.dumps({"error": e.as_dict()}, default=str) + "\n")
        return 1
    return 0


def _command(a: argparse.Namespace, spark: SparkSession, out) -> None:
    lake = Lake(spark)
    say = lambda x: out.write(json.dumps(writers.json_safe(x)) + "\n")
    if a.command in ("query", "explain", "write"):
        tables = dict(t.split("=", 1) for t in a.table)
        if a.text.lstrip().startswith("{"):
            q = lake.query(a.text)
            if a.command == "explain":
                return say(q.explain())
            df = q.df()
        else:
            df = run_sql(spark, a.text, a.path, tables, [json.loads(p) for p in getattr(a, "param", [])])
        if a.command == "explain":
            jvm = spark._jvm.org.apache.spark.sql.execution
            return say({"plan": df._jdf.queryExecution().explainString(jvm.ExplainMode.fromString("formatted"))})
        if a.command == "write":
            return say(writers.create_table_as(df, a.out, [c for c in a.partition_by.split(",") if c] or None, mode=a.mode))
        lines = {"ndjson": writers.stream_ndjson, "json": writers.stream_json}.get(a.format) or (lambda d: writers.stream_csv(d, prevent_formulae=a.prevent_formulae))
        for line in lines(df):
            out.write(line)
    elif a.command == "inspect":
        files = readers.list_files(spark, a.source)
        for path, size in files:
            groups = readers.row_groups(path)
            say({"path": path, "bytes": size, "rows": sum(g["rows"] for g in groups), "rowGroups": len(groups)})
    elif a.command == "schema":
        df = readers.read_parquet(spark, a.source)
        say([{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema.fields])
    else:
        from tarnlake.operators.compaction import compact_directory

        for r in compact_directory(spark, a.source, a.out, a.target_bytes, a.below_bytes).collect():
            say(r.asDict())
    return None


if __name__ == "__main__":
    session = SparkSession.builder.appName("tarnlake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    sys.exit(run(sys.argv[1:], session))
