"""Queries of sources and sinks: what is written is read back and compared with the table it came from."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.errors import LakeError
from tarnlake.functions import expr as X
from tarnlake.operators import compaction, dedup
from tarnlake.operators.incremental import StateStore, run_incremental
from tarnlake.plans.catalog import frame, query
from tarnlake.plans.query import Lake
from tarnlake.plans.shared import scratch
from tarnlake.sources import iceberg, readers, sidecar, writers
from tarnlake.sources.storage import local_path, write_whole
from tarnlake.streaming import streams


@query("select n_nationkey::double as n_nationkey, n_name, n_regionkey::double as n_regionkey from nation")
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "csv") + "/nation.csv"
    write_whole(path, "".join(writers.stream_csv(frame(spark, d, "nation").orderBy("n_nationkey"))).encode(), "0")
    return readers.read_csv(spark, path)


@query("select c_custkey, c_name, c_acctbal from customer")
def json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "json")
    frame(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").write.json(path)
    return readers.read_json(spark, path)


@query("select r_regionkey, r_name from region")
def json_array_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "json") + "/region.json"
    write_whole(path, "".join(writers.stream_json(frame(spark, d, "region"))).encode(), "0")
    return readers.read_json(spark, path).select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name")


@query("select * from region")
def arrow_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_arrow(spark, writers.to_arrow(frame(spark, d, "region")))


@query("select r_regionkey::bigint as r_regionkey, r_name from region")
def in_memory_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = [r.asDict() for r in frame(spark, d, "region").collect()]
    return Lake(spark).rows(rows, max_rows=100).select("r_regionkey", "r_name").df()


def _partitioned(spark: SparkSession, d: str) -> str:
    path = scratch(spark, "hive")
    writers.write_partitioned(frame(spark, d, "orders"), path, ["o_orderstatus", "o_orderpriority"], max_rows_per_file=100_000)
    return path


_ORDERS = "o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderstatus, o_orderpriority"


@query(f"select {_ORDERS} from orders")
def partitioned_write_readback(spark: SparkSession, d: str) -> DataFrame:
    return Lake(spark).hive(_partitioned(spark, d)).df()


@query("select o_orderkey, o_orderpriority from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT' and o_totalprice > 1000")
def hive_prune(spark: SparkSession, d: str) -> DataFrame:
    where = X.and_(X.eq("o_orderstatus", "F"), X.eq("o_orderpriority", "1-URGENT"), X.gt("o_totalprice", 1000))
    return Lake(spark).hive(_partitioned(spark, d)).select("o_orderkey", "o_orderpriority").where(where).df()


@query("select o_orderstatus, sum(1)::bigint as n from orders group by 1")
def output_manifest_counts(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "ctas")
    manifest = writers.create_table_as(frame(spark, d, "orders"), path, ["o_orderstatus"])
    rows = [(e["partitionValues"]["o_orderstatus"], e["rowCount"]) for e in writers.read_manifest(f"{path}/_manifest.json")["entries"]]
    assert len(rows) == len(manifest["entries"])
    return spark.createDataFrame(rows, "o_orderstatus string, n bigint").groupBy("o_orderstatus").agg(F.sum("n").alias("n"))


@query("select p_partkey, p_size::double as p_size, case when p_partkey % 2 = 0 then p_name end as p_name from part")
def schema_merge_nullfill(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "drift")
    part = frame(spark, d, "part")
    part.filter("p_partkey % 2 = 0").select("p_partkey", "p_size", "p_name").write.parquet(f"{path}/a")
    part.filter("p_partkey % 2 = 1").select("p_partkey", F.col("p_size").cast("double").alias("p_size")).write.parquet(f"{path}/b")
    return Lake(spark).path(f"{path}/**/*.parquet").df()


@query("select o_orderkey from orders where o_orderkey between 200 and 260 and o_totalprice > 0")
def sidecar_prune(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "ranges")
    frame(spark, d, "orders").repartitionByRange(8, "o_orderkey").write.parquet(path)
    index = sidecar.build_index(spark, [p for p, _ in readers.list_files(spark, path)], ["o_orderkey"])
    where = X.and_(X.between("o_orderkey", 200, 260), X.gt("o_totalprice", 0))
    return Lake(spark, index=index).path(path).select("o_orderkey").where(where).df()


@query("select c_custkey from (select c_custkey, row_number() over () as r from customer) where r between 11 and 60")
def row_range(spark: SparkSession, d: str) -> DataFrame:
    return readers.row_range(spark, f"{d}/customer.parquet", 10, 60, ["c_custkey"])


@query("select count(*) as n from lineitem")
def row_group_plan(spark: SparkSession, d: str) -> DataFrame:
    groups = readers.row_groups(f"{d}/lineitem.parquet", ["l_orderkey"])
    return spark.createDataFrame([(g["rows"],) for g in groups], "n bigint").agg(F.sum("n").alias("n"))


def iceberg_table(spark: SparkSession, d: str) -> str:
    """A table of the nations in two snapshots, by region; the second renames a column and deletes by position and by value."""
    root = scratch(spark, "iceberg")
    here = local_path(root)
    os.makedirs(f"{here}/metadata")
    nation = frame(spark, d, "nation").withColumn("region", F.col("n_regionkey").cast("string"))
    old = nation.filter("n_nationkey < 20").select("n_nationkey", F.col("n_name").alias("name"), "region")
    new = nation.filter("n_nationkey >= 20").select("n_nationkey", F.col("n_name").alias("n_name"), "region")
    manifests = []
    for k, (df, sequence) in enumerate(((old, 1), (new, 2))):
        entries = writers.write_partitioned(df, f"{root}/data/{k}", ["region"])["entries"]
        for e in entries:  # a reader of such tables finds the partition's column in the files or in the manifest
            folder = e["outputPath"].rsplit("/", 1)[0]
            plain = spark.read.parquet(e["outputPath"]).withColumn("region", F.lit(e["partitionValues"]["region"]))
            plain.coalesce(1).write.mode("append").parquet(folder.replace("/data/", "/files/"))
        files = readers.list_files(spark, f"{root}/files/{k}")
        manifests.append([{"status": 1, "sequence_number": sequence, "data_file": {"content": 0, "file_path": local_path(p), "file_format": "PARQUET", "partition": {"region": p.split("region=")[1].split("/")[0]}, "record_count": 0, "file_size_in_bytes": n}} for p, n in files])
    first = manifests[0][0]["data_file"]
    spark.createDataFrame([(first["file_path"], 1)], "file_path string, pos bigint").coalesce(1).write.parquet(f"{root}/deletes/position")
    spark.createDataFrame([("NATION_7",), (None,)], "n_name string").coalesce(1).write.parquet(f"{root}/deletes/equality")
    extra = [
        {"content": 1, "partition": first["partition"], "file_path": local_path(readers.list_files(spark, f"{root}/deletes/position")[0][0])},
        {"content": 2, "partition": {}, "equality_ids": [2], "file_path": local_path(readers.list_files(spark, f"{root}/deletes/equality")[0][0])},
    ]
    manifests.append([{"status": 1, "sequence_number": 3, "data_file": {"file_format": "PARQUET", "record_count": 1, "file_size_in_bytes": 1} | e} for e in extra])
    for i, m in enumerate(manifests):
        write_whole(f"{root}/metadata/m{i}.json", json.dumps({"entries": m}).encode(), "0")
    for i, used in ((1, [0]), (2, [0, 1, 2])):
        write_whole(f"{root}/metadata/list{i}.json", json.dumps({"manifests": [{"manifest_path": f"{here}/metadata/m{k}.json", "partition_spec_id": 0} for k in used]}).encode(), "0")
    field = lambda i, n, t: {"id": i, "name": n, "type": t, "required": False}
    meta = {
        "format-version": 2,
        "location": here,
        "last-sequence-number": 3,
        "current-snapshot-id": 2,
        "current-schema-id": 1,
        "schemas": [
            {"schema-id": 0, "fields": [field(1, "n_nationkey", "int"), field(2, "name", "string"), field(3, "region", "string")]},
            {"schema-id": 1, "fields": [field(1, "n_nationkey", "int"), field(2, "n_name", "string"), field(3, "region", "string"), field(4, "note", "string")]},
        ],
        "partition-specs": [{"spec-id": 0, "fields": [{"name": "region", "transform": "identity", "source-id": 3, "field-id": 1000}]}],
        "default-spec-id": 0,
        "refs": {"main": {"snapshot-id": 2, "type": "branch"}, "before": {"snapshot-id": 1, "type": "tag"}},
        "snapshots": [{"snapshot-id": i, "timestamp-ms": 1000 * i, "manifest-list": f"{here}/metadata/list{i}.json", "schema-id": i - 1} for i in (1, 2)],
    }
    write_whole(f"{root}/metadata/v2.metadata.json", json.dumps(meta).encode(), "0")
    return root


@query("select n_nationkey, n_name, null::varchar as note from nation where n_regionkey in (1, 2) and n_name <> 'NATION_7'")
def iceberg_scan(spark: SparkSession, d: str) -> DataFrame:
    table = iceberg.load_table(spark, local_path(iceberg_table(spark, d)))
    return table.scan(["n_nationkey", "n_name", "note"], X.is_in("region", ["1", "2"]))


@query("select n_nationkey, n_name as name from nation where n_nationkey < 20")
def iceberg_time_travel(spark: SparkSession, d: str) -> DataFrame:
    return iceberg.load_table(spark, local_path(iceberg_table(spark, d))).scan(["n_nationkey", "name"], as_of=1500)


@query("select n_nationkey from nation where n_name <> 'NATION_7' and n_regionkey > 0 union all select 100 + n_nationkey from nation where n_regionkey = 4")
def iceberg_append(spark: SparkSession, d: str) -> DataFrame:
    root = iceberg_table(spark, d)
    table = iceberg.load_table(spark, local_path(root))
    more = frame(spark, d, "nation").filter("n_regionkey = 4").select((F.col("n_nationkey") + 100).alias("n_nationkey"), "n_name", F.lit("4").alias("region"))
    more.coalesce(1).write.parquet(f"{root}/more")
    entries = [e | {"outputPath": local_path(e["outputPath"]), "partitionValues": {"region": "4"}} for e in writers.manifest_of(more, f"{root}/more")["entries"]]
    table.append(entries)
    return iceberg.load_table(spark, local_path(root)).scan(["n_nationkey"], X.gt("region", "0"))


@query("select * from lineitem")
def compact_directory(spark: SparkSession, d: str) -> DataFrame:
    root = scratch(spark, "tiny")
    frame(spark, d, "lineitem").repartition(40, "l_orderkey", "l_linenumber").write.parquet(f"{root}/from")
    compaction.compact_directory(spark, f"{root}/from", f"{root}/to", target=8 << 20)
    return compaction.read_compacted(spark, f"{root}/to")


@query("select e.event_id, e.value + 1 as value from events e where event_type = 'click' union all select event_id + 10000000, value from events where event_type = 'click'")
def incremental_changes(spark: SparkSession, d: str) -> DataFrame:
    root = scratch(spark, "runs")
    store = StateStore(spark, f"{root}/state")
    before = frame(spark, d, "events").select("event_id", "value", "event_type")
    clicks = F.col("event_type") == "click"
    changed = before.filter(~clicks).unionByName(before.filter(clicks).withColumn("value", F.col("value") + 1))
    now = changed.unionByName(before.filter(clicks).withColumn("event_id", F.col("event_id") + 10_000_000))

    def sink(df: DataFrame, run: str) -> None:
        df.write.mode("overwrite").parquet(f"{root}/{run}")

    for run, rows in (("one", before), ("two", now)):
        run_incremental(store, rows, ["event_id"], ["value"], run, sink)
    return spark.read.parquet(f"{root}/two").select("event_id", "value")


@query("select event_id, event_type from events")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    root = scratch(spark, "stream")
    rows = frame(spark, d, "events").select("event_id", "event_type", "user_id")
    for _ in range(2):
        rows.unionByName(rows).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = streams.read_files(spark, f"{root}/in", "event_id bigint, event_type string, user_id bigint", 1)
    identity = dedup.digest(["event_id", "event_type"])
    q = streams.dedupe_stream(stream, f"{root}/out", f"{root}/checkpoint", identity, "event_id")
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out").select("event_id", "event_type")
