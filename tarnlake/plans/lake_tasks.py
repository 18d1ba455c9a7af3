"""Queries of the general data tasks over the lake tables, with their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.operators import compaction, dedup, incremental, schema_drift
from tarnlake.plans.shared import scratch


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.schema_changes(table(spark, d, "table_schemas"))


def p1_alternatives(spark: SparkSession, d: str) -> DataFrame:
    """Every type that a path has had, where it appears, and the canonical name and type."""
    return schema_drift.type_alternatives(table(spark, d, "table_schemas"))


def p1_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every payload in one consistent table."""
    return schema_drift.consistent_rows(table(spark, d, "file_rows"), table(spark, d, "table_schemas"))


def p1_fields(spark: SparkSession, d: str) -> DataFrame:
    """Of each field of each schema, under its consistent name, the records and how many have no value."""
    values = p1_rows(spark, d).select("table_name", "schema_id", F.explode("fields").alias("field", "value"))
    return values.groupBy("table_name", "schema_id", "field").agg(F.count("*").alias("records"), F.count_if(F.col("value.tag") == "null").alias("missing"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The small files that compaction has replaced, by the report of the snapshot that it put in force."""
    return compaction.merged_files(table(spark, d, "file_rows"), table(spark, d, "data_files"), scratch(spark, "compacted")).select("entry_id")


def p2_files(spark: SparkSession, d: str) -> DataFrame:
    """What became of the files of each partition: merged into how many, kept as they are, or of no live file (their rows' own partition)."""
    rows, entries = table(spark, d, "file_rows"), table(spark, d, "data_files")
    report = compaction.compact_lake(rows, entries, scratch(spark, "compacted"))
    partition = list(compaction.PARTITION)
    merged = report.groupBy(*partition).agg(F.lit("merged").alias("fate"), F.sum("files").alias("files"), F.count("*").alias("outputs"), F.sum("groups").alias("row_groups"), F.sum("rows").alias("records"))
    of_file = compaction.untouched_rows(rows, entries).groupBy(*partition, "kept", "file").agg(F.count("*").alias("records"))
    rest = of_file.groupBy(*partition, F.when(F.col("kept"), "kept").otherwise("not live").alias("fate")).agg(F.count("*").alias("files"), F.sum("records").alias("records"))
    return merged.unionByName(rest, allowMissingColumns=True).na.fill(0, ["outputs", "row_groups"])


def p2_rows(spark: SparkSession, d: str) -> DataFrame:
    """The records of all live files as they are read after compaction: from the merged files, and of the files that stay."""
    rows, entries, out = table(spark, d, "file_rows"), table(spark, d, "data_files"), scratch(spark, "compacted")
    compaction.compact_lake(rows, entries, out)
    merged, kept = compaction.read_compacted(spark, out, rows.schema), compaction.untouched_rows(rows, entries).filter("kept")
    columns = ["row_id", "table_name", "store_id", "sale_date", "record_id", "record_version", "schema_id", "payload"]
    return merged.select(*columns).unionByName(kept.select(*columns))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.pending_records(table(spark, d, "file_rows"), table(spark, d, "scan_jobs"), table(spark, d, "bookmarks"), scratch(spark, "state"))


def p3_positions(spark: SparkSession, d: str) -> DataFrame:
    """The bookmark that each job resumes from."""
    return incremental.job_bookmarks(table(spark, d, "scan_jobs"), table(spark, d, "bookmarks"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return dedup.repeated_deliveries(table(spark, d, "retry_log"), dedup.message_identity(), "delivery_id")


def p5_kept(spark: SparkSession, d: str) -> DataFrame:
    """One copy of each message, and all deliveries without key."""
    return dedup.dedupe_messages(table(spark, d, "retry_log"), None, dedup.message_identity(), "delivery_id")


def p5_stored_new(spark: SparkSession, d: str) -> DataFrame:
    """The messages of the earlier half of the batches, kept once each, and then those of the later half added to them."""
    log, identity = table(spark, d, "retry_log"), dedup.message_identity()
    low, high = log.agg(F.min("batch_no"), F.max("batch_no")).first()
    middle = ((low or 0) + (high or 0)) // 2
    stored = dedup.dedupe_messages(log.filter(F.col("batch_no") <= middle), None, identity, "delivery_id")
    return dedup.dedupe_messages(log.filter(F.col("batch_no") > middle), stored, identity, "delivery_id")


def _handed_over(spark: SparkSession, d: str, contents: list[Column]) -> DataFrame:
    """Runs over the orders with a status of ``contents`` in turn: what each run handed over."""
    root, orders = scratch(spark, "runs"), table(spark, d, "orders")
    store, outs = incremental.StateStore(spark, f"{root}/state"), []
    for n, status in enumerate(contents, 1):
        outs.append(f"{root}/out/{n}")
        present = orders.select("o_orderkey", status.alias("status"))
        incremental.run_incremental(store, present, ["o_orderkey"], ["status"], f"run {n}", lambda df, run: df.write.mode("overwrite").parquet(outs[-1]))
    found = [spark.read.parquet(o).select(F.lit(n).alias("run"), "o_orderkey", "status", F.col("_change").alias("change")) for n, o in enumerate(outs, 1)]
    return reduce(DataFrame.unionByName, found)


def incremental_reverted(spark: SparkSession, d: str) -> DataFrame:
    """A status that changes and goes back: handed over each time."""
    status = F.col("o_orderstatus")
    return _handed_over(spark, d, [status, F.when(status == "F", "X").otherwise(status), status])


def incremental_two_runs(spark: SparkSession, d: str) -> DataFrame:
    """A second run that hands over what the first one's state hasn't, and a third that finds nothing new."""
    status = F.col("o_orderstatus")
    changed = F.when(F.col("o_totalprice") > 200_000, F.lower(status)).otherwise(status)
    return _handed_over(spark, d, [status, changed, changed])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_alternatives": p1_alternatives,
        "p1_rows": p1_rows,
        "p1_fields": p1_fields,
        "p2_found": p2_found,
        "p2_files": p2_files,
        "p2_rows": p2_rows,
        "p3_found": p3_found,
        "p3_positions": p3_positions,
        "p5_found": p5_found,
        "p5_kept": p5_kept,
        "p5_stored_new": p5_stored_new,
        "incremental_reverted": incremental_reverted,
        "incremental_two_runs": incremental_two_runs,
    }


_SEGMENTS = "'/[^/]+/\\.\\./'"
_PATH = f"""(select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    'x://' || case when instr(rest, '%') > 0 then url_decode(replace(rest, '+', '%2B')) else rest end, '(/\\.)+/', '/', 'g'), '([^:/])/+', '\\1/', 'g'),
    {_SEGMENTS}, '/'), {_SEGMENTS}, '/'), {_SEGMENTS}, '/') || '|' || case when scheme = 's3a' then 's3' else scheme end as file
  from (select *, lower(regexp_extract(file_path, '^([A-Za-z0-9+.-]+)://', 1)) as scheme, regexp_replace(file_path, '^[A-Za-z0-9+.-]+://', '') as rest from data_files))"""
_LIVE = f"""files as (
  select arg_max(entry_id, (coalesce(sequence_number, -1), entry_id)) as entry_id, arg_max(lower(entry_status), (coalesce(sequence_number, -1), entry_id)) as status,
    arg_max(lower(coalesce(content, 'data')), (coalesce(sequence_number, -1), entry_id)) as content, file,
    arg_max({{'t': table_name, 's': store_id, 'd': sale_date}}, (coalesce(sequence_number, -1), entry_id)) as p,
    arg_max(file_size_in_bytes, (coalesce(sequence_number, -1), entry_id)) filter (file_size_in_bytes > 0) as size
  from {_PATH} group by file),
live as (select * from files where status <> 'deleted' and content = 'data')"""
_STATUS = f"""{_LIVE},
cases as (select file from (select file, count(*) over (partition by p.t, p.s, p.d) as n from live where size < 1048576) where n >= 2),
status as (
  select r.*, l.p, case when l.file is null then 'not live' when c.file is null then 'kept' else 'merged' end as fate
  from {_PATH.replace("data_files", "file_rows")} r left join live l using (file) left join cases c using (file))"""
_POSITIONS = """usable as (
  select job_id, lower(trim(plan_fingerprint)) as plan, cast(regexp_extract(snapshot_ref, '([0-9]+)\\s*$', 1) as bigint) as snapshot, file_index, row_offset, run_no
  from bookmarks where lower(trim(state)) = 'complete' and plan_fingerprint is not null and snapshot_ref is not null and file_index is not null and row_offset is not null),
positions as (
  select j.job_id, j.table_name, u.snapshot, u.file_index, u.row_offset
  from (select distinct job_id, table_name, lower(trim(plan_fingerprint)) as plan from scan_jobs) j
  left join (select *, row_number() over (partition by job_id, plan order by run_no desc, snapshot desc, file_index desc, row_offset desc) as rn from usable) u
    on u.job_id = j.job_id and u.plan = j.plan and u.rn = 1)"""
_DECODED = "lower(trim(case when instr({0}, '%') > 0 then url_decode(replace(trim({0}, ' \t\n\r'), '+', '%2B')) else {0} end, ' \t\n\r'))"
_MESSAGES = f"""messages as (
  select *, {_DECODED.format("idempotency_key")} as k, {_DECODED.format("task_id")} as t, lower(regexp_replace(state, '[^A-Za-z]', '', 'g')) as s from retry_log)"""


_PAIRS = """fields as (
  select table_name, schema_id, field_id, any_value(field_name) as name, any_value(regexp_replace(lower(field_type), '\\s', '', 'g')) as type, any_value(source_id) as source_id
  from table_schemas group by all),
schemas as (select table_name, schema_id, lag(schema_id) over (partition by table_name order by schema_id) as before from (select distinct table_name, schema_id from table_schemas)),
now as (select f.*, s.before from fields f join schemas s using (table_name, schema_id) where s.before is not null),
pairs as (
  select n.*, coalesce(a.field_id, b.field_id) as was_id, coalesce(a.name, b.name) as was_name, coalesce(a.type, b.type) as was_type
  from now n
  left join fields a on a.table_name = n.table_name and a.schema_id = n.before and a.field_id = n.field_id
  left join fields b on a.field_id is null and b.table_name = n.table_name and b.schema_id = n.before and b.field_id = n.source_id
    and not exists (select 1 from fields x where x.table_name = n.table_name and x.schema_id = n.schema_id and x.field_id = n.source_id))"""


_UNIONS = f"""{_PAIRS},
links as (select table_name, field_id, min(was_id) as up from pairs where was_id <> field_id group by all),
walk as (
  select table_name, field_id, up as path from links
  union all select w.table_name, w.field_id, l.up from walk w join links l on l.table_name = w.table_name and l.field_id = w.path),
roots as (select table_name, field_id, path from walk w where not exists (select 1 from links l where l.table_name = w.table_name and l.field_id = w.path)),
paths as (select f.*, coalesce(r.path, f.field_id) as path from fields f left join roots r using (table_name, field_id)),
alternatives as (
  select table_name, path, type as field_type, min(schema_id) as first_schema_id, max(schema_id) as last_schema_id, arg_max(name, (schema_id, field_id)) as name, max((schema_id, field_id)) as place
  from paths group by all),
unions as (select table_name, path, list(distinct field_type) as types, coalesce(arg_max(name, place), '') as name from alternatives group by all),
measured as (
  select *, list_max(list_transform(types, lambda t: case t when 'int' then 10 when 'long' then 19 else coalesce(try_cast(regexp_extract(t, '(\\d+),(\\d+)', 1) as int) - try_cast(regexp_extract(t, '(\\d+),(\\d+)', 2) as int), 19) end)) as head,
    list_max(list_transform(types, lambda t: coalesce(try_cast(regexp_extract(t, '(\\d+),(\\d+)', 2) as int), 0))) as scale,
    len(list_filter(types, lambda t: t not in ('int', 'long'))) as no_whole, len(list_filter(types, lambda t: t not in ('int', 'long') and not t like 'decimal%')) as no_exact,
    len(list_filter(types, lambda t: t not in ('int', 'long', 'float', 'double') and not t like 'decimal%')) as no_number, len(list_filter(types, lambda t: t not in ('date', 'timestamp'))) as no_time,
    count(*) over (partition by table_name, name) as owners
  from unions)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""with {_PAIRS}
select table_name, schema_id, field_id, 'added' as change from pairs where was_id is null
union all select table_name, schema_id, field_id, 'renamed' from pairs where was_name <> name
union all select table_name, schema_id, field_id, 'retyped' from pairs where was_type <> type
union all select s.table_name, s.schema_id, f.field_id, 'removed' from schemas s join fields f on f.table_name = s.table_name and f.schema_id = s.before
where not exists (select 1 from pairs p where p.table_name = s.table_name and p.schema_id = s.schema_id and p.was_id = f.field_id)""",
        "p1_alternatives": f"""with recursive {_UNIONS}
select a.table_name, a.path, a.field_type, a.first_schema_id, a.last_schema_id,
  case when len(types) = 1 then types[1] when no_whole = 0 then 'long' when no_exact = 0 and head + scale <= 38 then 'decimal(' || (head + scale) || ',' || scale || ')'
    when no_number = 0 then 'double' when no_time = 0 then 'timestamp' else 'string' end as canonical_type,
  case when owners > 1 then m.name || '#' || m.path else m.name end as canonical_name
from alternatives a join measured m using (table_name, path)""",
        "p1_fields": f"""with recursive {_UNIONS},
specs as (
  select distinct p.table_name, p.schema_id, p.name as written, case when m.owners > 1 then m.name || '#' || m.path else m.name end as field
  from paths p join measured m using (table_name, path)),
one as (select distinct row_id, table_name, schema_id, payload from file_rows)
select o.table_name, o.schema_id, s.field, count(*) as records, count_if(json_extract_string(case when json_valid(o.payload) then o.payload end, '$."' || s.written || '"') is null) as missing
from one o join specs s using (table_name, schema_id) group by all""",
        "p2_found": f"""with {_LIVE},
small as (select *, count(*) over (partition by p.t, p.s, p.d) as n from live where size < 1048576)
select entry_id from small where n >= 2""",
        "p2_files": f"""with {_STATUS}
select table_name, store_id, sale_date, fate, count(distinct file) as files, case when fate = 'merged' then 1 else 0 end as outputs, case when fate = 'merged' then 1 else 0 end as row_groups, count(distinct row_id) as records
from (select case when fate = 'merged' then p.t else table_name end as table_name, case when fate = 'merged' then p.s else store_id end as store_id,
  case when fate = 'merged' then p.d else sale_date end as sale_date, fate, file, row_id from status) group by all""",
        "p2_rows": f"""with {_STATUS}
select distinct row_id, table_name, store_id, sale_date, record_id, record_version, schema_id, payload from status where fate <> 'not live'""",
        "p3_positions": f"with {_POSITIONS} select * from positions",
        "p3_found": f"""with {_POSITIONS}
select job_id, record_id, record_version from (
  select p.job_id, r.record_id, r.record_version,
    coalesce(r.snapshot_id <= p.snapshot and (r.file_index < p.file_index or (r.file_index = p.file_index and r.row_offset < p.row_offset)), false) as covered
  from file_rows r join positions p using (table_name))
group by all having not bool_or(covered)""".replace("group by all having", "group by job_id, record_id, record_version having"),
        "p5_found": f"""with {_MESSAGES}
select delivery_id from (select delivery_id, min(delivery_id) over (partition by k, t, s) as first from messages where k is not null and k <> '') where delivery_id <> first""",
        "p5_kept": f"""with {_MESSAGES}
select r.* from retry_log r where r.delivery_id not in (
  select delivery_id from (select delivery_id, min(delivery_id) over (partition by k, t, s) as first from messages where k is not null and k <> '') where delivery_id <> first)""",
        "p5_stored_new": f"""with {_MESSAGES}, cut as (select (min(batch_no) + max(batch_no)) // 2 as middle from retry_log),
ranked as (select m.*, row_number() over (partition by k, t, s order by batch_no > middle, delivery_id) as place from messages m, cut)
select r.* from retry_log r where r.delivery_id not in (select delivery_id from ranked where k is not null and k <> '' and place > 1)""",
        "incremental_reverted": """select 1 as run, o_orderkey, o_orderstatus as status, 'new' as change from orders
union all select 2, o_orderkey, 'X', 'changed' from orders where o_orderstatus = 'F'
union all select 3, o_orderkey, o_orderstatus, 'changed' from orders where o_orderstatus = 'F'""",
        "incremental_two_runs": """select 1 as run, o_orderkey, o_orderstatus as status, 'new' as change from orders
union all select 2, o_orderkey, lower(o_orderstatus), 'changed' from orders where o_totalprice > 200000""",
    }
