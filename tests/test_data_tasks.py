"""The general data tasks against plain Python on small rows full of dirt."""

import io
import json
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnlake.errors import LakeError
from tarnlake.functions.text import _object_name, object_name
from tarnlake.operators import compaction, dedup, incremental, schema_drift
from tarnlake.plans import lake_tasks
from tarnlake.plans.shared import Pointer, scratch, shuffles_released
from tarnlake.plans.skew import neighbours, salted_join
from tarnlake.sources import parquet_blocks
from tarnlake.sources.storage import local_path, open_part

FIELDS = "table_name string, schema_id int, field_pos int, field_id int, source_id int, field_name string, field_type string, required boolean, loaded_at timestamp_ntz, change string"


def changes(rows):
    forms = {}
    for t, s, _, f, src, name, kind, *_ in rows:
        if None not in (t, s, f):
            forms.setdefault((t, s), {})[f] = (name, "".join(kind.lower().split()) if kind is not None else None, src)
    out = set()
    for t in {t for t, _ in forms}:
        ids = sorted(s for u, s in forms if u == t)
        for before, now in zip(ids, ids[1:]):
            a, b = forms[t, before], forms[t, now]
            used = set()
            for f, (name, kind, src) in b.items():
                old = f if f in a else src if src in a and src not in b else None
                if old is None:
                    out.add((t, now, f, "added"))
                    continue
                used.add(old)
                if a[old][0] != name:
                    out.add((t, now, f, "renamed"))
                if a[old][1] != kind:
                    out.add((t, now, f, "retyped"))
            out |= {(t, now, f, "removed") for f in a if f not in used}
    return out


def test_schema_changes_equal_plain_python(spark):
    rng = random.Random(4)
    rows = []
    for t in ("a", "b", "c"):
        for s in sorted(rng.sample(range(-3, 9000), 14)):
            for f in rng.sample(range(1, 9), 5):
                rows.append((t, s, 1, f, rng.choice([None, None, rng.randint(1, 8)]), rng.choice(["x", "X", "y", None]), rng.choice(["int", " INT", "long", "decimal( 9, 2)", "decimal(9,2)", None]), None, None, "z"))
    rows += rows[:20] + [(None, 1, 1, 1, None, "n", "int", None, None, None), ("a", None, 1, 1, None, "n", "int", None, None, None), ("only", 5, 1, 1, None, "n", "int", None, None, None)]
    df = spark.createDataFrame(rows, FIELDS)
    got = [tuple(r) for r in schema_drift.schema_changes(df).collect()]
    assert len(got) == len(set(got)) and set(got) == changes(rows)
    assert schema_drift.schema_changes(df.limit(0)).count() == 0


def test_neighbours_across_blocks(spark):
    values = [("g", v) for v in (-5000, -1, 0, 1, 4095, 4096, 4097, 20_000)] + [("h", 7)]
    got = {(r[0], r[1]): (r[2], r[3]) for r in neighbours(spark.createDataFrame(values, "g string, v int"), ["g"], "v").collect()}
    ordered = [v for g, v in values if g == "g"]
    assert got == {("g", v): (([None] + ordered)[i], (ordered + [None])[i + 1]) for i, v in enumerate(ordered)} | {("h", 7): (None, None)}


def test_consistent_rows(spark):
    fields = [
        ("t", 0, 1, 1, None, "id", "int", True, None, None),
        ("t", 0, 2, 2, None, "amt", "int", True, None, None),
        ("t", 1, 1, 1, None, "id", "long", True, None, None),
        ("t", 1, 2, 2, None, "amount", "string", True, None, None),
        ("t", 2, 1, 1, None, "id", "long", True, None, None),
        ("t", 2, 2, 9, 2, "total", "double", True, None, None),
    ]
    rows = [
        (1, "t", 0, '{"id":1,"amt":5}', 0),
        (1, "t", 0, '{"id":1,"amt":5}', 0),
        (2, "t", 0, '{"id":"x","amt":null}', 0),
        (3, "t", 1, '{"id":12345678901,"amount":"7.5"}', 0),
        (4, "t", 2, '{"total":2.5}', 0),
        (5, "t", 2, None, 0),
        (6, "t", 2, "[1]", 0),
        (7, "u", 2, '{"a":1}', 0),
        (8, None, None, "", 0),
    ]
    schemas = spark.createDataFrame(fields, FIELDS)
    df = spark.createDataFrame(rows, "row_id bigint, table_name string, schema_id int, payload string, fields int")
    got = {r["row_id"]: r for r in schema_drift.consistent_rows(df, schemas).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7, 8]
    one = got[1]["fields"]
    assert set(one) == {"id", "total"} and (one["id"]["tag"], one["id"]["whole"], one["id"]["canonical"]) == ("whole", 1, "1")
    assert (one["total"]["tag"], one["total"]["whole"], one["total"]["canonical"]) == ("whole", 5, "5")
    assert (got[2]["fields"]["id"]["tag"], got[2]["fields"]["id"]["conforms"], got[2]["fields"]["id"]["canonical"]) == ("text", False, None)
    assert got[2]["fields"]["total"]["tag"] == "null"
    assert got[3]["fields"]["total"]["text"] == "7.5" and got[4]["fields"]["total"]["real"] == 2.5
    assert got[5]["fields"]["id"]["tag"] == "null" and not got[5]["malformed"] and got[6]["malformed"]
    assert got[7]["fields"] == {} and got[7]["unread"] == '{"a":1}'
    kinds = {(r["path"], r["field_type"]): r for r in schema_drift.type_alternatives(schemas).collect()}
    assert kinds[2, "int"]["canonical_type"] == "string" and kinds[2, "double"]["canonical_name"] == "total" and kinds[1, "long"]["first_schema_id"] == 1


def test_chains_of_fields(spark):
    # a chain of 40 links, one that closes on itself, and what leads into it
    fields = [("t", s, 1, 100 + s, 99 + s if s else None, f"f{s}", "int", True, None, None) for s in range(41)]
    ring = [(1, None), (2, 1), (3, 2), (1, 3), (9, 1)]
    fields += [("r", s, 1, f, src, "x", "int", True, None, None) for s, (f, src) in enumerate(ring)]
    got = {(r["table_name"], r["field_id"]): r["path"] for r in schema_drift.field_paths(spark.createDataFrame(fields, FIELDS)).collect()}
    assert {p for (t, _), p in got.items() if t == "t"} == {100} and {p for (t, _), p in got.items() if t == "r"} == {1}


def test_canonical_values_are_exact(spark):
    kinds = [("0.1000", "decimal(20,12)", "0.1"), ("0.123456789012", "decimal(20,12)", "0.123456789012"), ("-007.50", "decimal(9,2)", "-7.5"), ("12345678901234567890123456789012345678", "decimal(38,0)", "12345678901234567890123456789012345678"), ("1e3", "decimal(9,2)", "1000"), ("x", "decimal(9,2)", None), ("", "decimal(9,2)", None), ("1.5", "long", None), (" 5 ", "long", "5"), ("2024-02-30", "date", None), ("1700000000000", "timestamp", "2023-11-14T22:13:20.000000"), ("yes", "boolean", "true"), ("é" * 9000, "string", "é" * 9000)]
    df = spark.createDataFrame([(i, v, t) for i, (v, t, _) in enumerate(kinds)], "i int, v string, t string")
    F = __import__("pyspark").sql.functions
    array = F.array(F.struct(F.lit("k").alias("key"), F.col("v").alias("value"), schema_drift._kind(F.col("t")).alias("kind"), F.col("t").alias("form")))
    got = [r[0] for r in df.select("i", schema_drift.branches(array)[0]["value"]["canonical"].alias("c")).orderBy("i").select("c").collect()]
    assert got == [c for _, _, c in kinds]


PATHS = [
    ("s3://b/a/x.parquet", ["S3A://b/a/x.parquet", "s3://b/a/./x.parquet", "s3://b//a/y/../x.parquet", "s3://b/%61/x.parquet", "s3a://b/../a/x.parquet"]),
    ("s3://b/a/X.parquet", ["s3://b/a/%58.parquet"]),
    ("s3://b/a+b%zz", ["s3a://b/a+b%zz"]),
    ("s3n://b/a", ["S3N://b/a"]),
]


def test_object_names(spark):
    rows = [(want, p) for want, ps in PATHS for p in [want, *ps]]
    got = spark.createDataFrame(rows, "w string, p string").select("w", object_name(__import__("pyspark").sql.functions.col("p")).alias("o")).collect()
    assert all(r["o"] == r["w"] for r in got), got


ENTRY = "entry_id bigint, table_name string, file_path string, content string, entry_status string, sequence_number bigint, snapshot_id bigint, schema_id int, store_id string, sale_date string, record_count bigint, file_size_in_bytes bigint, file string"


def test_small_files(spark):
    e = lambda i, path, seq, status="added", size=10, store="s", content="data": (i, "t", path, content, status, seq, 1, 0, store, "d", 1, size, "x")
    rows = [
        e(1, "s3://b/1", 1),
        e(1, "s3://b/1", 1),
        e(2, "s3a://b/./1", 2, "existing", None),
        e(3, "s3://b/2", 1),
        e(4, "s3://b/3", 1, size=2_000_000),
        e(5, "s3://b/3", 2, size=-1),
        e(6, "s3://b/4", 1),
        e(7, "s3://b/4", 3, "DELETED"),
        e(8, "s3://b/5", 1, size=None),
        e(9, "s3://b/6", 1, content="position-delete"),
        e(10, "s3://b/7", 1, store=None),
        e(11, "s3://b/8", 1, store=None, content=None),
        e(12, "s3://b/9", 1, store="alone"),
        e(13, None, 1),
        e(14, "s3://b/10", None, store="alone", size=0),
    ]
    df = spark.createDataFrame(rows, ENTRY)
    assert sorted(r["entry_id"] for r in compaction.small_files(df).collect()) == [2, 3, 10, 11]
    assert compaction.small_files(df.limit(0)).count() == 0


TABLES = st.lists(st.integers(0, 40), min_size=0, max_size=4)


@settings(max_examples=60, deadline=None)
@given(TABLES, st.booleans(), st.sampled_from(["none", "snappy", "zstd"]))
def test_blocks_are_copied_whole(sizes, index, codec):
    tables, files = [], []
    for k, n in enumerate(sizes):
        t = pa.table({"a": pa.array(range(n), pa.int64()), "s": pa.array([None if i % 3 == 0 else "é" * i for i in range(n)], pa.string()), "l": pa.array([[float(k)] * (i % 3) for i in range(n)], pa.list_(pa.float64())), "b": pa.array([i % 2 == 0 for i in range(n)], pa.bool_())})
        sink = io.BytesIO()
        pq.write_table(t, sink, row_group_size=7, compression=codec, write_page_index=index)
        tables.append(t)
        files.append(sink.getvalue())
    if not files:
        with pytest.raises(LakeError):
            parquet_blocks.merge_bytes(files)
        return
    merged, counts = parquet_blocks.merge_bytes(files)
    assert pq.read_table(io.BytesIO(merged)).equals(pa.concat_tables(tables))
    assert counts["rows"] == sum(sizes) and counts["files"] == len(files) and counts["bytes"] == len(merged)


def test_blocks_of_other_schemas_are_refused():
    files = []
    for t in (pa.table({"a": [1]}), pa.table({"a": ["x"]})):
        sink = io.BytesIO()
        pq.write_table(t, sink)
        files.append(sink.getvalue())
    with pytest.raises(LakeError, match="SCHEMA_CONFLICT"):
        parquet_blocks.merge_bytes(files)
    with pytest.raises(LakeError):
        parquet_blocks.merge_bytes([b"nothing"])


@settings(max_examples=60, deadline=None)
@given(TABLES, st.sampled_from(["none", "snappy", "zstd"]), st.booleans())
def test_small_blocks_become_one(sizes, codec, version2):
    tables, files = [], []
    for k, n in enumerate(sizes):
        values = [k * 7 - i for i in range(n)]
        t = pa.table(
            {"a": pa.array(values, pa.int64()), "u": pa.array([abs(v) for v in values], pa.uint32()), "s": pa.array([None if v % 3 == 0 else f"é{v}" for v in values], pa.string()), "f": pa.array([float("nan") if v == 5 else v / 2 for v in values], pa.float64()), "l": pa.array([[1.0] * (abs(v) % 3) for v in values], pa.list_(pa.float64())), "t": pa.array([v * 1000 for v in values], pa.timestamp("us"))}
        )
        sink = io.BytesIO()
        pq.write_table(t, sink, row_group_size=7, compression=codec, use_dictionary=False, data_page_version="2.0" if version2 else "1.0")
        tables.append(t)
        files.append(sink.getvalue())
    if not files:
        return
    merged, counts = parquet_blocks.merge_bytes(files)
    back = pq.ParquetFile(io.BytesIO(merged))
    whole = pa.concat_tables(tables)
    assert back.read().to_pydict().__repr__() == whole.to_pydict().__repr__()  # repr, as NaN differs from itself
    assert counts["groups"] == back.num_row_groups == (1 if len(whole) else 0) and counts["blocks"] == sum(-(-n // 7) for n in sizes)
    if len(whole):
        group = back.metadata.row_group(0)
        a = group.column(0).statistics
        assert (a.min, a.max, a.null_count, group.num_rows) == (min(whole["a"].to_pylist()), max(whole["a"].to_pylist()), 0, len(whole))
        texts = [x for x in whole["s"].to_pylist() if x is not None]
        s = group.column(2).statistics
        assert s.null_count == len(whole) - len(texts) and (not s.has_min_max or (s.min, s.max) == (min(texts), max(texts)))


def test_joined_blocks_read_by_spark_with_pushed_filters(spark):
    root = scratch(spark, "joined")
    local = local_path(root)
    os.makedirs(f"{local}/in")
    for k in range(5):
        pq.write_table(pa.table({"a": list(range(k * 10, k * 10 + 10)), "s": [f"v{k}"] * 10}), f"{local}/in/{k}.parquet", use_dictionary=k == 4)
    report = compaction.compact_directory(spark, f"{root}/in", f"{root}/out").collect()
    assert [(r["files"], r["blocks"], r["groups"], r["rows"]) for r in report] == [(5, 5, 2, 50)]
    back = compaction.read_compacted(spark, f"{root}/out")
    assert back.filter("a between 18 and 21").orderBy("a").collect() == [(18, "v1"), (19, "v1"), (20, "v2"), (21, "v2")] and back.filter("s = 'v4'").count() == 10


def test_compaction_keeps_each_record_once(spark):
    row = lambda i, path, store: (i, "t", path, 0, i, 1, 0, store, "d", i, 1, json.dumps({"i": i}), None)
    kinds = "row_id bigint, table_name string, file_path string, file_index int, row_offset bigint, snapshot_id bigint, schema_id int, store_id string, sale_date string, record_id bigint, record_version int, payload string, written_at timestamp_ntz"
    rows = [row(i, f"s3://b/{i % 9}", None if i % 9 > 6 else "s") for i in range(90)] + [row(3, "s3://b/3", "s"), row(99, None, "s"), row(200, "s3://b/big", "s")]
    entries = [(i, "t", f"s3a://b/./{i}", "data", "deleted" if i == 2 else "added", 1, 1, 0, None if i > 6 else "s", "d", 10, 100, "x") for i in range(9)]
    entries.append((50, "t", "s3://b/big", "data", "added", 1, 1, 0, "s", "d", 10, 10_000_000, "x"))
    df, manifest, out = spark.createDataFrame(rows, kinds), spark.createDataFrame(entries, ENTRY), scratch(spark, "test")
    for target, outputs in ((1 << 20, 2), (3000, None)):
        report = compaction.compact_lake(df, manifest, out, target).collect()
        assert sum(r["rows"] for r in report) == 80 and sum(r["files"] for r in report) == 8 == sum(len(r["sources"]) for r in report)
        assert len(report) == outputs or outputs is None and len(report) > 2
        assert len({r["path"] for r in report}) == len(report) == sum(r["groups"] for r in report)
        back = compaction.read_compacted(spark, out, df.schema)
        assert sorted(r["row_id"] for r in back.collect()) == [i for i in range(90) if i % 9 != 2]
    rest = compaction.untouched_rows(df, manifest)
    assert sorted((r["row_id"], r["kept"]) for r in rest.collect()) == [(i, False) for i in range(90) if i % 9 == 2] + [(99, False), (200, True)]
    assert compaction.compact_lake(df.limit(0), manifest.limit(0), f"{out}-empty").count() == 0
    assert compaction.read_compacted(spark, f"{out}-empty", df.schema).count() == 0


def test_small_files_found_are_those_that_were_merged(spark, tmp_path, monkeypatch):
    kinds = "row_id bigint, table_name string, file_path string, file_index int, row_offset bigint, snapshot_id bigint, schema_id int, store_id string, sale_date string, record_id bigint, record_version int, payload string, written_at timestamp_ntz"
    rows = [(i, "t", f"s3://b/{i % 3}", 0, i, 1, 0, "s", "d", i, 1, "{}", None) for i in range(30)]
    # 3 and 4 have no records in the table; 5 is alone in its partition, 6 is large
    entries = [(i, "t", f"s3a://b/./{i}", "data", "added", 1, 1, 0, "s" if i != 5 else None, "d", 10, 100 if i < 6 else 10_000_000, "x") for i in range(7)]
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/file_rows.parquet")
    spark.createDataFrame(entries, ENTRY).write.parquet(f"{tmp_path}/data_files.parquet")
    out = scratch(spark, "found")
    monkeypatch.setattr(lake_tasks, "scratch", lambda *_: out)
    assert sorted(r["entry_id"] for r in lake_tasks.p2_found(spark, str(tmp_path)).collect()) == [0, 1, 2, 3, 4]
    assert Pointer(spark, out).current()["sources"] == 5
    assert sorted(r["row_id"] for r in compaction.read_compacted(spark, out).collect()) == list(range(30))


def test_small_files_are_staged_whole_in_few_packs(spark):
    kinds = "row_id bigint, table_name string, file_path string, row_offset bigint, payload string"
    rows = [(i, "t", f"s3://b/{i % 7}", i, f"é{i}") for i in range(70)] + [(i, "t", f"s3a://b/./{i % 7}", i, f"é{i}") for i in range(14)] + [(None, "t", "s3://b/3", 500, "x")] * 2 + [(99, "t", None, 0, ""), (98, "t", "s3://b/other", 0, "")]
    files = spark.createDataFrame([(f"s3://b/{k}", "t", None if k == 6 else "s", "d") for k in range(60)], "file string, table_name string, store_id string, sale_date string")
    df, name = spark.createDataFrame(rows, kinds), "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, 4)  # files go on over several batches
    try:
        for every, names in ((True, range(60)), (False, range(7))):
            out = scratch(spark, "small")
            staged = compaction.stage_files(df, files, out, every)
            assert staged._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2  # of either side, before the join; none after it
            found = compaction.with_layouts(staged).collect()
            assert {r["file"]: r["store_id"] for r in found} == {f"s3://b/{k}": None if k == 6 else "s" for k in names} and len(found) == len(names)
            assert len({r["layout"] for r in found}) == 1 and len([x for x in os.listdir(local_path(out)) if x.endswith(".pack")]) <= 16
            for r in found:
                with open(local_path(r["path"]), "rb") as pack:
                    pack.seek(r["start"])
                    table, k = pq.read_table(io.BytesIO(pack.read(r["length"]))), int(r["file"].rpartition("/")[2])
                assert table.column("row_id").to_pylist() == (list(range(k, 70, 7)) if k < 7 else []) + [None] * 2 * (k == 3) and table.num_rows == r["rows"]
    finally:
        spark.conf.unset(name)


def test_shuffle_files_go_with_their_query(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), shuffles_released(spark):
        assert spark.conf.get(key) == "true"
        raise ZeroDivisionError
    assert spark.conf.get(key) == before


def test_parts_of_files_read_as_files(tmp_path):
    data = os.urandom(3 << 20)
    (tmp_path / "pack").write_bytes(data)
    for start, length in ((5, 1000), (7, 2 << 20), (1, 0)):
        file, n = open_part(f"file://{tmp_path}/pack", start, length)
        with file:
            assert n == length and file.read() == data[start : start + length] and file.read() == b""
            file.seek(length // 2)
            assert file.read(100) == data[start + length // 2 :][: min(100, length - length // 2)]
    file, n = open_part(f"{tmp_path}/pack", None, 0)
    with file:
        assert (n, file.read()) == (len(data), data)


def test_outlines_are_those_of_footers():
    files = []
    for t in (pa.table({"a": [1, 2]}), pa.table({"a": [1]}), pa.table({"a": ["x"]}), pa.table({f"c{i}": pa.array([i] * 3, pa.decimal128(9, 2)) for i in range(900)}), pa.table({"a": [7] * 5})):
        sink = io.BytesIO()
        pq.write_table(t, sink)
        files.append((t.num_rows, sink.getvalue()))
    layouts = []
    for rows, data in files:
        whole, some = (read(io.BytesIO(data), len(data)) for read in (parquet_blocks.footer, parquet_blocks.outline))
        assert parquet_blocks.row_count(some) == parquet_blocks.row_count(whole) == rows and parquet_blocks.block_count(whole) == 1
        assert parquet_blocks.get(some, parquet_blocks.BLOCKS) is None and parquet_blocks.layout(some) == parquet_blocks.layout(whole)
        written = parquet_blocks._Writer()
        written.struct(whole)
        assert data[-8 - len(written.out) : -8] == written.out
        layouts.append(parquet_blocks.layout(whole))
    assert layouts[0] == layouts[1] == layouts[4] and len(set(layouts)) == 3


def test_plain_paths_are_their_names(spark):
    paths = ["s3://b/a", "s3://b/a/", "s3://b//a", "s3:///a", "s3://./a", "s3://../a", "s3://b/.a", "s3://b/a.b", "s3://b/..", "s3://b/a%20b", "s3://b/s3://c", "s3://", "s3:/b/a", "S3://b/a", "s3a://b/a", "b/a", "", None]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [tuple(r) for r in df.select(object_name(df["p"]), _object_name(df["p"])).collect()]
    assert [a for a, _ in got] == [b for _, b in got] and got[0][0] == "s3://b/a"


def test_compact_directory(spark):
    root = scratch(spark, "dir")
    spark.range(500).selectExpr("id", "id % 3 as k", "repeat('v', cast(id % 7 as int)) as v").repartition(12).write.partitionBy("k").parquet(f"{root}/in")
    report = compaction.compact_directory(spark, f"{root}/in", f"{root}/out", target=10_000).collect()
    assert sum(r["rows"] for r in report) == 500 and {r["folder"] for r in report} == {"k=0", "k=1", "k=2"}
    same = lambda: compaction.read_compacted(spark, f"{root}/out").selectExpr("id", "k", "v").exceptAll(spark.read.parquet(f"{root}/in").selectExpr("id", "k", "v")).count() == 0
    assert same()
    # a second compaction replaces the first one's files in one step; one that fails leaves them in force
    before = compaction.read_compacted(spark, f"{root}/out").inputFiles()
    compaction.compact_directory(spark, f"{root}/in", f"{root}/out")
    assert same() and not set(before) & set(compaction.read_compacted(spark, f"{root}/out").inputFiles())
    with pytest.raises(LakeError, match="lost or gained"):
        compaction.publish(spark, f"{root}/out", lambda to: spark.createDataFrame([("p", 1, 5)], "path string, files bigint, rows bigint"), lambda: 6)
    assert same()


def test_compact_directory_carries_large_files(spark):
    root = scratch(spark, "dir")
    source = spark.range(3000).selectExpr("id", "id % 3 as k", "repeat(md5(cast(id as string)), 3) as v")
    source.filter("id < 60").repartition(6).write.partitionBy("k").parquet(f"{root}/in")
    source.filter("id >= 60").repartition(2).write.mode("append").partitionBy("k").parquet(f"{root}/in")
    sizes = [os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(local_path(f"{root}/in")) for f in files if f.endswith(".parquet")]
    below = sorted(sizes)[len(sizes) // 2]
    for limit in (below, 1, max(sizes) + 1):  # some files are carried over, all are, none is
        report = compaction.compact_directory(spark, f"{root}/in", f"{root}/out{limit}", below=limit).collect()
        assert sum(r["rows"] for r in report) == 3000 and sum(r["files"] for r in report) == len(sizes)
        assert sum("/kept-" in r["path"] for r in report) == sum(n >= limit for n in sizes)
        back = compaction.read_compacted(spark, f"{root}/out{limit}").selectExpr("id", "k", "v")
        assert back.count() == 3000 and back.exceptAll(source.selectExpr("id", "cast(k as int) as k", "v")).count() == 0


def test_incremental_runs_survive_failures(spark):
    root = scratch(spark, "runs")
    store, seen = incremental.StateStore(spark, f"{root}/state"), []
    frame = lambda rows: spark.createDataFrame(rows, "k string, v string, key int")

    def sink(df, run):
        seen.append((run, sorted((r["k"] or "", r["v"] or "") for r in df.collect())))

    one = frame([("a", "1", 0), ("a", "1", 0), (None, "2", 0), ("b", None, 0)])
    assert incremental.run_incremental(store, one, ["k"], ["v"], "r1", sink)
    assert not incremental.run_incremental(store, one, ["k"], ["v"], "r1", sink)
    two = one.unionByName(frame([("a", "9", 0), ("c", "1", 0)]))

    def broken(df, run):
        sink(df, run)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        incremental.run_incremental(store, two, ["k"], ["v"], "r2", broken, order=["v"])
    assert incremental.run_incremental(store, two, ["k"], ["v"], "r2", sink, order=["v"])
    assert seen == [("r1", [("", "2"), ("a", "1"), ("b", "")]), ("r2", [("a", "9"), ("c", "1")]), ("r2", [("a", "9"), ("c", "1")])]
    began = store.current()
    assert began["runs"] == ["r1", "r2"]
    with pytest.raises(LakeError, match="COMMIT_CONFLICT"):
        store.commit(store.read(), "r3", began | {"number": 1})
    store.vacuum()
    assert store.read().count() == 4
    assert incremental.run_incremental(store, one.limit(0), ["k"], ["v"], "r4", sink) and seen[-1] == ("r4", [])
    assert store.read().count() == 4
    # what goes back to an earlier content is changed again
    assert incremental.run_incremental(store, frame([("a", "1", 0)]), ["k"], ["v"], "r5", sink) and seen[-1] == ("r5", [("a", "1")])
    # of several rows of a key the last counts; keys that a complete input hasn't are new when they come back
    rows = frame([("a", "1", 2), ("a", "7", 1), ("c", "1", 0)])
    assert incremental.run_incremental(store, rows, ["k"], ["v"], "r6", sink, order=["key"], complete=True) and seen[-1] == ("r6", [])
    assert store.read().count() == 2
    assert incremental.run_incremental(store, frame([("b", None, 0), ("c", "1", 0)]), ["k"], ["v"], "r7", sink) and seen[-1] == ("r7", [("b", "")])


def test_rows_that_arrive_during_a_run_belong_to_the_next(spark):
    root = scratch(spark, "arriving")
    store, seen = incremental.StateStore(spark, f"{root}/state"), []
    spark.range(5).write.parquet(f"{root}/in")

    def sink(df, run):
        spark.createDataFrame([(run_rows,) for run_rows in range(5, 8)], "id bigint").write.mode("append").parquet(f"{root}/in")
        seen.append(sorted(r["id"] for r in df.collect()))

    for run in ("r1", "r2"):
        spark.catalog.refreshByPath(f"{root}/in")
        incremental.run_incremental(store, spark.read.parquet(f"{root}/in"), ["id"], ["id"], run, sink)
    assert seen == [[0, 1, 2, 3, 4], [5, 6, 7]]


def test_two_racing_commits(spark):
    root = scratch(spark, "race")
    first, second = incremental.StateStore(spark, root), incremental.StateStore(spark, root)
    state = spark.createDataFrame([(b"k", b"c")], incremental.STATE)
    assert first.commit(state, "a", None)
    began = second.current()
    assert first.pointer.publish(began | {"run": "b"}, began)["number"] == 2
    with pytest.raises(LakeError, match="COMMIT_CONFLICT"):  # the other writer published between the check and this
        second.pointer.publish(began | {"run": "c"}, began)
    assert second.current()["run"] == "b" and not second.pointer.names(".pointer")
    with pytest.raises(LakeError, match="COMMIT_CONFLICT"):
        second.commit(state, "d", began)


def test_pending_records(spark):
    rows = [(i, "t", i // 10, i % 10, 1 + i // 10, 100 + i % 25, 1 + i // 25, "x") for i in range(40)]
    rows += [rows[5], (90, None, 0, 0, 1, 1, 1, "x"), (91, "t", None, None, None, None, None, "x"), (92, "other", 0, 0, 1, 7, 1, "x")]
    df = spark.createDataFrame(rows, "row_id bigint, table_name string, file_index int, row_offset bigint, snapshot_id bigint, record_id bigint, record_version int, payload string")
    jobs = spark.createDataFrame([("j1", "t", "fp_A", None), ("j2", "t", "fp_B", None), ("j3", "gone", "fp", None)], "job_id string, table_name string, plan_fingerprint string, created_at timestamp_ntz")
    mark = lambda run, plan, snap, f, o, state="complete", job="j1": (job, run, plan, snap, f, 0, o, state, None)
    marks = [mark(1, "fp_a ", "SNAPSHOT_2", 1, 4), mark(2, "fp_a", "2", 2, None), mark(3, "fp_old", "9", 9, 9), mark(4, "fp_a", "snapshot_9", 9, 9, "running"), mark(5, None, "9", 9, 9), mark(1, "fp_a", "9", 9, 9, job="j2")]
    books = spark.createDataFrame(marks, "job_id string, run_no int, plan_fingerprint string, snapshot_ref string, file_index int, row_group int, row_offset bigint, state string, saved_at timestamp_ntz")
    got = [tuple(r) for r in incremental.pending_records(df, jobs, books, scratch(spark, "s")).collect()]
    of_t = [r for r in rows if r[1] == "t"]
    covered = {(r[5], r[6]) for r in of_t if r[4] is not None and r[4] <= 2 and (r[2], r[3]) < (1, 4)}
    want = {("j1", r[5], r[6]) for r in of_t if (r[5], r[6]) not in covered} | {("j2", r[5], r[6]) for r in of_t}
    assert len(got) == len(set(got)) and set(got) == want
    assert incremental.pending_records(df.limit(0), jobs, books.limit(0), scratch(spark, "s")).count() == 0


def test_messages(spark):
    rows = [
        (1, "K-1", "t", "planned", "x"),
        (2, " k%2D1\n", "T ", "PLANNED", None),
        (3, "k-1", "t", "output-written", "x"),
        (4, "K-1", "t", "outputWritten", "x"),
        (5, None, "t", "planned", "x"),
        (6, None, "t", "planned", "x"),
        (7, "  ", "t", "planned", "x"),
        (8, "%20", "t", "planned", "x"),
        (9, "k", None, None, "x"),
        (10, "k", None, None, "x"),
        (11, "k%zz", "t", "planned", "x"),
        (12, "a b", "t", "planned", "x"),
        (13, "a%20b", "t", "planned", "x"),
        *[(100 + i, "hot", "t", "planned", "x") for i in range(200)],
    ]
    df = spark.createDataFrame(rows, "delivery_id bigint, idempotency_key string, task_id string, state string, copies string")
    found = sorted(r[0] for r in dedup.repeated_deliveries(df, dedup.message_identity(), "delivery_id").collect())
    assert found == [2, 4, 10, 13, *range(101, 300)]
    stored = df.filter("delivery_id in (2, 13)")
    kept = sorted(r[0] for r in dedup.dedupe_messages(df.filter("delivery_id <> 2"), stored, dedup.message_identity(), "delivery_id").collect())
    assert kept == [2, 3, 5, 6, 7, 8, 9, 11, 13, 100]
    assert dedup.dedupe_messages(df.limit(0), None, dedup.message_identity(), "delivery_id").count() == 0
    # deliveries that share an order value: one of each message stays
    shared = spark.createDataFrame([(1, "a", "t", "planned", "x"), (1, "b", "t", "planned", "y"), (2, "a", "t", "planned", "z"), (1, "a", "t", "planned", "w")], df.schema)
    assert sorted(r[1] for r in dedup.dedupe_messages(shared, None, dedup.message_identity(), "delivery_id").collect()) == ["a", "b"]
    # neither a window nor a join sees a message's deliveries in one part
    plan = dedup.repeated_deliveries(df, dedup.message_identity(), "delivery_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "[__identity" in plan and "__part" in plan.split("row_number")[-1]


def test_null_ids_lose_no_rows(spark):
    rows = [(None, "a", "t", "planned", "x"), (7, "a", "t", "planned", "y"), (None, "b", "t", "planned", "x"), (None, "b", "t", "planned", "x"), (None, "c", "t", "planned", "z"), (None, None, "t", "planned", "x")]
    df = spark.createDataFrame(rows, "delivery_id bigint, idempotency_key string, task_id string, state string, copies string")
    kept = dedup.dedupe_messages(df, None, dedup.message_identity(), "delivery_id").collect()
    assert sorted((r[1] or "", r[0] or 0) for r in kept) == [("", 0), ("a", 7), ("b", 0), ("c", 0)]
    schemas = spark.createDataFrame([("t", 0, 1, 1, None, "id", "int", True, None, None)], FIELDS)
    payloads = spark.createDataFrame([(i, "t", 0, f'{{"id":{n}}}') for n, i in enumerate([None, None, 4, 4, None])], "row_id bigint, table_name string, schema_id int, payload string")
    assert sorted(r[0] or 0 for r in schema_drift.consistent_rows(payloads, schemas).collect()) == [0, 0, 0, 4]
    assert sorted(r[0] or 0 for r in dedup.once_each(payloads, "row_id").collect()) == [0, 0, 0, 4]


def test_salted_join_matches_nulls(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("a", 3), ("b", 4)], "k string, v int")
    right = spark.createDataFrame([(None, "n"), ("a", "x")], "k string, w string")
    assert sorted(map(tuple, salted_join(left, right, ["k"], left["v"]).select("v", "w").collect())) == [(1, "n"), (2, "x"), (3, "x")]
    assert [r["v"] for r in salted_join(left, right, ["k"], left["v"], "left_anti").collect()] == [4]
