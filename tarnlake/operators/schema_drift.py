"""Schemas that drift between files: tagged unions of the types of each path, and a report of every change.

Consecutive schemas of a table are fused into one row per field that holds the field's earlier and later form side by
side. What continues what follows from that row; the alternatives of name and type that appear over time are kept per
path (a chain of fields of which each continues the one before), so that conflicting types become typed branches with
one canonical conversion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.operators.dedup import once_each
from tarnlake.plans.shared import materialized
from tarnlake.plans.skew import neighbours, salted_join

_FIELD = "struct<field_name:string,field_type:string,source_id:int>"


def plain_type(c: Column) -> Column:
    """A type's spelling without letter case and white space."""
    return F.regexp_replace(F.lower(c), r"[\s\p{Z}]+", "")


def _union(before: Column, now: Column, had: Column, has: Column) -> Column:
    """The alternatives of one property of a path in two parallel schemas, each with whether either schema has it."""
    form = lambda x, b, n: F.struct(x.alias("form"), b.alias("before"), n.alias("now"))
    apart = F.filter(F.array(form(before, had, F.lit(False)), form(now, F.lit(False), has)), lambda a: a["before"] | a["now"])
    return F.when(had & has & before.eqNullSafe(now), F.array(form(now, F.lit(True), F.lit(True)))).otherwise(apart)


def fused_schemas(schemas: DataFrame) -> DataFrame:
    """One row per path of a schema and the one before it, fused: (table, schema, field) with the union of its types and of its names.

    ``types`` and ``names`` hold the alternatives that either schema has for the path (``form``) and which of them has
    it: one alternative of both where nothing changed, two where they conflict, one of one schema where the path comes
    or goes. ``now`` and ``before`` are the field's forms in this and in the preceding schema (null where it has none),
    ``had`` tells whether there is a preceding schema, ``origin`` is the field that it continues by ``source_id`` and
    ``taken`` whether a vanished field is continued so. Deliveries of one field agree or the earliest loaded counts. Rows without
    table, schema or field id describe no field and are left out; an empty input gives an empty result.
    """
    fields = (
        schemas.filter(F.col("table_name").isNotNull() & F.col("schema_id").isNotNull() & F.col("field_id").isNotNull())
        .groupBy("table_name", "schema_id", "field_id")
        .agg(F.min(F.struct(F.coalesce(F.col("loaded_at").cast("string"), F.lit("~")), F.struct("field_name", "field_type", "source_id").alias("form"))).alias("first"))
        .select("table_name", "schema_id", "field_id", F.col("first.form").alias("form"))
    )
    linked = fields.join(neighbours(fields, ["table_name"], "schema_id"), ["table_name", "schema_id"])
    nothing = F.lit(None).cast(_FIELD)
    both = (
        linked.select(
            F.explode(
                F.filter(
                    F.array(
                        F.struct("table_name", F.col("schema_id"), "field_id", F.col("form").alias("now"), nothing.alias("before"), F.col("__prev").isNotNull().alias("had")),
                        F.struct("table_name", F.col("__next").alias("schema_id"), "field_id", nothing.alias("now"), F.col("form").alias("before"), F.lit(True).alias("had")),
                    ),
                    lambda x: x["schema_id"].isNotNull(),
                )
            ).alias("x")
        )
        .select("x.*")
        .groupBy("table_name", "schema_id", "field_id")
        .agg(F.max("now").alias("now"), F.max("before").alias("before"), F.max("had").alias("had"))
    )
    came, went = F.col("before").isNull() & F.col("had"), F.col("now").isNull()
    by_source = Window.partitionBy("table_name", "schema_id", "__key")
    fused = (
        both.withColumn("__key", F.when(came, F.col("now.source_id")).otherwise(F.col("field_id")))
        .withColumns(
            {
                "__left": F.max(F.when(went, F.struct("field_id", "before"))).over(by_source),
                "taken": F.coalesce(went & F.max(came & F.col("now.source_id").isNotNull()).over(by_source), F.lit(False)),
            }
        )
        .withColumn("__origin", F.when(came & F.col("__key").isNotNull(), F.col("__left")))
        .select(
            "table_name",
            "schema_id",
            "field_id",
            "now",
            F.coalesce(F.col("before"), F.col("__origin.before")).alias("before"),
            "had",
            F.col("__origin.field_id").alias("origin"),
            "taken",
        )
    )
    now, before = F.col("now"), F.col("before")
    has, was = now.isNotNull(), before.isNotNull()
    return fused.withColumns(
        {
            "types": _union(plain_type(before["field_type"]), plain_type(now["field_type"]), was, has),
            "names": _union(before["field_name"], now["field_name"], was, has),
        }
    )


def schema_changes(schemas: DataFrame) -> DataFrame:
    """(table_name, schema_id, field_id, change), read off the alternatives that appear on each fused path.

    A path all of whose alternatives appear was added, one that keeps none was removed (unless another field continues
    it); where an alternative appears beside an earlier one, of type or of name, the field was retyped or renamed.
    """
    appears = lambda union: F.exists(union, lambda a: a["now"] & ~a["before"]) & F.exists(union, lambda a: a["before"])
    types, names = F.col("types"), F.col("names")
    added = F.forall(types, lambda a: ~a["before"])
    removed = F.forall(types, lambda a: ~a["now"]) & ~F.col("taken")
    kinds = F.array(*[F.when(c, F.lit(k)) for k, c in (("added", added), ("removed", removed), ("renamed", appears(names)), ("retyped", appears(types)))])
    fused = fused_schemas(schemas).filter("had")
    return fused.select("table_name", "schema_id", "field_id", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("change"))


def canonical_type(types: Column) -> Column:
    """The one type that all of an array of plain types convert to without loss of magnitude; ``string`` if there is none."""
    whole, decimal = F.array(F.lit("int"), F.lit("long")), r"^decimal\((\d+),(\d+)\)$"
    real = F.array(F.lit("float"), F.lit("double"))
    scale = F.transform(types, lambda t: F.coalesce(F.regexp_extract(t, decimal, 2).try_cast("int"), F.lit(0)))
    head = F.transform(
        types,
        lambda t: F.coalesce(
            F.regexp_extract(t, decimal, 1).try_cast("int") - F.regexp_extract(t, decimal, 2).try_cast("int"),
            F.when(t == "int", F.lit(10)).otherwise(F.lit(19)),
        ),
    )
    is_decimal = lambda t: t.rlike(decimal)
    return (
        F.when(F.size(types) == 1, types[0])
        .when(F.forall(types, lambda t: F.array_contains(whole, t)), F.lit("long"))
        .when(
            F.forall(types, lambda t: F.array_contains(whole, t) | is_decimal(t)) & (F.array_max(head) + F.array_max(scale) <= 38),
            F.concat(F.lit("decimal("), (F.array_max(head) + F.array_max(scale)).cast("string"), F.lit(","), F.array_max(scale).cast("string"), F.lit(")")),
        )
        .when(F.forall(types, lambda t: F.array_contains(whole, t) | F.array_contains(real, t) | is_decimal(t)), F.lit("double"))
        .when(F.forall(types, lambda t: t.isin("date", "timestamp")), F.lit("timestamp"))
        .otherwise(F.lit("string"))
    )


def field_paths(schemas: DataFrame) -> DataFrame:
    """(table_name, schema_id, field_id, field_name, field_type, path): the first field of the chain that each continues.

    Chains of ``source_id`` are followed by doubling the step each round, until nothing changes or the steps are longer
    than all links together: what still moves then is on, or leads into, a chain that closes on itself, whose smallest
    id is the path.
    """
    fused = materialized(fused_schemas(schemas).select("table_name", "schema_id", "field_id", "now", "origin"), "fused")
    links = fused.filter(F.col("origin").isNotNull() & (F.col("origin") != F.col("field_id"))).groupBy("table_name", "field_id").agg(F.min("origin").alias("path"))
    steps = materialized(links.withColumn("low", F.least("field_id", "path")), "steps")
    count, length, moving = steps.count(), 1, True
    while moving and length <= count:
        up = steps.select("table_name", F.col("field_id").alias("path"), F.col("path").alias("higher"), F.col("low").alias("lower"))
        steps = materialized(
            steps.join(up, ["table_name", "path"], "left").select("table_name", "field_id", F.coalesce("higher", "path").alias("path"), F.least("low", "lower").alias("low"), F.col("higher").isNotNull().alias("moved")),
            "steps",
        )
        moving, length = steps.filter("moved").limit(1).count() > 0, 2 * length
    if moving and count:
        around = steps.select("table_name", F.col("field_id").alias("path"), F.col("low").alias("least"))
        steps = steps.join(around, ["table_name", "path"], "left").withColumn("path", F.when(F.col("moved"), F.coalesce("least", "path")).otherwise(F.col("path")))
    own = fused.filter(F.col("now").isNotNull())
    return own.join(steps.select("table_name", "field_id", "path"), ["table_name", "field_id"], "left").select(
        "table_name",
        "schema_id",
        "field_id",
        F.col("now.field_name").alias("field_name"),
        plain_type(F.col("now.field_type")).alias("field_type"),
        F.coalesce("path", "field_id").alias("path"),
    )


def type_alternatives(schemas: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """One row per path and type that it has had: where it first and last appears, and the path's canonical name and type.

    The canonical name is that of the path's latest schema; where two paths of a table share it, ``#`` and the path follow.
    """
    paths = field_paths(schemas) if paths is None else paths
    alternatives = paths.groupBy("table_name", "path", "field_type").agg(
        F.min("schema_id").alias("first_schema_id"), F.max("schema_id").alias("last_schema_id"), F.max(F.struct("schema_id", "field_id", "field_name")).alias("latest")
    )
    unions = (
        alternatives.groupBy("table_name", "path")
        .agg(F.array_sort(F.collect_set(F.coalesce("field_type", F.lit("string")))).alias("types"), F.max("latest").alias("latest"))
        .withColumns({"canonical_type": canonical_type(F.col("types")), "name": F.coalesce(F.col("latest.field_name"), F.lit(""))})
    )
    shared = unions.groupBy("table_name", "name").agg(F.count("*").alias("owners"))
    named = unions.join(shared, ["table_name", "name"]).select(
        "table_name", "path", "canonical_type", F.when(F.col("owners") > 1, F.concat("name", F.lit("#"), F.col("path").cast("string"))).otherwise(F.col("name")).alias("canonical_name")
    )
    return alternatives.drop("latest").join(named, ["table_name", "path"])


def _kind(plain: Column) -> Column:
    """The branch of a union that values of a type belong to."""
    return (
        F.when(plain.isin("int", "long"), "whole")
        .when(plain.isin("float", "double") | plain.startswith("decimal"), "real")
        .when(plain == "boolean", "flag")
        .when(plain.isin("date", "timestamp"), "instant")
        .otherwise(F.lit("text"))
    )


def branches(values: Column) -> Column:
    """An array of (key, value, kind, form) as tagged unions: (key, value struct) of each.

    ``value`` is a text, ``kind`` the branch of its declared type and ``form`` its canonical type. ``tag`` names the
    branch that holds it: whole, real, flag, instant (ISO text, or milliseconds since 1970) or text; a value that isn't
    of its declared type goes to text with ``conforms`` false; ``null`` has no branch. ``canonical`` is the value as its
    canonical type writes it, null where the conversion fails; decimals are exact at any number of digits.

    Each step is a transform of its own, so that no conversion is evaluated twice.
    """
    wants = lambda x, kind, *forms: (x["kind"] == kind) | x["form"].isin(*forms)
    instant = lambda v: F.when(v.rlike(r"^-?\d{9,}$"), F.timestamp_millis(v.try_cast("long"))).otherwise(v.try_cast("timestamp"))
    parsed = F.transform(
        values,
        lambda x: F.struct(
            x["key"].alias("key"),
            x["value"].alias("value"),
            x["kind"].alias("kind"),
            x["form"].alias("form"),
            F.when(wants(x, "whole", "int", "long"), x["value"].try_cast("long")).alias("whole"),
            F.when(wants(x, "real", "float", "double"), x["value"].try_cast("double")).alias("real"),
            F.when(wants(x, "flag", "boolean"), x["value"].try_cast("boolean")).alias("flag"),
            F.when(wants(x, "instant", "date", "timestamp"), instant(x["value"])).alias("instant"),
        ),
    )
    tagged = F.transform(
        parsed,
        lambda x: F.struct(
            x.alias("x"),
            F.when(x["value"].isNull(), F.lit("null"))
            .when((x["kind"] == "whole") & x["whole"].isNotNull(), F.lit("whole"))
            .when((x["kind"] == "real") & x["real"].isNotNull(), F.lit("real"))
            .when((x["kind"] == "flag") & x["flag"].isNotNull(), F.lit("flag"))
            .when((x["kind"] == "instant") & x["instant"].isNotNull(), F.lit("instant"))
            .otherwise(F.lit("text"))
            .alias("tag"),
        ),
    )
    sign, digits = r"^\s*(-?)\+?0*(\d+)(?:\.(\d*?)0*)?\s*$", r"\.$"
    exact = lambda v: F.when(v.rlike(sign), F.regexp_replace(F.regexp_replace(v, sign, "$1$2.$3"), digits, "")).otherwise(
        F.regexp_replace(F.regexp_replace(v.try_cast("decimal(38,18)").cast("string"), sign, "$1$2.$3"), digits, "")
    )
    canonical = lambda x: (
        F.when(x["form"] == "int", x["value"].try_cast("int").cast("string"))
        .when(x["form"] == "long", x["whole"].cast("string"))
        .when(x["form"] == "float", x["value"].try_cast("float").cast("string"))
        .when(x["form"] == "double", x["real"].cast("string"))
        .when(x["form"].startswith("decimal"), exact(x["value"]))
        .when(x["form"] == "boolean", x["flag"].cast("string"))
        .when(x["form"] == "date", F.date_format(x["instant"], "yyyy-MM-dd"))
        .when(x["form"] == "timestamp", F.date_format(x["instant"], "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .otherwise(x["value"])
    )
    return F.transform(
        tagged,
        lambda t: F.struct(
            t["x"]["key"].alias("key"),
            F.struct(
                t["tag"].alias("tag"),
                F.when(t["tag"] == "whole", t["x"]["whole"]).alias("whole"),
                F.when(t["tag"] == "real", t["x"]["real"]).alias("real"),
                F.when(t["tag"] == "flag", t["x"]["flag"]).alias("flag"),
                F.when(t["tag"] == "instant", t["x"]["instant"]).alias("instant"),
                F.when(t["tag"] == "text", t["x"]["value"]).alias("text"),
                ((t["tag"] != "text") | (t["x"]["kind"] == "text")).alias("conforms"),
                canonical(t["x"]).alias("canonical"),
            ).alias("value"),
        ),
    )


_SPEC = "array<struct<canonical_name:string,field_name:string,kind:string,form:string>>"


def consistent_rows(rows: DataFrame, schemas: DataFrame) -> DataFrame:
    """Every row of ``rows`` with its JSON ``payload`` as a map from canonical field name to a tagged value.

    ``rows`` has table_name, schema_id, payload and ``row_id``; one row comes out for each delivery-free ``row_id``, and one for each row whose ``row_id`` is null. The
    map has every field of the row's schema, absent ones with tag ``null``. A null payload gives null values only, one
    that is no JSON object also sets ``malformed``; a row of an unknown schema keeps its payload with an empty map.
    """
    paths = materialized(field_paths(schemas), "paths")
    named = type_alternatives(schemas, paths).select("table_name", "path", "canonical_name", "canonical_type").distinct()
    specs = (
        paths.join(named, ["table_name", "path"])
        .groupBy("table_name", "schema_id")
        .agg(F.sort_array(F.collect_set(F.struct("canonical_name", "field_name", _kind(F.coalesce("field_type", F.lit(""))).alias("kind"), F.col("canonical_type").alias("form")))).alias("__spec"))
    )
    one = once_each(rows.select("row_id", "table_name", "schema_id", "payload"), "row_id")
    joined = salted_join(one, materialized(specs, "specs"), ["table_name", "schema_id"], F.col("row_id"), "left")
    read = joined.withColumn("__values", F.from_json("payload", "map<string,string>"))
    spec = F.coalesce(F.col("__spec"), F.array().cast(_SPEC))
    fields = F.transform(
        spec, lambda s: F.struct(s["canonical_name"].alias("key"), F.try_element_at(F.col("__values"), s["field_name"]).alias("value"), s["kind"].alias("kind"), s["form"].alias("form"))
    )
    return read.select(
        "row_id",
        "table_name",
        "schema_id",
        F.map_from_entries(branches(fields)).alias("fields"),
        (F.col("payload").isNotNull() & (F.col("__values").isNull() | ~F.col("payload").rlike(r"^\s*\{"))).alias("malformed"),
        F.when(F.col("__spec").isNull(), F.col("payload")).alias("unread"),
    )


def field_counts(rows: DataFrame) -> DataFrame:
    """Of each canonical field of ``consistent_rows``, how many values each branch holds: where types really conflict."""
    return (
        rows.select("table_name", F.explode("fields").alias("field", "value"))
        .groupBy("table_name", "field", F.col("value.tag").alias("tag"))
        .agg(F.count("*").alias("values"), F.count_if(~F.col("value.conforms")).alias("unfit"))
    )
