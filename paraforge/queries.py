"""The queries of the reading, writing and checking operators, each with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import UnsupportedTypeError, translate
from .functions import conversions as C
from .functions.levels import is_fault, list_levels, nested_levels
from .operators import dictionary, diff, variant
from .operators.batches import bounded_batches, with_batch_number
from .operators.validate import count_violations
from .sources import Reader, ReadOptions, WriteOptions, file_facts, read, write
from .sources.footer import part_files, read_footer, stored_schema
from .sources.reader import refine
from .sources.writer import Writer, decoded_table
from .types import arrow_primitive, schema_differences, stored_columns
from .workspace import work_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, projection=None) -> DataFrame:
    return read(spark, f"{sf_dir}/{name}.parquet", projection)


def round_trip(df: DataFrame, name: str, options: WriteOptions = WriteOptions(), projection=None) -> DataFrame:
    path = work_path(df.sparkSession, name)
    write(df, path, options)
    return read(df.sparkSession, path, projection)


_BY_FLAGS = "SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, sum(l_quantity::BIGINT)::BIGINT AS quantity, sum(l_linenumber)::BIGINT AS numbers FROM lineitem GROUP BY ALL"


def by_flags(df: DataFrame) -> DataFrame:
    return df.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round("l_quantity").cast("long")).alias("quantity"), F.sum("l_linenumber").alias("numbers"))


@query(_BY_FLAGS)
def scan_full(spark, sf_dir):
    return by_flags(table(spark, sf_dir, "lineitem"))


@query(_BY_FLAGS)
def roundtrip_flat(spark, sf_dir):
    return by_flags(round_trip(table(spark, sf_dir, "lineitem"), "flat"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def project_flat(spark, sf_dir):
    return table(spark, sf_dir, "lineitem", [("l_quantity",), ("l_orderkey",), ("l_linenumber",)])


def _with_customer(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    status = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    customer = F.when(F.col("o_orderkey") % 5 != 0, F.struct(F.col("o_custkey").alias("id"), status.alias("order")))
    return orders.select("o_orderkey", customer.alias("cust"), F.array("o_custkey", "o_orderkey").alias("keys"))


@query("SELECT o_orderkey, o_orderkey % 5 = 0 AS absent, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS status, 1::BIGINT AS children FROM orders")
def project_nested(spark, sf_dir):
    df = round_trip(_with_customer(spark, sf_dir), "nested", projection=[("cust", "order", "status"), ("o_orderkey",)])
    return df.select("o_orderkey", F.col("cust").isNull().alias("absent"), F.col("cust.order.status").alias("status"), F.lit(len(df.schema["cust"].dataType.fields)).cast("long").alias("children"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey ELSE -1 END AS id, 2::BIGINT AS children FROM orders")
def project_overlap(spark, sf_dir):
    df = round_trip(_with_customer(spark, sf_dir), "overlap", projection=[("cust", "id"), ("cust",), ("o_orderkey",)])
    return df.select("o_orderkey", F.coalesce("cust.id", F.lit(-1)).alias("id"), F.lit(len(df.schema["cust"].dataType.fields)).cast("long").alias("children"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey ELSE -1 END AS id, 1::BIGINT AS children FROM orders")
def project_partial_unknown(spark, sf_dir):
    df = round_trip(_with_customer(spark, sf_dir), "partial", projection=[("cust", "id"), ("cust", "nothing"), ("o_orderkey",)])
    return df.select("o_orderkey", F.coalesce("cust.id", F.lit(-1)).alias("id"), F.lit(len(df.schema["cust"].dataType.fields)).cast("long").alias("children"))


@query("SELECT o_orderkey, 2::BIGINT AS n, o_custkey + o_orderkey AS total FROM orders")
def project_into_list(spark, sf_dir):
    df = round_trip(_with_customer(spark, sf_dir), "into_list", projection=[("keys", "list", "whatever"), ("o_orderkey",)])
    return df.select("o_orderkey", F.size("keys").cast("long").alias("n"), (F.col("keys")[0] + F.col("keys")[1]).alias("total"))


@query("SELECT (i // 8192)::BIGINT AS batch, count(*)::BIGINT AS n FROM (SELECT row_number() OVER () - 1 AS i FROM lineitem) GROUP BY 1")
def batch_rows(spark, sf_dir):
    return with_batch_number(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "_metadata.row_index", "_metadata"), ReadOptions().batch_rows).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


#: Limits of the batches of batch_variable_bytes.
_BATCH_ROWS, _BATCH_BYTES = 9, 20_000


@query(f"""
WITH RECURSIVE d AS (SELECT doc_id % 16 AS part, strlen(text)::BIGINT AS bytes, row_number() OVER (PARTITION BY doc_id % 16 ORDER BY doc_id) AS i FROM documents),
r AS (
  SELECT part, i, bytes, 0::BIGINT AS batch, bytes AS held, 1::BIGINT AS n FROM d WHERE i = 1
  UNION ALL
  SELECT d.part, d.i, d.bytes, r.batch + (CASE WHEN full_now THEN 1 ELSE 0 END), CASE WHEN full_now THEN d.bytes ELSE r.held + d.bytes END, CASE WHEN full_now THEN 1 ELSE r.n + 1 END
  FROM (SELECT *, held >= {_BATCH_BYTES} OR n >= {_BATCH_ROWS} AS full_now FROM r) r JOIN d ON d.part = r.part AND d.i = r.i + 1
)
SELECT part, batch, count(*)::BIGINT AS rows_in_batch, sum(bytes)::BIGINT AS bytes FROM r GROUP BY 1, 2
""")
def batch_variable_bytes(spark, sf_dir):
    """The rows of 16 readers, each in order: a batch ends after the row that reaches either limit."""
    docs = table(spark, sf_dir, "documents", [("doc_id",), ("text",)]).withColumn("part", F.col("doc_id") % 16)
    dealt = docs.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "doc_id", "text")
    split = bounded_batches(dealt, _BATCH_ROWS, _BATCH_BYTES, "doc_id", by="part")
    return split.groupBy("part", "batch").agg(F.count(F.lit(1)).alias("rows_in_batch"), F.sum("bytes").alias("bytes"))


@query("SELECT g::BIGINT AS group_number, least(2000, n - g * 2000)::BIGINT AS rows_in_group FROM (SELECT count(*) AS n FROM orders), range(0, 1000000) t(g) WHERE g * 2000 < n")
def row_group_plan(spark, sf_dir):
    path = work_path(spark, "groups")
    write(table(spark, sf_dir, "orders").coalesce(1), path, WriteOptions(row_group_rows=2000))
    groups = [n for f in file_facts(spark, path) for n in f.groups]
    return spark.createDataFrame(list(enumerate(groups)), "group_number long, rows_in_group long")


def _lists(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", [("l_orderkey",), ("l_linenumber",), ("l_partkey",)])
    return lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("lines"))


@query("SELECT l_orderkey, count(*)::BIGINT AS n, sum(l_linenumber)::BIGINT AS numbers, min(l_linenumber)::INT AS first_number FROM lineitem GROUP BY 1")
def roundtrip_list(spark, sf_dir):
    df = round_trip(_lists(spark, sf_dir).select("l_orderkey", F.col("lines.l_linenumber").alias("numbers")), "list")
    return df.select("l_orderkey", F.size("numbers").cast("long").alias("n"), F.aggregate("numbers", F.lit(0).cast("long"), lambda a, x: a + x).alias("numbers"), F.col("numbers")[0].alias("first_number"))


@query("SELECT label, count(*)::BIGINT AS n, sum(len(embedding))::BIGINT AS slots, 0::BIGINT AS violations FROM embeddings GROUP BY 1")
def fixed_list(spark, sf_dir):
    df = round_trip(table(spark, sf_dir, "embeddings"), "fixed")
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("embedding")).alias("slots"), F.count(F.when(~C.fixed_list_ok(F.col("embedding"), 64), 1)).alias("violations"))


@query("SELECT l_orderkey, count(*)::BIGINT AS n, sum(i * l_partkey)::BIGINT AS in_order FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) AS i FROM lineitem) GROUP BY 1")
def roundtrip_map(spark, sf_dir):
    """Maps whose keys descend: the entries come back in their order, which the sum of place times value tells."""
    entries = F.transform(F.reverse("lines"), lambda x, i: F.struct((100 - i).alias("key"), x["l_partkey"].alias("value")))
    df = round_trip(_lists(spark, sf_dir).select("l_orderkey", F.map_from_entries(entries).alias("lines")), "map")
    placed = F.transform(F.map_values("lines"), lambda x, i: x * (i + 1))
    return df.select("l_orderkey", F.size("lines").cast("long").alias("n"), F.aggregate(placed, F.lit(0).cast("long"), lambda a, x: a + x).alias("in_order"))


def _stored_maps(spark, sf_dir) -> str:
    """The path of a table of maps, some of which have a key twice. Spark's own expressions don't make such maps, files may hold them."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            lines = batch.column(1)
            numbers = lines.flatten().field("l_linenumber") if lines.offset == 0 else pa.concat_arrays([lines]).flatten().field("l_linenumber")
            keys = pa.array([n % 3 for n in numbers.to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.MapArray.from_arrays(lines.offsets, keys, numbers)], ["l_orderkey", "m"])

    path = work_path(spark, "repeated_keys")
    _lists(spark, sf_dir).mapInArrow(run, "l_orderkey long, m map<int,int>").write.parquet(path)
    return path


@query("SELECT l_orderkey, count(*)::BIGINT AS entries, count(*) <> count(DISTINCT l_linenumber % 3) AS repeated FROM lineitem GROUP BY 1")
def map_duplicate_keys(spark, sf_dir):
    stored = spark.read.parquet(_stored_maps(spark, sf_dir))
    return stored.select("l_orderkey", F.size("m").cast("long").alias("entries"), (~C.map_ok(F.col("m"))).alias("repeated"))


@query("SELECT l_orderkey, count(*)::BIGINT AS n, sum(l_linenumber + 2 * l_partkey)::BIGINT AS total FROM lineitem GROUP BY 1")
def roundtrip_nested(spark, sf_dir):
    nested = F.transform("lines", lambda x: F.struct(x["l_linenumber"].alias("number"), F.create_map(F.lit("part"), x["l_partkey"], F.lit("again"), x["l_partkey"]).alias("attributes")))
    df = round_trip(_lists(spark, sf_dir).select("l_orderkey", nested.alias("lines")), "deep")
    lines = df.select("l_orderkey", F.explode("lines").alias("x")).select("l_orderkey", "x.number", F.explode(F.map_values("x.attributes")).alias("part"))
    return lines.groupBy("l_orderkey").agg((F.count(F.lit(1)) / 2).cast("long").alias("n"), (F.sum("number") / 2 + F.sum("part")).cast("long").alias("total"))


@query("SELECT event_id, ((epoch_us(ts) // 1000000) % 86400 * 1000)::INT AS millis FROM events")
def promote_time_seconds(spark, sf_dir):
    seconds = F.pmod(F.unix_seconds(F.col("ts").cast("timestamp")), F.lit(86400)).cast("int")
    return _utc(spark, table(spark, sf_dir, "events")).select("event_id", C.time_seconds_to_millis(seconds).alias("millis"))


def _utc(spark, df):
    """df with its zone-less ts as microseconds since 1970, whatever the session's zone."""
    return df.withColumn("ts", F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")))


@query("SELECT event_id, (epoch_us(ts) // 1000000 * 1000)::BIGINT AS millis FROM events")
def promote_timestamp_seconds(spark, sf_dir):
    return _utc(spark, table(spark, sf_dir, "events")).select("event_id", C.timestamp_seconds_to_millis(F.unix_seconds("ts")).alias("millis"))


@query("SELECT event_id, epoch_ms(ts) % 86400000 = 0 AS exact, (epoch_ms(ts) // 86400000)::INT AS day FROM events")
def date64_to_day(spark, sf_dir):
    millis = F.unix_millis("ts")
    return _utc(spark, table(spark, sf_dir, "events")).select("event_id", C.date64_ok(millis).alias("exact"), F.unix_date(C.date64_to_day(millis)).alias("day"))


@query("SELECT rule, n::BIGINT AS violations FROM (SELECT count(*) FILTER (event_id % 90000 >= 86400 OR event_id % 7 = 0) AS a, count(*) FILTER (event_id % 7 = 0) AS b FROM events), LATERAL (VALUES ('seconds', a), ('micros', b)) v(rule, n)")
def validate_time_range(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 7 == 0, F.lit(-1)).otherwise(F.col("event_id") % 90000).alias("v"))
    return count_violations(events, {"seconds": C.time_ok(F.col("v"), "s"), "micros": C.time_ok(F.col("v"), "us")})


@query("SELECT rule, n::BIGINT AS violations FROM (SELECT count(*) FILTER (p_partkey % 1000 - 200 NOT BETWEEN -128 AND 127) AS a, count(*) FILTER (p_partkey % 1000 - 200 NOT BETWEEN 0 AND 255) AS b, 0 AS c, count(*) FILTER (p_partkey % 1000 - 200 < 0) AS d FROM part), LATERAL (VALUES ('int8', a), ('uint8', b), ('int16', c), ('uint16', d)) v(rule, n)")
def validate_int_range(spark, sf_dir):
    v = F.col("p_partkey") % 1000 - 200
    return count_violations(table(spark, sf_dir, "part"), {"int8": C.int_ok(v, 8, True), "uint8": C.int_ok(v, 8, False), "int16": C.int_ok(v, 16, True), "uint16": C.int_ok(v, 16, False)})


@query("SELECT count(*) FILTER (doc_id % 10 = 0)::BIGINT AS violations, 'utf8' AS rule FROM documents")
def validate_utf8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", [("doc_id",), ("text",)])
    raw = F.when(F.col("doc_id") % 10 == 0, F.concat(F.unhex(F.lit("C3")), F.unhex(F.lit("28")))).otherwise(F.col("text").cast("binary"))
    return count_violations(docs, {"utf8": C.utf8_ok(raw)})


@query("SELECT count(*) FILTER (strlen(c_mktsegment) <> 10)::BIGINT AS violations, 'width' AS rule FROM customer")
def validate_fixed_binary(spark, sf_dir):
    return count_violations(table(spark, sf_dir, "customer"), {"width": C.fixed_binary_ok(F.col("c_mktsegment").cast("binary"), 10)})


@query("SELECT rule, n::BIGINT AS violations FROM (SELECT count(*) FILTER (o_orderkey % 5 <> 0 AND o_orderkey % 3 = 0) AS a, count(*) FILTER (o_orderkey % 4 = 0) AS b FROM orders), LATERAL (VALUES ('child', a), ('elements', b)) v(rule, n)")
def validate_required(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", [("o_orderkey",)])
    s = F.when(F.col("o_orderkey") % 5 != 0, F.struct(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")).alias("v")))
    a = F.array(F.lit(1), F.when(F.col("o_orderkey") % 4 != 0, F.lit(2)))
    df = round_trip(orders.select(s.alias("s"), a.alias("a")), "required")
    return count_violations(df, {"child": C.required_ok(F.col("s"), F.col("s.v")), "elements": C.required_elements_ok(F.col("a"))})


@query("SELECT p::INT AS precision, CASE WHEN p <= 9 THEN 'INT32' WHEN p <= 18 THEN 'INT64' ELSE 'FIXED(' || (CASE WHEN p <= 18 THEN 8 WHEN p <= 21 THEN 9 WHEN p <= 23 THEN 10 WHEN p <= 26 THEN 11 WHEN p <= 28 THEN 12 WHEN p <= 31 THEN 13 WHEN p <= 33 THEN 14 WHEN p <= 35 THEN 15 ELSE 16 END) || ')' END AS physical FROM range(1, 39) t(p)")
def decimal_physical(spark, sf_dir):
    return spark.range(1, 39).select(F.col("id").cast("int").alias("precision"), C.decimal_physical(F.col("id")).alias("physical"))


@query("SELECT o_orderkey, (o_orderkey % 256)::BIGINT AS u8, (4294967295 - o_orderkey)::BIGINT AS u32, (18446744073709551615 - o_orderkey::HUGEINT)::DECIMAL(20,0)::VARCHAR AS u64 FROM orders")
def unsigned_widen(spark, sf_dir):
    stored = table(spark, sf_dir, "orders", [("o_orderkey",)]).select("o_orderkey", (F.col("o_orderkey") % 256).alias("a"), (-1 - F.col("o_orderkey")).alias("b"))
    df = round_trip(stored, "unsigned")
    return df.select("o_orderkey", C.unsigned_widen(F.col("a"), 8).alias("u8"), C.unsigned_widen(F.col("b"), 32).alias("u32"), C.unsigned_widen(F.col("b"), 64).cast("string").alias("u64"))


@query("SELECT event_id, epoch_us(ts)::BIGINT AS instant, epoch_us(ts)::BIGINT AS local FROM events")
def timestamp_kind(spark, sf_dir):
    events = table(spark, sf_dir, "events", [("event_id",), ("ts",)])
    df = round_trip(_utc(spark, events).select("event_id", F.col("ts").alias("instant")).join(events.select("event_id", F.col("ts").alias("local")), "event_id"), "timestamps")
    assert [f.dataType.typeName() for f in df.schema.fields] == ["long", "timestamp", "timestamp_ntz"]
    return df.select("event_id", F.unix_micros("instant").alias("instant"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', local)").alias("local"))


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _codes(spark, sf_dir, bad: bool):
    orders = table(spark, sf_dir, "orders", [("o_orderkey",), ("o_orderpriority",)])
    names = orders.select("o_orderpriority").distinct().withColumn("code", F.substring("o_orderpriority", 1, 1).cast("int"))
    code = F.when(F.col("o_orderkey") % 11 == 0, F.lit(None)).when(F.lit(bad) & (F.col("o_orderkey") % 13 == 0), F.lit(-1)).otherwise(F.substring("o_orderpriority", 1, 1).cast("int"))
    return orders.select("o_orderkey", code.alias("code")), names.withColumnRenamed("o_orderpriority", "priority")


@query("SELECT CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS priority, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def dictionary_decode(spark, sf_dir):
    coded, names = _codes(spark, sf_dir, False)
    return dictionary.decode_checked(round_trip(coded, "codes"), round_trip(names, "names"), "code", "priority").groupBy("priority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 = 0")
def dictionary_dangling(spark, sf_dir):
    coded, names = _codes(spark, sf_dir, True)
    return dictionary.dangling(coded, names, "code").select("o_orderkey")


@query("SELECT json_extract(props, '$.k')::BIGINT AS k, count(*)::BIGINT AS n FROM events GROUP BY 1")
def roundtrip_variant(spark, sf_dir):
    df = round_trip(table(spark, sf_dir, "events").select(variant.from_json(F.col("props")).alias("v")), "variant")
    return df.select(F.variant_get("v", "$.k", "bigint").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def variant_plain_struct(spark, sf_dir):
    """A variant's storage as a plain struct of two binaries stays one, byte by byte: read as a variant again it is what it was."""
    first, second = work_path(spark, "unmarked"), work_path(spark, "plain")
    flag = "spark.sql.parquet.variant.annotateLogicalType.enabled"
    before = spark.conf.get(flag, None)
    spark.conf.set(flag, "false")
    try:
        write(table(spark, sf_dir, "events").select("event_id", variant.from_json(F.col("props")).alias("v")), first)
    finally:
        spark.conf.unset(flag) if before is None else spark.conf.set(flag, before)
    key = T.StructField("event_id", T.LongType())
    storage = T.StructType([T.StructField("metadata", T.BinaryType()), T.StructField("value", T.BinaryType())])
    write(read(spark, first, schema=T.StructType([key, T.StructField("v", storage)])), second)
    assert read(spark, second).schema["v"].dataType == storage
    df = read(spark, second, schema=T.StructType([key, T.StructField("v", T.VariantType())]))
    return df.select("event_id", F.variant_get("v", "$.k", "bigint").alias("k"))


def _faulty(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", [("o_orderkey",), ("o_totalprice",), ("o_orderstatus",)])
    nested = orders.select("o_orderkey", "o_totalprice", "o_orderstatus", F.array(F.lit(1), F.lit(2)).alias("xs"), F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)).alias("m"))
    k = F.col("o_orderkey")
    changed = nested.select(
        "o_orderkey",
        F.when(k % 17 == 0, F.lit(-1.0)).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        F.when(k % 19 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 23 == 0, F.array(F.lit(1))).otherwise(F.col("xs")).alias("xs"),
        F.when(k % 29 == 0, F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.lit(1))).otherwise(F.col("m")).alias("m"),
    )
    return nested, changed


@query("SELECT 'LOGICAL_VALUES' AS dimension, 'o_totalprice' AS path, count(*)::BIGINT AS n FROM orders WHERE o_orderkey % 17 = 0 HAVING count(*) > 0 UNION ALL SELECT 'NULL_EMPTY_NESTED_SHAPE', 'o_orderstatus', count(*) FROM orders WHERE o_orderkey % 19 = 0 HAVING count(*) > 0 UNION ALL SELECT 'NULL_EMPTY_NESTED_SHAPE', 'xs', count(*) FROM orders WHERE o_orderkey % 23 = 0 HAVING count(*) > 0 UNION ALL SELECT 'NULL_EMPTY_NESTED_SHAPE', 'm', count(*) FROM orders WHERE o_orderkey % 29 = 0 HAVING count(*) > 0")
def dataset_diff(spark, sf_dir):
    expected, actual = _faulty(spark, sf_dir)
    return diff.compare_values(round_trip(expected, "expected"), round_trip(actual, "actual"), "o_orderkey").groupBy("dimension", "path").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 19 = 0 THEN 'o_orderstatus' ELSE 'xs' END AS path FROM orders WHERE o_orderkey % 19 = 0 UNION ALL SELECT o_orderkey, 'xs' FROM orders WHERE o_orderkey % 23 = 0")
def diff_shape(spark, sf_dir):
    expected, actual = _faulty(spark, sf_dir)
    return diff.compare_values(expected, actual, "o_orderkey").where("dimension = 'NULL_EMPTY_NESTED_SHAPE' AND path <> 'm'").select("o_orderkey", "path")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 29 = 0")
def diff_map_order(spark, sf_dir):
    expected, actual = _faulty(spark, sf_dir)
    return diff.compare_values(expected.select("o_orderkey", "m"), actual.select("o_orderkey", "m"), "o_orderkey").select("o_orderkey")


@query("SELECT o_orderkey, o_orderkey % 4 <> 1 AS same FROM orders")
def diff_float_semantics(spark, sf_dir):
    k = F.col("o_orderkey")
    x = F.when(k % 4 == 0, F.lit(float("nan"))).when(k % 4 == 1, F.lit(-0.0)).otherwise(F.lit(1.5))
    y = F.when(k % 4 == 0, F.lit(float("nan"))).when(k % 4 == 1, F.lit(0.0)).otherwise(F.lit(1.5))
    df = round_trip(table(spark, sf_dir, "orders", [("o_orderkey",)]).select("o_orderkey", x.alias("x"), y.alias("y")), "floats")
    return df.select("o_orderkey", C.same_float(F.col("x"), F.col("y")).alias("same"))


@query("SELECT * FROM (VALUES ('o_totalprice', 'double became string'), ('xs.element', 'int became bigint'), ('m', 'missing')) v(path, detail)")
def schema_compat(spark, sf_dir):
    expected, _ = _faulty(spark, sf_dir)
    other = expected.select("o_orderkey", F.col("o_totalprice").cast("string").alias("o_totalprice"), "o_orderstatus", F.col("xs").cast("array<bigint>").alias("xs"))
    return spark.createDataFrame(schema_differences(expected.schema, other.schema), "path string, detail string")


@query("SELECT rl, dl, count(*)::BIGINT AS n, 0::BIGINT AS faults FROM (SELECT 0 AS rl, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS dl FROM orders UNION ALL SELECT 1, 3 FROM orders WHERE o_orderkey % 3 = 2) GROUP BY ALL")
def dremel_levels(spark, sf_dir):
    k = F.col("o_orderkey")
    xs = F.when(k % 3 == 1, F.array().cast("array<int>")).when(k % 3 == 2, F.array(F.lit(None).cast("int"), F.lit(7)))
    events = list_levels(round_trip(table(spark, sf_dir, "orders", [("o_orderkey",)]).select("o_orderkey", xs.alias("xs")), "levels"), "o_orderkey", "xs")
    return events.groupBy("rl", "dl").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_fault(3), 1)).alias("faults"))


@query("""
WITH c AS (SELECT count(*)::BIGINT AS n, count(DISTINCT l_orderkey)::BIGINT AS first FROM lineitem)
SELECT 'lines.list.element.' || leaf AS leaf, rl, dl, CASE rl WHEN 0 THEN first WHEN 1 THEN n - first ELSE n END AS n FROM c,
(VALUES ('number', 0, 4), ('number', 1, 4), ('attributes.key_value.key', 0, 5), ('attributes.key_value.key', 1, 5), ('attributes.key_value.key', 2, 5),
('attributes.key_value.value', 0, 6), ('attributes.key_value.value', 1, 6), ('attributes.key_value.value', 2, 5)) v(leaf, rl, dl)
""")
def nested_dremel_levels(spark, sf_dir):
    """The events of the leaves of a list of structs that hold maps with one value and one null."""
    nested = F.transform("lines", lambda x: F.struct(x["l_linenumber"].alias("number"), F.create_map(F.lit("part"), x["l_partkey"], F.lit("none"), F.lit(None).cast("long")).alias("attributes")))
    df = round_trip(_lists(spark, sf_dir).select("l_orderkey", nested.alias("lines")), "nested_levels")
    return nested_levels(df, "l_orderkey", "lines").groupBy("leaf", "rl", "dl").agg(F.count(F.lit(1)).alias("n"))


def _matrix(spark, sf_dir, options: dict[str, WriteOptions], see) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem", [("l_orderkey",), ("l_quantity",), ("l_returnflag",)])
    out = None
    for name, option in options.items():
        path = work_path(spark, name.lower())
        write(lines, path, option)
        one = read(spark, path).agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys")).select(F.lit(name).alias("option"), F.lit(see(file_facts(spark, path))).alias("seen"), "n", "keys")
        out = one if out is None else out.unionByName(one)
    return out


_MATRIX = "SELECT option, seen, n, keys FROM (SELECT count(*)::BIGINT AS n, sum(l_orderkey)::BIGINT AS keys FROM lineitem), (VALUES {}) v(option, seen)"


@query(_MATRIX.format("('UNCOMPRESSED', 'UNCOMPRESSED'), ('ZSTD', 'ZSTD'), ('SNAPPY', 'SNAPPY'), ('GZIP', 'GZIP')"))
def codec_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir, {c: WriteOptions(compression=c) for c in ("UNCOMPRESSED", "ZSTD", "SNAPPY", "GZIP")}, lambda facts: ",".join(sorted({c for f in facts for c in f.codecs})))


@query(_MATRIX.format("('V1', 'PLAIN_DICTIONARY'), ('V2', 'RLE_DICTIONARY')"))
def page_version_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir, {v: WriteOptions(page_version=v) for v in ("V1", "V2")}, lambda facts: ",".join(sorted({e for f in facts for e in f.encodings if e.endswith("_DICTIONARY")})))


@query(_MATRIX.format("('default', 'dictionary'), ('plain', 'none')"))
def writer_options(spark, sf_dir):
    options = {"default": WriteOptions(), "plain": WriteOptions(dictionary=False, page_bytes=64 << 10, page_rows=1000)}
    return _matrix(spark, sf_dir, options, lambda facts: "dictionary" if any("DICTIONARY" in e for f in facts for e in f.encodings) else "none")


@query(_BY_FLAGS)
def checksum_read(spark, sf_dir):
    path = work_path(spark, "checksums")
    write(table(spark, sf_dir, "lineitem"), path, WriteOptions(page_checksums=True))
    return by_flags(read(spark, path, options=ReadOptions(verify_page_checksums=True)))


@query("SELECT (SELECT count(*) FROM customer)::BIGINT AS total_rows, 5::BIGINT AS columns")
def file_info(spark, sf_dir):
    path = work_path(spark, "facts")
    write(table(spark, sf_dir, "customer"), path)
    facts = file_facts(spark, path)
    return spark.createDataFrame([(sum(f.rows for f in facts), facts[0].columns)], "total_rows long, columns long")


@query("SELECT count(*)::BIGINT AS total_rows, ((count(*) + 499) // 500)::BIGINT AS batches, ((count(*) + 1999) // 2000)::BIGINT AS row_groups FROM customer")
def read_metrics(spark, sf_dir):
    """What a reader counts while it goes through a table: rows and batches as they come, and the row groups that it has completed."""
    path = work_path(spark, "metrics_read")
    write(table(spark, sf_dir, "customer").coalesce(1), path, WriteOptions(row_group_rows=2000))
    reader = Reader(read(spark, path, [("c_custkey",)]), ReadOptions(batch_rows=500))
    while reader.load_next():
        pass
    groups = sum(len(f.groups) for f in file_facts(spark, path))
    return spark.createDataFrame([(reader.rows, reader.batches, groups)], "total_rows long, batches long, row_groups long")


@query("SELECT count(*)::BIGINT AS total_rows, true AS has_bytes FROM supplier")
def write_metrics(spark, sf_dir):
    path = work_path(spark, "metrics")
    write(table(spark, sf_dir, "supplier"), path)
    facts = file_facts(spark, path)
    return spark.createDataFrame([(sum(f.rows for f in facts), sum(f.bytes for f in facts) > 0)], "total_rows long, has_bytes boolean")


@query("SELECT 0::BIGINT AS total_rows, 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS names")
def empty_roundtrip(spark, sf_dir):
    df = round_trip(table(spark, sf_dir, "orders").limit(0), "empty")
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select("total_rows", F.lit(",".join(df.columns)).alias("names"))


@query("""
SELECT 'region' AS name, count(*)::BIGINT AS total_rows, sha256(string_agg('{"key":' || r_regionkey || ',"name":"' || r_name || '"}', chr(10) ORDER BY r_regionkey)) AS digest FROM region
UNION ALL SELECT 'nation', count(*), sha256(string_agg('{"key":' || n_nationkey || ',"name":"' || n_name || '"}', chr(10) ORDER BY n_nationkey)) FROM nation
""")
def fixture_manifest(spark, sf_dir):
    """A manifest of small fixed tables: name, rows, and the digest of all rows in the order of their key, after they were written and read."""
    out = None
    for name, short in (("region", "r"), ("nation", "n")):
        rows = round_trip(table(spark, sf_dir, name), f"fixture_{name}").select(F.col(f"{short}_{name}key").alias("key"), F.to_json(F.struct(F.col(f"{short}_{name}key").alias("key"), F.col(f"{short}_name").alias("name"))).alias("line"))
        lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key", "line"))), lambda x: x["line"]), "\n")
        one = rows.agg(F.count(F.lit(1)).alias("total_rows"), F.sha2(lines, 256).alias("digest")).select(F.lit(name).alias("name"), "total_rows", "digest")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT * FROM (VALUES ('o_orderkey', 'INT64', ''), ('o_custkey', 'INT64', ''), ('o_orderstatus', 'BINARY', 'STRING'), ('o_totalprice', 'DOUBLE', ''), ('o_orderdate', 'INT64', 'TIMESTAMP(MICROS,false)'), ('o_orderpriority', 'BINARY', 'STRING')) v(path, physical, annotation)")
def type_contract(spark, sf_dir):
    rows = [(s.path, s.physical, s.annotation) for s in stored_columns(table(spark, sf_dir, "orders").schema)]
    return spark.createDataFrame(rows, "path string, physical string, annotation string")


@query("SELECT 'ts' AS name, 'ns' AS unit UNION ALL SELECT 'width', '4' UNION ALL SELECT 'plain', '' UNION ALL SELECT 'own', 's'")
def schema_refine(spark, sf_dir):
    """What a file says itself stays; hints add to it; hints for columns that are not there are passed over."""
    df = spark.range(3).select(F.col("id").alias("ts", metadata={"unit": "ns"}), F.lit(b"abcd").alias("width"), F.col("id").alias("plain"), F.col("id").alias("own", metadata={"unit": "s"}))
    back = refine(round_trip(df, "refined"), {"width": {"fixed_width": 4}, "own": {"unit": "ms"}, "absent": {"unit": "us"}})
    rows = [(f.name, str(next(iter((f.metadata or {"": ""}).values())))) for f in back.schema.fields]
    return spark.createDataFrame(rows, T.StructType().add("name", "string").add("unit", "string"))


@query("SELECT o_orderkey AS row, 'LOGICAL_VALUES' AS dimension, 'v' AS path FROM orders WHERE false UNION ALL SELECT (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT, 'LOGICAL_VALUES', 'v' FROM orders QUALIFY o_orderkey % 13 = 0")
def diff_by_row_number(spark, sf_dir):
    """Two tables without keys, in different partitions, aligned by the number of the row over all partitions."""
    orders = table(spark, sf_dir, "orders", [("o_orderkey",)]).repartitionByRange(7, "o_orderkey").sortWithinPartitions("o_orderkey")
    changed = table(spark, sf_dir, "orders", [("o_orderkey",)]).repartitionByRange(3, "o_orderkey").sortWithinPartitions("o_orderkey")
    k = F.col("o_orderkey")
    return diff.compare_values(orders.select((k % 1000).alias("v")), changed.select(F.when(k % 13 == 0, F.lit(-1)).otherwise(k % 1000).alias("v")))


@query("SELECT 'LOGICAL_VALUES' AS dimension, path, count(*)::BIGINT AS n FROM orders, (VALUES ('xs', 5), ('s', 7), ('maps', 11)) v(path, m) WHERE o_orderkey % m = 0 GROUP BY path")
def diff_nested(spark, sf_dir):
    """Signed zeros in lists and structs, and values of maps in lists, after both tables were written and read."""
    k = F.col("o_orderkey")

    def build(changed: bool):
        zero = lambda m: F.when(F.lit(changed) & (k % m == 0), F.negate(k.cast("double")) * 0.0).otherwise(k.cast("double") * 0.0)  # noqa: E731  the optimizer takes literal zeros for one
        one = F.when(F.lit(changed) & (k % 11 == 0), F.lit(2)).otherwise(F.lit(1))
        xs, s = F.array(F.lit(float("nan")), zero(5)), F.struct(F.create_map(F.lit("z"), zero(7)).alias("m"))
        return table(spark, sf_dir, "orders", [("o_orderkey",)]).select("o_orderkey", xs.alias("xs"), s.alias("s"), F.array(F.create_map(F.lit("n"), one)).alias("maps"))

    found = diff.compare_values(round_trip(build(False), "nested_expected"), round_trip(build(True), "nested_actual"), "o_orderkey")
    return found.groupBy("dimension", "path").agg(F.count(F.lit(1)).alias("n"))


@query(_MATRIX.format("('all', '3'), ('none', '0'), ('some', '2')"))
def column_statistics(spark, sf_dir):
    """For how many columns the files hold statistics."""
    options = {"all": WriteOptions(), "none": WriteOptions(statistics=False), "some": WriteOptions(without_statistics=("l_returnflag",))}
    return _matrix(spark, sf_dir, options, lambda facts: str(max(f.with_statistics // max(1, len(f.groups)) for f in facts)))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def roundtrip_arrow(spark, sf_dir):
    """Arrow data, its dictionary and unsigned integers among them, written in two row groups."""
    import pyarrow as pa

    nation = table(spark, sf_dir, "nation").toArrow()  # 25 rows
    coded = pa.table({"n_nationkey": nation["n_nationkey"].cast(pa.int64()), "n_name": nation["n_name"].cast(pa.string()).dictionary_encode(), "n_regionkey": nation["n_regionkey"].cast(pa.uint32())})
    path = work_path(spark, "arrow")
    with Writer(path, spark=spark) as writer:
        writer.write_batch(coded.slice(0, 10))
        writer.flush_row_group()
        writer.write_batch(coded.slice(10))
    return read(spark, path)


@query("SELECT o_orderkey, o_orderkey::BIGINT AS key_again FROM orders")
def roundtrip_nulls(spark, sf_dir):
    """A column of nulls beside another."""
    df = round_trip(table(spark, sf_dir, "orders", [("o_orderkey",)]).select("o_orderkey", F.lit(None).alias("nothing")), "nulls")
    assert df.schema["nothing"].dataType == T.NullType()
    return df.select("o_orderkey", F.when(F.col("nothing").isNull(), F.col("o_orderkey")).alias("key_again"))


@query("SELECT json_extract(props, '$.k')::BIGINT AS k, count(*)::BIGINT AS n FROM events GROUP BY 1")
def roundtrip_variant_shredded(spark, sf_dir):
    """Variants that another writer has stored with a typed value beside them."""
    path = work_path(spark, "shredded")
    before = spark.conf.get("spark.sql.variant.writeShredding.enabled", None)
    spark.conf.set("spark.sql.variant.writeShredding.enabled", "true")
    try:
        table(spark, sf_dir, "events").select(variant.from_json(F.col("props")).alias("v")).write.parquet(path)
    finally:
        spark.conf.unset("spark.sql.variant.writeShredding.enabled") if before is None else spark.conf.set("spark.sql.variant.writeShredding.enabled", before)
    return read(spark, path).select(F.variant_get("v", "$.k", "bigint").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def _rejections(cases: dict) -> list[tuple[str, str]]:
    out = []
    for name, run in cases.items():
        try:
            run()
            out.append((name, ""))
        except Exception as error:
            out.append((name, type(translate(error)).__name__))
    return out


@query("""
SELECT * FROM (VALUES ('good', ''), ('utf8', 'InvalidValueError'), ('width', 'InvalidValueError'), ('size', 'InvalidValueError'), ('time', 'InvalidValueError'), ('required', 'InvalidValueError'),
('float key', 'InvalidValueError'), ('interval', 'UnsupportedTypeError'), ('other schema', 'InputSchemaMismatchError')) v(case_name, error)
""")
def write_rejections(spark, sf_dir):
    """What write() says to orders of which some break a rule. Nothing is left of a table that it rejects."""
    orders = table(spark, sf_dir, "orders", [("o_orderkey",)])
    k = F.col("o_orderkey")
    some = lambda good, bad: F.when(k % 50 == 0, bad).otherwise(good)
    required = T.StructType([T.StructField("v", T.LongType(), False)])
    cases = {
        "good": (k.alias("v"), None),
        "utf8": (some(F.lit("fine"), F.expr("cast(X'C328' as string)")).alias("v"), None),
        "width": (some(F.lit(b"four"), F.lit(b"five!")).alias("v", metadata={"fixed_width": 4}), None),
        "size": (some(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1))).alias("v", metadata={"fixed_size": 2}), None),
        "time": (some(F.lit(0), F.lit(86_400)).alias("v", metadata={"time_unit": "s"}), None),
        "required": (some(k, F.lit(None)).alias("v"), required),
        "float key": (F.create_map(F.lit(1.5), F.lit(1)).alias("v"), None),
        "interval": (F.expr("interval '1' day").alias("v"), None),
        "other schema": (k.cast("string").alias("v"), required),
    }
    run = {name: (lambda c=c, s=s, name=name: write(orders.select(c), work_path(spark, f"reject_{name.replace(' ', '_')}"), schema=s)) for name, (c, s) in cases.items()}
    return spark.createDataFrame(_rejections(run), "case_name string, error string")


@query("SELECT * FROM (VALUES ('repeated keys', 'CorruptFileError'), ('unknown column', 'InvalidFileError'), ('no table', 'InvalidFileError'), ('no engine', 'ReadEngineUnavailableError')) v(case_name, error)")
def read_rejections(spark, sf_dir):
    """What read() and its scan say to stored maps with repeated keys, unknown names, missing tables and engines."""
    maps = _stored_maps(spark, sf_dir)
    cases = {
        "repeated keys": lambda: Reader(read(spark, maps)).load_next(),
        "unknown column": lambda: read(spark, maps, [("M",)]),
        "no table": lambda: read(spark, work_path(spark, "nothing")),
        "no engine": lambda: read(spark, maps, options=ReadOptions(engine="HARDWOOD")),
    }
    return spark.createDataFrame(_rejections(cases), "case_name string, error string")


#: Arrow types with what the contract stores for them; rejected ones have no physical type.
_ARROW = """
('null', 'INT32', 'UNKNOWN'), ('bool', 'BOOLEAN', ''), ('int8', 'INT32', 'INT(8,true)'), ('uint8', 'INT32', 'INT(8,false)'), ('int16', 'INT32', 'INT(16,true)'), ('uint16', 'INT32', 'INT(16,false)'),
('int32', 'INT32', 'INT(32,true)'), ('uint32', 'INT32', 'INT(32,false)'), ('int64', 'INT64', 'INT(64,true)'), ('uint64', 'INT64', 'INT(64,false)'), ('float', 'FLOAT', ''), ('double', 'DOUBLE', ''), ('halffloat', '', ''),
('string', 'BINARY', 'STRING'), ('large_string', 'BINARY', 'STRING'), ('string_view', 'BINARY', 'STRING'), ('binary', 'BINARY', ''), ('large_binary', 'BINARY', ''), ('binary_view', 'BINARY', ''), ('fixed_size_binary[4]', 'FIXED(4)', ''),
('decimal128(9, 2)', 'INT32', 'DECIMAL(9,2)'), ('decimal128(18, 0)', 'INT64', 'DECIMAL(18,0)'), ('decimal128(38, 2)', 'FIXED(16)', 'DECIMAL(38,2)'), ('decimal256(76, 3)', 'FIXED(32)', 'DECIMAL(76,3)'), ('date32[day]', 'INT32', 'DATE'), ('date64[ms]', 'INT32', 'DATE'),
('time32[s]', 'INT32', 'TIME(MILLIS,true)'), ('time32[ms]', 'INT32', 'TIME(MILLIS,true)'), ('time64[us]', 'INT64', 'TIME(MICROS,true)'), ('time64[ns]', 'INT64', 'TIME(NANOS,true)'), ('timestamp[s]', 'INT64', 'TIMESTAMP(MILLIS,false)'),
('timestamp[ms]', 'INT64', 'TIMESTAMP(MILLIS,false)'), ('timestamp[us, tz=UTC]', 'INT64', 'TIMESTAMP(MICROS,true)'), ('timestamp[ns, tz=UTC]', 'INT64', 'TIMESTAMP(NANOS,true)'), ('duration[ns]', 'INT64', ''), ('month_day_nano_interval', '', '')
"""


@query(f"SELECT * FROM (VALUES {_ARROW}) v(arrow, physical, annotation)")
def arrow_type_contract(spark, sf_dir):
    """How every Arrow type without children is stored, or that it is rejected."""
    import pyarrow as pa

    kinds = [
        pa.null(), pa.bool_(), pa.int8(), pa.uint8(), pa.int16(), pa.uint16(), pa.int32(), pa.uint32(), pa.int64(), pa.uint64(), pa.float32(), pa.float64(), pa.float16(), pa.string(), pa.large_string(), pa.string_view(),
        pa.binary(), pa.large_binary(), pa.binary_view(), pa.binary(4), pa.decimal128(9, 2), pa.decimal128(18, 0), pa.decimal128(38, 2), pa.decimal256(76, 3), pa.date32(), pa.date64(), pa.time32("s"), pa.time32("ms"), pa.time64("us"), pa.time64("ns"),
        pa.timestamp("s"), pa.timestamp("ms"), pa.timestamp("us", "UTC"), pa.timestamp("ns", "UTC"), pa.duration("ns"), pa.month_day_nano_interval(),
    ]
    rows = []
    for kind in kinds:
        try:
            rows.append((str(kind), *arrow_primitive(kind)))
        except UnsupportedTypeError:
            rows.append((str(kind), "", ""))
    return spark.createDataFrame(rows, "arrow string, physical string, annotation string")


@query("""
SELECT * FROM (VALUES ('k', 'INT64', ''), ('lines', 'GROUP', 'LIST'), ('lines.list.element', 'GROUP', ''), ('lines.list.element.number', 'INT32', ''), ('lines.list.element.attributes', 'GROUP', 'MAP'),
('lines.list.element.attributes.key_value.key', 'BINARY', 'STRING'), ('lines.list.element.attributes.key_value.value', 'INT64', ''), ('price', 'FIXED(9)', 'DECIMAL(20,2)'), ('day', 'INT32', 'DATE'), ('at', 'INT64', 'TIMESTAMP(MICROS,true)')) v(path, physical, annotation)
""")
def stored_contract(spark, sf_dir):
    """The schema of a written file, read back from its footer."""
    lines = _lists(spark, sf_dir).select(
        F.col("l_orderkey").alias("k"),
        F.transform("lines", lambda x: F.struct(x["l_linenumber"].alias("number"), F.create_map(F.lit("part"), x["l_partkey"]).alias("attributes"))).alias("lines"),
        F.col("l_orderkey").cast("decimal(20,2)").alias("price"), F.lit("2024-01-01").cast("date").alias("day"), F.timestamp_seconds(F.lit(0)).alias("at"),
    )
    path = work_path(spark, "stored")
    write(lines.limit(100), path)
    footer = read_footer(spark, part_files(spark, path)[0])
    return spark.createDataFrame([(x.path, x.physical, x.annotation) for x in stored_schema(footer)], "path string, physical string, annotation string")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS priority, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS status FROM orders")
def dictionary_nested(spark, sf_dir):
    """Arrow dictionaries inside a list and a struct, with null indexes of one and two bytes, decoded at the boundary."""
    import pyarrow as pa

    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")

    def code(batches):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            names = [None if k % 11 == 0 else x for k, x in zip(keys, batch.column(1).to_pylist(), strict=True)]
            states = [None if k % 11 == 0 else x for k, x in zip(keys, batch.column(2).to_pylist(), strict=True)]
            coded = pa.DictionaryArray.from_arrays(*_coded(names, pa.int8()))
            inner = pa.StructArray.from_arrays([pa.DictionaryArray.from_arrays(*_coded(states, pa.uint16()))], ["status"])
            one = pa.ListArray.from_arrays(pa.array(range(len(keys) + 1), pa.int32()), coded)
            made = pa.table({"o_orderkey": batch.column(0), "priorities": one, "state": inner})
            yield from decoded_table(made).to_batches()

    df = rows.mapInArrow(code, "o_orderkey long, priorities array<string>, state struct<status:string>")
    return round_trip(df, "nested_codes").select("o_orderkey", F.col("priorities")[0].alias("priority"), "state.status")


def _coded(values: list, kind):
    import pyarrow as pa

    names = sorted({v for v in values if v is not None})
    return pa.array([None if v is None else names.index(v) for v in values], kind), pa.array(names, pa.string())
