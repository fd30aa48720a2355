"""Types, projection, values and errors of the contract."""

import os
import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paraforge import errors as E
from paraforge.functions import conversions as C
from paraforge.functions.levels import flat_levels, level_faults, list_levels
from paraforge.operators import dictionary, diff
from paraforge.operators.batches import bounded_batches
from paraforge.operators.validate import check, contract_rules, enforced, violations
from paraforge.plans.projection import field_path, project
from paraforge.sources import Reader, ReadOptions, WriteOptions, file_facts, read, write
from paraforge.sources.reader import refine, require
from paraforge.sources.writer import Writer
from paraforge.types import decimal_physical, min_decimal_bytes, stored_columns


def ddl(text):
    return T._parse_datatype_string(text)


def test_decimals():
    assert [decimal_physical(p) for p in (1, 9, 10, 18, 19, 38)] == ["INT32", "INT32", "INT64", "INT64", "FIXED(9)", "FIXED(16)"]
    assert min_decimal_bytes(76) == 32
    for p, s in ((39, 0), (10, -1), (5, 6)):
        with pytest.raises(E.UnsupportedTypeError):
            decimal_physical(p, s)


@pytest.mark.parametrize(("schema", "path"), [
    (T.StructType([T.StructField("x", T.IntegerType()), T.StructField("x", T.IntegerType())]), "x"),
    (T.StructType([T.StructField("s", T.StructType([T.StructField("x", T.IntegerType()), T.StructField("x", T.IntegerType())]))]), "s.x"),
    (T.StructType([T.StructField("a", T.ArrayType(T.StructType([T.StructField("x", T.IntegerType()), T.StructField("x", T.IntegerType())])))]), "a.list.element.x"),
])
def test_duplicate_names(schema, path):
    with pytest.raises(E.UnsupportedTypeError, match=f"{path}: duplicate field name cannot round-trip through Parquet"):
        stored_columns(schema)


@pytest.mark.parametrize("kind", ["struct<>", "interval day to second"])
def test_rejected_types(spark, kind):
    with pytest.raises(E.UnsupportedTypeError):
        stored_columns(T.StructType([T.StructField("c", T.StructType([]) if kind == "struct<>" else ddl(kind))]))


def test_variant_storage(spark):
    good = ddl("struct<metadata:binary,value:binary>")
    assert stored_columns(T.StructType([T.StructField("v", good, True, {"variant": True})]))[0].annotation == "VARIANT(1)"
    for bad in ("struct<value:binary>", "struct<metadata:binary>", "struct<metadata:string,value:binary>", "struct<metadata:binary,value:binary,x:int>"):
        with pytest.raises(E.UnsupportedTypeError):
            stored_columns(T.StructType([T.StructField("v", ddl(bad), True, {"variant": True})]))


def test_projection(spark):
    df = spark.createDataFrame([(1, (2, (3, "x")), [1], {"a": 1}), (2, None, None, None)], "a int, s struct<p:int,q:struct<u:int,v:string>>, xs array<int>, m map<string,int>")
    assert project(df, ["xs", "a"]).columns == ["a", "xs"]
    narrow = project(df, [("s", "q", "v"), ("s", "nothing")])
    assert narrow.schema["s"].dataType.simpleString() == "struct<q:struct<v:string>>"
    assert [r["s"] is None for r in narrow.collect()] == [False, True]
    assert project(df, [("s",), ("s", "p")]).schema["s"].dataType == df.schema["s"].dataType
    assert project(df, [("m", "value", "x")]).columns == ["m"]
    for bad in ([("b",)], [("A",)], [("a", "x")], [("s", "nothing")]):
        with pytest.raises(E.InvalidFileError):
            project(df, bad)
    with pytest.raises(ValueError):
        field_path()


def test_empty_column_name(spark, tmp_path):
    df = spark.createDataFrame([(7, 42)], T.StructType([T.StructField("", T.IntegerType()), T.StructField("b", T.IntegerType())]))
    write(df, str(tmp_path / "t"))
    assert read(spark, str(tmp_path / "t")).collect() == [(7, 42)]


def test_nested_states(spark, tmp_path):
    rows = [(1, None, None, None), (2, [], {}, (None,)), (3, [None, 7], {"a": None, "b": 2}, (9,))]
    df = spark.createDataFrame(rows, "k int, xs array<int>, m map<string,int>, s struct<x:int>")
    write(df, str(tmp_path / "t"))
    back = read(spark, str(tmp_path / "t"))
    assert diff.compare(df, back, "k") == []
    events = list_levels(back, "k", "xs").orderBy("k", "rl").collect()
    assert [(r["row_boundary"], r["rl"], r["dl"], r["present"], r["value"]) for r in events] == [(True, 0, 0, False, None), (True, 0, 1, False, None), (True, 0, 2, False, None), (False, 1, 3, True, 7)]
    assert level_faults(list_levels(back, "k", "xs"), 3).count() == 0
    assert [r["dl"] for r in flat_levels(back.select("k", F.col("s.x").alias("x")), "k", "x").orderBy("k").collect()] == [0, 0, 1]


@pytest.mark.parametrize("codec", ["UNCOMPRESSED", "ZSTD", "SNAPPY", "GZIP"])
@pytest.mark.parametrize("version", ["V1", "V2"])
def test_codecs_and_pages(spark, tmp_path, codec, version):
    df = spark.range(100).select("id", F.when(F.col("id") % 5 != 0, F.col("id").cast("string")).alias("t"))
    write(df, str(tmp_path / "t"), WriteOptions(compression=codec, page_version=version))
    facts = file_facts(spark, str(tmp_path / "t"))
    assert {c for f in facts for c in f.codecs} == {codec}
    assert diff.compare(df, read(spark, str(tmp_path / "t")), "id") == []


def test_row_groups_and_statistics(spark, tmp_path):
    df = spark.range(5).coalesce(1)
    write(df, str(tmp_path / "t"), WriteOptions(row_group_rows=2))
    assert file_facts(spark, str(tmp_path / "t"))[0].groups == (2, 2, 1)
    two = spark.range(5).select("id", F.col("id").alias("u")).coalesce(1)
    write(two, str(tmp_path / "u"), WriteOptions(without_statistics=("u",)))
    assert file_facts(spark, str(tmp_path / "u"))[0].with_statistics == 1


def test_options_and_lifecycle(spark, tmp_path):
    with pytest.raises(E.CodecUnavailableError):
        WriteOptions(compression="LZ4")
    with pytest.raises(E.ReadEngineUnavailableError):
        read(spark, str(tmp_path), options=ReadOptions(engine="HARDWOOD"))
    with pytest.raises(ValueError):
        ReadOptions(batch_rows=0)
    writer = Writer(str(tmp_path / "t"))
    with pytest.raises(E.UnsupportedTypeError):
        writer.write_all(spark.range(1).select(F.expr("interval '1' day").alias("n")))  # nothing was written: still usable
    assert sum(f.rows for f in writer.write_all(spark.range(3))) == 3
    with pytest.raises(OSError):
        writer.write_all(spark.range(3))
    again = Writer(str(tmp_path / "t"))
    for _ in range(2):  # found before anything is written, so it aborts nothing
        with pytest.raises(E.PathExistsError):
            again.write_all(spark.range(1))


def test_input_schema(spark, tmp_path):
    df = spark.range(1)
    with pytest.raises(E.InputSchemaMismatchError):
        write(df, str(tmp_path / "a"), schema=ddl("struct<id:int>"))
    write(df, str(tmp_path / "b"), schema=ddl("struct<id:bigint>"))
    with pytest.raises(E.InputSchemaMismatchError):
        write(df, str(tmp_path / "c"), WriteOptions(strict_schema=True), schema=ddl("struct<id:bigint>"))


def corrupted(spark, tmp_path, change):
    df = spark.range(257).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("t")).coalesce(1)
    write(df, str(tmp_path / "t"), WriteOptions(compression="UNCOMPRESSED", dictionary=False))
    (file,) = [f for f in os.listdir(tmp_path / "t") if f.endswith(".parquet")]
    data = bytearray((tmp_path / "t" / file).read_bytes())
    change(data)
    os.makedirs(tmp_path / "bad")
    (tmp_path / "bad" / "x.parquet").write_bytes(bytes(data))
    return str(tmp_path / "bad")


def test_truncated_and_bad_footer(spark, tmp_path):
    path = corrupted(spark, tmp_path, lambda d: d.__delitem__(slice(len(d) // 2, None)))
    with pytest.raises(E.InvalidFileError):
        read(spark, path)
    shutil.rmtree(tmp_path / "t"), shutil.rmtree(tmp_path / "bad")
    path = corrupted(spark, tmp_path, lambda d: d.__setitem__(slice(-8, -4), b"\xff" * 4))
    with pytest.raises(E.InvalidFileError):
        read(spark, path)


def test_every_footer_is_checked(spark, tmp_path, monkeypatch):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from pyspark.sql import SparkSession

    from paraforge.sources import footer
    from paraforge.sources.footer import preflight

    texts = [f"prefix {i // 3} {i}" for i in range(2000)]
    table = pa.table({"s": texts})
    for part, encoding in ((0, "PLAIN"), (1, "DELTA_BYTE_ARRAY")):
        pq.write_table(table, tmp_path / f"part-{part}.parquet", compression="none", use_dictionary=False, column_encoding={"s": encoding}, data_page_version="2.0")
    for files in (64, 1):  # by the driver, and by executors
        monkeypatch.setattr(footer, "FILES_FOR_A_JOB", files)
        assert preflight(spark, str(tmp_path)).delta_strings
    df = read(spark, str(tmp_path))
    assert sorted(r["s"] for r in df.join(spark.range(1), F.lit(True)).collect()) == sorted(2 * texts)
    assert spark.conf.get("spark.sql.parquet.enableVectorizedReader") == "true" and SparkSession.active() is spark
    assert "vectorized" not in str(df.schema) and spark.range(3).count() == 3
    (tmp_path / "part-1.parquet").unlink()
    assert not preflight(spark, str(tmp_path)).delta_strings
    pq.write_table(pa.table({"s": pa.array([0], pa.timestamp("us"))}), tmp_path / "part-2.parquet", use_deprecated_int96_timestamps=True)
    for files in (64, 1):
        monkeypatch.setattr(footer, "FILES_FOR_A_JOB", files)
        with pytest.raises(E.UnsupportedTypeError, match="INT96"):
            preflight(spark, str(tmp_path))


def test_partitioned_tables(spark, tmp_path):
    spark.range(20).select("id", (F.col("id") % 3).alias("k"), F.concat(F.lit("a "), F.col("id")).alias("v.w")).write.partitionBy("k").parquet(str(tmp_path / "t"))
    assert read(spark, str(tmp_path / "t")).groupBy("k").count().count() == 3
    (tmp_path / "t" / "k=1" / "broken.parquet").write_bytes(b"PAR1 nothing PAR1")
    with pytest.raises(E.InvalidFileError):
        read(spark, str(tmp_path / "t"))
    with pytest.raises(E.InvalidFileError):
        read(spark, str(tmp_path / "no such table"))


@pytest.mark.parametrize(("message", "what"), [
    ("message m { optional int64 d (DATE); }", None), ("message m { optional int32 d (DATE); }", ""), ("message m { optional int32 t (TIME(MILLIS,true)); }", ""),
    ("message m { optional int64 x (DECIMAL(18,2)); }", ""), ("message m { optional fixed_len_byte_array(9) x (DECIMAL(21,2)); }", ""),
])
def test_pairs_in_files(spark, tmp_path, message, what):
    """Parquet's own parser refuses some pairs; the check is tested on nodes for those."""
    from paraforge.sources.footer import read_footer, verdict

    if what is None:
        with pytest.raises(Exception):
            foreign(spark, tmp_path, message, lambda g: None)
    else:
        path = foreign(spark, tmp_path, message, lambda g: None)
        verdict(read_footer(spark, f"{path}/x.parquet"))


@pytest.mark.parametrize("bad", [
    dict(physical="INT32", annotation="STRING"), dict(physical="INT64", annotation="DATE"), dict(physical="INT64", annotation="INT(8,true)"), dict(physical="INT32", annotation="INT(64,true)"),
    dict(physical="INT32", annotation="TIME(MICROS,true)"), dict(physical="INT32", annotation="TIMESTAMP(MILLIS,true)"), dict(physical="INT32", annotation="DECIMAL", precision=10), dict(physical="INT64", annotation="DECIMAL", precision=19),
    dict(physical="FIXED_LEN_BYTE_ARRAY", length=8, annotation="DECIMAL", precision=19), dict(physical="BINARY", annotation="DECIMAL", precision=5), dict(physical="INT32", annotation="DECIMAL", precision=5, scale=6),
    dict(physical="INT96"), dict(physical="FIXED_LEN_BYTE_ARRAY", length=16, annotation="UUID"), dict(physical="FIXED_LEN_BYTE_ARRAY", length=2, annotation="FLOAT16"), dict(physical="BINARY", annotation="BSON"),
    dict(physical="FIXED_LEN_BYTE_ARRAY", length=12, annotation="INTERVAL"), dict(physical="INT32", annotation="UNKNOWN", repetition="REQUIRED"),
])
def test_physical_types_and_annotations(bad):
    from paraforge.sources.footer import check_pair
    from paraforge.sources.footerbytes import Node

    with pytest.raises(E.UnsupportedTypeError):
        check_pair(Node(**{"name": "x", "repetition": "OPTIONAL", **bad}), "x")


def test_footer_facts_are_those_of_arrow(spark, tmp_path):
    import pyarrow.parquet as pq

    df = spark.range(5000).select("id", F.concat(F.lit("t"), F.col("id")).alias("t"), F.array("id").alias("xs"), F.create_map(F.lit("a"), F.col("id")).alias("m"), F.lit(1).cast("decimal(20,3)").alias("d")).coalesce(1)
    write(df, str(tmp_path / "t"), WriteOptions(row_group_rows=2000, compression="ZSTD"))
    (facts,) = file_facts(spark, str(tmp_path / "t"))
    theirs = pq.read_metadata(facts.path.removeprefix("file:"))
    assert (facts.rows, facts.columns, facts.created_by) == (theirs.num_rows, theirs.num_columns, theirs.created_by)
    assert facts.groups == tuple(theirs.row_group(i).num_rows for i in range(theirs.num_row_groups))
    chunks = [theirs.row_group(i).column(j) for i in range(theirs.num_row_groups) for j in range(theirs.num_columns)]
    assert facts.bytes == sum(c.total_compressed_size for c in chunks) and facts.with_statistics == sum(c.statistics is not None for c in chunks)
    assert set(facts.codecs) == {c.compression for c in chunks}


def test_narrow_integers_are_not_cut(spark, tmp_path):
    def fill(g):
        g.add("s8", 300)
        xs = g.addGroup("xs").addGroup("list")
        xs.add("element", 70000)

    message = "message m { optional int32 s8 (INTEGER(8,true)); optional group xs (LIST) { repeated group list { optional int32 element (INTEGER(16,false)); } } }"
    path = foreign(spark, tmp_path, message, fill)
    for names in (["s8"], ["xs"]):
        reader = Reader(read(spark, path, names))
        with pytest.raises(E.MetadataSchemaMismatchError, match=names[0]):
            reader.load_next()
    good = spark.createDataFrame([(1, -128, [7], {3: 4}, (5,)), (2, None, None, None, None)], "k int, b tinyint, xs array<smallint>, m map<tinyint,smallint>, s struct<x:tinyint>")
    write(good, str(tmp_path / "good"))
    back = read(spark, str(tmp_path / "good"))
    assert back.schema.simpleString() == good.schema.simpleString() and diff.compare(good, back, "k") == []


def test_stored_maps(spark, tmp_path):
    def fill(g):
        m = g.addGroup("m")
        for v in (1, 2):
            kv = m.addGroup("key_value")
            kv.add("key", "same")
            kv.add("value", v)

    path = foreign(spark, tmp_path, "message m { optional group m (MAP) { repeated group key_value { required binary key (STRING); optional int32 value; } } }", fill)
    reader = Reader(read(spark, path))
    with pytest.raises(E.CorruptFileError):
        reader.load_next()
    floats = spark.createDataFrame([({},)], "m map<float,int>")
    write(floats, str(tmp_path / "empty"))
    assert read(spark, str(tmp_path / "empty")).first()["m"] == {}
    with pytest.raises(E.InvalidValueError):
        write(spark.createDataFrame([({1.5: 1},)], "m map<float,int>"), str(tmp_path / "full"))
    assert not (tmp_path / "full").exists() or not list((tmp_path / "full").glob("*.parquet"))


@pytest.mark.parametrize(("rows", "kind", "metadata", "rule"), [
    ([(b"\xc3\x28",)], "binary", None, "UTF-8"), ([(b"abc",)], "binary", {"fixed_width": 4}, "4 bytes"), ([([1, 2],)], "array<int>", {"fixed_size": 3}, "3 elements"),
    ([(86400,)], "int", {"time_unit": "s"}, "time of day"), ([(-1,)], "bigint", {"time_unit": "ns"}, "time of day"), ([(86_400_000_000,)], "bigint", {"time_unit": "us"}, "time of day"),
])
def test_values_are_checked_on_writing(spark, tmp_path, rows, kind, metadata, rule):
    df = spark.createDataFrame(rows, f"v {kind}")
    df = df.select(F.expr("cast(v as string)").alias("v")) if rule == "UTF-8" else df.withMetadata("v", metadata)
    for nested in (False, True):
        data = df.select(F.struct("v").alias("s")) if nested else df
        with pytest.raises(E.InvalidValueError, match=rule):
            write(data, str(tmp_path / f"t{nested}"))
        with pytest.raises(E.PathExistsError if (tmp_path / f"t{nested}").exists() else E.InvalidFileError):
            write(spark.range(1), str(tmp_path / f"t{nested}")) if (tmp_path / f"t{nested}").exists() else read(spark, str(tmp_path / f"t{nested}"))


def test_required_values_are_checked_on_writing(spark, tmp_path):
    """A required child may be missing where what holds it is; a null that can be reached is not written."""
    wanted = T.StructType([T.StructField("s", T.StructType([T.StructField("v", T.IntegerType(), False)])), T.StructField("xs", T.ArrayType(T.IntegerType(), False))])
    good = spark.createDataFrame([(None, None), ((1,), [1]), ((2,), [])], "s struct<v:int>, xs array<int>")
    write(good, str(tmp_path / "good"), schema=wanted)
    for i, row in enumerate((((None,), [1]), ((1,), [1, None]))):
        with pytest.raises(E.InvalidValueError, match="required"):
            write(spark.createDataFrame([row], "s struct<v:int>, xs array<int>"), str(tmp_path / f"bad{i}"), schema=wanted)


def test_columns_of_nulls(spark, tmp_path):
    df = spark.range(3).select("id", F.lit(None).alias("n"))
    assert [(s.physical, s.annotation) for s in stored_columns(df.schema)][1] == ("BOOLEAN", "UNKNOWN")
    write(df, str(tmp_path / "t"))
    back = read(spark, str(tmp_path / "t"))
    assert back.schema["n"].dataType == T.NullType() and back.where("n is null").count() == 3
    with pytest.raises(E.UnsupportedTypeError):
        stored_columns(T.StructType([T.StructField("n", T.NullType(), False)]))


def test_shredded_variants(spark, tmp_path):
    """A variant whose values are stored beside it is carried; its footer passes the check; wrong shapes do not."""
    from paraforge.sources.footer import read_footer, verdict

    spark.conf.set("spark.sql.variant.writeShredding.enabled", "true")
    try:
        spark.range(9).select(F.parse_json(F.concat(F.lit('{"a": '), F.col("id"), F.lit("}"))).alias("v")).coalesce(1).write.parquet(str(tmp_path / "t"))
    finally:
        spark.conf.unset("spark.sql.variant.writeShredding.enabled")
    (file,) = (tmp_path / "t").glob("*.parquet")
    footer = read_footer(spark, f"file://{file}")
    assert "typed_value" in {c.name for c in footer.schema.children[0].children}
    verdict(footer)
    assert [r[0] for r in read(spark, str(tmp_path / "t")).select(F.variant_get("v", "$.a", "int")).collect()] == list(range(9))
    footer.schema.children[0].annotation = "VARIANT"
    for broken in (lambda own: own.pop(0), lambda own: own.append(own[0].__class__("more", "OPTIONAL", "INT32")), lambda own: setattr(own[0], "physical", "INT32")):
        copy = read_footer(spark, f"file://{file}")
        copy.schema.children[0].annotation = "VARIANT"
        own = copy.schema.children[0].children
        own.sort(key=lambda c: c.name)
        broken(own)
        with pytest.raises(E.UnsupportedTypeError):
            verdict(copy)


def test_writer_lifecycle(spark, tmp_path):
    import pyarrow as pa

    table = pa.table({"a": pa.array([1, 2, 3], pa.uint32()), "t": pa.array([0, 1, 86399], pa.time32("s")), "s": pa.array(["x", "y", "x"]).dictionary_encode(), "u": pa.array([1 << 63, 0, None], pa.uint64()), "f": pa.array([b"ab", b"cd", None], pa.binary(2))})
    with Writer(str(tmp_path / "t"), spark=spark) as writer:
        writer.write_batch(table.slice(0, 2))
        writer.flush_row_group()
        writer.flush_row_group()
        writer.write_batch(pa.RecordBatchReader.from_batches(table.schema, table.slice(2).to_batches()))
        with pytest.raises(E.InputSchemaMismatchError):
            writer.write_batch(spark.range(1))
    facts = writer.finish()
    assert facts == writer.finish() and sum(f.rows for f in facts) == 3 and sum(len(f.groups) for f in facts) >= 2
    writer.close()
    with pytest.raises(OSError, match="closed"):
        writer.write_batch(table)
    back = read(spark, str(tmp_path / "t")).orderBy("a")
    assert [(r["a"], r["t"], r["s"], r["u"] if r["u"] is None else int(r["u"])) for r in back.collect()] == [(1, 0, "x", 1 << 63), (2, 1000, "y", 0), (3, 86399000, "x", None)]
    assert back.schema["t"].metadata == {"time_unit": "ms"} and back.schema["f"].metadata == {"fixed_width": 2}
    bad = Writer(str(tmp_path / "bad"), spark=spark)
    bad.write_batch(spark.createDataFrame([(99_999,)], "v int").withMetadata("v", {"time_unit": "s"}))
    with pytest.raises(E.InvalidValueError):
        bad.flush_row_group()
    for use in (bad.flush_row_group, bad.finish):
        with pytest.raises(E.WriterAbortedError):
            use()
    bad.close()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]
    empty = Writer(str(tmp_path / "empty"), schema=ddl("struct<a:int,b:string>"), spark=spark)
    empty.close()
    assert read(spark, str(tmp_path / "empty")).columns == ["a", "b"] and sum(f.rows for f in empty.finish()) == 0
    with pytest.raises(ZeroDivisionError), Writer(str(tmp_path / "left"), spark=spark) as left:
        left.write_batch(table)
        left.flush_row_group()
        raise ZeroDivisionError
    assert not (tmp_path / "left").exists()
    with pytest.raises(E.UnsupportedTypeError):
        Writer(str(tmp_path / "no"), spark=spark).write_batch(pa.table({"h": pa.array([1.0], pa.float32()).cast(pa.float16())}))


def test_flipped_bit_fails_and_poisons(spark, tmp_path):
    def flip(data):
        data[len(data) // 3] ^= 0x80

    path = corrupted(spark, tmp_path, flip)
    reader = Reader(read(spark, path))
    with pytest.raises(E.CorruptFileError):
        while reader.load_next():
            pass
    with pytest.raises(E.ReaderPoisonedError):
        reader.load_next()


def test_reader_batches(spark):
    df = spark.createDataFrame([("one",), ("two",), ("x" * 128,)], "s string").coalesce(1)
    reader = Reader(df, ReadOptions(batch_rows=99, max_variable_bytes=1))
    sizes = []
    while reader.load_next():
        sizes.append(reader.batch.num_rows)
    assert sizes == [1, 1, 1] and not reader.load_next() and reader.rows == 3
    nested = spark.createDataFrame([(1, ["first"]), (2, ["second"])], "k int, xs array<string>").coalesce(1)
    assert {(r["batch"], r["bytes"]) for r in bounded_batches(nested, 99, 1, "k").collect()} == {(0, 5), (1, 6)}
    assert bounded_batches(spark.range(10).coalesce(1), 4, 100, "id").select("batch").distinct().count() == 3


def test_values(spark):
    df = spark.createDataFrame([(0, 0, -128), (1, 1700000000, 300), (2, -62135596800, None), (3, None, 127)], "k int, s long, i int")
    assert [r[0] for r in df.orderBy("k").select(C.timestamp_seconds_to_millis(F.col("s"))).collect()] == [0, 1700000000000, -62135596800000, None]
    over = spark.createDataFrame([((1 << 63) // 1000 + 1,)], "s long")
    assert not over.select(C.timestamp_seconds_ok(F.col("s"))).first()[0]
    with pytest.raises(Exception, match="overflows"):
        over.select(C.timestamp_seconds_to_millis(F.col("s"))).collect()
    assert [r["k"] for r in violations(df, "k", {"int8": C.int_ok(F.col("i"), 8, True)}).collect()] == [1]
    with pytest.raises(E.InvalidValueError):
        check(df, "k", {"int8": C.int_ok(F.col("i"), 8, True)})
    with pytest.raises(Exception, match="rule int8 is broken"):
        enforced(df, {"int8": C.int_ok(F.col("i"), 8, True)}).collect()
    days = spark.createDataFrame([(86400000,), (86400001,), (-86400000,)], "ms long")
    assert [r[0] for r in days.select(C.date64_ok(F.col("ms"))).collect()] == [True, False, True]
    maps = spark.sql("select map('a', 1, 'b', 2) m")
    assert maps.select(C.map_ok(F.col("m"))).first()[0]


def test_unsigned(spark):
    df = spark.createDataFrame([(-1,), (5,)], "b long")
    assert [str(r[0]) for r in df.select(C.unsigned_widen(F.col("b"), 64)).collect()] == [str((1 << 64) - 1), "5"]
    assert [r[0] for r in df.select(C.unsigned_widen(F.col("b"), 32)).collect()] == [(1 << 32) - 1, 5]


def test_required(spark):
    df = spark.createDataFrame([(1, None), (2, (42,)), (3, (None,))], "k int, s struct<v:int>")
    assert [r["k"] for r in violations(df, "k", {"v": C.required_ok(F.col("s"), F.col("s.v"))}).collect()] == [3]
    with pytest.raises(Exception):
        require(spark.createDataFrame([(None,)], "v int"), T.StructType([T.StructField("v", T.IntegerType(), False)])).collect()
    assert refine(spark.range(1), {"id": {"unit": "ns"}}).schema["id"].metadata == {"unit": "ns"}


def test_dictionary(spark):
    values = spark.createDataFrame([(0, "red"), (1, "green"), (2, "blue")], "code int, value string")
    coded = spark.createDataFrame([(1, 0), (2, 2), (3, 0), (4, None)], "k int, code int")
    assert [r["value"] for r in dictionary.decode_checked(coded, values, "code", "value").orderBy("k").collect()] == ["red", "blue", "red", None]
    with pytest.raises(E.InvalidValueError):
        dictionary.decode_checked(spark.createDataFrame([(1, 9)], "k int, code int"), values, "code", "value")


def test_differences(spark):
    a = spark.createDataFrame([(1, float("nan"), [1]), (2, 0.0, [1, 2])], "k int, x double, xs array<int>")
    b = spark.createDataFrame([(1, float("nan"), None), (2, -0.0, [1, 3])], "k int, x double, xs array<int>")
    assert diff.compare(a, a, "k") == []
    assert diff.compare(a, b, "k") == [("LOGICAL_VALUES", "x", "1 rows"), ("LOGICAL_VALUES", "xs", "1 rows"), ("NULL_EMPTY_NESTED_SHAPE", "xs", "1 rows")]
    assert diff.compare(a, a.limit(1), "k")[0][0] == "LOGICAL_VALUES"
    assert diff.compare(a, a.withColumnRenamed("x", "y"), "k")[0][0] == "SCHEMA"
    assert diff.compare(a, a.withMetadata("x", {"a": 1}), "k")[0][0] == "FIELD_METADATA"


def foreign(spark, tmp_path, message, fill):
    """A file written by Parquet's own example writer, not by Spark."""
    jvm = spark._jvm
    schema = jvm.org.apache.parquet.schema.MessageTypeParser.parseMessageType(message)
    os.makedirs(tmp_path / "f", exist_ok=True)
    path = jvm.org.apache.hadoop.fs.Path(f"file://{tmp_path}/f/x.parquet")
    writer = jvm.org.apache.parquet.hadoop.example.ExampleParquetWriter.builder(path).withType(schema).build()
    group = jvm.org.apache.parquet.example.data.simple.SimpleGroupFactory(schema).newGroup()
    fill(group)
    writer.write(group)
    writer.close()
    return str(tmp_path / "f")


def test_list_encodings(spark, tmp_path):
    def two(g):
        xs = g.addGroup("my_list")
        xs.add("element", 4)
        xs.add("element", 5)

    path = foreign(spark, tmp_path, "message m { optional group my_list (LIST) { repeated int32 element; } }", two)
    assert read(spark, path).first()["my_list"] == [4, 5]


@pytest.mark.parametrize(("message", "reason"), [
    ("message m { repeated int32 num; }", "UNANNOTATED_REPEATED at num"),
    ("message m { optional group a (MAP) { repeated group kv { optional binary key (STRING); optional int32 value; } } }", "OPTIONAL_KEY"),
    ("message m { optional group a (MAP) { repeated group kv { required binary key (STRING); } } }", "KEY_ONLY"),
    ("message m { optional group a (MAP) { repeated group kv { required binary key (STRING); optional int32 v; optional int32 w; } } }", "EXTRA_ENTRY_FIELDS"),
])
def test_rejected_encodings(spark, tmp_path, message, reason):
    path = foreign(spark, tmp_path, message, lambda g: None)
    with pytest.raises(E.UnsupportedNestedEncodingError, match=reason):
        read(spark, path)


@pytest.mark.parametrize("message", ["message m { optional int96 t; }", "message m { optional binary j (JSON); }", "message m { optional binary e (ENUM); }"])
def test_rejected_annotations(spark, tmp_path, message):
    path = foreign(spark, tmp_path, message, lambda g: None)
    with pytest.raises(E.UnsupportedTypeError):
        read(spark, path)


def test_property_round_trip(spark, tmp_path):
    import random

    for seed in (0x0175EED, 0x1A2B3C4D):
        r = random.Random(seed)
        maybe = lambda x, r=r: None if r.random() < 0.2 else x
        rows = [(i, maybe(r.random() < 0.5), maybe(r.randint(-(2**31), 2**31 - 1)), maybe("☃" * r.randint(0, 5))) for i in range(257)]
        df = spark.createDataFrame(rows, "k int, flag boolean, id int, text string")
        write(df, str(tmp_path / str(seed)))
        assert diff.compare(df, read(spark, str(tmp_path / str(seed))), "k") == []


def brute_levels(kind, value, steps, defined=0, depth=0, required=False):
    """[(rl, dl, value)] of a value towards a leaf."""
    here = defined if required else defined + 1
    if value is None:
        return [(0, defined, None)]
    if isinstance(kind, T.StructType):
        return brute_levels(kind[steps[0]].dataType, value[steps[0]], steps[1:], here, depth)
    if isinstance(kind, T.ArrayType | T.MapType):
        if not value:
            return [(0, here, None)]
        out = []
        side = steps[1] if isinstance(kind, T.MapType) else ""
        inner = kind.elementType if not side else kind.keyType if side == "key" else kind.valueType
        for i, x in enumerate(value if not side else value.keys() if side == "key" else value.values()):
            own = brute_levels(inner, x, steps[2:], here + 1, depth + 1, side == "key")
            out += [(depth + 1 if i and not j else own[j][0], *own[j][1:]) for j in range(len(own))]
        return out
    return [(0, here, value)]


def test_nested_levels(spark):
    import random

    from paraforge.functions.levels import leaves, nested_levels

    r = random.Random(5)
    maybe = lambda make: None if r.random() < 0.25 else make()
    number = lambda: maybe(lambda: r.randint(0, 99))
    inner = lambda: maybe(lambda: {"a": number(), "xs": maybe(lambda: [number() for _ in range(r.randint(0, 3))])})
    kind = "array<struct<a:int,xs:array<int>>>"
    rows = [(i, maybe(lambda: [inner() for _ in range(r.randint(0, 3))]), maybe(lambda: {f"k{j}": maybe(lambda: [number() for _ in range(r.randint(0, 2))]) for j in range(r.randint(0, 3))}), maybe(lambda: {"s": maybe(lambda: {"t": number()})})) for i in range(60)]
    df = spark.createDataFrame(rows, f"k int, c {kind}, m map<string,array<int>>, s struct<s:struct<t:int>>")
    for column, at in (("c", 1), ("m", 2), ("s", 3)):
        got = {}
        for e in nested_levels(df, "k", column).orderBy("k", "leaf", "at").collect():
            got.setdefault((e["k"], e["leaf"]), []).append((e["rl"], e["dl"], e["value"]))
            assert e["row_boundary"] == (e["rl"] == 0)
        for leaf in leaves(df.schema[column]):
            for row in rows:
                expected = [(x, d, None if v is None else str(v)) for x, d, v in brute_levels(df.schema[column].dataType, row[at], leaf.path.split(".")[1:])]
                assert got[row[0], leaf.path] == expected, (leaf, row)
    assert {x.path: (x.most_defined, x.most_repeated) for c in "cms" for x in leaves(df.schema[c])} == {"c.list.element.a": (4, 1), "c.list.element.xs.list.element": (6, 2), "m.key_value.key": (2, 1), "m.key_value.value.list.element": (5, 2), "s.s.t": (3, 0)}


def test_levels_are_those_of_the_file(spark, tmp_path):
    """The number of events of each leaf is the number of values that the footer counts for its column."""
    import pyarrow.parquet as pq

    from paraforge.functions.levels import nested_levels

    df = spark.createDataFrame([(1, [{"a": [1, 2]}, None, {"a": []}]), (2, None), (3, [])], "k int, c array<struct<a:array<int>>>").coalesce(1)
    write(df, str(tmp_path / "t"))
    (file,) = (tmp_path / "t").glob("*.parquet")
    group = pq.read_metadata(file).row_group(0)
    stored = {group.column(i).path_in_schema: group.column(i).num_values for i in range(group.num_columns)}
    for leaf, n in {r["leaf"]: r["n"] for r in nested_levels(df, "k", "c").groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}.items():
        assert stored[leaf] == n


def test_nested_differences(spark):
    kinds = "k int, xs array<double>, s struct<m:map<string,double>>, d array<map<int,int>>, `a.b` double"
    a = spark.createDataFrame([(1, [0.0, float("nan")], ({"x": 0.0, "y": 1.0},), [{1: 2}], 0.0), (2, None, (None,), [], 1.0)], kinds)
    b = spark.createDataFrame([(1, [-0.0, float("nan")], ({"x": -0.0, "y": 1.0},), [{1: 3}], -0.0), (2, None, (None,), [], 1.0)], kinds)
    assert diff.compare(a, a, "k") == []
    assert diff.compare(a, b, "k") == [("LOGICAL_VALUES", x, "1 rows") for x in ("a.b", "d", "s", "xs")]
    c = a.withColumn("s", F.when(F.col("k") == 1, F.struct(F.create_map(F.lit("y"), F.lit(1.0), F.lit("x"), F.lit(0.0)).alias("m"))).otherwise(F.col("s")))
    assert [x[:2] for x in diff.compare(a, c, "k")] == [("NULL_EMPTY_NESTED_SHAPE", "s")]


def brute_shape(kind, x):
    if x is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(brute_shape(f.dataType, x[f.name]) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return [brute_shape(kind.elementType, v) for v in x]
    return [(k, brute_shape(kind.valueType, v)) for k, v in x.items()] if isinstance(kind, T.MapType) else "+"


def brute_values(x):
    if isinstance(x, dict):
        return [(k, brute_values(v)) for k, v in x.items()]
    return [brute_values(v) for v in x] if isinstance(x, list | tuple) else repr(x)


def test_nested_values_are_compared_without_texts_of_their_shape(spark):
    import random

    r = random.Random(11)
    maybe = lambda make: None if r.random() < 0.25 else make()
    number = lambda: maybe(lambda: r.choice([0.0, -0.0, float("nan"), 1.5]))
    pairs = lambda make: dict(r.sample([(k, make()) for k in "abc"], r.randint(0, 3)))
    value = lambda: (maybe(lambda: [number() for _ in range(r.randint(0, 2))]), maybe(lambda: [maybe(lambda: pairs(lambda: maybe(lambda: [number()]))) for _ in range(r.randint(0, 2))]), maybe(lambda: (number(), maybe(lambda: pairs(number)))))
    xs, ys = [(i, *value()) for i in range(300)], []
    for row in xs:
        other = value()
        ys.append((row[0], *[a if r.random() < 0.5 else b for a, b in zip(row[1:], other, strict=True)]))
    kinds = "k int, xs array<double>, maps array<map<string,array<double>>>, s struct<x:double,m:map<string,double>>"
    a, b = (spark.createDataFrame(rows, kinds) for rows in (xs, ys))
    found = diff.compare_values(a, b, "k")
    expected = []
    for x, y in zip(a.orderBy("k").collect(), b.orderBy("k").collect(), strict=True):
        for f in a.schema.fields[1:]:
            if brute_shape(f.dataType, x[f.name]) != brute_shape(f.dataType, y[f.name]):
                expected.append((x["k"], f.name, "NULL_EMPTY_NESTED_SHAPE"))
            elif brute_values(x[f.name]) != brute_values(y[f.name]):
                expected.append((x["k"], f.name, "LOGICAL_VALUES"))
    assert len({e[2] for e in expected}) == 2
    assert sorted((e["k"], e["path"], e["dimension"]) for e in found.collect()) == sorted(expected)
    assert "array_join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_shape_keeps_to_the_text_of_keys(spark):
    """Keys whose JSON is equal have one shape, as timestamps of one millisecond, so that they differ by value; other types are compared as before."""
    m = lambda key: spark.sql(f"SELECT 1 AS k, map({key}, 1) AS m")
    told = lambda x, y: [e[0] for e in diff.compare_values(m(x), m(y), "k").collect()]
    assert told("TIMESTAMP'2020-01-01 00:00:00.000001'", "TIMESTAMP'2020-01-01 00:00:00.000002'") == ["LOGICAL_VALUES"]
    assert told("TIMESTAMP'2020-01-01 00:00:00'", "TIMESTAMP'2020-01-01 00:00:01'") == ["NULL_EMPTY_NESTED_SHAPE"]
    assert told("'a' COLLATE UTF8_LCASE", "'A' COLLATE UTF8_LCASE") == ["NULL_EMPTY_NESTED_SHAPE"]
    assert told("1.0BD", "1.00BD") == ["NULL_EMPTY_NESTED_SHAPE"]
    single = [spark.sql(f"SELECT 1 AS k, CAST(0.1 AS {kind}) AS x") for kind in ("double", "float")]
    assert [e[0] for e in diff.compare_values(single[0], single[1], "k").collect()] == ["LOGICAL_VALUES"]


def test_values_are_made_once_for_all_their_rules(spark, tmp_path):
    k = F.col("id")
    df = spark.range(10).select("id", F.array(F.create_map(F.concat(F.lit("made"), k.cast("string")), k)).alias("maps"))
    plan = enforced(df, contract_rules(df.schema))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat(made") == 1
    write(df, str(tmp_path / "t"))
    assert diff.compare(df, read(spark, str(tmp_path / "t")), "id") == []


@pytest.mark.parametrize("value, path", [("array(h, t)", "v.element"), ("array(null, t)", "v.element"), ("array(map('a', 1), map(h, 2))", "v.element.key"), ("map(1, array(struct(t AS s)))", "v.value.element.s"), ("struct(array(array('a'), array(h)) AS x)", "v.x.element.element")])
def test_nested_strings_are_utf8(spark, tmp_path, value, path):
    """A character cut in two is no string, even where its halves lie side by side."""
    parts = spark.range(1).select(F.lit(bytearray(b"\xe2\x98")).cast("string").alias("h"), F.lit(bytearray(b"\x83")).cast("string").alias("t"))
    with pytest.raises(E.InvalidValueError, match=f"rule {path} is UTF-8 is broken"):
        write(parts.selectExpr(f"{value} AS v"), str(tmp_path / "t"))
    good = spark.range(1).select(F.lit("☃").alias("h"), F.lit("").alias("t")).selectExpr(f"{value} AS v")
    write(good, str(tmp_path / "good"))


def test_rows_are_aligned_by_number_and_repeated_keys(spark):
    a = spark.range(100).select((F.col("id") % 7).alias("v")).repartition(1).selectExpr("v")
    assert diff.compare(a, a.coalesce(1)) == []
    x = spark.createDataFrame([(i // 2, i) for i in range(40)], "k int, v int").coalesce(1)
    y = spark.createDataFrame([(i // 2, -1 if i == 17 else i) for i in range(40)], "k int, v int").coalesce(1)
    assert [tuple(r) for r in diff.compare_values(x, y).collect()] == [("LOGICAL_VALUES", "v", 17)]
    assert [r["row"] for r in diff.numbered(spark.range(50).repartition(5)).orderBy("row").collect()] == list(range(50))
    assert diff.compare_values(x, x, "k").count() == 0
    assert diff.compare_values(x, y, "k").count() >= 1
    missing = diff.compare_values(x, x.where("v <> 5"), "k")
    assert {r["k"] for r in missing.collect()} == {2}
    nulls = spark.createDataFrame([(None, 1), (3, 2)], "k int, v int")
    assert diff.compare(nulls, nulls, "k") == []


def test_schema_hints(spark, tmp_path):
    import base64

    import pyarrow as pa
    import pyarrow.parquet as pq

    from paraforge.sources import hints

    schema = pa.schema([pa.field("t", pa.timestamp("us", "Europe/Paris"), metadata={"note": "local"}), pa.field("s", pa.large_string()), pa.field("xs", pa.list_(pa.int32()))])
    assert hints.decode(hints.encode(schema)).equals(schema, check_metadata=True)
    pq.write_table(pa.table({"t": pa.array([0], schema.field(0).type), "s": pa.array(["x"], pa.large_string()), "xs": pa.array([[1]], schema.field(2).type)}, schema=schema), tmp_path / "a.parquet")
    back = hints.refined(read(spark, str(tmp_path / "a.parquet")), spark, str(tmp_path / "a.parquet"))
    assert back.schema["t"].metadata == {"note": "local", "zone": "Europe/Paris"} and back.schema["s"].metadata == {"arrow": "large_string"} and not back.schema["xs"].metadata
    assert back.first()["s"] == "x"
    renamed = back.withColumnRenamed("t", "u").withMetadata("s", {"arrow": "own"})
    assert hints.advice(renamed.schema, schema).keys() == {"s"} and hints.advice(back.drop("s").schema, schema) == {}
    deep = pa.int32()
    for _ in range(70):
        deep = pa.list_(deep)
    for bad in (pa.schema([("d", deep)]), pa.schema([(f"c{i}", pa.int8()) for i in range(10_001)])):
        with pytest.raises(E.MetadataLimitError):
            hints.encode(bad)
        with pytest.raises(E.MetadataLimitError):
            hints.decode(base64.b64encode(bad.serialize().to_pybytes()).decode())
    with pytest.raises(E.MetadataLimitError):
        hints.decode("A" * (hints.MAX_ENCODED + 4))
    with pytest.raises(E.MetadataLimitError):
        hints.decode(base64.b64encode(bytes(hints.MAX_DECODED + 3)).decode())
    one = schema.serialize().to_pybytes()
    for broken in ("no base64!", base64.b64encode(b"nothing").decode(), base64.b64encode(one + one).decode(), ""):
        with pytest.raises(ValueError):
            hints.decode(broken)
    spark.range(1).write.parquet(str(tmp_path / "plain"))
    assert hints.hint_of(spark, str(tmp_path / "plain")) is None


def test_manifest_of_files(spark, tmp_path):
    import hashlib

    from paraforge.sources.manifest import check_manifest, file_manifest

    spark.range(100).repartition(3).write.parquet(str(tmp_path / "t"))
    made = file_manifest(spark, str(tmp_path / "t"))
    expected = {(p.name, p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in (tmp_path / "t").glob("*.parquet")}
    assert {(r["file"], r["bytes"], r["sha256"]) for r in made.collect()} == expected
    kept = spark.createDataFrame(made.collect(), made.schema)
    check_manifest(spark, str(tmp_path / "t"), kept)
    for side in (tmp_path / "t").glob(".*.crc"):
        side.unlink()
    next((tmp_path / "t").glob("*.parquet")).write_bytes(b"changed")
    with pytest.raises(E.InvalidFileError, match="part-"):
        check_manifest(spark, str(tmp_path / "t"), kept)


def test_nested_dictionaries(spark, tmp_path):
    import pyarrow as pa

    from paraforge.sources.writer import decoded_table

    words = pa.DictionaryArray.from_arrays(pa.array([0, None, 1, 0], pa.int16()), pa.array(["a", "b"]))
    lists = pa.array([["a"], None, ["b", None], []], pa.list_(pa.dictionary(pa.int8(), pa.string())))
    maps = pa.array([[("k", "x")], None, [], [("k", None)]], pa.map_(pa.string(), pa.dictionary(pa.uint8(), pa.string())))
    structs = pa.StructArray.from_arrays([words], ["w"], mask=pa.array([False, False, True, False]))
    table = pa.table({"w": words, "l": lists, "m": maps, "s": structs})
    assert decoded_table(table).to_pylist() == table.to_pylist()
    assert decoded_table(table.slice(1, 2)).to_pylist() == table.slice(1, 2).to_pylist()
    write(table, str(tmp_path / "t"), spark=spark)
    back = [(r["w"], r["l"], r["m"], r["s"] and r["s"]["w"]) for r in read(spark, str(tmp_path / "t")).collect()]
    assert sorted(back, key=repr) == sorted([("a", ["a"], {"k": "x"}, "a"), (None, None, None, None), ("b", ["b", None], {}, None), ("a", [], {"k": None}, "a")], key=repr)
    bad = pa.DictionaryArray.from_arrays(pa.array([0, 9], pa.int8()), pa.array(["a"]), safe=False)
    with pytest.raises(E.InvalidValueError):
        write(pa.table({"w": bad}), str(tmp_path / "bad"), spark=spark)


@pytest.mark.parametrize("make", [
    lambda pa: pa.schema([("s", pa.struct([]))]), lambda pa: pa.schema([("x", pa.int8()), ("x", pa.int8())]), lambda pa: pa.schema([("h", pa.list_(pa.float16()))]),
    lambda pa: pa.schema([("u", pa.dense_union([pa.field("a", pa.int8())]))]), lambda pa: pa.schema([("r", pa.run_end_encoded(pa.int32(), pa.string()))]), lambda pa: pa.schema([("v", pa.list_view(pa.int8()))]),
])
def test_arrow_types_outside_the_contract(make):
    import pyarrow as pa

    from paraforge.types import arrow_columns

    with pytest.raises(E.UnsupportedTypeError):
        arrow_columns(make(pa))


def test_arrow_schema_as_stored():
    import pyarrow as pa

    from paraforge.types import arrow_columns

    schema = pa.schema([pa.field("m", pa.map_(pa.string(), pa.list_(pa.dictionary(pa.int8(), pa.string())))), pa.field("f", pa.list_(pa.int32(), 2), nullable=False)])
    assert [(s.path, s.physical, s.annotation, s.nullable) for s in arrow_columns(schema)] == [
        ("m", "GROUP", "MAP", True), ("m.key_value.key", "BINARY", "STRING", False), ("m.key_value.value", "GROUP", "LIST", True), ("m.key_value.value.list.element", "BINARY", "STRING", True),
        ("f", "GROUP", "LIST", False), ("f.list.element", "INT32", "INT(32,true)", True),
    ]


def test_times_of_day_and_nanoseconds(spark, tmp_path):
    """What Spark infers no type for is read as integers with their unit, also inside lists, and checked."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from paraforge.sources.footer import read_footer, spark_schema

    table = pa.table({"a": pa.array([0, 86_399_999], pa.time32("ms")), "b": pa.array([1, None], pa.time64("us")), "c": pa.array([[2], [3, None]], pa.list_(pa.time64("ns"))), "n": pa.array([5, 6], pa.timestamp("ns")), "u": pa.array([200, 7], pa.uint8()), "f": pa.array([b"ab", b"cd"], pa.binary(2)), "k": [1, 2]})
    pq.write_table(table, tmp_path / "good.parquet", version="2.6")
    back = read(spark, str(tmp_path / "good.parquet"))
    assert [tuple(r) for r in back.orderBy("k").collect()] == [(0, 1, [2], 5, 200, b"ab", 1), (86_399_999, None, [3, None], 6, 7, b"cd", 2)]
    assert [back.schema[c].metadata for c in "abn"] == [{"time_unit": "ms"}, {"time_unit": "us"}, {"unit": "ns"}] and read(spark, str(tmp_path / "good.parquet"), ["a", "k"]).columns == ["a", "k"]
    write(back, str(tmp_path / "again"))
    assert diff.compare(back, read(spark, str(tmp_path / "again")), "k") == []
    for i, (message, name, value) in enumerate((("optional int32 t (TIME(MILLIS,true))", "t", 86_400_000), ("optional int64 t (TIME(NANOS,true))", "t", 86_400_000_000_000))):
        path = foreign(spark, tmp_path / str(i), f"message m {{ {message}; }}", lambda g, value=value: g.add("t", value))
        reader = Reader(read(spark, path))
        with pytest.raises(E.MetadataSchemaMismatchError, match=name):
            reader.load_next()
    own = spark.createDataFrame([], "b tinyint, s smallint, i int, l bigint, f float, d double, t string, y binary, da date, ts timestamp, tn timestamp_ntz, x decimal(20,3), a array<struct<p:int>>, m map<string,array<int>>, bo boolean")
    write(own, str(tmp_path / "types"))
    (file,) = (tmp_path / "types").glob("*.parquet")
    assert spark_schema(read_footer(spark, f"file://{file}")).simpleString() == own.schema.simpleString()
