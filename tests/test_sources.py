import pytest
from pyspark.sql import functions as F

from gridledger.sources import delimited, packs, sinks
from gridledger.streaming import freshness


@pytest.mark.parametrize(
    "raw, want",
    [
        (b"a,b,c\n1,2,3\n", ("utf-8", ",")), (b"a;b\n1,5;2\n3,5;4\n", ("utf-8", ";")), (b"\xff\xfea\x00\t\x00b\x00\n\x00", ("utf-16le", "\t")), (b"\xef\xbb\xbfa|b\n", ("utf-8", "|")), (b"caf\xe9;x\n", ("windows-1252", ";")),
        (b'"a,b";c\n"d,e";f\n', ("utf-8", ";")), (b"plain\n", ("utf-8", ",")), (b"", ("utf-8", ",")), ("é".encode()[:1], ("utf-8", ",")),
    ],
)
def test_sniff(raw, want):
    assert delimited.sniff(raw) == want


def test_given_dialect_is_taken():
    assert delimited.sniff(b"a,b", "utf-16be", ";") == ("utf-16be", ";")


def test_read_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x;"y;\nz";""""\n1;2;\n')
    got = sorted((r.row_num, r.col_num, r.text) for r in delimited.read_cells(spark, str(tmp_path)).collect())
    assert got == [(1, 1, "x"), (1, 2, "y;\nz"), (1, 3, '"'), (2, 1, "1"), (2, 2, "2"), (2, 3, "")]


PACK = {"code": "quote", "version": "1.0", "fields": [{"key": "total", "path": "price.total", "path_root": "economic", "value_kind": "money", "required": True, "synonyms": ["gross total"]}], "tables": [{"name": "items", "fields": [{"key": "rate", "value_kind": "rate"}]}]}


def test_packs(spark):
    row = packs.fields(spark, [PACK]).first()
    assert (row.pack_code, row.key, row.value_kind, row.required, row.synonyms) == ("quote", "total", "money", True, ["gross total"])
    schema = packs.json_schema(PACK)
    assert schema["required"] == ["total"] and "rate" in schema["properties"]["items"]["items"]["properties"]
    bad = {"code": "", "version": "1", "fields": [{"key": "a", "value_kind": "guess", "path_root": "x"}, {"key": "a", "value_kind": "text"}]}
    assert len(packs.faults(bad)) == 4
    with pytest.raises(ValueError, match="unknown kind"):
        packs.fields(spark, [PACK, bad])


def test_replacing_writes_are_idempotent(spark, tmp_path):
    path = f"{tmp_path}/t"
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "run int, v string")
    for _ in range(2):
        sinks.replace_partitions(df, path, ["run"])
    sinks.replace_partitions(df.where("run = 1").limit(1).withColumn("v", F.lit("z")), path, ["run"])
    assert sorted((r.run, r.v) for r in spark.read.parquet(path).collect()) == [(1, "z"), (2, "c")]


def test_stale_snapshots_from_a_stream(spark, tmp_path):
    facts = f"{tmp_path}/facts"
    spark.createDataFrame([(1, 2), (3, 4)], "fact_id long, superseded_by long").write.parquet(facts)
    links = spark.createDataFrame([(10, 1), (10, 3), (11, 5)], "snapshot_id long, fact_id long")
    stream = spark.readStream.schema("fact_id long, superseded_by long").parquet(facts)
    for _ in range(2):  # nothing new the second time
        freshness.mark_stale(stream, links, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(60)
    got = [(r.snapshot_id, r.reason) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert got == [(10, "fact 1 superseded by 2; fact 3 superseded by 4")]


def test_latest_values_leave_out_late_rows(spark, tmp_path):
    path = f"{tmp_path}/e"
    spark.sql("select * from values ('a', timestamp '2024-01-01 10:00:00', 1), ('a', timestamp '2024-01-01 11:00:00', 2) as t(k, at, v)").write.parquet(path)
    s = freshness.latest_values(spark.readStream.schema("k string, at timestamp, v int").parquet(path), "k", "at", "v")
    q = s.writeStream.format("memory").queryName("latest_t").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.k, r.v) for r in spark.table("latest_t").collect()] == [("a", 2)]
