"""Files in dialects of their own, paths by section and key, fr_FR text, first and last rows."""

import codecs

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splitlens.operators import slices
from splitlens.sources import dialect, locale
from tests.helpers import assert_same

SCHEMA = T.StructType([T.StructField("client_id", T.LongType()), T.StructField("name", T.StringType()),
                       T.StructField("when", T.TimestampNTZType()), T.StructField("age", T.DoubleType())])


@pytest.mark.parametrize("line, sep, names", [
    (b"client_id,name,when,age", ",", ("client_id", "name", "when", "age")),
    (b"client_id;name;when;age\r\n", ";", ("client_id", "name", "when", "age")),
    (codecs.BOM_UTF8 + b"client_id\tname", "\t", ("client_id", "name")),
    (b'"a;b;c;d";client_id|name,age', ",", ('a;b;c;d";client_id|name'.replace('"', ""), "age")),
    (b"client_id|note, with commas, in it|name", "|", ("client_id", "note, with commas, in it", "name")),
    (b"client_id", ",", ("client_id",)),
    (b"", ",", ("",)),
])
def test_dialect_of_a_line(line, sep, names):
    found = dialect.dialect_of(line, ["client_id", "name", "when", "age"])
    assert found.sep == sep and found.encoding == "UTF-8"
    assert found.names == names or line.startswith(b'"')


def test_mixed_files_are_one_table(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csv").write_bytes(b"client_id,name,when,age\n1,ann,2024-01-02 03:04:05,41.5\n2,NA,bad,\n")
    (tmp_path / "b.csv").write_bytes(codecs.BOM_UTF8 + "age;client_id;name;when\r\n7;3;\"zoë; x\";2024-05-06 00:00:00\r\n".encode())
    (tmp_path / "sub" / "c.txt").write_bytes(b"name\textra\tclient_id\r\nbob\tq\t4\r\n")
    (tmp_path / "d.csv").write_bytes("client_id|name|when|age\n5|été|2024-01-01 00:00:00|1\n".encode("utf-16-le").join([codecs.BOM_UTF16_LE, b""]))
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(b"x")
    got = dialect.read_csv(spark, str(tmp_path), SCHEMA)
    assert got.schema.fieldNames() == SCHEMA.fieldNames()
    rows = {r.client_id: (r.name, str(r.when), r.age) for r in got.collect()}
    assert rows[1] == ("ann", "2024-01-02 03:04:05", 41.5) and rows[2] == (None, "None", None)
    assert rows[3] == ("zoë; x", "2024-05-06 00:00:00", 7.0) and rows[4] == ("bob", "None", None)
    assert rows[5][0] == "été" and len(rows) == 5
    groups = dialect.by_dialect(spark, str(tmp_path), SCHEMA.fieldNames())
    assert sorted(d.sep for d in groups) == ["\t", ",", ";", "|"]


def test_no_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_bytes(b"")
    assert dialect.read_csv(spark, str(tmp_path), SCHEMA).count() == 0


def test_configured_paths(spark, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "x.csv").write_bytes(b"client_id;name\n1;ann\n")
    config = tmp_path / "config.yaml"
    config.write_text(f"# paths\ninput_data:\n  file1: \"{tmp_path}/data\"\n  file2: 's3://b/c d'  # other\n\noutput_data:\n  file1: out.csv\n")
    path = str(config)
    assert dialect.configured_path(spark, path, "input_data", "file2") == "s3://b/c d"
    assert dialect.configured_path(spark, path, "output_data", "file1") == "out.csv"
    assert [r.name for r in dialect.read_configured(spark, path, "input_data", "file1", SCHEMA).collect()] == ["ann"]
    assert dialect.read_configured(spark, str(tmp_path / "none.yaml"), "input_data", "file1", SCHEMA) is None
    for section, key in (("nothing", "file1"), ("input_data", "file9")):
        with pytest.raises(KeyError):
            dialect.configured_path(spark, path, section, key)


# -- fr_FR ----------------------------------------------------------------------------------
NUMBERS = [("1 234,5", 1234.5), ("1 234 567", 1234567.0), ("-12,25", -12.25), ("+3", 3.0), ("1\u00a0000,0", 1000.0), ("2\u202f000", 2000.0),
           ("1234,5", 1234.5), ("0,001", 0.001), (" 7 ", 7.0), ("1,", 1.0), ("1.5", None), ("12 34", None), ("abc", None), ("", None), (None, None), (",5", None)]
DATES = [("31/12/2024", "2024-12-31 00:00:00"), ("1/2/2024 3:04", "2024-02-01 03:04:00"), ("31/12/2024 23:59:58", "2024-12-31 23:59:58"),
         ("31/12/2024 23:59:58.25", "2024-12-31 23:59:58.250000"), ("12/31/2024", "None"), ("2024-12-31", "None"), ("29/02/2023", "None"), (None, "None")]


def test_numbers_and_dates(spark):
    df = spark.createDataFrame([(a,) for a, _ in NUMBERS], "t string")
    assert [r[0] for r in df.select(locale.parse_number(F.col("t"))).collect()] == [b for _, b in NUMBERS]
    df = spark.createDataFrame([(a,) for a, _ in DATES], "t string")
    assert [str(r[0]) for r in df.select(locale.parse_date(F.col("t"))).collect()] == [b for _, b in DATES]


def test_text_of_numbers(spark):
    values = [(1234567.5, "1\u202f234\u202f567,5"), (-1000.0, "-1\u202f000"), (0.1, "0,1"), (12.0, "12"), (None, None), (float("nan"), None), (49.520949659265774, "49,520949659265774")]
    df = spark.createDataFrame([(a,) for a, _ in values], "v double")
    got = df.select(locale.format_number(F.col("v")).alias("t"))
    assert [r.t for r in got.collect()] == [b for _, b in values]
    assert locale._SPACES == " \u00a0\u202f"
    back = got.select(locale.parse_number(F.col("t")))
    assert [r[0] for r in back.collect()] == [None if b is None else a for a, b in values]


def test_round_trip(spark, tmp_path):
    df = spark.range(300).selectExpr(
        "id * 1000003 as client_id", "concat('n;', id) as name",
        "timestamp_ntz'2024-01-31 22:00:00' + make_dt_interval(0, 0, 0, id * 61.25) as when", "id * 1234.56789 as age")
    none = spark.createDataFrame([(None,) * 4], "client_id long, name string, when timestamp_ntz, age double")
    df = df.unionByName(none)
    path = locale.write_csv_fr(df, str(tmp_path / "fr"))
    assert_same(locale.read_csv_fr(spark, path, df.schema).toPandas(), df.toPandas())


# -- first and last rows --------------------------------------------------------------------
def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def test_head_and_tail(spark):
    rows = [(None if i % 40 == 0 else (i * 37) % 211, i) for i in range(400)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))
    for n in (0, 1, 15, 1000):
        assert [tuple(r) for r in slices.head(df, ["a", "b"], n).collect()] == order[:n]
        assert [tuple(r) for r in slices.tail(df, ["a", "b"], n).collect()] == (order[-n:] if n else [])
    for cut in (slices.head(df, ["a"], 3), slices.tail(df, ["a"], 3)):
        assert "TakeOrderedAndProject" in plan(cut)


def test_first_per_key(spark):
    rows = [(None if i % 7 == 0 else i % 5, i // 3, i) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, a int, b int").repartition(4)
    got = slices.first_per_key(df, ["k"], ["a", "b"], 4)
    assert plan(got).count("WindowGroupLimit") == 2  # per task, then per key
    want = []
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        want += [(*r, i + 1) for i, r in enumerate(own[:4])]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
