from pyspark.sql import functions as F

from lineagram.functions import scalars as s


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "v string").select(f(F.col("v")).alias("x")).first().x


def test_counts(spark):
    for text, want in (("12", 12), (" 3.9 ", 3), ("-1", None), ("-0.5", 0), ("true", None), ("", None), (None, None), ("1e3", 1000)):
        assert value(spark, text, s.to_nonneg_int) == want, text


def test_bytes(spark):
    row = spark.createDataFrame([("5", "7", None, "9", "4")], "sent_bytes string, recv_bytes string, write_bytes string, read_bytes string, size string")
    fields = {c: F.col(c) for c in row.columns}
    assert row.select(s.extract_bytes(fields, ["size"]).alias("x")).first().x == 12
    assert row.drop("recv_bytes").select(s.extract_bytes({c: F.col(c) for c in row.columns if c != "recv_bytes"}, ["size"]).alias("x")).first().x == 4


def test_timestamps(spark):
    for text in ("1700000000", "1700000000000", "1700000000000000", "1700000000000000000", "2023-11-14T22:13:20Z"):
        assert str(value(spark, text, lambda c: F.date_format(s.parse_ts(c), "yyyy-MM-dd HH:mm:ss"))) == "2023-11-14 22:13:20"
    assert value(spark, "soon", s.parse_ts) is None


def test_names_and_shapes(spark):
    assert value(spark, '"C:\\Windows\\System32\\CMD.exe"', s.basename) == "cmd.exe"
    assert value(spark, " Spawned_By ", s.canonical_relation) == "spawn"
    assert value(spark, "/usr/lib/x.TAR.gz", s.file_shape) == "ext=.gz;dir_level=2;topdir=usr"
    assert value(spark, ".bashrc", s.file_shape) == "ext=(none);dir_level=0;topdir=(root)"
    assert value(spark, "10.1.2.3:443", s.ip_shape) == "subnet=10.1.2.0/24"
    assert value(spark, "10.1.2.300", s.ip_shape) == "subnet=invalid"
    assert value(spark, "hklm\\Software\\Run\\x", s.registry_shape) == "hive=HKLM;key=software\\run"
    assert value(spark, "web:abc", s.entity_shape) == "len=3"
    assert value(spark, "High", s.stage_severity) == 8.0 and value(spark, None, s.stage_severity) == 2.0
