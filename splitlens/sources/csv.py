"""Typed CSV scans and sinks.

The reference lets pandas infer types; here the caller passes a schema and a separator (or
leaves the separator to ``dialect``), so no pass over the data is spent on inference and a
bad value becomes null instead of changing a column's type.  Timestamps travel as
``yyyy-MM-dd HH:mm:ss`` text and are parsed into TIMESTAMP_NTZ with ``try_`` semantics
(bad text -> null, SURVEY T15) without involving the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TS_FORMAT = "yyyy-MM-dd HH:mm:ss"
# Text that pandas.read_csv reads as missing by default.
PANDAS_NA = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan",
             "null"]
_TS_PATTERN = (r"^\s*(\d{4})-(\d{1,2})-(\d{1,2})[ T](\d{1,2}):(\d{1,2}):(\d{1,2}(?:\.\d{1,6})?)"
               r"\s*$")


def parse_timestamp_ntz(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss[.ffffff]`` text -> TIMESTAMP_NTZ, anything else -> null."""
    part = [F.regexp_extract(text, _TS_PATTERN, i) for i in range(1, 7)]
    return F.when(text.rlike(_TS_PATTERN), F.try_make_timestamp_ntz(
        part[0].cast("int"), part[1].cast("int"), part[2].cast("int"),
        part[3].cast("int"), part[4].cast("int"), part[5].cast("decimal(16,6)")))


def read_csv_typed(spark: SparkSession, path: str | list[str], schema: T.StructType,
                   sep: str = ",", header: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """CSV scan with an explicit schema and separator.

    Timestamp fields of ``schema`` are read as text and parsed; text fields treat the
    pandas missing-value markers as null.  Files in UTF-16 are read whole, as their line ends
    cannot be told from bytes.
    """
    text_schema = T.StructType([
        T.StructField(f.name, T.StringType() if isinstance(
            f.dataType, (T.TimestampNTZType, T.TimestampType)) else f.dataType, True)
        for f in schema.fields])
    df = (spark.read.schema(text_schema).option("header", header).option("sep", sep)
          .option("mode", "PERMISSIVE").option("nanValue", "NaN")
          .option("encoding", encoding).option("multiLine", encoding.startswith("UTF-16"))
          .csv(path))
    cols = []
    for f in schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            c = parse_timestamp_ntz(c)
        elif isinstance(f.dataType, T.StringType):
            c = F.when(~c.isin(*PANDAS_NA), c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> str:
    """CSV with header and no index; timestamps written as ``yyyy-MM-dd HH:mm:ss``
    (fractions kept when present)."""
    cols = []
    for name, dtype in df.dtypes:
        c = F.col(name)
        if dtype.startswith("timestamp"):
            c = F.when(c.isNotNull(), F.regexp_replace(
                F.date_format(c, TS_FORMAT + ".SSSSSS"), r"\.?0+$", ""))
        cols.append(c.alias(name))
    (df.select(*cols).write.mode("overwrite").option("header", True).option("sep", sep)
     .option("encoding", "UTF-8").csv(path))
    return path
