"""Numbers and dates as the fr_FR workbook source writes them, as columns.

Numbers have a decimal comma and spaces between groups of three digits (plain, no-break or
narrow no-break); dates are ``dd/MM/yyyy``, with ``HH:mm:ss`` behind a space where there is a
time.  Anything else becomes null, as in the other typed scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .csv import PANDAS_NA

_SPACES = " \u00a0\u202f"  # plain, no-break, narrow no-break
_NUMBER = rf"^\s*[+-]?(\d{{1,3}}([{_SPACES}]\d{{3}})+|\d+)(,\d*)?\s*$"
_DATE = (r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})"
         r"(?:[ T](\d{1,2}):(\d{1,2})(?::(\d{1,2}(?:\.\d{1,6})?))?)?\s*$")
_TIMES = (T.TimestampNTZType, T.TimestampType)
_WHOLE = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)


def parse_number(text: Column) -> Column:
    """``1 234,5`` as a double."""
    plain = F.translate(F.regexp_replace(text, rf"[\s{_SPACES}]", ""), ",", ".")
    return F.when(text.rlike(_NUMBER), plain.try_cast("double"))


def parse_date(text: Column) -> Column:
    """``31/12/2024`` or ``31/12/2024 23:59:58`` as TIMESTAMP_NTZ."""
    part = [F.regexp_extract(text, _DATE, i) for i in range(1, 7)]
    clock = [F.when(p == "", "0").otherwise(p) for p in part[3:]]
    return F.when(text.rlike(_DATE), F.try_make_timestamp_ntz(
        part[2].cast("int"), part[1].cast("int"), part[0].cast("int"),
        clock[0].cast("int"), clock[1].cast("int"), clock[2].cast("decimal(16,6)")))


def format_number(value: Column) -> Column:
    """A number with all its digits; ``parse_number`` reads back the same double if it has at
    most 18 decimal places and 20 whole digits (else null)."""
    digits = value.try_cast("decimal(38,18)").cast("string")
    whole = F.regexp_replace(F.substring_index(digits, ".", 1), r"(\d)(?=(\d{3})+$)",
                             "$1\u202f")
    rest = F.regexp_replace(F.regexp_extract(digits, r"\.(\d*)$", 1), r"0+$", "")
    return F.when(rest == "", whole).otherwise(F.concat(whole, F.lit(","), rest))


def format_date(value: Column) -> Column:
    """Date and time, with the fraction of a second if there is one."""
    text = F.date_format(value, "dd/MM/yyyy HH:mm:ss.SSSSSS")
    return F.when(text.endswith(".000000"), F.substring(text, 1, 19)).otherwise(
        F.regexp_replace(text, r"0+$", ""))


def read_csv_fr(spark: SparkSession, path: str | list[str], schema: T.StructType,
                sep: str = ";") -> DataFrame:
    """Typed scan of a ``;`` separated fr_FR file with a header."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    df = spark.read.schema(text).option("header", True).option("sep", sep).csv(path)
    cols = []
    for f in schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, _TIMES):
            c = parse_date(c).cast(f.dataType)
        elif isinstance(f.dataType, _WHOLE):
            c = F.regexp_replace(c, rf"[{_SPACES}]", "").try_cast(f.dataType)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = parse_number(c).cast(f.dataType)
        elif isinstance(f.dataType, T.StringType):
            c = F.when(~c.isin(*PANDAS_NA), c)
        else:
            c = c.try_cast(f.dataType)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def write_csv_fr(df: DataFrame, path: str, sep: str = ";") -> str:
    """The same form written, one header per file."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, _TIMES):
            c = format_date(c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = format_number(c)
        cols.append(c.cast("string").alias(f.name))
    (df.select(*cols).write.mode("overwrite").option("header", True).option("sep", sep)
     .option("encoding", "UTF-8").csv(path))
    return path
