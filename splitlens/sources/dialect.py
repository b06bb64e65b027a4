"""CSV scans that find out each file's dialect, and paths by section and key.

Files delivered together may differ in separator, byte-order mark, line ends and column order.
The first line of every file tells its dialect; it is one small read per file, made when the
scan is planned (like Spark's own file listing), by a few threads.  Files of one dialect are
then one typed scan, and the scans' rows are united by column name.  Line ends need no
option: the CSV reader takes LF, CRLF and CR.
"""

from __future__ import annotations

import csv as pycsv
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .csv import read_csv_typed

SEPARATORS = [",", ";", "\t", "|"]
MARKS = {b"\xef\xbb\xbf": "UTF-8", b"\xff\xfe": "UTF-16LE", b"\xfe\xff": "UTF-16BE"}
READERS = 16


@dataclass(frozen=True)
class Dialect:
    sep: str
    encoding: str
    names: tuple[str, ...]


def dialect_of(line: bytes, wanted: list[str] | None = None) -> Dialect:
    """The dialect that a first line tells: the separator that yields the most ``wanted`` names,
    then the most columns, then the first of ``SEPARATORS``.  Separators inside quotes do not
    count.  An empty line has one unnamed column."""
    encoding = "UTF-8"
    for mark, name in MARKS.items():
        if line.startswith(mark):
            line, encoding = line[len(mark):], name
    text = line.decode(encoding, "replace").rstrip("\r\n\x00")
    found = []
    for sep in SEPARATORS:
        names = tuple(n.strip() for n in next(pycsv.reader([text], delimiter=sep), None) or [""])
        known = sum(n in names for n in wanted or [])
        found.append(((known, len(names), -SEPARATORS.index(sep)), Dialect(sep, encoding, names)))
    return max(found, key=lambda x: x[0])[1]


def _first_line(spark: SparkSession, path: str) -> bytes:
    """The bytes up to the first line end, read through the file system that Spark uses."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    file = jvm.org.apache.hadoop.fs.Path(path)
    stream = file.getFileSystem(conf).open(file)
    try:
        line = stream.readLine()  # bytes as Latin-1 characters; None at the end of the file
        return (line or "").encode("latin-1")
    finally:
        stream.close()


def files_of(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The data files under ``path``; their contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return sorted(r.path for r in listed.where(F.col("length") > 0).select("path").collect())


def by_dialect(spark: SparkSession, path: str | list[str],
               wanted: list[str] | None = None) -> dict[Dialect, list[str]]:
    files = files_of(spark, path)
    with ThreadPoolExecutor(READERS) as pool:
        lines = list(pool.map(lambda f: _first_line(spark, f), files))
    groups: dict[Dialect, list[str]] = defaultdict(list)
    for file, line in zip(files, lines):
        groups[dialect_of(line, wanted)].append(file)
    return dict(groups)


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """All files under ``path`` as one table of ``schema``.  Columns are found by their names in
    each file's header, whatever their order; a column that a file lacks is null there, one
    that ``schema`` lacks is not returned.  Without any file the table is empty."""
    names = [f.name for f in schema.fields]
    types = {f.name: f.dataType for f in schema.fields}
    out = None
    for dialect, files in by_dialect(spark, path, names).items():
        header = [n if n in types and n not in dialect.names[:i] else f"_unread_{i}"
                  for i, n in enumerate(dialect.names)]
        own = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in header])
        part = read_csv_typed(spark, files, own, sep=dialect.sep, encoding=dialect.encoding)
        absent = {n: F.lit(None).cast(types[n]) for n in names if n not in header}
        part = part.withColumns(absent).select(*names)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


# -- paths by section and key ---------------------------------------------------------------
def _sections(text: str) -> dict[str, dict[str, str]]:
    """Two levels of ``name:`` and ``key: value`` lines, values bare or in quotes."""
    out: dict[str, dict[str, str]] = {}
    section = None
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip() if not line.lstrip().startswith("#") else ""
        if not body.strip():
            continue
        name, _, value = body.strip().partition(":")
        if not body[0].isspace():
            section = out.setdefault(name.strip(), {})
        elif section is not None:
            section[name.strip()] = value.strip().strip("'\"")
    return out


def configured_path(spark: SparkSession, config: str, section: str, key: str) -> str | None:
    """The path that ``config`` (any path Spark reads) has under ``section`` and ``key``.  None
    without the config file; a missing section or key is a ``KeyError``."""
    try:
        text = spark.read.text(config, wholetext=True).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return _sections(text[0] if text else "")[section][key]


def read_configured(spark: SparkSession, config: str, section: str, key: str,
                    schema: T.StructType) -> DataFrame | None:
    """The table whose path the config names, each file in its own dialect."""
    path = configured_path(spark, config, section, key)
    return None if path is None else read_csv(spark, path, schema)
