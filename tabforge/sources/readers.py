"""File scans (S1-S4) and the NaN -> NULL ingest rule.

``load_data`` dispatches on the suffix like a pandas loader would, but
every format is a Spark reader: files are split across tasks and filters
and projections reach the scan.  A missing path or an unsupported suffix
gives ``None`` instead of raising, which is what the layer jobs expect.
"""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_table

SUPPORTED = (".csv", ".json", ".parquet", ".zip")
_ARCHIVE_MEMBERS = (".csv", ".json", ".parquet")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every float column (pandas treats both as
    missing; Spark keeps them apart).  Applied once, at ingest."""
    floats = [f.name for f in df.schema.fields
              if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not floats:
        return df
    return df.withColumns({c: F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c)) for c in floats})


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the path (or any match of a glob) is there, asked of the file
    system that Spark reads from."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


CORRUPT = "_corrupt"


def _with_corrupt(schema: T.StructType | str) -> T.StructType:
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if CORRUPT in schema.fieldNames():
        return schema
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             **options) -> DataFrame:
    """CSV with a header.  With a schema, a malformed row (a value of the
    wrong type, too few or too many fields) keeps its text in the extra
    column ``_corrupt``, which is NULL for good rows."""
    r = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if schema is not None:
        # a pruned scan would not parse, and so not check, the other fields
        r = (r.schema(_with_corrupt(schema)).option("columnNameOfCorruptRecord", CORRUPT)
             .option("columnPruning", False))
    else:
        r = r.option("inferSchema", True)
    for k, v in options.items():
        r = r.option(k, v)
    return r.csv(path)


def read_json_lines(spark: SparkSession, path: str,
                    schema: T.StructType | str | None = None, **options) -> DataFrame:
    """JSON lines.  With a schema, a line that is not such an object keeps
    its text in ``_corrupt``."""
    r = spark.read
    if schema is not None:
        r = r.schema(_with_corrupt(schema)).option("columnNameOfCorruptRecord", CORRUPT)
    for k, v in options.items():
        r = r.option(k, v)
    return r.json(path)


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows without the column, malformed rows): together all rows of
    a scan with a schema.  The parsed rows are written once; both halves read
    that table."""
    parsed = write_table(df, "parsed")
    return parsed.where(F.col(CORRUPT).isNull()).drop(CORRUPT), parsed.where(F.col(CORRUPT).isNotNull())


def _first_member(names: list[str]) -> str | None:
    for n in names:
        if n.lower().endswith(_ARCHIVE_MEMBERS):
            return n
    return None


def _read_member(data: bytes, name: str) -> pd.DataFrame:
    buf = io.BytesIO(data)
    low = name.lower()
    if low.endswith(".csv"):
        return pd.read_csv(buf)
    if low.endswith(".json"):
        return pd.read_json(buf, lines=True)
    return pd.read_parquet(buf)


def read_zip(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Archive scan: for every ``.zip`` under ``path`` the *first* supported
    member is read.  One archive per task (``binaryFile`` rows), member rows
    are yielded in Arrow batches under ``schema``.

    Without a schema it is taken from the first archive's member (read on
    the driver, one file), then applied to all archives.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.zip")
             .option("recursiveFileLookup", True).load(path))
    if schema is None:
        first = files.select("content").limit(1).collect()
        if not first:
            return None
        with zipfile.ZipFile(io.BytesIO(first[0]["content"])) as z:
            member = _first_member(z.namelist())
            if member is None:
                return None
            sample = _read_member(z.read(member), member)
        schema = spark.createDataFrame(sample.head(1000)).schema
    names = [f.name for f in schema.fields]

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for blob in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(blob)) as z:
                    member = _first_member(z.namelist())
                    if member is None:
                        continue
                    out = _read_member(z.read(member), member)
                for c in names:
                    if c not in out.columns:
                        out[c] = None
                yield out[names]

    return files.select("content").repartition(
        max(1, files.rdd.getNumPartitions())).mapInPandas(extract, schema)


def load_data(spark: SparkSession, path: str, schema=None, **options) -> DataFrame | None:
    """Read ``path`` by suffix (csv / json lines / parquet / zip).

    Returns ``None`` when the path does not exist, the suffix is not
    supported, or the read fails (the caller routes that to quarantine).
    With a schema, malformed rows end the job, unless the schema has the
    column ``_corrupt`` to keep them in.
    """
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in SUPPORTED or not _exists(spark, path):
        return None
    try:
        if suffix in (".csv", ".json"):
            if isinstance(schema, str):
                schema = T.StructType.fromDDL(schema)
            if schema is not None and CORRUPT not in schema.fieldNames():
                # the schema has no place for malformed rows: they end the read
                r = spark.read.schema(schema).options(header=True, mode="FAILFAST", **options)
                df = r.option("columnPruning", False).csv(path) if suffix == ".csv" else r.json(path)
            else:
                df = (read_csv if suffix == ".csv" else read_json_lines)(spark, path, schema, **options)
        elif suffix == ".parquet":
            df = spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
        else:
            df = read_zip(spark, path, schema)
            if df is None:
                return None
        return nan_to_null(df)
    except Exception:  # unreadable file -> None, like the layer contract says
        return None
