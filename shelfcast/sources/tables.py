"""CSV tables with declared schemas, and the submission sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DateType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from shelfcast.sources.scratch import stored


def _schema(**fields) -> StructType:
    return StructType([StructField(name, kind()) for name, kind in fields.items()])


SCHEMAS = {
    "train": _schema(
        id=LongType, date=DateType, store_nbr=IntegerType, family=StringType, sales=DoubleType, onpromotion=LongType
    ),
    "test": _schema(id=LongType, date=DateType, store_nbr=IntegerType, family=StringType, onpromotion=LongType),
    "stores": _schema(store_nbr=IntegerType, city=StringType, state=StringType, type=StringType, cluster=IntegerType),
    "oil": _schema(date=DateType, dcoilwtico=DoubleType),
    "holidays_events": _schema(
        date=DateType,
        type=StringType,
        locale=StringType,
        locale_name=StringType,
        description=StringType,
        transferred=BooleanType,
    ),
    "transactions": _schema(date=DateType, store_nbr=IntegerType, transactions=LongType),
}


MALFORMED = "_malformed"  # the whole line of a row that does not fit the schema


def _reader(spark: SparkSession, mode: str):
    options = {"header": True, "dateFormat": "yyyy-MM-dd", "mode": mode, "columnNameOfCorruptRecord": MALFORMED}
    return spark.read.options(**options)


def _path(directory: str, name: str) -> str:
    return f"{directory.rstrip('/')}/{name}.csv"


def read_table(
    spark: SparkSession, directory: str, name: str, schema: StructType | None = None, malformed: str = "fail"
) -> DataFrame:
    """Scan ``<directory>/<name>.csv`` (a file or a folder of part files) with a header.

    The schema is declared, never inferred, so the scan costs one pass and prunes unused columns; NaN is read
    as NULL.  A value that does not fit its column, or a row with too few or too many values, ends the job
    (``malformed="fail"``; only columns that are used are looked at) or makes the values NULL (``"null"``).
    ``read_checked`` sets such rows aside instead.
    """
    modes = {"fail": "FAILFAST", "null": "PERMISSIVE"}
    if malformed not in modes:
        raise ValueError(f"malformed must be one of {sorted(modes)}")
    return nan_to_null(_reader(spark, modes[malformed]).schema(schema or SCHEMAS[name]).csv(_path(directory, name)))


def read_checked(
    spark: SparkSession, directory: str, name: str, schema: StructType | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows that fit the schema, rows that do not), the latter with their line in ``_malformed``.

    The file is parsed once, all columns of it, and both parts are read from the stored result.
    """
    wanted = schema or SCHEMAS[name]
    whole = StructType([*wanted.fields, StructField(MALFORMED, StringType())])
    parsed = stored(_reader(spark, "PERMISSIVE").schema(whole).csv(_path(directory, name)), f"parsed-{name}")
    good = parsed.filter(F.col(MALFORMED).isNull()).drop(MALFORMED)
    return nan_to_null(good), parsed.filter(F.col(MALFORMED).isNotNull())


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers as NULL, so that aggregates skip them."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def parse_date(df: DataFrame, col: str, fmt: str = "yyyy-MM-dd") -> DataFrame:
    """Text to DATE."""
    return df.withColumn(col, F.to_date(F.col(col), fmt))


def write_submission(df: DataFrame, path: str) -> None:
    """Write (id, sales) as CSV with a header; a folder that exists is an error."""
    df.select("id", "sales").write.option("header", True).csv(path)
