"""Reading and writing the tables of the pipeline."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import TYPE_CHECKING
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import iso_utc
from ..operators.clean import Cleaned, cleaning_record
from ..schema import REQUESTS, TRIPS

if TYPE_CHECKING:
    from ..plans.build import TripBuild

# Doubled quotes inside quoted fields, as spreadsheet tools write them.
CSV = {"header": "true", "quote": '"', "escape": '"'}


def format_of(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    if name.endswith((".csv", ".txt")):
        return "csv"
    if name.endswith((".parquet", ".pq")):
        return "parquet"
    raise ValueError(f"Unsupported format of {path!r}; use CSV or Parquet")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw telemetry. CSV columns stay text: cleaning types them, so nothing is inferred."""
    if format_of(path) == "csv":
        return spark.read.options(**CSV).csv(path)
    return spark.read.parquet(path)


def preview(df: DataFrame, columns: list[str], n: int, order: str | None = None) -> DataFrame:
    """A few rows of a few columns; the scan reads no other column."""
    narrow = df.select(*columns) if order in (None, *columns) else df.select(*columns, order)
    return (narrow.orderBy(order) if order else narrow).limit(n).select(*columns)


def flat_for_csv(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, times in ISO form. Point structs become pairs."""

    def flat(f: T.StructField):
        c = F.col(f.name)
        kind = f.dataType
        if isinstance(kind, T.TimestampType):
            return iso_utc(c).alias(f.name)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            if kind.elementType.fieldNames() == ["latitude", "longitude"]:
                c = F.transform(c, lambda p: F.array(p["latitude"], p["longitude"]))
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            return F.to_json(c, {"ignoreNullFields": "false"}).alias(f.name)
        return c

    return df.select(*[flat(f) for f in df.schema.fields])


def write_table(df: DataFrame, path: str) -> str:
    """Write by extension; CSV gets nested columns as JSON text."""
    if format_of(path) == "csv":
        flat_for_csv(df).write.mode("overwrite").options(**CSV).csv(path)
    else:
        df.write.mode("overwrite").parquet(path)
    return path


def write_record(df: DataFrame, path: str) -> str:
    """A one-row table as one JSON object."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return path


def write_build(result: "TripBuild", directory: str, extension: str = "parquet") -> dict[str, str]:
    """All six outputs of a build under one folder."""
    tables = {
        "trips": (result.trips, "trips"),
        "points": (result.points, "trip_points"),
        "cleaned_source": (result.cleaned_source, "cleaned_trip_source"),
        "rejected": (result.rejected, "rejected_trips"),
        "cleaning_audit": (result.cleaning_audit, "raw_cleaning_audit"),
    }
    paths = {
        name: write_table(df, f"{directory}/{file}.{extension}") for name, (df, file) in tables.items()
    }
    paths["audit"] = write_record(result.audit, f"{directory}/trip_build_audit.json")
    return paths


def write_cleaning(cleaned: Cleaned, directory: str, extension: str = "parquet") -> dict[str, str]:
    return {
        "cleaned_raw": write_table(cleaned.data, f"{directory}/cleaned_raw.{extension}"),
        "discarded_rows": write_table(cleaned.discarded, f"{directory}/discarded_raw_rows.{extension}"),
        "cleaning_audit": write_record(cleaning_record(cleaned.counts), f"{directory}/raw_cleaning_audit.json"),
    }


#: Bytes of a file that a task holds at once while it hashes it.
PART_BYTES = 8 << 20


def _open(path: str):
    """A byte stream of a file as Spark names it."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return open("/" + rest.lstrip("/"), "rb")
    system, name = pyarrow.fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return system.open_input_stream(name)


def _hash_files(part_bytes: int):
    """Function for ``mapInArrow`` over (path, bytes): adds the sha256, read part by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                digest = hashlib.sha256()
                with _open(path) as stream:
                    while part := stream.read(part_bytes):
                        digest.update(part)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=["path", "bytes", "sha256"])

    return run


def file_fingerprints(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """(path, bytes, sha256) per file under ``path``, of any size.

    Spark lists the files and deals them into tasks by size; a task streams each of its
    files and holds ``part_bytes`` of it. The hash is of the file's bytes in order, so
    one file is one task's work. Spark lists no empty files; a folder without others gives an
    empty table.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"))
    return files.mapInArrow(_hash_files(part_bytes), "path string, bytes long, sha256 string")


def content_fingerprint(df: DataFrame) -> DataFrame:
    """(rows, content_hash) that depend on the rows only, not on files or order."""
    row = F.xxhash64(*[F.to_json(c) if isinstance(df.schema[c].dataType, T.MapType) else F.col(c) for c in df.columns])
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("content_hash")
    )


def file_contents(spark: SparkSession, path: str) -> DataFrame:
    """(path, rows, content_hash) per file under ``path``, of any size, streamed by the reader.

    Rows are the lines of a CSV file, its header among them, and the rows of a Parquet
    file. The hash does not depend on their order; it sees which columns are null, which
    xxhash64 alone does not. Files without rows have no row here.
    """
    df = spark.read.text(path) if format_of(path) == "csv" else spark.read.parquet(path)
    cells = [F.to_json(c) if isinstance(df.schema[c].dataType, T.MapType) else F.col(c) for c in df.columns]
    row = F.xxhash64(*cells, F.array(*[F.col(c).isNull() for c in df.columns]))
    return df.select(F.col("_metadata.file_path").alias("path"), row.cast("decimal(38,0)").alias("hash")).groupBy("path").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("hash").cast("string").alias("content_hash")
    )


def load_trips(spark: SparkSession, path: str) -> DataFrame:
    """A written trips table. From CSV the trajectory arrives as JSON text."""
    if format_of(path) == "parquet":
        return spark.read.parquet(path)
    text = {"Trajectory", "AltitudeTrajectory", "quality_flags"}
    head = spark.read.options(**CSV).csv(path).columns
    known = {f.name: f.dataType for f in TRIPS.fields}
    fields = [
        T.StructField(n, T.StringType() if n in text else known.get(n, T.StringType())) for n in head
    ]
    return spark.read.options(**CSV).schema(T.StructType(fields)).csv(path)


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    """A written predictions table; metrics need five of its columns, typed here."""
    if format_of(path) == "parquet":
        return spark.read.parquet(path)
    df = spark.read.options(**CSV).csv(path)
    numeric = {
        f: "int" if f == "actual_rank" else "double"
        for f in df.columns
        if f == "actual_rank" or f in ("error_km", "prefix_fraction") or f.endswith(("latitude", "longitude", "probability"))
    }
    return df.withColumns({c: F.col(c).cast("double").cast(t) for c, t in numeric.items()})


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Scenario requests as JSON lines, one row per line that is not blank.

    ``parse_error`` says why a line is no request (null for a sound one): it is not one
    JSON object, names settings that do not exist, or holds a value of another type.
    Each bad line keeps a row and an error of its own, told apart by ``line``.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    # All fields as text first, so that a value of another type is seen, not dropped. In
    # brackets, text after the object makes the line malformed.
    loose = T.ArrayType(T.StructType([T.StructField(f.name, T.StringType()) for f in REQUESTS.fields]))
    parsed = lines.select(
        "value",
        F.monotonically_increasing_id().alias("_line"),
        F.from_json(F.concat(F.lit("["), "value", F.lit("]")), loose).alias("_all"),
        F.json_object_keys("value").alias("_keys"),
    )
    one = (F.size("_all") == 1) & F.col("_keys").isNotNull()
    parsed = parsed.withColumn("r", F.when(one, F.get("_all", F.lit(0))))
    typed, wrong = [], []
    for f in REQUESTS.fields:
        text = F.col(f"r.{f.name}")
        if isinstance(f.dataType, T.StringType):
            value = text
        elif isinstance(f.dataType, T.ArrayType):
            value = F.from_json(text, f.dataType)
        else:
            value = text.try_cast(f.dataType)
        typed.append(value.alias(f.name))
        wrong.append(F.when(text.isNotNull() & value.isNull(), F.lit(f.name)))
    known = F.array(*[F.lit(f.name) for f in REQUESTS.fields])
    unknown = F.array_sort(F.array_except("_keys", known))
    mistyped = F.array_compact(F.array(*wrong))
    error = (
        F.when(F.coalesce(~one, F.lit(True)), "The line is not one JSON object")
        .when(F.size(unknown) > 0, F.concat(F.lit("Unknown settings: "), F.array_join(unknown, ", ")))
        .when(F.size(mistyped) > 0, F.concat(F.lit("Values of the wrong type: "), F.array_join(mistyped, ", ")))
    )
    return parsed.select(*typed, error.alias("parse_error"), F.when(error.isNotNull(), F.col("_line")).alias("line"))
