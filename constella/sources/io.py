"""Sources and sinks.

Reading is Spark's own readers; the reference's per-cell number coercion
becomes a per-column type decision made by one distributed aggregate (count
of values that fail each cast), then a projection with ``try_cast``. Writes go
to the shared folder named by ``spark.checkpoint.dir`` (or a path the caller
gives), never to a machine-local temporary folder.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from constella.session import shared_dir

MAX_FILE_BYTES = 100 * 1024 * 1024
MIN_FILE_BYTES = 10
# Accepted MIME types and their extensions, names that are
# refused, and the magic numbers of Excel files.
ALLOWED_TYPES = {
    "text/csv": [".csv"],
    "application/json": [".json"],
    "application/vnd.ms-excel": [".xls"],
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": [".xlsx"],
}
DANGEROUS_NAME_PARTS = ["..", "/", "\\", "<", ">", ":", '"', "|", "?", "*"]
MAGIC = {
    "application/vnd.ms-excel": [b"\xd0\xcf\x11\xe0", b"\x09\x08\x06\x00"],
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": [b"PK\x03\x04"],
}


class SourceError(ValueError):
    pass


# S1
def coerce_types(df: DataFrame) -> DataFrame:
    """String columns -> BIGINT if every non-empty value is an integer, else
    DOUBLE if every one is a number, else STRING; empty strings -> null."""
    cols = df.columns
    blank = {c: F.when(F.trim(F.col(f"`{c}`")) == "", None).otherwise(F.col(f"`{c}`")) for c in cols}
    aggs = []
    for i, c in enumerate(cols):
        v = blank[c]
        aggs.append(F.count_if(v.isNotNull() & v.try_cast("bigint").isNull()).alias(f"i{i}"))
        aggs.append(F.count_if(v.isNotNull() & v.try_cast("double").isNull()).alias(f"d{i}"))
    r = df.agg(*aggs).first()
    out = []
    for i, c in enumerate(cols):
        v = blank[c]
        if r[f"i{i}"] == 0:
            out.append(v.try_cast("bigint").alias(c))
        elif r[f"d{i}"] == 0:
            out.append(v.try_cast("double").alias(c))
        else:
            out.append(v.alias(c))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, coerce: bool = True) -> DataFrame:
    df = (spark.read.option("header", True).option("multiLine", True).option("encoding", "UTF-8")
          .option("inferSchema", False).csv(path))
    return coerce_types(df) if coerce else df


# S2
def read_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """JSON lines (the distributed form), or with ``multi_line`` one document
    per file holding an array of objects or a single object. Any other shape
    lands in ``_corrupt_record`` and is rejected."""
    df = spark.read.option("multiLine", multi_line).json(path)
    if "_corrupt_record" in df.columns:
        # whole rows: Spark refuses a scan of this column alone
        if df.columns == ["_corrupt_record"] or df.where(F.col("_corrupt_record").isNotNull()).first():
            raise SourceError("JSON must be an array of objects or a single object")
        df = df.drop("_corrupt_record")
    return df


def read_json_any(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, or else arrays and objects that stretch over lines (all
    files of a path in one form). Only a path whose first line opens such a
    value is read as whole files, so a bad line of JSON lines stays an error."""
    try:
        return read_json(spark, path)
    except SourceError:
        head = spark.read.text(path).where(F.trim("value") != "").first()
        opening = head["value"].strip() if head else ""
        if opening.startswith("[") or opening == "{":
            return read_json(spark, path, multi_line=True)
        raise


# S3
FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "json", ".parquet": "parquet", ".pq": "parquet"}
MIME_FORMATS = {"text/csv": "csv", "application/json": "json", "application/vnd.apache.parquet": "parquet"}


def read_table(spark: SparkSession, path: str, mime: str | None = None) -> DataFrame:
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    fmt = FORMATS.get(ext) or MIME_FORMATS.get(mime or "")
    if fmt == "csv":
        return read_csv(spark, path)
    if fmt == "json":
        return read_json_any(spark, path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    if ext in (".xls", ".xlsx"):
        raise SourceError("Excel files are not read here: convert to CSV or parquet upstream")
    raise SourceError("Unsupported file format. Supported: CSV, JSON, Parquet")


# S4
def require_rows(df: DataFrame, n: int = 1) -> DataFrame:
    """Reject a frame with fewer than n rows (reads at most n rows)."""
    if df.limit(n).count() < n:
        raise SourceError("Dataset is empty or could not be parsed" if n <= 1 else f"at least {n} rows are needed")
    return df


# S5
def _mime_from_ext(name: Column) -> Column:
    e = F.lower(name)
    return (F.when(e.endswith(".csv"), "text/csv").when(e.endswith(".json"), "application/json")
            .when(e.endswith(".xlsx"), "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet")
            .when(e.endswith(".xls"), "application/vnd.ms-excel").otherwise("application/octet-stream"))


def file_intake(spark: SparkSession, directory: str, declared: DataFrame | None = None,
                pattern: str = "*") -> DataFrame:
    """Accept or reject every file of a directory with a reason: size in
    [10 B, 100 MB], allowed MIME type, extension matching the MIME type,
    no dangerous characters in the name, Excel magic numbers. ``declared``
    (filename, mime) gives the MIME type the uploader claimed; otherwise it
    is derived from the extension. Files are listed without their content; it
    is read for those only whose first bytes decide (an Excel extension, a
    size within the limits), and 8 bytes of it are kept."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory).select(
        "path", F.col("length").alias("size"))
    ends = sorted({e for mime in MAGIC for e in ALLOWED_TYPES[mime]})
    by_end = ",".join("*" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in ends)
    heads = (spark.read.format("binaryFile").option("pathGlobFilter", "{" + by_end + "}").load(directory)
             .where((F.col("length") >= MIN_FILE_BYTES) & (F.col("length") <= MAX_FILE_BYTES))
             .select("path", F.substring("content", 1, 8).alias("head")))
    files = listed.join(heads, "path", "left").select(
        F.element_at(F.split("path", "/"), -1).alias("filename"), "size", "head")
    if declared is not None:
        files = files.join(declared.select("filename", "mime"), "filename", "left")
        files = files.withColumn("mime", F.coalesce("mime", _mime_from_ext(F.col("filename"))))
    else:
        files = files.withColumn("mime", _mime_from_ext(F.col("filename")))
    allowed = F.col("mime").isin(*ALLOWED_TYPES)
    ext_ok = F.lit(False)
    for mime, exts in ALLOWED_TYPES.items():
        for e in exts:
            ext_ok = ext_ok | ((F.col("mime") == mime) & F.lower("filename").endswith(e))
    danger = F.lit(False)
    for p in DANGEROUS_NAME_PARTS:
        danger = danger | F.col("filename").contains(p)
    magic_ok = F.lit(True)
    for mime, sigs in MAGIC.items():
        starts = F.lit(False)
        for s in sigs:
            starts = starts | (F.substring("head", 1, len(s)) == F.lit(s))
        magic_ok = magic_ok & ((F.col("mime") != mime) | F.col("head").isNull() | (F.length("head") < 4) | starts)
    reason = (F.when(F.col("size") > MAX_FILE_BYTES, "File too large")
              .when(F.col("size") < MIN_FILE_BYTES, "File is too small or empty")
              .when(~allowed, "Unsupported file type")
              .when(~ext_ok, "File extension doesn't match MIME type")
              .when(danger, "Filename contains dangerous characters")
              .when(~magic_ok, "File content doesn't match the declared file type"))
    return files.select("filename", "size", "mime", reason.isNull().alias("accepted"), reason.alias("reason"))


# S6
def write_dataset(df: DataFrame, name: str, catalogue_path: str | None = None, data_path: str | None = None,
                  tags: Sequence[str] = (), is_public: bool = False) -> DataFrame:
    """Persist rows as parquet and append one catalogue row (id, name, path,
    rows, columns, status 'uploaded'). Returns the catalogue row."""
    spark = df.sparkSession
    dataset_id = uuid.uuid4().hex
    data_path = data_path or shared_dir(spark, f"dataset-{name}")
    df.write.mode("overwrite").parquet(data_path)
    written = spark.read.parquet(data_path)
    row = written.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(dataset_id).alias("dataset_id"), F.lit(name).alias("name"), F.lit(data_path).alias("path"),
        "row_count", F.lit(len(df.columns)).cast("int").alias("column_count"),
        F.lit(",".join(t.strip() for t in tags if t.strip())).alias("tags"), F.lit(is_public).alias("is_public"),
        F.lit("uploaded").alias("status"), F.lit(1).cast("int").alias("version"),
        F.lit(None).cast("string").alias("parent_id"))
    if catalogue_path:
        row.write.mode("append").parquet(catalogue_path)
    return row


# S7
def write_result(tables: dict[str, DataFrame], run_id: str, base: str | None = None,
                 status: str = "processed") -> DataFrame:
    """Write each result table (points, clusters, anomalies, metadata) under
    base/<table>/run_id=<id>; returns (table, rows, status) per table."""
    spark = next(iter(tables.values())).sparkSession
    base = base or shared_dir(spark, "results")
    out = []
    for name, df in tables.items():
        path = f"{base}/{name}/run_id={run_id}"
        df.write.mode("overwrite").parquet(path)
        out.append(spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table_name"), "rows", F.lit(status).alias("status")))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


# S8
def create_version(catalogue: DataFrame) -> DataFrame:
    """A new catalogue row per given dataset row: version + 1, parent link,
    derived name, description and file name."""
    v = F.col("version") + 1
    return catalogue.select(
        F.concat(F.col("name"), F.lit(" v"), v.cast("string")).alias("name"),
        F.concat(F.lit("Version "), v.cast("string"), F.lit(" of "), F.col("name")).alias("description"),
        F.col("user_id"), F.col("dataset_id").alias("parent_id"), v.cast("int").alias("version"),
        F.col("is_public"), F.col("tags"),
        F.concat(F.col("name"), F.lit("_v"), v.cast("string")).alias("filename"))
