"""Connectors for stored row formats: fixed-width text, length-prefixed text, fixed-length binary.

Each reads a folder or file into text columns (with row id, versions and the
active flag), and writes such columns back. Formats are described by columns
``(name, type, width, scale)``.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.errors import StorageError
from tidemark.functions.codec import decode, decode_text, encode, encode_text, truncate, truncate_encoded
from tidemark.sql.tree import Column

# Fixed values of the formats: widths of row ids, versions and numbers in text, and bytes of numbers in binary.
ROW_ID_WIDTH, VERSION_WIDTH = 20, 20
TEXT_WIDTH = {"INT": 11, "TINYINT": 4, "BIGINT": 20, "BIT": 1}
BINARY = {"INT": "<i", "TINYINT": "<b", "BIGINT": "<q", "BIT": "<B", "DECIMAL": "<d"}
STATE = "_active boolean, _row_id long, _xmin long, _xmax long"


def width_of(c: Column) -> int:
    return c.width + 2 if c.type == "DECIMAL" else TEXT_WIDTH.get(c.type, c.width)


def _schema(columns: list[Column]) -> str:
    return STATE + "".join(f", `{c.name}` string" for c in columns)


def is_variable(columns: list[Column]) -> bool:
    """Tables with a VARCHAR column are stored length-prefixed."""
    return any(c.type == "VARCHAR" for c in columns)


def read_text_rows(spark: SparkSession, path: str, columns: list[Column]) -> DataFrame:
    return read_variable(spark, path, columns) if is_variable(columns) else read_fixed(spark, path, columns)


def write_text_rows(rows: DataFrame, path: str, columns: list[Column]) -> None:
    (write_variable if is_variable(columns) else write_fixed)(rows, path, columns)


# Fixed width


def read_fixed(spark: SparkSession, path: str, columns: list[Column]) -> DataFrame:
    """Lines ``A|field|field`` (D: deleted), with or without a row id before and two versions after.

    A line without a mark or with a wrong one raises a Spark error that names
    the line. Fields are trimmed; a CHAR field is unescaped.
    """
    line = F.col("value")
    mark = F.substring(line, 1, 2)
    checked = F.when(mark.isin("A|", "D|"), line).otherwise(
        F.raise_error(F.concat(F.when(F.length(line) < 2, F.lit("Row too short: ")).otherwise(F.lit("Expected A| or D|: ")), F.substring(line, 1, 80)))
    )
    parts = F.split(F.substring(F.col("line"), 3, 1 << 30), r"\|", -1)
    n, k = F.size("parts"), len(columns)
    versioned = (n >= k + 2) & F.get("parts", n - 1).rlike(r"^\s*\d+\s*$") & F.get("parts", n - 2).rlike(r"^\s*\d+\s*$") & n.isin(k + 2, k + 3)
    numbered = F.when(F.col("versioned"), n == k + 3).otherwise(n == k + 1)
    at = lambda i: F.trim(F.get("parts", i))
    out = [decode(at(F.col("from") + i)).alias(c.name) if c.type == "CHAR" else at(F.col("from") + i).alias(c.name) for i, c in enumerate(columns)]
    return (
        spark.read.text(path).select(checked.alias("line")).withColumn("parts", parts).withColumn("versioned", versioned).withColumn("from", numbered.cast("int"))
        .select(
            (F.substring("line", 1, 1) == "A").alias("_active"), F.when(F.col("from") == 1, at(F.lit(0)).try_cast("long")).alias("_row_id"),
            F.when(F.col("versioned"), at(n - 2).cast("long")).alias("_xmin"), F.when(F.col("versioned"), at(n - 1).cast("long")).alias("_xmax"), *out,
        )
    )


def _state(rows: DataFrame, name: str, default) -> object:
    return F.coalesce(F.col(name), F.lit(default)) if name in rows.columns else F.lit(default)


def write_fixed(rows: DataFrame, path: str, columns: list[Column]) -> None:
    """Numbers right-aligned (their last characters if too long), texts escaped, cut and padded."""
    fields = []
    for c in columns:
        value, w = F.coalesce(F.col(f"`{c.name}`").cast("string"), F.lit("")), width_of(c)
        if c.type in ("CHAR", "VARCHAR"):
            fields.append(F.rpad(encode(truncate(value, w)), w, " "))
        elif c.type == "BIT":
            fields.append(F.when(value.isin("1", "0"), value).otherwise("0"))
        else:
            fields.append(F.lpad(F.right(value, F.lit(w)), w, " "))
    if "_row_id" in rows.columns:
        fields.insert(0, F.lpad(F.col("_row_id").cast("string"), ROW_ID_WIDTH, " "))
    if "_xmin" in rows.columns:
        fields += [F.lpad(_state(rows, v, d).cast("string"), VERSION_WIDTH, "0") for v, d in (("_xmin", 1), ("_xmax", 0))]
    mark = F.when(_state(rows, "_active", True), "A|").otherwise("D|")
    rows.select(F.concat(mark, F.concat_ws("|", *fields)).alias("value")).write.mode("overwrite").text(path)


# Length-prefixed


def split_line(line: str) -> tuple[bool, list[str]]:
    """The mark and the fields of a line ``A|5:Hello|0:``; a field may hold any character."""
    if len(line) < 2:
        raise StorageError("Row too short: it must start with A| or D|", position=0)
    if line[:2] not in ("A|", "D|"):
        raise StorageError(f"Expected A| or D|, got '{line[:2]}'", position=0)
    out, at = [], 2
    while at < len(line):
        colon = line.find(":", at)
        if colon < 0 or not line[at:colon].isdigit():
            raise StorageError("Expected a field's length", position=at)
        end = colon + 1 + int(line[at:colon])
        if end > len(line) or end < len(line) and line[end] != "|":
            raise StorageError("A field ends beyond its place", position=at)
        out.append(line[colon + 1 : end])
        at = end + 1
    return line[0] == "A", out


def read_variable(spark: SparkSession, path: str, columns: list[Column]) -> DataFrame:
    names = ["_active", "_row_id", "_xmin", "_xmax", *(c.name for c in columns)]
    texts = [c.type in ("CHAR", "VARCHAR") for c in columns]

    def read(batches):
        for batch in batches:
            rows = []
            for line in batch.column(0).to_pylist():
                active, fields = split_line(line)
                extra = len(fields) - len(columns)
                if extra not in (0, 1, 2, 3):
                    raise StorageError(f"Expected {len(columns)} fields, got {len(fields)}")
                versions = [int(x) for x in fields[-2:]] if extra >= 2 else [None, None]
                body = fields[extra % 2 : extra % 2 + len(columns)]
                rows.append((active, int(fields[0]) if extra % 2 else None, *versions, *(decode_text(x) if t else x for x, t in zip(body, texts, strict=True))))
            kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * len(columns)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds)], names=names)

    return spark.read.text(path).mapInArrow(read, _schema(columns))


def write_variable(rows: DataFrame, path: str, columns: list[Column]) -> None:
    field = lambda v: F.concat(F.length(v).cast("string"), F.lit(":"), v)
    fields = []
    for c in columns:
        value = F.coalesce(F.col(f"`{c.name}`").cast("string"), F.lit(""))
        fields.append(field(encode(truncate(value, c.width)) if c.type in ("CHAR", "VARCHAR") else value))
    if "_row_id" in rows.columns:
        fields.insert(0, field(F.col("_row_id").cast("string")))
    if "_xmin" in rows.columns:
        fields += [field(_state(rows, v, d).cast("string")) for v, d in (("_xmin", 1), ("_xmax", 0))]
    mark = F.when(_state(rows, "_active", True), "A|").otherwise("D|")
    rows.select(F.concat(mark, F.concat_ws("|", *fields)).alias("value")).write.mode("overwrite").text(path)


# Binary


def record_size(columns: list[Column], versions: bool) -> int:
    return 9 + sum(struct.calcsize(BINARY[c.type]) if c.type in BINARY else c.width for c in columns) + 16 * versions


def unpack(record: bytes, columns: list[Column], versions: bool) -> tuple:
    if len(record) != record_size(columns, versions):
        raise StorageError("Binary row of the wrong length")
    values, at = [], 9
    for c in columns:
        if c.type in BINARY:
            (x,) = struct.unpack_from(BINARY[c.type], record, at)
            values.append(f"{x:.0f}" if isinstance(x, float) and x.is_integer() else str(x) if c.type != "BIT" else str(int(x != 0)))
            at += struct.calcsize(BINARY[c.type])
        else:
            values.append(decode_text(record[at : at + c.width].decode("ascii", "replace").rstrip(" \0")))
            at += c.width
    return (record[0] == 0, struct.unpack_from("<q", record, 1)[0], *(struct.unpack_from("<qq", record, at) if versions else (None, None)), *values)


def _as_number(c: Column, value: str):
    try:
        return float(value) if c.type == "DECIMAL" else int(value)
    except ValueError:
        return 0


def pack(row: tuple, columns: list[Column], versions: bool) -> bytes:
    """A record of (active, row id, xmin, xmax, values ...): what isn't a number of its type is 0."""
    active, row_id, xmin, xmax, *values = row
    out = [bytes([0 if active else 1]), struct.pack("<q", row_id or 0)]
    for c, value in zip(columns, values, strict=True):
        value = value or ""
        if c.type == "BIT":
            out.append(bytes([value in ("1", "true")]))
        elif c.type in BINARY:
            try:
                out.append(struct.pack(BINARY[c.type], _as_number(c, value)))
            except struct.error:
                out.append(struct.pack(BINARY[c.type], 0))
        else:
            out.append(truncate_encoded(encode_text(value), c.width).encode("ascii", "replace").ljust(c.width))
    return b"".join(out) + (struct.pack("<qq", xmin or 1, xmax or 0) if versions else b"")


def read_binary(spark: SparkSession, path: str, columns: list[Column], versions: bool) -> DataFrame:
    """Fixed-length records; whether they carry versions is for the caller to say, as lengths alone can't."""
    size = record_size(columns, versions)
    records = spark.sparkContext.binaryRecords(path, size)
    return spark.createDataFrame(records.map(lambda r: unpack(bytes(r), columns, versions)), _schema(columns))


def pack_rows(rows: DataFrame, columns: list[Column], versions: bool) -> DataFrame:
    """Records in a column ``record``, for any sink of binary rows."""
    wanted = rows.select(
        _state(rows, "_active", True).alias("_active"), *[_state(rows, n, d).cast("long").alias(n) for n, d in (("_row_id", 0), ("_xmin", 1), ("_xmax", 0))], *[F.col(f"`{c.name}`").cast("string").alias(c.name) for c in columns]
    )

    def build(batches):
        for batch in batches:
            lists = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([pa.array([pack(r, columns, versions) for r in zip(*lists, strict=True)], type=pa.binary())], names=["record"])

    return wanted.mapInArrow(build, "record binary")


def write_binary(rows: DataFrame, path: str, columns: list[Column], versions: bool) -> None:
    """One file of records without separators, in the order of rows.

    The format has no container, so the driver streams it partition by
    partition through Spark's file system; memory holds one partition. For
    tables that need many writers, write pack_rows to Parquet instead.
    """
    spark = rows.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        for r in pack_rows(rows, columns, versions).toLocalIterator():
            stream.write(r["record"])
    finally:
        stream.close()
