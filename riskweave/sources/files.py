"""Reading and writing files: tolerant CSV, workbooks, exports with digests, sealed predictions, tables that only grow."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts that a CSV may use for a missing value, and the suffixes an upload may have (fixed values).
NULL_TOKENS = ("NA", "N/A", "null", "")
SUFFIXES = (".csv", ".xlsx")
CORRUPT = "_corrupt"


class UploadError(ValueError):
    """A file that is refused, with the reason."""


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Names in the first line of a CSV."""
    lines = spark.read.text(path).limit(1).collect()
    if not lines:
        raise UploadError("the file is empty")
    import csv

    return next(csv.reader([lines[0][0].lstrip("﻿")]))


def read_csv_tolerantly(spark: SparkSession, path: str) -> DataFrame:
    """All columns as trimmed text with null tokens as null; ragged lines keep what they have, and the whole line in _corrupt.

    One pass without type inference: types are found by `canonicalise`, over all rows.
    """
    names = csv_header(spark, path)
    check_header(names)
    schema = ", ".join(f"`{n}` string" for n in names) + f", `{CORRUPT}` string"
    raw = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("enforceSchema", True).csv(path)
    cell = lambda c: F.when(~F.trim(F.col(f"`{c}`")).isin(*NULL_TOKENS), F.trim(F.col(f"`{c}`")))
    return raw.select(*(cell(n).alias(n) for n in names), CORRUPT)


def check_header(names: list[str]) -> None:
    """Refuses headers that name a column twice."""
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise UploadError(f"columns named twice: {', '.join(twice)}")


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """A CSV or workbook as text columns; other suffixes, repeated headers and files without rows are refused."""
    suffix = "." + path.rsplit(".", 1)[-1].lower()
    if suffix not in SUFFIXES:
        raise UploadError(f"not one of {', '.join(SUFFIXES)}")
    df = read_csv_tolerantly(spark, path).drop(CORRUPT) if suffix == ".csv" else read_workbook(spark, path)
    if df.isEmpty():
        raise UploadError("the file has no rows")
    return df


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        number = number * 26 + ord(letter) - 64
    return number - 1


def workbook_rows(data: bytes, sheet: int = 1) -> Iterator[list[str | None]]:
    """Cells of one sheet as text, row by row; empty cells are None, numbers as they stand."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            for _, item in ElementTree.iterparse(book.open("xl/sharedStrings.xml")):
                if item.tag == f"{_MAIN}si":
                    shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
                    item.clear()
        for _, row in ElementTree.iterparse(book.open(f"xl/worksheets/sheet{sheet}.xml")):
            if row.tag != f"{_MAIN}row":
                continue
            cells: list[str | None] = []
            for cell in row.iter(f"{_MAIN}c"):
                at = _column_number(cell.get("r")) if cell.get("r") else len(cells)
                cells += [None] * (at - len(cells))
                value, kind = cell.find(f"{_MAIN}v"), cell.get("t")
                if kind == "inlineStr":
                    cells.append("".join(t.text or "" for t in cell.iter(f"{_MAIN}t")))
                elif value is None or value.text is None:
                    cells.append(None)
                else:
                    cells.append(shared[int(value.text)] if kind == "s" else value.text)
            yield cells
            row.clear()


def read_workbook(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """One sheet of workbooks as text columns, a task a file, without the header row; files come through Spark, so any storage will do.

    The header is that of the first file in order of path. Rows without a value are left out.
    """
    books = spark.read.format("binaryFile").load(path)
    first = books.orderBy("path").select("content").first()
    if first is None:
        raise UploadError("the file is empty")
    header = next(workbook_rows(bytes(first[0]), sheet), [])
    names = [c if c is not None else f"_c{i}" for i, c in enumerate(header)]
    check_header(names)
    if not names:
        raise UploadError("the file is empty")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows: list[list[str | None]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=names)

        for batch in batches:
            for content in batch.column("content").to_pylist():
                held, cells = [], workbook_rows(content, sheet)
                next(cells, None)
                for row in cells:
                    if any(c is not None for c in row):
                        held.append((row + [None] * len(names))[: len(names)])
                    if len(held) >= 10_000:
                        yield emit(held)
                        held = []
                if held:
                    yield emit(held)

    df = books.select("content").mapInArrow(run, ", ".join(f"`{n}` string" for n in names))
    return df.select(*(F.when(~F.trim(F.col(f"`{n}`")).isin(*NULL_TOKENS), F.trim(F.col(f"`{n}`"))).alias(n) for n in names))


def workbook_bytes(header: list[str], rows: list[tuple]) -> bytes:
    """A workbook of one sheet with a header; values as text, empty cells for nulls."""
    from xml.sax.saxutils import escape

    def line(number: int, cells: list | tuple) -> str:
        inner = "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' if v is not None else "<c/>" for v in cells)
        return f'<row r="{number}">{inner}</row>'

    body = "".join(line(i, cells) for i, cells in enumerate([header, *rows], 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes one small file through Spark's storage."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, False)
    stream.write(bytearray(data))
    stream.close()


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, sha256) of every file of a path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def write_export(df: DataFrame, folder: str) -> DataFrame:
    """Writes CSV files with a header, and returns their digests; the files are as many as the rows' partitions."""
    df.write.mode("error").option("header", True).csv(folder)
    return file_digests(df.sparkSession, f"{folder}/*.csv")


def seal(df: DataFrame, folder: str, key: str, meta: dict) -> dict:
    """Writes predictions once, with a manifest of their digest, so that a change is found."""
    from ..operators.canonical import content_digest

    df.write.mode("error").option("compression", "zstd").parquet(f"{folder}/rows")
    row = content_digest(df.sparkSession.read.parquet(f"{folder}/rows"), sorted(df.columns)).first()
    manifest = {**meta, "key": key, "columns": sorted(df.columns), **row.asDict()}
    df.sparkSession.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("error").text(f"{folder}/manifest")
    return manifest


def verify_seal(spark: SparkSession, folder: str) -> bool:
    """Whether sealed rows still are what was sealed."""
    from ..operators.canonical import content_digest

    manifest = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
    row = content_digest(spark.read.parquet(f"{folder}/rows"), manifest["columns"]).first()
    return all(manifest[k] == v for k, v in row.asDict().items())


def reveal(spark: SparkSession, folder: str, labels: DataFrame) -> DataFrame:
    """Sealed predictions joined to labels by their key, if the seal holds."""
    if not verify_seal(spark, folder):
        raise UploadError("the sealed rows have changed")
    manifest = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
    return spark.read.parquet(f"{folder}/rows").join(labels, manifest["key"])


def append_checked(df: DataFrame, folder: str, check: str) -> int:
    """Appends the rows that hold the check to a table that only grows, the others to its quarantine; returns how many were refused."""
    good = F.coalesce(F.expr(check), F.lit(False))
    df.where(good).write.mode("append").parquet(f"{folder}/rows")
    refused = df.where(~good)
    refused.write.mode("append").parquet(f"{folder}/refused")
    return refused.count()


def replace_partition(df: DataFrame, folder: str, by: str) -> None:
    """Writes rows in place of the stored ones of the same `by` values; other partitions stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(folder)
