"""Daily files and change notices from folders: archives, encodings and names as an exchange publishes them.

Spark lists and reads the files (whole, up to 2 GB each), a file is unpacked and decoded by one task as a stream of lines; files are small and many. Paths
may be in any store that Spark reads.
"""

from __future__ import annotations

import codecs
import csv
import io
import re
import zipfile
from collections.abc import Iterator
from datetime import date, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.exchange import FORMATS, headers

LINES = "file string, file_day date, line_no long, line string, warning string, fault string"
_OUT = pa.schema([("file", pa.string()), ("file_day", pa.date32()), ("line_no", pa.int64()), ("line", pa.string()), ("warning", pa.string()), ("fault", pa.string())])
BATCH = 4096
_DAYS = ((re.compile(r"(?<!\d)(\d{2}[A-Za-z]{3}\d{4})(?!\d)"), "%d%b%Y"), (re.compile(r"(?<!\d)(\d{8})(?!\d)"), "%Y%m%d"), (re.compile(r"(?<!\d)(\d{4}-\d{2}-\d{2})(?!\d)"), "%Y-%m-%d"))


def named_day(name: str) -> date | None:
    """The day that a file's name holds."""
    for pattern, form in _DAYS:
        for text in pattern.findall(name):
            try:
                return datetime.strptime(text, form).date()
            except ValueError:
                continue
    return None


def unpacked(content: bytes) -> io.BufferedIOBase:
    """The bytes of a CSV, or of the one CSV in an archive; ValueError with the fault's name else."""
    if content[:2] != b"PK":
        return io.BytesIO(content)
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        found = [n for n in archive.namelist() if n.lower().endswith(".csv")]
        if len(found) != 1:
            raise ValueError("ZIP_LAYOUT")
        if archive.testzip():
            raise ValueError("BAD_ZIP")
        return archive.open(found[0])
    except zipfile.BadZipFile:
        raise ValueError("BAD_ZIP") from None


def encoding(source: io.BufferedIOBase) -> str:
    """utf-8-sig if all of it is that, else cp1252; reads in pieces."""
    decoder = codecs.getincrementaldecoder("utf-8-sig")()
    try:
        while piece := source.read(1 << 20):
            decoder.decode(piece)
        decoder.decode(b"", final=True)
    except UnicodeDecodeError:
        return "cp1252"
    return "utf-8-sig"


def rows(content: bytes) -> Iterator[tuple[int, str, str | None]]:
    """(line number, line, warning) of a file. Cells are trimmed, commas in quoted ones are blanks, and lines end as the header does: one that closes
    with commas has as many empty cells as all lines lose."""
    kind = encoding(unpacked(content))
    warning = None if kind == "utf-8-sig" else "ENCODING_FALLBACK"
    spare = None
    for n, cells in enumerate(csv.reader(io.TextIOWrapper(unpacked(content), kind, errors="replace", newline=""))):
        cells = [c.strip().replace(",", " ") for c in cells]
        if spare is None:
            spare = next((k for k, c in enumerate(reversed(cells)) if c), len(cells))
        cut = spare
        while cut and cells and not cells[-1]:
            cells.pop()
            cut -= 1
        yield n, ",".join(cells), warning


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            name = path.rstrip("/").rsplit("/", 1)[-1]
            day = named_day(name)
            try:
                found = False
                for n, line, warning in rows(content.as_py() or b""):
                    found = True
                    out.append((name, day, n, line, warning, None))
                    if len(out) >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _OUT.types)], schema=_OUT)
                        out = []
                if not found:
                    out.append((name, day, None, None, None, "EMPTY_FILE"))
            except (ValueError, csv.Error) as fault:
                out.append((name, day, None, None, None, str(fault) if isinstance(fault, ValueError) and str(fault).isupper() else "BAD_CSV"))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _OUT.types)], schema=_OUT)


def lines(contents: DataFrame) -> DataFrame:
    """LINES of files (path, content): their lines, or one row with the fault of a file that gives none.

    ZIP_LAYOUT: not exactly one CSV in an archive; BAD_ZIP, BAD_CSV, EMPTY_FILE. Bytes that are no UTF-8 are read as cp1252, with a warning. file_day is the
    day in the file's name, null without one.
    """
    return contents.select("path", "content").mapInArrow(_read, LINES)


def daily(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """lines() of the files of a folder whose names match. Spark passes over files without a byte."""
    return lines(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder))


def unknown(found: DataFrame) -> DataFrame:
    """file, closest, missing: for files of no known format, the format of which the fewest columns are missing, and these."""
    lack = F.array(*[F.struct(F.size(F.array_except(F.array(*[F.lit(c) for c in columns.values()]), "header")).alias("n"), F.lit(rank).alias("rank"), F.lit(name).alias("closest"), F.array_sort(F.array_except(F.array(*[F.lit(c) for c in columns.values()]), "header")).alias("missing")) for rank, (name, columns) in enumerate(FORMATS.items())])
    return headers(found.where("fault is null")).where("format = 'UNKNOWN_FORMAT'").withColumn("x", F.array_min(lack)).select("file", "x.closest", "x.missing")


def notices(found: DataFrame) -> DataFrame:
    """old, new, effective, company: change notices of lines without a header: company, old symbol, new symbol, day.

    Lines that say nothing else are left out: a missing notice only means fewer links. Repeated ones count once.
    """
    cell = lambda k: F.nullif(F.trim(F.get(F.split("line", ","), F.lit(k))), F.lit(""))
    when = F.try_to_timestamp(F.get(F.split("line", ","), F.lit(3)), F.lit("dd-MMM-yyyy")).cast("date")
    x = found.where("line is not null").select(F.upper(cell(1)).alias("old"), F.upper(cell(2)).alias("new"), when.alias("effective"), cell(0).alias("company"))
    return x.where("effective is not null and old <> new").distinct()
