"""Daily exchange files as lines of text: format, fields, quarantine reasons; and an action feed in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import quality

#: The public layouts of the exchange's daily file: column names, date formats and the segment that counts. Fixed values.
FORMATS = {
    "LEGACY": {"symbol": "SYMBOL", "series": "SERIES", "o": "OPEN", "h": "HIGH", "l": "LOW", "c": "CLOSE", "v": "TOTTRDQTY", "day": "TIMESTAMP", "isin": "ISIN"},
    "UDIFF": {"symbol": "TCKRSYMB", "series": "SCTYSRS", "o": "OPNPRIC", "h": "HGHPRIC", "l": "LWPRIC", "c": "CLSPRIC", "v": "TTLTRADGVOL", "day": "TRADDT", "isin": "ISIN", "segment": "SGMT"},
}
DATES = ("dd-MMM-yyyy", "yyyy-MM-dd")
SERIES = ("EQ", "BE")
SEGMENT = "CM"
ABNORMAL = 0.05


def headers(lines: DataFrame) -> DataFrame:
    """file, header (names trimmed, in capitals), format: the first whose names it has; DUPLICATE_COLUMN or UNKNOWN_FORMAT else."""
    h = lines.where("line_no = 0").select("file", F.transform(F.split(F.regexp_replace("line", "^﻿", ""), ","), lambda x: F.upper(F.trim(x))).alias("header"))
    name = F.when(F.size(F.array_distinct("header")) < F.size("header"), "DUPLICATE_COLUMN")
    for k, columns in FORMATS.items():
        name = name.when(F.size(F.array_except(F.array(*[F.lit(c) for c in columns.values()]), "header")) == 0, k)
    return h.withColumn("format", name.otherwise("UNKNOWN_FORMAT"))


def whole(text: Column) -> Column:
    """A quantity: digits, or digits with zeros behind the point; null else."""
    return F.when(text.rlike(r"^\d{1,15}(\.0+)?$"), F.split_part(text, F.lit("."), F.lit(1)).cast("long"))


def parsed(lines: DataFrame) -> DataFrame:
    """file, line_no, symbol, series, isin, o, h, l, c, v, status (ACCEPTED, OUT_OF_SCOPE, QUARANTINED, FILE), reason of lines (file, file_day, line_no, line).

    Rows of other series or segments are out of scope and no fault. All rows of a symbol and series that comes twice in a file go.
    """
    known = headers(lines)
    body = lines.where("line_no > 0").join(known, "file").withColumn("fields", F.transform(F.split("line", ","), lambda x: F.trim(x)))
    good = F.col("format").isin(*FORMATS) & (F.size("fields") == F.size("header"))
    body = body.withColumn("m", F.when(good, F.map_from_arrays("header", "fields")))

    def field(k: str) -> Column:
        out = F.lit(None).cast("string")
        for name, columns in FORMATS.items():
            if k in columns:
                out = F.when(F.col("format") == name, F.try_element_at("m", F.lit(columns[k]))).otherwise(out)
        return F.nullif(out, F.lit(""))

    x = body.withColumns({k: field(k) for k in ("symbol", "series", "isin", "segment", "day", *"ohlcv")})
    text = {k: F.col(k) for k in "ohlc"}
    shape = F.lit(False)
    for v in text.values():
        shape = shape | ~F.coalesce(v.rlike(r"^-?\d+(\.\d+)?$"), F.lit(False))
    prices = {k: quality.price(v) for k, v in text.items()}
    short = F.try_to_timestamp("day", F.lit("dd-MMM-yy")).cast("date")  # of two digits, 69 to 99 are of the last century
    short = F.when(F.year(short) >= 2069, F.add_months(short, -1200)).otherwise(short)
    day = F.coalesce(*[F.try_to_timestamp("day", F.lit(f)).cast("date") for f in DATES], short)
    scope = ~F.coalesce(F.col("series").isin(*SERIES), F.lit(False)) | (F.col("segment").isNotNull() & (F.col("segment") != SEGMENT))
    x = x.withColumns({"bad_price": shape, "traded": day, "out": scope & good, **prices, "v": whole(F.col("v"))})
    reason = (
        F.when(~F.col("format").isin(*FORMATS), F.col("format")).when(F.size("fields") != F.size("header"), "FIELD_COUNT").when(F.col("out"), None)
        .when(F.col("traded").isNull() | (F.col("traded") != F.col("file_day")), "DATE_MISMATCH").when(F.col("bad_price"), "BAD_PRICE").when(F.col("v").isNull(), "BAD_QUANTITY").otherwise(quality.problem(*"ohlcv"))
    )
    x = x.withColumn("reason", reason)
    same = Window.partitionBy("file", "symbol", "series")
    x = x.withColumn("reason", F.when(F.col("reason").isNull() & ~F.col("out") & (F.sum(F.when(~F.col("out"), 1).otherwise(0)).over(same) > 1), "DUPLICATE_ROW").otherwise(F.col("reason")))
    status = F.when(F.col("out"), "OUT_OF_SCOPE").when(F.col("reason").isNull(), "ACCEPTED").otherwise("QUARANTINED")
    return x.select("file", "file_day", "line_no", "symbol", "series", "isin", *"ohlcv", status.alias("status"), "reason")


def sessions(rows: DataFrame) -> DataFrame:
    """file, in_scope, rejected, state: QUARANTINED if a file has no row in scope or more than ABNORMAL of them rejected."""
    g = rows.groupBy("file").agg(F.sum((F.col("status") != "OUT_OF_SCOPE").cast("long")).alias("in_scope"), F.sum((F.col("status") == "QUARANTINED").cast("long")).alias("rejected"))
    return g.withColumn("state", F.when((F.col("in_scope") == 0) | (F.col("rejected") > ABNORMAL * F.col("in_scope")), "QUARANTINED").otherwise("INGESTED"))


def feed(items: DataFrame) -> DataFrame:
    """record_key, symbol, ex_date, subject, reason of feed items (window, downloaded_at, item: JSON text): the latest version of each
    window, each record once. Blank fields are null; an item without a symbol, an ex-date or a subject has a reason."""
    last = items.withColumn("r", F.rank().over(Window.partitionBy("window").orderBy(F.col("downloaded_at").desc()))).where("r = 1")
    j = F.from_json("item", "symbol string, exDate string, subject string")
    clean = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    x = last.withColumn("j", j).select(F.sha2("item", 256).alias("record_key"), clean(F.col("j.symbol")).alias("symbol"), F.to_date(F.try_to_timestamp("j.exDate", F.lit("dd-MMM-yyyy"))).alias("ex_date"), clean(F.col("j.subject")).alias("subject"))
    reason = F.when(F.col("symbol").isNull(), "NO_SYMBOL").when(F.col("ex_date").isNull(), "NO_EX_DATE").when(F.col("subject").isNull(), "NO_SUBJECT")
    return x.dropDuplicates(["record_key"]).withColumn("reason", reason)
