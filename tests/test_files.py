"""Files as they are published: archives, encodings, quoted cells, closing commas, faults and formats."""

import io
import zipfile
from datetime import date

from plumbline.sources import exchange, files

LEGACY = "SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,LAST,PREVCLOSE,TOTTRDQTY,TOTTRDVAL,TIMESTAMP,TOTALTRADES,ISIN"
UDIFF = "TradDt,BizDt,Sgmt,Src,TckrSymb,SctySrs,ISIN,OpnPric,HghPric,LwPric,ClsPric,TtlTradgVol,FinInstrmNm"


def zipped(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members.items():
            z.writestr(name, content)
    return out.getvalue()


def legacy(day: str, symbol: str = "ACME", end: str = ",") -> bytes:
    return f"{LEGACY}{end}\n{symbol},EQ,10.00,12.50,9.75,11.00,11.00,10.10,1200,13200.0,{day},7,INE000A01010{end}\n".encode()


CASES = {
    "cm05JAN2024bhav.csv.zip": zipped({"cm05JAN2024bhav.csv": legacy("05-JAN-2024"), "read me.txt": b"x"}),
    "cm06JAN1994bhav.csv": legacy("06-JAN-94"),
    "copy_20240708_F.csv.zip": zipped({"A.CSV": b"\xef\xbb\xbf" + f'{UDIFF}\n2024-07-08,2024-07-08,CM,NSE,ACME,EQ,INE000A01010,10.00,12.50,9.75,11.00,1200,"Acme, Limited"\n2024-07-08,2024-07-08,FO,NSE,ACME,EQ,INE000A01010,1,2,1,2,3,x\n'.encode()}),
    "cm08JAN2024bhav.csv": legacy("08-JAN-2024", "CAFÉ", "").decode().encode("cp1252"),
    "cm09JAN2024bhav.csv.zip": zipped({"a.csv": b"x", "b.csv": b"y"}),
    "cm10JAN2024bhav.csv.zip": zipped({"a.txt": b"x"}),
    "cm11JAN2024bhav.csv.zip": b"PK\x03\x04 broken",
    "cm13JAN2024bhav.csv": b"SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE\nACME,EQ,1,2,1,2\n",
    "no day.csv": legacy("05-JAN-2024"),
}


def test_files_of_a_folder(spark, tmp_path):
    for name, content in CASES.items():
        (tmp_path / name).write_bytes(content)
    got = files.daily(spark, str(tmp_path)).cache()
    faults = {r.file: r.fault for r in got.where("fault is not null").collect()}
    assert faults == {"cm09JAN2024bhav.csv.zip": "ZIP_LAYOUT", "cm10JAN2024bhav.csv.zip": "ZIP_LAYOUT", "cm11JAN2024bhav.csv.zip": "BAD_ZIP"}
    assert {r.file for r in got.where("warning is not null").collect()} == {"cm08JAN2024bhav.csv"}
    assert {r.file: r.file_day for r in got.select("file", "file_day").distinct().collect()}["no day.csv"] is None
    rows = {(r.file, r.line_no): r for r in exchange.parsed(got.where("fault is null")).collect()}
    for name, symbol in (("cm05JAN2024bhav.csv.zip", "ACME"), ("cm06JAN1994bhav.csv", "ACME"), ("copy_20240708_F.csv.zip", "ACME"), ("cm08JAN2024bhav.csv", "CAFÉ")):
        r = rows[name, 1]
        assert (r.symbol, r.series, r.isin, float(r.o), float(r.h), float(r.l), float(r.c), r.v, r.status) == (symbol, "EQ", "INE000A01010", 10.0, 12.5, 9.75, 11.0, 1200, "ACCEPTED"), name
    assert rows["copy_20240708_F.csv.zip", 2].status == "OUT_OF_SCOPE"
    assert rows["cm13JAN2024bhav.csv", 1].reason == "UNKNOWN_FORMAT"
    assert [tuple(r) for r in files.unknown(got).collect()] == [("cm13JAN2024bhav.csv", "LEGACY", ["ISIN", "TIMESTAMP", "TOTTRDQTY"])]


def test_all_lines_of_a_long_file(spark, monkeypatch):
    body = b"A,B\n" + b"".join(f"{k},x\n".encode() for k in range(20000))
    got = files.lines(spark.createDataFrame([("d/f.csv", bytearray(body)), ("d/g.csv", bytearray(zipped({"g.csv": body})))], "path string, content binary"))
    assert {tuple(r) for r in got.groupBy("file").agg({"line_no": "max", "*": "count"}).select("file", "max(line_no)", "count(1)").collect()} == {("f.csv", 20000, 20001), ("g.csv", 20000, 20001)}
    assert files.lines(spark.createDataFrame([], "path string, content binary")).collect() == []
    odd = files.lines(spark.createDataFrame([("d/n.csv", None)], "path string, content binary")).collect()
    assert [r.fault for r in odd] == ["EMPTY_FILE"]


def test_names_and_encodings():
    assert files.named_day("cm05JAN2024bhav.csv.zip") == date(2024, 1, 5) and files.named_day("x_20240708_1.csv") == date(2024, 7, 8)
    assert files.named_day("d 2024-02-30, 2024-02-29.csv") == date(2024, 2, 29) and files.named_day("12345678901.csv") is None and files.named_day("99999999.csv") is None
    assert files.encoding(io.BytesIO("é".encode() * (1 << 20))) == "utf-8-sig"  # a letter across the border of two pieces
    assert files.encoding(io.BytesIO(b"a" * (1 << 20) + b"\xe9")) == "cp1252"


def test_notices(spark):
    text = 'Acme Limited,OLD,NEW,05-JAN-2024\n"Beta, Sons",bet,BETA2,06-Feb-2023\nAcme Limited,OLD,NEW,05-JAN-2024\nGamma,SAME,same,01-JAN-2020\nshort,line\nDelta,D1,D2,not a day\nEps,,E2,01-JAN-2020\n'.encode()
    got = files.notices(files.lines(spark.createDataFrame([("symbolchange.csv", bytearray(text))], "path string, content binary")))
    assert {tuple(r) for r in got.collect()} == {("OLD", "NEW", date(2024, 1, 5), "Acme Limited"), ("BET", "BETA2", date(2023, 2, 6), "Beta  Sons")}
