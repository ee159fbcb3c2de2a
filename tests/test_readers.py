import io
import warnings
import zipfile
from csv import reader as csv_rows

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit import dataset_info, load_csv, load_excel, load_parquet
from assaykit.functions.dates import date_shape, elapsed_seconds, parse_date, parse_instant
from assaykit.functions.values import exact_sum, same_family, text_literal
from assaykit.operators import profiling
from assaykit.sources.readers import POSITION, extract_csv
from conftest import COLUMNS, NAMES

PANDAS_TYPES = {"int64": "bigint", "float64": "double", "object": "string", "bool": "boolean"}
HEADER = ",".join(NAMES)
LINES = ["536365,85123A,HEART,6,12/1/2010 8:26,2.5,17850.0,United Kingdom",
         "C536366,71053,LANTERN,-2,12/1/2010 8:28,3.0,,United Kingdom"]


@pytest.fixture
def csv(tmp_path):
    def write(lines, header=HEADER, name="retail.csv", encoding="latin-1"):
        path = tmp_path / name
        path.write_bytes("\n".join([header, *lines, ""]).encode(encoding))
        return str(path)
    return write


def test_reads_the_contract(spark, csv):
    e = extract_csv(spark, csv(LINES))
    assert (e.rows, e.columns) == (2, 8)
    assert ", ".join(f"{n} {t}" for n, t in e.df.dtypes) == COLUMNS
    assert e.df.orderBy("InvoiceNo").first().UnitPrice == 2.5


def test_missing_source(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_csv(spark, str(tmp_path / "missing.csv"))


def test_unreadable_source(spark, tmp_path):
    with pytest.raises(ValueError):
        load_csv(spark, str(tmp_path))


@pytest.mark.parametrize("content", ["", HEADER + "\n"])
def test_empty_source(spark, tmp_path, content):
    path = tmp_path / "empty.csv"
    path.write_text(content)
    with pytest.raises(ValueError, match="empty"):
        load_csv(spark, str(path))


def test_long_line_is_an_error_and_short_line_is_filled(spark, csv):
    with pytest.raises(ValueError, match="1 line"):
        load_csv(spark, csv([*LINES, LINES[0] + ",more"]))
    assert load_csv(spark, csv([*LINES, "536367,22632"])).filter("Country is null").count() == 1


def test_latin_text_and_quotes(spark, csv):
    path = csv(['1,A,"SET OF 3, ""RED"" £",6,12/1/2010 8:26,2.5,1.0,Réunion'])
    row = load_csv(spark, path, "latin-1").first()
    assert (row.Description, row.Country) == ('SET OF 3, "RED" £', "Réunion")


def test_line_breaks_in_quotes(spark, csv):
    path = csv(['1,A,"TWO\nLINES",6,12/1/2010 8:26,2.5,1.0,UK'])
    assert load_csv(spark, path, multi_line=True).first().Description == "TWO\nLINES"


def test_inferred_types_and_missing_values_match_pandas(spark, csv):
    cells = {
        "whole": ["1", "-2", "+3"], "gap": ["1", "", "3"], "real": ["1.5", "2", "1e3"], "suffix": ["1d", "2f", "3"],
        "mixed": ["1", "A", "3"], "flag": ["True", "False", "TRUE"], "flaggap": ["True", "", "False"],
        "none": ["", "NA", "nan"], "token": ["NULL", "x", "N/A"], "date": ["12/1/2010", "1/1/2011", "2/1/2011"],
        "infinite": ["inf", "-inf", "1"], "zero": ["007", "008", "009"], "lower": ["none", "NONE", "Null"],
    }
    lines = [",".join(v[i] for v in cells.values()) for i in range(3)]
    path = csv(lines, ",".join(cells))
    df = load_csv(spark, path)
    expected = pd.read_csv(path, encoding="latin-1", low_memory=False)
    assert dict(df.dtypes) == {n: PANDAS_TYPES[str(t)] for n, t in expected.dtypes.items()}
    nulls = df.select([F.count_if(F.col(n).isNull()).alias(n) for n in cells]).first().asDict()
    assert nulls == expected.isnull().sum().to_dict()


def test_declared_schema_fails_on_bad_values(spark, csv):
    schema = spark.createDataFrame([], COLUMNS).schema
    assert load_csv(spark, csv(LINES), schema=schema).count() == 2
    bad = csv([LINES[0].replace(",6,", ",six,")], name="bad.csv")
    with pytest.raises(Exception):
        load_csv(spark, bad, schema=schema).collect()


def test_positions_follow_the_file(spark, csv):
    path = csv([f"{(i * 37) % 100},A,B,{i},d,1.0,1.0,UK" for i in range(100)])
    df = load_csv(spark, path, keep_order=True)
    assert [r.Quantity for r in df.orderBy(POSITION).collect()] == list(range(100))
    rows = {r.name: r for r in profiling.columns_profile(df, order_by=POSITION).collect()}
    assert rows["InvoiceNo"].sample_values == ["0", "37", "74", "11", "48"]


def test_parquet(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(1.0,), (float("nan"),)], "x double").write.parquet(path)
    assert load_parquet(spark, path).filter("x is null").count() == 1
    with pytest.raises(FileNotFoundError):
        load_parquet(spark, path + "-missing")


def test_dataset_info(spark, csv):
    info = dataset_info(load_csv(spark, csv(LINES)))
    assert (info["rows"], info["columns"], info["column_names"]) == (2, 8, NAMES)
    assert info["dtypes"]["Quantity"] == "bigint" and info["data_mb"] == 0.0


def test_mixed_dates_match_pandas(spark):
    values = ["12/1/2010 8:26", "13/1/2010 8:26", "1/13/2010", "12/1/2010 8:26:05", "2010-12-01T08:26:00",
              "2010-12-01 08:26", "2010-12-01", "2010-12", "2010", "not-a-date", "12-01-2010 8:26", "2010/12/01 8:26",
              "20101201", " 12/1/2010 8:26 ", "2010-12-01T08:26:00.123456", "13/13/2010", "2/30/2010",
              "2010-12-1 8:26:1", "12/1/2010 24:00", "536365", "123456-1", "",
              "Dec 1 2010", "December 1, 2010", "1 Dec 2010", "1-Dec-2010", "1-Dec-10", "Dec-01-2010", "2010 Dec 1", "2010-Dec-01",
              "Dec 2010", "2010 Dec", "Wed, 01 Dec 2010 08:26:00", "Wednesday, December 1, 2010 8:26 AM", "12/1/2010 8:26 AM",
              "12/1/2010 12:05 AM", "12/1/2010 12:05 PM", "12/1/2010 8:26:05PM", "12/1/2010 8 PM", "12/1/2010 13:05 PM",
              "12/1/2010 0:05 AM", "12/1/10", "12/1/10 8:26", "1/13/10", "13/1/10", "31/12/99", "75/12/01", "10-12-01", "32-1-2",
              "12.01.2010", "13.01.2010", "1.12.10", "2010.12.01", "01.12.2010 08:26", "20101201 08:26", "20101201T0826",
              "20101201T082605", "20101201082605", "8:26 12/1/2010", "08:26:05 Dec 1 2010", "Dec 1st 2010", "Sept 3 2010", "Sep. 3 2010",
              "2010/13/01", "12/1/2010T08:26", "12/1/2010 8:26 a.m.", "12/1/2010 8:26 p", "1Dec2010", "01DEC2010", "Dec1 2010",
              "May 2010", "31 Feb 2010", "Foo 1 2010", "12/1/2010 8:26:05.25", "Dec 1 2010 8:26:05.5 PM", "2010-12-01 8:26 PM",
              "00/1/2010", "12/1/99", "1/1/69", "Mon Dec 1 2010", "1 December", "12/2010", "2010/12", "12-2010", "Dec 1 10", "1 Dec 99",
              "99 Dec 1", "10 Dec 01", "2/30/10", "12 1 2010", "2010 12 1", "12,1,2010", "1st of Dec 2010", "12/1/2010 at 8:26",
              "12/1/2010 8:26:61", "8 PM", "Dec", "Wed", "12", "3.10.2", "Dec 32 2010", "32 Dec 2010", "Dec 0 2010", "June 5, 2011 1:02pm",
              "THU 10 MAR 2011", "Sat Mar 12 09:15:00 2011", "2011-Mar-12 9:15 am", "July 4 '11x"]
    near = pd.Timestamp.now().year % 100
    values += [f"12/1/{(near + k) % 100:02}" for k in (-51, -50, -49, 0, 48, 49, 50, 51)]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    found = {r.s: r.t for r in df.select("s", parse_date(F.col("s")).alias("t")).collect()}
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for v in values:
            expected = pd.to_datetime(pd.Series([v]), errors="coerce", format="mixed")[0]
            assert found[v] == (None if pd.isna(expected) else expected.to_pydatetime()), v


def test_generated_layouts_match_pandas(spark):
    """Every join of a date layout, a time layout and their order, for dates in all months."""
    days = [pd.Timestamp(2009, m, d, h, 5, 9) for m, d, h in zip(range(1, 13), (1, 13, 31, 2, 28, 12, 30, 3, 11, 25, 9, 22), range(1, 24, 2))]
    dates = ["%b %d %Y", "%d %B %Y", "%B %d, %Y", "%d-%b-%y", "%m.%d.%Y", "%Y %b %d", "%a %d %b %Y", "%m/%d/%y", "%Y.%m.%d"]
    times = ["%I:%M %p", "%H:%M", "%H:%M:%S", "%I:%M:%S%p", "%I %p"]
    values = [at.strftime(f"{d} {t}" if d != "%Y.%m.%d" or "p" not in t else f"{t} {d}") for at in days for d in dates for t in times]
    found = {r.s: r.t for r in spark.createDataFrame([(v,) for v in values], "s string").select("s", parse_date(F.col("s")).alias("t")).collect()}
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        expected = pd.to_datetime(pd.Series(values), errors="coerce", format="mixed")
    wrong = [(v, found[v], e) for v, e in zip(values, expected) if found[v] != (None if pd.isna(e) else e.to_pydatetime())]
    assert wrong == [] and expected.notna().mean() > 0.9


def test_layouts_have_one_shape_each(spark):
    groups = [["Dec 1 2010", "May 31 2011"], ["1/2/2010 8:26 AM", "12/31/2010 10:05 pm"], ["Wed 1 June 2011", "Sun 30 Dec 2012"], ["13/1/2010"],
              ["1.2.10"], ["13.2.10"]]
    rows = [(v, i) for i, g in enumerate(groups) for v in g]
    shapes = spark.createDataFrame(rows, "s string, g int").select("g", date_shape(F.col("s")).alias("shape")).distinct().collect()
    assert len(shapes) == len(groups) and len({r["shape"] for r in shapes}) == len(groups)


def test_further_date_formats(spark):
    df = spark.createDataFrame([("2010|12|01",)], "s string")
    assert df.select(parse_date(F.col("s"))).first()[0] is None
    assert df.select(parse_date(F.col("s"), extra_formats=["yyyy|MM|dd"])).first()[0].month == 12


def test_instants(spark):
    df = spark.createDataFrame([("2026-08-25T12:00:00+00:00",), ("2026-08-25T12:00:00Z",), ("",), (None,)], "s string")
    at = parse_instant(F.col("s"), F.lit("2020-01-01 00:00:00").cast("timestamp"))
    assert [r[0] for r in df.select(F.date_format(at, "yyyy-MM-dd HH")).collect()] == [
        "2026-08-25 12", "2026-08-25 12", "2020-01-01 00", "2020-01-01 00"]
    back = elapsed_seconds(F.lit("2026-01-02").cast("timestamp"), F.lit("2026-01-01").cast("timestamp"))
    assert spark.range(1).select(back).first()[0] == 0.0


def test_exact_sum_keeps_large_values(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (1e16,), (None,)], "x double")
    assert df.filter("x < 1").agg(exact_sum(F.col("x"))).first()[0] == 0.3
    assert df.agg(exact_sum(F.col("x"))).first()[0] == 1e16
    assert df.filter("x is null").agg(exact_sum(F.col("x"))).first()[0] is None


def test_small_helpers(spark):
    assert same_family("int", "bigint") and not same_family("bigint", "double") and same_family("string", "string")
    text = "it's 100% \\ 'quoted'"
    assert spark.sql(f"select {text_literal(text)}").first()[0] == text


# Workbooks ---------------------------------------------------------------------------------------

def workbook_bytes(rows, sheet="Online Retail", styles=True):
    """A minimal workbook; cells are text, numbers, or ("date", serial)."""
    shared, body = [], []
    for r, row in enumerate(rows, 1):
        cells = []
        for c, value in enumerate(row):
            at = f'r="{chr(65 + c)}{r}"'
            if value is None:
                continue
            if isinstance(value, tuple):
                cells.append(f'<c {at} s="1"><v>{value[1]}</v></c>')
            elif isinstance(value, str):
                shared.append(value)
                cells.append(f'<c {at} t="s"><v>{len(shared) - 1}</v></c>')
            else:
                cells.append(f"<c {at}><v>{value}</v></c>")
        body.append(f'<row r="{r}">{"".join(cells)}</row>')
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    files = {
        "xl/workbook.xml": f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="{sheet}" sheetId="1" r:id="rId1"/>'
                           "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst {main}>' + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>",
        "xl/styles.xml": f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f"<worksheet {main}><sheetData>{''.join(body)}</sheetData></worksheet>",
    }
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as book:
        for name, text in files.items():
            book.writestr(name, text)
    return buffer.getvalue()


SHEET = [NAMES, ["536365", "85123A", "HEART", 6, ("date", 40513.3513888889), 2.55, 17850, "United Kingdom"],
         ["C536366", "71053", None, -2, ("date", 40513.3527777778), 3, None, "France"]]


def test_workbook(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook_bytes(SHEET))
    df = load_excel(spark, str(tmp_path / "a.xlsx"))
    assert dict(df.dtypes) == {
        "InvoiceNo": "string", "StockCode": "string", "Description": "string", "Quantity": "bigint",
        "InvoiceDate": "timestamp_ntz", "UnitPrice": "double", "CustomerID": "double", "Country": "string"}
    first, second = df.orderBy("InvoiceNo").collect()
    assert first.InvoiceDate.isoformat() == "2010-12-01T08:26:00" and first.CustomerID == 17850.0
    assert (second.InvoiceNo, second.Description, second.CustomerID) == ("C536366", None, None)


def test_folder_of_workbooks(spark, tmp_path):
    for name in "abc":
        (tmp_path / f"{name}.xlsx").write_bytes(workbook_bytes(SHEET))
    assert load_excel(spark, str(tmp_path)).count() == 6
    (tmp_path / "d.xlsx").write_bytes(workbook_bytes([["Other"], ["x"]]))
    with pytest.raises(ValueError, match="different headers"):
        load_excel(spark, str(tmp_path))


def test_workbook_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_excel(spark, str(tmp_path / "missing.xlsx"))
    (tmp_path / "a.xlsx").write_bytes(workbook_bytes(SHEET, sheet="Other"))
    with pytest.raises(ValueError, match="not found"):
        load_excel(spark, str(tmp_path / "a.xlsx"))
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    with pytest.raises(ValueError):
        load_excel(spark, str(tmp_path / "b.xlsx"))


@pytest.mark.parametrize("schema", [None, "A string, B string"])
def test_headers_in_another_order_are_an_error(spark, tmp_path, schema):
    (tmp_path / "1.csv").write_text("A,B\nx,y\n")
    (tmp_path / "2.csv").write_text("B,A\nz,w\n")
    with pytest.raises(Exception, match="(?i)header"):
        load_csv(spark, str(tmp_path), schema=schema and T.StructType.fromDDL(schema)).collect()


@pytest.mark.parametrize("text", ['A,B,C\n1,"two\nlines",3\n4,5,6\n', 'A,B,C\n1,2,"two\nlines"\n', 'A,B,C\n"o\nn\ne",2,3\n'])
def test_line_breaks_in_quotes_are_read_or_refused(spark, tmp_path, text):
    path = tmp_path / "quoted.csv"
    path.write_text(text)
    with pytest.raises(ValueError, match="multi_line"):
        load_csv(spark, str(path))
    assert load_csv(spark, str(path), multi_line=True).count() == len(list(csv_rows(io.StringIO(text)))) - 1
    with pytest.raises(Exception):
        load_csv(spark, str(path), schema=T.StructType.fromDDL("A string, B string, C string")).collect()
