import itertools
import random

from pyspark.sql import functions as F

from axleyard.functions import scalars as X
from axleyard.sources import files as Z


def plain_split(line):
    """The fields of a line, a character at a time."""
    out, now, inside, i = [], "", False, 0
    while i < len(line):
        c = line[i]
        if c == '"':
            if inside and line[i + 1 : i + 2] == '"':
                now += '"'
                i += 1
            else:
                inside = not inside
        elif c == "," and not inside:
            out.append(now)
            now = ""
        else:
            now += c
        i += 1
    return [*out, now]


def test_csv_lines(spark):
    rng = random.Random(1)
    lines = ["", ",", '"', '""', 'a,"b,c",d', '"a""b",c', 'x"y"z,1', '"open, to the end'] + ["".join(rng.choice('ab,"  ') for _ in range(rng.randrange(14))) for _ in range(1500)]
    got = spark.createDataFrame([(i, l) for i, l in enumerate(lines)], "i int, l string").select("i", Z.parse_csv_line(F.col("l")).alias("f")).collect()
    for r in got:
        assert r.f == plain_split(lines[r.i]), lines[r.i]


AWKWARD = (
    "preamble\r\n\r\n﻿Transaction Effective Date,Card Number,Litres,Customer Value ($),Product,Vehicle Description,Product\r\n"
    '3/7/2026, C1 ,"1,234.50",2000,x,"Hino ""big""",NZ Diesel\r\n\r\n,,,,\r\n31/02/2026,C2,10,20,x,y,NZ AdBlue\r\n3/7/26,null,10,$12.00\r\n1/1/2026,C3,10,5,x,y,NZ Unleaded,long,row'
)


def records(spark, raw):
    files = spark.createDataFrame([(1, raw)], "import_id int, raw_csv string")
    r = Z.rows_to_record(Z.detect_format(files))
    return [x.asDict() for x in r.select("format", "pos", "rec").orderBy("pos").collect()]


def test_awkward_file(spark):
    got = records(spark, AWKWARD)
    assert [g["format"] for g in got] == ["bp_transaction"] * 4 and [g["pos"] for g in got] == [3, 6, 7, 8]
    assert got[0]["rec"]["Card Number"] == "C1" and got[0]["rec"]["Litres"] == "1,234.50" and got[0]["rec"]["Vehicle Description"] == 'Hino "big"'
    assert got[0]["rec"]["Product"] == "NZ Diesel"  # a repeated header: the last column
    assert got[2]["rec"]["Product"] == ""  # a short row
    assert records(spark, "nothing,known\n1,2") == [] and records(spark, "") == []


def test_header_limits(spark):
    idle = "Vehicle,IdleStart,IdleEnd,Duration\n"
    files = spark.createDataFrame([(1, "\n" * 9 + idle), (2, "\n" * 10 + idle)], "import_id int, raw_csv string")
    assert {r.import_id: r.format for r in Z.detect_format(files).collect()} == {1: "idle", 2: "unknown"}


def test_raw_files_and_archive(spark, tmp_path):
    (tmp_path / "f 1.csv").write_text("a\nb\n")
    r = Z.read_raw_files(spark, f"file://{tmp_path}").collect()
    assert [(x.filename, x.raw_csv) for x in r] == [("f 1.csv", "a\nb\n")] and r[0].received_at
    df = spark.createDataFrame([("a.CSV", None), ("x", "text/csv"), ("b.xlsx", None), ("c.pdf", "application/pdf"), (None, None)], "n string, m string")
    assert [x.k for x in df.select(Z.attachment_kind(F.col("n"), F.col("m")).alias("k")).collect()] == ["csv", "csv", "xls", None, None]


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first().r


def test_scalars(spark):
    for text, want in [("12.5abc", 12.5), ("5.", 5.0), (".5", 0.5), ("1e", 1.0), ("$12", None), ("1 234", 1.0), ("", None), (None, None), ("1,234", 1234.0), ("-3", -3.0), (" 7\t", 7.0)]:
        assert one(spark, text, X.parse_numeric) == want, text
    assert one(spark, "$1,234.50", X.parse_currency) == 1234.5
    days = [(t, str(one(spark, t, X.parse_dmy))) for t in ("3/7/2026", "31/02/2026", "3/7/26", " 03/07/2026 ", "2026-07-03")]
    assert [d for _, d in days] == ["2026-07-03", "None", "None", "2026-07-03", "None"]
    assert str(one(spark, "03/07/2026 23:59", X.parse_dmy_datetime)) == "2026-07-03"
    kinds = {"Kenworth truck": "Semi Trailer", "Truck ute": "Rigid Truck", "Card ••••1234": "Rigid Truck", "my car": "Light Vehicle", "route 7": "Light Vehicle", "CAT Dozer": "Bulldozer", None: "Rigid Truck", "Scraper": "Other"}
    for name, kind in kinds.items():
        assert one(spark, name, X.detect_asset_type) == kind, name
    assert one(spark, " Ann & Sons  Ltd.-", X.slugify) == "ann-sons-ltd"
    assert one(spark, "Fleet <A.B@C.com> ", X.email_address) == "a.b@c.com"


def test_factors(spark):
    df = spark.createDataFrame([("Electric", 0.0, "Crane"), (None, None, "Nothing"), ("Petrol", 2.0, None)], "f string, r double, t string")
    got = df.select(X.emission_factor(F.col("f")).alias("f"), X.default_idle_rate(F.col("r"), F.col("t")).alias("r")).collect()
    assert [(x.f, x.r) for x in got] == [(0.0, 4.5), (2.68, 3.0), (2.31, 2.0)]


def test_large_files_are_read_by_ranges(spark, tmp_path):
    head = "Card report\r\n\r\nTransaction Effective Date,Card Number,Litres,Customer Value ($),Product,\"Vehicle Description\"\r\n,,,,\r\n"
    line = lambda k: f'{k % 28 + 1}/3/2024, C{k},{k / 4},"1,{k % 900 + 100}","NZ ""Diesel""",Käfer {k} €\r\n'
    (tmp_path / "big one.csv").write_bytes(("﻿" + head + "".join(map(line, range(20_000)))).encode())
    (tmp_path / "miles.csv").write_text("Vehicle,ActivityDate,ActualDistance\nV5,01/01/2024,10\n   \nV5,02/01/2024, 7 ")
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    (tmp_path / "empty.csv").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    whole = Z.rows_to_record(Z.detect_format(Z.read_raw_files(spark, f"file://{tmp_path}").withColumn("import_id", F.lit(1))))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = Z.read_report_rows(spark, f"file://{tmp_path}")
        assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 10
        place = lambda df: [(r.filename, r.format, tuple(sorted(r.rec.items()))) for r in df.orderBy("filename", "pos").select("filename", "format", "rec").collect()]
        rows = place(got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert rows == place(whole) and len(rows) == 20_002
    assert dict(rows[19_999][2])["Vehicle Description"] == "Käfer 19999 €" and dict(rows[5][2])["Product"] == 'NZ "Diesel"'


def test_lines_of_any_quotes_equal_a_scan(spark):
    lines = ["".join(t) for n in range(7) for t in itertools.product('a,"', repeat=n)] + ['"' + '""' * 100_000 + ',x",y', '"\r,￿"￾,z']
    rows = spark.createDataFrame([(t,) for t in lines], "line string").select("line", Z.parse_csv_line(F.col("line")).alias("f")).collect()
    for r in rows:
        assert r.f == plain_split(r.line), r.line[:20]


def test_numbers_behind_white_space_and_commas(spark):
    cases = {"1,234.5x": 1234.5, "﻿ \t7": 7.0, " ,+.5e1 ": 5.0, "x1": None, "": None, "1 2": 1.0, "-3.": -3.0, "$4": None, None: None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.parse_numeric(F.col("t")).alias("n"), X.parse_currency(F.concat(F.lit("$ "), "t")).alias("c")).collect()
    for r in rows:
        assert r.n == cases[r.t]
        assert r.c == (4.0 if r.t == "$4" else cases[r.t])


def test_reports_are_one_file_each_and_found_in_folders(spark, tmp_path):
    from axleyard.plans.ingest import _delivered

    files = spark.createDataFrame([(i, f"a,b\r\n{i},2\r\n") for i in range(40)], "import_id long, raw_csv string").repartition(3, "import_id")
    _delivered(files, f"file://{tmp_path}/in")
    made = [p for p in (tmp_path / "in").rglob("*") if p.is_file() and p.name != "_SUCCESS"]
    assert len(made) == 40 and not any(p.name.endswith(".crc") for p in made)
    assert len({p.parent for p in made}) == 40
    got = Z.read_raw_files(spark, f"file://{tmp_path}/in")
    assert got.columns == ["filename", "received_at", "raw_csv"] and sorted(r.raw_csv.split()[1] for r in got.collect()) == sorted(f"{i},2" for i in range(40))


def test_cells_are_what_the_map_holds(spark):
    """Short, long and blank rows, white space of all kinds, repeated and empty names: single columns by place equal those by name."""
    head = "Transaction Effective Date, Card Number ,Litres,Customer Value ($),Vehicle Description,Product,,Product"
    body = ['1/2/2024,C1,"1,2",3,"a ""b""\u3000",p,x,last', "1/2/2024,\u00a0C2\ufeff,5", " , ,\u2003,", ",,,,,,,,extra", "é ,1,2,3, d\u00e9 ,p,x,\u00a0q,r,s", "\u00a0,C"]
    files = spark.createDataFrame([(1, "\ufeff" + head + "\r\n" + "\r\n".join(body))], "import_id long, raw_csv string")
    r = Z.rows_to_record(Z.detect_format(files))
    names = [n.strip() for n in head.split(",") if n] + ["Missing"]
    got = r.orderBy("pos").select("pos", F.array(*map(Z.cell, names)).alias("c"), F.array(*map(Z.field, names)).alias("f")).collect()
    assert [x.pos for x in got] == [1, 2, 4, 5, 6] and all(x.c == x.f for x in got), got
    assert got[0].c[-2] == "last" and got[1].c[1] == "C2" and got[1].c[4] == "" and got[0].c[-1] is None
