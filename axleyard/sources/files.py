"""Delivered files: reading, format detection, splitting into typed rows, archive and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import scalars as X

#: Columns that every per-file step keeps.
FILE_COLUMNS = ("import_id", "user_id", "filename", "received_at")
#: How many small files are written: tasks move them in place themselves (else the driver moves them all, one by one).
#: On a local disk Hadoop starts a process for each file that it makes, so no second file holds checksums.
MANY_FILES = {"mapreduce.fileoutputcommitter.algorithm.version": "2", "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def read_raw_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file in ``path`` and all folders below: its name, when it came, its whole text. A file is one row, so files must fit a task."""
    # folders below are looked through, in parallel where they are many; their names are no columns
    f = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(
        F.url_decode("_metadata.file_name").alias("filename"), F.col("_metadata.file_modification_time").alias("received_at"), F.col("value").alias("raw_csv")
    )
    return f


def attachment_kind(filename: Column, mime: Column) -> Column:
    """csv, xls or null, by the name's ending or the MIME type."""
    name, m = F.lower(F.coalesce(filename, F.lit(""))), F.lower(F.coalesce(mime, F.lit("")))
    return F.when(F.endswith(name, F.lit(".csv")) | m.isin(S.CSV_MIME), "csv").when(name.rlike(r"\.xlsx?$") | m.isin(S.XLS_MIME), "xls")


def archive_raw(files: DataFrame, content: str = "content", kind: str = "kind") -> DataFrame:
    """``raw_csv`` as it is stored: CSV as text, spreadsheets as base64 behind a mark; status pending."""
    b64 = F.regexp_replace(F.base64(content), r"[\r\n]", "")
    return files.withColumn("raw_csv", F.when(F.col(kind) == "xls", F.concat(F.lit("BASE64_XLS:"), b64)).otherwise(F.decode(content, "UTF-8"))).withColumn("status", F.lit("pending"))


#: What quotes enclose, up to the line's end where they stay open, and a field behind its comma. Possessive: a line is read once, in a bounded stack.
_QUOTED = r'"((?:[^"]++|"")*+)(?:"|\z)'
#: A line whose quotes all close, hold no comma and no quote: without its quotes it splits at its commas.
_PLAINLY_QUOTED = r'^[^"]*+(?:"[^",]*+"(?!")[^"]*+)*+\z'
_FIELD = r',((?:[^",]++|"(?:[^"]++|"")*+(?:"|\z))*+)'


def parse_csv_line(line: Column) -> Column:
    """The fields of a line: "" inside quotes is a quote, quotes toggle anywhere, an open quote takes the rest."""
    bare = lambda f: F.when(F.contains(f, F.lit('"')), F.replace(F.regexp_replace(f, _QUOTED, "$1"), F.lit('""'), F.lit('"'))).otherwise(f)
    quoted = F.transform(F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_FIELD), F.lit(1)), bare)
    return F.when(~F.contains(line, F.lit('"')), F.split(line, ",", -1)).when(line.rlike(_PLAINLY_QUOTED), F.split(F.replace(line, F.lit('"')), ",", -1)).otherwise(quoted)


def normalize_header(fields: Column) -> Column:
    return F.transform(fields, X.js_trim)  # a byte order mark is white space there


def lines_of(raw: Column) -> Column:
    """Lines end with a line feed and a carriage return before it, if there is one. One character splits without a regular expression."""
    return F.split(F.replace(raw, F.lit("\r\n"), F.lit("\n")), "\n", -1)


def first_lines(raw: Column) -> Column:
    """As many as any header may be behind."""
    most = max(limit for _, limit in S.SIGNATURES.values())
    return F.slice(F.split(raw, "\r?\n", most + 1), 1, most)


def _cells(lines: DataFrame) -> DataFrame:
    """``lines`` (line, ...) with ``cells``, their fields as they stand; lines without anything in them go.

    The one-row inline keeps the optimiser from parsing a line again where the filter looks at its fields.
    """
    cells = parse_csv_line(F.col("line"))
    # where the first character tells, nothing is trimmed
    holds = lambda f: F.ascii(f).between(33, 126) | (X.js_trim(f) != "")
    return lines.select("*", F.inline(F.array(F.struct(cells.alias("cells"))))).filter(F.exists("cells", holds))


def split_lines(files: DataFrame, raw: str = "raw_csv") -> DataFrame:
    """One row per line that holds something: ``pos``, ``line``, ``fields`` (trimmed)."""
    return _lines(files, raw).withColumn("fields", F.transform("cells", X.js_trim)).drop("cells")


def _lines(files: DataFrame, raw: str) -> DataFrame:
    cols = [c for c in files.columns if c != raw]
    return _cells(files.select(*cols, F.posexplode(lines_of(F.col(raw))).alias("pos", "line")))


def header_position(heads: Column, signature: list[str], limit: int) -> Column:
    """The first of ``limit`` parsed lines that holds all of ``signature``; null where none does."""
    want = F.array(*map(F.lit, signature))
    at = F.transform(F.slice(heads, 1, limit), lambda l, i: F.when(F.size(F.array_except(want, l)) == 0, i))
    return F.array_min(at)


def detect_format(files: DataFrame, order: list[str] | None = None, raw: str = "raw_csv") -> DataFrame:
    """``format`` (first of ``order`` whose signature a line holds; 'unknown') and ``header_pos``. One row per file, no shuffle.

    The first lines are parsed once and held against all signatures; the one-row inline keeps filters on the format from detecting it again.
    """
    out = files.withColumn("_heads", F.transform(first_lines(F.col(raw)), lambda l: normalize_header(parse_csv_line(l))))
    out = out.withColumns({f"_at_{name}": header_position(F.col("_heads"), signature, limit) for name, (signature, limit) in S.SIGNATURES.items()})
    found = dispatch_format(out, order or S.MAIL_ORDER)
    return found.select(*files.columns, F.inline(F.array(F.struct("format", "header_pos"))))


def dispatch_format(matched: DataFrame, order: list[str]) -> DataFrame:
    """``format`` and ``header_pos`` by priority, from the columns _at_<format>."""
    name, pos = F.lit(None).cast("string"), F.lit(None).cast("int")
    for n in reversed(order):
        here = F.col(f"_at_{n}").isNotNull()
        name, pos = F.when(here, n).otherwise(name), F.when(here, F.col(f"_at_{n}")).otherwise(pos)
    return matched.withColumn("format", F.coalesce(name, F.lit("unknown"))).withColumn("header_pos", pos)


def classify_unknown(raw: Column) -> tuple[Column, Column]:
    """(category, header line) of a file of no known format: keyword hits in the first line that holds something."""
    header = F.coalesce(F.get(F.filter(F.slice(lines_of(raw), 1, 30), lambda l: X.js_trim(l) != ""), F.lit(0)), F.lit(""))
    low = F.lower(header)
    scores = {}
    for name, words in S.UNKNOWN_KEYWORDS.items():
        score = F.lit(0)
        for w in words:
            score = score + F.contains(low, F.lit(w)).cast("int")
        scores[name] = score
    best = F.greatest(*scores.values())
    category = F.when(best < 2, "unknown")
    for name, score in scores.items():
        category = category.when(score == best, name)
    return category, header


def rows_to_record(files: DataFrame, raw: str = "raw_csv") -> DataFrame:
    """Rows below each file's header as ``pos`` and ``rec`` (map): missing values '', a repeated header's last column wins.

    ``cells`` and ``at`` (a header's places) hold the same for readers of single columns, which need no map of each row (see cell).
    Needs spark.sql.mapKeyDedupPolicy=LAST_WIN (see session.SETTINGS).
    """
    header = normalize_header(parse_csv_line(F.get(lines_of(F.col(raw)), F.col("header_pos"))))
    # coalesce: a plain comparison makes the optimiser test header_pos for null first, which detects the format twice
    below = F.col("pos") > F.coalesce("header_pos", F.lit(2**31 - 1))
    return _records(_lines(_placed(files.withColumn("header", header)), raw).filter(below))


def place_of(header: Column, name: str) -> Column:
    """The last place (from 0) of ``name`` in ``header``; null where it is not there."""
    back = F.array_position(F.reverse(header), F.lit(name)).cast("int")
    return F.when(back > 0, F.size(header) - back)


def rows_by_place(files: DataFrame, names: list[str], raw: str = "raw_csv") -> DataFrame:
    """Rows below each file's header as ``pos``, ``header`` and ``cells``, and for the k-th of ``names`` its place ``_at_k``: found once a file, no map."""
    header = normalize_header(parse_csv_line(F.get(first_lines(F.col(raw)), F.col("header_pos"))))
    heads = files.filter("header_pos is not null").select("*", F.inline(F.array(F.struct(header.alias("header")))))
    return _lines(heads.withColumns({f"_at_{k}": place_of(F.col("header"), n) for k, n in enumerate(names)}), raw).filter("pos > header_pos").drop("line", "header_pos")


def _placed(heads: DataFrame) -> DataFrame:
    """``heads`` with the last place of each name in ``header``: once for each file."""
    return heads.withColumn("at", F.map_from_arrays("header", F.transform("header", lambda h, i: i)))


def _records(body: DataFrame) -> DataFrame:
    """Rows (header, cells, ...) as ``rec``."""
    body = body.withColumn("fields", F.transform("cells", X.js_trim))
    return body.withColumn("rec", record_of(F.col("header"), F.col("fields"))).drop("header", "fields", "line")


def record_of(header: Column, fields: Column) -> Column:
    """A row's ``fields`` by name (see rows_to_record)."""
    short = F.greatest(F.size(header) - F.size(fields), F.lit(0))
    padded = F.slice(F.concat(fields, F.array_repeat(F.lit(""), short)), F.lit(1), F.size(header))
    whole = F.map_from_arrays(header, F.when(F.size(fields) == F.size(header), fields).otherwise(padded))
    return F.when(F.array_contains(header, F.lit("")), F.map_filter(whole, lambda k, v: k != "")).otherwise(whole)


def read_report_rows(spark: SparkSession, path: str, order: list[str] | None = None) -> DataFrame:
    """Rows of report files of any size under ``path``, as rows_to_record has them: filename, received_at, format, ``pos``, ``rec``.

    A file is read by byte ranges (spark.sql.files.maxPartitionBytes), each by a task of its own; ``pos`` grows with the
    place of a line in its file. Only the first lines of each file are looked at for its format and header, and these
    travel to the ranges. Files of no known format give no rows.
    """
    at = F.col("_metadata.file_block_start")
    # ranges start at multiples of 4 KB at least, and hold fewer lines than 2**31
    place = F.shiftleft(F.shiftright(at, 12), 31).bitwiseOR(F.monotonically_increasing_id().bitwiseAND(F.lit(2**31 - 1)))
    text = spark.read.option("lineSep", "\n").text(path)
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.url_decode("_metadata.file_name").alias("filename"), F.col("_metadata.file_modification_time").alias("received_at"), at.alias("start"), place.alias("pos"), F.regexp_replace("value", "\r$", "").alias("line"))
    most = max(limit for _, limit in S.SIGNATURES.values())
    # a few lines a file; a window that asks for the first few keeps no more than these in each task
    first = Window.partitionBy("file").orderBy("pos")
    heads = lines.filter("start = 0").select("file", "pos", "line").withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= most)
    heads = heads.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    heads = detect_format(heads.withColumn("raw_csv", F.array_join(F.transform("ls", lambda x: x["line"]), "\n")), order).filter("format <> 'unknown'")
    head = F.get("ls", F.col("header_pos"))
    heads = heads.select("file", "format", head["pos"].alias("_from"), normalize_header(parse_csv_line(head["line"])).alias("header"))
    body = lines.join(_placed(heads), "file").filter("pos > _from").select("filename", "received_at", "format", "pos", "header", "at", "line")
    return _records(_cells(body))


def field(name: str) -> Column:
    return F.try_element_at(F.col("rec"), F.lit(name))


def cell(name: str) -> Column:
    """As field, from ``cells`` and ``at``."""
    return cell_at(F.try_element_at(F.col("at"), F.lit(name)))


def cell_at(at: Column) -> Column:
    """The cell at a place, trimmed: null where there is no place, empty where the row is short."""
    value = F.get("cells", at)
    # most have nothing to trim, which their ends tell
    plain = F.ascii(value).between(33, 126) & F.ascii(F.right(value, F.lit(1))).between(33, 126)
    return F.when(at.isNotNull(), F.when(plain, value).otherwise(F.coalesce(X.js_trim(value), F.lit(""))))


def read_oem_csv(spark: SparkSession, path: str) -> DataFrame:
    """Generic machine uploads, with a fixed schema; an empty odometer is null."""
    return spark.read.schema(S.OEM_UPLOAD).option("header", True).csv(path)


def emissions_export(daily: DataFrame) -> DataFrame:
    """The daily emissions table as text with two decimals, and the asset's file slug."""
    two = lambda c: F.format_string("%.2f", F.col(c))
    return daily.select(
        X.file_slug(F.col("asset_name")).alias("asset_slug"), F.date_format("record_date", "yyyy-MM-dd").alias("Date"), two("litres").alias("Fuel (L)"), two("operating_kg").alias("Operating CO2 (kg)"), two("idle_kg").alias("Idle CO2 (kg)"), two("kg").alias("Total CO2 (kg)"), two("cumulative_kg").alias("Cumulative CO2 (kg)")
    )


def export_daily_csv(daily: DataFrame, path: str) -> None:
    """One folder of CSV per asset."""
    emissions_export(daily).write.mode("overwrite").options(**MANY_FILES).option("header", True).partitionBy("asset_slug").csv(path)
