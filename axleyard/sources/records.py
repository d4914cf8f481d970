"""Typed rows of each report format, from raw text. ``files``: FILE_COLUMNS and raw_csv; every row keeps import_id, user_id, received_at, pos and rec."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import scalars as X
from .files import FILE_COLUMNS, cell, cell_at, detect_format, field, rows_by_place, rows_to_record

#: Columns of records that are kept for later steps.
KEPT = (*FILE_COLUMNS, "format", "pos", "rec")
Field = Callable[[str], Column]


def _number(value: Column) -> Column:
    return X.parse_numeric(value)


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def recorded(files: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Every row below a known header, of all formats: FILE_COLUMNS, format, pos, rec, and cells and at (see rows_to_record). Files of no known format give none.

    ``files`` may come with format and header_pos already.
    """
    return rows_to_record(files if "header_pos" in files.columns else detect_format(files, order)).select(*KEPT, "cells", "at")


def mileage(r: DataFrame, field: Field = field) -> DataFrame:
    return r.withColumns({"vehicle_name": field("Vehicle"), "registration": _text(field("Registration")), "record_date": X.parse_dmy(field("ActivityDate")), "distance": _number(field("ActualDistance"))})


def idle(r: DataFrame, field: Field = field) -> DataFrame:
    return r.withColumns({"vehicle_name": field("Vehicle"), "registration": _text(field("Registration")), "record_date": X.parse_dmy_datetime(field("IdleStart")), "duration": _number(field("Duration")), "unit": field("Unit")})


def exec_summary(r: DataFrame, field: Field = field) -> DataFrame:
    """Executive summaries hold a day each, which the file's name tells; the daily distance stands under the ignition time's name."""
    return r.withColumns({
        "vehicle_name": field("VehicleName"), "registration": _text(field("Registration")), "record_date": X.record_date_from_filename(F.col("filename"), F.col("received_at")),
        "total_minutes": _number(field("TotalHours")), "idle_minutes": _number(field("IdleTime")), "distance": _number(field("AverageDailyIgnitionTime")),
    })


def bp(r: DataFrame, field: Field = field) -> DataFrame:
    """Plain and transaction exports: card, day, litres, cost, product, and what may name the vehicle."""
    return r.withColumns({
        "card": X.card(field("Card Number")), "purchase_date": X.parse_dmy(field("Transaction Effective Date")), "litres": _number(field("Litres")), "cost": F.when(F.col("format") == "bp", X.parse_currency(field("Customer Value ($)"))).otherwise(_number(field("Customer Value ($)"))), "gst": _number(field("Tax")),
        "product": field("Product"), "description": _text(field("Vehicle Description")), "driver": _text(field("Driver Name")), "registration": _text(field("Vehicle Registration Number")), "odometer": _number(field("Transaction Odometer Reading")),
    })


def mobil(r: DataFrame, field: Field = field) -> DataFrame:
    return r.withColumns({
        "card": X.card(field("Card No.")), "purchase_date": X.parse_dmy(field("Transaction Date")), "litres": _number(field("Quantity")), "total": _number(field("Total")), "gst": _number(field("GST")), "product": field("Product Description"),
        "description": _text(field("Description")), "odometer": _number(field("Odometer")),
    })


#: format: its mapper
MAPPERS: dict[str, Callable[[DataFrame, Field], DataFrame]] = {"mileage": mileage, "idle": idle, "exec_summary": exec_summary, "bp_transaction": bp, "bp": bp, "mobil": mobil}


def typed_rows(files: DataFrame, name: str) -> DataFrame:
    """The rows of ``files`` (with format and header_pos) of one format: FILE_COLUMNS, format, pos, header, cells and its typed columns, in one pass and without a map of each row."""
    own, names = files.filter(F.col("format") == name), []
    MAPPERS[name](own, lambda n: F.lit(names.append(n)).cast("string"))  # only to hear the names
    rows = rows_by_place(own.select(*FILE_COLUMNS, "format", "header_pos", "raw_csv"), names)
    # the one-row inline has each cell trimmed once, however often its column reads it
    values = F.struct(*(cell_at(F.col(f"_at_{k}")).alias(f"_v_{k}") for k in range(len(names))))
    rows = rows.select(*FILE_COLUMNS, "format", "pos", "header", "cells", F.inline(F.array(values)))
    return MAPPERS[name](rows, lambda n: F.col(f"_v_{names.index(n)}")).drop(*(f"_v_{k}" for k in range(len(names))))


def typed(records: DataFrame, name: str) -> DataFrame:
    """The rows of one format of ``records`` (see recorded), with its typed columns."""
    if name not in S.SIGNATURES:
        raise ValueError(name)
    rows = records.filter(F.col("format") == name)
    return MAPPERS[name](rows, cell).drop("cells", "at") if "cells" in rows.columns else MAPPERS[name](rows, field)
