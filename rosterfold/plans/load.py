"""From yearly workbooks of sheets to one typed, stacked table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterfold.functions.columns import literal, quoted
from rosterfold.operators.merge import check_names, fold, narrowed, outer_merge, stack_years
from rosterfold.operators.projection import coerce_types
from rosterfold.operators.roster import Roster, key_cleanup
from rosterfold.sources.sheets import WORKBOOK, scan_workbook, scan_years


def load_stacked(
    sheets: Mapping[str, DataFrame],
    key: str,
    text_columns: Sequence[str],
    roster: Roster | None = None,
    year_column: str = "ReportingYear",
    placeholder: str = "^-,$",
) -> DataFrame:
    """One row per organisation and year from sheets that each hold all years, told apart by ``WORKBOOK``.

    The year is part of the merge's key, so the plan has one scan for each sheet and one
    shuffle, however many years there are. Cells are coerced before the merge, so numbers are merged as numbers.
    Organisations that are missing from the sheet with the year column get the
    year of the workbook; a sheet that states another year stops the job.
    """
    text = [key, year_column, WORKBOOK, *text_columns]
    return _merged({name: key_cleanup(coerce_types(df, text), key, placeholder) for name, df in sheets.items()}, key, roster, year_column)


def _merged(clean: Mapping[str, DataFrame], key: str, roster: Roster | None, year_column: str) -> DataFrame:
    keys = [WORKBOOK, key]
    return _dated(fold(narrowed(clean, keys, roster, roster_key=key), keys), year_column)


def _dated(merged: DataFrame, year_column: str) -> DataFrame:
    """The workbook's year as ``year_column``, which may not state another one."""
    if year_column not in merged.columns:
        return merged.withColumnRenamed(WORKBOOK, year_column)
    stated = quoted(year_column)
    wrong = f"concat('workbook ', {WORKBOOK}, ' holds rows of year ', {stated})"
    checked = (
        f"IF({stated} IS NULL OR {stated} = {WORKBOOK}, {WORKBOOK},"
        f" CAST(raise_error({wrong}) AS STRING))"
    )
    return merged.withColumn(year_column, F.expr(checked)).drop(WORKBOOK)


def load_all_years(
    workbooks: Mapping[str, Mapping[str, DataFrame]],
    key: str,
    text_columns: Sequence[str],
    roster: Roster | None = None,
    year_column: str = "ReportingYear",
    placeholder: str = "^-,$",
    unique_keys: bool = True,
) -> DataFrame:
    """Every year loaded: each sheet is stacked over the years first, and all are merged at once.

    With ``unique_keys=False`` every year is merged by chained joins of its own.
    """
    if not unique_keys:
        return stack_years(
            [_joined_year(sheets, str(year), key, text_columns, roster, year_column, placeholder) for year, sheets in workbooks.items()]
        )
    by_sheet: dict[str, list[DataFrame]] = {}
    text = [key, year_column, *text_columns]
    for year, sheets in workbooks.items():
        check_names({name: df.columns for name, df in sheets.items()}, [key])
        for name, df in sheets.items():
            # coerced before they are stacked: a cell may be text in one year and a number in another
            clean = key_cleanup(coerce_types(df, text), key, placeholder)
            by_sheet.setdefault(name, []).append(clean.withColumn(WORKBOOK, F.expr(literal(str(year)))))
    return _merged({name: stack_years(frames) for name, frames in by_sheet.items()}, key, roster, year_column)


def load_year(
    sheets: Mapping[str, DataFrame],
    year: str,
    key: str,
    text_columns: Sequence[str],
    roster: Roster | None = None,
    year_column: str = "ReportingYear",
    placeholder: str = "^-,$",
    unique_keys: bool = True,
) -> DataFrame:
    """One row per organisation of the roster, all sheets of one year side by side."""
    return load_all_years({year: sheets}, key, text_columns, roster, year_column, placeholder, unique_keys)


def _joined_year(sheets, year, key, text_columns, roster, year_column, placeholder) -> DataFrame:
    text = [key, year_column, *text_columns]
    clean = {name: key_cleanup(coerce_types(df, text), key, placeholder) for name, df in sheets.items()}
    merged = outer_merge(clean, key, roster, unique_keys=False)
    return _dated(merged.withColumn(WORKBOOK, F.expr(literal(year))), year_column)


def scan_all_years(
    spark: SparkSession,
    year_files: Mapping[str, str],
    info_sheet: str,
    info_columns: Sequence[str],
    table_sheets: Mapping[str, Iterable[int] | None],
    key: str,
    fmt: str = "parquet",
) -> dict[str, dict[str, DataFrame]]:
    """The sheets of every workbook in a year registry."""
    return {
        year: scan_workbook(spark, path, info_sheet, info_columns, table_sheets, key, fmt)
        for year, path in year_files.items()
    }


def scan_stacked(
    spark: SparkSession,
    year_files: Mapping[str, str],
    info_sheet: str,
    info_columns: Sequence[str],
    table_sheets: Mapping[str, Iterable[int] | None],
    key: str,
    fmt: str = "parquet",
) -> dict[str, DataFrame]:
    """Each sheet over all years of a registry, with ``WORKBOOK``: one scan for years whose sheet has the same columns."""
    found = {info_sheet: scan_years(spark, year_files, info_sheet, key, fmt, columns=info_columns)}
    for sheet, positions in table_sheets.items():
        found[sheet] = scan_years(spark, year_files, sheet, key, fmt, positions=positions)
    for year in year_files:
        check_names({sheet: columns[year] for sheet, (_, columns) in found.items()}, [key])
    return {sheet: df for sheet, (df, _) in found.items()}
