"""Scanning sheets.

A workbook is a directory per year that holds one Parquet or CSV dataset per
sheet. Types are never inferred: Parquet brings its own, CSV is read as text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rosterfold.functions.columns import col_q, literal, named, quoted, require_columns
from rosterfold.functions.numbers import to_text
from rosterfold.operators.merge import stack_years
from rosterfold.operators.projection import positional_projection
from rosterfold.operators.roster import Roster, roster_filter

# Quoted cells may hold line breaks and doubled quotes; a line with a cell too many or too few is an
# error. Files with line breaks in cells cannot be split: export large sheets as Parquet.
CSV = {"header": True, "multiLine": True, "escape": '"', "mode": "FAILFAST"}


#: Column with the year of the workbook that a row of a stacked sheet comes from.
WORKBOOK = "__workbook"


def year_registry(root: str, years: Iterable[str], pattern: str = "{root}/{year}") -> dict[str, str]:
    """Year label to workbook directory."""
    return {str(y): pattern.format(root=root.rstrip("/"), year=y) for y in years}


def scan_sheet(
    spark: SparkSession,
    workbook: str,
    sheet: str,
    fmt: str = "parquet",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """One sheet of a workbook.

    ``columns`` is a projection. For CSV the header row names the columns and
    every cell is text.
    """
    path = f"{workbook.rstrip('/')}/{sheet}.{fmt}"
    if fmt == "parquet":
        df = spark.read.parquet(path)
    elif fmt == "csv":
        df = spark.read.options(**CSV).option("inferSchema", False).csv(path)
    else:
        raise ValueError(f"unsupported sheet format: {fmt}")
    if columns is None:
        return df
    require_columns(df, columns, f"sheet {sheet}")
    return df.select(*[col_q(c) for c in columns])


def scan_text_sheet(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV sheet under an explicit all-text schema; no file is read to plan it."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.options(**CSV).option("enforceSchema", False).schema(schema).csv(path)


def roster_sheet(
    spark: SparkSession,
    workbook: str,
    sheet: str,
    key: str,
    roster: Roster | None = None,
    positions: Iterable[int] | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """Key first, then the positions asked for (all but the first), roster rows only."""
    df = positional_projection(scan_sheet(spark, workbook, sheet, fmt), key, positions)
    return df if roster is None else roster_filter(df, key, roster)


def scan_workbook(
    spark: SparkSession,
    workbook: str,
    info_sheet: str,
    info_columns: Sequence[str],
    table_sheets: Mapping[str, Iterable[int] | None],
    key: str,
    fmt: str = "parquet",
) -> dict[str, DataFrame]:
    """All sheets of one year: the info sheet by name, the rest by position."""
    sheets = {info_sheet: scan_sheet(spark, workbook, info_sheet, fmt, info_columns)}
    for sheet, positions in table_sheets.items():
        sheets[sheet] = roster_sheet(spark, workbook, sheet, key, None, positions, fmt)
    return sheets


def _year_of_file(year_files: Mapping[str, str], sheet: str, fmt: str) -> str:
    """SQL of the year whose workbook folder the file read lies in."""
    folders = {path.rstrip("/").rsplit("/", 1)[-1]: year for year, path in year_files.items()}
    names = "|".join(f"\\Q{name}\\E" for name in folders)
    pattern = literal(f"/({names})/\\Q{sheet}.{fmt}\\E(/[^/]*)*$")
    path = "url_decode(replace(_metadata.file_path, '+', '%2B'))"
    years = ", ".join(f"{literal(name)}, {literal(str(year))}" for name, year in folders.items())
    lost = f"raise_error(concat('no year for file ', _metadata.file_path))"
    return f"coalesce(try_element_at(map({years}), regexp_extract({path}, {pattern}, 1)), CAST({lost} AS STRING))"


def scan_years(
    spark: SparkSession,
    year_files: Mapping[str, str],
    sheet: str,
    key: str,
    fmt: str = "parquet",
    columns: Sequence[str] | None = None,
    positions: Iterable[int] | None = None,
) -> tuple[DataFrame, dict[str, list[str]]]:
    """One sheet over all years with its year in ``WORKBOOK``, and the columns it has in each year.

    Years whose sheets have the same columns and types are one scan, which knows the year from the path of
    each file; a filter on the year leaves out the files of other years. Workbook folders of one name in
    different places are scanned one by one. ``columns`` chooses by name, else the key and ``positions``.
    """
    groups: dict[object, dict[str, str]] = {}
    known, schemas = {}, {}
    folders = Counter(path.rstrip("/").rsplit("/", 1)[-1] for path in year_files.values())
    for year, path in year_files.items():
        df = scan_sheet(spark, path, sheet, fmt)
        alone = folders[path.rstrip("/").rsplit("/", 1)[-1]] > 1
        group = (df.schema.simpleString(), year if alone else None)
        groups.setdefault(group, {})[year] = path
        schemas[group] = df.schema
    frames = []
    for group, files in groups.items():
        paths = [f"{path.rstrip('/')}/{sheet}.{fmt}" for path in files.values()]
        reader = spark.read.schema(schemas[group])
        if fmt == "csv":
            reader = reader.options(**CSV).option("enforceSchema", False)
        df = reader.format(fmt).load(paths)
        year = literal(str(next(iter(files)))) if len(files) == 1 else _year_of_file(files, sheet, fmt)
        wanted = df if columns is not None else positional_projection(df, key, positions)
        names = list(columns) if columns is not None else wanted.columns
        require_columns(df, names, f"sheet {sheet}")
        known |= dict.fromkeys(files, names)
        frames.append(df.selectExpr(*map(quoted, names), f"{year} AS {WORKBOOK}"))
    if len(frames) == 1:
        return frames[0], known
    # a column may differ in type between years; all cells are text until they are coerced
    types = {(f.name, f.dataType.simpleString()) for df in frames for f in df.schema.fields}
    mixed = {name for name, n in Counter(name for name, _ in types).items() if n > 1}
    return stack_years([_as_text(df, mixed) for df in frames]), known


def _as_text(df: DataFrame, names: Iterable[str]) -> DataFrame:
    names = set(names)
    return df.selectExpr(
        *[named(to_text(quoted(f.name), f.dataType), f.name) if f.name in names else quoted(f.name) for f in df.schema.fields]
    )
