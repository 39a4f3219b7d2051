"""Outer merge of many sheets, stacking of years, and fact joins."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterfold.functions.columns import (
    as_names,
    col_q,
    group_by,
    literal,
    named,
    quoted,
    require_columns,
)
from rosterfold.operators.roster import Roster, roster_filter


#: Rows of the result that a piece of a repeated key is meant to give.
PIECE_ROWS = 1 << 18


def check_names(sheets: Mapping[str, Sequence[str]], keys: Sequence[str]) -> None:
    """Fail where two sheets (name to columns) both hold a column that is no key."""
    seen = Counter(c for columns in sheets.values() for c in set(columns) - set(keys))
    clash = sorted(c for c, n in seen.items() if n > 1)
    if clash:
        raise ValueError(f"column(s) in more than one sheet: {', '.join(clash)}")


def outer_merge(
    sheets: Mapping[str, DataFrame],
    key: str | Sequence[str],
    roster: Roster | None = None,
    keep_null_key: bool = False,
    unique_keys: bool | None = True,
    roster_key: str | None = None,
) -> DataFrame:
    """Full outer merge of any number of sheets on one key column, or several.

    With ``unique_keys`` (one row per key and sheet) all sheets are stacked and
    folded by one aggregation: one shuffle, where chained full joins shuffle at
    every step. A row travels as a struct of its own sheet's columns, so its width
    does not grow with the number of sheets. A key that occurs twice
    in a sheet stops the job with an error instead of losing a row. With
    ``unique_keys=False`` full joins are chained and repeated keys multiply. With
    ``unique_keys=None`` only the keys that some sheet repeats are joined, and all others folded; the rows of a repeated key are
    multiplied in pieces, none of which passes through one task as a whole (:func:`_multiplied`; it gives all zeros and NaN one form).

    ``keep_null_key`` lets NULL keys match each other; otherwise rows with a
    NULL key (in any key column) are dropped. ``roster`` holds values of ``roster_key``, by default the only key.
    """
    keys = as_names(key)
    for name, df in sheets.items():
        require_columns(df, keys, f"sheet {name}")
    check_names({name: df.columns for name, df in sheets.items()}, keys)
    parts = narrowed(sheets, keys, roster, keep_null_key, roster_key)
    if unique_keys is False:
        return _chained_full_join(parts, keys, keep_null_key)
    if unique_keys:
        return fold(parts, keys)
    again = _repeated(parts, keys)
    once = _fold([_beside(p, again, keys, "left_anti") for p in parts], keys).drop("__most")
    return once.unionByName(_multiplied(parts, again, keys))


def narrowed(
    sheets: Mapping[str, DataFrame], keys: Sequence[str], roster: Roster | None, keep_null_key: bool = False, roster_key: str | None = None
) -> list[DataFrame]:
    """The rows of each sheet that take part in a merge."""
    known = " AND ".join(f"{quoted(k)} IS NOT NULL" for k in keys)
    parts = [df if keep_null_key else df.where(known) for df in sheets.values()]
    if roster is None:
        return parts
    if roster_key is None and len(keys) > 1:
        raise ValueError("name the key column that the roster holds")
    return [roster_filter(p, roster_key or keys[0], roster) for p in parts]


def fold(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """One row per key from parts that hold each key at most once; a column of several parts is taken from the one that has a value.

    A key that a part repeats raises when its row is read.
    """
    folded = _fold(parts, keys)
    what = literal(f"key {', '.join(keys)} occurs more than once in a sheet: ")
    shown = ", ', ', ".join(f"coalesce(CAST({quoted(k)} AS STRING), 'NULL')" for k in keys)
    checked = f"IF(__most <= 1, true, CAST(raise_error(concat({what}, {shown})) AS BOOLEAN))"
    return folded.where(checked).drop("__most")


def _in_place(dtype: T.DataType) -> bool:
    """Whether a hash aggregation can keep a running maximum of the type in its rows."""
    return isinstance(dtype, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def _fold(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Keys, all other columns, and ``__most``: how often the part that repeats a key most holds it.

    Each part is packed into two structs of its own, one of numbers and one of texts, and NULL stands
    for those of the other parts. Numbers are folded by their maximum, texts as the list of the one struct
    there is: neither needs a sort of rows with text.
    """
    packed, values = [], {}
    for i, df in enumerate(parts):
        number, text = [], []
        for f in df.schema.fields:
            if f.name not in keys:
                (number if _in_place(f.dataType) else text).append(f.name)
                values.setdefault(f.name, []).append((i, _in_place(f.dataType)))
        structs = [
            named(f"named_struct({', '.join(f'{literal(c)}, {quoted(c)}' for c in columns)})", f"__{kind}{i}")
            for kind, columns in (("n", number), ("t", text))
            if columns
        ]
        packed.append(df.selectExpr(*map(quoted, keys), f"{i} AS __sheet", *structs))
    # keys are unique per part: combining before the shuffle would find nothing
    stacked = stack_years(packed).repartition(*map(col_q, keys))
    texts = [c for c in stacked.columns if c.startswith("__t")]
    numbers = {c: homes for c, homes in values.items() if homes[0][1]}
    folded = group_by(
        stacked,
        keys,
        [
            *[named(f"max({_first(f'__n{i}.{quoted(c)}' for i, _ in homes)})", c) for c, homes in numbers.items()],
            *[f"collect_list({t}) AS {t}" for t in texts],
            f"greatest({', '.join(['0L', *(f'count_if(__sheet = {i})' for i in range(len(packed)))])}) AS __most",
        ],
    )
    return folded.selectExpr(
        *map(quoted, keys),
        *[
            quoted(c) if c in numbers else named(_first(f"get(__t{i}, 0).{quoted(c)}" for i, _ in homes), c)
            for c, homes in values.items()
        ],
        "__most",
    )


def _first(values: Iterable[str]) -> str:
    values = list(values)
    return values[0] if len(values) == 1 else f"coalesce({', '.join(values)})"


def _repeated(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The keys (``__key0``...) that some part holds more than once, from the key columns alone.

    ``__pieces`` is the number of pieces that their rows are multiplied in, and ``__dealt`` the part with most of them.
    """
    names = _key_names(keys)
    counted = [
        group_by(p, keys, ["count(1) AS __n"]).selectExpr(*[f"{quoted(k)} AS {n}" for k, n in zip(keys, names)], f"{i} AS __sheet", "__n")
        for i, p in enumerate(parts)
    ]
    each = [f"sum(IF(__sheet = {i}, __n, 0L)) AS __n{i}" for i in range(len(parts))]
    ns = ", ".join(f"__n{i}" for i in range(len(parts)))
    most = f"greatest(1L, {ns})"
    product = " * ".join(f"CAST(greatest({n}, 1L) AS DOUBLE)" for n in ns.split(", "))
    return (
        group_by(stack_years(counted), names, each)
        .where(f"{most} > 1")
        .selectExpr(
            *names,
            f"CAST(least({product} / {PIECE_ROWS}, CAST({most} - 1 AS DOUBLE)) AS BIGINT) + 1 AS __pieces",
            f"CAST(array_position(array({ns}), {most}) AS INT) - 1 AS __dealt",
        )
    )


def _key_names(keys: Sequence[str]) -> list[str]:
    return [f"__key{i}" for i in range(len(keys))]


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], names: Sequence[str]) -> Column:
    """Key columns equal, NULL included."""
    return reduce(lambda a, b: a & b, (left[quoted(k)].eqNullSafe(right[n]) for k, n in zip(keys, names)))


def _beside(df: DataFrame, again: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Rows of a part with what is known of their repeated key, or those without one."""
    return df.join(again, _same(df, again, keys, _key_names(keys)), how)


def _dealt(df: DataFrame, i: int, again: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Different rows of part ``i`` under repeated keys, by key and piece (``__at{i}``), and how often they occur (``__m{i}``).

    The occurrences of the part that has most rows of a key are dealt to its pieces, those of other parts are in every piece.
    """
    names, rest = _key_names(keys), [c for c in df.columns if c not in keys]
    told = [quoted(f.name) for f in df.schema.fields if f.name in rest and isinstance(f.dataType, T.AtomicType)]
    rows = group_by(_beside(df, again, keys, "inner"), [*names, "__pieces", "__dealt", *rest], ["count(1) AS __m"])
    return (
        rows.withColumn("__mine", F.expr(f"__dealt = {i}"))
        .selectExpr("*", "explode(sequence(0L, IF(__mine, least(__m, __pieces), __pieces) - 1)) AS __j")
        .withColumn("__piece", F.expr(f"IF(__mine, pmod(pmod(xxhash64({', '.join([*names, *told])}), __pieces) + __j, __pieces), __j)"))
        .selectExpr(
            f"struct({', '.join(names)}, __piece) AS __at{i}",
            *map(quoted, rest),
            f"IF(__mine, __m div __pieces + IF(__j < __m % __pieces, 1L, 0L), __m) AS __m{i}",
        )
    )


def _multiplied(parts: Sequence[DataFrame], again: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Repeated keys with every combination of their rows in the parts, NULL for parts without the key.

    Equal rows are combined once and written as often as they occur. All parts meet on the same key and piece, so
    nothing multiplied is shuffled or sorted, and a piece holds about ``PIECE_ROWS`` rows however often a key occurs.
    """
    names, n = _key_names(keys), range(len(parts))
    # a struct is never NULL itself, and NULL fields of structs are equal
    pieces = again.selectExpr(*names, "__dealt", "explode(sequence(0L, __pieces - 1)) AS __piece")
    merged = pieces.selectExpr(f"struct({', '.join(names)}, __piece) AS __at", "__dealt")
    # by a number that adaptive execution keeps: pieces are small before they are multiplied
    merged = merged.repartition(int(parts[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), "__at")
    for i, part in enumerate(parts):
        dealt = _dealt(part, i, again, keys)
        merged = merged.join(dealt, merged["__at"] == dealt[f"__at{i}"], "left").drop(f"__at{i}")
    rest = [quoted(c) for part in parts for c in part.columns if c not in keys]
    out = [*[named(f"__at.{name}", k) for name, k in zip(names, keys)], *rest]
    return (
        merged.where(f"get(array({', '.join(f'__m{i}' for i in n)}), __dealt) IS NOT NULL")
        .selectExpr(*out, f"{' * '.join(f'coalesce(__m{i}, 1L)' for i in n)} AS __times")
        .selectExpr("*", "explode(sequence(0L, (__times - 1) div 4096)) AS __run")
        .selectExpr(*map(quoted, keys), *rest, "explode(sequence(1L, least(4096L, __times - 4096 * __run))) AS __one")
        .drop("__one")
    )


def _chained_full_join(parts: Sequence[DataFrame], keys: Sequence[str], keep_null_key: bool) -> DataFrame:
    if not keep_null_key:
        return reduce(lambda a, b: a.join(b, list(keys), "full"), parts)
    names = [f"__key{i}" for i in range(len(keys))]
    merged = parts[0]
    for part in parts[1:]:
        rest = [quoted(c) for c in part.columns if c not in keys]
        right = part.selectExpr(*[f"{quoted(k)} AS {n}" for k, n in zip(keys, names)], *rest)
        both = merged.join(right, _same(merged, right, keys, names), "full")
        merged = both.selectExpr(
            *[named(f"coalesce({quoted(k)}, {n})", k) for k, n in zip(keys, names)],
            *[quoted(c) for c in both.columns if c not in keys and c not in names],
        )
    return merged


def stack_years(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack by column name, keep duplicates, NULL where a year lacks a column.

    Neighbours are paired until one is left: every frame is then realigned a
    few times, where a left-to-right chain would realign the first ones again
    for each frame that follows.
    """
    frames = list(frames)
    while len(frames) > 1:
        pairs = [frames[i : i + 2] for i in range(0, len(frames), 2)]
        frames = [
            p[0].unionByName(p[1], allowMissingColumns=True) if len(p) == 2 else p[0]
            for p in pairs
        ]
    return frames[0]


def fact_join(left: DataFrame, right: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Inner join on one or several keys that both sides name alike."""
    on = as_names(keys)
    clash = (set(left.columns) & set(right.columns)) - set(on)
    if clash:
        raise ValueError(f"column(s) on both sides: {', '.join(sorted(clash))}")
    return left.join(right, on, "inner")
