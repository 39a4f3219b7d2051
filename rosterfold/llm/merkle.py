"""A Merkle manifest of a table: a digest for each row, one for each source, one for all, and every row's proof.

Leaves are SHA-256 digests of length-prefixed fields. Within a source leaves stand in order of
``doc_id``; every ``FAN`` neighbours become the digest of their digests until one is left, the source's subroot;
the subroots, in order of source (null first, then by UTF-8 bytes), become the root the same way.

**Places by rank.** No leaf is sorted. The ids of each source are merged, by a bitwise or that starts before the
shuffle, into words of 64 bits, of which only those that are not empty exist. A directory of counts over the words says how many ids
come before each, in steps of ``2**STEP`` words, so that no task sums more than that many
however many ids a source has; a leaf's place is that count plus the bits below its own in its word.

**Levels by slots.** A leaf's place divided by ``WIDTH`` keys the slot array it belongs to. An array is reduced by as many
levels as it holds, and its last digest is a slot of the next array: a table of 10^12 rows takes five passes.
Siblings are read off the arrays; a row's path is that of its array's, then that of its source's.

Ids that repeat and null ids (which come first) make a word hold more rows than bits. Rows of such words are
told apart by their digests: equal rows are counted, digests are summed in ``16**PREFIX`` cells of each id, and only
within a cell do they get an order. Of equal rows each has its own place. Null in a
field is part of the leaf; a table without rows has no manifest. Fields are read by the names given, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rosterfold.llm.common import pin, prepare
from rosterfold.llm.ranks import ranked

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

FAN = 3

#: Levels that one slot array is reduced by, and the slots that takes.
LEVELS = 6
WIDTH = FAN**LEVELS

#: Bits of a word's number that one step of the directory resolves.
STEP = 14

#: Hexadecimal digits of a leaf that spread the rows of one id.
PREFIX = 3

#: Places that one repeated leaf is expanded into at once.
_EXPANDED = 4096


def encoded(field: Column) -> Column:
    """A field's bytes in a leaf: ``-`` if null, else its length in bytes, a colon, and itself."""
    text = field.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, fields)), 256)


def _before(cells: DataFrame, low: int, high: int) -> DataFrame:
    """(src, slot, before) of cells (src, slot, n): how many rows of the source lie in smaller slots."""
    lower = Window.unboundedPreceding, -1
    if high - low < 1 << STEP:
        window = Window.partitionBy("src").orderBy("slot").rowsBetween(*lower)
        return cells.select("src", "slot", F.coalesce(F.sum("n").over(window), F.lit(0)).alias("before"))
    cells = cells.withColumn("upper", F.shiftright("slot", STEP))
    above = _before(cells.groupBy("src", F.col("upper").alias("slot")).agg(F.sum("n").alias("n")), low >> STEP, high >> STEP)
    window = Window.partitionBy("src", "upper").orderBy("slot").rowsBetween(*lower)
    inside = cells.select("src", "slot", "upper", F.coalesce(F.sum("n").over(window), F.lit(0)).alias("inside"))
    return inside.join(above.select("src", F.col("slot").alias("upper"), "before"), ["src", "upper"]).select(
        "src", "slot", (F.col("before") + F.col("inside")).alias("before")
    )


def _placed_repeats(rows: DataFrame) -> DataFrame:
    """Places of rows (src, slot, before, doc_id, leaf, other) whose words hold more rows than ids."""
    lower = Window.unboundedPreceding, -1
    key = ["src", "slot", "doc_id", "cell"]
    counted = rows.groupBy("src", "slot", "before", "doc_id", "leaf", "other", F.substring("leaf", 1, PREFIX).alias("cell")).agg(
        F.count(F.lit(1)).alias("n")
    )
    cells = counted.groupBy(*key).agg(F.sum("n").alias("n"))
    window = Window.partitionBy("src", "slot").orderBy(F.col("doc_id").asc_nulls_first(), "cell").rowsBetween(*lower)
    cells = cells.select(*key, F.coalesce(F.sum("n").over(window), F.lit(0)).alias("cells_before"))
    window = Window.partitionBy(*key).orderBy("leaf", "other").rowsBetween(*lower)
    inside = counted.withColumn("inside", F.coalesce(F.sum("n").over(window), F.lit(0)))
    same = [inside[k].eqNullSafe(cells[k]) for k in key]
    first = inside.join(cells, same).select(
        inside["src"], inside["doc_id"], "leaf", "other", "n", (F.col("before") + F.col("cells_before") + F.col("inside")).alias("first")
    )
    return (
        first.withColumn("part", F.explode(F.expr(f"sequence(0L, (n - 1) div {_EXPANDED})")))
        .repartition("leaf", "part")
        .withColumn("pos", F.explode(F.expr(f"sequence(first + part * {_EXPANDED}, first + least(n, (part + 1) * {_EXPANDED}) - 1)")))
        .select("src", "pos", "doc_id", "leaf", "other")
    )


def places(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (src, pos, doc_id, leaf, other) with their source's number and their place in it, and the sources (src, source, n).

    ``leaves`` (key, source, doc_id, leaf, other) must be a table; ``key`` orders the sources.
    """
    word = F.shiftright("doc_id", 6)
    bit = "CAST(doc_id & 63 AS INT)"
    words = pin(
        leaves.groupBy("key", "source", word.alias("slot")).agg(
            F.coalesce(F.expr(f"bit_or(shiftleft(1L, {bit}))"), F.lit(0).cast("bigint")).alias("bits"), F.count(F.lit(1)).alias("rows")
        )
    )
    low, high = words.agg(F.min("slot"), F.max("slot")).first()
    low, high = (0, 0) if low is None else (low, high)
    sources = ranked(pin(words.groupBy("key", "source").agg(F.sum("rows").alias("n"))), [F.col("key")], "src")
    sources = pin(sources.withColumn("src", F.col("src") - 1))
    slot = F.coalesce(F.col("slot"), F.lit(low - 1))  # null ids come first
    words = words.join(sources.select("key", "src"), "key").select("key", "src", slot.alias("slot"), "bits", "rows")
    before = _before(words.select("src", "slot", F.col("rows").alias("n")), low - 1, high)
    words = pin(words.join(before, ["src", "slot"]))
    found = leaves.withColumn("slot", F.coalesce(word, F.lit(low - 1))).join(words, ["key", "slot"])
    single = F.col("rows") == F.bit_count("bits")
    rank = F.expr(f"before + bit_count(bits & ~shiftleft(-1L, {bit}))")
    placed = found.where(single).select("src", rank.alias("pos"), "doc_id", "leaf", "other")
    if not words.where(~single).isEmpty():
        placed = placed.unionByName(_placed_repeats(found.where(~single)))
    return placed, sources.select("src", "source", "n")


def _arrays(nodes: DataFrame, carried: Sequence[str]) -> DataFrame:
    """Slot arrays (grp, block, n, slots, levels, top) of nodes (grp, pos, n, digest, and what is carried along).

    ``levels`` holds the digests of each level that was reduced; ``top`` is what remains.
    """
    arrays = nodes.groupBy("grp", "n", F.expr(f"pos div {WIDTH}").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest", *carried))).alias("slots")
    )
    arrays = arrays.withColumn("l0", F.expr("transform(slots, s -> s.digest)"))
    for k in range(LEVELS):
        runs = f"sequence(0, CAST((size(l{k}) + {FAN - 1}) div {FAN} - 1 AS INT))"
        up = f"transform({runs}, r -> sha2(array_join(slice(l{k}, {FAN} * r + 1, {FAN}), ''), 256))"
        arrays = arrays.withColumn(f"l{k + 1}", F.expr(f"IF(size(l{k}) > 1 OR n > {WIDTH}, {up}, CAST(array() AS array<string>))"))
    names = [f"l{k}" for k in range(LEVELS + 1)]
    reduced = ", ".join(f"IF(size(l{k + 1}) > 0, l{k}, NULL)" for k in range(LEVELS))
    top = "CASE " + " ".join(f"WHEN size({x}) > 0 THEN {x}[0]" for x in reversed(names)) + " END"
    return arrays.selectExpr("grp", "block", "n", "slots", f"filter(array({reduced}), l -> l IS NOT NULL) AS levels", f"{top} AS top")


#: Siblings of slot ``s`` on every level of its array: those before it, and those after it, in its run.
_PATH = (
    "transform(levels, (l, j) -> struct("
    "array_join(slice(l, CAST(at(s, j) - at(s, j) % {fan} + 1 AS INT), CAST(at(s, j) % {fan} AS INT)), '') AS left, "
    "array_join(slice(l, CAST(at(s, j) + 2 AS INT), CAST({fan} - 1 - at(s, j) % {fan} AS INT)), '') AS right))"
).replace("at(s, j)", "(s div element_at(array({powers}), j + 1))").format(fan=FAN, powers=", ".join(str(FAN**k) for k in range(LEVELS)))


def _climb(nodes: DataFrame, largest: int, carried: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Slot arrays with the path above each, and the last digest (grp, n, top) of each group of nodes (grp, pos, n, digest)."""
    arrays = pin(_arrays(nodes, carried))
    if largest <= WIDTH:
        none = F.expr("CAST(array() AS array<struct<left: string, right: string>>)")
        return arrays.withColumn("above", none), arrays.select("grp", "n", "top")
    upper = arrays.select("grp", F.col("block").alias("pos"), F.expr(f"(n + {WIDTH - 1}) div {WIDTH}").alias("n"), F.col("top").alias("digest"))
    above, tops = _climb(upper, -(-largest // WIDTH))
    return arrays.join(_paths(above).select("grp", F.col("pos").alias("block"), F.col("path").alias("above")), ["grp", "block"]), tops


def _paths(arrays: DataFrame, carried: Sequence[str] = (), kept: Sequence[str] = ()) -> DataFrame:
    """(grp, pos, what is carried, path) of every node."""
    fields = ", ".join(f"x.{c} AS {c}" for c in ("pos", *carried))
    nodes = f"transform(slots, (x, s) -> struct({fields}, concat({_PATH}, above) AS path))"
    return arrays.selectExpr("grp", *kept, f"inline({nodes})")


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None, fields: Sequence[str] = FIELDS) -> DataFrame:
    """source, position, doc_id, leaf, subroot, root, path, changed_leaf of every row.

    ``path`` is the siblings (left, right) of each level, up to the root. ``changed_leaf`` is the leaf of the row with
    the columns of ``changed`` in place of its own, for checks of altered copies. ``fields`` holds ``doc_id`` and ``source``.
    """
    prepare(docs.sparkSession)
    own = [F.col(f) for f in fields]
    other = [(changed or {}).get(f, F.col(f)) for f in fields]
    key = F.coalesce(F.concat(F.lit("."), F.col("source")), F.lit(""))  # null first, then empty
    leaves = docs.select(key.alias("key"), "source", F.col("doc_id").cast("bigint").alias("doc_id"), leaf(own).alias("leaf"), leaf(other).alias("other"))
    placed, sources = places(pin(leaves))
    nodes = placed.join(sources.select("src", "n"), "src").select(
        F.col("src").alias("grp"), "pos", "n", F.col("leaf").alias("digest"), "doc_id", "other"
    )
    largest, many = sources.agg(F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()
    carried = ["digest", "doc_id", "other"]
    arrays, tops = _climb(nodes, largest, carried[1:])
    subroots = pin(tops.select("grp", F.col("top").alias("subroot")))
    above, root = _climb(subroots.select(F.lit(0).alias("grp"), F.col("grp").alias("pos"), F.lit(many).alias("n"), F.col("subroot").alias("digest")), many)
    last = root.first()
    by_source = (
        _paths(above).select(F.col("pos").alias("grp"), F.col("path").alias("source_path"))
        .join(subroots, "grp")
        .join(sources.select(F.col("src").alias("grp"), "source"), "grp")
        .withColumn("root", F.lit(last.top if last else None).cast("string"))
    )
    whole = arrays.join(pin(by_source), "grp").withColumn("above", F.concat("above", "source_path"))
    return _paths(whole, carried, ["source", "subroot", "root"]).select(
        "source", F.col("pos").alias("position"), "doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path",
        F.col("other").alias("changed_leaf"),
    )


def folded(leaf_: str, path: str = "path") -> str:
    """SQL of the root that a leaf and its path give."""
    return f"aggregate({path}, {leaf_}, (d, p) -> sha2(concat(p.left, d, p.right), 256))"


def proof_digest(path: str = "path") -> str:
    """SQL of the digest of all siblings, from the leaf up."""
    return f"sha2(array_join(transform({path}, p -> concat(p.left, p.right)), ''), 256)"


def without_line_feeds(docs: DataFrame) -> Column:
    """The text without its line feeds in rows where 2 divides the CRC-32 of the id; the text itself elsewhere."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(docs["text"], F.lit("\n"), F.lit(""))).otherwise(docs["text"])


def digest(found: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of a manifest's rows."""
    return found.selectExpr(
        "doc_id", "leaf", "subroot", "root", f"{proof_digest()} AS proof_sha256", f"{folded('changed_leaf')} AS folded_root"
    ).selectExpr("*", "folded_root = root AS verified")
