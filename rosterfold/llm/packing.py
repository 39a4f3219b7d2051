"""Packing of token sequences into fixed windows by bin completion.

Only lengths matter to a packing, and a window has at most ``capacity`` of them,
so the search runs over the histogram of lengths: at most ``capacity`` counts,
whatever the number of documents. Bin completion takes the largest piece left and
looks for fillings around it. The incumbent takes the fullest one (found by branch and bound from the best-fit
filling on, by reachable sums where branches run out) as often as the counts allow, so the number of steps
follows the number of lengths, not of documents. Where it needs more windows than a lower bound says, its
last windows are packed again: a branch and bound over whole solutions enumerates
undominated fillings (none whose pieces could be exchanged for a larger one that is left over), bounds their waste by
what all windows together may waste, and never looks at the same pieces twice. That proves small tables optimal;
in large ones a window more than the bound may stay when the budget of branches ends.

Spark then deals the pieces: each piece has a rank among those of its length
(counted in buckets, so that a frequent length is not one task's work), and the
plan says which window and place each range of ranks has.

Null texts count as empty (one end id); rows that repeat are packed each; null
ids stay; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rosterfold.llm.common import pin, prepare, slices, texts
from rosterfold.llm.encoding import encoder

#: Branches that a search opens: one filling is then decided by reachable sums, a tail keeps the windows it has.
BRANCHES = 20_000

#: Windows at the end of an incumbent that are packed again at once, at most.
TAIL = 64

#: Pieces whose ranks one task counts.
RANKED = 1 << 20


def _below(lengths: list[int], counts: dict[int, int]) -> list[int]:
    """All that is left from each place of ``lengths`` on."""
    below = [0]
    for size in reversed(lengths):
        below.append(below[-1] + size * counts[size])
    return below[::-1]


def _fillings(lengths: list[int], counts: dict[int, int], room: int, waste: int):
    """Fillings ((length, times), ...) that leave at most ``waste`` of ``room`` and no place for another piece.

    Larger pieces come first, each length as often as it goes in, then one time less.
    """
    below = _below(lengths, counts)
    if room - below[0] > waste:
        return
    stack: list[tuple[int, int, tuple[tuple[int, int], ...], int]] = [(0, room, (), 0)]  # place, rest, chosen, the smallest length left behind
    while stack:
        at, rest, chosen, behind = stack.pop()
        while at < len(lengths) and lengths[at] > rest:
            at += 1
        if at == len(lengths) or not rest:
            if rest <= waste and not (behind and behind <= rest):
                yield chosen
            else:
                yield None  # a branch that came to nothing
            continue
        size = lengths[at]
        most = min(counts[size], rest // size)
        for k in range(most + 1):  # the last one pushed is looked at first
            left = rest - k * size
            if left - below[at + 1] > waste:
                continue
            stack.append((at + 1, left, (*chosen, (size, k)) if k else chosen, size if k < counts[size] else behind))


def _fullest(lengths: list[int], counts: dict[int, int], room: int) -> tuple[tuple[int, int], ...]:
    """The filling that leaves least of ``room``, by the sums that can be reached: exact, at a cost that ``room`` bounds."""
    sums, history, mask = 1, [], (1 << (room + 1)) - 1
    for size in reversed(lengths):
        history.append(sums)
        left, step = min(counts[size], room // size), 1
        while left:
            step = min(step, left)
            sums |= (sums << (step * size)) & mask
            left -= step
            step *= 2
    rest, out = sums.bit_length() - 1, []
    for size, before in zip(lengths, reversed(history), strict=True):
        k = 0
        while not before >> rest & 1:
            rest -= size
            k += 1
        if k:
            out.append((size, k))
    return tuple(out)


def fill(lengths: list[int], counts: dict[int, int], room: int, branches: int = BRANCHES) -> list[int]:
    """Lengths (falling, as often as used) that leave the least of ``room`` empty."""
    return [n for n, k in _filling(lengths, counts, room, branches) for _ in range(k)]


def _filling(lengths: list[int], counts: dict[int, int], room: int, branches: int) -> tuple[tuple[int, int], ...]:
    """The same as ((length, times), ...).

    ``lengths`` holds the lengths of ``counts`` that are left, from large to small. The first filling is
    the best-fit one; after ``branches`` branches the sums that can be reached decide.
    """
    lengths = [n for n in lengths if counts[n] and n <= room]
    best, least = (), room
    for opened, found in enumerate(_fillings(lengths, counts, room, room)):
        if found is not None:
            rest = room - sum(n * k for n, k in found)
            if rest < least:
                best, least = found, rest
        if not least:
            return best
        if opened >= branches:
            return _fullest(lengths, counts, room)
    return best


def _dominated(filling: tuple[tuple[int, int], ...], counts: dict[int, int], lengths: list[int], room: int) -> bool:
    """Whether pieces of a filling (one, or several together) can be exchanged for one larger piece that is left over."""
    rest = room - sum(n * k for n, k in filling)
    sums = {0: 0}  # sum of some of the filling's pieces: the fewest lengths that make it
    pieces = [n for n, k in filling for _ in range(min(k, 3))][:8]
    for n in pieces:
        sums |= {s + n: c + 1 for s, c in sums.items() if s + n not in sums}
    used = dict(filling)
    spare = sorted(n for n in lengths if counts[n] > used.get(n, 0))
    for total, parts in sums.items():
        if parts:
            k = bisect_left(spare, total + (parts == 1))
            if k < len(spare) and spare[k] <= total + rest and spare[k] <= room:
                return True
    return False


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Windows that any packing needs: by the sum, and by the pieces that cannot share a window."""
    best = -(-sum(n * c for n, c in counts.items()) // capacity)
    for small in sorted({0, *(n for n in counts if 2 * n <= capacity)}):
        large = sum(c for n, c in counts.items() if n > capacity - small)
        half = [(n, c) for n, c in counts.items() if capacity - small >= n and 2 * n > capacity]
        rest = sum(n * c for n, c in counts.items() if small <= n and 2 * n <= capacity)
        middle = sum(c for _, c in half)
        over = rest - (middle * capacity - sum(n * c for n, c in half))
        best = max(best, large + middle + max(0, -(-over // capacity)))
    return best


def complete(counts: dict[int, int], capacity: int, most: int, branches: int) -> list[tuple[tuple[int, int], ...]] | None:
    """A packing into at most ``most`` windows by branch and bound over bin completions; None if none was found.

    Each step takes the largest piece left and tries the undominated fillings around it, those that waste
    least first; what all windows together may waste bounds each filling's waste.
    """
    slack = most * capacity - sum(n * c for n, c in counts.items())
    if slack < 0:
        return None
    budget = branches

    def options(left: dict[int, int], waste: int):
        nonlocal budget
        first = max(left)
        rest = dict(left)
        rest[first] -= 1
        lengths = sorted((n for n, c in rest.items() if c and n <= capacity - first), reverse=True)
        found = []
        for filling in _fillings(lengths, rest, capacity - first, waste):
            budget -= 1
            if budget < 0:
                break
            if filling is not None and not _dominated(filling, rest, lengths, capacity - first):
                found.append((capacity - first - sum(n * k for n, k in filling), filling))
        found.sort(key=lambda x: (x[0], [(-n, -k) for n, k in x[1]]))
        for wasted, filling in found:
            after = dict(rest)
            for n, k in filling:
                after[n] -= k
            window = Counter(dict(filling))
            window[first] += 1
            yield wasted, tuple(sorted(window.items(), reverse=True)), {n: c for n, c in after.items() if c}

    left = {n: c for n, c in counts.items() if c}
    if not left:
        return []
    seen: set[tuple] = set()
    done: list[tuple[tuple[int, int], ...]] = []
    stack = [(options(left, slack), slack)]
    while stack:
        step = next(stack[-1][0], None)
        if step is None or budget < 0:
            if budget < 0:
                return None
            stack.pop()
            if done:
                done.pop()
            continue
        wasted, window, after = step
        state = tuple(sorted(after.items()))
        if state in seen:
            continue
        seen.add(state)
        done.append(window)
        if not after:
            return done
        slack_left = stack[-1][1] - wasted
        if len(done) + lower_bound(after, capacity) > most:
            done.pop()
            continue
        stack.append((options(after, slack_left), slack_left))
    return None


def plan(histogram: dict[int, int], capacity: int, branches: int = BRANCHES) -> list[tuple[int, list[int]]]:
    """(times, lengths) of each kind of window; all pieces of the histogram are used.

    The incumbent fills one window after another around the largest piece left, as often as the counts allow.
    While it needs more windows than ``lower_bound``, its last windows (4, 8, 16, ... of them, up to ``TAIL``, and in a small table all)
    are packed again by ``complete`` into one window less.
    """
    counts = {n: c for n, c in histogram.items() if c}
    lengths = sorted(counts, reverse=True)
    if lengths and (lengths[0] > capacity or lengths[-1] < 1):
        raise ValueError("a piece does not fit")
    least = lower_bound(counts, capacity)
    windows: list[tuple[int, tuple[tuple[int, int], ...]]] = []
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        need = Counter(dict(_filling(lengths, counts, capacity - first, branches)))
        counts[first] += 1
        need[first] += 1
        times = min(counts[n] // k for n, k in need.items())
        windows.append((times, tuple(sorted(need.items(), reverse=True))))
        for n, k in need.items():
            counts[n] -= k * times
        lengths = [n for n in lengths if counts[n]]
    tail = 4
    while sum(t for t, _ in windows) > least and tail <= TAIL:
        whole = sum(t for t, _ in windows)
        taken, again, kept = 0, Counter(), list(windows)
        while kept and taken < tail:
            times, window = kept.pop()
            use = min(times, tail - taken)
            if use < times:
                kept.append((times - use, window))
            for n, k in window:
                again[n] += k * use
            taken += use
        better = complete(dict(again), capacity, taken - 1, branches)
        if better is not None:
            windows = kept + [(t, w) for w, t in Counter(better).items()]
        elif taken == whole:
            break
        else:
            tail *= 2
    return [(times, [n for n, k in window for _ in range(k)]) for times, window in windows]


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """Each document's ids with ``end_id``, cut every ``capacity`` ids: doc_id, piece, start, length, ids_crc32, ids."""
    prepare(docs.sparkSession)

    def cut(batches):
        own = encoder(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, limit=1 << 21):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), own.batch(texts(batch.column("text"))), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part))
            columns = zip(*rows, strict=True)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"
    )


def pack(lengths: DataFrame, capacity: int, branches: int = BRANCHES) -> DataFrame:
    """Add sequence_id and offset to rows that have a ``length`` of 1 to ``capacity``.

    ``lengths`` must give the same rows each time it is read (a table, or pinned).
    """
    spark = lengths.sparkSession
    histogram = {r.length: r.n for r in lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(histogram.values())
    segments, first_window, used = [], 0, Counter()
    for times, sizes in plan(histogram, capacity, branches):
        offset = 0
        for size, k in Counter(sizes).items():
            segments.append((size, used[size], used[size] + k * times, times, first_window, offset))
            used[size] += k * times
            offset += size * k
        first_window += times
    # At most 63 different lengths go into a window of 2,048, and each pattern uses up the count of
    # one length but for less than one window's worth: the table's size follows the capacity alone.
    table = spark.createDataFrame(
        segments, "length bigint, low bigint, high bigint, times bigint, first_window bigint, offset bigint"
    )
    by_length = table.groupBy("length").agg(
        F.sort_array(F.collect_list(F.struct("low", "high", "times", "first_window", "offset"))).alias("ranges")
    )
    buckets = max(1, -(-total // RANKED)) * 8
    ordered = [c for c in lengths.columns if c != "ids"]
    keyed = lengths.withColumn("__bucket", F.pmod(F.xxhash64(*ordered), F.lit(buckets)))
    sizes = keyed.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(
        Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    sizes = sizes.select("length", "__bucket", F.coalesce(before, F.lit(0)).alias("__before"))
    ranked = (
        keyed.withColumn(
            "__rank", F.row_number().over(Window.partitionBy("length", "__bucket").orderBy(*ordered)) - 1
        )
        .join(sizes, ["length", "__bucket"])
        .withColumn("__rank", F.col("__rank") + F.col("__before"))
        .join(F.broadcast(by_length), "length")
    )
    found = F.expr("filter(ranges, r -> r.low <= __rank AND __rank < r.high)[0]")
    inside = F.col("__rank") - F.col("__range.low")
    return ranked.withColumn("__range", found).select(
        *lengths.columns,
        (F.col("__range.first_window") + F.pmod(inside, F.col("__range.times"))).alias("sequence_id"),
        (F.col("__range.offset") + F.col("length") * F.floor(inside / F.col("__range.times"))).alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(pin(pieces(docs, vocabulary, end_id, capacity).drop("ids")), capacity)
