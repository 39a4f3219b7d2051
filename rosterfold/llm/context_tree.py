"""Language-model scoring by context-tree weighting over the bytes of a text.

A token is coded as its bytes and a closing blank, each byte as eight binary
decisions. The context of a byte is what stands before it, up to ``DEPTH``
bytes back: the bytes of its token, the blank before it and the last ``TAIL`` bytes of the token before that. Every context of every depth has one
binary estimator for each node of the byte's decision tree (Krichevsky-Trofimov:
(n + 1/2) / (total + 1)). Weighting mixes all depths: a node's probability of what it has
seen is half its own estimate and half the product of its longer contexts', and the
share of either half is the weight with which it predicts. A longer context that
was never seen has no say. A text is its tokens and then one end token.

As contexts reach ``TAIL`` bytes into the token before, everything follows from the counts of
different units, a word with that tail before it:

1. units are counted, in buckets by hash of the word; nothing is left out, so what is
   gathered grows with the corpus. Units and words are told apart by 64-bit hashes;
2. the (context, byte) pairs of each bucket's units go to the group of the last two
   bytes of their context, where the tree of longer contexts is built bottom-up;
   only the nodes of contexts of up to two bytes (at most 65,536 times 255) meet on the driver;
3. each group answers each bucket's pairs with their probabilities, and the bucket sums
   them to one for each unit;
4. texts look frequent units up in a table sent to all tasks (units with at least one
   in ``2**20`` of all tokens, so at most ``2**20`` of them); the other units of a block of texts
   meet the table of their bucket in a shuffle, come back as one row for each block and bucket, and are summed by text.

``bits_per_byte`` is the text's code length, over its words' bytes with a blank each and the end token.

Texts are lower-cased (A-Z) and words are what is between ASCII white space. Null and
empty texts have the end token alone; texts with a null id are learned from; rows that
repeat are learned from and scored each; without anything to learn from all counts are 0. Only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterfold.llm.common import blob, parts, pin, prepare, remainders, slices, text_bytes, texts

DEPTH = 6

#: Bytes of the token before that belong to a token's contexts.
TAIL = 2

#: Units of at least one in this many training tokens are looked up without a shuffle.
FREQUENT = 1 << 20

BUCKET_BYTES = 24 << 20

#: Bytes of texts whose units a task counts before it passes them on.
HELD_BYTES = 12 << 20

_START = np.uint64(0x20 << 56)
_END = 10
_KEY = np.uint64(48)


def units(words: list[bytes]) -> list[bytes]:
    """Each word of a text behind a blank and the last bytes of the word before: what :func:`split` finds."""
    if not words:
        return []
    return [b" " + words[0], *[a[-TAIL:] + b" " + b for a, b in zip(words, words[1:])]]


_FOLDED = bytes.maketrans(bytes(range(65, 91)) + b"\t\n\v\f\r", bytes(range(97, 123)) + b" " * 5)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], "<u8")

#: Longer words are hashed one by one.
_LONG = 64


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Units:
    """Words within ``flat`` (eight more bytes follow the last one), each with ``tail`` bytes of the word before, which end at ``before``.

    A unit is told by a 64-bit hash, and so is its word.
    """

    def __init__(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray, before: np.ndarray, tail: np.ndarray) -> None:
        self.flat, self.start, self.size, self.before, self.tail = flat, start, size, before, tail
        self._loads = np.ndarray(len(flat) - 7, "<u8", flat, strides=(1,))
        self.word_hash = self._word_hash()
        code = (tail > 0) + flat[before - 1].astype(np.int64) * (tail > 0) + ((flat[before - 2].astype(np.int64) << 8) + (1 << 16)) * (tail > 1)
        self.hash = _scrambled(self.word_hash ^ (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))

    def _word_hash(self) -> np.ndarray:
        found = self.size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        todo = np.arange(len(self.start))
        for k in range(0, _LONG, 8):
            if not len(todo):
                return found
            left = self.size[todo] - k
            eight = self._loads[self.start[todo] + k] & _MASKS[np.minimum(left, 8)]
            found[todo] = _scrambled(found[todo] ^ eight)
            todo = todo[left > 8]
        for i in todo.tolist():
            found[i] = xxhash.xxh3_64_intdigest(self.flat[self.start[i] : self.start[i] + self.size[i]].tobytes())
        return found

    def in_order(self, some: np.ndarray, bucket: np.ndarray | None = None) -> np.ndarray:
        """These units by bucket, those whose words begin alike side by side."""
        first = (self._loads[self.start[some]] & _MASKS[np.minimum(self.size[some], 8)]).byteswap()
        order = np.argsort(first)
        return order if bucket is None else order[np.argsort(bucket[order], kind="stable")]

    def joined(self, some: np.ndarray) -> tuple[bytes, np.ndarray]:
        """These units (tail, blank, word and line feed each), and where each ends."""
        start, size, before, tail = self.start[some], self.size[some], self.before[some], self.tail[some]
        end = np.cumsum(size + tail + 2)
        begin = end - size - tail - 2
        kind = np.int32 if len(self.flat) < 1 << 31 else np.int64
        at = np.repeat((start - begin - tail - 1).astype(kind), size + tail + 2)
        at += np.arange(len(at), dtype=kind)
        out = self.flat[at]
        out[begin + tail], out[end - 1] = 32, 10
        one, two = np.flatnonzero(tail > 0), np.flatnonzero(tail > 1)
        out[(begin + tail - 1)[one]] = self.flat[before[one] - 1]
        out[begin[two]] = self.flat[before[two] - 2]
        return out.tobytes(), end


def split(found: list[bytes]) -> tuple[Units, np.ndarray]:
    """The units of these texts, and how many each text has."""
    flat = np.frombuffer(b"".join((b" ", b" ".join(found).translate(_FOLDED), b" " * 9)), np.uint8)
    blank = flat == 32
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, end = edges[::2], edges[1::2]
    bounds = np.cumsum([1, *(len(t) + 1 for t in found)])
    cuts = np.searchsorted(start, bounds)
    size = end - start
    tail = np.minimum(np.append(0, size[:-1]), TAIL)[: len(size)]
    tail[cuts[:-1][cuts[:-1] < len(tail)]] = 0
    return Units(flat, start, size, np.append(0, end[:-1])[: len(size)], tail), np.diff(cuts)


def parse(words: bytes) -> Units:
    """The units of a blob, which are joined by line feeds."""
    flat = np.frombuffer(words + b"\n" + b" " * 8, np.uint8)
    end = np.flatnonzero(flat == 10)
    begin = np.append(0, end[:-1] + 1)
    tail = np.where(flat[begin] == 32, 0, np.where(flat[begin + 1] == 32, 1, 2))
    start = begin + tail + 1
    return Units(flat, start, end - start, start - 1, tail)


def _alike(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the hashes, and where in it a new one begins."""
    order = np.argsort(hashes)
    here = hashes[order]
    return order, np.flatnonzero(np.append(True, here[1:] != here[:-1]))


def word_counts(docs: DataFrame, n: int, modulus: int, held_out: int) -> DataFrame:
    """bucket, words (units joined by line feeds), counts (in training texts), of_word (of the unit's word), n_tokens, n_known; pinned."""

    def count(batches):
        held, learned, nbytes = [], [], 0

        def flush():
            found, sizes = split(held)
            if not len(found.hash):
                return
            weight = np.repeat(np.concatenate(learned), sizes)
            order, begin = _alike(found.hash)
            total, one = np.add.reduceat(weight[order], begin), order[begin]
            bucket = (found.word_hash[one] % np.uint64(n)).astype(np.int32)
            order = found.in_order(one, bucket)
            total, one, bucket = total[order], one[order], bucket[order]
            words, end = found.joined(one)
            cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield pa.record_batch(
                    {
                        "bucket": pa.array([bucket[s]], pa.int32()),
                        "words": pa.array([words[end[s - 1] if s else 0 : end[e - 1] - 1]], pa.binary()),
                        "counts": pa.array([blob(total[s:e].astype("<u4"))], pa.binary()),
                    }
                )

        for batch in slices(batches):
            own = texts(batch.column("text"))
            held += own
            learned.append((remainders(batch.column("doc_id"), modulus) != held_out).astype(np.int64))
            nbytes += sum(map(len, own))
            if nbytes >= HELD_BYTES:
                yield from flush()
                held, learned, nbytes = [], [], 0
        if held:
            yield from flush()

    def merge(group):
        found = parse(b"\n".join(group.column("words").to_pylist()))
        counts = np.concatenate([np.frombuffer(c, "<u4") for c in group.column("counts").to_pylist()]).astype(np.int64)
        order, begin = _alike(found.hash)
        counts, one = np.add.reduceat(counts[order], begin), order[begin]
        order = found.in_order(one)
        counts, one = counts[order], one[order]
        order, begin = _alike(found.word_hash[one])
        of = np.add.reduceat(counts[order], begin)
        of_word = np.zeros(len(one), np.int64)
        of_word[order] = np.repeat(of, np.diff(np.append(begin, len(one))))
        return pa.table(
            {
                "bucket": group.column("bucket")[:1],
                "words": pa.array([found.joined(one)[0][:-1]], pa.binary()),
                "counts": pa.array([blob(counts.astype("<i8"))], pa.binary()),
                "of_word": pa.array([blob(of_word.astype("<i8"))], pa.binary()),
                "n_tokens": pa.array([int(counts.sum())], pa.int64()),
                "n_known": pa.array([int((of > 0).sum())], pa.int64()),
            }
        )

    return pin(
        docs.mapInArrow(count, "bucket int, words binary, counts binary")
        .groupBy("bucket")
        .applyInArrow(merge, "bucket int, words binary, counts binary, of_word binary, n_tokens bigint, n_known bigint")
    )


def contexts(words: bytes, counts: np.ndarray):
    """Different (context, byte) pairs of these units (or words without a tail) and of the end token, in order.

    Gives contexts (nearest byte on top), bytes, counts, the pair of each position,
    and the first position of each unit; the end token is the last position.
    """
    if b" " not in words:
        words = b" " + words.replace(b"\n", b"\n ")
    data = np.frombuffer(words.replace(b"\n", b" \n") + b" ", np.uint8)
    breaks, blanks = data == 10, data == 32
    unit = np.cumsum(breaks)
    starts = np.append(0, np.flatnonzero(breaks) + 1)
    # a unit has two blanks: what is coded stands behind the first, and the second is the last of it
    at = np.flatnonzero(~breaks & (np.cumsum(blanks) - blanks - 2 * unit == 1))
    back = at - starts[unit[at]]
    context = np.zeros(len(at), np.uint64)
    for k in range(1, DEPTH + 1):
        byte = np.where(k <= back, data[np.maximum(at - k, 0)], 0).astype(np.uint64)
        context |= byte << np.uint64(8 * (8 - k))
    first = np.flatnonzero(np.append(True, unit[at][1:] != unit[at][:-1]))
    weight = np.repeat(counts, np.diff(np.append(first, len(at))))
    context = np.append(context, _START)
    byte = np.append(data[at], np.uint8(_END))
    weight = np.append(weight, 0)
    order, begin = _grouped(context, byte)
    pair = np.zeros(len(order), np.int64)
    pair[order[begin[1:]]] = 1
    pair[order] = np.cumsum(pair[order])
    return context[order[begin]], byte[order[begin]], np.add.reduceat(weight[order], begin), pair, first


def _grouped(context: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pairs, and where in it a new pair begins."""
    # contexts leave their last byte free
    return _alike(context | byte)


_REQUESTS = "bucket int, key int, contexts binary, bytes binary, counts binary"


def requests(vocabulary: DataFrame) -> DataFrame:
    """Each bucket's pairs by the last two bytes of their context; pinned."""

    def ask(batches):
        for batch in batches:
            for bucket, words, counts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "words", "counts")), strict=True):
                context, byte, weight, _, _ = contexts(words, np.frombuffer(counts, "<i8"))
                key = (context >> _KEY).astype(np.int64)
                cuts = np.append(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))), len(key))
                rows = [(bucket, int(key[s]), blob(context[s:e]), blob(byte[s:e]), blob(weight[s:e].astype("<i8"))) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.record_batch(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=[c.split()[0] for c in _REQUESTS.split(", ")],
                )

    return pin(vocabulary.select("bucket", "words", "counts").mapInArrow(ask, _REQUESTS))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers, by Stirling's series after a shift by 8."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def weighted(own: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Half of each, as logarithms."""
    return np.logaddexp(own, longer) - np.log(2)


class Tree:
    """Nodes of all contexts in one group, from ``DEPTH`` bytes down to ``floor`` bytes.

    ``levels[d][j]`` holds, for contexts of d bytes and decision j: the node of each pair
    of that depth, counts of zeros and ones, and the logarithms of the node's own and
    weighted probability. ``up[d]`` is the pair of depth d - 1 of each pair of depth d.
    """

    def __init__(self, context: np.ndarray, byte: np.ndarray, count: np.ndarray, floor: int = 2) -> None:
        self.levels, self.up, self.byte, self.context = {}, {}, {}, {}
        for d in range(DEPTH, floor - 1, -1):
            self.byte[d], self.context[d] = byte, context
            below = self.levels.get(d + 1)
            self.levels[d] = []
            for j in range(8):
                high = byte >> np.uint8(8 - j) if j else np.zeros(len(byte), np.uint8)
                new = np.ones(len(byte), bool)
                new[1:] = (context[1:] != context[:-1]) | (high[1:] != high[:-1])
                begin = np.flatnonzero(new)
                node = (np.cumsum(new) - 1).astype(np.int32)
                bit = (byte >> np.uint8(7 - j)) & np.uint8(1)
                total = np.add.reduceat(count, begin)
                ones = np.add.reduceat(np.where(bit == 1, count, 0), begin)
                own = log_kt(total - ones, ones)
                both = own
                if below is not None:
                    kid_node, _, _, _, kid_both = below[j]
                    parent = np.zeros(len(kid_both), np.int64)
                    parent[kid_node] = node[self.up[d + 1]]
                    both = weighted(own, np.bincount(parent, kid_both, len(begin)))
                self.levels[d].append((node, total - ones, ones, own, both))
            if d > floor:
                shorter = context & ~(np.uint64(0xFF) << np.uint64(8 * (8 - d)))
                order, begin = _grouped(shorter, byte)
                up = np.zeros(len(byte), np.int64)
                up[order[begin[1:]]] = 1
                up[order] = np.cumsum(up[order])
                self.up[d] = up
                context, byte, count = shorter[order[begin]], byte[order[begin]], np.add.reduceat(count[order], begin)

    def nodes(self, d: int) -> tuple[np.ndarray, ...]:
        """Of all nodes of contexts of d bytes: number in the byte's tree (1 to 255), zeros, ones, weighted log probability."""
        number, zeros, ones, both = [], [], [], []
        for j, (node, n0, n1, _, w) in enumerate(self.levels[d]):
            at = np.zeros(len(n0), np.int64)
            at[node] = (1 << j) | (self.byte[d].astype(np.int64) >> (8 - j))
            number.append(at)
            zeros.append(n0)
            ones.append(n1)
            both.append(w)
        return tuple(map(np.concatenate, (number, zeros, ones, both)))

    def log10_predictions(self, top: dict) -> np.ndarray:
        """For each pair of full depth, the logarithm of the byte's probability, mixed over all depths."""
        floor = min(self.levels)
        out = 0.0
        for j in range(8):
            row = np.arange(len(self.byte[DEPTH]))
            path = {DEPTH: row}
            for d in range(DEPTH, floor, -1):
                path[d - 1] = row = self.up[d][row]
            mixed, seen = None, None
            for d in range(DEPTH, floor - 1, -1):
                node, zeros, ones, own, both = self.levels[d][j]
                at = node[path[d]]
                bit = (self.byte[d][path[d]] >> np.uint8(7 - j)) & np.uint8(1)
                estimate = (np.where(bit == 1, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1.0)
                mixed, seen = _mixed(estimate, own[at], both[at], mixed, seen, zeros[at] + ones[at])
            byte = self.byte[DEPTH].astype(np.int64)
            number, bit = (1 << j) | (byte >> (8 - j)), byte >> (7 - j) & 1
            nearest = (self.context[DEPTH] >> np.uint64(56)).astype(np.int64)
            for d, at in ((1, (nearest, number)), (0, (0, number))):
                zeros, ones, own, both = (top[d, name][at] for name in ("zeros", "ones", "own", "both"))
                estimate = (np.where(bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1.0)
                mixed, seen = _mixed(estimate, own, both, mixed, seen, zeros + ones)
            out = out + np.log10(mixed)
        return out


def _mixed(estimate, own, both, longer, longer_seen, total):
    """Prediction of a node: its own and its longer context's, by their weights; a context not seen has no say."""
    if longer is None:
        return estimate, total > 0
    share = np.where(longer_seen, np.exp(own - np.log(2) - both), 1.0)
    return share * estimate + (1 - share) * longer, total > 0


def top_nodes(found: DataFrame) -> dict:
    """Counts and probabilities of contexts of one and no byte, from the nodes of contexts of two."""
    two = found.toPandas()
    out = {}
    key, number = two["key"].to_numpy(np.int64), two["node"].to_numpy(np.int64)
    zeros, ones, both = (two[c].to_numpy(float) for c in ("zeros", "ones", "both"))
    index, shape = (key >> 8) * 256 + number, (256, 256)
    for d in (1, 0):
        zeros, ones, longer = (np.bincount(index, x, shape[0] * 256) for x in (zeros, ones, both))
        own = log_kt(zeros, ones)
        both = weighted(own, longer)
        for name, x in (("zeros", zeros), ("ones", ones), ("own", own), ("both", both)):
            out[d, name] = x.reshape(shape)
        index, shape = np.arange(len(own)) % 256, (1, 256)
    return out


def _merged(group, n_texts: int):
    """All pairs of a group with their counts; the end token counts once for each training text."""
    context, byte, count = (
        np.concatenate([np.frombuffer(x, t) for x in group.column(c).to_pylist()])
        for c, t in (("contexts", "<u8"), ("bytes", "u1"), ("counts", "<i8"))
    )
    order, begin = _grouped(context, byte)
    total = np.add.reduceat(count[order], begin)
    context, byte = context[order[begin]], byte[order[begin]]
    total[(context == _START) & (byte == _END)] += n_texts
    return context, byte, total


def word_scores(vocabulary: DataFrame, n_tokens: int, n_texts: int) -> DataFrame:
    """bucket, hashes (sorted), counts, scores, and the same of frequent units; pinned."""
    asked = requests(vocabulary)
    spark = asked.sparkSession

    def grow(group):
        number, zeros, ones, both = Tree(*_merged(group, n_texts)).nodes(2)
        key = group.column("key")[0].as_py()
        return pa.table({"key": pa.array([key] * len(number), pa.int32()), "node": number, "zeros": zeros.astype(float), "ones": ones.astype(float), "both": both})

    top = spark.sparkContext.broadcast(
        top_nodes(asked.groupBy("key").applyInArrow(grow, "key int, node bigint, zeros double, ones double, both double"))
    )

    def answer(group):
        context, byte, count = _merged(group, n_texts)
        found = Tree(context, byte, count).log10_predictions(top.value)
        tagged = {}
        for k in np.unique(byte).tolist():
            some = np.flatnonzero(byte == k)
            tagged[k] = (context[some], found[some])
        out = []
        for own_context, own_byte in zip(group.column("contexts").to_pylist(), group.column("bytes").to_pylist(), strict=True):
            own_context, own_byte = np.frombuffer(own_context, "<u8"), np.frombuffer(own_byte, "u1")
            scores = np.zeros(len(own_byte))
            for k in np.unique(own_byte).tolist():
                some = np.flatnonzero(own_byte == k)
                scores[some] = tagged[k][1][np.searchsorted(tagged[k][0], own_context[some])]
            out.append(blob(scores))
        return pa.table({"bucket": group.column("bucket"), "key": group.column("key"), "answers": pa.array(out, pa.binary())})

    answers = asked.groupBy("key").applyInArrow(answer, "bucket int, key int, answers binary")
    least = max(1, -(-n_tokens // FREQUENT))

    def total(left, right):
        names = ("hashes", "counts", "scores", "often", "often_counts", "often_scores")
        rows = []
        for bucket, words, counts, of_word in zip(*(left.column(c).to_pylist() for c in ("bucket", "words", "counts", "of_word")), strict=True):
            counts, of_word = np.frombuffer(counts, "<i8"), np.frombuffer(of_word, "<i8")
            _, _, _, pair, first = contexts(words, counts)
            order = np.argsort(right.column("key").to_numpy())
            given = right.column("answers").to_pylist()
            score = np.concatenate([np.frombuffer(given[k], "<f8") for k in order])[pair]
            end_score = score[-1]
            scores = np.add.reduceat(score[:-1], first)
            hashes = parse(words).hash
            order = np.argsort(hashes)
            often = np.flatnonzero(counts >= least)
            rows.append((bucket, float(end_score), *(blob(x[k]) for k in (order, often) for x in (hashes, of_word, scores))))
        kinds = (pa.int32(), pa.float64(), *[pa.binary()] * 6)
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "end_score", *names])

    return pin(
        vocabulary.select("bucket", "words", "counts", "of_word")
        .groupBy("bucket")
        .cogroup(answers.groupBy("bucket"))
        .applyInArrow(
            total,
            "bucket int, end_score double, hashes binary, counts binary, scores binary,"
            " often binary, often_counts binary, often_scores binary",
        )
    )


#: Texts and rare units of a block.
BLOCK_TEXTS = 50_000
BLOCK_UNITS = 1_500_000

_PARTS = (
    "kind int, block bigint, place int, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, coded bigint, base double, score double,"
    " bucket int, hashes binary, places binary"
)


def look_up(docs: DataFrame, n: int, often, modulus: int, held_out: int) -> DataFrame:
    """Kind 0: a text, its place in a block, and what its frequent units give. Kind 1: other units of a block's texts, by bucket. Pinned."""

    def work(batches):
        names = [c.split()[0] for c in _PARTS.split(",")]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), *[pa.int64()] * 3, pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary()]
        # the last entry is for units that are not frequent
        table, base, score, (end_base, end_score, end_known) = often.value
        held: list = []
        block, n_texts, kept = None, 0, 0

        def flush():
            hashes, buckets, places = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(buckets, kind="stable")
            cuts = np.searchsorted(buckets[order], np.arange(n + 1))
            rows = [
                (1, block, *[None] * 8, b, blob(hashes[order[s:e]]), blob(places[order[s:e]].astype("<u4")))
                for b, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
                if e > s
            ]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in slices(batches):
            if block is None:
                block = batch.column("row")[0].as_py()
            found, sizes = split(texts(batch.column("text")))
            many = len(sizes)
            owner = np.repeat(np.arange(many), sizes)
            order = np.argsort(found.hash)
            at = np.empty(len(order), np.int64)
            at[order] = np.searchsorted(table[:-1], found.hash[order])
            known = (table[at] == found.hash) & (at < len(table) - 1)
            at[~known] = len(table) - 1
            one = np.flatnonzero(~known)
            buckets = (found.word_hash[one] % np.uint64(n)).astype(np.int64)
            held.append((found.hash[one], buckets, n_texts + owner[one]))
            sums = [np.bincount(owner, x[at], many) for x in (base, score)]
            n_known = np.bincount(owner[known], minlength=many)
            out = remainders(batch.column("doc_id"), modulus) == held_out
            coded = np.bincount(owner, found.size, many).astype(np.int64) + sizes + 1
            yield pa.record_batch(
                [
                    pa.array([0] * many, pa.int32()), pa.array([block] * many, pa.int64()),
                    pa.array(np.arange(n_texts, n_texts + many), pa.int32()), batch.column("doc_id"), pa.array(out),
                    pa.array(sizes + 1, pa.int64()), pa.array(n_known + end_known, pa.int64()), pa.array(coded, pa.int64()),
                    pa.array(sums[0] + end_base), pa.array(sums[1] + end_score),
                    *(pa.nulls(many, k) for k in kinds[10:]),
                ],
                names=names,
            )
            n_texts += many
            kept += len(one)
            if kept >= BLOCK_UNITS or n_texts >= BLOCK_TEXTS:
                yield from flush()
                held, block, n_texts, kept = [], None, 0, 0
        if held:
            yield from flush()

    return pin(docs.mapInArrow(work, _PARTS))


def meet(found: DataFrame, table: DataFrame) -> DataFrame:
    """One row for each block and bucket: what units that are not frequent give to the block's texts."""

    def add(left, right):
        hashes, counts, scores = (np.frombuffer(right.column(c)[0].as_py(), t) for c, t in (("hashes", "<u8"), ("counts", "<i8"), ("scores", "<f8")))
        base = np.log10(counts + 1.0)
        rows = []
        for block, own, places in zip(*(left.column(c).to_pylist() for c in ("block", "hashes", "places")), strict=True):
            at = np.searchsorted(hashes, np.frombuffer(own, "<u8"))
            places, number = np.unique(np.frombuffer(places, "<u4"), return_inverse=True)
            sums = (np.bincount(number, x[at], len(places)) for x in ((counts > 0).astype(float), base, scores))
            rows.append((block, blob(places), *map(blob, sums)))
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        kinds = (pa.int64(), *[pa.binary()] * 4)
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["block", "places", "known", "base", "score"])

    return (
        found.where("kind = 1").select("bucket", "block", "hashes", "places").groupBy("bucket")
        .cogroup(table.select("bucket", "hashes", "counts", "scores").groupBy("bucket"))
        .applyInArrow(add, "block bigint, places binary, known binary, base binary, score binary")
    )


_SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, coded bigint, base double, score double"


def _add_blocks(left, right):
    """The texts of a block with all their sums."""
    place = left.column("place").to_numpy()
    sums = np.zeros((3, int(place.max()) + 1 if len(place) else 0))
    for places, *found in zip(*(right.column(c).to_pylist() for c in ("places", "known", "base", "score")), strict=True):
        at = np.frombuffer(places, "<u4")
        for k, x in enumerate(found):
            sums[k, at] += np.frombuffer(x, "<f8")
    return pa.table(
        {
            **{c: left.column(c) for c in ("doc_id", "held_out", "n_tokens")},
            "n_known": left.column("n_known").to_numpy() + sums[0, place].astype(np.int64),
            "coded": left.column("coded"),
            "base": left.column("base").to_numpy() + sums[1, place],
            "score": left.column("score").to_numpy() + sums[2, place],
        }
    )


def score(docs: DataFrame, modulus: int = 7, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every text.

    Texts whose crc32(doc_id) leaves ``held_out`` are scored but not learned from.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = parts(text_bytes(rows), BUCKET_BYTES)
    out = F.crc32(F.col("doc_id").cast("string")) % modulus == held_out
    n_texts = rows.where(~F.coalesce(out, F.lit(False))).count()
    vocabulary = word_counts(rows, n, modulus, held_out)
    sums = vocabulary.agg(F.sum("n_tokens"), F.sum("n_known")).first()
    n_tokens, n_known = (sums[0] or 0) + n_texts, (sums[1] or 0) + (n_texts > 0)
    table = word_scores(vocabulary, n_tokens, n_texts)
    frequent, end_score = [], 0.0
    for r in table.select("often", "often_counts", "often_scores", "end_score").collect():
        frequent.append([np.frombuffer(x, t) for x, t in ((r.often, "<u8"), (r.often_counts, "<i8"), (r.often_scores, "<f8"))])
        end_score = r.end_score
    # without any word the end token is certain
    hashes, counts, scores = map(np.concatenate, zip(*frequent, strict=True)) if frequent else (np.zeros(0, t) for t in ("<u8", "<i8", "<f8"))
    order = np.argsort(hashes)
    end = (float(np.log10(n_texts + 1)), end_score, int(n_texts > 0))
    last = (hashes[order], np.uint64(0)), (np.log10(counts[order] + 1.0), 0.0), (scores[order], 0.0)
    often = spark.sparkContext.broadcast((*(np.append(*x) for x in last), end))
    # the number of a block's first row tells blocks apart; both kinds of rows are written by one job
    found = look_up(rows.withColumn("row", F.monotonically_increasing_id()), n, often, modulus, held_out)
    own = found.where("kind = 0").select("block", "place", "doc_id", "held_out", "n_tokens", "n_known", "coded", "base", "score")
    scored = own.groupBy("block").cogroup(meet(found, table).groupBy("block")).applyInArrow(_add_blocks, _SCORED)
    rest = float(np.log10(n_tokens + n_known + 1))
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n_tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(rest)).alias("base_score"),
        "score",
        (-F.col("score") * F.lit(float(np.log2(10))) / F.col("coded")).alias("bits_per_byte"),
    )
