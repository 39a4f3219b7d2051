"""Near-duplicate documents by Jaccard similarity of word shingles: an exact prefix join.

A text's set holds its distinct shingles of ``width`` lower-cased words (with
fewer words, all of them as one; without words, none). Sets are linked when
100 * intersection >= threshold * union, and documents get the component of their
links. Equal sets are one node, so copies cost one row each.

Tokens (shingles) have a class: frequent ones occur in more than ``COMMON`` documents.
All sets are ordered alike: rare tokens first, then frequent ones, each by hash. A set of
n tokens can miss at most m = n - ceil(n * threshold / 100) of them in a set it links with, so
its first m + 1 tokens hold one that the other has in its own prefix. If frequent
tokens stand among these, the prefix is extended by one token, and then either
a rare token or two frequent ones are common to both prefixes: rare tokens are
indexed singly, frequent ones as combinations of two. Combinations grow with the
square of a prefix, so sets of more than ``PAIRED`` tokens index single frequent
tokens instead; sets whose partners can be on either side of that size do both.

Sets that meet under a key are candidates. A rare token has at most ``COMMON`` sets,
so all its pairs that pass the length and position filters are verified. A
frequent key may have any number of sets, and two sets may share many such keys: sets that are connected by frequent
keys form a cluster (an index task sends one of its sets for each key, and where the others belong), and a cluster's sets are
compared once, in blocks. A block holds sets of one band of sizes; only
blocks of the same band or of neighbouring ones can hold links. The overlaps of two blocks are
a product of their matrices of shared tokens, worked on in slices of the vocabulary, and only a forest of the links that it
shows is written. So no pair is a row, however large the group; the work in a cluster of sets that share much
and are not linked still grows with its square, a block with another at a time. Nothing is dropped.

The classes come from counts of all tokens, kept in two Bloom filters of
bounded size (``filters.BITS``). A false positive puts a token later in the order, for all
documents alike, or indexes a token that only one document has; results are the same.

Null and empty texts have no shingles and are their own component; documents with
null ids take part and get the smallest id that is not null; rows that repeat are
copies; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterfold.llm.common import blob, parts, pin, prepare, slices, text_bytes, texts, unpin
from rosterfold.llm.components import components
from rosterfold.llm.filters import Filter, member_filter, token_filters
from rosterfold.llm.words import is_space, joined, lower, mix, prefix_hashes, runs, span_hashes

WIDTH = 5
THRESHOLD = 80

#: A token of more documents is frequent.
COMMON = 10

#: Sets of up to so many tokens index frequent tokens by twos: at most about 300 combinations.
PAIRED = 100

#: Bytes of text to a bucket of tokens or keys.
BUCKET_BYTES = 1 << 24

#: Sets of a block, and tokens of all its sets, about.
BLOCK_SETS = 1024
BLOCK_TOKENS = 1 << 20

#: Columns of a slice of the vocabulary.
_COLUMNS = 2048

_PAIR, _SINGLE = np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)


def shingle_sets(found: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, and where each text's begin (one more entry than texts)."""
    data, first, last = joined(found)
    owners = np.repeat(np.arange(len(found)), last - first + 1)
    starts, ends = runs(~is_space(data))
    words = span_hashes(prefix_hashes(lower(data)), starts, ends)
    owner = owners[starts]
    sizes = np.bincount(owner, minlength=len(found))
    total = np.full(len(words), width, np.uint64)
    for k in range(width):
        total[: len(words) - k] = mix(total[: len(words) - k] + words[k:])
    keep = np.zeros(len(words), bool)
    keep[: len(words) - width + 1] = owner[: len(words) - width + 1] == owner[width - 1 :] if len(words) >= width else False
    for d in np.flatnonzero((sizes > 0) & (sizes < width)):
        k = int(np.searchsorted(owner, d))
        whole = np.full(1, sizes[d], np.uint64)
        for j in range(sizes[d]):
            whole = mix(whole + words[k + j : k + j + 1])
        total[k], keep[k] = whole[0], True
    total, owner = total[keep], owner[keep]
    order = np.lexsort((total, owner))
    total, owner = total[order], owner[order]
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
    total, owner = total[new], owner[new]
    return total, np.searchsorted(owner, np.arange(len(found) + 1))


def keys_of(tokens: np.ndarray, common: np.ndarray, repeated: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of one set, their places in the order, and which of them are of frequent tokens."""
    n = len(tokens)
    if n < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    order = np.lexsort((tokens, common))
    may_miss = n - -(-n * threshold // 100)
    rare = int(n - common.sum())
    length = may_miss + 1
    low, high = PAIRED * threshold / 100, PAIRED * 100 / threshold
    plain = order[: min(length, rare)]
    at = np.flatnonzero(repeated[plain])
    keys, places, often = [tokens[plain[at]]], [at], [np.zeros(len(at), bool)]
    if length > rare:
        if n <= high:
            own = tokens[order[rare : length + 1]]
            first, second = np.triu_indices(len(own), 1)
            keys.append(mix(mix(own[first] ^ _PAIR) + own[second]))
            places.append(np.zeros(len(first), np.int64))
            often.append(np.ones(len(first), bool))
        if n > low:
            own = order[rare:length]
            keys.append(mix(tokens[own] ^ _SINGLE))
            places.append(np.arange(rare, length))
            often.append(np.ones(len(own), bool))
    return np.concatenate(keys), np.concatenate(places), np.concatenate(often)


_INDEX = "kind int, doc_id bigint, digest binary, n bigint, key bigint, bucket int, keys binary, nodes binary, sizes binary, places binary, often binary"


def node_of(tokens: np.ndarray, mixed: np.ndarray) -> int:
    """One number for a set: equal sets are one node."""
    both = mixed.sum(dtype=np.uint64) ^ np.bitwise_xor.reduce(tokens)
    return int((mix(np.array([both])) + np.uint64(len(tokens))).view(np.int64)[0])


def _connected(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """The smallest of the numbers 0 to ``size`` that each is connected with, by edges (a, b)."""
    label = np.arange(size)
    while len(a):
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _clusters(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes, each once, and the node that stands for all that share keys with it, directly or through others."""
    own, number = np.unique(nodes, return_inverse=True)
    order = np.argsort(keys, kind="stable")
    new = np.concatenate(([True], keys[order][1:] != keys[order][:-1])) if len(keys) else np.zeros(0, bool)
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(keys) else order
    return own, own[_connected(number[order], number[first], len(own))]


def index(docs: DataFrame, n: int, filters, width: int, threshold: int) -> DataFrame:
    """Kind 0: each row's node and size. Kind 1: keys with their nodes, by bucket. Kind 2: nodes in one cluster (key, n)."""

    def build(batches):
        repeated, common = (Filter(bits, n) for bits in filters.value)
        names = [c.split()[0] for c in _INDEX.split(", ")]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
        seen: set[int] = set()
        held: list[tuple] = []
        kept = 0

        def table(rows):
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        def flush():
            keys, nodes, sizes, places, often = (np.concatenate(c) for c in zip(*held, strict=True))
            at = np.flatnonzero(often)
            own, root = _clusters(keys[at], nodes[at])
            moved = own != root
            if moved.any():
                yield table([(2, None, None, r, k, *[None] * 6) for k, r in zip(own[moved].tolist(), root[moved].tolist(), strict=True)])
            nodes[at] = root[np.searchsorted(own, nodes[at])]  # one node of this task for each frequent key
            _, one = np.unique(keys[at], return_index=True)
            some = np.concatenate((np.flatnonzero(~often), at[one]))
            keys, nodes, sizes, places, often = (x[some] for x in (keys, nodes, sizes, places, often))
            bucket = (keys % np.uint64(n)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(n + 1))
            for b, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if e > s:
                    some = order[s:e]
                    yield table(
                        [(1, None, None, None, None, b, blob(keys[some]), blob(nodes[some]), blob(sizes[some].astype("<u4")), blob(places[some].astype("<u4")), blob(often[some]))]
                    )

        for batch in slices(batches):
            found = texts(batch.column("text"))
            tokens, cuts = shingle_sets(found, width)
            is_common, is_repeated = common.has(tokens), repeated.has(tokens)
            mixed = mix(tokens)
            rows = []
            for doc_id, text, s, e in zip(batch.column("doc_id").to_pylist(), found, cuts[:-1], cuts[1:], strict=True):
                digest = hashlib.sha256(text).digest()
                if s == e:
                    rows.append((0, doc_id, digest, 0, *[None] * 7))
                    continue
                node = node_of(tokens[s:e], mixed[s:e])
                rows.append((0, doc_id, digest, int(e - s), node, *[None] * 6))
                if node in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(node)
                keys, places, often = keys_of(tokens[s:e], is_common[s:e], is_repeated[s:e], threshold)
                if len(keys):
                    held.append((keys, np.full(len(keys), node, np.int64), np.full(len(keys), e - s), places, often))
                    kept += len(keys)
                if kept > 500_000:
                    yield from flush()
                    held.clear()
                    kept = 0
            yield table(rows)
        if kept:
            yield from flush()

    return pin(docs.select("doc_id", "text").mapInArrow(build, _INDEX))


def _linkable(n1: np.ndarray, n2: np.ndarray, overlap: np.ndarray, threshold: int) -> np.ndarray:
    """Whether sets of these sizes with at most this overlap can be linked."""
    return 100 * overlap >= threshold * (n1 + n2 - overlap)


def candidates(found: DataFrame, threshold: int) -> DataFrame:
    """Kind 1: pairs under rare keys (a, b). Kind 2: nodes in one cluster (a, b)."""

    def meet(group):
        keys, nodes = (np.concatenate([np.frombuffer(x, t) for x in group.column(c).to_pylist()]) for c, t in (("keys", "<u8"), ("nodes", "<i8")))
        sizes, places = (np.concatenate([np.frombuffer(x, "<u4") for x in group.column(c).to_pylist()]).astype(np.int64) for c in ("sizes", "places"))
        often = np.concatenate([np.frombuffer(x, bool) for x in group.column("often").to_pylist()])
        own, root = _clusters(keys[often], nodes[often])
        rare = np.lexsort((nodes, keys))
        rare = rare[~often[rare]]
        keys, nodes, sizes, places = (x[rare] for x in (keys, nodes, sizes, places))
        new = np.ones(len(keys), bool)  # copies in different tasks give the same row
        new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
        keys, nodes, sizes, places = (x[new] for x in (keys, nodes, sizes, places))
        begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        count = np.diff(np.append(begin, len(keys)))
        pairs = [np.zeros((0, 2), np.int64)]
        for size in np.unique(count[count > 1]).tolist():
            rows = begin[count == size]
            first, second = np.triu_indices(size, 1)
            step = max(1, 4_000_000 // len(first))
            for k in range(0, len(rows), step):
                i, j = (rows[k : k + step, None] + first).ravel(), (rows[k : k + step, None] + second).ravel()
                most = np.minimum(places[i], places[j]) + np.minimum(sizes[i] - places[i], sizes[j] - places[j])
                good = _linkable(sizes[i], sizes[j], most, threshold)
                pairs.append(np.unique(np.stack([nodes[i[good]], nodes[j[good]]], 1), axis=0))
        pairs_ = np.unique(np.concatenate(pairs), axis=0)
        moved = own != root
        return pa.table(
            {
                "kind": pa.array([1] * len(pairs_) + [2] * int(moved.sum()), pa.int32()),
                "a": pa.array(np.concatenate([pairs_[:, 0], own[moved]])),
                "b": pa.array(np.concatenate([pairs_[:, 1], root[moved]])),
            }
        )

    met = (
        found.where("kind = 1")
        .select("bucket", "keys", "nodes", "sizes", "places", "often")
        .groupBy("bucket")
        .applyInArrow(meet, "kind int, a bigint, b bigint")
    )
    return pin(met.unionByName(found.where("kind = 2").select("kind", F.col("key").alias("a"), F.col("n").alias("b"))).distinct())


def sets_of(docs: DataFrame, nodes: DataFrame, n: int, nbytes: int, width: int) -> DataFrame:
    """key, keys: the sets of these nodes (key); pinned."""
    wanted = docs.sparkSession.sparkContext.broadcast(
        member_filter(nodes.select(F.col("key").alias("token")), n, nbytes)
    )

    def build(batches):
        wants = Filter(*wanted.value)
        seen: set[int] = set()
        for batch in slices(batches):
            tokens, cuts = shingle_sets(texts(batch.column("text")), width)
            mixed = mix(tokens)
            some = [(s, e) for s, e in zip(cuts[:-1], cuts[1:], strict=True) if e > s]
            own = np.array([node_of(tokens[s:e], mixed[s:e]) for s, e in some], np.int64)
            rows = []
            for node, (s, e), good in zip(own.tolist(), some, wants.has(mix(own.view(np.uint64))), strict=True):
                if good and node not in seen:
                    if len(seen) < 200_000:
                        seen.add(node)
                    rows.append((node, blob(tokens[s:e])))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary()), strict=True)], names=["key", "keys"])

    found = docs.select("text").mapInArrow(build, "key bigint, keys binary")
    out = pin(found.join(nodes, "key", "left_semi").groupBy("key").agg(F.any_value("keys").alias("keys")))
    wanted.unpersist()
    return out


def verify(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose sets are linked."""

    def check(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
                x, y = _tokens(x), _tokens(y)
                both = np.concatenate((x, y))
                both.sort()
                overlap = int((both[1:] == both[:-1]).sum())
                good.append(100 * overlap >= threshold * (len(x) + len(y) - overlap))
            mask = pa.array(good, pa.bool_())
            yield pa.record_batch({c: batch.column(c).filter(mask) for c in ("a", "b")})

    one = pairs.select("a", "b").distinct()
    with_b = one.join(sets.select(F.col("key").alias("b"), F.col("keys").alias("set_b")), "b")
    both = with_b.join(sets.select(F.col("key").alias("a"), F.col("keys").alias("set_a")), "a")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(check, "a bigint, b bigint")


def _tokens(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over slices of the tokens that both sides hold."""
    every = [np.concatenate(x) for x in (left, right)]
    shared = np.intersect1d(*every)
    sides = []
    for sets, tokens in zip((left, right), every, strict=True):
        column = np.searchsorted(shared, tokens)
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        good = column < len(shared)
        good[good] = shared[column[good]] == tokens[good]
        order = np.argsort(column[good], kind="stable")
        sides.append((row[good][order], column[good][order]))
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(shared), _COLUMNS):
        parts_ = []
        for sets, (row, column) in zip((left, right), sides, strict=True):
            s, e = np.searchsorted(column, (at, at + _COLUMNS))
            matrix = np.zeros((len(sets), _COLUMNS), np.float32)
            matrix[row[s:e], column[s:e] - at] = 1
            parts_.append(matrix)
        out += parts_[0] @ parts_[1].T
    return out.astype(np.int64)


def block_links(members: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) that connect what is linked within each cluster, from members (cluster, node, n, keys), a table."""
    # sizes of linked sets differ by less than one step, whatever the rounding
    step = -math.log(threshold / 100) * (1 + 1e-9)
    banded = members.withColumn("band", F.floor(F.log("n") / F.lit(step)).cast("int"))
    sizes = banded.groupBy("cluster", "band").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_SETS)), F.ceil(F.sum("n") / F.lit(BLOCK_TOKENS))
        ).cast("int").alias("blocks")
    )
    above = sizes.select("cluster", (F.col("band") - 1).alias("band"), F.col("blocks").alias("next_blocks"))
    below = sizes.select("cluster", (F.col("band") + 1).alias("band"), F.col("blocks").alias("last_blocks"))
    dealt = (
        banded.join(sizes, ["cluster", "band"]).join(above, ["cluster", "band"], "left").join(below, ["cluster", "band"], "left")
        .withColumn("block", F.expr("CAST(pmod(xxhash64(node), blocks) AS INT)"))
    )
    # each set goes to the pairs of its block with all blocks of its band and of both neighbours
    none = "CAST(array() AS array<struct<band:int,other:int,i:int,j:int>>)"
    numbers = "transform(sequence(0, {0} - 1), k -> struct(CAST({1} AS INT) AS band, {2} AS other, {3} AS i, {4} AS j))"
    same = numbers.format("blocks", "band", "0", "least(block, k)", "greatest(block, k)")
    up = f"IF(next_blocks IS NULL, {none}, {numbers.format('next_blocks', 'band', '1', 'block', 'k')})"
    down = f"IF(last_blocks IS NULL, {none}, {numbers.format('last_blocks', 'band - 1', '1', 'k', 'block')})"
    pairs = dealt.withColumn("pair", F.explode(F.expr(f"concat({same}, {up}, {down})")))
    # the side of a set in its pair: the first block, or the second
    side = F.expr("IF(pair.other = 0, block = pair.i, band = pair.band)")

    def compare(table):
        nodes, first = table.column("node").to_numpy(), np.array(table.column("first").to_pylist(), bool)
        sets = [_tokens(x) for x in table.column("keys").to_pylist()]
        alone = first.all()  # a block with itself
        left, right = np.flatnonzero(first), np.flatnonzero(first if alone else ~first)
        if not len(left) or not len(right):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        n = np.array([len(x) for x in sets])
        overlap = _overlaps([sets[k] for k in left], [sets[k] for k in right])
        linked = 100 * overlap >= threshold * (n[left][:, None] + n[right] - overlap)
        x, y = np.nonzero(linked)
        x, y = left[x], right[y]
        root = _connected(x[x != y], y[x != y], len(nodes))
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.table({"a": nodes[moved], "b": nodes[root[moved]]})

    return (
        pairs.select("cluster", "pair.band", "pair.other", "pair.i", "pair.j", "node", "keys", side.alias("first"))
        .groupBy("cluster", "band", "other", "i", "j")
        .applyInArrow(compare, "a bigint, b bigint")
    )


def labels(docs: DataFrame, found: DataFrame, n: int, nbytes: int, width: int, threshold: int) -> DataFrame:
    """node, component of every node that has a link."""
    met = candidates(found, threshold)
    rare = met.where("kind = 1").select("a", "b")
    cluster = pin(components(met.where("kind = 2").select("a", "b")).select(F.col("node").alias("key"), F.col("component").alias("cluster")))
    paired = rare.select(F.explode(F.array("a", "b")).alias("key"))
    sets = sets_of(docs, pin(paired.union(cluster.select("key")).distinct()), n, nbytes, width)
    members = pin(
        cluster.join(sets, "key").select("cluster", F.col("key").alias("node"), (F.length("keys") / 8).cast("bigint").alias("n"), "keys")
    )
    links = pin(verify(rare, sets, threshold).unionByName(block_links(members, threshold)).distinct())
    for table in (met, members, sets, cluster):
        unpin(table)
    return components(links)


def _labelled(docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """doc_id, digest, n, key (node), component of every row; key and component are null without shingles."""
    spark = docs.sparkSession
    prepare(spark)
    nbytes = text_bytes(docs)
    n = parts(nbytes, BUCKET_BYTES)
    filters = spark.sparkContext.broadcast(token_filters(docs, n, nbytes, lambda found: shingle_sets(found, width)[0], (1, COMMON)))
    found = index(docs, n, filters, width, threshold)
    filters.unpersist()
    del filters
    label = labels(docs, found, n, nbytes, width, threshold).withColumnRenamed("node", "key")
    rows = found.where("kind = 0").select("doc_id", "digest", "n", "key")
    return rows.join(label, "key", "left").select("doc_id", "digest", "n", "key", F.coalesce("component", "key").alias("component"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id for every document."""
    found = _labelled(docs, width, threshold).withColumnRenamed("n", "n_shingles")
    least = found.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    alone = found.where("component IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.join(least, "component").select("doc_id", "n_shingles", "component_id").unionByName(alone)


def representatives(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """One row of each component, with all its columns: the smallest id (null last), then the smallest digest of its text.

    Of rows with the same id and text, the one whose columns are smallest in their order stays. Rows without words are
    not linked with anything and stay. A column that takes part must be of a type that can be ordered.
    """
    if "__digest" in docs.columns:
        raise ValueError("column __digest is taken")
    found = _labelled(docs.select("doc_id", "text"), width, threshold)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    stays = found.where("component IS NOT NULL").groupBy("component").agg(first).select("first.doc_id", F.col("first.digest").alias("__digest"))
    keyed = docs.withColumn("__digest", F.unhex(F.sha2(F.col("text"), 256)))
    other = stays.select(F.col("doc_id").alias("__id"), F.col("__digest").alias("__own"))
    chosen = keyed.join(other, keyed["doc_id"].eqNullSafe(other["__id"]) & (keyed["__digest"] == other["__own"]), "left_semi")
    row = F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row")
    one = chosen.groupBy("doc_id", "__digest").agg(row).select("row.*")
    wordless = docs.where(F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return one.unionByName(wordless)

