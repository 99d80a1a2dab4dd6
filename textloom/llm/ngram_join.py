"""N-gram Jaccard join: MinHash bands give candidates, Bayesian pruning drops most, the rest are verified exactly."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import blocks, bounds, coded, cut, fields, fresh, in_arrow, tidied

#: Words in a shingle; least similarity; MinHash values (16 bits of each are kept: unequal ones agree once in 65,536),
#: of which ROWS at a time make a band.
WORDS, THRESHOLD, HASHES, ROWS = 5, 0.8, 96, 4
#: Pairs whose posterior probability of reaching the threshold is below this are dropped; values compared at a time.
TOLERANCE, STEP = 1e-6, 8
#: Larger buckets are cut into blocks that are compared two by two, each pair of blocks in a task of its own.
SMALL, BLOCK_ROWS, BLOCK_SHINGLES = 64, 512, 2_000_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def _shingled(block: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each text's word sequence; its shingle hashes, text by text; and where each text's begin and end.

    Words are what stands between white space, lower-cased. A text of fewer than ``size`` words has one shingle.
    """
    items, rows = fields(pc.utf8_lower(pc.fill_null(block.column("text").cast("large_string"), "")))
    uniq, index = coded(items)
    n = block.num_rows
    word = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in uniq), dtype=np.uint64, count=len(uniq))[index] if uniq else np.empty(0, np.uint64)
    at = bounds(rows, n)
    count = np.diff(at)
    place = (np.arange(len(word)) - at[rows]).astype(np.uint64) if len(word) else word
    mixed = (word ^ (place * _MULTIPLIER)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)))
    content = (total[at[1:]] - total[at[:-1]]) ^ (count.astype(np.uint64) * _MULTIPLIER)
    rolling = np.zeros(len(word), np.uint64)
    for k in range(size):
        shifted = np.zeros(len(word), np.uint64)
        shifted[: len(word) - k] = word[k:]
        # Past the text's end nothing is added: a short text is one shingle of all its words.
        inside = (place + np.uint64(k)) < count[rows].astype(np.uint64) if len(word) else np.empty(0, bool)
        rolling = np.where(inside, (rolling ^ shifted) * _MULTIPLIER + np.uint64(k + 1), rolling)
        rolling ^= rolling >> np.uint64(31)
    first = (place == 0) | (place + np.uint64(size) <= count[rows].astype(np.uint64)) if len(word) else np.empty(0, bool)
    return content, rolling[first], bounds(rows[first], n)


def _signatures(size: int):
    """doc_id, node (hash of the words), n (shingles) and sig of each text that has a word."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = _coefficients()
        for block in blocks(batches, limit=1 << 20):
            node, shingles, at = _shingled(block, size)
            some = np.flatnonzero(np.diff(at))
            sig = np.empty((len(some), HASHES), dtype=np.uint16)
            for k in range(HASHES if len(some) else 0):
                sig[:, k] = np.minimum.reduceat((shingles * mul[k] + add[k]) >> np.uint64(32), at[some]).astype(np.uint16)
            keep = pa.array(some)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id").take(keep), pa.array(node[some].view(np.int64)), pa.array(np.diff(at)[some], pa.int64()), pa.array([x.tobytes() for x in sig], pa.binary())],
                names=["doc_id", "node", "n", "sig"],
            )

    return run


def _sets(size: int):
    """node and its distinct shingles, of each text that has a word."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=1 << 20):
            node, shingles, at = _shingled(block, size)
            some = np.flatnonzero(np.diff(at))
            sets = [np.unique(shingles[at[i] : at[i + 1]].view(np.int64)) for i in some]
            yield pa.RecordBatch.from_arrays([pa.array(node[some].view(np.int64)), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return run


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """For n compared values (n a multiple of STEP) the fewest matches m at which a pair is kept.

    With a uniform prior the similarity given m of n has a Beta(m + 1, n - m + 1) posterior, whose mass from the
    threshold on is P(Binomial(n + 1, threshold) <= m).
    """
    out = np.zeros(HASHES + 1, dtype=np.int64)
    for n in range(STEP, HASHES + 1, STEP):
        mass = np.cumsum([math.comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(n + 1)])
        out[n] = int(np.searchsorted(mass, tolerance))
    return out


def prune(sig: np.ndarray, a: np.ndarray, b: np.ndarray, band: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) of rows stay: by stepwise comparison, and if ``band`` is the first band they share."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), dtype=np.int64)
    for n in range(STEP, HASHES + 1, STEP):
        matches[alive] += (sig[a[alive], n - STEP : n] == sig[b[alive], n - STEP : n]).sum(axis=1)
        alive = alive[matches[alive] >= least[n]]
    same = (sig[a[alive]] == sig[b[alive]]).reshape(len(alive), HASHES // ROWS, ROWS).all(axis=2)
    return alive[same.argmax(axis=1) == band[alive]]


def _small_buckets(threshold: float, tolerance: float):
    """Pairs of nodes that stay, from rows sorted by bucket key; a bucket may go on in the next batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = least_matches(threshold, tolerance)
        held = None
        for batch in _with_end(batches):
            if batch is not None:
                got = (np.asarray(batch.column("key")), np.asarray(batch.column("band")), np.asarray(batch.column("node")), np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint16).reshape(-1, HASHES))
                held = got if held is None else tuple(np.concatenate(x) for x in zip(held, got, strict=True))
            if held is None or not len(held[0]):
                continue
            whole = len(held[0]) if batch is None else int(np.searchsorted(held[0], held[0][-1], side="left"))
            key, band, node, sig = (x[:whole] for x in held)
            held = tuple(x[whole:] for x in held)
            for d in range(1, SMALL):
                a = np.flatnonzero(key[:-d] == key[d:]) if len(key) > d else np.empty(0, int)
                if not len(a):
                    break
                for part in np.array_split(a, max(1, len(a) // 100_000)):
                    kept = part[prune(sig, part, part + d, band[part], least)]
                    x, y = node[kept], node[kept + d]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return run


def _with_end(batches: Iterable) -> Iterator:
    yield from batches
    yield None


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows is joined to, by the pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _block_pair(threshold: float, tolerance: float):
    """Links of two blocks of a large bucket: for each node how many documents it is linked to, and a joined node."""

    def run(table: pa.Table) -> pa.Table:
        least = least_matches(threshold, tolerance)
        node, side, copies = (np.asarray(table.column(x).combine_chunks()) for x in ("node", "side", "copies"))
        band = int(table.column("band")[0].as_py())
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint16).reshape(-1, HASHES)
        lists = table.column("shingles").combine_chunks()
        begins = np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(lists)))))
        codes = np.unique(np.asarray(lists.flatten()), return_inverse=True)[1]
        size = np.diff(begins)
        mark = np.zeros(len(codes) + 1, dtype=np.int32)
        links = np.zeros(len(node), dtype=np.int64)
        ends: list[np.ndarray] = []
        one_block = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        for i in range(len(node)):
            others = np.arange(i + 1, len(node)) if one_block else (np.flatnonzero(side == 1) if side[i] == 0 else np.empty(0, int))
            if not len(others):
                continue
            others = others[prune(sig, np.full(len(others), i), others, np.full(len(others), band), least)]
            if not len(others):
                continue
            mine = codes[begins[i] : begins[i + 1]]
            mark[mine] = 1
            through = np.concatenate(([0], np.cumsum(mark[codes])))
            shared = through[begins[others + 1]] - through[begins[others]]
            mark[mine] = 0
            others = others[shared >= threshold * (size[i] + size[others] - shared) - 1e-9]
            links[i] += copies[others].sum()
            links[others] += copies[i]
            ends.append(np.stack([np.full(len(others), i), others]))
        a, b = np.concatenate(ends, axis=1) if ends else np.empty((2, 0), int)
        root = _components(len(node), a, b)
        some = np.flatnonzero(links)
        return pa.table({"node": pa.array(node[some]), "links": pa.array(links[some]), "root": pa.array(node[root[some]])})

    return run


def _one_of_blocks(threshold: float, tolerance: float):
    """Which rows of two blocks (or of one with itself) of a bucket are joined: each row's node with that of its group.

    Rows with one ``label`` are joined already. Pairs within a group aren't compared any more, so that a block of near
    copies costs about as many comparisons as it has rows.
    """

    def run(table: pa.Table) -> pa.Table:
        least = least_matches(threshold, tolerance)
        node, side, known = (np.asarray(table.column(x).combine_chunks()) for x in ("node", "side", "label"))
        band = int(table.column("band")[0].as_py())
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint16).reshape(-1, HASHES)
        lists = table.column("shingles").combine_chunks()
        begins = np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(lists)))))
        codes = np.unique(np.asarray(lists.flatten()), return_inverse=True)[1]
        size, mark = np.diff(begins), np.zeros(len(codes) + 1, dtype=bool)
        root = np.unique(known, return_index=True)[1][np.unique(known, return_inverse=True)[1]]
        alone = not side.any()
        for i in range(len(node)):
            others = np.arange(i + 1, len(node)) if alone else (np.flatnonzero(side == 1) if side[i] == 0 else np.empty(0, int))
            others = others[root[others] != root[i]]
            if len(others):
                others = others[prune(sig, np.full(len(others), i), others, np.full(len(others), band), least)]
            if not len(others):
                continue
            mark[codes[begins[i] : begins[i + 1]]] = True
            for j in others.tolist():
                if root[j] != root[i]:
                    shared = int(mark[codes[begins[j] : begins[j + 1]]].sum())
                    if shared >= threshold * (size[i] + size[j] - shared) - 1e-9:
                        root[root == root[j]] = root[i]
            mark[codes[begins[i] : begins[i + 1]]] = False
        return pa.table({"key": table.column("key"), "node": pa.array(node), "root": pa.array(node[root])})

    return run


def _large_classes(large: DataFrame, nodes: DataFrame, sets: DataFrame, linked: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(node, component) of the nodes that links join, where buckets are too large to compare all their rows.

    A bucket's blocks are grouped each by itself, then one row of each group is compared with the others'. What is joined
    by then needs no more comparison. Last, the rows outside their bucket's largest group are compared with all rows of
    other groups: so every pair was compared, or stands in one group.
    """
    kind = "key bigint, node bigint, root bigint"

    def compared(rows: DataFrame) -> DataFrame:
        loaded = rows.join(nodes.select("node", "sig"), "node").join(sets, "node")
        return cut(loaded.groupBy("key", "i", "j").applyInArrow(_one_of_blocks(threshold, tolerance), kind))

    def blocked(rows: DataFrame) -> DataFrame:
        """``rows`` (node, key, size and shingles of their bucket) with the number of blocks of the bucket and their own."""
        of = F.greatest(F.ceil(F.col("size") / BLOCK_ROWS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
        return rows.withColumn("of", of).withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("of")).cast("int"))

    own = compared(blocked(large).select("node", "key", "band", F.col("block").alias("i"), F.col("block").alias("j"), F.lit(0).alias("side"), F.col("node").alias("label")))
    heads = own.select("key", F.col("root").alias("node")).distinct().join(nodes.select("node", "n"), "node")
    sizes = heads.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("shingles")).join(large.select("key", "band").distinct(), "key")
    heads = blocked(heads.drop("n").join(sizes.where("size > 1"), "key"))
    other = heads.select("node", "key", "band", "block", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("other"))
    side = F.when(F.col("block") > F.col("other"), 1).otherwise(0)
    between = compared(other.select("node", "key", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), side.alias("side"), F.col("node").alias("label")))
    edges = lambda x: x.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b")
    label = cut(_join_labels(linked.unionAll(edges(own)).unionAll(edges(between))))

    named = cut(large.join(label, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component"))
    most = named.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("labels"))
    # Buckets of one group, as most are by now, need nothing more.
    placed = blocked(named.join(most.where("labels > 1"), "key"))
    rest = placed.where("label <> main")
    parts = rest.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("key", "node"), F.col("parts")).cast("int")
    members = placed.join(parts, "key").select("node", "key", "band", F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), F.lit(0).alias("side"), "label")
    strangers = rest.join(parts, "key").select("node", "key", "band", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("i"), part.alias("j"), F.lit(1).alias("side"), "label")
    last = edges(compared(members.unionByName(strangers)))
    return label if last.isEmpty() else _join_labels(label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(last))


def _join_labels(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (a, b): the smallest label spreads, and labels jump to their own."""
    both = cut(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = both.join(label, both["b"] == label["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        spread = label.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        jump = label.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = cut(spread.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("next", "component")).alias("component")))
        if new.where("old <> component").isEmpty():
            return new.select("node", "component")
        label = new.select("node", "component")


def _candidates(source: DataFrame, size: int, threshold: float, tolerance: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """The documents' nodes, the nodes, the members of large buckets, the shingles of all candidates, and the links of small buckets."""
    signed = cut(source.where("doc_id IS NOT NULL").transform(in_arrow, tidied(_signatures(size)), "doc_id bigint, node bigint, n bigint, sig binary"))
    nodes = cut(signed.groupBy("node").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig")))

    keys = nodes.select("node", "n", F.posexplode(F.expr(f"transform(sequence(0, {HASHES // ROWS - 1}), b -> xxhash64(b, substring(sig, b * {ROWS * 2} + 1, {ROWS * 2})))")).alias("band", "key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("shingles")).where("size > 1")
    members = cut(keys.drop("n").join(buckets, "key"))
    small, large = members.where(f"size <= {SMALL}"), members.where(f"size > {SMALL}")

    sorted_ = small.select("node", "band", "key").join(nodes.select("node", "sig"), "node").repartition("key").sortWithinPartitions("key").select("key", "band", "node", "sig")
    pairs = cut(sorted_.transform(in_arrow, tidied(_small_buckets(threshold, tolerance)), "a bigint, b bigint"))

    wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).unionAll(large.select("node")).distinct()
    wanted = cut(nodes.join(wanted, "node", "left_semi").select("node", "copy_id"))
    # The ids grow with the corpus: the same join at every size.
    texts = source.join(wanted.select(F.col("copy_id").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    sets = cut(texts.transform(in_arrow, tidied(_sets(size)), "node bigint, shingles array<bigint>").join(wanted, "node", "left_semi").dropDuplicates(["node"]))

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    shared = F.size(F.array_intersect("x", "y"))
    linked = cut(left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").where(shared >= F.lit(threshold) * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b"))
    return signed, nodes, large, sets, linked


def link_classes(docs: DataFrame, size: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): class_id, n_links, copy_id and n_copies.

    Texts with the same words (lower-cased, between white space) are copies: copy_id is the smallest id of such a
    group, n_copies its size. Groups whose sets of ``size``-word shingles have a Jaccard similarity of ``threshold`` or
    more are linked: n_links is how many other documents a document is linked to, copies included. class_id is the
    smallest id of all that links join. A pair is compared in the first band that both share, so it counts once.

    A text that is null, empty or without a word, and a row with a null id, is linked to nothing: its class is its own
    id, with n_copies 1. Texts of fewer than ``size`` words have one shingle. Repeated rows count as copies. Other
    columns are ignored.

    Nodes are 64-bit hashes of the words: among 10**8 different texts one collision is to be expected in some 4,000
    runs.
    """
    source = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    signed, nodes, large, sets, linked = _candidates(source, size, threshold, tolerance)

    # Large buckets: each row goes to its block's pairs with all blocks, not to all other rows.
    n_blocks = F.greatest(F.ceil(F.col("size") / BLOCK_ROWS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    placed = large.withColumn("of", n_blocks).withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("of")).cast("int"))
    spread = placed.select("node", "key", "band", "block", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("other"))
    spread = spread.select("node", "key", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    loaded = spread.join(nodes.select("node", "copies", "sig"), "node").join(sets, "node")
    in_large = cut(loaded.groupBy("key", "i", "j").applyInArrow(_block_pair(threshold, tolerance), "node bigint, links bigint, root bigint"))

    copies = nodes.select("node", "copies")
    counted = (
        linked.join(copies.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), F.col("copies").alias("links"))
        .unionAll(linked.join(copies.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), F.col("copies").alias("links")))
        .unionAll(in_large.select("node", "links"))
    )
    counted = counted.groupBy("node").agg(F.sum("links").alias("links"))
    label = _join_labels(linked.unionAll(in_large.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b")))

    labelled = nodes.select("node", "copy_id", "copies").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = labelled.groupBy("component").agg(F.min("copy_id").alias("class_id"))
    known = labelled.join(classes, "component").join(counted, "node", "left").select("node", "copy_id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    known = cut(known)  # so that the join below stands alone, and the rows of a large group of copies can be split
    found = signed.select("doc_id", "node").join(known, "node").select("doc_id", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "copy_id", F.col("copies").alias("n_copies"))
    wordless = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n\x0B\f\r]+", "")) == 0
    rest = source.where(F.col("doc_id").isNull() | wordless)
    own = F.col("doc_id")
    return found.unionAll(rest.select(own, own.alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), own.alias("copy_id"), F.lit(1).cast("bigint").alias("n_copies")))


def keep_one(docs: DataFrame, size: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` (doc_id, text) with one document of each class of ``link_classes``, that with the smallest id.

    Only classes are needed, so the rows of a large bucket are compared until they are joined, not all with all. Rows
    with a null id and texts without a word stay. Of rows alike in id and text one stays (the least by its columns, so
    these must be orderable). An empty table gives no rows; all columns are handed on, whatever their names.
    """
    source = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    signed, nodes, large, sets, linked = _candidates(source, size, threshold, tolerance)
    label = _join_labels(linked) if large.isEmpty() else _large_classes(large, nodes, sets, linked, threshold, tolerance)
    labelled = nodes.select("node", "copy_id").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = labelled.groupBy("component").agg(F.min("copy_id").alias("class_id"))
    # One row for each node, so that the rows of a large group of copies can be split where they meet it.
    known = cut(labelled.join(classes, "component").select("node", "class_id"))
    rows = signed.select("doc_id", "node").join(known, "node")
    id_, gone, again = fresh(docs, "id", "gone", "again")
    told = rows.groupBy(F.col("doc_id").alias(id_)).agg(F.bool_and(F.col("doc_id") != F.col("class_id")).alias(gone), (F.count("*") > 1).alias(again))
    told = cut(told.where(F.col(gone) | F.col(again)))
    joined = docs.join(told.hint("merge"), F.col("doc_id") == F.col(id_), "left")
    once = joined.where(F.col(id_).isNull()).select(*(F.col(f"`{x}`") for x in docs.columns))
    repeated = docs.join(told.where(~F.col(gone)).hint("merge"), F.col("doc_id") == F.col(id_), "left_semi")
    row = F.struct(*(F.col(f"`{x}`").alias(f"c{i}") for i, x in enumerate(docs.columns)))
    least = repeated.groupBy(F.col("doc_id").alias("a"), F.col("text").alias("b")).agg(F.min(row).alias("r"))
    return once.unionByName(least.select(*(F.col(f"r.c{i}").alias(x) for i, x in enumerate(docs.columns))))


ORACLE = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM documents
), t AS (
  SELECT doc_id, w, array_to_string(w, ' ') AS joined FROM w WHERE len(w) > 0
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < {WORDS} THEN [joined] ELSE list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) END)) AS g FROM t
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE c >= {THRESHOLD} * (x.n + y.n - c) - 1e-9
), r AS (
  SELECT doc_id AS root, doc_id AS node FROM w UNION SELECT r.root, l.b FROM r JOIN l ON r.node = l.a
), k AS (
  SELECT joined, min(doc_id) AS copy_id, count(*) AS n FROM t GROUP BY joined
)
SELECT w.doc_id, coalesce(k.copy_id, w.doc_id) AS copy_id, (SELECT min(node) FROM r WHERE root = w.doc_id) AS class_id,
  coalesce(k.n, 1) AS n_copies, (SELECT count(*) FROM l WHERE a = w.doc_id) AS n_links
FROM w LEFT JOIN t ON w.doc_id = t.doc_id LEFT JOIN k ON t.joined = k.joined
"""
