"""Operator 1: near-duplicates by SimHash, found with BK-trees.

Every text gets a 128-bit SimHash over its pairs of neighbouring words; in scripts without spaces, such as Chinese, Japanese
and Thai, each character counts as a word. Texts whose fingerprints lie within
``RADIUS`` bits are near-duplicates, and groups are the connected components of that relation.

Search is by shards: a fingerprint belongs to the shards named by ``KEYS`` shingles (runs of ``SHINGLE`` words) of its
texts, one for each of ``KEYS`` hash functions. A shingle is drawn in proportion to how often it occurs in the text, as
the SimHash weighs by that too, and alike in texts that have it in like proportion (P-MinHash). A shard's fingerprints form
BK-trees whose children are keyed by their Hamming distance to the parent; each member walks the trees of its
shards and follows only the edges within the radius. A shard of more than ``LIMIT`` fingerprints is cut into that many trees
of at most about ``LIMIT``, so that none is one task's work: members meet those of their own part in a shuffle, and the trees of all other parts
as broadcasts of a bounded size, one after the other. Shards of one are dropped before fingerprints move, and equal fingerprints are collapsed before that.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import numbered, pick, place, settle
from .textscan import blocks, fold, mix, per_row, raw, span_hashes, words

#: Greatest Hamming distance, of 128 bits, at which two fingerprints count as near-duplicates.
RADIUS = 28
#: Shards of each fingerprint, and words in the shingles that name them.
KEYS, SHINGLE = 12, 3
#: Fingerprints in a tree, about, and bytes of trees or of lists of ids that are broadcast at once.
LIMIT, BROADCAST = 4096, 64 << 20
#: Fingerprints that one task links, about: they are small, but each is compared with many.
TASK = 1 << 15


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row 16 fingerprint bytes and the KEYS shard keys.

    A text without words is fingerprinted by its bytes, so that only equal ones meet. A text of fewer words than
    a shingle has is one shingle.
    """
    folded = fold(data)
    starts, ends, first = words(folded, offsets, apart=True)
    rows = len(offsets) - 1
    bare = first[1:] == first[:-1]
    if bare.any():
        starts, ends = np.concatenate((starts, offsets[:-1][bare])), np.concatenate((ends, offsets[1:][bare]))
        order = np.lexsort((ends, np.concatenate((np.repeat(np.arange(rows), np.diff(first)), np.flatnonzero(bare)))))
        starts, ends = starts[order], ends[order]
        first = np.concatenate(([0], np.cumsum(np.diff(first) + bare)))
    word = span_hashes(folded, starts, ends)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(word))  # words from here to the row's end
    pair = word.copy()
    pair[:-1] = np.where(left[:-1] > 1, word[:-1] * np.uint64(3) + word[1:] * np.uint64(5), word[:-1])
    # the last word of a row pairs with nothing; it counts alone only where it is the row's only word
    used = (left > 1) | np.repeat(np.diff(first) == 1, np.diff(first))
    pair = pair[used]
    pairs_first = np.concatenate(([0], np.cumsum(np.maximum(np.diff(first) - 1, 1))))
    bits = np.empty((len(pair), 2), np.uint64)
    bits[:, 0], bits[:, 1] = mix(pair, 1), mix(pair, 2)
    prints = np.packbits(2 * ones_per_row(bits, pairs_first) > np.diff(pairs_first)[:, None], axis=1)
    run = word.copy()
    for k in range(1, SHINGLE):
        run[:-k] = np.where(left[:-k] > k, run[:-k] * np.uint64(0x100000001B3) + word[k:], run[:-k])
    whole = (left >= SHINGLE) | (np.repeat(np.diff(first), np.diff(first)) < SHINGLE) & (np.arange(len(word)) == np.repeat(first[:-1], np.diff(first)))
    run = run[whole]
    runs_first = np.concatenate(([0], np.cumsum(np.maximum(np.diff(first) - SHINGLE + 1, 1))))
    return prints, drawn(run, runs_first)


def drawn(run: np.ndarray, first: np.ndarray) -> np.ndarray:
    """KEYS shingles of each row's run, which is never empty: that of the least exponential variate, of a rate that is its count."""
    rows, mask = len(first) - 1, np.uint64((1 << 44) - 1)
    row, short = np.repeat(np.arange(rows, dtype=np.uint64), np.diff(first)), run >> np.uint64(20)
    if rows <= 1 << 20:
        both = np.sort(row << np.uint64(44) | short)
        row, short = both >> np.uint64(44), both & mask
    else:
        order = np.lexsort((short, row))
        row, short = row[order], short[order]
    new = np.ones(len(short), bool)
    new[1:] = (short[1:] != short[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    count, short, row = np.diff(np.concatenate((at, [len(row)]))), short[at], row[at].astype(np.int64)
    begin = np.searchsorted(row, np.arange(rows))
    keys = np.empty((rows, KEYS), np.uint64)
    for k in range(KEYS):
        code = mix(short, 10 + k)
        wait = -np.log1p(-((code >> np.uint64(11)).astype(float) / (1 << 53))) / count
        least = np.flatnonzero(wait == np.minimum.reduceat(wait, begin)[row])
        keys[row[least[::-1]], k] = code[least[::-1]]  # of equal ones the first
    return keys


def ones_per_row(bits: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How often each of the 128 bits is set within each row's run, which is never empty.

    A 64-bit word holds eight one-byte counters, so runs are summed in stretches of at most 255.
    """
    lengths = np.diff(first)
    stretches = -(-lengths // 255)
    begin = np.concatenate(([0], np.cumsum(stretches)))
    cuts = np.repeat(first[:-1], stretches) + 255 * (np.arange(begin[-1]) - np.repeat(begin[:-1], stretches))
    counts = np.empty((len(cuts), 2, 8, 8), np.uint8)
    for half in (0, 1):
        column = np.ascontiguousarray(bits[:, half])
        for b in range(8):
            lanes = (column >> np.uint64(b)) & np.uint64(0x0101010101010101)
            counts[:, half, :, b] = np.add.reduceat(lanes, cuts).view(np.uint8).reshape(-1, 8)
    flat = counts.reshape(len(cuts), 128)
    return np.add.reduceat(flat, begin[:-1], axis=0, dtype=np.int64)


def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, digest, text) to (doc_id, digest, print, keys)."""
    for batch in batches:
        for a, b, offsets, data in blocks(batch.column(2)):
            prints, keys = fingerprints(data, offsets)
            flat = pa.array(keys.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, KEYS, dtype=np.int32)), flat)
            solid = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), b - a, [None, pa.py_buffer(prints.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), solid, lists], ["doc_id", "digest", "print", "keys"])


class BKTree:
    """Fingerprints, rows of two 64-bit words; a node's children are keyed by their distance to it."""

    def __init__(self, prints: np.ndarray) -> None:
        self.prints = prints
        self.children: list[dict[int, int]] = [{} for _ in prints]
        values = [a << 64 | b for a, b in prints.tolist()]
        for i in range(1, len(values)):
            node, value = 0, values[i]
            while True:
                d = (values[node] ^ value).bit_count()
                below = self.children[node].get(d)
                if below is None:
                    self.children[node][d] = i
                    break
                node = below

    def near(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) for all within the radius. All queries walk side by side; a child at edge e is visited by those with |e - d| <= radius."""
        asked, met = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        stack = [(0, np.arange(len(queries)))] if len(self.prints) and len(queries) else []
        while stack:
            node, own = stack.pop()
            apart = np.bitwise_count(queries[own] ^ self.prints[node])
            d = apart[:, 0].astype(np.int16) + apart[:, 1]
            hit = own[d <= radius]
            asked.append(hit)
            met.append(np.full(len(hit), node))
            for edge, below in self.children[node].items():
                on = own[np.abs(d - edge) <= radius]
                if len(on):
                    stack.append((below, on))
        return np.concatenate(asked), np.concatenate(met)


def roots_of(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of the component of each of ``count`` nodes."""
    root = np.arange(count)
    while True:
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
        if (root == before).all():
            return root


class Shard:
    """The tree of a shard, or of a part of one, and the components within it."""

    def __init__(self, prints: np.ndarray, radius: int) -> None:
        self.prints, self.radius = np.unique(prints, axis=0), radius
        self.tree = BKTree(self.prints)
        self.root = roots_of(len(self.prints), *self.tree.near(self.prints, radius))

    def inner(self) -> tuple[np.ndarray, np.ndarray]:
        """An edge from each fingerprint to the least of its component."""
        some = np.flatnonzero(self.root != np.arange(len(self.root)))
        return self.prints[some], self.prints[self.root[some]]

    def outer(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An edge from each query to each component of the tree that it is near to."""
        q, node = self.tree.near(queries, self.radius)
        pairs = np.unique(np.stack((q, self.root[node]), axis=1), axis=0)
        return queries[pairs[:, 0]], self.prints[pairs[:, 1]]


def words_of(column: pa.Array) -> np.ndarray:
    """Fingerprints of 16 bytes as rows of two words, in the byte order that makes words compare as bytes do."""
    off, data = raw(column)
    return np.ascontiguousarray(data[off[0] : off[-1]]).view(">u8").astype(np.uint64).reshape(-1, 2)


def edge_batch(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    sides = [np.concatenate([np.zeros((0, 2), np.uint64), *(p[k] for p in pairs)]).astype(">u8") for k in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary()) for x in sides], ["a", "b"])


def linked(radius: int):
    """Rows (key, part, print), sorted by key and part within a partition, to edges (a, b); a shard may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held = np.zeros((0, 2), np.int64), np.zeros((0, 2), np.uint64)

        def edges(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            cuts = np.concatenate(([0], np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1, [len(keys)]))
            return edge_batch([Shard(prints[cuts[i] : cuts[i + 1]], radius).inner() for i in np.flatnonzero(np.diff(cuts) > 1)])

        for batch in batches:
            if not batch.num_rows:
                continue
            held_keys = np.concatenate((held_keys, np.stack([batch.column(i).to_numpy().astype(np.int64) for i in (0, 1)], axis=1)))
            held = np.concatenate((held, words_of(batch.column(2))))
            split = len(held_keys) - int(np.argmax((held_keys[::-1] != held_keys[-1]).any(axis=1)))
            if split < len(held_keys):
                yield edges(held_keys[:split], held[:split])
                held_keys, held = held_keys[split:], held[split:]
        yield edges(held_keys, held)

    return run


def crossed(shared, radius: int):
    """Rows (key, part, print) of shards in several parts to edges (a, b) with the broadcast trees of later parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[tuple[int, int], Shard] = {}
        for batch in batches:
            key, part = (batch.column(i).to_numpy() for i in (0, 1))
            prints, found = words_of(batch.column(2)), []
            for k in np.unique(key).tolist():
                own = np.flatnonzero(key == k)
                for p, members in shared.value.get(k, {}).items():
                    before = own[part[own] < p]
                    if len(before):
                        if (k, p) not in trees:
                            trees[k, p] = Shard(members, radius)
                        found.append(trees[k, p].outer(prints[before]))
            yield edge_batch(found)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): the least node of its connected component.

    Alternates large-star and small-star steps, whose number grows with the logarithm of the size of the
    largest component, until no edge changes. Each step is checkpointed.
    """
    pairs = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        pairs = settle(small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_if(F.col("a") <= F.col("b"))).first()
        if now == seen:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now


def signatures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, digest, print, keys) of every row whose text isn't null, computed once and kept."""
    rows = pick(docs, doc_id=id_column, text=text_column).where("text is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("digest"), "text")
    return settle(rows.mapInArrow(signed, "doc_id long, digest long, print binary, keys array<long>"))


def groups(signs: DataFrame, radius: int = RADIUS, limit: int = LIMIT, most: int = BROADCAST) -> DataFrame:
    """(print, root) for every fingerprint that has near-duplicates with other fingerprints.

    No key is one task's work: counts of keys are summed before they move, shards of one go, and those of more than ``limit``
    are cut into parts of about ``limit``.
    """
    spark = signs.sparkSession
    members = signs.select("print", "keys").distinct().select(F.explode("keys").alias("key"), "print")
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    part = F.pmod(F.xxhash64("print"), F.ceil(F.col("n") / limit)).cast("int")
    dealt = settle(members.join(sizes, "key").select("key", F.when(F.col("n") > limit, part).otherwise(0).alias("part"), "print", (F.col("n") > limit).alias("hot")))
    tasks = -(-dealt.count() // TASK) or 1
    edges = dealt.select("key", "part", "print").repartition(tasks, "key", "part").sortWithinPartitions("key", "part").mapInArrow(linked(radius), "a binary, b binary")
    hot = settle(dealt.where("hot").select("key", "part", "print").distinct())
    count = hot.count()
    rounds = -(-count * 28 // most)
    if rounds:
        hot = settle(hot.repartitionByRange(-(-count // limit), "key", "part"))  # so that a task needs few trees
    for r in range(rounds):
        table = hot.where(F.pmod(F.xxhash64("key", "part"), F.lit(rounds)) == r).toArrow()
        order = np.lexsort((table["part"].to_numpy(), table["key"].to_numpy()))
        key, at, prints = table["key"].to_numpy()[order], table["part"].to_numpy()[order], words_of(table["print"].combine_chunks())[order]
        trees: dict[int, dict[int, np.ndarray]] = {}
        cuts = [0, *(np.flatnonzero((np.diff(key) != 0) | (np.diff(at) != 0)) + 1).tolist(), len(key)]
        for x, y in zip(cuts, cuts[1:]):
            if y > x:
                trees.setdefault(int(key[x]), {})[int(at[x])] = prints[x:y]
        shared = spark.sparkContext.broadcast(trees)
        edges = edges.unionByName(settle(hot.mapInArrow(crossed(shared, radius), "a binary, b binary").distinct()))
        shared.unpersist()
    return components(edges).select(F.col("node").alias("print"), "root")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, kept_id, group_size): every document that has a near-duplicate with a lower doc_id, beside the
    lowest doc_id of its group.

    Texts that are null are duplicates of nothing. Empty texts, and texts without words, match equal texts only; texts of any length count whole. Documents whose
    doc_id is null don't show, and never are the kept one unless nothing else is. Repeated rows with one doc_id
    count as one document. Ties don't arise: the lowest doc_id of a group stays. Other columns may have any names and don't matter. An empty table
    gives no rows. Two texts are linked if they share a shard and their fingerprints lie within the radius; hardly any pair within the radius shares none.
    """
    signs = signatures(docs, id_column, text_column)
    roots = groups(signs, radius)
    placed = signs.select("doc_id", "print").distinct().join(roots, "print", "left").select("doc_id", F.coalesce("root", "print").alias("root"))
    placed = placed.where("doc_id is not null").distinct()
    kept = placed.groupBy("root").agg(F.min("doc_id").alias("kept_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    return placed.join(kept, "root").where("doc_id <> kept_id").select("doc_id", "kept_id", "group_size")


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS, most: int = BROADCAST) -> DataFrame:
    """The documents, less all but one of each group of near-duplicates; columns stay as they are, whatever they are called.

    Of a group the row with the lowest doc_id stays (null counts as the highest; among rows that share it, the one
    with the lowest text hash, and of rows equal in doc_id and text the one whose columns come first as JSON). Rows with null text all stay. Empty
    texts are equal to one another, and texts of any length count whole. An empty table stays empty. Texts don't move: rows are marked by a list of the dropped, which
    is broadcast if it has no more than ``most`` bytes.
    """
    names, inner = docs.columns, numbered(docs)
    at_id, at_text = (f"c{place(names, x)}" for x in (id_column, text_column))
    signs = signatures(docs, id_column, text_column)
    roots = groups(signs, radius)
    mark = [F.coalesce("doc_id", F.lit(-(2**63))).alias("__d"), F.col("doc_id").isNull().alias("__n"), F.col("digest").alias("__g")]
    rows = signs.join(roots, "print", "left").select(F.coalesce("root", "print").alias("root"), *mark).groupBy("root", "__d", "__n", "__g").agg(F.count(F.lit(1)).alias("times"))
    best = rows.groupBy("root").agg(F.min(F.struct("__n", "__d", "__g")).alias("best"))
    same = F.struct("__n", "__d", "__g") == F.col("best")
    # rows that go, and those of which one of several equal ones stays
    marked = settle(rows.join(best, "root").where(~same | (F.col("times") > 1)).select("__d", "__n", "__g", same.alias("again")).groupBy("__d", "__n", "__g").agg(F.max("again").alias("again")))
    count, again = marked.agg(F.count(F.lit(1)), F.count_if("again")).first()
    if count * 64 <= most:  # as much as a row of a broadcast table takes
        marked = F.broadcast(marked)
    key = [F.coalesce(F.col(at_id).cast("long"), F.lit(-(2**63))).alias("__d"), F.col(at_id).isNull().alias("__n"), F.xxhash64(at_text).alias("__g")]
    found = inner.select("*", *key, F.col(at_text).isNotNull().alias("__t")).join(marked.withColumn("__t", F.lit(True)), ["__d", "__n", "__g", "__t"], "left")
    left = found.where("again is null").select(*inner.columns)
    if again:
        first = Window.partitionBy("__d", "__n", "__g").orderBy(F.to_json(F.struct(*inner.columns)))
        left = left.unionByName(found.where("again").withColumn("__nth", F.row_number().over(first)).where("__nth = 1").select(*inner.columns))
    return left.toDF(*names)
