"""Operator 3: language-model scores by a weighted backoff automaton.

The model is an interpolated Witten-Bell n-gram model over bytes, counted over the whole corpus. Its contexts are
the states of an automaton, with an arc for each n-gram and a failure arc with the backoff weight to the next shorter
context. The automaton grows with the corpus, so it is never in one place: its arcs are rows, and failure arcs are followed
once for each different arc, in joins from the shortest contexts to the longest. Texts are dealt to blocks of a bounded
size, and each block is handed just the arcs that its texts take. Texts are then walked from left to right, many side by
side: each carries its state and adds up the weights of the arcs that it takes. A state is known by the last ORDER - 1
symbols, so long texts are walked in several stretches at once.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import pick, settle
from .textscan import blocks, raw

#: Bytes in the longest n-gram.
ORDER = 5
#: Bytes of text in a block; a longer text is the end of its block. Symbols in a stretch.
BLOCK, STRETCH = 32 << 20, 512
#: Tasks that score blocks, at most; more blocks than that follow one another.
TASKS = 1 << 16
START, END = 0, 1  # symbols that stand for the borders of a text; a byte b is the symbol b + 2
SYMBOLS = 258
BITS = 9


def symbols(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts as symbols with order - 1 start marks before and an end mark after each, and their new offsets."""
    size = np.diff(offsets)
    begin = np.concatenate(([0], np.cumsum(size + order)))
    out = np.zeros(begin[-1], np.uint16)
    out[np.arange(len(data)) + np.repeat(begin[:-1] + order - 1 - offsets[:-1], size)] = data.astype(np.uint16) + np.uint16(2)
    out[begin[1:] - 1] = END
    return out, begin


def codes(s: np.ndarray, begin: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each symbol from the first ``order`` on, and whether it ends in a text and not in start marks."""
    wide = s.astype(np.uint64)
    code = wide[order - 1 :].copy()
    for k in range(1, order):
        code |= wide[order - 1 - k : len(wide) - k] << np.uint64(BITS * k)
    valid = np.ones(len(code), bool)
    for k in range(order - 1):
        at = begin[1:-1] + k - (order - 1)
        valid[at[at >= 0]] = False
    return code, valid


def dealt(size: int):
    """Rows (doc_id, text) to (block, doc_id, text); a partition's blocks follow one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, done = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            off, _ = raw(batch.column(1))
            block = base + (done + off[:-1] - off[0]) // size
            done += int(off[-1] - off[0])
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), batch.column(0), batch.column(1)], ["block", "doc_id", "text"])

    return run


def runs(*columns: pa.Array) -> list[tuple[int, int]]:
    """First row and row after the last of each run of equal values."""
    n = len(columns[0])
    changes = np.zeros(max(n - 1, 0), bool)
    for c in columns:
        changes |= np.diff(c.to_numpy(zero_copy_only=False)) != 0
    cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), n]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def counted(order: int):
    """Rows (block, text) to counts (block, gram, n) of the longest n-grams, summed within the block as memory allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, keys, counts = 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def emitted():
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block, np.int64)), pa.array(keys.view(np.int64)), pa.array(counts)], ["block", "gram", "n"])

        for batch in batches:
            for a, b in runs(batch.column(0)):
                if (now := batch.column(0)[a].as_py()) != block or len(keys) > 1 << 21:
                    yield emitted()
                    block, keys, counts = now, keys[:0], counts[:0]
                for _, _, offsets, data in blocks(batch.column(1).slice(a, b - a), 4 << 20):
                    code, valid = codes(*symbols(data, offsets, order), order)
                    new, n = np.unique(code[valid], return_counts=True)
                    both = np.concatenate((keys, new))
                    keys, at = np.unique(both, return_inverse=True)
                    counts = np.bincount(at, np.concatenate((counts, n)), len(keys)).astype(np.int64)
                    if len(keys) > 1 << 21:
                        yield emitted()
                        keys, counts = keys[:0], counts[:0]
        yield emitted()

    return run


class Arcs:
    """The arcs that a block takes and their weights, in an open-addressing table."""

    def __init__(self, order: int, grams: np.ndarray, weights: np.ndarray) -> None:
        self.order = order
        grams, first = np.unique(grams, return_index=True)
        weights = weights[first]
        self.bits = max(4, int(np.ceil(np.log2(2 * len(grams) + 1))))
        size = 1 << self.bits
        self.keys, self.weights = np.full(size, 2**64 - 1, np.uint64), np.zeros(size)
        left, slot = np.arange(len(grams)), self.slot(grams)
        while len(left):
            free = self.keys[slot] == np.uint64(2**64 - 1)
            taken, first = np.unique(slot[free], return_index=True)
            winner = np.flatnonzero(free)[first]
            self.keys[taken], self.weights[taken] = grams[left[winner]], weights[left[winner]]
            rest = np.ones(len(left), bool)
            rest[winner] = False
            left, slot = left[rest], (slot[rest] + 1) & (size - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, grams: np.ndarray) -> np.ndarray:
        """Weight of each arc; every one must be there."""
        slot = self.slot(grams)
        out = self.weights[slot]
        left = np.flatnonzero(self.keys[slot] != grams)
        slot = slot[left]
        while len(left):
            if (self.keys[slot] == np.uint64(2**64 - 1)).any():
                raise KeyError("an n-gram of a text wasn't counted")
            slot = (slot + 1) & ((1 << self.bits) - 1)
            out[left] = self.weights[slot]
            go = self.keys[slot] != grams[left]
            left, slot = left[go], slot[go]
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Natural log-probability of each text, its end included."""
        s, begin = symbols(data, offsets, self.order)
        first, size = begin[:-1] + self.order - 1, np.diff(begin) - (self.order - 1)
        many = -(-size // STRETCH)
        text = np.repeat(np.arange(len(size)), many)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        start, length = first[text] + nth * STRETCH, np.minimum(STRETCH, size[text] - nth * STRETCH)
        order = np.argsort(-length, kind="stable")  # the longest first, so that those still walking are at the front
        start, walking = start[order], np.searchsorted(-length[order], -np.arange(1, STRETCH + 1), "right")
        state, total = np.zeros(len(start), np.uint64), np.zeros(len(start))
        for k in range(self.order - 1, 0, -1):
            state = state << np.uint64(BITS) | s[start - k].astype(np.uint64)
        known = np.uint64((1 << BITS * (self.order - 1)) - 1)
        for t, n in enumerate(walking[walking > 0].tolist()):
            arc = state[:n] << np.uint64(BITS) | s[start[:n] + t].astype(np.uint64)
            total[:n] += self.look(arc)
            state[:n] = arc & known
        by_text = np.empty(len(start))
        by_text[order] = total
        return np.add.reduceat(by_text, np.cumsum(many) - many)


def arc_weights(counts: DataFrame, order: int) -> DataFrame:
    """(gram, weight): log-probability of the last symbol of every longest n-gram after the ones before it.

    Counts (gram, n) are exact and summed in Spark; shorter n-grams and contexts are counted from the longest. Nothing
    but the counts of single symbols reaches the driver.
    """
    longest = settle(counts.groupBy("gram").agg(F.sum("n").alias("n")))
    cut = lambda k: F.col("gram").bitwiseAND(F.lit((1 << (BITS * k)) - 1))
    sizes = F.array(*(F.struct(F.lit(k).alias("k"), cut(k).alias("gram")) for k in range(1, order + 1)))
    grams = settle(longest.select("n", F.explode(sizes).alias("x")).groupBy("x.k", "x.gram").agg(F.sum("n").alias("n")))
    single = {r["gram"]: r["n"] for r in grams.where("k = 1").collect()}
    whole = sum(single.values()) + SYMBOLS - 1
    prob = counts.sparkSession.createDataFrame([(g, (n + 1) / whole) for g, n in single.items()], "gram long, p double")
    same = Window.partitionBy("h")
    for k in range(2, order + 1):
        level = grams.where(F.col("k") == k).select("gram", "n", cut(k - 1).alias("low")).join(prob.select(F.col("gram").alias("low"), F.col("p").alias("lower")), "low")
        level = level.select("gram", "n", "lower", F.shiftright("gram", BITS).alias("h"))
        level = level.withColumns({"total": F.sum("n").over(same), "kinds": F.count(F.lit(1)).over(same)})
        level = level.withColumn("p", (F.col("n") + F.col("kinds") * F.col("lower")) / (F.col("total") + F.col("kinds")))
        prob = level.select("gram", "p")
    return prob.select("gram", F.log("p").alias("weight"))


def scored(order: int):
    """Rows (block, kind, gram, weight, doc_id, text), sorted, a block's arcs (kind 0) before its texts (kind 1), to (doc_id, n_bytes, log_prob, bits_per_byte)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, arcs = None, [], None
        for batch in batches:
            for a, b in runs(batch.column(0), batch.column(1)):
                part = batch.slice(a, b - a)
                if (now := part.column(0)[0].as_py()) != block:
                    block, held, arcs = now, [], None
                if part.column(1)[0].as_py() == 0:
                    held.append((part.column(2).to_numpy().view(np.uint64), part.column(3).to_numpy()))
                    continue
                if arcs is None:
                    grams, weights = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.uint64), np.zeros(0))
                    arcs, held = Arcs(order, grams, weights), []
                texts = part.column(5)
                for i, j, offsets, data in blocks(texts, 4 << 20):
                    null = np.array(texts.slice(i, j - i).is_null())
                    total, size = np.zeros(j - i), np.diff(offsets)
                    if not null.all():
                        first = np.concatenate(([0], np.cumsum(size[~null])))  # a null text has no bytes, so the others' stay together
                        total[~null] = arcs.score(data, first)
                    out = [pa.array(total, mask=null), pa.array(-total / np.log(2) / (size + 1), mask=null)]
                    yield pa.RecordBatch.from_arrays([part.column(4).slice(i, j - i), pa.array(size), *out], ["doc_id", "n_bytes", "log_prob", "bits_per_byte"])

    return run


def lm_scores(docs: DataFrame, order: int = ORDER, id_column: str = "doc_id", text_column: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, log_prob, bits_per_byte) of every row under the model of the whole table.

    A null text has 0 bytes and null scores, and doesn't count for the model; an empty one is scored for its end; texts of any length are
    counted and scored whole. Every n-gram that occurs counts, at every size. Repeated rows count as often as they occur and give repeated results;
    null doc_ids stay null. Other columns may have any names. An empty table gives no rows. Equal texts have equal scores.
    """
    rows = pick(docs, doc_id=id_column, text=text_column).select(F.col("doc_id").cast("long"), "text")
    texts = settle(rows.mapInArrow(dealt(block), "block long, doc_id long, text string"))  # block numbers follow the partitions, so they are kept
    counts = settle(texts.where("text is not null").select("block", "text").mapInArrow(counted(order), "block long, gram long, n long"))
    model = counts.select("block", "gram").join(arc_weights(counts.select("gram", "n"), order), "gram")
    arcs = model.select("block", F.lit(0).alias("kind"), "gram", "weight", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    walks = texts.select("block", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("gram"), F.lit(None).cast("double").alias("weight"), "doc_id", "text")
    tasks = max(1, min(texts.select("block").distinct().count(), TASKS))
    # blocks of a partition are numbered from its number in the upper half, so this deals them one by one
    turn = F.pmod(F.shiftright("block", 32) + F.col("block").bitwiseAND(F.lit((1 << 32) - 1)) * texts.rdd.getNumPartitions(), F.lit(tasks)).cast("int")
    both = arcs.unionByName(walks).repartitionById(tasks, turn).sortWithinPartitions("block", "kind")
    return both.mapInArrow(scored(order), "doc_id long, n_bytes long, log_prob double, bits_per_byte double")
