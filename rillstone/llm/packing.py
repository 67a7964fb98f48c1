"""Operator 5: best-fit packing of documents into sequences of a fixed length by exact-complement hashing.

Documents are cut into pieces of at most ``CAPACITY`` tokens. Only the histogram of piece lengths decides the plan:
it has at most CAPACITY entries however large the corpus is, so the plan is made on the driver, in bulk, with
availability counts. Longest lengths first, the gap that a piece leaves is looked up among the sums of single
lengths, pairs and triples, and combinations that fill it exactly are consumed as often as the counts allow. What
is left is packed best-fit. The plan is applied in parallel: a piece's rank among those of its length decides its place.
"""

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import pick, settle

#: Tokens in a packed sequence, end marks included.
CAPACITY = 2048
#: Pieces that one task ranks, about: a length that more pieces have is divided into as many parts as it takes.
RANKED = 1 << 18


def _single(count: np.ndarray, gap: int) -> tuple[int, ...] | None:
    return (gap,) if count[gap] > 0 else None


def _pair(count: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """The pair of available lengths that sums to the gap and holds the longest piece."""
    low = np.arange(1, gap // 2 + 1)
    fits = (count[low] > 0) & (count[gap - low] > 0)
    if gap % 2 == 0 and len(low):
        fits[-1] = count[gap // 2] > 1
    at = int(np.argmax(fits)) if len(low) else 0
    return (gap - int(low[at]), int(low[at])) if len(low) and fits[at] else None


def _triple(count: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """The triple that sums to the gap, with the longest first and then second member."""
    for a in np.flatnonzero(count[: max(0, gap - 1)])[::-1]:
        if 3 * a < gap:
            return None
        count[a] -= 1
        rest = gap - int(a)
        low = np.arange(max(1, rest - int(a)), rest // 2 + 1)
        found = None
        if len(low):
            fits = (count[low] > 0) & (count[rest - low] > 0)
            if rest % 2 == 0:
                fits[-1] = count[rest // 2] > 1
            at = int(np.argmax(fits))
            found = (int(a), rest - int(low[at]), int(low[at])) if fits[at] else None
        count[a] += 1
        if found:
            return found
    return None


def _times(count: np.ndarray, pattern: tuple[int, ...]) -> int:
    return min(int(count[x]) // pattern.count(x) for x in set(pattern))


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with the number of bins that each one fills, in the order in which bins are numbered.

    Deterministic: it depends on nothing but the histogram. Every piece is placed exactly once.
    """
    count = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        count[length] = n
    made: list[tuple[tuple[int, ...], int]] = []
    if count[capacity]:
        made.append(((capacity,), int(count[capacity])))
        count[capacity] = 0
    left_over: list[tuple[int, int]] = []
    for anchor in range(capacity - 1, 0, -1):
        while count[anchor]:
            count[anchor] -= 1
            gap = capacity - anchor
            filler = _single(count, gap) or _pair(count, gap) or _triple(count, gap)
            count[anchor] += 1
            if filler is None:
                left_over.append((anchor, int(count[anchor])))
                count[anchor] = 0
                break
            pattern = (anchor, *filler)
            n = _times(count, pattern)
            for x in pattern:
                count[x] -= n
            made.append((pattern, n))
    open_bins: dict[int, list[list]] = defaultdict(list)  # gap: groups of [pattern, number of bins]
    for length, n in left_over:
        while n:
            gap = min((g for g in open_bins if g >= length), default=None)
            if gap is None:
                each = capacity // length
                if n >= each:
                    open_bins[capacity - each * length].append([(length,) * each, n // each])
                    n %= each
                if n:
                    open_bins[capacity - n * length].append([(length,) * n, 1])
                break
            group = open_bins[gap][0]
            each = min(n, gap // length)  # the bin that a piece went to is the best for the next one, while it has room
            k = min(n // each, group[1])
            open_bins[gap - each * length].append([(*group[0], *(length,) * each), k])
            group[1] -= k
            n -= k * each
            if not group[1]:
                open_bins[gap].pop(0)
                if not open_bins[gap]:
                    del open_bins[gap]
    for gap in sorted(open_bins):
        made += [(tuple(p), n) for p, n in open_bins[gap]]
    return made


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length, runs of ranks that go to the same slot of successive bins: sorted by length, then first rank."""
    rows, used, base = [], defaultdict(int), 0
    for pattern, n in patterns:
        at = 0
        for x in pattern:
            rows.append((x, used[x], base, at))
            used[x] += n
            at += x
        base += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "bin": table[:, 2], "at": table[:, 3]}


def placed(table: dict[str, np.ndarray], before: dict[int, np.ndarray], names: list[str]):
    """Rows (doc_id, piece, length, salt, rank in salt, others) to their bins; ``before`` has the pieces in lower salts of each length."""
    begin = np.searchsorted(table["length"], np.arange(int(table["length"].max(initial=0)) + 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, salt, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3, 4))
            slot = np.empty(len(rank), np.int64)
            for x in np.unique(length).tolist():
                own, rows = slice(begin[x], begin[x + 1]), length == x
                rank[rows] += before[x][salt[rows]]
                slot[rows] = begin[x] + np.searchsorted(table["rank"][own], rank[rows], "right") - 1
            found = [pa.array(table["bin"][slot] + rank - table["rank"][slot]), pa.array(table["at"][slot])]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *found, *(batch.column(i) for i in range(5, batch.num_columns))], names)

    return run


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, ranked: int = RANKED) -> DataFrame:
    """(doc_id, piece, length, bin_id, start, others) for pieces (doc_id, piece, length, others) with 0 < length <= capacity."""
    others = pieces.columns[3:]
    pieces = settle(pieces.withColumn("length", F.col("length").cast("int")))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    parts = [-(-histogram.get(x, 0) // ranked) or 1 for x in range(capacity + 1)]
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.element_at(F.lit(parts), F.col("length") + 1)).cast("int"))
    before = {x: np.zeros(parts[x] + 1, np.int64) for x in histogram}
    for length, salt, n in salted.groupBy("length", "salt").agg(F.count(F.lit(1))).toLocalIterator():
        before[length][salt + 1] = n
    before = {x: np.cumsum(n) for x, n in before.items()}
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy(F.col("doc_id").asc_nulls_last(), "piece")) - 1
    rows = salted.select("doc_id", "piece", "length", "salt", rank.alias("rank"), *others)
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name in others]
    names = ["doc_id", "piece", "length", "bin_id", "start", *others]
    return rows.mapInArrow(placed(slots(plan(histogram, capacity)), before, names), ", ".join(["doc_id long, piece int, length int, bin_id long, start long", *kinds]))


def lengths_of(docs: DataFrame, id_column: str, text_column: str, length_column: str | None = None) -> DataFrame:
    """(doc_id, tokens): the length, else the runs of characters other than white space, and one end mark."""
    if length_column:
        rows = pick(docs, doc_id=id_column, n=length_column).where("n is not null")
        return rows.select(F.col("doc_id").cast("long"), (F.greatest(F.col("n"), F.lit(0)) + 1).alias("tokens"))
    rows = pick(docs, doc_id=id_column, text=text_column).where("text is not null")
    return rows.select(F.col("doc_id").cast("long"), (F.regexp_count("text", F.lit(r"\S+")) + 1).alias("tokens"))


def pack(docs: DataFrame, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text", length_column: str | None = None, ranked: int = RANKED) -> DataFrame:
    """(doc_id, piece, length, bin_id, start): where each piece of each document lies.

    A document's tokens are counted by ``length_column``, such as the encoder's ``n_tokens``; if none is given, its words are its tokens. Null texts, or
    lengths, are left out; an empty text is a piece of one token, its end mark; so is one of negative length. Texts longer than the capacity are
    cut into full pieces and a rest, numbered from 0. Repeated rows are packed as often as they occur; rows equal in
    doc_id and piece may exchange places. Bins are numbered from 0; which of the equally long pieces goes to which bin
    follows a hash of (doc_id, piece), then doc_id, null last. Other columns may have any names. An empty table gives no rows.
    """
    tokens = lengths_of(docs, id_column, text_column, length_column)
    count = F.ceil(F.col("tokens") / capacity).cast("int")
    pieces = tokens.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"))
    return pack_pieces(pieces.select("doc_id", "piece", F.least(F.col("tokens") - F.col("piece") * capacity, F.lit(capacity)).alias("length")), capacity, ranked)


def sequences(rows: DataFrame, end: int, capacity: int = CAPACITY, id_column: str = "doc_id", tokens_column: str = "tokens", ranked: int = RANKED) -> DataFrame:
    """(bin_id, tokens, doc_ids, starts): the packed sequences of token lists, the mark ``end`` after each document, and where its pieces begin.

    Null lists are left out, an empty list is its end mark. Otherwise as ``pack``; a sequence has at most ``capacity`` tokens, so no bin is large.
    """
    own = pick(rows, doc_id=id_column, tokens=tokens_column).where("tokens is not null")
    whole = own.select(F.col("doc_id").cast("long"), F.concat(F.col("tokens").cast("array<int>"), F.array(F.lit(end))).alias("tokens"))
    cut = whole.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), F.ceil(F.size("tokens") / capacity).cast("int") - 1)).alias("piece"))
    part = F.slice("tokens", F.col("piece") * capacity + 1, capacity)
    pieces = cut.select("doc_id", "piece", part.alias("tokens")).select("doc_id", "piece", F.size("tokens").alias("length"), "tokens")
    bins = pack_pieces(pieces, capacity, ranked).groupBy("bin_id").agg(F.array_sort(F.collect_list(F.struct("start", "doc_id", "tokens"))).alias("parts"))
    return bins.select("bin_id", F.flatten("parts.tokens").alias("tokens"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.start").alias("starts"))
