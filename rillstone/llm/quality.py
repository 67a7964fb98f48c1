"""Operator 10: a quality classifier on document statistics.

Random Fourier features approximate a Gaussian kernel over standardised statistics of each text. Every
partition sums its part of the normal equations, which are added up and solved for ridge weights. Isotonic regression
over the scores of labelled rows that were held out from the weights turns a score into a probability of good quality.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import numbered, pick, place, settle
from .textscan import blocks, fold, per_row, span_hashes, words

#: Random features, their seed, ridge penalty for each labelled row, and the least probability that is kept.
FEATURES, SEED, RIDGE, KEEP = 192, 7, 1e-3, 0.3
#: One of so many labelled rows, by a hash of its statistics, is held out for the calibration.
HELD = 4
#: Bytes of labels that are broadcast, so that only labelled texts are measured; beyond, all are, and statistics meet labels in a shuffle.
BROADCAST = 64 << 20
#: Steps of the score, between -GRID/STEP and GRID/STEP, on which isotonic regression works.
GRID, STEP = 1024, 512
NAMES = ["log_words", "word_length", "word_length_spread", "upper", "digits", "marks", "bars", "brackets", "other_signs", "white", "beyond_ascii", "distinct_words", "repeated_lines", "log_line", "short_words", "controls"]
_KINDS = np.full(256, 5, np.uint8)
_KINDS[[*range(97, 123)]] = 0
_KINDS[[*range(65, 91)]] = 1
_KINDS[[*range(48, 58)]] = 2
_KINDS[[ord(c) for c in "!?"]] = 3
_KINDS[[ord(c) for c in "|"]] = 4
_KINDS[[ord(c) for c in " \t\r\n"]] = 6
_KINDS[128:] = 7
_KINDS[[ord(c) for c in "<>{}[]()"]] = 8
_KINDS[[*range(9), 11, 12, *range(14, 32), 127]] = 9


def _distinct(row: np.ndarray, hashes: np.ndarray, rows: int) -> np.ndarray:
    """Number of different hashes in each row."""
    key = np.sort(row.astype(np.uint64) << np.uint64(44) | hashes >> np.uint64(20))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> np.uint64(44)).astype(np.int64), minlength=rows)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of NAMES for each text; zeros for empty ones."""
    rows, size = len(offsets) - 1, np.diff(offsets)
    kinds = np.bincount(np.repeat(np.arange(rows) * 16, size) + _KINDS[data], minlength=rows * 16).reshape(rows, 16)
    folded = fold(data)
    starts, ends, first = words(folded, offsets)
    n, length = np.diff(first), (ends - starts).astype(float)
    some = np.maximum(n, 1)
    mean = per_row(length, first, np.add, 0.0) / some
    spread = np.sqrt(np.maximum(per_row(length**2, first, np.add, 0.0) / some - mean**2, 0))
    short = per_row((length <= 3).astype(float), first, np.add, 0.0) / some
    distinct = _distinct(np.repeat(np.arange(rows), n), span_hashes(folded, starts, ends), rows) / some
    line_ends = np.flatnonzero(data == 10)
    bounds = np.unique(np.concatenate((offsets, line_ends + 1)))
    line_start, line_end = bounds[:-1], bounds[1:]
    line_row = np.searchsorted(offsets, line_start, "right") - 1
    lines = np.bincount(line_row, minlength=rows)
    different = _distinct(line_row, span_hashes(folded, line_start, line_end), rows)
    whole = np.maximum(size, 1)
    columns = [np.log1p(n), mean, spread, kinds[:, 1], kinds[:, 2], kinds[:, 3], kinds[:, 4], kinds[:, 8], kinds[:, 5], kinds[:, 6], kinds[:, 7], distinct, 1 - different / np.maximum(lines, 1), np.log1p(size / np.maximum(lines, 1)), short, kinds[:, 9]]
    shares = {3, 4, 5, 6, 7, 8, 9, 10, 15}
    out = np.stack([x / whole if i in shares else np.asarray(x, float) for i, x in enumerate(columns)], axis=1)
    out[size == 0] = 0
    return out


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.ravel()))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) to (doc_id, stats)."""
    for batch in batches:
        for a, b, offsets, data in blocks(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _lists(statistics(data, offsets))], ["doc_id", "stats"])


class Model:
    """Standardisation, random features, weights and the calibration by step of the score."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.scale = mean, scale
        self.turn = rng.normal(size=(d, features)) / np.sqrt(d)
        self.shift = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.levels = np.full(2 * GRID + 1, 0.5)

    def expand(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features, and a constant."""
        x = np.clip((stats - self.mean) / self.scale, -8, 8) @ self.turn + self.shift
        return np.concatenate((np.cos(x) * np.sqrt(2 / len(self.shift)), np.ones((len(x), 1))), axis=1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return self.expand(stats) @ self.weights

    def probability(self, stats: np.ndarray) -> np.ndarray:
        return self.levels[steps(self.score(stats))]


def steps(score: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(score * STEP), -GRID, GRID).astype(np.int64) + GRID


def equations(model: Model):
    """Rows (stats, y) to one row (part, sums): this partition's share of the normal equations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, width = 0, len(model.mean)
        for batch in batches:
            if batch.num_rows:
                z = model.expand(_matrix(batch.column(0), width))
                y = batch.column(1).to_numpy(zero_copy_only=False)
                total = total + np.concatenate((z.T @ z, (z.T @ (2 * y - 1))[:, None]), axis=1)
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([_lists(total.reshape(1, -1))], ["sums"])

    return run


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sums) to one row, their sum."""
    total = None
    for batch in batches:
        for row in batch.column(0):
            x = row.values.to_numpy(zero_copy_only=False)
            total = x.copy() if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([_lists(total.reshape(1, -1))], ["sums"])


def levels(model: Model):
    """Rows (stats, y) to (step, y, n), summed within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = steps(model.score(_matrix(batch.column(0), len(model.mean))))
                n = np.bincount(at, minlength=2 * GRID + 1)
                y = np.bincount(at, batch.column(1).to_numpy(zero_copy_only=False), 2 * GRID + 1)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(y[some]), pa.array(n[some])], ["step", "y", "n"])

    return run


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Pooled adjacent violators: the non-decreasing means nearest to y / n, weighted by n, where n > 0."""
    blocks_: list[list[float]] = []
    for a, b in zip(y.tolist(), n.tolist()):
        blocks_.append([a, b, 1])
        while len(blocks_) > 1 and blocks_[-2][0] * blocks_[-1][1] >= blocks_[-1][0] * blocks_[-2][1]:
            last = blocks_.pop()
            blocks_[-1] = [x + z for x, z in zip(blocks_[-1], last)]
    return np.concatenate([np.full(int(k), a / b) for a, b, k in blocks_]) if blocks_ else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, features: int = FEATURES, seed: int = SEED, ridge: float = RIDGE, label_column: str = "quality", id_column: str = "doc_id", text_column: str = "text", held: int = HELD, most: int = BROADCAST) -> Model | None:
    """A model from all labelled documents; None if there are none. Texts don't move.

    Labels that are null don't count; several of one doc_id are averaged. Weights come from all but one in ``held`` of the labelled
    rows, the calibration from the others; equal statistics are on one side. Where a side would be empty, both have all rows.
    """
    marks = settle(pick(labels, doc_id="doc_id", y=label_column).where("doc_id is not null and y is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col("y").cast("double")).alias("y")))
    texts = pick(docs, doc_id=id_column, text=text_column).select(F.col("doc_id").cast("long"), "text")
    if marks.count() * 64 <= most:  # as much as a row of a broadcast table takes
        marks = F.broadcast(marks)
        texts = texts.join(marks.select("doc_id"), "doc_id", "left_semi")
    side = F.pmod(F.xxhash64("stats"), F.lit(held)) == 0
    rows = settle(texts.mapInArrow(measured, "doc_id long, stats array<double>").join(marks, "doc_id").select("stats", "y", side.alias("apart")))
    d = len(NAMES)
    head = rows.agg(F.count(F.lit(1)), F.count_if("apart"), *(f(F.col("stats")[i]) for i in range(d) for f in (F.avg, F.stddev_pop))).first()
    if not head[0]:
        return None
    both = 0 < head[1] < head[0]
    fitted, apart = (rows.where("not apart"), rows.where("apart")) if both else (rows, rows)
    moments = np.array(head[2:], float).reshape(d, 2)
    model = Model(moments[:, 0], np.where(moments[:, 1] > 1e-9, moments[:, 1], 1.0), features, seed)
    sums = fitted.select("stats", "y").mapInArrow(equations(model), "sums array<double>").repartition(8).mapInArrow(added, "sums array<double>")
    total = sum(np.array(r[0]) for r in sums.toLocalIterator()).reshape(features + 1, features + 2)
    model.weights = solved(total, ridge * (head[0] - head[1] if both else head[0]))
    table = apart.select("stats", "y").mapInArrow(levels(model), "step long, y double, n long").groupBy("step").agg(F.sum("y").alias("y"), F.sum("n").alias("n")).toPandas().sort_values("step")
    means = isotonic(table["y"].to_numpy(), table["n"].to_numpy())
    model.levels = np.interp(np.arange(2 * GRID + 1), table["step"].to_numpy(), means)
    return model


def solved(total: np.ndarray, penalty: float) -> np.ndarray:
    """Ridge weights from the summed equations (features + 1, features + 2)."""
    shrunk = np.full(len(total), penalty)
    shrunk[-1] = 1e-9  # the constant isn't shrunk
    return np.linalg.solve(total[:, :-1] + np.diag(shrunk), total[:, -1])


def results(model: Model | None, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score and probability; texts without a word have probability 0, without a model others have 1."""
    score = model.score(stats) if model else np.zeros(len(stats))
    good = model.levels[steps(score)] if model else np.ones(len(stats))
    return score, np.where(stats[:, 0] > 0, good, 0.0)


def kept(model: Model | None, keep: float, at_text: int):
    """Batches less the rows that are rejected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = [results(model, statistics(data, offsets))[1] >= keep for _, _, offsets, data in blocks(batch.column(at_text))]
            if stay:
                yield batch.filter(pa.array(np.concatenate(stay)))

    return run


def scored(model: Model | None, keep: float):
    """Rows (doc_id, text) to (doc_id, score, quality, keep)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, offsets, data in blocks(batch.column(1)):
                score, good = results(model, statistics(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score), pa.array(good), pa.array(good >= keep)], ["doc_id", "score", "quality", "keep"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, keep: float = KEEP, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score, quality, keep) of every row: ridge score, calibrated probability, whether the row stays.

    Null, empty and wordless texts have quality 0 and don't stay; texts of any length are measured whole. Repeated rows give repeated results, null
    doc_ids stay null and are unlabelled. Without any labelled row all others have quality 1. Equal scores have equal
    quality; a quality that equals the threshold stays. A statistic that all labelled rows share counts as it deviates from them. Other columns may
    have any names. An empty table gives no rows.
    """
    model = fit(docs, labels, id_column=id_column, text_column=text_column)
    rows = pick(docs, doc_id=id_column, text=text_column).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(scored(model, keep), "doc_id long, score double, quality double, keep boolean")


def keep_quality(docs: DataFrame, labels: DataFrame, keep: float = KEEP, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that ``quality_scores`` keeps, with all their columns, whatever these are called.

    Rows with a null, empty or wordless text go, null doc_ids are judged like others, repeated rows stay or go together, and an
    empty table stays empty.
    """
    model = fit(docs, labels, id_column=id_column, text_column=text_column)
    inner = numbered(docs)
    return inner.mapInArrow(kept(model, keep, place(docs.columns, text_column)), inner.schema).toDF(*docs.columns)
