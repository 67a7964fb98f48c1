"""Operator 6: approximate nearest neighbours in robust-pruned directed graphs.

Vectors are dealt to shards of a fixed size by a hash. In each shard points are inserted in growing batches: a greedy
search from the entry point proposes neighbours, and a proposal is dropped if a neighbour already chosen is nearer to it,
by the factor ``ALPHA``, than the point itself; so the edges that stay are short or lead elsewhere. Queries are a stated set;
they are broadcast in blocks of a bounded size, each block searches every shard by beam, and the lists of the shards that
one task sees are merged there. Searches and prunings run for many points side by side. Equal vectors are one point with
the lowest of their ids, as edges between them would be pruned; lists are expanded to these ids.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import pick, settle

#: Neighbours of each query, edges of a point, factor of pruning, and widths of the beam when inserting and querying.
NEIGHBOURS, DEGREE, ALPHA, BUILD, BEAM = 10, 32, 1.2, 64, 128
#: Vectors in a shard, bytes of queries broadcast at once, points searched side by side, and points expanded in one step.
SHARD, BLOCK, LANES, STEP = 16384, 64 << 20, 256, 4
#: Of the rows, those whose id is divisible by this are the queries of op6.
EVERY = 100
PACKED = "part int, dims int, ids binary, vectors binary, links binary, entry int"
#: Greatest and least size of the largest number with which squares are safe in 32 bits.
SAFE = 1e15, 1e-15


def gaps(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances between rows of x (.., m, d) and y (.., n, d), of squared lengths a and b."""
    return np.maximum(a[..., :, None] + b[..., None, :] - 2 * (x @ np.swapaxes(y, -1, -2)), 0)


class Graph:
    """A directed graph over one shard; -1 marks free places among the links."""

    def __init__(self, vectors: np.ndarray, links: np.ndarray | None = None, entry: int = 0, degree: int = DEGREE, alpha: float = ALPHA) -> None:
        n, d = vectors.shape
        self.vectors = np.concatenate((vectors, np.zeros((1, d), vectors.dtype)))  # the last stands for no point
        self.square = np.einsum("ij,ij->i", self.vectors, self.vectors)
        self.degree, self.alpha, self.entry = degree, alpha, entry
        self.links = np.full((n, 2 * degree), -1, np.int32) if links is None else links

    @property
    def size(self) -> int:
        return len(self.links)

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest points met by each query's beam and their squared distances, nearest first."""
        found = [self._beam(queries[i : i + LANES], width) for i in range(0, len(queries), LANES)]
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def _beam(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        count, none = len(q), self.size
        own = np.einsum("ij,ij->i", q, q)
        ids = np.full((count, width), none, np.int64)
        far = np.full((count, width), np.inf, q.dtype)
        fresh = np.zeros((count, width), bool)
        seen = np.zeros((count, none + 1), bool)
        seen[:, none] = True
        ids[:, 0], fresh[:, 0] = self.entry, True
        far[:, 0] = np.maximum(own + self.square[self.entry] - 2 * q @ self.vectors[self.entry], 0)
        seen[:, self.entry] = True
        while True:
            rows = np.flatnonzero(fresh.any(axis=1))
            if not len(rows):
                return ids, far
            some = fresh[rows]
            rank = np.cumsum(some, axis=1)
            line, place = np.nonzero(some & (rank <= STEP))
            fresh[rows[line], place] = False
            chosen = np.full((len(rows), STEP), none, np.int64)
            chosen[line, rank[line, place] - 1] = ids[rows[line], place]
            links = np.where(chosen[:, :, None] < none, self.links[np.minimum(chosen, none - 1)], -1).reshape(len(rows), -1)
            links = np.where(links < 0, none, links).astype(np.int64)
            links.sort(axis=1)
            links[:, 1:][links[:, 1:] == links[:, :-1]] = none
            links[seen[rows[:, None], links]] = none
            links.sort(axis=1)
            links = links[:, : max(1, int((links < none).sum(axis=1).max()))]
            seen[rows[:, None], links] = True
            d = own[rows, None] + self.square[links] - 2 * (self.vectors[links] @ q[rows][:, :, None])[:, :, 0]
            d = np.where(links < none, np.maximum(d, 0), np.inf).astype(q.dtype)
            all_ids, all_far = np.concatenate((ids[rows], links), axis=1), np.concatenate((far[rows], d), axis=1)
            all_fresh = np.concatenate((fresh[rows], links < none), axis=1)
            best = np.argpartition(all_far, width - 1, axis=1)[:, :width]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(all_far, best, 1), axis=1, kind="stable"), 1)
            ids[rows], far[rows], fresh[rows] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_far, all_fresh))

    def prune(self, points: np.ndarray, proposed: np.ndarray) -> np.ndarray:
        """For each point at most ``degree`` of its proposals (-1 or itself counts as none), diverse ones, nearest first."""
        out = np.full((len(points), self.degree), -1, np.int32)
        for i in range(0, len(points), LANES):
            p, c = points[i : i + LANES], proposed[i : i + LANES].astype(np.int64)
            c = np.sort(np.where((c < 0) | (c == p[:, None]), self.size, c), axis=1)
            c[:, 1:][c[:, 1:] == c[:, :-1]] = self.size
            d = gaps(self.square[p][:, None], self.square[c], self.vectors[p][:, None], self.vectors[c])[:, 0]
            d = np.where(c < self.size, d, np.inf)
            order = np.argsort(d, axis=1, kind="stable")
            c, d = np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1)
            wide = max(1, int((c < self.size).sum(axis=1).max()))
            c, d = c[:, :wide], d[:, :wide]
            between = gaps(self.square[c], self.square[c], self.vectors[c], self.vectors[c]) * self.alpha**2
            alive, lane = c < self.size, np.arange(len(p))
            for k in range(self.degree):
                if not alive.any():
                    break
                at = alive.argmax(axis=1)
                left = alive[lane, at]
                out[i : i + LANES, k] = np.where(left, c[lane, at], -1)
                alive &= between[lane, at] > d
                alive[lane, at] = False
        return out

    def link_back(self, points: np.ndarray, chosen: np.ndarray) -> None:
        """Adds the edges from the chosen neighbours to the points; who has no free place left is pruned first."""
        line, place = np.nonzero(chosen >= 0)
        target, source = chosen[line, place], points[line]
        while len(target):
            order = np.argsort(target, kind="stable")
            target, source = target[order], source[order]
            held, first = np.unique(target, return_index=True)
            nth = np.arange(len(target)) - np.repeat(first, np.diff(np.concatenate((first, [len(target)]))))
            used = (self.links[held] >= 0).sum(axis=1)
            full = held[used >= 2 * self.degree]
            if len(full):
                self.links[full, self.degree :] = -1
                self.links[full, : self.degree] = self.prune(full, self._with(full, target, source))
                done = np.isin(target, full)  # their newcomers were among the proposals, as far as they fitted
                done &= nth < self.degree
            else:
                done = np.zeros(len(target), bool)
            slot = np.repeat(used, np.diff(np.concatenate((first, [len(target)])))) + nth
            fits = ~done & (slot < 2 * self.degree) & ~np.isin(target, full)
            self.links[target[fits], slot[fits]] = source[fits]
            left = ~done & ~fits
            target, source = target[left], source[left]

    def _with(self, full: np.ndarray, target: np.ndarray, source: np.ndarray) -> np.ndarray:
        """The links of each full point and up to ``degree`` newcomers."""
        more = np.full((len(full), self.degree), -1, np.int64)
        begin = np.searchsorted(target, full)
        count = np.minimum(np.searchsorted(target, full, "right") - begin, self.degree)
        line = np.repeat(np.arange(len(full)), count)
        place = np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count)
        more[line, place] = source[begin[line] + place]
        return np.concatenate((self.links[full], more), axis=1)

    def build(self, width: int = BUILD) -> "Graph":
        n = self.size
        centre = self.vectors[:n].mean(axis=0, keepdims=True)
        middle = int(((self.vectors[:n] - centre) ** 2).sum(axis=1).argmin())
        order = np.concatenate(([middle], np.delete(np.arange(n), middle)))
        self.entry, done = middle, 1
        while done < n:
            batch = order[done : done + min(max(16, done), max(64, n // 16))]
            proposed = np.where((x := self.search(self.vectors[batch], width)[0]) < n, x, -1)
            if done < width:  # a batch that is larger than what it can find also proposes itself
                proposed = np.concatenate((proposed, np.broadcast_to(batch, (len(batch), len(batch)))), axis=1)
            chosen = self.prune(batch, proposed)
            self.links[batch, : self.degree] = chosen
            self.link_back(batch, chosen)
            done += len(batch)
        over = np.flatnonzero((self.links >= 0).sum(axis=1) > self.degree)
        pruned = self.prune(over, self.links[over])
        self.links[over, self.degree :] = -1
        self.links[over, : self.degree] = pruned
        self.links = np.ascontiguousarray(self.links[:, : self.degree])
        return self


def centred(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors less their mean, which distances don't notice but rounding does, and the mean; in 64 bits where squares would leave 32."""
    most = float(np.abs(vectors).max(initial=0))
    x = vectors.astype(np.float64)
    middle = x.mean(axis=0)
    return (x - middle).astype(np.float32 if SAFE[1] < most < SAFE[0] else np.float64), middle


def packed(degree: int, alpha: float, width: int, most: int):
    """Rows (part, ids, vector), sorted by part, to one row of PACKED for each part; of each point's ids the ``most`` lowest, -1 for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def emit(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(rows)
            lists = table["ids"].combine_chunks()
            ids = np.full((len(lists), most), -1, np.int64)
            size = lists.value_lengths().to_numpy()
            line = np.repeat(np.arange(len(lists)), size)
            ids[line, np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
            x = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(ids), -1)
            order = np.argsort(ids[:, 0])
            ids, x = ids[order], x[order]
            g = Graph(centred(x)[0], degree=degree, alpha=alpha).build(width)
            row = [[table["part"][0].as_py()], [x.shape[1]], [ids.tobytes()], [x.tobytes()], [g.links.tobytes()], [g.entry]]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32()))], ["part", "dims", "ids", "vectors", "links", "entry"])

        for batch in batches:
            part = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a and held and held[0].column(0)[0].as_py() != part[a]:
                    yield emit(held)
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield emit(held)

    return run


def nearest(g: Graph, middle: np.ndarray, x: np.ndarray, ids: np.ndarray, q_ids: np.ndarray, q: np.ndarray, width: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and squared distances of the ``most`` nearest rows of a shard for each query, itself excepted; -1 and inf where there are fewer."""
    near, _ = g.search((q.astype(np.float64) - middle).astype(g.vectors.dtype), max(width, most + 1))
    found, gap = np.full((len(q), most), -1, np.int64), np.full((len(q), most), np.inf)
    for a in range(0, len(q), LANES):
        at, own = near[a : a + LANES], q_ids[a : a + LANES]
        there = at < g.size
        at = np.where(there, at, 0)
        d = ((q[a : a + LANES, None].astype(float) - x[at]) ** 2).sum(axis=2)
        d[~there] = np.inf
        best = np.argsort(d, axis=1, kind="stable")[:, : most + 1]
        # the points beyond that are no nearer; those as near as the last stay, as ids decide between equals
        d_last = np.take_along_axis(d, best[:, -1:], 1)
        d[d > d_last] = np.inf
        rows = ids[at].reshape(len(own), -1)
        d = np.repeat(d, ids.shape[1], axis=1)
        d[(rows < 0) | (rows == own[:, None])] = np.inf
        order = np.lexsort((rows, d), axis=1)[:, :most]
        got = np.take_along_axis(d, order, 1)
        size = got.shape[1]
        gap[a : a + LANES, :size] = got
        found[a : a + LANES, :size] = np.where(np.isfinite(got), np.take_along_axis(rows, order, 1), -1)
    return found, gap


def searched(shared, degree: int, alpha: float, width: int, most: int):
    """Rows of PACKED to (vec_id, distance, neighbour_id): for each query of the block the nearest of all shards of the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                dims = batch.column(1)[i].as_py()
                if dims not in shared.value:
                    continue
                q_ids, q = shared.value[dims]
                ids, x, links, entry = (batch.column(k)[i].as_py() for k in range(2, 6))
                x = np.frombuffer(x, np.float32).reshape(-1, dims)
                moved, middle = centred(x)
                g = Graph(moved, np.frombuffer(links, np.int32).reshape(-1, degree), entry, degree, alpha)
                found, gap = nearest(g, middle, x, np.frombuffer(ids, np.int64).reshape(len(x), -1), q_ids, q, width, most)
                if dims in best:
                    found, gap = (np.concatenate(pair, axis=1) for pair in zip(best[dims], (found, gap)))
                    order = np.lexsort((found, gap), axis=1)[:, :most]
                    found, gap = (np.take_along_axis(v, order, 1) for v in (found, gap))
                best[dims] = found, gap
        for dims, (found, gap) in best.items():
            line, place = np.nonzero(np.isfinite(gap))
            yield pa.RecordBatch.from_arrays([pa.array(shared.value[dims][0][line]), pa.array(np.sqrt(gap[line, place])), pa.array(found[line, place])], ["vec_id", "distance", "neighbour_id"])

    return run


def sound(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, vector) of the rows that have an id and a vector of finite numbers, one for each id."""
    rows = pick(table, vec_id=id_column, vector=vector_column).select(F.col("vec_id").cast("long"), F.col("vector").cast("array<float>"))
    fine = F.col("vec_id").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return rows.where(fine).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def nearest_neighbours(embeddings: DataFrame, queries: DataFrame | None = None, neighbours: int = NEIGHBOURS, shard: int = SHARD, block: int = BLOCK, degree: int = DEGREE, alpha: float = ALPHA, build: int = BUILD, beam: int = BEAM, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, rank, neighbour_id, distance): for every query the nearest other rows of the table by Euclidean distance, rank from 1.

    ``queries`` are rows like those of the table, all of its rows if not given. Every row is in the index. Rows whose id or
    vector is null or empty, or that hold a null or a number that isn't finite, are left out, in both tables. Rows of
    different dimensions aren't compared: each has neighbours of its own dimension only. Of several rows with one id the one with the
    least vector counts. Of equally far neighbours the lower id comes first. Fewer rows than neighbours give shorter
    lists; a single row gives none, and so does an empty table. Vectors of any length in numbers are searched whole; other columns
    may have any names.
    """
    spark = embeddings.sparkSession
    rows = sound(embeddings, id_column, vector_column)
    first = Window.partitionBy("vector").orderBy("vec_id")  # more than neighbours + 1 equal rows are in no list
    lowest = rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= neighbours + 1)
    points = settle(lowest.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    parts, base = {}, 0
    for r in sorted(points.groupBy(F.size("vector").alias("d")).count().collect()):
        parts[r["d"]] = base, -(-r["count"] // shard)
        base += parts[r["d"]][1]
    if not parts:
        return spark.createDataFrame([], "vec_id long, rank int, neighbour_id long, distance double")
    known = F.create_map(*(F.lit(x) for d, (a, _) in parts.items() for x in (d, a))), F.create_map(*(F.lit(x) for d, (_, n) in parts.items() for x in (d, n)))
    start, count = (m[F.size("vector")] for m in known)
    dealt = points.select((start + F.pmod(F.xxhash64("vector"), count)).cast("int").alias("part"), "ids", "vector")
    shards = settle(dealt.repartitionById(base, "part").sortWithinPartitions("part").mapInArrow(packed(degree, alpha, build, neighbours + 1), PACKED))
    asked = settle(rows if queries is None else sound(queries, id_column, vector_column))
    size = asked.agg(F.sum(F.size("vector") * 4 + 8)).first()[0] or 0
    blocks = max(1, -(-size // block))
    lists = []
    for b in range(blocks):
        table = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)).toArrow()
        lengths, groups = table["vector"].combine_chunks().value_lengths().to_numpy(), {}
        for d in np.unique(lengths).tolist():
            own = table.filter(pa.array(lengths == d))
            groups[d] = own["vec_id"].to_numpy(), own["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        shared = spark.sparkContext.broadcast(groups)
        lists.append(settle(shards.mapInArrow(searched(shared, degree, alpha, beam, neighbours), "vec_id long, distance double, neighbour_id long")))
        shared.unpersist()
    found = lists[0]
    for x in lists[1:]:
        found = found.unionByName(x)
    order = Window.partitionBy("vec_id").orderBy("distance", "neighbour_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= neighbours)
    return ranked.select("vec_id", "rank", "neighbour_id", "distance")


def asked_every(embeddings: DataFrame, every: int = EVERY, id_column: str = "vec_id") -> DataFrame:
    """The stated set of queries: all rows whose id is divisible by ``every``."""
    at = embeddings.columns.index(id_column)
    plain = embeddings.toDF(*(f"c{i}" for i in range(len(embeddings.columns))))
    return plain.where(F.col(f"c{at}").cast("long") % every == 0).toDF(*embeddings.columns)
