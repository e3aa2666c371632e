"""Product codes of vectors, fitted on metric trees of their parts."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.common import bounded_batches, broadcast_if_small, materialize, table
from citeloom.shipping import ship_package

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: A block of vectors, over whose parts trees are built, holds about this many bytes of 32-bit components.
BLOCK_BYTES = 512 << 10
#: Balls of at most this many points are not divided further.
LEAF = 64
#: Scaled components are exact in 64-bit floats, and their sums over a block in 64-bit integers, below this.
MOST = 1 << 51
#: Labels with more than one in this many rows are so few that they are always broadcast.
FREQUENT = 1000
#: What a forest stores of each ball, besides its cached sums: the range of its points, its two children and its part.
_NODE = np.dtype([("start", "i4"), ("end", "i4"), ("left", "i4"), ("right", "i4"), ("part", "i4"), ("radius", "f8")])


def _norm(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=-1))


def anchors(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Up to ``most`` anchors of the points ``x``: the indexes that each owns.

    The point farthest from its anchor becomes the next anchor and takes the
    points that are nearer to it. Points nearer to their owner than half the
    way between the two anchors cannot change hands and are not looked at.
    """
    owner = np.zeros(len(x), dtype=np.int64)
    away = _norm(x - x[0])
    pivots = x[:1]
    while len(pivots) < most:
        far = int(away.argmax())
        if away[far] == 0:
            break
        gap = _norm(pivots - x[far])
        open_ = np.flatnonzero(2 * away > gap[owner])
        new = _norm(x[open_] - x[far])
        won = new < away[open_]
        owner[open_[won]], away[open_[won]] = len(pivots), new[won]
        pivots = np.concatenate([pivots, x[far : far + 1]])
    return [m for a in range(len(pivots)) if len(m := np.flatnonzero(owner == a))]


class _Tree:
    """The balls over one part of a block; leaves hold indexes of points, other balls two children."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        self.leaves: dict[int, np.ndarray] = {}
        self.children: list[tuple[int, int]] = []
        self.root = self.grow(np.arange(len(x)))

    def leaf(self, members: np.ndarray) -> int:
        self.children.append((-1, -1))
        self.leaves[len(self.children) - 1] = members
        return len(self.children) - 1

    def grow(self, members: np.ndarray) -> int:
        """From the middle out: anchors first, a tree below each of them, then pairs of balls are merged up to one root."""
        if len(members) <= LEAF:
            return self.leaf(members)
        owned = anchors(self.x[members], math.isqrt(len(members) - 1) + 1)
        if len(owned) < 2:
            return self.leaf(members)
        owned = [members[m] for m in owned]
        balls = [self.grow(m) for m in owned]
        centre = np.array([self.x[m].mean(axis=0) for m in owned])
        radius = np.array([_norm(self.x[m] - c).max() for m, c in zip(owned, centre, strict=True)])
        weight = np.array([float(len(m)) for m in owned])
        span = _norm(centre[:, None] - centre[None]) + radius[:, None] + radius[None]
        np.fill_diagonal(span, np.inf)
        for _ in range(len(balls) - 1):
            a, b = divmod(int(span.argmin()), len(balls))
            self.children.append((balls[a], balls[b]))
            balls[a] = len(self.children) - 1
            radius[a] = span[a, b] / 2
            both = weight[a] + weight[b]
            centre[a] = (centre[a] * weight[a] + centre[b] * weight[b]) / both
            weight[a] = both
            span[b], span[:, b] = np.inf, np.inf
            again = _norm(centre - centre[a]) + radius + radius[a]
            again[~np.isfinite(span[a])] = np.inf
            span[a], span[:, a] = again, again
        return balls[a]

    def layout(self, part: int, first_node: int, first_point: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order of the points, balls, their sums), the root first and the points of each ball side by side."""
        order: list[np.ndarray] = []
        nodes = np.zeros(len(self.children), dtype=_NODE)
        nodes["part"] = part
        number, at, stack, ends = 0, 0, [(self.root, -1, "")], []
        while stack:
            ball, parent, side = stack.pop()
            if ball < 0:  # all below this ball has been laid out
                nodes["end"][parent] = at
                continue
            here, number = number, number + 1
            if parent >= 0:
                nodes[side][parent] = here + first_node
            nodes["start"][here] = at
            if ball in self.leaves:
                order.append(self.leaves[ball])
                at += len(order[-1])
                nodes["end"][here], nodes["left"][here], nodes["right"][here] = at, -1, -1
            else:
                left, right = self.children[ball]
                stack += [(-1, here, ""), (right, here, "right"), (left, here, "left")]
        places = np.concatenate(order)
        x = self.x[places]
        upto = np.concatenate([np.zeros((1, x.shape[1]), dtype=np.int64), np.cumsum(x.astype(np.int64), axis=0)])
        sums = upto[nodes["end"]] - upto[nodes["start"]]
        spans = zip(nodes["start"].tolist(), nodes["end"].tolist(), sums, strict=True)
        radius = np.array([_norm(x[s:e] - total / (e - s)).max() for s, e, total in spans])
        nodes["radius"] = np.where(radius == 0, 0.0, radius * (1 + 1e-9) + 1e-9)  # zero for copies of one point only
        nodes["start"] += first_point
        nodes["end"] += first_point
        return places, nodes, sums


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(4096 x) as whole 64-bit floats."""
    out = np.floor(values.astype(np.float64) * SCALE)
    if len(out) and np.abs(out).max() >= MOST:
        raise ValueError(f"components beyond {MOST // SCALE} cannot be coded exactly")
    return out


def build_forest(x: np.ndarray) -> dict[str, np.ndarray]:
    """One tree for each part of the vectors ``x`` (whole floats, one row each), laid out in common arrays."""
    n, width = len(x), x.shape[1] // PARTS
    places, nodes, sums, roots, points = [], [], [], [], []
    first = 0
    for p in range(PARTS):
        part = x[:, p * width : (p + 1) * width]
        o, b, s = _Tree(part).layout(p, first, p * n)
        roots.append(first)
        first += len(b)
        places.append(o)
        nodes.append(b)
        sums.append(s)
        points.append(part[o])
    stored = np.concatenate(points)
    narrow = stored.astype(np.int32)
    return {
        "points": narrow if (narrow == stored).all() else stored,
        "place": np.concatenate(places).astype(np.int32),
        "node": np.concatenate(nodes),
        "sum": np.concatenate(sums),
        "root": np.array(roots, dtype=np.int32),
    }


def pack(forest: dict[str, np.ndarray], width: int) -> dict[str, bytes | bool | int]:
    return {
        "width": width,
        "narrow": forest["points"].dtype == np.int32,
        **{k: forest[k].tobytes() for k in ("points", "place", "node", "sum", "root")},
    }


def unpack(row: dict) -> dict[str, np.ndarray]:
    width = row["width"]
    points = np.frombuffer(row["points"], dtype=np.int32 if row["narrow"] else np.float64)
    n = len(row["place"]) // 4
    return {
        "points": points.reshape(n, width).astype(np.float64),
        "place": np.frombuffer(row["place"], dtype=np.int32),
        "node": np.frombuffer(row["node"], dtype=_NODE),
        "sum": np.frombuffer(row["sum"], dtype=np.int64).reshape(-1, width),
        "root": np.frombuffer(row["root"], dtype=np.int32),
    }


class Codebooks:
    """Entries (part, entry, position) as Python integers, and as floats for what need not be exact."""

    def __init__(self, entries: list[list[list[int]]]) -> None:
        self.exact = np.array(entries, dtype=object).reshape(PARTS, len(entries[0]), -1)
        self.near = self.exact.astype(np.float64)
        n = self.exact.shape[1]
        self.apart = _norm(self.near[:, :, None] - self.near[:, None])
        # An entry that equals an earlier one owns nothing, as ties go to the lower index.
        self.live = np.array([[not any((self.exact[p, k] == self.exact[p, j]).all() for j in range(k)) for k in range(n)] for p in range(PARTS)])

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for v in self.exact.ravel().tolist()).encode()).hexdigest()

    def _in_floats(self, points: np.ndarray) -> bool:
        """Whether sums of squared differences are exact in 64-bit floats."""
        most = max(np.abs(points).max(initial=0), np.abs(self.near).max(initial=0))
        return 4 * most * most * max(points.shape[-1], 1) < 2.0**53

    def nearest(self, points: np.ndarray, part: int) -> np.ndarray:
        """The entry nearest to each of ``points`` of one part, by exact squared distances; ties go to the lower index."""
        live = np.flatnonzero(self.live[part])
        if self._in_floats(points):
            entries = self.near[part][live]
            square = (points * points).sum(axis=1)[:, None] - 2 * points @ entries.T + (entries * entries).sum(axis=1)
            return live[square.argmin(axis=1)]
        square = ((np.frompyfunc(int, 1, 1)(points)[:, None] - self.exact[part][live][None]) ** 2).sum(axis=-1)
        return live[[min(range(len(s)), key=s.__getitem__) for s in square.tolist()]]

    def errors(self, points: np.ndarray, part: int, entry: int) -> np.ndarray:
        """Exact squared distances to one entry."""
        if self._in_floats(points):
            d = points - self.near[part, entry]
            return (d * d).sum(axis=1).astype(np.int64)
        return ((np.frompyfunc(int, 1, 1)(points) - self.exact[part, entry]) ** 2).sum(axis=1)

    def walk(self, forest: dict[str, np.ndarray]) -> Iterator[tuple[int, int, np.ndarray | None, np.ndarray]]:
        """Yields (part, entry, ball numbers or None, points) until every point is owned.

        Balls go down with the candidates that their parent left. A candidate
        goes when every place inside the ball is nearer to the best one; a ball
        with one candidate is wholly owned, and what it caches counts. Only
        leaves that stay shared are looked at point by point.
        """
        nodes, sums = forest["node"], forest["sum"]
        at = forest["root"].astype(np.int64)
        mine = self.live.copy()
        shared: list[np.ndarray] = []
        while len(at):
            ball = nodes[at]
            part, count = ball["part"], (ball["end"] - ball["start"])
            centre = sums[at] / count[:, None]
            d = centre[:, None] - self.near[part]
            square = np.where(mine, (d * d).sum(axis=-1), np.inf)
            best = square.argmin(axis=1)
            least = square[np.arange(len(at)), best]
            slack = 1e-9 * ((centre * centre).sum(axis=1) + (self.near * self.near).sum(axis=-1).max(initial=0)) + 1e-9
            reach = 2 * ball["radius"][:, None] * self.apart[part, best] * (1 + 1e-9)
            mine &= square - least[:, None] <= reach + slack[:, None]
            owned = mine.sum(axis=1) == 1
            for i in np.flatnonzero(owned).tolist():
                yield int(part[i]), int(best[i]), at[i : i + 1], np.arange(ball["start"][i], ball["end"][i])
            inner = ~owned & (ball["left"] >= 0)
            shared.append(at[~owned & (ball["left"] < 0)])
            at = np.concatenate([ball["left"][inner], ball["right"][inner]]).astype(np.int64)
            mine = np.concatenate([mine[inner], mine[inner]])
        for p in range(PARTS):
            left = np.concatenate([s[nodes["part"][s] == p] for s in shared]) if shared else np.zeros(0, dtype=np.int64)
            if not len(left):
                continue
            where = np.concatenate([np.arange(nodes["start"][i], nodes["end"][i]) for i in left])
            near = self.nearest(forest["points"][where], p)
            for k in np.unique(near).tolist():
                yield p, k, None, where[near == k]


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows to blocks with their forests."""

    def block() -> pa.RecordBatch:
        packed = pack(build_forest(scaled(np.concatenate(rows).reshape(-1, width))), width // PARTS)
        types = {"width": pa.int32(), "narrow": pa.bool_()}
        columns = [pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(label))]
        columns += [pa.array([v], types.get(k, pa.binary())) for k, v in packed.items()]
        return pa.RecordBatch.from_arrays(columns, names=["vec_ids", "labels", *packed])

    ids, labels, rows, width, most, label = [], [], [], None, 0, None
    for b in batches:
        label = b.column(1).type
        sizes = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
        if not len(sizes):
            continue
        width = int(sizes[0]) if width is None else width
        if (sizes != width).any() or width % PARTS or not width:
            raise ValueError(f"vectors must have one length that {PARTS} divides, not {sorted(set(sizes.tolist()) | {width})}")
        most = max(1, block_bytes // (4 * width))
        values = b.column(2).flatten().to_numpy(zero_copy_only=False)
        at = 0
        while at < len(sizes):
            take = min(most - len(ids), len(sizes) - at)
            ids += b.column(0).slice(at, take).to_pylist()
            labels += b.column(1).slice(at, take).to_pylist()
            rows.append(values[at * width : (at + take) * width])
            at += take
            if len(ids) == most:
                yield block()
                ids, labels, rows = [], [], []
    if ids:
        yield block()


def usable(vector: Column) -> Column:
    """Neither null nor with a null, NaN or infinite component."""
    inf = float("inf")
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))


def forests(vectors: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of the usable rows of ``vectors`` (vec_id, embedding, label) with the trees of their parts."""
    spark = vectors.sparkSession
    ship_package(spark)
    bounded_batches(spark)
    rows = vectors.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>"))
    kind = T.DataType.simpleString(vectors.schema["label"].dataType)
    schema = f"vec_ids array<long>, labels array<{kind}>, width int, narrow boolean, points binary, place binary, node binary, sum binary, root binary"
    return materialize(rows.mapInArrow(lambda it: _blocks(it, block_bytes), schema), "part-forests")


def _tally(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
    """The sums and counts of what each entry owns in the forests of one task."""
    total = np.zeros(books.exact.shape, dtype=object)
    count = np.zeros(books.exact.shape[:2], dtype=np.int64)
    for b in batches:
        for row in b.to_pylist():
            forest = unpack(row)
            for part, entry, ball, where in books.walk(forest):
                cached = forest["sum"][ball[0]] if ball is not None else forest["points"][where].astype(np.int64).sum(axis=0)
                total[part, entry] += cached
                count[part, entry] += len(where)
    at = np.argwhere(np.repeat(count[:, :, None] > 0, total.shape[2], axis=2))
    yield pa.RecordBatch.from_arrays(
        [
            *[pa.array(at[:, i], pa.int32()) for i in range(3)],
            pa.array([int(total[tuple(i)]) for i in at], pa.decimal128(38, 0)),
            pa.array([int(count[i[0], i[1]]) for i in at], pa.int64()),
        ],
        names=["part", "entry", "place", "total", "n"],
    )


def fit_codebooks(blocks: DataFrame, seeds: list[list[int]], rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after ``rounds`` rounds from the whole vectors ``seeds``. Each round brings the driver one number for each component of the entries."""
    width = len(seeds[0]) // PARTS
    books = Codebooks([[s[p * width : (p + 1) * width] for s in seeds] for p in range(PARTS)])
    forest = blocks.drop("vec_ids", "labels")
    for _ in range(rounds):
        part_sums = forest.mapInArrow(lambda it, books=books: _tally(it, books), "part int, entry int, place int, total decimal(38,0), n long")
        new = books.exact.copy()
        for r in part_sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            new[r.part, r.entry, r.place] = int(r.total) // r.n
        if (new == books.exact).all():
            break  # later rounds would change nothing
        books = Codebooks(new.tolist())
    return books


def _encode(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
    for b in batches:
        label = b.column("labels").type.value_type
        for row in b.to_pylist():
            forest = unpack(row)
            n = len(row["vec_ids"])
            codes = np.zeros((n, PARTS), dtype=np.uint8)
            error = np.zeros(n, dtype=object)
            for part, entry, _, where in books.walk(forest):
                place = forest["place"][where]
                codes[place, part] = entry
                error[place] += books.errors(forest["points"][where], part, entry)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["vec_ids"], pa.int64()), pa.array(row["labels"], label), pa.array([c.tobytes().hex() for c in codes]), pa.array([int(e) for e in error], pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds the error summed over equal labels, null labels together; labels of many rows are met without a shuffle of the rows."""
    spark = coded.sparkSession
    totals = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")).withColumnRenamed("label", "_label"), "label-errors")
    same = F.col("label").eqNullSafe(F.col("_label"))
    rows = totals.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    frequent = totals.where(F.col("_n") * FREQUENT > rows)  # fewer than FREQUENT rows
    found = coded.join(F.broadcast(frequent), same, "left")
    if not totals.where(F.col("_n") * FREQUENT <= rows).limit(1).count():
        return found.drop("_label", "_n")
    often = found.where("_n is not null").drop("_label", "_n")
    rest = found.where("_n is null").drop("_label", "_n", "label_error")
    return often.unionByName(rest.join(broadcast_if_small(totals), same).drop("_label", "_n"))


def vector_codes(vectors: DataFrame, rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) for every usable row of ``vectors``.

    Vectors are cut into eight parts, and each part position has a codebook of
    16 entries, fitted in ``rounds`` rounds from the vectors of the 16 smallest
    ids (of equal ids the smaller vectors first, null ids last; fewer than 16
    rows make as many entries). Spark deals the rows into blocks; over the
    parts of each block stand anchors-hierarchy metric trees, written once and
    walked in every round, and only sums and counts leave a task.

    Rows whose vector is null or holds a null, NaN or infinite component go;
    null ids and labels stay. Repeated rows each count and get equal codes;
    equal distances go to the lower entry. Vectors of different lengths, of a
    length that eight does not divide, or with components beyond 5e11 are an
    error, as is an error sum beyond 64 bits. An empty table, or one without
    usable rows, gives no rows; other columns, whatever their names, are not
    read.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding", "label")
    first = rows.where(usable(F.col("embedding"))).orderBy(F.col("vec_id").cast("long").asc_nulls_last(), "embedding").limit(ENTRIES)
    seeds = [[math.floor(SCALE * x) for x in r.embedding] for r in first.select(F.col("embedding").cast("array<double>")).collect()]
    out = "vec_id long, label {}, code string, error long".format(T.DataType.simpleString(rows.schema["label"].dataType))
    if not seeds:
        empty = spark.createDataFrame([], out)
        return empty.withColumn("label_error", F.lit(None).cast("long")).withColumn("codebooks_sha256", F.lit(None).cast("string"))
    blocks = forests(rows, block_bytes)
    if len({len(s) for s in seeds}) > 1:
        raise ValueError("vectors must have one length")
    books = fit_codebooks(blocks, seeds, rounds)
    coded = materialize(blocks.mapInArrow(lambda it: _encode(it, books), out), "vector-codes")
    return with_label_errors(coded).withColumn("codebooks_sha256", F.lit(books.digest()))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vector_codes(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    width = "(SELECT max(len(q)) // 8 FROM v)"
    steps = [
        """v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"""x AS MATERIALIZED (
  SELECT r, p, q[p * w + 1:(p + 1) * w] AS x FROM v, (SELECT {width} AS w), (SELECT unnest(range(8)) AS p)
)""",
        "c0 AS (SELECT p, r AS e, x AS c FROM x WHERE r < 16)",
    ]
    square = "CAST(list_sum(list_transform(list_zip(x.x, c.c), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS BIGINT)"
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, p, min({square} * 16 + e) AS m FROM x JOIN c{i} c USING (p) GROUP BY r, p)")
        if i < ROUNDS:
            steps.append(f"""u{i} AS (
  SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY k) AS c FROM (
    SELECT p, m % 16 AS e, k, CAST(sum(x[k]) AS BIGINT) AS s, count(*) AS n
    FROM (SELECT a.p, a.m, x.x, unnest(range(1, len(x.x) + 1)) AS k FROM a{i} a JOIN x USING (r, p)) GROUP BY p, m % 16, k
  ) GROUP BY p, e
)""")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(u.c, c.c) AS c FROM c{i} c LEFT JOIN u{i} u USING (p, e))")
    return "WITH " + ",\n".join(steps) + f""",
d AS (
  SELECT r, string_agg(printf('%02x', m % 16), '' ORDER BY p) AS code, CAST(sum(m // 16) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r
), k AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN d USING (r), k
"""


OP12_SQL = _sql()
