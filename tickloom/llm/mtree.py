"""Exact top-k search by integer inner product in an M-tree, best first.

Components are scaled and floored to integers. With M the largest squared norm, a vector v gets one more component,
the root of M - |v|^2, and a query q the component 0. Then d(q, v)^2 = |q|^2 + M - 2 q.v, so the largest inner products
are the smallest Euclidean distances, a metric with all its bounds. Equal vectors are one point with
its ``k + 1`` smallest ids: no other id of it can be among the best k of any query.

The tree is bulk loaded. A node with more than ``CELL`` points takes ``FAN`` of them as routing points, by a hash
of their bytes, and every point goes to the nearest; this goes on, level by level and on Spark, until every
cell is small or ``DEPTH`` is reached, where larger cells are cut by hash. The loads of a level are joins of
points with the routing points of their node, spread over salts, since at first one node holds all.
A cell is cut into pages of at most ``PAGE`` points around routing points of its own; too full ones into rings.
Nodes and pages are stored with their covering radii and the distances to their parents' routing points.

A query starts in the cell that holds its own vector, which sets its k-th score. Then it goes down from the
root, into the nodes whose covering radius allows that score, tested first with the stored distance to the parent alone.
Visits of a level meet their nodes in a cogroup by (node, chunk of ``CHUNK`` queries), so a group holds one
node or one cell and a bounded number of queries. In a cell pages wait in a queue by their bound, the best goes
first, and the rest is left as soon as that bound is below the query's k-th score; in a page, points whose distance to
the routing point differs too much from the query's are not compared.

Every row is indexed. Nothing is sampled but the routing points, which only shape the tree; results are exact.

Defined results: vectors that are null or hold null, NaN or infinite components take no part, nor do rows without
vec_id; an empty vector is a zero vector, and shorter vectors count as followed by zeros. Repeated rows count once. Rows that share
a vec_id but not the vector are rows of their own: each is searched for, under the one id, and each
can be found by the other. Scores beyond a long are cut to its range, and so are components. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch

SCALE = 1024
FAN = 64
CELL = 8192
PAGE = 128
DEPTH = 8
CHUNK = 2048
SALTS = 64
LONG = np.iinfo(np.int64)


# --- vectors ------------------------------------------------------------------------


def _packed(dim: int, scale: int):
    schema = pa.schema([("vec_id", pa.int64()), ("point", pa.binary()), ("length2", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            with np.errstate(over="ignore"):
                flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            # the largest double below 2**63
            flat = np.clip(flat, float(LONG.min), np.nextafter(2.0**63, 0)).astype(np.int64)
            whole = np.zeros((len(sizes), dim), np.int64)
            at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            whole[np.repeat(np.arange(len(sizes)), sizes), at] = flat
            data = whole.tobytes()
            points = [data[a : a + 8 * dim] for a in range(0, len(data), 8 * dim)] if dim else [b""] * len(sizes)
            yield pa.record_batch([batch.column("vec_id"), pa.array(points, pa.binary()), (whole.astype(np.float64) ** 2).sum(axis=1)], schema=schema)

    return run, "vec_id bigint, point binary, length2 double"


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, the scaled vector as little-endian longs and its squared length, once per pair, of all rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    dim = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    return rows.mapInArrow(*_packed(dim, scale)).distinct()


def matrix(points: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(points), np.int64).reshape(len(points), len(points[0]) // 8)


def inner(q: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact inner products of a query and points, cut to the range of long."""
    products = (points.astype(object) @ q.astype(object)).tolist()
    return np.array([min(max(x, LONG.min), LONG.max) for x in products], np.int64)


def lifted(points: np.ndarray, top: float) -> np.ndarray:
    """Points with the component that gives all the squared length ``top``."""
    x = points.astype(np.float64)
    return np.column_stack((x, np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))))


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of every row of ``a`` to every row of ``b``."""
    out = np.empty((len(a), len(b)))
    for k, x in enumerate(b):
        out[:, k] = np.sqrt(((a - x) ** 2).sum(axis=1))
    return out


# --- building the tree --------------------------------------------------------------


def _assign(top: float):
    schema = pa.schema([("node", pa.string()), ("point", pa.binary()), ("ids", pa.list_(pa.int64())), ("to_route", pa.float64()), ("route", pa.binary()), ("route_to_parent", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = np.array(batch.column("node").to_pylist(), object)
            points = batch.column("point").to_pylist()
            child, to_route, route, up = [None] * len(points), np.zeros(len(points)), [None] * len(points), np.zeros(len(points))
            for node in np.unique(nodes):
                rows = np.flatnonzero(nodes == node)
                routes = batch.column("routes")[int(rows[0])].as_py()
                there = lifted(matrix(routes), top)
                far = apart(lifted(matrix([points[r] for r in rows]), top), there)
                best = far.argmin(axis=1)
                parent = batch.column("route")[int(rows[0])].as_py()
                over = apart(there, lifted(matrix([parent]), top))[:, 0] if parent is not None else np.zeros(len(routes))
                for r, b in zip(rows.tolist(), best.tolist()):
                    child[r], route[r] = f"{node}.{b}", routes[b]
                to_route[rows], up[rows] = far[np.arange(len(rows)), best], over[best]
            yield pa.record_batch([pa.array(child, pa.string()), pa.array(points, pa.binary()), batch.column("ids"), to_route, pa.array(route, pa.binary()), up], schema=schema)

    return run, "node string, point binary, ids array<bigint>, to_route double, route binary, route_to_parent double"


def _pages(top: float, page: int):
    """A cell's points as pages of at most ``page``, each with its routing point, radius and inner distances."""
    schema = pa.schema([("node", pa.string()), ("route", pa.binary()), ("radius", pa.float64()), ("to_parent", pa.float64()), ("points", pa.list_(pa.binary())), ("ids", pa.list_(pa.list_(pa.int64()))), ("to_route", pa.list_(pa.float64()))])

    def build(cell: pa.Table) -> pa.Table:
        points, ids = cell.column("point").to_pylist(), cell.column("ids").to_pylist()
        above = cell.column("route")[0].as_py()
        here = lifted(matrix(points), top)
        first = np.argsort(np.array([hash_of(p) for p in points], np.uint64), kind="stable")[: -(-2 * len(points) // page)]
        far = apart(here, here[first])
        best = far.argmin(axis=1)
        up = apart(here[first], lifted(matrix([above]), top))[:, 0] if above is not None else np.zeros(len(first))
        out = []
        for b, f in enumerate(first.tolist()):
            own = np.flatnonzero(best == b)
            own = own[np.argsort(far[own, b], kind="stable")]
            for part in np.array_split(own, max(1, -(-len(own) // page))):
                if len(part):
                    out.append((cell.column("node")[0].as_py(), points[f], float(far[part, b].max()), float(up[b]), [points[i] for i in part], [ids[i] for i in part], far[part, b].tolist()))
        return _table(out, schema)

    return build, "node string, route binary, radius double, to_parent double, points array<binary>, ids array<array<bigint>>, to_route array<double>"


def hash_of(point: bytes) -> int:
    x = np.frombuffer(point, np.uint64)
    with np.errstate(over="ignore"):
        return int((x * np.arange(3, 2 * len(x) + 3, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum() * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(11))


class Tree:
    """Stored nodes: ``levels`` of routing entries by parent node, and the pages of the cells."""

    def __init__(self, top: float, cells: DataFrame, levels: list[DataFrame], pages: DataFrame):
        self.top, self.cells, self.levels, self.pages = top, cells, levels, pages


def _spread(rows: DataFrame, few: DataFrame, by: str) -> DataFrame:
    """Join of many rows per key with one; the keys' rows are spread over salts."""
    salted = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("point"), F.lit(SALTS)).cast("int")).join(salted, [by, "salt"]).drop("salt")


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def build(vectors: DataFrame, keep: int, fan: int = FAN, cell: int = CELL, page: int = PAGE, depth: int = DEPTH) -> Tree:
    """The tree over vec_id and point rows; a point keeps its ``keep`` smallest ids."""
    place = F.row_number().over(Window.partitionBy("point").orderBy("vec_id"))
    points = vectors.withColumn("place", place).where(F.col("place") <= keep).groupBy("point").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("length2").alias("length2"))
    # the root's name is stored, so that joins on it are joins on a column
    points = _stored(points.withColumn("node", F.lit("0")), "points")
    top = points.agg(F.max("length2")).first()[0] or 0.0
    now = points.select("node", "point", "ids", F.lit(0.0).alias("to_route"), F.lit(None).cast("binary").alias("route"))
    done, levels = [], []
    for level in range(depth + 1):
        sizes = _stored(now.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > cell), "crowded")
        if sizes.isEmpty():
            done.append(now)
            break
        # at first one node holds all
        crowded = _spread(now, sizes, "node") if level else now
        if level:
            done.append(now.join(sizes, "node", "left_anti"))
        if level == depth:
            part = F.pmod(F.xxhash64("point", F.lit(level)), F.ceil(F.col("n") * 2 / cell))
            cut = crowded.withColumn("child", F.concat_ws(".", "node", part.cast("string")))
            parent = F.col("route")
            entry = cut.groupBy("node", F.col("child")).agg(F.max("to_route").alias("radius"), F.first("route").alias("route"))
            levels.append(_stored(entry.select(F.col("node").alias("parent"), F.col("child").alias("node"), "route", "radius", F.lit(0.0).alias("to_parent"), parent.alias("above")), "level"))
            done.append(cut.select(F.col("child").alias("node"), "point", "ids", "to_route", "route"))
            break
        crowded = _stored(crowded.drop("n"), "crowded-points") if level else crowded
        order = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("point"), "point"))
        routes = crowded.select("node", "point").withColumn("place", order).where(F.col("place") <= fan)
        routes = routes.groupBy("node").agg(F.collect_list("point").alias("routes"))
        above = crowded.groupBy("node").agg(F.first("route").alias("above"))
        moved = _stored(_spread(crowded.drop("to_route"), routes, "node").mapInArrow(*_assign(top)), "moved")
        entry = moved.groupBy("node", "route").agg(F.max("to_route").alias("radius"), F.first("route_to_parent").alias("to_parent"))
        entry = entry.withColumn("parent", F.regexp_replace("node", r"\.[0-9]+$", ""))
        levels.append(_stored(entry.join(above.withColumnRenamed("node", "parent"), "parent").select("parent", "node", "route", "radius", "to_parent", "above"), "level"))
        now = moved.select("node", "point", "ids", "to_route", "route")
    cells = reduce(DataFrame.unionByName, done)
    cells = _stored(cells, "cells")
    pages = _stored(cells.groupBy("node").applyInArrow(*_pages(top, page)), "pages")
    # the routing point of the cell, from which the pages' stored distances are measured
    pages = pages.withColumnRenamed("route", "page_route")
    return Tree(top, cells.select("node", "point", "route"), levels, pages)


# --- searching ----------------------------------------------------------------------


class Query:
    """A query vector and the k best (score, -id, whether it is the query's own point) so far."""

    def __init__(self, point: bytes, k: int, top: float, floor: int | None):
        self.point, self.k, self.floor = np.frombuffer(point, np.int64), k, floor
        self.real = self.point.astype(np.float64)
        self.high = np.append(self.real, 0.0)
        self.most = float(np.abs(self.real).max(initial=0))
        self.total = float((self.real**2).sum()) + top
        self.slack = 1e-6 * np.sqrt(self.total) + 1e-9  # for rounding, here and in stored distances
        self.best: list[tuple[int, int, bool]] = []  # a heap
        self.compared = 0

    def limit(self) -> int | None:
        """The score that a point needs, if any."""
        own = self.best[0][0] if len(self.best) == self.k else None
        return max((x for x in (own, self.floor) if x is not None), default=None)

    def reach(self) -> float:
        """The distance up to which points may have that score."""
        need = self.limit()
        return np.inf if need is None else np.sqrt(max(self.total - 2.0 * need, 0.0)) + self.slack

    def add(self, score: int, ids: list[int], same: bool) -> None:
        for i in ids:
            if len(self.best) < self.k:
                heapq.heappush(self.best, (score, -i, same))
            elif (score, -i) > self.best[0][:2]:
                heapq.heapreplace(self.best, (score, -i, same))
            else:
                break


class Page:
    """A leaf node: its points, their ids and their distances to its routing point."""

    def __init__(self, points: list[bytes], ids: list[list[int]], to_route: list[float]):
        self.points, self.ids, self.to_route = matrix(points), ids, np.array(to_route)
        self.real = self.points.astype(np.float64)
        self.most = float(np.abs(self.real).max(initial=0))

    def scores(self, query: Query, near: np.ndarray) -> np.ndarray:
        if (query.most + 1) * (self.most + 1) * (len(query.point) + 1) < 2.0**53:
            return (self.real[near] @ query.real).astype(np.int64)
        return inner(query.point, self.points[near])


class Cell:
    """A small subtree: pages, with their routing points, radii and distances to the cell's routing point."""

    def __init__(self, stored: pa.Table, above: bytes | None, top: float):
        rows = [stored.column(c).to_pylist() for c in ("points", "ids", "to_route")]
        self.pages = [Page(*row) for row in zip(*rows)]
        self.routes = lifted(matrix(stored.column("page_route").to_pylist()), top)
        self.radius, self.to_parent = stored.column("radius").to_numpy(), stored.column("to_parent").to_numpy()
        self.above = None if above is None else lifted(matrix([above]), top)[0]

    def search(self, query: Query) -> None:
        """Pages by the least distance that their radius allows, until the query's k-th score is nearer."""
        near = np.arange(len(self.pages))
        if self.above is not None:
            # by the stored distance to the cell's routing point, before any distance to a page is computed
            over = np.sqrt(((query.high - self.above) ** 2).sum())
            near = np.flatnonzero(np.abs(over - self.to_parent) - self.radius <= query.reach())
        far = np.sqrt(((self.routes[near] - query.high) ** 2).sum(axis=1))
        queue = list(zip((far - self.radius[near]).tolist(), near.tolist(), far.tolist()))
        heapq.heapify(queue)
        while queue:
            bound, k, there = heapq.heappop(queue)
            reach = query.reach()
            if bound > reach:
                return
            page = self.pages[k]
            near = np.flatnonzero(np.abs(page.to_route - there) <= reach)
            query.compared += len(near)
            scores = page.scores(query, near)
            need = query.limit()
            good = np.arange(len(near)) if need is None else np.flatnonzero(scores >= need)
            for i in good[np.argsort(-scores[good], kind="stable")].tolist():
                point = near[i]
                query.add(int(scores[i]), page.ids[point], bool((page.points[point] == query.point).all()))


_FOUND = pa.schema([("query", pa.binary()), ("score", pa.int64()), ("vec_id", pa.int64()), ("same", pa.bool_()), ("compared", pa.int64())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _visit_cells(top: float, k: int):
    def visit(visits: pa.Table, stored: pa.Table) -> pa.Table:
        out = []
        if visits.num_rows and stored.num_rows:
            cell = Cell(stored, visits.column("route")[0].as_py(), top)
            for point, floor in zip(visits.column("query").to_pylist(), visits.column("floor").to_pylist()):
                query = Query(point, k, top, floor)
                cell.search(query)
                out += [(point, score, -i, same, None) for score, i, same in query.best]
                out.append((point, None, None, None, query.compared))
        return _table(out, _FOUND)

    return visit, "query binary, score bigint, vec_id bigint, same boolean, compared bigint"


def _visit_nodes(top: float, k: int):
    schema = pa.schema([("query", pa.binary()), ("floor", pa.int64()), ("home", pa.string()), ("node", pa.string()), ("route", pa.binary())])

    def visit(visits: pa.Table, stored: pa.Table) -> pa.Table:
        out = []
        if visits.num_rows and stored.num_rows:
            nodes, routes = stored.column("node").to_pylist(), stored.column("route").to_pylist()
            radius, up = stored.column("radius").to_numpy(), stored.column("to_parent").to_numpy()
            there = lifted(matrix(routes), top)
            above = stored.column("above")[0].as_py()
            above = None if above is None else lifted(matrix([above]), top)[0]
            for point, floor, home in zip(*(visits.column(c).to_pylist() for c in ("query", "floor", "home"))):
                query = Query(point, k, top, floor)
                reach, least = query.reach(), np.zeros(len(nodes))
                if above is not None:
                    least = np.abs(np.sqrt(((query.high - above) ** 2).sum()) - up) - radius
                near = np.flatnonzero(least <= reach)
                far = np.sqrt(((there[near] - query.high) ** 2).sum(axis=1))
                out += [(point, floor, home, nodes[c], routes[c]) for c in near[far - radius[near] <= reach].tolist() if nodes[c] != home]
        return _table(out, schema)

    return visit, "query binary, floor bigint, home string, node string, route binary"


def _meet(visits: DataFrame, stored: DataFrame, chunk: int, work) -> DataFrame:
    """Visits and what is stored of their node, in groups of one node and about ``chunk`` visits."""
    counts = visits.groupBy("node").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    left = visits.withColumn("salt", F.pmod(F.xxhash64("query"), F.lit(SALTS)).cast("int"))
    left = left.join(counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["node", "salt"]).drop("salt")
    left = left.withColumn("part", F.pmod(F.xxhash64("query", F.lit(1)), F.col("chunks")).cast("int")).drop("chunks")
    right = stored.join(counts, "node").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    return left.groupBy("node", "part").cogroup(right.groupBy("node", "part")).applyInArrow(*work)


def nearest(tree: Tree, queries: DataFrame, k: int, chunk: int = CHUNK) -> DataFrame:
    """query, score, vec_id: the ``k`` best ids of every query point; queries are points of the tree.

    Rows without vec_id carry, in ``compared``, how many points a visit compared.
    """
    work = _visit_cells(tree.top, k)
    home = _stored(queries.select(F.col("point").alias("query")).distinct().join(tree.cells.withColumnRenamed("point", "query"), "query"), "home")
    first = _stored(_meet(home.withColumn("floor", F.lit(None).cast("bigint")), tree.pages, chunk, work), "first")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    floors = first.where("vec_id IS NOT NULL").withColumn("place", place).where(F.col("place") == k).select("query", F.col("score").alias("floor"))
    known = home.select("query", F.col("node").alias("home")).join(floors, "query", "left")
    visits, found = _stored(known.select("query", "floor", "home", F.lit("0").alias("node"), F.lit(None).cast("binary").alias("route")), "visits"), [first]
    for entries in tree.levels:
        entries = entries.withColumnRenamed("node", "child").withColumnRenamed("parent", "node")
        visits = _stored(_meet(visits, entries.withColumnRenamed("child", "node_below"), chunk, _renamed(_visit_nodes(tree.top, k))), "visits")
        cells = tree.pages.select("node").distinct()
        found.append(_stored(_meet(visits.join(cells, "node", "left_semi"), tree.pages, chunk, work), "found"))
        visits = visits.join(cells, "node", "left_anti")
    return reduce(DataFrame.unionByName, found)


def _renamed(work):
    """The visit of stored nodes whose own names stand in ``node_below``."""
    visit, kinds = work

    def run(visits: pa.Table, stored: pa.Table) -> pa.Table:
        return visit(visits, stored.drop_columns(["node"]).rename_columns(["node" if c == "node_below" else c for c in stored.column_names if c != "node"]))

    return run, kinds


def top_k(vectors: DataFrame, wanted, k: int = 10, scale: int = SCALE, **tree) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best other rows of every row that ``wanted`` picks.

    ``wanted`` is a condition on vec_id; ``tree`` are parameters of ``build``.
    """
    rows = _stored(integer_vectors(vectors, scale), "vectors")
    asked = rows.where(wanted)
    index = build(rows, k + 1, **tree)
    found = nearest(index, asked, k + 1).where("vec_id IS NOT NULL").drop("compared")
    order = [F.desc("score"), F.col("vec_id")]
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("place") <= k + 1).drop("place")
    pairs = asked.select(F.col("vec_id").alias("query_id"), F.col("point").alias("query")).join(best, "query").where(~(F.col("same") & (F.col("vec_id") == F.col("query_id"))))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "query").orderBy(*order)).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
