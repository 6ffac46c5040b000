"""Networks and the metrics over them. Every metric returns a lazy DataFrame."""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Iterable, Mapping
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metaweave.operators import dense
from metaweave.operators import relation as R
from metaweave.operators import slices
from metaweave.plans import shapes
from metaweave.plans.schema import Metapath, Schema, Step

Pathlike = str | Metapath
#: A table with a row for each node is broadcast up to this number of nodes (about 24 MB), counted before.
BROADCAST_NODES = 500_000
#: From so many products on, relations that meet in few nodes are multiplied in blocks.
DENSE_PRODUCTS = 50_000_000
#: From so many products on, relations towards few nodes are multiplied in slices of these.
SLICED_PRODUCTS = 1_000_000
#: Ids of edges, sorted and compressed, may take so many times less in a file than the statistics of a plan suppose: blocks are cut for this many times the rows.
COMPRESSED = 8


class Part(NamedTuple):
    """A factor of a product. like: the paths whose rows it has about; none of them: those of a diagonal; None: those of its own path."""

    relation: DataFrame
    path: Metapath
    like: tuple[Metapath, ...] | None = None


#: A sign and the factors in a row.
Term = tuple[int, list[Part]]


def _estimated_rows(relation: DataFrame) -> float | None:
    """Rows of a relation by the statistics of its plan; None if these say nothing of it."""

    def joins(plan) -> bool:
        children = plan.children()
        return plan.nodeName() == "Join" or any(joins(children.apply(i)) for i in range(children.size()))

    plan = relation._jdf.queryExecution().optimizedPlan()
    size = int(plan.stats().sizeInBytes())
    if size >= 1 << 60 or joins(plan):
        return None
    return size / (8 + sum({"string": 20}.get(kind, 8) for _, kind in relation.dtypes))


class Network:
    """Nodes and edges of a schema.

    nodes: by metanode, (id, name), an id once. edges: by stored metaedge, (src, dst, v), a pair
    once, in the stored direction; an undirected metaedge of a metanode with itself holds both
    directions of each edge. hub_rows: nodes that would make more rows in a product are split, see `relation.compose`.
    """

    def __init__(self, spark: SparkSession, schema: Schema, nodes: Mapping[str, DataFrame], edges: Mapping[str, DataFrame], hub_rows: int | None = None):
        self.spark, self.schema, self.nodes, self._edges, self.hub_rows = spark, schema, nodes, edges, hub_rows
        self._node_counts: dict[str, int] = {}
        self._rows: dict[str, float] = {}
        self._kept: dict[tuple, DataFrame] = {}

    def edges(self, step: str | Step) -> DataFrame:
        step = self.schema.step(step) if isinstance(step, str) else step
        stored = self._edges[step.stored].select("src", "dst", "v")
        return stored if step.forward else R.transpose(stored)

    def node_ids(self, metanode: str) -> DataFrame:
        """The ids in order."""
        return self.nodes[metanode].select("id").orderBy("id")

    def count_nodes(self, metanode: str) -> int:
        return self.node_counts([metanode])[0]

    def node_counts(self, metanodes: Iterable[str]) -> list[int]:
        """Numbers of nodes, found once, in one job for all."""
        metanodes = list(metanodes)
        fresh = sorted(set(metanodes) - self._node_counts.keys())
        if fresh:
            each = [self.nodes[m].agg(F.lit(m).alias("metanode"), F.count("*").alias("n")) for m in fresh]
            self._node_counts.update({row[0]: row[1] for row in reduce(DataFrame.unionAll, each).collect()})
        return [self._node_counts[m] for m in metanodes]

    def with_edges(self, edges: dict[str, DataFrame]) -> Network:
        """A network with the same nodes and other edges, such as a permutation."""
        return Network(self.spark, self.schema, self.nodes, ChainMap(edges, self._edges), self.hub_rows)

    def sizes(self, steps: Iterable[Step]) -> list[tuple[float, float, float]]:
        """Rows (approximately), source nodes and target nodes of metaedges, found once.

        Rows are told by the size of the files that a relation comes from; relations of which Spark cannot tell it (made by
        joins, or checkpointed) are counted, in one job for all.
        """
        steps = list(steps)
        unknown = []
        for name in sorted({s.stored for s in steps} - self._rows.keys()):
            rows = _estimated_rows(self._edges[name])
            if rows is None:
                unknown.append(name)
            else:
                self._rows[name] = rows
        if unknown:
            each = [self._edges[name].agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name in unknown]
            self._rows.update({row[0]: float(row[1]) for row in reduce(DataFrame.unionAll, each).collect()})
        counts = dict(zip(ends := [m for s in steps for m in (s.source, s.target)], map(float, self.node_counts(ends))))
        return [(min(self._rows[s.stored], counts[s.source] * counts[s.target]), counts[s.source], counts[s.target]) for s in steps]

    def keep(self, metapath: Pathlike, metric: str = "dwpc", damping: float = 0.5, result: DataFrame | None = None) -> DataFrame:
        """Holds a metric in memory and disk of the executors; later calls, of longer metapaths too, use it. Released by release()."""
        path = self.schema.metapath(metapath)
        result = (result if result is not None else getattr(self, metric)(path, damping)).persist()
        self._kept[metric, float(damping), path] = result
        return result

    def release(self) -> None:
        for kept in self._kept.values():
            kept.unpersist()
        self._kept.clear()

    def _known(self, metric: str, path: Metapath, damping: float) -> DataFrame | None:
        metrics = [metric]
        if shapes.category(path.metanodes) == "no_repeats":
            metrics = ["dwpc", "dwwc"]
        for m in metrics:
            if (m, float(damping), path) in self._kept:
                return self._kept[m, float(damping), path]
            if (m, float(damping), path.inverse) in self._kept:
                return R.transpose(self._kept[m, float(damping), path.inverse])
        return None

    def _small(self, step: Step) -> tuple[bool, bool]:
        """Whether the sources and targets of a metaedge are few enough for tables of them to be sent to all executors."""
        sources, targets = self.node_counts([step.source, step.target])
        return sources <= BROADCAST_NODES, targets <= BROADCAST_NODES

    def _sent(self, metanode: str) -> bool:
        """As _small, of a table of ids and numbers."""
        return self.count_nodes(metanode) <= 3 * BROADCAST_NODES

    def weighted(self, step: Step, damping: float) -> DataFrame:
        return R.degree_weighted(self.edges(step), damping, self._small(step) if damping else (False, False))

    def _compose(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return R.compose(a, b, self.hub_rows)

    def _size(self, part: Part) -> tuple[float, float, float]:
        """Rows, source nodes and target nodes of a factor, about."""
        rows, sources, targets = reduce(lambda a, b: (min(a[0] * b[0] / max(1.0, b[1]), a[1] * b[2]), a[1], b[2]), self.sizes(part.path.steps))
        if part.like is not None:
            rows = sum(self._size(Part(part.relation, p))[0] for p in part.like) if part.like else sources
        return min(rows, sources * targets), sources, targets

    def _product(self, parts: list[Part], order: str) -> DataFrame:
        """Product of relations in a row: from the left (sequential), from the right (recursive), or in the cheapest order (chain)."""
        relations = [p.relation for p in parts]
        if len(parts) == 1 or order == "sequential":
            return reduce(self._compose, relations)
        if order == "recursive":
            return reduce(lambda right, left: self._compose(left, right), relations[::-1])
        if order != "chain":
            raise ValueError(f"order {order!r}")
        self.sizes(s for p in parts for s in p.path.steps)
        sizes = [self._size(p) for p in parts]

        def build(tree) -> tuple[DataFrame, tuple[float, float, float]]:
            if isinstance(tree, int):
                return relations[tree], sizes[tree]
            (a, x), (b, y) = build(tree[0]), build(tree[1])
            made = x[0] * y[0] / max(1.0, y[1])
            size = min(made, x[1] * y[2]), x[1], y[2]
            if y[1] <= dense.MIDDLE and made >= max(DENSE_PRODUCTS, 2 * size[0]):
                return dense.compose(a, b, x[1], y[2], y[0]), size
            return self._compose(a, b), size

        return build(shapes.cheapest_order(sizes))[0]

    def _sum(self, terms: list[Term], order: str) -> DataFrame:
        """The relation that the terms make together."""
        if len(terms) == 1 and terms[0][0] == 1:
            return self._product(terms[0][1], order)
        return R.combine(*[(sign, self._product(parts, order)) for sign, parts in terms])

    def _diagonal(self, terms: list[Term], path: Metapath, order: str) -> Part:
        """The closed walks of a sum of products, without the products: each is cut where its halves have the fewest rows."""
        found = []
        for sign, parts in terms:
            if len(parts) == 1:
                found.append((sign, parts[0].relation.where("src = dst")))
                continue

            def rows(at: int) -> float:
                return sum(self._size(Part(parts[0].relation, reduce(lambda a, b: a + b, [p.path for p in half]), half[0].like if len(half) == 1 else None))[0] for half in (parts[:at], parts[at:]))

            at = min(range(1, len(parts)), key=rows)
            left = self._product(parts[:at], order)
            if all(p.like is None for p in parts) and [p.path for p in parts[:at]] == [p.path.inverse for p in reversed(parts[at:])]:
                found.append((sign, R.squared_walks(left)))  # the other half is the same, turned
            else:
                found.append((sign, R.closed_walks(left, self._product(parts[at:], order))))
        relation = R.signed_sum(*found) if len(found) > 1 or found[0][0] != 1 else found[0][1]
        return Part(relation, path, ())

    @staticmethod
    def _restricted(r: DataFrame, side: str, ids: DataFrame | None) -> DataFrame:
        return r if ids is None else r.join(ids.select(F.col("id").alias(side)).distinct(), side, "left_semi").select("src", "dst", "n", "v")

    def dwwc(self, metapath: Pathlike, damping: float = 0.5, order: str = "chain", sources: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
        """Degree-weighted walk counts (src, dst, n, v) of all pairs with walks; n counts walks. sources and targets: (id) to keep to."""
        path = self.schema.metapath(metapath)
        known = self._known("dwwc", path, damping)
        if known is None:
            self.node_counts(path.metanodes if damping else ())
            parts = [self.weighted(s, damping) for s in path.steps]
            parts[0] = self._restricted(parts[0], "src", sources)
            parts[-1] = self._restricted(parts[-1], "dst", targets)
            return self._product([Part(r, path[i : i + 1]) for i, r in enumerate(parts)], order)
        return self._restricted(self._restricted(known, "src", sources), "dst", targets)

    def dwpc(self, metapath: Pathlike, damping: float = 0.5, order: str = "chain", exact: bool = True, dtype: str = "double") -> DataFrame:
        """Degree-weighted path counts (src, dst, n, v): walks that pass no node twice. dtype: double or float, of v.

        Exact for every metapath; exact=False bounds long repeats from above instead of enumerating them
        (neighbouring repeats of a metanode differ, others may be equal).
        """
        if dtype not in ("double", "float"):
            raise ValueError(f"dtype {dtype!r}")
        path = self.schema.metapath(metapath)
        self.node_counts(path.metanodes if damping else ())  # one job for all
        result = self._run(shapes.plan(path), damping, order, exact)
        return result if dtype == "double" else result.withColumn("v", F.col("v").cast(dtype))

    def _run(self, plan: shapes.Plan, damping: float, order: str, exact: bool) -> DataFrame:
        known = self._known("dwpc", plan.path, damping)
        if known is not None:
            return known
        if plan.op == "edge":
            step = plan.path.steps[0]
            edges = self.weighted(step, damping)
            return R.off_diagonal(edges) if step.source == step.target else edges
        half = len(plan.path) // 2
        if half >= 2 and plan.path.is_symmetric and len(set(plan.path.metanodes)) == half + 1:
            return self._mirrored(plan.path, damping, order)
        if order == "chain":
            for turned in (False, True):
                there = shapes.there_again(shapes.plan(plan.path.inverse) if turned else plan)
                if there is not None and self._many_towards_few(*there):
                    found = self._there_again(*there, damping, order, exact)
                    return R.transpose(found) if turned else found
        if plan.op in ("around", "triple", "quad"):
            return R.off_diagonal(self._sum(self._open_terms(plan, damping, order, exact), order))
        if plan.op == "enumerate":
            if not exact:
                return self._bound(plan.path, damping, order)
            if shapes.thrice_crossed(plan.path) is None:
                return self.enumerate_paths(plan.path, damping)
        return self._sum(self._open_terms(plan, damping, order, exact), order)

    def two_factors(self, path: Metapath, damping: float) -> tuple[DataFrame, DataFrame | None, bool] | None:
        """Where the path counts are a product of two metaedges: these, and whether the diagonal of it is to go. The second is None if it is the first turned round."""
        plan = shapes.plan(path)
        if len(path) != 2 or plan.op not in ("chain", "around") or any(s.source == s.target for s in path.steps) or self._known("dwpc", path, damping) is not None:
            return None
        a = self.weighted(path.steps[0], damping)
        return a, None if path.is_symmetric else self.weighted(path.steps[1], damping), plan.op == "around"

    def rows_about(self, path: Metapath) -> float:
        return self._size(Part(None, path))[0]

    def _terms(self, plan: shapes.Plan, damping: float, order: str, exact: bool) -> list[Term]:
        """Products, with signs, that make up the path counts of a plan: walks, and what is taken off them for nodes passed twice.

        In a longer product each of them is multiplied in its own cheapest order, so that a product between two metanodes with many pairs, such as
        all pairs of orders, need not be made only to leave out its diagonal. What has no more rows than the edges it is made of stays whole.
        """
        whole = not exact or plan.op == "edge" or self._known("dwpc", plan.path, damping) is not None
        if not whole:
            whole = self._size(Part(None, plan.path))[0] <= sum(rows for rows, _, _ in self.sizes(plan.path.steps))
        if whole or plan.op == "enumerate" and shapes.thrice_crossed(plan.path) is None:
            return [(1, [Part(self._run(plan, damping, order, exact), plan.path)])]
        terms = self._open_terms(plan, damping, order, exact)
        if plan.op in ("around", "triple", "quad"):
            return [*terms, (-1, [self._diagonal(terms, plan.path, order)])]
        return terms

    def _open_terms(self, plan: shapes.Plan, damping: float, order: str, exact: bool) -> list[Term]:
        """As _terms; of around, triple and quad without the condition that their two ends differ."""
        if plan.op == "enumerate":
            return self._thrice_crossed(plan, damping, order, exact)
        each = [self._terms(p, damping, order, exact) for p in plan.parts]
        terms = [(1, [])]
        for more in each:
            terms = [(a * b, x + y) for a, x in terms for b, y in more]
        if plan.op not in ("quad", "baba"):
            return terms
        x, y, z = (Part(self._sum(t, order), p.path) for t, p in zip(each, plan.parts))
        first = self._diagonal([(1, [x, y])], x.path + y.path, order)
        second = self._diagonal([(1, [y, z])], y.path + z.path, order)
        less = R.signed_sum((-1, self._compose(first.relation, z.relation)), (-1, self._compose(x.relation, second.relation)),
                            (1, R.hadamard(R.hadamard(x.relation, R.transpose(y.relation)), z.relation)))
        return [*terms, (1, [Part(less, plan.path, (x.path, z.path))])]

    def _mirrored(self, path: Metapath, damping: float, order: str) -> DataFrame:
        """Path counts of a metapath that leads by different metanodes to a middle one and back by the same.

        Pairs of ways to a middle node, by inclusion and exclusion over which of the nodes between they have in common. Ways from different ends can
        have a node in common only if it is reached from several ends: where none is, as of orders with one customer, the terms are empty. The degrees of
        middle nodes are left out until the ways to each are summed, so that the last metaedge is shuffled once by the node before it.
        """
        half = len(path) // 2
        edges = self.edges(path.steps[half - 1])
        last = R.row_weighted(edges, damping)
        degrees = R.degrees(edges, "dst", "column").withColumnRenamed("node", "dst")
        factor = F.when(F.col("column") == 0, 0.0).otherwise(F.pow("column", F.lit(-float(damping))))
        before = [self.weighted(s, damping) for s in path.steps[: half - 1]]

        def ends(ways: DataFrame) -> DataFrame:
            """By two different ends: ways (src, dst, n, v, and what else is to be the same)."""
            scaled = ways.join(degrees, "dst").withColumn("v", F.col("v") * factor) if damping else ways
            key = F.struct("dst", *[c for c in ways.columns if c.startswith("x")])
            r = scaled.select("src", key.alias("dst"), "n", "v")
            return R.off_diagonal(self._compose(r, R.transpose(r)))

        first = self._product([Part(r, path[i : i + 1]) for i, r in enumerate(before)], order)
        terms = [(1, ends(self._compose(first, last)))]
        ways = before[0].select(F.col("src").alias("x0"), F.col("dst").alias("x1"), "n", "v")
        shared = {}
        for i in range(1, half):
            if i > 1:
                e = before[i - 1].alias("e")
                ways = ways.alias("w").join(e, F.col(f"w.x{i - 1}") == F.col("e.src")).select(
                    *[f"w.x{j}" for j in range(i)], F.col("e.dst").alias(f"x{i}"), (F.col("w.n") * F.col("e.n")).alias("n"), (F.col("w.v") * F.col("e.v")).alias("v"))
            shared[i] = ways.groupBy(f"x{i}").agg(F.min("x0").alias("least"), F.max("x0").alias("most")).where("least <> most").select(f"x{i}")
        for mask in range(1, 1 << (half - 1)):
            same = [i for i in range(1, half) if mask >> (i - 1) & 1]
            some = ways
            for i in same:
                some = some.join(shared[i], f"x{i}", "left_semi")
            keep = [f"x{i}" for i in same]
            # nodes in common have names of their own, as the last of them is also what the metaedge is joined by
            some = some.select(F.col("x0").alias("src"), F.col(f"x{half - 1}").alias("mid"), *keep, "n", "v").groupBy("src", "mid", *keep).agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
            e = last.alias("e")
            rows = some.alias("w").join(e, F.col("w.mid") == F.col("e.src")).select(
                "w.src", "e.dst", *[f"w.{k}" for k in keep], (F.col("w.n") * F.col("e.n")).alias("n"), (F.col("w.v") * F.col("e.v")).alias("v"))
            rows = rows.groupBy("src", "dst", *keep).agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
            terms.append(((-1) ** len(same), ends(rows)))
        return R.combine(*terms)

    def _many_towards_few(self, before: tuple[shapes.Plan, ...], step: shapes.Plan, after: tuple[shapes.Plan, ...]) -> bool:
        """Whether few targets end ways of which a product row by row would be long."""
        targets = self.node_counts([after[-1].path.target])[0]
        if targets > slices.TARGETS:
            return False
        ways = reduce(lambda a, b: a + b, [p.path for p in before] + [step.path])
        return self._size(Part(None, ways))[0] * targets >= SLICED_PRODUCTS

    def _there_again(self, before: tuple[shapes.Plan, ...], step: shapes.Plan, after: tuple[shapes.Plan, ...], damping: float, order: str, exact: bool) -> DataFrame:
        """Path counts of a metapath that takes a metaedge there, back and there again (O P O P), and ends in few nodes.

        From the right, as products towards few nodes. Ways by two different nodes P: from a P to all ends of ways on from its O, less those by itself. Ways
        from an O go on so, less those that come back to it (the squares of its other edges). Both are sums beside the products, so that no relation but the metaedge's own is made.
        """
        edges = step.path.steps[0]
        small = self._sent(edges.target) if damping else False
        around = Window.partitionBy("src")
        e = R.laid_out(self.edges(edges), damping, "src", small)
        last = self._product([Part(self._run(p, damping, order, exact), p.path) for p in after], order)
        ends = reduce(lambda a, b: a + b, [p.path for p in after])
        targets = self.node_counts([ends.target])[0]
        sources, middle = self.node_counts([edges.source, edges.target])
        rows = min(COMPRESSED * self._size(Part(None, step.path))[0], sources * middle)
        last_rows = max(self._size(Part(None, ends))[0], middle)
        reached = min(rows * last_rows / max(1, middle), sources * targets)
        if self._sent(edges.target) and last_rows <= 3 * BROADCAST_NODES:
            w, x = F.broadcast(last).alias("w"), e.alias("e")
            joined = x.join(w, F.col("e.dst") == F.col("w.src")).select("e.src", "w.dst", (F.col("e.n") * F.col("w.n")).alias("n"), (F.col("e.v") * F.col("w.v")).alias("v"))
            onward = joined.groupBy("src", "dst").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))  # lies by src already
        else:
            onward = slices.compose(e, last, (rows, last_rows), targets, sources=sources, onward=reached)
        back = slices.compose(R.transpose(e), onward, (rows, reached), targets, last, middle, middle * targets)
        n1, v1 = F.lit(1).cast("long") - F.count("*").over(around), F.col("v") * (F.col("v") * F.col("v") - F.sum(F.col("v") * F.col("v")).over(around))
        first = e.select("src", "dst", "n", "v", n1.alias("n1"), v1.alias("v1"))
        if before:
            if len(before) == 1 and before[0].op == "edge" and before[0].path.source != before[0].path.target:
                s = before[0].path.steps[0]
                a = R.laid_out(self.edges(s), damping, "dst", self._sent(s.source) if damping else False)
            else:
                a = self._product([Part(self._run(p, damping, order, exact), p.path) for p in before], order)
            scaled = [(F.col("a.n") * F.col(f"e.{c}") if c.startswith("n") else F.col("a.v") * F.col(f"e.{c}")).alias(c) for c in ("n", "v", "n1", "v1")]
            first = a.alias("a").join(first.alias("e"), F.col("a.dst") == F.col("e.src")).select("a.src", "e.dst", *scaled)
            rows = max(rows, self._size(Part(None, reduce(lambda a, b: a + b, [p.path for p in before] + [step.path])))[0])
            sources = self.node_counts([before[0].path.source])[0]
        return slices.compose(first, back, (rows, middle * targets), targets, last, sources).where("n <> 0")

    def _thrice_crossed(self, plan: shapes.Plan, damping: float, order: str, exact: bool) -> list[Term]:
        """Three metanodes, each twice, in the same order (A B C A B C): by inclusion and exclusion over which of them are passed twice."""
        a, b, c, d, e = parts = [Part(self._run(p, damping, order, exact), p.path) for p in shapes.thrice_crossed(plan.path)]

        def diagonal(*parts: Part) -> Part:
            return self._diagonal([(1, list(parts))], reduce(lambda p, q: p + q, [x.path for x in parts]), order)

        def product(*parts: Part) -> DataFrame:
            return self._product(list(parts), order)

        ad, be, turned = R.hadamard(a.relation, d.relation), R.hadamard(b.relation, e.relation), R.transpose(c.relation)
        same_ab = Part(R.hadamard(ad, R.transpose(product(b, c))), a.path, (a.path,))
        same_bc = Part(R.hadamard(be, R.transpose(product(c, d))), b.path, (b.path,))
        same_ac = R.hadamard(R.hadamard(product(a, b), turned), product(d, e))
        same = R.hadamard(product(Part(ad, a.path), Part(be, b.path)), turned)
        both = a.path + b.path
        return [(1, parts), (-1, [diagonal(a, b, c), d, e]), (-1, [a, diagonal(b, c, d), e]), (-1, [a, b, diagonal(c, d, e)]), (1, [same_ab, e]), (1, [a, same_bc]),
                (1, [Part(same_ac, both, (both,))]), (-1, [Part(same, both, (both,))])]

    def _bound(self, path: Metapath, damping: float, order: str) -> DataFrame:
        """An upper bound of the path count: neighbouring occurrences of a metanode are kept apart where their stretches do not overlap."""
        parts, at = [], 0
        while at < len(path):
            nodes = path.metanodes
            again = next((j for j in range(at + 1, len(path) + 1) if nodes[j] == nodes[at]), None)
            stop = again or at + 1
            part = self._product([Part(self.weighted(path.steps[i], damping), path[i : i + 1]) for i in range(at, stop)], order)
            parts.append(Part(R.off_diagonal(part) if again else part, path[at:stop]))
            at = stop
        return self._product(parts, order)

    def enumerate_paths(self, metapath: Pathlike, damping: float = 0.5) -> DataFrame:
        """Path counts by a join for each edge that keeps nodes of a metanode distinct. Right for every metapath, slow for long ones.

        Of the nodes passed only those are kept that a later node could equal, and prefixes that agree in them are summed after each join.
        """
        path = self.schema.metapath(metapath)
        nodes = path.metanodes
        first = self.weighted(path.steps[0], damping)
        if nodes[0] == nodes[1]:
            first = R.off_diagonal(first)
        rows = first.select(F.col("src").alias("x0"), F.col("dst").alias("x1"), "n", "v")
        seen = [0, 1]
        for i in range(1, len(path)):
            edge = self.weighted(path.steps[i], damping).alias("e")
            on = F.col(f"r.x{i}") == F.col("e.src")
            for j in seen:
                if nodes[j] == nodes[i + 1]:
                    on &= F.col(f"r.x{j}") != F.col("e.dst")
            keep = [j for j in range(i + 1) if j == 0 or nodes[j] in nodes[i + 2 :]]
            rows = (
                rows.alias("r")
                .join(edge, on)
                .select(*[F.col(f"r.x{j}") for j in keep], F.col("e.dst").alias(f"x{i + 1}"), (F.col("r.n") * F.col("e.n")).alias("n"), (F.col("r.v") * F.col("e.v")).alias("v"))
                .groupBy(*[f"x{j}" for j in keep], f"x{i + 1}")
                .agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
            )
            seen = [*keep, i + 1]
        return rows.select(F.col("x0").alias("src"), F.col(f"x{len(path)}").alias("dst"), "n", "v")

    def diffuse(self, metapath: Pathlike, weights: DataFrame, column_damping: float = 0, row_damping: float = 1) -> DataFrame:
        """Weights (id, weight) of source nodes pushed along the metapath: (id, score) of every target node, 0 where nothing arrives."""
        path = self.schema.metapath(metapath)
        scores = weights.select("id", F.col("weight").cast("double").alias("score"))
        self.node_counts(path.metanodes)
        for step in path.steps:
            edges = R.diffusion_step(self.edges(step), row_damping, column_damping, self._small(step))
            scores = scores.join(edges, scores["id"] == edges["src"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("v")).alias("score"))
        return self.nodes[path.target].select("id").join(scores, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))

    def labelled(self, step: str | Step) -> DataFrame:
        """Edges with the names of their nodes: (source_id, target_id, source_name, target_name, v)."""
        step = self.schema.step(step) if isinstance(step, str) else step
        source = self.nodes[step.source].select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
        target = self.nodes[step.target].select(F.col("id").alias("target_id"), F.col("name").alias("target_name"))
        edges = self.edges(step).select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), "v")
        return edges.join(source, "source_id").join(target, "target_id").select("source_id", "target_id", "source_name", "target_name", "v")
