"""The product of a relation with one to few targets: blocks of sources against slices of middle nodes, each cell summed where it is made.

A join by the middle node would make every product a row, and shuffle most of them. Here both factors are shuffled once, packed; no product is.
A task has the sums of one block of sources, and reads all slices one after the other, each with the rows of its block that lead to it: it
holds no more of them than one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Targets at most; rows of a block of sources and of a slice of middle nodes, about; rows packed and put out at once.
TARGETS, ROWS, SLICE, PACKED, OUT = 256, 300_000, 500_000, 1_000_000, 50_000
#: Where the sources are known: cells (a source and a target) of a block, rows of a block at most, and blocks that are enough if neither asks for more.
CELLS, BLOCK, BLOCKS = 2_000_000, 6_000_000, 12
#: Products expanded at once.
PRODUCTS = 300_000
#: In place of a slice: rows of a second relation that go to a block of sources by their own source; the row of a block by which pieces of the right side pass.
BESIDE, PASS = -1, -2


def _narrow(column):
    """A column with the same values in fewer bytes: integers in as few as hold them, others by a dictionary where that is shorter."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if pa.types.is_integer(column.type):
        bounds = pc.min_max(column).as_py()
        if bounds["min"] is None:
            return column
        return next(column.cast(t) for t in (pa.int8(), pa.int16(), pa.int32(), pa.int64()) if -(1 << t.bit_width - 1) <= bounds["min"] and bounds["max"] < 1 << t.bit_width - 1)
    if pa.types.is_floating(column.type):
        values, codes = np.unique(column.to_numpy(zero_copy_only=False), return_inverse=True)
        if len(values) > min(60_000, len(column) // 4):
            return column
        return pa.DictionaryArray.from_arrays(pa.array(codes.astype(np.uint8 if len(values) <= 256 else np.uint16)), pa.array(values))
    return column.dictionary_encode()


def _apart(count: int) -> list[int]:
    """As many whole numbers, which Spark's hash (Murmur3 of an int, seed 42) sends to as many partitions, one to each."""
    mask, found, key = (1 << 32) - 1, {}, 0
    while len(found) < count:
        k = key * 0xCC9E2D51 & mask
        h = 42 ^ ((k << 15 | k >> 17) * 0x1B873593 & mask)
        h = (h << 13 | h >> 19) * 5 + 0xE6546B64 & mask
        h ^= 4
        h = (h ^ h >> 16) * 0x85EBCA6B & mask
        h = (h ^ h >> 13) * 0xC2B2AE35 & mask
        h ^= h >> 16
        found.setdefault((h - (1 << 32) * (h >> 31)) % count, key)
        key += 1
    return [found[p] for p in range(count)]


class Packed(NamedTuple):
    """The right side of a product, packed by slice: pieces (key, data) that are not shuffled yet, slices, and the kinds of its middle nodes and targets."""

    pieces: DataFrame
    slices: int
    kinds: tuple[str, str]


def _dealt(column, count: int):
    """For each node one of so many numbers, which is the same in every task."""
    import zlib

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if pa.types.is_integer(column.type):
        h = pc.fill_null(column.cast(pa.int64()), 0).to_numpy(zero_copy_only=False).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ h >> np.uint64(32)) % np.uint64(count)).astype(np.int64)
    nodes = column.dictionary_encode(null_encoding="encode")
    codes = np.array([zlib.crc32(str(x).encode()) % count for x in nodes.dictionary.to_pylist()], np.int64)
    return codes[nodes.indices.to_numpy(zero_copy_only=False)]


def _packer(names: list[str], deal: list[tuple[str, str, list[int]]], fixed: dict[str, int] | None = None) -> Callable[[Iterator], Iterator]:
    """What packs rows in pieces. names: columns to pack. deal: of each key of a piece its name, the column that it is dealt out by, and the keys there are; fixed: keys that are the same for all."""
    most, fixed = PACKED, fixed or {}

    def pack(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        options = pa.ipc.IpcWriteOptions(compression="zstd") if pa.Codec.is_available("zstd") else None

        def flush(held):
            table = pa.Table.from_batches(held).combine_chunks()
            cell = np.zeros(table.num_rows, np.int64)
            for _, by, keys in deal:
                cell = cell * len(keys) + _dealt(table.column(by).combine_chunks(), len(keys))
            order = np.argsort(cell, kind="stable")
            cell = cell[order]
            starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            for at, stop in zip(starts, [*starts[1:], len(cell)]):
                piece = table.take(pa.array(order[at:stop]))
                columns = [_narrow(piece.column(n).combine_chunks()) for n in names]
                batch = pa.RecordBatch.from_arrays(columns, names=names)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
                    writer.write_batch(batch)
                left, found = int(cell[at]), dict(fixed)
                for name, _, keys in reversed(deal):
                    left, place = divmod(left, len(keys))
                    found[name] = keys[place]
                where = sorted(found)
                yield pa.RecordBatch.from_arrays([*[pa.array([found[n]], pa.int32()) for n in where], pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=[*where, "data"])

        held, many = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                many += batch.num_rows
            if many >= most:
                yield from flush(held)
                held, many = [], 0
                pa.default_memory_pool().release_unused()
        if held:
            yield from flush(held)

    return pack


def _left(r: DataFrame, blocks: list[int], slices: list[int] | None) -> DataFrame:
    """(key, slice, data): rows by the block of their end, and by the slice of their middle node; slices: None for those that lie beside."""
    if slices is None:
        return r.mapInArrow(_packer(r.columns, [("key", "end", blocks)], {"slice": BESIDE}), "key int, slice int, data binary")
    return r.mapInArrow(_packer(r.columns, [("key", "end", blocks), ("slice", "mid", slices)]), "key int, slice int, data binary")


def _right(r: DataFrame, again: bool, slices: list[int]) -> DataFrame:
    """(key, data): rows of a relation towards the targets by the slice of their middle node."""
    rows = r.where("src IS NOT NULL").select(F.col("src").alias("mid"), F.col("dst").alias("end"), "n", "v", F.lit(again).alias("again"))
    return rows.mapInArrow(_packer(rows.columns, [("key", "mid", slices)]), "key int, data binary")


def slices_of(rows: float) -> int:
    """Slices of a relation of about so many rows."""
    return max(1, math.ceil(rows / SLICE))


def _opened(pieces, types: dict):
    """The table that was packed in pieces, with the types it had."""
    import pyarrow as pa

    columns = {n: [] for n in types}
    for piece in pieces:
        table = pa.ipc.open_stream(piece).read_all()
        for n, kind in types.items():
            for c in table.column(n).chunks:
                c = c.dictionary_decode() if pa.types.is_dictionary(c.type) else c
                columns[n].append(c.cast(kind))
    return {n: pa.concat_arrays(c) if c else pa.array([], types[n]) for n, c in columns.items()}


def _inverted(flag):
    import pyarrow.compute as pc

    return pc.invert(flag)


def _arrow(spark, kind: str):
    return to_arrow_type(spark.range(0).select(F.lit(None).cast(kind)).schema[0].dataType)


class _Slice:
    """Rows of the right side in order of their middle nodes: mids, bounds, targets, n, v."""

    def __init__(self, b: dict):
        import numpy as np
        import pyarrow as pa

        each = b["mid"].dictionary_encode()
        codes = each.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        self.mids = each.dictionary
        self.bounds = np.searchsorted(codes[order], np.arange(len(self.mids) + 1))
        self.targets = b["end"].take(pa.array(order))
        self.n, self.v = (b[c].to_numpy(zero_copy_only=False)[order] for c in ("n", "v"))


class _Block:
    """Sums of the sources of a block for each target, exact."""

    def __init__(self, sources: int, targets: int):
        import numpy as np

        self.ends, self.count, self.targets = None, 0, {}
        shape = max(1, sources), max(1, targets)
        self.n, self.v, self.made, self.most, self.bound = np.zeros(shape, np.int64), np.zeros(shape), np.zeros(shape, bool), None, 0.0
        self.squares = np.zeros(shape[0], np.int64), np.zeros(shape[0])

    def _grow(self, sources: int, targets: int) -> None:
        import numpy as np

        def grown(x, shape):
            y = np.zeros(shape, x.dtype)
            y[tuple(slice(0, k) for k in x.shape)] = x
            return y

        rows, columns = self.n.shape
        if sources > rows or targets > columns:
            shape = (rows if sources <= rows else max(sources, rows + rows // 2)), (columns if targets <= columns else max(targets, 2 * columns))
            self.n, self.v, self.made = (grown(x, shape) for x in (self.n, self.v, self.made))
            self.squares = tuple(grown(x, shape[:1]) for x in self.squares)
            if self.most is not None:
                most = np.full(shape, self.most.max(initial=0.0))
                most[:rows, :columns] = self.most
                self.most = most

    def places(self, ends):
        """The places of sources, which are given one if they have none."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        each = ends.dictionary_encode(null_encoding="encode")
        nodes = each.dictionary
        if self.ends is None:
            self.ends = nodes.slice(0, 0)
        at = pc.fill_null(pc.index_in(nodes, self.ends), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            at[fresh] = self.count + np.arange(len(fresh))
            self.ends = pa.concat_arrays([self.ends, nodes.take(pa.array(fresh))])
            self.count += len(fresh)
            self._grow(self.count, 0)
        return at[each.indices.to_numpy(zero_copy_only=False)]

    def _columns(self, targets):
        import numpy as np

        each = targets.dictionary_encode(null_encoding="encode")
        at = np.array([self.targets.setdefault(t, len(self.targets)) for t in each.dictionary.to_pylist()], np.int64)
        self._grow(0, len(self.targets))
        return at[each.indices.to_numpy(zero_copy_only=False)]

    def _add(self, row, column, n, m, v, w) -> None:
        """To cells: n times m, v times w."""
        import numpy as np

        cell = row * self.n.shape[1] + column
        more = float(np.abs(n.astype(float)).max(initial=0.0)) * float(np.abs(m.astype(float)).max(initial=0.0)) * len(cell)
        if self.most is None and self.bound + more >= 2.0**50:
            self.most = np.full(self.n.shape, self.bound)
        if self.most is None:
            self.bound += more
        else:
            np.add.at(self.most.reshape(-1), cell, np.abs(n.astype(float) * m))
            if self.most.max() >= 2.0**62:
                raise OverflowError("a count of paths is beyond 64 bits")
        np.add.at(self.n.reshape(-1), cell, n * m)
        np.add.at(self.v.reshape(-1), cell, v * w)
        self.made.reshape(-1)[cell] = True

    def square(self, at, n, v) -> None:
        import numpy as np

        np.add.at(self.squares[0], at, n * n)
        np.add.at(self.squares[1], at, v * v)

    def add(self, at, n, v, mid, to: _Slice) -> None:
        """Products of rows (places of sources, n, v, middle nodes) with those of a slice."""
        import numpy as np
        import pyarrow.compute as pc

        column = self._columns(to.targets)
        where = pc.fill_null(pc.index_in(mid, to.mids), -1).to_numpy(zero_copy_only=False)
        kept = np.flatnonzero(where >= 0)
        kept = kept[np.argsort(where[kept], kind="stable")]  # neighbours meet the same rows of the slice
        first, many = to.bounds[where[kept]], np.diff(to.bounds)[where[kept]]
        ends, i = np.cumsum(many), 0
        while i < len(kept):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PRODUCTS, "right")))
            some = many[i:j]
            x = np.repeat(kept[i:j], some)
            y = np.repeat(first[i:j] - (np.cumsum(some) - some), some) + np.arange(len(x))
            self._add(at[x], column[y], n[x], to.n[y], v[x], to.v[y])
            i = j

    def take_off(self, ends, targets, n, v) -> None:
        """Rows of a relation by their own source, times the squares of this, with a minus."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if self.ends is None:
            return
        at = pc.fill_null(pc.index_in(ends, self.ends), -1).to_numpy(zero_copy_only=False)
        kept = np.flatnonzero(at >= 0)
        if len(kept):
            at = at[kept].astype(np.int64)
            self._add(at, self._columns(targets.take(pa.array(kept))), -self.squares[0][at], n[kept], -self.squares[1][at], v[kept])

    def rows(self, kind, names: list[str], out: int, nonzero: bool) -> Iterator:
        import numpy as np
        import pyarrow as pa

        width, made = self.n.shape[1], self.made.reshape(-1)
        targets = pa.array(list(self.targets), kind)
        for first in range(0, len(made), max(out, 1) * 4):
            some = first + np.flatnonzero(made[first : first + max(out, 1) * 4])
            if nonzero:
                some = some[self.n.reshape(-1)[some] != 0]
            for i in range(0, len(some), out):
                at = some[i : i + out]
                columns = [self.ends.take(pa.array(at // width)), targets.take(pa.array(at % width)), pa.array(self.n.reshape(-1)[at]), pa.array(self.v.reshape(-1)[at])]
                yield pa.RecordBatch.from_arrays(columns, names=names)


def compose(a: DataFrame, b: DataFrame | Packed, rows: tuple[float, float], targets: float, again: DataFrame | None = None, sources: float | None = None, onward: float | None = None) -> DataFrame | Packed:
    """As relation.compose, for a b with few targets. rows: of a and b, about; targets, sources: how many.

    again: a second relation towards the targets, of which products are added. If a has columns n1 and v1, these lead to again by the same middle
    nodes; if not, what is added is again times the sums of squares of a's rows, with a minus: that takes off the ways there and back by the same edge. A pair
    once in b and in again. onward: the rows that the result has, about, if it is the b of another product: it is packed for that where it is made, without pairs of which n is 0.
    """
    own = ["n", "v", "n1", "v1"] if "n1" in a.columns else ["n", "v"]
    more = again is not None
    squares = more and "n1" not in own
    kinds = dict(a.dtypes)["src"], b.kinds[1] if isinstance(b, Packed) else dict(b.dtypes)["dst"]
    wanted = math.ceil(rows[0] / ROWS)
    blocks = max(1, wanted if sources is None else max(min(wanted, BLOCKS), math.ceil(sources * targets / CELLS), math.ceil(rows[0] / BLOCK)))
    slices = _apart(b.slices if isinstance(b, Packed) else slices_of(rows[1]))
    ends = _apart(blocks)
    left = a.where("dst IS NOT NULL").select(F.col("src").alias("end"), F.col("dst").alias("mid"), *own)
    of_a = {f.name: to_arrow_type(f.dataType) for f in left.schema}
    spark = a.sparkSession
    of_b = {"mid": of_a["mid"], "end": _arrow(spark, kinds[1]), "n": _arrow(spark, "long"), "v": _arrow(spark, "double"), "again": _arrow(spark, "boolean")}
    of_beside = {"end": of_a["end"], "to": of_b["end"], "n": of_b["n"], "v": of_b["v"]}
    pieces = _left(left, ends, slices)
    right = b.pieces if isinstance(b, Packed) else _right(b, False, slices)
    if squares:
        beside = again.where("src IS NOT NULL").select(F.col("src").cast(kinds[0]).alias("end"), F.col("dst").alias("to"), "n", "v")
        pieces = pieces.unionAll(_left(beside, ends, None))
    elif more:
        right = right.unionAll(_right(again, True, slices))
    pieces = pieces.unionAll(spark.createDataFrame([(k, PASS, None) for k in ends], "key int, slice int, data binary"))
    leads = [(k, k, None) for k in slices] + [(slices[0], BESIDE, None)] * squares
    # a slice is one row before the stream: all rows of a block are gone through for each row that passes
    right = right.repartition(len(slices), "key").groupBy("key").agg(F.collect_list("data").alias("data"))
    right = right.select("key", F.col("key").alias("to"), "data").unionAll(spark.createDataFrame(leads, "key int, to int, data array<binary>"))
    left = pieces.repartition(len(ends), "key").select("key", "slice", F.col("data").alias("a"))
    right = right.repartition(len(slices), "key").sortWithinPartitions("to").select("to", F.col("data").alias("b"))
    # the slices pass by every block in one stream, each once; another row of each slice, without data, brings the rows of the block that lead to it
    met = F.isnull("b") & (F.col("to") == F.col("slice")) | F.isnotnull("b") & (F.col("slice") == PASS)
    both = right.coalesce(1).join(left.hint("shuffle_replicate_nl"), met).select("key", "to", "a", "b")
    shape, out = (math.ceil(1.1 * (min(sources, rows[0]) if sources is not None else 1) / blocks) + 16, min(math.ceil(targets), TARGETS)), OUT
    names = ["src", "dst", "n", "v"] if onward is None else ["mid", "end", "n", "v"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found, beside, held, last = {}, [], {}, None

        def multiply() -> None:
            for key, (rows, to) in held.items():
                if not rows or not to and not squares:
                    continue
                y = _opened(to, of_b)
                to.clear()
                flag = y.pop("again")
                parts = [(f, _Slice({n: c.filter(f) for n, c in y.items()})) for f in (_inverted(flag), flag) if f.true_count]
                del y
                x = _opened(rows, of_a)
                rows.clear()
                block = found[key] = found.get(key) or _Block(*shape)
                at = block.places(x["end"])
                for f, part in parts:
                    n, v = (x[c].to_numpy(zero_copy_only=False) for c in (("n1", "v1") if f is flag and more and not squares else ("n", "v")))
                    block.add(at, n, v, x["mid"], part)
                if squares:
                    block.square(at, *(x[c].to_numpy(zero_copy_only=False) for c in ("n", "v")))
            held.clear()
            pa.default_memory_pool().release_unused()

        batches = iter(batches)
        while (batch := next(batches, None)) is not None:
            keys, slices_ = batch.column("key").to_pylist(), batch.column("to").to_pylist()
            for i, (key, to) in enumerate(zip(keys, slices_)):
                if to == BESIDE:
                    beside.append((key, batch.column("a")[i].as_py()))
                    continue
                if to != last:
                    multiply()
                    last = to
                rows, passing = held.setdefault(key, ([], []))
                if batch.column("b")[i].is_valid:
                    passing.extend(batch.column("b")[i].as_py())
                else:
                    rows.append(batch.column("a")[i].as_py())
            del batch
        multiply()
        for key, piece in beside:
            if key in found:
                x = _opened([piece], of_beside)
                found[key].take_off(x["end"], x["to"], *(x[c].to_numpy(zero_copy_only=False) for c in ("n", "v")))
        for key in list(found):
            yield from found.pop(key).rows(of_b["end"], names, out, onward is not None)

    if onward is None:
        return both.mapInArrow(run, f"src {kinds[0]}, dst {kinds[1]}, n long, v double")
    then = _apart(slices_of(onward))
    pack = _packer([*names, "again"], [("key", "mid", then)])

    def packed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        yield from pack(x.append_column("again", pa.repeat(pa.scalar(False), x.num_rows)) for x in run(batches))

    return Packed(both.mapInArrow(packed, "key int, data binary"), len(then), kinds)
