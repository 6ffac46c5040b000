"""Shapes of metapaths: classes, segments, and how an exact path count is put together."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

from metaweave.plans.schema import Metapath


@dataclass(frozen=True)
class Stretch:
    """Where a repeated metanode occurs: its places in order."""

    places: tuple[int, ...]

    @property
    def first(self) -> int:
        return self.places[0]

    @property
    def last(self) -> int:
        return self.places[-1]

    def __len__(self) -> int:
        return len(self.places)

    def towards(self, other: Stretch) -> str:
        """How two stretches lie: apart, nested (one inside the other) or crossed."""
        left, right = sorted((self, other), key=lambda s: s.first)
        return "apart" if left.last < right.first else "nested" if right.last < left.last else "crossed"


def stretches(metanodes: Sequence[str]) -> list[Stretch]:
    """The stretches of the metanodes that occur more than once, in order of their first places."""
    places: dict[str, list[int]] = {}
    for i, m in enumerate(metanodes):
        places.setdefault(m, []).append(i)
    return [Stretch(tuple(p)) for p in places.values() if len(p) > 1]


def category(metanodes: Sequence[str]) -> str:
    """The class of a sequence of metanodes, by how the stretches of its repeated ones lie towards each other.

    All apart: no_repeats, short_repeat, four_repeat, long_repeat (one stretch, by length) or disjoint. A nest of pairs around a
    stretch of at most four: BAAB. Two crossed pairs: BABA. Three pairs that aren't nested: repeat_around, where one encloses the others;
    disjoint_groups, where one is apart from the others; interior_complete_group, where two cross and the third is a pair of neighbours. Else: other.
    """
    found = stretches(metanodes)
    lie = Counter(a.towards(b) for a, b in combinations(found, 2))
    if not lie["nested"] and not lie["crossed"]:
        if len(found) != 1:
            return "disjoint" if found else "no_repeats"
        return {2: "short_repeat", 3: "short_repeat", 4: "four_repeat"}.get(len(found[0]), "long_repeat")
    if set(lie) == {"nested"} and len(found[-1]) <= 4 and all(len(s) == 2 for s in found[:-1]):
        return "BAAB"
    if any(len(s) != 2 for s in found):
        return "other"
    if len(found) == 2:
        return "BABA"
    if len(found) == 3:
        towards = [[s.towards(t) for t in found if t is not s] for s in found]
        if towards[0] == ["nested", "nested"] and found[0].last > max(s.last for s in found[1:]):
            return "repeat_around"
        if ["apart", "apart"] in towards:
            return "disjoint_groups"
        if lie["crossed"] and any(s.last == s.first + 1 for s in found):
            return "interior_complete_group"
    return "other"


def _walked(path: Metapath) -> list[Metapath]:
    """A path cut where it goes over from one repeated metanode to another, before and behind the step."""
    word = sorted((i, k) for k, s in enumerate(stretches(path.metanodes)) for i in s.places)
    cuts = {0, len(path)}
    for (i, k), (j, other) in zip(word, word[1:]):
        if k != other:
            cuts |= {i, j}
    at = sorted(cuts | {word[0][0], word[-1][0]})
    return [path[a:b] for a, b in zip(at, at[1:])]


def _opened(tree: Plan) -> list[Metapath]:
    """The operands of a plan, opened as long as they enclose further stretches; products of several groups stay whole."""
    if len(stretches(tree.path.metanodes)) <= 1 and tree.op != "chain":
        return [tree.path]
    grouped = [p for p in tree.parts if stretches(p.path.metanodes)]
    if tree.op in ("around", "triple") or tree.op == "chain" and len(grouped) == 1:
        return [x for p in tree.parts for x in _opened(p)]
    return [tree.path]


def segments(path: Metapath) -> list[Metapath]:
    """The parts of a metapath that are worth keeping for reuse: the operands of its exact plan.

    Of a product of several groups with repeated metanodes these are the groups and what links them; of a single group what its operation
    combines. Where only enumeration is exact, the path is cut where it goes over from one repeated metanode to another. Parts that meet in a
    metanode which isn't repeated are one part.
    """
    tree = plan(path)
    chain = tree.parts if tree.op == "chain" else (tree,)
    grouped = [p for p in chain if stretches(p.path.metanodes)]
    pieces: list[Metapath] = []
    for p in chain:
        if len(grouped) == 1 and p is grouped[0] and p.op in ("quad", "baba"):
            pieces += [x.path for x in p.parts]
        elif len(grouped) == 1 and p is grouped[0] and p.op == "enumerate":
            pieces += _walked(p.path)
        else:
            pieces += _opened(p) if len(grouped) == 1 else [p.path]
    repeated = {path.metanodes[i] for s in stretches(path.metanodes) for i in s.places}
    ends, at = [0], 0
    for piece in pieces:
        at += len(piece)
        if piece.target in repeated or at == len(path):
            ends.append(at)
    return [path[a:b] for a, b in zip(ends, ends[1:])]


def all_segments(path: Metapath) -> Iterator[Metapath]:
    """The metapath, its segments, the segments of these, and so on, each occurrence once."""
    todo = [path]
    while todo:
        part = todo.pop()
        yield part
        inner = segments(part)
        if len(inner) > 1:
            todo += reversed(inner)


def segment_frequency(paths: Sequence[Metapath], both_directions: bool = False) -> Counter:
    """How often each segment occurs in computing these metapaths; a segment and its inverse count as one, as first seen, unless both_directions."""
    names: dict[Metapath, Metapath] = {}
    count: Counter = Counter()
    for path in paths:
        for part in all_segments(path):
            name = names.setdefault(part, part)
            if not both_directions:
                names.setdefault(part.inverse, name)
            count[name] += 1
    return count


@dataclass(frozen=True)
class Plan:
    """An exact plan. op: edge, chain, around, triple, quad, baba or enumerate; parts: the plans it combines."""

    op: str
    path: Metapath
    parts: tuple[Plan, ...] = ()

    def operators(self) -> list[str]:
        return [self.op] + [o for p in self.parts for o in p.operators()]


def plan(path: Metapath) -> Plan:
    """How to count the paths (no node twice) of a metapath exactly.

    A position can be cut if no metanode occurs on both sides of it; the parts between cuts are
    independent and are multiplied. What can't be cut is put together from exact parts by one of
    five templates, and enumerated if none applies.
    """
    nodes, last = path.metanodes, len(path)
    if last == 1:
        return Plan("edge", path)
    cuts = [i for i in range(1, last) if not set(nodes[:i]) & set(nodes[i + 1 :])]
    if cuts:
        at = [0, *cuts, last]
        return Plan("chain", path, tuple(plan(path[a:b]) for a, b in zip(at, at[1:])))
    if nodes[0] == nodes[-1] and nodes[0] not in nodes[1:-1]:
        inner = (plan(path[1:-1]),) if last > 2 else ()
        return Plan("around", path, (Plan("edge", path[:1]), *inner, Plan("edge", path[-1:])))
    ends = (nodes[0], nodes[-1])
    at = [i for i, m in enumerate(nodes) if m in ends]
    word = "".join("A" if nodes[i] == nodes[0] else "B" for i in at)
    inner = [set(nodes[a + 1 : b]) for a, b in zip(at, at[1:])]
    op = {"AAA": "triple", "AAAA": "quad", "ABAB": "baba"}.get(word)
    if op and sum(map(len, inner)) == len(set().union(*inner)):
        return Plan(op, path, tuple(plan(path[a:b]) for a, b in zip(at, at[1:])))
    return Plan("enumerate", path)


def thrice_crossed(path: Metapath) -> tuple[Plan, ...] | None:
    """The plans between the places of three metanodes that occur twice each, in the same order and from end to end (A B C A B C); None for other paths."""
    found = stretches(path.metanodes)
    if len(found) != 3 or any(len(s) != 2 for s in found):
        return None
    at = [s.places[k] for k in (0, 1) for s in found]
    if at != sorted(at) or (at[0], at[-1]) != (0, len(path)):
        return None
    return tuple(plan(path[a:b]) for a, b in zip(at, at[1:]))


def there_again(tree: Plan) -> tuple[tuple[Plan, ...], Plan, tuple[Plan, ...]] | None:
    """Of a path that takes one metaedge there, back and there again: the plans before it, that of the metaedge, and the plans after it, of which there is one at least; None for other paths."""
    if tree.op != "chain":
        return None
    at = [i for i, p in enumerate(tree.parts) if p.op == "baba"]
    if len(at) != 1 or at[0] + 1 == len(tree.parts):
        return None
    x, y, z = tree.parts[at[0]].parts
    if x.op != "edge" or y.path != x.path.inverse or z.path != x.path:
        return None
    return tree.parts[: at[0]], x, tree.parts[at[0] + 1 :]


def cheapest_order(sizes: Sequence[tuple[float, float, float]]) -> tuple:
    """The order of multiplying relations in a row that makes the fewest intermediate rows, as nested pairs of indices.

    sizes: of each relation its rows and its numbers of source and target nodes. A product of a
    and b takes rows(a) * rows(b) / nodes between; no more rows come of it than there are pairs of nodes.
    """
    n = len(sizes)
    best = {(i, i + 1): (0.0, sizes[i][0], i) for i in range(n)}
    for width in range(2, n + 1):
        for a in range(n - width + 1):
            b = a + width
            found = None
            for m in range(a + 1, b):
                left, right = best[a, m], best[m, b]
                made = left[1] * right[1] / max(1.0, sizes[m][1])
                cost = left[0] + right[0] + made
                if found is None or cost < found[0]:
                    found = (cost, min(made, sizes[a][1] * sizes[b - 1][2]), (left[2], right[2]))
            best[a, b] = found
    return best[0, n][2]
