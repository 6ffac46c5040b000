"""The schema of a network (metanodes and metaedges) and metapaths over it."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property


@dataclass(frozen=True)
class Step:
    """One metaedge in one direction. `stored` is the abbreviation under which its edges lie, `forward` whether they lie in this direction."""

    source: str
    kind: str
    target: str
    stored: str
    forward: bool
    direction: str = "both"

    @property
    def abbreviation(self) -> str:
        if self.direction == "both":
            return self.source + self.kind + self.target
        return f"{self.source}{self.kind}>{self.target}" if self.forward else f"{self.source}<{self.kind}{self.target}"


@dataclass(frozen=True)
class Metapath:
    steps: tuple[Step, ...]
    back: tuple[Step, ...]

    @property
    def source(self) -> str:
        return self.steps[0].source

    @property
    def target(self) -> str:
        return self.steps[-1].target

    @cached_property
    def metanodes(self) -> tuple[str, ...]:
        return (self.source, *(s.target for s in self.steps))

    @property
    def inverse(self) -> Metapath:
        return Metapath(self.back[::-1], self.steps[::-1])

    @property
    def is_symmetric(self) -> bool:
        return self.steps == self.back[::-1]

    def __len__(self) -> int:
        return len(self.steps)

    def __getitem__(self, where: slice) -> Metapath:
        return Metapath(self.steps[where], self.back[where])

    def __add__(self, other: Metapath) -> Metapath:
        return Metapath(self.steps + other.steps, self.back + other.back)

    def __str__(self) -> str:
        return self.source + "".join(s.abbreviation[len(s.source) :] for s in self.steps)


class Schema:
    """Metanodes by abbreviation and metaedges between them.

    metanodes: {abbreviation: name}. metaedges: (source, kind, target, direction) with abbreviations
    of metanodes; direction is `both`, or `forward` for edges that point from source to target.
    """

    def __init__(self, metanodes: dict[str, str], metaedges: list[tuple[str, str, str, str]]):
        self.metanodes = dict(metanodes)
        self.metaedges: dict[str, Step] = {}
        self._steps: dict[tuple[str, str], Step] = {}
        self._inverse: dict[Step, Step] = {}
        for source, kind, target, direction in metaedges:
            if source not in self.metanodes or target not in self.metanodes:
                raise ValueError(f"metaedge {source}{kind}{target}: unknown metanode")
            if direction not in ("both", "forward"):
                raise ValueError(f"direction {direction!r}")
            arrow = ">" if direction == "forward" else ""
            name = f"{source}{kind}{arrow}{target}"
            there = Step(source, kind, target, name, True, direction)
            again = there if source == target and direction == "both" else Step(target, kind, source, name, False, direction)
            self.metaedges[name] = there
            for step in (there, again):
                self._steps[step.abbreviation] = step
            self._inverse[there], self._inverse[again] = again, there

    def step(self, abbreviation: str) -> Step:
        return self._steps[abbreviation]

    def metapath(self, text: str | Metapath) -> Metapath:
        """Parses an abbreviation such as CpOcP; of metanode abbreviations the longest that fits counts."""
        if isinstance(text, Metapath):
            return text
        steps = next(self._parse(text), None)
        if not steps:
            raise ValueError(f"{text!r} is no metapath of this schema")
        return Metapath(steps, tuple(self._inverse[s] for s in steps))

    def _parse(self, text: str) -> Iterator[tuple[Step, ...]]:
        names = sorted((s for s in self._steps if text.startswith(s)), key=len, reverse=True)
        for name in names:
            step = self._steps[name]
            if name == text:
                yield (step,)
            else:
                for rest in self._parse(text[len(name) - len(step.target) :]):
                    yield (step, *rest)

    def to_json(self) -> str:
        edges = [(s.source, s.kind, s.target, s.direction) for s in self.metaedges.values()]
        return json.dumps({"metanodes": self.metanodes, "metaedges": edges}, indent=1)

    @classmethod
    def from_json(cls, text: str) -> Schema:
        d = json.loads(text)
        return cls(d["metanodes"], [tuple(e) for e in d["metaedges"]])
