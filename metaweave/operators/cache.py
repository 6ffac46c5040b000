"""Results held within a budget of bytes: those of most worth stay, and hits are counted.

Worth is a priority given by name (such as the frequency of a metapath in a workload, see `shapes.segment_frequency`); of equal worth the
result used longest ago goes first. Results lie in the executors' storage, which Spark refills if an executor is lost.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from metaweave.operators import relation as R
from metaweave.operators.network import Network, Pathlike


class Cache:
    """dwpc and dwwc results of a network, by metric, damping and metapath; a metapath and its inverse share one result."""

    def __init__(self, network: Network, budget_bytes: int, priorities: Mapping[str, float] | None = None):
        self.network, self.budget, self.priorities = network, budget_bytes, dict(priorities or {})
        self.counts: Counter = Counter()
        self._held: dict[tuple, tuple[DataFrame, int]] = {}
        self._used: dict[tuple, int] = {}

    def _key(self, metric: str, metapath: Pathlike, damping: float) -> tuple[tuple, bool]:
        """The key under which a result lies, and whether it lies the other way round."""
        path = self.network.schema.metapath(metapath)
        names = sorted((str(path), str(path.inverse)))
        return (metric, float(damping), names[0]), str(path) != names[0]

    def worth(self, key: tuple) -> tuple[float, int]:
        _, _, name = key
        other = str(self.network.schema.metapath(name).inverse)
        return max(self.priorities.get(name, 0.0), self.priorities.get(other, 0.0)), self._used.get(key, 0)

    @property
    def bytes(self) -> int:
        return sum(size for _, size in self._held.values())

    def get(self, metapath: Pathlike, metric: str = "dwpc", damping: float = 0.5) -> DataFrame:
        """The result, held from now on if it is worth more than what would have to go for it."""
        key, turned = self._key(metric, metapath, damping)
        self._used[key] = sum(self.counts.values())
        if key in self._held:
            self.counts["hits"] += 1
            return R.transpose(self._held[key][0]) if turned else self._held[key][0]
        self.counts["misses"] += 1
        result = self._computed(metric, key[2], damping)
        kept = self._offer(key, result)
        return R.transpose(kept) if turned else kept

    def _computed(self, metric: str, name: str, damping: float) -> DataFrame:
        compute: Callable = getattr(self.network, metric)
        return compute(name, damping)

    def _offer(self, key: tuple, result: DataFrame) -> DataFrame:
        if self.budget <= 0:
            return result
        held = result.persist()
        # 40 bytes a row: two ids, a count, a sum and what the storage adds
        size = 40 * held.count()
        gone = []
        for other in sorted(self._held, key=self.worth):
            if self.bytes - sum(self._held[k][1] for k in gone) + size <= self.budget:
                break
            if self.worth(other)[0] > self.worth(key)[0]:
                break
            gone.append(other)
        if self.bytes - sum(self._held[k][1] for k in gone) + size > self.budget:
            held.unpersist()
            return result
        for other in gone:
            self._held.pop(other)[0].unpersist()
            self.counts["evicted"] += 1
        self._held[key] = held, size
        return held

    def clear(self) -> None:
        for held, _ in self._held.values():
            held.unpersist()
        self._held.clear()
