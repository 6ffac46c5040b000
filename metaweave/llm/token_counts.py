"""Token counts by rank-synchronous array merging.

The merges of a BPE model in a sentencepiece file are applied to many pre-tokens at once: all
distinct new pre-tokens of a batch lie in one ragged numpy array of symbols, every round finds each
sequence's lowest-rank pair and merges it, and the surviving symbols are counted (a symbol outside
the vocabulary counts its UTF-8 bytes). Counts of pre-tokens are kept in a bounded table, so each text costs one lookup a word.

Where the rank belongs to one piece and every piece made from that one ranks later, all its places in a sequence are merged in
the round, from the left without overlap; at other ranks (ties) only the leftmost is. Both give the
library's order of merges. A pre-token of over `LONG` characters would need nearly as many rounds as it has characters, so its
pairs wait in a heap by rank and place, which gives the same order.

Pre-tokens start at a space that follows another character. No merge crosses such a place if no
piece has a space after another character, which is checked when the model is read; else a whole
text is one pre-token.

Defined cases: a null or empty text has 0 tokens and 0 bytes; strings of control pieces inside texts are plain text, as the
library has it. Only doc_id and text are read.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from metaweave.llm import common as C

SPACE = "▁"
LIMIT = 4096
#: Pre-tokens whose counts a worker keeps.
KEPT = 300_000
#: Pre-tokens of more characters are merged one by one.
LONG = 512
_NONE = np.int32(2**31 - 1)


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """The fields of a protocol buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[i : i + size]
        i += size


class MergeModel:
    """Merge ranks of a BPE model with byte fallback, as its file has them."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        pieces: dict[str, float] = {}
        self.prefix, normal = True, {}
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                if piece.get(3, 1) in (1, 4):  # normal and user-defined pieces
                    if piece.get(3, 1) == 4:
                        raise ValueError("models with user-defined pieces aren't handled")
                    pieces[piece[1].decode()] = struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0]
            elif field == 2:
                spec = dict(_fields(value))
                if spec.get(3) != 2 or not spec.get(35, 0):
                    raise ValueError("a BPE model with byte fallback is needed")
            elif field == 3:
                normal = dict(_fields(value))
        if normal.get(2) or normal.get(4, 1):
            raise ValueError("the model normalises text or drops spaces, which isn't handled")
        self.prefix = bool(normal.get(3, 1))
        symbols = {c: i for i, c in enumerate(sorted({c for p in pieces for c in p}))}
        ids = dict(symbols)
        for p in pieces:
            ids.setdefault(p, len(ids))
        self.symbols = symbols
        self.cost = np.ones(len(ids), np.int32)
        for c, i in symbols.items():
            if c not in pieces:
                self.cost[i] = len(c.encode())
        order = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        rank = {p: order[s] for p, s in pieces.items()}
        made: dict[int, set[int]] = {}  # ranks -> pieces
        safe = np.ones(len(order), bool)
        keys, ranks, result = [], [], []
        for p, r in rank.items():
            made.setdefault(r, set()).add(ids[p])
            for i in range(1, len(p)):
                a, b = ids.get(p[:i]), ids.get(p[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    ranks.append(r)
                    result.append(ids[p])
                    for part in (p[:i], p[i:]):
                        if len(part) > 1 and rank[part] >= r:
                            safe[rank[part]] = False
        for r, made_of in made.items():
            safe[r] &= len(made_of) == 1
        by = np.argsort(np.array(keys, np.int64))
        self.keys, self.ranks, self.result = (np.array(x)[by] for x in (np.array(keys, np.int64), np.array(ranks, np.int32), np.array(result, np.int32)))
        self.safe = np.append(safe, False)
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        self.known: dict[str, int] = {}
        self.merges: dict[int, tuple[int, int]] = {}

    def count(self, pretokens: list[str]) -> np.ndarray:
        """Symbols that are left of each pre-token (with its spaces as SPACE)."""
        long = [i for i, p in enumerate(pretokens) if len(p) > LONG]
        if long:
            rest = [i for i, p in enumerate(pretokens) if len(p) <= LONG]
            counts = np.zeros(len(pretokens), np.int64)
            counts[rest] = self.count([pretokens[i] for i in rest])
            counts[long] = [self.count_long(pretokens[i]) for i in long]
            return counts
        counts = np.zeros(len(pretokens), np.int64)
        size = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        text = np.frombuffer("".join(pretokens).encode("utf-32-le", "surrogatepass"), np.uint32)
        chars, inverse = np.unique(text, return_inverse=True)
        known = np.array([self.symbols.get(chr(c), -1) for c in chars.tolist()], np.int32)
        bytes_ = np.array([len(chr(c).encode("utf-8", "surrogatepass")) for c in chars.tolist()], np.int32)
        ids = known[inverse] if len(text) else np.zeros(0, np.int32)
        owner = np.repeat(np.arange(len(pretokens)), size)
        lost = ids < 0
        np.add.at(counts, owner[lost], bytes_[inverse[lost]] if len(text) else 0)
        # a character that is in no piece stays; it also keeps its neighbours apart
        while len(ids):
            pair = (ids[:-1].astype(np.int64) << 32) | ids[1:]
            can = (owner[:-1] == owner[1:]) & (ids[:-1] >= 0) & (ids[1:] >= 0)
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            hit = can & (self.keys[at] == pair)
            rank = np.append(np.where(hit, self.ranks[at], _NONE), _NONE)
            new = np.append(True, owner[1:] != owner[:-1])
            starts = np.flatnonzero(new)
            which = np.cumsum(new) - 1
            best = np.minimum.reduceat(rank, starts)
            live = best < _NONE
            over = ~live[which] & (ids >= 0)
            np.add.at(counts, owner[over], self.cost[ids[over]])
            if not live.any():
                break
            place = np.flatnonzero((rank == best[which]) & live[which])
            # of places side by side every second one, from the left; at ranks that aren't safe the sequence's first
            run = np.append(True, np.diff(place) != 1)
            nth = np.arange(len(place)) - np.maximum.accumulate(np.where(run, np.arange(len(place)), 0))
            first = np.append(True, which[place[1:]] != which[place[:-1]])
            place = place[np.where(self.safe[np.minimum(rank[place], len(self.safe) - 1)], nth % 2 == 0, first)]
            ids = ids.copy()
            ids[place] = self.result[at[place]]
            keep = live[which]
            keep[place + 1] = False
            ids, owner = ids[keep], owner[keep]
        return counts

    def count_long(self, text: str) -> int:
        """As count, for one pre-token of any length: in a round nearly all of its symbols would stay as they are, so its pairs wait in a heap instead."""
        if not self.merges:
            self.merges = {k: (r, m) for k, r, m in zip(self.keys.tolist(), self.ranks.tolist(), self.result.tolist())}
        get = self.merges.get
        ids = [self.symbols.get(c, -1) for c in text]
        count = sum(len(c.encode("utf-8", "surrogatepass")) for c, i in zip(text, ids) if i < 0)
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if ids[i] >= 0 and ids[i + 1] >= 0 and (hit := get(ids[i] << 32 | ids[i + 1])):
                heap.append((hit[0], i, ids[i], ids[i + 1], hit[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged since
            ids[i], ids[j] = made, -2
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if ids[k] >= 0 and (hit := get(made << 32 | ids[k])):
                    heapq.heappush(heap, (hit[0], i, made, ids[k], hit[1]))
            k = before[i]
            if k >= 0 and ids[k] >= 0 and (hit := get(ids[k] << 32 | made)):
                heapq.heappush(heap, (hit[0], k, ids[k], made, hit[1]))
        return count + sum(int(self.cost[i]) for i in ids if i >= 0)

    def pretokens(self, text: str) -> list[str]:
        """Pieces that merge on their own. The first space of each is left out."""
        text = text.replace(SPACE, " ")
        if self.prefix:
            text = " " + text
        if not self.cuts or text[0] != " ":
            return ["\0" + text.replace(" ", SPACE)] if not self.cuts else ["\0" + x if i == 0 else x[1:] for i, x in enumerate(re.findall("^[^ ]+| +[^ ]*", text))]
        if "  " in text:
            return [x[1:] for x in re.findall(" +[^ ]*", text)]
        return text[1:].split(" ")

    def counts(self, texts: list[str | None]) -> list[int]:
        split = [self.pretokens(t) if t else [] for t in texts]
        if len(self.known) > KEPT:
            self.known.clear()
        known = self.known
        new = list({p for words in split for p in words if p not in known})
        step = 100_000
        for i in range(0, len(new), step):
            part = new[i : i + step]
            known.update(zip(part, self.count([p[1:] if p[:1] == "\0" and (not self.cuts or not self.prefix) else SPACE + p.replace(" ", SPACE) for p in part]).tolist()))
        get = known.__getitem__
        return [sum(map(get, words)) for words in split]


_models: dict[str, MergeModel] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def model_at(path: str) -> MergeModel:
    if path not in _models:
        _models[path] = MergeModel(path)
    return _models[path]


def count_tokens(docs: DataFrame, model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document. The model's path must hold on every executor."""
    kept = docs.select("doc_id", "text")

    def run(batches):
        merges = model_at(model or default_model())
        for batch in batches:
            data, offsets = C.flat_text(batch.column(1))
            n = []
            for a, b in C.chunks(offsets, 4 << 20):
                n += merges.counts(batch.column(1).slice(a, b - a).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return C.mapped(kept, run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(C.read_table(spark, sf_dir, "documents"))
