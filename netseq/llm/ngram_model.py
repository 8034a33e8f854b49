"""Language-model scores from an n-gram trie in Elias-Fano form.

Tokens are the words of a text and one end. Level 1 of the trie holds the words' hashes; a node of level k is a
context of k-1 words followed by a word, with the key (context's node, place of the word among the followers of
the context without its first word). Keys ascend, so a level is one Elias-Fano sequence whose upper bits are the
monotone pointers from a context to its followers, and a look-up is a successor search below the context. Each
node carries its smoothed probability and each context its back-off weight, both quantised to 16 bits.

Spark counts the n-grams: tasks send sorted runs of keys to shards cut by exact counts of the level above, where
they are merged. Every shard of a level is one file in the shared folder, which must be mounted on all executors;
workers map the files, so the model takes no heap. Nothing is left out of the counts.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netseq.llm.common import whole_text
from netseq.llm.eliasfano import U64, EliasFano, load, save
from netseq.session import stage, staging_path

ORDER = 3
PRIOR = 0.1  # added to each word's count
HELD_OUT_OF = 10

TOKENS = 1 << 20  # looked up at once
GROUP_BYTES = 2 << 20  # of texts hashed at once
HELD_KEYS = 1 << 21  # distinct keys a task gathers before it sends them
SHARD_BYTES = 8 << 20  # of text for a shard of level 1
SHARD_TOKENS = 1 << 21  # for a shard of a higher level
STEP = 4000  # quantised values for a power of ten
NONE = 65535

_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), 32]] = True
_SPACES = [bytes([b]) for b in (*range(9, 14), 32)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 64-bit numbers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mixed(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
END = int(mixed(np.array([0x656E64], U64))[0])


@lru_cache(maxsize=1)
def _places(n: int) -> np.ndarray:
    return mixed(np.arange(n, dtype=U64) + U64(0x51ED270B5F0C3A27)) | U64(1)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word, letters A-Z lower-cased. Words are the same to the model if their
    64-bit hashes are: among v words, v * v / 2**65 pairs are expected to share one."""
    a = np.frombuffer(raw, np.uint8)
    solid = ~_SPACE[a]
    edge = np.flatnonzero(np.diff(solid.astype(np.int8), prepend=0, append=0))
    first, sizes = edge[::2], edge[1::2] - edge[::2]
    if not len(first):
        return np.zeros(0, U64), first
    at = np.flatnonzero(solid)
    place = at - np.repeat(first, sizes)
    most = 1 << int(sizes.max()).bit_length()
    each = _BYTE[a[at]] * _places(max(most, 64))[place]
    return mixed(np.add.reduceat(each, np.cumsum(sizes) - sizes) + sizes.astype(U64)), first


def segments(raw: bytes, size: int = GROUP_BYTES) -> Iterator[bytes]:
    """A long text in parts, cut behind white space."""
    at = 0
    while len(raw) - at > size:
        cut = max(raw.rfind(s, at, at + size) for s in _SPACES)
        if cut < 0:
            cut = min((c for s in _SPACES if (c := raw.find(s, at + size)) >= 0), default=len(raw) - 1)
        yield raw[at : cut + 1]
        at = cut + 1
    yield raw[at:]


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts, each followed by the end, and their number per text."""
    if len(texts) == 1:
        parts = [word_hashes(s)[0] for s in segments(texts[0])]
        hashes, counts = np.concatenate(parts), np.array([sum(map(len, parts))])
    else:
        hashes, first = word_hashes(b"\n".join(texts))
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        counts = np.diff(np.searchsorted(first, begins))
    return np.insert(hashes, np.cumsum(counts), U64(END)), counts + 1


def groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Stretches of neighbours whose sizes sum to at most ``most``; a larger one stands alone."""
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if i > first and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if len(sizes) > first:
        yield first, len(sizes)


def coded(x: np.ndarray) -> bytes:
    return np.int64(x.nbytes).tobytes() + pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)


def decoded(raw: bytes, kind=U64) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True), kind)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs of (keys, counts) as one run."""
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Gathered:
    """Counts of keys, handed on as sorted runs per shard once there are many."""

    def __init__(self, cuts: np.ndarray):
        self.cuts, self.parts, self.size = cuts, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        found, counts = np.unique(keys, return_counts=True)
        self.parts.append((found, counts.astype(U64)))
        self.size += len(found)
        if self.size >= HELD_KEYS:
            self.parts = [merged(self.parts)]
            self.size = len(self.parts[0][0])
            if self.size >= HELD_KEYS // 2:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            keys, counts = merged(self.parts)
            edges = [0, *np.searchsorted(keys, self.cuts), len(keys)]
            rows = [(s, a, b) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if a < b]
            runs = [coded(np.diff(keys[a:b], prepend=U64(0))) for _, a, b in rows]
            sums = [coded(counts[a:b]) for _, a, b in rows]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in rows], pa.int32()), pa.array(runs, pa.binary()), pa.array(sums, pa.binary())], names=["shard", "keys", "counts"])
        self.parts, self.size = [], 0


@dataclass(frozen=True)
class Level:
    """Where the files of a level lie. ``begins`` are the first keys of the shards, ``offsets`` their first nodes."""

    folder: str
    number: int
    bits: int
    size: int
    widest: int  # most followers of one context
    shards: tuple[int, ...] = ()
    begins: tuple[int, ...] = ()
    offsets: tuple[int, ...] = ()

    def path(self, shard: int, kind: str) -> str:
        return f"{self.folder}/{self.number}-{shard:06d}.{kind}"


class Opened:
    """A level mapped by a worker."""

    def __init__(self, level: Level):
        self.level = level
        self.begins, self.offsets = np.array(level.begins, U64), np.array(level.offsets, np.int64)
        self.maps: dict[tuple[int, str], dict] = {}
        self.keys: dict[int, EliasFano] = {}

    def arrays(self, i: int, kind: str) -> dict[str, np.ndarray]:
        if (i, kind) not in self.maps:
            self.maps[i, kind] = load(self.level.path(self.level.shards[i], kind))
        return self.maps[i, kind]

    def sequence(self, i: int) -> EliasFano:
        if i not in self.keys:
            self.keys[i] = EliasFano.of(self.arrays(i, "keys"))
        return self.keys[i]

    def _by_shard(self, where: np.ndarray) -> Iterator[tuple[int, slice]]:
        """Stretches of ascending shard numbers."""
        cuts = np.flatnonzero(np.diff(where)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(where)]):
            if a < b:
                yield int(where[a]), slice(a, b)

    def _search(self, keys: np.ndarray, exact: bool) -> np.ndarray:
        out = np.full(len(keys), -1 if exact else 0, np.int64)
        for i, part in self._by_shard(np.searchsorted(self.begins, keys, "right") - 1):
            if i >= 0:
                own = self.sequence(i)
                at = own.find(keys[part]) if exact else own.successor(keys[part])
                out[part] = np.where(at >= 0, at + self.offsets[i], -1)
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Nodes of ascending keys, -1 where there is none."""
        return self._search(keys, True)

    def followers(self, contexts: np.ndarray) -> np.ndarray:
        """First node below each context, fastest if they ascend."""
        ascend = (contexts[1:] >= contexts[:-1]).all()
        distinct, back = runs(contexts) if ascend else np.unique(contexts, return_inverse=True)
        return self._search(distinct.astype(U64) << U64(self.level.bits), False)[back]

    def values(self, nodes: np.ndarray, kind: str, name: str) -> np.ndarray:
        """What the file ``kind`` holds under ``name`` for nodes, fastest if they ascend."""
        ascend = (nodes[1:] >= nodes[:-1]).all()
        distinct, back = (nodes, slice(None)) if ascend else np.unique(nodes, return_inverse=True)
        out = None
        for i, part in self._by_shard(np.searchsorted(self.offsets, distinct, "right") - 1):
            found = self.arrays(i, kind)[name][distinct[part] - self.offsets[i]]
            out = np.zeros(len(distinct), found.dtype) if out is None else out
            out[part] = found
        return np.zeros(0) if out is None else out[back]

    def access(self, nodes: np.ndarray) -> np.ndarray:
        """Keys of ascending nodes."""
        out = np.zeros(len(nodes), U64)
        for i, part in self._by_shard(np.searchsorted(self.offsets, nodes, "right") - 1):
            out[part] = self.sequence(i).access(nodes[part] - self.offsets[i])
        return out

    def weights(self, contexts: np.ndarray) -> np.ndarray:
        """Logarithms of the back-off weights of ascending contexts; 0 for those without followers."""
        distinct, back = runs(contexts)
        out = np.zeros(len(distinct))
        last = ((distinct + 1).astype(U64) << U64(self.level.bits)) - U64(1)
        for i, part in self._by_shard(np.searchsorted(self.begins, last, "right") - 1):
            if i >= 0:
                told = self.arrays(i, "model")
                at = distinct[part] - int(told["first"][0])
                inside = (at >= 0) & (at < len(told["weight"]))
                code = np.full(len(at), NONE)
                code[inside] = told["weight"][at[inside]]
                out[part] = np.where(code == NONE, 0.0, code / -STEP)
        return out[back]


def runs(ascending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of an ascending array, and where each element's value is among them."""
    first = np.concatenate([[True], ascending[1:] != ascending[:-1]]) if len(ascending) else np.zeros(0, bool)
    return ascending[first], np.cumsum(first) - 1


@lru_cache(maxsize=8)
def opened(level: Level) -> Opened:
    """One per worker process and level."""
    return Opened(level)


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(np.log10(p) * -STEP), 0, NONE - 1).astype(np.uint16)


@dataclass
class Trie:
    """A trained model: its levels and the totals of the training tokens."""

    levels: list[Level] = field(default_factory=list)
    tokens: int = 0
    distinct: int = 0

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts.astype(np.float64) + PRIOR) / (self.tokens + PRIOR * (self.distinct + 1))

    def suffix(self, k: int, nodes: np.ndarray) -> np.ndarray:
        """Per ascending node of level k the node of level k-1 without its first word."""
        own = opened(self.levels[k - 1])
        keys = own.access(nodes)
        place = (keys & U64((1 << own.level.bits) - 1)).astype(np.int64)
        if k == 2:
            return place
        contexts, back = np.unique((keys >> U64(own.level.bits)).astype(np.int64), return_inverse=True)
        return opened(self.levels[k - 2]).followers(self.suffix(k - 1, contexts))[back] + place


class Walk:
    """Follows tokens through the levels, in slices; remembers where the last slice ended.

    For each level a slice's keys are sorted once; what the level tells of a key is looked up in that order.
    """

    def __init__(self, trie: Trie, start: int):
        self.trie, self.start = trie, start
        self.last = [start] + [-1] * len(trie.levels)

    def _before(self, k: int, nodes: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The node of level k at the token before, -1 where the text begins or has none there."""
        out = np.empty_like(nodes)
        out[1:], out[0] = nodes[:-1], self.last[k - 1]
        out[begin] = self.start if k == 1 else -1
        self.last[k - 1] = int(nodes[-1])
        return out

    def keys(self, k: int, nodes: np.ndarray, places: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which tokens have a context of level k-1, their keys) from the tokens' nodes of level k-1. A token that
        does not follow the shorter context gets a key that is never stored."""
        contexts = self._before(k - 1, nodes, begin)
        there = contexts >= 0
        bits = _bits(self.trie, k)
        places = np.where(nodes >= 0, places, (1 << bits) - 1)
        return there, (contexts[there].astype(U64) << U64(bits)) | places[there].astype(U64)

    def step(self, k: int, nodes: np.ndarray, places: np.ndarray, begin: np.ndarray, last: bool = False) -> tuple:
        """(which tokens, ascending keys, their nodes, each token's key, nodes of level k, places below them); the two
        latter lead on, and are not worked out at the last level."""
        there, keys = self.keys(k, nodes, places, begin)
        distinct, back = np.unique(keys, return_inverse=True)
        own = opened(self.trie.levels[k - 1])
        found = own.find(distinct)
        nodes, places = np.full(len(nodes), -1, np.int64), np.zeros(len(nodes), np.int64)
        if not last:
            place = found - own.followers((distinct >> U64(own.level.bits)).astype(np.int64))
            nodes[there], places[there] = found[back], place[back]
        return there, distinct, found, back, nodes, places


def _bits(trie: Trie, k: int) -> int:
    """Bits for the place of a follower in the keys of level k."""
    bits = (trie.levels[0].size + 1 if k == 2 else trie.levels[k - 2].widest).bit_length()
    if trie.levels[k - 2].size << bits >= 1 << 63:
        raise ValueError(f"keys of level {k} need more than 63 bits")
    return bits


def _mounted(path: str) -> str:
    told = urlparse(path)
    if told.scheme not in ("", "file"):
        raise RuntimeError(f"the model's levels are mapped: {path} must be a folder mounted on all executors")
    os.makedirs(told.path, exist_ok=True)
    return told.path


_RUNS = "shard int, keys binary, counts binary"
_TOLD = (
    "shard int, n long, total long, once long, twice long, widest long, begin long, first long, first_sum long, first_n long, "
    "last long, last_sum long, last_n long, counts binary"
)


def _merge(runs: DataFrame, n_shards: int, folder: str, number: int, bits: int) -> DataFrame:
    """Merge the runs of each shard, write its keys to a file, and return its counts and their sums."""

    def told(shard: int, parts: list) -> pa.RecordBatch:
        keys, counts = merged(parts)
        arrays = EliasFano.build(keys).arrays() | ({"count": counts} if number == 1 else {})
        save(Level(folder, number, bits, 0, 0).path(shard, "keys"), arrays)
        contexts = keys >> U64(bits) if number > 1 else np.zeros(len(keys), U64)
        at = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]]))
        sums, ns = np.add.reduceat(counts, at), np.diff(at, append=len(keys))
        row = [shard, len(keys), counts.sum(), (counts == 1).sum(), (counts == 2).sum(), ns.max(), keys[:1].view(np.int64)[0]]
        row += [contexts[0], sums[0], ns[0], contexts[-1], sums[-1], ns[-1]]
        return pa.RecordBatch.from_pylist([dict(zip(_names, [*map(int, row), coded(counts)]))], schema=_arrow)

    _names = [c.split()[0] for c in _TOLD.split(", ")]
    _arrow = pa.schema([(n, pa.int32() if n == "shard" else pa.binary() if n == "counts" else pa.int64()) for n in _names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, size = None, [], 0
        for batch in batches:
            for s, keys, counts in zip(*(batch.column(i) for i in range(3))):
                if s.as_py() != shard:
                    if parts:
                        yield told(shard, parts)
                    shard, parts, size = s.as_py(), [], 0
                parts.append((np.cumsum(decoded(keys.as_py())), decoded(counts.as_py())))
                size += len(parts[-1][0])
                if size > 2 * HELD_KEYS:
                    parts = [merged(parts)]
                    size = len(parts[0][0]) // 2
        if parts:
            yield told(shard, parts)

    by_shard = runs.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard")
    return stage(by_shard.mapInArrow(run, _TOLD), f"ngram-{number}")


def _opened_level(rows: list, folder: str, number: int, bits: int) -> Level:
    """The level over the shards that Spark has merged; one row a shard reaches the driver."""
    widest: dict[int, int] = {}
    for r in rows:
        for p, n in {r["first"]: r["first_n"], r["last"]: r["last_n"]}.items():
            widest[p] = widest.get(p, 0) + n
    most = max([r["widest"] for r in rows] + list(widest.values()), default=0)
    offsets = np.cumsum([0] + [r["n"] for r in rows]).tolist()
    begins = [r["begin"] % (1 << 64) for r in rows]
    return Level(folder, number, bits, offsets[-1], most, tuple(r["shard"] for r in rows), tuple(begins), tuple(offsets[:-1]))


def _smooth(trie: Trie, table: DataFrame, rows: list) -> None:
    """Write the quantised probabilities and back-off weights of the last level.

    Absolute discounting, interpolated with the level above: the discount comes from the counts of n-grams
    seen once and twice.
    """
    level, k = trie.levels[-1], trie.levels[-1].number
    once, twice = sum(r["once"] for r in rows), sum(r["twice"] for r in rows)
    discount = min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5
    edges: dict[int, list[int]] = {}  # contexts that shards share
    for r in rows:
        for p, s, n in {(r["first"], r["first_sum"], r["first_n"]), (r["last"], r["last_sum"], r["last_n"])}:
            edges.setdefault(p, [0, 0])
            edges[p][0] += s
            edges[p][1] += n
    edges = {r["shard"]: {p: edges[p] for p in (r["first"], r["last"])} for r in rows}
    where = {s: i for i, s in enumerate(level.shards)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, c in zip(batch.column(0), batch.column(1)):
                shard, counts = s.as_py(), decoded(c.as_py()).astype(np.float64)
                keys = opened(level).sequence(where[shard]).keys()
                contexts, back = np.unique(keys >> U64(level.bits), return_inverse=True)
                contexts = contexts.astype(np.int64)
                sums, ns = np.bincount(back, counts), np.bincount(back).astype(np.float64)
                for p, (total, n) in edges[shard].items():
                    i = np.searchsorted(contexts, p)
                    sums[i], ns[i] = total, n
                place = (keys & U64((1 << level.bits) - 1)).astype(np.int64)
                above = opened(trie.levels[k - 2])
                lower = np.empty(len(keys))
                first = above.followers(trie.suffix(k - 1, contexts))[back] if k > 2 else np.zeros(len(keys), np.int64)
                for a in range(0, len(keys), TOKENS):
                    part = slice(a, a + TOKENS)
                    if k == 2:
                        lower[part] = trie.unigram(above.values(place[part], "keys", "count"))
                    else:
                        lower[part] = 10.0 ** (above.values(first[part] + place[part], "model", "logp") / -STEP)
                weight = discount * ns / sums
                logp = quantised(np.maximum(counts - discount, 0) / sums[back] + weight[back] * lower)
                dense = np.full(contexts[-1] - contexts[0] + 1, NONE, np.uint16)
                dense[contexts - contexts[0]] = quantised(weight)
                save(level.path(shard, "model"), {"logp": logp, "weight": dense, "first": contexts[:1]})
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32())], names=["shard"])

    table.select("shard", "counts").mapInArrow(run, "shard int").collect()  # numbers of shards


def _cuts(trie: Trie, table: DataFrame, rows: list, bits: int) -> np.ndarray:
    """Keys of the next level at which its shards begin, so that each gets equally many tokens.

    Tokens below a node are its own count; a node with more than one share is cut evenly among its followers.
    """
    level, k = trie.levels[-1], trie.levels[-1].number
    sums = np.cumsum([0] + [r["total"] for r in rows]).tolist()
    before, where = {r["shard"]: s for r, s in zip(rows, sums)}, {s: i for i, s in enumerate(level.shards)}
    share = max(SHARD_TOKENS, sums[-1] >> 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, c in zip(batch.column(0), batch.column(1)):
                shard, counts = s.as_py(), decoded(c.as_py()).astype(np.int64)
                upto = np.cumsum(counts) + before[shard]
                wanted = np.arange(before[shard] // share + 1, upto[-1] // share + 1) * share
                at = np.minimum(np.searchsorted(upto, wanted), len(upto) - 1)
                nodes = at + level.offsets[where[shard]]
                part = (wanted - (upto[at] - counts[at])) / counts[at]
                if k == 1:
                    width = np.full(len(nodes), level.size)
                else:
                    distinct, back = np.unique(nodes, return_inverse=True)
                    shorter = trie.suffix(k, distinct)
                    own = opened(level)
                    width = (own.followers(shorter + 1) - own.followers(shorter))[back]
                    width = np.maximum(width, 1)
                place = np.minimum((part * width).astype(np.int64), width - 1)
                keys = (nodes.astype(U64) << U64(bits)) | place.astype(U64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["key"])

    found = table.select("shard", "counts").mapInArrow(run, "key long").collect()  # at most 65,536
    return np.unique(np.array([r["key"] for r in found], np.int64).view(U64))


def _ids_of(batch: pa.RecordBatch, kind: str, wanted: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, begin, document of the batch) in slices of bounded length."""
    column = batch.column("ids")
    sizes = [len(column[i].as_buffer()) for i in wanted]
    for a, b in groups(sizes, TOKENS * 4):
        raw = [np.frombuffer(column[i].as_buffer(), kind) for i in wanted[a:b]]
        ids, lengths = np.concatenate(raw), [len(x) for x in raw]
        doc = np.repeat(np.array(wanted[a:b]), lengths)
        begin = np.zeros(len(ids), bool)
        begin[np.cumsum([0, *lengths[:-1]])] = True
        for at in range(0, len(ids), TOKENS):
            yield ids[at : at + TOKENS], begin[at : at + TOKENS], doc[at : at + TOKENS]


@dataclass
class Trained:
    trie: Trie
    ids: DataFrame
    kind: str
    end: int


def train(docs: DataFrame, held_out: Column | None = None, key: str = "doc_id", text: str = "text", order: int = ORDER) -> Trained:
    """Count the n-grams of all texts that are not held out, build the trie, and number the words of all texts.

    ``held_out`` defaults to crc32(key as text) mod 10 = 0; a null key counts as empty text. Null and empty texts
    are one end. Without training texts the trie is empty.
    """
    if order < 2:
        raise ValueError("order must be at least 2")
    spark = docs.sparkSession
    held = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % HELD_OUT_OF == 0 if held_out is None else held_out
    slim = docs.select(F.col(key).alias("key"), held.alias("held"), whole_text(text).cast("binary").alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder = _mounted(staging_path(spark, "ngram-trie"))
    n_shards = min(max(size // SHARD_BYTES, 1), 1 << 16)
    cuts = np.arange(1, n_shards, dtype=U64) * U64(((1 << 64) - 1) // n_shards)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Gathered(cuts)
        for batch in batches:
            texts = [t.as_py() for t, h in zip(batch.column("text"), batch.column("held")) if not h.as_py()]
            for a, b in groups([len(t) for t in texts], GROUP_BYTES):
                yield from found.add(hashed(texts[a:b])[0])
        yield from found.rest()

    table = _merge(slim.mapInArrow(count, _RUNS), n_shards, folder, 1, 0)
    rows = sorted(table.drop("counts").collect(), key=lambda r: r["shard"])  # a row a shard
    trie = Trie([_opened_level(rows, folder, 1, 0)], sum(r["total"] for r in rows), sum(r["n"] for r in rows))
    kind = "<u4" if trie.distinct < (1 << 32) - 1 else "<u8"
    ids = _numbered(slim, trie, kind)
    end = int(Opened(trie.levels[0]).find(np.array([END], U64))[0]) if rows else 0
    for k in range(2, order + 1):
        if not rows:
            break
        bits = _bits(trie, k)
        cuts_k = _cuts(trie, table, rows, bits)

        def gather(batches: Iterator[pa.RecordBatch], k=k, cuts_k=cuts_k) -> Iterator[pa.RecordBatch]:
            found, walk = Gathered(cuts_k), Walk(trie, end)
            for batch in batches:
                wanted = [i for i, h in enumerate(batch.column("held")) if not h.as_py()]
                for part, begin, _ in _ids_of(batch, kind, wanted):
                    nodes = places = part.astype(np.int64)
                    for j in range(2, k):
                        *_, nodes, places = walk.step(j, nodes, places, begin)
                    yield from found.add(walk.keys(k, nodes, places, begin)[1])
            yield from found.rest()

        table = _merge(ids.select("held", "ids").mapInArrow(gather, _RUNS), len(cuts_k) + 1, folder, k, bits)
        rows = sorted(table.drop("counts").collect(), key=lambda r: r["shard"])
        if rows:
            trie = Trie([*trie.levels, _opened_level(rows, folder, k, bits)], trie.tokens, trie.distinct)
            _smooth(trie, table, rows)
    return Trained(trie, ids, kind, end)


def _numbered(slim: DataFrame, trie: Trie, kind: str) -> DataFrame:
    """Staged table (key, held, n_tokens, n_known, base_score, ids): words as nodes of level 1, unknown ones as
    the number after the last."""
    spark, level = slim.sparkSession, trie.levels[0]
    schema = f"key {slim.schema['key'].dataType.simpleString()}, held boolean, n_tokens long, n_known long, base_score double, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = opened(level)
        for batch in batches:
            texts = batch.column("text")
            for a, b in groups([len(t.as_buffer()) for t in texts], GROUP_BYTES):
                hashes, lengths = hashed([t.as_py() for t in texts[a : b]])
                distinct, back = np.unique(hashes, return_inverse=True)
                nodes = known._search(distinct, True)
                counts = np.zeros(len(distinct), U64)
                if (nodes >= 0).any():
                    counts[nodes >= 0] = known.values(nodes[nodes >= 0], "keys", "count")
                first = np.cumsum(lengths) - lengths
                ids = np.where(nodes >= 0, nodes, level.size).astype(kind)[back]
                scores = np.add.reduceat(np.log10(trie.unigram(counts))[back], first)
                n_known = np.add.reduceat((nodes >= 0).astype(np.int64)[back], first)
                raw = [ids[i : i + n].tobytes() for i, n in zip(first, lengths)]
                columns = [batch.column("key").slice(a, b - a), batch.column("held").slice(a, b - a), pa.array(lengths, pa.int64())]
                columns += [pa.array(n_known, pa.int64()), pa.array(scores), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "held", "n_tokens", "n_known", "base_score", "ids"])

    place = staging_path(spark, "ngram-ids")
    slim.mapInArrow(run, schema).write.option("compression", "zstd").parquet(place)
    return spark.read.schema(schema).parquet(place)


def scores(model: Trained) -> DataFrame:
    """(key, held, n_tokens, n_known, base_score, score) of every text the model has numbered; the score is the
    log10 probability of its words and its end."""
    trie, kind, end = model.trie, model.kind, model.end
    told = ["key", "held", "n_tokens", "n_known", "base_score"]
    schema = ", ".join(f"{c} {model.ids.schema[c].dataType.simpleString()}" for c in told) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, walk = np.zeros(batch.num_rows), Walk(trie, end)
            for ids, begin, doc in _ids_of(batch, kind, list(range(batch.num_rows))):
                total += np.bincount(doc, _token_scores(trie, walk, ids, begin), batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in told), pa.array(total)], names=[*told, "score"])

    return model.ids.select(*told, "ids").mapInArrow(run, schema)


def _unigrams(trie: Trie, words: np.ndarray) -> np.ndarray:
    """log10 probabilities of words by themselves, unknown ones included."""
    counts, known = np.zeros(len(words), U64), words < trie.distinct
    if known.any():
        counts[known] = opened(trie.levels[0]).values(words[known], "keys", "count")
    return np.log10(trie.unigram(counts))


def _token_scores(trie: Trie, walk: Walk, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """log10 probability of each token after those before it."""
    nodes = places = ids.astype(np.int64)
    if len(trie.levels) < 2:
        return _unigrams(trie, nodes)
    out = np.zeros(len(ids))
    for k in range(2, len(trie.levels) + 1):
        own = opened(trie.levels[k - 1])
        there, keys, found, back, nodes, places = walk.step(k, nodes, places, begin, k == len(trie.levels))
        seen = found >= 0
        # A key stands for one word after one context, so the back-off is worked out per key for words alone.
        value = own.weights((keys >> U64(own.level.bits)).astype(np.int64))
        if k == 2:
            value[~seen] += _unigrams(trie, (keys[~seen] & U64((1 << own.level.bits) - 1)).astype(np.int64))
            lower = np.zeros(len(back))
        else:
            lower = np.where(seen[back], 0.0, out[there])
        if seen.any():
            value[seen] = own.values(found[seen], "model", "logp") / -STEP
        out[there] = value[back] + lower
    return out


def score(docs: DataFrame, held_out: Column | None = None, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """Per row of ``docs``: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows that are not held out (see ``train``) and scores all. Null and empty texts are one end;
    repeated rows and null keys are documents like any other; other columns play no part; an empty table gives
    no rows. Without training texts both scores are 0.
    """
    model = train(docs, held_out, key, text, order)
    return scores(model).select(
        F.col("key").alias(key), F.col("held").alias("held_out"), "n_tokens", "n_known",
        F.lit(model.trie.tokens).cast("bigint").alias("train_tokens"), "base_score", "score",
    )
