"""Secret scans: named patterns, and random strings found by how badly they tokenize.

Prose needs few tokens for its characters; keys and passwords need many. A run of key characters is reported
as random when its characters per token fall below a ratio, unless it is a known digest or identifier. Of a run
that is readable on the whole, the stretches of parts between separators are reported whose own ratio is low.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netseq.llm.tokens import BYTE_LEVEL_PATTERN

# Kinds in the order in which they are listed at one place.
KINDS = ("assign", "access", "hex", "random")
BASE = KINDS[:3]

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_LENGTH = 6
# Runs are matched whole, so a least length in the pattern equals dropping shorter ones.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

CANDIDATE_LENGTH = 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{CANDIDATE_LENGTH},}}")
LETTER = re.compile(r"[A-Za-z]")
UUID = r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
PART = re.compile(rf"{UUID}(?![A-Za-z0-9])|[A-Za-z0-9]+")
# Digests by their lengths in hexadecimal, UUIDs, and the alphabet.
KNOWN = re.compile(
    r"[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"
    r"|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128}"
    rf"|{UUID}|abcdefghijklmnopqrstuvwxyz|ABCDEFGHIJKLMNOPQRSTUVWXYZ"
)
# Parts of identifiers that need not tokenize well: abbreviations, and a short word in one case beside a number.
SHORT = re.compile(
    r"[a-z]{1,3}|[A-Z]{1,3}|[A-Z][a-z]{1,2}|(?:[a-z]{1,12}|[A-Z]{1,12}|[A-Z][a-z]{1,11})?[0-9]+(?:[a-z]{1,4}|[A-Z]{1,4})?"
)

# Characters per token below which a candidate counts as random.
RATIO = 2.0

# A run is tokenized in slices of this many characters, as merging one piece costs more than its length.
SLICE = 2048

MASK = "[SECRET]"


@lru_cache(maxsize=2)
def _encoding(path: str):
    """Byte-level encoding of a rank file, one per worker process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(run: str, path: str) -> int:
    encode = _encoding(path).encode_ordinary
    return sum(len(encode(run[i : i + SLICE])) for i in range(0, len(run), SLICE))


def readable(part: str, path: str, ratio: float = RATIO) -> bool:
    """Part of an identifier: a word that tokenizes well, an abbreviation or a number with a short word."""
    return bool(SHORT.fullmatch(part)) or (part.isalpha() and len(part) >= ratio * n_tokens(part, path))


def looks_random(run: str, path: str, ratio: float = RATIO) -> bool:
    """Not without letters, no known shape, fewer characters per token than ``ratio``, and some part not readable."""
    if not LETTER.search(run) or KNOWN.fullmatch(run) or len(run) >= ratio * n_tokens(run, path):
        return False
    return not all(readable(p, path, ratio) for p in PART.findall(run))


def highest(scores: list[float]) -> list[tuple[int, int]]:
    """All maximal stretches of highest sum (Ruzzo and Tompa), as disjoint (first, end); time is linear."""
    kept: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum after, place of the next lower sum before
    total = 0.0
    for i, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        first, at = i, len(kept) - 1
        while True:
            while at >= 0 and kept[at][2] >= before:
                at = kept[at][4]
            if at < 0 or kept[at][3] >= total:
                break
            first, _, before, _, lower = kept[at]
            del kept[at:]
            at = lower
        kept.append((first, i + 1, before, total, at))
    return [k[:2] for k in kept]


def random_stretches(run: str, path: str, ratio: float = RATIO) -> list[tuple[int, int]]:
    """(start, end) of what looks random in a run: all of it, or stretches of its parts and of what these leave."""

    def score(part: str) -> float:
        if KNOWN.fullmatch(part):
            return -ratio * len(run) - 1  # no stretch reaches over it
        own = ratio * n_tokens(part, path) - len(part)
        return min(own, 0) if readable(part, path, ratio) else own

    found, left = [], [(0, len(run))]
    while left:
        start, end = left.pop()
        if end - start < CANDIDATE_LENGTH:
            continue
        if looks_random(run[start:end], path, ratio):
            found.append((start, end))
            continue
        parts = [m.span() for m in PART.finditer(run, start, end)]
        at = start
        for a, b in highest([score(run[i:j]) for i, j in parts]):
            i, j = parts[a][0], parts[b - 1][1]
            if j - i >= CANDIDATE_LENGTH and (i, j) != (start, end) and looks_random(run[i:j], path, ratio):
                found.append((i, j))
                left.append((at, i))
                at = j
        if at > start:
            left.append((at, end))
    return found


def spans(text: str, path: str, ratio: float = RATIO) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind; ends are exclusive.

    Random stretches lie outside the base spans; what a base span leaves of a run is a run of its own.
    """
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    found.sort()
    next_base, covered = 0, 0
    random = []
    for m in CANDIDATE.finditer(text):
        runs, at = [], max(covered, m.start())
        while next_base < len(found) and found[next_base][0] < m.end():
            runs.append((at, found[next_base][0]))
            covered = max(covered, found[next_base][1])
            at = max(at, covered)
            next_base += 1
        for start, end in (*runs, (at, m.end())):
            if end - start >= CANDIDATE_LENGTH:
                random += [(start + i, start + j, "random") for i, j in random_stretches(text[start:end], path, ratio)]
    return sorted(found + random, key=lambda s: (s[0], KINDS.index(s[2])))


def written(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def masked(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with every stretch of overlapping spans replaced by one mask."""
    out, at = [], 0
    for start, end, _ in found:
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", ratio: float = RATIO) -> DataFrame:
    """Per row of ``docs``: key, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Null and empty texts have no spans. Rows are independent of each other; keys may repeat or be null. The
    rank file must lie at ``path`` on every executor.
    """
    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    counts = [T.StructField(f"n_{k}", T.LongType()) for k in BASE]
    schema = T.StructType(
        [slim.schema["key"], *counts, T.StructField("base_sha256", T.StringType()),
         T.StructField("spans", T.StringType()), T.StructField("n_random", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column("text"):
                found = spans(x.as_py() or "", path, ratio)
                base = [s for s in found if s[2] in BASE]
                kinds = [s[2] for s in found]
                digest = hashlib.sha256(written(base).encode()).hexdigest()
                rows.append((*[kinds.count(k) for k in BASE], digest, written(found), kinds.count("random")))
            columns = list(zip(*rows)) or [()] * 6
            kinds_of = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds_of)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *arrays], names=schema.names)

    return slim.mapInArrow(run, schema).withColumnRenamed("key", key)


def redact(docs: DataFrame, path: str, text: str = "text", length: str = "n_chars", ratio: float = RATIO) -> DataFrame:
    """``docs`` with all spans masked in the text; a column ``length`` of lengths follows where there is one.

    All other columns, and all rows, stay as they are; a null text stays null.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = []
            for x in batch.column(text):
                whole = x.as_py()
                clean.append(whole if whole is None else masked(whole, spans(whole, path, ratio)))
            columns = dict(zip(names, batch.columns))
            columns[text] = pa.array(clean, batch.schema.field(text).type)
            if length in columns:
                old, kind = columns[length], batch.schema.field(length).type
                before = batch.column(text)
                columns[length] = pa.array(
                    [o.as_py() if c is None or c == b.as_py() else len(c) for c, b, o in zip(clean, before, old)], kind
                )
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return docs.mapInArrow(run, docs.schema)
