"""Token counts and ids as a tokenizer file of the ``tokenizers`` library gives them.

The library's work per text is replaced by work per distinct piece. A piece is what the library's own
pre-tokenizer would hand to the merges. Which strings of the vocabulary are one token on their own is proved
once from the library's model; pieces among them count directly, and only the rest is merged, remembered up
to a bound. Texts for which a step cannot be shown to agree with the library go through the library whole.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Code points up to here are checked one by one for equal splitting; texts with later ones go the long way.
CHECKED = 0x3000

# Merged pieces that a worker remembers, and the longest of them.
REMEMBERED = 1 << 18
REMEMBERED_LENGTH = 64

# Hash values that tell whether a piece was met before.
MET = 1 << 22

# Pieces met once that are still at hand.
WAITING = 1 << 16

LIMIT = 2048

# The splitting pattern of byte-level pre-tokenizers that keep white space.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> list[str]:
    """The character that byte-level vocabularies write for each byte.

    Printable bytes stand for themselves, the others are counted up from 256.
    """
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = [b for b in range(256) if b not in printable]
    shifted = {b: chr(256 + i) for i, b in enumerate(others)}
    return [shifted.get(b) or chr(b) for b in range(256)]


class Remembering(dict):
    """What ``make`` gives for a piece, with the proved strings always at hand and others up to a bound.

    Most pieces of a corpus occur once. A piece keeps its place when it is met again, which a table of one byte per
    hash value tells (a wrong answer costs a place, no more); until then it waits among the latest ones. At the
    bound the older half gives way.
    """

    def __init__(self, proved: dict, make: Callable[[str], object]):
        super().__init__(proved)
        self.n_proved, self.make = len(proved), make
        self.met, self.waiting = bytearray(MET), {}

    def __missing__(self, piece: str):
        found = self.waiting.pop(piece, None)
        if found is None:
            found = self.make(piece)
            if len(piece) > REMEMBERED_LENGTH:
                return found
            h = hash(piece)
            slot, mark = h % MET, (h // MET) % 255 + 1
            if self.met[slot] != mark:
                self.met[slot] = mark
                if len(self.waiting) >= WAITING:
                    self.waiting.clear()
                self.waiting[piece] = found
                return found
        if len(self) >= REMEMBERED + self.n_proved:
            for old in list(islice(self, self.n_proved, self.n_proved + REMEMBERED // 2)):
                del self[old]
        self[piece] = found
        return found


def packed(ids: Iterable[int]) -> bytes:
    """Ids as unsigned 32-bit little-endian numbers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _class(kind: str) -> str:
    """Inside of a character class: the checked code points of a general category."""
    inside = [c for c in range(CHECKED) if unicodedata.category(chr(c))[0] == kind]
    starts = [c for i, c in enumerate(inside) if not i or inside[i - 1] != c - 1]
    ends = [c for i, c in enumerate(inside) if i + 1 == len(inside) or inside[i + 1] != c + 1]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends))


def spelled_out(pattern: str) -> str:
    """The pattern for the standard library's module, which has no properties but is the faster one: letters and
    numbers become classes of the checked code points."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        found = re.match(r"\\p\{([LN])\}", pattern[i:])
        part = found[0] if found else pattern[i : i + (2 if pattern[i] == "\\" else 1)]
        written = _class(found[1]) if found else part
        out.append(f"[{written}]" if found and not inside else written)
        inside = part == "[" or inside and part != "]"
        i += len(part)
    return "".join(out)


class Pieces:
    """Splits texts and encodes pieces for one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.special = [t["content"] for t in told["added_tokens"]]
        self.end = told["model"].get("end_of_word_suffix") or ""
        self.pattern = self._pattern(told["pre_tokenizer"])
        self.split = re.compile(spelled_out(self.pattern)).findall if self.pattern else None
        self.alphabet = byte_alphabet()
        self.to_alphabet = str.maketrans({chr(b): c for b, c in enumerate(self.alphabet)})
        self.single: dict[str, int] = {}
        if self.split:
            self.unproved = self._unproved()
            self.single = self._single(told["model"]["vocab"])
        self.counts = Remembering(dict.fromkeys(self.single, 1), lambda p: len(self.merged(p)))
        self.bytes = Remembering({p: packed([i]) for p, i in self.single.items()}, lambda p: packed(self.merged(p)))

    @staticmethod
    def _pattern(told: dict | None) -> str | None:
        """The one pattern that splits normalized text, for the two known layouts of pre-tokenizers."""
        if not told:
            return None
        if told["type"] == "ByteLevel" and told.get("use_regex") and not told["add_prefix_space"]:
            return BYTE_LEVEL_PATTERN
        steps = told.get("pretokenizers", [])
        if [s["type"] for s in steps] == ["Split", "ByteLevel"]:
            cut, bytes_ = steps
            if cut["behavior"] == "Removed" and cut["invert"] and not bytes_["use_regex"] and not bytes_["add_prefix_space"]:
                return cut["pattern"].get("Regex")
        return None

    def _unproved(self) -> re.Pattern:
        """Finds characters around which this module's splitting is not shown to be the library's."""
        wrong = []
        for c in map(chr, range(CHECKED)):
            probe = f"a{c}1{c}{c}b {c}"
            theirs = [probe[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(probe)]
            if theirs != self.split(probe):
                wrong.append(c)
        return re.compile(rf"[\U{CHECKED:08x}-\U0010ffff{''.join(map(re.escape, wrong))}]")

    def _single(self, vocabulary: dict[str, int]) -> dict[str, int]:
        """Strings of the vocabulary that the merges leave as one token when they stand alone."""
        byte_of = {c: b for b, c in enumerate(self.alphabet)}
        proved = {}
        for name, number in vocabulary.items():
            if not name.endswith(self.end) or name in self.special:
                continue
            written = name[: len(name) - len(self.end)]
            if not written or any(c not in byte_of for c in written):
                continue
            alone = self.library.model.tokenize(written)
            if len(alone) != 1 or alone[0].id != number:
                continue
            try:
                proved[bytes(byte_of[c] for c in written).decode("utf-8")] = number
            except UnicodeDecodeError:
                continue  # half a character is never a piece
        return proved

    def merged(self, piece: str) -> list[int]:
        """Ids of one piece by the library's merges."""
        if piece.isascii() and piece.isprintable():  # only the blank is written otherwise
            written = piece.replace(" ", self.alphabet[32])
        else:
            written = piece.encode("utf-8").decode("latin-1").translate(self.to_alphabet)
        return [t.id for t in self.library.model.tokenize(written)]

    def pieces(self, text: str) -> list[str] | None:
        """The pieces of a text, or None where only the library can tell."""
        if self.split is None or any(s in text for s in self.special):
            return None
        normal = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        return None if self.unproved.search(normal) else self.split(normal)

    def count(self, text: str) -> int:
        found = self.pieces(text)
        if found is None:
            return len(self.library.encode(text, add_special_tokens=False).ids)
        return sum(map(self.counts.__getitem__, found))

    def packed(self, text: str) -> bytes:
        """The ids of a text as unsigned 32-bit little-endian numbers."""
        found = self.pieces(text)
        if found is None:
            return packed(self.library.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.bytes.__getitem__, found))


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    """One per worker process."""
    return Pieces(path)


def texts(batch: pa.RecordBatch, column: str) -> Iterator[str]:
    """The texts of a batch one at a time, empty for null."""
    for x in batch.column(column):
        yield x.as_py() or ""


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row of ``docs``: key, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    Null and empty texts have none. Rows are independent: repeated and null keys get their own lines. The
    tokenizer file must lie at ``path`` on every executor.
    """
    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([slim.schema["key"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces_of(path)
        for batch in batches:
            sizes, counts = [], []
            for whole in texts(batch, "text"):
                sizes.append(len(whole.encode("utf-8")))
                counts.append(known.count(whole))
            columns = [batch.column("key"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n_bytes", "n_tokens"])

    counted = slim.mapInArrow(run, schema)
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
