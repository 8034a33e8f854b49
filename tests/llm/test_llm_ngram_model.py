"""Language-model scores against a plain dictionary model."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from netseq.llm import ngram_model
from netseq.llm.eliasfano import EliasFano, load, save

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, held string, ids string, key string, score string, n_tokens string"


def tokens(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [*WORD.findall(low), None]


def brute(rows, order=3):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base, score) by dictionaries, unquantised."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    counts = [Counter() for _ in range(order + 1)]
    for (_, text), out in zip(rows, held):
        if not out:
            line = [None, *tokens(text)]
            for at in range(1, len(line)):
                counts[1][(line[at],)] += 1
                for k in range(2, order + 1):
                    if at - k + 1 >= 0:
                        counts[k][tuple(line[at - k + 1 : at + 1])] += 1
    total, distinct = sum(counts[1].values()), len(counts[1])
    sums, kinds, discount = defaultdict(int), defaultdict(int), {}
    for k in range(2, order + 1):
        once, twice = sum(c == 1 for c in counts[k].values()), sum(c == 2 for c in counts[k].values())
        discount[k] = min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5
        for gram, c in counts[k].items():
            sums[gram[:-1]] += c
            kinds[gram[:-1]] += 1

    def p(gram):
        if len(gram) == 1:
            return (counts[1][gram] + 0.1) / (total + 0.1 * (distinct + 1))
        lower, context = p(gram[1:]), gram[:-1]
        if not sums[context]:
            return lower
        d = discount[len(gram)]
        return max(counts[len(gram)][gram] - d, 0) / sums[context] + d * kinds[context] / sums[context] * lower

    out = []
    for (i, text), h in zip(rows, held):
        line = [None, *tokens(text)]
        known = sum(counts[1][(t,)] > 0 for t in line[1:])
        base = sum(math.log10(p((t,))) for t in line[1:])
        score = sum(math.log10(p(tuple(line[max(0, at - order + 1) : at + 1]))) for at in range(1, len(line)))
        out.append((i, h, len(line) - 1, known, total, base, score))
    return out


def compare(spark, rows, order=3):
    full = [(i, t, "a", "b", "c", "d", "e") for i, t in rows]
    found = ngram_model.score(spark.createDataFrame(full, SCHEMA).repartition(3), order=order).collect()
    want = brute(rows, order)
    line = lambda r: (str(r[0]), r[2], r[5])
    assert len(found) == len(want)
    for got, exact in zip(sorted(map(tuple, found), key=line), sorted(want, key=line)):
        assert got[:5] == exact[:5]
        assert got[5] == pytest.approx(exact[5], rel=1e-9, abs=1e-9)
        assert got[6] == pytest.approx(exact[6], abs=3e-4 * got[2])
    return found


def prose(seed, n, vocabulary):
    return " ".join(f"W{x}" for x in np.random.default_rng(seed).zipf(1.4, n) % vocabulary)


def rows():
    return [
        *((i, prose(i % 30, 40 + i, 300)) for i in range(60)),
        (60, None), (61, ""), (62, " \t\n "), (None, "One two one TWO"), (None, None), (7, prose(7, 47, 300)), (7, prose(7, 47, 300)),
        (63, "É é İ ſ K \x00\x1c\x85 日本 " * 5), (64, prose(99, 30_000, 3_000)), (65, "x" * 5_000 + " y"),
    ]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_are_the_dictionary_models(spark, order):
    compare(spark, rows(), order)


def test_small_shards_and_slices(spark, monkeypatch):
    """Contexts that many shards share, texts that many slices share."""
    for name, value in (("SHARD_BYTES", 2_000), ("SHARD_TOKENS", 500), ("TOKENS", 100), ("GROUP_BYTES", 300), ("HELD_KEYS", 200)):
        monkeypatch.setattr(ngram_model, name, value)
    hot = [(100 + i, " ".join(f"the v{j}" for j in np.random.default_rng(i).integers(0, 900, 200))) for i in range(20)]
    compare(spark, rows() + hot)


def test_empty_and_unlearnt(spark):
    assert ngram_model.score(spark.createDataFrame([], SCHEMA)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    compare(spark, [(held, "nothing to learn from")])
    compare(spark, [(1, None), (2, ""), (held, None)])


def test_probabilities_sum_to_one(spark):
    """Over all words after a context, the unknown one included."""
    learnt = [(i, prose(i, 60, 20)) for i in range(30) if zlib.crc32(str(i).encode()) % 10]
    words = sorted({t for _, text in learnt for t in tokens(text) if t})
    held = [h for h in range(100_000) if zlib.crc32(str(h).encode()) % 10 == 0][: len(words) + 2]
    texts = ["w1 w2 " + w for w in [*words, "unheard"]] + ["w1 w2"]
    got = {r["doc_id"]: r["score"] for r in ngram_model.score(spark.createDataFrame([(*x, "", "", "", "", "") for x in learnt + list(zip(held, texts))], SCHEMA)).collect()}
    model = dict((r[0], r) for r in brute(learnt + list(zip(held, texts))))
    for h in held:
        assert got[h] == pytest.approx(model[h][6], abs=2e-3)


def test_held_out_texts_are_better_known_than_by_words_alone(spark):
    found = [r for r in compare(spark, [(i, prose(i % 12, 200, 200)) for i in range(80)]) if r["held_out"]]
    assert sum(r["score"] for r in found) > sum(r["base_score"] for r in found)


def test_elias_fano(tmp_path):
    rng = np.random.default_rng(5)
    for n, most in ((0, 10), (1, 10), (5, 6), (1_000, 2_000), (1_000, 10**15), (20_000, 2**63)):
        keys = np.unique(np.concatenate([rng.integers(0, most, n, dtype=np.uint64), np.arange(most, most + n, dtype=np.uint64)]))
        save(f"{tmp_path}/keys", EliasFano.build(keys).arrays())
        found = EliasFano.of(load(f"{tmp_path}/keys"))
        asked = np.concatenate([keys, keys + np.uint64(1), rng.integers(0, most, 500, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        at = np.searchsorted(keys, asked)
        assert (found.keys() == keys).all() and (found.successor(asked) == at).all()
        assert (found.find(asked) == np.where(np.isin(asked, keys), at, -1)).all()
        if n:
            assert (found.access(np.arange(len(keys))) == keys).all()
