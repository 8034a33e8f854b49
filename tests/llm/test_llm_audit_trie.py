"""Filter audits and conversation tries against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import permutations

import pytest

from netseq.llm import filter_audit, prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, row string, part string, key string, failed string, kept string"
LABELS = "doc_id long, quality int, toxic int, row string, key string"


def brute_audit(rows, labels):
    fails = []
    for n, (i, text, lang) in enumerate(rows):
        text = text or ""
        words = WORD.findall(text)
        copy = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)
        found = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": copy,
        }
        good = any(j == i and q == 1 for j, q, _ in labels if i is not None)
        toxic = any(j == i and t == 1 for j, _, t in labels if i is not None)
        fails.append((lang or "", {f for f, x in found.items() if x}, good, toxic))
    out = set()
    for part in {p for p, *_ in fails}:
        own = [x[1:] for x in fails if x[0] == part]
        shapley = defaultdict(int)
        lines = []
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                gone = set(order[: step - 1])
                now = [x for x in own if f in x[0] and not x[0] & gone]
                shapley[f] += len(now)
                lines.append((
                    "".join(order), step, sum(not x[0] & (gone | {f}) for x in own), len(now),
                    sum(f in x[0] and bool(x[0] & gone) for x in own), sum(x[0] == {f} for x in own),
                    sum(x[1] for x in now), sum(x[2] for x in now), f,
                ))
        out |= {(part, *x[:-1], shapley[x[-1]]) for x in lines}
    return out


def documents():
    rng = random.Random(3)
    texts = [None, "", " \t\n ", "Short AND LOUD", "a b " * 300, "plain " + " ".join(f"w{i}" for i in range(400)), "É é\x00\x1c\x85 x"]
    texts += [" ".join(rng.choice(["Word", "text", "five%", "more", "THIS", f"n{rng.randint(0, 900)}"]) for _ in range(rng.randint(0, 500))) for _ in range(30)]
    texts.append("long " + " ".join(f"x{i % 7_000}" for i in range(60_000)))
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["de", "en", None, ""])) for _ in range(150)]
    return rows + rows[:10]


def test_audit(spark):
    rows = documents()
    labels = [(i, i % 3, i % 2) for i in range(0, 50)] + [(3, 1, 1), (3, 0, None), (None, 1, 1), (4, None, 0)]
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], DOCS).repartition(5)
    told = spark.createDataFrame([(*x, "a", "b") for x in labels], LABELS)
    found = filter_audit.audit(docs, told)
    assert {tuple(r) for r in found.collect()} == brute_audit(rows, labels)
    assert found.count() == 3 * 600
    for a, b in ((docs.limit(0), told), (docs.limit(0), told.limit(0))):
        assert filter_audit.audit(a, b).count() == 0
    unlabelled = filter_audit.audit(docs, told.limit(0)).selectExpr("sum(good_lost + toxic_lost)", "sum(removed)").first()
    assert unlabelled[0] == 0 and unlabelled[1] > 0


TURNS = "conv_id long, turn long, role string, text string, node string, depth string, size string, parent string"


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    told = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        told[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in told.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)

    def totals(node):
        saved, leaves = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0), 0
        for x in children[node]:
            s, n = totals(x)
            saved, leaves = saved + s, leaves + n
        return saved, leaves or 1

    out = []
    for node, found in members.items():
        saved, leaves = totals(node)
        ends = ",".join(str(c) for c in sorted(c for c in found if len(told[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(found), len(node), parent, len(found), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def turns():
    rng = random.Random(4)
    rows = []
    for c in [*range(-205, -195), *range(130), *range(250, 330), *range(700, 712)]:
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None, ""]), rng.choice(["hi", "yes", None, "", "é日🎉", f"t{rng.randint(0, 9)}"])))
    rows += [(500, t, "user", "word " * 50) for t in range(300)] + [(None, 1, "user", "nobody's"), (None, None, None, None)]
    rows += [(800 + i, t, "user", "all the same") for i in range(60) for t in range(4)] + [(900, 0, "user", "x" * 100_000)]
    return rows + rows[:20]


@pytest.mark.parametrize("shard,top,held,chunk", [(200_000, 50_000, 200_000, 1 << 16), (20, 10_000, 3, 8), (1, 4, 1, 1)])
def test_trie(spark, monkeypatch, shard, top, held, chunk):
    """In one shard, and in many with queues that spill."""
    for name, value in (("SHARD_ROWS", shard), ("TOP_NODES", top), ("QUEUED", held), ("CHUNK_BYTES", chunk), ("MOST_RUNS", 5)):
        monkeypatch.setattr(prefix_trie, name, value)
    rows = turns()
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], TURNS).repartition(4)
    got = [tuple(r) for r in prefix_trie.trie(df).collect()]
    line = lambda r: tuple(map(str, r))
    assert sorted(got, key=line) == sorted(brute_trie(rows), key=line)


def test_empty_trie(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.trie(none).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "u", "t", "", "", "", "")], TURNS)).count() == 0


def test_queue_spills_in_order():
    rng = random.Random(5)
    queue, held = prefix_trie.SpillingQueue(7), []
    want = defaultdict(lambda: [0, 0, 0])
    for _ in range(3_000):
        key = prefix_trie.turn_of(rng.randint(0, 20), bytes([rng.randint(0, 5)]) * prefix_trie.DIGEST)
        sent = [1, rng.randint(1, 9), rng.randint(0, 99)]
        want[key] = [a + b for a, b in zip(want[key], sent)]
        queue.push(key, *sent)
        held.append(key)
    for key in sorted(set(held)):
        assert list(queue.pop(key)) == want[key]
    assert not queue.heap and not queue.runs
