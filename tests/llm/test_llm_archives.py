"""Archives and vector search, against plain Python."""

import base64
import gzip
import hashlib
import io

import numpy as np
import pytest

from netseq.llm import common, topk, warc

PAGES = "page_id long, url string, html string, archive string, path string, content string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "a", "p", "c") for i, u, h in rows], PAGES)


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def order(rows):
    return sorted(rows, key=lambda r: [(x is None, "" if x is None else str(x)) for x in r])


ROWS = [
    (1, "http://a/x y", "<p>é日本\r\n\r\nWARC/1.0\n1 0 x</p>"),
    (2, None, None),
    (3, "", ""),
    (4, "http://b/é", "same"),
    (5, "http://b", "same"),
    (5, "http://b", "same"),
    (None, "http://c", "same"),
    (None, "http://c", "only without a page"),
    (6, "http://d", "x" * 200_000),
    (7, "http://d", "y\n" * 50_000),
    (8, "filedesc://e", "HTTP/1.1 200 OK\r\nX-Page-Id: 99\r\n\r\nno"),
]


@pytest.mark.parametrize("limit, sent", [(1, None), (600, None), (600, 0), (warc.ARCHIVE_BYTES, None)])
def test_round_trip(spark, limit, sent, monkeypatch):
    """Also where the list of repeats is not sent to the archives."""
    if sent is not None:
        monkeypatch.setattr(common, "BROADCAST_BYTES", sent)
    got = warc.round_trip(pages(spark, ROWS).repartition(3), limit=limit).collect()
    first, want = {}, []
    for i, _, h in sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0)):
        d = digest(h)
        again = d in first
        first.setdefault(d, i)
        want.append((i, len((h or "").encode()), d, "revisit" if again else "response", first[d] if again else None))
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert order([tuple(r[c] for c in names) for r in got]) == order(want)
    assert len({r["record_id"] for r in got}) == len(got)


def test_least_size_of_revisits(spark):
    rows = [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcd"), (4, "u", "abcd")]
    got = {r["page_id"]: r["record_type"] for r in warc.round_trip(pages(spark, rows), least=4).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_no_pages(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_foreign_arc_files():
    """Version 1 with a short head, a URL with blanks and a document that is no HTTP message."""
    head = b"1 0 Crawl\nURL IP-address Archive-date Content-type Archive-length\n"
    body = b"plain words"
    file = b"filedesc://old.arc 0.0.0.0 19960923142103 text/plain %d\n" % len(head) + head
    file += b"\nhttp://x/a b 1.2.3.4 1996 text/plain %d\n" % len(body) + body + b"\n"
    records = list(warc.read_arc(io.BytesIO(file)))
    assert [f["URL"] for f, _ in records] == ["filedesc://old.arc", "http://x/a b"]
    out = b"".join(warc.converted(gzip.compress(file), {}))
    (info, _), (fields, block) = warc.read_warc(io.BytesIO(out))
    assert info["warc-type"] == "warcinfo" and block == body
    assert fields["warc-date"] == "1996-01-01T00:00:00Z" and fields["warc-ip-address"] == "1.2.3.4"
    assert fields["warc-payload-digest"] == "sha1:" + digest("plain words")
    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(file[:-5])))


def test_written_archives_are_gzip_per_record(spark, tmp_path):
    warc.write_arc(pages(spark, ROWS).coalesce(1), f"{tmp_path}/arc", limit=600)
    files = spark.read.format("binaryFile").load(f"{tmp_path}/arc").collect()
    assert len(files) > 2
    versions = set()
    for f in files:
        whole = gzip.decompress(bytes(f["content"]))
        versions.add(next(warc.read_arc(io.BytesIO(whole)))[0]["version"])
        assert bytes(f["content"]).count(b"\x1f\x8b\x08") >= 2
    assert versions == {"1", "2"}


def brute_top(rows, k, modulus):
    usable = [
        (i, np.floor(64 * np.array(v, np.float64)))
        for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for i, q in usable:
        if i % modulus:
            continue
        scored = []
        for j, c in usable:
            if i != j:
                n = min(len(q), len(c))
                scored.append((-int(q[:n] @ c[:n]), j))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("shards,block", [(3, 1000), (7, 10)])
def test_top_k(spark, shards, block):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]  # a crowd of one vector, all ties
    rows += [(2000, None), (2004, [1.0, None]), (2008, [float("nan")] * 8), (2012, [float("inf")] * 8), (None, rows[1][1])]
    rows += [(2016, []), (2020, [1.0, -1.0]), (3, rows[3][1]), (4, rows[9][1]), (-8, rows[2][1])]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, row long, shard long")
    from pyspark.sql import functions as F

    got = topk.top_k(df, F.col("vec_id") % 4 == 0, 20, least_shards=shards, shard_rows=10**6, block_rows=block)
    assert sorted(map(tuple, got.collect())) == sorted(brute_top(rows, 20, 4))


def test_few_or_no_vectors(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, [1.0]), (1, [0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 20).collect()] == [(0, 1, 1, 64 * 32)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_bounds_leave_nodes_out():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(10, 16)) * 640
    vectors = np.floor(np.repeat(centres, 400, axis=0) + rng.normal(size=(4000, 16)) * 20)
    ids = np.arange(4000)
    unknown = np.full(50, topk.NO_SCORE), np.full(50, topk.NO_ID)
    search = topk.Search(vectors, ids, vectors[:50], ids[:50], 5, *unknown)
    search.descend(topk.build_tree(vectors, ids), np.arange(50))
    assert search.visited < 0.35 * 50 * 4000
    scores = vectors[:50] @ vectors.T
    scores[np.arange(50), np.arange(50)] = -np.inf
    at, score, found = search.best
    for q in range(50):
        want = sorted(zip(-scores[q], ids))[:5]
        assert [(-s, i) for s, i in zip(score[at == q], found[at == q])] == [(s, i) for s, i in want]
