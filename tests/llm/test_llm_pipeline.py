"""The pipeline and the registered queries."""

import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from netseq.llm import secrets  # noqa: E402
from test_llm_documents import brute_components, brute_quality, count, order  # noqa: E402


def test_every_operator_is_registered():
    names = list(entry.queries())
    assert [sum(x.startswith(f"op{n}_") for x in names) for n in range(1, 14)] == [1] * 13
    assert "pipeline" in names


def test_pipeline(spark, small):
    """Every stage on what its predecessor kept, against plain Python."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    before = docs.collect()
    for name, apply in corpus_pipeline.STAGES[:-1]:
        rows = apply(spark, spark.createDataFrame(before, docs.schema), small)
        assert rows.columns == docs.columns and rows.schema.simpleString() == docs.schema.simpleString()
        after = rows.collect()
        if name == "quality rules":
            for r in before:
                n, chars, symbols, dup, repeat, lines = brute_quality(r["text"])
                rejected = (
                    n < 50 or 100 * repeat > 50 * n or chars < 2 * n or chars > 25 * n
                    or 100 * symbols > 40 * n or 100 * dup > 60 * lines
                )
                assert (r in after) != rejected
        elif name == "n-gram Jaccard join":
            found = brute_components([(r["doc_id"], r["text"]) for r in before], 5, 80)
            assert {r["doc_id"] for r in after} == {c for _, _, c in found} and len(after) < len(before)
        elif name == "secret scans":
            masked = {r["doc_id"]: secrets.masked(r["text"], secrets.spans(r["text"], vocabulary)) for r in before}
            assert {r["doc_id"]: r["text"] for r in after} == masked and len(after) == len(before)
            assert all(r["n_chars"] == len(r["text"]) for r in after if secrets.MASK in r["text"])
        else:
            copies = Counter(r["doc_id"] for r in after)
            assert set(copies) <= {r["doc_id"] for r in before} and max(copies.values()) <= 3
            total, got, sizes = 0, Counter(), Counter()
            for r in before:
                sizes[r["source"]] += count(r["text"])
                got[r["source"]] += copies[r["doc_id"]] * count(r["text"])
            longest = max(count(r["text"]) for r in before)
            names = sorted(sizes)
            weight = {s: i % 3 + 1 for i, s in enumerate(names)}
            share = {s: sum(sizes.values()) * weight[s] / sum(weight.values()) for s in names}
            if all(share[s] <= 3 * sizes[s] for s in names):
                assert all(abs(got[s] - share[s]) <= longest for s in names)
        assert after
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame(before, docs.schema), small).collect()
    ids = Counter()
    for r in before:
        found = np.array(library.encode(r["text"], add_special_tokens=False).ids + [0], "<u4")
        ids[r["doc_id"]] += len(found)
    got = Counter()
    for r in packed:
        got[r["doc_id"]] += r["length"]
    assert got == ids
    whole = [r for r in packed if r["length"] == r["doc_tokens"]]
    texts = {r["doc_id"]: r["text"] for r in before}
    for r in whole[:50]:
        found = np.array(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [0], "<u4")
        assert r["ids_crc32"] == zlib.crc32(found.tobytes())


def test_run_applies_all_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, apply in corpus_pipeline.STAGES:
        docs = apply(spark, docs, small)
    again = corpus_pipeline.run(spark, small)
    names = ["doc_id", "doc_tokens"]
    assert order(map(tuple, again.select(*names).distinct().collect())) == order(map(tuple, docs.select(*names).distinct().collect()))
