"""Near-duplicates of the pipeline against brute-force Jaccard."""

from itertools import combinations

import numpy as np
import pytest
from conftest import SF, rows

import corpus_pipeline
from tessera.llm import simhash


def plain_sets(texts):
    words = [(t or "").lower().split() for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]


def plain_components(texts):
    sets, root = plain_sets(texts), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def data(spark):
    found = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    base = [f"word{i}" for i in range(100)]
    # 6 of 96 shingles differ at each end: 0.88; five shingles around each of two changed words: 0.81; of three: 0.73
    odd = [base, ["x", *base[6:]], [*base[:30], "y", *base[31:60], "y", *base[61:]], [*base[:20], "z", *base[21:40], "z", *base[41:70], "z", *base[71:]]]
    texts = [*map(" ".join, odd), " ".join(base).upper(), "", None, "one two", "One  TWO", "one two three"]
    return found + [(10**6 + i, t) for i, t in enumerate(texts)] + [found[3]]


def test_stage_is_brute_force_jaccard(spark, data):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    parts = plain_components([t for _, t in data])
    kept = rows(corpus_pipeline.drop_near_duplicates(spark, docs, SF), "doc_id")
    assert kept == sorted((min(data[i][0] for i in range(len(data)) if parts[i] == p),) for p in set(parts))


def test_large_clusters_are_cut(spark, data, monkeypatch):
    table = spark.createDataFrame(data, "doc_id long, text string")
    whole = rows(simhash.similar(table))
    monkeypatch.setattr(simhash, "MEMBERS", 2)
    monkeypatch.setattr(simhash, "CELL", 3)
    assert rows(simhash.similar(table)) == whole


def test_empty_table(spark):
    assert simhash.similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize(("size", "n"), [(5, 4000), (9, 4000), (40, 4000), (900, 600)])
def test_recall_of_proposals(size, n):
    """Pairs of sets at 0.8 exactly or just above, over random shingles: nearly all share a sample's bits and lie within the radius; unrelated ones do not."""
    rng = np.random.default_rng(size)
    own = rng.integers(0, 2**63, (n, size)).astype(np.uint64)
    both = size - size // 9 if size >= 9 else size
    fps = np.array([simhash.wide_fingerprint(x) for x in own])
    more = rng.integers(0, 2**63, (n, size)).astype(np.uint64)
    near = np.array([simhash.wide_fingerprint(np.concatenate([x[:both], y[both:]]) if size >= 9 else x[:4]) for x, y in zip(own, more, strict=True)])
    apart = np.where((np.bitwise_count(fps ^ near) <= simhash.WORD_RADIUS).all(1), np.bitwise_count(fps ^ near).sum(1), 256)
    diff = np.unpackbits((fps ^ near).view(np.uint8), axis=1, bitorder="little")
    for documents in (10**3, 10**6):
        shared = np.zeros(n, bool)
        for sample in simhash.samples(documents):
            shared |= ~diff[:, [64 * word + shift for word, shift in sample]].any(1)
        if size < 9:
            shared |= np.array([not set(simhash.small_keys(np.sort(x))).isdisjoint(simhash.small_keys(np.sort(x[:4]))) for x in own])
        assert (shared & (apart <= simhash.WIDE_RADIUS)).mean() > 0.995
    assert (np.bitwise_count(fps[1:] ^ fps[:-1]).sum(1) > simhash.WIDE_RADIUS).all()
