from __future__ import annotations

import random

import numpy as np
import pytest
from common import corpus, documents, empty, sentence

from rooftide.llm import components, near_dedup
from rooftide.llm._common import materialize
from rooftide.llm.components import connected_components


def sets_of(rows, k):
    out = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        out.setdefault(i, []).append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    return out


def brute(rows, k, percent=80):
    sets = sets_of(rows, k)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            for x in sets[i]:
                for y in sets[j]:
                    if x and y and 100 * len(x & y) >= percent * len(x | y):
                        p, q = find(i), find(j)
                        root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def near_group(rng, base, n, edits):
    words = base.split()
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(edits):
            w[rng.randrange(len(w))] = "edit%d" % rng.randrange(10**6)
        out.append(" ".join(w))
    return out


def planted():
    rng = random.Random(9)
    texts = [sentence(rng, "en", rng.randrange(1, 120)) for _ in range(120)]
    base = sentence(rng, "en", 150)
    texts += [base] * 40 + near_group(rng, base, 150, 2) + near_group(rng, base, 30, 6)
    shared = sentence(rng, "fr", 40)
    texts += [shared + " " + sentence(rng, "en", 30) for _ in range(60)]
    texts += [None, "", " ", "one", "one", "One TWO", "one two three", "one two three four"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return [(i, t) for i, t in zip(ids, texts, strict=True)]


@pytest.mark.parametrize("limits", [{}, {"NODE_ROWS": 12, "CLUSTER_SHINGLES": 3000, "ROWS_A_BLOCK": 20, "OPEN_A_BLOCK": 7}])
def test_components_match_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(near_dedup, name, value)
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS n", "3 AS s1", "4 AS key")
    got = near_dedup.near_duplicates(df, k=4).collect()
    want, sets = brute(rows, 4), sets_of(rows, 4)
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id][0])
        assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_corpus_with_repeated_rows_and_null_id(spark):
    rows = [r[:2] for r in corpus()]
    got = near_dedup.near_duplicates(documents(spark), k=5).collect()
    assert len(got) == len(rows)
    want = brute([r for r in rows if r[0] is not None], 5)
    for r in got:
        if r.doc_id is None:
            assert r.component_id == 6 and not r.kept  # the null id's text is that of document 6
        else:
            assert r.component_id == want[r.doc_id]
    assert sum(r.kept for r in got) == len({r.component_id for r in got}) + 1  # one kept row comes twice


def test_empty_and_wordless(spark):
    assert near_dedup.near_duplicates(empty(spark)).count() == 0
    df = spark.createDataFrame([(1, None), (2, ""), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_dedup.near_duplicates(df).collect()) == [(0, 0, 0, True), (1, 0, 1, True), (2, 0, 2, True)]


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1050)] + [(5, 5), (7, 9), (7, 9)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    linked = {x for e in edges for x in e if e[0] != e[1]}
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_between_rows_of_unlike_hubs(spark, monkeypatch):
    """Versions of a page, neighbours alike: the outer ones are many and hold all hubs, the inner ones few."""
    monkeypatch.setattr(near_dedup, "ROWS_A_BLOCK", 20)
    monkeypatch.setattr(near_dedup, "OPEN_A_BLOCK", 7)
    rows, want = [], {}
    for key, versions in ((1, (0, 1, 2, 3)), (2, (0, 1, 3)), (3, (0, 1, 2, 3, 5))):
        numbers = [(v, n) for v in versions for n in range(2 if v in (1, 2) else 40)]
        sets = {1000 * key + at: np.array(sorted({*range(100 * v, 100 * v + 1000), 10_000 * key + at}), np.uint64) for at, (v, n) in enumerate(numbers)}
        rows += [(key, i, bytearray(x.tobytes())) for i, x in sets.items()]
        names = list(sets)
        root = {i: i for i in names}
        for a in names:
            for b in names:
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True)) if root[a] != root[b] else 0
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    old, new = max(root[a], root[b]), min(root[a], root[b])
                    root = {i: new if x == old else x for i, x in root.items()}
        want |= root
    edges = near_dedup.link_large(spark.createDataFrame(rows, "key long, id long, payload binary"), near_dedup._set_pass(80))
    assert {r.id: r.component for r in connected_components(edges).collect()} == want
    assert len(set(want.values())) == 5


def test_chain_of_versions_matches_brute_force(spark, monkeypatch):
    for name, value in {"NODE_ROWS": 12, "CLUSTER_SHINGLES": 3000, "ROWS_A_BLOCK": 20, "OPEN_A_BLOCK": 7}.items():
        monkeypatch.setattr(near_dedup, name, value)
    rng = random.Random(4)
    words = ["w%d" % i for i in range(460)]
    texts = []
    for v, n in enumerate((40, 2, 2, 40)):
        texts += near_group(rng, " ".join(words[30 * v : 30 * v + 370]), n, 1)
    rows = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()}
    assert got == brute(rows, 4)


@pytest.mark.parametrize("limit", [0, 40, 1 << 17])
def test_components_of_few_edges_take_one_task(spark, monkeypatch, limit):
    """Whatever is left to one task, the components are the same; rounds of stars are only for more edges than that."""
    monkeypatch.setattr(components, "EDGES_A_TASK", limit)
    written = []
    monkeypatch.setattr(components, "materialize", lambda df, tag: written.append(tag) or materialize(df, tag))
    edges = [(i, i + 1) for i in range(60)] + [(i, 200) for i in range(201, 230)] + [(-5, 300), (300, 301), (7, 7)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 200 for i in range(200, 230)} | {-5: -5, 300: -5, 301: -5}
    assert ("stars" in written) == (limit < len(edges))
