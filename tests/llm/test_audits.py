"""Whitening, decontamination and source divergence against plain Python and numpy, with the odd cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from brute import audit_rows, benchmark_hits

from careerloom.llm import contamination, divergence, whitening


def test_spectrum_updates_and_merges():
    rng = np.random.default_rng(1)
    for d, n in ((1, 6), (4, 3), (6, 40), (24, 200)):
        x = (rng.standard_normal((n, d)) @ rng.standard_normal((d, d)) * 90).astype(np.int64) + 100_000
        x[n // 2 :: 2] = x[0]
        whole, left, right = (whitening.Spectrum.empty(d) for _ in range(3))
        for i, row in enumerate(x):
            whole.add_row(row)
            (left if i < n // 3 else right).add_row(row)
        left.merge(right)
        scatter = np.cov(x.T, bias=True).reshape(d, d) * n
        for s in (whole, left):
            assert s.n == n and (s.sums == x.sum(axis=0)).all()
            assert np.allclose(s.vectors * s.values @ s.vectors.T, scatter, rtol=0, atol=1e-10 * scatter.max())
            assert np.allclose(s.vectors.T @ s.vectors, np.eye(d), atol=1e-12)


def test_secular_roots_with_close_poles():
    d = np.array([0.0, 1e-12, 1.0, 1.0 + 1e-9, 5.0])
    z2 = np.array([1e-14, 1.0, 1e-20, 2.0, 1e-3])
    gap = whitening.secular_roots(d, z2)
    roots = d - np.diagonal(gap)
    assert (np.diagonal(gap) < 0).all() and (np.diagonal(gap[1:]) > 0).all()  # each root is above its pole and below the next
    assert np.allclose(roots, np.linalg.eigvalsh(np.diag(d) + np.sqrt(np.outer(z2, z2))), atol=1e-13)


def check_whitened(rows, ids, x, k):
    n, d = x.shape
    sums = x.sum(axis=0)
    covariance = (x - sums / n).T @ (x - sums / n) / n
    values, vectors = np.linalg.eigh(covariance)
    got = {}
    for r in rows:
        got.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r)
    assert sorted(got) == list(range(1, k + 1)) and len(rows) == n * k
    for c, by_id in got.items():
        e, v = values[-c], vectors[:, -c]
        flat = [(r.vec_id, r.whitened) for rs in by_id.values() for r in rs]
        want = [(i, w) for i, w in zip(ids, (x - sums / n) @ v / np.sqrt(e))]
        sign = np.sign(sum(by_id[i][0].whitened * w for i, w in want))
        key = lambda p: (p[0] is None, p[0] or 0, round(p[1], 6))
        for (a, b), (i, w) in zip(sorted(flat, key=key), sorted([(i, sign * w) for i, w in want], key=key)):
            assert a == i and abs(b - w) < 1e-9
        assert abs(by_id[ids[0]][0].explained / (e / np.trace(covariance)) - 1) < 1e-9
    exact = {}
    for i, row in zip(ids, x):
        exact.setdefault(i, set()).add(sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)))
    assert all(r.n == n and r.deviation in exact[r.vec_id] and r.identity_error < 1e-9 for r in rows)


@pytest.mark.parametrize("parts", [1, 40])
def test_whitening(spark, parts):
    rng = np.random.default_rng(2)
    c = rng.standard_normal((300, 12)) @ rng.standard_normal((12, 12)) * 0.2
    c[100:200] = c[100]  # a third of the rows are one vector
    ids = [None, 7, 7, *range(3, 300)]
    rows = [(i, v.tolist(), "x", 1) for i, v in zip(ids, c)]
    rows += [(900, None, "x", 1), (901, [1.0, None] * 6, "x", 1), (902, [float("nan")] * 12, "x", 1), (903, [float("inf")] * 12, "x", 1), (904, [0.5] * 3, "x", 1), (905, [], "x", 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, values string, n int").repartition(parts)
    full = np.zeros((2, 12))
    full[0, :3] = 0.5
    x = np.floor(1024 * np.concatenate([c, full])).astype(np.int64) + 100_000
    check_whitened(whitening.whitening(frame).collect(), [*ids, 904, 905], x, 8)


def test_whitening_of_few_and_flat_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whitening(make([])).count() == whitening.whitening(make([(1, []), (2, None)])).count() == 0
    one = whitening.whitening(make([(5, [0.5, 0.25])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    line = sorted(whitening.whitening(make([(1, [0.0, 1.0]), (2, [1.0, 1.0])])).collect())
    assert [(r.vec_id, r.component, abs(r.whitened or 0), r.explained) for r in line] == [(1, 1, 1.0, 1.0), (1, 2, 0, 0.0), (2, 1, 1.0, 1.0), (2, 2, 0, 0.0)]
    far = whitening.whitening(make([(1, [3e38]), (2, [-3e38]), (3, [0.0])])).collect()
    assert {r.deviation for r in far} == {None, 0} or all(r.deviation is None or r.deviation >= 0 for r in far)


@pytest.fixture(scope="module")
def benchmark_case():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "日本", "a"]
    text = lambda n, w=words: " ".join(rng.choice(w) for _ in range(n))
    items = [(i, text(rng.randint(1, 30))) for i in range(12)]
    items += [(20, None), (21, " -- "), (22, items[0][1]), (22, text(14)), (None, text(11)), (30, "the " * 10), (31, "x y"), (32, text(400))]
    docs = [(i, text(rng.randint(0, 200))) for i in range(20)]
    for i, (_, t) in enumerate(items):
        w = (t or "").split()
        docs.append((40 + i, text(15) + " " + (t or "").upper().replace(" ", "-") + ", " + text(9)))
        docs.append((70 + i, " ".join(w[: len(w) // 2] + ["zz"] + w[len(w) // 2 :])))
    docs += [(99, None), (99, ""), (None, "x y"), (100, items[5][1] + " " + text(5)), (100, items[5][1] + " " + text(5)), (101, "the " * 3000 + "X_Y"), (102, items[9][1] * 2)]
    return docs, items


@pytest.mark.parametrize("most", [contamination.CANDIDATES, 3])
def test_contamination_equals_brute_force(spark, benchmark_case, most):
    docs, items = benchmark_case
    made = spark.createDataFrame([(*d, "a", 1, True) for d in docs], "doc_id long, text string, term string, n int, sets boolean").repartition(3)
    bench = spark.createDataFrame([(*b, "w") for b in items], "item_id long, text string, words string").repartition(2)
    rows = contamination.contamination(made, bench, candidates=most).collect()
    got = sorted([tuple(r)[:7] for r in rows], key=repr)
    assert got == sorted(benchmark_hits(docs, items), key=repr)
    assert all(sum(b - a for a, b in r.spans) == r.n_hit for r in rows)


def test_contamination_without_rows(spark, benchmark_case):
    docs, items = (spark.createDataFrame(rows, kind) for rows, kind in zip(benchmark_case, ("doc_id long, text string", "item_id long, text string")))
    assert contamination.contamination(docs.limit(0), items).count() == 0
    got = contamination.contamination(docs, items.limit(0)).collect()
    assert len(got) == len(benchmark_case[0]) and not any(r.contaminated or r.n_items for r in got)


@pytest.fixture(scope="module")
def audit_docs():
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "bcdfgé" for b in "aeiouÄ"]
    rows = []
    for lang, sources, n in (("en", 5, 300), ("de", 3, 90), (None, 1, 40), ("zz", 3, 6)):
        for i in range(n):
            source = None if i % 7 == 3 else f"s{min(rng.randrange(9), sources - 1)}"
            pick = [w for w in words if hash_of(w, source) % 4] or words
            rows.append((rng.choice([None, "", "12 _"]) if i % 9 == 0 else " ".join(rng.choice(pick).upper() if i % 5 else rng.choice(pick) for _ in range(rng.randint(1, 40))), lang, source))
    return rows + [rows[5]] * 40 + [("la " * 5000, "en", "s0"), (None, "fr", "x"), (None, "fr", None)]


def hash_of(word, source):
    return sum(map(ord, word + (source or "")))


@pytest.mark.parametrize("block, sources", [(divergence.BLOCK, divergence.SOURCES), (4, 2)])
def test_audit_equals_brute_force(spark, audit_docs, block, sources):
    frame = spark.createDataFrame([(*d, 1, "x", 2) for d in audit_docs], "text string, lang string, source string, n int, term string, at int").repartition(4)
    assert sorted(map(tuple, divergence.audit(frame, block=block, sources=sources).collect())) == audit_rows(audit_docs)
    assert divergence.audit(frame.limit(0)).count() == 0


def test_tree_nodes_are_shared_and_priced_once():
    counts = np.array([[1, 2, 1, 2, 1, 2, -1, -1], [0, 0, 0, 0, 3, 1, -1, -1], [1, 2, 1, 2, 1, 2, -1, -1]])
    trees = divergence.Trees(counts)
    assert trees.root[0] == trees.root[2] != trees.root[1]
    assert [len(left) for left, _, _ in trees.levels] == [4, 4, 2]  # of 12, 6 and 3 nodes
    price = [divergence.leaf_prices(trees.leaves, t, 6) for t in (9, 4, 9)]
    want = sum(abs(price[0][np.searchsorted(trees.leaves, a)] - price[1][np.searchsorted(trees.leaves, b)]) for a, b in zip(counts[0], counts[1]))
    assert trees.distance(0, 1, price[0], price[1]) == want and trees.distance(0, 2, price[0], price[2]) == 0
    big = divergence.leaf_prices(np.array([0, 10**13]), 10**14, 3)
    assert big.tolist() == [1 + 10**9 * (c + 5) // (10**14 + 15) for c in (0, 10**13)]
