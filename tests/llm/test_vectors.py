"""Operators on embeddings against plain Python and numpy: awkward rows, ties, repeats, clashing columns, empty tables."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from lumenfold.llm import impact_search, queries, vector_codes, whitening
from lumenfold.llm.common import Workspace

NAN, INF = float("nan"), float("inf")
CLASHING = ["x", "row", "code", "error", "label_error", "component", "n", "deviation", "whitened", "block", "lane", "id", "way", "of", "own", "white"]


def vectors(n, length, seed=3):
    rng = random.Random(seed)
    return [[rng.gauss(0, 0.2) for _ in range(length)] for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    good = vectors(330, 32)
    good[7] = good[8] = good[9]  # ties
    good[11] = [0.0] * 32
    good[12] = [v * 40 for v in good[12]]  # one long vector
    found = [(i, v, (i % 4 if i % 3 else None)) for i, v in enumerate(good)]
    bad = [(1000, None, 1), (1001, [], 1), (1002, [None] + good[0][1:], 1), (1003, [NAN] + good[0][1:], None), (1050, [INF] + good[0][1:], 1), (1100, good[0][:16], 1), (1150, [1e30] + good[0][1:], 2)]
    return found + bad + [found[50], found[50]]


@pytest.fixture(scope="module")
def frame(spark, rows):
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return made.selectExpr("*", *(f"concat('mine ', vec_id) as `{c}`" for c in CLASHING)).repartition(3)


def kept(rows, scale):
    ok = lambda v: v is not None and len(v) == 32 and all(c is not None and math.isfinite(c) and abs(c) < 1e20 for c in v)
    return [(i, [math.floor(scale * c) for c in v], label) for i, v, label in rows if ok(v)]


def codes_by_hand(rows):
    """(codebooks, [(id, code, error)]) with every distance computed."""
    found = kept(rows, 256)
    first = sorted(found, key=lambda r: (r[0], r[1]))[:64]
    parts = lambda x: [x[p * 2 : p * 2 + 2] for p in range(16)]
    books = [[parts(x)[p] for _, x, _ in first] for p in range(16)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(book))

    for _ in range(2):
        for p in range(16):
            mine = [[] for _ in books[p]]
            for _, x, _ in found:
                mine[nearest(parts(x)[p], books[p])[1]].append(parts(x)[p])
            books[p] = [[sum(c) // len(own) for c in zip(*own)] if own else was for own, was in zip(mine, books[p])]
    coded = []
    for i, x, label in found:
        best = [nearest(part, books[p]) for p, part in enumerate(parts(x))]
        coded.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label))
    return books, coded


def test_codes(frame, rows):
    books = vector_codes.fit(frame)
    by_hand, coded = codes_by_hand(rows)
    assert books.entries.tolist() == by_hand
    assert books.sha256() == hashlib.sha256(",".join(str(c) for b in by_hand for e in b for c in e).encode()).hexdigest()
    found = vector_codes.with_label_errors(vector_codes.encode(frame, books)).collect()
    sums = {}
    for _, _, error, label in coded:
        sums[label] = sums.get(label, 0) + error
    wanted = sorted((*c, sums[c[3]]) for c in coded if c[3] is not None) + sorted((i, c, e, sums[None]) for i, c, e, lab in coded if lab is None)
    got = [(r.vec_id, r.code, r.error, r.label, r.label_error) for r in found]
    assert sorted(g for g in got if g[3] is not None) + sorted((g[0], g[1], g[2], g[4]) for g in got if g[3] is None) == wanted
    assert all(r["x"] == r["row"] == f"mine {r.vec_id}" for r in found)


@pytest.mark.parametrize("spread", [1, 3, 90, 5000])
def test_cells_never_miss_the_nearest(spread):
    rng = np.random.default_rng(spread)
    entries, parts = rng.integers(-spread, spread + 1, (64, 4)), rng.integers(-2 * spread, 2 * spread + 1, (3000, 4))
    cells = vector_codes.Cells(entries)
    index, distance, refined = cells.nearest(parts)
    every = ((parts[:, None] - entries[None]) ** 2).sum(-1)
    lower, upper = cells.bounds(parts)
    assert (lower <= every).all() and (every <= upper).all()
    assert (index == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert spread < 50 or refined < len(parts) * 8  # the filter leaves few of 64


def test_whitening(frame, rows):
    made = whitening.fit(frame)
    found = whitening.whiten(frame, made).collect()
    every = kept(rows, 64)
    distinct = {tuple(x) for _, x, _ in every}
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    x = np.array(sorted(distinct), float)
    covariance = np.cov(x.T, bias=True)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:16], axes[:, ::-1][:, :16]
    assert len(found) == 16 * len(every) and {r.n for r in found} == {n} and max(r.identity_error for r in found) < 1e-9
    exact = {}
    for i, v, _ in every:
        exact.setdefault(i, sum((n * (c + 10**6) - (s + n * 10**6)) ** 2 for c, s in zip(v, sums)))
    assert {r.vec_id: r.deviation for r in found} == exact
    explained = {r.component: r.explained for r in found}
    assert [explained[c + 1] for c in range(16)] == pytest.approx(list(values / np.trace(covariance)), rel=1e-9)
    wanted = {i: (np.array(v) - np.array(sums) / n) @ axes / np.sqrt(values) for i, v, _ in every}
    for c in range(1, 17):
        got = {r.vec_id: r.whitened for r in found if r.component == c}
        sign = np.sign(sum(got[i] * wanted[i][c - 1] for i in got))
        assert all(got[i] == pytest.approx(sign * wanted[i][c - 1], abs=1e-7) for i in got)
    assert all(r["row"] == r["x"] == f"mine {r.vec_id}" for r in found)


def test_whitening_of_few_vectors(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.5, 0.0]), (2, [1.0, -0.5, 0.0]), (3, [1.0, -0.5, 0.0])], "vec_id long, embedding array<float>")
    found = {(r.vec_id, r.component): r for r in whitening.whiten(frame, whitening.fit(frame)).collect()}
    assert len(found) == 9 and abs(found[1, 1].whitened) == pytest.approx(1) and found[2, 1].whitened == found[3, 1].whitened == pytest.approx(-found[1, 1].whitened)
    assert found[1, 2].whitened is None and found[1, 2].explained == 0 and found[1, 1].explained == 1 and found[1, 1].identity_error < 1e-12
    same = frame.where("vec_id > 1")
    assert {(r.whitened, r.deviation, r.identity_error) for r in whitening.whiten(same, whitening.fit(same)).collect()} == {(None, 0, 0.0)}


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(1)
    scale = 10.0 ** np.arange(0, -14, -1)
    inner = rng.normal(size=(14, 14))
    inner = inner @ inner.T / 14 + np.eye(14)
    graded = np.sqrt(scale)[:, None] * inner * np.sqrt(scale)[None, :]
    values, axes = whitening.jacobi(graded)
    assert np.abs(axes.T @ axes - np.eye(14)).max() < 1e-13
    # Each small eigenvalue to a relative accuracy, by exact arithmetic: the determinant is their product.
    exact = [[Fraction(v) for v in row] for row in graded.tolist()]
    determinant = Fraction(1)
    for i in range(14):
        determinant *= exact[i][i]
        for j in range(i + 1, 14):
            factor = exact[j][i] / exact[i][i]
            exact[j] = [a - factor * b for a, b in zip(exact[j], exact[i])]
    assert math.prod(values) == pytest.approx(float(determinant), rel=1e-10)


@pytest.mark.parametrize("block,lane,k", [(40, 3, 5), (10**6, 512, 5), (100, 2, 400), (7, 50, 1)])
def test_search(spark, frame, rows, block, lane, k):
    index = impact_search.build(frame, Workspace(spark, "test"), block=block)
    found = impact_search.search(index, frame.where("vec_id % 50 = 0"), k=k, lane=lane)
    every = sorted({(i, tuple(x)) for i, x, _ in kept(rows, 256)})
    wanted = []
    for q, x in every:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in every if i != q)[:k]
            wanted += [(q, rank, i, -score) for rank, (score, i) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect()) == sorted(wanted)


def test_search_leaves_out_what_it_can_prove():
    """On clustered vectors the search stops early; on any, it finds what scoring all finds."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 64)) * 30
    x = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 64)) * 6).astype(np.int64)
    ids = np.arange(4000)
    block = impact_search.Segments.build(ids, x)
    found, adds, rescored = block.search(ids[:100], x[:100], 5)
    assert adds < 0.9 * 100 * 4000 * 64 and rescored < 0.2 * 100 * 4000
    for q, (best, scores) in enumerate(found):
        every = x @ x[q]
        every[q] = -(10**15)
        assert best.tolist() == np.lexsort((ids, -every))[:5].tolist() and scores.tolist() == sorted(every, reverse=True)[:5]


def test_empty_tables(spark, frame, tmp_path):
    for empty in (frame.limit(0), frame.where("vec_id = 1000")):
        assert vector_codes.with_label_errors(vector_codes.encode(empty, vector_codes.fit(empty))).collect() == []
        assert whitening.whiten(empty, whitening.fit(empty)).collect() == []
        assert impact_search.search(impact_search.build(empty, Workspace(spark, "test")), empty).collect() == []
    frame.select("vec_id", "embedding", "label").limit(0).write.parquet(str(tmp_path / "embeddings.parquet"))
    for name in ("op11_va_file_codes", "op12_jacobi_whitening", "op13_impact_ordered_search"):
        assert queries.QUERIES[name](spark, str(tmp_path)).collect() == []
