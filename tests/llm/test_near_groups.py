"""Groups of near copies: every link is found, and rows grow with the group and not with its pairs."""

import random

import numpy as np
import pytest
from llm import brute
from pyspark.sql import functions as F

from lumenfold.llm import common, components, ngram_join


def near_copies(size, edits, words=400, seed=11):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    rows = []
    for i in range(size):
        text = base.copy()
        for _ in range(rng.randint(*edits)):
            text[rng.randrange(words)] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(text)))
    return rows


def counted(spark, monkeypatch, rows):
    """The result, and the rows of each table that the join writes."""
    sizes, save = {}, common.Workspace.save

    def spy(self, frame, name):
        table = save(self, frame, name)
        sizes[name] = table.count()
        return table

    monkeypatch.setattr(common.Workspace, "save", spy)
    found = ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string"))
    return {r.doc_id: r.component_id for r in found.collect()}, sizes


@pytest.mark.parametrize("edits", [(6, 10), (3, 12)])
def test_rows_grow_with_the_group(spark, monkeypatch, edits):
    made = {}
    for size in (100, 400):
        rows = near_copies(size, edits)
        found, made[size] = counted(spark, monkeypatch, rows)
        group = brute.near_groups(rows, 5, 80)
        assert found == {i: group[i] for i in range(size)}
        assert made[size]["near"] <= 12 * size and made[size]["links"] <= 3 * size
    for name in ("near", "members", "links"):
        assert made[400].get(name, 0) <= 6 * max(made[100].get(name, 0), 10)


@pytest.mark.parametrize("block", [4, 32])
def test_small_blocks_lose_nothing(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = near_copies(60, (2, 12), words=120) + [(100 + i, t) for i, t in near_copies(20, (0, 6), words=90, seed=5)]
    group = brute.near_groups(rows, 5, 80)
    found = ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: rows[group[k]][0] for k, (i, _) in enumerate(rows)}


def test_classes_with_one_hash_are_told_apart(spark, monkeypatch):
    real = ngram_join.sign

    def clashing(documents, join, keep):
        return real(documents, join, keep).withColumn("cls", F.when(F.col("cls").isNotNull(), F.lit(7).cast("long")))

    monkeypatch.setattr(ngram_join, "sign", clashing)
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (2, b), (3, a + " end"), (4, b), (5, None)]
    found = ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 2, 3: 1, 4: 2, 5: 5}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "empty"])
def test_components(spark, shape):
    rng = np.random.default_rng(2)
    names = rng.permutation(3000).tolist()
    edges = {
        "chain": list(zip(names[:700], names[1:701])),
        "star": [(names[0], x) for x in names[1:500]],
        "random": [tuple(map(int, rng.integers(0, 2000, 2))) for _ in range(900)],
        "empty": [],
    }[shape]
    best = {}
    for a, b in edges:
        if a != b:
            best.setdefault(a, a), best.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and best[a] != best[b]:
                best[a] = best[b] = min(best[a], best[b])
                changed = True
    work = common.Workspace(spark, "test-components")
    found = components.components(spark.createDataFrame(edges, "a long, b long"), work, "c")
    assert sorted((r.node, r.label) for r in found.collect()) == sorted(best.items())


def test_rows_moved_double_with_a_dense_group(spark, monkeypatch):
    """What is dealt to be compared - rows, pivots and what these don't settle - grows with the group and not with its blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    moved, spanning, save = {}, ngram_join._spanning, common.Workspace.save
    for size in (150, 300):
        counts = []

        def counted_dealt(dealt, join, exact=False, counts=counts):
            counts.append(dealt.count())
            return spanning(dealt, join, exact)

        def spy(self, frame, name, counts=counts):
            table = save(self, frame, name)
            if name.endswith("-pivots"):
                counts.append(table.count())
            return table

        monkeypatch.setattr(ngram_join, "_spanning", counted_dealt)
        monkeypatch.setattr(common.Workspace, "save", spy)
        rows = near_copies(size, (2, 4))
        found = {r.doc_id: r.component_id for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        group = brute.near_groups(rows, 5, 80)
        assert found == {i: group[i] for i in range(size)} and len(set(found.values())) == 1
        moved[size] = sum(counts)
    assert moved[300] <= 2.3 * moved[150], moved
