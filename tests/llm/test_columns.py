"""Extra columns whose names clash with the operators' own, on rows that aren't empty, through every operator and stage."""

import public_tokenizers
import pytest
from llm import brute

import corpus_pipeline
from lumenfold.llm import avi, bpe, compression, langid, line_dedup, mixing, ngram_join, pii, quality_rules, token_counts

NAMES = ["size", "copies", "target", "source_size", "_row", "_id", "_hash", "row", "own", "hash", "id", "tie", "block", "lost", "lines", "at", "col", "set", "label", "cls", "place", "n_lines"]
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ADDED = {"size", "copies", "target", "source_size"}


def prose(seed, n=120):
    return " ".join(f"w{(seed * 7919 + i * i * 31) % 997}x{(seed + i) % 89}" for i in range(n))


@pytest.fixture(scope="module")
def rows():
    texts = [prose(k) for k in range(12)]
    return [(i, t, "en", ("web", None)[i % 2], len(t)) for i, t in enumerate(texts + texts[:3] + [texts[4] + " more"])] + [(3, texts[3], "en", None, 9), (None, prose(50), None, "web", 9), (40, None, "en", "web", None), (41, "", "en", "web", 0)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.selectExpr("*", *(f"concat('mine ', coalesce(doc_id, -1)) as `{c}`" for c in NAMES))


def mine(rows, names=NAMES):
    return all(r[c] == f"mine {-1 if r.doc_id is None else r.doc_id}" for r in rows for c in names)


def test_columns_stay(spark, docs, rows):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, label int")
    for made in (
        pii.find(docs), quality_rules.assess(docs), quality_rules.keep_good(docs), bpe.encode(docs, VOCABULARY), avi.content(avi.store(docs)),
        token_counts.count(docs, public_tokenizers.path("piece_bpe_32k.model")), langid.identify(docs, langid.fit(docs)), compression.score(docs, compression.fit(docs, labels)),
        ngram_join.keep_one(docs), mixing.mix(docs),
    ):
        found = made.collect()
        assert found and mine(found), made.columns
    assert mine(line_dedup.dedup_lines(docs).collect(), [c for c in NAMES if c != "n_lines"])
    planned = mixing.plan_copies(docs).collect()
    assert len(planned) == len(rows) and mine(planned, [c for c in NAMES if c not in ADDED]) and all(isinstance(r["size"], int) for r in planned)


def test_ids_of_other_types(spark, rows):
    texts = spark.createDataFrame([(None if r[0] is None else f"id{r[0]}", *r[1:4]) for r in rows], "doc_id string, text string, lang string, source string")
    sizes = brute.by_source([(r[3], len(brute.WORDS(r[1] or ""))) for r in rows])
    wanted = brute.targets(sizes)
    planned = mixing.plan_copies(texts).collect()
    assert len(planned) == len(rows) and all(r.target == pytest.approx(wanted[r.source]) and 0 <= r.copies <= 3 for r in planned)
    assert ngram_join.link(texts).count() == line_dedup.dedup_lines(texts).count() == len(rows)


def test_pipeline_takes_clashing_columns_and_repeats(spark, docs, tmp_path):
    docs.unionAll(docs.where("doc_id = 5")).write.parquet(str(tmp_path / "documents.parquet"))
    stages = []
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path))
        stages.append(frame.collect())
    kept, lines, single, mixed, encoded = stages
    assert [len(x) > 0 for x in stages] == [True] * 5
    assert all(mine(x) for x in (kept, lines, single, mixed))
    assert len({r.text for r in single}) == len(single) and {r.doc_id for r in encoded} == {r.doc_id for r in mixed}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(encoded)


def test_pipeline_of_nothing(spark, docs, tmp_path):
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("parts", [1, 9])
def test_targets_of_many_sources(spark, parts):
    """Weights follow the order of names over all parts of the table; the level is that of handing out the excess by hand."""
    from lumenfold.llm.common import Workspace

    for sizes in ({f"s{i * 37 % 101:03}": (i * i) % 17 * (50 if i % 9 == 0 else 1) for i in range(101)} | {None: 40}, {"a": 5}, {"a": 0, None: 0}, {"a": 1, "b": 1000, "c": 3}):
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(parts)
        found = {r.source: r.target for r in mixing.source_targets(frame, Workspace(spark, "targets")).collect()}
        assert found == pytest.approx(brute.targets(sizes))
