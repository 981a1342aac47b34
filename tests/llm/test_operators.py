"""Each operator against plain Python, on a fixture of awkward rows and on the small tables."""

import hashlib
import random

import public_tokenizers
import pytest
from conftest import SF_SMALL
from llm import brute
from tokenizers import Tokenizer

import corpus_pipeline
from lumenfold.llm import avi, bpe, compression, langid, line_dedup, mixing, ngram_join, pii, quality_rules, queries, token_counts

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Every operator must carry or replace columns of these names without a clash.
EXTRA = ["size", "row", "kept", "cls", "label", "lost", "spans", "ids", "score", "media"]


def texts() -> list[str | None]:
    rng = random.Random(5)
    names = ["alpha", "Beta", "gamma,", "don't", "x1", "été", "naïve", "日本", "a\tb", "42", "…", "ÄÖ", "<|endoftext|>", "é"]
    out: list[str | None] = [None, "", " \n\t ", "one", "two words", "Ünïcode — ok 😀", "x" * 30_000, "\n".join(["same line here"] * 40), "word " * 5000]
    for _ in range(60):
        lines = [" ".join(rng.choice(names) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 14))]
        out.append("\n".join(lines))
    long = " ".join(f"w{rng.randint(0, 400)}" for _ in range(300))
    out += [long, long, long.upper(), long + " tail", long.replace("w7 ", "q7 "), "\n".join(f"line {i} of the shared passage, with words" for i in range(6)) + "\nown end"]
    out += ["start\n" + "\n".join(f"line {i} of the shared passage, with words" for i in range(6))]
    mails = ["mail a.b@c-d.org or a.b @ c-d.org, ip 10.0.0.1 and 300.1.1.1.1", "card 4111 1111 1111 1111, then 4111.1111.1111.1111; +1 (555) 010-9999 now", "@" * 50 + "1.2.3" * 40, "+" * 30 + "1" * 40, "a" * 3000 + "@x"]
    return out + mails


@pytest.fixture(scope="module")
def rows():
    found = [(i, t, ("en", "fr", None)[i % 3], ("web", "books", None, "code")[i % 4]) for i, t in enumerate(texts())]
    return found + [found[20], found[20], (None, "null id here", "en", "web")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as bigint) as n_chars")
    return frame.selectExpr("*", *(f"'{c}' as {c}" for c in EXTRA))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


def pairs(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


def test_pii_base_is_the_patterns(docs, rows):
    found = pii.find(docs)
    assert "extra" not in found.columns and "row" in found.columns
    wanted = sorted(((i, t, [tuple(s) for s in brute.pii_base(t)]) for i, t, *_ in rows), key=repr)
    assert sorted(((r.doc_id, r.text, [tuple(s) for s in r.base_spans]) for r in found.collect()), key=repr) == wanted
    for r in found.collect():
        assert {tuple(s) for s in r.base_spans} <= {tuple(s) for s in r.spans}
        assert all(0 <= s.start < s.end <= len(r.text) for s in r.spans)


def test_pii_whole_table(documents):
    for r in pii.find(documents).collect():
        assert [tuple(s) for s in r.base_spans] == brute.pii_base(r.text)


def test_skip_links_spread_a_label():
    text = "write to jo.doe@site.org today; later jo.doe [at] site.org again"
    field = pii.Field({})
    base, spans = pii.find_spans(text, field)
    assert len(base) == 1 and len(spans) == 2


def test_skip_links_hold_on_large_tables(spark):
    runs = ["see jo [at] site.org", "ref 4111.1111.1111.1111 and 1-555-010-9998 here", "1-555-010-9997 or 1-555-010-9996", "+1 555 010 9999 or a@b.org"]
    linked = ["mail jo@site.org, jo [at] site.org", "card 4111 1111 1111 1111 and 4111.1111.1111.1111", "call +1 555 010 9999 now, 1-555-010-9999 or 1-555-010-9998"]
    field = pii.learn(spark.createDataFrame([(r,) for r in runs * 3000 + linked], "text string").repartition(4))
    for text, kinds in zip(linked, (["email"] * 2, ["card"] * 2, ["phone"] * 3)):
        assert [s[0] for s in pii.find_spans(text, field)[1]] == kinds
    assert [pii.find_spans(r, field)[1] for r in runs[:3]] == [[], [], []]


def test_quality_counts(docs, rows):
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    wanted = sorted(((i, *(brute.quality(t)[c] for c in columns)) for i, t, *_ in rows), key=repr)
    assert pairs(quality_rules.assess(docs), "doc_id", *columns) == wanted


def test_quality_keeps_columns(docs):
    assert quality_rules.keep_good(docs).columns == docs.columns


@pytest.mark.parametrize("words, percent", [(2, 50), (4, 85)])
def test_join_components(docs, rows, words, percent):
    # Rows sorted by id, those without one last, so that a group's first row has its least id.
    ordered = sorted(((i, t) for i, t, *_ in rows), key=lambda r: (r[0] is None, r[0] or 0))
    group = brute.near_groups(ordered, words, percent)
    wanted = sorted(((r[0], len(brute.shingles(r[1], words)), ordered[group[k]][0]) for k, r in enumerate(ordered)), key=repr)
    found = ngram_join.link(docs, ngram_join.Join(words, percent))
    assert pairs(found, "doc_id", "n_shingles", "component_id") == wanted


def test_join_keeps_one_of_each(documents):
    found = ngram_join.keep_one(documents)
    ordered = sorted((r.doc_id, r.text) for r in documents.select("doc_id", "text").collect())
    group = brute.near_groups(ordered, 5, 80)
    assert sorted(r.doc_id for r in found.collect()) == [ordered[k][0] for k in range(len(ordered)) if group[k] == k]
    assert found.columns == documents.columns


def test_line_windows(docs, rows):
    ordered = sorted({(i, t) for i, t, *_ in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    made = {r[0]: r for r in brute.line_dedup(ordered)}
    wanted = sorted((made[i] for i, *_ in rows), key=repr)
    assert pairs(line_dedup.dedup_lines(docs), "doc_id", "text", "n_lines", "n_removed") == wanted


def test_mix_targets_and_bounds(docs, rows):
    found = mixing.plan_copies(docs).collect()
    sizes = brute.by_source([(s, len(brute.WORDS(t or ""))) for _, t, _, s in rows])
    wanted = brute.targets(sizes)
    taken = brute.by_source([(r.source, r["size"] * r.copies) for r in found])
    longest = max(r["size"] for r in found)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(wanted[r.source]) and 0 <= r.copies <= 3
    assert all(abs(taken[s] - wanted[s]) <= 3 * longest for s in sizes)
    assert sorted(map(repr, found)) == sorted(map(repr, mixing.plan_copies(docs.repartition(7)).collect()))


def test_encoding_is_the_librarys(docs, documents):
    library = Tokenizer.from_file(VOCABULARY)
    library.no_truncation()
    library.no_padding()
    for frame in (docs, documents):
        for r in bpe.encode(frame, VOCABULARY).collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            assert r.ids == ids
            assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(docs, VOCABULARY).drop("decoded"), VOCABULARY).where("decoded is null").count() == 0


def test_media_round_trip(docs):
    for r in avi.content(avi.store(docs, keep=["doc_id", "text"]), keep=["text", "media"]).collect():
        data = (r.text or "").encode()
        size = max(576, -(-len(data) // 576) * 576)
        assert r.payload == data + b"\xff" * (size - len(data))
        assert r.frames == size // 576 and sum(c.frames for c in r.clips) == r.frames
        assert [c.start_s for c in r.clips][1:] == [c.end_s for c in r.clips][:-1]


def test_media_of_every_byte():
    payload = bytes(range(256)) * 9
    assert avi.read(avi.write(payload))["payload"] == payload
    with pytest.raises(ValueError):
        avi.read(b"RIFF")


def test_trie_scores_are_the_best_cuts():
    pieces = token_counts.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    counter = token_counts.Counter(pieces)
    words = sorted({"hello", "help", "helpless", "été", "日本語", "unbelievably", "x", "xyzzy", "a" * 60})
    for word, (tokens, score) in zip(words, counter.walk(words)):
        assert score == pytest.approx(brute.best_cut(token_counts.MARK + word, pieces, counter.byte))
        assert tokens >= 1


def test_token_counts_rows(docs, rows):
    found = token_counts.count(docs, public_tokenizers.path("piece_bpe_32k.model"))
    assert pairs(found, "doc_id", "n_words") == sorted(((i, len(brute.WORDS(t or ""))) for i, t, *_ in rows), key=repr)
    assert found.where("n_tokens < n_words or (n_words = 0 and n_tokens > 0)").count() == 0


def held_out_accuracy(spark, name, truth):
    return queries.QUERIES[name](spark, "/root/testdata/sf0.01").where("held_out").join(truth, "doc_id")


def test_compression_on_held_out_rows(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    rows = held_out_accuracy(spark, "op2_compression_quality", labels).collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.85 * len(rows) > 0


def test_language_on_held_out_rows(spark):
    langs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null").select("doc_id", "lang")
    rows = [r for r in held_out_accuracy(spark, "op6_word_first_language", langs).collect() if r.lang_pred != "und"]
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.9 * len(rows) > 0


def test_learned_operators_take_any_row(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, label int")
    scored = compression.score(docs, compression.fit(docs, labels))
    assert scored.count() == docs.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    assert compression.score(docs, compression.fit(docs, labels.limit(0))).where("score != 0.5").count() == 0
    found = langid.identify(docs, langid.fit(docs))
    assert found.count() == docs.count()
    assert found.where("(text is null or not text rlike '\\\\p{L}') != (lang_pred = 'und')").count() == 0


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], docs.schema)
    made = [
        pii.find(none), quality_rules.keep_good(none), ngram_join.link(none), ngram_join.keep_one(none), line_dedup.dedup_lines(none), mixing.mix(none), mixing.plan_copies(none),
        bpe.encode(none, VOCABULARY), avi.content(avi.store(none)), token_counts.count(none, public_tokenizers.path("piece_bpe_32k.model")),
        langid.identify(none, langid.fit(none)), compression.score(none, compression.fit(none, spark.createDataFrame([], "doc_id long, label int"))),
    ]
    assert [m.count() for m in made] == [0] * len(made)


def test_pipeline_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "source").collect()]
    kept = sorted(r for r in rows if brute.quality(r[1])["kept"])
    source = {r[0]: r[2] for r in kept}
    lines = [(i, t) for i, t, n, gone in brute.line_dedup([r[:2] for r in kept]) if not (gone and gone == n)]
    group = brute.near_groups(lines, 5, 80)
    single = {lines[k][0]: lines[k][1] for k in range(len(lines)) if group[k] == k}
    library = Tokenizer.from_file(VOCABULARY)
    library.no_truncation()
    library.no_padding()
    mixed = corpus_pipeline.run(spark, SF_SMALL).collect()
    taken = {}
    for r in mixed:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
    assert set(taken) <= set(single) and max(taken.values()) <= 3
    want = brute.targets(brute.by_source([(source[i], len(brute.WORDS(t))) for i, t in single.items()]))
    got = brute.by_source([(source[i], n * len(brute.WORDS(single[i]))) for i, n in taken.items()])
    longest = max(len(brute.WORDS(t)) for t in single.values())
    assert all(abs(got.get(s, 0) - want[s]) <= 3 * longest for s in want)
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in single.items() if i in taken}
    assert all(r.ids == ids[r.doc_id] and r.n_tokens == len(r.ids) and r.source == source[r.doc_id] for r in mixed)


def test_digests_of_the_queries(spark):
    row = queries.QUERIES["op5_avi_motion_jpeg"](spark, SF_SMALL).orderBy("doc_id").first()
    text = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where(f"doc_id = {row.doc_id}").first().text
    data = text.encode()
    payload = data + b"\xff" * (row.payload_bytes - len(data))
    assert row.payload_sha256 == hashlib.sha256(payload).hexdigest()
