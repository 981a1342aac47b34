"""Every labelled language is learned, however rare."""

import numpy as np

from lumenfold.llm import langid


def test_rare_language_is_learned(spark):
    # One in 4,001 rows is rare; a sample of 50 rows over all languages together leaves it out.
    common = [(i, f"the cat and the dog number{chr(97 + i % 26)} walk{chr(97 + i % 23)}", "en") for i in range(4000)]
    rare = [(9000, "kissa ja koira kulkevat talossa", "fi")]
    docs = spark.createDataFrame(common + rare, "doc_id long, text string, lang string")
    model = langid.fit(docs, langid.Sample(rows=50, words=8, ngrams=60))
    assert model.languages == ["en", "fi"]
    assert model.predict(["koira ja kissa", "the dog and the cat"])[0] == ["fi", "en"]
    assert len(model.words) <= 16


def test_a_rare_language_does_not_take_others_words():
    words = {f"word{i}": np.array([3.0, 0.0]) for i in range(5000)} | {w: np.array([0.0, 1.0]) for w in ("kissa", "ja", "koira")}
    model = langid.Model(["en", "fi"], words, langid.Sample())
    assert model.predict(["word17 word4000", "kissa ja koira"])[0] == ["en", "fi"]


def test_limits_by_language():
    assert langid._cut({3: 2, 1: 10}, 12) == (0, 0.0)
    assert langid._cut({3: 2, 1: 10}, 7) == (1, 0.5)
    assert langid.Sample().each(60_000, 4) == 60_000 and langid.Sample().each(60_000, 200) == 200


def test_more_languages_than_a_model_holds(spark, monkeypatch):
    """Labels typed by hand: those with the most documents are learned, equal ones by name, and others' rows don't count."""
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    rows = [(i, f"word{chr(97 + i % 20)} in en", "en") for i in range(40)] + [(100 + i, f"sana{chr(97 + i % 20)} on fi", "fi") for i in range(30)]
    rows += [(200 + i, "typo once", f"x{i:02}") for i in range(25)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["en", "fi", "x00"] and model.predict(["sanaa on", "worda in"])[0] == ["fi", "en"]
