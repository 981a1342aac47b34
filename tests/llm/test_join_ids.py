"""keep_one judges rows by their texts, whatever their ids."""

from collections import Counter

from lumenfold.llm import ngram_join

WORDS = [f"w{i}" for i in range(80)]


def kept(spark, rows):
    return Counter(tuple(r) for r in ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_equal_ids_and_missing_ids(spark):
    a, b, c, d = " ".join(WORDS), " ".join(WORDS[::-1]), " ".join(WORDS[::2] + WORDS[1::2]), " ".join(WORDS[::3] + WORDS[1::3])
    rows = [(5, a), (5, b), (None, c), (None, c), (None, c + " end"), (7, d), (7, d), (8, d), (None, None), (None, None), (5, "")]
    found = kept(spark, rows)
    assert found[5, a] == found[5, b] == 1
    assert found[None, c] + found[None, c + " end"] == 1
    assert found[7, d] == 1 and (8, d) not in found
    assert found[None, None] == 2 and found[5, ""] == 1
    assert sum(found.values()) == 7
