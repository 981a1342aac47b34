"""Sentiment of texts by rule: a lexicon's valences, changed by the words around them.

A word's valence is moved by capitals where others aren't in capitals, by up to three words before it that boost or
dampen (those farther off less) or negate, and by "no" and "least"; what comes before "but" counts half and what comes
after half as much again; exclamation and question marks push the sum on. s / sqrt(s^2 + 15) is the compound. The weights
are those of the published rule set (Hutto and Gilbert, ICWSM 2014); its few whole idioms aren't part of this.

The rules look at neighbours. ``of_texts`` scores texts where they lie, many at a time, by a lexicon that each task holds
(``held``). Where a lexicon is too large for that, ``compounds`` joins it as a table: words are one window a text, in order.
"""

from __future__ import annotations

import string
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators.words import _rounded

# The weights of the rules.
BOOST, CAPITALS, NEGATION, NEVER_SO = 0.293, 0.733, -0.74, 1.25
FARTHER = (1.0, 0.95, 0.9)
EXCLAMATION, MOST_EXCLAMATIONS, QUESTION, MANY_QUESTIONS = 0.292, 4, 0.18, 0.96
NORM = 15.0
# Words that boost, that dampen, and that negate (and negated verbs, with and without apostrophe).
BOOSTERS = (
    "absolutely", "amazingly", "awfully", "completely", "considerable", "considerably", "decidedly", "deeply", "enormous", "enormously", "entirely", "especially", "exceptional", "exceptionally",
    "extreme", "extremely", "fabulously", "fully", "greatly", "hella", "highly", "hugely", "incredible", "incredibly", "intensely", "major", "majorly", "more", "most", "particularly", "purely", "quite",
    "really", "remarkably", "so", "substantially", "thoroughly", "total", "totally", "tremendous", "tremendously", "uber", "unbelievably", "unusually", "utter", "utterly", "very",
)
DAMPENERS = (
    "almost", "barely", "hardly", "kinda", "kindof", "kind-of", "less", "little", "marginal", "marginally", "occasional", "occasionally", "partly", "scarce", "scarcely", "slight", "slightly", "somewhat",
    "sorta", "sortof", "sort-of",
)
NEGATIONS = ("cannot", "neither", "never", "none", "nope", "nor", "not", "nothing", "nowhere", "uhuh", "uh-uh", "without", "rarely", "seldom", "despite")
NEGATED_VERBS = ("ai", "are", "ca", "could", "dare", "did", "do", "does", "had", "has", "have", "is", "might", "must", "need", "ought", "sha", "should", "was", "were", "wo", "would")
NEGATORS = (*NEGATIONS, *(f"{v}nt" for v in NEGATED_VERBS))

#: The most words of a lexicon that tasks hold, and bytes of text whose words are scored at a time.
MOST_HELD, BATCH_BYTES = 200_000, 4 << 20

# What the rules ask of a word, as bits.
PRESENT, LISTED, UPPER, BOOSTS, DAMPENS, NEGATES, NO, OR, NEVER, SO, WITHOUT, DOUBT, LEAST, AT, BUT, KIND, OF = (1 << i for i in range(17))
_ASKED = {
    BOOSTS: BOOSTERS, DAMPENS: DAMPENERS, NEGATES: NEGATORS, NO: ("no",), OR: ("or", "nor"), NEVER: ("never",), SO: ("so", "this"), WITHOUT: ("without",), DOUBT: ("doubt",),
    LEAST: ("least",), AT: ("at", "very"), BUT: ("but",), KIND: ("kind",), OF: ("of",),
}
_SIGNS = {w: sum(sign for sign, words in _ASKED.items() if w in words) for listed in _ASKED.values() for w in listed}

BLANKS = r"[ \t\n\r\f]+"
EDGES = r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$"


def _negates(word: Column) -> Column:
    return word.isin(*NEGATORS) | word.contains("n't")


def _valences(words: DataFrame) -> DataFrame:
    """``words`` with v: a listed word's valence after the rules; ``p1`` to ``p3`` are the words before it, ``next`` the one after, as structs.

    A word before it gives three numbers that don't depend on v - what it adds by its sense, by its capitals, and the factor
    after that - so each rule is one projection.
    """
    p = {k: F.col(f"p{k}") for k in (1, 2, 3)}

    def is_(k: int, *words: str) -> Column:
        return F.coalesce(p[k]["low"].isin(*words), F.lit(False))

    no = is_(1, "no") | is_(2, "no") | (is_(3, "no") & is_(1, "or", "nor"))
    v = F.when(no, F.col("valence") * NEGATION).when((F.col("low") == "no") & F.coalesce(F.col("next.listed"), F.lit(False)), 0.0).otherwise(F.col("valence"))
    so = {1: F.lit(False), 2: is_(2, "never") & is_(1, "so", "this"), 3: is_(3, "never") & (is_(2, "so", "this") | is_(1, "so", "this"))}
    doubt = {1: F.lit(False), 2: is_(2, "without") & is_(1, "doubt"), 3: is_(3, "without") & (is_(2, "doubt") | is_(1, "doubt"))}
    words = words.withColumns({"v": v, "own": F.when(F.col("upper") & F.col("mixed"), CAPITALS).otherwise(0.0)})
    words = words.withColumn("v", F.col("v") + F.when(F.col("v") > 0, F.col("own")).otherwise(-F.col("own")))
    for k in p:
        bare = F.coalesce(~p[k]["listed"], F.lit(False))
        sense = F.when(bare & is_(k, *BOOSTERS), BOOST).when(bare & is_(k, *DAMPENERS), -BOOST).otherwise(0.0) * FARTHER[k - 1]
        loud = F.when(bare & is_(k, *BOOSTERS, *DAMPENERS) & p[k]["upper"] & F.col("mixed"), CAPITALS * FARTHER[k - 1]).otherwise(0.0)
        factor = F.when(~bare | doubt[k], F.when(bare & so[k], NEVER_SO).otherwise(1.0)).when(so[k], NEVER_SO).when(_negates(p[k]["low"]), NEGATION).otherwise(1.0)
        words = words.withColumns({"sense": sense, "loud": loud, "factor": factor})
        moved = F.col("v") + F.when(F.col("v") < 0, -F.col("sense")).otherwise(F.col("sense")) + F.when(F.col("v") > 0, F.col("loud")).otherwise(-F.col("loud"))
        words = words.withColumn("v", moved * F.col("factor"))
    least = is_(1, "least") & ~F.coalesce(p[1]["listed"], F.lit(False)) & ~is_(2, "at", "very")
    return words.withColumn("v", F.when(least, F.col("v") * NEGATION).otherwise(F.col("v")))


def compounds(texts: DataFrame, lexicon: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, compound) of each text that has a word, by a lexicon(word, valence), rounded to 4 places; ``keys`` tell texts apart."""
    split = F.filter(F.split(text, BLANKS), lambda w: w != "")
    marks = [F.regexp_count(text, F.lit(m)).alias(n) for m, n in (("!", "bangs"), (r"\?", "asks"))]
    words = texts.select(*keys, *marks, F.posexplode(split).alias("pos", "raw"))
    bare = F.regexp_replace("raw", EDGES, "")
    words = words.withColumn("token", F.when(F.length(bare) > 2, bare).otherwise(F.col("raw"))).withColumn("low", F.lower("token"))
    words = words.withColumn("upper", (F.upper("token") == F.col("token")) & (F.col("low") != F.col("token"))).drop("raw", "token")
    words = words.join(lexicon.select(F.col("word").alias("low"), "valence"), "low", "left").withColumn("listed", F.col("valence").isNotNull())

    whole = Window.partitionBy(*keys)
    order = whole.orderBy("pos")
    around = F.struct("low", "upper", "listed")
    words = words.select("*", *(F.lag(around, k).over(order).alias(f"p{k}") for k in (1, 2, 3)), F.lead(around).over(order).alias("next"))
    words = words.select(
        "*", F.count_if("upper").over(whole).alias("capitals"), F.count("*").over(whole).alias("n"), F.min(F.when(F.col("low") == "but", F.col("pos"))).over(whole).alias("but")
    )
    plain = (F.col("low") == "kind") & F.coalesce(F.col("next.low") == "of", F.lit(False))
    scored = F.col("listed") & ~F.col("low").isin(*BOOSTERS, *DAMPENERS) & ~plain
    words = _valences(words.withColumn("mixed", (F.col("capitals") > 0) & (F.col("capitals") < F.col("n"))).withColumn("scored", scored))
    turned = F.when(F.col("pos") < F.col("but"), 0.5).when(F.col("pos") > F.col("but"), 1.5).otherwise(1.0)
    sums = words.groupBy(*keys).agg(F.sum(F.when(F.col("scored"), F.col("v") * turned).otherwise(0.0)).alias("s"), F.first("bangs").alias("bangs"), F.first("asks").alias("asks"))
    push = F.least("bangs", F.lit(MOST_EXCLAMATIONS)) * EXCLAMATION + F.when(F.col("asks") > 3, MANY_QUESTIONS).when(F.col("asks") > 1, F.col("asks") * QUESTION).otherwise(0.0)
    s = F.col("s") + F.when(F.col("s") > 0, push).when(F.col("s") < 0, -push).otherwise(0.0)
    sums = sums.select(*keys, s.alias("s"))
    return sums.select(*keys, F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("s") / F.sqrt(F.col("s") * F.col("s") + NORM))), 4).alias("compound"))


def held(lexicon: DataFrame) -> dict[str, float] | None:
    """A lexicon(word, valence) for ``of_texts``; None where it has more than MOST_HELD words or a word twice, and must be joined."""
    rows = lexicon.where("word IS NOT NULL AND valence IS NOT NULL").select("word", F.col("valence").cast("double")).limit(MOST_HELD + 1).toArrow()
    found = dict(zip(*(c.to_pylist() for c in rows.columns)))
    return found if len(found) == rows.num_rows <= MOST_HELD else None


def of_texts(texts: pa.Array, lexicon: Mapping[str, float]) -> np.ndarray:
    """``compounds`` of texts in a task, by a lexicon that it holds; NaN where a text has no word."""
    part = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // BATCH_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(texts)]
    return np.concatenate([np.empty(0), *(_of_batch(texts.slice(a, b - a), lexicon) for a, b in zip(cuts, cuts[1:]) if b > a)])


def _of_batch(texts: pa.Array, lexicon: Mapping[str, float]) -> np.ndarray:
    """The rules for all words of some texts at once: each form of a word is looked up once, and neighbours are the places before and after."""
    words = pc.split_pattern_regex(texts, BLANKS)
    of, raw = pc.list_parent_indices(words).to_numpy(), words.flatten()
    filled = pc.not_equal(raw, "")
    of, forms = of[filled.to_numpy(zero_copy_only=False)], raw.filter(filled).dictionary_encode()
    n = np.bincount(of, minlength=len(texts))
    code, first = forms.indices.to_numpy(), np.cumsum(n) - n
    signs, valences = np.zeros(len(forms.dictionary), np.int32), np.zeros(len(forms.dictionary))
    for i, form in enumerate(forms.dictionary.to_numpy(zero_copy_only=False).tolist()):
        bare = form.strip(string.punctuation)
        token = bare if len(bare) > 2 else form
        low = token.lower()
        valence = lexicon.get(low)
        if valence is not None:
            valences[i] = valence
        signs[i] = PRESENT | _SIGNS.get(low, 0) | (valence is not None and LISTED) | ("n't" in low and NEGATES) | (low != token and token.upper() == token and UPPER)
    sign = signs[code]
    capitals = np.bincount(of[(sign & UPPER) > 0], minlength=len(texts))
    but = np.full(len(texts), -1)
    turns = np.flatnonzero(sign & BUT)[::-1]
    but[of[turns]] = turns

    at = np.flatnonzero((sign & (LISTED | BOOSTS | DAMPENS)) == LISTED)
    own, low, high = sign[at], first[of[at]], (first + n)[of[at]]

    def near(step: int) -> np.ndarray:
        """The signs of the word so far off, 0 beyond the text."""
        there = at + step
        return np.where((there >= low) & (there < high), sign[np.clip(there, 0, len(sign) - 1)], 0)

    p, after = {k: near(-k) for k in (1, 2, 3)}, near(1)

    def is_(k: int, which: int) -> np.ndarray:
        return (p[k] & which) > 0

    v, mixed = valences[code[at]], ((capitals > 0) & (capitals < n))[of[at]]
    no = is_(1, NO) | is_(2, NO) | (is_(3, NO) & is_(1, OR))
    v = np.where(no, v * NEGATION, np.where(((own & NO) > 0) & ((after & LISTED) > 0), 0.0, v))
    loud = np.where(((own & UPPER) > 0) & mixed, CAPITALS, 0.0)
    v = v + np.where(v > 0, loud, -loud)
    none = np.zeros(len(at), bool)
    so = {1: none, 2: is_(2, NEVER) & is_(1, SO), 3: is_(3, NEVER) & (is_(2, SO) | is_(1, SO))}
    doubt = {1: none, 2: is_(2, WITHOUT) & is_(1, DOUBT), 3: is_(3, WITHOUT) & (is_(2, DOUBT) | is_(1, DOUBT))}
    for k in p:
        bare = (p[k] & (PRESENT | LISTED)) == PRESENT
        sense = np.where(bare & is_(k, BOOSTS), BOOST, np.where(bare & is_(k, DAMPENS), -BOOST, 0.0)) * FARTHER[k - 1]
        loud = np.where(bare & is_(k, BOOSTS | DAMPENS) & is_(k, UPPER) & mixed, CAPITALS * FARTHER[k - 1], 0.0)
        factor = np.where(bare & so[k], NEVER_SO, np.where(bare & ~doubt[k] & is_(k, NEGATES), NEGATION, 1.0))
        v = (v + np.where(v < 0, -sense, sense) + np.where(v > 0, loud, -loud)) * factor
    v = np.where(is_(1, LEAST) & ((p[1] & LISTED) == 0) & ~is_(2, AT), v * NEGATION, v)
    turn = but[of[at]]
    v = v * np.where(turn < 0, 1.0, np.where(at < turn, 0.5, np.where(at > turn, 1.5, 1.0)))
    scored = ((own & KIND) == 0) | ((after & OF) == 0)
    s = np.bincount(of[at], np.where(scored, v, 0.0), len(texts))
    bangs, asks = (pc.fill_null(pc.count_substring(texts, m), 0).to_numpy(zero_copy_only=False) for m in "!?")
    push = np.minimum(bangs, MOST_EXCLAMATIONS) * EXCLAMATION + np.where(asks > 3, MANY_QUESTIONS, np.where(asks > 1, asks * QUESTION, 0.0))
    s = s + np.where(s > 0, push, np.where(s < 0, -push, 0.0))
    return np.where(n > 0, _rounded(np.fmax(-1.0, np.fmin(1.0, s / np.sqrt(s * s + NORM)))), np.nan)


def compounds_sql(source: str, keys: str) -> str:
    """The same as common table expressions of DuckDB over ``source``(keys, text) and lexicon(word, valence); the last is ``compounds``."""

    def listed(words: tuple[str, ...]) -> str:
        return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"

    def is_(k: int, *words: str) -> str:
        return f"coalesce(p{k}.low IN {listed(words)}, false)"

    boost, damp = listed(BOOSTERS), listed(DAMPENERS)
    steps = [
        f"CASE WHEN {is_(1, 'no')} OR {is_(2, 'no')} OR ({is_(3, 'no')} AND {is_(1, 'or', 'nor')}) THEN valence * {NEGATION} WHEN low = 'no' AND coalesce(nxt.listed, false) THEN 0.0 ELSE valence END",
        f"CASE WHEN upper AND diff THEN v + CASE WHEN v > 0 THEN {CAPITALS} ELSE -{CAPITALS} END ELSE v END",
    ]
    so = {2: f"{is_(2, 'never')} AND {is_(1, 'so', 'this')}", 3: f"{is_(3, 'never')} AND ({is_(2, 'so', 'this')} OR {is_(1, 'so', 'this')})"}
    doubt = {2: f"{is_(2, 'without')} AND {is_(1, 'doubt')}", 3: f"{is_(3, 'without')} AND ({is_(2, 'doubt')} OR {is_(1, 'doubt')})"}
    for k in (1, 2, 3):
        scale = f"CASE WHEN p{k}.low IN {boost} THEN {BOOST} WHEN p{k}.low IN {damp} THEN -{BOOST} END"
        capital = f"CASE WHEN p{k}.upper AND diff THEN CASE WHEN v > 0 THEN {CAPITALS} ELSE -{CAPITALS} END ELSE 0 END"
        moved = f"(v + coalesce((CASE WHEN v < 0 THEN -1 ELSE 1 END * ({scale}) + {capital}) * {FARTHER[k - 1]}, 0))"
        negates = f"coalesce(p{k}.low IN {listed(NEGATORS)} OR contains(p{k}.low, 'n''t'), false)"
        special = f"WHEN {so[k]} THEN {moved} * {NEVER_SO} WHEN {doubt[k]} THEN {moved}" if k > 1 else ""
        steps.append(f"CASE WHEN NOT coalesce(NOT p{k}.listed, false) THEN v {special} WHEN {negates} THEN {moved} * {NEGATION} ELSE {moved} END")
    steps.append(f"CASE WHEN {is_(1, 'least')} AND NOT coalesce(p1.listed, false) AND NOT {is_(2, 'at', 'very')} THEN v * {NEGATION} ELSE v END")
    made = [f"v{i} AS (SELECT * {'' if i == 0 else 'EXCLUDE (v)'}, CAST({s} AS DOUBLE) AS v FROM {'near' if i == 0 else f'v{i - 1}'})" for i, s in enumerate(steps)]
    edges = EDGES.replace("'", "''")
    return f"""split AS (SELECT {keys}, len(regexp_extract_all(text, '!')) AS bangs, len(regexp_extract_all(text, '\\?')) AS asks, unnest(ws) AS raw, unnest(range(len(ws))) AS pos
  FROM (SELECT *, list_filter(regexp_split_to_array(text, '{BLANKS}'), lambda w: w <> '') AS ws FROM {source})),
bare AS (SELECT * EXCLUDE (raw), CASE WHEN length(regexp_replace(raw, '{edges}', '', 'g')) > 2 THEN regexp_replace(raw, '{edges}', '', 'g') ELSE raw END AS token FROM split),
marked AS (SELECT b.* EXCLUDE (token), lower(token) AS low, upper(token) = token AND lower(token) <> token AS upper, valence, valence IS NOT NULL AS listed FROM bare b LEFT JOIN lexicon ON word = lower(token)),
near AS (SELECT *, {', '.join(f"lag({{'low': low, 'upper': upper, 'listed': listed}}, {k}) OVER o AS p{k}" for k in (1, 2, 3))}, lead({{'low': low, 'listed': listed}}) OVER o AS nxt,
  count_if(upper) OVER a > 0 AND count_if(upper) OVER a < count(*) OVER a AS diff, min(CASE WHEN low = 'but' THEN pos END) OVER a AS but
  FROM marked WINDOW a AS (PARTITION BY {keys}), o AS (PARTITION BY {keys} ORDER BY pos)),
{', '.join(made)},
summed AS (SELECT {keys}, any_value(bangs) AS bangs, any_value(asks) AS asks, sum(CASE WHEN listed AND low NOT IN {boost} AND low NOT IN {damp} AND NOT (low = 'kind' AND coalesce(nxt.low = 'of', false)) THEN v ELSE 0 END
  * CASE WHEN pos < but THEN 0.5 WHEN pos > but THEN 1.5 ELSE 1 END) AS s FROM v{len(steps) - 1} GROUP BY ALL),
pushed AS (SELECT {keys}, CAST(s + sign(s) * (least(bangs, {MOST_EXCLAMATIONS}) * {EXCLAMATION} + CASE WHEN asks > 3 THEN {MANY_QUESTIONS} WHEN asks > 1 THEN asks * {QUESTION} ELSE 0 END) AS DOUBLE) AS s FROM summed),
compounds AS (SELECT {keys}, round(greatest(-1.0, least(1.0, s / sqrt(s * s + {NORM}))), 4) AS compound FROM pushed)"""
