"""Queries of text functions over documents, jobs and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import constants as C
from lumenfold.functions import security
from lumenfold.functions import text as T
from lumenfold.operators import segments
from lumenfold.plans import views as V
from lumenfold.registry import query
from lumenfold.sources import table


def _masked(text: str, word: str) -> str:
    """SQL for whole words masked; a match takes its neighbours along, so that a second pass finds every other one."""
    letters = "".join(f"[{c}{c.upper()}]" for c in word[1:])
    once = rf"regexp_replace({{}}, '(^|[^\p{{{{L}}}}\p{{{{N}}}}_])([{word[0]}{word[0].upper()}]){letters}($|[^\p{{{{L}}}}\p{{{{N}}}}_])', '\1\2{'*' * (len(word) - 1)}\3', 'g')"
    return once.format(once.format(text).replace("{", "{{").replace("}", "}}")).replace("{{", "{").replace("}}", "}")


@query("f1_bleep", f"SELECT doc_id, {_masked(_masked('text', 'idiot'), 'the')} AS text FROM documents")
def bleep(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.bleep("text", "custom", ["the", "idiot"]).alias("text"))


def _cased(found: str, value: str) -> str:
    return f"""CASE WHEN {found} = upper({found}) THEN upper('{value}') WHEN {found} = upper(left({found}, 1)) || lower(substr({found}, 2)) THEN upper(left('{value}', 1)) || lower(substr('{value}', 2)) WHEN {found} = lower({found}) THEN lower('{value}') ELSE '{value}' END"""


_PAIR = "lower(coalesce(ps[{0}], '')) = 'of' AND ps[{0} + 1] = ' ' AND lower(coalesce(ps[{0} + 2], '')) = 'the'"


@query("f2_vocabulary", rf"""WITH p AS (SELECT doc_id, text, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') AS ps FROM documents)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(list_transform(ps, lambda x, i: CASE WHEN {_PAIR.format('i')} THEN {_cased("(x || ' ' || ps[i + 2])", 'from a')}
  WHEN i > 1 AND {_PAIR.format('(i - 1)')} OR i > 2 AND {_PAIR.format('(i - 2)')} THEN '' WHEN lower(x) = 'the' THEN {_cased('x', 'a certain')} WHEN lower(x) = 'de' THEN {_cased('x', 'of')} ELSE x END), '') END AS text FROM p""")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.replace_vocabulary("text", {"the": "a certain", "of the": "from a", "de": "of"}).alias("text"))


@query("f3_filler_words", f"""WITH {V.WORDS} SELECT vid, pos, lower(trim(word, ',.!?;:''"')) IN ({', '.join(f"'{f}'" for f in C.FILLERS)}) AS filler FROM words""")
def filler_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.words(spark, sf_dir).select("vid", "pos", T.is_filler("word").alias("filler"))


@query("f4_f5_slugs", r"""SELECT doc_id, coalesce(nullif(left(trim(regexp_replace(text, '[^\p{L}\p{N}_\-]', '_', 'g'), '_'), 80), ''), 'video') AS slug,
  lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') || '_' || coalesce(nullif(trim(regexp_replace(text, '[^\p{L}\p{N}_\-. ]', '_', 'g')), ''), 'chapter') AS name FROM documents""")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.slug("text").alias("slug"), T.output_name(F.col("doc_id") % 100, "text").alias("name"))


@query("f8_hook_patterns", """SELECT doc_id, CASE WHEN contains(text, '?') THEN 0.33::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(lower(text), '^(how|why|what|when|who|never|always|stop|start|you need)') THEN 0.33::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(text, '[0-9]') THEN 0.33::DOUBLE ELSE 0 END AS score FROM documents""")
def hook_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.hook_score("text").alias("score"))


@query("a9_j10_trend_hits", f"""SELECT item_id, CAST(len(list_filter([{', '.join(f"'{t}'" for t in C.TRENDS)}], lambda t: contains(lower(text), t))) AS INTEGER) AS hits, least(1.0, len(list_filter([{', '.join(f"'{t}'" for t in C.TRENDS)}], lambda t: contains(lower(text), t))) / 4.6::DOUBLE) AS score FROM benchmark""")
def trend_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.trend_hits("text").alias("hits"), F.round(T.trend_score("text"), 12).alias("score"))


HOW_TO = r"len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: w IN ('how', 'step', 'steps', 'tip', 'tips', 'way', 'ways', 'method', 'methods')))"
_HEAD = r"list_filter(regexp_split_to_array(left(text, 500), '[ \t\n\f\r]+'), lambda w: w <> '')"
VALUE = rf"""least(1.0, (len(regexp_extract_all(left(text, 500), '[A-Z][a-z]+(?:[ \t\n\f\r]+[A-Z][a-z]+)*')) + 2 * len(list_filter({_HEAD}, lambda w: regexp_full_match(w, '[0-9]+(?:[.,][0-9]+)*')))
  + 3 * {HOW_TO}) / (greatest(len({_HEAD}), 1) * 0.3::DOUBLE))"""


@query("f9_perceived_value", f"SELECT doc_id, CAST({HOW_TO} AS INTEGER) AS how_to, round({VALUE}, 9) AS value FROM documents")
def perceived_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", segments.how_to_count("text").alias("how_to"), F.round(segments.value_of("text"), 9).alias("value"))


@query("f11_noun_phrases", r"SELECT doc_id, array_to_string(list_transform(list_slice(regexp_extract_all(text, '[A-Z][a-z]+(?:[ \t\n\f\r]+[A-Z][a-z]+)*'), 1, 3), lambda x: lower(x)), '|') AS phrases FROM documents")
def noun_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.noun_phrases("text"), "|").alias("phrases"))


@query("p6_p10_platforms", f"""WITH {V.JOBS}, m AS (SELECT *, CASE WHEN regexp_matches(url, '^https?://(?:[^/]+\\.)?(?:youtube\\.com|youtu\\.be)(?:/|$)') THEN 'youtube' WHEN regexp_matches(url, '^https?://(?:[^/]+\\.)?(?:facebook\\.com|fb\\.watch)(?:/|$)') THEN 'facebook'
  WHEN regexp_matches(url, '^https?://(?:[^/]+\\.)?(?:tiktok\\.com)(?:/|$)') THEN 'tiktok' WHEN regexp_matches(url, '^https?://(?:[^/]+\\.)?(?:instagram\\.com|instagr\\.am)(?:/|$)') THEN 'instagram' END AS platform FROM jobs)
SELECT job_id, platform, CASE WHEN starts_with(url, 'upload://') THEN 'upload' ELSE coalesce(platform, 'unsupported') END AS kind, coalesce(platform IN ('tiktok', 'instagram'), false) OR (coalesce(platform, '') = 'youtube' AND contains(url, '/shorts/')) AS short,
  starts_with(url, 'upload://') OR platform IS NOT NULL AS supported, nullif(regexp_extract(url, '(?:v=|youtu\\.be/)([a-zA-Z0-9_-]{{11}})', 1), '') AS video_id FROM m""")
def platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = V.jobs(spark, sf_dir)
    return j.select("job_id", T.platform("url").alias("platform"), T.source_kind("url").alias("kind"), T.is_short_form("url").alias("short"), T.is_supported("url").alias("supported"), T.youtube_id("url").alias("video_id"))


@query("s12_cache_keys", "SELECT item_id, left(sha1(lower(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) || '|' || (item_id % 9)), 16) AS key FROM benchmark")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.cache_key("text", F.col("item_id") % 9).alias("key"))


_IPAD, _OPAD = ("".join(f"\\x{b ^ pad:02X}" for b in b"key".ljust(64, b"\0")) for pad in (0x36, 0x5C))


@query("f15_hmac", f"SELECT doc_id, sha256('{_OPAD}'::BLOB || unhex(sha256('{_IPAD}'::BLOB || encode(text)))) AS signature FROM documents")
def hmac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", security.hmac_sha256(b"key", "text").alias("signature"))


_SECRET = ["".join(f"\\x{b ^ pad:02X}" for b in b"secret".ljust(64, b"\0")) for pad in (0x36, 0x5C)]
_URL64 = "translate(rtrim(base64({}), '='), '+/', '-_')"
_SIGNED = f"unhex(sha256('{_SECRET[1]}'::BLOB || unhex(sha256('{_SECRET[0]}'::BLOB || encode(payload)))))"


@query("f16_share_tokens", f"""SELECT *, 'rs.' || {_URL64.format('encode(payload)')} || '.' || {_URL64.format(_SIGNED)} AS token, true AS verified, false AS forged
FROM (SELECT c_custkey AS clip_id, '{{"c":"' || c_custkey || '","e":1700000000}}' AS payload FROM customer)""")
def share_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("clip_id"), F.concat(F.lit('{"c":"'), F.col("c_custkey").cast("string"), F.lit('","e":1700000000}')).alias("payload"))
    c = c.withColumn("token", security.share_token(b"secret", "payload"))
    read = security.token_payload(b"secret", "token")
    return c.select("clip_id", "token", read.alias("payload"), (read == F.col("payload")).alias("verified"), security.token_payload(b"other", "token").isNotNull().alias("forged"))


@query("f18_transcript_shapes", """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN coalesce(nullif(text, ''), role) WHEN 1 THEN 'a b' ELSE 'sum' END AS text FROM conversations""")
def transcript_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    shaped = F.when(F.col("turn") % 3 == 0, F.to_json(F.struct("text"))).when(F.col("turn") % 3 == 1, '{"segments":[{"text":"a"},{"text":"b"}]}').otherwise("{}")
    return c.select("conv_id", "turn", T.transcript_text(shaped, F.when(F.col("turn") % 3 == 2, "sum"), "role").alias("text"))


@query("f19_f28_caps", "SELECT doc_id, left(text, 100) AS title, left(text, 5000) AS description, CAST(least(30, greatest(doc_id % 50, 1)) AS INTEGER) AS tags FROM documents")
def caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = T.external_caps("text", "text", F.array_repeat(F.lit("a"), F.greatest(F.col("doc_id") % 50, F.lit(1)).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", made["title"].alias("title"), made["description"].alias("description"), F.size(made["tags"]).alias("tags"))


@query("f27_backoff", "SELECT n_nationkey AS attempt, CAST(least(1000 * pow(2, n_nationkey), 30000) AS BIGINT) AS ms FROM nation")
def backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("attempt"), T.backoff_ms("n_nationkey").alias("ms"))


@query("c1_hashtags", r"SELECT item_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[,\s]+'), lambda x: trim(regexp_replace(x, '^#', ''))), lambda x: x <> ''), '|') AS tags FROM benchmark")
def hashtags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.parse_hashtags("text"), "|").alias("tags"))


@query("p21_range_checks", """WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity - 10 AS s, l_quantity * 0.5 AS e FROM lineitem) SELECT l_orderkey, l_linenumber, s >= 0 AND s < e AS valid FROM c""")
def range_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity - 10 AS s", "l_quantity * 0.5 AS e")
    return c.select("l_orderkey", "l_linenumber", T.valid_range("s", "e").alias("valid"))


_STYLES = [*C.PRESETS, "neon"]
_PICKED = f"[{', '.join(repr(x) for x in _STYLES)}][c_custkey % {len(_STYLES)} + 1]"


@query("f22_presets", "SELECT c_custkey AS clip_id, style, " + ", ".join(f"CASE style {' '.join(f'WHEN {k!r} THEN {v[i]!r}' for k, v in C.PRESETS.items() if v[i] is not None)} END AS {c}" for i, c in enumerate(("font_size", "color", "highlight")))
  + f""", CASE WHEN style = 'neon' THEN 'unknown caption style: neon; must be one of {', '.join(sorted(C.PRESETS))}' END AS error FROM (SELECT c_custkey, {_PICKED} AS style FROM customer)""")
def presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    style = F.element_at(F.array(*map(F.lit, _STYLES)), (F.col("c_custkey") % len(_STYLES) + 1).cast("int"))
    clips = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("clip_id"), style.alias("style"))
    return clips.select("clip_id", "style", F.inline(F.array(T.preset("style"))))


@query("s14_defaults_on_read", f"WITH {V.JOBS} SELECT job_id, coalesce(nullif(language, ''), 'en-US') AS language FROM jobs")
def defaults_on_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.jobs(spark, sf_dir).select("job_id", T.or_default("language", "en-US").alias("language"))
