"""The operators' queries over whole tables, and their DuckDB forms where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import avi, bpe, compression, impact_search, langid, line_dedup, mixing, ngram_join, pii, quality_rules, token_counts, vector_codes, whitening
from lumenfold.llm.common import Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_NGRAM_SQL = ",\n".join(
    f"""w{n} AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) AS nth FROM (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + {n - 1}), ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM d WHERE len(ws) >= {n}))),
c{n} AS (SELECT doc_id, sum(length(ws[j])) AS chars FROM (
  SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS j FROM w{n} WHERE nth > 1) JOIN d USING (doc_id) GROUP BY doc_id)"""
    for n in (5, 7, 10)
)
QUALITY_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
base AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM d),
lines AS (SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id, l ORDER BY k) AS nth FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dl AS (SELECT doc_id, count(*) AS n, sum(list_sum(list_transform(regexp_extract_all(l, '[^\x20\x09-\x0D]+'), lambda x: length(x)))) AS chars
  FROM lines WHERE nth > 1 GROUP BY doc_id),
w3 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS times FROM (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 2), ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3))),
c3 AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS j FROM w3 WHERE times > 1) GROUP BY doc_id),
{_NGRAM_SQL},
m AS (SELECT b.*, CAST(coalesce(dl.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c3.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(dl.chars, 0) AS DOUBLE) / greatest(word_chars, 1) AS fl, CAST(coalesce(c5.chars, 0) AS DOUBLE) / greatest(word_chars, 1) AS f5,
  CAST(coalesce(c7.chars, 0) AS DOUBLE) / greatest(word_chars, 1) AS f7, CAST(coalesce(c10.chars, 0) AS DOUBLE) / greatest(word_chars, 1) AS f10
  FROM base b LEFT JOIN dl USING (doc_id) LEFT JOIN c3 USING (doc_id) LEFT JOIN c5 USING (doc_id) LEFT JOIN c7 USING (doc_id) LEFT JOIN c10 USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND fl <= 0.20 AND f5 <= 0.15 AND f7 <= 0.13 AND f10 <= 0.10 AS kept
FROM m"""


@query("op3_repetition_coverage", QUALITY_SQL)
def repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.assess(documents(spark, sf_dir), keep=["doc_id"])
    return found.drop("line_coverage", "ngram_coverage")


TARGETS_SQL = r"""
sized AS (SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap FROM sources),
levels AS (SELECT *, row_number() OVER o AS nth, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighed WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, rank)),
chosen AS (SELECT min_by(level, nth) AS level FROM levels WHERE level * weight <= cap),
targets AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE least(CAST(cap AS DOUBLE), coalesce(chosen.level * weight, CAST(cap AS DOUBLE))) END AS target
  FROM weighed, chosen)"""
MIX_SQL = rf"""
WITH {TARGETS_SQL},
placed AS (SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS expected,
    CAST(CAST('0x' || left(md5('mix' || coalesce(s.source, '')), 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS shift,
    row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id) AS place
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(expected * place + shift) - floor(expected * (place - 1) + shift)) AS BIGINT) AS taken
FROM placed"""


@query("op9_systematic_mix", MIX_SQL)
def systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan_copies(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


LINE_SQL = r"""
WITH lines AS MATERIALIZED (SELECT doc_id, l, k FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)),
filled AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
three AS (SELECT doc_id, i, l AS a, lead(l) OVER w AS b, lead(l, 2) OVER w AS c FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS nth FROM three WHERE c IS NOT NULL),
lost AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM ranked WHERE nth > 1),
marked AS (SELECT l.doc_id, l.l, l.k, f.i, lost.i AS gone FROM lines l LEFT JOIN filled f ON l.doc_id = f.doc_id AND l.k = f.k LEFT JOIN lost ON f.doc_id = lost.doc_id AND f.i = lost.i),
made AS (SELECT doc_id, string_agg(l, chr(10) ORDER BY k) FILTER (WHERE gone IS NULL) AS text, CAST(count(i) AS BIGINT) AS n_lines, CAST(count(gone) AS BIGINT) AS n_removed FROM marked GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(made.text, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents d LEFT JOIN made USING (doc_id)"""


@query("op10_line_windows", LINE_SQL)
def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))


JOIN_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 2)) AS i FROM d WHERE len(ws) >= 4)
  UNION SELECT doc_id, array_to_string(ws, ' ') || chr(10) || len(ws) FROM d WHERE len(ws) BETWEEN 1 AND 3),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 85 * (na.n + nb.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.b) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN reach ON d.doc_id = reach.a GROUP BY d.doc_id"""


@query("op4_parity_sketch_join", JOIN_SQL)
def parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = ngram_join.link(documents(spark, sf_dir), ngram_join.Join(words=4, percent=85))
    return linked.select("doc_id", "n_shingles", "component_id")


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op8_bpe_speculate_verify")
def bpe_speculate_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), word_vocabulary(), keep=["doc_id"])
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query("op1_skip_chain_pii")
def skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"])

    def listed(column: str) -> Column:
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(listed("base_spans"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def _remainder(by: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % by


@query("op2_compression_quality")
def compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    scorer = compression.fit(docs.where(_remainder(5) != 0), labels.where(_remainder(5) != 0))
    scored = compression.score(docs, scorer, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op6_word_first_language")
def word_first_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = langid.fit(docs.where(_remainder(4) != 2))
    found = langid.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op5_avi_motion_jpeg")
def avi_motion_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    found = avi.content(avi.store(docs, keep=["doc_id", "n_bytes"]), keep=["doc_id", "n_bytes", "media"])
    begins = F.array_join(F.transform(F.slice("clips", 2, F.size("clips")), lambda c: F.round(c["start_s"] * avi.FPS).cast("string")), ",")
    feature = F.concat(
        F.lit("frames="), "frames", F.lit(";shots="), F.size("clips"), F.lit(";motion="), "motion", F.lit(";cuts="), F.regexp_replace(begins, "[.]0", ""),
        F.lit(";luma="), F.array_join(F.col("clips.luma").cast("array<string>"), ","),
    )
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


@query("op7_trie_token_counts")
def trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = token_counts.count(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_tokens", F.round("log_prob", 3).alias("log_prob"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _codes_sql() -> str:
    """Product codes of 16 parts, 64 entries and two rounds: each round assigns all parts and takes means."""
    steps = []
    for r in range(3):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT vec_id, label, p, v, min_by(e, (dist, e)) AS e, min(dist) AS dist FROM (
  SELECT parts.vec_id, parts.label, parts.p, parts.v, e, list_sum(list_transform(list_zip(parts.v, b{r}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist
  FROM parts JOIN b{r} USING (p)) GROUP BY ALL)""")
        if r < 2:
            steps.append(f"""
m{r} AS (SELECT p, e, list(mean ORDER BY place) AS v FROM (SELECT p, e, place, CAST(floor(sum(c) / count(*)) AS BIGINT) AS mean
  FROM (SELECT p, e, unnest(v) AS c, generate_subscripts(v, 1) AS place FROM a{r}) GROUP BY p, e, place) GROUP BY p, e),
b{r + 1} AS MATERIALIZED (SELECT b{r}.p, b{r}.e, coalesce(m{r}.v, b{r}.v) AS v FROM b{r} LEFT JOIN m{r} USING (p, e))""")
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)),
parts AS MATERIALIZED (SELECT vec_id, label, p, list_slice(x, p * len(x) // 16 + 1, (p + 1) * len(x) // 16) AS v FROM kept, range(16) t(p)),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64),
b0 AS MATERIALIZED (SELECT p, e, v FROM parts JOIN firsts USING (vec_id)),{",".join(steps)},
coded AS (SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS sha FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, book.sha AS codebooks_sha256 FROM coded, book"""


@query("op11_va_file_codes", _codes_sql())
def va_file_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = embeddings(spark, sf_dir)
    books = vector_codes.fit(vectors)
    coded = vector_codes.with_label_errors(vector_codes.encode(vectors, books, keep=["vec_id", "label"]))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


@query("op12_jacobi_whitening")
def jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = embeddings(spark, sf_dir)
    return whitening.whiten(vectors, whitening.fit(vectors), keep=["vec_id"])


SEARCH_SQL = """
WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)),
scored AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_sum(list_transform(list_zip(q.x, r.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM kept q JOIN kept r ON q.vec_id % 50 = 0 AND r.vec_id <> q.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""


@query("op13_impact_ordered_search", SEARCH_SQL)
def impact_ordered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = embeddings(spark, sf_dir)
    index = impact_search.build(vectors, Workspace(spark, "search"))
    return impact_search.search(index, vectors.where("vec_id % 50 = 0"), k=5)
