"""The queries opN_<name>: each operator over its whole table, and the digest columns asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_forest, chat_format, decontamination, html_extract, language_id, minhash, mixing, ngram_join, source_audit, token_lengths, token_shards, toxicity, vector_codes


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _bpe() -> str:
    """The vocabulary file; it belongs to the machine and is not copied here."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct encoded length, with the suffix sums from there on."""
    return token_lengths.suffix_sums(token_lengths.length_histogram(_read(spark, sf_dir, "documents"), _bpe()))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))["documents"].select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def _fold(n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(_fold(4) != 2))
    out = language_id.predict(docs.select("doc_id", "text", (_fold(4) == 2).alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op5_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the formatted strings, taken from what is read back from them."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat_format.format_conversations(turns)
    back = out.withColumn("turns", chat_format.read_turns(F.col("formatted"))).withColumn("loss", chat_format.loss_text(F.col("segments")))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(line, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "bad_turn",
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.read_tokens(token_shards.write_tokens(_read(spark, sf_dir, "documents"), _bpe()))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(_fold(3) != 1))
    out = toxicity.score(docs.select("doc_id", "text", (_fold(3) == 1).alias("held_out")), model)
    return out.select("doc_id", "held_out", "score", "predicted")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    return vector_codes.encode(vectors).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(_read(spark, sf_dir, "documents"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_token_counts, op2_ngram_join, op3_mixing, op4_language_id, op5_ann_forest, op6_chat_format, op7_decontamination, op8_html_extraction, op9_token_shards, op10_toxicity)
    return {f.__name__: f for f in (*found, op11_vector_codes, op12_source_audit, op13_minhash)}


#: Reads the same turns straight from the table; the length counts the control
#: strings of a turn (11 characters), one more for each escaped character, and two
#: before a role that could complete ``<|`` to ``<|end|>``. The turn order breaks
#: where two neighbours are no move of the state machine.
_CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(11 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\<|]', '', 'g')) + CASE WHEN role LIKE 'e%' THEN 2 ELSE 0 END) AS BIGINT) AS formatted_chars,
  count(*) FILTER (NOT ok) = 0 AND max_by(role, k) = 'assistant' AS valid,
  CAST(min(k) FILTER (NOT ok) AS INT) AS bad_turn
FROM (
  SELECT *, CASE WHEN k = 0 THEN role IN ('system', 'user') ELSE (p, role) IN (('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) END AS ok
  FROM (SELECT *, row_number() OVER w - 1 AS k, lag(role) OVER w AS p FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)))
GROUP BY conv_id
"""

#: Windows of 13 words (or all of a shorter item) joined with document windows of the same length.
_DECONTAMINATION_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT row_number() OVER () AS k, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT k, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT dw.k, dw.n, dw.i, bw.item_id FROM dw JOIN bw USING (n, s)),
h AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM m) GROUP BY k),
it AS (SELECT k, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (k) LEFT JOIN it USING (k)
"""


#: Sets of shingles joined shingle by shingle, links followed to all that they reach.
_NEAR_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT k, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM d),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
p AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.k < b.k GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE 100 * c >= {least} * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT k, k AS o FROM d UNION SELECT r.k, e.b FROM r JOIN e ON r.o = e.a),
m AS (SELECT r.k, min(d.doc_id) AS c FROM r JOIN d ON r.o = d.k GROUP BY r.k),
t AS (SELECT a AS k, count(*) AS n_links FROM e GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id, {more}
FROM d JOIN m USING (k) LEFT JOIN n USING (k) LEFT JOIN t USING (k)
"""


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Every part against every entry of its codebook, in integers."""
    square = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, p.part, min({{'d': {square}, 'e': entry}}) AS m FROM p JOIN b{k} b ON p.part = b.part GROUP BY r, p.part)")
        if k < rounds:
            steps.append(
                f"s{k} AS (SELECT a.part, m.e AS entry, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{k} a JOIN p USING (r, part), range(1, (SELECT max(len(x)) FROM p) + 1) t(i) GROUP BY ALL),\n"
                f"n{k} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{k} GROUP BY ALL),\n"
                f"b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n.x, o.x) AS x FROM b{k} o LEFT JOIN n{k} n USING (part, entry))"
            )
    chain = ",\n".join(steps)
    return f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, embedding AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT r, part, list_transform(v[part * len(v) // {parts} + 1:(part + 1) * len(v) // {parts}], lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM k, range({parts}) t(part)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x FROM p WHERE r <= {entries}),
{chain},
o AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(CAST(x[i] AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM b{rounds}, range(1, (SELECT max(len(x)) FROM p) + 1) t(i))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN o USING (r), h
"""


#: All kept terms of all groups, dense.
_AUDIT_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
w AS MATERIALIZED (SELECT k, lang, source, unnest(w) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT k) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
f AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS MATERIALIZED (
  SELECT lang, source, term, n, 1 + CAST(1000000000 AS HUGEINT) * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p FROM f),
q AS (
  SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM f GROUP BY ALL)),
v AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source LEFT JOIN (
    SELECT x.lang, x.source AS s1, y.source AS s2, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source != y.source GROUP BY ALL) s ON s.lang = a.lang AND s.s1 = a.source AND s.s2 = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM v)
WHERE part = 'pair' OR rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_join": _NEAR_SQL.format(least=80, more="CAST(coalesce(n_links, 0) AS BIGINT) AS n_links"),
        "op6_chat_format": _CHAT_SQL,
        "op7_decontamination": _DECONTAMINATION_SQL,
        "op11_vector_codes": _codes_sql(),
        "op12_source_audit": _AUDIT_SQL,
        "op13_minhash": _NEAR_SQL.format(least=85, more="doc_id IS NOT DISTINCT FROM c AS kept"),
    }
