"""The registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playseq.llm.decontaminate import decontaminate
from playseq.llm.chat import perspectives
from playseq.llm import language, suffix_dedup
from playseq.llm.lexical_search import search
from playseq.llm.licenses import scan
from playseq.llm.main_text import extract
from playseq.llm.mixing import mix
from playseq.llm.near_dedup import near_duplicates
from playseq.llm.quality import judge, learn_lexicon
from playseq.llm.substring_dedup import remove_repeats
from playseq.llm.tables import documents, on_workers, table
from playseq.llm.token_counts import count_tokens, token_stream
from playseq.llm.whitening import whitened_components


# How much more often than an unlabelled document a labelled one comes first.
LABEL_WEIGHT = {1: 2.0, 0: 0.5}


def quality_weights(labels: DataFrame) -> DataFrame:
    """A weight for each labelled document: 2 if good, 0.5 if bad; several labels count as the worst."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return known.select("doc_id", F.when(F.col("quality") == 1, LABEL_WEIGHT[1]).otherwise(LABEL_WEIGHT[0]).alias("weight"))


def op1_mix_to_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir), quality=quality_weights(table(spark, sf_dir, "labels")))
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken", "epochs", "cut_words")


def op2_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(table(spark, sf_dir, "conversations"))


def op3_difference_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def op4_fast_similarity_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir), shingle=2)
    return found.rows.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op5_weak_supervision_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels")
    judged = judge(docs, lexicon=learn_lexicon(docs, labels), labels=labels)
    return judged.rows.select(
        "row.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "good_probability",
    )


def op6_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = count_tokens(token_stream(documents(spark, sf_dir)))
    return found.select("row.doc_id", "stream", "number", "start", "n_tokens")


def op7_language_identification(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    held_out = F.coalesce(fold == 2, F.lit(False))
    model = language.fit(docs, ~held_out, order=F.xxhash64("doc_id"))
    found = language.identify(docs.withColumn("held_out", held_out), model, carry=["doc_id", "held_out"])
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score")


def op8_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_induced_sorting_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    return found.select("row.doc_id", F.concat_ws(",", "sentences").alias("sentences"), F.size("licences").cast("long").alias("n_licences"), "expression")


def op11_shifted_cholesky_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitened_components(table(spark, sf_dir, "embeddings"))
    deviation = F.col("deviation").cast("long").alias("deviation")
    return found.select("row.vec_id", "component", "n", deviation, "whitened", "explained", "identity_error")


def op12_class_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op13_composite_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("row.page_id", "row.url", "text", "n_chars")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_mix_to_target_weights,
        op2_perspective_rotation,
        op3_difference_cover_dedup,
        op4_fast_similarity_near_dedup,
        op5_weak_supervision_quality,
        op6_separator_scan,
        op7_language_identification,
        op8_fm_index_decontamination,
        op9_induced_sorting_dedup,
        op10_license_sentences,
        op11_shifted_cholesky_whitening,
        op12_class_ranked_search,
        op13_composite_text_density,
    )
    return {query.__name__: on_workers(query) for query in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_perspective_rotation": OP2_SQL,
        "op3_difference_cover_dedup": OP3_SQL,
        "op4_fast_similarity_near_dedup": OP4_SQL,
        "op8_fm_index_decontamination": OP8_SQL,
        "op9_induced_sorting_dedup": OP9_SQL,
        "op12_class_ranked_search": OP12_SQL,
    }


OP2_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, role IS NOT NULL AS named, text IS NOT NULL AS spoken,
    replace(coalesce(text, ''), '<|', '< |') AS said
  FROM conversations),
speakers AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE named AND speaker <> 'system'),
seen AS (
  SELECT s.*, perspective, named AND speaker = perspective AS own,
    '<|im_start|>' || CASE WHEN named AND speaker = perspective THEN 'assistant' WHEN named AND speaker = 'system' THEN 'system'
      ELSE 'user name=' || speaker END || chr(10) AS head
  FROM said s JOIN speakers p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
numbered AS (
  SELECT *, head || said || '<|im_end|>' || chr(10) AS segment,
    row_number() OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, said, spoken) AS position
  FROM seen),
placed AS (
  SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY position) AS BIGINT) AS past FROM numbered)
SELECT conv_id, perspective, position, turn, speaker, segment, past - length(segment) AS first, past,
  CASE WHEN own AND spoken THEN past - length(segment) + length(head) END AS train_first,
  CASE WHEN own AND spoken THEN past - 1 END AS train_past
FROM placed
"""

OP3_SQL = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM doc)),
twice AS (SELECT doc_id, i FROM win JOIN (SELECT h FROM win GROUP BY h HAVING count(*) > 1) USING (h)),
gone AS (SELECT doc_id, list(DISTINCT k) AS ks FROM (SELECT doc_id, unnest(range(i, i + 35)) AS k FROM twice) GROUP BY doc_id),
kept AS (
  SELECT doc_id, w, coalesce(len(ks), 0) AS n_removed,
    CASE WHEN ks IS NULL THEN w ELSE [x[1] for x in list_zip(w, range(1, len(w) + 1)) if NOT list_contains(ks, x[2])] END AS k
  FROM doc LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
  sha256(array_to_string(k, ' ')) AS kept_sha256
FROM kept
"""


OP4_SQL = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN size x ON x.doc_id = a.doc_id JOIN size y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM doc
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
component AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM component LEFT JOIN size USING (doc_id)
"""

OP8_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
phrase AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM item WHERE len(w) > 0)),
places AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
  FROM doc, (SELECT DISTINCT n FROM phrase) WHERE len(w) >= n),
hit AS (
  SELECT doc_id, i, pl.n, item_id
  FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM places) pl JOIN phrase USING (n, p)),
words_hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
items_hit AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)
"""

OP9_SQL = r"""
WITH doc AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (
  SELECT doc_id, i, md5(substring(h, 2 * i + 1, 800)) AS m
  FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 399, 0))) AS i FROM doc)),
twice AS (SELECT doc_id, i FROM win JOIN (SELECT m FROM win GROUP BY m HAVING count(*) > 1) USING (m)),
start AS (
  SELECT doc_id, i, i + 400 AS past,
    coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400, true) AS opens
  FROM twice),
span AS (
  SELECT doc_id, min(i) AS first, max(past) AS past
  FROM (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM start) GROUP BY doc_id, k),
edge AS (
  SELECT doc_id, coalesce(lag(past) OVER w, 0) AS kept_from, first AS kept_to FROM span WINDOW w AS (PARTITION BY doc_id ORDER BY first)
  UNION ALL SELECT doc_id, max(past), NULL FROM span GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(substring(h, 2 * kept_from + 1, 2 * (coalesce(kept_to, len(h) // 2) - kept_from)), '' ORDER BY kept_from) AS k
  FROM edge JOIN doc USING (doc_id) GROUP BY doc_id),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(past - first) AS n_removed FROM span GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id) LEFT JOIN cut USING (doc_id)
"""

OP12_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
corpus AS (
  SELECT count(*) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM doc WHERE len(w) > 0),
tf AS (
  SELECT r, term, count(*) AS tf
  FROM (SELECT r, unnest(w) AS term FROM doc) WHERE term IN (SELECT term FROM item) GROUP BY r, term),
weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(big_n) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight
  FROM tf, corpus GROUP BY term),
length AS (
  SELECT r, doc_id, 10 + (90 * len(w) * big_n) // big_l AS m FROM doc, corpus WHERE len(w) > 0),
scored AS (
  SELECT item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM item JOIN tf USING (term) JOIN weight USING (term) JOIN length USING (r) GROUP BY item_id, r, doc_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
