"""The registered queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import chosen_path, cotraining, hypervectors, infilling, line_windows, merge_dropout, mixcoder, positions, ppm, raster, resampling, suffix_sort, token_counts
from fathomline.llm._shared import id_crc32


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Seed of the merge-dropout.
SEED = 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of all documents, learned from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(id_crc32(), F.lit(7)) == 2
    found = ppm.score(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_symbols")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities that documents are good, by co-training on the labels."""
    docs = table(spark, sf_dir, "documents")
    found = cotraining.score(docs, cotraining.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "p_text", "p_meta", "p_good", (F.col("p_good") >= 0.5).alias("kept"))


def op3_sentencepiece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents under seeded merge-dropout, and whether they decode to the text."""
    return merge_dropout.encode_texts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), seed=SEED)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside benchmark windows, by the positional index."""
    found = positions.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").withColumn("_held_out", F.pmod(id_crc32(), F.lit(4)) == 2)
    model = hypervectors.fit(hypervectors.learning_rows(docs, ~F.col("_held_out")))
    found = hypervectors.predict(docs, model)
    return found.select("doc_id", (F.pmod(id_crc32(), F.lit(4)) == 2).alias("held_out"), "lang_pred", "score")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their later repeats of three-line windows removed."""
    return line_windows.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text stored as a Netpbm image, read back and digested."""
    return raster.text_media(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"))


def op10_token_id_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written by the context-mixing coder and read back."""
    return mixcoder.id_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights and scores of all documents towards the benchmark, and the ranks of the tenth that is drawn."""
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, least_words=20, seed=2024)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 50-byte strings that start in a document of a smaller id."""
    found = suffix_sort.dedup_strings(table(spark, sf_dir, "documents"), depth=50)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in fill-in-middle form, and the texts restored from it."""
    found = infilling.fill_in_middle(table(spark, sf_dir, "documents"), seed=1, plain_percent=10, spm_percent=20)
    back = infilling.restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP5_SQL = """
WITH ln AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS i,
         len(string_split(text, chr(10))) AS n
  FROM documents WHERE text IS NOT NULL),
w AS (
  SELECT doc_id, i, n,
         line || CASE WHEN n > 1 THEN chr(10) || coalesce(lead(line, 1) OVER d, '') ELSE '' END
              || CASE WHEN n > 2 THEN chr(10) || coalesce(lead(line, 2) OVER d, '') ELSE '' END AS key
  FROM ln WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
firsts AS (
  SELECT key, doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS k
  FROM w WHERE i <= greatest(n - 2, 1) AND trim(replace(key, chr(10), ' ')) <> ''),
cut AS (
  SELECT DISTINCT doc_id, i + s AS i
  FROM firsts, (SELECT unnest([0, 1, 2]) AS s) WHERE k > 1),
out AS (
  SELECT ln.doc_id, count(*) AS n_lines, count(cut.i) AS n_removed,
         coalesce(string_agg(CASE WHEN cut.i IS NULL THEN line END, chr(10) ORDER BY ln.i), '') AS text
  FROM ln LEFT JOIN cut ON ln.doc_id = cut.doc_id AND ln.i = cut.i GROUP BY ln.doc_id)
SELECT d.doc_id, coalesce(o.n_lines, 0) AS n_lines, coalesce(o.n_removed, 0) AS n_removed, o.text
FROM documents d LEFT JOIN out o ON d.doc_id = o.doc_id
"""

OP11_SQL = r"""
WITH bits AS (  -- the table of crc32, by its rule
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
tok AS (
  SELECT 'd' AS side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS w FROM documents
  UNION ALL
  SELECT 'b', NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) FROM benchmark),
words AS (
  SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM tok)),
codes AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(x, (2 * i - 1)::INT, 2))::BIGINT FOR i IN range(1, len(x) // 2 + 1)]),
                            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM words, bits),
sums AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM tok JOIN codes USING (w) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM sums),
means AS (
  SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM tok JOIN codes USING (w) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents d LEFT JOIN means USING (doc_id)),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, k AS rank FROM scored LEFT JOIN (SELECT doc_id, k FROM placed WHERE k <= 10 * n // 100) USING (doc_id)
"""

OP12_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(hex(encode(text)), '') AS x, coalesce(octet_length(encode(text)), 0) AS n FROM documents),
w AS (
  SELECT doc_id, unnest(range(n - 49)) AS i, x FROM d WHERE n >= 50),
k AS (
  SELECT doc_id, i, substr(x, (2 * i + 1)::INT, 100) AS key FROM w),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY key) AS first FROM k) WHERE first < doc_id),
steps AS (
  SELECT *, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS new FROM later),
spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b
  FROM (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM steps) GROUP BY doc_id, g),
parts AS (
  SELECT doc_id, a, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS k FROM spans),
cut AS (
  SELECT p.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
         string_agg(CASE WHEN k = 1 THEN substr(x, 1, (2 * a)::INT) ELSE '' END || substr(x, (2 * b + 1)::INT, (2 * (coalesce(next, n) - b))::INT), '' ORDER BY a) AS kept
  FROM parts p JOIN d ON p.doc_id = d.doc_id GROUP BY p.doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN cut ON d.doc_id = cut.doc_id
"""

OP13_SQL = """
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS x FROM documents),
n AS (
  SELECT doc_id, text, length(text) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM h),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM n),
p AS (
  SELECT *, substring(text, 1, a) AS pre, substring(text, a + 1, b - a) AS mid, substring(text, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_sentencepiece_dropout": op3_sentencepiece_dropout,
    "op4_decontamination": op4_decontamination,
    "op5_line_dedup": op5_line_dedup,
    "op6_language_id": op6_language_id,
    "op7_token_counts": op7_token_counts,
    "op8_media_columns": op8_media_columns,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_token_id_coder": op10_token_id_coder,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {"op5_line_dedup": OP5_SQL, "op11_importance_resampling": OP11_SQL, "op12_suffix_dedup": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
