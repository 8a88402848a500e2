"""The queries of this package, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uttera.llm import chat, html_text, ngram_join, packing, permutation_index, pieces, pii, quality_classifier, quality_rules, spelling, token_counts, vector_codes, vector_codes_sql, warc
from uttera.llm.common import table, written


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def gpt_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record in ZIP packages, read back."""
    packages = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(packages, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back, with conversation -7 that holds control strings."""
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat.format_turns(turns.unionByName(extra))


def op3_piece_n_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n best segmentations of every document."""
    return pieces.n_best_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets and batches of every document by its number of tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = token_counts.tokens_column(docs, tokenizer_path("byte_bpe_50k.json"), gpt_pattern())
    return packing.packing_plan(docs, n)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors found for each vector whose id is divisible by 100."""
    rows = permutation_index.usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return permutation_index.nearest(rows, rows.where("vec_id % 100 = 0"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence, site posteriors and verdict of every document; host: source, path: source and language."""
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    light = docs.select("doc_id", F.col("source").alias("host"), F.col("lang").alias("path"), model.column(F.col("text")).alias("p"))
    light = written(light, "evidence")
    sites, top = quality_classifier.site_posteriors(light)
    return quality_classifier.judged(light, sites, top)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the byte-level BPE vocabulary."""
    return token_counts.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"), gpt_pattern())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    out = quality_rules.apply(docs.select("doc_id", "text"), rules)
    return out.select("doc_id", "quality_rules.*").drop("n_lines", "n_upper")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return ngram_join.components(table(spark, sf_dir, "documents"))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return html_text.main_texts(pages, html_text.fit(pages))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, root and near words of every word of the documents."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and errors of every vector."""
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings")).drop("measured_share")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_chat_format": op2_chat_format,
        "op3_piece_n_best": op3_piece_n_best,
        "op4_packing": op4_packing,
        "op5_pii": op5_pii,
        "op6_permutation_index": op6_permutation_index,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_token_counts": op8_token_counts,
        "op9_quality_rules": op9_quality_rules,
        "op10_ngram_join": op10_ngram_join,
        "op11_html_text": op11_html_text,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_vector_codes": op13_vector_codes,
        "pipeline": pipeline,
    }


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS n, sha256(html) AS d FROM p),
f AS (SELECT d, min(page_id) AS first FROM q WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, q.d AS payload_digest,
  CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN NULL ELSE first END AS refers_to
FROM q LEFT JOIN f ON q.d = f.d
"""

#: A turn's marks have 24 characters; a backslash and each control string in a text cost one more.
_ESCAPED = r"length({c}) + length({c}) - length(replace({c}, '\', '')) + len(regexp_extract_all({c}, '<\|(turn|text|end|im_start|im_end|endoftext|startoftext)\|>|</?s>|\[/?INST\]|<</?SYS>>'))"

OP2_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + {_ESCAPED.format(c="role")} + {_ESCAPED.format(c="text")}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words
), sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
items AS (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
linked AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked),
reach AS (SELECT doc_id, doc_id AS r FROM sizes UNION SELECT reach.doc_id, edges.y FROM reach JOIN edges ON edges.x = reach.r)
SELECT s.doc_id, s.n AS n_shingles, min(r) AS component_id FROM sizes s JOIN reach USING (doc_id) GROUP BY s.doc_id, s.n
"""

#: For the layout that the table's pages have; the query itself knows no layout.
OP11_SQL = r"""
WITH b AS (
  SELECT page_id, url, unnest(string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>')) AS t,
    generate_subscripts(string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>'), 1) AS i FROM pages),
c AS (
  SELECT page_id, url, i, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS t FROM b),
d AS (SELECT page_id, url, coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (WHERE t <> ''), '') AS text FROM c GROUP BY page_id, url)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
"""

OP12_SQL = """
WITH RECURSIVE crc AS (SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY b) AS t FROM range(256) AS r(b)),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS r FROM documents),
own AS (SELECT doc_id, r, count(*) AS c, concat(doc_id, ':', r) AS s FROM runs WHERE length(r) >= 6 GROUP BY ALL),
hashed AS (
  SELECT r, c, xor(4294967295, list_reduce([4294967295] || list_transform(range(1, strlen(s) + 1), lambda i: CAST('0x' || substr(hex(s), 2 * i - 1, 2) AS BIGINT)),
    lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1]))) AS h FROM own, crc),
holed AS (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, c FROM hashed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM holed WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM words, range(1, length(word) + 1) AS t(i)),
half AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b USING (i, cut) WHERE a.word <> b.word
  UNION SELECT cuts.word, words.word, words.n FROM cuts JOIN words ON words.word = cut),
pairs AS (SELECT * FROM half UNION SELECT h.near, h.word, w.n FROM half h JOIN words w ON w.word = h.word),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(n := -near_n, w := encode(near))) AS b FROM pairs GROUP BY word),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.n >= 5 * n THEN decode(b.w) END AS form, CASE WHEN -b.n >= 5 * n THEN -b.n END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at FROM formed UNION SELECT chain.word, form FROM chain JOIN formed ON formed.word = chain.at WHERE form IS NOT NULL)
SELECT f.word, f.form, chain.at AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN chain ON chain.word = f.word JOIN formed l ON l.word = chain.at WHERE l.form IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op2_chat_format": OP2_SQL, "op10_ngram_join": OP10_SQL, "op11_html_text": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_vector_codes": vector_codes_sql.SQL}
