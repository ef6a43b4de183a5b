"""One thin query per operator, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The rules that the contract fixes for op7: verdict, host, path.
URL_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def op1_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.html_mincut import extract

    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("row.page_id", "row.url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op2_jpeg_thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.jpeg_thumbnails import media_digests

    return media_digests(table(spark, sf_dir, "documents"))


def op3_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.bm25_packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"), 1, vocabulary_file("byte_bpe_50k.tiktoken"), route=("lang",))


def op4_llr_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.llr_rules import judge_documents, trusted_keys

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge_documents(docs, trusted_keys(table(spark, sf_dir, "labels")))
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")


def op5_piece_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.piece_merge import encoding_digests

    return encoding_digests(table(spark, sf_dir, "documents"), vocabulary_file("piece_bpe_32k.model"))


def op6_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.two_pass_shuffle import shard_of, write_shards

    text, shards, seed = F.coalesce("text", F.lit("")), 40, 17
    size = (F.octet_length(text) + 16).cast("long")
    files = write_shards(table(spark, sf_dir, "documents"), "doc_id", size, shards, seed)
    grown = shard_of("doc_id", shards + 1, seed).alias("grown_shard")
    return files.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", grown)


def op7_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.url_trie import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op8_eb_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.eb_classifier import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_icws_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.icws_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.bit_packing import packed_ids

    return packed_ids(table(spark, sf_dir, "documents"), vocabulary_file("word_bpe_49k.json"), 49_408, 2)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents")).drop("at_key", "at_byte")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.token_alignment import align

    return align(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"), vocabulary_file("piece_bpe_32k.model"), vocabulary_file("byte_bpe_50k.tiktoken"))


def op13_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.pii_crf import find_private, labelled_table

    return find_private(table(spark, sf_dir, "documents"), labelled_table(spark))


def queries() -> dict[str, Query]:
    return {
        "op1_html_mincut": op1_html_mincut,
        "op2_jpeg_thumbnails": op2_jpeg_thumbnails,
        "op3_bm25_packing": op3_bm25_packing,
        "op4_llr_rules": op4_llr_rules,
        "op5_piece_merge": op5_piece_merge,
        "op6_two_pass_shuffle": op6_two_pass_shuffle,
        "op7_url_trie": op7_url_trie,
        "op8_eb_classifier": op8_eb_classifier,
        "op9_icws_dedup": op9_icws_dedup,
        "op10_bit_packing": op10_bit_packing,
        "op11_collocations": op11_collocations,
        "op12_token_alignment": op12_token_alignment,
        "op13_pii_crf": op13_pii_crf,
    }


OP7_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), urls AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), ruled AS (
  SELECT *, CASE
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN ends_with('.' || host, '.com') AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/es/') THEN 'org/es/'
  END AS rule FROM urls
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(str_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS w
  FROM (SELECT lang, unnest(str_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents)
), grams AS (
  SELECT lang, n, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (SELECT lang, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM pieces, range(1, 5) t(n))
), counts AS (
  SELECT lang, n, phrase, CAST(count(*) AS BIGINT) AS a FROM grams GROUP BY ALL
), words AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM counts WHERE n = 1 GROUP BY lang
), candidates AS (
  SELECT lang, n, phrase, str_split(phrase, ' ') AS w, a FROM counts WHERE n > 1 AND a >= 30
), halves AS (
  SELECT *, array_to_string(w[1 : k], ' ') AS first, array_to_string(w[k + 1 :], ' ') AS rest
  FROM (SELECT *, unnest(range(1, n)) AS k FROM candidates)
), scored AS (
  SELECT h.lang, h.phrase, h.a, h.k, x.a AS l, y.a AS r,
         CAST(CAST(2000000 AS HUGEINT) * h.a // (CAST(x.a AS HUGEINT) + y.a) AS BIGINT) AS score
  FROM halves h JOIN counts x ON x.lang = h.lang AND x.phrase = h.first AND x.n = h.k
  JOIN counts y ON y.lang = h.lang AND y.phrase = h.rest AND y.n = h.n - h.k
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_phrases AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, n, m, unnest(range(1, n - m + 2)) AS i FROM candidates, range(2, 4) t(m) WHERE m < n) GROUP BY ALL
), ranked AS (
  SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank, s.phrase, a, l, r, score
  FROM weakest s LEFT JOIN inner_phrases i ON i.lang = s.lang AND i.phrase = s.phrase
  WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT)
)
SELECT lang, rank, phrase, a, l, r, words.n AS n, score FROM ranked JOIN words USING (lang) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_url_trie": OP7_SQL, "op11_collocations": OP11_SQL}
