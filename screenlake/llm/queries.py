"""The registered queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table, tokenizer_file
from .bpe import bpe_round_trip
from .chat import format_chats, read_back
from .exact_dedup import exact_dedup
from .language_id import identify
from .packing import best_fit_pack
from .pii import pii_spans
from .prefix_trie import conversation_trie
from .secret_scan import secret_spans
from .simhash import simhash_components
from .spelling import spelling_variants
from .substring_dedup import repeated_passages
from .topk import top_k
from .warc import warc_round_trip


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In two batches, so that the second meets the state of the first."""
    return exact_dedup(table(spark, sf_dir, "documents"), batches=2)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"), within=False)


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one (-7) whose texts are made of control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = spark.sql(f"SELECT -7L AS conv_id, turn, role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return read_back(format_chats(turns))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_bpe": op2_bpe,
    "op3_language_id": op3_language_id,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_top_k": op5_top_k,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_pii": op7_pii,
    "op8_chat_format": op8_chat_format,
    "op9_simhash": op9_simhash,
    "op10_secret_scan": op10_secret_scan,
    "op11_warc": op11_warc,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_spelling_variants": op13_spelling_variants,
}

#: CRC-32 in SQL: its table as a list, and a fold over the bytes of ``{0}``.
_CRC_TABLE = """SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc"""
_CRC = """xor(4294967295, list_reduce(list_transform(range(1, length(hex({0})), 2), lambda i: ('0x' || substr(hex({0}), i, 2))::BIGINT),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295))"""

ORACLE_SQL = {
    "op1_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents
        )
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op5_top_k": r"""
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op8_chat_format": r"""
        WITH c AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
               sum(length(regexp_replace(text, '([<\[])(\\*)(<SYS>>|</SYS>>|INST\]|/INST\]|s>|/s>|\|role\|>|\|body\|>|\|end\|>)', '\1\2\\\3', 'g'))
                   + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE length(role) + 23 END)::BIGINT AS formatted_chars
        FROM c GROUP BY conv_id
    """,
    "op11_warc": r"""
        WITH p AS (
            SELECT page_id, url, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
        ), r AS (
            SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS first,
                   list_transform(range(0, 8), lambda i: ('0x' || substr(h, 5 * i + 1, 5))::BIGINT) AS fives
            FROM p WINDOW w AS (PARTITION BY h ORDER BY page_id NULLS LAST, url NULLS LAST)
        )
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   ((fives[j // 4 + 1] >> (5 * (3 - j % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
               CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN place > 1 THEN first END AS refers_to, url, true AS intact
        FROM r
    """,
    "op12_prefix_trie": f"""
        WITH k AS MATERIALIZED ({_CRC_TABLE}), o AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
                PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
            FROM conversations WHERE conv_id IS NOT NULL
        ), ids AS MATERIALIZED (
            SELECT c, c - c % 5 AS base, {_CRC.format("c::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id AS c FROM o), k
        ), r AS (
            SELECT c, 0 AS own, pos, role, text FROM ids JOIN o ON conv_id = base AND pos <= h UNION ALL SELECT c, 1, pos, role, text FROM ids JOIN o ON conv_id = c AND pos > h
        ), n AS (
            SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS d, sha256(role) || sha256(text) AS turn, strlen(text) AS bytes FROM r
        ), p AS MATERIALIZED (
            SELECT c, d, bytes, sha256(string_agg(turn, '') OVER (PARTITION BY c ORDER BY d)) AS key FROM n UNION ALL SELECT c, 0, 0, '' FROM ids
        ), node AS (
            SELECT d, key, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM p GROUP BY ALL
        ), path AS MATERIALIZED (
            SELECT p.c, p.d, conv_id, n_convs, node.bytes FROM p JOIN node USING (d, key)
        ), up AS MATERIALIZED (
            SELECT a.conv_id, a.d, b.conv_id AS parent, a.n_convs, a.bytes FROM path a LEFT JOIN path b ON b.c = a.c AND b.d = a.d - 1 WHERE a.c = a.conv_id
        ), kids AS (
            SELECT parent AS conv_id, d - 1 AS d, count(*) AS n_children FROM up WHERE d > 0 GROUP BY ALL
        ), sums AS (
            SELECT path.conv_id, path.d, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((up.n_convs - 1) * up.bytes)::BIGINT AS saved_tokens
            FROM up LEFT JOIN kids USING (conv_id, d) JOIN path ON path.c = up.conv_id AND path.d <= up.d GROUP BY ALL
        ), ends AS (
            SELECT conv_id, d, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends_sha256 FROM path WHERE (c, d) IN (SELECT (c, max(d)) FROM p GROUP BY c) GROUP BY ALL
        )
        SELECT conv_id, d::BIGINT AS depth, parent AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
        FROM up LEFT JOIN kids USING (conv_id, d) JOIN sums USING (conv_id, d) LEFT JOIN ends USING (conv_id, d)
    """,
    "op13_spelling_variants": f"""
        WITH RECURSIVE k AS MATERIALIZED ({_CRC_TABLE}), t AS (
            SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents
        ), c AS (
            SELECT doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM t WHERE length(run) >= 6 GROUP BY 1, 2
        ), h AS (
            SELECT run, n, {_CRC.format("(doc || ':' || run)")} AS h FROM c, k
        ), v AS MATERIALIZED (
            SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, sum(n)::BIGINT AS n
            FROM h GROUP BY 1 HAVING sum(n) >= 5 AND length(word) >= 6
        ), d AS MATERIALIZED (
            SELECT word, n, i, word[:i - 1] || word[i + 1:] AS less FROM v, unnest(range(1, length(word) + 1)) AS u(i)
        ), p AS (
            SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.i = b.i AND a.less = b.less AND length(a.word) = length(b.word) AND a.word <> b.word
            UNION SELECT d.word, v.word, v.n FROM d JOIN v ON v.word = d.less
            UNION SELECT v.word, d.word, d.n FROM d JOIN v ON v.word = d.less
        ), b AS MATERIALIZED (
            SELECT word, count(*) AS n_near, min(struct_pack(o := -near_n, near := near)) AS best FROM p GROUP BY 1
        ), f AS MATERIALIZED (
            SELECT v.word, CASE WHEN -best.o >= 5 * n THEN best.near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.o >= 5 * n THEN -best.o END AS form_n
            FROM v LEFT JOIN b USING (word)
        ), w AS (
            SELECT word, word AS at, form AS after FROM f
            UNION ALL SELECT w.word, f.word, f.form FROM w JOIN f ON f.word = w.after
        )
        SELECT f.word, form, w.at AS root, n, n_near, form_n FROM f JOIN w ON w.word = f.word AND w.after IS NULL
    """,
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
