"""The queries of this subpackage, by name, over the tables of a folder; and SQL for those that SQL can express."""

import public_tokenizers

from . import chat, extraction, fingerprints, jaccard, licences, mixing, packing, quality, repeats, tokens
from .shared import documents

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_html_main_text(spark, sf_dir):
    return extraction.main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_quality_rules(spark, sf_dir):
    judged = quality.quality_rules(documents(spark, sf_dir))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "quality")


def op3_source_mixing(spark, sf_dir):
    return mixing.placed(documents(spark, sf_dir))


def op4_licence_scan(spark, sf_dir):
    return licences.licence_scan(documents(spark, sf_dir))


def op5_chat_tree(spark, sf_dir):
    return chat.formatted(spark.read.parquet(f"{sf_dir}/conversations.parquet"), TOKENIZER)


def op6_token_counts(spark, sf_dir):
    return tokens.token_counts(documents(spark, sf_dir), TOKENIZER)


def op7_repeated_passages(spark, sf_dir):
    return repeats.repeats(documents(spark, sf_dir)).select("doc_id", "first_word", "end_word", "n_words")


def op8_best_fit_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), TOKENIZER)


def op9_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op10_jaccard_join(spark, sf_dir):
    return jaccard.near_groups(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_main_text, op2_quality_rules, op3_source_mixing, op4_licence_scan, op5_chat_tree,
        op6_token_counts, op7_repeated_passages, op8_best_fit_packing, op9_fingerprints, op10_jaccard_join,
    )
}

_ESCAPED = r"replace(replace(replace({}, '\', '\\'), '<', '\l'), '[', '\b')"

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL = {
    "op3_source_mixing": f"""
        WITH rows AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(length(text), 0) AS mass FROM documents),
        starts AS (
            SELECT *, CAST(coalesce(sum(mass) OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || mass), doc_id, mass ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
                CAST(greatest(1, ceil(sum(mass) OVER (PARTITION BY source) / {mixing.BLOCK_CHARS})) AS BIGINT) AS n_blocks FROM rows),
        slots AS (
            SELECT source, block, row_number() OVER (ORDER BY block, source) - 1 AS slot
            FROM (SELECT source, unnest(range(n_blocks)) AS block FROM (SELECT DISTINCT source, n_blocks FROM starts))),
        rounds AS (SELECT block, min(slot) AS release, max(slot) + 1 AS deadline FROM slots GROUP BY block)
        SELECT doc_id, source, mass, source AS stream, block, slot, release, deadline, start - block * {mixing.BLOCK_CHARS} AS "offset"
        FROM (SELECT *, least(start // {mixing.BLOCK_CHARS}, n_blocks - 1) AS block FROM starts) JOIN slots USING (source, block) JOIN rounds USING (block)""",
    "op7_repeated_passages": f"""
        WITH words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        windows AS (SELECT doc_id, s, md5(array_to_string(w[s + 1:s + {repeats.MIN_WORDS}], ' ')) AS h FROM (SELECT *, unnest(range(0, len(w) - {repeats.MIN_WORDS - 1})) AS s FROM words)),
        later AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS n FROM windows) WHERE n > 1),
        parts AS (
            SELECT *, sum(CASE WHEN s <= before + {repeats.MIN_WORDS} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS part
            FROM (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM later))
        SELECT doc_id, min(s) AS first_word, max(s) + {repeats.MIN_WORDS} AS end_word, max(s) + {repeats.MIN_WORDS} - min(s) AS n_words FROM parts GROUP BY doc_id, part""",
    "op5_chat_tree": rf"""
        WITH rows AS (
            SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS orphan, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT {chat.PROBE[0]}, NULL, 0, 'user', '{chat.PROBE[1]}'
            UNION ALL SELECT {chat.PROBE[0]}, NULL, 1, 'assistant', '{chat.PROBE[1]}'),
        paths AS (SELECT *, md5(CAST(list({{'r': role, 't': text}}) OVER (PARTITION BY conv_id, orphan ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS VARCHAR)) AS path FROM rows),
        used AS (SELECT *, count(*) OVER (PARTITION BY path) AS uses FROM paths)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
            CAST(sum({len(chat.TURN) + 1 + len(chat.END)} + length(replace({_ESCAPED.format("role")}, chr(10), '\n')) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars,
            count(*) FILTER (WHERE uses > 1) AS n_shared_turns
        FROM used GROUP BY conv_id, orphan""",
    "op10_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        shingles AS (
            SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s
            FROM words),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
            FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (
            SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
            WHERE 100 * c >= 75 * (p.n + q.n - c)),
        near AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
        reach AS (
            SELECT doc_id, doc_id AS r FROM words
            UNION SELECT reach.doc_id, near.y FROM reach JOIN near ON near.x = reach.r),
        least AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
        SELECT words.doc_id, coalesce(sizes.n, 0) AS n_shingles, least.component_id
        FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)""",
}
