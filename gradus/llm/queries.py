"""One query per corpus operator, over its whole table with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gradus.llm.common import read
from gradus.llm import chat_format, filter_audit, jaccard_join, language_id, line_quality, packing, secret_scan, separator_scan, source_divergence, token_files, url_rules, warc
from gradus.llm.decontamination import contamination_digest


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.quality_digest(read(spark, sf_dir, "documents"))


def op3_huffman_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(read(spark, sf_dir, "pages"), url_rules.production_rules(spark))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets_digest(read(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separator_scan.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), separator=50256)


def op8_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(read(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", planted), (-7, 1, "assistant", planted)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.format_digest(turns.unionByName(extra))


def op11_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interactions(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_line_quality": op2_line_quality,
    "op3_huffman_files": op3_huffman_files,
    "op4_url_rules": op4_url_rules,
    "op5_secret_scan": op5_secret_scan,
    "op6_token_counts": op6_token_counts,
    "op7_language_id": op7_language_id,
    "op8_best_two_fit": op8_best_two_fit,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_chat_format": op10_chat_format,
    "op11_warc_index": op11_warc_index,
    "op12_filter_interactions": op12_filter_interactions,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_quality": r"""
        WITH docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text, source FROM documents),
        split AS (SELECT n, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs),
        windows AS (SELECT n, unnest(range(1, len(words) - 6)) AS i, words FROM split WHERE len(words) > 8),
        repeated AS (
            SELECT n, i FROM (SELECT n, i, count(*) OVER (PARTITION BY n, array_to_string(words[i:i + 7], ' ')) AS times FROM windows) WHERE times > 1),
        covered AS (
            SELECT n, CAST(sum(least(8, i - before)) AS BIGINT) AS n_repeat_words
            FROM (SELECT n, i, coalesce(lag(i) OVER (PARTITION BY n ORDER BY i), i - 8) AS before FROM repeated) GROUP BY n),
        lines AS (SELECT n, source, unnest(string_split(text, chr(10))) AS line FROM docs),
        plain AS (SELECT n, source, trim(lower(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line, line AS raw FROM lines),
        dups AS (SELECT n, count(*) - count(DISTINCT raw) AS n_dup_lines FROM plain WHERE line <> '' GROUP BY n),
        once AS (SELECT n, source, line, count(*) AS times FROM plain WHERE line <> '' GROUP BY ALL),
        hosts AS (SELECT source, count(*) AS docs FROM documents GROUP BY source),
        common AS (
            SELECT once.source, line FROM once JOIN hosts ON once.source IS NOT DISTINCT FROM hosts.source
            GROUP BY once.source, line, docs HAVING count(*) > 20 AND count(*) > docs * 0.01),
        gone AS (
            SELECT n, CAST(sum(len(string_split(once.line, ' '))) AS BIGINT) AS n_removed_words, CAST(sum(len(string_split(once.line, ' ')) * times) AS BIGINT) AS n_gone_words
            FROM once JOIN common ON once.line = common.line AND once.source IS NOT DISTINCT FROM common.source GROUP BY n),
        measured AS (
            SELECT n, doc_id, len(words) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
                CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
                coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_removed_words, 0) AS n_removed_words, coalesce(n_gone_words, 0) AS n_gone_words
            FROM split LEFT JOIN covered USING (n) LEFT JOIN dups USING (n) LEFT JOIN gone USING (n)),
        judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND n_gone_words <= n_words * (1 - 0.3::DOUBLE) AS kept, n_removed_words
        FROM judged""",
    "op4_url_rules": r"""
        WITH parsed AS (
            SELECT page_id,
                coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        rules(rhost, rpath, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
            ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        numbered AS (SELECT *, row_number() OVER () AS n FROM parsed),
        fits AS (
            SELECT n, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
            FROM numbered JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM numbered LEFT JOIN fits USING (n)""",
    "op10_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
                SELECT conv_id, turn, role, text FROM conversations
                UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))),
        numbered AS (
            SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
                15 + 2 * length(role) - length(translate(role, '\#<:', '')) + 2 * length(text) - length(translate(text, '\#<', '')) AS chars
            FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        summed AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto FROM numbered),
        gathered AS (
            SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS said,
                coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '') AS loss,
                CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars,
                count(*) FILTER (role = 'assistant' OR k = n) AS n_examples
            FROM summed GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
            formatted_chars, n_examples FROM gathered""",
    "op11_warc_index": r"""
        WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS payload FROM pages),
        firsts AS (SELECT payload, min(page_id) AS first FROM p WHERE strlen(payload) >= 100 GROUP BY payload),
        parsed AS (
            SELECT *, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS rest FROM p),
        keyed AS (SELECT *, CASE WHEN contains(url, '://') THEN array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || rest ELSE url END AS url_key FROM parsed)
        SELECT page_id, CAST(strlen(keyed.payload) AS BIGINT) AS payload_bytes, sha256(keyed.payload) AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN first < page_id THEN first END AS refers_to, url_key, row_number() OVER (ORDER BY url_key, page_id % 4294967296, page_id) - 1 AS position
        FROM keyed LEFT JOIN firsts ON firsts.payload = keyed.payload""",
    "op12_filter_interactions": r"""
        WITH RECURSIVE docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
        firsts AS (SELECT text, min(doc_id) AS first FROM docs GROUP BY text),
        said AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
        split AS (SELECT docs.*, coalesce(first < doc_id, false) AS copy, regexp_extract_all(docs.text, '[^\x20\x09-\x0D]+') AS words FROM docs JOIN firsts ON firsts.text = docs.text),
        flags AS (
            SELECT k, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, unnest(['A', 'B', 'C', 'D', 'E']) AS filter,
                unnest([len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
                    100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(text), regexp_matches(text, '[#$%&*|]'), copy]) AS fails
            FROM split LEFT JOIN said ON said.doc_id = split.doc_id),
        orders AS (
            SELECT '' AS filter_order UNION ALL
            SELECT filter_order || x FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE instr(filter_order, x) = 0),
        steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders WHERE length(filter_order) = 5),
        fates AS (SELECT k, part, good, toxic, coalesce(string_agg(filter, '' ORDER BY filter) FILTER (fails), '') AS failed FROM flags GROUP BY ALL),
        kinds AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fates GROUP BY ALL),
        placed AS (
            SELECT *, instr(failed, filter_order[step]) > 0 AS has, list_min(list_transform(string_split(failed, ''), lambda f: instr(filter_order, f))) AS hit
            FROM kinds, steps),
        audit AS (
            SELECT part, filter_order, step, coalesce(sum(n) FILTER (failed = '' OR hit > step), 0) AS kept, coalesce(sum(n) FILTER (hit = step AND failed <> ''), 0) AS removed,
                coalesce(sum(n) FILTER (has AND hit < step), 0) AS redundant, coalesce(sum(n) FILTER (failed = filter_order[step]), 0) AS unique_fails,
                coalesce(sum(good) FILTER (hit = step AND failed <> ''), 0) AS good_lost, coalesce(sum(toxic) FILTER (hit = step AND failed <> ''), 0) AS toxic_lost
            FROM placed GROUP BY ALL)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
            CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
            CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley FROM audit""",
    "op13_source_divergence": r"""
        WITH docs AS (SELECT row_number() OVER () AS k, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
        said AS (
            SELECT k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
        kept AS (SELECT lang, term FROM said GROUP BY ALL HAVING count(DISTINCT k) >= 30),
        used AS (SELECT lang, source, term, count(*) AS n FROM said JOIN kept USING (lang, term) GROUP BY ALL),
        groups AS (SELECT DISTINCT lang, source FROM docs),
        terms AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        totals AS (SELECT lang, source, sum(n) AS total FROM used GROUP BY ALL),
        dense AS (
            SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (coalesce(total, 0) + 5 * v) AS p
            FROM groups JOIN kept USING (lang) JOIN terms USING (lang) LEFT JOIN totals USING (lang, source) LEFT JOIN used USING (lang, source, term)),
        whole AS (
            SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q
            FROM dense GROUP BY lang, term),
        far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        found AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
            UNION ALL
            SELECT dense.lang, source, 'term', dense.term, p - q FROM dense JOIN whole ON whole.lang = dense.lang AND whole.term = dense.term WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found) WHERE part = 'pair' OR rank <= 50""",
}
