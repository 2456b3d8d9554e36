"""The registered queries of this subpackage; each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import conversations, decontaminate, huffman, jaccard, licenses, packing, quality, resample, substring, suffix, tokens, topk, warc
from shelfspark.llm.common import table


def op1_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


def op2_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokens.vocabulary("byte_bpe_50k.json"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.suffix_dedup(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality(docs, quality.fit_references(docs))


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op7_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.huffman_ids(table(spark, sf_dir, "documents"), tokens.vocabulary("byte_bpe_50k.json"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokens.vocabulary("byte_bpe_50k.json"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.repair_report(conversations.damaged(rows), rows)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_warc_packages": op1_warc_packages,
    "op2_length_buckets": op2_length_buckets,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_winnowing": op5_winnowing,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_token_id_files": op7_token_id_files,
    "op8_token_counts": op8_token_counts,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_exact_topk": op11_exact_topk,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_importance_resampling": op13_importance_resampling,
}

#: Small letters for A-Z only, and words of a contract's character class.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_B32 = "list_transform(range(8), lambda g: ('0x' || substr(h, CAST(5 * g + 1 AS INTEGER), 5))::INTEGER)"

#: crc32 of a text's UTF-8 bytes; {t} is a list of 256 numbers.
_CRC_TABLE = "SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t"
_CRC = "xor(list_reduce(list_transform(range(octet_length(encode({x}))), lambda i: ('0x' || substr(hex(encode({x})), CAST(2 * i + 1 AS INTEGER), 2))::BIGINT), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]), 4294967295), 4294967295)"
_EDIT = "{{'c': {} + {}.c, 'a': '{}' || {}.a}}"
_DELETE, _KEEP, _REROLE = (lambda to: _EDIT.format(2, to, "D", to)), (lambda to: _EDIT.format("x", to, "K", to)), (lambda to: _EDIT.format("x + 1", to, "R", to))
_INSERT = lambda to, n=1: _EDIT.format(5 * n, to, "I" * n, to)

#: The contract's results in DuckDB SQL, over whole tables; the others need the tokenizer, the divergence rules, the program of buckets, or n_shared.
SQL: dict[str, str] = {
    "op1_warc_packages": f"""
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS x FROM pages),
        h AS (SELECT page_id, url, CAST(strlen(x) AS BIGINT) AS payload_bytes, sha1(x) AS h FROM p),
        d AS (SELECT page_id, url, payload_bytes, array_to_string(list_transform({_B32}, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> k) & 31) + 1, 1)), '')), '') AS payload_digest FROM h)
        SELECT *, CASE WHEN page_id = min(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> min(page_id) OVER w THEN min(page_id) OVER w END AS refers_to FROM d WINDOW w AS (PARTITION BY payload_digest)""",
    "op5_winnowing": f"""
        WITH d AS (SELECT doc_id, {_ALNUM.format(_LOWER)} AS w FROM documents), i AS (SELECT item_id, {_ALNUM.format(_LOWER)} AS w FROM benchmark),
        iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
        dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw))),
        hit AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN iw ON iw.n = dw.n AND iw.k = dw.k),
        spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY 1),
        its AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS l FROM hit GROUP BY 1)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(l), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN spots ON spots.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id""",
    "op6_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 2], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
        z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM o JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
        m AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
        SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, component_id FROM d JOIN m ON m.a = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id""",
    "op9_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
        g AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d)),
        h AS (SELECT doc_id, s FROM (SELECT *, min(doc_id) OVER (PARTITION BY k) AS least FROM g) WHERE least < doc_id),
        p AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(s, s + 13)) AS p FROM h) GROUP BY 1),
        k AS (SELECT d.doc_id, string_agg(x, ' ' ORDER BY d.i) AS kept FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) d LEFT JOIN (SELECT doc_id, unnest(gone) AS i FROM p) q ON q.doc_id = d.doc_id AND q.i = d.i WHERE q.i IS NULL GROUP BY 1)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op11_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5""",
    "op12_conversation_repair": rf"""
        WITH RECURSIVE crc AS ({_CRC_TABLE}),
        k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format(x="(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS k FROM conversations, crc),
        d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS again FROM k WHERE k <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
        f AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS r, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'fine' END AS fault FROM o),
        g AS (SELECT *, fault IN ('fine', 'truncated') AS ok, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS x FROM f),
        ends AS (SELECT conv_id, max(i) AS i FROM g GROUP BY 1),
        s AS (SELECT conv_id, i, {{'c': 0, 'a': ''}} AS s0, {{'c': 10, 'a': 'II'}} AS s1, {{'c': 5, 'a': 'I'}} AS s2, {{'c': 0, 'a': ''}} AS s3 FROM ends
            UNION ALL
            SELECT conv_id, i - 1, least(b0, {_INSERT("b2")}, {_INSERT("b3", 2)}), least(b1, {_INSERT("b2")}, {_INSERT("b3", 2)}), least(b2, {_INSERT("b3")}), least(b3, {_INSERT("b2")})
            FROM (SELECT s.conv_id, s.i, least({_DELETE("s0")}, CASE WHEN ok AND r = 's' THEN {_KEEP("s1")} END, CASE WHEN ok AND r = 'u' THEN {_KEEP("s2")} END, CASE WHEN ok THEN {_REROLE("s2")} END) AS b0,
                least({_DELETE("s1")}, CASE WHEN ok AND r = 'u' THEN {_KEEP("s2")} END, CASE WHEN ok THEN {_REROLE("s2")} END) AS b1,
                least({_DELETE("s2")}, CASE WHEN ok AND r = 'a' THEN {_KEEP("s3")} END, CASE WHEN ok THEN {_REROLE("s3")} END) AS b2,
                least({_DELETE("s3")}, CASE WHEN ok AND r = 'u' THEN {_KEEP("s2")} END, CASE WHEN ok THEN {_REROLE("s2")} END) AS b3
                FROM s JOIN g ON g.conv_id = s.conv_id AND g.i = s.i WHERE s.i > 0)),
        a AS (SELECT conv_id, s0.c AS cost, s0.a AS audit FROM s WHERE i = 0),
        e AS (SELECT conv_id, unnest(string_split(audit, '')) AS e, unnest(range(1, len(audit) + 1)) AS p FROM a WHERE audit <> ''),
        n AS (SELECT *, count(*) FILTER (e <> 'I') OVER w AS i, count(*) FILTER (e <> 'D') OVER w AS turn_no FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
        t AS (SELECT n.conv_id, p, e, turn_no, g.role, CASE WHEN e = 'I' THEN '' ELSE g.text END AS text, bool_or(turn_no = 1 AND e = 'K' AND g.r = 's') OVER (PARTITION BY n.conv_id) AS led FROM n LEFT JOIN g ON g.conv_id = n.conv_id AND g.i = n.i WHERE e <> 'D'),
        h AS (SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (turn_no - led::INTEGER) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p)) AS repaired_sha256 FROM t GROUP BY 1),
        c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT *, lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair FROM f) GROUP BY 1)
        SELECT q.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN c ON c.conv_id = q.conv_id LEFT JOIN a ON a.conv_id = q.conv_id LEFT JOIN h ON h.conv_id = q.conv_id""",
    "op13_importance_resampling": f"""
        WITH crc AS ({_CRC_TABLE}),
        d AS (SELECT doc_id, {_ALNUM.format(_LOWER)} AS w FROM documents), b AS (SELECT {_ALNUM.format(_LOWER)} AS w FROM benchmark),
        wd AS (SELECT doc_id, unnest(w) AS x FROM d), wb AS (SELECT unnest(w) AS x FROM b),
        k AS (SELECT x, {_CRC.format(x="x")} % 10000 AS k FROM (SELECT x FROM wd UNION SELECT x FROM wb), crc),
        s AS (SELECT k, count(*) AS s FROM wd JOIN k USING (x) GROUP BY 1), t AS (SELECT k, count(*) AS t FROM wb JOIN k USING (x) GROUP BY 1),
        g AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM wd) + 10000) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM wb) + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (k)),
        m AS (SELECT doc_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM wd JOIN k USING (x) JOIN g USING (k) GROUP BY 1),
        r AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN m USING (doc_id)),
        p AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM r WHERE n_features >= 20 QUALIFY rank <= (10 * count(*) OVER ()) // 100)
        SELECT r.*, rank FROM r LEFT JOIN p USING (doc_id)""",
}
