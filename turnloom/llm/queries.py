"""Queries of the corpus operators: thin digests of what the operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import alignment, block_anchors, bpe, decontaminate, difference_cover, exact_dedup, importance, jaccard_join, prefix_trie, revisits, token_files, transcripts, url_filter
from turnloom.llm.common import new_folder, table


def op3_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_anchors.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return rows.select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.bpe_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)
    return bpe.bpe_decode(ids, path).select("row.doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, folder, digest_only=True).withColumnRenamed("id", "doc_id")


#: Of the turns of op1's transcripts, shares without a speaker and with a wrong one.
LOST, WRONG = 0.25, 0.02


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation is decoded from flawed transcripts, even ones by a model
    of odd ones and the reverse, so that no model has seen what it decodes."""
    turns, out = table(spark, sf_dir, "conversations"), None
    flawed = transcripts.with_lost_markers(turns, LOST, WRONG)
    for side in (0, 1):
        own = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(2)) == side
        part = transcripts.recover_turns(flawed.where(own), transcripts.fit(turns.where(~own)))
        out = part if out is None else out.unionByName(part)
    recovered = F.array_join("roles", ",").alias("roles")
    return out.select("row.conv_id", "row.turn", F.col("row.truth").alias("role"), F.col("row.role").alias("marker"), recovered, F.sha2("rendered", 256).alias("rendered_sha256"))


def op4_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve_revisits(revisits.records_of_pages(table(spark, sf_dir, "pages")))
    fields = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e.key, F.lit(": "), e.value))), "\n")
    return found.select("row.record_id", "canonical_url", "response_id", "status", F.sha2(fields, 256).alias("headers_sha256"), F.sha2("payload", 256).alias("payload_sha256"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("row.doc_id", "n_shingles", "component_id")


def op7_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = difference_cover.remove_repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return importance.Resampler(docs, labels).draw().select("row.doc_id", "log_weight", "key", "kept")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    return decontaminate.find_contamination(docs, items).select("row.doc_id", "item_id", "distance")


#: Verdict, host and path of op11's rules.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = url_filter.judge(pages, url_filter.labelled_pages(pages, table(spark, sf_dir, "labels")), RULES)
    return found.select("row.page_id", "host", "path", "rule", "verdict", "score")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, convs = prefix_trie.grafted(prefix_trie.ordered_turns(table(spark, sf_dir, "conversations")))
    return prefix_trie.prefix_trie(rows, convs, [F.col("kind"), F.col("at")])


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("row.doc_id", *alignment.COLUMNS)


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_jaccard_join, op3_block_anchors, op4_revisits, op5_exact_dedup, op6_bpe, op7_difference_cover, op8_importance, op9_decontamination, op10_token_files, op11_url_filter, op12_prefix_trie, op13_token_alignment)}

ORACLES = {
    "op2_jaccard_join": r"""
        WITH RECURSIVE t AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        k AS (
          SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM t),
        n AS (SELECT doc_id, count(*) AS n FROM k GROUP BY 1),
        pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM k a JOIN k b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
        link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)
        SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, least(t.doc_id, coalesce(r.least, t.doc_id)) AS component_id
        FROM t LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY 1) r USING (doc_id)""",
    "op3_block_anchors": r"""
        WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t),
        v AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 19 <= len(w) THEN array_to_string(w[i:i + 19], ' ') END AS run FROM p),
        f AS (SELECT doc_id, i, word, CASE WHEN run IS NOT NULL AND row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1 THEN 1 ELSE 0 END AS later FROM v),
        g AS (SELECT doc_id, i, word, sum(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) > 0 AS gone FROM f),
        s AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY 1)
        SELECT t.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN s USING (doc_id)""",
    "op4_revisits": r"""
        WITH p AS (
          SELECT page_id, coalesce(html, '') AS html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
          FROM pages),
        c AS (
          SELECT page_id, html, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') AS host,
                 regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path, regexp_extract(bare, '\?(.*)$', 1) AS query
          FROM p),
        u AS (
          SELECT page_id, html, CASE WHEN page_id % 3 = 0 THEN html ELSE html || ' ' END AS later,
                 CASE WHEN host <> '' THEN host || path || CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(query, '&')), '&') END END AS canonical_url,
                 10 * page_id AS t0, 10 * page_id + 40 * (page_id * 31 % 1000) + 25 AS t1
          FROM c),
        full_ AS (
          SELECT 3 * page_id AS record_id, canonical_url, t0 AS ts, html AS payload FROM u
          UNION ALL SELECT 3 * page_id + 1, canonical_url, t1, later FROM u),
        asked AS (
          SELECT 3 * page_id + 2 AS record_id, canonical_url, substr(md5(html), 1, 16) AS tag,
                 CASE WHEN page_id % 29 = 0 THEN t0 - 5 WHEN page_id % 23 = 0 THEN t1 ELSE t0 + 40 * (page_id * 17 % 1500) + 15 END AS ts
          FROM u),
        m AS (
          SELECT a.*, f.record_id AS response_id, f.payload, substr(md5(f.payload), 1, 16) AS response_tag, f.ts AS was,
                 row_number() OVER (PARTITION BY a.record_id ORDER BY f.ts DESC, f.record_id DESC) AS n
          FROM asked a LEFT JOIN full_ f ON a.canonical_url = f.canonical_url AND f.ts < a.ts)
        SELECT record_id, canonical_url, response_id,
               CASE WHEN response_id IS NULL THEN 'orphan' WHEN tag = response_tag THEN 'resolved' ELSE 'mismatch' END AS status,
               sha256(CASE WHEN tag = response_tag THEN concat_ws(chr(10), 'content-type: text/html', 'date: ' || ts, 'etag: W/"' || tag || '"')
                           ELSE concat_ws(chr(10), 'content-length: 0', 'date: ' || ts, 'etag: W/"' || tag || '"') END) AS headers_sha256,
               CASE WHEN tag = response_tag THEN sha256(payload) END AS payload_sha256
        FROM m WHERE n = 1""",
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op12_prefix_trie": r"""
        WITH t AS (
          SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
                 md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
          FROM conversations WHERE conv_id IS NOT NULL),
        z AS (SELECT i AS n, list_reduce(list_prepend(i, range(8)), lambda v, j: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END) AS v FROM range(256) r(i)),
        crc AS (SELECT list(v ORDER BY n) AS tab FROM z),
        h AS (
          SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
                                    lambda v, s: xor(v // 256, tab[xor(v % 256, s) + 1])), 4294967295) % 4 AS h
          FROM (SELECT DISTINCT c FROM t), crc),
        r AS (
          SELECT h.c, 0 AS kind, k, x, words FROM h JOIN t ON t.c = h.c - h.c % 20 AND k <= h
          UNION ALL SELECT t.c, 1, k, x, words FROM t JOIN h ON t.c = h.c AND k > h),
        m AS (SELECT c, row_number() OVER o AS depth, list(x) OVER o AS path, words FROM r WINDOW o AS (PARTITION BY c ORDER BY kind, k)),
        a AS (SELECT c, depth, array_to_string(path, '') AS node, array_to_string(path[:-2], '') AS up, words FROM m UNION ALL SELECT c, 0, '', NULL, 0 FROM h),
        e AS (SELECT c, max_by(node, depth) AS node FROM a GROUP BY 1),
        n AS (SELECT node, any_value(up) AS up, any_value(depth) AS depth, min(c) AS c, count(*) AS n_convs, any_value(words) AS words FROM a GROUP BY 1),
        q AS (SELECT up AS node, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY 1),
        f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN q USING (node)),
        s AS (
          SELECT a.node, sum((f.n_convs - 1) * f.words)::BIGINT AS saved_tokens, count(*) FILTER (f.n_children = 0) AS n_leaves
          FROM f JOIN a ON a.c = f.c AND a.depth <= f.depth GROUP BY 1),
        g AS (SELECT node, string_agg(c, ',' ORDER BY c) AS ends FROM e GROUP BY 1)
        SELECT f.c AS conv_id, f.depth, p.c AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
        FROM f JOIN s USING (node) LEFT JOIN n p ON p.node = f.up LEFT JOIN g ON g.node = f.node""",
}
