"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression_quality, fill_in_middle, fm_dedup, html_extraction, jaccard_join, language_id, media, mixing, prefix_trie, quality_rules
from . import secret_scan, sentence_pieces, sharding
from .common import table


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best and second and third best segmentation of every text."""
    return sentence_pieces.encode(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_dedup.strip(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept",
        256).alias("kept_sha256"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all tokens, in three passes at most, with domains, languages and sources brought nearer to each other."""
    docs = table(spark, sf_dir, "documents")
    taken = mixing.select(docs, [mixing.domain_of(), F.col("lang"), F.col("source")], mixing.smoothed(0.5), 0.5, 3)
    return taken.select("doc_id", F.col("mix_level_0").alias("domain"), F.col("mix_level_1").alias("language"), F.col(
        "mix_level_2").alias("leaf"), mixing.tokens_of().alias("tokens"), "copies")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.grouped(table(spark, sf_dir, "documents"), k=4, percent=85)


def op8_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(table(spark, sf_dir, "documents"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secrets(table(spark, sf_dir, "documents")))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle.transform(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(
        fill_in_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


QUERIES = {
    "op1_sentence_pieces": op1_sentence_pieces,
    "op2_html_extraction": op2_html_extraction,
    "op3_language_id": op3_language_id,
    "op4_fm_dedup": op4_fm_dedup,
    "op5_mixing": op5_mixing,
    "op6_sharding": op6_sharding,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_compression_quality": op8_compression_quality,
    "op9_quality_rules": op9_quality_rules,
    "op10_media_columns": op10_media_columns,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_secret_scan": op12_secret_scan,
    "op13_fill_in_middle": op13_fill_in_middle,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op4_fm_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT r, unnest(range(1, len(w) - 33)) AS p, unnest(list_transform(range(1, len(w) - 33), lambda i: array_to_string(w[i:i + 34], ' '))) AS t FROM d WHERE len(w) >= 35),
        again AS (SELECT t FROM s GROUP BY t HAVING count(*) > 1),
        starts AS (SELECT r, p FROM s SEMI JOIN again USING (t)),
        words AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
        flagged AS (SELECT words.*, max(starts.p) OVER (PARTITION BY words.r ORDER BY words.p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM words LEFT JOIN starts ON words.r = starts.r AND words.p = starts.p),
        kept AS (SELECT r, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS t FROM flagged GROUP BY r)
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
    """,
    "op7_jaccard_join": r"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS (SELECT r, doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
        items AS (SELECT r, len(s) AS n, unnest(s) AS t FROM sets),
        pairs AS (SELECT a.r AS x, b.r AS y, a.n AS nx, b.n AS ny, count(*) AS i FROM items a JOIN items b ON a.t = b.t AND a.r <> b.r GROUP BY ALL),
        links AS (SELECT x, y FROM pairs WHERE 100 * i >= 85 * (nx + ny - i)),
        reach AS (SELECT r AS x, r AS y FROM sets UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
        SELECT any_value(sets.doc_id) AS doc_id, any_value(len(sets.s)) AS n_shingles, min(other.doc_id) AS component_id
        FROM sets JOIN reach ON sets.r = reach.x JOIN sets other ON other.r = reach.y GROUP BY sets.r
    """,
    "op11_prefix_trie": r"""
        WITH t AS (SELECT conv_id AS c, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS m, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
        own AS (SELECT c, list(m ORDER BY p) AS ms, crc.h FROM t JOIN (SELECT DISTINCT conv_id AS c, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda d: [ascii(d)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda v, x: xor(xor(v, x) >> 1, CASE WHEN xor(v, x) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 6 AS h FROM conversations) crc USING (c) GROUP BY ALL),
        rebuilt AS (SELECT own.c, list_concat(coalesce(list_slice(base.ms, 1, own.h), []), coalesce(list_slice(own.ms, own.h + 1, len(own.ms)), [])) AS ms FROM own LEFT JOIN own base ON base.c = own.c - own.c % 100),
        prefixes AS (SELECT c, unnest(range(len(ms) + 1)) AS depth, ms FROM rebuilt),
        members AS (SELECT c, depth, list_slice(ms, 1, depth) AS node, depth = len(ms) AS last FROM prefixes),
        nodes AS (SELECT node, any_value(depth) AS depth, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends_sha256 FROM members GROUP BY node),
        children AS (SELECT list_slice(node, 1, depth - 1) AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
        whole AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children, coalesce((n_convs - 1) * length(node[depth].text), 0) AS saves FROM nodes LEFT JOIN children USING (node)),
        above AS (SELECT list_slice(node, 1, up) AS node, n_children, saves FROM (SELECT node, n_children, saves, unnest(range(depth + 1)) AS up FROM whole)),
        below AS (SELECT node, count(*) FILTER (n_children = 0) AS n_leaves, sum(saves)::BIGINT AS saved_tokens FROM above GROUP BY node)
        SELECT whole.conv_id, whole.depth, parent.conv_id AS parent_conv_id, whole.n_convs, whole.n_children, n_leaves, saved_tokens, whole.ends_sha256
        FROM whole JOIN below USING (node) LEFT JOIN whole parent ON whole.depth > 0 AND parent.node = list_slice(whole.node, 1, whole.depth - 1)
    """,
    "op13_fill_in_middle": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
        h AS (SELECT *, len(u) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
        f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h),
        p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
        FROM p
    """,
}
