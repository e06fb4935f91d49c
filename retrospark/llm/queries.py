"""Registered queries of the training-data operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrospark.llm import adsearch, bitlm, fingerprint, langid, linerules, mixing, neardup, pieces, suffixes, tokenalign, turntrie, urlrules, warc
from retrospark.llm.common import table

# ---------------------------------------------------------------- op1


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprint.fingerprint_with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


# ---------------------------------------------------------------- op2


def op2_adaptive_scan_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors found for every vector whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return adsearch.nearest(rows, F.col("vec_id") % 100 == 0)


# ---------------------------------------------------------------- op3


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learned from the ids whose crc32 mod 4 is not 2."""
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


# ---------------------------------------------------------------- op4


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of ``pages`` judged by the listed rules, then by mined association rules."""
    return urlrules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))


# ---------------------------------------------------------------- op5

WARC_COLUMNS = ["page_id", "record_type", "record_id", "refers_to", "target_uri", "content_type", "source_headers", "payload_digest", "title", "n_links", "block_digest", "content_length"]


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page; blocks and whole records as digests."""
    made = warc.derivatives(warc.responses(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return made.select(*WARC_COLUMNS, F.sha2(F.col("record_text").cast("binary"), 256).alias("record_sha256"))


def warc_sql() -> str:
    """The same records in DuckDB SQL."""

    def quote(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def clean(c: str) -> str:
        for entity, char in warc.ENTITIES:
            c = f"replace({c}, {quote(entity)}, {quote(char)})"
        c = f"regexp_replace({c}, '[ \t\r\f\x0B]+', ' ', 'g')"
        c = f"regexp_replace({c}, ' ?\n[ \n]*', chr(10), 'g')"
        return f"regexp_replace({c}, '^[ \n]+|[ \n]+$', '', 'g')"

    text = "payload"
    for pattern in warc.DROP:
        text = f"regexp_replace({text}, {quote(pattern)}, '', 'g')"
    text = clean(f"regexp_replace(regexp_replace({text}, {quote(warc.BREAK)}, chr(10), 'g'), '<[^>]*>', '', 'g')")
    urn = "'urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12)"
    eol = "chr(13) || chr(10)"
    return f"""
WITH r0 AS (SELECT page_id, url AS target_uri, coalesce(html, '') AS payload, 'sha256:' || sha256(coalesce(html, '')) AS payload_digest FROM pages),
r1 AS (SELECT *, md5('response|' || coalesce(cast(page_id AS VARCHAR), '') || '|' || coalesce(target_uri, '') || '|' || payload_digest) AS h,
  'Content-Type: text/html; charset=utf-8' || {eol} || 'Content-Length: ' || strlen(payload) AS source_headers FROM r0),
r2 AS (SELECT *, {urn.format(h="h")} AS response_id, {clean(f"regexp_extract(payload, {quote(warc.TITLE)}, 1)")} AS title,
  regexp_extract(payload, {quote(warc.LANG)}, 1) AS language, regexp_extract_all(payload, {quote(warc.LINK)}, 1) AS links, {text} AS plain FROM r1),
r3 AS (SELECT *, 'title: ' || replace(title, chr(10), ' ') || {eol} || 'language: ' || language || {eol} || 'payload-digest: ' || payload_digest || {eol}
  || 'source-' || replace(source_headers, chr(10), chr(10) || 'source-') || {eol}
  || coalesce((SELECT string_agg('outlink: ' || u || ' L a/@href' || {eol}, '' ORDER BY i) FROM (SELECT unnest(links) AS u, generate_subscripts(links, 1) AS i)), '') AS fields FROM r2),
k AS (SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type, fields AS block FROM r3
  UNION ALL SELECT *, 'conversion' AS record_type, 'text/plain; charset=utf-8' AS content_type, plain AS block FROM r3),
m AS (SELECT *, md5(record_type || '|' || response_id) AS h2, 'sha256:' || sha256(block) AS block_digest, strlen(block) AS content_length FROM k),
n AS (SELECT *, {urn.format(h="h2")} AS record_id FROM m)
SELECT page_id, record_type, record_id, response_id AS refers_to, target_uri, content_type, source_headers, payload_digest, title, cast(len(links) AS INTEGER) AS n_links,
  block_digest, content_length,
  sha256('WARC/1.1' || {eol} || 'WARC-Type: ' || record_type || {eol} || 'WARC-Record-ID: <' || record_id || '>' || {eol} || 'WARC-Date: 1970-01-01T00:00:00Z' || {eol}
  || coalesce('WARC-Target-URI: ' || target_uri || {eol}, '') || 'WARC-Refers-To: <' || response_id || '>' || {eol} || coalesce('WARC-Refers-To-Target-URI: ' || target_uri || {eol}, '')
  || 'WARC-Refers-To-Date: 1970-01-01T00:00:00Z' || {eol} || 'WARC-Payload-Digest: ' || payload_digest || {eol} || 'WARC-Block-Digest: ' || block_digest || {eol}
  || 'Content-Type: ' || content_type || {eol} || 'Content-Length: ' || content_length || {eol} || {eol} || block) AS record_sha256
FROM n"""


# ---------------------------------------------------------------- op6


def piece_model() -> str:
    """Path of the public 32k BPE model (a parameter of the operator; the file is not part of the repository)."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    model = pieces.PieceTable.from_model(piece_model())
    return pieces.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), model)


# ---------------------------------------------------------------- op7


def op7_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by 3-word shingle sets with a similarity of 0.85 or more."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, percent=85, rows=5, count=24)


# ---------------------------------------------------------------- op8

MIX_ROUNDS = 10
MIX_KEEP = 0.5
MIX_TARGETS = {
    "source": {"src0": 0.22, **{f"src{i}": 0.04 for i in range(1, 20)}, "other": 0.02},
    "lang": {"en": 0.55, "de": 0.15, "es": 0.13, "fr": 0.16, "other": 0.01},
    "topic": {"note": 0.03, "article": 0.27, "report": 0.45, "book": 0.25},
}


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its raked factor, its probability and the sampling decision."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix(docs, MIX_TARGETS, keep=MIX_KEEP, rounds=MIX_ROUNDS).select(
        "doc_id", "tokens", "topic", "factor", "probability", "keep_share", "kept"
    )


def mixing_sql(docs: str = "documents") -> str:
    """The same raking, unrolled: one CTE per half step."""

    def share(dim: str) -> str:
        known = MIX_TARGETS[dim]
        return f"CASE {dim} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in known.items()) + " ELSE 0.0 END"

    def cat(col: str, dim: str) -> str:
        return f"CASE WHEN {col} IN ({', '.join(repr(k) for k in MIX_TARGETS[dim])}) THEN {col} ELSE 'other' END"

    ctes = [
        "w AS (SELECT doc_id, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS tokens FROM "
        + docs
        + ")",
        "d AS (SELECT doc_id, tokens, " + cat("source", "source") + " AS source, " + cat("lang", "lang") + " AS lang, "
        "CASE WHEN tokens < 100 THEN 'note' WHEN tokens < 400 THEN 'article' WHEN tokens < 1500 THEN 'report' ELSE 'book' END AS topic FROM w)",
        "c AS (SELECT source, lang, topic, sum(tokens) AS tokens FROM d GROUP BY ALL)",
        "t AS (SELECT sum(tokens)::DOUBLE AS total FROM c)",
    ]
    for dim in mixing.DIMS:
        ctes.append(f"m_{dim} AS (SELECT {dim}, {share(dim)} AS s, n FROM (SELECT {dim}, sum(tokens) AS n FROM c GROUP BY {dim}) WHERE n > 0)")
    scarce = ", ".join(f"(SELECT min(n / s) * sum(s) FROM m_{d} WHERE s > 0) / (SELECT total FROM t)" for d in mixing.DIMS)
    ctes.append(f"k AS (SELECT least({MIX_KEEP}, {scarce}) AS keep)")
    for dim in mixing.DIMS:
        ctes.append(f"g_{dim} AS (SELECT {dim}, s * (SELECT total FROM t) * (SELECT keep FROM k) / nullif((SELECT sum(s) FROM m_{dim}), 0) AS goal_{dim} FROM m_{dim})")
    ctes.append(
        "f0 AS (SELECT c.*, tokens * (SELECT keep FROM k) AS weight, coalesce(goal_source, 0) AS goal_source, coalesce(goal_lang, 0) AS goal_lang, coalesce(goal_topic, 0) AS goal_topic "
        "FROM c LEFT JOIN g_source USING (source) LEFT JOIN g_lang USING (lang) LEFT JOIN g_topic USING (topic))"
    )
    step = 0
    for _ in range(MIX_ROUNDS):
        for dim in mixing.DIMS:
            ctes.append(
                f"f{step + 1} AS (SELECT * EXCLUDE (weight, m), CASE WHEN m > 0 THEN least(tokens::DOUBLE, weight * goal_{dim} / m) ELSE 0 END AS weight "
                f"FROM (SELECT *, sum(weight) OVER (PARTITION BY {dim}) AS m FROM f{step}))"
            )
            step += 1
    ctes.append(f"p AS (SELECT source, lang, topic, keep, CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END AS chance FROM f{step}, k)")
    return (
        "WITH " + ",\n".join(ctes) + "\nSELECT doc_id, tokens, topic, round(chance / keep, 9) AS factor, round(chance, 9) AS probability, round(keep, 9) AS keep_share, "
        "cast('0x' || substr(md5('0:' || coalesce(cast(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 < round(chance, 9) AS kept FROM d JOIN p USING (source, lang, topic)"
    )


# ---------------------------------------------------------------- op9


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat 50-byte strings of documents with smaller ids."""
    return suffixes.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), length=50)


# ---------------------------------------------------------------- op10


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base score and context-mixing score of every document."""
    return bitlm.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


# ---------------------------------------------------------------- op11


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations with their subtree sums."""
    return turntrie.conversation_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def trie_sql() -> str:
    """The same nodes in DuckDB SQL; a prefix is the list of its turns' digests (CRC-32 bit by bit)."""
    bit = "list_reduce([crc, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, _: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))"
    step = f"list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda r, b: {bit.replace('crc', 'xor(r, b)')})"
    return f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place,
  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % {turntrie.LEAD_GROUP} AS base, xor({step}, 4294967295) % {turntrie.LEAD_MOD} AS h FROM t GROUP BY conv_id),
c AS (SELECT l.*, least(l.h, coalesce(b.n, 0)) AS lead FROM l LEFT JOIN l AS b ON b.conv_id = l.base),
s AS (SELECT conv_id, 0 AS pos, '' AS role, '' AS text FROM c
  UNION ALL SELECT c.conv_id, place + 1, role, text FROM c JOIN t ON t.conv_id = c.base WHERE place < lead
  UNION ALL SELECT c.conv_id, lead + place - h + 1, role, text FROM c JOIN t ON t.conv_id = c.conv_id WHERE place >= h),
p AS (SELECT conv_id, pos AS depth, length(text) AS chars, list(sha256(length(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY pos) AS path,
  max(pos) OVER (PARTITION BY conv_id) AS size FROM s),
n AS (SELECT path, depth, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
  coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = size), '') AS ends FROM p GROUP BY path, depth),
k AS (SELECT path[1 : len(path) - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
a AS (SELECT path[1 : i] AS path, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT path, (n_children = 0)::INT AS leaf, (n_convs - 1) * chars AS saved, unnest(range(1, len(path) + 1)) AS i FROM v) GROUP BY ALL)
SELECT v.conv_id, v.depth, q.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM v JOIN a USING (path) LEFT JOIN v AS q ON q.path = v.path[1 : len(v.path) - 1] AND v.depth > 0"""


# ---------------------------------------------------------------- op12


def op12_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures of every document and the verdict of the cross-document line rules, by source."""
    return linerules.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("n_removed_lines")


def line_rules_sql() -> str:
    """The same measures and rules in DuckDB SQL."""
    word = "'[^ \\t\\n\\x0B\\f\\r]+'"
    lower = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    n = linerules.SPAN
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, {word}) AS words FROM d),
g AS (SELECT r, i, words[i : i + {n - 1}] AS g FROM (SELECT r, words, unnest(range(1, len(words) - {n - 2})) AS i FROM w)),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + {n})) AS j FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1) GROUP BY r),
l AS (SELECT r, host, text, line, array_to_string(regexp_extract_all({lower}, {word}), ' ') AS k, len(regexp_extract_all(line, {word})) AS n
  FROM (SELECT r, host, text, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, {word})),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l GROUP BY r),
hd AS (SELECT host, count(DISTINCT text) AS host_docs FROM d GROUP BY host),
f AS (SELECT host, k FROM (SELECT host, k, count(DISTINCT text) AS n FROM l GROUP BY host, k) JOIN hd USING (host)
  WHERE n > {linerules.MOST_DOCS} AND n > host_docs * {linerules.MOST_SHARE}::DOUBLE),
gone AS (SELECT r, sum(n) AS n FROM l JOIN f USING (host, k) GROUP BY r),
m AS (SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(words) - coalesce(gone.n, 0) AS n_left
  FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_left::BIGINT AS n_left,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_left >= {linerules.LEAST_WORDS} AND n_left >= n_words * {linerules.LEAST_SHARE}::DOUBLE AS kept FROM m"""


# ---------------------------------------------------------------- op13


def byte_bpe() -> str:
    """Path of the public byte-level BPE (a parameter of the operator; the file is not part of the repository)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and corpus-wide pair counts of two tokenizers over every document."""
    return tokenalign.align_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), byte_bpe(), piece_model())


QUERIES = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_adaptive_scan_search": op2_adaptive_scan_search,
    "op3_language_id": op3_language_id,
    "op4_url_filter": op4_url_filter,
    "op5_warc_derivatives": op5_warc_derivatives,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_minhash_neardup": op7_minhash_neardup,
    "op8_mixing": op8_mixing,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_line_rules": op12_line_rules,
    "op13_cross_tokenizer_alignment": op13_cross_tokenizer_alignment,
}

ORACLES = {
    "op5_warc_derivatives": warc_sql(),
    "op8_mixing": mixing_sql(),
    "op11_conversation_trie": trie_sql(),
    "op12_line_rules": line_rules_sql(),
}
