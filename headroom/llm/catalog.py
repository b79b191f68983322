"""The registered corpus queries: thin contract views over the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headroom.llm import decontaminate, fixity, language, minhash, packing, personal_data, prefix_trie, quality_classifier, quality_rules, repeated_bytes, repeated_passages, simhash, whitening
from headroom.llm.common import is_held_out, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_classifier.with_score(docs.select("doc_id", "text"), weights)
    return scored.select(
        F.col("row.doc_id").alias("doc_id"),
        is_held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= quality_classifier.THRESHOLD).cast("int").alias("predicted"),
    )


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = fixity.archive(table(spark, sf_dir, "pages"))
    return fixity.audit(records, fixity.damaged(records))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.with_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        decontaminate.hit_words(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages.without_repeats(table(spark, sf_dir, "documents"), keep_text=False)


def vocabulary_path() -> str:
    """The public vocabulary file; it stays where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), packing.vocabulary_text(vocabulary_path()))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.with_language(docs.select("doc_id", "text"), language.fit(docs))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), is_held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score"
    )


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes.without_repeats(table(spark, sf_dir, "documents"), keep_bytes=False)


def op8_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.with_spans(table(spark, sf_dir, "documents"), "doc_id")

    def count(kind: int) -> Column:  # a second parameter of the lambda would be the place in the array
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(kind).alias(f"n_{name}") for kind, name in enumerate(personal_data.KINDS)]
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *counts,
        F.sha2(personal_data.as_text(F.col("base")), 256).alias("base_sha256"),
        personal_data.as_text(F.col("spans")).alias("spans"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )


def op10_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, conversations = prefix_trie.rebuilt(prefix_trie.ordered_turns(table(spark, sf_dir, "conversations")))
    return prefix_trie.prefix_trie(turns, conversations)


def op12_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select(
        F.col("row.vec_id").alias("vec_id"),
        "component",
        "n",
        F.col("deviation").cast("long").alias("deviation"),
        "whitened",
        "explained",
        "identity_error",
    )


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_warc_fixity": op2_warc_fixity,
    "op3_decontamination": op3_decontamination,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_packing": op5_packing,
    "op6_language_id": op6_language_id,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_pii_bootstrap": op8_pii_bootstrap,
    "op9_quality_rules": op9_quality_rules,
    "op10_simhash_neardup": op10_simhash_neardup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_minhash_neardup": op12_minhash_neardup,
    "op13_embedding_whitening": op13_embedding_whitening,
}

#: Records in files of 1024 ids, hashed, then hashes of 16 neighbours with their range, three times.
OP2_SQL = """
WITH records AS (
  SELECT page_id, CAST(floor(page_id / 1024) AS BIGINT) AS file,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') AS record
  FROM pages
), placed AS (
  SELECT *, CAST(row_number() OVER f - 1 AS BIGINT) AS number, CAST(strlen(record) + 4 AS BIGINT) AS length,
    CAST(coalesce(sum(strlen(record) + 4) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM records WINDOW f AS (PARTITION BY file ORDER BY page_id, record)
), leaves AS (
  SELECT page_id, file, number, "offset", length, sha256(record) AS a,
    CASE WHEN page_id % 103 = 7 THEN 'gone' WHEN page_id % 101 = 5 THEN sha256(left(record, length(record) - 1) || '?') ELSE sha256(record) END AS b
  FROM placed
), one AS (SELECT file, number // 16 AS number, min("offset") AS "offset", sum(length) AS length,
    sha256(min("offset") || ':' || sum(length) || ':' || string_agg(a, ',' ORDER BY number)) AS a,
    sha256(min("offset") || ':' || sum(length) || ':' || string_agg(b, ',' ORDER BY number)) AS b FROM leaves GROUP BY 1, number // 16
), two AS (SELECT file, number // 16 AS number, min("offset") AS "offset", sum(length) AS length,
    sha256(min("offset") || ':' || sum(length) || ':' || string_agg(a, ',' ORDER BY number)) AS a,
    sha256(min("offset") || ':' || sum(length) || ':' || string_agg(b, ',' ORDER BY number)) AS b FROM one GROUP BY 1, number // 16
), three AS (SELECT file, number // 16 AS number, min("offset") AS "offset", sum(length) AS length,
    sha256(min("offset") || ':' || sum(length) || ':' || string_agg(a, ',' ORDER BY number)) AS a,
    sha256(min("offset") || ':' || sum(length) || ':' || string_agg(b, ',' ORDER BY number)) AS b FROM two GROUP BY 1, number // 16
), depth AS (SELECT max(number) AS largest FROM leaves),
roots AS (
  SELECT file, a, b FROM one WHERE (SELECT largest FROM depth) < 16
  UNION ALL SELECT file, a, b FROM two WHERE (SELECT largest FROM depth) BETWEEN 16 AND 255
  UNION ALL SELECT file, a, b FROM three WHERE (SELECT largest FROM depth) > 255
)
SELECT l.page_id, l.file, l."offset", l.length, l.a AS digest, r.a AS root, r.b AS replica_root,
  CASE WHEN l.a = l.b THEN 'same' WHEN l.b = 'gone' THEN 'gone' ELSE 'changed' END AS state
FROM leaves l JOIN roots r USING (file)
"""

#: Words of item or document, one row per word; a window per item position; hit words by position.
OP3_SQL = """
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM items WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM windows
), places AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM doc_words, lengths WHERE len(w) >= n)
), found AS (SELECT doc_id, item_id, n, i FROM places JOIN windows USING (n, s)
), hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(generate_series(0, n - 1)) AS k FROM found) GROUP BY doc_id
), ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

#: A window per place, with the first place of its like; words under later ones go.
OP4_SQL = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, i, sha256(array_to_string(w[i : i + 19], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d WHERE len(w) >= 20)
), later AS (
  SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS j FROM (SELECT doc_id, i, unnest(generate_series(0, 19)) AS k FROM later)
), words AS (
  SELECT doc_id, j, w[j] AS word FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS j FROM d)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id
), counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)
"""

#: Paths by sums over prefixes written as text; a node's subtree is found over the paths of smallest members.
OP11_SQL = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS position, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS first,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 AS h
  FROM turns
), lengths AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id
), heads AS (
  SELECT ids.conv_id, position, role, text FROM ids JOIN turns ON turns.conv_id = first AND position <= h
), paths AS (
  SELECT * FROM heads
  UNION ALL
  SELECT ids.conv_id, least(h, coalesce(n, 0)) + position - h, role, text
  FROM ids JOIN turns USING (conv_id) LEFT JOIN lengths ON lengths.conv_id = first WHERE position > h
), keyed AS (
  SELECT conv_id, position AS depth, strlen(text) AS bytes,
    string_agg(sha256(role || chr(1) || text), ',') OVER (PARTITION BY conv_id ORDER BY position) AS path
  FROM paths
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids
), nodes AS (
  SELECT path, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, (count(*) - 1) * min(bytes) AS weight FROM keyed GROUP BY path
), kids AS (
  SELECT above.path, count(*) AS n_children FROM nodes JOIN keyed AS above ON above.conv_id = nodes.conv_id AND above.depth = nodes.depth - 1 GROUP BY above.path
), parents AS (
  SELECT nodes.path, up.conv_id AS parent_conv_id
  FROM nodes JOIN keyed AS above ON above.conv_id = nodes.conv_id AND above.depth = nodes.depth - 1 JOIN nodes AS up ON up.path = above.path
), subtrees AS (
  SELECT above.path, sum(weight) AS saved, count(*) FILTER (WHERE kids.path IS NULL) AS n_leaves
  FROM nodes JOIN keyed AS above ON above.conv_id = nodes.conv_id AND above.depth <= nodes.depth LEFT JOIN kids ON kids.path = nodes.path
  GROUP BY above.path
), last AS (SELECT conv_id, max(depth) AS depth FROM keyed GROUP BY conv_id
), ends AS (
  SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256 FROM keyed JOIN last USING (conv_id, depth) GROUP BY path
)
SELECT conv_id, depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
  coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM nodes JOIN subtrees USING (path) LEFT JOIN kids USING (path) LEFT JOIN parents USING (path) LEFT JOIN ends USING (path)
"""

#: Sets of shingles, one row per shingle; similar pairs over common shingles; what they reach.
OP12_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT DISTINCT doc_id, s
  FROM (SELECT doc_id, unnest(list_transform(generate_series(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i : i + 1], ' '))) AS s FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

ORACLE: dict[str, str] = {
    "op2_warc_fixity": OP2_SQL,
    "op3_decontamination": OP3_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_minhash_neardup": OP12_SQL,
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
