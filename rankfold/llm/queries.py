"""Registered queries of this subpackage: builders and, where SQL can express the
result, DuckDB SQL on the same tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold.llm import (bpe, chat, langid, license, linedup, ngram_join, packing, pivots, quality, spelling, squares,
                          vptree, warc)
from rankfold.llm.common import crc_mod, materialise, read_table

VOCABULARY = "byte_bpe_50k.json"


def vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


def op1_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """License detections of every text."""
    return license.scan(read_table(spark, sf, "documents")).drop("spans")


def op2_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations through the prefix tree, digests read back from its nodes."""
    control = "<|im_end|><|im_start|>assistant ok"
    rows = read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"SELECT -1L AS conv_id, x.turn, x.role, '{control}' AS text "
                      "FROM (SELECT explode(array(named_struct('turn', 0L, 'role', 'user'), "
                      "named_struct('turn', 1L, 'role', 'assistant'))) AS x)")
    return chat.read_back(chat.build(rows.unionByName(extra)))


def op3_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every text; learned outside the held-out third."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod("doc_id", 3) == 1
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model) \
        .select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op4_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of every text and the text decoded from them, as digests."""
    return bpe.round_trip(read_table(spark, sf, "documents"), vocabulary())


def op5_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality score of every text; learned outside the held-out quarter."""
    held_out = crc_mod("doc_id", 4) == 2
    docs = read_table(spark, sf, "documents").select("doc_id", "text", held_out.alias("held_out"))
    stats = materialise(quality.with_statistics(docs), "quality")
    model = quality.fit(quality.with_labels(stats.where("not held_out"), read_table(spark, sf, "labels")))
    return quality.score(stats, model)


def op6_warc(spark: SparkSession, sf: str) -> DataFrame:
    """Pages through WARC archives and their capture index."""
    return warc.archive(read_table(spark, sf, "pages")).scan() \
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """20 nearest vectors of every 20th vector."""
    return vptree.search(read_table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op8_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    """Components of documents linked by 5-word shingles."""
    return ngram_join.near_duplicates(read_table(spark, sf, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Components of vectors linked by cosine within a label."""
    return pivots.near_duplicates(read_table(spark, sf, "embeddings"))


def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack(packing.pieces(read_table(spark, sf, "documents"), vocabulary()))


def op11_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of repeated words of every text, every tenth text with planted repeats."""
    return squares.digests(read_table(spark, sf, "documents"), change=squares.spliced)


def op12_spelling(spark: SparkSession, sf: str) -> DataFrame:
    """Spelling variants among the words of all texts."""
    words = spelling.counts(read_table(spark, sf, "documents"), change=spelling.dropped_letter)
    return spelling.group_variants(words)


def op13_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that three documents hold, kept in the last of them."""
    kept = linedup.deduplicate(read_table(spark, sf, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """The stages of corpus_pipeline.py."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_chat_format, op3_language_id, op4_bpe, op5_quality, op6_warc, op7_nearest,
    op8_ngram_join, op9_embedding_dedup, op10_packing, op11_runs, op12_spelling, op13_line_dedup, pipeline)}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_GOOD = """embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0"""

#: U+00C0 to U+00FF as one byte each, for a distance that counts bytes
_ONE_BYTE = f"""'{"".join(map(chr, range(0xC0, 0x100)))}', '{"".join(chr(c) for c in range(32, 97) if chr(c) != "'")}'"""
#: crc32 of strings as a sum (xor) over their bytes: ``tab`` is a byte's share by the number of
#: bytes after it, ``zero`` the share of the start value by the length
_CRC = """
crc_rows AS (SELECT b, list_reduce(list_concat([b], range(1, 9)), lambda c, i: CASE WHEN c & 1 = 1
               THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM (SELECT unnest(range(256)) AS b)),
crc_list AS (SELECT list(t ORDER BY b) AS t0 FROM crc_rows),
tab(k, b, t) AS (SELECT CAST(0 AS BIGINT), b, t FROM crc_rows
  UNION ALL SELECT k + 1, b, xor(t >> 8, t0[1 + (t & 255)]) FROM tab, crc_list WHERE k < (SELECT max(n) FROM crc_len)),
zero(k, t) AS (SELECT CAST(0 AS BIGINT), 4294967295
  UNION ALL SELECT k + 1, xor(t >> 8, t0[1 + (t & 255)]) FROM zero, crc_list WHERE k < (SELECT max(n) FROM crc_len))"""

SQL = {
    "op11_runs": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
ids AS (SELECT DISTINCT doc_id, hex(encode(CAST(doc_id AS VARCHAR))) AS x FROM documents WHERE doc_id IS NOT NULL),
crc_len AS (SELECT max(length(x) // 2) AS n FROM ids),{_CRC},
bytes AS (SELECT doc_id, x, unnest(range(length(x) // 2)) AS i FROM ids),
shares AS (SELECT doc_id, bit_xor(t) AS s, max(length(x) // 2) AS n FROM bytes
  JOIN tab ON k = length(x) // 2 - 1 - i AND b = CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT) GROUP BY doc_id),
h AS (SELECT doc_id, xor(xor(s, t), 4294967295) AS h FROM shares JOIN zero ON k = n),
g AS (SELECT d.doc_id, ws, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN h // 10 END AS g
      FROM d LEFT JOIN h ON h.doc_id = d.doc_id),
a AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM g),
w AS (SELECT doc_id, i, CASE WHEN g IS NULL OR i < a THEN ws[i + 1] ELSE ws[a + (i - a) % p + 1] END AS w
      FROM (SELECT *, unnest(range(n)) AS i FROM a)),
f AS (SELECT doc_id, i, hash(w, lead(w) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS f,
        lead(w, 4) OVER o IS NOT NULL AS whole FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM f x JOIN f y ON x.doc_id = y.doc_id AND x.f = y.f AND x.i < y.i
      WHERE x.whole AND y.whole),
s AS (SELECT doc_id, q, min(i) AS s, max(i) + 5 + q AS e FROM (
        SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM e) GROUP BY doc_id, q, k),
r AS (SELECT doc_id, s, e - s AS n, min(q) AS q FROM s WHERE e - s >= greatest(6, 4 * q) GROUP BY doc_id, s, e),
l AS (SELECT doc_id, count(*) AS n_runs, min_by(struct_pack(s := s, n := n, q := q), (-n, s, q)) AS best,
        sha256(string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q)) AS runs_sha256 FROM r GROUP BY doc_id),
c AS (SELECT w.doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM w
      WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = w.doc_id AND w.i >= r.s + r.q AND w.i < r.s + r.n) GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.n AS length, best.q AS period,
  1000 * best.n // best.q AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256,
  sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id""",
    "op12_spelling": rf"""
WITH RECURSIVE o AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), {_AZ}) AS w FROM documents),
u AS (SELECT doc_id, w, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x
      FROM (SELECT doc_id, w, count(*) AS n FROM o GROUP BY ALL)),
crc_len AS (SELECT max(length(x) // 2) AS n FROM u),{_CRC},
bytes AS (SELECT x, unnest(range(length(x) // 2)) AS i FROM (SELECT DISTINCT x FROM u)),
shares AS (SELECT x, bit_xor(t) AS s FROM bytes JOIN tab ON k = length(x) // 2 - 1 - i
  AND b = CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT) GROUP BY x),
h AS (SELECT x, xor(xor(s, t), 4294967295) AS h FROM shares JOIN zero ON k = length(x) // 2),
v AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n
      FROM u JOIN h USING (x)),
c AS (SELECT word, CAST(sum(n) AS BIGINT) AS n, length(word) AS m, translate(word, {_ONE_BYTE}) AS y
      FROM v WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
p AS (SELECT x.word AS a, x.n AS na, y.word AS b, y.n AS nb FROM c x JOIN c y
      ON y.m BETWEEN x.m - 1 AND x.m + 1 AND levenshtein(x.y, y.y) = 1),
f AS (SELECT a AS word, count(*) AS n_near, min_by(b, (-nb, b)) FILTER (WHERE nb >= 2 * na) AS form FROM p GROUP BY a),
r(word, root) AS (SELECT word, word FROM c UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root AND f.form IS NOT NULL),
z AS (SELECT word, root FROM r WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.word = r.root AND f.form IS NOT NULL))
SELECT c.word, c.n, coalesce(n_near, 0) AS n_near, f.form, g.n AS form_n, z.root
FROM c LEFT JOIN f ON f.word = c.word LEFT JOIN c g ON g.word = f.form JOIN z ON z.word = c.word""",
    "op13_line_dedup": rf"""
WITH l AS (SELECT doc_id, r, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (
        SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(regexp_replace(line, '^[ 	-
]+|[ 	-
]+$', '', 'g'), {_AZ}) AS k FROM l),
s AS (SELECT k, max(doc_id) AS last FROM k WHERE length(k) >= 20 GROUP BY k
      HAVING count(DISTINCT doc_id) + max(CAST(doc_id IS NULL AS INTEGER)) >= 3),
m AS (SELECT k.*, s.k IS NOT NULL AND k.doc_id IS DISTINCT FROM s.last AS gone FROM k LEFT JOIN s ON s.k = k.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id""",
    "op2_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS r,
             replace(replace(text, '\', '\\'), '<|', '<\|') AS t FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), ''))
    AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(r) + 1 + length(t) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op6_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM f""",
    "op7_nearest": f"""
WITH e AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE {_GOOD}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
      FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op8_ngram_join": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ')
        ELSE array_to_string(list_slice(ws, i, i + 4), ' ') END AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= 80 * (p.n + q.n - o)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = d.doc_id""",
    "op9_embedding_dedup": f"""
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
      WHERE label IS NOT NULL AND {_GOOD}),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.label = y.label AND x.vec_id <> y.vec_id
        AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.98),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a), m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.vec_id, coalesce(k.n, 0) AS n_links, least(d.vec_id, coalesce(m.b, d.vec_id)) AS component_id,
  d.vec_id = least(d.vec_id, coalesce(m.b, d.vec_id)) AS kept
FROM embeddings d LEFT JOIN k ON k.a = d.vec_id LEFT JOIN m ON m.a = d.vec_id""",
}
