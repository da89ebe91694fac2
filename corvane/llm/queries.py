"""The operators applied to whole tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, exact_dedup, mixing, pii, quality, repair, secret_scan, simhash, substring_dedup, toxicity, variants, warc
from .common import new_folder

#: A document is toxic from this score on.
TOXIC = 0.3
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(by: int, id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % by


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(table(spark, sf_dir, "documents"), keep="largest")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents come in two increments, as versions do: the second scans only blobs that the first did not bring. The result is read from the ledger."""
    docs = table(spark, sf_dir, "documents")
    ledger = new_folder(spark, "ledger")
    for increment in (0, 1):
        secret_scan.update_ledger(docs.filter(F.pmod(F.coalesce(F.xxhash64("doc_id"), F.lit(0)), F.lit(2)) == increment), ledger)
    found = secret_scan.findings(docs, secret_scan.read_ledger(spark, ledger))
    n = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    scored = quality.score(docs, model)
    return scored.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.train(docs, table(spark, sf_dir, "labels"), remainder(4) != 2)
    scored = toxicity.score(docs, lexicon, keep=["doc_id"]).select(F.col("_row.doc_id").alias("doc_id"), F.col("_score").alias("score"))
    return scored.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    warc.write_archives(spark, table(spark, sf_dir, "pages"), folder)
    return warc.page_records(spark, folder)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, planned = mixing.plan(table(spark, sf_dir, "documents"))
    return mixing.taken(planned, mixing.draw(sources, planned)).select(F.col("_id").alias("doc_id"), "size", "source_size", "target", "taken")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(bpe.encode(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, keep=["doc_id"], decoded=True))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.of_documents(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.of_documents(table(spark, sf_dir, "documents"))
    name = F.array(*[F.lit(k) for k in pii.KINDS])
    said = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"], x["end"])), ",")
    n = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("bigint").alias(f"n_{pii.KINDS[i]}")
    return found.select("doc_id", *[n(i) for i in range(len(pii.KINDS))], F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.of_damaged(table(spark, sf_dir, "conversations"))


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select(F.col("_row.doc_id").alias("doc_id"), (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_secret_scan, op3_quality, op4_toxicity, op5_simhash, op6_warc, op7_substring_dedup, op8_mixing, op9_ann, op10_bpe, op11_spelling, op12_pii, op13_conversation_repair)}


def _rules_sql() -> str:
    parts = []
    for order, (kind, pattern, group, least) in enumerate(secret_scan.RULES):
        p = pattern.replace("'", "''")
        parts.append(f"SELECT doc_id, {order} AS ord, '{kind}' AS kind, {least} AS least, unnest(regexp_extract_all(text, '{p}', 0)) AS whole, unnest(regexp_extract_all(text, '{p}', {group})) AS part, unnest(string_split_regex(text, '{p}')) AS gap, unnest(range(len(string_split_regex(text, '{p}')))) AS i FROM t")
    return " UNION ALL ".join(parts)


def _crc32_sql(codes: str) -> str:
    """CRC-32 of a list of bytes, a bit at a time."""
    step = "list_reduce(list_prepend(xor(c, b), [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {step}), 4294967295)"


ORACLE = {
    "op1_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)""",
    "op2_secret_scan": f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({_rules_sql()}),
p AS (SELECT *, sum(length(gap) + coalesce(length(whole), 0)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM m),
h AS (SELECT doc_id, ord, kind, (stop - length(whole))::BIGINT AS start, stop::BIGINT AS stop FROM p WHERE whole IS NOT NULL AND length(part) >= least),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans FROM h GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (doc_id)""",
    "op6_warc": """
WITH d AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hx FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS best FROM d)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hx, ((5 * i) // 4 + 1)::INT, 2))::INT >> (3 - i % 4)::INT) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> best THEN best END AS refers_to
FROM w""",
    "op8_mixing": """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
l AS (SELECT *, ((sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE) AS level FROM r WINDOW o AS (ORDER BY source_size::DOUBLE / weight::DOUBLE, source NULLS LAST)),
b AS (SELECT max(level) AS level FROM l WHERE level * weight <= source_size * 3),
a AS (SELECT source, source_size, least(b.level * weight, (source_size * 3)::DOUBLE) AS target FROM r, b),
q AS (SELECT d.*, a.source_size, a.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('11:' || d.doc_id), d.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM q)
SELECT doc_id, size, source_size, target, (size * whole + greatest(0, least(size, round(target)::BIGINT - whole * source_size - start)))::BIGINT AS taken FROM e""",
    "op9_ann": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda x: x[1] * x[2]), lambda a, b: a + b) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY rank <= 20""",
    "op11_spelling": f"""
WITH RECURSIVE d AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
e AS (SELECT id, run, count(*) AS n FROM d GROUP BY ALL),
h AS (SELECT run, n, {_crc32_sql("list_transform(flatten(list_transform(string_split(id || ':' || run, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)] ELSE [192 + unicode(ch) // 64, 128 + unicode(ch) % 64] END)), lambda b: b::BIGINT)")} AS h FROM e),
w AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run) + 2)::INT) ELSE run END AS word, sum(n)::BIGINT AS n FROM h GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
cut AS (SELECT DISTINCT word, n, left(word, (i - 1)::INT) || substr(word, (i + 1)::INT) AS short FROM p),
masked AS (SELECT word, n, i, left(word, (i - 1)::INT) || substr(word, (i + 1)::INT) AS rest FROM p),
near AS (SELECT c.word AS a, c.n AS an, w.word AS b, w.n AS bn FROM cut c JOIN w ON w.word = c.short UNION ALL SELECT w.word, w.n, c.word, c.n FROM cut c JOIN w ON w.word = c.short
  UNION ALL SELECT x.word, x.n, y.word, y.n FROM masked x JOIN masked y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word),
best AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY bn DESC, b) AS b, max(bn) AS bn FROM near GROUP BY a),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 2 * w.n THEN b END AS form, CASE WHEN bn >= 2 * w.n THEN bn END AS form_n FROM w LEFT JOIN best USING (word)),
r AS (SELECT word, word AS root FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL),
l AS (SELECT r.word, r.root FROM r JOIN f ON f.word = r.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN l USING (word)""",
    "op13_conversation_repair": f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc32_sql("list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: unicode(ch)::BIGINT)")} % 20 AS k FROM conversations),
c AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || ':' || text), copy) AS i, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM c),
f AS (SELECT *, body = '' AS blank, body <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
s AS (SELECT *, NOT blank AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS cut FROM f),
n AS (SELECT conv_id, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
      coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, max(i) AS last FROM s GROUP BY conv_id),
ins AS (SELECT * FROM (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 2, 3, 'I'), (1, 3, 6, 'II'), (2, 3, 3, 'I'), (3, 2, 3, 'I')) AS t(p, q, c, e)),
op AS (SELECT * FROM (VALUES (0, 0, 4, 'D', ''), (1, 1, 4, 'D', ''), (2, 2, 4, 'D', ''), (3, 3, 4, 'D', ''), (0, 2, 3, 'R', ''), (1, 2, 3, 'R', ''), (3, 2, 3, 'R', ''), (2, 3, 3, 'R', ''), (0, 1, 0, 'K', 's'), (0, 2, 0, 'K', 'u'), (1, 2, 0, 'K', 'u'), (3, 2, 0, 'K', 'u'), (2, 3, 0, 'K', 'a')) AS t(p, q, c, e, need)),
r AS (SELECT conv_id, 0::BIGINT AS i, 0 AS state, {{'c': 0, 'a': ''}} AS best FROM n
  UNION ALL SELECT r.conv_id, s.i, op.q, min({{'c': r.best.c + ins.c + op.c + CASE WHEN s.cut AND op.e <> 'D' THEN 3 ELSE 0 END, 'a': r.best.a || ins.e || op.e}})
  FROM r JOIN s ON s.conv_id IS NOT DISTINCT FROM r.conv_id AND s.i = r.i + 1 JOIN ins ON ins.p = r.state JOIN op ON op.p = ins.q AND (op.e = 'D' OR (NOT s.blank AND NOT s.again AND (op.e = 'R' OR op.need = s.initial))) GROUP BY r.conv_id, s.i, op.q),
e AS (SELECT n.conv_id, min({{'c': r.best.c + CASE r.state WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END, 'a': r.best.a || CASE r.state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END}}) AS best FROM n JOIN r ON n.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = n.last GROUP BY n.conv_id),
l AS (SELECT conv_id, unnest(string_split(best.a, '')) AS e, unnest(range(1, length(best.a) + 1)) AS j FROM e),
m AS (SELECT *, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS i, count(*) FILTER (e <> 'D') OVER (PARTITION BY conv_id ORDER BY j) AS k FROM l),
x AS (SELECT m.conv_id, m.j, m.e, m.k, s.role, CASE WHEN m.e = 'I' THEN '' ELSE s.text END AS text, max(CASE WHEN m.k = 1 AND m.e = 'K' AND s.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY m.conv_id) AS head FROM m LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM m.conv_id AND s.i = m.i),
d AS (SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (k - head) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j)) AS h FROM x WHERE e <> 'D' GROUP BY conv_id)
SELECT a.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal, coalesce(e.best.c, 0)::BIGINT AS cost, coalesce(e.best.a, '') AS audit, coalesce(d.h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN d ON d.conv_id IS NOT DISTINCT FROM a.conv_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
