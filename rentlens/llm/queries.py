"""The registered queries of the operators, thin digests of their outputs, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rentlens.llm import (
    ball_simhash, chat_targets, context_tree, exact_dedup, harmonic_pack, merkle_fixity, personal_data, piece_transducer, projection_passes,
    ptolemaic_clusters, pu_quality, url_vocabulary, whitening)
from rentlens.llm.shared import fold, table
from rentlens.session import cut_lineage

WORD_TOKENIZER, PIECE_MODEL = "word_bpe_49k.json", "piece_bpe_32k.model"
#: Pages of an archive file, and the modulus of the crc32 of a page's id that decides what the replica lost.
ARCHIVE_PAGES, FAULTS = 1000, 97


def op1_merkle_fixity(spark: SparkSession, d: str) -> DataFrame:
    """Archive files of WARC records made from the pages, against a replica in which some records changed (a byte
    more), some are missing, and some stand twice, the second time one byte further on."""
    page = F.coalesce(F.col("page_id"), F.lit(-1))
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    record = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "),
                      F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"))
    fault = F.crc32(page.cast("string").cast("binary")) % FAULTS
    archive = F.concat(F.lit("crawl-"), F.floor(page / ARCHIVE_PAGES).cast("string"))
    pages = table(spark, d, "pages").select(archive.alias("archive"), page.alias("page"), record.alias("record"), fault.alias("fault")).withColumns(
        {"size": F.octet_length("record"), "key": F.sha2(F.col("record").cast("binary"), 256), "line": F.monotonically_increasing_id()})
    copy = lambda place, shift, payload: F.struct(F.lit(place).alias("place"), F.lit(shift).alias("shift"), payload.alias("payload"))
    copies = F.array(copy(0, 0, F.col("record")),
                     F.when(F.col("fault") != 1, copy(1, 0, F.when(F.col("fault") == 0, F.concat("record", F.lit("!"))).otherwise(F.col("record")))),
                     F.when(F.col("fault") == 2, copy(2, 1, F.col("record"))))
    # both sides are bytes here; each record of either is hashed on its own
    sides = pages.select("archive", "page", "size", "key", "line", F.inline(F.filter(copies, lambda c: c.isNotNull())))
    hashed = merkle_fixity.hash_records(sides, F.col("payload"), "archive", "shift", ("page", "size", "key", "line", "place"))
    upto = Window.partitionBy("archive").orderBy("page", "key", "line", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum(F.when(F.col("place") == 0, F.col("size")).otherwise(0)).over(upto) - F.col("size")
    placed = cut_lineage(hashed.select("archive", (start + F.col("offset")).alias("offset"), "sha", "place"))
    side = lambda cond: placed.where(cond).select("archive", "offset", "sha")
    return merkle_fixity.audit(side("place = 0"), side("place > 0"))


OP1 = f"""
WITH p AS (SELECT coalesce(page_id, -1) AS page, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
r AS (SELECT page, concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13), chr(10), 'Content-Length: ',
  strlen(html), chr(13), chr(10), chr(13), chr(10), html, chr(13), chr(10), chr(13), chr(10)) AS record FROM p),
f AS (SELECT *, 'crawl-' || (page // {ARCHIVE_PAGES}) AS archive, sha256(record) AS sha, sha256(record || '!') AS other, strlen(record) AS size,
  (WITH RECURSIVE c(i, v) AS (SELECT 0, 4294967295::BIGINT UNION ALL SELECT i + 1,
     CASE WHEN i % 9 = 0 THEN xor(v, CAST(ascii(substr(page::VARCHAR, i // 9 + 1, 1)) AS BIGINT))
          WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM c WHERE i < 9 * length(page::VARCHAR))
   SELECT xor(v, 4294967295) % {FAULTS} FROM c ORDER BY i DESC LIMIT 1) AS fault FROM r),
o AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY archive ORDER BY page, sha ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM f),
bad AS (SELECT archive, "offset", 'changed' AS fault, sha AS ours, other AS theirs FROM o WHERE fault = 0
  UNION ALL SELECT archive, "offset", 'missing', sha, NULL FROM o WHERE fault = 1
  UNION ALL SELECT archive, "offset" + 1, 'extra', NULL, sha FROM o WHERE fault = 2)
SELECT * FROM bad UNION ALL SELECT DISTINCT archive, CAST(NULL AS BIGINT), 'intact', NULL, NULL FROM o WHERE archive NOT IN (SELECT archive FROM bad)"""


def op2_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = exact_dedup.progressive_dedup(table(spark, d, "documents"), digest_all=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("full_hash").alias("text_sha256"))


OP2 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
g AS (SELECT h, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)"""


def op3_pu_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = pu_quality.fit(docs, table(spark, d, "labels"))
    out = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), pu_quality.score(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op4_url_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return url_vocabulary.judge_urls(table(spark, d, "pages")).select("page_id", "host", "path", "rule", "verdict", "term_weight")


def _term_sql(term: str, weight: int) -> str:
    return f"CASE WHEN regexp_matches(u, '(^|[^a-z0-9]){term}([^a-z0-9]|$)') THEN {weight} ELSE 0 END"


OP4 = f"""
WITH p AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
  translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u FROM pages),
r AS (SELECT *, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
  {' + '.join([_term_sql(t, url_vocabulary.STRICT_WEIGHT) for t in url_vocabulary.STRICT] + [_term_sql(t, url_vocabulary.SOFT_WEIGHT) for t in url_vocabulary.SOFT])} AS term_weight FROM p)
SELECT page_id, host, path, rule, CASE rule WHEN 'net/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block'
  WHEN 'org/fr/' THEN 'allow' ELSE CASE WHEN term_weight >= 2 THEN 'block' ELSE 'allow' END END AS verdict, CAST(term_weight AS INTEGER) AS term_weight FROM r"""


def op5_chat_targets(spark: SparkSession, d: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return chat_targets.digest(chat_targets.expand(turns.unionByName(extra)))


OP5 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
-- marks take 10 characters a turn, and each escaped character is written as four
e AS (SELECT *, 10 + length(role) + length(text) + 3 * (length(role || text) - length(translate(role || text, '\<[|', ''))) AS n FROM t),
p AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples,
  CAST(coalesce(sum(upto) FILTER (role = 'assistant'), 0) AS BIGINT) AS examples_chars
FROM p GROUP BY conv_id"""


def op6_context_tree(spark: SparkSession, d: str) -> DataFrame:
    held_out = fold("doc_id", 7) == 2
    out = context_tree.score_documents(table(spark, d, "documents"), ~held_out)
    return out.withColumn("held_out", ~F.col("train")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")


def op7_piece_transducer(spark: SparkSession, d: str) -> DataFrame:
    return piece_transducer.encode_documents(table(spark, d, "documents"), public_tokenizers.path(PIECE_MODEL), with_ids=False)


def op8_harmonic_packing(spark: SparkSession, d: str) -> DataFrame:
    return harmonic_pack.pack_documents(table(spark, d, "documents"), public_tokenizers.path(WORD_TOKENIZER))


def op9_ball_simhash(spark: SparkSession, d: str) -> DataFrame:
    out = ball_simhash.near_components(table(spark, d, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_projection_passes(spark: SparkSession, d: str) -> DataFrame:
    out = projection_passes.near_links(table(spark, d, "embeddings"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


OP10 = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= {projection_passes.THRESHOLD} ELSE false END),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
roots AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, r.component_id, r.component_id = e.vec_id AS kept
FROM embeddings e JOIN roots r ON r.a = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id"""


def op11_personal_data(spark: SparkSession, d: str) -> DataFrame:
    found = personal_data.detect(table(spark, d, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    digest = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in personal_data.BASE], F.sha2(digest(base).cast("binary"), 256).alias("base_sha256"),
                        digest(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"))


def _luhn_sql(s: str) -> str:
    return (f"list_sum(list_transform(range(1, length({s}) + 1), lambda i: CASE WHEN (length({s}) - i) % 2 = 0 THEN substr({s}, i, 1)::INT "
            f"WHEN substr({s}, i, 1)::INT > 4 THEN 2 * substr({s}, i, 1)::INT - 9 ELSE 2 * substr({s}, i, 1)::INT END)) % 10 = 0")


def _proposals_sql(kind: str, pattern: str) -> str:
    """Spans of the leftmost matches that do not overlap: what stands between them and they themselves, in turn."""
    return f"""SELECT doc_id, t, '{kind}' AS kind, list_sum(list_transform(gaps[:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[:i - 1], lambda h: length(h))), 0) AS a, hits[i] AS s
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, t, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS hits FROM d))"""


def _words_sql(words: dict[str, tuple[str, ...]]) -> str:
    return " ".join(f"WHEN '{kind}' THEN regexp_matches(view, '[^a-z]({'|'.join(w)})[^a-z]')" for kind, w in words.items() if w)


_DIGITS = "regexp_replace(s, '[^0-9]', '', 'g')"
OP11 = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS ({' UNION ALL '.join(_proposals_sql(k, v) for k, v in personal_data.BASE.items())}),
base AS MATERIALIZED (SELECT doc_id, t, kind, CAST(a AS BIGINT) AS a, CAST(a + length(s) AS BIGINT) AS b, 100 AS score, true AS base FROM p WHERE CASE kind
  WHEN 'email' THEN true
  WHEN 'ip' THEN len(list_filter(string_split(s, '.'), lambda o: length(ltrim(o, '0')) > 3 OR CASE WHEN length(ltrim(o, '0')) = 3 THEN ltrim(o, '0')::INT > 255 ELSE false END)) = 0
  WHEN 'card' THEN CASE WHEN length({_DIGITS}) BETWEEN 12 AND 19 THEN {_luhn_sql(_DIGITS)} ELSE false END
  ELSE length({_DIGITS}) BETWEEN 9 AND 15 END),
q AS MATERIALIZED (SELECT *, a + length(s) AS b FROM ({' UNION ALL '.join(_proposals_sql(k, v) for k, v in personal_data.ADDED.items())})),
ibans AS (SELECT doc_id, t, kind, a, unnest(range(15, length(s) + 1)) AS n, s FROM q WHERE kind = 'iban' AND NOT regexp_matches(substr(t, CAST(a AS BIGINT), CASE WHEN a = 0 THEN 0 ELSE 1 END), '[A-Za-z0-9]')),
iban AS (SELECT doc_id, any_value(t) AS t, kind, a, a + max(n) AS b FROM (SELECT *, replace(substr(s, 1, n), ' ', '') AS c FROM ibans
    WHERE substr(s, n, 1) <> ' ' AND NOT regexp_matches(substr(t, CAST(a + n + 1 AS BIGINT), 1), '[A-Za-z0-9]'))
  WHERE length(c) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split(substr(c, 5) || substr(c, 1, 4), ''), lambda o: CASE WHEN o BETWEEN '0' AND '9' THEN o::INT ELSE ascii(o) - 55 END)),
    lambda r, v: (r * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1 GROUP BY doc_id, kind, a),
more AS (SELECT doc_id, t, kind, a, b, CASE kind WHEN 'card' THEN 80 WHEN 'ssn' THEN 40 ELSE CASE WHEN s[1] = '+' THEN 65 ELSE 40 END END AS score FROM q
  WHERE kind <> 'iban' AND NOT regexp_matches(substr(t, CAST(a AS BIGINT), CASE WHEN a = 0 THEN 0 ELSE 1 END), '[0-9]') AND NOT regexp_matches(substr(t, CAST(b + 1 AS BIGINT), 1), '[0-9]')
    AND CASE kind WHEN 'card' THEN CASE WHEN length({_DIGITS}) BETWEEN 12 AND 19 THEN {_luhn_sql(_DIGITS)} ELSE false END
      WHEN 'ssn' THEN NOT regexp_matches(s, '^(000|666|9)|-00-|0000$') ELSE true END
  UNION ALL SELECT doc_id, t, kind, a, b, 85 FROM iban),
seen AS (SELECT * EXCLUDE (t), translate(' ' || CASE WHEN a > {personal_data.BEFORE} THEN regexp_replace(l, '^[a-zA-Z]*', '') ELSE l END || ' | '
    || CASE WHEN b + {personal_data.AFTER} < length(t) THEN regexp_replace(r, '[a-zA-Z]*$', '') ELSE r END || ' ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS view
  FROM (SELECT *, substr(t, CAST(greatest(a - {personal_data.BEFORE}, 0) + 1 AS BIGINT), CAST(least(a, {personal_data.BEFORE}) AS BIGINT)) AS l, substr(t, CAST(b + 1 AS BIGINT), {personal_data.AFTER}) AS r FROM more) WHERE true),
added AS (SELECT doc_id, kind, a, b FROM seen WHERE score + CASE WHEN CASE kind {_words_sql(personal_data.HELPFUL)} ELSE false END THEN {personal_data.HELP} ELSE 0 END
    + CASE WHEN CASE kind {_words_sql(personal_data.CONTRARY)} ELSE false END THEN {personal_data.HARM} ELSE 0 END >= {personal_data.THRESHOLD}
  AND NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = seen.doc_id AND base.a <= seen.a AND base.b >= seen.b)),
spans AS (SELECT doc_id, kind, a, b, true AS base FROM base UNION ALL SELECT doc_id, kind, a, b, false FROM added),
o AS (SELECT *, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT) AS x, list_position(['email', 'ip', 'card', 'phone', 'iban', 'ssn'], kind) AS k FROM spans)
SELECT d.doc_id, {', '.join(f"count(*) FILTER (kind = '{k}' AND base) AS n_{k}" for k in personal_data.BASE)}, sha256(coalesce(string_agg(x, ',' ORDER BY a, k, b) FILTER (base), '')) AS base_sha256,
  coalesce(string_agg(x, ',' ORDER BY a, k, b), '') AS spans, count(*) FILTER (NOT base) AS n_added FROM d LEFT JOIN o USING (doc_id) GROUP BY d.doc_id"""


def op12_whitening(spark: SparkSession, d: str) -> DataFrame:
    return whitening.whiten(table(spark, d, "embeddings"))


def op13_ptolemaic_clusters(spark: SparkSession, d: str) -> DataFrame:
    return ptolemaic_clusters.cluster(table(spark, d, "embeddings"))


def _round_sql(k: int) -> str:
    """Round ``k``: nearest centroids of c(k), then c(k + 1) by exact floors; empty centroids stay."""
    return f"""a{k} AS MATERIALIZED (SELECT vec_id, x, c, CAST(g AS BIGINT) AS g FROM (SELECT v.vec_id, v.x, c.c, list_sum(list_transform(list_zip(v.x, c.y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS g
  FROM v CROSS JOIN c{k} c) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY g, c) = 1),
s{k} AS (SELECT c, i, sum(e) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS e, unnest(range(1, 65)) AS i FROM a{k}) GROUP BY c, i),
n{k} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS y FROM s{k} GROUP BY c),
c{k + 1} AS MATERIALIZED (SELECT c.c, coalesce(n.y, c.y) AS y FROM c{k} c LEFT JOIN n{k} n USING (c))"""


OP13 = f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, x AS y FROM v ORDER BY sha256('3:' || vec_id) LIMIT 8),
{', '.join(_round_sql(k) for k in range(ptolemaic_clusters.ROUNDS + 1))}
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, g AS distance, CAST(sum(g) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(g) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.y, ',')) AS centroid_sha256 FROM a{ptolemaic_clusters.ROUNDS} a JOIN c{ptolemaic_clusters.ROUNDS} c USING (c)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_merkle_fixity, op2_exact_dedup, op3_pu_quality, op4_url_vocabulary, op5_chat_targets, op6_context_tree, op7_piece_transducer,
        op8_harmonic_packing, op9_ball_simhash, op10_projection_passes, op11_personal_data, op12_whitening, op13_ptolemaic_clusters)
}
SQL: dict[str, str] = {"op1_merkle_fixity": OP1, "op2_exact_dedup": OP2, "op4_url_vocabulary": OP4, "op5_chat_targets": OP5, "op10_projection_passes": OP10,
                       "op11_personal_data": OP11, "op13_ptolemaic_clusters": OP13}
