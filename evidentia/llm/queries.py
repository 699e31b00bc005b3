"""The registered queries opN_<name> of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, html_extract, importance, langid, line_dedup, mixing, quality, simhash, substring, warc, whitening

QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: all read back from the formatted text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    done = chat.format_chats(chat.text_parts(rows.unionByName(extra)))
    turns = chat.read_turns(F.col("formatted"))
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = done.select("conv_id", "formatted", turns.alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(all_turns, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


SQL["op2_chat_format"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\]', '', 'g'))
    + len(regexp_extract_all(text, '<\||</?s>|\[/?INST\]')) AS shown FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(shown + length(role) + 32) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    done = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL["op6_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (
  SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.holder AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL["op7_mix_sources"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS pos, 2 * source_size AS cap,
  CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s0),
s2 AS (SELECT *, CASE (pos - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s1),
s3 AS (SELECT *, (total * CAST(1.5 AS DOUBLE) - CAST(coalesce(sum(cap) OVER (ORDER BY cap / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
  / CAST(sum(w) OVER (ORDER BY cap / w, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM s2),
s4 AS (SELECT *, max(CASE WHEN cap > level * w THEN level END) OVER () AS share FROM s3),
t AS (SELECT source, pos, source_size, total, CASE WHEN cap > level * w THEN share * w ELSE CAST(cap AS DOUBLE) END AS target FROM s4),
seats AS (SELECT *, CAST(floor(total * CAST(1.5 AS DOUBLE) / 32 + 0.5) AS BIGINT) AS seats, sum(target) OVER () AS tw, count(*) OVER () AS n FROM t),
cand AS (
  SELECT pos, seats, target, k, target / (2 * k + 1) AS quotient FROM (
    SELECT *, unnest(generate_series(CAST(0 AS BIGINT), CAST(floor(target * seats / greatest(tw, 1)) + 2 * n AS BIGINT))) AS k FROM seats WHERE target > 0)),
won AS (SELECT pos, count(*) AS blocks FROM (
  SELECT pos, seats, row_number() OVER (ORDER BY quotient DESC, pos, k) AS r FROM cand) WHERE r <= seats GROUP BY pos),
line AS (
  SELECT d.doc_id, d.size, t.pos, t.source_size, t.target, coalesce(b.blocks, 0) AS blocks,
    d.h % greatest(1, CAST(ceil(t.source_size / 4000000) AS BIGINT)) AS shard, d.h
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN won b ON b.pos = t.pos),
placed AS (SELECT *, CAST(sum(size) OVER (PARTITION BY pos, shard ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hi FROM line),
held AS (SELECT *, sum(nb) OVER (PARTITION BY pos) AS bw, count(*) OVER (PARTITION BY pos) AS bn FROM (
  SELECT pos, blocks, shard, CAST(ceil(sum(size) / 32) AS BIGINT) AS nb FROM line GROUP BY ALL)),
cand2 AS (SELECT pos, shard, blocks, nb, k, nb / (2 * k + 1) AS quotient FROM (
  SELECT *, unnest(generate_series(CAST(0 AS BIGINT), CAST(floor(nb * blocks / greatest(bw, 1)) + 2 * bn AS BIGINT))) AS k FROM held WHERE nb > 0)),
won2 AS (SELECT pos, shard, nb, least(count(*), 2 * nb) AS quota FROM (
  SELECT *, row_number() OVER (PARTITION BY pos ORDER BY quotient DESC, shard, k) AS r FROM cand2) WHERE r <= blocks GROUP BY pos, shard, nb),
runs AS (SELECT pos, shard, nb, quota // nb AS f, quota % nb AS rem,
  CAST('0x' || substr(md5('mix-1:' || pos || ':' || shard), 1, 15) AS BIGINT) % nb AS a FROM won2)
SELECT p.doc_id, p.size, p.source_size, p.target, CAST(coalesce(f * p.size
  + greatest(least(hi, least(a + rem, nb) * 32) - greatest(hi - p.size, a * 32), 0)
  + greatest(least(hi, greatest(a + rem - nb, 0) * 32) - (hi - p.size), 0), 0) AS BIGINT) AS taken
FROM placed p LEFT JOIN runs r ON p.pos = r.pos AND p.shard = r.shard
"""


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), digest_all=True).withColumnRenamed("digest", "text_sha256")


SQL["op8_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    docs = table(spark, sf_dir, "documents")
    return substring.strip(docs, substring.removals(docs), kept_text=False)


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score; rejected follows."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(docs, model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query
def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metadata and conversion record of the pages' responses."""
    found = warc.derive(warc.responses(table(spark, sf_dir, "pages")))
    return found.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "content_type", "block", "block_digest", "payload_digest", "content_length", F.to_json("headers").alias("headers"))


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer, start: the documents that hold benchmark passages, and which."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


SQL["op11_importance_resample"] = r"""
WITH texts AS (
  SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
words AS (
  SELECT side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
features AS (
  SELECT side, doc_id, unnest(w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS feature FROM words),
counted AS (SELECT side, doc_id, feature, count(*) AS n FROM features GROUP BY ALL),
dictionary AS (
  SELECT feature, xor(list_reduce(list_prepend(4294967295, [CAST(('0x' || substr(hex(encode(feature)), 2 * i - 1, 2)) AS BIGINT) FOR i IN range(1, strlen(feature) + 1)]),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT feature FROM counted)),
sums AS (SELECT b.bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t
  FROM (SELECT unnest(range(10000)) AS bucket) b LEFT JOIN (dictionary JOIN counted USING (feature)) d ON b.bucket = d.bucket GROUP BY b.bucket),
totals AS (SELECT CAST(sum(s) AS DOUBLE) AS s_all, CAST(sum(t) AS DOUBLE) AS t_all FROM sums),
gains AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * (s_all + 10000)) / (CAST(s + 1 AS DOUBLE) * (t_all + 10000)))) AS BIGINT) AS gain FROM sums, totals),
means AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total
  FROM counted JOIN dictionary USING (feature) JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id),
scored AS (
  SELECT w.doc_id, len(w.w) AS n_words, coalesce(n_features, 0) AS n_features,
    CASE WHEN n_features IS NULL THEN 0 WHEN total % n_features < 0 THEN total // n_features - 1 ELSE total // n_features END AS weight,
    (CAST('0x' || substr(sha256('7:' || w.doc_id), 1, 8) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE) AS u
  FROM words w LEFT JOIN means m ON w.doc_id = m.doc_id WHERE w.side = 0),
summed AS (SELECT doc_id, n_words, n_features, weight, weight + CAST(floor(-1000 * ln(-ln(u))) AS BIGINT) AS score FROM scored),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM summed WHERE n_words >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN r <= 25 * n // 100 THEN r END AS rank FROM summed s LEFT JOIN ranked k ON s.doc_id = k.doc_id
"""


@query
def op12_embedding_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents")
    machine = quality.fit(docs, table(spark, sf_dir, "labels").filter(~quality.held_out(F.col("doc_id"))))
    return quality.score(docs, machine).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
