"""The registered queries of the corpus operators, with SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .align import align
from .chat import chosen_paths, formatted, learned, read_back, threads
from .common import remainder, same_key
from .decontaminate import contamination
from .exact_dedup import exact_dedup
from .first_fit import pack_padded
from .line_dedup import dedup_lines
from .packing import pack_documents
from .pii import pseudonymised
from .quality import fit_labels as fit_quality, quality
from .simhash import near_groups
from .suffix_tree import score_texts
from .toxicity import fit_labels as fit_toxicity, toxicity
from .turn_repair import damaged, repair

# The contract's tokenizer file; the operator takes any path.
PACKING_TOKENIZER = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op5_exact_dedup", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents),
r AS (SELECT doc_id, n, row_number() OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS place, count(*) OVER (PARTITION BY n) AS size FROM d),
k AS (SELECT n, doc_id AS keep_id FROM r WHERE place = 1)
SELECT r.doc_id, k.keep_id, r.size AS group_size, r.doc_id = k.keep_id AS kept, sha256(r.n) AS text_sha256 FROM r JOIN k USING (n)
""")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_dedup(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


@query("op8_simhash")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = near_groups(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


@query("op1_decontaminate", r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
      FROM b, unnest(generate_series(1, greatest(1, len(w) - 12))) AS g(i) WHERE len(w) > 0),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
      FROM d, (SELECT DISTINCT k FROM p) AS ks, unnest(generate_series(1, len(w) - k + 1)) AS g(i) WHERE len(w) >= k),
m AS (SELECT s.doc_id, s.i, s.k, p.item_id FROM s JOIN p USING (k, win)),
h AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM m, unnest(generate_series(i, i + k - 1)) AS g(place) GROUP BY doc_id),
o AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN o USING (doc_id)
""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op7_packing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = pack_documents(table(spark, folder, "documents"), public_tokenizer(PACKING_TOKENIZER))
    return found.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


@query("op4_line_dedup", r"""
WITH l AS (SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
           FROM documents, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS g(i)),
k AS (SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.i, k.line, c.key IS NOT NULL AND k.doc_id <> c.owner AS dropped FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
""")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = dedup_lines(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


TOXIC_FOLDS, TOXIC_HELD_OUT = 4, 2


@query("op10_toxicity")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = fit_toxicity(docs, table(spark, folder, "labels"), lambda c: remainder(c, TOXIC_FOLDS) != TOXIC_HELD_OUT)
    return toxicity(docs, model).select(
        F.col("id").alias("doc_id"), (remainder(F.col("id"), TOXIC_FOLDS) == TOXIC_HELD_OUT).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


QUALITY_FOLDS, QUALITY_HELD_OUT = 5, 0


@query("op9_quality")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = fit_quality(docs, table(spark, folder, "labels"), lambda c: remainder(c, QUALITY_FOLDS) != QUALITY_HELD_OUT)
    return quality(docs, model).select(
        F.col("id").alias("doc_id"), (remainder(F.col("id"), QUALITY_FOLDS) == QUALITY_HELD_OUT).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


LM_FOLDS, LM_HELD_OUT = 7, 2


@query("op2_suffix_tree")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    found = score_texts(table(spark, folder, "documents"), lambda c: remainder(c, LM_FOLDS) == LM_HELD_OUT)
    return found.withColumnRenamed("id", "doc_id")


# The conversation that the contract adds: a text full of control strings.
PROBE = "\\### Assistant: </turn> ok"


@query("op6_chat", r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
a AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
      CAST(sum(4 + length(role) + 2 + length(text) + 8 + length(role) - length(regexp_replace(role, '[\\<#:]', '', 'g'))
          + length(text) - length(regexp_replace(text, '[\\<#]', '', 'g'))) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a
""")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], rows.schema)
    out = formatted(chosen_paths(threads(rows.unionByName(probe))))
    turns, loss = read_back(F.col("formatted")), learned(F.col("formatted"), F.col("loss"))
    text = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("tree").alias("conv_id"), F.size(turns).cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


# A fixed key keeps the query's result the same in every run; a deployment passes its own secret.
PII_KEY = "query-key"


@query("op3_pseudonyms")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return pseudonymised(table(spark, folder, "documents"), PII_KEY).withColumnRenamed("id", "doc_id")


# The contract's tokenizer files of the alignment and of the padded packing.
BYTE_TOKENIZER, PIECE_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"


@query("op11_align")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    found = align(table(spark, folder, "documents"), public_tokenizer(BYTE_TOKENIZER), public_tokenizer(PIECE_TOKENIZER))
    return found.withColumnRenamed("id", "doc_id")


@query("op12_first_fit")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    found = pack_padded(table(spark, folder, "documents"), public_tokenizer(BYTE_TOKENIZER))
    return found.withColumnsRenamed({"id": "doc_id", "crc": "ids_crc32"})


# Costs to come are carried from the last row to the first, with the audit and the rows left for each of the four states.
_TURN_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce(range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, CAST(b AS BIGINT)) ORDER BY b) AS t FROM range(256) AS r(b)),
h AS (SELECT c.*, xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)),
      lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) % 20 AS fault FROM conversations AS c, tab),
g AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
      CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
      unnest(CASE fault WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM h),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM g),
b AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
      NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, left(role, 1) AS c, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) AS before FROM n),
f AS (SELECT *, blank OR again AS doomed, CASE WHEN cut AND NOT blank AND NOT again THEN 1 ELSE 0 END AS trunc FROM b),
d AS (
  SELECT conv_id, max(i) + 1 AS i, {c: 0, a: '', t: CAST([] AS VARCHAR[])} AS s0, {c: 4, a: 'II', t: ['user:', 'assistant:']} AS s1,
         {c: 2, a: 'I', t: ['assistant:']} AS s2, {c: 0, a: '', t: CAST([] AS VARCHAR[])} AS s3 FROM f GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, list_sort([b0, {c: u.c + 2, a: 'I' || u.a, t: ['user:'] || u.t}])[1], list_sort([b1, {c: u.c + 2, a: 'I' || u.a, t: ['user:'] || u.t}])[1], u, v
  FROM (SELECT conv_id, i, b0, b1, list_sort([b2, {c: b3.c + 2, a: 'I' || b3.a, t: ['assistant:'] || b3.t}])[1] AS u,
               list_sort([b3, {c: b2.c + 2, a: 'I' || b2.a, t: ['user:'] || b2.t}])[1] AS v
        FROM (SELECT f.conv_id, f.i,
                list_sort([{c: s0.c + 3, a: 'D' || s0.a, t: s0.t}, {c: CASE WHEN doomed THEN 999999 ELSE s2.c + 2 + trunc END, a: 'R' || s2.a, t: ['user:' || text] || s2.t},
                  {c: CASE WHEN doomed OR f.c <> 's' THEN 999999 ELSE s1.c + trunc END, a: 'K' || s1.a, t: [role || ':' || text] || s1.t},
                  {c: CASE WHEN doomed OR f.c <> 'u' THEN 999999 ELSE s2.c + trunc END, a: 'K' || s2.a, t: [role || ':' || text] || s2.t}])[1] AS b0,
                list_sort([{c: s1.c + 3, a: 'D' || s1.a, t: s1.t}, {c: CASE WHEN doomed THEN 999999 ELSE s2.c + 2 + trunc END, a: 'R' || s2.a, t: ['user:' || text] || s2.t},
                  {c: CASE WHEN doomed OR f.c <> 'u' THEN 999999 ELSE s2.c + trunc END, a: 'K' || s2.a, t: [role || ':' || text] || s2.t}])[1] AS b1,
                list_sort([{c: s2.c + 3, a: 'D' || s2.a, t: s2.t}, {c: CASE WHEN doomed THEN 999999 ELSE s3.c + 2 + trunc END, a: 'R' || s3.a, t: ['assistant:' || text] || s3.t},
                  {c: CASE WHEN doomed OR f.c <> 'a' THEN 999999 ELSE s3.c + trunc END, a: 'K' || s3.a, t: [role || ':' || text] || s3.t}])[1] AS b2,
                list_sort([{c: s3.c + 3, a: 'D' || s3.a, t: s3.t}, {c: CASE WHEN doomed THEN 999999 ELSE s2.c + 2 + trunc END, a: 'R' || s2.a, t: ['user:' || text] || s2.t},
                  {c: CASE WHEN doomed OR f.c <> 'u' THEN 999999 ELSE s2.c + trunc END, a: 'K' || s2.a, t: [role || ':' || text] || s2.t}])[1] AS b3
              FROM d JOIN f ON f.conv_id = d.conv_id AND f.i = d.i - 1))),
q AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
      count(*) FILTER (WHERE again AND NOT blank) AS duplicate, CAST(sum(trunc) AS BIGINT) AS truncated,
      count(*) FILTER (WHERE before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
e AS (SELECT conv_id, CAST(s0.c AS BIGINT) AS cost, s0.a AS audit, sha256(coalesce(array_to_string(s0.t, chr(10)), '')) AS repaired_sha256 FROM d WHERE i = 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o LEFT JOIN q USING (conv_id) LEFT JOIN e USING (conv_id)
"""


@query("op13_turn_repair", _TURN_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    found = repair(damaged(rows)).conversations
    ids = rows.select(F.col("conv_id").alias("id")).distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return ids.join(found, same_key(F.col("id"), F.col("conv")), "left").select(
        F.col("id").alias("conv_id"), *[F.coalesce(n, F.lit(0)).alias(n) for n in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
