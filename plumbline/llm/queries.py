"""One query per operator, over the whole of its table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.llm import bpe, chat, counts, fill_middle, language, lm, mixing, phrases, records, secret_scan, simhash, topk, vector_dedup
from plumbline.llm.frames import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
#: the id that ends a document in record files
END_ID = 2
#: longest document that fits a context
TOKEN_LIMIT = 1024


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_digest(ids: str):
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256)


def encoding_digests(docs: DataFrame) -> DataFrame:
    """Digests of the ids of every text and of the text decoded from them."""
    encoded = bpe.encode_decode(docs.select("doc_id", "text"), WORDS)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        id_digest("ids").alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op1_bpe_encoding")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return encoding_digests(table(spark, folder, "documents"))


@query("op8_token_records")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    files = new_folder(spark)
    index = records.write_records(table(spark, folder, "documents"), WORDS, files, end_id=END_ID)
    return records.read_records(index, files).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@query("op10_token_counts")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    counted = counts.token_counts(docs, BYTES, keep=["doc_id", "n_bytes"])
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query("op7_simhash_near_duplicates")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


@query("op9_secret_scan")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, folder, "documents"), keep=["doc_id"])

    def listed(spans):
        each = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(each, ",")

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[number(k) for k in ("assign", "access", "hex")],
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] != "random")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def held_out() -> Column:
    return F.coalesce(language.fold("doc_id") == 0, F.lit(False))


def language_model(docs: DataFrame, noise: str | None = None) -> language.Model:
    """Trained on the documents outside the held-out fold; those without an id are in no fold."""
    return language.train(docs.where(language.fold("doc_id") != 0).select("text", "lang"), noise=noise)


@query("op2_language_id")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language_model(docs)
    return language.identify(docs.select("doc_id", "text", held_out().alias("held_out")), model, keep=["doc_id", "held_out"])


@query("op6_source_mix")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixing.by_row(mixed).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH all_turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g') AS role_out, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS text_out
  FROM all_turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role_out) + length(text_out) + length('<|start|><|text|><|end|>')) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""


@query("op5_chat_format", OP5_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    words = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", words), (-7, 1, "assistant", words)], "conv_id long, turn long, role string, text string")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    back = chat.read_back(chat.format_chats(rows, BYTES))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_dot_product(CAST(q.w AS DOUBLE[]), CAST(d.w AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query("op3_exact_top_k", OP3_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return topk.top_products(vectors, vectors.where("vec_id % 20 = 0"), k=20)


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), usable AS (
  SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(x, lambda c: c <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(counts.n, 0) AS n_links, least.component_id, v.vec_id = least.component_id AS kept
FROM v JOIN least ON v.vec_id = least.a LEFT JOIN counts ON v.vec_id = counts.a
"""


@query("op4_embedding_near_duplicates", OP4_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, folder, "embeddings"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || CAST(doc_id AS VARCHAR)) AS digest,
    CASE WHEN coalesce(text, '') = '' THEN [] ELSE regexp_extract_all(text, '[^\n]*\n|[^\n]+') END AS lines
  FROM documents
), drawn AS (
  SELECT *, CAST(len(lines) AS BIGINT) AS n, list_transform([0, 1, 2, 3], lambda k:
    list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(substr(digest, CAST(8 * k + 1 AS BIGINT), 8), ''), lambda c: CAST(instr('0123456789abcdef', c) - 1 AS BIGINT))),
      lambda x, y: 16 * x + y)) AS h
  FROM d
), cuts AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN doc_id IS NULL OR text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
      WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle, array_to_string(lines[b + 1:n], '') AS suffix FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""


@query("op13_fill_in_middle", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    cut = fill_middle.fill_in_middle(table(spark, folder, "documents"), keep=["doc_id"])
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP12_SQL = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (
  SELECT lang, regexp_extract_all(unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM texts
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang
), sizes AS (SELECT lang, w, unnest(range(1, least(5, len(w)) + 1)) AS k FROM pieces),
spans AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sizes),
frequent AS (
  SELECT lang, w[i:i + k - 1] AS p, count(*) AS f FROM spans GROUP BY 1, 2 HAVING count(*) >= 100
), inside AS (SELECT lang, p, f, unnest(range(2, len(p))) AS k FROM frequent WHERE len(p) > 2),
parts AS (SELECT lang, p, f, k, unnest(range(1, len(p) - k + 2)) AS i FROM inside),
covering AS (SELECT lang, p[i:i + k - 1] AS p, max(f) AS longer FROM parts GROUP BY 1, 2),
kept AS (
  SELECT frequent.lang, frequent.p, f AS a FROM frequent LEFT JOIN covering ON frequent.lang = covering.lang AND frequent.p = covering.p
  WHERE len(frequent.p) > 1 AND NOT coalesce(100 * longer >= 100 * f, false)
), cuts AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM kept),
scored AS (
  SELECT cuts.lang, cuts.p, a, k, x.f AS l, y.f AS r, n, (CAST(1000 AS HUGEINT) * a * n) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM cuts JOIN frequent x ON x.lang = cuts.lang AND x.p = cuts.p[1:k] JOIN frequent y ON y.lang = cuts.lang AND y.p = cuts.p[k + 1:len(cuts.p)]
  JOIN totals ON totals.lang = cuts.lang
), lowest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS place FROM scored
), ranked AS (
  SELECT *, array_to_string(p, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(p, ' '))) AS rank
  FROM lowest WHERE place = 1
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""


@query("op12_phrase_collocations", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


@query("op11_lm_scores")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 10
    model = lm.train(docs.where(remainder != 0).select("text"))
    rows = docs.select("doc_id", "text", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"))
    return lm.score(rows, model, keep=["doc_id", "held_out"])
