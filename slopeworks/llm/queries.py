"""One registered query per operator, over its whole table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopeworks.shared import settled, shared_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from slopeworks.llm.pieces import encode_pieces

    return piece_digests(encode_pieces(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model")))


def piece_digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def remainder(id_column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from slopeworks.llm.toxicity import score, train

    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    learned = documents.filter(remainder("doc_id", 5) != 0)
    model = train(learned, labels, "doc_id", "text", "toxic", remainder("id", 5) == 1)
    return _judged(score(documents.select("doc_id", "text"), model), 0.5)


def op5_pages(spark: SparkSession, folder: str) -> DataFrame:
    from slopeworks.llm.pages import extract

    found = extract(table(spark, folder, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op6_vectors(spark: SparkSession, folder: str) -> DataFrame:
    from slopeworks.llm.vectors import near_vectors

    found = near_vectors(table(spark, folder, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    from slopeworks.llm.quality import features, score, train

    rows = settled(features(table(spark, folder, "documents")))
    labels = table(spark, folder, "labels")
    model = train(rows.filter(remainder("doc_id", 5) != 0), labels, "doc_id", "quality")
    return _judged(score(rows, model), 0.3)


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    from slopeworks.llm.language import identify, train

    documents = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = remainder("doc_id", 3) == 1
    model = train(documents.filter(~held_out))
    found = identify(documents, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def _judged(scored: DataFrame, limit: float) -> DataFrame:
    """``doc_id, held_out, score, predicted``, for labels learned where the remainder of 5 is not 0."""
    return scored.select(
        "doc_id",
        (remainder("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= limit).cast("int").alias("predicted"),
    )


def _joined(spans, kinds: tuple[str, ...]):
    kept = F.filter(spans, lambda span: span["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _number_of(spans, kind: str):
    return F.size(F.filter(spans, lambda span: span["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op2_secrets(spark: SparkSession, folder: str) -> DataFrame:
    from slopeworks.llm.secrets import KINDS, find_secrets

    found = find_secrets(table(spark, folder, "documents"))
    base = KINDS[:3]
    counts = [_number_of(F.col("spans"), kind) for kind in base]
    digest = F.sha2(_joined(F.col("spans"), base), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, _joined(F.col("spans"), KINDS).alias("spans"))


def op3_contamination(spark: SparkSession, folder: str) -> DataFrame:
    from slopeworks.llm.decontaminate import contamination

    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    from slopeworks.llm.simhash import near_copies

    found = near_copies(table(spark, folder, "documents"))
    text = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", text.alias("fingerprint"), "component_id")


def op8_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from slopeworks.llm.shards import read_token_shards, write_token_shards

    path = shared_folder(spark, f"token-shards-{uuid4().hex}")
    write_token_shards(table(spark, folder, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_shards(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def _damaged_conversations(conversations: DataFrame) -> DataFrame:
    """Rows of the contract: dropped, emptied, without ends of sentences, repeated or given to the user by hash."""
    text_of = {name: F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("conv_id", "turn", "role", "text")}
    hashed = F.crc32(F.concat_ws(":", text_of["conv_id"], text_of["turn"]).cast("binary")) % 20
    rows = conversations.withColumn("damage", hashed).filter("damage <> 0")
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace(text_of["text"], "[.!?]", ""))
    role = F.when(F.col("damage") == 4, "user").otherwise(text_of["role"])
    times = F.when(F.col("damage") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.otherwise(text_of["text"]).alias("text"), times.alias("times"))
    return rows.select("conv_id", "turn", "role", "text", F.explode("times").alias("copy")).drop("copy")


def op11_conversations(spark: SparkSession, folder: str) -> DataFrame:
    from slopeworks.llm.conversations import repair

    conversations = table(spark, folder, "conversations")
    found = repair(_damaged_conversations(conversations))
    ids = conversations.select(F.col("conv_id").alias("id")).distinct()
    joined = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    digest = F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return joined.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), digest)


def _damaged_words(documents: DataFrame) -> DataFrame:
    """``word, n`` of the contract: runs of letters with A-Z lowered, one letter deleted where 199 divides the hash.
    Runs under six letters give no word of six, so they are not taken."""
    runs = F.expr(r"regexp_extract_all(text, '[A-Za-z\\u00C0-\\u00FF]{6,}', 0)")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    found = found.withColumn("run", F.translate("run", upper, lower))
    found = found.withColumn("hash", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    place = (F.col("hash") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    words = found.select(F.when(F.col("hash") % 199 == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= 6).groupBy("word").agg(F.count("*").alias("n"))


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    from slopeworks.llm.spelling import forms

    counted = _damaged_words(table(spark, folder, "documents"))
    return forms(counted.filter("n >= 5"))


def op13_exact(spark: SparkSession, folder: str) -> DataFrame:
    from slopeworks.llm.exact import DigestIndex, buckets_for, digests

    rows = digests(table(spark, folder, "documents"))
    path, kind = shared_folder(spark, f"digest-index-{uuid4().hex}"), rows.schema["id"].dataType.simpleString()
    index = DigestIndex.at(spark, path, kind, buckets_for(rows.count()))
    # Two deliveries, the smaller ids first, so that the second one meets an index that is not empty.
    middle = rows.select(F.percentile_approx("id", 0.5)).first()[0]
    early = F.coalesce(F.col("id") <= F.lit(middle), F.lit(False))
    index.add(rows.filter(early), "1")
    index.add(rows.filter(~early), "2")
    found = index.resolve(rows)
    digest = F.lower(F.hex("digest")).alias("text_sha256")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", digest)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_secrets": op2_secrets,
        "op3_contamination": op3_contamination,
        "op4_simhash": op4_simhash,
        "op5_pages": op5_pages,
        "op6_vectors": op6_vectors,
        "op7_quality": op7_quality,
        "op8_token_shards": op8_token_shards,
        "op9_language": op9_language,
        "op10_pieces": op10_pieces,
        "op11_conversations": op11_conversations,
        "op12_spelling": op12_spelling,
        "op13_exact": op13_exact,
    }


_CONTAMINATION = """
  WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
  b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
  item_windows AS (
    SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g
    FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
          FROM b WHERE len(w) > 0)),
  doc_windows AS (
    SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
          FROM d, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)),
  hits AS MATERIALIZED (SELECT doc_id, i, n, item_id FROM doc_windows JOIN item_windows USING (n, g)),
  marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit
             FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
  named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
  SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
         coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)"""

_VECTORS = """
  WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  near AS MATERIALIZED (SELECT a.vec_id AS one, b.vec_id AS two FROM v a, v b
           WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
  reached(one, two) AS (SELECT vec_id, vec_id FROM v
           UNION SELECT r.one, n.two FROM reached r JOIN near n ON n.one = r.two)
  SELECT vec_id, n_links, component_id, vec_id = component_id AS kept
  FROM (SELECT one AS vec_id, min(two) AS component_id FROM reached GROUP BY one)
  JOIN (SELECT vec_id, count(two) AS n_links FROM v LEFT JOIN near ON one = vec_id GROUP BY vec_id) USING (vec_id)"""


_EXACT = """
  WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256
             FROM documents)
  SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
         row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
  FROM d WINDOW same AS (PARTITION BY text_sha256)"""


def llm_oracles() -> dict[str, str]:
    """SQL answers, where SQL has what a query needs; the others are tested against brute force."""
    return {"op3_contamination": _CONTAMINATION, "op6_vectors": _VECTORS, "op13_exact": _EXACT}
