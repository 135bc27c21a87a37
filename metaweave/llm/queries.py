"""The registered queries of the training-data operators, with SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaweave.llm import concat_packing, decontaminate, divergence, exact_dedup, ngram, packing, pii, secrets, sharding, simhash, toxicity, upkeep, warc
from metaweave.llm.common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


#: The registered query's key; a corpus run brings its own from a secret store.
PII_KEY = b"metaweave registered query"


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.replace(table(spark, sf_dir, "documents"), PII_KEY)
    return found.select("doc_id", "text", F.size("entities").cast("bigint").alias("n_entities"), "entities")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.train_and_score(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "start", "length", F.sha2("candidate", 256).alias("candidate_sha256"), F.round("probability", 6).alias("probability"), "secret"
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.deduplicate(table(spark, sf_dir, "documents")).rows
    return found.select("doc_id", "keep_id", F.col("n").alias("group_size"), "kept", F.col("digest").alias("text_sha256"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_aggregate_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = upkeep.document_changes(table(spark, sf_dir, "documents"))
    return upkeep.maintain(changes, ["source", "lang"], "batch", "n_chars", "by", last=upkeep.BATCHES - 1)


def op13_concat_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concat_packing.pack(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_simhash": op3_simhash,
    "op4_ngram_lm": op4_ngram_lm,
    "op5_secrets": op5_secrets,
    "op6_decontaminate": op6_decontaminate,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_warc": op8_warc,
    "op9_sharding": op9_sharding,
    "op10_toxicity": op10_toxicity,
    "op11_source_divergence": op11_source_divergence,
    "op12_aggregate_upkeep": op12_aggregate_upkeep,
    "op13_concat_packing": op13_concat_packing,
}

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"""

ORACLES: dict[str, str] = {
    "op6_decontaminate": f"""
        WITH i AS (SELECT item_id, {_WORDS} AS w, least(10, len(w)) AS size FROM benchmark),
        iw AS (SELECT DISTINCT item_id, size, array_to_string(w[k : k + size - 1], ' ') AS win
               FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS k FROM i WHERE len(w) > 0)),
        d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        dk AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM iw) WHERE len(w) >= size),
        hit AS (SELECT DISTINCT doc_id, k, size, item_id FROM (SELECT doc_id, k, size, array_to_string(w[k : k + size - 1], ' ') AS win FROM dk) JOIN iw USING (size, win)),
        n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM hit) GROUP BY 1),
        who AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM hit GROUP BY 1)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN who USING (doc_id)
    """,
    "op7_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
        )
        SELECT doc_id,
               min(doc_id) OVER (PARTITION BY h) AS keep_id,
               count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY h) AS kept,
               h AS text_sha256
        FROM d
    """,
    "op8_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages
        ), f AS (SELECT h, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY h)
        SELECT p.page_id, p.n AS payload_bytes, p.h AS payload_digest,
               CASE WHEN f.first < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.first < p.page_id THEN f.first END AS refers_to
        FROM p LEFT JOIN f USING (h)
    """,
    "op11_source_divergence": f"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS} AS w FROM documents),
        g AS (SELECT DISTINCT lang, source FROM d),
        o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
        k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
        v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
        c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
        t AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
        p AS (
            SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * v)::HUGEINT AS p
            FROM t JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
        ),
        q AS (
            SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v)::HUGEINT AS q
            FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN (SELECT lang, sum(total) AS total FROM t GROUP BY ALL) USING (lang) JOIN v USING (lang)
        ),
        pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p)) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ),
        f AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
            UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
        )
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f)
        WHERE part = 'pair' OR rank <= 50
    """,
    "op12_aggregate_upkeep": """
        WITH RECURSIVE bits(i, k, v) AS (
            SELECT i, 0, i::BIGINT FROM range(256) AS r(i) UNION ALL SELECT i, k + 1, xor(v >> 1, 3988292384 * (v & 1)) FROM bits WHERE k < 8
        ), crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
        x AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, n_chars FROM documents),
        y AS (
            SELECT source, lang, n_chars, xor(list_reduce(
                list_prepend(4294967295::BIGINT, list_transform(range(1, length(id) + 1), lambda i: ascii(id[i])::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])
            ), 4294967295) AS h FROM x, crc
        ),
        z AS (SELECT source, lang, n_chars, h % 20 AS b, (h // 20) % 4 AS q FROM y),
        e AS (
            SELECT source, lang, n_chars AS v, b AS a, b + q AS z FROM z
            UNION ALL SELECT source, lang, n_chars + q, b + q, 99 FROM z WHERE q % 3 = 0
        ),
        s AS (
            SELECT t AS batch, source, lang, count(*) AS n_rows, count(DISTINCT v) AS n_distinct, coalesce(sum(v), 0)::BIGINT AS total,
                   min(v) AS least, max(v) AS greatest, (list(v ORDER BY v) FILTER (v IS NOT NULL))[(count(v) + 1) // 2] AS median
            FROM e, range(20) AS r(t) WHERE a <= t AND t < z GROUP BY ALL
        ),
        w AS (
            SELECT t AS batch, z.source, z.lang, coalesce(n_rows, 0) AS n_rows, coalesce(n_distinct, 0) AS n_distinct, coalesce(total, 0) AS total, least, greatest, median
            FROM (SELECT DISTINCT source, lang FROM z) AS z JOIN range(20) AS r(t) ON true LEFT JOIN s ON s.batch = t AND s.source = z.source AND s.lang = z.lang
        )
        SELECT * FROM (
            SELECT batch::INTEGER AS batch, source, lang,
                   coalesce(lag(n_rows) OVER g, 0) AS old_n_rows, n_rows AS new_n_rows, coalesce(lag(n_distinct) OVER g, 0) AS old_n_distinct, n_distinct AS new_n_distinct,
                   coalesce(lag(total) OVER g, 0) AS old_total, total AS new_total, lag(least) OVER g AS old_least, least AS new_least,
                   lag(greatest) OVER g AS old_greatest, greatest AS new_greatest, lag(median) OVER g AS old_median, median AS new_median
            FROM w WINDOW g AS (PARTITION BY source, lang ORDER BY batch)
        )
        WHERE old_n_rows <> new_n_rows OR old_n_distinct <> new_n_distinct OR old_total <> new_total OR old_least IS DISTINCT FROM new_least
           OR old_greatest IS DISTINCT FROM new_greatest OR old_median IS DISTINCT FROM new_median
    """,
}
