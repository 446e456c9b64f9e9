"""Queries of the operators in this package, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import kept, new_path
from . import chat, fingerprint, media, minhash, mixing, phrases, quality, runs, sentencepiece, substring_dedup, token_shards, url_filter, warc
from ._scratch import map_batches, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = sentencepiece.decode(sentencepiece.encode(documents))
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"), same.alias("round_trip"))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "shards")
    token_shards.write_shards(sentencepiece.encode(table(spark, sf_dir, "documents").select("text")), path)
    return token_shards.read_slots(spark, path).select("slot", "shard", "byte_offset", F.sha2("tokens", 256).alias("tokens_sha256"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.in_order(mixing.mix(table(spark, sf_dir, "documents"), ties=["text"]))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(documents, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(quality.fold() == 0, F.lit(False)).alias("held_out")
    return quality.score(documents, model).select("doc_id", held_out, "score", "predicted")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = kept(media.store_png(media.text_payloads(table(spark, sf_dir, "documents"))), "media", "uncompressed")
    return media.read_png(stored)


#: The rules of the contract.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok").alias("text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    parts = kept(chat.formatted(chat.messages(chat.log_of(conversations.unionByName(more)))), "chat")
    return chat.digests(parts)


def with_repetitions(documents: DataFrame) -> DataFrame:
    """doc_id and text; with h, the crc32 of the decimal id, and g = h div 10: where h % 10 is 0, the words from number
    a = g % n on repeat the p words there, p = 1 + (n - a) div (3 + g % 8). Other texts, and those of a null id, stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for h, body in zip(batch.column("h").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if h is not None and h % 10 == 0 and (words := (body or b"").split()):
                    g, n = h // 10, len(words)
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    body = b" ".join([*words[:a], *(words[a + i % p] for i in range(n - a))])
                texts.append(body)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    rows = documents.select("doc_id", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"), "text")
    return map_batches(rows, run, "doc_id long, text string")


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(with_repetitions(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    told = found.withColumn("best", runs.strongest(F.col("runs")))
    return told.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_warc, op2_sentencepiece, op3_token_shards, op4_fingerprint, op5_substring_dedup, op6_mixing, op7_quality, op8_minhash, op9_media, op10_url_filter, op11_chat, op12_runs, op13_phrases)}

ORACLE: dict[str, str] = {
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS largest FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + ((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < largest THEN largest END AS refers_to
FROM d""",
    "op5_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, string_split(trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' ') AS w FROM documents),
     e AS (SELECT row_id, doc_id, CASE WHEN w = [''] THEN [] ELSE w END AS w FROM d),
     s AS (SELECT row_id, unnest(range(1, len(w) - 33)) AS i FROM e WHERE len(w) >= 35),
     g AS (SELECT row_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS seq FROM s JOIN e USING (row_id)),
     r AS (SELECT row_id, i, count(*) OVER (PARTITION BY seq) AS n FROM g),
     c AS (SELECT DISTINCT row_id, i + j AS pos FROM (SELECT row_id, i FROM r WHERE n > 1), range(35) t(j)),
     x AS (SELECT row_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM e),
     k AS (SELECT row_id, count(*) AS kept, string_agg(word, ' ' ORDER BY pos) AS kept_text FROM x ANTI JOIN c USING (row_id, pos) GROUP BY row_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept_text, '')) AS kept_sha256
FROM e LEFT JOIN k USING (row_id)""",
    "op8_minhash": r"""
WITH RECURSIVE d AS (SELECT doc_id, string_split(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' ') AS w FROM documents),
     s AS (SELECT doc_id, CASE WHEN w = [''] THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                               ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS x FROM d),
     n AS (SELECT doc_id, CAST(len(x) AS BIGINT) AS n FROM s),
     e AS (SELECT doc_id, unnest(x) AS g FROM s),
     p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
     l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
     r AS (SELECT doc_id AS v, doc_id AS c FROM n UNION SELECT l.b, r.c FROM r JOIN l ON r.v = l.a)
SELECT doc_id, n AS n_shingles, m AS component_id, doc_id = m AS kept
FROM n JOIN (SELECT v, min(c) AS m FROM r GROUP BY v) ON doc_id = v""",
    "op10_url_filter": r"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
     s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
     t AS (SELECT *, CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
                          WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
                          WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
                          WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM s)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM t""",
    "op11_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, turn, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
     e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '</turn>', '\</turn>'), '<turn ', '\<turn ') AS body,
                  replace(replace(replace(role, '\', '\\'), '>', '\>'), chr(10), '\' || chr(10)) AS name FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(name) + length(body) + 16) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op13_phrases": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
     w AS (SELECT lang, list_filter(string_split(replace(piece, chr(9), ' '), ' '), lambda x: x <> '') AS w FROM p),
     t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
     i AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (VALUES (1), (2), (3)) v(m)),
     f AS (SELECT lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, m, count(*) AS c FROM i GROUP BY ALL),
     c AS (SELECT lang, phrase, m, c AS a, string_split(phrase, ' ') AS x FROM f WHERE m > 1 AND c >= 10),
     k AS (SELECT c.*, unnest(range(1, m)) AS k FROM c),
     s AS (SELECT k.lang, k.phrase, k.a, k.k, l.c AS l, r.c AS r, CAST((1000000::HUGEINT * k.a * k.a) // (l.c::HUGEINT * r.c) AS BIGINT) AS score
           FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.x[1:k.k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.x[k.k + 1:], ' ')),
     b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
     o AS (SELECT lang, array_to_string(x[j:j + 1], ' ') AS phrase, max(a) AS cover FROM c, (VALUES (1), (2)) v(j) WHERE m = 3 GROUP BY ALL),
     d AS (SELECT b.* FROM b LEFT JOIN o USING (lang, phrase) WHERE cover IS NULL OR 100 * cover < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d) JOIN t USING (lang) WHERE rank <= 2000""",
}
