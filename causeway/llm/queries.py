"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.decontaminate import contaminated
from causeway.llm.language import identify
from causeway.llm.licenses import DIGESTS, KNOWN, canonical_sql, scan_licenses
from causeway.llm.media import media_columns
from causeway.llm.ngram_join import jaccard_components
from causeway.llm.packing import pack
from causeway.llm.substring_dedup import remove_repeats
from causeway.llm.token_files import read_summary, write_files
from causeway.llm.toxicity import score_toxicity
from causeway.llm.warc import canonical_url_sql, page_captures, resolve_revisits


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(of: int) -> Column:
    """crc32(doc_id as text) mod ``of``."""
    return F.crc32(F.col("doc_id").cast("string")) % of


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(_table(spark, sf_dir, "documents"))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page is crawled at the time of its number and revisited 1000 later."""
    found = resolve_revisits(page_captures(_table(spark, sf_dir, "pages"), later=1000))
    return found.select("record_id", "canonical_url", "response_id", "outcome", "digest", F.to_json("headers").alias("headers"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), n=3, percent=90)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1, size=2048)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs, fold(3) != 1)
    return out.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_summary(*write_files(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=0))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), fold(4) != 2)
    held = F.coalesce(fold(4) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_media_columns": op1_media_columns,
    "op2_warc_revisits": op2_warc_revisits,
    "op3_license_scan": op3_license_scan,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_packing": op5_packing,
    "op6_language_id": op6_language_id,
    "op7_token_files": op7_token_files,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_decontamination": op10_decontamination,
}

_known = ", ".join("('" + i.replace("'", "''") + "', '" + t.replace("'", "''") + "')" for i, t in KNOWN)
_digests = ", ".join(f"('{d}', '{i}')" for i, d in DIGESTS.items())
_words = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES = {
    "op2_warc_revisits": f"""
        WITH p AS (SELECT page_id, ((page_id % 4) + 4) % 4 AS k, coalesce(html, '') AS html, {canonical_url_sql('url')} AS c FROM pages),
        x AS (SELECT page_id, k, c, md5(html) AS etag, sha256(html) AS digest, CAST(strlen(html) AS VARCHAR) AS size FROM p),
        r AS (SELECT 2 * page_id AS id, page_id AS t, * EXCLUDE (k, page_id) FROM x),
        v AS (SELECT 2 * page_id + 1 AS id, page_id + 1000 AS t, * EXCLUDE (page_id) FROM x),
        m AS (SELECT v.id AS record_id, v.c AS canonical_url, v.t AS t, r.id AS response_id, r.digest AS digest, r.size AS size, r.etag AS etag,
                CASE WHEN r.id IS NULL THEN 'no_response' WHEN v.k = 3 THEN 'unverified'
                     WHEN (v.k = 0 AND v.etag = r.etag) OR (v.k = 1 AND v.digest = r.digest) OR (v.k = 2 AND v.size = r.size) THEN 'resolved' ELSE 'mismatch' END AS outcome
              FROM v ASOF LEFT JOIN r ON v.c = r.c AND v.t > r.t),
        g AS (SELECT *, outcome IN ('resolved', 'unverified') AS good FROM m)
        SELECT record_id, canonical_url, CASE WHEN good THEN response_id END AS response_id, outcome, CASE WHEN good THEN digest END AS digest,
            CASE WHEN good THEN '{{"cache-control":"max-age=60","content-length":"' || size || '","content-type":"text/html","date":"' || t || '","etag":"' || etag || '"}}' END AS headers
        FROM g""",
    "op4_ngram_jaccard": f"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({_lower}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
        g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
        n AS (SELECT doc_id, len(s) AS n FROM g),
        e AS (SELECT doc_id, unnest(s) AS x FROM g),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 90 * (x.n + y.n - i)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
        SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(reach.b) AS component_id FROM n JOIN reach ON n.doc_id = reach.a GROUP BY ALL""",
    "op8_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_words} AS w FROM documents),
        p AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS n FROM d),
        g AS (SELECT doc_id, i, word, n, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) AS h FROM p),
        r AS (SELECT doc_id, i, word, CASE WHEN i + 35 <= n AND count(*) OVER (PARTITION BY h, i + 35 <= n) > 1 THEN 1 ELSE 0 END AS again FROM g),
        k AS (SELECT doc_id, i, word, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM r),
        s AS (SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '') AS kept FROM k GROUP BY doc_id)
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN s USING (doc_id)""",
    "op3_license_scan": f"""
        WITH forms AS (SELECT license_id, {canonical_sql('text')} AS form FROM (VALUES {_known}) v(license_id, text)),
        known AS (SELECT canonical_sha256, min(license_id) AS license_id
                  FROM (SELECT sha256(form) AS canonical_sha256, license_id FROM forms WHERE form <> '' UNION ALL SELECT * FROM (VALUES {_digests}) d(canonical_sha256, license_id)) GROUP BY 1)
        SELECT doc_id, canonical_sha256, license_id
        FROM (SELECT doc_id, sha256({canonical_sql('text')}) AS canonical_sha256 FROM documents) LEFT JOIN known USING (canonical_sha256)""",
}
