"""One query per operator over the test tables, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, fingerprints, html_extract, language_id, license_scan, line_dedup, lm_score, mixing, packing, periodic_runs, simhash, topk, whitening
from ledgerlens.llm.common import held_back, read_table

Query = Callable[[SparkSession, str], DataFrame]

VOCABULARY = "byte_bpe_50k.json"


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and notices of every document."""
    return license_scan.scan(read_table(spark, folder, "documents"), containment=0.8)


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """SimHash and near-duplicate component of every document."""
    return simhash.near_duplicates(read_table(spark, folder, "documents"), shingle=3, distance=3, seed=42)


def op5_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(read_table(spark, folder, "pages"))


def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints.fingerprint_edits(read_table(spark, folder, "documents"))


def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    return bpe.round_trip(read_table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learnt from the rows that are not held out."""
    held_out = held_back(F.col("doc_id"), parts=4, part=2)
    documents = read_table(spark, folder, "documents").withColumn("held_out", held_out)
    return language_id.identify(documents, ~held_out, keep=["doc_id", "held_out"])


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most 1024 tokens."""
    return packing.pack(read_table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY), length=1024)


def op8_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest rows of every twentieth vector."""
    vectors = read_table(spark, folder, "embeddings")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20, scale=64.0)


OP8_SQL = """
WITH usable AS (
    SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""


def op9_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Katz scores of all documents, learnt from nine in ten."""
    documents = read_table(spark, folder, "documents")
    return lm_score.score_texts(documents, held_back(F.col("doc_id"), parts=10, part=0))


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the boilerplate lines of their source."""
    cleaned = line_dedup.drop_boilerplate(read_table(spark, folder, "documents"), host="source")
    return cleaned.select("doc_id", "source", "text", "n_dropped")


OP10_SQL = f"""
WITH lines AS (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents
), totals AS (
    SELECT source, count(*) AS pages FROM documents WHERE source IS NOT NULL GROUP BY source
), found AS (
    SELECT source, trim(line) AS line FROM lines JOIN totals USING (source) WHERE trim(line) <> ''
    GROUP BY source, trim(line)
    HAVING count(DISTINCT doc_id) >= {line_dedup.LEAST_PAGES} AND count(DISTINCT doc_id) > {line_dedup.RATIO} * any_value(pages)
), judged AS (
    SELECT doc_id, lines.line, place, found.line IS NOT NULL AS dropped
    FROM lines LEFT JOIN found ON lines.source = found.source AND trim(lines.line) = found.line
), rest AS (
    SELECT doc_id, string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped) AS text,
           count(*) FILTER (dropped) AS n_dropped FROM judged GROUP BY doc_id
)
SELECT documents.doc_id, source, CASE WHEN n_dropped > 0 THEN coalesce(rest.text, '') ELSE documents.text END AS text,
       coalesce(n_dropped, 0) AS n_dropped
FROM documents LEFT JOIN rest ON documents.doc_id = rest.doc_id
"""


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Whitened values of every vector on the eight strongest components of all vectors."""
    return whitening.whiten(read_table(spark, folder, "embeddings"), most=8, scale=1024.0, shift=100_000)


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of every document, some of which are made periodic first."""
    return periodic_runs.periodic_runs(read_table(spark, folder, "documents"), least_words=24, least_periods=3, plant=True)


def op13_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that a mix of the sources takes of every document: 150 % of all words, no document more than twice."""
    return mixing.mix(read_table(spark, folder, "documents"), weights=[5.0, 2.0, 1.0], share=1.5, most=2.0, seed=42)


QUERIES: dict[str, tuple[Query, str | None]] = {
    "op1_language_id": (op1_language_id, None),
    "op2_packing": (op2_packing, None),
    "op3_license_scan": (op3_license_scan, license_scan.scan_sql(0.8)),
    "op4_simhash": (op4_simhash, None),
    "op5_html_extraction": (op5_html_extraction, None),
    "op6_fingerprints": (op6_fingerprints, None),
    "op7_bpe": (op7_bpe, None),
    "op8_topk": (op8_topk, OP8_SQL),
    "op9_lm_scoring": (op9_lm_scoring, None),
    "op10_line_dedup": (op10_line_dedup, OP10_SQL),
    "op11_whitening": (op11_whitening, None),
    "op12_periodic_runs": (op12_periodic_runs, None),
    "op13_mixing": (op13_mixing, None),
}
