"""Questions to documents: ingestion with limits, retrieval of passages, and an answer that is citations or 'not answerable'.

No text is generated here. What would be sent to a model is the context: passages that passed the content scan, inside
their boundaries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenta.operators import injection, retrieval

# Fixed value: characters that a document may have.
MOST_CHARS = 2_000_000


def ingested(docs: DataFrame, key: str, text: str = "text", **options) -> tuple[DataFrame, DataFrame]:
    """(chunks, records): chunks of the documents that are taken, and for each document key, n_chars, n_chunks, flagged_chunks, refused.

    Empty and overlong documents are refused and say why; null keys and repeated rows are documents of their own.
    """
    own = docs.select(F.col(key).cast("string").alias("doc_key"), F.col(text).alias("text"), F.coalesce(F.length(text), F.lit(0)).alias("n_chars"))
    refused = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty").when(F.col("n_chars") > MOST_CHARS, "too long")
    own = own.withColumn("refused", refused)
    chunks = retrieval.chunked(own.where("refused is null"), "doc_key", **options)
    scanned = injection.scanned(chunks)
    sums = scanned.groupBy("doc_key").agg(F.count("*").alias("n_chunks"), F.sum(F.col("suspicious").cast("long")).alias("flagged_chunks"))
    records = own.select("doc_key", "n_chars", "refused").join(sums, "doc_key", "left")
    return chunks, records.select("doc_key", "n_chars", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("flagged_chunks", F.lit(0)).alias("flagged_chunks"), "refused")


def ask(chunks: DataFrame, question: str, limit: int = 5) -> dict:
    """{answerable, citations, context, excluded, reason}: the best passages by fused ranks of two signals, less those that the scan excludes."""
    signals = {"bm25": retrieval.bm25_texts(chunks, "chunk_id", question), "char_ngram": retrieval.char_tfidf(chunks, "chunk_id", question)}
    hits = retrieval.fused(signals, "chunk_id", limit)
    found = injection.admitted(hits.join(chunks, "chunk_id")).orderBy("rank")
    every = {r.chunk_id: r for r in hits.join(chunks, "chunk_id").collect()}  # at most limit passages
    excluded = [r.asDict() for r in injection.report(hits.join(chunks, "chunk_id"), "chunk_id").collect()]
    if not every:
        return {"answerable": False, "citations": [], "context": "", "excluded": [], "reason": "no passage matches the question"}
    kept = found.select("chunk_id", "wrapped").collect()
    if not kept:
        return {"answerable": False, "citations": [], "context": "", "excluded": excluded, "reason": "the content scan excluded every matching passage"}
    citations = [{k: every[r.chunk_id][k] for k in ("chunk_id", "doc_key", "ordinal", "heading_path", "text", "rank", "rrf", "places")} for r in kept]
    return {"answerable": True, "citations": citations, "context": "\n\n".join(r.wrapped for r in kept), "excluded": excluded, "reason": ""}
