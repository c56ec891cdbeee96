"""Corpus statistics, document views, text extraction, token budgets, citations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import text
from tidemark.functions.fixed_values import CONTENT_TYPE_ORDER
from tidemark.functions.scale import collect_in_pages

SYSTEM_PROMPT_TOKENS = 245
TOKEN_LIMIT = 8192
PAGE_CHUNKS = 500


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """Documents, chunks and vectors per corpus, counted per document first."""
    per_doc = chunks.groupBy("tenant_id", "corpus_id", "doc_id").agg(
        F.count("*").alias("_chunks"), F.count_if(F.size("content_embedding") > 0).alias("_vectors"))
    return per_doc.groupBy("tenant_id", "corpus_id").agg(
        F.count("*").alias("documents"), F.sum("_chunks").alias("chunks"), F.sum("_vectors").alias("vectors"))


def document_stats(chunks: DataFrame, preview_chars: int = 200) -> DataFrame:
    head = F.min_by(F.substring("content", 1, preview_chars), F.struct("chunk_index", "row_id"))
    return chunks.groupBy("tenant_id", "corpus_id", "doc_id").agg(
        F.count("*").alias("chunk_count"), F.max("page_number").alias("pages"), head.alias("preview"),
        F.bool_or(F.col("content_type") == "image").alias("has_images"),
        F.bool_or(F.col("content_type") == "table").alias("has_tables"))


def reassemble(chunks: DataFrame, page_chunks: int = PAGE_CHUNKS) -> DataFrame:
    """Document text in reading order and its image/table assets.

    One row per document and page of ``page_chunks`` chunk positions: common
    documents are one row, and the longest one never gathers in a single task.
    """
    item = F.struct("chunk_index", "row_id", "content_type", "content")
    pages = collect_in_pages(chunks, ["tenant_id", "corpus_id", "doc_id"], F.col("chunk_index"), item, page_chunks)

    def pick(test) -> Column:
        return F.filter("items", test)
    texts = F.transform(pick(lambda i: i["content_type"] == "text"), lambda i: i["content"])
    assets = F.transform(pick(lambda i: i["content_type"].isin("image", "table")), lambda i: i["row_id"])
    return pages.select("tenant_id", "corpus_id", "doc_id", "page", F.array_join(texts, "\n\n").alias("text"),
                        assets.alias("assets"),
                        F.size(pick(lambda i: i["content_type"] == "image")).alias("image_count"))


def find_text(rows: DataFrame, query: str, columns: Sequence[str]) -> DataFrame:
    """Case-insensitive substring search over several columns; blank finds all."""
    if not query.strip():
        return rows
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(query.lower()), F.lit(False))
    return rows.filter(hit)


def by_type(chunks: DataFrame) -> DataFrame:
    """Chunk counts per document and content type, in the fixed type order."""
    kind = F.coalesce("content_type", F.lit("text"))
    place = F.array_position(F.array(*[F.lit(t) for t in CONTENT_TYPE_ORDER]), F.col("content_type"))
    return (chunks.groupBy("doc_id", kind.alias("content_type")).agg(F.count("*").alias("chunks"))
            .withColumn("type_order", place.cast("int")).orderBy("doc_id", "type_order"))


def multimodal_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id", "page_number").agg(
        *[F.count_if(F.col("content_type") == t).alias(f"{t}_count") for t in ("image", "table", "formula")])


def entities_by_type(chunks: DataFrame) -> DataFrame:
    """Extracted entities grouped by type: mentions and distinct names."""
    found = (chunks.select(F.inline_outer(text.extract_entities("content"))).filter("name IS NOT NULL")
             .groupBy("type", "name").agg(F.count("*").alias("_n")))
    return found.groupBy(F.coalesce("type", F.lit("OTHER")).alias("entity_type")).agg(
        F.sum("_n").alias("mentions"), F.count("*").alias("names"))


def token_budget(parts: DataFrame, source: str, content: str = "content") -> DataFrame:
    """Estimated tokens per source and the level of the whole prompt against the limit."""
    sums = parts.groupBy(F.col(source).alias("source")).agg(F.sum(text.token_estimate(content)).alias("tokens"))
    total = F.lit(SYSTEM_PROMPT_TOKENS) + sums.agg(F.sum("tokens")).scalar()
    return sums.withColumn("total_tokens", total).select(
        "source", "tokens", "total_tokens",
        F.when(F.col("total_tokens") > 6000, "high").when(F.col("total_tokens") > 4000, "medium").otherwise("low").alias("level"),
        (F.col("total_tokens") <= TOKEN_LIMIT).alias("fits"))


_REF_IMAGE = r"!\[[^\]]*\]\[(?:IMG-\d+|\d+)\]"
_PLAIN = r"\[(?:\d+|IMG-\d+|TABLE-\d+|EQ-\d+)\]"


def citations(answers: DataFrame, keys: Sequence[str], answer: str = "text") -> DataFrame:
    """Citation marks in order of appearance; an image reference hides the mark inside it."""
    # Alternation order gives the image form precedence at the same position.
    marks = F.regexp_extract_all(answer, F.lit(f"({_REF_IMAGE}|{_PLAIN})"), F.lit(1))
    found = answers.select(*keys, F.posexplode_outer(marks).alias("_i", "mark")).filter("mark IS NOT NULL")
    is_image = F.col("mark").startswith("!")
    ref = F.regexp_extract("mark", r"\[([^\[\]]*)\]$", 1)
    return found.select(
        *keys, (F.col("_i") + 1).alias("position"), F.when(is_image, "ref_image").otherwise("citation").alias("kind"),
        ref.alias("ref_id"), F.regexp_extract("mark", r"^!\[([^\]]*)\]", 1).alias("alt_text"))


def context_window(chunks: DataFrame, n: int = 2, page: int = 64) -> DataFrame:
    """Every chunk with up to ``n`` contents before and after it, in order.

    Documents are dealt in pages of positions, so a long one spreads over tasks; only the ``n`` chunks at either end of a page
    are sent to the next page as well. A content is shuffled about once, not once for each neighbour.
    """
    home = ["tenant_id", "corpus_id", "doc_id"]
    at, placed = F.col("chunk_index"), F.lit(True)
    for c in [*home, "chunk_index"]:
        placed &= F.col(c).isNotNull()
    own = F.floor(at / page)
    first, last = F.floor(F.greatest(at - n, F.least(at, F.lit(0))) / page), F.floor((at + n) / page)
    # A chunk without a place has no neighbours and a page of its own.
    rows = (chunks.select(*home, "row_id", "content", "chunk_index").withColumn("_placed", placed)
            .withColumn("_own", F.when(F.col("_placed"), own).otherwise(F.xxhash64("row_id")))
            .withColumn("_page", F.explode(F.when(F.col("_placed"), F.sequence(first, last)).otherwise(F.array("_own")))))
    by_place = Window.partitionBy(*home, "_page").orderBy("chunk_index")

    def side(low: int, high: int) -> Column:
        return F.collect_list(F.struct("chunk_index", "row_id", "content")).over(by_place.rangeBetween(low, high))

    def contents(c: str) -> Column:
        near = F.array_sort(F.filter(c, lambda x: F.col("_placed") & (x["row_id"] != F.col("row_id"))))
        return F.transform(near, lambda x: x["content"]).alias(c)
    found = rows.withColumns({"before": side(-n, -1), "after": side(1, n)}).filter(F.col("_page") == F.col("_own"))
    return found.select("tenant_id", "corpus_id", "row_id", "content", contents("before"), contents("after"))


def by_content_type(chunks: DataFrame, content_type: str) -> DataFrame:
    return chunks.filter(F.col("content_type") == content_type)
