"""Chunks of long texts, and the way from chunk scores back to documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 500, 100
#: Separators from the coarsest to the finest; a text is cut at the first that makes its parts small enough.
SEPARATORS = {"plaintext": [r"\n\s*\n", r"\n", r"(?<=[.!?])\s+", r"\s+"], "markdown": [r"\n(?=#{1,6} )", r"\n\s*\n", r"\n", r"(?<=[.!?])\s+", r"\s+"]}


def _pieces(text: str, limit: int, separators: list[str]) -> Iterator[tuple[int, int]]:
    """Spans of at most limit characters, as coarse as they can be."""
    stack = [(0, len(text), 0)]
    while stack:
        start, end, depth = stack.pop()
        if end - start <= limit:
            if text[start:end].strip():
                yield start, end
            continue
        if depth == len(separators):
            stack += [(s, min(s + limit, end), depth) for s in range(start, end, limit)][::-1]
            continue
        cuts = [start, *(m.end() for m in re.finditer(separators[depth], text[start:end]) if 0 < m.end() < end - start)]
        edges = sorted({start, *(start + c for c in cuts[1:]), end})
        stack += [(a, b, depth + 1) for a, b in zip(edges, edges[1:], strict=False)][::-1]


def chunk_text(text: str | None, size: int = SIZE, overlap: int = OVERLAP, form: str = "plaintext") -> list[str]:
    """Chunks of at most size characters; a chunk begins with whole pieces of at most overlap characters from the one before."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap smaller")
    if not text or not text.strip():
        return []
    if len(text) <= size:
        return [text]
    spans, out, begin = list(_pieces(text, size, SEPARATORS[form])), [], 0
    while begin < len(spans):
        end = begin + 1
        while end < len(spans) and spans[end][1] - spans[begin][0] <= size:
            end += 1
        out.append(text[spans[begin][0] : spans[end - 1][1]].strip())
        if end == len(spans):
            break
        again = end
        while again - 1 > begin and spans[end - 1][1] - spans[again - 1][0] <= overlap and spans[end][1] - spans[again - 1][0] <= size:
            again -= 1
        begin = again
    return out


def chunk_id(doc: str, index: str):
    return F.concat(F.col(doc).cast("string"), F.lit("__chunk_"), F.col(index).cast("string"))


def chunk_documents(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, form: str = "plaintext") -> DataFrame:
    """(chunk_id, doc_id, chunk_index, text); empty texts have no chunks."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, i, c) for d, t in zip(frame["doc_id"], frame["text"], strict=True) for i, c in enumerate(chunk_text(t, size, overlap, form))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "text"])

    found = docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, chunk_index int, text string")
    return found.select(chunk_id("doc_id", "chunk_index").alias("chunk_id"), "doc_id", "chunk_index", "text")


def fixed_chunks(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Chunks of exactly size characters (the last may be shorter), without overlap, as a plan."""
    n = F.ceil(F.length("text") / size).cast("int")
    at = docs.where(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index"))
    part = F.substring(F.col("text"), F.col("chunk_index") * size + 1, F.lit(size))
    return at.select(chunk_id("doc_id", "chunk_index").alias("chunk_id"), "doc_id", "chunk_index", part.alias("text"))


def estimate_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))


def doc_of(chunk_ids: DataFrame, mapping: DataFrame) -> DataFrame:
    """(chunk_id, doc_id), null where the chunk is unknown."""
    return chunk_ids.select("chunk_id").join(mapping.select("chunk_id", "doc_id"), "chunk_id", "left")


def chunks_of(doc_ids: DataFrame, mapping: DataFrame) -> DataFrame:
    return mapping.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "chunk_index", "chunk_id")


def merge_results(results: DataFrame, mapping: DataFrame, how: str = "max") -> DataFrame:
    """(query_id, doc_id STRING, score) of chunk results (query_id, chunk_id, score): max, mean or sum; unknown chunks stand for themselves."""
    functions = {"max": F.max, "mean": F.avg, "sum": F.sum}
    if how not in functions:
        raise ValueError(f"unknown aggregation {how}")
    named = results.join(mapping.select("chunk_id", F.col("doc_id").cast("string").alias("_doc")), "chunk_id", "left")
    return named.groupBy("query_id", F.coalesce("_doc", "chunk_id").alias("doc_id")).agg(functions[how]("score").alias("score"))
