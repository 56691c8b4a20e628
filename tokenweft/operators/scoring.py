"""Late-interaction scoring: every query token's best similarity in a document, summed; fusion, ranking, explanation.

tokens: (doc_id, tok_pos, embedding); queries: (query_id, q_pos, embedding[, weight]). Query sets are the small side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenweft.functions.vectors import rounded
from tokenweft.operators.kernel import all_pairs, max_sim, nest, top
from tokenweft.session import small

#: Fixed value: tokens that stand for no word.
SPECIAL = ("[CLS]", "[SEP]", "[PAD]", "[MASK]", "[Q]", "[D]")
OUT_OF_RANGE = "[OUT_OF_RANGE]"
DIGITS = 9


def weighted(queries: DataFrame) -> DataFrame:
    return queries if "weight" in queries.columns else queries.withColumn("weight", F.lit(1.0))


def similarities(queries: DataFrame, tokens: DataFrame) -> DataFrame:
    """(query_id, q_pos, weight, doc_id, tok_pos, sim) of all query tokens and document tokens."""
    return all_pairs(tokens, weighted(queries))


def scores(queries: DataFrame, tokens: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of all queries and documents, by the dense kernel."""
    return max_sim(nest(tokens), weighted(queries))


def scores_by_join(queries: DataFrame, tokens: DataFrame) -> DataFrame:
    """The same from the similarities as rows: two aggregates, both summed up before they are shuffled."""
    best = similarities(queries, tokens).groupBy("query_id", "doc_id", "q_pos", "weight").agg(F.max("sim").alias("best"))
    return best.groupBy("query_id", "doc_id").agg(F.sum(F.col("best") * F.col("weight")).alias("score"))


def batch(queries: DataFrame, tokens: DataFrame, order: DataFrame) -> DataFrame:
    """(query_id, doc_pos, doc_id, score) in the order of `order` (doc_id, doc_pos)."""
    return order.join(scores(queries, tokens), "doc_id").select("query_id", "doc_pos", "doc_id", "score")


def rank(queries: DataFrame, tokens: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score), all documents or the best k, by the dense kernel."""
    return top(max_sim(nest(tokens), weighted(queries), k), k)


def explain(queries: DataFrame, tokens: DataFrame, query_names: DataFrame, token_names: DataFrame) -> DataFrame:
    """(query_id, doc_id, query_index, query_token, doc_index, doc_token, similarity, score).

    The best document token of each query token (the first of equal ones). Only query tokens with a name are listed; the score sums
    all of them. A document index without a name reads OUT_OF_RANGE.
    """
    sims = similarities(queries, tokens).withColumn("sim", rounded("sim", DIGITS))
    best = sims.groupBy("query_id", "doc_id", "q_pos", "weight").agg(F.max(F.struct("sim", (-F.col("tok_pos")).alias("neg"))).alias("b"))
    w = Window.partitionBy("query_id", "doc_id")
    rows = best.select("query_id", "doc_id", "q_pos", F.col("b.sim").alias("similarity"), (-F.col("b.neg")).alias("doc_index"), F.sum(F.col("b.sim") * F.col("weight")).over(w).alias("score"))
    named = rows.join(small(query_names.select("query_id", "q_pos", F.col("token").alias("query_token"))), ["query_id", "q_pos"])
    names = token_names.select("doc_id", F.col("tok_pos").alias("doc_index"), F.col("token").alias("doc_token"))
    return named.join(names, ["doc_id", "doc_index"], "left").select(
        "query_id", "doc_id", F.col("q_pos").alias("query_index"), "query_token", "doc_index", F.coalesce("doc_token", F.lit(OUT_OF_RANGE)).alias("doc_token"), "similarity", "score",
    )


def _cell(token: str) -> Column:
    return F.rpad(F.substring(token, 1, 20), 20, " ")


def _number(x: Column) -> Column:
    """The shortest decimal text of a number, as 0.95, 1.0 or 3.0e-4."""
    return F.lower(x.cast("string"))


def format_explanation(explained: DataFrame, skip_special: bool = True, min_similarity: float = 0.0, top_k: int | None = None) -> DataFrame:
    """(query_id, doc_id, report): the score, a blank line, a line of column names, a rule, and a line for each match from the most similar down."""
    shown = explained.withColumn("_shown", (F.lit(not skip_special) | ~F.col("query_token").isin(*SPECIAL)) & (F.col("similarity") >= min_similarity))
    line = F.concat(_cell("query_token"), F.lit(" -> "), _cell("doc_token"), F.lit(" "), _number(rounded("similarity", 4)))
    entry = F.when(F.col("_shown"), F.struct((-F.col("similarity")).alias("s"), F.col("query_index").alias("i"), line.alias("line")))
    lines = shown.groupBy("query_id", "doc_id").agg(F.first("score").alias("score"), F.array_sort(F.collect_list(entry)).alias("lines"))
    some = F.slice("lines", 1, top_k) if top_k is not None else F.col("lines")
    head = F.concat(F.lit("Score: "), _number(rounded("score", 2)), F.lit(f"\n\n{'Query Token':20} -> {'Doc Token':20} Similarity\n{'-' * 60}\n"))
    text = F.concat(head, F.array_join(F.transform(some, lambda x: x["line"]), "\n"))
    return lines.select("query_id", "doc_id", text.alias("report"))


def normalize(results: DataFrame, n: int) -> DataFrame:
    """Scores over the query length."""
    if n <= 0:
        raise ValueError("the query length must be positive")
    return results.withColumn("score", F.col("score") / n)


def normalize_minmax(results: DataFrame) -> DataFrame:
    """Scores of each query scaled to 0..1; where all are equal, 1."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return results.withColumn("score", F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)))


def fuse(scored: DataFrame, strategy: str = "max", weights: DataFrame | None = None) -> DataFrame:
    """(doc_id, score) over several queries' (query_id, doc_id, score): max, avg, or weighted by (query_id, w), not normalised.

    Every query must have a weight and every weight a query, else a ValueError is raised.
    """
    if strategy == "weighted":
        if weights is None:
            raise ValueError("weighted fusion needs weights")
        asked, given = scored.select("query_id").distinct(), weights.select("query_id")
        if not asked.join(small(given), "query_id", "left_anti").isEmpty() or not given.join(asked, "query_id", "left_anti").isEmpty():
            raise ValueError("weights and queries differ")
        return scored.join(small(weights), "query_id").groupBy("doc_id").agg(F.sum(F.col("score") * F.col("w")).alias("score"))
    how = {"max": F.max, "avg": F.avg}
    if strategy not in how:
        raise ValueError(f"unknown strategy {strategy}")
    return scored.groupBy("doc_id").agg(how[strategy]("score").alias("score"))


def best(fused: DataFrame, k: int | None = None) -> DataFrame:
    """(rank, doc_id, score) of one list; with a k only the best k meet in the last task."""
    found = fused.withColumn("score", F.round("score", 6))
    if k is not None:
        found = found.orderBy(F.col("score").desc(), "doc_id").limit(k)
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "doc_id"))).select("rank", "doc_id", "score")


def reciprocal_rank_fusion(lists: DataFrame, k: int = 60) -> DataFrame:
    """(doc_id, score) from ranked lists (list_id, rank, doc_id): the sum of 1 / (k + rank); scores of the lists are not used."""
    return lists.groupBy("doc_id").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"))
