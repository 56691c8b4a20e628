"""The dense MaxSim kernel: Arrow batches of nested documents against blocks of queries, with a partial top-k.

Documents are nested (one row each), so scoring shuffles nothing. The queries are written once and read in blocks of about
QUERY_TOKENS tokens; the driver holds one block at a time. With a top_k every batch gives at most top_k rows a query, so
what is shuffled afterwards grows with batches and not with queries times documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenweft.session import attach, cut

#: Query tokens in a block.
QUERY_TOKENS = 50_000
#: Products that a worker holds at once: 32 MB.
CELLS = 4_000_000


def nest(tokens: DataFrame) -> DataFrame:
    """doc_matrix(doc_id, embeddings) from tokens(doc_id, tok_pos, embedding), in token order."""
    rows = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("tok_pos", "embedding"))).alias("rows"))
    return rows.select("doc_id", F.transform("rows", lambda r: r["embedding"]).alias("embeddings"))


def matrix(lists: pa.Array) -> np.ndarray:
    """Rows of a list array as a matrix in double precision."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(lists), -1)


class Queries:
    """Queries in one block: ids, first token of each, and for each token its position, weight and vector."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("query_id", "ascending"), ("q_pos", "ascending")]).combine_chunks()
        owner = table.column("query_id").to_numpy()
        self.ids, self.starts = np.unique(owner, return_index=True)
        self.owner, self.positions = owner, table.column("q_pos").to_numpy()
        self.weights = table.column("weight").to_numpy()
        vectors = table.column("embedding")
        self.vectors = matrix(vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) and vectors.num_chunks else vectors.combine_chunks())

    @cached_property
    def different(self) -> tuple[np.ndarray, np.ndarray]:
        """(the different vectors, the place of each token's among them): queries share tokens."""
        vectors, at = np.unique(self.vectors, axis=0, return_inverse=True)
        return vectors, at.ravel()


def query_rows(queries: DataFrame) -> DataFrame:
    return queries.select(
        F.col("query_id").cast("long").alias("query_id"), F.col("q_pos").cast("long").alias("q_pos"), F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight"),
        F.transform("embedding", lambda x: x.cast("double")).alias("embedding"),
    )


def against(docs: DataFrame, queries: DataFrame, score: Callable[[Queries, pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str, most: int | None = None) -> DataFrame:
    """score(queries, batch of docs) for every block of queries and every batch of docs; the tokens of a query are in one block.

    One block is one pass that joins the plan. Of several, each pass is written before the next block is read. With `most`, a batch
    is sliced so that its rows times the block's tokens stay below it.
    """
    spark = docs.sparkSession
    attach(spark)
    rows = query_rows(queries)
    few = rows.limit(QUERY_TOKENS + 1).toArrow()
    if not few.num_rows:
        return spark.createDataFrame([], schema)
    blocks, found = 1, None
    if few.num_rows > QUERY_TOKENS:
        rows, docs = cut(rows), cut(docs)
        blocks = -(-rows.count() // QUERY_TOKENS)
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    for i in range(blocks):
        part = rows.where(block == i).toArrow() if blocks > 1 else few  # about QUERY_TOKENS rows
        if not part.num_rows:
            continue
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            mine = Queries(shared.value)
            step = 1 << 31 if most is None else max(1, most // len(mine.vectors))
            for whole in batches:
                for s in range(0, whole.num_rows, step):
                    got = score(mine, whole.slice(s, step))
                    yield from [got] if isinstance(got, pa.RecordBatch) else got

        got = docs.mapInArrow(run, schema)
        if blocks > 1:
            got = cut(got)
            shared.unpersist()
        found = got if found is None else found.unionByName(got)
    return found


def _kind(docs: DataFrame) -> tuple[pa.DataType, str]:
    return (pa.string(), "string") if docs.schema["doc_id"].dataType.simpleString() == "string" else (pa.int64(), "long")


def order_of(names: pa.Array) -> np.ndarray:
    """The place of each name among the sorted ones."""
    order = pc.array_sort_indices(names).to_numpy()
    out = np.empty(len(order), int)
    out[order] = np.arange(len(order))
    return out


def _pieces(counts: np.ndarray, query_tokens: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents whose tokens, and whose best products with all query tokens, stay near CELLS / 512 and CELLS; one document at least."""
    ends, s = np.cumsum(counts), 0
    while s < len(counts):
        before = ends[s] - counts[s]
        e = int(np.searchsorted(ends, before + CELLS // 512, "right"))
        e = min(max(e, s + 1), s + max(1, CELLS // query_tokens))
        yield s, e
        s = e


def _piece(q: Queries, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The scores of all queries and some documents, by blocks of query tokens; a document of very many tokens meets fewer of them at once."""
    first, step = np.cumsum(counts) - counts, max(1, min(512, CELLS // len(flat)))
    vectors, at = q.different
    best = np.empty((len(vectors), len(counts)))
    for s in range(0, len(vectors), step):
        best[s : s + step] = np.maximum.reduceat(vectors[s : s + step] @ flat.T, first, axis=1)
    best = best[at]
    best *= q.weights[:, None]
    return np.add.reduceat(best, q.starts, axis=0)


def _best(scores: np.ndarray, at: np.ndarray, by_name: np.ndarray, top_k: int, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """The top_k columns of each row of (scores, document indexes at), by rounded score from the highest, then name."""
    if scores.shape[1] <= top_k:
        return scores, at
    order = np.array([np.lexsort((by_name[a], -r))[:top_k] for r, a in zip(np.round(scores, digits), at, strict=True)])
    return np.take_along_axis(scores, order, 1), np.take_along_axis(at, order, 1)


def _scored(q: Queries, batch: pa.RecordBatch, top_k: int | None, id_type: pa.DataType, digits: int) -> Iterator[pa.RecordBatch]:
    """The scores of a batch's documents with all queries, a piece of it at a time; with a top_k one result for the batch, else one for each piece."""

    def out(scores: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        ids = np.repeat(q.ids, scores.shape[1])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), names.take(pa.array(at.ravel())), pa.array(scores.ravel())], names=["query_id", "doc_id", "score"])

    lists = batch.column("embeddings")
    counts = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(int)
    some = np.flatnonzero(counts)
    names = batch.column("doc_id").take(pa.array(some)).cast(id_type)
    if not len(some):
        return
    if len(some) < len(counts):
        lists = lists.filter(pa.array(counts > 0))
    by_name = order_of(names) if top_k is not None else None
    held = None
    for s, e in _pieces(counts[some], len(q.vectors)):
        scores = _piece(q, matrix(lists.slice(s, e - s).flatten()), counts[some[s:e]])
        at = np.broadcast_to(np.arange(s, e), scores.shape)
        if top_k is None:
            yield out(scores, at)
            continue
        if held is not None:
            scores, at = np.concatenate([held[0], scores], 1), np.concatenate([held[1], at], 1)
        held = _best(scores, at, by_name, top_k, digits)
    if held is not None:
        yield out(*held)


def max_sim(docs: DataFrame, queries: DataFrame, top_k: int | None = None, digits: int = 6) -> DataFrame:
    """(query_id, doc_id, score) of every query and nested document, or a superset of each query's top_k of them."""
    id_type, name = _kind(docs)
    return against(docs.select("doc_id", "embeddings"), queries, lambda q, b: _scored(q, b, top_k, id_type, digits), f"query_id long, doc_id {name}, score double")


def best_by_token(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, q_pos, doc_id, best): each query token's best product in each nested document."""
    id_type, name = _kind(docs)

    def score(q: Queries, batch: pa.RecordBatch) -> pa.RecordBatch:
        flat = matrix(batch.column("embeddings").flatten())
        counts = pc.list_value_length(batch.column("embeddings")).to_numpy(zero_copy_only=False).astype(int)
        best = np.concatenate([np.maximum.reduceat(q.vectors[s : s + 512] @ flat.T, np.cumsum(counts) - counts, axis=1) for s in range(0, len(q.vectors), 512)])
        owner, d = np.repeat(np.arange(len(best)), len(counts)), pa.array(np.tile(np.arange(len(counts)), len(best)))
        return pa.RecordBatch.from_arrays([pa.array(q.owner[owner]), pa.array(q.positions[owner]), batch.column("doc_id").cast(id_type).take(d), pa.array(best.ravel())], names=["query_id", "q_pos", "doc_id", "best"])

    return against(docs.select("doc_id", "embeddings").where(F.size("embeddings") > 0), queries, score, f"query_id long, q_pos long, doc_id {name}, best double", most=2_000_000)


def all_pairs(tokens: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, q_pos, weight, doc_id, tok_pos, sim) of all query tokens and document tokens; the rows are the product of both, as asked."""
    id_type, name = _kind(tokens)

    def score(q: Queries, batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors = matrix(batch.column("embedding"))
        owner, d = np.repeat(np.arange(len(q.vectors)), len(vectors)), pa.array(np.tile(np.arange(len(vectors)), len(q.vectors)))
        return pa.RecordBatch.from_arrays(
            [pa.array(q.owner[owner]), pa.array(q.positions[owner]), pa.array(q.weights[owner]), batch.column("doc_id").cast(id_type).take(d), batch.column("tok_pos").take(d), pa.array((q.vectors @ vectors.T).ravel())],
            names=["query_id", "q_pos", "weight", "doc_id", "tok_pos", "sim"],
        )

    rows = tokens.select("doc_id", F.col("tok_pos").cast("int").alias("tok_pos"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return against(rows, queries, score, f"query_id long, q_pos long, weight double, doc_id {name}, tok_pos int, sim double", most=2_000_000)


def max_sim_pairs(pairs: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of the given (query_id, doc_id) pairs and no others.

    A document's candidate queries travel to it as one array of ids, so vectors are never moved for a pair and work grows with the pairs.
    """
    id_type, name = _kind(docs)
    asked = pairs.groupBy("doc_id").agg(F.collect_set(F.col("query_id").cast("long")).alias("asked"))

    def score(q: Queries, batch: pa.RecordBatch) -> pa.RecordBatch:
        lists, wanted = batch.column("embeddings"), batch.column("asked")
        n_d, n_q = (pc.list_value_length(x).fill_null(0).to_numpy(zero_copy_only=False).astype(int) for x in (lists, wanted))
        flat, ids = matrix(lists.flatten()) if n_d.sum() else np.empty((0, q.vectors.shape[1])), wanted.flatten().to_numpy()
        at = np.minimum(np.searchsorted(q.ids, ids), len(q.ids) - 1)
        here, sizes = q.ids[at] == ids, np.diff(np.append(q.starts, len(q.vectors)))
        out_q, out_d, out = [], [], []
        d_ends, q_ends = np.cumsum(n_d).tolist(), np.cumsum(n_q).tolist()
        for j, (d, e, k, f) in enumerate(zip(n_d.tolist(), d_ends, n_q.tolist(), q_ends, strict=True)):
            mine = at[f - k : f][here[f - k : f]]
            if not d or not len(mine):
                continue
            lengths = sizes[mine]
            first = np.cumsum(lengths) - lengths
            rows = np.repeat(q.starts[mine] - first, lengths) + np.arange(int(lengths.sum()))
            best = (q.vectors[rows] @ flat[e - d : e].T).max(1) * q.weights[rows]
            out_q.append(q.ids[mine])
            out_d.append(np.full(len(mine), j))
            out.append(np.add.reduceat(best, first))
        joined = [np.concatenate(x) if x else np.empty(0, t) for x, t in ((out_q, np.int64), (out_d, np.int64), (out, float))]
        return pa.RecordBatch.from_arrays([pa.array(joined[0]), batch.column("doc_id").cast(id_type).take(pa.array(joined[1])), pa.array(joined[2])], names=["query_id", "doc_id", "score"])

    return against(docs.select("doc_id", "embeddings").join(asked, "doc_id"), queries, score, f"query_id long, doc_id {name}, score double")


def nearest(tokens: DataFrame, queries: DataFrame, k: int, space: str, digits: int) -> DataFrame:
    """(query_id, q_pos, weight, doc_id, tok_pos, near): a superset of the k nearest tokens of each query token, k of each batch."""
    id_type, name = _kind(tokens)

    def score(q: Queries, batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors, names = matrix(batch.column("embedding")), batch.column("doc_id").cast(id_type)
        place = batch.column("tok_pos").to_numpy()
        by_name = np.empty(len(place), int)
        by_name[np.lexsort((place, pc.rank(names, tiebreaker="dense").to_numpy()))] = np.arange(len(place))
        at, values, n = [], [], min(k, len(place))
        for s in range(0, len(q.vectors), 256):
            part = q.vectors[s : s + 256]
            if space == "cosine":
                near = part @ vectors.T
            else:
                near = np.stack([-((v - vectors) ** 2).sum(1) for v in part])
            near = np.round(near, digits)
            if n < len(place):
                least = np.partition(near, len(place) - n, axis=1)[:, len(place) - n]
                for row, low in zip(near, least.tolist(), strict=True):
                    some = np.flatnonzero(row >= low)
                    some = some[np.lexsort((by_name[some], -row[some]))[:n]]
                    at.append(some)
                    values.append(row[some])
            else:
                at += [np.arange(n)] * len(part)
                values += list(near)
        owner = np.repeat(np.arange(len(q.vectors)), n)
        d = pa.array(np.concatenate(at) if at else np.empty(0, int))
        return pa.RecordBatch.from_arrays(
            [pa.array(q.owner[owner]), pa.array(q.positions[owner]), pa.array(q.weights[owner]), names.take(d), pa.array(place.astype(np.int32)).take(d), pa.array(np.concatenate(values) if values else np.empty(0))],
            names=["query_id", "q_pos", "weight", "doc_id", "tok_pos", "near"],
        )

    rows = tokens.select("doc_id", F.col("tok_pos").cast("int").alias("tok_pos"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return against(rows, queries, score, f"query_id long, q_pos long, weight double, doc_id {name}, tok_pos int, near double")


def top(scores: DataFrame, k: int | None, digits: int = 6) -> DataFrame:
    """(query_id, rank, doc_id, score): by rounded score from the highest, then doc_id."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id"))
    ranked = scores.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(w))
    if k is not None:
        ranked = ranked.where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "doc_id", "score")
