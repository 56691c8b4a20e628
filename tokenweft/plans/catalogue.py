"""Registered queries of the retrieval engine, each with SQL that a second engine runs on the same tables.

Data: the vectors of `embeddings`, five to a document, are its tokens; documents whose id is divisible by 50 are the queries;
centroids are the first 16 vectors by a hash of their id (a documented, bounded sample; all rows are indexed).
Similarities are rounded to 9 digits before a best one is chosen, scores to 6 digits before they are ranked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenweft.functions.quantize import quantize, ratio
from tokenweft import api
from tokenweft.functions.vectors import norm, project, text, unit
from tokenweft.operators import chunk, compression, encode, kmeans, retrieve, scoring
from tokenweft.operators.indexes import CentroidIndex, CompressedIndex, FlatIndex, nearest_tokens, postings_of, probed
from tokenweft.operators.kernel import top
from tokenweft.session import cut, work_dir
from tokenweft.sources.tables import query_table, table, token_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CENTROIDS, DIM = 16, 64


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def tokens_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(table(spark, sf_dir, "embeddings"))


def inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tokens = tokens_of(spark, sf_dir)
    return query_table(tokens), tokens


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.seeds(table(spark, sf_dir, "embeddings"), CENTROIDS)


TOK = "tok AS (SELECT vec_id // 5 AS doc_id, vec_id % 5 AS tok_pos, embedding::DOUBLE[] AS e FROM embeddings)"
Q = "q AS (SELECT doc_id AS query_id, tok_pos AS q_pos, e AS q FROM tok WHERE doc_id % 50 = 0)"
SIM = "sim AS (SELECT query_id, q_pos, doc_id, tok_pos, list_inner_product(q, e) AS s FROM q, tok)"
SCORE = "score AS (SELECT query_id, doc_id, sum(b) AS score FROM (SELECT query_id, doc_id, q_pos, max(s) AS b FROM sim GROUP BY ALL) GROUP BY ALL)"
BASE = f"WITH {TOK}, {Q}, {SIM}, {SCORE}"
CENT = f"cent AS (SELECT (row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) - 1)::INT AS centroid_id, embedding::DOUBLE[] AS c FROM embeddings ORDER BY md5(vec_id::VARCHAR), vec_id LIMIT {CENTROIDS})"
RANK = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id)::INT"
SUB = "list_transform(list_zip({a}, {b}), lambda p: p[1] - p[2])"


def ranked_sql(head: str, scores: str, k: int | None) -> str:
    limit = f" WHERE rank <= {k}" if k else ""
    return f"{head} SELECT * FROM (SELECT query_id, {RANK} AS rank, doc_id, round(score, 6) AS score FROM {scores}){limit}"


def vec(x: str) -> str:
    """A vector as text, as functions.vectors.text writes it."""
    return f"array_to_string(list_transform({x}, lambda v: printf('%.6f', CASE WHEN round(v, 6) = 0 THEN 0.0 ELSE round(v, 6) END)), ',')"


# scoring


@registered(ranked_sql(BASE, "score", 10))
def maxsim_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.rank(*inputs(spark, sf_dir), 10)


@registered(f"{BASE} SELECT query_id, doc_id, round(score, 6) AS score FROM score")
def maxsim_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scores(*inputs(spark, sf_dir)).withColumn("score", F.round("score", 6))


@registered(f"{BASE} SELECT query_id, doc_id AS doc_pos, doc_id, round(score, 6) AS score FROM score")
def maxsim_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, tokens = inputs(spark, sf_dir)
    order = tokens.select("doc_id", F.col("doc_id").alias("doc_pos")).distinct()
    return scoring.batch(queries, tokens, order).withColumn("score", F.round("score", 6))


@registered(ranked_sql(BASE, "score", None))
def rank_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.rank(*inputs(spark, sf_dir))


@registered(f"WITH {TOK}, {Q}, {SIM} SELECT query_id, q_pos, doc_id, tok_pos, round(s, 6) AS sim FROM sim")
def similarity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sims = scoring.similarities(*inputs(spark, sf_dir))
    return sims.select("query_id", F.col("q_pos").cast("long").alias("q_pos"), "doc_id", F.col("tok_pos").cast("long").alias("tok_pos"), F.round("sim", 6).alias("sim"))


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, tokens = inputs(spark, sf_dir)
    names = F.when(F.col("q_pos") == 0, "[CLS]").otherwise(F.concat(F.lit("word"), F.col("q_pos").cast("string")))
    doc_names = tokens.where("tok_pos < 4").select("doc_id", "tok_pos", F.concat(F.lit("a rather long token "), F.col("tok_pos").cast("string")).alias("token"))
    return scoring.explain(queries, tokens, queries.select("query_id", "q_pos", names.alias("token")), doc_names)


EXPLAIN = f"""WITH {TOK}, {Q}, {SIM}, best AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, q_pos ORDER BY round(s, 9) DESC, tok_pos) AS n FROM sim),
ex AS (SELECT query_id, doc_id, q_pos AS query_index, CASE WHEN q_pos = 0 THEN '[CLS]' ELSE 'word' || q_pos END AS query_token, tok_pos AS doc_index,
CASE WHEN tok_pos < 4 THEN 'a rather long token ' || tok_pos ELSE '[OUT_OF_RANGE]' END AS doc_token, round(s, 9) AS similarity, sum(round(s, 9)) OVER (PARTITION BY query_id, doc_id) AS score FROM best WHERE n = 1)"""


@registered(f"{EXPLAIN} SELECT query_id, doc_id, query_index, query_token, doc_index, doc_token, round(similarity, 6) AS similarity, round(score, 6) AS score FROM ex")
def explain_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _explained(spark, sf_dir)
    return found.select("query_id", "doc_id", F.col("query_index").cast("long").alias("query_index"), "query_token", F.col("doc_index").cast("long").alias("doc_index"), "doc_token", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"))


_NUMBER = "CASE WHEN {v} > 0 AND {v} < 0.001 THEN round({v} * 10000)::INT || '.0e-4' ELSE {v}::VARCHAR END"


@registered(f"""{EXPLAIN}, lines AS (SELECT *, rpad(substr(query_token, 1, 20), 20, ' ') || ' -> ' || rpad(substr(doc_token, 1, 20), 20, ' ') || ' ' || {_NUMBER.format(v='round(similarity, 4)')} AS line FROM ex),
heads AS (SELECT DISTINCT query_id, doc_id, 'Score: ' || {_NUMBER.format(v='round(score, 2)')} || chr(10) || chr(10) || rpad('Query Token', 20, ' ') || ' -> ' || rpad('Doc Token', 20, ' ') || ' Similarity' || chr(10) || repeat('-', 60) || chr(10) AS head FROM ex),
body AS (SELECT query_id, doc_id, string_agg(line, chr(10) ORDER BY similarity DESC, query_index) AS body FROM lines WHERE query_token <> '[CLS]' AND similarity >= 0 GROUP BY ALL)
SELECT query_id, doc_id, head || coalesce(body, '') AS report FROM heads LEFT JOIN body USING (query_id, doc_id)""")
def explain_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.format_explanation(_explained(spark, sf_dir))


@registered(f"{BASE} SELECT query_id, doc_id, round(score / 5, 6) AS score FROM score")
def normalize_by_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.normalize(scoring.scores(*inputs(spark, sf_dir)), 5).withColumn("score", F.round("score", 6))


@registered(f"{BASE}, m AS (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM score) SELECT query_id, doc_id, round(CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END, 6) AS score FROM m")
def normalize_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.normalize_minmax(scoring.scores(*inputs(spark, sf_dir))).withColumn("score", F.round("score", 6))


@registered(f"{BASE} SELECT doc_id, round(max(score), 6) AS score FROM score GROUP BY ALL")
def fuse_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.fuse(scoring.scores(*inputs(spark, sf_dir)), "max").withColumn("score", F.round("score", 6))


@registered(f"{BASE} SELECT doc_id, round(avg(score), 6) AS score FROM score GROUP BY ALL")
def fuse_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.fuse(scoring.scores(*inputs(spark, sf_dir)), "avg").withColumn("score", F.round("score", 6))


@registered(f"{BASE} SELECT doc_id, round(sum(score / (1 + query_id)), 6) AS score FROM score GROUP BY ALL")
def fuse_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, tokens = inputs(spark, sf_dir)
    weights = queries.select("query_id", (F.lit(1.0) / (1 + F.col("query_id"))).alias("w")).distinct()
    return scoring.fuse(scoring.scores(queries, tokens), "weighted", weights).withColumn("score", F.round("score", 6))


@registered(f"{BASE}, f AS (SELECT doc_id, avg(score) AS score FROM score GROUP BY ALL) SELECT row_number() OVER (ORDER BY round(score, 6) DESC, doc_id)::INT AS rank, doc_id, round(score, 6) AS score FROM f ORDER BY rank LIMIT 100")
def fuse_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.best(scoring.fuse(scoring.scores(*inputs(spark, sf_dir)), "avg"), 100)


@registered(f"{BASE}, r AS (SELECT {RANK} AS rank, doc_id FROM score) SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM r GROUP BY ALL")
def rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = scoring.rank(*inputs(spark, sf_dir))
    return scoring.reciprocal_rank_fusion(ranked.withColumnRenamed("query_id", "list_id")).withColumn("score", F.round("score", 6))


# encoding

DTOK = r"dt AS (SELECT doc_id, list_slice(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+|[^a-z0-9\s]'), 1, {n}) AS t FROM documents)"
MARKED = "mk AS (SELECT doc_id, list_concat(list_concat({head}, t), ['[SEP]']) AS t FROM dt)"
PLAIN = f"WITH {DTOK.format(n=180)}, tk AS (SELECT doc_id, unnest(range(len(t)))::INT AS tok_pos, unnest(t) AS token FROM dt)"
WHOLE = r"WITH dt AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+|[^a-z0-9\s]') AS t FROM documents), tk AS (SELECT doc_id, unnest(range(len(t)))::INT AS tok_pos, unnest(t) AS token FROM dt)"
HASH16 = "list_transform(range(16), lambda i: (('0x' || substr(md5({t}), (i * 2 + 1)::INT, 2))::INT - 127.5::DOUBLE) / 127.5::DOUBLE)"


@registered(f"{PLAIN} SELECT doc_id, tok_pos, token FROM tk")
def tokenize_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.plain_tokens(table(spark, sf_dir, "documents"))


@registered(f"WITH {DTOK.format(n=29).replace('doc_id,', 'item_id AS doc_id,').replace('documents', 'benchmark')}, {MARKED.format(head=chr(91) + chr(39) + '[CLS]' + chr(39) + ',' + chr(39) + '[Q]' + chr(39) + ']')} SELECT doc_id AS query_id, unnest(range(len(t)))::INT AS tok_pos, unnest(t) AS token FROM mk")
def tokenize_query_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.tokenize(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id"), "query", key="query_id")


SKIP = ", ".join("'" + c.replace("'", "''") + "'" for c in encode.SKIPLIST)


@registered(f"{WHOLE} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY tok_pos) - 1)::INT AS tok_pos, token FROM tk WHERE token NOT IN ({SKIP})")
def skiplist_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.skip_punctuation(encode.plain_tokens(table(spark, sf_dir, "documents"), None))


@registered(f"{WHOLE}, d AS (SELECT DISTINCT token FROM tk), r AS (SELECT token, {HASH16.format(t='token')} AS v FROM d), u AS (SELECT token, list_transform(v, lambda x: x / (sqrt(list_inner_product(v, v)) + 1e-9)) AS v FROM r) SELECT token, {vec('v')} AS vector FROM u")
def encode_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = encode.plain_tokens(table(spark, sf_dir, "documents"), None).select("token").distinct()
    return encode.HashEncoder().vectors(tokens).select("token", text("embedding").alias("vector"))


@registered(f"""WITH {DTOK.format(n=29).replace('doc_id,', 'item_id AS doc_id,').replace('documents', 'benchmark')}, mk AS (SELECT doc_id, list_concat(list_concat(['[CLS]', '[Q]'], t), ['[SEP]']) AS t FROM dt),
a AS (SELECT doc_id AS query_id, unnest(range(len(t)))::INT AS q_pos, unnest(t) AS token, 1.0::DOUBLE AS weight FROM mk UNION ALL SELECT doc_id, len(t)::INT, '[MASK]', (32 - len(t))::DOUBLE FROM mk WHERE len(t) < 32),
r AS (SELECT *, {HASH16.format(t='token')} AS v FROM a) SELECT query_id, q_pos, token, weight, {vec('list_transform(v, lambda x: x / (sqrt(list_inner_product(v, v)) + 1e-9))')} AS vector FROM r""")
def encode_query_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")
    return encode.encode_queries(queries, encode.HashEncoder()).select("query_id", "q_pos", "token", "weight", text("embedding").alias("vector"))


MATRIX = [[((7 * i + 3 * j) % 11 - 5) / 10 for j in range(4)] for i in range(DIM)]
PROJECTED = "[" + ", ".join("list_inner_product(e, [" + ", ".join(f"{r[j]}::DOUBLE" for r in MATRIX) + "])" for j in range(4)) + "]"


@registered(f"WITH {TOK}, p AS (SELECT doc_id, tok_pos, {PROJECTED} AS v FROM tok) SELECT doc_id, tok_pos, {vec('list_transform(v, lambda x: x / (sqrt(list_inner_product(v, v)) + 1e-9))')} AS vector FROM p")
def project_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_of(spark, sf_dir).select("doc_id", F.col("tok_pos").cast("long").alias("tok_pos"), text(unit(project("embedding", MATRIX))).alias("vector"))


_KEEP = "".join(
    f", k{i} AS (SELECT *, " + ("true" if i == 0 else " AND ".join(f"NOT (k{j} AND list_inner_product(v[{i + 1}], v[{j + 1}]) > 0.3)" for j in range(i))) + f" AS k{i} FROM {'n' if i == 0 else f'k{i - 1}'})" for i in range(5)
)


@registered(f"WITH {TOK}, n AS (SELECT doc_id, list(e ORDER BY tok_pos) AS v FROM tok GROUP BY doc_id){_KEEP} SELECT doc_id, unnest([0, 1, 2, 3, 4])::INT AS tok_pos FROM k4 WHERE false UNION ALL SELECT doc_id, p.pos::INT FROM k4, (VALUES (0), (1), (2), (3), (4)) p(pos) WHERE [k0, k1, k2, k3, k4][pos + 1]")
def dedup_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.drop_near_duplicates(tokens_of(spark, sf_dir), above=0.3).select("doc_id", "tok_pos")


# k-means


def _near_sql(metric: str) -> str:
    by = "round(-list_inner_product(e, c), 9)" if metric == "cosine" else f"round(list_inner_product({SUB.format(a='e', b='c')}, {SUB.format(a='e', b='c')}), 9)"
    return f"near AS (SELECT doc_id, tok_pos, e, centroid_id, c FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, tok_pos ORDER BY {by}, centroid_id) AS n FROM tok, cent) WHERE n = 1)"


@registered(f"WITH {TOK}, {CENT}, {_near_sql('cosine')} SELECT doc_id, tok_pos, centroid_id FROM near")
def assign_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.assign(tokens_of(spark, sf_dir), book(spark, sf_dir)).select("doc_id", F.col("tok_pos").cast("long").alias("tok_pos"), "centroid_id")


@registered(f"WITH {TOK}, {CENT}, {_near_sql('l2')} SELECT doc_id, tok_pos, centroid_id FROM near")
def assign_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.assign(tokens_of(spark, sf_dir), book(spark, sf_dir), "l2").select("doc_id", F.col("tok_pos").cast("long").alias("tok_pos"), "centroid_id")


@registered(f"WITH {CENT}, h AS (SELECT centroid_id, list_transform(c, lambda x: x * 3) AS c FROM cent) SELECT centroid_id, {vec('list_transform(c, lambda x: x / greatest(sqrt(list_inner_product(c, c)), 1e-9))')} AS vector FROM h")
def normalize_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    tripled = book(spark, sf_dir).withColumn("vector", F.transform("vector", lambda x: x.cast("double") * 3))
    return kmeans.normalized(tripled).select("centroid_id", text("vector").alias("vector"))


def _lloyd_sql(step: int, source: str) -> str:
    d = SUB.format(a="e", b="c")
    return f"""a{step} AS (SELECT centroid_id, e FROM (SELECT centroid_id, e, row_number() OVER (PARTITION BY doc_id, tok_pos ORDER BY round(list_inner_product({d}, {d}), 9), centroid_id) AS n FROM tok, {source}) WHERE n = 1),
x{step} AS (SELECT centroid_id, unnest(range(len(e))) AS i, unnest(e) AS x FROM a{step}), m{step} AS (SELECT centroid_id, i, avg(x) AS m FROM x{step} GROUP BY ALL),
v{step} AS (SELECT centroid_id, list(m ORDER BY i) AS v FROM m{step} GROUP BY ALL), c{step} AS (SELECT centroid_id, coalesce(v, c) AS c FROM {source} LEFT JOIN v{step} USING (centroid_id))"""


@registered(f"WITH {TOK}, {CENT}, {_lloyd_sql(1, 'cent')}, {_lloyd_sql(2, 'c1')} SELECT centroid_id, {vec('c')} AS vector FROM c2")
def kmeans_lloyd2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.lloyd(tokens_of(spark, sf_dir), book(spark, sf_dir), 2).select("centroid_id", text("vector").alias("vector"))


@registered()
def kmeans_mllib(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.train(tokens_of(spark, sf_dir), CENTROIDS).select("centroid_id", text("vector").alias("vector"))


# compression

RES = f"WITH {TOK}, {CENT}, {_near_sql('l2')}, res AS (SELECT doc_id, tok_pos, e, centroid_id, c, {SUB.format(a='e', b='c')} AS r FROM near)"


def _codes_sql(bits: int) -> str:
    if bits == 1:
        return "list_transform(r, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)"
    return f"list_transform(r, lambda x: round((greatest(-1.0, least(1.0, x)) + 1.0) * {(1 << bits) / 2 - 0.5})::INT)"


def _values_sql(bits: int) -> str:
    return f"list_transform({_codes_sql(bits)}, lambda x: x * 2.0 - 1.0)" if bits == 1 else f"list_transform({_codes_sql(bits)}, lambda x: x / {(1 << bits) / 2 - 0.5}::DOUBLE - 1.0)"


def _add_compression(bits: int) -> None:
    def compress(spark: SparkSession, sf_dir: str) -> DataFrame:
        coded = compression.residuals(tokens_of(spark, sf_dir), book(spark, sf_dir))
        return coded.select("doc_id", F.col("tok_pos").cast("long").alias("tok_pos"), "centroid_id", F.array_join(quantize("residual", bits).cast("array<string>"), ",").alias("codes"))

    def decompress(spark: SparkSession, sf_dir: str) -> DataFrame:
        centroids = book(spark, sf_dir)
        back = compression.decompress(compression.compress(tokens_of(spark, sf_dir), centroids, bits), centroids, bits)
        return back.select("doc_id", F.col("tok_pos").cast("long").alias("tok_pos"), text("embedding").alias("vector"))

    compress.__name__, decompress.__name__ = f"compress_{bits}bit", f"decompress_{bits}bit"
    registered(f"{RES} SELECT doc_id, tok_pos, centroid_id, array_to_string({_codes_sql(bits)}, ',') AS codes FROM res")(compress)
    plus = f"list_transform(list_zip(c, {_values_sql(bits)}), lambda p: p[1] + p[2])"
    registered(f"{RES} SELECT doc_id, tok_pos, {vec(plus)} AS vector FROM res")(decompress)


for _bits in (8, 4, 2, 1):
    _add_compression(_bits)


@registered(f"{RES}, k AS (SELECT doc_id, tok_pos, {_codes_sql(1)} AS b FROM res) SELECT doc_id, tok_pos, array_to_string(list_transform(range(8), lambda i: printf('%02X', (b[i*8+1]*128 + b[i*8+2]*64 + b[i*8+3]*32 + b[i*8+4]*16 + b[i*8+5]*8 + b[i*8+6]*4 + b[i*8+7]*2 + b[i*8+8])::INT)), '') AS packed FROM k")
def compress_1bit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.compress(tokens_of(spark, sf_dir), book(spark, sf_dir), 1).select("doc_id", F.col("tok_pos").cast("long").alias("tok_pos"), F.hex("codes").alias("packed"))


BACK8 = f"back AS (SELECT doc_id, tok_pos, list_transform(list_zip(c, {_values_sql(8)}), lambda p: p[1] + p[2]) AS e FROM res)"


@registered(f"{RES}, {BACK8}, {Q} SELECT query_id, back.doc_id, q_pos, round(max(list_inner_product(q, back.e)), 6) AS best FROM back, q GROUP BY ALL")
def approx_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, tokens = inputs(spark, sf_dir)
    centroids = book(spark, sf_dir)
    found = compression.approximate_similarity(queries, compression.compress(tokens, centroids), centroids)
    return found.select("query_id", "doc_id", F.col("q_pos").cast("long").alias("q_pos"), F.round("best", 6).alias("best"))


@registered("SELECT bits::INT AS bits, dim::INT AS dim, round(dim * 4.0 / (2 + dim // (8 // bits)), 2)::DOUBLE AS ratio FROM (VALUES (1), (2), (4), (8)) b(bits), (SELECT DISTINCT len(embedding) AS dim FROM embeddings UNION SELECT 128)")
def compression_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = [r[0] for r in table(spark, sf_dir, "embeddings").select(F.size("embedding")).distinct().collect()]
    return spark.createDataFrame([(b, d, ratio(d, b)) for b in (1, 2, 4, 8) for d in sorted({*dims, 128})], "bits int, dim int, ratio double")


# flat index


def flat(spark: SparkSession, sf_dir: str, space: str = "cosine") -> FlatIndex:
    return FlatIndex.new(spark, DIM, space).add(tokens_of(spark, sf_dir))


def _nn(k: int, by: str = "round(s, 9) DESC") -> str:
    return f"nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, q_pos ORDER BY {by}, doc_id, tok_pos) AS n FROM sim) WHERE n <= {k})"


@registered(f"WITH {TOK}, {Q}, {SIM}, {_nn(50)} SELECT query_id, doc_id, count(*)::DOUBLE AS hits FROM nn GROUP BY ALL")
def flat_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spark, sf_dir).candidates(query_table(tokens_of(spark, sf_dir)), 50)


@registered(f"WITH {TOK}, {Q}, {SIM}, {_nn(10)} SELECT query_id, q_pos, doc_id, tok_pos, round(s, 6) AS near FROM nn")
def token_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, tokens = inputs(spark, sf_dir)
    found = nearest_tokens(tokens, queries, 10)
    return found.select("query_id", F.col("q_pos").cast("long").alias("q_pos"), "doc_id", F.col("tok_pos").cast("long").alias("tok_pos"), F.round("near", 6).alias("near"))


@registered(ranked_sql(f"{BASE}, {_nn(50)}, cs AS (SELECT * FROM score SEMI JOIN nn USING (query_id, doc_id))", "cs", 10))
def search_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spark, sf_dir).search(query_table(tokens_of(spark, sf_dir)))


@registered(ranked_sql(f"WITH {TOK}, {Q}, {SIM}, {_nn(50)}, h AS (SELECT query_id, doc_id, count(*)::DOUBLE AS score FROM nn GROUP BY ALL)", "h", 10))
def search_flat_no_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spark, sf_dir).search(query_table(tokens_of(spark, sf_dir)), rerank=False)


_D = SUB.format(a="q", b="e")


@registered(ranked_sql(f"{BASE}, l2 AS (SELECT query_id, q_pos, doc_id, tok_pos, list_inner_product({_D}, {_D}) AS d FROM q, tok), nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, q_pos ORDER BY round(d, 9), doc_id, tok_pos) AS n FROM l2) WHERE n <= 20), cs AS (SELECT * FROM score SEMI JOIN nn USING (query_id, doc_id))", "cs", 10))
def search_l2_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spark, sf_dir, "l2").search(query_table(tokens_of(spark, sf_dir)), candidates_per_token=20)


def _by_doc(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.round(F.sum(F.get("embedding", F.lit(0)).cast("double")), 6).alias("total"))


_ODD = "new AS (SELECT doc_id + 1 AS doc_id, tok_pos, list_transform(e, lambda x: -x) AS e FROM tok WHERE tok_pos < 3)"
_TOTAL = "count(*) AS n_tokens, round(sum(e[1]), 6) AS total"


def _shifted(tokens: DataFrame) -> DataFrame:
    """A second batch: every document's first three tokens, negated, under the next id, so that all but one replace another."""
    return tokens.where("tok_pos < 3").select((F.col("doc_id") + 1).alias("doc_id"), "tok_pos", F.transform("embedding", lambda x: -x).alias("embedding"))


@registered(f"WITH {TOK}, {_ODD}, u AS (SELECT * FROM tok ANTI JOIN new USING (doc_id) UNION ALL SELECT * FROM new) SELECT doc_id, {_TOTAL} FROM u GROUP BY ALL")
def index_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_doc(flat(spark, sf_dir).add(_shifted(tokens_of(spark, sf_dir))).tokens)


@registered(f"WITH {TOK} SELECT doc_id, {_TOTAL} FROM tok WHERE doc_id NOT IN (SELECT label FROM embeddings WHERE label IS NOT NULL) GROUP BY ALL")
def index_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "embeddings").where("label is not null").select(F.col("label").cast("long").alias("doc_id"))
    return _by_doc(flat(spark, sf_dir).delete(gone).tokens)


@registered(f"WITH {TOK}, {_ODD}, s AS (SELECT * FROM new SEMI JOIN tok USING (doc_id)), u AS (SELECT * FROM tok ANTI JOIN s USING (doc_id) UNION ALL SELECT * FROM s) SELECT doc_id, {_TOTAL} FROM u GROUP BY ALL")
def index_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = flat(spark, sf_dir)
    fresh = _shifted(tokens_of(spark, sf_dir)).join(index.doc_ids(), "doc_id", "left_semi")
    return _by_doc(index.update(fresh).tokens)


@registered(f"WITH {TOK}, a AS (SELECT DISTINCT vec_id AS doc_id FROM embeddings) SELECT doc_id, doc_id IN (SELECT doc_id FROM tok) AS present FROM a")
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return flat(spark, sf_dir).lookup(asked)


@registered(f"WITH {TOK} SELECT count(DISTINCT doc_id) AS size, count(*) AS token_count FROM tok")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spark, sf_dir).stats()


# centroid index

POST = f"WITH {TOK}, {CENT}, {_near_sql('cosine')}, post AS (SELECT DISTINCT centroid_id, doc_id FROM near), {Q}"


def _probe(n: int) -> str:
    return f"probe AS (SELECT DISTINCT query_id, centroid_id FROM (SELECT query_id, centroid_id, row_number() OVER (PARTITION BY query_id, q_pos ORDER BY round(list_inner_product(q, c), 9) DESC, centroid_id) AS n FROM q, cent) WHERE n <= {n}), cand AS (SELECT DISTINCT query_id, doc_id FROM probe JOIN post USING (centroid_id))"


def centroid(spark: SparkSession, sf_dir: str) -> CentroidIndex:
    return CentroidIndex.new(spark, DIM, CENTROIDS).index_documents(tokens_of(spark, sf_dir), book(spark, sf_dir))


@registered(f"{POST} SELECT centroid_id, doc_id FROM post")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings_of(tokens_of(spark, sf_dir), book(spark, sf_dir))


@registered(f"{POST}, {_probe(2)} SELECT query_id, centroid_id FROM probe")
def probed_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probed(query_table(tokens_of(spark, sf_dir)), book(spark, sf_dir), 2)


@registered(f"{POST}, {_probe(1)} SELECT query_id, doc_id FROM cand")
def centroid_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid(spark, sf_dir).candidates(query_table(tokens_of(spark, sf_dir)), 1)


@registered(ranked_sql(f"{POST}, {_probe(2)}, {SIM}, {SCORE}, cs AS (SELECT * FROM score SEMI JOIN cand USING (query_id, doc_id))", "cs", 10))
def search_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid(spark, sf_dir).search(query_table(tokens_of(spark, sf_dir)), nprobe=2)


@registered(f"{POST} SELECT centroid_id, doc_id FROM post WHERE doc_id NOT IN (SELECT label FROM embeddings WHERE label IS NOT NULL)")
def centroid_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "embeddings").where("label is not null").select(F.col("label").cast("long").alias("doc_id"))
    return centroid(spark, sf_dir).delete(gone).postings


# compressed index


def compressed(spark: SparkSession, sf_dir: str, bits: int = 8) -> CompressedIndex:
    tokens, centroids = tokens_of(spark, sf_dir), book(spark, sf_dir)
    return CompressedIndex(DIM, bits, CENTROIDS, CENTROIDS).train(tokens, centroids, centroids).add(tokens)


@registered(ranked_sql(
    f"""{RES}, {BACK8}, ncos AS (SELECT doc_id, centroid_id FROM (SELECT doc_id, tok_pos, centroid_id, row_number() OVER (PARTITION BY doc_id, tok_pos ORDER BY round(-list_inner_product(e, c), 9), centroid_id) AS n FROM tok, cent) WHERE n = 1),
post AS (SELECT DISTINCT centroid_id, doc_id FROM ncos), {Q}, {_probe(2)}, score AS (SELECT query_id, doc_id, sum(b) AS score FROM (SELECT query_id, back.doc_id, q_pos, max(list_inner_product(q, back.e)) AS b FROM q, back GROUP BY ALL) GROUP BY ALL),
cs AS (SELECT * FROM score SEMI JOIN cand USING (query_id, doc_id))""", "cs", 10))
def search_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(spark, sf_dir).search(query_table(tokens_of(spark, sf_dir)), nprobe=2)


@registered(f"WITH {TOK} SELECT count(DISTINCT doc_id) AS doc_count, count(*) AS token_count, (count(*) * 34)::BIGINT AS code_bytes, 64::INT AS dim, 4::INT AS bits, round(count(*) * 256.0 / (count(*) * 34), 2)::DOUBLE AS actual_ratio, round(count(DISTINCT doc_id) * 25600.0 / (count(*) * 34), 2)::DOUBLE AS estimated_ratio FROM tok")
def compressed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(spark, sf_dir, 4).stats()


@registered(f"{RES} SELECT doc_id, tok_pos, centroid_id FROM res WHERE doc_id NOT IN (SELECT label FROM embeddings WHERE label IS NOT NULL)")
def compressed_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "embeddings").where("label is not null").select(F.col("label").cast("long").alias("doc_id"))
    return compressed(spark, sf_dir).delete(gone).codes.select("doc_id", F.col("tok_pos").cast("long").alias("tok_pos"), "centroid_id")


# retrieval


def _candidates(queries: DataFrame, tokens: DataFrame) -> DataFrame:
    """All documents in the order of their ids, the first one twice, and an unknown id for each."""
    docs = tokens.select("doc_id").distinct()
    each = docs.select(F.col("doc_id").alias("cand_pos"), "doc_id").unionByName(docs.select((-F.col("doc_id") - 1).alias("cand_pos"), (-F.col("doc_id") - 1).alias("doc_id")))
    each = each.unionByName(docs.where("doc_id = 0").select(F.lit(-1_000_000).cast("long").alias("cand_pos"), "doc_id"))
    return queries.select("query_id").distinct().crossJoin(each)


CAND = f"{BASE}, d AS (SELECT DISTINCT doc_id FROM tok), each_ AS (SELECT doc_id AS cand_pos, doc_id FROM d UNION ALL SELECT -doc_id - 1, -doc_id - 1 FROM d UNION ALL SELECT -1000000, doc_id FROM d WHERE doc_id = 0), rr AS (SELECT query_id, cand_pos, doc_id, round(coalesce(score, 0.0), 6) AS score FROM (SELECT DISTINCT query_id FROM q) CROSS JOIN each_ LEFT JOIN score USING (query_id, doc_id)), ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, cand_pos)::INT AS rank, cand_pos, doc_id, score FROM rr)"


@registered(f"{CAND} SELECT * FROM ranked")
def rerank_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, tokens = inputs(spark, sf_dir)
    return retrieve.rerank(_candidates(queries, tokens), queries, tokens)


@registered(f"{CAND} SELECT * FROM ranked WHERE rank <= 10")
def batch_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, tokens = inputs(spark, sf_dir)
    return retrieve.batch_rerank(_candidates(queries, tokens), queries, tokens)


_V = f"list_transform({HASH16.format(t='token')}, lambda x: x)"
RERANK_TEXTS = f"""WITH {DTOK.format(n=177)}, qt AS (SELECT item_id AS query_id, list_slice(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+|[^a-z0-9\\s]'), 1, 29) AS t FROM benchmark),
qm AS (SELECT query_id, list_concat(list_concat(['[CLS]', '[Q]'], t), ['[SEP]']) AS t FROM qt),
qa AS (SELECT query_id, token, sum(w) AS w FROM (SELECT query_id, unnest(t) AS token, 1.0::DOUBLE AS w FROM qm UNION ALL SELECT query_id, '[MASK]', (32 - len(t))::DOUBLE FROM qm WHERE len(t) < 32) GROUP BY ALL),
da AS (SELECT doc_id, unnest(list_distinct(list_concat(['[CLS]', '[D]', '[SEP]'], t))) AS token FROM dt),
v AS (SELECT token, list_transform(r, lambda x: x / (sqrt(list_inner_product(r, r)) + 1e-9)) AS v FROM (SELECT token, {_V} AS r FROM (SELECT token FROM qa UNION SELECT token FROM da))),
qv AS (SELECT DISTINCT token FROM qa), pair AS (SELECT qv.token AS qt, b.token AS dt, list_inner_product(a.v, b.v) AS s FROM qv JOIN v a USING (token), v b WHERE b.token IN (SELECT token FROM da)),
best AS (SELECT qt, doc_id, max(s) AS b FROM pair JOIN da ON da.token = pair.dt GROUP BY ALL), score AS (SELECT query_id, doc_id, sum(w * b) AS score FROM qa JOIN best ON qa.token = best.qt GROUP BY ALL)"""


@registered(ranked_sql(RERANK_TEXTS, "score", 10))
def rerank_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item against every document's text."""
    queries = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")
    return retrieve.rerank_texts(queries, table(spark, sf_dir, "documents"), encode.HashEncoder(), 10)


PRF = f"""{BASE}, {_nn(50)}, cs AS (SELECT * FROM score SEMI JOIN nn USING (query_id, doc_id)), fb AS (SELECT query_id, doc_id FROM (SELECT query_id, doc_id, {RANK} AS rank FROM cs) WHERE rank <= 3),
ft AS (SELECT fb.query_id, doc_id, tok_pos, e FROM fb JOIN tok USING (doc_id)), fm AS (SELECT ft.query_id, doc_id, tok_pos, e, round(max(list_inner_product(q, e)), 9) AS m FROM ft JOIN q USING (query_id) GROUP BY ALL),
ex AS (SELECT * FROM (SELECT *, round(m * (1 - m), 9) AS value, row_number() OVER (PARTITION BY query_id ORDER BY round(m * (1 - m), 9) DESC, doc_id, tok_pos) AS n FROM fm) WHERE n <= 10)"""


@registered(f"{PRF} SELECT query_id, doc_id, tok_pos, round(value, 6) AS value FROM ex")
def prf_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, tokens = inputs(spark, sf_dir)
    found = retrieve.expansion_tokens(cut(flat(spark, sf_dir).search(queries, 3)), queries, tokens)
    return found.select("query_id", "doc_id", F.col("tok_pos").cast("long").alias("tok_pos"), F.round("value", 6).alias("value"))


@registered(ranked_sql(f"""{PRF}, q2 AS (SELECT query_id, q_pos, q FROM q UNION ALL SELECT query_id, 1000000 + row_number() OVER (PARTITION BY query_id ORDER BY doc_id, tok_pos), list_transform(e, lambda x: x * 0.5) FROM ex),
sim2 AS (SELECT query_id, q_pos, doc_id, tok_pos, list_inner_product(q, e) AS s FROM q2, tok), score2 AS (SELECT query_id, doc_id, sum(b) AS score FROM (SELECT query_id, doc_id, q_pos, max(s) AS b FROM sim2 GROUP BY ALL) GROUP BY ALL),
nn2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, q_pos ORDER BY round(s, 9) DESC, doc_id, tok_pos) AS n FROM sim2) WHERE n <= 50), cs2 AS (SELECT * FROM score2 SEMI JOIN nn2 USING (query_id, doc_id))""", "cs2", 10))
def search_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, tokens = inputs(spark, sf_dir)
    return retrieve.search_with_feedback(queries, flat(spark, sf_dir), tokens)


# chunks


@registered()
def chunk_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunk_documents(table(spark, sf_dir, "documents"))


@registered("""WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS ws FROM documents)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(ws)::BIGINT AS n_covered, true AS within_size FROM w WHERE len(ws) > 0""")
def chunk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document its distinct words, those that stand whole in a chunk, and whether all chunks keep to the size."""
    docs = table(spark, sf_dir, "documents")
    cut_up = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda x: x != "")
    words = docs.select("doc_id", F.explode(F.array_distinct(cut_up(F.col("text")))).alias("word"))
    chunks = chunk.chunk_documents(docs).select("doc_id", cut_up(F.col("text")).alias("ws"), (F.length("text") <= chunk.SIZE).alias("fits"))
    found = chunks.select("doc_id", "fits", F.explode("ws").alias("word")).groupBy("doc_id", "word").agg(F.min("fits").alias("fits"))
    both = words.join(found, ["doc_id", "word"], "left").groupBy("doc_id")
    return both.agg(F.count(F.lit(1)).alias("n_words"), F.count("fits").alias("n_covered"), F.min(F.coalesce("fits", F.lit(True))).alias("within_size"))


FIXED = "fx AS (SELECT doc_id, unnest(range(ceil(length(text) / 500.0)::BIGINT))::INT AS chunk_index, text FROM documents WHERE length(text) > 0), ch AS (SELECT doc_id || '__chunk_' || chunk_index AS chunk_id, doc_id, chunk_index, substr(text, chunk_index * 500 + 1, 500) AS text FROM fx)"


@registered(f"WITH {FIXED} SELECT chunk_id, doc_id, chunk_index, text FROM ch")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.fixed_chunks(table(spark, sf_dir, "documents"))


@registered(f"WITH {FIXED} SELECT doc_id, count(*) AS n_chunks FROM ch GROUP BY ALL")
def chunk_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.estimate_chunks(chunk.fixed_chunks(table(spark, sf_dir, "documents")))


TURNS = "mp AS (SELECT conv_id || '__chunk_' || turn AS chunk_id, conv_id AS doc_id, turn::INT AS chunk_index FROM conversations)"


def _mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("chunk_index"), "role", "text")
    return turns.withColumn("chunk_id", chunk.chunk_id("doc_id", "chunk_index"))


@registered(f"WITH {TURNS}, asked AS (SELECT chunk_id FROM mp UNION ALL SELECT chunk_id || '_unknown' FROM mp) SELECT chunk_id, coalesce(doc_id::VARCHAR, 'none') AS doc_id FROM asked LEFT JOIN mp USING (chunk_id)")
def chunk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = _mapping(spark, sf_dir)
    asked = mapping.select("chunk_id").unionByName(mapping.select(F.concat("chunk_id", F.lit("_unknown")).alias("chunk_id")))
    return chunk.doc_of(asked, mapping).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))


@registered(f"WITH {TURNS} SELECT doc_id, chunk_index, chunk_id FROM mp WHERE doc_id IN (SELECT doc_id FROM documents)")
def chunk_ids_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunks_of(table(spark, sf_dir, "documents"), _mapping(spark, sf_dir))


def _add_merge(how: str, sql: str) -> None:
    def merge(spark: SparkSession, sf_dir: str) -> DataFrame:
        mapping = _mapping(spark, sf_dir)
        results = mapping.select(F.lit(0).cast("long").alias("query_id"), F.when(F.col("role") == "system", F.concat(F.lit("lone"), "chunk_id")).otherwise(F.col("chunk_id")).alias("chunk_id"), F.length("text").cast("double").alias("score"))
        return chunk.merge_results(results, mapping, how).withColumn("score", F.round("score", 6))

    merge.__name__ = f"merge_{how}"
    registered(f"SELECT 0::BIGINT AS query_id, CASE WHEN role = 'system' THEN 'lone' || conv_id || '__chunk_' || turn ELSE conv_id::VARCHAR END AS doc_id, round({sql}(length(text)::DOUBLE), 6) AS score FROM conversations GROUP BY ALL")(merge)


for _how, _sql in (("max", "max"), ("mean", "avg"), ("sum", "sum")):
    _add_merge(_how, _sql)


# texts through the whole way in


BENCH = f"""WITH bt AS (SELECT item_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+|[^a-z0-9\\s]') AS t FROM benchmark),
qm AS (SELECT id, list_concat(list_concat(['[CLS]', '[Q]'], list_slice(t, 1, 29)), ['[SEP]']) AS t FROM bt),
qa AS (SELECT id AS query_id, unnest(range(len(t)))::BIGINT AS q_pos, unnest(t) AS token, 1.0::DOUBLE AS w FROM qm UNION ALL SELECT id, len(t)::BIGINT, '[MASK]', (32 - len(t))::DOUBLE FROM qm WHERE len(t) < 32),
dm AS (SELECT id, list_concat(list_concat(['[CLS]', '[D]'], list_slice(t, 1, 177)), ['[SEP]']) AS t FROM bt), da AS (SELECT id AS doc_id, unnest(range(len(t)))::BIGINT AS tok_pos, unnest(t) AS token FROM dm),
v AS (SELECT token, list_transform(r, lambda x: x / (sqrt(list_inner_product(r, r)) + 1e-9)) AS v FROM (SELECT token, {_V} AS r FROM (SELECT token FROM qa UNION SELECT token FROM da))),
pr AS (SELECT a.token AS qt, b.token AS dt, list_inner_product(a.v, b.v) AS s FROM v a, v b WHERE a.token IN (SELECT token FROM qa) AND b.token IN (SELECT token FROM da)),
sim AS (SELECT query_id, q_pos, w, qa.token AS query_token, doc_id, tok_pos, da.token AS doc_token, s FROM qa JOIN pr ON qa.token = pr.qt JOIN da ON da.token = pr.dt),
score AS (SELECT query_id, doc_id, sum(b * w) AS score FROM (SELECT query_id, doc_id, q_pos, w, max(s) AS b FROM sim GROUP BY ALL) GROUP BY ALL)"""


def _bench(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf_dir, "benchmark")
    return items.select(F.col("item_id").alias("query_id"), "text"), items.select(F.col("item_id").alias("doc_id"), "text")


@registered(ranked_sql(f"{BENCH}, {_nn(50)}, cs AS (SELECT * FROM score SEMI JOIN nn USING (query_id, doc_id))", "cs", 10))
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in, texts asked: every benchmark item is indexed and is a query."""
    encoder, (queries, docs) = api.load_encoder(), _bench(spark, sf_dir)
    return api.search(queries, encoder, api.index(docs, encoder, api.new_index(spark, encoder)))


@registered(f"""{BENCH}, best AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, q_pos ORDER BY round(s, 9) DESC, tok_pos) AS n FROM sim), ex AS (SELECT *, sum(round(s, 9) * w) OVER (PARTITION BY query_id, doc_id) AS score FROM best WHERE n = 1)
SELECT query_id, doc_id, q_pos AS query_index, query_token, tok_pos AS doc_index, doc_token, round(s, 9) AS similarity, round(score, 9) AS score FROM ex WHERE query_token <> '[MASK]'""")
def explain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = api.explain(*_bench(spark, sf_dir), api.load_encoder())
    return found.select("query_id", "doc_id", F.col("query_index").cast("long").alias("query_index"), "query_token", F.col("doc_index").cast("long").alias("doc_index"), "doc_token", F.round("similarity", 9).alias("similarity"), F.round("score", 9).alias("score"))


@registered(f"""WITH {DTOK.format(n=177)}, mk AS (SELECT doc_id, list_concat(list_concat(['[CLS]', '[D]'], t), ['[SEP]']) AS t FROM dt), tk AS (SELECT doc_id, unnest(range(len(t)))::INT AS p, unnest(t) AS token FROM mk),
f AS (SELECT doc_id, token, min(p) AS p FROM tk WHERE token NOT IN ({SKIP}) GROUP BY ALL) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1)::INT AS tok_pos, token FROM f""")
def encode_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents encoded, without punctuation and near duplicates: of this encoder's vectors equal tokens alone are over 0.99."""
    return encode.encode_documents(table(spark, sf_dir, "documents"), encode.HashEncoder(), True, True).select("doc_id", "tok_pos", "token")


# indexes that train themselves, and their updates


@registered(ranked_sql(BASE, "score", 10))
def trained_centroid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first batch trains the centroids; with all of them probed the search is exact, whatever they are."""
    queries, tokens = inputs(spark, sf_dir)
    return CentroidIndex.new(spark, DIM, CENTROIDS).index_documents(tokens).search(queries, nprobe=CENTROIDS)


@registered(f"WITH {TOK}, {Q} SELECT DISTINCT query_id, query_id AS doc_id FROM q")
def trained_compressed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codebook and centroids are trained; with 8 bits every query document is its own best match."""
    queries, tokens = inputs(spark, sf_dir)
    index = CompressedIndex(DIM, 8, CENTROIDS, CENTROIDS).index_documents(tokens)
    return index.search(queries, top_k=1, nprobe=CENTROIDS).select("query_id", "doc_id")


@registered(f"WITH {TOK} SELECT {CENTROIDS}::BIGINT AS n_centroids, {CENTROIDS}::BIGINT AS n_unit, count(*) AS n_tokens FROM tok")
def trained_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many centroids as asked for, all of unit length, and every token assigned to one of them."""
    tokens = tokens_of(spark, sf_dir)
    found = cut(kmeans.train(tokens, CENTROIDS))
    about = found.agg(F.count(F.lit(1)).alias("n_centroids"), F.count_if(F.abs(norm("vector") - 1) < 1e-6).alias("n_unit"))
    known = kmeans.assign(tokens, found).join(F.broadcast(found.select("centroid_id")), "centroid_id").agg(F.count(F.lit(1)).alias("n_tokens"))
    return about.crossJoin(known)


_ODD_CENT = f"WITH {TOK}, {CENT}, {_ODD}, u AS (SELECT * FROM tok ANTI JOIN new USING (doc_id) UNION ALL SELECT * FROM new)"


@registered(f"{_ODD_CENT}, {_near_sql('cosine').replace('FROM tok,', 'FROM u,')} SELECT DISTINCT centroid_id, doc_id FROM near")
def centroid_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid(spark, sf_dir).update(_shifted(tokens_of(spark, sf_dir))).postings


@registered(f"{_ODD_CENT}, {_near_sql('l2').replace('FROM tok,', 'FROM u,')} SELECT doc_id, tok_pos, centroid_id FROM near")
def compressed_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compressed(spark, sf_dir).update(_shifted(tokens_of(spark, sf_dir))).codes
    return found.select("doc_id", F.col("tok_pos").cast("long").alias("tok_pos"), "centroid_id")


# persistence


@registered(SQL["decompress_2bit"])
def save_load_codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark)
    compression.save_codebook(book(spark, sf_dir), path, 2)
    centroids, bits = compression.load_codebook(spark, path)
    back = compression.decompress(compression.compress(tokens_of(spark, sf_dir), centroids, bits), centroids, bits)
    return back.select("doc_id", F.col("tok_pos").cast("long").alias("tok_pos"), text("embedding").alias("vector"))


@registered(SQL["search_centroid"])
def save_load_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark)
    centroid(spark, sf_dir).save(path)
    return CentroidIndex.load(spark, path).search(query_table(tokens_of(spark, sf_dir)), nprobe=2)


@registered(SQL["search_compressed"])
def save_load_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark)
    compressed(spark, sf_dir).save(path)
    return CompressedIndex.load(spark, path).search(query_table(tokens_of(spark, sf_dir)), nprobe=2)


@registered(SQL["search_flat"])
def save_load_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark)
    flat(spark, sf_dir).save(path)
    return FlatIndex.load(spark, path).search(query_table(tokens_of(spark, sf_dir)))


@registered(ranked_sql(BASE, "score", 10))
def merged_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join formulation of maxsim_topk: the same rows without the kernel."""
    return top(scoring.scores_by_join(*inputs(spark, sf_dir)), 10)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


