"""Small frames for the tests."""


def tokens(spark, docs: dict):
    rows = [(d, i, [float(x) for x in v]) for d, vs in docs.items() for i, v in enumerate(vs)]
    kind = "string" if rows and isinstance(rows[0][0], str) else "long"
    return spark.createDataFrame(rows, f"doc_id {kind}, tok_pos int, embedding array<double>")


def queries(spark, qs: dict):
    rows = [(q, i, [float(x) for x in v], 1.0) for q, vs in qs.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "query_id long, q_pos int, embedding array<double>, weight double")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def ranked(df):
    return [r["doc_id"] for r in sorted(df.collect(), key=lambda r: r["rank"])]
