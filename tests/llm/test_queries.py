"""The registered queries themselves, on the smallest tables and on edge cases, against a second engine or the contract's columns."""

import hashlib
import random
import zlib

import duckdb
import pytest

from tokenweft.llm import queries
from tokenweft.llm._common import read


def rows_of(found):
    names = sorted(found.columns)
    return sorted(tuple(str(r[c]) for c in names) for r in found.collect())


def rows_of_sql(con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(str(r[i]) for i in order) for r in found.fetchall())


def test_tool_calls_as_sql_on_edge_cases(spark, tmp_path):
    rng = random.Random(11)
    texts = [None, "", "plain", 'with "quotes" and \\ back', "line\nend\ttab", "é中🙂", "x" * 350, "y" * 500]
    rows = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", "tool", "User", None]), rng.choice(texts)) for _ in range(160)]
    rows = list(dict.fromkeys([*rows, (7, 0, "user", "a"), (7, 1, "assistant", "b"), (None, None, None, None)]))
    path = str(tmp_path)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{path}/conversations.parquet/*.parquet'")
    assert rows_of(queries.op4_tool_calls(spark, path)) == rows_of_sql(con, queries.oracle_sql()["op4_tool_calls"])


def test_fingerprint_columns(spark, sf_dir):
    docs = sorted(((r["doc_id"], r["text"] or "") for r in read(spark, sf_dir, "documents").select("doc_id", "text").collect()), reverse=True)
    got = {r["doc_id"]: r for r in queries.op5_order_minhash(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for (i, t), (_, following) in zip(docs, [*docs[1:], docs[0]], strict=True):
        cut = len(t) // 3
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256((t[: len(t) - cut] + following[:cut]).encode()).hexdigest())


@pytest.mark.parametrize(("name", "columns"), [
    ("op1_quality", "doc_id held_out score predicted"), ("op2_language_model", "doc_id held_out n_tokens n_known train_tokens base_score score"),
    ("op6_rules", "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept"), ("op9_toxicity", "doc_id held_out score predicted"),
])
def test_contract_columns(spark, sf_dir, name, columns):
    got = queries.queries()[name](spark, sf_dir)
    assert set(columns.split()) <= set(got.columns)
    ids = [r["doc_id"] for r in read(spark, sf_dir, "documents").select("doc_id").collect()]
    rows = got.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(ids)
    if "held_out" in got.columns:
        folds, fold = (7, 2) if "base_score" in got.columns else (5, 0)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == fold) for r in rows)
