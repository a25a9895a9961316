"""Queries against their SQL on small tables of rows that are rare in the generated ones."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from archivolt.plans.catalog import ORACLES, QUERIES
from tests.test_catalog import rows


def agree(spark, path, name, **tables):
    con = duckdb.connect()
    for table, columns in tables.items():
        pq.write_table(pa.table(columns), f"{path}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{path}/{table}.parquet'")
    assert rows(QUERIES[name](spark, str(path)).toPandas()) == rows(con.execute(ORACLES[name]).df())


def test_own_body_is_no_foreign_reference(spark, tmp_path):
    """Orders that cite Ley 1 de 1999 itself, every third of them with their own body as reference."""
    keys = [2000 * i + 1 for i in range(12)]
    orders = {"o_orderkey": keys, "o_custkey": [3 * i + 1 for i in range(12)], "o_orderstatus": ["F"] * 12, "o_totalprice": [1.0] * 12, "o_orderdate": [datetime.datetime(1999, 5, 1)] * 12, "o_orderpriority": ["1-URGENT"] * 12}
    agree(spark, tmp_path, "citation_score", orders=orders)


def test_halves_round_to_even(spark, tmp_path):
    balances = [4.5, 4.0, 5.5, 6.0, -2.5, -2.0, -3.0, 5.0, 0.5, 0.0, -0.5, 1.0, 1.5, 2.0]
    n = len(balances)
    customer = {"c_custkey": list(range(n)), "c_name": ["x"] * n, "c_nationkey": pa.array([1] * n, pa.int32()), "c_acctbal": balances, "c_mktsegment": ["BUILDING"] * n}
    agree(spark, tmp_path, "validation_errors", customer=customer)


def test_legal_words_of_other_scripts(spark, tmp_path):
    """Words end at letters that are not ASCII ones; a capital I with a dot is one letter."""
    texts = ["ßsl 3385 y", "sl 3385ß", "ж12 o", "12 oж", "日c-004", "İA İstanbul", "ΑΣ 7 º", "sl3385 12 o", None, ""]
    documents = {"doc_id": list(range(len(texts))), "text": texts, "lang": ["es"] * len(texts), "source": ["s"] * len(texts), "n_chars": [0] * len(texts)}
    agree(spark, tmp_path, "legal_terms", documents=documents)
    agree(spark, tmp_path, "term_document_frequency", documents=documents)
