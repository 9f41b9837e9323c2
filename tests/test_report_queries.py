from datetime import date

import __spark_entry__ as E
import pytest


def run(spark, name, d):
    return E.queries()[name](spark, str(d)).collect()


@pytest.fixture
def parts(spark, tmp_path):
    rows = [(k, "n", "B", "PROMO", 6 if k % 2 else 11) for k in (1, 4001, 4041, 4060, 30001)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(4, "s")], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    return tmp_path


def test_styles_of_all_parts(spark, parts):
    """4001, 30001, 1 and 4041 share a group and an order: b = k % 3 + 1 decides, then the line."""
    got = {(r["winner"], r["loser"]) for r in run(spark, "ref_J15_cascade_conflicts", parts)}
    assert got == {(4001, 30001), (4001, 1), (4001, 4041), (30001, 1), (30001, 4041), (1, 4041)}
    assert {(r["stronger"], r["simple"]) for r in run(spark, "ref_J16_specificity_warnings", parts)} == {(k, 4041) for k in (1, 4001, 30001)}
    assert {r["id"] for r in run(spark, "ref_R13_near_duplicate_styles", parts)} == {1, 4001, 4041, 4060, 30001}


def test_config_of_all_parts(spark, parts):
    assert {r["entry"] for r in run(spark, "ref_J4_config_definitions", parts)} == {f"entry:{k}" for k in (1, 4001, 4041, 4060, 30001)}
    assert {r["src"] for r in run(spark, "ref_J5_config_usages", parts)} == {"supplier:4"}


def test_runs_of_all_orders(spark, tmp_path):
    """4002 and 4008 share a scope with 6 and are later; resolved is k % 90, indeterminate k % 5, external k % 7."""
    rows = [(6, date(2001, 1, 1)), (4002, date(2001, 1, 2)), (4008, date(2001, 1, 3))]
    spark.createDataFrame(rows, "o_orderkey long, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    trust = run(spark, "ref_R7_relationship_trust", tmp_path)
    assert [(r["runs"], r["resolved"], r["indeterminate"], r["external"]) for r in trust] == [(1, 48, 3, 4)]
    # arity is k % 4, a reason r(k % 5) counts 2
    assert {r["reason"]: r["n"] for r in run(spark, "ref_R7_reason_counts", tmp_path)} == {"arity": 4, "r2": 2, "r1": 2}


def test_snippets_of_all_documents_with_text(spark, tmp_path):
    rows = [(50, 100, "x" * 100), (62, 40, "y" * 40), (99, 8, "z" * 8), (100, 0, ""), (149, 4, "abcd")]
    spark.createDataFrame(rows, "doc_id long, n_chars int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["pack"], r["id"]): r["tokens"] for r in run(spark, "ref_C26_snippets_in_budget", tmp_path)}
    assert got == {(1, "50"): 25, (1, "62"): 10, (1, "99"): 2, (2, "149"): 1}
