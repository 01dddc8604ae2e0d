"""The driver contract: names, twins, and small queries run end to end."""

import duckdb
import pytest

import __spark_entry__ as entry
from folioscope.plans.catalogue import catalogue

DIR = "/root/testdata/sf0.001"


def test_twins_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue()) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0


@pytest.mark.parametrize("name", ["p3_found", "corpus_filter", "corpus_metrics", "early_stopping", "lexicon_candidates", "alto_text", "greedy_match"])
def test_twin_agrees(spark, name):
    con = duckdb.connect()
    for t in "corpus_lines run_lines runs lexicon events lineitem line_files".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = entry.queries()[name](spark, DIR)
    rel = con.sql(entry.oracle_sql()[name])
    order = lambda cols: sorted(range(len(cols)), key=cols.__getitem__)
    fix = lambda rows, cols: sorted(repr([round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order(cols)]) for r in rows)
    assert sorted(df.columns) == sorted(rel.columns)
    assert fix(df.collect(), df.columns) == fix(rel.fetchall(), rel.columns)
