import duckdb
import pytest

import __spark_entry__ as E

FAST = ["curated_projection", "impute_median", "impute_mode", "split_exact", "standardize",
        "anova_f", "anova_f_shifted", "top_k_perfect", "clean_nan", "impute_median_discrete", "binary_metrics",
        "roc_curve", "cos2_features", "cos2_kernel_stats", "kernel_stats", "cross_gram", "metric_pivot", "readme_table"]


def test_entry_runs(spark):
    rows = E.entry(spark).collect()
    assert {r.split for r in rows} == {"train", "val", "test"}


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("orders customer lineitem documents labels embeddings").split():
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    s = E.queries()[name](spark, sf).toPandas()
    d = con.sql(E.oracle_sql()[name]).df()
    assert sorted(s.columns) == sorted(d.columns)
    cols = sorted(s.columns)

    def norm(df):
        out = []
        for r in df[cols].itertuples(index=False):
            out.append(tuple(None if v is None or (isinstance(v, float) and v != v) else
                             (round(float(v), 6) if isinstance(v, float) else v) for v in r))
        return sorted(out, key=repr)

    assert norm(s) == norm(d)
