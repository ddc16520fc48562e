"""The registered graph queries against their SQL on another engine; a sample here, all of them in the driver's run."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["flagship_region_orders", "expand_both", "optional_chain", "exists_under_or", "agg_distinct_values", "call_union", "path_trail", "path_node_pred", "lsqb_q8_like", "copy_roundtrip", "dml_merge"]


def plain(rows):
    return sorted(repr([round(v, 6) if isinstance(v, float) and math.isfinite(v) else v for v in r]) for r in rows)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert plain(got.select(*[f"`{n}`" for n in names]).collect()) == plain(want.fetchall())


WHOLE = ["expand_edge_props", "expand_any_type", "self_join_neq", "cast_string", "cast_temporal", "date_part_all", "date_plus_interval", "ts_minus_ts_days", "str_upper_lower_reverse", "path_long_chain"]


@pytest.mark.parametrize("name", WHOLE)
def test_whole_tables_against_sql(spark, name):
    test_against_sql(spark, name)


NEW = ["refers_between", "refers_nearest", "refers_all_shortest", "refers_trail", "named_path_long", "path_pred_both", "exists_alone", "exists_alone_marked", "interval_mixed", "lsqb_q8_like", "dml_merge_rel", "macro_call", "load_graph_spec"]


@pytest.mark.parametrize("name", NEW)
def test_further_forms_against_sql(spark, name):
    test_against_sql(spark, name)
