import os
import sys

import pytest

SF = "/root/testdata/sf0.001"
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
NAMES = (
    "component_edges fan_in probe_all probe_types entry_points scenario_edges convergence islands on_cycle_nodes elementary_cycles_len4 import_depth connected_components mesh_nodes mesh_aggregate_component "
    "impact risk_scores what_if_edges report_diff boundary_rules drift hexa_roles vocab_map churn coverage route c_includes package_edges p2_found p3_found p4_percentiles p5_found p5_name_stats "
    "p4_combined_error pattern_scan cross_repo_new_cycles_len4 cohesion_clusters resolve_roles suppressed gaps top_churn symbol_hashes changed_packages"
).split()


def test_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_against_sql(spark, name):
    import duckdb
    from compare import bag

    import __spark_entry__ as e

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    df = e.queries()[name](spark, SF)
    r = con.execute(e.oracle_sql()[name])
    cols = [c[0] for c in r.description]
    assert sorted(cols) == sorted(df.columns)
    assert bag(df.columns, df.collect()) == bag(cols, r.fetchall())
