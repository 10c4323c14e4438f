"""The registered queries against DuckDB at the smallest scale; SIFTMILL_ALL=1 runs every one."""

import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
SOME = ["sec003", "sec012", "jsec006", "jscs008", "sql003", "cs_sec004", "cs005", "taint001", "m_dup", "m_mi", "u_deps", "a_summary", "q_page", "q_page_ranked", "k_issues", "s_discover", "st_history"]
INVENTORY = """s_discover s_decode s_lang s_projlang s_lines s_req s_pkgjson s_advisory s_imports s_catalog k_issues k_metrics k_scan k_csv k_json k_purge
q_proj q_sev q_cat q_file q_rule q_langf q_notsev q_page q_metrics q_deps q_scans q_projects j_unused j_undeclared j_stdlib j_declnames j_vuln j_latest j_meta
j_langrule j_defuse j_desc a_overview a_sev a_cat a_owasp a_sevpivot a_langbreak a_scansum a_summary a_dash a_avgcc a_weight t_files t_rules t_hot t_scans10
t_scans20 t_dist t_sevtext u_all u_deps u_distinct u_snippet u_lineof u_firstmsg u_comment u_strip u_sevest u_version u_sanitize u_prompt u_halstead u_preview
taint_src taint_sink taint_carry taint_prop taint001 f_py_ast f_py_defs f_py_classes f_py_imports f_py_calls f_js_func f_js_class f_js_import f_js_call f_js_var
m_loc_py m_loc_js m_cc_py m_len_py m_cc_js m_fn_js m_mi m_dup st_scan st_history x_rule""".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def test_inventory_is_covered():
    assert set(INVENTORY) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("SIFTMILL_ALL") else SOME)
def test_query_equals_oracle(spark, duck, name):
    rows = entry.queries()[name](spark, DATA)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(rows.columns)
    key = lambda r: str(r)
    want = sorted((tuple(plain(v) for v in r) for r in cursor.fetchall()), key=key)
    assert sorted((tuple(plain(v) for v in r) for r in rows.select(*[f"`{c}`" for c in columns]).collect()), key=key) == want


def test_entry_runs(spark):
    assert entry.entry(spark).limit(5).count() == 5
