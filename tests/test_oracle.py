"""Every registered query against DuckDB on the smallest tables."""

import os
import subprocess
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as contract
from check_oracle import compare, connect
from scanloom.plans.registry import ORACLES, QUERIES

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in contract.queries() if n in QUERIES])
def test_query_matches_duckdb(spark, con, name):
    ok, text = compare(spark, con, name, SF)
    assert ok, text


@pytest.mark.parametrize("name", ["depth_scale_per_capture", "fusion_with_short_capture", "fusion_bounds"])
def test_captures_with_and_without_depth(spark, name):
    """Here every capture has depth; in the smallest tables two have none."""
    ok, text = compare(spark, connect(LARGER), name, LARGER)
    assert ok, text


@pytest.fixture(scope="module")
def long_numbers(tmp_path_factory):
    """The smallest tables with numbers of five and of six digits: 10000 and 100000 to 100009 get the same name."""
    folder = str(tmp_path_factory.mktemp("long"))
    con = connect(SF)
    for name in os.listdir(SF):
        table = name.partition(".")[0]
        key = {"embeddings": "vec_id", "events": "event_id", "orders": "o_orderkey"}.get(table)
        sql = f"FROM {table}"
        if key:
            sql = " UNION ALL ".join(f"SELECT * REPLACE ({k} AS {key}) FROM {table}" for k in (f"{key} + 10000", f"{key} * 3 + 100000"))
        con.execute(f"COPY ({sql}) TO '{folder}/{name}'")
    return folder


NAMED = (
    "depth_link_counts depth_links frame_documents frame_table mean_focal registration_rate sidecar_documents_per_capture "
    "sidecar_files sidecar_frame_table sidecar_header sidecar_match_counts skipped_frames"
)


@pytest.mark.parametrize("name", NAMED.split())
def test_files_that_share_a_name(spark, long_numbers, name):
    ok, text = compare(spark, connect(long_numbers), name, long_numbers)
    assert ok, text


def test_an_input_registers_by_its_own_number(spark, long_numbers):
    """Names of five digits would register 100004 for 10000; the query and its SQL compare all digits."""
    con = connect(long_numbers)
    model = {i for (i,) in con.execute("SELECT vec_id FROM embeddings").fetchall()}
    want = {}
    for (i,) in con.execute("SELECT event_id FROM events").fetchall():
        n, found = want.get(i % 4, (0, 0))
        want[i % 4] = n + 1, found + (i in model)
    got = contract.queries()["registration_rate"](spark, long_numbers).collect()
    sql = con.execute(contract.oracle_sql()["registration_rate"]).fetchall()
    for rows in (got, sql):
        assert {capture: (n, found) for capture, n, found, _ in rows} == want


@pytest.mark.parametrize("missing", ["tiktoken", "scanloom.llm"])
def test_entry_loads_without_its_optional_part(missing):
    code = (
        f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; "
        "n = [q for q in e.queries() if q.startswith('op') and q[2].isdigit() or q == 'pipeline']; "
        "print(len(e.queries()), len(e.oracle_sql()), len(n))"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout
    queries, oracles, optional = map(int, out.split())
    assert queries == len(QUERIES) and oracles == len(ORACLES) and optional == 0


def test_entry_runs(spark):
    df = contract.entry(spark)
    assert df.columns[:2] == ["capture", "point_id"] and df.count() > 0
