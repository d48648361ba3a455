"""The site threshold of the line dedup follows the number of sites, in code and SQL alike."""

import duckdb
import pytest

from visitlake.llm import line_dedup
from visitlake.llm.oracle import SQL


@pytest.mark.parametrize("sites,need", [(1, 3), (2, 3), (5, 3), (9, 5), (19, 10), (20, 10), (60, 10)])
def test_threshold(spark, sites, need):
    rows = [(100 * k + i, f"own line {k} {i}\nline on {k} sites\nend", f"s{i % sites}") for k in range(1, min(sites, 12) + 1) for i in range(k)]
    rows += [(10_000 + i, "alone", f"s{i}") for i in range(sites)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert line_dedup.sites_needed(docs) == need
    done = line_dedup.drop_boilerplate_lines(docs)
    got = {r.doc_id: (r.n, r.text) for r in done.selectExpr("doc_id", "line_dedup.n_removed as n", "text").collect()}
    for k in range(1, min(sites, 12) + 1):
        gone = sum("line on" not in got[100 * k + i][1] for i in range(k))
        assert gone == (k - 1 if k >= need else 0)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    assert {r[0]: r[2] for r in con.execute(SQL["op8_line_dedup"]).fetchall()} == {i: n for i, (n, _) in got.items()}
