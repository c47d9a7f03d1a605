"""Queries over whole tables and the whole grid, against their SQL or a plain version."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from threadloom.operators import policies as P
from threadloom.operators import utility as U
from threadloom.plans import catalog, ranking


def test_sentence_ratios_of_empty_and_open_ended_texts(spark, tmp_path):
    texts = ["", " ", "One two. Three. ", "One two. Three.", "a  ", "no end", None]
    pq.write_table(pa.table({"doc_id": list(range(len(texts))), "text": texts}), tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    want = sorted(con.execute(catalog.ORACLE_SQL["sentence_ratios_of_all"]).fetchall())
    got = sorted(tuple(r) for r in catalog.QUERIES["sentence_ratios_of_all"](spark, str(tmp_path)).collect())
    assert got == want and len(got) == len(texts)
    assert dict((d, w) for d, _, w in got)[2] == 1.5


def test_all_orders_have_a_number(spark, sf):
    rows = catalog.QUERIES["global_row_number_of_all"](spark, sf).collect()
    assert sorted(r.order_all for r in rows) == list(range(1, pq.read_table(f"{sf}/orders.parquet").num_rows + 1))


@pytest.fixture(scope="module")
def grid(spark, sf):
    """Scores of all policies by (cut-off, policy)."""
    by = {}
    for r in U.utility(ranking._forum(spark, sf), ("lexdiv",), P.GRID, (10,)).collect():
        by.setdefault((r.cutoff, r.policy), []).append(round(r.value, 6))
    return by


def test_places_and_selection_in_the_whole_grid(spark, sf, grid):
    means = {k: float(np.mean(v)) for k, v in grid.items()}
    places = catalog.QUERIES["policy_leaderboard_grid"](spark, sf).collect()
    assert len(places) == 2 * 66
    for cutoff in ("10", "N"):
        own = sorted((r.place, r.policy) for r in places if r.cutoff == cutoff)
        assert [p for p, _ in own] == list(range(1, 67))
        found = [means[cutoff, p] for _, p in own]
        assert all(a >= b - 1e-5 for a, b in zip(found, found[1:], strict=False))
        roles = {r.role: r.policy for r in catalog.QUERIES["policy_selection_grid"](spark, sf).collect() if r.cutoff == cutoff}
        assert roles["best"] == own[0][1] and roles["worst"] == own[-1][1]


def test_quartiles_of_the_whole_grid(spark, sf, grid):
    rows = catalog.QUERIES["quartiles_by_policy_grid"](spark, sf).collect()
    assert len(rows) == 66
    for r in rows:
        assert [r.q25, r.median, r.q75] == pytest.approx(np.quantile(grid["N", r.policy], [0.25, 0.5, 0.75]), abs=2e-5)


def test_global_numbers_with_ties_and_nulls(spark):
    from threadloom.operators import relational

    rows = [(k, None if k % 17 == 0 else k * 7 % 10) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, v int")
    got = [r.id for r in relational.global_number(df, "v", ["id"], "place", parts=6).orderBy("place").collect()]
    assert got == [k for k, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))]
    assert relational.global_number(df.limit(0), "v", ["id"], "place").count() == 0


def test_smaller_models_stand_beside_the_largest(spark):
    from threadloom.operators import compare

    def fit(**terms):
        return spark.createDataFrame([(t, float(v)) for t, v in terms.items()], "term string, estimate double")

    got = sorted(tuple(r) for r in compare.aligned_coefficients({"less": fit(a=1, z=9), "full": fit(a=2, b=3, c=4)}).collect())
    assert got == [("a", 1.0, 2.0), ("b", None, 3.0), ("c", None, 4.0)]
