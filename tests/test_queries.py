"""Queries against their SQL in DuckDB, on the driver's smallest tables."""

from pathlib import Path

import pytest

from arcmesh.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
LIGHT = ("bbox_union", "quantize_lines", "delta_encode", "delta_roundtrip", "point_quantize", "signed_area", "winding_fix", "collinear_removal", "valid_rings", "junctions_coords", "junctions_paths", "junctions_bricks", "candidate_pairs", "shared_directions", "t_junction_insert", "cut_lines", "signed_refs_bricks", "decode_rings", "merge_contiguous", "shared_coords_cut", "simplify_dp", "duplicate_ids")


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", LIGHT)
def test_query(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("nation", "customer", "orders", "supplier", "events", "lineitem", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    tidy = lambda rows: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)
    own = tidy(df.select(*cols).collect())
    r = con.execute(ORACLE_SQL[name])
    at = [[d[0] for d in r.description].index(c) for c in cols]
    assert own == tidy([x[i] for i in at] for x in r.fetchall())


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
