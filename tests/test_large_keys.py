"""Queries on tables with larger keys and odd values, against their SQL in DuckDB."""

import duckdb

from quire.plans import registry


def both(spark, at, name, table, rows, schema):
    """A query's rows and its SQL's over one table of given rows."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{table}.parquet")
    c = duckdb.connect()
    c.execute("SET threads = 1")
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{at}/{table}.parquet/*.parquet'")
    df = registry.queries()[name](spark, str(at))
    found = c.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    return sorted(map(str, map(tuple, df.select(*columns).collect()))), sorted(map(str, found.fetchall()))


EVENTS = "event_id long, user_id long, value double, ts timestamp, event_type string"


def test_fallbacks_beyond_a_million_ids(spark, tmp_path):
    """An old partial state (id 11) is before a success a million ids later, as in SQL; rows without an id don't count."""
    ids = {1: [11, 1_000_013, 3_000_003], 2: [21, 999_998], 3: [5, 10, 2_000_003], 4: [None, 8], 5: [None], None: [1_200_004, 16]}
    rows = [(i, user, 1.0, None, "view") for user, all_ in ids.items() for i in all_]
    got, want = both(spark, tmp_path, "first_available", "events", rows, EVENTS)
    assert got == want and str((1, 11)) in got


def test_bands_of_boxes_without_a_size(spark, tmp_path):
    """A box without a bottom comes after those of its top, and is in their band."""
    rows = [(k, "n", None if k % 7 == 3 else k * k % 50 + 1) for k in range(400)] + [(None, "x", 3), (None, "y", 4)]
    got, want = both(spark, tmp_path, "vertical_bands", "part", rows, "p_partkey long, p_name string, p_size int")
    assert got == want


def test_bands_of_equal_boxes_are_apart(spark, tmp_path):
    """Boxes of equal top and bottom leave the order open; the bands of a page still don't meet, and hold every box."""
    rows = [(20 * k + j, "n", 13 * (j % 2) + 1) for k in range(50) for j in range(20) for _ in range(3)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int").repartition(7).write.parquet(str(tmp_path / "part.parquet"))
    got = sorted(map(tuple, registry.queries()["vertical_bands"](spark, str(tmp_path)).select("page", "band", "top", "bottom", "items").collect()))
    assert sum(r[4] for r in got) == len(rows)
    assert all(a[3] < b[2] and a[1] + 1 == b[1] for a, b in zip(got, got[1:], strict=False) if a[0] == b[0])


def test_tiers_of_odd_tables(spark, tmp_path):
    """Tables of one row, of many, with labels that repeat, blanks and nulls; a line without a table has no candidates, as in SQL."""
    rows = []
    for tab in (None, 0, 1, 2, 3, 4, -5, 6, 7, 8):
        for k in range(1 if tab in (3, 4) else 14):
            part, supplier = (None if k == 9 else 20 + k * k % 5 + k % 2), (None if k == 4 else k * 3 % 8)
            rows.append((tab, part, supplier, k, float(k), None if k == 2 else 10.5 * k + 1, (None, "", "A", "R")[k % 4]))
    got, want = both(spark, tmp_path, "candidate_tier", "lineitem", rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string")
    assert got == want and {r[-2] for r in got} == {"1", "3", "4"}


def test_tiers_compare_rows_not_cells(spark):
    """One shuffle, of lines, before they are parted into cells: a second one, of cells, and an array of them for each cell took over 15 minutes on 36 million lines."""
    df = registry.queries()["candidate_tier"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
