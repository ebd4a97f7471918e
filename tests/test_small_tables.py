"""Queries against their SQL on small tables of odd rows."""

import duckdb

from sparkloom.plans import queries as plans


def _both(spark, folder, name, **tables):
    """The query's rows and those of its SQL, over tables given as (schema, rows)."""
    con = duckdb.connect()
    for table, (schema, rows) in tables.items():
        path = f"{folder}/{table}.parquet"
        spark.createDataFrame(rows, schema).write.parquet(path)
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    df = plans.QUERIES[name](spark, str(folder))
    cursor = con.execute(plans.ORACLE[name])
    order = [c[0] for c in cursor.description]
    return sorted(map(tuple, df.select(*order).collect()), key=str), sorted(cursor.fetchall(), key=str)


def test_labels_of_short_texts(spark, tmp_path):
    texts = (None, "", "A.", "abc", "Long enough to be some prose.")
    rows = [(60 * j + i, t, "web") for j, t in enumerate(texts) for i in range(60)]
    got, expected = _both(spark, tmp_path, "s23_magic_label", documents=("doc_id long, text string, source string", rows))
    assert got == [(int(a), b, c) for a, b, c in expected]
    assert all(r[1] == "mp4" for r in got if r[0] % 10 == 8)


def test_citations_are_taken_out(spark, tmp_path):
    rows = [(c, t, x) for c in range(12) for t in range(3) for x in (None, "", "see [S2] and [S 1],  [S 02] [S0] or [S12345]", "[S 7][S 2] a\n[S1]")]
    got, expected = _both(spark, tmp_path, "t15_citations", conversations=("conv_id long, turn int, text string", rows))
    assert sorted((c, t, a, tuple(r), n) for c, t, a, r, n in got) == sorted((c, t, a, tuple(r), n) for c, t, a, r, n in expected)
    assert any("[S" not in a and "so" in a for _, _, a, _, _ in got) and any(list(r) == [2, 1] for *_, r, _ in got)
