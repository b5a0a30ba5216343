"""Every query of the engine runs at the smallest size and has columns that its SQL names."""

import os

import duckdb
import pytest

from glyphledger.plans.catalog_of_queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else value


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in SQL:
        assert rows
        return
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want)) or sorted(map(str, [tuple(map(_num, r)) for r in rows])) == sorted(map(str, [tuple(map(_num, r)) for r in want]))


def _num(v):
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v if not hasattr(v, "as_tuple") else float(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_detect_card_with_images_cut_short(spark, duck, tmp_path):
    """Four vectors make an image; here some images lack up to three of theirs."""
    duck.execute(f"COPY (SELECT * FROM embeddings WHERE hash(vec_id) % 5 < 3 OR vec_id < 40) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    cut = duckdb.connect()
    cut.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    df = QUERIES["detect_card"](spark, str(tmp_path))
    want = cut.execute(SQL["detect_card"]).fetchall()
    assert [d[0] for d in cut.description] == df.columns
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, want))
    assert len({r[1] for r in want}) > 1
