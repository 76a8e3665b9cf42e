"""Every registered query runs on the smallest tables and equals its SQL there, where the tables are present."""

import math
import os

import pytest

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the test tables aren't here")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 5) if isinstance(v, float) else str(v)[:19] if hasattr(v, "isoformat") else v


def test_queries_equal_their_sql(spark):
    import duckdb

    from trovework.plans import catalogue

    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DIR):
        db.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    sql = catalogue.oracle_sql()
    queries = catalogue.queries()
    assert set(sql) <= set(queries)
    for name in ("keyword_search", "hybrid_search", "facets", "snapshot_changes", "file_states", "declarations", "nearest_vectors", "inheritance_closure", "result_quality", "usage", "citations", "upserted", "embedding_texts", "prompt_selection", "transitive_search", "phrase_search", "nearest_by_cells_recall", "mode_comparison", "repository_of_file", "index_build"):
        df = queries[name](spark, DIR)
        cols = sorted(df.columns)
        got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
        r = db.execute(sql[name])
        names = [x[0] for x in r.description]
        assert sorted(names) == cols, name
        assert got == sorted(repr([plain(x[names.index(c)]) for c in cols]) for x in r.fetchall()), name


def test_modes_share_their_legs(spark, monkeypatch):
    """A comparison of modes searches by words once, not once for each mode."""
    from trovework.operators import search
    from trovework.plans import catalogue

    calls, real = [], search.keyword_search
    monkeypatch.setattr(search, "keyword_search", lambda *x, **y: calls.append(x) or real(*x, **y))
    assert catalogue.mode_comparison(spark, DIR).count() > 0
    assert len(calls) == 1


def test_a_mode_searches_its_own_leg(spark, monkeypatch):
    from trovework.operators import search
    from trovework.plans import catalogue

    def refuse(*x, **y):
        raise AssertionError("the mode leaves this leg out")

    monkeypatch.setattr(catalogue, "_BUILT", {})
    with monkeypatch.context() as m:
        m.setattr(search, "nearest", refuse)
        assert catalogue.hybrid_keyword_mode(spark, DIR).count() > 0
    with monkeypatch.context() as m:
        m.setattr(catalogue, "_BUILT", {})
        m.setattr(search, "build_index", refuse)
        m.setattr(search, "keyword_search", refuse)
        assert catalogue.hybrid_vector_mode(spark, DIR).count() > 0
