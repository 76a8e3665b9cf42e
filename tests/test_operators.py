import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from trovework.operators import changes, chunks, entities, graph, metrics, rag, search
from trovework.sources import repositories

CHUNK = "id string, content string, language string, entity_type string, entity_name string, source_file string, start_line int, end_line int, start_byte int, end_byte int, created_at timestamp, updated_at timestamp"


def chunk(i, content="x", path="o/r/a.py", name="f", day=1, language="python", start=1, end=2):
    return (i, content, language, "function", name, path, start, end, 0, 5, datetime(2025, 1, day), datetime(2025, 1, day))


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_clean_takes_the_last_row(spark):
    df = spark.createDataFrame([chunk("a", "old", day=1), chunk("a", "new", day=3, language=" PY "), chunk("b")], CHUNK)
    assert values(chunks.clean(df), "id", "content", "language") == [("a", "new", "python"), ("b", "x", "python")]
    assert chunks.clean(df.limit(0)).count() == 0


def test_violations(spark):
    bad = list(chunk("a", start=0, end=-1))
    bad[1] = None
    df = spark.createDataFrame([tuple(bad), chunk("b")], CHUNK)
    assert values(chunks.violations(df), "id", "violations") == [("a", "content is null, start_line below 1, end_line before start_line")]


def test_changes_of_the_table(spark):
    t = spark.createDataFrame([chunk("a", path="1"), chunk("b", path="1"), chunk("c", path="2")], CHUNK)
    new = spark.createDataFrame([chunk("d", path="1"), chunk("c", "y", path="2")], CHUNK)
    assert values(chunks.append(t, new), "id") == [("a",), ("b",), ("c",), ("c",), ("d",)]
    assert values(chunks.replace_files(t, new), "id") == [("c",), ("d",)]
    assert values(chunks.upsert(t, new), "id", "content") == [("a", "x"), ("b", "x"), ("c", "y"), ("d", "x")]
    assert values(chunks.delete_by(t, spark.createDataFrame([("a",), (None,)], "k string"), "id"), "id") == [("b",), ("c",)]


def test_vectors_of_another_dimension_are_refused(spark):
    t = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    new = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0])], t.schema)
    assert values(chunks.upsert_vectors(t, new, 2), "vec_id", "embedding") == [(1, [0.0, 1.0])]


def test_file_predicates(spark):
    df = spark.createDataFrame([("a/B.JAVA",), ("a/.x.py",), ("r.md",), ("lib.so",), ("Makefile",)], "p string")
    got = df.select("p", chunks.is_source_file(F.col("p")).alias("s"), chunks.is_text_file(F.col("p")).alias("t")).collect()
    assert [(r["s"], r["t"]) for r in got] == [(True, True), (False, False), (False, True), (False, False), (False, True)]


DOCS = [("1", "token ledger token"), ("2", "the ledger of snapshots"), ("3", "getToken value"), ("4", None), ("5", "")]


@pytest.fixture
def index(spark, tmp_path):
    return search.build_index(spark.createDataFrame(DOCS, "id string, text string"), {"content": F.col("text")}, f"file://{tmp_path}/index")


@pytest.fixture
def post(index):
    return index.post


def test_bm25_by_brute_force(spark, index):
    q = spark.createDataFrame([("q", "token ledger")], "query_id string, text string")
    got = {r["doc"]: r["score"] for r in search.keyword_search(search.open_index(spark, index.path), q).collect()}
    terms = {"1": ["token", "ledger", "token"], "2": ["ledger", "snapshots"], "3": ["gettoken", "get", "token", "value"]}
    n, avg = 3, 3.0
    for d, t in terms.items():
        want = 0.0
        for w in ("token", "ledger"):
            df, tf = sum(w in x for x in terms.values()), t.count(w)
            want += np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * len(t) / avg))
        assert got[d] == pytest.approx(want, abs=1e-6)
    assert set(got) == {"1", "2", "3"}


def test_predicates(spark, post):
    assert values(search.boolean(post, must=["ledger"], must_not=["token"]), "doc") == [("2",)]
    assert values(search.wildcard(post, "get*"), "doc") == [("3",)]
    assert values(search.fuzzy(post, "tokem"), "doc") == [("1",), ("3",)]
    docs = spark.createDataFrame(DOCS, "id string, text string")
    # analysed terms: stop words don't stand between
    assert values(search.phrase(docs, {"text": F.col("text"), "id": F.col("id")}, "Ledger's of snapshots"), "doc", "fields") == [("2", "text")]
    assert search.phrase(docs, {"text": F.col("text")}, "the of").count() == 0
    assert search.match_all(docs).count() == 5
    with pytest.raises(ValueError, match="wants"):
        search.boolean(post, must_not=["a"])
    with pytest.raises(ValueError, match="blank"):
        search.metadata_filter(language=[" "])


def test_blocks_hold_every_query_and_document(spark, tmp_path, monkeypatch):
    """Small blocks and slices give what all scores, one after the other, give; ties go by doc."""
    monkeypatch.setattr(search, "DOCS", 7)
    monkeypatch.setattr(search, "QUERIES", 2)
    r = random.Random(4)
    words = [f"w{chr(97 + i)}x" for i in range(12)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 9))), r.choice(words), None) for i in range(60)] + [(100 + i, "wax wbx", "wcx", "clash") for i in range(5)]
    ix = search.build_index(spark.createDataFrame(rows, "id long, text string, name string, score string"), {"content": F.col("text"), "entity_name": F.col("name")}, f"file://{tmp_path}/index")
    asked = [(i, " ".join(r.sample(words, 4))) for i in range(9)] + [(50, None), (51, "nowhere")]
    got = values(search.keyword_search(ix, spark.createDataFrame(asked, "query_id long, text string"), 10), "query_id", "doc", "score")
    n = {f: sum(1 for _ in rows) for f in ("content", "entity_name")}
    want = []
    for q, t in asked:
        found = []
        for d, text, name, _ in rows:
            total = 0.0
            for f, words_of, boost in (("content", [x[1].split() for x in rows], 1.0), ("entity_name", [[x[2]] for x in rows], 3.0)):
                own, avg = (text.split() if f == "content" else [name]), sum(map(len, words_of)) / n[f]
                for w in set((t or "").split()):
                    df, tf = sum(w in x for x in words_of), own.count(w)
                    if tf:
                        total += boost * np.log(1 + (n[f] - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len(own) / avg))
            if total:
                found.append((-round(total, 6), d))
        want += [(q, d, -x) for x, d in sorted(found)[:10]]
    assert [(q, d) for q, d, _ in got] == sorted((q, d) for q, d, _ in want)
    assert [x for *_, x in got] == pytest.approx([x for *_, x in sorted(want)], abs=2e-6)


def test_words_are_the_terms(spark):
    """The index's own analyser gives what the column function gives, also for signs of other scripts."""
    from trovework.functions.text import Words, terms

    r = random.Random(9)
    signs = "aabXYZz019__  .'’sS\n-ßÄéΣσςĞıİдЖ語自ªǅ²Ⅷ½٣\u0301\u200b𝐀𝟘"
    texts = ["", "it's the Getter's end's", "getHTTPResponse2xx_v10 XMLs", "a's's b's\n", *("".join(r.choice(signs) for _ in range(r.randint(1, 40))) for _ in range(3000))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", terms(F.col("t")).alias("x")).collect()
    w = Words()
    assert {x["i"]: x["x"] for x in rows} == {i: [w.terms[n] for n in w.of(t)] for i, t in enumerate(texts)}


def test_index_has_a_list_a_term(spark, tmp_path):
    """No row for each posting is shuffled or written: a block of documents has one list for a term, and rows of a document count together."""
    rows = [(str(i), "token ledger") for i in range(500)] + [("0", "token ledger"), ("1", "token"), ("2", None)]
    docs = spark.createDataFrame(rows, "id string, text string").coalesce(1)
    ix = search.build_index(docs, {"content": F.col("text")}, f"file://{tmp_path}/index")
    assert ix.lists.count() <= 2 * ix.docs.count()
    assert values(ix.words, "field", "term", "df", "cf") == [("content", "ledger", 500, 501), ("content", "token", 501, 502)]
    assert values(ix.stats, "field", "n") == [("content", 501)]
    assert values(ix.post.where("doc in ('0', '1')"), "doc", "term", "tf") == [("0", "ledger", 2), ("0", "token", 2), ("1", "ledger", 1), ("1", "token", 1), ("1", "token", 1)]


def test_texts_of_stored_documents_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Only rows whose key is in several rows are shuffled with their texts; the index is the same."""
    rows = [(str(i), f"token ledger w{chr(97 + i % 20)}") for i in range(200)] + [("0", "token ledger wa"), ("1", "token"), (None, "ledger"), (None, "ledger token"), ("2", None)]
    spark.createDataFrame(rows, "id string, text string").repartition(3).write.parquet(f"file://{tmp_path}/docs")
    docs, fields = spark.read.parquet(f"file://{tmp_path}/docs"), {"content": F.col("text")}
    plan = lambda d: search._gathered(d, fields, "id", True)._jdf.queryExecution().sparkPlan().toString()
    assert "ObjectHashAggregate" not in plan(docs.where("id > '3'")) and "LeftSemi" in plan(docs)
    seen = []
    for name, stored, most in (("all", False, 9), ("some", True, 9), ("many", True, 1)):
        monkeypatch.setattr(search, "MOST_REPEATED", most)
        ix = search.build_index(docs, fields, f"file://{tmp_path}/{name}", stored=stored)
        seen.append((values(ix.words, "field", "term", "df", "cf"), values(ix.stats, "field", "n", "avgdl"), sorted(values(ix.post.fillna("none"), "doc", "term", "tf"))))
    assert seen[0] == seen[1] == seen[2]
    assert search.build_index(docs.limit(0), fields, f"file://{tmp_path}/none", stored=True).blocks.count() == 0


def test_lists_are_not_shuffled(spark, index):
    """A block is one row from the task that made it to the task that searches it; only the best documents of each task are shuffled."""
    assert index.blocks.count() == index.docs.count()
    q = spark.createDataFrame([("a", "token ledger"), ("b", "value")], "query_id string, text string")
    plan = search.keyword_search(index, q)._jdf.queryExecution().sparkPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    assert search.keyword_search(index, q, 10, spark.createDataFrame([("1",)], "doc string"))._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin") == 1


def test_best_of_blocks_with_and_without_matrices(spark, tmp_path, monkeypatch):
    """The k best over many blocks of a task are those of one block, ties by doc, whichever terms are scored by a product."""
    r = random.Random(5)
    docs = spark.createDataFrame([(f"d{i:03}", " ".join(r.choice(("wax", "wbx", "wcx", "wdx")) for _ in range(r.randint(1, 4)))) for i in range(300)], "id string, text string").coalesce(1)
    q = spark.createDataFrame([(i, t) for i, t in enumerate(("wax", "wbx wcx", "wax wbx wcx wdx", "wdx"))], "query_id long, text string")
    got = []
    for size, dense in ((8192, 10**9), (8192, -1), (6, 10**9), (6, -1)):
        monkeypatch.setattr(search, "DOCS", size)
        monkeypatch.setattr(search, "DENSE", dense)
        got.append(values(search.keyword_search(search.build_index(docs, {"content": F.col("text")}, f"file://{tmp_path}/{size}{dense}"), q, 5), "query_id", "doc", "score", "rank"))
    assert len(got[0]) == 20 and all(x == got[0] for x in got[1:])


def test_queries_in_groups(spark, index, monkeypatch):
    """Queries whose terms don't fit at once are answered in groups, with filter and fields, and are the same."""
    q = spark.createDataFrame([(c, t) for c, t in zip("abcdef", ("token ledger", "value", "snapshots", "token", None, "ledger get"))], "query_id string, text string")
    docs = spark.createDataFrame([("1",), ("3",)], "doc string")
    ask = lambda: (values(search.keyword_search(index, q), "query_id", "doc", "score"), values(search.keyword_search(index, q, 10, docs), "query_id", "doc"), values(search.field_match(index, q, search.keyword_search(index, q)), "query_id", "doc", "matched_fields"))
    whole = ask()
    assert whole[1] == [("a", "1"), ("a", "3"), ("b", "3"), ("d", "1"), ("d", "3"), ("f", "1"), ("f", "3")]
    assert [x[:2] for x in whole[2]] == [x[:2] for x in whole[0]]
    monkeypatch.setattr(search, "QUERY_TERMS", 2)
    assert ask() == whole


def test_empty_corpus(spark, tmp_path):
    p = search.build_index(spark.createDataFrame([], "id string, text string"), {"content": F.col("text")}, f"file://{tmp_path}/index")
    q = spark.createDataFrame([("q", "token"), ("r", None), ("s", "")], "query_id string, text string")
    assert search.keyword_search(p, q).count() == 0
    assert search.facets(spark.createDataFrame([], "language string"), ["language"]).count() == 0


def test_orchestrated_search(spark, index):
    chunks_of = spark.createDataFrame([("1", "A"), ("3", "B"), ("9", "C"), ("9", "C"), ("8", "D")], "id string, entity_name string")
    edges = spark.createDataFrame([("A", "B"), ("B", "C"), ("A", "C")], "src string, dst string")
    q = spark.createDataFrame([("q", "token")], "query_id string, text string")
    got = search.orchestrate(index, chunks_of, q, edges, spark.createDataFrame([("q", "A")], "query_id string, name string"))
    # a hit stays a hit; what the closure adds has score 1 and the shortest path
    assert values(got, "doc", "is_transitive", "path") == [("1", False, None), ("3", False, None), ("9", True, "A>C")]


def test_facets_leave_out_blanks_and_break_ties_by_value(spark):
    df = spark.createDataFrame([("b",), ("a",), (" ",), (None,), ("c",), ("c",)], "language string")
    assert [(r["value"], r["count"]) for r in search.facets(df, ["language"], 2).orderBy("rank").collect()] == [("c", 2), ("a", 1)]


def vectors(spark, n, dim=8, seed=1):
    r = np.random.default_rng(seed)
    return spark.createDataFrame([(i, [float(x) for x in r.normal(size=dim)]) for i in range(n)], "vec_id long, embedding array<double>")


def test_nearest_by_brute_force(spark):
    v = vectors(spark, 120)
    got = {(r["query_id"], r["doc"]) for r in search.nearest(v, v.where("vec_id % 20 = 0"), 5, threshold=-1, block=50).collect()}
    x = np.array([r["embedding"] for r in v.orderBy("vec_id").collect()])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert got == {(q, int(d)) for q in range(0, 120, 20) for d in np.argsort(-(x @ x[q]), kind="stable")[:5]}


def test_nearest_with_odd_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0]), (5, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert values(search.nearest(v, v.where("vec_id in (1, 2)"), 3), "query_id", "doc") == [(1, 1), (1, 4)]


def test_cells_find_nearly_all(spark):
    v = vectors(spark, 400, dim=32)  # without clusters
    q = v.where("vec_id % 20 = 0")
    fitted = search.fit_cells(v, k=5)
    r = search.recall(search.nearest(v, q, 5, threshold=-1), search.nearest_by_cells(v, q, fitted, 5, salt=64)).first()
    assert r["recall"] >= 0.9 and fitted.probes < len(fitted.centres)
    assert search.fit_cells(v.limit(0)).probes == 1


def test_merge_and_page(spark):
    k = spark.createDataFrame([("q", "A", 0.8)], "query_id string, doc string, score double")
    v = spark.createDataFrame([("q", "A", 0.9), ("q", "B", 0.5)], k.schema)
    m = search.merge(k, v)
    assert [(r["doc"], round(r["score"], 9), r["both"]) for r in m.orderBy("doc").collect()] == [("A", 0.84, True), ("B", 0.5, False)]
    assert values(search.with_closure(m, spark.createDataFrame([("q", "B"), ("q", "C")], "query_id string, doc string")), "doc", "score")[-1] == ("C", 1.0)
    p = search.page(m, 1, 1).collect()
    assert [(r["doc"], r["total"], r["page"]) for r in p] == [("B", 2, 1)]
    for bad in ({"limit": 0}, {"limit": 101}, {"offset": -1}, {"depth": 11}):
        with pytest.raises(ValueError, match="must"):
            search.check_request(**bad)


def test_hybrid_modes(spark):
    k = spark.createDataFrame([("q", "A", 3.0), ("q", "B", 1.0)], "query_id string, doc string, score double")
    v = spark.createDataFrame([("q", "C", 0.9)], k.schema)
    assert values(search.hybrid(k, v, "keyword"), "doc", "score") == [("A", 1.0), ("B", 0.0)]
    assert values(search.hybrid(k, v, "vector"), "doc", "score") == [("C", 1.0)]
    assert values(search.hybrid(k, v, None), "doc") == [("A",), ("B",), ("C",)]


def test_hot_query(spark):
    """A query that matches all rows gets the same as brute force."""
    r = random.Random(3)
    rows = [("q", f"d{i:04}", r.choice([0.1, 0.5, 0.9])) for i in range(2000)]
    df = spark.createDataFrame(rows, "query_id string, doc string, score double").repartition(7)
    want = [d for _, d, s in sorted(rows, key=lambda x: (-x[2], x[1]))[:10]]
    assert [x["doc"] for x in search.top(df, 10).orderBy("rank").collect()] == want


def test_closure(spark):
    e = spark.createDataFrame([("I", "A"), ("A", "C"), ("C", "I"), ("I", "C"), (None, "x")], "src string, dst string")
    s = spark.createDataFrame([("I",)], "n string")
    assert values(graph.closure(e, s, 1), "name", "depth") == [("A", 1), ("C", 1)]
    assert values(graph.closure(e, s, 99, itself=True), "name", "depth") == [("A", 1), ("C", 1), ("I", 0)]
    assert values(graph.closure(e, spark.createDataFrame([("none",)], "n string")), "name") == []


def test_detected_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "0"), ("g", "0")], "path string, hash string")
    new = spark.createDataFrame([("a", "9"), ("b", "2"), ("e", "3"), ("f", "0")], old.schema)
    got = values(changes.detect(old, new).fillna(""), "change_type", "file_path", "old_path")
    assert got == [("ADDED", "f", ""), ("DELETED", "d", ""), ("DELETED", "g", ""), ("MODIFIED", "a", ""), ("RENAMED", "e", "c")]
    assert changes.detect(old.limit(0), new.limit(0)).count() == 0


FEED = "change_id long, change_type string, file_path string, old_path string, repository string, commit_sha string, changed_at timestamp, received_at timestamp"


def test_similar_files_by_brute_force(spark):
    r = random.Random(6)
    text = lambda: [f"line {r.randint(0, 25)}" for _ in range(r.randint(1, 14))]
    old = {f"o{i}": text() for i in range(40)} | {"oe": [], "os": ["}", "{"]}
    new = {f"n{i}": ([x for x in old[f"o{i}"] if r.random() < 0.8] + text()[:3] if i < 15 else text()) for i in range(40)} | {"ne": [" "], "ns": ["{", "}"]}
    frame = lambda d: spark.createDataFrame([(p, "\n".join(x), "clash") for p, x in d.items()] + [(None, "x", "y"), ("null", None, None)], "path string, content string, line string")
    got = {(x["old_path"], x["file_path"]): round(x["similarity"], 9) for x in changes.similar(frame(old), frame(new)).collect()}
    sets = lambda d: {p: {y.strip() for y in x if y.strip()} for p, x in d.items()}
    a, b = sets(old), sets(new)
    sim = {(p, q): len(x & y) / max(len(x), len(y)) for p, x in a.items() for q, y in b.items() if x & y}
    sim = {k: v for k, v in sim.items() if v >= 0.5}
    want = {(p, q): round(v, 9) for (p, q), v in sim.items() if (-v, p) == min((-z, i) for (i, j), z in sim.items() if j == q) and (-v, q) == min((-z, j) for (i, j), z in sim.items() if i == p)}
    assert got == want and len(want) > 8
    assert changes.similar(frame(old).limit(0), frame(new)).count() == 0


def test_applied_changes(spark):
    t = lambda d: datetime(2025, 2, d)
    feed = spark.createDataFrame([(1, "added", "a", None, "r", "s1", t(1), t(1)), (1, "added", "a", None, "r", "s1", t(1), t(2)), (2, "RENAMED", "b", "a", "r", "s2", t(2), t(9)), (3, "DELETED", "c", None, None, "s3", t(3), t(3)), (4, "odd", "d", None, "r", "s4", t(4), t(4))], FEED)
    table = spark.createDataFrame([chunk("1", path="a"), chunk("2", path="b"), chunk("3", path="c"), chunk("4", path="d")], CHUNK)
    assert values(changes.last_state(feed), "path", "alive") == [("a", False), ("b", True), ("c", False)]
    assert values(changes.apply(table, feed), "id") == [("2",), ("4",)]
    fresh = spark.createDataFrame([chunk("5", path="b"), chunk("6", path="d")], CHUNK)
    assert values(changes.apply(table, feed, fresh), "id") == [("4",), ("5",)]
    assert values(changes.index_state(feed), "repository", "commit_sha", "changes") == [("r", "s2", 2)]
    assert values(changes.apply(table, feed.limit(0)), "id") == [("1",), ("2",), ("3",), ("4",)]


def test_selection_of_the_survey(spark):
    rows = [("q", f"c{i}", f, 1.0 - i / 10, 250) for i, f in enumerate(("f1", "f1", "f2", "f3"))]
    df = spark.createDataFrame(rows, "query_id string, doc string, source_file string, score double, n_tokens int")
    got = rag.choose(df, rag.budget(1000, 100, 100)).orderBy("position").collect()
    assert [r["doc"] for r in got] == ["c0", "c2"]
    c = spark.createDataFrame([chunk("c0", "def f(): pass\n")], CHUNK)
    assert rag.context(rag.choose(df, 300), c).first()["context"] == "[Source: o/r/a.py - f() (lines 1-2)]\n```python\ndef f(): pass\n```"


def greedy(rows, tokens):
    left, taken, seen, later = tokens, [], set(), []
    for doc, f, score, n in sorted(rows, key=lambda r: (-r[2], r[0])):
        if f in seen:
            later.append((doc, n))
        elif n <= left:
            left -= n
            taken.append(doc)
            seen.add(f)
    for doc, n in later:
        if n <= left:
            left -= n
            taken.append(doc)
    return taken


def test_selection_walks_all_candidates(spark):
    r = random.Random(4)
    rows = [("few", f"c{i:03}", "big" if i < 130 else f"f{i}", 1.0 - i / 1000, 290 if i < 130 else 5) for i in range(140)]
    for q in range(12):
        rows += [(None if q == 3 else f"q{q}", f"d{i}", f"f{r.randrange(1 + 9 * q)}", r.randrange(50) / 50, r.choice([0, 1, 2, 7, 30, 90, 400])) for i in range(40 * q)]
    df = spark.createDataFrame(rows, "query_id string, doc string, source_file string, score double, n_tokens int").repartition(3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (7, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = {}
            for x in rag.choose(df, 300).orderBy("position").collect():
                got.setdefault(x["query_id"], []).append(x["doc"])
            assert got == {q: greedy([x[1:] for x in rows if x[0] == q], 300) for q in {x[0] for x in rows}}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got["few"] == ["c000", "c130", "c131"] and rag.choose(df, -1).count() == rag.choose(df.limit(0), 300).count() == 0


def test_prompt_and_sources(spark):
    df = spark.createDataFrame([("c", "q?")], "c string, q string")
    assert df.select(rag.render("{{context}} / {{question}}", F.col("c"), F.col("q"))).first()[0] == "c / q?"
    with pytest.raises(ValueError, match="lacks"):
        rag.render("{{context}}", F.col("c"), F.col("q"))
    chosen = spark.createDataFrame([(1, "a", 1, 2)], "k int, file string, start_line int, end_line int")
    found = spark.createDataFrame([(1, "a", 1, 2), (1, "b", 3, 3), (1, "b", 3, 3)], chosen.schema)
    assert values(rag.sources(chosen, found, "k"), "file", "kind") == [("a", "context"), ("b", "citation")]
    tokens = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "k int, seq int, token string")
    assert rag.assemble(tokens, "k").first()["answer"] == "ab"


def test_quality(spark):
    r = spark.createDataFrame([("q", str(i), i) for i in range(1, 6)], "query_id string, doc string, rank int")
    rel = spark.createDataFrame([("q", "1"), ("q", "3"), ("q", "5"), ("q", "99")], "query_id string, doc string")
    x = metrics.ranked_quality(r, rel).first()
    assert (x["p_at_5"], x["p_at_10"], x["recall"]) == (0.6, 0.6, 0.75)
    assert [metrics.improvement(a, b) for a, b in ((0, 1), (0, 0), (0.4, 0.6))] == [100.0, 0.0, pytest.approx(50.0)]
    q = spark.createDataFrame([("q", "keyword", 0.5), ("q", "hybrid", 0.5), ("r", "vector", 0.9), ("r", "hybrid", 0.1)], "query_id string, mode string, p_at_10 double")
    assert values(metrics.best_mode(q), "query_id", "mode") == [("q", "hybrid"), ("r", "vector")]
    assert metrics.recommended_weights(0.9, 0.2, 0.5) == (0.7, 0.3)


def test_repositories(spark):
    df = spark.createDataFrame([("https://github.com/o/r.git",), ("git@gitlab.com:g/s/r.git",), ("https://h/scm/p/r.git",), ("x",), (None,)], "u string")
    got = df.select(repositories.client(F.col("u")).alias("c"), repositories.owner(F.col("u")).alias("o"), repositories.name(F.col("u")).alias("n")).collect()
    assert [tuple(r) for r in got] == [("github", "o", "r"), ("gitlab", "g/s", "r"), ("bitbucket_server", "p", "r"), ("unknown", None, None), ("unknown", None, None)]
    j = spark.createDataFrame([('{"name": "r", "owner": {"login": "o"}}',), ("broken",)], "json string")
    assert [r["default_branch"] for r in repositories.metadata(j).collect()] == ["main", "main"]


def test_scan(spark, tmp_path):
    for p, t in (("a/__init__.py", "x = 1"), ("a/.hidden.py", ""), (".git/b.py", ""), ("c.md", ""), ("d/e.go", "package d")):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    assert values(repositories.scan(spark, str(tmp_path)), "path", "content") == [("a/__init__.py", "x = 1"), ("d/e.go", "package d")]


@pytest.mark.parametrize(
    ("path", "source", "want"),
    [
        ("A.java", "public final class A extends B implements C, D {\n  int f(int x) {\n    if (x) {\n", [("class", "A"), ("function", "f")]),
        ("a.py", "class A:\n    async def f(self):\n", [("class", "A"), ("function", "f")]),
        ("a.go", "type S struct {\n}\nfunc (s *S) F() {\n", [("type", "S"), ("function", "F")]),
        ("a.rs", "pub trait T {\n    pub fn f() {}\n", [("trait", "T"), ("function", "f")]),
        ("a.rb", "module M\n  def self.f(x)\n", [("module", "M"), ("function", "f")]),
        ("a.kt", "data class K(val x: Int)\nsuspend fun f() {\n", [("class", "K"), ("function", "f")]),
        ("a.unknown", "class X", []),
    ],
)
def test_declarations(spark, path, source, want):
    df = spark.createDataFrame([chunk("i", source, path)], CHUNK)
    got = entities.declarations(df).orderBy("line_no").collect()
    assert [(r["kind"], r["name"]) for r in got] == want


def test_extents(spark):
    java = 'class A {\n  // }\n  int f(int a) {\n    String s = "}";\n    if (a) {\n    }\n    return 1;\n  }\n\n  class B {\n    int g(int x) { return 1; }\n    void h() {\n    }\n  }\n}\n'
    py = "class A:\n    def f(self):\n        if x:\n            y = 1\n\n        return 2\n\n    def g(self):\n        pass\n\n\ndef h():\n    return 1\n"
    df = spark.createDataFrame([chunk("j", java, path="A.java"), chunk("p", py, path="a.py"), chunk("n", None), chunk("e", "")], CHUNK)
    assert values(entities.extents(df), "id", "line_no", "end_line", "qualified") == [
        ("j", 1, 15, "A"), ("j", 3, 8, "A.f"), ("j", 10, 14, "A.B"), ("j", 12, 13, "A.B.h"), ("p", 1, 9, "A"), ("p", 2, 6, "A.f"), ("p", 8, 9, "A.g"), ("p", 12, 13, "h")]
    assert entities.extents(df.limit(0)).count() == 0


def test_inheritance(spark):
    df = spark.createDataFrame([chunk("i", "class A extends B implements C, D {\n", "A.java")], CHUNK)
    assert values(entities.inheritance(entities.declarations(df)), "src", "dst", "relation", "label") == [("B", "A", "EXTENDS", "class"), ("C", "A", "IMPLEMENTS", "class"), ("D", "A", "IMPLEMENTS", "class")]
    src = "// class Gone extends Lost\n/* class Gone2 */\ninterface I extends J\nclass K implements I {\nclass L extends K {\n"
    found = entities.declarations(spark.createDataFrame([chunk("i", src, "A.java")], CHUNK))
    assert values(found, "line_no", "name") == [(3, "I"), (4, "K"), (5, "L")]
    e, names = entities.inheritance(found), spark.createDataFrame([("I",), ("K",), ("J",)], "name string")
    assert values(graph.implementations(e, names), "start", "name") == [("I", "K"), ("I", "L")]
    assert values(graph.subclasses(e, names), "start", "name") == [("K", "L")]
    assert values(graph.usages(e, names), "start", "name") == [("I", "I"), ("I", "K"), ("I", "L"), ("J", "J"), ("K", "K"), ("K", "L")]


def test_dual_write(spark, tmp_path):
    """Only chunks with an embedding reach the vectors; all reach the index."""
    df = spark.createDataFrame([chunk("a", "token ledger"), chunk("b", "the"), chunk("c", "ledger")], CHUNK)
    both = search.index_both(df, f"file://{tmp_path}/both", lambda t: F.when(F.length(t) > 3, F.array(F.lit(1.0), F.lit(0.0))), 2)
    assert values(both.index.post.where("field = 'content'").select("doc").distinct(), "doc") == [("a",), ("c",)]
    assert values(both.vectors, "id") == [("a",), ("c",)]


def test_state_store(spark, tmp_path):
    """The last state saved of a repository is the one found; deleted ones are gone."""
    at = f"file://{tmp_path}/states"
    one = spark.createDataFrame([("r", "c1", datetime(2025, 1, 1)), ("s", "c2", datetime(2025, 1, 1))], "repository string, commit_sha string, changed_at timestamp")
    changes.save_states(one, at)
    changes.save_states(spark.createDataFrame([("r", "c9", datetime(2025, 1, 2))], one.schema), at)
    assert values(changes.find_states(spark, at), "repository", "commit_sha") == [("r", "c9"), ("s", "c2")]
    changes.delete_states(spark.createDataFrame([("s",)], "repository string"), at)
    assert values(changes.find_states(spark, at), "repository", "commit_sha") == [("r", "c9")]
    changes.save_states(one, at)
    assert values(changes.find_states(spark, at), "repository", "commit_sha") == [("r", "c1"), ("s", "c2")]
