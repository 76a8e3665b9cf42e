import pytest
from pyspark.sql import functions as F

from trovework.functions import scores, text


def one(spark, column, **values):
    names = list(values)
    kinds = ", ".join(f"{n} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}" for n, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column).first()[0]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("getUserName", ["getusername", "get", "user", "name"]),
        ("snake_case_name", ["snake_case_name", "snake", "case", "name"][:2] + ["name"]),
        ("XMLHttpRequest", ["xmlhttprequest", "xml", "http", "request"]),
        ("utf8", ["utf8", "utf"]),
        ("the class of foo", ["foo"]),
        ("package", ["package"]),
        ("", []),
        ("...", []),
    ],
)
def test_terms(spark, given, want):
    assert one(spark, text.terms(F.col("t")), t=given) == want


def test_terms_of_null(spark):
    assert one(spark, text.terms(F.col("t")), t=None) is None


@pytest.mark.parametrize(
    ("path", "want"),
    [("github.com/Owner/Repo/a.py", "repo"), ("Repo/src/a.py", "repo"), ("owner/repo/file.py", "repo"), ("repo/file.py", "repo"), ("file.py", "unknown"), ("", "unknown"), (None, "unknown")],
)
def test_repository(spark, path, want):
    assert one(spark, text.repository_of(F.col("p")), p=path) == want


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ("see [Source: a/b.py:10-12]", [("a/b.py", 10, 12)]),
        ("[Source: c:/x.py:7]", [("c:/x.py", 7, 7)]),
        ("[Source: x.py:0] [Source: x.py:9-3] [Source: x.py]", []),
        ("none", []),
    ],
)
def test_citations(spark, answer, want):
    assert [tuple(c) for c in one(spark, text.citations(F.col("t")), t=answer)] == want


@pytest.mark.parametrize(("message", "want"), [("Failed to clone", "CLONING"), ("Parsed file 1/2", "PARSING"), ("Indexing completed successfully", "COMPLETE"), ("Starting indexing", "INDEXING"), ("an error", "FAILED"), (None, "INDEXING")])
def test_stage(spark, message, want):
    assert one(spark, text.stage_of(F.col("m")), m=message) == want


@pytest.mark.parametrize(("q", "kind"), [("", "all"), (None, "all"), ("extends:Foo bar", "structural"), ("language:java", "field"), ("get*", "wildcard"), ('"a b"', "phrase"), ("a b", "words")])
def test_query_kind(spark, q, kind):
    assert one(spark, text.query_kind(F.col("q")), q=q) == kind


def test_structural_target(spark):
    assert one(spark, text.structural_target(F.col("q")), q="implements: Reader now") == "Reader"
    assert one(spark, text.structural_target(F.col("q")), q="implements: ") is None


def test_embedding_text(spark):
    assert one(spark, text.embedding_text(F.col("t"), F.lit("Java")), t="a  b\n c") == "java: a b c"
    assert one(spark, text.embedding_text(F.col("t"), F.lit("go")), t=None) == ""
    long = one(spark, text.embedding_text(F.col("t"), F.lit("go")), t="word " * 1000)
    assert len(long) <= 2048 + 4 and long.endswith("word")
    assert len(one(spark, text.embedding_text(F.col("t"), F.lit("go")), t="x" * 5000)) == 2048 + 4


def test_estimates(spark):
    assert one(spark, text.token_estimate(F.col("t")), t="12345") == 2
    assert one(spark, scores.token_cost_estimate(F.col("t")), t="") == 0
    assert one(spark, scores.token_cost_estimate(F.col("t")), t="a") == 1
    assert one(spark, text.context_window(F.col("m")), m="gpt-4-32k-x") == 32768
    assert one(spark, text.context_window(F.col("m")), m="other") == 8192


def test_cost(spark):
    row = spark.createDataFrame([("OpenAI", "gpt-4", 1000, 1000), ("x", "y", 5, 5), (None, None, None, None)], "p string, m string, i int, o int")
    assert [round(r[0], 9) for r in row.select(scores.cost(F.col("p"), F.col("m"), F.col("i"), F.col("o"))).collect()] == [0.09, 0.0, 0.0]


def test_combined(spark):
    assert round(one(spark, scores.combined(F.col("a"), F.col("b")), a=0.8, b=0.9), 9) == 0.84
    df = spark.createDataFrame([(None, 0.5)], "a double, b double")
    assert df.select(scores.combined(F.col("a"), F.col("b"))).first()[0] == 0.5
    with pytest.raises(ValueError, match="sum to 1"):
        scores.combined(F.lit(1), F.lit(1), 0.5, 0.6)


@pytest.mark.parametrize(("given", "want"), [([0.5, 0.8, 1.0], [0.0, 0.6, 1.0]), ([0.7, 0.7], [1.0, 1.0]), ([-2.0, -1.0], [0.0, 1.0]), ([3.0], [1.0]), ([], [])])
def test_min_max(spark, given, want):
    df = spark.createDataFrame([("q", float(x)) for x in given], "query_id string, score double")
    assert [round(r[0], 9) for r in scores.min_max(df, ["query_id"]).orderBy("score").select("score").collect()] == want


def test_masks_and_names(spark):
    assert one(spark, text.mask_key(F.col("k")), k="abc") == "***"
    assert one(spark, text.metadata_field(F.col("k")), k="Return-Type") == "meta_return_type"
    assert one(spark, text.snippet(F.col("t"), 2, 3), t="abcdef\nxy\nz") == "abc\nxy"
