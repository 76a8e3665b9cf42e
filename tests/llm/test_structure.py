import pytest

from trovework.llm import splitting
from trovework.llm import structure as S

TABLE = "id string, content string, source_file string, language string, entity_type string, entity_name string, start_line int, end_line int, pos int, line int"
RESULTS = "source_file string, entity_name string, start_line int, end_line int, doc_summary string"


def frame(spark, *rows):
    return spark.createDataFrame([(*r, 0, 0) for r in rows], TABLE)


def chunk(i, text, path="a.py", kind="module", name="m"):
    return (i, text, path, None, kind, name, 1, 9)


@pytest.mark.parametrize(
    ("path", "text", "names"),
    [
        ("a.java", "class A {\n  /** Reads two lines of it. */\n  @Override\n  public int f(int a) {\n    Runnable r = new Runnable() { public void run() { } };\n    return 1;\n  }\n  int g();\n}", ["f"]),
        ("a.py", 'class A:\n    """Holds the values."""\n    def f(self):\n        """Reads two lines."""\n        def h():\n            """Inner one of it."""\n            return 1\n        return h\n\n    def g(self):\n        return 1\n', ["f"]),
        ("a.js", "// Sorts the rows by size.\nexport const f = (a) => {\n  return a;\n};\n\n// lost\n\nfunction g() {}\n", ["f"]),
        ("a.go", "// F waits for the lock.\nfunc (s *S) F(x int) error {\n\treturn nil\n}\n// G is here\n\nfunc G() {}\n", ["F"]),
        ("a.rs", "impl A {\n    /// Drops stale rows.\n    #[inline]\n    pub fn f(&self) -> usize { 1 }\n    fn g();\n}", ["f"]),
        ("a.rb", "class A\n  # Drops stale rows.\n  def f(x)\n    if x\n      1\n    end\n  end\n\n  def g\n  end\nend\n", ["f"]),
        ("a.php", "<?php\nclass A {\n    /** Drops stale rows. */\n    public function f(string $a): int {\n        return 1;\n    }\n}", ["f"]),
        ("a.kt", "/** Drops stale rows. */\nfun f(x: Int): Int = x + 1\n", ["f"]),
        ("a.cpp", "/// Drops stale rows.\nint A::f(const std::string& x) const {\n  if (x) {\n  }\n}\n// int y = f(x);\nint g() {\n}\n", ["f"]),
        ("a.scala", "// Drops stale rows.\ndef f(x: Int): Int = {\n  x\n}\n", ["f"]),
        ("a.swift", "/// Drops stale rows.\npublic func f(_ x: Int) -> Int {\n}\n", ["f"]),
        ("a.cs", "/// <summary>\n/// Drops stale rows.\n/// </summary>\n[Obsolete]\npublic static int F(int x) {\n}\n", ["F"]),
    ],
)
def test_documented(spark, path, text, names):
    df = frame(spark, chunk("1", text, path), chunk("1", text, path))
    none = spark.createDataFrame([], RESULTS)
    assert sorted(r["func_name"] for r in S.functions_with_docs(df, none).collect()) == names


@pytest.mark.parametrize("doc", ["# TODO: document", "# Reads lines.", "# read_lines", "# ----", "# @param x", "# x = read(y)", "# n/a", "# See above.", "# Function read_lines", "# Copyright 2024 the contributors"])
def test_trivial(spark, doc):
    df = frame(spark, chunk("1", f"{doc}\ndef read_lines(x):\n    return 1\n"))
    assert S.functions_with_docs(df, spark.createDataFrame([], RESULTS)).count() == 0


def test_strings_hold_no_functions(spark):
    df = frame(spark, chunk("1", 'def f():\n    t = """\n    # Reads two rows.\n    def g(x):\n        return 1\n    """\n    return t\n'))
    assert S.functions_with_docs(df, spark.createDataFrame([], RESULTS)).count() == 0


def test_summaries_of_results(spark):
    text = "def f(x):\n    return 1\n"
    df = frame(spark, chunk("1", text, kind="FUNCTION", name="m.f"), chunk("2", text, "b.py", "function", "f"), chunk("3", None), chunk("4", ""), chunk("5", text, "c.unknown", "function", "f"))
    results = spark.createDataFrame([("a.py", "m.f", 1, 9, "Waits for the lock."), ("a.py", "m.f", 1, 9, None), ("b.py", "f", 1, 9, "TODO"), ("b.py", "f", 1, 9, " "), (None, None, None, None, "x")], RESULTS)
    assert [(r["id"], r["func_name"], r["doc"]) for r in S.pairs(df, results).collect()] == [("1", "f", "Waits for the lock.")]
    assert S.pairs(df.limit(0), results.limit(0)).count() == 0


def test_pairs_have_code_and_documentation(spark):
    text = "class A {\n    // Waits for the lock.\n    int f(int a) {\n        return 1;\n    }\n}"
    r = S.pairs(frame(spark, chunk("1", text, "A.java")), spark.createDataFrame([], RESULTS)).first()
    assert r["doc"] == "// Waits for the lock." and r["code"] == "int f(int a) {\n        return 1;\n    }"


# --- splitting ---


def big(n=300, doc=True):
    return "class A:\n" + "".join((f"    # Row {i} of it.\n" if doc else "") + f"    def f{i}(self):\n        x = {i}\n        return x\n\n" for i in range(n))


def greedy(text, members, limit=4000, overlap=200):
    """The cuts one after the other."""
    lines, at = [], 0
    for x in text.split("\n"):
        lines.append((at, len(x) + 1))
        at += len(x) + 1
    bounds = sorted({p for s, n in lines for p in range(s, s + max(n - 2, 0) + 1, limit - overlap)})
    cut = [0]
    while len(text) - cut[-1] > (limit if len(cut) == 1 else limit - overlap):
        reach = cut[-1] + (limit if len(cut) == 1 else limit - overlap)
        inside = [m for m in members if cut[-1] < m <= reach] or [b for b in bounds if cut[-1] < b <= reach]
        cut.append(max(inside))
    return cut


def test_members(spark):
    df = frame(spark, chunk("1", big(), kind="class", name="A"), chunk("2", "x", kind="class"), chunk("3", big(), kind="method", name="A.f"))
    got = {(r["id"], r["line_no"]) for r in splitting.member_starts(df).collect()}
    assert got == {("1", 2 + 5 * i) for i in range(300)}
    far = frame(spark, chunk("1", big(2) + "x = 1\n" * 9_000 + "z" * 9_000 + "\n" + big(2)[9:], kind="class", name="A"))  # members out of each other's reach
    assert len(splitting.member_starts(far).collect()) == 4


@pytest.mark.parametrize("text", [big(), "y" * 15_000, "a b\n" * 3_000, big(60) + "z" * 9_000 + "\n" + big(40, False), "é\r\n" * 5_000])
def test_cuts_by_brute_force(spark, text):
    df = frame(spark, chunk("1", text, kind="class", name="A"), chunk("1", text, kind="class", name="A"), chunk("n", None), chunk("e", ""))
    members = [r["at"] for r in splitting.members(df).collect()]
    want = greedy(text, members)
    pieces = splitting.split(df).orderBy("piece").collect()
    assert len(pieces) == len(want)
    whole = ""
    for p in pieces:
        assert len(p["content"]) <= 4000
        if whole:
            assert p["content"][:200] == whole[-200:]
        start = len(whole) - (200 if whole else 0)
        assert p["start_line"] == 1 + text.count("\n", 0, start)
        whole += p["content"][200 if whole else 0 :]
        assert p["end_line"] == 1 + text.count("\n", 0, len(whole) - 1)
    assert whole == text and splitting.split(df.limit(0)).count() == 0
