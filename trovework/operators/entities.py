"""Declarations in source text by line patterns, one for each language, and the inheritance they state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trovework.operators.chunks import parser_of

_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|open|sealed|data|partial|override|export|default|async|pub|pub\(crate\)|unsafe|inline|virtual|case|implicit|lazy|fileprivate|const|readonly|suspend|mutating|declare)\s+)*"
_TYPED = r"^\s*(?:[\w<>\[\]:,&*]+\s+)+[*&]*(~?\w+)\s*\([^;{}]*\)[^;{}=]*\{\s*$"
#: Fixed values: (language, pattern of a type's line, pattern of a function's line); group 1 the kind, group 2 the name.
PATTERNS = (
    ("java", rf"^\s*{_MODS}(class|interface|enum|record)\s+(\w+)", "()" + _TYPED),
    ("csharp", rf"^\s*{_MODS}(class|interface|enum|record|struct)\s+(\w+)", "()" + _TYPED),
    ("cpp", r"^\s*(class|struct|enum|union)\s+(\w+)\s*[:{]", "()" + _TYPED),
    ("c", r"^\s*(?:typedef\s+)?(struct|enum|union)\s+(\w+)\s*\{", "()" + _TYPED),
    ("python", r"^\s*(class)\s+(\w+)", r"^\s*(?:async\s+)?(def)\s+(\w+)"),
    ("javascript", rf"^\s*{_MODS}(class)\s+(\w+)", rf"^\s*{_MODS}(function)\s*\*?\s*(\w+)"),
    ("typescript", rf"^\s*{_MODS}(class|interface|enum|type)\s+(\w+)", rf"^\s*{_MODS}(function)\s*\*?\s*(\w+)"),
    ("go", r"^\s*(type)\s+(\w+)\s", r"^\s*(func)\s*(?:\([^)]*\)\s*)?(\w+)"),
    ("rust", rf"^\s*{_MODS}(struct|enum|union|trait|impl|type)\s+(\w+)", rf"^\s*{_MODS}(fn)\s+(\w+)"),
    ("kotlin", rf"^\s*{_MODS}(class|interface|object|enum)\s+(\w+)", rf"^\s*{_MODS}(fun)\s+(\w+)"),
    ("scala", rf"^\s*{_MODS}(class|trait|object)\s+(\w+)", rf"^\s*{_MODS}(def)\s+(\w+)"),
    ("swift", rf"^\s*{_MODS}(class|struct|enum|protocol|extension)\s+(\w+)", rf"^\s*{_MODS}(func)\s+(\w+)"),
    ("ruby", r"^\s*(class|module)\s+(\w+)", r"^\s*(def)\s+(?:self\.)?(\w+)"),
    ("php", rf"^\s*{_MODS}(class|interface|trait|enum)\s+(\w+)", rf"^\s*{_MODS}(function)\s+(\w+)"),
)
#: Words that the pattern of typed functions also meets.
NOT_NAMES = ("if", "for", "while", "switch", "catch", "return", "else", "new", "do", "try", "using", "lock", "foreach", "synchronized")


#: A line that begins as a comment.
COMMENT = r"^\s*(?://|/\*|\*|#)"


def declarations(chunks: DataFrame) -> DataFrame:
    """id, line_no, kind, name and parents of each line that declares a type or function; lines that begin as comments are none."""
    p = chunks.sparkSession.createDataFrame(PATTERNS, "lang string, type_pattern string, function_pattern string")
    lines = chunks.select("id", parser_of(F.col("source_file")).alias("lang"), F.posexplode(F.split("content", "\n")).alias("n", "line")).where(F.col("line").rlike(r"\w") & ~F.col("line").rlike(COMMENT))
    j = lines.join(F.broadcast(p), "lang")  # as many rows as there are languages
    at = lambda pattern, g: F.expr(f"regexp_extract(line, {pattern}, {g})")
    j = j.withColumns({"t": at("type_pattern", 2), "f": at("function_pattern", 2)})
    kind = F.when(F.col("t") != "", F.lower(at("type_pattern", 1))).otherwise(F.lit("function"))
    name = F.when(F.col("t") != "", F.col("t")).otherwise(F.col("f"))
    parents = F.trim(F.regexp_extract("line", r"(?:\b(?:extends|implements)|:)\s+([\w.<>, ]+)", 0))
    out = j.select("id", (F.col("n") + 1).alias("line_no"), kind.alias("kind"), name.alias("name"), F.when(F.col("t") != "", parents).otherwise(F.lit("")).alias("parents"))
    return out.where((F.col("name") != "") & ~F.col("name").isin(*NOT_NAMES))


#: Literals and comments within a line, without escapes, whose braces don't count.
QUIET = r"\"[^\"]*\"|'[^']*'|//.*"
#: Kinds of declarations that others stand in.
TYPES = ("class", "interface", "enum", "record", "struct", "union", "trait", "impl", "object", "protocol", "extension", "module")


def extents(chunks: DataFrame) -> DataFrame:
    """id, line_no, kind, name, end_line and qualified (the names of the enclosing types and its own, with dots between) of each declaration.

    A declaration's level is the depth of braces before its line, in languages without braces its indentation. Lines that bring the level
    down are events of the levels they close; the first event of its level from its line on ends a declaration, else the end of the
    chunk. All windows partition by chunk. A declaration is in each type whose lines include it.
    """
    lines = chunks.select("id", parser_of(F.col("source_file")).alias("lang"), F.posexplode(F.split("content", "\n")).alias("n", "line")).where(F.trim(F.regexp_replace("line", r"\s", "")) != "")
    plain = F.regexp_replace(F.regexp_replace("line", r"\\.", ""), QUIET, "")
    braces = lambda b: F.length(plain) - F.length(F.replace(plain, F.lit(b), F.lit("")))
    by_line = Window.partitionBy("id").orderBy("n")
    indent = F.length(F.regexp_extract("line", r"^[ \t]*", 0))
    by_indent = F.col("lang").isin("python", "ruby")
    t = lines.withColumn("step", F.when(by_indent, 0).otherwise(braces("{") - braces("}")))
    after = F.sum("step").over(by_line)
    t = t.withColumn("after", F.when(by_indent, F.coalesce(F.lead(indent).over(by_line), F.lit(0))).otherwise(after))
    t = t.withColumn("level", F.when(by_indent, indent).otherwise(F.col("after") - F.col("step")))
    # a line closes the levels from the one after it up to its own; a line that opens and closes a block closes its own level
    one_line = ~by_indent & (F.col("step") == 0) & (braces("{") > 0)
    top = F.when(one_line, F.col("level")).otherwise(F.col("level") - 1)
    ends = t.where(one_line | (F.col("after") < F.col("level"))).select("id", "n", F.explode(F.sequence(F.greatest(F.col("after"), F.lit(0)), F.greatest(F.col("after"), top, F.lit(0)))).alias("level"), F.lit(True).alias("closes"))
    last = t.groupBy("id").agg((F.max("n") + 1).alias("last"))
    found = declarations(chunks).select("id", (F.col("line_no") - 1).alias("n"), "kind", "name")
    own = found.join(t.select("id", "n", "level"), ["id", "n"])
    both = own.unionByName(ends, allowMissingColumns=True)
    # of one line the declaration comes before the event
    w = Window.partitionBy("id", "level").orderBy("n", F.col("closes").isNotNull()).rowsBetween(0, Window.unboundedFollowing)
    ended = both.withColumn("end", F.min(F.when(F.col("closes"), F.col("n") + 1)).over(w)).where("closes is null").join(last, "id")
    d = ended.select("id", (F.col("n") + 1).alias("line_no"), "kind", "name", F.coalesce("end", "last").cast("int").alias("end_line"))
    outer = d.where(F.col("kind").isin(*TYPES)).select(F.col("id").alias("o_id"), F.col("line_no").alias("o_line"), F.col("end_line").alias("o_end"), F.col("name").alias("o_name"))
    inside = (F.col("id") == F.col("o_id")) & (F.col("o_line") < F.col("line_no")) & (F.col("line_no") <= F.col("o_end"))
    above = d.join(outer, inside, "left").groupBy("id", "line_no", "kind", "name", "end_line").agg(F.array_sort(F.collect_list(F.when(F.col("o_line").isNotNull(), F.struct("o_line", "o_name")))).alias("o"))
    return above.select("id", "line_no", "kind", "name", "end_line", F.array_join(F.concat(F.transform("o", lambda x: x["o_name"]), F.array("name")), ".").alias("qualified"))


def inheritance(found: DataFrame) -> DataFrame:
    """src (the parent), dst (the child), relation (EXTENDS or IMPLEMENTS) and label (the child's kind), each once, as graph.closure() takes it."""
    p = found.where("parents != ''").withColumn("p", F.regexp_replace("parents", r"^:\s*", "extends "))
    parts = lambda word, name: F.struct(F.lit(name).alias("relation"), F.split(F.regexp_replace(F.regexp_extract("p", rf"\b{word}\s+(.*?)(?:\s+(?:extends|implements)\s|$)", 1), r"\s+with\s+", ", "), r"\s*,\s*").alias("names"))
    both = p.select(F.col("name").alias("dst"), F.col("kind").alias("label"), F.explode(F.array(parts("extends", "EXTENDS"), parts("implements", "IMPLEMENTS"))).alias("r"))
    e = both.select(F.explode("r.names").alias("src"), "dst", "r.relation", "label").withColumn("src", F.trim("src"))
    return e.where("src != '' and src != dst").distinct()
