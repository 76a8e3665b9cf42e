"""The chunk table: cleaning, keys, and changes to it as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovework.functions.text import repository_of

#: Other spellings of languages.
LANGUAGE_ALIASES = {"py": "python", "js": "javascript", "ts": "typescript", "golang": "go", "c++": "cpp", "c#": "csharp", "cs": "csharp", "rs": "rust", "rb": "ruby", "kt": "kotlin", "yml": "yaml", "sh": "shell"}
#: Extensions of source files and of plain-text files that are none, and of binaries.
SOURCE_EXTENSIONS = ("java", "py", "js", "ts", "cpp", "c", "h", "cs", "go", "rs", "scala", "kt", "rb", "php", "swift")
BINARY_EXTENSIONS = ("class", "jar", "war", "exe", "dll", "so", "png", "jpg", "jpeg", "gif", "pdf", "zip", "gz")
PARSERS = {
    "java": "java", "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp",
    "go": "go", "rs": "rust", "kt": "kotlin", "kts": "kotlin", "rb": "ruby", "scala": "scala", "sc": "scala", "swift": "swift", "php": "php", "cs": "csharp",
}


def file_name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def extension(path: Column) -> Column:
    """What follows the last dot of the file's name, in lower case; empty without one."""
    n = file_name(path)
    return F.when(F.contains(n, F.lit(".")), F.substring_index(n, ".", -1)).otherwise(F.lit(""))


def is_source_file(path: Column) -> Column:
    return ~file_name(path).startswith(".") & extension(path).isin(*SOURCE_EXTENSIONS)


def is_text_file(path: Column) -> Column:
    return ~file_name(path).startswith(".") & ~extension(path).isin(*BINARY_EXTENSIONS)


def parser_of(path: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in PARSERS.items() for x in kv])
    return m[extension(path)]


def language_of(language: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in LANGUAGE_ALIASES.items() for x in kv])
    t = F.lower(F.trim(language))
    return F.coalesce(m[t], t)


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row a key, the greatest by order: an aggregation with partial maxima, so a key with many rows is no burden on one task."""
    cols = rows.columns
    best = F.max(F.struct(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("o"), F.struct(*cols).alias("r"))).alias("b")
    # the key is the group's own, by which Spark knows that the rows are partitioned
    return rows.groupBy(F.col(key).alias("_k")).agg(best).select(*[F.col("_k").alias(c) if c == key else F.col(f"b.r.`{c}`").alias(c) for c in cols])


def clean(chunks: DataFrame) -> DataFrame:
    """Each chunk once, the last written, with clean language and type, its repository and document_id."""
    one = latest(chunks, "id", F.greatest("created_at", "updated_at"), F.col("created_at"))
    return one.withColumns({
        "language": language_of(F.col("language")), "entity_type": F.lower("entity_type"), "repository": repository_of(F.col("source_file")),
        "document_id": F.concat_ws(":", "source_file", "entity_name", F.col("start_line").cast("string"), F.col("end_line").cast("string")),
    })


def violations(chunks: DataFrame) -> DataFrame:
    """id and the names of the rules that a row breaks, for rows that break any."""
    need = ("content", "language", "entity_type", "entity_name", "source_file")
    rules = [F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in need]
    rules += [
        F.when(F.col("start_line") < 1, F.lit("start_line below 1")), F.when(F.col("end_line") < F.col("start_line"), F.lit("end_line before start_line")),
        F.when(F.col("start_byte") < 0, F.lit("start_byte below 0")), F.when(F.col("end_byte") < F.col("start_byte"), F.lit("end_byte before start_byte")),
        F.when(F.col("updated_at").isNull(), F.lit("updated_at is null")), F.when(F.col("updated_at") < F.col("created_at"), F.lit("updated_at before created_at")),
    ]
    return chunks.select("id", F.array_join(F.array_compact(F.array(*rules)), ", ").alias("violations")).where("violations != ''")


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def delete_by(table: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """table without the rows whose column is among keys (one column, any name)."""
    k = keys.toDF("_key").where("_key is not null").distinct()
    return table.join(k, F.col(column) == F.col("_key"), "left_anti")


def replace_files(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of each file in rows take the place of those the table has of it."""
    return delete_by(table, rows.select("source_file"), "source_file").unionByName(rows, allowMissingColumns=True)


def upsert(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """rows win over the table's rows of the same key; within rows the last by updated_at, then created_at."""
    last = latest(rows, key, F.col("updated_at"), F.col("created_at"))
    return delete_by(table, last.select(key), key).unionByName(last, allowMissingColumns=True)


def upsert_vectors(table: DataFrame, rows: DataFrame, dimension: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """As upsert(), for vectors; those of another dimension are refused (they stay out)."""
    good = rows.where(F.size(column) == dimension).dropDuplicates([key])
    return delete_by(table, good.select(key), key).unionByName(good, allowMissingColumns=True)


def stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(
        F.count("*").alias("rows"), F.countDistinct("id").alias("documents"), F.countDistinct("source_file").alias("files"), F.sum(F.length("content")).cast("bigint").alias("characters"),
    )


def parse_progress(chunks: DataFrame) -> DataFrame:
    """Chunks and files of each language, and the percentage of all files done when languages are taken in order of name."""
    per = chunks.groupBy("language").agg(F.count("*").alias("chunks"), F.countDistinct("source_file").alias("files"))
    # one row a language: the window sorts a few dozen rows
    w = Window.orderBy("language").rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("percent", F.floor(100 * F.sum("files").over(w) / F.sum("files").over(Window.partitionBy(F.lit(1)))).cast("int"))
