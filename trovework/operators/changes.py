"""Changes of files: found between snapshots, and applied to the chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trovework.operators.chunks import delete_by, latest
from trovework.session import cut

KINDS = ("ADDED", "MODIFIED", "DELETED", "RENAMED")


def detect(old: DataFrame, new: DataFrame) -> DataFrame:
    """change_type, file_path and old_path between two snapshots with path and hash.

    A deleted and an added file are one rename where they are the only ones of their content; contents that several have, such
    as that of empty files, say nothing about which became which. similar() finds renames with changes.
    """
    j = old.select("path", F.col("hash").alias("a")).join(new.select("path", F.col("hash").alias("b")), "path", "full_outer")
    gone, come = j.where("b is null"), j.where("a is null")
    only = lambda d, h, p: d.groupBy(F.col(h).alias("hash")).agg(F.count("*").alias("n"), F.min("path").alias(p)).where("n = 1").select("hash", p)
    moved = only(gone, "a", "old_path").join(only(come, "b", "file_path"), "hash").select("old_path", "file_path")
    out = j.where("a is not null and b is not null and a != b").select(F.lit("MODIFIED").alias("change_type"), F.col("path").alias("file_path"), F.lit(None).cast("string").alias("old_path"))
    rest = lambda d, kind, used: delete_by(d, moved.select(used), "path").select(F.lit(kind).alias("change_type"), F.col("path").alias("file_path"), F.lit(None).cast("string").alias("old_path"))
    return out.unionByName(rest(gone, "DELETED", "old_path")).unionByName(rest(come, "ADDED", "file_path")).unionByName(moved.select(F.lit("RENAMED").alias("change_type"), "file_path", "old_path"))


#: A line in more rows than this, or than this part of all rows, is joined as one of a short list, so that no task gets all its rows.
HOT, HOT_PART = 100_000, 10_000


def _lines(files: DataFrame) -> DataFrame:
    """path and line, each once, without blanks around and without empty lines."""
    return files.where("path is not null").select("path", F.explode(F.split("content", "\n")).alias("line")).select("path", F.trim(F.regexp_replace("line", "[\\t\\r]", " ")).alias("line")).where("line != ''").distinct()


def similar(old: DataFrame, new: DataFrame, least: float = 0.5) -> DataFrame:
    """old_path, file_path and similarity of the renames among gone and added files (path and content, in one or more rows a file).

    The similarity is the lines that both have as a part of those of the larger one, at least least. Of two files that are each other's
    most similar, ties by path, one became the other. Nothing is missed: two files that share enough lines share one of the rarest of
    either, as many of these as can be left out by the others being shared, so only files that do are compared in full.
    """
    rows = _lines(old).withColumn("side", F.lit(0)).unionByName(_lines(new).withColumn("side", F.lit(1)))
    rows = cut(rows)
    size = rows.groupBy("side", "path").agg(F.count("*").alias("size"))
    # lines that one side alone has match nothing; the counts are summed where the rows are
    counted = cut(rows.groupBy("line").agg(F.count("*").alias("n"), F.min("side").alias("a"), F.max("side").alias("b")).where("a != b").select("line", "n"))
    limit = max(HOT, rows.count() // HOT_PART)
    hot = F.broadcast(counted.where(F.col("n") > limit))  # at most HOT_PART lines can be in so many rows
    marked = rows.join(hot, "line", "left")
    known = marked.where("n is not null").unionByName(marked.where("n is null").drop("n").join(counted.where(F.col("n") <= limit), "line"))
    w = Window.partitionBy("side", "path")
    ranked = known.withColumn("rank", F.row_number().over(w.orderBy("n", "line"))).withColumn("known", F.count("*").over(w)).join(size, ["side", "path"])
    rare = cut(ranked.where(F.col("rank") <= F.col("known") - F.ceil(F.col("size") * least - 1e-9) + 1).select("side", "path", "line"))
    of = lambda d, s, name: d.where(f"side = {s}").select(F.col("path").alias(name), "line")
    pairs = of(rare, 0, "old_path").join(of(rare, 1, "file_path"), "line").select("old_path", "file_path").distinct()
    shared = pairs.join(of(known, 0, "old_path"), "old_path").join(of(known, 1, "file_path"), ["file_path", "line"]).groupBy("old_path", "file_path").agg(F.count("*").alias("shared"))
    sized = lambda s, path, name: size.where(f"side = {s}").select(F.col("path").alias(path), F.col("size").alias(name))
    found = shared.join(sized(0, "old_path", "x"), "old_path").join(sized(1, "file_path", "y"), "file_path").withColumn("similarity", F.col("shared") / F.greatest("x", "y")).where(F.col("similarity") >= least)
    found = cut(found.select("old_path", "file_path", "similarity"))
    best = lambda by, other: found.groupBy(by).agg(F.min(F.struct((-F.col("similarity")).alias("s"), other)).alias("r")).select(by, f"r.{other}")
    return found.join(best("file_path", "old_path"), ["old_path", "file_path"], "left_semi").join(best("old_path", "file_path"), ["old_path", "file_path"], "left_semi")


def clean(changes: DataFrame) -> DataFrame:
    """Each change once, its type in upper case; types that aren't known stay out."""
    c = latest(changes, "change_id", F.col("received_at"))
    return c.withColumn("change_type", F.upper(F.trim("change_type"))).where(F.col("change_type").isin(*KINDS) & F.col("file_path").isNotNull())


def last_state(changes: DataFrame) -> DataFrame:
    """path, alive, changed_at, change_id: what the last change of each path says of it; a rename ends its old path."""
    c = clean(changes)
    says = c.select(F.col("file_path").alias("path"), (F.col("change_type") != "DELETED").alias("alive"), "changed_at", "change_id")
    ends = c.where("change_type = 'RENAMED' and old_path is not null and old_path != file_path").select(F.col("old_path").alias("path"), F.lit(False).alias("alive"), "changed_at", "change_id")
    return latest(says.unionByName(ends), "path", F.col("changed_at"), F.col("change_id"), F.col("alive")).select("path", "alive", "changed_at", "change_id")


def apply(table: DataFrame, changes: DataFrame, fresh: DataFrame | None = None) -> DataFrame:
    """The table after the changes: rows of files that ended leave, rows of files in fresh take the place of the old ones.

    The order of types (added, modified, deleted, renamed) matters only for one path; the last change of a path decides. Files
    that changed and aren't in fresh keep the rows they have.
    """
    state = last_state(changes)
    kept = delete_by(table, state.where("not alive").select("path"), "source_file")
    if fresh is None:
        return kept
    new = fresh.join(state.where("alive").select(F.col("path").alias("source_file")), "source_file", "left_semi")
    return delete_by(kept, new.select("source_file"), "source_file").unionByName(new, allowMissingColumns=True)


def index_state(changes: DataFrame) -> DataFrame:
    """repository, the commit and time of its last change, and its number of changes."""
    c = clean(changes).where("repository is not null")
    last = latest(c, "repository", F.col("changed_at"), F.col("change_id")).select("repository", "commit_sha", "changed_at")
    return last.join(c.groupBy("repository").agg(F.count("*").alias("changes")), "repository")


_STATE = "repository string, commit_sha string, changed_at timestamp, gone boolean"


def _version(spark: SparkSession, path: str) -> DataFrame:
    """All rows that were ever written to a store of states, with the number of the write."""
    return spark.read.schema(_STATE + ", written int").parquet(path)


def _append(states: DataFrame, path: str, gone: bool) -> None:
    spark = states.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    last = [int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(at) if "=" in f.getPath().getName()] if fs.exists(at) else []
    states.withColumn("gone", F.lit(gone)).write.parquet(f"{path}/written={max(last, default=0) + 1}")


def save_states(states: DataFrame, path: str) -> None:
    """Adds repository, commit_sha and changed_at to the store under path; what is saved last of a repository counts. One writer at a time."""
    _append(states.select("repository", "commit_sha", "changed_at"), path, False)


def delete_states(repositories: DataFrame, path: str) -> None:
    """Takes repositories (one column) out of the store."""
    _append(repositories.toDF("repository").select("repository", F.lit(None).cast("string").alias("commit_sha"), F.lit(None).cast("timestamp").alias("changed_at")), path, True)


def find_states(spark: SparkSession, path: str) -> DataFrame:
    """repository, commit_sha and changed_at as last saved."""
    return latest(_version(spark, path), "repository", F.col("written"), F.col("changed_at"), F.col("commit_sha")).where("not gone").drop("gone", "written")
