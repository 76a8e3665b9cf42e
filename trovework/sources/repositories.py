"""Sources: repositories by URL, their metadata from JSON, and source files from a directory tree."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trovework.operators.chunks import is_source_file

_URL = r"^(?:https?://|ssh://git@|git@)(?:[^@/]*@)?([^/:]+)[/:](?:scm/)?(.+?)(?:\.git)?/?$"


def host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def owner(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.regexp_extract(url, _URL, 2), r"^(.*)/[^/]+$", 1), F.lit(""))


def name(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.regexp_extract(url, _URL, 2), r"([^/]+)$", 1), F.lit(""))


def client(url: Column) -> Column:
    """Which kind of host a URL belongs to."""
    h = F.coalesce(host(url), F.lit(""))
    return F.when(h == "github.com", "github").when(h == "bitbucket.org", "bitbucket").when(url.rlike("/scm/"), "bitbucket_server").when(h.rlike("gitlab"), "gitlab").when(h != "", "other").otherwise("unknown")


def clone_url(url: Column) -> Column:
    """The HTTPS address to clone from."""
    return F.when(host(url).isNotNull() & owner(url).isNotNull(), F.concat(F.lit("https://"), host(url), F.lit("/"), owner(url), F.lit("/"), name(url), F.lit(".git")))


METADATA = "name string, owner struct<login:string>, default_branch string, clone_url string, pushed_at string"


def metadata(payloads: DataFrame, column: str = "json") -> DataFrame:
    """Repository metadata from the JSON that hosts answer with; broken JSON gives nulls."""
    j = F.from_json(column, METADATA)
    return payloads.select(j.alias("j")).select(F.col("j.name").alias("repo_name"), F.col("j.owner.login").alias("repo_owner"), F.col("j.clone_url"), F.coalesce("j.default_branch", F.lit("main")).alias("default_branch"))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path and content of the source files under root, a folder that all executors share; names with a leading dot are left out.

    The driver lists the first two levels only, the tasks walk what lies below and then read the files; names with a leading underscore
    are kept, which Spark's own file readers leave out.
    """
    seen = lambda at: [e for e in sorted(os.scandir(at), key=lambda e: e.name) if not e.name.startswith(".")]
    first = seen(root)
    below = [e for d in first if d.is_dir() for e in seen(d.path)]
    folders = [os.path.relpath(e.path, root) for e in below if e.is_dir()]
    files = [os.path.relpath(e.path, root) for e in [*first, *below] if e.is_file()]
    wide = spark.sparkContext.defaultParallelism * 4
    spread = lambda names: spark.createDataFrame([(n,) for n in names], "path string").repartition(max(1, min(len(names), wide)))

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            for folder in p["path"]:
                for d, dirs, names in os.walk(os.path.join(root, folder)):
                    dirs[:] = sorted(x for x in dirs if not x.startswith("."))
                    yield pd.DataFrame({"path": pd.Series([os.path.relpath(os.path.join(d, n), root) for n in sorted(names) if not n.startswith(".")], dtype=object)})

    rows = spread(folders).mapInPandas(walk, "path string").unionByName(spread(files)).where(is_source_file(F.col("path"))).repartition(wide)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            for x in p["path"]:
                with open(os.path.join(root, x), "rb") as f:
                    yield pd.DataFrame({"path": [x], "content": [f.read().decode("utf-8", "replace")]})

    return rows.mapInPandas(read, "path string, content string")
