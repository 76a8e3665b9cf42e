"""Choosing chunks for a prompt, building it, and taking citations from answers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovework.functions.text import citations, context_block


def budget(window: int, system: int, question: int, reserve: float = 0.2) -> int:
    return max(0, window - int(window * reserve) - system - question)


def choose(scored: DataFrame, tokens: int) -> DataFrame:
    """The candidates that fit a budget: query_id, doc, source_file, n_tokens, score, position.

    By falling score, first one chunk a file, then the others, each taken if it still fits. scored has query_id, doc,
    source_file, score and n_tokens. All candidates of a query are walked in sorted batches. What is carried along is bounded
    by the budget: the files taken, and of the others of a size only as many as the budget left can hold (of one size those
    that fit come first); empty ones always fit.
    """
    slim = scored.select("query_id", "doc", "source_file", "score", "n_tokens").where(F.col("n_tokens") <= tokens)
    names, files, sizes = slim.columns, slim.columns.index("source_file"), slim.columns.index("n_tokens")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, left, rows, seen, later, held = None, tokens, [], set(), [], Counter()

        def chosen() -> pa.RecordBatch:
            room = left
            for r in later:
                if r[sizes] <= room:
                    room -= r[sizes]
                    rows.append(r)
            columns = [*zip(*rows)] or [()] * len(names)
            arrays = [pa.array(c, type=t) for c, t in zip(columns, types)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(range(1, len(rows) + 1), type=pa.int32())], names=[*names, "position"])

        types: list[pa.DataType] = []
        for b in batches:
            types = b.schema.types
            while b.num_rows:
                ids = b.column("query_id")
                first = ids[0].as_py()
                # sorted by query: the first row of another one ends this one's part of the batch
                n = pc.index(pc.fill_null(pc.equal(ids, ids[0]), False) if first is not None else pc.is_null(ids), False).as_py()
                part, b = (b, b.slice(b.num_rows)) if n < 0 else (b.slice(0, n), b.slice(n))
                if rows and first != query:
                    yield chosen()
                if first != query:
                    query, left, rows, seen, later, held = first, tokens, [], set(), [], Counter()
                part = part.filter(pc.less_equal(part.column("n_tokens"), left))  # what is left only falls
                for r in zip(*(c.to_pylist() for c in part.columns)):
                    size = r[sizes]
                    if size > left:
                        continue
                    if r[files] not in seen:
                        left -= size
                        rows.append(r)
                        seen.add(r[files])
                    elif held[size] * size <= left - size:
                        held[size] += 1
                        later.append(r)
        if rows:
            yield chosen()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema) + ", position int"
    return slim.repartition("query_id").sortWithinPartitions("query_id", F.desc("score"), "doc").mapInArrow(walk, schema)


def context(chosen: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id and context: the blocks of the chosen chunks in order, a blank line between."""
    c = chunks.select(F.col("id").alias("doc"), "entity_name", "entity_type", "start_line", "end_line", "language", "content", F.col("source_file").alias("path"))
    block = context_block(F.col("path"), F.col("entity_name"), F.col("entity_type"), F.col("start_line"), F.col("end_line"), F.col("language"), F.col("content"))
    rows = chosen.join(c, "doc").select("query_id", F.struct("position", block.alias("block")).alias("b"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: x["block"]), "\n\n").alias("context"))


def render(template: str, context: Column, question: Column) -> Column:
    """The template with {{context}} and {{question}} replaced; both must occur."""
    for name in ("{{context}}", "{{question}}"):
        if name not in template:
            raise ValueError(f"the template lacks {name}")
    return F.replace(F.replace(F.lit(template), F.lit("{{question}}"), question), F.lit("{{context}}"), context)


def cited(answers: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, n, file, start_line and end_line of each proper citation of each answer, in order."""
    return answers.select(key, F.posexplode(citations(F.col(text))).alias("n", "c")).select(key, "n", "c.*")


def sources(chosen: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The chunks of the prompt and the citations that it lacks, by key, file and lines."""
    same = [key, "file", "start_line", "end_line"]
    return chosen.select(*same, F.lit("context").alias("kind")).unionByName(found.select(*same).distinct().join(chosen, same, "left_anti").select(*same, F.lit("citation").alias("kind")))


def assemble(tokens: DataFrame, key: str) -> DataFrame:
    """key and answer: the tokens (seq, token) in order."""
    return tokens.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "token"))), lambda x: x["token"]), "").alias("answer"))
