"""Splitting oversized items at natural boundaries, with an overlap, by pointer doubling.

The boundaries of an item are its line starts, marked where a member begins, and, inside a line longer than the
limit, every place a full step on. They leave the scan in sections of the limit's length. A section is joined with
the one that follows it, and so each boundary with its farthest legal successor: the farthest member in reach, else
the farthest boundary in reach, where reach is the limit less the overlap. Squaring that successor table again and
again gives the successors 2, 4, 8, ... cuts on, and with them all cuts of the greedy walk in a logarithmic number
of joins, whatever the items' lengths. With every=True the walk steps to the nearest member in reach instead, so it
cuts at every member, and member_starts() reads the members off that walk.

Items of at most the limit, null or empty content give no rows; repeated ids come out once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trovework.llm.structure import headers, lexed
from trovework.session import written

LIMIT, OVERLAP = 4000, 200


def oversized(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    return chunks.where(F.length("content") > limit)


def members(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """id, at and line_no of the line on which each member's attached lines begin, within items above the limit."""
    big = oversized(chunks, limit).withColumn("single", F.lower("entity_type").isin("function", "method", "constructor"))
    heads = headers(lexed(big, "single", where="single is null or not single"), "single")
    return heads.select("id", F.col("first_bol").alias("at"), F.col("first_line").alias("line_no")).distinct()


def sections(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """id, total (characters), section, and the boundaries in that section of the limit's length: places, with their lines (from 1)."""
    step = limit - overlap
    schema = "id string, total int, section int, places array<int>, lines array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, totals, numbers, places, lines, ends = [], [], [], [], [], [0]
            for i, text in zip(b.column("id").to_pylist(), b.column("content").to_pylist()):
                points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                starts = np.concatenate(([0], np.flatnonzero(points == 10) + 1))
                sizes = np.diff(np.append(starts, len(points) + 1)) - 1  # without the line's end
                more = np.maximum(sizes - 1, 0) // step  # boundaries inside the line
                line = np.repeat(np.arange(1, len(starts) + 1), more + 1)
                at = np.repeat(starts, more + 1) + step * (np.arange(len(line)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1))
                section = at // limit
                first = np.flatnonzero(np.diff(section, prepend=-1))
                ids += [i] * len(first)
                totals += [len(points)] * len(first)
                numbers.append(section[first])
                ends += (np.append(first[1:], len(at)) + ends[-1]).tolist()
                places.append(at)
                lines.append(line)
            flat = lambda x: np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32)
            as_list = lambda x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat(x)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(totals, pa.int32()), pa.array(flat(numbers)), as_list(places), as_list(lines)], names=["id", "total", "section", "places", "lines"])

    return oversized(chunks, limit).select("id", "content").mapInArrow(run, schema).dropDuplicates(["id", "section"])


def successors(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, every: bool = False) -> DataFrame:
    """id, at, line_no, member and next, the farthest legal cut from each boundary; null where the rest fits.

    Each section meets its members and the section after it by joins on id and section, so what a task holds of an item is
    two sections, however long the item is.
    """
    found = members(chunks, limit).groupBy("id", F.expr(f"at div {limit}").cast("int").alias("section")).agg(F.collect_set("at").alias("members"))
    here = written(sections(chunks, limit, overlap).join(found, ["id", "section"], "left"), "sections")  # joined with itself
    after = here.select("id", (F.col("section") - 1).alias("section"), F.col("places").alias("places_after"), F.col("members").alias("members_after"))
    j = here.join(after, ["id", "section"], "left")
    schema = "id string, at int, line_no int, member boolean, next int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for r in b.to_pylist():
                at, line = np.array(r["places"], dtype=np.int64), r["lines"]
                pool = np.concatenate((at, np.array(r["places_after"] or [], dtype=np.int64)))
                known = np.sort(np.array([*(r["members"] or []), *(r["members_after"] or [])], dtype=np.int64))
                room = np.where(at == 0, limit, limit - overlap)
                nxt = np.append(-1, pool)[np.searchsorted(pool, at + room, side="right")]
                if every:
                    near = np.append(known, np.iinfo(np.int64).max)[np.searchsorted(known, at, side="right")]
                    by_member = np.where(near <= at + room, near, -1)
                else:
                    by_member = np.append(-1, known)[np.searchsorted(known, at + room, side="right")]
                    by_member[r["total"] - at <= room] = -1
                nxt = np.where(by_member > at, by_member, np.where((r["total"] - at > room) & (nxt > at), nxt, -1))
                ids += [r["id"]] * len(at)
                out.append((at, np.array(line), np.isin(at, known), nxt))
            a, n, m, x = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (zip(*out) if out else [()] * 4)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(a.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(m.astype(bool)), pa.array(x.astype(np.int32), mask=x < 0)], names=["id", "at", "line_no", "member", "next"])

    return j.select("id", "total", "section", "places", "lines", "members", "places_after", "members_after").mapInArrow(run, schema)


def walk(nxt: DataFrame) -> DataFrame:
    """id and at of all boundaries that the walk from each item's start (at 0) along next reaches, the start included."""
    # a boundary that nothing leads to is not on the walk: it can be left out of the tables to square
    led = nxt.where("next is not null").select("id", F.col("next").alias("at")).distinct()
    start = nxt.where("at = 0").select("id", "at")
    table = written(nxt.where("next is not null").join(led.unionByName(start), ["id", "at"], "left_semi").select("id", "at", "next"), "jumps")
    reached = [start]
    while True:
        # one join a round: the table squared, and the boundaries that its jumps reach from those reached before (those have no at)
        before = reduce(DataFrame.unionByName, reached).select("id", F.lit(None).cast("int").alias("at"), F.col("at").alias("next"))
        far = table.select("id", F.col("at").alias("next"), F.col("next").alias("far"))
        step = written(table.unionByName(before).join(far, ["id", "next"]).select("id", "at", F.col("far").alias("next")), "jumps")
        reached.append(step.where("at is null").select("id", F.col("next").alias("at")))
        table = step.where("at is not null")
        if table.isEmpty():
            break
    return reduce(DataFrame.unionByName, reached).distinct()


def cuts(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, every: bool = False) -> DataFrame:
    """id, at, line_no and member of every piece's own beginning, the first included."""
    nxt = written(successors(chunks, limit, overlap, every), "successors")
    return nxt.select("id", "at", "line_no", "member").join(walk(nxt), ["id", "at"], "left_semi")


def member_starts(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """id and line_no of the members within items above the limit: the cuts of the walk that steps from member to member."""
    return cuts(chunks, limit, overlap, every=True).where("member").select("id", "line_no").distinct()


def split(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces: id, piece (from 1), start_line, end_line (counted like the item's), content.

    chunks needs id, content, source_file, language, entity_type and start_line.
    """
    w = Window.partitionBy("id").orderBy("at")
    p = cuts(chunks, limit, overlap).withColumn("piece", F.row_number().over(w)).withColumn("to", F.lead("at").over(w))
    text = oversized(chunks, limit).select("id", "content", F.col("start_line").alias("first_line")).dropDuplicates(["id"])
    lead = F.when(F.col("piece") > 1, F.lit(overlap)).otherwise(F.lit(0))
    p = p.join(text, "id").withColumn("from", F.col("at") - lead)
    content = F.expr("substring(content, `from` + 1, coalesce(`to`, length(content)) - `from`)")
    p = p.select("id", "piece", "first_line", "line_no", content.alias("piece_text"), F.expr(f"substring(content, at - {overlap} + 1, {overlap})").alias("before"), (F.col("piece") > 1).alias("later"))
    ends = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    # the line of the cut is known; the overlap before it begins as many lines earlier as it has line ends
    start = F.col("first_line") + F.col("line_no") - 1 - F.when(F.col("later"), ends(F.col("before"))).otherwise(F.lit(0))
    inner = ends(F.expr("substring(piece_text, 1, length(piece_text) - 1)"))
    return p.select("id", "piece", start.cast("int").alias("start_line"), (start + inner).cast("int").alias("end_line"), F.col("piece_text").alias("content"))
