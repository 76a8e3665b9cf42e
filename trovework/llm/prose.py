"""Natural language in comments and string literals, by a character-level hidden Markov model.

The states are code and eight languages. What a state emits depends on the two characters before, with shorter
contexts where those were not seen. Staying is free and every change of state costs the same, so one step of the
Viterbi algorithm takes one maximum over the states; it runs over many contents at once, each decoded for itself and
whole; only those above LENGTH are cut, with context on both sides. The spans are then restricted to the comments and
literals that the lexer finds.

The model is trained here: the languages on a bounded sample of documents by their lang column, of which those that
a first model assigns elsewhere are left out (the column has errors), the code state on a bounded sample of code.

Null and empty content gives no rows; repeated ids come out once; files of unknown kind are lexed like JavaScript.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovework.llm.lexing import CONFIG, language_of, scanner, unescape
from trovework.session import sample_by_hash

LANGUAGES = ("en", "de", "fr", "es", "pt", "ru", "ja", "zh")
CODE = len(LANGUAGES)
#: At most so many characters a state are drawn for training, in texts of at most TEXT characters.
SAMPLE, TEXT = 150_000, 20_000
#: The cost of a change of state, in nats.
CHANGE = 6.0
BITS = 20
#: A text up to LENGTH is decoded whole; a longer one in pieces of that length, each with so many characters before and after it that are
#: decoded for their context and then left out. Cells (characters times pieces) that are decoded at once.
LENGTH, CONTEXT, CELLS = 2048, 96, 1_000_000
#: What a character of a comment or literal is less likely to be code, in nats.
INSIDE = 0.4
#: The least words (characters in Japanese and Chinese) of a clause.
WORDS, SIGNS = 5, 8

_LOW = np.arange(1 << 16, dtype=np.int64)
for _c in range(1, 0x530):
    if len(chr(_c).lower()) == 1:
        _LOW[_c] = ord(chr(_c).lower())
_LOW[[9, 10, 11, 12, 13, 0xA0, 0x3000]] = 32
_LOW[48:58] = 48


def _points(text: str) -> np.ndarray:
    return _LOW[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 0xFFFF)]


def _bins(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the last three, two and one characters at each place."""
    a = np.concatenate(([32, 32], c))
    shift = np.uint64(64 - BITS)
    three = (a[:-2] << 32) ^ (a[1:-1] << 16) ^ a[2:]
    two = (a[1:-1] << 16) ^ a[2:] ^ (1 << 50)
    return tuple(((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int32) for x in (three, two, a[2:] ^ (1 << 52)))


def train(texts: dict[int, list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(row of each bin, 0 for none; log probabilities by state and row) from texts by state."""
    n = len(LANGUAGES) + 1
    size = 1 << BITS
    counts = np.zeros((n, 3), dtype=object)
    seen = np.zeros(size, dtype=bool)
    for s in range(n):
        c = _points("\n".join(texts.get(s, [])) or " ")
        counts[s] = [np.bincount(b, minlength=size) for b in _bins(c)]
        for k in range(3):
            seen |= counts[s][k] > (1 if k == 0 else 0)
    row = np.zeros(size, dtype=np.int32)
    rows = np.flatnonzero(seen)
    row[rows] = np.arange(1, len(rows) + 1)
    table = np.full((n, len(rows) + 1), np.log(1e-4), dtype=np.float32)
    # all three lengths share one table of bins: joint frequencies, balanced over the states
    for s in range(n):
        p = sum(counts[s][k][rows] / max(1, counts[s][k].sum()) for k in range(3))
        table[s, 1:] = np.log(p + 2e-6)
    table[:, 1:] -= table[:, 1:].max(axis=0)
    table[:, 1:] = np.maximum(table[:, 1:], -5.0)
    table[:, 0] = 0
    return row, table


def _rows(row: np.ndarray, text: str) -> np.ndarray:
    three, two, one = _bins(_points(text))
    r = row[three]
    for b in (two, one):
        need = r == 0
        r[need] = row[b[need]]
    return r


def states(model: tuple[np.ndarray, np.ndarray], texts: list[str], inside: np.ndarray | None = None) -> np.ndarray:
    """The state of each character of the texts, one after the other; inside is 1 where a comment or literal is.

    No piece reaches over the border of a text, so a text's states don't depend on those it is decoded with.
    """
    row, table = model
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    n = int(sizes.sum())
    out = np.full(n, CODE, dtype=np.int8)
    if not n:
        return out
    # between two texts two blanks, as if each began a text of its own
    ends = np.cumsum(sizes)
    r = _rows(row, "  ".join(texts))[np.arange(n) + 2 * np.repeat(np.arange(len(texts)), sizes)]
    count = -(-sizes // LENGTH)
    text = np.repeat(np.arange(len(texts)), count)
    start = (ends - sizes)[text] + LENGTH * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
    stop = np.minimum(start + LENGTH, ends[text])
    # with its context a piece lies within its text
    low, high = np.maximum(start - CONTEXT, (ends - sizes)[text]), np.minimum(stop + CONTEXT, ends[text])
    by_size = np.argsort(low - high, kind="stable")  # pieces of about one length are decoded together
    k = 0
    while k < len(by_size):
        longest = int(high[by_size[k]] - low[by_size[k]])
        group = by_size[k : k + max(1, CELLS // longest)]
        k += len(group)
        _decode(table, r, inside, out, low[group], high[group], start[group], stop[group])
    return out


def _decode(table: np.ndarray, r: np.ndarray, inside: np.ndarray | None, out: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
    """Viterbi over pieces side by side; what follows the end of a shorter one has no emissions, so its best path stays as it is."""
    size, wide = int((high - low).max()), len(low)
    at = low.astype(np.int32)[None, :] + np.arange(size, dtype=np.int32)[:, None]
    grid = r.take(at, mode="clip")
    minus = None if inside is None else inside.take(at, mode="clip") * np.float32(INSIDE)
    for c in np.flatnonzero(high - low < size):
        grid[high[c] - low[c] :, c] = 0
        if minus is not None:
            minus[high[c] - low[c] :, c] = 0
    score = np.empty((size, table.shape[0], wide), dtype=np.float32)
    moved_to = np.empty((size, wide), dtype=np.float32)  # what a state has that is moved to from the best one
    gain = np.empty((table.shape[0], wide), dtype=np.float32)
    score[0] = table[:, grid[0]]
    for t in range(1, size):
        np.subtract(score[t - 1].max(axis=0), np.float32(CHANGE), out=moved_to[t])
        np.maximum(score[t - 1], moved_to[t], out=score[t])
        np.take(table, grid[t], axis=1, out=gain, mode="clip")
        score[t] += gain
        if minus is not None:
            score[t, CODE] -= minus[t]
    state = score[-1].argmax(axis=0)
    path = np.empty((size, wide), dtype=np.int8)
    col = np.arange(wide)
    for t in range(size - 1, 0, -1):
        path[t] = state
        go = np.flatnonzero(score[t - 1][state, col] < moved_to[t])
        if len(go):
            state[go] = score[t - 1][:, go].argmax(axis=0)
    path[0] = state
    for c in range(wide):
        out[start[c] : stop[c]] = path[start[c] - low[c] : stop[c] - low[c], c]


_FENCE = re.compile(r"(?s)```.*?(?:```|\Z)")
_PROSE = re.compile(r"[^\W\d_]+(?:[ ,]+[^\W\d_]+){4,}[.,;!?]|[぀-ヿ㐀-鿿]{6,}|[а-яё]{3,}")


def fit(spark: SparkSession, docs: DataFrame, chunks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The model from a sample of at most SAMPLE characters a state, chosen by a hash of the ids.

    The documents of each language are counted first; the sample of all languages is then drawn in one pass, about twice as many texts as
    SAMPLE needs of each, which are cut to size here.
    """
    lang = F.lower(F.trim("lang"))
    d = docs.select("doc_id", lang.alias("lang"), "text").where(F.col("lang").isin(*LANGUAGES) & F.col("text").isNotNull() & (F.length("text") <= TEXT))
    found = {r["lang"]: (r["n"], r["size"]) for r in d.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size")).collect()}
    hashed = lambda key: F.pmod(F.xxhash64(F.lit(17), key), F.lit(1_000_003))
    part = lambda size: int(min(1.0, (2 * SAMPLE + 3 * TEXT) / max(1, size)) * 1_000_003)
    limit = F.create_map(*[F.lit(x) for g in LANGUAGES for x in (g, part(found.get(g, (0, 0))[1]))])
    drawn: dict[str, list[tuple[int, str]]] = {g: [] for g in LANGUAGES}
    for h, g, t in d.where(hashed("doc_id") < limit[F.col("lang")]).select(F.xxhash64(F.lit(17), "doc_id"), "lang", "text").collect():
        drawn[g].append((h, t))
    texts: dict[int, list[str]] = {s: [] for s in range(CODE + 1)}
    for s, g in enumerate(LANGUAGES):
        size = 0
        for _, t in sorted(drawn[g]):
            t = _FENCE.sub(" ", t)
            if size < SAMPLE:
                texts[s].append(t)
                size += len(t)
    size = 0
    c = chunks.select("id", "content", "source_file", "language").where(F.col("content").isNotNull() & (F.length("content") <= TEXT))
    for t, path, g in sample_by_hash(c, "id", SAMPLE // 300).select("content", "source_file", "language").collect():
        scan = scanner(language_of(path, g))
        if scan and size < SAMPLE:
            # code is what lies outside comments, and literals without a sentence
            code = scan.sub(lambda m: m[0] if m["s"] is not None and not _PROSE.search(m[0]) else " ", unescape(t))
            texts[CODE].append(code)
            size += len(code)
    model = train(texts)
    for s in range(CODE):
        path, at, kept = states(model, texts[s]), 0, []
        for t in texts[s]:
            if len(t) < 40 or np.bincount(path[at : at + len(t)], minlength=CODE + 1)[:CODE].argmax() == s:
                kept.append(t)
            at += len(t)
        texts[s] = kept
    return train(texts)


_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_STOP = re.compile(r"[.!?][\"')]?\s")
_SIGN = re.compile(r"[぀-ヿ㐀-鿿]")
#: Queries aren't prose, though their keywords are words.
_QUERY = re.compile(r"(?is)\W*(?:select\b.{0,400}?\bfrom\b|insert\s+into\b|update\s+\S+\s+set\b|delete\s+from\b|(?:create|alter|drop)\s+(?:table|index|view)\b|merge\s+into\b|with\s+\w+\s+as\s*\()")


def texts_of(content: str, language: str) -> list[tuple[int, int]]:
    """Comments and literals of a content; line comments on consecutive lines are one."""
    scan = scanner(language) or scanner("javascript")
    out: list[tuple[int, int]] = []
    line_comment = False
    for m in scan.finditer(content):
        s, e = m.span()
        if m["c"] is None:
            if language not in CONFIG:
                out.append((s, e))
            line_comment = False
            continue
        single = not m[0].startswith(("/*", "<!--", "=begin"))
        alone = single and not content[content.rfind("\n", 0, s) + 1 : s].strip()
        if alone and line_comment and content.count("\n", out[-1][1], s) == 1 and not content[out[-1][1] : s].strip():
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
        line_comment = alone
    return out


def clause(text: str, state: np.ndarray) -> int | None:
    """The language of a comment or literal, if it holds a clause in it."""
    n = np.bincount(state, minlength=CODE + 1)[:CODE]
    s = int(n.argmax())
    if n[s] < 8 or _QUERY.match(text):
        return None
    # the runs of any language: short foreign stretches inside a sentence are one text
    mask = state != CODE
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    a, b = edge[::2], edge[1::2]
    keep = np.concatenate(([True], a[1:] - b[:-1] > 3))  # small gaps don't end a run
    a, b = a[keep], b[np.concatenate((keep[1:], [True]))]
    for x, y in zip(a, b):
        if y - x < 8:
            continue
        while s < 6 and x > 0 and text[x - 1].isalpha() and text[x].isalpha():
            x -= 1
        while s < 6 and y < len(text) and text[y].isalpha() and text[y - 1].isalpha():
            y += 1
        run = text[x:y]
        if len(_SIGN.findall(run)) >= SIGNS if s >= 6 else any(len(_WORD.findall(x)) >= WORDS for x in _STOP.split(run)):
            return s
    return None


_OUT = "id string, line_no int, prose_lang string, start int, n_chars int, source_file string"


def find_prose(chunks: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """id, line_no, prose_lang, start, n_chars and source_file of each comment or literal that holds a clause.

    chunks needs id, content, source_file and language. The model is a table of fixed size and is broadcast.
    """
    shared = chunks.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for p in frames:
            rows, todo, size = [], [], 0
            for k, (i, t, path, g) in enumerate(zip(p["id"], p["content"], p["source_file"], p["language"])):
                if t:
                    t = unescape(t)
                    todo.append((i, t, path, language_of(path, g)))
                    size += len(t)
                if todo and (size > 1_500_000 or k == len(p) - 1):
                    spans, inside, at = [texts_of(t, lang) for _, t, _, lang in todo], np.zeros(size, dtype=np.int8), 0
                    for x, found in zip(todo, spans):
                        for s, e in found:
                            inside[at + s : at + e] = 1
                        at += len(x[1])
                    state, at = states(m, [x[1] for x in todo], inside), 0
                    for (i, t, path, _), found in zip(todo, spans):
                        for s, e in found:
                            if e - s < 10:
                                continue
                            g = clause(t[s:e], state[at + s : at + e])
                            if g is not None:
                                rows.append((i, t.count("\n", 0, s) + 1, LANGUAGES[g], s, e - s, path))
                        at += len(t)
                    todo, size = [], 0
            yield pd.DataFrame(rows, columns=["id", "line_no", "prose_lang", "start", "n_chars", "source_file"])

    slim = chunks.select("id", "content", "source_file", "language").where(F.col("content").isNotNull() & (F.col("content") != ""))
    return slim.mapInPandas(run, _OUT).distinct()


def shares(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """source_file, prose_lang and the share of the file's characters in texts of that language."""
    # only sizes are shuffled
    files = chunks.where(F.col("content").isNotNull()).select("id", "source_file", F.length("content").alias("n")).dropDuplicates(["id"]).groupBy("source_file").agg(F.sum("n").alias("all_chars"))
    chars = found.groupBy("source_file", "prose_lang").agg(F.sum("n_chars").alias("chars"))
    return files.join(chars, "source_file").select("source_file", "prose_lang", (F.col("chars") / F.col("all_chars")).alias("share"))
