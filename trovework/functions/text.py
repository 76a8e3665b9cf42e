"""Column functions: the analyser of code and prose, repositories from paths, texts for embedding and prompts."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the analyser leaves out, common English words and words of Java.
STOP_WORDS = tuple(
    "a an and are as at be by for from has he in is it its of on that the to was will with would"
    " public private protected static final class interface enum abstract extends implements import return void int long double float boolean char byte short new this super null true false"
    " if else while do switch case default try catch finally throw throws break continue".split()
)
#: Fixed values for the repository of a path: hosts, directories below a repository, build files, and directories that name none.
HOSTS = ("github.com", "gitlab.com", "bitbucket.org")
SOURCE_DIRS = ("src", "main", "test", "docs")
BUILD_FILES = ("README", "package.json", "pom.xml", "build.gradle", "Cargo.toml", "go.mod")
COMMON_DIRS = ("java", "com", "org", "net", "io")
BUILD_DIRS = (*COMMON_DIRS, *SOURCE_DIRS, "bin", "target", "build", "out", "dist")


def parts(token: Column) -> Column:
    """Parts of an identifier in lower case: at underscores, at changes of case and between letters and digits."""
    t = F.regexp_replace(token, r"(\p{Ll})(\p{Lu})", "$1 $2")
    t = F.regexp_replace(t, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    t = F.regexp_replace(t, r"(\p{L})(\p{N})", "$1 $2")
    t = F.regexp_replace(t, r"(\p{N})(\p{L})", "$1 $2")
    return F.filter(F.split(F.lower(t), "[ _]+"), lambda x: x != "")


def terms(text: Column) -> Column:
    """The terms of a text in order: each token in lower case, then its parts of at least two characters where it has several.

    Stop words are left out. Null gives null, a text without tokens an empty array.
    """
    # the possessive s is no term
    tokens = F.regexp_extract_all(F.regexp_replace(text, r"([\p{L}\p{N}])['’][sS]($|[^\p{L}\p{N}_])", "$1$2"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))

    def of(token: Column) -> Column:
        p = parts(token)
        more = F.array_distinct(F.filter(p, lambda x: F.length(x) > 1))
        return F.when(F.size(p) > 1, F.concat(F.array(F.lower(token)), F.array_remove(more, F.lower(token)))).otherwise(F.array(F.lower(token)))

    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(F.flatten(F.transform(tokens, of)), lambda x: ~F.array_contains(stop, x))


@cache
def _letters(category: str) -> str:
    """A class of a pattern with the characters of a Unicode category, given by its beginning, as \\p{..} has in Java."""
    on = [unicodedata.category(chr(c)).startswith(category) for c in range(sys.maxunicode + 1)]
    edges = [c for c in range(len(on)) if on[c] != (on[c - 1] if c else False)] + [len(on)]
    return "[" + "".join(f"\\U{x:08x}-\\U{y - 1:08x}" for x, y in zip(edges[::2], edges[1::2])) + "]"


class Words(dict):
    """terms() in Python, for texts in great number: each different token is cut once. Terms are numbers, whose names are in terms."""

    def __init__(self) -> None:
        super().__init__()
        self.terms: list[str] = []
        self.number: dict[str, int] = {}
        up, low, any_letter, digit = (_letters(x) for x in ("Lu", "Ll", "L", "N"))
        self.cuts = [re.compile(p) for p in (f"({low})({up})", f"({up})({up}{low})", f"({any_letter})({digit})", f"({digit})({any_letter})")]
        # \w are the letters, numbers and the underscore
        self.tokens, self.possessive, self.stop = re.compile(r"\w+").findall, re.compile(r"([^\W_])['’][sS]($|[^\w])"), {*STOP_WORDS}

    def split(self, token: str) -> list[str]:
        t = token
        for p in self.cuts:
            t = p.sub(r"\1 \2", t)
        parts, whole = [x for x in re.split("[ _]+", t.lower()) if x], token.lower()
        return [x for x in ([whole, *(x for x in dict.fromkeys(parts) if len(x) > 1 and x != whole)] if len(parts) > 1 else [whole]) if x not in self.stop]

    def __missing__(self, token: str) -> tuple[int, ...]:
        got = []
        for x in self.split(token):
            if (n := self.number.get(x)) is None:
                n = self.number[x] = len(self.terms)
                self.terms.append(x)
            got.append(n)
        self[token] = got = tuple(got)
        return got

    def of(self, text: str) -> list[int]:
        """The numbers of the terms of a text, in order."""
        if "'" in text or "’" in text:
            text = self.possessive.sub(r"\1\2", text)
        return list(chain.from_iterable(map(self.__getitem__, self.tokens(text))))

    def bound(self, most: int = 500_000) -> None:
        """Begins anew once there are more tokens than most; numbers given before are void then."""
        if len(self) > most:
            self.clear()
            self.number, self.terms = {}, []


def repository_of(path: Column) -> Column:
    """The repository of a file by its path, in lower case; a name has two characters at least and no dot.

    The first that fits: two parts below a host; what stands above a source directory; what stands above a build file; the last part
    where the two last are names; the last directory that isn't a usual one; unknown.
    """
    p = F.split(F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/"), "/")
    at = lambda i: F.try_element_at(p, i.cast("int"))
    valid = lambda c: (F.length(c) > 1) & ~F.contains(c, F.lit("."))
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(p), F.lit(1))), lambda i: i <= F.size(p))
    first = lambda holds, value: F.try_element_at(F.transform(F.filter(places, holds), value), F.lit(1))
    by_host = first(lambda i: at(i).isin(*HOSTS) & F.coalesce(valid(at(i + 2)), F.lit(False)), lambda i: at(i + 2))
    by_dir = first(lambda i: F.coalesce(at(i + 1).isin(*SOURCE_DIRS), F.lit(False)) & valid(at(i)) & ~at(i).isin(*COMMON_DIRS), at)
    by_file = first(lambda i: F.coalesce(at(i + 1).isin(*BUILD_FILES), F.lit(False)) & valid(at(i)), at)
    last, before = F.element_at(p, -1), F.try_element_at(p, F.lit(-2))
    pair = F.when(valid(last) & valid(before) & ~last.isin(*COMMON_DIRS) & ~before.isin(*COMMON_DIRS), last)
    rest = F.try_element_at(F.filter(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda x: valid(x) & ~x.isin(*BUILD_DIRS)), F.lit(-1))
    return F.lower(F.coalesce(by_host, by_dir, by_file, pair, rest, F.lit("unknown")))


def metadata_field(name: Column) -> Column:
    return F.concat(F.lit("meta_"), F.regexp_replace(F.lower(name), "[^a-z0-9_]", "_"))


def embedding_text(content: Column, language: Column, max_tokens: int = 512) -> Column:
    """language: content, with single blanks, cut at four characters a token, at the last blank where that is past 80 per cent."""
    limit = 4 * max_tokens
    t = F.trim(F.regexp_replace(content, r"\s+", " "))
    head = F.substring(t, 1, limit)
    blank = F.lit(limit + 1) - F.locate(" ", F.reverse(head))
    cut = F.when(F.length(t) <= limit, t).when((F.locate(" ", F.reverse(head)) > 0) & (blank > 0.8 * limit), F.rtrim(F.substring(head, F.lit(1), blank))).otherwise(head)
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.coalesce(F.lower(language), F.lit("text")), F.lit(": "), cut))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / F.lit(4.0)).cast("int")


#: Context windows by the first part of a model's name that fits, in this order.
WINDOWS = (("claude-3", 100000), ("claude-2", 100000), ("gpt-4-32k", 32768), ("gpt-4", 8192), ("gpt-3.5-turbo-16k", 16384), ("gpt-3.5-turbo", 4096), ("llama-3", 8192), ("llama3", 8192), ("mistral", 8192), ("phi", 2048))
DEFAULT_WINDOW = 8192


def context_window(model: Column) -> Column:
    out = F.lit(DEFAULT_WINDOW)
    for part, size in reversed(WINDOWS):
        out = F.when(F.contains(F.lower(model), F.lit(part)), F.lit(size)).otherwise(out)
    return out


def context_block(path: Column, name: Column, kind: Column, start: Column, end: Column, language: Column, content: Column) -> Column:
    """A chunk as the prompt shows it: a header with its source, then its content in a fence."""
    call = F.when(F.lower(kind).isin("method", "function") & ~F.contains(name, F.lit("(")), F.lit("()")).otherwise(F.lit(""))
    head = F.concat(F.lit("[Source: "), path, F.lit(" - "), name, call, F.lit(" (lines "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(")]"))
    return F.concat(head, F.lit("\n```"), F.lower(F.coalesce(language, F.lit(""))), F.lit("\n"), F.regexp_replace(content, r"\n+\z", ""), F.lit("\n```"))


def citations(answer: Column) -> Column:
    """The citations [Source: file:line] and [Source: file:a-b] of an answer, those with proper lines only."""
    raw = F.regexp_extract_all(answer, F.lit(r"\[Source:\s*([^\]]+)\]"), F.lit(1))
    def one(r: Column) -> Column:
        t = F.trim(r)
        lines = F.regexp_extract(t, r":\s*(\d+(?:\s*-\s*\d+)?)\s*$", 1)
        start = F.regexp_extract(lines, r"^(\d+)", 1).try_cast("int")
        end = F.coalesce(F.regexp_extract(lines, r"-\s*(\d+)$", 1).try_cast("int"), start)
        return F.struct(F.trim(F.regexp_extract(t, r"^(.*):[^:]*$", 1)).alias("file"), start.alias("start_line"), end.alias("end_line"))
    return F.filter(F.transform(raw, one), lambda c: (c["file"] != "") & (c["start_line"] >= 1) & (c["end_line"] >= c["start_line"]))


def stage_of(message: Column) -> Column:
    """The stage of a progress message."""
    m = F.lower(F.coalesce(message, F.lit("")))
    has = lambda *w: F.greatest(*[F.contains(m, F.lit(x)) for x in w]) if len(w) > 1 else F.contains(m, F.lit(w[0]))
    return F.when(has("clone", "cloning"), "CLONING").when(has("pars"), "PARSING").when(has("success", "completed"), "COMPLETE").when(has("fail", "error"), "FAILED").otherwise("INDEXING")


def query_kind(q: Column) -> Column:
    """How a query string is read: all, structural, field, wildcard, phrase or words."""
    t = F.trim(F.coalesce(q, F.lit("")))
    return F.when(t == "", "all").when(t.rlike(r"^(implements|extends|usages):"), "structural").when(F.contains(t, F.lit(":")), "field").when(t.rlike(r"[*?]"), "wildcard").when(t.rlike(r'^".*"$') & (F.length(t) > 1), "phrase").otherwise("words")


def structural_target(q: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(q), r"^(?:implements|extends|usages):\s*(\S+)", 1), F.lit(""))


def snippet(content: Column, lines: int = 15, width: int = 120) -> Column:
    return F.array_join(F.transform(F.slice(F.split(content, "\n"), 1, lines), lambda x: F.substring(x, 1, width)), "\n")


def file_name_of(url: Column) -> Column:
    """A state file's name for a repository URL: only letters, digits, dot, dash and underscore."""
    return F.concat(F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://", ""), r"[^A-Za-z0-9._-]", "_"), "_+", "_"), F.lit(".json"))


def mask_key(key: Column) -> Column:
    return F.when(F.coalesce(key, F.lit("")) == "", F.lit(None)).otherwise(F.lit("***"))
