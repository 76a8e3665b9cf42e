"""Functions and their documentation by windows over lexed tokens.

Each chunk is lexed once inside a task into the tokens that shape it: comments and annotation lines that stand on
lines of their own, function headers, docstrings, and the opening and closing of blocks. The tokens are exploded
into rows. Cumulative sums then give the depth of each block, a lag over the blocks of one depth pairs a closing
with its opening, islands of adjacent lines attach comments and annotations to the header below them. All windows
partition by chunk id, so the tokens are shuffled once, together with the dropping of repeated rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trovework.llm.lexing import CONFIG, blank, language_of, scanner
from trovework.session import written

COMMENT, ANNOTATION, HEADER, OPEN, CLOSE, DOCSTRING, TYPE = 1, 2, 3, 4, 5, 6, 7

#: Names before a bracket that are no functions.
_CONTROL = frozenset("if for while switch catch foreach using lock synchronized fixed return else do try when with elseif match guard sizeof defer select function new throw await yield in of typeof super this".split())
_ARGS = r"\((?:[^(){};]|\([^(){};]*\))*\)"
_C_LIKE = re.compile(rf"(?:^|\n)(?P<pre>[ \t]*(?:template\s*<[^\n]*>\s*)?(?:@\w+(?:\([^()\n]*\))?[ \t]+)*(?:\[\[?[\w, ()\"]+\]\]?[ \t]*)?[^\n(){{}};=#]*?)(?<![\w.>:~])(?:[\w<>]+::)*(?P<name>~?[A-Za-z_$]\w*)\s*(?:<[\w, ]+>)?{_ARGS}[^(){{}};=]*(?:noexcept\([^()]*\)|throw\([^()]*\)|:\s*\w+[^{{}};]*)?\Z")
_JS = re.compile(
    rf"(?:^|\n)[ \t]*(?:(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s*(?P<a>[\w$]+)\s*(?:<[^>\n]*>)?{_ARGS}"
    rf"|(?:export\s+)?(?:const|let|var)\s+(?P<b>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b\s*\*?\s*[\w$]*\s*{_ARGS}|(?:<[^>\n]*>\s*)?(?:{_ARGS}|[\w$]+)\s*(?::\s*[^=\n]+?)?\s*=>)"
    rf"|(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set|export)\s+)*\*?\s*\#?(?P<c>[\w$]+)\s*(?:<[^>\n]*>)?{_ARGS})(?:\s*:\s*[^{{;=]+?)?\s*\Z"
)
_ARROW = re.compile(r"=>[ \t]*(?=[^\s{])")
_ARROW_JS = re.compile(rf"[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:{_ARGS}|[\w$]+)\s*(?::\s*[^=\n]+?)?\s*\Z")
_ARROW_CS = re.compile(rf"[ \t]*(?:(?:public|private|protected|internal|static|override|virtual|async|sealed)\s+)+[^\n(){{}};=#]*?(?<![\w.>])(?P<name>[A-Za-z_]\w*)\s*{_ARGS}\s*\Z")
_WORDED = {
    "go": r"func\s*(?:\([^)\n]*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]\n]*\])?",
    "rust": r"(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s*(?:\"[^\"]*\"|\s)*\s*)?fn\s+(?P<name>\w+)\s*(?:<[^({]*>)?",
    "swift": r"(?:@\w+(?:\([^)\n]*\))?\s+)*(?:\w+(?:\(set\))?\s+)*?func\s+(?P<name>\w+|[^\s\w(]+)\s*(?:<[^({]*>)?",
    "kotlin": r"(?:@\w+(?:\([^)\n]*\))?\s+)*(?:\w+\s+)*?fun\s+(?:<[^>\n]*>\s*)?(?:[\w<>?, ]+\.)?(?P<name>\w+)\s*",
    "scala": r"(?:@\w+(?:\([^)\n]*\))?\s+)*(?:\w+(?:\[\w+\])?\s+)*?def\s+(?P<name>\w+)\s*(?:\[[^\]\n]*\])?",
    "php": r"(?:\w+\s+)*?function\s+&?\s*(?P<name>\w+)\s*",
}
_WORDED = {k: (re.compile(rf"{w}\b"), re.compile(rf"[ \t]*{_WORDED[k]}(?={'[(:=]' if k == 'scala' else '[(]'})")) for k, w in (("go", "func"), ("rust", "fn"), ("swift", "func"), ("kotlin", "fun"), ("scala", "def"), ("php", "function"))}
_BALANCED = re.compile(r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)")
_BODY = re.compile(r"[^{};=]*?(?:(?P<open>\{)|(?P<expr>=)(?![=>])|(?=[};])|\Z)")
_FIRST, _OPENS = re.compile(r"\s*(\w+)"), re.compile(r"\s*\{")
_PY_DEF = re.compile(r"(?m)^([ \t]*)(?:async[ \t]+)?def[ \t]+(\w+)[ \t]*\(")
_PY_CLASS = re.compile(r"(?m)^[ \t]*class[ \t]+\w+")
_RB = re.compile(
    r"(?m)^[ \t]*(?:(?:private|public|protected|module_function)\s+)?def\s+(?:self\.|\w+\.)?(?P<name>\w+[?!=]?)(?P<endless>[ \t]*(?:\([^)\n]*\))?[ \t]*=[ \t])?"
    r"|^[ \t]*(?P<block>(?:class|module|if|unless|while|until|case|begin|for)\b)|(?<==)\s*(?P<value>(?:if|unless|case|begin)\b)|\b(?P<do>do)[ \t]*(?:\|[^|\n]*\|)?[ \t]*\r?$|^[ \t]*(?P<end>end)\b"
)
_ANNOTATION = {
    **dict.fromkeys(("java", "kotlin", "scala", "swift", "typescript", "javascript", "python"), re.compile(r"(?m)^[ \t]*@[\w.]+(?:\([^\n]*\))?[ \t]*\r?$")),
    **dict.fromkeys(("rust", "php"), re.compile(r"(?m)^[ \t]*(?:#!?\[[^\n]*\]|@[\w.]+)[ \t]*\r?$")),
    "csharp": re.compile(r"(?m)^[ \t]*\[[A-Za-z][^\n]*\][ \t]*\r?$"),
    "cpp": re.compile(r"(?m)^[ \t]*(?:\[\[[^\n]*\]\]|template\s*<[^\n]*>)[ \t]*\r?$"),
    "c": re.compile(r"(?m)^[ \t]*__attribute__\s*\(\([^\n]*\)\)[ \t]*\r?$"),
}
#: What every annotation of a language holds.
_SIGNS = {**dict.fromkeys(("java", "kotlin", "scala", "swift", "typescript", "javascript", "python"), "@"), "rust": "#@", "php": "#@", "csharp": "[", "cpp": ("[[", "template"), "c": ("__attribute__",)}
_BRACE = re.compile(r"[{}](?:(?<=\})[ \t]*(?:else|catch|finally|while)\b[^{}\n]*\{|(?<=\{)[^{}\n]*\})?")

_MARK = re.compile(r"(?m)^[ \t]*(?:/\*+!?|\*+/|\*(?!\w)|//+!?|#+!?|\"\"\"|'''|[rRuU]?\"\"\"|=begin|=end|<!--)|\*+/[ \t]*$|(?:\"\"\"|''')[ \t]*$|-->|</?[a-z]\w*[^>\n]*>")
_TAG = re.compile(r"(?m)^[ \t]*(?:[@\\](?:param|arg|return|returns|throws|exception|see|since|author|version|type|deprecated|tparam|brief|inheritdoc|override)\b[ \t]*(?:\{[^}\n]*\}[ \t]*)?|:(?:param|returns?|raises|rtype|type)\b[^:\n]*:|- (?:Parameters?|Returns|Throws)\b:?)[ \t]*(?P<rest>[^\n]*)$", re.I)
#: Documentation that says nothing, without marks and in lower case.
STOCK = frozenset(
    "todo fixme tbd xxx hack description documentation n a na none see above see below no auto generated autogenerated inheritdoc method function constructor getter setter helper internal docs doc comment here add missing"
    " placeholder undocumented document this me please write to do fill in later wip stub the a an of for and or it is does".split()
)
_CODE = re.compile(r"(?:[;{}]\s*$)|^\s*(?:(?:const|let|var|val|auto|int|return|import|if|for|while|else|def|fn|func|fun|end)\b.*[=({;:]|end$|return\b)|^\s*[$\w.>\-\[\]]+\s*(?::=|[+\-*/]?=)\s*\S|^\s*[\w.$>:-]+\([^)]*\)\s*;?\s*$|^\s*\$\w+")
_LEGAL = re.compile(r"(?i)\b(?:copyright|licen[cs]ed? under|all rights|may be used under|spdx-license|generated by|do not edit)\b")
_WORD = re.compile(r"[^\W\d_]+|\d+")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_a-zA-Z]+|\d+")


@lru_cache(maxsize=100_000)
def _stem(w: str) -> str:
    w = w.lower()
    if w.endswith("ies") and len(w) > 4:
        w = w[:-3] + "y"
    for end in ("ing", "es", "ed", "s", "e"):
        if len(w) > len(end) + 2 and w.endswith(end):
            return w[: -len(end)]
    return w


def stems(text: str) -> list[str]:
    """Lower-case words of prose or of an identifier, without plural and verb endings."""
    return [_stem(w) for w in _PART.findall(text)]


_STOCK_STEMS = frozenset(x for w in STOCK for x in stems(w))


def doc_words(text: str) -> list[str] | None:
    """The stems that documentation adds beyond tags, marks and stock words; None where it is trivial or disabled code."""
    if text.startswith("/*!"):  # a banner
        return None
    t = _MARK.sub(" ", text.replace("\r", ""))
    if _LEGAL.search(t):
        return None
    if "@" in t or ":" in t or "\\" in t or "- " in t:
        t = _TAG.sub(lambda m: m["rest"] if len(m["rest"].split()) >= 4 else " ", t)
    lines = [x for x in t.split("\n") if x.strip()]
    code = sum(bool(_CODE.search(x.rstrip())) for x in lines)
    if not lines or code * 2 >= len(lines) and code:
        return None
    body = " ".join(lines)
    if len(lines) == 1 and re.match(r"(?i)\W*(?:todo|fixme|xxx|tbd|hack)\b", body):
        return None
    if not body.isascii() and len(cjk := re.findall(r"[぀-ヿ㐀-鿿]", body)) >= 4:
        return ["　", *sorted(set(cjk))]
    words = sorted({w for w in stems(body) if w not in _STOCK_STEMS and not w.isdigit()})
    if not words or body.lstrip()[:1] in "-=*#~_." and re.fullmatch(r"\s*([-=*#~_.]{3,})\s*[\w ]*?\s*\1?\s*", body):
        return None
    return words


def tokens(content: str, language: str) -> tuple[list[tuple[int, int, int, int, str]], str]:
    """(start, end, kind, function?, text) of each shaping token in order of start; and the code with comments and literals blanked."""
    out: list[tuple[int, int, int, int, str]] = []
    scan = scanner(language)
    if scan is None or language in CONFIG:
        return out, content
    parts, at, docs = [], 0, []
    find, rfind, python = content.find, content.rfind, language == "python"
    for m in scan.finditer(content):
        s, e = m.span()
        parts.append(content[at:s])
        at = e
        if m["s"] is None:
            text = m[0]
            parts.append(blank(text) if "\n" in text else " " * (e - s))
            if not content[rfind("\n", 0, s) + 1 : s].strip():
                tail = find("\n", e)
                if not content[e : tail if tail >= 0 else len(content)].strip():
                    out.append((s, e, COMMENT, 0, text))
        elif find("\n", s, e) < 0:
            parts.append(" " * (e - s))
            if python and not content[rfind("\n", 0, s) + 1 : s].strip():
                docs.append((s, e, m[0]))
        else:
            parts.append(blank(m[0]))
            if python and not content[rfind("\n", 0, s) + 1 : s].strip():
                docs.append((s, e, m[0]))
    parts.append(content[at:])
    code = "".join(parts)
    functions: dict[int, int] = {}
    heads: list[tuple[int, int, str]] = []
    if language == "python":
        _python(code, out, heads, docs)
    elif language == "ruby":
        for m in _RB.finditer(code):
            if m["name"]:
                heads.append((m.start(), m.end(), m["name"]))
                if not m["endless"]:
                    out.append((m.end(), m.end(), OPEN, 1, ""))
            elif m["end"]:
                out.append((m.start("end"), m.end(), CLOSE, 0, ""))
            elif not (m["do"] and re.match(r"[ \t]*(?:while|until|for)\b", code[code.rfind("\n", 0, m.start()) + 1 : m.start()])):
                out.append((m.start(m.lastgroup), m.end(), OPEN, 0, ""))
    else:
        if language in _WORDED:
            word, header = _WORDED[language]
            done = 0
            for w in word.finditer(code):
                start = max(code.rfind("\n", 0, w.start()) + 1, done)
                if not (m := header.match(code, start)):
                    continue
                at = done = m.end()
                while (b := _BALANCED.match(code, at)) and b.end() > at:
                    at = b.end()
                    if code[at : at + 1] != "(":
                        break
                b = _BODY.match(code, at)
                if b and b["open"]:
                    functions[b.start("open")] = 1
                    heads.append((m.start(), at, m["name"]))
                elif b and b["expr"] and language in ("kotlin", "scala"):
                    rest = _OPENS.match(code, b.end())
                    if rest:
                        functions[rest.end() - 1] = 1
                    heads.append((m.start(), at, m["name"]))
        elif _ARROW.search(code):
            arrow = _ARROW_JS if language in ("javascript", "typescript") else _ARROW_CS if language == "csharp" else None
            for m in _ARROW.finditer(code) if arrow else ():
                start = code.rfind("\n", 0, m.start()) + 1
                if f := arrow.match(code[start : m.start()]):
                    heads.append((start + len(f[0]) - len(f[0].lstrip()), m.end(), f["name"]))
        last, header = 0, language not in _WORDED
        for m in _BRACE.finditer(code):
            s, e = m.span()
            opens = code[s] == "{"
            if opens and header and (h := _header(code, max(last, code.rfind(";", last, s) + 1), s, language)):
                functions[s] = 1
                heads.append(h)
            if e - s == 1:
                out.append((s, e, OPEN if opens else CLOSE, functions.get(s, 0), ""))
                last = e
            elif not opens:
                last = e
            elif s in functions:
                out.append((s, s + 1, OPEN, 1, ""))
                out.append((e - 1, e, CLOSE, 0, ""))
                last = e
    out += [(s, e, HEADER, 0, name) for s, e, name in heads]
    if heads and language in _ANNOTATION and any(x in code for x in _SIGNS[language]):
        for m in _ANNOTATION[language].finditer(code):
            s = m.start() + len(m[0]) - len(m[0].lstrip())
            out.append((s, m.end(), ANNOTATION, 0, ""))
    out.sort()
    return out, code


def _header(code: str, start: int, end: int, language: str) -> tuple[int, int, str] | None:
    """The function header that ends where a block opens, if there is one between start and end."""
    text = code[start:end].rstrip()
    if len(text) < 3 or ("(" not in text and "=>" not in text):
        return None
    first = _FIRST.match(text)
    if first and first[1] in _CONTROL and first[1] not in ("new", "function", "lock", "match", "select", "this"):
        return None
    line = text.rfind("\n") + 1
    if line and text.count("(", line) == text.count(")", line):  # most headers are one line, the last
        start, text = start + line, text[line:]
        first = _FIRST.match(text)
        if first and first[1] in _CONTROL and first[1] not in ("new", "function", "lock", "match", "select", "this"):
            return None
    if language in ("javascript", "typescript"):
        m = _JS.search(text)
        name = m and (m["a"] or m["b"] or m["c"])
    else:
        m = _C_LIKE.search(text)
        name = m and m["name"]
        pre = m["pre"].split() if m else []
        if m and (not pre and language in ("c", "cpp", "java", "csharp") and name[:1].islower() or pre and pre[0] in ("return", "throw", "else", "class", "new") or pre and pre[-1] in ("new", "return", "else", "throw", "case", "class", "struct", "enum", "record", "interface")):
            return None
    if not name or name in _CONTROL:
        return None
    at = start + m.start() + len(m[0]) - len(m[0].lstrip())
    return at, end, name


def _python(code: str, out: list, heads: list, docs: list) -> None:
    """Blocks of Python by indentation, outside brackets."""
    headers = {m.start(): m[2] for m in _PY_DEF.finditer(code)}
    levels, pos, inside, pending, tail, first = [0], 0, 0, 0, 0, {s: (e, t) for s, e, t in docs}
    expects = False
    for line in code.split("\n"):
        text = line.strip()
        here = pos
        pos += len(line) + 1
        indent = len(line) - len(line.lstrip())
        if not text:
            if expects:  # a blanked line: a docstring, a comment or empty
                d = next((s for s in range(here, here + len(line)) if s in first), None) if first and len(line) < 400 else next((s for s in first if here <= s < pos), None)
                if d is not None:
                    out.append((d, first[d][0], DOCSTRING, 0, first[d][1]))
                    expects, tail = False, first[d][0]
            continue
        if not inside:
            if indent > levels[-1]:
                levels.append(indent)
                out.append((here, here, OPEN, int(pending), ""))
            else:
                if pending:  # a header without an indented body of code holds its docstring only
                    out.append((tail, tail, OPEN, 1, ""))
                    out.append((tail, tail, CLOSE, 0, ""))
                while indent < levels[-1]:
                    levels.pop()
                    out.append((here, here, CLOSE, 0, ""))
                if indent > levels[-1]:
                    levels.append(indent)
                    out.append((here, here, OPEN, 0, ""))
            pending, expects = 0, False
            if here in headers:
                heads.append((here + indent, here + len(line), headers[here]))
                pending = expects = 1
                tail = here + len(line)
            elif _PY_CLASS.match(line):
                out.append((here, here, TYPE, 0, ""))
                expects = True
        inside = max(0, inside + sum(map(line.count, "([{")) - sum(map(line.count, ")]}")))


_LEXED = "start array<int>, end array<int>, bol array<int>, line array<int>, end_line array<int>, kind array<tinyint>, fn array<tinyint>, text array<string>"


def shaped(content: str, language: str) -> list[tuple[int, int, int, int, int, int, int, str | None]]:
    """The tokens of a chunk that has a function header: start, end, begin of the line, line, end_line, kind, function?, and a text.

    A header's text is its name and the stems of the name, that of a comment or docstring its stems, all with blanks between; null
    where it says nothing. Comments and annotations that something else than a header follows are left out.
    """
    toks = tokens(content, language)[0]
    if not any(x[2] == HEADER for x in toks):
        return []
    kept, near, below = [], False, 0
    for x in reversed(toks):
        if x[2] in (COMMENT, ANNOTATION):
            # what stands between belongs to the header only where no blank line and no code parts them
            near = near and not content.count("\n", x[1], below) > 1
        else:
            near = x[2] == HEADER or near and x[2] in (OPEN, CLOSE)
        if near or x[2] not in (COMMENT, ANNOTATION):
            kept.append(x)
            below = x[0] if x[2] in (COMMENT, ANNOTATION, HEADER) else below
    out, at, line, count = [], 0, 1, content.count
    for s, e, kind, fn, text in reversed(kept):
        line += count("\n", at, s)
        at = s
        words: list[str] | None = None
        if kind == HEADER:
            words = [text, *stems(text)]
        elif kind in (COMMENT, DOCSTRING):
            words = doc_words(text)
        last = line if kind in (OPEN, CLOSE, TYPE) or e - s < 2 else line + count("\n", s, e - 1)
        out.append((s, e, content.rfind("\n", 0, s) + 1, line, last, kind, fn, None if words is None else " ".join(words)))
    return out


def _lex(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int32()] * 5 + [pa.int8()] * 2 + [pa.string()]
    for b in batches:
        rows, sizes, kept = [], [0], []
        for n, (t, p, g) in enumerate(zip(*(b.column(c).to_pylist() for c in ("content", "source_file", "language")))):
            if found := shaped(t, language_of(p, g)):
                rows += found
                sizes.append(len(rows))
                kept.append(n)
        flat = [*zip(*rows)] or [()] * 8
        arrays = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(c, t)) for c, t in zip(flat, types)]
        rest = b.drop_columns(["content", "source_file", "language"]).take(pa.array(kept, pa.int32()))
        yield pa.RecordBatch.from_arrays([*rest.columns, *arrays], names=[*rest.schema.names, *(c.split()[0] for c in _LEXED.split(", "))])


def lexed(chunks: DataFrame, *more: str, where: str = "true") -> DataFrame:
    """A row for each token of each distinct chunk with a function header: id, the columns in more, pos, and the token's fields.

    where is a condition on the arrays of a chunk's tokens that it must meet.
    """
    slim = chunks.select("id", *more, "content", "source_file", "language").where(F.col("content").isNotNull() & (F.col("content") != ""))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.select("id", *more).schema) + ", " + _LEXED
    arrays = slim.mapInArrow(_lex, schema).where(where).dropDuplicates(["id"])
    names = [c.split()[0] for c in _LEXED.split(", ")]
    return arrays.select("id", *more, F.posexplode(F.arrays_zip(*names)).alias("pos", "t")).select("id", *more, "pos", "t.*")


def headers(lex: DataFrame, *more: str) -> DataFrame:
    """Function headers outside other functions: id, name, line, the first line of what is attached, and the stems of the documentation."""
    by_id = Window.partitionBy("id").orderBy("pos")
    # depth of each block: an opening and its closing have the same
    block = F.when(F.col("kind") == OPEN, 1).when(F.col("kind") == CLOSE, -1).otherwise(0)
    t = lex.withColumn("depth", F.sum(block).over(by_id) + F.when(F.col("kind") == CLOSE, 1).otherwise(0))
    # a closing belongs to a function where the token before it at that depth is a function's opening
    same = Window.partitionBy("id", F.col("kind").isin(OPEN, CLOSE), "depth").orderBy("pos")
    t = t.withColumn("opened_fn", F.lag("fn").over(same)).withColumn("close_end", F.lead("end").over(same))
    step = F.when(F.col("kind") == OPEN, F.col("fn").cast("int")).when(F.col("kind") == CLOSE, -F.coalesce(F.col("opened_fn").cast("int"), F.lit(0))).otherwise(0)
    t = t.withColumn("inside", F.sum(step).over(by_id))
    # islands of adjacent lines; a header ends its island
    t = t.where(F.col("kind").isin(COMMENT, ANNOTATION, HEADER, DOCSTRING, TYPE) | (F.col("kind") == OPEN) & (F.col("fn") == 1))
    joined = (F.col("line") == F.lag("end_line").over(by_id) + 1) & F.lag("kind").over(by_id).isin(COMMENT, ANNOTATION) & F.col("kind").isin(COMMENT, ANNOTATION, HEADER)
    t = t.withColumn("island", F.sum(F.when(joined, 0).otherwise(1)).over(by_id))
    inland = Window.partitionBy("id", "island").orderBy("pos")
    t = t.withColumn("first_line", F.min("line").over(inland)).withColumn("first_bol", F.min("bol").over(inland)).withColumn("above", F.collect_list(F.when(F.col("kind") == COMMENT, F.col("text"))).over(inland))
    t = t.withColumn("doc_start", F.min(F.when(F.col("kind") == COMMENT, F.col("start"))).over(inland)).withColumn("doc_end", F.max(F.when(F.col("kind") == COMMENT, F.col("end"))).over(inland))
    # a docstring belongs to the header before it, with nothing but comments between
    t = t.where(F.col("kind").isin(HEADER, DOCSTRING, TYPE, OPEN))
    body = [F.when(F.lead("kind", n).over(by_id) == OPEN, F.lead("close_end", n).over(by_id)) for n in (1, 2)]
    t = t.withColumn("code_end", F.when(F.lead("kind").over(by_id) == OPEN, body[0]).when(F.lead("kind").over(by_id) == DOCSTRING, body[1]))
    after = F.lead("kind").over(by_id) == DOCSTRING
    t = t.withColumn("docstring", F.when(after, F.lead("text").over(by_id))).withColumn("ds_start", F.when(after, F.lead("start").over(by_id))).withColumn("ds_end", F.when(after, F.lead("end").over(by_id)))
    t = t.where((F.col("kind") == HEADER) & (F.col("inside") == 0))
    t = t.withColumn("words", F.split("text", " ")).withColumn("name", F.element_at("words", 1)).withColumn("words", F.slice("words", 2, F.size("words")))
    docs = F.filter(F.concat(F.col("above"), F.array("docstring")), lambda w: w.isNotNull())
    says = F.exists(docs, lambda w: F.size(F.array_except(F.split(w, " "), F.col("words"))) > 0)
    return t.select("id", *more, "name", "line", "first_line", "first_bol", "start", "depth", "words", "code_end", F.coalesce(says, F.lit(False)).alias("documented"), "doc_start", "doc_end", "ds_start", "ds_end")


def functions_with_docs(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """Functions with documentation that isn't trivial: id, func_name, line, the places of code and documentation in content, and summary.

    chunks needs id, content, source_file, language, entity_type, entity_name, start_line, end_line; results the last
    four of these but entity_type, source_file and doc_summary. The documentation is a comment or docstring at its place, else the
    first in order of the summaries. Null or empty contents and files of unknown kind give no rows.
    """
    place = ["source_file", "entity_name", "start_line", "end_line"]
    # 128 bits of hash stand for the four columns, so that they needn't go through the windows; a null matches nothing
    key = F.when(F.expr(" and ".join(f"{c} is not null" for c in place)), F.struct(F.xxhash64(*place).alias("a"), F.xxhash64(F.lit(1), *reversed(place)).alias("b")))
    single = F.lower("entity_type").isin("function", "method", "constructor")
    src = chunks.withColumn("fn_key", F.when(single, key)).withColumn("entity", F.when(single, F.regexp_extract(F.regexp_replace("entity_name", r"\(.*$", ""), r"([^.#:\\]+)$", 1)))
    # a chunk with neither comments nor summaries has no documentation
    some = f"fn_key is not null or array_contains(kind, {COMMENT}Y) or array_contains(kind, {DOCSTRING}Y)"
    heads = written(headers(lexed(src, "fn_key", "entity", where=some), "fn_key", "entity"), "headers")  # used twice
    words = F.pandas_udf(lambda s: pd.Series([doc_words(x) if x else None for x in s], dtype=object), "array<string>")
    said = results.where(F.col("doc_summary").isNotNull() & (F.trim("doc_summary") != "")).select(key.alias("fn_key"), "doc_summary").distinct()
    said = said.withColumn("said", words("doc_summary")).where("said is not null")
    bare = heads.where((F.col("name") == F.col("entity")) & F.col("fn_key").isNotNull() & ~F.col("documented"))
    from_results = bare.join(said, "fn_key").where(F.size(F.array_except("said", "words")) > 0).groupBy("id", "name", "line", "start", "code_end").agg(F.min("doc_summary").alias("summary"))
    at = ["doc_start", "doc_end", "ds_start", "ds_end"]
    own = heads.where("documented").select("id", "name", "line", "start", "code_end", *at, F.lit(None).cast("string").alias("summary"))
    rest = from_results.select("id", "name", "line", "start", "code_end", *[F.lit(None).cast("int").alias(c) for c in at], "summary")
    return own.unionByName(rest).withColumnRenamed("name", "func_name")


def pairs(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """As functions_with_docs(), with the texts: id, func_name, line, code and doc."""
    found = functions_with_docs(chunks, results)
    texts = chunks.select("id", "content")
    piece = lambda a, b: F.expr(f"substring(content, {a} + 1, {b} - {a})")
    doc = F.when(F.col("ds_start").isNotNull(), piece("ds_start", "ds_end")).when(F.col("doc_start").isNotNull(), piece("doc_start", "doc_end")).otherwise(F.col("summary"))
    code = F.expr("substring(content, start + 1, coalesce(code_end, length(content)) - start)")
    # repeated rows go after the join, which has brought the rows of an id together already
    return found.join(texts, "id").select("id", "start", "func_name", "line", code.alias("code"), doc.alias("doc")).dropDuplicates(["id", "start"]).drop("start")
