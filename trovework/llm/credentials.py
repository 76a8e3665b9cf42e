"""Credentials in source code and configuration: find them, and redact them without breaking the code around.

Configuration formats are parsed into key paths with the offsets of their values, code into literals with the name
or call before them. A value is a credential by the shape it has, or by its shape under a sensitive key. Redactions
are spliced into the original UTF-8 bytes, so every other byte stays as it was.

Null or empty content gives no rows and is returned as it is; repeated rows of one id come out once; other columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovework.llm.lexing import CONFIG, language_of, scanner

#: Words that make a key sensitive, whole words after splitting camelCase, snake_case and dots.
SENSITIVE_WORDS = frozenset(
    "password passwd pwd passphrase passcode pass pw secret credential credentials bearer kennwort passwort contrasena contraseña senha"
    " motdepasse mdp zugangstoken apikey authtoken accesstoken secretkey privatekey clientsecret dbpass dbpwd dbpassword пароль".split()
)
SENSITIVE_PAIRS = frozenset(
    "api key,auth token,access token,access key,secret key,private key,signing key,storage key,encryption key,master key,account key,session token,refresh token,client secret,"
    "webhook secret,github token,gitlab token,slack token,bot token,api token,mot passe,bearer token,service key,license key,id token,deploy key,deploy token,shared key".split(",")
)
#: The last word of a key that names something about a secret, not the secret.
ABOUT = frozenset(
    "name names field column label type types path file dir url uri host port prefix suffix length len size limit count policy mode header id ids index format pattern regex hint"
    " prompt text message title enabled required ttl expiry expires timeout env var ref alias input form user username public store provider manager service tokenizer hash".split()
)
#: Parts of values that stand in for a secret.
PLACEHOLDER = re.compile(
    r"(?i)^(?:|[x*.#_\-•?0]+|.*(?:change[-_ ]?me|your[-_ ]?\w*[-_ ]?(?:token|key|secret|password|pass)|insert[-_ ]|placeholder|redacted|replace[-_ ]?(?:me|this|with)|[-_ ]here\b|dummy|to[-_ ]?do\b|fill[-_ ]?in|not[-_ ]?set|undefined|sample[-_ ]|\bexample\b|example[-_]|masked|removed|hidden).*"
    r"|(?:none|null|nil|true|false|unset|empty|default|test|admin|root|secret|password|passwd|token|key|n/a|na|tbd)|<.*>|&lt;.*|\$\{.*|\$\(.*|%\{.*|\{\{.*|%\(.*|%\w+%|\$[A-Za-z_]\w*|#\{.*|@\w+@|\[.*\]|env[:(].*|vault[:/(].*|secret://.*|arn:.*|ref\+.*|!.*vault.*)$",
    re.S,
)
#: Shapes that only secrets have.
TOKEN = re.compile(
    r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|github_pat_\w{30,}|glpat-[\w-]{20}|xox[abeprs]-[\w-]{20,}|sk-(?:[a-z]+-)?[\w]{32,}|[sr]k_(?:live|test)_\w{20,}|AIza[\w-]{35}"
    r"|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{10,}|SG\.[\w-]{16,}\.[\w-]{16,}|hf_[A-Za-z0-9]{30,}|npm_[A-Za-z0-9]{36}|pypi-[\w-]{40,}|dop_v1_[0-9a-f]{64}|shp(?:at|ss)_[0-9a-fA-F]{32}"
    r"|[a-z]{2,8}_(?:live|test|prod)_[A-Za-z0-9]{20,}|[a-z]{2,5}-[a-z0-9]{8}-[a-z0-9]{16,})(?![A-Za-z0-9])"
)
KEY_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_BODY = re.compile(r"(?:[\s*/#;\"'+.,\\rn>-]|\\[nr])*(?:Proc-Type[^\n]*|DEK-Info[^\n]*|[\s*/#;\"'+]|\\[nr])*[A-Za-z0-9+/=]{16,}")
_KEY_END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
#: The body of a key: runs of base64, 16 signs or more with a digit or sign among them, and a last shorter one, between quotes, comment signs and line ends.
_GAP = r"(?:[\s*/#;\"'+.,>|(){}\[\]-]|\\[nr])"
_RUN = r"(?=[A-Za-z]*[0-9+/=])[A-Za-z0-9+/=]{16,}"
_KEY_BODY = re.compile(rf"(?:{_GAP}*(?:(?:Proc-Type|DEK-Info|Version|Comment)\b[^\n\\\"']*|{_RUN}))+(?:{_GAP}{{1,8}}[A-Za-z0-9+/]{{0,14}}={{1,2}})?")
URL = re.compile(r"\b[a-zA-Z][a-zA-Z0-9+.\-]*://([^\s/:@\"'<>]*):([^\s/@\"'<>]+)@(?=[\w\[])")
PARAM = re.compile(r"(?i)(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase)?|pwd|secret|(?:access|auth|api)[_-]?(?:token|key)|accountkey|sharedaccesskey|sig|token)=([^&;\s\"'<>]+)")
HEADER = re.compile(r"(?i)\b(authorization|proxy-authorization|x-[a-z-]*(?:key|token|secret)|api-key|private-token)[\"']?\s*[:=,]\s*[\"']?\s*(?:(basic|bearer|token|apikey|key)\s+)?([^\s\"',;]+)")
FLAG = re.compile(
    r"(?:(?<=\s)-u[ =]?[^\s:\"']+:([^\s\"'@]+))|(?:\b(?:mysql|mysqldump|mysqladmin|mariadb)\b[^\n\"']*?\s-p([^\s\"']+))|(?:--(?:[a-z]+-)?(?:password|passwd|pass|token|secret|api-key|apikey|access-key|secret-key)[= ]([^\s\"']+))"
    r"|(?:\bsshpass\s+-p\s*([^\s\"']+))|(?:\b(?:PGPASSWORD|MYSQL_PWD|REDISCLI_AUTH|SSHPASS)=([^\s\"';]+))"
)
_CALL = re.compile(r"(?i)(?:log_?in|log_?on|sign_?in|connect|auth(?:enticate|orize)?|basic_?auth|set_?(?:credentials|password|passwd)|credentials?|open_?session|bind)\s*\(\s*(?:[\w.]+\s*,\s*|[\"'][^\"'\n]*[\"']\s*,\s*|user\w*\s*[:=]\s*[\"'][^\"'\n]*[\"']\s*,\s*)+$")
_SETPASS = re.compile(r"(?i)(?:set_?|with_?)?(?:password|passwd|secret|api_?key|(?:auth|access)_?token)\s*\(\s*$")
_NAME = re.compile(r"([A-Za-z_$@\u00c0-\u024f\u0400-\u04ff][\w$.\-]*)[\"'\]]*\s*(?:(?:(?<!:):(?!:)|\bas\b)\s*[\w<>\[\]?*&. :]+?\s*)?(?::=|=>|=|:)\s*(?:[\w.]+\()?\s*$")
_KV = re.compile(r"([A-Za-z_\u00c0-\u024f\u0400-\u04ff][\w.\-]*)\s*(?::=|=>|=|:)\s*(\"[^\"\n]*\"|'[^'\n]*'|[^\s\"',;)]+)")
_SPLIT = re.compile(r"[A-Z]+(?![a-zß-ÿ])|[A-Z]?[a-zß-ÿа-яё]+|[А-ЯЁ][а-яё]*|\d+")
_SCALAR = re.compile(r"[|>][+-]?\d?[+-]?\s*(?:#.*)?\Z")
#: A value in a map or list on one line, with its key if it has one.
_FLOW = re.compile(r"""(?:([\w.\-]+|"[^"\n]*"|'[^'\n]*')\s*[:=]\s*)?(?:"([^"\n]*)"|'([^'\n]*)'|([^\s,{}\[\]"'][^,{}\[\]"'\n]*?)(?=\s*[,}\]]))""")
_GLUE = re.compile(r"\s*(?:\+|\.|\.\.|<<|&|\\\n)?\s*\Z")
_HEX = re.compile(r"[0-9a-fA-F]+\Z")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\Z")
_PHRASE = re.compile(r"[^\W\d_]{3,}(?:[ _-][^\W\d_]{3,}){2,}[ _-]?\d+[!?.]?\Z")
_OTHER = re.compile(r"(?i)(?:sha\d+[-:]|data:|https?:|[./~]|\w+://|[a-z]+/[a-z]|\d+(?:[.:-]\d+)*\Z|.*%[sdv]|.*\.(?:json|ya?ml|txt|pem|key|crt|cfg|ini|log|xml|toml|env|jks)\Z)")


def words_of(key: str) -> list[str]:
    return [w.lower() for w in _SPLIT.findall(key)]


_TAIL = re.compile(r"(?:(?<!by)(?<!com)pass|password|passwd|passphrase|pwd|secret|apikey|kennwort|contrasena|motdepasse|credential|(?:auth|access|api|github|zugangs|bearer)token|(?:secret|signing|storage|private|access)key)\Z")


def sensitive(key: str) -> int:
    """2 for a key that names a secret by itself, 1 for a bare token or key, 0 for others. The key may be a path."""
    w = words_of(key.rsplit("/", 1)[-1])
    if not w or w[-1] in ABOUT or "public" in w:
        return 0
    if any(x in SENSITIVE_WORDS for x in w) or any(f"{a} {b}" in SENSITIVE_PAIRS for a, b in zip(w, w[1:])) or {"mot", "passe"} <= {*w} or "".join(w[-2:]) in SENSITIVE_WORDS or _TAIL.search("".join(w)):
        return 2
    return int(w[-1] in ("token", "jwt", "pat") or w in (["key"], ["auth"]))


def entropy(v: str) -> float:
    return -sum(n / len(v) * math.log2(n / len(v)) for n in Counter(v).values())


def random_like(v: str) -> bool:
    """One run of at least 20 letters and digits mixed as only a generator does; no hex, UUID, path or data."""
    if len(v) < 20 or _HEX.match(v) or _UUID.match(v) or _OTHER.match(v) or not re.fullmatch(r"[\w+/=.~\-]+", v):
        return False
    return bool(re.search(r"\d", v) and re.search(r"[A-Za-z]", v)) and entropy(v) > 3.6 and len(re.findall(r"[a-z](?=[A-Z0-9])|[0-9](?=[A-Za-z])|[A-Z](?=[0-9])", v)) >= 5


def secret_value(v: str, level: int) -> bool:
    """Whether v is a secret under a key of that level, or by a context that takes only secrets (3)."""
    if PLACEHOLDER.match(v):
        return False
    if TOKEN.fullmatch(v):
        return True
    if level == 3:
        return len(v) >= 4 and not re.fullmatch(r"(?:[%$]\w+|:\w+|\?)", v)
    if level == 1:
        return bool(random_like(v) or (_HEX.fullmatch(v) and len(v) in (32, 40, 64)))
    if _HEX.fullmatch(v) and len(v) in (32, 40, 48, 64):
        return True
    if " " in v:
        return bool(_PHRASE.fullmatch(v))
    if len(v) < 6 or _UUID.match(v) or re.match(r"(?i)(?:https?:|\w+://|[./~]/|/|sha\d+-|data:)", v) or re.fullmatch(r"[A-Z][A-Z0-9_]*", v) and "_" in v and not re.search(r"\d{3}", v):
        return False
    if random_like(v):
        return True
    if re.search(r"[(){}<>\[\]]|%[sdv]", v) or re.fullmatch(r"\d+(?:[.:\-]\d+)*", v):
        return False
    letters, digits, signs = (len(re.findall(p, v)) for p in (r"[^\W\d_]", r"\d", r"[^\w\s]"))
    if not digits:
        return signs >= 1 and bool(re.search(r"[a-z]", v) and re.search(r"[A-Z]", v)) and not re.fullmatch(r"[\w.\-/]+", v)
    return letters >= 2 and not re.fullmatch(r"[a-z]+(?:[._/\-][a-z]+)+\d?", v) and not re.fullmatch(r"(?i)(?:sha|aes|rsa|md|utf|base|hs|rs|es|oauth|v|http|tls|ssl)[-_]?\d+(?:[-_/.]\w+)*", v)


def _basic(v: str) -> bool:
    try:
        user, colon, word = base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode().partition(":")
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return False
    return bool(colon and word) and secret_value(word, 3)


def in_text(t: str, at: int, found: list) -> None:
    """Credentials whose context is in the text itself: addresses, parameters, headers, commands and known shapes."""
    if "://" in t:
        for m in URL.finditer(t):
            if secret_value(m[2], 3):
                found.append((at + m.start(2), at + m.end(2), "url", "address"))
    if "=" in t:
        for m in PARAM.finditer(t):
            if secret_value(m[1], 2 if not re.search(r"://|;", t) else 3):
                found.append((at + m.start(1), at + m.end(1), "param", "address"))
    if ":" in t or "=" in t or "," in t:
        for m in HEADER.finditer(t):
            kind, v = (m[2] or "").lower(), m[3]
            if _basic(v) if kind == "basic" else secret_value(v, 2) and (kind or m[1].lower() not in ("authorization", "proxy-authorization") or random_like(v)):
                found.append((at + m.start(3), at + m.end(3), m[1], "header"))
    if "-" in t or "PASS" in t or "PWD" in t or "AUTH" in t:
        for m in FLAG.finditer(t):
            k = m.lastindex
            if k and secret_value(m[k], 3):
                found.append((at + m.start(k), at + m.end(k), "flag", "command"))
    for m in TOKEN.finditer(t):
        if not PLACEHOLDER.match(m[0]) and entropy(m[0]) > 2.8:
            found.append((at + m.start(), at + m.end(), "", "shape"))


def config_values(t: str, language: str) -> Iterator[tuple[str, int, int]]:
    """Key paths of a configuration file with the offsets of their values."""
    if language == "xml":
        stack: list[str] = []
        for m in re.finditer(r"<!--[\s\S]*?-->|<(/?)([\w.:\-]+)((?:\s+[\w.:\-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(/?)>([^<]*)", t):
            if m[2] is None:
                continue
            if m[1]:
                if stack:
                    stack.pop()
                continue
            named = re.search(r"\b(?:name|key|id)\s*=\s*[\"']([^\"']*)", m[3])
            for a in re.finditer(r"([\w.:\-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", m[3]):
                k = 2 if a[2] is not None else 3
                key = named[1] if named and a[1] == "value" else a[1]
                yield "/".join([*stack, m[2], key]), m.start(3) + a.start(k), m.start(3) + a.end(k)
            if not m[4]:
                stack.append(m[2])
                if m[5].strip():
                    lead = len(m[5]) - len(m[5].lstrip())
                    yield "/".join([*stack[:-1], named[1] if named else m[2]]), m.start(5) + lead, m.start(5) + len(m[5].rstrip())
        return
    if language == "json":
        # an object's place on the stack holds the key of the value that comes next, an array's the key that it is the value of
        stack, owner = [], []
        for m in re.finditer(r"([{\[])|([}\]])|\"((?:\\.|[^\"\\])*)\"(\s*:)?|(,)", t):
            if m[1]:
                stack.append((m[1], ""))
                owner.append(m[1] == "[")
            elif m[2]:
                if stack:
                    stack.pop()
                    owner.pop()
            elif m[4]:
                if stack and not owner[-1]:
                    stack[-1] = ("{", m[3])
            elif m[3] is not None:
                yield "/".join(k for _, k in stack if k), m.start(3), m.end(3)
            elif stack and not owner[-1]:
                stack[-1] = ("{", "")
        return
    section, levels = "", []
    for m in re.finditer(r"(?m)^([ \t]*)(?:-[ \t]+)?(?:export[ \t]+|set[ \t]+)?(?:\[+([^\]\n]+)\]+|(\"[^\"\n]+\"|'[^'\n]+'|[\w.\-/]+)[ \t]*(:=|=|:(?=[ \t\r\n]|$)|:(?!//)(?=\S)))?([^\n]*)$", t):
        if m[2] and language in ("toml", "properties", "dotenv"):
            section = m[2].strip() + "/"
        if m[3] is None or language != "properties" and m[0].lstrip().startswith("#") or language == "yaml" and m[4] != ":" or language in ("dotenv", "shell", "toml") and m[4] != "=":
            continue
        key, depth = m[3].strip("\"'"), len(m[1])
        while levels and levels[-1][0] >= depth:
            levels.pop()
        v, at = m[5].rstrip(), m.start(5)
        lead = len(v) - len(v.lstrip())
        v, at = v.lstrip(), at + lead
        path = (section if language != "yaml" else "".join(k + "/" for _, k in levels)) + key
        if language == "yaml" and not v:
            levels.append((depth, key))
            continue
        if language == "yaml" and _SCALAR.match(v):  # the block's only line, if it has one
            block = re.compile(rf"(?:\r?\n[ \t]*(?=\r?\n|\Z))*\r?\n[ \t]{{{depth + 1},}}(\S[^\n]*?)[ \t\r]*(?=\n|\Z)(?!\n[ \t]{{{depth + 1},}}\S)").match(t, m.end())
            if block:
                yield path, block.start(1), block.end(1)
            continue
        if v[:1] in ("{", "[") and language in ("yaml", "toml"):
            for x in _FLOW.finditer(t, at, at + len(v)):
                k = 2 if x[2] is not None else 3 if x[3] is not None else 4
                yield f"{path}/{x[1].strip(chr(34) + chr(39))}" if x[1] else path, x.start(k), x.end(k)
            continue
        if v[:1] in "\"'" and v:
            end = v.find(v[0], 1)
            v, at = v[1 : end if end > 0 else len(v)], at + 1
        elif language in ("yaml", "toml", "dotenv", "shell"):
            v = re.split(r"\s+#", v)[0].rstrip()
        yield path, at, at + len(v)


#: The kind of a place that continues a key of the chunk before.
PART = "part of a private key"


def key_state(content: str) -> int:
    """1 where content ends inside a private key, 2 where it is nothing but a key's body, else 0."""
    last = None
    if "PRIVATE KEY" in content:
        for last in KEY_BEGIN.finditer(content):
            pass
        return int(last is not None and bool(m := _KEY_BODY.match(content, last.end())) and m.end() >= len(content.rstrip(" \t\r\n\"'+*/#;,\\")))
    head = content[:200].split("\n", 1)[0]
    m = _KEY_BODY.match(content) if re.search(_RUN, head) else None
    return 2 if m and not content[m.end() :].strip() else 0


def secrets(content: str, language: str) -> list[tuple[int, int, str, str]]:
    """(start, end, key, kind) of each credential in content, in characters, without overlaps, in order."""
    found: list[tuple[int, int, str, str]] = []
    if "PRIVATE KEY" in content:
        for m in KEY_BEGIN.finditer(content):
            if _BODY.match(content, m.end()):
                end = _KEY_END.search(content, m.end())
                # a key that the chunk's border cuts reaches to the end of its body
                found.append((m.start(), end.end() if end else _KEY_BODY.match(content, m.end()).end(), "", "private key"))
        first = _KEY_END.search(content)
        if first and not KEY_BEGIN.search(content, 0, first.start()) and (rest := _KEY_BODY.match(content)) and not content[rest.end() : first.start()].strip(" \t\r\n\"'+*/#;,\\"):
            found.append((0, first.end(), "", PART))  # the rest of a key that began in the chunk before
    if language in CONFIG:
        rest = 0
        for key, a, b in config_values(content, language):
            if a > rest:
                in_text(content[rest:a], rest, found)
            rest = max(rest, b)
            v = content[a:b]
            if language == "xml":
                v = v.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&").replace("&quot;", '"')
            level = sensitive(key)
            if level and secret_value(v, level):
                found.append((a, b, key, "value"))
            else:
                in_text(content[a:b].replace("&amp;", "&    ") if "&amp;" in content[a:b] else content[a:b], a, found)
                if not level and random_like(v) and TOKEN.search(v):
                    found.append((a, b, key, "shape"))
        in_text(content[rest:], rest, found)
    scan = scanner(language) or scanner("javascript")
    joined: list[tuple[int, int]] = []
    for m in scan.finditer(content):
        if m.lastgroup is None and m["c"] is None and m["s"] is None:
            continue
        if m["c"] is not None:
            t = m[0]
            if len(t) > 8 and ("=" in t or ":" in t or "-" in t or "_" in t or TOKEN.search(t)):
                in_text(t, m.start(), found)
                for k in _KV.finditer(t):
                    v = k[2].strip("\"'")
                    level = sensitive(k[1])
                    if level and secret_value(v, level) and not re.search(r"[()]", v):
                        a = m.start() + k.start(2) + (k[2][:1] in "\"'")
                        found.append((a, a + len(v), k[1], "comment"))
            continue
        if language in CONFIG:
            continue
        s, e = m.span()
        if joined and _GLUE.match(content[joined[-1][1] : s]) and s - joined[-1][1] < 60 and content[joined[-1][1] : s].strip() != ",":
            joined.append((s, e))
            continue
        _literal(content, joined, found)
        joined = [(s, e)]
    _literal(content, joined, found)
    out: list[tuple[int, int, str, str]] = []
    for x in sorted(set(found), key=lambda f: (f[0], -f[1])):
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def _inner(content: str, s: int, e: int) -> tuple[int, int]:
    """The offsets of a literal's value without its quotes and prefix."""
    m = re.match(r"[A-Za-z@$]{0,3}#*(\"\"\"|'''|[\"'`])", content[s : s + 8])
    if not m:
        return s, e
    return s + m.end(), max(s + m.end(), e - len(m[1]))


def _literal(content: str, parts: list[tuple[int, int]], found: list) -> None:
    """Tests a literal, or parts of one that are joined; found gets each part of a secret."""
    if not parts:
        return
    spans = [_inner(content, s, e) for s, e in parts]
    v = "".join(content[a:b] for a, b in spans)
    if len(v) < 4:
        return
    if len(parts) == 1:
        n = len(found)
        in_text(v, spans[0][0], found)
        if len(found) > n:
            return
    elif TOKEN.fullmatch(v):
        found.extend((a, b, "", "shape") for a, b in spans if b > a)
        return
    s = parts[0][0]
    line = content.rfind("\n", 0, s) + 1
    before = content[max(line, min(s - 160, max(content.rfind(c, line, s) for c in ",;{}"))) : s]
    name = _NAME.search(before)
    level = sensitive(name[1]) if name else 0
    if not level and (_CALL.search(before) or _SETPASS.search(before)):
        level, name = 2, None
    if level and secret_value(v, level) or len(parts) > 1 and random_like(v) and bool(level):
        found.extend((a, b, name[1] if name else "call", "value") for a, b in spans if b > a)
    elif len(parts) > 1:
        in_text(v, spans[0][0], whole := [])
        if whole:
            found.extend((a, b, "", "joined") for a, b in spans if b > a)


_SITES = "id string, line_no int, key string, kind string, byte_start int, byte_end int"


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in frames:
        rows = []
        for i, t, path, lang in zip(p["id"], p["content"], p["source_file"], p["language"]):
            if not t:
                continue
            for a, b, key, kind in secrets(t, language_of(path, lang)):
                start = a if t.isascii() else len(t[:a].encode("utf-8", "surrogatepass"))
                size = len(t[a:b].encode("utf-8", "surrogatepass"))
                rows.append((i, t.count("\n", 0, a) + 1, key, kind, start, start + size))
        yield pd.DataFrame(rows, columns=["id", "line_no", "key", "kind", "byte_start", "byte_end"])


def find_credentials(chunks: DataFrame) -> DataFrame:
    """The place of each credential: id, line_no, key, kind, byte_start and byte_end in the content's UTF-8 bytes.

    chunks needs id, content, source_file and language. No shuffle but the one that drops repeated rows, which
    carries only the found places.
    """
    slim = chunks.select("id", "content", "source_file", "language").where(F.col("content").isNotNull() & (F.col("content") != ""))
    return slim.mapInPandas(_scan, _SITES).dropDuplicates(["id", "byte_start", "byte_end"])


def redact_credentials(chunks: DataFrame, mark: str = "REDACTED") -> DataFrame:
    """id, content with each credential's bytes replaced by mark, and n_redacted; each id comes out once.

    A key that chunks' borders cut is redacted in all of them: a chunk of nothing but a key's body is redacted whole where a
    chunk before it in its file ends inside a key. Such chunks are few, and only their ids and places are joined.
    """
    slim = chunks.select("id", "content", "source_file", "language", "start_byte") if "start_byte" in chunks.columns else chunks.select("id", "content", "source_file", "language", F.lit(0).alias("start_byte"))
    state = F.pandas_udf(lambda s: pd.Series([key_state(t) if t else 0 for t in s], dtype="int32"), "int")
    # the signs that a body or a marker must hold are looked for before anything leaves the JVM
    maybe = slim.where(F.contains("content", F.lit("PRIVATE KEY")) | F.col("content").rlike(r"\A[^\n]{0,40}[A-Za-z0-9+/=]{16}[^\n ]{0,80}(?:\n|\z)"))
    cut = maybe.select("id", "source_file", "start_byte", state("content").alias("state")).where("state > 0")
    opened = cut.where("state = 1 and source_file is not null").groupBy("source_file").agg(F.min("start_byte").alias("opened"))
    bodies = cut.where("state = 2").join(opened, "source_file").where("start_byte >= opened").select("id").distinct().withColumn("body", F.lit(True))

    @F.pandas_udf("content string, n_redacted int")
    def splice(content: pd.Series, path: pd.Series, lang: pd.Series, body: pd.Series) -> pd.DataFrame:
        out = []
        for t, p, g, whole in zip(content, path, lang, body):
            sites = [(0, len(t), "", PART)] if t and whole else secrets(t, language_of(p, g)) if t else []
            raw, at, parts = (t or "").encode("utf-8", "surrogatepass"), 0, []
            for a, b, _, _ in sites:
                x = len(t[:a].encode("utf-8", "surrogatepass"))
                parts += [raw[at:x], mark.encode()]
                at = x + len(t[a:b].encode("utf-8", "surrogatepass"))
            out.append((t if not sites else b"".join([*parts, raw[at:]]).decode("utf-8", "surrogatepass"), len(sites)))
        return pd.DataFrame(out, columns=["content", "n_redacted"])

    one = slim.join(bodies, "id", "left")
    done = one.select("id", splice("content", "source_file", "language", F.coalesce("body", F.lit(False))).alias("r"))
    return done.select("id", "r.content", "r.n_redacted").dropDuplicates(["id"])
