"""Secret scans (operator 11): assignment-aware lexing.

Every text is lexed as source or configuration: string literals, names, assignment marks and
line ends.  ``pairs`` reads name-literal pairs from the tokens (assignments, typed and chained
ones, mapping entries, subscripts, setter calls, keyword arguments, command-line options, XML
elements, unquoted configuration values).  A right side may be several literals and names
joined by ``+``; names are replaced by the literals assigned to them (constant propagation,
the last assignment before the use, else the first one after it).  A literal that reaches a
target with a sensitive name is scored by the name and by its own shape, and those of at least
``THRESHOLD`` are reported as kind ``literal``, with the target's name.

Beside these spans stand the base patterns ``assign``, ``access`` and ``hex``.  A literal
inside a base span is not reported again.  Spans count code points, end exclusive.

Null text: no spans, as for an empty one.  Texts are read whole; one text is lexed in time and
memory in proportion to its length.  Repeated rows give equal rows, null ids are passed on, and
an empty table gives an empty result.  Spans that start together are ordered by kind as listed in ``KINDS``.
Only the named columns are read, so further columns, whatever their names, do not matter."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, table

KINDS = ("assign", "access", "hex", "literal")
THRESHOLD = 0.5

# The base patterns.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: What a target's name must hold for its literals to count, and how much.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "api key": 1.0,
    "access key": 1.0, "private key": 1.0, "secret key": 1.0, "signing key": 1.0, "encryption key": 1.0, "auth key": 1.0,
    "client secret": 1.0, "credential": 0.8, "credentials": 0.8, "authorization": 0.8, "bearer": 0.8,
}
#: Last words that make a name speak about a secret instead of holding one.
ABOUT = {"count", "counts", "len", "length", "size", "type", "types", "name", "names", "field", "label", "id", "ids", "path", "file", "dir",
         "url", "uri", "host", "hint", "prompt", "policy", "regex", "pattern", "expiry", "expires", "ttl", "limit", "max", "min",
         "env", "var", "index", "column", "header", "class", "model", "kind", "format", "prefix", "suffix", "error", "message"}
PLACEHOLDERS = {"none", "null", "nil", "true", "false", "undefined", "todo", "example", "sample", "placeholder", "redacted", "hidden",
                "string", "required", "optional", "empty", "default", "password", "secret", "token"}
_STEMS = ("pass", "pwd", "secret", "token", "key", "credential", "authoriz", "bearer")

_TOKEN = re.compile(r"""
    (?P<str> (?<![\w'"`]) (?:[rbfuL]{1,2}|@)? (?P<q>\"\"\"|'''|"|'|`) (?P<body> (?:\\.|(?!(?P=q))[^\\\n])* ) (?P=q) )
  | (?P<xml> <(?P<tag>[A-Za-z_][\w.-]*)> (?P<text>[^<>\n]+) </(?P=tag)> )
  | (?P<option> (?<![\w-]) --? (?P<oname>[A-Za-z][\w-]*) (?:=|\x20+) (?P<ovalue>[^\s'"`;,|&<>-][^\s'"`;,|&<>]*) )
  | (?P<bare> ^ [\x20\t]* (?:export\x20+|set\x20+|-\x20+)? (?P<bname>[A-Za-z_][\w.-]*) [\x20\t]* (?:=|:(?=\s)) [\x20\t]* (?P<bvalue>[^\s'"`(){}\[\],;|>&*][^\s'"`(){},;]*) (?=[\x20\t]*(?:\#|;|\r?$)) )
  | (?P<name> [$@%]?\{?[A-Za-z_][\w$]*(?:(?:\.|->|::|-)[A-Za-z_][\w$]*)*\}? (?:'(?=\w)\w+)? )
  | (?P<op> [=!<>]=+ | := | \?\?= | \|\|= | => | = | : )
  | (?P<line> \n )
  | (?P<mark> [+.,;(){}\[\]] )
""", re.X | re.M)


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int


class Literal(NamedTuple):
    text: str
    start: int
    end: int


class Word(NamedTuple):
    """An unquoted value: a name if something is assigned to it, else a literal."""
    name: str
    literal: Literal


class Pair(NamedTuple):
    """A name and what is assigned to it: literals, words, or names to be resolved."""
    name: str
    parts: tuple


def tokens(text: str) -> Iterator[Token]:
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup if m.lastgroup in ("str", "name", "op", "line", "mark") else None
        if m["str"] is not None:
            yield Token("str", m["body"], m.start("body"), m.end("body"))
        elif m["xml"] is not None:
            yield Token("pair", m["tag"], m.start("tag"), m.end("tag"))
            yield Token("value", m["text"], m.start("text"), m.end("text"))
        elif m["option"] is not None:
            yield Token("pair", m["oname"], m.start("oname"), m.end("oname"))
            yield Token("value", m["ovalue"], m.start("ovalue"), m.end("ovalue"))
        elif m["bare"] is not None:
            yield Token("pair", m["bname"], m.start("bname"), m.end("bname"))
            yield Token("value", m["bvalue"], m.start("bvalue"), m.end("bvalue"))
        elif kind:
            yield Token(kind, m[kind], m.start(), m.end())


_REFERENCE = re.compile(r"\$?\{\{?\s*([A-Za-z_][\w.]*)\s*\}?\}|\$([A-Za-z_]\w*)")


def _parts(token: Token) -> tuple:
    """A literal, or the name it only refers to (``${NAME}``)."""
    literal = Literal(token.text, token.start, token.end)
    m = _REFERENCE.fullmatch(token.text.strip())
    if m:
        return (m[1] or m[2],)
    return (Word(token.text, literal),) if token.kind == "value" and re.fullmatch(r"[A-Za-z_][\w.]*", token.text) else (literal,)


def _right_side(found: list[Token], i: int) -> tuple[tuple, int]:
    """Literals and names of an expression from token i on, and the token after it."""
    parts: tuple = ()
    while i < len(found):
        t = found[i]
        if t.kind == "str":
            parts += _parts(t)
        elif t.kind == "name":
            if i + 1 < len(found) and found[i + 1].text == "(":
                # a call's result is no literal, but a decoder's only argument passes through
                if i + 3 < len(found) and found[i + 2].kind == "str" and found[i + 3].text == ")" and _DECODERS.search(t.text):
                    parts += _parts(found[i + 2])
                    i += 3
                else:
                    return parts, i + 1
            else:
                parts += (t.text.strip("$@%{}"),)
        else:
            return parts, i
        i += 1
        if i < len(found) and found[i].text in ("+", "."):
            i += 1
        elif not (i < len(found) and found[i].kind == "str" and t.kind == "str"):
            return parts, i
    return parts, i


_DECODERS = re.compile(r"(?i)(?:b64decode|decode|str|string|bytes|encode|unquote|trim|strip|char|buffer|from)$")
_SETTERS = re.compile(r"(?i)(?:^|[.>:_])(?:set|put|add|with|define|setenv|putenv|setproperty|setdefault|header|append|insert)\w*$")


def pairs(text: str) -> list[Pair]:
    """Name-literal pairs in the order of the text."""
    found = list(tokens(text))
    out: list[Pair] = []
    for i, t in enumerate(found):
        after = found[i + 1] if i + 1 < len(found) else None
        if t.kind == "pair" and after is not None:
            out.append(Pair(t.text, _parts(after)))
        elif t.kind == "op" and t.text in ("=", ":=", ":", "=>", "??=", "||="):
            # the target: a name, a quoted key, or the key of a subscript
            k = i - 1
            if k >= 0 and found[k].text == "]" and k >= 2 and found[k - 1].kind == "str":
                k -= 1
            if k < 0 or found[k].kind not in ("name", "str") or (found[k].kind == "str" and t.text == "=" and found[i - 1].text != "]"):
                continue
            if t.text == "=" and k >= 2 and found[k - 1].text == ":" and found[k - 2].kind == "name":
                k -= 2  # name: type = value
            parts, _ = _right_side(found, i + 1)
            if parts:
                out.append(Pair(found[k].text.strip("$@%{}"), parts))
        elif t.kind == "name" and after is not None and after.text == "(" and i + 3 < len(found):
            first, mark = found[i + 2], found[i + 3]
            if first.kind == "str" and mark.text == "," and _SETTERS.search(t.text):
                parts, _ = _right_side(found, i + 4)  # put("name", value)
                if parts:
                    out.append(Pair(first.text, parts))
            elif mark.text == ")" and first.kind in ("str", "name") and _SETTERS.search(t.text):
                parts, _ = _right_side(found, i + 2)  # setName(value)
                if parts:
                    out.append(Pair(re.sub(r"(?i)^.*[.>:]|^(set|with|add|put)_?", "", t.text), parts))
    return out


def name_words(name: str) -> list[str]:
    """Lower-cased words of an identifier: camel case, digits and punctuation separate them."""
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)]


def name_weight(name: str) -> float:
    """How much a target's name speaks of a secret, 0 to 1."""
    words = name_words(name)
    if not words or words[-1] in ABOUT:
        return 0.0
    joined = " ".join(words)
    return max((w for k, w in SENSITIVE.items() if re.search(rf"(?:^| ){k}(?:$| )", joined)), default=0.0)


def literal_weight(value: str) -> float:
    """How much a literal looks like a credential, 0 to 1."""
    value = value.strip()
    n = len(value)
    if n < 4 or value.lower() in PLACEHOLDERS or len(set(value)) <= 2:
        return 0.0
    if re.search(r"[<>{}\s]|\$\(|%\w|^\.{0,2}/|://|\*{3}|x{4,}|(?i:your|example|change.?me|placeholder|dummy)", value):
        return 0.0
    counts = Counter(value)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
    if re.fullmatch(r"[A-Za-z]+|[a-z]+(?:[-_.][a-z]+)+|[A-Z]+(?:_[A-Z]+)+|[\d.,:-]+", value):
        return 0.3 if entropy < 3.5 else 0.6  # a plain word, a name, a number or a date
    return min(1.0, 0.35 + 0.1 * classes + 0.1 * entropy)


def _resolve(parts: tuple, before: dict, anywhere: dict) -> Iterator[Literal]:
    """Literals that an expression stands for, its names replaced by what was assigned to them;
    a name is followed once, so cycles and repeated names end."""
    seen: set[str] = set()
    queue = list(reversed(parts))
    while queue:
        p = queue.pop()
        if isinstance(p, Literal):
            yield p
            continue
        key = _last(p.name if isinstance(p, Word) else p)
        source = before.get(key) or anywhere.get(key)
        if source and key not in seen:
            seen.add(key)
            queue += reversed(source)
        elif isinstance(p, Word) and not source:
            yield p.literal


def _last(name: str) -> str:
    """The name without its owner: ``self.key`` and ``config.key`` are ``key``."""
    return re.split(r"\.|->|::", name)[-1]


def literals(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, target, score) of the literals that reach a sensitive target."""
    found = pairs(text)
    if not any(name_weight(p.name) for p in found):
        return []
    anywhere: dict[str, tuple] = {}
    for p in found:
        anywhere.setdefault(_last(p.name), p.parts)
    best: dict[tuple[int, int], tuple[float, str]] = {}
    before: dict[str, tuple] = {}
    for p in found:
        weight = name_weight(p.name)
        if weight:
            for lit in _resolve(p.parts, before, anywhere):
                score = weight * literal_weight(lit.text)
                at = (lit.start, lit.end)
                if score >= THRESHOLD and score > best.get(at, (0.0,))[0]:
                    best[at] = (score, p.name)
        before[_last(p.name)] = p.parts
    return [(a, b, name, score) for (a, b), (score, name) in sorted(best.items())]


def scan_text(text: str) -> list[tuple[int, int, int, str | None, float]]:
    """(start, end, kind number, target, score) of all spans, by start, then kind."""
    low = text.lower()
    spans: list[tuple[int, int, int, str | None, float]] = []
    if any(w in low for w in _ASSIGN_WORDS):
        spans += [(m.start(), m.end(), 0, m[1], 1.0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), 1, None, 1.0) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), m.end(), 2, None, 1.0) for m in _HEX.finditer(text)]
    if any(s in low for s in _STEMS):
        base = sorted((a, b) for a, b, *_ in spans)
        for a, b, name, score in literals(text):
            if not any(x <= a and b <= y for x, y in base):
                spans.append((a, b, 3, name, score))
    return sorted(spans, key=lambda s: (s[0], s[2], s[1]))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("target", pa.string()), ("score", pa.float64())])
_FOUND = pa.schema([("id", pa.int64()), ("spans", pa.list_(_SPAN))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [[{"kind": KINDS[k], "start": a, "end": b, "target": name, "score": score}
                  for a, b, k, name, score in scan_text(t.as_py() or "")] for t in batch.column(1)]
        yield pa.record_batch([batch.column(0), pa.array(spans, pa.list_(_SPAN))], schema=_FOUND)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every row; a span has kind, start, end, target (the name it is assigned to) and score."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return map_arrow(rows, _scan, "id bigint, spans array<struct<kind:string,start:int,end:int,target:string,score:double>>")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """(id, text) with every stretch of overlapping spans replaced by ``mark``; null stays null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                if t:
                    pieces, at = [], 0
                    for a, b, *_ in scan_text(t):
                        if a >= at:
                            pieces += [t[at:a], mark]
                        at = max(at, b)
                    t = "".join(pieces) + t[at:]
                out.append(t)
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], names=["id", "text"])

    return map_arrow(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")), run, "id bigint, text string")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op11_secret_lexer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "literal")
    return found.select(F.col("id").alias("doc_id"), *[count(k) for k in KINDS[:3]], F.sha2(_joined(base), 256).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"))


QUERIES = {"op11_secret_lexer": op11_secret_lexer}
ORACLE: dict[str, str] = {}
