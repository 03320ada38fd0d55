"""Operator 5, secret scans: assignment-aware lexing.

Three base patterns are matched leftmost and non-overlapping over whole texts. Beyond them, the texts that
name anything sensitive are lexed as source or configuration into name-literal pairs: `name = literal`, `name: literal`,
`"name" => literal`, `x["name"] = literal`, `<name>literal</name>`, `key="name" value="literal"`; literals are quoted (also by three quotes, or in parts joined by +),
bare values of .env, INI, YAML and XML text, or block scalars of YAML under a sensitive name. `name = other` propagates the constant last bound to `other`, or the one
first bound to it later on; so do sums, lists and arguments of calls, to all constants and literals in them. A literal is scored by the best name that it reaches: by whole
parts of it, or their endings; names that only say `value` and the like by the name they are nested under, in braces or by indentation, and so are those nested under a
sensitive name that do not say something public. Literals in lists, calls and nested so must look random (a digit, no identifier, address or path). A literal that reaches
MIN_SCORE is added as a span of kind `bound` (from its first part to its last), unless a base span covers it; parts of a sum may be short, if the sum is not.

Row-local: no shuffle. Spans are half-open ranges of code points. Null and empty texts have no spans;
null ids pass through; repeated rows get equal results; very long texts are lexed whole, in linear time; spans that start together are ordered
by kind, then end; an empty table gives no rows; further columns are
ignored by scan() and kept by redact().
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.llm import rows

KINDS = ("assign", "access", "hex", "bound")
#: Base patterns; ASCII letters only fold in `assign`.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # as AKIA[A-Z0-9]+ of 16 characters or more: a run ends where it ends
HEX = re.compile(r"[0-9a-f]{32,}")
STEMS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Parts of a target name and what they add to its literal's score.
SENSITIVE = {"password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "pass": 3, "secret": 3, "token": 3, "apikey": 3, "credential": 3, "credentials": 3, "auth": 1, "private": 1, "access": 1, "api": 1, "key": 2, "signing": 1, "bearer": 3}
#: Parts that add one less in the name of something about a secret.
ABLE = {"pass", "token", "credential", "credentials", "bearer"}
ABOUT = {"count", "dir", "endpoint", "expires", "expiry", "file", "id", "index", "len", "length", "limit", "max", "min", "name", "path", "rate", "size", "ttl", "type", "uri", "url"}
#: Endings of a part of a name that count as the part they are.
ENDINGS = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "credential", "credentials")
#: Parts of names that are public though they are nested under a sensitive one.
PUBLIC = ABOUT | {"account", "alg", "algorithm", "arn", "bucket", "comment", "date", "description", "domain", "email", "env", "environment", "format", "host", "issuer", "kind", "label", "login", "mode", "owner", "port", "provider", "region", "role", "scope", "server", "source", "status", "time", "title", "updated", "created", "user", "username", "version"}
#: Names that say nothing themselves: the one that they are nested under does.
NEUTRAL = {"value", "val", "data", "default", "content", "string", "text", "plain"}
HINT = re.compile(r"(?ai)pass|pwd|secret|token|key|credential|auth|bearer")
#: A name and the separator after it; names and literals are of any length, and every pattern reads its characters a bounded number of times.
_NAME = r"""["']?([A-Za-z_$][\w.$-]*+)["']?(?:[ \t]*+\])?[ \t]*+(?::=|=>|[=:])[ \t]*+"""
NAME = re.compile(r"(?a)(?<![\w.$-])" + _NAME)
QUOTED = {q: re.compile(rf"{q}((?:\\.|[^\\\n{q}])*+){q}") for q in "\"'`"}
JOINED = re.compile(r"\s*+\+\s*+(?=[\"'`])")
ELEMENT = re.compile(r"(?a)<([A-Za-z_][\w.:-]*+)(?:[ \t][^<>\n]*+)?>([^<>\n]*+)</\1[ \t]*+>")
ATTRIBUTES = re.compile(r"""(?ai)\b(?:key|name)[ \t]*+=[ \t]*+["']([^"'\n<>]*+)["'][ \t]++value[ \t]*+=[ \t]*+["']([^"'\n<>]*+)["']""")
OTHER = re.compile(r"(?a)([A-Za-z_$][\w.$]*+)(?!\()")
#: What opens a list or the arguments of a call, what comes before a further operand, and a call on a value.
OPENING = re.compile(r"(?a)(?:(?:await|new)[ \t]++)?[A-Za-z_$][\w.$]*+\(|[\[(]")
METHOD = re.compile(r"(?a)\s*+\.[ \t]*+[A-Za-z_$][\w.$]*+\(")
SUM, SPACE, NUMBER = re.compile(r"\s*+\+(?![+=])\s*+"), re.compile(r"\s*+"), re.compile(r"(?a)-?[0-9][\w.]*+")
BLOCK = re.compile(r"[|>][+-]?[0-9]?[+-]?[ \t\r]*+(?:#[^\n]*+)?\n")
#: A line of .env, INI or YAML text: its value is the whole word, up to a comment. Elsewhere a bare value ends at the next delimiter.
LINE = re.compile(rf"(?am)^[ \t]*+(?:(?:export|set|-)[ \t]++)?{_NAME}([^\s\"'`]\S*+)[ \t\r]*+(?:[#;][^\n]*+)?$")
BARE = re.compile(r"[^\s\"'`,;&=:(){}\[\]<>|]++={0,2}")
#: Bare values that say where a value is: calls, variables, templates, addresses, paths.
ELSEWHERE = re.compile(r"(?a)[A-Za-z_$][\w.$]*[(\[]|\$\{?[A-Za-z_]\w*\}?$|\$?\{\{|[<\[{=:(]|[A-Za-z][\w+.-]*://[^@]*$|[~.]?(?:/[\w.-]+){2,}/?$")
DOTTED = re.compile(r"(?a)[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)+")
WORDY = re.compile(r"[a-z_]+[0-9]*|[A-Z_]+[0-9]*")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
MIN_SCORE, MIN_ENTROPY, MIN_LENGTH = 3.0, 2.5, 8


def base_spans(text: str, lowered: str | None = None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, ordered."""
    lowered = text.lower() if lowered is None else lowered
    found = []
    if any(x in lowered for x in STEMS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def name_score(name: str, many: bool = False) -> float:
    """What a target name says; `many`: of several values, so that parts may be plurals."""
    parts = {p.lower() for p in PARTS.findall(name)}
    if many:
        parts = {p[:-1] if p.endswith("s") and (p[:-1] in SENSITIVE or p[:-1].endswith(ENDINGS)) else p for p in parts}
    known = {p: next((e for e in ENDINGS if p.endswith(e)), p) for p in parts}
    return sum(SENSITIVE.get(known[p], 0) - (known[p] in ABLE and not parts.isdisjoint(ABOUT)) for p in parts)


def entropy(literal: str) -> float:
    n = len(literal)
    return -sum(c / n * math.log2(c / n) for c in (literal.count(x) for x in set(literal)))


def bare(text: str, lo: int, line: tuple[int, bool] | None) -> tuple[int, int] | None:
    """The literal of a value without quotes, if it is one. line: where the value of a configuration line ends, and whether it stands close to its name."""
    end = line[0] if line else m.end() if (m := BARE.match(text, lo)) else lo
    word = text[lo:end]
    if line:
        word = word.rstrip(",;")
    if ELSEWHERE.match(word) or not re.search("[A-Za-z]", word):
        return None
    mixed = lambda x: len(x) >= 8 and all(re.search(c, x) for c in ("[0-9]", "[a-z]", "[A-Z]"))
    if DOTTED.fullmatch(word) and not any(map(mixed, word.split("."))):
        return None
    if WORDY.fullmatch(word) and not (line and line[1] and lo + len(word) == end):
        return None
    if not re.search("[0-9]", word) and not (line and re.search(r"[!@#%^&*+?~]", word)):
        return None
    return lo, lo + len(word)


class _Strings:
    """Quoted literals of a text."""

    def __init__(self, text: str):
        self.text, self.open = text, set()

    def at(self, lo: int) -> tuple[int, int, int] | None:
        """The literal whose quotes begin here, as its inner range and the end of its quotes."""
        quote = self.text[lo : lo + 1]
        if quote not in QUOTED:
            return None
        if self.text.startswith(quote * 3, lo) and quote not in self.open:
            end = self.text.find(quote * 3, lo + 3)
            if end >= 0:
                return lo + 3, end, end + 3
            self.open.add(quote)  # and no later one is closed
        m = QUOTED[quote].match(self.text, lo)
        return m and (m.start(1), m.end(1), m.end())

    def joined(self, lo: int) -> tuple[tuple[int, int, str], int] | None:
        """A literal of one part or more, as its range with its value, and where it ends."""
        part = self.at(lo)
        if part is None:
            return None
        first, last, end = part
        value = [self.text[first:last]]
        while (m := JOINED.match(self.text, end)) and (part := self.at(m.end())):
            value.append(self.text[part[0] : part[1]])
            _, last, end = part
        return (first, last, "".join(value)), end


class _Nested:
    """The names that a place of a text is nested under, by braces and by indentation."""

    def __init__(self):
        self.braces: list[str | None] = []
        self.lines: list[tuple[int, str]] = []

    def passed(self, gap: str) -> None:
        for c in re.findall("[{}]", gap):
            if c == "{":
                self.braces.append(None)
            elif self.braces:
                self.braces.pop()

    def indented(self, indent: int | None) -> None:
        while indent is not None and self.lines and self.lines[-1][0] >= indent:
            self.lines.pop()

    def name(self) -> str | None:
        return self.braces[-1] if self.braces and self.braces[-1] else self.lines[-1][1] if self.lines else None


class _Bindings:
    """Constants and the names that they reach: a node for each literal and each binding, with what it is made of."""

    def __init__(self):
        self.score: list[float] = []
        self.parts: list[list[int]] = []
        self.length: list[int] = []
        self.literal: dict[int, tuple[int, int, str]] = {}
        self.random: set[int] = set()  # literals that must look so
        self.bound: dict[str, int] = {}
        self.waiting: dict[str, list[int]] = {}  # name not bound so far -> bindings made of it

    def _node(self, score: float, parts: list[int], length: int) -> int:
        self.score.append(score)
        self.parts.append(parts)
        self.length.append(min(length, MIN_LENGTH))
        return len(self.score) - 1

    def leaf(self, literal: tuple[int, int, str], random: bool) -> int:
        node = self._node(0, [], len(literal[2]))
        self.literal[node] = literal
        if random:
            self.random.add(node)
        return node

    def known(self, name: str) -> bool:
        return name in self.bound and self.length[self.bound[name]] > 0

    def bind(self, name: str, score: float, operands: list[int | str]) -> None:
        parts = [self.bound.get(x, x) if isinstance(x, str) else x for x in operands]
        here = [x for x in parts if not isinstance(x, str)]
        node = self._node(score, here, sum(self.length[x] for x in here))
        for x in parts:
            if isinstance(x, str):
                self.waiting.setdefault(x, []).append(node)
        self.bound[name] = node
        for later in self.waiting.pop(name, ()):
            if later != node:
                self.parts[later].append(node)
                self.length[later] = min(self.length[later] + self.length[node], MIN_LENGTH)

    def reached(self) -> dict[int, tuple[float, int]]:
        """Of each literal, the best score of a name that it reaches, and the length of the whole there (up to MIN_LENGTH). Best names first, so each node is met once."""
        best: dict[int, tuple[float, int]] = {}
        for root in sorted(range(len(self.score)), key=lambda i: (-self.score[i], -self.length[i])):
            if self.score[root] <= 0:
                break
            open_ = [root]
            while open_:
                if (node := open_.pop()) not in best:
                    best[node] = (self.score[root], self.length[root])
                    open_ += self.parts[node]
        return {k: best[k] for k in self.literal if k in best}


def operands(text: str, at: int, strings: _Strings, bindings: _Bindings, random: bool) -> tuple[list[int | str], int]:
    """The literals (as nodes) and names that a value is made of, by sums, lists and calls, and where the lexing goes on: before a name that may be a target itself."""
    found: list[int | str] = []
    depth = 0
    while True:
        if depth:
            at = SPACE.match(text, at).end()
        if part := strings.joined(at):
            literal, at = part
            found.append(bindings.leaf(literal, random or depth > 0))
        elif m := OPENING.match(text, at):
            depth, at = depth + 1, m.end()
            continue
        elif m := OTHER.match(text, at):
            end = SPACE.match(text, m.end()).end()
            if depth and text[end : end + 1] in ("=", ":"):
                return found, at
            found.append(m[1])
            if not depth and not SUM.match(text, m.end()):
                return found, at
            at = m.end()
        elif m := NUMBER.match(text, at):
            at = m.end()
        elif not depth or text[at : at + 1] not in (")", "]"):
            return found, at
        while True:  # after an operand
            if m := METHOD.match(text, at):
                depth, at = depth + 1, m.end()
                break
            if m := SUM.match(text, at):
                at = m.end()
                break
            end = SPACE.match(text, at).end()
            if not depth or text[end : end + 1] not in (",", ")", "]"):
                return found, at
            at = end + 1
            if text[end] == ",":
                break
            depth -= 1


def block_scalar(text: str, begin: int, at: int) -> tuple[int, int, str] | None:
    """The lines after `at` that are indented deeper than the line that begins at `begin`."""
    indent = len(text[begin:at]) - len(text[begin:at].lstrip(" "))
    first = last = at
    lines = []
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end].strip()
        if line:
            lead = len(text[at:end]) - len(text[at:end].lstrip())
            if lead <= indent:
                break
            first = first if lines else at + lead
            last = at + lead + len(line)
            lines.append(line)
        at = end + 1
    return (first, last, "\n".join(lines)) if lines else None


def looks_random(literal: str) -> bool:
    return bool(re.search("[0-9]", literal)) and not (WORDY.fullmatch(literal) or DOTTED.fullmatch(literal) or ELSEWHERE.match(literal))


def bound_spans(text: str) -> list[tuple[int, int, int]]:
    """Literals that reach a sensitive name, straight or through other names."""
    lines = {m.start(2): (m.end(2), text[m.end(1)] in "=:\"'") for m in LINE.finditer(text)}
    strings, nested, bindings = _Strings(text), _Nested(), _Bindings()
    at = done = 0
    while m := NAME.search(text, at):
        name, at = m[1], m.end()
        nested.passed(text[done : m.start()])
        begin = text.rfind("\n", max(done - 1, 0), m.start()) + 1
        starts = (begin or not done) and not text[begin : m.start()].strip(" \t-")
        nested.indented(m.start() - begin if starts else None)
        done, above = at, nested.name()
        full, own = name, name_score(name)
        under = False
        if above and name.lower() in NEUTRAL:
            full = f"{above}.{name}"
            own = name_score(full)
        elif above and own < MIN_SCORE and name_score(above, True) >= MIN_SCORE and PUBLIC.isdisjoint(p.lower() for p in PARTS.findall(name)):
            under, own = True, name_score(above, True)
        if text.startswith("{", at):
            nested.braces.append(full)
            done = at = at + 1
            continue
        if own >= MIN_SCORE and starts and (head := BLOCK.match(text, at)) and (literal := block_scalar(text, begin, head.end())):
            bindings.bind(name, own, [bindings.leaf(literal, under)])
            done = at = literal[1]
            continue
        other = OTHER.match(text, at)
        plain = None if text[at : at + 1] in QUOTED or other and bindings.known(other[1]) else bare(text, at, lines.get(at))
        if plain:
            bindings.bind(name, own, [bindings.leaf((*plain, text[plain[0] : plain[1]]), under)])
            continue
        opening = OPENING.match(text, at)
        found, at = operands(text, at, strings, bindings, under)
        done = at
        if found:
            bindings.bind(name, max(own, name_score(full, True)) if opening else own, found)
        elif text[at : at + 1] in ("\n", "\r", ""):
            nested.lines.append((m.start() - begin, full))
    for m in [*ELEMENT.finditer(text), *ATTRIBUTES.finditer(text)]:
        if m[0][0] != "<" or (plain := bare(text, m.start(2), (m.end(2), True))) and plain[1] == m.end(2):
            bindings.bind("", name_score(m[1]), [bindings.leaf((m.start(2), m.end(2), m[2]), False)])
    out = set()
    for node, (score, length) in bindings.reached().items():
        lo, hi, literal = bindings.literal[node]
        if not literal or max(0 if node in bindings.random else length, len(literal)) < MIN_LENGTH or node in bindings.random and not looks_random(literal):
            continue
        enough = MIN_ENTROPY if len(literal) >= MIN_LENGTH else min(MIN_ENTROPY, 0.8 * math.log2(len(literal)))
        if score - (2 if " " in literal else 0) >= MIN_SCORE and entropy(literal) >= enough and re.search(r"[0-9A-Z_\W]", literal):
            out.add((lo, 3, hi))
    return sorted(out)


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, each ordered by start, then kind."""
    lowered = text.lower()
    base = base_spans(text, lowered)
    if not HINT.search(lowered):
        return base, base
    more = [x for x in bound_spans(text) if not any(lo <= x[0] and x[2] <= hi for lo, _, hi in base)]
    return base, sorted(base + more) if more else base


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{lo}:{hi}" for lo, k, hi in found)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts by base kind, digest of the base spans and all spans of every row."""

    def fn(texts: pa.Array, _: pa.RecordBatch) -> dict:
        both = [spans(t) for t in texts.to_pylist()]
        counts = {f"n_{kind}": pa.array([sum(x[1] == k for x in a) for _, a in both], pa.int64()) for k, kind in enumerate(KINDS)}
        return counts | {"base_sha256": pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _ in both], pa.string()), "spans": pa.array([written(a) for _, a in both], pa.string())}

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, n_bound long, base_sha256 string, spans string"
    return rows.map_texts(docs.select("doc_id", "text"), fn, ["doc_id"], schema)


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """The rows with every span of the text replaced by `mask` (overlapping spans by one), n_chars counted anew."""

    def hide(text: str) -> str:
        out, done = [], 0
        for lo, _, hi in spans(text)[1]:
            if lo >= done:
                out += [text[done:lo], mask]
            done = max(done, hi)
        return "".join([*out, text[done:]]) if done else text

    def fn(texts: pa.Array, part: pa.RecordBatch) -> dict:
        return {"text": pa.array([hide(t) if there else None for t, there in zip(texts.to_pylist(), part.column("text").is_valid().to_pylist(), strict=True)], pa.string())}

    names = docs.columns
    out = rows.map_texts(docs, fn, names, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(rows.documents(spark, sf_dir))
