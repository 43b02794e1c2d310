"""Secret scans by assignment-aware lexing.

Every whole text is scanned for the base kinds (assign, access, hex) and then
lexed as source or configuration text: names, string literals and bare
values are read into (target, terms) assignments; constants are propagated
through names and ``+`` / adjacent-literal concatenation; a literal that
reaches a sensitive target name is scored by the name and by its own shape.
Literals from ``THRESHOLD`` up are reported as kind ``literal`` unless a base
span already covers them.

The work is a per-row function inside ``mapInArrow``: one pass over the
documents, no shuffle.

Defined results: null text counts as empty (no spans); repeated rows give
repeated results; an empty table gives no rows; texts of any length are read
whole; only doc_id and text are read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

THRESHOLD = 0.5
KINDS = ("assign", "access", "hex", "literal")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ASSIGN_CUES = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

# Sensitivity of the words of a target name, and words that say the value is
# about a secret rather than one.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "pass": 0.7, "passphrase": 1.0, "passcode": 0.9,
    "secret": 0.9, "token": 0.8, "apikey": 0.9, "credential": 0.8, "credentials": 0.8, "bearer": 0.8,
    "authorization": 0.7, "auth": 0.6, "signature": 0.5, "salt": 0.5, "pin": 0.5,
}
KEY_QUALIFIERS = {"api", "private", "access", "secret", "signing", "encryption", "master", "account", "client", "service"}
HARMLESS = {"length", "len", "count", "name", "type", "url", "uri", "path", "file", "field", "label", "max", "min",
            "ttl", "expiry", "expires", "timeout", "policy", "reset", "hint", "prompt", "placeholder", "regex", "limit",
            "limits", "budget", "id", "usage", "size", "format", "column", "header"}
SENSITIVE = re.compile(r"pass|pwd|secret|token|key|credential|bearer|auth|signature|salt|pin\b", re.IGNORECASE)
PLACEHOLDER = re.compile(r"^(x{4,}|\*+|\.{3,}|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s|none|null|nil|true|false|undefined|"
                         r"changeme|change_me|example|placeholder|your[_-].*|todo|test|string|str|password|secret|token)$",
                         re.IGNORECASE)

LEX = re.compile(r"""
    (?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)
  | (?P<name>[A-Za-z_$][A-Za-z0-9_$]*(?:[.-][A-Za-z_$][A-Za-z0-9_$]*)*)
  | (?P<number>[0-9][A-Za-z0-9+/_.=-]*)
  | (?P<compare>==+|!=|<=|>=)
  | (?P<op>:=|=>|[:=+])
  | (?P<close>[\])>])
  | (?P<space>[^\S\n]+)
  | (?P<line>\n)
  | (?P<other>.)
""", re.VERBOSE)
BARE = re.compile(r"[^\s;,'\"`(){}\[\]<>]+")


def name_score(name: str) -> float:
    words = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", name)]
    score = max([NAME_WEIGHTS.get(w, 0.0) for w in words], default=0.0)
    if "key" in words or "keys" in words:
        score = max(score, 0.9 if KEY_QUALIFIERS & set(words) else 0.4)
    return score * (0.3 if words and (words[-1] in HARMLESS or words[0] in ("max", "min", "num")) else 1.0)


def assignments(text: str) -> list[tuple[str, list]]:
    """(target, terms) in order; a term is ("lit", value, start, end) or ("ref", name)."""
    tokens = [(m.lastgroup, m.start(), m.end()) for m in LEX.finditer(text) if m.lastgroup != "space"]
    out, n, i = [], len(tokens), 0
    while i < n:
        kind, start, end = tokens[i]
        if kind != "op" or text[start:end] == "+":
            i += 1
            continue
        j = i - 1
        while j >= 0 and tokens[j][0] == "close":
            j -= 1
        if j < 0 or tokens[j][0] not in ("name", "string"):
            i += 1
            continue
        target = text[tokens[j][1]:tokens[j][2]].strip("\"'`")
        k, terms, joined = i + 1, [], True
        # a type between the name and the value: ``name: type = value``
        if text[start:end] == ":" and k + 1 < n and tokens[k][0] == "name" and text[tokens[k + 1][1]:tokens[k + 1][2]] == "=":
            k += 2
        while k < n:
            kind, start, end = tokens[k]
            if kind == "string" and (joined or terms):
                terms.append(("lit", text[start + 1:end - 1], start + 1, end - 1))
                joined = False
            elif kind in ("name", "number", "other") and joined:
                if kind == "name" and not BARE.fullmatch(text[start:end + 1].strip() or "."):
                    terms.append(("ref", text[start:end]))
                elif kind == "other" and not BARE.match(text, start):
                    break
                else:
                    m = BARE.match(text, start)
                    bare = m.group(0).rstrip(".")
                    if kind == "name" and m.end() == end:
                        terms.append(("ref", bare))
                    else:
                        terms.append(("lit", bare, start, start + len(bare)))
                        while k + 1 < n and tokens[k + 1][1] < m.end():
                            k += 1
                joined = False
            elif kind == "op" and text[start:end] == "+":
                joined = True
            elif kind == "line" and terms and (joined or k + 1 < n and text[tokens[k + 1][1]:tokens[k + 1][2]] == "+"):
                pass  # the value goes on after or before a +
            else:
                break
            k += 1
        if terms:
            out.append((target, terms))
        i += 1
    return out


class Value:
    """What is known of a concatenated constant: enough to score it, of
    bounded size however long it is. ``joined`` adds two values up."""

    __slots__ = ("length", "counts", "head", "tail", "word", "inner", "lead", "trail")
    KEPT = 64

    def __init__(self, text: str = ""):
        core = text.strip()
        self.length, self.counts = len(text), Counter(text)
        self.head, self.tail = text[:self.KEPT], text[-4:]
        self.word, self.inner = bool(core), " " in core
        self.lead = " " in text[:len(text) - len(text.lstrip())]       # blanks before the first
        self.trail = " " in text[len(text.rstrip()):]                  # and after the last other character

    def joined(self, other: "Value") -> "Value":
        out = Value()
        out.length, out.counts = self.length + other.length, self.counts + other.counts
        out.head, out.tail = (self.head + other.head)[:self.KEPT], (self.tail + other.tail)[-4:]
        out.word = self.word or other.word
        out.inner = self.inner or other.inner or (self.word and other.word and (self.trail or other.lead))
        out.lead = self.lead if self.word else self.lead or other.lead
        out.trail = other.trail if other.word else self.trail or other.trail
        return out

    def placeholder(self) -> bool:
        if self.length <= self.KEPT:
            return bool(PLACEHOLDER.match(self.head))
        kinds = set(self.counts)
        if kinds <= {"x", "X"} or kinds == {"*"}:
            return True
        # the other long forms are told by how they begin and end
        ends = self.head[:32] + self.tail
        return "\n" not in kinds and not re.match(r"x+$|\*+$", ends, re.IGNORECASE) and bool(PLACEHOLDER.match(ends))

    def score(self) -> float:
        """0 for placeholders and short values, up to 1 for long mixed ones."""
        if self.length < 6 or self.inner or self.placeholder():
            return 0.0
        entropy = -sum(c / self.length * math.log2(c / self.length) for c in self.counts.values())
        letters = self.counts.keys()
        kinds = (any("a" <= c <= "z" for c in letters) + any("A" <= c <= "Z" for c in letters)
                 + any("0" <= c <= "9" for c in letters) + any(not (c.isascii() and c.isalnum()) for c in letters))
        return min(1.0, 0.25 + 0.1 * entropy + 0.12 * kinds)


def literal_score(value: str) -> float:
    return Value(value).score()


def method_spans(text: str) -> list[tuple[int, int]]:
    """Literals that reach a sensitive name, directly or through constants.

    An assignment's references are resolved once: a name stands for its
    last assignment before, else for its first one after. So constants form a
    graph without copies: values are added up along it with an explicit stack,
    and the literals of a sensitive target are collected by a walk that enters
    no assignment twice."""
    if not SENSITIVE.search(text):
        return []
    found = assignments(text)
    scores = [name_score(t) for t, _ in found]
    if not any(scores):
        return []
    first: dict[str, int] = {}
    for i, (target, _) in enumerate(found):
        first.setdefault(target, i)
    last: dict[str, int] = {}             # of the assignments before the current one
    links: dict[int, list] = {}           # assignment -> its terms, references as assignment numbers
    values: dict[int, Value] = {}

    def link(i: int) -> None:
        target, terms = found[i]
        links[i] = []
        for t in terms:
            if t[0] == "lit":
                links[i].append(t)
            elif t[1] != target and (at := last.get(t[1], first.get(t[1]))) is not None:
                links[i].append(("ref", at))

    def evaluate(i: int) -> None:
        open_, stack = set(), [i]
        while stack:
            j = stack[-1]
            if j in values:
                stack.pop()
                continue
            if j not in links:
                link(j)
            if j not in open_:
                open_.add(j)
                # what is open already is a circle: those references stay out
                links[j] = [t for t in links[j] if t[0] == "lit" or t[1] in values or t[1] not in open_]
                todo = [t[1] for t in links[j] if t[0] == "ref" and t[1] not in values]
                if todo:
                    stack += todo
                    continue
            links[j] = [t for t in links[j] if t[0] == "lit" or t[1] in values]
            value = Value()
            for t in links[j]:
                value = value.joined(Value(t[1]) if t[0] == "lit" else values[t[1]])
            values[j] = value
            stack.pop()

    spans: set[tuple[int, int]] = set()
    walked: set[int] = set()
    for i, (target, terms) in enumerate(found):
        evaluate(i)
        if not links[i] and len(terms) == 1 and terms[0][0] == "ref":
            continue
        last[target] = i
        if scores[i] and scores[i] * values[i].score() >= THRESHOLD:
            stack = [i]
            while stack:
                j = stack.pop()
                if j not in walked:
                    walked.add(j)
                    for t in links[j]:
                        if t[0] == "ref":
                            stack.append(t[1])
                        elif t[3] > t[2]:
                            spans.add((t[2], t[3]))
    return sorted(spans)


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans, by start, then kind."""
    spans = []
    low = text.lower()
    if any(c in low for c in ASSIGN_CUES):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base = list(spans)
    # spans of a base kind do not overlap: of each kind only the last one that starts
    # at or before a literal can cover it
    starts = [sorted((a, b) for a, kind, b in base if kind == k) for k in range(3)]

    def within(s: int, e: int) -> bool:
        at = [(own, bisect_right(own, (s, math.inf)) - 1) for own in starts]
        return any(k >= 0 and e <= own[k][1] for own, k in at)

    spans += [(s, 3, e) for s, e in method_spans(text) if not within(s, e)]
    return sorted(spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (kind, start, end) in code points, end exclusive."""
    element = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find(t)] if t else []
                     for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(element))], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")
