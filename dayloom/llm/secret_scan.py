"""Secret scans: name-literal pairs from source and configuration text, scored by the target's name.

Three fixed patterns give the base spans. Beyond them every text with an
assignment is lexed into names, literals and operators; assignments become
(target, operands) pairs; constants travel through later assignments, so that a
harmlessly named literal that ends up in `db_password` is found where it was
written. A literal is reported where the most sensitive target that it reaches,
weighed by how much the literal looks like a secret, passes a threshold.

A run of three or more backticks is a mark, as at Markdown's fences. A backtick
that is not closed on its line opens a string only where a value may stand; else
it is a mark. What is inside backticks and triple quotes is lexed again for
assignments of its own; a literal there may lie inside another that is reported.

Constants are followed through chains of any length, and every value is made once, so
that the work grows with the text; only a value joined again and again from two long
ones is gone through anew each time. A name that is used before it is given a value
has the last one it is given.

Offsets count code points, ends are exclusive. Null and empty texts have no
spans. A literal inside a base span is not reported again; spans that begin at
the same place are ordered as kinds are listed in `KINDS`.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from functools import reduce
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dayloom.llm.tables import per_row, slices, texts

KINDS = ("assign", "access", "hex", "literal")
THRESHOLD = 0.5

_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)
_ASSIGN_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Runs of 32 and more; shorter runs are matches that the base rule drops.
_HEX = re.compile(r"[0-9a-f]{32,}")


class Span(NamedTuple):
    kind: str
    start: int
    end: int

    def __str__(self) -> str:
        return f"{self.kind}:{self.start}:{self.end}"


def _ordered(spans) -> list[Span]:
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def base_spans(text: str) -> list[Span]:
    """Spans of the three fixed patterns."""
    found = []
    low = text.lower()
    if any(hint in low for hint in _ASSIGN_HINTS):
        found += [Span("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        found += [Span("access", *m.span()) for m in _ACCESS.finditer(text) if len(m.group()) >= 16]
    found += [Span("hex", *m.span()) for m in _HEX.finditer(text)]
    return _ordered(found)


# Lexer

_LEXEMES = re.compile(
    r"""
    (?P<fence>`{3,})
    | (?P<string>\"\"\"(?:\\.|[^\\])*?\"\"\" | '''(?:\\.|[^\\])*?''' |
        "(?:\\.|[^"\\\n])*" | (?<!\w)'(?:\\.|[^'\\\n])*' | `(?:\\.|[^`\\])*`)
    | (?P<name>[^\W\d]\w*(?:[.-]\w+)*)
    | (?P<number>\d[\w.]*)
    | (?P<other>==|!=|<=|>=)
    | (?P<assign>:=|=>|=|:)
    | (?P<plus>\+)
    | (?P<line>\n)
    | (?P<mark>[^\s\w])
    """,
    re.X,
)
# An unquoted value; an equals sign only ends it, as padding.
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]=]+={0,2}")


class Lexeme(NamedTuple):
    kind: str
    text: str
    start: int
    end: int


class Assignment(NamedTuple):
    target: str
    operands: tuple[Lexeme, ...]


def _string_body(lexeme: Lexeme) -> Lexeme:
    quote = 3 if lexeme.text[:3] in ('"""', "'''") and len(lexeme.text) >= 6 else 1
    return Lexeme("literal", lexeme.text[quote:-quote], lexeme.start + quote, lexeme.end - quote)


def _lexemes(text: str) -> list[Lexeme]:
    out: list[Lexeme] = []
    at = 0
    while True:
        for m in _LEXEMES.finditer(text, at):
            if m.lastgroup == "string" and m.group()[0] == "`" and _stray(text, m, out):
                at = m.start() + 1
                out.append(Lexeme("mark", "`", m.start(), at))
                break
            out.append(Lexeme(m.lastgroup, m.group(), *m.span()))
        else:
            return out


def _stray(text: str, string: re.Match, before: list[Lexeme]) -> bool:
    """Whether the first of two backticks is none that opens a string."""
    body = string.group()[1:-1]
    if body.rstrip(" \t")[-1:] in ("=", ":", "+") and text[string.end() : string.end() + 1].isalnum():
        return True  # the second one opens a value
    value = before and (before[-1].kind in ("assign", "plus") or before[-1].text in ("(", "[", "{", ","))
    return "\n" in body and not value


def assignments(text: str) -> list[Assignment]:
    """(target, operands) pairs in the order of the text.

    Known forms: `name = value`, `name := value`, `name: type = value`,
    `"name": value`, `name => value`, `name: value`; a value is a chain of
    literals and names joined by `+`, or an unquoted run up to white space.
    """
    return [pair for _, pair in sorted(_placed(text), key=lambda x: x[0])]


def _placed(text: str) -> list[tuple[int, Assignment]]:
    """(place of the sign, pair) of the text and of its strings in backticks and triple quotes."""
    lexemes = _lexemes(text)
    found = []
    for lexeme in lexemes:
        if lexeme.kind == "string" and (lexeme.text[0] == "`" or lexeme.text[:3] in ('"""', "'''")):
            body = _string_body(lexeme)
            if "=" not in body.text and ":" not in body.text:
                continue
            for place, (target, operands) in _placed(body.text):
                moved = tuple(o._replace(start=o.start + body.start, end=o.end + body.start) for o in operands)
                found.append((place + body.start, Assignment(target, moved)))
    lexemes.append(Lexeme("line", "\n", len(text), len(text)))
    at = 0
    while at + 1 < len(lexemes):
        at += 1
        sign, left = lexemes[at], lexemes[at - 1]
        if sign.kind != "assign" or left.kind not in ("name", "string"):
            continue
        if sign.text == "=" and at >= 3 and lexemes[at - 2].text == ":" and lexemes[at - 3].kind == "name":
            left = lexemes[at - 3]  # the name before its type
        operands, value = _operands(text, lexemes, at + 1)
        if sign.text == ":" and lexemes[min(at + 2, len(lexemes) - 1)].text == "=":
            continue  # the type of an annotated name; its value follows
        if operands:
            found.append((sign.start, Assignment(_string_body(left).text if left.kind == "string" else left.text, operands)))
            at = value  # what a value holds is no assignment of this level
    return found


def _operands(text: str, lexemes: list[Lexeme], at: int) -> tuple[tuple[Lexeme, ...], int]:
    """The operands of the value that begins at a lexeme, and the value's last lexeme."""
    operands = []
    while at < len(lexemes):
        part = lexemes[at]
        run = _BARE.match(text, part.start) if part.kind in ("name", "number", "mark") else None
        if part.kind == "string":
            operands.append(_string_body(part))
        elif run is not None:
            operands.append(Lexeme("bare", run.group(), *run.span()))
            while lexemes[at].end < run.end():
                at += 1
        else:
            return tuple(operands), at - 1
        if at + 1 >= len(lexemes) or lexemes[at + 1].kind != "plus":
            return tuple(operands), at
        at += 2
    return tuple(operands), at - 1


# Scores. The words and weights are fixed values.
_SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "pass": 0.8, "token": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.7, "authorization": 0.8, "bearer": 0.9,
}
_SENSITIVE_PAIRS = {
    ("api", "key"): 1.0, ("private", "key"): 1.0, ("access", "key"): 1.0, ("secret", "key"): 1.0,
    ("encryption", "key"): 0.9, ("signing", "key"): 0.9, ("master", "key"): 0.9, ("connection", "string"): 0.7,
}
# A name that ends so speaks about a secret without holding one.
_ABOUT = {
    "url", "uri", "path", "file", "name", "field", "label", "hint", "length", "type", "id", "count", "policy",
    "prompt", "expiry", "ttl", "header", "param", "endpoint", "limit",
}
_PLACEHOLDERS = re.compile(
    r"\$\{.*|\{\{.*|<.*>|%\(.*|x{4,}|\*{4,}|change.?me|your.*|example.*|placeholder|todo|none|null|true|false|undefined",
    re.I,
)
_PLACEHOLDER_STARTS = re.compile(
    r"\$\{|\{\{|<|%\(|x{4}|\*{4}|change|your|example|placeholder|todo|none|null|true|false|undefined", re.I
)
_NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def name_weight(name: str) -> float:
    """How sensitive a target is by its name, from 0 to 1."""
    parts = [p.lower() for p in _NAME_PARTS.findall(name)]
    weight = max((_SENSITIVE.get(p, 0.0) for p in parts), default=0.0)
    weight = max([weight, *(_SENSITIVE_PAIRS.get(pair, 0.0) for pair in zip(parts, parts[1:]))])
    return weight * (0.2 if parts and parts[-1] in _ABOUT else 1.0)


def literal_weight(value: str) -> float:
    """How much a literal looks like a secret, from 0 to 1."""
    value = value.strip()
    if len(value) < 8 or _PLACEHOLDERS.fullmatch(value):
        return 0.0
    return _spread_weight(len(value), list(Counter(value).values()), re.search(r"\s", value) is not None)


def _spread_weight(size: int, counts: list[int], spaced: bool) -> float:
    if size < 8 or len(counts) < 4:
        return 0.0
    share = [n / size for n in counts]
    entropy = -sum(p * math.log2(p) for p in share)
    return (0.6 + 0.4 * min(1.0, entropy / 3.5)) * (0.3 if spaced else 1.0)


class _Sum:
    """What the score of a long joined value needs of it, of fixed size; for ASCII only.

    `blank` and `tail` count white space before and after the rest, `counts` what is between.
    """

    __slots__ = ("blank", "counts", "spaced", "head", "tail")

    def __init__(self, blank, counts, spaced: bool, head: str, tail):
        self.blank, self.counts, self.spaced, self.head, self.tail = blank, counts, spaced, head, tail

    @staticmethod
    def of(text: str) -> _Sum | None:
        if not text.isascii():
            return None
        count = lambda part: np.bincount(np.frombuffer(part.encode(), np.uint8), minlength=128)
        left = text.lstrip()
        core = left.rstrip()
        return _Sum(
            count(text[: len(text) - len(left)]), count(core), re.search(r"\s", core) is not None, core[:16],
            count(left[len(core) :]),
        )

    def then(self, other: _Sum) -> _Sum:
        if not self.head:
            return _Sum(self.blank + other.blank, other.counts, other.spaced, other.head, other.tail)
        if not other.head:
            return _Sum(self.blank, self.counts, self.spaced, self.head, self.tail + other.blank + other.tail)
        between = self.tail + other.blank
        joined = bool(between.any())
        # A head shorter than 16 characters is the whole text so far.
        head = self.head if len(self.head) >= 16 or joined else (self.head + other.head)[:16]
        return _Sum(
            self.blank, self.counts + between + other.counts, self.spaced or other.spaced or joined, head, other.tail
        )

    def weight(self) -> float | None:
        """None where only the text itself can tell, as it begins like a placeholder."""
        if not self.head or _PLACEHOLDER_STARTS.match(self.head):
            return None
        return _spread_weight(int(self.counts.sum()), self.counts[self.counts > 0].tolist(), self.spaced)


# A joined value of up to so many literals keeps the list of them.
_LISTED = 64


class _Value:
    """A literal, or what the operands of an assignment make: other values, joined."""

    __slots__ = ("literal", "kids", "leaves", "sum", "best")

    def __init__(self, literal: Lexeme | None, kids: tuple[_Value, ...] = ()):
        self.literal, self.kids, self.best, self.sum = literal, tuple(dict.fromkeys(kids)), 0.0, None
        self.leaves = (self,) if literal is not None else self._listed()
        if self.leaves is None and sum(kid.literal is None for kid in self.kids) <= 1:
            # Literals of this assignment are in no other value, so nothing is joined twice.
            parts = [kid.sum if kid.leaves is None else _Sum.of(kid.text()) for kid in self.kids]
            if all(part is not None for part in parts):
                self.sum = reduce(_Sum.then, parts)

    def _listed(self) -> tuple[_Value, ...] | None:
        if any(kid.leaves is None for kid in self.kids):
            return None
        leaves = tuple(dict.fromkeys(leaf for kid in self.kids for leaf in kid.leaves))
        return leaves if len(leaves) <= _LISTED else None

    def text(self) -> str:
        """All literals joined in order, each once: a constant may be joined to itself again and again."""
        if self.leaves is not None:
            return "".join(leaf.literal.text for leaf in self.leaves)
        seen, found, waiting = set(), {}, [self]
        while waiting:
            value = waiting.pop()
            if value in seen:
                continue
            seen.add(value)
            if value.leaves is not None:
                found.update(dict.fromkeys(value.leaves))
            else:
                waiting += reversed(value.kids)
        return "".join(leaf.literal.text for leaf in found)

    def weight(self) -> float:
        known = None if self.sum is None else self.sum.weight()
        return literal_weight(self.text()) if known is None else known


def literal_scores(pairs: list[Assignment]) -> dict[tuple[int, int], float]:
    """Score of each literal: its own weight times that of the most sensitive target it reaches.

    A name has the value it was given last before, else the one it is given last further
    down. Every value is made once, whatever uses it, so chains of any length are followed
    in time that grows with the text. A name that leads back to itself adds nothing there.
    """
    last = {pair.target: pair.operands for pair in pairs}
    leaves: dict[tuple[int, int], _Value] = {}
    held: dict[str, _Value] = {}
    ahead: dict[str, _Value | None] = {}
    made: list[_Value] = []  # what a value is made of stands before it

    def leaf(operand: Lexeme) -> _Value:
        return leaves.setdefault((operand.start, operand.end), _Value(operand))

    def joined(kids: list[_Value]) -> _Value:
        made.append(_Value(None, tuple(kids)))
        return made[-1]

    def further_down(name: str) -> _Value:
        """The value a name is given last; names in it have their last values too."""
        waiting = [(name, iter(last[name]), [])]
        ahead[name] = None  # being made
        while waiting:
            here, operands, kids = waiting[-1]
            for operand in operands:
                if operand.kind == "literal" or operand.text not in last:
                    kids.append(leaf(operand))
                elif operand.text in ahead:
                    if ahead[operand.text] is not None:
                        kids.append(ahead[operand.text])
                else:
                    ahead[operand.text] = None
                    waiting.append((operand.text, iter(last[operand.text]), []))
                    break
            else:
                waiting.pop()
                ahead[here] = joined(kids)
                if waiting:
                    waiting[-1][2].append(ahead[here])
        return ahead[name]

    def value(operand: Lexeme, target: str) -> _Value:
        if operand.kind != "literal":
            if operand.text in held:
                return held[operand.text]
            if operand.text in last and operand.text != target:
                return ahead.get(operand.text) or further_down(operand.text)
        return leaf(operand)

    for pair in pairs:
        node = joined([value(operand, pair.target) for operand in pair.operands])
        held[pair.target] = node
        weight = name_weight(pair.target)
        if weight:
            # Concatenated parts are judged as the one value they make.
            node.best = max(node.best, weight * node.weight())
    for node in reversed(made):
        for kid in node.kids:
            kid.best = max(kid.best, node.best)
    return {place: found.best for place, found in leaves.items() if found.best}


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text."""
    base = base_spans(text)
    if "=" not in text and ":" not in text:
        return base, base
    begins, furthest = [b.start for b in base], list(accumulate((b.end for b in base), max))

    def reported(start: int, end: int) -> bool:
        """Whether one base span that begins before reaches over it."""
        before = bisect_right(begins, start)
        return before > 0 and furthest[before - 1] >= end

    found = [
        Span("literal", start, end)
        for (start, end), score in literal_scores(assignments(text)).items()
        if score >= THRESHOLD and end > start and not reported(start, end)
    ]
    return base, _ordered([*base, *found])


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(",".join(map(str, spans)).encode()).hexdigest()


def secret_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document: base counts and digest, and all spans."""

    def compute():
        def work(column):
            pairs = [scan(t) for t in texts(column)]
            counts = [[sum(s.kind == kind for s in spans) for _, spans in pairs] for kind in KINDS]
            return [
                *(pa.array(c, pa.int64()) for c in counts), pa.array([digest(base) for base, _ in pairs]),
                pa.array([",".join(map(str, spans)) for _, spans in pairs]),
            ]

        return work

    return per_row(
        docs, [id_column], [text_column], compute,
        "n_assign bigint, n_access bigint, n_hex bigint, n_literal bigint, base_sha256 string, spans string",
    )


def redacted(text: str, mark: str = "[secret]") -> str:
    """The text with every span replaced; spans that overlap are replaced as one."""
    merged: list[list[int]] = []
    for span in scan(text)[1]:
        if merged and span.start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], span.end)
        else:
            merged.append([span.start, span.end])
    kept = zip([0, *(end for _, end in merged)], [*(start for start, _ in merged), len(text)])
    return mark.join(text[a:b] for a, b in kept)


def redact(docs: DataFrame, text_column: str = "text", length_column: str | None = None) -> DataFrame:
    """All rows and columns, with the secrets in the texts replaced; null texts stay null.

    `length_column`, where given, is set to the code points of the new text.
    """
    schema, at = docs.schema, docs.columns.index(text_column)
    length_at = docs.columns.index(length_column) if length_column else None

    def run(batches):
        for batch in (part for full in batches for part in slices(full)):
            columns = list(batch.columns)
            new = [None if t is None else redacted(t) for t in columns[at].to_pylist()]
            columns[at] = pa.array(new, columns[at].type)
            if length_at is not None:
                sizes = pa.array([None if t is None else len(t) for t in new], pa.int64())
                columns[length_at] = sizes.cast(columns[length_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, schema)
