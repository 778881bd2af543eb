"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

Only Spark's own functions. A span's place follows from the lengths of the
matches and of the pieces between them, as `split` and `regexp_extract_all` find
the same matches. Base kinds are reported whatever their score; further kinds
where a checksum confirms them or a word nearby speaks for them, unless they lie
inside a base span.

Patterns that must not start inside a run say so with a look-behind or `\\G`, and
take runs possessively, so that no text makes them slow; what they match is the
leftmost match of the plain pattern. Places are summed up in blocks of matches, and
words nearby are looked up in pieces of the text, so that the time a text takes grows
with its length and its spans, not with their product.

Offsets count code points, ends are exclusive. Null and empty texts have no
spans. Spans that begin at the same place are ordered as `KINDS` lists them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from dayloom.llm.expressions import let, scan

_LOCAL = r"A-Za-z0-9._%+-"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str  # texts without a match of this hold no span
    score: int  # of a confirmed span with no word nearby, in percent
    context: str  # words that raise the score

    def confirmed(self, value: Column) -> Column:
        return _CHECKS[self.name](value)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """12 to 19 digits whose Luhn sum is a multiple of ten."""

    def total(d: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            doubled = (F.ascii(F.substr(d, i, F.lit(1))) - 48) * (F.lit(2) - i % 2)
            return acc + doubled - F.when(doubled > 9, 9).otherwise(0)

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add)

    return let(F.reverse(_digits(value)), lambda d: F.length(d).between(12, 19) & (total(d) % 10 == 0))


def _mod97(value: Column) -> Column:
    """Country and check digits moved to the end, letters read as 10 to 35, leave 1 when divided by 97."""

    def remainder(v: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            code = F.ascii(F.substr(v, i, F.lit(1)))
            return F.when(code >= 65, acc * 100 + code - 55).otherwise(acc * 10 + code - 48) % 97

        return F.aggregate(F.sequence(F.lit(1), F.length(v)), F.lit(0), add)

    def moved(v: Column) -> Column:
        return F.concat(F.substr(v, F.lit(5)), F.substr(v, F.lit(1), F.lit(4)))

    return let(moved(F.replace(value, F.lit(" "), F.lit(""))), lambda v: remainder(v) == 1)


_CHECKS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"),
    "card": _luhn,
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
    "iban": _mod97,
    "ssn": lambda v: F.lit(True),
    "local_phone": lambda v: F.lit(True),
}

BASE = (
    Kind(
        "email", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 80,
        r"e-?mail|contact|write to|correo|courriel",
    ),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 60, r"(?:^|[^a-z])ip(?:[^a-z]|$)|address|host|server"),
    Kind("card", r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+", r"[0-9](?:[\x20-]?[0-9]){11}", 90, r"card|visa|mastercard|karte|carte|tarjeta"),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 70,
        r"phone|call|(?:^|[^a-z])tel|mobile|fax|appel|llama",
    ),
)
ADDED = (
    Kind(
        "iban", r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)", "[A-Z]{2}[0-9]{2}",
        90, r"iban|account|konto|compte|cuenta",
    ),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9]-[0-9]", 30, r"(?:^|[^a-z])ssn(?:[^a-z]|$)|social security"),
    Kind("local_phone", r"\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}", r"\([0-9]", 30, r"phone|call|(?:^|[^a-z])tel|mobile|fax"),
)
KINDS = BASE + ADDED
CONTEXT_WEIGHT, CONTEXT_BEFORE, CONTEXT_AFTER = 30, 40, 20
THRESHOLD = 50


# Long texts are cut into pieces of so many code points, where the words near a span are looked up.
_PIECE = 256


def _pieces(text: Column) -> Column:
    short = F.length(text) <= _PIECE
    return F.when(short, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)))


def _part(pieces: Column, start: Column, length: Column) -> Column:
    """At most `length` code points from a place on, which lie in one piece or two."""
    number = F.floor(start / _PIECE).cast("int")
    first, second = F.get(pieces, number), F.coalesce(F.get(pieces, number + 1), F.lit(""))
    at = start - number * _PIECE
    return F.when(
        at + length <= _PIECE, F.substr(first, at + 1, length)
    ).otherwise(F.substr(F.concat(first, second), at + 1, length))


def _proposed(text: Column, digits: Column, kind: Kind, number: int) -> Column:
    """Confirmed spans of a kind: start, kind, end, score; `digits` says whether the text has any."""

    def places(found: Column, gaps: Column) -> Column:
        def step(at: Column, i: Column) -> tuple[Column, Column]:
            value = F.get(found, i)
            start = at + F.length(F.get(gaps, i))
            end = start + F.length(value)
            return end, F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"), i.alias("i"))

        numbers = F.sequence(F.lit(0), F.size(found) - 1)
        return let(numbers, lambda n: scan(n, F.lit(0), step, "struct<start:int,kind:int,end:int,i:int>"))

    def scored(pieces: Column, span: Column) -> Column:
        first = F.greatest(span["start"] - CONTEXT_BEFORE, F.lit(0))
        near = F.concat_ws(
            " ", _part(pieces, first, span["start"] - first), _part(pieces, span["end"], F.lit(CONTEXT_AFTER))
        )
        bonus = F.when(F.lower(near).rlike(kind.context), CONTEXT_WEIGHT).otherwise(0)
        score = F.least(F.lit(kind.score) + bonus, F.lit(100))
        return F.struct(span["start"].alias("start"), span["kind"].alias("kind"), span["end"].alias("end"), score.alias("score"))

    def with_scores(spans: Column) -> Column:
        return F.when(
            F.size(spans) > 0, let(_pieces(text), lambda pieces: F.transform(spans, lambda s: scored(pieces, s)))
        ).otherwise(none)

    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,score:int>>)")
    found = let(
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)),
        lambda m: F.when(F.size(m) == 0, none).otherwise(
            let(
                F.filter(let(F.split(text, kind.pattern, -1), lambda g: places(m, g)), lambda s: kind.confirmed(F.get(m, s["i"]))),
                with_scores,
            )
        ),
    )
    hinted = F.contains(text, F.lit(kind.hint)) if kind.hint == "@" else F.when(digits, text.rlike(kind.hint))
    return F.when(hinted, found).otherwise(none)


def _outside(base: Column, added: Column) -> Column:
    """All spans in order, without those of `added` that lie inside one of `base`."""
    span = "struct<start:int,kind:int,end:int,score:int>"

    def step(reach: Column, s: Column) -> tuple[Column, Column]:
        # Base spans stand before added ones of the same start, so the furthest end so far tells.
        is_base = s["kind"] < len(BASE)
        kept = F.struct(s.alias("span"), (is_base | (s["end"] > reach)).alias("kept"))
        return F.when(is_base, F.greatest(reach, s["end"])).otherwise(reach), kept

    def swept(spans: Column) -> Column:
        marked = scan(spans, F.lit(0), step, f"struct<span:{span},kept:boolean>")
        return F.transform(F.filter(marked, lambda m: m["kept"]), lambda m: m["span"])

    return F.when(F.size(added) == 0, base).otherwise(let(F.sort_array(F.concat(base, added)), swept))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k.name) for k in KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def _count(spans: Column, number: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")


def personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document: base counts and digest, all spans, and their scores in percent in the same order."""
    text = F.col("text")
    digits = F.col("digits")
    plain = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    proposed = plain.withColumn("digits", text.rlike("[0-9]")).select(
        "id",
        F.sort_array(F.concat(*(_proposed(text, digits, k, i) for i, k in enumerate(BASE)))).alias("base"),
        F.concat(*(_proposed(text, digits, k, len(BASE) + i) for i, k in enumerate(ADDED))).alias("added"),
    )
    base, added = F.col("base"), F.col("added")
    likely = F.filter(added, lambda a: a["score"] >= THRESHOLD)
    spans = proposed.select("id", "base", let(likely, lambda a: _outside(base, a)).alias("spans"))
    counts = [_count(base, i).alias(f"n_{k.name}") for i, k in enumerate(BASE)]
    return spans.select(
        F.col("id").alias(id_column), *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )
