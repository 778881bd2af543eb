"""Column expressions for operators that stay within Spark's own functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

SPACES = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, also where `body` uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_SCAN = 64


def scan(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], out_type: str) -> Column:
    """What `step(state, item)`, a pair of the next state and a value of `out_type`, gives for the items in order.

    An aggregate copies what it holds at each step, so values are gathered in blocks of
    blocks: the time grows with the items up to some hundred thousand.
    """

    def begin(state: Column, kind: str) -> Column:
        return F.struct(state.alias("state"), F.expr(f"cast(array() as array<{kind}>)").alias("out"))

    def add(acc: Column, item: Column) -> Column:
        after, value = step(acc["state"], item)
        return F.struct(after.alias("state"), F.concat(acc["out"], F.array(value)).alias("out"))

    def fold(items: Column, state: Column, size: int, finish: Callable[[Column, Column], Column]) -> Column:
        if size == 1:
            return F.aggregate(items, begin(state, out_type), add, lambda acc: finish(acc["state"], acc["out"]))

        def block(acc: Column, number: Column) -> Column:
            def appended(after: Column, out: Column) -> Column:
                return F.struct(after.alias("state"), F.concat(acc["out"], F.array(out)).alias("out"))

            return fold(F.slice(items, number * size + 1, F.lit(size)), acc["state"], size // _SCAN, appended)

        numbers = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int"))
        return F.aggregate(
            numbers, begin(state, f"array<{out_type}>"), block, lambda acc: finish(acc["state"], F.flatten(acc["out"]))
        )

    whole = fold(items, state, _SCAN * _SCAN, lambda _, out: out)
    return F.when(F.size(items) > 0, whole).otherwise(F.expr(f"cast(array() as array<{out_type}>)"))


def words(text: Column) -> Column:
    """Runs without white space."""
    return F.array_remove(F.split(text, SPACES), "")


def count_of(text: Column, characters: str) -> Column:
    """How many characters of a class a text has."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"{characters}+", ""))).cast("long")
