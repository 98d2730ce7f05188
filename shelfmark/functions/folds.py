"""Folds inside a row: values that are computed once, and running states over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(items: Column, start: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """The array of outs of a fold: step(state, item) gives struct(state, out); kind is the type of out.

    A fold that appends to its result copies it at every step. Here items go in blocks whose
    results are appended as wholes, so the copying stays small beside the work itself.
    """
    state = lambda s, out: F.struct(s.alias("state"), out.alias("out"))

    def one(acc: Column, item: Column) -> Column:
        return let(step(acc["state"], item), lambda r: state(r["state"], F.concat(acc["out"], F.array(r["out"]))))

    def block(acc: Column, items: Column) -> Column:
        done = F.aggregate(items, state(acc["state"], F.array().cast(f"array<{kind}>")), one)
        return let(done, lambda r: state(r["state"], F.concat(acc["out"], F.array(r["out"]))))

    def blocks(xs: Column) -> Column:
        upto = lambda b: F.least(F.size(xs), (b + 1) * _BLOCK) - 1
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _BLOCK).cast("int")), lambda b: F.transform(F.sequence(b * _BLOCK, upto(b)), lambda i: F.get(xs, i)))

    return let(items, lambda xs: F.when(F.size(xs) > 0, F.flatten(F.aggregate(blocks(xs), state(start, F.array().cast(f"array<array<{kind}>>")), block)["out"])).otherwise(F.array().cast(f"array<{kind}>")))
