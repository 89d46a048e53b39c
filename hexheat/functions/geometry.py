"""Rings as a stream of drawing commands, the way vector tiles hold them, and back. All are built-in expressions.

A command word is `count * 8 + command`: move to (1) and line to (2) are followed by `count` zigzag-coded steps in x
and y from the cursor; close path (7) has no steps.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hexheat.functions.tiles import zigzag

MOVE, LINE, CLOSE = 1, 2, 7  # fixed values of the format
POINT = "struct<x:bigint,y:bigint>"
# Points of a ring are gathered in blocks of so many, so that a point doesn't copy all those before it.
BLOCK = 128


def to_zigzag(value: Column) -> Column:
    """Zigzag code of a signed number: 0, -1, 1, -2 become 0, 1, 2, 3."""
    value = value.cast("bigint")
    return F.shiftleft(value, 1).bitwiseXOR(F.shiftright(value, 63))


def word(command: int, count: Column) -> Column:
    return (count.cast("bigint") * 8 + command).cast("bigint")


def encode_rings(rings: Column) -> Column:
    """Commands (ARRAY<BIGINT>) that draw closed rings of whole-number points, each ending where it starts.

    Rings of fewer than three different corners draw nothing. NULL rings give NULL.
    """
    open_rings = F.transform(F.filter(rings, lambda r: F.size(r) >= 4), lambda r: F.slice(r, F.lit(1), F.size(r) - 1))

    def steps(points: Column, before: Column) -> Column:
        """Codes of the way from `before` to the first point, and on from point to point."""
        froms = F.concat(F.array(before), F.slice(points, F.lit(1), F.size(points) - 1))
        return F.zip_with(froms, points, lambda a, b: F.array(to_zigzag(b["x"] - a["x"]), to_zigzag(b["y"] - a["y"])))

    def drawn(points: Column, before: Column) -> Column:
        way = steps(points, before)
        return F.concat(
            F.array(word(MOVE, F.lit(1))), F.element_at(way, 1), F.array(word(LINE, F.size(points) - 1)),
            F.flatten(F.slice(way, F.lit(2), F.size(points) - 1)), F.array(word(CLOSE, F.lit(1))),
        )

    origin = F.struct(F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"))
    ends = F.concat(F.array(origin), F.transform(open_rings, lambda r: F.element_at(r, -1).cast(POINT)))
    whole = F.transform(open_rings, lambda r: r.cast(f"array<{POINT}>"))
    return F.flatten(F.zip_with(whole, F.slice(ends, F.lit(1), F.size(whole)), drawn))


def decode_rings(commands: Column) -> Column:
    """The closed rings (ARRAY of ARRAY of x, y) that a stream of commands draws; NULL for NULL.

    One pass over the words: the state holds the command at work, the steps it still has, and the cursor. What is
    moved to and never closed draws no ring, and words after an unknown command are read as its steps.
    """
    points = f"array<{POINT}>"
    start = F.struct(
        F.lit(0).cast("bigint").alias("command"), F.lit(0).cast("bigint").alias("left"), F.lit(0).cast("bigint").alias("dx"),
        F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"),
        F.array().cast(f"array<{points}>").alias("rings"), F.array().cast(f"array<{points}>").alias("full"), F.array().cast(points).alias("part"),
    )

    def step(acc: Column, value: Column) -> Column:
        value = value.cast("bigint")
        is_word = acc["left"] == 0
        command = F.when(is_word, value.bitwiseAND(F.lit(7).cast("bigint"))).otherwise(acc["command"])
        closes = is_word & (command == CLOSE)
        moves = is_word & (command == MOVE)
        left = F.when(closes, F.lit(0).cast("bigint")).when(is_word, F.shiftright(value, 3) * 2).otherwise(acc["left"] - 1)
        is_y = ~is_word & (acc["left"] % 2 == 1)
        x = F.when(is_y, acc["x"] + acc["dx"]).otherwise(acc["x"])
        y = F.when(is_y, acc["y"] + zigzag(value)).otherwise(acc["y"])
        whole = F.flatten(F.concat(acc["full"], F.array(acc["part"])))
        blank, none = F.array().cast(f"array<{points}>"), F.array().cast(points)
        full = F.size(acc["part"]) >= BLOCK
        return F.struct(
            command.alias("command"), left.alias("left"), F.when(~is_word & ~is_y, zigzag(value)).otherwise(acc["dx"]).alias("dx"),
            x.alias("x"), y.alias("y"),
            F.when(closes & (F.size(acc["part"]) > 0), F.concat(acc["rings"], F.array(F.concat(whole, F.slice(whole, 1, 1))))).otherwise(acc["rings"]).alias("rings"),
            F.when(closes | moves, blank).when(is_y & full, F.concat(acc["full"], F.array(acc["part"]))).otherwise(acc["full"]).alias("full"),
            F.when(closes | moves, none)
            .when(is_y, F.concat(F.when(full, none).otherwise(acc["part"]), F.array(F.struct(x.alias("x"), y.alias("y"))))).otherwise(acc["part"]).alias("part"),
        )

    return F.aggregate(commands, start, step, lambda acc: acc["rings"])
