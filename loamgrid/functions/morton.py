"""Compressed Morton codes: dimensions share bits in turn, each only as many as its grid needs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_plan(shape: Sequence[int]) -> list[tuple[int, int]]:
    """``(dimension, bit)`` for each bit of the code, lowest first."""
    if min(shape) < 1:
        raise ValueError(f"a grid needs a cell in every dimension: {tuple(shape)}")
    plan = [(d, b) for b in range(max(shape).bit_length()) for d, n in enumerate(shape) if 1 << b < n]
    if len(plan) > 63:
        raise ValueError(f"{len(plan)} bits do not fit a bigint")
    return plan


def encode(cell: Sequence[Column], shape: Sequence[int]) -> Column:
    """Code of a cell given as bigint columns; cells outside the grid give null."""
    code = F.lit(0).cast("bigint")
    for at, (d, b) in enumerate(bit_plan(shape)):
        code = code.bitwiseOR(F.shiftleft(F.shiftright(cell[d], b).bitwiseAND(F.lit(1).cast("bigint")), at))
    inside = F.lit(True)
    for c, n in zip(cell, shape):
        inside = inside & c.between(0, n - 1)
    return F.when(inside, code)


def decode(code: Column, shape: Sequence[int]) -> list[Column]:
    """Cell of a code, one bigint column per dimension; codes of no cell give null."""
    cell = [F.lit(0).cast("bigint") for _ in shape]
    plan = bit_plan(shape)
    for at, (d, b) in enumerate(plan):
        cell[d] = cell[d].bitwiseOR(F.shiftleft(F.shiftright(code, at).bitwiseAND(F.lit(1).cast("bigint")), b))
    inside = code.between(0, (1 << len(plan)) - 1)
    for c, n in zip(cell, shape):
        inside = inside & (c < n)
    return [F.when(inside, c) for c in cell]


def encode_cell(cell: Sequence[int], shape: Sequence[int]) -> int:
    if any(not 0 <= c < n for c, n in zip(cell, shape, strict=True)):
        raise ValueError(f"cell {tuple(cell)} is outside the grid {tuple(shape)}")
    return sum((cell[d] >> b & 1) << at for at, (d, b) in enumerate(bit_plan(shape)))


def decode_cell(code: int, shape: Sequence[int]) -> tuple[int, ...]:
    cell, plan = [0] * len(shape), bit_plan(shape)
    for at, (d, b) in enumerate(plan):
        cell[d] |= (code >> at & 1) << b
    if code >> len(plan) or any(c >= n for c, n in zip(cell, shape)):
        raise ValueError(f"code {code} is no cell of the grid {tuple(shape)}")
    return tuple(cell)
