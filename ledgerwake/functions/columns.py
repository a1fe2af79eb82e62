"""Column builders: bins over edges, state cells, board strings, hashes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Material of the pieces (fixed values).
PIECE_VALUES = {"p": 1, "n": 3, "b": 3, "r": 5, "q": 9}


def binned(c: Column, edges: Sequence[float], labels: Sequence[object] | None = None, closed: str = "right", missing: object = None) -> Column:
    """The label of the bin between ascending ``edges``; the bin's number from 0 without ``labels``.

    ``closed`` says which end belongs to a bin: with "right" a value equal to an
    edge falls below it. Null and NaN get ``missing``.
    """
    names = list(labels) if labels is not None else list(range(len(edges) + 1))
    if len(names) != len(edges) + 1:
        raise ValueError("there is one label more than edges")
    below = (lambda e: c <= e) if closed == "right" else (lambda e: c < e)
    out = F.when(c.isNull() | F.isnan(c.cast("double")), F.lit(missing))
    for e, name in zip(edges, names, strict=False):
        out = out.when(below(F.lit(e)), F.lit(name))
    return out.otherwise(F.lit(names[-1]))


def state_cell(cp: Column, ply: Column, speed: Column, gap: Column) -> Column:
    """One of 500 cells: five of evaluation, four of plies, five of speed (0 to 4), five of rating gap."""
    merit = F.when(cp <= -300, 0).when(cp < -100, 1).when(cp <= 100, 2).when(cp < 300, 3).otherwise(4)
    plies = binned(ply, [10, 30, 60])
    gaps = binned(gap, [-200, -100, 100, 200])
    return ((merit * 4 + plies) * 5 + speed) * 5 + gaps


def speed_code(c: Column, speeds: Sequence[str] = ("bullet", "blitz", "rapid", "classical")) -> Column:
    """The number of a speed; all others share the last."""
    return reduce(lambda out, x: out.when(c == x[1], x[0]), enumerate(speeds), F.when(F.lit(False), 0)).otherwise(len(speeds))


def occurrences(c: Column, letter: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(letter), F.lit("")))


def board(fen: Column) -> Column:
    """The piece placement, the first field of a position string."""
    return F.split_part(fen, F.lit(" "), F.lit(1))


def piece_counts(fen: Column) -> Mapping[str, Column]:
    """Counts of all kinds of pieces: ``white_p`` to ``white_q`` and ``black_p`` to ``black_q``."""
    b = board(fen)
    return {f"{side}_{p}": occurrences(b, p.upper() if side == "white" else p) for side in ("white", "black") for p in PIECE_VALUES}


def material_balance(fen: Column) -> Column:
    """White's material less black's, kings not counted."""
    n = piece_counts(fen)
    return reduce(lambda x, y: x + y, (v * (n[f"white_{p}"] - n[f"black_{p}"]) for p, v in PIECE_VALUES.items()))


def valid_position(fen: Column, to_move: Column | None = None) -> Column:
    """Whether a position string has six fields, eight ranks of eight squares and one king a side.

    With ``to_move`` (w or b) the second field must also agree. Null is not valid.
    """
    b = board(fen)
    # every digit stands for so many empty squares
    squares = F.transform(F.split(b, "/"), lambda r: F.length(F.regexp_replace(r, "[0-9]", "")) + F.aggregate(F.regexp_extract_all(r, F.lit("([0-9])"), F.lit(1)), F.lit(0), lambda a, x: a + x.cast("int")))
    ok = (
        (F.size(F.split(F.trim(fen), " ")) == 6)
        & b.rlike("^[prnbqkPRNBQK1-8]+(/[prnbqkPRNBQK1-8]+){7}$")
        & (F.array_min(squares) == 8)
        & (F.array_max(squares) == 8)
        & (occurrences(b, "K") == 1)
        & (occurrences(b, "k") == 1)
    )
    if to_move is not None:
        ok &= F.split_part(fen, F.lit(" "), F.lit(2)) == to_move
    return F.coalesce(ok, F.lit(False))


def md5_low(c: Column) -> Column:
    """The last eight bytes of the md5 digest read as a little-endian number, as a decimal string."""
    tail = F.substring(F.md5(c.cast("binary")), 17, 16)
    turned = F.concat(*[F.substring(tail, i, 2) for i in range(15, 0, -2)])
    return F.conv(turned, 16, 10)
