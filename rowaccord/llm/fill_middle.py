"""Fill-in-the-middle: each document is cut at two places and its middle moved to the end.

A document's units are its runs of letters and its single other characters. The two cuts are ranks among
units, drawn from a hash of the document's id, and the texts between them are wanted in code points. An
indexable skip list answers that: every node of a lane carries the number of units and the number of code
points up to the lane's next node, so a search that goes right while the units passed stay within the rank,
and down otherwise, reaches the cut with a logarithmic number of steps and knows both its widths.

Python finds the cuts only; the output and the way back to the text are SQL expressions, so the texts cross
to Python once and do not come back.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: One node in this many of a lane also stands in the lane above.
STRIDE = 4
#: Lanes are added until the top one has at most this many nodes.
TOP = 8


@dataclass(frozen=True)
class Lane:
    """Nodes of one lane: how many units and code points lie before the next one, and where it is in the lane below."""

    units: np.ndarray
    points: np.ndarray
    below: np.ndarray


class SkipList:
    """The units of a text by rank. ``n`` is their number, ``points`` the text's length in code points."""

    def __init__(self, text: str):
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        lower = code | 32
        letter = (lower >= 97) & (lower <= 122)
        first = np.ones(len(code), bool)
        first[1:] = ~(letter[1:] & letter[:-1])  # a letter after a letter goes on with the unit
        start = np.flatnonzero(first)
        self.n, self.points = len(start), len(code)
        # The lowest lane has one node per unit; a head of width 0 in front is where searches begin.
        units = np.ones(self.n + 1, np.int32)
        units[0] = 0
        points = np.diff(start, prepend=0, append=len(code)).astype(np.int32)
        self.lanes = [Lane(units, points, np.arange(self.n + 1, dtype=np.int32))]
        while len(self.lanes[-1].units) > TOP:
            self._raise()

    def _raise(self) -> None:
        """Add a lane above: its heights come from a hash of the node's rank, the head always rises."""
        lane, level = self.lanes[-1], len(self.lanes)
        mixed = (np.arange(len(lane.units), dtype=np.uint32) + np.uint32(level)) * np.uint32(0x9E3779B1)
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77)
        up = (mixed >> np.uint32(16)) % np.uint32(STRIDE) == 0
        up[0] = True
        at = np.flatnonzero(up).astype(np.int32)
        self.lanes.append(Lane(np.add.reduceat(lane.units, at), np.add.reduceat(lane.points, at), at))

    def reach(self, rank: int) -> int:
        """Code points before the unit of this rank (0 to ``n``)."""
        units = points = node = 0
        for lane in reversed(self.lanes):
            while node < len(lane.units) and units + lane.units[node] <= rank:
                units += int(lane.units[node])
                points += int(lane.points[node])
                node += 1
            if node == len(lane.units):
                break
            node = int(lane.below[node])
        return points


def draws(doc_id: object) -> list[int]:
    """h1 to h4 of a document: the first four 8-digit groups of a hash of its id. A null id counts as an empty text."""
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def cuts(doc_id: object, text: str) -> tuple[int, int | None, int | None, str]:
    """Units of a text, code points of its prefix and middle (null for plain), and its form."""
    h1, h2, h3, h4 = draws(doc_id)
    units = SkipList(text)
    if not text or h3 % 100 >= 90 or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return units.n, None, None, "plain"
    low, high = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    before = units.reach(low)
    return units.n, before, units.reach(high) - before, "spm" if h4 % 100 < 20 else "psm"


_CUT = pa.struct([("n", pa.int64()), ("prefix", pa.int64()), ("middle", pa.int64()), ("form", pa.string())])


def _cuts_of(ids: pa.Array, texts: pa.Array) -> pa.Array:
    # One text at a time: a batch of long texts is never held twice.
    rows = [cuts(i.as_py(), t.as_py()) for i, t in zip(ids, texts, strict=True)]
    return pa.array([dict(zip(_CUT.names, r, strict=True)) for r in rows], _CUT)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output`` of each row, the id under its own name.

    The form is ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix, middle) or ``plain``, where the
    output is the text: one in ten documents by the hash of the id, and all those that are empty or hold a
    mark. Widths are null for plain rows, ``n`` counts the units of every text.

    Null texts are empty ones, null ids are hashed as an empty text. Repeated rows give equal rows; rows
    that share an id share the draws, not the cuts. No other column is read, so names cannot clash.
    An empty table gives an empty table. No shuffle.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    found = docs.select(docs[id_col].alias("id"), text.alias("text"))
    find = F.arrow_udf(_cuts_of, "struct<n: bigint, prefix: bigint, middle: bigint, form: string>")
    found = found.withColumn("cut", find(F.col("id").cast("string"), "text")).select("id", "text", "cut.*")
    prefix = F.expr("substring(text, 1, int(prefix))")
    middle = F.expr("substring(text, int(prefix) + 1, int(middle))")
    suffix = F.expr("substring(text, int(prefix + middle) + 1)")
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.col("text"))
    )
    widths = F.col("prefix").alias("prefix_chars"), F.col("middle").alias("middle_chars")
    return found.select(F.col("id").alias(id_col), "n", "form", *widths, output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The exact text of an output: no part holds a mark, and none can arise where a part meets one."""
    part = F.split(output, "<[PSM]>", -1)  # nothing, first, second, middle
    return (
        F.when(form == "psm", F.concat(part[1], part[3], part[2]))
        .when(form == "spm", F.concat(part[2], part[3], part[1]))
        .otherwise(output)
    )
