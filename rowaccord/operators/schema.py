"""Comparing column lists, and mapping the names of table 2 onto table 1.

Schemas are known to the driver, so these operators start no job on the tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Points taken off a full score of 100, and the rename threshold.
POINTS_ONLY_IN_1 = 5
POINTS_ONLY_IN_2 = 2
POINTS_REORDERED = 5
POINTS_TYPE_MISMATCH = 3
RENAME_SIMILARITY = 0.7


def normalize_map(column_map: Sequence[Mapping[str, str]] | Mapping[str, str] | None) -> dict[str, str]:
    """``{name in table 2: name in table 1}`` from a list of ``{"f1", "f2"}`` or a mapping f2 → f1.

    Entries that lack a side or change nothing are left out.
    """
    if not column_map:
        return {}
    if isinstance(column_map, Mapping):
        pairs = [(f2, f1) for f2, f1 in column_map.items()]
    else:
        pairs = [(m.get("f2"), m.get("f1")) for m in column_map]
    return {f2: f1 for f2, f1 in pairs if f1 and f2 and f1 != f2}


def apply_column_map(
    df2: DataFrame, column_map: Sequence[Mapping[str, str]] | Mapping[str, str] | None
) -> DataFrame:
    """Rename columns of table 2 into the names of table 1; unknown names are skipped."""
    renames = {f2: f1 for f2, f1 in normalize_map(column_map).items() if f2 in df2.columns}
    if not renames:
        return df2
    names = [renames.get(c, c) for c in df2.columns]
    doubled = sorted({n for n in names if names.count(n) > 1})
    if doubled:
        raise ValueError(f"column map gives table 2 several columns named {doubled}")
    return df2.toDF(*names)


@dataclass(frozen=True)
class SchemaFacts:
    """The comparison of two column lists, from the schemas alone."""

    only_in_1: list[str]
    only_in_2: list[str]
    in_both: list[str]
    type_mismatches: int
    reordered: bool

    @property
    def score(self) -> float:
        points = (
            len(self.only_in_1) * POINTS_ONLY_IN_1
            + len(self.only_in_2) * POINTS_ONLY_IN_2
            + (POINTS_REORDERED if self.reordered else 0)
            + self.type_mismatches * POINTS_TYPE_MISMATCH
        )
        return max(0.0, 100.0 - points)


def schema_facts(df1: DataFrame, df2: DataFrame) -> SchemaFacts:
    set_1, set_2 = set(df1.columns), set(df2.columns)
    types_1, types_2 = dict(df1.dtypes), dict(df2.dtypes)
    both = sorted(set_1 & set_2)
    return SchemaFacts(
        only_in_1=sorted(set_1 - set_2),
        only_in_2=sorted(set_2 - set_1),
        in_both=both,
        type_mismatches=sum(types_1[c] != types_2[c] for c in both),
        reordered=[c for c in df1.columns if c in set_2] != [c for c in df2.columns if c in set_1],
    )


def compare_schemas(df1: DataFrame, df2: DataFrame) -> DataFrame:
    """One row per column name: ``name, status, position_1, position_2, dtype_1, dtype_2, same_type, moved``.

    ``status`` is ``both``, ``only_in_1`` or ``only_in_2``. ``moved`` tells whether a shared
    column has another place among the shared columns.
    """
    place_1 = {c: i for i, c in enumerate(df1.columns)}
    place_2 = {c: i for i, c in enumerate(df2.columns)}
    types_1, types_2 = dict(df1.dtypes), dict(df2.dtypes)
    rank_1 = {c: i for i, c in enumerate(c for c in df1.columns if c in place_2)}
    rank_2 = {c: i for i, c in enumerate(c for c in df2.columns if c in place_1)}
    rows = []
    for name in sorted({*place_1, *place_2}):
        status = "both" if name in rank_1 else "only_in_1" if name in place_1 else "only_in_2"
        same, moved = None, None
        if status == "both":
            same, moved = types_1[name] == types_2[name], rank_1[name] != rank_2[name]
        rows.append(
            (name, status, place_1.get(name), place_2.get(name), types_1.get(name), types_2.get(name), same, moved)
        )
    return df1.sparkSession.createDataFrame(
        rows,
        "name string, status string, position_1 int, position_2 int, dtype_1 string, dtype_2 string, "
        "same_type boolean, moved boolean",
    )


def rename_candidates(df1: DataFrame, df2: DataFrame) -> DataFrame:
    """``name_1, name_2, similarity`` of unmatched names that look alike.

    Similarity is one minus the edit distance of the lower-cased names over the longer
    length; pairs above 0.7 are kept. The two inputs are lists of column names.
    """
    only_1 = [c for c in df1.columns if c not in set(df2.columns)]
    only_2 = [c for c in df2.columns if c not in set(df1.columns)]
    pairs = [(x, y) for x in only_1 for y in only_2]
    longest = F.greatest(F.char_length("name_1"), F.char_length("name_2"))
    similarity = 1.0 - F.levenshtein(F.lower("name_1"), F.lower("name_2")) / longest
    return (
        df1.sparkSession.createDataFrame(pairs, "name_1 string, name_2 string")
        .withColumn("similarity", similarity)
        .where(F.col("similarity") > RENAME_SIMILARITY)
        .withColumn("similarity", F.round("similarity", 3))
        .orderBy("name_1", "name_2")
    )


def schema_score(df1: DataFrame, df2: DataFrame) -> DataFrame:
    """One row: counts of each kind of schema difference and the compatibility score (0 to 100)."""
    f = schema_facts(df1, df2)
    row = (len(f.only_in_1), len(f.only_in_2), len(f.in_both), f.type_mismatches, f.reordered, f.score)
    return df1.sparkSession.createDataFrame(
        [row],
        "only_in_1 bigint, only_in_2 bigint, in_both bigint, type_mismatches bigint, reordered boolean, score double",
    )
