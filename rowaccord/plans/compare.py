"""The whole comparison of two tables, and of one reference with several candidates."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.compare import IgnoreRules
from ..operators.checks import ValidationConfig, check_summary, validate_pair
from ..operators.diff import Diff, DiffSpec
from ..operators.key_search import smallest_keys
from ..operators.keys import discover_keys, key_columns, key_multiplicity
from ..operators.profile import profile_columns
from ..operators.schema import apply_column_map, compare_schemas, rename_candidates, schema_score

@dataclass(frozen=True)
class CompareSpec:
    """A comparison request.

    ``keys`` are names of table 1; ``keys_2`` gives other names they have in table 2. Without
    keys the best unique candidate of table 1 is taken, or else its first column (see :class:`KeyChoice`).
    ``preview`` compares only that share of the keys, chosen by hash on both sides alike.
    ``exact_profiles=False`` profiles with estimated distinct counts, without a shuffle.
    """

    keys: Sequence[str] | None = None
    keys_2: Sequence[str] | None = None
    rules: IgnoreRules = field(default_factory=IgnoreRules)
    column_map: Sequence[Mapping[str, str]] | Mapping[str, str] | None = None
    compare_columns: Sequence[str] | None = None
    validation: ValidationConfig = field(default_factory=ValidationConfig)
    preview: float | None = None
    exact_profiles: bool = True

    def full_column_map(self) -> list[dict[str, str]]:
        """The column map with the differing key names added."""
        if isinstance(self.column_map, Mapping):
            pairs = [{"f1": f1, "f2": f2} for f2, f1 in self.column_map.items()]
        else:
            pairs = [dict(m) for m in self.column_map or []]
        for k1, k2 in zip(self.keys or [], self.keys_2 or []):
            if k1 != k2:
                pairs.append({"f1": k1, "f2": k2})
        return pairs


def preview_keys(df1: DataFrame, df2: DataFrame, keys: Sequence[str], share: float) -> tuple[DataFrame, DataFrame]:
    """Both tables cut to the same share of keys, so that partners stay together.

    A key is kept if its place between 0 and 1, the first 32 bits of the MD5 of its parts as text, is below the share.
    The first key of all is kept in any case: a preview of tables with rows has rows.
    """
    if not 0 < share <= 1:
        raise ValueError(f"preview must be a share above 0 and at most 1, not {share}")
    sides = []
    for df, columns in zip((df1, df2), key_columns(df1, df2, keys)):
        parts = [F.coalesce(c.cast("string"), F.lit("\0")) for c in columns]
        digits = F.substring(F.md5(F.concat_ws("\1", *parts)), 1, 8)
        sides.append((df, F.conv(digits, 16, 10).cast("double") / 2**32))
    least = [df.agg(F.min(place)).first()[0] for df, place in sides]
    first = min((x for x in least if x is not None), default=0.0)
    one, two = (df.where((place < share) | (place == first)) for df, place in sides)
    return one, two


class Comparison:
    """Result of :func:`compare`: tables, each lazy until used."""

    def __init__(self, df1: DataFrame, df2: DataFrame, spec: CompareSpec):
        if spec.keys_2 and len(spec.keys_2) != len(spec.keys or []):
            raise ValueError("keys and keys_2 must have the same length")
        # Names are mapped before anything looks at table 2: keys, schemas, profiles, checks, diff.
        df2 = apply_column_map(df2, spec.full_column_map())
        self.spec = spec
        self.key_choice = KeyChoice(list(spec.keys), "given", "named by the caller") if spec.keys else choose_key(df1)
        self.keys = self.key_choice.columns
        self.is_preview = spec.preview is not None
        if self.is_preview:
            df1, df2 = preview_keys(df1, df2, self.keys, spec.preview)
        self.df1, self.df2 = df1, df2
        self.diff = Diff(df1, df2, DiffSpec(self.keys, spec.rules, None, spec.compare_columns))

    def key_report(self) -> DataFrame:
        """One row: the key's ``columns``, its ``source`` and the ``reason`` for it."""
        k = self.key_choice
        return self.df1.sparkSession.createDataFrame([(k.columns, k.source, k.reason)], "columns array<string>, source string, reason string")

    def schemas(self) -> DataFrame:
        return compare_schemas(self.df1, self.df2)

    def renames(self) -> DataFrame:
        return rename_candidates(self.df1, self.df2)

    def score(self) -> DataFrame:
        return schema_score(self.df1, self.df2)

    @cached_property
    def profiles(self) -> tuple[DataFrame, DataFrame]:
        exact = self.spec.exact_profiles
        return profile_columns(self.df1, exact=exact), profile_columns(self.df2, exact=exact)

    def checks(self, profiles: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
        """All checks; the keys were counted for the diff already, and ready profiles take the place of a scan."""
        k = self.diff.check
        counts = (k.rows_1, k.duplicates_1, k.null_rows_1), (k.rows_2, k.duplicates_2, k.null_rows_2)
        return validate_pair(self.df1, self.df2, self.spec.validation, self.keys, profiles, key_counts=counts)

    def check_summary(self) -> DataFrame:
        return check_summary(self.checks())

    def counts(self) -> DataFrame:
        counts = self.diff.counts()
        return counts.withColumn("is_full_count", F.lit(False)) if self.is_preview else counts

    def column_stats(self) -> DataFrame:
        return self.diff.column_stats()

    def changes(self) -> DataFrame:
        return self.diff.changes()

    def sample(self) -> DataFrame:
        return self.diff.sample()

    def multiplicity(self) -> DataFrame:
        """Keys that repeat; where the key scan saw none, nothing is read again."""
        repeated = key_multiplicity(self.df1, self.df2, self.keys)
        k = self.diff.check
        return repeated if k.duplicates_1 or k.duplicates_2 else repeated.where(F.lit(False))

    def contents(self) -> DataFrame:
        """Contents of keys that repeat on both sides, see :meth:`Diff.factored_contents`."""
        contents = self.diff.factored_contents()
        return contents if self.diff.check.repeated_on_both else contents.where(F.lit(False))


@dataclass(frozen=True)
class KeyChoice:
    """The key of a comparison and why it was taken.

    ``source`` is ``given``, ``single`` (a column whose values almost all differ), ``composite`` (a smallest group of
    columns in which all rows differ) or ``fallback`` (no key was found: the first column, and rows that share it count
    as repeated keys).
    """

    columns: list[str]
    source: str
    reason: str


def choose_key(df: DataFrame, max_columns: int = 4) -> KeyChoice:
    """The best single column as key, else the best smallest composite key, else the first column with a warning."""
    best = discover_keys(df, max_columns=1, exact=False).where("recommended AND is_unique").first()
    if best:
        found = f"{best.uniqueness_ratio:.2%} of the values differ, {best.null_rate:.2%} are null"
        return KeyChoice(list(best["columns"]), "single", found)
    group = smallest_keys(df, max_columns=max_columns, min_columns=2).where("rank = 1").first()
    if group:
        found = f"no column is a key; all rows differ in these {group.n_columns}, {group.null_rate:.2%} hold a null"
        return KeyChoice(list(group["columns"]), "composite", found)
    found = f"no group of up to {max_columns} columns is a key; the first column was taken"
    warnings.warn(f"{found}: {df.columns[0]!r}", stacklevel=3)
    return KeyChoice([df.columns[0]], "fallback", found)


def default_keys(df: DataFrame) -> list[str]:
    """The columns of :func:`choose_key`."""
    return choose_key(df).columns


def compare(df1: DataFrame, df2: DataFrame, spec: CompareSpec | None = None, **options) -> Comparison:
    """Compare two tables; ``options`` are fields of :class:`CompareSpec`."""
    return Comparison(df1, df2, replace(spec or CompareSpec(), **options))


def multi_compare(
    reference: DataFrame, candidates: Mapping[str, DataFrame], spec: CompareSpec | None = None, **options
) -> DataFrame:
    """Counters of independent comparisons of one reference with each candidate, by ``candidate``."""
    spec = replace(spec or CompareSpec(), **options)
    if not spec.keys:
        spec = replace(spec, keys=default_keys(reference))
    rows = [
        compare(reference, df, spec).counts().select(F.lit(name).alias("candidate"), "*")
        for name, df in candidates.items()
    ]
    return reduce(lambda x, y: x.unionByName(y), rows)
