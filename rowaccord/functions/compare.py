"""How two values of one column are compared: the semantic view and the raw view.

Functions take and return Spark SQL expressions as text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from . import parsing, text


@dataclass(frozen=True)
class IgnoreRules:
    """Which differences do not count as a change of meaning.

    Rules touch text values only and never the key columns. ``null_vs_blank`` treats
    a text without any visible character as missing. ``date_formats`` lists the
    layouts that ``date_format`` rewrites to ISO; the first that fits wins.
    """

    case: bool = False
    whitespace: bool = False
    date_format: bool = False
    null_vs_blank: bool = False
    date_formats: tuple[str, ...] = ("yyyy-MM-dd", "MM/dd/yyyy")

    @classmethod
    def from_dict(cls, rules: dict | None, ignore_case: bool = False, ignore_whitespace: bool = False) -> IgnoreRules:
        """The rule dictionary wins over the two flat flags; missing case/whitespace entries fall back to them."""
        if not rules:
            return cls(case=ignore_case, whitespace=ignore_whitespace)
        return cls(
            case=bool(rules.get("ignore_case", ignore_case)),
            whitespace=bool(rules.get("ignore_whitespace", ignore_whitespace)),
            null_vs_blank=bool(rules.get("ignore_null_vs_blank", False)),
            date_format=bool(rules.get("normalize_dates", False)),
        )

    @property
    def any(self) -> bool:
        return self.case or self.whitespace or self.date_format or self.null_vs_blank


def normalize_text(c: str, rules: IgnoreRules) -> str:
    """A text value after the active ignore rules."""
    if rules.whitespace:
        c = text.strip(c)
    if rules.null_vs_blank:
        c = f"(CASE WHEN {text.strip(c)} <> '' THEN {c} END)"
    if rules.date_format:
        c = parsing.iso_date_text(c, rules.date_formats)
    if rules.case:
        c = f"lower({c})"
    return c


def only_exact_text(t1: T.DataType, t2: T.DataType) -> bool:
    """Whether no type holds all values of both: a double cannot tell large bigints apart, see ``text.exact_number``."""
    return any(isinstance(x, T.LongType) and text.is_float(y) for x, y in ((t1, t2), (t2, t1)))


def key_text(c: str, t: T.DataType, other: T.DataType) -> str:
    """Text of a key whose columns have no common type."""
    return text.exact_number(c, t) if only_exact_text(t, other) else text.render(c, t)


def common_type(t1: T.DataType, t2: T.DataType) -> T.DataType | None:
    """The type in which two columns compare natively; None means compare their text."""
    if t1 == t2:
        return t1
    if only_exact_text(t1, t2):
        return None
    if isinstance(t1, T.NumericType) and isinstance(t2, T.NumericType):
        if text.is_float(t1) or text.is_float(t2):
            return T.DoubleType()
        if text.is_integral(t1) and text.is_integral(t2):
            return T.LongType()
        scale = max(t.scale for t in (t1, t2) if isinstance(t, T.DecimalType))
        return T.DecimalType(38, scale) if scale <= 18 else T.DoubleType()
    return None


# Outcome of one column in one matched row.
SAME, FORMATTING, CHANGED, NULL_INTRODUCED, NULL_RESOLVED = range(5)


@dataclass(frozen=True)
class ComparedColumn:
    name: str
    type_1: T.DataType
    type_2: T.DataType
    rules: IgnoreRules = field(default_factory=IgnoreRules)

    @property
    def _native(self) -> T.DataType | None:
        t = common_type(self.type_1, self.type_2)
        return None if t is None or text.is_text(t) else t

    def semantic(self, c1: str, c2: str) -> tuple[str, str]:
        """Both values in comparable form, after the ignore rules."""
        if only_exact_text(self.type_1, self.type_2):
            return text.exact_number(c1, self.type_1), text.exact_number(c2, self.type_2)
        native = self._native
        if native is None:
            return (
                normalize_text(text.render(c1, self.type_1), self.rules),
                normalize_text(text.render(c2, self.type_2), self.rules),
            )
        if isinstance(native, T.MapType):
            return text.sorted_entries(c1), text.sorted_entries(c2)
        if isinstance(native, (T.BinaryType, T.DayTimeIntervalType, T.YearMonthIntervalType)):
            raise TypeError(f"column {self.name!r}: type {native.simpleString()} cannot be compared")
        name = native.simpleString()
        return (
            c1 if self.type_1 == native else f"CAST({c1} AS {name})",
            c2 if self.type_2 == native else f"CAST({c2} AS {name})",
        )

    def semantic_text(self, c1: str, c2: str) -> tuple[str, str]:
        """Text that is equal exactly when the semantic values are equal."""
        native = self._native
        s1, s2 = self.semantic(c1, c2)
        if native is None:
            return s1, s2
        if text.is_float(native):
            s1, s2 = f"({s1} + 0.0D)", f"({s2} + 0.0D)"  # -0.0 and 0.0 are one value
        if isinstance(native, T.MapType):
            return f"to_json({s1})", f"to_json({s2})"
        return text.render(s1, native), text.render(s2, native)

    def raw_text(self, c1: str, c2: str) -> tuple[str, str]:
        return text.render(c1, self.type_1), text.render(c2, self.type_2)

    def raw_residue(self, c1: str, c2: str) -> tuple[str, str]:
        """What the raw text adds to the semantic text; null where it adds nothing."""
        nothing = "CAST(NULL AS STRING)"
        same_type = self.type_1 == self.type_2
        if same_type and text.is_float(self.type_1):
            return f"CASE WHEN {c1} = 0 THEN CAST({c1} AS STRING) END", f"CASE WHEN {c2} = 0 THEN CAST({c2} AS STRING) END"
        if same_type and not (text.is_text(self.type_1) and self.rules.any):
            return nothing, nothing
        return self.raw_text(c1, c2)

    def _raw_differs(self, c1: str, c2: str) -> str:
        """Whether the raw texts differ, given that the semantic values do not."""
        if self.type_1 == self.type_2:
            if text.is_float(self.type_1):
                # Equal floats have equal text, but for the sign of zero.
                return f"coalesce({c1} = 0 AND CAST({c1} AS STRING) <> CAST({c2} AS STRING), false)"
            if not (text.is_text(self.type_1) and self.rules.any):
                return "false"
        r1, r2 = self.raw_text(c1, c2)
        return f"NOT ({r1} <=> {r2})"

    def outcome(self, c1: str, c2: str) -> str:
        """One small code per matched row: everything the counters need."""
        s1, s2 = self.semantic(c1, c2)
        return (
            f"CAST(CASE WHEN NOT ({s1} <=> {s2}) THEN "
            f"CASE WHEN {s2} IS NULL THEN {NULL_INTRODUCED} WHEN {s1} IS NULL THEN {NULL_RESOLVED} ELSE {CHANGED} END "
            f"WHEN {self._raw_differs(c1, c2)} THEN {FORMATTING} ELSE {SAME} END AS TINYINT)"
        )
