"""Which texts read as integer, float, boolean, date or datetime.

Every test is a guarded built-in expression: the pattern decides the shape, the lenient cast
decides the range, so nothing depends on how generous a cast is. Functions take and return
Spark SQL expressions as text.
"""

from __future__ import annotations

from .names import in_list, lit

INTEGER_PATTERN = r"^[+-]?[0-9]+\z"
FLOAT_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"

# The shapes of date texts (9 for any digit) by order of their parts, and the
# shapes of a time that may follow. Slashed dates with the year last can be read both ways.
DATE_SHAPES = {
    "ymd": ("9999-99-99", "9999/99/99"),
    "mdy": ("99/99/9999",),
    "dmy": ("99/99/9999", "99-99-9999", "99.99.9999"),
}
TIME_SHAPES = (" 99:99:99", "T99:99:99", " 99:99")
_DATE_LENGTH = 10
# Places of year, month and day (from 1) in a text of each order.
_PLACES = {"ymd": (1, 6, 9), "mdy": (7, 1, 4), "dmy": (7, 4, 1)}
_LENGTHS = sorted({_DATE_LENGTH, *(_DATE_LENGTH + len(t) for t in TIME_SHAPES)})


def is_integer(c: str) -> str:
    return f"({c} RLIKE {lit(INTEGER_PATTERN)} AND try_cast({c} AS BIGINT) IS NOT NULL)"


def is_float(c: str) -> str:
    return f"({c} RLIKE {lit(FLOAT_PATTERN)} AND try_cast({c} AS DOUBLE) IS NOT NULL)"


def is_boolean(c: str) -> str:
    return f"(char_length({c}) <= 5 AND lower({c}) IN ('true', 'false'))"


def shape_of(c: str) -> str:
    """The text with every digit as 9."""
    return f"translate({c}, '0123456789', '9999999999')"


def _iso_day(c: str, order: str) -> str:
    year, month, day = _PLACES[order]
    return f"concat(substr({c}, {year}, 4), '-', substr({c}, {month}, 2), '-', substr({c}, {day}, 2))"


def date_reading(c: str) -> str:
    """How a text reads as a date: per order of parts the date shape it has, and the kind.

    A struct ``kind, ymd, mdy, dmy``: ``kind`` is ``date`` or ``datetime``, null for texts that
    are neither; an order is null unless the text is a real calendar day in that order. One
    struct per value serves all date counters, without a regular expression per layout.
    """
    shape = shape_of(f"substr({c}, 1, {_DATE_LENGTH})")
    time = f"substr({c}, {_DATE_LENGTH + 1}, 9)"
    kind = (
        f"CASE WHEN char_length({c}) = {_DATE_LENGTH} THEN 'date' "
        f"WHEN {shape_of(time)} IN {in_list(TIME_SHAPES)} AND substr({time}, 2, 2) < '24' "
        f"AND substr({time}, 5, 2) < '60' AND substr({time}, 8, 2) < '60' THEN 'datetime' END"
    )
    fields = [f"'kind', {kind}"]
    for order, shapes in DATE_SHAPES.items():
        real = f"try_cast({_iso_day(c, order)} AS DATE) IS NOT NULL"
        fields.append(f"'{order}', CASE WHEN {shape} IN {in_list(shapes)} AND {real} THEN {shape} END")
    lengths = ", ".join(str(n) for n in _LENGTHS)
    return f"CASE WHEN char_length({c}) IN ({lengths}) THEN named_struct({', '.join(fields)}) END"


def date_layouts(reading: str, kind: str) -> list[str]:
    """One test per date layout: the reading is of this kind and in this layout."""
    return [
        f"({reading}.kind = '{kind}' AND {reading}.{order} = {lit(shape)})"
        for order, shapes in DATE_SHAPES.items()
        for shape in shapes
    ]


def _layout_shape(fmt: str) -> str:
    return "".join("9" if ch in "yMdHms" else ch for ch in fmt if ch != "'")


def iso_date_text(c: str, formats: tuple[str, ...]) -> str:
    """Rewrite a text in any of the given layouts to ISO 8601; other texts stay as they are.

    The first layout that fits wins, which is how the caller settles the ambiguity
    between day-first and month-first dates.
    """
    options = []
    for fmt in formats:
        out = "yyyy-MM-dd HH:mm:ss" if "H" in fmt else "yyyy-MM-dd"
        shape = _layout_shape(fmt)
        fits = f"char_length({c}) = {len(shape)} AND {shape_of(c)} = {lit(shape)}"
        options.append(f"CASE WHEN {fits} THEN date_format(try_to_timestamp({c}, {lit(fmt)}), '{out}') END")
    return f"coalesce({', '.join(options)}, {c})"
