"""Row-level comparison of two tables matched by key.

One full outer join carries one copy of every compared value; the semantic and the raw
view are computed after it. How the join is laid out follows from the key scan:

* keys that occur at most once on one side go through a shuffled join on the key, whose
  result is linear in the input;
* rows with a null in the key match nothing and skip the join;
* a key with very many rows on one side is taken out of that shuffle, by a broadcast list of
  such keys with a proven length, and joined over salted partitions;
* a key that repeats on both sides would give the product of its rows. At every size it is
  given as its distinct row contents: pairs are counted exactly from value histograms, and
  each listed row says how many join rows it stands for, so listings and counters add up.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compare import (
    CHANGED,
    FORMATTING,
    NULL_INTRODUCED,
    NULL_RESOLVED,
    SAME,
    ComparedColumn,
    IgnoreRules,
)
from ..functions.names import col, lit, require_distinct_names
from ..functions.storage import written
from .keys import KeyCheck, any_null, check_keys, counter, key_columns, key_names, none_null, rows_per_key
from .schema import apply_column_map

# Confidence of a comparison without and with unmatched rows.
CONFIDENCE_MATCHED = 0.95
CONFIDENCE_UNMATCHED = 0.80

SAMPLE_ROWS = 200

# A key with more rows than this leaves the shuffled join. The second number bounds how
# many such keys there can be, and with it the length of the broadcast list of keys. Both
# choose a plan only; results are the same on either way.
HOT_KEY_ROWS = 100_000
MOST_HOT_KEYS = 20_000
MOST_SALTS = 1024

# Rows of both sides by which the tasks that count repeated keys are dealt: their memory does not grow with the tables.
ROWS_PER_TASK = 200_000

# Compared columns from which counters go through a long form: one aggregate with four counters
# per column would outgrow the JVM's compiled methods.
WIDE_COLUMNS = 40


@dataclass(frozen=True)
class DiffSpec:
    """What to compare: keys, rules, names of table 2 mapped to table 1, column subset."""

    keys: Sequence[str]
    rules: IgnoreRules = field(default_factory=IgnoreRules)
    column_map: Sequence[Mapping[str, str]] | Mapping[str, str] | None = None
    compare_columns: Sequence[str] | None = None
    hot_key_rows: int = HOT_KEY_ROWS


class Diff:
    """A planned comparison. Every method returns a lazy DataFrame.

    Building it runs one job, the key scan, whose counters choose the plan.
    """

    def __init__(self, df1: DataFrame, df2: DataFrame, spec: DiffSpec, check: KeyCheck | None = None):
        df2 = apply_column_map(df2, spec.column_map)
        require_distinct_names(df1)
        require_distinct_names(df2)
        if not spec.keys:
            raise ValueError("at least one key column is needed")
        self.spec = spec
        self.df1, self.df2 = df1, df2
        self.check = check or check_keys(df1, df2, spec.keys)
        self.columns = self._compared_columns()
        self.keys = key_names(len(spec.keys))
        self._stored: DataFrame | None = None

    def _compared_columns(self) -> list[ComparedColumn]:
        in_2 = set(self.df2.columns)
        names = [c for c in self.df1.columns if c in in_2 and c not in set(self.spec.keys)]
        if self.spec.compare_columns:
            unknown = sorted(set(self.spec.compare_columns) - {*names, *self.spec.keys})
            if unknown:
                raise ValueError(f"compare_columns that the tables do not share: {unknown}")
            names = [c for c in names if c in set(self.spec.compare_columns)]
        return [
            ComparedColumn(n, self.df1.schema[n].dataType, self.df2.schema[n].dataType, self.spec.rules)
            for n in names
        ]

    # ---- the two sides and their join -------------------------------------------------

    @cached_property
    def _sides(self) -> tuple[DataFrame, DataFrame]:
        """``_k*, _a, _a0…`` and ``_k*, _b, _b0…``; generated names cannot meet a user's."""
        left, right = key_columns(self.df1, self.df2, self.spec.keys)
        values = [c.name for c in self.columns]
        one = self.df1.select(
            *left, F.lit(True).alias("_a"), *[col(n).alias(f"_a{i}") for i, n in enumerate(values)]
        )
        two = self.df2.select(
            *right, F.lit(True).alias("_b"), *[col(n).alias(f"_b{i}") for i, n in enumerate(values)]
        )
        return one, two

    @property
    def _hot_limit(self) -> int:
        """Row count from which a key is hot: at most ``MOST_HOT_KEYS`` keys can pass it."""
        return max(self.spec.hot_key_rows, (self.check.rows_1 + self.check.rows_2) // MOST_HOT_KEYS)

    @property
    def _has_hot_keys(self) -> bool:
        return max(self.check.most_rows_1, self.check.most_rows_2) > self._hot_limit

    @property
    def _has_factored_keys(self) -> bool:
        return self.check.repeated_on_both > 0

    @cached_property
    def _special_keys(self) -> DataFrame:
        """Counts of the hot and the factored keys, written once for all joins that need them."""
        hot = f"greatest(rows_1, rows_2) > {self._hot_limit}"
        factored = "least(rows_1, rows_2) > 1"
        counts = rows_per_key(self.df1, self.df2, self.spec.keys).where(none_null(self.keys))
        special = counts.where(f"{hot} OR {factored}").selectExpr("*", f"{hot} AS hot", f"{factored} AS factored")
        if not (self._has_hot_keys or self._has_factored_keys):
            return special.where(F.lit(False))
        return written(special, "special-keys")

    @property
    def _hot_keys(self) -> DataFrame:
        return self._special_keys.where("hot")

    @property
    def _cool_factored_keys(self) -> DataFrame:
        return self._special_keys.where("factored AND NOT hot")

    def _without_hot(self, side: DataFrame) -> DataFrame:
        if not self._has_hot_keys:
            return side
        return side.join(F.broadcast(self._hot_keys.select(*self.keys)), self.keys, "left_anti")

    def _only_hot(self, side: DataFrame, which: Column) -> DataFrame:
        keys = self._hot_keys.where(which).select(*self.keys)
        return side.join(F.broadcast(keys), self.keys, "left_semi")

    def _salted_join(self, many: DataFrame, few: DataFrame) -> DataFrame:
        """Join hot rows with their single partner rows, each hot key spread over several tasks.

        The salt of a row is the number of the partition it is read in: even, and the same
        again when a lost task is repeated. Small partner tables are broadcast by Spark itself.
        """
        most = max(self.check.most_rows_1, self.check.most_rows_2)
        salts = min(MOST_SALTS, -(-most // self._hot_limit))
        many = many.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        few = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return many.join(few, [*self.keys, "_salt"], "inner").drop("_salt")

    @cached_property
    def _joined(self) -> DataFrame:
        """``_k*, _a, _b, _a*, _b*`` of all join rows, but for the factored keys."""
        one, two = self._sides
        parts: list[DataFrame] = []
        if self.check.null_rows_1:
            parts.append(one.where(any_null(self.keys)))
            one = one.where(none_null(self.keys))
        if self.check.null_rows_2:
            parts.append(two.where(any_null(self.keys)))
            two = two.where(none_null(self.keys))

        cool_1, cool_2 = self._without_hot(one), self._without_hot(two)
        if self._has_factored_keys:
            # A long list of keys is joined on the hash partitioning of the join that follows.
            factored = self._cool_factored_keys.select(*self.keys)
            cool_1 = cool_1.join(factored, self.keys, "left_anti")
            cool_2 = cool_2.join(factored, self.keys, "left_anti")
        parts.insert(0, cool_1.join(cool_2, self.keys, "full"))

        if self._has_hot_keys:
            n1, n2 = F.col("rows_1"), F.col("rows_2")
            # No partner at all: nothing to join.
            parts.append(self._only_hot(one, n2 == 0))
            parts.append(self._only_hot(two, n1 == 0))
            # One partner row: it is repeated for every salt, the many rows go to one salt each.
            many_1, many_2 = (n2 == 1) & (n1 >= 1), (n1 == 1) & (n2 > 1)
            parts.append(self._salted_join(self._only_hot(one, many_1), self._only_hot(two, many_1)))
            parts.append(self._salted_join(self._only_hot(two, many_2), self._only_hot(one, many_2)))
        return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)

    @cached_property
    def _coded(self) -> DataFrame:
        """Join rows with ``change_type`` and one outcome code ``_c*`` per compared column, factored keys left out."""
        if self._stored is not None:
            return self._stored.where("_n IS NULL")
        n = range(len(self.columns))
        codes = [
            F.expr(
                f"CASE WHEN _a AND _b THEN {c.outcome(f'_a{i}', f'_b{i}')} ELSE CAST({SAME} AS TINYINT) END"
            ).alias(f"_c{i}")
            for i, c in enumerate(self.columns)
        ]
        worst = ", ".join([f"_c{i}" for i in n] + [str(SAME), str(SAME)])
        change_type = F.expr(
            "CASE WHEN _a IS NULL THEN 'added' WHEN _b IS NULL THEN 'removed' "
            f"WHEN greatest({worst}) >= {CHANGED} THEN 'modified' "
            f"WHEN greatest({worst}) = {FORMATTING} THEN 'formatting_only' ELSE 'unchanged' END"
        )
        values = [f"_{s}{i}" for s in "ab" for i in n]
        return self._joined.select(*self.keys, *values, "_a", "_b", *codes).withColumn("change_type", change_type)

    # ---- counters ---------------------------------------------------------------------

    @property
    def is_full_count(self) -> bool:
        """False when a repeated key makes the counters count join rows instead of table rows."""
        return self.check.unique

    def _counter_row(self, per_column: bool = True) -> DataFrame:
        """One row: counters per change type and, per column, of each outcome."""
        kinds = ("added", "removed", "modified", "formatting_only")
        if per_column and len(self.columns) > WIDE_COLUMNS:
            counters = self._wide_counter_row(kinds)
        else:
            aggs = [F.expr(f"count_if(change_type = '{k}')").alias(k) for k in kinds]
            for i in range(len(self.columns) if per_column else 0):
                aggs += [
                    F.expr(f"count_if(_c{i} >= {CHANGED})").alias(f"_m{i}"),
                    F.expr(f"count_if(_c{i} = {FORMATTING})").alias(f"_f{i}"),
                    F.expr(f"count_if(_c{i} = {NULL_INTRODUCED})").alias(f"_i{i}"),
                    F.expr(f"count_if(_c{i} = {NULL_RESOLVED})").alias(f"_r{i}"),
                ]
            counters = self._coded.agg(*aggs)
        if not self._has_factored_keys:
            return counters
        both = counters.unionByName(self._factored_counter_row(per_column))
        wide = self.check.join_rows > 2**63 - 1
        total = [F.sum(c).cast("decimal(38,0)" if wide else "bigint").alias(c) for c in counters.columns]
        return both.agg(*total)

    def _wide_counter_row(self, kinds: Sequence[str]) -> DataFrame:
        """The same row for wide tables: only changed cells are counted, by column and outcome.

        Cells are (position, code); position −1 holds the number of the change type.
        """
        slots = NULL_RESOLVED + 1
        kind = " ".join(f"WHEN '{k}' THEN {n}" for n, k in enumerate(kinds, 1))
        codes = ", ".join(f"_c{i}" for i in range(len(self.columns)))
        cells = (
            f"concat(array(struct(-1 AS at, CASE change_type {kind} ELSE 0 END AS code)), "
            f"transform(array({codes}), (c, i) -> struct(i AS at, int(c) AS code)))"
        )
        tally = (
            self._coded.selectExpr(f"inline(filter({cells}, x -> x.code > 0))")
            .groupBy("at", "code")
            .agg(F.expr("count(1)").alias("n"))
            # At most four counters per column.
            .groupBy()
            .agg(F.expr(f"map_from_entries(collect_list(struct(at * {slots} + code, n)))").alias("n"))
        )

        def count(at: int, *codes: int) -> str:
            return " + ".join(f"coalesce(try_element_at(n, {at * slots + c}), 0L)" for c in codes)

        outputs = [f"{count(-1, n)} AS {k}" for n, k in enumerate(kinds, 1)]
        for i in range(len(self.columns)):
            outputs += [
                f"{count(i, CHANGED, NULL_INTRODUCED, NULL_RESOLVED)} AS _m{i}",
                f"{count(i, FORMATTING)} AS _f{i}",
                f"{count(i, NULL_INTRODUCED)} AS _i{i}",
                f"{count(i, NULL_RESOLVED)} AS _r{i}",
            ]
        return tally.selectExpr(*outputs)

    def _counts_of(self) -> list[Column]:
        changed = F.col("added") + F.col("removed") + F.col("modified") + F.col("formatting_only")
        confidence = F.when(F.col("added") + F.col("removed") == 0, F.lit(CONFIDENCE_MATCHED)).otherwise(
            F.lit(CONFIDENCE_UNMATCHED)
        )
        return [
            F.lit(self.check.rows_1).cast("bigint").alias("total_rows_f1"),
            F.lit(self.check.rows_2).cast("bigint").alias("total_rows_f2"),
            counter(self.check.join_rows).alias("rows_scanned"),
            F.col("added").alias("added_rows"),
            F.col("removed").alias("removed_rows"),
            F.col("modified").alias("modified_rows"),
            F.col("formatting_only").alias("formatting_only_rows"),
            (counter(self.check.join_rows) - changed).alias("unchanged_rows"),
            confidence.alias("confidence_score"),
            F.lit(self.is_full_count).alias("is_full_count"),
        ]

    def _column_stats_of(self) -> Column:
        base = f"{max(self.check.rows_1, 1)}D"
        entries = [
            f"named_struct('column', {lit(c.name)}, 'position', {i}, 'modified', _m{i}, 'formatting_only', _f{i}, "
            f"'null_introduced', _i{i}, 'null_resolved', _r{i}, 'change_rate', (_m{i} + _f{i}) / {base})"
            for i, c in enumerate(self.columns)
        ]
        return F.expr(f"array({', '.join(entries)})")

    def counts(self) -> DataFrame:
        """One row of totals, counters per change type, confidence and scope flag."""
        return self._counter_row(per_column=False).select(*self._counts_of())

    def column_stats(self) -> DataFrame:
        """One row per compared column: counters over matched rows and the change rate."""
        if not self.columns:
            return self.df1.sparkSession.createDataFrame(
                [],
                "column string, position int, modified bigint, formatting_only bigint, "
                "null_introduced bigint, null_resolved bigint, change_rate double",
            )
        return self._counter_row().select(F.inline(self._column_stats_of()))

    def statistics(self) -> DataFrame:
        """The row of :meth:`counts` with the column statistics as one array: a single pass for both."""
        stats = self._column_stats_of() if self.columns else F.array()
        return self._counter_row().select(*self._counts_of(), stats.alias("column_stats"))

    # ---- row outputs ------------------------------------------------------------------

    def _key_output(self) -> list[Column]:
        return [F.col(n).alias(k) for n, k in zip(self.keys, self.spec.keys)]

    def _names_where(self, test: str) -> Column:
        """Names of the compared columns whose outcome code passes a test such as ``>= 2``."""
        hits = [f"CASE WHEN _c{i} {test} THEN {lit(c.name)} END" for i, c in enumerate(self.columns)]
        return F.expr(f"array_compact(array({', '.join(hits)}))" if hits else "cast(array() as array<string>)")

    def _raw(self, i: int) -> tuple[str, str]:
        return self.columns[i].raw_text(f"_a{i}", f"_b{i}")

    def _raw_outputs(self, label_1: str, label_2: str, interleaved: bool) -> list[Column]:
        first = [F.expr(self._raw(i)[0]).alias(c.name + label_1) for i, c in enumerate(self.columns)]
        second = [F.expr(self._raw(i)[1]).alias(c.name + label_2) for i, c in enumerate(self.columns)]
        if not interleaved:
            return first + second
        return [x for pair in zip(first, second) for x in pair]

    @cached_property
    def _listed(self) -> DataFrame:
        """Rows of all listings: join rows, and the contents of factored keys with ``_n`` join rows each."""
        if self._stored is not None:
            return self._stored
        plain = self._coded.withColumn("_n", F.lit(None).cast("decimal(38,0)"))
        return reduce(DataFrame.unionByName, [plain, *[self._factored_rows(hot) for hot in self._factored_parts]]) if self._has_factored_keys else plain

    def _join_rows(self, name: str) -> Column:
        return F.coalesce("_n", F.lit(1).cast("decimal(38,0)")).alias(name)

    def classified(self) -> DataFrame:
        """Keys, ``change_type`` and ``join_rows`` of everything that was matched, added or removed.

        A row stands for ``join_rows`` rows of the full outer join. That is 1, but for keys that
        repeat on both sides: these come as distinct contents. A content of table 1 has up to one
        row per change type, for its pairs with the rows of table 2. A content that only table 2
        has comes with 0 join rows, since its pairs are counted where they start.
        """
        listed = self._listed
        if self._has_factored_keys and self._stored is None:
            # Nothing but the numbers of pairs is asked of factored keys: no values, no outcomes of columns.
            plain = self._coded.select(*self.keys, "change_type", F.lit(None).cast("decimal(38,0)").alias("_n"))
            listed = reduce(DataFrame.unionByName, [plain, *[self._factored_rows(hot, kinds=True) for hot in self._factored_parts]])
        return listed.select(*self._key_output(), "change_type", self._join_rows("join_rows"))

    def _changed(self) -> DataFrame:
        return self._listed.where(F.col("change_type") != "unchanged")

    def _check_output(self, df: DataFrame) -> DataFrame:
        require_distinct_names(df)
        return df

    def changes(self) -> DataFrame:
        """All changed rows: keys, ``_change_type``, lists of changed columns, raw values of both sides.

        ``changed`` names the columns with a semantic change, ``changed_raw`` those that
        differ in formatting only; values are kept for added and removed rows too. Contents of
        keys that repeat on both sides (see :meth:`classified`) have the values of their own side;
        their lists name the columns in which any partner differs. ``_join_rows`` comes last.
        """
        return self._check_output(
            self._changed().select(
                *self._key_output(),
                F.col("change_type").alias("_change_type"),
                self._names_where(f">= {CHANGED}").alias("changed"),
                self._names_where(f"= {FORMATTING}").alias("changed_raw"),
                *self._raw_outputs("_f1", "_f2", interleaved=False),
                self._join_rows("_join_rows"),
            )
        )

    def before_after(self) -> DataFrame:
        """All changed rows with ``{c}_before`` and ``{c}_after`` side by side."""
        return self._check_output(
            self._changed().select(
                *self._key_output(),
                "change_type",
                *self._raw_outputs("_before", "_after", interleaved=True),
                self._names_where(f">= {CHANGED}").alias("changed"),
                self._join_rows("_join_rows"),
            )
        )

    def sample(self, rows: int = SAMPLE_ROWS) -> DataFrame:
        """The display sample: the ``rows`` changed rows with the highest severity, then smallest keys."""
        key_text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("None")) for k in self.keys])

        def values(side: int) -> Column:
            nothing = "cast(map() as map<string,string>)"
            pairs = [f"{lit(c.name)}, coalesce({self._raw(i)[side]}, '')" for i, c in enumerate(self.columns)]
            if not pairs:
                return F.expr(nothing)
            return F.expr(f"CASE WHEN _{'ab'[side]} THEN map({', '.join(pairs)}) ELSE {nothing} END")

        severity = F.when(F.col("change_type").isin("added", "removed"), F.lit(1.0)).otherwise(F.lit(0.5))
        top = (
            self._changed()
            .withColumn("severity", severity)
            .orderBy(F.desc("severity"), *[F.asc(k) for k in self.keys], "change_type")
            .limit(rows)
        )
        return top.select(
            *self._key_output(),
            key_text.alias("key"),
            "change_type",
            "severity",
            self._names_where(f">= {CHANGED}").alias("columns_changed"),
            values(0).alias("f1"),
            values(1).alias("f2"),
            self._join_rows("join_rows"),
        )

    def stored(self, path: str, mode: str = "errorifexists") -> Diff:
        """Write the changed rows once and return a Diff that reads them back.

        Counters, statistics, samples and exports then share one run of the join;
        unchanged rows need no storage because the key scan already knows how many
        join rows there are.
        """
        self._changed().write.mode(mode).parquet(path)
        return self.read_stored(path)

    def read_stored(self, path: str) -> Diff:
        """The same Diff on changed rows that :meth:`stored` has written, here or in an earlier session."""
        copy = Diff(self.df1, self.df2, replace(self.spec, column_map=None), self.check)
        copy._stored = self.df1.sparkSession.read.parquet(path)
        if "_special_keys" in self.__dict__:
            copy._special_keys = self._special_keys
        return copy

    # ---- factored keys ----------------------------------------------------------------

    def _factored_sides(self, hot: bool) -> tuple[DataFrame, DataFrame]:
        """Rows of both sides whose key repeats on both, of the hot keys or of all others.

        Those of other keys are dealt by key, so all counts of a key are made in one task without another shuffle.
        Their copies hardly meet before a shuffle, and a map of them would grow with the task's part of the table.
        """
        one, two = (side.where(none_null(self.keys)) for side in self._sides)
        if hot:
            return self._only_hot(one, F.col("factored")), self._only_hot(two, F.col("factored"))
        keys = self._cool_factored_keys.select(*self.keys)
        tasks = 1 + (self.check.rows_1 + self.check.rows_2) // ROWS_PER_TASK
        one, two = (self._without_hot(side).join(keys, self.keys, "left_semi").repartition(tasks, *self.keys) for side in (one, two))
        return one, two

    @property
    def _factored_parts(self) -> list[bool]:
        """Whether the keys are hot, of each part of the factored keys: no key is in both parts."""
        return [False, True] if self._has_hot_keys else [False]

    def _texts(self, side: int, full_raw: bool) -> tuple[list[str], list[str]]:
        """Semantic and raw texts of the compared columns of one side.

        The other operand only fixes the common type, so a typed null stands in for it.
        Without ``full_raw`` the raw text is left out where the semantic text determines it.
        """
        semantic, raw = [], []
        for i, c in enumerate(self.columns):
            other = (c.type_2 if side == 0 else c.type_1).simpleString()
            pair = [f"CAST(NULL AS {other})"] * 2
            pair[side] = f"_{'ab'[side]}{i}"
            semantic.append(c.semantic_text(*pair)[side])
            raw.append((c.raw_text(*pair) if full_raw else c.raw_residue(*pair))[side])
        return semantic, raw

    def _contents(self, per_column: bool, hot: bool, full_raw: bool = False) -> DataFrame:
        """``_k*, item, sem, raw, n1, n2``: copies of each distinct content of a part of the factored keys.

        ``item`` −1 stands for the whole row; with ``per_column`` each column is an item too.
        """

        def items(df: DataFrame, side: int) -> DataFrame:
            semantic, raw = self._texts(side, full_raw)

            def item(number: int, sem: list[str], rest: list[str]) -> str:
                sem_texts, raw_texts = (f"cast(array({', '.join(x)}) as array<string>)" for x in (sem, rest))
                return f"named_struct('item', {number}, 'sem', {sem_texts}, 'raw', {raw_texts})"

            entries = [item(-1, semantic, raw)]
            if per_column:
                entries += [item(i, [s], [r]) for i, (s, r) in enumerate(zip(semantic, raw))]
            return df.select(*self.keys, F.expr(f"inline(array({', '.join(entries)}))"), F.lit(side == 0).alias("_first"))

        one, two = self._factored_sides(hot)
        return (
            items(one, 0)
            .unionAll(items(two, 1))
            .groupBy(*self.keys, "item", "sem", "raw")
            .agg(F.count_if("_first").alias("n1"), F.count_if(~F.col("_first")).alias("n2"))
        )

    def _factored_counter_row(self, per_column: bool) -> DataFrame:
        """Counters of the join rows of factored keys, from products of copy counts.

        With N1, N2 copies of a key, N1·N2 join rows exist; the equal ones are the sum
        of n1·n2 over its contents, so no pair has to be formed.
        """

        def big(name: str) -> Column:
            return F.col(name).cast("decimal(19,0)")

        def total(c: Column, name: str) -> Column:
            return F.sum(c).cast("decimal(38,0)").alias(name)

        known = F.element_at("sem", 1).isNotNull()

        def keyed(hot: bool) -> DataFrame:
            per_meaning = (
                self._contents(per_column, hot)
                .groupBy(*self.keys, "item", "sem")
                .agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2"), total(big("n1") * big("n2"), "same"))
            )
            return per_meaning.groupBy(*self.keys, "item").agg(
                F.sum("n1").alias("n1"),
                F.sum("n2").alias("n2"),
                total(big("n1") * big("n2"), "equal"),
                total(F.col("same"), "same"),
                F.sum(F.when((F.col("item") >= 0) & known, F.col("n1")).otherwise(0)).alias("known1"),
                F.sum(F.when((F.col("item") >= 0) & known, F.col("n2")).otherwise(0)).alias("known2"),
            )

        per_key = reduce(DataFrame.unionAll, [keyed(hot) for hot in self._factored_parts])
        nulls_1, nulls_2 = big("n1") - big("known1"), big("n2") - big("known2")
        per_item = per_key.groupBy("item").agg(
            total(big("n1") * big("n2") - F.col("equal"), "m"),
            total(F.col("equal") - F.col("same"), "f"),
            total(big("known1") * nulls_2, "i"),
            total(nulls_1 * big("known2"), "r"),
        )

        def of(item: int, name: str) -> Column:
            return F.coalesce(F.sum(F.when(F.col("item") == item, F.col(name))), F.lit(0)).cast("decimal(38,0)")

        aggs = [F.lit(0).cast("decimal(38,0)").alias(k) for k in ("added", "removed")]
        aggs += [of(-1, "m").alias("modified"), of(-1, "f").alias("formatting_only")]
        for i in range(len(self.columns) if per_column else 0):
            aggs += [of(i, x).alias(f"_{x}{i}") for x in "mfir"]
        return per_item.agg(*aggs)

    def _factored_rows(self, hot: bool, kinds: bool = False) -> DataFrame:
        """The contents of a part of the factored keys in the shape of ``_coded``, with ``_n`` join rows each.

        With ``kinds`` only the keys, ``change_type`` and ``_n``.

        Whether any partner differs in a column follows from the least and the greatest digest
        of that column among the partners, so no pair is formed here either.
        """
        n = range(0 if kinds else len(self.columns))

        def side(df: DataFrame, number: int) -> DataFrame:
            semantic, raw = self._texts(number, full_raw=not kinds)
            texts = [f"cast(array({', '.join(x)}) as array<string>) AS {name}" for x, name in ((semantic, "sem"), (raw, "raw"))]
            own, other = "ab"[number], "ba"[number]
            types = [(c.type_2 if number == 0 else c.type_1).simpleString() for c in self.columns]
            nothing = [f"CAST(NULL AS {types[i]}) AS _{other}{i}" for i in n]
            return df.selectExpr(*self.keys, *texts, f"{number == 0} AS _first", *[f"_{own}{i}" for i in n], *nothing)

        one, two = self._factored_sides(hot)
        contents = (
            side(one, 0)
            .unionByName(side(two, 1))
            .groupBy(*self.keys, "sem", "raw")
            .agg(
                F.count_if("_first").alias("n1"),
                F.count_if(~F.col("_first")).alias("n2"),
                *[F.any_value(f"_{s}{i}", True).alias(f"_{s}{i}") for s in "ab" for i in n],
            )
        )

        def digest(name: str, i: int) -> str:
            return f"coalesce(md5({name}[{i}]), '')"

        def extremes(value: str, prefix: str) -> dict[str, str]:
            return {
                f"{prefix}_{f}{s}_{i}": f"{f}(CASE WHEN n{s} > 0 THEN {value.format(i=i)} END)"
                for i in n
                for s in (1, 2)
                for f in ("min", "max")
            }

        both = "named_struct('s', coalesce(md5(sem[{i}]), ''), 'r', coalesce(md5(raw[{i}]), ''))"
        of_key = {"all1": "sum(n1)", "all2": "sum(n2)"} | extremes(both, "k")
        of_meaning = {"eq1": "sum(n1)", "eq2": "sum(n2)"} | extremes("coalesce(md5(raw[{i}]), '')", "m")
        if hot:
            # The contents of a hot key stay spread: its one row of extremes goes to every salt.
            per_key = contents.groupBy(*self.keys).agg(*[F.expr(x).alias(c) for c, x in of_key.items()])
            per_meaning = contents.groupBy(*self.keys, "sem").agg(*[F.expr(x).alias(c) for c, x in of_meaning.items()])
            rows = self._salted_join(contents.join(per_meaning, [*self.keys, "sem"]), per_key)
        else:
            # All rows of another key are in one task already.
            rows = contents
            for names, own in ((of_meaning, [*self.keys, "sem"]), (of_key, self.keys)):
                rows = rows.select("*", *[F.expr(x).over(Window.partitionBy(*own)).alias(c) for c, x in names.items()])

        def codes(s: int, kind: str) -> str:
            """Outcome codes against the partners on side ``s``."""
            found = []
            for i in n:
                sem, raw = digest("sem", i), digest("raw", i)
                if kind == "modified":
                    lo, hi = f"k_min{s}_{i}", f"k_max{s}_{i}"
                    found.append(
                        f"CASE WHEN {lo}.s <> {sem} OR {hi}.s <> {sem} THEN {CHANGED} "
                        f"WHEN {lo}.r <> {raw} OR {hi}.r <> {raw} THEN {FORMATTING} ELSE {SAME} END"
                    )
                elif kind == "formatting_only":
                    found.append(
                        f"CASE WHEN m_min{s}_{i} <> {raw} OR m_max{s}_{i} <> {raw} THEN {FORMATTING} ELSE {SAME} END"
                    )
                else:
                    found.append(str(SAME))
            return f"cast(array({', '.join(found)}) as array<tinyint>)"

        def pairs(count: str) -> str:
            return f"cast(cast(n1 AS decimal(19,0)) * cast({count} AS decimal(19,0)) AS decimal(38,0))"

        def entry(kind: str, count: str, when: str, s: int) -> str:
            return (
                f"CASE WHEN {when} THEN named_struct('change_type', '{kind}', '_n', {pairs(count)}, "
                f"'codes', {codes(s, kind)}) END"
            )

        entries = [
            entry("unchanged", "n2", "n1 > 0 AND n2 > 0", 2),
            entry("formatting_only", "(eq2 - n2)", "n1 > 0 AND eq2 > n2", 2),
            entry("modified", "(all2 - eq2)", "n1 > 0 AND all2 > eq2", 2),
            entry("modified", "0", "n1 = 0 AND all1 > eq1", 1),
            entry("formatting_only", "0", "n1 = 0 AND all1 = eq1", 1),
        ]
        listed = rows.select("*", F.expr(f"inline(array_compact(array({', '.join(entries)})))"))
        if kinds:
            return listed.select(*self.keys, "change_type", "_n")
        # Values of table 2 stand beside those of table 1 only where they are the same.
        shown = "(n1 = 0 OR change_type = 'unchanged')"
        values = [f"_a{i}" for i in n] + [f"CASE WHEN {shown} THEN _b{i} END AS _b{i}" for i in n]
        return listed.selectExpr(
            *self.keys, *values, "nullif(n1 > 0, false) AS _a", f"nullif({shown}, false) AS _b",
            *[f"codes[{i}] AS _c{i}" for i in n], "change_type", "_n",
        )

    def factored_contents(self) -> DataFrame:
        """Keys that repeat on both sides, as distinct row contents with copy counts.

        One row per key and distinct content: ``rows_f1`` and ``rows_f2`` copies, the raw
        ``values``, and how many of the key's join rows that start from these table-1
        copies are ``unchanged``, ``formatting_only`` or ``modified``. This is the full
        product in factored form: its size is that of the inputs.
        """
        def totalled(hot: bool) -> DataFrame:
            contents = self._contents(per_column=False, hot=hot, full_raw=True)
            meaning = contents.groupBy(*self.keys, "sem").agg(F.sum("n2").alias("_equal2"))
            # Totals come back by join: a window over the key would hold a hot key in one task.
            counts = (self._hot_keys if hot else self._cool_factored_keys).select(*self.keys, F.col("rows_2").alias("_all2"))
            totals = contents.join(F.broadcast(counts) if hot else counts, self.keys)
            return totals.join(meaning, [*self.keys, "sem"])

        joined = reduce(DataFrame.unionByName, [totalled(hot) for hot in self._factored_parts])
        names = F.array(*[F.lit(c.name) for c in self.columns]) if self.columns else F.array().cast("array<string>")

        def pairs(n: Column) -> Column:
            return (F.col("n1").cast("decimal(19,0)") * n.cast("decimal(19,0)")).cast("decimal(38,0)")

        return joined.select(
            *self._key_output(),
            F.col("n1").alias("rows_f1"),
            F.col("n2").alias("rows_f2"),
            F.map_from_arrays(names, "raw").alias("values"),
            pairs(F.col("n2")).alias("unchanged"),
            pairs(F.col("_equal2") - F.col("n2")).alias("formatting_only"),
            pairs(F.col("_all2") - F.col("_equal2")).alias("modified"),
        )


def diff(df1: DataFrame, df2: DataFrame, keys: Sequence[str], **options) -> Diff:
    """Plan a comparison of two tables; ``options`` are the fields of :class:`DiffSpec`."""
    return Diff(df1, df2, DiffSpec(keys=keys, **options))


def diff_classified(df1: DataFrame, df2: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    return diff(df1, df2, keys, **options).classified()


def diff_counts(df1: DataFrame, df2: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    return diff(df1, df2, keys, **options).counts()


def diff_column_stats(df1: DataFrame, df2: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    return diff(df1, df2, keys, **options).column_stats()


def diff_changes(df1: DataFrame, df2: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    return diff(df1, df2, keys, **options).changes()


def diff_before_after(df1: DataFrame, df2: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    return diff(df1, df2, keys, **options).before_after()


def diff_sample(df1: DataFrame, df2: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    return diff(df1, df2, keys, **options).sample()
