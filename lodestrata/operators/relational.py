"""Joins, appends, grouping, pivots."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import Rejected, dtype, nfkc_fold, require_finite, sequence_ratio
from .running import cut

KINDS = ("inner", "left", "right", "full")
#: Joined rows of one key above which a full join deals the key out, in blocks of about so many.
KEY_ROWS = 1 << 22
#: Deletions up to which texts may be found by what is left of them, and texts of a block and length that meet others at once.
DELETIONS, MEETING_TEXTS = 3, 4096
#: About so many rows of what deletions leave, or pairs to be met, go to a task.
LEFT_OVER, PAIRS = 1 << 17, 1 << 22


def _key_condition(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], nulls_equal: bool) -> Column:
    out = F.lit(True)
    for a, b in keys:
        if dtype(left, a) != dtype(right, b):
            raise Rejected(f"keys {a!r} and {b!r} differ in type")
        out = out & (left[a].eqNullSafe(right[b]) if nulls_equal else left[a] == right[b])
    return out


def join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], how: str = "inner", nulls_equal: bool = False, check: bool = True) -> DataFrame:
    """Equi-join that keeps the key columns of both sides; names must differ, so rename first.

    Non-finite keys are refused (``check``).  The strategy is left to the
    optimizer: a side is broadcast only where its size in bytes is known to be small.
    A full join holds all joined rows of a key at once, so keys with over ``KEY_ROWS`` of them are joined apart, in blocks.
    """
    if how not in KINDS or not keys:
        raise Rejected(how)
    if set(left.columns) & set(right.columns):
        raise Rejected(f"columns on both sides: {sorted(set(left.columns) & set(right.columns))}")
    condition = _key_condition(left, right, keys, nulls_equal)
    if check:
        require_finite(left, [a for a, _ in keys], "left key")
        require_finite(right, [b for _, b in keys], "right key")
    return _full(left, right, keys, nulls_equal) if how == "full" else left.join(right, condition, how)


def _full(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], nulls_equal: bool) -> DataFrame:
    """Full join; a heavy key's rows of either side are dealt out in blocks, and each two blocks meet in a task."""
    names = [f"__k{i}" for i in range(len(keys))]
    same = lambda x, y: x.eqNullSafe(y) if nulls_equal else x == y
    on = lambda pairs: reduce(lambda x, y: x & y, [same(x, y) for x, y in pairs])
    counts = lambda df, side, n: df.groupBy(*[F.col(k[side]).alias(m) for k, m in zip(keys, names, strict=True)]).agg(F.count(F.lit(1)).alias(n))
    x, y = counts(left, 0, "lc").alias("x"), counts(right, 1, "rc").alias("y")
    heavy = x.join(y, on([(F.col(f"x.{m}"), F.col(f"y.{m}")) for m in names])).filter(F.col("lc").cast("double") * F.col("rc") > KEY_ROWS)
    # The longer side is cut first; where a block of one of its rows would still be too large, the other too.
    short, long_ = F.least("lc", "rc"), F.greatest("lc", "rc")
    rows = F.least(long_, F.greatest(F.lit(1), F.floor(F.lit(KEY_ROWS) / short)))
    most, fewest = F.ceil(long_ / rows), F.ceil(short / KEY_ROWS)
    dealt = heavy.select(*[F.col(f"x.{m}").alias(m) for m in names], F.when(F.col("lc") >= F.col("rc"), most).otherwise(fewest).alias("__m"), F.when(F.col("lc") >= F.col("rc"), fewest).otherwise(most).alias("__n"))
    heavy = cut(dealt.withColumn("__h", F.monotonically_increasing_id()))
    groups = heavy.agg(F.sum(F.col("__m") * F.col("__n"))).first()[0]
    if not groups:
        return left.join(right, _key_condition(left, right, keys, nulls_equal), "full")

    # A number of partitions that adaptive execution keeps: it goes by bytes read, and these rows are few against those joined.
    parts = min(groups, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def blocks(df: DataFrame, side: int) -> DataFrame:
        own, other = ("__m", "__n") if side == 0 else ("__n", "__m")
        met = df.join(heavy, on([(F.col(k[side]), F.col(m)) for k, m in zip(keys, names, strict=True)]))
        met = met.withColumn("__own", F.pmod(F.xxhash64(F.lit(17), *[c for c in df.columns if "map<" not in dtype(df, c).simpleString()]), F.col(own))).withColumn("__other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)))
        i, j = ("__own", "__other") if side == 0 else ("__other", "__own")
        place = [f"__{c}{side}" for c in "hij"]
        return met.select(*df.columns, *[F.col(c).alias(n) for c, n in zip(("__h", i, j), place, strict=True)]).repartition(parts, *place)

    a, b = blocks(left, 0), blocks(right, 1)
    apart = a.join(b.hint("merge"), reduce(lambda x, y: x & y, [F.col(f"__{c}0") == F.col(f"__{c}1") for c in "hij"]))
    light = [df.join(heavy, on([(F.col(k[side]), F.col(m)) for k, m in zip(keys, names, strict=True)]), "left_anti") for side, df in enumerate((left, right))]
    rest = light[0].join(light[1], on([(F.col(p), F.col(q)) for p, q in keys]), "full")
    return rest.unionByName(apart.select(*left.columns, *right.columns))


def preflight(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], nulls_equal: bool = False) -> DataFrame:
    """One row that says what each kind of join would give, from counts of keys alone."""
    l_names, r_names = [f"__l{i}" for i in range(len(keys))], [f"__r{i}" for i in range(len(keys))]
    lc = left.groupBy(*[F.col(a).alias(n) for (a, _), n in zip(keys, l_names, strict=True)]).agg(F.count(F.lit(1)).alias("lc"))
    rc = right.groupBy(*[F.col(b).alias(n) for (_, b), n in zip(keys, r_names, strict=True)]).agg(F.count(F.lit(1)).alias("rc"))
    cond = F.lit(True)
    for a, b in zip(l_names, r_names, strict=True):
        cond = cond & (F.col(a).eqNullSafe(F.col(b)) if nulls_equal else F.col(a) == F.col(b))
    both = lc.join(rc, cond, "full")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    matched = F.col("lc").isNotNull() & F.col("rc").isNotNull()
    sums = both.agg(
        total(F.when(matched, F.col("lc") * F.col("rc"))).alias("inner_rows"),
        total(F.when(F.col("rc").isNull(), F.col("lc"))).alias("left_unmatched"),
        total(F.when(F.col("lc").isNull(), F.col("rc"))).alias("right_unmatched"),
        F.coalesce(F.max(F.when(matched, F.col("lc"))), F.lit(0)).alias("l"),
        F.coalesce(F.max(F.when(matched, F.col("rc"))), F.lit(0)).alias("r"),
    )
    side = lambda c: F.when(F.col(c) > 1, F.lit("n")).otherwise(F.lit("1"))
    return sums.select(
        "inner_rows", "left_unmatched", "right_unmatched",
        (F.col("inner_rows") + F.col("left_unmatched")).alias("left_rows"),
        (F.col("inner_rows") + F.col("right_unmatched")).alias("right_rows"),
        (F.col("inner_rows") + F.col("left_unmatched") + F.col("right_unmatched")).alias("full_rows"),
        F.concat(side("l"), F.lit(":"), side("r")).alias("relationship"),
    )


def lineage(joined: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Which input rows each joined row came from: one edge for a row and side."""
    edges = F.array(
        F.struct(F.lit("left").alias("side"), F.col(left_id).cast("string").alias("input_row_id")),
        F.struct(F.lit("right").alias("side"), F.col(right_id).cast("string").alias("input_row_id")),
    )
    row = F.sha2(F.concat_ws("\u0001", F.coalesce(F.col(left_id).cast("string"), F.lit("\u0002")), F.coalesce(F.col(right_id).cast("string"), F.lit("\u0002"))), 256)
    return joined.select(row.alias("output_row_id"), F.explode(edges).alias("e")).select("output_row_id", "e.side", "e.input_row_id").filter("input_row_id is not null")


def semi(df: DataFrame, selection: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows whose keys are in the selection; null keys never match."""
    return df.join(selection.select(*[F.col(b).alias(f"__k{i}") for i, (_, b) in enumerate(keys)]).distinct(), [F.col(a) == F.col(f"__k{i}") for i, (a, _) in enumerate(keys)], "left_semi")


def orphans(df: DataFrame, reference: DataFrame, column: str, key: str, nullable: bool = True) -> DataFrame:
    """Rows whose foreign key isn't in the reference, whose keys must be unique."""
    if reference.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").limit(1).count():
        raise Rejected("the referenced key isn't unique")
    rows = df.filter(F.col(column).isNotNull()) if nullable else df
    return rows.join(reference.select(F.col(key).alias("__key")), F.col(column) == F.col("__key"), "left_anti")


def append(left: DataFrame, right: DataFrame, mapping: dict[str, str], ordinal: bool = False) -> DataFrame:
    """Rows of both; ``mapping`` says the left name of each right column.  What one side lacks is null there."""
    if set(mapping) != set(right.columns) or len(set(mapping.values())) != len(mapping):
        raise Rejected("every right column needs one name")
    for r, name in mapping.items():
        if name in left.columns and dtype(left, name) != dtype(right, r):
            raise Rejected(f"{name!r} differs in type")
    renamed = right.select(*[F.col(r).alias(n) for r, n in mapping.items()])
    if ordinal:
        left, renamed = left.withColumn("__side", F.lit(0)), renamed.withColumn("__side", F.lit(1))
    return left.unionByName(renamed, allowMissingColumns=True)


MEASURES = ("count", "count_valid", "sum", "mean", "min", "max")


def _measure(df: DataFrame, op: str, column: str | None, target: str | None) -> Column:
    if op == "count":
        return F.count(F.lit(1))
    if op == "count_valid":
        return F.count(column)
    if op not in MEASURES:
        raise Rejected(op)
    out = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[op](F.col(column))
    return out.cast(target) if target else out


def aggregate(df: DataFrame, keys: Sequence[str], measures: dict[str, tuple], check: bool = True) -> DataFrame:
    """``measures``: name to ``(op, column[, target type])``.

    Null is a group; without keys there is always one row.  Non-finite keys
    and measured values are refused.
    """
    if check:
        require_finite(df, [*keys, *(m[1] for m in measures.values() if len(m) > 1 and m[0] in ("sum", "mean") and m[1])], "aggregate")
    columns = [_measure(df, m[0], m[1] if len(m) > 1 else None, m[2] if len(m) > 2 else None).alias(name) for name, m in measures.items()]
    return df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)


def header_values(df: DataFrame, header: str, ordinal: str | None = None, limit: int = 256) -> list:
    """Headers of a pivot in the order of their first row: one small aggregate."""
    if not isinstance(dtype(df, header), (T.StringType, T.IntegralType)):
        raise Rejected("headers are texts or whole numbers")
    first = df.groupBy(header).agg(F.min(ordinal).alias("o") if ordinal else F.lit(0).alias("o"))
    rows = first.orderBy("o", header).limit(limit + 1).collect()
    if len(rows) > limit or any(r[0] is None for r in rows):
        raise Rejected("null or too many headers")
    return [r[0] for r in rows]


def pivot(df: DataFrame, keys: Sequence[str], header: str, values: Sequence, op: str, column: str | None = None, target: str | None = None) -> DataFrame:
    """Columns ``Pivot_<value>``; an absent cell is 0 for count and null for the others; ``reject`` refuses two rows for a cell."""
    cell = lambda v: F.col(header) == F.lit(v)
    if op == "reject":
        if df.groupBy(*keys, header).count().filter("count > 1").limit(1).count():
            raise Rejected("two rows for one cell")
        op = "max"
    found = []
    for v in values:
        # Conditional aggregates: one pass and one shuffle whatever the number of headers.
        pick = F.when(cell(v), F.lit(1) if op == "count" else F.col(column))
        out = F.count(pick) if op == "count" else {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[op](pick)
        found.append((out.cast(target) if target else out).alias(f"Pivot_{v}"))
    return df.groupBy(*keys).agg(*found)


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    """One row for each row and column, nulls too."""
    if len({dtype(df, c).simpleString() for c in columns}) != 1:
        raise Rejected("columns of one type are needed")
    return df.unpivot(list(ids), list(columns), name, value)


def keyed_pairs(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Inner join on a key that must be unique and not null on both sides, and the counts that found no partner."""
    for side in (left, right):
        if side.groupBy(key).count().filter(F.col(key).isNull() | (F.col("count") > 1)).limit(1).count():
            raise Rejected("keys must be unique and not null")
    counts = preflight(left, right.withColumnRenamed(key, f"{key}_r"), [(key, f"{key}_r")]).select("inner_rows", "left_unmatched", "right_unmatched")
    return left.join(right, key), counts


def _remaining(text: Column, deletions: Column) -> Column:
    """Distinct texts that so many deletions leave."""
    @F.arrow_udf("array<string>")
    def left(texts: pa.Array, counts: pa.Array) -> pa.Array:
        return pa.array([list({"".join(c) for c in combinations(t, len(t) - d)}) for t, d in zip(texts.to_pylist(), counts.to_pylist(), strict=True)], pa.list_(pa.string()))

    return left(text, deletions)


def _ratio_pairs(texts: DataFrame, threshold: float) -> DataFrame:
    """``b, x, xn, y, yn``: all ordered pairs of a block's ``texts`` (``b, t, n, lo, hi``, written) that may reach the ratio, each once.

    Matching blocks are a common subsequence, so the texts share one of ``least`` characters.  Texts of two lengths are found by what
    deletions down to ``least`` leave of them, where that makes fewer rows than their pairs are; else each two meet, dealt out in
    parts, and stay if as many edits as the deletions of both suffice.
    """
    counts = texts.groupBy("b", "n").agg(F.count(F.lit(1)).alias("c"))
    x, y = counts.alias("x"), counts.alias("y")
    able = F.col("x.n") * 2 >= threshold * (F.col("x.n") + F.col("y.n"))
    both = x.join(y, (F.col("x.b") == F.col("y.b")) & (F.col("x.n") <= F.col("y.n")) & able)
    both = both.select("x.b", "x.n", F.col("y.n").alias("m"), F.col("x.c").alias("cn"), F.col("y.c").alias("cm"))
    least = F.greatest(F.lit(0), F.ceil(threshold * (F.col("n") + F.col("m")) / 2 - 1e-9)).cast("int")
    both = both.withColumn("dn", F.col("n") - F.least("n", least)).withColumn("dm", F.col("m") - F.least("n", least))

    def ways(n: Column, d: Column) -> Column:
        out, found = F.lit(1.0), F.when(d == 0, 1.0)
        for k in range(1, DELETIONS + 1):
            out = out * (n - (k - 1)) / k
            found = found.when(d == k, out)
        return found

    rows = F.col("cn") * ways(F.col("n"), F.col("dn")) + F.col("cm") * ways(F.col("m"), F.col("dm"))
    both = cut(both.withColumn("few", F.coalesce(4 * rows < F.col("cn") * F.col("cm").cast("double"), F.lit(False))))
    work = {r["few"]: r["w"] for r in both.groupBy("few").agg(F.sum(F.when(F.col("few"), rows).otherwise(F.col("cn") * F.col("cm").cast("double"))).alias("w")).collect()}
    tasks = {few: int(w // (LEFT_OVER if few else PAIRS)) + 1 for few, w in work.items()}

    def met(few: bool, of: dict[str, Column]) -> DataFrame:
        """Pairs of texts of two lengths that share a value of those that ``of`` has of each side."""
        sizes = both.filter(F.col("few") == few)
        side = lambda n, name: texts.withColumnRenamed("n", n).join(sizes, ["b", n]).select("b", "n", "m", "dn", "dm", F.struct("t", "lo", "hi").alias(name), of[n])
        keys = ["b", "n", "m", "v"]
        left, right = side("n", "x"), side("m", "y").drop("dn", "dm")
        pairs = left.repartition(tasks[few], *keys).join(right.repartition(tasks[few], *keys).hint("merge"), keys)
        return pairs.filter((F.col("n") < F.col("m")) | (F.col("x.t") <= F.col("y.t"))).select("b", "n", "m", "dn", "dm", "x", "y")

    met_by = []
    if True in work:
        met_by.append(met(True, {n: F.explode(_remaining(F.col("t"), F.col(f"d{n}"))).alias("v") for n in "nm"}))
    if False in work:
        of = {n: F.ceil(F.col(f"c{n}") / MEETING_TEXTS) for n in "nm"}
        own = {n: F.pmod(F.xxhash64("t"), of[n]) for n in "nm"}
        every = {n: F.sequence(F.lit(0).cast("bigint"), of[n] - 1) for n in "nm"}
        x = F.transform(every["m"], lambda k: F.struct(own["n"].alias("i"), k.alias("j")))
        y = F.transform(every["n"], lambda k: F.struct(k.alias("i"), own["m"].alias("j")))
        near = F.call_function("levenshtein", F.col("x.t"), F.col("y.t"), (F.col("dn") + F.col("dm")).cast("int")) >= 0
        met_by.append(met(False, {"n": F.explode(x).alias("v"), "m": F.explode(y).alias("v")}).filter(near))
    if not met_by:
        return texts.limit(0).select("b", F.col("t").alias("x"), F.col("n").alias("xn"), F.col("t").alias("y"), F.col("n").alias("yn"))
    pairs = reduce(DataFrame.unionByName, met_by)
    ordered = F.array(F.struct(F.col("x"), F.col("n").alias("xn"), F.col("y"), F.col("m").alias("yn")), F.struct(F.col("y").alias("x"), F.col("m").alias("xn"), F.col("x").alias("y"), F.col("n").alias("yn")))
    turned = pairs.select("b", F.explode(ordered).alias("p")).filter(F.col("p.x.lo") < F.col("p.y.hi"))
    out = turned.select("b", F.col("p.x.t").alias("x"), F.col("p.xn").alias("xn"), F.col("p.y.t").alias("y"), F.col("p.yn").alias("yn"))
    return out.repartition(max(sum(tasks.values()), texts.sparkSession.sparkContext.defaultParallelism), "b", "x", "y").distinct()


def block_pairs(df: DataFrame, key: str, block: Sequence[str], text: str, threshold: float, method: str = "distance") -> DataFrame:
    """Pairs within a block whose texts are alike.

    ``distance``: 1 - edit distance / longer length, of trimmed lower-case texts; ``ratio``: by matching blocks, of texts in
    compatibility form and folded.  Only pairs with lengths that allow the threshold are compared (of ``ratio``: only those with
    a common subsequence or edits that allow it), and a block's copies of a text once for all.
    """
    if method == "ratio":
        rows = cut(df.select(F.col(key).alias("id"), F.struct(*block).alias("b"), nfkc_fold(F.col(text)).alias("t")).filter("t is not null").withColumn("n", F.char_length("t")))
        similarity = sequence_ratio(F.col("x"), F.col("y"))
    else:
        rows = df.select(F.col(key).alias("id"), F.concat_ws("\u0001", *[F.coalesce(F.lower(F.trim(F.col(b).cast("string"))), F.lit("")) for b in block]).alias("b"), F.lower(F.trim(text)).alias("t"), F.char_length(F.trim(text)).alias("n")).filter("t is not null")
        able = F.least("a.n", "b.n") >= threshold * F.greatest("a.n", "b.n")
        similarity = 1 - F.levenshtein("x", "y") / F.greatest(F.col("xn"), F.col("yn"), F.lit(1))
    # A text's first and last key tell whether it can be on the left of another, so texts that all differ meet once too.
    texts = rows.groupBy("b", "t", "n").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    if method == "ratio":
        met = _ratio_pairs(cut(texts), threshold)
    else:
        a, b = texts.alias("a"), texts.alias("b")
        met = a.join(b, (F.col("a.b") == F.col("b.b")) & (F.col("a.lo") < F.col("b.hi")) & able)
        met = met.select(F.col("a.b").alias("b"), F.col("a.t").alias("x"), F.col("a.n").alias("xn"), F.col("b.t").alias("y"), F.col("b.n").alias("yn"))
    # Exploded, so that the planner doesn't compare a pair again for the filter.
    alike = met.select("b", "x", "xn", "y", "yn", F.explode(F.filter(F.array(similarity), lambda v: v >= threshold)).alias("similarity"))
    left = rows.select(F.col("id").alias("left_id"), "b", F.col("t").alias("x"), F.col("n").alias("xn"))
    right = rows.select(F.col("id").alias("right_id"), "b", F.col("t").alias("y"), F.col("n").alias("yn"))
    found = left.join(alike, ["b", "x", "xn"]).join(right, ["b", "y", "yn"])
    return found.filter(F.col("left_id") < F.col("right_id")).select("left_id", "right_id", "similarity")
