"""Damage of many kinds and rates laid over one given table: variants that share their draws.

A cell is hit at rate r if its draw lies below a threshold that grows with r, so the damage at a low rate is part of the damage at
a higher one.  The table is written once with the *level* of every cell (the number of thresholds its draw has passed); any mix
of rates is then a comparison of levels.  A variant differs from the base of its part in few rows, which it loses and gains
as *delta rows*; its profile is the aggregates of the base plus those of the delta, so the table itself is aggregated once, and
not once per variant.  Samples are further parts of the same table.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_double
from ..functions.draws import Draws
from ..operators.inject import COPY_NO, copy_arrivals, hit_share
from ..operators.profile import DUPLICATE, INCONSISTENCY, INDICATORS, MISSING, OUTLIER, any_of, count_nulls, fence_columns, outside
from ..operators.quantiles import variant_quantiles
from ..operators.selection import cutoffs
from ..operators.storage import materialise, small_table
from ..operators.table import AuditTable, row_hashes
from ..sources.generate import ErrorRates, one_error_type
from .registry import PREFIX_SIZES

KINDS = ("missing", "duplicate", "outlier", "inconsistency")
MOST_VARIANTS = 4096  # the list of variants is sent to all tasks


@dataclass(frozen=True)
class Overlay:
    """``rows``: key, copy_no, clean measured columns and the level of every kind of damage; ``rates``: per kind, in order."""

    table: AuditTable
    rows: DataFrame
    rates: dict[str, tuple[float, ...]]
    sizes: tuple[int, ...]  # rows of the table at each rate of copies

    def levels(self, rates: ErrorRates) -> tuple[int, ...]:
        return tuple(self.rates[k].index(float(getattr(rates, k))) for k in KINDS)

    def present(self, level: Column) -> Column:
        return F.col("copy_level") <= level

    def content(self, missing: Column, outlier: Column, inconsistency: Column) -> list[Column]:
        """The measured columns at the given levels; numeric ones as doubles."""
        t, cells = self.table, []
        for k, c in enumerate(t.measured):
            x = as_double(c) if c in t.numeric else F.col(f"`{c}`")
            x = F.when(F.col(f"missing_{k}") > missing, x)
            if c in t.numeric:
                x = F.when(F.col(f"outlier_{k}") <= outlier, x + F.col(f"shift_{k}")).otherwise(x)
            if t.rules and c == t.rules[0].dependent:
                x = F.when(F.col("broken_level") <= inconsistency, F.col("noise")).otherwise(x)
            cells.append(x.alias(c))
        return cells

    def damaged(self, rates: ErrorRates, name: str) -> AuditTable:
        """One variant as a table of its own; ``copy_no`` belongs to its key."""
        m, d, o, i = (F.lit(x) for x in self.levels(rates))
        keys = [*self.table.key_cols, COPY_NO]
        df = self.rows.where(self.present(d)).select(*keys, *self.content(m, o, i))
        return AuditTable(df, tuple(keys), self.table.measured, self.table.rules, name, self.sizes[self.levels(rates)[1]], "overlay")


def lay_over(t: AuditTable, variants: Sequence[ErrorRates], seed: int = 42, low: float = -100.0, high: float = 100.0) -> Overlay:
    """Draw the damage of all ``variants`` over ``t`` once.

    Damage comes in this order: cells go missing (hits with replacement), rows are copied, numeric cells move by +-10 (sample sd of
    the given column + 1e-6), and the dependent of the rule is overwritten by a uniform value.  Cells of copies are drawn anew from
    the third step on.  The table may have at most one rule, with a numeric dependent; a second one is an error.
    """
    if len(t.rules) > 1:
        raise ValueError("an overlay breaks one dependency; give a table with one rule")
    if t.rules and t.rules[0].dependent not in t.numeric:
        raise ValueError(f"dependent {t.rules[0].dependent!r} is not numeric")
    if COPY_NO in t.df.columns:
        raise ValueError(f"column {COPY_NO!r} is added here and must not be there")
    rates = {k: tuple(sorted({float(getattr(v, k)) for v in variants})) for k in KINDS}
    draws, keys, numeric = Draws(seed), list(t.key_cols), t.numeric
    n = t.rows
    source = t.df.select(*dict.fromkeys([*keys, *t.measured]))
    sizes = [int(n * r) for r in rates["duplicate"]]
    rows = source.withColumns({COPY_NO: F.lit(0), "copy_level": F.lit(0)})
    if n and sizes[-1] > 0:
        names = [*keys, COPY_NO]
        arrived, early = copy_arrivals(source, n, sizes[-1], keys, seed)
        _, cuts = cutoffs(arrived, F.col("arrival"), names, lambda _: {j: (None, m) for j, m in enumerate(sizes)}, spread=early)
        later = reduce(lambda a, b: a + b, [(~cuts[j].keeps(F.col("arrival"), names)).cast("int") for j in range(len(sizes))])
        copies = arrived.withColumn("copy_level", later).drop("arrival").where(F.col("copy_level") < len(sizes))
        rows = rows.unionByName(copies)

    def level(draw: Column, shares: Sequence[float]) -> Column:
        return reduce(lambda a, b: a + b, [(draw >= F.lit(s)).cast("int") for s in shares]).cast("byte")

    columns: dict[str, Column] = {}
    for k, c in enumerate(t.measured):
        columns[f"missing_{k}"] = level(draws.uniform(f"missing:{c}", *keys), [hit_share(r) for r in rates["missing"]])
        if c in numeric:
            columns[f"outlier_{k}"] = level(draws.uniform(f"outlier:{c}", *keys, COPY_NO), [hit_share(r / len(numeric)) for r in rates["outlier"]])
            columns[f"shift_{k}"] = draws.sign(f"sign:{c}", *keys, COPY_NO) * 10.0 * (F.col(f"sd_{k}") + 1e-6)
    if t.rules:
        dependent = t.rules[0].dependent
        columns["broken_level"] = level(draws.uniform(f"break:{dependent}", *keys, COPY_NO), [hit_share(r) for r in rates["inconsistency"]])
        columns["noise"] = F.lit(low) + F.lit(high - low) * draws.uniform(f"noise:{dependent}", *keys, COPY_NO)
    if numeric:
        deviations = [F.coalesce(F.stddev_samp(as_double(c)), F.lit(0.0)).alias(f"sd_{t.measured.index(c)}") for c in numeric]
        rows = rows.crossJoin(F.broadcast(source.agg(*deviations)))
    written = materialise(rows.select(*source.columns, COPY_NO, "copy_level", *[c.alias(a) for a, c in columns.items()]), "overlay")
    return Overlay(t, written, rates, tuple(n + m for m in sizes))


def variant_profiles(o: Overlay, parts: Sequence[tuple[int, Column, ErrorRates]], variants: Sequence[tuple[int, int, ErrorRates]]) -> DataFrame:
    """Profiles of variants: (variant, the indicators, sample_size), one row each, empty ones included.

    ``parts``: (number, predicate on ``o.rows``, base rates); ``variants``: (number, part, rates).  The base of a part should be
    near its variants, since the cost of a variant is the rows in which both differ.
    """
    if len(variants) > MOST_VARIANTS:
        raise ValueError(f"at most {MOST_VARIANTS} variants at a time")
    spark, t = o.rows.sparkSession, o.table
    numeric = [c for c in t.measured if c in t.numeric]
    base_of = {p: o.levels(rates) for p, _, rates in parts}
    listed = small_table(spark, [(v, p, *base_of[p], *o.levels(rates)) for v, p, rates in variants],
                         "variant int, part int, " + ", ".join(f"{s}_{k} int" for s in "bv" for k in KINDS))
    bases = small_table(spark, [(p, *levels) for p, levels in base_of.items()], "part int, " + ", ".join(f"b_{k} int" for k in KINDS))
    in_parts = F.filter(F.array(*[F.when(keep, F.lit(p)) for p, keep, _ in parts]), lambda p: p.isNotNull())
    rows = o.rows.withColumn("part", F.explode(in_parts))

    def content(s: str) -> list[Column]:
        return o.content(*[F.col(f"{s}_{k}") for k in KINDS if k != "duplicate"])

    base = materialise(_reduced(t, numeric, rows.join(F.broadcast(bases), "part").where(o.present(F.col("b_duplicate"))).select("part", *content("b"))), "base")
    was, is_ = o.present(F.col("b_duplicate")), o.present(F.col("v_duplicate"))

    def moved(name: str, kind: str) -> Column:
        return (F.col(name) <= F.col(f"b_{kind}")) != (F.col(name) <= F.col(f"v_{kind}"))

    def touched(columns: Sequence[str]) -> Column:
        flags = [was != is_, *[moved(f"missing_{k}", "missing") for k, c in enumerate(t.measured) if c in columns],
                 *[moved(f"outlier_{k}", "outlier") for k, c in enumerate(t.measured) if c in columns and c in numeric]]
        return any_of(flags + ([moved("broken_level", "inconsistency")] if t.rules else []))

    ruled = touched([*t.rules[0].determinant, t.rules[0].dependent]) if t.rules else F.lit(False)
    pairs = rows.join(F.broadcast(listed), "part").where(touched(t.measured) & (was | is_)).withColumn("ruled", ruled)
    sides = F.array(F.when(was, F.struct(F.lit(-1).alias("sign"), *content("b"))), F.when(is_, F.struct(F.lit(1).alias("sign"), *content("v"))))
    delta = pairs.select("variant", "part", "ruled", F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("x")).select("variant", "part", "ruled", "x.*")
    delta = materialise(_reduced(t, numeric, delta), "delta")

    plain = base.groupBy("part").agg(F.count(F.lit(1)).alias("n_base"), F.sum("nulls").alias("nulls_base"))
    change = delta.groupBy("variant").agg(F.sum("sign").alias("dn"), F.sum(F.col("sign") * F.col("nulls")).alias("dnulls"))
    out = listed.select("variant", "part").join(plain, "part", "left").join(change, "variant", "left")
    for found, on in [*_repeated(base, delta), *(_broken(base, delta) if t.rules else []), *(_outlying(base, delta, listed, numeric) if numeric else [])]:
        out = out.join(found, on, "left")
    n = F.coalesce("n_base", F.lit(0)) + F.coalesce("dn", F.lit(0))

    def rate(name: str, per: int = 1) -> Column:
        if name not in names:
            return F.lit(0.0)
        total = F.coalesce(f"{name}_base", F.lit(0)) + F.coalesce(f"d{name}", F.lit(0))
        return F.coalesce(total.cast("double") / F.nullif(n * per, F.lit(0)), F.lit(0.0))

    names = {c.removesuffix("_base") for c in out.columns if c.endswith("_base")}
    rates = {MISSING: rate("nulls", max(len(t.measured), 1)), DUPLICATE: rate("repeated"), OUTLIER: rate("out"), INCONSISTENCY: rate("broken")}
    return out.select("variant", *[rates[i].alias(i) for i in INDICATORS], n.cast("bigint").alias("sample_size"))


def _reduced(t: AuditTable, numeric: Sequence[str], df: DataFrame) -> DataFrame:
    """Rows as hashes of what is compared, null cells, and the numeric cells."""
    df = df.withColumns({c: F.nanvl(F.col(f"`{c}`"), F.lit(None).cast("double")) for c in numeric})
    h1, h2 = row_hashes(df, t.measured)
    columns = {"id_1": h1, "id_2": h2, "nulls": count_nulls(t.measured).cast("bigint"), **{f"x_{i}": F.col(f"`{c}`") for i, c in enumerate(numeric)}}
    if t.rules:
        rule = t.rules[0]
        known = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in rule.determinant])
        d1, d2 = row_hashes(df, rule.determinant)
        columns |= {"det_1": F.when(known, d1), "det_2": F.when(known, d2),
                    "dep": F.when(F.col(f"`{rule.dependent}`").isNotNull(), row_hashes(df, [rule.dependent])[0])}
    kept = [c for c in ("variant", "part", "ruled", "sign") if c in df.columns]
    return df.select(*kept, *[c.alias(a) for a, c in columns.items()])


def _repeated(base: DataFrame, delta: DataFrame) -> list[tuple[DataFrame, str]]:
    """Rows whose content occurs more than once: only contents that a variant touches are looked up."""
    content = ["id_1", "id_2"]
    # never null; said here, so that both uses of the counts have one plan and share one shuffle
    counts = base.where("part is not null and id_1 is not null and id_2 is not null").groupBy("part", *content).agg(F.count(F.lit(1)).alias("n"))
    change = delta.groupBy("variant", "part", *content).agg(F.sum("sign").alias("d")).where("d != 0")
    met = change.join(counts, ["part", *content], "left").withColumn("n", F.coalesce("n", F.lit(0)))

    def repeated(n: Column) -> Column:
        return F.when(n > 1, n).otherwise(F.lit(0))

    return [(counts.groupBy("part").agg(F.sum(repeated(F.col("n"))).alias("repeated_base")), "part"),
            (met.groupBy("variant").agg(F.sum(repeated(F.col("n") + F.col("d")) - repeated(F.col("n"))).alias("drepeated")), "variant")]


def _broken(base: DataFrame, delta: DataFrame) -> list[tuple[DataFrame, str]]:
    """Rows of determinants with several dependents.

    A variant changes the number of dependents of a determinant where a pair of both appears or ends, so the
    dependents of a determinant are never gathered, however many it has.  Rows whose pair a variant leaves alone lose and gain it.
    """
    det, pair = ["det_1", "det_2"], ["det_1", "det_2", "dep", "known"]

    def keyed(df: DataFrame) -> DataFrame:
        # a null dependent is no dependent, but its row counts; without null keys all uses of the pairs share one shuffle
        df = df.where("part is not null and det_1 is not null and det_2 is not null")
        return df.withColumn("known", F.col("dep").isNotNull()).withColumn("dep", F.coalesce("dep", F.lit(0)))

    pairs = keyed(base).groupBy("part", *pair).agg(F.count(F.lit(1)).alias("n"))
    dets = pairs.groupBy("part", *det).agg(F.sum("n").alias("rows"), F.sum(F.col("known").cast("bigint")).alias("deps"))
    change = keyed(delta.where("ruled")).groupBy("variant", "part", *pair).agg(F.sum("sign").alias("d")).where("d != 0")
    met = change.join(pairs, ["part", *pair], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    appeared = F.when(F.col("known"), (F.col("n") + F.col("d") > 0).cast("int") - (F.col("n") > 0).cast("int")).otherwise(F.lit(0))
    touched = met.groupBy("variant", "part", *det).agg(F.sum("d").alias("drows"), F.sum(appeared).alias("ddeps"))
    seen = touched.join(dets, ["part", *det], "left").na.fill(0, ["rows", "deps"])
    before = F.when(F.col("deps") > 1, F.col("rows")).otherwise(F.lit(0))
    after = F.when(F.col("deps") + F.col("ddeps") > 1, F.col("rows") + F.col("drows")).otherwise(F.lit(0))
    return [(dets.groupBy("part").agg(F.sum(before).alias("broken_base")), "part"),
            (seen.groupBy("variant").agg(F.sum(after - before).alias("dbroken")), "variant")]


def _outlying(base: DataFrame, delta: DataFrame, listed: DataFrame, numeric: Sequence[str]) -> list[tuple[DataFrame, str]]:
    """Rows outside a variant's own fences: the base is read once for all variants, against one small row of fences each."""
    xs = [f"x_{i}" for i in range(len(numeric))]
    own = listed.select("variant", "part")
    quartiles = variant_quantiles(base, delta, own, xs, (0.25, 0.75))
    centre = base.groupBy("part").agg(*[F.coalesce(F.avg(x), F.lit(0.0)).alias(f"mid_{x}") for x in xs])

    def moments(rows: DataFrame, by: str, sign: Column, prefix: str) -> DataFrame:
        sums = []
        for x in xs:
            off = F.col(x) - F.col(f"mid_{x}")
            sums += [F.sum(F.when(F.col(x).isNotNull(), sign)).alias(f"{prefix}n_{x}"), F.sum(sign * off).alias(f"{prefix}s_{x}"), F.sum(sign * off * off).alias(f"{prefix}q_{x}")]
        return rows.join(F.broadcast(centre), "part", "left").groupBy(by).agg(*sums)

    # about the mean of the base, so that squares do not cancel
    stats = own.join(moments(base, "part", F.lit(1), "b"), "part", "left").join(moments(delta, "variant", F.col("sign"), "d"), "variant", "left")
    stats = stats.join(centre, "part", "left").join(quartiles, "variant", "left").na.fill(0)
    columns: list[Column] = []
    for i, x in enumerate(xs):
        n, s, q = (F.col(f"b{m}_{x}") + F.col(f"d{m}_{x}") for m in "nsq")
        columns += [n.alias(f"n_{i}"), (F.col(f"mid_{x}") + s / F.nullif(n, F.lit(0))).alias(f"mean_{i}"),
                    F.sqrt(F.greatest((q - s * s / F.nullif(n, F.lit(0))) / F.nullif(n - 1, F.lit(0)), F.lit(0.0))).alias(f"sd_{i}"), F.col(x).alias(f"q_{i}")]
    fences = materialise(stats.select("variant", "part", *columns).select("variant", "part", *fence_columns(len(xs))), "fences")
    flag = any_of(outside(xs)).cast("int")
    static = base.join(F.broadcast(fences), "part").groupBy("variant").agg(F.sum(flag).alias("out_base"))
    moving = delta.join(F.broadcast(fences.drop("part")), "variant").groupBy("variant").agg(F.sum(F.col("sign") * flag).alias("dout"))
    return [(static, "variant"), (moving, "variant")]


def sweep(kinds: Sequence[str], rates: Sequence[float], others: float = 0.01) -> list[tuple[str, float, ErrorRates]]:
    """(kind, rate, rates of all kinds): one kind at a rate, the others at ``others``."""
    return [(kind, float(rate), one_error_type(kind, float(rate), others)) for kind in kinds for rate in rates]


def sweep_results(t: AuditTable, kinds: Sequence[str], rates: Sequence[float], methods: Sequence[str], budgets: Sequence[float],
                  seeds: Sequence[int], others: float = 0.01, damage_seed: int = 42) -> tuple[Overlay, DataFrame]:
    """The overlay, and one row per (error_type, error_rate, method, budget, seed) with estimates and true rates (``true_...``).

    ``methods`` take a prefix of the draw order.  A sample of a variant is the prefix among the rows the variant has, so variants
    with equally many copies share the rows of a sample; each such sample is one part, also if several methods or budgets take as many rows.
    """
    listed = sweep(kinds, rates, others)
    o = lay_over(t, [r for *_, r in listed], damage_seed)
    base = one_error_type("missing", others, others)
    if base.duplicate not in o.rates["duplicate"] or any(others not in o.rates[k] for k in KINDS):
        base = listed[0][2]
    keys = [*t.key_cols, COPY_NO]
    parts: list[tuple[int, Column, ErrorRates]] = [(0, F.lit(True), base)]
    variants: list[tuple[int, int, ErrorRates]] = [(v, 0, r) for v, (*_, r) in enumerate(listed)]
    described: list[tuple] = []
    for level, n in enumerate(o.sizes):
        those = [(v, r) for v, (*_, r) in enumerate(listed) if o.levels(r)[1] == level]
        held, near = o.present(F.lit(level)), base if o.levels(base)[1] == level else those[0][1] if those else base
        for seed in seeds if those else ():
            draw = Draws(seed).uniform("row", *keys)
            wanted = {(m, b): (None, min(n, PREFIX_SIZES[m](n, b))) for m in methods for b in budgets}
            _, cuts = cutoffs(o.rows.where(held), draw, keys, lambda _: wanted)
            first: dict[int, int] = {}  # by size of the prefix, the number of its first variant
            for (m, b), cut in cuts.items():
                size = wanted[m, b][1]
                if size not in first:
                    first[size] = len(variants)
                    parts.append((len(parts), held & cut.keeps(draw, keys), near))
                    variants += [(first[size] + k, len(parts) - 1, r) for k, (_, r) in enumerate(those)]
                described += [(first[size] + k, v, m, float(b), int(seed), n) for k, (v, _) in enumerate(those)]
    found = materialise(variant_profiles(o, parts, variants), "variants")
    spark = o.rows.sparkSession
    truth = found.where(F.col("variant") < len(listed)).select(F.col("variant").alias("truth_of"), *[F.col(i).alias(f"true_{i}") for i in INDICATORS])
    names = small_table(spark, [(v, kind, rate) for v, (kind, rate, _) in enumerate(listed)], "truth_of int, error_type string, error_rate double")
    rows = small_table(spark, described, "variant int, truth_of int, method string, budget double, seed bigint, n_records bigint")
    small = F.broadcast(rows.join(F.broadcast(names), "truth_of"))
    return o, found.join(small, "variant").join(F.broadcast(truth), "truth_of").drop("truth_of", "variant")
