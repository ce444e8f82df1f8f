"""Chain samplers: Metropolis-Hastings, Gibbs, and dependency-guided proposals.

A chain is sequential, but one step needs only the size and the score sum of the batch it looks at.  So:

1. rows are drawn into a warm start (a filter, see ``selection``); the rest is the pool;
2. every pool row gets, by hash, a stream and a chunk of about ``batch_size`` rows.  A fifth of the pool forms the
   *forced* stream (chunks of ``batch_size / 4``, used when a proposal is rejected); the others propose from the
   stream of a pivot column (rows that are extreme in it) or from the uniform stream;
3. chunks are reduced to (rows, defect cells) - one grouped count, the only pass that shuffles, N / batch_size rows;
4. steps are listed with the pivot each one draws, and folded in order: accept the proposal with probability
   min(1, exp(lam (proposed - current))), else take the step's forced chunk;
5. the sample is the rows of the taken chunks (a semi join on chunk numbers), trimmed to the budget.

Steps 1-5 read a narrow table (key, defect cells, draws) that is written once.

If the pool's chunks run out first, the untouched rows are hashed again and the chain goes on.  The batch size is
what the caller says at any table size.

A chain is sequential in its steps, but a step feels the steps before it only through one number, the running mean, which many
rows make stiff.  So steps are cut into segments that lie in storage, and all segments are folded at once, each from a
*predicted* entry state (defects and rows so far).  The sums they return give better entry states by a prefix sum.  Every
segment keeps how close its decisions came to the other outcome; only where a corrected entry state moves the mean by
more than that is it folded again.  When no segment has to be, all entry states are exact and the decisions are those of
the serial chain.  Each round settles at least the first open segment; in practice a few rounds settle all.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_double
from ..functions.draws import Draws
from .dependency import column_priority, pairwise_weights, pivot_distribution
from .quantiles import quantile_table
from .samplers import WEIGHT, Sample, with_inverse_weights
from .score import EPSILON, CellRules, ScoreCounts, score_counts
from .prefix import totals_before
from .selection import smallest, weight_spread
from .storage import materialise, small_table
from .table import AuditTable

UNIFORM, FORCED = "uniform", "forced"
FORCED_SHARE = 0.2  # a forced batch is a quarter of a proposal: 1/4 : 1
SEGMENT = 4096  # steps folded at a time
CARRIED = "__row"
DECISIONS = "stream string, chunk bigint, entry bigint"


@dataclass(frozen=True)
class Proposals:
    """Where proposals come from: the stream of each row, and the chance of each stream per step."""

    stream: Column = field(default_factory=lambda: F.lit(UNIFORM))
    chances: tuple[tuple[str, float], ...] = ((UNIFORM, 1.0),)


def metropolis_hastings(t: AuditTable, budget: float, seed=42, lam: float = 2.0, batch_size: int = 200, **options) -> Sample:
    """Uniform proposals, accepted by their mean score against the running mean."""
    return _chain(t, budget, seed, "metropolis_hastings", Proposals(), CellRules.of(t), lam, batch_size, **options)


def gibbs(t: AuditTable, budget: float, seed=42, batch_size: int = 200, **options) -> Sample:
    """Each step takes a batch from one decile of one numeric column; always accepted."""
    rules = CellRules.of(t)
    return _chain(t, budget, seed, "gibbs", decile_proposals(t, Draws(seed)), rules, None, batch_size, **options)


def dependency_guided(t: AuditTable, budget: float, seed=42, edges: DataFrame | None = None, fitted: bool = True,
                      lam: float = 2.0, batch_size: int = 200, uniform_weights: bool = False, **options) -> Sample:
    """Each step picks a column by dependency priority and proposes rows extreme in it.

    ``edges`` are dependency weights (fitted if absent); ``fitted=False`` runs without any, proposing rows at or
    above the median score.  ``uniform_weights`` estimates without inverse-score weights.
    """
    rules = CellRules.of(t)
    proposals = guided_proposals(t, rules, Draws(seed), edges, fitted)
    method = "dag_uniform" if uniform_weights else "dag"
    return _chain(t, budget, seed, method, proposals, rules, lam, batch_size, uniform_weights=uniform_weights, **options)


# ---- proposal streams ----------------------------------------------------------------------------------------------

def guided_proposals(t: AuditTable, rules: CellRules, draws: Draws, edges: DataFrame | None = None, fitted: bool = True) -> Proposals:
    """Streams by dependency priority, or by score where there are no weights (``fitted=False`` and no ``edges``)."""
    if edges is None and not fitted:
        return high_score_proposals(rules, score_counts(t.df, rules)[None])
    priority = column_priority(t, pairwise_weights(t) if edges is None else edges)
    return extreme_proposals(t, pivot_distribution(priority, t.numeric), draws)


def extreme_proposals(t: AuditTable, pivots: Sequence[tuple[str, float]], draws: Draws) -> Proposals:
    """Rows at or beyond the 5 % or 95 % quantile of a column, or not finite in it; several columns share by chance."""
    if not pivots:
        return Proposals()
    finite = t.df.select(*[F.when(F.abs(as_double(c)) < F.lit(float("inf")), as_double(c)).alias(c) for c, _ in pivots])
    bands = quantile_table(finite, [c for c, _ in pivots], (0.05, 0.95), rows=t.rows).first()
    few = finite.agg(*[F.count(f"`{c}`").alias(c) for c, _ in pivots]).first()
    extreme = {}
    for c, p in pivots:
        if bands[c] is not None and few[c] >= 4:
            low, high = bands[c]
            x = as_double(c)
            extreme[c] = (p, F.coalesce((x <= F.lit(low)) | (x >= F.lit(high)), F.lit(True)))
    if not extreme:
        return Proposals()
    # walk the priorities of the columns this row is extreme in until a uniform share of their sum is passed
    shares = [F.when(hit, F.lit(p)).otherwise(F.lit(0.0)) for p, hit in extreme.values()]
    total = sum(shares, F.lit(0.0))
    goal = draws.uniform("stream", *t.key_cols) * total
    running, stream = F.lit(0.0), F.lit(None).cast("string")
    for c, share in zip(extreme, shares):
        running = running + share
        stream = F.coalesce(stream, F.when((share > 0) & (goal < running), F.lit(c)))
    chances = tuple((c if c in extreme else UNIFORM, p) for c, p in pivots)
    return Proposals(F.coalesce(stream, F.lit(UNIFORM)), chances)


def decile_proposals(t: AuditTable, draws: Draws) -> Proposals:
    """One stream per (numeric column, decile); a row belongs to the decile of one column chosen by hash.

    A band that starts uniformly in [0, 0.9] is snapped to the nearest decile, so the outer two have half a chance.
    """
    columns = t.numeric
    if not columns:
        return Proposals()
    cuts = quantile_table(t.df, columns, [d / 10 for d in range(1, 10)], rows=t.rows).first()
    usable = [c for c in columns if cuts[c] is not None]
    column = draws.integer(max(len(usable), 1), "stream", *t.key_cols)
    stream = F.lit(UNIFORM)
    for i, c in enumerate(usable):
        value = as_double(c)
        below = F.filter(F.array(*[F.lit(cut) for cut in cuts[c]]), lambda cut: cut < value)
        named = F.concat(F.lit(f"{c}#"), F.size(below).cast("string"))
        stream = F.when((column == i) & F.col(f"`{c}`").isNotNull(), named).otherwise(stream)
    chance = {0: 0.5 / 9, 9: 0.5 / 9}
    chances = tuple((f"{c}#{d}", chance.get(d, 1 / 9) / len(usable)) for c in usable for d in range(10))
    return Proposals(stream, chances or ((UNIFORM, 1.0),))


def high_score_proposals(rules: CellRules, scores: ScoreCounts) -> Proposals:
    """Without dependency weights: rows at or above the median score, unless all scores are equal."""
    if len(scores.counts) <= 1:
        return Proposals()
    high = F.when(rules.score() >= F.lit(scores.quantile(0.5)), F.lit("high")).otherwise(F.lit(UNIFORM))
    return Proposals(high, (("high", 1.0),))


# ---- the chain -----------------------------------------------------------------------------------------------------

@dataclass
class ChainState:
    defects: int
    rows: int
    steps: int = 0
    accepted: int = 0


@dataclass
class Walk:
    """A finished chain.  ``rows`` are the narrow rows it took; ``entry`` is how many rows it held before the step that took them."""

    rows: DataFrame
    n: int
    goal: int
    state: ChainState
    # of every round that listed steps: rows at its begin, the bound on its steps that no goal moves, its decisions
    rounds: list[tuple[int, int, DataFrame]] = field(default_factory=list)


def chain_goal(n: int, budget: float, batch_size: int) -> int:
    return min(n, max(batch_size, int(n * budget)))


def _chain(t: AuditTable, budget: float, seed: int, method: str, proposals: Proposals, rules: CellRules,
           lam: float | None, batch_size: int, uniform_weights: bool = False, segment: int = SEGMENT,
           algorithm: str = "md5") -> Sample:
    keys = list(t.key_cols)
    walk = walk_chain(t, budget, seed, proposals, rules, lam, batch_size, segment, algorithm)
    picked, n, goal, state = materialise(walk.rows.drop("entry"), "picked"), walk.n, walk.goal, walk.state
    if state.rows > goal:
        _, trim = smallest(picked, F.col("row_draw"), keys, lambda _: goal)
        picked = picked.where(trim.keeps(F.col("row_draw"), keys))
    # the sampled keys fetch their rows; keys are unique, so no key is hot
    rows = materialise(t.df.join(picked.select(*keys), keys, "left_semi"), method)
    if uniform_weights:
        rows = rows.withColumn(WEIGHT, F.lit(1.0 / max(goal, 1)))
    else:
        rows = with_inverse_weights(rows, rules)
    total = min(goal, state.rows)
    return Sample(t.with_rows(rows, total), n, total, method, WEIGHT, state.steps, state.accepted / max(state.steps, 1), kept=True)


def walk_chain(t: AuditTable, budget: float, seed: int, proposals: Proposals, rules: CellRules, lam: float | None,
               batch_size: int, segment: int = SEGMENT, algorithm: str = "md5", carry: bool = False) -> Walk:
    """Warm start and steps until the budget is reached; the last step may go beyond it.  ``carry``: the rows bring their other columns along."""
    draws = Draws(seed, algorithm)
    cells = max(len(rules.columns), 1)
    keys = list(t.key_cols)

    narrow = materialise(narrow_rows(t, proposals, rules, draws, carry), "chain")
    n, cut = smallest(narrow, F.col("start"), keys, lambda rows: min(batch_size, rows), spread=weight_spread)
    goal = chain_goal(n, budget, batch_size)
    in_start = cut.keeps(F.col("start"), keys)
    warm = materialise(narrow.where(in_start), "warm")
    first = warm.agg(F.coalesce(F.sum("defects"), F.lit(0)).alias("d"), F.count(F.lit(1)).alias("n")).first()
    state = ChainState(first["d"], first["n"])

    return steps_to_goal(narrow.where(~in_start), warm, n, goal, state, keys, proposals, draws, lam, batch_size, cells, segment)


def narrow_rows(t: AuditTable, proposals: Proposals, rules: CellRules, draws: Draws, carry: bool = False) -> DataFrame:
    """Every draw and score once per row, in a narrow table that all later passes read: ``stream`` and ``u_chunk`` are those of the first round.

    ``carry`` adds the columns that are no keys, as the struct CARRIED, which only the passes that fetch sampled rows read.
    """
    keys = list(t.key_cols)
    others = [F.col(f"`{c}`") for c in t.df.columns if c not in keys]
    start = draws.exponential("start", *keys) / (rules.score() + EPSILON)
    return t.df.select(
        *keys, (rules.outlying_cells() + rules.missing_cells()).cast("bigint").alias("defects"), start.alias("start"),
        proposals.stream.alias("home"), *[F.struct(*others).alias(CARRIED)] * bool(carry and others)).withColumns(_streamed(draws, "pool0", keys))


def _streamed(draws: Draws, tag: str, keys: Sequence[str]) -> dict[str, Column]:
    forced = draws.uniform(tag, *keys) < FORCED_SHARE
    return {"u_chunk": draws.uniform(tag, *keys, half=1), "stream": F.when(forced, F.lit(FORCED)).otherwise(F.col("home"))}


def steps_to_goal(pool: DataFrame, warm: DataFrame, n: int, goal: int, state: ChainState, keys: list[str], proposals: Proposals, draws: Draws,
                  lam: float | None, batch_size: int, cells: int, segment: int = SEGMENT, first_round=None) -> Walk:
    """Rounds over the pool until the goal is reached; ``first_round(state)`` replaces the first one."""
    columns = [*keys, "defects", "start", "home", *[c for c in warm.columns if c == CARRIED]]
    taken, left = [warm.select(*columns, F.lit(0).cast("bigint").alias("entry"))], n - state.rows
    round_no, rounds = 0, []
    while state.rows < goal and left > 0:
        if first_round is not None and round_no == 0 and left > batch_size:
            placed, decisions, used, listed = first_round(state)
        else:
            placed, decisions, used, listed = _round(pool, left, keys, proposals, draws, lam, batch_size, goal, cells, state, round_no, segment)
        rounds += listed
        # a chunk is taken once, so the join repeats no row
        taken.append(placed.join(decisions, ["stream", "chunk"]).select(*columns, "entry"))
        left -= used
        if state.rows < goal and left > 0:
            pool = materialise(placed.join(decisions, ["stream", "chunk"], "left_anti").select(*columns), "pool")
        round_no += 1

    picked = taken[0]
    for part in taken[1:]:
        picked = picked.unionByName(part)
    return Walk(picked.withColumn("row_draw", draws.uniform("row", *keys)), n, goal, state, rounds)


def _round(pool, left, key_cols, proposals, draws, lam, batch, goal, cells, state, round_no, segment):
    """One pass over the pool: place rows, reduce chunks, list steps, fold.  Returns the placed pool, the taken chunks,
    how many rows they hold, and the steps for ``Walk.rounds``; updates ``state``."""
    forced_size = max(1, batch // 4)
    tag = f"pool{round_no}"
    if left <= batch:
        return _last_batch(pool, left, key_cols, draws, lam, forced_size, cells, state, round_no)

    streamed = pool.withColumns(_streamed(draws, tag, key_cols)) if round_no else pool
    sizes = {r["stream"]: r["count"] for r in streamed.groupBy("stream").count().collect()}  # a row per stream
    chunks = {s: max(1, c // (forced_size if s == FORCED else batch)) for s, c in sizes.items()}
    counts = small_table(pool.sparkSession, sorted(chunks.items()), "stream string, n_chunks bigint")
    placed = streamed.join(F.broadcast(counts), "stream").withColumn("chunk", F.floor(F.col("u_chunk") * F.col("n_chunks")).cast("bigint")).drop("n_chunks")

    # written once, as it is read for proposals and for forced chunks
    batches = materialise(placed.groupBy("stream", "chunk").agg(F.count(F.lit(1)).alias("size"), F.sum("defects").alias("defects")), "batches")
    return take_chunks(placed, batches, chunks, proposals, draws, lam, forced_size, goal, cells, state, round_no, segment)


def take_chunks(placed: DataFrame, batches: DataFrame, chunks: dict[str, int], proposals: Proposals, draws: Draws, lam: float | None,
                forced_size: int, goal: int, cells: int, state: ChainState, round_no: int, segment: int):
    """List the steps over placed rows and fold them; ``batches`` are the sums of the chunks, ``chunks`` their number per stream."""
    spark = placed.sparkSession
    most = min(sum(c for s, c in chunks.items() if s != FORCED) or 1, chunks.get(FORCED, 1))
    n_steps = min(math.ceil((goal - state.rows) / forced_size), most)
    steps = _steps(spark, n_steps, proposals.chances, chunks, draws, round_no, segment)
    batches = batches.where(F.col("chunk") < n_steps)
    offered = batches.select(F.col("stream").alias("offer"), F.col("chunk").alias("visit"), F.col("size").alias("p_size"), F.col("defects").alias("p_defects"))
    spare = batches.where(F.col("stream") == FORCED).select(F.col("chunk").alias("step"), F.col("size").alias("f_size"), F.col("defects").alias("f_defects"))
    table = steps.join(offered, ["offer", "visit"], "left").join(spare, "step", "left").na.fill(0, ["p_size", "p_defects", "f_size", "f_defects"])
    begin = (state.rows, state.steps)
    decisions = _segments(table, -(-n_steps // segment), state, goal, lam, cells)
    used = state.rows - begin[0]
    inside = Window.partitionBy("segment").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    decisions = decisions.withColumn("entry", F.col("entry_size") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    taken = decisions.where("size > 0").select("stream", "chunk", "entry")
    if used == 0:  # nothing but empty chunks were looked at: take one proposal chunk
        s, c = placed.where(F.col("stream") != FORCED).select("stream", "chunk").orderBy("stream", "chunk").first() or (FORCED, 0)
        row = placed.where((F.col("stream") == s) & (F.col("chunk") == c)).agg(F.count(F.lit(1)).alias("n"), F.sum("defects").alias("d")).first()
        taken, used = small_table(spark, [(s, c, begin[0])], DECISIONS), row["n"]
        state.steps, state.accepted = state.steps + 1, state.accepted + 1
        state.rows, state.defects = state.rows + row["n"], state.defects + row["d"]
    return placed, taken, used, [(begin[0], most, decisions)]


def _last_batch(pool, left, key_cols, draws, lam, forced_size, cells, state, round_no):
    """The rest of the pool is one proposal, accepted like any other; if not, a forced batch of it is taken."""
    spark = pool.sparkSession
    row = pool.agg(F.sum("defects").alias("d")).first()
    u = spark.range(1).select(draws.uniform(f"accept{round_no}", "id").alias("u")).first()["u"]
    rise = (row["d"] / left - state.defects / max(state.rows, 1)) / cells
    accept = lam is None or state.rows == 0 or math.log(u + 1e-12) < lam * rise
    stream = pool.withColumns({"stream": F.lit(UNIFORM), "chunk": F.lit(0).cast("bigint")})
    used, defects, begin = left, row["d"], state.rows
    if not accept and forced_size < left:
        _, cut = smallest(pool, draws.uniform(f"pool{round_no}", *key_cols), key_cols, lambda _: forced_size)
        kept = cut.keeps(draws.uniform(f"pool{round_no}", *key_cols), key_cols)
        stream = materialise(pool.withColumns({"stream": F.lit(UNIFORM), "chunk": F.when(kept, F.lit(0)).otherwise(F.lit(1)).cast("bigint")}), "last")
        got = stream.where("chunk = 0").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("defects"), F.lit(0)).alias("d")).first()
        used, defects = got["n"], got["d"]
    state.steps, state.accepted, state.rows, state.defects = state.steps + 1, state.accepted + int(accept), state.rows + used, state.defects + defects
    return stream, small_table(spark, [(UNIFORM, 0, begin)], DECISIONS), used, []


def _numbered(steps: DataFrame, name: str, by: str) -> DataFrame:
    """Adds how many steps before this one have the same ``by``: counts of earlier segments, and a window inside one."""
    counts = steps.groupBy("segment", by).agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(
        Window.partitionBy(by).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = Window.partitionBy("segment", by).orderBy("step")
    return steps.join(before, ["segment", by]).withColumn(name, (F.col("before") + F.row_number().over(inside) - 1).cast("bigint")).drop("before")


def _steps(spark, n_steps: int, chances, chunks: dict, draws: Draws, round_no: int, segment: int) -> DataFrame:
    """(step, segment, offer, visit, u): the stream each step proposes from and how often it was visited before.

    A stream that has no chunk left falls back to the uniform stream, whose visits are numbered in step order too.
    """
    u = draws.uniform(f"pivot{round_no}", "step")
    pivot, running = F.lit(chances[-1][0]), 1.0
    for s, p in reversed(chances):
        running -= p
        pivot = F.when(u < F.lit(running + p), F.lit(s)).otherwise(pivot)
    steps = spark.range(n_steps).withColumnRenamed("id", "step").withColumns({"pivot": pivot, "segment": F.floor(F.col("step") / segment).cast("bigint")})
    limit = F.coalesce(F.element_at(F.create_map(*[x for s, c in sorted(chunks.items()) for x in (F.lit(s), F.lit(c))]), F.col("pivot")), F.lit(0))
    steps = _numbered(steps, "turn", "pivot")
    steps = steps.withColumn("offer", F.when(F.col("turn") < limit, F.col("pivot")).otherwise(F.lit(UNIFORM)))
    return _numbered(steps, "visit", "offer").withColumn("u", draws.uniform(f"accept{round_no}", "step")).select("step", "segment", "offer", "visit", "u")


def _segments(table: DataFrame, n_segments: int, state: ChainState, goal: int, lam: float | None, cells: int) -> DataFrame:
    """Fold the steps until the goal is reached, all segments at once; updates ``state``.

    Returns the decisions (segment, entry_size, step, stream, chunk, size, defects, accepted) of the steps used.
    """
    columns = ["step", "offer", "visit", "u", "p_size", "p_defects", "f_size", "f_defects"]
    steps = F.array_sort(F.collect_list(F.struct(*columns)))
    listed = materialise(table.groupBy("segment").agg(steps.alias("steps")), "steps")
    exact = _corrected(_predicted(listed, state, lam, cells), n_segments, state, goal, lam, cells)
    while True:
        folds = materialise(_folded(listed, exact, goal, lam, cells), "folds")
        exact = _corrected(folds, n_segments, state, goal, lam, cells)
        if n_segments == 1 or exact.where("again").isEmpty():  # the first segment's entry state is always exact
            break
    used = exact.where(F.col("entry_size") < goal).select("segment", "entry_size", F.posexplode("decided").alias("place", "accepted"))
    used = used.join(listed, "segment").withColumn("s", F.get("steps", F.col("place"))).drop("steps")

    def either(yes, no):
        return F.when(F.col("accepted"), yes).otherwise(no)

    decisions = materialise(used.select(
        "segment", "entry_size", "s.step", either(F.col("s.offer"), F.lit(FORCED)).alias("stream"), either(F.col("s.visit"), F.col("s.step")).cast("bigint").alias("chunk"),
        either(F.col("s.p_size"), F.col("s.f_size")).cast("bigint").alias("size"),
        either(F.col("s.p_defects"), F.col("s.f_defects")).cast("bigint").alias("defects"), "accepted"), "decisions")
    row = decisions.agg(F.count(F.lit(1)).alias("steps"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("size", "defects")],
                        F.coalesce(F.sum(F.col("accepted").cast("bigint")), F.lit(0)).alias("accepted")).first()
    state.steps, state.rows = state.steps + row["steps"], state.rows + row["size"]
    state.accepted, state.defects = state.accepted + row["accepted"], state.defects + row["defects"]
    return decisions


def _accepts(s, have: Column, size: Column, lam: float | None, cells: int) -> tuple[Column, Column]:
    """Whether a step is accepted at a running mean of have / size, and how far that is from the other outcome."""
    if lam is None:
        return s["p_size"] > 0, F.lit(float("inf"))
    rise = (s["p_defects"] / F.nullif(s["p_size"], F.lit(0)) - have / F.nullif(size, F.lit(0))) / cells
    bar = F.ln(s["u"] + 1e-12)
    accept = (s["p_size"] > 0) & F.coalesce(bar < lam * rise, F.lit(True))
    return accept, F.when(s["p_size"] == 0, F.lit(float("inf"))).otherwise(F.coalesce(F.abs(lam * rise - bar), F.lit(0.0)))


def _predicted(listed: DataFrame, state: ChainState, lam: float | None, cells: int) -> DataFrame:
    """Sums of the segments if every step met the mean the chain begins with."""
    def took(column: str) -> Column:
        def add(total, s):
            accept, _ = _accepts(s, F.lit(state.defects), F.lit(state.rows), lam, cells)
            return total + F.when(accept, s[f"p_{column}"]).otherwise(s[f"f_{column}"])
        return F.aggregate("steps", F.lit(0).cast("bigint"), add)

    unknown = {"entry_defects": "bigint", "entry_size": "bigint", "slack": "double", "low": "double", "high": "double", "decided": "array<boolean>", "steps_listed": "int"}
    return listed.select("segment", took("defects").alias("defects"), took("size").alias("size"), *[F.lit(None).cast(k).alias(c) for c, k in unknown.items()])


def _corrected(folds: DataFrame, n_segments: int, state: ChainState, goal: int, lam: float | None, cells: int) -> DataFrame:
    """The folds with entry states from their sums, and ``again`` where the decisions may differ with these.

    A segment whose entry state moves by (dd, dn) sees its means move by at most max |dd - m dn| / n, m being a mean it
    met and n the rows at its entry.  Segments that begin at or after the goal are not folded.
    """
    corrected = totals_before(folds, "segment", ["defects", "size"], rows=n_segments).withColumns({
        "new_defects": F.col("before_defects") + state.defects, "new_size": F.col("before_size") + state.rows})
    moved, grown = F.col("new_defects") - F.col("entry_defects"), F.col("new_size") - F.col("entry_size")
    reach = F.greatest(F.abs(moved - F.col("low") * grown), F.abs(moved - F.col("high") * grown)) / F.greatest(F.col("new_size"), F.lit(1))
    near = reach * ((lam or 0.0) / cells) * (1 + 1e-9) + F.when(reach > 0, F.lit(1e-9)).otherwise(F.lit(0.0)) >= F.col("slack")
    stops = (grown != 0) & ((F.size("decided") < F.col("steps_listed")) | (F.col("new_size") + F.col("size") >= goal))
    same = (moved == 0) & (grown == 0)
    again = (F.col("new_size") < goal) & (F.col("decided").isNull() | (~same & (near | stops)))
    return corrected.select("segment", F.col("new_defects").alias("entry_defects"), F.col("new_size").alias("entry_size"), "defects", "size", "slack", "low", "high",
                                 "decided", "steps_listed", F.coalesce(again, F.lit(True)).alias("again"))


def _folded(listed: DataFrame, entries: DataFrame, goal: int, lam: float | None, cells: int) -> DataFrame:
    """Folds the segments marked ``again`` from their entry states, each in one ``aggregate`` over its steps; keeps the others."""
    begin = F.struct(F.col("entry_defects").alias("have"), F.col("entry_size").alias("size"), F.lit(float("inf")).alias("slack"),
                     F.lit(float("inf")).alias("low"), F.lit(float("-inf")).alias("high"), F.array().cast("array<boolean>").alias("decided"))

    def step(now, s):
        accept, slack = _accepts(s, now["have"], now["size"], lam, cells)
        mean = F.coalesce(now["have"] / F.nullif(now["size"], F.lit(0)), F.lit(0.0))
        after = F.struct((now["have"] + F.when(accept, s["p_defects"]).otherwise(s["f_defects"])).alias("have"),
                         (now["size"] + F.when(accept, s["p_size"]).otherwise(s["f_size"])).alias("size"),
                         F.least(now["slack"], slack).alias("slack"), F.least(now["low"], mean).alias("low"), F.greatest(now["high"], mean).alias("high"),
                         F.array_append(now["decided"], accept).alias("decided"))
        return F.when(now["size"] >= goal, now).otherwise(after)

    todo = entries.where("again").join(listed, "segment").withColumn("end", F.aggregate("steps", begin, step))
    folded = todo.select("segment", "entry_defects", "entry_size", (F.col("end.have") - F.col("entry_defects")).alias("defects"), (F.col("end.size") - F.col("entry_size")).alias("size"),
                         "end.slack", "end.low", "end.high", "end.decided", F.size("steps").alias("steps_listed"), "again")
    return folded.unionByName(entries.where(~F.col("again")))
