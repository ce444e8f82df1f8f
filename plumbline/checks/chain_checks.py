"""Chain samplers: the rows they end with and the profile they give, checked against a recursive query."""
from __future__ import annotations

import math

from ..operators import chains
from ..operators.profile import INDICATORS
from .base import (DIRTY_CTE, DIRTY_KEY, LINE_RULES, MEASURED, NUMBERS, SCORED_CTE, Check, d, dirty_lines, expo,
                   profile_sql, rounded, u)

B, SEED, BATCH, LAM = 0.1, 42, 500, 2.0
FORCED = BATCH // 4
KEYS = ", ".join(DIRTY_KEY)


def _draw(spark, folder, method, **options):
    return getattr(chains, method)(dirty_lines(spark, folder), B, SEED, batch_size=BATCH, **options)


def _keys(method, **options):
    def run(spark, folder):
        return _draw(spark, folder, method, **options).df.select(*DIRTY_KEY)
    return run


def _profile(method, **options):
    def run(spark, folder):
        return rounded(_draw(spark, folder, method, **options).profile()).select(*INDICATORS, "sample_size", "n_records")
    return run


def guided_without_weights(spark, folder):
    """No dependency weights: proposals come from the rows at or above the median score."""
    return _draw(spark, folder, "dependency_guided", fitted=False).df.select(*DIRTY_KEY)


# ---- SQL: one pass over the pool ------------------------------------------------------------------------------------

def chain_sql(home: str, pivots: str, joins: str = "", extra: str = "", lam: float | None = LAM, weight: str = "inverse",
              budget: float = B) -> str:
    """``pivots`` is a SELECT of (place, stream, p); ``home`` names the stream of a row of ``scored s``."""
    step_draw = u(SEED, "pivot0", "step")
    accept = "TRUE" if lam is None else (
        f"ln({u(SEED, 'accept0', 's.step')} + 1e-12::DOUBLE) < {d(lam)} * (s.p_defects / s.p_size::DOUBLE - f.have / f.size::DOUBLE) / 4")
    took = f"(s.p_size > 0 AND {accept})"
    w = "1.0::DOUBLE" if weight == "none" else "least(1.0 / (score + 1e-6::DOUBLE), cap)"
    return f"""WITH RECURSIVE {DIRTY_CTE}, {SCORED_CTE}, {extra}
size AS (SELECT CAST(count(*) AS BIGINT) AS n, greatest({BATCH}, CAST(floor(count(*) * {d(budget)}) AS BIGINT)) AS goal FROM scored),
narrow AS MATERIALIZED (SELECT s.*, o + m AS defects, {home} AS home, {expo(SEED, 'start', *DIRTY_KEY)} / (score + 1e-6::DOUBLE) AS start_draw,
  {u(SEED, 'row', *DIRTY_KEY)} AS row_draw FROM scored s {joins}),
ranked AS (SELECT *, row_number() OVER (ORDER BY start_draw, {KEYS}) AS rn FROM narrow),
streamed AS (SELECT *, CASE WHEN {u(SEED, 'pool0', *DIRTY_KEY)} < 0.2 THEN 'forced' ELSE home END AS stream FROM ranked WHERE rn > {BATCH}),
chunks AS (SELECT stream, greatest(1, count(*) // CASE WHEN stream = 'forced' THEN {FORCED} ELSE {BATCH} END) AS n_chunks FROM streamed GROUP BY stream),
placed AS MATERIALIZED (SELECT t.*, CAST(floor({u(SEED, 'pool0', *DIRTY_KEY, half=1)} * n_chunks) AS BIGINT) AS chunk FROM streamed t JOIN chunks USING (stream)),
batches AS (SELECT stream, chunk, CAST(count(*) AS BIGINT) AS size, CAST(sum(defects) AS BIGINT) AS defects FROM placed GROUP BY stream, chunk),
n_steps AS (SELECT least((SELECT CAST(ceil((goal - {BATCH}) / {FORCED}.0) AS BIGINT) FROM size), (SELECT CAST(sum(n_chunks) AS BIGINT) FROM chunks WHERE stream <> 'forced'),
  (SELECT n_chunks FROM chunks WHERE stream = 'forced')) AS n),
pivots AS (SELECT stream, sum(p) OVER (ORDER BY place) AS upto FROM ({pivots}) p),
listed AS (SELECT step, (SELECT min_by(stream, upto) FROM pivots WHERE {step_draw} < upto) AS focal FROM range((SELECT n FROM n_steps)) r(step)),
turns AS (SELECT step, CASE WHEN row_number() OVER (PARTITION BY focal ORDER BY step) - 1 < coalesce(n_chunks, 0) THEN focal ELSE 'uniform' END AS offer
  FROM listed LEFT JOIN chunks ON stream = focal),
visits AS (SELECT step, offer, row_number() OVER (PARTITION BY offer ORDER BY step) - 1 AS visit FROM turns),
steps AS MATERIALIZED (SELECT step, offer, visit, coalesce(p.size, 0) AS p_size, coalesce(p.defects, 0) AS p_defects, coalesce(f.size, 0) AS f_size, coalesce(f.defects, 0) AS f_defects
  FROM visits LEFT JOIN batches p ON p.stream = offer AND p.chunk = visit LEFT JOIN batches f ON f.stream = 'forced' AND f.chunk = step),
fold AS (SELECT CAST(-1 AS BIGINT) AS step, CAST(sum(defects) AS BIGINT) AS have, CAST(count(*) AS BIGINT) AS size, FALSE AS took FROM ranked WHERE rn <= {BATCH}
  UNION ALL SELECT s.step, f.have + CASE WHEN {took} THEN s.p_defects ELSE s.f_defects END, f.size + CASE WHEN {took} THEN s.p_size ELSE s.f_size END, {took}
  FROM fold f JOIN steps s ON s.step = f.step + 1 WHERE f.size < (SELECT goal FROM size)),
taken AS (SELECT CASE WHEN took THEN offer ELSE 'forced' END AS stream, CASE WHEN took THEN visit ELSE step END AS chunk FROM fold JOIN steps USING (step)),
chosen AS (SELECT {KEYS}, row_draw FROM ranked WHERE rn <= {BATCH} UNION ALL SELECT {KEYS}, row_draw FROM placed SEMI JOIN taken USING (stream, chunk)),
trimmed AS (SELECT {KEYS} FROM (SELECT *, row_number() OVER (ORDER BY row_draw, {KEYS}) AS place FROM chosen) c WHERE place <= (SELECT goal FROM size)),
kept AS (SELECT s.* FROM scored s SEMI JOIN trimmed USING ({KEYS})),
cap AS (SELECT quantile_cont(1.0 / (score + 1e-6::DOUBLE), 0.95) AS cap FROM kept),
picked AS (SELECT kept.*, {w} / sum({w}) OVER () AS w FROM kept CROSS JOIN cap) """


UNIFORM = "SELECT 0 AS place, 'uniform' AS stream, 1.0::DOUBLE AS p"
MH = chain_sql("'uniform'", UNIFORM)

_cuts = ", ".join(f"quantile_cont({c}, {q / 10}) AS cut_{i}_{q}" for i, c in enumerate(NUMBERS) for q in range(1, 10))
_home = " ".join(
    f"WHEN CAST(floor({u(SEED, 'stream', *DIRTY_KEY)} * 4.0::DOUBLE) AS INTEGER) = {i} AND s.{c} IS NOT NULL THEN '{c}#' || CAST("
    + " + ".join(f"CASE WHEN cut_{i}_{q} < s.{c} THEN 1 ELSE 0 END" for q in range(1, 10)) + " AS VARCHAR)"
    for i, c in enumerate(NUMBERS))
_bands = " UNION ALL ".join(f"SELECT {10 * i + q} AS place, '{c}#{q}' AS stream, {d((0.5 if q in (0, 9) else 1.0) / 9 / 4)} AS p"
                            for i, c in enumerate(NUMBERS) for q in range(10))
GIBBS = chain_sql(f"CASE {_home} ELSE 'uniform' END", _bands, "CROSS JOIN cuts", f"cuts AS (SELECT {_cuts} FROM dirty_lines),", lam=None)

_degree = {c: " + ".join(f"abs(corr(coalesce({min(c, e)}, 0), coalesce({max(c, e)}, 0)))" for e in NUMBERS if e != c) for c in NUMBERS}
_raw = ", ".join(f"{_degree[c]} + 1.0 / {len(MEASURED)} AS g_{i}" for i, c in enumerate(NUMBERS))
_total = " + ".join(f"g_{i}" for i in range(4))
_priority = (f"degree AS (SELECT {_raw} FROM dirty_lines), priority AS (SELECT {', '.join(f'g_{i} / ({_total}) AS p_{i}' for i in range(4))} FROM degree), "
             f"bands AS (SELECT {', '.join(f'quantile_cont({c}, 0.05) AS a_{i}, quantile_cont({c}, 0.95) AS z_{i}' for i, c in enumerate(NUMBERS))} FROM dirty_lines), "
             "marked AS (SELECT s.*, " + ", ".join(f"CASE WHEN coalesce(s.{c} <= a_{i} OR s.{c} >= z_{i}, TRUE) THEN p_{i} ELSE 0.0 END AS h_{i}" for i, c in enumerate(NUMBERS))
             + " FROM dirty_lines s CROSS JOIN priority CROSS JOIN bands),")
_sum_h = " + ".join(f"h_{i}" for i in range(4))
_walk = " ".join(f"WHEN h_{i} > 0 AND {u(SEED, 'stream', *[f's.{k}' for k in DIRTY_KEY])} * ({_sum_h}) < {' + '.join(f'h_{j}' for j in range(i + 1))} THEN '{c}'"
                 for i, c in enumerate(NUMBERS))
_pivots = " UNION ALL ".join(f"SELECT {i} AS place, '{c}' AS stream, p_{i} AS p FROM priority" for i, c in enumerate(NUMBERS))
_marked = f"JOIN (SELECT {KEYS}, h_0, h_1, h_2, h_3 FROM marked) h ON " + " AND ".join(f"h.{k} = s.{k}" for k in DIRTY_KEY)


def _dag(weight="inverse", budget=B):
    sql = chain_sql(f"CASE {_walk} ELSE 'uniform' END", _pivots, _marked, _priority, weight=weight, budget=budget)
    # inside ``narrow`` the key exists on both sides of the join
    draws = sql.index("narrow AS"), sql.index("ranked AS")
    body = sql[draws[0]:draws[1]]
    for k in DIRTY_KEY:
        body = body.replace(f"CAST({k} AS VARCHAR)", f"CAST(s.{k} AS VARCHAR)")
    return sql[:draws[0]] + body + sql[draws[1]:]


HIGH = chain_sql("CASE WHEN score >= mid THEN 'high' ELSE 'uniform' END", "SELECT 0 AS place, 'high' AS stream, 1.0::DOUBLE AS p",
                 "CROSS JOIN median", "median AS (SELECT quantile_cont(score, 0.5) AS mid FROM scored),")
PICK = f"SELECT {KEYS} FROM picked"


def _estimate(sql: str) -> str:
    return sql + ("SELECT p.*, (SELECT n FROM size) AS n_records FROM (" + profile_sql("picked", MEASURED, NUMBERS, LINE_RULES, weight="w") + ") p")


def batch_sweep_sql(method: str, batches) -> str:
    """SELECT of (method, batch_size, rates, sizes): each batch size over the leaves that all of them share."""
    unit, forced_unit, parts = math.gcd(*batches), math.gcd(*[b // 4 for b in batches]), []
    for b in batches:
        sql = _dag() if method == "dag" else MH
        begin, end = sql.index("streamed AS ("), sql.index("batches AS (")
        per = f"CASE WHEN stream = 'forced' THEN {b // 4 // forced_unit} ELSE {b // unit} END"
        placing = f"""streamed AS (SELECT *, CASE WHEN {u(SEED, 'pool0', *DIRTY_KEY)} < 0.2 THEN 'forced' ELSE home END AS stream FROM ranked),
leaves AS (SELECT stream, greatest(1, count(*) // CASE WHEN stream = 'forced' THEN {forced_unit} ELSE {unit} END) AS n_leaves FROM streamed GROUP BY stream),
chunks AS (SELECT stream, (n_leaves + {per} - 1) // {per} AS n_chunks FROM leaves),
placed AS MATERIALIZED (SELECT t.*, CAST(floor({u(SEED, 'pool0', *DIRTY_KEY, half=1)} * n_leaves) AS BIGINT) // {per} AS chunk FROM streamed t JOIN leaves USING (stream) WHERE rn > {BATCH}),
"""
        sql = sql[:begin] + placing + sql[end:]
        for old, new in ((f"greatest({BATCH}, CAST", f"greatest({b}, CAST"), (f"rn > {BATCH})", f"rn > {b})"), (f"rn <= {BATCH}", f"rn <= {b}"),
                         (f"(goal - {BATCH}) / {FORCED}.0", f"(goal - {b}) / {b // 4}.0")):
            assert old in sql, old
            sql = sql.replace(old, new)
        sql += (f"SELECT '{method}' AS method, {b} AS batch_size, p.*, (SELECT n FROM size) AS n_records FROM ("
                + profile_sql("picked", MEASURED, NUMBERS, LINE_RULES, weight="w", digits=None) + ") p")
        parts.append(f"SELECT * FROM ({sql}) x")
    return " UNION ALL ".join(parts)


def single_runs_sql(method: str, budgets, levels) -> str:
    """SELECT of (budget, clip_percentile, rates, sample_size): one chain per budget, each by itself, and every clip level."""
    parts = []
    for b in budgets:
        sql = _dag(budget=b) if method == "dag" else chain_sql("'uniform'", UNIFORM, budget=b)
        sql = sql[:sql.rindex("cap AS (")]
        listed = " UNION ALL ".join(f"SELECT '{name}' AS clip_percentile, {'max(NULL::DOUBLE)' if p is None else f'quantile_cont(1.0 / (score + 1e-6::DOUBLE), {p})'} AS cap FROM kept"
                                    for name, p in levels.items())
        raw = "least(1.0 / (score + 1e-6::DOUBLE), coalesce(cap, 1.0 / (score + 1e-6::DOUBLE)))"
        sql += (f"caps AS ({listed}), picked AS (SELECT kept.*, clip_percentile, {raw} / sum({raw}) OVER (PARTITION BY clip_percentile) AS w FROM kept CROSS JOIN caps) "
                f"SELECT '{method}' AS method, {d(b)} AS budget, p.*, (SELECT n FROM size) AS n_records FROM ("
                + profile_sql("picked", MEASURED, NUMBERS, LINE_RULES, ["clip_percentile"], weight="w", digits=None) + ") p")
        parts.append(f"SELECT * FROM ({sql}) x")
    return " UNION ALL ".join(parts)


CHECKS = {
    "sample_mh": Check(_keys("metropolis_hastings"), MH + PICK),
    "sample_gibbs": Check(_keys("gibbs"), GIBBS + PICK),
    "sample_dag": Check(_keys("dependency_guided"), _dag() + PICK),
    "sample_without_weights": Check(guided_without_weights, HIGH + PICK),
    "profile_mh": Check(_profile("metropolis_hastings"), _estimate(MH)),
    "profile_gibbs": Check(_profile("gibbs"), _estimate(GIBBS)),
    "profile_dag": Check(_profile("dependency_guided"), _estimate(_dag())),
    "profile_dag_uniform": Check(_profile("dependency_guided", uniform_weights=True), _estimate(_dag("none"))),
}
