"""DuckDB SQL of the registered queries: recursions as recursive tables over rows of (sequence, step, state)."""

from __future__ import annotations

import numpy as np

from hiddenpath.model import ContinuousHmm, DiscreteHmm, Hmm
from hiddenpath.plans.catalog import _PAIR, BACKGROUND, BIVARIATE, BOUNDED, EVENTS, MIXED, NORMAL, ORDER1, OTHER, PLAIN, SILENT, SWITCHING, TAILS

_LIST = ", ".join(f"'{e}'" for e in EVENTS)
#: Steps of all sequences: code, value, the code before, and whether the value is 250 or more.
S = f"s AS MATERIALIZED (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS t, list_position([{_LIST}], event_type) - 1 AS sym, lag(list_position([{_LIST}], event_type) - 1) OVER (PARTITION BY user_id ORDER BY ts) AS prev, value AS x, CAST(value >= 250 AS INTEGER) AS high, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


def _literal(x: object) -> str:
    """Reals with an exponent: plain ones would be decimals."""
    return f"{x!r}e0" if isinstance(x, float) and "e" not in repr(x) else repr(x)


def _values(head: str, rows: list[tuple]) -> str:
    return f"{head} AS (VALUES {', '.join('(' + ', '.join(_literal(x) for x in r) + ')' for r in rows)})"


def _chain(model: Hmm, k: str = "") -> str:
    tr = [(c, i, j, float(p)) for (c, i, j), p in np.ndenumerate(model.a) if p > 0]
    ini = [(i, float(p)) for i, p in enumerate(model.pi) if p > 0]
    return _values(f"tr{k}(c, src, dst, p)", tr) + ", " + _values(f"ini{k}(st, p)", ini)


def _emissions(model: Hmm, k: str = "") -> str:
    """A table e(id, t, st, p)."""
    if isinstance(model, DiscreteHmm):
        rows = [(i, x, float(p)) for i, b in enumerate(model.b) for x, p in enumerate(b) if p > 0 and len(b) == 5]
        longer = [(i, x // 5, x % 5, float(p)) for i, b in enumerate(model.b) for x, p in enumerate(b) if len(b) == 25]
        out = _values(f"em{k}(st, sym, p)", rows) + f", e{k} AS (SELECT s.id, s.t, em.st, em.p FROM s JOIN em{k} em ON em.sym = s.sym"
        return (_values("em1(st, prev, sym, p)", longer) + ", " + out + " UNION ALL SELECT s.id, s.t, em1.st, em1.p FROM s JOIN em1 ON em1.sym = s.sym AND em1.prev = s.prev)") if longer else out + ")"
    assert isinstance(model, ContinuousHmm)
    parts = []
    for i, comps in enumerate(model.components):
        terms = [f"{c.weight} * (CASE WHEN x BETWEEN {c.lo} AND {c.hi} THEN 1 / {c.hi - c.lo} ELSE 0 END)" if c.kind == "uniform" else f"{c.weight} * exp(-pow(x - {c.mean}, 2) / {2 * c.var}) / sqrt(2 * pi() * {c.var})" for c in comps]
        parts.append(f"SELECT id, t, {i} AS st, {' + '.join(terms)} AS p FROM s")
    return f"e{k} AS ({' UNION ALL '.join(parts)})"


def _forward(k: str = "", cls: str = "0", allow: str = "true") -> str:
    """f(id, t, st, v): unscaled forward values. ``cls``: class of the step before; ``allow``: which states a step may have."""
    return (
        f"f{k}(id, t, st, v) AS (SELECT e.id, e.t, e.st, ini.p * e.p FROM e{k} e JOIN ini{k} ini USING (st) JOIN s USING (id, t) WHERE e.t = 0 AND {allow} UNION ALL "
        f"SELECT e.id, e.t, e.st, sum(f.v * tr.p) * any_value(e.p) FROM f{k} f JOIN s p ON p.id = f.id AND p.t = f.t JOIN tr{k} tr ON tr.src = f.st AND tr.c = {cls} JOIN e{k} e ON e.id = f.id AND e.t = f.t + 1 AND e.st = tr.dst "
        f"JOIN s ON s.id = e.id AND s.t = e.t WHERE {allow} GROUP BY e.id, e.t, e.st)"
    )


def _backward() -> str:
    return (
        "b(id, t, st, v) AS (SELECT s.id, s.t, q.st, CAST(1 AS DOUBLE) FROM s CROSS JOIN (SELECT DISTINCT src AS st FROM tr) q WHERE s.t = s.n - 1 UNION ALL "
        "SELECT b.id, b.t - 1, tr.src, sum(tr.p * e.p * b.v) FROM b JOIN tr ON tr.dst = b.st JOIN e ON e.id = b.id AND e.t = b.t AND e.st = b.st WHERE b.t > 0 GROUP BY b.id, b.t, tr.src)"
    )


def _viterbi(cls: str = "0") -> str:
    return (
        "v(id, t, st, v, src) AS (SELECT e.id, e.t, e.st, ln(ini.p) + ln(e.p), -1 FROM e JOIN ini USING (st) WHERE e.t = 0 UNION ALL "
        f"SELECT e.id, e.t, e.st, max(v.v + ln(tr.p)) + ln(any_value(e.p)), arg_max(v.st, v.v + ln(tr.p)) FROM v JOIN s p ON p.id = v.id AND p.t = v.t JOIN tr ON tr.src = v.st AND tr.c = {cls} JOIN e ON e.id = v.id AND e.t = v.t + 1 AND e.st = tr.dst GROUP BY e.id, e.t, e.st), "
        "w(id, t, st, src, lp) AS (SELECT s.id, s.t, arg_max(v.st, v.v), arg_max(v.src, v.v), max(v.v) FROM v JOIN s USING (id, t) WHERE s.t = s.n - 1 GROUP BY s.id, s.t UNION ALL SELECT v.id, v.t, v.st, v.src, w.lp FROM w JOIN v ON v.id = w.id AND v.t = w.t - 1 AND v.st = w.src)"
    )


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + " "


def _logp(model: Hmm, **how: str) -> str:
    return _with(S, _chain(model), _emissions(model), _forward(**how)) + "SELECT f.id AS seq_id, round(ln(sum(f.v)), 4) AS logp FROM f JOIN s USING (id, t) WHERE s.t = s.n - 1 GROUP BY f.id"


_TWO = _with(S, _chain(PLAIN, "x"), _emissions(PLAIN, "x"), _forward("x"), _chain(OTHER, "y"), _emissions(OTHER, "y"), _forward("y")) + "lx AS (SELECT f.id, ln(sum(f.v)) AS l FROM fx f JOIN s USING (id, t) WHERE s.t = s.n - 1 GROUP BY f.id), ly AS (SELECT f.id, ln(sum(f.v)) AS l FROM fy f JOIN s USING (id, t) WHERE s.t = s.n - 1 GROUP BY f.id), z AS (SELECT id, lx.l AS p, ly.l AS q FROM lx JOIN ly USING (id)) "
_TWO = _TWO.replace(" lx AS", ", lx AS", 1)
_PATH = "SELECT id AS seq_id, string_agg(st, ',' ORDER BY t) AS path, round(any_value(lp), 4) AS logp FROM w GROUP BY id"
# the silent state taken out: what passes through it becomes a transition of its own
_thru = SILENT.a[0][:2, :2] + np.outer(SILENT.a[0][:2, 2], SILENT.a[0][2, :2]) / (1 - SILENT.a[0][2, 2])
_LOUD = DiscreteHmm(pi=SILENT.pi[:2], a=_thru, b=SILENT.b[:2], alphabet=EVENTS)
_A0 = "CASE WHEN s.t = 0 THEN ln(i.p) ELSE ln(tr.p) END"

ORACLE_SQL: dict[str, str] = {
    "seq_build": _with(S) + "SELECT id AS seq_id, CAST(count(*) AS INTEGER) AS n, string_agg(sym, ',' ORDER BY t) AS obs FROM s GROUP BY id",
    "symbol_counts": _with(S) + "SELECT CAST(sym AS INTEGER) AS symbol, count(*) AS n FROM s GROUP BY sym",
    "bigram_counts": _with(S) + "SELECT CAST(prev AS INTEGER) AS src, CAST(sym AS INTEGER) AS dst, count(*) AS n FROM s WHERE prev IS NOT NULL GROUP BY ALL",
    "forward_logp": _logp(PLAIN),
    "forward_logp_arrow": _logp(PLAIN),
    "filtered_states": _with(S, _chain(PLAIN), _emissions(PLAIN), _forward()) + "SELECT f.id AS seq_id, CAST(f.st AS INTEGER) AS state, round(f.v / sum(f.v) OVER (PARTITION BY f.id), 6) AS p FROM f JOIN s USING (id, t) WHERE s.t = s.n - 1",
    "posterior_at": _with(S, _chain(PLAIN), _emissions(PLAIN), _forward(), _backward()) + "SELECT id AS seq_id, CAST(st AS INTEGER) AS state, round(f.v * b.v / sum(f.v * b.v) OVER (PARTITION BY id), 6) AS p FROM f JOIN b USING (id, t, st) WHERE t = 10",
    "viterbi_path": _with(S, _chain(PLAIN), _emissions(PLAIN), _viterbi()) + _PATH,
    "viterbi_labels": _with(S, _chain(PLAIN), _emissions(PLAIN), _viterbi()) + "SELECT id AS seq_id, string_agg(CASE WHEN st = 0 THEN '0' ELSE '1' END, ',' ORDER BY t) AS labels FROM w GROUP BY id",
    "joint_logp": _with(S, _chain(PLAIN), _emissions(PLAIN)) + f"SELECT s.id AS seq_id, round(sum({_A0} + ln(e.p)), 4) AS logp FROM s JOIN e ON e.id = s.id AND e.t = s.t AND e.st = s.sym % 3 LEFT JOIN ini i ON i.st = s.sym % 3 LEFT JOIN tr ON tr.src = s.prev % 3 AND tr.dst = s.sym % 3 GROUP BY s.id",
    "normal_logp": _logp(NORMAL),
    "mixed_logp": _logp(MIXED),
    "normal_viterbi": _with(S, _chain(NORMAL), _emissions(NORMAL), _viterbi()) + _PATH,
    "labelled_logp": _logp(PLAIN, allow="(e.st > 0) = (s.high = 1)"),
    "switching_logp": _logp(SWITCHING, cls="p.high"),
    "switching_viterbi": _with(S, _chain(SWITCHING), _emissions(SWITCHING), _viterbi("p.high")) + _PATH,
    "order1_logp": _logp(ORDER1),
    "silent_logp": _logp(_LOUD),
    "em_step": _with(S, _chain(PLAIN), _emissions(PLAIN), _forward(), _backward())
    + ", z AS (SELECT f.id, sum(f.v) AS v FROM f JOIN s USING (id, t) WHERE s.t = s.n - 1 GROUP BY f.id), g AS (SELECT id, t, st, f.v * b.v / z.v AS p FROM f JOIN b USING (id, t, st) JOIN z USING (id)) "
    "SELECT 'pi' AS stat, 0 AS i, CAST(st AS INTEGER) AS j, round(sum(p), 4) AS value FROM g WHERE t = 0 GROUP BY st "
    "UNION ALL SELECT 'b', CAST(st AS INTEGER), CAST(sym AS INTEGER), round(sum(p), 4) FROM g JOIN s USING (id, t) GROUP BY st, sym "
    "UNION ALL SELECT 'a', CAST(tr.src AS INTEGER), CAST(tr.dst AS INTEGER), round(sum(f.v * tr.p * e.p * b.v / z.v), 4) FROM f JOIN tr ON tr.src = f.st JOIN e ON e.id = f.id AND e.t = f.t + 1 AND e.st = tr.dst JOIN b ON b.id = f.id AND b.t = e.t AND b.st = tr.dst JOIN z ON z.id = f.id GROUP BY tr.src, tr.dst",
    "normal_em_step": _with(S, _chain(NORMAL), _emissions(NORMAL), _forward(), _backward())
    + ", z AS (SELECT f.id, sum(f.v) AS v FROM f JOIN s USING (id, t) WHERE s.t = s.n - 1 GROUP BY f.id), g AS (SELECT st, s.x, f.v * b.v / z.v AS p FROM f JOIN b USING (id, t, st) JOIN z USING (id) JOIN s USING (id, t)) "
    "SELECT CAST(st AS INTEGER) AS state, round(sum(p * x) / sum(p), 4) AS mean, round(sum(p * pow(x - CASE st WHEN 0 THEN 80.0 WHEN 1 THEN 220.0 ELSE 400.0 END, 2)) / sum(p), 3) AS var FROM g GROUP BY st",
    "bayes_classify": _TWO + "SELECT id AS seq_id, CASE WHEN p >= q THEN 0 ELSE 1 END AS model_id, round(1 / (1 + exp(-abs(p - q))), 6) AS posterior FROM z",
    "best_model": _TWO + "SELECT id AS seq_id, CASE WHEN p >= q THEN 0 ELSE 1 END AS model_id, round(greatest(p, q), 4) AS logp FROM z",
    "ranked": f"SELECT * FROM ({_logp(PLAIN)}) ORDER BY logp DESC, seq_id LIMIT 20",
    "set_logp": _TWO + "SELECT round(sum(p), 2) AS logp, count(*) AS n FROM z",
    "mixture_logp": _TWO + "SELECT round(sum(greatest(p, q) + ln(0.3 * exp(p - greatest(p, q)) + 0.7 * exp(q - greatest(p, q)))), 2) AS logp FROM z",
    "mixture_decode": _TWO + ", r AS (SELECT id, p >= q AS first, 1 / (1 + exp(-abs(p - q))) AS h, 1 / (1 + exp(abs(p - q))) AS l FROM z) SELECT id AS seq_id, CASE WHEN -h * ln(h) - l * ln(l) <= 0.3 THEN CASE WHEN first THEN 0 ELSE 1 END END AS model_id, round(-h * ln(h) - l * ln(l), 5) AS entropy FROM r",
    "log_odds": _TWO + "SELECT id AS seq_id, round(CASE id % 2 WHEN 0 THEN p - q ELSE q - p END, 4) AS odds, round(1 / (1 + exp(CASE id % 2 WHEN 0 THEN q - p ELSE p - q END)), 6) AS gain FROM z",
    "confusion": _TWO + "SELECT CAST(id % 2 AS INTEGER) AS label, CASE WHEN p >= q THEN 0 ELSE 1 END AS model_id, count(*) AS n FROM z GROUP BY ALL",
    "mean_sequence": _with(S) + "SELECT CAST(t AS INTEGER) AS t, round(sum(x) / (SELECT count(DISTINCT id) FROM s), 4) AS mean FROM s GROUP BY t",
    "scatter_matrix": _with(S) + "SELECT CAST(p.t AS INTEGER) AS k, CAST(q.t AS INTEGER) AS l, round(avg(p.x * q.x) - avg(p.x) * avg(q.x), 2) AS value FROM s p JOIN s q ON p.id = q.id AND p.t <= q.t GROUP BY ALL",
    "extremes": _with(S) + "SELECT count(DISTINCT id) AS n, CAST(max(n) AS INTEGER) AS longest, count(*) AS items, CAST(min(sym) AS INTEGER) AS least, CAST(max(sym) AS INTEGER) AS most FROM s",
    "background_estimate": _with(S) + ", k AS (SELECT h.i AS history, y.i AS symbol, 1 + (SELECT count(*) FROM s WHERE prev = h.i AND sym = y.i) AS n FROM range(5) h(i), range(5) y(i)) SELECT CAST(history AS INTEGER) AS history, CAST(symbol AS INTEGER) AS symbol, round(n / sum(n) OVER (PARTITION BY history), 8) AS p FROM k",
    "pair_counts": _with(S) + ", m AS (SELECT DISTINCT id, n FROM s), w AS (SELECT x.id, greatest(x.n, y.n) AS n FROM m x JOIN m y ON y.id = x.id + 1) SELECT CAST(p.sym AS INTEGER) AS a, CAST(q.sym AS INTEGER) AS b, count(*) AS n FROM (SELECT id, unnest(range(n)) AS t FROM w) r LEFT JOIN s p ON p.id = r.id AND p.t = r.t LEFT JOIN s q ON q.id = r.id + 1 AND q.t = r.t GROUP BY ALL",
    "subset": _with(S) + ", w(pos, id) AS (VALUES (0, 7), (1, 3), (2, 7)) SELECT pos, s.id AS seq_id, string_agg(sym, ',' ORDER BY t) AS obs FROM w JOIN s ON s.id = w.id GROUP BY pos, s.id",
    "merge": _with(S) + "SELECT id AS seq_id, CAST(2 AS BIGINT) AS n, 2 * count(*) AS items FROM s GROUP BY id",
    "all_words": "SELECT (a * 27 + b * 9 + c * 3 + d) AS seq_id, concat_ws(',', a, b, c, d) AS obs FROM range(3) w(a), range(3) x(b), range(3) y(c), range(3) z(d)",
    "order_statuses": "SELECT o_custkey AS seq_id, string_agg(o_orderstatus, '' ORDER BY o_orderdate, o_orderkey) AS obs FROM orders GROUP BY o_custkey",
    "value_blocks": _with(S) + ", d AS (SELECT id, t, x, CAST(coalesce(abs(x - lag(x) OVER (PARTITION BY id ORDER BY t)) >= 150, false) AS INTEGER) AS new FROM s), k AS (SELECT id, t, x, sum(new) OVER (PARTITION BY id ORDER BY t) AS block FROM d) SELECT id AS seq_id, CAST(block AS BIGINT) AS block, CAST(min(t) AS INTEGER) AS start, count(*) AS n, round(avg(x), 8) AS mean FROM k GROUP BY id, block",
}
ORACLE_SQL |= {"scatter_matrix_whole": ORACLE_SQL["scatter_matrix"], "pair_counts_whole": ORACLE_SQL["pair_counts"]}


def _learnt(k: str, after: str, weight: str = "") -> str:
    """One training step: the tables of ``after`` from those of ``k``; ``weight`` names a table (id, p), all sequences count 1 without."""
    w, p = (f" JOIN {weight} w ON w.id = f.id", " * w.p") if weight else ("", "")
    backward = _backward().replace("b(id", f"b{k}(id", 1).replace("AS (", "AS MATERIALIZED (", 1).replace("FROM tr)", f"FROM tr{k})").replace("FROM b JOIN tr ON", f"FROM b{k} b JOIN tr{k} tr ON").replace("JOIN e ON", f"JOIN e{k} e ON")
    joined = f"f{k} f JOIN b{k} b ON b.id = f.id AND b.t = f.t AND b.st = f.st JOIN z{k} z ON z.id = f.id{w}"
    moves = f"f{k} f JOIN tr{k} tr ON tr.src = f.st JOIN e{k} e ON e.id = f.id AND e.t = f.t + 1 AND e.st = tr.dst JOIN b{k} b ON b.id = f.id AND b.t = e.t AND b.st = tr.dst JOIN z{k} z ON z.id = f.id{w}"
    return ", ".join((
        backward,
        f"g{k} AS MATERIALIZED (SELECT f.id, f.t, f.st, f.v * b.v / z.v{p} AS p FROM {joined})",
        f"ini{after} AS MATERIALIZED (SELECT st, sum(p) / sum(sum(p)) OVER () AS p FROM g{k} WHERE t = 0 GROUP BY st)",
        f"tr{after} AS MATERIALIZED (SELECT 0 AS c, tr.src, tr.dst, sum(f.v * tr.p * e.p * b.v / z.v{p}) / sum(sum(f.v * tr.p * e.p * b.v / z.v{p})) OVER (PARTITION BY tr.src) AS p FROM {moves} GROUP BY tr.src, tr.dst)",
        f"em{after} AS MATERIALIZED (SELECT st, sym, sum(p) / sum(sum(p)) OVER (PARTITION BY st) AS p FROM g{k} JOIN s USING (id, t) GROUP BY st, sym)",
        f"e{after} AS MATERIALIZED (SELECT s.id, s.t, em.st, em.p FROM s JOIN em{after} em ON em.sym = s.sym)",
    ))


def _scored(k: str) -> str:
    """The forward table of ``k`` and z (id, v): the likelihood of each sequence."""
    return _forward(k).replace("AS (", "AS MATERIALIZED (", 1) + f", z{k} AS MATERIALIZED (SELECT f.id, sum(f.v) AS v FROM f{k} f JOIN s USING (id, t) WHERE s.t = s.n - 1 GROUP BY f.id)"


def _start(model: Hmm, k: str) -> str:
    return f"{_chain(model, k)}, {_emissions(model, k)}"


def _parameters(k: str, model_id: int, where: str = "true") -> str:
    head = f"SELECT CAST({model_id} AS INTEGER) AS model_id,"
    return (
        f"{head} 'pi' AS stat, 0 AS i, CAST(st AS INTEGER) AS j, round(p, 6) AS value FROM ini{k} WHERE {where} UNION ALL {head} 'a', CAST(src AS INTEGER), CAST(dst AS INTEGER), round(p, 6) FROM tr{k} WHERE {where} "
        f"UNION ALL {head} 'b', CAST(st AS INTEGER), CAST(sym AS INTEGER), round(p, 6) FROM em{k} WHERE {where}"
    )


def _training() -> str:
    """Three steps, or two where the second gains under a ten-thousandth of the log-likelihood."""
    steps = _with(S, _start(PLAIN, "0"), *[_scored(str(k)) + ", " + _learnt(str(k), str(k + 1)) for k in range(3)], "gain AS (SELECT abs((SELECT sum(ln(v)) FROM z1) - (SELECT sum(ln(v)) FROM z0)) < 1e-4 * abs((SELECT sum(ln(v)) FROM z1)) AS small)")
    return steps + _parameters("2", 0, "(SELECT small FROM gain)") + " UNION ALL " + _parameters("3", 0, "NOT (SELECT small FROM gain)")


def _clustering() -> str:
    """Members by the likelier model, models trained a step on their members, three times or until no one moves."""
    parts = [S, _start(PLAIN, "x0"), _start(OTHER, "y0")]
    for k in range(4):
        x, y = f"x{k}", f"y{k}"
        parts += [_scored(x), _scored(y), f"own{k} AS MATERIALIZED (SELECT id, CASE WHEN a.v >= b.v THEN 0 ELSE 1 END AS m FROM z{x} a JOIN z{y} b USING (id))"]
        if k < 3:
            for name, m in ((x, 0), (y, 1)):
                parts += [f"w{name} AS MATERIALIZED (SELECT id, CAST(m = {m} AS INTEGER) AS p FROM own{k})", _learnt(name, f"{name[0]}{k + 1}", f"w{name}")]
    same = "NOT EXISTS (SELECT 1 FROM own{} a JOIN own{} b USING (id) WHERE a.m <> b.m)"
    last = f"CASE WHEN {same.format(0, 1)} THEN b.m WHEN {same.format(1, 2)} THEN c.m ELSE d.m END"
    return _with(*parts) + f"SELECT b.id AS seq_id, {last} AS model_id FROM own1 b JOIN own2 c USING (id) JOIN own3 d USING (id)"


def _mixture() -> str:
    """Two rounds of a soft mixture, from equal shares."""
    parts = [S, _start(PLAIN, "x0"), _start(OTHER, "y0"), "mix0 AS (SELECT 0.5e0 AS x, 0.5e0 AS y)"]
    for k in range(2):
        parts += [_scored(f"x{k}"), _scored(f"y{k}")]
        for name, v in (("x", "a"), ("y", "b")):
            parts += [f"w{name}{k} AS MATERIALIZED (SELECT id, mix.{name} * {v}.v / (mix.x * a.v + mix.y * b.v) AS p FROM zx{k} a JOIN zy{k} b USING (id) CROSS JOIN mix{k} mix)", _learnt(f"{name}{k}", f"{name}{k + 1}", f"w{name}{k}")]
        parts.append(f"mix{k + 1} AS MATERIALIZED (SELECT (SELECT avg(p) FROM wx{k}) AS x, (SELECT avg(p) FROM wy{k}) AS y)")
    return _with(*parts) + _parameters("x2", 0) + " UNION ALL " + _parameters("y2", 1)


ORACLE_SQL |= {"baum_welch": _training(), "hard_clusters": _clustering(), "soft_mixture": _mixture()}
ORACLE_SQL |= {
    "class_trajectory": _with(S, _start(PLAIN, "x"), _start(OTHER, "y"), _forward("x"), _forward("y"), "a AS (SELECT id, t, sum(v) AS v FROM fx GROUP BY id, t), b AS (SELECT id, t, sum(v) AS v FROM fy GROUP BY id, t)")
    + "SELECT id AS seq_id, CAST(t AS INTEGER) AS t, round(a.v / (a.v + b.v), 6) AS p FROM a JOIN b USING (id, t)",
    "model_distance": _TWO + "SELECT round(sum(p - q) / (SELECT count(*) FROM s), 6) AS distance FROM z",
    "weighted_logp": _with(S, _start(NORMAL, ""), _forward()) + ", l AS (SELECT f.id, any_value(s.n) AS n, ln(sum(f.v)) AS l FROM f JOIN s USING (id, t) WHERE s.t = s.n - 1 GROUP BY f.id) SELECT round(sum(n * l), 1) AS logp, count(*) AS n FROM l",
    "admissible": _with(S) + "SELECT id AS seq_id, bool_and(sym < 4) AS ok FROM s GROUP BY id",
}


def _pair_scores(last: str = "true") -> str:
    """Alignment scores by antidiagonals: cells of this one (age 0) and the one before (age 1); a move takes a cell on, or lets it age."""
    n = len(_PAIR.pi)
    moves = [(p, q, dx, dy, dx + dy - 1, float(np.log(_PAIR.a[0][p, q]))) for p in range(n) for q, (dx, dy) in enumerate(_PAIR.steps) if _PAIR.a[0][p, q] > 0]
    starts = [(-1, q, dx, dy, dx + dy - 1, float(np.log(_PAIR.pi[q]))) for q, (dx, dy) in enumerate(_PAIR.steps)]
    emit = [(q, x, y, float(np.log(_PAIR.b[q][x * 5 + y if dx and dy else x if dx else y]))) for q, (dx, dy) in enumerate(_PAIR.steps) for x in (range(5) if dx else [-1]) for y in (range(5) if dy else [-1])]
    ageing = [(p, p, 0, 0, 0, 0.0) for p in range(-1, n)]
    parts = [
        S,
        _values("mv(src, dst, dx, dy, age, lp)", moves + starts),
        _values("ag(src, dst, dx, dy, age, lp)", ageing),
        _values("em(st, x, y, lp)", emit),
        "w AS MATERIALIZED (SELECT a.id, a.n AS lx, b.n AS ly FROM (SELECT DISTINCT id, n FROM s) a JOIN (SELECT DISTINCT id, n FROM s) b ON b.id = a.id + 1)",
        "act AS MATERIALIZED (SELECT *, 0 AS to_age FROM mv UNION ALL SELECT *, 1 FROM ag)",
        "c(id, lx, ly, d, age, u, v, st, sc) AS (SELECT id, lx, ly, 0, 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT), -1, CAST(0 AS DOUBLE) FROM w UNION ALL "
        "SELECT c.id, c.lx, c.ly, c.d + 1, a.to_age, c.u + a.dx, c.v + a.dy, a.dst, max(c.sc + a.lp + CASE WHEN a.to_age = 1 THEN 0 ELSE em.lp END) "
        "FROM c JOIN act a ON a.src = c.st AND a.age = c.age AND c.u + a.dx <= c.lx AND c.v + a.dy <= c.ly "
        "LEFT JOIN s p ON a.dx = 1 AND p.id = c.id AND p.t = c.u LEFT JOIN s q ON a.dy = 1 AND q.id = c.id + 1 AND q.t = c.v "
        "LEFT JOIN em ON a.to_age = 0 AND em.st = a.dst AND em.x = coalesce(p.sym, -1) AND em.y = coalesce(q.sym, -1) WHERE c.d < c.lx + c.ly GROUP BY ALL)",
    ]
    return _with(*parts) + "SELECT id AS pair_id, round(max(sc), 4) AS logp FROM c WHERE age = 0 AND u = lx AND v = ly AND " + last + " GROUP BY id"


_FAR = S.replace("value AS x", "CASE WHEN value > 480 THEN value + 260 ELSE value END AS x")
ORACLE_SQL |= {
    "pair_scores": _pair_scores(),
    "decoded_steps": _with(S, _chain(PLAIN), _emissions(PLAIN), _viterbi()) + "SELECT id AS seq_id, CAST(t AS INTEGER) AS t, CAST(st AS INTEGER) AS state FROM w",
    "outlier_logp": _with(_FAR, _chain(NORMAL), _emissions(NORMAL), _forward()) + "SELECT f.id AS seq_id, round(ln(sum(f.v)), 4) AS logp FROM f JOIN s USING (id, t) WHERE s.t = s.n - 1 GROUP BY f.id",
    "penalised_logp": _with(S, _chain(BOUNDED), _emissions(BOUNDED))
    + "SELECT round(sum(CASE WHEN p > 0 THEN ln(p) ELSE -50 END), 4) AS logp, count(*) FILTER (p > 0) AS n FROM (SELECT e.id, sum(ini.p * e.p) AS p FROM e JOIN ini USING (st) WHERE e.t = 0 GROUP BY e.id)",
    "value_runs": _with(S) + ", d AS (SELECT id, t, x, CAST(coalesce(abs(x - lag(x) OVER (PARTITION BY id ORDER BY t)) >= 60, false) AS INTEGER) AS new FROM s), k AS (SELECT id, t, x, sum(new) OVER (PARTITION BY id ORDER BY t) AS run FROM d) SELECT id AS seq_id, CAST(run AS INTEGER) AS run, count(*) AS n, round(avg(x), 6) AS mean, round(sqrt(var_pop(x) * count(*)), 5) AS spread FROM k GROUP BY id, run",
}
ORACLE_SQL |= {
    "distance_curve": _with(S, _start(PLAIN, "x"), _start(OTHER, "y"), _forward("x"), _forward("y"), "a AS (SELECT id, t, ln(sum(v)) AS v FROM fx GROUP BY id, t), b AS (SELECT id, t, ln(sum(v)) AS v FROM fy GROUP BY id, t)")
    + "SELECT CAST(t + 1 AS INTEGER) AS items, count(*) AS n, round(sum(a.v - b.v) / (count(*) * (t + 1)), 6) AS distance FROM a JOIN b USING (id, t) WHERE (t + 1) % 20 = 0 GROUP BY t",
    "switching_joint_logp": _with(S, _chain(SWITCHING), _emissions(SWITCHING)) + f"SELECT s.id AS seq_id, round(sum({_A0} + ln(e.p)), 4) AS logp FROM s LEFT JOIN s b ON b.id = s.id AND b.t = s.t - 1 JOIN e ON e.id = s.id AND e.t = s.t AND e.st = s.sym % 3 LEFT JOIN ini i ON i.st = s.sym % 3 LEFT JOIN tr ON tr.c = b.high AND tr.src = s.prev % 3 AND tr.dst = s.sym % 3 GROUP BY s.id",
}


def _tail_emissions() -> str:
    """Cut normals: the density over its mass, added up in strips of a thousandth of a standard deviation."""
    def mass(c: object) -> float:
        sd = float(np.sqrt(c.var))
        x = np.arange(c.lo, c.mean + 12 * sd, sd / 1000) if c.kind == "normal_right" else np.arange(c.hi, c.mean - 12 * sd, -sd / 1000)
        p = np.exp(-((x - c.mean) ** 2) / (2 * c.var))
        return float((p.sum() - (p[0] + p[-1]) / 2) * sd / 1000)

    parts = []
    for i, comps in enumerate(TAILS.components):
        terms = [f"CASE WHEN x {'>=' if c.kind == 'normal_right' else '<='} {c.lo if c.kind == 'normal_right' else c.hi} THEN {c.weight} * exp(-pow(x - {c.mean}, 2) / {2 * c.var}) / {mass(c)!r} ELSE 0 END" for c in comps]
        parts.append(f"SELECT id, t, {i} AS st, {' + '.join(terms)} AS p FROM s")
    return f"e AS ({' UNION ALL '.join(parts)})"


def _plane_emissions() -> str:
    """Normals of two dimensions, times 10,000 so that products don't vanish: a value, and the one before it or 0."""
    parts = []
    for i, (c,) in enumerate(BIVARIATE.components):
        (a, b), (_, d) = c.var
        det = a * d - b * b
        x, y = f"(x - {c.mean[0]})", f"(y - {c.mean[1]})"
        parts.append(f"SELECT id, t, {i} AS st, 10000 * exp(-({d} * {x} * {x} - 2 * {b} * {x} * {y} + {a} * {y} * {y}) / {2 * det}) / (2 * pi() * sqrt({det})) AS p FROM (SELECT id, t, x, coalesce(lag(x) OVER (PARTITION BY id ORDER BY t), 0) AS y FROM s)")
    return f"e AS ({' UNION ALL '.join(parts)})"


_END = "SELECT f.id AS seq_id, round(ln(sum(f.v)), 4) AS logp FROM f JOIN s USING (id, t) WHERE s.t = s.n - 1 GROUP BY f.id"
_HELD = "(e.st > 0) = (s.high = 1)"
_HELD_BACKWARD = (
    "b(id, t, st, v) AS (SELECT s.id, s.t, q.st, CAST(1 AS DOUBLE) FROM s CROSS JOIN (SELECT DISTINCT src AS st FROM tr) q WHERE s.t = s.n - 1 UNION ALL "
    f"SELECT b.id, b.t - 1, tr.src, sum(tr.p * e.p * b.v) FROM b JOIN tr ON tr.dst = b.st JOIN e ON e.id = b.id AND e.t = b.t AND e.st = b.st JOIN s ON s.id = e.id AND s.t = e.t WHERE b.t > 0 AND {_HELD} GROUP BY b.id, b.t, tr.src)"
)
_DURATION = np.zeros((4, 4))  # the first state's entries reach state 0, its exits leave state 3
_DURATION[0, 3] = 1
_DURATION[3, :3] = PLAIN.a[0][0]
_DURATION[1:3, :3] = PLAIN.a[0][1:]
_LASTING = DiscreteHmm(pi=[*PLAIN.pi, 0], a=_DURATION, b=[*PLAIN.b, PLAIN.b[0]], alphabet=EVENTS)
ORACLE_SQL |= {
    "pair_scores_end": _pair_scores("st = 1"),
    "pair_path_logp": _with(S) + ", m AS (SELECT DISTINCT id, n FROM s), w AS (SELECT x.id, x.n AS lx, y.n AS ly FROM m x JOIN m y ON y.id = x.id + 1), "
    "k AS (SELECT w.id, lx, ly, u.t AS t, p.sym AS a, q.sym AS b, CASE WHEN u.t < least(lx, ly) THEN 0 WHEN lx > ly THEN 1 ELSE 2 END AS st FROM w, unnest(range(greatest(lx, ly))) u(t) LEFT JOIN s p ON p.id = w.id AND p.t = u.t LEFT JOIN s q ON q.id = w.id + 1 AND q.t = u.t), "
    "c AS (SELECT *, lag(st) OVER (PARTITION BY id ORDER BY t) AS prev FROM k) SELECT id AS pair_id, round(sum(ln(CASE WHEN prev IS NULL THEN [0.8, 0.1, 0.1][st + 1] ELSE [[0.8, 0.1, 0.1], [0.6, 0.35, 0.05], [0.6, 0.05, 0.35]][prev + 1][st + 1] END) + ln(CASE WHEN st > 0 THEN 0.2 WHEN a = b THEN 0.1625 ELSE 0.0125 END)), 4) AS logp FROM c GROUP BY id",
    "step_scales": _with(S, _chain(PLAIN), _emissions(PLAIN), _forward()) + ", z AS (SELECT id, t, sum(v) AS v FROM f GROUP BY id, t) SELECT id AS seq_id, CAST(t AS INTEGER) AS t, round(v / coalesce(lag(v) OVER (PARTITION BY id ORDER BY t), 1), 8) AS scale FROM z",
    "scaled_betas": _with(S, _chain(PLAIN), _emissions(PLAIN), _forward(), _backward())
    + ", z AS (SELECT id, t, sum(v) AS v FROM f GROUP BY id, t), l AS (SELECT z.id, z.v FROM z JOIN s USING (id, t) WHERE s.t = s.n - 1) SELECT b.id AS seq_id, CAST(b.t AS INTEGER) AS t, CAST(b.st AS INTEGER) AS state, round(b.v * z.v / l.v, 6) AS beta FROM b JOIN z USING (id, t) JOIN l ON l.id = b.id WHERE b.t < 10",
    "labelled_em_step": _with(S, _chain(PLAIN), _emissions(PLAIN), _forward(allow=_HELD), _HELD_BACKWARD)
    + ", z AS (SELECT f.id, sum(f.v) AS v FROM f JOIN s USING (id, t) WHERE s.t = s.n - 1 GROUP BY f.id), g AS (SELECT id, t, st, f.v * b.v / z.v AS p FROM f JOIN b USING (id, t, st) JOIN z USING (id)), r AS ("
    "SELECT 'pi' AS stat, 0 AS i, CAST(st AS INTEGER) AS j, round(sum(p), 3) AS value FROM g WHERE t = 0 GROUP BY st "
    "UNION ALL SELECT 'b', CAST(st AS INTEGER), CAST(sym AS INTEGER), round(sum(p), 3) FROM g JOIN s USING (id, t) GROUP BY st, sym "
    f"UNION ALL SELECT 'a', CAST(tr.src AS INTEGER), CAST(tr.dst AS INTEGER), round(sum(f.v * tr.p * e.p * b.v / z.v), 3) FROM f JOIN tr ON tr.src = f.st JOIN e ON e.id = f.id AND e.t = f.t + 1 AND e.st = tr.dst JOIN s ON s.id = e.id AND s.t = e.t JOIN b ON b.id = f.id AND b.t = e.t AND b.st = tr.dst JOIN z ON z.id = f.id WHERE {_HELD} GROUP BY tr.src, tr.dst) SELECT * FROM r WHERE value > 0",
    "tied_step": _with(S, _start(PLAIN, "0"), _scored("0"), _learnt("0", "1")) + "SELECT CAST(0 AS INTEGER) AS model_id, 'b' AS stat, CAST(st AS INTEGER) AS i, CAST(sym AS INTEGER) AS j, round(CASE WHEN st = 0 THEN p ELSE avg(p) OVER (PARTITION BY st > 0, sym) END, 6) AS value FROM em1",
    "background_logp": _with(S, _chain(PLAIN), _values("em(st, sym, p)", [(i, x, float(p)) for i, b in enumerate(PLAIN.b) for x, p in enumerate(b)]), _values("bg(sym, q)", list(enumerate(BACKGROUND))), "e AS (SELECT s.id, s.t, em.st, CASE em.st WHEN 0 THEN 0.75e0 * p + 0.25e0 * q WHEN 2 THEN 0.5e0 * p + 0.5e0 * q ELSE p END AS p FROM s JOIN em USING (sym) JOIN bg USING (sym))", _forward()) + _END,
    "class_logp": _with(S, _chain(DiscreteHmm(pi=PLAIN.pi, a=OTHER.a, b=PLAIN.b, alphabet=EVENTS)), _emissions(PLAIN), _forward()) + _END,
    "duration_logp": _logp(_LASTING),
    "tail_logp": _with(S, _chain(TAILS), _tail_emissions(), _forward()) + _END,
    "bivariate_logp": _with(S, _chain(BIVARIATE), _plane_emissions(), _forward()) + "SELECT f.id AS seq_id, round(ln(sum(f.v)) - any_value(s.n) * ln(10000), 4) AS logp FROM f JOIN s USING (id, t) WHERE s.t = s.n - 1 GROUP BY f.id",
    "integer_values": _with(S) + "SELECT CAST(floor(abs(x) + 0.5) AS INTEGER) AS value, count(*) AS n FROM s GROUP BY ALL",
    "weighted_extremes": _with(S) + "SELECT count(*) AS n, sum(n) / 4 AS total_weight, CAST(max(n) AS INTEGER) AS longest FROM (SELECT DISTINCT id, n FROM s)",
    "registered_logp": _with(S, _chain(PLAIN), _emissions(PLAIN), _forward(), _backward()) + ", g AS (SELECT id, f.v * b.v / sum(f.v * b.v) OVER (PARTITION BY id) AS p, f.st FROM f JOIN b USING (id, t, st) WHERE t = 0) "
    "SELECT f.id AS seq_id, round(ln(sum(f.v)), 4) AS logp, CAST(any_value(s.n) AS INTEGER) AS steps, round(any_value(g.p), 6) AS first FROM f JOIN s USING (id, t) JOIN g ON g.id = f.id AND g.st = 0 WHERE s.t = s.n - 1 GROUP BY f.id",
    "one_sequence": _with(S) + "SELECT id AS seq_id, CAST(t AS INTEGER) AS t, CAST(sym AS INTEGER) AS x FROM s WHERE id = 11",
}
