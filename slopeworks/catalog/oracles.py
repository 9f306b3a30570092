"""The SQL answer to every query, for DuckDB over the same tables.

Training is written out as a chain of common table expressions, one group per iteration.  The SQL
states the formulas afresh, so it checks the library's rather than repeating them.
"""

from __future__ import annotations

from slopeworks.catalog import queries as q
from slopeworks.catalog.tables import BUCKETS
from slopeworks.functions.sampling import PRIME, affine
from slopeworks.functions.updates import UPDATER_NAMES
from slopeworks.plans.sweep import BASE_RATES, VARIATIONS

LINEITEM = """
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k,
         CASE WHEN l_extendedprice * (1 - l_discount) > 50000 THEN 1e0 ELSE 0e0 END AS y,
         l_quantity / 50 AS x0, l_extendedprice / 1e5 AS x1,
         l_discount * 10 + 0e0 AS x2, l_tax * 10 + 0e0 AS x3
  FROM lineitem"""

EMBEDDINGS = (
    "SELECT CAST(vec_id AS VARCHAR) AS k, CASE WHEN label < 5 THEN 1e0 ELSE 0e0 END AS y, "
    + ", ".join(f"CAST(embedding[{j + 1}] AS DOUBLE) AS x{j}" for j in range(64))
    + " FROM embeddings"
)


def lit(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def placed(seed: int) -> str:
    """Where a seed places a row in [0, P): an affine map of the two parts of its hash word."""
    a, b, c = affine(seed)
    word = "CAST(concat('0x', substr(md5(k), 1, 15)) AS BIGINT)"
    return f"(({word} % {2**31}) * {a} + ({word} // {2**31}) * {b} + {c}) % {PRIME}"


def in_batch(iteration: int, fraction: float) -> str:
    return f"{placed(42 + iteration)} < {lit(fraction * PRIME)}"


def held(split: float) -> str:
    return f"{placed(41)} >= {lit((1 - split) * PRIME)}"


def rnd(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0e0"


def margin(weights, bias: float = 0.0, prefix: str = "x") -> str:
    total = " + ".join(f"{lit(w)} * {prefix}{j}" for j, w in enumerate(weights))
    return f"({total} + {lit(bias)})" if bias else f"({total})"


def multiplier(loss: str, m: str = "m") -> str:
    if loss == "logistic":
        return f"(1e0 / (1e0 + exp(-{m})) - y)"
    return f"(CASE WHEN (2e0 * y - 1e0) * {m} < 1e0 THEN -(2e0 * y - 1e0) ELSE 0e0 END)"


def row_loss(loss: str, m: str = "m") -> str:
    if loss == "logistic":
        return f"(ln(1e0 + exp(-abs({m}))) + greatest(0e0, CASE WHEN y > 0 THEN -{m} ELSE {m} END))"
    return f"greatest(0e0, 1e0 - (2e0 * y - 1e0) * {m})"


# --- update formulas ----------------------------------------------------------------------------

# Per updater: (new a, new b, new c, step); later parts may use a2, b2, c2.  e is the step size,
# tk the exponent of the bias corrections.
_EPS = "1e-8"


def update_sql(updater: str, standard: bool) -> tuple[str, str, str, str]:
    first, second = "0.9e0 * a + (1e0 - 0.9e0) * g", "0.999e0 * b + (1e0 - 0.999e0) * g * g"
    root = f"(sqrt(b2 / (1e0 - pow(0.999e0, tk))) + {_EPS})"
    return {
        "simple": ("a", "b", "c", "e * g"),
        "momentum": ("0.9e0 * a + e * g", "b", "c", "a2"),
        "nesterov": ("0.9e0 * a + e * g", "b", "c", "a2"),
        "adagrad": ("a + g * g", "b", "c", f"e * g / sqrt(a2 + {_EPS})"),
        "adadelta": (
            "0.9e0 * a + (1e0 - 0.9e0) * g * g",
            f"0.9e0 * b + (1e0 - 0.9e0) * (b + {_EPS}) / (0.9e0 * a + (1e0 - 0.9e0) * g * g + {_EPS}) * g * g",
            "c",
            f"sqrt(b + {_EPS}) / sqrt(a2 + {_EPS}) * g",
        ),
        "rmsprop": ("0.9e0 * a + 0.1e0 * g * g", "b", "c", f"e * g / sqrt(a2 + {_EPS})"),
        "adam": (first, second, "c", f"e * (a2 / (1e0 - pow(0.9e0, tk))) / {root}"),
        "adamax": (
            first,
            "greatest(0.999e0 * b, abs(g))",
            "c",
            "CASE WHEN b2 = 0 THEN 0e0 ELSE e * (a2 / (1e0 - pow(0.9e0, tk))) / b2 END",
        ),
        "nadam": (
            first,
            second,
            "c",
            f"e / {root} * (0.9e0 * a2 / (1e0 - pow(0.9e0, tk + 1)) + (1e0 - 0.9e0) * g / (1e0 - pow(0.9e0, tk)))",
        ),
        "amsgrad": (
            first,
            second,
            f"greatest(c, {second})",
            f"e * a2 / (sqrt({'c2' if standard else 'b2'}) + {_EPS})",
        ),
    }[updater]


def stepped(source: str, updaters, t: int, standard: bool, reg_type: int, reg: float, decay: bool) -> str:
    """SELECT of the next params from ``source`` with columns (cfg, updater, rate, j, w, a, b, c, g)."""

    def by_updater(part: int, keep: str) -> str:
        cases = " ".join(f"WHEN '{u}' THEN {update_sql(u, standard)[part]}" for u in updaters)
        return f"CASE updater {cases} ELSE {keep} END"

    rate = f"rate / sqrt({lit(t)})" if decay else "rate"
    tk = t if standard else t + 1
    new_w = "w - u"
    if reg_type == 1:
        new_w = f"sign(w - u) * greatest(0e0, abs(w - u) - {lit(reg)} * e)"
    elif reg_type == 2:
        new_w = f"(1e0 - e * {lit(reg)}) * w - u"
    return f"""
      SELECT cfg, updater, rate, j, w2 AS w, a2 AS a, b2 AS b, c2 AS c,
             CASE WHEN updater = 'nesterov' THEN w2 - 0.9e0 * a2 ELSE w2 END AS ahead
      FROM (SELECT *, {new_w} AS w2
            FROM (SELECT *, {by_updater(3, "0e0")} AS u
                  FROM (SELECT *, {by_updater(0, "a")} AS a2, {by_updater(1, "b")} AS b2,
                               {by_updater(2, "c")} AS c2
                        FROM (SELECT *, {rate} AS e, {tk} AS tk FROM ({source})))))"""


# --- training chains ----------------------------------------------------------------------------


def train_chain(
    configs: list[tuple[int, str, float]],
    steps: int,
    data: str = LINEITEM,
    width: int = 4,
    loss: str = "logistic",
    standard: bool = False,
    reg_type: int = 0,
    reg: float = 0.0,
    decay: bool = False,
    fraction: float = 1.0,
    split: float = 0.0,
    intercept: bool = False,
    scale: bool = False,
    start: tuple[float, ...] = (),
) -> str:
    """CTEs up to ``hist(cfg, updater, rate, t, loss, val_loss)`` and ``p{steps}`` (params).

    The intercept is parameter number ``width``, starting at 1.
    """
    d = width + 1 if intercept else width
    updaters = sorted({u for _, u, _ in configs})
    values = ", ".join(f"({c}, '{u}', {lit(r)})" for c, u, r in configs)
    features = [f"x{j}" for j in range(width)] + (["xb"] if intercept else [])
    columns = ", ".join(f"x{j}" for j in range(width)) + (", 1e0 AS xb" if intercept else "")
    if scale:
        deviations = ", ".join(f"stddev_samp(x{j}) AS d{j}" for j in range(width))
        columns = ", ".join(f"x{j} / d{j} AS x{j}" for j in range(width)) + (", 1e0 AS xb" if intercept else "")
        parts = [f"raw AS MATERIALIZED ({data})", f"dev AS MATERIALIZED (SELECT {deviations} FROM raw)"]
        origin = "raw, dev"
    else:
        parts, origin = [], f"({data})"
    is_held = held(split) if split > 0 else "false"
    parts += [
        f"conf(cfg, updater, rate) AS (VALUES {values})",
        f"ts AS MATERIALIZED (SELECT k, y, {columns}, {is_held} AS held FROM {origin})",
        f"""p0 AS MATERIALIZED (SELECT cfg, updater, rate, CAST(j AS INTEGER) AS j, s AS w, 0e0 AS a, 0e0 AS b,
             0e0 AS c, s AS ahead
             FROM conf, (SELECT j, CASE WHEN j = {width} THEN 1e0 ELSE 0e0 END AS s FROM range({d}) AS r(j)))""",
    ]
    if start:
        case = " ".join(f"WHEN {j} THEN {lit(w)}" for j, w in enumerate(start))
        parts[-1] = parts[-1].replace("ELSE 0e0 END AS s", f"ELSE CASE j {case} END END AS s")
    hist = []
    for t in range(1, steps + 1):
        pivot = ", ".join(f"max(CASE WHEN j = {j} THEN ahead END) AS v{j}" for j in range(d))
        m = " + ".join(f"v{j} * {x}" for j, x in enumerate(features))
        sums = ", ".join(f"avg(p * {x}) FILTER (NOT held) AS g{j}" for j, x in enumerate(features))
        penalty = {0: "0e0", 1: f"{lit(reg)} * sum(abs(w))", 2: f"0.5e0 * {lit(reg)} * sum(w * w)"}[reg_type]
        where = f"WHERE {in_batch(t, fraction)}" if fraction < 1 else ""
        gcase = " ".join(f"WHEN {j} THEN g{j}" for j in range(d))
        parts += [
            f"v{t} AS MATERIALIZED (SELECT cfg, {pivot} FROM p{t - 1} GROUP BY cfg)",
            f"r{t} AS MATERIALIZED (SELECT cfg, {penalty} AS pen FROM p{t - 1} GROUP BY cfg)",
            f"""g{t} AS MATERIALIZED (
              SELECT cfg, avg(l) FILTER (NOT held) AS loss, avg(l) FILTER (held) AS val_loss, {sums}
              FROM (SELECT *, {multiplier(loss)} AS p, {row_loss(loss)} AS l
                    FROM (SELECT cfg, held, y, {", ".join(features)}, {m} AS m
                          FROM (SELECT * FROM ts {where}), v{t}))
              GROUP BY cfg)""",
            f"p{t} AS MATERIALIZED ("
            + stepped(
                f"SELECT p.*, CASE p.j {gcase} END AS g FROM p{t - 1} p JOIN g{t} USING (cfg)",
                updaters, t, standard, reg_type, reg, decay,
            )
            + ")",
        ]
        hist.append(
            f"SELECT cfg, updater, rate, {t} AS t, loss + pen AS loss, val_loss + pen AS val_loss "
            f"FROM g{t} JOIN r{t} USING (cfg) JOIN conf USING (cfg)"
        )
    parts.append(f"hist AS MATERIALIZED ({' UNION ALL '.join(hist)})")
    return "WITH " + ",\n".join(parts)


def chain_of(changes: dict, **fixed) -> str:
    """The chain of one training configuration given by its settings."""
    settings = {"updater": "simple", "step_size": q.STEP} | changes
    return train_chain(
        [(0, settings["updater"], settings["step_size"])],
        settings.get("num_iterations", 3),
        loss=settings.get("loss", "logistic"),
        standard=settings.get("semantics") == "standard",
        reg_type=settings.get("reg_type", 0),
        reg=settings.get("reg_param", 0.0),
        decay=settings.get("decay", False),
        fraction=settings.get("mini_batch_fraction", 1.0),
        split=settings.get("validation_split", 0.0),
        intercept=settings.get("intercept", False),
        scale=settings.get("scale", False),
        **fixed,
    )


def training_sql(changes: dict, width: int = 4, **fixed) -> str:
    """Result of a training query: weights, intercept, losses."""
    scale = changes.get("scale", False)
    steps = changes.get("num_iterations", 3)
    weight = "w"
    source = f"p{steps}"
    if scale:
        case = " ".join(f"WHEN {j} THEN d{j}" for j in range(width))
        weight, source = f"w / CASE j {case} END", f"p{steps}, dev"
    value = lambda x: rnd(x, q.digits_of(changes.get("loss", "logistic")))
    parts = [
        f"SELECT updater, 'weight' AS entry, j AS pos, {value(weight)} AS value FROM {source} WHERE j < {width}",
        f"SELECT updater, 'loss', t, {value('loss')} FROM hist",
    ]
    if changes.get("intercept"):
        parts.append(f"SELECT updater, 'intercept', 0, {value('w')} FROM p{steps} WHERE j = {width}")
    if changes.get("validation_split"):
        parts.append(f"SELECT updater, 'val_loss', t, {value('val_loss')} FROM hist")
    return chain_of(changes, width=width, **fixed) + "\n" + " UNION ALL ".join(parts)


def _all_weights(steps: int) -> str:
    return " UNION ALL ".join(f"SELECT cfg, updater, {t} AS t, j, w FROM p{t}" for t in range(steps + 1))


def _early_stopped() -> str:
    """Weights before the first iteration whose validation loss did not fall, or after the last."""
    configs = [(i, u, q.RESTLESS_STEP) for i, u in enumerate(q.STOPPING)]
    steps = q.STOP_STEPS
    return (
        train_chain(configs, steps, split=q.SPLIT)
        + f""", stops AS (
        SELECT cfg, min(t) AS stop
        FROM (SELECT cfg, t, val_loss, lag(val_loss) OVER (PARTITION BY cfg ORDER BY t) AS before FROM hist)
        WHERE t > 1 AND NOT coalesce(val_loss < before, false) GROUP BY cfg),
      ends AS (SELECT conf.cfg, coalesce(stop - 1, {steps}) AS t, coalesce(stop, {steps}) AS steps,
                      CASE WHEN stop IS NULL THEN 'max_iterations' ELSE 'early_stop' END AS stop_reason
               FROM conf LEFT JOIN stops USING (cfg)),
      al AS ({_all_weights(steps)})
      SELECT updater, stop_reason, CAST(steps AS INTEGER) AS steps, j AS idx, {rnd("w")} AS w
      FROM ends JOIN al USING (cfg, t)"""
    )


def _converged() -> str:
    """Weights after the first update but one that changed them little, or after the last."""
    configs = [(i, u, q.STEP) for i, u in enumerate(q.STOPPING)]
    steps = q.CONVERGING_STEPS
    return (
        train_chain(configs, steps)
        + f""", al AS MATERIALIZED ({_all_weights(steps)}),
      moves AS (SELECT n.cfg, n.t, sqrt(sum((n.w - o.w) * (n.w - o.w))) AS d, sqrt(sum(n.w * n.w)) AS s
                FROM al n JOIN al o ON n.cfg = o.cfg AND n.j = o.j AND n.t = o.t + 1 GROUP BY n.cfg, n.t),
      stops AS (SELECT cfg, min(t) AS stop FROM moves
                WHERE t > 1 AND d < {lit(q.TOLERANCE)} * greatest(s, 1e0) GROUP BY cfg),
      ends AS (SELECT conf.cfg, coalesce(stop, {steps}) AS t,
                      CASE WHEN stop IS NULL THEN 'max_iterations' ELSE 'converged' END AS stop_reason
               FROM conf LEFT JOIN stops USING (cfg))
      SELECT updater, stop_reason, CAST(t AS INTEGER) AS steps, j AS idx, {rnd("w")} AS w
      FROM ends JOIN al USING (cfg, t)"""
    )


def two_step_sql(changes: dict) -> str:
    """Result of an update query: two updates with the gradients of the first two mini-batches."""
    s = {"updater": "simple", "step_size": q.STEP, "semantics": "reference"} | changes
    grads = ", ".join(f"avg(p * x{j}) AS g{j}" for j in range(4))
    gcase = "CASE j " + " ".join(f"WHEN {j} THEN g{j}" for j in range(4)) + " END"
    wcase = "CASE j " + " ".join(f"WHEN {j} THEN {lit(w)}" for j, w in enumerate(q.POINT)) + " END"

    def grad(t):
        return f"""g{t} AS MATERIALIZED (SELECT {grads} FROM (SELECT *, {multiplier("logistic")} AS p
          FROM (SELECT *, {margin(q.POINT)} AS m FROM ts WHERE {in_batch(t, q.BATCH)})))"""

    def move(source, t):
        return stepped(
            source, [s["updater"]], t, s["semantics"] == "standard",
            s.get("reg_type", 0), s.get("reg_param", 0.0), s.get("decay", False),
        )

    return f"""WITH ts AS MATERIALIZED ({LINEITEM}), {grad(1)}, {grad(2)},
      p0 AS (SELECT 0 AS cfg, '{s["updater"]}' AS updater, {lit(s["step_size"])} AS rate, CAST(j AS INTEGER) AS j,
             {wcase} AS w, 0e0 AS a, 0e0 AS b, 0e0 AS c FROM range(4) AS r(j)),
      p1 AS MATERIALIZED ({move(f"SELECT p0.*, {gcase} AS g FROM p0, g1", 1)}),
      p2 AS MATERIALIZED ({move(f"SELECT p1.* EXCLUDE (ahead), {gcase} AS g FROM p1, g2", 2)})
      SELECT p1.j AS idx, {rnd("p1.w")} AS w1, {rnd("p1.ahead")} AS ahead1,
             {rnd("p2.w")} AS w2, {rnd("p2.ahead")} AS ahead2
      FROM p1 JOIN p2 USING (j)"""


def document_entries(label: str = "toxic") -> str:
    """(k, y, j, x) of the bag of hashed words."""
    return f"""
      SELECT CAST(doc_id AS VARCHAR) AS k, y, j, CAST(count(*) AS DOUBLE) AS x
      FROM (SELECT doc_id, y, CAST(CAST(concat('0x', substr(md5(word), 1, 8)) AS BIGINT) % {BUCKETS} AS INTEGER) AS j
            FROM (SELECT doc_id, CAST({label} AS DOUBLE) AS y,
                         unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word
                  FROM documents JOIN labels USING (doc_id))
            WHERE word <> '')
      GROUP BY doc_id, y, j"""


_PATTERN = "((j % 7) - 3) / 10e0"


def _sparse_sweep() -> str:
    """Accuracies of two rates after three steps on the training part; weights start at 0, so an index that only
    the test part has keeps weight 0."""
    parts = [
        f"every AS MATERIALIZED (SELECT *, {held(q.SPLIT)} AS h FROM ({document_entries()}))",
        "en AS MATERIALIZED (SELECT k, y, j, x FROM every WHERE NOT h)",
        "docs AS MATERIALIZED (SELECT DISTINCT k, y FROM en)",
        "whole AS MATERIALIZED (SELECT DISTINCT k, y, h FROM every)",
    ]
    out = []
    for run, rate in enumerate(q.SPARSE_RATES):
        parts.append(f"p{run}_0 AS MATERIALIZED (SELECT CAST(j AS INTEGER) AS j, 0e0 AS w FROM range({BUCKETS}) AS r(j))")
        for t in range(1, 4):
            before = f"p{run}_{t - 1}"
            parts += [
                f"m{run}_{t} AS MATERIALIZED (SELECT k, sum(x * w) AS m FROM en JOIN {before} USING (j) GROUP BY k)",
                f"t{run}_{t} AS MATERIALIZED (SELECT k, {multiplier('logistic')} AS p FROM docs JOIN m{run}_{t} USING (k))",
                f"g{run}_{t} AS MATERIALIZED (SELECT j, sum(x * p) / (SELECT count(*) FROM docs) AS g "
                f"FROM en JOIN t{run}_{t} USING (k) GROUP BY j)",
                f"p{run}_{t} AS MATERIALIZED (SELECT j, w - {lit(rate)} * coalesce(g, 0e0) AS w "
                f"FROM {before} LEFT JOIN g{run}_{t} USING (j))",
            ]
        hit = "CASE WHEN (1e0 / (1e0 + exp(-m)) > 0.5e0) = (y > 0) THEN 1e0 ELSE 0e0 END"
        out.append(
            f"SELECT {run} AS run_id, {rnd(lit(rate))} AS rate, {rnd(f'avg({hit}) FILTER (NOT h)')} AS train_acc, "
            f"{rnd(f'avg({hit}) FILTER (h)')} AS test_acc "
            f"FROM whole JOIN (SELECT k, sum(x * w) AS m FROM every JOIN p{run}_3 USING (j) GROUP BY k) USING (k)"
        )
    return "WITH " + ",\n".join(parts) + "\n" + " UNION ALL ".join(out)


def sparse_training_sql(rate: float, steps: int = 3) -> str:
    parts = [
        f"en AS MATERIALIZED ({document_entries()})",
        "docs AS MATERIALIZED (SELECT DISTINCT k, y FROM en)",
        f"p0 AS MATERIALIZED (SELECT CAST(j AS INTEGER) AS j, 0e0 AS w FROM range({BUCKETS}) AS r(j))",
    ]
    for t in range(1, steps + 1):
        parts += [
            f"m{t} AS MATERIALIZED (SELECT k, sum(x * w) AS m FROM en JOIN p{t - 1} USING (j) GROUP BY k)",
            f"t{t} AS MATERIALIZED (SELECT k, {multiplier('logistic')} AS p, {row_loss('logistic')} AS l "
            f"FROM docs JOIN m{t} USING (k))",
            f"g{t} AS MATERIALIZED (SELECT j, sum(x * p) / (SELECT count(*) FROM docs) AS g "
            f"FROM en JOIN t{t} USING (k) GROUP BY j)",
            f"p{t} AS MATERIALIZED (SELECT j, w - {lit(rate)} * coalesce(g, 0e0) AS w "
            f"FROM p{t - 1} LEFT JOIN g{t} USING (j))",
        ]
    losses = " UNION ALL ".join(
        f"SELECT 'simple', 'loss', {t}, {rnd('avg(l)')} FROM t{t}" for t in range(1, steps + 1)
    )
    return (
        "WITH " + ",\n".join(parts)
        + f"\nSELECT 'simple' AS updater, 'weight' AS entry, j AS pos, {rnd('w')} AS value FROM p{steps} "
        + f"UNION ALL {losses}"
    )


# --- everything else ----------------------------------------------------------------------------


def _gradient_sql(loss: str) -> str:
    grads = ", ".join(f"avg(p * x{j}) AS g{j}" for j in range(4))
    case = "CASE j " + " ".join(f"WHEN {j} THEN g{j}" for j in range(4)) + " END"
    return f"""
      SELECT CAST(j AS INTEGER) AS idx, n, {rnd("l")} AS loss_mean, {rnd(case)} AS grad_mean
      FROM (SELECT count(*) AS n, avg(l) AS l, {grads}
            FROM (SELECT *, {multiplier(loss)} AS p, {row_loss(loss)} AS l
                  FROM (SELECT *, {margin(q.POINT, q.POINT_BIAS)} AS m FROM ({LINEITEM})))), range(4) AS r(j)"""


def _dense64_gradient() -> str:
    weights = [((j % 7) - 3) / 10 for j in range(64)]
    grads = ", ".join(f"avg(p * x{j}) AS g{j}" for j in range(64))
    case = "CASE j " + " ".join(f"WHEN {j} THEN g{j}" for j in range(64)) + " END"
    return f"""
      SELECT CAST(j AS INTEGER) AS idx, n, {rnd("l")} AS loss_mean, {rnd(case)} AS grad_mean
      FROM (SELECT count(*) AS n, avg(l) AS l, {grads}
            FROM (SELECT *, {multiplier("logistic")} AS p, {row_loss("logistic")} AS l
                  FROM (SELECT *, {margin(weights)} AS m FROM ({EMBEDDINGS})))), range(64) AS r(j)"""


def _sparse_gradient() -> str:
    return f"""
      WITH en AS MATERIALIZED ({document_entries()}),
      rows AS MATERIALIZED (
        SELECT k, y, {multiplier("logistic")} AS p, {row_loss("logistic")} AS l
        FROM (SELECT k, y, sum(x * {_PATTERN}) AS m FROM en GROUP BY k, y)),
      tot AS (SELECT count(*) AS n, avg(l) AS l FROM rows),
      gr AS (SELECT j, sum(x * p) AS g FROM en JOIN rows USING (k) GROUP BY j)
      SELECT CAST(r.j AS INTEGER) AS idx, n, {rnd("l")} AS loss_mean, {rnd("coalesce(g, 0e0) / n")} AS grad_mean
      FROM range({BUCKETS}) AS r(j) LEFT JOIN gr ON gr.j = r.j, tot"""


def _join_gradient() -> str:
    return f"""
      WITH en AS MATERIALIZED ({document_entries()}),
      rows AS MATERIALIZED (
        SELECT k, {multiplier("logistic")} AS p FROM (SELECT k, y, sum(x * {_PATTERN}) AS m FROM en GROUP BY k, y))
      SELECT j AS idx, count(*) AS n_entries, {rnd("sum(x * p)")} AS grad_sum FROM en JOIN rows USING (k) GROUP BY j"""


def _loss_validation() -> str:
    one = lambda loss: f"""
      SELECT count(*) FILTER (NOT held) AS n, count(*) FILTER (held) AS n_val, '{loss}' AS loss,
             {rnd("avg(l) FILTER (NOT held)")} AS train_loss, {rnd("avg(l) FILTER (held)")} AS val_loss
      FROM (SELECT {held(q.SPLIT)} AS held, {row_loss(loss)} AS l
            FROM (SELECT *, {margin(q.POINT, q.POINT_BIAS)} AS m FROM ({LINEITEM}) WHERE {in_batch(2, q.BATCH)}))"""  # noqa: E731
    return one("logistic") + " UNION ALL " + one("hinge")


def _reg_value() -> str:
    grads = ", ".join(f"avg(p * x{j}) AS g{j}" for j in range(4))
    parts = []
    for kind in (0, 1, 2):
        moved = []
        for j, w in enumerate(q.POINT):
            step = f"{lit(q.STEP)} * g{j}"
            if kind == 1:
                moved.append(
                    f"sign({lit(w)} - {step}) * greatest(0e0, abs({lit(w)} - {step}) - {lit(q.REG * q.STEP)})"
                )
            else:
                kept = 1 - q.STEP * q.REG if kind == 2 else 1.0
                moved.append(f"{lit(kept)} * {lit(w)} - {step}")
        value = {
            0: "0e0",
            1: f"{lit(q.REG)} * (" + " + ".join(f"abs({m})" for m in moved) + ")",
            2: f"{lit(0.5 * q.REG)} * (" + " + ".join(f"({m}) * ({m})" for m in moved) + ")",
        }[kind]
        parts.append(f"SELECT {kind} AS reg_type, {rnd(value)} AS penalty FROM g")
    return f"""WITH g AS MATERIALIZED (SELECT {grads} FROM (SELECT *, {multiplier("logistic")} AS p
        FROM (SELECT *, {margin(q.POINT)} AS m FROM ({LINEITEM}) WHERE {in_batch(1, q.BATCH)})))
        {" UNION ALL ".join(parts)}"""


def _convergence() -> str:
    steps = 4
    pick = " UNION ALL ".join(f"SELECT cfg, {t} AS t, j, w FROM p{t}" for t in range(1, steps + 1))
    configs = [(i, u, q.STEP) for i, u in enumerate(UPDATER_NAMES)]
    return (
        train_chain(configs, steps)
        + f""", al AS ({pick})
      SELECT cfg AS config_id, t AS iteration, {rnd("d")} AS change_norm, {rnd("s")} AS weight_norm,
             d < 0.05e0 * greatest(s, 1e0) AS converged
      FROM (SELECT n.cfg, n.t, sqrt(sum((n.w - o.w) * (n.w - o.w))) AS d, sqrt(sum(n.w * n.w)) AS s
            FROM al n JOIN al o ON n.cfg = o.cfg AND n.j = o.j AND n.t = o.t + 1 GROUP BY n.cfg, n.t)"""
    )


def _early_stop() -> str:
    configs = [(i, u, q.RESTLESS_STEP) for i, u in enumerate(UPDATER_NAMES)]
    return (
        train_chain(configs, q.STOP_STEPS, split=q.SPLIT)
        + """
      SELECT cfg AS config_id, min(t) AS stop_iteration
      FROM (SELECT cfg, t, val_loss, lag(val_loss) OVER (PARTITION BY cfg ORDER BY t) AS before FROM hist)
      WHERE t > 1 AND NOT coalesce(val_loss < before, false) GROUP BY cfg"""
    )


def _scores(loss: str) -> str:
    return f"""SELECT k, y, m, 1e0 / (1e0 + exp(-m)) AS pr,
        CASE WHEN {"1e0 / (1e0 + exp(-m)) > 0.5e0" if loss == "logistic" else "m > 0e0"} THEN 1e0 ELSE 0e0 END AS hat
      FROM (SELECT *, {margin(q.POINT, q.POINT_BIAS)} AS m FROM ({LINEITEM}))"""


def _scored_rows(margins: str) -> str:
    return f"""SELECT k AS row_key, y AS label, {rnd("pr")} AS probability,
        CASE WHEN pr > 0.5e0 THEN 1e0 ELSE 0e0 END AS prediction
      FROM (SELECT k, y, 1e0 / (1e0 + exp(-m)) AS pr FROM ({margins}))"""


def sweep_list() -> list[tuple[int, str, float]]:
    rates = [(u, b + b * v) for u, b in zip(UPDATER_NAMES, BASE_RATES) for v in VARIATIONS]
    return [(i, u, r) for i, (u, r) in enumerate(rates)]


def _sweep(tail: str, steps: int = q.SWEEP_STEPS, **settings) -> str:
    return train_chain(sweep_list(), steps, fraction=q.BATCH, **settings) + tail


def _sweep_best(steps: int = q.SWEEP_STEPS) -> str:
    return f""", best AS (
      SELECT updater, cfg, rate, loss,
             row_number() OVER (PARTITION BY updater ORDER BY loss, cfg) AS place
      FROM hist WHERE t = {steps})"""


def _sweep_runs(loss: str) -> str:
    # The test part is what the split holds back; the training part is the rest.
    rows = f"SELECT * FROM ({LINEITEM}) WHERE NOT ({held(q.SPLIT)})"
    pivot = ", ".join(f"max(CASE WHEN j = {j} THEN w END) AS v{j}" for j in range(4))
    m = " + ".join(f"v{j} * x{j}" for j in range(4))
    hat = "1e0 / (1e0 + exp(-m)) > 0.5e0" if loss == "logistic" else "m > 0e0"
    return (
        train_chain(sweep_list(), q.SWEEP_STEPS, data=rows, loss=loss, fraction=q.BATCH)
        + f""", fin AS MATERIALIZED (SELECT cfg, {pivot} FROM p{q.SWEEP_STEPS} GROUP BY cfg),
      acc AS (SELECT cfg, avg(hit) FILTER (NOT h) AS train_acc, avg(hit) FILTER (h) AS test_acc
              FROM (SELECT cfg, h, CASE WHEN ({hat}) = (y > 0) THEN 1e0 ELSE 0e0 END AS hit
                    FROM (SELECT cfg, y, {m} AS m, {held(q.SPLIT)} AS h FROM ({LINEITEM}), fin))
              GROUP BY cfg)
      SELECT cfg AS run_id, updater, '{loss}' AS alg, {q.SWEEP_STEPS} AS iterations, {rnd("rate")} AS rate,
             {rnd("train_acc")} AS train_acc, {rnd("test_acc")} AS test_acc
      FROM acc JOIN conf USING (cfg)"""
    )


def _experiment() -> str:
    steps = q.EXPERIMENT["iterations"]
    rows = f"SELECT * FROM ({LINEITEM}) WHERE NOT ({held(q.SPLIT)})"
    pivot = ", ".join(f"max(CASE WHEN j = {j} THEN w END) AS v{j}" for j in range(4))
    m = " + ".join(f"v{j} * x{j}" for j in range(4))
    hit = "CASE WHEN (1e0 / (1e0 + exp(-m)) > 0.5e0) = (y > 0) THEN 1e0 ELSE 0e0 END"
    return (
        train_chain([(0, "adam", q.EXPERIMENT["rate"])], steps, data=rows)
        + f""", fin AS MATERIALIZED (SELECT {pivot} FROM p{steps}),
      acc AS (SELECT avg({hit}) FILTER (NOT h) AS train_acc, avg({hit}) FILTER (h) AS test_acc
              FROM (SELECT y, {m} AS m, {held(q.SPLIT)} AS h FROM ({LINEITEM}), fin))
      SELECT 'adam' AS updater, 'logistic' AS alg, {steps} AS iterations, 'max_iterations' AS stop_reason,
             {rnd("loss")} AS loss, {rnd("train_acc")} AS train_acc, {rnd("test_acc")} AS test_acc
      FROM acc, hist WHERE t = {steps}"""
    )


_LOG = """WITH ev AS (
        SELECT *, event_type = 'purchase' AS closes,
               count(*) FILTER (event_type = 'purchase') OVER (ORDER BY event_id) AS through FROM events),
      closed AS (
        SELECT through - 1 AS run_id, CAST(user_id % 10 AS INTEGER) AS updater,
               CAST(user_id % 2 AS VARCHAR) AS alg, value AS rate, user_id / 1000e0 AS test_acc,
               user_id / 2000e0 AS train_acc, event_id AS elapsed_ms
        FROM ev WHERE closes),
      told AS (
        SELECT through AS run_id, CAST(event_id % 20 + 1 AS INTEGER) AS iteration, value AS loss
        FROM ev WHERE event_type NOT IN ('purchase', 'error'))
"""


_LOG_FILES = f"""WITH ev AS (
        SELECT *, event_id // {q.LOG_FILE} AS source, event_type = 'purchase' AS closes,
               count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY event_id // {q.LOG_FILE} ORDER BY event_id) AS through
        FROM events)
      SELECT source, through - 1 AS run_id, CAST(user_id % 10 AS INTEGER) AS updater,
             CAST(user_id % 2 AS VARCHAR) AS alg, value AS rate, user_id / 1000e0 AS test_acc,
             user_id / 2000e0 AS train_acc, event_id AS elapsed_ms
      FROM ev WHERE closes"""


def _confusion_many() -> str:
    # The key's second part is the line number.
    label = "CASE WHEN n <> 5 THEN CAST(n % 4 - 1 AS DOUBLE) END"
    parts = [
        f"SELECT {i} AS config_id, {label} AS label, hat AS prediction, count(*) AS n "
        f"FROM (SELECT hat, CAST(string_split(k, '-')[2] AS INTEGER) AS n FROM ({_scores(loss)})) GROUP BY 1, 2, 3"
        for i, loss in enumerate(("logistic", "hinge"))
    ]
    return " UNION ALL ".join(parts)


def all_oracles() -> dict[str, str]:
    found = {
        "src_training_set": f"SELECT k AS row_key, y AS label, x0, x1, x2, x3 FROM ({LINEITEM})",
        "src_libsvm": "SELECT y AS label, CAST(j AS INTEGER) AS idx, count(*) AS n, "
        + rnd("avg(x)")
        + f" AS mean FROM (SELECT y, unnest(range(4)) AS j, unnest([x0, x1, x2, x3]) AS x FROM ({LINEITEM})) "
        "WHERE x <> 0 GROUP BY y, j",
        "feat_append_bias": f"SELECT k AS row_key, x0, x1, x2, x3, 1e0 AS x4 FROM ({LINEITEM})",
        "feat_std_scale": f"WITH ts AS ({LINEITEM}), sd AS (SELECT "
        + ", ".join(f"stddev_samp(x{j}) AS d{j}" for j in range(4))
        + " FROM ts) SELECT k AS row_key, "
        + ", ".join(f"{rnd(f'x{j} / d{j}')} AS x{j}" for j in range(4))
        + " FROM ts, sd",
        "feat_std_scale_sparse": f"""
          WITH en AS MATERIALIZED ({document_entries()}),
          docs AS MATERIALIZED (SELECT DISTINCT k FROM en),
          full_rows AS (SELECT r.j, coalesce(en.x, 0e0) AS x
                        FROM docs CROSS JOIN range({BUCKETS}) AS r(j) LEFT JOIN en ON en.k = docs.k AND en.j = r.j)
          SELECT CAST(j AS INTEGER) AS idx, {rnd("stddev_samp(x)")} AS sd FROM full_rows GROUP BY j""",
        "feat_unscale_weights": f"""
          SELECT CAST(j AS INTEGER) AS idx, {rnd("w")} AS w FROM (
            SELECT unnest([0, 1, 2, 3, 4]) AS j, unnest([{
            ", ".join(f"avg(x{j}) / stddev_samp(x{j})" for j in range(4))
        }, 1e0]) AS w FROM ({LINEITEM}))""",
        "val_binary_label": "SELECT CAST(l_linenumber AS DOUBLE) AS label, count(*) AS n FROM lineitem "
        "WHERE l_linenumber NOT IN (0, 1) GROUP BY 1",
        "val_feature_width": f"""
          SELECT 'lineitem' AS source, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_bad_labels,
                 CAST(0 AS BIGINT) AS n_missing, 4 AS min_width, 4 AS max_width FROM lineitem
          UNION ALL
          SELECT 'embeddings', count(*), 0, count(*) FILTER (embedding IS NULL),
                 CAST(min(len(embedding)) AS INTEGER), CAST(max(len(embedding)) AS INTEGER) FROM embeddings
          UNION ALL
          SELECT 'documents', count(*), 0, 0, CAST(min(w) AS INTEGER), CAST(max(w) AS INTEGER)
          FROM (SELECT k, max(j) + 1 AS w FROM ({document_entries()}) GROUP BY k)""",
        "sample_minibatch": " UNION ALL ".join(
            f"SELECT k AS row_key, {i} AS iteration FROM ({LINEITEM}) WHERE {in_batch(i, q.BATCH)}" for i in (1, 2, 3)
        ),
        "split_validation": f"SELECT k AS row_key, {held(q.SPLIT)} AS held_out FROM ({LINEITEM})",
        "grad_logistic": _gradient_sql("logistic"),
        "grad_hinge": _gradient_sql("hinge"),
        "grad_logistic_dense64": _dense64_gradient(),
        "grad_logistic_sparse": _sparse_gradient(),
        "grad_logistic_join": _join_gradient(),
        "loss_validation": _loss_validation(),
        "reg_value": _reg_value(),
        "ctl_convergence": _convergence(),
        "ctl_early_stop": _early_stop(),
        "history_last10": chain_of({"num_iterations": 12})
        + f" SELECT t AS iteration, {rnd('loss')} AS train_loss FROM hist ORDER BY t DESC LIMIT 10",
        "predict_lr": f"SELECT k AS row_key, y AS label, m AS margin, {rnd('pr')} AS probability, "
        f"hat AS prediction FROM ({_scores('logistic')})",
        "predict_svm": f"SELECT k AS row_key, y AS label, m AS margin, hat AS prediction FROM ({_scores('hinge')})",
        "predict_dense64": _scored_rows(
            f"SELECT k, y, {margin([((j % 7) - 3) / 10 for j in range(64)], 0.05)} AS m FROM ({EMBEDDINGS})"
        ),
        "predict_sparse": _scored_rows(
            f"SELECT k, y, sum(x * {_PATTERN}) + 0.05e0 AS m FROM ({document_entries()}) GROUP BY k, y"
        ),
        "eval_accuracy": f"SELECT {rnd('avg(CASE WHEN hat = y THEN 1e0 ELSE 0e0 END)')} AS accuracy "
        f"FROM ({_scores('logistic')})",
        "eval_confusion": f"SELECT y AS label, hat AS prediction, count(*) AS n FROM ({_scores('hinge')}) GROUP BY 1, 2",
        "eval_majority": f"SELECT {rnd('max(n) / sum(n)')} AS accuracy "
        f"FROM (SELECT y, count(*) AS n FROM ({LINEITEM}) GROUP BY y)",
        "sweep_grid": _sweep(
            f""" SELECT cfg AS run_id, updater, {rnd("rate")} AS rate,
               {rnd("max(CASE WHEN t = 1 THEN loss END)")} AS loss1,
               {rnd("max(CASE WHEN t = 2 THEN loss END)")} AS loss2
             FROM hist GROUP BY cfg, updater, rate""",
            steps=2,
        ),
        "sweep_runs": _sweep_runs("logistic"),
        "sweep_runs_svm": _sweep_runs("hinge"),
        "sweep_best_rate": _sweep(
            f"""{_sweep_best(q.CRITERION)} SELECT updater, cfg AS run_id, {rnd("rate")} AS rate, {rnd("loss")} AS loss
             FROM best WHERE place = 1""",
            steps=q.CRITERION,
        ),
        "sweep_curves": _sweep(
            f""" SELECT updater, cfg AS run_id, {rnd("rate")} AS rate, t AS iteration, {rnd("loss")} AS loss
             FROM hist"""
        ),
        "sweep_best_curves": _sweep(
            f"""{_sweep_best()},
             panels AS (SELECT 1 AS panel, unnest(['simple', 'momentum', 'nesterov', 'adagrad', 'adadelta',
                                                   'rmsprop']) AS updater
                        UNION ALL
                        SELECT 2, unnest(['simple', 'adam', 'adamax', 'nadam', 'amsgrad']))
             SELECT panel, h.updater, h.cfg AS run_id, {rnd("h.rate")} AS rate, h.t AS iteration,
                    {rnd("h.loss")} AS loss
             FROM best b JOIN hist h ON h.cfg = b.cfg JOIN panels p ON p.updater = h.updater WHERE place = 1"""
        ),
        "parse_run_log": _LOG
        + "SELECT run_id, updater, alg, rate, iteration, loss FROM told JOIN closed USING (run_id)",
        "parse_run_log_runs": _LOG + "SELECT * FROM closed",
        "log_best_rate": _LOG
        + """, crit AS (SELECT run_id, min(loss) AS loss FROM told WHERE iteration = 5 GROUP BY run_id),
        cand AS (SELECT c.updater, c.run_id, c.rate, a.loss,
                        row_number() OVER (PARTITION BY c.updater ORDER BY c.run_id) AS nth
                 FROM closed c LEFT JOIN crit a USING (run_id)),
        ranked AS (SELECT *, row_number() OVER (
                     PARTITION BY updater
                     ORDER BY CASE WHEN nth = 1 THEN coalesce(loss, 1e0) ELSE loss END, run_id) AS place
                   FROM cand WHERE nth = 1 OR loss IS NOT NULL)
        SELECT updater, run_id, rate, loss FROM ranked WHERE place = 1""",
    }
    found |= {name: two_step_sql(changes) for name, changes in q.update_cases().items()}
    found |= {name: training_sql(changes) for name, changes in q.training_cases().items()}
    found["train_lr_dense64"] = training_sql({"updater": "adam"}, width=64, data=EMBEDDINGS)
    share = f"CAST(unnest([1, 2, 3]) AS INTEGER) AS iteration, count(*) AS n_rows"
    found["sample_unkeyed"] = f"SELECT {share}, true AS layouts_agree, true AS near_share FROM lineitem"
    found["val_features"] = """
      SELECT count(*) FILTER (l_returnflag IN ('A', 'N')) AS n_bad_labels, count(*) FILTER (l_linenumber = 4) AS n_missing,
             count(*) FILTER (l_linenumber IN (1, 2, 3, 5)) AS n_bad_vectors, count(*) FILTER (l_linenumber = 6) AS n_no_key
      FROM lineitem"""
    found["eval_confusion_many"] = _confusion_many()
    found["train_lr_early_stop"] = _early_stopped()
    found["train_lr_converged"] = _converged()
    defaults = {"updater": "adagrad", "step_size": 1.0, "num_iterations": q.API_STEPS}
    found["api_train_logistic"] = found["api_logistic_estimator"] = training_sql(defaults)
    found["api_train_svm"] = training_sql(defaults | {"loss": "hinge"})
    found["api_svm_estimator"] = training_sql(
        defaults | {"loss": "hinge", "reg_type": 2, "reg_param": 0.01}, start=q.POINT
    )
    found["experiment_run"] = _experiment()
    found["predict_sparse_join"] = found["predict_sparse"]
    found["eval_confusion_join"] = found["eval_confusion_many"]
    for updater in ("adam", "nesterov"):
        found[f"train_lr_resumed_{updater}"] = found[f"train_lr_{updater}"]
    found["feat_std_scale_rows_sparse"] = f"""
      WITH en AS MATERIALIZED ({document_entries()}),
      n AS (SELECT count(DISTINCT k) AS n FROM en),
      sd AS (SELECT j, sqrt(greatest(sum(x * x) - sum(x) * sum(x) / n, 0e0) / (n - 1)) AS sd FROM en, n GROUP BY j, n)
      SELECT k AS row_key, j AS idx, {rnd("CASE WHEN sd > 0 THEN x / sd ELSE 0e0 END")} AS x FROM en JOIN sd USING (j)"""
    found["sweep_runs_sparse"] = _sparse_sweep()
    found["parse_run_log_text"] = _LOG_FILES
    found["train_lr_sparse"] = sparse_training_sql(0.01)
    plain = training_sql({"updater": "simple", "step_size": q.STEP / 2, "num_iterations": q.LONG_STEPS})
    found["train_lr_plugged"] = f"SELECT 'halved' AS updater, entry, pos, value FROM ({plain})"
    found["feat_std_scale_rows_join"] = found["feat_std_scale_rows_sparse"]
    found["train_lr_sparse_join"] = sparse_training_sql(0.01)
    return found
