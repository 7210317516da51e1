"""DuckDB SQL stating each registered query independently of the Spark code.

Opponents are found by self-joins, distributions by one plain GROUP BY each, and
regressions by Gram-Schmidt, so the two sides share no method.
"""

from __future__ import annotations

import math

MIN_ROUNDS = 60
SERIES_ROUNDS = 20
SERIES_MIN_ROUNDS = 20

# Another payoff of each choice (row) against each opponent's, and weights of some dependencies.
OTHER_PAYOFF = ((1.0, -2.0, 3.0), (4.0, 0.5, -1.0), (-3.0, 2.0, 0.0))
PLAIN_PAYOFF = ((0, -1, 1), (1, 0, -1), (-1, 1, 0))
OTHER_WEIGHTS = {"prev_move": 0.25, "prev_2move": 0.5}

# Games of other numbers of choices: paper and well beat two of the others; of twenty choices each beats
# the nine before it on a circle. Their transitions pay off as those of the plain game.
FOUR = ("rock", "paper", "scissors", "well")
FOUR_PAYOFF = ((0, -1, 1, -1), (1, 0, -1, 1), (-1, 1, 0, -1), (1, -1, 1, 0))
TWENTY = tuple(f"c{i:02}" for i in range(20))
TWENTY_PAYOFF = tuple(tuple((0, *[1] * 9, 0, *[-1] * 9)[(i - j) % 20] for j in range(20)) for i in range(20))

# By variant: choices, payoff, and the move of an event in SQL.
PLAIN = (
    ("rock", "paper", "scissors"),
    PLAIN_PAYOFF,
    """CASE event_type WHEN 'click' THEN 'rock' WHEN 'signup' THEN 'rock' WHEN 'view' THEN 'paper'
                         WHEN 'purchase' THEN 'scissors' WHEN 'error' THEN 'none' END""",
)
PLAYED = {
    "four": (
        FOUR,
        FOUR_PAYOFF,
        """CASE event_type WHEN 'click' THEN 'rock' WHEN 'signup' THEN 'well' WHEN 'view' THEN 'paper'
                         WHEN 'purchase' THEN 'scissors' WHEN 'error' THEN 'none' END""",
    ),
    "twenty": (
        TWENTY,
        TWENTY_PAYOFF,
        "CASE event_type WHEN 'error' THEN 'none' ELSE 'c' || lpad(CAST(event_id % 20 AS VARCHAR), 2, '0') END",
    ),
}

GAME = ("game_id", "player_id")
PLAYER = ("player_id",)


def r(x: str, digits: int = 8) -> str:
    """Round, without negative zero."""
    return f"CASE WHEN abs({x}) < 0.5e-{digits} THEN 0.0 ELSE round({x}, {digits}) END"


def rounds_ctes(variant: str = "ragged") -> str:
    join = "JOIN" if variant == "paired" else "LEFT JOIN"
    series = variant == "series"
    game = (
        f"(a.user_id // 2) * 2147483648 + (a.rn - 1) // {SERIES_ROUNDS}" if series else "a.user_id // 2"
    )
    number = f"(a.rn - 1) % {SERIES_ROUNDS} + 1" if series else "a.rn"
    least = SERIES_MIN_ROUNDS if series else MIN_ROUNDS
    choices, payoff, move = PLAYED.get(variant, PLAIN)

    def paying(sign: int) -> str:
        return ", ".join(
            f"'{a}|{b}'" for a, row in zip(choices, payoff) for b, x in zip(choices, row)
            if (x > 0) - (x < 0) == sign)

    return f"""
ev AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
         {move} AS move
  FROM events),
all_rounds AS (
  SELECT CAST({game} AS BIGINT) AS game_id, a.user_id AS player_id,
         CAST({number} AS INTEGER) AS round_index, a.move AS player_move,
         CASE WHEN b.move IS NULL THEN NULL WHEN a.move = b.move THEN 'tie'
              WHEN a.move = 'none' THEN 'loss' WHEN b.move = 'none' THEN 'win'
              WHEN a.move || '|' || b.move IN ({paying(1)}) THEN 'win'
              WHEN a.move || '|' || b.move IN ({paying(0)}) THEN 'tie'
              ELSE 'loss' END AS player_outcome
  FROM ev a {join} ev b ON a.user_id // 2 = b.user_id // 2 AND a.user_id <> b.user_id AND a.rn = b.rn),
rounds AS (
  SELECT * FROM all_rounds WHERE player_id NOT IN (
    SELECT player_id FROM all_rounds GROUP BY player_id HAVING max(round_index) < {least}))"""


def transition(before: str, after: str, choices=PLAIN[0]) -> str:
    near = list(zip(choices, (*choices[1:], choices[0])))
    up, down = (", ".join(f"'{a}|{b}'" for a, b in pairs) for pairs in (near, [(b, a) for a, b in near]))
    return f"""CASE WHEN {before} = {after} THEN '0'
      WHEN {before} || '|' || {after} IN ({up}) THEN '+'
      WHEN {before} || '|' || {after} IN ({down}) THEN '-' END"""


def features_ctes(keys=GAME, variant: str = "ragged") -> str:
    part = ", ".join(keys)
    order = "round_index" if keys == GAME else "game_id, round_index"
    choices = PLAYED.get(variant, PLAIN)[0]
    both = "prev_outcome IS NOT NULL AND prev_move <> 'none' AND player_move <> 'none'"
    return rounds_ctes(variant) + f""",
lagged AS (
  SELECT *, lag(player_move, 1) OVER w AS prev_move, lag(player_move, 2) OVER w AS prev_move2,
         lag(player_outcome, 1) OVER w AS prev_outcome
  FROM rounds WINDOW w AS (PARTITION BY {part} ORDER BY {order})),
paired AS (
  SELECT a.*, b.prev_move AS opponent_prev_move
  FROM lagged a LEFT JOIN lagged b
    ON a.game_id = b.game_id AND a.round_index = b.round_index AND a.player_id <> b.player_id
   AND a.prev_move IS NOT NULL AND b.prev_move IS NOT NULL),
strict AS (SELECT * FROM lagged WHERE {both}),
feats AS (
  SELECT a.*, c.prev_move AS opponent_prev_move_both,
         {transition('a.prev_move', 'a.player_move', choices)} AS transition,
         {transition('a.prev_move2', 'a.prev_move', choices)} AS prev_transition,
         {transition('a.opponent_prev_move', 'a.player_move', choices)} AS cournot_transition,
         {transition('c.prev_move', 'a.player_move', choices)} AS cournot_transition_both
  FROM paired a
  LEFT JOIN strict s ON a.game_id = s.game_id AND a.round_index = s.round_index AND a.player_id = s.player_id
  LEFT JOIN strict c ON s.game_id = c.game_id AND s.round_index = c.round_index AND s.player_id <> c.player_id)"""


# By name: category columns, context columns, population.
MOVED = "player_move <> 'none'"
# Fixed values, as in the library.
OBSERVED = {
    "move": ("player_move", "", MOVED),
    "transition": ("transition", "", f"prev_move <> 'none' AND {MOVED}"),
    "cournot_transition": ("cournot_transition", "", f"opponent_prev_move <> 'none' AND {MOVED}"),
    "prev_move": ("player_move", "prev_move", f"prev_move <> 'none' AND {MOVED}"),
    "opponent_prev_move": ("player_move", "opponent_prev_move", f"opponent_prev_move <> 'none' AND {MOVED}"),
    "outcome_transition": (
        "transition", "prev_outcome", f"prev_outcome IS NOT NULL AND prev_move <> 'none' AND {MOVED}"),
    "outcome_cournot_transition": (
        "cournot_transition_both", "prev_outcome", f"opponent_prev_move_both <> 'none' AND {MOVED}"),
    "prev_2move": (
        "player_move", "prev_move, prev_move2", f"prev_move <> 'none' AND prev_move2 <> 'none' AND {MOVED}"),
    "prev_transition_prev_outcome": (
        "transition", "prev_transition, prev_outcome",
        f"prev_outcome IS NOT NULL AND prev_move <> 'none' AND prev_move2 <> 'none' AND {MOVED}"),
}
# Fixed values, as in the library.
CONTEXTS = {
    "prev_move": ("prev_move", "prev_move <> 'none'"),
    "opponent_prev_move": ("opponent_prev_move", "prev_move IS NOT NULL AND opponent_prev_move <> 'none'"),
    "prev_outcome": ("prev_outcome", "prev_outcome IS NOT NULL"),
    "prev_2move": ("prev_move, prev_move2", "prev_move <> 'none' AND prev_move2 <> 'none'"),
    "prev_transition_prev_outcome": (
        "prev_transition, prev_outcome",
        f"prev_outcome IS NOT NULL AND prev_move <> 'none' AND prev_move2 <> 'none' AND {MOVED}"),
}
# Fixed values, as in the library.
GRIDS = ("prev_2move", "prev_transition_prev_outcome")
SIGNS = ("+", "-", "0")
OUTCOMES = ("win", "loss", "tie")


def categories(columns: str, choices) -> list[tuple[str, ...]]:
    return [
        SIGNS if "transition" in c else OUTCOMES if "outcome" in c else choices
        for c in columns.split(", ") if c
    ]


def _values(items) -> str:
    return "(VALUES " + ", ".join(f"('{i}')" for i in items) + ")"


def distribution(name: str, keys=GAME, smoothing: str = "reference", choices=PLAIN[0]) -> str:
    """A SELECT over feats: keys, contexts, category, n, total, p."""
    category, context, where = OBSERVED[name]
    k = ", ".join(keys)
    groups = ", ".join(x for x in (k, context) if x)
    counted = f"""SELECT *, CAST(sum(n) OVER (PARTITION BY {groups}) AS BIGINT) AS total
      FROM (SELECT {groups}, {category}, count(*) AS n FROM feats WHERE {where} GROUP BY {groups}, {category})"""
    if name not in GRIDS:
        return f"SELECT *, n / total AS p FROM ({counted})"
    one, two, last = categories(f"{context}, {category}", choices)
    c1, c2 = context.split(", ")
    cells = f"{k}, {c1}, {c2}, {category}"
    seen = "coalesce(o.total, 0)"
    if smoothing == "laplace":
        seen = f"coalesce(max(o.total) OVER (PARTITION BY {k}, {c1}, {c2}), 0)"
    return f"""SELECT {cells}, n, total, n / total AS p FROM (
      SELECT {cells}, CAST(1 + coalesce(o.n, 0) AS BIGINT) AS n, CAST({len(last)} + {seen} AS BIGINT) AS total
      FROM (SELECT DISTINCT {k} FROM rounds) p
      CROSS JOIN {_values(one)} g1({c1}) CROSS JOIN {_values(two)} g2({c2})
      CROSS JOIN {_values(last)} g3({category})
      LEFT JOIN ({counted}) o USING ({cells}))"""


def context_distribution(name: str, keys=PLAYER) -> str:
    columns, where = CONTEXTS[name]
    k = ", ".join(keys)
    return f"""SELECT *, n / total AS p FROM (
      SELECT *, CAST(sum(n) OVER (PARTITION BY {k}) AS BIGINT) AS total
      FROM (SELECT {k}, {columns}, count(*) AS n FROM feats WHERE {where} GROUP BY {k}, {columns}))"""


def rounded_distribution(body: str, prelude: str) -> str:
    return f"WITH {prelude} SELECT * EXCLUDE (p), {r('p')} AS p FROM ({body})"


# Fixed values, as in the library.
EWCD = {
    "move": "max_exp_wcd_move_dist",
    "transition": "max_exp_wcd_transition",
    "cournot_transition": "max_exp_wcd_transition_cournot",
    "opponent_prev_move": "max_exp_wcd_opponent_prev_move",
    "prev_move": "max_exp_wcd_player_prev_move",
    "outcome_transition": "max_exp_wcd_transition_outcome",
    "outcome_cournot_transition": "max_exp_wcd_cournot_transition_outcome",
    "prev_2move": "max_exp_wcd_player_prev_2move",
    "prev_transition_prev_outcome": "max_exp_wcd_transition_prev_transition_prev_outcome",
}


def best_response(
    name: str, alignment: str = "positional", smoothing: str = "reference", payoff=PLAIN_PAYOFF,
    signs_payoff=None, choices=PLAIN[0],
) -> str:
    """Best expected payoff per player and context, each possible cell stated."""
    category, context, _ = OBSERVED[name]
    if "transition" in category:
        order, payoff = SIGNS, signs_payoff or payoff
    else:
        order = choices if alignment == "aligned" or name == "move" else sorted(choices)
    groups = ", ".join(x for x in ("game_id, player_id", context) if x)
    against = ", ".join(" + ".join(f"x{i} * {p}" for i, p in enumerate(row)) for row in payoff)
    columns = ", ".join(
        f"coalesce(sum(p) FILTER ({category} = '{value}'), 0) AS x{i}" for i, value in enumerate(order))
    return f"""SELECT {groups}, greatest({against}) AS max_util FROM (
      SELECT {groups}, {columns}
      FROM ({distribution(name, GAME, smoothing, choices)}) GROUP BY {groups})"""


def player_wcd(name: str, weights=None, **options) -> str:
    contexts = math.prod(len(c) for c in categories(OBSERVED[name][1], options.get("choices", PLAIN[0])))
    factor = (weights or {}).get(name, f"1.0 / {contexts}")
    return f"""SELECT game_id, player_id, sum(max_util) * 300.0 * {factor} AS win_diff
      FROM ({best_response(name, **options)}) GROUP BY game_id, player_id"""


def game_wcd(name: str, **options) -> str:
    return f"""SELECT game_id, avg(win_diff) AS {EWCD[name]}
      FROM ({player_wcd(name, **options)}) GROUP BY game_id"""


EMPIRICAL = """SELECT game_id, CAST(abs(n - opp) AS BIGINT) AS empirical_wcd FROM (
  SELECT game_id, n, lag(n) OVER (PARTITION BY game_id ORDER BY player_id) AS opp FROM (
    SELECT game_id, player_id, count(*) AS n FROM rounds WHERE player_outcome = 'win'
    GROUP BY game_id, player_id)) WHERE opp IS NOT NULL"""


def summary_ctes(variant: str = "ragged", **options) -> str:
    parts = "".join(f",\nw_{n} AS ({game_wcd(n, **options)})" for n in EWCD)
    joins = " ".join(f"JOIN w_{n} USING (game_id)" for n in EWCD)
    return (
        features_ctes(GAME, variant) + f",\nempirical AS ({EMPIRICAL})" + parts
        + f",\nsummary AS (SELECT * FROM empirical {joins})"
    )


# Fixed values, as in the library.
ENTROPY = {
    "move": "entropy_move_dist",
    "prev_move": "entropy_prev_move",
    "opponent_prev_move": "entropy_opponent_prev_move",
    "prev_2move": "entropy_prev_2move",
    "transition": "entropy_transition",
    "cournot_transition": "entropy_cournot_transition",
    "outcome_transition": "entropy_outcome_transition",
    "outcome_cournot_transition": "entropy_outcome_cournot_transition",
    "prev_transition_prev_outcome": "entropy_prev_transition_prev_outcome",
}


def entropy(name: str, choices=PLAIN[0]) -> str:
    context = OBSERVED[name][1]
    h = "-sum(p * log2(p))"
    if not context:
        return f"""SELECT player_id, {h} AS {ENTROPY[name]}
          FROM ({distribution(name, PLAYER, choices=choices)}) GROUP BY player_id"""
    weights = "prev_outcome" if context == "prev_outcome" else name
    return f"""SELECT player_id, sum(h * w.p) AS {ENTROPY[name]} FROM (
        SELECT player_id, {context}, {h} AS h FROM ({distribution(name, PLAYER, choices=choices)}) GROUP BY player_id, {context})
      JOIN ({context_distribution(weights)}) w USING (player_id, {context}) GROUP BY player_id"""


def gain_ctes(variant: str = "ragged") -> str:
    choices = PLAYED.get(variant, PLAIN)[0]
    parts = "".join(f",\nh_{n} AS ({entropy(n, choices)})" for n in ENTROPY)
    joins = " ".join(f"LEFT JOIN h_{n} USING (player_id)" for n in ENTROPY if n != "move")
    sizes = {n: len(categories(OBSERVED[n][0], choices)[0]) for n in ENTROPY}
    raw = ", ".join(f"log2({sizes[n]}) - {c} AS {n}" for n, c in ENTROPY.items())
    corrected = """SELECT player_id, move, transition, cournot_transition,
      opponent_prev_move - cournot_transition - move AS opponent_prev_move,
      prev_move - transition - move AS prev_move,
      outcome_transition - transition - cournot_transition AS outcome_transition,
      prev_2move - (prev_move - transition - move) - transition - move AS prev_2move,
      prev_transition_prev_outcome - (outcome_transition - transition - cournot_transition)
        - (outcome_cournot_transition - transition - cournot_transition)
        - transition - cournot_transition AS prev_transition_prev_outcome FROM raw"""
    shown = [n for n in ENTROPY if n != "outcome_cournot_transition"]

    def long(table: str, tag: str) -> str:
        return " UNION ALL ".join(
            f"SELECT player_id, '{ENTROPY[n]}' AS entropy_type, {n} AS information_gain,"
            f" '{tag}' AS corrected FROM {table}" for n in shown)

    return features_ctes(PLAYER, variant) + parts + f""",
wide AS (SELECT * FROM h_move {joins}),
raw AS (SELECT player_id, {raw} FROM wide),
fixed AS ({corrected}),
uncorrected AS ({long('raw', 'Uncorrected')}),
corrected AS ({long('fixed', 'Corrected')}),
combined AS (SELECT * FROM uncorrected UNION ALL SELECT * FROM corrected),
gain_summary AS (
  SELECT corrected, entropy_type,
    CASE WHEN count(*) = count(information_gain) THEN avg(information_gain) END AS mean_information_gain,
    CASE WHEN count(*) = count(information_gain)
         THEN stddev_samp(information_gain) / sqrt(count(DISTINCT player_id)) END AS se_information_gain
  FROM combined GROUP BY corrected, entropy_type)"""


# Fixed values, as in the library.
LABELS = (
    ("move", "Choice base rate (R/P/S)"),
    ("transition", "Transition base rate (+/−/0)"),
    ("cournot_transition", "Opponent transition base rate (+/−/0)"),
    ("prev_move", "Choice given player's prior choice"),
    ("opponent_prev_move", "Choice given opponent's prior choice"),
    ("outcome_transition", "Transition given prior outcome (W/L/T)"),
    ("prev_2move", "Choice given player's prior two choices"),
    ("prev_transition_prev_outcome", "Transition given prior transition & prior outcome"),
)


def label_values(names: dict[str, str]) -> str:
    rows = ", ".join(
        "('{}', '{}', {})".format(names[n], label.replace("'", "''"), i)
        for i, (n, label) in enumerate(LABELS))
    return f"(VALUES {rows}) AS labels(metric, label, ordinal)"


# Fixed values, as in the library.
RESIDUALS = {
    "opponent_prev_move_resid": ("opponent_prev_move", ("move", "cournot_transition")),
    "player_prev_move_resid": ("prev_move", ("move", "transition")),
    "player_prev_2move_resid": ("prev_2move", ("move", "prev_move", "transition")),
    "transition_outcome_resid": ("outcome_transition", ("transition", "cournot_transition")),
    "transition_prev_trans_outcome_resid": (
        "prev_transition_prev_outcome", ("outcome_transition", "outcome_cournot_transition")),
}


def gram_schmidt(prefix: str, source: str, pivots: list[str], rest: list[str]) -> tuple[str, str]:
    """CTEs that sweep each pivot out of the later pivots and of `rest`; the last one's name."""
    ctes, current = [], source
    for i, pivot in enumerate(pivots):
        swept = [*pivots[i + 1:], *rest]
        name = f"{prefix}_{i}"
        columns = ", ".join(
            f"{c} - {pivot} * (sum({c} * {pivot}) OVER () / sum({pivot} * {pivot}) OVER ()) AS {c}"
            for c in swept)
        ctes.append(f"{name} AS (SELECT game_id, {columns} FROM {current})")
        current = name
    return ",\n".join(ctes), current


def residual_ctes(variant: str = "ragged") -> str:
    """summary plus the five residuals, as table `resid`."""
    text = summary_ctes(variant) + ",\nbase AS (SELECT *, CAST(1 AS DOUBLE) AS one FROM summary)"
    joins = ""
    for name, (of, on) in RESIDUALS.items():
        ctes, last = gram_schmidt(
            f"gs_{name}", "base", ["one", *(EWCD[n] for n in on)], [EWCD[of]])
        text += f",\n{ctes},\nres_{name} AS (SELECT game_id, {EWCD[of]} AS {name} FROM {last})"
        joins += f" JOIN res_{name} USING (game_id)"
    return text + f",\nresid AS (SELECT * FROM base {joins})"


FULL = ["max_exp_wcd_move_dist", "max_exp_wcd_transition", "max_exp_wcd_transition_cournot", *RESIDUALS]


def ols_ctes(variant: str = "ragged") -> str:
    """Table `y_resid` (residuals of the full model) and one table coef_<i> per term."""
    terms = ["one", *FULL]
    columns = ", ".join(terms)
    text = residual_ctes(variant) + (
        f",\ndesign AS (SELECT game_id, {columns}, CAST(empirical_wcd AS DOUBLE) AS y,"
        " CAST(empirical_wcd AS DOUBLE) AS y0 FROM resid)")
    ctes, last = gram_schmidt("gs_full", "design", terms, ["y"])
    text += f",\n{ctes},\ny_resid AS (SELECT game_id, y AS e FROM {last})"
    for i, term in enumerate(terms):
        others = [t for t in terms if t != term]
        ctes, last = gram_schmidt(f"gs_term{i}", "design", others, [term])
        text += f""",\n{ctes},
coef_{i} AS (
  SELECT {i} AS i, sum(t.{term} * d.y0) / sum(t.{term} * t.{term}) AS estimate,
         sum(t.{term} * t.{term}) AS square FROM {last} t JOIN design d USING (game_id))"""
    return text + f""",
scale AS (SELECT count(*) AS n, CAST(count(*) - {len(terms)} AS BIGINT) AS df, sum(e * e) AS rss FROM y_resid)"""


def coefficients() -> str:
    terms = ["(Intercept)", *FULL]
    names = ", ".join(f"({i}, '{t}')" for i, t in enumerate(terms))
    union = " UNION ALL ".join(f"SELECT * FROM coef_{i}" for i in range(len(terms)))
    # Two-sided tail of Student's t by its finite trigonometric series.
    odd = """1 - 2 / pi() * (theta + sin(theta) * cos(theta) * coalesce(list_sum(list_transform(
      range(0, (df - 1) // 2), lambda k: cos(theta) ** (2 * k)
        * exp(coalesce(list_sum(list_transform(range(1, k + 1), lambda j: ln(2.0 * j / (2 * j + 1)))), 0)))), 0))"""
    even = """1 - sin(theta) * coalesce(list_sum(list_transform(
      range(0, df // 2), lambda k: cos(theta) ** (2 * k)
        * exp(coalesce(list_sum(list_transform(range(1, k + 1), lambda j: ln((2.0 * j - 1) / (2 * j)))), 0)))), 0)"""
    return f"""WITH {ols_ctes()},
terms AS (
  SELECT term, estimate, sqrt(rss / df / square) AS std_error, df
  FROM ({union}) JOIN (VALUES {names}) AS names(i, term) USING (i) CROSS JOIN scale),
tests AS (SELECT *, estimate / std_error AS t_value, atan(abs(estimate / std_error) / sqrt(df)) AS theta FROM terms)
SELECT term, {r('estimate', 6)} AS estimate, {r('std_error', 6)} AS std_error, {r('t_value', 6)} AS t_value,
       {r(f'CASE WHEN df % 2 = 1 THEN {odd} ELSE {even} END', 6)} AS p_value
FROM tests"""


def fit_row() -> str:
    k = len(FULL)
    # Upper tail of F for an even numerator: a finite sum.
    tail = f"""x ** (df / 2.0) * list_sum(list_transform(range(0, {k // 2}), lambda i: (1 - x) ** i
      * exp(coalesce(list_sum(list_transform(range(0, i), lambda j: ln((df + 2.0 * j) / (2 * j + 2)))), 0))))"""
    quartiles = ", ".join(
        f"{r(f'quantile_cont(e, {q})', 6)} AS residual_{n}"
        for n, q in (("min", 0.0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("max", 1.0)))
    return f"""WITH {ols_ctes()},
facts AS (
  SELECT n, df, rss, 1 - rss / tss AS r2, ((tss - rss) / {k}) / (rss / df) AS f
  FROM scale CROSS JOIN (SELECT sum((y0 - m) ** 2) AS tss FROM design, (SELECT avg(y0) AS m FROM design))),
tail AS (SELECT *, df / (df + {k} * f) AS x FROM facts)
SELECT n, CAST({k} AS BIGINT) AS df_model, df AS df_residual, {r('r2', 6)} AS r_squared,
       {r('1 - (1 - r2) * (n - 1) / df', 6)} AS adj_r_squared, {r('sqrt(rss / df)', 6)} AS residual_std_error,
       {r('f', 6)} AS f_statistic, {r(tail, 6)} AS f_p_value, q.*
FROM tail CROSS JOIN (SELECT {quartiles} FROM y_resid) q"""


def correlation_cte(variant: str = "ragged") -> str:
    rows = []
    residual_of = {of: name for name, (of, _) in RESIDUALS.items()}
    for i, (name, label) in enumerate(LABELS):
        label = label.replace("'", "''")
        for column, tag in ((EWCD[name], "Uncorrected"), (residual_of.get(name), "Corrected")):
            if column:
                rows.append(
                    f"SELECT '{label}' AS dependency, '{tag}' AS correction, {i} AS ordinal,"
                    f" corr({column}, empirical_wcd) AS corr, count(DISTINCT game_id) AS n FROM resid")
    return residual_ctes(variant) + f""",
cors AS (SELECT *, sqrt((1 - corr * corr) / (n - 2)) AS se FROM ({" UNION ALL ".join(rows)}))"""


def build() -> dict[str, str]:
    game, player, series = features_ctes(GAME), features_ctes(PLAYER), features_ctes(PLAYER, "series")
    sql = {}
    for variant in ("ragged", "paired", "series", *PLAYED):
        sql[f"complete_rounds_{variant}"] = f"WITH {rounds_ctes(variant)} SELECT * FROM rounds"
    own = "prev_move, prev_move2, prev_outcome, transition, prev_transition"
    other = "opponent_prev_move, opponent_prev_move_both, cournot_transition, cournot_transition_both"
    row = "game_id, player_id, round_index"
    for name, prelude in (("", game), ("_series", series)):
        sql[f"features_own{name}"] = f"WITH {prelude} SELECT {row}, {own} FROM feats"
        sql[f"features_opponent{name}"] = f"WITH {prelude} SELECT {row}, {other} FROM feats"
    for name in OBSERVED:
        sql[f"dist_{name}"] = rounded_distribution(distribution(name), game)
        sql[f"player_dist_{name}"] = rounded_distribution(distribution(name, PLAYER), series)
    for name in CONTEXTS:
        sql[f"context_dist_{name}"] = rounded_distribution(context_distribution(name), player)
        sql[f"player_context_dist_{name}"] = rounded_distribution(context_distribution(name), series)
    for name in GRIDS:
        sql[f"dist_{name}_laplace"] = rounded_distribution(distribution(name, GAME, "laplace"), game)
    for name, column in EWCD.items():
        sql[f"player_wcd_{name}"] = f"""WITH {game} SELECT game_id, player_id, {r('win_diff')} AS {column}
          FROM ({player_wcd(name)})"""
        sql[f"ewcd_{name}"] = f"WITH {game} SELECT game_id, {r(column)} AS {column} FROM ({game_wcd(name)})"
    for alignment, smoothing in (("aligned", "reference"), ("positional", "laplace")):
        ctes = summary_ctes("ragged", alignment=alignment, smoothing=smoothing)
        columns = ", ".join(f"{r(c)} AS {c}" for c in EWCD.values())
        name = alignment if alignment == "aligned" else smoothing
        sql[f"summary_win_diff_{name}"] = f"WITH {ctes} SELECT game_id, empirical_wcd, {columns} FROM summary"
    ctes = summary_ctes("ragged", payoff=OTHER_PAYOFF, weights=OTHER_WEIGHTS)
    columns = ", ".join(f"{r(c)} AS {c}" for c in EWCD.values())
    sql["summary_win_diff_payoff"] = f"WITH {ctes} SELECT game_id, empirical_wcd, {columns} FROM summary"
    sql["empirical_wcd"] = f"WITH {rounds_ctes()} {EMPIRICAL}"
    for suffix, variant in (("", "ragged"), ("_paired", "paired")):
        columns = ", ".join(f"{r(c)} AS {c}" for c in EWCD.values())
        sql[f"summary_win_diff{suffix}"] = (
            f"WITH {summary_ctes(variant)} SELECT game_id, empirical_wcd, {columns} FROM summary")
    for name, column in ENTROPY.items():
        for prefix, prelude in (("", player), ("player_", series)):
            sql[f"{prefix}entropy_{name}"] = (
                f"WITH {prelude} SELECT player_id, {r(column)} AS {column} FROM ({entropy(name)})")
    for variant, (choices, payoff, _) in PLAYED.items():
        prelude = features_ctes(GAME, variant)
        sql[f"features_{variant}"] = f"WITH {prelude} SELECT {row}, {own}, {other} FROM feats"
        for name in ("prev_move", "outcome_transition", *["prev_2move"] * (variant == "four")):
            sql[f"dist_{name}_{variant}"] = rounded_distribution(distribution(name, choices=choices), prelude)
        for smoothing in ("reference", "laplace"):
            options = {"choices": choices, "payoff": payoff, "signs_payoff": PLAIN_PAYOFF, "smoothing": smoothing}
            columns = ", ".join(f"{r(c)} AS {c}" for c in EWCD.values())
            name = f"summary_win_diff_{variant}" + ("" if smoothing == "reference" else f"_{smoothing}")
            sql[name] = (
                f"WITH {summary_ctes(variant, **options)} SELECT game_id, empirical_wcd, {columns} FROM summary")
        sql[f"info_gain_combined_{variant}"] = f"""WITH {gain_ctes(variant)}
          SELECT player_id, entropy_type, corrected, {r('information_gain')} AS information_gain FROM combined"""
    gain = "player_id, entropy_type, corrected, " + r("information_gain") + " AS information_gain"
    for table in ("uncorrected", "corrected", "combined"):
        sql[f"info_gain_{table}"] = f"WITH {gain_ctes()} SELECT {gain} FROM {table}"
    sql["info_gain_combined_series"] = f"WITH {gain_ctes('series')} SELECT {gain} FROM combined"
    sql["info_gain_combined_paired"] = f"WITH {gain_ctes('paired')} SELECT {gain} FROM combined"
    mean, se = "mean_information_gain", "se_information_gain"
    for suffix, variant in (("", "ragged"), ("_paired", "paired"), ("_series", "series")):
        ctes = gain_ctes(variant)
        sql[f"info_gain_summary{suffix}"] = f"""WITH {ctes}
          SELECT corrected, entropy_type, {r(mean)} AS {mean}, {r(se)} AS {se} FROM gain_summary"""
        sql[f"info_gain_figure{suffix}"] = f"""WITH {ctes}
          SELECT label AS entropy_type, ordinal, corrected, {r(mean)} AS {mean},
                 {r(f'{mean} - {se}')} AS lower, {r(f'{mean} + {se}')} AS upper
          FROM gain_summary LEFT JOIN {label_values(ENTROPY)} ON entropy_type = metric"""
    for name in RESIDUALS:
        sql[f"resid_{name.removesuffix('_resid')}"] = (
            f"WITH {residual_ctes()} SELECT game_id, {r(name, 6)} AS {name} FROM resid")
    sql["ols_coefficients"] = coefficients()
    sql["ols_fit"] = fit_row()
    sql["corr_table"] = f"""WITH {correlation_cte()}
      SELECT dependency, correction, {r('corr', 6)} AS corr, {r('se', 6)} AS se FROM cors"""
    # The z-score of a two-sided interval of 95 %.
    reach = "1.959963984540054 / sqrt(n - 3)"
    sql["corr_test"] = f"""WITH {correlation_cte()}
      SELECT dependency, correction, {r('corr', 6)} AS corr, {r('corr * sqrt((n - 2) / (1 - corr * corr))', 6)} AS t_value,
             n - 2 AS df, {r(f'tanh(atanh(corr) - {reach})', 6)} AS lower, {r(f'tanh(atanh(corr) + {reach})', 6)} AS upper FROM cors"""
    sql["corr_figure"] = f"""WITH {correlation_cte()}
      SELECT dependency, ordinal, correction, {r('corr', 6)} AS corr, {r('corr - se', 6)} AS lower,
             {r('corr + se', 6)} AS upper FROM cors"""
    return sql
