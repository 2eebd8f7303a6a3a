"""SQL counterparts of the registered queries, for DuckDB over the same tables.

Each query names the common table expressions it needs; ``sql`` adds them and everything they depend on.
"""

from __future__ import annotations

import re

from lumenmatch import datasets as d
from lumenmatch.functions import media, paths, scoring
from lumenmatch.operators import banks, clusters, diagnostics as dg, evidence as ev, frames as fr, mentions as mn, reports as rp
from lumenmatch.sources import listings, posts as po

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body)


def sql(body: str, *needs: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][0]:
            visit(dep)
        order.append(name)

    for need in needs:
        visit(need)
    if not order:
        return body
    parts = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order)
    return f"WITH {parts}\n{body}"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pick(values, index: str) -> str:
    items = ", ".join(lit(v) if isinstance(v, str) else f"{v!r}" for v in values)
    kind = "VARCHAR" if isinstance(values[0], str) else "DOUBLE" if isinstance(values[0], float) else "BIGINT"
    return f"([{items}]::{kind}[])[CAST({index} AS BIGINT) + 1]"


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def unit(v: str) -> str:
    return f"list_transform({v}, lambda x: x / sqrt(list_dot_product({v}, {v})))"


def mixed(base: str, weight: str, other: str) -> str:
    return f"list_transform(list_zip({base}, {other}), lambda t: t[1] + ({weight}) * t[2])"


def rnd(expr: str, places: int = 6) -> str:
    return f"(round({expr}, {places}) + 0.0::DOUBLE)"


def cond(pairs, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


def clamp(expr: str, low: float, high: float) -> str:
    return f"greatest({low!r}::DOUBLE, least({high!r}::DOUBLE, {expr}))"


def mean_vector(source: str, keys: str, column: str) -> str:
    """Component mean of ``column`` per ``keys``."""
    return (
        f"SELECT {keys}, list(m ORDER BY i) AS v FROM (SELECT {keys}, i, avg(x) AS m FROM (SELECT {keys}, "
        f"unnest(generate_series(1, len({column}))) AS i, unnest({column}) AS x FROM {source}) GROUP BY {keys}, i) GROUP BY {keys}"
    )


# --- derived inputs ----------------------------------------------------------------------------------------------

cte("ev", f"SELECT vec_id, vec_id // {d.CAMPAIGN_SIZE} AS campaign_id, vec_id % {d.CAMPAIGN_SIZE} AS slot, embedding::DOUBLE[] AS e FROM embeddings")
cte(
    "vec",
    """SELECT *, CASE WHEN slot = 0 THEN 'target' WHEN slot <= n_ref THEN 'reference' WHEN slot <= n_ref + n_neg THEN 'competitor'
    ELSE 'target' END AS role FROM (SELECT a.*, b.e AS theme, a.campaign_id % 10 AS p,
    CASE WHEN a.campaign_id % 10 < 5 THEN 12 WHEN a.campaign_id % 10 < 9 THEN 8 ELSE 2 END AS n_ref,
    CASE WHEN a.campaign_id % 10 < 8 THEN 3 ELSE 0 END AS n_neg
    FROM ev a JOIN (SELECT campaign_id, e FROM ev WHERE slot = 0) b USING (campaign_id))""",
    "ev",
)
cte(
    "bank",
    f"SELECT campaign_id, ref_id, ref_name, {unit('m')} AS e FROM (SELECT campaign_id, vec_id AS ref_id, "
    f"{pick(['logo', 'cup', 'bottle', 'store', 'img'], 'slot % 5')} || '_' || vec_id || '.jpg' AS ref_name, "
    f"{mixed('theme', '0.3::DOUBLE + 0.15::DOUBLE * p', 'e')} AS m FROM vec WHERE role = 'reference')",
    "vec",
)
cte(
    "neg",
    f"SELECT campaign_id, neg_id, neg_name, CASE WHEN p % 2 = 0 THEN {unit('m')} ELSE e END AS e FROM (SELECT campaign_id, "
    f"vec_id AS neg_id, 'rival_' || vec_id AS neg_name, p, e, {mixed('theme', '0.9::DOUBLE', 'e')} AS m FROM vec WHERE role = 'competitor')",
    "vec",
)
cte(
    "tgt",
    f"""SELECT *, edge_mean * (0.7::DOUBLE + 0.1::DOUBLE * (target_id % 10)) AS edge_std,
    campaign_id * 100 + ord // 16 AS video_id, ord % 16 AS frame_idx, 'frame_' || target_id || '.jpg' AS frame_name
    FROM (SELECT vec_id AS target_id, campaign_id, wi <= 2 AS expected_match, CASE WHEN wi = 5 THEN e ELSE {unit('m')} END AS e,
    {pick(['tiktok', 'instagram', 'facebook', 'fb', 'youtube', 'clip'], 'slot % 6')} || '_' || vec_id || '.' ||
    {pick(['jpg', 'png', 'mp4', 'JPEG', 'txt'], '(slot + campaign_id) % 5')} AS filename,
    {pick([1080, 1920, 1280, 720, 1000], 'slot % 5')} AS width, {pick([1920, 1080, 720, 1280, 1400], 'slot % 5')} AS height,
    (slot * 37 + vec_id) % 300 AS bottom, (slot * 53 + vec_id) % 200 AS top, (slot * 29 + vec_id) % 120 AS "right",
    (slot * 17 + vec_id) % 60 AS status, (slot * 41 + vec_id) % 150 AS subtitle,
    CASE WHEN vec_id % 97 = 0 THEN 0.0::DOUBLE ELSE (slot % 7 + 10)::DOUBLE END AS edge_mean,
    CASE WHEN slot = 0 THEN {d.CAMPAIGN_SIZE} - first ELSE slot - first END AS ord
    FROM (SELECT *, {mixed('theme', 'weight', 'e')} AS m FROM (SELECT *, n_ref + n_neg + 1 AS first,
    {pick([0.2, 0.6, 0.9, 1.2, 2.0, 0.0], 'wi')} AS weight
    FROM (SELECT *, {pick([0, 1, 5, 0, 4, 1, 0, 2, 3, 0, 5], 'slot % 11')} AS wi FROM vec WHERE role = 'target'))))""",
    "vec",
)
cte(
    "scores",
    "SELECT user_id AS seq_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value / (value + 20) AS score FROM events",
)

# --- banks -------------------------------------------------------------------------------------------------------

cte("pair", f"SELECT t.target_id, t.campaign_id, b.ref_id, b.ref_name, {dot('t.e', 'b.e')} AS sim FROM tgt t JOIN bank b USING (campaign_id)", "tgt", "bank")
cte("cen", f"SELECT campaign_id, {unit('v')} AS c FROM ({mean_vector('bank', 'campaign_id', 'e')})", "bank")
cte("ncen", f"SELECT campaign_id, {unit('v')} AS c FROM ({mean_vector('neg', 'campaign_id', 'e')})", "neg")
cte("csim", f"SELECT b.campaign_id, b.ref_id, b.ref_name, {dot('b.e', 'c.c')} AS sim FROM bank b JOIN cen c USING (campaign_id)", "bank", "cen")
cte("bvar", "SELECT campaign_id, count(*) AS n_refs, stddev_pop(sim) AS variance FROM csim GROUP BY 1", "csim")
cte("rpair", f"SELECT a.campaign_id, a.ref_id, b.ref_id AS other, {dot('a.e', 'b.e')} AS sim FROM bank a JOIN bank b ON a.campaign_id = b.campaign_id AND a.ref_id <> b.ref_id", "bank")
cte(
    "intra",
    "SELECT n.campaign_id, n.n_refs, coalesce(m, 1.0::DOUBLE) AS mean, coalesce(s, 0.0::DOUBLE) AS std FROM (SELECT campaign_id, count(*) AS n_refs FROM bank GROUP BY 1) n "
    "LEFT JOIN (SELECT campaign_id, avg(sim) AS m, stddev_pop(sim) AS s FROM rpair WHERE ref_id < other GROUP BY 1) USING (campaign_id)",
    "bank", "rpair",
)
cte(
    "sil",
    f"""SELECT i.campaign_id, i.n_refs, coalesce(s.n_negs, 0) AS n_negs, coalesce(s.s, {clamp('(i.mean - 0.5) * 2', 0.0, 1.0)}) AS s FROM intra i LEFT JOIN (
    SELECT campaign_id, max(n) AS n_negs, avg(CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END) AS s FROM (
    SELECT r.campaign_id, r.ref_id, coalesce(x.a, 0.0::DOUBLE) AS a, y.b, y.n FROM bank r
    LEFT JOIN (SELECT campaign_id, ref_id, avg(1 - sim) AS a FROM rpair GROUP BY 1, 2) x USING (campaign_id, ref_id)
    JOIN (SELECT b.campaign_id, b.ref_id, avg(1 - {dot('b.e', 'n.e')}) AS b, count(*) AS n FROM bank b JOIN neg n USING (campaign_id) GROUP BY 1, 2) y USING (campaign_id, ref_id))
    GROUP BY 1) s USING (campaign_id)""",
    "bank", "neg", "rpair", "intra",
)
cte(
    "coh",
    f"""SELECT *, CASE WHEN s > 0.65 AND n_out = 0 THEN 'EXCELLENT' WHEN s > 0.40 AND n_out <= 1 THEN 'GOOD' ELSE 'WEAK' END AS grade
    FROM (SELECT sil.*, intra.mean, intra.std, coalesce(o.names, []::VARCHAR[]) AS names, coalesce(len(o.names), 0) AS n_out FROM sil JOIN intra USING (campaign_id)
    LEFT JOIN (SELECT campaign_id, list(ref_name ORDER BY ref_id) AS names FROM csim WHERE sim < {banks.OUTLIER_BELOW}::DOUBLE GROUP BY 1) o USING (campaign_id))""",
    "sil", "intra", "csim",
)


def kmeans(prefix: str, k: int, iters: int) -> None:
    """Seeds s1..sk, then ``iters`` rounds; an assignment that repeats gives the same centres again."""
    cte(f"{prefix}s1", "SELECT campaign_id, 0 AS j, ref_id, e FROM (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY ref_id) AS r FROM bank) WHERE r = 1", "bank")
    for step in range(2, k + 1):
        prev = f"{prefix}s{step - 1}"
        cte(
            f"{prefix}s{step}",
            f"""SELECT * FROM {prev} UNION ALL SELECT campaign_id, {step - 1}, ref_id, e FROM (SELECT *, row_number() OVER (PARTITION BY campaign_id
            ORDER BY d DESC, ref_id) AS r FROM (SELECT b.campaign_id, b.ref_id, b.e, min(1 - {dot('b.e', 's.e')}) AS d, any_value(n.n) AS n FROM bank b
            JOIN {prev} s USING (campaign_id) JOIN (SELECT campaign_id, count(*) AS n FROM bank GROUP BY 1) n USING (campaign_id)
            GROUP BY 1, 2, 3)) WHERE r = 1 AND n >= {step}""",
            "bank", prev,
        )
    centers = f"{prefix}s{k}"
    first = f"{prefix}a1"
    for it in range(1, iters + 1):
        cte(
            f"{prefix}a{it}",
            f"""SELECT campaign_id, ref_id, e, j FROM (SELECT b.campaign_id, b.ref_id, b.e, c.j, row_number() OVER (PARTITION BY b.campaign_id, b.ref_id
            ORDER BY {dot('b.e', 'c.e')} DESC, c.j) AS r FROM bank b JOIN {centers} c USING (campaign_id)) WHERE r = 1""",
            "bank", centers,
        )
        cte(
            f"{prefix}c{it}",
            f"""SELECT o.campaign_id, o.j, CASE WHEN f.frozen OR n.v IS NULL THEN o.e ELSE {unit('n.v')} END AS e FROM {centers} o
            JOIN (SELECT campaign_id, max(j) = 0 AND count(*) > 1 AS frozen FROM {first} GROUP BY 1) f USING (campaign_id)
            LEFT JOIN ({mean_vector(f'{prefix}a{it}', 'campaign_id, j', 'e')}) n ON n.campaign_id = o.campaign_id AND n.j = o.j""",
            f"{prefix}a{it}", centers, first,
        )
        centers = f"{prefix}c{it}"
    cte(
        f"{prefix}stat",
        f"""SELECT a.campaign_id, a.j, count(*) AS n_members, any_value(c.e) AS c, avg({dot('a.e', 'c.e')}) AS mean, stddev_pop({dot('a.e', 'c.e')}) AS std,
        {', '.join(f"count(*) FILTER (WHERE regexp_matches(lower(b.ref_name), {lit('|'.join(w))})) AS {n}" for n, w in clusters.CATEGORIES.items())}
        FROM {prefix}a{iters} a JOIN {centers} c USING (campaign_id, j) JOIN bank b USING (campaign_id, ref_id) GROUP BY 1, 2""",
        f"{prefix}a{iters}", centers, "bank",
    )


kmeans("k4", 4, 25)
kmeans("k3", 3, 20)
_cats = list(clusters.CATEGORIES)
cte(
    "clu",
    "SELECT *, "
    + cond(
        [(f"{c} > 0 AND {c} = greatest({', '.join(_cats)})", lit(c)) for c in _cats] + [("mean > 0.88", "'logo_refs'"), ("mean > 0.78", "'drink_refs'")],
        "'store_refs'",
    )
    + " AS label FROM k4stat",
    "k4stat",
)

# --- scoring -----------------------------------------------------------------------------------------------------

cte(
    "tstat",
    """SELECT target_id, campaign_id, count(*) AS n_refs, max(sim) AS mx, avg(sim) AS av, avg(sim) FILTER (WHERE r <= 5) AS top5,
    max(ref_name) FILTER (WHERE r = 1) AS best FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY sim DESC, ref_id) AS r FROM pair) GROUP BY 1, 2""",
    "pair",
)
cte(
    "dom",
    f"""SELECT target_id, label, j, s, round(s, 4) AS cs FROM (SELECT t.target_id, c.label, c.j, {dot('t.e', 'c.c')} AS s, row_number() OVER (PARTITION BY t.target_id
    ORDER BY {dot('t.e', 'c.c')} DESC, c.j) AS r FROM tgt t JOIN clu c USING (campaign_id)) WHERE r = 1""",
    "tgt", "clu",
)
cte(
    "ctop",
    """SELECT target_id, avg(sim) AS ct FROM (SELECT p.target_id, p.sim, row_number() OVER (PARTITION BY p.target_id ORDER BY p.sim DESC) AS r FROM pair p
    JOIN dom USING (target_id) JOIN k4a25 m ON m.campaign_id = p.campaign_id AND m.ref_id = p.ref_id AND m.j = dom.j) WHERE r <= 3 GROUP BY 1""",
    "pair", "dom", "k4a25",
)
cte(
    "comp0",
    f"""SELECT target_id, count(*) AS n, max(sim) AS b, avg(sim) FILTER (WHERE r <= 3) AS t3, max(neg_name) FILTER (WHERE r = 1) AS nm FROM (
    SELECT t.target_id, n.neg_name, {dot('t.e', 'n.e')} AS sim, row_number() OVER (PARTITION BY t.target_id ORDER BY {dot('t.e', 'n.e')} DESC, n.neg_id) AS r
    FROM tgt t JOIN neg n USING (campaign_id)) GROUP BY 1""",
    "tgt", "neg",
)
cte(
    "comp",
    f"""SELECT *, CASE WHEN o > 0.60 THEN least(0.35::DOUBLE, (amb * 0.18 + greatest(0.0::DOUBLE, (o - 0.65) * 0.22)) * (1 / (1 + exp(-12 * (o - 0.68))))) ELSE 0.0::DOUBLE END AS pen
    FROM (SELECT *, 1.0::DOUBLE - {clamp('(mx - o) / 0.12', 0.0, 1.0)} AS amb FROM (
    SELECT c.*, s.mx, c.b * 0.5 + c.t3 * 0.3 + {dot('t.e', 'x.c')} * 0.2 AS o FROM comp0 c JOIN tgt t USING (target_id) JOIN tstat s USING (target_id) JOIN ncen x ON x.campaign_id = t.campaign_id))""",
    "comp0", "tgt", "tstat", "ncen",
)
cte(
    "ctx",
    f"""SELECT *, vertical OR overlays OR mobile AS social, {cond([("len(rs) = 0", lit(media.DEFAULT_REASON))], "array_to_string(rs, ', ')")} AS reasoning,
    round(greatest(-0.08::DOUBLE, least(0.0::DOUBLE, 0.0::DOUBLE + CASE WHEN vertical THEN -0.04::DOUBLE ELSE 0 END + CASE WHEN mobile THEN -0.02::DOUBLE ELSE 0 END
    + CASE WHEN subs THEN -0.01::DOUBLE ELSE 0 END + CASE WHEN overlays AND NOT subs THEN -0.01::DOUBLE ELSE 0 END + CASE WHEN level > 0.6 THEN -0.02::DOUBLE ELSE 0 END)), 4) AS off
    FROM (SELECT *, list_filter([CASE WHEN vertical THEN {lit(media.OFFSET_RULES[0][2])} END, CASE WHEN mobile THEN {lit(media.OFFSET_RULES[1][2])} END,
    CASE WHEN subs THEN {lit(media.OFFSET_RULES[2][2])} END, CASE WHEN overlays AND NOT subs THEN {lit(media.OFFSET_RULES[3][2])} END,
    CASE WHEN level > 0.6 THEN {lit(media.OFFSET_RULES[4][2])} END], lambda x: x IS NOT NULL) AS rs
    FROM (SELECT *, aspect < 0.80 AS vertical, subtitle > 90 AS subs, bottom > 150 OR top > 150 OR "right" > 80 OR subtitle > 90 AS overlays,
    aspect < 0.80 AND (status > 35 OR aspect <= 0.60) AS mobile
    FROM (SELECT *, width::DOUBLE / height AS aspect, CASE WHEN edge_mean > 0 AND edge_std / edge_mean < 1.3 THEN least(1.0::DOUBLE, (1.3 - edge_std / edge_mean) / 0.5) ELSE 0.0::DOUBLE END AS level FROM tgt)))""",
    "tgt",
)


def threshold(base: float, low: float, high: float, offset: str) -> str:
    return clamp(
        f"{base}::DOUBLE - CASE WHEN variance > 0.08 THEN 0.05::DOUBLE WHEN variance > 0.05 THEN 0.03::DOUBLE ELSE 0 END + CASE WHEN n_refs >= 10 THEN 0.02::DOUBLE ELSE 0 END + {offset}",
        low, high,
    )


def calibrated(score: str, strong: str, possible: str) -> str:
    gap = f"CASE WHEN {strong} <= {possible} THEN {possible} + 0.15::DOUBLE - {possible} ELSE {strong} - {possible} END"
    return clamp(
        f"1 / (1 + exp(-({scoring.SIGMOID_SCALE}::DOUBLE / greatest(0.01::DOUBLE, {gap})) * ({score} - {possible}))) * CASE WHEN {score} < 0.40 THEN ({score} / 0.40) * ({score} / 0.40) ELSE 1 END",
        0.0, 1.0,
    )


def boostable(label: str) -> str:
    listed = ", ".join(lit(x) for x in scoring.BOOST_LABELS)
    return f"({label} IN ({listed}) OR " + " OR ".join(f"contains({label}, {lit(p)})" for p in scoring.BOOST_LABEL_PARTS) + ")"


def decision(source: str, best: str, comp: str, social: str, label: str) -> str:
    """Calibrated score, boosts, boosted confidence and verdict over rows with primary_score, strong and possible."""
    bands = scoring.VERDICT_BANDS
    return f"""SELECT *, {cond([(f"conf >= {b}", lit(t)) for b, t, _, _ in bands], "'NO_MATCH'")} AS match_type, conf >= 0.65 AS campaign_match,
    {cond([(f"conf >= {b}", lit(v)) for b, _, _, v in bands], "'Irrelevant'")} AS verdict
    FROM (SELECT *, CASE WHEN soc > 0 OR prod > 0 THEN least(0.98::DOUBLE, cal + soc + prod) ELSE cal END AS conf
    FROM (SELECT *, {calibrated('primary_score', 'strong', 'possible')} AS cal,
    CASE WHEN {comp} >= 0.65 THEN 0.0::DOUBLE WHEN {social} AND {best} >= 0.78 THEN CASE WHEN {boostable(label)} THEN 0.08::DOUBLE ELSE 0.05::DOUBLE END ELSE 0.0::DOUBLE END AS soc,
    CASE WHEN {comp} >= 0.65 THEN 0.0::DOUBLE WHEN {boostable(label)} AND {best} >= 0.80 THEN CASE WHEN {best} >= 0.86 THEN 0.07::DOUBLE ELSE 0.05::DOUBLE END ELSE 0.0::DOUBLE END AS prod
    FROM {source}))"""


cte(
    "img0",
    f"""SELECT t.target_id, t.campaign_id, t.filename, t.expected_match, t.video_id, t.frame_idx, t.frame_name, s.n_refs, s.mx, s.av, s.top5, s.best, v.variance, dom.label, dom.j, dom.s, dom.cs, ctop.ct,
    coalesce(c.n, 0) AS n_negs, coalesce(c.nm, '') AS rival, coalesce(round(c.b, 4), 0.0::DOUBLE) AS comp, coalesce(round(c.amb, 4), 0.0::DOUBLE) AS amb,
    coalesce(round(c.pen, 4), 0.0::DOUBLE) AS penalty, coalesce(c.amb > 0.45 OR c.b > 0.72, false) AS ambiguous, c.b AS rawb, c.pen AS rawpen, {dot('t.e', 'g.c')} AS gsim,
    s.mx * 0.5::DOUBLE + dom.cs * 0.3::DOUBLE + ctop.ct * 0.2::DOUBLE AS fused, x.social, x.off, x.reasoning, x.aspect, x.overlays, x.level, x.subs, x.mobile
    FROM tgt t JOIN tstat s USING (target_id) JOIN bvar v ON v.campaign_id = t.campaign_id JOIN cen g ON g.campaign_id = t.campaign_id JOIN dom USING (target_id)
    JOIN ctop USING (target_id) LEFT JOIN comp c USING (target_id) JOIN ctx x USING (target_id)""",
    "tgt", "tstat", "bvar", "cen", "dom", "ctop", "comp", "ctx",
)
cte(
    "img1",
    f"SELECT *, {clamp('fused - penalty', 0.0, 1.0)} AS primary_score, {threshold(0.85, 0.75, 0.92, 'off')} AS strong, {threshold(0.70, 0.60, 0.80, 'off')} AS possible FROM img0",
    "img0",
)
cte("img2", decision("img1", "mx", "comp", "social", "label"), "img1")


def cloned(suffix: str, names: tuple[str, ...], renamed: dict[str, str]) -> None:
    """The CTEs ``names`` over other inputs: every mention of one of them or of a renamed input gets the other name."""
    of = {n: f"{n}{suffix}" for n in names} | renamed
    word = re.compile(r"\b(" + "|".join(of) + r")\b(?!\s*\()")
    for n in names:
        needs, body = CTES[n]
        cte(of[n], word.sub(lambda m: of[m[1]], body), *[of.get(x, x) for x in needs])


def message(text: str, *args: str) -> str:
    """printf of a message; ``%s`` slots of three-place numbers take ``f3`` arguments."""
    return f"printf({lit(text)}, {', '.join(args)})"


def f3(expr: str) -> str:
    return f"printf('%.3f', {expr})"


def diag(best: str, comp: str, amb: str) -> list[str]:
    return [
        cond([(f"{comp} > 0.75", message(dg.HIGH_OVERLAP, f3(comp))), (f"{comp} > 0.65 AND {amb} > 0.4", message(dg.AMBIGUITY, f3(comp), f3(best)))], "NULL"),
        cond([("variance > 0.08", message(dg.WEAK_CLUSTER, f3("variance"))), ("n_refs < 3", message(dg.FEW_REFERENCES, "n_refs"))], "NULL"),
        cond([(f"{best} > 0.85 AND primary_score < 0.70", message(dg.LOCALIZED, f3(best), f3("primary_score")))], "NULL"),
    ]


RIVAL_TEXT = (
    "Competitor match '%s' (similarity: %.3f) is very close to campaign positive (similarity: %.3f). "
    "Active margin: %.3f. Competitor penalty applied: %.3f."
)
cte(
    "img",
    "SELECT *, list_filter(["
    + ", ".join(
        [
            f"CASE WHEN ambiguous THEN {message(RIVAL_TEXT, 'rival', 'rawb', 'mx', 'mx - rawb', 'rawpen')} END",
            f"CASE WHEN soc > 0 THEN {message(dg.SOCIAL_IMAGE, 'soc')} END",
            f"CASE WHEN prod > 0 THEN {message(dg.BRAND_IMAGE, 'prod')} END",
            *diag("mx", "comp", "amb"),
        ]
    )
    + "], lambda w: w IS NOT NULL) AS warnings FROM img2",
    "img2",
)
_steps = [
    message(dg.STEP_BANK, "n_refs"),
    message(dg.STEP_CLUSTER, "label", "cs"),
    lit(dg.STEP_IMAGE),
    message(dg.STEP_BEST, "best", "round(mx, 4)"),
    cond([("rival <> '' AND comp > 0.70", message(dg.STEP_CONFLICT, "rival", "comp")), ("rival <> '' AND comp > 0", message(dg.STEP_LOW_COMPETITOR, "rival", "comp"))], lit(dg.STEP_NO_COMPETITOR)),
    f"CASE WHEN soc > 0 THEN {message(dg.STEP_SOCIAL, 'soc')} END",
    f"CASE WHEN prod > 0 THEN {message(dg.STEP_PRODUCT, 'prod')} END",
    message(dg.STEP_SIGMOID, "conf * 100"),
    cond([("conf >= possible", message(dg.STEP_CONFIRMED, "conf * 100", "possible * 100"))], message(dg.STEP_REJECTED, "conf * 100", "possible * 100")),
]

# --- sequences ---------------------------------------------------------------------------------------------------


def suppressed(source: str) -> str:
    return f"""SELECT seq_id, idx, score, n, CASE WHEN n < 3 THEN score
    WHEN score - l > 0.18 AND score - r > 0.18 THEN (l + r) / 2 + 0.05 * (score - (l + r) / 2)
    WHEN l IS NULL AND score - r > 0.18::DOUBLE * 1.5 THEN r + 0.05 * (score - r)
    WHEN r IS NULL AND score - l > 0.18::DOUBLE * 1.5 THEN l + 0.05 * (score - l) ELSE score END AS sup
    FROM (SELECT *, lag(score) OVER w AS l, lead(score) OVER w AS r, count(*) OVER (PARTITION BY seq_id) AS n FROM {source} WINDOW w AS (PARTITION BY seq_id ORDER BY idx))"""


def smoothed(source: str, column: str, weights) -> str:
    half = len(weights) // 2
    near = [(f"lag({column}, {half - i}) OVER w" if i < half else f"lead({column}, {i - half}) OVER w" if i > half else column, w) for i, w in enumerate(weights)]
    top = " + ".join(f"coalesce({e} * {w!r}::DOUBLE, 0)" for e, w in near)
    low = " + ".join(f"CASE WHEN {e} IS NULL THEN 0 ELSE {w!r}::DOUBLE END" for e, w in near)
    return f"SELECT *, CASE WHEN n < 3 THEN {column} ELSE ({top}) / ({low}) END AS smo FROM {source} WINDOW w AS (PARTITION BY seq_id ORDER BY idx)"


K5 = (0.1, 0.2, 0.4, 0.2, 0.1)
K7 = tuple(w / sum((0, 1, 2, 3, 2, 1, 0)) for w in (0, 1, 2, 3, 2, 1, 0))
cte("sup", suppressed("scores"), "scores")
cte("smo", smoothed("sup", "sup", K5), "sup")


def segments(source: str, column: str, thr: str) -> str:
    return f"""SELECT seq_id, min(idx) AS start_frame, max(idx) AS end_frame, count(*) AS duration_frames, round(avg({column}), 4) AS average_score
    FROM (SELECT *, idx - row_number() OVER (PARTITION BY seq_id ORDER BY idx) AS g FROM {source} WHERE {column} >= {thr}) GROUP BY seq_id, g"""


def runs(source: str, column: str, thr: str) -> str:
    return f"""SELECT seq_id, n, longest_streak, round(longest_streak / n, 4) AS streak_ratio,
    round(CASE WHEN longest_streak > 0 THEN 0.6::DOUBLE * least(1.0::DOUBLE, longest_streak / 4) + 0.4::DOUBLE * (longest_streak / n) ELSE 0 END, 4) AS frame_continuity_score
    FROM (SELECT x.seq_id, x.n, coalesce(y.m, 0) AS longest_streak FROM (SELECT seq_id, count(*) AS n FROM {source} GROUP BY 1) x
    LEFT JOIN (SELECT seq_id, max(duration_frames) AS m FROM ({segments(source, column, thr)}) GROUP BY 1) y USING (seq_id))"""


def strength(source: str, column: str, thr: str) -> str:
    return f"""SELECT c.*, round({clamp('0.7::DOUBLE * t.m + 0.3::DOUBLE * c.frame_continuity_score', 0.0, 1.0)}, 4) AS temporal_strength FROM ({runs(source, column, thr)}) c
    JOIN (SELECT seq_id, avg(v) AS m FROM (SELECT seq_id, {column} AS v, row_number() OVER (PARTITION BY seq_id ORDER BY {column} DESC) AS r FROM {source}) WHERE r <= 3 GROUP BY 1) t USING (seq_id)"""


cte(
    "vid0",
    f"""SELECT *, {threshold(0.85, 0.75, 0.92, 'off')} AS strong, {threshold(0.70, 0.60, 0.80, 'off')} AS possible FROM (
    SELECT video_id, campaign_id, count(*) AS frames, max(n_refs) AS n_refs, max(n_negs) AS n_negs, max(variance) AS variance, avg(penalty) AS pen, avg(mx) AS av,
    max(fused) AS fmax, avg(fused) AS fmean, stddev_pop(fused) AS fstd, bool_or(social) AS social, sum(CAST(round(off * 10000) AS BIGINT))::DOUBLE / count(*) / 10000 AS off, avg(round(aspect, 4)) AS aspect, bool_or(overlays) AS overlays, avg(round(level, 4)) AS level,
    {', '.join(f"bool_or(contains(reasoning, {lit(t)})) AS r{i}" for i, (_, _, t) in enumerate(media.OFFSET_RULES))},
    first(mx ORDER BY mx DESC, frame_idx) AS mx, first(best ORDER BY mx DESC, frame_idx) AS best, first(frame_name ORDER BY mx DESC, frame_idx) AS best_frame,
    first(label ORDER BY mx DESC, frame_idx) AS label, greatest(0.0::DOUBLE, first(comp ORDER BY comp DESC, frame_idx)) AS comp, first(rival ORDER BY comp DESC, frame_idx) AS rival
    FROM img0 GROUP BY 1, 2)""",
    "img0",
)
cte("vser", "SELECT video_id AS seq_id, frame_idx AS idx, fused AS score FROM img0", "img0")
cte("vsup", suppressed("vser"), "vser")
cte("vsmo0", smoothed("vsup", "sup", K5), "vsup")
cte("vsmo", "SELECT a.*, v.possible AS thr, v.strong FROM vsmo0 a JOIN vid0 v ON v.video_id = a.seq_id", "vsmo0", "vid0")
cte("vstr", strength("vsmo", "smo", "thr"), "vsmo")
cte(
    "vid1",
    f"""SELECT v.*, s.temporal_strength, s.longest_streak, {clamp('s.temporal_strength - v.pen', 0.0, 1.0)} AS primary_score,
    CASE WHEN v.n_negs > 0 THEN 1.0::DOUBLE - {clamp('(v.mx - v.comp) / 0.12', 0.0, 1.0)} ELSE 0.0::DOUBLE END AS amb FROM vid0 v JOIN vstr s ON s.seq_id = v.video_id""",
    "vid0", "vstr",
)
# every target and frame asked of its own campaign and its neighbour; the keys hold both
cte(
    "tgt_s",
    """SELECT t.* REPLACE (t.target_id * 1000000 + c.k AS target_id, t.video_id * 1000000 + c.k AS video_id, c.k AS campaign_id) FROM tgt t
    JOIN (SELECT campaign_id, unnest([campaign_id, CASE WHEN campaign_id % 2 = 0 THEN campaign_id + 1 ELSE campaign_id - 1 END]) AS k FROM (SELECT DISTINCT campaign_id FROM tgt)) c USING (campaign_id)""",
    "tgt",
)
cloned("_s", ("pair", "tstat", "dom", "ctop", "comp0", "ctx", "vser", "vsup", "vsmo0", "vsmo", "vstr"), {"tgt": "tgt_s", "comp": "comp_s", "img0": "img0_s", "vid0": "vid0_s"})
cloned("_s", ("comp", "img0", "vid0"), {"tgt": "tgt_s", **{n: f"{n}_s" for n in ("tstat", "dom", "ctop", "comp0", "ctx", "pair")}})
cte("vid2", decision("vid1", "mx", "comp", "social", "label"), "vid1")
_reasons = "list_filter([" + ", ".join(f"CASE WHEN r{i} THEN {lit(t)} END" for i, (_, _, t) in enumerate(media.OFFSET_RULES)) + "], lambda x: x IS NOT NULL)"
VIDEO_REASON = cond([(f"len({_reasons}) = 0", lit(media.DEFAULT_REASON))], f"array_to_string({_reasons}, ', ')")
_video_warnings = "list_filter([" + ", ".join(
    [
        f"CASE WHEN soc > 0 THEN {message(dg.SOCIAL_VIDEO, 'soc')} END", f"CASE WHEN prod > 0 THEN {message(dg.BRAND_VIDEO, 'prod')} END", *diag("mx", "comp", "amb"),
        f"CASE WHEN frames > 1 AND fmax > 0.80 AND temporal_strength < 0.65 THEN {message(dg.UNSTABLE, f3('fmax'), f3('temporal_strength'))} END",
        f"CASE WHEN frames > 1 AND fstd < 0.01 AND fmean > 0.60 AND fmean < 0.75 THEN {lit(dg.STATIC)} END",
    ]
) + "], lambda w: w IS NOT NULL)"

# --- frames, text, sources ---------------------------------------------------------------------------------------

cte(
    "videos",
    f"SELECT target_id AS video_id, target_id * 13 % 900 + 1 AS n, 24 + target_id % {d.CAMPAIGN_SIZE} % 7 AS fps FROM tgt WHERE ends_with(lower(filename), '.mp4')",
    "tgt",
)
cte(
    "sampled",
    "SELECT DISTINCT video_id, n, unnest(list_concat(generate_series(0::BIGINT, n - 1, CAST(fps * 2 AS BIGINT)), [n - 1])) AS frame_idx FROM videos",
    "videos",
)
cte(
    "even",
    f"""SELECT DISTINCT video_id, n, unnest(CASE WHEN n <= {fr.EVEN_FRAMES} THEN generate_series(0::BIGINT, n - 1) ELSE
    list_concat(list_transform(generate_series(0, 4), lambda i: CAST(floor((n - 1) / 5 * i) AS BIGINT)), [n - 1]) END) AS frame_idx FROM videos""",
    "videos",
)
cte(
    "blur",
    "SELECT video_id, n, frame_idx, ((video_id * 7 + frame_idx // 16 * 31) % 90)::DOUBLE AS b FROM (SELECT video_id, n, unnest(generate_series(0::BIGINT, n - 1)) AS frame_idx FROM videos)",
    "videos",
)
SPACE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def stripped(expr: str) -> str:
    return f"regexp_replace({expr}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def normalized(expr: str) -> str:
    inner = f"regexp_replace(regexp_replace({stripped(f'lower({expr})')}, '[أإآا]', 'ا', 'g'), '[\\x{{064B}}-\\x{{065F}}]', '', 'g')"
    return f"regexp_replace({inner}, '{SPACE}+', ' ', 'g')"


def values(items) -> str:
    return "(VALUES " + ", ".join(f"({i}, {lit(t)})" for i, t in enumerate(items)) + ")"


# DuckDB counts edits in bytes. Words are lower case, so mapping accented letters to capitals makes bytes characters.
ACCENTED, CAPITALS = "ßäçèéêíñóöü", "ABCDEFGHIJK"


def single_byte(expr: str) -> str:
    return f"translate({expr}, '{ACCENTED}', '{CAPITALS}')"


def close(words: str, term: str) -> str:
    near = f"levenshtein({single_byte('w')}, {single_byte(term)}) <= 2"
    return f"(length({term}) >= 3 AND len(list_filter({words}, lambda w: abs(length(w) - length({term})) <= 2 AND {near})) > 0)"


cte("docn", f"SELECT doc_id, nt, list_distinct(list_filter(string_split(nt, ' '), lambda w: w <> '')) AS ws FROM (SELECT doc_id, {normalized('text')} AS nt FROM documents)")
cte("convn", "SELECT conv_id AS item_id, string_agg(text, ' ' ORDER BY turn) AS txt, avg(((turn * 3 + conv_id) % 10) / 10) AS conf FROM conversations GROUP BY 1")
cte(
    "ocr",
    f"""SELECT item_id, txt, conf, bm, tm, CASE WHEN len(bm) > 0 THEN least(1.0::DOUBLE, 0.6 + conf * 0.4) WHEN len(tm) > 0 THEN least(0.7::DOUBLE, 0.3 + conf * 0.3) ELSE 0.0::DOUBLE END AS score,
    len(bm) + len(tm) > 0 AS fired FROM (SELECT *, list_filter([{', '.join(lit(t) for t in d.BRAND_TERMS)}], lambda t: contains(nt, t) OR {close('ws', 't')}) AS bm,
    list_filter([{', '.join(lit(t.lstrip('#')) for t in d.HASHTAGS)}], lambda t: contains(nt, t)) AS tm
    FROM (SELECT *, string_split(nt, ' ') AS ws FROM (SELECT *, {normalized('txt')} AS nt FROM convn)))""",
    "convn",
)

cte(
    "mnorm",
    f"""SELECT term, pos, {normalized('term')} AS n FROM (SELECT term, min(item_id * 1000 + i) AS pos FROM (
        SELECT item_id, unnest(ts) AS term, unnest(range(0, len(ts))) AS i FROM (
            SELECT item_id, list_concat(list_filter(p, lambda w: length(w) >= 5), [concat_ws(' ', p[1], p[2])]) AS ts
            FROM (SELECT item_id, string_split(regexp_replace(text, '[^\\p{{L}}]+', ' ', 'g'), ' ') AS p FROM benchmark))) WHERE trim(term) <> '' GROUP BY term)""",
)


def term_hits(words: str) -> str:
    """Words near or around a term; ``words`` selects the distinct words ``w``."""
    near = f"abs(length(w) - length(n)) <= 2 AND levenshtein({single_byte('w')}, {single_byte('n')}) <= 2"
    return f"SELECT w, term, pos, contains(w, n) AS exact FROM ({words}), mnorm WHERE contains(w, n) OR (length(n) >= 3 AND {near})"


cte("mnear", term_hits("SELECT DISTINCT unnest(ws) AS w FROM docn"), "docn", "mnorm")
cte("convw", f"SELECT item_id, conf, nt, list_distinct(list_filter(string_split(nt, ' '), lambda w: w <> '')) AS ws FROM (SELECT *, {normalized('txt')} AS nt FROM convn)", "convn")
cte("cnear", term_hits("SELECT DISTINCT unnest(ws) AS w FROM convw"), "convw", "mnorm")
cte(
    "chits",
    """SELECT DISTINCT item_id, term, pos FROM (SELECT item_id, term, pos FROM (SELECT item_id, unnest(ws) AS w FROM convw) JOIN cnear USING (w)
    UNION ALL SELECT item_id, term, pos FROM convw, mnorm WHERE contains(n, ' ') AND contains(nt, n))""",
    "convw", "cnear", "mnorm",
)
cte(
    "ocrt",
    f"""SELECT item_id, conf, coalesce(bm, []) AS bm, list_filter([{', '.join(lit(t.lstrip('#')) for t in d.HASHTAGS)}], lambda t: contains(nt, t)) AS tm
    FROM convw LEFT JOIN (SELECT item_id, list(term ORDER BY pos) AS bm FROM chits GROUP BY 1) USING (item_id)""",
    "convw", "chits",
)


def quoted(terms: str) -> str:
    return f"('[' || array_to_string(list_transform({terms}, lambda t: chr(39) || t || chr(39)), ', ') || ']')"


_caption_terms = list(dict.fromkeys(t.lower() for t in [*d.BRAND_TERMS, *d.KEYWORDS]))
cte(
    "cap",
    f"""SELECT item_id, c, mt, CASE WHEN len(mt) > 0 THEN least(1.0::DOUBLE, len(mt) * 0.5) WHEN scene THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS score, len(mt) > 0 AS fired
    FROM (SELECT doc_id AS item_id, c, list_filter([{', '.join(lit(t) for t in _caption_terms)}], lambda t: contains(c, t)) AS mt,
    len(list_intersect(string_split(regexp_replace(c, '{SPACE}+', ' ', 'g'), ' '), [{', '.join(lit(w) for w in mn.SCENE_WORDS)}])) > 0 AS scene
    FROM (SELECT doc_id, {stripped('lower(text)')} AS c FROM documents))""",
)
cte(
    "brandn",
    """SELECT brand_id, i, name FROM (SELECT brand_id, min(i) AS i, name FROM (SELECT brand_id, unnest([1, 2, 3]) AS i, trim(unnest(names)) AS name FROM (
    SELECT p_partkey AS brand_id, [p_brand, p_name, CASE p_partkey % 3 WHEN 0 THEN ' ' || p_brand || ' ' WHEN 1 THEN 'é' || p_name ELSE '' END] AS names FROM part))
    WHERE name <> '' GROUP BY brand_id, name)""",
)
cte(
    "box",
    f"""SELECT *, round(conf, 3) AS conf3, CASE WHEN gen OR conf < 0.35 THEN 'generic' ELSE 'brand' END AS kind, CASE WHEN gen OR conf >= 0.35 THEN cls ELSE cls || ' (low-conf)' END AS label
    FROM (SELECT *, cls IN ('brand logo', 'store sign') AS gen FROM (SELECT user_id AS item_id, event_id, CASE event_type WHEN 'view' THEN 'brand logo' WHEN 'click' THEN 'store sign' ELSE event_type END AS cls,
    value / (value + 200) AS conf FROM events)) WHERE gen OR conf >= 0.15""",
)
cte(
    "detl",
    """SELECT item_id, CASE WHEN nb > 0 THEN least(1.0::DOUBLE, b * 2) WHEN ng > 0 THEN least(0.3::DOUBLE, g * 0.5) ELSE 0.0::DOUBLE END AS score, coalesce(nb > 0, false) AS fired,
    CASE WHEN nb > 0 THEN 'Brand detected with high confidence: ' || lb || CASE WHEN nb > 300 THEN printf(' and %d more', nb - 300) ELSE '' END
        WHEN ng > 0 THEN 'Only generic or low-confidence objects: ' || lg || CASE WHEN ng > 300 THEN printf(' and %d more', ng - 300) ELSE '' END
        ELSE 'No relevant objects detected.' END AS evidence
    FROM (SELECT DISTINCT user_id AS item_id FROM events) LEFT JOIN (SELECT item_id,
    max(conf) FILTER (WHERE kind = 'brand') AS b, max(conf3) FILTER (WHERE kind = 'generic') AS g, count(*) FILTER (WHERE kind = 'brand') AS nb, count(*) FILTER (WHERE kind = 'generic') AS ng,
    '[' || string_agg(t, ', ' ORDER BY event_id) FILTER (WHERE kind = 'brand' AND k <= 300) || ']' AS lb, '[' || string_agg(t, ', ' ORDER BY event_id) FILTER (WHERE kind = 'generic' AND k <= 300) || ']' AS lg
    FROM (SELECT *, '(''' || label || ''', ' || CAST(conf3 AS VARCHAR) || ')' AS t, row_number() OVER (PARTITION BY item_id, kind ORDER BY event_id) AS k FROM box) GROUP BY 1) USING (item_id)""",
    "box",
)
_rgb = [ev.hex_to_rgb(h) for h in d.PALETTE]
cte(
    "colr",
    f"""SELECT item_id, dist, greatest(0.0::DOUBLE, 1 - dist / 220) AS score FROM (SELECT item_id, min(least({', '.join(f"sqrt((r - {a})::DOUBLE ** 2 + (g - {b})::DOUBLE ** 2 + (b - {c})::DOUBLE ** 2)" for a, b, c in _rgb)})) AS dist
    FROM (SELECT p_partkey AS item_id, (CAST(floor(p_retailprice * 10) AS BIGINT) * k) % 256 AS r, (p_size * 5 * k) % 256 AS g, (p_partkey * 37 + k * 11) % 256 AS b FROM part, (VALUES (1), (2), (3)) t(k)) GROUP BY 1)""",
)
cte(
    "evi",
    """SELECT item_id, layer, score, score > 0.75 AS fired, CASE layer WHEN 'image' THEN 4.0::DOUBLE WHEN 'prompt' THEN 0.8::DOUBLE WHEN 'color' THEN 0.3::DOUBLE ELSE 0.7::DOUBLE END AS weight
    FROM (SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS item_id, CASE event_type WHEN 'view' THEN 'image' WHEN 'click' THEN 'prompt' WHEN 'purchase' THEN 'caption' WHEN 'signup' THEN 'detection'
    ELSE CASE WHEN event_id % 3 = 0 THEN 'color' ELSE 'ocr' END END AS layer, max(value / (value + 20)) AS score FROM events GROUP BY 1, 2)""",
)


def fusion(source: str, defaults: dict[str, float], items: str | None = None) -> str:
    base = items or f"(SELECT DISTINCT item_id FROM {source})"
    wide = ", ".join(
        f"coalesce(max(score) FILTER (WHERE layer = '{n}'), 0.0::DOUBLE) AS {n}_s, coalesce(bool_or(fired) FILTER (WHERE layer = '{n}'), false) AS {n}_f, "
        f"coalesce(max(weight) FILTER (WHERE layer = '{n}'), {w}::DOUBLE) AS {n}_w" for n, w in defaults.items()
    )
    eff = {n: f"CASE WHEN {n}_w > 0 THEN {n}_w * CASE WHEN {n}_f THEN 1.5::DOUBLE ELSE 1 END ELSE 0 END" for n in defaults}
    top = " + ".join(f"{n}_s * ({e})" for n, e in eff.items())
    low = " + ".join(f"({e})" for e in eff.values())
    count = " + ".join(f"CASE WHEN {n}_w > 0 AND {n}_f THEN 1 ELSE 0 END" for n in defaults)
    best = ", ".join(f"CASE WHEN {n}_w > 0 AND {n}_f THEN {n}_s ELSE 0 END" for n in ev.RELIABLE)
    return f"""SELECT *, CASE WHEN fired_count >= 3 THEN least(1.0::DOUBLE, base + 0.10::DOUBLE) WHEN fired_count >= 2 THEN least(1.0::DOUBLE, base + 0.05::DOUBLE) ELSE base END AS es
    FROM (SELECT *, ({count})::BIGINT AS fired_count, greatest(CASE WHEN {low} > 0 THEN ({top}) / ({low}) ELSE 0 END, greatest(0.0::DOUBLE, {best}) * 0.85::DOUBLE) AS base
    FROM (SELECT item_id, {wide} FROM {base} LEFT JOIN {source} USING (item_id) GROUP BY 1))"""


def verdicts(source: str) -> str:
    visual, support = "(image_f::INT + detection_f::INT)", "(caption_f::INT + color_f::INT)"
    floor = cond(
        [("ocr_f", "0.90::DOUBLE"), ("image_f AND image_s >= 0.85", "0.75::DOUBLE"), (f"{visual} >= 2 OR ({visual} >= 1 AND {support} >= 1)", "0.65::DOUBLE"),
         (f"{visual} = 1 OR {support} >= 2", "0.50::DOUBLE")], "es",
    )
    flags = ", ".join(f"CASE WHEN {n}_f THEN 'True' ELSE 'False' END" for n in ("image", "prompt", "caption", "detection", "ocr"))
    return f"""SELECT item_id, verdict, round(c * 100, 1) AS confidence, round(es, 4) AS confidence_raw,
    printf('%s (Score: %.2f, ClipImg: %s, ClipTxt: %s, Caption: %s, YOLO: %s, OCR: %s)', verdict, round(es, 4), {flags}) AS label
    FROM (SELECT *, CASE WHEN ocr_f OR c >= 0.70 THEN 'Relevant' WHEN c >= 0.45 THEN 'Uncertain' ELSE 'Irrelevant' END AS verdict
    FROM (SELECT *, least(1.0::DOUBLE, greatest(es, {floor})) AS c FROM {source}))"""


cte("fus", fusion("evi", ev.LAYERS), "evi")
cte(
    "prm",
    f"""SELECT item_id, 'prompt' AS layer, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (b - 0.21) / 0.07)) AS score, b >= 0.23 AND b > ng + 0.01 AS fired,
        printf('Best brand sim: %.3f (''prompt %d''), best neg: %.3f, diff: %.3f', b, bi, ng, b - ng) AS evidence, 0.8::DOUBLE AS weight FROM (
        SELECT item_id, max(s) FILTER (WHERE i % 8 <> 7) AS b, first(i ORDER BY s DESC, i) FILTER (WHERE i % 8 <> 7) AS bi, max(s) FILTER (WHERE i % 8 = 7) AS ng
        FROM (SELECT target_id AS item_id, unnest(generate_series(0, 63)) AS i, 0.2::DOUBLE + unnest(e) * 0.2::DOUBLE AS s FROM tgt) GROUP BY 1)""",
    "tgt",
)
cte(
    "lay",
    """SELECT item_id, 'caption' AS layer, score, fired, 0.7::DOUBLE AS weight FROM cap UNION ALL SELECT item_id, 'ocr', score, fired, 0.7::DOUBLE FROM ocr
    UNION ALL SELECT item_id, 'detection', score, fired, 0.7::DOUBLE FROM detl UNION ALL SELECT item_id, 'color', score, score > 0.70, 0.3::DOUBLE FROM colr
    UNION ALL SELECT target_id, 'image', mx * 0.7 + av * 0.3, mx * 0.7 + av * 0.3 > 0.75, 4.0::DOUBLE FROM tstat UNION ALL SELECT item_id, layer, score, fired, weight FROM prm""",
    "cap", "ocr", "detl", "colr", "tstat", "prm",
)
cte("docs", "SELECT doc_id AS item_id FROM documents")
cte("dfus", fusion("lay", {**{n: 0.0 for n in ev.LAYERS}, "caption": 0.7, "detection": 0.7, "ocr": 0.7, "color": 0.3, "prompt": 0.8}, "docs"), "lay", "docs")
cte(
    "lst",
    f"""SELECT '/media/c' || campaign_id || '/' || CASE role WHEN 'reference' THEN {pick(['positive_refs/', 'positives/', 'refs/', 'references/deep/', ''], 'p % 5')}
    WHEN 'competitor' THEN {pick(['hard_negatives/', 'negatives/'], 'p % 2')} ELSE CASE vec_id % 4 WHEN 0 THEN 'references/' WHEN 1 THEN 'negatives/' ELSE 'raw/' END END ||
    CASE WHEN vec_id % 10 = 3 THEN 'F_' || (vec_id - 1) ELSE 'f_' || vec_id END || '.' || {pick(['jpg', 'PNG', 'mp4', 'txt', 'webp', 'gif'], 'vec_id % 6')} AS path,
    vec_id * 977 % 100000 + 1 AS length, vec_id * 1000 AS modified FROM vec""",
    "vec",
)
EXT = r"(?:^|/)\.*[^./][^/]*\.([^./]*)$"


def extension(path: str) -> str:
    return f"lower(regexp_extract({path}, '{EXT}', 1))"


def any_of(items) -> str:
    return "(" + ", ".join(lit(i) for i in items) + ")"


def media_type(path: str) -> str:
    return cond([(f"{extension(path)} IN {any_of(paths.IMAGE_EXTS)}", "'image'"), (f"{extension(path)} IN {any_of(paths.VIDEO_EXTS)}", "'video'")], "'unsupported'")


def preference(names) -> str:
    return cond([(f"folder = {lit(n)}", str(i)) for i, n in enumerate(names)], "NULL")


cte(
    "roles",
    f"""SELECT campaign, path, length, modified, unnest(list_filter([CASE WHEN pos IS NULL OR fp = pos THEN 'positive' END, CASE WHEN fn = ng THEN 'negative' END], lambda x: x IS NOT NULL)) AS role
    FROM (SELECT *, min(fp) OVER (PARTITION BY campaign) AS pos, min(fn) OVER (PARTITION BY campaign) AS ng FROM (SELECT *, {preference(listings.POSITIVE_DIRS)} AS fp, {preference(listings.NEGATIVE_DIRS)} AS fn
    FROM (SELECT *, string_split(path, '/')[3] AS campaign, CASE WHEN len(string_split(path, '/')) > 4 THEN string_split(path, '/')[4] ELSE '' END AS folder FROM lst)))""",
    "lst",
)
cte(
    "mu",
    f"""SELECT page_id, regexp_replace(url, '[?#].*$', '') || {pick(['.jpg', '.MP4', '', '.pdf', '.webm;v=1', '/.png'], 'page_id % 6')} || {pick(['', '?x=1.jpg', '#a.png'], 'page_id % 3')} AS url FROM pages""",
)
_path = r"regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', '')"
cte(
    "mux",
    f"SELECT *, 'direct_' || md5(url) || '.' || CASE WHEN ext = '' THEN 'bin' ELSE ext END AS manifest FROM (SELECT *, CASE WHEN x IN {any_of(paths.SUPPORTED_EXTS)} THEN x ELSE '' END AS ext "
    f"FROM (SELECT *, {extension(_path)} AS x FROM mu))",
    "mu",
)
cte("ltgt", f"SELECT path FROM lst WHERE contains(path, '.') AND lower(regexp_extract(path, '[^.]*$')) IN {any_of(paths.SUPPORTED_EXTS)}", "lst")
cte(
    "run",
    """SELECT campaign_id, count(*) AS num_targets, count(*) FILTER (WHERE campaign_match) AS matches, count(*) FILTER (WHERE match_type = 'STRONG_MATCH') AS strong_matches,
    count(*) FILTER (WHERE match_type IN ('PROBABLE_STRONG_MATCH', 'POSSIBLE_MATCH')) AS possible_matches, count(*) FILTER (WHERE match_type = 'NO_MATCH') AS rejections FROM img GROUP BY 1""",
    "img",
)
cte(
    "camp",
    f"""SELECT campaign_id, filename AS file, campaign_match, match_type, verdict, round(conf, 4) AS confidence, best AS best_reference, 1::BIGINT AS num_frames_analyzed, soc AS social_adjustment,
    '' AS source_url, '' AS error, true AS has, social, aspect, overlays, subs, mobile, level, reasoning FROM img WHERE {media_type('filename')} <> 'video'
    UNION ALL SELECT campaign_id, 'clip_' || video_id || '.mp4', campaign_match, match_type, verdict, round(conf, 4), best, frames, soc, '', '', true, social, aspect, overlays, false, false, level, {VIDEO_REASON} FROM vid2
    UNION ALL SELECT campaign_id, filename, false, 'NO_MATCH', 'Irrelevant', 0.0, '', 0, 0.0, '', '', false, false, NULL, false, false, false, NULL, NULL FROM img WHERE {media_type('filename')} = 'video'
    UNION ALL SELECT length(url) % 10, '', false, 'NO_MATCH', 'Irrelevant', 0.0, '', 0, 0.0, url, CASE WHEN length(url) % 7 = 0 THEN 'no fetch outcome' ELSE 'yt-dlp not available' END, false, false, NULL, false, false, false, NULL, NULL
    FROM mux WHERE ext = '' OR length(url) % 7 = 0""",
    "img", "vid2", "mux",
)
cte(
    "pred",
    f"""SELECT target_id, expected_match, score, score >= possible AS is_match, CASE WHEN score >= strong THEN 'STRONG_MATCH' WHEN score >= possible THEN 'POSSIBLE_MATCH' ELSE 'NO_MATCH' END AS match_type
    FROM (SELECT *, greatest(0.0::DOUBLE, mx * 0.4::DOUBLE + top5 * 0.35::DOUBLE + gsim * 0.25::DOUBLE - penalty) AS score,
    {threshold(0.85, 0.75, 0.92, '0.0::DOUBLE')} AS strong, {threshold(0.70, 0.60, 0.80, '0.0::DOUBLE')} AS possible FROM img0)""",
    "img0",
)
cte(
    "conf",
    """SELECT count(*) FILTER (WHERE expected_match AND is_match) AS tp, count(*) FILTER (WHERE expected_match AND NOT is_match) AS fn,
    count(*) FILTER (WHERE NOT expected_match AND is_match) AS fp, count(*) FILTER (WHERE NOT expected_match AND NOT is_match) AS tn FROM pred""",
    "pred",
)


def share(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN {part}::DOUBLE / ({whole}) ELSE 0.0::DOUBLE END"


def platform(name: str, why: str) -> str:
    n, w = f"lower({name})", f"lower({why})"
    return cond(
        [(f"contains({n}, 'tiktok') OR contains({w}, 'tiktok')", "'tiktok'"), (f"contains({n}, 'instagram') OR contains({w}, 'reels') OR contains({w}, 'instagram')", "'instagram'"),
         (f"contains({n}, 'facebook') OR contains({n}, 'fb')", "'facebook'"), (f"contains({n}, 'youtube') OR contains({w}, 'shorts')", "'youtube_shorts'"), ("social", "'generic_social'")],
        "'standard_web_or_print'",
    )


def pictures(column: str) -> str:
    scene = "((video_id * 5 + frame_idx) // 150 % 4)"
    hist = f"list_transform(generate_series(0, 63), lambda i: ((i * ({scene} + 3) + video_id) % 17)::DOUBLE)"
    thumb = f"list_transform(generate_series(0, 1023), lambda i: ((i * ({scene} + 1) * 7 + frame_idx % 5 + video_id) % 256)::DOUBLE)"
    return hist if column == "hist" else thumb


cte("pic", f"SELECT video_id, frame_idx, {pictures('hist')} AS hist, {pictures('thumb')} AS thumb FROM even", "even")
cte("pic_all", f"SELECT video_id, frame_idx, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS rn, {pictures('hist')} AS hist, {pictures('thumb')} AS thumb FROM sampled", "sampled")


def same_structure(kept: str) -> str:
    """Whether the kept frame at a place of the list, if there is one, looks like the next frame."""
    gap = "list_sum(list_transform(list_zip(k.thumb, n.thumb), lambda t: abs(t[1] - t[2]))) / 1024 / 255.0"
    return f"coalesce((SELECT {gap} < 0.05 FROM pic_all k WHERE k.video_id = s.video_id AND k.rn = {kept}), false)"


_r = "((list_dot_product(l.hist, n.hist) - 64 * list_avg(l.hist) * list_avg(n.hist)) / sqrt((list_dot_product(l.hist, l.hist) - 64 * list_avg(l.hist) ** 2) * (list_dot_product(n.hist, n.hist) - 64 * list_avg(n.hist) ** 2)))"
cte(
    "dedup",
    f"""WITH RECURSIVE walk AS (SELECT video_id, 1::BIGINT AS rn, [1::BIGINT] AS kept FROM pic_all WHERE rn = 1 UNION ALL
    SELECT s.video_id, n.rn, CASE WHEN len(s.kept) < 15 AND NOT {_r} > 0.98 AND NOT {same_structure('s.kept[-1]')} AND NOT {same_structure('s.kept[-2]')} AND NOT {same_structure('s.kept[-3]')}
    THEN list_append(s.kept, n.rn) ELSE s.kept END FROM walk s JOIN pic_all n ON n.video_id = s.video_id AND n.rn = s.rn + 1 JOIN pic_all l ON l.video_id = s.video_id AND l.rn = s.kept[-1])
    SELECT p.video_id, p.frame_idx, k.i - 1 AS kept_order FROM (SELECT video_id, unnest(generate_series(1, len(kept))) AS i, unnest(kept) AS rn FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY rn DESC) = 1)) k JOIN pic_all p USING (video_id, rn)""",
    "pic_all",
)
cte(
    "blurred",
    """SELECT video_id, frame_idx, coalesce(u, frame_idx) AS use_idx, u IS NOT NULL AS replaced FROM (SELECT s.video_id, s.frame_idx, b.b, s.frame_idx <> 0 AND s.frame_idx <> s.n - 1 AND b.b < 40 AS blurry,
        CASE WHEN s.frame_idx <> 0 AND s.frame_idx <> s.n - 1 AND b.b < 40 THEN (SELECT first(x.frame_idx ORDER BY CASE x.frame_idx - s.frame_idx WHEN -5 THEN 1 WHEN -2 THEN 2 WHEN 2 THEN 3 ELSE 4 END) FROM blur x
        WHERE x.video_id = s.video_id AND x.b >= 40 AND x.frame_idx - s.frame_idx IN (-5, -2, 2, 5)) END AS u FROM sampled s JOIN blur b USING (video_id, frame_idx)) WHERE NOT (blurry AND u IS NULL AND b < 20)""",
    "sampled", "blur",
)
cte("used", "SELECT DISTINCT video_id, use_idx AS frame_idx FROM blurred", "blurred")
cloned("_k", ("pic_all", "dedup"), {"sampled": "used"})
cte(
    "tgt_k",
    f"""SELECT t.* EXCLUDE (fw, theme, ve) REPLACE (t.video_id * 1000 + t.frame_idx AS target_id, {unit('fw')} AS e) FROM (
    SELECT t.* REPLACE (k.video_id AS video_id, k.frame_idx AS frame_idx, 'frame_' || k.video_id || '_' || k.frame_idx || '.jpg' AS frame_name), v.theme, v.e AS ve,
    {mixed('v.theme', pick([0.2, 0.9, 0.6, 2.0, 1.2], 'k.frame_idx // 100 % 5'), 'v.e')} AS fw FROM dedup_k k JOIN tgt t ON t.target_id = k.video_id JOIN vec v ON v.vec_id = k.video_id) t""",
    "dedup_k", "tgt", "vec",
)
cte("vser_k", "SELECT video_id AS seq_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS idx, fused AS score FROM img0_k", "img0_k")
_chain = ("pair", "tstat", "dom", "ctop", "comp0", "ctx", "vsup", "vsmo0", "vsmo", "vstr")
cloned("_k", _chain, {"tgt": "tgt_k", "comp": "comp_k", "img0": "img0_k", "vid0": "vid0_k", "vser": "vser_k"})
cloned("_k", ("comp", "img0", "vid0"), {"tgt": "tgt_k", **{n: f"{n}_k" for n in ("tstat", "dom", "ctop", "comp0", "ctx", "pair")}})
cloned("_k", ("vid1",), {"vid0": "vid0_k", "vstr": "vstr_k", "comp": "comp_k"})
cte("vid2_k", decision("vid1_k", "mx", "comp_k", "social", "label"), "vid1_k")
_moment = "avg({0}) OVER (PARTITION BY seq_id)"
_cluster_cols = f"campaign_id, j::BIGINT AS cluster_idx, n_members, label, {rnd('std')} AS variance, {rnd('mean')} AS avg_similarity"
_band = cond([("mean > 0.88", lit(clusters.COHESION_LABELS[0])), ("mean > 0.78", lit(clusters.COHESION_LABELS[1]))], lit(clusters.COHESION_LABELS[2]))
_edges = rp.HISTOGRAM_EDGES
_bins = ", ".join(
    f"count(*) FILTER (WHERE score >= {lo} AND score {'<=' if i == 4 else '<'} {hi}) AS bin_{i}" for i, (lo, hi) in enumerate(zip(_edges, _edges[1:]))
)
_cohesion_text = f"""array_to_string(list_filter([CASE grade WHEN 'EXCELLENT' THEN {lit(banks.EXCELLENT_TEXT)} WHEN 'GOOD' THEN {lit(banks.GOOD_TEXT)} ELSE {lit(banks.WEAK_TEXT)} END,
    CASE WHEN grade = 'GOOD' AND n_out > 0 THEN printf({lit(banks.GOOD_OUTLIER_TEXT)}, names[1]) WHEN grade = 'WEAK' AND n_out > 0 THEN printf({lit(banks.WEAK_OUTLIER_TEXT)}, array_to_string(names, ', ')) END,
    CASE WHEN grade = 'WEAK' AND n_refs < 3 THEN {lit(banks.FEW_TEXT)} END], lambda x: x IS NOT NULL), '|')"""

# --- queries -----------------------------------------------------------------------------------------------------

cte(
    "framev",
    f"""SELECT *, CAST(string_split(item_id, '-')[1] AS BIGINT) AS seq_id, date_diff('day', DATE '2024-01-01', CAST(regexp_replace(item_id, '^[0-9]+-', '') AS DATE)) AS idx FROM ({verdicts('fus')})""",
    "fus",
)
cte(
    "framebest",
    """SELECT seq_id, count(*) AS n_scanned, first(idx ORDER BY confidence DESC, idx) AS idx FROM (
    SELECT *, coalesce(max(CASE WHEN verdict = 'Relevant' AND confidence >= 85 THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
    FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY idx) AS k FROM framev) WHERE k <= 6) WHERE s = 0 GROUP BY 1""",
    "framev",
)

ORACLE = {
    "l2_normalize": f"""SELECT vec_id, unnest(generate_series(0, len(u) - 1)) AS pos, {rnd('unnest(u)')} AS value FROM (SELECT vec_id, {unit('w')} AS u FROM
        (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (vec_id % 7 + 1)) AS w FROM embeddings))""",
    "pair_similarity": sql(f"SELECT target_id, campaign_id, ref_id, ref_name, {rnd('sim')} AS similarity FROM pair", "pair"),
    "top_matches": sql(
        "SELECT target_id, r AS rank, ref_name AS reference_name, round(sim, 4) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY sim DESC, ref_id) AS r FROM pair) WHERE r <= 5",
        "pair",
    ),
    "target_stats": sql(f"SELECT target_id, n_refs, {rnd('mx')} AS max_similarity, {rnd('av')} AS avg_similarity, {rnd('top5')} AS top_k_avg, best AS best_reference FROM tstat", "tstat"),
    "bank_centroid": sql(
        f"SELECT campaign_id, n_refs, unnest(generate_series(0, len(c) - 1)) AS pos, {rnd('unnest(c)')} AS value FROM cen JOIN (SELECT campaign_id, count(*) AS n_refs FROM bank GROUP BY 1) USING (campaign_id)", "cen", "bank"
    ),
    "bank_variance": sql(f"SELECT campaign_id, n_refs, {rnd('variance')} AS variance FROM bvar", "bvar"),
    "intra_similarity": sql(f"SELECT campaign_id, n_refs, {rnd('mean')} AS intra_similarity_mean, {rnd('std')} AS intra_similarity_std FROM intra", "intra"),
    "outliers": sql(f"SELECT campaign_id, ref_id, ref_name, {rnd('sim')} AS similarity FROM csim WHERE sim < {banks.OUTLIER_BELOW}", "csim"),
    "silhouette": sql(f"SELECT campaign_id, n_refs, n_negs, {rnd('s')} AS silhouette_score FROM sil", "sil"),
    "cohesion": sql(
        f"""SELECT campaign_id, grade AS cluster_quality, round(mean, 4) AS intra_similarity_mean, round(std, 4) AS intra_similarity_std, {rnd('s', 4)} AS silhouette_score,
        array_to_string(names, '|') AS outliers, {_cohesion_text} AS recommendations FROM coh""",
        "coh",
    ),
    "farthest_first": sql("SELECT campaign_id, j::BIGINT AS cluster_idx, ref_id FROM k4s4", "k4s4"),
    "cluster_members": sql("SELECT campaign_id, ref_id, j::BIGINT AS cluster_idx FROM k4a25", "k4a25"),
    "cluster_members_rounds": sql("SELECT campaign_id, ref_id, j::BIGINT AS cluster_idx FROM k4a25", "k4a25"),
    "reference_clusters": sql(f"SELECT {_cluster_cols} FROM clu", "clu"),
    "cohesion_clusters": sql(
        f"SELECT {_cluster_cols} FROM (SELECT *, CASE WHEN sum(n_members) OVER (PARTITION BY campaign_id) = 1 THEN {_band} ELSE printf('%s (Cluster %d)', {_band}, j + 1) END AS label FROM k3stat)", "k3stat"
    ),
    "dominant_cluster": sql(
        f"""SELECT target_id, label AS dominant_cluster, j::BIGINT AS cluster_idx, {rnd('cs', 4)} AS cluster_similarity, CASE WHEN s >= 0.80 THEN 'HIGH' WHEN s >= 0.70 THEN 'MEDIUM' ELSE 'LOW' END AS cluster_confidence,
        {rnd('gsim')} AS centroid_similarity, label AS best_cluster_label, {rnd('s')} AS best_cluster_centroid_sim FROM img0""",
        "img0",
    ),
    "cluster_topk": sql(f"SELECT target_id, {rnd('ct')} AS cluster_top_k_avg, {rnd('fused')} AS fused_score FROM img0", "img0"),
    "competitor_eval": sql(
        f"""SELECT target_id, n_negs, {rnd('comp', 4)} AS competitor_similarity, amb AS ambiguity_score, penalty, CASE WHEN ambiguous THEN 'AMBIGUOUS' ELSE 'CLEAR' END AS ambiguity_status, rival AS best_competitor,
        CASE WHEN ambiguous THEN {message(RIVAL_TEXT, 'rival', 'rawb', 'mx', 'mx - rawb', 'rawpen')} ELSE '' END AS competitor_warning FROM img0""",
        "img0",
    ),
    "thresholds": sql(f"SELECT target_id, {rnd('strong')} AS strong_threshold, {rnd('possible')} AS possible_threshold FROM img1", "img1"),
    "calibrate": f"""SELECT event_id, {rnd(calibrated('score', 'strong', 'possible'))} AS confidence FROM (SELECT event_id, value / (value + 20) AS score,
        0.75::DOUBLE + (user_id % 4) * 0.05::DOUBLE AS strong, 0.60::DOUBLE + (user_id % 5) * 0.05::DOUBLE AS possible FROM events)""",
    "boosts": sql(f"SELECT target_id, soc AS social_adjustment, prod AS product_boost, {rnd('cal')} AS calibrated, {rnd('conf')} AS confidence_raw FROM img2", "img2"),
    "verdict": f"""SELECT event_id, {cond([(f"c >= {b}", lit(t)) for b, t, _, _ in scoring.VERDICT_BANDS], "'NO_MATCH'")} AS match_type, c >= 0.65 AS campaign_match,
        {cond([(f"c >= {b}", lit(v)) for b, _, _, v in scoring.VERDICT_BANDS], "'Irrelevant'")} AS verdict, round(c * 100, 1) AS confidence_pct, {rnd('c - 0.85::DOUBLE')} AS decision_margin, c >= 0.7 AS matched
        FROM (SELECT event_id, value / (value + 20) AS c FROM events)""",
    "match_images": sql(
        f"""SELECT target_id, campaign_id, campaign_match, round(conf, 4) AS confidence, match_type, round(mx, 4) AS top_similarity, {rnd('av', 4)} AS average_similarity, best AS best_reference, filename AS best_frame,
        n_refs AS num_references, 1::BIGINT AS num_frames_analyzed, round(variance, 4) AS reference_variance, round(strong, 4) AS threshold_used, {rnd('comp', 4)} AS competitor_similarity, amb AS ambiguity_score, verdict,
        round(conf * 100, 1) AS confidence_pct, label AS dominant_cluster, {rnd('cs', 4)} AS cluster_similarity, soc AS social_adjustment, prod AS product_boost, grade AS cluster_quality, reasoning,
        {rnd('fused', 4)} AS raw_score FROM img JOIN (SELECT campaign_id, grade FROM coh) USING (campaign_id)""",
        "img", "coh",
    ),
    "diagnostics": sql("SELECT target_id, unnest(generate_series(0, len(warnings) - 1)) AS pos, unnest(warnings) AS warning FROM img WHERE len(warnings) > 0", "img"),
    "explain": sql(
        f"""SELECT target_id, ambiguity_reason, unnest(generate_series(0, len(st) - 1)) AS pos, unnest(st) AS step FROM (SELECT target_id, CASE WHEN len(warnings) > 0 THEN warnings[1] ELSE {lit(dg.CLEAR_REASON)} END AS ambiguity_reason,
        list_filter([{', '.join(_steps)}], lambda x: x IS NOT NULL) AS st FROM img)""",
        "img",
    ),
    "failure_cases": sql(
        f"""SELECT * FROM (SELECT filename, regexp_replace(filename, '[^\\p{{L}}\\p{{N}}]', '_', 'g') AS clean_name, round(primary_score, 4) AS similarity_score, {rnd('comp', 4)} AS competitor_similarity, amb AS ambiguity_score, verdict,
        round(possible, 4) AS threshold_used, abs(primary_score - possible) <= 0.05 AS is_near_miss, comp >= 0.65 AND amb >= 0.40 AS is_ambiguous, len(warnings) AS n_warnings FROM img)
        WHERE is_near_miss OR is_ambiguous OR n_warnings > 0""",
        "img",
    ),
    "failure_archive": sql(
        """SELECT verdict, 2 * count(*) AS n, 2 * count(*) FILTER (WHERE near) AS near_misses, 2 * count(*) FILTER (WHERE amb_) AS ambiguous, count(DISTINCT filename) AS files, round(max(round(primary_score, 4)), 4) AS most_similar
        FROM (SELECT *, abs(primary_score - possible) <= 0.05 AS near, comp >= 0.65 AND amb >= 0.40 AS amb_ FROM img) WHERE near OR amb_ OR len(warnings) > 0 GROUP BY 1""",
        "img",
    ),
    "spike_suppression": sql(f"SELECT seq_id, idx, {rnd('sup')} AS suppressed FROM sup", "sup"),
    "kernel_smoothing": sql(
        f"SELECT seq_id, idx, {rnd('smo5')} AS smoothed5, {rnd('smo')} AS smoothed7 FROM ({smoothed('(SELECT * RENAME (smo AS smo5) FROM (' + smoothed('sup', 'score', K5) + '))', 'score', K7)})", "sup"
    ),
    "continuity": sql(runs("scores", "score", "0.55"), "scores"),
    "stable_segments": sql(segments("smo", "smo", "0.55"), "smo"),
    "temporal_strength": sql(strength("smo", "smo", "0.55"), "smo"),
    "best_until_confident": sql(
        """SELECT seq_id, count(*) AS n_scanned, first(idx ORDER BY c DESC, idx) AS idx, first(v ORDER BY c DESC, idx) AS verdict, first(c ORDER BY c DESC, idx) AS confidence FROM (
        SELECT *, coalesce(max(CASE WHEN v = 'Relevant' AND c >= 85 THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen
        FROM (SELECT seq_id, idx, round(score * 100, 1) AS c, CASE WHEN round(score * 100, 1) >= 70 THEN 'Relevant' WHEN round(score * 100, 1) >= 45 THEN 'Uncertain' ELSE 'Irrelevant' END AS v FROM scores WHERE idx < 6))
        WHERE seen = 0 GROUP BY 1""",
        "scores",
    ),
    "match_videos": sql(
        f"""SELECT video_id, campaign_id, campaign_match, round(conf, 4) AS confidence, match_type, round(mx, 4) AS top_similarity, {rnd('av', 4)} AS average_similarity, best AS best_reference, best_frame,
        n_refs AS num_references, frames AS num_frames_analyzed, round(strong, 4) AS threshold_used, temporal_strength, longest_streak, {rnd('comp', 4)} AS competitor_similarity, round(amb, 4) AS ambiguity_score, verdict,
        round(conf * 100, 1) AS confidence_pct, 'store_refs' AS dominant_cluster, label AS explained_cluster, soc AS explained_social, prod AS explained_product, {VIDEO_REASON} AS reasoning,
        array_to_string({_video_warnings}, '|') AS warnings FROM vid2""",
        "vid2",
    ),
    "whole_bank_similarity": sql(
        f"""SELECT campaign_id, n_refs, {rnd('mean')} AS intra_similarity_mean, {rnd('std')} AS intra_similarity_std FROM intra
        UNION ALL SELECT -1, (SELECT count(*) FROM ev), {rnd('avg(s)')}, {rnd('stddev_pop(s)')} FROM (SELECT {dot('a.e', 'b.e')} AS s FROM ev a JOIN ev b ON a.vec_id < b.vec_id)""",
        "intra", "ev",
    ),
    "keyframe_match": sql(
        f"""SELECT video_id, campaign_id, frames AS num_frames_analyzed, match_type, round(mx, 4) AS top_similarity, best AS best_reference, best_frame, temporal_strength, longest_streak,
        {rnd('comp_k', 4)} AS competitor_similarity, round(strong, 4) AS threshold_used, round(conf, 4) AS confidence FROM vid2_k""",
        "vid2_k",
    ),
    "dedupe_frames": sql("SELECT video_id, frame_idx, kept_order FROM dedup", "dedup"),
    "dedupe_frames_rounds": sql("SELECT video_id, frame_idx, kept_order FROM dedup", "dedup"),
    "shared_videos": sql(
        f"""SELECT v.video_id // 1000000 AS video_id, v.campaign_id, v.frames AS num_frames_analyzed, round(v.mx, 4) AS top_similarity, v.best AS best_reference, v.best_frame, s.temporal_strength, s.longest_streak
        FROM vid0_s v JOIN vstr_s s ON s.seq_id = v.video_id""",
        "vid0_s", "vstr_s",
    ),
    "shared_targets": sql(
        f"""SELECT target_id, campaign_id, count(*) AS n_refs, {rnd('max(sim)')} AS max_similarity, {rnd('avg(sim)')} AS avg_similarity, {rnd('avg(sim) FILTER (WHERE r <= 5)')} AS top_k_avg, max(ref_name) FILTER (WHERE r = 1) AS best_reference
        FROM (SELECT *, row_number() OVER (PARTITION BY target_id, campaign_id ORDER BY sim DESC, ref_id) AS r FROM (
        SELECT s.target_id // 1000000 AS target_id, s.campaign_id, b.ref_id, b.ref_name, {dot('s.e', 'b.e')} AS sim FROM tgt_s s JOIN bank b USING (campaign_id)
        UNION ALL SELECT t.target_id, -1, v.vec_id, 'all_' || v.vec_id, {dot('t.e', 'v.e')} FROM tgt t CROSS JOIN ev v)) GROUP BY 1, 2""",
        "tgt_s", "bank", "tgt", "ev",
    ),
    "frame_scores": sql(
        f"""SELECT i.video_id, i.campaign_id, i.frame_idx, i.frame_name AS frame_id, round(i.mx, 4) AS max_similarity, {rnd('i.av', 4)} AS avg_similarity, round(i.ct, 4) AS top_k_avg, i.best AS best_reference,
        {rnd(calibrated('round(s.smo, 4)', 's.strong', 's.thr'), 4)} AS smoothed_similarity, {rnd('i.comp', 4)} AS competitor_similarity, {rnd('i.fused', 4)} AS raw_score FROM img0 i JOIN vsmo s ON s.seq_id = i.video_id AND s.idx = i.frame_idx""",
        "img0", "vsmo",
    ),
    "video_segments": sql(f"SELECT * RENAME (seq_id AS video_id) FROM ({segments('vsmo', 'smo', 'thr')})", "vsmo"),
    "sequence_context": sql(
        f"""SELECT video_id, campaign_id, social AS is_social_media, round(aspect, 4) AS aspect_ratio, overlays AS has_overlays, round(level, 4) AS compression_level, {rnd('off', 4)} AS suggested_threshold_offset,
        {VIDEO_REASON} AS reasoning FROM vid0""",
        "vid0",
    ),
    "sample_interval": sql("SELECT video_id, frame_idx FROM sampled", "sampled"),
    "sample_even": sql("SELECT video_id, frame_idx FROM even", "even"),
    "blur_filter": sql("SELECT * FROM blurred", "blurred"),
    "frame_diff": sql(
        f"""SELECT a.video_id, a.frame_idx, {rnd('list_sum(list_transform(list_zip(z.thumb, a.thumb), lambda t: abs(t[1] - t[2]))) / 1024 / 255')} AS difference,
        {rnd('(list_dot_product(z.hist, a.hist) - 64 * list_avg(z.hist) * list_avg(a.hist)) / sqrt((list_dot_product(z.hist, z.hist) - 64 * list_avg(z.hist) ** 2) * (list_dot_product(a.hist, a.hist) - 64 * list_avg(a.hist) ** 2))')} AS correlation
        FROM pic a JOIN (SELECT * FROM pic WHERE frame_idx = 0) z USING (video_id)""",
        "pic",
    ),
    "media_context": sql(
        f"""SELECT target_id, social AS is_social_media, round(aspect, 4) AS aspect_ratio, overlays AS has_overlays, mobile AS is_mobile_screenshot, subs AS has_subtitles, {rnd('level', 4)} AS compression_level,
        {rnd('off', 4)} AS suggested_threshold_offset, reasoning FROM ctx""",
        "ctx",
    ),
    "text_normalize": sql("SELECT doc_id, md5(nt) AS digest, length(nt) AS n, contains(nt, 'anble') AS has_term FROM docn", "docn"),
    "brand_mentions": sql(f"SELECT doc_id, t.term, contains(nt, t.term) AS exact FROM docn, {values(d.BRAND_TERMS)} t(i, term) WHERE contains(nt, t.term) OR {close('ws', 't.term')}", "docn"),
    "term_table_mentions": sql(
        """SELECT doc_id, term, bool_or(exact) AS exact FROM (SELECT doc_id, term, exact FROM (SELECT doc_id, unnest(ws) AS w FROM docn) JOIN mnear USING (w)
        UNION ALL SELECT doc_id, term, true FROM docn, mnorm WHERE contains(n, ' ') AND contains(nt, n)) GROUP BY ALL""",
        "docn", "mnear", "mnorm",
    ),
    "ocr_term_table": sql(
        f"""SELECT item_id, array_to_string(bm, '|') AS brand_matched, array_to_string(tm, '|') AS hashtag_matched,
        {rnd('CASE WHEN len(bm) > 0 THEN least(1.0::DOUBLE, 0.6 + conf * 0.4) WHEN len(tm) > 0 THEN least(0.7::DOUBLE, 0.3 + conf * 0.3) ELSE 0.0::DOUBLE END')} AS score, len(bm) + len(tm) > 0 AS fired FROM ocrt""",
        "ocrt",
    ),
    "ocr_evidence": sql(
        f"SELECT item_id, substr(txt, 1, 200) AS ocr_head, {rnd('conf')} AS avg_conf, array_to_string(list_concat(bm, tm), '|') AS matched_terms, {rnd('score')} AS score, fired, 0.7::DOUBLE AS weight, {lit('OCR text: ' + chr(39))} || substr(txt, 1, 200) || {lit(chr(39) + ' | Brand: ')} || {quoted('bm')} || ' | Hashtags: ' || {quoted('tm')} AS evidence FROM ocr", "ocr"
    ),
    "caption_evidence": sql(f"SELECT item_id, array_to_string(mt, '|') AS matched_terms, {rnd('score')} AS score, fired, 0.7::DOUBLE AS weight, {lit('Caption: ' + chr(39))} || c || {lit(chr(39) + ' | Matched: ')} || {quoted('mt')} AS evidence FROM cap", "cap"),
    "prompt_table": sql(
        f"""SELECT brand_id, prompt_kind, row_number() OVER (PARTITION BY brand_id ORDER BY k, i, ti) - 1 AS prompt_idx, prompt FROM (
        SELECT brand_id, 'brand' AS prompt_kind, 0 AS k, i, ti, replace(tpl, '{{}}', name) AS prompt FROM brandn, {values(mn.PROMPT_TEMPLATES)} t(ti, tpl) WHERE regexp_matches(name, '^[\\x00-\\x7F]*$')
        UNION ALL SELECT brand_id, 'negative', 1, 0, ti, tpl FROM (SELECT DISTINCT brand_id FROM brandn), {values(mn.NEGATIVE_PROMPTS)} t(ti, tpl))""",
        "brandn",
    ),
    "class_table": sql(
        f"""SELECT brand_id, row_number() OVER (PARTITION BY brand_id ORDER BY k, i, ti) - 1 AS class_idx, class_name FROM (
        SELECT brand_id, 0 AS k, i, ti, replace(tpl, '{{}}', name) AS class_name FROM brandn, {values(mn.CLASS_TEMPLATES)} t(ti, tpl)
        UNION ALL SELECT brand_id, 1, 0, ti, tpl FROM (SELECT DISTINCT brand_id FROM brandn), {values(mn.GENERIC_CLASSES)} t(ti, tpl))""",
        "brandn",
    ),
    "image_layer": sql(
        f"""SELECT target_id AS item_id, 'image' AS layer, {rnd('mx * 0.7 + av * 0.3')} AS score, mx * 0.7 + av * 0.3 > 0.75 AS fired,
        printf('Best ref sim: %.3f, avg: %.3f, blended: %.3f (%d refs)', mx, av, mx * 0.7 + av * 0.3, n_refs) AS evidence, 4.0::DOUBLE AS weight FROM tstat""",
        "tstat",
    ),
    "prompt_layer": sql(
        f"""SELECT item_id, 'prompt' AS layer, {rnd('least(1.0::DOUBLE, greatest(0.0::DOUBLE, (b - 0.21) / 0.07))')} AS score, b >= 0.23 AND b > ng + 0.01 AS fired,
        printf('Best brand sim: %.3f (''prompt %d''), best neg: %.3f, diff: %.3f', b, bi, ng, b - ng) AS evidence, 0.8::DOUBLE AS weight FROM (
        SELECT item_id, max(s) FILTER (WHERE i % 8 <> 7) AS b, first(i ORDER BY s DESC, i) FILTER (WHERE i % 8 <> 7) AS bi, max(s) FILTER (WHERE i % 8 = 7) AS ng
        FROM (SELECT target_id AS item_id, unnest(generate_series(0, 63)) AS i, 0.2::DOUBLE + unnest(e) * 0.2::DOUBLE AS s FROM tgt) GROUP BY 1)""",
        "tgt",
    ),
    "detections": sql("SELECT item_id, event_id, kind, label, conf3 FROM box", "box"),
    "detection_layer": sql(
        f"""SELECT item_id, 'detection' AS layer, {rnd('score')} AS score, fired, evidence, 0.7::DOUBLE AS weight FROM detl""",
        "detl",
    ),
    "brand_video": sql(
        """SELECT q.seq_id, coalesce(n_scanned, 0) AS n_scanned, b.idx, item_id, coalesce(verdict, 'Irrelevant') AS verdict, coalesce(confidence, 0.0::DOUBLE) AS confidence, confidence_raw, label
        FROM (SELECT DISTINCT seq_id FROM framev UNION ALL SELECT -1) q LEFT JOIN framebest b ON b.seq_id = q.seq_id LEFT JOIN framev v ON v.seq_id = b.seq_id AND v.idx = b.idx""",
        "framev", "framebest",
    ),
    "bankless_matches": sql(
        """SELECT campaign_id, count(*) AS n, count(*) FILTER (WHERE match_type <> 'NO_MATCH') AS matched, count(*) FILTER (WHERE len(warnings) > 0) AS warned, round(max(round(conf, 4)), 4) AS most FROM img GROUP BY 1
        UNION ALL SELECT -1, count(*), 0, 0, 0.0::DOUBLE FROM img""",
        "img",
    ),
    "bank_readiness": sql(
        """SELECT campaign_id, coalesce(n, 0) AS n_refs, coalesce(m, 0) AS n_negs, coalesce(n, 0) > 0 AS ready FROM (SELECT DISTINCT campaign_id FROM tgt UNION ALL SELECT -1 UNION ALL SELECT -2)
        LEFT JOIN (SELECT campaign_id, count(*) AS n FROM bank GROUP BY 1) USING (campaign_id) LEFT JOIN (SELECT campaign_id, count(*) AS m FROM neg GROUP BY 1) USING (campaign_id)""",
        "tgt", "bank", "neg",
    ),
    "bank_reuse": sql("SELECT campaign_id, CASE campaign_id WHEN 3 THEN 2 ELSE 1 END::BIGINT AS builds, count(*) - CASE campaign_id WHEN 3 THEN 1 ELSE 0 END AS n_refs FROM bank GROUP BY 1", "bank"),
    "report_payload": sql(
        """SELECT campaign_id, num_targets, matches, rejections, b.n_refs AS num_references, c.grade AS cluster_quality, social_targets, num_targets AS lines, matches AS matched_lines
        FROM run JOIN bvar b USING (campaign_id) JOIN coh c USING (campaign_id) JOIN (SELECT campaign_id, count(*) FILTER (WHERE social) AS social_targets FROM img GROUP BY 1) USING (campaign_id)""",
        "run", "bvar", "coh", "img",
    ),
    "color_layer": sql(
        f"""SELECT item_id, 'color' AS layer, {rnd('score')} AS score, score > 0.70 AS fired, printf('Color match score: %.3f (min dist=%.1f)', score, dist) AS evidence, 0.3::DOUBLE AS weight FROM colr""",
        "colr",
    ),
    "hex_colors": """SELECT p_partkey, printf('#%06x', v) AS hex, v // 65536 AS r, v // 256 % 256 AS g, v % 256 AS b FROM (SELECT p_partkey, (p_partkey * 2654435) % 16777216 AS v FROM part)""",
    "ensemble": sql(f"SELECT item_id, fired_count, {rnd('es')} AS ensemble_score FROM fus", "fus"),
    "brand_verdict": sql(verdicts("fus"), "fus"),
    "detect_brands": sql(
        f"SELECT v.*, {', '.join(f'{rnd(n + chr(95) + chr(115))} AS {n}_score' for n in ev.LAYERS)} FROM ({verdicts('dfus')}) v JOIN dfus USING (item_id)", "dfus"
    ),
    "score_distribution": sql(
        f"""SELECT seq_id, n, round(m, 4) AS mean, round(med, 4) AS median, round(sd, 4) AS std, round(lo, 4) AS min, round(hi, 4) AS max,
        {rnd('CASE WHEN n >= 3 AND sd > 0.001 THEN s3 / sd ** 3 ELSE 0 END', 4)} AS skewness, bin_0, bin_1, bin_2, bin_3, bin_4,
        CASE WHEN sd < 0.015 AND m BETWEEN 0.58 AND 0.76 THEN 'HIGH_AMBIENT_OVERLAP_RISK' WHEN hi > 0.85 AND m < 0.50 THEN 'CLEAR_TRANSIENT_MATCH' WHEN m > 0.80 THEN 'SUSTAINED_STRONG_MATCH' ELSE 'NOMINAL_NO_MATCH' END AS risk_profile
        FROM (SELECT seq_id, count(*) AS n, any_value(mu) AS m, median(score) AS med, stddev_pop(score) AS sd, min(score) AS lo, max(score) AS hi, avg((score - mu) ** 3) AS s3, {_bins}
        FROM (SELECT *, avg(score) OVER (PARTITION BY seq_id) AS mu FROM scores) GROUP BY 1)""",
        "scores",
    ),
    "social_analytics": sql(
        f"""SELECT campaign_id, count(*) AS total_targets, count(*) FILTER (WHERE social) AS social_targets, round(count(*) FILTER (WHERE social) / count(*), 4) AS social_ratio,
        round(count(*) FILTER (WHERE round(aspect, 4) < 0.8) / count(*), 4) AS vertical_ratio, round(count(*) FILTER (WHERE overlays) / count(*), 4) AS overlay_ratio,
        round(count(*) FILTER (WHERE subs) / count(*), 4) AS subtitle_ratio, round(count(*) FILTER (WHERE mobile) / count(*), 4) AS mobile_screenshot_ratio,
        round(avg(round(level, 4)), 4) AS average_compression, round(avg(soc), 4) AS average_social_adjustment,
        array_to_string(list_filter([{', '.join(f"CASE WHEN count(*) FILTER (WHERE pf = '{p}') > 0 THEN '{p}=' || count(*) FILTER (WHERE pf = '{p}') END" for p in rp.PLATFORMS)}], lambda x: x IS NOT NULL), ',') AS platform_distribution
        FROM (SELECT *, {platform('filename', 'reasoning')} AS pf FROM img) GROUP BY 1""",
        "img",
    ),
    "run_summary": sql(
        f"""SELECT campaign_id, num_targets, matches, strong_matches, possible_matches, rejections, b.n_refs AS num_references, round(b.variance, 4) AS reference_variance, c.grade AS cluster_quality,
        round(c.mean, 4) AS intra_similarity_mean, round(c.std, 4) AS intra_similarity_std, {rnd('c.s', 4)} AS silhouette_score FROM run JOIN bvar b USING (campaign_id) JOIN coh c USING (campaign_id)""",
        "run", "bvar", "coh",
    ),
    "evaluation": sql(
        f"""SELECT tp, fn, fp, tn, round(pr, 4) AS precision, round(rc, 4) AS recall, round({share('fp', 'fp + tn')}, 4) AS fpr, round({share('fn', 'tp + fn')}, 4) AS fnr,
        round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END, 4) AS f1 FROM (SELECT *, {share('tp', 'tp + fp')} AS pr, {share('tp', 'tp + fn')} AS rc FROM conf)""",
        "conf",
    ),
    "evaluation_predictions": sql(f"SELECT target_id, {rnd('score')} AS score, is_match, match_type FROM pred", "pred"),
    "campaign_report": sql(
        """SELECT campaign_id, count(*) AS num_targets, count(*) FILTER (WHERE campaign_match) AS matches, count(*) FILTER (WHERE match_type = 'STRONG_MATCH') AS strong_matches,
        count(*) FILTER (WHERE match_type IN ('PROBABLE_STRONG_MATCH', 'POSSIBLE_MATCH')) AS possible_matches, count(*) FILTER (WHERE match_type = 'NO_MATCH') AS rejections FROM camp GROUP BY 1""",
        "camp",
    ),
    "campaign_results": sql("SELECT campaign_id, file, match_type, verdict, confidence, best_reference, num_frames_analyzed, social_adjustment, source_url, error FROM camp", "camp"),
    "campaign_analytics": sql(
        f"""SELECT campaign_id, count(*) AS total_targets, count(*) FILTER (WHERE has AND social) AS social_targets, round(count(*) FILTER (WHERE has AND social) / count(*), 4) AS social_ratio,
        round(count(*) FILTER (WHERE has AND round(aspect, 4) < 0.8) / count(*), 4) AS vertical_ratio, round(count(*) FILTER (WHERE has AND overlays) / count(*), 4) AS overlay_ratio,
        round(count(*) FILTER (WHERE has AND subs) / count(*), 4) AS subtitle_ratio, round(count(*) FILTER (WHERE has AND mobile) / count(*), 4) AS mobile_screenshot_ratio,
        coalesce(round(avg(round(level, 4)) FILTER (WHERE has), 4), 0.0::DOUBLE) AS average_compression, coalesce(round(avg(social_adjustment) FILTER (WHERE has), 4), 0.0::DOUBLE) AS average_social_adjustment,
        array_to_string(list_filter([{', '.join(f"CASE WHEN count(*) FILTER (WHERE has AND pf = '{p}') > 0 THEN '{p}=' || count(*) FILTER (WHERE has AND pf = '{p}') END" for p in rp.PLATFORMS)}], lambda x: x IS NOT NULL), ',') AS platform_distribution
        FROM (SELECT *, {platform('file', 'reasoning')} AS pf FROM camp) GROUP BY 1""",
        "camp",
    ),
    "debug_exports": sql(
        f"""SELECT target_id, filename AS frame_id, round(mx, 4) AS max_similarity, {rnd('av', 4)} AS avg_similarity, round(ct, 4) AS top_k_avg, round(conf, 4) AS smoothed_similarity, {rnd('fused', 4)} AS raw_score FROM img""",
        "img",
    ),
    "debug_matches": sql(
        "SELECT target_id, r AS rank, ref_name AS reference_name, round(sim, 4) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY sim DESC, ref_id) AS r FROM pair) WHERE r <= 5",
        "pair",
    ),
    "debug_headers": sql(
        f"""SELECT target_id, campaign_match, round(conf, 4) AS confidence, match_type, round(mx, 4) AS top_similarity, {rnd('av', 4)} AS average_similarity, best AS best_reference, filename AS best_frame,
        round(strong, 4) AS threshold_used, {rnd('variance', 4)} AS reference_variance, img.n_refs AS num_references, 1::BIGINT AS num_frames_analyzed, grade AS cluster_quality, reasoning FROM img JOIN coh USING (campaign_id)""",
        "img", "coh",
    ),
    "flatten_results": sql(
        """SELECT target_id, verdict, grade AS cohesion_metrics_cluster_quality, social AS media_context_is_social_media, reasoning AS media_context_reasoning, length(to_json(warnings)) AS warnings_chars FROM img JOIN coh USING (campaign_id)""",
        "img", "coh",
    ),
    "list_media": sql(
        f"SELECT path, length FROM (SELECT *, row_number() OVER (PARTITION BY lower(path) ORDER BY path) AS r FROM lst WHERE {extension('path')} IN {any_of(paths.REFERENCE_EXTS)}) WHERE r = 1", "lst"
    ),
    "list_targets": sql(f"SELECT path, {media_type('path')} AS media_type FROM ltgt", "ltgt"),
    "resolve_roles": sql("SELECT campaign, path, role FROM roles", "roles"),
    "scan_posts": f"""SELECT regexp_extract(path, '^data/([^/]+)/([^/]+)/posts/[^/]+$', 1) AS influencer, regexp_extract(path, '^data/([^/]+)/([^/]+)/posts/[^/]+$', 2) AS platform, path, {media_type('path')} AS media_type FROM (
        SELECT 'data/' || replace(c_name, '#', '_') || '/' || lower(c_mktsegment) || '/' || CASE WHEN c_custkey % 9 = 0 THEN 'drafts/' WHEN c_custkey % 10 = 0 THEN 'posts/old/' ELSE 'posts/' END || c_custkey ||
        {pick(['.jpg', '.mp4', '.tar.gz', '', '.JPEG'], 'c_custkey % 5')} AS path FROM customer) WHERE regexp_matches(path, '^data/([^/]+)/([^/]+)/posts/[^/]+$')""",
    "bank_fingerprint": sql(
        f"""SELECT campaign, count(*) AS n_files, md5(concat_ws(':', count(*), sum(a), sum(b))) AS fingerprint FROM (SELECT campaign, CAST('0x' || substr(h, 1, 15) AS BIGINT) AS a, CAST('0x' || substr(h, 16, 15) AS BIGINT) AS b
        FROM (SELECT split_part(path, '/', 3) AS campaign, md5(concat_ws(':', regexp_extract(path, '[^/]*$'), length, modified)) AS h
        FROM (SELECT *, row_number() OVER (PARTITION BY lower(path) ORDER BY path) AS r FROM lst WHERE {extension('path')} IN {any_of(paths.REFERENCE_EXTS)}) WHERE r = 1)) GROUP BY 1""",
        "lst",
    ),
    "posts_clean": f"""SELECT coalesce(nullif({stripped('u')}, ''), '{po.UNKNOWN_USER}') AS username, {stripped('l')} AS link, row_index FROM (SELECT p.page_id AS row_index,
        CASE WHEN p.page_id % 11 = 0 THEN '  ' WHEN p.page_id % 7 <> 0 THEN ' ' || c.c_name END AS u, CASE WHEN p.page_id % 13 = 0 THEN ' ' WHEN p.page_id % 5 <> 0 THEN p.url || ' ' END AS l
        FROM pages p LEFT JOIN customer c ON c.c_custkey = p.page_id) WHERE {stripped('l')} <> ''""",
    "media_urls": sql("SELECT page_id, url, ext, ext <> '' AS direct, manifest FROM mux", "mux"),
    "union_targets": sql(
        "SELECT 'file' AS type, path, NULL::VARCHAR AS username, NULL::VARCHAR AS url FROM ltgt UNION ALL SELECT 'url', NULL, 'user ' || page_id, url FROM mu", "ltgt", "mu"
    ),
    "expand_media": sql(
        """SELECT 'file' AS type, path, NULL::VARCHAR AS username, NULL::VARCHAR AS source_url FROM ltgt UNION ALL
        SELECT 'url', unnest(CASE WHEN length(url) % 2 = 0 THEN [manifest, 'alt_' || manifest] ELSE [manifest] END), 'user ' || page_id, url FROM mux WHERE ext <> '' AND length(url) % 7 <> 0""",
        "ltgt", "mux",
    ),
    "fetch_errors": sql(
        """SELECT false AS campaign_match, 'NO_MATCH' AS match_type, 'Irrelevant' AS verdict, 0.0::DOUBLE AS confidence, '' AS file, '' AS filename, 'user ' || page_id AS username, url AS source_url,
        CASE WHEN length(url) % 7 = 0 THEN 'no fetch outcome' ELSE 'yt-dlp not available' END AS error FROM mux WHERE ext = '' OR length(url) % 7 = 0""",
        "mux",
    ),
}
