"""Further registered queries: candidate families, page miners, corpus features, counts and checks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..functions import vectors as V
from ..operators import candidates as A
from ..operators import corpus as C
from ..operators import evaluate as E
from ..operators import integrity as I
from ..operators import joint as J
from ..operators import learn as L
from ..operators import mining as M
from ..operators import names as names_
from ..operators import neighbours as N
from ..operators import pages as G
from ..operators import pairing as P
from ..operators import render as R
from . import view
from .queries import LABELS, TRIPLES, label_ids, query, r6, triples
from .view import CATALOG, CORPUS, PAIRS, ROLE, load

# --- candidate families ---------------------------------------------------------------------------------------


def sweep_sql(source: str, rows: list[tuple[str, str, str | None]], k: int = 10) -> str:
    """SQL that ranks named expressions over a relation, each behind its own guard."""
    union = " UNION ALL ".join(f"SELECT h_id, id, '{name}' AS candidate, round(CAST({score} AS DOUBLE), 9) AS score FROM {source}" + (f" WHERE {guard}" if guard else "") for name, score, guard in rows)
    return f"c AS ({union}), r AS (SELECT *, row_number() OVER (PARTITION BY candidate, h_id ORDER BY score DESC, id) AS rank FROM c) SELECT candidate, h_id, id, rank FROM r WHERE rank <= {k}"


def first_ten(pairs: DataFrame, candidates: list[A.Candidate]) -> DataFrame:
    rounded = [A.Candidate(c.name, F.round(c.score, 9), c.guard) for c in candidates]
    return A.sweep(pairs, rounded).where("rank <= 10").select("candidate", "h_id", "id", "rank")


CENTROID = """
parts_of AS (SELECT pos, avg(x) AS x FROM (SELECT unnest(unit) AS x, generate_subscripts(unit, 1) AS pos FROM corpus WHERE serif) GROUP BY pos),
mean_of AS (SELECT list(x ORDER BY pos) AS c FROM parts_of), centre AS (SELECT list_transform(c, lambda x: x / n) AS c FROM (SELECT c, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS n FROM mean_of)),
medians AS (SELECT list_sort(list(stroke))[CAST(floor(count(stroke) / 2) AS BIGINT) + 1] AS ms, list_sort(list(width))[CAST(floor(count(width) / 2) AS BIGINT) + 1] AS mw FROM corpus WHERE eligible),
quiet AS (SELECT id, (list_sum(list_transform(list_zip(unit, c), lambda z: z[1] * z[2])) + 1) / 2 AS centroid_sim,
  coalesce(1 - 0.5 * (least(CAST(1 AS DOUBLE), abs(stroke - ms) / CAST(0.3 AS DOUBLE)) + least(CAST(1 AS DOUBLE), abs(width - mw) / CAST(0.3 AS DOUBLE))), 0) AS plain FROM corpus, centre, medians)"""


def with_quiet(corpus: DataFrame) -> DataFrame:
    """(id, centroid_sim, plain) of every corpus row."""
    return A.plainness(A.centroid_similarity(corpus, F.col("serif")), F.col("eligible")).select("id", "centroid_sim", "plain")


def typical(spark, sf) -> DataFrame:
    near = N.knn(view.corpus(spark, sf).where("eligible"), K.TYPICAL_NEAR)
    return N.typicality(near, K.TYPICAL_NEAR).select("id", "typicality")


def screened(spark, sf) -> DataFrame:
    """Pairs with the candidate's signals of quietness."""
    pairs = view.role_pairs(spark, sf).join(with_quiet(view.corpus(spark, sf)), "id").join(typical(spark, sf).withColumnRenamed("typicality", "typical"), "id")
    return pairs.withColumn("centroid_leg", F.coalesce("legibility", "centroid_sim"))


@query(f"WITH {CORPUS}, {CENTROID} SELECT id, round(centroid_sim, 6) AS centroid_sim, round(plain, 6) AS plain FROM quiet")
def quiet_signals(spark, sf):
    return with_quiet(view.corpus(spark, sf)).select("id", r6("centroid_sim").alias("centroid_sim"), r6("plain").alias("plain"))


_GATE = "coalesce(exp(-abs(h_xh - xh) / CAST({} AS DOUBLE)), 0)"


def _variant_sql(t="0", leg="0.5", serif="0.2", sigma="0.05", legibility="leg") -> str:
    return f"cn - CAST({t} AS DOUBLE) * cos + CAST({serif} AS DOUBLE) * serif_split * {_GATE.format(sigma)} + 0.5 * xh_match + 0.5 * width_match + CAST({leg} AS DOUBLE) * {legibility}"


_BODY = "weight BETWEEN 300 AND 700"
_PARAMETERS = [
    ("contrast", "contrast", None), ("role", _variant_sql(), None), ("role, body guard", _variant_sql(), _BODY), ("role, body and stroke guard", _variant_sql(), f"{_BODY} AND weight <= h_weight"),
    ("role, centroid legibility", _variant_sql(legibility="centroid_leg"), None), *[(f"legibility {v}", _variant_sql(leg=v), None) for v in ("0.0", "0.25", "0.5", "0.75", "1.0")],
    *[(f"serif {v}", _variant_sql(serif=v), None) for v in ("0.0", "0.1", "0.2", "0.4")], *[(f"t {v}", _variant_sql(t=v), None) for v in ("-0.5", "0.0", "0.5")], *[(f"sigma {v}", _variant_sql(sigma=v), None) for v in ("0.03", "0.05", "0.1")],
]


@query(f"WITH {ROLE}, {CENTROID}, x AS (SELECT s.*, coalesce(s.legibility, centroid_sim) AS centroid_leg FROM scored s JOIN quiet USING (id)), {sweep_sql('x', _PARAMETERS)}")
def parameter_sweep(spark, sf):
    pairs = view.role_pairs(spark, sf).join(with_quiet(view.corpus(spark, sf)), "id").withColumn("centroid_leg", F.coalesce("legibility", "centroid_sim"))
    return first_ten(pairs, A.parameter_candidates("body"))


def _match_sql(name: str, span: str) -> str:
    return f"CASE WHEN h_{name} IS NULL OR {name} IS NULL THEN -1 ELSE 1 - least(CAST(1 AS DOUBLE), abs(h_{name} - {name}) / CAST({span} AS DOUBLE)) END"


_XH, _WIDTH, _STROKE, _APERTURE = (_match_sql(n, s) for n, s in (("xh", "0.15"), ("width", "0.3"), ("stroke", "0.3"), ("aperture", "0.3")))
_SPLIT = "CASE WHEN h_category <> category THEN CAST(1 AS DOUBLE) ELSE 0 END"
_ROLE, _BENCH = "body_score", "body_score - cos"
_AXES = [
    ("cosine", "cos", None), ("contrast", "contrast", None), ("role", _ROLE, None), ("xh", _XH, None), ("width", _WIDTH, None), ("stroke", _STROKE, None), ("aperture", _APERTURE, None),
    ("weight", "1 - least(CAST(1 AS DOUBLE), abs(h_weight - weight) / CAST(400 AS DOUBLE))", None), ("category split", _SPLIT, None), ("legibility", "leg", None), ("serif axis", "serif_split * gate", None),
    ("split * xh", f"{_SPLIT} * greatest(CAST(0 AS DOUBLE), {_XH})", None), ("split * (xh + width + stroke)", f"{_SPLIT} * greatest(CAST(0 AS DOUBLE), 0.5 * ({_XH}) + 0.3 * ({_WIDTH}) + 0.2 * ({_STROKE}))", None),
    ("contrast + xh", f"cn + ({_XH})", None), ("cosine + xh", f"cos + ({_XH})", None), ("cosine + xh + width", f"cos + ({_XH}) + ({_WIDTH})", None),
    *[(f"role + 0.5 {n}", f"{_ROLE} + 0.5 * ({x})", None) for n, x in (("width", _WIDTH), ("stroke", _STROKE), ("aperture", _APERTURE))],
    ("bench", _BENCH, _BODY), ("default", _ROLE, _BODY), ("bench + 0.5 width", f"{_BENCH} + 0.5 * ({_WIDTH})", _BODY), ("bench + 0.75 width", f"{_BENCH} + 0.75 * ({_WIDTH})", _BODY),
]


@query(f"WITH {ROLE}, {sweep_sql('scored', _AXES)}")
def axis_sweep(spark, sf):
    return first_ten(view.role_pairs(spark, sf), A.axis_candidates("body"))


_BY_CENTROID = _variant_sql(legibility="centroid_leg")
_SIGNALS = {"centroid": "centroid_sim", "neutral": "(1 - cn)", "typical": "typical", "plain": "plain", "cosine + typical": "(cos + typical)"}
_SCREEN = [
    ("centroid legibility", _BY_CENTROID, None), *[(n, x, None) for n, x in _SIGNALS.items()], *[(f"role + {n}", f"{_ROLE} + 0.5 * {x}", None) for n, x in _SIGNALS.items()],
    ("guard, centroid legibility", _BY_CENTROID, _BODY), *[(f"guard + {n}", f"{_BENCH} + 0.5 * {x}", _BODY) for n, x in _SIGNALS.items()],
]


@query(f"""WITH {ROLE}, {CENTROID}, e AS (SELECT id, unit FROM corpus WHERE eligible),
close_ AS (SELECT a.id, list_sum(list_transform(list_zip(a.unit, b.unit), lambda z: z[1] * z[2])) AS dot, b.id AS near FROM e a JOIN e b ON a.id <> b.id),
typ AS (SELECT id, avg(dot) AS typical FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dot DESC, near) AS rn FROM close_) WHERE rn <= 20 GROUP BY 1),
x AS (SELECT s.*, centroid_sim, plain, typical, coalesce(s.legibility, centroid_sim) AS centroid_leg FROM scored s JOIN quiet USING (id) JOIN typ USING (id)), {sweep_sql('x', _SCREEN)}""")
def screen_sweep(spark, sf):
    return first_ten(screened(spark, sf), A.screen_candidates("body"))


_LEG = "coalesce(legibility, 0)"
_DAMP = "(1 - 0.3 * least(CAST(1 AS DOUBLE), coalesce(abs(h_width - width), 0) / CAST(0.3 AS DOUBLE)))"
_GAPS = {"serif": "serif_split", "weight": "least(CAST(1 AS DOUBLE), abs(h_weight - weight) / CAST(400 AS DOUBLE))", "stroke": "least(CAST(1 AS DOUBLE), coalesce(abs(h_stroke - stroke), 0))"}
_CHALLENGERS = [
    ("product", "contrast", None), *[(f"cn + {w} leg", f"cn + {w} * {_LEG}", None) for w in ("0.25", "0.5", "0.75", "1.0", "1.5", "2.0")],
    *[(f"cn * (leg + {e})", f"cn * ({e} + (1 - {e}) * {_LEG})", None) for e in ("0.1", "0.3")], *[(f"cn * (1 + {w} leg)", f"cn + {w} * {_LEG} * (1 - cn)", None) for w in ("0.5", "1.0")],
    *[(f"axis {'+'.join(ns)} {s}", f"{_GATE.format(s)} * {_DAMP} * ({' + '.join(_GAPS[n] for n in ns)})", None) for ns, s in ((("serif",), "0.1"), (("weight",), "0.1"), (("stroke",), "0.1"), (("serif",), "0.05"), (("serif", "weight"), "0.05"), (("serif", "stroke"), "0.05"), (("serif", "weight", "stroke"), "0.05"))],
]


@query(f"WITH {ROLE}, {sweep_sql('scored', _CHALLENGERS)}")
def challenger_sweep(spark, sf):
    return first_ten(view.role_pairs(spark, sf), A.challengers())


_NEAR = "((cos + 1) / 2)"
_GATES = {"xh 0.05": _GATE.format("0.05"), "xh 0.1": _GATE.format("0.1"), "cos": _NEAR, "xh * cos": f"({_GATE.format('0.1')} * {_NEAR})", "xh + cos / 2": f"({_GATE.format('0.05')} + 0.5 * {_NEAR})"}
_HYBRIDS = [(f"{w} leg + {g} serif, {name}", f"cn + {w} * {_LEG} + {g} * serif_split * {gate}", None) for w in ("0.5", "0.75", "1.0") for name, gate in _GATES.items() for g in ("0.2", "0.5")]


@query(f"WITH {ROLE}, {sweep_sql('scored', _HYBRIDS)}")
def hybrid_sweep(spark, sf):
    return first_ten(view.role_pairs(spark, sf), A.hybrids())


@query(f"""WITH {ROLE}, m AS (SELECT h_id, avg(cos) AS m, stddev_pop(cos) AS sd FROM scored GROUP BY 1),
x AS (SELECT s.*, (cos - m) / (sd + CAST(1e-9 AS DOUBLE)) AS z FROM scored s JOIN m USING (h_id)), {sweep_sql('x', [('blend', f'cn + 0.5 * {_LEG} + 0.2 * serif_split * gate + 0.25 * z', None)])}""")
def blended_scores(spark, sf):
    pairs = L.z_scored(view.role_pairs(spark, sf), "cos", ("h_id",), "z")
    return first_ten(pairs, [A.Candidate("blend", P.hand_score() + 0.25 * F.col("z"))])


@query(f"""WITH {PAIRS}, x AS (SELECT h_id, id, contrast FROM pairs WHERE id % 5 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY h_id ORDER BY contrast DESC, id) AS rank FROM x) SELECT h_id, id, rank FROM r WHERE rank <= 10""")
def ranking_without(spark, sf):
    scores = P.ranked(view.pairs(spark, sf).select("h_id", "id", F.col("contrast").alias("score")), "score")
    return A.excluding(scores, scores.where("id % 5 = 0")).where("rank <= 10").select("h_id", "id", "rank")


@query(f"WITH {PAIRS} SELECT count(*) AS pairs, round(max(contrast), 6) AS cmax, round(max(contrast) FILTER (weight BETWEEN 300 AND 700), 6) AS body_cmax FROM pairs")
def global_contrast(spark, sf):
    pairs = view.pairs(spark, sf).select("contrast", "weight")
    body = P.max_contrast(C.role_guard(pairs, "body", C.body_suitable(F.col("weight")))).select(r6("cmax").alias("body_cmax"))
    return pairs.agg(F.count("*").alias("pairs")).join(P.max_contrast(pairs).select(r6("cmax").alias("cmax"))).join(body)  # one row each


@query(f"""WITH {ROLE}, {LABELS}, l AS (SELECT h.id AS h_id, p.id AS partner FROM labels_ x JOIN canonical h ON h.family = x.heading JOIN canonical p ON p.family = x.partner),
s AS (SELECT 'head' AS role, h_id, id, head_score AS score FROM scored UNION ALL SELECT 'body', h_id, id, body_score FROM scored WHERE weight BETWEEN 300 AND 700),
r AS (SELECT *, row_number() OVER (PARTITION BY role, h_id ORDER BY score DESC, id) AS rank, count(*) OVER (PARTITION BY role, h_id) AS pool FROM s),
p AS (SELECT role, l.h_id, partner, coalesce(rank, n + 1) AS rank FROM (SELECT DISTINCT role, h_id, pool AS n FROM r) q JOIN l USING (h_id) LEFT JOIN r USING (role, h_id) WHERE r.id = partner OR r.id IS NULL
  UNION ALL SELECT role, l.h_id, partner, n + 1 FROM (SELECT DISTINCT role, h_id, pool AS n FROM r) q JOIN l USING (h_id) WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.role = q.role AND r.h_id = l.h_id AND r.id = partner)),
h AS (SELECT role, h_id, count(*) AS n, count(*) FILTER (rank <= 100) AS hits, coalesce(sum(1 / log2(rank + CAST(1 AS DOUBLE))) FILTER (rank <= 100), 0) AS dcg, list_sum(list_transform(range(1, least(count(*), 100) + 1), lambda p: 1 / log2(p + CAST(1 AS DOUBLE)))) AS idcg FROM p GROUP BY 1, 2),
e AS (SELECT role, count(*) AS headings, avg(hits / n) AS recall, avg(dcg / idcg) AS ndcg FROM h GROUP BY 1)
SELECT role, headings, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg FROM e UNION ALL SELECT NULL, CAST(sum(headings) AS BIGINT), round(avg(recall), 6), round(avg(ndcg), 6) FROM e""")
def role_ndcg(spark, sf):
    pairs = view.role_pairs(spark, sf)
    scores = {"head": pairs.select("h_id", "id", P.role_score("head").alias("score")), "body": C.role_guard(pairs, "body", C.body_suitable(F.col("weight"))).select("h_id", "id", P.role_score("body").alias("score"))}
    each = [E.per_heading(E.ranks_by_count(s, label_ids(spark, sf)), 100).withColumn("role", F.lit(role)) for role, s in scores.items()]
    return E.role_summary(each[0].unionByName(each[1])).select("role", "headings", r6("recall").alias("recall"), r6("ndcg").alias("ndcg"))


@query(f"""WITH {TRIPLES}, s AS (SELECT h_id, family, CAST(round(cn * 1e9) AS BIGINT) AS cn FROM scored), ref AS (SELECT h_id, CAST(round((hb + ha) * 1e9) AS BIGINT) AS r FROM best),
p AS (SELECT h_id, x.cn + y.cn AS v FROM s x JOIN s y USING (h_id) WHERE x.family <> y.family) SELECT h_id, count(*) FILTER (v > r) AS better, count(*) AS total FROM p JOIN ref USING (h_id) GROUP BY 1""")
def exhaustive_pairs(spark, sf):
    best = J.best_triple(triples(spark, sf)).select("h_id", (F.col("hb") + F.col("ha")).alias("objective"))
    return J.exhaustive(view.role_pairs(spark, sf).select("h_id", "family", "cn"), best).select("h_id", F.col("better").cast("long"), F.col("total").cast("long"))


@query(f"""WITH {TRIPLES}, q AS (SELECT *, hb + ha + ba + 0.25 * b_leg AS s, hb * ha * ba + 0 * b_leg AS p FROM o)
SELECT h_id, arg_min(b_id, rs) AS sum_body, arg_min(a_id, rs) AS sum_accent, arg_min(b_id, rp) AS product_body, arg_min(a_id, rp) AS product_accent FROM (
  SELECT *, row_number() OVER (PARTITION BY h_id ORDER BY round(s, 9) DESC, b_ord, a_ord) AS rs, row_number() OVER (PARTITION BY h_id ORDER BY round(p, 9) DESC, b_ord, a_ord) AS rp FROM q) GROUP BY 1""")
def triple_objectives(spark, sf):
    found = triples(spark, sf)

    def best(agg: str, beta: float) -> DataFrame:
        order = Window.partitionBy("h_id").orderBy(F.desc(F.round(J.objective(agg, beta), 9)), "b_ord", "a_ord")
        return found.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("h_id", F.col("b_id").alias(f"{agg}_body"), F.col("a_id").alias(f"{agg}_accent"))

    return best("sum", K.TRIPLE_LEGIBILITY).join(best("product", 0.0), "h_id")


# --- corpus features and counts -------------------------------------------------------------------------------


@query(f"""WITH {CATALOG}, v AS (SELECT id, category, family, xh, aperture, stroke FROM catalog WHERE xh IS NOT NULL AND aperture IS NOT NULL AND stroke IS NOT NULL),
r AS (SELECT *, (row_number() OVER (ORDER BY xh, id) - 1) / greatest(count(*) OVER () - 1, 1) AS x, (row_number() OVER (ORDER BY aperture, id) - 1) / greatest(count(*) OVER () - 1, 1) AS a, (row_number() OVER (ORDER BY stroke, id) - 1) / greatest(count(*) OVER () - 1, 1) AS s FROM v),
l AS (SELECT category, family, round((x + a + 1 - s) / 3, 4) AS l FROM r)
SELECT 'category' AS by, category AS name, round(avg(l), 6) AS mean, count(*) AS n FROM l GROUP BY 2 UNION ALL SELECT 'family', family, round(avg(l), 6), count(*) FROM l GROUP BY 2""")
def legibility_means(spark, sf):
    rows = view.catalog(spark, sf).select("id", "category", "family", "xh", "aperture", "stroke").dropna()
    for column in ("xh", "aperture", "stroke"):
        rows = E.rank_normalized(rows, column, "id", f"{column}_rank")
    score = F.round(R.legibility_of(F.col("xh_rank"), F.col("aperture_rank"), F.col("stroke_rank")), 4)
    means = lambda by: rows.withColumn("_l", score).groupBy(F.col(by).alias("name")).agg(r6(F.avg("_l")).alias("mean"), F.count("*").alias("n")).select(F.lit(by).alias("by"), "name", "mean", "n")
    return means("category").unionByName(means("family"))


@query(f"""WITH {CATALOG}, served AS (SELECT DISTINCT family, weight, style FROM catalog WHERE source = 'google'), kept AS (SELECT * FROM catalog c WHERE EXISTS (SELECT 1 FROM served s WHERE s.family = c.family AND s.weight = c.weight AND s.style = c.style))
SELECT (SELECT count(DISTINCT family) FROM catalog) AS families, (SELECT count(DISTINCT family) FROM served) AS published, (SELECT count(DISTINCT family) FROM kept) AS families_kept,
(SELECT count(DISTINCT family) FROM catalog) - (SELECT count(DISTINCT family) FROM kept) AS unpublished, (SELECT count(*) FROM catalog) - (SELECT count(*) FROM kept) AS cuts_dropped, (SELECT count(*) FROM kept) AS instances, (SELECT count(*) FROM kept WHERE eligible) AS eligible""")
def release_counts(spark, sf):
    cat = view.catalog(spark, sf)
    return C.release_counts(cat, cat.where("source = 'google'").select("family", "weight", "style"))


@query(f"WITH {CATALOG} SELECT id, family, weight, style FROM catalog ORDER BY lower(family), weight, style, id LIMIT 50")
def instance_order(spark, sf):
    return names_.instance_order(view.catalog(spark, sf), "id").select("id", "family", "weight", "style").limit(50)


@query("SELECT CASE p_size % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE 'z' END AS source, count(*) AS labels, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS families FROM part GROUP BY 1")
def source_families(spark, sf):
    source = F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.col("p_size") % 3 + 1)
    found = names_.source_counts(load(spark, sf, "part").select(source.alias("source"), F.col("p_type").alias("family")))
    return found.select("source", "labels", F.array_join("families", ",").alias("families"))


@query("""WITH l AS (SELECT DISTINCT substr(p_name, 3, 9) AS label FROM part), f AS (SELECT DISTINCT p_name AS family FROM part),
m AS (SELECT label, family FROM l JOIN f ON contains(regexp_replace(lower(family), '[^a-z0-9]+', '', 'g'), substr(regexp_replace(lower(label), '[^a-z0-9]+', '', 'g'), 1, 4)) WHERE regexp_replace(lower(label), '[^a-z0-9]+', '', 'g') <> '')
SELECT label, array_to_string(list_sort(list(family))[1:4], ',') AS families FROM m GROUP BY 1""")
def nearest_families(spark, sf):
    part = load(spark, sf, "part")
    found = names_.nearest_families(part.select(F.substring("p_name", 3, 9).alias("label")), part.select(F.col("p_name").alias("family")))
    return found.select("label", F.array_join("families", ",").alias("families"))


@query("""SELECT event_type AS metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, min(v) AS low, max(v) AS high FROM (SELECT event_type, user_id % 8 AS seed, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2) GROUP BY 1""")
def seed_ensemble(spark, sf):
    each = load(spark, sf, "events").groupBy(F.col("event_type").alias("metric"), (F.col("user_id") % 8).alias("seed")).agg(F.count("*").cast("double").alias("value"))
    return E.seed_summary(each).select("metric", r6("mean").alias("mean"), r6("sd").alias("sd"), "low", "high")


@query("""WITH sets AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey),
met AS (SELECT a.l_orderkey, a.p_brand AS a, b.p_brand AS b FROM sets a JOIN sets b ON a.l_orderkey = b.l_orderkey AND a.p_brand < b.p_brand)
SELECT a, b, count(*) AS uses FROM met JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2 HAVING count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) > 0""")
def pairs_in_mediums(spark, sf):
    from .queries import brand_sets

    medium = load(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("medium"))
    pairs = M.pair_rows(M.multi_rows(brand_sets(spark, sf), "l_orderkey", "p_brand"), "l_orderkey", "p_brand").join(medium, "l_orderkey")
    return M.in_mediums(M.uses(pairs, "medium"), ("1-URGENT", "2-HIGH")).select("a", "b", "uses")


@query(f"""WITH {LABELS}, c AS (SELECT DISTINCT p_brand AS family FROM part), n AS (SELECT heading, substr(partner, 1, 7) AS partner FROM labels_), k AS (SELECT * FROM n WHERE heading <> 'Brand#3' AND NOT (heading = 'Brand#4' AND partner = 'Brand#5')),
s AS (SELECT DISTINCT heading AS label FROM k UNION SELECT DISTINCT partner FROM k), z AS (SELECT label, family, lower(replace(label, '#', '')) AS x, lower(replace(family, '#', '')) AS y FROM s, c),
m AS (SELECT label, family FROM (SELECT *, max(CAST(x = y AS INT)) OVER (PARTITION BY label) AS any_exact FROM z WHERE starts_with(x, y) OR starts_with(y, x)) WHERE x = y OR any_exact = 0),
h AS (SELECT label AS heading, min(family) AS h_family FROM m GROUP BY 1)
SELECT DISTINCT h_family, m.family AS p_family FROM k JOIN h USING (heading) JOIN m ON m.label = k.partner WHERE h_family <> m.family""")
def resolved_labels(spark, sf):
    from .queries import brand_labels

    labels = brand_labels(spark, sf).select("heading", F.substring("partner", 1, 7).alias("partner"))
    dropped = spark.createDataFrame([("Brand#3", None), ("Brand#4", "Brand#5")], "heading string, partner string")
    names = labels.select(F.col("heading").alias("label")).unionByName(labels.select(F.col("partner").alias("label"))).distinct()
    matches = C.match_families(names, load(spark, sf, "part").select(F.col("p_brand").alias("family")))
    return M.resolve_labels(labels, dropped, matches)[0]


@query(f"""WITH {CORPUS}, a AS (SELECT id, unit[1:3] AS q FROM corpus WHERE source = 'google'), b AS (SELECT id, unit[1:3] AS q FROM corpus WHERE source = 'local')
SELECT 'dim' AS check, CAST(d AS VARCHAR) AS found FROM (SELECT DISTINCT len(q) AS d FROM b) WHERE d NOT IN (SELECT len(q) FROM a) UNION ALL SELECT 'rows', CAST(count(*) AS VARCHAR) FROM b""")
def merge_checks(spark, sf):
    c = view.corpus(spark, sf).select("id", "source", F.slice("unit", 1, 3).alias("q"))
    bad = I.unlike_dims(c.where("source = 'google'"), c.where("source = 'local'"), "q")
    rows = c.where("source = 'local'").agg(F.count("*").cast("string").alias("found")).select(F.lit("rows").alias("check"), "found")
    return bad.select(F.lit("dim").alias("check"), F.col("dim").cast("string").alias("found")).unionByName(rows)


# --- pages ------------------------------------------------------------------------------------------------------

PAGE = """page AS (SELECT p_partkey, '<h2 class="a">' || CAST(p_size AS VARCHAR) || '. <b>' || p_name || '</b> &amp; ' || p_type || '</h2><h3>' || CAST(p_size AS VARCHAR) || ' Best: ' || p_type || ' + ' || p_name
  || '</h3><li>' || upper(p_name) || ' + ' || p_type || '</li><td><strong>' || p_name || ' and ' || p_brand || '</strong></td> <td>x</td><td>' || CASE WHEN p_size % 2 = 0 THEN 'Body Text + Headings' ELSE 'Headings, Body Text' END
  || '</td><a href="https://fonts.googleapis.com/css2?family=' || replace(p_name, ' ', '+') || ':wght@400&family=' || p_type || CASE WHEN p_size % 5 = 0 THEN '&family=Third' ELSE '' END || '">s</a>'
  || '<div class="card"><p style="font-family: ''' || p_name || '''">a</p><p style="font-family: ''' || p_type || '''">b</p></div></div>' AS html FROM part)"""


def page(spark, sf) -> DataFrame:
    name, kind, size = F.col("p_name"), F.col("p_type"), F.col("p_size").cast("string")
    parts = [
        F.lit('<h2 class="a">'), size, F.lit(". <b>"), name, F.lit("</b> &amp; "), kind, F.lit("</h2><h3>"), size, F.lit(" Best: "), kind, F.lit(" + "), name, F.lit("</h3><li>"), F.upper(name), F.lit(" + "), kind,
        F.lit("</li><td><strong>"), name, F.lit(" and "), F.col("p_brand"), F.lit("</strong></td> <td>x</td><td>"), F.when(F.col("p_size") % 2 == 0, "Body Text + Headings").otherwise("Headings, Body Text"),
        F.lit('</td><a href="https://fonts.googleapis.com/css2?family='), F.replace(name, F.lit(" "), F.lit("+")), F.lit(":wght@400&family="), kind, F.when(F.col("p_size") % 5 == 0, "&family=Third").otherwise(""),
        F.lit('">s</a><div class="card"><p style="font-family: \''), name, F.lit("'\">a</p><p style=\"font-family: '"), kind, F.lit("'\">b</p></div></div>"),
    ]
    return load(spark, sf, "part").select("p_partkey", F.concat(*parts).alias("html"))


@query("""SELECT p_partkey, 'numbered' AS miner, p_name AS heading, p_type AS partner FROM part UNION ALL SELECT p_partkey, 'titled', p_type, p_name FROM part
UNION ALL SELECT p_partkey, 'joined', upper(p_name), p_type FROM part UNION ALL SELECT p_partkey, 'joined', 'Body Text', 'Headings' FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 'role', CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_name END, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand END FROM part
UNION ALL SELECT p_partkey, 'stylesheet', p_name, p_type FROM part WHERE p_size % 5 <> 0 UNION ALL SELECT p_partkey, 'card', p_name, p_type FROM part""")
def page_pairs(spark, sf):
    """Every miner over the same pages: each finds the pairs that were written in its own way and no others."""
    html = page(spark, sf)
    found = {
        "numbered": G.element_pairs(html, "html", ("h2", "h3"), G.NUMBERED), "titled": G.element_pairs(html, "html", ("h2", "h3"), G.TITLED), "joined": G.element_pairs(html, "html", ("td", "h2", "h3", "h4", "strong", "li"), G.JOINED, 90),
        "role": G.role_pairs(html, "html"), "stylesheet": G.stylesheet_pairs(html, "html"), "card": G.card_pairs(html, "html", r'(?s)<div class="card.{0,400}?</div></div>'),
    }
    rows = [df.select("p_partkey", F.lit(miner).alias("miner"), "heading", "partner") for miner, df in found.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


@query("""SELECT p_partkey, 'rule' AS miner, p_name AS heading, p_type AS partner FROM part WHERE p_size % 3 <> 0 UNION ALL SELECT p_partkey, 'registry', p_name, p_type FROM part
UNION ALL SELECT p_partkey, 'bundle', p_brand, p_type FROM part UNION ALL SELECT p_partkey, 'api', p_type, p_brand FROM part WHERE p_size % 4 <> 0""")
def bundle_pairs(spark, sf):
    """Scoped style rules, a script's registry and pairs of ids, named pairs in a script, and records of an API."""
    part, name, kind = load(spark, sf, "part"), F.col("p_name"), F.col("p_type")
    q = F.lit('"')
    sheet = F.concat(F.lit("#day .firstfont { color: red; font-family: '"), name, F.lit("', serif; }\n#day .firstfont { font-family: Late; }"), F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("#day  .secondfont {font-family:"), kind, F.lit("}"))).otherwise(""), F.lit("#other .secondfont{font-family:Lone}"))
    script = F.concat(F.lit('x={"f-1":{id:"f-1",family:"'), name, F.lit('"},f_2:{id:"f_2",family:"Early"},f_2:{id:"f_2",family:"'), kind, F.lit('"}};P=[{id:"a",headingFontId:"f-1",bodyFontId:"f_2"},{id:"b",headingFontId:"f-1",bodyFontId:"none"}]'))
    objects = F.concat(F.lit('e.exports=[{heading:\\"'), F.col("p_brand"), F.lit('\\",body:\\"'), kind, F.lit('\\"}]'))
    answer = F.concat(F.lit('{"results":[{"heading_font_family":"'), kind, F.lit('","body_font_family":'), F.when(F.col("p_size") % 4 != 0, F.concat(q, F.col("p_brand"), q)).otherwise("null"), F.lit('}],"count":1}'))
    text = lambda x: part.select("p_partkey", x.alias("body"))
    found = {"rule": G.rule_pairs(text(sheet), "body"), "registry": G.registry_pairs(text(script), "body"), "bundle": G.bundle_pairs(text(objects), "body"), "api": G.api_pairs(text(answer), "body")}
    out = None
    for miner, df in found.items():
        rows = df.select("p_partkey", F.lit(miner).alias("miner"), "heading", "partner")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""SELECT h.p_name AS heading, b.p_name AS partner, CASE WHEN l.l_linenumber % 2 = 0 THEN 'community' ELSE 'curated' END AS tag FROM lineitem l JOIN part h ON h.p_partkey = l.l_partkey JOIN part b ON b.p_partkey = l.l_suppkey WHERE h.p_type = 'ECONOMY' AND b.p_type = 'ECONOMY'""")
def keyed_pairs(spark, sf):
    """Pairs of ids that a table of fonts names; both fonts must be of the wanted kind."""
    fonts = load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"))
    pairs = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("heading_id"), F.col("l_suppkey").alias("body_id"), (F.col("l_linenumber") % 2 == 0).alias("community"))
    return G.keyed_pairs(pairs, fonts, "ECONOMY")


_QUALIFIED = ("", "Condensed", "X-Wide", "Odd", "X", "MonoItalic")


@query("""WITH f AS (SELECT p_partkey, p_size, 'Some Folder' AS folder, CASE p_size % 4 WHEN 0 THEN ['.', ' ' || p_name || ' '] WHEN 1 THEN [p_name] WHEN 2 THEN ['', '--'] ELSE [NULL, 'É'] END AS records,
  replace(p_name, ' ', '') || ['', 'Condensed', 'X-Wide', 'Odd', 'X', 'MonoItalic'][p_size % 6 + 1] || '-Bold' AS stem, p_size % 7 = 0 AS fixed, p_size % 5 AS kind, p_size % 16 AS serif FROM part)
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN trim(records[2]) WHEN 1 THEN records[1] WHEN 2 THEN folder ELSE 'É' END AS family,
CASE WHEN p_size % 4 NOT IN (0, 1) THEN NULL ELSE CASE p_size % 6 WHEN 1 THEN 'Condensed' WHEN 2 THEN 'X Wide' WHEN 5 THEN 'Mono' END END AS qualifier,
CASE WHEN fixed THEN 'monospace' WHEN kind = 2 AND serif BETWEEN 2 AND 10 THEN 'serif' ELSE 'sans-serif' END AS category FROM f""")
def file_identity(spark, sf):
    """Family, qualifier and category of faces from name records, folders, file names and classification bytes."""
    size, name = F.col("p_size"), F.col("p_name")
    records = F.when(size % 4 == 0, F.array(F.lit("."), F.concat(F.lit(" "), name, F.lit(" ")))).when(size % 4 == 1, F.array(name)).when(size % 4 == 2, F.array(F.lit(""), F.lit("--"))).otherwise(F.array(F.lit(None).cast("string"), F.lit("É")))
    words = F.split(name, " ")
    said = F.element_at(F.array(*[F.lit(q) for q in _QUALIFIED]), size % 6 + 1)
    stem = F.concat(F.array_join(F.transform(words, lambda w: F.initcap(w)), ""), said, F.lit("-Bold"))
    rows = load(spark, sf, "part").withColumns({"family": T.family_name(records, F.lit("Some Folder"), stem), "stem": stem})
    qualifier = T.file_qualifier(F.col("family"), F.col("stem"), ("condensed", "wide", "mono", "x"), ("bold", "italic"))
    return rows.select("p_partkey", "family", qualifier.alias("qualifier"), T.category_guess((size % 7 == 0).cast("int"), size % 5, size % 16).alias("category"))
