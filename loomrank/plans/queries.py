"""Registered queries over the driver tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..functions import vectors as V
from ..operators import corpus as C
from ..operators import evaluate as E
from ..operators import graph as G
from ..operators import integrity as I
from ..operators import joint as J
from ..operators import learn as L
from ..operators import mining as M
from ..operators import names as names_
from ..operators import neighbours as N
from ..operators import nulls as U
from ..operators import pairing as P
from ..operators.stages import kept
from ..sources import textproto
from . import view
from .view import CATALOG, CORPUS, PAIRS, ROLE, load

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def r6(c):
    return F.round(c, 6)


# --- scores and ranks -------------------------------------------------------------------------------------


@query(f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY h_id ORDER BY contrast DESC, id) AS rank FROM pairs)
SELECT h_id, id, round(contrast, 6) AS contrast, rank FROM r WHERE rank <= 10""")
def contrast_top10(spark, sf):
    top = P.ranked(view.pairs(spark, sf), "contrast").where("rank <= 10")
    return top.select("h_id", "id", r6("contrast").alias("contrast"), "rank")


@query(f"WITH {PAIRS} SELECT h_id, id, round(p * n, 6) AS product, round(least(p, n), 6) AS smaller, round(2 * least(p, n), 6) AS balanced FROM pairs")
def contrast_forms(spark, sf):
    p, n = F.col("p"), F.col("n")
    return view.pairs(spark, sf).select("h_id", "id", *[r6(V.percentile_form(p, n, form)).alias(name) for form, name in (("product", "product"), ("min", "smaller"), ("balanced", "balanced"))])


@query(f"""WITH {CORPUS}, s AS (SELECT id, unit, list_max(list_transform(unit, lambda x: abs(x))) AS top FROM corpus),
q AS (SELECT id, unit, CASE WHEN top = 0 THEN 1 ELSE top END AS scale FROM s),
b AS (SELECT id, unit, scale, list_transform(unit, lambda x: CAST(round_even(x / scale * 127, 0) AS DOUBLE)) AS q FROM q)
SELECT id, round(scale, 6) AS scale, CAST(list_sum(q) AS BIGINT) AS checksum, round(list_max(list_transform(list_zip(q, unit), lambda z: abs(z[1] * (scale / 127) - z[2]))), 6) AS worst FROM b""")
def quantize_roundtrip(spark, sf):
    df = view.corpus(spark, sf).select("id", "unit").withColumn("scale", V.quantize_scale(F.col("unit")))
    df = df.withColumn("q", V.quantize(F.col("unit"), F.col("scale")))
    worst = F.array_max(F.zip_with(V.dequantize(F.col("q"), F.col("scale")), F.col("unit"), lambda a, b: F.abs(a - b)))
    df = df.withColumn("worst", worst)  # before the rounded scale takes the name
    return df.select("id", r6("scale").alias("scale"), F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x.cast("long")).alias("checksum"), r6("worst").alias("worst"))


@query(f"""WITH {PAIRS}, g AS (SELECT h_id, id, list_transform(list_zip(h_unit, unit), lambda z: abs(z[1] - z[2])) AS gaps FROM pairs)
SELECT h_id, id, round(list_sum(list_sort(gaps, 'DESC')[1:5]) / (list_sum(gaps) + CAST(1e-9 AS DOUBLE)), 6) AS concentration FROM g""")
def concentration_top5(spark, sf):
    return view.pairs(spark, sf).select("h_id", "id", r6(V.concentration(F.col("h_unit"), F.col("unit"))).alias("concentration"))


@query(f"WITH {CORPUS} SELECT family, id, weight, style FROM canonical")
def canonical_instance(spark, sf):
    return C.canonical(view.corpus(spark, sf)).select("family", "id", "weight", "style")


@query(f"WITH {CORPUS} SELECT h.family AS h_family, count(*) AS pool FROM canonical h JOIN corpus c ON h.family <> c.family WHERE c.eligible GROUP BY 1")
def eligible_pool(spark, sf):
    c = view.corpus(spark, sf).drop("unit")
    return C.pool(C.canonical(c), c).groupBy("h_family").agg(F.count("*").alias("pool"))


@query(f"""WITH {ROLE}, r AS (SELECT h_id, id, body_score, row_number() OVER (PARTITION BY h_id ORDER BY body_score DESC, id) AS rank FROM scored WHERE weight BETWEEN 300 AND 700)
SELECT h_id, id, round(body_score, 6) AS score, rank FROM r WHERE rank <= 40""")
def role_score_rank(spark, sf):
    df = view.role_pairs(spark, sf).withColumn("score", P.role_score("body")).where(C.body_suitable(F.col("weight")))
    return P.ranked(df, "score").where(F.col("rank") <= K.BODY_CUT).select("h_id", "id", r6("score").alias("score"), "rank")


@query(f"""WITH {PAIRS}, f AS (SELECT h_id, id, weight <= h_weight AS ok, max(CAST(weight <= h_weight AS INT)) OVER (PARTITION BY h_id) AS any_ok FROM pairs)
SELECT h_id, count(*) AS kept, min(id) AS first_id FROM f WHERE ok OR any_ok = 0 GROUP BY 1""")
def stroke_order_guard(spark, sf):
    c = view.corpus(spark, sf).drop("unit")
    return C.stroke_guard(C.pool(C.canonical(c), c)).groupBy("h_id").agg(F.count("*").alias("kept"), F.min("id").alias("first_id"))


@query(f"""WITH {ROLE}, f AS (SELECT h_id, h_family, family, max(head_score) AS score FROM scored GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY h_id ORDER BY score DESC, family) AS rank FROM f)
SELECT h_family, family, round(score, 6) AS score, rank FROM r""")
def family_level_rank(spark, sf):
    df = view.role_pairs(spark, sf).withColumn("score", P.role_score("head"))
    return P.ranked(P.best_cut_per_family(df, "score"), "score", tie="family").select("h_family", "family", r6("score").alias("score"), "rank")


@query(f"""WITH {ROLE}, c AS (
  SELECT h_id, id, 't0' AS candidate, cn AS score FROM scored UNION ALL SELECT h_id, id, 't1', cn - cos FROM scored UNION ALL SELECT h_id, id, 'tm', cn + CAST(0.5 AS DOUBLE) * cos FROM scored
  UNION ALL SELECT h_id, id, 'role', head_score FROM scored UNION ALL SELECT h_id, id, 'hand', cn + CAST(0.5 AS DOUBLE) * coalesce(legibility, 0) + CAST(0.2 AS DOUBLE) * serif_split * gate FROM scored),
r AS (SELECT *, row_number() OVER (PARTITION BY candidate, h_id ORDER BY score DESC, id) AS rank FROM c)
SELECT candidate, h_id, id, rank FROM r WHERE rank <= 10""")
def candidate_sweep(spark, sf):
    candidates = {"t0": P.pair_score(0.0), "t1": P.pair_score(1.0), "tm": P.pair_score(-0.5), "role": P.role_score("head"), "hand": P.hand_score()}
    return P.swept(view.role_pairs(spark, sf), candidates).where("rank <= 10").select("candidate", "h_id", "id", "rank")


# --- labels for evaluation: the brands most often bought together ------------------------------------------

LABELS = """
sets AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey),
bought AS (SELECT a.p_brand AS a, b.p_brand AS b, count(*) AS uses FROM sets a JOIN sets b ON a.l_orderkey = b.l_orderkey AND a.p_brand < b.p_brand GROUP BY 1, 2),
both_ways AS (SELECT a AS heading, b AS partner, uses FROM bought UNION ALL SELECT b, a, uses FROM bought),
labels_ AS (SELECT heading, partner FROM (SELECT *, row_number() OVER (PARTITION BY heading ORDER BY uses DESC, partner) AS rn FROM both_ways) WHERE rn <= 3)"""


def brand_sets(spark, sf) -> DataFrame:
    part = load(spark, sf, "part").select("p_partkey", "p_brand")
    return load(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand")


def brand_labels(spark, sf) -> DataFrame:
    """(heading, partner) families: each brand's three most frequent companions."""
    counted = M.symmetric(M.uses(M.pair_rows(brand_sets(spark, sf).distinct(), "l_orderkey", "p_brand")))
    order = Window.partitionBy("heading").orderBy(F.desc("uses"), "partner")
    return counted.withColumn("_r", F.row_number().over(order)).where("_r <= 3").select("heading", "partner")


def label_ids(spark, sf) -> DataFrame:
    """(h_id, partner): ids of the labelled headings and of their partners' canonical cuts."""
    heads = C.canonical(view.catalog(spark, sf).join(load(spark, sf, "embeddings").select(F.col("vec_id").alias("id")), "id", "left_semi")).select("family", "id")
    named = brand_labels(spark, sf).join(heads.select(F.col("family").alias("heading"), F.col("id").alias("h_id")), "heading")
    return named.join(heads.select(F.col("family").alias("partner"), F.col("id").alias("p_id")), "partner").select("h_id", F.col("p_id").alias("partner"))


def label_ranks(spark, sf, score=None) -> DataFrame:
    scores = view.role_pairs(spark, sf).select("h_id", "id", (P.role_score("head") if score is None else score).alias("score"))
    return E.ranks_by_count(scores, label_ids(spark, sf))


RANKS = ROLE + "," + LABELS + """,
ranked AS (SELECT h_id, id, row_number() OVER (PARTITION BY h_id ORDER BY head_score DESC, id) AS rank, row_number() OVER (PARTITION BY h_id ORDER BY cn DESC, id) AS plain_rank, count(*) OVER (PARTITION BY h_id) AS pool FROM scored),
ranks AS (SELECT h.id AS h_id, p.id AS partner, r.rank, r.plain_rank FROM labels_ l JOIN canonical h ON h.family = l.heading JOIN canonical p ON p.family = l.partner JOIN ranked r ON r.h_id = h.id AND r.id = p.id),
heads AS (SELECT h_id, count(*) AS n, min(rank) AS best, min(plain_rank) AS plain_best, count(*) FILTER (rank <= 100) AS hits,
  coalesce(sum(1 / log2(rank + CAST(1 AS DOUBLE))) FILTER (rank <= 100), 0) AS dcg, list_sum(list_transform(range(1, least(count(*), 100) + 1), lambda p: 1 / log2(p + CAST(1 AS DOUBLE)))) AS idcg FROM ranks GROUP BY 1)"""


@query(f"WITH {RANKS} SELECT h_id, partner, rank FROM ranks")
def partner_ranks(spark, sf):
    return label_ranks(spark, sf).select("h_id", "partner", "rank")


@query(f"WITH {RANKS} SELECT k, count(*) FILTER (best <= k) AS hit FROM heads, (VALUES (10), (50), (100)) t(k) GROUP BY k")
def hit_at_k(spark, sf):
    heads = E.per_heading(label_ranks(spark, sf), 100)
    row = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.when(F.col("best") <= k, 1).otherwise(0).alias("h")) for k in (10, 50, 100)])).alias("x")
    return heads.select(row).groupBy(F.col("x.k").alias("k")).agg(F.sum("x.h").alias("hit"))


@query(f"WITH {RANKS} SELECT round(avg(hits / n), 6) AS recall, round(avg(dcg / idcg), 6) AS ndcg FROM heads")
def recall_and_ndcg(spark, sf):
    return E.summary(E.per_heading(label_ranks(spark, sf), 100), 100, medians=False).select("recall", "ndcg")


@query(f"WITH {RANKS} SELECT list_sort(list(best))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median_upper, CAST(trunc(median(best)) AS INTEGER) AS median_true, count(*) AS headings FROM heads")
def median_rank(spark, sf):
    return E.summary(E.per_heading(label_ranks(spark, sf), 100), 100).select("median_upper", "median_true", "headings")


@query(f"WITH {RANKS} SELECT h_id, CASE WHEN plain_best <= 50 THEN 'break' ELSE 'fix' END AS change FROM heads WHERE (plain_best <= 50) <> (best <= 50)")
def breaks_and_fixes(spark, sf):
    plain = E.per_heading(label_ranks(spark, sf, P.pair_score()), 50)
    return E.breaks_and_fixes(plain, E.per_heading(label_ranks(spark, sf), 50), 50)


@query(f"WITH {RANKS}, f AS (SELECT *, (row_number() OVER (ORDER BY h_id) - 1) % 2 AS fold FROM heads) SELECT fold, count(*) AS headings, count(*) FILTER (best <= 50) AS hit FROM f GROUP BY 1")
def even_odd_split(spark, sf):
    heads = E.folds(kept(E.per_heading(label_ranks(spark, sf), 50)))
    return heads.groupBy("fold").agg(F.count("*").alias("headings"), F.count_if(F.col("best") <= 50).alias("hit"))


@query(f"""WITH {RANKS}, s AS (SELECT round(s.cos, 9) AS score, CASE WHEN l.heading IS NULL THEN 0 ELSE 1 END AS label FROM scored s JOIN canonical c ON c.id = s.id LEFT JOIN labels_ l ON l.heading = s.h_family AND l.partner = s.family),
m AS (SELECT count(*) FILTER (label = 1) AS real, count(*) FILTER (label = 0) AS nulls, avg(score) FILTER (label = 1) AS rm, avg(score) FILTER (label = 0) AS nm, stddev_pop(score) FILTER (label = 0) AS sd FROM s),
w AS (SELECT sum(CASE WHEN a.score > b.score THEN CAST(1 AS DOUBLE) WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS w FROM s a, s b WHERE a.label = 1 AND b.label = 0)
SELECT real, nulls, round((rm - nm) / sd, 6) AS z, round(w / (real * nulls), 6) AS auc FROM m, w""")
def null_z_and_auc(spark, sf):
    pairs = view.pairs(spark, sf)
    canon = C.canonical(view.corpus(spark, sf)).select("id")
    labels = brand_labels(spark, sf).select(F.col("heading").alias("h_family"), F.col("partner").alias("family"), F.lit(1).alias("label"))
    scores = pairs.join(canon, "id", "left_semi").select("h_family", "family", F.round("cos", 9).alias("score")).join(labels, ["h_family", "family"], "left")
    return E.z_and_auc(scores.select("score", F.coalesce("label", F.lit(0)).alias("label")))


def draw_sql(place: str, n: str) -> str:
    """The generator's draw at a place of its sequence in SQL."""
    times = lambda x, y: f"((({x}) * (({y}) & 65535) + ((((({x}) * (({y}) >> 16)) & 65535)) << 16)) & 4294967295)"
    return f"""(SELECT ((xor(u, u >> 14) * ({n})) >> 32) FROM (SELECT xor((t + {times('xor(t, t >> 7)', 't | 61')}) & 4294967295, t) AS u FROM (SELECT {times('xor(s, s >> 15)', 's | 1')} AS t FROM (SELECT ((CAST({place} AS BIGINT) + 1) * 1831565813) & 4294967295 AS s))))"""


@query(f"""WITH {CORPUS}, pool AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS at FROM corpus WHERE eligible), n AS (SELECT count(*) AS n FROM pool),
d AS (SELECT i, n, {draw_sql('3 * i', 'n')} AS x, {draw_sql('3 * i + 1', 'n')} AS y, {draw_sql('3 * i + 2', 'n - 1')} AS z FROM range(20000) t(i), n),
e AS (SELECT i, x, CASE WHEN x <> y THEN y ELSE (x + 1 + z) % n END AS y FROM d)
SELECT i AS draw, a.id AS a, b.id AS b FROM e JOIN pool a ON a.at = e.x JOIN pool b ON b.at = e.y""")
def uniform_null_pairs(spark, sf):
    return U.uniform_pairs(view.corpus(spark, sf).where("eligible"), 20_000)


# --- mining -------------------------------------------------------------------------------------------------

SETS = """sets AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey),
many AS (SELECT * FROM sets WHERE l_orderkey IN (SELECT l_orderkey FROM sets GROUP BY 1 HAVING count(*) >= 2)),
met AS (SELECT a.l_orderkey, a.p_brand AS a, b.p_brand AS b FROM many a JOIN many b ON a.l_orderkey = b.l_orderkey AND a.p_brand < b.p_brand),
counted AS (SELECT a, b, count(*) AS uses FROM met GROUP BY 1, 2), supports AS (SELECT p_brand, count(*) AS support FROM many GROUP BY 1), total AS (SELECT count(DISTINCT l_orderkey) AS n FROM many),
lifted AS (SELECT a, b, uses, floor(uses * CAST(n AS DOUBLE) / (x.support * y.support) * 100 + 0.5) / 100 AS lift FROM counted JOIN supports x ON x.p_brand = a JOIN supports y ON y.p_brand = b, total)"""


def lifted(spark, sf) -> DataFrame:
    sets = M.multi_rows(brand_sets(spark, sf), "l_orderkey", "p_brand")
    n = sets.select("l_orderkey").distinct().count()
    return M.lift(M.uses(M.pair_rows(sets, "l_orderkey", "p_brand")), M.support(sets, "p_brand"), "p_brand", n)


@query(f"WITH {SETS} SELECT p_brand, support FROM supports")
def brand_support(spark, sf):
    return M.support(M.multi_rows(brand_sets(spark, sf), "l_orderkey", "p_brand"), "p_brand")


@query(f"WITH {SETS} SELECT a, b, uses FROM counted")
def pair_uses(spark, sf):
    return M.uses(M.pair_rows(M.multi_rows(brand_sets(spark, sf), "l_orderkey", "p_brand"), "l_orderkey", "p_brand"))


@query(f"WITH {SETS} SELECT a, b, uses, lift FROM lifted")
def pair_lift(spark, sf):
    return lifted(spark, sf)


@query(f"""WITH {SETS} SELECT a, b, count(*) AS uses, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM met JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def pair_mediums(spark, sf):
    medium = load(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("medium"))
    pairs = M.pair_rows(M.multi_rows(brand_sets(spark, sf), "l_orderkey", "p_brand"), "l_orderkey", "p_brand").join(medium, "l_orderkey")
    at = lambda m: F.coalesce(F.try_element_at("mediums", F.lit(m)), F.lit(0).cast("long"))
    return M.uses(pairs, "medium").select("a", "b", "uses", at("1-URGENT").alias("urgent"), at("5-LOW").alias("low"))


@query(f"WITH {SETS} SELECT a AS heading, b AS partner, uses FROM counted UNION ALL SELECT b, a, uses FROM counted")
def pair_symmetric(spark, sf):
    return M.symmetric(pair_uses(spark, sf))


@query(f"WITH {SETS} SELECT a, b, uses, lift FROM lifted WHERE uses >= 2 AND lift >= 1.05 AND substr(a, 1, 7) <> substr(b, 1, 7)")
def pair_refined(spark, sf):
    kin = F.substring("a", 1, 7) == F.substring("b", 1, 7)
    return M.refined(lifted(spark, sf).withColumn("kin", kin), 2, 1.05).select("a", "b", "uses", "lift")


@query("""WITH e AS (SELECT DISTINCT p_brand AS heading, p_type AS partner, CASE p_size % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE 'z' END AS source FROM part),
p AS (SELECT heading, partner, list_sort(list(source)) AS sources FROM e GROUP BY 1, 2),
g AS (SELECT heading, count(*) AS n, string_agg(partner || ':' || array_to_string(sources, '+'), ',' ORDER BY partner) AS partners FROM p GROUP BY 1)
SELECT heading, n, partners FROM g WHERE n >= 2""")
def partners_having(spark, sf):
    source = F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.col("p_size") % 3 + 1)
    labels = load(spark, sf, "part").select(F.col("p_brand").alias("heading"), F.col("p_type").alias("partner"), source.alias("source"))
    text = F.array_join(F.transform("partners", lambda p: F.concat(p["family"], F.lit(":"), F.array_join(p["sources"], "+"))), ",")
    return M.grouped(labels, 2).select("heading", F.size("partners").cast("long").alias("n"), text.alias("partners"))


@query("""WITH e AS (SELECT p_brand AS heading, p_type AS partner, p_size % 3 AS so FROM part), f AS (SELECT heading, partner, min(so) AS so FROM e GROUP BY 1, 2)
SELECT CASE e.so WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE 'z' END AS source, count(DISTINCT e.heading || '|' || e.partner) AS pairs, (SELECT count(*) FROM f WHERE f.so = e.so) AS added FROM e GROUP BY e.so""")
def source_yield(spark, sf):
    source = F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.col("p_size") % 3 + 1)
    labels = load(spark, sf, "part").select(F.col("p_brand").alias("heading"), F.col("p_type").alias("partner"), source.alias("source"), (F.col("p_size") % 3).alias("source_order"))
    return M.source_yield(labels)


@query(f"""WITH {LABELS}, u AS (SELECT heading, partner FROM labels_ UNION SELECT p_brand, 'Brand#' || CAST(1 + p_size % 25 AS VARCHAR) FROM part)
SELECT heading, string_agg(partner, ',' ORDER BY partner) AS partners FROM u WHERE heading <> partner GROUP BY 1""")
def pair_graph_union(spark, sf):
    more = load(spark, sf, "part").select(F.col("p_brand").alias("heading"), F.concat(F.lit("Brand#"), (1 + F.col("p_size") % 25).cast("string")).alias("partner"))
    return M.union_graph(brand_labels(spark, sf), more).select("heading", F.array_join("partners", ",").alias("partners"))


@query("SELECT event_type AS name, count(*) AS n FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY 1 ORDER BY n DESC, name LIMIT 25")
def unresolved_top(spark, sf):
    known = spark.createDataFrame([("view",), ("click",)], "name string")
    return M.unresolved(load(spark, sf, "events").select(F.col("event_type").alias("name")), known)


CUT = "(?i)^((ultra|extra|semi)-+)?(thin|light|regular|medium|bold|black|heavy|book|demi|italic|roman)$"

TRIES = f"""w AS (SELECT name, string_split(s, ' ') AS w FROM c WHERE s <> ''),
t AS (SELECT name, w, unnest(range(0, len(w))) AS cut FROM w),
tries AS (SELECT name, cut, array_to_string(w[1:len(w) - cut], ' ') AS try FROM t WHERE len(list_filter(w[len(w) - cut + 1:], lambda x: NOT regexp_matches(x, '{CUT}'))) = 0)"""

_SUFFIXES = (" Bold", " Semi-Bold  Italic.", "", " Wide", " Ultra-Light Demi", " &amp; Roman", " BOOK!", " SemiBold")


@query(f"""WITH n AS (SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN upper(p_name) ELSE p_name END || [{', '.join(repr(x) for x in _SUFFIXES)}][p_size % 8 + 1] AS name FROM part UNION SELECT 'Source Sans Pro Black'),
k AS (SELECT DISTINCT p_name AS family FROM part UNION SELECT 'red & gear'), l AS (SELECT lower(family) AS low, min(family) AS any_family FROM k GROUP BY 1), r AS (SELECT * FROM (VALUES ('Source Sans Pro', 'Source Sans 3'), ('Source Serif Pro', 'Source Serif 4')) r(alias, alias_family)),
c AS (SELECT name, trim(regexp_replace(regexp_replace(replace(replace(name, '&amp;', '&'), '&nbsp;', ' '), '\\s+', ' ', 'g'), '[.,;:!?]+$', '')) AS s FROM n), {TRIES},
h AS (SELECT name, cut, coalesce(alias_family, k.family, any_family) AS family FROM tries LEFT JOIN r ON alias = try LEFT JOIN k ON k.family = try LEFT JOIN l ON low = lower(try))
SELECT name, arg_min(family, cut) AS family FROM h WHERE family IS NOT NULL GROUP BY 1""")
def strip_qualifiers(spark, sf):
    part = load(spark, sf, "part")
    suffix = F.element_at(F.array(*[F.lit(x) for x in _SUFFIXES]), F.col("p_size") % 8 + 1)
    names = part.select(F.concat(F.when(F.col("p_size") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")), suffix).alias("name")).unionByName(spark.createDataFrame([("Source Sans Pro Black",)], "name string"))
    known = part.select(F.col("p_name").alias("family")).unionByName(spark.createDataFrame([("red & gear",)], "family string"))
    return names_.resolved(names, known)


@query(f"""WITH n AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN p_name || ' (Trial)  Book' WHEN 1 THEN 'Futura Extra-Bold' WHEN 2 THEN 'TIMES new roman' ELSE upper(p_name) || ' Roman;' END AS name FROM part),
k AS (SELECT DISTINCT p_name AS family FROM part UNION SELECT 'Jost'), l AS (SELECT lower(family) AS low, min(family) AS any_family FROM k GROUP BY 1),
r AS (SELECT * FROM (VALUES ('futura', 'Jost'), ('franklin gothic', 'Libre Franklin'), ('times new roman', 'Tinos'), ('times', 'Tinos'), ('arial', 'Arimo'), ('georgia', 'Gelasio'), ('bodoni', 'Bodoni Moda'), ('baskerville', 'Libre Baskerville'), ('courier', 'Courier Prime'), ('caslon', 'Libre Caslon Text'), ('adobe caslon', 'Libre Caslon Text')) r(alias, alias_family)),
c AS (SELECT name, trim(regexp_replace(regexp_replace(regexp_replace(name, '\\([^)]*\\)', ' ', 'g'), '\\s+', ' ', 'g'), '[.,;:!?]+$', '')) AS s FROM n), {TRIES},
h AS (SELECT name, cut, coalesce(k.family, any_family, x.family) AS family FROM tries LEFT JOIN k ON k.family = try LEFT JOIN l ON low = lower(try) LEFT JOIN r ON alias = lower(try) LEFT JOIN k x ON x.family = alias_family)
SELECT name, arg_min(family, cut) AS family FROM h WHERE family IS NOT NULL GROUP BY 1""")
def usage_names(spark, sf):
    part, size, name = load(spark, sf, "part"), F.col("p_size") % 4, F.col("p_name")
    raw = F.when(size == 0, F.concat(name, F.lit(" (Trial)  Book"))).when(size == 1, "Futura Extra-Bold").when(size == 2, "TIMES new roman").otherwise(F.concat(F.upper(name), F.lit(" Roman;")))
    known = part.select(name.alias("family")).unionByName(spark.createDataFrame([("Jost",)], "family string"))
    return names_.resolved(part.select(raw.alias("name")), known, usage=True)


# --- text ---------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' & ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS norm FROM part")
def slug_names(spark, sf):
    return load(spark, sf, "part").select("p_partkey", T.slug(F.concat_ws(" & ", "p_name", "p_type")).alias("slug"), T.plain(F.col("p_name")).alias("norm"))


@query(f"""WITH {CATALOG} SELECT id, family || ' ' || CAST(weight AS VARCHAR) || CASE WHEN style = 'italic' THEN ' Italic' ELSE '' END AS label,
replace(family, ' ', '+') || CASE WHEN weight % 200 = 0 THEN ':ital,wght@' || CASE WHEN style = 'italic' THEN '1' ELSE '0' END || ',' || CAST(weight AS VARCHAR) ELSE ':wght@' || CAST(weight AS VARCHAR) END AS css2 FROM catalog""")
def labels_and_css2(spark, sf):
    f, w, s = F.col("family"), F.col("weight"), F.col("style")
    return view.catalog(spark, sf).select("id", T.label_of(f, w, s).alias("label"), T.css2_fragment(f, w, s, w % 200 == 0).alias("css2"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '<h[1-3][^>]*>([^<]*)</h[1-3]>', 1)) AS heading FROM pages")
def html_headings(spark, sf):
    return load(spark, sf, "pages").select("page_id", F.explode(T.headings(F.col("html"))).alias("heading"))


@query("SELECT page_id, len(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS links, coalesce(list_min(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)), '') AS first_link FROM pages")
def html_links(spark, sf):
    found = T.links(F.col("html"))
    return load(spark, sf, "pages").select("page_id", F.size(found).cast("long").alias("links"), F.coalesce(F.array_min(found), F.lit("")).alias("first_link"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')) AS text_md5 FROM pages")
def strip_tags(spark, sf):
    return load(spark, sf, "pages").select("page_id", F.md5(T.strip_tags(F.col("html"))).alias("text_md5"))


@query("SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def props_json(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return load(spark, sf, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.countDistinct("user_id").alias("users"))


@query("""WITH l AS (SELECT DISTINCT substr(p_brand, 1, 7) AS label FROM part), f AS (SELECT DISTINCT p_brand AS family FROM part),
n AS (SELECT label, family, regexp_replace(lower(label), '[^a-z0-9]+', '', 'g') AS a, regexp_replace(lower(family), '[^a-z0-9]+', '', 'g') AS b FROM l, f),
m AS (SELECT *, a = b AS exact FROM n WHERE starts_with(a, b) OR starts_with(b, a)) SELECT label, family FROM (SELECT *, max(CAST(exact AS INT)) OVER (PARTITION BY label) AS any_exact FROM m) WHERE exact OR any_exact = 0""")
def norm_prefix_match(spark, sf):
    part = load(spark, sf, "part")
    return C.match_families(part.select(F.substring("p_brand", 1, 7).alias("label")), part.select(F.col("p_brand").alias("family")))


_CLASSES = "['sans', 'serif', 'mono', 'slab', 'display', 'text', 'gothic', 'grotesk', 'grotesque', 'condensed', 'expanded', 'narrow', 'rounded', 'sc', 'pro']"
_KINDS = ("", " Grotesk", " Mono", " Sans Pro", " gothic SC", " Narrow Deluxe", " Expanded")


@query(f"""WITH n AS (SELECT DISTINCT p_name || [{', '.join(repr(x) for x in _KINDS)}][p_size % 7 + 1] AS name, string_split(p_name, ' ')[1] AS first FROM part),
p AS (SELECT a.name AS a, b.name AS b, string_split(lower(a.name), ' ') AS x, string_split(lower(b.name), ' ') AS y FROM n a JOIN n b ON a.first = b.first AND a.name < b.name),
s AS (SELECT a, b, x, y, len(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[1:i] = y[1:i])) AS same FROM p)
SELECT a, b, same >= 1 AND len(list_filter(list_concat(x[same + 1:], y[same + 1:]), lambda t: NOT list_contains({_CLASSES}, t))) = 0 AS kin FROM s""")
def kin_pairs(spark, sf):
    kind = F.element_at(F.array(*[F.lit(x) for x in _KINDS]), F.col("p_size") % 7 + 1)
    names = load(spark, sf, "part").select(F.concat("p_name", kind).alias("a"), F.split("p_name", " ")[0].alias("first")).distinct()
    return names.join(names.withColumnRenamed("a", "b"), "first").where("a < b").select("a", "b", T.kin(F.col("a"), F.col("b")).alias("kin"))


# --- ingest and policy --------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT p_partkey, p_size % 2 = 0 AS variable, 200 + 100 * (p_size % 5) AS low, 500 + 100 * (p_size % 5) AS high, 400 AS weight, p_size % 3 = 0 AS has_italic FROM part),
w AS (SELECT *, CASE WHEN variable THEN list_filter([300, 400, 700, 900], lambda x: x BETWEEN low AND high) ELSE [400] END AS ws FROM f)
SELECT family, weight, style FROM (SELECT 'F' || CAST(p_partkey AS VARCHAR) AS family, unnest(ws) AS weight, has_italic FROM w) i, (VALUES ('normal'), ('italic')) s(style) WHERE style = 'normal' OR has_italic""")
def ladder_expand(spark, sf):
    size = F.col("p_size")
    families = load(spark, sf, "part").select(F.concat(F.lit("F"), F.col("p_partkey").cast("string")).alias("family"), (size % 2 == 0).alias("variable"), (200 + 100 * (size % 5)).alias("low"), (500 + 100 * (size % 5)).alias("high"), F.lit(400).alias("weight"), (size % 3 == 0).alias("has_italic"))
    return C.expand_ladder(families)


@query(f"""WITH {CATALOG}, served AS (SELECT DISTINCT family, weight, style FROM catalog WHERE source = 'local')
SELECT count(*) AS kept, (SELECT count(*) FROM catalog) - count(*) AS dropped FROM catalog c WHERE EXISTS (SELECT 1 FROM served s WHERE s.family = c.family AND s.weight = c.weight AND s.style = c.style)""")
def served_counts(spark, sf):
    cat = view.catalog(spark, sf)
    served = cat.where("source = 'local'").select("family", "weight", "style").distinct()
    marked = cat.join(served.withColumn("_s", F.lit(True)), ["family", "weight", "style"], "left")
    return marked.agg(F.count_if(F.col("_s").isNotNull()).alias("kept"), F.count_if(F.col("_s").isNull()).alias("dropped"))


@query("""WITH a AS (SELECT DISTINCT p_type AS family FROM part), b AS (SELECT DISTINCT c_mktsegment AS family FROM customer)
SELECT 'local_only' AS side, family FROM a WHERE family NOT IN (SELECT family FROM b) UNION ALL SELECT 'published_only', family FROM b WHERE family NOT IN (SELECT family FROM a)""")
def cross_check(spark, sf):
    return C.cross_check(load(spark, sf, "part").select(F.col("p_type").alias("family")), load(spark, sf, "customer").select(F.col("c_mktsegment").alias("family")))


@query("SELECT p_partkey, p_name AS family, lower(p_type) AS category, CAST(p_size AS BIGINT) AS weight, p_size % 2 = 0 AS variable FROM part")
def protobuf_roundtrip(spark, sf):
    name = F.concat(F.lit("part-"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, "[wght].ttf").otherwise(".ttf"))
    text = F.concat(F.lit('# made from a row\nname: "'), "p_name", F.lit('"\ncategory: '), "p_type", F.lit('\nfonts {\n  filename: "'), name, F.lit('"\n  weight: '), F.col("p_size").cast("string"), F.lit('\n  full_name: "a \\"b\\" {c}"\n}\nsubsets: "latin"\nsubsets: "menu"\n'))
    rows = textproto.normalize_family(textproto.parse_families(load(spark, sf, "part").select("p_partkey", text.alias("value")), carry=("p_partkey",)))
    return rows.select("p_partkey", "family", "category", F.col("fonts")[0]["weight"].cast("long").alias("weight"), "variable")


@query(f"WITH {CATALOG} SELECT category, count(*) AS rows, count(*) FILTER (eligible) AS eligible, count(xh) AS with_xh FROM catalog GROUP BY 1")
def category_histogram(spark, sf):
    return view.catalog(spark, sf).groupBy("category").agg(F.count("*").alias("rows"), F.count_if("eligible").alias("eligible"), F.count("xh").alias("with_xh"))


@query(f"WITH {CATALOG}, v AS (SELECT id, (row_number() OVER (ORDER BY xh, id) - 1) / greatest(count(*) OVER () - 1, 1) AS rank FROM catalog WHERE xh IS NOT NULL) SELECT id, round(rank, 6) AS rank FROM v UNION ALL SELECT id, NULL FROM catalog WHERE xh IS NULL")
def percent_rank_norm(spark, sf):
    return E.rank_normalized(view.catalog(spark, sf).select("id", "xh"), "xh", "id", "rank").select("id", r6("rank").alias("rank"))


@query(f"WITH {CATALOG} SELECT count(*) AS rows, count(DISTINCT id) AS ids, min(id) AS low, max(id) AS high, count(*) = count(DISTINCT id) AND min(id) = 0 AND max(id) = count(*) - 1 AS dense FROM catalog")
def ids_dense(spark, sf):
    return I.dense_ids(view.catalog(spark, sf))


@query(f"WITH {CATALOG} SELECT source, count(*) AS rows FROM catalog WHERE source NOT IN ('google') GROUP BY 1")
def allowlist_violations(spark, sf):
    return I.foreign_sources(view.catalog(spark, sf), ("google",))


@query("SELECT p_partkey, sha256(p_name || '|' || p_brand || '|' || CAST(p_size AS VARCHAR)) AS sha256 FROM part")
def content_hash(spark, sf):
    return I.content_hash(load(spark, sf, "part"), "p_partkey", "p_name", "p_brand", "p_size")


# --- neighbours ---------------------------------------------------------------------------------------------

NEAR = CORPUS + """,
sims AS (SELECT a.id, b.id AS near, list_sum(list_transform(list_zip(a.unit, b.unit), lambda z: z[1] * z[2])) AS cos, a.topic AS a_topic, b.topic AS b_topic FROM corpus a JOIN corpus b ON a.id <> b.id),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cos DESC, near) AS rank FROM sims) WHERE rank <= 20)"""


@query(f"WITH {NEAR} SELECT id, near, round(cos, 6) AS cos, rank FROM knn WHERE rank <= 5")
def cosine_topk(spark, sf):
    return N.knn(view.corpus(spark, sf), 5).select("id", "near", r6("cos").alias("cos"), "rank")


@query(f"WITH {NEAR} SELECT count(*) AS n, round(avg(CAST(a_topic = b_topic AS INT)), 6) AS share FROM knn WHERE rank = 1")
def knn_1nn_acc(spark, sf):
    c = view.corpus(spark, sf)
    return N.share_of_same(N.knn(c, 1), c, "topic", 1)


@query(f"WITH {NEAR}, s AS (SELECT id, sum(CAST(a_topic = b_topic AS INT)) / 10 AS share FROM knn WHERE rank <= 10 GROUP BY 1) SELECT count(*) AS n, round(avg(share), 6) AS share FROM s")
def knn_p_at_10(spark, sf):
    c = view.corpus(spark, sf)
    return N.share_of_same(N.knn(c, 10), c, "topic", 10)


@query(f"WITH {NEAR} SELECT id, round(avg(cos), 6) AS typicality FROM knn GROUP BY 1")
def typicality(spark, sf):
    return N.typicality(N.knn(view.corpus(spark, sf), K.TYPICAL_NEAR), K.TYPICAL_NEAR).select("id", r6("typicality").alias("typicality"))


HALVES = """
v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
h AS (SELECT id, v[1:32] AS a, v[33:64] AS b FROM v),
l AS (SELECT id, a, b, sqrt(list_sum(list_transform(a, lambda x: x * x))) AS na, sqrt(list_sum(list_transform(b, lambda x: x * x))) AS nb FROM h),
u AS (SELECT id, list_transform(a, lambda x: x / na) AS a, list_transform(b, lambda x: x / nb) AS b FROM l),
s AS (SELECT x.id, y.id AS near, list_sum(list_transform(list_zip(x.a, y.a), lambda z: z[1] * z[2])) AS ca, list_sum(list_transform(list_zip(x.b, y.b), lambda z: z[1] * z[2])) AS cb FROM u x JOIN u y ON x.id <> y.id)"""


def halves(spark, sf) -> tuple[DataFrame, DataFrame]:
    e = load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return C.with_unit(e.withColumn("x", F.slice("embedding", 1, 32)), "x"), C.with_unit(e.withColumn("x", F.slice("embedding", 33, 32)), "x")


@query(f"""WITH {HALVES}, r AS (SELECT id, near, row_number() OVER (PARTITION BY id ORDER BY ca DESC, near) AS ra, row_number() OVER (PARTITION BY id ORDER BY cb DESC, near) AS rb FROM s),
c AS (SELECT id, count(*) FILTER (ra <= 10 AND rb <= 10) / 10 AS c FROM r GROUP BY 1) SELECT round(avg(c), 6) AS overlap FROM c""")
def overlap_at_k(spark, sf):
    a, b = halves(spark, sf)
    return N.overlap(N.knn(a, 10), N.knn(b, 10), 10)


@query(f"WITH {HALVES} SELECT round(corr(ca, cb), 6) AS r FROM s WHERE id < near")
def pearson_pairwise(spark, sf):
    a, b = halves(spark, sf)
    both = a.select("id", F.col("unit").alias("a")).join(b.select("id", F.col("unit").alias("b")), "id")
    return N.pairwise_correlation(both, "a", "b")


@query(f"""WITH {CORPUS}, k AS (SELECT id, topic AS s, id % 4 AS c, unit FROM corpus),
p AS (SELECT a.id, b.id AS near, a.s = b.s AS ss, a.c = b.c AS cc, list_sum(list_transform(list_zip(a.unit, b.unit), lambda z: z[1] * z[2])) AS cos FROM k a JOIN k b ON a.id <> b.id),
m AS (SELECT avg(cos) FILTER (ss AND NOT cc) AS style, avg(cos) FILTER (cc AND NOT ss) AS content FROM p),
nn AS (SELECT avg(CAST(ss AS INT)) AS a, avg(CAST(cc AND NOT ss AS INT)) AS b, avg(CAST(NOT cc AND NOT ss AS INT)) AS o FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cos DESC, near) AS rn FROM p) WHERE rn = 1),
w AS (SELECT avg(CASE WHEN coalesce(x > y, x IS NOT NULL) THEN CAST(1 AS DOUBLE) ELSE 0 END) AS win FROM (SELECT id, max(cos) FILTER (ss AND NOT cc) AS x, max(cos) FILTER (cc AND NOT ss) AS y FROM p GROUP BY 1)),
z AS (SELECT count(DISTINCT s) AS styles, count(DISTINCT c) AS contents, count(*) AS n FROM k)
SELECT styles, contents, round(style, 6) AS style_sim, round(content, 6) AS content_sim, round(style - content, 6) AS style_bias, round(win, 6) AS style_win_rate, round(a, 6) AS same_style_nn, round(b, 6) AS same_content_nn, round(o, 6) AS other_nn,
round((contents - 1) / (n - 1), 6) AS chance_style_nn, round((styles - 1) / (n - 1), 6) AS chance_content_nn FROM m, nn, w, z""")
def style_content_stats(spark, sf):
    k = view.corpus(spark, sf).select("id", F.col("topic").alias("style"), (F.col("id") % 4).alias("content"), "unit")
    return N.style_content(k, "style", "content")


# --- graph feature, learned ranker, joint search ---------------------------------------------------------------

GRAPH = ROLE + "," + LABELS + """,
edges AS (SELECT h.id AS heading, p.id AS partner FROM labels_ l JOIN canonical h ON h.family = l.heading JOIN canonical p ON p.family = l.partner),
gs AS (SELECT h.id AS h_id, g.id AS g, list_sum(list_transform(list_zip(h.unit, g.unit), lambda z: z[1] * z[2])) AS weight FROM canonical h JOIN canonical g ON h.id <> g.id WHERE g.id IN (SELECT heading FROM edges)),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY h_id ORDER BY weight DESC, g) AS rn FROM gs) WHERE rn <= 10),
reach AS (SELECT h_id, g, partner, weight FROM near JOIN edges ON heading = g),
cand AS (SELECT h_id, id FROM scored),
sim AS (SELECT c.h_id, c.id, r.g, r.partner, r.weight, list_sum(list_transform(list_zip(p.unit, q.unit), lambda z: z[1] * z[2])) AS sim FROM cand c JOIN reach r USING (h_id) JOIN corpus p ON p.id = r.partner JOIN corpus q ON q.id = c.id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY h_id, id ORDER BY sim DESC, partner, g) AS rn FROM sim) WHERE rn <= 10),
ds AS (SELECT h_id, id, avg(sim * weight) AS dsknn FROM best GROUP BY 1, 2)"""


def graph_edges(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = view.corpus(spark, sf)
    heads = C.canonical(c)
    ids = heads.select("family", "id")
    edges = brand_labels(spark, sf).join(ids.select(F.col("family").alias("heading"), F.col("id").alias("h")), "heading").join(ids.select(F.col("family").alias("partner"), F.col("id").alias("p")), "partner")
    return c, heads, edges.select(F.col("h").alias("heading"), F.col("p").alias("partner"))


@query(f"WITH {GRAPH} SELECT c.h_id, c.id, round(coalesce(dsknn, 0), 6) AS dsknn, CASE WHEN dsknn IS NULL THEN 0 ELSE 1 END AS has_graph FROM cand c LEFT JOIN ds ON ds.h_id = c.h_id AND ds.id = c.id")
def dsknn_scores(spark, sf):
    c, heads, edges = graph_edges(spark, sf)
    units = c.select("id", "unit")
    candidates = C.pool(heads.select("id", "family"), c.select("id", "family", "eligible")).select("h_id", "id")
    return G.graph_scores(G.graph_partners(heads, edges, units), candidates, units).select("h_id", "id", r6("dsknn").alias("dsknn"), "has_graph")


WEIGHTS = {"f_cos": -0.4, "f_contrast": 1.1, "f_leg_body": 0.6, "f_leg_head": 0.1, "f_serif_split": 0.3, "f_serif_skel": 0.5, "f_dxh": 0.7, "f_bodyweight": 0.2, "f_italic": -0.3, "f_concentration": 0.9}


@query(f"""WITH {ROLE}, f AS (SELECT h_id, id, -0.2 + cos * -0.4 + cn * 1.1 + coalesce(legibility, 0) * 0.6 + coalesce(h_legibility, 0) * 0.1 + serif_split * 0.3 + serif_split * gate * 0.5 + coalesce(-abs(h_xh - xh), -1) * 0.7
  + -abs(log2(weight / CAST(400 AS DOUBLE))) * 0.2 + CASE WHEN style = 'italic' THEN 1 ELSE 0 END * -0.3
  + list_sum(list_sort(list_transform(list_zip(h_unit, unit), lambda z: abs(z[1] - z[2])), 'DESC')[1:5]) / (list_sum(list_transform(list_zip(h_unit, unit), lambda z: abs(z[1] - z[2]))) + CAST(1e-9 AS DOUBLE)) * 0.9 AS score FROM scored),
r AS (SELECT *, row_number() OVER (PARTITION BY h_id ORDER BY score DESC, id) AS rank FROM f) SELECT h_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def rerank_linear_score(spark, sf):
    df = P.feature_frame(view.role_pairs(spark, sf)).withColumn("score", P.learned_score(WEIGHTS, -0.2))
    return P.ranked(df, "score").where("rank <= 10").select("h_id", "id", r6("score").alias("score"), "rank")


TRIPLES = ROLE + """,
b AS (SELECT *, list_transform(list_zip(h_unit, unit), lambda z: abs(z[1] - z[2])) AS gaps FROM (SELECT *, row_number() OVER (PARTITION BY h_id ORDER BY cn DESC, id) AS ord FROM scored WHERE weight BETWEEN 300 AND 700) WHERE ord <= 40),
a AS (SELECT * FROM (SELECT *, max(contrast) OVER (PARTITION BY h_id) AS cmax, row_number() OVER (PARTITION BY h_id ORDER BY cn DESC, id) AS ord FROM scored) WHERE ord <= 80),
t AS (SELECT b.h_id, b.h_category, b.id AS b_id, a.id AS a_id, b.cn AS hb, a.cn AS ha, b.leg AS b_leg, b.gaps AS gaps, b.ord AS b_ord, a.ord AS a_ord, b.category AS b_category, a.category AS a_category, a.cmax,
  list_transform(list_zip(b.unit, a.unit), lambda z: z[1] * z[2]) AS m FROM b JOIN a ON a.h_id = b.h_id AND a.family <> b.family),
o AS (SELECT * EXCLUDE (m), list_sum(list_transform(m, lambda x: greatest(x, CAST(0 AS DOUBLE)))) * list_sum(list_transform(m, lambda x: greatest(-x, CAST(0 AS DOUBLE)))) / CASE WHEN cmax > 0 THEN cmax ELSE 1 END AS ba FROM t),
best AS (SELECT * FROM (SELECT *, least(hb, ha, ba) + CAST(0.25 AS DOUBLE) * b_leg AS objective, row_number() OVER (PARTITION BY h_id ORDER BY least(hb, ha, ba) + CAST(0.25 AS DOUBLE) * b_leg DESC, b_ord, a_ord) AS rn FROM o) WHERE rn = 1)"""


def triples(spark, sf) -> DataFrame:
    pairs = view.role_pairs(spark, sf)
    return J.triples(J.top_of(pairs.where(C.body_suitable(F.col("weight"))), "cn", K.BODY_CUT), J.top_of(pairs, "cn", K.ACCENT_CUT))


@query(f"WITH {TRIPLES} SELECT h_id, b_id, a_id, round(objective, 6) AS objective FROM best")
def triple_argmax(spark, sf):
    return J.best_triple(triples(spark, sf)).select("h_id", "b_id", "a_id", r6("objective").alias("objective"))


@query(f"""WITH {TRIPLES} SELECT count(*) AS headings, round(avg(b_leg), 6) AS legibility, round(avg(hb + ha + ba), 6) AS contrast, round(avg(least(hb, ha, ba) / CASE WHEN greatest(hb, ha, ba) > 0 THEN greatest(hb, ha, ba) ELSE 1 END), 6) AS balance,
round(avg(list_sum(list_sort(gaps, 'DESC')[1:5]) / (list_sum(gaps) + CAST(1e-9 AS DOUBLE))), 6) AS concentration, round(avg(len(list_distinct([h_category, b_category, a_category]))), 6) AS spread, round(avg(CASE WHEN b_leg >= 0.5 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS legible_rate FROM best""")
def balance_spread(spark, sf):
    return J.engine_metrics(J.best_triple(triples(spark, sf)))


@query(f"WITH {ROLE}, r AS (SELECT h_id, h_category, family, category FROM (SELECT *, row_number() OVER (PARTITION BY h_id ORDER BY cn DESC, id) AS rank FROM scored) WHERE rank <= 20), f AS (SELECT h_id, family, count(*) AS n FROM r GROUP BY 1, 2), c AS (SELECT h_id, max(n) / sum(n) AS crowding FROM f GROUP BY 1), o AS (SELECT h_id, avg(CAST(category <> h_category AS INT)) AS other FROM r GROUP BY 1) SELECT h_id, round(crowding, 6) AS crowding, round(other, 6) AS other_category FROM c JOIN o USING (h_id)")
def head_crowding(spark, sf):
    return J.crowding(P.ranked(view.role_pairs(spark, sf), "cn"), 20).select("h_id", r6("crowding").alias("crowding"), r6("other_category").alias("other_category"))


@query(f"""WITH {ROLE}, r AS (SELECT h_id, id, row_number() OVER (PARTITION BY h_id ORDER BY cn DESC, id) AS x, row_number() OVER (PARTITION BY h_id ORDER BY head_score DESC, id) AS y FROM scored),
l AS (SELECT h_id, list(id ORDER BY x) FILTER (x <= 4) AS a, list(id ORDER BY y) FILTER (y <= 4) AS b FROM r GROUP BY 1) SELECT h_id, len(list_intersect(a, b)) AS shared, a <> b AS reordered FROM l""")
def recommendation_overlap(spark, sf):
    pairs = view.role_pairs(spark, sf).withColumn("score", P.role_score("head"))
    return J.recommendation_overlap(P.ranked(pairs, "cn"), P.ranked(pairs, "score")).withColumn("shared", F.col("shared").cast("long"))


# --- further operators over the same tables -------------------------------------------------------------------


@query(f"""WITH {CATALOG}, w AS (SELECT DISTINCT family, 500 AS weight FROM catalog), m AS (SELECT w.family, c.id, c.weight = w.weight AS named, c.weight AS cw, c.style FROM w JOIN catalog c USING (family)),
o AS (SELECT *, CASE WHEN named AND style = 'normal' THEN 0 WHEN named THEN 1 WHEN cw = 400 AND style = 'normal' THEN 2 WHEN cw = 400 THEN 3 ELSE 4 END AS o FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY o, id) AS rn FROM o) SELECT family, id, o > 1 AS warned FROM r WHERE rn = 1""")
def named_cut(spark, sf):
    cat = view.catalog(spark, sf)
    wanted = cat.select("family").distinct().select(F.col("family").alias("key"), "family", F.lit(500).alias("weight"), F.lit(None).cast("string").alias("style"))
    return C.pick_cut(cat, wanted).select("family", "id", "warned")


@query(f"""WITH {CATALOG}, r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place, count(*) OVER () AS n FROM catalog) SELECT id FROM r WHERE place IN (SELECT CAST(floor(i * (SELECT max(n) FROM r) / 20) AS BIGINT) FROM range(20) t(i))""")
def evenly_spaced_sample(spark, sf):
    return E.evenly_spaced(view.catalog(spark, sf).select("id"), "id", 20)


@query(f"""WITH w AS (SELECT label AS id, count(*) AS weight FROM embeddings GROUP BY 1), s AS (SELECT id, sum(weight) OVER (ORDER BY id) - weight AS a, sum(weight) OVER (ORDER BY id) AS b FROM w), n AS (SELECT sum(weight) AS n FROM w),
d AS (SELECT i AS draw, {draw_sql('i', 'CAST(n AS BIGINT)')} AS u FROM range(20000) t(i), n) SELECT draw, id FROM d JOIN s ON u >= a AND u < b""")
def weighted_null_draws(spark, sf):
    return U.weighted_draws(load(spark, sf, "embeddings").groupBy(F.col("label").alias("id")).agg(F.count("*").alias("weight")), 20_000)


@query(f"WITH {CATALOG} SELECT id, family, 'google' AS source FROM catalog WHERE source = 'google' UNION ALL SELECT id + (SELECT max(id) + 1 FROM catalog WHERE source = 'google'), family, 'private' FROM catalog WHERE source = 'local'")
def merged_ids(spark, sf):
    cat = view.catalog(spark, sf).select("id", "family", "source")
    return C.merge(cat.where("source = 'google'").drop("source"), cat.where("source = 'local'").drop("source"))


@query(f"""WITH {TRIPLES}, s AS (SELECT *, least(hb, ha, ba) + CAST(0.25 AS DOUBLE) * b_leg AS score FROM o),
ref AS (SELECT h_id, arg_min(score, b_ord * 1000 + a_ord) AS r FROM s GROUP BY 1) SELECT h_id, count(*) FILTER (score > r) AS better, count(*) AS total, round(100 * (1 - count(*) FILTER (score > r) / count(*)), 6) AS percentile,
count(*) FILTER (b_leg >= 0.5) AS legible, round(100 * (1 - count(*) FILTER (score > r AND b_leg >= 0.5) / nullif(count(*) FILTER (b_leg >= 0.5), 0)), 6) AS legible_percentile FROM s JOIN ref USING (h_id) GROUP BY 1""")
def triples_better(spark, sf):
    found = triples(spark, sf).withColumn("_score", J.objective())
    first = found.groupBy("h_id").agg(F.min_by("_score", F.col("b_ord") * 1000 + F.col("a_ord")).alias("objective"))
    found = found.drop("_score")
    legible = J.triples_above(found, first, 0.5).select("h_id", F.col("total").alias("legible"), r6("percentile").alias("legible_percentile"))
    every = J.triples_above(found, first).withColumn("percentile", r6("percentile"))
    return every.join(legible, "h_id", "left").fillna(0, ["legible"])


@query(f"""WITH {ROLE}, c AS (
  SELECT h_id, id, 'xh' AS candidate, CASE WHEN h_xh IS NULL OR xh IS NULL THEN -1 ELSE 1 - least(CAST(1 AS DOUBLE), abs(h_xh - xh) / CAST(0.15 AS DOUBLE)) END AS score FROM scored
  UNION ALL SELECT h_id, id, 'weight', 1 - least(CAST(1 AS DOUBLE), abs(h_weight - weight) / CAST(400 AS DOUBLE)) FROM scored
  UNION ALL SELECT h_id, id, 'category', CASE WHEN h_category <> category THEN CAST(1 AS DOUBLE) ELSE 0 END FROM scored
  UNION ALL SELECT h_id, id, 'skeleton', gate * (1 - CAST(0.3 AS DOUBLE) * least(CAST(1 AS DOUBLE), coalesce(abs(h_width - width), 0) / CAST(0.3 AS DOUBLE))) * (CAST(0 AS DOUBLE) + cn * CAST(0.7 AS DOUBLE) + serif_split * CAST(0.3 AS DOUBLE)) FROM scored),
r AS (SELECT *, row_number() OVER (PARTITION BY candidate, h_id ORDER BY score DESC, id) AS rank FROM c) SELECT candidate, h_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def axis_candidates(spark, sf):
    h, c = F.col("h_weight"), F.col("weight")
    axis = V.axis_metric(F.col("gate"), F.coalesce(F.abs(F.col("h_width") - F.col("width")), F.lit(0.0)), {"contrast": (F.col("cn"), 0.7), "serif": (F.col("serif_split"), 0.3)})
    candidates = {
        "xh": V.match(F.col("h_xh"), F.col("xh"), K.XH_SPAN, -1.0), "weight": V.match(h.cast("double"), c.cast("double"), K.WEIGHT_SPAN),
        "category": F.when(F.col("h_category") != F.col("category"), 1.0).otherwise(0.0), "skeleton": axis,
    }
    return P.swept(view.role_pairs(spark, sf), candidates).where("rank <= 10").select("candidate", "h_id", "id", r6("score").alias("score"), "rank")


@query(f"WITH {GRAPH} SELECT round(avg(CASE WHEN r.h_id IS NULL THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS cold FROM (SELECT DISTINCT h_id FROM cand) c LEFT JOIN (SELECT DISTINCT h_id FROM reach) r USING (h_id)")
def graph_cold_rate(spark, sf):
    c, heads, edges = graph_edges(spark, sf)
    candidates = C.pool(heads.select("id", "family"), c.select("id", "family", "eligible")).select("h_id", "id")
    return G.cold_rate(candidates, G.graph_partners(heads, edges, c.select("id", "unit")))


@query(f"""WITH {CATALOG} SELECT id, family || ' ' || CAST(weight AS VARCHAR) || CASE WHEN style = 'italic' THEN ' Italic' ELSE '' END AS label, CAST(round_even(xh, 4) AS DOUBLE) AS xh, CAST(round_even(width, 4) AS DOUBLE) AS width, lower(family || ' ' || CAST(weight AS VARCHAR) || ' ' || style || ' ' || category) AS search FROM catalog""")
def served_catalog(spark, sf):
    from ..sources.sinks import catalog_rows

    return catalog_rows(view.catalog(spark, sf)).select("id", "label", "xh", "width", "search")


# --- learned parts: without SQL where the fit has none ----------------------------------------------------------


@query()
def pca_project(spark, sf):
    """Components of the public rows, projections of all."""
    c = load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    model = L.fit_pca(c, "embedding", 8, F.col("id") % 11 != 0)
    return L.pca_project(c, "embedding", model).select("id", F.transform("projected", lambda x: F.round(x, 6)).alias("projected"))


@query(f"""WITH {CORPUS}, d AS (SELECT a.id, a.topic, b.topic AS other, 1 - list_sum(list_transform(list_zip(a.unit, b.unit), lambda z: z[1] * z[2])) AS d FROM corpus a JOIN corpus b ON a.id <> b.id),
g AS (SELECT id, topic, other, avg(d) AS m FROM d GROUP BY 1, 2, 3), own AS (SELECT id, m AS a FROM g WHERE topic = other), rest AS (SELECT id, min(m) AS b FROM g WHERE topic <> other GROUP BY 1),
s AS (SELECT c.id, CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM corpus c LEFT JOIN own USING (id) LEFT JOIN rest USING (id)) SELECT round(avg(s), 6) AS silhouette FROM s""")
def silhouette_cosine(spark, sf):
    return spark.createDataFrame([(round(L.silhouette(view.corpus(spark, sf), "unit", "topic"), 6),)], "silhouette double")


@query()
def legibility_proxy(spark, sf):
    return L.legibility_proxy(view.corpus(spark, sf), "category in ('ECONOMY', 'STANDARD')", "category in ('LARGE', 'PROMO')").select("id", r6("legibility").alias("legibility"))


#: negatives a heading and seeds of the published fit
NEGATIVES, SEEDS = 50, 8


def ranker_tables(spark, sf) -> dict[str, DataFrame]:
    """What the learned ranker is fitted on: pairs with static features, labels, excluded candidates, and graphs by fold.

    Tables that several steps read are written once.
    """
    c, _, edges = graph_edges(spark, sf)
    c, edges = kept(c), kept(edges)
    heads = C.canonical(c)
    pairs = kept(P.feature_frame(view.role_pairs(spark, sf)).select("h_id", "id", "family", *P.STATIC_FEATURES))
    units = c.select("id", "unit")
    graphs, cuts = G.fold_graphs(heads, edges, units)
    positives = edges.select(F.col("heading").alias("h_id"), F.col("partner").alias("id"))
    families = positives.join(c.select("id", "family"), "id").select("h_id", "family").distinct()
    excluded = pairs.select("h_id", "id", "family").join(families, ["h_id", "family"], "left_semi").select("h_id", "id")  # every cut of a partner's family
    labelled = positives.select("h_id").distinct()
    folds = kept(E.folds(labelled, parts=2**62))
    return {"pairs": pairs.drop("family"), "positives": positives, "excluded": kept(excluded), "labelled": labelled, "folds": folds, "graphs": kept(graphs), "cuts": kept(cuts), "units": units, "heads": heads, "edges": edges}


def loocv_models(t: dict[str, DataFrame], seeds: int = SEEDS) -> DataFrame:
    """(fold, seed, weights, bias): a model for each labelled heading, fitted on all others with the graph without it."""
    folds = t["folds"]
    rows = kept(L.training_rows(t["pairs"], t["positives"], t["excluded"], seeds, NEGATIVES).join(folds, "h_id"))
    held = L.held_out(rows, folds.count()).join(folds.select(F.col("fold").alias("held"), F.col("h_id").alias("without")), "held")
    scores = kept(G.fold_scores(t["graphs"], rows.select("h_id", "id"), t["units"]))
    return L.fit_by(G.with_fold_feature(held, scores, t["cuts"], "without"), ("held", "seed"), P.ALL_FEATURES)


def loocv_ranks(t: dict[str, DataFrame], models: DataFrame) -> DataFrame:
    """(seed, h_id, best): best rank of a heading's partners under the model that never saw it; its own graph has no part of it anyway."""
    test = t["pairs"].join(t["folds"], "h_id")
    scores = G.fold_scores(t["graphs"].where("without is null"), test.select("h_id", "id"), t["units"])
    featured = G.with_fold_feature(test.withColumnRenamed("fold", "held"), scores, t["cuts"], None)
    scored = L.scored(featured, models, P.ALL_FEATURES, ["held"])
    by_seed = scored.select(F.struct("seed", "h_id").alias("h_id"), "id", "score")
    wanted = models.select("held", "seed").join(t["folds"].withColumnRenamed("fold", "held"), "held").join(t["positives"].withColumnRenamed("id", "partner"), "h_id").select(F.struct("seed", "h_id").alias("h_id"), "partner")
    return E.ranks_by_count(by_seed, wanted).groupBy("h_id").agg(F.min("rank").alias("best")).select("h_id.seed", "h_id.h_id", "best")


@query()
def reranker_loocv(spark, sf):
    """Twelve features, one heading left out at a time, eight negative samples: mean and range over seeds of hits and the median rank."""
    t = ranker_tables(spark, sf)
    ranks = kept(loocv_ranks(t, kept(loocv_models(t))))
    hits = [F.struct(F.lit(f"hit@{k}").alias("metric"), F.count_if(F.col("best") <= k).cast("double").alias("value")) for k in (10, 50, 100)]
    middle = F.struct(F.lit("median").alias("metric"), F.percentile("best", F.lit(0.5)).alias("value"))
    each = ranks.groupBy("seed").agg(F.array(*hits, middle).alias("m")).select("seed", F.explode("m").alias("m")).select("seed", "m.metric", "m.value")
    return E.seed_summary(each).select("metric", r6("mean").alias("mean"), r6("sd").alias("sd"), "low", "high")


@query()
def reranker_model(spark, sf):
    """(feature, weight, sd): the model of all labelled headings, averaged over eight negative samples, in input space."""
    t = ranker_tables(spark, sf)
    rows = L.training_rows(t["pairs"], t["positives"], t["excluded"], SEEDS, NEGATIVES)
    scores = G.fold_scores(t["graphs"].where("without is null"), rows.select("h_id", "id"), t["units"])
    mean = L.averaged(L.fit_by(G.with_fold_feature(rows, scores, t["cuts"], None), ("seed",), P.ALL_FEATURES))
    names = F.array(*[F.lit(f) for f in P.ALL_FEATURES])
    weights = mean.select(F.explode(F.arrays_zip(names.alias("feature"), F.col("weights").alias("weight"), F.col("spread").alias("sd"))).alias("x")).select("x.*")
    return weights.unionByName(mean.select(F.lit("bias").alias("feature"), F.col("bias").alias("weight"), F.lit(None).cast("double").alias("sd"))).select("feature", r6("weight").alias("weight"), r6("sd").alias("sd"))


@query()
def reranker_crossfit(spark, sf):
    """Even and odd headings: the ranker of the other half, its graph without the tested half; best rank of each heading's partners."""
    t = ranker_tables(spark, sf)
    folds = t["folds"].select("h_id", (F.col("fold") % 2).alias("fold"))
    rows = L.training_rows(t["pairs"], t["positives"], t["excluded"], SEEDS, NEGATIVES).join(folds, "h_id").withColumn("held", 1 - F.col("fold"))
    rows = kept(rows)
    found = []
    for held in (0, 1):
        inside = folds.where(F.col("fold") != held).select(F.col("h_id").alias("heading"))
        graphs, cuts = G.fold_graphs(t["heads"], t["edges"].join(inside, "heading", "left_semi"), t["units"])
        whole = kept(graphs.where("without is null"))
        own = rows.where(F.col("held") == held)
        model = L.averaged(L.fit_by(G.with_fold_feature(own, G.fold_scores(whole, own.select("h_id", "id"), t["units"]), cuts, None), ("seed",), P.ALL_FEATURES)).withColumn("held", F.lit(held).cast("long"))
        test = t["pairs"].join(folds.where(F.col("fold") == held).select("h_id", F.col("fold").alias("held")), "h_id")
        featured = G.with_fold_feature(test, G.fold_scores(whole, test.select("h_id", "id"), t["units"]), cuts, None)
        found.append(L.scored(featured, model, P.ALL_FEATURES, ["held"]).select("h_id", "id", "score"))
    ranks = E.ranks_by_count(found[0].unionByName(found[1]), t["positives"].withColumnRenamed("id", "partner"))
    return E.per_heading(ranks, 50).select("h_id", "n", "best", "hits")


@query()
def bilinear_crossfit(spark, sf):
    """The learned bilinear metric on 32 standardized components, alone and added to the hand score: best ranks on the other half of the headings."""
    c, _, edges = graph_edges(spark, sf)
    edges, pairs = kept(edges), kept(view.role_pairs(spark, sf).drop("h_unit", "unit"))
    positives = edges.select(F.col("heading").alias("h_id"), F.col("partner").alias("id"))
    labelled = positives.groupBy("h_id").agg(F.count("*").alias("n"))
    folds = E.folds(labelled.select("h_id"))
    x = L.standardized(c, "unit").select("id", "x")
    known = pairs.join(folds, "h_id").select("h_id", "fold", "id", P.hand_score().alias("hand")).join(x.withColumnRenamed("id", "h_id"), "h_id").join(x.select("id", F.col("x").alias("z")), "id")
    rows = L.training_rows(known, positives, positives, 1, NEGATIVES).withColumn("_n", F.row_number().over(Window.partitionBy("h_id", "y").orderBy(F.xxhash64("id"), "id")))
    rows = rows.join(labelled, "h_id").where("y = 1 or _n <= n").withColumn("held", 1 - F.col("fold"))  # as many negatives as positives
    scored = L.metric_scores(known.withColumnRenamed("fold", "held"), L.fit_metric_by(rows, ("held",)), ["held"])
    scored = L.z_scored(scored, "metric", ("h_id",), "z")
    ranks = lambda score, out: E.ranks_by_count(scored.select("h_id", "id", score.alias("score")), positives.withColumnRenamed("id", "partner")).groupBy("h_id").agg(F.min("rank").alias(out))
    return ranks(F.col("metric"), "metric_best").join(ranks(F.col("hand") + 0.5 * F.col("z"), "blend_best"), "h_id")


def queries() -> dict[str, Query]:
    from . import extended  # noqa: F401  registers its queries here

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import extended  # noqa: F401

    return dict(_SQL)
