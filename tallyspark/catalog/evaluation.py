"""Evaluation queries on the ``embeddings`` table (labels are the categories)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.catalog.categorisation import DIM, FUZZY_ITEMS, UNIT, fuzzy_of
from tallyspark.catalog.registry import query
from tallyspark.operators import evaluate as E
from tallyspark.plans import keyed
from tallyspark.plans.session import work_folder
from tallyspark.sources import readers

REFS = f"""
SELECT category_id, canonical_id, {UNIT.format('c')} AS ref_vec FROM (SELECT category_id, canonical_id, list(m ORDER BY pos) AS c FROM (
  SELECT label AS category_id, canonical_id, pos, avg(x) AS m FROM (SELECT label, canonical_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM fx_vec WHERE variant_type = 'clean') a
  GROUP BY label, canonical_id, pos) b GROUP BY category_id, canonical_id) d"""
# Leave-one-product-out by brute force: every (item, category) re-averages the other products.
PROTO_OF = {"DESCRIPTION_ONLY": "d", "EXAMPLE_CENTROID": "COALESCE(u, d)", "HYBRID_PROTOTYPE": UNIT.format("mix")}


def predictions_sql(strategy: str) -> str:
    return f"""
SELECT item_id, canonical_id, category_id, language, variant_type, '{strategy}' AS strategy, 'default' AS model,
  t[1].c AS top1, t[1].s AS top1_score, t[2].c AS top2, t[2].s AS top2_score, t[1].s - t[2].s AS score_gap,
  '[' || t[1].c || ',' || t[2].c || ',' || t[3].c || ']' AS topk_categories, t[1].c = category_id AS top1_correct, list_contains([t[1].c, t[2].c, t[3].c], category_id) AS top3_correct
FROM (SELECT item_id, canonical_id, category_id, language, variant_type, list(struct_pack(s := s, c := c) ORDER BY s DESC, c) AS t FROM (
  SELECT *, list_inner_product(vec, {PROTO_OF[strategy]}) AS s FROM (SELECT *, list_transform(list_zip(d, COALESCE(u, d)), lambda p: 0.5 * p[1] + 0.5 * p[2]) AS mix FROM (
    SELECT *, CASE WHEN c_raw IS NOT NULL THEN {UNIT.format('c_raw')} END AS u FROM (
      SELECT v.item_id, v.canonical_id, v.label AS category_id, v.language, v.variant_type, v.vec, d.label AS c, d.vec AS d, o.c_raw
      FROM fx_vec v CROSS JOIN fx_desc d LEFT JOIN (
        SELECT canonical_id, category_id, list(m ORDER BY pos) AS c_raw FROM (
          SELECT k.canonical_id, r.category_id, r.pos, avg(r.x) AS m FROM (SELECT DISTINCT canonical_id FROM fx_vec) k
          JOIN (SELECT category_id, canonical_id, unnest(ref_vec) AS x, generate_subscripts(ref_vec, 1) AS pos FROM ({REFS}) q) r ON r.canonical_id <> k.canonical_id
          GROUP BY k.canonical_id, r.category_id, r.pos) g GROUP BY canonical_id, category_id) o ON o.canonical_id = v.canonical_id AND o.category_id = d.label) e) f) h) i
  GROUP BY ALL) j"""


PRED = "canonical_id, category_id, language, variant_type, strategy, model, top1, top1_score, top2, top2_score, score_gap, topk_categories, top1_correct, top3_correct"
PREDC = ["item_id", *[c.strip() for c in PRED.split(",")]]
SCORES = ["top1_score", "top2_score", "score_gap"]
HYBRID, CENTROID, DESCRIPTION = (predictions_sql(s) for s in ("HYBRID_PROTOTYPE", "EXAMPLE_CENTROID", "DESCRIPTION_ONLY"))
BOTH = f"SELECT * FROM ({HYBRID}) h UNION ALL SELECT * FROM ({CENTROID}) c"
HIT = "CAST(top1_correct AS INTEGER)"


def items_of(t):
    return t.vec.withColumnRenamed("label", "category_id")


def refs_of(t):
    """Reference vectors, written once: the class sums and the own vectors both read them."""
    return keyed.cut(E.canonical_refs(items_of(t).filter("variant_type = 'clean'"), dim=DIM), "refs")


def pred_of(t, strategy="HYBRID_PROTOTYPE", refs=None):
    return E.predict(items_of(t), t.desc.withColumnRenamed("label", "category_id"), refs or refs_of(t), strategy, dim=DIM)


def both_of(t):
    refs = refs_of(t)
    return E.stack_predictions([pred_of(t, refs=refs), pred_of(t, "EXAMPLE_CENTROID", refs)])


for _name, _strategy, _sql in (("e01_predict_hybrid", "HYBRID_PROTOTYPE", HYBRID), ("e01_predict_centroid", "EXAMPLE_CENTROID", CENTROID), ("e01_predict_description", "DESCRIPTION_ONLY", DESCRIPTION)):
    @query(_name, f"SELECT item_id, {PRED} FROM ({_sql}) p", doubles=SCORES)
    def _(t, s=_strategy):
        return pred_of(t, s).select(*PREDC)


@query("us2_stack_predictions", f"SELECT item_id, {PRED} FROM ({BOTH}) p", doubles=SCORES)
def _(t):
    return both_of(t).select(*PREDC)


@query("e02_canonical_refs", f"SELECT category_id, canonical_id, pos - 1 AS pos, x FROM (SELECT category_id, canonical_id, unnest(ref_vec) AS x, generate_subscripts(ref_vec, 1) AS pos FROM ({REFS}) r) q", doubles=["x"])
def _(t):
    return refs_of(t).select("category_id", "canonical_id", F.posexplode("ref_vec").alias("pos", "x"))


@query("j12_loo_prototypes", f"""
WITH refs AS ({REFS}), cells AS (SELECT category_id, canonical_id, unnest(ref_vec) AS x, generate_subscripts(ref_vec, 1) AS pos FROM refs)
SELECT v.item_id, o.n_others, CASE WHEN o.n_others > 0 THEN list_inner_product(v.vec, {UNIT.format('o.c')}) END AS score
FROM fx_vec v LEFT JOIN (SELECT canonical_id, label, MAX(n) AS n_others, list(m ORDER BY pos) AS c FROM (
  SELECT k.canonical_id, k.label, r.pos, avg(r.x) AS m, COUNT(*) AS n FROM (SELECT DISTINCT canonical_id, label FROM fx_vec) k JOIN cells r ON r.category_id = k.label AND r.canonical_id <> k.canonical_id GROUP BY ALL) g GROUP BY ALL) o
  ON o.canonical_id = v.canonical_id AND o.label = v.label""", doubles=["score"])
def _(t):
    from tallyspark.functions import vectors

    out = E.loo_prototypes(items_of(t), refs_of(t), dim=DIM)
    return out.select("item_id", F.col("n_others").cast("long").alias("n_others"), vectors.dot(F.col("vec"), F.col("loo_centroid")).alias("score"))


@query("e03_overall_metrics", f"""
SELECT model, strategy, COUNT(*) AS examples, avg({HIT}) AS top1_accuracy, avg(CAST(top3_correct AS INTEGER)) AS top3_accuracy, avg(score_gap) FILTER (top1_correct) AS mean_gap_correct,
  avg(score_gap) FILTER (NOT top1_correct) AS mean_gap_incorrect, corr(score_gap, CAST({HIT} AS DOUBLE)) AS gap_correctness_correlation FROM ({BOTH}) p GROUP BY model, strategy""",
    doubles=["top1_accuracy", "top3_accuracy", "mean_gap_correct", "mean_gap_incorrect", "gap_correctness_correlation"])
def _(t):
    return E.overall_metrics(both_of(t))


@query("e04_group_metrics", " UNION ALL ".join(
    f"SELECT model, strategy, '{d}' AS dimension, CAST({d} AS VARCHAR) AS \"group\", COUNT(*) AS examples, avg({HIT}) AS top1_accuracy, avg(CAST(top3_correct AS INTEGER)) AS top3_accuracy, avg(score_gap) AS average_score_gap FROM ({HYBRID}) p GROUP BY ALL"
    for d in ("language", "variant_type", "category_id")), doubles=["top1_accuracy", "top3_accuracy", "average_score_gap"])
def _(t):
    return E.group_metrics(pred_of(t))


@query("e05_config_metrics", f"""
SELECT model, strategy, avg({HIT}) AS overall_top1, avg(CAST(top3_correct AS INTEGER)) AS overall_top3, {", ".join(f"avg({HIT}) FILTER (language = '{v}') AS {v}_top1" for v in ('en', 'ar', 'mixed'))},
  {", ".join(f"avg({HIT}) FILTER (variant_type = '{v}') AS {v}_top1" for v in ('clean', 'ocr_noise'))}, {", ".join(f"avg({HIT}) FILTER (category_id = {v}) AS category_{v}_top1" for v in range(10))}
FROM ({BOTH}) p GROUP BY model, strategy""", doubles=["overall_top1", "overall_top3", "en_top1", "ar_top1", "mixed_top1", "clean_top1", "ocr_noise_top1", *[f"category_{v}_top1" for v in range(10)]])
def _(t):
    return E.config_metrics(both_of(t), ["en", "ar", "mixed"], ["clean", "ocr_noise"], range(10))


_GAPS = ", ".join(f"({g})" for g in E.GAP_THRESHOLDS)
_SCORES = ", ".join(f"({s})" for s in E.SCORE_THRESHOLDS)


def sweep_sql(pred: str) -> str:
    return f"""
SELECT p.model, p.strategy, g.threshold_type, g.minimum_score, g.minimum_gap, COUNT(*) FILTER (ok) AS accepted, COUNT(*) FILTER (NOT ok) AS abstained, COUNT(*) FILTER (ok) * 100.0 / COUNT(*) AS coverage_percentage,
  CASE WHEN COUNT(*) FILTER (ok) > 0 THEN COUNT(*) FILTER (ok AND top1_correct) / COUNT(*) FILTER (ok) END AS accepted_accuracy, COUNT(*) FILTER (ok AND NOT top1_correct) AS incorrect_accepted
FROM (SELECT *, score_gap >= minimum_gap AND (minimum_score IS NULL OR top1_score >= minimum_score) AS ok FROM ({pred}) a CROSS JOIN (
    SELECT 'GAP_ONLY' AS threshold_type, CAST(NULL AS DOUBLE) AS minimum_score, CAST(g AS DOUBLE) AS minimum_gap FROM (VALUES {_GAPS}) x(g)
    UNION ALL SELECT 'SCORE_AND_GAP', CAST(s AS DOUBLE), CAST(g AS DOUBLE) FROM (VALUES {_GAPS}) x(g) CROSS JOIN (VALUES {_SCORES}) y(s)) b) p, (SELECT p.threshold_type, p.minimum_score, p.minimum_gap) g
GROUP BY p.model, p.strategy, g.threshold_type, g.minimum_score, g.minimum_gap"""


SWEEP_DOUBLES = ["minimum_score", "minimum_gap", "coverage_percentage", "accepted_accuracy"]


@query("e06_threshold_sweep", sweep_sql(BOTH), doubles=SWEEP_DOUBLES)
def _(t):
    return E.threshold_sweep(both_of(t))


def clear_sql(pred: str, model: str) -> str:
    """The predictions on the clearer vectors, of a model of that name."""
    return f"SELECT * REPLACE ('{model}' AS model) FROM ({pred.replace('fx_vec', 'fx_clear').replace('fx_desc', 'fx_clear_desc')}) p"


CLEAR = {"lexical": clear_sql(CENTROID, "lexical"), "semantic": clear_sql(HYBRID, "semantic")}


def clear_of(t):
    """Two models on the clearer vectors: the centroid strategy stands in for the first stage, the hybrid is the second."""
    items, desc = t.clear.withColumnRenamed("label", "category_id"), t.clear_desc.withColumnRenamed("label", "category_id")
    refs = keyed.cut(E.canonical_refs(items.filter("variant_type = 'clean'"), dim=DIM), "clear-refs")
    made = [E.predict(items, desc, refs, s, dim=DIM).withColumn("model", F.lit(m)) for m, s in (("lexical", "EXAMPLE_CENTROID"), ("semantic", "HYBRID_PROTOTYPE"))]
    return [keyed.cut(df, "clear") for df in made]


@query("e07_best_threshold", f"""
SELECT * EXCLUDE (r) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY model ORDER BY coverage_percentage DESC, accepted_accuracy DESC, minimum_score NULLS FIRST, minimum_gap, strategy) AS r
FROM ({sweep_sql(" UNION ALL ".join(CLEAR.values()))}) s WHERE accepted_accuracy >= {E.SAFE_ACCURACY} AND accepted > 0) x WHERE r = 1""", doubles=SWEEP_DOUBLES)
def _(t):
    """The widest threshold of each of two models at which nine of ten accepted answers are right."""
    return E.best_threshold(E.threshold_sweep(E.stack_predictions(clear_of(t))))


@query("e08_errors", f"""
SELECT item_id, canonical_id, category_id AS expected_category, top1 AS predicted_category, top1_score AS predicted_score, top2 AS second_best_category, top2_score AS second_best_score,
  score_gap, language, variant_type, model, strategy FROM ({HYBRID}) p WHERE NOT top1_correct""", doubles=["predicted_score", "second_best_score", "score_gap"])
def _(t):
    return E.errors(pred_of(t))


@query("e09_kshot_eval", doubles=["top1_accuracy"])
def _(t):
    return E.kshot_eval(items_of(t), t.desc.withColumnRenamed("label", "category_id"), refs_of(t), 5)


@query("j13_k_reference_sets", f"""
WITH c AS (SELECT category_id, canonical_id, ROW_NUMBER() OVER (PARTITION BY category_id ORDER BY canonical_id) - 1 AS i FROM (SELECT DISTINCT label AS category_id, canonical_id FROM fx_vec WHERE variant_type = 'clean') q)
SELECT a.category_id, '[' || a.i || ',' || b.i || ',' || d.i || ']' AS members FROM c a JOIN c b ON b.category_id = a.category_id AND b.i > a.i JOIN c d ON d.category_id = a.category_id AND d.i > b.i""")
def _(t):
    return E.k_reference_sets(refs_of(t), 3).withColumn("members", F.to_json("members"))


@query("e10_cascade_report", f"""
WITH h AS ({CLEAR["semantic"]}), c AS ({CLEAR["lexical"]}), best AS (SELECT * FROM (SELECT model, minimum_gap, minimum_score, ROW_NUMBER() OVER (PARTITION BY model ORDER BY coverage_percentage DESC, accepted_accuracy DESC, minimum_score NULLS FIRST, minimum_gap, strategy) AS r
   FROM ({sweep_sql("SELECT item_id, model, strategy, top1_score, score_gap, top1_correct FROM c UNION ALL SELECT item_id, model, strategy, top1_score, score_gap, top1_correct FROM h")}) s WHERE accepted_accuracy >= {E.SAFE_ACCURACY} AND accepted > 0) b WHERE r = 1),
 j AS (SELECT h.model AS semantic_model, c.score_gap >= bl.minimum_gap AND (bl.minimum_score IS NULL OR c.top1_score >= bl.minimum_score) AS lex_ok, c.top1_correct AS lex_hit,
   h.score_gap >= bs.minimum_gap AND (bs.minimum_score IS NULL OR h.top1_score >= bs.minimum_score) AS sem_raw, h.top1_correct AS sem_hit
   FROM h JOIN c ON c.item_id = h.item_id JOIN best bl ON bl.model = 'lexical' JOIN best bs ON bs.model = h.model)
SELECT semantic_model, COUNT(*) FILTER (lex_ok OR sem_raw) AS accepted, COUNT(*) FILTER (lex_ok OR sem_raw) * 100.0 / COUNT(*) AS coverage_percentage,
  COUNT(*) FILTER ((lex_ok AND lex_hit) OR (sem_raw AND NOT lex_ok AND sem_hit)) / COUNT(*) FILTER (lex_ok OR sem_raw) AS accepted_accuracy,
  COUNT(*) FILTER (lex_ok OR sem_raw) - COUNT(*) FILTER ((lex_ok AND lex_hit) OR (sem_raw AND NOT lex_ok AND sem_hit)) AS incorrect_accepted,
  COUNT(*) FILTER (lex_ok) AS lexical_accepted, COUNT(*) FILTER (sem_raw AND NOT lex_ok) AS semantic_accepted_after_lexical FROM j GROUP BY semantic_model""", doubles=["coverage_percentage", "accepted_accuracy"])
def _(t):
    first, second = clear_of(t)
    return E.cascade_report(first, second, E.best_threshold(E.threshold_sweep(first.unionByName(second))), "lexical")


CANDIDATE = "SELECT item_id, label, list_transform(vec, lambda x: floor(x * 50 + 0.5) / 50) AS vec FROM fx_vec"


def candidate_of(t):
    return t.vec.withColumn("vec", F.transform("vec", lambda x: F.floor(x * 50 + 0.5) / 50))


@query("e11_vector_parity", f"""
SELECT r.item_id, list_inner_product(r.vec, c.vec) / (sqrt(list_inner_product(r.vec, r.vec)) * sqrt(list_inner_product(c.vec, c.vec))) AS cosine,
  list_avg(list_transform(list_zip(r.vec, c.vec), lambda p: abs(p[1] - p[2]))) AS mean_absolute_difference, list_max(list_transform(list_zip(r.vec, c.vec), lambda p: abs(p[1] - p[2]))) AS max_absolute_difference
FROM fx_vec r JOIN ({CANDIDATE}) c ON c.item_id = r.item_id""", doubles=["cosine", "mean_absolute_difference", "max_absolute_difference"])
def _(t):
    return E.vector_parity(t.vec, candidate_of(t))


def flat_top(vecs: str) -> str:
    return f"""SELECT item_id, t[1].c AS top1, t[2].c AS top2, t[1].s AS top1_score, t[2].s AS top2_score, t[1].s - t[2].s AS score_gap FROM (
  SELECT item_id, list(struct_pack(s := s, c := c) ORDER BY s DESC, c) AS t FROM (SELECT v.item_id, d.label AS c, list_inner_product(v.vec, d.vec) AS s FROM ({vecs}) v CROSS JOIN fx_desc d) q GROUP BY item_id) w"""


DRIFT = f"""
SELECT r.item_id, c.top1 <> r.top1 AS top1_changed, c.top2 <> r.top2 AS top2_changed, (c.score_gap + 1e-7 >= 0.01) <> (r.score_gap + 1e-7 >= 0.01) AS threshold_changed,
  abs(c.top1_score - r.top1_score) AS d1, abs(c.top2_score - r.top2_score) AS d2, abs(c.score_gap - r.score_gap) AS d3
FROM ({flat_top('SELECT item_id, vec FROM fx_vec')}) r JOIN ({flat_top(CANDIDATE)}) c ON c.item_id = r.item_id"""


def drift_of(t):
    from tallyspark.operators.categorize import score_items, topk_with_gap

    protos = t.desc.withColumnRenamed("label", "category_id")
    one = topk_with_gap(score_items(t.vec.select("item_id", "vec"), protos))
    two = topk_with_gap(score_items(candidate_of(t).select("item_id", "vec"), protos))
    return E.drift_rows(one, two, 0.01)


@query("e12_drift_report", f"""
SELECT COUNT(*) AS cases, COUNT(*) FILTER (top1_changed) AS top1_change_cases, COUNT(*) FILTER (top2_changed) AS top2_change_cases, COUNT(*) FILTER (threshold_changed) AS threshold_change_cases,
  MAX(d1) AS max_top1_drift, MAX(d2) AS max_top2_drift, MAX(d3) AS max_gap_drift FROM ({DRIFT}) d""", doubles=["max_top1_drift", "max_top2_drift", "max_gap_drift"])
def _(t):
    return E.drift_report(drift_of(t))


@query("e12_drift_targets", " UNION ALL ".join(f"SELECT item_id, '{c}' AS change FROM ({DRIFT}) d WHERE {c}" for c in ("top1_changed", "top2_changed", "threshold_changed")))
def _(t):
    return E.drift_targets(drift_of(t))


LENGTHS = "SELECT 'document' AS role, length(text) AS n FROM documents UNION ALL SELECT 'turn', length(text) FROM conversations UNION ALL SELECT 'name', length(p_name) FROM part"


@query("e13_length_report", f"""
SELECT *, COALESCE(LEAST(CASE WHEN over_100 = 0 THEN 100 END, CASE WHEN over_10000 = 0 THEN 10000 END, CASE WHEN over_1000000 = 0 THEN 1000000 END), 128) AS safe_limit FROM (
  SELECT COUNT(*) AS texts, MAX(n) AS longest, quantile_cont(n, 0.95) AS p95, quantile_cont(n, 0.99) AS p99, COUNT(*) FILTER (n > 100) AS over_100, COUNT(*) FILTER (n > 10000) AS over_10000, COUNT(*) FILTER (n > 1000000) AS over_1000000 FROM ({LENGTHS}) l) x""", doubles=["p95", "p99"])
def _(t):
    parts = [t.raw(n).select(F.length(c).alias("n")) for n, c in (("documents", "text"), ("conversations", "text"), ("part", "p_name"))]
    return E.length_report(parts[0].unionByName(parts[1]).unionByName(parts[2]), [100, 10000, 1000000], 128)


GROUPS = "SELECT item_text, group_id FROM (VALUES ('red widget', 'widget_red'), ('blue bolt', 'bolt_blue'), ('hot gear', 'economy_old_rod')) AS g(item_text, group_id)"
NAMED = "SELECT p_partkey AS item_id, p_name AS item_text, p_type AS category FROM part"


@query("e14_assign_canonical", f"""
SELECT item_id, CASE WHEN group_id IS NOT NULL THEN group_id WHEN n = 1 THEN base ELSE base || '_' || n END AS canonical_id FROM (
  SELECT x.*, ROW_NUMBER() OVER (PARTITION BY base, group_id IS NULL ORDER BY item_id) + CASE WHEN base IN (SELECT group_id FROM ({GROUPS}) t) THEN 1 ELSE 0 END AS n
  FROM (SELECT i.item_id, g.group_id, lower(category) || '_' || replace(i.item_text, ' ', '_') AS base FROM ({NAMED}) i LEFT JOIN ({GROUPS}) g ON g.item_text = i.item_text) x) y""")
def _(t):
    return E.assign_canonical(t.sql(NAMED), t.sql(GROUPS))


@query("e15_leaking_ids", "SELECT p_name AS canonical_id, COUNT(DISTINCT p_type) AS n_categories FROM part GROUP BY p_name HAVING COUNT(DISTINCT p_type) > 1")
def _(t):
    return E.leaking_ids(t.raw("part").select(F.col("p_name").alias("canonical_id"), F.col("p_type").alias("category_id")))


@query("e16_confusion", f"SELECT model, category_id AS expected, {', '.join(f'COUNT(*) FILTER (top1 = {v}) AS {chr(34)}{v}{chr(34)}' for v in range(10))} FROM ({HYBRID}) p GROUP BY model, category_id")
def _(t):
    return E.confusion(pred_of(t), range(10))


@query("e17_distribution", "SELECT label AS category_id, COUNT(*) FILTER (language = 'en') AS en, COUNT(*) FILTER (language = 'ar') AS ar, COUNT(*) FILTER (language = 'mixed') AS mixed FROM fx_vec GROUP BY label")
def _(t):
    return E.distribution(items_of(t), ["en", "ar", "mixed"])


@query("e18_gap_summary", f"SELECT model, top1_correct, COUNT(*) AS n, avg(score_gap) AS mean_gap, median(score_gap) AS median_gap FROM ({HYBRID}) p GROUP BY model, top1_correct", doubles=["mean_gap", "median_gap"])
def _(t):
    return E.gap_summary(keyed.cut(pred_of(t), "predictions"))


@query("e18_least_confident", f"SELECT item_id, score_gap FROM ({HYBRID}) p ORDER BY score_gap, item_id LIMIT 20", doubles=["score_gap"])
def _(t):
    return E.least_confident(pred_of(t), 20).select("item_id", "score_gap")


@query("e19_precision_coverage", f"SELECT model, strategy, minimum_gap, coverage_percentage, accepted_accuracy FROM ({sweep_sql(HYBRID)}) s WHERE threshold_type = 'GAP_ONLY'", doubles=["minimum_gap", "coverage_percentage", "accepted_accuracy"])
def _(t):
    return E.precision_coverage(E.threshold_sweep(pred_of(t)))


@query("e19_slice_metrics", f"SELECT model, strategy, COUNT(*) AS examples, avg({HIT}) AS top1_accuracy, avg(CAST(top3_correct AS INTEGER)) AS top3_accuracy, avg(score_gap) AS average_score_gap FROM ({HYBRID}) p WHERE category_id = 3 GROUP BY model, strategy", doubles=["top1_accuracy", "top3_accuracy", "average_score_gap"])
def _(t):
    return E.slice_metrics(pred_of(t), 3)


@query("src02_read_labelled", f"SELECT CAST(item_id AS VARCHAR) AS item_id, item_text, category FROM ({FUZZY_ITEMS}) i WHERE category IN ('PROMO', 'LARGE')")
def _(t):
    """Labelled rows written as CSV, read back, and the ones with unknown labels."""
    path = work_folder(t.spark, "labelled")
    readers.write_report(t.sql(FUZZY_ITEMS), path, "csv")
    labels = t.sql("SELECT DISTINCT p_type AS category FROM part WHERE p_type NOT IN ('PROMO', 'LARGE')")
    _, unknown = readers.read_labelled(t.spark, path, ["item_id", "item_text", "category"], labels)
    return unknown.select("item_id", "item_text", "category")


@query("snk01_write_report", sweep_sql(HYBRID), doubles=SWEEP_DOUBLES)
def _(t):
    """The threshold sweep written as a CSV report and read back with its schema."""
    path = work_folder(t.spark, "sweep")
    sweep = E.threshold_sweep(pred_of(t))
    readers.write_report(sweep, path, "csv")
    return t.spark.read.schema(sweep.schema).option("header", True).csv(path)
