"""Category suggestion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.catalog.registry import query
from tallyspark.operators import categorize as C
from tallyspark.sources.category_data import DESCRIPTIONS

DIM = 64
UNIT = "list_transform({0}, lambda x: x / greatest(sqrt(list_inner_product({0}, {0})), 1e-12))"
# Prototypes: each label's description vector blended with its clean items from label 0 to 6.
EX = "SELECT label AS category_id, vec FROM fx_vec WHERE variant_type = 'clean' AND label < 7"
PROTOS = f"""
SELECT category_id, CASE WHEN c IS NULL THEN d ELSE {UNIT.format('mix')} END AS vec
FROM (SELECT *, list_transform(list_zip(d, {UNIT.format('COALESCE(c, d)')}), lambda p: 0.5 * p[1] + 0.5 * p[2]) AS mix
  FROM (SELECT d.label AS category_id, d.vec AS d, e.c FROM fx_desc d LEFT JOIN (SELECT category_id, list(m ORDER BY pos) AS c FROM (
      SELECT category_id, pos, avg(x) AS m FROM (SELECT category_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM ({EX}) a) b GROUP BY category_id, pos) g GROUP BY category_id) e
    ON e.category_id = d.label) y) z"""
SCORED = "SELECT i.item_id, p.category_id, list_inner_product(i.vec, p.vec) AS score FROM ({items}) i CROSS JOIN ({protos}) p"
RANKED = """
SELECT item_id, MAX(category_id) FILTER (r = 1) AS top1, MAX(score) FILTER (r = 1) AS top1_score, MAX(category_id) FILTER (r = 2) AS top2, MAX(score) FILTER (r = 2) AS top2_score,
  COALESCE(MAX(score) FILTER (r = 1) - MAX(score) FILTER (r = 2), 1.0) AS score_gap, CAST(to_json(list(category_id ORDER BY r) FILTER (r <= 3)) AS VARCHAR) AS topk_categories
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY score DESC, category_id) AS r FROM ({scored}) s) t GROUP BY item_id"""
TOPS = RANKED.replace("{scored}", SCORED.format(items="SELECT item_id, vec FROM fx_vec", protos=PROTOS))
LEARNED = """
SELECT i.item_id, COALESCE(s.category_id, g.category_id) AS category_id, CASE WHEN s.category_id IS NOT NULL THEN 0.98 ELSE 0.9 END AS confidence, 'USER_LEARNED' AS source
FROM {items} i LEFT JOIN (SELECT m.* FROM fx_mappings m JOIN fx_cats10 c ON c.category_id = m.category_id AND NOT c.is_archived WHERE normalized_merchant IS NOT NULL) s
  ON s.owner_id = i.owner_id AND s.normalized_item = i.item_name AND s.normalized_merchant = lower(replace(i.merchant, '#', ' '))
LEFT JOIN (SELECT m.* FROM fx_mappings m JOIN fx_cats10 c ON c.category_id = m.category_id AND NOT c.is_archived WHERE normalized_merchant IS NULL) g ON g.owner_id = i.owner_id AND g.normalized_item = i.item_name
WHERE COALESCE(s.category_id, g.category_id) IS NOT NULL"""
MATCHES = """
SELECT i.item_id, l.category_id, COUNT(*) AS n_terms FROM (SELECT item_id, unnest(list_distinct(string_split(item_name, ' '))) AS term FROM {items} i) i
JOIN fx_lexicon l ON l.term = i.term JOIN fx_cats10 c ON c.category_id = l.category_id AND NOT c.is_archived GROUP BY i.item_id, l.category_id"""
WINNER = """
SELECT item_id, category_id, n_terms FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY n_terms DESC) AS r, LEAD(n_terms) OVER (PARTITION BY item_id ORDER BY n_terms DESC) AS nxt
  FROM ({matches}) m) w WHERE r = 1 AND (nxt IS NULL OR nxt < n_terms)"""


def lexical_sql(items: str) -> str:
    won = WINNER.replace("{matches}", MATCHES.replace("{items}", items))
    return f"SELECT item_id, category_id, LEAST(1.0, 0.75 + 0.1 * (n_terms - 1)) AS confidence, 'LEXICAL' AS source FROM ({won}) x"


def examples_of(t):
    return t.vec.filter("variant_type = 'clean' AND label < 7").select(F.col("label").alias("category_id"), "vec")


def protos_of(t):
    return C.hybrid_prototypes(t.desc.withColumnRenamed("label", "category_id"), examples_of(t), dim=DIM)


def learned_items(t):
    return t.items.select("item_id", "owner_id", "item_name", "merchant", "vec")


@query("c01_suggest_learned", LEARNED.replace("{items}", "fx_items"), doubles=["confidence"])
def _(t):
    return C.suggest_learned(learned_items(t), t.mappings, t.cats10)


@query("c02_suggest_lexical", lexical_sql("fx_items"), doubles=["confidence"])
def _(t):
    return C.suggest_lexical(learned_items(t), t.lexicon, t.cats10)


@query("w05_unique_winner", WINNER.replace("{matches}", MATCHES.replace("{items}", "fx_items")))
def _(t):
    return C.unique_winner(C.term_matches(learned_items(t), t.lexicon, t.cats10))


@query("c04_hybrid_prototypes", f"SELECT category_id, pos - 1 AS pos, x FROM (SELECT category_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM ({PROTOS}) p) q", doubles=["x"])
def _(t):
    return protos_of(t).select("category_id", F.posexplode("vec").alias("pos", "x"))


@query("j11_score_pairs", SCORED.format(items="SELECT item_id, vec FROM fx_vec", protos=PROTOS), doubles=["score"])
def _(t):
    return C.score_pairs(t.vec.select("item_id", "vec"), protos_of(t))


@query("w04_topk_with_gap", TOPS, doubles=["top1_score", "top2_score", "score_gap"])
def _(t):
    return C.topk_with_gap(C.score_items(t.vec.select("item_id", "vec"), protos_of(t))).select(
        "item_id", "top1", "top1_score", "top2", "top2_score", "score_gap", "topk_categories")


@query("w04_topk_pruned", TOPS, doubles=["top1_score", "top2_score", "score_gap"])
def _(t):
    """The same by balls of prototypes: products that cannot reach the third best are not computed."""
    return C.topk_with_gap(C.nearest_prototypes(t.vec.select("item_id", "vec"), protos_of(t))).select(
        "item_id", "top1", "top1_score", "top2", "top2_score", "score_gap", "topk_categories")


@query("n17_topk_json", f"SELECT item_id, topk_categories FROM ({TOPS}) x")
def _(t):
    """The same ranking from four prototype blocks, each contributing its own best."""
    blocks = 4
    return C.topk_with_gap(C.score_items(t.vec.select("item_id", "vec"), protos_of(t), blocks), blocks=blocks).select("item_id", "topk_categories")


SEMANTIC = "SELECT item_id, top1 AS category_id, top1_score AS confidence, 'SEMANTIC_MODEL' AS source FROM ({tops}) x WHERE score_gap + 1e-7 >= 0.05"


@query("c03_suggest_semantic", SEMANTIC.replace("{tops}", TOPS), doubles=["confidence"])
def _(t):
    return C.suggest_semantic(t.vec.select("item_id", "vec"), protos_of(t), 0.05)


LIVE_PROTOS = f"SELECT p.* FROM ({PROTOS}) p JOIN fx_cats10 c ON c.category_id = p.category_id AND NOT c.is_archived"
CASCADE = f"""
WITH l AS ({LEARNED.replace('{items}', 'fx_items')}), r1 AS (SELECT * FROM fx_items WHERE item_id NOT IN (SELECT item_id FROM l)),
 x AS ({lexical_sql('r1')}), r2 AS (SELECT * FROM r1 WHERE item_id NOT IN (SELECT item_id FROM x)),
 s AS ({SEMANTIC.replace('{tops}', RANKED.replace('{scored}', SCORED.format(items='SELECT item_id, vec FROM r2 WHERE vec IS NOT NULL', protos=LIVE_PROTOS)))})
SELECT item_id, category_id, confidence, source FROM l UNION ALL SELECT item_id, category_id, confidence, source FROM x UNION ALL SELECT item_id, category_id, confidence, source FROM s
UNION ALL SELECT item_id, NULL, NULL, 'ABSTAIN' FROM r2 WHERE item_id NOT IN (SELECT item_id FROM s)"""


@query("c05_suggest_all", CASCADE, doubles=["confidence"])
def _(t):
    return C.suggest_all(learned_items(t), t.mappings, t.lexicon, t.cats10, protos_of(t), 0.05)


@query("j14_unresolved", f"SELECT item_id, item_name FROM fx_items WHERE item_id NOT IN (SELECT item_id FROM ({LEARNED.replace('{items}', 'fx_items')}) l)")
def _(t):
    return C.unresolved(t.items, C.suggest_learned(learned_items(t), t.mappings, t.cats10)).select("item_id", "item_name")


FUZZY_ITEMS = """SELECT p_partkey AS item_id, p_name AS canonical_id, CASE WHEN p_size > 25 THEN REPLACE(REPLACE(p_name, 'o', '0'), 'l', '1') ELSE p_name END AS item_text, p_type AS category FROM part"""
FUZZY_REFS = "SELECT p_type AS category_id, p_name AS canonical_id, p_name AS reference_text FROM part WHERE p_size <= 10"
FUZZY_DESC = "SELECT DISTINCT p_type AS category_id, CONCAT(LOWER(p_type), ' ', CASE p_type WHEN 'SMALL' THEN 'small ring gear' WHEN 'PROMO' THEN 'red widget bolt' ELSE 'hot anvil' END) AS description FROM part"


def fuzzy_of(t):
    return C.suggest_fuzzy(t.sql(FUZZY_ITEMS), t.sql(FUZZY_REFS), t.sql(FUZZY_DESC))


@query("c06_suggest_fuzzy")
def _(t):
    return fuzzy_of(t).select("item_id", "canonical_id", "item_text", "top1", F.round("top1_score", 6).alias("top1_score"), "top2", F.round("top2_score", 6).alias("top2_score"))


@query("n11_lexical_score")
def _(t):
    return t.raw("part").select("p_partkey", F.round(C.lexical_score(F.col("p_name"), F.lower(F.concat("p_type", F.lit(" "), "p_name"))), 6).alias("score"))


@query("c07_describe", "SELECT category_id, name, name || ', ' || name AS description FROM fx_cats10")
def _(t):
    return C.describe(t.cats10, DESCRIPTIONS).select("category_id", "name", "description")
