"""Search and learned-mapping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.catalog.registry import query
from tallyspark.operators import ledger as L
from tallyspark.operators import ranking as R

KIND = """CASE WHEN trim(query) = '' THEN 'RECENT' WHEN normalized_name = query THEN 'EXACT' WHEN starts_with(normalized_name, query) THEN 'PREFIX' WHEN contains(normalized_name, query) THEN 'CONTAINS'
  WHEN length(query) >= 3 AND levenshtein(normalized_name, query) <= greatest(1, length(query) // 3) THEN 'FUZZY' END"""
CAT_QUERIES = """
SELECT DISTINCT query, CAST(suggested_id AS BIGINT) AS suggested_id FROM (
  SELECT SUBSTR(p_type, 2, 3) AS query, CASE WHEN p_size < 45 THEN p_size % 9 END AS suggested_id FROM part
  UNION ALL SELECT p_type, p_size % 9 FROM part UNION ALL SELECT SUBSTR(p_type, 1, 1), p_size % 5 FROM part UNION ALL SELECT '', p_size % 10 FROM part UNION ALL SELECT ' e ', 1 FROM part) x"""
SELECTIONS = "SELECT tx_id, merchant_id, category_id AS current_category_id FROM fx_tx WHERE type = 'EXPENSE'"
USAGE = """SELECT c.category_id, c.name, COUNT(t.tx_id) AS usage_count, MAX(t.tx_date) AS last_used FROM fx_categories c
LEFT JOIN fx_tx t ON t.category_id = c.category_id AND t.type = 'EXPENSE' WHERE NOT c.is_archived GROUP BY c.category_id, c.name"""


@query("w06_rank_merchants", f"""
SELECT query, merchant_id, display_name, match_kind, r AS position FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY list_position(['EXACT', 'PREFIX', 'CONTAINS', 'FUZZY', 'RECENT'], match_kind), usage_count DESC, last_used_at DESC,
    CASE WHEN source = 'SEEDED' THEN 1 ELSE 0 END, display_name, merchant_id) AS r
  FROM (SELECT q.query, m.*, {KIND} AS match_kind FROM (SELECT DISTINCT trim(query) AS query FROM fx_queries) q CROSS JOIN fx_names m) a WHERE match_kind IS NOT NULL) b WHERE r <= 6""")
def _(t):
    return R.rank_merchants(t.queries, t.names).select("query", "merchant_id", "display_name", "match_kind", "position")


@query("w07_rank_categories", f"""
WITH u AS ({USAGE}), q AS (SELECT DISTINCT lower(trim(query)) AS query, suggested_id FROM ({CAT_QUERIES}) x)
SELECT query, suggested_id, category_id, match_rank, r AS position FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY query, suggested_id ORDER BY match_rank, category_id IS DISTINCT FROM suggested_id, usage_count DESC, last_used DESC NULLS LAST, category_id) AS r
  FROM (SELECT q.query, q.suggested_id, u.*, CASE WHEN query = '' THEN CASE WHEN category_id = suggested_id THEN 0 ELSE 1 END WHEN lower(name) = query THEN 0 WHEN starts_with(lower(name), query) THEN 1 WHEN contains(lower(name), query) THEN 2 END AS match_rank
    FROM q CROSS JOIN u) a WHERE match_rank IS NOT NULL) b WHERE r <= 5""")
def _(t):
    usage = L.categories_for_entry(t.categories, t.tx)
    return R.rank_categories(t.sql(CAT_QUERIES), usage).select("query", "suggested_id", "category_id", "match_rank", "position")


@query("p03_resolve_merchant_category", f"""
SELECT s.tx_id, m.display_name, COALESCE(c.category_id, s.current_category_id) AS category_id FROM ({SELECTIONS}) s JOIN fx_merchants m ON m.merchant_id = s.merchant_id
LEFT JOIN fx_categories c ON c.category_id = m.default_category_id AND NOT c.is_archived""")
def _(t):
    return R.resolve_merchant_category(t.sql(SELECTIONS), t.merchants, t.categories).select("tx_id", "display_name", "category_id")


@query("p04_offer_new_merchant", "SELECT query FROM fx_queries WHERE length(trim(query)) >= 3 AND trim(query) NOT IN (SELECT p_name FROM part WHERE p_name LIKE 'red%')")
def _(t):
    known = t.sql("SELECT DISTINCT p_name AS normalized_name FROM part WHERE p_name LIKE 'red%'")
    return R.offer_new_merchant(t.queries, known).select("query")


MAP = "owner_id, normalized_item, normalized_merchant, category_id, confirmation_count"
MAPC = [c.strip() for c in MAP.split(",")]


@query("j03_active_mappings", f"SELECT {MAP} FROM fx_mappings WHERE category_id IN (SELECT category_id FROM fx_cats10 WHERE NOT is_archived)")
def _(t):
    return R.active_mappings(t.mappings, t.cats10).select(*MAPC)


KEYS = "SELECT CAST(p_partkey % 3 AS BIGINT) AS owner_id, p_name AS normalized_item, CASE WHEN p_size % 2 = 0 THEN LOWER(REPLACE(p_brand, '#', ' ')) END AS normalized_merchant FROM part"


@query("j05_find_mapping", f"""
SELECT m.{MAP.replace(', ', ', m.')} FROM fx_mappings m WHERE EXISTS (SELECT 1 FROM ({KEYS}) k WHERE k.owner_id = m.owner_id AND k.normalized_item = m.normalized_item AND k.normalized_merchant IS NOT DISTINCT FROM m.normalized_merchant)""")
def _(t):
    return R.find_mapping(t.sql(KEYS), t.mappings).select(*MAPC)


@query("j06_confirmed_examples", f"SELECT {MAP} FROM fx_mappings WHERE normalized_merchant IS NULL AND category_id IN (SELECT category_id FROM fx_cats10 WHERE NOT is_archived AND name <> 'K3')")
def _(t):
    return R.confirmed_examples(t.mappings, t.cats10, t.cats10.filter("name <> 'K3'")).select(*MAPC)


@query("us4_distinct_examples", "SELECT DISTINCT normalized_item FROM fx_mappings WHERE normalized_merchant IS NULL")
def _(t):
    return R.distinct_examples(t.mappings)
