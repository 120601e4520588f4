"""Merchant and category search, and the learned-mapping lookups.

Searches never compare every query with every name. Both sides meet on short
substrings: a query is cut into (allowed edits + 1) pieces, so a name within
that distance must contain one of them near its place, and a name that contains
the query must contain its first piece. The exact test runs inside the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.plans import keyed

# Rank order of the match kinds.
MATCH_ORDER = ["EXACT", "PREFIX", "CONTAINS", "FUZZY", "RECENT"]
PIECE_MAX = 3


def _match_rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in MATCH_ORDER]), kind).cast("int") - 1


def _pieces(q: DataFrame, fuzzy: bool) -> DataFrame:
    """(query, piece_no, piece_at, piece): the query cut into pieces of at most three characters."""
    n = F.length("query")
    count = F.when(n >= 3, text.fuzzy_limit(F.col("query")) + 1).otherwise(F.lit(1))
    if not fuzzy:
        return q.withColumns({"piece_no": F.lit(0), "piece_at": F.lit(0), "piece": F.substring("query", 1, PIECE_MAX)})
    cut = q.withColumn("__n", count).withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    at = F.floor(F.col("piece_no") * n / F.col("__n")).cast("int")
    end = F.floor((F.col("piece_no") + 1) * n / F.col("__n")).cast("int")
    cut = cut.withColumn("piece_at", at)
    return cut.withColumn("piece", F.col("query").substr(F.col("piece_at") + 1, end - F.col("piece_at"))).drop("__n")


def _substrings(names: DataFrame, name: str) -> DataFrame:
    """(…, sub, sub_at): every substring of one to three characters of each name."""
    size = F.length(name)
    at = names.withColumn("sub_at", F.explode(F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))))
    at = at.withColumn("__len", F.explode(F.array(*[F.lit(i) for i in range(1, PIECE_MAX + 1)])))
    at = at.filter(F.col("sub_at") + F.col("__len") <= size)
    return at.withColumn("sub", F.col(name).substr(F.col("sub_at") + 1, F.col("__len"))).drop("__len")


def _recency() -> list[Column]:
    return [F.desc("usage_count"), F.desc("last_used_at"), F.when(F.col("source") == "SEEDED", 1).otherwise(0).asc(), F.asc("display_name"), F.asc("merchant_id")]


def rank_merchants(queries: DataFrame, merchants: DataFrame, k: int = 6) -> DataFrame:
    """Best ``k`` merchants of each distinct query: kind, usage, last use, user before seeded, name.

    ``queries`` has ``query``; ``merchants`` has the columns of the merchants table.
    """
    cols = ["merchant_id", "display_name", "normalized_name", "usage_count", "last_used_at", "source"]
    q = queries.select(text.normalize_merchant(F.col("query")).alias("query")).distinct()
    typed = _pieces(q.filter(F.trim("query") != ""), fuzzy=True)
    subs = _substrings(merchants.select(*cols), "normalized_name")
    near = F.abs(F.col("sub_at") - F.col("piece_at")) <= text.fuzzy_limit(F.col("query"))
    kind = text.match_kind(F.col("query"), F.col("normalized_name"))
    hits = typed.join(subs, (F.col("piece") == F.col("sub")) & ((F.col("piece_no") == 0) | near) & kind.isNotNull())
    pairs = hits.select("query", *cols).dropDuplicates(["query", "merchant_id"]).withColumn("match_kind", kind)
    # A blank query shows the most recent merchants: k rows of the whole table.
    recent = merchants.select(*cols).orderBy(*_recency()).limit(k).withColumn("match_kind", F.lit("RECENT"))
    blank = keyed.attach_catalog(q.filter(F.trim("query") == ""), recent, "query").select("query", *cols, "match_kind")
    order = [_match_rank(F.col("match_kind")).asc(), *_recency()]
    return keyed.top_per_key(pairs.unionByName(blank), ["query"], order, k, rank="position")


def offer_new_merchant(queries: DataFrame, merchants: DataFrame, minimum: int = 3) -> DataFrame:
    """Queries long enough that match no merchant exactly."""
    q = queries.withColumn("normalized_name", text.normalize_merchant(F.col("query"))).filter(F.length("normalized_name") >= minimum)
    return q.join(merchants.select("normalized_name"), "normalized_name", "left_anti")


def resolve_merchant_category(selections: DataFrame, merchants: DataFrame, cats: DataFrame) -> DataFrame:
    """The merchant's default category if it is active, else the current one."""
    m = merchants.select("merchant_id", "display_name", "default_category_id")
    live = cats.filter(~F.col("is_archived")).select(F.col("category_id").alias("__live"))
    j = selections.join(m, "merchant_id").join(live, F.col("default_category_id") == F.col("__live"), "left")
    return j.withColumn("category_id", F.coalesce("__live", "current_category_id")).drop("__live")


def rank_categories(queries: DataFrame, usage: DataFrame, k: int = 5) -> DataFrame:
    """Best ``k`` active categories per (query, suggested id): match, suggested first, usage order.

    ``usage`` is the output of ``categories_for_entry``.
    """
    q = queries.select(text.normalize_search(F.col("query")).alias("query"), "suggested_id").distinct()
    names = usage.withColumn("normalized", text.normalize_search(F.col("name")))
    order_cols = ["category_id", "name", "usage_count", "last_used", "normalized"]
    subs = _substrings(names.select(*order_cols), "normalized")
    typed = _pieces(q.filter(F.col("query") != ""), fuzzy=False)
    n, query = F.col("normalized"), F.col("query")
    hits = typed.join(subs, (F.col("piece") == F.col("sub")) & n.contains(query))
    rank = F.when(n == query, 0).when(n.startswith(query), 1).otherwise(2)
    named = hits.select("query", "suggested_id", *order_cols).dropDuplicates(["query", "suggested_id", "category_id"]).withColumn("match_rank", rank)
    by_use = [F.desc("usage_count"), F.desc_nulls_last("last_used"), F.asc("category_id")]
    blank = q.filter(query == "")
    top = names.select(*order_cols).orderBy(*by_use).limit(k)
    own = names.select(*order_cols).withColumn("__id", F.col("category_id"))
    shown = keyed.attach_catalog(blank, top, "suggested_id").unionByName(
        blank.join(own, F.col("suggested_id") == F.col("__id")).drop("__id")
    ).dropDuplicates(["suggested_id", "category_id"])
    shown = shown.withColumn("match_rank", F.when(F.col("category_id").eqNullSafe(F.col("suggested_id")), 0).otherwise(1))
    suggested_last = F.when(F.col("category_id").eqNullSafe(F.col("suggested_id")), 0).otherwise(1)
    order = [F.asc("match_rank"), suggested_last.asc(), *by_use]
    return keyed.top_per_key(named.unionByName(shown), ["query", "suggested_id"], order, k, rank="position").drop("normalized")


# --- learned mappings --------------------------------------------------------


def active_mappings(mappings: DataFrame, cats: DataFrame) -> DataFrame:
    """Mappings whose category is not archived."""
    return mappings.join(cats.filter(~F.col("is_archived")).select("category_id"), "category_id", "left_semi")


def find_mapping(keys: DataFrame, mappings: DataFrame) -> DataFrame:
    """The owner's mapping of each (item, merchant) key; a null merchant is a key of its own."""
    m = mappings.alias("m")
    k = keys.select("owner_id", "normalized_item", "normalized_merchant").distinct().alias("k")
    on = (F.col("k.owner_id") == F.col("m.owner_id")) & (F.col("k.normalized_item") == F.col("m.normalized_item")) & F.col("k.normalized_merchant").eqNullSafe(F.col("m.normalized_merchant"))
    return k.join(m, on).select("m.*")


def confirmed_examples(mappings: DataFrame, cats: DataFrame, wanted: DataFrame) -> DataFrame:
    """Generic mappings of the wanted active categories, newest first per category."""
    generic = mappings.filter(F.col("normalized_merchant").isNull())
    kept = active_mappings(generic, cats).join(wanted.select("category_id").distinct(), "category_id", "left_semi")
    return kept.orderBy("category_id", F.desc("updated_at"), "normalized_item")


def distinct_examples(mappings: DataFrame) -> DataFrame:
    """The texts to embed, each once."""
    return mappings.filter(F.col("normalized_merchant").isNull()).select("normalized_item").distinct()
