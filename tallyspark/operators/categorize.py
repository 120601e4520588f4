"""Category suggestion: learned mapping, words, embedding prototypes, abstain."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions import text, vectors
from tallyspark.functions.udfs import seq_ratio
from tallyspark.operators.ranking import active_mappings
from tallyspark.plans import keyed

MERCHANT_CONFIDENCE = 0.98
GENERIC_CONFIDENCE = 0.90
MINIMUM_GAP = 0.01
GAP_EPSILON = 1e-7
TOP_K = 3

# The common columns of a suggestion.
SUGGESTION = ["item_id", "category_id", "confidence", "source"]


def describe(cats: DataFrame, descriptions: Mapping[str, str]) -> DataFrame:
    """Category descriptions; an unknown category is described by its doubled name."""
    known = F.create_map(*[F.lit(x) for pair in descriptions.items() for x in pair])
    return cats.withColumn("description", F.coalesce(F.try_element_at(known, F.col("name")), F.concat_ws(", ", "name", "name")))


def unresolved(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Items without an answer from an earlier stage."""
    return items.join(answers.select("item_id"), "item_id", "left_anti")


# --- learned -----------------------------------------------------------------


def suggest_learned(items: DataFrame, mappings: DataFrame, cats: DataFrame) -> DataFrame:
    """The owner's exact mapping of the item, the merchant's own before the generic one."""
    live = active_mappings(mappings, cats)
    special = live.filter(F.col("normalized_merchant").isNotNull()).select("owner_id", "normalized_item", "normalized_merchant", F.col("category_id").alias("__own"))
    generic = live.filter(F.col("normalized_merchant").isNull()).select("owner_id", "normalized_item", F.col("category_id").alias("__any"))
    x = keyed.pin(items.select("item_id", "owner_id", "item_name", "merchant"), "normalized_item", text.normalize_item(F.col("item_name")))
    x = keyed.pin(x.filter(F.col("normalized_item") != ""), "normalized_merchant", text.normalize_item(F.col("merchant")))
    j = x.join(special, ["owner_id", "normalized_item", "normalized_merchant"], "left").join(generic, ["owner_id", "normalized_item"], "left")
    category = F.coalesce("__own", "__any")
    return j.filter(category.isNotNull()).select(
        "item_id", category.alias("category_id"),
        F.when(F.col("__own").isNotNull(), F.lit(MERCHANT_CONFIDENCE)).otherwise(F.lit(GENERIC_CONFIDENCE)).alias("confidence"),
        F.lit("USER_LEARNED").alias("source"),
    )


# --- lexical -----------------------------------------------------------------


def term_matches(items: DataFrame, terms: DataFrame, cats: DataFrame) -> DataFrame:
    """(item, category, number of the category's terms among the item's words)."""
    live = cats.filter(~F.col("is_archived")).select("category_id")
    words = items.select("item_id", F.explode(text.tokens(text.normalize_item(F.col("item_name")))).alias("term"))
    return words.join(terms.select("term", "category_id").distinct().join(live, "category_id"), "term").groupBy("item_id", "category_id").agg(
        F.count("*").alias("n_terms")
    )


def unique_winner(matches: DataFrame) -> DataFrame:
    """The category with the most terms, only if no other category has as many."""
    tied = matches.groupBy("item_id", "n_terms").agg(F.count("*").alias("__c"), F.min("category_id").alias("__cat"))
    best = tied.groupBy("item_id").agg(F.max(F.struct("n_terms", "__c", "__cat")).alias("b"))
    return best.filter(F.col("b.__c") == 1).select("item_id", F.col("b.__cat").alias("category_id"), F.col("b.n_terms").alias("n_terms"))


def suggest_lexical(items: DataFrame, terms: DataFrame, cats: DataFrame) -> DataFrame:
    won = unique_winner(term_matches(items, terms, cats))
    score = F.least(F.lit(1.0), F.lit(0.75) + (F.col("n_terms") - 1) * F.lit(0.1))
    return won.select("item_id", "category_id", score.alias("confidence"), F.lit("LEXICAL").alias("source"))


# --- semantic ----------------------------------------------------------------


def hybrid_prototypes(descriptions: DataFrame, examples: DataFrame, dim: int | None = None) -> DataFrame:
    """(category, vec): the description, blended half and half with the examples' unit centroid."""
    mean = vectors.centroid(examples, ["category_id"], "vec", dim=dim).select("category_id", "centroid")
    j = descriptions.join(mean, "category_id", "left")
    mixed = vectors.l2_normalize(vectors.blend(F.col("vec"), vectors.l2_normalize(F.col("centroid"))))
    return j.select("category_id", F.when(F.col("centroid").isNull(), F.col("vec")).otherwise(mixed).alias("vec"))


def pack_prototypes(protos: DataFrame, blocks: int = 1) -> DataFrame:
    """Prototypes packed into ``blocks`` rows of about equal size.

    One block suits catalogs up to some thousand categories; more blocks bound
    the size of a packed row for larger ones.
    """
    block = F.pmod(F.xxhash64("category_id"), F.lit(blocks)).cast("int")
    return protos.groupBy(block.alias("block")).agg(F.collect_list(F.struct("category_id", "vec")).alias("protos"))


def score_items(items: DataFrame, protos: DataFrame, blocks: int = 1) -> DataFrame:
    """Adds ``scores``: the dot product with every prototype of a block, best first.

    One row per item and block; the pairs live in an array and are never emitted.
    """
    packed = pack_prototypes(protos, blocks)
    rows = keyed.attach_catalog(items.filter(F.col("vec").isNotNull()), packed, "item_id")
    scored = F.transform("protos", lambda p: F.struct((-vectors.dot(p["vec"], F.col("vec"))).alias("minus"), p["category_id"].alias("category_id")))
    return rows.withColumn("scores", F.array_sort(scored)).drop("protos")


def score_pairs(items: DataFrame, protos: DataFrame) -> DataFrame:
    """The full (item, category, score) matrix in long form."""
    rows = score_items(items, protos).select("item_id", F.explode("scores").alias("s"))
    return rows.select("item_id", F.col("s.category_id").alias("category_id"), (-F.col("s.minus")).alias("score"))


def topk_with_gap(scored: DataFrame, k: int = TOP_K, blocks: int = 1) -> DataFrame:
    """Top-1 and top-2 with their gap (1.0 for a single category) and the top-k as JSON.

    With several blocks each contributes its own k best before the merge.
    """
    best = F.slice("scores", 1, k)
    if blocks == 1:
        top = scored.withColumn("top", best).drop("scores", "block")
    else:
        own = scored.withColumn("top", best).drop("scores", "block")
        rest = [c for c in own.columns if c not in {"item_id", "top"}]
        merged = own.groupBy("item_id").agg(
            F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"), *[F.first(c).alias(c) for c in rest]
        )
        top = merged
    at = lambda i: F.get("top", F.lit(i))
    s1, s2 = -at(0)["minus"], -at(1)["minus"]
    return top.select(
        *[c for c in top.columns if c != "top"],
        at(0)["category_id"].alias("top1"), s1.alias("top1_score"),
        at(1)["category_id"].alias("top2"), s2.alias("top2_score"),
        F.when(at(1).isNull(), F.lit(1.0)).otherwise(s1 - s2).alias("score_gap"),
        F.transform("top", lambda t: t["category_id"]).alias("topk"),
        F.to_json(F.transform("top", lambda t: t["category_id"])).alias("topk_categories"),
        F.to_json(F.transform("top", lambda t: F.round(-t["minus"], 6))).alias("topk_scores"),
    )


#: Bytes of prototype vectors that are broadcast at once; more take a pass for each block.
PROTOTYPE_BYTES = 64 << 20


def _balls(vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(centres, radii, members) of about as many balls as the root of the number of vectors: a few rounds of k-means."""
    m = max(1, int(len(vecs) ** 0.5))
    centres = vecs[np.random.default_rng(7).choice(len(vecs), m, replace=False)]
    for _ in range(6):
        home = np.concatenate([((centres * centres).sum(axis=1) - 2 * vecs[i : i + 4096] @ centres.T).argmin(axis=1) for i in range(0, len(vecs), 4096)])
        used = np.unique(home)
        centres = np.array([vecs[home == c].mean(axis=0) for c in used])
        home = np.searchsorted(used, home)
    members = [np.flatnonzero(home == c) for c in range(len(centres))]
    return centres, np.array([np.linalg.norm(vecs[own] - c, axis=1).max() for own, c in zip(members, centres, strict=True)]), members


def _pruned(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vecs, centres, radii, members = block.value  # ids ascending, so a lower row wins a tie
        for batch in batches:
            x = np.array(batch.column("vec").to_pylist(), float).reshape(batch.num_rows, vecs.shape[1])
            bound = x @ centres.T + np.linalg.norm(x, axis=1)[:, None] * radii + 1e-12
            order = np.argsort(-bound, axis=1, kind="stable")
            score, row = np.full((len(x), k), -np.inf), np.full((len(x), k), len(ids))
            tried, open_ = np.zeros(len(x), np.int64), np.arange(len(x))
            for turn in range(len(centres)):
                nearest = order[open_, turn]
                open_ = open_[bound[open_, nearest] >= score[open_, -1]]  # a ball that cannot reach the k-th best ends the search
                if not len(open_):
                    break
                nearest = order[open_, turn]
                for c in np.unique(nearest).tolist():
                    mine, own = open_[nearest == c], members[c]
                    s = np.concatenate([score[mine], x[mine] @ vecs[own].T], axis=1)
                    r = np.concatenate([row[mine], np.broadcast_to(own, (len(mine), len(own)))], axis=1)
                    best = np.lexsort((r, -s), axis=1)[:, :k]
                    score[mine], row[mine] = np.take_along_axis(s, best, 1), np.take_along_axis(r, best, 1)
                    tried[mine] += len(own)
            top = [[{"minus": -float(v), "category_id": ids[i]} for v, i in zip(*pair, strict=True) if i < len(ids)] for pair in zip(score, row.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(top, pa.list_(pa.struct([("minus", pa.float64()), ("category_id", pa.int64())]))), pa.array(tried)], [*batch.schema.names, "scores", "tried"])

    return run


def nearest_prototypes(items: DataFrame, protos: DataFrame, k: int = TOP_K) -> DataFrame:
    """As ``score_items`` with the ``k`` best of each block of prototypes only, and ``tried``, the products computed.

    Prototypes are gathered into balls. An item looks at the balls in the order of the best score any member could have,
    and stops where that is below its k-th best: exact, and near items' categories are few of many. For some dozens of
    categories ``score_items`` is simpler and as fast.
    """
    spark = items.sparkSession
    rows = items.filter(F.col("vec").isNotNull())
    kind = T.ArrayType(T.StructType([T.StructField("minus", T.DoubleType()), T.StructField("category_id", T.LongType())]))
    schema = T.StructType([*rows.schema.fields, T.StructField("scores", kind), T.StructField("tried", T.LongType()), T.StructField("block", T.IntegerType())])
    out, block, held = None, [], 0

    def passed(block: list) -> DataFrame:
        vecs = np.array([r["vec"] for r in block], float)
        shared = spark.sparkContext.broadcast(([r["category_id"] for r in block], vecs, *_balls(vecs)))
        return rows.mapInArrow(_pruned(shared, k), T.StructType(schema.fields[:-1])).withColumn("block", F.lit(0))

    for r in protos.select(F.col("category_id").cast("long").alias("category_id"), "vec").filter("vec is not null").orderBy("category_id").toLocalIterator():
        if held and held + 8 * len(r["vec"]) > PROTOTYPE_BYTES:
            out, block, held = passed(block) if out is None else out.unionByName(passed(block)), [], 0
        block.append(r)
        held += 8 * len(r["vec"])
    if block:
        out = passed(block) if out is None else out.unionByName(passed(block))
    return spark.createDataFrame([], schema) if out is None else out


def suggest_semantic(items: DataFrame, protos: DataFrame, min_gap: float = MINIMUM_GAP) -> DataFrame:
    """Nearest prototype, if it leads the second by at least ``min_gap``."""
    top = topk_with_gap(score_items(items, protos))
    kept = top.filter(F.col("top1").isNotNull() & (F.col("score_gap") + F.lit(GAP_EPSILON) >= min_gap))
    return kept.select("item_id", F.col("top1").alias("category_id"), F.col("top1_score").alias("confidence"), F.lit("SEMANTIC_MODEL").alias("source"))


def suggest_all(items: DataFrame, mappings: DataFrame, terms: DataFrame, cats: DataFrame, protos: DataFrame, min_gap: float = MINIMUM_GAP) -> DataFrame:
    """Learned, lexical, semantic, abstain; each stage sees only what earlier ones left open.

    The answers of a stage and the items it leaves are read by all later stages,
    so each is written once instead of being recomputed by every one of them.
    """
    learned = keyed.cut(suggest_learned(items, mappings, cats), "learned")
    rest = keyed.cut(unresolved(items, learned), "after-learned")
    lexical = keyed.cut(suggest_lexical(rest, terms, cats), "lexical")
    rest = keyed.cut(unresolved(rest, lexical), "after-lexical")
    live = protos.join(cats.filter(~F.col("is_archived")).select("category_id"), "category_id", "left_semi")
    semantic = keyed.cut(suggest_semantic(rest, live, min_gap), "semantic")
    open_items = unresolved(rest, semantic).select(
        "item_id", F.lit(None).cast("bigint").alias("category_id"), F.lit(None).cast("double").alias("confidence"), F.lit("ABSTAIN").alias("source")
    )
    out = learned.select(*SUGGESTION)
    for part in (lexical, semantic, open_items):
        out = out.unionByName(part.select(*SUGGESTION))
    return out


# --- word and character similarity baseline ----------------------------------


def lexical_score(item: Column, reference: Column) -> Column:
    """0.75 of the better sequence ratio (plain or OCR-folded) plus 0.25 of the token Jaccard."""
    plain = seq_ratio(text.normalize_text(item), text.normalize_text(reference))
    folded = seq_ratio(text.ocr_fold(item), text.ocr_fold(reference))
    return F.greatest(plain, folded) * 0.75 + text.jaccard(text.normalize_text(item), text.normalize_text(reference)) * 0.25


def suggest_fuzzy(items: DataFrame, references: DataFrame, descriptions: DataFrame, k: int = TOP_K) -> DataFrame:
    """Best categories of each item by words and character sequences, leaving its own product out.

    ``items`` (item_id, canonical_id, item_text), ``references`` (category_id,
    canonical_id, reference_text; the labelled examples) and ``descriptions``
    (category_id, description). Each distinct (text, product) is scored once, and
    each distinct pair of texts is compared once.
    """
    asked = items.select("canonical_id", "item_text").distinct()
    refs = references.groupBy("category_id", "canonical_id").agg(F.min("reference_text").alias("reference_text"))
    texts = refs.select("reference_text").distinct()
    packed = texts.groupBy().agg(F.collect_list("reference_text").alias("__refs"))
    item_texts = asked.select("item_text").distinct()
    pairs = keyed.attach_catalog(item_texts, packed, "item_text").select("item_text", F.explode("__refs").alias("reference_text"))
    scored = pairs.withColumn("score", lexical_score(F.col("item_text"), F.col("reference_text")))
    by_product = asked.join(scored, "item_text").join(refs.withColumnRenamed("canonical_id", "__ref_id"), "reference_text")
    kept = by_product.filter(F.col("__ref_id") != F.col("canonical_id"))
    best = kept.groupBy("canonical_id", "item_text", "category_id").agg(F.max("score").alias("score"))
    words = descriptions.groupBy().agg(F.collect_list(F.struct("category_id", "description")).alias("__d"))
    keyword = keyed.attach_catalog(asked, words, "item_text").select("canonical_id", "item_text", F.explode("__d").alias("d"))
    overlap = F.least(F.lit(1.0), text.token_overlap(text.normalize_text(F.col("item_text")), text.normalize_text(F.col("d.description"))) * 0.85)
    by_words = keyword.select("canonical_id", "item_text", F.col("d.category_id").alias("category_id"), overlap.alias("score"))
    total = best.unionByName(by_words).groupBy("canonical_id", "item_text", "category_id").agg(F.max("score").alias("score"))
    top = keyed.top_per_key(total, ["canonical_id", "item_text"], [F.desc("score"), F.asc("category_id")], k, rank="r")
    wide = top.groupBy("canonical_id", "item_text").agg(
        F.max(F.when(F.col("r") == 1, F.col("category_id"))).alias("top1"), F.max(F.when(F.col("r") == 1, F.col("score"))).alias("top1_score"),
        F.max(F.when(F.col("r") == 2, F.col("category_id"))).alias("top2"), F.max(F.when(F.col("r") == 2, F.col("score"))).alias("top2_score"),
        F.transform(F.array_sort(F.collect_list(F.struct("r", "category_id"))), lambda s: s["category_id"]).alias("topk"),
    )
    return items.join(wide, ["canonical_id", "item_text"]).withColumn("score_gap", F.col("top1_score") - F.col("top2_score"))
