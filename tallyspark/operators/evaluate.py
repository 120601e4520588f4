"""Evaluation of category suggestions: leave-one-product-out predictions, metrics and thresholds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import text, vectors
from tallyspark.operators.categorize import topk_with_gap
from tallyspark.plans import keyed

STRATEGIES = ["DESCRIPTION_ONLY", "EXAMPLE_CENTROID", "HYBRID_PROTOTYPE"]
# The thresholds of the sweep.
GAP_THRESHOLDS = [0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.08, 0.10, 0.12, 0.15, 0.20]
SCORE_THRESHOLDS = [0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90]
SAFE_ACCURACY = 0.90


# --- reference vectors and predictions ---------------------------------------


def canonical_refs(clean: DataFrame, dim: int | None = None) -> DataFrame:
    """One unit vector per (category, product): the mean of its clean variants."""
    mean = vectors.centroid(clean, ["category_id", "canonical_id"], "vec", dim=dim)
    return mean.select("category_id", "canonical_id", vectors.l2_normalize(F.col("centroid")).alias("ref_vec"))


def class_sums(refs: DataFrame, dim: int | None = None) -> DataFrame:
    """(category, class_sum, class_n): the sum and number of its product vectors."""
    return vectors.vector_sums(refs, ["category_id"], "ref_vec", out="class_sum", n="class_n", dim=dim)


def loo_prototypes(items: DataFrame, refs: DataFrame, dim: int | None = None, sums: DataFrame | None = None) -> DataFrame:
    """Per item the unit centroid of its category's other products (null when there is none).

    Leaving one out is class sum minus own vector, so no item meets the other
    products. ``sums`` may pass the class sums in when they are known.
    """
    if sums is None:
        sums = class_sums(refs, dim)
    own = refs.select("category_id", "canonical_id", F.col("ref_vec").alias("own_vec"))
    j = items.join(own, ["category_id", "canonical_id"], "left").join(sums, "category_id", "left")
    others = F.coalesce("class_n", F.lit(0)) - F.when(F.col("own_vec").isNotNull(), 1).otherwise(0)
    left = F.when(F.col("own_vec").isNull(), F.col("class_sum")).otherwise(vectors.subtract(F.col("class_sum"), F.col("own_vec")))
    return j.withColumn("n_others", others).withColumn(
        "loo_centroid", F.when(F.col("n_others") > 0, vectors.l2_normalize(left))
    ).drop("own_vec", "class_sum", "class_n")


def _prototype(description: Column, centroid: Column, strategy: str) -> Column:
    if strategy == "DESCRIPTION_ONLY":
        return description
    filled = F.coalesce(centroid, description)
    if strategy == "EXAMPLE_CENTROID":
        return filled
    if strategy == "HYBRID_PROTOTYPE":
        return vectors.l2_normalize(vectors.blend(description, filled))
    raise ValueError(f"unknown strategy {strategy}")


def predict(items: DataFrame, descriptions: DataFrame, refs: DataFrame, strategy: str, model: str = "default", dim: int | None = None) -> DataFrame:
    """Top-3 prediction of every item, its own product left out of its category's prototype.

    Only the item's own category depends on the item; every other prototype comes
    from one packed catalog row.
    """
    sums = class_sums(refs, dim)
    whole = descriptions.join(sums, "category_id", "left")
    centroid = F.when(F.col("class_n") > 0, vectors.l2_normalize(F.col("class_sum")))
    full = whole.select("category_id", _prototype(F.col("vec"), centroid, strategy).alias("vec"))
    packed = full.groupBy().agg(F.collect_list(F.struct("category_id", "vec")).alias("protos"))
    own_desc = descriptions.select("category_id", F.col("vec").alias("own_desc"))
    own = loo_prototypes(items, refs, dim, sums).join(own_desc, "category_id", "left")
    own = own.withColumn("own_proto", _prototype(F.col("own_desc"), F.col("loo_centroid"), strategy)).drop("own_desc", "loo_centroid", "n_others")
    rows = keyed.attach_catalog(own, packed, "item_id").withColumn("own_score", vectors.dot(F.col("own_proto"), F.col("vec")))
    score = lambda p: F.when(p["category_id"] == F.col("category_id"), F.col("own_score")).otherwise(vectors.dot(p["vec"], F.col("vec")))
    scored = rows.withColumn("scores", F.array_sort(F.transform("protos", lambda p: F.struct((-score(p)).alias("minus"), p["category_id"].alias("category_id")))))
    top = topk_with_gap(scored.drop("protos", "own_proto", "own_score"))
    return top.withColumns({
        "model": F.lit(model), "strategy": F.lit(strategy),
        "top1_correct": F.col("top1") == F.col("category_id"),
        "top3_correct": F.array_contains("topk", F.col("category_id")),
    }).drop("vec", "topk")


def stack_predictions(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# --- metrics -----------------------------------------------------------------

CONFIG = ["model", "strategy"]


def _rate(flag: Column) -> Column:
    return F.avg(flag.cast("int"))


def overall_metrics(pred: DataFrame) -> DataFrame:
    hit, gap = F.col("top1_correct"), F.col("score_gap")
    return pred.groupBy(*CONFIG).agg(
        F.count("*").alias("examples"), _rate(hit).alias("top1_accuracy"), _rate(F.col("top3_correct")).alias("top3_accuracy"),
        F.avg(F.when(hit, gap)).alias("mean_gap_correct"), F.avg(F.when(~hit, gap)).alias("mean_gap_incorrect"),
        F.corr(gap, hit.cast("double")).alias("gap_correctness_correlation"),
    )


def group_metrics(pred: DataFrame, dims: Sequence[str] = ("language", "variant_type", "category_id")) -> DataFrame:
    """Accuracy per value of each dimension, one frame, one pass (grouping sets)."""
    x = pred
    for d in dims:
        x = x.withColumn(d, F.col(d).cast("string"))
    sets = [[*CONFIG, d] for d in dims]
    out = x.groupingSets(sets, *CONFIG, *dims).agg(
        F.count("*").alias("examples"), _rate(F.col("top1_correct")).alias("top1_accuracy"),
        _rate(F.col("top3_correct")).alias("top3_accuracy"), F.avg("score_gap").alias("average_score_gap"),
        *[F.grouping(d).alias(f"__g_{d}") for d in dims],
    )
    dimension, group = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d in dims:
        here = F.col(f"__g_{d}") == 0
        dimension, group = F.when(here, F.lit(d)).otherwise(dimension), F.when(here, F.col(d)).otherwise(group)
    return out.select(*CONFIG, dimension.alias("dimension"), group.alias("group"), "examples", "top1_accuracy", "top3_accuracy", "average_score_gap")


def config_metrics(pred: DataFrame, languages: Sequence[str], variants: Sequence[str], categories: Sequence) -> DataFrame:
    """One wide accuracy row per configuration."""
    hit = F.col("top1_correct").cast("int")
    cols = [F.avg(hit).alias("overall_top1"), _rate(F.col("top3_correct")).alias("overall_top3")]
    cols += [F.avg(F.when(F.col("language") == v, hit)).alias(f"{v}_top1") for v in languages]
    cols += [F.avg(F.when(F.col("variant_type") == v, hit)).alias(f"{v}_top1") for v in variants]
    cols += [F.avg(F.when(F.col("category_id") == v, hit)).alias(f"category_{v}_top1") for v in categories]
    return pred.groupBy(*CONFIG).agg(*cols)


def threshold_sweep(pred: DataFrame, gaps: Sequence[float] = GAP_THRESHOLDS, scores: Sequence[float] = SCORE_THRESHOLDS) -> DataFrame:
    """Accepted, abstained, coverage and accuracy at every gap, and at every score and gap.

    Predictions are first counted per (thresholds reached by gap, by score), at
    most a few hundred cells; only the cells meet the grid.
    """
    reached = lambda c, ts: F.size(F.filter(F.array(*[F.lit(float(x)) for x in ts]), lambda x: F.col(c) >= x))
    cells = pred.groupBy(*CONFIG, reached("score_gap", gaps).alias("g"), reached("top1_score", scores).alias("s")).agg(
        F.count("*").alias("n"), F.count_if("top1_correct").alias("hits")
    )
    only = [F.struct(F.lit("GAP_ONLY").alias("threshold_type"), F.lit(None).cast("double").alias("minimum_score"), F.lit(float(g)).alias("minimum_gap"),
                     F.lit(0).alias("si"), F.lit(i + 1).alias("gi")) for i, g in enumerate(gaps)]
    both = [F.struct(F.lit("SCORE_AND_GAP").alias("threshold_type"), F.lit(float(s)).alias("minimum_score"), F.lit(float(g)).alias("minimum_gap"),
                     F.lit(j + 1).alias("si"), F.lit(i + 1).alias("gi")) for j, s in enumerate(scores) for i, g in enumerate(gaps)]
    grid = cells.withColumn("t", F.explode(F.array(*only, *both)))
    ok = (F.col("g") >= F.col("t.gi")) & (F.col("s") >= F.col("t.si"))
    out = grid.groupBy(*CONFIG, "t.threshold_type", "t.minimum_score", "t.minimum_gap").agg(
        F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("accepted"), F.sum(F.when(ok, F.col("hits")).otherwise(0)).alias("hits"), F.sum("n").alias("n")
    )
    a = F.col("accepted")
    return out.select(
        *CONFIG, "threshold_type", "minimum_score", "minimum_gap", a.alias("accepted"), (F.col("n") - a).alias("abstained"),
        (a * 100.0 / F.col("n")).alias("coverage_percentage"), F.when(a > 0, F.col("hits") / a).alias("accepted_accuracy"),
        (a - F.col("hits")).alias("incorrect_accepted"),
    )


def best_threshold(sweep: DataFrame, safe: float = SAFE_ACCURACY) -> DataFrame:
    """Per model the widest coverage with safe accuracy, then the best accuracy."""
    ok = sweep.filter((F.col("accepted_accuracy") >= safe) & (F.col("accepted") > 0))
    order = [F.desc("coverage_percentage"), F.desc("accepted_accuracy"), F.asc_nulls_first("minimum_score"), F.asc("minimum_gap"), F.asc("strategy")]
    return keyed.top_per_key(ok, ["model"], order, 1)


def errors(pred: DataFrame) -> DataFrame:
    return pred.filter(~F.col("top1_correct")).select(
        "item_id", "canonical_id", F.col("category_id").alias("expected_category"), F.col("top1").alias("predicted_category"),
        F.col("top1_score").alias("predicted_score"), F.col("top2").alias("second_best_category"), F.col("top2_score").alias("second_best_score"),
        "score_gap", "language", "variant_type", *CONFIG,
    )


def precision_coverage(sweep: DataFrame) -> DataFrame:
    """The gap-only points of the sweep, by coverage."""
    return sweep.filter(F.col("threshold_type") == "GAP_ONLY").select(*CONFIG, "minimum_gap", "coverage_percentage", "accepted_accuracy").orderBy(*CONFIG, "coverage_percentage")


def slice_metrics(pred: DataFrame, category) -> DataFrame:
    return pred.filter(F.col("category_id") == category).groupBy(*CONFIG).agg(
        F.count("*").alias("examples"), _rate(F.col("top1_correct")).alias("top1_accuracy"),
        _rate(F.col("top3_correct")).alias("top3_accuracy"), F.avg("score_gap").alias("average_score_gap"),
    )


def confusion(pred: DataFrame, labels: Sequence) -> DataFrame:
    """Expected by predicted counts per model, zero-filled."""
    return pred.groupBy("model", F.col("category_id").alias("expected")).pivot("top1", list(labels)).count().fillna(0)


def distribution(items: DataFrame, languages: Sequence[str]) -> DataFrame:
    return items.groupBy("category_id").pivot("language", list(languages)).count().fillna(0)


def gap_summary(pred: DataFrame) -> DataFrame:
    """Count, mean and exact median gap of correct and incorrect predictions."""
    keys = ["model", "top1_correct"]
    base = pred.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("score_gap").alias("mean_gap"))
    return base.join(keyed.exact_median(pred, keys, "score_gap", "median_gap"), keys, "left")


def least_confident(pred: DataFrame, n: int) -> DataFrame:
    """The ``n`` predictions with the smallest gap (a top-k report)."""
    return pred.orderBy("score_gap", "item_id").limit(n)


def cascade_report(lexical: DataFrame, semantic: DataFrame, best: DataFrame, lexical_model: str) -> DataFrame:
    """Coverage and accuracy when lexical accepts first and a semantic model takes the rest."""
    limits = best.select("model", F.col("minimum_gap").alias("__gap"), F.col("minimum_score").alias("__score"))

    def judged(df: DataFrame) -> DataFrame:
        ok = (F.col("score_gap") >= F.col("__gap")) & (F.col("__score").isNull() | (F.col("top1_score") >= F.col("__score")))
        return df.join(limits, "model").withColumn("ok", ok)

    lex = judged(lexical.filter(F.col("model") == lexical_model)).select("item_id", F.col("ok").alias("lex_ok"), F.col("top1_correct").alias("lex_hit"))
    sem = judged(semantic).select("item_id", F.col("model").alias("semantic_model"), F.col("ok").alias("sem_ok"), F.col("top1_correct").alias("sem_hit"))
    j = sem.join(lex, "item_id").withColumn("sem_ok", F.col("sem_ok") & ~F.col("lex_ok"))
    hit = (F.col("lex_ok") & F.col("lex_hit")) | (F.col("sem_ok") & F.col("sem_hit"))
    out = j.groupBy("semantic_model").agg(
        F.count("*").alias("n"), F.count_if(F.col("lex_ok") | F.col("sem_ok")).alias("accepted"), F.count_if(hit).alias("hits"),
        F.count_if("lex_ok").alias("lexical_accepted"), F.count_if("sem_ok").alias("semantic_accepted_after_lexical"),
    )
    return out.select(
        "semantic_model", "accepted", (F.col("accepted") * 100.0 / F.col("n")).alias("coverage_percentage"),
        F.when(F.col("accepted") > 0, F.col("hits") / F.col("accepted")).alias("accepted_accuracy"),
        (F.col("accepted") - F.col("hits")).alias("incorrect_accepted"), "lexical_accepted", "semantic_accepted_after_lexical",
    )


# --- parity, drift and lengths -----------------------------------------------


def vector_parity(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Similarity and absolute differences of two embeddings of the same items."""
    j = reference.select("item_id", F.col("vec").alias("r")).join(candidate.select("item_id", F.col("vec").alias("c")), "item_id")
    gap = F.zip_with("r", "c", lambda x, y: F.abs(y - x))
    return j.select(
        "item_id", vectors.cosine(F.col("r"), F.col("c")).alias("cosine"),
        (F.aggregate(gap, F.lit(0.0), lambda s, x: s + x) / F.size("r")).alias("mean_absolute_difference"), F.array_max(gap).alias("max_absolute_difference"),
    )


def drift_rows(reference: DataFrame, candidate: DataFrame, min_gap: float) -> DataFrame:
    """Per item what a changed embedding changes."""
    cols = ["item_id", "top1", "top2", "top1_score", "top2_score", "score_gap"]
    r = reference.select("item_id", *[F.col(c).alias(f"r_{c}") for c in cols[1:]])
    j = r.join(candidate.select(*cols), "item_id")
    ok = lambda c: F.col(c) + 1e-7 >= min_gap
    return j.select(
        "item_id", (F.col("top1") != F.col("r_top1")).alias("top1_changed"), (~F.col("top2").eqNullSafe(F.col("r_top2"))).alias("top2_changed"),
        (ok("score_gap") != ok("r_score_gap")).alias("threshold_changed"),
        *[F.abs(F.col(c) - F.col(f"r_{c}")).alias(f"{c}_drift") for c in cols[3:]],
    )


def drift_report(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("cases"), F.count_if("top1_changed").alias("top1_change_cases"), F.count_if("top2_changed").alias("top2_change_cases"),
        F.count_if("threshold_changed").alias("threshold_change_cases"), F.max("top1_score_drift").alias("max_top1_drift"),
        F.max("top2_score_drift").alias("max_top2_drift"), F.max("score_gap_drift").alias("max_gap_drift"),
    )


def drift_targets(rows: DataFrame) -> DataFrame:
    """The affected items, one row per kind of change."""
    kinds = F.filter(F.array(*[F.when(F.col(c), F.lit(c)) for c in ("top1_changed", "top2_changed", "threshold_changed")]), lambda x: x.isNotNull())
    return rows.select("item_id", F.explode(kinds).alias("change"))


def length_report(lengths: DataFrame, limits: Sequence[int], fallback: int) -> DataFrame:
    """Longest, p95 and p99 length, texts beyond each limit, and the smallest limit nothing exceeds.

    ``lengths`` has role and n. The exact percentile keeps one counter per
    distinct length.
    """
    over = [F.count_if(F.col("n") > x).alias(f"over_{x}") for x in limits]
    out = lengths.agg(
        F.count("*").alias("texts"), F.max("n").alias("longest"), F.percentile("n", F.lit(0.95)).alias("p95"), F.percentile("n", F.lit(0.99)).alias("p99"), *over
    )
    safe = F.least(*[F.when(F.col(f"over_{x}") == 0, F.lit(x)) for x in limits]) if len(limits) > 1 else F.when(F.col(f"over_{limits[0]}") == 0, F.lit(limits[0]))
    return out.withColumn("safe_limit", F.coalesce(safe, F.lit(fallback)))


# --- product ids -------------------------------------------------------------


def assign_canonical(items: DataFrame, groups: DataFrame, slot_size: int = 65536) -> DataFrame:
    """Product id per row: the group of its text, else ``category_slug`` with ``_2``, ``_3`` … on repeats.

    ``items`` (item_id in row order, item_text, category), ``groups`` (item_text,
    group_id). Repeats are numbered in two levels, so one slug may hold most rows.
    """
    known = groups.select("item_text", "group_id")
    rows = items.join(known, "item_text", "left")
    body = text.slug(F.col("item_text"))
    cat = F.trim(F.regexp_replace(F.lower("category"), r"[^a-z0-9]+", "_"), F.lit("_"))
    rows = rows.withColumn("base", F.concat_ws("_", cat, F.when(body == "", F.col("item_id").cast("string")).otherwise(body)))
    open_rows = rows.filter(F.col("group_id").isNull()).withColumn("slot", F.floor(F.col("item_id") / slot_size))
    numbered = keyed.number_rows(open_rows, ["base"], "slot", [F.asc("item_id")], "n")
    taken = groups.select(F.col("group_id").alias("base"), F.lit(1).alias("taken")).distinct()
    numbered = numbered.join(taken, "base", "left").withColumn("n", F.col("n") + F.coalesce("taken", F.lit(0)) + 1)
    made = F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("n").cast("string")))
    fresh = numbered.select("item_id", made.alias("canonical_id"))
    return rows.filter(F.col("group_id").isNotNull()).select("item_id", F.col("group_id").alias("canonical_id")).unionByName(fresh)


def leaking_ids(items: DataFrame) -> DataFrame:
    """Products found in more than one category."""
    pairs = items.select("canonical_id", "category_id").distinct()
    return pairs.groupBy("canonical_id").agg(F.count("*").alias("n_categories")).filter(F.col("n_categories") > 1)


# --- few-shot evaluation -----------------------------------------------------


def k_reference_sets(refs: DataFrame, k: int, spread: int = 1) -> DataFrame:
    """Every k-subset of each category's products, as ascending positions ``members``.

    Positions index the category's sorted product ids (``ids``). The sets are
    unfolded level by level from the number of products; only the beginnings of
    ``spread`` members are shuffled, and each is unfolded to its end where it is.
    C(n, k) rows are the operator's result, C(n, spread) short ones its shuffle.
    """
    spark = refs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    packed = refs.groupBy("category_id").agg(F.array_sort(F.collect_set("canonical_id")).alias("ids"))
    rows = packed.select("category_id", F.size("ids").alias("n"), F.array().cast("array<int>").alias("members"))
    for level in range(k):
        start = F.lit(0) if level == 0 else F.element_at("members", -1) + 1
        last = F.col("n") - (k - level)
        nxt = F.explode(F.when(last >= start, F.sequence(start, last)).otherwise(F.array().cast("array<int>")))
        rows = rows.withColumn("__next", nxt).withColumn("members", F.concat("members", F.array("__next"))).drop("__next")
        if level + 1 == min(spread, k):
            rows = rows.repartition(tasks)  # a number, or few short rows would be put together again
    return rows.select("category_id", "members")


#: Items of the category that are broadcast at once (a vector and two numbers each); more take a pass for each block.
ITEM_BLOCK = 50_000
#: Bytes of a category's product vectors; C(n, k) sets of so many products would not end anyway.
REFERENCE_BYTES = 64 << 20
#: Scores (8 bytes each) that a task holds at once.
SCORES = 4 << 20


def _tails(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(members, containing, first): the sets of the last ``size`` (1 or 2) members of n, by first member; for each product the
    sets that contain it; and the first set whose members are all at or after each product."""
    members = np.arange(n)[:, None] if size == 1 else np.column_stack(np.triu_indices(n, 1))
    containing = np.array([np.flatnonzero((members == p).any(axis=1)) for p in range(n)]).reshape(n, -1)
    return members, containing, np.searchsorted(members[:, 0], np.arange(n + 1))


def _hits(block, k: int):
    """Counts the hits of all sets that begin with the given members.

    A set S of products has the prototype of d and c = R/|R|, R the sum of its vectors. Multiplied by its length, its score
    of an item x reaches the best other score b exactly if x.R + (x.d) L - b L sqrt(d.d + 2 d.R/L + 1) >= 0 with L = |R|:
    linear in numbers of the item alone. So all sets with the same first members meet all items in one matrix product.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs, d, own, items = block.value
        n, dd = len(refs), float(d @ d)
        members, containing, first = _tails(n, min(k, 2))
        sums = refs[members].sum(axis=1)
        for batch in batches:
            hits = 0
            for head in batch.column("members").to_pylist():
                start = head[-1] + 1 if head else 0
                total = sums[first[start] :] + refs[head].sum(axis=0)
                p = len(total)
                if not p:
                    continue
                length = np.sqrt(np.maximum((total * total).sum(axis=1), 1e-24))
                sets = np.column_stack([total, length, length * np.sqrt(dd + 2 * (total @ d) / length + 1)])
                step = max(1, SCORES // p)
                for i in range(0, len(items), step):
                    mine, block_items = own[i : i + step], items[i : i + step]
                    reached = np.zeros((p + 1, len(mine)), bool)  # a last row for sets that are not among these
                    np.greater_equal(sets @ block_items.T, 0, out=reached[:p])
                    free = ~np.isin(mine, head)
                    count = reached.sum(axis=0)
                    known = np.flatnonzero(free & (mine >= 0))
                    with_own = containing[mine[known]] - first[start]
                    count[known] -= reached[np.where(with_own >= 0, with_own, p), known[:, None]].sum(axis=1)
                    hits += int(count[free].sum())
            yield pa.RecordBatch.from_arrays([pa.array([hits], pa.int64())], ["hits"])

    return run


def _spread(n: int, members: int, enough: int) -> int:
    """How many members of a set's beginning are dealt to tasks: as few as make ``enough`` beginnings."""
    return next((i for i in range(1, members) if comb(n, i) >= enough), max(1, members))


def kshot_eval(items: DataFrame, descriptions: DataFrame, refs: DataFrame, category, ks: Sequence[int] = (0, 1, 3, 5)) -> DataFrame:
    """Accuracy of a new category with k confirmed products, over all eligible reference sets of each item.

    A set of k products does not hold the item's own. Sets are spread by as few of their first members as keep all tasks busy
    and unfolded to k - 2 where they are; the last two are tried against all items in one matrix product. Trials are counted by binomials. The category's product vectors are on every
    executor (``REFERENCE_BYTES``), its items in blocks of ``ITEM_BLOCK``; rows of the sets stay where they are.
    """
    spark = items.sparkSession
    mine = refs.filter(F.col("category_id") == category).select("category_id", "canonical_id", "ref_vec")
    own_desc = descriptions.filter(F.col("category_id") == category).select(F.col("vec").alias("d"))
    others = descriptions.filter(F.col("category_id") != category).groupBy().agg(F.collect_list("vec").alias("others"))  # a vector a category
    size = mine.agg(F.coalesce(F.sum(8 * F.size("ref_vec")), F.lit(0))).first()[0]
    if size > REFERENCE_BYTES:
        raise ValueError(f"{size} bytes of product vectors: their sets cannot be enumerated")
    known = mine.orderBy("canonical_id").collect()
    number = spark.createDataFrame([(r["canonical_id"], i) for i, r in enumerate(known)], "canonical_id STRING, own INT")
    own = items.filter(F.col("category_id") == category).join(F.broadcast(number), "canonical_id", "left")
    asked = keyed.attach_catalog(keyed.attach_catalog(own, own_desc, "item_id"), others, "item_id").select(
        F.coalesce("own", F.lit(-1)).alias("own"), "vec", "d", vectors.dot(F.col("d"), F.col("vec")).alias("dx"), F.array_max(F.transform("others", lambda o: vectors.dot(o, F.col("vec")))).alias("bar"))
    asked = keyed.cut(asked, "asked")
    n_known, n_free, zero_hits = asked.agg(F.count_if(F.col("own") >= 0), F.count_if(F.col("own") < 0), F.count_if(F.coalesce(F.col("dx") >= F.col("bar"), F.lit(True)))).first()
    hits = dict.fromkeys(ks, 0) | ({0: zero_hits} if 0 in ks else {})

    def tried(block: list) -> None:
        d = np.array(block[0]["d"], float)
        numbers = np.array([[*r["vec"], r["dx"], -r["bar"] if r["bar"] is not None else 1e300] for r in block], float)
        shared = spark.sparkContext.broadcast((np.array([r["ref_vec"] for r in known], float), d, np.array([r["own"] for r in block]), numbers))
        for k in ks:
            if k and len(known) >= k:
                heads = k_reference_sets(mine, max(0, k - 2), _spread(len(known), k - 2, 64 * spark.sparkContext.defaultParallelism)).select("members")
                hits[k] += heads.mapInArrow(_hits(shared, k), "hits long").agg(F.sum("hits")).first()[0] or 0

    block: list = []
    for row in asked.toLocalIterator():
        block.append(row)
        if len(block) == ITEM_BLOCK:
            tried(block)
            block = []
    if block:
        tried(block)
    rows = []
    for k in ks:
        trials = n_known * comb(len(known) - 1, k) + n_free * comb(len(known), k) if known else (n_known + n_free) * (k == 0)
        rows.append((k, trials, hits[k] / trials if trials else None))
    return spark.createDataFrame(rows, "confirmed_examples INT, trials LONG, top1_accuracy DOUBLE")
