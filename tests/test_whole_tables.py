"""Registered queries answer for every row of their driver tables."""

from math import comb

from tallyspark.catalog.index import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_cascade_answers_for_every_part(spark):
    """Parts without an embedding are looked up and searched like the others, and end in ABSTAIN at worst."""
    parts = spark.read.parquet(f"{FOLDER}/part.parquet").select("p_partkey")
    vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet").selectExpr("vec_id AS item_id")
    got = QUERIES["c05_suggest_all"](spark, FOLDER).cache()
    assert got.count() == parts.count()
    bare = got.join(vectors, "item_id", "left_anti")
    sources = {r[0] for r in bare.select("source").distinct().collect()}
    assert "ABSTAIN" in sources and "SEMANTIC_MODEL" not in sources
    assert QUERIES["j14_unresolved"](spark, FOLDER).count() == got.filter("source <> 'USER_LEARNED'").count()


def test_few_shot_asks_for_all_sizes(spark):
    """31 products: each item is tried with every set of k of them that leaves its own product out."""
    rows = {r["confirmed_examples"]: r["trials"] for r in QUERIES["e09_kshot_eval"](spark, FOLDER).collect()}
    assert sorted(rows) == [0, 1, 3, 5]
    vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet").filter("label = 5").selectExpr("vec_id div 3 AS product", "vec_id % 4 <> 0 AS clean").collect()
    products = {r["product"] for r in vectors if r["clean"]}
    for k in (1, 3, 5):
        assert rows[k] == sum(comb(len(products) - (r["product"] in products), k) for r in vectors)
