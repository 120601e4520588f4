"""Each stage on awkward rows against a plain-Python twin, and the whole on a small table."""

from collections import Counter

import corpus_pipeline
from cases import PARAGRAPH, ROWS, components, documents
from test_decontaminate import twin as contaminated_twin
from test_line_dedup import twin as line_twin

STAGES = dict(corpus_pipeline.STAGES)
BENCH = [(1, "the quick brown fox went over the hill to see whether the lazy dog was still asleep"), (2, None)]


def folder(spark, tmp_path, rows):
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def kept(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_stages_on_awkward_rows(spark, tmp_path):
    sf = folder(spark, tmp_path, ROWS)
    docs = documents(spark, extra=True)
    source = Counter((r[0], r[1]) for r in ROWS)

    out = STAGES["language ID"](spark, docs, sf)
    assert out.columns == docs.columns
    lettered = Counter({k: n for k, n in source.items() if any(c.isalpha() for c in k[1] or "")})
    assert kept(out) == lettered

    out = STAGES["line dedup"](spark, docs, sf)
    assert out.columns == docs.columns
    texts = line_twin([(r[0], r[1]) for r in ROWS])
    expected = Counter()
    for key, n in source.items():
        if texts[key] == key[1] or texts[key]:
            expected[key[0], texts[key]] += n
    assert kept(out) == expected

    out = STAGES["n-gram Jaccard join"](spark, docs, sf)
    assert out.columns == docs.columns
    comps = components([(r[0], r[1]) for r in ROWS if r[0] is not None], 5, 80)
    expected = {(r[0], r[1]) for r in ROWS if r[0] is None or comps[r[0]][1] == r[0]}
    assert set(kept(out)) == expected and all(n == 1 for n in kept(out).values())

    out = STAGES["benchmark decontamination"](spark, docs, sf)
    assert out.columns == docs.columns
    dirty = {t[0] for t in contaminated_twin([(r[0], r[1]) for r in ROWS if r[0] != 8], BENCH) if t[5]}
    assert dirty and kept(out) == Counter({k: n for k, n in source.items() if k[0] not in dirty})

    out = STAGES["best-fit packing"](spark, docs, sf)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {r[0] for r in ROWS}


def test_empty_table(spark, tmp_path):
    sf = folder(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, sf).collect() == []


def test_run_keeps_clean_documents_and_drops_copies(spark, tmp_path):
    clean = [(i, f"Document number {i} says that {i * 7} birds flew over the town of place{i}. Nobody in street{i} saw them at hour {i % 24}.\nA second line {i} follows.", "en", "s", 100) for i in range(30)]
    copies = [(100 + i, PARAGRAPH.split("\n", 1)[1], "en", "s", 300) for i in range(5)]
    dirty = [(200, BENCH[0][1] + " and more", "en", "s", 90)]
    sf = folder(spark, tmp_path, clean + copies + dirty + [(300, "12 34 !!", "en", "s", 8)])
    found = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()}
    assert found == {r[0] for r in clean} | {100}
