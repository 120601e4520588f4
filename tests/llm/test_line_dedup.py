import random
import re

from cases import PARAGRAPH, ROWS, documents

from tallyspark.llm.line_dedup import dedup_lines, line_pattern

PATTERN = re.compile(line_pattern(16, ""))


def twin(rows):
    """Texts of (doc_id, text) rows after the removal, by a dictionary of windows."""
    pieces = {key: PATTERN.findall(key[1] or "") for key in rows}
    first, cut = {}, {key: set() for key in rows}
    order = sorted(set(rows), key=lambda k: (k[0] is not None, k[0] or 0))
    for key in order:
        plain = [p.rstrip(" \t\n\r\f") for p in pieces[key]]
        for i in range(len(plain) - 2):
            if first.setdefault(tuple(plain[i : i + 3]), (key, i)) != (key, i):
                cut[key] |= {i, i + 1, i + 2}
    out = {}
    for key in rows:
        p, c = pieces[key], cut[key]
        keep = [x if i + 1 not in c or x.endswith("\n") else x.rstrip(" \t\n\r\f") + "\n" for i, x in enumerate(p) if i not in c]
        out[key] = "".join(keep) if c else key[1]
    return out


def test_awkward_rows(spark):
    got = dedup_lines(documents(spark, extra=True))
    assert got.select("row.*").columns == documents(spark, extra=True).columns
    expected = twin([(r[0], r[1]) for r in ROWS])
    source = {(r[0], r[2], r[3]): r[1] for r in ROWS}
    rows = got.select("row.doc_id", "row.text", "row.lang", "row.source").collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r["text"] == expected[r["doc_id"], source[r["doc_id"], r["lang"], r["source"]]]


def test_passage_in_one_long_line(spark):
    """A passage of over 50 words inside paragraphs of different documents stays in the first only."""
    passage = " ".join(f"shared{i}" for i in range(60))
    rows = [(i, f"Own opening {i} with some words.\n{passage}\nOwn ending {i} as well.", "en", "s", 0) for i in range(1, 6)]
    texts = {r["doc_id"]: r["text"] for r in dedup_lines(documents(spark, rows)).select("row.doc_id", "row.text").collect()}
    assert passage in texts[1]
    assert all("shared" not in texts[i] and f"opening {i}" in texts[i] and f"ending {i}" in texts[i] for i in range(2, 6))


def test_passage_at_any_place_of_a_line(spark):
    """A passage of 50 words is found at any word offset, also after a word put in before it in the same line."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abdeghiklmnoprstuvz") for _ in range(rng.randint(3, 8)))
    passage = [f"{word()}" for _ in range(50)]
    rows = [(i, " ".join([*(f"{word()}" for _ in range(i)), *passage, *(f"{word()}" for _ in range(5))]), "en", "s", 0) for i in range(34)]
    rows.append((40, "another " + rows[30][1].split(" ", 1)[1], "en", "s", 0))
    texts = {r["doc_id"]: r["text"].split() for r in dedup_lines(documents(spark, rows)).select("row.doc_id", "row.text").collect()}
    assert texts[0] == rows[0][1].split()
    assert all(len(set(passage) & set(texts[i])) <= 25 for i in texts if i)
    pieces = [len(p.split()) for r in rows for p in PATTERN.findall(r[1])]
    assert max(pieces) <= 12


def test_empty_table_and_no_repeats(spark):
    assert dedup_lines(documents(spark, [])).collect() == []
    alone = dedup_lines(documents(spark, [(1, PARAGRAPH, "en", "s", 0)])).select("row.text", "n_cut").first()
    assert (alone["text"], alone["n_cut"]) == (PARAGRAPH, 0)
