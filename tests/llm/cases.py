"""Small tables with the awkward rows every operator must take, and plain-Python twins of the operators."""

import re
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns whose names clash with what the operators make themselves.
EXTRA = ["row", "node", "n", "spans", "items", "score", "part", "size", "k", "range", "marks", "lang_pred", "n_cut", "length", "uid"]

LONG = "Alpha beta gamma delta. " * 30000
PARAGRAPH = "One day the quick brown fox went over the hill to see whether the lazy dog was still asleep in the warm sun of the late afternoon.\nThen it came back along the river, past the mill and the old stone bridge, and told everybody what it had seen.\nNobody believed a word of it, but they all agreed that it was a very good story for an evening by the fire."

ROWS = [
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, "   \n\t ", None, None, 6),
    (4, "word", "en", "a", 4),
    (5, PARAGRAPH, "en", "b", len(PARAGRAPH)),
    (6, PARAGRAPH, "en", "b", len(PARAGRAPH)),
    (6, PARAGRAPH, "en", "b", len(PARAGRAPH)),
    (7, PARAGRAPH.replace("mill", "farm"), "en", None, len(PARAGRAPH)),
    (8, LONG, "en", "c", len(LONG)),
    (9, "Les jours de la semaine sont longs, et la nuit vient avec le vent du nord. École Été.", "fr", "c", 80),
    (10, "日本語のテキスト。 数字 123", None, "d", 14),
    (11, "123 456 !!! ---", "en", "d", 15),
    (None, "A row without an id, which says something of its own.", "en", None, None),
    (12, PARAGRAPH.upper(), "en", "e", len(PARAGRAPH)),
]


def documents(spark, rows=ROWS, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for name in EXTRA:
            df = df.selectExpr("*", f"'x' AS {name}")
    return df


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def shingle_set(text, k):
    w = spaced_words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def components(rows, k, percent):
    """{doc_id: (set size, component)} by comparing all pairs of (doc_id, text)."""
    sets = {d: shingle_set(t, k) for d, t in rows}
    home = {d: d for d in sets}

    def find(a):
        while home[a] != a:
            a = home[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = find(a), find(b)
                home[max(p, q)] = min(p, q)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def crc(text):
    return zlib.crc32((text or "").encode())
