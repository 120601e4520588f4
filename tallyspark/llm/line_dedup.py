"""Line dedup by overlapping three-line windows, as DataFrame expressions only.

A text is cut into lines: words of one line of text with the white space that follows, so the pieces give the text again
and a long paragraph is several lines. A long line of text breaks where its words say so, not by their count: after the
first word with an ``ENDS`` character at its end once a quarter of ``wrap`` words are together, and after three quarters in
any case. Equal passages so fall into step after a few words, wherever in a line they begin, and any 3 * ``wrap`` words
hold three whole lines. Texts without blanks break at their line ends only.

Every three consecutive lines form a window, hashed from the hashes of its lines. Of equal windows the one first by
(doc_id, text, position) stays; the positions that the later ones cover are merged and cut out. Windows are dealt by hash
once and ranked there. Windows that a sample of the documents shows to be frequent are dealt in ``SALTS`` parts; the first
of each part is held back and only these are compared, so a line that a third of all documents share never meets in one
task. Every window is looked at, whether the sample found it or not.

Null or empty texts, and texts of fewer than three lines, have no window and stay as they are. Rows with the same
doc_id and text count as one document and are all kept alike; different texts of one doc_id are told apart by 34 bits of
their hash. Rows without doc_id are first in order and told apart by 64 bits. Texts of any length are taken whole. Empty
table: no rows. Columns of the table stay; their names never clash with the results, since each row is a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.plans.keyed import cut

WRAP = 16
#: One document of so many is sampled for frequent windows; found so often there, a window is dealt in parts.
SAMPLED, OFTEN, SALTS = 64, 32, 64
#: Frequent windows that are broadcast (16 bytes each); of more, the most frequent.
MOST_HOT = 1 << 16
#: Bits of a position; the higher bits of the same number hold the text's hash.
PLACE_BITS = 30
SPACE = " \t\n\r\f"
#: Sentence ends, and the last characters of about half of all words.
ENDS = ".!?:;。！？aeinrAEINR02468à-ïÀ-Ïаеийояاهين"
_BLANK, _WORD, _OTHER = "[ \\t\\r\\f]", "[^ \\t\\n\\r\\f]", f"[^ \\t\\n\\r\\f{ENDS}]"


def line_pattern(wrap: int, possessive: str = "+") -> str:
    """One piece of a line and the white space up to the next word (``possessive``: never backtrack, and look behind)."""
    p, least, most = possessive, max(2, wrap // 4), max(2, 3 * wrap // 4)
    word = f"{_WORD}+{p}{_BLANK}*{p}"
    goes_on = f"{_WORD}++(?<![{ENDS}])" if p else f"{_WORD}*{_OTHER}"  # a word that does not end the piece
    inside = f"(?:{goes_on}{_BLANK}+{p}){{0,{most - least}}}{p}"
    return f"[ \\t\\n\\r\\f]*{p}(?:{word}){{1,{least - 1}}}{p}{inside}(?:{word})?{p}(?:\\n[ \\t\\n\\r\\f]*{p})?{p}"


def lines(text: Column, wrap: int) -> Column:
    return F.regexp_extract_all(text, F.lit(line_pattern(wrap)), F.lit(0))


def _windows(pieces: Column, span: int) -> Column:
    """Window hashes by position."""
    hashed = F.transform(pieces, lambda x: F.xxhash64(F.rtrim(x, F.lit(SPACE))))
    n = F.size(pieces) - (span - 1)
    built = lambda h: F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(*[F.element_at(h, (i + k).cast("int")) for k in range(span)]))
    return F.when(n >= 1, F.element_at(F.transform(F.array(hashed), built), 1))


def runs(positions: Column) -> Column:
    """Half-open ranges ``struct<start, stop>`` that merge the positions of an array."""
    inside = lambda s: F.zip_with(
        F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1) < x - 1)),
        F.filter(s, lambda x, i: (i == F.size(s) - 1) | (F.get(s, i + 1) > x + 1)),
        lambda a, b: F.struct(a.alias("start"), (b + 1).alias("stop")),
    )
    return F.element_at(F.transform(F.array(F.array_sort(positions)), inside), 1)


def _text_key(doc_id: Column, text: Column) -> Column:
    return F.when(doc_id.isNull(), F.xxhash64(text))


def windows_of(docs: DataFrame, span: int, wrap: int) -> DataFrame:
    """(doc_id, text_key, place, window): ``place`` holds the text's hash above the position."""
    version = F.xxhash64("text")
    keyed = docs.select("doc_id", _text_key(F.col("doc_id"), F.col("text")).alias("text_key"), version.alias("version"), F.explode(F.array(lines(F.col("text"), wrap))).alias("pieces"))
    found = keyed.select("doc_id", "text_key", "version", F.posexplode(_windows(F.col("pieces"), span)).alias("pos", "window"))
    place = F.col("version").bitwiseAND(F.lit(-(1 << PLACE_BITS))).bitwiseOR(F.col("pos").cast("long"))
    return found.select("doc_id", "text_key", place.alias("place"), "version", "window")


def hot_windows(windows: DataFrame) -> DataFrame:
    """(window, hot): windows that are frequent in a sample of the documents, at most ``MOST_HOT``."""
    sample = windows.filter(F.pmod("version", F.lit(SAMPLED)) == 0).groupBy("window").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN)
    return sample.orderBy(F.desc("n"), "window").limit(MOST_HOT).select("window", F.lit(True).alias("hot"))


def repeated_lines(docs: DataFrame, span: int = 3, wrap: int = WRAP) -> DataFrame:
    """(doc_id, text_key, version, covered): merged ranges of lines under later occurrences, of the documents with any."""
    windows = windows_of(docs, span, wrap)
    hot = cut(hot_windows(windows), "hot-windows")
    salt = F.when(F.col("hot"), F.pmod("version", F.lit(SALTS))).otherwise(-1)
    order = ["doc_id", "text_key", "place"]
    dealt = windows.join(F.broadcast(hot), "window", "left").select("window", salt.cast("int").alias("salt"), *order)
    ranked = dealt.withColumn("rank", F.rank().over(Window.partitionBy("window", "salt").orderBy(*order)))
    # Not the first of its part, or the first of one of a frequent window's parts.
    behind = cut(ranked.filter((F.col("rank") > 1) | (F.col("salt") >= 0)).select(*order, F.when(F.col("rank") == 1, F.col("window")).alias("first_of")), "behind")
    heads = behind.filter(F.col("first_of").isNotNull())
    first = heads.groupBy("first_of").agg(F.min(F.struct(*order)).alias("first"))  # frequent windows only
    later = behind.filter(F.col("first_of").isNull()).select(*order).unionByName(
        heads.join(F.broadcast(first), "first_of").filter(F.struct(*order) > F.col("first")).select(*order))
    pos = F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    positions = F.array_distinct(F.flatten(F.transform(F.collect_set(pos), lambda p: F.sequence(p, p + (span - 1)))))
    return later.groupBy("doc_id", "text_key", F.shiftright("place", PLACE_BITS).alias("version")).agg(runs(positions).alias("covered"))


def _without(pieces: Column, covered: Column) -> Column:
    """The text between the covered ranges; a cut inside a line ends it."""

    def built(p: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(covered, lambda x: x["stop"]))
        stops = F.concat(F.transform(covered, lambda x: x["start"]), F.array(F.size(p)))
        gaps = F.zip_with(starts, stops, lambda a, b: F.array_join(F.slice(p, a + 1, b - a), ""))
        ended = lambda x, i: F.when((i < F.size(covered)) & (x != "") & ~x.endswith("\n"), F.concat(F.rtrim(x, F.lit(SPACE)), F.lit("\n"))).otherwise(x)
        return F.array_join(F.transform(gaps, ended), "")

    return F.element_at(F.transform(F.array(pieces), built), 1)


def dedup_lines(docs: DataFrame, span: int = 3, wrap: int = WRAP) -> DataFrame:
    """(row, n_lines, n_cut, cut): the rows with repeated windows cut from ``text``, and the merged ranges that were cut."""
    found = repeated_lines(docs, span, wrap).select(*[F.col(c).alias(f"__{c}") for c in ("doc_id", "text_key", "version", "covered")])
    rows = docs.select(F.struct(*[docs[c].alias(c) for c in docs.columns]).alias("row"))
    doc_id, own = rows["row"]["doc_id"], rows["row"]["text"]
    same = doc_id.eqNullSafe(found["__doc_id"]) & _text_key(doc_id, own).eqNullSafe(found["__text_key"]) & (F.shiftright(F.xxhash64(own), PLACE_BITS) == found["__version"])
    joined = rows.join(found, same, "left").select("row", "__covered", F.explode(F.array(lines(F.col("row.text"), wrap))).alias("__pieces"))
    pieces = F.col("__pieces")
    text = F.when(F.col("__covered").isNull(), F.col("row.text")).otherwise(_without(pieces, F.col("__covered")))
    facts = (
        F.coalesce(F.size(pieces), F.lit(0)).alias("n_lines"),
        F.coalesce(F.aggregate("__covered", F.lit(0), lambda n, x: n + x["stop"] - x["start"]), F.lit(0)).alias("n_cut"),
        F.coalesce("__covered", F.array().cast("array<struct<start:int,stop:int>>")).alias("cut"),
    )
    out = F.struct(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
    return joined.select(out.alias("row"), *facts)
