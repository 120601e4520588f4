"""Text normalisation, similarity and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.udfs import nfkc, nfkd

# Characters folded by every normaliser.
ARABIC_INDIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
ASCII_DIGITS = "0123456789"
ALEF_FORMS = "أإآٱ"
TATWEEL = "ـ"
ARABIC_MARKS = r"[\u0610-\u061A\u064B-\u065F\u0670\u06D6-\u06ED]"
OCR_LOOKALIKES = ("0157", "olst")
DECIMAL_MARK, GROUP_MARK = "٫", "٬"


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def fold_digits(c: Column) -> Column:
    """Arabic and Persian digits to ASCII."""
    return F.translate(c, ARABIC_INDIC_DIGITS + PERSIAN_DIGITS, ASCII_DIGITS * 2)


def fold_receipt_digits(c: Column) -> Column:
    """``fold_digits`` plus the Arabic decimal and group marks."""
    return F.translate(fold_digits(c), DECIMAL_MARK + GROUP_MARK, ".,")


def normalize_merchant(c: Column) -> Column:
    folded = F.translate(F.lower(F.trim(nfkc(c))), ALEF_FORMS + "ى" + TATWEEL, "ا" * 4 + "ي" + " ")
    return _squeeze(folded)


def normalize_search(c: Column) -> Column:
    return _squeeze(F.regexp_replace(normalize_merchant(c), r"[^\p{L}\p{N}]+", " "))


def normalize_item(c: Column) -> Column:
    """Item text; runs of three or more single-character tokens are joined."""
    t = F.translate(fold_digits(F.lower(nfkc(c))), TATWEEL, " ")
    t = F.regexp_replace(t, ARABIC_MARKS, "")
    t = _squeeze(F.regexp_replace(t, r"[\p{P}\p{S}]+", " "))
    # Mark the inner spaces of a run (a space that has a single-character token on
    # both sides and belongs to a run of three or more), then drop them.
    single = r"(?<![^ ])[\p{L}\p{N}](?![^ ])"
    inner = (
        rf"(?<=(?<![^ ])[\p{{L}}\p{{N}}]) (?={single} {single})"
        rf"|(?<=(?<![^ ])[\p{{L}}\p{{N}}] [\p{{L}}\p{{N}}]) (?={single})"
    )
    return F.regexp_replace(t, inner, "")


def normalize_text(c: Column) -> Column:
    """Lexical form: folded case and digits, marks dropped, other symbols to spaces."""
    t = F.replace(F.lower(fold_digits(nfkc(c))), F.lit("ß"), F.lit("ss"))
    t = F.translate(F.regexp_replace(t, ARABIC_MARKS, ""), TATWEEL, "")
    return _squeeze(F.regexp_replace(t, r"[^\p{L}\p{N}_\s]+", " "))


def ocr_fold(c: Column) -> Column:
    return F.translate(normalize_text(c), *OCR_LOOKALIKES)


def tokens(normalized: Column, longer_than: int = 0) -> Column:
    """Distinct tokens of a normalised text."""
    return F.array_distinct(F.filter(F.split(normalized, " "), lambda t: F.length(t) > longer_than))


def token_overlap(item: Column, description: Column) -> Column:
    """Shared tokens over at most three item tokens."""
    a, b = tokens(item, 1), tokens(description, 1)
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.least(F.lit(3), F.size(a)))


def jaccard(a: Column, b: Column) -> Column:
    x, y = tokens(a, 1), tokens(b, 1)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0))


def edit_similarity(a: Column, b: Column) -> Column:
    """``1 - distance / longer length``; 0 when either text is empty."""
    longer = F.greatest(F.length(a), F.length(b))
    empty = (F.length(a) == 0) | (F.length(b) == 0)
    return F.when(empty, F.lit(0.0)).otherwise(
        F.lit(1.0) - F.levenshtein(a, b) / F.greatest(longer, F.lit(1))
    )


def similar(a: Column, b: Column, threshold: float) -> Column:
    """``edit_similarity(a, b) >= threshold`` without the full distance when lengths rule it out."""
    longer, shorter = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    reachable = (shorter > 0) & (longer - shorter <= (1.0 - threshold) * longer + 1e-9)
    return F.when(reachable, edit_similarity(a, b) >= threshold).otherwise(F.lit(False))


def fuzzy_limit(query: Column) -> Column:
    """Edits allowed for a query: max(1, length / 3)."""
    return F.greatest(F.lit(1), F.floor(F.length(query) / 3).cast("int"))


def match_kind(query: Column, name: Column) -> Column:
    """RECENT, EXACT, PREFIX, CONTAINS, FUZZY or null for normalised texts."""
    fuzzy = (F.length(query) >= 3) & (F.levenshtein(name, query) <= fuzzy_limit(query))
    return (
        F.when(F.trim(query) == "", F.lit("RECENT"))
        .when(name == query, F.lit("EXACT"))
        .when(name.startswith(query), F.lit("PREFIX"))
        .when(name.contains(query), F.lit("CONTAINS"))
        .when(fuzzy, F.lit("FUZZY"))
    )


def normalize_type(c: Column) -> Column:
    return F.lower(_squeeze(c))


def slug(c: Column) -> Column:
    """ASCII slug: decomposed, non-ASCII dropped, other runs to one underscore."""
    ascii_only = F.regexp_replace(nfkd(c), r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(F.lower(ascii_only), r"[^a-z0-9]+", "_"), F.lit("_"))


def occurrence_key(date: Column, km: Column) -> Column:
    """``epochday:km`` with ``-`` for a missing part."""
    return F.concat_ws(
        ":",
        F.coalesce(F.unix_date(date).cast("string"), F.lit("-")),
        F.coalesce(km.cast("string"), F.lit("-")),
    )


def none_if_blank(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)
