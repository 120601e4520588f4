"""Column helpers, each over a whole driver table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.catalog.ledger import egp, tenths
from tallyspark.catalog.registry import query
from tallyspark.functions import dates as D
from tallyspark.functions import money, text, vectors

AMOUNT_TEXT = """
SELECT line_id, CASE line_no WHEN 1 THEN w || '.' || c WHEN 2 THEN '  ' || w || '.' || SUBSTR(c, 1, 1) || ' ' WHEN 3 THEN w || '.' || c || '0'
  WHEN 4 THEN w || '.' || c || '7' WHEN 5 THEN 'x' || w WHEN 6 THEN '-' || w ELSE w || '99999999999999999999' END AS amount_text
FROM (SELECT line_id, line_no, CAST(@DIV[price_minor, 100] AS STRING) AS w, LPAD(CAST(price_minor % 100 AS STRING), 2, '0') AS c FROM fx_lines) x"""
# Documents in the forms the normalisers meet: Arabic digits, marks and letters beside the driver's own text.
DOCS = """
SELECT doc_id, lang, CASE WHEN lang = 'de' THEN REPLACE(text, 'e', 'أ') WHEN lang = 'fr' THEN CONCAT('٣٤ ', REPLACE(text, 'a', 'ى'), ' p a n ۵') ELSE text END AS body FROM documents"""
TIDY = "TRIM(REGEXP_REPLACE({0}, '\\s+', ' ', 'g'))"
_DIGITS = "TRANSLATE({0}, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789')"
MERCHANT_SQL = TIDY.format("TRANSLATE(LOWER(TRIM(body)), 'أإآٱىـ', 'ااااي ')")


@query("n01_parse_minor", f"""
SELECT line_id, CASE WHEN regexp_full_match(TRIM(amount_text), '[+-]?(\\d+\\.?\\d*|\\.\\d+)') AND NOT regexp_matches(amount_text, '\\.\\d{{2}}\\d*[1-9]')
  THEN TRY_CAST(TRY_CAST(TRIM(amount_text) AS DECIMAL(38, 10)) * 100 AS BIGINT) END AS minor FROM ({AMOUNT_TEXT}) a""")
def _(t):
    return t.sql(AMOUNT_TEXT).select("line_id", money.parse_minor(F.col("amount_text")).alias("minor"))


@query("n02_format_minor", f"SELECT tx_id, {egp('v')} AS shown FROM (SELECT tx_id, CASE WHEN type = 'INCOME' THEN amount_minor WHEN created_at = 2 THEN amount_minor // 100 * 100 ELSE -amount_minor END AS v FROM fx_tx) x")
def _(t):
    v = F.when(F.col("type") == "INCOME", F.col("amount_minor")).when(
        F.col("created_at") == 2, money.int_div(F.col("amount_minor"), F.lit(100)) * 100).otherwise(-F.col("amount_minor"))
    return t.tx.select("tx_id", money.format_minor(v).alias("shown"))


@query("n03_format_tenths", f"SELECT tx_id, {tenths('v')} AS shown FROM (SELECT tx_id, amount_minor % 1001 AS v FROM fx_tx) x")
def _(t):
    return t.tx.select("tx_id", money.format_tenths(F.col("amount_minor") % 1001).alias("shown"))


@query("n04_normalize_merchant", f"SELECT doc_id, md5({MERCHANT_SQL}) AS digest, LENGTH({MERCHANT_SQL}) AS n FROM ({DOCS}) d")
def _(t):
    n = text.normalize_merchant(F.col("body"))
    return t.sql(DOCS).select("doc_id", n.alias("v")).select("doc_id", F.md5("v").alias("digest"), F.length("v").cast("long").alias("n"))


@query("n05_normalize_search", f"SELECT doc_id, md5(v) AS digest, LENGTH(v) AS n FROM (SELECT doc_id, {TIDY.format(f'REGEXP_REPLACE({MERCHANT_SQL}, ' + chr(39) + '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS v FROM ({DOCS}) d) x")
def _(t):
    n = text.normalize_search(F.col("body"))
    return t.sql(DOCS).select("doc_id", n.alias("v")).select("doc_id", F.md5("v").alias("digest"), F.length("v").cast("long").alias("n"))


_MARKS = "[\\x{0610}-\\x{061A}\\x{064B}-\\x{065F}\\x{0670}\\x{06D6}-\\x{06ED}]"


@query("n06_normalize_item", f"""
SELECT doc_id, md5(v) AS digest, LENGTH(v) AS n FROM (
  SELECT doc_id, COALESCE(string_agg(CASE WHEN run_size >= 3 AND place > 1 THEN '' WHEN pos = 1 THEN '' ELSE ' ' END || token, '' ORDER BY pos), '') AS v FROM (
    SELECT *, CASE WHEN single THEN COUNT(*) OVER (PARTITION BY doc_id, single, run) ELSE 0 END AS run_size,
      ROW_NUMBER() OVER (PARTITION BY doc_id, single, run ORDER BY pos) AS place
    FROM (SELECT *, pos - ROW_NUMBER() OVER (PARTITION BY doc_id, single ORDER BY pos) AS run
      FROM (SELECT doc_id, pos, token, regexp_full_match(token, '[\\p{{L}}\\p{{N}}]') AS single
        FROM (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM (
          SELECT doc_id, string_split({TIDY.format("REGEXP_REPLACE(REGEXP_REPLACE(TRANSLATE(" + _DIGITS.format("LOWER(body)") + ", 'ـ', ' '), '" + _MARKS + "', '', 'g'), '[\\p{P}\\p{S}]+', ' ', 'g')")}, ' ') AS tokens FROM ({DOCS}) d) a) b) c) e) f
  GROUP BY doc_id) g""")
def _(t):
    n = text.normalize_item(F.col("body"))
    return t.sql(DOCS).select("doc_id", n.alias("v")).select("doc_id", F.md5("v").alias("digest"), F.length("v").cast("long").alias("n"))


_LEX = TIDY.format("REGEXP_REPLACE(TRANSLATE(REGEXP_REPLACE(REPLACE(" + _DIGITS.format("LOWER(body)") + ", 'ß', 'ss'), '" + _MARKS + "', '', 'g'), 'ـ', ''), '[^\\p{L}\\p{N}_\\s]+', ' ', 'g')")


@query("n07_normalize_text", f"SELECT doc_id, md5(v) AS digest, md5(TRANSLATE(v, '0157', 'olst')) AS folded FROM (SELECT doc_id, {_LEX} AS v FROM ({DOCS}) d) x")
def _(t):
    d = t.sql(DOCS).select("doc_id", text.normalize_text(F.col("body")).alias("v"), text.ocr_fold(F.col("body")).alias("o"))
    return d.select("doc_id", F.md5("v").alias("digest"), F.md5("o").alias("folded"))


_TOK = "list_distinct(list_filter(string_split(COALESCE({0}, ''), ' '), lambda x: length(x) > 1))"


@query("n08_token_overlap", f"""
SELECT p_partkey, len(list_intersect(a, b)) / greatest(1, least(3, len(a))) AS overlap,
  CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0.0 END AS jaccard
FROM (SELECT p_partkey, {_TOK.format("p_name")} AS a, {_TOK.format("'red widget small gear ' || lower(p_type)")} AS b FROM part) x""", doubles=["overlap", "jaccard"])
def _(t):
    a, b = F.col("p_name"), F.concat(F.lit("red widget small gear "), F.lower("p_type"))
    return t.raw("part").select("p_partkey", text.token_overlap(a, b).alias("overlap"), text.jaccard(a, b).alias("jaccard"))


@query("n09_edit_similarity", """
SELECT p_partkey, 1.0 - levenshtein(p_name, b) / greatest(length(p_name), length(b)) AS similarity
FROM (SELECT p_partkey, p_name, lower(p_type || ' ' || p_brand) AS b FROM part) x""", doubles=["similarity"])
def _(t):
    return t.raw("part").select("p_partkey", text.edit_similarity(F.col("p_name"), F.lower(F.concat("p_type", F.lit(" "), "p_brand"))).alias("similarity"))


@query("n10_match_kind", """
SELECT p_partkey, CASE WHEN trim(q) = '' THEN 'RECENT' WHEN p_name = q THEN 'EXACT' WHEN starts_with(p_name, q) THEN 'PREFIX' WHEN contains(p_name, q) THEN 'CONTAINS'
  WHEN length(q) >= 3 AND levenshtein(p_name, q) <= greatest(1, length(q) // 3) THEN 'FUZZY' END AS kind
FROM (SELECT p_partkey, p_name, CASE p_size % 6 WHEN 0 THEN '' WHEN 1 THEN 'red bolt' WHEN 2 THEN substr(p_name, 1, 4) WHEN 3 THEN substr(p_name, 3, 4) WHEN 4 THEN replace(p_name, 'l', '1') ELSE 'old gear' END AS q FROM part) x""")
def _(t):
    p = t.raw("part")
    n, m = F.col("p_name"), F.col("p_size") % 6
    q = (F.when(m == 0, "").when(m == 1, "red bolt").when(m == 2, F.substring(n, 1, 4)).when(m == 3, F.substring(n, 3, 4))
         .when(m == 4, F.replace(n, F.lit("l"), F.lit("1"))).otherwise("old gear"))
    return p.select("p_partkey", text.match_kind(q, n).alias("kind"))


@query("n12_utc_date", """
SELECT event_id, CAST(ts AS DATE) AS day, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS epoch_day,
  CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) * 86400000 AS day_start FROM events""", dates=["day"])
def _(t):
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    e = t.raw("events").select("event_id", D.utc_date(millis).alias("day"))
    return e.select("event_id", "day", F.unix_date("day").cast("long").alias("epoch_day"), D.day_start_millis(F.col("day")).alias("day_start"))


@query("n13_clamp_date", """
SELECT o_orderkey, make_date(y, m, least(31 - o_orderkey % 4, day(last_day(make_date(y, m, 1))))) AS clamped
FROM (SELECT o_orderkey, year(o_orderdate) + 1 AS y, month(o_orderdate) AS m FROM orders) x""", dates=["clamped"])
def _(t):
    d = F.col("o_orderdate")
    return t.raw("orders").select("o_orderkey", D.clamp_date(F.year(d) + 1, F.month(d), (31 - F.col("o_orderkey") % 4).cast("int")).alias("clamped"))


@query("n14_normalize_type", "SELECT p_partkey, LOWER(TRIM(REGEXP_REPLACE('  ' || p_type || '   ' || p_name || ' ', '\\s+', ' ', 'g'))) AS normalized FROM part")
def _(t):
    return t.raw("part").select("p_partkey", text.normalize_type(F.concat(F.lit("  "), "p_type", F.lit("   "), "p_name", F.lit(" "))).alias("normalized"))


@query("n15_slug", "SELECT doc_id, md5(TRIM(REGEXP_REPLACE(LOWER(REGEXP_REPLACE(REPLACE(strip_accents(text), 'ß', ''), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', '_', 'g'), '_')) AS digest FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", text.slug(F.col("text")).alias("s")).select("doc_id", F.md5("s").alias("digest"))


@query("n16_vector_algebra", """
SELECT item_id, list_inner_product(vec, d) AS dot, sqrt(list_inner_product(vec, vec)) AS norm,
  list_inner_product(vec, d) / (sqrt(list_inner_product(vec, vec)) * sqrt(list_inner_product(d, d))) AS cosine,
  sqrt(list_sum(list_transform(list_zip(vec, d), lambda p: (0.5 * p[1] + 0.5 * p[2]) * (0.5 * p[1] + 0.5 * p[2])))) AS blend_norm
FROM (SELECT v.item_id, v.vec, d.vec AS d FROM fx_vec v JOIN fx_desc d ON d.label = v.label) x""", doubles=["dot", "norm", "cosine", "blend_norm"])
def _(t):
    d = t.desc.select("label", F.col("vec").alias("d"))
    x = t.vec.join(d, "label")
    return x.select("item_id", vectors.dot(F.col("vec"), F.col("d")).alias("dot"), vectors.l2_norm(F.col("vec")).alias("norm"),
                    vectors.cosine(F.col("vec"), F.col("d")).alias("cosine"), vectors.l2_norm(vectors.blend(F.col("vec"), F.col("d"))).alias("blend_norm"))


@query("n18_occurrence_key", """
SELECT checkpoint_id, COALESCE(CAST(date_diff('day', DATE '1970-01-01', due_date) AS VARCHAR), '-') || ':' || COALESCE(CAST(due_km AS VARCHAR), '-') AS occurrence_key FROM fx_checkpoints""")
def _(t):
    return t.checkpoints.select("checkpoint_id", text.occurrence_key(F.col("due_date"), F.col("due_km")).alias("occurrence_key"))


@query("u02_nfkc", "SELECT doc_id, md5(nfc_normalize(text)) AS digest FROM documents")
def _(t):
    """The driver's texts hold no compatibility characters, so NFC is their NFKC."""
    return t.raw("documents").select("doc_id", F.md5(text.nfkc(F.col("text"))).alias("digest"))


@query("u03_seq_ratio")
def _(t):
    from tallyspark.functions.udfs import seq_ratio

    return t.raw("part").select("p_partkey", F.round(seq_ratio(F.col("p_name"), F.lower(F.concat("p_type", F.lit(" "), "p_brand"))), 6).alias("ratio"))


def compound_sql(rows: str, key: str) -> str:
    """DuckDB text of (key, gain): (basis, points, periods) compounded by powers of each rate, carried along in limbs of four digits."""
    return f"""
WITH RECURSIVE rows AS ({rows}), rates AS (SELECT points, MAX(periods) AS top FROM rows GROUP BY points),
 powers AS (SELECT points, 0 AS n, [CAST(1 AS HUGEINT)] AS limbs FROM rates UNION ALL
  SELECT points, n + 1, list_concat(r[2:], [r[1]]) FROM (SELECT points, n, list_reduce(list_concat([[CAST(0 AS HUGEINT)]], list_transform(limbs, lambda x: [x])),
   lambda a, x: list_concat([(x[1] * (10000 + points) + a[1]) // 10000], a[2:], [(x[1] * (10000 + points) + a[1]) % 10000])) AS r FROM powers JOIN rates USING (points) WHERE n < top) s),
 sized AS (SELECT {key}, basis, limbs, n, list_reduce(list_concat([CAST(0 AS HUGEINT)], limbs[1:n - 1]), lambda a, x: (x * basis + a) // 10000) AS below,
   list_reduce(list_concat([CAST(0 AS HUGEINT)], list_reverse(limbs[n + 1:])), lambda a, x: a * 10000 + x) AS whole FROM rows JOIN powers USING (points) WHERE periods = n)
SELECT {key}, CASE WHEN n = 0 THEN 0 ELSE CAST(whole * basis + (limbs[n] * basis + below + 5000) // 10000 - basis AS BIGINT) END AS gain FROM sized"""


@query("u04_compound_charge", f"SELECT tx_id, gain AS charge_minor FROM ({compound_sql('SELECT tx_id, amount_minor AS basis, 150 AS points, created_at AS periods FROM fx_tx', 'tx_id')}) g")
def _(t):
    return t.tx.select("tx_id", money.compound_charge(F.col("amount_minor"), F.lit(150).cast("long"), F.col("created_at")).alias("charge_minor"))


@query("u05_centroid", """
SELECT label, pos, avg(x) AS mean FROM (SELECT label, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS pos FROM fx_vec) y GROUP BY label, pos""", doubles=["mean"])
def _(t):
    c = vectors.centroid(t.vec, ["label"], "vec")
    return c.select("label", F.posexplode("centroid").alias("pos", "mean")).withColumn("pos", F.col("pos").cast("long"))


@query("u01_embed")
def _(t):
    """Distinct item names embedded by a stand-in hashing model and joined back."""
    from tallyspark.functions.udfs import embed

    def hashing(texts):
        import zlib

        return [[(zlib.crc32(f"{i}|{s}".encode()) % 2000 - 1000) / 1000.0 for i in range(16)] for s in texts]

    out = embed(t.raw("part"), "p_name", "QUERY", hashing)
    return out.select("p_partkey", F.array_join(F.transform("embedding", lambda x: x.cast("string")), ",").alias("embedding"))
