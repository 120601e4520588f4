"""The registered queries of this folder: each applies one operator with production parameters to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import chat, divergence, language_id, mixing, packing, prefix_trie, quality, sharding, syncmers, toxicity
from tallyspark.llm.decontaminate import find_passages, judged
from tallyspark.llm.line_dedup import dedup_lines, line_pattern, WRAP
from tallyspark.llm.ngram_join import near_duplicates
from tallyspark.plans.keyed import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int, doc_id: str = "doc_id") -> Column:
    """Remainder of the id's CRC-32 that deals rows into learning and held-out ones; null without an id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(n))


def held_out(n: int, remainder: int, doc_id: str = "doc_id") -> Column:
    return F.coalesce(fold(n, doc_id) == remainder, F.lit(False))


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op1_ngram_jaccard_join",
    f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i:i + 3], ' ') FOR i IN range(1, len(words) - 2)]) END AS s FROM w),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN comp USING (doc_id)
""",
)
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and near-duplicate component of every document (4-word shingles, 85 %)."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=85)


@query(
    "op2_benchmark_decontamination",
    f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
phrases AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + 12], ' ') AS p
    FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS p
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM phrases))),
found AS (SELECT doc_id, i, f.n, item_id FROM places JOIN phrases f USING (n, p)),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
""",
)
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, words under 13-word benchmark passages, and the items found, of every document."""
    found = find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), span=13)
    return judged(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query(
    "op4_line_dedup",
    f"""
WITH pieces AS (SELECT doc_id, text, regexp_extract_all(text, '{line_pattern(WRAP, "")}') AS p FROM documents),
units AS (SELECT doc_id, unnest(p) AS u, generate_subscripts(p, 1) AS i FROM pieces),
trimmed AS (SELECT doc_id, i, u, rtrim(u, chr(32) || chr(9) || chr(10) || chr(13) || chr(12)) AS k FROM units),
windows AS (SELECT doc_id, i, k, lead(k, 1) OVER w AS k1, lead(k, 2) OVER w AS k2 FROM trimmed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k, k1, k2 ORDER BY doc_id, i) AS r FROM windows WHERE k2 IS NOT NULL),
cut AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM ranked WHERE r > 1),
marked AS (SELECT t.*, c.i IS NOT NULL AS gone, lead(c.i IS NOT NULL) OVER (PARTITION BY t.doc_id ORDER BY t.i) AS next_gone
    FROM trimmed t LEFT JOIN cut c ON t.doc_id = c.doc_id AND t.i = c.i),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_cut, coalesce(string_agg(CASE WHEN next_gone AND u NOT LIKE '%' || chr(10) THEN k || chr(10) ELSE u END, '' ORDER BY i)
    FILTER (NOT gone), '') AS kept FROM marked GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(p), 0) AS BIGINT) AS n_lines, coalesce(n_cut, 0) AS n_cut, CASE WHEN n_cut > 0 THEN kept ELSE text END AS text
FROM pieces LEFT JOIN kept USING (doc_id)
""",
)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and lines cut of every document, by three-line windows over all documents, with the text that is left."""
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_cut").cast("long").alias("n_cut"), "row.text")


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_id.identify(docs, fold(4) != 2)
    return out.select("row.doc_id", held_out(4, 2, "row.doc_id").alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence of at most 2048 tokens and its place there."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pieces = packing.tokenize(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, capacity=2048, end=0)
    return packing.pack(pieces, capacity=2048)


@query("op7_sharding")
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of nearly equal bytes, copies together."""
    out = sharding.shard(spark, table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "range")


PROBE = "\\### Assistant: </turn> ok"


@query(
    "op8_chat_formatting",
    f"""
WITH turns AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}'))),
parts AS (SELECT *, role = 'assistant' AS trained, lag(role, 1, '') OVER w AS prior, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS last,
    length(CASE role WHEN 'system' THEN '### System: ' WHEN 'user' THEN '### User: ' WHEN 'assistant' THEN '### Assistant: ' WHEN 'tool' THEN '### Tool: ' END) + length(' </turn>' || chr(10))
    + length(replace(replace(replace(text, '\\', '\\\\'), '###', '\\###'), '</turn>', '\\</turn>')) AS n
    FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (trained), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (trained), '')) AS loss_sha256,
    CAST(sum(n) AS BIGINT) AS formatted_chars,
    bool_and((prior, role) IN (('', 'system'), ('', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user'), ('assistant', 'tool'), ('tool', 'assistant')))
    AND bool_or(last = 1 AND role = 'assistant') AS valid
FROM parts GROUP BY conv_id
""",
)
def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted text; conversation -7 speaks in control strings."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(chat.format_turns(rows.unionByName(probe)))


#: Labelled rows to learn from; of more, a sample by hash of about this size. Only ids and labels are broadcast.
LEARN_ROWS = 200_000


def labelled(spark: SparkSession, sf_dir: str, docs: DataFrame, label: str, learnable: Column) -> DataFrame:
    """(doc_id, text, label) of the documents to learn from; the texts stay where they are read."""
    labels = table(spark, sf_dir, "labels").filter(F.col(label).isNotNull() & learnable).groupBy("doc_id").agg(F.max(label).cast("int").alias(label))
    share = min(1.0, LEARN_ROWS / max(1, labels.count()))
    kept = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * share))
    found = docs.join(F.broadcast(kept), "doc_id").select("doc_id", "text", label)
    one = found.groupBy(F.xxhash64("text").alias("copy")).agg(F.min("doc_id").alias("doc_id"), F.max(label).alias(label)).drop("copy")
    return docs.join(F.broadcast(one), "doc_id").select("doc_id", "text", label)  # of equal texts one; no more rows than ``kept``


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of held-out documents are not used."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, labelled(spark, sf_dir, docs, "toxic", fold(5) != 0))
    out = toxicity.score(docs, model).withColumn("held_out", held_out(5, 0))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


@query("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; of the learning rows those with remainder 3 calibrate, the others fit."""
    x = cut(quality.measured(table(spark, sf_dir, "documents")), "statistics")
    labels = table(spark, sf_dir, "labels").filter(F.col("quality").isNotNull() & (fold(4) != 2)).groupBy("doc_id").agg(F.max("quality").alias("label"))
    model = quality.learn(x.join(labels, "doc_id").select("x", "label", (fold(4) != 3).alias("fitted")))
    out = quality.score(x, model).withColumn("held_out", held_out(4, 2))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op5_document_fingerprints")
def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, with their likeness and that of the next document."""
    return syncmers.compared(table(spark, sf_dir, "documents"))


@query(
    "op11_source_mixing",
    """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
src AS (SELECT source, count(*) AS n, sum(size) AS s, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS w FROM d GROUP BY source),
filled AS (SELECT *, sum(s) OVER () AS total, coalesce(sum(s) OVER (ORDER BY s * (6 // w), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c,
    sum(w) OVER (ORDER BY s * (6 // w), source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM src),
closed AS (SELECT *, 4 * s * open <= w * (3 * total - 4 * c) AS at_stop FROM filled),
level AS (SELECT 3 * max(total) - 4 * coalesce(sum(s) FILTER (at_stop), 0) AS num, 2 * sum(w) FILTER (NOT at_stop) AS den FROM closed),
targets AS (SELECT source, n, s, CASE WHEN at_stop THEN CAST(2 * s AS DOUBLE) ELSE CAST(w * num AS DOUBLE) / CAST(den AS DOUBLE) END AS target FROM closed, level),
parts AS (SELECT *, CASE WHEN s > 0 THEN CAST(least(2, floor(target / s)) AS BIGINT) ELSE 0 END AS whole FROM targets),
tiers AS (SELECT d.*, p.s, p.target, p.whole, p.target - p.whole * p.s AS rest, CASE WHEN size * n > 8 * p.s THEN 0 WHEN size * n > p.s THEN 1 ELSE 2 END AS tier,
    md5(concat_ws(':', '7', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(size AS VARCHAR))) AS draw FROM d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, tier ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(size) FILTER (tier = 0) OVER (PARTITION BY source) AS s0, sum(size) FILTER (tier < 2) OVER (PARTITION BY source) AS s1 FROM tiers),
first AS (SELECT *, CASE WHEN s > 0 THEN rest * coalesce(s0, 0) / s ELSE 0 END AS b0 FROM placed),
second AS (SELECT *, CASE WHEN s > 0 THEN rest * coalesce(s1, 0) / s ELSE 0 END - coalesce(sum(size) FILTER (tier = 0 AND 2 * before + size <= 2 * b0) OVER (PARTITION BY source), 0) AS b1 FROM first),
third AS (SELECT *, CASE WHEN s > 0 THEN rest * s / s ELSE 0 END - coalesce(sum(size) FILTER (tier = 0 AND 2 * before + size <= 2 * b0 OR tier = 1 AND 2 * before + size <= 2 * b1) OVER (PARTITION BY source), 0) AS b2 FROM second)
SELECT doc_id, source, size, CAST(s AS BIGINT) AS source_size, target,
    CAST(size * (whole + CASE WHEN whole < 2 AND 2 * before + size <= 2 * CASE tier WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM third
""",
)
def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of 150 % of all words takes of every document; sources weigh 3, 1, 2 in turn, at most two epochs."""
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")


@query(
    "op12_conversation_trie",
    """
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, md5(coalesce(role, '') || chr(10) || coalesce(text, '')) AS k,
    length(coalesce(text, '')) AS len FROM conversations),
convs AS (SELECT c, c - c % 100 AS base, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: list_reduce(list_concat([xor(a, b)], CAST(range(8) AS BIGINT[])), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 AS h FROM (SELECT DISTINCT c FROM t)),
taken AS (SELECT convs.*, (SELECT count(*) FROM t WHERE t.c = convs.base AND t.i <= h) AS m FROM convs),
turns AS (SELECT taken.c, t.i AS pos, k, len FROM taken JOIN t ON t.c = taken.base AND t.i <= h
    UNION ALL SELECT taken.c, m + i - h AS pos, k, len FROM taken JOIN t ON t.c = taken.c AND t.i > h),
paths AS (SELECT c, pos AS depth, string_agg(k, '') OVER (PARTITION BY c ORDER BY pos) AS path, len FROM turns UNION ALL SELECT c, 0, '', 0 FROM convs),
nodes AS (SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, any_value(len) AS len FROM paths GROUP BY path, depth),
children AS (SELECT left(path, CAST(32 * (depth - 1) AS BIGINT)) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
tops AS (SELECT left(path, CAST(32 * unnest(range(depth + 1)) AS BIGINT)) AS path, n_children IS NULL AS leaf, (n_convs - 1) * len AS saved FROM nodes LEFT JOIN children USING (path)),
sums AS (SELECT path, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens FROM tops GROUP BY path),
last AS (SELECT path, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ends FROM (SELECT c, arg_max(path, depth) AS path FROM paths GROUP BY c) GROUP BY path)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
    sha256(coalesce(ends, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = left(n.path, CAST(32 * (n.depth - 1) AS BIGINT)) LEFT JOIN children ON children.path = n.path JOIN sums ON sums.path = n.path LEFT JOIN last ON last.path = n.path
""",
)
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations, each rebuilt on the first turns of its hundred's first conversation."""
    nodes = prefix_trie.trie(table(spark, sf_dir, "conversations"), rebuild=prefix_trie.rebuilt)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@query(
    "op13_source_divergence",
    f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
tok AS (SELECT id, lang, source, unnest(t) AS term FROM d),
kept AS (SELECT lang, term FROM tok GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM tok GROUP BY lang, source, term),
c AS (SELECT g.lang, g.source, k.term, v, coalesce(n, 0) AS n FROM g JOIN kept k ON g.lang = k.lang JOIN v ON v.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
p AS (SELECT *, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM c),
q AS (SELECT DISTINCT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (sum(n) OVER (PARTITION BY lang, term) + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM c),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY a.lang, a.source, b.source),
own AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, p - q AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM own) QUALIFY part = 'pair' OR rank <= 50
""",
)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of the sources of each language and the 50 terms by which each source departs most from its language."""
    return divergence.audit(table(spark, sf_dir, "documents"))
