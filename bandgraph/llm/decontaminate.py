"""Benchmark decontamination by a prefix-filtered join of item windows [native]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bandgraph.llm.common import lower_ascii, own_names, quoted, without
from bandgraph.session import cut, table

WIDTH = 10
#: What is between words: ASCII that is neither letter a-z nor digit, one by one, which Java looks up in one table.
BREAK = "[" + "".join(rf"\x{i:02X}" for i in [*range(48), *range(58, 97), *range(123, 128)]) + "]+"
#: A word in either case, to count words without lower-casing.
WORD = "[^" + "".join(rf"\x{i:02X}" for i in [*range(48), *range(58, 65), *range(91, 97), *range(123, 128)]) + "]+"
#: Windows up to this many rows (about 200 bytes each) are broadcast; beyond it both sides are shuffled.
BROADCAST_ROWS = 500_000
#: Documents are read in pieces of this many words, each with the WIDTH - 1 words after it, so that no row grows with
#: its text and a very long document is spread over many rows.
PIECE = 256


def words(text: Column) -> Column:
    """Words of a text, in order; an empty array for a text that is null or has none."""
    w = F.split(lower_ascii(text), BREAK)
    return F.coalesce(F.filter(w, lambda x: x != ""), F.array().cast("array<string>"))


def windows(bench: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, gram, len) distinct: every run of width words of an item; a shorter item is one run."""
    w = bench.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.size("w")
    runs = F.when(n <= width, F.array("w")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.slice("w", i, width)))
    return w.select("item_id", F.explode(runs).alias("gram")).distinct().withColumn("len", F.size("gram"))


def _prefixes(wins: DataFrame, pieces: DataFrame, small: bool) -> DataFrame:
    """(gram, len, items, token, offset): the rarest word of each window and its place, by document frequency counts.

    A window must occur whole (containment 1), so by the prefix filter its rarest word alone is a necessary token.
    """
    grams = wins.groupBy("gram", "len").agg(F.collect_set("item_id").alias("items"))
    vocabulary = grams.select(F.explode("gram").alias("token")).distinct()
    hint = F.broadcast if small else (lambda x: x)
    seen = pieces.select(F.explode(F.slice("piece", 1, PIECE)).alias("token")).join(hint(vocabulary), "token").groupBy("token").agg(F.count("*").alias("n"))
    placed = grams.select("gram", "len", "items", F.posexplode("gram").alias("offset", "token")).join(hint(seen), "token", "left")
    # A word that no document has rules the window out; it is first in the order, and the join finds nothing.
    best = placed.groupBy("gram").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "token", "len", "items")).alias("p"))
    return best.select("gram", "p.len", "p.items", "p.token", "p.offset")


def occurrences(docs: DataFrame, bench: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text_key, start, len, items): where a window occurs in a document, by word position from 0.

    Tokens are words, ordered by their count over all documents, the rarest first. Document words are joined with the
    windows' prefix tokens; the word's place in the window gives the start, which must lie in the document with the whole
    window (position and length bounds); the window-sized slice there must equal the window word by word.
    """
    key = F.xxhash64("text").alias("text_key")
    base = docs.select("doc_id", key, words(F.col("text")).alias("w")).where(F.size("w") > 0)
    # The slice begins width - 1 words early too, for prefix tokens late in a window.
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(PIECE))).alias("at")
    pieces = base.select("doc_id", "text_key", "w", at)
    lead = F.least("at", F.lit(width - 1)).cast("int")
    pieces = pieces.select("doc_id", "text_key", "at", lead.alias("lead"), F.slice("w", F.col("at") + 1, PIECE).alias("piece"), F.slice("w", F.col("at") - lead + 1, lead + PIECE + width - 1).alias("near"))
    wins = cut(windows(bench, width))
    small = wins.count() <= BROADCAST_ROWS
    prefixes = cut(_prefixes(wins, pieces.select("piece"), small))
    each = pieces.select("doc_id", "text_key", "at", "lead", "near", F.posexplode("piece").alias("i", "token"))
    found = each.join(F.broadcast(prefixes) if small else prefixes, "token")
    first = F.col("lead") + F.col("i") - F.col("offset")  # in near, from 0
    found = found.where((first >= 0) & (first + F.col("len") <= F.size("near"))).where(F.slice("near", first + 1, F.col("len")) == F.col("gram"))
    return found.select("doc_id", "text_key", (F.col("at") + F.col("i") - F.col("offset")).alias("start"), "len", "items")


def decontaminate(docs: DataFrame, bench: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with n_words, n_hit (words inside an occurrence), items (ids with an occurring window, sorted as strings), contaminated.

    Nulls: a null text has no words; a null id is an id like others; a null item text has no windows, a null item_id
    isn't listed. Ties and repeated rows: equal (id, text) rows are looked up once per row and get equal results. Items of
    fewer than width words are one window of their own length. Empty tables: no rows, or nothing contaminated. Columns
    that clash with the added ones are replaced; other extra columns stay.
    """
    slim = docs.select("doc_id", "text")
    occ = cut(occurrences(slim, bench.select("item_id", "text"), width))
    keys = ("doc_id", "text_key")
    spans = occ.groupBy(*keys, "start").agg(F.max(F.col("start") + F.col("len")).alias("stop"))
    w = Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.greatest(F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(w), F.lit(0))), F.lit(0))
    hits = spans.withColumn("covered", covered).groupBy(*keys).agg(F.sum("covered").alias("n_hit"))
    items = occ.select(*keys, F.explode("items").alias("item")).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list(F.col("item").cast("string"))).alias("items"))
    found = hits.join(items.select(*(F.col(k).alias(f"i_{k}") for k in keys), "items"), F.col("doc_id").eqNullSafe(F.col("i_doc_id")) & (F.col("text_key") == F.col("i_text_key")), "left")
    k, f_id, f_key, f_hit, f_items = own_names(docs, "key", "f_doc_id", "f_key", "f_hit", "f_items")
    found = found.select(F.col("doc_id").alias(f_id), F.col("text_key").alias(f_key), F.col("n_hit").alias(f_hit), F.col("items").alias(f_items))
    out = docs.withColumn(k, F.xxhash64("text")).join(found, F.col("doc_id").eqNullSafe(F.col(f_id)) & (F.col(k) == F.col(f_key)), "left")
    n = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    hit = F.coalesce(f_hit, F.lit(0)).cast("bigint")
    kept = map(quoted, without(docs, "n_words", "n_hit", "items", "contaminated"))
    return out.select(*kept, n.alias("n_words"), hit.alias("n_hit"), F.coalesce(f_items, F.array().cast("array<string>")).alias("items"), (hit > 0).alias("contaminated"))


def op5_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), g AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram, least(10, len(w)) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM g), dg AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)
), occ AS (SELECT dg.doc_id, dg.p, dg.n, g.item_id FROM dg JOIN g ON dg.gram = g.gram AND dg.n = g.n),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM occ) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
       FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
