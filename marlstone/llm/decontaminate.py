"""Benchmark decontamination over a distributed positional inverted index, in DataFrame operations only.

The index is a stored table with a posting (term, document, position) for every token of the training texts that some item has, and one for each text's end, made in the only pass that splits texts. Its parts
follow the documents', so that making it shuffles nothing. All that follows reads postings, not texts:

- *Phrases.* A window is ``WINDOW`` consecutive words of an item, or a shorter item whole. From the postings of its ``SEEDS`` rarest terms (by the corpus's own counts), less the terms' offsets in the item, come
  alignments of item and document; those that several lists share are the few candidates. Their other terms' postings, at their offsets in the candidate documents, are then intersected with them. A window occurs where ten consecutive
  offsets of an alignment all have their posting. A window with a term that the corpus lacks ends at once.
- *Proximity.* ``NEAR`` rarest terms of an item that stand, in any order, within ``SLOP`` words of the rarest one, found by joining positions in blocks of ``SLOP``, never all with all.

Documents are known by a hash of doc_id and text, so that repeated and null ids keep rows apart; rows equal in both share one result. Terms are known by 64-bit hashes. Null texts have no
words. Items without words have no windows. Equal items each count. Empty tables give zero counts or no rows. ``mark`` keeps extra columns, except those it adds. A very long text is one row until it is split and many postings
after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import prepare, stored, text_of

WINDOW, SEEDS = 10, 2
NEAR, SLOP = 3, 10
#: Rows of two or three numbers up to this many (tens of MB) are broadcast; beyond it, the join shuffles.
MAX_BROADCAST_ROWS = 500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """A-Z lower-cased; words are runs of digits, a-z and characters beyond ASCII."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), "")


def _small(df: DataFrame) -> DataFrame:
    """``df``, of numbers only, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc", F.xxhash64("doc_id", text_of()))


def _end() -> Column:
    """The term that stands after a text's last word: no word is empty."""
    return F.xxhash64(F.lit(""))


def postings(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(term, doc, pos), of the given ``terms`` (hashes) and the ends only, or of all. ``docs`` has doc."""
    rows = docs.select("doc", F.posexplode(F.array_append(words_of(text_of()), "")).alias("pos", "word")).select(F.xxhash64("word").alias("term"), "doc", "pos")
    if terms is None:
        return rows
    wanted = terms.select("term").unionByName(docs.sparkSession.range(1).select(_end().alias("term"))).distinct()
    return rows.join(_small(wanted), "term", "left_semi")


def near_matches(index: DataFrame, terms: DataFrame, slop: int = SLOP) -> DataFrame:
    """Distinct (ikey, doc, at): where the term of rank 0 stands with every other term of its group at most ``slop`` positions away. ``terms``: (ikey, rank, term), ranks from 0."""
    wanted = terms.join(terms.groupBy("ikey").agg(F.max("rank").alias("others")), "ikey")
    met = index.join(_small(wanted), "term")
    first = met.where("rank = 0").select("ikey", "doc", "others", F.col("pos").alias("at"), F.floor(F.col("pos") / slop).alias("block"))
    other = met.where("rank > 0").select("ikey", "doc", "rank", "pos", F.explode(F.array(*(F.floor(F.col("pos") / slop) + d for d in (-1, 0, 1)))).alias("block"))
    close = first.join(other, ["ikey", "doc", "block"]).where(F.abs(F.col("at") - F.col("pos")) <= slop)
    found = close.groupBy("ikey", "doc", "at", "others").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("rank") - 1)).alias("seen"))
    alone = first.where("others = 0").select("ikey", "doc", "at")
    return found.where(F.col("seen") == F.call_function("shiftleft", F.lit(1), F.col("others")) - 1).select("ikey", "doc", "at").unionByName(alone).distinct()


def proximity_matches(index: DataFrame, terms: list[str], slop: int) -> DataFrame:
    """(doc, at): where the first of ``terms`` stands with every other one at most ``slop`` positions away, in any order."""
    rows = index.sparkSession.createDataFrame([(0, i, t) for i, t in enumerate(dict.fromkeys(terms))], "ikey long, rank int, word string")
    return near_matches(index, rows.select("ikey", "rank", F.xxhash64("word").alias("term")), slop).select("doc", "at")


def items_of(items: DataFrame) -> DataFrame:
    """(ikey, words, item): each distinct word sequence, once for each item that has it."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words_of(text_of()).alias("words")).where(F.size("words") > 0)
    return w.distinct().select(F.xxhash64("words").alias("ikey"), "words", "item")


def rated_terms(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(ikey, ts): each item's terms in order, with n, their number of postings (null if none)."""
    counts = index.where(F.col("term") != _end()).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return stored(terms.join(counts, "term", "left").groupBy("ikey").agg(F.sort_array(F.collect_list(F.struct("off", "n", "term"))).alias("ts")), "decon-rated")  # as long as the item


def _by_rarity(ts: Column) -> Column:
    return F.sort_array(F.transform(ts, lambda t: F.struct(t["n"].alias("n"), t["off"].alias("off"), t["term"].alias("term"))))


def alignments(index: DataFrame, rated: DataFrame, size: int = WINDOW, seeds: int = SEEDS) -> DataFrame:
    """(doc, ikey, shift): where an item laid over a document from position ``shift`` meets at least as many seeds as a window has. A window's seeds are its rarest terms; windows that share a seed share its postings."""

    def rarest(at: Column) -> Column:
        window = F.slice("ts", at, size)
        return F.when(F.forall(window, lambda t: t["n"].isNotNull()), F.slice(_by_rarity(window), 1, seeds)).otherwise(F.slice(_by_rarity(window), 1, 0))

    chosen = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size("ts") - size + 1, F.lit(1))), rarest)))
    lookup = rated.select("ikey", F.least(F.size("ts"), F.lit(min(seeds, size))).alias("need"), F.explode(chosen).alias("t")).select("ikey", "need", F.col("t.off").alias("off"), F.col("t.term").alias("term"))
    met = index.join(_small(stored(lookup, "decon-seeds")), "term").select("doc", "ikey", "need", (F.col("pos") - F.col("off")).alias("shift"))
    return met.groupBy("doc", "ikey", "shift", "need").agg(F.count(F.lit(1)).alias("n")).where("n >= need").select("doc", "ikey", "shift")


def occurrences(index: DataFrame, rated: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc, ikey, start, length) of every window's occurrences."""
    laid = stored(alignments(index, rated, size), "decon-laid")
    own = index.join(_small(laid.select("doc").distinct()), "doc", "left_semi")
    terms = rated.select("ikey", F.size("ts").alias("length"), F.explode("ts").alias("t")).select("ikey", "length", "t.off", "t.term")
    due = laid.join(terms, "ikey").select("doc", (F.col("shift") + F.col("off")).alias("pos"), "term", "ikey", "shift", "off", F.least("length", F.lit(size)).alias("length"))
    met = due.join(own, ["doc", "pos", "term"]).groupBy("doc", "ikey", "shift", "length").agg(F.sort_array(F.collect_set("off")).alias("offs"))  # as long as the item
    whole = F.filter("offs", lambda o, i: F.get(F.col("offs"), i + F.col("length") - 1) == o + F.col("length") - 1)
    return met.select("doc", "ikey", "shift", "length", F.explode(whole).alias("off")).select("doc", "ikey", (F.col("shift") + F.col("off")).alias("start"), "length")


def mark(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items (sorted ids as text), hit_starts (start and length of each occurrence) and n_near (items whose rarest terms stand close together)."""
    prepare(docs.sparkSession)
    added = ["n_words", "n_hit", "n_items", "items", "hit_starts", "n_near"]
    docs = docs.drop(*added, "doc")
    named = stored(items_of(items), "decon-items")
    each = named.select("ikey", "words").dropDuplicates(["ikey"])
    terms = each.select("ikey", F.posexplode("words").alias("off", "word")).select("ikey", "off", F.xxhash64("word").alias("term"))
    index = stored(postings(keyed(docs), terms.select("term").distinct()), "decon-index")
    rated = rated_terms(index, terms)
    found = stored(occurrences(index, rated, size), "decon-found")
    distinct_terms = F.filter(_by_rarity(F.filter("ts", lambda t: t["n"].isNotNull())), lambda t: F.size(F.filter("ts", lambda o: (o["term"] == t["term"]) & (o["off"] < t["off"]))) == 0)
    rare = rated.select("ikey", F.posexplode(F.slice(distinct_terms, 1, NEAR)).alias("rank", "t")).select("ikey", "rank", "t.term")
    near = near_matches(index, rare).select("doc", "ikey").distinct().join(named.select("ikey", "item"), "ikey").groupBy("doc").agg(F.count_distinct("item").alias("n_near"))
    covered = F.array_distinct(F.flatten(F.transform("hit_starts", lambda c: F.sequence(c["start"], c["start"] + c["length"] - 1))))
    hits = found.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("hit_starts")).select("doc", "hit_starts", F.size(covered).cast("long").alias("n_hit"))  # as long as the document
    of_items = found.select("doc", "ikey").distinct().join(named.select("ikey", "item"), "ikey").groupBy("doc").agg(F.sort_array(F.collect_set("item")).alias("items"))
    ends = index.where(F.col("term") == _end()).groupBy("doc").agg(F.max("pos").cast("long").alias("n_words"))
    told = ends.join(hits, "doc", "left").join(of_items, "doc", "left").join(near, "doc", "left")
    out = keyed(docs).join(told, "doc", "left").drop("doc")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(*docs.columns, zero("n_words"), zero("n_hit"), F.size(items_).cast("long").alias("n_items"), items_.alias("items"), F.coalesce("hit_starts", F.array().cast("array<struct<start:int,length:int>>")).alias("hit_starts"), zero("n_near"))


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = mark(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near")


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
bw AS (SELECT item_id, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda i: list_slice(ws, i, i + 9))) AS w FROM b WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT len(w) AS n FROM bw),
dw AS (SELECT doc_id, n, i, list_slice(ws, i, i + n - 1) AS w FROM d, sizes, unnest(range(1, len(ws) - n + 2)) AS t(i) WHERE len(ws) >= n),
h AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.w = bw.w),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id),
dt AS (SELECT doc_id, unnest(ws) AS term, unnest(range(len(ws))) AS p FROM d),
bt AS (SELECT item_id, term, min(o) AS o FROM (SELECT item_id, unnest(ws) AS term, unnest(range(len(ws))) AS o FROM b) GROUP BY item_id, term),
c AS (SELECT term, count(*) AS n FROM dt WHERE term IN (SELECT term FROM bt) GROUP BY term),
r AS (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY n, o) AS k, count(*) OVER (PARTITION BY item_id) AS m FROM bt JOIN c USING (term)),
rp AS (SELECT item_id, k, least(m, 3) AS m, doc_id, p FROM r JOIN dt USING (term) WHERE k <= 3),
nr AS (SELECT DISTINCT f.item_id, f.doc_id FROM rp f JOIN rp g ON f.item_id = g.item_id AND f.doc_id = g.doc_id AND f.k = 1 AND abs(f.p - g.p) <= 10 GROUP BY f.item_id, f.doc_id, f.p, f.m HAVING count(DISTINCT g.k) = f.m),
nn AS (SELECT doc_id, count(*) AS n_near FROM nr GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN nn USING (doc_id)"""
