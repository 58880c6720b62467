"""Personal data by patterns, and what else reveals it by corpus co-occurrence; in DataFrame operations only.

Base spans are e-mail addresses, IPv4 addresses, payment cards (Luhn) and phone numbers. A span's place comes from the lengths of what a pattern matches and of
what it leaves between. The patterns are the contract's, with possessive repetition and start guards that skip places where the plain form fails as well (or where a card has too few digits to be kept): linear time and
no recursion on long runs.

Information-theoretic sanitisation: beside each base span stand up to ``CONTEXT`` terms on either side, as far as the next span. For an entity (the span's kind and value) and a term, the corpus
gives p(entity | term) = different texts with both side by side / different texts that hold the term. The term's pointwise mutual information with the entity is log p(entity | term) / p(entity); where it
leaves at most ``MAX_BITS`` of the entity's own information, -log p(entity), hidden, and at least ``SUPPORT`` texts bear it out, the term discloses the entity and is
removed (kind ``term``) wherever it stands, in every text of the corpus, beside the entity or not. Equal surroundings count once in both numbers, however often they are copied, and so do equal texts. Terms that stand near an entity but
never beside it are not weighed.

Sums along a text's matches are taken in two levels of some square root of their number, and text is cut from blocks of ``BLOCK`` characters, so that a text of any length and any number of matches costs little more than linear time; no text is cut
off. Texts, entities and terms are known by 64-bit hashes. Null texts are empty and have no spans. Positions count code points. Repeated rows have the same spans. Empty tables give no rows. Extra columns
stay, except those that are added.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import prepare, stored, text_of

#: Kinds in order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"(?<![0-9])(?<![0-9][\x20-])(?=(?:[0-9][\x20-]?){12})[0-9]++(?:[\x20-][0-9]++)*+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
TERM = r"\p{L}{2,}+"

CONTEXT, SUPPORT, MAX_BITS = 5, 3, 1.0
#: Hashes (8 bytes each) up to this many are broadcast; beyond it, the join shuffles.
MAX_BROADCAST_ROWS = 500_000
BLOCK = 4096

_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """The running totals of an array of int (from 0) under an associative ``merge``, in chunks of the square root of its size: growing an array by one copies it."""
    none = F.array().cast("array<int>")

    def walked(chunk: Column, start: Column) -> Column:
        step = lambda acc, x: _let(merge(acc["at"], x), lambda now: F.struct(now.alias("at"), F.concat(acc["out"], F.array(now)).alias("out")))
        return F.aggregate(chunk, F.struct(start.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def whole(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda k: F.slice(v, k * width + 1, width))

        def joined(c: Column) -> Column:
            totals = F.transform(c, lambda x: F.aggregate(x, F.lit(0), merge))
            return _let(walked(totals, F.lit(0)), lambda ends: F.flatten(F.zip_with(c, F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1)), walked)))

        return _let(chunks, joined)

    return _let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(none))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def places(text: Column, pattern: str) -> Column:
    """Array of (start, end, found) for the matches of a pattern, leftmost and not overlapping."""
    empty = F.array().cast("array<struct<start:int,end:int,found:string>>")

    def told(found: Column) -> Column:
        sizes = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
        return F.zip_with(running(sizes, _sum), found, lambda end, m: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("found")))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, told(found)).otherwise(empty))


def _valid(kind: int, found: Column) -> Column:
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        plain = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(found, r"\."), lambda p: (F.length(plain(p)) <= 3) & (F.coalesce(F.try_to_number(plain(p), F.lit("999")), F.lit(0)) <= 255))
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == 2:
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(9, 15)


def _of_kind(kind: int, matches: Column) -> Column:
    good = F.filter(matches, lambda s: _valid(kind, s["found"]))
    return F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["found"].alias("found")))


def base_spans(text: Column) -> Column:
    """Array of (start, kind, end, found) over all kinds, by start and then kind."""
    return F.array_sort(F.concat(*(_of_kind(k, places(text, pattern)) for k, pattern in enumerate(PATTERNS))))


def _piece(blocks: Column, a: Column, b: Column) -> Column:
    """The text from ``a`` to ``b`` out of its blocks."""
    i, j = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
    block = lambda k: F.coalesce(F.get(blocks, k), F.lit(""))
    ends = lambda: F.concat(F.array(F.substring(block(i), a % BLOCK + 1, F.lit(BLOCK))), F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), F.array(F.substring(block(j), F.lit(1), b % BLOCK)))
    return F.when(i == j, F.substring(block(i), a % BLOCK + 1, b - a)).otherwise(F.array_join(ends(), ""))


def _parted(text: Column, spans: Column, body: Callable[[Column, Column, Column], Column]) -> Column:
    """``body(heads, gaps, cluster)``. Spans that overlap are one cluster; heads are the clusters' first spans, gaps the texts before, between and after clusters, and cluster has the number (from 1) of each span's."""
    tops = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))

    def with_tops(top: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.slice(top, 1, F.size(top) - 1))
        marked = F.zip_with(spans, before, lambda s, at: F.struct(s.alias("s"), at.alias("at"), (s["start"] >= at).alias("head")))

        def with_marks(m: Column) -> Column:
            heads = F.filter(m, lambda x: x["head"])
            cluster = running(F.transform(m, lambda x: x["head"].cast("int")), _sum)
            blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
            gaps = lambda bs: F.concat(F.transform(heads, lambda x: _piece(bs, x["at"], x["s"]["start"])), F.array(_piece(bs, F.element_at(top, -1), F.length(text))))
            return _let(F.struct(F.transform(heads, lambda x: x["s"]).alias("heads"), _let(blocks, gaps).alias("gaps"), cluster.alias("cluster")), lambda x: body(x["heads"], x["gaps"], x["cluster"]))

        return _let(marked, with_marks)

    return _let(tops, with_tops)


def _terms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda t: F.xxhash64(F.lower(t)))


def mentions_of(text: Column, spans: Column) -> Column:
    """For each span (entity, context, terms): hashes of its kind and value, of the terms around it, and of each of these."""

    def told(heads: Column, gaps: Column, cluster: Column) -> Column:
        def around(terms: Column) -> Column:
            def one(s: Column, c: Column) -> Column:
                before, after = F.element_at(terms, c), F.element_at(terms, c + 1)
                near = F.concat(F.slice(before, F.greatest(F.size(before) - (CONTEXT - 1), F.lit(1)), CONTEXT), F.lit([0]).cast("array<bigint>"), F.slice(after, 1, CONTEXT))
                return F.struct(F.xxhash64(s["kind"], F.lower(s["found"])).alias("entity"), F.xxhash64(near).alias("context"), F.array_remove(F.array_distinct(near), 0).alias("terms"))

            return F.zip_with(spans, cluster, one)

        return _let(F.transform(gaps, _terms), around)

    return _parted(text, spans, told)


def found_in(docs: DataFrame) -> DataFrame:
    """``docs`` with text_hash and base (array of spans)."""
    return docs.withColumns({"text_hash": F.xxhash64(text_of()), "base": base_spans(text_of())})


def _hashes(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= MAX_BROADCAST_ROWS else rows


def disclosing(docs: DataFrame, mentions: DataFrame, support: int = SUPPORT, max_bits: float = MAX_BITS) -> DataFrame:
    """(entity, term) pairs beyond the disclosure threshold. ``docs``: with text_hash; ``mentions``: (entity, context, term, text_hash)."""
    once = mentions.groupBy("entity", "term", "context").agg(F.min("text_hash").alias("text_hash")).select("entity", "term", "text_hash").distinct()
    pairs = once.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= support)
    beside = mentions.select("entity", "term", "text_hash").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("raw"))
    pairs = pairs.join(beside, ["entity", "term"])

    def told(texts: Column) -> Column:
        """Whether the term leaves few of the entity's bits hidden, if it stands in so many texts; those in which surroundings are copied are one here too."""
        return -F.log2(F.col("both") / (texts - F.col("raw") + F.col("both"))) <= max_bits

    # a term that stands beside too many other entities already is in too many texts: only the rest are counted in all texts
    near = mentions.select("term", "text_hash").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("near"))
    pairs = stored(pairs.join(near, "term").where(told(F.col("near"))), "pii-pairs")
    held = holding(docs, _hashes(pairs.select("term").distinct()))
    return pairs.join(held.groupBy("term").agg(F.count(F.lit(1)).alias("texts")), "term").where(told(F.col("texts"))).select("entity", "term")


def holding(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Distinct (text_hash, term) of the given ``terms``, from whole texts."""
    return docs.select("text_hash", F.explode(F.array_distinct(_terms(text_of()))).alias("term")).join(terms, "term", "left_semi").distinct()


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with text_hash, base and spans: arrays of (start, kind, end); kind is an index into ``KINDS``, or 4 for a disclosing term."""
    prepare(docs.sparkSession)
    docs = docs.drop("text_hash", "base", "spans")
    texts = docs.select(text_of().alias("text"), F.xxhash64(text_of()).alias("text_hash"))
    seen = found_in(docs.select("text")).where(F.size("base") > 0)
    short = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    kept = stored(seen.select("text_hash", short.alias("plain"), mentions_of(text_of(), F.col("base")).alias("mentions")).dropDuplicates(["text_hash"]).withColumnRenamed("plain", "base"), "pii-found")
    flat = kept.select("text_hash", F.explode("mentions").alias("m")).select("text_hash", "m.entity", "m.context", F.explode("m.terms").alias("term"))
    terms = stored(disclosing(texts, flat).select("term").distinct(), "pii-terms")
    reached = stored(holding(texts, _hashes(terms)).groupBy("text_hash").agg(F.collect_list("term").alias("terms")), "pii-reached")
    at = F.filter(places(F.col("text"), TERM), lambda t: F.array_contains(F.col("terms"), F.xxhash64(F.lower(t["found"]))))
    added = F.transform(at, lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), t["end"].alias("end")))
    hashes = _hashes(reached.select("text_hash"))
    more = texts.join(hashes, "text_hash", "left_semi").dropDuplicates(["text_hash"]).join(reached, "text_hash").select("text_hash", added.cast(_SPANS).alias("added"))
    none = F.array().cast(_SPANS)
    rows = kept.select("text_hash", F.col("base").cast(_SPANS).alias("base")).join(more, "text_hash", "full")
    rows = rows.select(F.col("text_hash").alias("__h"), F.coalesce("base", none).alias("base"), F.array_sort(F.concat(F.coalesce("base", none), F.coalesce("added", none))).alias("spans"))
    out = docs.withColumn("text_hash", F.xxhash64(text_of())).join(stored(rows, "pii-spans"), F.col("text_hash") == F.col("__h"), "left").drop("__h")
    return out.withColumns({"base": F.coalesce("base", none), "spans": F.coalesce("spans", none)})


def digest(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in (*KINDS, "term")))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with every span generalised to its kind, ``[EMAIL]`` and so on, and disclosing terms removed; spans that overlap become the first one's kind."""
    tags = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS), F.lit("[TERM]"))

    def told(heads: Column, gaps: Column, cluster: Column) -> Column:
        named = F.zip_with(F.slice(gaps, 1, F.size(heads)), heads, lambda g, s: F.concat(g, F.element_at(tags, s["kind"] + 1)))
        return F.concat(F.array_join(named, ""), F.element_at(gaps, -1))

    done = _parted(text_of(), F.col("spans"), told)
    return find(docs).withColumn("text", F.when(F.size("spans") > 0, done).otherwise(F.col("text"))).drop("text_hash", "base", "spans")


def op9_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = find(docs)
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))
