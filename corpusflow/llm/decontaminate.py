"""Benchmark decontamination on a distributed positional inverted index (operator 8).

DataFrame functions only.

1. The documents' postings ``(key, ih, th, pos)`` of the benchmark's terms are stored once, every shard
   (input partition) sorted by term, so each term's list is one stretch of every shard. Texts are not moved.
2. List lengths are counted on that index. Of every benchmark window the two rarest places are asked for.
3. Lists are offset-adjusted: posting minus place in the item gives the start of an alignment. The rarest
   list is intersected with the next one; alignments that both hold are intersected with the
   lists of all other places of their windows. Runs of places met are the exact phrase matches.

``key`` is the 64-bit hash of a benchmark term (a document's word is compared as text before it becomes a key);
a document is known by ``ih``, the hash of its id, and ``th``, the hash of its text, 128 bits together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize, release

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
DOC = ["ih", "th"]


def raw_words(text: Column) -> Column:
    """Words in their own case; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAKS), "")


def small(w: Column) -> Column:
    """A-Z in lower case, all other letters unchanged."""
    plain = F.octet_length(w) == F.char_length(w)  # lower() is fast, and the same on ASCII
    return F.when(plain, F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))


def items_of(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(item, ids, words)``: distinct word sequences and the item ids that have them."""
    b = benchmark.select(F.col(id_col).cast("string").alias("id"), F.transform(raw_words(F.col(text_col)), small).alias("words"))
    b = b.where(F.size("words") > 0).groupBy("words").agg(F.collect_set("id").alias("ids"))
    return b.select(F.xxhash64("words").alias("item"), "ids", "words")


def doc_key(id_col: str, text_col: str) -> list[Column]:
    return [F.xxhash64(id_col).alias("ih"), F.xxhash64(text_col).alias("th")]


def build_index(docs: DataFrame, items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The stored index: one posting ``(key, ih, th, pos)`` per word of a document that is a benchmark term, positions from 0."""
    terms = materialize(items.select(F.explode("words").alias("term")).distinct(), "terms")
    words = docs.select(*doc_key(id_col, text_col), F.posexplode(raw_words(F.col(text_col))).alias("pos", "w"))
    posted = words.select(*DOC, "pos", small(F.col("w")).alias("term")).join(terms, "term")
    index = materialize(posted.select(F.xxhash64("term").alias("key"), *DOC, "pos").sortWithinPartitions("key"), "index")
    release(terms)
    return index


def item_places(items: DataFrame, index: DataFrame, window: int) -> DataFrame:
    """``(item, n, size, at, key, df)``: the places of every item with the length of the list of the term there."""
    lists = index.groupBy("key").agg(F.count("*").alias("df"))
    places = items.select("item", F.size("words").alias("n"), F.posexplode("words").alias("at", "w"))
    return (places.withColumns({"key": F.xxhash64("w"), "size": F.least(F.lit(window), F.col("n"))}).drop("w")
            .join(lists, "key", "left").select("item", "n", "size", "at", "key", F.coalesce("df", F.lit(0)).alias("df")))


def probes(places: DataFrame) -> DataFrame:
    """``(item, a1, k1, a2, k2)``: the two rarest places of each window and their terms (ties: the first).

    A window of one word has that place twice; a window with a term that no document has is not asked for.
    """
    starts = F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("size") + 1), F.least(F.col("at"), F.col("n") - F.col("size")))
    rank = Window.partitionBy("item", "s").orderBy("df", "at")
    ranked = places.withColumn("s", F.explode(starts)).withColumn("r", F.row_number().over(rank)).where("r <= 2")
    place = F.struct("df", "at", "key")
    two = ranked.groupBy("item", "s").agg(F.max(F.when(F.col("r") == 1, place)).alias("x"), F.max(F.when(F.col("r") == 2, place)).alias("y"))
    two = two.where("x.df > 0").withColumn("y", F.coalesce("y", "x"))
    return two.select("item", F.col("x.at").alias("a1"), F.col("x.key").alias("k1"), F.col("y.at").alias("a2"), F.col("y.key").alias("k2")).distinct()


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text",
            item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Exact phrase matches: ``(ih, th, start, item, ids, size, lo, hi)``.

    ``start`` is where the item would begin in the document; its places ``lo`` to ``hi`` all stand there, and a
    window of ``size`` words at each of ``lo`` to ``hi - size + 1``.
    """
    items = materialize(items_of(benchmark, item_id, item_text), "items")
    index = build_index(docs, items, id_col, text_col)
    places = materialize(item_places(items, index, window), "places")
    pairs = materialize(probes(places), "probes")

    start = (F.col("pos") - F.col("at")).alias("start")
    first = (index.join(pairs.withColumnsRenamed({"k1": "key", "a1": "at"}), "key")
             .select(*DOC, "item", start, F.col("at").alias("a1"), "a2").distinct())
    second = (index.join(pairs.select("item", F.col("k2").alias("key"), F.col("a2").alias("at")).distinct(), "key")
              .select(*DOC, "item", start, F.col("at").alias("a2")).distinct())
    both = first.join(second, [*DOC, "item", "start", "a2"], "left_semi")
    aligned = materialize(both.select(*DOC, "item", "start", "a1").distinct(), "aligned")

    # all places of the windows that an aligned pair can belong to
    near = (pairs.select("item", "a1").distinct().join(places, "item").where(F.abs(F.col("at") - F.col("a1")) < F.col("size"))
            .select("item", "a1", "at", "key", "size"))
    asked = (aligned.join(near, ["item", "a1"]).withColumn("pos", F.col("start") + F.col("at")).where("pos >= 0")
             .select(*DOC, "item", "start", "size", "at", "pos", "key").distinct())
    lists = index.join(aligned.select(*DOC).distinct(), DOC, "left_semi").select(*DOC, "pos", "key").distinct()
    met = asked.join(lists, [*DOC, "pos", "key"], "left_semi")
    run = F.col("at") - F.row_number().over(Window.partitionBy(*DOC, "item", "start").orderBy("at"))
    runs = (met.withColumn("run", run).groupBy(*DOC, "item", "start", "size", "run").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
            .where("hi - lo + 1 >= size"))
    out = materialize(runs.join(items.select("item", "ids"), "item").select(*DOC, "start", "item", "ids", "size", "lo", "hi"), "matches")
    for t in (index, aligned, pairs, places, items):
        release(t)
    return out


def near_matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, slop: int = 4, id_col: str = "doc_id",
                 text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Proximity matches: documents that hold all words of a window, in any order, within ``window + slop`` words.

    Returns ``(id_col, item, at, pos)``: the window starts at ``at`` in the item; ``pos`` is the posting of its
    rarest term. Repeated words of a window are asked for once. Lists meet by stretch of ``window + slop``
    positions, so a document never meets itself as a whole.
    """
    items = materialize(items_of(benchmark, item_id, item_text), "items")
    index = build_index(docs, items, id_col, text_col)
    places = item_places(items, index, window)
    reach = window + slop
    starts = F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("size") + 1), F.least(F.col("at"), F.col("n") - F.col("size")))
    windows = places.withColumn("s", F.explode(starts)).groupBy("item", "s").agg(
        F.min(F.struct("df", "at", "key")).alias("x"), F.collect_set("key").alias("asked"))
    windows = materialize(windows.where("x.df > 0").select("item", "s", "asked", F.col("x.key").alias("key")), "windows")

    stretch = F.floor(F.col("pos") / reach).cast("int")
    at = index.join(windows, "key").select(*DOC, "item", "s", "asked", "pos").distinct()
    wanted = (at.withColumn("key", F.explode("asked")).withColumn("b", F.explode(F.sequence(stretch - 1, stretch + 1))))
    lists = index.select(*DOC, "key", F.col("pos").alias("p"), stretch.alias("b"))
    there = (wanted.join(lists, [*DOC, "key", "b"]).where(F.abs(F.col("p") - F.col("pos")) < reach)
             .groupBy(*DOC, "item", "s", "asked", "pos").agg(F.collect_set(F.struct("p", "key")).alias("there")))

    def whole(a: Column) -> Column:
        inside = F.filter("there", lambda x: (x["p"] >= a["p"]) & (x["p"] < a["p"] + reach))
        return ((a["p"] <= F.col("pos")) & (F.col("pos") < a["p"] + reach)
                & (F.size(F.array_distinct(F.transform(inside, lambda x: x["key"]))) == F.size("asked")))

    found = there.where(F.exists("there", whole)).select(*DOC, "item", F.col("s").alias("at"), "pos")
    names = docs.select(F.col(id_col), *doc_key(id_col, text_col)).distinct()
    return found.join(names, DOC).select(id_col, "item", "at", "pos")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, id_col: str = "doc_id",
                  text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, th (hash of the text), n_words, n_hit, n_items, items (ids as strings, sorted), contaminated.

    A word is hit inside any occurrence of ``window`` consecutive words of an item, or of a whole shorter
    item; contaminated means that at least one in ``share`` words is hit. Null and empty texts have no
    words and are clean; items without words ask for nothing; repeated items count once per
    id; repeated documents are judged each; ids may be null and of any type; an empty table on either side gives
    no hits; other columns are ignored; texts may be of any length.
    """
    found = matches(docs, benchmark, window, id_col, text_col, item_id, item_text)
    hit = found.select(*DOC, F.explode(F.sequence(F.col("start") + F.col("lo"), F.col("start") + F.col("hi"))).alias("pos")).distinct()
    named = found.select(*DOC, F.explode("ids").alias("x")).distinct()
    per_doc = (hit.groupBy(*DOC).agg(F.count("*").alias("n_hit"))
               .join(named.groupBy(*DOC).agg(F.array_sort(F.collect_list("x")).alias("items")), DOC, "left"))
    d = docs.select(F.col(id_col).alias("id"), *doc_key(id_col, text_col),
                    F.size(raw_words(F.col(text_col))).cast("bigint").alias("n_words"))
    out = d.join(per_doc, DOC, "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col("id").alias(id_col), "th", "n_words", n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
                      items.alias("items"), ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, id_col: str = "doc_id",
          text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated; nulls, ties and empty tables as ``contamination`` has them."""
    judged = contamination(docs, benchmark, window, share, id_col, text_col, item_id, item_text)
    bad = materialize(judged.where("contaminated").select(F.xxhash64(id_col).alias("__ih"), F.col("th").alias("__th")).distinct(),
                      "contaminated")
    cond = (F.xxhash64(docs[id_col]) == bad["__ih"]) & (F.xxhash64(docs[text_col]) == bad["__th"])
    return docs.join(bad, cond, "left_anti")
