"""Benchmark passages in training texts, by a distributed positional inverted index.

The index holds a posting (term, document, position) for every occurrence in the training texts of a
term that the test texts hold, in order of term within each file. Search starts from the rarest
term of a phrase: its postings, moved back by the term's offset, are the places where the phrase may
start. The list of its second rarest term, moved likewise, is intersected with them, then those of
all others at once. Proximity search starts from the rarest term, too, and looks for the others
around it.

Everything is built-in expressions. Small sides (phrases, few candidates) are stored, so that Catalyst
knows their size and decides whether to broadcast them; beyond its limit the joins shuffle, with
the adaptive skew join for hot terms. No posting list is ever one row.

Words are the maximal runs of 0-9, A-Z, a-z and anything beyond ASCII; A-Z count as a-z. A phrase
matches where its words stand in a row.

Defined cases: a null or empty text has no words and no match; items without words have no windows; an
item without a key counts as one with the empty key, items of one key as one; rows that repeat are
judged each, whatever their keys; empty tables give empty results or none hit; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from actorlens.operators.ordering import ordered_index
from actorlens.sources.storage import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased and nothing else."""
    known = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(known) == F.char_length(known)
    lowered = F.when(ascii_only, F.lower(known)).otherwise(F.translate(known, UPPER, LOWER))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def windows(items: DataFrame, size: int, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, terms): all runs of ``size`` words of each item; all its words where it has fewer."""
    cut = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w"))
    last = F.greatest(F.size("w") - size, F.lit(0))
    starts = cut.filter(F.size("w") > 0).select("item", "w", F.explode(F.sequence(F.lit(0), last)).alias("s"))
    return starts.select("item", F.slice("w", F.col("s") + 1, F.lit(size)).alias("terms"))


@dataclass
class PositionalIndex:
    """``terms`` (term, tid) and ``postings`` (ref, tid, pos); every text also has one row of its key and length.

    ``ref`` numbers the rows of the indexed table. ``key`` and ``n_words`` stand in the row of a text's first word, or
    in one without position where there is none.
    """

    terms: DataFrame
    postings: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, vocabulary: DataFrame, key: str = "doc_id", text: str = "text") -> PositionalIndex:
        """Index ``docs`` for phrases of the words in ``vocabulary`` (term)."""
        terms = materialise(ordered_index(vocabulary.select("term").distinct(), "term", name="tid"))
        cut = docs.select(F.monotonically_increasing_id().alias("ref"), F.col(key).alias("key"), words(F.col(text)).alias("w"))
        tokens = cut.select("ref", "key", F.size("w").alias("n"), F.posexplode_outer("w").alias("pos", "term"))
        first = F.coalesce(F.col("pos"), F.lit(0)) == 0
        known = tokens.join(terms, "term", "left").filter(F.col("tid").isNotNull() | first)
        postings = known.select(
            "ref",
            F.col("tid").cast("int").alias("tid"),
            "pos",
            F.when(first, F.col("key")).alias("key"),
            F.when(first, F.col("n")).cast("bigint").alias("n_words"),
        )
        return cls(terms, materialise(postings.sortWithinPartitions("tid", "ref", "pos")))

    def texts(self) -> DataFrame:
        """(ref, key, n_words) of every indexed row."""
        return self.postings.filter("coalesce(pos, 0) = 0").select("ref", "key", "n_words")

    def _occurrences(self) -> DataFrame:
        return self.postings.filter("tid IS NOT NULL").select("ref", "tid", "pos")

    def _ranked(self, queries: DataFrame) -> DataFrame:
        """(query, n, rank, off, tid) of queries (query, terms) whose terms all occur, rarest term first."""
        frequency = self._occurrences().groupBy("tid").agg(F.count("*").alias("rows"))
        known = self.terms.join(frequency, "tid")
        parts = queries.select("query", F.size("terms").alias("n"), F.posexplode("terms").alias("off", "term"))
        found = parts.join(known, "term").select("query", "n", "off", "tid", "rows")
        per_query = W.partitionBy("query")
        ranked = found.withColumns(
            {
                "all": F.count("*").over(per_query),
                "rank": F.row_number().over(per_query.orderBy("rows", "off")) - 1,
            }
        )
        return materialise(ranked.filter("all = n").select("query", "n", "rank", "off", F.col("tid").cast("int").alias("tid")))

    def phrases(self, queries: DataFrame) -> DataFrame:
        """(query, ref, start, n): every place where the words of a query (query, terms) stand in a row."""
        ranked, occurrences = self._ranked(queries), self._occurrences()
        rarest = ranked.filter("rank = 0").select("query", "n", "off", "tid")
        starts = occurrences.join(rarest, "tid").select("query", "n", "ref", (F.col("pos") - F.col("off")).alias("start"))
        starts = starts.filter("start >= 0")
        place = ["ref", "pos", "tid"]

        def due(places: DataFrame, ranks: str) -> DataFrame:
            """Where the terms of the given ranks have to stand."""
            needed = ranked.filter(ranks).select("query", "off", "tid")
            return places.join(needed, "query").withColumn("pos", F.col("start") + F.col("off")).drop("off")

        second = ranked.filter("rank = 1").select("tid").distinct()
        both = due(starts.filter("n > 1"), "rank = 1").join(occurrences.join(second, "tid", "left_semi"), place)
        both = materialise(both.select("query", "n", "ref", "start"))
        # Few texts hold both, so the long lists of the frequent terms shrink to those first.
        left = materialise(both.filter("n > 2").select("ref").distinct())
        rest = due(both.filter("n > 2"), "rank > 1").join(occurrences.join(left, "ref", "left_semi"), place)
        whole = rest.groupBy("query", "n", "ref", "start").agg(F.count("*").alias("met")).filter("met = n - 2").drop("met")
        return starts.filter("n = 1").unionByName(both.filter("n = 2")).unionByName(whole).select("query", "ref", "start", "n")

    def near(self, queries: DataFrame, span: int) -> DataFrame:
        """(query, ref, start): places of a query's terms from which on all its terms stand within ``span`` words, in any order."""
        distinct = queries.select("query", F.array_distinct("terms").alias("terms"))
        ranked, occurrences = self._ranked(distinct), self._occurrences()
        blocks = occurrences.withColumn("block", F.floor(F.col("pos") / span))
        rarest = ranked.filter("rank = 0").select("query", "n", "tid")
        anchors = occurrences.join(rarest, "tid").select("query", "n", "ref", F.col("pos").alias("at"))
        around = anchors.withColumn("block", F.explode(F.array(*[F.floor(F.col("at") / span) + i for i in (-1, 0, 1)])))
        needed = ranked.select("query", "tid")
        met = around.join(blocks, ["ref", "block"]).join(needed, ["query", "tid"], "left_semi")
        met = met.filter(F.abs(F.col("pos") - F.col("at")) < span)
        # At most two spans of words per anchor.
        seen = met.groupBy("query", "n", "ref", "at").agg(F.collect_list(F.struct("pos", "tid")).alias("seen"))

        def holds_all(start: Column) -> Column:
            inside = F.filter("seen", lambda o: (o["pos"] >= start) & (o["pos"] < start + span))
            return F.size(F.array_distinct(F.transform(inside, lambda o: o["tid"]))) == F.col("n")

        first = F.filter(F.transform("seen", lambda o: o["pos"]), lambda p: (p <= F.col("at")) & holds_all(p))
        return seen.select("query", "ref", F.explode(first).alias("start")).distinct()


def contamination(
    docs: DataFrame,
    items: DataFrame,
    size: int = 10,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(key, n_words, n_hit, items) of every document.

    ``n_hit`` counts words inside occurrences of windows of items, ``items`` are the keys of those
    items as strings, sorted.
    """
    cut = materialise(windows(items, size, item_key, item_text).withColumn("phrase", F.concat_ws(" ", "terms")))
    numbered = materialise(ordered_index(cut.select("phrase").distinct(), "phrase", name="query"))
    queries = numbered.select("query", F.split("phrase", " ").alias("terms"))
    index = PositionalIndex.build(docs, cut.select(F.explode("terms").alias("term")), key, text)
    found = materialise(index.phrases(queries))
    longest = found.groupBy("ref", "start").agg(F.max("n").alias("n"))
    covered = longest.select("ref", F.explode(F.expr("sequence(start, start + n - 1)")).alias("pos")).distinct()
    hit = covered.groupBy("ref").agg(F.count("*").alias("n_hit"))
    holders = cut.select("phrase", "item").distinct().join(numbered, "phrase").select("query", "item")
    named = found.select("ref", "query").distinct().join(holders, "query").select("ref", "item").distinct()
    listed = named.groupBy("ref").agg(F.sort_array(F.collect_list("item")).alias("items"))
    judged = index.texts().join(hit, "ref", "left").join(listed, "ref", "left")
    return judged.select(
        F.col("key").alias(key),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
