"""Evaluation texts leaking into training text: a positional inverted index with phrase and proximity search.

Every training token's posting (token, document, position) is stored, sorted by token within each segment, so that a
look-up reads the row groups of its terms only. The stored index serves any number of searches. A test item is searched
from its rarest terms: their postings, less the term's place in the item, give the places where the item would have to
begin; the postings of the other terms are intersected there, offset by offset, once for each place within the document's
group, and runs of matching offsets are the phrases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import bounded_broadcast, exists, require, written

#: Consecutive words that make a leak.
MIN_WORDS = 12
#: Places this near to each other belong to one proximity match.
SLACK = 3
#: Positions of a document that are verified together.
BLOCK = 512


def words(text: Column) -> Column:
    """The runs of letters and digits of ``text``, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def index(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """The stored postings ``(token, doc_id, position)`` of all documents. Null and empty texts have none.

    ``path``: where the index is kept; one that is there is read, not built again. Searches take what this returns, so
    that many of them share one index.
    """
    spark = documents.sparkSession
    if path and exists(spark, path):
        return spark.read.parquet(path)
    d = require(documents, id_col, text_col).select(F.col(id_col).alias("doc_id"), F.posexplode(words(F.col(text_col))).alias("position", "token"))
    # Segments keep the scan's partitioning: building the index moves no row.
    postings = d.select("token", "doc_id", "position").sortWithinPartitions("token")
    if not path:
        return written(postings, "postings")
    postings.write.parquet(path)
    return spark.read.parquet(path)


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "sms", min_words: int = MIN_WORDS) -> DataFrame:
    """``(item_id, w)``: the words of items long enough to leak."""
    return require(items, id_col, text_col).select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") >= min_words)


def search(postings: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, item_id: str = "item_id", item_text: str = "sms", span: int | None = None) -> DataFrame:
    """``(doc_id, item_id, begin, ats)``: the places in an item of its words that a document holds in place.

    One row for each ``begin``, where the item would have to begin in the document, at which ``span`` consecutive words,
    ``min_words`` by default, can match. ``postings`` is an ``index``. Null and short items match nothing; repeated
    documents count once; extra columns are ignored.
    """
    span = span or min_words
    whole = written(item_words(items, item_id, item_text, min_words), "items")
    terms = whole.select("item_id", F.posexplode("w").alias("at", "token"))
    # Only postings of test terms are read on; how frequent each is decides where the search begins.
    hits = written(postings.join(bounded_broadcast(terms.select("token").distinct()), "token", "left_semi"), "test-postings")
    frequency = hits.groupBy("token").agg(F.count("*").alias("n"))
    ranked = terms.join(frequency, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    window = Window.partitionBy("item_id").orderBy("at").rowsBetween(0, span - 1)
    # The rarest term of every run of span words: whichever run leaked, one of these is in it.
    rarest = F.min(F.struct("n", "at", "token")).over(window)
    size = F.max("at").over(Window.partitionBy("item_id"))
    anchors = ranked.select("item_id", "at", rarest.alias("r"), size.alias("last")).where(F.col("at") + span - 1 <= F.col("last")).where("r.n > 0").select("item_id", F.col("r.at").alias("at"), F.col("r.token").alias("token")).distinct()
    begins = hits.join(bounded_broadcast(written(anchors, "anchors")), "token").select("doc_id", "item_id", (F.col("position") - F.col("at")).alias("begin"))
    # The places of a document's block meet its postings of test terms once; each place is intersected at its offsets there.
    block = lambda position: F.floor(position / BLOCK)
    places = written(begins.groupBy("doc_id", block(F.col("begin")).alias("block")).agg(F.collect_set(F.struct("item_id", "begin")).alias("places")), "places")
    # Frequent terms have postings in every document: only those of documents with a place are moved.
    wanted = hits.join(bounded_broadcast(places.select("doc_id").distinct()), "doc_id", "left_semi")
    # A place reaches as far as its item is long, so a posting also belongs to blocks that end before it.
    reach = whole.agg(F.coalesce(F.max(F.size("w")), F.lit(1))).first()[0]
    blocks = F.explode(F.sequence(block(F.col("position") - (reach - 1)), block(F.col("position")))).alias("block")
    held = wanted.select("doc_id", blocks, "position", "token").groupBy("doc_id", "block").agg(F.array_sort(F.collect_set(F.struct("position", "token"))).alias("held"))
    each = places.join(held, ["doc_id", "block"]).select("doc_id", "held", F.explode("places").alias("p")).select("doc_id", "held", "p.*").join(bounded_broadcast(whole), "item_id")
    at = lambda h: h["position"] - F.col("begin")
    met = F.filter("held", lambda h: (at(h) >= 0) & (at(h) < F.size("w")) & (F.get("w", at(h)) == h["token"]))
    found = each.withColumn("ats", F.transform(met, at)).where(F.size("ats") >= span)
    return found.select("doc_id", "item_id", "begin", "ats")


def longest_run(ats: Column) -> Column:
    """The length of the longest run of consecutive numbers in a sorted array of distinct ones."""
    step = F.aggregate(
        ats,
        F.struct(F.lit(-2).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best")),
        lambda s, x: F.struct(
            x.alias("last"),
            F.when(x == s["last"] + 1, s["run"] + 1).otherwise(1).alias("run"),
            F.greatest(s["best"], F.when(x == s["last"] + 1, s["run"] + 1).otherwise(1)).alias("best"),
        ),
    )
    return step["best"]


def leaks(postings: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, item_id)``: documents of an ``index`` that contain ``min_words`` consecutive words of an item, once each."""
    return search(postings, items, min_words).where(longest_run(F.col("ats")) >= min_words).select("doc_id", "item_id").distinct()


def proximity(postings: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, item_id, matched, longest)``: exact and proximity matches in the documents of an ``index``.

    ``matched`` counts the item's words found in order, where every omission or insertion between them moves the place at
    which the item would begin by ``SLACK`` words at most; at each such place half of ``min_words`` have to run on.
    """
    span = max(2, min_words // 2)
    found = search(postings, items, min_words, span=span).withColumn("longest", longest_run(F.col("ats"))).where(F.col("longest") >= span)
    by = Window.partitionBy("doc_id", "item_id").orderBy("begin")
    near = found.withColumn("new", (F.col("begin") - F.lag("begin").over(by) > SLACK).cast("int")).withColumn("part", F.sum(F.coalesce("new", F.lit(0))).over(by))
    # A word of the item counts once, at whichever of the places it is found.
    told = near.groupBy("doc_id", "item_id", "part").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("matched"), F.max("longest").alias("longest"))
    return told.where(F.col("matched") >= min_words).groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("longest").alias("longest"))
