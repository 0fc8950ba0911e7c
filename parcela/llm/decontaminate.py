"""Benchmark passages in training documents, found with a positional index.

Test items are cut into windows of consecutive words. The corpus frequency of
every test word is counted; windows with a word the corpus lacks are dropped.
The rarest words of the other windows get posting lists (word, document,
position). A list entry minus the word's offset in the window is a possible
start; a start named by all of the window's lists is a candidate, whose words
are then read in the document itself: all in place is an exact match, most of
them within the slop a proximity match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize, small_or_stored
from .names import set_apart

# Fixed value: a word is a run of digits, lower-case letters and non-ASCII characters,
# after A-Z became a-z; the pattern finds what separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

WINDOW = 10
# Posting lists intersected per window.
LISTS = 2
# A proximity match has at least this share of the window's different words.
NEAR_SHARE = 0.8


def words_of(text: Column) -> Column:
    """Words of a text; a null text has none."""
    # lower() is fast and touches only A-Z when all characters are ASCII.
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    parts = F.split(F.coalesce(lowered, F.lit("")), SEPARATORS)
    # Only the first and the last part can be empty.
    return F.filter(parts, lambda w: w != "")


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Different windows (``window_id``, ``terms``) and the items that hold them."""
    words = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    cut = words.select("item", F.explode(starts).alias("at"), "w").select(
        "item", F.slice("w", F.col("at"), F.lit(window)).alias("terms")
    )
    return cut.select(F.xxhash64(F.concat_ws(" ", "terms")).alias("window_id"), "terms", "item").distinct()


def _rarest(cut: DataFrame, frequency: DataFrame, lists: int) -> DataFrame:
    """Per window whose words all occur: the offsets of its rarest words."""
    terms = cut.select("window_id", F.posexplode("terms").alias("offset", "term"))
    known = terms.join(frequency, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rank = Window.partitionBy("window_id").orderBy("n", "term", "offset")
    ranked = known.withColumn("least", F.min("n").over(Window.partitionBy("window_id"))).withColumn("nth", F.row_number().over(rank))
    used = ranked.filter((F.col("least") > 0) & (F.col("nth") <= lists))
    return used.withColumn("lists", F.count("*").over(Window.partitionBy("window_id"))).select("window_id", "offset", "term", "lists")


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """A row is known by its id and a hash of its text, as ids may repeat."""
    return docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_th"), F.col(text).alias("_text"))


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["_id"].eqNullSafe(b["_id"]) & (a["_th"] == b["_th"])


def find_windows(docs: DataFrame, cut: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 slop: int = 0, lists: int = LISTS) -> DataFrame:
    """Matches of windows in documents: ``_id``, ``_th``, ``window_id``,
    ``start`` (0-based word), ``length`` and ``match`` (exact or near; near ones
    only with ``slop`` > 0, ``start`` being that of the phrase in place)."""
    docs = _keyed(docs, doc_id, text)
    cut = materialize(cut.select("window_id", "terms").distinct(), "windows")
    vocabulary = small_or_stored(cut.select(F.explode("terms").alias("term")).distinct())
    frequency = (
        docs.select(F.explode(words_of(F.col("_text"))).alias("term"))
        .join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    )
    anchors = small_or_stored(materialize(_rarest(cut, materialize(frequency, "frequency"), lists), "anchors"))
    anchor_terms = small_or_stored(anchors.select("term").distinct())
    postings = materialize(
        docs.select("_id", "_th", F.posexplode(words_of(F.col("_text"))).alias("pos", "term"))
        .join(anchor_terms, "term", "left_semi").select("term", "_id", "_th", "pos"),
        "postings",
    )
    # Offset-adjusted lists: each entry votes for the start it implies.
    starts = postings.join(anchors, "term").select(
        "_id", "_th", "window_id", "lists", "offset", (F.col("pos") - F.col("offset")).alias("start")
    )
    if slop:
        starts = starts.withColumn("start", F.explode(F.sequence(F.col("start") - slop, F.col("start") + slop)))
    agreed = (
        starts.groupBy("_id", "_th", "window_id", "start")
        .agg(F.count_distinct("offset").alias("votes"), F.max("lists").alias("lists"))
        .filter((F.col("votes") == F.col("lists")) & (F.col("start") >= -slop))
        .select("_id", "_th", "window_id", "start")
    )
    candidates = materialize(agreed, "candidates")
    wanted = small_or_stored(candidates.select("_id", "_th").distinct())
    # One row per text: repeated rows would repeat its matches.
    texts = docs.join(wanted, _same_row(docs, wanted), "left_semi").groupBy("_id", "_th").agg(F.first("_text").alias("_text"))
    texts = texts.select(F.col("_id").alias("_i"), F.col("_th").alias("_t"), words_of(F.col("_text")).alias("_words"))
    # Candidates of a document come together before its words are looked at,
    # so the words are not copied for each of them.
    sites = candidates.join(small_or_stored(cut), "window_id").groupBy("_id", "_th").agg(
        F.collect_list(F.struct("window_id", "terms", "start")).alias("_sites")
    )
    placed = sites.join(texts, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_t")))

    def judged(site: Column) -> Column:
        terms, start = site["terms"], site["start"]
        there = F.when(start >= 0, F.slice("_words", F.greatest(start, F.lit(0)) + 1, F.size(terms)))
        match = F.when(there == terms, F.lit("exact"))
        if slop:
            first = F.greatest(start - slop, F.lit(0))
            around = F.slice("_words", first + 1, start + F.size(terms) + slop - first)
            shared = F.size(F.array_intersect(terms, around))
            enough = shared >= NEAR_SHARE * F.size(F.array_distinct(terms))
            match = F.coalesce(match, F.when(enough, F.lit("near")))
        return F.struct(site["window_id"].alias("window_id"), start.alias("start"),
                        F.size(terms).alias("length"), match.alias("match"))

    return placed.select("_id", "_th", F.explode(F.transform("_sites", judged)).alias("m")).select("_id", "_th", "m.*").filter(
        "match IS NOT NULL"
    )


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  slop: int = 0) -> DataFrame:
    """Per row of ``docs``: its id, ``n_words``, ``n_hit`` (words inside any
    exact occurrence; with ``slop`` also those inside the span of near ones),
    ``n_items``, ``items_sha256`` and ``contaminated``.

    Null and empty texts have no words; items without words match nothing. Items
    of one id count once; an item whose id is null marks words but is not
    counted. Repeated document rows are judged alike. Empty tables give no rows,
    or rows without hits.
    """
    cut = materialize(windows(items, item_id, item_text, window), "cut")
    matches = materialize(find_windows(docs, cut, doc_id, text, slop), "matches")
    counted = docs.select(
        F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_th"), F.size(words_of(F.col(text))).cast("bigint").alias("n_words")
    )
    spans = matches.select("_id", "_th", F.greatest("start", F.lit(0)).alias("first"),
                           F.explode(F.sequence(F.greatest("start", F.lit(0)), F.col("start") + F.col("length") - 1)).alias("pos"))
    hit = spans.groupBy("_id", "_th").agg(F.count_distinct("pos").cast("bigint").alias("n_hit"))
    owners = small_or_stored(cut.filter("item IS NOT NULL").select("window_id", "item"))
    found = matches.select("_id", "_th", "window_id").distinct().join(owners, "window_id").select("_id", "_th", "item").distinct()
    named = found.groupBy("_id", "_th").agg(F.array_sort(F.collect_list("item")).alias("_items"))
    marks = hit.join(named.withColumnsRenamed({"_id": "_i", "_th": "_t"}),
                     F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_t")), "left").drop("_i", "_t")
    marks = small_or_stored(materialize(marks, "marks").withColumnsRenamed({"_id": "_i", "_th": "_t"}))
    joined = counted.join(marks, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_t")), "left")
    held = F.coalesce("_items", F.array().cast("array<string>"))
    return joined.select(
        F.col("_id").alias(doc_id), "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(held).cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", held), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "_th",
    )


def clean_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the contaminated rows."""
    found = contamination(docs, items, doc_id, text, **options).filter("contaminated")
    docs, named = set_apart(docs, ["_i", "_t"], [doc_id, text])
    bad = small_or_stored(found.select(F.col(doc_id).alias("_i"), F.col("_th").alias("_t")).distinct())
    return named(docs.join(bad, F.col(doc_id).eqNullSafe(F.col("_i")) & (F.xxhash64(text) == F.col("_t")), "left_anti"))


_SQL_WORDS = ("regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
              r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
DECONTAMINATE_SQL = f"""
WITH i AS (SELECT item_id, {_SQL_WORDS.format('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[s:s + least(len(w), {WINDOW}) - 1], ' ') AS t, least(len(w), {WINDOW}) AS m
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce({_SQL_WORDS.format('text')}, []) AS w FROM documents),
g AS (SELECT doc_id, s, m, array_to_string(w[s:s + m - 1], ' ') AS t
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
hits AS (SELECT g.doc_id, g.s, g.m, win.item_id FROM g JOIN win ON g.t = win.t AND g.m = win.m),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id"""
