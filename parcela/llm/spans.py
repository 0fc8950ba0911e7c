"""Removal of passages that repeat across or within documents.

A run starts at every sentence: ``SPAN`` sentences if they have ``MIN_WORDS``
words, else as many of the next ones as it takes to reach ``LONG_WORDS``. A
sentence of ``LONG_WORDS`` is a run of its own as well. Every run is hashed. Of
each run that occurs more than once, the first occurrence (least document, then
position) stays; sentences covered by any other occurrence are removed. A long
passage is a chain of overlapping runs, so its whole sentences go, but for fewer
than ``LONG_WORDS`` words of short sentences at its end, whose runs reach beyond
it. What a passage holds of a sentence that is not repeated whole stays.
"""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .linededup import kept_runs
from .names import set_apart

# Sentences per run and the words these need to tell a passage from chance; runs
# of fewer or more sentences need the larger number of words.
SPAN = 2
MIN_WORDS = 8
LONG_WORDS = 20

_BREAK = "\u0001"


def sentences(text: Column) -> Column:
    """Pieces ending in . ! ? before white space, or at a line break."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])[ \t]+", f"$1{_BREAK}")
    parts = F.split(marked, rf"[\n\r{_BREAK}]+")
    return F.filter(F.transform(parts, lambda s: F.btrim(s, F.lit(" \t"))), lambda s: s != "")


def _normal(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[ \t]+", " ")


def _runs(docs: DataFrame, span: int, min_words: int, long_words: int) -> DataFrame:
    """Runs: row key, position, number of sentences and a 128-bit hash."""
    cut = docs.select("_id", "_th", sentences(_normal(F.col("_text"))).alias("s")).filter("size(s) > 0")
    # Words are counted by their gaps.
    cut = cut.withColumn("w", F.transform("s", lambda x: F.length(x) - F.length(F.translate(x, " ", "")) + 1))
    every = F.sequence(F.lit(0), F.size("s") - 1)

    def grown(at: Column) -> Column:
        # A sentence has a word at least, so no run needs more sentences than words.
        ahead = F.slice("w", at + 1, F.lit(max(span, long_words)))
        longer = lambda run, x: F.struct((run["n"] + 1).alias("n"), (run["words"] + x).alias("words"))
        run = F.aggregate(ahead, F.struct(F.lit(0).alias("n"), F.lit(0).alias("words")), lambda run, x: F.when(
            (run["n"] > span) & (run["words"] >= long_words), run).otherwise(longer(run, x)))
        return F.when((run["n"] > span) & (run["words"] >= long_words), run["n"])

    # A shorter document has one run.
    first = F.least(F.lit(span), F.size("s"))
    words = lambda at: F.aggregate(F.slice("w", at + 1, first), F.lit(0), operator.add)
    whole = lambda at: (words(at) >= min_words) & (at + first <= F.size("s"))
    several = F.transform(every, lambda at: F.struct(at.alias("at"), F.when(whole(at), first).otherwise(grown(at)).alias("n")))
    lone = F.transform(F.filter(every, lambda at: F.get("w", at) >= long_words), lambda at: F.struct(at.alias("at"), F.lit(1).alias("n")))
    texts = F.transform(F.concat(F.filter(several, lambda run: run["n"].isNotNull()), lone), lambda run: F.struct(
        run["at"].alias("at"), run["n"].alias("n"), F.array_join(F.slice("s", run["at"] + 1, run["n"]), _BREAK).alias("run")))
    return cut.select("_id", "_th", F.explode(texts).alias("r")).select(
        "_id", "_th", "r.at", "r.n", F.xxhash64("r.run").alias("h1"), F.xxhash64(F.lit(1), "r.run").alias("h2")
    )


def repeated_sentences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN,
                       min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """Positions of sentences under a non-first run: ``_id``, ``_th``, ``at``."""
    keyed = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_th"), F.col(text).alias("_text"))
    runs = materialize(_runs(keyed, span, min_words, long_words), "runs")
    place = F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_th", "at")
    firsts = runs.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("times"))
    firsts = materialize(firsts.filter("times > 1").drop("times"), "firsts")
    # Stored sides let a run that thousands of documents share be split. The join
    # is the same at every size.
    later = runs.join(firsts.hint("merge"), ["h1", "h2"]).filter(place != F.col("first"))
    covered = later.select("_id", "_th", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("at"))
    return covered.distinct()


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN,
                   min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """``docs`` with ``text`` rid of repeated passages, plus ``n_sentences`` and
    ``n_removed``. Documents that lose nothing keep their text as it is; of
    others the remaining sentences are joined by line breaks. A document shorter
    than ``span`` sentences is one run, if it has ``min_words`` words.

    Repeated rows of one id and text cannot be told apart and lose the same
    sentences, none for each other. A null text stays null and has no sentences;
    rows without id come after all others. Clashing column names are replaced.
    """
    drop = materialize(repeated_sentences(docs, doc_id, text, span, min_words, long_words), "repeats")
    # One document's positions: as many as it has sentences.
    per_doc = materialize(drop.groupBy(F.col("_id").alias("_i"), F.col("_th").alias("_t")).agg(F.collect_set("at").alias("_drop")), "drop").hint("merge")
    docs, named = set_apart(docs.drop("n_sentences", "n_removed"), ["_i", "_t", "_drop", "_s"], [doc_id, text])
    joined = docs.join(per_doc, F.col(doc_id).eqNullSafe(F.col("_i")) & (F.xxhash64(text) == F.col("_t")), "left")
    cut = joined.withColumn("_s", sentences(F.col(text)))
    # Slices between the dropped positions: one step per run, not per pair.
    kept = F.flatten(F.transform(kept_runs(F.array_sort("_drop"), F.size("_s")), lambda r: F.slice("_s", r["start"] + 1, r["length"])))
    removed = F.when(F.col("_drop").isNull(), F.lit(0)).otherwise(F.size("_s") - F.size(kept)).cast("bigint")
    return cut.withColumns({
        "n_sentences": F.size("_s").cast("bigint"), "n_removed": removed,
        text: F.when(F.col("_drop").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")),
    }).transform(lambda done: named(done.select(*docs.columns, "n_sentences", "n_removed")))


SPANS_SQL = f"""
WITH p AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(
    regexp_replace(coalesce(text, ''), '([.!?])[ \\t]+', '\\1' || chr(1), 'g'), '[\\n\\r\\x01]+'),
    lambda s: regexp_replace(s, '^[ \\t]+|[ \\t]+$', '', 'g')), lambda s: s <> '') AS s FROM documents),
q AS (SELECT doc_id, list_transform(s, lambda x: regexp_replace(lower(x), '[ \\t]+', ' ', 'g')) AS s FROM p WHERE len(s) > 0),
v AS (SELECT doc_id, s, list_transform(s, lambda x: length(x) - length(translate(x, ' ', '')) + 1) AS w FROM q),
a AS (SELECT doc_id, s, w, unnest(range(0, len(s))) AS pos FROM v),
n AS (SELECT doc_id, s, pos, list_filter(range(least({SPAN}, len(s)), {max(SPAN, LONG_WORDS)} + 1),
    lambda k: pos + k <= len(s) AND list_sum(w[pos + 1:pos + k]) >= CASE WHEN k <= {SPAN} THEN {MIN_WORDS} ELSE {LONG_WORDS} END)[1] AS n FROM a
  UNION ALL SELECT doc_id, s, pos, 1 FROM a WHERE w[pos + 1] >= {LONG_WORDS}),
r AS (SELECT DISTINCT doc_id, pos, n, array_to_string(s[pos + 1:pos + n], chr(1)) AS run FROM n WHERE n IS NOT NULL),
l AS (SELECT doc_id, pos, n FROM r QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) > 1),
c AS (SELECT doc_id, list(DISTINCT a) AS gone FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS a FROM l) GROUP BY doc_id)
SELECT p.doc_id, len(s)::BIGINT AS n_sentences,
  CASE WHEN gone IS NULL THEN 0 ELSE len(list_filter(s, lambda x, i: list_contains(gone, i - 1))) END::BIGINT AS n_removed,
  CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(s, lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END AS text
FROM p LEFT JOIN c ON c.doc_id = p.doc_id"""
