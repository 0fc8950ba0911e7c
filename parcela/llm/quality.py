"""Quality and toxicity of documents from weak labels.

Heuristic labellers vote bad, good or not at all. Their votes over all documents
are counted by pattern, and expectation-maximisation finds how accurate each
labeller is, without true labels. The posterior of each pattern then labels a
bounded sample on which a hashed linear scorer is trained, and the scorer judges
every document. Quality and toxicity are two such tasks.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import materialize, small_or_stored
from .names import set_apart

# Documents the scorer is fitted on, and labelled rows the toxic lexicon is read
# from: the bounds of what reaches the driver, parameters of ``fit``.
SAMPLE_DOCS = 10_000
LABELLED_DOCS = 20_000
LEXICON_DOCS = 4
STEM = 5
BITS = 18
THRESHOLD = 0.5

_UPPER = bytes(range(65, 91))
# What prose is made of: letters, digits, white space, common marks, non-ASCII.
_PROSE = bytes(range(48, 58)) + _UPPER + bytes(range(97, 123)) + b" \t\n\r.,;:'\"()-?" + bytes(range(128, 256))
_MARKS = b".,;:!?'\"()#*%&$|"

QUALITY_LABELLERS = ("repeats", "symbols", "capitals", "vocabulary", "sentences", "fences")
TOXIC_LABELLERS = ("words", "stems", "annotators")


def _words(text: str | None) -> list[bytes]:
    return [w.strip(_MARKS) for w in text.encode("utf-8", "surrogatepass").lower().split()] if text else []


def shape(text: str | None) -> np.ndarray:
    """Shares that the quality labellers look at, in their order, and the number of words."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    words = data.lower().split()
    n, size = max(len(words), 1), max(len(data), 1)
    return np.array([
        sum(map(operator.eq, words, words[1:])) / n,
        len(data.translate(None, _PROSE)) / size,
        (len(data) - len(data.translate(None, _UPPER))) / size,
        len(set(words)) / min(n, 1000),
        (data.count(b".") + data.count(b"?") + data.count(b"!")) / n,
        (data.count(b"|") + data.count(b"!!") + data.count(b"##") + data.count(b"**")) / n,
        len(words),
    ])


# Per labeller: from where on it votes bad, and up to where good.
_LIMITS = ((0.25, 0.05), (0.06, 0.01), (0.3, 0.1), None, None, (0.25, 0.02))


def quality_votes(s: np.ndarray) -> str:
    """One sign per labeller: b(ad), g(ood) or - (no vote)."""
    if s[6] == 0:
        return "b" * len(QUALITY_LABELLERS)
    out = ["-" if t is None else "b" if v >= t[0] else "g" if v <= t[1] else "-" for v, t in zip(s, _LIMITS)]
    if s[6] >= 20:
        out[3] = "b" if s[3] < 0.1 else "g" if s[3] > 0.15 else "-"
        out[4] = "b" if s[4] < 0.004 or s[4] > 0.8 else "g" if 0.02 < s[4] < 0.4 else "-"
    return "".join(out)


def toxic_lexicon(labelled: DataFrame, text: str = "text") -> tuple[frozenset[bytes], frozenset[bytes]]:
    """Words and stems of which nine in ten documents are toxic, from
    ``labelled`` rows, a bounded sample."""
    rows = labelled.filter("toxic IS NOT NULL")

    def terms(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for t, toxic in zip(part["text"], part["toxic"]):
                own = {w for w in _words(t) if w}
                # Columns of an empty frame are floats, which Spark does not take for texts.
                if not own:
                    continue
                stems = {w[:STEM] for w in own if len(w) > STEM}
                yield pd.DataFrame({
                    "term": [w.decode("utf-8", "replace") for x in (own, stems) for w in x],
                    "kind": ["w"] * len(own) + ["s"] * len(stems), "toxic": int(toxic),
                })

    counts = rows.select(F.col(text).alias("text"), "toxic").mapInPandas(terms, "term string, kind string, toxic int").groupBy(
        "kind", "term").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    telling = counts.filter((F.col("bad") >= LEXICON_DOCS) & (F.col("bad") >= 0.9 * F.col("n")))
    # Bounded by the words of the sample.
    found = telling.select("term", "kind").collect()
    return (frozenset(r.term.encode() for r in found if r.kind == "w"), frozenset(r.term.encode() for r in found if r.kind == "s"))


def toxic_votes(text: str | None, lexicon: tuple[frozenset[bytes], frozenset[bytes]]) -> str:
    """Votes of the two lexicon labellers; the annotators' one follows them."""
    own = set(_words(text))
    by_word = "b" if not lexicon[0].isdisjoint(own) else "g"
    by_stem = "b" if not lexicon[1].isdisjoint({w[:STEM] for w in own if len(w) > STEM}) else "g"
    return by_word + by_stem


def _vote(lexicon, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        yield part.drop(columns="text").assign(
            quality=[quality_votes(shape(t)) for t in part["text"]], toxic=[toxic_votes(t, lexicon) for t in part["text"]])


def label_model(patterns: dict[str, int], rounds: int = 100) -> tuple[dict[str, float], np.ndarray]:
    """Posterior of "bad" for each vote pattern, and per labeller the chance of
    its bad vote on bad and on good documents, by expectation-maximisation."""
    names = sorted(patterns)
    if not names:
        return {}, np.empty((0, 2))
    count = np.array([patterns[p] for p in names], float)
    bad = np.array([[c == "b" for c in p] for p in names], float)
    good = np.array([[c == "g" for c in p] for p in names], float)
    # Start: a document is as bad as its worst vote; labellers look for different faults.
    post = np.where(bad.sum(1) > 0, 0.9, 0.05)
    rate = np.empty((bad.shape[1], 2))
    for _ in range(rounds):
        for k, weight in enumerate((post * count, (1 - post) * count)):
            rate[:, k] = (weight @ bad + (0.9, 0.1)[k]) / (weight @ (bad + good) + 1.0)
        rate = np.clip(rate, 1e-4, 1 - 1e-4)
        prior = np.clip((post @ count + 1) / (count.sum() + 20), 1e-4, 0.5)
        log = bad @ np.log(rate[:, 0] / rate[:, 1]) + good @ np.log((1 - rate[:, 0]) / (1 - rate[:, 1])) + np.log(prior / (1 - prior))
        post = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
    return dict(zip(names, post.tolist())), rate


class _Features(dict):
    """Word -> hashed ids of the word and its stem, cached."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) > 300_000:
            self.clear()
        mask = (1 << BITS) - 1
        value = self[word] = (xxhash.xxh32_intdigest(word) & mask, xxhash.xxh32_intdigest(b"s:" + word[:STEM]) & mask)
        return value


def features(text: str | None, cache: dict) -> np.ndarray:
    """Hashed features of a whole text: different words, their stems, and the
    shape in eighths of powers of two, each repeated to weigh more."""
    ids = [i for w in set(_words(text)) for i in cache[w]]
    s = shape(text)
    steps = np.floor(np.log2(s + 1 / 1024) * 2).astype(int)
    for name, step in zip(QUALITY_LABELLERS + ("length",), steps.tolist()):
        ids += [xxhash.xxh32_intdigest(f"f:{name}:{step}".encode()) & ((1 << BITS) - 1)] * 3
    return np.array(ids, np.int32)


def _featured(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cache = _Features()
    for part in parts:
        yield part.drop(columns="text").assign(ids=[features(t, cache) for t in part["text"]])


def train(rows: list[np.ndarray], target: np.ndarray, epochs: int = 4, alpha: float = 0.1, l1: float = 1.0) -> np.ndarray:
    """Logistic regression on soft labels by FTRL-proximal steps; the last weight
    is the intercept."""
    size = (1 << BITS) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    order = np.random.default_rng(1)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            ids, times = np.unique(np.append(rows[i], size - 1), return_counts=True)
            zi, ni = z[ids], n[ids]
            weight = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((1.0 + np.sqrt(ni)) / alpha + 0.1))
            p = 1 / (1 + np.exp(-np.clip(weight @ times, -30, 30)))
            g = (p - target[i]) * times
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[ids] += g - sigma * weight
            n[ids] += g * g
    strong = np.abs(z) > l1
    w[strong] = -(z[strong] - np.sign(z[strong]) * l1) / ((1.0 + np.sqrt(n[strong])) / alpha + 0.1)
    return w


def fit(docs: DataFrame, labels: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text",
        sample_docs: int = SAMPLE_DOCS, labelled_docs: int = LABELLED_DOCS) -> np.ndarray:
    """Weights of the two scorers (features x 2), trained on ``sample_docs`` rows.
    Votes of all of ``docs`` are counted; ``labels`` (doc_id, toxic) gives the
    annotators' votes and, by ``labelled_docs`` of its rows, the lexicon."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if labels is None:
        labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marks = materialize(marks, "marks")
    sampled = small_or_stored(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_docs))
    lexicon = toxic_lexicon(rows.join(sampled, "doc_id"))

    # A row is known by a hash; the sample is the least of them.
    rows = rows.withColumn("_pick", F.xxhash64("doc_id", "text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    votes = rows.mapInPandas(partial(_vote, lexicon), f"doc_id {kind}, _pick bigint, quality string, toxic string")
    # The annotators' votes join the narrow votes, so texts stay where they are.
    mark = F.when(F.col("mark").isNull(), "-").when(F.col("mark") > 0, "b").otherwise("g")
    votes = materialize(votes, "votes").join(marks.withColumnRenamed("toxic", "mark"), "doc_id", "left")
    votes = materialize(votes.select("_pick", "quality", F.concat("toxic", mark).alias("toxic")), "votes")
    # At most 3 ** labellers patterns.
    models = [label_model({r.p: r.n for r in votes.groupBy(F.col(task).alias("p")).agg(F.count("*").alias("n")).collect()})[0]
              for task in ("quality", "toxic")]
    cut = votes.select("_pick").distinct().orderBy("_pick").limit(sample_docs).agg(F.max("_pick")).first()[0]
    if cut is None:
        return np.zeros(((1 << BITS) + 1, 2))
    picked = votes.filter(F.col("_pick") <= cut).groupBy("_pick").agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"))
    # Repeated rows share a hash; each text trains once.
    chosen = rows.filter(F.col("_pick") <= cut).select("text", "_pick").mapInPandas(_featured, "_pick bigint, ids array<int>")
    sample = chosen.dropDuplicates(["_pick"]).join(picked, "_pick").orderBy("_pick").select("quality", "toxic", "ids").toArrow()
    held = sample["ids"].combine_chunks()
    bounds = held.offsets.to_numpy()
    ids = np.split(held.values.to_numpy(), bounds[1:-1])
    columns = [np.array([m.get(p, 0.0) for p in sample[task].to_pylist()]) for m, task in zip(models, ("quality", "toxic"))]
    return np.stack([train(ids, c) for c in columns], axis=1)


def _score(weights, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    w, cache = weights.value, _Features()
    for part in parts:
        logit = np.array([w[features(t, cache)].sum(axis=0) + w[-1] for t in part["text"]]).reshape(-1, 2)
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        yield part.drop(columns="text").assign(bad_score=p[:, 0], toxic_score=p[:, 1])


def score(docs: DataFrame, weights: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, text hash ``_th``, ``bad_score``, ``toxic_score`` and
    ``kept``. A null or empty text is bad and not kept."""
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    rows = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_th"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    scored = rows.mapInPandas(partial(_score, sent), f"_id {kind}, _th bigint, bad_score double, toxic_score double")
    empty = F.col("_th") == F.xxhash64(F.lit("")), F.col("_th") == F.xxhash64(F.lit(None).cast("string"))
    bad = F.when(empty[0] | empty[1], F.lit(1.0)).otherwise(F.col("bad_score"))
    return scored.select(F.col("_id").alias(doc_id), "_th", bad.alias("bad_score"), "toxic_score",
                         ((bad < THRESHOLD) & (F.col("toxic_score") < THRESHOLD)).alias("kept"))


def classify(docs: DataFrame, labels: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text",
             **bounds) -> DataFrame:
    """Fit on ``docs`` and score every row of it. Rows with a null id are scored
    like others; repeated rows get equal scores; an empty table gives no rows."""
    return score(docs, fit(docs, labels, doc_id, text, **bounds), doc_id, text)


def keep_good(docs: DataFrame, labels: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are neither bad nor toxic."""
    found = materialize(classify(docs, labels, doc_id, text), "judged")
    gone = found.filter("NOT kept").select(F.col(doc_id).alias("_i"), F.col("_th").alias("_t")).distinct()
    gone = materialize(gone, "rejected").hint("merge")
    docs, named = set_apart(docs, ["_i", "_t"], [doc_id, text])
    return named(docs.join(gone, F.col(doc_id).eqNullSafe(F.col("_i")) & (F.xxhash64(text) == F.col("_t")), "left_anti"))
