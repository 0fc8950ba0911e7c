"""Language of documents with a linear-chain conditional random field.

Every word gets one label per language from its character n-grams (those at a
word's edges are its affixes) and from a lexicon of frequent training words; a
learned table scores transitions between the labels of neighbouring words.
Forward-backward gives each word's chance of each language in its context, so
code-switched text is labelled word by word. A document's language is the one
its words expect most.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Documents per language that the model is fitted on, chosen by hash.
SAMPLE_PER_LANGUAGE = 150
# Words per training chain; chains of two languages teach the transitions.
CHAIN = 40
BITS = 17
GRAMS = (1, 2, 3, 4)
LEXICON_COUNT = 3
BATCH_WORDS = 200_000
# Parts of a language whose least hashes are found before those of the language.
SALTS = 64

UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in small letters."""
    return _WORD.findall(text.lower()) if text else []


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram ids of all words and the start of each word's ids."""
    # A word is at least as long as the longest gram, its edges included.
    raw = [b"^" + w.encode("utf-8", "surrogatepass") + b"$\0\0" for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    sizes = np.array([len(r) for r in raw])
    ends = np.cumsum(sizes)
    pad = np.concatenate([data, np.zeros(max(GRAMS), np.uint64)])
    ids = np.empty((len(data), len(GRAMS)), np.int64)
    value = np.zeros(len(data), np.uint64)
    for k, n in enumerate(GRAMS):
        value = value * np.uint64(257) + pad[n - 1:n - 1 + len(data)] + np.uint64(1)
        mixed = (value ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        ids[:, k] = (mixed >> np.uint64(64 - BITS)).astype(np.int64)
    return ids.reshape(-1), (ends - sizes) * len(GRAMS)


class Model:
    """Languages, n-gram weights, lexicon and transitions."""

    def __init__(self, languages: list[str]):
        k = len(languages)
        self.languages = languages
        self.grams = np.zeros((1 << BITS, k), np.float32)
        self.lexicon: dict[str, int] = {}
        self.words = np.zeros((1, k), np.float32)
        self.moves = np.zeros((k, k))

    def emissions(self, words: list[str]) -> np.ndarray:
        """Score of each language for each (different) word."""
        if not words:
            return np.zeros((0, len(self.languages)))
        ids, starts = _grams(words)
        known = np.array([self.lexicon.get(w, 0) for w in words])
        return np.add.reduceat(self.grams[ids], starts, axis=0).astype(float) + self.words[known]


def forward_backward(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chances per chain, word and label, and expected transitions, for chains
    (chain x word x label) of descending length."""
    chains, longest, k = scores.shape
    step = np.exp(moves - moves.max())
    emit = np.exp(scores - scores.max(axis=2, keepdims=True))
    ahead, back = np.empty_like(emit), np.ones_like(emit)
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # chains longer than t
    a = emit[:, 0] / emit[:, 0].sum(1, keepdims=True)
    ahead[:, 0] = a
    for t in range(1, longest):
        n = active[t]
        a = (a[:n] @ step) * emit[:n, t]
        a /= a.sum(1, keepdims=True)
        ahead[:n, t] = a
    b = np.ones((0, k))
    used = np.zeros((k, k))
    for t in range(longest - 2, -1, -1):
        n = active[t + 1]
        b = np.concatenate([b, np.ones((n - len(b), k))])
        right = b * emit[:n, t + 1]
        both = ahead[:n, t, :, None] * step * right[:, None, :]
        used += (both / both.sum((1, 2), keepdims=True)).sum(0)
        b = right @ step.T
        b /= b.sum(1, keepdims=True)
        back[:n, t] = b
    chance = ahead * back
    inside = np.arange(longest) < lengths[:, None]
    chance = np.where(inside[:, :, None], chance, 0)
    total = chance.sum(2, keepdims=True)
    return np.divide(chance, total, out=np.zeros_like(chance), where=total > 0), used


def train(rows: list[tuple[str, str]], epochs: int = 3, rate: float = 0.3, seed: int = 3) -> Model:
    """Fit on (text, language). Each chain holds pieces of one or two documents;
    weights follow the gradient of the chain likelihood with adaptive steps."""
    model = Model(sorted({lang for _, lang in rows}))
    k, rng = len(model.languages), np.random.default_rng(seed)
    place = {lang: i for i, lang in enumerate(model.languages)}
    pieces: list[tuple[list[str], int]] = []
    for text, lang in rows:
        found = words_of(text)
        pieces += [(found[i:i + CHAIN], place[lang]) for i in range(0, len(found), CHAIN)]
    if not pieces:
        return model
    counts: dict[str, int] = {}
    for found, _ in pieces:
        for w in found:
            counts[w] = counts.get(w, 0) + 1
    frequent = sorted(w for w, n in counts.items() if n >= LEXICON_COUNT)
    model.lexicon = {w: i + 1 for i, w in enumerate(frequent)}
    model.words = np.zeros((len(frequent) + 1, k), np.float32)
    squares = [np.full(x.shape, 1e-6) for x in (model.grams, model.words, model.moves)]
    for _ in range(epochs):
        order = rng.permutation(len(pieces))
        for start in range(0, len(order), 64):
            chains = []
            chosen = [pieces[i] for i in order[start:start + 64]]
            for (a, x), (b, y) in zip(chosen, chosen[::-1]):
                # Every other chain switches language half way.
                cut = len(a) // 2 if len(chains) % 2 else len(a)
                words = a[:cut] + b[cut:CHAIN] if cut < len(a) else a
                chains.append((words, [x] * min(cut, len(words)) + [y] * (len(words) - min(cut, len(words)))))
            chains.sort(key=lambda c: -len(c[0]))
            lengths = np.array([len(c[0]) for c in chains])
            every = list(dict.fromkeys(w for c in chains for w in c[0]))
            at = {w: i for i, w in enumerate(every)}
            table = model.emissions(every)
            scores = np.zeros((len(chains), lengths[0], k))
            truth = np.zeros_like(scores)
            index = np.zeros(scores.shape[:2], int)
            turns = np.zeros((k, k))
            for c, (words, langs) in enumerate(chains):
                index[c, :len(words)] = [at[w] for w in words]
                scores[c, :len(words)] = table[index[c, :len(words)]]
                truth[c, np.arange(len(words)), langs] = 1
                np.add.at(turns, (langs[:-1], langs[1:]), 1)
            chance, used = forward_backward(scores, lengths, model.moves)
            inside = np.arange(lengths[0]) < lengths[:, None]
            wanted = np.zeros_like(table)
            np.add.at(wanted, index[inside], (truth - chance)[inside])
            ids, starts = _grams(every)
            owner = np.repeat(np.arange(len(every)), np.diff(np.append(starts, len(ids))))
            for target, rows_, value, square in (
                (model.grams, ids, wanted[owner], squares[0]),
                (model.words, np.array([model.lexicon.get(w, 0) for w in every]), wanted, squares[1]),
            ):
                own, back = np.unique(rows_, return_inverse=True)
                g = np.zeros((len(own), k))
                np.add.at(g, back, value)
                square[own] += g * g
                target[own] += (rate * 0.1 if target is model.grams else rate) * g / np.sqrt(square[own])
            g = turns - used
            squares[2] += g * g
            model.moves += rate * g / np.sqrt(squares[2])
    model.words[0] = 0
    return model


def label_words(model: Model, texts: list[list[str]]) -> list[np.ndarray]:
    """Chances (word x language) for each list of words; long and short texts
    are taken together, sorted by length."""
    out: list[np.ndarray] = [np.zeros((0, len(model.languages)))] * len(texts)
    if not model.languages:
        return out
    order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: -len(texts[i]))
    at: dict[str, int] = {}
    ids = {i: np.array([at.setdefault(w, len(at)) for w in texts[i]]) for i in order}
    table = model.emissions(list(at))
    start = 0
    while start < len(order):
        # A batch's array is as wide as its longest text.
        stop = start + max(1, BATCH_WORDS // len(texts[order[start]]))
        batch = order[start:stop]
        lengths = np.array([len(texts[i]) for i in batch])
        scores = np.zeros((len(batch), lengths[0], len(model.languages)))
        for row, i in enumerate(batch):
            scores[row, :len(ids[i])] = table[ids[i]]
        chance, _ = forward_backward(scores, lengths, model.moves)
        for row, i in enumerate(batch):
            out[i] = chance[row, :lengths[row]]
        start = stop
    return out


def _predict(sent, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    model = sent.value
    for part in parts:
        langs: list[str] = []
        sure: list[float] = []
        held: list[list[str]] = []
        size = 0

        def flush() -> None:
            for chance in label_words(model, held):
                if not len(chance) or not model.languages:
                    langs.append(UNKNOWN)
                    sure.append(0.0)
                    continue
                mean = chance.mean(axis=0)
                best = int(mean.argmax())
                langs.append(model.languages[best])
                sure.append(float(min(mean[best], 1.0)))

        # The words of about a batch are held at a time.
        for text in part["text"]:
            held.append(words_of(text))
            size += len(held[-1])
            if size >= BATCH_WORDS:
                flush()
                held, size = [], 0
        flush()
        yield part.drop(columns="text").assign(lang_pred=langs, score=sure)


def held_out(doc_id: Column) -> Column:
    """Rows kept from training; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """A model from at most ``per_language`` labelled rows of each language, the
    least by hash. Whole texts are used."""
    from pyspark.sql import Window

    rows = docs.filter(~held_out(F.col(doc_id)) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    keyed = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(doc_id, text).alias("_h"))
    # Only hashes are ranked, first within parts of a language, so that the task
    # of a hot language sees a number of rows that does not grow with the table.
    chosen = keyed.select("lang", "_h").distinct()
    for parts in (["lang", F.pmod("_h", F.lit(SALTS))], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*parts).orderBy("_h"))
        chosen = chosen.withColumn("_n", rank).filter(F.col("_n") <= per_language).select("lang", "_h")
    chosen = chosen.select(F.col("lang").alias("_l"), F.col("_h").alias("_c"))
    found = keyed.join(F.broadcast(chosen), (F.col("lang") == F.col("_l")) & (F.col("_h") == F.col("_c"))).groupBy("lang", "_h").agg(
        F.first("text").alias("text")).orderBy("lang", "_h").collect()
    return train([(r.text, r.lang) for r in found])


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row its id, ``held_out``, ``lang_pred`` and ``score`` (mean chance of
    that language over the words).

    A null text, one without letters, and any text if nothing was labelled, is
    ``und`` with score 0. Repeated rows get equal results; only the text decides.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, doc_id, text, lang))
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))

    def predict(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _predict(sent, parts)

    found = rows.mapInPandas(predict, f"_id {kind}, held_out boolean, lang_pred string, score double")
    return found.withColumnRenamed("_id", doc_id)
