"""Toxicity of documents: gradient-boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from bandgraph.llm.common import fold
from bandgraph.llm.gbt import calibrated
from bandgraph.llm.sampling import bounded
from bandgraph.session import cut, table

#: Labelled documents of each class that the model is fitted on, at most about.
TRAIN_EACH = 8_000
#: Words and stems that the learned lexicon holds, at most; a stem is a word's first 4, 5 or 6 letters and '*'.
LEXICON, STEMS = 20_000, (4, 5, 6)
#: Documents with a lexicon entry, at least, and the share of toxic ones among them (with one clean one added).
LEAST, PURITY = 4, 0.75
THRESHOLD = 0.3
#: Words that a second person may be away from a lexicon word.
NEAR = 5
#: Common insults, and second-person pronouns of four languages.
INSULTS = "idiot idiots moron morons stupid loser losers scum trash garbage worthless pathetic disgusting clown dumb fool jerk bastard idiotisch dumm dummkopf trottel abschaum stupide imbécile crétin ordure idiota estúpido imbécil basura".split()
SECOND = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre tú ti tuyo usted ustedes".split()
#: Letters that digits and signs stand for in obfuscated words.
LEET = str.maketrans("013457@$!", "oieastasi")

WORD = re.compile(r"[^\W\d_]+")
HIDDEN = re.compile(r"(?<![^\W_])[^\W\d_]+[0-9@$!*.\-]+(?=[^\W\d_])[^\W_@$!*.\-]*(?:[0-9@$!*.\-]+[^\W\d_]+)*")
NAMES = "pure pure_density pure_kinds fair_density insult insult_density near near_rate second capitals shouting exclaims punctuation digits hidden hidden_hits words length repeats".split()
#: Classes of ASCII bytes: 1 upper, 2 lower, 3 digit, 4 '!', 5 other sign, 6 space, 0 part of a longer code point.
KIND = np.array([6 if i in (9, 10, 11, 12, 13, 32) else 1 if 65 <= i < 91 else 2 if 97 <= i < 123 else 3 if 48 <= i < 58 else 4 if i == 33 else 5 if i < 128 else 0 for i in range(256)], np.uint8)


def entries(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)]


class Features:
    """Dense features of a text under a lexicon {entry: share of toxic documents}."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.known = lexicon, {}
        self.insults, self.second = set(INSULTS), set(SECOND)

    def kind(self, word: str) -> int:
        """Bit 0: in the lexicon at 0.9 or more, bit 1: in it, bit 2: a common insult, bit 3: second person."""
        share = max((self.lexicon.get(e, 0.0) for e in entries(word)), default=0.0)
        return (share >= 0.9) | (share > 0) << 1 | (word in self.insults) << 2 | (word in self.second) << 3

    def row(self, text: str | None) -> list[float]:
        text = text or ""
        low = text.lower()
        words = WORD.findall(low)
        if len(self.known) > 500_000:
            self.known.clear()
        known = self.known
        bits = []
        for w in words:
            k = known.get(w)
            if k is None:
                k = known[w] = self.kind(w)
            bits.append(k)
        b = np.array(bits, np.uint8)
        n, chars = max(len(words), 1), max(len(text), 1)
        pure, fair, insult, second = ((b >> k & 1) for k in range(4))
        hit = np.flatnonzero(b & 7)
        near = 0
        if len(hit) and (at := np.flatnonzero(second)).size:
            k = np.searchsorted(at, hit)
            near = int((np.minimum(np.abs(at[np.minimum(k, len(at) - 1)] - hit), np.abs(at[np.maximum(k - 1, 0)] - hit)) <= NEAR).sum())
        raw = np.bincount(KIND[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)], minlength=7)
        hidden = HIDDEN.findall(low) if raw[3] + raw[5] + raw[4] else []
        hidden_hits = sum(1 for h in hidden if self.kind(re.sub(r"[^\w]|[\d_]", "", h.translate(LEET))) & 7)
        letters = max(raw[1] + raw[2], 1)
        return [pure.sum(), pure.sum() / n, len({words[i] for i in np.flatnonzero(pure)}), fair.sum() / n, insult.sum(), insult.sum() / n, near, near / n, second.sum() / n, raw[1] / letters, float(raw[1] > 0.6 * letters), raw[4] / chars, raw[5] / chars, raw[3] / chars, len(hidden) / n, hidden_hits, np.log1p(len(words)), chars / n, 1 - len(set(words)) / n]


def learn_lexicon(train: DataFrame) -> dict[int, dict[str, float]]:
    """Lexicons by half, 0 and 1 (of that half of train's documents) and 2 (of all), from rows (text, toxic, half)."""

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(e, int(y), int(h)) for t, y, h in zip(pdf.text, pdf.toxic, pdf.half, strict=True) for e in {e for w in set(WORD.findall((t or "").lower())) for e in entries(w)}]
            yield pd.DataFrame(rows, columns=["entry", "toxic", "half"]).groupby(["entry", "half"], as_index=False).agg(a=("toxic", "sum"), n=("toxic", "size"))

    seen = train.mapInPandas(tokens, "entry string, half long, a long, n long").groupBy("entry").agg(*(F.coalesce(F.sum(F.when(F.col("half") == h, F.col(c))), F.lit(0)).alias(f"{c}{h}") for h in (0, 1) for c in "an"))
    seen = seen.withColumns({"a2": F.expr("a0 + a1"), "n2": F.expr("n0 + n1")})
    out = {}
    for h in (0, 1, 2):
        share = F.col(f"a{h}") / (F.col(f"n{h}") + 1)
        kept = seen.where((F.col(f"n{h}") >= LEAST) & (share >= PURITY)).select("entry", share.alias("share"), (F.col(f"n{h}") * share).alias("w"))
        out[h] = {r.entry: r.share for r in kept.orderBy(F.desc("w"), "entry").limit(LEXICON).collect()}
    return out


def fit(docs: DataFrame, labels: DataFrame, each: int = TRAIN_EACH):
    """(lexicon, trees, knots) from documents (doc_id, text) and labels (doc_id, toxic), about `each` rows of either class.

    Each half of the sample gets its lexicon features from the other half's lexicon, as unseen documents do.
    """
    rows = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = bounded(rows, "toxic", each)  # bounded: broadcast
    half = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(6)).alias("fold")
    train = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic", half)
    train = cut(train.withColumn("half", F.col("fold") % 2))
    lexicons = learn_lexicon(train)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        makers = [Features(lexicons[1]), Features(lexicons[0])]
        for pdf in batches:
            yield pd.DataFrame({"x": [list(map(float, makers[h].row(t))) for t, h in zip(pdf.text, pdf.half, strict=True)], "toxic": pdf.toxic, "fold": pdf.fold})

    got = train.mapInPandas(features, "x array<double>, toxic int, fold long").toPandas()
    x = np.array(got.x.tolist(), float).reshape(-1, len(NAMES))
    order = np.lexsort((*x.T, got.toxic, got.fold))  # rows come in any order
    return lexicons[2], *calibrated(x[order], got.toxic.to_numpy(float)[order], got.fold.to_numpy()[order] // 2)


def toxicity(docs: DataFrame, model, column: str = "score") -> DataFrame:
    """docs with score, the calibrated probability from its whole text.

    A null or empty text scores as one without words; rows are independent, so nulls elsewhere, ties, repeated rows and
    other columns don't matter; column `score` is replaced. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))  # at most LEXICON entries

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon, trees, (knots, values) = cloudpickle.loads(shared.value)
        maker = Features(lexicon)
        for texts in batches:
            x = np.array([maker.row(t) for t in texts], float).reshape(-1, len(NAMES))
            yield pd.Series(np.interp(trees.margin(x), knots, values))

    return docs.withColumn(column, score(F.col("text")))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold(F.col("doc_id"), 4) != 2)
    out = toxicity(docs, fit(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
