"""Language identification of words and documents by a linear-chain conditional random field."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from bandgraph.llm.common import fold
from bandgraph.llm.sampling import bounded
from bandgraph.session import table

#: Documents of each language that the model is fitted on, at most about; each gives a run of this many words.
TRAIN_EACH, TRAIN_WORDS = 700, 200
#: Hashed feature weights for each language; letters of a word at most: a longer run of letters is several words.
SIZE, LETTERS = 1 << 17, 24
#: A chain is a run of at most so many words; longer texts are several chains.
CHAIN = 512
#: Words of a chain that may be in another language than their document, as the fit assumes.
SWITCH = 0.1
UNDETERMINED = "und"
#: Signs of numbers that \w has and \d hasn't, such as fractions and Roman numerals; they are no letters.
NUMERALS = "".join(c for c in map(chr, range(0x20000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
WORD = re.compile(rf"[^\W\d_{NUMERALS}]{{1,{LETTERS}}}")
#: Runs of letters and numerals, which re finds much faster than it looks up a class of a thousand signs.
RUN = re.compile(r"[^\W\d_]+")
#: Words scored at once, which bounds a worker's memory whatever the batch is.
BLOCK = 100_000


def words_of(text: str | None) -> list[str]:
    """What WORD finds in the lower-case text; only runs with a numeral or of more than LETTERS letters are searched for it."""
    found = RUN.findall((text or "").lower())
    if not found or ("".join(found).isalpha() and max(map(len, found)) <= LETTERS):
        return found
    return [part for w in found for part in ([w] if len(w) <= LETTERS and w.isalpha() else WORD.findall(w))]


def features(words: list[str]) -> np.ndarray:
    """Hashed features of lower-case words, [n, k]: the word itself (lexicon), affixes of 1 to 4 and n-grams of 1 to 3 letters; 0 is none."""
    n = len(words)
    size = np.fromiter(map(len, words), np.int64, n)
    c = np.zeros((n, LETTERS + 6), np.uint64)
    if n:
        c[:, 1 : LETTERS + 1] = np.array(words, f"U{LETTERS}").view(np.uint32).reshape(n, LETTERS)
    c[:, 0] = 1  # word boundary
    row = np.arange(n)
    c[row, size + 1] = 1
    mult = np.uint64(0x9E3779B97F4A7C15)
    mixed = lambda h, kind: (((h + np.uint64(kind)) * mult) ^ ((h * mult) >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - 17)
    out = []
    h = np.zeros(n, np.uint64)
    for i in range(LETTERS):
        h = h * np.uint64(1_000_003) + c[:, i + 1] * (i < size)
        if i < 4:
            out.append(mixed(h, 100 + i) * (size > i))
    out.append(mixed(h, 99))
    h = np.zeros(n, np.uint64)
    for i in range(4):
        at = np.maximum(size - i, 0)
        h = h * np.uint64(1_000_003) + c[row, at]
        out.append(mixed(h, 200 + i) * (size > i))
    cells = min(LETTERS, int(size.max(initial=0))) + 2  # with both boundaries, which no single letter is
    for k in (1, 2, 3):
        for i in range(k == 1, cells - k + 1):
            g = np.zeros(n, np.uint64)
            for j in range(k):
                g = g * np.uint64(1_114_112) + c[:, i + j]
            out.append(mixed(g, 300 + k) * (i + k <= size + (2 if k > 1 else 1)))
    return np.stack([o.astype(np.int32) for o in out], 1)


def _emissions(words: list[str], weights: np.ndarray) -> np.ndarray:
    out = np.empty((len(words), weights.shape[1]), np.float32)
    for i in range(0, len(words), 20_000):
        f = features(words[i : i + 20_000])
        e = np.zeros((len(f), weights.shape[1]), np.float32)
        for k in range(f.shape[1]):
            e += weights[f[:, k]]
        out[i : i + 20_000] = e
    return out


def forward_backward(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """Marginals [words, languages] of chains laid end to end, of the given sizes; with pairs also summed pair marginals.

    scores are log potentials of words, moves those of transitions. Chains go together, longest first, a word a step.
    """
    off = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    off, size = off[order], sizes[order]
    e = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float64)
    t = np.exp(moves)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(longest), side="left")  # chains longer than each step
    for s in range(longest):
        at = off[: live[s]] + s
        a = e[at] if s == 0 else e[at] * (alpha[at - 1] @ t)
        alpha[at] = a / a.sum(1, keepdims=True)
    counts = np.zeros_like(t)
    for s in range(longest - 2, -1, -1):
        at = off[: live[s + 1]] + s
        eb = e[at + 1] * beta[at + 1]
        b = eb @ t.T
        if pairs:
            joint = alpha[at][:, :, None] * t[None] * eb[:, None, :]
            counts += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        beta[at] = b / b.sum(1, keepdims=True)
    g = alpha * beta
    g /= g.sum(1, keepdims=True)
    return (g, counts) if pairs else g


class Tagger:
    """Languages, feature weights and transitions; fitted to documents' languages as noisy labels of their words."""

    def fit(self, texts: list[str], langs: list[str], steps: int = 25) -> Tagger:
        self.langs = sorted(set(langs))
        n = max(len(self.langs), 1)
        chains, label = [], []
        for text, lang in zip(texts, langs, strict=True):
            w = words_of(text)
            start = (len(w) * 7919 + len(text)) % max(len(w) - TRAIN_WORDS + 1, 1)
            if w := w[start : start + TRAIN_WORDS]:
                chains.append(w)
                label.append(self.langs.index(lang))
        ids: dict[str, int] = {}
        seq = np.array([ids.setdefault(w, len(ids)) for c in chains for w in c], np.int64)
        sizes = np.array([len(c) for c in chains], np.int64)
        f = features(list(ids))
        given = np.repeat(np.array(label, np.int64), sizes)
        clamp = np.full((len(seq), n), np.log(SWITCH / max(n - 1, 1)) if n > 1 else 0.0, np.float32)
        if len(seq):
            clamp[np.arange(len(seq)), given] = np.log(1 - SWITCH)
        self.weights, self.moves = np.zeros((SIZE, n), np.float32), np.zeros((n, n))
        if n < 2:
            return self
        np.fill_diagonal(self.moves, 2.0)
        g2, m2 = np.full((SIZE, n), 1e-6, np.float32), np.full((n, n), 1e-6)
        each = np.bincount(seq, minlength=len(ids))[:, None]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        runs = [(slice(i, i + 250), ends[i], ends[min(i + 250, len(sizes))]) for i in range(0, len(sizes), 250)]
        for step in range(steps):
            e = np.zeros((len(ids), n), np.float32)
            for k in range(f.shape[1]):
                e += self.weights[f[:, k]]
            if step < steps // 2:  # words on their own first
                p = np.exp(e - e.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                want = np.stack([np.bincount(seq, given == s, len(ids)) for s in range(n)], 1)
                grad = want - p * each
                gm = None
            else:
                grad, gm = np.zeros((len(ids), n)), -1e-3 * self.moves * len(seq)
                for c, lo, hi in runs:  # some chains at a time, which bounds the driver's memory
                    own = e[seq[lo:hi]]
                    free, cf = forward_backward(own, sizes[c], self.moves, True)
                    held, ch = forward_backward(own + clamp[lo:hi], sizes[c], self.moves, True)
                    held -= free
                    for s in range(n):
                        grad[:, s] += np.bincount(seq[lo:hi], held[:, s], len(ids))
                    gm += ch - cf
            # Words count by the root of how often they occur, so that a few common ones don't decide every feature.
            grad = grad / np.sqrt(np.maximum(each, 1))
            gw = np.stack([sum(np.bincount(f[:, k], grad[:, s], SIZE) for k in range(f.shape[1])) for s in range(n)], 1).astype(np.float32)
            gw -= 0.01 * self.weights
            gw[0] = 0
            g2 += gw * gw
            self.weights += 0.3 * gw / np.sqrt(g2)
            if gm is not None:
                m2 += gm * gm
                self.moves += 0.3 * gm / np.sqrt(m2)
        return self


class Scorer:
    """Applies a Tagger to texts; keeps the emissions of words it has seen, up to a bound."""

    def __init__(self, tagger: Tagger, keep: int = 100_000):
        self.t, self.keep = tagger, keep
        self.ids: dict[str, int] = {}
        self.e = np.zeros((0, tagger.weights.shape[1]), np.float32)

    def _known(self, found: list[list[str]]) -> np.ndarray:
        if len(self.ids) > self.keep:
            self.ids, self.e = {}, self.e[:0]
        before, ids = len(self.ids), self.ids
        seq = np.array([ids.setdefault(w, len(ids)) for ws in found for w in ws], np.int64)
        if len(ids) > before:
            new = [w for w, i in zip(list(ids)[before:], range(before, len(ids)), strict=True)]
            self.e = np.concatenate([self.e, _emissions(new, self.t.weights)])
        return seq

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: its words' mean marginals, how many words it has, and how often the likeliest language switches."""
        n = self.e.shape[1]
        out, count, switches = np.zeros((len(texts), n)), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        i = 0
        while i < len(texts):
            found, total, first = [], 0, i
            while i < len(texts) and (total < BLOCK or not found):
                found.append(words_of(texts[i]))
                total += len(found[-1])
                i += 1
            size = np.array([len(w) for w in found], np.int64)
            if not total:
                continue
            seq = self._known(found)
            chains = np.concatenate([[CHAIN] * (s // CHAIN) + ([s % CHAIN] if s % CHAIN else []) for s in size if s]).astype(np.int64)
            g = forward_backward(self.e[seq], chains, self.t.moves)
            doc = np.repeat(np.arange(len(found)), size)
            for s in range(n):
                out[first:i, s] = np.bincount(doc, g[:, s], len(found))
            best = g.argmax(1)
            switches[first:i] = np.bincount(doc[1:], (best[1:] != best[:-1]) & (doc[1:] == doc[:-1]), len(found))
            out[first:i] /= np.maximum(size, 1)[:, None]
            count[first:i] = size
        return out, count, switches


def fit(docs: DataFrame, each: int = TRAIN_EACH) -> Tagger:
    """A Tagger from about `each` documents (doc_id, text, lang) of every language with a non-null text."""
    rows = docs.where("text IS NOT NULL").select("doc_id", "lang")
    picked = bounded(rows, "lang", each).select("doc_id", F.col("lang").alias("l")).distinct()  # bounded: broadcast
    got = docs.select("doc_id", "text", "lang").join(F.broadcast(picked), "doc_id").where("lang = l").select("doc_id", "text", "lang")

    def head(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:  # what fit() uses of a text, so that the driver gets little of a long one
            yield pdf.assign(text=[" ".join((w := words_of(t))[(k := (len(w) * 7919) % max(len(w) - TRAIN_WORDS + 1, 1)) : k + TRAIN_WORDS]) for t in pdf.text])

    pdf = got.mapInPandas(head, got.schema).toPandas().sort_values(["lang", "text"], kind="stable")
    return Tagger().fit(pdf.text.tolist(), pdf.lang.tolist())


def identify(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """docs with lang_pred, score, lang_shares (map of language to share of words) and lang_switches.

    Words are runs of letters of the whole text, LETTERS at most, labelled by forward-backward in chains of up to CHAIN
    words; a document's language is that with the largest share of its words, ties by name, and score is the share. Without a text or a letter: 'und' with score 0.
    Rows are independent: nulls elsewhere, ties and repeated rows don't matter. Columns of the four names are replaced.
    With no learned language every text is 'und'. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(tagger))  # SIZE weights for each language

    @F.pandas_udf("lang_pred string, score double, lang_shares map<string,double>, lang_switches long")
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = cloudpickle.loads(shared.value)
        scorer = Scorer(tagger)
        for texts in batches:
            p, n, moves = scorer.shares(texts.tolist())
            sure = (n > 0) & bool(tagger.langs)
            best = p.argmax(1)
            yield pd.DataFrame({
                "lang_pred": [tagger.langs[b] if ok else UNDETERMINED for b, ok in zip(best, sure, strict=True)],
                "score": np.where(sure, p[np.arange(len(p)), best], 0.0).clip(0, 1),
                "lang_shares": [{s: float(x) for s, x in zip(tagger.langs, row, strict=True) if x >= 0.005} if ok else {} for row, ok in zip(p, sure, strict=True)],
                "lang_switches": moves,
            })

    names = ("lang_pred", "score", "lang_shares", "lang_switches")
    return docs.drop(*names).withColumn("_tag", tag("text")).select(*(c for c in docs.columns if c not in names), *(F.col("_tag")[c].alias(c) for c in names))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 4) == 2
    tagger = fit(docs.where(~held_out & F.col("lang").isNotNull()))
    return identify(docs.select("doc_id", "text"), tagger).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "lang_switches")
