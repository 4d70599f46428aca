"""Language identification: averaged hashed subword embeddings with a linear softmax.

Subwords are the byte 2-, 3- and 4-grams of lower-cased words, blanks at a word's borders included, hashed into a
table of embeddings; a text is their mean, and a linear softmax gives the languages. Embeddings and weights are
learned by stochastic gradient descent in numpy on a bounded sample of labelled rows (SAMPLE a language, chosen by the
hash of the id). A held-back part of the sample sets the temperature that calibrates probabilities, and the score below
which a text is rejected. Prediction maps rows without shuffle; mean and linear layer are both linear, so the layer is
folded into the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import base

#: Rows a language that the classifier is fitted on, at most about; embeddings' slots and width.
SAMPLE, BITS, WIDTH = 500, 15, 8
EPOCHS, BATCH, RATE, SEED = 12, 32, 30.0, 7
ORDERS = (2, 3, 4)
#: A-Z are lower by then; letters and all above 0x7F stay.
LETTERS = bytes(x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256))
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def subwords(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: slots of all texts' subwords, and where each text's begin (one more for the end)."""
    raw = [b" " + t.lower().encode("utf-8", "surrogatepass").translate(LETTERS) + b" " for t in texts]
    ends = np.cumsum([0] + [len(x) for x in raw])
    b = np.frombuffer(b"".join(raw) + b" " * 8, np.uint8)
    words = np.ndarray((len(b) - 7,), "<u8", b.data, 0, (1,))
    letter = b != 32
    for n in ORDERS:
        size = int(ends[-1])
        good = letter[:size] | letter[n - 1 : size + n - 1]
        for j in range(1, n - 1):
            good &= letter[j : size + j]
        at = np.flatnonzero(good)
        # A border blank is of the word's own text: texts begin and end with one.
        slot = ((words[at] & np.uint64((1 << 8 * n) - 1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)
        yield slot, np.searchsorted(at, ends)


class Model:
    def __init__(self, languages: list[str]):
        rng = np.random.default_rng(SEED)
        self.languages = languages
        self.table = rng.normal(0, 0.1, (1 << BITS, WIDTH)).astype(np.float32)
        self.weights = rng.normal(0, 0.1, (WIDTH, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)
        self.temperature, self.threshold, self.scores = 1.0, 0.0, None

    def fit(self, texts: list[str], labels: np.ndarray) -> None:
        """Every fifth row is held back for calibration."""
        rng = np.random.default_rng(SEED)
        rows = []
        for i in range(0, len(texts), 64):
            parts = [list(x) for x in subwords(texts[i : i + 64])]
            for j in range(len(texts[i : i + 64])):
                slots, counts = np.unique(np.concatenate([s[at[j] : at[j + 1]] for s, at in parts]), return_counts=True)
                rows.append((slots, (counts / max(1, counts.sum())).astype(np.float32)))
        back = np.arange(len(rows)) % 5 == 4
        learn = np.flatnonzero(~back)
        share = np.bincount(labels[learn], minlength=len(self.languages))
        heavy = (len(learn) / np.maximum(share, 1) / len(self.languages)).astype(np.float32)  # languages weigh the same
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            for at in np.array_split(rng.permutation(learn), max(1, len(learn) // BATCH)):
                x = self.dense([rows[i] for i in at])
                mean = x @ self.table
                p = softmax(mean @ self.weights + self.bias)
                p[np.arange(len(at)), labels[at]] -= 1
                p *= heavy[labels[at]][:, None] / len(at)
                slope = p @ self.weights.T
                self.weights -= np.float32(rate / 30) * (mean.T @ p)
                self.bias -= np.float32(rate / 300) * p.sum(0)
                self.table -= np.float32(rate) * (x.T @ slope)
        held = np.flatnonzero(back) if back.any() else learn
        logits = np.concatenate([self.dense([rows[i] for i in at]) @ self.table @ self.weights + self.bias for at in np.array_split(held, max(1, len(held) // 64))])
        options = np.exp(np.linspace(-3, 3, 61))
        self.temperature = float(min(options, key=lambda t: -np.log(softmax(logits / t)[np.arange(len(held)), labels[held]] + 1e-9).mean()))
        p = softmax(logits / self.temperature)
        right = p.argmax(1) == labels[held]
        # Below every text that was recognised rightly.
        self.threshold = float(0.9 * p.max(1)[right].min()) if right.any() else 0.0

    @staticmethod
    def dense(rows: list) -> np.ndarray:
        x = np.zeros((len(rows), 1 << BITS), np.float32)
        for i, (slots, share) in enumerate(rows):
            x[i, slots] = share
        return x

    def predict(self, texts: list[str]) -> np.ndarray:
        """Calibrated probabilities [text, language]; a text without subwords gets the bias alone."""
        if self.scores is None:
            self.scores = self.table @ self.weights if len(self.languages) <= WIDTH else self.table
        total, count = np.zeros((len(texts), self.scores.shape[1])), np.zeros(len(texts))
        for slots, at in subwords(texts):
            some = np.flatnonzero(np.diff(at))
            if len(some):
                for c in range(self.scores.shape[1]):
                    total[some, c] += np.add.reduceat(np.take(np.ascontiguousarray(self.scores[:, c]), slots), at[:-1][some], dtype=np.float64)
                count += np.diff(at)
        mean = total / np.maximum(count, 1)[:, None]
        return softmax(((mean if len(self.languages) <= WIDTH else mean @ self.weights) + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """docs: doc_id, text, lang. Learns from rows with id, text and lang that aren't held out; None if there are none."""
    known = docs.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    keep = F.lit(False)
    for lang, n in sorted(counts.items()):
        keep = keep | ((F.col("lang") == lang) & (chance < sample / n))
    rows = sorted(known.where(keep).collect(), key=lambda r: (r["doc_id"], r["text"], r["lang"]))
    languages = sorted(counts)
    model = Model(languages)
    model.fit([r["text"] for r in rows], np.array([languages.index(r["lang"]) for r in rows]))
    return model


def identify(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """The columns keep (doc_id if not given) with lang_pred, score (calibrated probability) and rejected. `und` with
    score 0 if text is null or has no letter, or no language was learned; these are rejected."""
    names = keep or ["doc_id"]
    cols = [*dict.fromkeys([*names, "text"])]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    model = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            every = [x or "" for x in batch.column("text").to_pylist()]
            for a, b in base.chunks(every, 1 << 20):
                texts = every[a:b]
                some = [i for i, t in enumerate(texts) if known and LETTER.search(t)]
                lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if some:
                    p = known.predict([texts[i] for i in some])
                    score[some] = p.max(1)
                    for i, j in zip(some, p.argmax(1), strict=True):
                        lang[i] = known.languages[j]
                low = np.array([x == UNKNOWN for x in lang]) | (score < (known.threshold if known else 0))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(lang, pa.string()), pa.array(score), pa.array(low)], names=[*names, "lang_pred", "score", "rejected"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(cols).mapInArrow(run, f"{kinds}, lang_pred string, score double, rejected boolean")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
