"""Language identification: the family first, then one-versus-one linear support vector machines within it.

Features are frequencies of byte trigrams (A-Z as a-z, other ASCII characters that are no letters
as a space), hashed to ``SIZE`` columns; a decision is the mean weight of a text's trigrams plus a bias.
The machines are fitted by dual coordinate descent on ``sample`` labelled texts at most, equally many of
each language. A language that the table of families lacks is a family
of its own. Prediction reads each whole text once and needs no shuffle.

Null texts and texts without a letter are ``und`` with score 0; so is everything if there is
nothing to learn from. With one language learned, all other texts get it. Extra columns are kept as they are, save
lang_pred and score, whose place the operator's take. Repeated rows are predicted each and learned from each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm import arrays as A

# fixed values: families of languages by ISO 639-1 code
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "bg": "slavic", "sk": "slavic",
}
SIZE, SCALE, STEEP = 4096, 30.0, 4.0
_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[:128] = 0x20
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The column of each trigram within a text, and for each text the index of its first, then the number of all."""
    if len(data) < 3:
        return np.zeros(0, np.uint16), np.zeros(len(offsets), np.int64)
    x = _LETTERS[data].astype(np.uint32)
    code = x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)
    use = code != 0x202020
    for back in (1, 2):  # trigrams across two texts
        at = offsets[1:-1] - back
        use[at[(at >= 0) & (at < len(use))]] = False
    before = np.concatenate(([0], np.cumsum(use)))
    code = code[use] * np.uint32(0x9E3779B1)
    return (code >> np.uint32(20)).astype(np.uint16), before[np.minimum(offsets, len(use))]


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in A.text_slices(batch):
            columns, first = _trigrams(data, offsets)
            out = [(np.bincount(columns[s:e], minlength=SIZE) / max(1, e - s)).astype("<f4").tobytes() for s, e in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([rows["lang"].combine_chunks().cast(pa.string()), pa.array(out, pa.binary())], ["lang", "profile"])


def fit_machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 12) -> np.ndarray:
    """Weights and, last, bias of a linear machine with squared hinge loss; y is 1 or -1."""
    weights, dual = np.zeros(x.shape[1]), np.zeros(len(y))
    diagonal = np.einsum("ij,ij->i", x, x) + 0.5 / cost
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(y)):
            gradient = y[i] * (x[i] @ weights) - 1 + dual[i] * 0.5 / cost
            new = max(0.0, dual[i] - gradient / diagonal[i])
            if new != dual[i]:
                weights += (new - dual[i]) * y[i] * x[i]
                dual[i] = new
    return weights


class Model:
    """``pairs``: for each machine the classes at its positive and negative side; ``groups``: the classes decided among, the families first."""

    def __init__(self, labels: list[str], x: np.ndarray):
        self.families: dict[str, list[str]] = {}
        for lang in sorted(set(labels)):
            self.families.setdefault(FAMILIES.get(lang, lang), []).append(lang)
        x = np.append(x * SCALE, np.ones((len(x), 1), np.float32), axis=1)
        names = np.array(labels)
        family = np.array([FAMILIES.get(v, v) for v in labels])
        self.groups = [("", sorted(self.families), family), *((f, v, names) for f, v in sorted(self.families.items()))]
        self.groups = [(f, classes, {pair: fit_machine(x[m := np.isin(of, pair)], np.where(of[m] == pair[0], 1, -1)) for pair in combinations(classes, 2)}) for f, classes, of in self.groups]

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language of each text, and a score between 0 and 1: how clear both decisions are."""
        columns, first = _trigrams(data, offsets)
        n = np.maximum(1, np.diff(first))
        lang, score = np.full(len(n), "", object), np.ones(len(n))
        chosen: dict[str, np.ndarray] = {"": np.ones(len(n), bool)}
        for group, classes, machines in self.groups:
            total = np.zeros((len(classes), len(n)))
            for (a, b), weights in machines.items():
                sums = np.concatenate(([0.0], np.cumsum(weights[:-1][columns])))
                margin = np.clip((sums[first[1:]] - sums[first[:-1]]) / n * SCALE + weights[-1], -1, 1)
                total[classes.index(a)] += margin
                total[classes.index(b)] -= margin
            best = total.argmax(axis=0)
            top = np.sort(total, axis=0)
            gap = top[-1] - top[-2] if len(classes) > 1 else np.full(len(n), np.inf)
            mine = chosen[group]
            score[mine] *= (1 / (1 + np.exp(-STEEP * gap)))[mine]
            for k, name in enumerate(classes):
                if group:
                    lang[mine & (best == k)] = name
                else:
                    chosen[name] = mine & (best == k)
        return lang, score


def fit(docs: DataFrame, usable: Column, sample: int = 2000) -> Model | None:
    """A model of ``sample`` usable rows with a lang and a letter at most; None if there are none.

    All languages give equally many rows (1000 at most; the most frequent ``sample`` languages if there are more), those with
    the smallest hashes of their ids. A first cut by the hash leaves a few times as many, so the choice never meets in one task at full size.
    """
    known = docs.where(usable & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("doc_id").alias("h"))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample).collect()
    if not counts:
        return None
    each = max(1, min(1000, sample // len(counts)))
    cuts = docs.sparkSession.createDataFrame([(r["lang"], min(1 << 30, math.ceil((8 * each + 64) / r["count"] * (1 << 30)))) for r in counts], "lang string, cut long")
    few = known.join(F.broadcast(cuts), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("cut")).where(F.col("text").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy("h", F.xxhash64("text"))
    few = few.withColumn("at", F.row_number().over(order)).where(F.col("at") <= each).select("lang", "text")
    found = few.mapInArrow(_profiles, "lang string, profile binary").collect()  # bounded by the sample, in rows
    if not found:
        return None
    found.sort(key=lambda r: (r.lang, r.profile))
    return Model([r.lang for r in found], np.stack([np.frombuffer(r.profile, "<f4") for r in found]))


def _predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with lang_pred and score; only texts go to Python, and only answers come back."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, letter in parts:
            out = []
            for rows, data, offsets in A.text_slices(pa.RecordBatch.from_arrays([text, letter], ["text", "letter"])):
                known = rows["letter"].to_numpy()
                lang, score = held.value.predict(data, offsets) if held.value else (np.full(len(known), "und", object), np.zeros(len(known)))
                out.append(pa.StructArray.from_arrays([pa.array(np.where(known, lang, "und"), pa.string()), pa.array(np.where(known, score, 0.0), pa.float64())], ["lang_pred", "score"]))
            yield pa.concat_arrays(out) if out else pa.array([], pa.struct([("lang_pred", pa.string()), ("score", pa.float64())]))

    A.small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    named = docs.withColumn("lang_pred", F.arrow_udf(predict, "lang_pred string, score double")("text", _letter()))
    return named.select(*(A.column(c) for c in docs.columns), "lang_pred.lang_pred", "lang_pred.score")


def _letter() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, usable: Column | None = None, sample: int = 2000) -> DataFrame:
    """``docs`` with lang_pred and score, learned from its ``usable`` rows (all with a lang by default)."""
    return _predicted(docs, fit(docs, F.lit(True) if usable is None else usable, sample))


def recognised(docs: DataFrame, least: float = 0.4, sample: int = 2000) -> DataFrame:
    """The rows of ``docs`` whose language is told: those of ``und`` go, and those with a score below ``least``.

    Each of the two decisions scores 0.5 where it is a coin's, 0.25 together; clear ones are near 1. Where nothing can be learned, all
    texts with a letter stay.
    """
    model = fit(docs, F.lit(True), sample)
    if model is None:
        return docs.where(_letter())
    old = docs.columns
    if not {"lang_pred", "score"} & set(old):
        return _predicted(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*(A.column(c) for c in old))
    packed = docs.select(F.struct(*(A.column(c) for c in old)).alias("r"), "text")  # columns of these names stay what they are
    return _predicted(packed, model).where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("r.*")
