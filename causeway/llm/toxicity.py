"""Toxicity by class-conditional Kneser-Ney models of words' characters.

Words are runs of ASCII letters, digits and characters above 127, letters in lower case. Two models, toxic and
ordinary, predict each character of a word (and its end) from the ``ORDER`` - 1 before it, the word's begin
counting as such. Counts are discounted by ``DISCOUNT`` and back off with ``STRENGTH`` more to one shared estimate: that of both
classes' counts, interpolated with continuation counts of shorter runs (Kneser and Ney 1995). So a rare
expression is as likely in both models unless one class has shown it again and again. A document counts each word once.

A word's log-likelihood ratio is the sum over its characters. Two length-normalised comparisons of the models
make a text's features: the ratio of the whole text divided by its number of characters, and what words' ratios exceed ``LEVEL``,
divided by the root of the number of words. (The first alone can't tell one word in a short text from many in a long one.) A
logistic curve on them, fitted on ``sample`` labelled rows at most, each scored by models of the other ``FOLDS`` - 1 folds of all rows, gives the
score; it is moved so that 0.3 separates these rows best.

The tables are keyed by the runs themselves and grow with the input. Runs are counted within tasks,
added up by JVM aggregates that combine before the shuffle, and estimated by joins; no group is larger than the
alphabet. Up to ``table_entries`` entries (checked) the ratios are broadcast, and documents are not shuffled; beyond,
words meet them by joins and documents meet words, hot words by broadcast, with the same result.

Null and empty texts have the features 0 and get the curve's score there. With no learnable row of both
classes all scores are 0. Labels of repeated ids count once per row of the join; null labels don't count.
Repeated rows are scored each. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm import arrays as A
from causeway.llm.components import joined
from causeway.runtime import settled

ORDER, DISCOUNT, STRENGTH, LEVEL, FOLDS = 6, 0.95, 50.0, 1.0, 5
_BEGIN, _END = 2, 3
_WORD = np.full(256, 0x20, np.uint8)
_WORD[0x30:0x3A] = np.arange(0x30, 0x3A)
_WORD[0x61:0x7B] = np.arange(0x61, 0x7B)
_WORD[0x41:0x5B] = np.arange(0x61, 0x7B)
_WORD[0x80:] = np.arange(0x80, 0x100)
_lower: list[np.ndarray] = []


def _lowered(points: np.ndarray) -> np.ndarray:
    """Letters of scripts with cases in lower case, where that is one character."""
    if not _lower:
        _lower.append(np.array([ord(v) if len(v := chr(c).lower()) == 1 else c for c in range(0x2000)], np.uint32))
    return np.where(points < 0x2000, _lower[0][np.minimum(points, 0x1FFF)], points)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in UTF-8: where each one's words begin, which of the different words each is, the different words' bytes and their offsets."""
    data = _WORD[data]
    begins, ends, first = A.word_bounds(data, offsets)
    _, one, of = np.unique(A.word_hashes(data, begins, ends), return_index=True, return_inverse=True)
    size = ends[one] - begins[one]
    at = np.concatenate(([0], np.cumsum(size)))
    return first, of, data[np.repeat(begins[one] - at[:-1], size) + np.arange(at[-1])], at


def runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ORDER characters of words (bytes and their offsets), one for each character and the end, and where each word's runs begin."""
    points = _lowered(np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4"))
    first = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[at]
    lead, n = ORDER - 1, len(at) - 1
    size = np.diff(first)
    begin = first[:-1] + np.arange(n) * ORDER  # of each word's symbols: the begin ORDER - 1 times, the characters, the end
    symbols = np.full(len(points) + n * ORDER, _BEGIN, np.uint32)
    symbols[begin + lead + size] = _END
    symbols[np.repeat(begin + lead - first[:-1], size) + np.arange(len(points))] = points
    starts = np.concatenate(([0], np.cumsum(size + 1)))
    from_ = np.repeat(begin - starts[:-1], size + 1) + np.arange(starts[-1])
    return symbols[from_[:, None] + np.arange(ORDER)], starts


def keys(grams: np.ndarray) -> np.ndarray:
    """A signed 64-bit hash of each row."""
    h = np.zeros(len(grams), np.uint64)
    for k in range(grams.shape[1]):
        h = A.mix(h * A.C3 + grams[:, k].astype(np.uint64) + A.C1)
    return h.view(np.int64)


def _strings(grams: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(grams, "<u4").view(f"<U{grams.shape[1]}").ravel().tolist(), pa.string())


_COUNTS = [f"c{k}" for k in range(2 * FOLDS)]
#: One model for the rows of each fold, learned from the others, and one of all.
_MODELS = range(FOLDS + 1)
_RATIOS = ", ".join(f"r{m} float" for m in _MODELS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents' words each run stands, by kind = 2 * fold + class."""
    for batch in batches:
        for rows, data, offsets in A.text_slices(batch):
            first, of, letters, at = words_of(data, offsets)
            owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
            pair = np.unique(owner * max(1, len(at)) + of)  # a word once for each document
            n = np.bincount(pair % max(1, len(at)) * len(_COUNTS) + rows["kind"].to_numpy()[pair // max(1, len(at))], minlength=len(_COUNTS) * (len(at) - 1)).reshape(-1, len(_COUNTS))
            grams, starts = runs(letters, at)
            _, one, run = np.unique(keys(grams), return_index=True, return_inverse=True)
            each = np.repeat(n, np.diff(starts), axis=0)
            sums = [np.bincount(run, each[:, k], len(one)).astype(np.int64) for k in range(len(_COUNTS))]
            yield pa.RecordBatch.from_arrays([_strings(grams[one]), *map(pa.array, sums)], ["g", *_COUNTS])


def _shared(table: DataFrame, size: int) -> DataFrame:
    """(g, p0, p1 ...): the interpolated estimate of each run's last character; n0, n1 ... are the counts of ``table``."""
    if size == 1:
        total = table.agg(*(F.sum(f"n{m}") for m in _MODELS)).first()
        return table.select("g", *((F.col(f"n{m}") / F.lit(float(total[m] or 1))).alias(f"p{m}") for m in _MODELS))
    shorter = settled(table.groupBy(F.expr(f"substring(g, 2, {size - 1})").alias("g")).agg(*(F.sum((F.col(f"n{m}") > 0).cast("long")).alias(f"n{m}") for m in _MODELS)), "runs")
    lower = _shared(shorter, size - 1).withColumnRenamed("g", "rest")
    context = F.expr(f"substring(g, 1, {size - 1})")
    sums = table.groupBy(context.alias("context")).agg(*(F.sum(f"n{m}").alias(f"t{m}") for m in _MODELS), *(F.sum((F.col(f"n{m}") > 0).cast("long")).alias(f"k{m}") for m in _MODELS))
    both = table.withColumns({"context": context, "rest": F.expr(f"substring(g, 2, {size - 1})")}).join(sums, "context").join(lower, "rest")
    estimate = [F.when(F.col(f"t{m}") > 0, (F.greatest(F.col(f"n{m}") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"k{m}") * F.col(f"p{m}")) / F.col(f"t{m}")).otherwise(F.col(f"p{m}")) for m in _MODELS]
    return settled(both.select("g", *(e.alias(f"p{m}") for m, e in zip(_MODELS, estimate, strict=True))), "estimates")


def ratio_tables(counts: DataFrame) -> DataFrame:
    """(g, r0, r1 ...) of ``counts`` (g, c0, c1 ...): ln of the toxic model's probability over the ordinary one's, for each model.

    A run of ORDER characters is the ratio of its last one; a run of one less is that of any other character after it.
    """
    of = lambda c, m: reduce(add, (F.col(f"c{2 * f + c}") for f in range(FOLDS) if f != m))
    by = counts.select("g", *(of(c, m).alias(f"{'ox'[c]}{m}") for m in _MODELS for c in (0, 1)))
    by = by.select("*", *((F.col(f"o{m}") + F.col(f"x{m}")).alias(f"n{m}") for m in _MODELS))
    shared = _shared(by, ORDER)
    context = F.expr(f"substring(g, 1, {ORDER - 1})")
    sums = by.groupBy(context.alias("context")).agg(*(f(v).alias(f"{n}{c}{m}") for m in _MODELS for c in "ox" for v in [F.col(f"{c}{m}")] for n, f in (("t", F.sum), ("k", lambda v: F.sum((v > 0).cast("long"))))))
    sums = settled(sums, "contexts")
    left = lambda c, m: DISCOUNT * F.col(f"k{c}{m}") + STRENGTH
    rest = sums.select(F.col("context").alias("g"), *((F.log(left("x", m) / (F.col(f"tx{m}") + STRENGTH)) - F.log(left("o", m) / (F.col(f"to{m}") + STRENGTH))).alias(f"r{m}") for m in _MODELS))
    own = lambda c, m: (F.greatest(F.col(f"{c}{m}") - DISCOUNT, F.lit(0.0)) + left(c, m) * F.col(f"p{m}")) / (F.col(f"t{c}{m}") + STRENGTH)
    both = by.withColumn("context", context).join(sums, "context").join(shared, "g")
    # a run that only the left-out fold has shown has no estimate: there, it is one of the rest
    ratio = [F.when(F.col(f"n{m}") > 0, F.log(own("x", m)) - F.log(own("o", m))).otherwise(F.log(left("x", m) / (F.col(f"tx{m}") + STRENGTH)) - F.log(left("o", m) / (F.col(f"to{m}") + STRENGTH))).alias(f"r{m}") for m in _MODELS]
    return settled(both.select("g", *ratio).union(rest), "ratios")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch["g"].to_pylist()
        full = np.array([len(g) == ORDER for g in names], bool)
        out = np.zeros(len(names), np.int64)
        for size, which in ((ORDER, full), (ORDER - 1, ~full)):
            some = np.array([g for g, w in zip(names, which, strict=True) if w], f"<U{size}")
            out[which] = keys(some.view("<u4").reshape(-1, size))
        yield pa.RecordBatch.from_arrays([pa.array(out), *(batch[f"r{m}"].cast(pa.float32()) for m in _MODELS)], ["key", *(f"r{m}" for m in _MODELS)])


class Ratios:
    """The tables in memory: sorted keys of runs and of contexts, and their ratios by model."""

    def __init__(self, key: np.ndarray, ratio: np.ndarray):
        self.key, self.ratio = key, ratio  # the last row of ratios is that of what was never seen

    @classmethod
    def sorted(cls, key: np.ndarray, columns: list[np.ndarray]) -> Ratios:
        order = np.argsort(key)
        ratio = np.zeros((len(key) + 1, len(columns)), np.float32)
        for m, column in enumerate(columns):
            ratio[:-1, m] = column[order]
        return cls(key[order], ratio)

    def only(self, model: int) -> Ratios:
        """The same with the ratios of one model, as each number of a model."""
        return Ratios(self.key, np.ascontiguousarray(self.ratio[:, model : model + 1]))

    def _at(self, wanted: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return np.where(self.key[at] == wanted, at, -1)

    def words(self, letters: np.ndarray, at: np.ndarray, model: int) -> tuple[np.ndarray, np.ndarray]:
        """The ratio and the number of characters (the end is one) of each word."""
        if len(at) < 2:
            return np.zeros(0), np.zeros(0, np.int64)
        grams, starts = runs(letters, at)
        found = self._at(keys(grams))
        lost = np.flatnonzero(found < 0)
        found[lost] = self._at(keys(grams[lost, :-1]))  # never seen: what is left in its context; a context never seen: 0, the last entry
        return np.add.reduceat(self.ratio[found, min(model, self.ratio.shape[1] - 1)].astype(np.float64), starts[:-1]), np.diff(starts)


def features_of(ratios: Ratios, model: int, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Both comparisons for each text."""
    first, of, letters, at = words_of(data, offsets)
    each, size = ratios.words(letters, at, model)
    total, chars, over = (np.diff(np.concatenate(([0.0], np.cumsum(v[of] if len(v) else np.zeros(0))))[first]) for v in (each, size, np.maximum(each - LEVEL, 0)))
    return np.stack([total / np.maximum(1, chars), over / np.sqrt(np.maximum(1, np.diff(first)))], 1)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton's method; the last weight is the bias."""
    z = np.append(x, np.ones((len(x), 1)), axis=1)
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def shifted(w: np.ndarray, x: np.ndarray, y: np.ndarray, cut: float = 0.3) -> np.ndarray:
    """The curve moved so that a score of ``cut`` separates the classes best (by F1) on what it was fitted on."""
    z = x @ w[:-1] + w[-1]
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][z[order][1:] == z[order][:-1]] = 0  # no cut between equal ones
    k = int(np.argmax(f1))
    below = z[order][k + 1] if k + 1 < len(z) else z[order][k] - 1
    out = w.copy()
    out[-1] += np.log(cut / (1 - cut)) - (z[order][k] + below) / 2
    return out


def _held(tables: DataFrame, entries: int) -> Ratios | None:
    """The tables in memory; None if they have more than ``entries`` entries."""
    if tables.count() > entries:
        return None
    rows = tables.mapInArrow(_keyed, f"key long, {_RATIOS}").toArrow()  # at most ``entries`` rows
    return Ratios.sorted(rows["key"].to_numpy(), [rows[f"r{m}"].to_numpy() for m in _MODELS])


def _featured(rows: DataFrame, tables: DataFrame, held: Ratios | None) -> DataFrame:
    """``rows`` (id, text, model) as (id, f0, f1) by the model of that number."""
    spark = rows.sparkSession
    kind = rows.schema["id"].dataType
    if held is not None:
        sent = spark.sparkContext.broadcast(held)

        def short(batches):
            for batch in batches:
                for some, data, offsets in A.text_slices(batch):
                    model = some["model"].to_numpy()
                    x = np.zeros((len(model), 2))
                    for m in np.unique(model).tolist():
                        x = np.where((model == m)[:, None], features_of(sent.value, m, data, offsets), x)
                    yield pa.RecordBatch.from_arrays([some["id"].combine_chunks(), pa.array(x[:, 0]), pa.array(x[:, 1])], ["id", "f0", "f1"])

        return rows.mapInArrow(short, f"id {kind.simpleString()}, f0 double, f1 double")

    def tokens(batches):
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for some, data, offsets in A.text_slices(batch):
                first, of, letters, at = words_of(data, offsets)
                n = len(first) - 1
                pair, times = np.unique(np.repeat(np.arange(n), np.diff(first)) * max(1, len(at)) + of, return_counts=True)
                row, word = pair // max(1, len(at)), pair % max(1, len(at))
                text = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(letters.tobytes())).take(pa.array(word))
                whole = pa.nulls(n, pa.string())  # and one row for each text
                yield pa.RecordBatch.from_arrays([pa.array(uid + np.append(row, np.arange(n))), pa.concat_arrays([some["id"].combine_chunks().take(pa.array(row)), some["id"].combine_chunks()]), pa.array(np.append(some["model"].to_numpy()[row], np.full(n, FOLDS))), pa.concat_arrays([text, whole]), pa.array(np.append(times, np.zeros(n, np.int64)))], ["uid", "id", "model", "word", "n"])
                uid += n

    def cut(batches):
        for batch in batches:
            text = batch["word"].to_pylist()
            letters = np.frombuffer("".join(text).encode(), np.uint8)
            at = np.concatenate(([0], np.cumsum([len(w.encode()) for w in text]))).astype(np.int64)
            grams, starts = runs(letters, at)
            yield pa.RecordBatch.from_arrays([batch["word"].take(pa.array(np.repeat(np.arange(len(text)), np.diff(starts)))), _strings(grams)], ["word", "g"])

    found = settled(rows.mapInArrow(tokens, f"uid long, id {kind.simpleString()}, model long, word string, n long"), "tokens")
    words = settled(found.where("word is not null").groupBy("word").agg(F.count("*").alias("_n")), "words")
    # every run of every word, with its ratio, or what is left in its context
    pieces = words.select("word").mapInArrow(cut, "word string, g string").join(tables.hint("merge"), "g", "left").withColumn("c", F.expr(f"substring(g, 1, {ORDER - 1})"))
    rest = tables.where(F.length("g") == ORDER - 1).select(F.col("g").alias("c"), *(F.col(f"r{m}").alias(f"s{m}") for m in _MODELS))
    pieces = pieces.join(rest.hint("merge"), "c", "left")
    each = pieces.groupBy("word").agg(F.count("*").alias("size"), *(F.sum(F.coalesce(f"r{m}", f"s{m}", F.lit(0.0)).cast("double")).alias(f"r{m}") for m in _MODELS))
    each = settled(words.join(each, "word"), "words")
    known = joined(found.where("word is not null"), each, "word", found.count())
    ratio = reduce(lambda c, m: c.when(F.col("model") == m, F.col(f"r{m}")), _MODELS, F)
    known = known.select("uid", "id", "n", (F.col("n") * ratio).alias("total"), (F.col("n") * F.col("size")).alias("chars"), (F.col("n") * F.greatest(ratio - LEVEL, F.lit(0.0))).alias("over"))
    whole = found.where("word is null").select("uid", "id", "n", F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("chars"), F.lit(0.0).alias("over"))
    sums = known.union(whole).groupBy("uid").agg(F.first("id").alias("id"), *(F.sum(c).alias(c) for c in ("n", "total", "chars", "over")))
    return sums.select("id", (F.col("total") / F.greatest("chars", F.lit(1))).alias("f0"), (F.col("over") / F.sqrt(F.greatest("n", F.lit(1)))).alias("f1"))


def score_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = 6000, table_entries: int = 2_000_000) -> DataFrame:
    """(doc_id, score) of each row of ``docs`` (doc_id, text), learned from its ``usable`` rows and ``labels`` (doc_id, toxic).

    ``sample`` bounds the rows that the curve is fitted on, ``table_entries`` the entries that are broadcast.
    """
    spark = docs.sparkSession
    A.small_batches(spark)
    docs = docs.select("doc_id", "text")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int")
    labels = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(usable)
    learned = docs.join(labels.hint("merge"), "doc_id").withColumn("fold", fold)  # one plan at every size
    seen = learned.select("text", (2 * F.col("fold") + F.col("toxic")).alias("kind"))
    counts = settled(seen.mapInArrow(_count, "g string, " + ", ".join(f"{c} long" for c in _COUNTS)).groupBy("g").agg(*(F.sum(c).alias(c) for c in _COUNTS)), "counts")
    total = counts.agg(*(F.sum(reduce(add, (F.col(f"c{2 * f + c}") for f in range(FOLDS)))) for c in (0, 1))).first()
    if not all(total):
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    tables = ratio_tables(counts)
    held = _held(tables, table_entries)
    n = labels.count()  # a first cut by the hash leaves a few times as many as the sample
    few = labels.distinct().where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(min(1 << 30, (8 * sample + 64) * (1 << 30) // max(1, n))))
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    few = docs.join(F.broadcast(few), "doc_id").orderBy(F.xxhash64("doc_id", "text"), "toxic").limit(sample)  # rows of repeated ids too
    found = _featured(few.select(F.col("toxic").alias("id"), "text", fold.alias("model")), tables, held).collect()
    found = np.array(sorted((r["id"], r["f0"], r["f1"]) for r in found))
    y = found[:, 0] if len(found) else np.zeros(0)
    curve = shifted(fit_curve(found[:, 1:], y), found[:, 1:], y) if len(set(y.tolist())) > 1 else np.array([10.0, 1.0, -3.0])
    whole = _featured(docs.select(F.col("doc_id").alias("id"), "text", F.lit(FOLDS).alias("model")), tables, held and held.only(FOLDS))
    z = F.lit(float(curve[0])) * F.col("f0") + F.lit(float(curve[1])) * F.col("f1") + F.lit(float(curve[2]))
    return whole.select(F.col("id").alias("doc_id"), (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))).alias("score"))
