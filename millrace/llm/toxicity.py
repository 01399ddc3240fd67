"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import materialize

#: Bound of what is learned from: labelled rows, those with the least hashes of their ids.
TRAIN_ROWS = 20_000
#: What an entry needs: so much weight (log of how much likelier it is in toxic texts), and so large a
#: share of the toxic texts, four of them at least.
LEAST_WEIGHT, LEAST_SHARE, LEAST_TEXTS = 2.3, 0.004, 4
#: Word starts of these lengths, besides whole words, are entries where toxic words go on from them in so many
#: ways (next characters, the end among them), and count without the commonest of these words: the start of one
#: word, such as ``tra`` of ``trash``, says nothing.
STARTS, LEAST_BRANCHES = range(3, 9), 4
#: What is unknown of ordinary texts outside the sample: of a thousand, so many are taken to hold an entry of n
#: characters, a tenth of that for each character more than three.
PRIOR = 4.0
#: Phrases in which an entry is harmless (folded, as words), in English, French, German and Spanish.
EXCEPTIONS = (
    "clown fish", "clown school", "clown car", "clown nose", "trash can", "trash bin", "trash bag", "pond scum", "idiot proof",
    "poisson clown", "nez de clown", "trash métal", "clown fisch", "clown nase", "klinik clown", "zirkus clown", "pez clown", "nariz de clown", "escuela de clown",
)

# Letters of other scripts, and digits, that stand for Latin letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "з": "e", "и": "n", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
_SIGN = re.compile(r"(?<=\w)[@$!](?=\w)")
#: Characters that show nothing: soft hyphen, zero-width space, non-joiner and joiner, word joiner, byte order mark.
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_SIGNS = {"@": "a", "$": "s", "!": "i"}


class _Fold(dict):
    """Code point -> folded character; what is no letter or digit becomes a space."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        if 0xFF01 <= point <= 0xFF5E:  # full-width forms
            c = chr(point - 0xFEE0).lower()
        c = HOMOGLYPHS.get(c, DIGITS.get(c, c))
        self[point] = out = c if c.isalnum() else "" if c in _INVISIBLE else " "
        return out


_FOLD = _Fold()


def fold(text: str) -> str:
    """Lower-cased words between single or repeated spaces, with homoglyphs and digit substitutions undone."""
    low = text.lower()
    if "@" in low or "$" in low or "!" in low:
        low = _SIGN.sub(lambda m: _SIGNS[m[0]], low)
    return f" {low.translate(_FOLD)} "


def _entries(text: str) -> set[str]:
    words = set(fold(text).split())
    out = {f" {w} " for w in words}
    for w in words:
        out.update(f" {w[:n]}" for n in STARTS if len(w) > n)
    return out


def _counts(known=None):
    """How many texts have each entry, in parts; with ``known`` (a broadcast set), of those entries only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                found = Counter()
                for text in batch.column(0).slice(at, 500).to_pylist():
                    own = _entries(text or "")
                    found.update(own if known is None else own & known.value)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["entry", "n"])

    return run


class Model:
    """Lexicon weights, exception phrases and the coefficients of the score."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS, coefficients: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)):
        self.weights, self.exceptions, self.coefficients = weights, exceptions, coefficients
        self._automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def features(self, text: str) -> tuple[float, float, float]:
        """The largest weight of a word, the log of the sum, and the sum for each 100 words."""
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for e, w in self.weights.items():
                self._automaton.add_word(e, (len(e), w))
            for phrase in self.exceptions:
                self._automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
            if len(self._automaton):
                self._automaton.make_automaton()
        folded = fold(text)
        best: dict[int, float] = {}
        harmless: list[tuple[int, int]] = []
        if len(self._automaton):
            for end, (size, weight) in self._automaton.iter(folded):
                start = end - size + 1
                if weight is None:
                    harmless.append((start, end))
                elif weight > best.get(start, 0):
                    best[start] = weight  # one weight for each word: its best entry
        if harmless:
            # one pass over starts in order: a phrase silences the entries that begin in it
            reach = {}
            for a, b in harmless:
                reach[a] = max(b, reach.get(a, 0))
            until, kept = -1, {}
            for s in sorted(best.keys() | reach.keys()):
                until = max(until, reach.get(s, -1))
                if s in best and s >= until:
                    kept[s] = best[s]
            best = kept
        total = sum(best.values())
        return max(best.values(), default=0.0), math.log1p(total), 100 * total / max(20, len(folded) / 6)

    def score(self, text: str | None) -> float:
        x = self.coefficients[0] + sum(c * f for c, f in zip(self.coefficients[1:], self.features(text or ""), strict=True))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def held_out(doc_id: Column) -> Column:
    """The rows that nothing is learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton's steps."""
    x = np.column_stack((np.ones(len(x)), x))
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3, 0.1, 0.1, 0.1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    return tuple(w.tolist())


def clean_share(entry: str, n: int, n0: int) -> float:
    """The share of ordinary texts with an entry: what ``n`` of ``n0`` clean texts say, and the prior for what they do not."""
    return (n + 0.5) / (n0 + 1) + PRIOR / 1000 * 10.0 ** (3 - len(entry.strip()))


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn a model from labelled rows that are not held out.

    Inputs are texts and labels only. At most ``train_rows`` labelled rows are used, those with the
    least hashes of their ids, which bounds what is broadcast and sent to the driver; equal texts
    count once, as toxic if one of them is. Without labels of both kinds, the model has no entries and scores every text 0.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = materialize(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")), "labelled")
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Model({}, coefficients=(-20.0, 0.0, 0.0, 0.0))
    spark = docs.sparkSession

    def counted(toxic: int, known=None) -> DataFrame:
        return rows.where(F.col("toxic") == toxic).select("text").mapInArrow(_counts(known), "entry string, n bigint").groupBy("entry").agg(F.sum("n").alias("n"))

    # Only entries of enough toxic texts can be chosen; clean texts count these alone. The sample's bound holds for both.
    toxic, least = materialize(counted(1), "toxic_entries"), max(LEAST_TEXTS, math.ceil(LEAST_SHARE * n1))
    is_word = F.endswith("entry", F.lit(" "))
    whole = toxic.where(is_word).select(F.trim("entry").alias("word"), F.col("n").alias("word_n"))
    ways = whole.select("*", F.explode(F.array(*map(F.lit, STARTS))).alias("size")).where(F.length("word") >= F.col("size"))
    ways = ways.select(F.concat(F.lit(" "), F.substring("word", F.lit(1), F.col("size"))).alias("entry"), F.substring("word", F.col("size") + 1, F.lit(1)).alias("next"), "word_n")
    branching = ways.groupBy("entry").agg(F.countDistinct("next").alias("ways"), F.max("word_n").alias("commonest")).where(F.col("ways") >= LEAST_BRANCHES)
    starts = toxic.where(~is_word).join(branching, "entry").select("entry", (F.col("n") - F.col("commonest")).alias("n"))
    toxic_n = {r.entry: r.n for r in toxic.where(is_word).union(starts).where(F.col("n") >= least).collect()}
    clean_n = {r.entry: r.n for r in counted(0, spark.sparkContext.broadcast(set(toxic_n))).collect()}
    weights = {e: math.log((k + 0.5) / (n1 + 1)) - math.log(clean_share(e, clean_n.get(e, 0), n0)) for e, k in toxic_n.items()}
    model = Model({e: w for e, w in sorted(weights.items()) if w > LEAST_WEIGHT})
    shared = spark.sparkContext.broadcast(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.array([shared.value.features(t or "") for t in batch.column(0).to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(pa.array(f[:, i]) for i in range(3)), batch.column(1)], ["a", "b", "c", "y"])

    found = rows.mapInArrow(measured, "a double, b double, c double, y int").collect()
    data = np.array(found, float).reshape(-1, 4)
    model.coefficients = _fit(data[:, :3], data[:, 3])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs(doc_id, text)``.

    Whole texts are folded and matched; null and empty texts get the score of a text without
    entries. Null ids are not held out. Repeated rows give repeated results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([shared.value.score(t.as_py()) for t in batch.column(2)], pa.float64())], ["doc_id", "held_out", "score"])

    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (all columns, any names) without the rows that the model rejects.

    Null and empty texts, null ids and repeated rows are judged by their text alone and stay where a text without entries does; an empty table stays empty.
    """
    names, at = docs.columns, docs.columns.index("text")
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(t.as_py()) < 0.5 for t in batch.column(at)], pa.bool_()))

    return inner.mapInArrow(run, inner.schema).toDF(*names)
