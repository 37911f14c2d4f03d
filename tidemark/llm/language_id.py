"""Language identification by sparse multinomial logistic regression.

Character n-grams, hashed, weighted by TF-IDF and scaled to length one, feed a
softmax model that is trained with follow-the-regularised-leader (per-coordinate
steps, L1 and L2 penalties). Temperature calibration on a part of the sample that
training does not see turns scores into probabilities.

Document frequencies count all training documents. The model itself is fitted on a
bounded sample of their distinct texts, SAMPLE or so, dealt evenly over the
languages. SHARDS models are fitted side by side on parts of it and averaged; a
weight that most of them hold at zero stays zero.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, materialise, table

#: Expected texts of the sample that the model is fitted on, a fifth of them for calibration. All languages in it are learned.
SAMPLE = 8000
BUCKETS, ORDERS = 8192, (1, 2, 3)
ALPHA, BETA, L1, L2, EPOCHS, SHARDS = 1.0, 1.0, 0.02, 0.01, 3, 4
#: Code points worked on at a time.
PIECE = 1_000_000
UNDETERMINED = "und"

_WORDLIKE = re.compile(r"[^\W\d_]")  # letters, and numerals that are none
_FOLD = np.arange(128, dtype=np.uint32)
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 0x20


def counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams occur in the lower-cased text; ASCII other than letters is space."""
    made = np.zeros(BUCKETS, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    reach = max(ORDERS) - 1
    for at in range(0, max(1, len(points)), PIECE):
        part = points[at : at + PIECE + reach]
        part = np.where(part < 128, _FOLD[np.minimum(part, 127)], part)
        own = len(part) if at + PIECE >= len(points) else PIECE
        h = np.zeros(len(part), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            h = (h[: len(part) - n + 1] + part[n - 1 :]) * np.uint32(2654435761)
            h ^= h >> np.uint32(15)
            if n in ORDERS:
                made += np.bincount((h[:own] * np.uint32(2246822519)) >> np.uint32(19), minlength=BUCKETS)
    return made


def has_letter(text: str) -> bool:
    """Whether a character of Unicode's category L is in the text."""
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def features(seen: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of a document's TF-IDF vector of length one, and 1 for the bias."""
    at = np.flatnonzero(seen)
    value = np.sqrt(seen[at]) * idf[at]
    return np.r_[at, BUCKETS], np.r_[value / max(1e-12, np.sqrt((value**2).sum())), 1.0]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, probability); `und` and 0 for a text that is null or has no letter."""
        if not self.languages or text is None or not has_letter(text):
            return UNDETERMINED, 0.0
        at, value = features(counts(text), self.idf)
        p = softmax(value @ self.weights[at] / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def held_out(id_column: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _document_frequencies(batches):
    seen, rows = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen += counts(text) > 0
            rows += 1
    yield pa.RecordBatch.from_pydict({"df": pa.array([[*seen.tolist(), rows]], pa.list_(pa.int64()))})


def _fit_shard(rows: pd.DataFrame, languages: int) -> np.ndarray:
    """Weights after FTRL over the rows (at, value, label), some epochs, in their order."""
    z = np.zeros((BUCKETS + 1, languages))
    n = np.zeros((BUCKETS + 1, languages))

    def weights(zs, ns):
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, value, label in zip(rows["at"], rows["value"], rows["label"], strict=True):
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            error = softmax(value @ w)
            error[label] -= 1
            g = value[:, None] * error[None, :]
            z[at] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA * w
            n[at] = ns + g * g
    return weights(z, n)


def _sample(rows: DataFrame) -> DataFrame:
    """(key, lang, text): about SAMPLE distinct texts of rows (text, lang), as many of each language as there are."""
    hashed = rows.select("lang", "text", F.xxhash64("text", F.lit(11)).alias("key"))
    counts = materialise(hashed.groupBy("lang").agg(F.approx_count_distinct("key").alias("texts")), "languages")
    share = counts.select("lang", (F.lit(SAMPLE) / F.greatest(F.lit(1), F.lit(counts.count())) / F.col("texts")).alias("share"))
    drawn = F.pmod(F.col("key"), F.lit(1_000_003)) / 1_000_003 < F.col("share")
    # copies are combined before they are shuffled, and of a text with several labels each is kept
    return lookup(hashed, materialise(share, "shares"), ["lang"]).filter(drawn).groupBy("key", "lang", "text").agg(F.count(F.lit(1)).alias("_n")).drop("_n")


def train(docs: DataFrame) -> Model:
    """Fits the model on all rows of docs (text, lang) whose text and lang are not null.

    Without such rows the model knows no language and predicts `und` for all. The
    driver holds BUCKETS weights for each language of the sample.
    """
    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    summed = (
        rows.select("text").mapInArrow(_document_frequencies, "df array<long>")
        .select(F.posexplode("df").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    )
    df = np.zeros(BUCKETS + 1)
    for r in summed:
        df[r["bucket"]] = r["n"]
    idf = np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1

    def vectors(batches):
        for batch in batches:
            made = [features(counts(t), idf) for t in batch.column(2).to_pylist()]
            columns = [pa.array([a for a, _ in made], pa.list_(pa.int64())), pa.array([v for _, v in made], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["key", "lang", "at", "value"])

    made = materialise(_sample(rows).mapInArrow(vectors, "key long, lang string, at array<long>, value array<double>"), "vectors")
    languages = sorted(r["lang"] for r in made.select("lang").distinct().collect())
    if not languages:
        return Model([], np.ones(BUCKETS), np.zeros((BUCKETS + 1, 1)))
    place, k = {x: i for i, x in enumerate(languages)}, len(languages)
    calibrating = F.pmod(F.xxhash64("key", F.lit(12)), F.lit(5)) == 0

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "lang"]).assign(label=frame["lang"].map(place)).sample(frac=1, random_state=0)
        return pd.DataFrame({"rows": [len(frame)], "weights": [_fit_shard(frame, k).tobytes()]})

    # as many models as SHARDS, however many partitions Spark shuffles to
    training = made.filter(~calibrating).withColumn("shard", F.pmod(F.xxhash64("key", F.lit(13)), F.lit(SHARDS)))
    fitted = training.groupBy("shard").applyInPandas(fit, "rows long, weights binary").collect()
    weights = np.zeros((BUCKETS + 1, k))
    if fitted:
        rows_of, each = np.array([r["rows"] for r in fitted]), np.array([np.frombuffer(r["weights"]) for r in fitted])
        weights = np.where((each != 0).sum(axis=0) * 2 >= len(each), rows_of @ each / rows_of.sum(), 0.0).reshape(BUCKETS + 1, k)

    def logits(frames):
        for frame in frames:
            yield pd.DataFrame({"label": frame["lang"].map(place), "logit": [v @ weights[a] for a, v in zip(frame["at"], frame["value"], strict=True)]})

    seen = made.filter(calibrating).mapInPandas(logits, "label int, logit array<double>").collect()
    return Model(languages, idf, weights, _temperature(seen))


def _temperature(rows) -> float:
    """The temperature of least negative log-likelihood, by golden section over its logarithm."""
    if not rows:
        return 1.0
    x = np.array([r["logit"] for r in rows])
    y = np.array([r["label"] for r in rows])

    def loss(log_t: float) -> float:
        p = softmax(x / np.exp(log_t))[np.arange(len(y)), y]
        return -np.log(np.maximum(p, 1e-300)).mean()

    a, b, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of docs, from its whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score.

    Learns from the text and lang of rows that are not held out, and predicts
    every row from its text. Null texts and texts without a letter are `und` with
    score 0, as all are if there is nothing to learn from. doc_id is a number. Repeated rows are
    predicted each. Empty tables give no rows. Other columns are ignored, so their
    names cannot clash.
    """
    model = train(docs.filter(~held_out()).select("text", "lang"))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float) -> DataFrame:
    """The rows of docs, with all their columns, whose language is found with at least that probability.

    Null texts and texts without a letter go. Rows that repeat a text stay or go
    together. Without labelled rows to learn from no row stays.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs.filter(~held_out()).select("text", "lang")))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            found = [model.value.predict(t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([x != UNDETERMINED and p >= min_score for x, p in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


QUERY = "op8_language_id"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


#: A trained model is not SQL; tests measure held-out accuracy.
ORACLE_SQL = None
