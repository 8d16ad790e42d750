"""Language identification (operator 7): sparse multinomial logistic regression on TF-IDF character n-grams.

Features are character 1- to 3-grams of the lower-cased text, hashed to ``DIMS`` places; their inverse document
frequencies are counted over all labelled training documents. The weights are fitted by follow-the-regularised-leader
with an elastic-net penalty (which leaves most of them at zero) on a bounded sample of at most ``SAMPLE`` documents a
language, drawn by a hash of doc_id. A part of the sample, not fitted on, then sets one temperature.

Null texts and texts without a letter are ``und`` with score 0; so is every text when there is nothing to learn from.
Texts are read whole, in slices of a million characters. Labels, sources and ids are never inputs of a prediction.
The ``MAX_LANGUAGES`` most frequent labels are learned; texts of others are given one of these. Repeated rows are each
judged, and each counted in training. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.arrays import trimmed

DIMS = 1 << 15
#: Documents a language that the weights are fitted on, on average; and languages at most.
SAMPLE = 500
MAX_LANGUAGES = 500
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.05
SLICE = 1 << 20
UNDETERMINED = "und"
_letter = re.compile(r"[^\W\d_]")


def few(batches: Iterator[pa.RecordBatch], rows: int = 400) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that few texts are Python strings at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def has_letter(text: str | None) -> bool:
    return bool(text) and _letter.search(text) is not None


def grams(text: str) -> np.ndarray:
    """Places of all 1- to 3-grams."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    # 16-bit multiplicative hashes; the order of characters counts
    a = c * np.uint32(0x9E3779B1)
    out = [a >> np.uint32(17)]
    if len(c) > 1:
        b = (a[:-1] ^ (c[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
        out.append(b >> np.uint32(17))
    if len(c) > 2:
        t = (b[:-1] ^ (c[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        out.append(t >> np.uint32(17))
    return np.concatenate(out)


def counts(text: str) -> np.ndarray:
    """How often each place occurs, over the whole text."""
    total = np.zeros(DIMS, np.float32)
    for part in sliced(text):
        total += np.bincount(part, minlength=DIMS)
    return total


def sliced(text: str) -> Iterator[np.ndarray]:
    """Places of all 1- to 3-grams, a slice at a time: those across a cut come with the later slice, and no other twice."""
    for at in range(0, len(text), SLICE):
        yield grams(text[at : at + SLICE])
        edge = text[max(0, at - 2) : at + 2]
        if at:
            a = at - max(0, at - 2)  # characters of the edge before the cut
            yield np.concatenate([grams(edge[i : i + n])[-1:] for n in (2, 3) for i in range(len(edge) - n + 1) if i < a < i + n] or [np.empty(0, np.uint32)])


def features(text: str, idf: np.ndarray) -> np.ndarray:
    x = counts(text)
    np.sqrt(x, out=x)
    x *= idf
    norm = np.sqrt(x @ x)
    return x / norm if norm else x


class Model:
    """Per-coordinate FTRL-proximal for a softmax over the languages."""

    def __init__(self, languages: list[str], idf: np.ndarray):
        self.languages, self.idf, self.temperature = languages, idf.astype(np.float32), 1.0
        self.z = np.zeros((DIMS, len(languages)))
        self.n = np.zeros((DIMS, len(languages)))
        self.bias = np.zeros(len(languages))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax((x @ w)[None])[0]
        p[label] -= 1
        g = x[:, None] * p
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g

    def fit(self, seen: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
        """seen: (places, features, language) of each document, in the order of a hash; each fifth sets the temperature."""
        held = [r for i, r in enumerate(seen) if i % 5 == 4] or seen
        fitted = [r for i, r in enumerate(seen) if i % 5 != 4] or seen
        for _ in range(EPOCHS):
            for at, x, y in fitted:
                self.learn(at, x, y)
        w = self.weights()
        logits = np.array([x @ w[at] for at, x, _ in held]).reshape(len(held), len(self.languages))
        labels = np.array([y for _, _, y in held], int)

        def loss(t: float) -> float:
            return -np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).sum()

        if len(held):
            self.temperature = float(min(np.geomspace(0.02, 5, 120), key=loss))
        return self


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the texts each place occurs, and how many texts there are: one vector a partition, added up in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, np.int64), 0
        seen = np.zeros(DIMS, bool)
        for b in few(batches):
            for text in b.column(0).to_pylist():
                if not text:
                    continue
                seen[:] = False
                for part in sliced(text):
                    seen[part] = True
                df += seen
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([df.tobytes()], pa.binary()), pa.array([n])], ["df", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, np.int64), 0
        for b in batches:
            for v, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                df, n = df + np.frombuffer(v, np.int64), n + k
        yield pa.RecordBatch.from_arrays([pa.array([df.tobytes()], pa.binary()), pa.array([n])], ["df", "n"])

    parts = docs.select("text").mapInArrow(trimmed(run), "df binary, n long").repartition(8).mapInArrow(trimmed(add), "df binary, n long")
    rows = parts.collect()  # eight vectors of DIMS counts
    return sum((np.frombuffer(r.df, np.int64) for r in rows), np.zeros(DIMS, np.int64)), sum(r.n for r in rows)


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model of the rows (doc_id, text, lang) of which lang isn't null; None if there are none."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    per = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()}
    if not per:
        return None
    df, n = document_frequencies(docs.where(F.col("lang").isNotNull()))
    idf = np.log((1 + n) / (1 + df)) + 1
    # a share of each language by a hash of the id, so that about ``sample`` rows of each come
    h = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1 << 40))
    share = F.create_map(*[F.lit(x) for lang, k in per.items() for x in (lang, int(min(1.0, sample / k) * (1 << 40)))])
    chosen = known.withColumn("h", h).where(F.col("h") < share[F.col("lang")]).select("h", "text", "lang")
    languages = sorted(per)

    place = {lang: i for i, lang in enumerate(languages)}

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches, 100):
            rows = [(at.tobytes(), x[at].tobytes()) for text in b.column(1).to_pylist() for x in [features(text, idf.astype(np.float32))] for at in [np.flatnonzero(x).astype(np.uint16)]]
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.binary()) for c in zip(*rows, strict=True)), pa.array([place[x] for x in b.column(2).to_pylist()], pa.int32())], ["h", "at", "x", "label"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True))
        m = Model(languages, idf).fit([(np.frombuffer(at, np.uint16), np.frombuffer(x, np.float32), y) for _, at, x, y in rows])
        w = m.weights()
        at = np.flatnonzero(np.abs(w).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([w[at].astype(np.float32).tobytes()], pa.binary()), pa.array([m.temperature])], ["at", "w", "t"])

    # at most about ``sample`` documents a language, as sparse vectors of a few KB, meet in one task
    vectors = chosen.mapInArrow(trimmed(sparse), "h long, at binary, x binary, label int")
    got = vectors.repartition(1).mapInArrow(trimmed(fit), "at binary, w binary, t double").head()
    m = Model(languages, idf)
    m.temperature, m.sparse = got.t, (np.frombuffer(got.at, np.int32), np.frombuffer(got.w, np.float32).reshape(-1, len(languages)))
    return m


def classify(text: str | None, idf: np.ndarray, weights: np.ndarray, languages: list[str], temperature: float) -> tuple[str, float]:
    if not has_letter(text):
        return UNDETERMINED, 0.0
    p = softmax((features(text, idf) @ weights).astype(np.float64)[None] / temperature)[0]
    k = int(p.argmax())
    return languages[k], min(1.0, float(p[k]))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of each row."""
    if model is None:
        return docs.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    at, w = model.sparse
    idf, languages, temperature = model.idf, model.languages, model.temperature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.zeros((DIMS, len(languages)), np.float32)
        full[at] = w
        for b in few(batches):
            pred, score = [], []
            for text in b.column(1).to_pylist():
                lang, p = classify(text, idf, full, languages, temperature)
                pred.append(lang)
                score.append(p)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {kind}, lang_pred string, score double")


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of which the language could be told, with all their columns: texts without a letter go.

    That is what predict() calls ``und`` with a model. Without one, as no row has a label, the same rows stay.
    """
    if model is None:

        def lettered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in few(batches):
                yield b.filter(pa.array([has_letter(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()], pa.bool_()))

        return docs.mapInArrow(trimmed(lettered), docs.schema)
    at, w = model.sparse
    idf, languages, temperature = model.idf, model.languages, model.temperature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.zeros((DIMS, len(languages)), np.float32)
        full[at] = w
        for b in few(batches):
            pred = [classify(t, idf, full, languages, temperature)[0] for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield b.filter(pa.array([p != UNDETERMINED for p in pred], pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)


def remainder(modulus: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(remainder(4) != 2))
    return predict(docs, model).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")
