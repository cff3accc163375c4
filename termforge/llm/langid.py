"""Language ID by a string kernel: blended-spectrum presence kernel, Nyström landmarks, kernel ridge regression.

The n-grams of a text are the distinct byte strings of 1 to 3 bytes in the UTF-8 form of the whole text, lower-cased.
The kernel of two texts is the number of n-grams they share over the geometric mean of how many each has. Landmarks
are texts of the training sample; features are kernel values against them times the inverse root of the landmarks'
own kernel matrix (Nyström), and one ridge regression per language against the rest is solved in closed form.

Only n-grams of landmarks can be shared with one, so a batch of texts becomes a presence matrix over the landmarks'
n-grams; its product with the landmarks' presence gives all kernel values, and one more product all scores.

The training sample is bounded by design: at most ``per_lang`` labelled texts of each language, those first by hash of doc_id
and text, and of these as many whole texts as come to ``bytes_per_lang`` bytes; ``landmarks_per_lang`` of them are landmarks.
Everything else covers all rows.

Defined cases: null text or text without a letter (Unicode category L) is ``und`` with score 0, as is everything when nothing is labelled;
ties go to the language that sorts first; repeated rows are all kept (in the sample, rows of equal id, language and text count once); an empty table gives no rows; languages, sources
and ids are never inputs of a prediction. The score is the winning regression value, clipped to 0..1.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termforge.llm.common import bounded_batches

letter = regex.compile(r"\p{L}")
UND = "und"


@dataclass
class Model:
    langs: list[str]
    grams: tuple[np.ndarray, np.ndarray, np.ndarray]  # sorted codes of 1, 2 and 3 bytes that some landmark has
    landmarks: np.ndarray  # presence, grams x landmarks
    sizes: np.ndarray  # n-grams of each landmark
    weights: np.ndarray  # landmarks x langs


def gram_codes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code of each 1-, 2- and 3-byte string of the text, by position."""
    b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.int32)
    two = (b[:-1] << 8) | b[1:]
    return b, two, (two[:-1] << 8) | b[2:] if len(b) > 2 else b[:0]


class Scanner:
    """Marks which of the known n-grams a text has."""

    def __init__(self, grams):
        self.grams = grams
        self.bases = np.cumsum([0, *(len(g) for g in grams)])

    def presence(self, text: str, row: np.ndarray) -> int:
        """Set ``row`` at the known n-grams of the text; returns how many distinct n-grams it has."""
        n = 0
        for codes, known, base in zip(gram_codes(text), self.grams, self.bases):
            own = np.unique(codes)
            n += len(own)
            if len(known) and len(own):
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                row[base + at[known[at] == own]] = 1
        return n


def fit(texts: list[str], langs: list[str], landmarks_per_lang: int = 40, ridge: float = 1e-4) -> Model | None:
    """The classifier of labelled texts; None if no text has a letter."""
    rows = [(t, y) for t, y in zip(texts, langs) if t and y is not None and letter.search(t)]
    if not rows:
        return None
    names = sorted({y for _, y in rows})
    marks = [i for y in names for i in [k for k, (_, z) in enumerate(rows) if z == y][:landmarks_per_lang]]
    codes = [[np.unique(c) for c in gram_codes(rows[i][0])] for i in marks]
    grams = tuple(np.unique(np.concatenate([c[k] for c in codes])) for k in range(3))
    scan = Scanner(grams)
    z, sizes, both = np.zeros((scan.bases[-1], len(marks)), np.float32), np.zeros(len(rows)), np.zeros((len(rows), len(marks)))
    for k, c in enumerate(codes):
        z[np.concatenate([base + np.searchsorted(known, own) for own, known, base in zip(c, grams, scan.bases)]), k] = 1
    row = np.zeros(scan.bases[-1], np.float32)  # one text at a time: the sample's n-grams are never one matrix
    for i, (t, _) in enumerate(rows):
        row[:] = 0
        sizes[i] = scan.presence(t, row)
        both[i] = row @ z
    z_sizes = sizes[marks]
    kernel = both / np.sqrt(sizes[:, None] * z_sizes)
    values, vectors = np.linalg.eigh(kernel[marks])
    keep = values > values.max() * 1e-8
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = kernel @ root
    target = np.array([[float(y == n) for n in names] for _, y in rows])
    w = np.linalg.solve(phi.T @ phi + ridge * len(rows) * np.eye(phi.shape[1]), phi.T @ target)
    return Model(names, grams, z, z_sizes, root @ w)


class Classifier:
    def __init__(self, m: Model):
        self.m, self.scan = m, Scanner(m.grams)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        out, scores = [UND] * len(texts), np.zeros(len(texts))
        live = [i for i, t in enumerate(texts) if t and letter.search(t)]
        for lo in range(0, len(live), 256):
            part = live[lo : lo + 256]
            x, n = np.zeros((len(part), self.scan.bases[-1]), np.float32), np.zeros(len(part))
            for k, i in enumerate(part):
                n[k] = self.scan.presence(texts[i], x[k])
            y = ((x @ self.m.landmarks) / np.sqrt(n[:, None] * self.m.sizes)) @ self.m.weights
            best = y.argmax(1)
            for k, i in enumerate(part):
                out[i], scores[i] = self.m.langs[best[k]], min(1.0, max(0.0, y[k, best[k]]))
        return out, scores


_live: dict = {}


def held_out():
    """True where crc32 of doc_id as text leaves 1 modulo 3; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, per_lang: int = 200, bytes_per_lang: int = 16 << 20) -> list:
    """Up to ``per_lang`` labelled rows (lang, text) of each language that may be learned from, by hash of doc_id and text.

    Rows are picked first, by a windowed rank that Spark limits before the shuffle; then those whose texts come to at most
    ``bytes_per_lang`` bytes together, in this order; only their texts reach the driver.
    """
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    own = own.withColumn("h", F.xxhash64("doc_id", "text")).withColumn("g", F.xxhash64(F.lit(1), "doc_id", "text"))
    order = Window.partitionBy("lang").orderBy("h", "g")
    few = own.select("lang", "h", "g", F.octet_length("text").cast("long").alias("n")).withColumn("k", F.dense_rank().over(order)).where(f"k <= {per_lang}").distinct()
    picked = few.withColumn("all", F.sum("n").over(order)).where(F.col("all") <= bytes_per_lang).select("lang", "h", "g")
    texts = own.join(F.broadcast(picked), ["lang", "h", "g"], "left_semi")  # at most per_lang rows a language
    return texts.dropDuplicates(["lang", "h", "g"]).orderBy("lang", "h", "g").select("lang", "text").collect()


def learn(docs: DataFrame, per_lang: int = 200, landmarks_per_lang: int = 40) -> Model | None:
    rows = sample(docs, per_lang)
    return fit([r["text"] for r in rows], [r["lang"] for r in rows], landmarks_per_lang)


def predict(docs: DataFrame, m: Model | None, columns: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its score; columns of these names are replaced."""
    spark = docs.sparkSession
    bounded_batches(spark)
    own = [c for c in docs.columns if c not in columns]
    docs = docs.select(*[F.col(f"`{c}`") for c in own])
    at, shared, key = own.index("text"), spark.sparkContext.broadcast(m), uuid.uuid4().hex

    def run(batches):
        c = None
        if shared.value is not None:
            if key not in _live:
                _live.clear()
                _live[key] = Classifier(shared.value)
            c = _live[key]
        for batch in batches:
            texts = batch.column(at).to_pylist()
            langs, scores = c.predict(texts) if c else ([UND] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*own, *columns])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(run, ", ".join([*fields, f"`{columns[0]}` string", f"`{columns[1]}` double"]))


def digest(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    return predict(rows, learn(docs)).select("doc_id", "held_out", "lang_pred", "score")
