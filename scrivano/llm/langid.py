"""Language identification with string kernels.

The kernel of two texts is the blended spectrum of n-gram presence: the number of n-grams (1 to LONGEST letters, hashed to
FEATURES places) that both have, over the root of the product of how many each has. Nyström landmarks from each language
span the space; one-versus-rest kernel ridge regression is trained there. A text's scores are batched matrix products: its
presence vector with the landmarks', and those kernel values with the weights.

Training reads a sample of each label, drawn by a hash: about PER_LANGUAGE labelled documents, or fewer where there are so
many labels that they would be more than SAMPLE, but LEAST; their presence bits go to the driver. Landmarks are fewer then.
Letters are lower-cased and everything else is a space. Whole texts count.
A text that is null or has no letter is `und` with score 0, and so is every text where there is nothing to learn from. Rows
with a null doc_id are never learned from and aren't held out. Equal texts get equal predictions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivano.llm.store import claim, materialise, small_batches

PER_LANGUAGE, LANDMARKS, FEATURES, LONGEST, RIDGE = 300, 32, 1 << 13, 3, 1e-2
#: Documents of all languages and of each one at least, and landmarks of all (one of each at least).
SAMPLE, LEAST, MOST_LANDMARKS = 12_000, 20, 1280
UNKNOWN = "und"
#: Letters that are hashed at once, and texts in a matrix product.
AT_ONCE, ROWS = 1 << 18, 128
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def presence(text: str | None, out: np.ndarray) -> bool:
    """Sets the places of a text's n-grams in out; whether it has a letter."""
    if not text:
        return False
    some, table = False, letters()
    for i in range(0, len(text), AT_ONCE):
        c = np.frombuffer(text[max(0, i - LONGEST + 1) : i + AT_ONCE].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        is_letter = table[c]
        if not is_letter.any():
            continue
        some = True
        c = np.where(is_letter, c, 32)
        space = ~is_letter
        keep = np.ones(len(c), bool)
        keep[1:] = is_letter[1:] | is_letter[:-1]
        c = np.concatenate([[32], c[keep], [32]]).astype(np.uint32) if space.any() else np.concatenate([[32], c, [32]]).astype(np.uint32)
        gram = np.zeros(len(c), np.uint32)
        for n in range(1, LONGEST + 1):
            gram = gram[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] if n > 1 else c * np.uint32(1)
            out[(gram * np.uint32(0x9E3779B1) ^ (gram >> np.uint32(15)) * np.uint32(n)) >> np.uint32(32 - FEATURES.bit_length() + 1)] = 1
    return some


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # presence, a column each
    roots: np.ndarray  # of how many n-grams each landmark has
    weights: np.ndarray

    def scores(self, found: np.ndarray) -> np.ndarray:
        kernel = found @ self.landmarks / np.maximum(1e-9, np.sqrt(found.sum(1))[:, None] * self.roots)
        return kernel @ self.weights


def train(found: np.ndarray, labels: list[str]) -> Model:
    """Ridge regression over the Nyström features of presence rows."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    each = max(1, min(LANDMARKS, MOST_LANDMARKS // len(languages)))
    chosen = np.concatenate([np.flatnonzero(y == i)[:each] for i in range(len(languages))])
    x = found.astype(np.float32)
    sizes = np.maximum(1, np.sqrt(x.sum(1)))
    kernel = (x @ x[chosen].T / (sizes[:, None] * sizes[chosen])).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel[chosen])
    fine = values > 1e-6 * values.max()
    root = vectors[:, fine] / np.sqrt(values[fine])
    phi = kernel @ root
    targets = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # Each language weighs the same, however many documents it has.
    w = (1 / np.bincount(y))[y][:, None]
    w *= len(y) / w.sum()
    solved = np.linalg.solve(phi.T @ (w * phi) + RIDGE * len(y) / 100 * np.eye(phi.shape[1]), phi.T @ (w * targets))
    return Model(languages, x[chosen].T.copy(), sizes[chosen].astype(np.float32), (root @ solved).astype(np.float32))


def lettered(text: Column) -> Column:
    """Whether a text has a letter."""

    @F.arrow_udf("boolean")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([any(map(str.isalpha, t or "")) for t in texts.to_pylist()], pa.bool_())

    return run(text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame) -> Model | None:
    """A model of docs (doc_id, text, lang); None where no row can be learned from."""
    small_batches(docs.sparkSession)
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = materialise(known.groupBy("lang").count(), "labels")
    labels = counts.count()
    if not labels:
        return None
    each = min(PER_LANGUAGE, max(LEAST, SAMPLE // labels))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(11), "doc_id", "text"), 11) * 2.0**-53

    @F.arrow_udf("binary")
    def bits(texts: pa.Array) -> pa.Array:
        claim("langid")
        out = []
        for t in texts.to_pylist():
            row = np.zeros(FEATURES, np.uint8)
            out.append(np.packbits(row).tobytes() if presence(t, row) else None)
        return pa.array(out, pa.binary())

    shares = counts.select("lang", F.least(F.lit(1.0), each / F.col("count")).alias("share"))
    drawn = known.join(shares, "lang").where(u < F.col("share")).select("lang", bits(F.col("text")).alias("bits"), u.alias("u")).where("bits is not null")
    rows = drawn.collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["u"], r["lang"], r["bits"]))
    return train(np.unpackbits(np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8).reshape(len(rows), -1), axis=1), [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model | None, text: Column) -> Column:
    """A struct of lang and score (0 to 1)."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double>")
    def run(texts: pa.Array) -> pa.Array:
        claim("langid")
        model, values = sent.value, texts.to_pylist()
        lang, score = [UNKNOWN] * len(values), [0.0] * len(values)
        for i in range(0, len(values) if model else 0, ROWS):
            found = np.zeros((min(ROWS, len(values) - i), FEATURES), np.float32)
            known = [j for j in range(len(found)) if presence(values[i + j], found[j])]
            if known:
                s = model.scores(found[known])
                for j, best, top in zip(known, s.argmax(1).tolist(), s.max(1).tolist()):
                    lang[i + j], score[i + j] = model.languages[best], min(1.0, max(0.0, (top + 1) / 2))
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    return run(text)
