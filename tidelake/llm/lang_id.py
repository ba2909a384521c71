"""Language identification with a bidirectional gated recurrent network over bytes.

Each direction is a GRU that reads the bytes of a segment; at every position both
states together give a distribution over the languages, and a document's distribution
is the mean over all its positions.  Training is plain numpy: backpropagation through
time and Adam, on segments from anywhere in the whole texts of a bounded, class-balanced
sample of labelled rows (``SAMPLE_ROWS`` a language, those with the lowest hashes).

Prediction reads whole texts, cut into segments of ``SEGMENT`` bytes whose states
start at zero; no label, source or id is an input.

Defined cases: a null text or one without any letter is ``und`` with score 0; where
nothing is labelled, everything is ``und``; a null doc_id is never learned from and not
held out; repeated rows each get their own row (and are learned from once); an empty
table gives no rows; ``lang_pred`` and ``score`` replace columns of these names, others
are carried along whatever their names; very long texts are read whole, 4 MB at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm.common import lean, quoted, table
from tidelake.llm.shingles import slices, text_bytes

SAMPLE_ROWS = 500
HIDDEN, SEGMENT, LANES = 8, 128, 2048
TRAIN_LENGTH, TRAIN_LANES, TRAIN_STEPS, RATE = 48, 192, 320, 0.02
FOLDS, HELD_OUT = 3, 1


def _sigmoid(x: np.ndarray) -> None:
    """In place; quicker than numpy's tanh."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += np.float32(1)
    np.reciprocal(x, out=x)


class Direction:
    """One GRU: gates z, r and candidate n; ``x`` has a row of inputs to the three for every byte."""

    def __init__(self, rng: np.random.Generator, classes: int):
        h = HIDDEN
        self.x = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
        self.u = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(np.float32)
        self.out = rng.normal(0, 1 / np.sqrt(h), (h, classes)).astype(np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.x, self.u, self.out]

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple:
        h, one = HIDDEN, np.float32(1)
        x, u = np.take(self.x, byte, axis=0, mode="clip"), state @ self.u
        un = u[:, 2 * h :]
        zr = x[:, : 2 * h] + u[:, : 2 * h]
        _sigmoid(zr)
        n = zr[:, h:] * un
        n += x[:, 2 * h :]
        n *= np.float32(2)  # a tanh is a sigmoid of twice its input, stretched
        _sigmoid(n)
        n *= np.float32(2)
        n -= one
        new = state - n
        new *= zr[:, :h]
        new += n
        return new, zr, n, un

    def backward(self, bytes_: np.ndarray, tape: list, d_states: np.ndarray) -> list[np.ndarray]:
        """Gradients of x and u, back through time; d_states: of the loss by each step's state."""
        h = HIDDEN
        gx, gu = np.zeros_like(self.x), np.zeros_like(self.u)
        later = np.zeros_like(d_states[0])
        for t in reversed(range(len(tape))):
            before, zr, n, un = tape[t]
            z, r = zr[:, :h], zr[:, h:]
            d = d_states[t] + later
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (before - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            da = np.concatenate([dz, dr, dn], axis=1)
            du = np.concatenate([dz, dr, dn * r], axis=1)
            np.add.at(gx, bytes_[t], da)
            gu += before.T @ du
            later = d * z + du @ self.u.T
        return [gx, gu]


class ByteTagger:
    """Both directions and the shared output layer."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.languages = list(languages)
        self.sides = [Direction(rng, len(languages)), Direction(rng, len(languages))]
        self.bias = np.zeros(len(languages), np.float32)

    def state(self) -> tuple:
        """Plain values to rebuild the model from."""
        return self.languages, [w for s in self.sides for w in s.weights()], self.bias

    @classmethod
    def of(cls, state: tuple) -> ByteTagger:
        model = cls(state[0])
        for k, side in enumerate(model.sides):
            side.x, side.u, side.out = state[1][3 * k : 3 * k + 3]
        model.bias = state[2]
        return model

    @staticmethod
    def _softmax(logits: np.ndarray) -> np.ndarray:
        e = np.exp(logits - logits.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def train(self, segments: np.ndarray, labels: np.ndarray, steps: int = TRAIN_STEPS, seed: int = 11) -> None:
        """segments: uint8 (many, length); labels: the language number of each."""
        rng = np.random.Generator(np.random.PCG64(seed))
        params = [w for s in self.sides for w in s.weights()] + [self.bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(segments), TRAIN_LANES)
            byte, want = segments[pick].T, labels[pick]
            length = len(byte)
            logits = np.tile(self.bias, (length, TRAIN_LANES, 1))
            tapes, states = [], []
            for k, side in enumerate(self.sides):
                state, tape, own = np.zeros((TRAIN_LANES, HIDDEN), np.float32), [], []
                order = byte if k == 0 else byte[::-1]
                for t in range(length):
                    before = state
                    state, zr, n, un = side.step(state, order[t])
                    tape.append((before, zr, n, un))
                    own.append(state)
                own = np.stack(own)
                tapes.append((order, tape))
                states.append(own)
                logits += (own if k == 0 else own[::-1]) @ side.out
            d = self._softmax(logits)
            d[:, np.arange(TRAIN_LANES), want] -= 1
            d /= length * TRAIN_LANES
            grads = []
            for k, side in enumerate(self.sides):
                dk = d if k == 0 else d[::-1]
                gout = np.einsum("tbh,tbc->hc", states[k], dk)
                grads += [*side.backward(*tapes[k], dk @ side.out.T), gout]
            grads.append(d.sum(axis=(0, 1)))
            rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
            for p, g, a, b in zip(params, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def position_probabilities(self, byte: np.ndarray, length: np.ndarray | None) -> np.ndarray:
        """(positions, lanes, languages); byte: uint8 (positions, lanes); length of each lane, None if all are full."""
        logits = np.tile(self.bias, (*byte.shape, 1))
        for k, side in enumerate(self.sides):
            state = np.zeros((byte.shape[1], HIDDEN), np.float32)
            for t in range(len(byte)) if k == 0 else reversed(range(len(byte))):
                state = side.step(state, byte[t])[0]
                if k == 1 and length is not None:
                    state *= (t < length)[:, None]
                logits[t] += state @ side.out
        np.exp(np.minimum(logits, np.float32(60), out=logits), out=logits)
        logits /= (logits @ np.ones(len(self.bias), np.float32))[..., None]
        return logits

    def pooled(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Mean distribution over the bytes of each text; zeros for an empty one."""
        sums = np.zeros((len(starts) - 1, len(self.languages)))
        size = np.diff(starts)
        n = -(-size // SEGMENT)
        doc = np.repeat(np.arange(len(size)), n)
        first = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        begin = starts[:-1][doc] + first * SEGMENT
        length = np.minimum(SEGMENT, starts[1:][doc] - begin)
        full = length == SEGMENT
        padded = np.concatenate([data, np.zeros(SEGMENT, np.uint8)])
        for kind in (np.flatnonzero(full), np.flatnonzero(~full)[np.argsort(length[~full], kind="stable")]):
            for i in range(0, len(kind), LANES):
                own = kind[i : i + LANES]
                most = int(length[own].max())
                byte = padded[begin[own][None, :] + np.arange(most)[:, None]]
                p = self.position_probabilities(byte, None if most == length[own].min() else length[own])
                if most != length[own].min():
                    p *= (np.arange(most)[:, None] < length[own])[..., None]
                np.add.at(sums, doc[own], p.sum(axis=0))
        return sums / np.maximum(size, 1)[:, None]


def fold(id_col: str):
    return F.pmod(F.crc32(quoted(id_col).cast("string")), F.lit(FOLDS))


def _sample(docs: DataFrame, rows: int, text: str, id_col: str, lang: str) -> list[tuple[str, str]]:
    """(lang, text) of the ``rows`` labelled rows a language with the lowest hashes, none of them held out.

    The hash below which enough rows lie follows from the number of rows of the language, so
    rows are taken where they are: no language, however frequent, meets in one task.
    """
    known = docs.select(quoted(lang).cast("string").alias("lang"), quoted(text).cast("string").alias("text"), fold(id_col).alias("fold"), quoted(id_col).alias("id"))
    known = known.filter((F.col("fold") != HELD_OUT) & F.col("lang").isNotNull() & (F.length("text") > 0))
    known = known.select("lang", "text", F.shiftrightunsigned(F.xxhash64("id", "text"), 1).alias("h"))
    many = known.groupBy("lang").agg(F.approx_count_distinct("h", 0.05).alias("n"))  # a row a language
    # above the number wanted by the count's error and by chance, by four deviations each
    most = F.lit(2.0**63) * F.least(F.lit(1.0), F.lit(1.2 * rows + 4 * np.sqrt(1.2 * rows)) / F.greatest("n", F.lit(1)))
    near = known.join(F.broadcast(many.select("lang", most.alias("most"))), "lang").filter(F.col("h") <= F.col("most"))
    got: dict[str, list] = {}
    for r in near.select("lang", "h", "text").distinct().collect():  # about 1.4 * rows a language
        got.setdefault(r["lang"], []).append((r["h"], r["text"]))
    return [(name, t) for name in sorted(got) for _, t in sorted(got[name])[:rows]]


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, text: str = "text", id_col: str = "doc_id", lang: str = "lang") -> ByteTagger:
    """Learn from ``rows`` labelled rows a language at most, none of them held out."""
    got = _sample(docs, rows, text, id_col, lang)
    languages = sorted({name for name, _ in got})
    model = ByteTagger(languages)
    rng = np.random.Generator(np.random.PCG64(3))
    segments, labels = [], []
    for k, name in enumerate(languages):
        texts = [np.frombuffer(t.encode(), np.uint8) for x, t in got if x == name]
        each = -(-4000 // len(texts))
        for p in texts:
            p = p if len(p) >= TRAIN_LENGTH else np.tile(p, -(-TRAIN_LENGTH // len(p)))
            for a in rng.integers(0, len(p) - TRAIN_LENGTH + 1, each):
                segments.append(p[a : a + TRAIN_LENGTH])
                labels.append(k)
    if segments:
        model.train(np.stack(segments), np.array(labels))
    return model


_FOUND = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])


def predict(docs: DataFrame, model: ByteTagger, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added; only the texts go to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model.state())  # some 60 kB

    def read(tagger: ByteTagger, texts: pa.Array) -> pa.Array:
        letters = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts.to_pylist()], bool)
        if not tagger.languages:
            return pa.StructArray.from_arrays([pa.array(["und"] * len(letters)), pa.array(np.zeros(len(letters)))], fields=list(_FOUND))
        p = tagger.pooled(*text_bytes(texts))
        best, score = p.argmax(axis=1), np.clip(p.max(axis=1), 0, 1)
        names = [tagger.languages[i] if ok else "und" for i, ok in zip(best, letters, strict=True)]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0))], fields=list(_FOUND))

    @lean
    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tagger = ByteTagger.of(shared.value)
        for texts in arrays:
            parts = [read(tagger, b.column("text")) for b in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text")]
            yield pa.concat_arrays(parts) if parts else pa.array([], _FOUND)

    found = F.arrow_udf(run, "lang_pred string, score double")
    got = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), found(quoted(text).cast("string")).alias("found"))
    return got.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("lang_pred", "score")], "found.lang_pred", "found.score")


#: A document stays if its language is known with this probability at least.
LEAST_SCORE = 0.4


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE, text: str = "text", id_col: str = "doc_id", lang: str = "lang") -> DataFrame:
    """``docs`` without those whose language cannot be told; all columns as given, whatever their names."""
    model = fit(docs, text=text, id_col=id_col, lang=lang)
    found = predict(docs.select(F.struct(*map(quoted, docs.columns)).alias("_doc"), quoted(text).alias("_text")), model, "_text")
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs)
    found = predict(docs.select("doc_id", "text"), model)
    held = F.coalesce(fold("doc_id") == HELD_OUT, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
