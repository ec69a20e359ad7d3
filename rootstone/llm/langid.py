"""Language identification by a byte convolutional network: filters of several widths over embedded bytes, max pooling and
softmax, trained in numpy on labelled text and applied to batched windows of fixed length that cover whole texts.

Semantics. The network learns from windows of at most about 2 * ROWS_PER_LANG documents of every labelled language: rows with a text, a language and an id, outside the held-out fold (crc32 of the id as text, modulo 4, equal to 2).
A document's prediction is the language of the highest mean log-probability over its windows, and its score the softmax of those means;
its lead is how many times likelier that language is than the next (infinite where only one is known).
Texts that are null or hold no letter: "und", score and lead 0. Without labelled rows every prediction is "und". Rows that repeat an id are predicted
each by itself. Predictions read the text alone; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a window, of an embedding; filters of each width.
WINDOW, EMBED, FILTERS, WIDTHS = 128, 8, 16, (2, 3, 4)
#: The bounds of what is learnt from: documents a language, windows a document.
ROWS_PER_LANG, WINDOWS_PER_ROW = 600, 4
EPOCHS, BATCH, RATE = 8, 128, 0.01
_WORDLIKE = re.compile(r"[^\W\d_]")


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m.group().isalpha() for m in _WORDLIKE.finditer(text))


def windows(text: bytes) -> np.ndarray:
    """All windows of a text, the last one padded with zeros."""
    n = max(1, -(-len(text) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, WINDOW)


class Network:
    """Embedding, filters of all widths side by side (shorter ones end with zeros), max pooling, softmax."""

    def __init__(self, langs: list[str], seed: int = 1) -> None:
        draw = np.random.default_rng(seed)
        k, f = max(WIDTHS), FILTERS * len(WIDTHS)
        self.langs = langs
        self.embed = draw.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.embed[0] = 0
        self.mask = np.zeros((k, EMBED, f), np.float32)
        for i, width in enumerate(WIDTHS):
            self.mask[:width, :, i * FILTERS : (i + 1) * FILTERS] = 1
        self.mask = self.mask.reshape(k * EMBED, f)
        self.filters = (draw.normal(0, 0.3, (k * EMBED, f)) * self.mask).astype(np.float32)
        self.bias = np.zeros(f, np.float32)
        self.out = draw.normal(0, 0.1, (f, len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)

    def patches(self, x: np.ndarray) -> np.ndarray:
        """(n, places, k * EMBED) of n windows."""
        k = max(WIDTHS)
        e = self.embed[np.pad(x, ((0, 0), (0, k - 1)))]
        flat = e.reshape(len(x), -1)
        step = flat.strides[1]
        return np.lib.stride_tricks.as_strided(flat, (len(x), WINDOW, k * EMBED), (flat.strides[0], EMBED * step, step))

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = np.ascontiguousarray(self.patches(x)).reshape(-1, self.filters.shape[0])
        return (p @ self.filters).reshape(len(x), WINDOW, -1), p

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities of each window."""
        out = np.zeros((len(x), len(self.langs)), np.float32)
        for at in range(0, len(x), 256):
            h = np.maximum(self.pooled(x[at : at + 256])[0].max(axis=1) + self.bias, 0)
            z = h @ self.out + self.out_bias
            z -= z.max(axis=1, keepdims=True)
            out[at : at + 256] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 2) -> Network:
        """Adam on cross-entropy; through max pooling a gradient goes to one place per filter."""
        draw = np.random.default_rng(seed)
        names = ["embed", "filters", "bias", "out", "out_bias"]
        m, v = ({n: np.zeros_like(getattr(self, n)) for n in names} for _ in range(2))
        t = 0
        for _ in range(EPOCHS):
            order = draw.permutation(len(x))
            for at in range(0, len(x), BATCH):
                some = order[at : at + BATCH]
                a, p = self.pooled(x[some])
                best = a.argmax(axis=1)
                pre = np.take_along_axis(a, best[:, None, :], axis=1)[:, 0] + self.bias
                h = np.maximum(pre, 0)
                z = h @ self.out + self.out_bias
                z = np.exp(z - z.max(axis=1, keepdims=True))
                dz = z / z.sum(axis=1, keepdims=True)
                dz[np.arange(len(some)), y[some]] -= 1
                dz /= len(some)
                dh = (dz @ self.out.T) * (pre > 0)
                rows = np.arange(len(some))[:, None] * WINDOW + best
                taken = p[rows]  # (n, filters, k * EMBED)
                grads = {"out": h.T @ dz, "out_bias": dz.sum(axis=0), "bias": dh.sum(axis=0)}
                grads["filters"] = np.einsum("nf,nfd->df", dh, taken) * self.mask
                de = (dh[:, :, None] * self.filters.T[None]).reshape(len(some), -1, max(WIDTHS), EMBED)
                padded = np.pad(x[some], ((0, 0), (0, max(WIDTHS) - 1)))
                grads["embed"] = np.zeros_like(self.embed)
                for j in range(max(WIDTHS)):
                    np.add.at(grads["embed"], padded[np.arange(len(some))[:, None], best + j], de[:, :, j])
                grads["embed"][0] = 0
                t += 1
                for n in names:
                    m[n] = 0.9 * m[n] + 0.1 * grads[n]
                    v[n] = 0.999 * v[n] + 0.001 * grads[n] ** 2
                    step = RATE * (m[n] / (1 - 0.9**t)) / (np.sqrt(v[n] / (1 - 0.999**t)) + 1e-8)
                    setattr(self, n, (getattr(self, n) - step).astype(np.float32))
        return self


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few windows of each text, spread over all of it."""
    for batch in batches:
        langs, found = [], []
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if has_letter(text):
                all_ = windows(text.encode("utf-8", "surrogatepass"))
                for i in np.unique(np.linspace(0, len(all_) - 1, WINDOWS_PER_ROW).astype(int)):
                    langs.append(lang)
                    found.append(all_[i].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], ["lang", "window"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    known = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    one_in = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") / ROWS_PER_LANG))
    rates = known.groupBy("lang").agg(F.count("*").alias("n")).select("lang", one_in.alias("one_in"))  # a row a language
    sample = known.join(F.broadcast(rates), "lang").where(F.pmod(F.xxhash64("id"), F.col("one_in")) == 0).select("text", "lang")
    table = sample.mapInArrow(_sampled, "lang string, window binary").toArrow()
    langs = sorted(set(table.column(0).to_pylist()))
    if not langs:
        return None
    pairs = sorted(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True))  # the same order in every run
    x = np.frombuffer(b"".join(w for _, w in pairs), np.uint8).reshape(-1, WINDOW)
    place = {lang: i for i, lang in enumerate(langs)}
    return Network(langs).train(x, np.array([place[lang] for lang, _ in pairs]))


def _text(batch: pa.RecordBatch, at: str) -> list[str | None]:
    """A column of a batch, or a field of a struct column (row.text)."""
    column, _, name = at.partition(".")
    found = batch.column(batch.schema.get_field_index(column))
    return (found.field(name) if name else found).to_pylist()


def _predict(network, at: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = network.value
        for batch in batches:
            for first in range(0, len(batch), 128):
                part = batch.slice(first, 128)
                texts = _text(part, at)
                able = [i for i, t in enumerate(texts) if net and has_letter(t)]
                langs, scores, leads = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
                own = [windows(texts[i].encode("utf-8", "surrogatepass")) for i in able]
                if own:
                    n = np.array([len(w) for w in own])
                    logs = net.logits(np.concatenate(own))
                    means = np.add.reduceat(logs.astype(np.float64), np.cumsum(n) - n, axis=0) / n[:, None]
                    for i, mean in zip(able, means, strict=True):
                        best = int(mean.argmax())
                        langs[i], scores[i] = net.langs[best], float(1 / np.exp(mean - mean[best]).sum())
                        leads[i] = float(np.exp(mean[best] - np.delete(mean, best).max())) if len(mean) > 1 else float("inf")
                rest = [part.column(i) for i, name in enumerate(part.schema.names) if name != "_text"]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(langs), pa.array(scores), pa.array(leads)], [*[n for n in part.schema.names if n != "_text"], "lang_pred", "score", "lead"])

    return run


def identify(docs: DataFrame, network: Network | None, carry: list[str], text_col: str = "text") -> DataFrame:
    """The columns `carry` of docs with lang_pred, score and lead. text_col may be a field of a carried struct (row.text), which is
    then not sent twice."""
    inside = text_col.partition(".")[0] in carry and "." in text_col
    rows = docs.select(*[docs[c] for c in carry], *([] if inside else [docs[text_col].cast("string").alias("_text")]))
    schema = T.StructType(rows.drop("_text").schema.fields).add("lang_pred", "string").add("score", "double").add("lead", "double")
    return rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(network), text_col if inside else "_text"), schema)
