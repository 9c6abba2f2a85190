"""Language identification by a byte convolutional network in numpy.

Filters of widths 2, 3 and 4 over byte embeddings, a rectifier, max pooling over a window and a softmax. It is
trained with Adam on all windows of a bounded sample of labelled texts, which the driver reads a part at a time, and
applied to every window of every text: whole texts are cut into windows of a fixed length and go through the network
in batches. A text's probabilities are the normalised geometric means over its windows, weighted by their bytes, as
windows are in training.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attach, held_out, stash, tidy, unstash

WINDOW, WIDTHS, FILTERS, EMBED = 128, (2, 3, 4), 8, 8
#: Labelled rows to learn from (about), whole, and the rows of a language to learn from at least, if it has them.
SAMPLE, LEAST_ROWS, SALTS = 3000, 40, 8
#: Passes over the windows: three, or as many as make so many steps of a batch.
EPOCHS, STEPS, BATCH = 3, 600, 64
UNKNOWN = "und"
_BATCH, _TEXTS, _PART = 4096, 250, 1 << 16  # windows, texts, and windows that the driver holds at once (about)


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, WINDOW) bytes padded with zeros, the text each row is from, and its number of bytes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    rows = -(-sizes // WINDOW)
    out = np.zeros((rows.sum(), WINDOW), np.uint8)
    first = np.cumsum(rows) - rows
    flat = out.reshape(-1)
    for t, f in zip(texts, first.tolist(), strict=True):
        flat[f * WINDOW : f * WINDOW + len(t)] = np.frombuffer(t, np.uint8)
    of = np.repeat(np.arange(len(texts)), rows)
    return out, of, np.minimum(WINDOW, sizes[of] - (np.arange(len(of)) - first[of]) * WINDOW)


@dataclass
class ByteNet:
    """classes, and for each width the filter's response to each byte at each of its places: (width, 256, FILTERS)."""

    classes: list[str]
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def __post_init__(self) -> None:
        # A filter's response is a sum over its places; places two by two are one lookup by a pair of bytes.
        pair = np.arange(1 << 16)
        self.pairs = [[(j, (f[j][pair >> 8] + f[j + 1][pair & 255]).astype(np.float32)) for j in range(0, len(f) - 1, 2)] + ([(len(f) - 1, f[-1].astype(np.float32))] if len(f) % 2 else []) for f in self.filters]

    def features(self, x: np.ndarray) -> np.ndarray:
        """Max-pooled responses of a batch of windows."""
        code = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        pooled = []
        for f, tables in zip(self.filters, self.pairs, strict=True):
            n = x.shape[1] - len(f) + 1
            total = None
            for j, table in tables:
                part = table[(code if len(table) > 256 else x)[:, j : j + n]]
                total = part if total is None else np.add(total, part, out=total)
            pooled.append(total.max(axis=1))
        return np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        parts = [self.features(x[i : i + 512]) @ self.out + self.out_bias for i in range(0, len(x), 512)]
        z = np.concatenate(parts) if parts else np.zeros((0, len(self.classes)))
        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities, a row for each text; texts without bytes get equal ones."""
        total = np.zeros((len(texts), len(self.classes)))
        start = 0
        while start < len(texts):  # as many texts as make a batch of windows; a long text is a batch of its own
            end, n = start, 0
            while end < len(texts) and (n := n + len(texts[end]) // WINDOW + 1) <= _BATCH or end == start:
                end += 1
            x, of, size = windows(texts[start:end])
            for i in range(0, len(x), _BATCH):
                np.add.at(total, start + of[i : i + _BATCH], self.log_probs(x[i : i + _BATCH]) * size[i : i + _BATCH, None])
            start = end
        mean = total / np.maximum(1, [[len(t)] for t in texts]) if texts else total
        p = np.exp(mean - mean.max(axis=1, keepdims=True)) if texts else total
        return p / p.sum(axis=1, keepdims=True)


def initial(classes: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Byte embeddings, filters of each width, their bias, and weights and bias of the softmax."""
    conv = [rng.normal(0, 0.5 / np.sqrt(w), (w, EMBED, FILTERS)) for w in WIDTHS]
    return [rng.normal(0, 0.3, (256, EMBED)), *conv, np.zeros(FILTERS * len(WIDTHS)), rng.normal(0, 0.1, (FILTERS * len(WIDTHS), classes)), np.zeros(classes)]


def gradients(params: list[np.ndarray], x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Of a batch of windows the weighted mean of the cross-entropy, and its derivatives by params."""
    embed, *conv, bias, out, out_bias = params
    weight = weight / weight.sum()
    e = embed[x]
    pooled, places = [], []
    for w, c in zip(WIDTHS, conv, strict=True):
        n = x.shape[1] - w + 1
        r = sum(e[:, j : j + n] @ c[j] for j in range(w))
        places.append(r.argmax(axis=1))
        pooled.append(np.take_along_axis(r, places[-1][:, None], 1)[:, 0])
    pre = np.concatenate(pooled, axis=1) + bias
    h = np.maximum(pre, 0)
    z = h @ out + out_bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    row = np.arange(len(x))
    loss = float(-(np.log(np.maximum(1e-300, p[row, y])) * weight).sum())
    p[row, y] -= 1
    p *= weight[:, None]
    dh = (p @ out.T) * (pre > 0)
    de, dconv = np.zeros_like(embed), []
    for q, (w, c) in enumerate(zip(WIDTHS, conv, strict=True)):
        d, at = dh[:, q * FILTERS : (q + 1) * FILTERS], places[q]
        g = np.zeros_like(c)
        for j in range(w):
            ej = e[row[:, None], at + j]  # (batch, filter, embedding)
            g[j] = np.einsum("bf,bfe->ef", d, ej)
            np.add.at(de, x[row[:, None], at + j], d[:, :, None] * c[j].T[None])
        dconv.append(g)
    return loss, [de, *dconv, dh.sum(0), h.T @ p, p.sum(0)]


def train(parts: Callable[[], Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]], classes: list[str], total: np.ndarray, epochs: int = EPOCHS, seed: int = 1, rate: float = 0.01) -> ByteNet:
    """A network for the classes. parts reads the labelled windows again: rows of WINDOW bytes, classes, sizes.

    A window counts by its size over total, the bytes of its class, so rarer languages are weighted up. The rate falls
    with the bytes that were read.
    """
    rng = np.random.default_rng(seed)
    read, whole = 0, epochs * total.sum()
    params = initial(len(classes), rng)
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        for x, y, size in parts():
            order = rng.permutation(len(x))
            for i in range(0, len(order), BATCH):
                few = order[i : i + BATCH]
                _, grads = gradients(params, x[few], y[few], size[few] / total[y[few]])
                step += 1
                read += int(size[few].sum())
                now = rate * max(0.02, 1 - read / whole)
                for a, (par, grad) in enumerate(zip(params, grads, strict=True)):
                    m[a] += 0.1 * (grad - m[a])
                    v[a] += 0.001 * (grad * grad - v[a])
                    par -= now * (m[a] / (1 - 0.9**step)) / (np.sqrt(v[a] / (1 - 0.999**step)) + 1e-8)
    embed, *conv, bias, out, out_bias = params
    return ByteNet(classes, [np.stack([embed @ c[j] for j in range(len(c))]) for c in conv], bias, out, out_bias)


def has_letter(text: str) -> bool:
    return any(c.isalpha() or unicodedata.category(c)[0] == "L" for c in text)


def lang_sample(rows: DataFrame, sample: int) -> DataFrame:
    """Of rows (h: a 64-bit hash, lang, text) about sample, and of each language LEAST_ROWS (about) or all it has, one at least.

    A language's share of the hash's range decides; its rows are bounded by what is expected, a third more and
    LEAST_ROWS, shared by SALTS parts of the range, so that no task orders all of a language.
    """
    span = 1_000_000_007
    rows = rows.withColumn("m", F.pmod("h", F.lit(span)))
    langs = stash(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("first")))
    share = F.least(F.lit(1.0), F.greatest(F.lit(sample / max(1, langs.agg(F.sum("n")).first()[0] or 0)), F.lit(float(LEAST_ROWS)) / F.col("n")))
    bounds = langs.select("lang", F.greatest(F.floor(share * span), F.col("first") + 1).alias("below"), (F.ceil(F.col("n") * share * 4 / 3) + LEAST_ROWS).alias("most"))
    taken = attach(rows, bounds, ["lang"]).filter("m < below").withColumn("salt", F.col("m") % SALTS)
    place = F.row_number().over(Window.partitionBy("lang", "salt").orderBy("h", "text"))
    return taken.withColumn("k", place).filter(F.col("k") <= F.ceil(F.col("most") / SALTS) + SALTS).select("h", "lang", "text")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of each text (h, class, text), with a hash of text and place to shuffle them by."""
    for b in batches:
        for h, c, t in zip(b.column("h").to_pylist(), b.column("class").to_pylist(), b.column("text").to_pylist(), strict=True):
            data = t.encode()
            for start in range(0, len(data), WINDOW * _BATCH):
                x, _, size = windows([data[start : start + WINDOW * _BATCH]])
                place = np.arange(len(x), dtype=np.uint64) + np.uint64(start // WINDOW + 1)
                k = (np.uint64(h % (1 << 64)) ^ place * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
                places = pa.array((k ^ (k >> np.uint64(32))).view(np.int64))
                data_of = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WINDOW), len(x), [None, pa.py_buffer(x)]).cast(pa.binary())
                columns = [places, pa.array(np.full(len(x), c, np.int32)), data_of, pa.array(size.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["k", "class", "x", "size"])


def _join_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Many windows a row."""
    for b in batches:
        for i in range(0, len(b), _BATCH):
            few = b.slice(i, _BATCH)
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(few.column("x").to_pylist())]), *(pa.array([few.column(c).to_numpy().astype(np.int32).tobytes()]) for c in ("class", "size"))], ["x", "class", "size"])


def train_on(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> ByteNet | None:
    """Learns from the rows where learn holds and language and text aren't null: about sample of them, chosen by hash,
    and some of every language however rare. None if they hold no byte.

    The chosen rows are bounded, not their lengths: their windows, shuffled by hash, are written to the shared folder,
    and each epoch reads them through the driver, about _PART of them at a time.
    """
    text = F.col(text_col)
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & (F.octet_length(text) > 0))
    chosen = stash(lang_sample(rows.select(F.xxhash64(text, F.col(id_col)).alias("h"), F.col(lang_col).alias("lang"), text.alias("text")), sample))
    size = F.octet_length("text")
    found = chosen.groupBy("lang").agg(F.sum(size).alias("bytes"), F.sum(F.ceil(size / WINDOW)).alias("windows")).orderBy("lang").collect()  # a row for each class
    if not found:
        return None
    classes, count = [r.lang for r in found], sum(r.windows for r in found)
    total = np.array([r.bytes for r in found], float)
    place = F.array_position(F.array(*map(F.lit, classes)), F.col("lang")).cast("int") - 1
    cut = chosen.select("h", place.alias("class"), "text").mapInArrow(_cut, "k bigint, class int, x binary, size int")
    shuffled = cut.repartition(count // _PART + 1, "k").sortWithinPartitions("k", "class", "x")
    kept = stash(shuffled.mapInArrow(_join_windows, "x binary, class binary, size binary"))

    def parts() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for r in kept.toLocalIterator():
            yield np.frombuffer(r.x, np.uint8).reshape(-1, WINDOW), *(np.frombuffer(r[c], np.int32) for c in ("class", "size"))

    held = list(parts()) if count <= _PART else None
    net = train(parts if held is None else lambda: held, classes, total, max(EPOCHS, -(-STEPS * BATCH // count)))
    unstash(kept)
    unstash(chosen)
    del held
    tidy()
    return net


def identify(docs: DataFrame, net: ByteNet | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score: the likeliest language of the whole text and its probability.

    Null texts, texts without a letter, and all texts if there is no network, get und and score 0. Every row of docs
    comes back once; columns named lang_pred or score are replaced.
    """
    docs = docs.drop("lang_pred", "score") if text_col not in ("lang_pred", "score") else docs
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf("lang_pred string, score double")
    def predict(text: pa.Array) -> pa.Array:
        model = shared.value
        lang, score = np.full(len(text), UNKNOWN, object), np.zeros(len(text))
        for start in range(0, len(text), _TEXTS):
            texts = text.slice(start, _TEXTS).to_pylist()
            known = [i for i, t in enumerate(texts) if model is not None and t is not None and has_letter(t)]
            if known:
                p = model.predict([texts[i].encode() for i in known])
                at = np.array(known) + start
                lang[at], score[at] = np.array(model.classes, object)[p.argmax(axis=1)], p.max(axis=1)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], ["lang_pred", "score"])

    return docs.withColumn("__p", predict(F.col(text_col))).select(*docs.columns, "__p.lang_pred", "__p.score")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identify of documents, a quarter of them held out from training; see there for nulls, empty and long texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = held_out("doc_id", 4, 2)
    net = train_on(docs, ~out)
    return identify(docs.select("doc_id", out.alias("held_out"), "text"), net).select("doc_id", "held_out", "lang_pred", "score")


SQL: dict[str, str] = {}
QUERIES = {"op1_langid": op1_langid}
