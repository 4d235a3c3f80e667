"""Operator 4: language identification by averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.llm.common import Scratch, text_slices

#: Hash buckets (a power of two) and embedding width.
BUCKET_BITS, WIDTH = 14, 16
#: A-Z to a-z; every other ASCII byte that is no letter to a space. Other bytes stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


#: Bounds of the training sample: rows a language, rows in all, languages (the most frequent ones), bytes of a text.
PER_LANG, MOST_ROWS, MOST_LANGS, MOST_BYTES = 600, 6_000, 300, 20_000


def has_letter(text: str | None) -> bool:
    """Whether the text holds a character of the Unicode categories Lu, Ll, Lt, Lm or Lo."""
    return any(map(str.isalpha, text or ""))


def subwords(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte trigram and 4-gram inside a word of the folded texts (a word's two ends count as bytes),
    and where each text's buckets start (one entry more than texts)."""
    joined = b" " + b"".join(t.translate(_FOLD) + b"  " for t in texts)
    raw = np.frombuffer(joined, dtype=np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(t) + 2 for t in texts])))
    b = raw.astype(np.uint32)
    space = raw == 32
    with np.errstate(over="ignore"):
        tri = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        quad = (tri[:-1] << np.uint32(8)) | b[3:]
        shift = np.uint32(32 - BUCKET_BITS)
        tri = (tri * np.uint32(2654435761)) >> shift
        quad = (quad * np.uint32(2246822519)) >> shift
    at3 = np.flatnonzero(~space[1:-1])
    at4 = np.flatnonzero(~(space[1:-2] | space[2:-1]))
    place = np.concatenate([at3, at4])
    order = np.argsort(place, kind="stable")
    return np.concatenate([tri[at3], quad[at4]])[order], np.searchsorted(place[order], starts)


class Model:
    """Bucket-by-language scores, bias, temperature and the rejection threshold."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, threshold: float):
        self.langs, self.table, self.bias, self.temperature, self.threshold = langs, table, bias, temperature, threshold

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        buckets, starts = subwords(raw)
        out: list[tuple[str, float]] = []
        sums = np.zeros((len(raw), len(self.langs)))
        counts = np.diff(starts)
        full = np.flatnonzero(counts)
        if len(full):
            sums[full] = np.add.reduceat(self.table[buckets], starts[:-1][full], axis=0) / counts[full, None]
        logits = (sums + self.bias) / self.temperature
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        for i, text in enumerate(texts):
            out.append((self.langs[best[i]], float(p[i, best[i]])) if has_letter(text) else ("und", 0.0))
        return out


def _examples(rows: list[tuple[str, str]], rng: np.random.Generator) -> list[tuple[bytes, str]]:
    """Whole texts and short cuts of them, so that short texts are calibrated too."""
    out = []
    for text, lang in rows:
        raw = text.encode("utf-8", "surrogatepass")
        out.append((raw, lang))
        for _ in range(2):
            size = int(rng.integers(15, 300))
            if len(raw) > size:
                start = int(rng.integers(0, len(raw) - size))
                out.append((raw[start : start + size], lang))
    return out


def _shares(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct buckets of each text and the share of each, a few texts at a time."""
    out = []
    for lo in range(0, len(texts), 32):
        buckets, starts = subwords(texts[lo : lo + 32])
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            at, n = np.unique(buckets[a:b], return_counts=True)
            out.append((at.astype(np.uint16), (n / max(1, b - a)).astype(np.float32)))
    return out


def fit(rows: list[tuple[str, str]], epochs: int = 4, rate: float = 0.5, false_rejects: float = 0.001, seed: int = 5) -> Model:
    """Train on (text, lang) rows by mini-batch stochastic gradient descent; a fifth of the rows is held back to set
    the temperature (least log loss) and the rejection threshold: at most ``false_rejects`` of the right answers on
    whole texts score less than twice the threshold, which never exceeds one half.

    Without rows, or without any subword, the model knows no language; one language is enough.
    """
    rng = np.random.default_rng(seed)
    rows = sorted((t, g) for t, g in rows if g is not None and has_letter(t))
    langs = sorted({g for _, g in rows})
    if not langs:
        return Model(["und"], np.zeros((1 << BUCKET_BITS, 1), np.float32), np.zeros(1), 1.0, 0.5)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    held, seen = (rows[::5], [r for i, r in enumerate(rows) if i % 5]) if len(rows) >= 50 else (rows, rows)
    code = {g: i for i, g in enumerate(langs)}
    examples = _examples(seen, rng)
    size = 1 << BUCKET_BITS
    shares = _shares([x for x, _ in examples])
    target = np.array([code[g] for _, g in examples])
    weight = (len(target) / (len(langs) * np.bincount(target, minlength=len(langs))))[target]  # languages count alike
    embed = rng.normal(0, 0.1, (size, WIDTH))
    head, bias = rng.normal(0, 0.1, (WIDTH, len(langs))), np.zeros(len(langs))
    batch = 64
    epochs = max(epochs, -(-600 * batch // len(examples)))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(examples))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            mean = np.zeros((len(pick), size), dtype=np.float32)
            for k, i in enumerate(pick):
                mean[k, shares[i][0]] = shares[i][1]
            hidden = mean @ embed.astype(np.float32)
            logits = hidden @ head + bias
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), target[pick]] -= 1
            p *= weight[pick, None] / len(pick)
            back = p @ head.T
            head -= step * hidden.T @ p
            bias -= step * p.sum(axis=0)
            used = np.flatnonzero(mean.any(axis=0))
            embed[used] -= step * 20 * (mean[:, used].T @ back)
    model = Model(langs, (embed @ head).astype(np.float32), bias, 1.0, 0.0)
    check = _examples(held, rng)
    sums = np.stack([share @ model.table[at] for at, share in _shares([x for x, _ in check])]) + bias
    truth = np.array([code[g] for _, g in check])

    def loss(temperature: float) -> float:
        z = sums / temperature
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(truth)), truth]).mean())

    model.temperature = min((0.1 * 1.25**k for k in range(25)), key=loss)
    found = [x for lo in range(0, len(held), 32) for x in model.predict([t for t, _ in held[lo : lo + 32]])]
    right = [s for (_, g), (p, s) in zip(held, found, strict=True) if p == g]
    model.threshold = min(0.5, float(np.quantile(right, false_rejects)) / 2) if right else 0.0
    return model


def is_held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")), F.lit(4)) == 2


def training_sample(docs: DataFrame, per_lang: int = PER_LANG, max_bytes: int = MOST_BYTES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", scratch: Scratch | None = None) -> DataFrame:
    """(text, lang): a bounded sample of labelled rows outside the held-out quarter: of each of the ``MOST_LANGS`` most frequent
    languages the ``per_lang`` rows with the smallest hash among texts of 1 to ``max_bytes`` bytes, fewer where that
    would be more than ``MOST_ROWS`` in all (one a language at least). One scan counts, another writes the sample."""
    scratch = scratch or Scratch(docs.sparkSession, "language")
    usable = docs.where(~F.coalesce(is_held_out(id_col), F.lit(True)) & F.col(lang_col).isNotNull() & F.octet_length(text_col).between(1, max_bytes))
    usable = usable.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.pmod(F.xxhash64(id_col), F.lit(1 << 30)).alias("hash"), F.col(id_col).alias("id"))
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()
    if not sizes:
        return usable.select("text", "lang").where("false")
    per_lang = max(1, min(per_lang, MOST_ROWS // len(sizes)))
    # twice the share of a language by hash, so that little is left to rank
    shares = docs.sparkSession.createDataFrame([(r[0], float(2 * per_lang << 30) / r[1]) for r in sizes], "lang string, share double")
    taken = scratch.keep(usable.join(F.broadcast(shares), "lang").where("hash < share").drop("share"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "id", "text"))
    return taken.withColumn("rank", rank).where(F.col("rank") <= per_lang).select("text", "lang")


def train(sample: DataFrame) -> Model:
    """``fit`` on all rows of a bounded sample (text, lang), in one task, so that only the model comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], names=["model"])

    found = sample.select("text", "lang").repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found[0]) if found else fit([])  # an empty plan has no task


def _map_predict(model: Model, schema: pa.Schema, id_at: int, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = max(100_000, 4_000_000 // len(model.langs))
        for batch in batches:
            for start, stop in text_slices(batch, batch.schema.names[text_at], limit):
                part = batch.slice(start, stop - start)
                got = model.predict(part.column(text_at).to_pylist())
                langs, scores = [g for g, _ in got], [s for _, s in got]
                rejected = [g == "und" or s < model.threshold for g, s in got]
                yield pa.RecordBatch.from_arrays([part.column(id_at), part.column(id_at + 1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], schema=schema)

    return run


PREDICTED = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def language_id(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The language of every whole text of ``docs``.

    Without a ``model``, one is trained on ``training_sample``. Returns (id_col, held_out boolean, lang_pred string, score
    double, rejected boolean). lang_pred is a learned language, or ``und`` with score 0 if the text is null or has no
    letter; score is the calibrated probability; rejected is true for ``und`` and below the calibrated threshold. Only
    the text enters a prediction. Rows with a null id have held_out null and are predicted all the same; repeated
    rows give repeated rows; an empty table gives an empty result; other columns are ignored.
    """
    model = model or train(training_sample(docs, id_col=id_col, text_col=text_col, lang_col=lang_col))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), is_held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_map_predict(model, PREDICTED, 0, 2), "id long, held_out boolean, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model | None = None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is identified, with all their columns: not ``und`` and not below the
    calibrated threshold. Null texts and texts without a letter go; ids are not looked at; repeated rows stay or go
    each; an empty table gives an empty one."""
    model = model or train(training_sample(docs, text_col=text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = max(100_000, 4_000_000 // len(model.langs))
        for batch in batches:
            for start, stop in text_slices(batch, text_col, limit):
                part = batch.slice(start, stop - start)
                got = model.predict(part.column(text_col).to_pylist())
                yield part.filter(pa.array([g != "und" and s >= model.threshold for g, s in got]))

    return docs.mapInArrow(run, docs.schema)
