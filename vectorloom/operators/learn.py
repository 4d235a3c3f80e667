"""Learning affine maps by Adam. A model's steps follow one another in one task, over batches sorted by model and place;
Spark runs many models at once."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.errors import ValidationError
from vectorloom.operators.blocks import Weights
from vectorloom.operators.search import centroids

#: Adam's decay rates and epsilon; learning rates that are tried; epochs of a trial.
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8
RATES = (0.1, 0.05, 0.01, 0.005, 0.001)
TRIAL_EPOCHS = 10


@dataclass
class Options:
    rate: float = 0.01
    epochs: int = 100
    regularization: float = 0.001
    patience: int | None = None
    auto_rate: bool = False
    margin: float = 0.1
    temperature: float = 0.1

    def check(self) -> Options:
        for name in ("rate", "temperature"):
            if not np.isfinite(getattr(self, name)) or getattr(self, name) <= 0:
                raise ValidationError(name, "must be positive")
        for name in ("regularization", "margin"):
            if not np.isfinite(getattr(self, name)) or getattr(self, name) < 0:
                raise ValidationError(name, "must not be negative")
        if self.epochs < 1 or self.patience is not None and self.patience < 1:
            raise ValidationError("epochs and patience", "must be positive")
        return self


class Adam:
    """An affine map with its moments, or, with one more axis in front, many of them at once. The L2 term enters the
    matrix gradient only."""

    def __init__(self, weights: Weights):
        self.matrix, self.bias, self.routing = weights.matrix.copy(), weights.bias.copy(), weights.routing
        self.moments = [np.zeros_like(x) for x in (self.matrix, self.matrix, self.bias, self.bias)]
        self.t = 0

    @classmethod
    def many(cls, n: int, source: int, target: int) -> Adam:
        """``n`` maps that start as the identity."""
        out = cls(initial(source, target))
        out.matrix, out.bias = np.repeat(out.matrix[None], n, axis=0), np.repeat(out.bias[None], n, axis=0)
        out.moments = [np.zeros_like(x) for x in (out.matrix, out.matrix, out.bias, out.bias)]
        return out

    def step(self, x: np.ndarray, gradient: np.ndarray, rate: float, regularization: float) -> None:
        fix1, fix2 = 1 - BETA1**self.t, 1 - BETA2**self.t
        for value, g, a, b in ((self.matrix, gradient[..., :, None] * x[..., None, :] + regularization * self.matrix, 0, 1), (self.bias, gradient, 2, 3)):
            self.moments[a] = BETA1 * self.moments[a] + (1 - BETA1) * g
            self.moments[b] = BETA2 * self.moments[b] + (1 - BETA2) * g * g
            value -= rate * (self.moments[a] / fix1) / (np.sqrt(self.moments[b] / fix2) + EPSILON)

    def weights(self) -> Weights:
        return Weights(self.matrix, self.bias, self.routing)


def soft(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max())
    return e / e.sum()


class Objective:
    """Input, loss and output gradient of one example (a dict of arrays)."""

    columns: tuple[str, ...] = ()

    def input(self, example: dict) -> np.ndarray:
        return example[self.columns[0]]

    def dims(self, example: dict) -> tuple[int, int]:
        return len(self.input(example)), len(self.input(example))

    def loss(self, y: np.ndarray, example: dict, options: Options) -> float:
        raise NotImplementedError

    def gradient(self, y: np.ndarray, example: dict, options: Options) -> np.ndarray | None:
        """None: no step for this example."""
        raise NotImplementedError


class Regression(Objective):
    """Squared error to a target, of any dimension."""

    def __init__(self, source: str = "input", target: str = "target"):
        self.columns = (source, target)

    def dims(self, example):
        return len(example[self.columns[0]]), len(example[self.columns[1]])

    def loss(self, y, example, options):
        return float(((y - example[self.columns[1]]) ** 2).sum())

    def gradient(self, y, example, options):
        return y - example[self.columns[1]]


class CrossEncoder(Objective):
    """A score from the concatenation of a query and a document."""

    columns = ("query", "document", "score")

    def input(self, example):
        return np.concatenate([example["query"], example["document"]])

    def dims(self, example):
        return len(example["query"]) + len(example["document"]), 1

    def loss(self, y, example, options):
        return float((y[0] - example["score"]) ** 2)

    def gradient(self, y, example, options):
        return y - example["score"]


class Triplet(Objective):
    """Hinge on margin + negative - positive; an example within the margin takes no step."""

    columns = ("anchor", "positive", "negative")

    def loss(self, y, example, options):
        return max(0.0, options.margin + float(y @ example["negative"]) - float(y @ example["positive"]))

    def gradient(self, y, example, options):
        return example["negative"] - example["positive"] if self.loss(y, example, options) > 0 else None


class InfoNce(Objective):
    """Cross entropy of the positive among positive and negatives."""

    columns = ("anchor", "positive", "negatives")

    def shares(self, y, example, options):
        others = np.asarray(example["negatives"], dtype=np.float64).reshape(-1, len(y))
        return others, soft(np.concatenate([[y @ example["positive"]], others @ y]) / options.temperature)

    def loss(self, y, example, options):
        return -float(np.log(max(self.shares(y, example, options)[1][0], 1e-9)))

    def gradient(self, y, example, options):
        others, p = self.shares(y, example, options)
        return ((p[0] - 1) * example["positive"] + p[1:] @ others) / options.temperature


def initial(source: int, target: int) -> Weights:
    return Weights(np.eye(target, source), np.zeros(target))


def _advance(model: Adam | None, objective: Objective, example: dict, options: Options, rate: float | None = None) -> Adam:
    """One step; the identity starts."""
    model = model or Adam(initial(*objective.dims(example)))
    x = objective.input(example)
    model.t += 1
    gradient = objective.gradient(model.matrix @ x + model.bias, example, options)
    if gradient is not None:
        model.step(x, gradient, rate or options.rate, options.regularization)
    return model


def _loss(model: Adam | Weights, objective: Objective, example: dict, options: Options) -> float:
    return objective.loss(model.matrix @ objective.input(example) + model.bias, example, options)


def train(objective: Objective, examples: Iterable[dict] | Callable[[], Iterable[dict]], options: Options = Options(), start: Weights | None = None) -> Weights:  # noqa: B008
    """Steps in the order of the examples, epoch by epoch. A callable is read anew each epoch. With ``patience`` it stops
    once the mean loss has not strictly improved for that many epochs: over the whole set after the epoch, or, for a
    callable, as measured after each step. ``auto_rate`` tries ``RATES`` first."""
    options.check()
    fresh = examples if callable(examples) else None
    kept = None if fresh else list(examples)
    if kept is not None and not kept:
        raise ValidationError("examples", "none")
    if options.auto_rate:
        options = replace(options, rate=best_rate(objective, examples if fresh else kept, options), auto_rate=False)
    model: Adam | None = Adam(start) if start else None
    best, waited = np.inf, 0
    for _ in range(options.epochs):
        total, n = 0.0, 0
        for example in fresh() if fresh else kept:
            model = _advance(model, objective, example, options)
            if fresh and options.patience:
                total += _loss(model, objective, example, options)
            n += 1
        if model is None:
            raise ValidationError("examples", "none")
        if options.patience:
            if kept is not None:
                total = sum(_loss(model, objective, e, options) for e in kept)
            if total / n < best:
                best, waited = total / n, 0
            else:
                waited += 1
                if waited >= options.patience:
                    break
    return model.weights()


def best_rate(objective: Objective, examples, options: Options) -> float:
    """The rate of ``RATES`` with the least summed loss after a short training; the first of equals."""
    read = examples if callable(examples) else lambda: examples
    found = []
    for rate in RATES:
        w = train(objective, examples, replace(options, rate=rate, epochs=min(options.epochs, TRIAL_EPOCHS), patience=None, auto_rate=False))
        found.append(sum(_loss(w, objective, e, options) for e in read()))
    return RATES[int(np.argmin(np.nan_to_num(found, nan=np.inf)))]


class OnlineTrainer:
    """One step an example; moments survive between calls, the routing vector stays."""

    def __init__(self, objective: Objective, options: Options = Options()):  # noqa: B008
        self.objective, self.options = objective, options.check()
        self.model: Adam | None = None

    def update(self, weights: Weights, example: dict, rate: float | None = None) -> Weights:
        if self.model is None:
            self.model = Adam(weights)
        m = self.model
        m.matrix, m.bias, m.routing = weights.matrix.copy(), weights.bias.copy(), weights.routing
        return _advance(m, self.objective, example, self.options, rate).weights()


def _arrays(column: pa.Array) -> list:
    """The values of an Arrow column: numbers, vectors or stacks of vectors."""
    if not (pa.types.is_list(column.type) or pa.types.is_large_list(column.type)):
        return column.cast(pa.float64()).to_numpy(zero_copy_only=False).tolist()
    offsets, inner = column.offsets.to_numpy(), column.values
    if pa.types.is_list(inner.type) or pa.types.is_large_list(inner.type):
        rows = _arrays(inner)
        return [np.stack(rows[a:b]) if b > a else np.empty((0, 0)) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    flat = inner.cast(pa.float64()).to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def read_examples(batch: pa.RecordBatch, columns: Iterable[str]) -> Iterator[dict]:
    """The rows of a batch as examples."""
    names = list(columns)
    for row in zip(*(_arrays(batch.column(c)) for c in names), strict=True):
        yield dict(zip(names, row, strict=True))


WEIGHT_ROWS = "i long, j long, w double"


def weight_rows(weights: Weights) -> list[pa.Array]:
    """Columns (i, j, w); the bias has j null."""
    rows, cols = weights.matrix.shape
    i, j = np.divmod(np.arange(rows * cols), cols)
    return [pa.array(np.concatenate([i, np.arange(rows)])), pa.concat_arrays([pa.array(j), pa.nulls(rows, pa.int64())]), pa.array(np.concatenate([weights.matrix.reshape(-1), weights.bias]))]


def _repeat(value, kind: pa.DataType, n: int) -> pa.Array:
    return pa.array([value], kind).take(pa.array(np.zeros(n, dtype=np.int64)))


def train_models(examples: DataFrame, objective: Objective, options: Options = Options(), by: str = "model") -> DataFrame:  # noqa: B008
    """(by, i, j, w): a map for each value of ``by``, trained in the order of ``seq``. A model's examples are one task, as
    its steps follow one another; models run side by side. A single epoch reads sorted batches and holds nothing; more
    epochs, patience or a rate search hold one model's examples as dense arrays."""
    options.check()
    kind = examples.schema[by].dataType.simpleString()
    once = options.epochs == 1 and not options.patience and not options.auto_rate

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, field, model, held = None, None, None, []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal model, held
            if model or held:
                columns = weight_rows(model.weights() if once else train(objective, held, options))
                yield pa.RecordBatch.from_arrays([_repeat(key, field, len(columns[0])), *columns], names=[by, "i", "j", "w"])
            model, held = None, []

        for batch in batches:
            field = batch.schema.field(0).type
            for own, example in zip(batch.column(0).to_pylist(), read_examples(batch, objective.columns), strict=True):
                if own != key:
                    yield from close()
                    key = own
                if once:
                    model = _advance(model, objective, example, options)
                else:
                    held.append(example)
        yield from close()

    rows = examples.select(by, "seq", *objective.columns)
    return rows.repartition(by).sortWithinPartitions(by, "seq").mapInArrow(run, f"{by} {kind}, {WEIGHT_ROWS}")


def rate_losses(examples: DataFrame, objective: Objective, options: Options = Options()) -> DataFrame:  # noqa: B008
    """(rate, loss) of every candidate rate after a short training over all examples in the order of ``seq``.

    An epoch is one pass of one task over the sorted rows that steps all candidates, so nothing is copied or held; the
    losses are then summed over all partitions."""
    trial = replace(options, epochs=min(options.epochs, TRIAL_EPOCHS), patience=None, auto_rate=False).check()
    rows = examples.select("seq", *objective.columns)

    def epoch(models: list[Adam | None]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = list(models)
            for batch in batches:
                for example in read_examples(batch, objective.columns):
                    own = [_advance(m, objective, example, trial, rate) for m, rate in zip(own, RATES, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(own)], pa.binary())], names=["models"])

        return run

    models: list[Adam | None] = [None] * len(RATES)
    for _ in range(trial.epochs):
        models = pickle.loads(rows.repartition(1).sortWithinPartitions("seq").mapInArrow(epoch(models), "models binary").first()[0])

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(RATES))
        for batch in batches:
            for example in read_examples(batch, objective.columns):
                total += [_loss(m, objective, example, trial) for m in models]
        yield pa.RecordBatch.from_arrays([pa.array(RATES), pa.array(total)], names=["rate", "loss"])

    return rows.mapInArrow(losses, "rate double, loss double").groupBy("rate").agg(F.sum("loss").alias("loss"))


def train_online(examples: DataFrame, scheduler, weights: Weights, order: list[str]) -> DataFrame:
    """(steps, i, j, w): the weights after a scheduler has taken all rows in ``order``: one task over sorted batches, since
    each step starts from the one before; nothing is held but the scheduler's buffer."""
    columns = scheduler.trainer.objective.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = weights
        for batch in batches:
            for example in read_examples(batch, columns):
                now = scheduler.add(now, [example]) or now
        out = weight_rows(now)
        yield pa.RecordBatch.from_arrays([_repeat(scheduler.steps, pa.int64(), len(out[0])), *out], names=["steps", "i", "j", "w"])

    return examples.select(*order, *columns).repartition(1).sortWithinPartitions(*order).mapInArrow(run, f"steps long, {WEIGHT_ROWS}")


def factory_examples(samples: DataFrame, by: str, order: str, column: str = "v", max_negatives: int = 7) -> DataFrame:
    """(by, seq, anchor, positive, negatives) for contrastive training of one intent a category.

    Anchor i of a category pairs with its predecessor, the first with its successor, one alone with itself. Negatives
    are the other categories' samples in order, all of them or ``max_negatives`` at even strides that start at i.
    Categories come in order of ``by``. Positions come from windows; only the few chosen negatives are joined.
    """
    n_of = samples.groupBy(by).agg(F.count("*").alias("n"))
    sizes = n_of.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    own = Window.partitionBy(by).orderBy(order)
    rows = samples.select(by, order, F.col(column).alias("anchor"), (F.row_number().over(own) - 1).cast("long").alias("i"), F.lag(column).over(own).alias("_prev"), F.lead(column).over(own).alias("_next")).join(sizes, by)
    rows = rows.withColumn("positive", F.coalesce("_prev", "_next", "anchor")).withColumn("place", F.col("before") + F.col("i"))
    others = F.col("total") - F.col("n")
    k = F.explode(F.sequence(F.lit(0), F.least(others, F.lit(max_negatives)) - 1))
    picks = rows.where(others > 0).select(by, "i", "anchor", "positive", "n", "before", others.alias("others"), k.alias("k"))
    stride = F.floor((F.col("k") * (F.col("others").cast("double") / max_negatives) + F.col("i")) % F.col("others")).cast("long")
    at = F.when(F.col("others") <= max_negatives, F.col("k").cast("long")).otherwise(stride)
    picks = picks.withColumn("at", at + F.when(at >= F.col("before"), F.col("n")).otherwise(0))
    negatives = rows.select(F.col("place").alias("at"), F.col("anchor").alias("negative"))
    joined = picks.join(negatives, "at")
    found = joined.groupBy(by, "i").agg(F.first("anchor").alias("anchor"), F.first("positive").alias("positive"), F.transform(F.array_sort(F.collect_list(F.struct("k", "negative"))), lambda r: r["negative"]).alias("negatives"))
    return found.select(by, F.col("i").alias("seq"), "anchor", "positive", "negatives")


def build_intents(samples: DataFrame, by: str, order: str, column: str = "v", options: Options = Options(temperature=0.07), max_negatives: int = 7) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(weights (by, i, j, w), routing (by, v)): a contrastive intent for each category, with its unit centroid. Two
    categories are needed."""
    if samples.select(by).distinct().limit(2).count() < 2:
        raise ValidationError("categories", "two at least are needed")
    from vectorloom.functions.vectors import normalize

    return train_models(factory_examples(samples, by, order, column, max_negatives), InfoNce(), options, by), centroids(samples, by, column).withColumn("v", normalize(F.col("v")))


@dataclass
class WhiteningFit:
    """Running mean and principal components (textbook Sanger rule), and eigenvalues for the soft form.

    The first vector is the mean; later ones move it by the rate. Components start as unit axes, so a fit is repeatable.
    Eigenvalues start at 1e-6 and follow the squared projection before the component moves.
    """

    dim: int
    components: int = 1
    rate: float = 0.01

    def __post_init__(self):
        self.mean, self.axes = np.zeros(self.dim), np.eye(self.components, self.dim)
        self.eigenvalues, self.count = np.full(self.components, 1e-6), 0

    def update(self, v: np.ndarray) -> None:
        v = np.asarray(v, dtype=np.float64)
        self.mean = v.copy() if self.count == 0 else (1 - self.rate) * self.mean + self.rate * v
        self.count += 1
        rest = v - self.mean
        for k in range(self.components):
            w = self.axes[k]
            y = float(w @ rest)
            self.eigenvalues[k] = (1 - self.rate) * self.eigenvalues[k] + self.rate * y * y
            w = w + self.rate * (y * rest - y * y * w)
            n = np.linalg.norm(w)
            self.axes[k] = w / n if n else w
            rest = rest - y * self.axes[k]


def fit_whitening(rows: DataFrame, dim: int, components: int = 1, rate: float = 0.01, by: str = "model", column: str = "v") -> DataFrame:
    """(by, mean, components, eigenvalues, n): a sequential fit in the order of ``seq`` for each ``by``."""
    kind = rows.schema[by].dataType.simpleString()
    lists = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, field, fit = None, None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], field), pa.array([fit.mean.tolist()], lists), pa.array([fit.axes.tolist()], pa.list_(lists)), pa.array([fit.eigenvalues.tolist()], lists), pa.array([fit.count], pa.int64())], names=[by, "mean", "components", "eigenvalues", "n"])

        for batch in batches:
            field = batch.schema.field(0).type
            for own, v in zip(batch.column(0).to_pylist(), _arrays(batch.column(2)), strict=True):
                if fit is None or own != key:
                    if fit:
                        yield row()
                    key, fit = own, WhiteningFit(dim, components, rate)
                fit.update(v)
        if fit:
            yield row()

    sorted_rows = rows.select(by, "seq", column).repartition(by).sortWithinPartitions(by, "seq")
    return sorted_rows.mapInArrow(run, f"{by} {kind}, mean array<double>, components array<array<double>>, eigenvalues array<double>, n long")


def ewma(rows: DataFrame, by: str, order: str, value: str, rate: float = 0.01) -> DataFrame:
    """(by, ewma): exponentially weighted mean in order; the first value starts it. A row's weight follows from how many
    rows come after it, so the mean is a grouped sum behind one window, and no history is held in a row."""
    back = Window.partitionBy(by).orderBy(F.col(order).desc())
    after = (F.row_number().over(back) - 1).cast("double")
    first = F.lead(F.lit(1)).over(back).isNull()
    weighed = rows.select(by, order, F.col(value).cast("double").alias("x")).withColumn("after", after).withColumn("first", first)
    share = F.pow(F.lit(1 - rate), F.col("after")) * F.when(F.col("first"), 1.0).otherwise(rate)
    return weighed.groupBy(by).agg(F.sum(F.col("x") * share).alias("ewma"))
