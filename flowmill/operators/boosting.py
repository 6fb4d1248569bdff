"""Boosted regression trees for a binary label, grown from histograms.

The learner is that of MLlib's ``GBTClassifier``: logistic loss, the first tree fitted to the labels
(-1 and 1) and the others to the residuals, variance as impurity, ``maxBins`` intervals a feature,
means as leaves; the fitted model is MLlib's own class. MLlib starts a job for each level of each
tree and walks all trees' rows through it. Here one barrier stage grows all trees: each of its tasks
keeps its share of the binned rows in a temporary file, and what tasks exchange is a histogram per
level, so a tree costs no job. They exchange it through files in the shared scratch folder where that is a folder
for Python too, else by ``allGather``, whose every call takes a second.

Bins of several features are one code of 16 bits, so that one count serves them all. A histogram is
built for the smaller of two siblings only, the other is the parent less that one. Every task decides every
split from the same sums.
"""

from __future__ import annotations

import base64
import json
import os
import tempfile
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.session import local_folder, scratch_path, scratch_scope, stage

#: Values of a feature that a summary tells apart; beyond that they are ranked to 1 / SUMMARY a merge.
SUMMARY = 1024
#: Rows between two merges of summaries.
_SUMMARY_ROWS = 65_536
#: Codes of a group of features.
CELLS = 1024
#: Rows in a row of the binned table.
_PIECE = 128
#: Rows counted at once. A count and a sum share one float: residuals, up to 4, are rounded to 2**-17, so
#: sums of a block stay below 2**35 and counts begin at 2**37.
_BLOCK = 60_000
_FINE, _COUNT = 2.0**17, 2.0**37


def fit(estimator: GBTClassifier, train: DataFrame) -> GBTClassificationModel:
    """The model that ``estimator`` describes; of its settings maxIter, maxDepth, stepSize, maxBins, subsamplingRate
    and seed are followed, and featureSubsetStrategy, a share.

    Null, NaN and infinite values and labels other than 0 and 1 are errors, as in MLlib.
    """
    spark = train.sparkSession
    label = F.col(estimator.getLabelCol()).cast("double")
    known = F.when(label.isin(0.0, 1.0), label).otherwise(F.raise_error(F.lit("labels must be 0 or 1")).cast("double"))
    rows = train.select(known.alias("y"), vector_to_array(F.col(estimator.getFeaturesCol())).alias("x"))
    n_rows, cuts = find_cuts(rows, estimator.getMaxBins())
    with scratch_scope(spark) as scope:
        pieces = stage(_binned(rows, cuts), "bins")
        scope.paths.append(shared := scratch_path(spark, "exchange"))
        grown = _grow(spark, pieces, n_rows, cuts, local_folder(spark, shared), {
            "trees": estimator.getMaxIter(), "depth": estimator.getMaxDepth(), "step": estimator.getStepSize(),
            "row_share": estimator.getSubsamplingRate(), "column_share": float(estimator.getFeatureSubsetStrategy()), "seed": estimator.getSeed(),
        })
    return _as_model(spark, estimator, grown, len(cuts))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten()
    if column.null_count or values.null_count:
        raise ValueError("features must not be null")
    x = values.to_numpy(zero_copy_only=False).reshape(len(column), -1)
    if not np.isfinite(x).all():
        raise ValueError("features must not be NaN or infinite")
    return x


def _merged(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values with their counts; of more than SUMMARY the largest of each stretch of ranks."""
    values, at = np.unique(values, return_inverse=True)
    counts = np.bincount(at, counts, len(values))
    if len(values) <= SUMMARY:
        return values, counts
    ranks = np.cumsum(counts)
    stretch = np.ceil(ranks * (SUMMARY / ranks[-1]))
    last = np.flatnonzero(np.append(stretch[1:] != stretch[:-1], True))
    return values[last], np.diff(ranks[last], prepend=0)


def thresholds(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """Bounds of at most ``bins`` intervals, halfway between two values: of every value, or of equal numbers of rows."""
    if len(values) > bins:
        ranks = np.cumsum(counts)
        wanted = ranks[-1] * np.arange(1, bins) / bins
        ends = np.searchsorted(ranks, wanted)
        before = np.append(0.0, ranks)[ends]
        ends = np.where((ends > 0) & (wanted - before < ranks[ends] - wanted), ends - 1, ends)  # the nearest, so that a frequent value is an interval
    else:
        ends = np.arange(len(values) - 1)
    ends = np.unique(ends[ends < len(values) - 1])
    low, high = values[ends], values[ends + 1]
    middle = low + (high - low) / 2
    return np.where(middle < high, middle, low)


def find_cuts(rows: DataFrame, bins: int) -> tuple[int, list[np.ndarray]]:
    """Rows, and the thresholds of every feature of ``x``. All rows are read; summaries merge pairwise, so that
    their errors add up to the logarithm of the rows."""

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels: list[list | None] = []
        waiting: list[np.ndarray] = []

        def add() -> None:
            x = np.concatenate(waiting)
            waiting.clear()
            new = [_merged(c, np.ones(len(c))) for c in x.T]
            for k, old in enumerate(levels):
                if old is None:
                    levels[k] = new
                    return
                new = [_merged(*map(np.concatenate, zip(a, b, strict=True))) for a, b in zip(old, new, strict=True)]
                levels[k] = None
            levels.append(new)

        for batch in batches:
            if len(batch):
                waiting.append(_matrix(batch.column(1)))
                if sum(map(len, waiting)) >= _SUMMARY_ROWS:
                    add()
        if waiting:
            add()
        for each in filter(None, levels):
            yield pa.RecordBatch.from_pydict({
                "feature": pa.array(range(len(each)), pa.int32()),
                "value": pa.array([v for v, _ in each], pa.list_(pa.float64())), "rows": pa.array([n for _, n in each], pa.list_(pa.float64())),
            })

    def bounds(of: pd.DataFrame) -> pd.DataFrame:
        parts = [_merged(np.asarray(v), np.asarray(n)) for v, n in zip(of["value"], of["rows"], strict=True)]
        while len(parts) > 1:
            parts = [_merged(*map(np.concatenate, zip(*parts[i : i + 2], strict=True))) for i in range(0, len(parts), 2)]
        values, counts = parts[0]
        return pd.DataFrame({"feature": of["feature"][:1], "n": [int(counts.sum())], "cuts": [thresholds(values, counts, bins)]})

    summaries = rows.mapInArrow(summarize, "feature int, value array<double>, rows array<double>")
    found = sorted(summaries.groupBy("feature").applyInPandas(bounds, "feature int, n long, cuts array<double>").collect())
    if not found:
        raise ValueError("there is no row to learn from")
    return found[0].n, [np.array(r.cuts, dtype=float) for r in found]


def _groups(cuts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Features that share a code: (feature, bins, stride of its bin in the code)."""
    out: list[list[tuple[int, int, int]]] = []
    size = CELLS
    for j, bins in enumerate(len(c) + 1 for c in cuts):
        if bins == 1:  # a constant splits nothing
            continue
        if size * bins > CELLS:
            out.append([])
            size = 1
        out[-1].append((j, bins, size))
        size *= bins
    return out


def _binned(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """``rows`` in pieces of at most 128: their labels, and their codes group by group."""
    groups = _groups(cuts)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(1))
            y = batch.column(0).to_numpy().astype(np.int8)
            codes = np.zeros((len(groups), len(x)), np.uint16)
            for g, members in enumerate(groups):
                for j, _, stride in members:
                    codes[g] += (np.searchsorted(cuts[j], x[:, j]) * stride).astype(np.uint16)
            at = range(0, len(x), _PIECE)
            yield pa.RecordBatch.from_pydict({
                "y": pa.array([y[i : i + _PIECE].tobytes() for i in at], pa.binary()),
                "codes": pa.array([codes[:, i : i + _PIECE].tobytes() for i in at], pa.binary()),
            })

    return rows.mapInArrow(code, "y binary, codes binary")


def _tasks(spark: SparkSession, n_rows: int) -> int:
    """Tasks of the barrier stage, which all run at once. What they exchange grows with the square of their
    number and what each counts is its share of the rows, which balances at a cube root."""
    sc = spark.sparkContext._jsc.sc()
    slots = sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile())
    return max(1, min(slots, round((n_rows / 8192) ** (1 / 3))))


def _grow(spark: SparkSession, pieces: DataFrame, n_rows: int, cuts: list[np.ndarray], folder: str | None, how: dict) -> pd.DataFrame:
    """Nodes of all trees: tree, node, feature (-1 in a leaf), cut, left, right, and rows, sum and squares of the residuals."""
    sizes = [len(c) + 1 for c in cuts]
    groups = _groups(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exchange = _Exchange(BarrierTaskContext.get(), folder)
        with tempfile.TemporaryFile() as file:
            trees = _Grower(file, batches, groups, sizes, how, exchange).trees()
            for t, nodes in enumerate(trees):
                if exchange.task == 0:
                    columns = {"tree": np.full(len(nodes["feature"]), t), "node": np.arange(len(nodes["feature"])), **nodes}
                    yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.float64() if k in ("rows", "sum", "squares") else pa.int32()) for k, v in columns.items()})

    dealt = pieces.repartition(_tasks(spark, n_rows))
    kinds = "tree int, node int, feature int, cut int, left int, right int, rows double, sum double, squares double"
    out = dealt.mapInArrow(run, kinds, barrier=True).toPandas().sort_values(["tree", "node"])
    out["threshold"] = [cuts[j][c] if j >= 0 else np.nan for j, c in zip(out["feature"], out["cut"], strict=True)]
    return out


class _Exchange:
    """Hands what each task of a barrier stage has to all of them.

    A file is complete once it has its name. Who has read all files of a round knows that the one before was read
    by all, and removes its own of that one. The folder is named after an attempt of the stage, so that a
    repeated one starts anew.
    """

    def __init__(self, context: BarrierTaskContext, folder: str | None):
        attempts = context.allGather(str(context.taskAttemptId()))
        self.context, self.task, self.tasks, self.round = context, context.partitionId(), len(attempts), 0
        self.folder = folder and f"{folder}/{attempts[0]}"
        if self.folder:
            os.makedirs(self.folder, exist_ok=True)

    def all(self, data: bytes) -> Iterator[bytes]:
        """``data`` of every task, in the order of the tasks."""
        if self.tasks == 1:
            yield data
        elif self.folder is None:
            yield from map(base64.b64decode, self.context.allGather(base64.b64encode(data).decode()))
        else:
            own = f"{self.folder}/{self.round}-{self.task}"
            with open(f"{own}.tmp", "wb") as file:
                file.write(data)
            os.rename(f"{own}.tmp", own)
            for k in range(self.tasks):
                while not os.path.exists(at := f"{self.folder}/{self.round}-{k}"):
                    time.sleep(0.0005)
                with open(at, "rb") as file:
                    yield file.read()
            if self.round:
                os.remove(f"{self.folder}/{self.round - 1}-{self.task}")
            self.round += 1


class _Grower:
    """One task's part in growing trees. Its codes lie in ``file``, by block and group."""

    def __init__(self, file, batches, groups, sizes, how, exchange):
        self.groups, self.how, self.exchange = groups, how, exchange
        self.n_features, self.bins = len(sizes), max(sizes)
        self.stride = max([1] + [size * bins for g in groups for _, bins, size in g[-1:]])
        labels, lengths, parts, held = [], [], [], 0

        def write() -> None:
            np.concatenate(parts, axis=1).tofile(file)
            lengths.append(held)
            parts.clear()

        for batch in batches:
            for y, codes in zip(batch.column(0), batch.column(1), strict=True):
                labels.append(np.frombuffer(y.as_py(), np.int8))
                parts.append(np.frombuffer(codes.as_py(), np.uint16).reshape(len(groups), len(labels[-1])))
                held += len(labels[-1])
                if held > _BLOCK - _PIECE:
                    write()
                    held = 0
        if held:
            write()
        file.flush()
        y = np.concatenate(labels) if labels else np.empty(0, np.int8)
        self.y = y * np.int8(2) - np.int8(1)
        self.margin = np.zeros(len(y))
        self.at = np.zeros(len(y), np.int32)
        ends = np.cumsum(lengths, dtype=np.int64)
        self.spans = [slice(e - n, e) for e, n in zip(ends.tolist(), lengths, strict=True)]
        all_codes = np.memmap(file, np.uint16, "r") if len(y) and groups else np.empty(0, np.uint16)
        self.codes = [all_codes[s.start * len(groups) : s.stop * len(groups)].reshape(len(groups), s.stop - s.start) for s in self.spans]
        self.index = np.empty(_BLOCK, np.int64)
        # the group of a feature, its bins and stride there
        self.place = {j: (g, bins, size) for g, members in enumerate(groups) for j, bins, size in members}

    def summed(self, *arrays: np.ndarray) -> list[np.ndarray]:
        """Arrays added up over all tasks, in the order of the tasks."""
        totals = [np.zeros(a.shape, np.float64 if a.dtype == np.float64 else np.int64) for a in arrays]
        for data in self.exchange.all(b"".join(a.tobytes() for a in arrays)):
            at = 0
            for a, total in zip(arrays, totals, strict=True):
                total += np.frombuffer(data, a.dtype, a.size, at).reshape(a.shape)
                at += a.nbytes
        return totals

    def trees(self) -> Iterator[dict[str, np.ndarray]]:
        for t in range(self.how["trees"]):
            residual = 4.0 * self.y / (1.0 + np.exp(np.minimum(2.0 * self.y * self.margin, 700.0))) if t else self.y.astype(float)
            chosen = np.random.default_rng([self.how["seed"] & (2**63 - 1), t, self.exchange.task]).random(len(self.y), np.float32) < self.how["row_share"]
            nodes = self.tree(t, residual, chosen)
            mean = nodes["sum"] / np.maximum(nodes["rows"], 1)
            self.margin += (self.how["step"] if t else 1.0) * mean[self.at]
            yield nodes

    def tree(self, t: int, residual: np.ndarray, chosen: np.ndarray) -> dict[str, np.ndarray]:
        weight = _COUNT + np.rint(residual * _FINE)
        self.at[:] = 0
        feature, cut, left, right = [-1], [-1], [-1], [-1]
        random = np.random.default_rng([self.how["seed"] & (2**63 - 1), t])
        n_chosen = max(1, int(np.ceil(self.how["column_share"] * self.n_features)))
        level, build, parents = [0], [0], None
        for _ in range(self.how["depth"] if self.groups else 0):
            counts, sums = self.summed(*self.histograms(build, len(feature), weight, chosen))
            if parents is not None:  # a sibling is what the parent has besides
                place = {node: i for i, node in enumerate(build)}
                pairs = [(node, parent, sibling) for node, parent, sibling in parents]
                counts, sums = ([h[place[n]] if n in place else was[p] - h[place[s]] for n, p, s in pairs] for h, was in ((counts, old[0]), (sums, old[1])))
                counts, sums = np.stack(counts), np.stack(sums)
            usable = random.random((len(level), self.n_features)).argsort(axis=1).argsort(axis=1) < n_chosen
            gain, best, below, total = self.best(counts, sums, usable)
            split = np.flatnonzero(gain > 0)
            if not len(split):
                break
            nxt, build, parents, first = [], [], [], len(feature)
            for i in split:
                node, child = level[i], len(feature)
                feature[node], cut[node] = divmod(int(best[i]), self.bins)
                left[node], right[node] = child, child + 1
                for column in (feature, cut, left, right):
                    column += [-1, -1]
                nxt += [child, child + 1]
                build.append(child if 2 * below[i] <= total[i] else child + 1)
                parents += [(child, i, child + 1), (child + 1, i, child)]
            self.descend([level[i] for i in split], feature, cut, left, first)
            level, old = nxt, (counts, sums)
        return self.closed(residual, chosen, feature, cut, left, right)

    def histograms(self, build: list[int], n_nodes: int, weight: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows, and sums of residuals in units of 1 / _FINE, by node, feature and bin."""
        shape = (len(build), self.n_features, self.bins)
        counts, sums = np.zeros(shape, np.int32), np.zeros(shape, np.int64)
        slot = np.full(n_nodes, -1, np.int64)
        slot[build] = np.arange(len(build))
        slot_cells = slot * self.stride
        packed = np.zeros(shape)
        for span, codes in zip(self.spans, self.codes, strict=True):
            offset = slot_cells[self.at[span]]
            keep = np.flatnonzero((offset >= 0) & chosen[span])
            offset, w, codes = offset[keep], weight[span][keep], codes.take(keep, axis=1)
            index = self.index[: len(keep)]
            for g, members in enumerate(self.groups):
                np.add(codes[g], offset, out=index)
                cells = np.bincount(index, w, len(build) * self.stride).reshape(len(build), self.stride)
                for j, bins, size in members:
                    whole = cells[:, : members[-1][1] * members[-1][2]].reshape(len(build), -1, bins, size)
                    packed[:, j, :bins] = whole.sum(axis=3).sum(axis=1)
            n = np.rint(packed / _COUNT)
            counts += n.astype(np.int32)
            sums += (packed - n * _COUNT).astype(np.int64)
        return counts, sums

    def best(self, counts: np.ndarray, sums: np.ndarray, usable: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each node the gain, place (feature * bins + bin) and rows below of its best split, and its rows."""
        n_low, s_low = np.cumsum(counts, axis=2).astype(float), np.cumsum(sums, axis=2).astype(float)
        filled = self.groups[0][0][0]  # any feature that is not constant has all rows of a node
        n, s = n_low[:, filled, -1][:, None, None], s_low[:, filled, -1][:, None, None]
        n_high, s_high = n - n_low, s - s_low
        with np.errstate(divide="ignore", invalid="ignore"):
            whole = np.where(n > 0, s * s / n, 0.0)
            gain = s_low * s_low / n_low + s_high * s_high / n_high - whole
        gain = np.where((n_low > 0) & (n_high > 0) & usable[:, :, None], gain, -np.inf).reshape(len(counts), -1)
        place = gain.argmax(axis=1)
        each = np.arange(len(counts))
        gain, whole, total = gain[each, place], whole[:, 0, 0], n[:, 0, 0]
        # what rounding leaves of equal means is no gain
        return np.where(gain > 1e-12 * (whole + 1), gain, 0.0), place, n_low.reshape(len(counts), -1)[each, place], total

    def descend(self, split: list[int], feature: list[int], cut: list[int], left: list[int], n_nodes: int) -> None:
        """Rows of split nodes go to a child: a table tells for each node and code which."""
        slot = np.full(n_nodes, -1, np.int64)
        slot[split] = np.arange(len(split))
        group = np.zeros(len(split), np.int64)
        child = np.zeros((len(split), self.stride), np.int32)
        code = np.arange(self.stride)
        for i, node in enumerate(split):
            group[i], bins, size = self.place[feature[node]]
            child[i] = left[node] + (code // size % bins > cut[node])
        child = child.reshape(-1)
        for span, codes in zip(self.spans, self.codes, strict=True):
            at = self.at[span]
            mine = slot[at]
            rows = np.flatnonzero(mine >= 0)
            mine = mine[rows]
            found = codes.reshape(-1).take(group[mine] * codes.shape[1] + rows)
            at[rows] = child.take(mine * self.stride + found)

    def closed(self, residual: np.ndarray, chosen: np.ndarray, feature: list[int], cut: list[int], left: list[int], right: list[int]) -> dict[str, np.ndarray]:
        """The nodes with rows, sum and squares of their residuals, unrounded."""
        at, r = self.at[chosen], residual[chosen]
        (stats,) = self.summed(np.stack([np.bincount(at, w, len(feature)) for w in (None, r, r * r)]).astype(float))
        for node in range(len(feature) - 1, -1, -1):  # children come after their parents
            if feature[node] >= 0:
                stats[:, node] = stats[:, left[node]] + stats[:, right[node]]
        tree = {"feature": feature, "cut": cut, "left": left, "right": right}
        return {k: np.array(v) for k, v in tree.items()} | dict(zip(("rows", "sum", "squares"), stats, strict=True))


def _as_model(spark: SparkSession, estimator: GBTClassifier, grown: pd.DataFrame, n_features: int) -> GBTClassificationModel:
    """The trees as MLlib's model: written in the layout of its saved models and loaded from there."""
    java = estimator._to_java()
    params = {p.name: estimator.getOrDefault(p) for p in estimator.params if estimator.isSet(p)}
    defaults = {p.name: estimator.getOrDefault(p) for p in estimator.params if estimator.hasDefault(p) and not estimator.isSet(p)}
    about = {"timestamp": 0, "sparkVersion": spark.version}
    own = {k: v for k, v in (defaults | params).items() if k in ("featuresCol", "labelCol", "maxDepth", "seed")}
    tree = about | {"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", "paramMap": own, "defaultParamMap": {"impurity": "variance"}}
    n_trees = int(grown["tree"].max()) + 1
    head = about | {"class": "org.apache.spark.ml.classification.GBTClassificationModel", "uid": java.uid(), "paramMap": params, "defaultParamMap": defaults, "numFeatures": n_features, "numTrees": n_trees}

    nodes = []
    # in the saved layout nodes are in preorder
    for t, part in grown.groupby("tree"):
        rows, order, todo = list(part.itertuples(index=False)), [], [0]
        while todo:
            order.append(k := todo.pop())
            if rows[k].feature >= 0:
                todo += [rows[k].right, rows[k].left]
        number = {k: i for i, k in enumerate(order)}
        impurity = [r.squares / r.rows - (r.sum / r.rows) ** 2 if r.rows else 0.0 for r in rows]
        for k in order:
            r, gain, split, children = rows[k], -1.0, (-1, [], -1), (-1, -1)
            if r.feature >= 0:
                a, b = rows[r.left], rows[r.right]
                gain = impurity[k] - (a.rows * impurity[r.left] + b.rows * impurity[r.right]) / r.rows
                split, children = (int(r.feature), [float(r.threshold)], -1), (number[r.left], number[r.right])
            stats = [float(r.rows), float(r.sum), float(r.squares)]
            nodes.append((int(t), (number[k], float(r.sum / r.rows if r.rows else 0.0), float(impurity[k]), stats, int(r.rows), float(gain), *children, split)))

    path = scratch_path(spark, "gbt")
    spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    trees = [(t, json.dumps(tree | {"uid": f"{java.uid()}_{t}"}), estimator.getStepSize() if t else 1.0) for t in range(n_trees)]
    spark.createDataFrame(trees, "_1 int, _2 string, _3 double").write.parquet(f"{path}/treesMetadata")
    split_kind = "struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>"
    kind = f"struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,leftChild:int,rightChild:int,split:{split_kind}>"
    spark.createDataFrame(nodes, f"treeID int, nodeData {kind}").write.parquet(f"{path}/data")
    return GBTClassificationModel.load(path)
