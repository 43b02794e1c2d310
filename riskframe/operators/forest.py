"""Random forest learner for large tables (ML1).

The classification forest of Spark ML (Poisson bags, a random subset of the
features at every node, Gini gain over binned features, class weights) grown
level by level. Rows are binned once, to one byte a feature, and packed into
blocks; a level is one pass in which a task finds the node of its rows in its
trees and counts (node, feature, bin, class) with numpy, and one grouping by
tree that adds the counts and picks the splits. A task holds the blocks of one part and
the counts of one tree; few parts are passed by several tasks, each for its share of
the trees. The driver holds the trees. Bags and subsets are
drawn anew in every pass from seeds, so nothing of the size rows x trees is
kept. As in Spark, leaves of one split that predict the same are joined at the end. Candidate splits come from all rows: every value of a feature with few
values, else approximate quantiles.

The result is an ordinary ``RandomForestClassificationModel``.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col
from ..functions.sizing import PART_ROWS
from ..session import materialize, shared_folder

BINS = 32                  # Spark's default for maxBins
LARGE_ROWS = 50_000        # up to so many Spark's own learner, whose passes cost less to start
BLOCK_ROWS = 1 << 15
TASKS = 3                  # a core's tasks of a pass, at least: one waits less for the last
ACCURACY = 10_000          # of the quantiles that cut a feature of many values
PARAMS = {"numTrees", "maxDepth", "seed", "featureSubsetStrategy", "maxMemoryInMB", "cacheNodeIds"}   # that the learner knows


def _poisson_table() -> np.ndarray:
    """Poisson(1) by a number of 16 bits."""
    upto = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])
    return np.searchsorted(upto, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def _subsets(seed: int, tree: int, level: int, nodes: int, n_features: int, width: int) -> np.ndarray:
    """The features that each open node of a level may split on."""
    order = np.random.default_rng([seed, tree, level, 1]).random((nodes, n_features)).argsort(axis=1, kind="stable")
    return order[:, :width]


def _candidates(data: DataFrame, names: Sequence[str]) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """Ascending thresholds of every feature (x <= t goes left), and the rows per label."""
    def few(batches):
        seen: list = [np.empty(0)] * len(names)
        for batch in batches:
            for j in range(len(names)):
                if len(seen[j]) <= BINS:
                    x = batch.column(j)
                    values = x.to_numpy(zero_copy_only=False)
                    if x.null_count or np.isnan(values).any():
                        raise ValueError(f"feature {j} has null or NaN values")
                    seen[j] = np.union1d(seen[j], values)[:BINS + 1]
        yield pa.RecordBatch.from_pydict({"j": pa.array([j for j, v in enumerate(seen) for _ in v], pa.int32()),
                                          "x": pa.array([float(x) for v in seen for x in v], pa.float64())})

    found = data.select(*names).mapInArrow(few, "j int, x double").distinct().groupBy("j").agg(
        F.sort_array(F.collect_list("x")).alias("x")).collect()
    values = {r["j"]: np.array(r["x"]) for r in found}
    many = [j for j in range(len(names)) if len(values.get(j, ())) > BINS]
    if many:
        at = [i / BINS for i in range(1, BINS)]
        row = data.agg(*[F.percentile_approx(names[j], at, ACCURACY).alias(f"q{j}") for j in many]).first()
        values.update({j: np.unique(row[f"q{j}"]) for j in many})
    cuts = [values[j] if j in many else (values[j][1:] + values[j][:-1]) / 2 if j in values else np.empty(0) for j in range(len(names))]
    return cuts, sorted((r["y"], r["n"]) for r in data.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect())


def _blocks(data: DataFrame, names: Sequence[str], cuts: list[np.ndarray]) -> DataFrame:
    """Stored blocks of rows: part and number (the seed of their bags), the binned
    features one after another, and the labels."""
    from pyspark import TaskContext

    def pack(batches):
        part, number, held, n = TaskContext.get().partitionId(), 0, [], 0

        def block(rows):
            table = pa.Table.from_batches(rows)
            columns = [table.column(j) for j in range(len(names))]
            if any(x.null_count or np.isnan(x.to_numpy()).any() for x in columns):
                raise ValueError("a feature has null or NaN values")
            binned = [np.searchsorted(cuts[j], x.to_numpy(), "left").astype(np.uint8) for j, x in enumerate(columns)]
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()),
                "x": pa.array([np.concatenate(binned).tobytes()], pa.binary()),
                "y": pa.array([table.column(len(names)).to_numpy().astype(np.uint8).tobytes()], pa.binary())})

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield block(held)
                number, held, n = number + 1, [], 0
        if n:
            yield block(held)

    return materialize(data.mapInArrow(pack, "part int, number int, x binary, y binary"))


def _counts(blocks: DataFrame, shares: int, level: int, trees: list[dict], n_features: int, width: int, classes: int,
            seed: int) -> DataFrame:
    """Rows (tree, counts): per part and tree the bagged rows by open node, feature, bin and class."""
    table = _poisson_table()
    upper = [[(t["feature"][d], t["bin"][d]) for d in range(level)] for t in trees]
    opened = [t["open"] for t in trees]

    def run(batches):
        rows, share = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                share = batch.column(4)[i].as_py()
                y = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint8)
                x = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint8)
                rows.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), x, y.astype(np.int32)))
        for tree in range(share, len(opened), shares):
            slots = opened[tree].astype(np.int64)
            nodes = int((slots >= 0).sum())
            if not nodes or not rows:
                continue
            chosen = _subsets(seed, tree, level, nodes, n_features, width)
            total = np.zeros(nodes * width * BINS * classes)
            for part, number, x, y in rows:
                n = len(y)
                weight = table[np.random.Generator(np.random.SFC64([seed, tree, part, number])).integers(0, 1 << 16, n, dtype=np.uint16)]
                at = np.flatnonzero(weight)
                node = np.zeros(len(at), np.int64)
                for feature, cut in upper[tree]:
                    right = x.take((feature * np.int64(n)).take(node) + at) > cut.take(node)
                    node = 2 * node + right
                slot = slots.take(node)
                if (slots < 0).any():
                    kept = np.flatnonzero(slot >= 0)
                    slot, at = slot.take(kept), at.take(kept)
                start = slot * (width * BINS * classes) + y.take(at)
                index = np.empty((width, len(at)), np.int64)
                for s in range(width):
                    bins = x.take((chosen[:, s] * n).take(slot) + at)
                    np.multiply(bins, classes, out=index[s], casting="unsafe", dtype=np.int64)
                    index[s] += start
                    index[s] += s * BINS * classes
                total += np.bincount(index.ravel(), np.tile(weight.take(at).astype(np.float64), width), len(total))
            yield pa.RecordBatch.from_pydict({"tree": pa.array([tree], pa.int32()),
                                              "counts": pa.array([total.astype(np.uint32).tobytes()], pa.binary())})

    # the stored parts once for every share: read again, not moved
    each = [blocks.withColumn("share", F.lit(i)) for i in range(shares)]
    return reduce(DataFrame.union, each).mapInArrow(run, "tree int, counts binary")


def _gini(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Impurity and weight of counts by class (last axis)."""
    weight = counts.sum(axis=-1)
    share = counts / np.where(weight > 0, weight, 1)[..., None]
    return np.where(weight > 0, 1 - (share * share).sum(axis=-1), 0.0), weight


def _best(counts: DataFrame, level: int, n_features: int, width: int, classes: int, class_weight: np.ndarray, seed: int) -> DataFrame:
    """One row per tree: the best split of each open node (feature -1: none) with the
    raw counts of the node and of its left side."""
    def pick(key, rows):
        tree = key[0].as_py()
        total = sum(np.frombuffer(c.as_buffer(), np.uint32).astype(np.int64) for c in rows["counts"])
        total = total.reshape(-1, width, BINS, classes)
        chosen = _subsets(seed, tree, level, len(total), n_features, width)
        left = total.cumsum(axis=2)
        whole = left[:, 0, -1]                                          # node, class
        other = whole[:, None, None] - left
        impurity, weight = _gini(whole * class_weight)
        parts = [_gini(side * class_weight) for side in (left, other)]
        gain = impurity[:, None, None] - sum(i * w for i, w in parts) / np.where(weight > 0, weight, 1)[:, None, None]
        gain[(left.sum(axis=-1) == 0) | (other.sum(axis=-1) == 0)] = -1.0
        flat = gain.reshape(len(total), -1)
        at = flat.argmax(axis=1)
        node = np.arange(len(total))
        best, s, b = flat[node, at], at // BINS, at % BINS
        feature = np.where(best > 0, chosen[node, s], -1)
        return pa.table({"tree": pa.array([tree], pa.int32()), "feature": [feature.tolist()], "bin": [b.tolist()],
                         "gain": [best.tolist()], "whole": [whole.ravel().tolist()], "left": [left[node, s, b].ravel().tolist()]})

    # a number of partitions of our own: picking is work, and small counts would be coalesced into one task
    par = counts.sparkSession.sparkContext.defaultParallelism
    return counts.repartition(par, "tree").groupBy("tree").applyInArrow(
        pick, "tree int, feature array<bigint>, bin array<bigint>, gain array<double>, whole array<bigint>, left array<bigint>")


def _grow(blocks: DataFrame, shares: int, n_trees: int, depth: int, n_features: int, classes: int, class_weight: np.ndarray, seed: int) -> list[dict]:
    """The trees: per tree its ``nodes`` (level, position) -> (raw counts, split or None)."""
    width = math.ceil(math.sqrt(n_features))
    trees = [{"feature": [], "bin": [], "open": np.zeros(1, np.int32), "nodes": {}} for _ in range(n_trees)]
    for level in range(depth):
        found = _best(_counts(blocks, shares, level, trees, n_features, width, classes, seed), level, n_features, width, classes, class_weight, seed)
        for r in found.collect():
            tree = trees[r["tree"]]
            position = np.flatnonzero(tree["open"] >= 0)                # the slots are in this order
            whole, left = (np.array(r[c], np.int64).reshape(-1, classes) for c in ("whole", "left"))
            # a node that does not split sends its rows left, where nothing is open
            feature, cut = np.zeros(1 << level, np.int16), np.full(1 << level, 255, np.uint8)
            split = np.zeros(2 << level, bool)
            for i, p in enumerate(position.tolist()):
                f, b = r["feature"][i], r["bin"][i]
                if f < 0:
                    tree["nodes"][level, p] = whole[i], None
                    continue
                tree["nodes"][level, p] = whole[i], (f, b, r["gain"][i])
                feature[p], cut[p] = f, b
                for child, counts in ((2 * p, left[i]), (2 * p + 1, whole[i] - left[i])):
                    tree["nodes"][level + 1, child] = counts, None
                    split[child] = level + 1 < depth and (counts > 0).sum() > 1
            tree["feature"].append(feature)
            tree["bin"].append(cut)
            tree["open"] = np.where(split, np.cumsum(split) - 1, -1).astype(np.int32)
        done = [t for t in trees if len(t["feature"]) <= level]
        for tree in done:                                                # nothing was open
            tree["feature"].append(np.zeros(1 << level, np.int16))
            tree["bin"].append(np.full(1 << level, 255, np.uint8))
            tree["open"] = np.full(2 << level, -1, np.int32)
        if len(done) == n_trees:
            break
    return trees


def _pruned(tree: dict, class_weight: np.ndarray) -> None:
    """Join the two leaves of a split that predict the same class, from the lowest level up."""
    nodes = tree["nodes"]
    for level, p in sorted(nodes, reverse=True):
        counts, split = nodes[level, p]
        if split is None:
            continue
        below = [nodes[level + 1, 2 * p], nodes[level + 1, 2 * p + 1]]
        if all(x[1] is None for x in below) and len({int(np.argmax(x[0] * class_weight)) for x in below}) == 1:
            nodes[level, p] = counts, None


def _node_table(trees: list[dict], cuts: list[np.ndarray], class_weight: np.ndarray) -> pa.Table:
    """The nodes in the form Spark stores a forest in: numbered in preorder."""
    rows: dict[str, list] = {c: [] for c in ("tree", "id", "impurity", "stats", "raw", "gain", "left", "right", "feature", "cut")}
    for number, tree in enumerate(trees):
        _pruned(tree, class_weight)
        order, stack = [], [(0, 0)]
        while stack:
            level, p = stack.pop()
            order.append((level, p))
            if tree["nodes"][level, p][1] is not None:
                stack += [(level + 1, 2 * p + 1), (level + 1, 2 * p)]
        ids = {node: i for i, node in enumerate(order)}
        counts = np.array([tree["nodes"][node][0] for node in order])
        rows["tree"] += [number] * len(order)
        rows["id"] += range(len(order))
        rows["impurity"] += _gini(counts * class_weight)[0].tolist()
        rows["stats"] += (counts * class_weight).tolist()
        rows["raw"] += counts.sum(axis=1).tolist()
        for level, p in order:
            f, b, gain = tree["nodes"][level, p][1] or (-1, 0, -1.0)
            rows["gain"].append(gain)
            rows["left"].append(-1 if f < 0 else ids[level + 1, 2 * p])
            rows["right"].append(-1 if f < 0 else ids[level + 1, 2 * p + 1])
            rows["feature"].append(f)
            rows["cut"].append([] if f < 0 else [float(cuts[f][b])])
    rows["prediction"] = [float(np.argmax(s)) for s in rows["stats"]]
    ints = {"tree", "id", "left", "right", "feature"}
    types = {c: pa.int32() if c in ints else pa.int64() if c == "raw" else pa.list_(pa.float64()) if c in ("stats", "cut") else pa.float64()
             for c in rows}
    return pa.table({c: pa.array(v, types[c]) for c, v in rows.items()})


def _model(spark, est, nodes: pa.Table, n_trees: int, n_features: int, classes: int):
    """The trees as a model of Spark ML, by way of its storage format."""
    from pyspark.ml.classification import RandomForestClassificationModel

    def described(kind, own, default, **more):
        return json.dumps({"class": f"org.apache.spark.ml.classification.{kind}", "timestamp": int(time.time() * 1000),
                           "sparkVersion": spark.version, "uid": f"{kind}_{uuid.uuid4().hex[:12]}", "paramMap": own,
                           "defaultParamMap": default, **more})

    own, default = ({p.name: v for p, v in m.items()} for m in (est._paramMap, est._defaultParamMap))
    path = shared_folder(spark, "forest")
    forest = described("RandomForestClassificationModel", own, default, numFeatures=n_features, numClasses=classes, numTrees=n_trees)
    spark.createDataFrame([(forest,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    tree = {c: own[c] for c in ("maxDepth", "seed") if c in own}
    spark.createDataFrame([(i, described("DecisionTreeClassificationModel", tree, {}), 1.0) for i in range(n_trees)],
                          "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    split = F.struct(F.col("feature").alias("featureIndex"), F.col("cut").alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    data = F.struct("id", "prediction", "impurity", F.col("stats").alias("impurityStats"), F.col("raw").alias("rawCount"), "gain",
                    F.col("left").alias("leftChild"), F.col("right").alias("rightChild"), split.alias("split"))
    spark.createDataFrame(nodes).select(F.col("tree").alias("treeID"), data.alias("nodeData")).write.parquet(f"{path}/data")
    return RandomForestClassificationModel.load(path)


def fit_forest(est, df: DataFrame, features: Sequence[str], label: str, balanced: bool):
    """Fit the forest that the ``RandomForestClassifier`` ``est`` describes."""
    names = [f"f{j}" for j in range(len(features))]
    data = df.select(*[col(f).cast("double").alias(n) for f, n in zip(features, names)], col(label).cast("int").alias("y"))
    cuts, sizes = _candidates(data, names)
    rows = sum(n for _, n in sizes)
    if not rows or any(y is None or not 0 <= y < 256 for y, _ in sizes):
        raise ValueError("a forest needs rows, and labels from 0")
    classes = max(2, max(y for y, _ in sizes) + 1)
    class_weight = np.ones(classes)
    if balanced:
        class_weight[[y for y, _ in sizes]] = [rows / (len(sizes) * n) for _, n in sizes]
    n_trees, seed = est.getNumTrees(), est.getSeed() & ((1 << 63) - 1)
    par = df.sparkSession.sparkContext.defaultParallelism
    parts = -(-rows // PART_ROWS)
    parts = parts if parts < par else -(-parts // par) * par
    shares = min(n_trees, max(1, -(-TASKS * par // parts)))
    blocks = _blocks(data.repartition(parts), names, cuts)
    trees = _grow(blocks, shares, n_trees, est.getMaxDepth(), len(features), classes, class_weight, seed)
    return _model(df.sparkSession, est, _node_table(trees, cuts, class_weight), n_trees, len(features), classes)


def is_forest(model) -> bool:
    from pyspark.ml.classification import RandomForestClassificationModel
    return isinstance(model, RandomForestClassificationModel) and model.numClasses == 2


def _read(model, spark) -> tuple[list[np.ndarray], list[tuple]]:
    """The thresholds of every feature, and per tree its depth, node arrays (feature,
    place of the threshold, left and right child; a leaf is its own child) and votes."""
    path = shared_folder(spark, "forest")
    model.write().save(path)
    split = "nodeData.split"
    t = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
        F.col(f"{split}.featureIndex").alias("feature"), F.get(f"{split}.leftCategoriesOrThreshold", F.lit(0)).alias("cut"),
        F.col("nodeData.impurityStats")[0].alias("n0"), F.col("nodeData.impurityStats")[1].alias("n1")).toPandas().sort_values(["treeID", "id"])
    inner = t[t["left"] >= 0]
    cuts = [np.unique(inner["cut"][inner["feature"] == j].to_numpy()) for j in range(model.numFeatures)]
    trees = []
    for _, rows in t.groupby("treeID", sort=True):
        leaf, number = (rows["left"] < 0).to_numpy(), np.arange(len(rows))
        feature = np.where(leaf, 0, rows["feature"].to_numpy()).astype(np.int64)
        cut = np.array([0 if end else np.searchsorted(cuts[f], c) for end, f, c in zip(leaf, feature, rows["cut"])], np.int64)
        left, right = (np.where(leaf, number, rows[side].to_numpy()).astype(np.int64) for side in ("left", "right"))
        depth, open_ = 0, np.zeros(1, np.int64)
        while not leaf[open_].all():
            open_ = np.concatenate([left[open_[~leaf[open_]]], right[open_[~leaf[open_]]]])
            depth += 1
        n0, n1 = rows["n0"].to_numpy(), rows["n1"].to_numpy()
        total = np.where(n0 + n1 > 0, n0 + n1, 1)
        trees.append((depth, feature, cut, np.column_stack([left, right]).ravel(), n0 / total, n1 / total))
    return cuts, trees


def variant_scores(model, perm: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Rows (repeat, label, _j, _score) of ``perm`` (repeat, label, _score, the features and
    the donors' ``_d_0``, ...): the row's probability with feature j from its donor. A
    variant whose value lies between the same thresholds as the row's own takes
    the row's ``_score``; the votes of the others are added tree by tree, as Spark does."""
    cuts, trees = _read(model, perm.sparkSession)
    n_features = len(features)
    rows = perm.select(col("repeat").cast("int"), col(label).cast("int"), "_score", *[col(f).cast("double").alias(f"f{j}") for j, f in enumerate(features)],
                       *[F.col(f"_d_{j}").cast("double").alias(f"d{j}") for j in range(n_features)])

    def probability(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        flat, row = x.ravel(), np.arange(n)
        votes = np.zeros((2, n))
        for depth, feature, cut, child, v0, v1 in trees:
            node, start = np.zeros(n, np.int64), feature * n
            for _ in range(depth):
                node = child.take(2 * node + (flat.take(start.take(node) + row) > cut.take(node)))
            votes[0] += v0.take(node)
            votes[1] += v1.take(node)
        return votes[1] / (votes[0] + votes[1])

    def run(batches):
        for batch in batches:
            values = [batch.column(3 + j).to_numpy() for j in range(2 * n_features)]
            x, d = (np.stack([np.searchsorted(cuts[j], values[at + j], "left").astype(np.int32) for j in range(n_features)])
                    for at in (0, n_features))
            for j in range(n_features):
                score = batch.column(2).to_numpy().copy()
                new = np.flatnonzero(x[j] != d[j])
                if len(new):
                    variant = x[:, new]
                    variant[j] = d[j, new]
                    score[new] = probability(variant)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(score), j, np.int32)),
                                                  pa.array(score)], ["repeat", "label", "_j", "_score"])

    return rows.mapInArrow(run, "repeat int, label int, _j int, _score double").withColumnRenamed("label", label)
