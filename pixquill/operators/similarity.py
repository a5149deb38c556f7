"""Embedding classification against a label taxonomy, pooling, cosine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..session import materialize

#: Bytes of labels, as doubles, that all tasks get at once; more labels are met in blocks of about so many.
LABEL_BYTES_LIMIT = 256 * 1024 * 1024
#: Scores held at once by a task: rows are taken in slices against slices of labels.
SLICE_SCORES = 4_000_000
SLICE_LABELS = 4096
TEMPERATURE = 100.0
STATE = "top: array<struct<label: string, logit: double>>, peak: double, mass: double"


def cosine_to(df: DataFrame, reference: DataFrame, column: str = "embedding", name: str = "cosine") -> DataFrame:
    """Cosine similarity to the one vector held by ``reference`` (a one-row,
    one-column table, passed as a scalar subquery)."""
    target = reference.select(F.col(reference.columns[0]).alias("_r")).scalar()
    paired = df.withColumn("_reference", target)
    return paired.withColumn(name, vectors.cosine(column, "_reference")).drop("_reference")


def last_label_wins(labels: DataFrame) -> DataFrame:
    """Per label the description of its last line."""
    return labels.groupBy("label").agg(F.max_by("description", "line_no").alias("description"))


def label_centroids(df: DataFrame, label: str = "label", column: str = "embedding") -> DataFrame:
    """Mean vector per label.  Sums are combined before the shuffle per (label,
    dimension), so the size of a label does not matter."""
    dims = df.select(label, F.posexplode(column).alias("_d", "_x"))
    means = dims.groupBy(label, "_d").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    vector = F.sort_array(F.collect_list(F.struct("_d", "_m")))
    return means.groupBy(label).agg(vector.alias("_v")).select(
        F.col(label).alias("label"), F.transform("_v", lambda s: s["_m"]).alias("embedding")
    )


def _features(usable: DataFrame):
    """Names in order and unit vectors of labels that have a direction; they come to the driver in Arrow form."""
    import numpy as np

    rows = usable.orderBy("label").select("label", F.col("embedding").cast("array<double>")).toArrow().combine_chunks()
    names = rows.column("label").to_pylist()
    if not names:
        return [], np.zeros((0, 0))
    flat = rows.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    features = flat.reshape(len(names), -1)
    return names, features / np.linalg.norm(features, axis=1, keepdims=True)


def _classify(items, features, k, slice_labels):
    """(indices and logits of the best ``k`` labels, highest logit, softmax sum below it) of each row.

    Ties go to the first label.  Labels are met slice by slice with a running
    maximum, softmax sum and top list.
    """
    import numpy as np

    x = items / np.linalg.norm(items, axis=1, keepdims=True)
    peak = np.full(len(x), -np.inf)
    mass = np.zeros(len(x))
    best = np.zeros((len(x), 0))
    which = np.zeros((len(x), 0), np.int64)
    for at in range(0, len(features), slice_labels):
        logits = TEMPERATURE * (x @ features[at : at + slice_labels].T)
        higher = np.maximum(peak, logits.max(axis=1))
        mass = mass * np.exp(peak - higher) + np.exp(logits - higher[:, None]).sum(axis=1)
        peak = higher
        known = np.concatenate([best, logits], axis=1)
        index = np.concatenate([which, np.broadcast_to(np.arange(at, at + logits.shape[1]), logits.shape)], axis=1)
        order = np.argsort(-known, axis=1, kind="stable")[:, :k]
        best, which = np.take_along_axis(known, order, 1), np.take_along_axis(index, order, 1)
    return which, best, peak, mass


def _states(items: DataFrame, column: str, labels: DataFrame, k: int, slice_labels: int):
    """(``items`` with a ``_state`` for these labels: top list, highest logit, softmax sum; what to free afterwards)."""
    names, features = _features(labels)
    if not names:
        return items.withColumn("_state", F.lit(None).cast(f"struct<{STATE}>")), None
    shared = items.sparkSession.sparkContext.broadcast((names, features))
    rows = max(1, SLICE_SCORES // min(len(names), slice_labels))

    @F.pandas_udf(f"struct<{STATE}>")
    def score(vectors_):
        import numpy as np
        import pandas as pd

        names_, features_ = shared.value
        tops, peaks, masses = [], [], []
        for at in range(0, len(vectors_), rows):
            part = np.stack(vectors_.iloc[at : at + rows].to_numpy()).astype(np.float64)
            which, logits, peak, mass = _classify(part, features_, k, slice_labels)
            tops += [[{"label": names_[j], "logit": v} for j, v in zip(js, vs)] for js, vs in zip(which.tolist(), logits.tolist())]
            peaks.append(peak)
            masses.append(mass)
        empty = np.zeros(0)
        return pd.DataFrame({
            "top": pd.Series(tops, dtype=object), "peak": np.concatenate(peaks or [empty]), "mass": np.concatenate(masses or [empty]),
        })

    # declared non-deterministic so that filters inferred from the explosion
    # later do not evaluate it a second time
    return items.withColumn("_state", score.asNondeterministic()(column)), shared


def zero_shot(
    items: DataFrame,
    labels: DataFrame,
    k: int = 1,
    key: str = "id",
    column: str = "embedding",
    slice_labels: int = SLICE_LABELS,
    block_bytes: int | None = None,
) -> DataFrame:
    """Top ``k`` labels per item by softmax of scaled cosine similarity.

    Returns (key, rank, label, confidence).  ``labels`` has a unique ``label``
    and an ``embedding``.  What has no direction has no cosine: items and labels
    whose vector is null or all zero are left out.

    Labels are broadcast as a matrix and items scored where they are, in slices
    of rows and labels.  Labels of more than ``block_bytes`` (by default
    ``LABEL_BYTES_LIMIT``) are met block by block: each block leaves a top list,
    a highest logit and a softmax sum per item under the shared folder, and these
    are put together at the end, so nothing is refused and neither driver nor task
    holds more than a block.
    """
    limit = LABEL_BYTES_LIMIT if block_bytes is None else block_bytes
    directed = lambda c: F.col(c).isNotNull() & F.exists(c, lambda x: F.coalesce(x != 0, F.lit(False)))
    present = items.where(directed(column)).select(key, column)
    usable = labels.where(F.col("label").isNotNull() & directed("embedding")).select(F.col("label").cast("string").alias("label"), "embedding")
    n, size = usable.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("embedding") * 8), F.lit(0))).first()
    blocks = max(1, min(n, -(-size // limit)))
    if blocks == 1:
        scored, _ = _states(present, column, usable, k, slice_labels)
        return _ranked(scored.select(key, F.array("_state").alias("_states")), key, k)
    # a row's number tells it from others of its key
    numbered = materialize(present.withColumn("_row", F.monotonically_increasing_id()), "items")
    block = F.pmod(F.xxhash64("label", F.lit("block")), F.lit(blocks))
    parts = []
    for i in range(blocks):
        scored, shared = _states(numbered, column, usable.where(block == i), k, slice_labels)
        parts.append(materialize(scored.where(F.col("_state").isNotNull()).select("_row", key, "_state"), "scored"))
        if shared is not None:
            shared.destroy()
    # one state per block and item
    gathered = reduce(DataFrame.unionByName, parts).groupBy("_row", key).agg(F.collect_list("_state").alias("_states"))
    return _ranked(gathered.select(key, "_states"), key, k)


def _ranked(states: DataFrame, key: str, k: int) -> DataFrame:
    """The best ``k`` labels over the states of all blocks; equal logits go by label."""
    order = lambda a, b: (
        F.when(a["logit"] > b["logit"], -1).when(a["logit"] < b["logit"], 1).when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0)
    )
    known = states.select(key, F.filter("_states", lambda s: s.isNotNull()).alias("_states")).withColumn(
        "_peak", F.array_max(F.transform("_states", lambda s: s["peak"]))
    )
    total = F.aggregate("_states", F.lit(0.0), lambda n, s: n + s["mass"] * F.exp(s["peak"] - F.col("_peak")))
    merged = F.array_sort(F.flatten(F.transform("_states", lambda s: s["top"])), order)
    top = F.when(F.size("_states") == 1, F.col("_states")[0]["top"]).otherwise(F.slice(merged, 1, k))
    return known.select(key, "_peak", total.alias("_mass"), F.posexplode(top).alias("_r", "_b")).select(
        key,
        (F.col("_r") + 1).alias("rank"),
        F.col("_b.label").alias("label"),
        (F.exp(F.col("_b.logit") - F.col("_peak")) / F.col("_mass")).alias("confidence"),
    )


def class_distribution(classified: DataFrame) -> DataFrame:
    """Items and mean confidence per label."""
    return classified.groupBy("label").agg(
        F.count(F.lit(1)).alias("items"), F.avg("confidence").alias("mean_confidence")
    )


def pool_patches(
    patches: DataFrame,
    side: int,
    n_patches: int = 64,
    image: str = "image_id",
    index: str = "patch_idx",
    column: str = "embedding",
) -> DataFrame:
    """Average-pool a ``side`` x ``side`` patch grid to (about) ``n_patches``.

    The stride is ``side // sqrt(n_patches)``; rows and columns beyond the last
    full window are left out, as in a pooling layer without padding.  A cell
    gathers stride x stride vectors.
    """
    stride = int(side // n_patches**0.5)
    cells = side // stride
    row, column_no = F.floor(F.col(index) / side), F.col(index) % side
    placed = patches.select(
        image,
        F.floor(row / stride).alias("_r"),
        F.floor(column_no / stride).alias("_c"),
        F.struct(F.col(index).alias("i"), F.col(column).alias("v")).alias("_p"),
    ).where((F.col("_r") < cells) & (F.col("_c") < cells))
    gathered = placed.groupBy(image, "_r", "_c").agg(F.sort_array(F.collect_list("_p")).alias("_ps"))
    zero = F.transform(F.element_at("_ps", 1)["v"], lambda x: F.lit(0.0))
    total = F.aggregate(
        "_ps", zero, lambda acc, p: F.zip_with(acc, p["v"], lambda a, b: a + b.cast("double"))
    )
    return gathered.select(
        image,
        (F.col("_r") * cells + F.col("_c")).cast("int").alias("cell"),
        F.transform(total, lambda x: x / F.size("_ps")).alias("embedding"),
    )
