"""Model hooks: batched inference over columns of a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_batches
from .chunks import in_chunks

EVAL_BATCH = 16
EMBED_BATCH = 32
#: Rows whose results are kept together.
CHUNK = 100_000


def batch_predict(
    df: DataFrame,
    make_predict: Callable,
    inputs: list[str],
    output: str,
    return_type,
    batch_size: int = EVAL_BATCH,
    input_shapes=None,
) -> DataFrame:
    """Run a user model over the table.

    ``make_predict()`` loads the model once per Python worker and returns the
    batch function; it receives one numpy array per input column.
    ``return_type`` is a Spark data type object.
    """
    predict = predict_batch_udf(
        make_predict, return_type=return_type, batch_size=batch_size, input_tensor_shapes=input_shapes
    )
    # declared non-deterministic so that a filter on the output does not run the model again
    return df.withColumn(output, predict.asNondeterministic()(*[F.col(c) for c in inputs]))


def embed_images(
    images: DataFrame, make_encoder: Callable, content: str = "content", batch_size: int = EMBED_BATCH
) -> DataFrame:
    """Add ``embedding`` (array<float>) from image bytes.

    ``make_encoder()`` returns a function from a list of bytes to a list of
    vectors, None for an image it cannot decode.
    """
    small_batches(images.sparkSession)
    names = [f"{f.name} {f.dataType.simpleString()}" for f in images.schema.fields]
    schema = ", ".join([*names, "embedding array<float>"])

    def run(frames):
        encode = make_encoder()
        for pdf in frames:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start : start + batch_size]
                yield part.assign(embedding=list(encode(list(part[content]))))

    return images.mapInPandas(run, schema)


def run_model(
    df: DataFrame, make_model: Callable, inputs: list[str], outputs: str, keep: list[str], batch_size: int = EVAL_BATCH
) -> DataFrame:
    """``keep`` columns, the ``outputs`` (a schema) of a user model, and ``error``.

    ``make_model()`` loads the model once per task and returns a function from a
    list of input tuples to a list of output tuples.  A batch that fails is tried
    row by row, so one bad row costs only itself: its outputs are null and
    ``error`` has the text.  A model that gives another number of rows than it
    got fails the batch the same way.
    """
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields]
    names = [part.split()[0] for part in outputs.split(", ")]

    def run(frames):
        import pandas as pd

        model = make_model()

        def tried(rows: list[tuple]) -> list[tuple]:
            try:
                found = list(model(rows))
                if len(found) != len(rows):
                    raise ValueError(f"{len(found)} results for {len(rows)} rows")
                return [(*(f if isinstance(f, tuple) else (f,)), None) for f in found]
            except Exception as e:  # the rows that are not to blame go on
                if len(rows) == 1:
                    return [(*[None] * len(names), str(e) or type(e).__name__)]
                return [out for row in rows for out in tried([row])]

        for pdf in frames:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start : start + batch_size]
                found = pd.DataFrame(tried(list(part[inputs].itertuples(index=False, name=None))), columns=[*names, "error"], dtype=object)
                yield pd.concat([part[keep].reset_index(drop=True), found], axis=1)

    needed = list(dict.fromkeys([*keep, *inputs]))
    return df.select(*needed).mapInPandas(run, ", ".join([*kept, outputs, "error string"]))


def infer_in_chunks(
    df: DataFrame, key: str, path: str, make_model: Callable, inputs: list[str], outputs: str,
    batch_size: int = EVAL_BATCH, chunk: int = CHUNK, done: Callable[[int], None] | None = None,
) -> DataFrame:
    """``key``, ``outputs`` and ``error`` of a user model over the whole table, kept chunk by chunk under ``path``.

    Inputs are read once and a finished chunk is never inferred again, so a run
    that died goes on with the rest (``in_chunks``).  ``done`` is called with the
    number of chunks begun so far before each one.
    """
    begun = [0]

    def step(own: DataFrame) -> DataFrame:
        if done:
            done(begun[0])
        begun[0] += 1
        return run_model(own, make_model, inputs, outputs, [key], batch_size)

    kind = df.schema[key].dataType.simpleString()
    return in_chunks(df.select(*dict.fromkeys([key, *inputs])), key, path, step, chunk, f"{key} {kind}, {outputs}, error string")
