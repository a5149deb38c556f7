"""Request table to reply table as a stream of micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extract_reply
from ..operators.corpus import prepare_requests

REQUEST = "request_id string, message string, image string"


def serve_stream(
    spark: SparkSession,
    requests: str,
    replies: str,
    checkpoint: str,
    predict: Callable[[DataFrame], DataFrame],
    extract: bool = False,
):
    """Answer all waiting requests of a JSON-lines folder, then stop.

    ``predict`` adds a column ``reply`` to (request_id, prompt, image_bytes, error).
    With ``extract`` the reply is cut out of the decoded conversation.  A request
    whose image does not decode is answered with the error.
    """
    incoming = spark.readStream.schema(REQUEST).json(requests)
    answered = predict(prepare_requests(incoming))
    text = extract_reply("reply") if extract else F.col("reply")
    query = (
        answered.select("request_id", F.coalesce("error", text).alias("response"))
        .writeStream.format("parquet")
        .option("path", replies)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
