"""Image scans and fetches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.imagebytes import header_size
from ..operators.chunks import in_chunks
from ..operators.joins import skew_join

IMAGE_GLOB = "*.{jpg,jpeg,JPG,JPEG,png,webp,avif}"
PHOTO_GLOB = "*.{jpg,jpeg,JPG,JPEG}"
#: Splits of image files, of a few dozen each, that share a task.
SPLITS_PER_TASK = 16
OUTCOME = "identifier string, image_url string, ok boolean, error string, elapsed double, content binary"


def grouped(scan: DataFrame) -> DataFrame:
    """A scan of many small files in fewer tasks: a task of a few dozen files takes longer to start than to run."""
    splits, parallel = scan.rdd.getNumPartitions(), scan.sparkSession.sparkContext.defaultParallelism
    tasks = max(4 * parallel, -(-splits // SPLITS_PER_TASK))
    return scan.coalesce(tasks) if tasks < splits else scan


def scan_images(spark: SparkSession, path: str, glob: str = IMAGE_GLOB) -> DataFrame:
    """Encoded image files: (path, name, content)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return grouped(files.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), "content"
    ))


def decode_image_files(spark: SparkSession, path: str, glob: str = IMAGE_GLOB) -> DataFrame:
    """Decoded images (path, width, height, n_channels, data); files that do not
    decode are left out.  ``data`` is row-wise BGR as the image source gives it."""
    reader = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", glob)
    return grouped(reader.load(path).select(
        F.col("image.origin").alias("path"),
        F.col("image.width").alias("width"),
        F.col("image.height").alias("height"),
        F.col("image.nChannels").alias("n_channels"),
        F.col("image.data").alias("data"),
    ))


def decode_contents(df: DataFrame, decoder: Callable, content: str = "content", rows: int = 32) -> DataFrame:
    """Decoded images (identifier, width, height, n_channels, data) from a bytes
    column through a user decoder; ``decoder(bytes)`` returns (width, height,
    channels, data) with BGR order, or raises for what it cannot read."""

    def one(item):
        try:
            return decoder(item)
        except Exception:  # an unreadable image is left out
            return None

    def run(frames):
        import pandas as pd

        for pdf in frames:
            for start in range(0, len(pdf), rows):
                part = pdf.iloc[start : start + rows]
                found = [(k, *d) for k, d in zip(part["identifier"], map(one, part[content])) if d is not None]
                yield pd.DataFrame(found, columns=["identifier", "width", "height", "n_channels", "data"])

    return df.select("identifier", content).mapInPandas(
        run, "identifier string, width int, height int, n_channels int, data binary"
    )


def image_size(spark: SparkSession, path: str, glob: str = IMAGE_GLOB) -> DataFrame:
    """(path, width, height) of decodable images."""
    return decode_image_files(spark, path, glob).select("path", "width", "height")


def probe_sizes(df: DataFrame, content: str = "content") -> DataFrame:
    """Add width and height from the header bytes of a content column."""
    width, height = header_size(content)
    return df.withColumns({"original_width": width, "original_height": height})


def url_fetcher(timeout: float = K.FETCH_TIMEOUT_SECONDS) -> Callable[[str], bytes]:
    """Fetch function on the standard library; any error status raises."""

    def fetch(url: str) -> bytes:
        from urllib.request import urlopen

        with urlopen(url, timeout=timeout) as response:
            return response.read()

    return fetch


def fetch_images(
    links: DataFrame,
    fetch: Callable[[str], bytes] | None = None,
    threads: int = K.FETCH_THREADS,
    partitions: int | None = None,
    max_attempts: int = 1,
    per_host: int | None = None,
) -> DataFrame:
    """Fetch outcome per distinct image (identifier, image_url).

    Every URL is fetched once however many links share it, and URLs are spread
    by hash, so neither a popular URL nor a popular host lands in one task.  A
    small thread pool inside each Arrow batch hides network waits.  The result
    depends on the network: pass it through ``durable`` or write it before
    reading it twice.

    ``per_host`` bounds the requests that a host gets at the same time: its URLs
    are dealt into so many lanes, a lane is in one task, and one thread after the
    other works on it.  A host that has a third of all URLs thus has as many tasks
    as lanes.
    """
    fetch = fetch or url_fetcher()
    rows = links.select("identifier", "image_url")
    if partitions and not per_host:
        # one exchange by identifier serves the removal of copies too
        rows = rows.repartition(partitions, "identifier")
    spread = rows.dropDuplicates(["identifier", "image_url"])
    if per_host:
        host = F.regexp_extract("image_url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
        lane = F.pmod(F.xxhash64("image_url"), F.lit(per_host))
        spread = spread.withColumn("lane", F.xxhash64(F.lower(host), lane))
        spread = spread.repartition(partitions, "lane") if partitions else spread.repartition("lane")

    def one(url: str):
        import time

        start = time.monotonic()
        error = None
        for _ in range(max_attempts):
            try:
                return True, None, time.monotonic() - start, fetch(url)
            except Exception as e:  # the outcome records the failure
                error = str(e)
        return False, error, time.monotonic() - start, None

    def run(frames):
        from concurrent.futures import ThreadPoolExecutor

        def in_lanes(pool, part) -> list:
            """Outcomes in the order of the rows; the rows of a lane one after another."""
            lanes: dict = {}
            for at, lane in enumerate(part["lane"]):
                lanes.setdefault(lane, []).append(at)
            urls, found = part["image_url"].tolist(), [None] * len(part)
            for places, outcomes in pool.map(lambda own: (own, [one(urls[i]) for i in own]), lanes.values()):
                for i, outcome in zip(places, outcomes):
                    found[i] = outcome
            return found

        with ThreadPoolExecutor(threads) as pool:
            for pdf in frames:
                # image bytes are large: hand them on a few at a time
                for start in range(0, len(pdf), 4 * threads):
                    part = pdf.iloc[start : start + 4 * threads]
                    outcomes = in_lanes(pool, part) if per_host else list(pool.map(one, part["image_url"]))
                    part = part[["identifier", "image_url"]]
                    yield part.assign(
                        **{name: [o[i] for o in outcomes] for i, name in enumerate(["ok", "error", "elapsed", "content"])}
                    )

    return spread.mapInPandas(run, OUTCOME)


def fetch_in_chunks(
    links: DataFrame,
    path: str,
    fetch: Callable[[str], bytes] | None = None,
    chunk: int = K.CHUNK_ROWS,
    **how,
) -> DataFrame:
    """Fetch outcomes with header sizes, kept chunk by chunk under ``path``.

    Links are read once, dealt into chunks of about ``chunk`` by a hash of the
    identifier, and a finished chunk is never fetched again (``in_chunks``): a run
    that died goes on where it stopped, without the links.  An outcome whose bytes
    are no image counts as failed.
    """
    known = F.col("original_width").isNotNull()

    def step(own: DataFrame) -> DataFrame:
        sized = probe_sizes(fetch_images(own, fetch, **how))
        error = F.when(F.col("ok") & ~known, F.lit("cannot identify image file")).otherwise(F.col("error"))
        return sized.withColumns({"error": error, "ok": F.col("ok") & known})

    distinct = links.select(*[F.col(c).cast("string").alias(c) for c in ("identifier", "image_url")]).distinct()
    return in_chunks(distinct, "identifier", path, step, chunk, f"{OUTCOME}, original_width int, original_height int")


def join_local_images(links: DataFrame, files: DataFrame, file_name) -> DataFrame:
    """Offline stand-in for a fetch: outcomes from image files already on disk.

    ``file_name`` is a column of the link giving the file name.
    """
    named = links.select("identifier", "image_url", file_name.alias("name")).distinct()
    joined = skew_join(named, files.select("name", "content"), "name")
    return joined.select(
        "identifier",
        "image_url",
        F.col("content").isNotNull().alias("ok"),
        F.when(F.col("content").isNull(), F.lit("404 file not found")).alias("error"),
        F.lit(0.0).alias("elapsed"),
        "content",
    )
