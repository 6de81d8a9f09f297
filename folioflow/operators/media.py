"""Media of documents as rows: name, mime, bytes; references rewritten by join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as T


def from_data_uris(urls: DataFrame, url: str = "url") -> DataFrame:
    """urls with mime and bytes of base64 data addresses; others have nulls."""
    part = lambda k: F.regexp_extract(url, r"^data:([^;,]*)(?:;[^;,]*)*;base64,(.*)$", k)
    data = F.try_to_binary(F.when(F.startswith(url, F.lit("data:")), part(2)), F.lit("base64"))
    return urls.withColumn("mime", F.when(data.isNotNull(), F.when(part(1) == "", "text/plain").otherwise(part(1)))).withColumn("bytes", data)


def content_addressed(media: DataFrame) -> DataFrame:
    """media with path: the name itself if it is a safe relative path, else its content's digest and extension."""
    unsafe = F.col("name").rlike(r"^/|^[A-Za-z][A-Za-z0-9+.-]*:|(^|/)\.\.(/|$)|\\")
    return media.withColumn("path", F.when(unsafe, T.content_name(F.col("mime"), F.col("bytes"))).otherwise(F.col("name")))


def rewrite(links: DataFrame, media: DataFrame, folder: str, url: str = "url") -> DataFrame:
    """links whose url names an item point into the folder; media: one row a name."""
    to = media.select(F.col("name").alias(url), F.concat(F.lit(folder.rstrip("/") + "/"), F.col("path")).alias("_to"))
    return links.join(to, url, "left").withColumn(url, F.coalesce("_to", url)).drop("_to")


def missing(links: DataFrame, media: DataFrame, url: str = "url") -> DataFrame:
    """The local references that no item holds yet, each once."""
    local = links.filter(~F.col(url).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^//|^#") & (F.col(url) != "")).select(url).distinct()
    return local.join(media.select(F.col("name").alias(url)).distinct(), url, "left_anti")


def image_size(images: DataFrame, content: str = "bytes") -> DataFrame:
    """images with width and height of PNG and GIF files, read from the header bytes; null for others."""
    n = lambda at, size: F.conv(F.hex(F.substring(content, at, size)), 16, 10).cast("long")
    little = lambda at: n(at, 1) + 256 * n(at + 1, 1)
    head = F.hex(F.substring(content, 1, 4))
    w = F.when(head == "89504E47", n(17, 4)).when(head == "47494638", little(7))
    h = F.when(head == "89504E47", n(21, 4)).when(head == "47494638", little(9))
    return images.withColumn("width", w).withColumn("height", h)
