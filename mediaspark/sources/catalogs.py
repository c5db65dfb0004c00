"""Catalogue responses, landed as JSON rows, to candidate rows.

Every reader takes a DataFrame with one catalogue item per row in a string
column and gives source, source_id, download_url, media_type, width, height,
duration, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaspark.functions.media import open_licence
from mediaspark.functions.text import url_slug

HIT_COLUMNS = ("source", "source_id", "download_url", "media_type", "width", "height", "duration", "text")


def _hit(source: str, source_id: Column, url: Column, media: Column | str, width: Column, height: Column,
         duration: Column | None, text: Column) -> list[Column]:
    media = F.lit(media) if isinstance(media, str) else media
    duration = F.lit(0.0) if duration is None else F.coalesce(duration.cast("double"), F.lit(0.0))
    return [
        F.lit(source).alias("source"), source_id.cast("string").alias("source_id"), url.alias("download_url"),
        media.alias("media_type"), F.coalesce(width.cast("int"), F.lit(0)).alias("width"),
        F.coalesce(height.cast("int"), F.lit(0)).alias("height"), duration.alias("duration"),
        F.coalesce(text, F.lit("")).alias("text"),
    ]


def _filled(*values: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def _joined(*values: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(v, F.lit("")) for v in values])


def _parsed(landed: DataFrame, schema: str, body: str) -> DataFrame:
    return landed.select(F.from_json(body, schema).alias("j"))


def pexels_videos(landed: DataFrame, body: str = "body") -> DataFrame:
    """Widest rendition, the first of equally wide ones; text from the page URL."""
    schema = "id bigint, url string, duration double, video_files array<struct<link:string,width:int,height:int>>"
    rows = _parsed(landed, schema, body)
    ranked = F.transform(
        F.coalesce("j.video_files", F.array().cast("array<struct<link:string,width:int,height:int>>")),
        lambda f, i: F.struct((-F.coalesce(f["width"], F.lit(0))).alias("w"), i.alias("i"), f.alias("f")),
    )
    rows = rows.withColumn("best", F.try_element_at(F.array_sort(ranked), F.lit(1))["f"]).where(F.col("best").isNotNull())
    return rows.select(*_hit(
        "pexels", F.col("j.id"), F.col("best.link"), "video", F.col("best.width"), F.col("best.height"),
        F.col("j.duration"), url_slug(F.coalesce("j.url", F.lit(""))),
    ))


def pixabay_videos(landed: DataFrame, body: str = "body") -> DataFrame:
    """The largest named quality that exists."""
    clip = "struct<url:string,width:int,height:int>"
    schema = f"id bigint, tags string, duration double, videos struct<large:{clip},medium:{clip},small:{clip},tiny:{clip}>"
    rows = _parsed(landed, schema, body).withColumn(
        "best", F.coalesce("j.videos.large", "j.videos.medium", "j.videos.small", "j.videos.tiny")
    ).where(F.col("best").isNotNull())
    return rows.select(*_hit(
        "pixabay", F.col("j.id"), F.col("best.url"), "video", F.col("best.width"), F.col("best.height"),
        F.col("j.duration"), F.col("j.tags"),
    ))


def pexels_images(landed: DataFrame, body: str = "body") -> DataFrame:
    schema = "id bigint, alt string, width int, height int, src struct<large2x:string,original:string>"
    rows = _parsed(landed, schema, body).withColumn("url", _filled(F.col("j.src.large2x"), F.col("j.src.original")))
    return rows.where(F.col("url").isNotNull()).select(*_hit(
        "pexels_images", F.col("j.id"), F.col("url"), "image", F.col("j.width"), F.col("j.height"), None, F.col("j.alt")
    ))


def pixabay_images(landed: DataFrame, body: str = "body") -> DataFrame:
    schema = "id bigint, tags string, largeImageURL string, imageWidth int, imageHeight int"
    rows = _parsed(landed, schema, body).where(_filled(F.col("j.largeImageURL")).isNotNull())
    return rows.select(*_hit(
        "pixabay_images", F.col("j.id"), F.col("j.largeImageURL"), "image", F.col("j.imageWidth"), F.col("j.imageHeight"),
        None, F.col("j.tags"),
    ))


def _list_or_text(raw: Column) -> Column:
    """A JSON value that is a list of strings or one string, as text."""
    as_list = F.from_json(raw, "array<string>")
    return F.when(raw.startswith("["), F.array_join(as_list, " ")).otherwise(raw)


def coverr(landed: DataFrame, body: str = "body") -> DataFrame:
    schema = (
        "id string, title string, description string, max_width int, max_height int, duration double, tags string, "
        "urls struct<mp4:string,mp4_download:string>"
    )
    rows = _parsed(landed, schema, body).withColumn("url", _filled(F.col("j.urls.mp4_download"), F.col("j.urls.mp4")))
    return rows.where(F.col("url").isNotNull()).select(*_hit(
        "coverr", F.col("j.id"), F.col("url"), "video", F.col("j.max_width"), F.col("j.max_height"), F.col("j.duration"),
        _joined(F.col("j.title"), F.col("j.description"), _list_or_text(F.col("j.tags"))),
    ))


def internet_archive(items: DataFrame, files: DataFrame, body: str = "body") -> DataFrame:
    """Items under an open licence with their first video, else first image.

    ``items``: JSON items; ``files``: identifier, pos, name, width, height,
    length (strings).  The licence is checked before the file join, and of the
    files only the best one of each item takes part in it.
    """
    schema = "identifier string, title string, description string, subject string, licenseurl string"
    docs = _parsed(items, schema, body).select("j.*").where(open_licence("licenseurl"))
    name = F.lower("name")
    kind = F.when(name.rlike(r"\.(mp4|ogv|webm)$"), 0).when(name.rlike(r"\.(jpg|jpeg|png)$"), 1)
    best = (
        files.withColumn("kind", kind).where(F.col("kind").isNotNull())
        .groupBy("identifier")
        .agg(F.min_by(F.struct("name", "width", "height", "length", "kind"), F.struct("kind", "pos")).alias("best"))
    )
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    return docs.join(best, "identifier").select(*_hit(
        "internet_archive", F.col("identifier"),
        F.concat(F.lit("https://archive.org/download/"), "identifier", F.lit("/"), "best.name"),
        F.when(F.col("best.kind") == 0, F.lit("video")).otherwise(F.lit("image")),
        number("best.width"), number("best.height"), number("best.length"),
        _joined(F.col("title"), F.col("description"), _list_or_text(F.col("subject"))),
    ))


def nasa(landed: DataFrame, body: str = "body") -> DataFrame:
    """First preview link; sizes are not known."""
    schema = "data array<struct<nasa_id:string,title:string>>, links array<struct<href:string,rel:string>>"
    rows = _parsed(landed, schema, body)
    preview = F.filter("j.links", lambda link: link["rel"] == "preview")
    rows = rows.withColumn("href", F.try_element_at(preview, F.lit(1))["href"]).withColumn(
        "first", F.try_element_at("j.data", F.lit(1))
    ).where(_filled(F.col("href")).isNotNull())
    return rows.select(*_hit(
        "nasa", F.coalesce("first.nasa_id", F.lit("")), F.col("href"), "image", F.lit(0), F.lit(0), None,
        F.col("first.title"),
    ))


def wikimedia(landed: DataFrame, body: str = "body") -> DataFrame:
    """Commons pages (a map by page) with a usable picture."""
    page = "struct<pageid:bigint,title:string,imageinfo:array<struct<url:string,width:int,height:int>>>"
    rows = landed.select(F.explode(F.from_json(body, f"map<string,{page}>")).alias("key", "p"))
    rows = rows.withColumn("info", F.try_element_at("p.imageinfo", F.lit(1)))
    rows = rows.where(F.lower("info.url").rlike(r"\.(jpe?g|png)$"))
    return rows.select(*_hit(
        "wikimedia", F.coalesce(F.col("p.pageid").cast("string"), F.col("p.title")), F.col("info.url"), "image",
        F.col("info.width"), F.col("info.height"), None, F.col("p.title"),
    ))
