"""Path and URL expressions: extensions, media types, direct-media test, manifest names, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Supported extensions.
REFERENCE_EXTS = ("png", "jpg", "jpeg", "webp", "bmp", "tiff")
IMAGE_EXTS = ("png", "jpg", "jpeg", "webp", "bmp", "gif", "tiff")
VIDEO_EXTS = ("mp4", "avi", "mov", "mkv", "webm")
SUPPORTED_EXTS = IMAGE_EXTS + VIDEO_EXTS

_EXT = r"(?:^|/)\.*[^./][^/]*\.([^./]*)$"
_URL_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"


def extension(path: Column) -> Column:
    """Lower-case extension of the last path part; empty for none and for dot files."""
    return F.lower(F.regexp_extract(path, _EXT, 1))


def media_type(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin(*IMAGE_EXTS), "image").when(ext.isin(*VIDEO_EXTS), "video").otherwise("unsupported")


def url_path(url: Column) -> Column:
    """Path of a URL without query, fragment and trailing parameters."""
    return F.regexp_replace(F.regexp_extract(url, _URL_PATH, 1), ";[^/]*$", "")


def url_ext(url: Column) -> Column:
    """Supported extension of the URL path, else empty."""
    ext = extension(url_path(url))
    return F.when(ext.isin(*SUPPORTED_EXTS), ext).otherwise("")


def is_direct_media(url: Column) -> Column:
    return url_ext(url) != ""


def manifest_name(url: Column) -> Column:
    ext = url_ext(url)
    return F.concat(F.lit("direct_"), F.md5(url.cast("binary")), F.lit("."), F.when(ext == "", "bin").otherwise(ext))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def digest_parts(text: Column) -> tuple[Column, Column]:
    """Two 60-bit numbers of the md5, wide enough to be summed; sums over a bag give an order-free digest with map-side
    partials, in which equal entries don't cancel out."""
    hexed = F.md5(text.cast("binary"))
    return tuple(F.conv(F.substring(hexed, start, 15), 16, 10).cast("decimal(20,0)") for start in (1, 16))
