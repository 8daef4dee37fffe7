"""URLs, ids and image keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank


def canonical(url: Column | str, keep_query_hosts: tuple[str, ...] = ()) -> Column:
    """Without fragment and query (but for hosts whose query is the address), without slashes at the end."""
    u = F.regexp_replace(F.trim(blank(url)), "#.*$", "")
    bare = F.regexp_replace(u, r"\?.*$", "")
    if keep_query_hosts:
        bare = F.when(host(u).isin(*keep_query_hosts), u).otherwise(bare)
    return F.regexp_replace(bare, "/+$", "")


def host(url: Column | str) -> Column:
    """Host in lower case, without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(blank(url), r"^https?://([^/?#:]+)", 1)), r"^www\.", "")


def path(url: Column | str) -> Column:
    return F.regexp_extract(blank(url), r"^https?://[^/?#]+([^?#]*)", 1)


def is_http(url: Column | str) -> Column:
    return blank(url).rlike(r"^https?://[^/?#\s]+")


def resolve(url: Column | str, base: Column | str) -> Column:
    """An address as seen from a page: absolute, //host, /path, or beside the page."""
    u, b = F.trim(blank(url)), blank(base)
    origin = F.regexp_extract(b, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_extract(b, r"^(https?://[^?#]+)", 1), r"^(https?://[^/]+.*/)[^/]*$", "$1")
    folder = F.when(folder.rlike(r"^https?://[^/]+$"), F.concat(folder, F.lit("/"))).otherwise(folder)
    query = F.regexp_replace(b, r"[?#].*$", "")
    found = F.when(u.rlike("^https?://"), u).when(F.startswith(u, F.lit("//")), F.concat(F.lit("https:"), u)).when(F.startswith(u, F.lit("/")), F.concat(origin, u)).when(u == "", u).when(u.rlike("^[?]"), F.concat(query, u)).when(u.rlike("^#"), F.concat(F.regexp_replace(b, "#.*$", ""), u)).otherwise(F.concat(folder, u))
    return F.when(found.rlike(r"^https?://[^?#]*/\.\.?(?:/|$|[?#])"), undotted(found)).otherwise(found)


def undotted(url: Column) -> Column:
    """An address without . and .. in its path."""
    origin, rest = F.regexp_extract(url, r"^(https?://[^/?#]+)", 1), F.regexp_extract(url, r"^https?://[^/?#]+[^?#]*(.*)$", 1)
    parts = F.slice(F.split(path_of(url), "/"), 2, 10_000)
    last = F.element_at(parts, -1)
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(p == ".", acc).otherwise(F.concat(acc, F.array(p))))
    joined = F.concat(F.lit("/"), F.array_join(walked, "/"))
    return F.concat(origin, joined, F.when(last.isin(".", "..") & (F.size(walked) > 0), "/").otherwise(""), rest)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)


def make_id(url: Column | str) -> Column:
    """First 16 hex digits of the canonical address's sha1."""
    return F.substring(F.sha1(canonical(url)), 1, 16)


def palette(name: Column | str, colours: tuple[str, ...]) -> Column:
    """A colour for a name, always the same."""
    n = F.conv(F.substring(F.sha1(blank(name)), 1, 8), 16, 10).cast("long") % len(colours)
    return F.get(F.array(*[F.lit(c) for c in colours]), n.cast("int"))


#: Query parameters that only change an image's size or encoding (fixed values).
SIZE_PARAMETERS = "w|width|h|height|q|quality|fit|crop|auto|format|fm"


def image_key(url: Column | str) -> Column:
    """An image's address without its size parameters and fragment; the path keeps its case."""
    u = F.regexp_replace(F.trim(blank(url)), "#.*$", "")
    query = F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(f"^(?:{SIZE_PARAMETERS})(?:=|$)"))
    bare = F.regexp_replace(u, r"\?.*$", "")
    return F.when(F.size(query) > 0, F.concat(bare, F.lit("?"), F.array_join(query, "&"))).otherwise(bare)


def image_path_key(url: Column | str) -> Column:
    """Folder and file name, in lower case, without size marks."""
    p = F.regexp_replace(F.lower(path(url)), "/+$", "")
    tail = F.regexp_extract(p, r"([^/]*/?[^/]+)$", 1)
    tail = F.regexp_replace(F.regexp_replace(tail, "^/", ""), r"[-_]\d{2,5}x\d{2,5}(?=\.[a-z0-9]{2,5}$)", "")
    return F.regexp_replace(tail, r"[-_][wh]\d{2,5}(?=\.[a-z0-9]{2,5}$)", "")


def same_image(a: Column, b: Column) -> Column:
    name = lambda u: F.regexp_extract(image_path_key(u), r"([^/]+)$", 1)
    return (image_key(a) == image_key(b)) | ((image_path_key(a) == image_path_key(b)) & (image_path_key(a) != "")) | ((name(a) == name(b)) & (F.length(name(a)) >= 14))


def srcset_best(srcset: Column | str) -> Column:
    """The widest candidate of a srcset attribute."""
    parts = F.transform(F.split(blank(srcset), r",\s+"), lambda p: F.trim(p))
    rated = F.transform(parts, lambda p: F.struct(F.coalesce(F.regexp_extract(p, r"\s(\d+)[wx]$", 1).try_cast("int"), F.lit(0)).alias("w"), F.regexp_extract(p, r"^(\S+)", 1).alias("u")))
    return F.array_max(rated)["u"]


def requested_sizes(url: Column | str) -> Column:
    """Sizes that an address asks for, decoded up to three times."""
    u = blank(url)
    for _ in range(3):
        u = F.coalesce(F.try_url_decode(u), u)
    return F.transform(F.regexp_extract_all(u, F.lit(r"[?&/,](?:w|width|h|height)[=_](\d{1,6})"), F.lit(1)), lambda s: s.cast("int"))


def media_kind(url: Column | str) -> Column:
    """What an embedded address is."""
    h = host(url)
    return (
        F.when(h.rlike(r"(?:^|\.)(?:youtube\.com|youtu\.be|youtube-nocookie\.com)$"), "youtube")
        .when(h.rlike(r"(?:^|\.)vimeo\.com$"), "vimeo")
        .when(h.rlike(r"(?:^|\.)(?:twitter|x)\.com$"), "post")
        .when(path(url).rlike(r"(?i)\.(?:mp4|webm|m3u8)$"), "video")
        .when(path(url).rlike(r"(?i)\.(?:mp3|m4a|ogg|wav)$"), "audio")
        .when(path(url).rlike(r"(?i)\.(?:jpe?g|png|gif|webp|avif)$"), "image")
        .otherwise("link")
    )


#: Parts of an address that tell furniture from pictures (fixed values).
IMAGE_JUNK = (
    "logo", "icon", "avatar", "author", "profile", "sprite", "pixel", "tracking", "badge", "weather", "placeholder", "newsletter", "app-store", "google-play",
    "social", "facebook", "twitter", "instagram", "tiktok", "favicon", "headshot", "crest", "coat-of-arms", "coat_of_arms", "emblem",
)


def is_picture(url: Column | str) -> Column:
    """An address that may be an article's picture."""
    # "default" may be a part of a picture's address: it counts in descriptions only
    return is_http(url) & ~F.lower(blank(url)).rlike("|".join(IMAGE_JUNK)) & ~F.lower(path(url)).rlike(r"\.(?:svg|gif)$")


def image_rating(url: Column | str) -> Column:
    """Points for what an address says of a picture: type, size asked for; none for furniture."""
    size = F.coalesce(F.array_max(requested_sizes(url)), F.lit(0))
    kind = F.when(F.lower(path(url)).rlike(r"\.(?:jpe?g|webp|avif)$"), 20).when(F.lower(path(url)).rlike(r"\.png$"), 10).otherwise(0)
    return F.when(is_picture(url), 50 + kind + F.least(F.lit(30), F.floor(size / 40))).otherwise(0).cast("int")
