"""Images of parsed pages: the address to show, the reason against an image, duplicates and the limit of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.web import resolved_url
from .parse import BAD_HOSTS, DESCRIBED, NAME_HINTS, TINY_DATA

#: Pixels of the shorter side, and images of one page. Fixed values.
LEAST_PIXELS, MOST_IMAGES = 32, 20
#: Endings of files that are images. Fixed values.
ENDINGS = ("png", "jpg", "jpeg", "gif", "webp", "svg", "avif", "bmp")


def largest_candidate(srcset: Column) -> Column:
    """The candidate of a srcset with the largest width or density, the first of equals; one without either counts as 1."""
    bits = F.transform(F.split(srcset, ","), lambda c: F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "))
    there = F.filter(bits, lambda b: b[0] != "")
    size = lambda b: F.when(F.size(b) > 1, F.coalesce(F.substring(F.element_at(b, 2), F.lit(1), F.length(F.element_at(b, 2)) - 1).try_cast("double"), F.lit(1.0))).otherwise(F.lit(1.0))
    scored = F.transform(there, lambda b, i: F.struct(size(b).alias("size"), (-i).alias("at"), b[0].alias("url")))
    return F.array_max(F.filter(scored, lambda s: s["size"] > -1))["url"]


def _blank(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def image_address(image: Column, page: Column) -> Column:
    """The largest candidate, else the source, else the one that scripts load; the full-size image where it links to one. Relative
    addresses are resolved by the page's."""
    chosen = F.coalesce(_blank(largest_candidate(_blank(image["srcset"]))), _blank(image["src"]), _blank(image["data_src"]))
    linked = F.lower(F.regexp_extract(F.regexp_replace(image["link"], r"\?.*$", ""), r"\.([^.]*)$", 1)).isin(*ENDINGS)
    return F.when(chosen.isNotNull(), resolved_url(page, F.when(linked, image["link"]).otherwise(chosen)))


def _pixels(c: Column) -> Column:
    return F.trim(F.replace(c, F.lit("px"), F.lit(""))).try_cast("double").cast("int")


def image_reason(url: Column, image: Column, least: int = LEAST_PIXELS, patterns: tuple[str, ...] = ()) -> Column:
    """Why an image is left out by what the page says of it; null where it is not. The first rule that fits decides."""
    low = F.lower(F.coalesce(url, F.lit("")))
    alt, title, caption = image["alt"], image["title"], image["caption"]
    full = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    path, before = F.substring_index(low, "?", 1), F.substring_index(low, "#", 1)
    where = F.lower(F.concat_ws(" ", low, F.coalesce(image["hints"], F.lit("")), F.coalesce(alt, F.lit(""))))
    words = F.split(where, "[^a-z0-9]+")
    hint = F.get(F.filter(F.array(*map(F.lit, NAME_HINTS)), lambda h: F.array_contains(words, h) | F.array_contains(words, F.concat(h, F.lit("s")))), F.lit(0))
    described = full(caption) | (full(alt) & (F.size(F.split(F.trim(alt), r"\s+")) >= DESCRIBED))
    small = F.coalesce(_pixels(image["width"]) < least, F.lit(False)) | F.coalesce(_pixels(image["height"]) < least, F.lit(False))
    rules = (
        F.when(image["decorative"], "marked decorative")
        .when(url.isNull(), F.when(full(alt) | full(title) | full(caption), "").otherwise("no text"))
        .when(low.startswith("data:") & (F.length(low) < TINY_DATA), "tiny inline image")
        .when(low.contains("#") & before.endswith(".svg"), "svg sprite")
        .when(path.endswith(".ico"), "icon file")
        .when((alt == "") & caption.isNull() & ~full(title), "empty alt text")
        .when(small, f"smaller than {least}px")
        .when(F.exists(F.array(*map(F.lit, BAD_HOSTS)), lambda h: F.contains(low, h)), "badge or tracker")
        .when(~described & hint.isNotNull(), F.concat(F.lit("looks like decoration ("), hint, F.lit(")")))
    )
    for p in patterns:
        rules = rules.when(F.contains(where, F.lit(p)), f"skip pattern '{p}'")
    return F.nullif(rules, F.lit(""))


def image_text(url: Column, image: Column) -> Column:
    """An image as a line of text."""
    named = F.coalesce(_blank(F.trim(image["alt"])), _blank(F.trim(image["title"])), F.substring_index(url, "/", -1), F.lit(""))
    shown = F.concat(F.lit("[Image: "), named, F.coalesce(F.concat(F.lit(" — "), image["caption"]), F.lit("")), F.lit("]"))
    return F.concat(shown, F.coalesce(F.concat(F.lit(" ("), url, F.lit(")")), F.lit("")))


def page_blocks(parsed: DataFrame, key: str, page: str, least: int = LEAST_PIXELS, most: int = MOST_IMAGES, patterns: tuple[str, ...] = ()) -> DataFrame:
    """``parsed``: key, blocks (of ``parse_pages``) and the page's address. Every block with its place: key, pos, heading, kind,
    language, text, url, reason. The reason is null for blocks that stay; images have one if a rule speaks against them, if
    the page showed the same address before, or if ``most`` images stand before them."""
    rows = parsed.select(key, F.col(page).alias("__page"), F.posexplode("blocks").alias("pos", "b")).select(key, "__page", "pos", "b.*")
    shown = F.col("kind") == "image"
    rows = rows.withColumn("url", F.when(shown, image_address(F.col("image"), F.col("__page"))))
    rows = rows.withColumn("reason", F.when(shown, image_reason(F.col("url"), F.col("image"), least, patterns)))
    good = shown & F.col("reason").isNull()
    again = Window.partitionBy(key, "url").orderBy("pos")
    nth = F.when(good & F.col("url").isNotNull(), F.count_if(good).over(again))
    rows = rows.withColumn("reason", F.when(nth > 1, "duplicate on page").otherwise(F.col("reason")))
    line = Window.partitionBy(key).orderBy("pos")
    good = shown & F.col("reason").isNull()
    rows = rows.withColumn("reason", F.when(good & (F.count_if(good).over(line) > most), "per-page limit").otherwise(F.col("reason")))
    text = F.when(shown, image_text(F.col("url"), F.col("image"))).otherwise(F.col("text"))
    return rows.select(key, "pos", "heading", "kind", "language", text.alias("text"), "url", "reason")
