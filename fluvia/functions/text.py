"""Text contracts: listings, metadata, names and codes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def iso_date(text: Column) -> Column:
    """YYYYMMDD as an ISO date; what is no such date is null."""
    return F.when(text.rlike(r"^\d{8}$"), F.date_format(F.try_to_date(text, "yyyyMMdd"), "yyyy-MM-dd"))


def sanitized(text: Column) -> Column:
    """Anything but letters, digits, blank-free marks becomes one underscore, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[^A-Za-z0-9_-]+", "_"), F.lit("_"))


def granule_month(name: Column) -> Column:
    """The month of a name's A<year><day of year> token."""
    year, day = F.regexp_extract(name, r"\.A(\d{4})(\d{3})", 1), F.regexp_extract(name, r"\.A(\d{4})(\d{3})", 2)
    return F.when(year != "", F.month(F.date_add(F.make_date(year.cast("int"), F.lit(1), F.lit(1)), day.cast("int") - 1)))


def granule_part(name: Column, part: str) -> Column:
    """The platform (by the product token) or the tile of a granule's name; a name without it is an error."""
    if part == "platform":
        token = F.regexp_extract(name, r"^(MOD|MYD)13Q1\.", 1)
        return F.when(token == "MOD", "terra").when(token == "MYD", "aqua").otherwise(F.raise_error(F.concat(F.lit("no product token in "), name)))
    tile = F.regexp_extract(name, r"\.(h\d\dv\d\d)\.", 1)
    return F.when(tile != "", tile).otherwise(F.raise_error(F.concat(F.lit("no tile in "), name)))


# Prefixes of wetland codes that name a lasting water table and those that do not, the letters of regimes
# and uses that rule one out, and metres by class of anchor, for area features, and added for managed waters.
KEPT_WETLANDS = ["PEM", "PFO", "PSS", "PAB", "PUB", "L1", "L2", "R2", "R3"]
DROPPED_WETLANDS = ["R4", "R5"]
DROPPED_MODIFIERS = ["d", "f", "x", "A", "J", "K"]
HEAD_UNCERTAINTY = {"spring": 0.5, "open_water": 1.5, "wetland": 2.5}
AREA_UNCERTAINTY = 2.0
MANAGED_UNCERTAINTY = 1.5


def persistent_wetland(code: Column) -> Column:
    """Whether a wetland code names a lasting water table: a kept prefix before any slash, and no excluded letter at the
    end of the whole code. A null code does not."""
    code = F.coalesce(code, F.lit(""))
    head = F.split(code, "/")[0]
    kept = head.rlike("^(" + "|".join(KEPT_WETLANDS) + ")") & ~head.rlike("^(" + "|".join(DROPPED_WETLANDS) + ")")
    return kept & ~F.regexp_extract(code, r"([A-Za-z])\s*$", 1).isin(DROPPED_MODIFIERS)


def head_uncertainty(cls: Column, label: Column) -> Column:
    """Metres by class of anchor, or those of area features by the label's prefix; managed waters are less sure. An unknown
    class that is no area feature has none."""
    label = F.coalesce(label, F.lit(""))
    base = F.when(label.startswith("NHDArea"), AREA_UNCERTAINTY)
    for name, metres in HEAD_UNCERTAINTY.items():
        base = base.when(cls == name, metres)
    return base + F.when(label.rlike("(?i)reservoir|playa|managed"), MANAGED_UNCERTAINTY).otherwise(0.0)


def bucket_path(*parts: Column) -> Column:
    """Parts of a path joined by one slash each, whatever slashes they bring; nulls and empty parts say nothing."""
    trimmed = F.array(*[F.nullif(F.regexp_replace(p.cast("string"), "^/+|/+$", ""), F.lit("")) for p in parts])
    return F.array_join(F.array_compact(trimmed), "/")


#: Stands between the parts of a record; no XML document can hold it.
_BETWEEN = "\x01"


def metadata_record(xml: Column) -> Column:
    """Title, bounding box, first and last date (ISO) and links of one metadata document; absent parts are null.

    A document is read twice, once for all its single parts and once for its links if it has any, and not once for each part."""
    edges = ("westbc", "southbc", "eastbc", "northbc")
    paths = ["//citeinfo/title", *[f"//bounding/{k}" for k in edges], "//rngdates/begdate", "//rngdates/enddate"]
    parts = F.split(F.xpath_string(xml, F.lit("concat(" + f", '{_BETWEEN}', ".join(paths) + ")")), _BETWEEN)
    links = F.when(~xml.contains("onlink"), F.array().cast("array<string>")).otherwise(F.xpath(xml, F.lit("//onlink/text()")))
    read = F.struct(F.transform(parts, lambda p: F.nullif(F.trim(p), F.lit(""))).alias("p"), links.alias("links"))

    def told(r: Column) -> Column:
        box = [r["p"][i].try_cast("double").alias(k) for i, k in enumerate(edges, 1)]
        return F.struct(r["p"][0].alias("title"), *box, iso_date(r["p"][5]).alias("begins"), iso_date(r["p"][6]).alias("ends"), r["links"].alias("links"))

    # within a lambda what was read has a name, so that the fields do not read it again
    return F.transform(F.array(read), told)[0]


def listed_keys(xml: Column) -> Column:
    """Keys of one page of an object listing."""
    return F.xpath(xml, F.lit("//*[local-name()='Contents']/*[local-name()='Key']/text()"))


def listed_prefixes(xml: Column) -> Column:
    """Common prefixes of one page of an object listing, without a slash at the end."""
    return F.transform(F.xpath(xml, F.lit("//*[local-name()='CommonPrefixes']/*[local-name()='Prefix']/text()")), lambda p: F.regexp_replace(p, "/$", ""))
