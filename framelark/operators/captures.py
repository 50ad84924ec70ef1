"""What a recording says about its camera: maker by the first rule that fits, and the lens model to begin with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelark.operators.setup import stripped

#: The words that name a maker, in order, and what it is called.
MAKERS = (("gopro", "GoPro"), ("insta360", "Insta360"), ("dji", "DJI"), ("apple", "Apple/iPhone"), ("iphone", "Apple/iPhone"))
#: How the firmware of the first maker's cameras begins.
FIRMWARE = "HD"
#: Makers of wide-angle cameras, and the lens models and mappers of these and of others.
WIDE = ("GoPro", "Insta360", "DJI")
WIDE_MODEL, WIDE_MAPPER, OTHER_MODEL, OTHER_MAPPER = "OPENCV_FISHEYE", "global", "OPENCV", "incremental"
#: What is read of a probe's document.
PROBE = "format struct<format_name: string, tags: struct<make: string, `com.apple.quicktime.make`: string, model: string, `com.apple.quicktime.model`: string, firmware: string, creation_time: string>>, streams array<struct<codec_type: string, tags: struct<handler_name: string>>>"


def _first(*texts: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


def maker(make: Column, model: Column, firmware: Column, handlers: Column) -> Column:
    """The maker that make, model, firmware or a stream's handler names; else make itself, else `unknown`."""
    words = F.lower(F.concat_ws(" ", make, model, firmware, handlers))
    found = F.when(words.contains(MAKERS[0][0]) | F.coalesce(firmware.startswith(FIRMWARE), F.lit(False)), MAKERS[0][1])
    for word, name in MAKERS[1:]:
        found = found.when(words.contains(word), name)
    return found.otherwise(F.coalesce(F.nullif(make, F.lit("")), F.lit("unknown")))


def capture(document: Column) -> Column:
    """A struct of container, created, make, model, firmware, detected, camera_model and mapper, from a probe's JSON document; missing keys are null."""
    p = F.from_json(document, PROBE)
    tags = p["format"]["tags"]
    make, model = _first(tags["make"], tags["com.apple.quicktime.make"]), _first(tags["model"], tags["com.apple.quicktime.model"])
    handlers = F.array_join(F.transform(p["streams"], lambda s: F.coalesce(stripped(s["tags"]["handler_name"]), F.lit(""))), " ")
    detected = maker(make, model, tags["firmware"], handlers)
    wide = detected.isin(*WIDE)
    return F.struct(
        p["format"]["format_name"].alias("container"), tags["creation_time"].alias("created"), make.alias("make"), model.alias("model"), tags["firmware"].alias("firmware"), detected.alias("detected"),
        F.when(wide, WIDE_MODEL).otherwise(OTHER_MODEL).alias("camera_model"), F.when(wide, WIDE_MAPPER).otherwise(OTHER_MAPPER).alias("mapper"),
    )
