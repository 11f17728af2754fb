"""Keys, splits, names and hash-based random choices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip_key(source: Column, file: Column) -> Column:
    """Frames of one video share a key; loose images keep their whole path."""
    base = F.element_at(F.split(file, "/"), -1)
    batch = F.regexp_extract(base, r"^(BATCH_[A-Za-z0-9]+)_", 1)
    return (F.when(source.startswith("RoLID"),
                   F.concat(F.lit("R:"), F.regexp_replace(base, r"_frame\d+\.\w+$", "")))
            .when((source == "UAVVaste") & (batch != ""), F.concat(F.lit("U:"), batch))
            .otherwise(file))


def audit_clip_key(kind: Column, file: Column) -> Column:
    """The audit's variant: same grouping, no prefixes, chosen by source kind."""
    base = F.element_at(F.split(file, "/"), -1)
    batch = F.regexp_extract(base, r"^(BATCH_[A-Za-z0-9]+)_", 1)
    return (F.when(kind == "rolid", F.regexp_replace(base, r"_frame\d+\.\w+$", ""))
            .when((kind == "uav") & (batch != ""), batch)
            .otherwise(file))


def _md5_head(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint")


def split_of(key: Column, val_frac: float = 0.15) -> Column:
    """Stable train/val choice from the key alone."""
    return F.when(_md5_head(key) % 10000 < val_frac * 10000, F.lit("val")).otherwise(F.lit("train"))


def tile_source(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, _TILE, 1), F.lit(""))


def tile_image(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, _TILE, 2), F.lit(""))


# fixed format of tile names: <source>_<image>_<t#|n#|full>
_TILE = r"^([A-Za-z]+)_(.+?)_(?:t\d+|n\d+|full)$"


def hash_order(*parts: Column, seed: int = 0) -> Column:
    """Random but repeatable ordering key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))


def hash_uniform(*parts: Column, seed: int = 0) -> Column:
    """Uniform number in [0, 1) derived from the row's own key."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return _md5_head(text) / F.lit(4294967296.0)


def matches_any_word(text: Column, words: list[str]) -> Column:
    low = F.lower(text)
    cond = F.lit(False)
    for w in words:
        cond = cond | low.contains(w.lower())
    return cond
