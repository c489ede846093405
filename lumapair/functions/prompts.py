"""Deterministic prompts: a path's hash decides whether it gets its weather's prompt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default prompts by weather, which callers may override.
PROMPTS = {
    "rain": "rainy scene, rain streaks on the image, wet surfaces, overcast sky",
    "snow": "snowy scene, snowflakes covering the image, cold atmosphere, white noise",
    "haze": "hazy scene, foggy atmosphere, low visibility, grayish tone",
}


def hash_share(key: Column) -> Column:
    """A number in [0, 1) with six digits, from the first 32 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % 1_000_000 / F.lit(1_000_000.0)


def parse_prompts(pairs: list[str]) -> dict[str, str]:
    """key:value texts, cut at the first colon and trimmed; later ones win."""
    return {k.strip(): v.strip() for k, _, v in (p.partition(":") for p in pairs if ":" in p)}


def prompt(path: Column, weather: Column, ratio: float, prompts: dict[str, str] | None = None, use: bool = True) -> Column:
    """The weather's prompt for a share `ratio` of all paths, else an empty text."""
    if not use:
        return F.lit("")
    known = PROMPTS | (prompts or {})
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.when(hash_share(path) < min(max(ratio, 0.0), 1.0), F.coalesce(F.try_element_at(table, weather), F.lit(""))).otherwise("")


def caption(captions: Column, key: Column, empty_share: float, train: bool) -> Column:
    """One of an array of captions: by hash in training, the first in evaluation; empty for a share of keys."""
    at = F.pmod(F.conv(F.substring(F.md5(key), 9, 7), 16, 10).cast("int"), F.size(captions)) if train else F.lit(0)
    return F.when(hash_share(key) < empty_share, "").otherwise(F.get(captions, at))
