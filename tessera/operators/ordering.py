"""Sort keys."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.cluster import Workspace
from tessera.operators.order import running

UNKNOWN = "99_"


def with_fallback(pages: DataFrame, keys: DataFrame, path: str = "path", key: str = "sort_key") -> DataFrame:
    """O2: keys (path, sort_key) by path without ``.md``; pages that have none come last."""
    bare = F.regexp_replace(path, r"\.md$", "")
    found = pages.withColumn("__bare", bare).join(keys.select(F.regexp_replace(path, r"\.md$", "").alias("__bare"), key), "__bare", "left")
    return found.withColumn(key, F.coalesce(key, F.concat(F.lit(UNKNOWN), F.col(path)))).drop("__bare")


def by_category(items: DataFrame, category: str, name: str, section: int | None = None) -> DataFrame:
    """A section for each category in alphabetical order from 1, its items from 0; with ``section``, categories are groups of that section.
    Ranks run over ranges of all items, so that neither a category nor the list of them has to fit a task."""
    keep = Workspace(items.sparkSession).keep
    ranked = running(items.filter(F.col(category).isNotNull()), [category, name], {"__rank": F.lit(1)}, keep)
    first = keep(ranked.groupBy(F.col(category).alias("__category")).agg(F.min("__rank").alias("__first")))
    named = running(first, ["__category"], {"g": F.lit(1)}, keep)
    out = ranked.join(named, F.col(category) == F.col("__category")).withColumn("i", F.col("__rank") - F.col("__first")).withColumn("g", F.col("g") - 1)
    group = F.col("g") + 1
    key = (padded(group), F.lit("00")) if section is None else (F.lit(f"{section:02d}"), padded(group))
    return out.withColumn("sort_key", F.concat_ws("_", *key, padded(F.col("i")))).drop("g", "i", "__rank", "__first", "__category")


# Guide pages in reading order, and pages at the root.
GUIDE_PAGES, ROOT_PAGES = ("index", "best-practice", "config", "components", "work-with-ai"), ("index", "add-ons")


def of_guide(path: Column) -> Column:
    """Keys of guide pages and root pages, null for others; paths without ``.md``."""
    place = lambda names, of: F.array_position(F.array(*map(F.lit, names)), of) - 1
    guide = place([f"guide/{n}" for n in GUIDE_PAGES], path)
    root = place(list(ROOT_PAGES), path)
    return F.when(guide >= 0, F.concat(F.lit("00_00_"), padded(guide))).when(root >= 0, F.concat(F.lit("00_01_"), padded(root)))


def padded(number: Column, width: int = 2) -> Column:
    """Zeros before a number; longer numbers stay whole."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def by_prefix(path: Column, levels: int = 3) -> Column:
    """Numbers before the names of a path's parts, 99 where there is none."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.md$", ""), r"/(\d+\.)?index$", "")
    parts = F.split(bare, "/")
    number = F.transform(parts, lambda x: F.coalesce(F.regexp_extract(x, r"^(\d+)\.", 1).try_cast("int"), F.lit(99)))
    filled = F.slice(F.concat(number, F.array_repeat(F.lit(0), levels)), 1, levels)
    return F.array_join(F.transform(filled, lambda x: padded(x)), "_")


def by_appearance(index: Column) -> Column:
    """Groups of ten."""
    return F.concat_ws("_", F.lit("00"), padded(F.floor(index / 10).cast("int")), padded((index % 10).cast("int")))


def _bracketed(source: str, start: int, opening: str, closing: str) -> str:
    """What stands between a bracket, just before ``start``, and the one that closes it."""
    depth, at = 1, start
    while depth and at < len(source):
        depth += (source[at] == opening) - (source[at] == closing)
        at += 1
    return source[start : at - 1]


def _links(part: str, section: int, out: dict[str, str], first_group: int = 0) -> None:
    """Keys of a part's links; each ``items`` starts a group."""
    group, item = first_group - 1, 0
    for m in re.finditer(r"""\bitems\s*:|\blink\s*:\s*(['"])([^'"]+)\1""", part):
        if m[2] is None:
            group, item = group + 1, 0
        elif path := re.sub(r"\.(html|md)$", "", m[2].split("#")[0].strip("/")):
            out[path] = f"{section:02d}_{max(group, 0):02d}_{item:02d}"
            item += 1


def links_of(source: str) -> list[str]:
    """Paths of a configuration's links in order of appearance, each once."""
    out: dict[str, str] = {}
    _links(source, 0, out)
    return list(out)


def sidebar(source: str, functions: tuple[str, ...] = ()) -> dict[str, str]:
    """O1, O3: a sidebar's configuration text to {path: SS_GG_II}: a section for each quoted path with a list, ``/`` among them, and a
    group for each ``items``. Links in the bodies of some functions belong to the first section, in groups after those it has."""
    out: dict[str, str] = {}
    for section, m in enumerate(re.finditer(r"""(['"])(/[^'"]*)\1\s*:\s*\[""", source)):
        _links(_bracketed(source, m.end(), "[", "]"), section, out)
    for name in functions:
        if m := re.search(rf"function\s+{name}\s*\([^)]*\)\s*\{{", source):
            groups = [int(key.split("_")[1]) for key in out.values() if key.startswith("00_")]
            _links(_bracketed(source, m.end(), "{", "}"), 0, out, max(groups, default=-1) + 1)
    return out
