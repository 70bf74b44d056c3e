"""Column functions over text: slugs, cleaning, hashes, URLs, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CODE_FENCE = r"(?m)^```([A-Za-z0-9_+-]+)"
EXPLICIT_SLUG = r"\{#([^}]+)\}\s*$"


def slug(heading: Column) -> Column:
    """An explicit ``{#slug}`` wins; else lower case, word characters, hyphens for spaces."""
    explicit = F.regexp_extract(heading, EXPLICIT_SLUG, 1)
    plain = F.regexp_replace(F.lower(F.trim(heading)), r"[^\p{L}\p{N}_\s-]", "")
    return F.when(explicit != "", explicit).otherwise(F.btrim(F.regexp_replace(plain, r"[\s_]+", "-"), F.lit("-")))


def squeeze(text: Column) -> Column:
    """Trim, and at most one empty line in a row."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\n{3,}", "\n\n")


def fence_languages(text: Column) -> Column:
    """Languages of code fences, sorted, each once, comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(CODE_FENCE), F.lit(1)))), ",")


def breadcrumb(*parts: Column) -> Column:
    """Non-empty parts joined by `` > ``."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), " > ")


def content_hash(text: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def point_id(chunk_id: Column) -> Column:
    """K6: the first 15 hexadecimal digits of SHA-256, as a number."""
    return F.conv(F.substring(F.sha2(chunk_id, 256), 1, 15), 16, 10).cast("long")


def with_prefix(prefix: Column, content: Column) -> Column:
    """What is embedded: prefix, empty line, content."""
    return F.when(F.coalesce(prefix, F.lit("")) != "", F.concat(prefix, F.lit("\n\n"), content)).otherwise(content)


def rerank_text(chunk_type: Column, crumb: Column, prose: Column, content: Column) -> Column:
    """What the reranker reads."""
    has, told = F.coalesce(crumb, F.lit("")) != "", F.coalesce(prose, F.lit("")) != ""
    return F.when((chunk_type == "code_block") & told, F.concat_ws("\n", F.when(has, crumb), prose, content)).when(
        has, F.concat_ws("\n", crumb, content)
    ).otherwise(content)


def page_url(path: Column, base: Column) -> Column:
    """P25: file path to address."""
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), F.regexp_replace(F.regexp_replace(path, "^/+", ""), r"\.md$", ""))


def section_title(title: Column) -> Column:
    """A heading without backticks, anchors, tags and doubled white space."""
    out = F.regexp_replace(title, r"\{#[^}]*\}", "")
    out = F.regexp_replace(out, r"<sup[^>]*>.*?</sup>|<[^>]*/>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "`", ""), r"\s+", " "))


def label(name: Column) -> Column:
    """Words with capitals for a name with underscores."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def tool_prefix(source: Column) -> Column:
    """P28."""
    return F.replace(source, F.lit("-"), F.lit("_"))


def api_names(heading: Column) -> Column:
    """API names of a heading: without slug, anchors and call parentheses, compound headings split at ``&``."""
    bare = F.regexp_replace(F.regexp_replace(heading, r"\{#[^}]*\}|<[^>]+/>|<sup>.*?</sup>", ""), "`", "")
    parts = F.transform(F.split(bare, r"\s*&\s*"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"\(.*\)$", "")))
    return F.filter(parts, lambda x: (x != "") & ~x.rlike(r"\s"))


def retry_seconds(delay: Column) -> Column:
    """``1h2m3.5s`` in seconds; null where there is no such part."""

    def part(unit: str) -> Column:
        return F.regexp_extract(delay, rf"([0-9.]+){unit}(?![a-z])", 1).try_cast("double")

    total = F.coalesce(part("h"), F.lit(0.0)) * 3600 + F.coalesce(part("m"), F.lit(0.0)) * 60 + F.coalesce(part("s"), F.lit(0.0))
    return F.when(delay.rlike(r"[0-9](h|m|s)"), total)


def cost(embed_tokens: Column, rerank_tokens: Column, per_million: float = 0.02) -> Column:
    """Null where both counts are."""
    total = (F.coalesce(embed_tokens, F.lit(0)) + F.coalesce(rerank_tokens, F.lit(0))) * per_million / 1e6
    return F.when(embed_tokens.isNotNull() | rerank_tokens.isNotNull(), total)


def token_count(text: Column) -> Column:
    """Words and punctuation marks; stands in for a model's own tokens. Each word becomes one character, white space none, and the rest is counted."""
    words = F.regexp_replace(F.coalesce(text, F.lit("")), r"[A-Za-z0-9_\p{L}\p{N}]{2,}", "a")
    return F.length(F.translate(words, " \t\n\x0b\f\r", ""))


def paths_in(text: Column, host: str) -> Column:
    """Paths of addresses of a host, and of any host on ``source:`` lines; lower case, each once."""
    direct = F.regexp_extract_all(text, F.lit(rf"https?://(?:[A-Za-z0-9-]+\.)*{host}/([A-Za-z0-9/_.-]+)"), F.lit(1))
    lines = F.regexp_extract_all(text, F.lit(r"(?im)^source:\s*https?://[^/\s]+/([A-Za-z0-9/_.-]+)"), F.lit(1))
    named = F.when(F.contains(F.lower(text), F.lit("source:")), lines).when(text.isNotNull(), F.array().cast("array<string>"))

    def bare(x: Column) -> Column:
        ends = F.when(x.endswith(".md"), F.left(x, F.length(x) - 3)).when(x.endswith(".html"), F.left(x, F.length(x) - 5))
        return F.rtrim(F.lower(ends.otherwise(x)), F.lit("/"))

    return F.array_distinct(F.transform(F.concat(direct, named), bare))


def size_warning(content: Column, most: int = 8000, least: int = 50) -> Column:
    """P34."""
    return F.when(F.length(content) > most, "long").when(F.length(content) < least, "short")


def strip_tags(text: Column, names: list[str]) -> Column:
    """Components, self-closing or with what they hold."""
    any_of = "|".join(names)
    return F.regexp_replace(F.regexp_replace(text, rf"(?s)<({any_of})\b[^>]*?/>", ""), rf"(?s)<({any_of})\b[^>]*>.*?</\1>", "")
