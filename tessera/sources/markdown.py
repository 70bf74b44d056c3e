"""Markdown sources: scan, front matter, adapters with their file rules and cleaning."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import squeeze
from tessera.operators import ordering


def scan(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """Path (below the root) and text of every markdown file, by Spark's own readers, in any store."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    full = F.col("_metadata.file_path")
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    return files.select(F.element_at(F.split(full, F.lit(base + "/"), 2), -1).alias("path"), F.col("value").alias("text"))


def front_matter(text: Column) -> Column:
    """Category, deprecated, related of a leading ``---`` block; null where there is none."""
    block = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)

    def value(name: str) -> Column:
        return F.nullif(F.trim(F.regexp_extract(block, rf"(?m)^{name}:\s*['\"]?(.*?)['\"]?\s*$", 1)), F.lit(""))

    related = F.filter(F.split(F.regexp_replace(F.coalesce(value("related"), F.lit("")), r"[\[\]`'\"]", ""), r"\s*,\s*"), lambda x: x != "")
    return F.struct(value("category").alias("category"), (value("deprecated").isNotNull()).alias("deprecated"), related.alias("related"))


def long_enough(documents: DataFrame, text: str = "text", least: int = 100) -> DataFrame:
    """S16."""
    return documents.filter(F.length(text) >= least)


def parts(path: Column) -> Column:
    return F.split(path, "/")


def top(path: Column) -> Column:
    return F.element_at(parts(path), 1)


def at_root(path: Column) -> Column:
    return F.size(parts(path)) == 1


def everything(path: Column) -> Column:
    return path.isNotNull()


def without(dirs: tuple = (), root_files: tuple = (), files: tuple = (), prefixes: tuple = ()) -> Callable[[Column], Column]:
    """No file of some top folders, no such files at the root, none of these, none below these."""

    def rule(path: Column) -> Column:
        out = ~top(path).isin(*dirs) if dirs else F.lit(True)
        if root_files:
            out &= ~(at_root(path) & path.isin(*root_files))
        if files:
            out &= ~path.isin(*files)
        for prefix in prefixes:
            out &= ~path.startswith(prefix)
        return out

    return rule


# Folders of packages whose functions have a page each.
PACKAGES = ("core", "shared", "router", "integrations", "math", "firebase", "rxjs", "electron", "nuxt")


def composable_files(path: Column) -> Column:
    """Two files at the root, guides, components, and the index file of each function of each package; nothing else."""
    deep, first = F.size(parts(path)), top(path)
    index = first.isin(*PACKAGES) & (deep == 3) & (F.element_at(parts(path), -1) == "index.md")
    return F.when(deep == 1, path.isin("index.md", "add-ons.md")).otherwise(first.isin("guide", "components") | index)


def without_script(text: Column) -> Column:
    """``<script setup>`` blocks outside code fences go, line by line."""
    start = F.struct(F.lit(False).alias("fence"), F.lit(False).alias("script"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, line: Column) -> Column:
        mark = line.rlike(r"^\s*(```|~~~)") & ~state["script"]
        fence = F.when(mark, ~state["fence"]).otherwise(state["fence"])
        opens = ~state["fence"] & line.rlike(r"^\s*<script\b[^>]*\bsetup\b")
        inside = state["script"] | opens
        ends = inside & line.rlike("</script>")
        return F.struct(
            F.when(inside, state["fence"]).otherwise(fence).alias("fence"), (inside & ~ends).alias("script"),
            F.when(inside, state["out"]).otherwise(F.concat(state["out"], F.array(line))).alias("out"),
        )

    return F.aggregate(F.split(text, "\n"), start, step, lambda s: F.array_join(s["out"], "\n"))


def without_style_divs(text: Column) -> Column:
    """The marks of API-style blocks go, what they hold stays; blocks of other kinds are left."""
    start = F.struct(F.array().cast("array<boolean>").alias("open"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, line: Column) -> Column:
        opens, ends = line.rlike(r"^\s*<div\b"), line.rlike(r"^\s*</div>\s*$")
        styled = line.rlike(r'^\s*<div class="(options|composition)-api">\s*$')
        top_is = F.coalesce(F.try_element_at(state["open"], F.lit(-1)), F.lit(False))
        stack = F.when(opens, F.concat(state["open"], F.array(styled))).when(ends & (F.size(state["open"]) > 0), F.slice(state["open"], 1, F.greatest(F.size(state["open"]) - 1, F.lit(0)))).otherwise(state["open"])
        gone = (opens & styled) | (ends & top_is)
        return F.struct(stack.alias("open"), F.when(gone, state["out"]).otherwise(F.concat(state["out"], F.array(line))).alias("out"))

    return F.aggregate(F.split(text, "\n"), start, step, lambda s: F.array_join(s["out"], "\n"))


def without_cuts(text: Column) -> Column:
    """In fences, lines between the marks of a cut go, the marks too, and include lines; the fence's tag for checked code goes."""
    start = F.struct(F.lit(False).alias("fence"), F.lit(False).alias("cut"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, line: Column) -> Column:
        mark = line.rlike(r"^\s*```")
        begins, ends = line.rlike(r"^\s*//\s*---cut-start---\s*$"), line.rlike(r"^\s*//\s*---cut-end---\s*$")
        gone = state["fence"] & ~mark & (state["cut"] | begins | ends | line.rlike(r"^\s*//\s*@include:\s*.+$"))
        opening = F.regexp_replace(F.regexp_replace(line, r"\btwoslash\b", ""), r"\s+$", "")
        shown = F.when(mark & ~state["fence"], opening).otherwise(line)
        cut = state["fence"] & ~mark & ~ends & (state["cut"] | begins)
        fence = F.when(mark, ~state["fence"]).otherwise(state["fence"])
        return F.struct(fence.alias("fence"), cut.alias("cut"), F.when(gone, state["out"]).otherwise(F.concat(state["out"], F.array(shown))).alias("out"))

    return F.aggregate(F.split(text, "\n"), start, step, lambda s: F.array_join(s["out"], "\n"))


def without_blocks(*names: str) -> Callable[[Column], Column]:
    """Components with what they hold, up to the next end of any of them."""
    any_of = "|".join(names)
    return lambda text: F.regexp_replace(text, rf"(?s)<(?:{any_of})\b[^>]*>.*?</(?:{any_of})>", "")


def without_lines(*patterns: str) -> Callable[[Column], Column]:
    """Lines that hold nothing but one of some marks, with the white space around them."""
    any_of = "|".join(patterns)
    return lambda text: F.regexp_replace(text, rf"(?dm)^\s*(?:{any_of})\s*$", "")


def alone(*names: str) -> str:
    """A pattern of a component's single tag."""
    return rf"<(?:{'|'.join(names)})(?:\s[^>]*)?\s*/?\s*>"


def components(*names: str) -> tuple[Callable[[Column], Column], ...]:
    """Components with what they hold, then single tags on lines of their own."""
    return without_blocks(*names), without_lines(alone(*names))


def without_playgrounds(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)^\s*\[(Try it in the Playground|Playground)\]\([^)]*\)\s*$", "")


def without_directives(text: Column) -> Column:
    """Lines that point to more or to an example, and videos; blocks of text stay."""
    out = F.regexp_replace(text, r"(?dm)^::(?:read-more|link-example)\{[^}]*\}\s*$", "")
    return F.regexp_replace(out, r"(?dm)^\s*:video-accordion\{[^}]*\}\s*$", "")


@dataclass(frozen=True)
class Adapter:
    """What a source does its own way. Cleaning is applied in order; imports are the packages whose import lists name its entities."""

    name: str
    keep: Callable[[Column], Column] = everything
    clean: tuple[Callable[[Column], Column], ...] = ()
    pairs: tuple[tuple[str, str], ...] = ()
    base_url: str = "https://docs.example.org"
    title: str = ""
    imports: tuple[str, ...] = ()
    sorting: str = "sidebar"
    sidebar_functions: tuple[str, ...] = ()

    @property
    def display(self) -> str:
        return self.title or self.name.replace("-", " ").title()

    def discover(self, files: DataFrame, path: str = "path") -> DataFrame:
        return files.filter(self.keep(F.col(path)))

    def sort_keys(self, files: DataFrame, config: str = "", path: str = "path", text: str = "text") -> DataFrame:
        """path, sort_key of every file, by the source's way of sorting; config: the text of its sidebar, for those that have one."""
        bare = F.regexp_replace(path, r"\.md$", "")
        if self.sorting == "prefix":
            return files.select(path, ordering.by_prefix(F.col(path)).alias("sort_key"))
        if self.sorting == "category":
            rows = files.select(path, bare.alias("name"), F.coalesce(front_matter(F.col(text))["category"], F.lit("Uncategorized")).alias("category"))
            index = rows.filter((F.size(parts(F.col(path))) == 3) & F.col(path).endswith("/index.md"))
            keys = ordering.by_category(index, "category", "name").select(path, "sort_key")
            keys = keys.unionByName(rows.select(path, ordering.of_guide(F.col("name")).alias("sort_key")).filter("sort_key is not null"))
        else:
            found = ordering.sidebar(config, self.sidebar_functions)
            if self.sorting == "appearance":
                found = {p: f"00_{i // 10:02d}_{i % 10:02d}" for i, p in enumerate(ordering.links_of(config))}
            keys = files.sparkSession.createDataFrame(list(found.items()), f"{path} string, sort_key string")
        return ordering.with_fallback(files.select(path), keys, path)

    def cleaned(self, text: Column) -> Column:
        """The adapter's steps between two trims."""
        for step in self.clean:
            text = step(text)
        return squeeze(text)


CORE = "core"

# Components that hold no documentation, by kind of source.
ROUTER_TAGS = ("VueSchoolLink", "RuleKitLink", "HomeSponsors", "VueMasteryLogoLink", "VueMasteryBanner", "VuejsdeConfBanner", "MadVueBanner", "AsideSponsors")
STORE_TAGS = ("RuleKitLink", "MasteringPiniaLink", "VueSchoolLink", "VueMasteryLogoLink", "HomeSponsors")
TESTING_TAGS = ("Version", "Deprecated", "Experimental", "CRoot", "CourseLink")


def without_inline_tags(text: Column) -> Column:
    """P20: closed single tags inside lines, and badges of either kind."""
    return without_blocks("Badge")(F.regexp_replace(text, rf"<(?:{'|'.join((*TESTING_TAGS, 'Badge'))})\b[^>]*/\s*>", ""))


# Folders and files that hold no documentation, and pairs of folders whose links count most, by kind of source.
ADAPTERS = {
    a.name: a
    for a in (
        Adapter("core", clean=(without_style_divs, without_playgrounds), pairs=(("guide", "api"),)),
        Adapter("router", keep=without(dirs=("zh",)), clean=(*components(*ROUTER_TAGS), without_script), pairs=(("guide", "api"), ("guide", "data-loaders"), ("guide", "file-based-routing"))),
        Adapter("store", keep=without(dirs=("zh",)), clean=(*components(*STORE_TAGS), without_script), pairs=(("core-concepts", "cookbook"), ("core-concepts", "api"))),
        Adapter("composables", keep=composable_files, clean=(*components("CourseLink"), without_script, without_cuts), sorting="category", pairs=(("guide", "core"), ("guide", "shared"))),
        Adapter("bundler", keep=without((".vitepress", "node_modules", "blog", "public", "_data"), ("team.md", "releases.md", "acknowledgements.md", "live.md", "blog.md", "index.md")), clean=(without_blocks("ScrimbaLink"), without_blocks("audio"), without_lines(r"<(?:ScrimbaLink|audio)\b[^>]*/>", r"<!--\s*prettier-ignore\s*-->"), without_script), pairs=(("guide", "config"),)),
        Adapter("testing", keep=without((".vitepress", "node_modules", "blog", "public"), ("team.md", "todo.md", "blog.md", "index.md"), ("guide/cli-generated.md",), ("guide/examples/",)), clean=(*components(*TESTING_TAGS), without_inline_tags, without_lines(r"<img\s+img-(?:light|dark)\b[^>]*/?\s*>"), without_script), pairs=(("guide", "api"), ("guide", "config"), ("api", "config"))),
        Adapter("meta", sorting="prefix", keep=without(("5.community", "node_modules")), clean=(without_directives,), pairs=(("getting-started", "api"), ("guide", "api"), ("directory-structure", "api"))),
        Adapter("devtools", sorting="appearance", keep=without((".vitepress", "node_modules", "public"), ("index.md",)), clean=(without_lines(alone("Home", "UseModeList")),), pairs=(("getting-started", "plugins"), ("guide", "plugins"))),
    )
}


def adapter(name: str) -> Adapter:
    """S3: KeyError for an unknown name."""
    return ADAPTERS[name]


def by_source(values: dict[str, str], source: Column, default: str) -> Column:
    """What a mapping says of a source's name."""
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), source), F.lit(default))


def base_url(source: Column) -> Column:
    """The address of a source's site; the core's for unknown ones."""
    return by_source({a.name: a.base_url for a in ADAPTERS.values()}, source, ADAPTERS[CORE].base_url)


def display_name(source: Column) -> Column:
    return by_source({a.name: a.display for a in ADAPTERS.values()}, source, "")


def enabled(names: str | None) -> list[str]:
    """Names from a comma-separated list, all if it is empty; ValueError for an unknown one."""
    wanted = [n.strip() for n in (names or "").split(",") if n.strip()]
    if unknown := [n for n in wanted if n not in ADAPTERS]:
        raise ValueError(f"unknown sources: {', '.join(unknown)}")
    return wanted or list(ADAPTERS)
