"""Behaviour of operators on small rows of our own."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.engine import Engine
from tessera.operators import analytics, bm25, entities, evaluation, graph, incremental, markdown, match, ordering, payloads, reconstruct, retrieval
from tessera.sources import loaders
from tessera.sources import markdown as sources
from tessera.streaming import usage


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_slug(spark):
    assert one(spark, "Hello, World `x`", T.slug) == "hello-world-x"
    assert one(spark, "Name {#own-slug}", T.slug) == "own-slug"


def test_headings_skip_fences(spark):
    found = one(spark, "# A\n```\n# no\n```\n## B {#b2}\n", markdown.headings)
    assert [(h.level, h.title, h.slug, h.line) for h in found] == [(1, "A", "a", 0), (2, "B", "b2", 4)]


def test_long_sections_are_split(spark):
    body = "x" * 1600
    text = f"# T\n## S\n{'intro ' * 20}\n### One\n{body}\n### Two\n{body}\n## Short\ny"
    rows = markdown.chunks(spark.createDataFrame([("a/b.md", text)], "path string, text string")).collect()
    by = {r.chunk_id: r for r in rows}
    assert set(by) == {"b#s", "b#one", "b#two", "b#short"}
    assert by["b#one"].content.startswith("## S") and by["b#one"].parent_chunk_id == "b#s"
    assert by["b#s"].child_chunk_ids == ["b#one", "b#two"] and by["b#s"].sibling_chunk_ids == ["b#short"]


def test_file_without_sections_is_one_chunk(spark):
    rows = markdown.chunks(spark.createDataFrame([("my-page.md", "just text")], "path string, text string")).collect()
    assert [(r.chunk_id, r.chunk_type, r.folder_path, r.breadcrumb) for r in rows] == [("my-page#my-page", "section", ".", "My Page > My Page")]


def test_images_and_style(spark):
    found = one(spark, "a\n![alt](/i.png)\n```\n![no](x)\n```", markdown.images)
    assert [(i.alt, i.src, i.line) for i in found] == [("alt", "/i.png", 1)]
    text = '<div class="options-api">\na\n<div class="composition-api">\nb\n</div>\nc\n</div>\nd'
    assert one(spark, text, markdown.style_lines) == ["options", "options", "composition", "composition", "options", "options", "both", "both"]
    assert one(spark, text, markdown.api_style) == "both" and one(spark, '<div class="options-api">', markdown.api_style) == "options"


def test_cleaning(spark):
    core = sources.adapter("core")
    text = '<div class="options-api">\nkeep\n<div>\nin\n</div>\n</div>\nend'
    assert one(spark, text, core.cleaned) == "keep\n<div>\nin\n</div>\nend"
    assert one(spark, "<script setup>\nx\n</script>\n```\n<script setup>\n```\n", sources.without_script) == "```\n<script setup>\n```\n"
    assert one(spark, "```ts twoslash\na\n// ---cut-start---\nb\n// ---cut-end---\nc\n// @include: d\n```\n// ---cut-start---\ne", sources.without_cuts) == "```ts\na\nc\n```\n// ---cut-start---\ne"
    assert one(spark, "```ts\n// ---cut-start---\na\n```\nb", sources.without_cuts) == "```ts\n```\nb"
    assert one(spark, "::read-more{to='/x'}\nkept text\n::tip\nin\n::\nend\n:link-example{y}\n", sources.without_directives) == "\nkept text\n::tip\nin\n::\nend\n:link-example{y}\n"
    router, testing, bundler = (sources.adapter(n).cleaned for n in ("router", "testing", "bundler"))
    assert one(spark, "a <RouterLink to='x'>b</RouterLink>\n<MadVueBanner>\nc", router) == "a <RouterLink to='x'>b</RouterLink>\n\nc"
    assert one(spark, "use <CRoot /> here <Badge>x</Badge>\n  <img img-dark src='y' />\nd", testing) == "use  here \n\nd"
    assert one(spark, "a\n<!-- prettier-ignore -->\n<audio src='z' />\nb", bundler) == "a\n\nb"


def test_sources():
    with pytest.raises(KeyError):
        sources.adapter("nope")
    with pytest.raises(ValueError):
        sources.enabled("core,nope")
    assert sources.enabled("") == list(sources.ADAPTERS)


def test_scan(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("# X")
    (tmp_path / "y.txt").write_text("no")
    assert [(r.path, r.text) for r in sources.scan(spark, str(tmp_path)).collect()] == [("a/x.md", "# X")]


def test_links(spark):
    cases = [("/g/a.html#x", "g/a#x"), ("./b.md", "s/b"), ("../../c", "c"), ("d/", "s/d"), ("#top", None), ("https://x.y", None), ("mailto:a@b", None)]
    rows = spark.createDataFrame(cases, "link string, want string")
    for r in rows.select("want", graph.resolve(F.col("link"), F.lit("s/p.md")).alias("got")).collect():
        assert r.got == r.want


def test_not_fitted():
    with pytest.raises(RuntimeError):
        _ = bm25.Model().postings


def test_model_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red apple pie"), (2, "green apple")], "id long, t string")
    model = bm25.Model().fit(docs, "id", "t")
    model.save(str(tmp_path))
    again = bm25.Model.load(spark, str(tmp_path))
    assert sorted(map(tuple, again.postings.collect())) == sorted(map(tuple, model.postings.collect()))


def test_empty_and_unknown_queries(spark):
    docs = spark.createDataFrame([(1, "red apple")], "id long, t string")
    asked = spark.createDataFrame([(7, "unknown words"), (8, None)], "q long, t string")
    assert bm25.Model().fit(docs, "id", "t").scores(asked, "q", "t").count() == 0


def test_fuzzy_ratio(spark):
    row = spark.createDataFrame([("definprops", "defineprops"), ("abc", "xyz")], "a string, b string").select(match.ratio(F.col("a"), F.col("b"))).collect()
    assert [round(r[0], 4) for r in row] == [round(200 * 10 / 21, 4), 0.0]


def test_ambiguous_names_need_code(spark):
    names = spark.createDataFrame([("data",), ("ref",)], "name string")
    asked = spark.createDataFrame([(1, "what is data in a reference"), (2, "use `data` and ref here")], "query long, text string")
    assert sorted(map(tuple, match.exact(asked, names).collect())) == [(2, "data"), (2, "ref")]


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query long, doc string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query long, doc string, rank int")
    one_way, other = retrieval.fuse([a, b], 5).collect(), retrieval.fuse([b, a], 5).collect()
    assert one_way == other and one_way[0].doc == "y"


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    once = incremental.upsert(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, incremental.upsert(once, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_sidebar():
    text = "'/guide/': [{ items: [{ text: 'A', link: '/guide/a' }, { link: '/guide/b.html' }] }, { items: [{ link: '/guide/c' }] }]"
    assert ordering.sidebar(text) == {"guide/a": "00_00_00", "guide/b": "00_00_01", "guide/c": "00_01_00"}


def test_sidebar_functions():
    text = "'/': [{ items: [{ link: '/a' }] }, more()],\n'/x/': [{ items: [{ link: '/x/b.html#c' }] }]\nfunction more() { return { items: [{ link: '/d' }] } }"
    assert ordering.sidebar(text, ("more", "absent")) == {"a": "00_00_00", "x/b": "01_00_00", "d": "00_01_00"}


def test_fuzzy_against_all_pairs(spark):
    words = ["defineprops", "definemodel", "onmounted", "onunmounted", "usefetch", "usefetchdata", "transition", "translation", "keepalive", "short", "teleport"]
    typos = sorted({w[:i] + c + w[i + k :] for w in words for i in range(0, len(w), 2) for k, c in ((0, "x"), (1, ""), (1, "x"))} | {"nothing-like-it"})
    names = spark.createDataFrame([(w,) for w in words], "name string")
    asked = spark.createDataFrame(list(enumerate(typos)), "query long, text string")
    got = {(r.query, r.name) for r in match.fuzzy(asked, names, names.select(F.lit(-1).cast("long").alias("query"), "name")).collect()}

    def common(a, b):
        before = [0] * (len(b) + 1)
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(before[j] + 1 if x == y else max(before[j + 1], row[-1]))
            before = row
        return before[-1]

    want = set()
    for q, text in enumerate(typos):
        for token in {t for t in text.replace("-", " ").split() if len(t) >= 6}:
            near = sorted((-200.0 * common(token, w) / (len(token) + len(w)), w) for w in words if len(w) >= 6 and w != token)
            want |= {(q, w) for r, w in [x for x in near if -x[0] >= 85][:3]}
    assert got == want and want


def test_contained_names_of_any_length(spark):
    names = spark.createDataFrame([("h2",), ("abc",), ("useFetch",), ("a b c d e",)], "name string")
    asked = spark.createDataFrame([(1, "h2 and usefetching"), (2, "xabcx"), (3, "abc. A B C D E"), (4, ""), (5, None)], "query long, text string")
    assert sorted(map(tuple, match.exact(asked, names).collect())) == [(1, "h2"), (1, "useFetch"), (3, "a b c d e"), (3, "abc")]


def test_dense_in_blocks(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(40)]
    chunks, asked = spark.createDataFrame(rows, "doc long, vec array<double>"), spark.createDataFrame(rows[:9], "query long, qvec array<double>")
    whole = sorted(map(tuple, retrieval.dense(asked, chunks, 4).collect()))
    assert whole == sorted(map(tuple, retrieval.dense(asked, chunks, 4, most_bytes=60).collect())) and len(whole) == 36


def test_payload_needs_its_fields(spark):
    row = {name: "x" for name, (kind, default) in payloads.FIELDS.items() if default is None} | {"chunk_id": "c"}
    good = spark.createDataFrame([row])
    back = payloads.chunks_of(payloads.payload(good)).first()
    assert back.api_style == "both" and back.api_entities == [] and back.content == "x"
    with pytest.raises(Exception, match="no content"):
        payloads.chunks_of(payloads.payload(good.drop("content"))).collect()


def test_collection_is_made_once(spark, tmp_path):
    path = str(tmp_path / "c")
    payloads.create(spark, path)
    payloads.payload(spark.createDataFrame([("c", "x")], "chunk_id string, content string")).write.mode("append").parquet(path)
    payloads.create(spark, path)
    assert payloads.collection_stats(spark.read.parquet(path)).first().points == 1
    payloads.create(spark, path, anew=True)
    assert payloads.collection_stats(spark.read.parquet(path)).first() == (0, "empty")


def test_parse_failures_are_told(spark):
    rows = spark.createDataFrame([("a", None), ("b", "bad"), ("c", "worse")], "path string, parse_error string")
    with pytest.raises(ValueError, match="2 files(.|\n)*b: bad(.|\n)*c: worse"):
        incremental.parsed_or_raise(rows)
    assert incremental.parsed_or_raise(rows.filter("path = 'a'")).columns == ["path"]


def test_idle_run_and_state(spark):
    state = spark.createDataFrame([("a", "h", "v1", ["c1", "c2"]), ("b", "h", "v1", ["c3"])], "path string, content_hash string, version string, chunk_ids array<string>")
    current = state.select("path", "content_hash")
    assert incremental.Run(state, current, "v1").idle() and not incremental.Run(state, current, "v2").idle() and not incremental.Run(state, current, "v1", full=True).idle()
    known = incremental.State(state)
    assert known.get("b").chunk_ids == ["c3"] and known.get("z") is None
    more = known.put(spark.createDataFrame([("b", "h2", "v1", ["c4", "c5"])], state.schema)).remove(current.filter("path = 'a'"))
    assert more.total_chunks().first().chunks == 2 and [r.path for r in more.paths().collect()] == ["b"]


def test_dictionary_round_trip(spark, tmp_path):
    whole = tmp_path / "d.json"
    whole.write_text('{\n "ref": {"entity_type": "global_api", "page_path": "api/x.md", "section": "ref()", "related": ["reactive"], "source": "core"},\n "h": {"entity_type": "other", "related": []}\n}')
    found = loaders.load_dictionary(spark, str(whole))
    assert {r.name: (r.entity_type, r.related) for r in found.collect()} == {"ref": ("global_api", ["reactive"]), "h": ("other", [])}
    loaders.save_dictionary(found, str(tmp_path / "out"))
    again = loaders.load_dictionary(spark, str(tmp_path / "out"), lines=True)
    assert sorted(map(str, again.collect())) == sorted(map(str, found.collect()))


def test_questions(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"{n}.json").write_text('[{"question": "q%d", "framework": "core", "relevant_paths": ["a"], "relevant_apis": []}]' % n)
    assert sorted(r.question for r in loaders.load_questions(spark, [str(tmp_path / "1.json"), str(tmp_path / "2.json")]).collect()) == ["q1", "q2"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        loaders.load_questions(spark, [str(tmp_path / "3.json")]).collect()


def test_reports_are_saved(spark, tmp_path):
    figures = spark.createDataFrame([("a", 0.5, None)], "provider string, avg_f1 double, max_latency double")
    evaluation.save_report(figures, ["avg_f1", "max_latency"], str(tmp_path))
    assert spark.read.json(f"{tmp_path}/json").first().avg_f1 == 0.5
    assert [r.value for r in spark.read.text(f"{tmp_path}/txt").collect()][:2] == ["EVALUATION REPORT: A", "avg_f1:                 0.500"]


def test_packing_without_groups(spark):
    rows = spark.createDataFrame([(i, 3) for i in range(10)], "i long, size long")
    assert [r.i for r in analytics.packed(rows, ["i"], F.col("size"), 10).collect()] == [0, 1, 2]


def small_engine(spark):
    columns = "chunk_id string, content string, file_path string, section_title string, breadcrumb string, global_sort_key string, chunk_type string, language_tag string, folder_path string, source string, parent_chunk_id string"
    chunks = spark.createDataFrame([
        ("a#x", "red apple pie", "guide/a.md", "Apples", "A > Apples", "00_00_01", "section", "", "guide", "core", ""),
        ("b#y", "green pear tart", "api/b.md", "Pears", "", "00_00_02", "section", "", "api", "router", ""),
        ("q", "how to bake pears", "api/b.md", "", "", "", "hype_question", "", "api", "router", "b#y"),
    ], columns)
    entities_ = spark.createDataFrame([("useApple", "composable", "guide/a.md", "Apples", ["usePear"], "core"), ("usePear", "composable", "", "", [], "router")], "name string, entity_type string, page_path string, section string, related array<string>, source string")
    return Engine(chunks, entities_, spark.createDataFrame([], "alias string, names array<string>"))


def test_engine(spark):
    engine = small_engine(spark)
    asked = spark.createDataFrame([(1, "apple"), (2, "bake"), (3, "nothing")], "query long, text string")
    got = {r.query: r.answer for r in engine.search(asked).collect()}
    assert "red apple pie" in got[1] and "breadcrumb: A > Apples" in got[1]
    assert "green pear tart" in got[2] and "framework: Router" in got[2] and "how to bake" not in got[2]
    assert got[3] == "No documentation found for: nothing"
    inside = {r.query: r.answer for r in engine.search(asked, scope="guide").collect()}
    assert "red apple pie" in inside[1] and "green pear tart" in inside[2]
    with pytest.raises(ValueError):
        engine.search(asked, most=21)
    with pytest.raises(Exception, match="2000 characters"):
        engine.search(spark.createDataFrame([(1, "x" * 2001)], asked.schema)).collect()
    assert engine.for_sources(["core"]).pages().count() == 1
    names = {r.query: r.answer for r in engine.api_lookup(spark.createDataFrame([(1, "USEAPPLE"), (2, "how to useapple"), (3, "zz")], asked.schema)).collect()}
    assert names[1] == names[2] and "`usePear`" in names[1] and names[3].startswith("No API entity found for `zz`")
    assert [(r.name, r.hop) for r in engine.related(spark.createDataFrame([(1, "useapple")], asked.schema)).orderBy("n").collect()] == [("useApple", 0), ("usePear", 1)]


def test_summaries_stand_alone(spark):
    rows = [(1, "s", 3, "folder_summary", None, ""), (1, "p", 2, "page_summary", "00_00_02", "a.md"), (1, "c1", 1, "section", "00_00_00", "a.md"), (1, "c2", 4, "section", "00_00_01", "a.md")]
    hits = spark.createDataFrame(rows, "query long, chunk_id string, rank int, chunk_type string, global_sort_key string, file_path string").withColumn("section_title", F.lit("t")).withColumn("content", F.col("chunk_id"))
    marked = reconstruct.islands(reconstruct.reading_order(hits, 9)).orderBy("pos").collect()
    assert [(r.chunk_id, r.page_run, r.merged) for r in marked] == [("s", 1, 1), ("p", 2, 2), ("c1", 2, 3), ("c2", 2, 3)]


def test_usage_is_appended_once(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, kind string")
    seen = []
    for _ in range(2):
        rows.write.mode("append").parquet(folder)
        usage.append(usage.read_events(spark, folder, rows.schema), out, str(tmp_path / "c1")).awaitTermination()
        usage.on_change(spark, folder, rows.schema, str(tmp_path / "c2"), lambda new: seen.append(new.count())).awaitTermination()
    assert spark.read.parquet(out).count() == 4 and seen == [2, 2]


def test_first_package_wins(spark):
    rows = spark.createDataFrame([("shared/useX/index.md", ""), ("core/useX/index.md", "---\nrelated: useY\n---\n"), ("core/useX/demo.md", "")], "path string, text string")
    assert [(r.name, r.package, r.related) for r in entities.by_directory(rows, text="text").collect()] == [("useX", "core", ["useY"])]


def test_sort_keys_of_sources(spark):
    files = spark.createDataFrame([("guide/config.md", ""), ("core/useB/index.md", "---\ncategory: State\n---\n"), ("core/useA/index.md", ""), ("x/y.md", "")], "path string, text string")
    keys = lambda name, config="": {r.path: r.sort_key for r in sources.adapter(name).sort_keys(files, config).collect()}
    assert keys("composables") == {"guide/config.md": "00_00_02", "core/useB/index.md": "01_00_00", "core/useA/index.md": "02_00_00", "x/y.md": "99_x/y.md"}
    assert keys("router", "'/': [{ items: [{ link: '/x/y' }] }]")["x/y.md"] == "00_00_00"
    assert keys("devtools", "const A = [{ link: '/guide/config' }]\nconst B = [{ link: '/x/y' }]") == {"guide/config.md": "00_00_00", "x/y.md": "00_00_01", "core/useB/index.md": "99_core/useB/index.md", "core/useA/index.md": "99_core/useA/index.md"}
    assert keys("meta")["x/y.md"] == "99_99_00"
