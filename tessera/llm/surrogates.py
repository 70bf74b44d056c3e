"""PII replacement by keyed surrogates, in DataFrame functions only.

Entities are found by one pattern. Each has a kind, and a canonical form (letters and digits in lower case, without
the part that its kind keeps, such as a country code), from which a keyed hash draws a surrogate of like form: digits for
digits, letters for letters, valid octets, card numbers with a right last digit, first names of the title's gender, names
in the entity's script. The surrogate is woven into the entity's own punctuation and case, so that every
mention of one entity, anywhere, gets the same surrogate.

Titles without a gender take one from the name. A full name that stands without a title is replaced in texts that give the person one
elsewhere; other bare names, which only a list of names could tell, are left.

Distinctness: over the distinct entities of all documents, of whatever kinds, a surrogate that two entities share, or that is itself an entity
of the input, is drawn anew for all but the least entity, until none is left. Only entities drawn anew have to be looked up;
they reach their documents by a join on the text's fingerprint. After ``LONGER_AFTER`` draws a surrogate grows by
four characters, so a crowded format can't keep this from ending.

Null text stays null; texts without entities are returned as they are. Rows are kept one for one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, fingerprint, numbered, pick, session_of

LONGER_AFTER, MOST_DRAWS = 12, 40
BROADCAST_ROWS = 100_000

# Formats of entities, titles that tell a person's gender, and name parts.
FEMALE_TITLES = r"Mrs\.?|Ms\.?|Miss|Frau|Madame|Mme\.?|Señora|Sra\.|Signora|г-жа|госпожа|Госпожа"
MALE_TITLES = r"Mr\.?|Herr|Monsieur|Señor|Sr\.|Signor|г-н|господин|Господин"
OTHER_TITLES = r"Dr\.?|Prof\.?|Professor|Doctor|Mx\.?"
PERSON = rf"(?<![\p{{L}}])(?:{FEMALE_TITLES}|{MALE_TITLES}|{OTHER_TITLES}) (?:\p{{Lu}}[\p{{Ll}}]{{1,30}}+(?:[ -]\p{{Lu}}\p{{Ll}}{{1,30}}+)?|\p{{IsHan}}{{2,4}}+)"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
FORMATS = {
    "pem": r"-----BEGIN (?:[A-Z]{1,20} ){0,3}PRIVATE KEY-----[^-]++-----END (?:[A-Z]{1,20} ){0,3}PRIVATE KEY-----",
    "secret": r"""(?i:[psta](?:assword|asswd|wd|ecret|oken|pi_?key|ccess_key|uth))["']?\s{0,2}[=:]\s{0,2}["']?[^\s"',;<>=:]{6,}+""",
    "email": r"(?<![\p{L}0-9._%+@-])[\p{L}0-9._%+-]{1,64}+@[\p{L}0-9-]{1,63}+(?:\.[\p{L}0-9-]{1,63}+)++",
    "key": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[opsu]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}+)(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "mac": r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:-])",
    "ip6": r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\w:.])(?=[A-Fa-f:]{0,19}\d)(?:[0-9A-Fa-f]{1,4}:){1,6}:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?(?![\w:])",
    "ip4": rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\d|\.\d)",
    "card": r"(?<![\d+])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\d)|(?<![\d+])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w(])\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}(?!\d)|(?<![\w.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-])",
    "person": PERSON,
}
PATTERN = "|".join(FORMATS.values())
PEM_BODY = r"^(-----[A-Z ]+-----)([^-]+)(-----[A-Z ]+-----)$"
SECRET_VALUE = r"""[^\s"',;<>=:]+$"""
#: What a text must hold to hold an entity; each choice starts with a set of characters, so most positions fail at once.
DIGITS_OR_SIGNS, TITLES = r"[0-9@=:]", r"[MFHSDPгГ](?:rs?|s|x|iss|rau|err|adame|me|onsieur|eñora?|ra|ignora?|rof(?:essor)?|octor|-жа|-н|осп[а-я]+)\.? [\p{Lu}\p{IsHan}]"
FIRST_NAMES = {
    "f": "Anna Clara Elena Emma Eva Ines Irene Julia Laura Lea Lena Marta Nora Olga Paula Sara".split(),
    "m": "Adam Bruno Carlo Daniel Emil Felix Hugo Ivan Jonas Leon Lukas Marco Oscar Pablo Simon Viktor".split(),
    "fc": "Анна Вера Дарья Елена Жанна Зоя Инна Ирина Лидия Мария Нина Ольга Полина Раиса Софья Юлия".split(),
    "mc": "Антон Борис Вадим Глеб Денис Егор Иван Игорь Кирилл Лев Максим Олег Павел Роман Семён Юрий".split(),
}
SYLLABLES = "ba der fel gon hal kir lan mer nor pel rai sal tor ven wil zan".split()
SYLLABLES_CYRILLIC = "ба дер фел гон хал кир лан мер нор пел рай сал тор вен вил зан".split()
HAN_FAMILIES, HAN_NAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭", "安宁文明志强秀英丽华建国春梅海云雪峰玉兰晓东佳慧子轩雨涵思远"
DIGITS, LETTERS, HEX, CYRILLIC = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "абвгдежзиклмнопрстуфхцчшэюя"


def entities(text: Column) -> Column:
    return F.when(text.rlike(DIGITS_OR_SIGNS) | text.rlike(TITLES), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))


def alnum(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9A-Za-z]", "")


def kind_of(value: Column) -> Column:
    """Kind of a found entity; what has no format of its own was found by the words before it."""

    def whole(pattern: str) -> Column:
        return value.rlike(rf"^(?:{pattern})$")

    person = value.rlike(rf"^(?:{FEMALE_TITLES}) \p{{Lu}}")
    other = value.rlike(rf"^(?:{MALE_TITLES}) \p{{Lu}}")
    script = F.when(value.rlike(r"\p{IsCyrillic}\p{Ll}*$"), "c").otherwise("")
    titled = value.rlike(rf"^(?:{OTHER_TITLES}) \p{{Lu}}")
    # A title without a gender leaves that to the name's hash, so that it is the same everywhere.
    either = F.when(F.crc32(F.lower(F.regexp_extract(value, r"(\S+)$", 1))) % 2 == 0, "person_f").otherwise("person_m")
    out = F.when(value.startswith("-----BEGIN "), "pem").when(value.contains("@") & whole(FORMATS["email"]), "email")
    out = out.when(value.rlike(r"^\S+ \p{IsHan}+$"), "person_h")
    out = out.when(person, F.concat(F.lit("person_f"), script)).when(other, F.concat(F.lit("person_m"), script)).when(titled, F.concat(either, script))
    for name in ("key", "iban", "mac", "ip6", "ip4", "card", "ssn", "phone"):
        out = out.when(whole(FORMATS[name]), name)
    return out.when(value.rlike(r"""[=:]\s{0,2}["']?[0-9a-f]+$"""), "hex").otherwise("secret")


def canonical(kind: Column, value: Column) -> Column:
    """What mentions of one entity have in common, of which the surrogate is drawn."""
    bare = F.lower(alnum(value))
    return (
        F.when(kind == "email", F.lower(value))
        .when(kind.startswith("person"), F.lower(F.regexp_extract(value, r"^\S+ (.*)$", 1)))
        .when(kind == "ip4", value)
        .when(kind == "pem", F.lower(alnum(F.regexp_extract(value, PEM_BODY, 2))))
        .when(kind == "phone", F.when(F.length(bare) > 10, F.right(bare, F.lit(10))).otherwise(bare))
        .when(kind == "key", F.when(value.rlike("^A[KS]IA"), F.substr(bare, F.lit(5))).when(value.startswith("sk-"), F.substr(bare, F.lit(3))).otherwise(F.substr(bare, F.lit(4))))
        .when(kind == "iban", F.substring(bare, 3, 100))
        .when(kind.isin("hex", "secret"), F.lower(alnum(F.regexp_extract(value, SECRET_VALUE, 0))))
        .otherwise(bare)
    )


def byte(hashed: Column, i: Column) -> Column:
    return F.conv(F.substr(hashed, (i - 1) % 63 * 2 + 1, F.lit(2)), 16, 10).cast("int")


def one_of(letters: str, number: Column) -> Column:
    return F.substr(F.lit(letters), number % len(letters) + 1, F.lit(1))


def like(value: Column, hashed: Column, letters: Column | None = None) -> Column:
    """Digits for digits and letters for letters; hexadecimal digits for all where ``letters`` holds."""

    def char(c: Column, i: Column) -> Column:
        n = byte(hashed, i + 1)
        plain = F.when(c.rlike("[0-9]"), one_of(DIGITS, n)).when(c.rlike("[a-z]"), one_of(LETTERS, n))
        plain = plain.when(c.rlike(r"\p{IsCyrillic}"), one_of(CYRILLIC, n)).when(c.rlike(r"\p{L}"), one_of(LETTERS, n)).otherwise(c)
        return plain if letters is None else F.when(letters & c.rlike("[0-9a-f]"), one_of(HEX, n)).otherwise(plain)

    return F.when(F.length(value) > 0, F.array_join(F.transform(F.split(value, ""), char), "")).otherwise(value)


def octets(value: Column, hashed: Column, free: Column) -> Column:
    """Octets with as many digits each, of any value where ``free`` holds."""
    parts = F.split(value, r"\.")

    def octet(part: Column, i: Column) -> Column:
        n = byte(hashed, i * 2 + 1) * 256 + byte(hashed, i * 2 + 2)
        kept = F.when(F.length(part) == 3, 100 + n % 156).when(F.length(part) == 2, 10 + n % 90).otherwise(n % 10)
        return F.when(free, n % 256).otherwise(kept).cast("string")

    return F.array_join(F.transform(parts, octet), ".")


def luhn(value: Column) -> Column:
    """The same number with its last digit set right."""
    head = F.substr(value, F.lit(1), F.length(value) - 1)

    def step(total: Column, i: Column) -> Column:
        n = F.substr(head, -i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + n - F.when(n > 9, 9).otherwise(0)

    total = F.aggregate(F.sequence(F.lit(1), F.length(head)), F.lit(0), step)
    return F.concat(head, (F.pmod(10 - total % 10, F.lit(10))).cast("string"))


def key_hash(key: str, *what: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", F.lit(key), *what, F.lit(key)), 512)


def names(kind: Column, value: Column, first_hash: Column, last_hash: Column) -> Column:
    """As many names as there were, each drawn of the name it replaces: first names by gender, last names of syllables."""
    cyrillic = kind.endswith("c")

    def at(words: list[str], i: int, hashed: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, words)), byte(hashed, F.lit(i)) % len(words) + 1)

    first = F.lit("")
    for code, words in FIRST_NAMES.items():
        first = F.when(kind == f"person_{code}", F.lower(at(words, 1, first_hash))).otherwise(first)
    last = F.concat(*[F.when(cyrillic, at(SYLLABLES_CYRILLIC, i, last_hash)).otherwise(at(SYLLABLES, i, last_hash)) for i in range(1, 5)])
    han = F.concat(at([*HAN_FAMILIES], 1, last_hash), *[at([*HAN_NAMES], i, last_hash) for i in (2, 3)])
    return F.when(kind == "person_h", han).when(value.rlike("[ -]"), F.concat_ws(" ", first, last)).otherwise(last)


def with_fields(items: Column, **fields) -> Column:
    """Each struct of an array with one more field for each function of it; later stages refer to fields, so nothing is inlined twice."""

    def stage(name: str, f):
        return lambda x: x.withField(name, f(x))

    for name, f in fields.items():
        items = F.transform(items, stage(name, f))
    return items


def recognise(values: Column) -> Column:
    """Array of struct(value, kind, canonical) of found entities."""
    items = F.transform(values, lambda v: F.struct(v.alias("value")))
    return with_fields(items, kind=lambda x: kind_of(x["value"]), canonical=lambda x: canonical(x["kind"], x["value"]))


def drawn(items: Column, key: str) -> Column:
    """Array of structs that hold kind, canonical and draws, with the field ``drawn``: the surrogate of the canonical form."""

    def part(x: Column, first: bool) -> Column:
        value = x["canonical"]
        name = F.element_at(F.split(value, "[ -]"), 1 if first else -1)
        host = F.split_part(value, F.lit("@"), F.lit(2))
        return F.when(x["kind"] == "email", host).otherwise(name)

    return with_fields(
        items,
        hashed=lambda x: key_hash(key, x["kind"], x["canonical"], x["draws"].cast("string")),
        first=lambda x: key_hash(key, F.lit("first"), part(x, True), F.when(x["kind"] == "email", "").otherwise(x["draws"].cast("string"))),
        last=lambda x: key_hash(key, F.lit("last"), part(x, False), x["draws"].cast("string")),
        same=lambda x: like(x["canonical"], x["hashed"], x["kind"].isin("hex", "mac", "ip6")),
        drawn=lambda x: draw(x["kind"], x["canonical"], x["draws"], x["hashed"], x["first"], x["last"], x["same"]),
    )


def draw(kind: Column, value: Column, draws: Column, hashed: Column, first: Column, last: Column, same: Column) -> Column:
    """Surrogate of a canonical form; ``draws`` counts from 0."""
    local, domain = F.split_part(same, F.lit("@"), F.lit(1)), F.split_part(value, F.lit("@"), F.lit(2))
    inner = F.regexp_extract(domain, r"^(.*)\.[^.]+\.[^.]+$", 1)
    end = F.concat(F.lit("example."), F.element_at(F.array(*map(F.lit, ("com", "org", "net"))), byte(hashed, F.lit(60)) % 3 + 1))
    more = F.when(draws > LONGER_AFTER, like(F.lit("0000"), F.reverse(hashed))).otherwise("")
    email = F.concat(local, more, F.lit("@"), F.when(inner == "", end).otherwise(F.concat(like(inner, first), F.lit("."), end)))
    return (
        F.when(kind == "email", email)
        .when(kind == "ip4", octets(value, hashed, draws > LONGER_AFTER))
        .when(kind == "card", luhn(F.concat(F.substr(value, F.lit(1), F.lit(1)), F.substring(same, 2, 100), more)))
        .when(kind.startswith("person"), F.concat(names(kind, value, first, last), F.when(draws > LONGER_AFTER, at_end(kind, hashed)).otherwise("")))
        .otherwise(F.concat(same, more))
    )


def at_end(kind: Column, hashed: Column) -> Column:
    def more(words: list[str]) -> Column:
        return F.concat(*[F.element_at(F.array(*map(F.lit, words)), byte(hashed, F.lit(i)) % len(words) + 1) for i in range(20, 24)])

    return F.when(kind == "person_h", more([*HAN_NAMES])).when(kind.endswith("c"), more(SYLLABLES_CYRILLIC)).otherwise(more(SYLLABLES))


def woven(item: Column) -> Column:
    """The surrogate's characters in place of the entity's letters and digits after ``skip``, in their case; longer ones end it. In linear time:
    the fields ``between`` and ``own`` hold what stands between those letters and digits, and the letters and digits."""
    skip, drawn = F.greatest(item["skip"], F.lit(0)), item["chars"]

    def char(c: Column, i: Column) -> Column:
        other = F.coalesce(F.try_element_at(drawn, i - skip + 1), F.lit(""))
        return F.when(i < skip, c).when(c.rlike("[A-Z]"), F.upper(other)).otherwise(other)

    together = F.zip_with(item["between"], F.transform(item["own"], char), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    longer = F.substr(item["drawn"], F.length(item["drawn"]) + item["skip"] + 1, F.length(item["drawn"]))
    return F.concat(F.array_join(together, ""), F.when(item["skip"] < 0, longer).otherwise(""))


def rendered(items: Column) -> Column:
    """Array of structs with the field ``surrogate``, from value, kind and drawn."""
    body = lambda x: F.when(x["kind"] == "pem", F.regexp_extract(x["value"], PEM_BODY, 2)).otherwise(x["value"])
    return with_fields(
        items,
        body=body,
        skip=lambda x: F.length(alnum(x["body"])) - F.length(x["drawn"]),
        between=lambda x: F.split(x["body"], "[0-9A-Za-z]", -1),
        own=lambda x: F.regexp_extract_all(x["body"], F.lit("[0-9A-Za-z]"), F.lit(0)),
        chars=lambda x: F.split(x["drawn"], ""),
        surrogate=lambda x: render(x),
    )


def render(x: Column) -> Column:
    kind, value, drawn = x["kind"], x["value"], x["drawn"]
    return (
        F.when(kind.isin("email", "ip4"), drawn)
        .when(kind.startswith("person"), F.concat(F.regexp_extract(value, r"^(\S+ )", 1), F.initcap(drawn)))
        .when(kind == "pem", F.concat(F.regexp_extract(value, PEM_BODY, 1), woven(x), F.regexp_extract(value, PEM_BODY, 3)))
        .otherwise(woven(x))
    )


def bare_mentions(text: Column, found: Column) -> Column:
    """The text with full names that stand without a title, of persons who have one elsewhere in it, replaced too."""
    named = F.filter(found, lambda x: x["kind"].startswith("person") & x["value"].rlike(r"^\S+ \S+[ -]\S+$"))
    pairs = F.array_distinct(F.transform(named, lambda x: F.struct(*[F.regexp_extract(x[c], r"^\S+ (.*)$", 1).alias(c) for c in ("value", "surrogate")])))
    alone = lambda v: F.concat(F.lit(r"(?<![\p{L}])"), v, F.lit(r"(?![\p{L}])"))
    return F.when(F.size(pairs) > 0, F.aggregate(pairs, text, lambda t, p: F.regexp_replace(t, alone(p["value"]), p["surrogate"]))).otherwise(text)


def drawn_of(key: str, draws: Column | None = None) -> Column:
    row = F.struct(F.col("kind"), F.col("canonical"), (F.lit(0) if draws is None else draws).alias("draws"))
    return F.element_at(drawn(F.array(row), key), 1)["drawn"]


def registry_of(documents: DataFrame, text: str, key: str, scratch: Scratch) -> DataFrame:
    """kind, canonical, draws of every entity that had to be drawn anew."""
    found = documents.select(F.explode(recognise(entities(F.col(text)))).alias("e"))
    found = found.select("e.kind", "e.canonical").groupBy("kind", "canonical").count()
    known = scratch.keep(found.select("kind", "canonical", F.lit(0).alias("draws"), drawn_of(key).alias("drawn")))
    for _ in range(MOST_DRAWS):
        # One canonical form may be of several kinds, such as a name with several titles; it is one entity.
        originals = known.select(F.col("canonical").alias("drawn"), F.lit(True).alias("taken")).distinct()
        first = known.groupBy("drawn").agg(F.min(F.struct("draws", "canonical")).alias("first"))
        state = known.join(first, "drawn").join(originals, "drawn", "left")
        again = F.col("taken").isNotNull() | (F.struct("draws", "canonical") != F.col("first"))
        state = state.select("kind", "canonical", F.when(again, F.col("draws") + 1).otherwise(F.col("draws")).alias("draws"), "drawn", again.alias("again"))
        state = scratch.keep(state)
        if state.filter("again").isEmpty():
            return known.filter("draws > 0").select("kind", "canonical", "draws")
        redrawn = F.when(F.col("again"), drawn_of(key, F.col("draws"))).otherwise(F.col("drawn"))
        known = scratch.keep(state.select("kind", "canonical", "draws", redrawn.alias("drawn")))
    raise RuntimeError(f"entities still share surrogates after {MOST_DRAWS} draws")


def replace(documents: DataFrame, key: str, text: str = "text", found: str | None = None) -> DataFrame:
    """Documents with surrogates in ``text``. found: a column to add, array of struct(kind, value, surrogate) in text order."""
    spark = session_of(documents)
    scratch = Scratch(spark)
    anew = registry_of(pick(documents, text), text, key, scratch)
    count = anew.count()
    own, (at,) = numbered(documents, text)
    columns = own.columns
    out = own.withColumn("__found", entities(F.col(at)))
    if count:
        mentions = own.select(fingerprint(F.col(at)).alias("__text"), F.explode(recognise(F.array_distinct(entities(F.col(at))))).alias("e"))
        mentions = mentions.select("__text", "e.kind", "e.canonical", F.col("e.value").alias("v"))
        mentions = mentions.join(F.broadcast(anew) if count <= BROADCAST_ROWS else anew, ["kind", "canonical"])
        mentions = mentions.groupBy("__text").agg(F.collect_set(F.struct("v", "draws")).alias("__draws"))
        out = out.withColumn("__text", fingerprint(F.col(at))).join(mentions, "__text", "left").withColumn("__draws", F.map_from_entries("__draws"))
    else:
        out = out.withColumn("__draws", F.lit(None).cast("map<string,int>"))

    items = with_fields(recognise(F.col("__found")), draws=lambda x: F.coalesce(F.try_element_at(F.col("__draws"), x["value"]), F.lit(0)))
    items = rendered(drawn(items, key))
    items = F.transform(items, lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), x["surrogate"].alias("surrogate")))
    out = out.withColumn("__found", F.when(F.size("__found") > 0, items))
    between = F.split(F.col(at), PATTERN, -1)
    joined = F.array_join(F.transform(between, lambda part, i: F.concat(part, F.coalesce(F.try_element_at(F.col("__found"), i + 1)["surrogate"], F.lit("")))), "")
    out = out.withColumn("__new", F.when(F.col("__found").isNotNull(), bare_mentions(joined, F.col("__found"))).otherwise(F.col(at)))
    kept = [F.col("__new").alias(c) if c == at else F.col(c) for c in columns]
    out = out.select(*kept, *([F.col("__found").alias(found)] if found else []))
    return out.toDF(*documents.columns, *([found] if found else []))


def op3_surrogates(spark, sf_dir: str) -> DataFrame:
    documents = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    out = replace(documents, "tessera", found="found")
    return out.select("doc_id", "text", F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_replaced"), F.coalesce(F.array_sort(F.array_distinct("found.kind")), F.array().cast("array<string>")).alias("kinds"))
