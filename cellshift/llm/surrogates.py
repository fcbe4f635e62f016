"""Operator 8: personal data replaced by keyed surrogates, in DataFrame functions alone.

One pattern finds all entities; the text between them stays as it is. A surrogate follows from a keyed
hash of the entity's kind and canonical form, so an entity gets the same replacement in every document, and
it keeps the entity's format: digits for digits, letters of the same case and script, separators in place,
country codes, card issuers' first digit and valid check digits, titles and the gender they tell.

Distinctness is checked over all distinct entities: where two surrogates meet, or one equals an entity
that occurs, all but the smallest take their next attempt, until no collision is left. Only these
exceptions (none, mostly) are joined back to documents; everything else is row by row.

Defined cases: null stays null, empty stays empty; texts without entities are returned untouched; repeated
rows are rewritten alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellshift.llm.common import let, materialize

KEY_SETTING = "spark.cellshift.surrogates.key"  # where a cluster keeps the real key
KEY = "surrogate-key"  # for sessions without that setting, as in tests

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# Titles that tell a gender, and those that don't.
MALE, FEMALE, OPEN = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"], ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"], ["Dr", "Prof"]
_LABEL = r"(?i:token|secret|api_key|apikey|passwd|password) ?[=:]"  # what a secret stands behind
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "secret": rf"(?<={_LABEL} ?[\"']?)[A-Za-z0-9+/_-]{{12,}}+",
    "aws": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![\d.])(?:\+\d{1,3}[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.])\+\d{1,3}(?:[ .-]\d{2,4}){2,5}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "card": r"(?<![\d.-])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\d-])",
    "name": rf"(?<![\p{{L}}])(?:{'|'.join(MALE + FEMALE + OPEN)})\.? \p{{Lu}}\p{{Ll}}++(?: \p{{Lu}}\p{{Ll}}++)?",
}
EVERY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What any text with an entity holds (secrets and access keys may be letters only): tells most clean texts at once.
HINT = rf"[0-9@]|AKIA|{_LABEL}|(?:{'|'.join(MALE + FEMALE + OPEN)})\.? \p{{Lu}}"
_NOT_ALNUM = r"[^\p{L}\p{N}]"
# Given names and syllables that surrogate names are made of.
GIVEN = {
    "m": "Adam Boris Carl David Emil Felix Georg Henrik Ivan Jonas Karl Leon Martin Noah Oskar Paul".split(),
    "f": "Anna Berta Clara Diana Emma Flora Greta Hanna Irene Julia Karla Lena Maria Nora Olga Paula".split(),
    "cm": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Семён Юрий".split(),
    "cf": "Анна Вера Галина Дарья Елена Жанна Инна Ксения Лидия Мария Нина Ольга Полина Раиса Софья Юлия".split(),
}
SYLLABLES = {
    "l": "ba be bo da de di fa fe ga go ha he ka ke ko la le li lo ma me mi na ne ni ra re ri sa ta to va".split(),
    "c": "ба бе бо ва ве ви го да де ди за зе ка ке ко ла ле ли ло ма ме ми на не ни ра ре ри са та то ха".split(),
}


def kind_of(e: Column) -> Column:
    """The kind of an entity that EVERY has matched, from its own form."""
    digits = F.regexp_replace(e, r"\D", "")
    out = F.when(F.instr(e, "@") > 0, "email").when(e.rlike(rf"^(?:{'|'.join(MALE + FEMALE + OPEN)})\.? \p{{Lu}}"), "name")
    out = out.when(e.rlike(r"^AKIA[A-Z0-9]{16}$"), "aws").when(e.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), "ip").when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
    out = out.when(e.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$"), "phone").when(e.rlike(r"^[\d -]+$") & F.length(digits).between(13, 19), "card")
    return out.when(e.rlike(r"^[A-Z]{2}\d{2} ?[A-Z0-9]{4}"), "iban").otherwise("secret")


def canonical(e: Column, kind: Column) -> Column:
    """What makes two mentions the same entity: case of addresses, separators of numbers don't."""
    bare = F.regexp_replace(e, _NOT_ALNUM, "")
    return F.when(kind == "email", F.lower(e)).when(kind.isin("phone", "card", "iban", "ssn"), bare).when(kind == "name", F.regexp_replace(e, r"\.", "")).otherwise(e)


def _seed(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("\u0001", *[F.lit(p) if isinstance(p, str) else p for p in parts]), 512)


def _byte(seed: Column, i: Column | int) -> Column:
    """Number 0 to 255 from place i of a hash, cyclic."""
    at = (F.lit(i) if isinstance(i, int) else i) % 63
    return F.conv(F.substring(seed, at * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(values: list[str] | str, number: Column) -> Column:
    options = F.array(*[F.lit(v) for v in values])
    return F.element_at(options, (number % len(values)) + 1)


def _letter(c: Column, number: Column, hexadecimal: Column) -> Column:
    upper = (c != F.lower(c))
    cyrillic = c.rlike(r"\p{IsCyrillic}")
    greek = c.rlike(r"\p{IsGreek}")
    found = F.when(hexadecimal, _pick("abcdef", number)).when(cyrillic, _pick("абвгдежзиклмнопрстуфхцчшэюя", number)).when(greek, _pick("αβγδεζηθικλμνξοπρστυφχψω", number))
    found = found.otherwise(_pick("abcdefghijklmnopqrstuvwxyz", number))
    return F.when(upper, F.upper(found)).otherwise(found)


def _spelled(e: Column, kind: Column, seed: Column) -> Column:
    """e with letters and digits replaced in place, the kind's fixed beginning kept.

    Numbers that may be written with separators are spelled without them first, so that they agree however they are
    written; they are short. All else, of any length, goes character by character.
    """

    def char(c: Column, i: Column, kept: Column, hexadecimal: Column) -> Column:
        number = _byte(seed, i)
        digit = F.when(kind == "aws", 2 + number % 6).when((kind == "phone") & (i == kept + 1), 2 + number % 8).otherwise(number % 10)
        return F.when(i <= kept, c).when(c.rlike(r"^\p{N}$"), digit.cast("string")).when(c.rlike(_NOT_ALNUM), c).otherwise(_letter(c, number, hexadecimal))

    def along(text: Column, kept: Column, hexadecimal: Column) -> Column:
        return F.array_join(F.transform(F.split(text, ""), lambda c, j: char(c, j + 1, kept, hexadecimal)), "")

    def new(bare: Column, kept: Column) -> Column:
        spelled = along(bare, kept, F.lit(False))
        return F.when((kind == "card") & (_luhn(bare) % 10 == 0), let(spelled, _checked)).otherwise(spelled)

    def back(letters: Column) -> Column:
        def one(j: Column) -> Column:
            c = F.substring(e, j, F.lit(1))
            nth = F.length(F.regexp_replace(F.substring(e, F.lit(1), j), _NOT_ALNUM, ""))
            return F.when(c.rlike(_NOT_ALNUM), c).otherwise(F.substring(letters, nth, F.lit(1)))

        return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(e), F.lit(1))), one), "")

    country = F.length(F.regexp_extract(e, r"^\+(\d+)", 1))
    kept = F.when(kind == "card", 1).when(kind == "iban", 2).when(kind == "phone", country).otherwise(0)
    hexadecimal = (kind == "secret") & e.rlike(r"^[0-9a-f]++$|^[0-9A-F]++$")
    bare = F.regexp_replace(e, _NOT_ALNUM, "")
    separated = let(let(F.struct(bare.alias("b"), kept.alias("k")), lambda x: new(x.b, x.k)), back)
    whole = let(F.struct(F.when(kind == "aws", 4).otherwise(0).alias("k"), hexadecimal.alias("h")), lambda x: along(e, x.k, x.h))
    return F.when(kind.isin("phone", "card", "iban", "ssn"), separated).otherwise(whole)


def _luhn(digits: Column) -> Column:
    """Luhn sum: every second digit from the right, doubled, counts its own digits."""
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return total + F.coalesce(F.when(i % 2 == 1, twice).otherwise(d), F.lit(0))

    return F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0), step)


def _checked(digits: Column) -> Column:
    head = F.substring(digits, F.lit(1), F.length(digits) - 1)
    return F.concat(head, ((10 - _luhn(F.concat(head, F.lit("0"))) % 10) % 10).cast("string"))


def _name(e: Column, key: str, attempt: Column) -> Column:
    """Title kept; given name of the title's gender and a surname, each from its own part, so parts refer alike."""
    title, first, last = (F.regexp_extract(e, r"^(\S+) (\S+)(?: (\S+))?$", g) for g in (1, 2, 3))
    bare = F.regexp_replace(title, r"\.", "")
    cyrillic = first.rlike(r"\p{IsCyrillic}")
    gender = F.when(bare.isin(*MALE), "m").when(bare.isin(*FEMALE), "f").otherwise("o")
    seed = _seed(key, "given", F.lower(first), gender, attempt)
    man = F.when(gender == "o", _byte(seed, 9) % 2 == 0).otherwise(gender == "m")

    def given(m: str, f: str) -> Column:
        return F.when(man, _pick(GIVEN[m], _byte(seed, 0))).otherwise(_pick(GIVEN[f], _byte(seed, 0)))

    def surname(part: Column) -> Column:
        s = _seed(key, "surname", F.lower(part), attempt)
        latin, other = (F.concat(*[_pick(SYLLABLES[k], _byte(s, i)) for i in range(4)]) for k in "lc")
        return F.initcap(F.when(cyrillic, other).otherwise(latin))

    named = F.concat(F.when(cyrillic, given("cm", "cf")).otherwise(given("m", "f")), F.lit(" "), surname(last))
    return F.concat(title, F.lit(" "), F.when(last == "", surname(first)).otherwise(named))


def surrogate(e: Column, key: str, attempt: Column) -> Column:
    """The replacement of an entity at an attempt, from 0."""

    def made(kind: Column, seed: Column) -> Column:
        local, domain = F.substring_index(e, "@", 1), F.lower(F.substring_index(e, "@", -1))
        host = F.concat(F.lit("@h"), F.substring(_seed(key, "host", domain), 1, 8), F.lit(".example.org"))
        ip = F.concat_ws(".", (1 + _byte(seed, 0) % 223).cast("string"), *[_byte(seed, i).cast("string") for i in (1, 2, 3)])
        name = _name(e, key, attempt.cast("string"))
        return F.when(kind == "ip", ip).when(kind == "name", name).when(kind == "email", F.concat(_spelled(local, kind, seed), host)).otherwise(_spelled(e, kind, seed))

    return let(kind_of(e), lambda kind: let(_seed(key, kind, canonical(e, kind), attempt.cast("string")), lambda seed: made(kind, seed)))


def entities(text: str = "text") -> Column:
    """All entities of a text in order; an empty array where there can be none."""
    return F.when(F.col(text).rlike(HINT), F.regexp_extract_all(text, F.lit(EVERY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, KEY)


def exceptions(mentions: DataFrame, key: str, max_rounds: int = 40) -> DataFrame | None:
    """(kind, canon, attempt) of entities whose first surrogate would not be their own alone; None if there are none.

    mentions (entity): any number of rows of each; they are made distinct first.
    """
    kind = kind_of(F.col("entity"))
    known = materialize(mentions.select("entity").distinct().select(kind.alias("kind"), canonical(F.col("entity"), kind).alias("canon"), "entity")
                        .groupBy("kind", "canon").agg(F.min("entity").alias("entity")), "entities")
    tried, bumped = known.withColumn("attempt", F.lit(0)), False
    for _ in range(max_rounds):
        made = surrogate(F.col("entity"), key, F.col("attempt"))
        now = materialize(tried.withColumn("other", canonical(made, F.col("kind"))), "surrogates")
        taken = now.join(known.select(F.col("kind").alias("k"), F.col("canon").alias("c")), (F.col("kind") == F.col("k")) & (F.col("other") == F.col("c")), "left_semi").select("kind", "canon")
        owner = now.groupBy("kind", "other").agg(F.min(F.struct("attempt", "canon")).alias("first"), F.count("*").alias("n")).where("n > 1")
        met = now.join(owner.select(F.col("kind").alias("k"), F.col("other").alias("o"), F.col("first.canon").alias("f")), (F.col("kind") == F.col("k")) & (F.col("other") == F.col("o"))).where("canon <> f").select("kind", "canon")
        lost = materialize(taken.union(met).distinct().select(F.col("kind").alias("k"), F.col("canon").alias("c")), "collisions")
        if lost.isEmpty():
            return now.where("attempt > 0").select("kind", "canon", "attempt") if bumped else None
        bumped = True
        tried = now.join(lost, (F.col("kind") == F.col("k")) & (F.col("canon") == F.col("c")), "left").select("kind", "canon", "entity", (F.col("attempt") + F.col("k").isNotNull().cast("int")).alias("attempt"))
    raise RuntimeError("surrogates still collide: a kind has more entities than replacements")


def replace(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with text rewritten, and n_entities; other columns stay. The key is the session's unless given."""
    columns, key = docs.columns, key or session_key(docs.sparkSession)
    found = docs.withColumn("__found", entities())
    odd = exceptions(docs.select(F.explode(entities()).alias("entity")), key)
    if odd is None:
        attempt_of = lambda e: F.lit(0)
    else:
        marked = docs.select("doc_id", F.xxhash64("text").alias("same"), F.explode(F.array_distinct(entities())).alias("entity"))
        kind = kind_of(F.col("entity"))
        keyed = marked.withColumn("kind", kind).withColumn("canon", canonical(F.col("entity"), kind)).join(odd.withColumnsRenamed({"kind": "k", "canon": "c"}), (F.col("kind") == F.col("k")) & (F.col("canon") == F.col("c")))
        per_doc = keyed.groupBy(F.col("doc_id").alias("__doc"), F.col("same").alias("__same")).agg(F.map_from_entries(F.collect_set(F.struct("entity", "attempt"))).alias("__attempts"))
        found = found.join(per_doc, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.xxhash64("text") == F.col("__same")), "left")
        attempt_of = lambda e: F.coalesce(F.element_at(F.coalesce("__attempts", F.create_map().cast("map<string,int>")), e), F.lit(0))
    new = F.transform("__found", lambda e: surrogate(e, key, attempt_of(e)))
    gaps = F.split("text", EVERY, -1)
    woven = F.array_join(F.flatten(F.zip_with(gaps, new, lambda g, s: F.array(F.coalesce(g, F.lit("")), F.coalesce(s, F.lit(""))))), "")
    text = F.when(F.size("__found") > 0, woven).otherwise(F.col("text")).alias("text")
    return found.select(*[text if c == "text" else F.col(c) for c in columns], F.size("__found").alias("n_entities"))
