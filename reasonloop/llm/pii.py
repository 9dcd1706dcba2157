"""PII surrogates with DataFrame operations only.

Entities: e-mail addresses, phone numbers, IPv4 addresses, payment card numbers (Luhn-valid
ones; other digit runs stay), US social security numbers and titled personal names (Latin and
Cyrillic). Each is replaced by a surrogate of its own type, made from sha-256 of a key and the
entity's canonical form:

* *coreference*: surfaces with one canonical form (an address in another case, a number with
  other punctuation, a surname with or without the given name) get one surrogate, in every text;
* *format*: digits stand where digits stood, the country code stays, letter case and
  punctuation stay, cards pass Luhn, addresses fall in reserved domains;
* *gender and script*: a given name's surrogate follows the title's gender, every name its script; a Cyrillic
  surname in its feminine form shares the masculine form's surrogate and takes a feminine ending;
* *distinctness*: surrogates of a type are compared with each other and with all entities that
  occur; of those that collide all but one draw again until none is left. From the ``WIDEN``-th draw on the
  forms get longer (more digits or syllables, IPv6 for IPv4), so a type whose form space is full still ends.

A name is a chain of titles and up to four words, with initials, particles, hyphens, apostrophes and inner capitals; its last
word is the surname. Each hyphenated piece is an entity, particles stay, initials move by one keyed rotation of the alphabet (distinct,
and alike everywhere). Capitalised words of a fixed list (days, months, sentence starts) do not continue a name; other
capitalised words after a name are taken as its part.

Mapping tables hold distinct entities only. Texts without an entity are not shuffled; the others meet their replacements by an equi-join on
the text's md5, so copies of a text share one row there. Null texts stay null, texts without
entities stay as they are; repeated rows are changed alike; every other column passes through.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import packed

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE = (r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)"
         r"|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d.-])\d{3}-\d{3}-\d{4}(?![\d-])")
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)"
CARD = r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\d)"
#: Titles by gender, particles inside names, capitalised words that do not continue a name.
MALE = ("Mr", "Herr", "Herrn", "Sir", "Monsieur", "Señor", "Sr", "господин", "господина", "господину")
FEMALE = ("Mrs", "Ms", "Miss", "Lady", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "госпожа", "госпожи", "госпоже")
NEUTRAL = ("Dr", "Prof", "Professor", "Mx", "доктор", "профессор")
PARTICLES = ("von", "van", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "zu", "zur", "ter", "ten", "bin", "ibn", "al", "el", "y")
NO_NAME = ("Yesterday", "Today", "Tomorrow", "Now", "Then", "Here", "There", "However", "The", "This", "That", "These", "Those", "He", "She",
           "It", "They", "We", "You", "But", "And", "Or", "If", "When", "While", "After", "Before", "Monday", "Tuesday", "Wednesday",
           "Thursday", "Friday", "Saturday", "Sunday", "January", "February", "March", "April", "May", "June", "July", "August",
           "September", "October", "November", "December", "Gestern", "Heute", "Morgen", "Der", "Die", "Das", "Er", "Sie", "Es", "Wir",
           "Und", "Aber", "Montag", "Dienstag", "Mittwoch", "Donnerstag", "Freitag", "Samstag", "Sonntag", "Hier", "Le", "La", "Les", "El", "Los",
           "Il", "Elle", "Demain", "Ayer", "Hoy", "Pero", "Mais", "Вчера", "Сегодня", "Завтра", "Он", "Она", "Но", "И", "Это")
WIDEN = 6
_TITLE = "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))
_TITLES = rf"(?:{_TITLE})(?:\.? (?:{_TITLE})(?!\p{{L}}))*+\.? "
_UP, _LOW = r"[\p{Lu}&&[\p{IsLatin}\p{IsCyrillic}]]", r"[\p{Ll}\p{M}]"
#: one piece of a name word: Smith, McDonald, O'Neil
UNIT = rf"(?:{_UP}['’])?{_UP}{_LOW}++(?:{_UP}{_LOW}++)*+"
_WORD = rf"(?!(?:{'|'.join(NO_NAME)}|{_TITLE})(?!\p{{L}})){UNIT}(?:-{UNIT})*+"
_BEFORE = rf"(?:(?:{_UP}(?:\. ?| ))++|(?:(?:{'|'.join(PARTICLES)}) )++)*+"
NAME = rf"(?<!\p{{L}}){_TITLES}{_BEFORE}{_WORD}(?: {_BEFORE}{_WORD}){{0,3}}"
ENTITY = "|".join((EMAIL, PHONE, SSN, IP, CARD, NAME))
TYPES = (("email", EMAIL), ("phone", PHONE), ("ssn", SSN), ("ip", IP), ("card", CARD), ("name", NAME))
PART = "array<struct<i:int,type:string,canon:string>>"


def _let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def _luhn_sum(digits: Column, double_last: bool) -> Column:
    """Luhn sum; ``double_last`` for digits that still lack their check digit."""
    first = 1 if double_last else 0
    total = F.aggregate(
        F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
        F.struct(F.lit(first).alias("i"), F.lit(0).alias("s")),
        lambda a, c: F.struct((a["i"] + 1).alias("i"), (a["s"] + _let(
            c.cast("int") * (a["i"] % 2 + 1), lambda d: d - F.when(d > 9, 9).otherwise(0))).alias("s")))
    return total["s"]


def classify(surface: Column) -> Column:
    """Type of a found surface; null for digit runs that are no card."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(TYPES):
        kind = F.when(surface.rlike(rf"^(?:{pattern})$"), F.lit(name)).otherwise(kind)
    return kind


def _body(surface: Column) -> Column:
    return F.regexp_replace(surface, f"^{_TITLES}", "")


def _units(surface: Column) -> tuple[Column, Column]:
    """The pieces of a name's words in order, and how many of them the last word has."""
    body = _body(surface)
    return (F.regexp_extract_all(body, F.lit(UNIT), F.lit(0)),
            F.size(F.regexp_extract_all(F.substring_index(body, " ", -1), F.lit(UNIT), F.lit(0))))


def _gender(surface: Column) -> Column:
    """f or m from the titles (of several the first that tells), n where none tells."""
    titles = F.regexp_extract(surface, f"^{_TITLES}", 0)

    def any_of(names: tuple[str, ...]) -> Column:
        return titles.rlike(rf"(?<!\p{{L}})(?:{'|'.join(names)})(?!\p{{L}})")

    return F.when(any_of(FEMALE), F.lit("f")).when(any_of(MALE), F.lit("m")).otherwise(F.lit("n"))


def _feminine(low: Column, gender: Column) -> Column:
    """Whether a lower-case Cyrillic surname stands in its feminine form; after a title without
    gender only the endings that no masculine surname has count."""
    return (((gender == "f") & low.rlike("(?:[её]в|ов|ин|ын)а$")) | ((gender != "m") & low.rlike("(?:(?:[её]в|ов)а|[сц]кая)$")))


def _masculine(low: Column, gender: Column) -> Column:
    return F.when(~_feminine(low, gender), low).when(low.endswith("ая"), F.regexp_replace(low, "ая$", "ий")) \
        .otherwise(F.regexp_replace(low, "а$", ""))


def parts(kind: Column, surface: Column) -> Column:
    """The entities of a surface with their canonical forms, in order."""
    def one(type_: Column, canon: Column, i: int = 0) -> Column:
        return F.struct(F.lit(i).alias("i"), type_.alias("type"), canon.alias("canon"))

    digits = _digits(surface)
    units, of_last = _units(surface)
    gender = _gender(surface)

    def script(w: Column) -> Column:
        return F.when(w.rlike(r"\p{IsCyrillic}"), F.lit("cyr")).otherwise(F.lit("lat"))

    def unit(w: Column, i: Column) -> Column:
        low = F.translate(F.lower(w), "’", "'")
        last = i >= F.size(units) - of_last
        type_ = F.when(last, F.concat_ws("_", F.lit("surname"), script(w))).otherwise(F.concat_ws("_", F.lit("given"), gender, script(w)))
        return F.struct(i.cast("int").alias("i"), type_.alias("type"),
                        F.when(last, _masculine(low, gender)).otherwise(low).alias("canon"))

    return (F.when(kind == "email", F.array(one(kind, F.lower(surface))))
            .when(kind == "phone", F.array(one(F.concat(kind, F.least(F.length(digits), F.lit(10)).cast("string")),
                                               F.substr(digits, F.greatest(F.length(digits) - 9, F.lit(1)), F.lit(10)))))
            .when(kind == "card", F.array(one(F.concat(kind, F.length(digits).cast("string")), digits)))
            .when(kind == "ssn", F.array(one(kind, digits)))
            .when(kind == "ip", F.array(one(kind, surface)))
            .when(kind == "name", F.transform(units, unit))).cast(PART)


def surrogate(type_: Column, canon: Column, key: str, attempt: Column) -> Column:
    """The surrogate canonical form that a keyed hash of (type, form, attempt) gives."""
    seed = F.concat_ws("|", F.lit(key), type_, canon, attempt.cast("string"))

    def made(h: Column) -> Column:
        d = F.translate(h, "abcdef", "012345")
        letters = F.translate(h, "0123456789abcdef", "abcdefghijklmnop")
        wider = F.greatest(attempt - (WIDEN - 1), F.lit(0))
        n = F.length(canon) + wider
        # the area code of a full number does not start with 0 or 1
        phone = F.concat(F.translate(F.substr(d, F.lit(1), F.lit(1)), "01", "89"), F.substr(d, F.lit(2), n - 1))
        body = F.concat(F.substr(canon, F.lit(1), F.lit(1)), F.substr(d, F.lit(2), n - 2))
        card = F.concat(body, F.pmod(-_luhn_sum(body, True), F.lit(10)).cast("string"))
        ssn = F.concat(F.lit("9"), F.substr(d, F.lit(2), wider + 8))

        def octet(i: int, most: int) -> Column:
            return (F.conv(F.substr(h, F.lit(4 * i + 1), F.lit(4)), 16, 10).cast("int") % most + 1).cast("string")

        ip = F.when(wider > 0, F.concat_ws(":", F.lit("2001:db8"), *[F.substr(h, F.lit(4 * i + 1), F.lit(4)) for i in range(6)])) \
            .otherwise(F.concat_ws(".", octet(0, 223), octet(1, 254), octet(2, 254), octet(3, 254)))
        local = F.split(F.substring_index(canon, "@", 1), "")
        swapped = F.array_join(F.transform(local, lambda c, i: F.when(
            c.rlike("[0-9]"), F.substr(d, i % 64 + 1, F.lit(1))).when(
            c.rlike("[a-z]"), F.substr(letters, i % 64 + 1, F.lit(1))).otherwise(c)), "")
        email = F.concat(swapped, F.lit("@mail"), F.substr(d, F.lit(44), wider + 6), F.lit(".example."),
                         F.element_at(F.array(F.lit("com"), F.lit("org"), F.lit("net")),
                                      F.conv(F.substr(h, F.lit(60), F.lit(3)), 16, 10).cast("int") % 3 + 1))

        def name(consonants: str, vowels: str, ending: Column) -> Column:
            def pick(i: int, letters: str) -> Column:
                return F.substr(F.lit(letters), F.conv(F.substr(h, F.lit(i), F.lit(3)), 16, 10).cast("int") % len(letters) + 1,
                                F.lit(1))
            syllables = [F.concat(pick(6 * i + 1, consonants), pick(6 * i + 4, vowels)) for i in range(3)]
            more = F.when(attempt > 0, F.concat(pick(25, consonants), pick(28, vowels))).otherwise(F.lit(""))
            most = F.when(wider > 0, F.concat(pick(31, consonants), pick(34, vowels), pick(37, consonants), pick(40, vowels))).otherwise(F.lit(""))
            return F.concat(*syllables, more, most, ending)

        latin = name("bdfghjklmnprstvz", "aeiou", F.when(type_.startswith("given_f"), F.lit("la"))
                     .when(type_.startswith("given_m"), F.lit("rd")).when(type_.startswith("given_n"), F.lit("is")).otherwise(F.lit("ns")))
        cyrillic = name("бвгджзклмнпрстфх", "аеиоу", F.when(type_.startswith("given_f"), F.lit("на"))
                        .when(type_.startswith("given_m"), F.lit("р")).when(type_.startswith("given_n"), F.lit("ли")).otherwise(F.lit("в")))
        return (F.when(type_ == "email", email).when(type_.startswith("phone"), phone).when(type_.startswith("card"), card)
                .when(type_ == "ssn", ssn).when(type_ == "ip", ip).when(type_.endswith("_cyr"), cyrillic).otherwise(latin))

    return _let(F.sha2(seed.cast("binary"), 256), made)


def assign_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(type, canon, made): surrogates distinct within a type and equal to no entity. Each
    round only those that collide draw again."""
    entities = materialize(entities.distinct(), "pii-entities")
    todo, done, attempt = entities, None, 0
    while True:
        drawn = materialize(todo.select("type", "canon", surrogate(F.col("type"), F.col("canon"), key, F.lit(attempt))
                                        .alias("made")), "pii-drawn")
        first = drawn.groupBy("type", "made").agg(F.min("canon").alias("canon"))
        taken = entities.select("type", F.col("canon").alias("made"))
        if done is not None:
            taken = taken.unionByName(done.select("type", "made"))
        good = materialize(first.join(taken.distinct(), ["type", "made"], "left_anti").select("type", "canon", "made"), "pii-good")
        done = good if done is None else done.unionByName(good)
        todo = materialize(drawn.join(good, ["type", "canon"], "left_anti").select("type", "canon"), "pii-again")
        attempt += 1
        if todo.isEmpty():
            return done


def _refill(surface: Column, pattern: str, chars: Column) -> Column:
    """``surface`` with its characters that match ``pattern`` replaced in turn by ``chars``."""
    return F.aggregate(
        F.filter(F.split(surface, ""), lambda c: c != ""), F.struct(F.lit("").alias("o"), F.lit(1).alias("i")),
        lambda a, c: F.when(c.rlike(pattern), F.struct(F.concat(a["o"], F.substr(chars, a["i"], F.lit(1))).alias("o"),
                                                       (a["i"] + 1).alias("i")))
        .otherwise(F.struct(F.concat(a["o"], c).alias("o"), a["i"].alias("i"))),
        lambda a: F.concat(a["o"], F.substr(chars, a["i"], F.length(chars))))


#: Alphabets of initials, each rotated by itself.
INITIALS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ÀÁÂÄÅÇÈÉÍÎÑÓÖØÚÜČŁŚŠŽ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ")


def _rotated(text: Column, key: str) -> Column:
    """``text`` with its initials moved inside their alphabets by a number of places drawn from ``key`` (never none)."""
    turn = int(hashlib.sha256(f"{key}|initials".encode()).hexdigest(), 16)
    turned = [a[(k := 1 + turn % (len(a) - 1)):] + a[:k] for a in INITIALS]
    return F.translate(text, "".join(INITIALS), "".join(turned))


def render(kind: Column, surface: Column, made: Column, key: str) -> Column:
    """The surface's replacement from its surrogate forms (array by part)."""
    first, digits = F.element_at(made, 1), _digits(surface)
    kept = F.substr(digits, F.lit(1), F.greatest(F.length(digits) - 10, F.lit(0)))
    gaps, (units, of_last), gender = F.split(_body(surface), UNIT, -1), _units(surface), _gender(surface)

    def written(m: Column, i: Column) -> Column:
        feminine = (i >= F.size(units) - of_last) & _feminine(F.lower(F.get(units, i)), gender)
        return F.concat(F.initcap(m), F.when(feminine, F.lit("а")).otherwise(F.lit("")), _rotated(F.get(gaps, i + 1), key))

    name = F.concat(F.regexp_extract(surface, f"^{_TITLES}", 0), _rotated(F.get(gaps, F.lit(0)), key),
                    F.array_join(F.transform(made, written), ""))
    email = F.when(F.upper(surface) == surface, F.upper(first)).otherwise(first)
    return (F.when(kind == "email", email)
            .when(kind == "phone", _refill(surface, "[0-9]", F.concat(kept, first)))
            .when(kind.isin("card", "ssn"), _refill(surface, "[0-9]", first))
            .when(kind == "ip", first)
            .otherwise(name))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str = "n_replaced",
                 kinds_col: str = "kinds") -> DataFrame:
    """``docs`` with entities replaced in ``text_col``, plus the number of replacements and the
    sorted types found (comma-joined); these two stand in place of columns of ``docs`` so named."""
    docs = docs.drop(count_col, kinds_col)
    t = F.col(text_col).cast("string")
    names = docs.columns
    # texts with an entity are written aside once; the others pass through and are never shuffled
    some = F.coalesce(t.rlike(ENTITY), F.lit(False))
    row = F.col("row")
    inner = row.getField(text_col).cast("string")
    keyed = materialize(packed(docs.where(some)).withColumn("__m", F.regexp_extract_all(inner, F.lit(ENTITY), F.lit(0)))
                        .withColumn("__th", F.md5(inner.cast("binary"))), "pii-matched")
    found = materialize(keyed.select(F.col("__th").alias("th"), F.col("__m").alias("m")).dropDuplicates(["th"]), "pii-found")
    surfaces = found.select(F.explode("m").alias("surface")).distinct().withColumn("kind", classify(F.col("surface")))
    luhn = F.pmod(_luhn_sum(_digits(F.col("surface")), False), F.lit(10)) == 0
    surfaces = surfaces.where(F.col("kind").isNotNull()).where(F.when(F.col("kind") == "card", luhn).otherwise(F.lit(True)))
    surfaces = materialize(surfaces.withColumn("parts", parts(F.col("kind"), F.col("surface"))), "pii-surfaces")
    each = surfaces.select("kind", "surface", F.explode("parts").alias("p")).select("kind", "surface", "p.*")
    made = assign_surrogates(each.select("type", "canon"), key)
    forms = (each.join(made, ["type", "canon"]).groupBy("kind", "surface")
             .agg(F.array_sort(F.collect_list(F.struct("i", "made"))).alias("made"))       # the pieces of one name
             .select("surface", "kind", render(F.col("kind"), F.col("surface"), F.transform("made", lambda x: x["made"]), key).alias("to")))
    forms = materialize(forms, "pii-forms")
    hits = (found.select("th", F.posexplode("m").alias("i", "surface")).join(forms, "surface")
            .groupBy("th").agg(F.collect_list(F.struct("i", "to", "kind")).alias("hits")))     # of one text
    hits = materialize(hits, "pii-hits")
    joined = keyed.join(hits, F.col("__th") == F.col("th"), "left")
    by_place = F.map_from_entries(F.transform("hits", lambda x: F.struct(x["i"], x["to"])))
    gaps = F.split(inner, ENTITY, -1)
    text = F.concat_ws("", F.flatten(F.transform(gaps, lambda g, i: F.array(g, F.coalesce(
        F.element_at(F.col("__by"), i), F.get(F.col("__m"), i), F.lit(""))))))
    joined = joined.withColumn("__by", by_place)
    new = F.when(F.col("hits").isNotNull(), text).otherwise(inner)
    changed = joined.withColumn("__new", new).select(
        *[(F.col("__new") if c == text_col else row.getField(c)).alias(c) for c in names],
        F.coalesce(F.size("hits"), F.lit(0)).cast("long").alias(count_col),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda x: x["kind"]))), ","), F.lit("")).alias(kinds_col))
    rest = docs.where(~some).withColumn(count_col, F.lit(0).cast("long")).withColumn(kinds_col, F.lit(""))
    return changed.unionByName(rest.withColumn(text_col, t))
