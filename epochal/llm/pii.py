"""Surrogates for personal data, in DataFrame functions alone.

Patterns find e-mail and IP addresses, phone, card and account numbers and titled names. What they find is taken apart
into entities: a number without its punctuation, an address in lower case, of a name the family name and, by gender,
the given name. So all spellings of a number or an address are one entity, and "Mr. Keller", "Herr Keller" and "Mrs
Clara Keller" share a family name before and after. Every entity gets one replacement, derived from a key and the
entity alone: of the same type and format, letters for letters of the same script, digits for digits, a card's check
digit valid where it was, a given name of the gender that the title tells; each spelling gets it back in its own
case, punctuation and title. Replacements are checked over the whole corpus: where two entities of a kind would get
the same one, or one would get what is itself an entity of the corpus, all but the smallest try again with the next
derivation, until all are distinct. From the ninth on a derivation is longer by a character or syllable a turn (an IP
address becomes one of version 6), so that a format with too few values can't run out.

Null texts stay null and have no entity. Repeated rows are replaced alike. Columns other than those named aren't
looked at; an empty table gives an empty table. Names without a title aren't found. A domain of more than 60 labels is
none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

KINDS = ("email", "ip", "iban", "card", "phone", "name")
MALE, FEMALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"), ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Sra", "Госпожа")
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
NAME = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
PATTERNS = {
    "email": r"(?<![\pL\pN._%+-])[\pL\pN._%+-]++@(?:[\pL\pN-]{1,63}+\.){1,60}\pL{2,63}",
    "ip": rf"(?<![\pN.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\pN)",
    "iban": r"(?<![\pL\pN])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\pL\pN])",
    "card": r"(?<![\pL\pN.-])\d(?:[ -]?\d){12,18}(?![\pL\pN])",
    "phone": r"(?<![\pL\pN.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\pL\pN])",
    "name": rf"(?<!\pL)(?:{'|'.join(MALE + FEMALE)})\.? {NAME}(?: {NAME})?(?!\pL)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
HINT = rf"[@0-9]|(?<!\pL)(?:{'|'.join(MALE + FEMALE)})\.? "
#: Given names by script and gender, and the syllables that family names, and given names beyond the list, are made of.
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karim Leo Marco Nils Oscar Pablo Quentin Raul Simon Thomas Urban Victor Walter Yann".split(),
    ("latin", "f"): "Anna Berta Clara Diana Elena Frida Greta Hanna Irene Julia Karin Laura Maria Nora Olivia Paula Rita Sara Teresa Ursula Vera Wanda Yvonne Zoe".split(),
    ("cyrillic", "m"): "Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Леонид Максим Никита Олег Павел Роман Семён Тимур".split(),
    ("cyrillic", "f"): "Анна Белла Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия Мария Нина Ольга Полина Раиса".split(),
}
SYLLABLES = {"latin": "ba bel bri car da del dor fa fen gar hal hen jo kar kel la len lin mar mel mo nor ol per ra ren ro sal sen tor ul va ver wal wen za".split(), "cyrillic": "ба бел вол гор де дол ер жу зи кар кры лав ла мар мо нос па пол ро ряб со сол ти тур фе шу".split()}
ENDINGS = {"latin": "berg dorf er ini ley man nen ov sen son ström ton vez well".split(), "cyrillic": ("ов", "ев", "ин")}
GIVEN_ENDINGS = {("latin", "m"): ("an", "el", "is", "o"), ("latin", "f"): ("a", "ia", "ina", "elle"), ("cyrillic", "m"): ("ан", "ий", "ор"), ("cyrillic", "f"): ("а", "ина", "ия")}
#: From this attempt on replacements grow.
GROWS = 8


def kind_of(entity: Column) -> Column:
    found = F.lit(KINDS[-1])
    for kind in reversed(KINDS[:-1]):
        found = F.when(entity.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(found)
    return found


def entities_of(kind: Column, surface: Column) -> Column:
    """What a surface is made of, as an array of (kind, entity): a name of its family and its given name, others of
    one entity. What all spellings share is the entity."""
    bare = F.regexp_replace(surface, r"[^\pL\pN]", "")
    whole = F.when(kind.isin("card", "phone", "iban"), bare).when(kind == "email", F.lower(surface)).otherwise(surface)
    of = lambda k, e: F.struct(k.alias("kind"), e.alias("entity"))
    family = of(F.lit("family"), family_stem(surface))
    given = of(F.concat(F.lit("given "), gender(surface)), F.get(words(surface), F.lit(0)))
    names = F.when(F.size(words(surface)) > 1, F.array(family, given)).otherwise(F.array(family))
    return F.when(kind == "name", names).otherwise(F.array(of(kind, whole)))


def words(name: Column) -> Column:
    """The words of a titled name without the title."""
    return F.slice(F.split(name, " "), 2, 9)


def gender(name: Column) -> Column:
    return F.when(F.regexp_replace(F.substring_index(name, " ", 1), r"\.", "").isin(*MALE), "m").otherwise("f")


def feminine(name: Column) -> Column:
    """Whether a family name has the ending that women's have beside men's."""
    return (gender(name) == "f") & F.element_at(words(name), -1).rlike("(?:ов|ев|ин)а$")


def family_stem(name: Column) -> Column:
    last = F.element_at(words(name), -1)
    return F.when(feminine(name), F.regexp_replace(last, "а$", "")).otherwise(last)


def number(h: Column, i: Column, below: int) -> Column:
    """A number below a bound from two places of a hash in hexadecimal."""
    return F.conv(F.substring(h, (i * 4) % 60 + 1, F.lit(4)), 16, 10).cast("int") % below


def alike(text: Column, h: Column) -> Column:
    """Letters for letters of the same case and script, digits for digits, the rest as it is."""
    sets = (("^[a-z]$", "abcdefghijklmnopqrstuvwxyz"), ("^[A-Z]$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("^[0-9]$", "0123456789"), ("^[а-яё]$", "абвгдежзиклмнопрстуфхцчшщэюя"), ("^[А-ЯЁ]$", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ"), (r"^[\p{Ll}&&\p{IsGreek}]$", "αβγδεζηθικλμνξοπρστυφχψω"), (r"^[\p{Lu}&&\p{IsGreek}]$", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"), (r"^\p{Ll}$", "abcdefghijklmnopqrstuvwxyz"), (r"^\p{Lu}$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))

    def one(c: Column, i: Column) -> Column:
        own = F.sha2(F.concat_ws("|", h, (F.floor(i / 15)).cast("string")), 256)
        out = c
        for pattern, letters in reversed(sets):
            out = F.when(c.rlike(pattern), F.substring(F.lit(letters), number(own, i % 15, len(letters)) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


def luhn(digits: Column) -> Column:
    """The check sum of a number, 0 if valid, by the rule of card numbers."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10


def made_name(script: str, endings, h: Column, attempt: int, seed: str) -> Column:
    """A name of syllables, two of them and more from ``GROWS`` on."""
    part = lambda of, i: F.get(F.array(*map(F.lit, of)), number(F.sha2(F.concat_ws("|", h, F.lit(f"{seed}{i}")), 256), F.lit(1), len(of)))
    return F.initcap(F.concat(*[part(SYLLABLES[script], i) for i in range(2 + max(0, attempt + 1 - GROWS))], part(endings, "end")))


def with_surrogate(entities: DataFrame, key: str, attempt: int) -> DataFrame:
    """Adds to, the replacement of each entity (kind, entity) at one attempt. The hashes that it is derived from are
    columns first: within a lambda they would be computed anew for each character."""
    domain = F.substring_index("entity", "@", -1)
    hashes = {"__h": F.sha2(F.concat_ws("|", F.lit(key), F.col("kind"), F.col("entity"), F.lit(str(attempt))), 256), "__d": F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain), 256)}
    return entities.withColumns(hashes).withColumn("to", surrogate(F.col("kind"), F.col("entity"), F.col("__h"), F.col("__d"), attempt)).drop(*hashes)


def surrogate(kind: Column, entity: Column, h: Column, h_domain: Column, attempt: int) -> Column:
    """The replacement of an entity from its hash at one attempt and, of an address, that of its domain."""
    extra = max(0, attempt + 1 - GROWS)
    more = alike(F.lit("0" * extra), F.sha2(F.concat(h, F.lit("more")), 256))
    body = alike(F.substring(entity, 2, 1 << 20), h)
    card = F.concat(F.substring(entity, 1, 1), body)
    head = F.regexp_replace(card, ".$", "")
    valid = F.concat(head, ((10 - luhn(F.concat(head, F.lit("0")))) % 10).cast("string"))
    card = F.concat(F.when(luhn(entity) == 0, valid).otherwise(card), more)
    ip = F.concat_ws(".", *[(number(h, F.lit(i), 222 if i == 0 else 254) + 1).cast("string") for i in range(4)])
    ip = F.concat(F.lit("fd"), F.substring(h, 1, 2), *[F.concat(F.lit(":"), F.substring(h, 4 * i + 3, 4)) for i in range(7)]) if extra else ip
    at = F.substring_index(entity, "@", 1)
    domain = F.substring_index(entity, "@", -1)
    tld = F.substring_index(domain, ".", -1)
    email = F.concat(alike(at, h), more, F.lit("@"), alike(F.regexp_replace(domain, r"\.[^.]*$", ""), h_domain), F.lit("."), tld)
    # A nation's or an operator's digits at the front stay: they are part of the format.
    phone = F.concat(F.substring(entity, 1, 1), F.regexp_replace(body, "^0", "2"), more)
    iban = F.concat(F.substring(entity, 1, 2), alike(F.substring(entity, 3, 1 << 20), h), more)
    latin, cyrillic = entity.rlike(r"^[\p{IsLatin}-]+$"), entity.rlike(r"^[\p{IsCyrillic}-]+$")
    other = F.concat(alike(entity, h), alike(F.lit("a" * extra), h))
    by_script = lambda f: F.when(latin, f("latin")).when(cyrillic, f("cyrillic")).otherwise(other)
    family = by_script(lambda s: made_name(s, ENDINGS[s], h, attempt, "f"))
    listed = lambda s, g: F.get(F.array(*map(F.lit, GIVEN[s, g])), number(h, F.lit(1), len(GIVEN[s, g]))) if attempt < 4 else made_name(s, GIVEN_ENDINGS[s, g], h, attempt, "g")
    found = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone).when(kind == "iban", iban)
    return found.when(kind == "family", family).when(kind == "given m", by_script(lambda s: listed(s, "m"))).otherwise(by_script(lambda s: listed(s, "f")))


def spelled_as(surface: Column, kind: Column, to: Column) -> Column:
    """The replacements of a surface's entities (a map by kind) in the spelling that they stand for."""
    chars = lambda text: F.filter(F.split(text, ""), lambda c: c != "")
    one = F.element_at(F.map_values(to), 1)
    place = lambda i: F.length(F.regexp_replace(F.substring(surface, F.lit(1), i + 1), r"[^\pL\pN]", ""))
    filled = F.array_join(F.transform(chars(surface), lambda c, i: F.when(c.rlike(r"[\pL\pN]"), F.substring(one, place(i), F.lit(1))).otherwise(c)), "")
    # What a grown replacement has beyond the spelling's own letters and digits.
    filled = F.concat(filled, F.substring(one, F.length(F.regexp_replace(surface, r"[^\pL\pN]", "")) + 1, F.lit(1 << 20)))
    # Letters that are capitals in an address are capitals in its replacement, which has as many characters.
    # Both are cut into characters once: a lambda that took the i-th of a text would walk it anew for each.
    cased = F.array_join(F.zip_with(chars(one), chars(surface), lambda c, s: F.when(s.rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")
    last = F.concat(F.try_element_at(to, F.lit("family")), F.when(feminine(surface), "а").otherwise(""))
    given = F.coalesce(F.try_element_at(to, F.lit("given m")), F.try_element_at(to, F.lit("given f")))
    name = F.concat_ws(" ", F.substring_index(surface, " ", 1), given, last)
    return F.when(kind.isin("card", "phone", "iban"), filled).when(kind == "email", cased).when(kind == "name", name).otherwise(one)


def replacements(entities: DataFrame, key: str) -> DataFrame:
    """kind, entity and its replacement, distinct within its kind over the corpus and none of its entities."""
    todo, done, attempt = entities.select("kind", "entity"), None, 0
    originals = entities.select("kind", F.lower("entity").alias("low")).distinct()
    while True:
        # How an entity is replaced depends on it alone, so the smallest entity keeps a replacement that several get.
        tried = with_surrogate(todo, key, attempt).withColumn("low", F.lower("to"))
        free = tried.join(originals, ["kind", "low"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", F.lower("to").alias("low")), ["kind", "low"], "left_anti")
        first = materialize(free.groupBy("kind", "low").agg(F.min(F.struct("entity", "to")).alias("x")).select("kind", "x.entity", "x.to"))
        done = first if done is None else done.unionByName(first)
        todo = materialize(todo.join(first, ["kind", "entity"], "left_anti"))
        if todo.isEmpty():
            return done
        attempt += 1


def replace(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with every entity replaced, n_entities and the number of each kind."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    hinted = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    # Few texts hold any entity; the others pass without being dealt out. Equal rows share a key.
    found = rows.where(hinted).withColumn("found", F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).withColumn("key", F.xxhash64("doc_id", "text"))
    found = materialize(found)
    some = found.where(F.size("found") > 0)
    each = some.select("key", F.explode(F.array_distinct("found")).alias("surface")).distinct()
    surfaces = materialize(each.select("surface").distinct().withColumn("kind", kind_of(F.col("surface"))))
    parts = materialize(surfaces.select("surface", F.col("kind").alias("of"), F.explode(entities_of(F.col("kind"), F.col("surface"))).alias("x")).select("surface", "of", "x.*"))
    made = replacements(parts.select("kind", "entity").distinct(), key)
    by_kind = parts.join(made, ["kind", "entity"]).groupBy("surface", F.col("of").alias("kind")).agg(F.map_from_entries(F.collect_list(F.struct("kind", "to"))).alias("to"))
    table = materialize(by_kind.select("surface", "kind", spelled_as(F.col("surface"), F.col("kind"), F.col("to")).alias("to")))
    maps = each.join(table, "surface").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("surface", F.struct("to", "kind").alias("v")))).alias("map"))
    joined = some.join(maps, "key").withColumn("rest", F.split("text", ANY, -1))
    kinds = F.transform("found", lambda s: F.element_at("map", s)["kind"])
    text = F.array_join(F.transform("rest", lambda r, i: F.concat(r, F.coalesce(F.element_at("map", F.get("found", i))["to"], F.lit("")))), "")
    number_of = lambda kind: F.size(F.filter(kinds, lambda k: k == kind)).cast("long")
    counts = [number_of(kind).alias(f"n_{kind}") for kind in KINDS]
    changed = joined.select("doc_id", text.alias("text"), F.size("found").cast("long").alias("n_entities"), *counts)
    none = [F.lit(0).cast("long").alias(n) for n in ("n_entities", *(f"n_{k}" for k in KINDS))]
    return changed.unionByName(found.where(F.size("found") == 0).select("doc_id", "text", *none)).unionByName(rows.where(~hinted).select("doc_id", "text", *none))
