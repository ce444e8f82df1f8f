"""Personal data: detection by pattern and surrogates that look like what they replace. DataFrame functions only.

An entity (its letters and digits, in lower case) gets one surrogate in the whole table, so coreference survives whatever
separators or capitals it is written with; the surrogate is written in the form found. It is drawn from a keyed hash and
has the type's shape: card numbers keep issuer digit, length and check digit, addresses keep their parts, telephone
numbers their country code, names follow the gender of the title and the script they are written in. A collision check
over the table of distinct entities redraws until no two entities of a type share a surrogate and none is a real entity.

Only rows with entities are written out and joined; all others pass by.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import keep

#: Titles before names, by gender; the rest of the patterns are alternatives of one expression, in order of precedence.
MALE, FEMALE, ANY = r"Mr|Herr|Monsieur|Señor|Sr|Don|господин", r"Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Doña|госпожа", r"Dr|Prof"
#: A name is a run of capitalised words, one blank between two of them; initials and particles stand before a word. It ends before
#: another title. A lone initial is no name.
PARTICLE = r"(?:von|vom|van|der|den|de|del|della|di|da|das|do|dos|du|la|le|zu|zum|zur|ten|ter|af|av|bin|ibn|al|el|y)"
WORD = rf"(?:\p{{Lu}}\.[ -]?|\p{{Lu}} |{PARTICLE} )*+(?!(?:{MALE}|{FEMALE}|{ANY})(?!\p{{L}}))\p{{Lu}}[\p{{L}}'’-]++"
NAME = rf"{WORD}(?: {WORD})*+"
KINDS: tuple[tuple[str, str], ...] = (
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"),
    ("secret", r"(?<![\p{L}\p{N}])(?:AKIA[0-9A-Z]{16}|(?:ghp|gho|ghs)_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64}|[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![\p{L}\p{N}])"),
    ("iban", r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"),
    ("ip", r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}]|\.\d)"),
    ("phone", r"(?<![\p{L}\p{N}+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])\(\d{3}\) ?\d{3}[ .-]\d{4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\p{L}\p{N}])"),
    ("national", r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])"),
    ("card", r"(?<![\p{L}\p{N}])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|3\d{3}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\p{L}\p{N}])"),
    ("male", rf"(?<=\b(?:{MALE})\.? ){NAME}"), ("female", rf"(?<=\b(?:{FEMALE})\.? ){NAME}"), ("person", rf"(?<=\b(?:{ANY})\.? ){NAME}"),
)
#: A text without any of these has no entity; it is looked for first. Every alternative of KINDS contains one of them.
HINT = (rf"\d{{3}}|@|\.\d|\+\d|AKIA[0-9A-Z]{{16}}|gh[pos]_[0-9A-Za-z]{{36}}|sk-[0-9A-Za-z]{{20}}|[0-9a-fA-F]{{32}}|[A-Z]{{2}}\d{{2}} ?[A-Z0-9]{{4}}"
        rf"|(?:{MALE}|{FEMALE}|{ANY})\.? (?:\p{{Lu}}|{PARTICLE} )")
#: Issuer prefixes and lengths of payment cards.
ISSUERS = r"4(?:\d{12}|\d{15}|\d{18})|5[1-5]\d{14}|2[2-7]\d{14}|3[47]\d{13}|3(?:0[0-5]|[68]\d)\d{11}|35\d{14}|6(?:011|4[4-9]\d|5\d\d)\d{12}"
FIRST = {
    ("male", "latin"): "Adam Bruno Carl David Emil Felix Gustav Henry Ivan Jonas Karl Leo Martin Nils Oscar Paul Robert Simon Thomas Victor".split(),
    ("female", "latin"): "Anna Berta Clara Diana Emma Flora Greta Helena Irma Julia Karla Laura Maria Nora Olga Paula Rosa Sara Tina Vera".split(),
    ("person", "latin"): "Alex Andrea Charlie Dana Eli Jamie Jordan Kim Lou Morgan Nikita Noa Robin Sam Sascha Sidney Taylor Toni Val Yuki".split(),
    ("male", "cyrillic"): "Алексей Борис Виктор Георгий Дмитрий Егор Иван Кирилл Максим Николай Олег Павел Роман Сергей Тимур Фёдор".split(),
    ("female", "cyrillic"): "Алла Вера Галина Дарья Елена Жанна Зоя Инна Ксения Лидия Мария Нина Ольга Полина Раиса София".split(),
    ("person", "cyrillic"): "Женя Саша Валя Слава Шура Тоня".split(),
}
LAST = {
    "latin": "Abel Becker Castro Dorn Engel Fischer Garcia Haas Ibarra Jansen Keller Lopez Moreau Novak Olsen Perez Quint Rossi Sanchez Tanner Ulrich Vidal Weber Xavier Young Zeller".split(),
    "cyrillic": "Антоненко Бондаренко Власенко Гончаренко Демченко Ермоленко Захаренко Иваненко Клименко Левченко Марченко Назаренко Павленко Романенко".split(),
}
PEOPLE = ("male", "female", "person")


def pattern(kinds: Sequence[tuple[str, str]] = KINDS) -> str:
    return "|".join(f"(?:{p})" for _, p in kinds)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _check_sum(digits: Column, shift: int) -> Column:
    """Luhn sum of a digit string; shift 0 if its last digit is the check digit, 1 if that is still to come."""
    size = F.length(digits)
    values = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda k: (lambda d: F.when(F.pmod(size - k + shift, F.lit(2)) == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))(
        F.coalesce(F.substring(digits, k, F.lit(1)).try_cast("int"), F.lit(0))))
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def _kind(found: Column, before: Column) -> Column:
    """Type of a match by its own form; a name's gender is that of the title before it. Null: no entity after all."""
    digits = _digits(found)
    whole = {k: F.regexp_like(found, F.lit(f"^(?:{p})$")) for k, p in KINDS if k not in PEOPLE}
    title = lambda words: F.regexp_like(before, F.lit(rf"(?:^|\P{{L}})(?:{words})\.? $"))
    kind = F.when(title(MALE), "male").when(title(FEMALE), "female").when(title(ANY), "person")
    kind = F.when(whole["card"], F.when(F.regexp_like(digits, F.lit(f"^(?:{ISSUERS})$")) & (_check_sum(digits, 0) % 10 == 0), "card")).otherwise(kind)
    for name in ("national", "phone", "ip", "iban", "secret", "email"):
        kind = F.when(whole[name], name).otherwise(kind)
    return kind


def _canonical(kind: Column, found: Column) -> Column:
    lower = F.lower(found)
    return F.when(kind.isin("card", "national", "phone"), _digits(found)).when(kind == "iban", F.replace(lower, F.lit(" "), F.lit(""))).otherwise(lower)


def _script(text: Column) -> Column:
    return F.when(F.regexp_like(text, F.lit(r"\p{IsCyrillic}")), "cyrillic").otherwise("latin")


def _draw(key: str, salt: Column, place: Column, below: int) -> Column:
    """A number below `below` that depends on key, entity, attempt and place."""
    block = F.sha2(F.concat_ws("|", F.lit(key), salt, place.cast("string")), 256)
    return F.pmod(F.conv(F.substring(block, 1, 12), 16, 10).cast("long"), F.lit(below))


def surrogate(kind: Column, entity: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a canonical entity, itself canonical."""
    salt = F.concat_ws("|", kind, entity, attempt.cast("string"))
    size = F.length(entity)

    def letters(low: Column, high: Column, hexadecimal: Column) -> Column:
        """Characters low to high replaced by others of their class."""
        def one(k: Column) -> Column:
            c = F.substring(entity, k, F.lit(1))
            digit = F.substring(F.lit("0123456789"), (_draw(key, salt, k, 10) + 1).cast("int"), F.lit(1))
            letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (_draw(key, salt, k, 26) + 1).cast("int"), F.lit(1))
            hexa = F.substring(F.lit("abcdef"), (_draw(key, salt, k, 6) + 1).cast("int"), F.lit(1))
            return F.when((k < low) | (k > high), c).when(c.rlike("[0-9]"), digit).when(hexadecimal & c.rlike("[a-f]"), hexa).when(c.rlike(r"\p{L}"), letter).otherwise(c)

        return F.array_join(F.transform(F.sequence(F.lit(1), size), one), "")

    no, one = F.lit(False), F.lit(1)
    kept_end = size - F.length(F.regexp_extract(entity, r"\.[^.]*$", 0))
    body = letters(F.lit(2), size - 1, no)
    card_body = F.substring(body, one, size - 1)
    card = F.concat(card_body, F.pmod(10 - _check_sum(card_body, 1) % 10, F.lit(10)).cast("string"))
    octets = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: (_draw(key, salt, k, 254) + 1).cast("string")), ".")
    def pick(words: Sequence[str], place: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, words)), (_draw(key, salt, place, len(words)) + 1).cast("int"))

    def family(script: str) -> Column:
        """One family name; further ones are added when redraws are needed."""
        return F.array_join(F.transform(F.sequence(F.lit(10), 10 + F.floor(attempt / 4).cast("int")), lambda k: pick(LAST[script], k)), "-")

    names = []
    for (gender, script), first in FIRST.items():
        both = F.when(entity.contains(" "), F.concat_ws(" ", pick(first, F.lit(1)), family(script))).otherwise(family(script))
        names.append(F.when((kind == gender) & (_script(entity) == script), F.lower(both)))
    country = F.when(size > 10, size - 10).otherwise(F.lit(0))
    return (F.when(kind == "email", letters(one, kept_end, no)).when(kind == "secret", letters(F.when(entity.startswith("akia"), 5).when(entity.startswith("gh") | entity.startswith("sk-"), 5).otherwise(1), size, entity.rlike("^[0-9a-f]+$")))
            .when(kind == "iban", letters(F.lit(3), size, no)).when(kind == "ip", octets).when(kind == "phone", letters(country + 1, size, no)).when(kind == "national", letters(one, size, no))
            .when(kind == "card", card).otherwise(F.coalesce(*names)))


def _in_form(kind: Column, found: Column, made: Column) -> Column:
    """A canonical surrogate in the separators and capitals of the text it replaces."""
    lean = kind.isin("card", "national", "phone", "iban")
    mark = F.when(kind == "iban", F.lit("[A-Za-z0-9]")).otherwise(F.lit("[0-9]"))
    skip = F.when(kind == "iban", F.lit("[^A-Za-z0-9]")).otherwise(F.lit("[^0-9]"))
    spread = F.array_join(F.transform(F.sequence(F.lit(1), F.length(found)), lambda k: F.when(
        F.regexp_like(F.substring(found, k, F.lit(1)), mark), F.substring(made, F.length(F.regexp_replace(F.substring(found, F.lit(1), k), skip, F.lit(""))), F.lit(1))).otherwise(F.substring(found, k, F.lit(1)))), "")
    shaped = F.when(lean, spread).otherwise(made)
    capitals = (F.upper(found) == found) & (F.lower(found) != found)
    return F.when(capitals, F.upper(shaped)).when(kind.isin(*PEOPLE), F.initcap(F.replace(shaped, F.lit("-"), F.lit(" ")))).otherwise(shaped)


def surrogates(entities: DataFrame, key: str, most_rounds: int = 64) -> DataFrame:
    """(kind, entity, made) for distinct (kind, entity), redrawn until surrogates are distinct and no real entity."""
    table = keep(entities.select("kind", "entity", F.lit(0).alias("attempt"), surrogate(F.col("kind"), F.col("entity"), F.lit(0), key).alias("made")), "pii-surrogates")
    real = table.select(F.col("kind"), F.col("entity").alias("made"), F.lit(True).alias("real"))
    for _ in range(most_rounds):
        first = table.groupBy("kind", "made").agg(F.min("entity").alias("owner"), F.count("*").alias("n"))
        bad = (table.join(first.where(F.col("n") > 1), ["kind", "made"], "left").join(real, ["kind", "made"], "left")
               .withColumn("bad", F.coalesce(F.col("entity") != F.col("owner"), F.lit(False)) | F.col("real").isNotNull()))
        if bad.where("bad").isEmpty():
            return table.select("kind", "entity", "made")
        attempt = F.col("attempt") + F.col("bad").cast("int")
        table = keep(bad.select("kind", "entity", attempt.alias("attempt"), F.when(F.col("bad"), surrogate(F.col("kind"), F.col("entity"), attempt, key)).otherwise(F.col("made")).alias("made")), "pii-surrogates")
    raise RuntimeError("surrogates still collide; a type has too few of them for these entities")


def replace(docs: DataFrame, *, text_col: str = "text", key: str = "plumbline") -> DataFrame:
    """Replaces entities in every text; adds n_replaced and kinds (sorted types). All other columns stay as they are.

    Null and empty texts stay. Repeated rows get the same text. Columns n_replaced and kinds of the input are replaced.
    A number that fits no issuer or fails its check digit is no card and stays.
    """
    docs = docs.drop("n_replaced", "kinds")
    names, every = docs.columns, F.lit(pattern())
    text = F.col(text_col)
    matches = F.coalesce(F.when(F.regexp_like(text, F.lit(HINT)), F.regexp_extract_all(text, every, F.lit(0))), F.array().cast("array<string>"))
    hit = docs.select(F.struct(*names).alias("row"), text.alias("text"), matches.alias("matches")).where(F.size("matches") > 0)
    split = keep(hit.select(F.monotonically_increasing_id().alias("key"), "row", "matches", F.split("text", pattern(), -1).alias("pieces")), "pii-rows")
    found = split.select("key", F.posexplode("matches").alias("place", "found"), "pieces").select("key", "place", "found", F.substring(F.element_at("pieces", F.col("place") + 1), -12, 12).alias("before"))
    found = found.withColumn("kind", _kind(F.col("found"), F.col("before"))).where(F.col("kind").isNotNull()).withColumn("entity", _canonical(F.col("kind"), F.col("found")))
    found = keep(found.select("key", "place", "found", "kind", "entity"), "pii-found")
    table = surrogates(found.groupBy("kind", "entity").agg(F.count("*").alias("n")), key)
    made = (found.join(table, ["kind", "entity"]).select("key", "kind", "place", _in_form(F.col("kind"), F.col("found"), F.col("made")).alias("new"))
            .groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("place", "new"))).alias("new"), F.array_sort(F.collect_set("kind")).alias("kinds")))
    places = F.sequence(F.lit(0), F.size("matches") - 1)
    text_now = F.concat(F.array_join(F.transform(places, lambda k: F.concat(F.element_at("pieces", k + 1), F.coalesce(F.element_at(F.col("new"), k), F.element_at("matches", k + 1)))), ""), F.element_at("pieces", -1))
    changed = split.join(made, "key", "left").select(*[(F.coalesce(F.when(F.col("new").isNotNull(), text_now), F.col(f"row.`{c}`")) if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in names],
                                                     F.coalesce(F.size("new"), F.lit(0)).alias("n_replaced"), F.coalesce(F.array_join("kinds", ","), F.lit("")).alias("kinds"))
    same = docs.where(F.size(matches) == 0).select(*names, F.lit(0).alias("n_replaced"), F.lit("").alias("kinds"))
    return changed.unionByName(same)
