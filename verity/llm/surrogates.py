"""Personal data replaced by keyed surrogates (operator 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verity.llm.common import cut

#: Titles that tell the gender of the name after them, and names to draw from, by script and gender.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Sra", "Señora", "Madame", "г-жа"], "m": ["Mr", "Herr", "Sr", "Señor", "Monsieur", "г-н"], "n": ["Dr", "Prof"]}
#: Titles as they are, and in capitals; in small letters they may be other words.
SPELLED = {gender: [*titles, *(t.upper() for t in titles)] for gender, titles in TITLES.items()}
GIVEN = {
    ("latin", "f"): ["anna", "clara", "elena", "ines", "julia", "laura", "maria", "nora", "sofia", "vera"],
    ("latin", "m"): ["adam", "bruno", "david", "erik", "felix", "hugo", "leon", "martin", "oscar", "simon"],
    ("latin", "n"): ["alex", "andrea", "chris", "dominique", "jules", "kim", "luca", "robin", "sam", "toni"],
    ("cyrillic", "f"): ["анна", "вера", "елена", "ирина", "мария", "нина", "ольга", "софия", "тамара", "юлия"],
    ("cyrillic", "m"): ["антон", "борис", "виктор", "глеб", "иван", "максим", "николай", "олег", "павел", "юрий"],
    ("cyrillic", "n"): ["саша", "женя", "валя", "слава", "паша", "миша", "шура", "тоня", "лёня", "вася"],
    ("greek", "f"): ["άννα", "ελένη", "ειρήνη", "ζωή", "ιωάννα", "κατερίνα", "μαρία", "νίκη", "σοφία", "χριστίνα"],
    ("greek", "m"): ["αλέξης", "άρης", "γιάννης", "δημήτρης", "ηλίας", "κώστας", "μάριος", "νίκος", "πέτρος", "σπύρος"],
    ("greek", "n"): ["λίλη", "μίκυ", "νίνο", "ρένο", "τζο", "τόνι", "φώτη", "χάρι", "ντένι", "σάντι"],
}
SYLLABLES = {"latin": ["ba", "ce", "di", "fo", "gu", "ha", "ki", "lo", "me", "nu", "pa", "re", "si", "to", "va", "zu"], "cyrillic": ["ба", "ве", "ди", "го", "гу", "жа", "ки", "ло", "ме", "ну", "па", "ре", "си", "то", "ва", "зу"], "greek": ["βα", "γε", "δι", "ζο", "θα", "κι", "λο", "με", "νυ", "ξα", "πα", "ρε", "σι", "το", "φα", "χω"]}
#: Java patterns of the kinds, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9])",
    "ip6": r"(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "intl": r"\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])",
    "person": r"(?<!\p{L})(?:" + "|".join(t for ts in SPELLED.values() for t in ts) + r")\.? \p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+)?",
}
ANY = "|".join(PATTERNS.values())
DIGIT_KINDS = ["phone", "ssn", "card", "intl"]
#: Most rounds of drawing.
ROUNDS = 40


def kind_of(mention: Column) -> Column:
    """The first kind whose pattern is the whole mention."""
    out = None
    for kind, pattern in PATTERNS.items():
        test = F.rlike(mention, F.lit(f"^(?:{pattern})$"))
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out


def country_code(mention: Column) -> Column:
    """The digits of a phone number's country code; empty where it has none."""
    return F.regexp_extract(mention, r"^\+([0-9]{1,3})[ .-]?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}$", 1)


def check_digit(body: Column) -> Column:
    """The digit that makes a card number valid (from the right, every other digit counts twice)."""
    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    total = F.aggregate(F.transform(F.split(F.reverse(body), ""), value), F.lit(0), lambda a, x: a + x)
    return F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def normal(kind: Column, mention: Column) -> Column:
    """What mentions of one entity have in common: digits alone, letters in lower case, a name without its title but with its gender."""
    titled = F.regexp_extract(mention, r"^([\p{L}-]+)\.? (.*)$", 1)
    gender = F.when(titled.isin(SPELLED["f"]), "f").when(titled.isin(SPELLED["m"]), "m").otherwise("n")
    name = F.concat(gender, F.lit(":"), F.lower(F.regexp_extract(mention, r"^[\p{L}-]+\.? (.*)$", 1)))
    digits = F.regexp_replace(mention, "[^0-9]", "")
    national = F.substring(digits, F.length(country_code(mention)) + 1, F.length(digits))
    return F.when(kind == "phone", national).when(kind.isin(DIGIT_KINDS), digits).when(kind == "person", name).when(kind == "iban", F.replace(mention, F.lit(" "), F.lit(""))).otherwise(F.lower(mention))


def _draws(key: str, kind: Column, entity: Column, attempt: Column) -> Column:
    """256 hexadecimal digits that the key, the entity and the attempt decide."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, entity, attempt.cast("string"))
    return F.concat(*(F.sha2(F.concat(F.lit(f"{k}\x1f"), seed), 256) for k in range(4)))


def _number(draws: Column, at: Column | int, below: int) -> Column:
    """Four draws as a number below ``below``."""
    start = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substring(draws, start + F.lit(1), F.lit(4)), 16, 10).cast("int") % below


def surrogate(kind: Column, entity: Column, draws: Column, attempt: Column) -> Column:
    """The normal form of a replacement of the same type: digits for digits, letters for letters of the same script.

    E-mail domains end in the reserved ``example``; IP addresses are private ones (of version 6 unique local ones); social security numbers start
    with the unissued 9; cards keep the first digit, IBANs the country; names keep gender and script. Names are made in
    parts: a surname, and a given name for ``gender:given surname``, with that surname behind it.
    """
    pick = lambda text, at: F.substring(F.lit(text), _number(draws, at, len(text)) + 1, F.lit(1))
    place = lambda i: F.pmod(i * 3, F.lit(250))

    def letter(c: Column, i: Column) -> Column:
        at = place(i)
        return (
            F.when(F.rlike(c, F.lit("[0-9]")), pick("0123456789", at))
            .when(F.rlike(c, F.lit(r"\p{IsCyrillic}")), pick("абвгдежзиклмнопрстуфхцчшщэюя", at))
            .when(F.rlike(c, F.lit(r"\p{IsGreek}")), pick("αβγδεζηθικλμνξοπρστυφχψω", at))
            .when(F.rlike(c, F.lit(r"\p{Lu}")), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", at))
            .when(F.rlike(c, F.lit(r"\p{L}")), pick("abcdefghijklmnopqrstuvwxyz", at))
            .otherwise(c)
        )

    spell = lambda text: F.array_join(F.transform(F.split(text, ""), letter), "")
    local, domain = F.substring_index(entity, "@", 1), F.regexp_replace(F.substring_index(entity, "@", -1), r"\.[^.]*$", "")
    email = F.concat(spell(local), F.lit("@"), spell(domain), F.lit(".example"))
    # Private addresses first; those in the reserved upper range when many of them are taken.
    ip = F.concat_ws(".", F.when(attempt < 4, "10").otherwise((_number(draws, 16, 16) + 240).cast("string")), *(_number(draws, 4 * k, 256).cast("string") for k in range(3)))
    group = lambda i: F.lpad(F.lower(F.hex(_number(draws, F.pmod(i * 5, F.lit(250)), 1 << 16).cast("long"))), 4, "0")
    groups = F.transform(F.split(entity, ":"), lambda g, i: F.when(g == "", g).when(i == 0, F.concat(F.lit("fd"), F.substring(group(i), 3, 2))).otherwise(group(i)))
    ip6 = F.array_join(groups, ":")
    number = spell(entity)
    body = F.concat(F.substring(entity, 1, 1), F.substring(number, F.lit(2), F.length(entity) - 2))
    valid = F.substring(entity, -1, 1) == check_digit(F.substring(entity, F.lit(1), F.length(entity) - 1))
    card, ssn = F.concat(body, F.when(valid, check_digit(body)).otherwise(F.substring(number, -1, 1))), F.concat(F.lit("9"), F.substring(number, F.lit(2), F.length(entity)))
    iban = F.concat(F.substring(entity, 1, 2), F.substring(number, F.lit(3), F.length(entity)))
    last = F.substring_index(entity, " ", -1)
    script, gender = F.when(F.rlike(last, F.lit(r"\p{IsCyrillic}")), "cyrillic").when(F.rlike(last, F.lit(r"\p{IsGreek}")), "greek").otherwise("latin"), F.substring(entity, 1, 1)
    surname = F.when(script == "cyrillic", _syllables(draws, F.lit(3) + attempt, "cyrillic")).when(script == "greek", _syllables(draws, F.lit(3) + attempt, "greek")).otherwise(_syllables(draws, F.lit(3) + attempt, "latin"))
    given = None
    for (s, g), bank in GIVEN.items():
        one = F.concat(F.element_at(F.array(*map(F.lit, bank)), _number(draws, 0, len(bank)) + 1), _syllables(draws, attempt, s), F.lit(" "), F.substring_index(entity, " ", -1))
        given = F.when((script == s) & (gender == g), one) if given is None else given.when((script == s) & (gender == g), one)
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "ip6", ip6).when(kind == "card", card).when(kind == "ssn", ssn).when(kind == "iban", iban).when(kind == "surname", surname).when(kind == "given", given).otherwise(number)


def _syllables(draws: Column, n: Column, script: str) -> Column:
    """So many syllables, 43 at most: one more for each attempt, so that there are always more names to draw."""
    bank = F.array(*map(F.lit, SYLLABLES[script]))
    return F.array_join(F.transform(F.slice(F.sequence(F.lit(1), F.lit(43)), F.lit(1), F.least(n, F.lit(43))), lambda i: F.element_at(bank, _number(draws, i * 5, 16) + 1)), "")


def formatted(kind: Column, mention: Column, made: Column) -> Column:
    """The surrogate in the format of the mention: its separators, its title, its case and number of names."""
    chars = F.split(mention, "")
    nth = lambda i: F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), "[^0-9]", ""))
    code = F.when(kind == "phone", F.length(country_code(mention))).otherwise(0)
    digits = F.array_join(F.transform(chars, lambda c, i: F.when(F.rlike(c, F.lit("[0-9]")) & (nth(i) > code), F.substring(made, nth(i) - code, F.lit(1))).otherwise(c)), "")
    solid = lambda i: F.length(F.replace(F.substring(mention, F.lit(1), i + 1), F.lit(" "), F.lit("")))
    iban = F.array_join(F.transform(chars, lambda c, i: F.when(c == " ", c).otherwise(F.substring(made, solid(i), F.lit(1)))), "")
    title, name = F.regexp_extract(mention, r"^[\p{L}-]+\.? ", 0), F.initcap(F.substring_index(made, ":", -1))
    name = F.when(F.size(F.split(mention, " ")) > 2, name).otherwise(F.substring_index(name, " ", -1))
    upper = mention == F.upper(mention)
    name = F.when(upper, F.upper(name)).otherwise(name)
    email = F.when(upper, F.upper(made)).otherwise(made)
    return F.when(kind.isin(DIGIT_KINDS), digits).when(kind == "iban", iban).when(kind == "person", F.concat(title, name)).when(kind.isin("email", "ip6"), email).otherwise(made)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, made): a surrogate for each distinct entity, no two of a kind the same and none a real entity.

    A person's surname has one surrogate, whatever the title and with or without a given name, and distinct surnames
    have distinct ones, so what is printed of a one-name mention is distinct too. Given names are distinct among
    those of a surname. A title that tells no gender takes that of the one gender which the same name has elsewhere.
    """
    people = entities.where("kind = 'person'").select("entity", F.substring("entity", 1, 1).alias("_gender"), F.expr("substring(entity, 3)").alias("_name"))
    people = people.withColumn("_surname", F.substring_index("_name", " ", -1))
    full = people.where("_name <> _surname")
    told = full.where("_gender <> 'n'").groupBy("_name").agg(F.min("_gender").alias("_least"), F.max("_gender").alias("_most")).where("_least = _most").select("_name", "_least")
    full = full.join(told, "_name", "left").select("entity", F.concat(F.when(F.col("_gender") == "n", F.coalesce("_least", "_gender")).otherwise(F.col("_gender")), F.lit(":"), F.col("_name")).alias("_given"))
    people = cut(people.join(full, "entity", "left").select("entity", "_gender", "_surname", "_given"))
    parts = people.select(F.lit("surname").alias("kind"), F.col("_surname").alias("entity")).unionByName(people.where("_given IS NOT NULL").select(F.lit("given").alias("kind"), F.col("_given").alias("entity"))).distinct()
    others = entities.where("kind <> 'person'").select("kind", "entity")
    made = _distinct(others.unionByName(parts), key)
    surnames = made.where("kind = 'surname'").select(F.col("entity").alias("_surname"), F.col("made").alias("_last"))
    givens = made.where("kind = 'given'").select(F.col("entity").alias("_given"), F.concat(F.substring_index("made", " ", 1), F.lit(" ")).alias("_first"))
    named = people.join(surnames, "_surname").join(givens, "_given", "left")
    named = named.select(F.lit("person").alias("kind"), "entity", F.concat("_gender", F.lit(":"), F.coalesce("_first", F.lit("")), "_last").alias("made"))
    return made.where("kind NOT IN ('surname', 'given')").unionByName(named)


def _distinct(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, made) for entities that are replaced as they are.

    All entities draw; of those that drew one surrogate the least keeps it, and the others, and those that drew what
    is itself an entity, draw again. Each round is a window over equal surrogates and a join on them.
    """
    taken = entities.select("kind", F.col("entity").alias("made"))
    current = entities.withColumn("attempt", F.lit(0))
    for _ in range(ROUNDS):
        drawn = current.withColumn("made", surrogate(F.col("kind"), F.col("entity"), _draws(key, F.col("kind"), F.col("entity"), F.col("attempt")), F.col("attempt")))
        first = F.row_number().over(Window.partitionBy("kind", "made").orderBy("attempt", "entity")) == 1
        real = taken.withColumn("_real", F.lit(True))
        checked = cut(drawn.withColumn("_first", first).join(real, ["kind", "made"], "left").withColumn("_again", ~F.col("_first") | F.col("_real").isNotNull()).drop("_first", "_real"))
        if checked.where("_again").isEmpty():
            return checked.select("kind", "entity", "made")
        current = checked.select("kind", "entity", (F.col("attempt") + F.col("_again").cast("int")).alias("attempt"))
    raise ValueError(f"no distinct surrogates after {ROUNDS} rounds")


def pseudonymise(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Replace the personal data of every whole text: e-mail and IP addresses, phone, card, social security and
    account numbers, and names after a title, with other mentions of the same full name, and of the surname alone as it is spelled
    there, in the text without one.

    An entity has one surrogate in all documents and formats, distinct entities have distinct ones, and only the
    key and the entities of the corpus decide them. Texts without personal data are returned as they are and not
    shuffled. Returns id_col, text_col, n_entities (mentions) and kinds (distinct, sorted), a row for each row.

    Null text stays null and has none; repeated rows are changed alike; an empty table gives none; other columns
    are not read.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_has", F.coalesce(F.rlike("_text", F.lit(ANY)), F.lit(False)))
    plain = rows.where(~F.col("_has")).select("_id", "_text", F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<string>").alias("kinds"))
    some = cut(rows.where("_has").select("_id", "_text", F.md5(F.col("_text").cast("binary")).alias("_key"), F.regexp_extract_all("_text", F.lit(ANY), F.lit(0)).alias("_found")))
    mentions = some.select("_key", F.explode_outer(F.array_distinct("_found")).alias("mention")).where("mention IS NOT NULL").distinct()
    mentions = mentions.withColumn("kind", kind_of(F.col("mention"))).where("kind IS NOT NULL")
    mentions = cut(mentions.withColumn("entity", normal(F.col("kind"), F.col("mention"))))
    made = assign(cut(mentions.select("kind", "entity").distinct()), key)
    named = mentions.join(made, ["kind", "entity"]).select("_key", "kind", F.struct("mention", formatted(F.col("kind"), F.col("mention"), F.col("made")).alias("to")).alias("e"))
    maps = named.groupBy("_key").agg(F.map_from_entries(F.collect_list("e")).alias("_map"), F.sort_array(F.collect_set("kind")).alias("kinds"))
    changed = some.join(maps, "_key", "left")
    between = F.split("_text", ANY, -1)
    filled = F.zip_with(between, F.transform("_found", lambda m: F.coalesce(F.element_at("_map", m), m)), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    # A name that a title told is a person's without the title too, anywhere in the text: full names first, then surnames.
    people = F.coalesce(F.filter(F.map_entries("_map"), lambda e: F.rlike(e["key"], F.lit(f"^(?:{PATTERNS['person']})$"))), F.array().cast("array<struct<key:string,value:string>>"))
    bare = lambda m: F.regexp_extract(m, r"^[\p{L}-]+\.? (.*)$", 1)
    swap = lambda t, a, b: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}'’-])\Q"), a, F.lit(r"\E(?![\p{L}-])(?!['’](?!s(?!\p{L})))")), b)
    full = F.filter(people, lambda e: F.size(F.split(e["key"], " ")) > 2)
    surnames = F.array_distinct(F.transform(people, lambda e: F.struct(F.substring_index(e["key"], " ", -1).alias("a"), F.substring_index(e["value"], " ", -1).alias("b"))))
    whole = F.array_join(filled, "")
    told = F.aggregate(full, whole, lambda t, e: swap(t, bare(e["key"]), bare(e["value"])))
    told = F.when(F.size(people) > 0, F.aggregate(surnames, told, lambda t, e: swap(t, e["a"], e["b"]))).otherwise(whole)
    changed = changed.select("_id", told.alias("_text"), F.size("_found").cast("long").alias("n_entities"), F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))
    return plain.unionByName(changed).select(F.col("_id").alias(id_col), F.col("_text").alias(text_col), "n_entities", "kinds")
