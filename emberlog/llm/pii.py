"""PII: detection and surrogate generation, by DataFrame operations only.

Entities (e-mail addresses, telephone numbers, card numbers, IPv4 addresses, social security numbers, persons
with a title, a known given name or after words by which someone is named) are found by patterns.  Every mention is taken to whom or what it names, in all the
corpus: an address is one in any letter case, a card, telephone or security number in any layout (a ten-digit
telephone number without a country code is the one with +1), a person with or without title.  A family
name has one surrogate, with which full names are composed, so that 'Mr Peter Muller', 'Peter Muller' and 'Mr Muller'
stay as related as they were; which of several Mullers a bare 'Mr Muller' is, no text says and none is chosen.

Each of these gets one keyed surrogate of its type, given in the mention's format: numbers keep their punctuation and
length (cards keep a valid check digit, addresses the range 0-255, telephone numbers the country code), names keep title,
gender and script, words and addresses in capitals stay so.

Distinctness: surrogates are proposed from a keyed hash of (type, who, attempt).  A proposal that two of a
type share, or that is itself one of the corpus, is a collision; the one with the smallest hash
keeps a shared one, and the others propose anew (given names only collide within their family name).  It ends when none
is left; with ever longer proposals from the fourth attempt on, that is soon.  The mapping is a table, joined on the
entity; no part of it is collected or broadcast.

Only rows with an entity take part in the joins, keyed by a digest of the text, so copies are done once.

Defined results: null texts stay null, texts without entities stay as they are; the same key gives the same
surrogates for the same corpus; a repeated row gets equal results; rows without a doc_id and empty or very long texts are
done like others; an empty table gives no rows; a passed column named like the result's count gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

# Names known by gender and script, and the parts that surrogates of family names are composed of.
GIVEN = {
    ("latin", "f"): "Anna Clara Elena Emma Helen Ines Julia Laura Lucia Maria Marta Nina Olivia Paula Rosa Sara Sofia Teresa Vera Alice".split(),
    ("latin", "m"): "Adam Carlos David Daniel Emil Felix Hugo Ivan Jakob John Karl Luis Marco Martin Nils Oscar Pablo Peter Robert Thomas".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Дмитрий Иван Кирилл Михаил Николай Павел Сергей".split(),
}
TITLES = {"f": "Mrs Ms Frau Mme Sra".split(), "m": "Mr Herr Sr".split(), "": "Dr Prof".split()}
SYLLABLES = {"latin": "ba be bo da de do fa ga ka ke la le lo ma me mo na ne no ra re ro sa se so ta te to va vo".split(), "cyrillic": "ба бо ва во га го да до ка ко ла ло ма мо на но па по ра ро са со та то фа ха".split()}

#: Words after which someone is named; in any letter case.
CUES = "my name is|i am called|ich heiße|mein name ist|je m'appelle|mon nom est|me llamo|mi nombre es|меня зовут".split("|")

# A name goes over an apostrophe only before three letters, so a possessive or contracted ending is no part of it.
_PART = r"\p{Lu}(?:[\p{L}\p{M}]|['’](?=\p{L}{3}))+"
_NAME = rf"{_PART}(?:-{_PART})?"
_CYR = "[А-ЯЁ][А-ЯЁа-яё]+(?:-[А-ЯЁ][А-ЯЁа-яё]+)?"


def _person() -> str:
    titles = "|".join(t for ts in TITLES.values() for t in ts)
    latin = "|".join(n for (s, _), ns in GIVEN.items() if s == "latin" for n in ns)
    cyr = "|".join(n for (s, _), ns in GIVEN.items() if s == "cyrillic" for n in ns)
    before, after = r"(?<![\p{L}\p{M}\p{N}_])", r"(?![\p{L}\p{M}\p{N}_])"
    cues = "|".join(c.replace(" ", r"\x20") for c in CUES)
    cued = rf"(?<=(?:[^\p{{L}}]|^)(?iu:{cues})\x20){_NAME}(?:\x20{_NAME})?{after}"
    return rf"{before}(?:{cued}|(?:{titles})\.?\x20{_NAME}(?:\x20{_NAME})?{after}|(?:{latin})\x20{_NAME}{after}|(?:{cyr})\x20{_CYR})"


# Cards of other lengths than 16 only by the prefixes that have them, the longer ones first; so other long numbers stay.
_CARDS = (
    r"(?:5[06-8]|6[237])[0-9]{2}(?:[\x20-]?[0-9]{4}){3}[\x20-]?[0-9]{3}",  # 19 digits in groups
    r"62[0-9]{4}[\x20-][0-9]{13}",
    r"(?:4|5[06-8]|6)[0-9]{16,18}",
    r"4[0-9]{18}",
    r"(?:[0-9]{4}[\x20-]?){3}[0-9]{4}",
    r"3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}",
    r"3(?:0[0-5]|[689][0-9])[0-9][\x20-]?[0-9]{6}[\x20-]?[0-9]{4}",
    r"4[0-9]{3}(?:[\x20-]?[0-9]{3}){3}",
    r"(?:5018|5020|5038|5893|6304|6759|676[1-3])[0-9]{9,11}",
)
# International numbers in any grouping: as many digits as the country's plan has where that is fixed, else 7 to 11 that end in no single one.
_GAP = r"(?:[\x20.()/-]{0,2}(?:\(0\)\x20?)?)"
_PHONES = (
    rf"\+[17](?:{_GAP}[0-9]){{10}}(?![0-9])",
    rf"\+(?:3[34]|31|41|48|351)(?:{_GAP}[0-9]){{9}}(?![0-9])",
    rf"\+[2-9][0-9]{{1,2}}(?:{_GAP}[0-9]){{7,11}}(?<![\x20.()/-][0-9])(?![0-9])",
)


#: Types in the order in which a text is claimed; the first that matches at a place has it.
TYPES = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]*\.)+[A-Za-z]{2,}",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": rf"(?<![0-9])(?:{'|'.join(_CARDS)})(?![0-9])",
    "phone": rf"(?<![0-9+])(?:{'|'.join(_PHONES)})|" + r"(?<![0-9+])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{3})[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])|\+[0-9]{8,15}(?![0-9])",
    "person": _person(),
}
_CAPITAL = "(?=[A-ZА-Я])"
ANY = TYPES["email"] + "|(?=[0-9+(])(?:" + "|".join(f"(?:{TYPES[t]})" for t in ("ip", "ssn", "card", "phone")) + f")|{_CAPITAL}(?:{TYPES['person']})"
#: Any entity has one of these, so other texts are passed by at once; one look at a character settles most places.
HINT = rf"(?=[@+0-9A-ZА-Я])(?:@|\+[0-9]|[0-9]{{3}}|[0-9]\.[0-9]|{_CAPITAL}(?:{TYPES['person']}))"


_TITLE = rf"^(?:{'|'.join(t for ts in TITLES.values() for t in ts)})\.?\x20"
_CYRILLIC = "[А-Яа-яЁё]"
#: The zero that is dialled only within the country.
_TRUNK = r"\(0\)"
#: Country codes are a prefix code, so the digits alone tell them.
_COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def kind_of(entity: Column) -> Column:
    out = F.lit("person")
    for name in reversed([t for t in TYPES if t != "person"]):
        out = F.when(entity.rlike(f"^(?:{TYPES[name]})$"), F.lit(name)).otherwise(out)
    return out


def _digits(seed: Column, n: int) -> Column:
    """``n`` keyed decimal digits: of each hash eight, so that longer formats stay evenly spread."""
    parts = [F.lpad(F.pmod(F.xxhash64(seed, F.lit(k)), F.lit(100_000_000)).cast("string"), 8, "0") for k in range(-(-n // 8))]
    return F.concat(*parts)


def _like(entity: Column, digits: Column) -> Column:
    """The entity with its digits replaced in order, all else kept."""
    chars = F.split(entity, "")
    number = lambda i: F.length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), "[^0-9]", ""))
    return F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, number(i), F.lit(1))).otherwise(c)), "")


def _pick(values: list[str], seed: Column, salt: int) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.xxhash64(seed, F.lit(salt)), F.lit(len(values))) + 1).cast("int"))


def _invented(seed: Column, script: str, attempt: Column) -> Column:
    """A family name in small letters: three syllables, three more from each third attempt on."""
    known = F.array(*[F.lit(v) for v in SYLLABLES[script]])
    n = F.lit(3) + F.floor(attempt / 3).cast("int") * 3
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda k: F.element_at(known, (F.pmod(F.xxhash64(seed, F.lit(20) + k), F.size(known)) + 1).cast("int"))), "")


def _luhn(first: Column) -> Column:
    """Check digit after the digits given."""
    doubled = F.transform(F.split(F.reverse(first), ""), lambda c, i: F.when(i % 2 == 1, c.cast("int")).when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))
    return F.pmod(F.lit(10) - F.aggregate(doubled, F.lit(0), lambda x, d: x + d) % 10, F.lit(10)).cast("string")


def _valid_card(digits: Column) -> Column:
    return _luhn(F.substring(digits, F.lit(1), F.length(digits) - 1)) == F.right(digits, F.lit(1))


def _gender(title: Column, head: Column) -> tuple[Column, Column]:
    """What a title tells, and what a given name in small letters tells."""
    bare = F.rtrim(F.regexp_replace(title, r"\.", ""))
    known = {g: [n.lower() for (_, x), ns in GIVEN.items() if x == g for n in ns] for g in "fm"}
    return tuple(F.when(c.isin(f), F.lit("f")).when(c.isin(m), F.lit("m")) for c, f, m in ((bare, TITLES["f"], TITLES["m"]), (head, known["f"], known["m"])))


def canonical(entities: DataFrame) -> DataFrame:
    """kind and entity, and whom they name: ``type`` and ``who``; of persons also title, family and the genders told."""
    kind, entity = F.col("kind"), F.col("entity")
    digits = F.regexp_replace(entity, "[^0-9]", "")
    phone = F.when(entity.startswith("+"), F.concat(F.lit("+"), F.regexp_replace(F.regexp_replace(entity, _TRUNK, ""), "[^0-9]", ""))).when(digits.rlike("^[2-9][0-9]{9}$"), F.concat(F.lit("+1"), digits)).otherwise(digits)
    title = F.when(kind == "person", F.regexp_extract(entity, _TITLE, 0))
    name = F.translate(F.lower(F.substring(entity, F.length(title) + 1, F.length(entity))), "’", "'")
    by_title, by_given = _gender(title, F.substring_index(name, " ", 1))
    return entities.select(
        "kind", "entity", F.when((kind == "person") & ~name.contains(" "), F.lit("family")).otherwise(kind).alias("type"),
        F.when(kind == "person", name).when(kind == "email", F.lower(entity)).when(kind == "phone", phone).when(kind == "ip", entity).otherwise(digits).alias("who"),
        title.alias("title"), F.substring_index(name, " ", -1).alias("family"), by_title.alias("by_title"), by_given.alias("by_given"),
    )


def propose(kind: Column, who: Column, gender: Column, attempt: Column, key: str) -> Column:
    """The keyed proposal for a canonical entity, itself canonical; for a full name a given name before the family's own."""
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, who, attempt.cast("string")), 256)
    digits = _digits(seed, 24)
    prefix = F.when(F.length(who) == 16, "").otherwise(F.substring(who, 1, 4))  # other lengths are cards by their prefix
    free = F.length(who) - F.length(prefix)
    most = F.concat(prefix, F.substring(digits, F.lit(1), free - 1))
    card = F.when((kind == "card") & _valid_card(who), F.concat(most, _luhn(most))).otherwise(F.concat(prefix, F.substring(digits, F.lit(1), free)))
    octet = lambda k: F.pmod(F.xxhash64(seed, F.lit(50 + k)), F.lit(254)) + 1
    email = F.concat(_invented(seed, "latin", attempt), F.lit("."), F.substring(digits, 1, 4), F.lit("@"), F.concat(*[_pick(SYLLABLES["latin"], seed, 40 + k) for k in range(3)]), F.lit(".example"))
    area = F.regexp_extract(who, _COUNTRY, 0)
    first = F.substring(who, F.length(area) + 1, F.lit(1))
    first = F.when(first.isin("0", "1"), first).otherwise((F.pmod(F.xxhash64(seed, F.lit(70)), F.lit(8)) + 2).cast("string"))  # what tells a national number from others
    phone = F.concat(area, first, F.substring(digits, F.lit(2), F.length(who) - F.length(area) - 1))
    cyr = who.rlike(_CYRILLIC)
    gender = F.coalesce(gender, F.when(F.pmod(F.xxhash64(seed, F.lit(60)), F.lit(2)) == 0, F.lit("f")).otherwise(F.lit("m")))
    given = F.when(cyr & (gender == "f"), _pick(GIVEN["cyrillic", "f"], seed, 10)).when(cyr, _pick(GIVEN["cyrillic", "m"], seed, 11)).when(gender == "f", _pick(GIVEN["latin", "f"], seed, 12)).otherwise(_pick(GIVEN["latin", "m"], seed, 13))
    family = F.when(cyr, _invented(seed, "cyrillic", attempt)).otherwise(_invented(seed, "latin", attempt))
    given = F.lower(F.when(attempt < 3, given).otherwise(F.concat(given, F.lit("-"), family)))
    person = F.concat(given, F.lit(" "), F.substring_index(who, " ", -1))
    return F.when(kind == "email", email).when(kind == "ip", F.concat_ws(".", *[octet(k).cast("string") for k in range(4)])).when(kind == "card", card).when(kind == "phone", phone).when(kind == "ssn", F.substring(digits, 1, 9)).when(kind == "family", family).otherwise(person)


def _cased(like: Column, word: Column) -> Column:
    """A name's word with capitals as in the mention's: all or the first of each part."""
    return F.when((F.upper(like) == like) & (F.length(like) > 1), F.upper(word)).otherwise(F.array_join(F.transform(F.split(word, "-"), F.initcap), "-"))


def _rendered(given: Column, family: Column) -> Column:
    """A row of ``canonical`` with its surrogate, in the format of the mention."""
    kind, entity, title = F.col("kind"), F.col("entity"), F.col("title")
    number = F.regexp_replace("surrogate", "[^0-9]", "")
    shape = F.when(kind == "phone", F.regexp_replace(entity, _TRUNK, "(\x01)")).otherwise(entity)
    digits = F.right(number, F.length(F.regexp_replace(shape, "[^0-9]", "")))
    name = F.substring(entity, F.length(title) + 1, F.length(entity))
    ending = F.when(F.col("family").rlike("[ая]$") & (F.coalesce("by_title", "by_given") == "f"), F.concat(family, F.lit("ва"))).otherwise(family)
    person = F.concat(title, F.when(F.col("type") == "person", F.concat(_cased(F.substring_index(name, " ", 1), given), F.lit(" "))).otherwise(""), _cased(F.substring_index(name, " ", -1), ending))
    email = F.when(F.upper(entity) == entity, F.upper("surrogate")).otherwise(F.col("surrogate"))
    return F.when(kind == "person", person).when(kind == "email", email).when(kind == "ip", F.col("surrogate")).otherwise(F.regexp_replace(_like(shape, digits), r"\(\x01\)", "(0)"))


def _settle(ids: DataFrame, key: str, work: shared.Workspace) -> DataFrame:
    """ids(type, who, gender), distinct, to (type, who, surrogate), each surrogate once in its type and none of the corpus."""
    todo = ids.withColumn("attempt", F.lit(0))
    settled: DataFrame | None = None
    attempt = 0
    while True:
        # a proposal is far more work than its row's size tells, so the rows are spread over all tasks
        asked = work.keep(todo.repartition(shared.partitions(ids.sparkSession), "type", "who").withColumn("surrogate", propose(F.col("type"), F.col("who"), F.col("gender"), F.col("attempt"), key)))
        known = ids.select("type", F.col("who").alias("surrogate"))
        free = asked.join(known, ["type", "surrogate"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("type", "surrogate"), ["type", "surrogate"], "left_anti")
        first = Window.partitionBy("type", "surrogate").orderBy(F.xxhash64("who"), "who")
        won = work.keep(free.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("type", "who", "surrogate"))
        settled = won if settled is None else work.keep(settled.unionByName(won))
        attempt += 1
        todo = work.keep(asked.join(won, ["type", "who"], "left_anti").select("type", "who", "gender", F.lit(attempt).alias("attempt")))
        if todo.isEmpty():
            return settled


def surrogates(entities: DataFrame, key: str, work: shared.Workspace) -> DataFrame:
    """entities(kind, entity), distinct, to (kind, entity, surrogate); mentions of one canonical entity get the same in their formats."""
    named = work.keep(canonical(entities))
    told = F.when(F.min("by_title") == F.max("by_title"), F.min("by_title"))  # titles that contradict each other tell nothing
    ids = named.groupBy("type", "who").agg(F.coalesce(told, F.min("by_given")).alias("gender"))
    families = named.where("type = 'person'").select(F.lit("family").alias("type"), F.col("family").alias("who"), F.lit(None).cast("string").alias("gender"))
    settled = _settle(work.keep(ids.unionByName(families).groupBy("type", "who").agg(F.min("gender").alias("gender"))), key, work)
    found = work.keep(named.join(settled, ["type", "who"])).repartition(shared.partitions(entities.sparkSession), "kind", "entity")
    last = settled.where("type = 'family'").select(F.col("who").alias("family"), F.col("surrogate").alias("_last"))
    full = found.where("type = 'person'").join(last, "family").select("kind", "entity", _rendered(F.substring_index("surrogate", " ", 1), F.col("_last")).alias("surrogate"))
    other = found.where("type <> 'person'").select("kind", "entity", _rendered(F.col("surrogate"), F.col("surrogate")).alias("surrogate"))
    return work.keep(full.unionByName(other))


def replace_entities(docs: DataFrame, columns: list[str], key: str, name: str = "pii", count: str = "n_entities") -> DataFrame:
    """The named columns with text replaced, and the number of entities.

    ``key`` is the secret that surrogates depend on: without it nobody can tell them from the originals.
    """
    if not key:
        raise ValueError("surrogates need a key")
    work = shared.Workspace(docs.sparkSession, name)
    columns = shared.passed(columns, [count])
    own = [c for c in columns if c != "text"]
    rows = docs.select(docs["text"].alias("text"), *[docs[c].alias(f"c{i}") for i, c in enumerate(own)])
    text = F.col("text")
    hinted = F.coalesce(text.rlike(HINT), F.lit(False))
    found = F.when(hinted, F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    # one row of each distinct text with entities; the pieces between them stay with the rows
    texts = rows.select(F.sha2(text, 256).alias("text_key"), found.alias("e")).where(F.size("e") > 0).groupBy("text_key").agg(F.first("e").alias("e"))
    texts = work.keep(texts)
    mentions = texts.select("text_key", F.posexplode("e").alias("pos", "entity")).withColumn("kind", kind_of(F.col("entity")))
    mentions = work.keep(mentions)
    mapping = surrogates(work.keep(mentions.select("kind", "entity").distinct()), key, work)
    answers = mentions.join(mapping, ["kind", "entity"]).groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("pos", "surrogate"))).alias("a"))  # bounded by a text's length
    answers = answers.select("text_key", F.transform("a", lambda x: x["surrogate"]).alias("s"))
    keyed = rows.withColumn("text_key", F.when(F.size(found) > 0, F.sha2(text, 256)))
    joined = keyed.where(F.col("text_key").isNotNull()).join(answers, "text_key")
    between = F.split(text, ANY, -1)
    new = F.concat(F.array_join(F.flatten(F.zip_with(F.slice(between, 1, F.size("s")), F.col("s"), lambda a, b: F.array(a, b))), ""), F.element_at(between, -1))
    changed = joined.select(*[f"c{i}" for i in range(len(own))], new.alias("text"), F.size("s").cast("long").alias("_n"))
    same = keyed.where(F.col("text_key").isNull()).select(*[f"c{i}" for i in range(len(own))], "text", F.lit(0).cast("long").alias("_n"))
    out = changed.unionByName(same)
    return out.select(*[(F.col("text") if c == "text" else F.col(f"c{own.index(c)}")).alias(c) for c in columns], F.col("_n").alias(count))
