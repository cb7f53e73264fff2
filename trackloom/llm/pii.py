"""PII surrogates in plain DataFrame operations: detected entities get keyed, type-consistent replacements.

One pattern finds e-mail addresses, phone numbers, card numbers (with a right check digit), IPv4 addresses, social
security numbers, bank account numbers, secrets and personal names (after a title, or a known given name before a
surname, also in capitals; then each further mention of a row's name tokens, in any case). An entity is its type and its canonical value (digits of a number, lower-case address, one name token), so
mentions in other notations or cases, or of the surname alone, share a surrogate. A surrogate comes from a keyed hash and keeps
type, script, gender, length and notation. Surrogates are checked over the whole corpus: one that equals another
entity's surrogate or a value that really occurs is drawn anew until all differ.

Edge cases: null and empty text stay as they are; repeated rows stay repeated; a text of any length is one expression;
rows without an entity never move; an empty table gives no rows; the input's columns may have any names but those
beginning with `_pii_`; n_chars, where there, is set to the new length of the changed rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import shared

#: the query's own key; other callers give theirs
QUERY_KEY = "op1"
MOST_ROUNDS = 64

# Our own choice: titles and given names by gender, and syllables of surnames by script.
MALE_TITLES = ["Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Sir", "господин"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "госпожа"]
OTHER_TITLES = ["Dr", "Prof", "Mx"]
MALE_NAMES = ["James", "Robert", "Michael", "David", "William", "Richard", "Thomas", "Charles", "Daniel", "Matthew", "Hans", "Jürgen", "Klaus", "Wolfgang", "Pierre", "François", "Jacques", "Étienne", "Carlos", "José", "Miguel", "Fernando", "Javier", "Jorge"]
FEMALE_NAMES = ["Mary", "Patricia", "Jennifer", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Margaret", "Emily", "Ursula", "Sabine", "Heike", "Ingrid", "Céline", "Amélie", "Juliette", "Geneviève", "Carmen", "Lucía", "Isabel", "Pilar", "Dolores", "Beatriz"]
CYRILLIC_MALE = ["Иван", "Пётр", "Сергей", "Николай", "Дмитрий", "Андрей"]
CYRILLIC_FEMALE = ["Анна", "Мария", "Ольга", "Елена", "Наталья", "Татьяна"]
LATIN_SYLLABLES = ["bar", "bel", "cor", "dal", "den", "fal", "gar", "hal", "jen", "kel", "lan", "mar", "mel", "nor", "pal", "quin", "ros", "sal", "tor", "val", "ver", "wen", "yor", "zan"]
CYRILLIC_SYLLABLES = ["бар", "вел", "гор", "дал", "жен", "зор", "кел", "лан", "мар", "нор", "пал", "рос", "сал", "тор", "фед", "хар"]

# Given names that are only found, never drawn.
MORE_MALE = "John Peter Paul George Joseph Christopher Andrew Anthony Steven Kenneth Kevin Brian Edward Ronald Timothy Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin Scott Brandon Benjamin Samuel Gregory Alexander Patrick Henry Philip Adam Simon Martin Oliver Harry Lukas Felix Stefan Andreas Markus Matthias Tobias Sebastian Florian Dieter Uwe Heinz Günter Helmut Manfred Ulrich Jean Michel Philippe Alain Bernard Laurent Nicolas Julien Olivier Antoine Luis Juan Antonio Francisco Manuel Pedro Pablo Rafael Sergio Alejandro Diego Andrés Marco Giovanni Luca Paolo Jan Pavel Tomáš Ahmed Mohammed Ali Omar".split()
MORE_FEMALE = "Anna Anne Maria Linda Karen Lisa Nancy Betty Sandra Ashley Kimberly Donna Emma Olivia Sophia Isabella Charlotte Amelia Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Laura Sharon Cynthia Kathleen Amy Angela Helen Alice Julia Lucy Catherine Katherine Christine Victoria Rachel Hannah Claudia Petra Monika Andrea Birgit Gabriele Renate Martina Katrin Julie Marie Sophie Isabelle Nathalie Sylvie Camille Chloé Claire Hélène Ana Teresa Rosa Marta Cristina Elena Paula Sofía Laura Francesca Giulia Fatima Aisha Eva Jana Nina".split()
MORE_CYRILLIC_MALE = "Алексей Александр Михаил Владимир Борис Павел Виктор Юрий Олег Игорь".split()
MORE_CYRILLIC_FEMALE = "Светлана Ирина Екатерина Людмила Юлия Галина Вера Нина Лариса Оксана".split()
#: Parts of names that are common words, so they are not looked for on their own.
PARTICLES = "de la le les van von der den dem del des da di du dos das al el il bin ibn st y e und and the".split()

_MALE, _FEMALE = MALE_NAMES + CYRILLIC_MALE + MORE_MALE + MORE_CYRILLIC_MALE, FEMALE_NAMES + CYRILLIC_FEMALE + MORE_FEMALE + MORE_CYRILLIC_FEMALE
_GIVEN = _MALE + _FEMALE
_TITLES = MALE_TITLES + FEMALE_TITLES + OTHER_TITLES
_NAME = r"(?:\p{Lu}['’](?=\p{Lu}\p{Ll}))?\p{Lu}\p{Ll}[\p{L}'’-]*+"
_UPPER = r"\p{Lu}(?:['’-]?\p{Lu})++(?!\p{L})"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+){1,8}"
SECRET_VALUE = r"(?=[A-Za-z+/_~-]*\d)[A-Za-z0-9+/_~-]{8,}+"
SECRET = rf"(?i:\b(?:api[_-]?key|access[_-]?key|auth[_-]?token|token|secret|password|passwd|pwd)\b[\"']?\s{{0,4}}[:=]\s{{0,4}}[\"']?){SECRET_VALUE}"
PREFIXED = r"\b(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,})"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
IPV4 = rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?!\d)"
PHONE = r"(?<![\w+])(?:\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,4}){2,4}(?!\d)|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-]))"
_upper = lambda names: "|".join(n.upper() for n in names)
PERSON = (
    rf"(?<!\p{{L}})(?=[\p{{Lu}}г])(?:(?:{'|'.join(_TITLES)})\.? {_NAME}(?: {_NAME}){{0,2}}|(?:{'|'.join(_GIVEN)}) {_NAME}(?: {_NAME})?"
    rf"|(?:{'|'.join([*_TITLES, _upper(_TITLES)])})\.? {_UPPER}(?: {_UPPER}){{0,2}}|(?:{_upper(_GIVEN)}) {_UPPER}(?: {_UPPER})?)"
)
PATTERN = "|".join([SECRET, PREFIXED, EMAIL, IPV4, PHONE, SSN, IBAN, CARD, PERSON])
MAYBE = rf"[0-9@]|(?<!\p{{L}})(?=[\p{{Lu}}г])(?:{'|'.join([*_TITLES, *_GIVEN, _upper(_TITLES + _GIVEN)])})(?!\p{{L}})"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def _fold(items: Column, start: str, step) -> Column:
    return F.aggregate(items, F.expr(start), step)


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits with every second one, from the right, doubled and cross-summed."""
    n = F.length(digits)
    at = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))

    def step(total: Column, i: Column) -> Column:
        d = F.coalesce(F.substr(digits, i, F.lit(1)).try_cast("int"), F.lit(0))
        twice = (n - i) % 2 == 1
        return total + F.when(twice, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return _fold(at, "0", step)


def kind_of(mention: Column) -> Column:
    """The type of a match of PATTERN; null if it isn't one after all (a number without a right check digit)."""
    whole = lambda p: mention.rlike(f"^(?:{p})$")
    card = F.when(luhn_sum(_digits(mention)) % 10 == 0, F.lit("card"))
    return (
        F.when(whole(EMAIL), F.lit("email")).when(whole(IPV4), F.lit("ipv4")).when(whole(SSN), F.lit("ssn"))
        .when(whole(r"[+(]?\d[\d ().-]*") & ~whole(CARD), F.lit("phone")).when(mention.rlike(r"^[+(]"), F.lit("phone")).when(whole(CARD), card)
        .when(whole(IBAN), F.lit("iban")).when(whole(PREFIXED) | whole(SECRET), F.lit("secret")).otherwise(F.lit("person"))
    )


def _is_in(word: Column, names: list[str]) -> Column:
    return F.lower(word).isin(*{n.lower() for n in names})


def _genitive(word: Column) -> Column:
    """What a name token ends with: an apostrophe, with or without an s, or a hyphen."""
    return F.regexp_extract(word, r"(?:['’][sS]?|-+)$", 0)


def _token(word: Column) -> Column:
    """A name token's canonical form: without the genitive, in title case."""
    return F.initcap(F.lower(F.left(word, F.length(word) - F.length(_genitive(word)))))


def _cased(made: Column, like: Column) -> Column:
    return F.when((F.upper(like) == like) & (F.length(like) > 1), F.upper(made)).when(F.lower(like) == like, F.lower(made)).otherwise(made)


def _gender(mention: Column) -> Column:
    first = F.regexp_replace(F.substring_index(mention, " ", 1), r"\.$", "")
    second = F.element_at(F.split(mention, " "), 2)
    return F.when(_is_in(first, MALE_TITLES + _MALE), "m").when(_is_in(first, FEMALE_TITLES + _FEMALE), "f").when(_is_in(second, _MALE), "m").when(_is_in(second, _FEMALE), "f").otherwise("u")


def _entity(kind: Column, value: Column, gender: Column | None = None) -> Column:
    return F.struct(kind.alias("kind"), value.alias("value"), (F.lit("u") if gender is None else gender).alias("gender"))


def _phone(digits: Column, mention: Column) -> Column:
    """A number's digits; those of a country whose national notation is read too (1 and ten digits) without the country's."""
    return F.when(mention.startswith("+1") & (F.length(digits) == 11), F.substr(digits, F.lit(2))).otherwise(digits)


def entities_of(kind: Column, mention: Column) -> Column:
    """The entities of a mention: one, or one for each token of a name (given names carry the gender as evidence)."""
    words = F.split(mention, " ")
    names = F.filter(words, lambda w: ~_is_in(F.regexp_replace(w, r"\.$", ""), _TITLES))
    count = F.size(names)
    person = F.transform(names, lambda w, i: _entity(F.when((i < count - 1) | _is_in(_token(w), _GIVEN), F.lit("given")).otherwise(F.lit("surname")), _token(w), _gender(mention)))
    value = (
        F.when(kind == "email", F.lower(mention)).when(kind == "phone", _phone(_digits(mention), mention)).when(kind.isin("ssn", "card"), _digits(mention)).when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .when(kind == "secret", F.regexp_extract(mention, r"([A-Za-z0-9+/_~-]+)$", 1)).otherwise(mention)
    )
    return F.when(kind == "person", person).when(kind.isNotNull(), F.array(_entity(kind, value))).otherwise(F.array().cast("array<struct<kind:string, value:string, gender:string>>"))


def distinct_entities(asked: DataFrame) -> DataFrame:
    """(kind, value, gender) of all entities; a given name's gender is that of most of its mentions with a known one, m where they tie, u without any."""
    count = lambda g: F.count_if(F.col("gender") == g)
    gender = F.when(count("f") > count("m"), "f").when(count("m") > 0, "m").otherwise("u")
    return asked.groupBy("kind", "value").agg(gender.alias("gender"))


def _stream(key: str) -> Column:
    """A hex stream keyed by type, value and attempt, four characters for each of the value's and more."""
    seed = F.concat_ws("\x1f", F.lit(key), "kind", "value", F.col("attempt").cast("string"))
    blocks = F.sequence(F.lit(0), (F.length("value") / 16).cast("int") + 2)
    return F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat(seed, F.lit("\x1f"), b.cast("string")).cast("binary"), 256)), "")


def _number(stream: Column, i: Column) -> Column:
    return F.conv(F.substr(stream, 4 * i + 1, F.lit(4)), 16, 10).cast("int")


def _pick(letters: str, n: Column) -> Column:
    return F.substr(F.lit(letters), n % len(letters) + 1, F.lit(1))


def _like(value: Column, stream: Column, kept: Column | None = None) -> Column:
    """Each character replaced by one of its script, case and kind; those up to `kept` and all others stay."""
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    scripts = [("[0-9]", "0123456789"), ("[a-z]", lower), ("[A-Z]", upper), ("[à-öø-ÿ]", "àâäçéèêëîïñóôöùûü"), ("[À-ÖØ-Þ]", "ÀÂÄÇÉÈÊËÎÏÑÓÔÖÙÛÜ"), ("[а-яё]", "абвгдежзиклмнопрстуфхцчшэюя"), ("[А-ЯЁ]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"), ("[α-ω]", "αβγδεζηθικλμνξοπρστυφχψω"), ("[Α-Ω]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")]

    def one(c: Column, i: Column) -> Column:
        out = c
        for pattern, letters in reversed(scripts):
            out = F.when(c.rlike(f"^{pattern}$"), _pick(letters, _number(stream, i))).otherwise(out)
        return out if kept is None else F.when(i < kept, c).otherwise(out)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _chosen(names: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), n % len(names) + 1)


def surrogate(key: str) -> Column:
    """The surrogate of an entity row (kind, value, gender, attempt), of the value's canonical form."""
    kind, value, stream = F.col("kind"), F.col("value"), _stream(key)
    number = lambda i: _number(stream, F.lit(i))
    local, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    labels = F.size(F.split(host, r"\."))
    front = F.when(labels > 2, F.concat(_like(F.substring_index(host, ".", 1), F.substr(stream, F.lit(33))), F.lit("."))).otherwise(F.lit(""))
    email = F.concat(_like(local, stream), F.lit("@"), front, F.lit("example."), _chosen(["com", "net", "org"], number(9)))
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_number(stream, i) % 254 + 1).cast("string")), ".")
    country = F.when(F.length(value) <= 10, 0).when(value.rlike("^[17]"), 1).otherwise(2)
    body = _like(F.expr("substr(value, 1, length(value) - 1)"), stream, F.lit(1))
    card = F.concat(body, ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    account = _like(F.substr(value, F.lit(5)), stream)
    country_code = F.substr(value, F.lit(1), F.lit(2))

    def remainder(text: Column) -> Column:
        """Modulo 97, letters as two digits from 10 on."""
        step = lambda r, c: F.when(c.rlike("^[0-9]$"), (r * 10 + c.try_cast("int")) % 97).when(c != "", (r * 100 + F.ascii(c) - 55) % 97).otherwise(r)
        return _fold(F.split(text, ""), "0", step)

    iban = F.concat(country_code, F.lpad((98 - remainder(F.concat(account, country_code, F.lit("00")))).cast("string"), 2, "0"), account)
    cyrillic = value.rlike(r"^\p{IsCyrillic}")
    extra = F.least("attempt", F.lit(8))

    def given(latin: list[str], other: list[str]) -> Column:
        parts = F.transform(F.sequence(F.lit(0), extra), lambda i: F.when(cyrillic, _chosen(other, _number(stream, i))).otherwise(_chosen(latin, _number(stream, i))))
        return F.array_join(parts, "-")

    def family(part: Column, i: Column) -> Column:
        """A family name's hyphenated part: O' and the like stay, syllables are as many as its length asks for."""
        size = F.least(F.greatest(F.round(F.length(part) / 3).cast("int"), F.lit(2)), F.lit(4)) + extra
        drawn = F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.when(cyrillic, _chosen(CYRILLIC_SYLLABLES, _number(stream, (13 * i + k) % 40))).otherwise(_chosen(LATIN_SYLLABLES, _number(stream, (13 * i + k) % 40))))
        return F.concat(F.regexp_extract(part, r"^(\p{L}['’])", 1), F.initcap(F.array_join(drawn, "")))

    surname = F.array_join(F.transform(F.split(value, "-"), family), "-")
    gender = F.col("gender")
    names = F.when(gender == "m", given(MALE_NAMES, CYRILLIC_MALE)).when(gender == "f", given(FEMALE_NAMES, CYRILLIC_FEMALE)).otherwise(given(MALE_NAMES + FEMALE_NAMES, CYRILLIC_MALE + CYRILLIC_FEMALE))
    return (
        F.when(kind == "email", email).when(kind == "ipv4", octets).when(kind == "phone", _like(value, stream, country)).when(kind == "card", card).when(kind == "iban", iban)
        .when(kind == "given", names).when(kind == "surname", surname).when(value.rlike("^[0-9a-f]+$") & value.rlike("[a-f]"), F.substr(stream, F.lit(1), F.length(value))).otherwise(_like(value, stream))
    )


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) of the distinct entities (kind, value, gender), no two of a kind alike and none a real value.

    Given names of all genders are one kind, so pools that overlap are checked together. Each round draws for the
    entities that are left and keeps those whose surrogate is free; earlier rounds, then smaller values, go first, so a
    result depends on the corpus and the key alone. Each round's finds are a table of their own.
    """
    left = entities.withColumn("attempt", F.lit(0))
    real = entities.select("kind", F.col("value").alias("surrogate"))
    found: DataFrame | None = None
    for _ in range(MOST_ROUNDS):
        dealt = left.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), "kind", "value")
        drawn = shared.staged(dealt.withColumn("surrogate", surrogate(key)), "drawn")
        used = real if found is None else real.union(found.select("kind", "surrogate"))
        foreign = drawn.where(~F.array_contains(F.split(F.lower("surrogate"), "-"), F.lower("value")))
        first = foreign.groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
        good = shared.staged(first.join(used.hint("merge"), ["kind", "surrogate"], "left_anti").select("kind", "value", "surrogate"), "taken")
        found = good if found is None else found.union(good)
        left = drawn.join(good.select("kind", "value").hint("merge"), ["kind", "value"], "left_anti").select("kind", "value", "gender", (F.col("attempt") + 1).alias("attempt"))
        left = shared.staged(left, "left")
        shared.released(drawn)
        if left.isEmpty():
            return found
    raise RuntimeError(f"no free surrogates after {MOST_ROUNDS} rounds")


def _in_notation(mention: Column, digits: Column) -> Column:
    """The mention with its digits replaced in order."""
    at = F.sequence(F.lit(1), F.length(mention))

    def one(i: Column) -> Column:
        c = F.substr(mention, i, F.lit(1))
        return F.when(c.rlike("^[0-9]$"), F.substr(digits, F.length(_digits(F.substr(mention, F.lit(1), i))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(at, one), "")


def _replaced(found: Column, table: Column) -> Column:
    """A mention {text, kind, entities} with its entities' surrogates from the row's map."""
    mention, kind = found["text"], found["kind"]
    of = lambda e: F.element_at(table, F.concat_ws("\x1f", e["kind"], e["value"]))
    only = of(found["entities"][0])
    value = found["entities"][0]["value"]
    names = found["entities"]
    titles = F.size(F.split(mention, " ")) - F.size(names)
    words = F.split(mention, " ")
    named = F.zip_with(F.slice(words, titles + 1, F.greatest(F.size(names), F.lit(0))), names, lambda w, e: F.concat(_cased(of(e), w), _genitive(w)))
    person = F.concat_ws(" ", F.slice(words, F.lit(1), titles), named)
    # a number that came with the country's digits keeps them
    digits = F.concat(F.left(_digits(mention), F.greatest(F.length(_digits(mention)) - F.length(only), F.lit(0))), only)
    spaced = F.when(mention.contains(" "), F.trim(F.regexp_replace(only, "(.{4})", "$1 "))).otherwise(only)
    return (
        F.when(kind.isNull(), mention).when(kind == "person", person).when(kind.isin("phone", "ssn", "card"), _in_notation(mention, digits))
        .when(kind == "iban", spaced).when(kind == "secret", F.concat(F.left(mention, F.length(mention) - F.length(value)), only))
        .when((kind == "email") & (mention == F.upper(mention)), F.upper(only)).otherwise(only)
    )


def _carried(piece: Column, names: Column, pattern: Column) -> Column:
    """{text, n}: a piece between mentions with the row's name tokens (lower-case k, surrogate v) replaced wherever they stand as words."""
    found = F.regexp_extract_all(piece, pattern, F.lit(0))
    made = F.transform(found, lambda w: _cased(F.get(F.filter(names, lambda n: n["k"] == F.lower(w)), F.lit(0))["v"], w))
    text = F.array_join(F.flatten(F.zip_with(F.split(piece, pattern, -1), made, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    return F.struct(text.alias("text"), F.size(found).alias("n"))


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """`docs` with surrogates in text; adds _pii_n, the number of mentions replaced."""
    maybe = F.coalesce(F.col("text").rlike(MAYBE) & F.col("text").rlike(PATTERN), F.lit(False))
    mentions = F.transform(F.regexp_extract_all("text", F.lit(PATTERN), 0), lambda m: F.struct(m.alias("text"), kind_of(m).alias("kind")))
    with_entities = F.transform("_pii_found", lambda m: F.struct(m["text"].alias("text"), m["kind"].alias("kind"), entities_of(m["kind"], m["text"]).alias("entities")))
    hits = docs.where(maybe).withColumn("_pii_found", mentions).withColumn("_pii_found", with_entities)
    hits = shared.staged(hits.withColumn("_pii_row", F.monotonically_increasing_id()), "hits")
    asked = hits.select("_pii_row", F.explode(F.array_distinct(F.flatten(F.col("_pii_found.entities")))).alias("e")).select("_pii_row", "e.*")
    asked = shared.staged(asked, "asked")
    known = surrogates(shared.staged(distinct_entities(asked), "entities"), key)
    entry = F.struct(F.concat_ws("\x1f", "kind", "value").alias("k"), F.col("surrogate").alias("v"))
    # a row's entities are parts of its own text, so its map is bounded by it
    tables = asked.select("_pii_row", "kind", "value").distinct().join(known.hint("merge"), ["kind", "value"]).groupBy("_pii_row").agg(F.map_from_entries(F.collect_list(entry)).alias("_pii_map"))
    met = hits.join(tables.hint("merge"), "_pii_row", "left")
    # further mentions of a row's names, in any case, also where neither title nor given name is beside them
    persons = F.filter(F.map_entries("_pii_map"), lambda e: e["key"].rlike("^(?:surname|given)\x1f"))
    names = F.transform(persons, lambda e: F.struct(F.lower(F.substring_index(e["key"], "\x1f", -1)).alias("k"), e["value"].alias("v"), (~e["key"].startswith("surname")).alias("given")))
    names = F.filter(names, lambda n: ~n["k"].isin(*PARTICLES) & (F.length(n["k"]) > 1))
    met = met.withColumn("_pii_names", F.coalesce(F.array_sort(names, lambda a, b: F.when(a["given"] == b["given"], 0).when(b["given"], -1).otherwise(1)), F.array().cast(
        "array<struct<k:string, v:string, given:boolean>>")))
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(F.transform("_pii_names", lambda n: n["k"]), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    met = met.withColumn("_pii_pattern", F.when(F.size("_pii_names") > 0, pattern).otherwise(F.lit("(?!)")))
    whole = F.transform(F.split("text", PATTERN, -1), lambda p: F.struct(p.alias("text"), F.lit(0).alias("n")))
    carried = F.transform(F.split("text", PATTERN, -1), lambda p: _carried(p, F.col("_pii_names"), F.col("_pii_pattern")))
    met = met.withColumn("_pii_between", F.when(F.size("_pii_names") > 0, carried).otherwise(whole))
    between = F.transform("_pii_between", lambda p: p["text"])
    given = F.transform("_pii_found", lambda m: _replaced(m, F.col("_pii_map")))
    met = met.withColumn("_pii_n", (F.size(F.filter("_pii_found", lambda m: m["kind"].isNotNull())) + F.aggregate("_pii_between", F.lit(0), lambda n, p: n + p["n"])).cast("long"))
    met = met.withColumn("text", F.array_join(F.flatten(F.zip_with(between, given, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), ""))
    if "n_chars" in docs.columns:
        met = met.withColumn("n_chars", F.when(F.col("_pii_n") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    clean = docs.where(~maybe).withColumn("_pii_n", F.lit(0).cast("long"))
    return clean.unionByName(met.select(*docs.columns, "_pii_n"))


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_pii(docs, QUERY_KEY).select("doc_id", "text", F.col("_pii_n").alias("n_replaced"))
