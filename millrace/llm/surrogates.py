"""Personal data: detected entities are replaced by keyed surrogates, in DataFrame expressions only.

An entity's surrogate is a function of the key, its kind and its own characters: a four-round Feistel
network over the characters' places in their alphabets. So the same entity has the same surrogate in
every document (coreference) without any shared table, and distinct entities of a kind and format have
distinct surrogates, as the network is a bijection (distinctness). Text is rewritten where it is; nothing
is shuffled or joined. Formats stay: separators, case, script and length, the country code and leading
digits of phone numbers, valid octets of IPv4 addresses, a card's first digit and its Luhn remainder, an
IBAN's country and check digits, the prefix of an access key, the alphabet of a hexadecimal secret, the
top-level domain (and reserved example domains) of e-mail addresses, titles, gendered endings of names.
Known given names change places within their own gender and script, frequent surnames among themselves; any
other word of a name keeps its vowels and consonants in place, accented ones too.

A person is found behind a title or by a known given name before a capitalised word. A name's words have one
surrogate each, wherever they stand and however they are cased; once a text has named a person, the same words
standing alone in it are replaced as well.

``collisions`` checks the promise over a corpus and lists what breaks it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 4
DIGITS = "0123456789"
LATIN = "abcdefghijklmnopqrstuvwxyz"
CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
HEX = "0123456789abcdef"
#: Letters of names change places within their row.
NAME_LETTERS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "áàâäãåéèêëíìîïóòôöõúùûü", "çñšžčćřśźń", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь")

#: Given names by script and gender, and titles by gender.
GIVEN = {
    ("latin", "male"): "James John Robert Michael William David Richard Thomas Hans Karl Stefan Jürgen Pierre Jean Michel Louis Carlos José Miguel Pedro".split(),
    ("latin", "female"): "Mary Linda Barbara Susan Jessica Sarah Karen Nancy Anna Greta Ingrid Ursula Marie Claire Camille Julie Carmen María Lucía Elena".split(),
    ("cyrillic", "male"): "Иван Пётр Сергей Алексей Дмитрий Николай Михаил Андрей Павел Виктор".split(),
    ("cyrillic", "female"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Людмила".split(),
}
MALE_TITLES = "Mr Herr Monsieur Señor Sr господин г-н".split()
FEMALE_TITLES = "Mrs Ms Miss Frau Madame Mme Señora Sra госпожа г-жа".split()
NEUTRAL_TITLES = "Dr Prof".split()
#: Frequent surnames, none of which is a given name above.
SURNAMES = ("Smith", "Johnson", "Williams", "Brown", "Jones", "Miller", "Davis", "Wilson", "Taylor", "Clark", "Schmidt", "Schneider", "Fischer", "Weber", "Meyer", "Wagner", "Becker", "Dubois", "Durand", "Moreau", "Garcia", "Lopez")
POOLS: dict[tuple[str, str], list[str]] = {**GIVEN, ("latin", "family"): list(SURNAMES)}

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLES = "|".join([*MALE_TITLES, *FEMALE_TITLES, *NEUTRAL_TITLES])
_GIVEN = "|".join(n for names in GIVEN.values() for n in names)
_TITLE = rf"^(?:(?:{_TITLES})\.?[ ])?"
_GROUP = "[0-9A-Fa-f]{1,4}"
SPACED_IBAN = r"[A-Z]{2}\d{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?"

#: Kind and pattern, tried in this order at each place of a text.
PATTERNS: dict[str, str] = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9])",
    "ipv4": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)",
    "ipv6": rf"(?<![A-Za-z0-9:.])(?=[0-9A-Fa-f:]*\d)(?:(?:{_GROUP}:){{7}}{_GROUP}|{_GROUP}(?::{_GROUP}){{0,5}}::(?:{_GROUP}(?::{_GROUP}){{0,5}})?)(?![A-Za-z0-9:])",
    "iban": rf"(?<![A-Za-z0-9])(?:[A-Z]{{2}}\d{{2}}[A-Z0-9]{{11,30}}|{SPACED_IBAN})(?![A-Za-z0-9])",
    "access_key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:token|password|passwd|secret|api_key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_+/.-]{8,}",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|[3-6]\d{12,18})(?![\d-])",
    "phone": r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[ .-]\d{4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}(?!\d)",
    "name": rf"(?<![\p{{L}}])(?:(?:{_TITLES})\.?[ ]\p{{Lu}}\p{{L}}+(?:[ -]\p{{Lu}}\p{{L}}+)?|(?:{_GIVEN})[ ]\p{{Lu}}\p{{L}}+)",
}


def _any(*kinds: str) -> str:
    return "|".join(f"(?:{PATTERNS[k]})" for k in kinds)


#: All kinds, behind cheap tests of where and with what a match can begin.
ANY = (
    rf"(?<![A-Za-z0-9._%+-])(?=[A-Za-z0-9])(?:{_any('email', 'ipv6', 'iban', 'access_key', 'secret')})"
    rf"|(?=[\d+(])(?:{_any('ipv4', 'ssn', 'card', 'phone')})"
    rf"|(?=[{''.join(sorted({t[0] for t in f'{_TITLES}|{_GIVEN}'.split('|')}))}])(?:{_any('name')})"
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _keystream(key: str, kind: Column, turn: Column, other: Column, sizes: Column, i: Column) -> Column:
    block = F.floor(i / 16)
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, turn, block, F.array_join(other, ","), F.array_join(sizes, ",")), 256)
    return F.conv(F.substr(digest, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def feistel(values: Column, sizes: Column, key: str, kind: Column) -> Column:
    """A keyed bijection of the arrays with 0 <= values[i] < sizes[i]."""
    half = F.floor(F.size(values) / 2).cast("int")
    rest = F.size(values) - half

    def turned(v: Column, b: Column, other: Column, turn: Column) -> Column:
        return F.transform(v, lambda x, i: ((x + _keystream(key, kind, turn, other, sizes, i)) % F.get(b, i)).cast("int"))

    def step(acc: Column, turn: Column) -> Column:
        left = F.when(turn % 2 == 1, turned(acc["l"], acc["bl"], acc["r"], turn)).otherwise(acc["l"])
        right = F.when(turn % 2 == 0, turned(acc["r"], acc["br"], acc["l"], turn)).otherwise(acc["r"])
        return F.struct(left.alias("l"), right.alias("r"), acc["bl"].alias("bl"), acc["br"].alias("br"))

    start = F.struct(F.slice(values, 1, half).alias("l"), F.slice(values, half + 1, rest).alias("r"), F.slice(sizes, 1, half).alias("bl"), F.slice(sizes, half + 1, rest).alias("br"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda acc: F.concat(acc["l"], acc["r"]))


def alphabet_of(kind: Column, c: Column, i: Column, cells: Column) -> Column:
    """Lower-case characters that the i-th character of a part may become; '' for one that stays."""
    low = F.lower(c)
    own = F.when(low.rlike("^[0-9]$"), F.lit(DIGITS)).when(low.rlike("^[a-z]$"), F.lit(LATIN)).when(low.rlike("^[а-я]$"), F.lit(CYRILLIC)).otherwise(F.lit(""))
    digit = (c >= "0") & (c <= "9")
    n = F.size(F.filter(cells, lambda x: (x >= "0") & (x <= "9")))
    # A phone number keeps what stands before its last ten digits; area and exchange begin with 2 to 9.
    rank = F.size(F.filter(F.slice(cells, 1, i + 1), lambda x: (x >= "0") & (x <= "9"))) - F.when(n >= 10, n - 10).otherwise(2)
    phone = F.when(~digit | (rank < 1), F.lit("")).when(rank.isin(1, 4) & (c >= "2") & (n >= 10), F.lit("23456789")).otherwise(F.lit(DIGITS))
    in_name = F.lit("")
    for letters in NAME_LETTERS:
        in_name = F.when(F.instr(F.lit(letters), low) > 0, F.lit(letters)).otherwise(in_name)
    return F.when(kind.isin("hex", "ipv6"), F.lit(HEX)).when(kind == "word", in_name).when(kind == "phone", phone).when((kind == "card") & (i == 0), F.lit("")).otherwise(own)


def permute(text: Column, kind: Column, key: str) -> Column:
    """``text`` with each character moved within its alphabet; case and all other characters are kept."""

    def celled(cs: Column) -> Column:
        def cell(c: Column, i: Column) -> Column:
            a = alphabet_of(kind, c, i, cs)
            return F.struct(c.alias("c"), F.when(F.instr(a, F.lower(c)) > 0, a).otherwise(F.lit("")).alias("a"))

        return F.transform(cs, cell)

    def moved(cells: Column) -> Column:
        def start(moving: Column) -> Column:
            values = F.transform(moving, lambda m: (F.instr(m["a"], F.lower(m["c"])) - 1).cast("int"))
            return feistel(values, F.transform(moving, lambda m: F.length(m["a"]).cast("int")), key, kind)

        def put(new: Column) -> Column:
            def add(acc: Column, x: Column) -> Column:
                letter = F.substr(x["a"], F.get(new, acc["i"]) + 1, F.lit(1))
                cased = F.when(F.lower(x["c"]) != x["c"], F.upper(letter)).otherwise(letter)
                stays = x["a"] == ""
                return F.struct(F.concat(acc["s"], F.when(stays, x["c"]).otherwise(cased)).alias("s"), (acc["i"] + F.when(stays, 0).otherwise(1)).alias("i"))

            return F.aggregate(cells, F.struct(F.lit("").alias("s"), F.lit(0).alias("i")), add, lambda acc: acc["s"])

        return let(let(F.filter(cells, lambda m: m["a"] != ""), start), put)

    return let(let(chars(text), celled), moved)


def luhn(text: Column) -> Column:
    """Luhn sum of the digits, modulo 10: 0 for a valid number."""
    digits = F.reverse(chars(F.regexp_replace(text, r"\D", "")))

    def worth(d: Column, i: Column) -> Column:
        twice = d.cast("int") * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d.cast("int"))

    return F.aggregate(F.transform(digits, worth), F.lit(0), lambda a, x: (a + x) % 10)


def _parts(*pairs: tuple[str | Column, Column | str]) -> Column:
    def lit(x: Column | str) -> Column:
        return F.lit(x) if isinstance(x, str) else x

    return F.array(*[F.struct(lit(kind).alias("kind"), lit(text).alias("text")) for kind, text in pairs])


def _email(text: Column) -> Column:
    domain = F.substring_index(text, "@", -1)
    reserved = r"((?:^|\.)(?i:example\.(?:com|net|org)))$"
    kept = F.regexp_extract(domain, r"((?:^|\.)(?i:example\.(?:com|net|org))|\.[A-Za-z]+)$", 1)
    kept = F.when(domain.rlike(reserved), F.regexp_extract(domain, reserved, 1)).otherwise(kept)
    labels = F.substr(domain, F.lit(1), F.length(domain) - F.length(kept))
    return _parts(("local", F.substring_index(text, "@", 1)), ("fixed", "@"), ("domain", labels), ("fixed", kept))


def _secret(text: Column) -> Column:
    rule = r"^(\w+\s*[=:]\s*[\"']?)(.*)$"
    value = F.regexp_extract(text, rule, 2)
    return _parts(("fixed", F.regexp_extract(text, rule, 1)), (F.when(value.rlike("^[0-9a-f]+$"), "hex").otherwise("secret"), value))


def _is_known(word: Column) -> Column:
    return F.find_in_set(F.initcap(word), F.lit(",".join(n for names in POOLS.values() for n in names))) > 0


def _name(text: Column) -> Column:
    """The title, then each word of the name by itself."""
    title = F.regexp_extract(text, _TITLE, 0)
    tokens = F.regexp_extract_all(F.substr(text, F.length(title) + 1), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.concat(_parts(("fixed", title)), F.transform(tokens, lambda t: F.struct(F.when(t.rlike(r"^\p{L}"), "word").otherwise("fixed").alias("kind"), t.alias("text"))))


def _shifted(name: Column, key: str) -> Column:
    """A known name moves within its list by an amount that the key gives; capitals stay."""
    found, proper = name, F.initcap(name)
    for (script, gender), names in POOLS.items():
        shift = F.pmod(F.xxhash64(F.lit(key), F.lit(script), F.lit(gender)), F.lit(len(names) - 1)) + 1
        pool = F.lit(",".join(names))
        at = F.find_in_set(proper, pool)
        moved = F.split_part(pool, F.lit(","), (F.pmod(at - 1 + shift, F.lit(len(names))) + 1).cast("int"))
        found = F.when(at > 0, moved).otherwise(found)
    return let(found, lambda new: F.when(F.upper(name) == name, F.upper(new)).when(F.lower(name) == name, F.lower(new)).otherwise(new))


def name_word(word: Column, key: str) -> Column:
    """The surrogate of a name's word. One that is no known name keeps the ending that marks gender, and is moved on
    while it lands on a known one, so none of those is hit twice."""

    def moved(w: Column) -> Column:
        ending = F.when(w.rlike("[а-яёА-ЯЁ]") & (F.length(w) > 4), 3).when(F.length(w) > 3, 1).otherwise(0)
        cut = F.length(w) - ending
        return F.concat(permute(F.substr(w, F.lit(1), cut), F.lit("word"), key), F.substr(w, cut + 1))

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(3)), word, lambda x, i: F.when((i == 1) | _is_known(x), moved(x)).otherwise(x))
    return F.when(_is_known(word), _shifted(word, key)).otherwise(walked)


def _with_luhn(text: Column, body: Column) -> Column:
    """The last digit that leaves the whole number's Luhn sum as it was."""
    last = F.substr(text, F.length(text), F.lit(1)).cast("int")
    return F.concat(body, F.pmod(last + luhn(text) - luhn(F.concat(body, last.cast("string"))), F.lit(10)).cast("string"))


def _with_iban_check(text: Column, body: Column) -> Column:
    country = F.substr(text, F.lit(1), F.lit(2))

    def add(acc: Column, c: Column) -> Column:
        v = F.instr(F.lit(DIGITS + LATIN), F.lower(c)) - 1
        return F.when(v > 9, (acc * 100 + v) % 97).otherwise((acc * 10 + v) % 97).cast("int")

    left = F.aggregate(chars(F.concat(body, country, F.lit("00"))), F.lit(0), add)
    return F.concat(country, F.lpad((98 - left).cast("string"), 2, "0"), body)


def _compact(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def _spaced_like(text: Column, made: Column) -> Column:
    return F.when(F.instr(text, " ") > 0, F.regexp_replace(made, "(.{4})(?=.)", "$1 ")).otherwise(made)


def kind_of(entity: Column) -> Column:
    """The first kind whose pattern is the whole entity."""
    found = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        found = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(found)
    return found


def surrogate(entity: Column, key: str) -> Column:
    """The replacement of an entity (of any text that ``kind_of`` knows; others stay)."""

    def of_part(part: Column) -> Column:
        other = F.when((part["kind"] == "fixed") | (part["text"] == ""), part["text"]).otherwise(permute(part["text"], part["kind"], key))
        return F.when(part["kind"] == "word", name_word(part["text"], key)).otherwise(other)

    def made(kind: Column) -> Column:
        parts = (
            F.when(kind == "email", _email(entity))
            .when(kind == "secret", _secret(entity))
            .when(kind == "name", _name(entity))
            .when(kind == "card", _parts(("card", F.substr(entity, F.lit(1), F.length(entity) - 1))))
            .when(kind == "iban", _parts(("iban", F.substr(_compact(entity), F.lit(5)))))
            .when(kind == "access_key", _parts(("fixed", "AKIA"), ("access_key", F.substr(entity, F.lit(5)))))
            .otherwise(_parts((kind, entity)))
        )

        def whole(text: Column) -> Column:
            return F.when(kind == "card", _with_luhn(entity, text)).when(kind == "iban", _spaced_like(entity, _with_iban_check(entity, text))).otherwise(text)

        octets = F.transform(F.split(entity, r"\."), lambda x: x.cast("int"))
        address = F.array_join(feistel(octets, F.array(*[F.lit(256)] * 4), key, F.lit("ipv4")), ".")
        return F.when(kind.isNull(), entity).when(kind == "ipv4", address).otherwise(let(F.array_join(F.transform(parts, of_part), ""), whole))

    return let(kind_of(entity), made)


def is_entity(match: Column) -> Column:
    """A number of a card's shape counts only with a valid Luhn sum, a spaced IBAN only with valid check digits; any
    other match counts."""
    iban = match.rlike(f"^{SPACED_IBAN}$")
    valid = _with_iban_check(match, F.substr(_compact(match), F.lit(5))) == _compact(match)
    return F.when(match.rlike(f"^(?:{PATTERNS['card']})$"), luhn(match) == 0).when(iban, valid).otherwise(True)


def entities(text: Column) -> Column:
    """All entities of a text in order; null has none."""
    return F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ANY), F.lit(0)), is_entity)


def named(found: Column) -> Column:
    """The lower-case words of all names among a text's matches."""
    names = F.filter(found, lambda e: e.rlike(f"^(?:{PATTERNS['name']})$"))
    words = F.transform(names, lambda e: F.regexp_extract_all(F.lower(F.regexp_replace(e, _TITLE, "")), F.lit(r"\p{L}{2,}"), F.lit(0)))
    return F.array_distinct(F.flatten(words))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with text rewritten and n_entities added; all other columns and every row as they were.

    Entities are all matches, and the capitalised words between them that are part of a name found in the same text.
    Null text stays null, with 0 entities. Empty texts, repeated rows and empty tables need no special case.
    A column n_entities of the input is replaced.
    """
    text, found, words = F.col("text"), F.col("__found"), F.col("__words")
    replaced = F.transform(found, lambda e: F.when(is_entity(e), surrogate(e, key)).otherwise(e))

    def tokens(gap: Column) -> Column:
        return F.regexp_extract_all(gap, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))

    def again(token: Column) -> Column:
        return token.rlike(r"^\p{Lu}") & F.array_contains(words, F.lower(token))

    def rewritten(gap: Column) -> Column:
        return F.array_join(F.transform(tokens(gap), lambda t: F.when(again(t), name_word(t, key)).otherwise(t)), "")

    gaps = F.split(text, ANY, -1)
    between = F.when(F.size(words) > 0, F.transform(gaps, rewritten)).otherwise(gaps)
    more = F.when(F.size(words) > 0, F.aggregate(gaps, F.lit(0), lambda n, gap: n + F.size(F.filter(tokens(gap), again)))).otherwise(0)
    woven = F.array_join(F.zip_with(between, replaced, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    count = F.coalesce(F.size(F.filter(found, is_entity)) + more, F.lit(0))
    once = docs.withColumn("__found", F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ANY), F.lit(0))).withColumn("__words", named(found))
    return once.withColumns({"text": F.when(F.size(found) > 0, woven).otherwise(text), "n_entities": count}).drop("__found", "__words")


def collisions(docs: DataFrame, key: str) -> DataFrame:
    """Entities that break the promise: kind, surrogate, the number of distinct entities that share it (over 1),
    and whether it is itself an entity of the corpus. Entities are distinct before anything is shuffled by surrogate.
    """
    found = docs.select(F.explode(entities(F.col("text"))).alias("entity")).distinct()
    made = found.select("entity", kind_of(F.col("entity")).alias("kind"), surrogate(F.col("entity"), key).alias("surrogate"))
    shared = made.groupBy("kind", "surrogate").agg(F.count("*").alias("n_entities"))
    real = found.select(F.col("entity").alias("surrogate"), F.lit(True).alias("is_real"))
    return shared.join(real, "surrogate", "left").select("kind", "surrogate", "n_entities", F.coalesce("is_real", F.lit(False)).alias("is_real")).where("n_entities > 1 or is_real")
