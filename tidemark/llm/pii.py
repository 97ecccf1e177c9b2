"""Personal data replaced by keyed surrogates, in DataFrame functions only.

Every detected entity gets a replacement of its own kind and format: digits for digits with the separators of the
mention, check digits (Luhn, IBAN) that hold where they held, the country of an IBAN, the first digit of a card,
addresses for addresses, names of the gender of the form of address or given name and of the script of the original. A
surrogate depends on the key, the kind and the normalised value alone, so all mentions of one entity, anywhere, get the
same one. A name is made of its parts: a given name (by gender) and a surname are entities of their own, so every mention
of a person keeps the surname that all other mentions have.

Digit kinds and IPv4 addresses go through a keyed permutation (a Feistel network over the two halves), which cannot
merge two values; others through a keyed digest. Collision checks run over the distinct entities of the whole corpus:
a surrogate that equals another entity, or that two entities share, is made again with the next attempt number until
none is left; the surrogates of names grow with the attempts, so that their space is never exhausted. Texts are
rewritten where they are scanned, without a shuffle; attempts above 0 (few) are joined to the texts that hold them, by a
hash of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import broadcast_if_small, checkpoint

# Forms of address by gender and language.
MALE_TITLES = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Господин", "Κύριος")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Госпожа", "Κυρία")
# Given names by script and gender.
GIVEN = {
    ("latin", "m"): ("Robert", "Daniel", "Martin", "Thomas", "Victor", "Simon", "Oscar", "Felix"),
    ("latin", "f"): ("Laura", "Helena", "Clara", "Julia", "Teresa", "Silvia", "Nora", "Irene"),
    ("cyrillic", "m"): ("Иван", "Павел", "Олег", "Борис", "Егор", "Антон", "Фёдор", "Глеб"),
    ("cyrillic", "f"): ("Анна", "Ольга", "Вера", "Нина", "Елена", "Дарья", "Ирина", "Зоя"),
    ("greek", "m"): ("Νίκος", "Πέτρος", "Ιάσων", "Μάρκος", "Λέων", "Άρης", "Σπύρος", "Φώτης"),
    ("greek", "f"): ("Άννα", "Ελένη", "Σοφία", "Ειρήνη", "Ζωή", "Δάφνη", "Μαρία", "Χλόη"),
}
# Syllables of surrogate surnames by script.
SYLLABLES = {
    "latin": ("ba", "de", "ki", "lo", "mu", "na", "re", "si", "to", "vu", "ga", "pe", "fi", "zo", "lu", "ma"),
    "cyrillic": ("ба", "де", "ки", "ло", "му", "на", "ре", "си", "то", "ву", "га", "пе", "фи", "зо", "лу", "ма"),
    "greek": ("βα", "δε", "κι", "λο", "μυ", "να", "ρε", "σι", "το", "φυ", "γα", "πε", "φι", "ζο", "λυ", "μα"),
}

# Forms of address without a gender; given names that tell a name without a form of address.
TITLES = ("Dr", "Prof", "Professor", "Доктор", "Профессор")
KNOWN_MALE = ("James", "John", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Daniel", "Matthew", "Peter", "Hans", "Klaus", "Jürgen", "Carlos", "José", "Juan", "Pierre", "Jean", "Иван", "Пётр", "Сергей")
KNOWN_FEMALE = ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Anna", "Emma", "Laura", "Maria", "María", "Sabine", "Petra", "Carmen", "Marie", "Sophie", "Ольга", "Мария", "Елена")
# Capitalised words that are no names.
NO_NAMES = ("The", "This", "That", "These", "Those", "And", "But", "Or", "For", "Not", "You", "He", "She", "It", "We", "They", "His", "Her", "In", "On", "At", "Of", "To", "From", "With", "Is", "Was", "Are", "Der", "Die", "Das", "Und", "Ein", "Eine", "El", "La", "Los", "Las", "Un", "Una", "Y", "Le", "Les", "Une", "Et", "Des", "Du")

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME = rf"(?!(?:{'|'.join(NO_NAMES)})(?![\p{{L}}'’-]))\p{{Lu}}[\p{{L}}'’-]+"
_GROUPS = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}"


def _either(words) -> str:
    return "(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")"


#: Kind, what may not stand before (a letter or digit never may), pattern, and what may not follow; in order of precedence.
PATTERNS = (
    ("email", r"(?<![._%+-])", r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+", ""),
    ("secret", "", r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|(?=[a-fA-F]*\d)(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}))", r"(?![\p{L}\p{N}])"),
    ("iban", "", r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", r"(?![\p{L}\p{N}])"),
    ("mac", "(?<!:)", r"(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}", r"(?![\p{L}\p{N}:])"),
    ("ipv6", "(?<!:)", rf"(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}|{_GROUPS}::(?:{_GROUPS})?|::{_GROUPS})", r"(?![\p{L}\p{N}:])"),
    ("ipv4", r"(?<!\.)", rf"{_OCTET}(?:\.{_OCTET}){{3}}", r"(?![\p{L}\p{N}]|\.\d)"),
    ("ssn", "(?<!-)", r"\d{3}-\d{2}-\d{4}", r"(?![\p{L}\p{N}]|-\d)"),
    ("card", r"(?<!\.)", r"(?:\d{13,19}|\d{4}(?: \d{4}){3}(?: \d{1,3})?|\d{4}(?:-\d{4}){3}(?:-\d{1,3})?|\d{4} \d{6} \d{4,5}|\d{4}-\d{6}-\d{4,5})", r"(?![\p{L}\p{N}]|\.\d)"),
    ("phone", r"(?<!\.)", r"(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]?\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4}|0\d{1,4}[ /-]\d{3,4}[ -]?\d{3,5})", r"(?![\p{L}\p{N}]|\.\d)"),
    ("name", "", rf"(?=\p{{Lu}})(?:{_either(MALE_TITLES + FEMALE_TITLES + TITLES)}\.? {_NAME}|{_either(KNOWN_MALE + KNOWN_FEMALE)} {_NAME})(?: {_NAME}){{0,2}}", ""),
)
ANY = r"(?<![\p{L}\p{N}])(?:" + "|".join(before + body + after for _, before, body, after in PATTERNS) + ")"
#: What every text with a mention has one of, each cheap to look for: a digit or @, the head of a key, the head of a name.
HINTS = (
    "[0-9@]", r"(?=[Agsx])(?:AKIA|gh[pousr]_|sk-|xox[abprs]-)",
    rf"(?=\p{{Lu}})(?<!\p{{L}}){_either(MALE_TITLES + FEMALE_TITLES + TITLES + KNOWN_MALE + KNOWN_FEMALE)}\.? \p{{Lu}}",
)
#: Digits of a card whose length and beginning an issuer uses.
ISSUED = r"^(?:4\d{12}(?:\d{3}){0,2}|5[1-5]\d{14}|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)\d{12}|3[47]\d{13}|3(?:0[0-5]|[689]\d)\d{11}|35\d{14}|6\d{15,18})$"
DIGIT_KINDS = ("card", "phone", "ssn")
ROUNDS = 8
#: Attempts before the check gives up; each attempt is made for colliding entities only.
MAX_ATTEMPTS = 64
#: Rows of a side that is broadcast.
BROADCAST_ROWS = 100_000


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kind_of(mention: Column) -> Column:
    """The kind of a mention; ``none`` for a plain run of digits whose beginning or check digit is no card's."""
    out = F.lit("name")
    for kind, _, body, _ in reversed(PATTERNS[:-1]):
        # the mention is a whole match, so its surroundings need no second look
        mine = F.lit(kind)
        if kind == "card":
            number = digits(mention)
            real = mention.rlike("[ -]") | (number.rlike(ISSUED) & (F.pmod(_luhn_sum(F.substr(number, F.lit(1), F.length(number) - 1)) + F.substr(number, F.length(number), F.lit(1)).cast("int"), F.lit(10)) == 0))
            mine = F.when(real, "card").otherwise("none")
        out = F.when(mention.rlike(f"^{body}$"), mine).otherwise(out)
    return out


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def normal_form(kind: Column, mention: Column) -> Column:
    """What mentions of one entity share."""
    calling = F.when(mention.rlike(r"^\+\d{1,3}[ .(-]"), F.regexp_extract(mention, r"^(\+\d{1,3})", 1)).otherwise(F.lit(""))
    rest = digits(F.substr(mention, F.length(calling) + 1))
    return (
        F.when(kind == "phone", F.concat(calling, F.lit("|"), rest))
        .when(kind.isin("card", "ssn"), F.concat(F.lit("|"), digits(mention)))
        .when(kind == "email", F.lower(mention))
        .when(kind == "iban", F.regexp_replace(mention, " ", ""))
        .otherwise(mention)
    )


def _number(key: str, *parts: Column) -> Column:
    """A keyed 48-bit number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 256), 1, 12), 16, 10).cast("long")


def _permuted_digits(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """A keyed permutation of the digit strings of one length; attempt n applies it n + 1 times."""
    n = F.length(value)
    u = F.floor(n / 2).cast("int")
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    start = F.struct(
        F.coalesce(F.substr(value, F.lit(1), u).try_cast("long"), F.lit(0).cast("long")).alias("l"),
        F.coalesce(F.substr(value, u + 1).try_cast("long"), F.lit(0).cast("long")).alias("r"),
    )

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        salt = (i % ROUNDS).cast("string")
        left = F.pmod(s["l"] + _number(key, kind, n.cast("string"), salt, s["r"].cast("string")), ten(u))
        right = F.pmod(s["r"] + _number(key, kind, n.cast("string"), salt, s["l"].cast("string")), ten(n - u))
        return F.struct(F.when(even, left).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(right).alias("r"))

    done = F.aggregate(F.sequence(F.lit(0), ROUNDS * (attempt + 1) - 1), start, turn)
    padded = lambda d: F.concat(
        F.when(u > 0, F.lpad(d["l"].cast("string"), u, F.lit("0"))).otherwise(F.lit("")), F.lpad(d["r"].cast("string"), n - u, F.lit("0")),
    )
    return let(done, padded)


def _luhn_sum(value: Column) -> Column:
    """Luhn sum of the digits before a check digit."""
    n = F.length(value)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(value, i, F.lit(1)).cast("int")
        d = F.when((n - i) % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
        return total + d

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _card(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """The first digit stays, the others but the last are permuted; the last keeps its distance from the right check digit."""
    head, last = F.substr(value, F.lit(1), F.lit(1)), F.substr(value, F.length(value), F.lit(1)).cast("int")
    old = F.substr(value, F.lit(1), F.length(value) - 1)
    checked = lambda new: F.concat(new, F.pmod(last + _luhn_sum(old) - _luhn_sum(new), F.lit(10)).cast("string"))
    return let(F.concat(head, _permuted_digits(key, kind, F.substr(old, F.lit(2)), attempt)), checked)


def _iban_check(country: Column, account: Column) -> Column:
    """The right check number, 2 to 98, of an IBAN."""
    line = F.concat(account, country, F.lit("00"))

    def add(rest: Column, i: Column) -> Column:
        c = F.substr(line, i, F.lit(1))
        number = F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
        return F.pmod(rest * F.when(number > 9, 100).otherwise(10) + number, F.lit(97))

    return F.lit(98) - F.aggregate(F.sequence(F.lit(1), F.length(line)), F.lit(0), add)


def _iban(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """Country kept, account masked; the check number keeps its distance from the right one."""
    country, check, account = F.substr(value, F.lit(1), F.lit(2)), F.substr(value, F.lit(3), F.lit(2)).cast("int"), F.substr(value, F.lit(5))

    def whole(new: Column) -> Column:
        moved = F.pmod(_iban_check(country, new) + check - _iban_check(country, account) - 2, F.lit(97)) + 2
        return F.concat(country, F.lpad(moved.cast("string"), 2, "0"), new)

    return let(_masked(key, kind, account, attempt), whole)


def _ipv4(key: str, value: Column, attempt: Column) -> Column:
    """A keyed permutation of the 32-bit addresses."""
    octet = F.transform(F.split(value, r"\."), lambda o: o.cast("int"))
    start = F.struct((octet[0] * 256 + octet[1]).alias("l"), (octet[2] * 256 + octet[3]).alias("r"))

    def turn(s: Column, i: Column) -> Column:
        mixed = F.pmod(_number(key, F.lit("ipv4"), (i % ROUNDS).cast("string"), s["r"].cast("string")), F.lit(65536)).cast("int")
        return F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(mixed).alias("r"))

    done = F.aggregate(F.sequence(F.lit(0), ROUNDS * (attempt + 1) - 1), start, turn)
    parts = lambda d: [F.shiftright(d["l"], 8), d["l"] % 256, F.shiftright(d["r"], 8), d["r"] % 256]
    return let(done, lambda d: F.concat_ws(".", *[p.cast("string") for p in parts(d)]))


def _masked(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """Character by character: digits to digits, letters to letters of their case (hexadecimal where all are); others stay."""
    keep = F.regexp_extract(value, r"^(AKIA|gh[pousr]_|sk-|xox[abprs]-)", 1)
    hexadecimal = value.rlike(r"^[0-9A-Fa-f:-]+$")
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, attempt.cast("string")), 512)

    def one(i: Column, bytes_: Column) -> Column:
        c = F.substr(value, i, F.lit(1))
        b = F.conv(F.substr(bytes_, (i - 1) % 63 * 2 + 1, F.lit(2)), 16, 10).cast("int")
        letters = F.when(hexadecimal, F.lit(6)).otherwise(F.lit(26))
        lower = F.char(97 + b % letters)
        return (
            F.when(i <= F.length(keep), c).when(c.rlike("[0-9]"), (b % 10).cast("string"))
            .when(c.rlike("[a-z]"), lower).when(c.rlike("[A-Z]"), F.upper(lower)).otherwise(c)
        )

    return let(digest, lambda bytes_: F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: one(i, bytes_)), ""))


def _email(key: str, value: Column, attempt: Column) -> Column:
    """A keyed mailbox at a keyed host (one host for all mailboxes of a host) under the same top-level domain."""
    host = F.substring_index(value, "@", -1)
    box = F.substr(F.translate(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("box"), value, attempt.cast("string")), 256), "0123456789", "ghijklmnop"), F.lit(1), F.lit(14))
    where = F.substr(F.translate(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("host"), host), 256), "0123456789", "ghijklmnop"), F.lit(1), F.lit(10))
    return F.concat(box, F.lit("@"), where, F.lit("."), F.substring_index(host, ".", -1))


def _by_script(word: Column, make) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), make("cyrillic")).when(word.rlike(r"\p{IsGreek}"), make("greek")).otherwise(make("latin"))


def _pick(options, seed: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(seed, F.lit(len(options))) + 1).cast("int"))


def _syllables(script: str, seed: Column, n: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: _pick(SYLLABLES[script], F.floor(seed / F.pow(F.lit(16.0), i)))), "")


def _family(key: str, value: Column, attempt: Column) -> Column:
    """Five syllables, and one more for every attempt up to five."""
    seed = _number(key, F.lit("family"), value, attempt.cast("string"))
    return let(seed, lambda x: _by_script(value, lambda s: F.initcap(_syllables(s, x, 5 + F.least(attempt, F.lit(5))))))


def _given(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """A given name of the gender, drawn out with syllables after the first attempt."""
    seed = _number(key, kind, value, attempt.cast("string"))

    def made(x: Column) -> Column:
        first = _by_script(value, lambda s: F.when(kind == "given-m", _pick(GIVEN[s, "m"], x)).otherwise(_pick(GIVEN[s, "f"], x)))
        more = _by_script(value, lambda s: F.initcap(_syllables(s, x, 1 + F.least(attempt, F.lit(8)))))
        return F.when(attempt > 0, F.concat(first, F.lit("-"), more)).otherwise(first)

    return let(seed, made)


def name_parts(mention: Column) -> Column:
    """(kind, normal) of the parts of a name after its form of address: given names, and the surname last."""
    words = F.split(mention, " ")
    head = F.regexp_replace(words[0], r"\.$", "")
    titled = head.isin(*MALE_TITLES, *FEMALE_TITLES, *TITLES)
    rest = F.when(titled, F.slice(words, F.lit(2), F.size(words))).otherwise(words)
    first = rest[0]
    male = F.when(head.isin(*MALE_TITLES), True).when(head.isin(*FEMALE_TITLES), False).when(first.isin(*KNOWN_MALE), True).when(first.isin(*KNOWN_FEMALE), False).otherwise(F.pmod(F.crc32(first), F.lit(2)) == 0)
    given = F.when(male, "given-m").otherwise("given-f")
    return F.transform(rest, lambda w, i: F.struct(F.when(i == F.size(rest) - 1, "family").otherwise(given).alias("kind"), w.alias("normal")))


def surrogate(key: str, kind: Column, normal: Column, attempt: Column) -> Column:
    """The surrogate's normal form."""
    calling, rest = F.substring_index(normal, "|", 1), F.substring_index(normal, "|", -1)
    return (
        F.when(kind == "card", F.concat(F.lit("|"), _card(key, kind, rest, attempt)))
        .when(kind.isin("phone", "ssn"), F.concat(calling, F.lit("|"), _permuted_digits(key, kind, rest, attempt)))
        .when(kind == "ipv4", _ipv4(key, normal, attempt))
        .when(kind == "email", _email(key, normal, attempt))
        .when(kind == "family", _family(key, normal, attempt))
        .when(kind.isin("given-m", "given-f"), _given(key, kind, normal, attempt))
        .when(kind == "iban", _iban(key, kind, normal, attempt))
        .otherwise(_masked(key, kind, normal, attempt))
    )


def render(kind: Column, mention: Column, made: Column) -> Column:
    """A surrogate in the format of a mention: its separators and its case."""
    calling, new = F.substring_index(made, "|", 1), F.substring_index(made, "|", -1)
    slots = F.when(kind == "iban", F.lit(r"[^ ]")).otherwise(F.lit(r"[0-9]"))
    body = F.when(kind == "phone", F.substr(mention, F.length(calling) + 1)).otherwise(mention)

    def one(i: Column) -> Column:
        c = F.substr(body, i, F.lit(1))
        filled = F.length(F.regexp_replace(F.substr(body, F.lit(1), i), F.when(kind == "iban", F.lit(" ")).otherwise(F.lit("[^0-9]")), F.lit("")))
        return F.when(F.regexp_like(c, slots), F.substr(new, filled, F.lit(1))).otherwise(c)

    spaced = F.array_join(F.transform(F.sequence(F.lit(1), F.length(body)), one), "")
    upper = (mention == F.upper(mention)) & (mention != F.lower(mention))
    return (
        F.when(kind == "phone", F.concat(calling, spaced)).when(kind.isin("card", "ssn", "iban"), spaced)
        .when((kind == "email") & upper, F.upper(made))
        .otherwise(made)
    )


def mentions(text: Column) -> Column:
    """All matches of the patterns in order; runs of digits that are no cards are among them. Null for most others."""
    hinted = text.rlike(HINTS[0]) | text.rlike(HINTS[1]) | text.rlike(HINTS[2])
    return F.when(hinted, F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))


def named(found: Column) -> Column:
    """Mentions to structs of mention, kind and parts: the (kind, normal) entities it is made of, in order.

    One step at a time, so that no step's work is repeated.
    """
    kinds = F.transform(found, lambda m: F.struct(m.alias("mention"), kind_of(m).alias("kind")))

    def parts(e: Column) -> Column:
        one = F.array(F.struct(e["kind"].alias("kind"), normal_form(e["kind"], e["mention"]).alias("normal")))
        return F.when(e["kind"] == "name", name_parts(e["mention"])).when(e["kind"] != "none", one).otherwise(F.slice(one, 1, 0))

    return F.transform(kinds, lambda e: F.struct(e["mention"].alias("mention"), e["kind"].alias("kind"), parts(e).alias("parts")))


def tags(text: Column) -> Column:
    """The distinct (kind, normal) entities of a text."""
    return F.array_distinct(F.flatten(F.transform(named(F.array_distinct(mentions(text))), lambda e: e["parts"])))


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The distinct entities of the corpus: kind, normal."""
    found = docs.select(F.explode(tags(F.col(f"`{text_col}`"))).alias("e"))
    return found.select("e.kind", "e.normal").distinct()


def later_attempts(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """kind, normal, attempt of the entities whose first surrogate collides; usually no rows."""
    known = checkpoint(entities(docs, text_col).withColumn("attempt", F.lit(0)))
    originals = known.select("kind", F.col("normal").alias("made"), F.lit(True).alias("taken"))
    state = known.withColumn("made", surrogate(key, F.col("kind"), F.col("normal"), F.col("attempt")))
    for _ in range(MAX_ATTEMPTS):
        rivals = W.partitionBy("kind", "made").orderBy("attempt", "normal")
        judged = state.withColumn("nth", F.row_number().over(rivals)).join(originals, ["kind", "made"], "left")
        judged = checkpoint(judged.select("kind", "normal", "attempt", "made", (F.col("taken").isNotNull() | (F.col("nth") > 1)).alias("bad")))
        if not judged.where("bad").count():
            return judged.where("attempt > 0").select("kind", "normal", "attempt")
        again = F.when(F.col("bad"), F.col("attempt") + 1).otherwise(F.col("attempt"))
        retried = judged.withColumn("attempt", again)
        state = retried.withColumn("made", F.when(F.col("bad"), surrogate(key, F.col("kind"), F.col("normal"), F.col("attempt"))).otherwise(F.col("made"))).drop("bad")
    raise RuntimeError("surrogates still collide; the space of a kind is exhausted")


def replace(docs: DataFrame, key: str, *, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its text rewritten, and the column ``n_entities``.

    Null text stays null with 0 entities; texts without entities stay as they are. Other columns are carried, whatever
    their names; an input column ``n_entities`` is replaced. Repeated rows and ids are rewritten alike; null ids are
    fine. An empty table gives an empty table. Equal keys give equal surrogates on every run.
    """
    attempts = checkpoint(later_attempts(docs, key, text_col))
    kept = [c for c in docs.columns if c.lower() != "n_entities"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    tag = lambda e: F.concat(e["kind"], F.lit("|"), e["normal"])
    if attempts.isEmpty():
        rows = rows.withColumn("again", F.lit(None).cast("map<string,int>"))
    else:
        # the attempts that a text needs depend on the text alone, so its hash finds them
        tagged = attempts.select(F.concat("kind", F.lit("|"), "normal").alias("tag"), "attempt")
        found = rows.select(F.xxhash64("text").alias("of"), F.explode(F.transform(tags(F.col("text")), tag)).alias("tag")).distinct()
        again = found.join(broadcast_if_small(tagged, BROADCAST_ROWS), "tag").groupBy("of").agg(F.map_from_entries(F.collect_list(F.struct("tag", "attempt"))).alias("again"))
        again = checkpoint(again)
        rows = rows.withColumn("of", F.xxhash64("text")).join(broadcast_if_small(again, BROADCAST_ROWS), "of", "left")
    split = rows.select("row", "again", "text", named(mentions(F.col("text"))).alias("found"))
    split = split.withColumn("between", F.when(F.size("found") > 0, F.split(F.col("text"), ANY, -1)))

    def made(part: Column) -> Column:
        attempt = F.coalesce(F.try_element_at(F.col("again"), tag(part)), F.lit(0))
        return let(attempt, lambda n: surrogate(key, part["kind"], part["normal"], n))

    def rendered(e: Column) -> Column:
        # a name keeps its form of address, which is what its parts leave over
        words = F.split(e["mention"], " ")
        title = F.array_join(F.slice(words, F.lit(1), F.size(words) - F.size(e["parts"])), " ")
        name = F.concat_ws(" ", F.nullif(title, F.lit("")), F.transform(e["parts"], made))
        return F.when(e["kind"] == "none", e["mention"]).when(e["kind"] == "name", name).otherwise(let(made(e["parts"][0]), lambda m: render(e["kind"], e["mention"], m)))

    pieces = F.transform(F.col("found"), lambda e, i: F.concat(rendered(e), F.get(F.col("between"), i + 1)))
    whole = F.concat(F.col("between")[0], F.array_join(pieces, ""))
    new = F.when(F.size("found") > 0, whole).otherwise(F.col("text"))
    counted = F.size(F.filter(F.col("found"), lambda e: e["kind"] != "none"))
    return split.select(
        *[(new if c == text_col else F.col("row").getField(c)).alias(c) for c in kept],
        F.greatest(F.coalesce(counted, F.lit(0)), F.lit(0)).alias("n_entities"),
    )
