"""Surrogates for personal data, keyed, type-consistent and distinct.

Mentions are found by one pattern per type. Each mention has a canonical value (digits
of a number, lower case of an address, one part of a name), and a surrogate is a keyed
hash (HMAC) of type and value poured into the mention's own format: letters give
letters, digits digits, valid card and account numbers valid ones, a name a name of the
same script and, for given names, of the same gender. The same value gets the same
surrogate everywhere (coreference), and parts of a name that a text has told are
replaced wherever they stand in that text, with a title or without. The distinct values
of the corpus are checked: where two would get one surrogate, or a surrogate is itself a
value of the corpus, all but the first hash again, and grow longer after some rounds,
until none clash. Surrogates are recomputed in place from the text; only the few values
that hashed again, or whose gender the corpus decides, travel to their documents.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import let, materialize

#: Titles by the gender that they tell (fixed values).
TITLES = {
    "m": ("Mr", "Sir", "Herr", "Señor", "Sr", "Monsieur", "Господин", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Señorita", "Sra", "Madame", "Mme", "Mlle", "Госпожа", "Κυρία"),
    "n": ("Dr", "Prof"),
}
_ALL_TITLES = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_TITLE = rf"(?<![\p{{L}}\p{{N}}])(?:{_ALL_TITLES})\.?\x20"
#: Hyphens and apostrophes belong to a name between its letters; a possessive s does not.
_NAME = r"\p{Lu}(?:['’\-](?!s(?!\p{L}))(?=\p{L})|\p{L})++"
_INITIALS = r"(?:\p{Lu}\.\x20)*+"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_KEYWORD = r"(?i:api[_\-]?key|access[_\-]?key|secret|token|password|passwd|pwd)"
#: Eight characters or more up to a space or quote; punctuation belongs to it where more of it follows.
_SECRET = r"(?=[A-Za-z0-9+/_\-=~.!@#$%^&*]{8})(?:[A-Za-z0-9+/_\-=~]++|[.!@#$%^&*](?=[A-Za-z0-9+/_\-=~.!@#$%^&*]))++"

#: One pattern per type, tried in this order. Possessive groups have no bound and need no stack.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?=[A-Za-z0-9.\-]*?\.[A-Za-z]{2})[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "secret": rf"(?<![A-Za-z0-9]){_KEYWORD}[\"']?\x20{{0,3}}[:=]\x20{{0,3}}[\"']?{_SECRET}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![A-Za-z0-9])(?:[0-9]{13,19}|(?:[0-9]{4}\x20){3}[0-9]{4}|(?:[0-9]{4}-){3}[0-9]{4})(?![A-Za-z0-9])",
    "phone": (
        r"(?<![A-Za-z0-9+])(?:\+1[\x20.\-]?\(?[0-9]{3}\)?[\x20.\-]?[0-9]{3}[\x20.\-]?[0-9]{4}"
        r"|\+[2-9][0-9]{0,2}[\x20.\-]\(?[0-9]{1,4}\)?(?:[\x20.\-]?[0-9]{2,4}){2,4}"
        r"|\([0-9]{3}\)\x20[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?![0-9])"
    ),
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "name": rf"{_TITLE}{_INITIALS}{_NAME}(?:\x20{_INITIALS}{_NAME})*+",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every mention contains; texts without it are passed over quickly.
GUARD = rf"[0-9@]|(?:{_ALL_TITLES}|{_KEYWORD})"

#: Sounds of made-up names by script: consonants, vowels, endings by gender (fixed values).
SCRIPTS = {
    "latin": ("bdfgklmnprstvz", "aeiou", {"m": "an", "f": "ia", "n": "el"}),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", {"m": "ан", "f": "ия", "n": "ей"}),
    "greek": ("βγδζκλμνπρστφ", "αεηιο", {"m": "ος", "f": "ια", "n": "ης"}),
}
#: Attempts after which a value's surrogates grow by one sign with each attempt.
WIDEN = 16
#: Stands around mentions while a text is cut; a character that no text should have.
MARK = "\ufdd0"

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Setting that holds the secret key, and the key of sessions that have none: for trials only, as anyone can read it here.
KEY_SETTING, TRIAL_KEY = "spark.sparkloom.pii.key", "trial"


def session_key(spark: SparkSession) -> str:
    """The secret key of the session, from its configuration."""
    return spark.conf.get(KEY_SETTING, TRIAL_KEY)


def _chars(s: Column, body) -> Column:
    """``body(character, index)`` over the characters of a string, joined."""
    return F.array_join(F.transform(F.split(s, ""), body), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits, the last one undoubled."""
    back = F.reverse(digits)
    each = F.transform(F.sequence(F.lit(1), F.char_length(back)), lambda i: let(
        F.substr(back, i, F.lit(1)).cast("int"), lambda d: F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _mod97(account: Column) -> Column:
    """Remainder of an account number (letters count 10 to 35) by 97, its head moved to the end."""
    turned = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def kind_of(mention: Column) -> Column:
    """Type of a mention; null for a long number that is no valid card or account."""
    whole = reduce(lambda c, k: c.when(mention.rlike(f"^(?:{PATTERNS[k]})$"), F.lit(k)), list(PATTERNS)[1:], F.when(mention.rlike(f"^(?:{PATTERNS['email']})$"), F.lit("email")))

    def valid(kind: Column) -> Column:
        card = F.coalesce(kind == "card", F.lit(False)) & (_luhn(_digits(mention)) % 10 != 0)
        account = F.coalesce(kind == "iban", F.lit(False)) & (_mod97(F.replace(mention, F.lit(" "), F.lit(""))) != 1)
        return F.when(card | account, F.lit(None)).otherwise(kind)

    return let(whole, valid)


def _secret_prefix(mention: Column) -> Column:
    return F.regexp_extract(mention, rf"^({_KEYWORD}[\"']?\x20{{0,3}}[:=]\x20{{0,3}}[\"']?)", 1)


def _title(mention: Column) -> Column:
    return F.regexp_extract(mention, rf"^({_TITLE})", 1)


def _gender(mention: Column) -> Column:
    title = F.regexp_replace(_title(mention), r"[. ]", "")
    return F.when(title.isin(*TITLES["m"]), F.lit("m")).when(title.isin(*TITLES["f"]), F.lit("f")).otherwise(F.lit("n"))


_PARTS = "array<struct<kind:string,canon:string,gender:string,form:string>>"


def parts(mention: Column) -> Column:
    """The values of a mention: structs of kind, canonical value, gender and (names) form.

    A name has a value for each of its parts, given names before the surname, so that
    "Mr. Smith" and "Dr. John Smith" share the surrogate of the surname. Initials stay.
    """

    def one(kind: Column, value: Column) -> Column:
        return F.struct(kind.alias("kind"), value.alias("canon"), F.lit("").alias("gender"), F.lit("").alias("form"))

    def of(kind: Column) -> Column:
        names = let(F.split(F.substr(mention, F.char_length(_title(mention)) + 1), " "), lambda a: F.transform(a, lambda x, i: F.struct(
            F.when(x.endswith("."), F.lit("initial")).when(i == F.size(a) - 1, F.lit("surname")).otherwise(F.lit("given")).alias("kind"), F.lower(x).alias("canon"),
            F.when(i == F.size(a) - 1, F.lit("")).otherwise(_gender(mention)).alias("gender"), x.alias("form"))))
        canon = (
            F.when(kind == "email", F.lower(mention))
            .when(kind == "secret", F.substr(mention, F.char_length(_secret_prefix(mention)) + 1))
            .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
            .when(kind == "ip", mention)
            .otherwise(_digits(mention))
        )
        return F.when(kind.isNull(), F.array().cast(_PARTS)).when(kind == "name", names).otherwise(F.array(one(kind, canon)))

    return let(kind_of(mention), of)


def _mac(key: str, message: Column) -> Column:
    """HMAC-SHA256 as hex digits."""
    block = key.encode()
    block = (hashlib.sha256(block).digest() if len(block) > 64 else block).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def _stream(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """192 keyed hex digits."""
    mac = _mac(key, F.concat_ws("\x1f", kind, canon, attempt.cast("string")))
    return let(mac, lambda m: F.concat(m, F.sha2(F.concat(m, F.lit("1")), 256), F.sha2(F.concat(m, F.lit("2")), 256)))


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substr(stream, (2 * (i % 96) + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _pick(alphabet: str, stream: Column, i: Column) -> Column:
    return F.substr(F.lit(alphabet), (_byte(stream, i) % len(alphabet) + 1).cast("int"), F.lit(1))


def _masked(value: Column, stream: Column) -> Column:
    """Digits for digits and letters for letters; hexadecimal stays hexadecimal."""
    hexadecimal = value.rlike("^[0-9a-fA-F]+$")
    return _chars(value, lambda c, i: F.when(c.rlike("[0-9]"), _pick("0123456789", stream, i))
                  .when(c.rlike("[a-z]"), F.when(hexadecimal, _pick("abcdef", stream, i)).otherwise(_pick(_LETTERS, stream, i)))
                  .when(c.rlike("[A-Z]"), F.when(hexadecimal, _pick("ABCDEF", stream, i)).otherwise(_pick(_LETTERS.upper(), stream, i)))
                  .otherwise(c))


def _made_up(canon: Column, stream: Column, gender: Column, more: Column) -> Column:
    """A name in the script of ``canon``, with its gender's ending, hyphens and apostrophes.

    Four syllables and ``more``; a segment of one or two letters is a vowel.
    """

    def name(script: str) -> Column:
        consonants, vowels, endings = SCRIPTS[script]
        syllable = lambda i: F.concat(_pick(consonants, stream, 2 * i), _pick(vowels, stream, 2 * i + 1))
        ending = F.when(gender == "m", F.lit(endings["m"])).when(gender == "f", F.lit(endings["f"])).when(gender == "n", F.lit(endings["n"])).otherwise(_pick(consonants, stream, F.lit(95)))

        def segment(s: Column, k: Column, last: Column) -> Column:
            sounds = F.array_join(F.transform(F.sequence(F.lit(0), F.when(last, 3 + more).otherwise(F.lit(1))), lambda i: syllable(7 * k + i)), "")
            return F.when(last, F.concat(sounds, ending)).when(F.char_length(s) <= 2, _pick(vowels, stream, 7 * k + 50)).otherwise(sounds)

        return let(F.split(canon, "['’\\-]"), lambda a: F.array_join(F.zip_with(
            F.transform(a, lambda s, k: segment(s, k, k == F.size(a) - 1)), F.concat(F.regexp_extract_all(canon, F.lit("['’\\-]"), F.lit(0)), F.array(F.lit(""))),
            lambda x, y: F.concat(x, y)), ""))

    return F.when(canon.rlike(r"^\p{IsCyrillic}"), name("cyrillic")).when(canon.rlike(r"^\p{IsGreek}"), name("greek")).otherwise(name("latin"))


def surrogate(key: str, kind: Column, canon: Column, gender: Column, attempt: Column) -> Column:
    """Canonical surrogate of a canonical value; beyond ``WIDEN`` attempts it grows."""
    more = F.greatest(F.lit(0), attempt - WIDEN)

    def of(s: Column) -> Column:
        extra = lambda alphabet: F.when(more == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), more)), lambda i: _pick(alphabet, s, 40 + i)), ""))
        top = F.regexp_extract(canon, r"\.([a-z]+)$", 1)
        email = F.concat(_masked(F.substring_index(canon, "@", 1), s), extra(_LETTERS), F.lit("@"), *[_pick(_LETTERS, s, F.lit(88 + i)) for i in range(8)], F.lit(".example."), F.when(top.isin("com", "net", "org"), top).otherwise(F.lit("com")))
        octets = F.concat(F.concat_ws(".", *[(_byte(s, F.lit(i)) % 254 + 1).cast("string") for i in range(4)]), F.when(more > 0, F.concat(F.lit("-"), extra("0123456789"))).otherwise(F.lit("")))
        body = F.concat(F.substr(canon, F.lit(1), F.lit(1)), F.substr(_masked(canon, s), F.lit(2), F.char_length(canon) - 2), extra("0123456789"))
        card = let(body, lambda b: F.concat(b, ((10 - _luhn(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
        # The country code of a number and the country of an account stay.
        phone = F.concat(F.when(F.char_length(canon) > 10, F.substr(canon, F.lit(1), F.char_length(canon) - 10)).otherwise(F.lit("")), F.right(_masked(canon, s), F.least(F.lit(10), F.char_length(canon))), extra("0123456789"))
        bank = F.concat(F.substr(_masked(canon, s), F.lit(5)), extra("0123456789"))
        country = F.substr(canon, F.lit(1), F.lit(2))
        iban = let(bank, lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), b))).cast("string"), 2, "0"), b))
        return (
            F.when(kind == "email", email).when(kind == "ip", octets).when(kind == "card", card).when(kind == "phone", phone).when(kind == "initial", canon)
            .when(kind == "iban", iban).when(kind.isin("given", "surname"), _made_up(canon, s, gender, more))
            .when(kind == "ssn", F.concat(_masked(canon, s), extra("0123456789"))).otherwise(F.concat(_masked(canon, s), extra(_LETTERS)))
        )

    return let(_stream(key, kind, canon, attempt), of)


def _poured(template: Column, canon: Column, symbol: str) -> Column:
    """``template`` with the characters that match ``symbol`` replaced by those of ``canon`` in order, and what is left of it at the end."""
    count = lambda x: F.char_length(F.regexp_replace(x, f"(?!{symbol})[\\s\\S]", ""))
    filled = _chars(template, lambda c, i: F.when(c.rlike(symbol), F.substr(canon, count(F.substr(template, F.lit(1), i + 1)), F.lit(1))).otherwise(c))
    return F.concat(filled, F.substr(canon, count(template) + 1))


def _capitals(name: Column, like: Column) -> Column:
    """A made-up name with capitals at its start and after hyphens and apostrophes, or all through if ``like`` has them."""
    segments = F.split(name, "(?<=['’\\-])")
    written = F.array_join(F.transform(segments, lambda x: F.concat(F.upper(F.substr(x, F.lit(1), F.lit(1))), F.substr(x, F.lit(2)))), "")
    return F.when((like == F.upper(like)) & (F.char_length(like) > 1), F.upper(name)).otherwise(written)


def rendered(mention: Column, found: Column, names: Column) -> Column:
    """The mention with its values' surrogates ``names`` in its own format."""
    kind, first = found[0]["kind"], names[0]
    written = F.array_join(F.zip_with(names, found, lambda x, p: _capitals(x, p["form"])), " ")
    return (
        F.when(kind == "email", F.when(mention == F.upper(mention), F.upper(first)).otherwise(first))
        .when(kind == "secret", F.concat(_secret_prefix(mention), first))
        .when(kind.isin("given", "surname", "initial"), F.concat(_title(mention), written))
        .when(kind == "iban", _poured(mention, first, "[A-Z0-9]"))
        .when(kind == "ip", first)
        .otherwise(_poured(mention, first, "[0-9]"))
    )


def cut(text: Column, pattern: Column) -> Column:
    """The text in pieces: what stands between mentions at even places, mentions at odd ones.

    One pass of the pattern sets marks to cut at; texts that have the mark in them take two.
    """
    marked = F.split(F.regexp_replace(text, pattern, F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    by_two = F.flatten(F.zip_with(between, F.concat(found, F.array(F.lit(""))), lambda a, b: F.array(a, b)))
    return F.when(text.contains(MARK), by_two).otherwise(marked)


def cells(text: Column) -> Column:
    """Structs of a piece of the text (``x``) and its values (``p``; none between mentions), none for a null text."""
    plain = F.array(F.struct(text.alias("x"), F.array().cast(_PARTS).alias("p")))
    found = F.transform(cut(text, F.lit(ANY)), lambda x, i: F.struct(x.alias("x"), F.when((i % 2 == 1) & (x != ""), parts(x)).otherwise(F.array().cast(_PARTS)).alias("p")))
    return F.when(text.isNull(), F.array().cast(f"array<struct<x:string,p:{_PARTS}>>")).when(text.rlike(GUARD), found).otherwise(plain)


def _settled(values: DataFrame, key: str) -> DataFrame:
    """kind, canon, gender, attempt: every distinct value, with distinct surrogates.

    ``values`` has one row per kind and canonical value. Of values that clash, the
    smallest keeps the surrogate; one that the corpus itself contains is never used.
    Surrogates that grow leave room for all, so this ends.
    """
    current = values.withColumn("attempt", F.lit(0))
    while True:
        named = materialize(current.withColumn("name", surrogate(key, F.col("kind"), F.col("canon"), F.col("gender"), F.col("attempt"))), "pii-names")
        owners = named.groupBy("kind", "name").agg(F.min("canon").alias("owner"), F.count(F.lit(1)).alias("n"))
        real = named.select("kind", F.col("canon").alias("name"), F.lit(True).alias("real"))
        lost = materialize(
            owners.join(real, ["kind", "name"], "left").filter((F.col("n") > 1) | F.col("real")).withColumn("real", F.coalesce("real", F.lit(False))), "pii-clashes"
        )
        if lost.isEmpty():
            return named.drop("name")
        again = F.col("real").isNotNull() & (F.col("real") | (F.col("canon") != F.col("owner")))
        current = named.join(lost, ["kind", "name"], "left").withColumn("attempt", F.col("attempt") + again.cast("int")).select("kind", "canon", "gender", "attempt")


def replace(docs: DataFrame, key: str, text: str = "text", counted: str | None = None) -> DataFrame:
    """``docs`` with surrogates in the text, all rows and columns kept, whatever their names.

    ``n_chars``, if there is one, is updated. ``counted`` names an extra column for the
    number of mentions replaced (a name without a title is no mention of its own). Null
    and empty texts stay. Texts that are equal share their exceptions, which are looked
    up by the hash of the text and by value; ids play no part.
    """
    shared = F.xxhash64(F.col(text))
    told = F.filter(F.flatten(F.transform(cells(F.col(text)), lambda c: c["p"])), lambda p: p["kind"] != "initial")
    found = materialize(
        docs.filter(F.col(text).rlike(GUARD)).select(shared.alias("h"), F.explode(told).alias("p")).groupBy("h", "p.kind", "p.canon", "p.gender").agg(F.count(F.lit(1)).alias("n")),
        "pii-mentions",
    )
    by_gender = found.groupBy("kind", "canon", "gender").agg(F.sum("n").alias("n"))
    # The gender told most often; what tells none counts last.
    most = F.max_by("gender", F.struct((F.col("gender") != "n").cast("int"), F.col("n"), F.col("gender")))
    values = materialize(by_gender.groupBy("kind", "canon").agg(most.alias("gender"), F.count(F.lit(1)).alias("genders")), "pii-values")
    settled = _settled(values.select("kind", "canon", "gender"), key).join(values.select("kind", "canon", "genders"), ["kind", "canon"])
    special = materialize(settled.filter((F.col("attempt") > 0) | (F.col("genders") > 1)).select("kind", "canon", F.col("gender").alias("_g"), "attempt"), "pii-special")
    lookups = materialize(
        found.select("h", "kind", "canon").distinct().join(special, ["kind", "canon"])
        .groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "kind", "canon"), F.struct(F.col("_g").alias("gender"), "attempt")))).alias("special")),
        "pii-lookups",
    )
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col(text).alias("text"), shared.alias("h")).join(lookups, "h", "left")

    def name(p: Column) -> Column:
        known = F.col("special")[F.concat_ws(":", p["kind"], p["canon"])]
        return let(known, lambda k: surrogate(key, p["kind"], p["canon"], F.coalesce(k["gender"], p["gender"]), F.coalesce(k["attempt"], F.lit(0))))

    def between(x: Column, names: Column) -> Column:
        """Text between mentions, with the parts of names that the text has told."""
        pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(F.transform(names, lambda p: p["form"]), "|"), F.lit(r")(?![\p{L}\p{N}])"))
        again = lambda pattern: F.transform(cut(x, pattern), lambda y, i: F.when((i % 2 == 0) | (y == ""), y).otherwise(let(F.filter(names, lambda p: p["form"] == y)[0], lambda p: let(name(p), lambda new: _capitals(new, y)))))
        return F.when(F.size(names) == 0, x).otherwise(F.array_join(let(pattern, again), ""))

    def written(found: Column) -> Column:
        people = F.filter(F.flatten(F.transform(found, lambda c: c["p"])), lambda p: p["kind"].isin("given", "surname"))
        # As strings, as those have a hash. Long forms first: an alternative that is the start of another must not hide it.
        coded = F.array_distinct(F.transform(people, lambda p: F.concat_ws("\x1f", F.lpad(F.char_length(p["form"]).cast("string"), 9, "0"), p["form"], p["kind"], p["canon"], p["gender"])))
        field = lambda x: F.split(x, "\x1f", -1)
        names = F.transform(F.sort_array(coded, asc=False), lambda x: let(field(x), lambda f: F.struct(f[1].alias("form"), f[2].alias("kind"), f[3].alias("canon"), f[4].alias("gender"))))
        new = let(names, lambda n: F.array_join(F.transform(found, lambda c: F.when(F.size(c["p"]) == 0, between(c["x"], n)).otherwise(let(F.transform(c["p"], name), lambda new: rendered(c["x"], c["p"], new)))), ""))
        count = F.size(F.filter(found, lambda c: F.size(c["p"]) > 0))
        return F.when(count == 0, F.struct(F.array_join(F.transform(found, lambda c: c["x"]), "").alias("text"), F.lit(0).alias("n"))).otherwise(F.struct(new.alias("text"), count.alias("n")))

    done = rows.select("row", let(cells(F.col("text")), written).alias("new"))
    now = F.when(F.col("row")[text].isNotNull(), F.col("new.text"))

    def column(c: str) -> Column:
        if c == text:
            return now.alias(c)
        if c == "n_chars":
            return F.when(now.isNotNull(), F.char_length(now).cast(docs.schema[c].dataType)).otherwise(F.col("row")[c]).alias(c)
        return F.col("row")[c].alias(c)

    return done.select(*map(column, docs.columns), *([F.col("new.n").alias(counted)] if counted else []))
