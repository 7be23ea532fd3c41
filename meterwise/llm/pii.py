"""Pseudonyms for personal data that keep its format: keyed Feistel permutations, in DataFrame expressions only.

Values are found by one regular expression and validated: card numbers by their check digit, IBANs by their remainder,
dates by the calendar, addresses by the range of their octets. A valid value is permuted within its format, so that a
card number stays one that checks and a date stays a date, and equal values of all documents get equal pseudonyms under
one key, however they are spaced or punctuated. A number ends where one of its kind can end; in a run of numbers cards
are tried at every extent of whole groups. What does not validate stays as it is.
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spare

ROUNDS = 8
#: The setting that holds the secret of pseudonyms.
KEY_SETTING = "spark.meterwise.secret.key"
#: Fixed formats. Each begins where no longer value of its kind can have begun, so that a search takes linear time.
EMAIL = r"(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
ADDRESS = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\w)"
DATE = r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\w/-]|\.\d)"
#: Lengths of IBANs by country.
LENGTHS = {
    length: names.split()
    for length, names in (
        (15, "NO"), (16, "BE"), (18, "DK FI FO GL NL"), (19, "MK SI"), (20, "AT BA EE KZ LT LU XK"), (21, "CH HR LI LV"), (22, "BG BH CR DE GB GE IE ME RS VA"),
        (23, "AE GI IL IQ OM TL"), (24, "AD CZ ES MD PK RO SA SE SK TN VG"), (25, "LY PT ST"), (26, "IS TR"), (27, "FR GR IT MC MR SM"),
        (28, "AL AZ BY CY DO GT HU LB PL SV"), (29, "BR EG PS QA UA"), (30, "JO KW MU"), (31, "MT SC"), (32, "LC"),
    )
}
_KNOWN = "(?:" + "|".join(rf"(?:{'|'.join(names)})\d{{2}}(?: ?[A-Z0-9]){{{length - 4}}}" for length, names in LENGTHS.items()) + r")(?!\w)"
#: An IBAN of a listed country ends at its length; other letters and digits stop where a listed one begins.
IBAN = rf"(?<!\w){_KNOWN}|(?<!\w)[A-Z]{{2}}\d{{2}}(?:(?! {_KNOWN}) ?[A-Z0-9]{{4}}){{2,7}}(?:(?! {_KNOWN}) ?[A-Z0-9]{{1,3}})?(?!\w)"
#: Where a number in groups goes no further: a card's groups begin, an address, a date or another phone number.
_GROUPED = r"\d{4}[ -](?:\d{4}[ -]\d{4}[ -]\d{1,4}|\d{6}[ -]\d{4,5})(?![\w-])"
_LOCAL = r"(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"
_OTHER = f"{ADDRESS}|{DATE}|{_LOCAL}"
_PARTS = lambda times, other: rf"\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{2,4}}(?:(?! (?:{other}))[ .-]?\d{{2,4}}){times}(?!\w)"
#: 7 to 15 digits end here; the engine looks behind for nothing that repeats in groups.
_DIGIT = r"\d[ .()-]{0,2}"
_ENOUGH = rf"(?<={_DIGIT * 6}\d)(?<!{_DIGIT * 15}\d)"
PHONE = "|".join(
    (
        r"(?<![\w+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\w)",
        rf"(?<![\w+]){_PARTS('{1,4}', f'{_OTHER}|{_GROUPED}')}{_ENOUGH}",
        rf"(?<![\w+]){_PARTS('{1,4}?', _OTHER)}{_ENOUGH}(?= {_GROUPED})",
        rf"(?<![\w+]){_PARTS('{1,4}', _OTHER)}{_ENOUGH}",
        r"(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)",
        _LOCAL,
    )
)
#: A run of numbers in which cards are looked for.
_TOKEN = r"\d++(?:-\d++)*+(?![\w-])"
CARD = rf"(?<![\w.-])(?=\d(?:[ -]?\d){{12}}){_TOKEN}(?: (?!{_OTHER}){_TOKEN})*+"
#: Digits of a card's groups, the usual ones first.
_CARDS = (r"^(?:16|4 4 4 4|15|4 6 5|14|4 6 4)$", r"^(?:13|17|18|19|4 4 4 1|4 4 4 4 [1-3])$")
SECRET = r"(?i:(?<!\w)(?:token|password|passwd|secret|api[_-]?key)) ?[=:] ?[\"']?[0-9a-fA-F]{16,}(?!\w)"
ALL = "|".join((EMAIL, SECRET, DATE, ADDRESS, IBAN, PHONE, CARD))
#: Dates are permuted within these years.
FIRST_DAY, LAST_DAY = "1900-01-01", "2099-12-31"
_DAYS, _LEFT, _RIGHT = 73049, 271, 270  # days from the first to the last, and a grid that just holds them


def _hash(key: str, kind: str, *parts: Column) -> Column:
    """60 keyed bits."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def let(value: Column, body) -> Column:
    """body(value) that evaluates value once, however often it is named there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _at(text: Column, i: Column) -> Column:
    return F.substr(text, i, F.lit(1))


def _each(text: Column, change) -> Column:
    """text with change(character, position) in place of each character."""
    return let(text, lambda t: F.when(F.length(t) == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: change(_at(t, i), i)), "")))


def _shifted(c: Column, by: Column, letters: int) -> Column:
    """A digit or letter moved by so many places among those of its kind; other characters stay."""
    moved = lambda base, n: F.char(F.pmod(F.ascii(c) - base + by, F.lit(n)) + base)
    return F.when(c.between("0", "9"), moved(48, 10)).when(c.between("a", "z"), moved(97, letters)).when(c.between("A", "Z"), moved(65, letters)).otherwise(c)


def feistel(text: Column, key: str, kind: str, tweak: Column | None = None, letters: int = 26) -> Column:
    """A permutation of the strings that have a digit, small or capital letter where text has one.

    In each round every character of one half moves by a keyed hash of the other half, the round and its position.
    """

    def network(text: Column, tweak: Column) -> Column:
        half = F.floor(F.length(text) / 2).cast("int")

        def round_(state: Column, i: Column) -> Column:
            left, right = state["left"], state["right"]
            mixed = lambda own, other: _each(own, lambda c, j: let(_hash(key, kind, tweak, F.length(text), i, j, other), lambda by: _shifted(c, by, letters)))
            return F.when(i % 2 == 0, F.struct(mixed(left, right).alias("left"), right.alias("right"))).otherwise(F.struct(left.alias("left"), mixed(right, left).alias("right")))

        begin = F.struct(F.substr(text, F.lit(1), half).alias("left"), F.substr(text, half + 1, F.length(text)).alias("right"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, round_, lambda s: F.concat(s["left"], s["right"]))

    return let(text, lambda t: let(F.lit("") if tweak is None else tweak, lambda w: network(t, w)))


def _fill(shape: Column, values: Column, of: str) -> Column:
    """shape with its characters of the class `of` replaced by values, one after another."""
    place = lambda whole, i: F.length(F.regexp_replace(F.substr(whole, F.lit(1), i), f"[^{of}]", ""))
    return let(values, lambda v: let(shape, lambda whole: _each(whole, lambda c, i: F.when(c.rlike(f"[{of}]"), _at(v, place(whole, i))).otherwise(c))))


def luhn(digits: Column) -> Column:
    """The sum of the digits, every second from the right doubled: a card number's is divisible by ten."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = _at(digits, n + 1 - i).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def mod97(text: Column) -> Column:
    """The remainder by 97 of digits and capital letters, a letter standing for two digits."""

    def add(rest: Column, i: Column) -> Column:
        c = _at(text, i)
        return F.when(c.between("0", "9"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add)


def _card(value: Column, key: str) -> Column:
    """The first digit stays, the last is the check digit again."""

    def changed(digits: Column) -> Column:
        first, middle = _at(digits, F.lit(1)), F.substr(digits, F.lit(2), F.length(digits) - 2)
        check = lambda body: F.pmod(10 - luhn(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string")
        whole = let(F.concat(first, feistel(middle, key, "card", first)), lambda body: F.concat(body, check(body)))
        return F.when(luhn(digits) % 10 == 0, _fill(value, whole, "0-9")).otherwise(value)

    return let(F.regexp_replace(value, "[^0-9]", ""), changed)


def _cards(run: Column, key: str) -> Column:
    """(new, n): a run of numbers with pseudonyms for its n cards.

    A card is any 13 to 19 digits of whole groups that check, in a card's usual groups, in groups of at least three
    digits, or as many groups as possible from the first. From left to right the longest is taken, usual groups first,
    unless a more usual one begins within it.
    """

    def found(groups: Column, bare: Column) -> Column:
        count = F.size(groups)
        part = lambda array, i, j: F.slice(array, i + 1, j - i + 1)

        def best(i: Column) -> Column:
            ends = F.sequence(i, F.least(i + 18, count - 1))
            spans = F.transform(ends, lambda j: F.struct(j.alias("j"), F.array_join(part(bare, i, j), "").alias("digits")))
            spans = F.filter(spans, lambda s: F.length(s["digits"]).between(13, 19))
            last = let(spans, lambda all_: F.when(F.size(all_) > 0, F.transform(all_, lambda s: F.struct(s["j"].alias("j"), s["digits"].alias("digits"), (s["j"] == F.element_at(all_, -1)["j"]).alias("most")))))

            def rank(s: Column) -> Column:
                sizes = F.transform(part(bare, i, s["j"]), F.length)
                shape = F.array_join(F.transform(sizes, lambda n: n.cast("string")), " ")
                return F.when(shape.rlike(_CARDS[0]), 0).when(shape.rlike(_CARDS[1]), 1).when(F.forall(sizes, lambda n: n > 2) | ((i == 0) & s["most"]), 2)

            ranked = F.transform(F.filter(last, lambda s: luhn(s["digits"]) % 10 == 0), lambda s: F.struct(rank(s).alias("rank"), (-s["j"]).alias("end")))
            return F.array_min(F.filter(ranked, lambda r: r["rank"].isNotNull()))

        def choose(all_: Column) -> Column:
            def step(state: Column, i: Column) -> Column:
                own = F.get(all_, i)
                better = F.exists(F.slice(all_, i + 2, F.greatest(-own["end"] - i, F.lit(0))), lambda x: F.coalesce(x["rank"] < own["rank"], F.lit(False)))
                taken = F.struct((1 - own["end"]).alias("next"), F.concat(state["hits"], F.array(F.struct(i.alias("i"), (-own["end"]).alias("j")))).alias("hits"))
                return F.when((i >= state["next"]) & own.isNotNull() & ~better, taken).otherwise(state)

            begin = F.struct(F.lit(0).alias("next"), F.lit([]).cast("array<struct<i:int,j:int>>").alias("hits"))
            return F.aggregate(F.sequence(F.lit(0), count - 1), begin, step, lambda state: state["hits"])

        def written(hits: Column) -> Column:
            n = F.size(hits)
            plain = lambda i, j: F.when(j >= i, F.array_join(part(groups, i, j), "")).otherwise("")
            before = lambda k: F.when(k == 0, 0).otherwise(F.get(hits, k - 1)["j"] + 1)
            pieces = F.transform(hits, lambda h, k: F.concat(plain(before(k), h["i"] - 1), _card(plain(h["i"], h["j"]), key)))
            return F.when(n > 0, F.struct(F.concat(F.array_join(pieces, ""), plain(before(n), count - 1)).alias("new"), n.alias("n"))).otherwise(F.struct(run.alias("new"), F.lit(0).alias("n")))

        return let(let(F.transform(F.sequence(F.lit(0), count - 1), best), choose), written)

    return let(F.regexp_extract_all(run, F.lit("[ -]?[0-9]+"), F.lit(0)), lambda groups: let(F.transform(groups, lambda g: F.regexp_replace(g, "[^0-9]", "")), lambda bare: found(groups, bare)))


def _iban(value: Column, key: str) -> Column:
    """The country stays, the check digits are those of the permuted account. What follows after a blank may not belong
    to it: the longest part that checks is taken."""
    bare_of = lambda v: F.replace(v, F.lit(" "), F.lit(""))
    holds = lambda bare: F.length(bare).between(12, 35) & (mod97(F.concat(F.substr(bare, F.lit(5), F.length(bare)), F.substr(bare, F.lit(1), F.lit(4)))) == 1)

    def changed(part: Column) -> Column:
        def new(bare: Column) -> Column:
            country, account = F.substr(bare, F.lit(1), F.lit(2)), F.substr(bare, F.lit(5), F.length(bare))
            check = lambda new: F.lpad((98 - mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
            whole = let(feistel(account, key, "iban", country), lambda new: F.concat(country, check(new), new))
            return _fill(part, whole, "A-Z0-9")

        return F.concat(let(bare_of(part), new), F.substr(value, F.length(part) + 1, F.length(value)))

    words = F.split(value, " ")
    parts = F.transform(F.sequence(F.size(words), F.lit(1)), lambda n: F.array_join(F.slice(words, 1, n), " "))
    return let(F.get(F.filter(parts, lambda p: holds(bare_of(p))), F.lit(0)), lambda part: F.when(part.isNotNull(), changed(part)).otherwise(value))


def _phone(value: Column, key: str) -> Column:
    """The country code stays; a number of ten digits without one counts as one of country 1."""
    code = F.regexp_extract(value, r"^\+(\d{1,3})[ .(-]", 1)
    digits = F.regexp_replace(value, "[^0-9]", "")
    rest = F.substr(digits, F.length(code) + 1, F.length(digits))
    country = F.when((code == "") & ~value.startswith("+"), "1").otherwise(code)
    return F.when(F.length(digits).between(7, 15), _fill(value, F.concat(code, feistel(rest, key, "phone", country)), "0-9")).otherwise(value)


def _address(value: Column, key: str) -> Column:
    """Two halves of 16 bits."""
    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    low = lambda i: (octets[i] * 256 + octets[i + 1]).cast("long")

    def round_(state: Column, i: Column) -> Column:
        left, right = state["left"], state["right"]
        moved = lambda own, other: F.pmod(own + _hash(key, "address", i, other), F.lit(65536)).cast("long")
        return F.when(i % 2 == 0, F.struct(moved(left, right).alias("left"), right.alias("right"))).otherwise(F.struct(left.alias("left"), moved(right, left).alias("right")))

    text = lambda x: F.concat(F.floor(x / 256).cast("string"), F.lit("."), (x % 256).cast("string"))
    new = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(low(0).alias("left"), low(2).alias("right")), round_, lambda s: F.concat(text(s["left"]), F.lit("."), text(s["right"])))
    return F.when(F.forall(octets, lambda x: x < 256), new).otherwise(value)


def _day(day: Column, key: str) -> Column:
    """Day numbers permuted: a Feistel network on a grid, walked on until it comes to a day again."""

    def network(x: Column) -> Column:
        def round_(state: Column, i: Column) -> Column:
            left, right = state["left"], state["right"]
            moved = lambda own, other, n: F.pmod(own + _hash(key, "date", i, other), F.lit(n)).cast("long")
            return F.when(i % 2 == 0, F.struct(moved(left, right, _LEFT).alias("left"), right.alias("right"))).otherwise(F.struct(left.alias("left"), moved(right, left, _RIGHT).alias("right")))

        begin = F.struct(F.floor(x / _RIGHT).cast("long").alias("left"), (x % _RIGHT).cast("long").alias("right"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, round_, lambda s: s["left"] * _RIGHT + s["right"])

    outside = _LEFT * _RIGHT - _DAYS
    return F.aggregate(F.sequence(F.lit(0), F.lit(outside)), F.lit(-1).cast("long"), lambda now, i: F.when(i == 0, network(day)).when(now < _DAYS, now).otherwise(network(now)))


def _date(value: Column, key: str) -> Column:
    """1999-12-31, 31.12.1999 or 12/31/1999; a day and month with two digits keep two."""
    part = F.split(value, r"[-./]")
    year, month, day = (F.when(value.contains("-"), part[a]).when(value.contains("."), part[b]).otherwise(part[c]).cast("int") for a, b, c in ((0, 2, 2), (1, 1, 0), (2, 0, 1)))
    date = F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")
    number = F.date_diff(date, F.to_date(F.lit(FIRST_DAY))).cast("long")
    short = ~value.rlike(r"^\d\d[./]\d\d[./]|-")

    def written(new: Column) -> Column:
        out = F.when(value.contains("-"), F.date_format(new, "yyyy-MM-dd"))
        out = out.when(value.contains("."), F.when(short, F.date_format(new, "d.M.yyyy")).otherwise(F.date_format(new, "dd.MM.yyyy")))
        return out.otherwise(F.when(short, F.date_format(new, "M/d/yyyy")).otherwise(F.date_format(new, "MM/dd/yyyy")))

    changed = let(number, lambda n: let(F.date_add(F.to_date(F.lit(FIRST_DAY)), _day(n, key).cast("int")), written))
    return F.when(number.between(0, _DAYS - 1), changed).otherwise(value)


def _cased(shape: Column, small: Column) -> Column:
    """small with capitals where shape has some."""
    return let(small, lambda new: _each(shape, lambda c, i: F.when(c.between("A", "Z"), F.upper(_at(new, i))).otherwise(_at(new, i))))


def _email(value: Column, key: str) -> Column:
    """The domain stays; capitals count as small letters, and stay capitals."""
    name, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    return F.concat(_cased(name, feistel(F.lower(name), key, "email", F.lower(domain))), F.lit("@"), domain)


def _secret(value: Column, key: str) -> Column:
    """The hexadecimal digits after the name; capitals count as small letters, and stay capitals."""
    secret = F.regexp_extract(value, "[0-9a-fA-F]+$", 0)
    return F.concat(F.substr(value, F.lit(1), F.length(value) - F.length(secret)), _cased(secret, feistel(F.lower(secret), key, "secret", letters=6)))


def pseudonym(value: Column, key: str) -> Column:
    """(new, n): what ALL has found with pseudonyms for its n values; what does not validate stays."""
    whole = lambda pattern: value.rlike(f"^(?:{pattern})$")
    kinds = ((value.contains("@"), _email), (whole(SECRET), _secret), (whole(DATE), _date), (whole(ADDRESS), _address), (value.rlike("^[A-Z]"), _iban), (value.rlike("^[+(]") | whole(_LOCAL), _phone))
    out = None
    for holds, change in kinds:
        one = let(change(value, key), lambda new: F.struct(new.alias("new"), (new != value).cast("int").alias("n")))
        out = F.when(holds, one) if out is None else out.when(holds, one)
    return out.otherwise(_cards(value, key))


def session_key(spark: SparkSession) -> str:
    """The secret in the setting KEY_SETTING. Where it is unset the session gets one of its own: pseudonyms then agree within
    the session only, and nobody can invert them."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(16)
        spark.conf.set(KEY_SETTING, key)
    return key


#: What Spark leaves out of the plans that it shows and logs: the digests that hashes are keyed with.
_DIGEST = r"\b[0-9a-f]{64}\b"
_REDACTED = "spark.sql.redaction.string.regex"


def hidden(spark: SparkSession, key: str) -> str:
    """The digest of a key that plans hold instead of it, and which Spark redacts in their texts from now on: who reads plans, the
    web interface or event logs can't undo pseudonyms. (Settings with `secret` in their names are redacted by default.)"""
    before = spark.conf.get(_REDACTED, None) or ""
    if _DIGEST not in before:
        spark.conf.set(_REDACTED, f"(?:{before})|{_DIGEST}" if before else _DIGEST)
    return hashlib.sha256(key.encode()).hexdigest()


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with pseudonyms in its text, and (count_col) how many values of a text they replace.

    Null texts stay null, with 0 values; empty texts stay empty; texts of any length are gone through whole; an empty table gives
    no rows. Other columns and repeated rows stay as they are.
    """
    key = hidden(docs.sparkSession, key)
    count, found, parts = spare(docs.columns, "pii_count", "pii_found", "pii_parts")
    text = F.col(text_col)
    may = text.rlike("[0-9@]")  # every value has a digit or an @
    out = docs.withColumns({found: F.when(may, F.regexp_extract_all(text, F.lit(ALL), F.lit(0))), parts: F.when(may, F.split(text, ALL, -1))})
    out = out.withColumn(count, F.transform(found, lambda m: pseudonym(m, key)))
    joined = F.concat(F.array_join(F.zip_with(F.slice(F.col(parts), 1, F.size(count)), F.col(count), lambda a, b: F.concat(a, b["new"])), ""), F.element_at(parts, -1))
    columns = [F.when(F.size(found) > 0, joined).otherwise(text).alias(text_col) if c == text_col else F.col(c) for c in docs.columns]
    if count_col:
        columns.append(F.coalesce(F.aggregate(count, F.lit(0), lambda n, m: n + m["n"]), F.lit(0)).alias(count_col))
    return out.select(*columns)
