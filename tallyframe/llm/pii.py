"""Format-preserving pseudonyms for personal data, in DataFrame functions alone.

Card numbers (Luhn-checked), telephone and social-security numbers, IPv4 addresses, dates, e-mail names and access
keys are found by one pattern, validated, and put through a keyed Feistel network over their own format: a value is
cut in halves, and in every round one half is shifted, element by element, by a keyed SHA-512 digest of the other. The
network is a bijection of each format, so equal values get equal pseudonyms in every document and different values
different ones; a pseudonym is a valid value of its kind again (check digits are computed anew, days exist).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6
HEX = "0123456789abcdef"

# What each kind looks like. Order matters where one is a prefix of another.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
KEY = r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"
TOKEN = r"(?<=(?i:token|secret|key|password) ?[=:] ?[\"']?)[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])"
IPV4 = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"
ISO_DATE = r"(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9](?!(?!T[0-9]{2}:)[0-9A-Za-z]|-[0-9])"
DAY_DATE = r"[0-3]?[0-9]([/.])[0-3]?[0-9]\1(?:19|20)[0-9]{2}(?![0-9A-Za-z]|[/.][0-9])"
SOCIAL = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
PHONE = r"(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|-[0-9])"
CARD = r"[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|-[0-9])"
# cards within a longer run of digits: 4-4-4-4, 4-6-5 or solid
SHAPED = r"(?<![0-9])(?=((?:[0-9]{4}[ -]){3}[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9]))"
KINDS = {"email": EMAIL, "key": KEY, "token": TOKEN, "ipv4": IPV4, "iso": ISO_DATE, "day": DAY_DATE, "social": SOCIAL, "phone": PHONE, "card": CARD}
ANY = r"(?<![0-9A-Za-z_.+-])(?:" + "|".join(KINDS.values()) + ")"
# what a text with any of the kinds holds: a digit or an @, or the lead of a key or token that may be letters alone
LEAD = r"[0-9@]|AKIA|(?i:token|secret|key|password) ?[=:]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def digest(key: str, kind: str, turn: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), half), 512)


def byte_at(hashed: Column, i: Column) -> Column:
    """Byte ``i`` (from 0) of a hexadecimal SHA-512 digest, which repeats after 64."""
    return F.conv(F.substr(hashed, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def feistel(elements: Column, key: str, kind: str, shift: Callable[[Column, Column], Column]) -> Column:
    """The permuted array of strings; ``shift`` adds a byte to an element within its format."""
    cut = F.floor(F.size(elements) / 2).cast("int")
    start = F.struct(F.slice(elements, F.lit(1), cut).alias("left"), F.slice(elements, cut + 1, F.size(elements) - cut).alias("right"))

    def turn(acc: Column, r: Column) -> Column:
        hashed = digest(key, kind, r, F.array_join(acc["right"], ","))
        moved = let(hashed, lambda h: F.transform(acc["left"], lambda x, i: shift(x, byte_at(h, i))))
        return F.struct(acc["right"].alias("left"), moved.alias("right"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda acc: F.concat(acc["left"], acc["right"]))


def modulo(size: int) -> Callable[[Column, Column], Column]:
    return lambda x, b: F.pmod(x.cast("int") + b, F.lit(size)).cast("string")


def shift_character(x: Column, b: Column) -> Column:
    """Digits stay digits, letters letters of their case, other characters themselves."""
    out = x
    for first, size in (("0", 10), ("A", 26), ("a", 26)):
        place = F.ascii(x) - ord(first)
        out = F.when((place >= 0) & (place < size), F.char(F.pmod(place + b, F.lit(size)) + ord(first))).otherwise(out)
    return out


def shift_hex(x: Column, b: Column) -> Column:
    return F.substr(F.lit(HEX), F.pmod(F.instr(F.lit(HEX), x) - 1 + b, F.lit(16)) + 1, F.lit(1))


def shift_cased_hex(x: Column, b: Column) -> Column:
    """Digits stay digits, and A to F or a to f letters of their case, so that tokens with capitals are permuted."""
    out = x
    for first, size in (("0", 10), ("A", 6), ("a", 6)):
        place = F.ascii(x) - ord(first)
        out = F.when((place >= 0) & (place < size), F.char(F.pmod(place + b, F.lit(size)) + ord(first))).otherwise(out)
    return out


def characters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda x: x != "")


def filled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by those of the array ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        number = x.rlike("[0-9]")
        return F.struct(F.concat(acc["out"], F.when(number, F.get(digits, acc["n"])).otherwise(x)).alias("out"), (acc["n"] + number.cast("int")).alias("n"))

    return F.aggregate(characters(shape), start, step, lambda acc: acc["out"])


def digits_of(s: Column) -> Column:
    return characters(F.regexp_replace(s, "[^0-9]", ""))


def check_digit(body: Column) -> Column:
    """The Luhn digit that closes an array of digits."""

    def weight(x: Column, i: Column) -> Column:
        double = x.cast("int") * 2
        return F.when(F.pmod(F.size(body) - i, F.lit(2)) == 1, double - F.when(double > 9, 9).otherwise(0)).otherwise(x.cast("int"))

    total = F.aggregate(F.transform(body, weight), F.lit(0), lambda a, x: a + x)
    return F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def luhn(d: Column) -> Column:
    return check_digit(F.slice(d, F.lit(1), F.size(d) - 1)) == F.element_at(d, -1)


def card(m: Column, key: str) -> Column:
    """Luhn-valid numbers of one length are permuted among themselves: the whole run, or else card-shaped parts."""

    def fresh(x: Column) -> Column:
        def body(d: Column) -> Column:
            return let(feistel(F.slice(d, F.lit(1), F.size(d) - 1), key, "card", modulo(10)), lambda p: filled(x, F.concat(p, F.array(check_digit(p)))))

        return let(digits_of(x), body)

    parts = F.filter(F.regexp_extract_all(m, F.lit(SHAPED), F.lit(1)), lambda x: luhn(digits_of(x)))
    chosen = F.when(luhn(digits_of(m)), F.array(m)).otherwise(parts)
    return F.aggregate(chosen, m, lambda acc, x: F.replace(acc, x, fresh(x)))


def phone(m: Column, key: str) -> Column:
    """The ten national digits are permuted; a country code stays."""
    code = F.regexp_extract(m, r"^(\+1[ .-]?)?", 0)
    rest = F.substr(m, F.length(code) + 1)
    return F.concat(code, let(rest, lambda r: filled(r, feistel(digits_of(r), key, "phone", modulo(10)))))


def ipv4(m: Column, key: str) -> Column:
    """Addresses whose parts are 0 to 255 without needless zeros."""
    parts = F.split(m, r"\.")
    valid = F.forall(parts, lambda x: (x.cast("int") < 256) & (x == x.cast("int").cast("string")))
    return F.when(valid, F.array_join(feistel(parts, key, "ipv4", modulo(256)), ".")).otherwise(m)


def moved_date(d: Column, key: str) -> Column:
    """A day of 1900 to 2099 among those days; 29 February among the 49 of them."""
    leap = (F.month(d) == 2) & (F.dayofmonth(d) == 29)
    # years and the 365 days of a common year are the two halves
    day = F.dayofyear(F.make_date(F.lit(2001), F.month(d), F.when(leap, 28).otherwise(F.dayofmonth(d)))) - 1
    start = F.struct((F.year(d) - 1900).alias("y"), day.alias("d"))

    def number(r: Column, half: Column) -> Column:
        return F.conv(F.substr(digest(key, "date", r, half.cast("string")), F.lit(1), F.lit(12)), 16, 10).cast("long")

    def turn(acc: Column, r: Column) -> Column:
        year = F.pmod(acc["y"] + number(r, acc["d"]), F.lit(200)).cast("int")
        return let(year, lambda y: F.struct(y.alias("y"), F.pmod(acc["d"] + number(-r, y), F.lit(365)).cast("int").alias("d")))

    def result(acc: Column) -> Column:
        plain = F.date_add(F.lit("2001-01-01").cast("date"), acc["d"])
        return F.make_date(acc["y"] + 1900, F.month(plain), F.dayofmonth(plain))

    common = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, turn, result)
    place = F.pmod(F.floor((F.year(d) - 1904) / 4) + number(F.lit(0), F.lit("29 February")), F.lit(49)).cast("int")
    return F.when(leap, F.make_date(place * 4 + 1904, F.lit(2), F.lit(29))).otherwise(common)


def moved_late(d: Column, key: str) -> Column:
    """A day of 1900 to 2099 after the 12th of its month among such days; 29 February as in ``moved_date``."""
    late = F.filter(F.sequence(F.lit("2001-01-01").cast("date"), F.lit("2001-12-31").cast("date")), lambda x: F.dayofmonth(x) > 12)
    leap = (F.month(d) == 2) & (F.dayofmonth(d) == 29)
    common = F.make_date(F.lit(2001), F.month(d), F.when(leap, 28).otherwise(F.dayofmonth(d)))
    start = F.struct((F.year(d) - 1900).alias("y"), (F.array_position(late, common).cast("int") - 1).alias("d"))

    def number(r: Column, half: Column) -> Column:
        return F.conv(F.substr(digest(key, "late", r, half.cast("string")), F.lit(1), F.lit(12)), 16, 10).cast("long")

    def turn(acc: Column, r: Column) -> Column:
        year = F.pmod(acc["y"] + number(r, acc["d"]), F.lit(200)).cast("int")
        return let(year, lambda y: F.struct(y.alias("y"), F.pmod(acc["d"] + number(-r, y), F.lit(221)).cast("int").alias("d")))

    moved = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, turn, lambda acc: F.make_date(acc["y"] + 1900, F.month(F.get(late, acc["d"])), F.dayofmonth(F.get(late, acc["d"]))))
    return F.when(leap, moved_date(d, key)).otherwise(moved)


def iso_date(m: Column, key: str) -> Column:
    return let(F.try_to_date(m, "yyyy-MM-dd"), lambda d: F.coalesce(F.date_format(moved_date(d, key), "yyyy-MM-dd"), m))


def day_date(m: Column, key: str) -> Column:
    """Day, month, year, or month, day, year where only that exists, among days after the 12th; the separators and whether days and months are padded stay."""
    sep = F.regexp_extract(m, "[/.]", 0)
    parts = F.split(m, "[/.]")
    padded = F.when((F.length(parts[0]) == 2) & (F.length(parts[1]) == 2), F.lit(2)).otherwise(F.lit(1))
    parsed = F.try_to_date(F.concat_ws("-", parts[2], parts[1], parts[0]), "yyyy-M-d")

    american = F.try_to_date(F.concat_ws("-", parts[2], parts[0], parts[1]), "yyyy-M-d")

    def write(d: Column, first: int = 0) -> Column:
        two = [F.when(padded == 2, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string")) for x in (F.dayofmonth(d), F.month(d))]
        return F.concat(two[first], sep, two[1 - first], sep, F.year(d).cast("string"))

    return let(parsed, lambda d: F.when(d.isNull(), let(american, lambda e: F.when(e.isNull(), m).otherwise(let(moved_late(e, key), lambda x: write(x, 1))))).otherwise(let(moved_date(d, key), lambda x: write(x))))


def email(m: Column, key: str) -> Column:
    """The name is permuted, the domain stays."""
    name = F.substring_index(m, "@", 1)
    return F.concat(F.array_join(feistel(characters(name), key, "email", shift_character), ""), F.lit("@"), F.substring_index(m, "@", -1))


def pseudonym(m: Column, key: str) -> Column:
    """What stands for one match; what fails validation stays."""
    whole = {k: "^(?:" + p.split("(?!")[0] + ")$" for k, p in KINDS.items()}
    kinds = {
        "email": email(m, key),
        "key": F.concat(F.lit("AKIA"), F.array_join(feistel(characters(F.substr(m, F.lit(5))), key, "key", shift_character), "")),
        "ipv4": ipv4(m, key),
        "iso": iso_date(m, key),
        "day": day_date(m, key),
        "social": let(m, lambda x: filled(x, feistel(digits_of(x), key, "social", modulo(10)))),
        "phone": phone(m, key),
        "card": card(m, key),
    }
    cased, plain = (F.array_join(feistel(characters(m), key, "token", shift), "") for shift in (shift_cased_hex, shift_hex))
    out = F.when(m.rlike("[A-F]"), cased).otherwise(plain)
    for kind, to in reversed(kinds.items()):
        out = F.when(m.rlike(whole[kind]), to).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with ``text`` pseudonymised under ``key``, and ``n_private int``, the values replaced.

    What looks like a kind but isn't valid (a card that fails its check digit, an address part over 255, a day that
    doesn't exist) stays, as do all other characters. Null texts stay null with 0. Rows are independent: repeats,
    nulls elsewhere and extra columns pass through (a column ``n_private`` is replaced); an empty table gives no rows.
    """
    text = F.col("text").cast("string")
    found = F.when(text.rlike(LEAD), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    marked = docs.withColumn("__found", found).withColumn("__new", F.transform("__found", lambda m: pseudonym(m, key)))
    between = F.split(text, ANY, -1)
    woven = F.transform(between, lambda s, i: F.concat(s, F.coalesce(F.get("__new", i), F.lit(""))))
    changed = F.size(F.filter(F.arrays_zip("__found", "__new"), lambda x: x["__found"] != x["__new"]))
    out = marked.withColumn("n_private", F.when(text.isNull(), 0).otherwise(changed))
    return out.withColumn("text", F.when(F.size("__found") > 0, F.array_join(woven, "")).otherwise(text)).drop("__found", "__new")
