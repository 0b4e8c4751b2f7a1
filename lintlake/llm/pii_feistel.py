"""Format-preserving pseudonyms for personal data, in DataFrame operations only.

A pattern finds candidates, a validation per kind decides (Luhn sum, octets, calendar, area numbers), and each valid value is
replaced by another value of the same format: a keyed Feistel network permutes the values of a format among themselves, so
equal values get equal pseudonyms in every document, different values different ones, and whoever has the key can
invert it. Kinds and the domains that are permuted:

* card: 13 to 19 digits, all but the last, which is set to the Luhn digit; separators stay;
* ssn: valid area, group and serial numbers;
* phone: North American numbers with area 200-999, with +1, with 1 or with neither in front, all of one domain; other international numbers
  (+, 8 to 15 digits) among those of the same country code and length; country codes stay;
* ip: all addresses; date: the days of 1700-2099 (one Gregorian cycle), as yyyy-MM-dd, yyyy/MM/dd, MM/dd/yyyy or dd.MM.yyyy;
  dd/MM/yyyy with a day above 12, and dates with a one-digit part, each among their like, so that they are read back as what they are (29 February:
  among the leap years); what can be read as month first is;
* iban: digits and letters of the account, each among their like, country stays, check digits are set anew;
* email: letters and digits of the local part, each among its like; capitals stay where they are, and the domain stays.

Symbols that stand alone (a local part of one letter) and leap years have no two halves; they are permuted by a keyed table.

The key itself is in no plan: keys for each use are derived from it (HMAC-SHA-256). Those, and the tables, are literals of the plan, so whoever may read plans, the
UI or event logs can undo pseudonyms; restrict these, or redact them (spark.sql.redaction.string.regex).

Values that fail validation stay as they are. Only texts with a digit or an @ are looked at closely. No shuffle.

Edge cases: NULL stays NULL, empty stays empty. Columns ``_p`` and ``pii_kinds`` of the input are replaced. Adjoining values are told apart by the pattern's bounds. Rows are independent.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.quality_votes import let

ROUNDS = 8
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_PHONE = r"\+1[ .-]?\(?[2-9][0-9]{2}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
_NATIONAL = r"(?<![0-9A-Za-z+])(?<![0-9][.-])(?:1[ .-])?(?:\([2-9][0-9]{2}\)[ .-]?|[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|[.-][0-9])"
_ABROAD = r"(?<![0-9A-Za-z+])\+[2-9](?:[ ./-]?\(?[0-9]\)?){7,14}(?![0-9])"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
_DATE = (r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![0-9/])(?:[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9/])"
         r"|(?<![0-9.])[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}(?![0-9]|\.[0-9])")
VALUE = "|".join((_EMAIL, _IBAN, _PHONE, _ABROAD, _NATIONAL, _SSN, _DATE, _IP, _CARD))
KINDS = ("email", "iban", "phone", "ssn", "date", "ip", "card")

# Country codes of one and of two digits; all others have three (ITU E.164).
_CODE = r"^(7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
_DAYS = [f"{m:02d}-{d:02d}" for m, n in enumerate((31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31), 1) for d in range(1, n + 1)]
# Dates that only some days of a year can have: what they look like, how they are read, and those days.
_SHORT = r"^(?:[1-9]{0}[1-9][0-9]?|[1-9][0-9]?{0}[1-9]){0}[0-9]{{4}}$"
_PARTLY = (
    ("day first", r"^(?:1[3-9]|2[0-9]|3[01])/[0-9]{2}/", "dd/MM/yyyy", [x for x in _DAYS if x[3:] > "12"]),
    ("short day first", r"^(?:1[3-9]|2[0-9]|3[01])/[1-9]/", "d/M/yyyy", [x for x in _DAYS if x[3:] > "12" and x < "10"]),
    ("short", _SHORT.format("/"), "M/d/yyyy", [x for x in _DAYS if x < "10" or x[3:] < "10"]),
    ("short dotted", _SHORT.format(r"\."), "d.M.yyyy", [x for x in _DAYS if x < "10" or x[3:] < "10"]),
)
_WHOLE = (("yyyy-MM-dd", r"^[0-9]{4}-"), ("yyyy/MM/dd", r"^[0-9]{4}/"), ("MM/dd/yyyy", r"^[0-9]{2}/[0-9]{2}/"), ("dd.MM.yyyy", r"^[0-9]{2}\.[0-9]{2}\."))


def _subkey(key: str, use: str) -> str:
    """The key for one use, of a fixed length."""
    return hmac.new(key.encode(), use.encode(), hashlib.sha256).hexdigest()


def _table(values: list, key: str, use: str, back: bool) -> list:
    """A keyed permutation of a few values: what the i-th one becomes."""
    moved = sorted(values, key=lambda x: hmac.new(key.encode(), f"{use}|{x}".encode(), hashlib.sha256).digest())
    return [values[moved.index(x)] for x in values] if back else moved


def _random(key: str, tweak: Column, round_: Column, half: Column) -> Column:
    """60 pseudo-random bits from the key, what is permuted, the round and one half."""
    told = F.concat_ws("|", F.lit(key), F.length(tweak).cast("string"), tweak, round_.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(told, 256), 1, 15), 16, 10).cast("bigint")


def feistel(value: Column, low: Column, high: Column, key: str, tweak: Column, back: bool = False) -> Column:
    """Permute 0 <= value < high * low; the halves are value div low and value mod low, and change in turn."""
    def step(h: Column, r: Column) -> Column:
        shift = lambda half, m: (F.lit(-1) if back else F.lit(1)) * F.pmod(_random(key, tweak, r, half), m)
        return F.struct(F.when(r % 2 == 0, F.pmod(h["a"] + shift(h["b"], high), high)).otherwise(h["a"]).alias("a"),
                        F.when(r % 2 == 1, F.pmod(h["b"] + shift(h["a"], low), low)).otherwise(h["b"]).alias("b"))

    start = F.struct(((value - F.pmod(value, low)) / low).cast("bigint").alias("a"), F.pmod(value, low).cast("bigint").alias("b"))
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, start, step, lambda h: h["a"] * low + h["b"])


def _power(base: int, n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(16)), F.lit(1).cast("bigint"), lambda acc, k: F.when(k <= n, acc * base).otherwise(acc))


def _digits(s: Column, key: str, tweak: str, back: bool, more: Column | None = None) -> Column:
    """Permute the strings of as many digits (18 at most)."""
    n, alone = F.length(s), "".join(_table(list("0123456789"), key, tweak, back))
    low, high = _power(10, F.floor(n / 2)), _power(10, n - F.floor(n / 2))
    moved = F.lpad(feistel(s.cast("bigint"), low, high, key, F.concat(F.lit(tweak), n.cast("string"), *([F.lit("|"), more] if more is not None else [])), back).cast("string"), n, "0")
    return F.when(n == 1, F.translate(s, "0123456789", alone)).otherwise(moved)


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _letters(s: Column, key: str, tweak: str, back: bool) -> Column:
    """Permute the strings of as many lower-case letters (12 at most)."""
    n, alone = F.length(s), "".join(_table(list(_LETTERS), key, tweak, back))
    value = F.aggregate(F.split(s, ""), F.lit(0).cast("bigint"), lambda acc, c: acc * 26 + F.ascii(c) - 97)
    low, high = _power(26, F.floor(n / 2)), _power(26, n - F.floor(n / 2))
    moved = feistel(value, low, high, key, F.concat(F.lit(tweak), n.cast("string")), back)
    spelled = let(moved, lambda v: F.array_join(F.transform(F.sequence(n - 1, F.lit(0)), lambda k: F.substring(F.lit(_LETTERS), (F.pmod(((v - F.pmod(v, _power(26, k))) / _power(26, k)).cast("bigint"), F.lit(26)) + 1).cast("int"), F.lit(1))), ""))
    return F.when(n == 1, F.translate(s, _LETTERS, alone)).otherwise(spelled)


def _fill(form: Column, pattern: str, symbols: Column) -> Column:
    """``form`` with the characters that match ``pattern`` replaced, in order, by those of ``symbols``."""
    step = lambda acc, c: F.when(c.rlike(pattern), F.struct((acc["i"] + 1).alias("i"), F.concat(acc["s"], F.substring(symbols, acc["i"], F.lit(1))).alias("s"))).otherwise(F.struct(acc["i"].alias("i"), F.concat(acc["s"], c).alias("s")))
    return F.aggregate(F.split(form, ""), F.struct(F.lit(1).alias("i"), F.lit("").alias("s")), step, lambda acc: acc["s"])


def _luhn_digit(body: Column) -> Column:
    """The digit that makes body + digit pass the Luhn check."""
    total = F.aggregate(F.split(F.reverse(body), ""), F.struct(F.lit(0).alias("i"), F.lit(0).alias("t")),
                        lambda acc, c: F.struct((acc["i"] + 1).alias("i"), (acc["t"] + F.when(acc["i"] % 2 == 0, F.pmod(c.cast("int") * 2, F.lit(10)) + F.when(c.cast("int") > 4, 1).otherwise(0)).otherwise(c.cast("int"))).alias("t")),
                        lambda acc: acc["t"])
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def kind(v: Column) -> Column:
    """The kind of a found value, or NULL if it fails validation."""
    digits = F.regexp_replace(v, "[^0-9]", "")
    octets = F.split(v, r"\.")
    area, group, serial = F.substring(v, 1, 3), F.substring(v, 5, 2), F.substring(v, 8, 4)
    return (
        F.when(v.contains("@"), "email")
        .when(v.rlike(f"^(?:{_IBAN})$"), F.when(F.substring(v, 3, 2).between("02", "98") & (_mod97(F.replace(v, F.lit(" "), F.lit(""))) == 1), "iban"))
        .when(v.startswith("+1"), "phone")
        .when(v.startswith("+"), F.when(F.length(digits).between(8, 15), "phone"))
        .when(v.rlike(f"^(?:{_NATIONAL})$"), "phone")
        .when(v.rlike(f"^(?:{_SSN})$"), F.when((area < "900") & ~area.isin("000", "666") & (group > "00") & (serial > "0000"), "ssn"))
        .when(v.rlike(f"^(?:{_DATE})$"), F.when(_day(v).isNotNull() | _partly(v, lambda date, *_: F.lit(True)), "date"))
        .when(v.rlike(f"^(?:{_IP})$"), F.when(F.forall(octets, lambda o: o.cast("int") <= 255), "ip"))
        .otherwise(F.when(F.length(digits).between(13, 19) & F.call_function("luhn_check", digits), "card"))
    )


def _mod97(iban: Column) -> Column:
    """The remainder that is 1 for a valid IBAN without spaces."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda acc, c: F.pmod(
        F.when(c.rlike("[A-Z]"), acc * 100 + F.ascii(c) - 55).otherwise(acc * 10 + F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0))), F.lit(97)))


def _whole(v: Column) -> Column:
    """The date of a text that any day can have."""
    return F.coalesce(*[F.when(v.rlike(looks), F.try_to_timestamp(v, F.lit(form)).cast("date")) for form, looks in _WHOLE])


def _day(v: Column) -> Column:
    """Days since 1700-01-01 of a date found, NULL if it is none of 1700-2099."""
    days = F.datediff(_whole(v), F.lit("1700-01-01").cast("date"))
    return F.when(days.between(0, 146096), days)


def _partly(v: Column, of: Callable) -> Column:
    """``of`` (date, name, format, days) of a date that only some days can have, NULL if it is none of 1700-2099."""
    def one(name: str, looks: str, form: str, days: list[str]) -> Column:
        date = F.when(v.rlike(looks), F.try_to_timestamp(v, F.lit(form)).cast("date"))
        return let(date, lambda d: F.when(F.year(d).between(1700, 2099), of(d, name, form, days)))

    return F.coalesce(*[one(*p) for p in _PARTLY])


def _moved_partly(v: Column, key: str, back: bool) -> Column:
    def of(date: Column, name: str, form: str, days: list[str]) -> Column:
        one = lambda n: F.lit(n).cast("bigint")
        years = [y for y in range(1700, 2100) if y % 4 == 0 and (y % 100 or y % 400 == 0)]
        listed, leap, moved = (F.array(*map(F.lit, x)) for x in (days, years, _table(years, key, name + " leap", back)))
        place = F.array_position(listed, F.date_format(date, "MM-dd")) - 1
        x = feistel((F.year(date).cast("bigint") - 1700) * len(days) + place, one(len(days)), one(400), key, F.lit(name), back)
        common = let(x, lambda x: F.concat((F.floor(x / len(days)) + 1700).cast("string"), F.lit("-"), F.element_at(listed, (F.pmod(x, one(len(days))) + 1).cast("int"))))
        year = F.element_at(moved, F.array_position(leap, F.year(date)).cast("int"))
        made = F.when(place >= 0, common).otherwise(F.concat(year.cast("string"), F.lit("-02-29")))
        return F.date_format(made.cast("date"), form)

    return _partly(v, of)


def pseudonym(v: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of a found value (or with ``back`` the value of a pseudonym); what is not valid stays."""
    key, abroad_key = _subkey(key, "pseudonym"), _subkey(key, "abroad")
    digits = F.regexp_replace(v, "[^0-9]", "")
    local = F.lower(F.substring_index(v, "@", 1))
    cased = lambda moved: F.array_join(F.zip_with(F.split(F.substring_index(v, "@", 1), ""), F.split(moved, ""), lambda o, m: F.when(o.rlike("^[A-Z]$"), F.upper(m)).otherwise(m)), "")
    parts = lambda cls, size: F.regexp_extract_all(F.regexp_replace(local, f"[^{cls}]", ""), F.lit(f".{{1,{size}}}"), F.lit(0))
    words = F.array_join(F.transform(parts("a-z", 12), lambda p: _letters(p, key, "letters", back)), "")
    numbers = F.array_join(F.transform(parts("0-9", 18), lambda p: _digits(p, key, "digits", back)), "")
    email = F.concat(cased(_fill(_fill(local, "^[a-z]$", words), "^[0-9]$", numbers)), F.lit("@"), F.substring_index(v, "@", -1))
    ten = F.right(digits, F.lit(10))
    phone_value = feistel(ten.cast("bigint") - 2_000_000_000, F.lit(10_000).cast("bigint"), F.lit(800_000).cast("bigint"), key, F.lit("phone"), back) + 2_000_000_000
    phone = _fill(v, "^[0-9]$", F.concat(F.when(F.length(digits) > 10, "1").otherwise(""), phone_value.cast("string")))
    code = F.regexp_extract(digits, _CODE, 1)
    abroad = let(code, lambda c: _fill(v, "^[0-9]$", F.concat(c, let(F.substring(digits, F.length(c) + 1, F.length(digits)), lambda rest: _digits(rest, abroad_key, "", back, c)))))
    account = F.lower(F.substring(F.replace(v, F.lit(" "), F.lit("")), F.lit(5), F.length(v)))
    runs = lambda cls, size: F.regexp_extract_all(F.regexp_replace(account, f"[^{cls}]", ""), F.lit(f".{{1,{size}}}"), F.lit(0))
    numbers_in = F.array_join(F.transform(runs("0-9", 18), lambda p, i: _digits(p, key, "iban", back, i.cast("string"))), "")
    letters_in = F.array_join(F.transform(runs("a-z", 12), lambda p: _letters(p, key, "iban", back)), "")
    moved = F.upper(_fill(_fill(account, "^[a-z]$", letters_in), "^[0-9]$", numbers_in))
    country = F.substring(v, 1, 2)
    iban = let(moved, lambda m: let(_mod97(F.concat(country, F.lit("00"), m)), lambda r: let(
        F.concat(country, F.lpad((98 - r).cast("string"), 2, "0"), m), lambda all_: _fill(v, "^[A-Z0-9]$", all_))))
    area = F.substring(v, 1, 3).cast("bigint")
    head = (area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + F.substring(v, 5, 2).cast("bigint") - 1
    ssn_value = feistel(head * 9999 + F.substring(v, 8, 4).cast("bigint") - 1, F.lit(9999).cast("bigint"), F.lit(898 * 99).cast("bigint"), key, F.lit("ssn"), back)

    def ssn_text(x: Column) -> Column:
        def of(a: Column) -> Column:
            area_no = a + 1 + F.when(a + 1 > 665, 1).otherwise(0)
            return F.format_string("%03d-%02d-%04d", area_no.cast("bigint"), (F.pmod(F.floor(x / 9999), F.lit(99)) + 1).cast("bigint"), (F.pmod(x, F.lit(9999)) + 1).cast("bigint"))
        return let(F.floor(x / (9999 * 99)), of)

    octet = lambda i: F.split(v, r"\.")[i].cast("bigint")
    ip_value = feistel(((octet(0) * 256 + octet(1)) * 256 + octet(2)) * 256 + octet(3), F.lit(65536).cast("bigint"), F.lit(65536).cast("bigint"), key, F.lit("ip"), back)
    ip = let(ip_value, lambda x: F.concat_ws(".", *[F.pmod(F.floor(x / 256 ** k), F.lit(256)).cast("string") for k in (3, 2, 1, 0)]))
    day = F.date_add(F.lit("1700-01-01").cast("date"), feistel(_day(v).cast("bigint"), F.lit(773).cast("bigint"), F.lit(189).cast("bigint"), key, F.lit("date"), back).cast("int"))
    whole = F.coalesce(*[F.when(v.rlike(looks), F.date_format(day, form)) for form, looks in _WHOLE])
    date = F.when(_day(v).isNotNull(), whole).otherwise(_moved_partly(v, key, back))
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    card = let(_digits(body, key, "card", back), lambda b: _fill(v, "^[0-9]$", F.concat(b, _luhn_digit(b))))
    k = kind(v)
    return F.coalesce(F.when(k == "email", email).when(k == "iban", iban).when((k == "phone") & v.rlike(r"^\+[^1]"), abroad).when(k == "phone", phone).when(k == "ssn", let(ssn_value, ssn_text)).when(k == "date", date).when(k == "ip", ip).when(k == "card", card), v)


def pseudonymise(text: Column, key: str, back: bool = False) -> Column:
    """(text, kinds): the text with pseudonyms for all valid values, and the kinds of the values in order."""
    def changed(found: Column) -> Column:
        def joined(rest: Column) -> Column:
            pieces = F.zip_with(rest, found, lambda r, v: F.concat(r, F.coalesce(pseudonym(v, key, back), F.lit(""))))
            return F.struct(F.array_join(pieces, "").alias("text"), F.filter(F.transform(found, kind), lambda k: k.isNotNull()).alias("kinds"))

        plain = F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds"))
        return F.when(F.size(found) > 0, let(F.split(text, VALUE, -1), joined)).otherwise(plain)

    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(VALUE), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return let(found, changed)


def apply(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and ``pii_kinds``."""
    return docs.withColumn("_p", pseudonymise(F.col(text), key)).withColumn(text, F.col("_p.text")).withColumn("pii_kinds", F.col("_p.kinds")).drop("_p")
