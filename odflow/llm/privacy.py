"""Pseudonyms in the format of the value: a keyed Feistel permutation of digits, addresses and dates.

All of it is DataFrame expressions. A text is split at candidate matches; each is
validated, permuted and put back, so equal values get equal pseudonyms in all
documents, and a permutation never maps two values to one. Card numbers keep a
valid check digit, IBANs valid check digits, addresses stay IPv4, dates stay dates
from 1900 to 2099, in digits or with an English month's name. Mail addresses and secrets, which have no fixed format, get a
keyed hash in their alphabet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, refuse

ROUNDS = 10
DATE_SIDE = 270  # dates are pairs of numbers below it: 72,900 days from 1900-01-01
KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "card", "secret")

# Groups that repeat without a bound are possessive: Java matches those in a loop, all others by recursion, which a long text drives out of the stack.
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
#: Lengths of IBANs by country.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_OF_COUNTRY = "|".join(f"(?:{c.replace(' ', '|')})\\d{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + f" ?[A-Z0-9]{{{n % 4}}}" * (n % 4 > 0) for n, c in _IBAN_LENGTHS.items())
_IBAN = rf"\b(?=[A-Z]{{2}}\d{{2}})(?:(?:{_OF_COUNTRY})\b|[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?\b)"
_IP = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
_DATE = r"(?<![\d/.-])(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})(?![-/]?\d)"
#: Names of months, in calendar order.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_WRITTEN = rf"\b\d{{1,2}} (?:{'|'.join(MONTHS)}) \d{{4}}(?!\d)|\b(?:{'|'.join(MONTHS)}) \d{{1,2}}, \d{{4}}(?!\d)"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_PHONE = "|".join((
    r"(?<![\w+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)",
    r"(?<![\w+])\+(?!1\b)\d{2,3}[ .-]?(?:\(0\)[ .-]?)?\d{1,2}(?:[ .-]\d{2}){4}(?!\.?\d)",  # groups of two, as in France
    r"(?<![\w+])\+(?!1\b)\d{2,3}[ .-]\d(?:[ .-]\d{2,4}){2,3}(?!\.?\d)",
    r"(?<![\w+])\+(?!1\b)\d{2,3}(?:[ .-]?\d{2,4}){2,4}(?!\.?\d)",
    r"(?<![\w.+-])0[1-9](?:[ .-]\d{2}){4}(?![.-]?\d)",
    r"(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)",
    r"(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-]?\d)",
))
_CARD = r"(?<!\d)(?:\d{13,19}|\d{4}(?: \d{4}){3}(?: \d{3})?|\d{4}(?:-\d{4}){3}(?:-\d{3})?|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)"
_SET = r"[\"']?[ \t]{0,2}[=:][ \t]{0,2}[\"']?"
_SECRET = rf"\bAKIA[A-Z0-9]{{16}}\b|(?i:\b(?:password|passwd|pwd|secret|api[_-]?key|token){_SET})[^\s\"']+|\b[0-9A-Fa-f]{{40}}\b|\b(?:sk|pk|rk)-[A-Za-z0-9_-]{{16,}}|\bgh[opsu]_[A-Za-z0-9]{{16,}}"
_CANDIDATE = "|".join((_EMAIL, _SECRET, _IBAN, _IP, _DATE, _WRITTEN, _SSN, _PHONE, _CARD))


def _digest(key: str, *parts: Column) -> Column:
    """Hex of a keyed SHA-256."""
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 256)


def _number(key: str, *parts: Column) -> Column:
    """The first 60 bits of the keyed hash."""
    return F.conv(F.substring(_digest(key, *parts), 1, 15), 16, 10).cast("long")


def permute_digits(digits: Column, key: str, tweak: str) -> Column:
    """A permutation of the strings of as many digits (2 to 36): ten unbalanced Feistel rounds."""

    def round_(pair: Column, i: Column) -> Column:
        size = F.length(pair["a"])
        modulus = F.rpad(F.lit("1"), size + 1, F.lit("0")).cast("long")
        new = F.pmod(pair["a"].cast("long") + F.pmod(_number(key, F.lit(tweak), i.cast("string"), pair["b"]), modulus), modulus)
        return F.struct(pair["b"].alias("a"), F.lpad(new.cast("string"), size, F.lit("0")).alias("b"))

    half = (F.length(digits) / 2).cast("int")
    pair = F.struct(F.substr(digits, F.lit(1), half).alias("a"), F.substr(digits, half + 1).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), pair, round_, lambda p: F.concat(p["a"], p["b"]))


def permute_pair(left: Column, right: Column, side: int, key: str, tweak: str) -> Column:
    """A permutation of pairs of numbers below side, as struct a, b."""

    def round_(pair: Column, i: Column) -> Column:
        add = F.pmod(_number(key, F.lit(tweak), i.cast("string"), pair["b"].cast("string")), F.lit(side))
        return F.struct(pair["b"].alias("a"), F.pmod(pair["a"] + add, F.lit(side)).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("a"), right.cast("long").alias("b")), round_)


def _only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _put(pattern: Column, digits: Column) -> Column:
    """The pattern with its digits replaced in turn."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("i"))
    step = lambda acc, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(acc["out"], F.substr(digits, acc["i"], F.lit(1))).alias("out"), (acc["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["i"].alias("i")))
    return F.aggregate(F.split(pattern, ""), start, step, lambda acc: acc["out"])


def _luhn_sum(digits: Column, first_doubled: int) -> Column:
    """Luhn sum; from the right, digits at odd (0) or even (1) places are doubled."""

    def add(total: Column, c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(F.pmod(i + first_doubled, F.lit(2)) == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    turned = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    return F.aggregate(turned, F.lit(0), lambda t, x: add(t, x["c"], x["i"]))


def luhn_valid(digits: Column) -> Column:
    return F.pmod(_luhn_sum(digits, 0), F.lit(10)) == 0


def card(value: Column, key: str) -> Column:
    def of(digits: Column) -> Column:
        body = permute_digits(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")
        full = let(body, lambda b: F.concat(b, F.pmod(10 - F.pmod(_luhn_sum(b, 1), F.lit(10)), F.lit(10)).cast("string")))
        return F.when(luhn_valid(digits) & digits.rlike("[1-9]"), let(full, lambda f: _put(value, f))).otherwise(value)

    return let(_only_digits(value), of)


def phone(value: Column, key: str) -> Column:
    """The country code and a leading zero in its place stay; the national number is permuted by its digits alone, so formats don't part equal numbers."""
    code = F.regexp_extract(value, r"^0(?=\d[ .-])|^\+\d{2,3}[ .-]?\(0\)|^\+1(?=\D|\d{10}$)|^\+\d{1,3}(?=[ .(-])|^\+", 0)
    rest = F.substr(value, F.length(code) + 1)
    return let(_only_digits(rest), lambda d: F.when(F.length(d).between(7, 14), let(permute_digits(d, key, "phone"), lambda p: F.concat(code, _put(rest, p)))).otherwise(value))


def ssn(value: Column, key: str) -> Column:
    """Permuted again until the result is a valid number, which keeps it a permutation of the valid ones."""
    good = lambda d: ~d.rlike("^(000|666|9)|^...00|0000$")
    walk = lambda d: F.aggregate(F.sequence(F.lit(1), F.lit(64)), permute_digits(d, key, "ssn"), lambda x, _: F.when(good(x), x).otherwise(permute_digits(x, key, "ssn")))
    return let(_only_digits(value), lambda d: F.when(good(d), let(walk(d), lambda p: _put(value, p))).otherwise(value))


def ip(value: Column, key: str) -> Column:
    def of(octets: Column) -> Column:
        at = lambda i: F.get(octets, F.lit(i))
        new = permute_pair(at(0) * 256 + at(1), at(2) * 256 + at(3), 65536, key, "ip")
        text = let(new, lambda p: F.concat_ws(".", *[x.cast("string") for x in ((p["a"] / 256).cast("int"), F.pmod(p["a"], F.lit(256)), (p["b"] / 256).cast("int"), F.pmod(p["b"], F.lit(256)))]))
        return F.when(F.forall(octets, lambda o: o <= 255), text).otherwise(value)

    return let(F.transform(F.split(value, r"\."), lambda o: o.cast("int")), of)


def _new_day(day: Column, key: str) -> Column:
    """The day's pseudonym, null for days that are null or out of range."""
    n = F.datediff(day, F.lit("1900-01-01").cast("date"))
    new = let(permute_pair((n / DATE_SIDE).cast("int"), F.pmod(n, F.lit(DATE_SIDE)), DATE_SIDE, key, "date"), lambda p: F.date_add(F.lit("1900-01-01").cast("date"), (p["a"] * DATE_SIDE + p["b"]).cast("int")))
    return F.when(n.between(0, DATE_SIDE * DATE_SIDE - 1), new)


def written(value: Column, key: str) -> Column:
    """A date with its month's name, day first or month first; it has the pseudonym of the same day in digits."""

    def of(parts: Column) -> Column:
        at = lambda i: F.get(parts, F.lit(i))
        day_first = at(0).rlike("^[0-9]")
        name, day = F.when(day_first, at(1)).otherwise(at(0)), F.when(day_first, at(0)).otherwise(at(1))
        names = F.array(*[F.lit(m) for m in MONTHS])
        found = F.try_to_date(F.concat_ws("-", at(2), F.lpad(F.array_position(names, name).cast("string"), 2, "0"), F.lpad(day, 2, "0")))
        shown = lambda d: F.when(day_first, F.concat_ws(" ", F.dayofmonth(d).cast("string"), F.get(names, F.month(d) - 1), F.year(d).cast("string"))).otherwise(F.concat(F.get(names, F.month(d) - 1), F.lit(" "), F.dayofmonth(d).cast("string"), F.lit(", "), F.year(d).cast("string")))
        return let(_new_day(found, key), lambda d: F.when(d.isNotNull(), shown(d)).otherwise(value))

    return let(F.split(value, "[, ]+"), of)


def date(value: Column, key: str) -> Column:
    """Year first, or year last with the day first where that is a date, else the month first; separators and widths stay."""

    def of(parts: Column) -> Column:
        at = lambda i: F.get(parts, F.lit(i))
        year_first = F.length(at(0)) == 4
        make = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))
        day_first = make(at(2), at(1), at(0))
        found = F.when(year_first, make(at(0), at(1), at(2))).otherwise(F.coalesce(day_first, make(at(2), at(0), at(1))))

        def shown(x: Column) -> Column:
            new = _new_day(x["date"], key)
            pattern = F.when(year_first, "yyyyMMdd").when(x["day_first"], "ddMMyyyy").otherwise("MMddyyyy")
            digits = F.when(pattern == "yyyyMMdd", F.date_format(new, "yyyyMMdd")).when(pattern == "ddMMyyyy", F.date_format(new, "ddMMyyyy")).otherwise(F.date_format(new, "MMddyyyy"))
            wide = F.when(year_first, F.concat(at(0), F.regexp_extract(value, "[-/.]", 0), F.lit("00"), F.regexp_extract(value, "[-/.]", 0), F.lit("00"))).otherwise(F.concat(F.lit("00"), F.regexp_extract(value, "[-/.]", 0), F.lit("00"), F.regexp_extract(value, "[-/.]", 0), at(2)))
            return F.when(new.isNotNull(), _put(wide, digits)).otherwise(value)

        return let(F.struct(found.alias("date"), day_first.isNotNull().alias("day_first")), shown)

    return let(F.split(value, "[-/.]"), of)


def _mod97(text: Column) -> Column:
    """Of the text with letters as 10 to 35."""
    step = lambda r, c: F.when(c.rlike("[0-9]"), F.pmod(r * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(r * 100 + F.ascii(c) - 55, F.lit(97)))
    return F.aggregate(F.split(text, ""), F.lit(0), step)


def iban(value: Column, key: str) -> Column:
    def of(bare: Column) -> Column:
        head, rest = F.substring(bare, 1, 2), F.substr(bare, F.lit(5))
        fresh = let(_only_digits(rest), lambda d: F.when(F.length(d) >= 2, _put(rest, permute_digits(d, key, "iban"))).otherwise(rest))
        text = let(fresh, lambda r: let(F.lpad((98 - _mod97(F.concat(r, head, F.lit("00")))).cast("string"), 2, "0"), lambda check: _put(value, F.concat(check, _only_digits(r)))))
        return F.when((_mod97(F.concat(rest, F.substring(bare, 1, 4))) == 1) & (F.length(bare) >= 15), text).otherwise(value)

    return let(F.regexp_replace(value, " ", ""), of)


def email(value: Column, key: str) -> Column:
    h = _digest(key, F.lit("email"), F.lower(value))
    return F.concat(F.lit("u"), F.substring(h, 1, 12), F.lit("@"), F.lit("d"), F.substring(_digest(key, F.lit("domain"), F.lower(F.substring_index(value, "@", -1))), 1, 8), F.lit(".invalid"))


def secret(value: Column, key: str) -> Column:
    """Of the same length, in hex digits or capitals; the name, = or : and the quote before it stay, as do sk-, ghp_ and the like. Hex digits are one value in either case."""
    name = F.regexp_extract(value, f"^(?:[A-Za-z_-]+{_SET}|(?:sk|pk|rk)-|gh[opsu]_)", 0)
    bare = F.substr(value, F.length(name) + 1)
    hexes = bare.rlike("^[0-9A-Fa-f]{40}$")
    h = _digest(key, F.lit("secret"), F.when(hexes, F.lower(bare)).otherwise(bare))
    access = F.concat(F.lit("AKIA"), F.translate(F.substring(h, 1, 16), "0123456789abcdef", "ABCDEFGHIJ234567"))
    made = let(F.when(hexes & (bare == F.upper(bare)) & bare.rlike("[A-F]"), F.upper(h)).otherwise(h), lambda x: F.rpad(x, F.length(bare), x))
    return F.when(value.rlike("^AKIA[A-Z0-9]{16}$"), access).otherwise(F.concat(name, made))


def _kind(value: Column) -> Column:
    """The first kind whose whole pattern the match has; later ones are numbers."""
    whole = lambda p: value.rlike(f"^(?:{p})$")
    return (
        F.when(value.contains("@") & whole(_EMAIL), "email").when(whole(_SECRET), "secret").when(whole(_IBAN), "iban").when(whole(_IP), "ip")
        .when(whole(_DATE), "date").when(whole(_WRITTEN), "written").when(whole(_SSN), "ssn").when(whole(_PHONE), "phone").otherwise("card")
    )


def pseudonymise(docs: DataFrame, text_col: str = "text", *, key: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """docs with private values in text_col replaced, and _found: the count of each kind that was.

    Whoever has the key can undo the permutations; keep it, and event logs, which hold
    the plan with it, as safe as the texts. A null text stays null, an empty one empty.
    A value that is not valid (a number without its check digit, an octet over 255, a
    day that no month has or out of 1900 to 2099) stays as it is. Repeated rows change
    alike; other columns stay, of which none may be called _found (ValueError).
    """
    refuse(docs, "_found")
    if not key:
        raise ValueError("pseudonyms need a key")
    make = {"email": email, "iban": iban, "ip": ip, "date": date, "ssn": ssn, "phone": phone, "card": card, "secret": secret}
    text = F.col(text_col)

    def one(value: Column, kind: Column) -> Column:
        out = F.when(kind == "written", written(value, key)) if "date" in kinds else F.when(F.lit(False), value)
        for k in kinds:
            out = out.when(kind == k, make[k](value, key))
        return out.otherwise(value)

    found = F.transform(F.regexp_extract_all(text, F.lit(_CANDIDATE), F.lit(0)), lambda m: let(_kind(m), lambda k: F.struct(m.alias("old"), F.when(k == "written", "date").otherwise(k).alias("kind"), one(m, k).alias("new"))))
    gaps = F.split(text, _CANDIDATE, -1)

    def changed(f: Column) -> Column:
        joined = let(gaps, lambda g: F.concat(F.array_join(F.zip_with(F.slice(g, 1, F.size(f)), f, lambda a, b: F.concat(a, b["new"])), ""), F.element_at(g, -1)))
        count = lambda kind: F.size(F.filter(f, lambda x: (x["kind"] == kind) & (x["new"] != x["old"]))).cast("long")
        counts = F.struct(*[count(k).alias(k) for k in kinds])
        return F.struct(joined.alias("text"), counts.alias("found"))

    none = F.struct(text.cast("string").alias("text"), F.struct(*[F.lit(0).cast("long").alias(k) for k in kinds]).alias("found"))
    result = F.when(text.rlike("[0-9@=:]|AKIA|sk-|pk-|rk-|gh[opsu]_"), let(found, lambda f: F.when(F.size(f) > 0, changed(f)).otherwise(none))).otherwise(none)
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), result.alias("_made"))
    names = [F.col("_made.text").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns]
    return out.select(*names, F.col("_made.found").alias("_found"))
