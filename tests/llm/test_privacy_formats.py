"""Formats of private values that a text must not keep, each alone and beside other numbers."""

import hashlib
import os
import re
import subprocess
import sys
from datetime import date, timedelta

import pytest
import regex

from odflow.llm import privacy

PHONES = ["+33 1 23 45 67 89", "+33 6 12 34 56 78", "06 12 34 56 78", "06.12.34.56.78", "+33 (0)6 12 34 56 78", "+49 30 12 34 56 78", "+32 2 123 45 67", "+36 1 234 5678", "+41 44 668 18 00", "+44 20 7946 0958"]
IBANS = ["ES91 2100 0418 4502 0005 1332", "ES9121000418450200051332", "AT61 1904 3002 3457 3201", "BE68 5390 0754 7034", "GB82 WEST 1234 5698 7654 32", "FR14 2004 1010 0505 0001 3M02 606", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947"]
SECRETS = [("password: ", "hunter2x", ""), ('password = "', "hunter2x", '"'), ("api_key = ", "k9Zq77", ""), ('{"token": "', "k9Zq77", '"}'), ("pwd=", "k9Zq77", ""), ("sha ", "24BE64439E3E49CF46B2D7C90F3602A3D0B907FF", ""), ("sha ", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "")]


KEY = "a key of the tests"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


def number(*parts):
    return int(hashlib.sha256("|".join([KEY, *map(str, parts)]).encode()).hexdigest()[:15], 16)


def slow_digits(digits, tweak):
    a, b = digits[: len(digits) // 2], digits[len(digits) // 2 :]
    for i in range(10):
        a, b = b, str((int(a) + number(tweak, i, b)) % 10 ** len(a)).zfill(len(a))
    return a + b


def slow_pair(a, b, side, tweak):
    for i in range(10):
        a, b = b, (a + number(tweak, i, b)) % side
    return a, b


def put(pattern, digits):
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in pattern)


def luhn_check(body):
    for d in "0123456789":
        if sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(body + d)))) % 10 == 0:
            return d


def slow_day(y, m, d):
    try:
        n = (date(int(y), int(m), int(d)) - date(1900, 1, 1)).days
    except ValueError:
        return None
    a, b = slow_pair(n // 270, n % 270, 270, "date") if 0 <= n < 72900 else (None, None)
    return a if a is None else date(1900, 1, 1) + timedelta(a * 270 + b)


def slow_value(kind, v):
    digits = re.sub("[^0-9]", "", v)
    if kind == "card":
        new = slow_digits(digits[:-1], "card")
        return put(v, new + luhn_check(new)) if luhn_check(digits[:-1]) == digits[-1] and digits.strip("0") else v
    if kind == "ssn":
        bad = lambda x: x[:3] in ("000", "666") or x[0] == "9" or x[3:5] == "00" or x[5:] == "0000"
        new = digits
        while not bad(digits) and (new == digits or bad(new)):
            new = slow_digits(new, "ssn")
        return put(v, new)
    if kind == "ip":
        o = list(map(int, v.split(".")))
        if max(o) > 255:
            return v
        a, b = slow_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, "ip")
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if kind == "date":
        p = re.split("[-/.]", v)
        if len(p[0]) == 4:
            new = slow_day(*p)
            return v if new is None else re.sub(r"^\d+(\D)\d+(\D)\d+$", rf"{new:%Y}\g<1>{new:%m}\g<1>{new:%d}", v)
        try:
            date(int(p[2]), int(p[1]), int(p[0]))
            new, form = slow_day(p[2], p[1], p[0]), "%d {0}%m {0}%Y"
        except ValueError:
            new, form = slow_day(p[2], p[0], p[1]), "%m {0}%d {0}%Y"
        sep = re.search("[-/.]", v)[0]
        return v if new is None else new.strftime(form.replace(" {0}", sep))
    if kind == "iban":
        bare = v.replace(" ", "")
        if len(bare) < 15 or int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 != 1:
            return v
        own = re.sub("[^0-9]", "", bare[4:])
        rest = put(bare[4:], slow_digits(own, "iban"))
        check = 98 - int("".join(str(int(c, 36)) for c in rest + bare[:2] + "00")) % 97
        return put(v, f"{check:02d}" + re.sub("[^0-9]", "", rest))
    raise ValueError(kind)


def sure_kind(v):
    """Of values whose kind their form alone tells."""
    forms = {"ip": r"\d{1,3}(\.\d{1,3}){3}", "date": r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4}", "ssn": r"\d{3}-\d{2}-\d{4}", "iban": r"[A-Z]{2}\d{2} ?[A-Z0-9].*", "card": r"\d{13,19}|\d{4}([ -]\d{4}){3}"}
    return next((k for k, f in forms.items() if re.fullmatch(f, v)), None)


def slow_text(text, new_of):
    """The text with each candidate of a sure kind replaced, those of others as the operator has them, in order."""
    out, at = [], 0
    for m in regex.finditer(privacy._CANDIDATE, text, flags=regex.ASCII):
        kind = sure_kind(m[0])
        out += [text[at : m.start()], slow_value(kind, m[0]) if kind else new_of(m[0])]
        at = m.end()
    return "".join([*out, text[at:]])


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_whole_texts_against_an_independent_cipher(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["4539578763621486, 16.120.181.235 / 2024-02-29; 31/12/1999 12/31/1999, 1-2-2003 | 123-45-6789 DE89 3704 0044 0532 0130 00 4111-1111-1111-1111"]
    others = sorted({m[0] for t in texts for m in regex.finditer(privacy._CANDIDATE, t, flags=regex.ASCII) if not sure_kind(m[0])})
    new_of = dict(zip(others, (t for t, _ in new_texts(spark, others)), strict=True)) if others else {}
    seen = 0
    for text, (new, _) in zip(texts, new_texts(spark, texts), strict=True):
        assert new == slow_text(text, new_of.__getitem__)
        seen += new != text
    assert seen > 10


def test_dates_with_names(spark):
    (one, _), (two, _), (three, found) = new_texts(spark, ["2024-03-12", "on 12 March 2024.", "March 12, 2024"])
    day = slow_day(2024, 3, 12)
    assert one == f"{day:%Y-%m-%d}" and two == f"on {day.day} {day:%B} {day.year}." and three == f"{day:%B} {day.day}, {day.year}" and found["date"] == 1
    assert new_texts(spark, ["31 February 2024"])[0][0] == "31 February 2024"


def test_long_secrets_and_prefixes(spark):
    texts = ["token=" + "k9" * 10_000, "sk-" + "a1B2" * 8, "ghp_" + "a1B2" * 9]
    for old, (new, found) in zip(texts, new_texts(spark, texts), strict=True):
        assert len(new) == len(old) and new != old and new[:3] == old[:3] and found["secret"] == 1


def test_a_key_is_needed(spark):
    df = spark.createDataFrame([("x",)], "text string")
    with pytest.raises(TypeError):
        privacy.pseudonymise(df)
    with pytest.raises(ValueError, match="key"):
        privacy.pseudonymise(df, key="")


def test_no_text_overflows_the_stack_of_a_fresh_jvm():
    code = """
from pyspark.sql import SparkSession
from odflow.llm.privacy import pseudonymise
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
texts = ["a@b" + ".c" * 20000, "a" * 20000 + "@b.c", "DE89" + " 3704" * 20000, "1." * 20000, "+33" + " 12" * 20000, "a@" + "b-" * 20000, "token=" + "x" * 200000, "1-" * 20000]
rows = pseudonymise(spark.createDataFrame([(t,) for t in texts], "text string"), key="k").collect()
assert len(rows) == len(texts) and rows[0].text.endswith(".invalid"), rows
"""
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, env=os.environ | {"PYTHONPATH": REPO}, timeout=300)


def new_texts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return [(r.text, r._found.asDict()) for r in privacy.pseudonymise(df, key=KEY).orderBy("id").collect()]


@pytest.mark.parametrize("after", ["", " ok", " 2024", " 3 items", " 20240115"])
def test_numbers(spark, after):
    for kind, values in (("phone", PHONES), ("iban", IBANS)):
        for value, (text, found) in zip(values, new_texts(spark, [f"see {v}{after}" for v in values]), strict=True):
            assert found[kind] == 1 and sum(found.values()) == 1, (value, text)
            assert value not in text and len(text) == len(f"see {value}{after}")
            if kind == "iban":
                own = text[4 : 4 + len(value)].replace(" ", "")
                assert own[:2] == value[:2] and int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1 and text.endswith(after)


def test_formats_do_not_part_equal_numbers(spark):
    one, two, three = (re.sub(r"\D", "", t) for t, _ in new_texts(spark, ["+33 6 12 34 56 78", "06 12 34 56 78", "+33 (0)6 12 34 56 78"]))
    assert one[2:] == two[1:] == three[3:] != "612345678"


def test_secrets(spark):
    got = new_texts(spark, [a + b + c for a, b, c in SECRETS])
    for (a, b, c), (text, found) in zip(SECRETS, got, strict=True):
        assert found["secret"] == 1 and b not in text and text.startswith(a) and text.endswith(c) and len(text) == len(a + b + c), text
    assert got[0][0][-8:] == got[1][0][-9:-1] and got[-2][0] == "sha " + got[-1][0][4:].upper()


def test_public(spark):
    public = ["the token ring", "a secret, kept", "12 34 56 78", "at 06 12", "1.2.3.4.5", "+33", "NO93 8601 1117 948", "24be64439e3e49cf46b2d7c90f3602a3d0b907f"]
    assert [t for t, _ in new_texts(spark, public)] == public
