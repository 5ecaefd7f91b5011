"""Format-preserving pseudonyms by keyed Feistel permutations (DataFrame functions only).

Found and validated: e-mail addresses, IPv4 addresses (octets up to 255), payment
card numbers (13 to 19 digits, Luhn; in a usual layout also beside other numbers), US social security numbers (area, group and
serial in range), bank accounts (IBAN, checked modulo 97), telephone numbers (10 to 15
digits with separators or a plus) and dates (real days of 1900 to 2099: ISO,
month/day/year, day/month/year where only that is a day, day.month.year). Each value is
permuted within its format by a Feistel network whose round function is a keyed SHA-256:

* cards: all digits but the last are permuted, the last is the new Luhn digit;
* IBANs: the digits after the check digits are permuted, letters stay, the check
  digits are computed anew; telephone numbers and cards are not looked for inside;
* telephone and social security numbers: the digits after the country code or
  the nine digits; separators stay;
* IPv4: the 32-bit number; dates: the day in the same notation, where padding and
  what can stand unpadded belong to the notation: with two digits for month and day
  (month first, ISO, dots) the number among 73 000 days from 1900-01-01; where one has
  a single digit, or a slash date begins with more than 12, days up to the 28th, days
  after it and 29 February are permuted each among their like (so this much of a date
  can be seen);
* e-mail: letters and digits of the local part within their class, the domain stays.

A permutation is a bijection, so equal values stay linked across documents and
different values of one format stay different; who has the key can invert it. What
fails its validation is left alone.

Edge cases: other columns are ignored, whatever their names; null text gives null; text without matches is returned unchanged; a
null id is kept; repeated rows give equal results; whole texts of any length are
read by the regular expressions without backtracking over more than one token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab.llm._common import table

ROUNDS = 8
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
IPV4 = r"(?<![\d.])\d{1,3}+(?:\.\d{1,3}+){3}(?!\.?\d)"
DATE = r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![/-]?\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?!-?\d)"
CARD = r"(?<!\d)(?<!\d[ -])\d(?:[ -]?\d){12,18}(?![ -]?\d)"
#: Countries whose IBANs are looked for (fixed values).
IBAN_COUNTRIES = "AD|AE|AL|AT|AZ|BA|BE|BG|BH|BR|BY|CH|CR|CY|CZ|DE|DK|DO|EE|EG|ES|FI|FO|FR|GB|GE|GI|GL|GR|GT|HR|HU|IE|IL|IQ|IS|IT|JO|KW|KZ|LB|LC|LI|LT|LU|LV|LY|MC|MD|ME|MK|MR|MT|MU|NL|NO|PK|PL|PS|PT|QA|RO|RS|SA|SC|SE|SI|SK|SM|ST|SV|TL|TN|TR|UA|VA|VG|XK"
IBAN = rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}\d{{2}})(?:{IBAN_COUNTRIES})\d{{2}}(?:[A-Z0-9]{{11,30}}|(?: [A-Z0-9]{{4}}){{2,7}}(?: [A-Z0-9]{{1,3}})?)(?![A-Za-z0-9])"
#: Usual layouts of a card, found at any group border of a longer run: unbroken, 4-4-4-4, 4-6-5, 4-6-4, 4-4-4-4-(1 to 3).
LAYOUTS = (r"\d{13,19}", r"\d{4}(?:[ -]\d{4}){3}", r"\d{4}[ -]\d{6}[ -]\d{4,5}", r"\d{4}(?:[ -]\d{4}){3}[ -]\d{1,3}")
#: What may not stand before a card, behind the look at the card itself (which fails at once nearly everywhere), and what may not follow.
_AT = rf"(?<!\d{{3}}-\d{{2}}-)(?<!\b(?:{IBAN_COUNTRIES})\d{{2}}(?: [A-Z0-9]{{4}}){{0,6}} )"
_END = r"(?!\d)(?![A-Za-z0-9._%+-]{0,64}@)"
#: Noncharacters of Unicode around the cards that were found beside other numbers.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"
MARKED = rf"{_OPEN}\d[\d -]{{11,24}}\d{_CLOSE}"
#: Telephones by their plan: a country code behind a plus, an area code in brackets, a trunk 0, or 3-3-4 with hyphens or dots.
#: Groups of figures between spaces alone aren't telephones.
_NATIONAL = r"\d{3,4}[ .-]\d{3,4}"
PHONE = rf"(?<![\w.+])(?:\+\d{{1,3}}[ .-]?(?:\(\d{{2,4}}\) ?|\d{{2,4}}[ .-]){_NATIONAL}|\(\d{{2,4}}\) ?{_NATIONAL}|0\d{{1,3}}[ .-]{_NATIONAL}|(?:1-)?[2-9]\d{{2}}-\d{{3}}-\d{{4}}|(?:1\.)?[2-9]\d{{2}}\.\d{{3}}\.\d{{4}})(?![\w-]|[.]\d)|(?<![\w.+])\+\d{{10,15}}(?!\d)"
KINDS = {"marked": MARKED, "iban": IBAN, "email": EMAIL, "ipv4": IPV4, "date": DATE, "ssn": SSN, "card": CARD, "phone": PHONE}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: What every kind contains: an @, or two digits with at least five digits or separators between.
MAY = r"@|[0-9][0-9 ./()-]{5,}[0-9]"
FOUND = "array<struct<kind:string,original:string,pseudonym:string>>"
_DAYS = (17, 4297)  # 73 049 days, all of 1900 to 2099


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is read."""
    return F.transform(F.array(value), body)[0]


def _rounds(n: int, back: bool) -> Column:
    return F.array(*(F.lit(i) for i in (range(n)[::-1] if back else range(n))))


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, tweak: str | Column, back: bool = False) -> Column:
    """A keyed permutation of Z_a x Z_b as a struct (l, r); ``back`` inverts it.

    A round adds 52 bits of the keyed hash of one half to the other.
    """
    sign = -1 if back else 1
    head = F.lit(f"{key}|{tweak}|") if isinstance(tweak, str) else F.concat(F.lit(f"{key}|"), tweak, F.lit("|"))

    def step(p: Column, i: Column) -> Column:
        even = i % 2 == 0
        # The modulus enters the hash, so lengths don't share a permutation.
        text = F.concat(head, F.concat_ws("/", F.concat_ws("|", i, F.when(even, p["r"]).otherwise(p["l"])), p["a"], p["b"]))
        more = sign * F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("bigint")

        def moved(h: Column) -> Column:
            new = F.struct(F.when(even, F.pmod(p["l"] + h, p["a"])).otherwise(p["l"]).alias("l"), F.when(even, p["r"]).otherwise(F.pmod(p["r"] + h, p["b"])).alias("r"), p["a"].alias("a"), p["b"].alias("b"))
            return new

        return _let(more, moved)

    return F.aggregate(_rounds(ROUNDS, back), F.struct(left.alias("l"), right.alias("r"), a.alias("a"), b.alias("b")), step)


def _pow10(n: Column) -> Column:
    return F.concat(F.lit("1"), F.repeat(F.lit("0"), n)).cast("bigint")


def permute_digits(digits: Column, key: str, tweak: str, back: bool = False) -> Column:
    """A string of 2 to 30 digits to another of the same length."""

    def body(d: Column) -> Column:
        n = F.length(d)
        u = F.floor(n / 2).cast("int")
        pair = feistel(F.substr(d, F.lit(1), u).cast("bigint"), F.substr(d, u + 1, n - u).cast("bigint"), _pow10(u), _pow10(n - u), key, tweak, back)
        return _let(pair, lambda p: F.concat(F.lpad(p["l"].cast("string"), u, F.lit("0")), F.lpad(p["r"].cast("string"), n - u, F.lit("0"))))

    return _let(digits, body)


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum when the last digit counts once."""
    reversed_digits = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    value = F.transform(reversed_digits, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(value, F.lit(0), lambda s, x: s + x)


def _into_format(original: Column, digits: Column) -> Column:
    """The digits of ``original`` replaced one by one."""
    chars = F.filter(F.split(original, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))
    is_digit = lambda c: c.between("0", "9")

    def filled(d: Column) -> Column:
        step = lambda a, c: F.struct(F.concat(a["s"], F.when(is_digit(c), F.substr(d, a["i"], F.lit(1))).otherwise(c)).alias("s"), (a["i"] + is_digit(c).cast("int")).alias("i"))
        return F.aggregate(chars, start, step)["s"]

    return _let(digits, filled)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _card(value: Column, key: str, back: bool) -> Column:

    def new(d: Column) -> Column:
        check = lambda body: F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string")
        body = permute_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card", back)
        return F.when(luhn_sum(d) % 10 == 0, _into_format(value, _let(body, lambda b: F.concat(b, check(b))))).otherwise(value)

    return _let(_digits(value), new)


def _cards_marked(text: Column) -> Column:
    """``text`` with marks around each valid card in a usual layout, whatever numbers stand beside it; of two that overlap the first found counts."""

    def marked(cards: Column) -> Column:
        step = lambda s, c: F.regexp_replace(s, F.concat(F.lit(rf"(?<![\d{_OPEN}])(?="), c, F.lit(rf"){_AT}"), c, F.lit(rf"(?!{_CLOSE}){_END}")), F.concat(F.lit(_OPEN), c, F.lit(_CLOSE)))
        return F.aggregate(cards, text, step)

    found = F.concat(*(F.regexp_extract_all(text, F.lit(rf"(?<!\d)(?=({p}){_END}){_AT}"), F.lit(1)) for p in LAYOUTS))
    valid = F.filter(F.array_distinct(found), lambda c: luhn_sum(_digits(c)) % 10 == 0)
    return F.when(text.rlike(r"\d(?:[ -]?\d){12}"), _let(valid, marked)).otherwise(text)


def _phone(value: Column, key: str, back: bool) -> Column:
    """The last ten digits (all of nine or less) are permuted, what stands before is the country code."""

    def new(d: Column) -> Column:
        n = F.least(F.length(d), F.lit(10))
        head = F.substr(d, F.lit(1), F.length(d) - n)
        tail = permute_digits(F.substr(d, F.length(d) - n + 1, n), key, "phone", back)
        return F.when((F.length(d) >= 10) & (F.length(d) <= 15), _into_format(value, F.concat(head, tail))).otherwise(value)

    return _let(_digits(value), new)


def _ssn(value: Column, key: str, back: bool) -> Column:
    """Area 1..899 without 666 has 898 values; group 1..99; serial 1..9999."""
    area, group, serial = (F.split(value, "-")[i].cast("bigint") for i in range(3))
    fine = area.between(1, 899) & (area != 666) & (group >= 1) & (serial >= 1)
    packed = feistel(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898).cast("bigint"), F.lit(99 * 9999).cast("bigint"), key, "ssn", back)

    def text(p: Column) -> Column:
        new_area = p["l"] + F.when(p["l"] >= 665, 2).otherwise(1)
        return F.concat_ws("-", *(F.lpad(x.cast("string"), n, "0") for x, n in ((new_area, 3), (F.floor(p["r"] / 9999) + 1, 2), (p["r"] % 9999 + 1, 4))))

    return F.when(fine, _let(packed, text)).otherwise(value)


def _ipv4(value: Column, key: str, back: bool) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda o: o.cast("bigint"))
    plain = ~value.rlike(r"(?:^|\.)0\d")
    out = feistel(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], F.lit(65536).cast("bigint"), F.lit(65536).cast("bigint"), key, "ipv4", back)
    text = _let(out, lambda p: F.concat_ws(".", F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256))
    return F.when(plain & F.forall(octets, lambda o: o <= 255), text).otherwise(value)


#: (month, day) of the days after the 28th but 29 February, in order; the first 21 have a month of one digit.
_LATE = [(m, d) for m in range(1, 13) for d in (29, 30, 31) if m != 2 and (d < 31 or m in (1, 3, 5, 7, 8, 10, 12))]


def _date(value: Column, key: str, back: bool) -> Column:
    def read(parts: Column) -> Column:
        first, second, third = (F.get(parts, F.lit(i)) for i in range(3))
        # Slashes are month/day/year, or day/month/year where they can't be; dots day.month.year.
        order = F.when(value.contains("-"), F.lit("-")).when(value.contains("."), F.lit(".")).when((first.cast("int") > 12) & (second.cast("int") <= 12), F.lit("s")).otherwise(F.lit("/"))

        def named(o: Column) -> Column:
            return F.struct(o.alias("order"), F.when(o == "-", first).otherwise(third).alias("y"), F.when(o == "/", first).otherwise(second).alias("m"), F.when(o == "-", third).when(o == "/", second).otherwise(first).alias("d"))

        return _let(order, named)

    def checked(v: Column) -> Column:
        day = F.try_to_date(F.concat_ws("-", F.lpad(v["y"], 4, "0"), F.lpad(v["m"], 2, "0"), F.lpad(v["d"], 2, "0")), "yyyy-MM-dd")
        two = (F.length(v["m"]) == 2) & (F.length(v["d"]) == 2) & (v["order"] != "s")
        kind = F.when(two, F.lit("any")).when(F.dayofmonth(day) <= 28, F.lit("early")).when(F.month(day) != 2, F.lit("late")).otherwise(F.lit("leap"))
        least = F.when(v["order"] == "s", 13).otherwise(1)
        places = F.when(F.length(v["d"]) == 1, 9).otherwise(29 - least)  # days of a month that the notation can write, up to the 28th
        months = F.when(F.length(v["m"]) == 1, 9).otherwise(12)
        fields = {"order": v["order"], "m": F.length(v["m"]), "d": F.length(v["d"]), "kind": kind, "year": F.year(day), "month": F.month(day), "day": F.dayofmonth(day), "least": least, "places": places, "months": months, "number": F.datediff(day, F.lit("1900-01-01").cast("date"))}
        return F.struct(*(c.alias(n) for n, c in fields.items()))

    a, b = _DAYS
    table = F.array(*(F.lit(100 * x + z) for x, z in _LATE))

    def pair(v: Column) -> Column:
        """The two numbers that are permuted and their moduli."""
        at = F.floor((v["year"] - 1904) / 4)  # of 49 leap days
        choice = lambda every, early, late, leap: F.when(v["kind"] == "any", every).when(v["kind"] == "early", early).when(v["kind"] == "late", late).otherwise(leap).cast("bigint")
        left = choice(F.floor(v["number"] / b), v["year"] - 1900, v["year"] - 1900, F.floor(at / 7))
        right = choice(v["number"] % b, (v["month"] - 1) * v["places"] + v["day"] - v["least"], F.array_position(table, 100 * v["month"] + v["day"]) - 1, at % 7)
        return F.struct(left.alias("l"), right.alias("r"), choice(F.lit(a), F.lit(200), F.lit(200), F.lit(7)).alias("a"), choice(F.lit(b), v["months"] * v["places"], F.when(v["months"] == 9, 21).otherwise(len(_LATE)), F.lit(7)).alias("b"))

    def day_of(v: Column, p: Column) -> Column:
        """Year, month and day of a permuted pair as yyyymmdd."""
        every = F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), (p["l"] * b + p["r"]).cast("int")), "yyyyMMdd").cast("bigint")
        early = (p["l"] + 1900) * 10000 + (F.floor(p["r"] / v["places"]) + 1) * 100 + p["r"] % v["places"] + v["least"]
        late = (p["l"] + 1900) * 10000 + F.get(table, p["r"].cast("int"))
        leap = (1904 + 4 * (p["l"] * 7 + p["r"])) * 10000 + 229
        return F.when(v["kind"] == "any", every).when(v["kind"] == "early", early).when(v["kind"] == "late", late).otherwise(leap)

    def written(v: Column, n: Column) -> Column:
        year = F.floor(n / 10000).cast("string")
        month, day = F.lpad((F.floor(n / 100) % 100).cast("string"), v["m"], F.lit("0")), F.lpad((n % 100).cast("string"), v["d"], F.lit("0"))
        return F.when(v["order"] == "-", F.concat_ws("-", year, month, day)).when(v["order"] == "/", F.concat_ws("/", month, day, year)).when(v["order"] == "s", F.concat_ws("/", day, month, year)).otherwise(F.concat_ws(".", day, month, year))

    def new(v: Column) -> Column:
        tweak = F.concat(F.lit("date"), v["kind"], v["order"], v["m"], v["d"])
        out = _let(pair(v), lambda p: feistel(p["l"], p["r"], p["a"], p["b"], key, tweak, back))
        text = _let(_let(out, lambda p: day_of(v, p)), lambda n: written(v, n))
        return F.when(v["year"].between(1900, 2099) & ((v["kind"] != "any") | v["number"].between(0, a * b - 1)), text).otherwise(value)

    return _let(_let(F.split(value, "[/.-]"), lambda parts: _let(read(parts), checked)), new)


def _iban(value: Column, key: str, back: bool) -> Column:
    def mod97(text: Column) -> Column:
        """Letters count as 10 to 35."""
        return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda s, c: F.when(c.between("0", "9"), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97))

    def check(bare: Column) -> Column:
        return F.lpad((98 - mod97(F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 2), F.lit("00")))).cast("string"), 2, "0")

    def new(bare: Column) -> Column:
        digits = permute_digits(_digits(F.substring(bare, 5, 40)), key, "iban", back)
        body = _let(_into_format(F.substring(value, 5, 60), digits), lambda b: F.concat(F.substring(value, 1, 2), check(F.concat(F.substring(value, 1, 2), F.lit("00"), F.replace(b, F.lit(" "), F.lit("")))), b))
        fine = (check(bare) == F.substring(bare, 3, 2)) & (F.length(_digits(F.substring(bare, 5, 40))) >= 2)
        return F.when(fine, body).otherwise(value)

    return _let(F.replace(value, F.lit(" "), F.lit("")), new)


def _email(value: Column, key: str, back: bool) -> Column:
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    chars = F.filter(F.split(local, ""), lambda c: c != "")
    n = F.size(chars)
    u = F.floor(n / 2).cast("int")
    sign = -1 if back else 1

    def shifted(part: Column, by: Column) -> Column:
        """Each letter or digit moves on within its class by a byte of the hash (64 bytes of two hashes)."""

        def one(c: Column, i: Column, h: Column) -> Column:
            s = sign * F.conv(F.substr(h, (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
            turn = lambda base, size: F.char((F.lit(base) + F.pmod(F.ascii(c) - base + s, F.lit(size))).cast("int"))
            return F.when(c.between("0", "9"), turn(48, 10)).when(c.between("a", "z"), turn(97, 26)).when(c.between("A", "Z"), turn(65, 26)).otherwise(c)

        return _let(by, lambda h: F.transform(part, lambda c, i: one(c, i, h)))

    def stream(i: Column, other: Column) -> Column:
        return F.concat(*(F.sha2(F.concat_ws("|", F.lit(f"{key}|email"), i, F.lit(part), F.array_join(other, "")), 256) for part in "01"))

    def step(p: Column, i: Column) -> Column:
        even = i % 2 == 0
        halves = F.struct(F.when(even, p["l"]).otherwise(p["r"]).alias("to"), F.when(even, p["r"]).otherwise(p["l"]).alias("by"))
        moved = _let(halves, lambda h: shifted(h["to"], stream(i, h["by"])))
        return _let(moved, lambda m: F.struct(F.when(even, m).otherwise(p["l"]).alias("l"), F.when(even, p["r"]).otherwise(m).alias("r")))

    out = F.aggregate(_rounds(4, back), F.struct(F.slice(chars, F.lit(1), u).alias("l"), F.slice(chars, u + 1, n - u).alias("r")), step)
    return _let(out, lambda p: F.concat(F.array_join(p["l"], ""), F.array_join(p["r"], ""), F.lit("@"), domain))


_PERMUTE = {"iban": _iban, "email": _email, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}


def _kind(value: Column) -> Column:
    whole = lambda p: value.rlike(rf"\A(?:{p})\z")
    rest = F.when(value.contains("@"), F.lit("email")).when(value.rlike("^[A-Z]"), F.lit("iban")).when(whole(r"\d{1,3}(\.\d{1,3}){3}"), F.lit("ipv4")).when(whole(r"\d{3}-\d{2}-\d{4}"), F.lit("ssn"))
    rest = rest.when(whole(r"\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}"), F.lit("date"))
    return rest.when(whole(r"\d(?:[ -]?\d){12,18}"), F.lit("card")).otherwise(F.lit("phone"))


def permuted(value: Column, kind: Column, key: str, back: bool = False) -> Column:
    out = value
    for name, f in _PERMUTE.items():
        out = F.when(kind == name, f(value, key, back)).otherwise(out)
    return out


def pseudonymised(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """One row per row: doc_id, text with pseudonyms, found (kind, original, pseudonym in text order).

    ``back`` turns pseudonyms into the originals again.
    """
    t = F.col("t")
    none = F.array().cast(FOUND)

    def swapped(found: Column) -> Column:
        return _let(F.translate(found, _OPEN + _CLOSE, ""), _swapped)

    def _swapped(v: Column) -> Column:
        kind = _kind(v)
        return F.struct(kind.alias("kind"), v.alias("original"), _let(kind, lambda k: permuted(v, k, key, back)).alias("pseudonym"))

    def rewritten(found: Column, m: Column) -> Column:
        joined = F.array_join(F.zip_with(F.split(m, ANY, -1), F.concat(F.transform(found, lambda x: x["pseudonym"]), F.array(F.lit(""))), lambda s, p: F.concat(s, p)), "")
        return F.struct(F.when(F.size(found) > 0, joined).otherwise(t).alias("text"), F.filter(found, lambda x: x["original"] != x["pseudonym"]).alias("found"))

    searched = _let(_cards_marked(t), lambda m: _let(F.transform(F.regexp_extract_all(m, F.lit(ANY), F.lit(0)), swapped), lambda found: rewritten(found, m)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    # Texts without anything like a number or an address are not searched.
    out = rows.select("doc_id", F.when(t.rlike(MAY), searched).otherwise(F.struct(t.alias("text"), none.alias("found"))).alias("out"))
    return out.select("doc_id", "out.text", "out.found")


def op7_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of this query is a demonstration value; production passes its own."""
    out = pseudonymised(table(spark, sf_dir, "documents"), key="strandlab-demo")
    return out.select("doc_id", "text", F.size("found").alias("n_found"), F.concat_ws(",", F.transform("found", lambda x: x["kind"])).alias("kinds"))
