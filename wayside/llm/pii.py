"""Format-preserving pseudonyms for personal data.

Personal numbers, dates and addresses are found by pattern, validated (check digits, calendar, ranges) and replaced by a
keyed permutation of the same format: a card stays a valid card, a date a date, digits stay digits and letters letters.
The permutation is a Feistel network with SHA-256 as its round function, so it is one to one: equal values get equal
pseudonyms in all documents, different ones different pseudonyms, and only the key's owner can go back. What is permuted is
the value, not its spelling: the national digits of a phone number whatever stands between or before them, the day that a
date names, the eight groups of an IPv6 address.

Texts are taken apart and put together within the row: no shuffle, and anything that is not validated stays as it was.

Nulls: a null text stays null with no finds; ids are only passed on. Repeated rows are treated alike. Empty texts and tables
stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayside.llm.text import let

ROUNDS = 10

#: Countries by the length of their IBANs.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
UNREGISTERED = {28: "BF BJ CI MA ML NE SN TG"}  # tried at this length first, then like any unknown country


def iban_pattern() -> str:
    """An IBAN ends where its country's ends, whatever stands behind it; only unknown countries are read to the last group."""
    def groups(n: int) -> str:
        full, tail = divmod(n, 4)
        return rf"(?: ?[A-Z0-9]{{4}}){{{full}}}" + (rf" ?[A-Z0-9]{{{tail}}}" if tail else "")

    known = [rf"(?:{lands.replace(' ', '|')})\d{{2}}{groups(n - 4)}"
             for table in (IBAN_LENGTHS, UNREGISTERED) for n, lands in table.items()]
    every = " ".join(IBAN_LENGTHS.values()).replace(" ", "|")
    other = rf"(?!{every})[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?"
    return rf"(?<![0-9A-Za-z])(?=[A-Z]{{2}}\d{{2}})(?:{'|'.join([*known, other])})(?![0-9A-Za-z])"


#: Country codes of phone numbers by their length; all others have three digits.
COUNTRY = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"
#: What credentials are announced by, and what some begin with.
NAMED = r"(?i:token|secret|password|passwd|api[_-]?key)"
PREFIXED = r"(?:AKIA|ASIA)(?=[0-9A-Z]{16}$)|gh[pousr]_(?=[0-9A-Za-z]{36}$)"
GROUP = r"[0-9A-Fa-f]{1,4}"

OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: What each kind looks like, tried in this order at every place; looks ahead that fail soon stand first.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}+@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9\-])",
    "secret": rf"(?<=[\"'])(?<={NAMED}\s?[=:]\s?[\"'])[A-Za-z0-9+/_\-]{{16,128}}(?=[\"'])"
              rf"|(?<=[=:\s])(?=[A-Za-z0-9+/_\-]{{16}})(?<={NAMED}\s?[=:]\s?)[A-Za-z0-9+/_\-]{{16,128}}(?![A-Za-z0-9+/_\-])"
              r"|(?<![0-9A-Za-z])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36})(?![0-9A-Za-z])",
    "ipv6": rf"(?=[0-9A-Fa-f]{{0,4}}:)(?<![0-9A-Za-z:.])(?:(?:{GROUP}:){{7}}{GROUP}|(?:{GROUP}(?::{GROUP}){{0,6}})?::(?:{GROUP}(?::{GROUP}){{0,6}})?)(?![0-9A-Za-z:]|\.\d)",
    "iban": iban_pattern(),
    "card": r"(?<![0-9A-Za-z])(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ \-])\d{6}\2\d{5})(?![0-9A-Za-z])",
    "ipv4": rf"(?<![0-9A-Za-z.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9A-Za-z]|\.\d)",
    "ssn": r"(?<![0-9A-Za-z\-])\d{3}-\d{2}-\d{4}(?![0-9A-Za-z]|-\d)",
    "iso_date": r"(?<![0-9A-Za-z\-])(?:19|20)\d\d-\d\d-\d\d(?:(?=T\d\d)|(?![0-9A-Za-z]|-\d))",
    "dotted_date": r"(?<![0-9A-Za-z.])\d\d\.\d\d\.(?:19|20)\d\d(?![0-9A-Za-z]|\.\d)",
    "slashed_date": r"(?<![0-9A-Za-z/])\d\d/\d\d/(?:19|20)\d\d(?![0-9A-Za-z]|/\d)",
    "phone": r"(?<![0-9A-Za-z+])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}"
             r"|\(\d{3}\) ?\d{3}[.\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4}|0\d{2,4}[ .\-]\d{3,4}[ .\-]?\d{3,4})(?![0-9A-Za-z]|[.\-]\d)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
KINDS = ("email", "secret", "iban", "card", "ipv4", "ipv6", "ssn", "date", "phone")


def prf(secret: str, tweak: Column, k: Column, value: Column) -> Column:
    """60 pseudo-random bits from the key, the format, the round and the other half."""
    hexed = F.sha2(F.concat_ws("|", F.lit(secret), tweak, k.cast("string"), value.cast("string")), 256)
    return F.conv(F.substring(hexed, 1, 15), 16, 10).cast("long")


def permute_pair(secret: str, tweak: Column, a: Column, b: Column, m: Column, n: Column, take) -> Column:
    """Feistel over Z_m x Z_n: the halves are shifted in turn by a function of the other; ``take`` uses the result."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    even = lambda k: k % 2 == 0
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start,
        lambda s, k: F.struct(
            F.when(even(k), (s["a"] + prf(secret, tweak, k, s["b"])) % m).otherwise(s["a"]).alias("a"),
            F.when(even(k), s["b"]).otherwise((s["b"] + prf(secret, tweak, k, s["a"])) % n).alias("b"),
        ),
        take,
    )


def permute_digits(secret: str, kind: str, digits: Column) -> Column:
    """A string of 2 to 18 digits to another of the same length."""
    def of(d: Column) -> Column:
        size = F.length(d)
        left = F.floor(size / 2).cast("int")
        right = size - left
        power = lambda n: F.pow(F.lit(10.0), n).cast("long")
        return permute_pair(
            secret, F.concat_ws(":", F.lit(kind), size.cast("string")),
            F.substr(d, F.lit(1), left).cast("long"), F.substr(d, left + 1, right).cast("long"), power(left), power(right),
            lambda s: F.concat(F.lpad(s["a"].cast("string"), left, F.lit("0")), F.lpad(s["b"].cast("string"), right, F.lit("0"))),
        )
    return let(digits, of)


ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def permute_chars(secret: str, kind: str, text: Column, digits: str = ALPHABETS[0], lower: str = ALPHABETS[1]) -> Column:
    """Any ASCII string: digits stay digits, letters stay letters of their case, all else stays.

    Feistel over the characters: in turn, the left and the right half are shifted, each place within its own alphabet, by a
    stream made from the other half.
    """
    alphabets = (digits, lower, ALPHABETS[2])
    every = "".join(alphabets)

    def of(chars: Column) -> Column:
        half = F.floor(F.size(chars) / 2).cast("int")
        tweak = F.concat_ws(":", F.lit(kind), F.size(chars).cast("string"))

        def shift(c: Column, i: Column, stream: Column) -> Column:
            by = F.conv(F.substr(stream, (i % 14) * 4 + 1, F.lit(4)), 16, 10).cast("int") + i
            out = c
            for letters in alphabets:
                at = F.instr(F.lit(letters), c)
                out = F.when(at > 0, F.substr(F.lit(letters), (at - 1 + by) % len(letters) + 1, F.lit(1))).otherwise(out)
            return out

        def turn(v: Column, k: Column) -> Column:
            left = k % 2 == 0
            other = F.when(left, F.slice(v, half + 1, F.size(v))).otherwise(F.slice(v, 1, half))
            stream = F.sha2(F.concat_ws("|", F.lit(secret), tweak, k.cast("string"), F.array_join(other, "")), 256)
            return let(stream, lambda s: F.transform(v, lambda c, i: F.when((i < half) == left, shift(c, i, s)).otherwise(c)))

        return F.array_join(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), chars, turn), "")

    assert len(set(every)) == len(every)
    return let(F.split(text, ""), of)


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def lay_out(digits: Column, like: Column) -> Column:
    """``digits`` in the places of the digits of ``like``: separators stay where they are."""
    def of(d: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
        return F.aggregate(F.split(like, ""), start, lambda s, c: F.when(
            c.rlike(r"\d"), F.struct(F.concat(s["out"], F.substr(d, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))
        ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))), lambda s: s["out"])
    return let(digits, of)


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, its last digit counted as the check digit."""
    def weighed(c: Column, i: Column, n: Column) -> Column:
        d = c.cast("int")
        twice = (n - i) % 2 == 0
        return F.when(twice, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
    return let(F.split(digits, ""), lambda a: F.aggregate(
        F.transform(a, lambda c, i: weighed(c, i, F.size(a))), F.lit(0), lambda s, x: s + x))


def card(secret: str, m: Column) -> Column:
    """A valid card number to a valid one: the digits before the check digit are permuted, the check digit follows them."""
    def of(d: Column) -> Column:
        body = permute_digits(secret, "card", F.substr(d, F.lit(1), F.length(d) - 1))
        full = let(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
        return F.when(luhn_sum(d) % 10 == 0, lay_out(full, m))
    return let(only_digits(m), of)


def mod97(text: Column) -> Column:
    """The remainder by 97 of a string of digits and capitals, A counting as 10 and Z as 35."""
    value = lambda c: F.instr(F.lit(ALPHABETS[0] + ALPHABETS[2]), c) - 1
    return F.aggregate(F.split(text, ""), F.lit(0), lambda s, c: F.when(
        value(c) < 10, (s * 10 + value(c)) % 97).otherwise((s * 100 + value(c)) % 97))


def iban(secret: str, m: Column) -> Column:
    def of(v: Column) -> Column:
        body, land = F.substr(v, F.lit(5)), F.substr(v, F.lit(1), F.lit(2))
        valid = mod97(F.concat(body, F.substr(v, F.lit(1), F.lit(4)))) == 1
        made = let(permute_chars(secret, "iban", body), lambda b: F.concat(
            land, F.lpad((98 - mod97(F.concat(b, land, F.lit("00")))).cast("string"), 2, "0"), b))
        spaced = let(made, lambda d: F.aggregate(
            F.split(m, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
            lambda s, c: F.when(c == " ", F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))).otherwise(
                F.struct(F.concat(s["out"], F.substr(d, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))),
            lambda s: s["out"]))
        return F.when(valid, spaced)
    return let(F.replace(m, F.lit(" "), F.lit("")), of)


def ipv4(secret: str, m: Column) -> Column:
    def of(o: Column) -> Column:
        pair = lambda i: F.get(o, F.lit(i)).cast("long") * 256 + F.get(o, F.lit(i + 1)).cast("long")
        side = F.lit(65536).cast("long")
        text = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), (x % 256).cast("string"))
        return permute_pair(secret, F.lit("ipv4"), pair(0), pair(2), side, side,
                            lambda s: F.concat_ws(".", text(s["a"]), text(s["b"])))
    return let(F.split(m, r"\."), of)


def ipv6(secret: str, m: Column) -> Column:
    """An address, short or written out, to eight groups of four: equal addresses get equal ones however they are written."""
    groups = lambda t: F.filter(F.split(t, ":"), lambda g: g != "")
    full = lambda a: F.array_join(F.transform(a, lambda g: F.lpad(F.lower(g), 4, "0")), "")
    short = m.contains("::")
    before = groups(F.when(short, F.substring_index(m, "::", 1)).otherwise(m))
    behind = groups(F.when(short, F.substring_index(m, "::", -1)).otherwise(F.lit("")))
    missing = 8 - F.size(before) - F.size(behind)
    valid = F.when(short, missing >= 1).otherwise(missing == 0) & m.rlike("[0-9]") & (F.length(F.replace(m, F.lit(":"), F.lit(""))) > 1)
    hexed = F.concat(full(before), F.repeat(F.lit("0000"), F.greatest(missing, F.lit(0))), full(behind))
    made = permute_chars(secret, "ipv6", hexed, lower="abcdef")
    return F.when(valid, let(made, lambda h: F.array_join(F.transform(
        F.sequence(F.lit(1), F.lit(29), F.lit(4)), lambda i: F.substr(h, i, F.lit(4))), ":")))


def ssn(secret: str, m: Column) -> Column:
    """Valid area (001-899 but 666), group (01-99) and serial (0001-9999) to other valid ones."""
    area, group, serial = (F.substr(m, F.lit(i), F.lit(n)).cast("int") for i, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)  # 0..897
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")

    def text(s: Column) -> Column:
        a = F.when(s["a"] >= 665, s["a"] + 2).otherwise(s["a"] + 1)
        return F.concat_ws("-", pad(a, 3), pad(F.floor(s["b"] / 9999) + 1, 2), pad(s["b"] % 9999 + 1, 4))

    return F.when(valid, permute_pair(secret, F.lit("ssn"), place, (group - 1) * 9999 + serial - 1,
                                      F.lit(898).cast("long"), F.lit(99 * 9999).cast("long"), text))


FIRST_DAY, DAYS = "1900-01-01", (17, 4297)  # 17 * 4297 days: 1900-01-01 to 2099-12-31


WALK = 64  # steps: two days in five are up to the 12th, so that all of them end on the other side has a chance of 1e-14


def moved_date(secret: str, d: Column) -> Column:
    def of(n: Column) -> Column:
        return F.date_add(F.lit(FIRST_DAY).cast("date"), permute_pair(
            secret, F.lit("date"), F.floor(n / DAYS[1]), n % DAYS[1], F.lit(DAYS[0]).cast("long"),
            F.lit(DAYS[1]).cast("long"), lambda s: (s["a"] * DAYS[1] + s["b"]).cast("int")))
    return let(F.datediff(d, F.lit(FIRST_DAY).cast("date")), of)


def other_day(secret: str, d: Column) -> Column:
    """A date of 1900 to 2099 to another one, moved until its day is up to 12 if the first one's was, and above if not.

    So a date that only one reading allows stays one, and its pseudonym is the same in every form; the walk is one to one.
    """
    early = lambda x: F.dayofmonth(x) <= 12
    return F.aggregate(F.sequence(F.lit(2), F.lit(WALK)), moved_date(secret, d), lambda s, _: F.when(
        early(s) == early(d), s).otherwise(moved_date(secret, s)))


def date(secret: str, m: Column, *forms: str) -> Column:
    """A date, in the first of the forms that it can be read by, to another one written the same way."""
    read = lambda form: let(F.try_to_date(m, form), lambda d: F.when(
        d.isNotNull(), F.date_format(other_day(secret, d), form)))
    return F.coalesce(*[read(form) for form in forms])


def phone(secret: str, m: Column) -> Column:
    """The national digits are permuted; country code, trunk zero and layout stay.

    They are what follows the country code (after +) and a trunk zero, so +44 20 7946 0958, +442079460958, +44 (0)20 7946 0958
    and 020 7946 0958 get the same ones. Italian numbers keep their zero.
    """
    def of(d: Column) -> Column:
        code = F.when(m.startswith("+"), F.length(F.regexp_extract(d, rf"^(?:{COUNTRY})", 0))).otherwise(F.lit(0))
        trunk = (F.substr(d, code + 1, F.lit(1)) == "0") & ~(m.startswith("+") & d.startswith("39"))
        start = code + trunk.cast("int")
        n = F.length(d) - start
        return F.when((n >= 6) & (n <= 15), lay_out(F.concat(
            F.substr(d, F.lit(1), start), permute_digits(secret, "phone", F.substr(d, start + 1))), m))
    return let(only_digits(m), of)


def email(secret: str, m: Column) -> Column:
    """The local part is permuted; the domain stays."""
    return F.concat(permute_chars(secret, "email", F.substring_index(m, "@", 1)), F.lit("@"), F.substring_index(m, "@", -1))


def secret_value(secret: str, m: Column) -> Column:
    """A credential: digits and letters both needed, unless it begins like one; hexadecimal stays hexadecimal."""
    head = F.regexp_extract(m, rf"^(?:{PREFIXED})", 0)
    body = F.substr(m, F.length(head) + 1)
    hexed = permute_chars(secret, "hex", body, lower="abcdef")
    other = permute_chars(secret, "secret", body)
    mixed = m.rlike(r"[0-9]") & m.rlike(r"[A-Za-z]")
    return F.when(mixed | (head != ""), F.concat(head, F.when(body.rlike(r"^[0-9a-f]+$"), hexed).otherwise(other)))


def pseudonym(secret: str, m: Column) -> Column:
    """(kind, text) for a match: its pseudonym, or kind null and the match itself if it is not valid."""
    ways = [
        ("email", m.contains("@"), lambda: email(secret, m)),
        ("ipv4", m.rlike(rf"^{PATTERNS['ipv4']}$"), lambda: ipv4(secret, m)),
        ("ipv6", m.rlike(rf"^{PATTERNS['ipv6']}$"), lambda: ipv6(secret, m)),
        ("ssn", m.rlike(rf"^{PATTERNS['ssn']}$"), lambda: ssn(secret, m)),
        ("date", m.rlike(r"^\d{4}-\d\d-\d\d$"), lambda: date(secret, m, "yyyy-MM-dd")),
        ("date", m.rlike(r"^\d\d\.\d\d\.\d{4}$"), lambda: date(secret, m, "dd.MM.yyyy")),
        ("date", m.rlike(r"^\d\d/\d\d/\d{4}$"), lambda: date(secret, m, "MM/dd/yyyy", "dd/MM/yyyy")),
        ("card", m.rlike(rf"^{PATTERNS['card']}$"), lambda: card(secret, m)),
        ("phone", m.rlike(rf"^{PATTERNS['phone']}$"), lambda: phone(secret, m)),
        ("iban", m.rlike(rf"^{PATTERNS['iban']}$"), lambda: iban(secret, m)),
        ("secret", F.lit(True), lambda: secret_value(secret, m)),
    ]
    made, kind = None, None
    for name, test, out in ways:
        made = F.when(test, out()) if made is None else made.when(test, out())
        kind = F.when(test, F.lit(name)) if kind is None else kind.when(test, F.lit(name))
    return let(made, lambda p: F.struct(
        F.when(p.isNotNull(), kind).alias("kind"), F.coalesce(p, m).alias("text")))


def pseudonymize(docs: DataFrame, secret: str, text: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in the text, and ``found``: the kinds replaced, in order."""
    matches = F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))
    taken = docs.withColumn("__m", matches).withColumn("__p", F.transform("__m", lambda m: pseudonym(secret, m)))
    hit = F.exists("__p", lambda p: p["kind"].isNotNull())
    gaps = F.split(F.col(text), ANY)
    pieces = F.zip_with(gaps, F.transform("__p", lambda p: p["text"]), lambda g, p: F.concat(g, F.coalesce(p, F.lit(""))))
    kinds = F.filter(F.transform("__p", lambda p: p["kind"]), lambda k: k.isNotNull())
    return taken.withColumn("found", F.coalesce(F.when(hit, kinds), F.array().cast("array<string>"))).withColumn(
        text, F.when(hit, F.array_join(pieces, "")).otherwise(F.col(text))
    ).drop("__m", "__p")
