"""Format-preserving pseudonyms from keyed Feistel permutations, in column expressions only.

A text is cut at everything that looks like personal data; each piece that is
valid for its kind is replaced by a permuted value of the same format:

* numbers and dates whose valid values form a grid a x b are permuted on it: the
  rounds add a keyed digest of one coordinate to the other, modulo its size.
  That is a bijection of the grid, so the outcome is valid again. Telephone
  numbers of the +1 plan, social security numbers, IPv4 addresses and dates (the
  146,097 days from 1800 to 2199 are 189 x 773) go this way;
* all others are permuted as strings: the letters and digits of one half are
  shifted, each within its class, by a digest of the other half. Card numbers
  keep their first digit and IBANs their country, and get the check digits that
  fit; e-mail addresses keep their last label, other telephone numbers their
  country code.

The value is permuted, not its spelling: a number gives one pseudonym, however
it is punctuated, and so does an address in either case, in every document and
on every run with the same key. Without the key the digests can't be undone.

Pieces that fail the check of their kind (Luhn, modulo 97, calendar, number
ranges; e-mail addresses longer than the mail standards allow: 64 characters
before the @, 63 a label, 127 labels, 320 in all) are no personal data and stay
as they are. No pattern repeats a group without a bound, so the matcher's stack
and time stay bounded on texts of any length, whatever they hold. Null and empty
texts stay so, repeated rows get the same text, and an empty table gives an
empty one. Columns may have any name: the row travels as one struct.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
LONGEST_EMAIL = 320
YEARS, DAYS, DAY_ROWS, DAY_COLUMNS = (1800, 2200), 146_097, 189, 773

# ── fixed values: how personal data is written ──────────────────────────────
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_DATE = r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/-]|\.\d)"
_IP = rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\w)"
_SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
_SEP = r"[ ./\u00a0\u202f-]?"
_DIGIT = rf"{_SEP}(?:\((?=\d{{1,5}}\)))?\d(?:\)(?={_SEP}\d))?"
_OTHER = rf"(?![ ](?:{_DATE}|{_IP}|{_SSN}|\+|\d{{13,19}}(?!\d)|(?:\d{{4}}[ -]){{3}}\d{{1,7}}(?![ -]?\d)|\d{{3}}[ .-]\d{{3}}[ .-]\d{{4}}\b))"
#: Of the plans +1, +33 and +34 the length is known; others take up to 15 digits, and stop before something of another kind if they can.
_ABROAD = rf"(?<![\w+])\+(?:(?:1(?:{_DIGIT}){{10}}|3[34](?:{_SEP}\(0\))?(?:{_DIGIT}){{9}})(?!\w)|\d(?:{_OTHER}{_DIGIT}){{6,14}}(?!\w)|\d(?:{_DIGIT}){{6,14}}(?!\w))"
_COUNTRY = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"
#: Registered lengths; others are taken as long as they go.
_IBANS = {15: "NO", 16: "BE", 18: "DK FK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
          24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
_GROUPED = "|".join(rf"(?:{c.replace(' ', '|')})\d{{2}}(?:[A-Z0-9]{{{n - 4}}}|(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}{f' [A-Z0-9]{{{n % 4}}}' if n % 4 else ''})" for n, c in _IBANS.items())
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,125}\.[A-Za-z]{2,63}(?![A-Za-z])",
    "date": _DATE,
    "ip": _IP,
    "ssn": _SSN,
    "phone": rf"{_ABROAD}|(?<![\w(])(?:\(\d{{3}}\) ?|\d{{3}}[.-])\d{{3}}[.-]\d{{4}}(?!\w)|(?<![\w(])(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .-])[2-9]\d\d[ .-]\d{{4}}(?!\w)",
    "iban": rf"(?<!\w)(?=[A-Z]{{2}}\d{{2}})(?:{_GROUPED})(?!\w)|" r"(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w)",
    "card": r"(?<![\w.+-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-]|\.\d)",
}
# ────────────────────────────────────────────────────────────────────────────
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used: inside a lambda Spark shares nothing."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _draw(*parts: Column | str) -> Column:
    """60 bits of a digest of the parts, as a number."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def permuted_pair(left: Column, right: Column, a: int, b: int, secret: str, kind: str) -> Column:
    """struct<l, r>: the Feistel permutation of the grid a x b; ``left`` in [0, a), ``right`` in [0, b)."""

    def step(at: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(F.pmod(at["l"] + F.pmod(_draw(secret, kind, i, at["r"]), F.lit(a)), F.lit(a)).alias("l"), at["r"].alias("r"))).otherwise(
            F.struct(at["l"].alias("l"), F.pmod(at["r"] + F.pmod(_draw(secret, kind, i, at["l"]), F.lit(b)), F.lit(b)).alias("r")))

    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _chars(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: s.substr(i, F.lit(1)))


def _shifted(half: Column, other: Column, i: Column, secret: str, kind: str) -> Column:
    """Each letter or digit moved on within its class, by a digest of round, place and the other half."""

    def one(c: Column, j: Column) -> Column:
        by = _draw(secret, kind, i, j, other)
        digit = F.pmod(F.ascii(c) - 48 + F.pmod(by, F.lit(10)), F.lit(10)) + 48
        lower = F.pmod(F.ascii(c) - 97 + F.pmod(by, F.lit(26)), F.lit(26)) + 97
        upper = F.pmod(F.ascii(c) - 65 + F.pmod(by, F.lit(26)), F.lit(26)) + 65
        return F.char(F.when(c.between("0", "9"), digit).when(c.between("a", "z"), lower).otherwise(upper))

    return F.when(F.length(half) == 0, half).otherwise(F.array_join(F.transform(_chars(half), one), ""))


def permuted_string(value: Column, secret: str, kind: str) -> Column:
    """The Feistel permutation of strings of ASCII letters and digits with the same class at each place."""

    def step(at: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(_shifted(at["l"], at["r"], i, secret, kind).alias("l"), at["r"].alias("r"))).otherwise(
            F.struct(at["l"].alias("l"), _shifted(at["r"], at["l"], i, secret, kind).alias("r")))

    def halves(v: Column) -> Column:
        half = F.floor(F.length(v) / 2).cast("int")
        return F.struct(v.substr(F.lit(1), half).alias("l"), v.substr(half + 1, F.length(v)).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), _let(value, halves), step, lambda at: F.concat(at["l"], at["r"]))


def _laid_out(spelling: Column, values: Column, kept: str) -> Column:
    """``spelling`` with its characters of the class ``kept`` replaced in order by those of ``values``."""

    def filled(v: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            nth = F.length(F.regexp_replace(spelling.substr(F.lit(1), i + 1), f"[^{kept}]", ""))
            return F.when(c.rlike(f"^[{kept}]$"), v.substr(nth, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(_chars(spelling), one), "")

    return _let(values, filled)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _int(s: Column, start: int, length: int) -> Column:
    return s.substr(start, length).cast("bigint")


def _padded(n: Column, width: int) -> Column:
    """Leading zeros up to a width; values are below 10 ** width, so nothing is cut."""
    return F.lpad(n.cast("string"), width, "0")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum, modulo 10: 0 for a valid number."""

    def summed(s: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            d = s.substr(F.length(s) - i, F.lit(1)).cast("int")
            return F.pmod(acc + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d), F.lit(10))

        return F.aggregate(F.sequence(F.lit(0), F.length(s) - 1), F.lit(0), add)

    return _let(digits, summed)


def mod97(s: Column) -> Column:
    """The string read as a number, letters as 10 to 35, modulo 97."""

    def add(acc: Column, c: Column) -> Column:
        v = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.pmod(acc * F.when(v > 9, 100).otherwise(10) + v, F.lit(97))

    return F.aggregate(_chars(s), F.lit(0), add)


def _email(m: Column, secret: str) -> Column:
    low = F.lower(m)
    tail = F.concat(F.lit("."), F.element_at(F.split(low, r"\."), -1))
    head = low.substr(F.lit(1), F.length(low) - F.length(tail))
    new = F.concat(_let(head, lambda h: _laid_out(h, permuted_string(F.regexp_replace(h, "[^a-z0-9]", ""), secret, "email"), "a-z0-9")), tail)
    return F.when(F.length(m) <= LONGEST_EMAIL, new)


def _date(m: Column, secret: str) -> Column:
    parts = F.split(m, "[-/.]")
    iso, sep = m.rlike("^[0-9]{4}-"), F.regexp_extract(m, "[-/.]", 0)
    x, y, z = (F.get(parts, F.lit(i)).cast("int") for i in range(3))
    dm = (x <= 31) & (y <= 12) & F.try_to_date(F.concat_ws("-", z, _padded(y, 2), _padded(x, 2))).isNotNull()
    day = F.when(iso, F.try_to_date(m)).when(dm, F.try_to_date(F.concat_ws("-", z, _padded(y, 2), _padded(x, 2)))).otherwise(F.try_to_date(F.concat_ws("-", z, _padded(x, 2), _padded(y, 2))))
    first_day = F.lit(f"{YEARS[0]}-01-01").cast("date")
    wide = lambda n, like: F.when(F.length(like) == 2, _padded(n, 2)).otherwise(n.cast("string"))

    def spelled(to: Column) -> Column:
        first, second = F.when(dm, F.dayofmonth(to)).otherwise(F.month(to)), F.when(dm, F.month(to)).otherwise(F.dayofmonth(to))
        local = F.concat(wide(first, F.get(parts, F.lit(0))), sep, wide(second, F.get(parts, F.lit(1))), sep, F.year(to).cast("string"))
        return F.when(iso, F.date_format(to, "yyyy-MM-dd")).otherwise(local)

    def moved(n: Column) -> Column:
        new = permuted_pair(F.floor(n / DAY_COLUMNS), F.pmod(n, F.lit(DAY_COLUMNS)), DAY_ROWS, DAY_COLUMNS, secret, "date")
        return F.when(n.between(0, DAYS - 1), _let(_let(new, lambda x: F.date_add(first_day, (x["l"] * DAY_COLUMNS + x["r"]).cast("int"))), spelled))

    return _let(F.datediff(day, first_day), moved)


def _ip(m: Column, secret: str) -> Column:
    o = F.split(m, r"\.")
    at = [F.get(o, F.lit(i)).cast("bigint") for i in range(4)]
    new = permuted_pair(at[0] * 256 + at[1], at[2] * 256 + at[3], 65_536, 65_536, secret, "ip")
    return _let(new, lambda to: F.concat_ws(".", *[x.cast("string") for n in (to["l"], to["r"]) for x in (F.shiftright(n, 8), F.pmod(n, F.lit(256)))]))


def _ssn(m: Column, secret: str) -> Column:
    area, group, serial = _int(m, 1, 3), _int(m, 5, 2), _int(m, 8, 4)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = area - F.when(area > 666, 2).otherwise(1)  # 898 areas, 666 left out
    new = permuted_pair(index * 99 + group - 1, serial - 1, 898 * 99, 9999, secret, "ssn")

    def spelled(to: Column) -> Column:
        i = F.floor(to["l"] / 99)
        return F.concat_ws("-", _padded(i + F.when(i >= 665, 2).otherwise(1), 3), _padded(F.pmod(to["l"], F.lit(99)) + 1, 2), _padded(to["r"] + 1, 4))

    return F.when(valid, _let(new, spelled))


def _phone(m: Column, secret: str) -> Column:
    """The trunk digit in "+44 (0)20" is not part of the number: it is left out, and stays where it is."""
    own = F.regexp_replace(m, r"\(0\)", "(o)")
    d, abroad = _digits(own), m.startswith("+")
    country = F.when(abroad, F.regexp_extract(d, f"^({_COUNTRY})", 1)).otherwise(F.lit("1"))

    def permuted(at: Column) -> Column:
        national, area, exchange = at["national"], _int(at["national"], 1, 3), _int(at["national"], 4, 3)
        plan = (at["country"] == "1") & (F.length(national) == 10) & (area >= 200) & (exchange >= 200)
        new = permuted_pair((area - 200) * 800 + exchange - 200, _int(national, 7, 4), 640_000, 10_000, secret, "phone")
        there = _let(new, lambda to: F.concat(_padded(F.floor(to["l"] / 800) + 200, 3), _padded(F.pmod(to["l"], F.lit(800)) + 200, 3), _padded(to["r"], 4)))
        to = F.when(plan, there).otherwise(permuted_string(national, secret, "phone"))
        spelled = _laid_out(own, F.concat(F.when(abroad, at["country"]).otherwise(F.lit("")), to), "0-9")
        return F.when(F.length(national) > 0, F.regexp_replace(spelled, r"\(o\)", "(0)"))

    return _let(F.struct(country.alias("country"), F.when(abroad, d.substr(F.length(country) + 1, F.length(d))).otherwise(d).alias("national")), permuted)


def _iban(m: Column, secret: str) -> Column:
    s = F.regexp_replace(m, " ", "")
    rest = s.substr(F.lit(5), F.length(s))
    valid = mod97(F.concat(rest, s.substr(1, 4))) == 1
    checked = lambda new: F.concat(s.substr(1, 2), _padded(F.lit(98) - mod97(F.concat(new, s.substr(1, 2), F.lit("00"))), 2), new)
    return F.when(valid, _laid_out(m, _let(permuted_string(rest, secret, "iban"), checked), "A-Z0-9"))


def _card(m: Column, secret: str) -> Column:
    d = _digits(m)
    body = F.concat(d.substr(1, 1), permuted_string(d.substr(F.lit(2), F.length(d) - 2), secret, "card"))
    checked = lambda x: F.concat(x, F.pmod(F.lit(10) - luhn_sum(F.concat(x, F.lit("0"))), F.lit(10)).cast("string"))
    return F.when(luhn_sum(d) == 0, _laid_out(m, _let(body, checked), "0-9"))


_MAKERS = {"email": _email, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "iban": _iban, "card": _card}


def _replaced(m: Column, secret: str) -> Column:
    """struct<kind, to> of a piece: the first kind whose pattern fits it whole; ``to`` is null if it is not valid."""
    kind = F.lit(None).cast("string")
    to = F.lit(None).cast("string")
    for name in reversed(PATTERNS):
        fits = m.rlike(f"^(?:{PATTERNS[name]})$")
        kind, to = F.when(fits, F.lit(name)).otherwise(kind), F.when(fits, _MAKERS[name](m, secret)).otherwise(to)
    return F.struct(F.when(to.isNotNull(), kind).alias("kind"), F.coalesce(to, m).alias("to"))


def _times(kinds: Column, kind: str) -> Column:
    return F.greatest(F.size(F.filter(kinds, lambda x: x == kind)), F.lit(0)).cast("bigint")


def pseudonymise(docs: DataFrame, secret: str, text: str = "text", out: str = "text", found: str | None = None) -> DataFrame:
    """Every row with personal data in ``text`` replaced, written to ``out``; ``found`` gets a map of kind to number.

    Columns keep their order; ``out`` and ``found`` replace columns of that name.
    """
    t = F.col(text)
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), t.alias("t"), F.regexp_extract_all(F.when(t.rlike("[0-9@]"), t), F.lit(_ANY), F.lit(0)).alias("pieces"))
    row = row.withColumn("new", F.transform("pieces", lambda m: _replaced(m, secret)))
    gaps = F.split(F.col("t"), _ANY, -1)
    joined = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.col("new"), i)["to"], F.lit("")))), "")
    row = row.withColumn("made", F.when(F.coalesce(F.size("new"), F.lit(0)) > 0, joined).otherwise(F.col("t")))
    held = F.filter(F.transform("new", lambda x: x["kind"]), lambda k: k.isNotNull())
    counts = F.map_from_arrays(F.array(*[F.lit(k) for k in PATTERNS]), F.array(*[_times(held, k) for k in PATTERNS]))
    names = [c for c in docs.columns if c != found] + ([out] if out not in docs.columns else [])
    cols = [F.col("made").alias(c) if c == out else F.col("row").getField(c).alias(c) for c in names]
    return row.select(*cols, *([counts.alias(found)] if found else []))
