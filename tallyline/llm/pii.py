"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations; SQL functions only.

A finding counts once it is validated: card numbers by their check digit, dates by the calendar, addresses of machines by
their octets, social security numbers by their ranges, telephone numbers by their form, mail addresses by their parts.  A
number is permuted within the numbers of its kind and written in its own format, so that the same value gets the same
pseudonym in every document and different values of one way of writing different ones.  A local part of more than 64
signs, a domain of more than 127 labels and a number of more than 15 digits are no mail address or telephone number.

A permutation is an alternating Feistel network over pairs (a, b) with a < m and b < n: each round adds a keyed hash of
one half to the other, modulo its size.  With the key the rounds can be undone; no table of values is kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import keyed_text

ROUNDS = 8

# What may be personal data, in one pattern: later forms do not match inside earlier ones.
_LEFT, _RIGHT = r"(?<![\p{L}\p{N}@._+-])", r"(?![\p{L}\p{N}@])"
FORMS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,24}",
    "date": r"\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4}",
    "ip": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",
    "phone": r"\+\d{1,3}[ -]?\(?\d{2,4}\)?[ -]?\d{3,4}[ -]?\d{3,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "card": r"\d{4}(?:[ -]?\d{4}){3}|\d{4}[ -]?\d{6}[ -]?\d{5}|\d{13,19}",
}
PATTERN = _LEFT + "(?:" + "|".join(f"(?:{form})" for form in FORMS.values()) + ")" + _RIGHT


def keyed(key: str, tweak: str, turn: int, half: Column) -> Column:
    """60 bits of a keyed hash of a half, as a long."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), F.lit(str(turn)), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, m: Column, n: Column, key: str, tweak: str, forward: bool = True) -> Column:
    """struct(a, b): the permuted pair; `forward=False` undoes it.  Sizes must be at least 1."""
    state, sign = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), 1 if forward else -1

    def turned(turn: int) -> Callable[[Column], Column]:
        def step(s: Column) -> Column:
            if turn % 2 == 0:
                return F.struct(F.pmod(s["a"] + sign * F.pmod(keyed(key, tweak, turn, s["b"]), m), m).alias("a"), s["b"].alias("b"))
            return F.struct(s["a"].alias("a"), F.pmod(s["b"] + sign * F.pmod(keyed(key, tweak, turn, s["a"]), n), n).alias("b"))
        return step

    for turn in range(ROUNDS) if forward else reversed(range(ROUNDS)):
        # A lambda binds the state once, so that the expression does not double with every round.
        state = F.transform(F.array(state), turned(turn))[0]
    return state


def power(digits: Column) -> Column:
    """10 ** digits as a long, for up to 18 digits."""
    return F.concat(F.lit("1"), F.repeat(F.lit("0"), digits)).cast("long")


def permuted_digits(digits: Column, key: str, tweak: str, forward: bool = True) -> Column:
    """A string of 2 to 36 digits to another of the same length."""
    size = F.length(digits)
    left = (size / 2).cast("int")
    pair = feistel(F.substring(digits, F.lit(1), left).cast("long"), F.substring(digits, left + 1, size).cast("long"), power(left), power(size - left), key, tweak, forward)
    return F.transform(F.array(pair), lambda p: F.concat(F.lpad(p["a"].cast("string"), left, "0"), F.lpad(p["b"].cast("string"), size - left, "0")))[0]


def characters(text: Column) -> Column:
    """The characters of a text that is not empty."""
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)))


def luhn(body: Column) -> Column:
    """The check digit of a string of digits without it."""
    doubled = F.transform(characters(F.reverse(body)), lambda d, i: F.when(i % 2 == 0, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.pmod(-F.aggregate(doubled, F.lit(0), lambda s, d: s + d), F.lit(10)).cast("string")


def digits_of(found: Column) -> Column:
    return F.regexp_replace(found, r"[^0-9]", "")


def in_format(found: Column, marks: Column, kind: str = "0-9") -> Column:
    """`marks` in the places of the finding's characters of a kind; the other characters stay."""
    return F.array_join(F.transform(characters(found), lambda c, i: F.when(
        c.rlike(f"^[{kind}]$"), F.substring(marks, F.length(F.regexp_replace(F.substring(found, F.lit(1), i + 1), f"[^{kind}]", "")), F.lit(1))).otherwise(c)), "")


def email(found: Column, key: str) -> tuple[Column, Column]:
    """Letters and digits of the local part, read as numbers to the base 36 in stretches of up to 24; the domain stays.

    Addresses that differ in letter case alone are equal, and the pseudonym is written in lower case.
    """
    local, domain = F.lower(F.regexp_extract(found, "^([^@]*)@", 1)), F.regexp_extract(found, "@(.*)$", 1)
    signs = F.regexp_replace(local, "[^a-z0-9]", "")

    def power36(n: Column) -> Column:
        return F.aggregate(F.array_repeat(F.lit(36).cast("long"), n), F.lit(1).cast("long"), lambda p, x: p * x)

    def stretch(part: Column, i: Column) -> Column:
        left = (F.length(part) / 2).cast("int")
        right = F.length(part) - left
        number = lambda t: F.when(F.length(t) > 0, F.conv(t, 36, 10).cast("long")).otherwise(0)
        pair = feistel(number(F.substring(part, F.lit(1), left)), number(F.substring(part, left + 1, F.length(part))), power36(left), power36(right), key, "email")
        write = lambda n, size: F.when(size > 0, F.lpad(F.lower(F.conv(n.cast("string"), 10, 36)), size, "0")).otherwise("")
        return F.transform(F.array(pair), lambda p: F.concat(write(p["a"], left), write(p["b"], right)))[0]

    stretches = F.transform(F.sequence(F.lit(0), F.floor((F.length(signs) - 1) / 24).cast("int")), lambda i: F.substring(signs, i * 24 + 1, F.lit(24)))
    return F.length(signs) > 0, F.concat(in_format(local, F.array_join(F.transform(stretches, stretch), ""), "a-z0-9"), F.lit("@"), domain)


def card(found: Column, key: str) -> tuple[Column, Column]:
    digits = digits_of(found)
    body = F.left(digits, F.length(digits) - 1)
    valid = (F.length(digits) >= 13) & (luhn(body) == F.right(digits, F.lit(1)))
    return valid, F.transform(F.array(permuted_digits(body, key, "card")), lambda b: in_format(found, F.concat(b, luhn(b))))[0]


# The country codes of one and of two digits; all others have three.
_SHORT_CODES = "1|7"
_TWO_DIGIT_CODES = "20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|53|54|55|56|57|58|60|61|62|63|64|65|66|81|82|84|86|90|91|92|93|94|95|98"


def phone(found: Column, key: str) -> tuple[Column, Column]:
    """The country code behind a plus stays, the other digits are permuted: spellings of one number stay linked."""
    digits = digits_of(found)
    code = F.when(~found.startswith("+"), 0).when(digits.rlike(f"^(?:{_SHORT_CODES})"), 1).when(digits.rlike(f"^(?:{_TWO_DIGIT_CODES})"), 2).otherwise(3)
    rest = F.substring(digits, code + 1, F.length(digits))
    valid = (F.length(digits) >= 7) & (F.length(digits) <= 15)
    return valid, F.transform(F.array(permuted_digits(rest, key, "phone")), lambda r: in_format(found, F.concat(F.left(digits, code), r)))[0]


def ssn(found: Column, key: str) -> tuple[Column, Column]:
    """Areas 001-899 but 666, groups 01-99, serials 0001-9999, permuted within themselves: 898 x 99 x 9999 numbers."""
    digits = digits_of(found)
    area, group, serial = (F.substring(digits, a, n).cast("long") for a, n in ((1, 3), (4, 2), (6, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    pair = feistel((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")

    def written(p: Column) -> Column:
        place = F.floor(p["a"] / 99)
        return F.concat(F.lpad((place + F.when(place >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((p["a"] % 99 + 1).cast("string"), 2, "0"), F.lpad((p["b"] + 1).cast("string"), 4, "0"))
    return valid, F.transform(F.array(pair), lambda p: in_format(found, written(p)))[0]


def ip(found: Column, key: str) -> tuple[Column, Column]:
    """Every address below 2**32 to another; octets are written without leading zeros."""
    octets = F.transform(F.split(found, r"\."), lambda o: o.cast("long"))
    valid = F.forall(octets, lambda o: o <= 255)
    pair = feistel(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], F.lit(65536), F.lit(65536), key, "ip")
    return valid, F.transform(F.array(pair), lambda p: F.concat_ws(".", *[x.cast("long").cast("string") for x in (F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256)]))[0]


# Dates are permuted within classes of days that every way of writing keeps apart: days up to 12, which a date with the
# month first can hold, days 13 to 28, days 29 and 30 outside February, days 31, and 29 February.  Each class is a product
# of two sizes.  The years 1900-2099 are permuted among themselves, and all other years up to 9999 among themselves.
_LATE, _MANY, _OTHERS = 1900, 200, 9799
_LEAPS, _LEAPS_BEFORE = 49, 460  # leap years of 1900-2099, and before 1900


def _leaps(year: Column) -> Column:
    """Leap years below `year`."""
    y = year - 1
    return F.floor(y / 4) - F.floor(y / 100) + F.floor(y / 400)


def _leap_year(rank: Column) -> Column:
    """The leap year with `rank` leap years below it: 97 in 400 years, 24 in each century of them and its last year."""
    cycle, k = F.floor(rank / 97), rank % 97
    return cycle * 400 + F.when(k == 96, 400).otherwise(F.floor(k / 24) * 100 + (k % 24 + 1) * 4)


def permuted_day(year: Column, month: Column, day: Column, key: str) -> Column:
    """struct(y, m, d): the pseudonym of a valid date of the years 1 to 9999, of the same class."""
    recent = (year >= _LATE) & (year < _LATE + _MANY)
    place = F.when(recent, year - _LATE).when(year < _LATE, year - 1).otherwise(year - 1 - _MANY)
    years = F.when(recent, _MANY).otherwise(_OTHERS)
    leap_place = _leaps(year) - F.when(year < _LATE, 0).when(recent, _LEAPS_BEFORE).otherwise(_LEAPS)
    early, middle, last, leap = day <= 12, day <= 28, day == 31, (month == 2) & (day == 29)
    long_month = F.when(month <= 7, F.floor((month - 1) / 2)).otherwise(month / 2)
    other_month = F.when(month == 1, 0).otherwise(month - 2)

    def pick(*values) -> Column:
        a, b, c, d, e = values
        return F.when(early, a).when(middle, b).when(leap, c).when(last, d).otherwise(e).cast("long")

    a = pick(place * 12 + month - 1, place * 12 + month - 1, F.floor(leap_place / F.when(recent, 7).otherwise(125)), place, place * 11 + other_month)
    b = pick(day - 1, day - 13, leap_place % F.when(recent, 7).otherwise(125), long_month, day - 29)
    m = pick(years * 12, years * 12, F.when(recent, 7).otherwise(19), years, years * 11)
    n = pick(F.lit(12), F.lit(16), F.when(recent, 7).otherwise(125), F.lit(7), F.lit(2))

    def read(p: Column) -> Column:
        a, b = p["a"], p["b"]
        at = pick(F.floor(a / 12), F.floor(a / 12), F.lit(0), a, F.floor(a / 11))
        plain = F.when(recent, at + _LATE).when(at < _LATE - 1, at + 1).otherwise(at + 1 + _MANY)
        rank = a * F.when(recent, 7).otherwise(125) + b
        rank = rank + F.when(recent, _LEAPS_BEFORE).when(rank < _LEAPS_BEFORE, 0).otherwise(_LEAPS)
        return F.struct(
            F.when(leap, _leap_year(rank)).otherwise(plain).cast("int").alias("y"),
            pick(a % 12 + 1, a % 12 + 1, F.lit(2), F.when(b <= 3, b * 2 + 1).otherwise(b * 2), F.when(a % 11 == 0, 1).otherwise(a % 11 + 2)).cast("int").alias("m"),
            pick(b + 1, b + 13, F.lit(29), F.lit(31), b + 29).cast("int").alias("d"))

    return F.transform(F.array(feistel(a, b, m, n, key, "date")), read)[0]


def date(found: Column, key: str) -> tuple[Column, Column]:
    """One day gets one pseudonym however it is written.  With slashes the month comes first where it can."""
    year_first, slashes = found.rlike(r"^\d{4}"), found.contains("/")
    month_first = slashes & found.rlike(r"^(0[1-9]|1[0-2])/")
    first, second = F.substring(found, 1, 2), F.substring(found, 4, 2)
    y = F.when(year_first, F.substring(found, 1, 4)).otherwise(F.substring(found, 7, 4))
    m = F.when(year_first, F.substring(found, 6, 2)).when(month_first, first).otherwise(second)
    d = F.when(year_first, F.substring(found, 9, 2)).when(month_first, second).otherwise(first)
    day = F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-MM-dd")
    mark = F.when(slashes, "/").when(found.contains("."), ".").otherwise("-")

    def written(p: Column) -> Column:
        year, month, day = (F.lpad(p[k].cast("string"), n, "0") for k, n in (("y", 4), ("m", 2), ("d", 2)))
        return F.when(year_first, F.concat(year, mark, month, mark, day)).when(month_first, F.concat(month, mark, day, mark, year)).otherwise(F.concat(day, mark, month, mark, year))
    return day.isNotNull() & (y >= "0001"), F.transform(F.array(permuted_day(y.cast("int"), m.cast("int"), d.cast("int"), key)), written)[0]


KINDS: dict[str, Callable[[Column, str], tuple[Column, Column]]] = {"email": email, "date": date, "ip": ip, "phone": phone, "ssn": ssn, "card": card}


def pseudonym(found: Column, key: str) -> Column:
    """What to write for a finding; NULL if it is not valid as any kind whose form it has."""
    out = F.lit(None).cast("string")
    for kind, make in reversed(KINDS.items()):
        valid, value = make(found, key)
        out = F.when(found.rlike(f"^(?:{FORMS[kind]})$") & F.coalesce(valid, F.lit(False)), value).otherwise(out)
    return out


def pseudonymised(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_found): every valid finding in every whole text replaced by its pseudonym.

    The rest of a text is untouched; what has the form but is not valid stays.  A NULL text counts as empty; rows repeating
    an id are treated each by its own text; an empty table gives no rows.  Ties cannot arise.
    """
    rows = keyed_text(docs, id_col, text_col)
    may = F.col("text").rlike("[0-9@]")  # most texts hold neither and skip the pattern
    none = F.array().cast("array<string>")
    cut = rows.select("id", "text", F.when(may, F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).otherwise(none).alias("found"))
    names = cut.withColumn("names", F.transform("found", lambda f: pseudonym(f, key)))
    pieces = F.split("text", PATTERN, -1)
    put = F.zip_with(pieces, F.zip_with("found", "names", lambda f, n: F.coalesce(n, f)), lambda p, n: F.concat(p, F.coalesce(n, F.lit(""))))
    return names.select("id", F.when(F.size("found") > 0, F.array_join(put, "")).otherwise(F.col("text")).alias("text"),
                        F.size(F.filter("names", lambda n: n.isNotNull())).cast("long").alias("n_found"))
