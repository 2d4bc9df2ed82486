"""Format-preserving pseudonyms for private values, by keyed Feistel permutations in DataFrame functions.

Found values are validated (Luhn digit of card numbers, octets of addresses, calendar of dates, ranges of social
security numbers), split into two numbers A and B of known moduli, and permuted by rounds that add a keyed hash of one
to the other. The result is written in the same format and is valid again. The permutation is one to one on each
format, so equal values stay equal in all documents, different values stay different, and the holder of the key can
undo it. An e-mail address is no number: its parts are replaced by a keyed hash of theirs.

Numbers that stand beside a card, such as a security code or an expiry month, look like a part of it. So a whole run of
numbers is taken, up to a value of another form, and the cards in it are those that are valid: first unbroken numbers
and the usual groups (4-4-4-4, 4-6-5, 4-6-4) wherever they are, then the run as one card, then the run without its first
or last number. What is left is read from left to right in stretches of up to 19 digits. A card in unusual groups with
two or more numbers on one side of it may be missed.

| Value | Kept | Permuted |
|---|---|---|
| card number, 13-19 digits | length, separators, first digit | other digits; the check digit is computed anew |
| phone number with country code, separated or not (E.164) | country code, separators | national digits |
| IPv4 address | form | the 32 bits |
| social security number | form | all valid numbers |
| date (ISO, m/d/y, d.m.y), 1801-2100 | form, century | days of the century |
| long hexadecimal key | length, case | all digits |

Defined results: NULL text stays NULL and empty text empty; text without valid values is unchanged; other columns are
kept as they are, whatever their names; rows may repeat; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 8
KEY = "change me: the key of the pseudonyms"

#: Forms of the values.
FORMS = {
    # begins where no sign of its own stands before, so that a long run of signs is read once; a host has up to 127 labels
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,}",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{4}|\+[1-9][0-9]{7,14}",
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}",
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "hex": r"[0-9a-f]{32,128}|[0-9A-F]{32,128}",
}
#: A run of numbers as long as a card or longer. It ends before a value of another form.
FORMS["card"] = (
    r"(?=[0-9](?:[ -]?[0-9]){12})[0-9]++(?![0-9A-Za-z])(?:[ -](?!(?:"
    + "|".join(FORMS[kind] for kind in ("email", "date", "ip", "ssn", "hex")) + r")(?![0-9A-Za-z]))[0-9]++(?![0-9A-Za-z]))*+"
)
ONE_CARD = r"[0-9](?:[ -]?[0-9]){12,18}"
#: Where cards may be in a run, likely places first. Places of one form may overlap.
PLACES = (
    *(rf"(?<![0-9])(?=({form})(?![0-9]))" for form in ("[0-9]{13,19}", "[0-9]{4}(?:[ -][0-9]{4}){3}", "[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}")),
    f"^({ONE_CARD})$", f"^({ONE_CARD})[ -][0-9]+$", f"^[0-9]+[ -]({ONE_CARD})$", f"^[0-9]+[ -]({ONE_CARD})[ -][0-9]+$",
)
#: Country codes of one and two digits; all others have three.
COUNTRY = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3})"
DATE_FORMATS = {r"[0-9]{4}-.*": "yyyy-MM-dd", r".*/.*": "M/d/yyyy", r".*\..*": "d.M.yyyy"}
#: First day, and two factors of the number of days, of each century.
CENTURIES = (("1801-01-01", 92, 397), ("1901-01-01", 75, 487), ("2001-01-01", 92, 397))

ANY = "(?<![0-9A-Za-z])(?:" + "|".join(FORMS.values()) + ")(?![0-9A-Za-z])"
#: What every value has: cheap, and false for most texts.
MAYBE = r"@[A-Za-z0-9]|[0-9][0-9./ -][0-9./ ()-]*[0-9]|[0-9a-f]{32}|[0-9A-F]{32}"


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def number(text: Column, radix: int = 10) -> Column:
    return (text if radix == 10 else F.conv(text, radix, 10)).cast("long")


def power(radix: int, n: Column) -> Column:
    return F.round(F.pow(F.lit(float(radix)), n)).cast("long")


def feistel(a: Column, b: Column, mod_a: Column, mod_b: Column, key: str, tweak: Column) -> Column:
    """struct(a, b) permuted: rounds add a keyed hash of b to a and of a to b in turn."""

    def keyed(i, x):
        text = F.concat_ws("|", F.lit(key), tweak, i.cast("string"), x.cast("string"), F.lit(key))
        return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")

    def turn(s, i):
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["a"] + keyed(i, s["b"]), mod_a)).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise(F.pmod(s["b"] + keyed(i, s["a"]), mod_b)).alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.alias("a"), b.alias("b")), turn)


def permuted_digits(text: Column, radix: int, key: str, tweak: Column) -> Column:
    """A string of 2 to 18 digits permuted within its length."""
    left = F.floor(F.length(text) / 2).cast("int")
    right = F.length(text) - left
    out = feistel(
        number(F.substr(text, F.lit(1), left), radix), number(F.substr(text, left + 1, right), radix),
        power(radix, left), power(radix, right), key, tweak,
    )

    def written(x, n):
        return F.lpad(F.lower(F.conv(x.cast("string"), 10, radix)), n, F.lit("0"))

    return F.concat(written(out["a"], left), written(out["b"], right))


def luhn_sum(digits: Column) -> Column:
    """Sum in which the last digit counts once and every second digit before it doubled."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.lit(2) * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def refilled(form: Column, digits: Column) -> Column:
    """`form` with its digits replaced, in order, by `digits`."""
    empty = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def step(s, c):
        is_digit = c.rlike("^[0-9]$")
        put = F.when(is_digit, F.substr(digits, s["k"] + 1, F.lit(1))).otherwise(c)
        return F.struct(F.concat(s["out"], put).alias("out"), (s["k"] + F.when(is_digit, 1).otherwise(0)).alias("k"))

    return F.aggregate(F.split(form, ""), empty, step, lambda s: s["out"])


def exchanged(text: Column, form: str, new) -> Column:
    """`text` with each match of `form` replaced by what `new` makes of it."""
    values, between = F.regexp_extract_all(text, F.lit(form), F.lit(0)), F.split(text, form, -1)
    return F.array_join(F.flatten(F.zip_with(between, F.transform(values, new), lambda b, v: F.array(b, F.coalesce(v, F.lit(""))))), "")


# ---- kinds: each gives NULL for what isn't valid -------------------------------------------------------------------

def valid_card(value: Column) -> Column:
    digits = digits_of(value)
    return (F.pmod(luhn_sum(digits), F.lit(10)) == 0) & ~digits.rlike("^0*$")


def cards(value: Column, key: str) -> Column:
    """A run of numbers with each card in it replaced. A card that is found is kept apart as <letters>."""
    places = F.concat(*(F.regexp_extract_all(value, F.lit(place), F.lit(1)) for place in PLACES))

    def apart(run, found):
        bounded = F.concat(F.lit("(?<![0-9a-j])"), found, F.lit("(?![0-9a-j])"))
        return F.regexp_replace(run, bounded, F.concat(F.lit("<"), F.translate(found, "0123456789", "abcdefghij"), F.lit(">")))

    marked = F.aggregate(F.filter(F.array_distinct(places), valid_card), value, apart)
    return exchanged(
        marked, f"<[^>]*>|(?<![0-9]){ONE_CARD}(?![0-9])",
        lambda v: F.coalesce(card(F.translate(v, "abcdefghij<>", "0123456789"), key), v),
    )


def card(value: Column, key: str) -> Column:
    digits = digits_of(value)
    n = F.length(digits)
    body = F.concat(F.substring(digits, 1, 1), permuted_digits(F.substr(digits, F.lit(2), n - 2), 10, key, F.concat(F.lit("card"), F.substring(digits, 1, 1))))
    check = F.pmod(F.lit(10) - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
    return F.when(valid_card(value), refilled(value, F.concat(body, check.cast("string"))))


def phone(value: Column, key: str) -> Column:
    apart = F.regexp_extract(value, r"^\+([0-9]{1,3})[^0-9]", 1)
    code = F.when(apart == "", F.regexp_extract(value, COUNTRY, 1)).otherwise(apart)
    digits = digits_of(value)
    nation = F.substr(digits, F.length(code) + 1, F.length(digits))
    return F.when(F.length(digits) <= 15, refilled(value, F.concat(code, permuted_digits(nation, 10, key, F.concat(F.lit("phone"), code)))))


def ip(value: Column, key: str) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda o: o.cast("int"))
    at = lambda k: F.get(octets, k)
    out = feistel((at(0) * 256 + at(1)).cast("long"), (at(2) * 256 + at(3)).cast("long"), F.lit(65536), F.lit(65536), key, F.lit("ip"))
    parts = [f(out[x]) for x in "ab" for f in (lambda v: F.floor(v / 256), lambda v: v % 256)]
    return F.when(F.forall(octets, lambda o: o < 256), F.concat_ws(".", *(p.cast("string") for p in parts)))


def ssn(value: Column, key: str) -> Column:
    area, group, serial = (F.substring(value, p, n).cast("long") for p, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    out = feistel(area - 1 - F.when(area > 666, 1).otherwise(0), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, F.lit("ssn"))
    new_area = out["a"] + 1 + F.when(out["a"] + 1 >= 666, 1).otherwise(0)
    parts = ((new_area, 3), (F.floor(out["b"] / 9999) + 1, 2), (out["b"] % 9999 + 1, 4))
    return F.when(valid, F.concat_ws("-", *(F.lpad(p.cast("string"), n, "0") for p, n in parts)))


def date(value: Column, key: str) -> Column:
    result = F.lit(None).cast("string")
    for shape, form in DATE_FORMATS.items():
        day = F.try_to_date(value, form)
        new = F.lit(None).cast("date")
        for first, many, few in CENTURIES:
            n = F.datediff(day, F.lit(first).cast("date")).cast("long")
            out = feistel(F.floor(n / few).cast("long"), n % few, F.lit(many), F.lit(few), key, F.concat(F.lit("date"), F.lit(first)))
            new = F.when((n >= 0) & (n < many * few), F.date_add(F.lit(first).cast("date"), (out["a"] * few + out["b"]).cast("int"))).otherwise(new)
        written = F.date_format(new, form)
        padded = F.date_format(new, form.replace("M", "MM").replace("d", "dd")) if form != "yyyy-MM-dd" else written
        result = F.when(value.rlike(f"^{shape}$"), F.when(F.length(value) == 10, padded).otherwise(written)).otherwise(result)
    return result


def hex_key(value: Column, key: str) -> Column:
    """Ten digits at a time, each stretch with its own permutation; a run of one letter or digit is no key."""
    low = F.lower(value)
    starts = F.sequence(F.lit(1), F.length(low) - 1, F.lit(10))

    def stretch(at, i):
        last = F.length(low) - at < 11
        return permuted_digits(F.substr(low, at, F.when(last, F.length(low)).otherwise(F.lit(10))), 16, key, F.concat(F.lit("hex"), i.cast("string")))

    # a last single digit belongs to the stretch before it
    cut = F.filter(starts, lambda at: (F.length(low) - at >= 1) & ((at == 1) | (F.length(low) - at >= 2) | (F.length(low) % 10 != 1)))
    out = F.array_join(F.transform(cut, stretch), "")
    mixed = low.rlike("[0-9]") & low.rlike("[a-f]") & ~low.rlike("^(.)\\1*$")
    return F.when(mixed, F.when(value == low, out).otherwise(F.upper(out)))


def email(value: Column, key: str) -> Column:
    def keyed(part, n):
        return F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(part), F.lit(key)), 256), 1, n)

    return F.concat(F.lit("u"), keyed(value, 12), F.lit("@h"), keyed(F.substring_index(value, "@", -1), 8), F.lit(".invalid"))


KINDS = {"email": email, "phone": phone, "date": date, "ip": ip, "ssn": ssn, "hex": hex_key, "card": cards}


def pseudonym(value: Column, key: str) -> Column:
    """The value's pseudonym, by the first form that it has; itself where it isn't valid."""
    out = value
    for kind in reversed(KINDS):
        out = F.when(value.rlike(f"^(?:{FORMS[kind]})$"), F.coalesce(KINDS[kind](value, key), value)).otherwise(out)
    return out


def with_pseudonyms(docs: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """`docs` with the private values in column `text` replaced. Rows stay where they are: nothing is shuffled."""
    body = F.col(text)
    whole = exchanged(body, ANY, lambda v: pseudonym(v, key))
    return docs.withColumn(text, F.when(body.rlike(MAYBE), whole).otherwise(body))
