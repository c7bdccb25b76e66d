"""Format-preserving pseudonyms for personal data, by keyed Feistel networks.

One pattern finds candidates. Each is validated (Luhn and issuer range, IBAN mod 97, calendar,
octet and area ranges); what fails stays as it is. A valid value is permuted within its own format
under the key: separators, letter case, issuer digits and check digits stay well-formed, and equal values give
equal pseudonyms in every document, however they are written. Three networks cover all formats:

* symbol strings (card payloads, phone digits, mail names, tokens): two halves, symbolwise
  addition of a SHA-256 key stream modulo the alphabet, an even number of rounds;
* pairs of residues (dates as day numbers, IPv4, SSN): Z_a x Z_b with domains that factor exactly,
  so there is no cycle walking;
* check digits are recomputed from the permuted payload.

Everything is DataFrame expressions; there is no shuffle, so hot values cost nothing.

Edge cases: a null text stays null with no replacement; an empty text stays empty; very long texts are read whole
and no pattern repeats without bound; text outside the matches is never touched; repeated rows get equal results; extra columns pass through unless they
have the name of an added column, which is replaced; an empty table gives an empty result. A
permutation may map a value to itself, about as often as 1 in the size of its format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.llm._common import table

ROUNDS = 8
#: Replace in production: whoever holds it can invert the pseudonyms.
DEFAULT_KEY = "quadlake-demo-key"

#: A domain has at most 127 labels; the bound also keeps the matcher's stack short on very long ones.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]+\.){1,126}[A-Za-z]{2,24}"
PHONE = r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9A-Za-z])"
IP = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"
DATE = r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9A-Za-z]|[./-][0-9])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
CARD = r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"
TOKEN = r"(?<=[kK][eE][yYnN] ?[=:] ?\"?)[0-9a-fA-F]{16,64}(?![0-9A-Za-z])"
PATTERN = "|".join((EMAIL, PHONE, IP, DATE, SSN, IBAN, CARD, TOKEN))
#: What every match of PATTERN needs: an "@", a digit, or the prefix of a token (whose digits may all be letters).
NEEDED = r"[@0-9]|[kK][eE][yYnN] ?[=:]"

DIGITS = "0123456789"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
HEX = "0123456789abcdef"

#: Dates are permuted within 1904-01-01 to 2099-12-31, 49 cycles of 1461 days, or within all other days of the years 1 to 9999.
EPOCH, DATE_RADICES = "1904-01-01", (49, 1461)
OLDEST, OTHER_RADICES = "0001-01-01", (1335, 2682)


def _digest(key: str, tweak: Column | str, round_: Column, value: Column) -> Column:
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak
    return F.sha2(F.concat_ws("|", F.lit(key), tweak, round_.cast("string"), value), 256)


def _shift(symbols: Column, stream: Column, alphabet: str) -> Column:
    """Add the key stream to a string of symbols, position by position."""

    def one(char, i):
        step = F.conv(F.substring(stream, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        return F.substring(F.lit(alphabet), F.pmod(F.instr(F.lit(alphabet), char) - 1 + step, F.lit(len(alphabet))) + 1, F.lit(1))

    return F.when(F.length(symbols) == 0, F.lit("")).otherwise(F.array_join(F.transform(F.split(symbols, ""), one), ""))


def permute_symbols(symbols: Column, alphabet: str, key: str, tweak: Column | str) -> Column:
    """A keyed permutation of the strings of this length over `alphabet` (at most 64 symbols)."""
    half = F.floor(F.length(symbols) / 2).cast("int")
    start = F.struct(F.substring(symbols, F.lit(1), half).alias("l"), F.substring(symbols, half + 1, F.length(symbols)).alias("r"))

    def step(acc, i):
        return F.struct(acc["r"].alias("l"), _shift(acc["l"], _digest(key, tweak, i, acc["r"]), alphabet).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda acc: F.concat(acc["l"], acc["r"]))


def permute_pair(a: Column, b: Column, radices: tuple[int, int], key: str, tweak: str) -> Column:
    """A keyed permutation of Z_a x Z_b, as struct(x, y)."""
    long = "long"
    start = F.struct(a.cast(long).alias("x"), b.cast(long).alias("y"), F.lit(radices[0]).cast(long).alias("p"), F.lit(radices[1]).cast(long).alias("q"))

    def step(acc, i):
        add = F.conv(F.substring(_digest(key, tweak, i, acc["y"].cast("string")), 1, 14), 16, 10).cast(long)
        return F.struct(acc["y"].alias("x"), F.pmod(acc["x"] + add, acc["p"]).alias("y"), acc["q"].alias("p"), acc["p"].alias("q"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda acc: F.struct(acc["x"].alias("x"), acc["y"].alias("y")))


def _only(text: Column, classes: str) -> Column:
    return F.regexp_replace(text, f"[^{classes}]", "")


def _refill(template: Column, classes: str, symbols: Column) -> Column:
    """`template` with its characters of a class replaced, in order, by `symbols`; letter case follows the template."""

    def one(char, i):
        at = F.length(_only(F.substring(template, F.lit(1), i + 1), classes))
        new = F.substring(symbols, at, F.lit(1))
        return F.when(char.rlike(f"[{classes}]"), F.when(char.rlike("[A-Z]"), F.upper(new)).otherwise(new)).otherwise(char)

    return F.array_join(F.transform(F.split(template, ""), one), "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit counts once."""

    def weigh(d, i):
        n = d.cast("int")
        twice = F.when(n > 4, n * 2 - 9).otherwise(n * 2)
        return F.when(i % 2 == 1, twice).otherwise(n)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), weigh), F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    """An alphanumeric string as a number (A = 10 ... Z = 35) modulo 97."""

    def step(acc, c):
        v = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.pmod(F.when(v < 10, acc * 10).otherwise(acc * 100) + v, F.lit(97))

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _let(value: Column, body) -> Column:
    """Bind an expression once: body(variable)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _card(m: Column, key: str) -> Column:
    def with_digits(d):
        keep = F.when(d.startswith("2"), F.lit(4)).otherwise(F.lit(2))
        issuer = d.rlike("^(4|5[1-5]|3[4-9]|30|6|2[2-7])")
        middle = F.substring(d, keep + 1, F.length(d) - keep - 1)

        def with_payload(body):
            check = F.pmod(F.lit(10) - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
            return _refill(m, "0-9", F.concat(body, check.cast("string")))

        fresh = _let(F.concat(F.substring(d, F.lit(1), keep), permute_symbols(middle, DIGITS, key, F.concat(F.lit("card"), F.substring(d, F.lit(1), keep)))), with_payload)
        return F.when(issuer & (F.pmod(luhn_sum(d), F.lit(10)) == 0), fresh).otherwise(m)

    return _let(_only(m, "0-9"), with_digits)


def _phone(m: Column, key: str) -> Column:
    country = F.regexp_extract(m, r"^\+[0-9]{1,3}", 0)
    rest = F.substring(m, F.length(country) + 1, F.length(m))
    return F.concat(country, _refill(rest, "0-9", permute_symbols(_only(rest, "0-9"), DIGITS, key, "phone")))


def _email(m: Column, key: str) -> Column:
    domain = F.lower(F.substring_index(m, "@", -1))
    name = F.substring_index(m, "@", 1)
    letters = permute_symbols(F.lower(_only(name, "A-Za-z")), LETTERS, key, F.concat(F.lit("mail"), domain, _only(name, "0-9")))
    digits = permute_symbols(_only(name, "0-9"), DIGITS, key, F.concat(F.lit("mail"), domain))
    return F.concat(_refill(_refill(name, "A-Za-z", letters), "0-9", digits), F.lit("@"), F.substring_index(m, "@", -1))


def _ip(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    mixed = permute_pair(parts[0] * 256 + parts[1], parts[2] * 256 + parts[3], (65536, 65536), key, "ip")
    fresh = _let(mixed, lambda p: F.concat_ws(".", F.floor(p["x"] / 256).cast("string"), F.pmod(p["x"], F.lit(256)).cast("string"), F.floor(p["y"] / 256).cast("string"), F.pmod(p["y"], F.lit(256)).cast("string")))
    return F.when(F.forall(parts, lambda x: x <= 255), fresh).otherwise(m)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.split(m, "-")[i].cast("int") for i in range(3))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    mixed = permute_pair(index, (group - 1) * 9999 + serial - 1, (898, 99 * 9999), key, "ssn")

    def spell(p):
        new_area = F.when(p["x"] >= 665, p["x"] + 2).otherwise(p["x"] + 1)
        return F.concat_ws("-", F.lpad(new_area.cast("string"), 3, "0"), F.lpad((F.floor(p["y"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(p["y"], F.lit(9999)) + 1).cast("string"), 4, "0"))

    return F.when(valid, _let(mixed, spell)).otherwise(m)


def _date(m: Column, key: str) -> Column:
    recent, other = DATE_RADICES[0] * DATE_RADICES[1], OTHER_RADICES[0] * OTHER_RADICES[1]
    epoch, oldest = F.to_date(F.lit(EPOCH)), F.to_date(F.lit(OLDEST))

    def pair(index: Column, radices: tuple[int, int], tweak: str, spell) -> Column:
        mixed = permute_pair(F.floor(index / radices[1]), F.pmod(index, F.lit(radices[1])), radices, key, tweak)
        return _let(mixed, lambda p: spell((p["x"] * radices[1] + p["y"]).cast("int")))

    def under(form: str) -> Column:
        day = F.try_to_timestamp(m, F.lit(form)).cast("date")
        near, far, before = F.datediff(day, epoch), F.datediff(day, oldest), F.datediff(epoch, oldest)
        index = F.when(near < 0, far).otherwise(far - recent)  # among the other days, without a gap
        inside = pair(near, DATE_RADICES, "date", lambda n: F.date_format(F.date_add(epoch, n), form))
        outside = pair(index, OTHER_RADICES, "day", lambda n: F.date_format(F.date_add(oldest, F.when(n < before, n).otherwise(n + recent)), form))
        return F.when((near >= 0) & (near < recent), inside).when((index >= 0) & (index < other), outside)

    iso, dotted = under("yyyy-MM-dd"), under("dd.MM.yyyy")
    slashed = F.coalesce(under("MM/dd/yyyy"), under("dd/MM/yyyy"))
    return F.coalesce(F.when(m.contains("-"), iso).when(m.contains("."), dotted).otherwise(slashed), m)


def _iban(m: Column, key: str) -> Column:
    def with_plain(p):
        country, body = F.substring(p, 1, 2), F.substring(p, F.lit(5), F.length(p))
        letters = permute_symbols(F.lower(_only(body, "A-Z")), LETTERS, key, F.concat(F.lit("iban"), country, _only(body, "0-9")))
        digits = permute_symbols(_only(body, "0-9"), DIGITS, key, F.concat(F.lit("iban"), country))

        def with_body(b):
            check = F.lpad((F.lit(98) - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
            fresh = F.concat(country, check, b)
            return F.array_join(F.transform(F.split(m, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substring(fresh, F.length(_only(F.substring(m, F.lit(1), i + 1), "A-Z0-9")), F.lit(1)))), "")

        fresh = _let(_refill(_refill(body, "A-Z", letters), "0-9", digits), with_body)
        return F.when(_mod97(F.concat(body, F.substring(p, 1, 4))) == 1, fresh).otherwise(m)

    return _let(_only(m, "A-Z0-9"), with_plain)


def _token(m: Column, key: str) -> Column:
    return _let(permute_symbols(F.lower(m), HEX, key, "token"), lambda fresh: F.when(m.rlike("[A-F]"), F.upper(fresh)).otherwise(fresh))


def pseudonym(m: Column, key: str) -> Column:
    """The replacement of one match of PATTERN; the match itself if it fails validation."""
    return (
        F.when(m.contains("@"), _email(m, key))
        .when(m.rlike(r"^[+(]"), _phone(m, key))
        .when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), _ip(m, key))
        .when(m.rlike(r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})$"), _date(m, key))
        .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), _ssn(m, key))
        .when(m.rlike(r"^[A-Z]{2}[0-9]{2}[ A-Z0-9]{8,}$"), _iban(m, key))
        .when(m.rlike(r"^[0-9 -]{13,37}$") & (F.length(_only(m, "0-9")) <= 19), _card(m, key))
        .otherwise(_token(m, key))
    )


def pseudonymize(docs: DataFrame, text: str = "text", key: str = DEFAULT_KEY, count: str = "n_replaced") -> DataFrame:
    """`docs` with its text column pseudonymized and the number of replaced values in `count`."""
    kept = [c for c in docs.columns if c != count]
    body = F.col("body")
    suspect = body.rlike(NEEDED)
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(text).cast("string").alias("body"))
    marked = marked.withColumn("found", F.when(suspect, F.regexp_extract_all(body, F.lit(PATTERN), 0)))
    hit = F.coalesce(F.size("found"), F.lit(0)) > 0
    marked = marked.withColumn("fresh", F.when(hit, F.transform("found", lambda m: pseudonym(m, key))))
    gaps = F.split(body, PATTERN, -1)
    woven = F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size("found")), F.col("fresh"), lambda gap, new: F.concat(gap, new)), ""), F.element_at(gaps, -1))
    changed = F.aggregate(F.zip_with("found", "fresh", lambda old, new: F.when(old != new, 1).otherwise(0)), F.lit(0), lambda a, x: a + x)
    columns = [F.when(hit, woven).otherwise(body).alias(c) if c == text else F.col("row")[c].alias(c) for c in kept]
    return marked.select(*columns, F.when(hit, changed).otherwise(F.lit(0)).alias(count))


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """doc_id, text (pseudonymized), n_replaced of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymize(docs).select("doc_id", "text", "n_replaced")
