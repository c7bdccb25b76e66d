"""Values that an earlier gate left in clear, very long texts, and an exact round trip by an independent decoder."""

import datetime
import hashlib
import re

from quadlake.llm import pii

KEY = pii.DEFAULT_KEY


def test_values_without_adjacent_digits(spark):
    texts = ["dns 8.8.8.8", "1.1.1.1", "key=a1b2c3d4e5f6a7b8", "key: abcdefabcdefabcd", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "no 1 thing"]
    long = [f"{t} and 12 more" for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts + long)), "doc_id long, text string")
    out = {r.doc_id: r for r in pii.pseudonymize(docs).collect()}
    for i, text in enumerate(texts):
        alone, along = out[i], out[i + len(texts)]
        assert along.text == alone.text + " and 12 more" and along.n_replaced == alone.n_replaced == (i < 5)
        assert (alone.text != text) == (i < 5)


def test_very_long_texts(spark):
    """A domain of a million labels, long runs of what values are made of, and a million characters around a value."""
    labels = "ab." * 1_000_000
    texts = [f"x mail.name@{labels}com y", "1" * 1_000_000, "1-" * 500_000, "a@" * 500_000, "word " * 200_000 + "8.8.8.8", "DE" * 500_000, "1.1." * 250_000, "+1 " * 300_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in pii.pseudonymize(docs).collect()}
    assert all(len(out[i].text) >= len(t) - 8 for i, t in enumerate(texts))
    assert out[4].n_replaced == 1 and out[1].text == texts[1] and out[5].text == texts[5]


def digest(tweak, i, value):
    return hashlib.sha256("|".join((KEY, tweak, str(i), value)).encode()).hexdigest()


def unpair(x, y, radices, tweak):
    """The inverse of a network on pairs of residues."""
    moduli = list(radices) if pii.ROUNDS % 2 == 0 else list(radices)[::-1]
    for i in range(pii.ROUNDS, 0, -1):
        p, q = moduli[1], moduli[0]  # the radices before this round, swapped by it
        before = (y - int(digest(tweak, i, str(x))[:14], 16)) % p
        x, y, moduli = before, x, [p, q]
    return x, y


def unstring(text, alphabet, tweak):
    """The inverse of a network on strings of symbols."""
    lengths = [(len(text) // 2, len(text) - len(text) // 2)]
    for _ in range(pii.ROUNDS):
        lengths.append(lengths[-1][::-1])
    left, right = text[: lengths[-1][0]], text[lengths[-1][0] :]
    for i in range(pii.ROUNDS, 0, -1):
        stream = digest(tweak, i, left)
        back = "".join(alphabet[(alphabet.index(c) - int(stream[2 * k : 2 * k + 2], 16)) % len(alphabet)] for k, c in enumerate(right))
        left, right = back, left
    return left + right


def test_round_trip(spark):
    rows = [
        "born 1984-02-29 or 0001-01-01 or 9999-12-31 or 1903-12-31 or 2100-01-01 or 1904-01-01 or 2099-12-31 or 1600-06-15",
        "ip 97.51.17.173 and 0.0.0.0 and 255.255.255.255",
        "ssn 123-45-6789 and 899-99-9999 and 001-01-0001",
        "token = 04dbebab91ab85687d33eeaaf9ac699e1188f962",
        "call +1 (017) 555-7713 or +44 20 7946 0958",
    ]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = [r.text for r in sorted(pii.pseudonymize(docs).collect(), key=lambda r: r.doc_id)]
    epoch, oldest = datetime.date(1904, 1, 1), datetime.date(1, 1, 1)
    recent, before = pii.DATE_RADICES[0] * pii.DATE_RADICES[1], (epoch - oldest).days
    assert recent + pii.OTHER_RADICES[0] * pii.OTHER_RADICES[1] == (datetime.date(9999, 12, 31) - oldest).days + 1

    def undate(m):
        day = datetime.date.fromisoformat(m.group())
        n = (day - epoch).days
        if 0 <= n < recent:
            a, b = unpair(*divmod(n, pii.DATE_RADICES[1]), pii.DATE_RADICES, "date")
            return (epoch + datetime.timedelta(a * pii.DATE_RADICES[1] + b)).isoformat()
        index = (day - oldest).days
        a, b = unpair(*divmod(index if index < before else index - recent, pii.OTHER_RADICES[1]), pii.OTHER_RADICES, "day")
        index = a * pii.OTHER_RADICES[1] + b
        return (oldest + datetime.timedelta(index if index < before else index + recent)).isoformat()

    assert re.sub(r"\d{4}-\d\d-\d\d", undate, out[0]) == rows[0] and out[0] != rows[0]

    def unip(m):
        a, b, c, d = map(int, m.group().split("."))
        x, y = unpair(a * 256 + b, c * 256 + d, (65536, 65536), "ip")
        return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"

    assert re.sub(r"[\d.]{7,}", unip, out[1]) == rows[1] and out[1] != rows[1]

    def unssn(m):
        area, group, serial = map(int, m.group().split("-"))
        x, y = unpair(area - 2 if area > 666 else area - 1, (group - 1) * 9999 + serial - 1, (898, 99 * 9999), "ssn")
        return f"{x + 2 if x >= 665 else x + 1:03}-{y // 9999 + 1:02}-{y % 9999 + 1:04}"

    assert re.sub(r"\d{3}-\d\d-\d{4}", unssn, out[2]) == rows[2] and out[2] != rows[2]
    assert re.sub(r"[0-9a-f]{16,}", lambda m: unstring(m.group(), pii.HEX, "token"), out[3]) == rows[3] and out[3] != rows[3]

    def unphone(m):
        country, rest = re.match(r"(\+\d+)(.*)", m.group()).groups()
        digits = iter(unstring(re.sub(r"\D", "", rest), pii.DIGITS, "phone"))
        return country + re.sub(r"\d", lambda _: next(digits), rest)

    assert re.sub(r"\+\d+[ ()\d-]*\d", unphone, out[4]) == rows[4] and out[4] != rows[4]
