"""Typed column values. Errors and unbound variables are both NULL, so SPARQL's logic is SQL's."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadlake import terms as R

#: Kinds: int, dec, dbl, str, bool, ts, date, iri (text), key (IRI by prefix and native key), bnode (label), term.
NUMBERS = ("int", "dec", "dbl")
DATATYPES = {"int": R.INTEGER, "dec": R.DECIMAL, "dbl": R.DOUBLE, "str": R.STRING, "bool": R.BOOLEAN, "ts": R.DATETIME, "date": R.DATE}
NUMERIC_DTS = (*R.NUMERIC, *R.DERIVED)
DECIMAL_TYPE = "decimal(38,12)"


@dataclass
class Val:
    kind: str
    col: Column
    prefix: str = ""  # of kind key; of kind iri what all values begin with, as far as that is known
    text: str | None = None  # of a constant string

    def null_when(self, cond: Column) -> Val:
        return Val(self.kind, F.when(~cond, self.col), self.prefix)


def bind(cols: list[Column], body) -> Column:
    """`body` of columns that are evaluated once. Without it nested expressions over terms grow exponentially."""
    row = F.struct(*[c.alias(f"a{i}") for i, c in enumerate(cols)])
    return F.transform(F.array(row), lambda r: body(*[r[f"a{i}"] for i in range(len(cols))]))[0]


def null() -> Val:
    return Val("term", F.lit(None).cast(R.TERM))


def constant(term) -> Val:
    """A ground term; natively where its lexical form is in the datatype's value space."""
    if isinstance(term, R.IRI):
        return Val("iri", F.lit(term.value))
    if isinstance(term, R.Lit) and not term.lang:
        try:
            if term.dt == R.INTEGER and abs(int(term.lex)) < 2**63 and str(int(term.lex)) == term.lex:
                return Val("int", F.lit(int(term.lex)).cast("bigint"))
            if term.dt == R.DOUBLE:
                return Val("dbl", F.lit(float(term.lex.replace("INF", "inf"))))
        except ValueError:
            pass
        if term.dt == R.DECIMAL and _plain_decimal(term.lex):
            return Val("dec", F.lit(term.lex).cast(DECIMAL_TYPE))
        if term.dt == R.STRING:
            return Val("str", F.lit(term.lex), text=term.lex)
        if term.dt == R.BOOLEAN and term.lex in ("true", "false"):
            return Val("bool", F.lit(term.lex == "true"))
        if term.dt == R.DATETIME and len(term.lex) == 19 and "T" in term.lex:
            return Val("ts", F.lit(term.lex).cast("timestamp_ntz"))
        if term.dt == R.DATE and len(term.lex) == 10:
            return Val("date", F.lit(term.lex).cast("date"))
    return Val("term", R.term_lit(term))


def _plain_decimal(text: str) -> bool:
    whole, _, fraction = text.lstrip("+-").partition(".")
    return (whole + fraction).isdigit() and len(whole) <= 26 and len(fraction) <= 12


def decimal_text(col: Column) -> Column:
    """Canonical xsd:decimal: no closing zeros, at least one digit after the point."""
    text = F.regexp_replace(F.regexp_replace(col.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(text.contains("."), text).otherwise(F.concat(text, F.lit(".0")))


def double_text(col: Column) -> Column:
    """Canonical xsd:double: one digit before the point, E notation."""
    return bind([col], _double_text)


def _double_text(col: Column) -> Column:
    raw = F.upper(F.abs(col).cast("string"))
    mantissa, exponent = F.substring_index(raw, "E", 1), F.when(raw.contains("E"), F.substring_index(raw, "E", -1)).otherwise(F.lit("0")).cast("int")
    whole, part = F.substring_index(mantissa, ".", 1), F.substring_index(mantissa, ".", -1)
    digits = F.regexp_replace(F.concat(whole, part), "^0+", "")
    leading = F.length(F.concat(whole, part)) - F.length(digits)
    power = F.length(whole) - 1 - leading + exponent
    trimmed = F.regexp_replace(digits, "0+$", "")
    tail = F.when(F.length(trimmed) > 1, F.substring(trimmed, F.lit(2), F.length(trimmed))).otherwise(F.lit("0"))
    text = F.concat(F.when(col < 0, F.lit("-")).otherwise(F.lit("")), F.substring(trimmed, 1, 1), F.lit("."), tail, F.lit("E"), power.cast("string"))
    return F.when(F.isnan(col), F.lit("NaN")).when(col == float("inf"), F.lit("INF")).when(col == float("-inf"), F.lit("-INF")).when(col == 0, F.lit("0.0E0")).otherwise(text)


def timestamp_text(col: Column) -> Column:
    base = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.regexp_replace(F.date_format(col, "SSSSSS"), "0+$", "")
    return F.when(fraction != "", F.concat(base, F.lit("."), fraction)).otherwise(base)


def text_of(v: Val) -> Column:
    """The lexical form, IRI or label."""
    if v.kind == "term":
        return v.col["lex"]
    if v.kind == "key":
        return F.concat(F.lit(v.prefix), v.col.cast("string"))
    if v.kind == "dec":
        return decimal_text(v.col)
    if v.kind == "dbl":
        return double_text(v.col.cast("double"))
    if v.kind == "ts":
        return timestamp_text(v.col)
    return v.col if v.kind in ("str", "iri", "bnode") else v.col.cast("string")


def to_term(v: Val) -> Column:
    if v.kind == "term":
        return v.col
    if v.kind in ("iri", "key"):
        return R.iri(text_of(v))
    if v.kind == "bnode":
        return R.bnode(v.col)
    return R.literal(text_of(v), DATATYPES[v.kind])


def is_number(t: Column) -> Column:
    return (t["kind"] == R.LITERAL) & t["dt"].isin(*NUMERIC_DTS) & number(t).isNotNull()


_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def number(t: Column) -> Column:
    """A term's value as a double; null unless it is a valid number."""
    lex = t["lex"]
    special = F.when(lex == "NaN", float("nan")).when(lex.isin("INF", "+INF"), float("inf")).when(lex == "-INF", float("-inf"))
    whole = ~t["dt"].isin(R.DECIMAL, R.DOUBLE, R.FLOAT)
    valid = F.when(whole, lex.rlike(r"^\s*[+-]?\d+\s*$")).when(t["dt"] == R.DECIMAL, lex.rlike(r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)\s*$")).otherwise(lex.rlike(_NUMBER))
    value = F.when(valid, F.expr("0D") + lex.try_cast("double")).when(t["dt"].isin(R.DOUBLE, R.FLOAT), special)
    return F.when((t["kind"] == R.LITERAL) & t["dt"].isin(*NUMERIC_DTS), value)


def exact(t: Column) -> Column:
    """An integer or decimal term's exact value; null otherwise."""
    return F.when(number(t).isNotNull() & ~t["dt"].isin(R.DOUBLE, R.FLOAT), F.trim(t["lex"]).try_cast(DECIMAL_TYPE))


def rank(t: Column) -> Column:
    """Place in the numeric promotion order: integer 0, decimal 1, float 2, double 3."""
    return F.when(t["dt"] == R.DECIMAL, 1).when(t["dt"] == R.FLOAT, 2).when(t["dt"] == R.DOUBLE, 3).otherwise(0)


def instant(t: Column) -> Column:
    """A dateTime or date as microseconds since 1970; without a zone it counts as UTC."""
    lex = F.when(t["dt"] == R.DATE, F.concat(F.substring(t["lex"], 1, 10), F.lit("T00:00:00"), F.substring(t["lex"], F.lit(11), F.length(t["lex"])))).otherwise(t["lex"])
    zoned = F.when(lex.rlike(r"(Z|[+-]\d\d:\d\d)$"), lex).otherwise(F.concat(lex, F.lit("Z")))
    return F.when(t["dt"].isin(R.DATETIME, R.DATE), F.unix_micros(zoned.try_cast("timestamp")))


def native_number(v: Val) -> Val | None:
    return v if v.kind in NUMBERS else None


def as_double(v: Val) -> Column:
    if v.kind in NUMBERS:
        return v.col.cast("double")
    return number(to_term(v)) if v.kind == "term" else F.lit(None).cast("double")


def ebv(v: Val) -> Column:
    """Effective boolean value; null is a type error."""
    if v.kind == "bool":
        return v.col
    if v.kind == "str":
        return v.col != ""
    if v.kind == "dbl":
        return (v.col != 0) & ~F.isnan(v.col)
    if v.kind in NUMBERS:
        return v.col != 0
    if v.kind == "term":
        return bind([v.col], _term_truth)
    return F.lit(None).cast("boolean")


def _term_truth(t: Column) -> Column:
    n = number(t)
    typed = F.when(t["dt"] == R.BOOLEAN, F.when(t["lex"].isin("true", "1"), F.lit(True)).otherwise(F.lit(False))).when(t["dt"] == R.STRING, t["lex"] != "")
    return F.when(t["kind"] == R.LITERAL, typed.when(t["dt"].isin(*NUMERIC_DTS), F.coalesce((n != 0) & ~F.isnan(n), F.lit(False))))


def same_term(a: Val, b: Val) -> Column:
    """Term identity; null if either is unbound."""
    if a.kind == b.kind and a.kind in ("key", "iri", "bnode", "int", "str", "bool", "ts", "date", "dec", "dbl", "term"):
        if a.kind != "key" or a.prefix == b.prefix:
            return a.col == b.col
    if apart(a, b):
        return _never(a, b)
    if a.kind in ("iri", "key") and b.kind in ("iri", "key"):
        return text_of(a) == text_of(b)
    return to_term(a) == to_term(b)


def apart(a, b) -> bool:
    """Whether kinds and prefixes alone (of a Val or an Info) tell that no term is a value of both."""
    if "term" in (a.kind, b.kind):
        return False
    if a.kind in ("iri", "key") and b.kind in ("iri", "key"):
        return not (a.prefix.startswith(b.prefix) or b.prefix.startswith(a.prefix))
    return a.kind != b.kind


def _never(a: Val, b: Val) -> Column:
    return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))


def equal(a: Val, b: Val) -> Column:
    """The = operator."""
    if a.kind in NUMBERS and b.kind in NUMBERS:
        x, y = _pair(a, b)
        return x == y
    if a.kind in ("ts", "date") and b.kind in ("ts", "date"):
        return a.col.cast("timestamp_ntz") == b.col.cast("timestamp_ntz")
    if "term" in (a.kind, b.kind):
        return bind([to_term(a), to_term(b)], _equal_terms)
    return same_term(a, b)


def _equal_terms(x: Column, y: Column) -> Column:
    nx, ny, ex, ey, tx, ty = number(x), number(y), exact(x), exact(y), instant(x), instant(y)
    booleans = (x["dt"] == R.BOOLEAN) & (y["dt"] == R.BOOLEAN)
    value = F.when(x["kind"] != y["kind"], F.lit(False)).when(ex.isNotNull() & ey.isNotNull(), ex == ey).when(nx.isNotNull() & ny.isNotNull(), (nx == ny) & ~F.isnan(nx) & ~F.isnan(ny))
    value = value.when(tx.isNotNull() & ty.isNotNull(), tx == ty).when(booleans, x["lex"].isin("true", "1") == y["lex"].isin("true", "1")).otherwise(x == y)
    return F.when(x.isNotNull() & y.isNotNull(), value)


def _less_terms(x: Column, y: Column) -> Column:
    nx, ny, ex, ey, tx, ty = number(x), number(y), exact(x), exact(y), instant(x), instant(y)
    plain = (x["dt"] == R.STRING) & (y["dt"] == R.STRING)
    booleans = (x["dt"] == R.BOOLEAN) & (y["dt"] == R.BOOLEAN)
    value = F.when(ex.isNotNull() & ey.isNotNull(), ex < ey).when(nx.isNotNull() & ny.isNotNull(), (nx < ny) & ~F.isnan(nx) & ~F.isnan(ny)).when(tx.isNotNull() & ty.isNotNull(), tx < ty)
    return value.when(plain, x["lex"] < y["lex"]).when(booleans, ~x["lex"].isin("true", "1") & y["lex"].isin("true", "1"))


def _pair(a: Val, b: Val) -> tuple[Column, Column]:
    """Two native numbers in their common type."""
    if "dbl" in (a.kind, b.kind):
        return a.col.cast("double"), b.col.cast("double")
    return a.col, b.col


def less(a: Val, b: Val) -> Column:
    """a < b; null where the operator is not defined."""
    if a.kind in NUMBERS and b.kind in NUMBERS:
        x, y = _pair(a, b)
        return x < y
    if a.kind == b.kind and a.kind in ("str", "bool"):
        return a.col < b.col
    if a.kind in ("ts", "date") and b.kind in ("ts", "date"):
        return a.col.cast("timestamp_ntz") < b.col.cast("timestamp_ntz")
    if "term" in (a.kind, b.kind):
        return bind([to_term(a), to_term(b)], _less_terms)
    return F.lit(None).cast("boolean")


def from_number(value: Column, place: Column) -> Column:
    """A numeric term from a double and its promotion rank; integers and decimals come exact through `value`."""
    return F.when(place >= 2, R.literal(double_text(value.cast("double")), F.when(place == 2, F.lit(R.FLOAT)).otherwise(F.lit(R.DOUBLE))))


def arithmetic(op: str, a: Val, b: Val, exact_integers: bool = False) -> Val:
    """+ - * / with numeric promotion; integer / integer is a decimal. With `exact_integers` integers of more than 64 bits stay exact."""
    call = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[op]
    if a.kind in NUMBERS and b.kind in NUMBERS:
        if "dbl" in (a.kind, b.kind):
            x, y = a.col.cast("double"), b.col.cast("double")
            return Val("dbl", F.when(y != 0, x / y) if op == "/" else {"+": x + y, "-": x - y, "*": x * y}[op])
        if a.kind == b.kind == "int" and op != "/" and exact_integers:
            return Val("term", bind([to_term(a), to_term(b)], lambda x, y: _term_arithmetic(op, call, x, y)))
        if a.kind == b.kind == "int" and op != "/":
            return Val("int", call(a.col.cast("bigint"), b.col.cast("bigint")))
        return Val("dec", call(a.col.cast(DECIMAL_TYPE), b.col.cast(DECIMAL_TYPE)).cast(DECIMAL_TYPE))
    return Val("term", bind([to_term(a), to_term(b)], lambda x, y: _term_arithmetic(op, call, x, y)))


def _term_arithmetic(op: str, call, x: Column, y: Column) -> Column:
    nx, ny, ex, ey = number(x), number(y), exact(x), exact(y)
    place = F.greatest(rank(x), rank(y), F.lit(1 if op == "/" else 0))
    fast = {"+": nx + ny, "-": nx - ny, "*": nx * ny, "/": F.when(ny != 0, nx / ny)}[op]
    slow = call(ex, ey).cast(DECIMAL_TYPE)
    # Whole numbers have all 38 digits to themselves.
    wholes = call(*(F.trim(t["lex"]).try_cast("decimal(38,0)") for t in (x, y))).cast("decimal(38,0)") if op != "/" else F.lit(None).cast("decimal(38,0)")

    def spell(p, f, d, n):
        return F.when(p >= 2, from_number(f, p)).when(p == 0, R.literal(n.cast("string"), R.INTEGER)).otherwise(R.literal(decimal_text(d), R.DECIMAL))

    return F.when(nx.isNotNull() & ny.isNotNull(), bind([place, fast, slow, F.when(place == 0, wholes)], spell))


def lift(v: Val, kind: str) -> Column:
    """`v` in another representation of the same term."""
    if v.kind == kind:
        return v.col
    if kind == "iri" and v.kind == "key":
        return text_of(v)
    return to_term(v)


def common(vals: list[Val]) -> tuple[str, str]:
    """(kind, prefix) that holds all values without loss."""
    kinds = {(v.kind, v.prefix) for v in vals}
    if len(kinds) == 1:
        return next(iter(kinds))
    if {k for k, _ in kinds} <= {"iri", "key"}:
        return "iri", ""
    return "term", ""


def term_key(t: Column) -> Column:
    """A struct that orders terms; all numbers form one group at one place."""
    n = number(t)
    return F.struct(t["kind"].alias("k"), F.when(n.isNotNull(), F.lit(R.DECIMAL)).otherwise(t["dt"]).alias("g"), n.alias("n"), instant(t).alias("t"), t["lex"].alias("x"), t["dt"].alias("d"), t["lang"].alias("l"), t["dir"].alias("r"))


def order_keys(v: Val, ascending: bool) -> list[Column]:
    """Sort columns of the total order: unbound, blank nodes, IRIs, literals, triple terms."""
    if v.kind == "term":
        keys = [F.when(v.col.isNotNull(), bind([v.col], term_key))]
    elif v.kind == "key":
        keys = [text_of(v)]
    else:
        keys = [v.col]
    return [k.asc_nulls_first() if ascending else k.desc_nulls_last() for k in keys]
