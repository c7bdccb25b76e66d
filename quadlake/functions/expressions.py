"""SPARQL expressions to columns."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quadlake import terms as R
from quadlake.functions import values as V
from quadlake.functions.values import Val


@dataclass
class Context:
    """What an expression may refer to besides its row."""

    base: str = ""
    now: str = field(default_factory=lambda: datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ"))
    functions: dict[str, Callable] = field(default_factory=dict)
    exact_integers: bool = False


#: Functions that may also be called by an IRI with this local name.
ALIASES = {"uuid": "UUID", "struuid": "STRUUID", "md5": "MD5", "sha1": "SHA1", "sha256": "SHA256", "sha384": "SHA384", "sha512": "SHA512", "concat": "CONCAT", "strlen": "STRLEN", "substr": "SUBSTR", "now": "NOW"}


class Expressions:
    def __init__(self, env: dict[str, Val], context: Context, flags: dict[int, Column] | None = None, aggregates: dict[tuple, Val] | None = None):
        self.env, self.context = env, context
        self.flags, self.aggregates = flags or {}, aggregates or {}

    def value(self, e: tuple) -> Val:
        kind = e[0]
        if kind == "var":
            return self.env.get(e[1]) or V.null()
        if kind == "term":
            return V.constant(e[1])
        if kind == "agg":
            return self.aggregates[freeze(e)]
        if kind == "exists":
            flag = F.coalesce(self.flags[id(e[1])], F.lit(False))
            return Val("bool", ~flag if e[2] else flag)
        if kind == "in":
            return Val("bool", self._in(e))
        if kind == "op":
            return self._operator(e[1], e[2])
        if kind == "call":
            return self._call(e[1], e[2])
        if kind == "fn":
            return self._function(e[1], [self.value(a) for a in e[2]], e[2])
        if kind == "triple":
            return self._triple([self.value(x) for x in e[1:]])
        raise ValueError(f"unknown expression {kind}")

    def truth(self, e: tuple) -> Column:
        return V.ebv(self.value(e))

    def _operator(self, op: str, args: list) -> Val:
        if op in ("&&", "||"):
            a, b = self.truth(args[0]), self.truth(args[1])
            return Val("bool", a & b if op == "&&" else a | b)
        if op == "!":
            return Val("bool", ~self.truth(args[0]))
        a = self.value(args[0])
        if op in ("u+", "u-"):
            zero = Val("int", F.lit(0).cast("bigint"))
            if a.kind == "dbl":
                return a if op == "u+" else Val("dbl", -a.col)
            return V.arithmetic("+" if op == "u+" else "-", zero, a, self.context.exact_integers)
        b = self.value(args[1])
        if op == "=":
            return Val("bool", V.equal(a, b))
        if op == "!=":
            return Val("bool", ~V.equal(a, b))
        if op in ("<", ">"):
            return Val("bool", V.less(a, b) if op == "<" else V.less(b, a))
        if op in ("<=", ">="):
            x, y = (a, b) if op == "<=" else (b, a)
            if x.kind in V.NUMBERS and y.kind in V.NUMBERS and x.kind == y.kind:
                return Val("bool", x.col <= y.col)
            low = V.less(x, y)
            return Val("bool", F.when(low.isNotNull(), low | V.equal(x, y)))
        return V.arithmetic(op, a, b, self.context.exact_integers)

    def _in(self, e) -> Column:
        left = self.value(e[1])
        found = F.lit(False)
        for item in e[2]:
            found = found | V.equal(left, self.value(item))
        return ~found if e[3] else found

    # ---- helpers of functions
    @staticmethod
    def _string(v: Val) -> Column:
        """Text of a string literal of any language; null for anything else."""
        if v.kind == "str":
            return v.col
        if v.kind == "term":
            t = v.col
            return F.when((t["kind"] == R.LITERAL) & t["dt"].isin(R.STRING, R.LANG_STRING, R.DIR_LANG_STRING), t["lex"])
        return F.lit(None).cast("string")

    @classmethod
    def _simple(cls, v: Val) -> Column:
        """Text of a plain string; null for anything else."""
        if v.kind == "term":
            return F.when((v.col["kind"] == R.LITERAL) & (v.col["dt"] == R.STRING), v.col["lex"])
        return cls._string(v)

    @classmethod
    def _like(cls, v: Val, text: Column) -> Val:
        """A string with the language of another."""
        if v.kind == "term":
            t = v.col
            return Val("term", F.when(cls._string(v).isNotNull(), R.literal(text, t["dt"], t["lang"], t["dir"])))
        return Val("str", text)

    @staticmethod
    def _compatible(a: Val, b: Val) -> Column:
        """May b be an argument to a? b is plain or has a's language."""
        if b.kind != "term":
            return F.lit(True)
        other = b.col
        own = (V.to_term(a)["lang"], V.to_term(a)["dir"])
        return (other["dt"] == R.STRING) | ((other["lang"] == own[0]) & (other["dir"] == own[1]))

    def _kind(self, v: Val, want: int) -> Column:
        if v.kind == "term":
            return v.col["kind"] == want
        have = {"iri": R.IRI_KIND, "key": R.IRI_KIND, "bnode": R.BNODE}.get(v.kind, R.LITERAL)
        return F.when(v.col.isNotNull(), F.lit(have == want))

    def _call(self, name: str, args: list) -> Val:
        if name == "BOUND":
            v = self.env.get(args[0][1])
            return Val("bool", v.col.isNotNull() if v else F.lit(False))
        if name == "COALESCE":
            vals = [self.value(a) for a in args if a[0] != "var" or a[1] in self.env]
            if not vals:
                return V.null()
            kind, prefix = V.common(vals)
            return Val(kind, F.coalesce(*[V.lift(v, kind) for v in vals]), prefix)
        if name == "IF":
            cond = self.truth(args[0])
            yes, no = self.value(args[1]), self.value(args[2])
            kind, prefix = V.common([yes, no])
            return Val(kind, F.when(cond.isNull(), F.lit(None)).when(cond, V.lift(yes, kind)).otherwise(V.lift(no, kind)), prefix)
        vals = [self.value(a) for a in args]
        return getattr(self, "_f_" + name.lower())(*vals)

    # ---- terms
    def _f_str(self, v):
        if v.kind == "term":
            return Val("str", F.when(v.col["kind"].isin(R.IRI_KIND, R.LITERAL), v.col["lex"]))
        return Val("str", V.text_of(v) if v.kind != "bnode" else F.lit(None).cast("string"))

    def _f_lang(self, v):
        if v.kind == "term":
            return Val("str", F.when(v.col["kind"] == R.LITERAL, v.col["lang"]))
        return Val("str", F.when(self._kind(v, R.LITERAL), F.lit("")))

    def _f_langdir(self, v):
        if v.kind == "term":
            return Val("str", F.when(v.col["kind"] == R.LITERAL, v.col["dir"]))
        return Val("str", F.when(self._kind(v, R.LITERAL), F.lit("")))

    def _f_langmatches(self, tag, span):
        a, b = F.lower(self._simple(tag)), F.lower(self._simple(span))
        return Val("bool", F.when(b == "*", a != "").otherwise((a == b) | a.startswith(F.concat(b, F.lit("-")))))

    def _f_haslang(self, v, tag=None, direction=None):
        has = F.when(self._f_lang(v).col.isNotNull(), self._f_lang(v).col != "")
        if tag is not None:
            has = has & (self._f_lang(v).col == F.lower(self._simple(tag)))
        if direction is not None:
            has = has & (self._f_langdir(v).col == self._simple(direction))
        return Val("bool", has)

    def _f_haslangdir(self, v):
        return Val("bool", self._f_langdir(v).col != "")

    def _f_datatype(self, v):
        if v.kind == "term":
            return Val("iri", F.when(v.col["kind"] == R.LITERAL, v.col["dt"]))
        dt = V.DATATYPES.get(v.kind)
        return Val("iri", F.when(v.col.isNotNull(), F.lit(dt)) if dt else F.lit(None).cast("string"))

    def _f_iri(self, v):
        if v.kind in ("iri", "key"):
            return v
        text = F.when(self._kind(v, R.IRI_KIND), V.text_of(v)).otherwise(self._simple(v)) if v.kind == "term" else self._simple(v)
        base = self.context.base
        if base:
            root = urljoin(base, "/")
            folder = urljoin(base, ".")
            text = F.when(text.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), text).when(text.startswith("//"), F.concat(F.lit(base.split(":")[0] + ":"), text)).when(text.startswith("/"), F.concat(F.lit(root.rstrip("/")), text)).when(text.startswith("#"), F.concat(F.lit(base.split("#")[0]), text)).when(text == "", F.lit(base)).otherwise(F.concat(F.lit(folder), text))
        return Val("iri", F.when(~text.rlike(r'[\x00-\x20<>"{}|^`\\]'), text))

    _f_uri = _f_iri

    def _f_bnode(self, v=None):
        uid = self.env["_row"].col
        if v is None:
            return Val("bnode", F.concat(F.lit("n"), F.md5(F.concat_ws(" ", uid, F.uuid()))))
        return Val("bnode", F.concat(F.lit("n"), F.md5(F.concat(uid, F.lit(" "), self._simple(v)))))

    def _f_strdt(self, v, dt):
        iri = V.text_of(dt) if dt.kind in ("iri", "key") else F.when(self._kind(dt, R.IRI_KIND), V.text_of(dt)) if dt.kind == "term" else F.lit(None).cast("string")
        return Val("term", F.when(~iri.isin(R.LANG_STRING, R.DIR_LANG_STRING), R.literal(self._simple(v), iri)))

    def _f_strlang(self, v, tag):
        lang = F.lower(self._simple(tag))
        return Val("term", F.when((lang != "") & self._simple(v).isNotNull(), R.literal(self._simple(v), R.LANG_STRING, lang)))

    def _f_strlangdir(self, v, tag, direction):
        lang, way = F.lower(self._simple(tag)), self._simple(direction)
        return Val("term", F.when((lang != "") & way.isin("ltr", "rtl") & self._simple(v).isNotNull(), R.literal(self._simple(v), R.DIR_LANG_STRING, lang, way)))

    def _f_sameterm(self, a, b):
        return Val("bool", V.same_term(a, b))

    def _f_isiri(self, v):
        return Val("bool", self._kind(v, R.IRI_KIND))

    _f_isuri = _f_isiri

    def _f_isblank(self, v):
        return Val("bool", self._kind(v, R.BNODE))

    def _f_isliteral(self, v):
        return Val("bool", self._kind(v, R.LITERAL))

    def _f_istriple(self, v):
        return Val("bool", self._kind(v, R.TRIPLE))

    def _f_isnumeric(self, v):
        if v.kind == "term":
            return Val("bool", F.when(v.col.isNotNull(), F.coalesce(V.is_number(v.col), F.lit(False))))
        return Val("bool", F.when(v.col.isNotNull(), F.lit(v.kind in V.NUMBERS)))

    # ---- triple terms: the canonical string
    def _triple(self, vals: list[Val]) -> Val:
        s, p, o = (V.to_term(v) for v in vals)
        key = F.concat(F.lit("<<( "), R.nt_column(s), F.lit(" "), R.nt_column(p), F.lit(" "), R.nt_column(o), F.lit(" )>>"))
        e = F.lit("")
        fits = s["kind"].isin(R.IRI_KIND, R.BNODE) & (p["kind"] == R.IRI_KIND) & o.isNotNull()
        return Val("term", F.when(fits, R.make(F.lit(R.TRIPLE), key, e, e, e)))

    def _f_triple(self, s, p, o):
        return self._triple([s, p, o])

    def _part(self, v: Val, i: int) -> Val:
        return Val("term", triple_part(V.to_term(v), i))

    def _f_subject(self, v):
        return self._part(v, 0)

    def _f_predicate(self, v):
        return self._part(v, 1)

    def _f_object(self, v):
        return self._part(v, 2)

    # ---- strings
    def _f_strlen(self, v):
        return Val("int", F.length(self._string(v)).cast("bigint"))

    def _f_substr(self, v, start, length=None):
        text = self._string(v)
        first = F.floor(V.as_double(start) + 0.5)
        if length is None:
            return self._like(v, F.substring(text, F.greatest(first, F.lit(1)).cast("int"), F.greatest(F.length(text), F.lit(0))))
        end = first + F.floor(V.as_double(length) + 0.5)
        low = F.greatest(first, F.lit(1))
        return self._like(v, F.substring(text, low.cast("int"), F.greatest(end - low, F.lit(0)).cast("int")))

    def _f_ucase(self, v):
        return self._like(v, F.upper(self._string(v)))

    def _f_lcase(self, v):
        return self._like(v, F.lower(self._string(v)))

    def _f_concat(self, *vals):
        text = F.concat(*[self._string(v) for v in vals]) if vals else F.lit("")
        if all(v.kind == "str" for v in vals):
            return Val("str", text)
        ts = [V.to_term(v) for v in vals]
        same = F.lit(True)
        for t in ts[1:]:
            same = same & (t["lang"] == ts[0]["lang"]) & (t["dir"] == ts[0]["dir"])
        return Val("term", F.when(same, R.literal(text, ts[0]["dt"], ts[0]["lang"], ts[0]["dir"])).otherwise(R.literal(text, R.STRING)))

    def _test(self, a, b, how) -> Val:
        return Val("bool", F.when(self._compatible(a, b), how(self._string(a), self._string(b))))

    def _f_contains(self, a, b):
        return self._test(a, b, lambda x, y: x.contains(y))

    def _f_strstarts(self, a, b):
        return self._test(a, b, lambda x, y: x.startswith(y))

    def _f_strends(self, a, b):
        return self._test(a, b, lambda x, y: x.endswith(y))

    def _around(self, a: Val, b: Val, after: bool) -> Val:
        x, y = self._string(a), self._string(b)
        at = F.when(F.length(y) == 0, 1).otherwise(F.call_function("locate", y, x))
        cut = F.substring(x, at + F.length(y), F.length(x)) if after else F.substring(x, F.lit(1), at - 1)
        fits = self._compatible(a, b)
        if a.kind == "str":
            return Val("str", F.when(fits, F.when(at == 0, F.lit("")).otherwise(cut)))
        return Val("term", F.when(fits, F.when(at == 0, R.literal(F.lit(""), R.STRING)).otherwise(self._like(a, cut).col)))

    def _f_strbefore(self, a, b):
        return self._around(a, b, False)

    def _f_strafter(self, a, b):
        return self._around(a, b, True)

    def _pattern(self, pattern: Val, flags: Val | None) -> Column:
        text = self._simple(pattern)
        if flags is None:
            return text
        given = self._simple(flags)
        quoted = F.when(given.contains("q"), F.concat(F.lit("\\Q"), text, F.lit("\\E"))).otherwise(text)
        known = F.regexp_replace(given, "q", "")
        return F.when(known.rlike("^[imsx]+$"), F.concat(F.lit("(?"), known, F.lit(")"), quoted)).when(known == "", quoted)

    def _checked(self, pattern: Val, flags: Val | None) -> tuple[Column, Column]:
        """(pattern, number of its groups); null if it is invalid: an error of one solution, not of the job."""
        text = self._pattern(pattern, flags)
        if pattern.text is not None and (flags is None or flags.text is not None):
            groups = self._groups(pattern.text, flags.text if flags is not None else "")
            return (F.lit(None).cast("string"), F.lit(0)) if groups is None else (text, F.lit(groups))
        valid = F.call_function("try_reflect", F.lit("java.util.regex.Pattern"), F.lit("compile"), text).isNotNull()
        at_most = F.length(text) - F.length(F.replace(text, F.lit("("), F.lit("")))
        return F.when(valid, text), at_most

    @staticmethod
    def _groups(pattern: str, flags: str) -> int | None:
        """Groups of a constant pattern, which the planner's JVM compiles; None if it or its flags are invalid."""
        from pyspark import SparkContext

        if set(flags) - set("imsxq"):
            return None
        known = flags.replace("q", "")
        body = f"\\Q{pattern}\\E" if "q" in flags else pattern
        try:
            compiled = SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(f"(?{known}){body}" if known else body)
            return compiled.matcher("").groupCount()
        except Exception:  # noqa: BLE001  the JVM's PatternSyntaxException
            return None

    def _f_regex(self, v, pattern, flags=None):
        text, _ = self._checked(pattern, flags)
        return Val("bool", F.when(text.isNotNull(), F.rlike(self._string(v), text)) if pattern.text is None else F.rlike(self._string(v), text))

    def _f_replace(self, v, pattern, by, flags=None):
        text, groups = self._checked(pattern, flags)
        new = self._replacement(self._simple(by), groups)
        return self._like(v, F.when(text.isNotNull(), F.regexp_replace(self._string(v), text, new)))

    @staticmethod
    def _replacement(by: Column, groups: Column) -> Column:
        """Replacement text for the regular expressions of the JVM: `$1` to `$9` are groups that the pattern has and `$&` is
        the match, `$$` and `\\$` are a dollar; everything else is plain text."""

        def spell(token):
            group = token.substr(F.lit(2), F.lit(1)).try_cast("int")
            plain = F.replace(F.replace(token, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
            return F.when(token == "$&", "$0").when(token.isin("$$", "\\$"), "\\$").when(token == "\\\\", "\\\\").when(token.rlike("^\\$[0-9]$") & (group <= groups), token).otherwise(plain)

        tokens = F.regexp_extract_all(by, F.lit(r"(?s)\$[0-9&$]|\\[$\\]|[^$\\]+|."), 0)
        return F.when(by == "", "").otherwise(F.array_join(F.transform(tokens, spell), ""))

    def _f_encode_for_uri(self, v):
        text = F.url_encode(self._string(v))
        for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
            text = F.replace(text, F.lit(a), F.lit(b))
        return Val("str", text)

    # ---- numbers
    def _numeric(self, v: Val, native: dict, slow) -> Val:
        if v.kind in native:
            return Val(v.kind, native[v.kind](v.col))
        if v.kind != "term":
            return V.null()
        def spell(t):
            n, x = V.number(t), V.exact(t)
            place = V.rank(t)
            y = slow(x).cast(V.DECIMAL_TYPE)
            whole = F.when(place == 0, R.literal(y.cast("decimal(38,0)").cast("string"), R.INTEGER)).otherwise(R.literal(V.decimal_text(y), R.DECIMAL))
            return F.when(place >= 2, V.from_number(slow(n).cast("double"), place)).when(x.isNotNull(), whole)

        return Val("term", V.bind([v.col], spell))

    def _f_abs(self, v):
        return self._numeric(v, dict.fromkeys(V.NUMBERS, F.abs), F.abs)

    def _rounded(self, v, how):
        return self._numeric(v, {"int": lambda c: c, "dbl": lambda c: F.when(F.isnan(c) | (F.abs(c) > 2.0**52), c).otherwise(how(c).cast("double")), "dec": lambda c: how(c).cast(V.DECIMAL_TYPE)}, how)

    def _f_ceil(self, v):
        return self._rounded(v, F.ceil)

    def _f_floor(self, v):
        return self._rounded(v, F.floor)

    def _f_round(self, v):
        return self._rounded(v, lambda c: F.floor(c + F.lit("0.5").cast("decimal(2,1)")))

    def _f_rand(self):
        return Val("dbl", F.rand())

    # ---- dates: the written components, no shift of zone
    def _date_part(self, v: Val, native, group: int, kind: str = "int") -> Val:
        if v.kind in ("ts", "date"):
            return Val(kind, native(v.col).cast("bigint" if kind == "int" else V.DECIMAL_TYPE))
        t = V.to_term(v)
        part = F.regexp_extract(t["lex"], r"^(-?\d{4,})-(\d\d)-(\d\d)(?:T(\d\d):(\d\d):(\d\d(?:\.\d+)?))?(Z|[+-]\d\d:\d\d)?$", group)
        return Val(kind, F.when(t["dt"].isin(R.DATETIME, R.DATE), part.try_cast("bigint" if kind == "int" else V.DECIMAL_TYPE)))

    def _f_year(self, v):
        return self._date_part(v, F.year, 1)

    def _f_month(self, v):
        return self._date_part(v, F.month, 2)

    def _f_day(self, v):
        return self._date_part(v, F.dayofmonth, 3)

    def _f_hours(self, v):
        return self._date_part(v, F.hour, 4)

    def _f_minutes(self, v):
        return self._date_part(v, F.minute, 5)

    def _f_seconds(self, v):
        return self._date_part(v, lambda c: F.extract(F.lit("SECOND"), c), 6, "dec")

    def _zone(self, v: Val) -> Column:
        if v.kind in ("ts", "date"):
            return F.when(v.col.isNotNull(), F.lit(""))
        t = V.to_term(v)
        return F.when(t["dt"].isin(R.DATETIME, R.DATE), F.regexp_extract(t["lex"], r"(Z|[+-]\d\d:\d\d)$", 1))

    def _f_tz(self, v):
        return Val("str", self._zone(v))

    def _f_timezone(self, v):
        z = self._zone(v)
        h, m = F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
        text = F.concat(F.when(z.startswith("-"), F.lit("-PT")).otherwise(F.lit("PT")), F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(F.lit("")), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(F.lit("")))
        zero = z.isin("Z", "+00:00", "-00:00")
        return Val("term", F.when(zero, R.literal(F.lit("PT0S"), R.DURATION)).when(z != "", R.literal(text, R.DURATION)))

    def _f_now(self):
        return Val("term", R.term_lit(R.Lit(self.context.now, R.DATETIME)))

    # ---- hashes and fresh values
    def _f_md5(self, v):
        return Val("str", F.md5(self._simple(v)))

    def _f_sha1(self, v):
        return Val("str", F.sha1(self._simple(v)))

    def _f_sha256(self, v):
        return Val("str", F.sha2(self._simple(v), 256))

    def _f_sha384(self, v):
        return Val("str", F.sha2(self._simple(v), 384))

    def _f_sha512(self, v):
        return Val("str", F.sha2(self._simple(v), 512))

    def _f_uuid(self):
        return Val("iri", F.concat(F.lit("urn:uuid:"), F.uuid()))

    def _f_struuid(self):
        return Val("str", F.uuid())

    # ---- functions named by IRIs: casts, aliases, the user's own
    def _function(self, iri: str, vals: list[Val], args: list) -> Val:
        own = self.context.functions.get(iri)
        if own is not None:
            out = own(*[V.to_term(v) for v in vals])
            return out if isinstance(out, Val) else Val("term", out)
        if iri.startswith(R.XSD) and len(vals) == 1:
            cast = getattr(self, "_cast_" + iri[len(R.XSD) :].lower(), None)
            if cast is not None:
                return cast(vals[0])
        alias = ALIASES.get(re.split(r"[#/:]", iri)[-1].lower())
        if alias is not None:
            return self._call(alias, args)
        raise ValueError(f"unknown function <{iri}>")

    def _cast_string(self, v):
        return self._f_str(v)

    def _cast_boolean(self, v):
        if v.kind == "bool":
            return v
        if v.kind in V.NUMBERS:
            return Val("bool", V.ebv(v))
        if v.kind == "str":
            return Val("bool", F.when(v.col.isin("true", "1"), True).when(v.col.isin("false", "0"), False))
        if v.kind == "term":
            t = v.col
            n = V.number(t)
            text = F.when(t["dt"].isin(R.STRING, R.BOOLEAN), F.when(t["lex"].isin("true", "1"), True).when(t["lex"].isin("false", "0"), False))
            return Val("bool", F.when(n.isNotNull(), (n != 0) & ~F.isnan(n)).otherwise(text))
        return Val("bool", F.lit(None).cast("boolean"))

    def _numeric_text(self, v: Val) -> Column:
        """What a numeric cast reads: a number's own text, a boolean as 1 or 0, a string."""
        if v.kind == "bool":
            return v.col.cast("int").cast("string")
        if v.kind == "str":
            return F.trim(v.col)
        if v.kind in V.NUMBERS:
            return v.col.cast("string")
        if v.kind == "term":
            t = v.col
            flag = F.when(t["lex"].isin("true", "1"), F.lit("1")).when(t["lex"].isin("false", "0"), F.lit("0"))
            return F.when(t["dt"] == R.BOOLEAN, flag).when((t["dt"] == R.STRING) | t["dt"].isin(*V.NUMERIC_DTS), F.trim(t["lex"]))
        return F.lit(None).cast("string")

    def _is_string(self, v: Val) -> Column:
        return F.lit(v.kind == "str") if v.kind != "term" else v.col["dt"] == R.STRING

    def _cast_integer(self, v):
        if v.kind == "int":
            return v
        if v.kind in ("dbl", "dec"):
            return Val("int", F.when(F.abs(v.col) < 9e18, F.when(v.col < 0, F.ceil(v.col)).otherwise(F.floor(v.col)).cast("bigint")))
        text = self._numeric_text(v)
        whole = text.rlike(r"^[+-]?\d+$")
        number = text.try_cast("double")
        cut = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("bigint")
        return Val("int", F.when(whole, text.try_cast("bigint")).when(~self._is_string(v) & (F.abs(number) < 9e18), cut))

    def _cast_decimal(self, v):
        if v.kind == "dec":
            return v
        if v.kind == "int":
            return Val("dec", v.col.cast(V.DECIMAL_TYPE))
        text = self._numeric_text(v)
        plain = text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$")
        return Val("dec", F.when(plain | ~self._is_string(v), text.try_cast(V.DECIMAL_TYPE)))

    def _cast_double(self, v):
        if v.kind in V.NUMBERS:
            return Val("dbl", v.col.cast("double"))
        text = self._numeric_text(v)
        special = F.when(text == "NaN", float("nan")).when(text == "INF", float("inf")).when(text == "-INF", float("-inf"))
        return Val("dbl", F.when(text.rlike(V._NUMBER), text.try_cast("double")).otherwise(special))

    def _cast_float(self, v):
        d = self._cast_double(v)
        return Val("term", R.literal(V.double_text(d.col.cast("float").cast("double")), R.FLOAT))

    def _cast_datetime(self, v):
        if v.kind == "ts":
            return v
        if v.kind == "date":
            return Val("ts", v.col.cast("timestamp_ntz"))
        text = self._string(v) if v.kind == "str" else F.when(V.to_term(v)["dt"].isin(R.STRING, R.DATETIME), V.to_term(v)["lex"])
        return Val("term", F.when(text.rlike(r"^-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?$"), R.literal(text, R.DATETIME)))

    def _cast_date(self, v):
        if v.kind == "date":
            return v
        if v.kind == "ts":
            return Val("date", v.col.cast("date"))
        text = self._string(v) if v.kind == "str" else F.when(V.to_term(v)["dt"].isin(R.STRING, R.DATE, R.DATETIME), F.substring(V.to_term(v)["lex"], 1, 10))
        return Val("term", F.when(text.rlike(r"^-?\d{4,}-\d\d-\d\d(Z|[+-]\d\d:\d\d)?$"), R.literal(text, R.DATE)))


def triple_part(t: Column, i: int) -> Column:
    """Subject, predicate or object of a triple term column, read from its canonical form. Vectorized: the form nests."""

    @F.pandas_udf(R.TERM_DDL)
    def part(keys: pd.Series) -> pd.DataFrame:
        from quadlake.parser.turtle import parse_term

        rows = []
        for k in keys:
            term = parse_term(k) if isinstance(k, str) and k.startswith("<<(") else None
            rows.append(R.parts((term.s, term.p, term.o)[i]) if isinstance(term, R.TripleTerm) else (None,) * 5)
        return pd.DataFrame(rows, columns=["kind", "lex", "dt", "lang", "dir"])

    key = F.when(t["kind"] == R.TRIPLE, t["lex"])
    found = part(F.coalesce(key, F.lit("")))
    return F.when(key.isNotNull(), found)


def freeze(e):
    """A hashable form of an expression."""
    if isinstance(e, tuple):
        return tuple(freeze(x) for x in e)
    if isinstance(e, list):
        return ("list", *(freeze(x) for x in e))
    return e if e.__hash__ else id(e)
