"""Personal data under format-preserving pseudonyms, with DataFrame operations alone.

One pattern finds candidates; checksums, ranges and calendars validate them. A run of digit groups that
is no card as a whole is searched for the cards, and what they leave for the other kinds, that begin and
end with its groups. A number or date is then
permuted by a keyed Feistel network over exactly its format's values, so it stays a valid value of the
format, no two values share a pseudonym, and equal values have equal ones in every document and
spelling. Addresses of e-mail and secrets, which aren't numbers, get a keyed digest.

In the network the two halves take turns: each round adds to one half a keyed digest of the other,
modulo the half's range; so ranges may differ and no value leaves its format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphveil.fixed import IBAN_LENGTHS

#: Stands for the caller's key in tests and in the registered query.
DEFAULT_KEY = "corpus-key"
ROUNDS = 8
#: Days from 1900-01-01 that dates are permuted in: a product of two equal ranges, to August 2099.
FIRST_DAY, DAY_HALF = "1900-01-01", 270

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_KEYWORD = r"(?i:passw(?:or)?d|secret|token|api[_\-]?key|access[_\-]?key)[\"']?[ ]?[=:][ ]?[\"']?"


def _spaced_ibans() -> str:
    """IBANs in groups of four, or compact with small letters: as long as their countries have them."""
    out = []
    for n in sorted(set(IBAN_LENGTHS.values())):
        here = "|".join(c for c, k in IBAN_LENGTHS.items() if k == n)
        fours, rest = divmod(n - 4, 4)
        out.append(f"(?:{here})[0-9]{{2}}(?:(?:[ ][A-Z0-9]{{4}}){{{fours}}}" + (f"[ ][A-Z0-9]{{{rest}}}" if rest else "") + f"|[A-Z0-9]{{{n - 4}}})")
    return "(?i:(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(out) + "))(?![0-9A-Za-z_])"


#: National phones of the corpus's languages: with a trunk 0 or 00 (also in brackets), French pairs, Spanish nines.
_NATIONAL = (
    r"(?:(?=\(?0(?:[ .\-/)]{0,2}[0-9]){7})(?:\(0[1-9][0-9]{0,4}\)[ ]?|0[1-9][0-9]{1,4}[ .\-/])[0-9]{2,8}(?:[ .\-/][0-9]{2,8}){0,3}"
    r"|00[1-9](?:[ .\-()/]{0,3}[0-9]){7,13}|0[1-9](?:[ .\-]?[0-9]{2}){4}|0[1-9][0-9]{7,10}"
    r"|[6-9][0-9]{2}(?:[ .\-]?[0-9]{3}[ .\-]?[0-9]{3}|(?:[ .\-][0-9]{2}){3})|[89][0-9][ .\-][0-9]{3}[ .\-](?:[0-9]{4}|[0-9]{2}[ .\-][0-9]{2}))(?![0-9A-Za-z_]|[.\-][0-9])"
)
#: Kinds of candidates, in the order in which they are tried at a place; nothing of [0-9A-Za-z_] stands before.
PATTERNS = {
    "email": r"(?<![.%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "secret": _KEYWORD + r"[A-Za-z0-9+/_\-]{8,}+|(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z_])",
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![0-9A-Za-z_])|" + _spaced_ibans(),
    "ip": rf"(?<![0-9]\.){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9A-Za-z_]|\.[0-9])",
    "date": r"(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2})(?![0-9A-Za-z_])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z_]|-[0-9])",
    "card": r"[0-9](?:[ \-]?[0-9]){12,18}(?![0-9A-Za-z_])",
    "phone": r"(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9A-Za-z_])|\+[0-9]{1,3}(?:[ .\-()/]{0,3}[0-9]){7,12}(?![0-9A-Za-z_])",
    "national": _NATIONAL,
}
#: Groups of digits, 13 digits at least, without a last group that begins an IP address, a date or a phone with points.
_RUN = r"(?=[0-9](?:[ \-]?[0-9]){12})[0-9]++(?![A-Za-z_])(?:[ \-](?![0-9]{1,3}\.[0-9]{1,3}\.[0-9]|[0-9]{2}/[0-9]{2}/(?:19|20))[0-9]++(?![A-Za-z_]))*+"


def _finder(patterns: dict[str, str]) -> str:
    return r"(?<![0-9A-Za-z_])(?:" + "|".join(f"(?:{p})" for p in patterns.values()) + ")"


FINDER = _finder(PATTERNS | {"card": _RUN})
#: Of what is left of a run beside its cards.
_REST = _finder({k: p for k, p in PATTERNS.items() if k != "card"})
#: Groups as cards are printed; within a longer run others are cards only where none of these is, and if _EVEN: a tenth of all digits have a fitting check digit.
_PRINTED = r"^(?:[0-9]{13,19}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{4,5}|(?:[0-9]{4}[ \-]){3}[0-9]{1,4}(?:[ \-][0-9]{3})?)$"
_EVEN = r"^[0-9]{3,8}([ \-])[0-9]{3,8}(?:\1[0-9]{3,8}){0,4}$"


def _is(m: Column, kind: str) -> Column:
    return m.rlike(f"^(?:{PATTERNS[kind]})$")


def _digest(*parts: Column | str | int) -> Column:
    return F.sha2(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]), 256)


def feistel(left: Column, right: Column, left_range: Column | int, right_range: Column | int, key: str, tweak: Column | str) -> Column:
    """struct(l, r): a keyed permutation of the pairs below the two ranges (long); tweak separates formats."""

    def mixed(i: Column, half: Column, most: Column | int) -> Column:
        return F.pmod(F.conv(F.substring(_digest(key, tweak, i.cast("string"), half.cast("string")), 1, 14), 16, 10).cast("long"), most if isinstance(most, Column) else F.lit(most).cast("long"))

    def turn(s: Column, i: Column) -> Column:
        lr = left_range if isinstance(left_range, Column) else F.lit(left_range).cast("long")
        rr = right_range if isinstance(right_range, Column) else F.lit(right_range).cast("long")
        return F.when(i % 2 == 0, F.struct(((s["l"] + mixed(i, s["r"], lr)) % lr).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), ((s["r"] + mixed(i, s["l"], rr)) % rr).alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def permuted_digits(digits: Column, key: str, tweak: str) -> Column:
    """Digits (2 to 34 of them) permuted among those of the same length."""
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")
    power = lambda k: F.concat(F.lit("1"), F.repeat(F.lit("0"), k)).cast("long")
    s = feistel(digits.substr(F.lit(1), a), digits.substr(a + 1, n), power(a), power(n - a), key, F.concat(F.lit(tweak), n.cast("string")))
    # One field for both halves, so that the network runs once a value.
    return F.aggregate(F.array(s), F.lit(""), lambda _, x: F.concat(F.lpad(x["l"].cast("string"), a, "0"), F.lpad(x["r"].cast("string"), n - a, "0")))


def respelled(m: Column, digits: Column) -> Column:
    """m with its digits, one after the other, replaced by digits; the rest as it was."""
    begin = F.struct(F.lit(1).alias("i"), F.lit("").alias("out"))

    def step(s: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct((s["i"] + F.when(digit, 1).otherwise(0)).alias("i"), F.concat(s["out"], F.when(digit, digits.substr(s["i"], F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(F.split(m, "(?!^)(?!$)"), begin, step)["out"]


def _once(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def mod97(text: Column) -> Column:
    """A number of digits and letters (A as 10) modulo 97."""
    def step(a: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(text, "(?!^)(?!$)"), F.lit(0), step)


def _luhn(m: Column) -> Column:
    """Whether the digits of m are not all 0 and end in their check digit."""
    return _once(F.regexp_replace(m, "[^0-9]", ""), lambda d: F.call_function("luhn_check", d) & d.rlike("[1-9]"))


def _joined(parts: Column, first: Column, last: Column) -> Column:
    """The text of parts first to last; element by element, as slice copies the whole array."""
    return F.when(first > last, "").otherwise(F.array_join(F.transform(F.sequence(first, last), lambda k: F.get(parts, k)), ""))


def _card_spans(parts: Column) -> Column:
    """The first and last groups of the cards in parts (group, separator, group, ...), in order, without overlap; of those from one group on the longest."""
    n = F.floor((F.size(parts) + 1) / 2).cast("int")
    groups = F.sequence(F.lit(0), n - 1)

    def ends(i: Column) -> Column:
        last = F.sequence(i, F.least(i + 18, n - 1))
        texts = F.transform(last, lambda j: F.struct(j.alias("j"), _joined(parts, 2 * i, 2 * j).alias("t")))
        return F.filter(texts, lambda x: (x["t"].rlike(_PRINTED) | x["t"].rlike(_EVEN)) & _is(x["t"], "card") & _luhn(x["t"]))

    def best(found: Column) -> Column:
        return F.struct(F.array_max(F.transform(F.filter(found, lambda x: x["t"].rlike(_PRINTED)), lambda x: x["j"])).alias("printed"), F.array_max(F.transform(found, lambda x: x["j"])).alias("any"))

    none = F.expr("CAST(array() AS array<struct<i: int, j: int>>)")

    def chosen(hits: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            h = F.get(hits, i)
            hidden = F.exists(F.sequence(i, F.coalesce(h["any"], i)), lambda k: (k > i) & F.get(hits, k)["printed"].isNotNull())
            j = F.when(i >= s["free"], F.coalesce(h["printed"], F.when(~hidden, h["any"])))
            return _once(j, lambda j: F.when(j.isNull(), s).otherwise(F.struct((j + 1).alias("free"), F.concat(s["spans"], F.array(F.struct(i.alias("i"), j.alias("j")))).alias("spans"))))

        return F.aggregate(groups, F.struct(F.lit(0).alias("free"), none.alias("spans")), step, lambda s: s["spans"])

    return _once(F.transform(groups, lambda i: _once(ends(i), best)), chosen)


def _pieces(m: Column) -> Column:
    """A candidate as an array of (text, tried): a run of groups that is none as a whole in its cards, the candidates beside them and the rest."""
    piece = lambda t, tried: F.struct(t.alias("text"), F.lit(tried).alias("tried"))

    def others(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(_REST), F.lit(0))
        return _once(found, lambda f: F.flatten(F.transform(F.split(t, _REST, -1), lambda g, i: F.array(piece(g, False), piece(F.coalesce(F.get(f, i), F.lit("")), True)))))

    def cut(parts: Column, spans: Column) -> Column:
        def one(k: Column) -> Column:
            begin = F.when(k == 0, F.lit(0)).otherwise(2 * F.get(spans, k - 1)["j"] + 1)
            card = F.get(spans, k)
            end = F.coalesce(2 * card["i"], F.size(parts))
            rest = _once(_joined(parts, begin, end - 1), others)
            text = F.when(card.isNull(), "").otherwise(_joined(parts, 2 * card["i"], 2 * card["j"]))
            return F.concat(rest, F.array(piece(text, True)))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), one))

    run = (F.length(m) >= 13) & m.rlike("^[0-9][0-9 \\-]+$") & ~(_is(m, "card") & _luhn(m))
    failed = m.rlike("^[A-Za-z]{2}[0-9]{2}[ ]") & _is(m, "iban") & ~_once(F.upper(F.regexp_replace(m, "[ ]", "")), _iban_valid)
    return F.when(run | failed, _once(F.split(m, "(?<=[ \\-])|(?=[ \\-])"), lambda p: _once(_card_spans(p), lambda s: cut(p, s)))).otherwise(F.array(piece(m, True)))


def _card(m: Column, key: str) -> Column:
    """The first digit stays, the check digit follows from the others."""
    luhn = lambda x: F.call_function("luhn_check", x)
    checked = lambda p: F.concat(p, F.filter(F.array(*[F.lit(str(c)) for c in range(10)]), lambda c: luhn(F.concat(p, c)))[0])

    def new(d: Column) -> Column:
        inner = _once(d.substr(F.lit(2), F.length(d) - 2), lambda x: permuted_digits(x, key, "card"))
        return F.when(luhn(d) & d.rlike("[1-9]"), _once(_once(F.concat(d.substr(1, 1), inner), checked), lambda w: respelled(m, w)))

    return _once(F.regexp_replace(m, "[^0-9]", ""), new)


def _phone(m: Column, key: str) -> Column:
    """The last ten digits (or all of fewer) are permuted, a country code before them stays."""

    def new(d: Column) -> Column:
        ahead = F.greatest(F.length(d) - 10, F.lit(0))
        return F.concat(d.substr(F.lit(1), ahead), _once(d.substr(ahead + 1, F.length(d)), lambda x: permuted_digits(x, key, "phone")))

    return _once(_once(F.regexp_replace(m, "[^0-9]", ""), new), lambda w: respelled(m, w))


def _ip(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    s = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip")
    part = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), (x % 256).cast("string"))
    return _once(s, lambda x: F.concat_ws(".", part(x["l"]), part(x["r"])))


def _ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999: just these are permuted."""
    area, group, serial = (m.substr(p, n).cast("long") for p, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    s = feistel(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
    new = _once(s, lambda x: F.concat_ws("-", F.lpad((x["l"] + F.when(x["l"] >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((F.floor(x["r"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((x["r"] % 9999 + 1).cast("string"), 4, "0")))
    return F.when(valid, new)


def _date(m: Column, key: str) -> Column:
    """Calendar days from FIRST_DAY on; the layout stays. With slashes the day comes first, or the month if only that is a date."""
    first = F.lit(FIRST_DAY).cast("date")
    out = F.lit(None).cast("struct<day: int, form: string>")
    day = lambda form: F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), first)
    forms = ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy", "MM/dd/yyyy")
    for form in reversed(forms):
        inside = (day(form) >= 0) & (day(form) < DAY_HALF * DAY_HALF)
        out = F.when(inside, F.struct(day(form).alias("day"), F.lit(form).alias("form"))).otherwise(out)

    def new(x: Column) -> Column:
        s = feistel(F.floor(x["day"] / DAY_HALF), x["day"] % DAY_HALF, DAY_HALF, DAY_HALF, key, "date")
        moved = F.date_add(first, _once(s, lambda y: y["l"] * DAY_HALF + y["r"]).cast("int"))
        return _once(moved, lambda d: F.coalesce(*[F.when(x["form"] == f, F.date_format(d, f)) for f in forms]))

    return _once(out, new)


def _national(m: Column, key: str) -> Column:
    """Zeros ahead and the digit after them stay, the others are permuted."""

    def new(d: Column) -> Column:
        ahead = F.length(F.regexp_extract(d, "^0*[1-9]", 0))
        return F.concat(d.substr(F.lit(1), ahead), _once(d.substr(ahead + 1, F.length(d)), lambda x: permuted_digits(x, key, "national")))

    return _once(_once(F.regexp_replace(m, "[^0-9]", ""), new), lambda w: respelled(m, w))


def _iban_valid(c: Column) -> Column:
    """Of a compact IBAN in capitals."""
    return mod97(F.concat(c.substr(F.lit(5), F.length(c)), c.substr(1, 4))) == 1


def _iban(m: Column, key: str) -> Column:
    """The country and letters stay, other digits are permuted, the check digits follow; spaces and case stay."""

    def new(c: Column) -> Column:
        body = c.substr(F.lit(5), F.length(c))
        digits = F.regexp_replace(body, "[^0-9]", "")
        country = c.substr(1, 2)
        moved = _once(digits, lambda x: permuted_digits(x, key, "iban"))
        check = lambda w: F.lpad((F.lit(98) - mod97(F.concat(respelled(body, w), country, F.lit("00")))).cast("string"), 2, "0")
        whole = _once(_once(moved, lambda w: F.concat(check(w), w)), lambda w: respelled(m, w))
        return F.when(_iban_valid(c) & (F.length(digits) >= 2), whole)

    return _once(F.upper(F.regexp_replace(m, "[ ]", "")), new)


def _email(m: Column, key: str) -> Column:
    return F.when(m.rlike(r"\.[A-Za-z]{2,63}$"), F.concat(F.lit("u"), F.substring(_digest(key, "email", F.lower(m)), 1, 12), F.lit("@example.org")))


def _secret(m: Column, key: str) -> Column:
    ahead = F.regexp_extract(m, f"^({_KEYWORD})?", 1)
    return F.concat(ahead, F.lit("SECRET-"), F.substring(_digest(key, "secret", m.substr(F.length(ahead) + 1, F.length(m))), 1, 12))


_MAKERS = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone, "national": _national}


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of a candidate; null if it is valid in no format."""
    return F.coalesce(*[F.when(_is(m, kind), _MAKERS[kind](m, key)) for kind in PATTERNS])


def pseudonymise(docs: DataFrame, key: str = DEFAULT_KEY, text: str = "text", found: str = "n_found") -> DataFrame:
    """docs with the text's valid personal data replaced, and n_found (int, named by found), how many were.

    A null text stays null with n_found 0; texts without candidates are untouched; candidates that
    fail validation stay, but for valid ones within them. No shuffle: one pass of the pattern over each whole text, a second over
    those with candidates. A column n_found of docs is replaced, others stay.
    """
    t = F.col(text)
    df = docs.withColumn("__gv_found", F.regexp_extract_all(t, F.lit(FINDER), F.lit(0)))
    # Of each candidate its text, and how many values of it were replaced.
    told = lambda ps: F.struct(F.array_join(F.transform(ps, lambda p: F.coalesce(p["new"], p["text"])), "").alias("text"), F.size(F.filter(ps, lambda p: p["new"].isNotNull())).alias("n"))
    new = F.transform("__gv_found", lambda m: _once(F.transform(_pieces(m), lambda p: F.struct(p["text"].alias("text"), F.when(p["tried"], pseudonym(p["text"], key)).alias("new"))), told))
    df = df.withColumn("__gv_new", F.when(F.size("__gv_found") > 0, new))
    gaps = F.split(t, FINDER, -1)
    woven = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.col("__gv_new"), i)["text"], F.lit("")))), "")
    count = F.when(F.size("__gv_found") > 0, F.aggregate("__gv_new", F.lit(0), lambda a, x: a + x["n"])).otherwise(0)
    return df.withColumn(found, count).withColumn(text, F.when(F.col(found) > 0, woven).otherwise(t)).drop("__gv_found", "__gv_new")
