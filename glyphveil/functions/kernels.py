"""Checksums as column expressions: a value in, a verdict or a remainder out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphveil import fixed


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use mentions it."""
    return F.transform(F.array(value), use)[0]


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def at(v: Column, i: int) -> Column:
    """The character at a 0-based place."""
    return v.substr(i + 1, 1)


def number(v: Column, i: int) -> Column:
    return at(v, i).cast("int")


def chars(v: Column) -> Column:
    return F.split(v, "(?!^)(?!$)")


def luhn(v: Column) -> Column:
    """Luhn over all digits; all zeros don't count."""
    return F.call_function("luhn_check", v) & v.rlike("[1-9]")


def mod97(v: Column) -> Column:
    """The number that digits and letters (A as 10) spell, modulo 97; null beyond 70 digits, which no IBAN has. Two decimals hold them."""
    spelled = F.array_join(F.transform(chars(v), lambda c: F.conv(c, 36, 10)), "")

    def rest(d: Column) -> Column:
        head = d.substr(1, 34).try_cast("decimal(38,0)") % 97
        return (F.concat(head.cast("string"), d.substr(35, 36)).try_cast("decimal(38,0)") % 97).cast("int")

    return once(spelled, lambda d: F.when(F.length(d) <= 70, rest(d)))


def iban(v: Column) -> Column:
    """Known country, its length, and remainder 1 with the first four characters last."""
    lengths = F.create_map(*[F.lit(x) for pair in fixed.IBAN_LENGTHS.items() for x in pair])

    def check(c: Column) -> Column:
        return (F.length(c) == F.coalesce(F.try_element_at(lengths, c.substr(1, 2)), F.lit(0))) & (mod97(F.concat(c.substr(F.lit(5), F.length(c)), c.substr(1, 4))) == 1)

    return once(F.upper(F.regexp_replace(v, r"\s", "")), lambda c: F.coalesce(check(c), F.lit(False)))


def credit_card(v: Column) -> Column:
    return once(F.regexp_replace(v, r"[\s\-]", ""), lambda d: F.length(d).between(13, 19) & luhn(d))


def codice_fiscale(v: Column) -> Column:
    """Letters standing for digits are digits again before the check letter is computed."""
    def plain(u: Column) -> Column:
        return F.concat(*[F.translate(at(u, i), fixed.CF_LETTERS_FOR_DIGITS, "0123456789") if i in fixed.CF_DIGIT_PLACES else at(u, i) for i in range(16)])

    def check(u: Column) -> Column:
        odd = F.create_map(*[F.lit(x) for pair in fixed.CF_ODD.items() for x in pair])
        even = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 65)
        total = F.lit(0)
        for i in range(15):
            total = total + (odd[at(u, i)] if i % 2 == 0 else even(at(u, i)))
        return F.char(total % 26 + 65) == at(u, 15)

    return once(once(F.upper(v), plain), check)


def mod11_10(v: Column, n: int) -> Column:
    """The check digit of ISO 7064 mod 11,10 over the first n digits."""
    p: Column = F.lit(10)
    for i in range(n):
        p = ((number(v, i) + p + 9) % 10 + 1) * 2 % 11
    return (11 - p) % 10


def steuer_id(v: Column) -> Column:
    """Of the first ten digits one occurs twice or three times, the others once at most; then the check digit."""
    def counts(d: Column) -> Column:
        return F.transform(F.array(*[F.lit(str(i)) for i in range(10)]), lambda c: F.length(d) - F.length(F.replace(d, c, F.lit(""))))

    spread = once(counts(v.substr(1, 10)), lambda n: (F.array_max(n) <= 3) & (F.size(F.filter(n, lambda x: x.isin(2, 3))) == 1) & (F.size(F.filter(n, lambda x: x > 0)) <= 9))
    return spread & (mod11_10(v, 10) == number(v, 10))


def ust_idnr(v: Column) -> Column:
    return once(v.substr(3, 9), lambda d: mod11_10(d, 8) == number(d, 8))


def mod23_letter(n: Column) -> Column:
    return F.substring(F.lit(fixed.DNI_LETTERS), F.pmod(n.cast("int"), F.lit(23)) + 1, F.lit(1))


def dni(v: Column) -> Column:
    return mod23_letter(v.substr(1, 8)) == F.upper(at(v, 8))


def nie(v: Column) -> Column:
    return once(F.upper(v), lambda u: mod23_letter(F.concat(F.translate(at(u, 0), fixed.NIE_LEADERS, "012"), u.substr(2, 7))) == at(u, 8))


def cif(v: Column) -> Column:
    """Digits at odd places are doubled and their digits added; the leading letter says what the control may be."""
    def check(u: Column) -> Column:
        twice = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        total = F.lit(0)
        for i in range(1, 8):
            total = total + (twice(number(u, i)) if i % 2 else number(u, i))
        lead, last = at(u, 0), at(u, 8)

        def told(c: Column) -> Column:
            letter = last == F.substring(F.lit(fixed.CIF_LETTERS), c + 1, F.lit(1))
            digit = last == c.cast("string")
            return F.when(lead.isin(*fixed.CIF_LETTER_LEADERS), letter).when(lead.isin(*fixed.CIF_DIGIT_LEADERS), digit).otherwise(letter | digit)

        return once((10 - total % 10) % 10, told)

    return once(F.upper(v), check)


def phone_it(v: Column) -> Column:
    return F.length(digits(v)) >= 9


def phone_de(v: Column) -> Column:
    return F.length(digits(v)).between(7, 14)


def phone_es(v: Column) -> Column:
    return F.length(digits(v)).isin(9, 11, 13)
