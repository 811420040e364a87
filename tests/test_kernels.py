"""Checksums against plain Python on random values, and the plans that detectors make."""

import random

from pyspark.sql import functions as F

from glyphveil import fixed
from glyphveil.functions import kernels
from glyphveil.operators.engine import default_engine
from glyphveil.operators.packs import GERMANY, ITALY, SPAIN


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0 and set(d) != {"0"}


def check_digit(d):
    p = 10
    for c in d:
        s = (int(c) + p) % 10 or 10
        p = 2 * s % 11
    return (11 - p) % 10


def steuer(v):
    n = sorted((v[:10].count(c) for c in set(v[:10])), reverse=True)
    return n[0] in (2, 3) and all(x == 1 for x in n[1:]) and check_digit(v[:10]) == int(v[10])


def iban(v):
    c = "".join(v.split()).upper()
    return fixed.IBAN_LENGTHS.get(c[:2]) == len(c) and int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1


def cf(v):
    u = "".join(str(fixed.CF_LETTERS_FOR_DIGITS.index(c)) if i in fixed.CF_DIGIT_PLACES and c in fixed.CF_LETTERS_FOR_DIGITS else c for i, c in enumerate(v.upper()))
    total = sum(fixed.CF_ODD[c] if i % 2 == 0 else (int(c) if c.isdigit() else ord(c) - 65) for i, c in enumerate(u[:15]))
    return chr(total % 26 + 65) == u[15]


def dni(v):
    return fixed.DNI_LETTERS[int(v[:8]) % 23] == v[8].upper()


def cif(v):
    total = sum(int(c) if i % 2 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(v[1:8]))
    c = (10 - total % 10) % 10
    letter, digit = v[8].upper() == fixed.CIF_LETTERS[c], v[8] == str(c)
    lead = v[0].upper()
    return letter if lead in "KPQS" else digit if lead in "ABEH" else letter or digit


def agree(spark, check, twin, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [(r["v"], r["ok"]) for r in df.select("v", check(F.col("v")).alias("ok")).collect()]
    assert all(bool(ok) == twin(v) for v, ok in got), [x for x in got if bool(x[1]) != twin(x[0])][:3]
    assert any(ok for _, ok in got) and not all(ok for _, ok in got)


def test_kernels(spark):
    r = random.Random(7)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    agree(spark, kernels.luhn, luhn, [digits(11) for _ in range(2000)] + ["0" * 11])
    shuffled = lambda: "".join(r.sample("0123456789", 10))[:9] + r.choice("0123456789") + digits(1)
    agree(spark, kernels.steuer_id, steuer, [shuffled() for _ in range(2000)] + [digits(11) for _ in range(500)])
    agree(spark, kernels.ust_idnr, lambda v: check_digit(v[2:10]) == int(v[10]), ["DE" + digits(9) for _ in range(1500)])
    agree(spark, kernels.dni, dni, [digits(8) + r.choice(fixed.DNI_LETTERS + "abc") for _ in range(1500)])
    agree(spark, kernels.nie, lambda v: dni("012"["XYZ".index(v[0].upper())] + v[1:]), [r.choice("XYZxyz") + digits(7) + r.choice(fixed.DNI_LETTERS) for _ in range(1500)])
    agree(spark, kernels.cif, cif, [r.choice("ABCDEFGHJKLMNPQRSUVWabk") + digits(7) + r.choice("0123456789ABCDEFGHIJabj") for _ in range(2500)])
    letters = "LMNPQRSTUV0123456789"
    some = lambda n: "".join(r.choice(letters) for _ in range(n))
    agree(spark, kernels.codice_fiscale, cf, ["RSSmra" + some(2) + r.choice("ABCDEHLMPRST") + some(2) + "A" + some(3) + r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(2500)])
    right = [f"DE{98 - int(b + '131400') % 97:02d}{b}" for b in (digits(18) for _ in range(300))]
    agree(spark, kernels.iban, iban, right + ["DE" + digits(20) for _ in range(500)] + ["GB82 WEST 1234 5698 7654 32", "gb82west12345698765432", "XX82WEST12345698765432"])


def test_plans(spark):
    """A redaction with all packs is one projection over the columns it needs: no shuffle, no Python."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    e = default_engine(*ITALY.detectors, *GERMANY.detectors, *SPAIN.detectors)
    plan = docs.select("doc_id", e.redact(F.col("text")).alias("r"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
