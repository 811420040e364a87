"""Each detector on values that it must and must not take, whole and within sentences."""

from pyspark.sql import functions as F

from glyphveil.operators.custom_rules import CustomRule, CustomRuleDetector, CustomRuleSet
from glyphveil.operators.detectors import ADDRESS_DE, BUILT_IN

VALID = {
    "iban": ["IT60X0542811101000000123456", "DE89370400440532013000", "NO9386011117947", "NO93 8601 1117 947", "GB82WEST12345698765432"],
    "credit_card": ["4242424242424242", "4242 4242 4242 4242"],
    "email": ["mario.rossi@example.com", "a+filter@x.io", "another_user@sub.domain.co.uk"],
    "codice_fiscale": ["RSSMRA85T10A562S", "rssmra85t10a562s", "NRELRT75D03H501K", "RSSMRA85T10A56NS", "RSSMRAU5T10A56NS"],
    "p_iva": ["12345678903", "01234567897"],
    "phone_it": ["+39 333 1234567", "02 12345678", "06-1234567"],
    "steuer_id": "65929970489 01003246797 01005384928 01006493586 01008235761 01028904350 01029854631 01032467901 01032547090 01036902543".split(),
    "ust_idnr": "DE123456788 DE812345673 DE998877660 DE123456995 DE135792460 DE246813573 DE111222339 DE888999009 DE765432106 DE234567894 de123456788".split(),
    "phone_de": ["+49 30 12345678", "+49 (0) 30 12345678", "030 12345678", "+4915112345678", "0151 12345678", "0049 30 12345678", "030-12345678"],
    "dni": "12345678Z 87654321X 11111111H 22222222J 99999999R 10203040X 50607080L 13579246T 24681357B 76543210S 12345678z".split(),
    "nie": "X1234567L Y0123456Y Z9876543A X7777777M Y1111111H Z2222222J X0000001R Y5555555B Z3141592G X8088088T x1234567l".split(),
    "cif": "K1234567D P7654321D Q2468013D S1357902D N5050505F W9090909D A12345674 B76543214 C40302010 D51515153 k1234567d".split(),
    "phone_es": ["+34 612 345 678", "+34 91 123 4567", "+34612345678", "91 123 4567", "612-345-678", "612.345.678", "0034 612 345 678"],
    "address_it": ["Via Roma, 12", "Via Roma 12/A", "Via Roma 12bis", "Via d'Annunzio 1", "Via dell'Università 1", "Via Roma 12 - 50100 Firenze", "Via Roma"],
    "address_de": ["Berliner Straße 12, 10115 Berlin", "Hauptstr. 5-9", "Friedrich-Ebert-Str. 12", "An der Alster 12", "Kurfürstendamm 195"],
    "address_es": ["Calle Mayor 12, 28013 Madrid", "P.º de la Castellana 30", "Avda. de América 3", "Calle de la Princesa 8", "Calle Mayor"],
}
INVALID = {
    "iban": ["IT60X0542811101000000123457", "ZZ60X0542811101000000123456", "IT60X054281110100000012345"],
    "credit_card": ["4242424242424241", "1234567890", "12345678901234567890", "0000000000000"],
    "email": ["user@", "@domain.com", "mario@münchen.de"],
    "codice_fiscale": ["RSSMRA85T10A562X", "RSSMRA85T10A562", "RSSMRA85Q10A562S"],
    "p_iva": ["12345678901", "00000000000", "1234567890", "123456789012"],
    "phone_it": ["id-99993331234567", "833312345678abc", "33312345678901"],
    "steuer_id": ["65929970480", "12345678901", "11111111111", "00000000000"],
    "ust_idnr": ["DE123456789", "DE12345678", "IT12345678901", "XDE123456788Y"],
    "phone_de": ["110", "112", "999015112345678abc"],
    "dni": ["12345678A", "1234567A", "123456789A", "12345678"],
    "nie": ["X1234567A", "Q1234567A", "X12345A"],
    "cif": ["K1234567A", "N5050505A", "T1234567A", "A123456"],
    "phone_es": ["12345678901", "6123456789012abc", "512 345 678", "999612345678"],
    "address_it": ["via roma", "lavia roma 12"],
    "address_de": ["die berliner straße"],
    "address_es": ["calle mayor 12", "incalle Mayor 12", "Vía Mayor 12"],
}


def found(spark, rows):
    """(detector, text) -> values with offsets."""
    df = spark.createDataFrame(rows, "name string, text string")
    out = {}
    got = df.select("name", "text", *[d.detect(F.col("text")).alias(n) for n, d in BUILT_IN.items()]).collect()
    for r in got:
        out[r["name"], r["text"]] = [(x["value"], x["offset"], x["length"]) for x in r[r["name"]]]
    return out


def test_values(spark):
    rows = [(n, v) for n, vs in VALID.items() for v in vs]
    wrapped = [(n, f"😀 è: {v} ; fine") for n, v in rows]
    bad = [(n, v) for n, vs in INVALID.items() for v in vs]
    got = found(spark, rows + wrapped + bad)
    head = len("😀 è: ".encode())
    for n, v in rows:
        assert got[n, v] == [(v, 0, len(v.encode()))], (n, v, got[n, v])
        assert got[n, f"😀 è: {v} ; fine"] == [(v, head, len(v.encode()))], (n, v)
    for n, v in bad:
        assert got[n, v] == [], (n, v, got[n, v])


def test_byte_edges_and_null(spark):
    got = found(spark, [("dni", "è12345678Z"), ("email", "a@x.io,b@y.io"), ("email", ""), ("email", None), ("iban", "NO93 8601 1117 947 NO9386011117947")])
    assert [x[0] for x in got["dni", "è12345678Z"]] == ["12345678Z"]
    assert [x[:2] for x in got["email", "a@x.io,b@y.io"]] == [("a@x.io", 0), ("b@y.io", 7)]
    assert got["email", ""] == [] and got["email", None] == []
    assert [x[0] for x in got["iban", "NO93 8601 1117 947 NO9386011117947"]] == ["NO93 8601 1117 947", "NO9386011117947"]


def test_hostile_texts(spark):
    """Long repetitions neither overflow the matcher's stack nor take quadratic time."""
    texts = ["Via " + "Roma " * 5000 + "12", "Calle " + "Mayor " * 5000 + "12", "A" + "b-A" * 3000, "a" * 200_000, "Via Roma 1 50100 " + "Firenze " * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    names = ("address_it", "address_es", "address_de", "email")
    got = df.select(*[F.size(BUILT_IN[n].detect(F.col("text"))).alias(n) for n in names]).collect()
    assert got[0]["address_it"] == 1 and got[1]["address_es"] == 1 and got[3]["email"] == 0


def test_rule_flags(spark):
    def found(pattern, flags, text):
        return [x["value"] for x in CustomRuleDetector("r", CustomRuleSet((CustomRule("r", pattern, flags),))).spans(text)]

    assert found("a+", "uU", "aaa") == ["a", "a", "a"] and found("a+?", "uU", "aaa") == ["aaa"] and found("[+]a{1,2}", "uU", "+aa") == ["+a"]
    assert found("(?:a)*b", "uU", "aab") == ["aab"] and found(r"\+x?", "uU", "+x") == ["+"]
    assert found("ab", "uA", "abab ab") == ["ab", "ab"] and found("a b # x", "uAx", "abab") == ["ab", "ab"]
    assert found("a$", "u", "a\n") == ["a"] and found("a$", "uD", "a\n") == [] and found("a$", "uDm", "a\n") == ["a"] and found("[$]a", "uD", "$a") == ["$a"]
    assert found("(?<n>a)|(?<n>b)", "uJSX", "ab") == ["a", "b"]


def test_failed_rules_are_told(spark):
    rules = CustomRuleSet((CustomRule("runaway", "(a|aa)+$"), CustomRule("sound", "!")))
    det = CustomRuleDetector("r", rules, seconds=0.05)
    df = spark.createDataFrame([("a" * 60 + "!",), ("!",), (None,)], "text string")
    got = df.select(det.detect(F.col("text")).alias("d"), det.failed(F.col("text")).alias("failed")).collect()
    assert [(len(r["d"]), r["failed"]) for r in got] == [(1, ["runaway"]), (1, []), (0, [])]


def test_long_german_names(spark):
    names = ["Am-" + "Neu-" * 80 + "Weg 7", "An-der-Weg-Straße 5", "Karl-Marx-Allee 12a", "Alt-Moabit-Ufer"]
    assert [[x["value"] for x in r["d"]] for r in spark.createDataFrame([(n,) for n in names], "text string").select(ADDRESS_DE.detect(F.col("text")).alias("d")).collect()] == [[names[0]], ["Weg-Straße 5"], [names[2]], [names[3]]]
