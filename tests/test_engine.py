"""Engine, strategies, reports, packs, rules, recognisers, configuration and the command line."""

import io
import json

import pytest
from pyspark.sql import functions as F

from glyphveil import cli, pii
from glyphveil.errors import CustomRuleError, DetectorError, PackError, StrategyError
from glyphveil.operators import custom_rules, ner, packs, reports
from glyphveil.operators import detectors as d
from glyphveil.operators.engine import Engine, default_engine
from glyphveil.operators.strategies import Drop, FunctionStrategy, Hash, Mask, PythonStrategy, Tokenise, make_strategy
from glyphveil.plans.admin import snapshot
from glyphveil.sources.config import Config, build_engine, build_ner, from_environment
from glyphveil.tenancy import LazyTenant, default_tenant


def redacted(spark, engine, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r[0] for r in df.orderBy("i").select(engine.redact(F.col("text"))).collect()]


def test_golden(spark):
    e = default_engine(strategy=Mask("[X]"))
    assert redacted(spark, e, "A: a@x.io, B: b@y.io, IBAN: IT60X0542811101000000123456.", "", None, "none") == ["A: [X], B: [X], IBAN: [X].", "", None, "none"]
    assert redacted(spark, e, "📧🎉👋 mario@example.com 🚀") == ["📧🎉👋 [X] 🚀"]
    assert redacted(spark, e.with_enabled(False), "a@x.io") == ["a@x.io"]
    drop = Engine(Drop()).register(d.PatternDetector("albo", (r"ISCR-\d+",)))
    assert redacted(spark, drop, "Avvocato ISCR-12345 di Milano.") == ["Avvocato  di Milano."]


def test_overlap(spark):
    e = Engine(Mask("[X]")).register(d.PatternDetector("a", ("abcde",))).register(d.PatternDetector("b", ("cdefg",)))
    assert redacted(spark, e, "abcdefghij") == ["[X]fghij"]
    touching = Engine(Mask("[X]")).register(d.PatternDetector("a", ("ab",))).register(d.PatternDetector("b", ("cd",)))
    assert redacted(spark, touching, "abcd") == ["[X][X]"]
    tie = Engine(FunctionStrategy("n", lambda v, n: n)).register(d.PatternDetector("first", ("abc",))).register(d.PatternDetector("second", ("abc",)))
    assert redacted(spark, tie, "abc") == ["first"]
    again = tie.register(d.PatternDetector("first", ("ab",)))
    assert list(again.detectors) == ["first", "second"] and redacted(spark, again, "abc") == ["second"]


def test_strategies(spark):
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    one = Engine().register(d.EMAIL)
    assert redacted(spark, one.with_strategy(Hash("s")), "a@x.io") == [f"[hash:{sha('email:s:a@x.io')[:16]}]"]
    assert redacted(spark, one.with_strategy(Tokenise("s")), "a@x.io") == [f"[tok:email:{sha('s:email:a@x.io')[:16]}]"]
    assert redacted(spark, one.with_strategy(Tokenise("s", tenant="t")), "a@x.io") == [f"[tok:email:{sha('s:t:email:a@x.io')[:16]}]"]
    assert redacted(spark, one.with_strategy(Tokenise("s", tenant="default")), "a@x.io") == [f"[tok:email:{sha('s:email:a@x.io')[:16]}]"]
    assert redacted(spark, one.with_strategy(PythonStrategy("up", lambda v, n: f"<{n}:{v.upper()}>")), "è a@x.io b@y.io", "none", None) == ["è <email:A@X.IO> <email:B@Y.IO>", "none", None]
    for bad in (lambda: Hash(""), lambda: Hash("s", 3), lambda: Tokenise("s", 7), lambda: Tokenise(""), lambda: make_strategy("odd"), lambda: make_strategy("hash")):
        with pytest.raises(StrategyError):
            bad()


def test_reports_and_audit(spark):
    e = default_engine().with_audit(True)
    text = " ".join(f"u{i}@x.io" for i in range(7)) + " u0@x.io 4242424242424242"
    df = e.apply(spark.createDataFrame([(text,), ("none",)], "text string"))
    r = df.withColumn("r", reports.report(F.col("detections"))).withColumn("safe", reports.safe(F.col("r"))).collect()
    assert r[0]["r"]["total"] == 9 and dict(r[0]["r"]["counts"]) == {"email": 8, "credit_card": 1}
    assert r[0]["r"]["samples"]["email"] == [f"u{i}@x.io" for i in range(5)]
    assert r[0]["safe"]["samples"]["email"] == ["[email]"] * 5
    assert r[0]["audit"]["total"] == 9 and r[0]["audit"]["strategy"] == "mask" and r[1]["audit"] is None
    assert e.with_audit(False).apply(spark.createDataFrame([(text,)], "text string")).first()["audit"] is None


def test_registration():
    with pytest.raises(DetectorError):
        Engine().register(d.PatternDetector("", ("x",)))
    with pytest.raises(DetectorError):
        Engine().extend("other", d.EMAIL)
    with pytest.raises(PackError):
        packs.PackRegistry(["nowhere"]).detectors()
    with pytest.raises(PackError):
        packs.PackRegistry([packs.Pack("p", "XX", "", ("no detector",))]).detectors()
    assert [x.name for x in packs.PackRegistry(["italy", packs.SPAIN]).detectors()] == ["codice_fiscale", "p_iva", "phone_it", "address_it", "dni", "nie", "cif", "phone_es", "address_es"]


def test_first_pack_wins(spark):
    value = "65929970489"  # a German tax id
    both = "12345678903"
    de_it = build_engine(Config(packs=("germany", "italy"), detectors=()))
    df = spark.createDataFrame([(value,), (both,)], "text string").select(de_it.detections(F.col("text")).alias("d")).collect()
    assert df[0]["d"][0]["detector"] == "steuer_id" and df[1]["d"][0]["detector"] == "p_iva"


def test_custom_rules(spark, tmp_path):
    f = tmp_path / "albo.yaml"
    f.write_text("rules:\n  - name: a\n    pattern: 'ISCR-\\d{6,}'\n    flags: u\n  - name: b\n    pattern: '\\bTess-[A-Z]{2}-\\d{4,8}\\b'\n")
    e = custom_rules.registered(Engine(Mask("[X]")), [{"name": "albo", "path": str(f)}])
    assert redacted(spark, e, "è ISCR-123456 e Tess-IT-1234", None, "") == ["è [X] e [X]", None, ""]
    rule = lambda p, fl="u": custom_rules.CustomRuleDetector("r", custom_rules.CustomRuleSet((custom_rules.CustomRule("r", p, fl),)))
    assert rule("a*").spans("hello") == []
    assert rule("(a+)+b").spans("a" * 36 + "!") == []
    assert [x["offset"] for x in rule("x").spans("èxx")] == [2, 3]
    assert rule("\\w+", "").spans("è ab")[0]["offset"] == 3
    three = custom_rules.CustomRuleDetector("r", custom_rules.CustomRuleSet(tuple(custom_rules.CustomRule("r", p) for p in ("mario@", r"@example\.com", r"mario@example\.com"))))
    assert len(three.spans("mario@example.com")) == 3
    for bad in ("rules: 3", "rules:\n - 1", "rules:\n - name: a", "rules:\n - pattern: a", "a: [", "rules:\n - {name: a, pattern: '('}"):
        f.write_text(bad)
        with pytest.raises(CustomRuleError):
            custom_rules.CustomRuleSet.load(str(f)).rules[0].compiled()
    for empty in ("", "null", "other: 1"):
        f.write_text(empty)
        assert custom_rules.CustomRuleSet.load(str(f)).is_empty()
    got = custom_rules.inspect_packs(spark, [{"name": "n", "path": str(f)}, {"name": "n", "path": "/none"}, 3]).collect()
    assert [(r["valid"], r["exists"], r["rule_count"]) for r in got] == [(True, True, 0), (False, False, 0), (False, False, 0)]
    with pytest.raises(CustomRuleError):
        custom_rules.registered(Engine(), [{"name": "x"}])


def hf(answer, status=200):
    def post(url, body, headers, seconds):
        if isinstance(answer, Exception):
            raise answer
        return status, answer if isinstance(answer, str) else json.dumps(answer)

    return ner.HuggingFaceRecogniser("key", post=post)


def test_recognisers(spark):
    row = {"entity_group": "per", "score": 0.9, "word": "x", "start": 2, "end": 6}
    assert hf([row]).spans("è Nuño") == [{"detector": "person", "value": "Nuño", "offset": 3, "length": 5}]
    for bad in ([{**row, "entity_group": "ODD"}], [{**row, "end": 2}], [{**row, "start": -1}], [{"entity": "PER"}], [3], {"error": 1}, "not json", [{**row, "start": 90, "end": 95}]):
        assert hf(bad).spans("è Nuño") == []
    assert hf([row], 503).spans("è Nuño") == [] and hf([row], 201).spans("è Nuño") == [] and hf(TimeoutError()).spans("x") == []
    spacy = ner.SpacyRecogniser("http://x", post=lambda *a: (200, json.dumps({"entities": [{"label": "GPE", "start_char": 0, "end_char": 4, "text": "Roma!"}, {"label": "ODD", "start_char": 0, "end_char": 4}]})))
    assert spacy.spans("Roma") == [{"detector": "location", "value": "Roma!", "offset": 0, "length": 4}]
    for bad in (lambda: ner.HuggingFaceRecogniser(""), lambda: ner.SpacyRecogniser("")):
        with pytest.raises(DetectorError):
            bad()

    def post(url, body, headers, seconds):
        return 200, json.dumps([{"entity_group": "PER", "start": 0, "end": 23}])

    e = Engine(Mask("[X]")).register(d.EMAIL).with_ner(ner.HuggingFaceRecogniser("key", post=post))
    assert redacted(spark, e, "User: mario@example.com.") == ["[X]."]
    assert isinstance(build_ner(Config()), ner.StubRecogniser) and isinstance(build_ner(Config(ner_enabled=True, ner_driver="odd")), ner.StubRecogniser)
    with pytest.raises(DetectorError):
        build_ner(Config(ner_enabled=True, ner_driver=3))


def test_config_tenant_admin(spark):
    c = from_environment({"PII_REDACTOR_STRATEGY": "hash", "PII_REDACTOR_SALT": "s", "PII_REDACTOR_ENABLED": "false", "PII_REDACTOR_HASH_LENGTH": "8", "PII_REDACTOR_AUDIT_TRAIL": "true"})
    assert (c.strategy, c.salt, c.enabled, c.hash_hex_length, c.audit_trail) == ("hash", "s", False, 8, True)
    assert [default_tenant(x) for x in (None, "", "0", "a")] == ["default", "default", "0", "a"]
    lazy = LazyTenant(fallback="f")
    lazy.resolve = lazy
    assert lazy() == "f" and LazyTenant(lambda: "t")() == "t"
    r = snapshot(spark, Config(salt="secret")).first()
    assert r["token_store"]["driver"] == "memory" and len(r["detectors"]) == 7 and "secret" not in str(r)


def test_facade_and_cli(spark, tmp_path):
    pii.configure(default_engine(strategy=Mask("[X]")))
    pii.extend("albo", d.PatternDetector("albo", (r"ISCR-\d+",)))
    df = spark.createDataFrame([("a@x.io ISCR-1",)], "text string")
    assert pii.redact(df).first()["text"] == "[X] [X]" and pii.scan(df).first()["report"]["total"] == 2
    f = tmp_path / "t.txt"
    f.write_text("a@x.io è/à", encoding="utf-8")
    run = lambda *a, **k: (cli.main(list(a), spark, default_engine(), out=(o := io.StringIO()), **k), o.getvalue())
    assert run(str(f)) == (0, '{"total":1,"counts":{"email":1},"samples":{"email":["[email]"]}}\n')
    assert json.loads(run(str(f), "--show-samples", "--pretty")[1])["samples"] == {"email": ["a@x.io"]}
    assert run("--from=stdin", stdin=io.StringIO("nothing"))[0] == 0
    assert run()[0] == 1 and run(str(f), "--from=stdin")[0] == 1 and run("/none")[0] == 2
