"""The registered queries of the detection engine, each with DuckDB SQL that tells its result another way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphveil import fixed
from glyphveil.functions.spans import resolve
from glyphveil.operators import detectors as d
from glyphveil.operators import reports
from glyphveil.operators.custom_rules import CustomRule, CustomRuleDetector, CustomRuleSet
from glyphveil.operators.engine import Engine, default_engine
from glyphveil.operators.ner import entities_from_json
from glyphveil.operators.packs import PackRegistry
from glyphveil.operators.strategies import Drop, FunctionStrategy, Hash, Mask, Tokenise
from glyphveil.plans.admin import snapshot
from glyphveil.scratch import once_written, shared_path
from glyphveil.sources import vault
from glyphveil.sources.config import Config
from glyphveil.streaming.redaction import available, redact_stream

SALT = "pepper"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _found(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Documents with the spans of e-mail addresses and valid cards, a row a detection."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", *keep, "text")
    return reports.detections_long(docs.withColumn("detections", default_engine().detections(F.col("text"))), keep=("doc_id", *keep))


_EMAIL = r"(?i)[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,63}"
_CARD = r"\b(?:\d[ \-]?){12,18}\d\b"
_LUHN = "list_sum(list_transform(range(length({0})), lambda i: CASE WHEN i % 2 = 0 THEN substr({0}, length({0}) - i, 1)::INT ELSE 2 * substr({0}, length({0}) - i, 1)::INT - CASE WHEN substr({0}, length({0}) - i, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
#: Spans by splitting: gaps and matches in turn, each place by the bytes before it.
_SPANS = f"""
found AS (
  SELECT doc_id, lang, 'email' AS detector, unnest(range(1, len(m) + 1)) AS i, m, g FROM (SELECT doc_id, lang, regexp_extract_all(text, '{_EMAIL}') AS m, regexp_split_to_array(text, '{_EMAIL}') AS g FROM documents)
  UNION ALL
  SELECT doc_id, lang, 'credit_card', unnest(range(1, len(m) + 1)), m, g FROM (SELECT doc_id, lang, regexp_extract_all(text, '{_CARD}') AS m, regexp_split_to_array(text, '{_CARD}') AS g FROM documents)),
placed AS (SELECT doc_id, lang, detector, m[i] AS value, (list_sum(list_transform(g[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: strlen(x))), 0))::INT AS "offset", strlen(m[i])::INT AS length, regexp_replace(m[i], '[ \\-]', '', 'g') AS digits FROM found),
spans AS (SELECT doc_id, lang, detector, value, "offset", length FROM placed WHERE detector = 'email' OR (length(digits) BETWEEN 13 AND 19 AND regexp_matches(digits, '[1-9]') AND {_LUHN.format('digits')}))
"""


def _replaced(new: str, where: str = "true") -> str:
    """Documents with each span's value replaced by new, the longest values first."""
    return f"""
WITH {_SPANS},
v AS (SELECT doc_id, list({{'a': value, 'b': {new}}} ORDER BY length(value) DESC, value) AS pairs FROM (SELECT DISTINCT doc_id, detector, value FROM spans WHERE {where}) GROUP BY doc_id),
paired AS (SELECT d.doc_id, d.text, coalesce(v.pairs, []) AS pairs FROM documents d LEFT JOIN v USING (doc_id)),
done AS (SELECT doc_id, CASE WHEN len(pairs) = 0 THEN text ELSE list_reduce(list_prepend(text, list_transform(pairs, lambda p: p.a || chr(1) || p.b)), lambda t, p: replace(t, split_part(p, chr(1), 1), split_part(p, chr(1), 2))) END AS redacted FROM paired)
SELECT doc_id, redacted FROM done
"""


@query(_replaced("'[REDACTED]'"))
def mask_documents(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", default_engine().with_everywhere(True).redact(F.col("text")).alias("redacted"))


@query(f"WITH {_SPANS} SELECT doc_id, detector, value, \"offset\", length FROM spans")
def detections(spark, sf_dir):
    return _found(spark, sf_dir)


@query(f"WITH {_SPANS} SELECT doc_id, value, \"offset\", length FROM spans WHERE detector = 'email'")
def email_detections(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.explode(d.EMAIL.detect(F.col("text"))).alias("d")).select("doc_id", "d.value", "d.offset", "d.length")


@query(f"WITH {_SPANS} SELECT lang, count(*) AS n FROM spans WHERE detector = 'email' GROUP BY lang")
def email_counts_by_lang(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("lang", "text")
    return docs.select("lang", F.explode(d.EMAIL.detect(F.col("text")))).groupBy("lang").agg(F.count("*").alias("n"))


@query(f"WITH {_SPANS} SELECT doc_id, value, \"offset\" FROM spans WHERE detector = 'credit_card'")
def card_luhn_filter(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.explode(d.CREDIT_CARD.detect(F.col("text"))).alias("d")).select("doc_id", "d.value", "d.offset")


def _redacting(strategy):
    def run(spark, sf_dir):
        docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
        return docs.select("doc_id", Engine(strategy).register(d.EMAIL).redact(F.col("text")).alias("redacted"))

    return run


for _name, _strategy, _new in (
    ("mask_email", Mask("[X]"), "'[X]'"),
    ("hash_email", Hash(SALT), f"'[hash:' || substr(sha256('email:{SALT}:' || value), 1, 16) || ']'"),
    ("tokenise_email", Tokenise(SALT), f"'[tok:email:' || substr(sha256('{SALT}:email:' || value), 1, 16) || ']'"),
    ("drop_email", Drop(), "''"),
):
    query(_replaced(_new, "detector = 'email'"), _name)(_redacting(_strategy))


@query(f"""WITH {_SPANS} SELECT d.doc_id, count(s.detector)::INT AS total, count(*) FILTER (s.detector = 'email')::INT AS n_email, count(*) FILTER (s.detector = 'credit_card')::INT AS n_card
FROM documents d LEFT JOIN spans s USING (doc_id) GROUP BY d.doc_id""")
def scan_report(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    r = docs.select("doc_id", default_engine().scan(F.col("text")).alias("r"))
    n = lambda k: F.coalesce(F.try_element_at("r.counts", F.lit(k)), F.lit(0))
    return r.select("doc_id", "r.total", n("email").alias("n_email"), n("credit_card").alias("n_card"))


@query(f"""WITH {_SPANS}, f AS (SELECT detector, value, min(doc_id) AS doc_id FROM spans GROUP BY detector, value),
o AS (SELECT f.detector, f.value, f.doc_id, min(s."offset") AS place FROM f JOIN spans s ON s.detector = f.detector AND s.value = f.value AND s.doc_id = f.doc_id GROUP BY ALL),
r AS (SELECT detector, value, row_number() OVER (PARTITION BY detector ORDER BY doc_id, place, value)::INT AS rank FROM o) SELECT detector, rank, value FROM r WHERE rank <= {fixed.SAMPLES}""")
def samples_capped(spark, sf_dir):
    return reports.corpus_samples(_found(spark, sf_dir), ("doc_id", "offset"))


@query(f"""WITH {_SPANS}, n AS (SELECT doc_id, detector, count(DISTINCT value) AS n FROM spans GROUP BY ALL)
SELECT doc_id, detector, least(n, {fixed.SAMPLES})::INT AS n_samples, '[' || detector || ']' AS sample FROM n""")
def safe_report(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    r = docs.select("doc_id", reports.safe(default_engine().scan(F.col("text"))).alias("r"))
    return r.select("doc_id", F.explode("r.samples").alias("detector", "s")).select("doc_id", "detector", F.size("s").alias("n_samples"), F.array_min("s").alias("sample"))


@query(f"WITH {_SPANS} SELECT lang, detector, count(*) AS n FROM spans GROUP BY ROLLUP (lang, detector)")
def counts_rollup(spark, sf_dir):
    return reports.corpus_counts(_found(spark, sf_dir, "lang"), ("lang",))


@query(f"WITH {_SPANS} SELECT 'mask' AS strategy, detector, count(*) AS n, count(DISTINCT doc_id) AS n_events FROM spans GROUP BY detector")
def audit_counts(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("text")
    events = default_engine().with_audit(True).apply(docs).where("audit IS NOT NULL").select("audit.strategy", F.explode("audit.counts").alias("detector", "k"))
    return events.groupBy("strategy", "detector").agg(F.sum("k").alias("n"), F.count("*").alias("n_events"))


_TENANT_SALT = f"CASE WHEN lang = 'en' THEN '{SALT}' ELSE '{SALT}:' || lang END"
_TENANT_TOKEN = f"'[tok:' || detector || ':' || substr(sha256({_TENANT_SALT} || ':' || detector || ':' || value), 1, 16) || ']'"


def _tenant_tokens(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    e = default_engine(strategy=Tokenise(SALT, tenant=F.col("lang"), legacy="en"))
    return e, docs.withColumn("detections", e.detections(F.col("text")))


@query(f"WITH {_SPANS} SELECT DISTINCT lang AS tenant_id, {_TENANT_TOKEN} AS token, value AS original, detector FROM spans")
def vault_entries(spark, sf_dir):
    e, docs = _tenant_tokens(spark, sf_dir)
    return vault.token_entries(docs, "detections", e.strategy, F.col("lang"))


def _stored(spark: SparkSession, docs: DataFrame, e: Engine) -> vault.TableStore:
    """A token store on disk with all that redacting docs mints."""
    store = vault.TableStore(spark, shared_path(spark, "store"))
    store.put(vault.token_entries(docs, "detections", e.strategy, F.col("lang")))
    return store


@query("SELECT doc_id, text AS output FROM documents")
def detokenise_roundtrip(spark, sf_dir):
    """Redacted to tokens that a store keeps, and back: the texts as they were."""
    e, docs = _tenant_tokens(spark, sf_dir)
    docs = once_written(docs, "detections")
    redacted = docs.select("doc_id", "lang", e.replaced(F.col("text"), F.col("detections")).alias("text"))
    return vault.detokenise(redacted, _stored(spark, docs, e), "text", F.col("lang")).select("doc_id", "detokenised.output")


@query(f"""WITH {_SPANS}, t AS (SELECT DISTINCT doc_id, {_TENANT_TOKEN} AS token, detector FROM spans)
SELECT d.doc_id, count(t.token)::INT AS token_count, count(*) FILTER (t.detector = 'email')::INT AS resolved_count, count(*) FILTER (t.detector = 'credit_card')::INT AS n_unresolved
FROM documents d LEFT JOIN t USING (doc_id) GROUP BY d.doc_id""")
def detokenise_stats(spark, sf_dir):
    """With only the addresses stored, the cards' tokens stay unresolved."""
    e, docs = _tenant_tokens(spark, sf_dir)
    docs = once_written(docs, "detections")
    mails = docs.withColumn("detections", F.filter("detections", lambda x: x["detector"] == "email"))
    redacted = docs.select("doc_id", "lang", e.replaced(F.col("text"), F.col("detections")).alias("text"))
    got = vault.detokenise(redacted, _stored(spark, mails, e), "text", F.col("lang"))
    return got.select("doc_id", "detokenised.token_count", "detokenised.resolved_count", F.size("detokenised.unresolved_tokens").alias("n_unresolved"))


_MINTED = f"minted AS (SELECT DISTINCT lang AS tenant_id, {_TENANT_TOKEN} AS token, value AS original, detector FROM spans)"


def _minted(spark, sf_dir) -> DataFrame:
    e, docs = _tenant_tokens(spark, sf_dir)
    return once_written(vault.token_entries(docs, "detections", e.strategy, F.col("lang")), "minted")


@query(f"WITH {_SPANS}, {_MINTED} SELECT tenant_id, token, CASE WHEN detector = 'email' THEN upper(original) ELSE original END AS original, detector FROM minted")
def store_upsert(spark, sf_dir):
    """All entries put, the addresses put again with another value, all put a third time for no tenant that is there: each token once, as last put."""
    new = _minted(spark, sf_dir)
    store = vault.TableStore(spark, shared_path(spark, "store"))
    store.put(new)
    twice = new.where("detector = 'email'")
    store.put(twice.withColumn("at", F.lit(1)).unionByName(twice.withColumn("original", F.upper("original")).withColumn("at", F.lit(2))), order="at")
    store.put(new.where("false"))
    return store.frame().select("tenant_id", "token", "original", "detector")


@query(f"""WITH {_SPANS}, {_MINTED} SELECT tenant_id, token, CASE WHEN tenant_id = 'en' THEN 'x' || original ELSE original END AS original, detector FROM minted
WHERE tenant_id <> 'de' AND (tenant_id <> 'en' OR detector = 'credit_card')""")
def store_load_clear(spark, sf_dir):
    """One tenant's entries loaded in place of all that it had, another's cleared; the others' stay."""
    new = _minted(spark, sf_dir)
    store = vault.TableStore(spark, shared_path(spark, "store"))
    store.put(new)
    store.load(new.where("tenant_id = 'en' AND detector = 'credit_card'").select("token", F.concat(F.lit("x"), "original").alias("original")), "en")
    store.clear("de")
    return store.frame().select("tenant_id", "token", "original", "detector")


@query(f"""WITH {_SPANS}, {_MINTED} SELECT 'pii_token:' || CASE WHEN tenant_id = 'en' THEN '' ELSE tenant_id || ':' END || sha256(token) AS key, original FROM minted WHERE detector = 'credit_card' OR tenant_id = 'en'""")
def store_expiry(spark, sf_dir):
    """Entries end a minute after they were last put: the cards, and one tenant's addresses, were put again in time."""
    new, now = _minted(spark, sf_dir), [1_700_000_000]
    store = vault.ExpiringStore(spark, shared_path(spark, "store"), ttl=60, legacy="en", clock=lambda: now[0])
    store.put(new)
    now[0] += 50
    store.put(new.where("detector = 'credit_card' OR tenant_id = 'en'"))
    now[0] += 30
    return store.keyed().select("key", "original")


@query(f"""WITH {_SPANS}, {_MINTED}, a AS (SELECT DISTINCT token FROM minted), t AS (SELECT DISTINCT tenant_id FROM minted)
SELECT t.tenant_id, a.token, m.original AS resolved FROM a CROSS JOIN t LEFT JOIN minted m ON m.token = a.token AND m.tenant_id = t.tenant_id
UNION ALL SELECT t.tenant_id, 'odd', NULL FROM t""")
def store_resolve(spark, sf_dir):
    """Every token asked for by every tenant: only its own tenant gets its value."""
    new = _minted(spark, sf_dir)
    store = vault.TableStore(spark, shared_path(spark, "store"))
    store.put(new)
    tenants = [F.lit(t) for t in ("de", "en", "es", "fr", "it")]
    asked = new.select("token").distinct().unionByName(spark.createDataFrame([("odd",)], "token string"))
    asked = asked.withColumn("tenant_id", F.explode(F.array(*tenants))).join(new.select("tenant_id").distinct(), "tenant_id", "left_semi")
    return vault.resolve_token(asked, store, tenant=F.col("tenant_id")).select("tenant_id", "token", "resolved")


# Numbers are built from keys, with the check character right where c_custkey isn't a multiple of
# three, else the next one. The SQL knows from the key which are right; it never tests them.
_N8 = "lpad(CAST((c_custkey * 7919 + 1234567) % 100000000 AS STRING), 8, '0')"
_W = "(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END)"


def _digit(text: str, i: int) -> str:
    return f"CAST(substr({text}, {i + 1}, 1) AS INT)"


def _doubled(text: str, i: int) -> str:
    return f"(2 * {_digit(text, i)} - CASE WHEN {_digit(text, i)} > 4 THEN 9 ELSE 0 END)"


def _mod11(text: str, n: int) -> str:
    p = "10"
    for i in range(n):
        p = f"((({_digit(text, i)} + {p} + 9) % 10 + 1) * 2 % 11)"
    return f"((11 - {p} + {_W}) % 10)"


_D10 = "lpad(CAST((c_custkey * 104729 + 1234567891) % 10000000000 AS STRING), 10, '0')"
_N7 = f"substr({_N8}, 2, 7)"
_ROTATED = "(substr('01234567890123456789', CAST(c_custkey % 10 AS INT) + 1, 9) || substr('0123456789', CAST(c_custkey % 10 AS INT) + 1, 1))"
_PIVA_SUM = " + ".join(_doubled("{0}", i) if i % 2 else _digit("{0}", i) for i in range(10)).format(_D10)
_CIF_SUM = " + ".join(_digit("{0}", i) if i % 2 else _doubled("{0}", i) for i in range(7)).format(_N7)
_CF_ODD = lambda i: f"CAST(substr('01000507091315171921', 2 * {_digit(_N8, i)} + 1, 2) AS INT)"
# RSSMRA and T, A stand for 8 + 18 + 12 + 12 + 8 + 0 and 14, 0 in the tables for their places.
_CF_SUM = f"(8 + 18 + 12 + 12 + 8 + 0 + 14 + 0 + {_CF_ODD(0)} + {_digit(_N8, 1)} + {_digit(_N8, 2)} + {_CF_ODD(3)} + {_CF_ODD(4)} + {_digit(_N8, 5)} + {_CF_ODD(6)})"
_IBAN_REST = f"((((CAST({_N8} AS BIGINT) % 97) * 100000000 + CAST({_N8} AS BIGINT)) % 97 * 100000000 + 42131400) % 97)"
IDS = {
    "dni": f"{_N8} || substr('{fixed.DNI_LETTERS}', CAST((CAST({_N8} AS BIGINT) + {_W}) % 23 AS INT) + 1, 1)",
    "nie": f"substr('XYZ', CAST(c_custkey % 2 AS INT) + 1, 1) || {_N7} || substr('{fixed.DNI_LETTERS}', CAST(((c_custkey % 2) * 10000000 + CAST({_N7} AS BIGINT) + {_W}) % 23 AS INT) + 1, 1)",
    "cif": f"'A' || {_N7} || CAST((10 - ({_CIF_SUM}) % 10 + {_W}) % 10 AS STRING)",
    "p_iva": f"{_D10} || CAST((10 - ({_PIVA_SUM}) % 10 + {_W}) % 10 AS STRING)",
    "steuer_id": f"{_ROTATED} || CAST({_mod11(_ROTATED, 10)} AS STRING)",
    "ust_idnr": f"'DE' || {_N8} || CAST({_mod11(_N8, 8)} AS STRING)",
    "codice_fiscale": f"'RSSMRA' || substr({_N8}, 1, 2) || 'T' || substr({_N8}, 3, 2) || 'A' || substr({_N8}, 5, 3) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(({_CF_SUM} + {_W}) % 26 AS INT) + 1, 1)",
    "iban": f"'DE' || lpad(CAST(98 - {_IBAN_REST} + {_W} AS STRING), 2, '0') || {_N8} || {_N8} || '42'",
}
SENTENCES = {
    "phone_it": (f"'+39 333 ' || {_N7}", f"'id-9999333' || {_N7}"),
    "phone_de": (f"'+49 30 ' || {_N8}", f"'9990151' || {_N8} || 'abc'"),
    "phone_es": (f"'+34 612 345 ' || substr({_N8}, 1, 3)", f"'512 345 ' || substr({_N8}, 1, 3)"),
    "address_it": ("'Via Roma ' || CAST(c_custkey AS STRING)", "'via roma ' || CAST(c_custkey AS STRING)"),
    "address_de": ("'Hauptstr. ' || CAST(c_custkey AS STRING)", "'die berliner straße ' || CAST(c_custkey AS STRING)"),
    "address_es": ("'Calle Mayor ' || CAST(c_custkey AS STRING)", "'calle mayor ' || CAST(c_custkey AS STRING)"),
}


def _judging(name: str, made: str):
    def run(spark, sf_dir):
        texts = _read(spark, sf_dir, "customer").select("c_custkey", F.expr(f"'No. è: ' || {made} || ' ; end'").alias("text"))
        spans = texts.select("c_custkey", d.BUILT_IN[name].detect(F.col("text")).alias("d"))
        return spans.select("c_custkey", F.size("d").alias("n"), F.coalesce(F.get("d", F.lit(0))["value"], F.lit("")).alias("value"), F.coalesce(F.get("d", F.lit(0))["offset"], F.lit(-1)).alias("offset"))

    return run


for _name in d.BUILT_IN:
    if _name in IDS:
        _right, _made, _key = IDS[_name], IDS[_name], "valid"
    elif _name in SENTENCES:
        _right, _bad = SENTENCES[_name]
        _made, _key = f"CASE WHEN c_custkey % 3 = 0 THEN {_bad} ELSE {_right} END", "found"
    else:
        continue
    query(f"SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS n, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE {_right} END AS value, CASE WHEN c_custkey % 3 = 0 THEN -1 ELSE 8 END AS \"offset\" FROM customer", f"{_name}_{_key}")(_judging(_name, f"({_made})"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'A: [X], B: [X], IBAN: ' || iban || '.' ELSE 'A: [X], B: [X], IBAN: [X].' END AS redacted
FROM (SELECT c_custkey, """ + IDS["iban"] + " AS iban FROM customer)")
def engine_default_pack(spark, sf_dir):
    k = "CAST(c_custkey AS STRING)"
    texts = _read(spark, sf_dir, "customer").select("c_custkey", F.expr(f"'A: a' || {k} || '@x.io, B: b' || {k} || '@y.io, IBAN: ' || {IDS['iban']} || '.'").alias("text"))
    return texts.select("c_custkey", default_engine(strategy=Mask("[X]")).redact(F.col("text")).alias("redacted"))


# All packs on one text. Its numbers begin so that no pattern of phones takes them; an eleven-digit one
# may pass another country's check by chance, so the SQL computes both checks of it, by the digits.
_SPREAD = "(SELECT count(*) FILTER (n > 0) <= 9 AND max(n) <= 3 AND count(*) FILTER (n IN (2, 3)) = 1 FROM (SELECT length({0}) - length(replace({0}, d, '')) AS n FROM (SELECT unnest(string_split('0 1 2 3 4 5 6 7 8 9', ' ')) AS d)))"


def _eleven(v: str) -> str:
    """In DuckDB: the detector that takes an eleven-digit number, the one registered first if both do."""
    ten = f"substr({v}, 1, 10)"
    luhn = f"({_LUHN.format(v)}) AND regexp_matches({v}, '[1-9]')"
    tax = f"{_SPREAD.format(ten)} AND {_mod11(v, 10).replace(_W, '0')} = {_digit(v, 10)}"
    return f"CASE WHEN {luhn} THEN '[p_iva]' WHEN {tax} THEN '[steuer_id]' ELSE {v} END"


#: Numbers that lead with digits with which no phone begins.
_LED = f"(CAST(c_custkey % 2 + 1 AS STRING) || substr({_D10}, 2))"
_LED8 = f"('15' || substr({_N8}, 3, 6))"
#: Ten digits, one of them twice.
_PLAIN = "(substr('12', CAST(c_custkey % 2 AS INT) + 1, 1) || substr('45678945678', CAST(c_custkey % 6 AS INT) + 1, 6) || substr('45678945678', CAST(c_custkey % 6 AS INT) + 1, 1) || substr('03', CAST(c_custkey % 2 AS INT) + 1, 1) || substr('21', CAST(c_custkey % 2 AS INT) + 1, 1))"
_PACKED = {
    "p_iva": IDS["p_iva"].replace(_D10, _LED),
    "steuer_id": IDS["steuer_id"].replace(_ROTATED, _PLAIN),
    **{k: IDS[k].replace(_N8, _LED8) for k in ("ust_idnr", "dni", "nie", "cif", "codice_fiscale", "iban")},
}


def _packed_sql() -> str:
    told = {k: f"CASE WHEN c_custkey % 3 = 0 THEN {k} ELSE '[{k}]' END" for k in _PACKED}
    told |= {k: _eleven(k) for k in ("p_iva", "steuer_id")}
    pieces = " || '; ' || ".join(told[k] for k in _PACKED)
    return f"SELECT c_custkey, {pieces} || '; [email]; [address_it]; [phone_es]' AS redacted FROM (SELECT c_custkey, {', '.join(f'{v} AS {k}' for k, v in _PACKED.items())} FROM customer)"


@query(_packed_sql())
def all_packs(spark, sf_dir):
    """The detectors of all countries together on one text: each value goes to the detector that its check and place make it."""
    e = Engine(FunctionStrategy("told", lambda v, n: F.concat(F.lit("["), n, F.lit("]"))))
    for x in (*d.DEFAULTS, *PackRegistry(["italy", "germany", "spain"]).detectors()):
        e = e.register(x)
    k = "CAST(c_custkey AS STRING)"
    numbers = " || '; ' || ".join(f"({v})" for v in _PACKED.values())
    texts = _read(spark, sf_dir, "customer").select("c_custkey", F.expr(f"{numbers} || '; m' || {k} || '@x.io; Via Roma ' || {k} || '; +34 612 345 ' || substr({_N8}, 1, 3)").alias("text"))
    return texts.repartition(spark.sparkContext.defaultParallelism).select("c_custkey", e.redact(F.col("text")).alias("redacted"))


@query("SELECT c_custkey, '[X] end [X]' AS redacted, 2 AS kept, 4 AS emitted FROM customer")
def overlap_resolution(spark, sf_dir):
    """The span that begins first swallows the address within it; of two equal spans the one registered first stays."""
    e = Engine(Mask("[X]")).register(d.EMAIL).register(d.PatternDetector("user", (r"User: \S+",))).register(d.PatternDetector("again", (r"(?<=end )\S+",)))
    k = "CAST(c_custkey AS STRING)"
    texts = _read(spark, sf_dir, "customer").select("c_custkey", F.expr(f"'User: u' || {k} || '@example.com end v' || {k} || '@example.com'").alias("text"))
    df = texts.withColumn("all", e.collect(F.col("text"))).withColumn("kept", e.detections(F.col("text")))
    return df.select("c_custkey", e.replaced(F.col("text"), F.col("kept")).alias("redacted"), F.size("kept").alias("kept"), F.size("all").alias("emitted"))


@query("SELECT c_custkey, 'è [albo] e [albo].' AS redacted, 2 AS n FROM customer")
def custom_rules(spark, sf_dir):
    rules = CustomRuleSet((CustomRule("number", r"ISCR-\d{6,}"), CustomRule("card", r"\bTess-[A-Z]{2}-\d{4,8}\b"), CustomRule("empty", "a*"), CustomRule("runaway", "(q+)+r")))
    e = Engine(Mask("[albo]")).register(CustomRuleDetector("albo", rules))
    texts = _read(spark, sf_dir, "customer").select("c_custkey", F.expr(f"'è ISCR-' || {_N8} || ' e Tess-IT-' || {_N7} || '.'").alias("text"))
    rule = e.detectors["albo"]
    df = texts.repartition(spark.sparkContext.defaultParallelism).withColumn("d", rule.detect(F.col("text"))).withColumn("failed", rule.failed(F.col("text")))
    # The rule of empty matches also finds runs of a, which don't occur in these texts.
    n = F.size(F.filter("d", lambda x: x["length"] > 5)) + F.size("failed")
    return df.select("c_custkey", e.replaced(F.col("text"), resolve(F.col("d"))).alias("redacted"), n.alias("n"))


@query("SELECT c_custkey, 'Così [person:' || c_name || '] [email:m' || CAST(c_custkey AS STRING) || '@x.io]' AS redacted FROM customer")
def ner_merge(spark, sf_dir):
    """Entities from answers in a column, after the detectors; unknown labels are dropped."""
    k = "CAST(c_custkey AS STRING)"
    texts = _read(spark, sf_dir, "customer").select("c_custkey", F.expr(f"'Così ' || c_name || ' m' || {k} || '@x.io'").alias("text"), F.expr("'[{\"entity_group\":\"per\",\"start\":5,\"end\":' || CAST(5 + length(c_name) AS STRING) || '},{\"entity_group\":\"ODD\",\"start\":0,\"end\":2}]'").alias("body"))

    class Answers:
        name = "answers"

        def detect(self, text):
            return entities_from_json(text, F.col("body"))

    e = Engine(FunctionStrategy("told", lambda v, n: F.concat(F.lit("["), n, F.lit(":"), v, F.lit("]")))).register(d.EMAIL).with_ner(Answers())
    return texts.select("c_custkey", e.redact(F.col("text")).alias("redacted"))


@query(_replaced("'[REDACTED]'"))
def streaming_redact(spark, sf_dir):
    """The documents as a stream, redacted to a table that is read back; found values are hidden wherever they occur."""
    # A pattern, since the table may be one file or a folder of them, and streams read folders or patterns.
    schema = _read(spark, sf_dir, "documents").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]").select("doc_id", "text")
    return available(redact_stream(stream, default_engine().with_everywhere(True)).select("doc_id", "redacted"))


@query()
def admin_snapshot(spark, sf_dir):
    return snapshot(spark, Config()).select("enabled", "default_strategy", "audit_trail_enabled", "token_store.driver", F.size("detectors").alias("n_detectors"), F.size("packs").alias("n_packs"))


ORACLE["admin_snapshot"] = "SELECT true AS enabled, 'mask' AS default_strategy, false AS audit_trail_enabled, 'memory' AS driver, 7 AS n_detectors, 1 AS n_packs"
