"""Patterns, tables and formats that results depend on, in one place."""

# ---- Fixed values: word edges of patterns that work on bytes, where letters are ASCII alone.
B, E = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"

# ---- Fixed values: patterns of single detectors (Java syntax).
EMAIL = r"(?i)(?:\G|(?<![A-Z0-9._%+\-]))[A-Z0-9._%+\-]++@[A-Z0-9.\-]+\.[A-Z]{2,63}"
IBAN_COMPACT = rf"(?i){B}[A-Z]{{2}}\d{{2}}[A-Z0-9]{{11,30}}{E}"
IBAN_SPACED = rf"(?i){B}[A-Z]{{2}}\d{{2}} [A-Z0-9]{{4}}(?: [A-Z0-9]{{4}}){{1,7}}(?: [A-Z0-9]{{1,4}})?{E}"
CREDIT_CARD = rf"{B}(?:\d[ \-]?){{12,18}}\d{E}"
CODICE_FISCALE = rf"(?i){B}[A-Z]{{6}}[\dLMNPQRSTUV]{{2}}[A-EHLMPRST][\dLMNPQRSTUV]{{2}}[A-Z][\dLMNPQRSTUV]{{3}}[A-Z]{E}"
ELEVEN_DIGITS = rf"{B}\d{{11}}{E}"
UST_IDNR = rf"(?i){B}DE\d{{9}}{E}"
DNI = rf"{B}\d{{8}}[A-Za-z]{E}"
NIE = rf"{B}[XYZxyz]\d{{7}}[A-Za-z]{E}"
CIF = rf"{B}[A-HJ-NP-SUVWa-hj-np-suvw]\d{{7}}[0-9A-Za-z]{E}"
PHONE_IT = r"(?<![0-9+])(?:(?:\+|00)39[\s.\-]?)?(?:3\d{2}[\s.\-]?\d{6,7}|0\d{1,3}[\s.\-]?\d{5,8})(?!\d)"
PHONE_DE = r"(?<![0-9+])(?:(?:\+49|0049)[\s.\-]?(?:\(0\)[\s.\-]?)?(?:1[5-7]\d[\s.\-]?\d{6,9}|\d{2,5}[\s.\-]?\d{4,10})|0(?:1[5-7]\d[\s.\-]?\d{6,9}|\d{1,4}[\s.\-]?\d{4,10}))(?!\d)"
PHONE_ES = r"(?<![0-9+])(?:(?:\+|00)34[\s.\-]?)?(?:[6789]\d{2}[\s.\-]?\d{3}[\s.\-]?\d{3}|[89]\d[\s.\-]\d{3}[\s.\-]\d{4})(?!\d)"

# ---- Fixed values: address patterns. They know Unicode letters. Loops are possessive, or bounded where
# something must follow them, because Java's matcher would otherwise recurse once a repetition.
_IT_JOIN = "dell'|nell'|sull'|coll'|all'|dei|della|delle|degli|dello|del|di|d'"
ADDRESS_IT = (
    r"(?U)\b(?iu:V\.le|Viale|Via|P\.zza|Piazzetta|Piazza|C\.so|Corso|L\.go|Largo|Strada|Vicolo|Vico|Calle|Salita|Lungomare|Località|Loc\.)"
    rf"(?:\s+(?:{_IT_JOIN}))*+"
    r"(?:\s+|(?<='))[A-ZÀ-Ý][A-Za-zÀ-ÿ']*"
    rf"(?:\s+(?:[A-ZÀ-Ý][A-Za-zÀ-ÿ']*|{_IT_JOIN}))*+"
    r"(?:\s*,?\s*(?:n\.?\s*)?\d+(?:\s*/\s*[A-Z]|\s*bis|\s*ter)?"
    r"(?:\s*-?\s*\d{5}\s+[A-ZÀ-Ý][A-Za-zÀ-ÿ']+(?:\s+[A-ZÀ-Ý][A-Za-zÀ-ÿ']+)*+)?)?"
)
_DE_NUMBER = r"[\s,]+\d+[a-zA-Z]?(?:\s*-\s*\d+[a-zA-Z]?)?"
_DE_CITY = r"(?:[\s,]+\d{5}\s+[A-ZÄÖÜ][a-zäöüß]+(?:[\-\s][A-ZÄÖÜ][a-zäöüß]+)*+)?"
# Hyphenated parts that are no kind of way have one reading, so any number of them is taken; only kinds
# of way within a name ("An-der-Weg-Straße") are tried in turn, 50 of them at most.
_DE_WAY = r"(?iu:Straße|strasse|Str\.|Allee|Platz|Weg|Gasse|Ring|Damm|Ufer|Brücke|Hof)"
_DE_OTHERS = rf"(?:\-(?!{_DE_WAY})[A-ZÄÖÜ][a-zäöüß]+)*+"
ADDRESS_DE = (
    r"(?U)(?:"
    rf"\b[A-ZÄÖÜ][a-zäöüß]+(?:{_DE_OTHERS}\-(?={_DE_WAY})[A-ZÄÖÜ][a-zäöüß]+){{0,50}}{_DE_OTHERS}\-{_DE_WAY}(?:{_DE_NUMBER})?{_DE_CITY}"
    rf"|\b[A-ZÄÖÜ][a-zäöüß]+\s+(?iu:Straße|strasse|Str\.|Allee|Platz)(?:{_DE_NUMBER})?{_DE_CITY}"
    rf"|\b[A-ZÄÖÜ][a-zäöüß]+(?iu:straße|strasse|str\.|allee|platz|weg|gasse|ring|damm|ufer|brücke|hof){_DE_NUMBER}{_DE_CITY}"
    rf"|\b(?:Am|An\s+der|An\s+den|Auf\s+der|Auf\s+dem|Im|In\s+der|In\s+den|Zur|Zum|Unter\s+den|Vor\s+dem|Hinter\s+der)\s+[A-ZÄÖÜ][a-zäöüß]+(?:{_DE_NUMBER})?{_DE_CITY}"
    r")"
)
ADDRESS_ES = (
    r"(?U)\b(?iu:Avda\.|Avd\.|Avenida|Pza\.|Plaza|P\.º|Paseo|Carrer|Travesía|Glorieta|Ronda|C/|Calle)"
    r"(?:\s+de(?:\s+(?:la|los|las))?|\s+del)?"
    r"\s+[A-ZÁÉÍÓÚÑ][A-Za-záéíóúñ]+"
    r"(?:[\s\-](?:[A-ZÁÉÍÓÚÑ][A-Za-záéíóúñ]+|de|la|los|las|del))*+"
    r"(?:\s*,?\s*\d+[A-Za-z]?"
    r"(?:\s*,?\s*\d{5}\s+[A-ZÁÉÍÓÚÑ][A-Za-záéíóúñ]+(?:\s+[A-ZÁÉÍÓÚÑ][A-Za-záéíóúñ]+)*+)?)?"
)

# ---- Fixed values: length of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29,
    "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19,
    "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TL": 23, "TN": 24,
    "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

# ---- Fixed values: check characters.
CF_ODD = {
    "0": 1, "1": 0, "2": 5, "3": 7, "4": 9, "5": 13, "6": 15, "7": 17, "8": 19, "9": 21,
    "A": 1, "B": 0, "C": 5, "D": 7, "E": 9, "F": 13, "G": 15, "H": 17, "I": 19, "J": 21, "K": 2, "L": 4, "M": 18,
    "N": 20, "O": 11, "P": 3, "Q": 6, "R": 8, "S": 12, "T": 14, "U": 16, "V": 10, "W": 22, "X": 25, "Y": 24, "Z": 23,
}
CF_DIGIT_PLACES = (6, 7, 9, 10, 12, 13, 14)
CF_LETTERS_FOR_DIGITS = "LMNPQRSTUV"
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
NIE_LEADERS = "XYZ"
CIF_LETTERS = "JABCDEFGHI"
CIF_LETTER_LEADERS = "KPQS"
CIF_DIGIT_LEADERS = "ABEH"

# ---- Fixed values: labels of entity recognisers.
HF_LABELS = {"PER": "person", "PERSON": "person", "ORG": "organisation", "LOC": "location", "MISC": "misc"}
SPACY_LABELS = {"PERSON": "person", "PER": "person", "ORG": "organisation", "GPE": "location", "LOC": "location", "NORP": "group", "FAC": "facility"}

# ---- Fixed values: tokens, defaults and limits.
MASK = "[REDACTED]"
TOKEN = r"\[tok:[A-Za-z0-9_]+:[0-9a-f]+\]"
TOKEN_WHOLE = r"^\[tok:([^:]+):[0-9a-f]+\]$"
SAMPLES = 5
LEGACY_TENANT = "default"
HF_MODEL = "Davlan/bert-base-multilingual-cased-ner-hrl"
HF_URL = "https://api-inference.huggingface.co"
