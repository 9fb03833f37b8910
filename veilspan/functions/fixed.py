"""Label names, word lists and patterns that results depend on."""

from __future__ import annotations

# Fixed values. Model label, canonical label, filter key, rule entity, match group, one of the base seven.
LABELS = [
    ("sg_phone_number", "SG_PHONE_NUMBER", "SG_PHONE_NUMBER", "SG_PHONE_NUMBER", "PHONE", True),
    ("sg_address", "SG_ADDRESS", "SG_ADDRESS", "SG_ADDRESS", "ADDRESS", True),
    ("sg_address_unit_number", "SG_ADDRESS_UNIT", "SG_ADDRESS_UNIT_NUMBER", "SG_UNIT_NUMBER", "ADDRESS", True),
    ("sg_address_block_number", "SG_ADDRESS_BLOCK", "SG_ADDRESS_BLOCK_NUMBER", "SG_ADDRESS_BLOCK_NUMBER", "ADDRESS", True),
    ("sg_postal_code", "SG_POSTAL_CODE", "SG_POSTAL_CODE", "SG_POSTAL_CODE", "ADDRESS", True),
    ("email_address", "EMAIL_ADDRESS", "EMAIL_ADDRESS", "EMAIL_ADDRESS", "EMAIL", True),
    ("sg_nric_fin", "SG_NRIC_FIN", "SG_NRIC_FIN", "SG_NRIC_FIN", "NRIC", True),
    ("account_number", "ACCOUNT_NUMBER", "ACCOUNT_NUMBER", "ACCOUNT_NUMBER", "ACCOUNT_NUMBER", False),
    ("full_name", "FULL_NAME", "FULL_NAME", "PERSON", "FULL_NAME", False),
]

# Fixed values. Other names that belong to a match group.
GROUP_SYNONYMS = {
    "PHONE": ["PHONE_NUMBER", "CONTACT_NUMBER", "SG_CONTACT_NUMBER", "SG_MOBILE_NUMBER", "MOBILE_NUMBER", "CONTACT"],
    "ADDRESS": ["ADDRESS", "POSTAL_CODE", "SG_ADDRESS_UNIT_NUMBER", "SG_ADDRESS_BLOCK_NUMBER"],
    "EMAIL": ["EMAIL"],
    "NRIC": ["NRIC_FIN", "NRIC", "SG_NRIC"],
}

# Fixed values. The model recognizer's own label names, each with the rule entity it stands for.
MODEL_SYNONYMS = {
    "sg_phone_number": "SG_PHONE_NUMBER",
    "sg_contact_number": "SG_PHONE_NUMBER",
    "sg_mobile_number": "SG_PHONE_NUMBER",
    "phone_number": "SG_PHONE_NUMBER",
    "contact_number": "SG_PHONE_NUMBER",
    "mobile_number": "SG_PHONE_NUMBER",
    "contact": "SG_PHONE_NUMBER",
    "sg_address": "SG_ADDRESS",
    "address": "SG_ADDRESS",
    "sg_address_unit_number": "SG_UNIT_NUMBER",
    "sg_address_block_number": "SG_ADDRESS_BLOCK_NUMBER",
    "email_address": "EMAIL_ADDRESS",
    "sg_nric_fin": "SG_NRIC_FIN",
    "sg_postal_code": "SG_POSTAL_CODE",
}

# Fixed values. Rule patterns.
PHONE = r"(?<!\d)(?<!\d[ -])(?:\+?65[ -]*)?[3689](?:[ -]*\d){7}(?![ -]*\d)"
ACCOUNT = r"\b\d{10}\b"
POSTAL = r"\b\d{6}\b"
UNIT = r"(?<![\d:.$])(?:#\s*)?\d{1,2}\s*-\s*\d{1,4}(?!\s*-\s*\d)"
BLOCK = r"\b(?:blk|block)\s*\d+[a-z]?\b"
SINGAPORE = r"\bSingapore\b"
POSTAL_WORDS = r"\b(postal\s*code|postcode|postal\s*code\s*is|postal)\b"
UNIT_EXCLUDED = (
    r"\b(hours?|hrs?|hr|hourly|minutes?|mins?|min|seconds?|secs?|sec|cubic\s*meters?|cubic\s*metres?|cu\s*m|m\^?3|"
    r"liters?|litres?|l|kwh|kw\s*h|kw-?hr|kilowatt\s*hours?|kw|kilowatt[s]?|wh|w\s*h|watt\s*hours?|watt[s]?|mwh|mw\s*h|"
    r"january|february|march|april|may|june|july|august|september|october|november|december|"
    r"jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec|expiry|expire|expires|expired|valid|validity|renewal|"
    r"visa|mastercard|card|credit|debit)\b"
)

# Fixed values. Street suffixes, words that stop a street name, and areas.
SUFFIXES = ["road", "rd", "street", "avenue", "ave", "lane", "ln", "crescent", "cres", "boulevard", "blvd", "quay", "gate", "gardens"]
STREET_STOPS = ["blk", "block", "address", "is", "at", "located"]
AREAS = [
    "Ang Mo Kio", "Bedok", "Bishan", "Boon Lay", "Bukit Batok", "Bukit Merah", "Bukit Panjang", "Bukit Timah",
    "Choa Chu Kang", "Clementi", "Geylang", "Hougang", "Jurong East", "Jurong West", "Kallang", "Lim Chu Kang",
    "Marina", "Marine Parade", "Marina East", "Marina South", "Newton", "Novena", "Orchard", "Pasir Ris",
    "Paya Lebar", "Punggol", "Pioneer", "Queenstown", "Rochor", "River Valley", "Sembawang", "Sengkang",
    "Serangoon", "Tampines", "Toa Payoh", "Tanglin", "Tengah", "Tuas", "Woodlands", "Yishun", "Yew Tee",
]

# Fixed values. Validity and context patterns.
NRIC_FULL = r"^[STFGMstfgm]\d{7}[A-Za-z]$"
NRIC_PREFIX_PIECE = r"^[STFGM]\d{1,7}[A-Z]?$"
NRIC_TAIL_PIECE = r"^\d{2,6}[A-Z]$"
ADDRESS_CONTEXT = (
    r"\b(?:Singapore|Blk|Block|Street|St|Road|Rd|Ave|Avenue|Drive|Dr|Lane|Crescent|Cres|"
    r"Close|Way|Place|Pl|Sector|Terrace|Walk|Park|Garden|Gardens|Hill|View|Heights|Estate|"
    r"Toa Payoh|Tampines|Jurong|Bedok|Ang Mo Kio|Woodlands|Yishun|Hougang|Sengkang|Punggol|"
    r"Bukit|Clementi|Pasir Ris|Bishan|Serangoon|Boon Lay|Geylang|Queenstown|Tanjong|"
    r"MacPherson|Kallang|Paya Lebar|Novena|Buona Vista)\b|#"
)
POSTAL_CONTEXT = r"\b(?:postal|poster|post)\s+code\b"
EMAIL_SHAPE = r"@|\bat\b|\.(?:com|sg|net|org|edu|gov)\b|\bdot\s+(?:com|sg|net|org)\b"
COMPANY_DOMAIN = r"\b(?:s[bp]|ht)\s*-?\s*group\b"
MONEY = r"\$|\d\.\d{2}\b"
LETTER_DIGITS = r"^[A-Za-z]\d+$|^\d+[A-Za-z]$"
UNIT_CLEAN = r"^#?\d{2}-\d{2,4}$"
UNIT_CONTEXT = r"\bunit\b|#"
UNIT_REJECTED = r"\b(?:reference|account)\s+number\b|\boutbound\b|\binbound\b"
FLOOR = r"\d+\s*(?:st|nd|rd|th)\s+floor"
BLOCK_CONTEXT = r"\bbl(?:oc)?k\b"
SPEAKER = r"^(?:speaker_\d+|unknown|caller|agent|customer)$"
NRIC_BOOST = r"\b[STFG]\d{7}[A-Za-z]\b"
NRIC_WORDS = r"\bnric\b|\bic\b|\bfin\b|\bidentification\b|\bidentity\b"
NAME_BEFORE = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2},\s*$"
EMAIL_BOOST = r"(\b[Aa]t\s+)([\w.-]+\.(?:com|net|org|edu)(?:\.sg)?)\b"

# Fixed values. Generic words a detector reports in place of a value.
GENERIC_WORDS = {
    "SG_ADDRESS": [
        "address", "mailing address", "mailing addresses", "office address", "residential address", "home address",
        "billing address", "delivery address", "postal address", "registered address", "residency address",
        "correspondence address", "company address", "service address", "street address", "new address",
        "current address", "updated address", "contact address", "promise address", "full address", "house address",
    ],
    "SG_UNIT_NUMBER": ["unit number"],
    "EMAIL_ADDRESS": ["email"],
}

# Fixed values. Spoken digits.
DIGIT_WORDS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0"}
REPEAT_WORDS = {"double": 2, "triple": 3}

# Fixed values. Thresholds, windows, scores.
THRESHOLD = 0.35
LABEL_THRESHOLDS = {"SG_ADDRESS_UNIT": 0.75, "SG_ADDRESS_BLOCK": 0.97}
RULE_THRESHOLD = 0.5
WINDOW_CHARS, WINDOW_OVERLAP = 1800, 400
HIGH, MODERATE, POSTAL_LOW, POSTAL_HIGH = 0.85, 0.60, 0.50, 0.90
GATE = 0.8
COMPLETE_DIGITS = 8

# Own choices, where a library would decide: shapes of national ids, emails and names.
NRIC_RULE = r"\b[STFGM]\d{7}[A-Z]\b"
EMAIL_RULE = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b"
PERSON_RULE = r"(?<=\b[Nn]ame is |\bthis is |\bThis is )[A-Z][a-z]+(?: [A-Z][a-z]+){1,3}\b"
PERSON_CAPITALISED = r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\b"
