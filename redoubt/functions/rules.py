"""The declarative pattern rules, as data.

A rule has an expression, a base confidence, an optional validator (by name, see
``checks``), an optional normaliser, context cues and locales.  Expressions are
written in the dialect they are specified in (ASCII \\d, \\w and \\b, Unicode \\s)
and translated once by ``scan.compile_rule``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

VERIFIED, STRONG, LIKELY, WEAK, HINT = 0.99, 0.85, 0.65, 0.40, 0.20


@dataclass(frozen=True)
class Rule:
    id: str
    type: str
    pattern: str
    base: float
    flags: str = ""
    group: int = 0
    check: str | Callable | None = None  # a name of ``checks.CHECKS`` or f(value, match, gain) to the gain, None to drop
    gain: float = 0.0
    norm: str | Callable = "none"  # a name of ``checks.NORMS`` or f(value)
    supports: tuple[str, ...] = ()
    suppresses: tuple[str, ...] = ()
    require: bool = False
    support_weight: float = 0.12
    locales: tuple[str, ...] = ()
    guard: str = ""  # a cheap class that a text must hold: see ``scan``, or a literal
    needs: tuple[str, ...] = ()  # lower-case literals, one of which a text must hold


# White space as the rules mean it, for a class of either engine.
SPACE = "\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"

# --- Fixed values: fragments, word lists and expressions of the rules. ---

MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?"
NAME = r"\p{Lu}\p{L}*(?:['’\-]\p{L}+)*"
STATES = "A[LKZR]|C[AOT]|D[EC]|FL|GA|HI|I[ADLN]|K[SY]|LA|M[ADEINOST]|N[CDEHJMVY]|O[HKR]|PA|RI|S[CD]|TN|TX|UT|V[AT]|W[AIVY]"
NUMBER_WORDS = {
    "zero": "0", "oh": "0", "o": "0", "nought": "0", "naught": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9", "ten": "10", "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16",
    "seventeen": "17", "eighteen": "18", "nineteen": "19", "twenty": "20", "thirty": "30", "forty": "40", "fifty": "50", "sixty": "60", "seventy": "70",
    "eighty": "80", "ninety": "90",
}
_NUMBERS = "|".join(sorted(NUMBER_WORDS, key=len, reverse=True))
_GAP = r"(?:[ ,-]|\r?\n(?!\s*\r?\n))+"
SPOKEN = rf"(?<![\p{{L}}-])(?:{_NUMBERS})(?:{_GAP}(?:and{_GAP})?(?:{_NUMBERS})){{2,}}(?![\p{{L}}-])"
HONORIFICS = (
    r"Mr|Mrs|Ms|Miss|Mx|Dr|Prof(?:essor)?|Sir|Dame|Lord|Lady|Rev(?:erend)?|Hon(?:ourable)?|Judge|Justice|Officer|Det(?:ective)?|Sgt|Sergeant|Insp(?:ector)?|Capt(?:ain)?|"
    r"Col(?:onel)?|Gen(?:eral)?|Lt|Lieutenant|Maj(?:or)?|Adm(?:iral)?|Sen(?:ator)?|Rep|Amb(?:assador)?"
)
ROLES = (
    r"[Nn]ame|[Ff]ull\s+name|[Cc]omplainant|[Cc]laimant|[Pp]laintiff|[Dd]efendant|[Rr]espondent|[Aa]ppellant|[Ww]itness|[Pp]atient|[Cc]lient|[Gg]uarantor|[Aa]pplicant|[Ee]mployee|"
    r"[Aa]uthor|[Oo]wner|[Cc]ontact|[Ss]igned|[Ss]ignature|[Pp]repared\s+by|[Rr]eviewed\s+by|[Ss]ubmitted\s+by|[Ii]nterviewed|[Aa]ttn|[Aa]ttention|[Cc]are\s+of|[Cc]/o"
)
NOT_A_NAME = frozenset((
    "january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december", "monday", "tuesday", "wednesday", "thursday",
    "friday", "saturday", "sunday", "department", "ministry", "agency", "bureau", "office", "court", "tribunal", "university", "hospital", "clinic", "limited", "ltd",
    "inc", "llc", "plc", "corporation", "company", "holdings", "group", "trust", "foundation", "street", "avenue", "road", "lane", "drive", "square", "station",
    "airport", "north", "south", "east", "west", "united", "states", "kingdom",
))
HEX6 = "[0-9A-Fa-f]{1,4}"
IPV6 = (
    rf"(?<![:.\w])(?:(?:{HEX6}:){{7}}{HEX6}|(?:{HEX6}:){{1,7}}:|(?:{HEX6}:){{1,6}}:{HEX6}|(?:{HEX6}:){{1,5}}(?::{HEX6}){{1,2}}|(?:{HEX6}:){{1,4}}(?::{HEX6}){{1,3}}|"
    rf"(?:{HEX6}:){{1,3}}(?::{HEX6}){{1,4}}|(?:{HEX6}:){{1,2}}(?::{HEX6}){{1,5}}|{HEX6}:(?::{HEX6}){{1,6}}|:(?:(?::{HEX6}){{1,7}}|:))(?![:\w]|\.[0-9A-Fa-f])"
)
_H = r"[^\S\n]"
_LABEL = rf"{_H}{{0,4}}[:#=]{_H}{{0,4}}"
_IP_LABEL = r"IP(?:v4)?(?:\s+address)?|originat(?:ed|ing)\s+from|source\s+(?:IP|address)|remote\s+(?:IP|address)|client\s+IP"


CONTACT = (
    Rule("contact.email", "contact.email", r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~.-]{1,64}@[A-Za-z0-9.-]{1,253}\.[A-Za-z]{2,24}", STRONG, check="email", gain=0.10, norm="lower", guard="@"),
    Rule("contact.phone", "contact.phone", r"(?<![\w+])\+?\d[\d\s().-]{5,18}\d(?:\s*(?:ext|extn|x|#)\.?\s*\d{1,6})?(?!\w)", WEAK, "i", check="phone", gain=0.25, norm="phone", guard="digit",
         supports=("phone", "tel", "telephone", "mobile", "cell", "fax", "contact", "contactable", "call", "reachable", "reach", "dial", "hotline", "switchboard", "extension", "ext", "whatsapp", "sms", "text"),
         suppresses=("invoice", "order", "ref", "reference", "case", "docket", "isbn", "sku", "part", "serial", "tracking")),
    Rule("contact.address.labelled", "contact.address",
         r"(?<!\b(?:IP|IPv4|IPv6|MAC|email|e-mail|web|network|wallet|bitcoin|contract)\s)(?:home\s+|billing\s+|postal\s+|mailing\s+|street\s+|residential\s+)?address(?:es)?(?:\s+(?:is|are))?"
         rf"{_H}{{0,4}}[:#=]?{_H}{{0,4}}([^\n,]{{3,60}}(?:,[^\n,]{{2,60}}){{0,3}}?)(?=\s*,?\s*(?:[A-Z]{{1,2}}\d[A-Z\d]?\s?\d[A-Z]{{2}}\b|\d{{5}}(?:-\d{{4}})?\b|\Z|\.\s))",
         LIKELY, "i", 1, check="address_line", gain=0.15, norm="lower_ws", needs=("address",)),
    Rule("contact.address.street", "contact.address",
         r"\b\d{1,6}[A-Za-z]?\s+(?:[A-Z][A-Za-z'.-]{1,20}\s+){1,4}(?:Street|St|Avenue|Ave|Boulevard|Blvd|Road|Rd|Lane|Ln|Drive|Dr|Court|Ct|Place|Pl|Terrace|Ter|Way|Circle|Cir|Parkway|Pkwy|Square|Sq|Highway|Hwy)\b\.?",
         LIKELY, norm="lower_ws", locales=("en",), guard="digit"),
    Rule("contact.address.po-box", "contact.address", r"\b(?:P\.?\s?O\.?\s?Box|Post\s+Office\s+Box)\s+\d{1,7}\b", STRONG, "i", norm="lower_alnum", locales=("en",), guard="digit"),
    Rule("contact.handle", "contact.handle", r"(?<![\w@./])@[A-Za-z0-9_]{2,30}\b(?!\.[A-Za-z]{2,})", WEAK, norm="lower", guard="@", require=True,
         supports=("twitter", "x", "instagram", "telegram", "signal", "handle", "username", "account", "follow", "mastodon", "tiktok", "github")),
    Rule("net.url", "net.url", r"\bhttps?://[^\s<>\"'`\]),]{4,2048}", STRONG, norm="url", guard=":", needs=("http",)),
    Rule("secret.url-credentials", "secret.password", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{1,128}@[^\s/]{1,253}", VERIFIED, "i", guard="@"),
)
PEOPLE = (
    Rule("person.name.honorific", "person.name", rf"(?:{HONORIFICS})\.?\s+({NAME}(?:\s+{NAME}){{0,2}})", STRONG, "u", 1, check="name", gain=0.10, norm="lower_ws", guard="honorific"),
    Rule("person.name.labelled", "person.name", rf"(?:{ROLES})\s*[:,]?\s+({NAME}(?:\s+{NAME}){{1,3}})", LIKELY, "u", 1, check="name", gain=0.18, norm="lower_ws", needs=("name", "complainant", "claimant", "plaintiff", "defendant", "respondent", "appellant", "witness", "patient", "client", "guarantor", "applicant", "employee", "author", "owner", "contact", "signed", "signature", "prepared", "reviewed", "submitted", "interviewed", "attn", "attention", "care", "c/o")),
    Rule("person.name.slash", "person.name", r"(?<![\w/])\p{Lu}[\p{Lu}'’ -]{1,30}/\p{Lu}[\p{Lu}'’ -]{1,30}(?![\w/])", LIKELY, "u", check="name", gain=0.14, norm="lower_ws", guard="/"),
    Rule("person.name.surname-first", "person.name", rf"(?<![,\w])({NAME}),\s+({NAME})(?:\s+{NAME})?(?![,\w])", WEAK, "u", check="name", gain=0.10, norm="lower_ws", require=True,
         supports=("name", "surname", "index", "record", "file", "v", "versus", "signed", "author")),
    Rule("org.name.legal-form", "org.name",
         rf"(?:{NAME}\s+){{1,4}}(?:Ltd|Limited|LLC|L\.L\.C|Inc|Incorporated|Corp|Corporation|PLC|plc|LLP|GmbH|AG|S\.A|SARL|B\.V|N\.V|Pty|Pte|A/S|AB|Oy)\.?", STRONG, "u", norm="org", guard="legal"),
    Rule("org.record-id", "org.employee-id",
         r"(?:user[_\s-]?id|account[_\s-]?id|customer[_\s-]?id|subscriber[_\s-]?id|member[_\s-]?id|record[_\s-]?id|case[_\s-]?(?:id|number|no\.?)|client[_\s-]?id|profile[_\s-]?id|uid|guid)"
         r"[\"'\s]{0,4}[:=][\"'\s]{0,4}([A-Za-z0-9][A-Za-z0-9._-]{2,48})", STRONG, "i", 1, norm="upper", needs=("user", "account", "customer", "subscriber", "member", "record", "case", "client", "profile", "uid", "guid")),
    Rule("org.employee-id", "org.employee-id", r"(?<![A-Z0-9-])[A-Z]{0,3}-?\d{4,10}(?![A-Z0-9-])", HINT, norm="upper_nohyphen", guard="digit", require=True, support_weight=0.35,
         supports=("employee", "staff", "personnel", "payroll", "badge", "emp no", "emp id", "worker")),
)
IDENTITY = (
    Rule("gov.ssn.us.labelled", "gov.ssn", rf"(?:SSN|S\.S\.N|Social\s+Security(?:\s+(?:Number|No\.?|#))?|Tax\s?ID(?:\s*/\s*SSN)?){_H}{{0,4}}[:#=]?{_H}{{0,4}}(\d{{3}}[- ]?\d{{2}}[- ]?\d{{4}})(?![\d-])",
         VERIFIED, "i", 1, norm="strip", guard="digit", needs=("ssn", "s.s.n", "social", "tax")),
    Rule("gov.national-id.labelled", "gov.national-id",
         rf"(?:National\s+(?:ID|Insurance)|NRIC|Aadhaar|CPF|SIN|Personnummer|Fiscal\s+Code){_H}{{0,4}}(?:Number|No\.?|#)?{_LABEL}([A-Z0-9][A-Z0-9 .-]{{4,24}}[A-Z0-9])", STRONG, "i", 1, norm="strip_upper", needs=("national", "nric", "aadhaar", "cpf", "sin", "personnummer", "fiscal")),
    Rule("gov.ssn.us.formatted", "gov.ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", STRONG, check="ssn", gain=0.14, norm="strip", locales=("en-US",), guard="digit"),
    Rule("gov.ssn.us.bare", "gov.ssn", r"(?<![\d-])\d{9}(?![\d-])", WEAK, check="ssn", gain=0.20, locales=("en-US",), norm="same", guard="digit", require=True,
         supports=("ssn", "social security", "soc sec", "ss#", "ssa", "tin", "taxpayer"), suppresses=("phone", "zip", "account", "invoice", "routing")),
    Rule("gov.tax-id.us.itin", "gov.tax-id", r"(?<![\d-])9\d{2}-(?:5\d|6[0-5]|7\d|8[0-8]|9[0-2]|9[4-9])-\d{4}(?![\d-])", STRONG, norm="strip", locales=("en-US",), guard="digit"),
    Rule("gov.tax-id.us.ein", "gov.tax-id", r"(?<![\d-])\d{2}-\d{7}(?![\d-])", WEAK, norm="strip", locales=("en-US",), guard="digit", require=True,
         supports=("ein", "employer identification", "federal tax", "fein", "tax id")),
    Rule("gov.national-id.uk.nino", "gov.national-id", r"(?<![A-Z0-9])[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D](?![A-Z0-9])", STRONG, "i", check="nino", gain=0.14,
         norm="strip_upper", locales=("en-GB",), guard="digit"),
    Rule("gov.passport", "gov.passport", r"(?<![A-Z0-9])[A-Z]{0,2}\d{6,9}(?![A-Z0-9])", HINT, check="not_placeholder", gain=0.05, norm="upper", guard="digit", require=True, support_weight=0.35,
         supports=("passport", "travel document", "document no", "document number", "mrz")),
    Rule("gov.mrz.td3", "gov.mrz", r"(?<![A-Z0-9<])P[A-Z<][A-Z]{3}[A-Z0-9<]{39}\r?\n[A-Z0-9<]{44}(?![A-Z0-9<])", STRONG, check="mrz", gain=0.14, norm="no_ws", guard="<"),
    Rule("gov.driver-license", "gov.driver-license", r"(?<![A-Z0-9])[A-Z]{1,2}[- ]?\d{4,12}(?![A-Z0-9])", HINT, norm="strip_upper", guard="digit", require=True, support_weight=0.35,
         supports=("driver", "licence", "license", "dl no", "dl#", "dln", "operator permit")),
    Rule("person.dob", "person.dob",
         r"(?<![\d/-])(?:\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}|\d{4}-\d{2}-\d{2}|\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?,?\s+\d{4})(?![\d/-])", WEAK, "i", norm="lower_ws",
         guard="digit", require=True, support_weight=0.40, supports=("dob", "date of birth", "born", "birth date", "birthdate", "birthday", "d.o.b")),
)
FINANCIAL = (
    Rule("financial.card.track", "financial.card", r"%?[A-Z]\d{12,19}\^[A-Z0-9 ./'-]{2,60}\^\d{4,}[^\s?]{0,60}\??", VERIFIED, norm="upper", guard="^"),
    Rule("financial.card.labelled", "financial.card",
         rf"(?:card\s*(?:number|no\.?|#)?|PAN|primary\s+account\s+number|visa|mastercard|amex|american\s+express){_H}{{0,12}}[:#=is]{_H}{{0,4}}((?:\d[ -]?){{11,18}}\d)(?![\d-])", VERIFIED, "i", 1,
         norm="strip", guard="digit", needs=("card", "pan", "primary", "visa", "amex", "american")),
    Rule("financial.iban.labelled", "financial.iban", rf"(?:IBAN|International\s+Bank\s+Account)(?:\s*/\s*\w+)?{_LABEL}([A-Z]{{2}}[A-Z0-9 ]{{10,40}}[A-Z0-9])", VERIFIED, "i", 1, norm="strip_upper", needs=("iban", "international")),
    Rule("financial.account.labelled", "financial.account",
         rf"(?:Account\s*(?:Number|No\.?|ID|#)|Acct\.?\s*(?:No\.?|#)?|A/C){_H}{{0,12}}[:#=]{_H}{{0,4}}([A-Z0-9][A-Z0-9 .-]{{3,30}}[A-Z0-9])", STRONG, "i", 1, norm="strip_upper", needs=("account", "acct", "a/c")),
    Rule("financial.card.cvv", "financial.card",
         rf"(?:CVV2?|CVC2?|CID|Security\s+Code|Card\s+Verification(?:\s+(?:Value|Code))?)(?:{_H}{{0,4}}[:#=]|[^\n]{{0,40}}?\b(?:is|was)\b){_H}{{0,4}}(\d{{3,4}})(?!\d)", VERIFIED, "i", 1, norm="same", guard="digit", needs=("cvv", "cvc", "cid", "security", "verification")),
    Rule("financial.card.expiry", "financial.card",
         rf"(?:Exp(?:iry|ires|iration)?\.?(?:\s*Date)?){_H}{{0,12}}(?:[:#=]|\bis\b){_H}{{0,4}}(\d{{1,2}}\s*[/-]\s*\d{{2,4}})(?![\d/-])", STRONG, "i", 1, norm="no_ws", guard="digit", needs=("exp",)),
    Rule("financial.card", "financial.card", r"(?<![\d-])(?:\d[ -]?){11,18}\d(?![\d-])", LIKELY, check="card", gain=0.34, norm="strip", guard="digit", suppresses=("isbn", "imei", "tracking", "shipment")),
    Rule("financial.iban", "financial.iban", r"(?<![A-Z0-9])[A-Z]{2}\d{2}[ ]?(?:[A-Z0-9]{4}[ ]?){2,7}[A-Z0-9]{1,4}(?![A-Z0-9])", LIKELY, check="iban", gain=0.34, norm="strip_upper", guard="digit"),
    Rule("financial.routing.aba", "financial.routing", r"(?<![\d-])\d{9}(?![\d-])", HINT, check="aba", gain=0.30, norm="same", locales=("en-US",), guard="digit", require=True, support_weight=0.30,
         supports=("routing", "aba", "rtn", "ach", "wire", "transit", "bank")),
    Rule("financial.swift-bic", "financial.account", r"(?<![A-Z0-9])[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?(?![A-Z0-9])", WEAK, norm="upper", require=True,
         supports=("swift", "bic", "iban", "beneficiary", "correspondent", "remit")),
    Rule("financial.account.generic", "financial.account", r"(?<![\d-])\d{6,17}(?![\d-])", HINT, check="not_placeholder", gain=0.05, norm="same", guard="digit", require=True, support_weight=0.30,
         supports=("account", "acct", "a/c", "iban", "sort code", "deposit", "checking", "savings"), suppresses=("invoice", "order", "quantity", "total", "amount", "phone", "zip", "postcode")),
    Rule("financial.crypto-address", "financial.crypto-address",
         r"(?<![A-Za-z0-9])(?:bc1[a-z0-9]{25,62}|[13][1-9A-HJ-NP-Za-km-z]{25,34}|0x[a-fA-F0-9]{40}|[LM][1-9A-HJ-NP-Za-km-z]{26,33}|r[1-9A-HJ-NP-Za-km-z]{24,34}|4[0-9AB][1-9A-HJ-NP-Za-km-z]{93})(?![A-Za-z0-9])",
         LIKELY, norm="crypto", guard="run25"),
)
HEALTH = (
    Rule("health.record-number.labelled", "health.record-number",
         rf"(?:NHS\s*(?:Number|No\.?|#)?|Medical\s+Record\s*(?:Number|No\.?|#)?|MRN|Patient\s*(?:ID|Number|No\.?|#)|Chart\s*(?:Number|No\.?|#)|Hospital\s*(?:Number|No\.?|#)){_LABEL}([A-Z0-9][A-Z0-9 .-]{{4,24}}[A-Z0-9])",
         VERIFIED, "i", 1, norm="strip_upper", needs=("nhs", "medical", "mrn", "patient", "chart", "hospital")),
    Rule("health.condition.icd10", "health.condition", r"(?<![A-Z0-9.])[A-TV-Z]\d{2}(?:\.[A-Z0-9]{1,4})?(?![A-Z0-9.])", WEAK, norm="upper", guard="digit", require=True, support_weight=0.35,
         supports=("icd", "icd-10", "icd10", "diagnosis", "diagnosed", "diagnostic", "dx", "code", "coded", "condition", "billing", "patient", "clinical", "notes", "admitted", "treatment", "history")),
    Rule("health.nhs-number", "health.record-number", r"(?<![\d-])\d{3}[ -]?\d{3}[ -]?\d{4}(?![\d-])", WEAK, check="nhs", gain=0.35, norm="strip", locales=("en-GB",), guard="digit"),
    Rule("health.medicare.mbi", "health.insurance-id",
         r"(?<![A-Z0-9])[1-9][ACDEFGHJKMNPQRTUVWXY][AC-HJKMNP-RT-Y\d]\d[ACDEFGHJKMNPQRTUVWXY][AC-HJKMNP-RT-Y\d]\d[ACDEFGHJKMNPQRTUVWXY]{2}\d{2}(?![A-Z0-9])", STRONG, norm="upper", locales=("en-US",), guard="digit"),
    Rule("health.record-number.generic", "health.record-number", r"(?<![A-Z0-9-])[A-Z]{0,3}[-]?\d{5,12}(?![A-Z0-9-])", HINT, "i", norm="strip_upper", guard="digit", require=True, support_weight=0.35,
         supports=("mrn", "medical record", "patient id", "patient no", "chart no", "chart number", "hospital number", "nhs no", "encounter")),
    Rule("health.insurance-id.member", "health.insurance-id", r"(?<![A-Z0-9-])[A-Z]{2,4}\d{6,12}(?![A-Z0-9-])", HINT, norm="upper", guard="digit", require=True, support_weight=0.35,
         supports=("member id", "member no", "policy", "subscriber", "insurance", "plan id", "group number", "payer")),
    Rule("health.condition.sensitive", "health.condition",
         r"\b(?:HIV(?:[/-]AIDS)?|AIDS|hepatitis\s?[ABC]|tuberculosis|schizophreni[ac]|bipolar\s+disorder|major\s+depressive\s+disorder|substance\s+(?:use|abuse)\s+disorder|opioid\s+dependence|"
         r"alcohol\s+dependence|sickle\s+cell(?:\s+(?:disease|anaemia|anemia|trait))?|Huntington'?s?\s+disease|gender\s+dysphoria|termination\s+of\s+pregnancy|type\s?[12]\s+diabetes(?:\s+mellitus)?|"
         r"diabetes\s+mellitus|epilepsy|multiple\s+sclerosis|cystic\s+fibrosis|sexually\s+transmitted\s+(?:infection|disease))\b", LIKELY, "i", norm="lower_ws",
         suppresses=("policy", "guideline", "training", "awareness", "campaign", "research funding"), needs=("hiv", "aids", "hepatitis", "tuberculosis", "schizophreni", "bipolar", "depressive", "substance", "opioid", "alcohol", "sickle", "huntington", "gender", "termination", "diabetes", "epilepsy", "multiple", "cystic", "sexually")),
)
# The secrets pack has no published expressions; these are our own, for its published types.
SECRETS = (
    Rule("secret.aws-key", "secret.api-key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])", VERIFIED, check="not_sample", guard="upper"),
    Rule("secret.vendor-token", "secret.api-key",
         r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{30,}|sk_(?:test|live)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|xox[abprs]-[A-Za-z0-9-]{10,}|glpat-[A-Za-z0-9_-]{20,})(?![A-Za-z0-9_])", VERIFIED, check="not_sample", needs=("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk_", "aiza", "xox", "glpat-")),
    Rule("secret.jwt", "secret.jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", VERIFIED, guard="."),
    Rule("secret.private-key", "secret.private-key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}-----END [A-Z ]{0,20}PRIVATE KEY-----", VERIFIED, guard="-----BEGIN"),
    Rule("secret.labelled", "secret.api-key", rf"(?:api[_\s-]?key|access[_\s-]?token|auth[_\s-]?token|client[_\s-]?secret|secret|token)[\"']?{_H}{{0,4}}[:=]{_H}{{0,4}}[\"']?([A-Za-z0-9+/_.=-]{{16,}})",
         STRONG, "i", 1, check="entropy", gain=0.10, needs=("key", "token", "secret")),
    Rule("secret.password.labelled", "secret.password", rf"(?:password|passwd|passphrase|pwd)[\"']?{_H}{{0,4}}[:=]{_H}{{0,4}}[\"']?([^\s\"',;]{{4,}})", STRONG, "i", 1, check="not_sample", needs=("password", "passwd", "passphrase", "pwd")),
)
NETWORK = (
    Rule("net.ipv4.labelled", "net.ipv4", rf"(?:{_IP_LABEL}|host){_H}{{0,4}}[:#=]?{_H}{{0,4}}(\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}})(?!\.?\d)", STRONG, "i", 1, check="ipv4", gain=0.14, norm="same", guard="digit", needs=("ip", "originat", "source", "remote", "client", "host")),
    Rule("net.ipv6.labelled", "net.ipv6", rf"(?:{_IP_LABEL.replace('v4', 'v6')}){_H}{{0,4}}[:#=]?{_H}{{0,4}}((?:{HEX6}:){{2,7}}{HEX6})(?![:\w]|\.[0-9A-Fa-f])", STRONG, "", 1, norm="lower", guard=":"),
    Rule("net.ipv4", "net.ipv4", r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)", STRONG, check="ipv4_public", gain=0.14, norm="same", guard="digit"),
    Rule("net.ipv6", "net.ipv6", IPV6, STRONG, check="ipv6", gain=0.10, norm="lower", guard=":"),
    Rule("net.mac", "net.mac", r"(?<![\w:.-])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![\w:-])", STRONG, norm="mac", guard="pairs"),
    Rule("net.hostname.internal", "net.hostname", r"\b(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.){1,6}(?:internal|local|localdomain|corp|lan|intranet|home\.arpa)\b", STRONG, "i", norm="lower", guard="host"),
    Rule("net.cloud-resource", "net.url",
         r"\b(?:s3://[a-z0-9.-]{3,63}(?:/[^\s\"'<>]{0,512})?|gs://[a-z0-9._-]{3,222}(?:/[^\s\"'<>]{0,512})?|[a-z0-9-]{3,63}\.s3(?:[.-][a-z0-9-]{1,20})?\.amazonaws\.com|[a-z0-9-]{3,63}\.blob\.core\.windows\.net)\b",
         STRONG, "i", norm="lower", guard="cloud"),
)
GEO = (
    Rule("geo.coordinates.decimal", "geo.coordinates", r"(?<![\d.])(-?\d{1,2}\.\d{4,10})\s*[,;]\s*(-?\d{1,3}\.\d{4,10})(?![\d.])", LIKELY, check="coordinates", norm="no_ws", guard="digit"),
    Rule("geo.coordinates.dms", "geo.coordinates",
         r"(?<![\d.])\d{1,3}[°º]\s?\d{1,2}['′]\s?\d{1,2}(?:\.\d{1,4})?[\"″]?\s?[NS][,;\s]+\d{1,3}[°º]\s?\d{1,2}['′]\s?\d{1,2}(?:\.\d{1,4})?[\"″]?\s?[EW](?![\d.])", STRONG, "i", norm="no_ws", guard="digit"),
    Rule("geo.postcode.uk", "geo.postcode", r"(?<![A-Z0-9])[A-Z]{1,2}\d[A-Z\d]?\s?\d[ABD-HJLNP-UW-Z]{2}(?![A-Z0-9])", STRONG, "i", norm="upper_no_ws", locales=("en-GB",), guard="digit"),
    Rule("geo.postcode.us.zip4", "geo.postcode", r"(?<![\d-])\d{5}-\d{4}(?![\d-])", STRONG, norm="same", locales=("en-US",), guard="digit"),
    Rule("geo.postcode.us.zip5", "geo.postcode", r"(?<![\d-])\d{5}(?![\d-])", HINT, norm="same", locales=("en-US",), guard="digit", require=True, support_weight=0.30,
         supports=("zip", "postal", "address", "city", "state", "mailing"), suppresses=("year", "amount", "total", "quantity", "invoice", "page")),
    Rule("geo.postcode.ca", "geo.postcode", r"(?<![A-Z0-9])[ABCEGHJ-NPRSTVXY]\d[ABCEGHJ-NPRSTV-Z]\s?\d[ABCEGHJ-NPRSTV-Z]\d(?![A-Z0-9])", STRONG, "i", norm="upper_no_ws", locales=("en-CA", "fr-CA"), guard="digit"),
)
TEMPORAL = (
    Rule("temporal.date.embedded", "temporal.date", r"\b[A-Za-z][A-Za-z0-9]*[_-](?:20|19)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[_-][A-Za-z0-9_-]{1,64}\b", STRONG, norm="upper", guard="digit"),
    Rule("temporal.date", "temporal.date",
         rf"(?<![\d/-])(?:\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}(?::\d{{2}})?(?:\.\d+)?(?:Z|[+-]\d{{2}}:?\d{{2}})?|{MONTH}\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}|\d{{1,2}}(?:st|nd|rd|th)?\s+{MONTH},?\s+\d{{4}}|"
         rf"\d{{1,2}}[-/]{MONTH}[-/]\d{{2,4}}|\d{{4}}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01]))(?![\d/-])", LIKELY, "i", norm="date", guard="digit"),
    Rule("temporal.date.numeric", "temporal.date", r"(?<![\d/.-])\d{1,2}[/.-]\d{1,2}[/.-]\d{4}(?![\d/.-])", LIKELY, norm="slashes", guard="digit"),
    Rule("temporal.time", "temporal.date", r"(?<![\d:])(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d)?(?:\s?(?:AM|PM|am|pm))?(?:\s?(?:UTC|GMT|Z|[+-]\d{2}:?\d{2}))?(?![\d:])", WEAK, norm="lower_no_ws", guard="digit",
         require=True, supports=("at", "time", "timestamp", "occurred", "logged", "failed", "started", "incident")),
    Rule("financial.amount", "financial.amount", r"(?:[$£€¥₹]\s?\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?|\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?\s?(?:USD|EUR|GBP|CHF|JPY|CAD|AUD|INR))(?![\d])", STRONG, norm="no_ws", guard="digit"),
    Rule("geo.locality.us", "geo.locality", rf"\b([A-Z][a-z]+(?:[ -][A-Z][a-z]+){{0,2}}),\s*(?:{STATES})\b\.?(?=\s|\Z|,)", LIKELY, norm="locality", locales=("en-US",), guard="state"),
    Rule("geo.locality.before-postcode", "geo.locality",
         r",\s*([A-Z][a-z]+(?:[ -][A-Z][a-z]+){0,2})\s*,\s*(?=[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}\b|\d{4,5}\b|[A-Z][a-z]+\s+(?:Kingdom|States)\b)", LIKELY, "", 1, norm="lower_trim", guard="comma_place"),
    Rule("geo.locality.labelled", "geo.locality", rf"(?:City|Town|Locality|Municipality|Place\s+of\s+(?:birth|residence)){_LABEL}([A-Z][A-Za-z' -]{{2,40}})", STRONG, "", 1, norm="lower_trim", needs=("city", "town", "locality", "municipality", "place")),
)
OBFUSCATED = (
    Rule("obfuscated.card.spoken", "financial.card", SPOKEN, LIKELY, "iu", check="spoken_card", norm="spoken", supports=("card", "visa", "mastercard", "amex", "pan", "account", "number", "digits"), guard="spoken"),
    Rule("obfuscated.ssn.spoken", "gov.ssn", SPOKEN, WEAK, "iu", check="spoken_9", gain=0.30, norm="spoken", require=True, support_weight=0.35,
         supports=("ssn", "social security", "social security number", "sin", "national insurance", "tax"), guard="spoken"),
    Rule("obfuscated.cvv.spoken", "financial.card", SPOKEN, WEAK, "iu", check="spoken_3_4", gain=0.30, norm="spoken", require=True, support_weight=0.35,
         supports=("cvv", "cvc", "cid", "security code", "verification", "three digits", "back of the card"), guard="spoken"),
    Rule("obfuscated.base64-credential", "secret.password", r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{24,512}={0,2}(?![A-Za-z0-9+/=])", WEAK, check="base64_credential", gain=0.45, norm="same", guard="run24"),
    Rule("obfuscated.bare-credentials", "secret.password", r"(?<![\w@:/])[A-Za-z][\w.-]{1,32}:[^\s/]{4,64}@(?:\d{1,3}(?:\.\d{1,3}){3}|[A-Za-z0-9][\w.-]{1,60})(?::\d{2,5})?(?![\w.])", STRONG, norm="same", guard="@"),
)
MARKINGS = (
    Rule("marking.banner.us", "marking.banner", r"(?<![A-Z/])(?:TOP SECRET|SECRET|CONFIDENTIAL|UNCLASSIFIED|CUI|CONTROLLED)(?://[A-Z0-9][A-Z0-9 ,._-]{0,60})*(?![A-Z/])", STRONG, check="us_banner", gain=0.14, norm="upper_ws", needs=("secret", "confidential", "unclassified", "cui", "controlled")),
    Rule("marking.portion.us", "marking.portion", r"(?<=^|[\n.!?]\s{0,4})\((?:TS|S|C|U|CUI|R)(?://[A-Z0-9][A-Z0-9 ,._-]{0,40})*\)", LIKELY, "m", norm="upper_ws", guard="("),
    Rule("marking.banner.nato", "marking.banner",
         r"(?<![A-Z-])(?:COSMIC TOP SECRET|NATO SECRET|NATO CONFIDENTIAL|NATO RESTRICTED|NATO UNCLASSIFIED|CTS|NS|NC|NR|NU)(?:\s?ATOMAL)?(?![A-Z-])", LIKELY, check="longer_than_3", gain=0.20, norm="upper_ws", needs=("cosmic", "nato", "atomal")),
    Rule("marking.banner.uk", "marking.banner", r"(?<![A-Z-])OFFICIAL(?:\s?-\s?SENSITIVE)?(?:\s?\[[A-Z ]{2,30}\])?|(?<![A-Z-])(?:SECRET|TOP SECRET)(?:\s?-\s?[A-Z]{2,20})?(?![A-Z-])", LIKELY, norm="uk_banner", locales=("en-GB",), needs=("official", "secret")),
    Rule("marking.declassification", "marking.banner", r"\b(?:Declassify On|Classified By|Derived From|Reason|Downgrade To|Declassification Date)\s*:\s*[^\n]{1,120}", STRONG, "i", norm="ws", guard=":", needs=("declassify", "classified", "derived", "reason", "downgrade", "declassification")),
    Rule("marking.handling-caveat", "marking.banner",
         r"\b(?:ATTORNEY[- ](?:CLIENT PRIVILEGE|WORK PRODUCT)|PRIVILEGED AND CONFIDENTIAL|COMMERCIAL[- ]IN[- ]CONFIDENCE|PROPRIETARY AND CONFIDENTIAL|INTERNAL USE ONLY|"
         r"NOT FOR (?:PUBLIC )?(?:DISTRIBUTION|RELEASE)|EMBARGOED(?: UNTIL [^\n]{1,40})?|DRAFT[- ]{1,3}(?:DO NOT (?:CITE|QUOTE|DISTRIBUTE)))\b", STRONG, "i", norm="upper_ws", needs=("attorney", "privileged", "commercial", "proprietary", "internal", "not for", "embargoed", "draft")),
)

PACKS: dict[str, tuple[Rule, ...]] = {
    "contact": CONTACT, "people": PEOPLE, "identity": IDENTITY, "financial": FINANCIAL, "health": HEALTH, "secrets": SECRETS, "network": NETWORK, "geo": GEO,
    "temporal": TEMPORAL, "obfuscated": OBFUSCATED, "markings": MARKINGS,
}
ALL = tuple(PACKS)
PERSONAL = ("contact", "people", "identity", "financial", "health", "geo", "temporal", "obfuscated", "markings")
OPERATIONAL = ("secrets", "network", "contact")
STANDARD = (*PERSONAL, "secrets", "network")


def select(packs=STANDARD, locales=(), include=None, exclude=()) -> list[Rule]:
    """The rules to run: by pack, id and locale (a prefix, whatever its case)."""
    out, seen = [], set()
    for name in packs:
        for rule in PACKS[name] if isinstance(name, str) else name:
            if include is not None and rule.id not in include or rule.id in exclude:
                continue
            if rule.locales and locales and not any(a.lower().startswith(r.lower()) for r in rule.locales for a in locales):
                continue
            if rule.id in seen:
                raise ValueError(f"duplicate rule id {rule.id}")
            seen.add(rule.id)
            out.append(rule)
    return out
