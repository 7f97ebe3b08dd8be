"""Classification policies, as data."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Level:
    id: str
    name: str
    short: str
    rank: int


@dataclass(frozen=True)
class Value:
    id: str
    name: str
    short: str
    dominates: tuple[str, ...] = ()
    expands: tuple[str, ...] = ()
    minimum: str | None = None


@dataclass(frozen=True)
class Group:
    id: str
    values: tuple[Value, ...]
    union: bool = True
    prefix: str = ""
    suffix: str = ""
    separator: str = "/"
    defaults: tuple[str, ...] = ()


@dataclass(frozen=True)
class PolicyRule:
    id: str
    types: tuple[str, ...]
    level: str
    markings: dict[str, tuple[str, ...]] = field(default_factory=dict)
    least: float = 0.0
    roles: tuple[str, ...] = ()
    occurrences: int = 1
    authority: str = ""


@dataclass(frozen=True)
class Mosaic:
    id: str
    types: tuple[str, ...]
    threshold: int
    scope: str
    level: str
    markings: dict[str, tuple[str, ...]]
    authority: str = ""


@dataclass(frozen=True)
class Policy:
    id: str
    levels: tuple[Level, ...]
    groups: tuple[Group, ...]
    rules: tuple[PolicyRule, ...]
    mosaic: tuple[Mosaic, ...]
    default: str
    separator: str = " // "
    delimiters: tuple[str, str] = ("(", ")")
    version: str = "1.0.0"
    uppercase: bool = True

    def __post_init__(self):
        levels = [x.id for x in self.levels]
        values = [v.id for g in self.groups for v in g.values]
        for what, ids in (("level", levels), ("group", [g.id for g in self.groups]), ("value", values)):
            if len(set(ids)) != len(ids):
                raise ValueError(f"policy {self.id}: duplicate {what}")
        if self.default not in levels or any(v.minimum and v.minimum not in levels for g in self.groups for v in g.values):
            raise ValueError(f"policy {self.id}: unknown level")

    def level(self, key: str) -> Level:
        return next(x for x in self.levels if x.id == key)

    @property
    def bottom(self) -> Level:
        return min(self.levels, key=lambda x: x.rank)

    def value(self, key: str) -> Value:
        return next(v for g in self.groups for v in g.values if v.id == key)



# --- Fixed values: the five policies. ---

PRIVACY = Policy(
    "privacy",
    (Level("open", "OPEN", "O", 0), Level("personal", "PERSONAL DATA", "PD", 20), Level("special-category", "SPECIAL CATEGORY", "SC", 30), Level("restricted", "RESTRICTED", "R", 40)),
    (
        Group("basis", (Value("gdpr-art4", "GDPR-ART4", "A4"), Value("gdpr-art9", "GDPR-ART9", "A9"), Value("gdpr-art10", "GDPR-ART10", "A10"), Value("hipaa-phi", "HIPAA-PHI", "PHI"), Value("pci-chd", "PCI-CHD", "CHD"), Value("ferpa", "FERPA", "FERPA"))),
        Group("handling", (
            Value("no-publish", "DO NOT PUBLISH", "NP", ("aggregate-only", "pseudonymized")),
            Value("aggregate-only", "AGGREGATE ONLY", "AGG"), Value("pseudonymized", "PSEUDONYMIZED", "PSEUDO"), Value("consent-required", "CONSENT REQUIRED", "CONSENT"),
        )),
    ),
    (
        PolicyRule("privacy.direct-identifier", ("person.name", "contact.*"), "personal", {"basis": ("gdpr-art4",), "handling": ("pseudonymized",)}, 0.6),
        PolicyRule("privacy.government-identifier", ("gov.*",), "personal", {"basis": ("gdpr-art4",), "handling": ("no-publish",)}, 0.6),
        PolicyRule("privacy.health", ("health.*",), "special-category", {"basis": ("gdpr-art9", "hipaa-phi"), "handling": ("no-publish",)}, 0.6),
        PolicyRule("privacy.cardholder-data", ("financial.card",), "personal", {"basis": ("pci-chd",), "handling": ("no-publish",)}, 0.7),
        PolicyRule("privacy.financial", ("financial.*",), "personal", {"basis": ("gdpr-art4",), "handling": ("no-publish",)}, 0.7),
        PolicyRule("privacy.credentials", ("secret.*",), "restricted", {"handling": ("no-publish",)}, 0.7),
        PolicyRule("privacy.precise-location", ("geo.coordinates", "geo.postcode"), "personal", {"basis": ("gdpr-art4",), "handling": ("aggregate-only",)}, 0.6),
        PolicyRule("privacy.locality", ("geo.locality",), "personal", {"basis": ("gdpr-art4", "hipaa-phi"), "handling": ("aggregate-only",)}, 0.6),
        PolicyRule("privacy.dates", ("temporal.date",), "personal", {"basis": ("hipaa-phi",), "handling": ("aggregate-only",)}, 0.6),
        PolicyRule("privacy.amounts", ("financial.amount",), "personal", {"basis": ("gdpr-art4",), "handling": ("aggregate-only",)}, 0.7),
        PolicyRule("privacy.metadata", ("risk.metadata",), "personal", {"basis": ("gdpr-art4",), "handling": ("no-publish",)}, 0.8),
        PolicyRule("privacy.operator-marked", ("manual.marked",), "personal", {"handling": ("no-publish",)}),
    ),
    (
        Mosaic("mosaic.safe-harbor", ("person.dob", "geo.postcode", "geo.locality", "temporal.date", "person.age", "contact.address", "health.record-number"), 2, "portion", "special-category",
               {"basis": ("hipaa-phi",), "handling": ("aggregate-only",)}),
        Mosaic("mosaic.singling-out", ("person.name", "person.dob", "geo.postcode", "contact.*", "org.employee-id", "health.*"), 3, "document", "personal", {"handling": ("pseudonymized",)}),
    ),
    "open", " // ", ("[", "]"),
)
CORPORATE = Policy(
    "corporate",
    (Level("public", "PUBLIC", "P", 0), Level("internal", "INTERNAL", "I", 10), Level("confidential", "CONFIDENTIAL", "C", 20), Level("restricted", "RESTRICTED", "R", 30)),
    (
        Group("caveat", (
            Value("privileged", "ATTORNEY-CLIENT PRIVILEGED", "PRIV"), Value("personal-data", "PERSONAL DATA", "PD"), Value("trade-secret", "TRADE SECRET", "TS"), Value("material-nonpublic", "MATERIAL NON-PUBLIC", "MNPI"),
            Value("no-external", "NO EXTERNAL DISTRIBUTION", "NOEXT", ("partners", "customers")),
        )),
        Group("audience", (Value("internal-staff", "STAFF", "STAFF"), Value("partners", "PARTNERS", "PTNR"), Value("customers", "CUSTOMERS", "CUST")), False, "SHARE ", separator=", ", defaults=("internal-staff",)),
    ),
    (
        PolicyRule("corp.personal-data", ("person.*", "contact.*", "gov.*"), "confidential", {"caveat": ("personal-data",)}, 0.6),
        PolicyRule("corp.financial", ("financial.*",), "confidential", {"caveat": ("personal-data", "no-external")}, 0.7),
        PolicyRule("corp.credentials", ("secret.*",), "restricted", {"caveat": ("no-external",)}, 0.7),
        PolicyRule("corp.infrastructure", ("net.hostname", "net.ipv4", "net.ipv6", "net.mac"), "internal", {"caveat": ("no-external",)}, 0.7),
        PolicyRule("corp.privilege", ("marking.banner",), "confidential", {}, 0.8),
        PolicyRule("corporate.operator-marked", ("manual.marked",), "confidential", {"caveat": ("no-external",)}),
    ),
    (Mosaic("mosaic.employee-record", ("person.name", "org.employee-id", "contact.*", "person.dob"), 3, "portion", "confidential", {"caveat": ("personal-data", "no-external")}),),
    "internal",
)
US_CAPCO = Policy(
    "us-capco",
    (Level("unclassified", "UNCLASSIFIED", "U", 0), Level("cui", "CUI", "CUI", 10), Level("confidential", "CONFIDENTIAL", "C", 20), Level("secret", "SECRET", "S", 30), Level("top-secret", "TOP SECRET", "TS", 40)),
    (
        Group("sci", (Value("si", "SI", "SI"), Value("tk", "TK", "TK"), Value("hcs", "HCS", "HCS"), Value("kdk", "KDK", "KDK"))),
        Group("cui-category", (Value("sp-prvcy", "SP-PRVCY", "PRVCY"), Value("sp-hlth", "SP-HLTH", "HLTH"), Value("sp-propin", "SP-PROPIN", "PROPIN"), Value("sp-lei", "SP-LEI", "LEI"), Value("sp-tax", "SP-TAX", "TAX"), Value("sp-opsec", "SP-OPSEC", "OPSEC"))),
        Group("dissemination", (
            Value("noforn", "NOFORN", "NF", ("usa", "fvey", "nato", "aus", "can", "gbr", "nzl")),
            Value("orcon", "ORCON", "OC"), Value("propin", "PROPIN", "PR"), Value("relido", "RELIDO", "RELIDO"), Value("imcon", "IMCON", "IMC"), Value("fisa", "FISA", "FISA"), Value("fedcon", "FED ONLY", "FEDCON"), Value("nocontract", "NOCONTRACT", "NC"),
        )),
        Group("releasable", (
            Value("usa", "USA", "USA"), Value("fvey", "FVEY", "FVEY", expands=("usa", "aus", "can", "gbr", "nzl")),
            Value("nato", "NATO", "NATO"), Value("aus", "AUS", "AUS"), Value("can", "CAN", "CAN"), Value("gbr", "GBR", "GBR"), Value("nzl", "NZL", "NZL"),
        ), False, "REL TO ", separator=", ", defaults=("usa",)),
    ),
    (
        PolicyRule("cui.privacy", ("person.*", "contact.*", "gov.ssn", "gov.tax-id", "gov.passport", "gov.driver-license", "gov.national-id", "gov.mrz"), "cui", {"cui-category": ("sp-prvcy",)}, 0.6),
        PolicyRule("cui.health", ("health.*",), "cui", {"cui-category": ("sp-hlth",)}, 0.6),
        PolicyRule("cui.tax", ("gov.tax-id",), "cui", {"cui-category": ("sp-tax",)}, 0.6),
        PolicyRule("cui.financial", ("financial.*",), "cui", {"cui-category": ("sp-prvcy",)}, 0.7),
        PolicyRule("cui.opsec", ("secret.*", "net.hostname", "net.ipv4", "net.ipv6"), "cui", {"cui-category": ("sp-opsec",)}, 0.7),
        PolicyRule("dissem.propin", ("org.*",), "cui", {"cui-category": ("sp-propin",), "dissemination": ("propin",)}, 0.7),
        PolicyRule("us-capco.operator-marked", ("manual.marked",), "cui", {"cui-category": ("sp-prvcy",)}),
    ),
    (
        Mosaic("mosaic.hipaa-quasi-identifiers", ("person.dob", "geo.postcode", "person.age", "contact.address"), 2, "portion", "cui", {"cui-category": ("sp-prvcy",)}),
        Mosaic("mosaic.identity-dossier", ("person.name", "gov.*", "contact.email", "contact.phone", "contact.address"), 3, "document", "cui", {"cui-category": ("sp-prvcy",)}),
    ),
    "unclassified", "//",
)
UK_GSCP = Policy(
    "uk-gscp",
    (Level("official", "OFFICIAL", "O", 10), Level("official-sensitive", "OFFICIAL-SENSITIVE", "OS", 15), Level("secret", "SECRET", "S", 30), Level("top-secret", "TOP SECRET", "TS", 40)),
    (
        Group("descriptor", (Value("commercial", "COMMERCIAL", "COMM"), Value("personal", "PERSONAL", "PERS"), Value("legal", "LEGAL", "LEGAL"), Value("locsen", "LOCSEN", "LOCSEN"), Value("health", "MEDICAL", "MED")), prefix="[", suffix="]", separator=", "),
        Group("caveat", (Value("uk-eyes-only", "UK EYES ONLY", "UKEO", ("gbr", "fvey", "nato"), minimum="secret"), Value("handling-instruction", "HANDLING INSTRUCTIONS APPLY", "HI"))),
        Group("releasable", (Value("gbr", "GBR", "GBR"), Value("fvey", "FVEY", "FVEY"), Value("nato", "NATO", "NATO")), False, "REL ", separator=", ", defaults=("gbr",)),
    ),
    (
        PolicyRule("gscp.personal-data", ("person.*", "contact.*", "gov.national-id", "gov.passport", "gov.driver-license"), "official-sensitive", {"descriptor": ("personal",)}, 0.6),
        PolicyRule("gscp.special-category", ("health.*",), "official-sensitive", {"descriptor": ("personal", "health")}, 0.6),
        PolicyRule("gscp.commercial", ("financial.*",), "official-sensitive", {"descriptor": ("commercial",)}, 0.7),
        PolicyRule("gscp.credentials", ("secret.*",), "official-sensitive", {}, 0.7),
        PolicyRule("uk-gscp.operator-marked", ("manual.marked",), "official-sensitive", {"descriptor": ("personal",)}),
    ),
    (Mosaic("mosaic.uk-quasi-identifiers", ("geo.postcode", "person.dob", "contact.address", "person.name"), 2, "portion", "official-sensitive", {"descriptor": ("personal",)}),),
    "official", " ",
)
NATO = Policy(
    "nato",
    (Level("nato-unclassified", "NATO UNCLASSIFIED", "NU", 0), Level("nato-restricted", "NATO RESTRICTED", "NR", 10), Level("nato-confidential", "NATO CONFIDENTIAL", "NC", 20),
     Level("nato-secret", "NATO SECRET", "NS", 30), Level("cosmic-top-secret", "COSMIC TOP SECRET", "CTS", 40)),
    (
        Group("compartment", (Value("atomal", "ATOMAL", "A", minimum="nato-confidential"), Value("bohemia", "BOHEMIA", "BOH", minimum="nato-secret"))),
        Group("dissemination", (Value("nato-eyes-only", "NATO EYES ONLY", "NEO", ("pfp", "ico")), Value("releasable-internet", "RELEASABLE TO THE INTERNET", "RELINT"))),
        Group("releasable", (Value("nato-nations", "NATO", "NATO"), Value("pfp", "PFP", "PFP"), Value("ico", "ISAF COALITION", "ICO")), False, "REL ", separator=", ", defaults=("nato-nations",)),
    ),
    (
        PolicyRule("nato.personal-data", ("person.*", "contact.*", "gov.*"), "nato-restricted", {}, 0.6),
        PolicyRule("nato.credentials", ("secret.*",), "nato-confidential", {"dissemination": ("nato-eyes-only",)}, 0.7),
        PolicyRule("nato.locations", ("geo.coordinates",), "nato-restricted", {}, 0.7),
        PolicyRule("nato.operator-marked", ("manual.marked",), "nato-restricted"),
    ),
    (),
    "nato-unclassified", "//",
)

POLICIES = {p.id: p for p in (PRIVACY, CORPORATE, US_CAPCO, UK_GSCP, NATO)}
