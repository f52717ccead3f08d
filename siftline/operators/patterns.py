"""Detection patterns and the tables that classify what they find."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Pattern:
    """``hint`` matches every text that the pattern matches in, at a lower cost."""

    type: str
    severity: str
    confidence: float
    regex: str
    hint: str
    group: int = 0
    label: str | None = None
    luhn: bool = False


# Patterns, severities, confidences, type names and weights.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?<!\w)(?:\+?\d{1,3}[\s.-]?)?(?:\(?\d{2,4}\)?[\s.-]?)?\d{3,4}[\s.-]?\d{4}(?!\w)"
CARD = r"\b(?:\d[ -]*?){13,19}\b"
SECRET = r"(?i)\b(?:api[_-]?key|secret|access[_-]?token|auth[_-]?token|bearer)\b\s*[:=]\s*['\"]?([A-Za-z0-9._~+/=-]{16,})"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"

PATTERNS = (
    Pattern("Email", "medium", 0.92, EMAIL, "@"),
    Pattern("Phone Number", "medium", 0.78, PHONE, r"\d{4}"),
    Pattern("Credit Card", "high", 0.97, CARD, r"(?:\d[ -]*?){13}", luhn=True),
    Pattern("Password", "high", 0.95, r"(?i)\b(?:password|passwd|pwd)\b\s*[:=]\s*['\"]?([^\s'\";,\]]{6,})", r"(?i)(?:passw|pwd)", group=1),
    Pattern("API Key", "high", 0.98, r"\bAKIA[0-9A-Z]{16}\b", "AKIA"),
    Pattern("API Key", "high", 0.97, r"\bAIza[0-9A-Za-z_-]{35}\b", "AIza"),
    Pattern("API Key", "high", 0.96, r"\beyJ[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{10,}\b", "eyJ"),
    Pattern("API Key", "high", 0.92, SECRET, r"(?i)(?:api|secret|token|bearer)", group=1),
    Pattern("ID Number", "high", 0.96, SSN, r"\d-\d", label="SSN-like ID"),
    Pattern("ID Number", "medium", 0.72, r"(?i)\b(?:employee|student|customer|account|user|member|passport|license|id)\s*(?:id|no|number|#)?\s*[:=]\s*['\"]?([A-Z0-9][A-Z0-9-]{4,24})", "[:=]", group=1),
)

RECOGNIZERS = (
    Pattern("Email", "medium", 0.85, EMAIL, "@", label="EMAIL_ADDRESS"),
    Pattern("Phone Number", "medium", 0.80, PHONE, r"\d{4}", label="PHONE_NUMBER"),
    Pattern("Credit Card", "high", 0.95, CARD, r"(?:\d[ -]*?){13}", label="CREDIT_CARD"),
    Pattern("ID Number", "high", 0.98, SSN, r"\d-\d", label="US_SSN"),
    Pattern("Bank Account", "high", 0.92, r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", r"[A-Z]\d{2}", label="IBAN_CODE"),
    Pattern("IP Address", "medium", 0.90, r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b", r"\d\.\d", label="IP_ADDRESS"),
    Pattern("API Key", "high", 0.97, SECRET, r"(?i)(?:api|secret|token|bearer)", label="API_TOKEN"),
)
#: Fixed values. A recognizer's context words near a match raise its score; scores stay as listed unless a boost is asked for.
RECOGNIZER_CONTEXT = {"EMAIL_ADDRESS": ("email", "mail", "correo", "courriel"), "PHONE_NUMBER": ("phone", "mobile", "tel", "telefono", "téléphone"), "CREDIT_CARD": ("card", "credit", "tarjeta"), "US_SSN": ("ssn", "social security"), "IBAN_CODE": ("iban", "bank", "account", "cuenta", "compte"), "IP_ADDRESS": ("ip", "address", "network", "adresse"), "API_TOKEN": ("token", "api", "secret")}

# Types and severities of recognizers' and models' labels.
ENTITY_TYPES = {"EMAIL_ADDRESS": "Email", "PHONE_NUMBER": "Phone Number", "CREDIT_CARD": "Credit Card", "US_SSN": "ID Number", "US_PASSPORT": "ID Number", "US_DRIVER_LICENSE": "ID Number", "IBAN_CODE": "Bank Account", "IP_ADDRESS": "IP Address", "API_TOKEN": "API Key", "PERSON": "Person Name", "LOCATION": "Location", "ORGANIZATION": "Organization", "NRP": "ID Number", "DATE_TIME": "Date of Birth", "MEDICAL_LICENSE": "ID Number", "CRYPTO": "API Key", "URL": "URL"}
ENTITY_HIGH = ("CREDIT_CARD", "US_SSN", "US_PASSPORT", "US_DRIVER_LICENSE", "IBAN_CODE", "API_TOKEN", "MEDICAL_LICENSE", "CRYPTO")
ENTITY_MEDIUM = ("EMAIL_ADDRESS", "PHONE_NUMBER", "IP_ADDRESS", "DATE_TIME", "NRP")
ENTITY_STRICT = ("ORGANIZATION", "PERSON", "LOCATION", "URL", "NRP")

LABEL_TYPES = {"person": "Person Name", "organization": "Organization", "location": "Location", "address": "Location", "email address": "Email", "phone number": "Phone Number", "passport number": "ID Number", "credit card": "Credit Card", "bank account": "Bank Account", "date of birth": "Date of Birth", "id number": "ID Number", "social security number": "ID Number", "tax id number": "ID Number", "medical record number": "ID Number", "driver license number": "ID Number", "ip address": "IP Address", "api key": "API Key", "password": "Password"}
LABEL_HIGH = ("Credit Card", "Bank Account", "ID Number", "API Key", "Password")
LABEL_MEDIUM = ("Email", "Phone Number", "Date of Birth", "IP Address")
LABEL_DIGITS = {"Phone Number": 4, "Credit Card": 8, "ID Number": 3, "Date of Birth": 1, "IP Address": 4}
VALIDATOR_LABELS = {"PERSON": "PER", "ORG": "ORG", "GPE": "LOC", "LOC": "LOC", "FAC": "LOC", "Person Name": "PER", "Organization": "ORG", "Location": "LOC", "Group": "MISC"}

# Risk levels, weights and frameworks by type.
RISK_HIGH = ("Credit Card", "SSN", "Password", "API Key", "API_TOKEN", "US_SSN", "IBAN_CODE", "ID Number", "Bank Account", "Date of Birth", "passport number", "bank account", "date of birth")
RISK_MEDIUM = ("Email", "Phone Number", "IP Address")
RISK_LOW = ("Person Name", "Organization", "Location", "Address")
WEIGHTS = {"Credit Card": 1.5, "SSN": 1.5, "US_SSN": 1.5, "ID Number": 1.4, "Password": 1.4, "API Key": 1.4, "API_TOKEN": 1.4, "IBAN_CODE": 1.4, "Email": 1.0, "Phone Number": 1.0, "Person Name": 0.8, "Organization": 0.8, "Location": 0.8, "Address": 0.9, "bank account": 1.3, "passport number": 1.4, "date of birth": 1.1}
NAMED_HIGH = ("Credit Card", "SSN", "Password", "API Key", "API_TOKEN", "US_SSN", "IBAN_CODE", "passport number", "bank account")
FULL_REDACTION = ("Credit Card", "SSN", "US_SSN", "Password", "API Key", "API_TOKEN", "IBAN_CODE", "passport number", "bank account", "ID Number")
FRAMEWORKS = {
    "GDPR": (("Email", "Phone Number", "Person Name", "Address", "Location", "ID Number", "Date of Birth", "Credit Card", "Bank Account"), "personal data processing"),
    "HIPAA": (("Person Name", "Date of Birth", "ID Number", "Email", "Phone Number", "Medical Record", "Address"), "protected health information indicators"),
    "DPA": (("Person Name", "Email", "Phone Number", "ID Number", "Address"), "personal data under DPA"),
}
ENGINE_CONFIDENCE = {"regex": 0.74, "presidio": 0.82, "gliner": 0.68, "transformer": 0.75}
