"""Patterns written so that Java's and RE2's dialects read them alike."""

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
EMAIL_WHOLE = f"^{EMAIL}$"
PHONE = r"\+?[0-9]{0,2}[-. ]?\(?[2-9][0-9]{2}\)?[-. ][0-9]{3}[-. ][0-9]{4}"
PHONE_WHOLE = r"^(\+?1[-. ]?)?\(?[2-9][0-9]{2}\)?[-. ]?[0-9]{3}[-. ]?[0-9]{4}$"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
SSN_WHOLE = f"^{SSN}$"
DOB = r"^(19|20)[0-9]{2}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$"
CARD = r"[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}"
IP = r"(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}"
IP_WHOLE = f"^{IP}$"
URL = r"https?://[^ \"<>]+"

# kind: (pattern for the column name, pattern for the values)
SENSITIVE = {
    "email": (r"(?i)e?mail", EMAIL),
    "phone": (r"(?i)phone|mobile|fax", PHONE),
    "ssn": (r"(?i)ssn|social", SSN),
    "birth_date": (r"(?i)^dob$|birth", DOB),
    "card_number": (r"(?i)card_?(no|num)|^pan$", CARD),
    "ip_address": (r"(?i)^ip(_|$)|ip_?addr", IP),
}

FREE_TEXT = {"email": EMAIL, "ip_address": IP, "phone": PHONE, "card_number": CARD}

# A text every match contains ("" stands for a digit): a cheap test before the pattern itself.
NEEDLE = {"email": "@", "phone": "", "ssn": "", "birth_date": "", "card_number": "", "ip_address": ""}
