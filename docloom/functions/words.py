"""Keyword lists and patterns of the banking domain that results must agree on."""

from __future__ import annotations

CATEGORY_KEYWORDS = {
    "retail": ("savings account", "current account", "fixed deposit", "fd", "rd", "recurring deposit", "home loan", "personal loan", "car loan", "auto loan", "credit card", "debit card", "overdraft", "atm", "retail banking", "consumer loan", "education loan", "gold loan", "kisan credit", "agriculture loan", "pm jan dhan"),
    "corporate": ("corporate", "msme", "sme", "small medium enterprise", "trade finance", "letter of credit", "lc", "bank guarantee", "bg", "working capital", "cash credit", "term loan", "business loan", "project finance", "vendor", "buyer", "supply chain"),
    "nri": ("nri", "non-resident indian", "nre", "nro", "fcnr", "overseas", "remittance", "repatriation", "foreign national", "diaspora", "nre account", "nro account"),
    "grievance": ("grievance", "complaint", "redressal", "escalation", "ombudsman", "banking ombudsman", "rbi ombudsman", "dispute", "dissatisfied", "lodge complaint", "appeal", "resolution"),
    "policy": ("policy", "circular", "guidelines", "regulation", "compliance", "directive", "rbi guideline", "master circular", "notification", "amendment"),
    "interest_rates": ("interest rate", "rate of interest", "roi", "mclr", "repo rate", "base rate", "emi", "apr", "annual rate", "rate card", "interest schedule"),
    "digital": ("net banking", "internet banking", "mobile banking", "upi", "imps", "neft", "rtgs", "digital payment", "e-banking", "app", "whatsapp banking", "missed call"),
    "forex": ("forex", "foreign exchange", "currency", "dollar", "euro", "gbp", "swift", "wire transfer", "international transfer", "exchange rate", "libor", "fema"),
    "insurance": ("insurance", "life insurance", "health insurance", "bancassurance", "premium", "policy term", "sum assured", "claim"),
    "investments": ("mutual fund", "ppf", "nssc", "sovereign gold bond", "sgb", "investment", "wealth management", "portfolio", "demat"),
}

TOPIC_KEYWORDS = {
    "home_loans": ("home loan", "housing loan", "mortgage", "hl"),
    "personal_loans": ("personal loan", "unsecured loan", "pl"),
    "savings_accounts": ("savings account", "saving account", "sb account", "minimum balance"),
    "fixed_deposits": ("fixed deposit", "fd", "term deposit", "recurring deposit", "rd"),
    "credit_cards": ("credit card", "cc", "billing cycle", "card reward"),
    "grievance_redressal": ("grievance", "complaint", "ombudsman", "dispute", "redressal", "escalate"),
    "digital_banking": ("upi", "net banking", "mobile app", "netbanking", "digital transaction"),
}
DEFAULT_TOPIC = "general_banking"

ENTITY_PATTERNS = {
    "account_number": r"\b\d{15,16}\b",
    "loan_id": r"(?i)\bLN-\d{6,10}\b",
    "ticket_id": r"(?i)\b(?:TKT|SR)-\d{6,10}\b",
    "interest_rate": r"\b\d+(?:\.\d+)?\s*%?(?:\s*p\.a\.)?\b",
    "amount": r"(?i)\b(?:₹|rs\.?|inr)?\s*\d{1,3}(?:,\d{2,3})*(?:\.\d{2})?\s*(?:lakh|crore)?\b",
}

PRODUCTS = ("home loan", "housing loan", "personal loan", "vehicle loan", "car loan", "education loan", "gold loan", "savings account", "current account", "fixed deposit", "fd", "recurring deposit", "rd", "credit card", "debit card", "upi", "net banking", "mobile banking")

BULLETS = "•·◦▪▸‣➢➤-*"
