"""Patterns, names and formats that results depend on, as plain text and in their order.

Patterns follow the rules of Unicode for white space, digits and word boundaries; ``text.regex`` adds the flags.
"""

# ---- senders: the first pattern that matches the trimmed sender names its category
SENDER_CATEGORIES = [
    ("Mobile Number", r"^\+?[0-9]{10,15}$"),
    ("Numeric Shortcode", r"^[0-9]{3,9}$"),
    ("Commercial/Brand (Prefixed)", r"^[A-Za-z]{2}-.+$"),
    ("Commercial/Brand (Textual)", r"[A-Za-z]"),
]
SENDER_OTHERS = "Others"
OWN = "me"

# ---- funnel stages
AMOUNT = r"(?:rs\.?|inr|₹)\s*[\d,]+(?:\.\d{1,2})?|[\d,]+(?:\.\d{1,2})?\s*(?:rs\.?|inr|₹)"
ACCOUNT = r"a/?c\s*(?:no\.?\s*)?[X*x]+\d+|card\s*(?:no\.?\s*)?[Xx*]+\d+|card\s+\d{4}\b|card\s+ending\s+[Xx*]*\d+"
VERB = (
    r"\b(?:debited|credited|deducted|spent|paid|received|transferred|sent|reversed|refunded|used|withdrawn|deposited)(?=[^a-zA-Z]|$)"
    r"|\btxn\b|\bhas\s+(?:a\s+)?debit\s+by\b|\bhas\s+credit\s+for\b|\bwithout\s+OTP\b|\bauto.?debit\b|\bDebit\s+in\s+a/c\b"
    r"|\btxn\s+of\s+Rs\b|\bRedemption\s+payout\b|\b(?:money\s+transfer|amt\s+sent|amt\s+received)\b|you've\s+hand-?picked"
)
VERB_OLD = r"\b(?:debited|credited|deducted|spent|paid|received|transferred|sent|reversed|refunded|used|money\s+transfer|amt\s+sent|amt\s+received)\b"
OTP = r"\botp\b|\bone.?time.?password\b|\bverification.?code\b"
COLLECT = r"has\s+requested\s+money|requested\s+Rs\.?|collect\s+request|mandate\s+request|request\s+from\s+you"
FALSE_POSITIVE = r"Statement is sent|is due by|CKYC|Pay Total Amount Due"
FINANCIAL = [
    r"(?:Rs\.?|INR|₹)\s*[\d,]+",
    r"(?:debited|credited|debit|credit)",
    r"(?:A/[Cc]|a/c|acct)\s*[Xx\d]+",
    r"(?:UPI|NEFT|IMPS|RTGS|ATM)",
    r"(?:Avl\s*Bal|balance|bal)",
    r"(?:OTP|CVV|PIN)\s*\d+",
    r"(?:EMI|loan|premium|insurance)",
    r"(?:SBI|HDFC|ICICI|Axis|Kotak|BOB|PNB|Yes Bank|IndusInd)",
    r"(?:Paytm|PhonePe|GPay|BHIM|Razorpay)",
    r"(?:credit\s*card|debit\s*card)",
    r"(?:mutual\s*fund|SIP|NAV|folio)",
]

# ---- extractors: name, pattern, type, and the groups that hold (amount, account, counterparty, date), 0 for none
_AMT = r"([\d,]+(?:\.\d+)?)"
EXTRACTORS = [
    ("hdfc_sent", rf"Sent\s+Rs\.?{_AMT}\s+From\s+HDFC\s+Bank\s+(A/C\s*[\*x]?\d+)\s+To\s+(.+?)\s+On\s+(\S+)", "debit", (1, 2, 3, 4)),
    ("hdfc_txn_card", rf"Txn\s+Rs\.?{_AMT}\s+On\s+HDFC\s+Bank\s+(Card\s+\d+)\s+At\s+(.+?)\s+by\s+UPI\s+\S+\s+On\s+(\S+)", "debit", (1, 2, 3, 4)),
    ("hdfc_spent_on", rf"Spent\s+Rs\.?{_AMT}\s+On\s+HDFC\s+Bank\s+(Card\s+\d+)\s+At\s+(.+?)\s+On\s+(\S+)", "debit", (1, 2, 3, 4)),
    ("hdfc_rs_spent", rf"Rs\.?{_AMT}\s+spent\s+on\s+HDFC\s+Bank\s+(Card\s+x?\d+)\s+at\s+(.+?)\s+on\s+(\S+)", "debit", (1, 2, 3, 4)),
    ("hdfc_credit_alert", rf"Credit\s+Alert!\s+Rs\.?{_AMT}\s+credited\s+to\s+HDFC\s+Bank\s+(A/c\s*[Xx]*\d+)\s+on\s+(\S+)\s+from\s+VPA\s+(\S+)", "credit", (1, 2, 4, 3)),
    ("hdfc_card_payment", rf"Online\s+Payment\s+of\s+Rs\.?{_AMT}\s+.*?credited\s+to\s+your\s+(card\s+ending\s+\d+)\s+On\s+(\S+)", "credit", (1, 2, 0, 3)),
    ("hdfc_neft_deposit", rf"INR\s+{_AMT}\s+deposited\s+in\s+HDFC\s+Bank\s+(A/c\s*[Xx]*\d+)\s+on\s+(\S+)\s+for\s+NEFT\s+Cr-(.+?)Avl", "credit", (1, 2, 4, 3)),
    ("hdfc_refund", rf"Rs\.?\s*{_AMT}\s+refunded\s+by\s+(.+?)\s+on\s+(\S+).*?(?:HDFC\s+Bank\s+)?(Credit\s+Card\s+\d+)", "credit", (1, 4, 2, 3)),
    ("icici_spent", rf"INR\s+{_AMT}\s+spent\s+using\s+ICICI\s+Bank\s+(Card\s+XX\d+)\s+on\s+(\S+)\s+on\s+(.+?)\.\s*Avl", "debit", (1, 2, 4, 3)),
    ("icici_debited", rf"ICICI\s+Bank\s+(Credit\s+Card\s+XX\d+)\s+debited\s+for\s+INR\s+{_AMT}\s+on\s+(\S+)\s+for\s+UPI-\d+-(.+?)\.?\s*(?:To\s+dispute|$)", "debit", (2, 1, 4, 3)),
    ("icici_payment", rf"Payment\s+of\s+Rs\s+{_AMT}\s+has\s+been\s+received\s+on\s+your\s+ICICI\s+Bank\s+(Credit\s+Card\s+XX\d+)\s+through\s+.+?\s+on\s+(\S+)", "credit", (1, 2, 0, 3)),
    ("sbi_credit", rf"(A/c\s*X\d+)-credited\s+by\s+Rs\.?{_AMT}\s+on\s+(\S+)\s+transfer\s+from\s+(.+?)\s+Ref", "credit", (2, 1, 4, 3)),
    ("sbi_debit", rf"(A/c\s*X\d+)-debited\s+by\s+Rs\.?{_AMT}\s+on\s+(\S+)\s+transfer\s+to\s+(.+?)\s+Ref", "debit", (2, 1, 4, 3)),
]

# ---- shapes of dates that are read; digits are those of any script, months are named in ``MONTHS``
DATE_SHAPES = {
    "iso": r"^(\d{4})-(\d{2})-(\d{2})",
    "slash": r"^(\d{1,2})/(\d{2})/(\d{2})$",
    "named": r"^(\d{1,2})/([A-Za-z]{3})/(\d{4})",
    "dashed": r"^(\d{1,2})-([A-Za-z]{3})-(\d{2,4})",
    "joined": r"^(\d{1,2})([A-Za-z]{3})(\d{2})$",
    "short": r"^(\d{2})-(\d{2})-(\d{2})$",
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# ---- categories: the first pattern that matches names the category; the first list reads across lines
TRANSACTION_CATEGORIES = [
    ("hdfc_sent", r"Sent\s+Rs"),
    ("hdfc_txn", r"Txn\s+Rs.*On\s+HDFC\s+Bank\s+Card"),
    ("hdfc_spent", r"Spent\s+Rs.*On\s+HDFC\s+Bank\s+Card"),
    ("hdfc_rs_spent", r"Rs.*spent\s+on\s+HDFC\s+Bank\s+Card"),
    ("hdfc_credit_alert", r"Credit\s+Alert"),
    ("hdfc_card_payment", r"Online\s+Payment.*card\s+ending"),
    ("hdfc_neft", r"deposited.*NEFT"),
    ("hdfc_refund", r"refunded\s+by"),
    ("icici_spent", r"spent\s+using\s+ICICI\s+Bank\s+Card"),
    ("icici_debited", r"ICICI.*debited\s+for\s+INR"),
    ("icici_payment", r"Payment.*received.*ICICI"),
    ("sbi_credit", r"A/c\s*X\d+-credited"),
    ("sbi_debit", r"A/c\s*X\d+-debited"),
]
OTHER_CATEGORIES = [
    ("otp", r"\bOTP\b|\bone.time.pass"),
    ("statement", r"Statement\s+is\s+sent|Amount\s+Due|minimum.*due\s+by"),
    ("hdfc_pay_confirm", r"PAYMENT.*RECEIVED.*CREDIT\s+CARD|AVAILABLE\s+LIMIT.*CREDIT"),
    ("cab", r"CabID|MoveInSync|within\s+\d+km.*pickup"),
    ("mf_sip", r"SIP\s+installment|Mutual\s+Fund|NAV\s+of|units\s+are\s+allotted"),
    ("stock", r"KOTAK\s+SECURITIES|Securities\s+bal|NSDL.*blocked\s+for\s+debit|NSE.*reported"),
    ("bill_split", r"split.*bill|axio\.co"),
    ("wallet", r"Simpl|Pay\s+Later.*Simpl|instalment.*Simpl"),
    ("wallet", r"Apay\s+[Bb]alance|Amazon\s+Pay\s+balance|Juspay"),
    ("loan_offer", r"Pre.?approved.*[Ll]oan|Personal\s+Loan.*approved|loan.*ready"),
    ("kyc", r"KYC.*expir|Complete\s+KYC|KYC\s+Link"),
    ("delivery", r"order.*could\s+not|DELIVERY\s+ATTEMPTED|dispatch|your\s+order.*track"),
    ("refund_notif", r"Refund.*initiated|refund.*credited\s+by.*Aug|Refund.*Zomato"),
    ("banking_misc", r"iMobile.*activated|NetBanking.*verify|CKYC\s+Number|AutoPay.*Success|E-mandate.*Success"),
    ("utility_bill", r"ebill|JioHome|Bill\s+Summary|Bill\s+period"),
    ("telecom", r"[Rr]echarge|EXPIR.*pack|plan.*expir|Services\s+stopped"),
]
OTHER = "other"

# ---- gold set: rows to draw for (year, category)
TRANSACTION_TARGETS = {
    2026: {"hdfc_sent": 8, "hdfc_txn": 7, "hdfc_spent": 3, "hdfc_credit_alert": 3, "hdfc_card_payment": 2, "hdfc_neft": 2, "icici_spent": 3, "icici_debited": 5, "icici_payment": 2, "sbi_credit": 2},
    2025: {"hdfc_sent": 4, "hdfc_txn": 4, "hdfc_spent": 1, "hdfc_rs_spent": 2, "hdfc_credit_alert": 2, "hdfc_card_payment": 1, "hdfc_neft": 1, "hdfc_refund": 1, "icici_spent": 2, "icici_payment": 1, "sbi_credit": 1},
}
OTHER_TARGETS = {
    2026: {"otp": 5, "statement": 2, "hdfc_pay_confirm": 2, "cab": 2, "mf_sip": 1, "stock": 2, "wallet": 2, "loan_offer": 1, "banking_misc": 2, "utility_bill": 1, "telecom": 2, "other": 3},
    2025: {"otp": 4, "stock": 2, "bill_split": 2, "wallet": 2, "loan_offer": 1, "kyc": 1, "delivery": 1, "refund_notif": 1, "banking_misc": 1, "telecom": 2, "mf_sip": 1, "other": 5},
}

# ---- answers
REQUIRED_FIELDS = ("amount", "type", "account")
QUANT = r"-((?:I?Q[0-9]_(?:K_)?[A-Z]+)|Q[0-9]_[0-9]|F16|BF16)\.gguf$"
GRAMMAR = r'^(?:null|\{\s*"amount"\s*:\s*[0-9]+(?:\.[0-9]+)?\s*,\s*"counterparty"\s*:\s*(?:null|"(?:[^"\\]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")\s*,\s*"type"\s*:\s*"(?:debit|credit)"\s*,\s*"account"\s*:\s*"(?:[^"\\]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"\s*\})$'
CONTEXT_CAP = 32768
