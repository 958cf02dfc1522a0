"""Word lists, patterns and weights of the contract domain. All are defaults of parameters."""

#: List items of target and of reference documents.
LIST_ITEM = r"^[a-z0-9]\.\s|^\([0-9]+\)\s|^[-*•]\s"
REFERENCE_ITEM = r"^[a-z]\.\s|^\([0-9]+\)\s|^[0-9]+\.\s"

#: Patterns that a noise line starts with.
NOISE_LINES = [r"<!-- image -->", r"<!-- .*? -->", r"\|.*?\|.*?\|", r"\s*\|.*?\|\s*$", r"\s*[-=:]+\s*$", r"\s*page \d+ of \d+\s*$", r"\s*\d+\s*$", r"\s*[A-Z]+\s*$"]
NOISE_LINE = "(?i)^(?:" + "|".join(NOISE_LINES) + ")"

#: Fixed values.
NOISE_INDICATORS = [
    "table of contents", "page break", "header", "footer", "appendix", "signature", "date:", "company identification",
    "contact information", "address:", "phone:", "email:", "fax:", "price (eur without vat)", "item description",
    "proposal", "table 1:", "table 2:", "table 3:",
]
NOISE_SYMBOLS = "|+-=_*#[](){}"

#: Fixed values.
LEGAL_KEYWORDS = [
    "shall", "agree", "contract", "agreement", "party", "parties", "terminate", "termination", "liable", "liability",
    "rights", "obligations", "payment", "fee", "confidential", "intellectual", "property", "indemnify", "damages",
    "breach", "notice", "governing", "law", "amendment", "modify", "assign", "transfer", "expire", "renew",
]

#: Fixed values.
TITLE_KEYWORDS = ["agreement", "contract", "terms", "license", "statement of work", "sow", "amendment", "order"]

#: Fixed values: (type, pattern) in order.
DOC_TYPE_PATTERNS = [
    ("software_license", r"software\s+license\s+agreement"),
    ("software_license", r"end\s+user\s+license\s+agreement"),
    ("software_license", r"eula"),
    ("software_license", r"software\s+licensing\s+terms"),
    ("master_agreement", r"master\s+(?:service|services|subscription)\s+agreement"),
    ("master_agreement", r"msa"),
    ("master_agreement", r"master\s+agreement"),
    ("master_agreement", r"framework\s+agreement"),
    ("statement_of_work", r"statement\s+of\s+work"),
    ("statement_of_work", r"sow"),
    ("statement_of_work", r"work\s+order"),
    ("statement_of_work", r"project\s+scope"),
    ("saas_agreement", r"saas\s+(?:service|services)?\s*agreement"),
    ("saas_agreement", r"software\s+as\s+a\s+service"),
    ("saas_agreement", r"cloud\s+services?\s+agreement"),
    ("saas_agreement", r"subscription\s+agreement"),
    ("purchase_order", r"purchase\s+order"),
    ("purchase_order", r"p\.?o\.?"),
    ("purchase_order", r"order\s+form"),
    ("amendment", r"amendment"),
    ("amendment", r"addendum"),
    ("amendment", r"modification\s+agreement"),
    ("amendment", r"change\s+order"),
    ("nda", r"non[\-\s]?disclosure\s+agreement"),
    ("nda", r"nda"),
    ("nda", r"confidentiality\s+agreement"),
    ("nda", r"mutual\s+non[\-\s]?disclosure"),
    ("service_agreement", r"(?:professional\s+)?services?\s+agreement"),
    ("service_agreement", r"consulting\s+(?:services?\s+)?agreement"),
    ("service_agreement", r"maintenance\s+(?:and\s+support\s+)?agreement"),
]

#: The first group is the header.
HEADER_PATTERNS = [r"(?i)^#+\s+(.+)$", r"(?i)^(\d+\.?\d*\.?\s+[A-Z][^.]+)$", r"(?i)^([A-Z][A-Z\s]{10,})$", r"(?i)^((?:ARTICLE|SECTION|EXHIBIT)\s+[IVX\d]+[:.]?\s*.+)$"]

#: Traces of a wrong character set.
GARBLED_PATTERNS = [r"[^\x00-\x7F]{5,}", r'â€™|â€"|â€œ', r"Ã¢|Ã©|Ã¨", r"\\x[0-9a-f]{2}", r"[?]{3,}"]

#: Fixed values: (category, severity, pattern, title, action, impact) in order.
RED_FLAGS = [
    ("liability_unlimited", "critical", r"(?i)(?:unlimited|no\s+limit|without\s+limitation).*liability", "Unlimited Liability Exposure", "REJECT or negotiate strict liability caps", "Unlimited financial exposure for any breach"),
    ("liability_unlimited", "high", r"(?i)liable.*(?:all|any|every).*(?:loss|damage|claim|cost)", "Broad Liability Coverage", "Negotiate specific exclusions and limitations", "Potential liability for unrelated third-party claims"),
    ("indemnification_asymmetric", "high", r"(?i)(?:you|customer|client).*(?:shall|will|agree).*indemnify.*(?:us|company|provider)(?!.*we.*indemnify)", "One-Sided Indemnification", "Demand mutual indemnification provisions", "One-way protection only benefits counterparty"),
    ("indemnification_asymmetric", "medium", r"(?i)indemnify.*(?:attorneys['\s]fees|legal\s+costs|defense\s+costs)", "Legal Fee Indemnification", "Negotiate mutual attorney fee provisions", "Potential for significant legal cost exposure"),
    ("ip_overreach", "critical", r"(?i)(?:assign|transfer|grant).*(?:all|entire|complete).*intellectual\s+property", "Broad IP Assignment", "Limit to specific work product only", "Loss of all IP including pre-existing and unrelated IP"),
    ("ip_overreach", "high", r"(?i)work.*(?:made\s+for\s+hire|for\s+hire)", "Work for Hire Designation", "Clarify scope of work for hire provisions", "Automatic IP ownership transfer to counterparty"),
    ("termination_unfair", "high", r"(?i)(?:we|company|provider).*(?:may|can|right).*terminat.*(?:immediately|any\s+time|without\s+notice)", "Unilateral Termination Rights", "Negotiate mutual termination rights with notice", "Business disruption risk from sudden termination"),
    ("termination_unfair", "medium", r"(?i)terminat.*(?:without\s+cause|for\s+convenience).*(?:immediately|no\s+notice)", "Immediate Termination for Convenience", "Require minimum notice period", "No protection against arbitrary termination"),
    ("payment_unfavorable", "high", r"(?i)(?:all\s+amounts|entire\s+balance|full\s+payment).*(?:immediately\s+due|payable\s+immediately)", "Payment Acceleration", "Limit acceleration to material uncured defaults", "Immediate cash flow impact upon any breach"),
    ("payment_unfavorable", "medium", r"(?i)(?:late\s+fee|interest).*(?:[2-9]\d|[1-9]\d\d+)%", "Excessive Late Fees", "Negotiate reasonable late fee rates (typically 1.5% monthly)", "Punitive charges for payment delays"),
    ("confidentiality_overreach", "high", r"(?i)confidential.*(?:perpetual|indefinite|forever|permanent)", "Perpetual Confidentiality", "Negotiate time limit (typically 3-5 years)", "Permanent business restrictions and compliance burden"),
    ("confidentiality_overreach", "medium", r"(?i)confidential.*(?:all\s+information|any\s+information|everything\s+disclosed)", "Overly Broad Confidentiality", "Define confidential information specifically", "Difficulty using general industry knowledge"),
    ("governing_law_hostile", "critical", r"(?i)governed.*(?:laws?\s+of\s+(?:north\s+korea|iran|cuba|syria))", "Hostile Jurisdiction", "REJECT - Legal/compliance violation risk", "Potential violation of sanctions and trade restrictions"),
    ("governing_law_hostile", "high", r"(?i)exclusive\s+jurisdiction.*(?:foreign|international|offshore)", "Exclusive Foreign Jurisdiction", "Negotiate for home jurisdiction or arbitration", "Expensive and complex foreign litigation"),
    ("compliance_violations", "critical", r"(?i)(?:anti-?bribery|fcpa|corruption).*(?:not\s+applicable|excluded|waived)", "Anti-Corruption Waiver", "REJECT - Compliance violation risk", "Potential criminal liability and regulatory violations"),
    ("compliance_violations", "high", r"(?i)(?:export|trade).*(?:restriction|compliance).*(?:not\s+applicable|waived)", "Export Control Waiver", "Restore full export control compliance", "Potential violations of international trade laws"),
    ("data_privacy_violations", "high", r"(?i)(?:gdpr|privacy|data\s+protection).*(?:not\s+applicable|excluded|waived)", "Privacy Law Exclusion", "Restore full privacy law compliance", "Regulatory fines and privacy violations"),
    ("data_privacy_violations", "medium", r"(?i)data.*(?:sold|shared|disclosed).*(?:third\s+part|affiliate|subsidiary)", "Broad Data Sharing", "Limit data sharing and require consent", "Privacy breaches and regulatory compliance issues"),
]

#: Fixed values: (group, type, level, pattern, guidance) in order.
RISK_INDICATORS = [
    ("liability", "unlimited_liability", "critical", r"(?i)(?:unlimited|no\s+limitation|without\s+limit).*liability", "Negotiate cap on liability or specific exclusions"),
    ("liability", "broad_liability", "high", r"(?i)liable\s+for.*(?:indirect|consequential|punitive|special).*damages", "Exclude consequential and indirect damages"),
    ("liability", "liability_exclusions", "high", r"(?i)limitation.*liability.*shall\s+not\s+apply", "Review exclusion scope and negotiate limitations"),
    ("indemnification", "broad_indemnification", "high", r"(?i)indemnify.*(?:against\s+all|for\s+any\s+and\s+all|from\s+and\s+against\s+any)", "Limit indemnification scope to specific claims"),
    ("indemnification", "mutual_indemnification", "medium", r"(?i)(?:mutual|each\s+party).*indemnif", "Ensure balanced indemnification obligations"),
    ("intellectual_property", "ip_assignment_broad", "critical", r"(?i)(?:assign|transfer).*(?:all|any).*intellectual\s+property", "Limit IP assignment to work specifically created"),
    ("intellectual_property", "ip_infringement_warranty", "high", r"(?i)warrant.*(?:does\s+not\s+infringe|non-infringement)", "Qualify warranty with knowledge limitations"),
    ("termination", "termination_convenience", "medium", r"(?i)terminat.*(?:at\s+any\s+time|for\s+convenience|without\s+cause)", "Ensure mutual termination rights or notice period"),
    ("termination", "termination_immediate", "high", r"(?i)(?:immediate|immediately).*terminat", "Add cure period for non-material breaches"),
    ("confidentiality", "confidentiality_broad", "medium", r"(?i)confidential.*(?:all\s+information|any\s+information|everything)", "Define confidential information more specifically"),
    ("confidentiality", "confidentiality_perpetual", "high", r"(?i)confidential.*(?:perpetual|indefinite|forever)", "Negotiate time limit on confidentiality"),
    ("governing_law", "foreign_jurisdiction", "low", r"(?i)governed\s+by.*(?:laws\s+of.*(?:england|delaware|new\s+york|california))", "Consider implications of foreign law"),
    ("governing_law", "exclusive_jurisdiction", "medium", r"(?i)exclusive\s+jurisdiction", "Negotiate for non-exclusive jurisdiction"),
    ("payment", "payment_acceleration", "high", r"(?i)(?:all\s+amounts|entire\s+amount).*(?:immediately\s+due|become\s+due)", "Limit acceleration to material defaults"),
    ("payment", "late_fees_high", "medium", r"(?i)(?:late\s+fee|interest).*(?:[2-9]\d|1[5-9])%", "Negotiate reasonable late fee rates"),
    ("warranty", "warranty_broad", "medium", r"(?i)warrant.*(?:all|complete|total|absolute)", "Qualify warranties with materiality thresholds"),
    ("warranty", "warranty_performance", "high", r"(?i)warrant.*(?:performance|results|outcomes)", "Limit to effort-based rather than results-based"),
]

#: Advice by the level of red flags, and points to negotiate by category.
LEVEL_ADVICE = {
    "critical": "DO NOT SIGN - Critical issues require resolution", "many_high": "CAUTION - Multiple high-risk issues require negotiation", "high": "REVIEW REQUIRED - Address high-risk provisions",
    "medium": "NEGOTIATE - Address medium-risk provisions", "low": "ACCEPTABLE - Standard contract review recommended",
}
CRITICAL_POINT = "1. CRITICAL: Address unlimited liability and IP overreach"
POINTS = [
    ("liability_unlimited", "2. Negotiate liability caps and limitations"), ("indemnification_asymmetric", "3. Establish mutual indemnification provisions"),
    ("termination_unfair", "4. Balance termination rights and notice periods"), ("ip_overreach", "5. Limit IP assignment to specific deliverables"),
]
