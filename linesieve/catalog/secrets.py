"""Credential patterns.

Our own list for the credential types the reference documents: cloud keys,
forge tokens, chat tokens and webhooks, payment keys, service accounts, generic
keys, passwords and tokens, private key blocks, connection strings, bearer and
basic authentication. Patterns use only ASCII
classes and no look-around. Group 1 is the part to hide.

Rows are (rule_name, description, severity, pattern).
"""

SECRET_RULES = [
    ("AWS Access Key", "Cloud access key id", "CRITICAL", r"((?:AKIA|ASIA)[A-Z0-9]{16})"),
    ("AWS Secret Key", "Cloud secret access key", "CRITICAL",
     r"""(?i)aws[a-z_]{0,20}secret[a-z_]{0,20}["']?[ \t]*[:=][ \t]*["']?([A-Za-z0-9/+]{40})"""),
    ("Google API Key", "Cloud API key", "HIGH", r"(AIza[A-Za-z0-9_-]{35})"),
    ("GitHub Token", "Forge access token", "CRITICAL", r"((?:ghp_|gho_|ghu_|ghs_|ghr_)[A-Za-z0-9]{36})"),
    ("GitLab Token", "Forge access token", "CRITICAL", r"(glpat-[A-Za-z0-9_-]{20})"),
    ("Slack Token", "Chat workspace token", "HIGH", r"(xox[abprs]-[A-Za-z0-9-]{10,48})"),
    ("Slack Webhook", "Chat workspace webhook", "HIGH",
     r"(https://hooks[.]slack[.]com/services/T[A-Za-z0-9_]{6,}/B[A-Za-z0-9_]{6,}/[A-Za-z0-9_]{16,})"),
    ("Google Service Account", "Cloud service account key", "CRITICAL", r"""["']private_key_id["'][ \t]*:[ \t]*["']([0-9a-f]{40})["']"""),
    ("Auth0 Client Secret", "Identity provider client secret", "CRITICAL",
     r"""(?i)auth0[a-z0-9_-]{0,30}secret["']?[ \t]*[:=][ \t]*["']?([A-Za-z0-9_-]{32,})"""),
    ("Stripe Publishable Key", "Payment publishable key", "MEDIUM", r"(pk_live_[A-Za-z0-9]{16,64})"),
    ("Stripe Key", "Payment API key", "CRITICAL", r"((?:sk|rk)_live_[A-Za-z0-9]{16,64})"),
    ("JSON Web Token", "Signed web token", "HIGH",
     r"(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"),
    ("Private Key", "Private key block", "CRITICAL", r"(-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----)"),
    ("PGP Private Key", "Private key block", "CRITICAL", r"(-----BEGIN PGP PRIVATE KEY BLOCK-----)"),
    ("Database URL", "Connection string with a password", "CRITICAL",
     r"(?i)(?:postgres|postgresql|mysql|mongodb|redis|amqp)(?:\+[a-z]+)?://[^: \t/@]+:([^@ \t/]+)@"),
    ("Bearer Token", "Bearer authentication header", "HIGH", r"(?i)bearer[ \t]+([A-Za-z0-9._~+/-]{20,})"),
    ("Basic Auth", "Basic authentication header", "HIGH", r"(?i)authorization[\"']?[ \t]*[:=][ \t]*[\"']?basic[ \t]+([A-Za-z0-9+/=]{8,})"),
    ("Generic Password", "Password assigned from a literal", "HIGH",
     r"""(?i)(?:password|passwd|pwd)["']?[ \t]*[:=][ \t]*["']([^"' \t]{4,})["']"""),
    ("Generic API Key", "API key assigned from a literal", "HIGH",
     r"""(?i)(?:api_key|api-key|apikey)["']?[ \t]*[:=][ \t]*["']([A-Za-z0-9_-]{8,})["']"""),
    ("Generic Secret", "Secret assigned from a literal", "HIGH",
     r"""(?i)(?:secret|secret_key|secret-key|secretkey)["']?[ \t]*[:=][ \t]*["']([^"' \t]{6,})["']"""),
    ("Generic Token", "Token assigned from a literal", "MEDIUM",
     r"""(?i)token["']?[ \t]*[:=][ \t]*["']([A-Za-z0-9._-]{8,})["']"""),
]
# A redacted value keeps at most this many characters and a quarter of its own;
# one that is shorter than the second number keeps none.
REDACT_KEEP = 4
REDACT_WHOLE = 12

# Credentials over several lines. A key block, or an assignment to a name of the list that leaves its
# value open, goes on over the lines that hold nothing but encoded text.
SENSITIVE_NAME = r"(?i)(?:private[_-]?key|secret|password|passwd|token|api[_-]?key|credential)[a-z0-9_-]{0,30}[\"']?[ \t]*[:=][ \t]*"
KEY_BEGIN = r"-----BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----"
KEY_END = r"-----END [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----"
OPEN_VALUE = SENSITIVE_NAME + r"""(?:(?:[|>][+-]?[0-9]?|[(\["'`]{1,4}|\\)?|["'(`]{0,4}[a-z0-9+/_-]{16,}(?:["']?[ \t]*[\\+])?)[ \t]*$"""
BODY_LINE = r"""^[ \t"'`+#*>]{0,40}[A-Za-z0-9+/=_-]{16,}(?:\\[nr])*["'`]?[ \t,;+)\\]{0,8}$"""
SHORT_BODY_LINE = r"""^[ \t"'`+#*>]{0,40}[A-Za-z0-9+/=_-]{1,15}(?:\\[nr])*["'`]?[ \t,;+)\\]{0,8}$"""
KEY_HEADER = r"^[ \t]{0,40}(?:Proc-Type|DEK-Info|Version|Comment|Hash): "
# What is hidden on a line though no rule reports it: a key behind its mark, and the first part of an open value.
HIDDEN_ONLY = [
    KEY_BEGIN + r"((?:\\[nr]|[A-Za-z0-9+/= \t])+)",
    SENSITIVE_NAME + r"""["'(`]{0,4}([a-z0-9+/_-]{16,})(?:["']?[ \t]*[\\+])?[ \t]*$""",
]
