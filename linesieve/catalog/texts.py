"""Short advice texts, one per weakness category."""

ADVICE = {
    "Injection": "Keep data out of the statement: bind parameters and avoid evaluating built strings.",
    "CommandInjection": "Call the program with an argument list and never through a shell.",
    "InsecureDeserialization": "Read untrusted data with a data-only format and an explicit type list.",
    "PathTraversal": "Resolve the path and check that it stays below the intended directory.",
    "XSS": "Escape output for its context or set text instead of markup.",
    "SSRF": "Check the target against a list of allowed hosts and block internal addresses.",
    "BrokenAuth": "Require authentication and verify origin, signature and comparison type.",
    "AuthorizationBypass": "Check the sender's origin before acting on a message.",
    "WeakCrypto": "Use a current algorithm and mode with keys from a key store.",
    "BufferOverflow": "Use length-checked calls and test every size.",
    "RaceCondition": "Make check and use one atomic step.",
    "InfoDisclosure": "Keep credentials and internals out of logs and responses.",
    "InsecureFileOps": "Restrict file type, location and permissions.",
    "InsecureStorage": "Keep tokens in protected storage that scripts cannot read.",
    "OpenRedirect": "Redirect only to listed destinations.",
    "TemplateInjection": "Pass data as template variables, never as template text.",
    "InsecureTLS": "Verify certificates and allow current protocol versions only.",
    "InsecureRandom": "Use a cryptographic generator for secrets.",
    "XXE": "Turn off external entities in the parser.",
    "PrototypePollution": "Filter prototype keys before merging objects.",
    "RegexDoS": "Do not build patterns from input, or bound matching time.",
    "UseAfterFree": "Clear the pointer when its memory is released.",
    "MassAssignment": "List the fields a request may set.",
    "HardcodedSecret": "Load secrets from the environment or a secret store.",
    "LDAPInjection": "Escape filter values.",
    "IntegerOverflow": "Check arithmetic on sizes before allocating.",
    "PrivilegeEscalation": "Guard privileged operations and drop rights early.",
    "FormatString": "Use a constant format string.",
    "CSRF": "Keep request forgery protection on.",
    "Misconfiguration": "Use the restrictive setting in production.",
    "IDOR": "Check that the object belongs to the caller.",
}
ADVICE_ELSE = "Review the flagged configuration and choose the restrictive setting."
