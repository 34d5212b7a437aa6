"""Attack chains: what is anchored where, and the steps it suggests.

Titles, severities, scores and step types are fixed values and must equal the
published ones; the descriptions are our own.
"""

# key: (title, severity, score, impact, [(description, type), ...])
CHAINS = {
    "tainted_exec": ("Taint-confirmed", "CRITICAL", 9.8, "Attacker-chosen statements run on the server",
                     [("Untrusted input enters", "taint_source"), ("The input reaches the call", None)]),
    "ssrf_internal": ("SSRF to Internal Service/Data Access", "CRITICAL", 9.1,
                      "Internal services and cloud metadata become reachable",
                      [("The server can be made to send requests", "SSRF"),
                       ("Path traversal in the same file reads local files", "PathTraversal")]),
    "xss_takeover": ("XSS to Account Takeover Chain", "HIGH", 8.1, "Accounts can be taken over",
                     [("Script is injected", "XSS"), ("The session is read by the script", "SessionHijacking")]),
    "deser_rce": ("Insecure Deserialization to RCE", "CRITICAL", 9.8, "The server can be taken over",
                  [("Untrusted objects are read", "InsecureDeserialization"),
                   ("A chain of known classes runs code", "RemoteCodeExecution")]),
    "crypto_secret": ("Weak Crypto + Hardcoded Secrets → Data Breach", "HIGH", 7.5, "Stored data can be decrypted",
                      [("A secret stands in the code", "HardcodedSecret"),
                       ("The algorithm it serves is weak", "WeakCrypto")]),
    "xxe_ssrf": ("XXE → SSRF → Internal Data Exfiltration", "CRITICAL", 9.6, "Internal data leaves through the parser",
                 [("External entities are parsed", "XXE"), ("Entities fetch internal addresses", "SSRF"),
                  ("The answers are sent out", "DataExfiltration")]),
    "auth_escalation": ("Authentication Bypass → Privilege Escalation", "CRITICAL", 9.4, "Administrative access",
                        [("Authentication can be passed by", "BrokenAuth"),
                         ("Privileged functions are reached", "PrivilegeEscalation"),
                         ("An injection runs with these rights", None)]),
    "proto_rce": ("Prototype Pollution → Remote Code Execution", "HIGH", 8.6, "Code may run on server or client",
                  [("The prototype is written to", "PrototypePollution"),
                   ("Other objects inherit the value", "ObjectManipulation"),
                   ("A consumer runs it", "RemoteCodeExecution")]),
    "path_creds": ("Path Traversal → Sensitive File Read → Credential Theft", "HIGH", 8.2, "Credentials are read",
                   [("The path leaves its directory", "PathTraversal"), ("Sensitive files are read", "FileRead"),
                    ("Credentials in them are reused", "CredentialTheft")]),
    "log_forging": ("Log Injection → Log Forging → SIEM Evasion", "MEDIUM", 5.3, "Log entries can be forged",
                    [("Untrusted input enters", "TaintSource"), ("It is written to the log", "LogInjection")]),
    "redirect_oauth": ("Open Redirect → Phishing → OAuth Token Theft", "HIGH", 8.0, "Login tokens are stolen",
                       [("The redirect target is free", "OpenRedirect"),
                        ("It is used in a login flow", "OAuthAbuse"), ("The token arrives elsewhere", "TokenTheft")]),
    "template_rce": ("Server-Side Template Injection → Remote Code Execution", "CRITICAL", 9.8,
                     "The server can be taken over",
                     [("Untrusted input enters", "TaintSource"), ("It becomes template text", "TemplateInjection"),
                      ("The template engine runs it", "RemoteCodeExecution")]),
    "sqli_auth_repo": ("SQL Injection + Weak Auth → Complete Database Takeover", "CRITICAL", 9.9,
                       "The database can be taken over",
                       [("Authentication can be passed by", "BrokenAuth"),
                        ("SQL injection raises the rights", "SQLInjection"),
                        ("The data is copied out", "DataExfiltration")]),
    "token_in_logs": ("Auth Token in Plaintext Logs → Credential Theft", "MEDIUM", 6.5, "Logged tokens are reused",
                      [("A token is logged", "InfoDisclosure"), ("The log is read", "LogExfiltration"),
                       ("The token is replayed", "CredentialTheft")]),
}
GADGET_EXTENSIONS = ["java", "kt", "py", "rb", "php", "cs"]
CHECKSUM_WORDS = ["checksum", "hash", "digest", "etag"]
TOKEN_LOG_PREFIXES = ["KT-LOG", "MOB-LOG", "JS-LOG", "MOB-TOAST"]
PLATFORM_NOTES = {"android": "device log", "ios": "device console", "other": "browser console or server log"}
