"""Package advisories, manifest routing and manifest line patterns."""

# Advisories (ecosystem, package, affected below, advisory,
# severity), manifest names and extraction patterns.
ADVISORIES = [
    ("npm", "lodash", "4.17.21", "CVE-2021-23337", "HIGH"),
    ("npm", "minimist", "1.2.6", "CVE-2021-44906", "CRITICAL"),
    ("npm", "node-forge", "1.3.0", "CVE-2022-24771", "HIGH"),
    ("npm", "express", "4.19.2", "CVE-2024-29041", "MEDIUM"),
    ("npm", "jsonwebtoken", "9.0.0", "CVE-2022-23529", "HIGH"),
    ("npm", "tar", "6.1.9", "CVE-2021-37701", "HIGH"),
    ("npm", "glob-parent", "5.1.2", "CVE-2020-28469", "HIGH"),
    ("npm", "axios", "1.6.0", "CVE-2023-45857", "MEDIUM"),
    ("npm", "xml2js", "0.5.0", "CVE-2023-0842", "MEDIUM"),
    ("npm", "semver", "7.5.2", "CVE-2022-25883", "MEDIUM"),
    ("npm", "tough-cookie", "4.1.3", "CVE-2023-26136", "MEDIUM"),
    ("npm", "word-wrap", "1.2.4", "CVE-2023-26115", "MEDIUM"),
    ("npm", "serialize-javascript", "3.1.0", "CVE-2020-7660", "CRITICAL"),
    ("npm", "underscore", "1.13.6", "CVE-2021-23358", "HIGH"),
    ("pip", "django", "4.2.11", "CVE-2024-27351", "HIGH"),
    ("pip", "flask", "2.3.2", "CVE-2023-30861", "HIGH"),
    ("pip", "requests", "2.31.0", "CVE-2023-32681", "MEDIUM"),
    ("pip", "pillow", "10.0.1", "CVE-2023-44271", "HIGH"),
    ("pip", "cryptography", "42.0.0", "CVE-2023-49083", "HIGH"),
    ("pip", "jinja2", "3.1.3", "CVE-2024-22195", "MEDIUM"),
    ("pip", "urllib3", "2.0.7", "CVE-2023-45803", "MEDIUM"),
    ("pip", "pyyaml", "6.0.1", "CVE-2020-14343", "CRITICAL"),
    ("pip", "paramiko", "3.4.0", "CVE-2023-48795", "MEDIUM"),
    ("pip", "aiohttp", "3.9.2", "CVE-2024-23334", "HIGH"),
    ("maven", "log4j-core", "2.17.1", "CVE-2021-44228", "CRITICAL"),
    ("maven", "spring-webmvc", "5.3.28", "CVE-2023-34053", "HIGH"),
    ("maven", "commons-text", "1.10.0", "CVE-2022-42889", "CRITICAL"),
    ("maven", "jackson-databind", "2.15.3", "CVE-2022-42003", "HIGH"),
    ("maven", "snakeyaml", "2.0", "CVE-2022-1471", "CRITICAL"),
    ("maven", "gson", "2.8.9", "CVE-2022-25647", "HIGH"),
    ("maven", "commons-io", "2.14.0", "CVE-2024-47554", "MEDIUM"),
    ("go", "golang.org/x/crypto", "0.17.0", "CVE-2023-48795", "MEDIUM"),
    ("go", "golang.org/x/net", "0.23.0", "CVE-2023-45288", "HIGH"),
    ("go", "github.com/gin-gonic/gin", "1.9.1", "CVE-2023-29401", "MEDIUM"),
    ("gem", "rails", "7.0.8", "CVE-2023-38037", "MEDIUM"),
    ("gem", "nokogiri", "1.16.2", "CVE-2024-25062", "HIGH"),
    ("gem", "rack", "3.0.9", "CVE-2024-25126", "MEDIUM"),
    ("cargo", "hyper", "1.4.0", "CVE-2024-51996", "MEDIUM"),
    ("cargo", "h2", "0.4.4", "CVE-2024-2653", "HIGH"),
]

# (extractor, ecosystem, file names). Composer manifests are extracted like the
# others; no advisory names that ecosystem, so they yield packages only.
MANIFESTS = [
    ("npm", "npm", "package.json"),
    ("npm_lock", "npm", "package-lock.json yarn.lock pnpm-lock.yaml"),
    ("python", "pip", "requirements.txt Pipfile Pipfile.lock setup.py setup.cfg pyproject.toml"),
    ("maven", "maven", "pom.xml"),
    ("gradle", "maven", "build.gradle build.gradle.kts"),
    ("go", "go", "go.mod go.sum"),
    ("gem", "gem", "Gemfile Gemfile.lock"),
    ("cargo", "cargo", "Cargo.toml Cargo.lock"),
    ("composer", "composer", "composer.json composer.lock"),
]

# extractor -> [(pattern, package group, version group)]
EXTRACTORS = {
    "npm": [(r'"([^"]+)"\s*:\s*"[~^]?(\d+\.\d+\.\d+[^"]*)"', 1, 2)],
    "npm_lock": [(r'"([^"@]+)"\s*:\s*\{[^}]*"version"\s*:\s*"(\d+\.\d+\.\d+[^"]*)"', 1, 2)],
    "python": [(r'(?m)^\s*([a-zA-Z0-9_-]+)\s*(?:==|>=|<=|~=|!=)\s*(\d+\.\d+(?:\.\d+)?)', 1, 2)],
    "maven": [(r'<artifactId>\s*([^<]+)\s*</artifactId>\s*(?:<[^>]+>[^<]*</[^>]+>\s*)*<version>\s*([^<]+)\s*</version>', 1, 2)],
    "gradle": [(r'''(?:implementation|compile|api|runtimeOnly)\s*['"(]([^:'"]+):([^:'"]+):([^'")\s]+)''', 2, 3)],
    "go": [(r'(?m)^\s*(\S+)\s+v(\d+\.\d+\.\d+)', 1, 2)],
    "gem": [(r'''(?m)gem\s+['"]([^'"]+)['"]\s*(?:,\s*['"].*?(\d+\.\d+(?:\.\d+)?))?''', 1, 2)],
    "cargo": [(r'(?m)^(\w[\w-]*)\s*=\s*"(\d+\.\d+(?:\.\d+)?)"', 1, 2),
              (r'(?m)^(\w[\w-]*)\s*=\s*\{[^}]*version\s*=\s*"(\d+\.\d+(?:\.\d+)?)"', 1, 2)],
    "composer": [(r'"([^"]+/[^"]+)"\s*:\s*"[~^]?(\d+\.\d+(?:\.\d+)?)"', 1, 2)],
}
# The maven pattern with its repeated group made possessive and captured, for a
# matcher that recurses at every repetition: group 2 holds all elements up to the
# version and beyond; the last version in it is the one the pattern above ends at.
MAVEN_RUN = r'<artifactId>\s*([^<]+)\s*</artifactId>\s*((?:<[^>]+>[^<]*</[^>]+>\s*)*+)'
MAVEN_VERSION = r'(?s).*<version>\s*([^<]+)\s*</version>'
UNKNOWN_VERSION = "unknown"

# (severity, vulnerability text, pattern), tested on every manifest line
RISKY_LINES = [
    ("HIGH", "Insecure protocol dependency (plaintext communication)",
     r'''(?i)(?:^|["'\s])(?:telnet|ftp|rsh|rlogin|rexec)://'''),
    ("MEDIUM", "Database driver detected — verify TLS/SSL is configured", r'(?i)(?:mysql|mongodb|redis)\b'),
]
