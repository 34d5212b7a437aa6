"""Line-pattern rules: one row per rule, matched against single lines.

Rows are (rule_id, name, category, severity, languages, cwe, pattern).
A pattern of None marks a rule that is not a line rule: C-MEM-001 is computed
by ``operators.patterns.double_free``.

Six ids occur twice with different patterns (for example a general and a
framework-specific form of the same weakness). They stay two rows; a line that
meets either is reported once under the id.

Five patterns differ from their published form because that form cannot match
or does not compile: PY-XSS-001 (bare brace), PY-TMPL-001, JS-DESER-001,
JS-SSRF-001 (first row) and JAVA-SEC-004 (two opening parentheses required
where a call has one). C-FMT-001 is written without a repeated group (same language,
but the Java matcher recurses once per repetition of a group).
"""

# Rule ids, names, categories, severities, languages, weakness
# numbers and patterns must equal the published rule set for equal results.
RULES = [
    ('PY-INJ-001', 'SQL Injection (Python)', 'Injection', 'CRITICAL', 'py', 'CWE-89',
     r'''(?i)(?:execute|cursor\.execute|\.raw|\.extra)\s*\(\s*(?:f["\']|["\'].*%s|["\'].*\bformat\b|["\'].*\+)'''),
    ('PY-INJ-002', 'Command Injection (Python)', 'CommandInjection', 'CRITICAL', 'py', 'CWE-78',
     r'''(?i)(?:os\.system|os\.popen|subprocess\.call|subprocess\.Popen|subprocess\.run|commands\.getoutput)\s*\(\s*(?:f["\']|.*\+|.*%|.*\.format)'''),
    ('PY-INJ-003', 'Code Injection via eval/exec (Python)', 'Injection', 'CRITICAL', 'py', 'CWE-94',
     r'(?i)\b(?:eval|exec|compile)\s*\([^)]*(?:request|input|argv|args|param|data|user|query|payload|body)'),
    ('PY-DESER-001', 'Insecure Deserialization (Python pickle)', 'InsecureDeserialization', 'CRITICAL', 'py', 'CWE-502',
     r'(?i)(?:pickle\.loads?|cPickle\.loads?|marshal\.loads?|shelve\.open|yaml\.(?:unsafe_load|load\s*\())'),
    ('PY-PATH-001', 'Path Traversal (Python)', 'PathTraversal', 'HIGH', 'py', 'CWE-22',
     r'''(?i)(?:open|Path)\s*\(\s*(?:f["\']|.*\+|.*%|.*\.format|.*os\.path\.join)\s*.*(?:request|input|argv|param|filename|user)'''),
    ('PY-SSRF-001', 'SSRF (Python)', 'SSRF', 'HIGH', 'py', 'CWE-918',
     r'''(?i)(?:requests\.(?:get|post|put|delete|patch|head)|urllib\.request\.urlopen|urllib2\.urlopen|httpx\.\w+|aiohttp\.\w+\.(?:get|post))\s*\(\s*(?:f["\']|.*\+|.*%|.*format|.*request|.*input|.*param|.*user|.*url)'''),
    ('PY-XSS-001', 'XSS via Template (Python)', 'XSS', 'HIGH', 'py html', 'CWE-79',
     r'(?i)(?:\|\s*safe\b|mark_safe\s*\(|Markup\s*\(|\{% autoescape\s+off|\.format\(.*request\.|render_template_string)'),
    ('PY-CRYPTO-001', 'Weak Cryptography (Python)', 'WeakCrypto', 'MEDIUM', 'py', 'CWE-327',
     r'''(?i)(?:hashlib\.(?:md5|sha1)\s*\(|DES\.new|ARC4\.new|Blowfish\.new|\.pbkdf2_hmac\s*\(\s*["\'](?:md5|sha1))'''),
    ('PY-RAND-001', 'Insecure Random (Python)', 'InsecureRandom', 'MEDIUM', 'py', 'CWE-330',
     r'(?i)\brandom\.(?:random|randint|choice|randrange|shuffle)\s*\(.*(?:token|secret|password|key|session|nonce|salt|otp|pin)'),
    ('PY-XXE-001', 'XXE via XML Parsing (Python)', 'XXE', 'HIGH', 'py', 'CWE-611',
     r'(?i)(?:etree\.parse|minidom\.parse|xml\.sax\.parse|etree\.fromstring|XMLParser)\s*\('),
    ('PY-TMPL-001', 'Server-Side Template Injection (Python)', 'TemplateInjection', 'CRITICAL', 'py', 'CWE-1336',
     r'(?i)(?:render_template_string|Template|Environment\s*\(.*\)\.from_string)\s*\(.*(?:request|input|param|user|data|body)'),
    ('PY-LDAP-001', 'LDAP Injection (Python)', 'LDAPInjection', 'HIGH', 'py', 'CWE-90',
     r'''(?i)(?:ldap\.search_s|search_s|ldap_search)\s*\(.*(?:f["\']|\.format|%s|\+\s*(?:request|input|user|param))'''),
    ('JS-INJ-001', 'SQL Injection (JavaScript)', 'Injection', 'CRITICAL', 'js ts jsx tsx', 'CWE-89',
     r'''(?i)(?:\.query|\.execute|\.raw)\s*\(\s*(?:`[^`]*\$\{|["\'].*\+|["\'].*concat)'''),
    ('JS-INJ-002', 'NoSQL Injection (JavaScript)', 'Injection', 'CRITICAL', 'js ts', 'CWE-943',
     r'(?i)(?:\.find|\.findOne|\.update|\.delete|\.aggregate|\.where)\s*\(\s*(?:\{[^}]*(?:req\.(?:body|query|params)|request\.|input)|JSON\.parse)'),
    ('JS-XSS-001', 'DOM XSS (JavaScript)', 'XSS', 'HIGH', 'js ts jsx tsx html', 'CWE-79',
     r'(?i)(?:\.innerHTML|\.outerHTML|document\.write|document\.writeln|\.insertAdjacentHTML)\s*(?:=|\()\s*(?:[^;]*(?:location|document\.URL|document\.referrer|window\.name|\.value|\.search|\.hash|req\.|request\.|param|user|input|data))'),
    ('JS-XSS-002', 'React dangerouslySetInnerHTML', 'XSS', 'HIGH', 'js ts jsx tsx', 'CWE-79',
     r'(?i)dangerouslySetInnerHTML\s*=\s*\{\s*\{\s*__html\s*:'),
    ('JS-CMD-001', 'Command Injection (JavaScript)', 'CommandInjection', 'CRITICAL', 'js ts', 'CWE-78',
     r'''(?i)(?:child_process\.exec\s*\(|execSync\s*\(|spawn\s*\(\s*["\'](?:sh|bash|cmd)|\.exec\s*\()\s*(?:`[^`]*\$\{|["\'].*\+|.*req\.|.*request\.|.*input|.*param|.*user)'''),
    ('JS-PROTO-001', 'Prototype Pollution (JavaScript)', 'PrototypePollution', 'HIGH', 'js ts', 'CWE-1321',
     r'(?i)(?:(?:deep)?[Mm]erge|extend|assign|defaults(?:Deep)?)\s*\([^)]*(?:req\.body|req\.query|req\.params|request\.|input|user|JSON\.parse)'),
    ('JS-DESER-001', 'Insecure Deserialization (JavaScript)', 'InsecureDeserialization', 'CRITICAL', 'js ts', 'CWE-502',
     r'(?i)(?:(?:node-serialize|serialize-javascript).*\.unserialize|yaml\.load|\.deserialize)\s*\(\s*.*(?:req\.|request\.|input|user|body|data|param)'),
    ('JS-SSRF-001', 'SSRF (JavaScript)', 'SSRF', 'HIGH', 'js ts', 'CWE-918',
     r'(?i)(?:axios|fetch|got|request|superagent|node-fetch|undici)\s*(?:\.(?:get|post|put|delete))?\s*\(\s*(?:`[^`]*\$\{|.*\+|.*req\.|.*request\.|.*param|.*user|.*input|.*url)'),
    ('JS-PATH-001', 'Path Traversal (JavaScript)', 'PathTraversal', 'HIGH', 'js ts', 'CWE-22',
     r'(?i)(?:fs\.(?:readFile|writeFile|access|stat|unlink|readdir|createReadStream|createWriteStream)(?:Sync)?|path\.(?:join|resolve))\s*\(.*(?:req\.|request\.|param|user|input|body|query)'),
    ('JS-EVAL-001', 'Code Injection via eval (JavaScript)', 'Injection', 'CRITICAL', 'js ts', 'CWE-94',
     r'(?i)\b(?:eval|Function|setTimeout|setInterval)\s*\(\s*(?:[^)]*(?:req\.|request\.|input|user|param|data|body|query)|`)'),
    ('JS-REDIRECT-001', 'Open Redirect (JavaScript)', 'OpenRedirect', 'MEDIUM', 'js ts', 'CWE-601',
     r'(?i)(?:res\.redirect|window\.location|location\.href|location\.assign|location\.replace)\s*(?:=|\()\s*(?:req\.|request\.|param|user|input|query|url)'),
    ('JS-REGEX-001', 'ReDoS - Regular Expression DoS (JavaScript)', 'RegexDoS', 'MEDIUM', 'js ts', 'CWE-1333',
     r'(?:new RegExp|\.match|\.test|\.replace)\s*\(\s*(?:req\.|request\.|input|user|param|body|query)'),
    ('JAVA-INJ-001', 'SQL Injection (Java)', 'Injection', 'CRITICAL', 'java', 'CWE-89',
     r'(?i)(?:Statement|createStatement|prepareStatement|createQuery|createNativeQuery|jdbcTemplate\.(?:query|update|execute))\s*(?:\(|\.).*(?:\+\s*|"\s*\+\s*)'),
    ('JAVA-INJ-002', 'Command Injection (Java)', 'CommandInjection', 'CRITICAL', 'java', 'CWE-78',
     r'(?i)(?:Runtime\.getRuntime\(\)\.exec|ProcessBuilder|new\s+ProcessBuilder)\s*\(.*(?:\+|concat|request|param|input|user|getParameter)'),
    ('JAVA-DESER-001', 'Insecure Deserialization (Java)', 'InsecureDeserialization', 'CRITICAL', 'java', 'CWE-502',
     r'(?i)(?:ObjectInputStream|\.readObject\s*\(|\.readUnshared\s*\(|XMLDecoder|XStream\.fromXML|SerializationUtils\.deserialize)'),
    ('JAVA-XXE-001', 'XXE (Java)', 'XXE', 'HIGH', 'java', 'CWE-611',
     r'(?i)(?:DocumentBuilderFactory|SAXParserFactory|XMLInputFactory|TransformerFactory|XMLReader|SchemaFactory)\.new(?:Instance|Factory)\s*\('),
    ('JAVA-PATH-001', 'Path Traversal (Java)', 'PathTraversal', 'HIGH', 'java', 'CWE-22',
     r'(?i)new\s+(?:File|FileInputStream|FileOutputStream|FileReader|FileWriter|RandomAccessFile)\s*\(.*(?:request|param|input|getParameter|user)'),
    ('JAVA-SSRF-001', 'SSRF (Java)', 'SSRF', 'HIGH', 'java', 'CWE-918',
     r'(?i)(?:new\s+URL|HttpURLConnection|HttpClient|RestTemplate|WebClient|OkHttpClient)\s*(?:\(|\.).*(?:request|param|input|getParameter|user)'),
    ('JAVA-CRYPTO-001', 'Weak Crypto (Java)', 'WeakCrypto', 'MEDIUM', 'java', 'CWE-327',
     r'''(?i)(?:Cipher\.getInstance\s*\(\s*["\'](?:DES|RC[24]|Blowfish|DESede|ECB)|MessageDigest\.getInstance\s*\(\s*["\'](?:MD5|SHA-?1)["\']|SecretKeySpec\s*\(.*["\']DES)'''),
    ('JAVA-LOG-001', 'Log Injection / Log4Shell pattern (Java)', 'Injection', 'HIGH', 'java', 'CWE-117',
     r'(?i)(?:logger|log|LOG)\s*\.(?:info|warn|error|debug|trace|fatal)\s*\(.*(?:request|getParameter|getHeader|getCookie|param|input|user)\b'),
    ('JAVA-LDAP-001', 'LDAP Injection (Java)', 'LDAPInjection', 'HIGH', 'java', 'CWE-90',
     r'(?i)(?:search|DirContext\.search)\s*\(.*(?:\+|concat).*(?:request|param|input|user|getParameter)'),
    ('JAVA-SSTI-001', 'Template Injection (Java)', 'TemplateInjection', 'CRITICAL', 'java', 'CWE-1336',
     r'(?i)(?:Velocity\.evaluate|engine\.eval|templateEngine\.process|freemarker\.template)\s*\(.*(?:request|param|input|user|getParameter)'),
    ('C-BOF-001', 'Buffer Overflow - Unsafe Functions', 'BufferOverflow', 'CRITICAL', 'c cpp h hpp cc cxx', 'CWE-120',
     r'\b(?:gets|strcpy|strcat|sprintf|vsprintf|scanf|sscanf|fscanf)\s*\('),
    ('C-BOF-002', 'Buffer Overflow - Unchecked Length', 'BufferOverflow', 'HIGH', 'c cpp h hpp cc cxx', 'CWE-120',
     r'\b(?:memcpy|memmove|memset|bcopy)\s*\([^)]*(?:strlen|sizeof\s*\*|argv|argc|input|buf|data|user|param|request)'),
    ('C-FMT-001', 'Format String Vulnerability', 'FormatString', 'CRITICAL', 'c cpp h hpp cc cxx', 'CWE-134',
     r'\b(?:printf|fprintf|sprintf|snprintf|vprintf|syslog)\s*\(\s*(?:[^"]*,\s*)?(?:buf|buffer|input|data|user|str|msg|argv|arg|param|request)\s*\)'),
    ('C-INT-001', 'Integer Overflow', 'IntegerOverflow', 'HIGH', 'c cpp h hpp cc cxx', 'CWE-190',
     r'(?:malloc|calloc|realloc|alloca)\s*\([^)]*(?:\*|\+)\s*(?:sizeof|len|size|count|num|n\b)'),
    ('C-UAF-001', 'Potential Use-After-Free', 'UseAfterFree', 'MEDIUM', 'c cpp h hpp cc cxx', 'CWE-416',
     r'free\s*\(\s*(\w+)\s*\)\s*;'),
    ('C-CMD-001', 'Command Injection (C/C++)', 'CommandInjection', 'CRITICAL', 'c cpp h hpp cc cxx', 'CWE-78',
     r'\b(?:system|popen|exec[lv]p?e?)\s*\([^)]*(?:argv|argc|input|buf|data|user|param|getenv|fgets)'),
    ('C-RACE-001', 'TOCTOU Race Condition', 'RaceCondition', 'MEDIUM', 'c cpp h hpp cc cxx', 'CWE-367',
     r'(?:access|stat|lstat)\s*\([^)]*\).*(?:open|fopen|unlink|rename|chmod|chown)\s*\('),
    ('C-RAND-001', 'Insecure Random (C/C++)', 'InsecureRandom', 'MEDIUM', 'c cpp h hpp cc cxx', 'CWE-338',
     r'\b(?:rand|srand|random|srandom)\s*\(\s*\)'),
    ('GO-INJ-001', 'SQL Injection (Go)', 'Injection', 'CRITICAL', 'go', 'CWE-89',
     r'(?i)(?:db\.(?:Query|Exec|QueryRow|Prepare)|\.(?:Raw|Where|Order|Group|Having|Select))\s*\(\s*(?:fmt\.Sprintf|.*\+)'),
    ('GO-CMD-001', 'Command Injection (Go)', 'CommandInjection', 'CRITICAL', 'go', 'CWE-78',
     r'''(?i)exec\.Command\s*\(\s*["\'](?:sh|bash|cmd|/bin/sh|/bin/bash)["\'].*(?:request|param|input|user|r\.(?:URL|Form|Body)|fmt\.Sprintf)'''),
    ('GO-SSRF-001', 'SSRF (Go)', 'SSRF', 'HIGH', 'go', 'CWE-918',
     r'(?i)(?:http\.(?:Get|Post|Head|NewRequest)|httpClient\.Do)\s*\(.*(?:r\.(?:URL|Form|Body)|request|param|input|user|fmt\.Sprintf)'),
    ('GO-PATH-001', 'Path Traversal (Go)', 'PathTraversal', 'HIGH', 'go', 'CWE-22',
     r'(?i)(?:os\.(?:Open|Create|ReadFile|WriteFile)|ioutil\.(?:ReadFile|WriteFile)|filepath\.(?:Join|Clean))\s*\(.*(?:r\.(?:URL|Form|Body)|request|param|input|user)'),
    ('GO-TMPL-001', 'Template Injection (Go)', 'TemplateInjection', 'HIGH', 'go', 'CWE-1336',
     r'(?i)template\.(?:New|Must)\s*\(.*(?:r\.|request|param|input|user)'),
    ('GO-CRYPTO-001', 'Weak Crypto (Go)', 'WeakCrypto', 'MEDIUM', 'go', 'CWE-327',
     r'(?:crypto/des|crypto/rc4|crypto/md5|crypto/sha1)\b|(?:\bdes|rc4|md5|sha1)\.(?:New|Sum|NewCipher|NewTripleDES)\b'),
    ('PHP-INJ-001', 'SQL Injection (PHP)', 'Injection', 'CRITICAL', 'php', 'CWE-89',
     r'''(?i)(?:mysql_query|mysqli_query|->query|pg_query|->execute)\s*\(\s*(?:["'].*\.\s*\$|["'].*\$\{|["'].*\$_(?:GET|POST|REQUEST|COOKIE))'''),
    ('PHP-INJ-002', 'Command Injection (PHP)', 'CommandInjection', 'CRITICAL', 'php', 'CWE-78',
     r'(?i)(?:exec|system|passthru|shell_exec|popen|proc_open|pcntl_exec|`)\s*\(\s*(?:.*\$_(?:GET|POST|REQUEST|COOKIE|SERVER)|.*\$(?:input|user|param|data|cmd|command))'),
    ('PHP-XSS-001', 'XSS (PHP)', 'XSS', 'HIGH', 'php', 'CWE-79',
     r'(?i)(?:echo|print|print_r|die|exit)\s+(?:.*\$_(?:GET|POST|REQUEST|COOKIE|SERVER)|.*\$(?:input|user|param|data))'),
    ('PHP-DESER-001', 'Insecure Deserialization (PHP)', 'InsecureDeserialization', 'CRITICAL', 'php', 'CWE-502',
     r'(?i)unserialize\s*\(\s*(?:\$_(?:GET|POST|REQUEST|COOKIE)|.*(?:input|user|param|data|body|request))'),
    ('PHP-FILE-001', 'File Inclusion (PHP)', 'PathTraversal', 'CRITICAL', 'php', 'CWE-98',
     r'(?i)(?:include|require|include_once|require_once)\s*\(\s*(?:\$_(?:GET|POST|REQUEST|COOKIE)|.*(?:input|user|param|data|file|page|path))'),
    ('PHP-SSRF-001', 'SSRF (PHP)', 'SSRF', 'HIGH', 'php', 'CWE-918',
     r'(?i)(?:file_get_contents|curl_setopt.*CURLOPT_URL|fopen)\s*\(\s*(?:\$_(?:GET|POST|REQUEST)|.*(?:input|user|param|url))'),
    ('PHP-EVAL-001', 'Code Injection (PHP)', 'Injection', 'CRITICAL', 'php', 'CWE-94',
     r'(?i)(?:eval|assert|preg_replace\s*\(.*\/e)\s*\(\s*(?:\$_(?:GET|POST|REQUEST|COOKIE)|.*(?:input|user|param|data))'),
    ('RB-INJ-001', 'SQL Injection (Ruby)', 'Injection', 'CRITICAL', 'rb', 'CWE-89',
     r'''(?i)(?:\.where|\.find_by_sql|\.order|\.group|\.having|\.pluck|\.select|\.joins)\s*\(\s*["'].*#\{'''),
    ('RB-CMD-001', 'Command Injection (Ruby)', 'CommandInjection', 'CRITICAL', 'rb', 'CWE-78',
     r'(?i)(?:(?:system|exec)\s*\(\s*(?:params|request\.\w+|input\b|user_input\b|\$\w+\[|gets\b)|%x\[[^\]]*(?:params|request|input|user|cmd|args)\b|IO\.popen\s*\(.*(?:params\b|request\.\w+|input\b|user\b|args\b)|Open3\.\w+\s*\(.*(?:params\b|request\.\w+|input\b|user\b|args\b)|Kernel\.system\s*\(.*(?:params\b|request\.\w+|input\b|user\b|args\b)|`[^`\n]*#\{[^}]*(?:params|request|input|user|cmd|args|data)\b)'),
    ('RB-DESER-001', 'Insecure Deserialization (Ruby)', 'InsecureDeserialization', 'CRITICAL', 'rb', 'CWE-502',
     r'(?i)(?:Marshal\.load|YAML\.load|Oj\.load)\s*\(.*(?:params|request|input|user|data|body)'),
    ('RB-XSS-001', 'XSS (Ruby on Rails)', 'XSS', 'HIGH', 'rb erb', 'CWE-79',
     r'(?i)(?:\.html_safe|raw\s*\(|<%==)\s*.*(?:params|request|input|user)'),
    ('RB-MASS-001', 'Mass Assignment (Ruby on Rails)', 'MassAssignment', 'HIGH', 'rb', 'CWE-915',
     r'(?i)(?:\.permit!|params\.(?:to_unsafe_h|to_h)|attr_accessible\s*:all|without_protection)'),
    ('RS-UNSAFE-001', 'Unsafe Block Usage', 'BufferOverflow', 'MEDIUM', 'rs', 'CWE-676',
     r'\bunsafe\s*\{'),
    ('RS-CMD-001', 'Command Injection (Rust)', 'CommandInjection', 'CRITICAL', 'rs', 'CWE-78',
     r'''(?i)Command::new\s*\(\s*(?:["'](?:sh|bash|cmd)["\']|.*(?:input|user|arg|param|request))'''),
    ('RS-SQL-001', 'SQL Injection (Rust)', 'Injection', 'CRITICAL', 'rs', 'CWE-89',
     r'(?i)(?:execute|query|query_one|query_opt|query_row|batch_execute)\s*\(\s*&?format!'),
    ('RS-PATH-001', 'Path Traversal (Rust)', 'PathTraversal', 'HIGH', 'rs', 'CWE-22',
     r'(?i)(?:File::(?:open|create)|fs::(?:read|write|read_to_string|remove))\s*\(\s*(?:&?format!|.*(?:input|user|param|request|arg))'),
    ('CS-INJ-001', 'SQL Injection (C#)', 'Injection', 'CRITICAL', 'cs', 'CWE-89',
     r'''(?i)(?:SqlCommand|OleDbCommand|OracleCommand|new\s+.*Command)\s*\(\s*(?:["'].*\+|\$"|.*string\.Format|.*String\.Concat)'''),
    ('CS-DESER-001', 'Insecure Deserialization (C#)', 'InsecureDeserialization', 'CRITICAL', 'cs', 'CWE-502',
     r'(?i)(?:BinaryFormatter|SoapFormatter|ObjectStateFormatter|LosFormatter|NetDataContractSerializer|TypeNameHandling\s*\.?\s*(?:All|Auto|Objects|Arrays))'),
    ('CS-XSS-001', 'XSS (C# / ASP.NET)', 'XSS', 'HIGH', 'cs cshtml', 'CWE-79',
     r'(?i)(?:@Html\.Raw|Response\.Write|<%=)\s*\(?\s*(?:Request|Model|ViewBag|ViewData|TempData|input|user|param)'),
    ('CS-CMD-001', 'Command Injection (C#)', 'CommandInjection', 'CRITICAL', 'cs', 'CWE-78',
     r'(?i)Process\.Start\s*\(.*(?:Request|input|user|param|args|query)'),
    ('CS-XXE-001', 'XXE (C#)', 'XXE', 'HIGH', 'cs', 'CWE-611',
     r'(?i)(?:XmlDocument|XmlTextReader|XmlReader\.Create|XDocument\.Load)\s*(?:\(\)|\.)'),
    ('KT-INJ-001', 'SQL Injection (Kotlin/Android)', 'Injection', 'CRITICAL', 'kt kts', 'CWE-89',
     r'''(?i)(?:rawQuery|execSQL|compileStatement)\s*\(\s*(?:["'].*\$|.*\+|.*string\.format)'''),
    ('KT-LOG-001', 'Sensitive Data in Logs (Mobile)', 'InfoDisclosure', 'MEDIUM', 'kt kts swift m mm', 'CWE-532',
     r'(?i)(?:Log\.(?:d|i|w|e|v)|println|Timber\.\w+|NSLog|print\b|debugPrint)\s*\(.*(?:password|token|secret|key|credential|ssn|credit.?card|api.?key|public.?token|link.?token|access.?token)'),
    ('SWIFT-KEYCHAIN-001', 'Insecure Data Storage (Swift/iOS)', 'InsecureFileOps', 'MEDIUM', 'swift', 'CWE-922',
     r'(?i)UserDefaults\.standard\.set\s*\(.*(?:password|token|secret|key|credential|session)'),
    ('SOL-REENT-001', 'Reentrancy Vulnerability', 'RaceCondition', 'CRITICAL', 'sol', 'CWE-841',
     r'\.call\{.*value'),
    ('SOL-ARITH-001', 'Unchecked Arithmetic (pre-0.8)', 'IntegerOverflow', 'HIGH', 'sol', 'CWE-190',
     r'(?:unchecked\s*\{|pragma\s+solidity\s+(?:0\.[4-7]|\^0\.[4-7]))'),
    ('SOL-AUTH-001', 'tx.origin Authentication', 'BrokenAuth', 'HIGH', 'sol', 'CWE-284',
     r'tx\.origin'),
    ('SOL-DELEG-001', 'Delegatecall to User-Controlled Address', 'Injection', 'CRITICAL', 'sol', 'CWE-94',
     r'\.delegatecall\('),
    ('SOL-DESTR-001', 'Unprotected Selfdestruct', 'PrivilegeEscalation', 'CRITICAL', 'sol', 'CWE-284',
     r'selfdestruct\s*\('),
    ('SOL-FRONT-001', 'Front-Running Vulnerable Pattern', 'RaceCondition', 'MEDIUM', 'sol', 'CWE-362',
     r'block\.(?:timestamp|number|difficulty|coinbase)'),
    ('PY-CSRF-001', 'Missing CSRF Protection (Django)', 'CSRF', 'HIGH', 'py', 'CWE-352',
     r'@csrf_exempt'),
    ('PY-AUTH-001', 'Hardcoded JWT Secret (Python)', 'HardcodedSecret', 'CRITICAL', 'py', 'CWE-798',
     r'''(?i)jwt\.encode\s*\(.*(?:secret|key)\s*=\s*["'][^"']{4,}["']'''),
    ('PY-AUTH-002', 'Flask Debug Mode', 'Misconfiguration', 'HIGH', 'py', 'CWE-489',
     r'(?i)(?:app\.run\s*\(.*debug\s*=\s*True|app\.debug\s*=\s*True|DEBUG\s*=\s*True)'),
    ('PY-SEC-001', 'Insecure Hash for Password (Python)', 'WeakCrypto', 'HIGH', 'py', 'CWE-916',
     r'(?i)hashlib\.(?:md5|sha1)\s*\(.*(?:password|passwd|pwd)'),
    ('PY-SEC-002', 'Binding to All Interfaces (Python)', 'Misconfiguration', 'LOW', 'py', 'CWE-668',
     r'''(?i)\.run\s*\(.*host\s*=\s*["']0\.0\.0\.0["']'''),
    ('PY-SEC-003', 'Python Temporary File Race Condition', 'RaceCondition', 'MEDIUM', 'py', 'CWE-377',
     r'(?i)(?:tempfile\.mktemp|os\.tempnam|os\.tmpnam)\s*\('),
    ('PY-SEC-004', 'Python Assert in Production', 'Misconfiguration', 'MEDIUM', 'py', 'CWE-617',
     r'assert\s+.*(?:is_authenticated|is_admin|has_permission|is_authorized|is_valid|verify)'),
    ('PY-SSRF-002', 'DNS Rebinding via urllib (Python)', 'SSRF', 'HIGH', 'py', 'CWE-918',
     r'(?i)(?:urllib\.request\.urlopen|requests\.\w+)\s*\(.*(?:allow_redirects\s*=\s*True|follow_redirects)'),
    ('PY-NOSQL-001', 'NoSQL Injection (Python/MongoDB)', 'Injection', 'HIGH', 'py', 'CWE-943',
     r'(?i)(?:collection|db)\.\w+\.\s*(?:find|find_one|update|delete|aggregate)\s*\(.*(?:request|param|args|form|json)'),
    ('PY-LOG-001', 'Sensitive Data in Logs (Python)', 'InfoDisclosure', 'MEDIUM', 'py', 'CWE-532',
     r'(?i)(?:logging|logger|log)\.\w+\(.*(?:password|token|secret|key|credential|session_id|credit_card|ssn)'),
    ('PY-CORS-001', 'Flask CORS Allow All', 'Misconfiguration', 'MEDIUM', 'py', 'CWE-942',
     r'''(?i)CORS\s*\(\s*app\s*(?:,\s*resources\s*=\s*r?[\"']\*)?(?:\s*\)|\s*,)'''),
    ('JS-PP-001', 'Prototype Pollution via merge', 'PrototypePollution', 'HIGH', 'js ts', 'CWE-1321',
     r'(?i)(?:lodash\.merge|_\.merge|deepMerge|Object\.assign|defaultsDeep|extend)\s*\(.*(?:req\.|request\.|body|query|param)'),
    ('JS-PP-002', 'Prototype Pollution via bracket notation', 'PrototypePollution', 'HIGH', 'js ts', 'CWE-1321',
     r'(?i)\w+\[\s*(?:req\.|request\.|body|query|param|key)\w*\s*\]\s*='),
    ('JS-AUTH-001', 'JWT Weak Secret (Node.js)', 'HardcodedSecret', 'CRITICAL', 'js ts', 'CWE-798',
     r'''(?i)jwt\.sign\s*\(.*(?:secret|key)\s*[:=]\s*["'][^"']{1,20}["']'''),
    ('JS-AUTH-002', 'JWT None Algorithm (Node.js)', 'BrokenAuth', 'CRITICAL', 'js ts', 'CWE-345',
     r'''(?i)jwt\.verify\s*\(.*(?:algorithms\s*:\s*\[.*["']none["']|options.*algorithms.*none)'''),
    ('JS-SEC-001', 'Express Trust Proxy Misconfiguration', 'Misconfiguration', 'MEDIUM', 'js ts', 'CWE-348',
     r'''(?i)app\.set\s*\(\s*["']trust\s+proxy["']\s*,\s*true\s*\)'''),
    ('JS-SEC-002', 'Node.js TLS Reject Unauthorized Disabled', 'InsecureTLS', 'HIGH', 'js ts', 'CWE-295',
     r'''NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*["']?0'''),
    ('JS-SEC-003', 'Helmet Missing (Express)', 'Misconfiguration', 'MEDIUM', 'js ts', 'CWE-693',
     r'(?i)express\s*\(\s*\)'),
    ('JS-SEC-004', 'Mongoose Debug Mode', 'InfoDisclosure', 'LOW', 'js ts', 'CWE-200',
     r'''mongoose\.set\s*\(\s*["']debug["']\s*,\s*true'''),
    ('JS-REDIR-001', 'Open Redirect (Express)', 'OpenRedirect', 'MEDIUM', 'js ts', 'CWE-601',
     r'(?i)res\.redirect\s*\(\s*(?:req\.(?:query|params|body)\.|request\.\w+)'),
    ('JS-CORS-001', 'CORS Wildcard Origin (Node.js)', 'Misconfiguration', 'MEDIUM', 'js ts', 'CWE-942',
     r'''(?i)(?:Access-Control-Allow-Origin.*\*|cors\(\s*\{?\s*origin\s*:\s*(?:true|["']\*["']))'''),
    ('JS-FILE-001', 'Path Traversal in File Serving (Node.js)', 'PathTraversal', 'HIGH', 'js ts', 'CWE-22',
     r'(?i)(?:sendFile|res\.download|createReadStream)\s*\(.*(?:req\.|request\.|params|query)'),
    ('JS-SSRF-001', 'SSRF via fetch/axios (Node.js)', 'SSRF', 'HIGH', 'js ts', 'CWE-918',
     r'(?i)(?:fetch|axios\.\w+|got\(|node-fetch)\s*\(\s*(?:req\.|request\.|.*\+|`\$\{)'),
    ('JS-LOG-001', 'Sensitive Data in Console.log', 'InfoDisclosure', 'MEDIUM', 'js ts jsx tsx', 'CWE-532',
     r'(?i)console\.log\s*\(.*(?:password|token|secret|key|credential|session|apiKey|public[_-]?token|link[_-]?token|access[_-]?token)'),
    ('JS-STORAGE-001', 'Sensitive Token Stored in localStorage', 'InsecureFileOps', 'MEDIUM', 'js ts jsx tsx', 'CWE-922',
     r'''(?i)localStorage\.setItem\s*\(\s*["'][^"']*(?:token|secret|key|auth|credential|access_token|link_token|jwt|session_id|api_key)[^"']*["']'''),
    ('JS-POSTMSG-001', 'postMessage Event Listener Without Origin Check', 'BrokenAuth', 'MEDIUM', 'js ts jsx tsx', 'CWE-346',
     r'''(?i)addEventListener\s*\(\s*["']message["']\s*,'''),
    ('JS-OAUTH-REDIR-001', 'OAuth redirect_uri / receivedRedirectUri from URL Parameters', 'OpenRedirect', 'MEDIUM', 'js ts jsx tsx', 'CWE-601',
     r'(?i)(?:searchParams\.get|URLSearchParams|location\.search)[^;)]*(?:redirect_uri|redirectUri|received_redirect_uri|receivedRedirectUri|oauth_redirect_uri|return_url|returnUrl|next)\b'),
    ('JS-REGEX-001', 'ReDoS — User Input in Regex (Node.js)', 'RegexDoS', 'MEDIUM', 'js ts', 'CWE-1333',
     r'(?i)new\s+RegExp\s*\(\s*(?:req\.|request\.|body|query|params|user)'),
    ('JS-DESER-002', 'Unsafe JSON Parsing with reviver', 'InsecureDeserialization', 'HIGH', 'js ts', 'CWE-502',
     r'(?i)JSON\.parse\s*\(.*function\s*\(.*(?:eval|Function|new\s+Function)'),
    ('JAVA-AUTH-001', 'Spring Security Disabled', 'BrokenAuth', 'HIGH', 'java kt', 'CWE-306',
     r'(?i)(?:\.csrf\(\)\.disable\(\)|\.authorizeRequests\(\)\.anyRequest\(\)\.permitAll\(\)|@(?:PermitAll|Anonymous))'),
    ('JAVA-CRYPTO-001', 'Java Insecure TLS Version', 'InsecureTLS', 'HIGH', 'java', 'CWE-326',
     r'''(?i)(?:SSLContext\.getInstance\s*\(\s*["'](?:SSL|SSLv3|TLS|TLSv1|TLSv1\.1)["']|setEnabledProtocols.*(?:SSLv3|TLSv1\.0|TLSv1\.1))'''),
    ('JAVA-CRYPTO-002', 'Java ECB Mode Cipher', 'WeakCrypto', 'HIGH', 'java', 'CWE-327',
     r'''(?i)Cipher\.getInstance\s*\(\s*["'](?:AES|DES|DESede)(?:/ECB)?["']\s*\)'''),
    ('JAVA-SEC-001', 'Java Reflection with User Input', 'Injection', 'CRITICAL', 'java', 'CWE-470',
     r'(?i)(?:Class\.forName|\.loadClass|\.getMethod|\.newInstance)\s*\(.*(?:request|param|user|input|args)'),
    ('JAVA-SEC-002', 'Java JNDI Injection (Log4Shell-style)', 'Injection', 'CRITICAL', 'java', 'CWE-917',
     r'(?i)(?:InitialContext\.lookup|ctx\.lookup|JndiTemplate\.lookup)\s*\(.*(?:request|param|user|input|header)'),
    ('JAVA-SEC-003', 'Java SpEL Injection', 'Injection', 'CRITICAL', 'java', 'CWE-917',
     r'(?i)(?:ExpressionParser|SpelExpressionParser).*\.parseExpression\s*\(.*(?:request|param|user|input)'),
    ('JAVA-SEC-004', 'Java Open Redirect', 'OpenRedirect', 'MEDIUM', 'java', 'CWE-601',
     r'''(?i)(?:sendRedirect\s*\(|setHeader\s*\(\s*["']Location["']).*(?:request\.getParameter|request\.getAttribute|param)'''),
    ('JAVA-SEC-005', 'Java Regex DoS', 'RegexDoS', 'MEDIUM', 'java', 'CWE-1333',
     r'(?i)Pattern\.compile\s*\(.*(?:request|param|user|input|args)'),
    ('JAVA-FILE-001', 'Java ZIP Slip', 'PathTraversal', 'HIGH', 'java', 'CWE-22',
     r'(?i)(?:ZipEntry|ZipInputStream|ZipFile).*(?:getName|getEntry)'),
    ('JAVA-LOG-001', 'Java Log Injection', 'Injection', 'MEDIUM', 'java', 'CWE-117',
     r'(?i)(?:logger|log|LOG)\.\w+\s*\(.*(?:request\.getParameter|request\.getHeader|param|user_input)'),
    ('C-MEM-001', 'C Double Free', 'UseAfterFree', 'CRITICAL', 'c cpp', 'CWE-415',
     None),
    ('C-MEM-002', 'C Null Pointer Dereference', 'BufferOverflow', 'HIGH', 'c cpp', 'CWE-476',
     r'(?:malloc|calloc|realloc|strdup)\s*\([^)]*\)\s*;'),
    ('C-BUF-001', 'C Unsafe String Copy', 'BufferOverflow', 'HIGH', 'c cpp', 'CWE-120',
     r'\b(?:strcpy|strcat|sprintf|gets|scanf)\s*\('),
    ('C-RAND-001', 'C Insecure Random (rand/srand)', 'InsecureRandom', 'MEDIUM', 'c cpp', 'CWE-338',
     r'\brand\s*\(\s*\).*(?:key|token|secret|password|nonce|salt|seed|iv)'),
    ('C-SEC-001', 'C Setuid Without Dropping Privileges', 'PrivilegeEscalation', 'HIGH', 'c cpp', 'CWE-250',
     r'set(?:uid|euid|gid|egid)\s*\(\s*0\s*\)'),
    ('C-SEC-002', 'C Unsafe Environment Variable Use', 'CommandInjection', 'HIGH', 'c cpp', 'CWE-78',
     r'(?:system|popen|exec[lvpe]*)\s*\(.*getenv\s*\('),
    ('GO-SEC-001', 'Go Insecure TLS Config', 'InsecureTLS', 'HIGH', 'go', 'CWE-295',
     r'InsecureSkipVerify\s*:\s*true'),
    ('GO-SEC-002', 'Go HTML Template with User Input', 'XSS', 'HIGH', 'go', 'CWE-79',
     r'text/template.*\.Execute'),
    ('GO-SEC-003', 'Go Unhandled Error', 'Misconfiguration', 'LOW', 'go', 'CWE-252',
     r'(?i)(?:db\.Exec|http\.ListenAndServe|bcrypt\.CompareHash|jwt\.Parse)\s*\([^)]*\)\s*$'),
    ('GO-SEC-004', 'Go Race Condition (goroutine)', 'RaceCondition', 'MEDIUM', 'go', 'CWE-362',
     r'go\s+func\s*\(\s*\)\s*\{[^}]*(?:append|delete|map\[|slice)'),
    ('GO-DESER-001', 'Go Insecure Gob/JSON Deserialization', 'InsecureDeserialization', 'LOW', 'go', 'CWE-502',
     r'(?i)(?:gob\.NewDecoder|json\.NewDecoder)\s*\(\s*(?:r\.Body|req\.Body|conn)'),
    ('GO-REDIR-001', 'Go Open Redirect', 'OpenRedirect', 'MEDIUM', 'go', 'CWE-601',
     r'(?i)http\.Redirect\s*\(.*(?:r\.(?:FormValue|URL\.Query)|params|query)'),
    ('PHP-SEC-001', 'PHP session_start without secure flags', 'Misconfiguration', 'MEDIUM', 'php', 'CWE-614',
     r'session_start\s*\(\s*\)'),
    ('PHP-SEC-002', 'PHP extract() on User Input', 'MassAssignment', 'CRITICAL', 'php', 'CWE-915',
     r'extract\s*\(\s*\$_(?:GET|POST|REQUEST|COOKIE)'),
    ('PHP-SEC-003', 'PHP File Upload Vulnerability', 'InsecureFileOps', 'HIGH', 'php', 'CWE-434',
     r'(?i)move_uploaded_file\s*\(.*\$_FILES.*\$_(?:GET|POST|REQUEST)'),
    ('PHP-SEC-004', 'PHP Type Juggling', 'BrokenAuth', 'HIGH', 'php', 'CWE-697',
     r'(?i)(?:password|token|hash|secret|key)\s*==\s*\$'),
    ('PHP-SEC-005', 'PHP Unsafe preg_replace /e', 'Injection', 'CRITICAL', 'php', 'CWE-94',
     r'''preg_replace\s*\(\s*["']/.*?/e["']'''),
    ('PHP-CORS-001', 'PHP CORS Wildcard', 'Misconfiguration', 'MEDIUM', 'php', 'CWE-942',
     r'''(?i)header\s*\(\s*["']Access-Control-Allow-Origin:\s*\*'''),
    ('RB-SEC-001', 'Ruby send() with User Input', 'Injection', 'CRITICAL', 'rb', 'CWE-470',
     r'(?i)\.send\s*\(\s*(?:params|request|user_input)'),
    ('RB-SEC-002', 'Ruby constantize with User Input', 'Injection', 'CRITICAL', 'rb', 'CWE-470',
     r'(?i)(?:constantize|safe_constantize|classify\.constantize).*(?:params|request|user)'),
    ('RB-SEC-003', 'Rails render inline with User Input', 'TemplateInjection', 'CRITICAL', 'rb', 'CWE-1336',
     r'(?i)render\s+inline\s*:.*(?:params|request|user)'),
    ('RB-SEC-004', 'Rails Mass Assignment', 'MassAssignment', 'HIGH', 'rb', 'CWE-915',
     r'(?i)(?:\.create|\.update|\.new)\s*\(\s*params'),
    ('RB-AUTH-001', 'Rails skip_before_action Authentication', 'BrokenAuth', 'HIGH', 'rb', 'CWE-306',
     r'(?i)skip_before_(?:action|filter)\s+:(?:authenticate|require_login|verify_auth)'),
    ('RS-SEC-001', 'Rust unwrap() on User Input', 'Misconfiguration', 'MEDIUM', 'rs', 'CWE-248',
     r'(?i)(?:from_str|parse|to_string|into|try_into)\s*\(\s*\)\s*\.unwrap\(\)'),
    ('RS-SEC-002', 'Rust Transmute Unsafe', 'BufferOverflow', 'HIGH', 'rs', 'CWE-843',
     r'(?:std::mem::)?transmute\s*[:<]'),
    ('RS-SEC-003', 'Rust Raw Pointer Dereference', 'UseAfterFree', 'HIGH', 'rs', 'CWE-119',
     r'\*(?:mut|const)\s+\w+.*(?:as\s+\*(?:mut|const)|\*\w+)'),
    ('CS-SEC-001', 'C# ViewState Tampering', 'Misconfiguration', 'HIGH', 'cs', 'CWE-642',
     r'''(?i)EnableViewStateMac\s*=\s*["']?false'''),
    ('CS-SEC-002', 'C# Request Validation Disabled', 'XSS', 'HIGH', 'cs', 'CWE-79',
     r'''(?i)(?:ValidateInput\s*\(\s*false\)|validateRequest\s*=\s*["']false)'''),
    ('CS-SEC-003', 'C# Hardcoded Connection String', 'HardcodedSecret', 'HIGH', 'cs', 'CWE-798',
     r'''(?i)(?:connectionString|ConnectionString)\s*=\s*["'].*(?:Password|Pwd)\s*=\s*[^;$\{]{4,}'''),
    ('CS-DESER-001', 'C# BinaryFormatter Deserialization', 'InsecureDeserialization', 'CRITICAL', 'cs', 'CWE-502',
     r'(?i)(?:BinaryFormatter|SoapFormatter|LosFormatter|ObjectStateFormatter|NetDataContractSerializer).*Deserialize'),
    ('CS-CRYPTO-001', 'C# Weak Crypto Algorithm', 'WeakCrypto', 'MEDIUM', 'cs', 'CWE-327',
     r'(?i)(?:DESCryptoServiceProvider|RC2CryptoServiceProvider|TripleDESCryptoServiceProvider|MD5CryptoServiceProvider|SHA1CryptoServiceProvider|RijndaelManaged)\.Create'),
    ('MOB-SEC-001', 'iOS ATS Disabled', 'InsecureTLS', 'HIGH', 'swift xml', 'CWE-319',
     r'NSAllowsArbitraryLoads.*true'),
    ('MOB-SEC-002', 'Android WebView JavaScript Enabled', 'Injection', 'HIGH', 'java kt', 'CWE-749',
     r'(?i)(?:setJavaScriptEnabled\s*\(\s*true\)|addJavascriptInterface)'),
    ('MOB-SEC-003', 'Android Exported Component', 'BrokenAuth', 'MEDIUM', 'xml', 'CWE-926',
     r'''(?i)android:exported\s*=\s*["']true["']'''),
    ('MOB-SEC-004', 'iOS Keychain Without Access Control', 'InsecureFileOps', 'MEDIUM', 'swift', 'CWE-922',
     r'(?i)SecItemAdd.*(?:kSecAttrAccessible.*(?:Always|AfterFirstUnlock))'),
    ('MOB-SEC-005', 'Android Debug Flag', 'Misconfiguration', 'HIGH', 'xml', 'CWE-489',
     r'''(?i)android:debuggable\s*=\s*["']true["']'''),
    ('MOB-LOG-002', 'iOS NSLog/print of Auth Token (Visible in Release)', 'InfoDisclosure', 'MEDIUM', 'swift m mm', 'CWE-532',
     r'(?i)(?:NSLog\s*\(|print\s*\(|debugPrint\s*\()[^;)]*(?:public[_.]?token|publicToken|link[_.]?token|linkToken|access[_.]?token|accessToken|api[_.]?key|apiKey)'),
    ('MOB-TOAST-001', 'Android Toast Exposing Auth Token', 'InfoDisclosure', 'MEDIUM', 'kt kts java', 'CWE-532',
     r'(?i)Toast\.makeText\s*\([^)]*(?:public[_.]?token|publicToken|link[_.]?token|linkToken|access[_.]?token|accessToken|secret|apiKey|api[_.]?key)[^)]*\)'),
    ('MOB-WEBVIEW-002', 'Android WebView Universal File Access Enabled', 'InsecureFileOps', 'HIGH', 'kt kts java', 'CWE-200',
     r'(?i)set(?:AllowFileAccessFromFileURLs|AllowUniversalAccessFromFileURLs)\s*\(\s*true\s*\)'),
    ('MOB-INTENT-001', 'Android Intent Data Used Directly (App Links Spoofing Risk)', 'BrokenAuth', 'MEDIUM', 'kt kts java', 'CWE-601',
     r'(?i)(?:intent\??\.data\b|intent\??\.getDataString\(\)|getIntent\(\)\.getData\(\))'),
    ('SH-INJ-001', 'Shell Command Injection via Variable', 'CommandInjection', 'HIGH', 'sh bash zsh', 'CWE-78',
     r'''(?:eval|exec|system|xargs)\s+.*\$\{?\w+\}?(?:[^"']|$)'''),
    ('SH-SEC-001', 'Shell Curl Pipe to Shell', 'CommandInjection', 'HIGH', 'sh bash zsh', 'CWE-829',
     r'(?:curl|wget)\s+.*\|\s*(?:sudo\s+)?(?:bash|sh|zsh)'),
    ('SH-SEC-002', 'Shell World-Writable File Creation', 'InsecureFileOps', 'MEDIUM', 'sh bash zsh', 'CWE-732',
     r'chmod\s+(?:777|666|o\+w)'),
    ('SH-SEC-003', 'Shell Temporary File Predictable Name', 'RaceCondition', 'MEDIUM', 'sh bash zsh', 'CWE-377',
     r'(?:/tmp/\w+|tempfile=\$\w+)'),
]
