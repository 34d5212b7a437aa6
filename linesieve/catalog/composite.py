"""Composite rules: condition trees over a line and its neighbourhood.

Rows are (rule_id, name, severity, cwe, owasp, languages, category,
confidence, condition). The guard of COMP-GO-001 is a numbered or ``?``
placeholder; its published form matches empty text, so the rule could never
fire.
"""

from linesieve.functions.conditions import (
    all_of, any_of, inside, leaf, none_near, not_inside)

# Ids, names, severities, weakness numbers, categories and the
# patterns in the conditions must equal the published rule set.
COMPOSITE_RULES = [
    ('COMP-SQLI-001', 'SQL Injection in Web Handler', 'CRITICAL', 'CWE-89', 'A03:2021',
     'py', 'Injection', 'HIGH',
     all_of(leaf(r'''(?i)(?:execute|cursor\.execute|\.raw)\s*\(\s*(?:f["\']|.*%s|.*\.format)'''),
            inside(r'(?i)(?:def\s+\w+.*request|@app\.route|@bp\.route|@api\.)'),
            none_near(r'(?i)(?:parameterized|placeholder|prepared|\?\s*,)'))),
    ('COMP-SQLI-002', 'SQL Injection in Express Handler', 'CRITICAL', 'CWE-89', 'A03:2021',
     'js ts', 'Injection', 'HIGH',
     all_of(leaf(r'(?i)(?:\.query|\.execute|\.raw)\s*\(.*(?:\+|`\$\{)'),
            inside(r'(?:app|router)\.\s*(?:get|post|put|delete|patch|all)\s*\('),
            none_near(r'(?i)(?:parameterized|placeholder|\?\s*,|\$\d+)'))),
    ('COMP-SQLI-003', 'SQL Injection in Spring Controller', 'CRITICAL', 'CWE-89', 'A03:2021',
     'java kt', 'Injection', 'HIGH',
     all_of(leaf(r'(?i)(?:createQuery|createNativeQuery|nativeQuery|jdbcTemplate\.query)\s*\(.*\+'),
            inside(r'(?i)@(?:GetMapping|PostMapping|RequestMapping|PutMapping|DeleteMapping|Controller|RestController)'))),
    ('COMP-CMDI-001', 'Command Injection in Web Handler', 'CRITICAL', 'CWE-78', 'A03:2021',
     'py', 'CommandInjection', 'HIGH',
     all_of(leaf(r'(?i)(?:os\.system|os\.popen|subprocess\.(?:call|run|Popen|check_output))\s*\(.*(?:request|input|param)'),
            none_near(r'(?i)(?:shlex\.quote|shell=False|subprocess\.run\(\[)'))),
    ('COMP-CMDI-002', 'Command Injection via child_process', 'CRITICAL', 'CWE-78', 'A03:2021',
     'js ts', 'CommandInjection', 'HIGH',
     all_of(leaf(r'(?i)(?:exec|execSync|spawn)\s*\(.*(?:req\.|request\.|params|query|body|\$\{)'),
            none_near(r'''(?i)(?:execFile|spawn\s*\(\s*['"][^'"]+['"]\s*,\s*\[)'''))),
    ('COMP-XSS-001', 'React dangerouslySetInnerHTML', 'HIGH', 'CWE-79', 'A03:2021',
     'jsx tsx js ts', 'XSS', 'HIGH',
     all_of(leaf(r'dangerouslySetInnerHTML'),
            none_near(r'(?i)(?:DOMPurify|sanitize|sanitizeHtml|xss\()'))),
    ('COMP-XSS-002', 'Django mark_safe with user data', 'HIGH', 'CWE-79', 'A03:2021',
     'py', 'XSS', 'HIGH',
     any_of(leaf(r'mark_safe\s*\(.*(?:request|input|param|user|data|form)'),
            leaf(r'render_template_string\s*\(.*(?:request|input|param)'))),
    ('COMP-XSS-003', 'innerHTML Assignment', 'HIGH', 'CWE-79', 'A03:2021',
     'js ts', 'XSS', 'MEDIUM',
     all_of(leaf(r'\.innerHTML\s*='),
            none_near(r'(?i)(?:DOMPurify|sanitize|escape|encode)'))),
    ('COMP-SSRF-001', 'SSRF in Python Web App', 'HIGH', 'CWE-918', 'A10:2021',
     'py', 'SSRF', 'HIGH',
     all_of(leaf(r'(?i)requests\.\w+\s*\(.*(?:request|param|user|input|url|data)'),
            none_near(r'(?i)(?:is_safe_url|validate_url|allowed_hosts|urlparse|ALLOWED_HOSTS|whitelist)'),
            inside(r'(?i)(?:def\s+\w+.*request|@app\.route|@bp\.route)'))),
    ('COMP-DESER-001', 'Python yaml.load without SafeLoader', 'CRITICAL', 'CWE-502', 'A08:2021',
     'py', 'InsecureDeserialization', 'HIGH',
     all_of(leaf(r'yaml\.load\s*\('),
            none_near(r'(?i)(?:SafeLoader|safe_load|yaml\.CSafeLoader)'))),
    ('COMP-DESER-002', 'Java Unsafe Deserialization', 'CRITICAL', 'CWE-502', 'A08:2021',
     'java', 'InsecureDeserialization', 'HIGH',
     all_of(leaf(r'(?i)(?:readObject|readUnshared|ObjectInputStream|XStream\.fromXML|XMLDecoder)'),
            none_near(r'(?i)(?:ObjectInputFilter|SerializationFilter|lookAheadObjectInputStream|ValidatingObjectInputStream)'))),
    ('COMP-DESER-003', 'Node.js Unsafe Deserialization', 'CRITICAL', 'CWE-502', 'A08:2021',
     'js ts', 'InsecureDeserialization', 'HIGH',
     any_of(leaf(r'(?:node-serialize|serialize-javascript|funcster).*(?:unserialize|deserialize)'),
            leaf(r'(?:unserialize|deserialize)\(.*(?:req\.|request\.|body|query|param)'))),
    ('COMP-XXE-001', 'XXE in Java XML Parser', 'HIGH', 'CWE-611', 'A05:2021',
     'java', 'XXE', 'MEDIUM',
     all_of(leaf(r'(?i)(?:DocumentBuilderFactory|SAXParserFactory|XMLInputFactory|SchemaFactory|TransformerFactory)\.new(?:Instance|Factory)?\(\)'),
            none_near(r'(?i)(?:DISALLOW_DOCTYPE_DECL|disallow-doctype-decl|EXTERNAL_GENERAL_ENTITIES|XMLConstants\.ACCESS_EXTERNAL|setExpandEntityReferences\(false\))'))),
    ('COMP-XXE-002', 'XXE in Python XML Parser', 'HIGH', 'CWE-611', 'A05:2021',
     'py', 'XXE', 'MEDIUM',
     all_of(leaf(r'(?i)(?:xml\.etree\.ElementTree|xml\.dom\.minidom|xml\.sax|lxml\.etree)\.(?:parse|fromstring|iterparse)'),
            none_near(r'(?i)(?:defusedxml|resolve_entities\s*=\s*False|no_network|XMLParser\s*\(.*resolve_entities\s*=\s*False)'))),
    ('COMP-PATH-001', 'Path Traversal in File Operations', 'HIGH', 'CWE-22', 'A01:2021',
     'py js ts', 'PathTraversal', 'HIGH',
     all_of(leaf(r'(?i)(?:open|readFile|writeFile|createReadStream|readFileSync)\s*\(.*(?:req\.|request\.|param|user|input|filename)'),
            none_near(r'(?i)(?:realpath|resolve|basename|safe_join|secure_filename|canonicalize|normalize|commonpath|commonprefix|abspath|startswith\s*\(|pathlib\.Path|\.resolve\(\)|os\.path\.)'))),
    ('COMP-AUTH-001', 'Missing Auth Check in API Handler', 'HIGH', 'CWE-306', 'A01:2021',
     'py', 'BrokenAuth', 'MEDIUM',
     all_of(leaf(r'@(?:app|bp)\.route\s*\(\s*.*(?:api|admin|user|account|profile|settings|delete|update|create)'),
            none_near(r'(?i)(?:@login_required|@authenticated|@auth\.|@permission|@require|@jwt_required|@token_required|current_user)'))),
    ('COMP-AUTH-002', 'Missing Auth in Express Route', 'HIGH', 'CWE-306', 'A01:2021',
     'js ts', 'BrokenAuth', 'MEDIUM',
     all_of(leaf(r'''(?:router|app)\.\s*(?:get|post|put|delete|patch)\s*\(\s*['"].*(?:api|admin|user|account|profile|settings|delete|update|create)'''),
            none_near(r'(?i)(?:authenticate|isAuth|requireAuth|ensureAuth|passport\.authenticate|verifyToken|authMiddleware|protect|requireLogin|jwt)'))),
    ('COMP-CRYPTO-001', 'Hardcoded Encryption Key', 'HIGH', 'CWE-321', 'A02:2021',
     'py js ts java cs go', 'WeakCrypto', 'HIGH',
     all_of(leaf(r'(?i)(?:AES|DES|Cipher|encrypt|crypto|CryptoJS|createCipher)'),
            leaf(r'''(?i)(?:key|secret|password|iv)\s*[:=]\s*["'][^"']{4,}["']'''))),
    ('COMP-CRYPTO-002', 'ECB Mode Encryption', 'HIGH', 'CWE-327', 'A02:2021',
     'py java cs go', 'WeakCrypto', 'HIGH',
     any_of(leaf(r'(?i)(?:MODE_ECB|AES/ECB|DES/ECB|CipherMode\.ECB|cipher\.NewECBEncrypter)'),
            leaf(r'''(?i)Cipher\.getInstance\s*\(\s*["'](?:AES|DES|DESede)["']\s*\)'''))),
    ('COMP-CONF-001', 'Debug Mode in Production', 'MEDIUM', 'CWE-489', 'A05:2021',
     'py', 'Misconfiguration', 'HIGH',
     any_of(leaf(r'(?i)(?:DEBUG\s*=\s*True|app\.debug\s*=\s*True|app\.run\(.*debug\s*=\s*True)'),
            leaf(r'(?i)FLASK_DEBUG\s*=\s*1'))),
    ('COMP-CONF-002', 'CORS Allow All Origins', 'MEDIUM', 'CWE-942', 'A05:2021',
     'py js ts java cs', 'Misconfiguration', 'MEDIUM',
     any_of(leaf(r'''(?i)(?:Access-Control-Allow-Origin|allowedOrigins?|origin)\s*[:=]\s*["']\*["']'''),
            leaf(r'(?i)CORS\s*\(\s*\w*\s*\)'))),
    ('COMP-CONF-003', 'Insecure Cookie Configuration', 'MEDIUM', 'CWE-614', 'A05:2021',
     'py js ts java rb php', 'Misconfiguration', 'MEDIUM',
     all_of(leaf(r'(?i)(?:set_cookie|setCookie|addCookie|cookie\s*\(|document\.cookie\s*=|setcookie\s*\()'),
            none_near(r'(?i)(?:httponly|http_only|secure|samesite)'))),
    ('COMP-RACE-001', 'TOCTOU Race Condition', 'MEDIUM', 'CWE-367', 'A04:2021',
     'py c cpp go rs', 'RaceCondition', 'MEDIUM',
     all_of(leaf(r'(?i)(?:os\.path\.exists|os\.access|access\(|stat\(|Path\.exists|fs\.existsSync|fs\.accessSync)'),
            inside(r'(?i)(?:open\(|fopen|File\.open|fs\.readFile|fs\.writeFile)'))),
    ('COMP-PP-001', 'Prototype Pollution via Merge/Extend', 'HIGH', 'CWE-1321', 'A03:2021',
     'js ts', 'PrototypePollution', 'MEDIUM',
     all_of(leaf(r'(?i)(?:merge|extend|deepMerge|assign|defaultsDeep|lodash\.merge|_\.merge)\s*\(.*(?:req\.|request\.|body|query|param|user|input)'),
            none_near(r'(?i)(?:Object\.freeze|Object\.seal|__proto__|constructor|prototype)'))),
    ('COMP-JWT-001', 'JWT None Algorithm Attack', 'CRITICAL', 'CWE-345', 'A02:2021',
     'js ts py', 'BrokenAuth', 'HIGH',
     all_of(leaf(r'(?i)(?:jwt\.verify|jwt\.decode|PyJWT\.decode|jose\.jwt\.decode)'),
            leaf(r'''(?i)(?:algorithms?\s*[:=]\s*\[.*["']none["']|verify\s*[:=]\s*(?:false|False)|options.*verify.*false)'''))),
    ('COMP-REDIR-001', 'Open Redirect', 'MEDIUM', 'CWE-601', 'A01:2021',
     'py js ts java rb php', 'OpenRedirect', 'MEDIUM',
     all_of(leaf(r'''(?i)(?:redirect\(|res\.redirect|sendRedirect|Response\.Redirect|header\s*\(\s*['"]Location).*(?:req\.|request\.|param|query|url|next|return_to|redirect_uri|goto|target)'''),
            none_near(r'(?i)(?:is_safe_url|validate|allowed|whitelist|url_for|starts_with|startsWith)'))),
    ('COMP-MASS-001', 'Mass Assignment / Over-posting', 'HIGH', 'CWE-915', 'A04:2021',
     'rb', 'MassAssignment', 'HIGH',
     all_of(leaf(r'(?i)(?:\.create\(params|\.update\(params|\.new\(params|assign_attributes\(params)'),
            none_near(r'(?i)(?:permit|strong_param|require\(\.\w+\)\.permit)'))),
    ('COMP-LOG-001', 'Log Injection', 'MEDIUM', 'CWE-117', 'A09:2021',
     'java py js ts', 'Injection', 'MEDIUM',
     all_of(leaf(r'(?i)(?:logger|log|LOG)\s*\.(?:info|warn|error|debug)\s*\(.*(?:req\.|request\.|getParameter|params|query|body|user_input)'),
            none_near(r'(?i)(?:sanitize|encode|escape|replace\s*\(.*\\n|replace\s*\(.*\\r)'))),
    ('COMP-RAND-001', 'Insecure Random for Security', 'HIGH', 'CWE-330', 'A02:2021',
     'py js ts java go', 'InsecureRandom', 'HIGH',
     all_of(leaf(r'(?i)(?:random\.(?:randint|choice|random|shuffle)|Math\.random\(\)|java\.util\.Random|rand\.Intn|rand\.Int\(\))'),
            inside(r'(?i)(?:token|password|secret|key|salt|nonce|otp|csrf|session|auth|verify)'))),
    ('COMP-SSTI-001', 'Server-Side Template Injection', 'CRITICAL', 'CWE-1336', 'A03:2021',
     'py java js ts rb', 'TemplateInjection', 'HIGH',
     any_of(leaf(r'(?i)render_template_string\s*\(.*(?:request|input|param|user|data)'),
            leaf(r'(?i)(?:Template|Environment\(|Jinja2)\s*\(.*(?:request|input|param|user|data)'),
            leaf(r'(?i)Velocity\.evaluate\s*\(.*(?:request|param|user)'),
            leaf(r'(?i)ERB\.new\s*\(.*(?:params|request|user)'))),
    ('COMP-IDOR-001', 'Insecure Direct Object Reference', 'HIGH', 'CWE-639', 'A01:2021',
     'py js ts rb', 'IDOR', 'MEDIUM',
     all_of(leaf(r'(?i)(?:find_by_id|findById|\.get\(|\.find\(|WHERE.*id\s*=).*(?:req\.|request\.|params|query)'),
            none_near(r'(?i)(?:current_user|session\.user|auth|owner|belongs_to|authorize|permission|can\?)'))),
    ('COMP-UPLOAD-001', 'Insecure File Upload', 'HIGH', 'CWE-434', 'A04:2021',
     'py js ts java php', 'InsecureFileOps', 'MEDIUM',
     all_of(leaf(r'(?i)(?:\.save\(|upload|multer|formidable|file\.write|move_uploaded_file|transferTo|\.files\[)'),
            none_near(r'(?i)(?:content_type|mimetype|mime_type|extension|allowed_ext|ALLOWED_EXTENSIONS|fileFilter|accept|\.endsWith)'))),
    ('COMP-GQL-001', 'GraphQL Introspection Enabled', 'MEDIUM', 'CWE-200', 'A05:2021',
     'js ts py java', 'InfoDisclosure', 'LOW',
     all_of(leaf(r'(?i)(?:introspection|__schema|schema.*introspection)'),
            none_near(r'(?i)(?:introspection\s*[:=]\s*false|disable.*introspection)'))),
    ('COMP-NOSQL-001', 'NoSQL Injection', 'HIGH', 'CWE-943', 'A03:2021',
     'js ts py', 'Injection', 'MEDIUM',
     all_of(leaf(r'(?i)(?:\.find\(|\.findOne\(|\.aggregate\(|\.updateOne\(|\.deleteOne\().*(?:req\.|request\.|body|query|param)'),
            none_near(r'(?i)(?:sanitize|mongo-sanitize|express-mongo-sanitize|parseInt|ObjectId\()'))),
    ('COMP-REDOS-001', 'ReDoS — Regex Denial of Service', 'MEDIUM', 'CWE-1333', 'A06:2021',
     'js ts py java', 'RegexDoS', 'MEDIUM',
     all_of(leaf(r'(?:new RegExp|re\.compile|Pattern\.compile)\s*\(.*(?:req\.|request\.|param|query|body|user|input)'),
            none_near(r'(?i)(?:re2|safe-regex|timeout|deadline)'))),
    ('COMP-TLS-001', 'TLS Certificate Verification Disabled', 'HIGH', 'CWE-295', 'A07:2021',
     'py js ts java go rb', 'InsecureTLS', 'HIGH',
     any_of(leaf(r'(?i)verify\s*[:=]\s*(?:False|false|0)'),
            leaf(r'(?i)(?:CERT_NONE|rejectUnauthorized\s*:\s*false|InsecureSkipVerify\s*:\s*true|ssl_verify_peer\s*=>\s*false)'),
            leaf(r'''(?i)NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*['"]?0'''))),
    ('COMP-CONF-004', 'Binding to All Interfaces', 'LOW', 'CWE-668', 'A05:2021',
     'py js ts go java rs', 'Misconfiguration', 'LOW',
     all_of(leaf(r'''(?i)(?:host|bind|listen|address)\s*[:=]\s*["']0\.0\.0\.0["']'''),
            not_inside(r'(?i)(?:test|spec|example|demo|development|docker|container)'))),
    ('COMP-PHP-001', 'PHP Code Injection', 'CRITICAL', 'CWE-94', 'A03:2021',
     'php', 'Injection', 'HIGH',
     all_of(leaf(r'(?i)(?:eval|assert|preg_replace.*\/e|create_function|call_user_func|usort)\s*\(.*\$_(?:GET|POST|REQUEST|COOKIE)'),
            none_near(r'(?i)(?:filter_var|filter_input|htmlspecialchars|intval|preg_match)'))),
    ('COMP-PHP-002', 'PHP File Inclusion', 'CRITICAL', 'CWE-98', 'A03:2021',
     'php', 'Injection', 'HIGH',
     all_of(leaf(r'(?i)(?:include|include_once|require|require_once)\s*\(?\s*\$_(?:GET|POST|REQUEST)'),
            none_near(r'(?i)(?:basename|realpath|in_array|whitelist|allowed)'))),
    ('COMP-GO-001', 'Go SQL Injection', 'CRITICAL', 'CWE-89', 'A03:2021',
     'go', 'Injection', 'HIGH',
     all_of(leaf(r'(?i)(?:db\.(?:Query|Exec|QueryRow)|tx\.(?:Query|Exec))\s*\(\s*(?:fmt\.Sprintf|.*\+)'),
            none_near(r'\$[0-9]+|\?'))),
    ('COMP-CS-001', 'C# SQL Injection', 'CRITICAL', 'CWE-89', 'A03:2021',
     'cs', 'Injection', 'HIGH',
     all_of(leaf(r'''(?i)(?:SqlCommand|OleDbCommand|OracleCommand|NpgsqlCommand)\s*\(\s*["'].*\+'''),
            none_near(r'(?i)(?:SqlParameter|Parameters\.Add|AddWithValue|@\w+)'))),
    ('COMP-MOB-001', 'Auth Token Logged via Android Log', 'MEDIUM', 'CWE-532', 'A09:2021',
     'kt java', 'InfoDisclosure', 'HIGH',
     all_of(leaf(r'(?i)Log\s*\.\s*[diwev]\s*\('),
            leaf(r'(?i)(?:public[_.]?token|publicToken|link[_.]?token|linkToken|access[_.]?token|accessToken)'))),
    ('COMP-LOCALSTORAGE-001', 'Auth Token Stored in localStorage', 'MEDIUM', 'CWE-922', 'A02:2021',
     'js ts jsx tsx', 'InsecureStorage', 'HIGH',
     all_of(leaf(r'(?i)localStorage\.setItem\s*\(.*(?:token|secret|key|auth|credential|session|link.?token|access.?token)'),
            none_near(r'(?i)(?:sessionStorage|httpOnly|cookieStore|secure)'))),
    ('COMP-POSTMSG-001', 'postMessage Listener Without Origin Validation', 'MEDIUM', 'CWE-346', 'A01:2021',
     'js ts jsx tsx', 'AuthorizationBypass', 'MEDIUM',
     all_of(leaf(r'''addEventListener\s*\(\s*['"]message['"]\s*,'''),
            none_near(r'(?i)event\.origin'))),
]
