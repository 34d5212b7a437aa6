"""Taint and flow catalogs: sources, sinks and sanitizers."""

# The patterns, kinds, languages, severities and weakness numbers
# below must equal the published catalogs for equal results.

# (source type, languages, pattern); group 1 is the variable
TAINT_SOURCES = [
    ("user_input", "py",
     r'(?i)(\w+)\s*=\s*(?:request\.(?:args|form|data|json|values|cookies|headers|files)|flask\.request|input\s*\()'),
    ("command_line_arg", "py", r'(?i)(\w+)\s*=\s*sys\.argv'),
    ("user_input", "js ts",
     r'(?i)(?:const|let|var)\s+(\w+)\s*=\s*(?:req\.(?:body|query|params|headers|cookies)|request\.(?:body|query|params))'),
    ("dom_input", "js ts jsx tsx",
     r'(?i)(?:const|let|var)\s+(\w+)\s*=\s*(?:document\.(?:location|URL|referrer|cookie)|window\.location|location\.(?:hash|search|href))'),
    ("environment", "js ts", r'(?i)(?:const|let|var)\s+(\w+)\s*=\s*(?:process\.argv|process\.env)'),
    ("user_input", "java kt",
     r'(?i)(?:String|Object|var)\s+(\w+)\s*=\s*(?:request\.getParameter|request\.getHeader|request\.getCookies|request\.getInputStream|request\.getReader)'),
    ("user_input", "php", r'(?i)(\$\w+)\s*=\s*\$_(?:GET|POST|REQUEST|COOKIE|SERVER|FILES)\['),
    ("user_input", "go", r'(?i)(\w+)\s*(?::=|=)\s*r\.(?:FormValue|URL\.Query|Body|Header\.Get|PostFormValue|Cookie)\('),
    ("user_input", "rb", r'(?i)(\w+)\s*=\s*params\['),
    ("user_input", "c cpp h hpp", r'(?i)(?:fgets|scanf|fscanf|gets|read|recv|recvfrom)\s*\(\s*(\w+)'),
]

# (sink type, languages, severity, pattern)
TAINT_SINKS = [
    ("sql_execution", "py js ts java rb php go kt", "CRITICAL",
     r'(?i)(?:execute|query|cursor\.execute|\.raw|db\.query|\.exec|rawQuery)\s*\('),
    ("command_execution", "py js ts java rb php go c cpp cs kt", "CRITICAL",
     r'(?i)(?:os\.system|subprocess|exec|system|popen|child_process|Process\.Start|Runtime\.exec|exec\.Command)\s*\('),
    ("file_operation", "py js ts java rb php go c cpp rs", "HIGH",
     r'(?i)(?:open|fopen|File\.open|fs\.readFile|fs\.writeFile|FileInputStream|FileOutputStream|File::open)\s*\('),
    ("network_request", "py js ts java rb php go", "HIGH",
     r'(?i)(?:requests\.get|urllib|fetch|axios|http\.Get|HttpClient|curl_exec|Net::HTTP)\s*\('),
    ("code_execution", "py js ts rb php", "CRITICAL",
     r'(?i)(?:eval|exec|compile|Function|setTimeout|setInterval|assert)\s*\('),
    ("deserialization", "py js ts java rb php", "CRITICAL",
     r'(?i)(?:pickle\.loads?|yaml\.load|unserialize|readObject|Marshal\.load|JSON\.parse)\s*\('),
    ("html_output", "js ts jsx tsx py rb cs", "HIGH",
     r'(?i)(?:innerHTML|outerHTML|document\.write|\.html_safe|mark_safe|@Html\.Raw|render_template_string|dangerouslySetInnerHTML)\b'),
    ("ldap_query", "py java", "HIGH", r'(?i)(?:ldap\.search|search_s|DirContext\.search)\s*\('),
]

# (category, protected kinds, languages, pattern). The published set has a
# csrf_protection entry whose word list holds the decorator that turns the
# protection off and that no sink kind asks for; it is left out.
SANITIZERS = [
    ("xss_sanitizer", "XSS xss html_output", "js ts py rb php cs java",
     r'(?i)(?:DOMPurify\.sanitize|sanitizeHtml|xss\(|escapeHtml|htmlspecialchars|html\.escape|cgi\.escape|ERB::Util\.html_escape|CGI\.escapeHTML|bleach\.clean|Markup\.escape|HtmlEncoder\.Default)'),
    ("sql_sanitizer", "Injection sql_execution", "py js ts java rb php go cs",
     r'(?i)(?:PreparedStatement|parameterized|placeholder|\?\s*,|%s.*bind|prepare\(|\.prepare|real_escape_string|quote\(|pg_escape|Arel\.sql|ActiveRecord::Base\.sanitize|SqlParameter)'),
    ("cmd_sanitizer", "CommandInjection command_execution", "py js ts java rb php rs",
     r'(?i)(?:shlex\.quote|shellescape|escapeshellarg|escapeshellcmd|ProcessBuilder\(\)|execFile\(|\.arg\()'),
    ("path_sanitizer", "PathTraversal file_operation", "py js ts go rs java cs rb",
     r'(?i)(?:os\.path\.basename|os\.path\.realpath|filepath\.Clean|filepath\.Base|Path\.GetFileName|secure_filename|safe_join|\.canonicalize\(\)|\.normalize\(\))'),
    ("url_validator", "SSRF OpenRedirect ssrf open_redirect", "py js ts java go rb cs",
     r'(?i)(?:is_safe_url|validate_url|url\.Parse|urlparse|new URL\(|URL\.canParse|allowed_hosts|ALLOWED_HOSTS|url_has_allowed_host|is_valid_url)'),
    ("xxe_prevention", "XXE xxe", "py java cs c cpp",
     r'(?i)(?:DISALLOW_DOCTYPE_DECL|defusedxml|setFeature.*disallow|DtdProcessing\.Prohibit|XMLConstants\.FEATURE_SECURE_PROCESSING|setExpandEntityReferences\(false\)|resolve_entities\s*=\s*False)'),
    ("deser_sanitizer", "InsecureDeserialization deserialization", "py js ts java rb php cs",
     r'(?i)(?:safe_load|SafeLoader|JSON\.parse|json_decode|allowed_classes|ObjectInputFilter|SerializationBinder|TypeNameHandling\.None|System\.Text\.Json)'),
    ("auth_check", "BrokenAuth IDOR PrivilegeEscalation", "py js ts java rb cs php go",
     r'(?i)(?:@login_required|@authenticated|@authorize|RequireAuth|isAuthenticated|session\.user|currentUser|auth\.check|protect\(\)|ensureAuth)'),
    ("rate_limit", "BruteForce DoS", "py js ts java rb go",
     r'(?i)(?:rateLimit|rate_limit|throttle|@throttle|RateLimiter|slowDown|express-rate-limit|django-ratelimit)'),
    ("log_sanitizer", "LogInjection log_injection", "py js ts java go rb cs",
     r'''(?i)(?:log\.escape|strip_ansi|sanitize_log|replace\s*\(\s*["']\\n|replace\s*\(\s*["']\\r)'''),
    ("regex_dos_prevention", "RegexDoS", "py js ts java go rs rb",
     r'(?i)(?:re2|google/re2|regex_timeout|re\.compile.*timeout|PCRE2_MATCH_LIMIT|SafeRegex|anchored_regex)'),
    ("file_type_validation", "FileUpload file_operation", "py js ts java rb php go cs",
     r'(?i)(?:content.?type\s*[!=]=|mime.?type|file.?type|magic\.from_buffer|python-magic|file-type|allowed_extensions|ALLOWED_EXTENSIONS|accept=)'),
    ("boundary_validation", "IntegerOverflow BufferOverflow", "py js ts java go rs cs c cpp rb",
     r'(?i)(?:max_length|min_length|maxlength|minlength|MaxValue|MinValue|Range\(|between\(|clamp\(|bounded|limit|MAX_SIZE|validate_range)'),
]

# (source type, languages, pattern); group 1 is the variable
FLOW_SOURCES = [
    ("http_input", "py",
     r'(\w+)\s*=\s*(?:request\.(?:args|form|data|json|values|cookies|headers|files|get_json|method)|flask\.request|input\s*\()'),
    ("cli_arg", "py", r'(\w+)\s*=\s*sys\.argv'),
    ("env_var", "py", r'(\w+)\s*=\s*os\.environ\.get\('),
    ("deserialized_data", "py", r'(\w+)\s*=\s*(?:json\.loads?|yaml\.safe_load|xmltodict\.parse)\s*\('),
    ("http_input", "js ts jsx tsx",
     r'(?:const|let|var)\s+(\w+)\s*=\s*(?:req\.(?:body|query|params|headers|cookies|ip|hostname|path)|request\.(?:body|query|params))'),
    ("dom_input", "js ts jsx tsx",
     r'(?:const|let|var)\s+(\w+)\s*=\s*(?:document\.(?:location|URL|referrer|cookie|getElementById|querySelector)|window\.location|location\.(?:hash|search|href|pathname))'),
    ("env_var", "js ts", r'(?:const|let|var)\s+(\w+)\s*=\s*(?:process\.argv|process\.env)'),
    ("parsed_input", "js ts", r'(?:const|let|var)\s+(\w+)\s*=\s*(?:JSON\.parse|new URLSearchParams|FormData|FileReader)'),
    ("route_param", "js ts jsx tsx",
     r'(?:const|let|var)\s+\{?\s*(\w+).*\}?\s*=\s*(?:useParams|useSearchParams|useLocation|useRouter)'),
    ("http_input", "java kt",
     r'(?:String|Object|var|int|long|boolean)\s+(\w+)\s*=\s*(?:request\.getParameter|request\.getHeader|request\.getCookies?|request\.getInputStream|request\.getReader|request\.getAttribute|request\.getPathInfo|request\.getQueryString|request\.getRemoteAddr)'),
    ("spring_input", "java kt", r'@(?:RequestParam|PathVariable|RequestBody|RequestHeader|CookieValue)\s*.*?(\w+)'),
    ("env_var", "java", r'(?:String|Object|var)\s+(\w+)\s*=\s*System\.getenv\('),
    ("http_input", "php", r'(\$\w+)\s*=\s*\$_(?:GET|POST|REQUEST|COOKIE|SERVER|FILES|ENV)\['),
    ("raw_input", "php", r'''(\$\w+)\s*=\s*(?:file_get_contents\s*\(\s*['"]php://input|getenv\s*\()'''),
    ("http_input", "go",
     r'(\w+)\s*(?::=|=)\s*(?:r\.(?:FormValue|URL\.Query|Body|Header\.Get|PostFormValue|Cookie|PathValue|Context)|c\.(?:Param|Query|PostForm|FormFile|Request))\('),
    ("env_arg_local", "go", r'(\w+)\s*(?::=|=)\s*os\.(?:Getenv|Args)'),
    ("http_input", "rb", r'(\w+)\s*=\s*(?:params\[|request\.(?:body|env|headers|cookies|referer))'),
    ("io_input", "c cpp h hpp", r'(?:fgets|scanf|fscanf|gets|read|recv|recvfrom|getline)\s*\(\s*(\w+)'),
    ("env_arg", "c cpp", r'(\w+)\s*=\s*(?:getenv|argv)\[?'),
    ("http_input", "cs",
     r'(?:string|var|object)\s+(\w+)\s*=\s*(?:Request\.(?:Query|Form|Headers|Cookies|Body)|HttpContext\.Request|context\.Request)'),
    ("input", "rs",
     r'(?:let|let\s+mut)\s+(\w+)\s*(?::\s*\w+)?\s*=\s*(?:std::env::args|std::env::var|req\.|request\.)'),
]

# (sink type, languages, severity, cwe, pattern)
FLOW_SINKS = [
    ("sql_execution", "py js ts java rb php go kt cs rs", "CRITICAL", "CWE-89",
     r'(?i)(?:execute|cursor\.execute|\.query|\.exec|rawQuery|db\.(?:Query|Exec|QueryRow)|\.raw\(|find_by_sql|createQuery|createNativeQuery|\.prepare)\s*\('),
    ("command_execution", "py js ts java rb php go c cpp cs rs", "CRITICAL", "CWE-78",
     r'(?i)(?:os\.system|subprocess\.(?:call|run|Popen|check_output)|child_process\.exec|execSync|spawn\(|system\(|popen\(|exec\(|Process\.Start|Runtime\.getRuntime|exec\.Command|Command::new)'),
    ("file_operation", "py js ts java rb php go c cpp rs", "HIGH", "CWE-22",
     r'(?i)(?:open\(|fopen|File\.open|fs\.(?:readFile|writeFile|unlink|createReadStream|createWriteStream|access)|FileInputStream|FileOutputStream|File::(?:open|create)|os\.(?:Open|Create|ReadFile)|ioutil\.ReadFile)'),
    ("ssrf", "py js ts java rb php go cs", "HIGH", "CWE-918",
     r'(?i)(?:requests\.(?:get|post|put|delete|patch)|urllib\.request\.urlopen|fetch\(|axios\.|got\(|http\.(?:Get|Post|NewRequest)|HttpClient|curl_exec|Net::HTTP|WebClient|RestTemplate)'),
    ("code_execution", "py js ts rb php", "CRITICAL", "CWE-94",
     r'(?i)(?:eval\(|exec\(|compile\(|Function\(|setTimeout\s*\(|setInterval\s*\(|assert\(|preg_replace.*\/e|render_template_string)'),
    ("deserialization", "py js ts java rb php cs", "CRITICAL", "CWE-502",
     r'(?i)(?:pickle\.loads?|yaml\.(?:load|unsafe_load)|unserialize|readObject|Marshal\.load|ObjectInputStream|BinaryFormatter|XStream\.fromXML|node-serialize)'),
    ("xss", "js ts jsx tsx py rb cs", "HIGH", "CWE-79",
     r'(?i)(?:innerHTML|outerHTML|document\.write|\.html_safe|mark_safe|@Html\.Raw|dangerouslySetInnerHTML|render_template_string|Response\.Write)'),
    ("ldap_query", "py java php", "HIGH", "CWE-90",
     r'(?i)(?:ldap\.search|search_s|DirContext\.search|ldap_search)'),
    ("open_redirect", "py js ts java rb php cs", "MEDIUM", "CWE-601",
     r'(?i)(?:redirect\(|res\.redirect|sendRedirect|Response\.Redirect|location\.href\s*=|window\.location\s*=)'),
    ("template_injection", "py java js ts rb", "CRITICAL", "CWE-1336",
     r'(?i)(?:render_template_string|Template\(|Environment.*from_string|Velocity\.evaluate|engine\.eval|FreeMarker)'),
    ("xxe", "py java cs c cpp", "HIGH", "CWE-611",
     r'(?i)(?:etree\.(?:parse|fromstring)|minidom\.parse|DocumentBuilderFactory|SAXParserFactory|XMLInputFactory|XmlDocument|XDocument\.Load|xml\.sax\.parse)'),
    ("log_injection", "java py js ts go rb cs", "MEDIUM", "CWE-117",
     r'(?i)(?:logger|log|LOG)\s*\.(?:info|warn|error|debug|trace|fatal|log)\s*\('),
]

# (kind, languages, pattern)
FLOW_SANITIZERS = [
    ("generic_sanitizer", "py js ts java rb php go c cpp cs rs",
     r'(?i)(?:parameterized|prepared|PreparedStatement|placeholder|bind_param|sanitize|escape|encode|validate|clean|filter|purify|DOMPurify|bleach|htmlspecialchars|htmlentities|html\.escape|cgi\.escape|quote_identifier|paramstyle|shellescape|escapeshellarg|escapeshellcmd|shlex\.quote|Regex\.Escape|SecurityElement\.Escape)'),
    ("input_validation", "py js ts java rb php go cs rs",
     r'(?i)(?:parseInt|parseFloat|Number\(|int\(|float\(|bool\(|Integer\.parseInt|\.trim\(\)|strip\(\)|\.replace\(|whitelist|allowlist|isValid|validate|Validator\.|\.test\()'),
    ("path_sanitizer", "py js ts java go cs rs rb php",
     r'(?i)(?:realpath|canonicalize|normalize|abspath|os\.path\.basename|filepath\.Clean|filepath\.Base|Path\.GetFileName|path\.resolve|safe_join|secure_filename)'),
    ("url_validator", "py js ts java go rb",
     r'(?i)(?:url\.Parse|URL\(|new URL|urlparse|is_safe_url|validate_url|url_for|URI\.parse)'),
    ("encoding", "py js ts rb cs java",
     r'(?i)(?:encodeURI|encodeURIComponent|urllib\.parse\.quote|html\.escape|cgi\.escape|ERB::Util\.html_escape|CGI\.escapeHTML|HtmlEncoder|JavaScriptEncoder|UrlEncoder)'),
]
VALIDATE_CALL = (r'(?i)(?:validate|check|verify|ensure|assert|is_valid|sanitize|clean|filter|normalize|escape|encode'
                 r'|whitelist|allowlist|safeguard|guard)_?\w*\s*\(')
DECLARATION = r'(?:const|let|var|int|String|string|auto|val|var)\s+(\w+)\s*=\s*(.+)'
ASSIGNMENT = r'(\w+)\s*=\s*(.+)'
LOCAL_SOURCE_TYPES = ("env_arg_local", "env_var", "cli_arg", "env_arg")

# Right-hand sides that are constants, tested on the trimmed line.
LITERAL_SIDES = [
    r'''=\s*["'][^"']*["']\s*$''',
    r'=\s*\d+\.?\d*\s*$',
    r'=\s*\[.*\]\s*$',
    r'=\s*\{.*\}\s*$',
    r'=\s*(?:True|False|None)\s*$',
    r'''=\s*b["'][^"']*["']\s*$''',
]
DICT_VIEWS = [".keys()", ".values()", ".items()"]
SHELL_OFF = ["shell=false", "shell = false"]
LIST_CALLS = ["subprocess.run([", "subprocess.popen([", "subprocess.call([", "subprocess.check_output(["]
PARAM_DECORATORS = ["@pytest.mark.parametrize", "@parametrize"]
FIXTURE_DECORATORS = PARAM_DECORATORS + ["@pytest.fixture"]

# Scope patterns: function header per language, then the shared ones. The
# script-language header gets its missing closing parenthesis, and the C header
# is written without a repeated group (same language and same name).
FUNCTION_HEADERS = {
    "py": r'^\s*(?:async\s+)?def\s+(\w+)',
    "js ts jsx tsx": r'(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:function|\())',
    "java kt cs": r'(?:public|private|protected|static|void|int|String|async)\s+\w*\s*(\w+)\s*\(',
    "go": r'func\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)',
    "rb": r'def\s+(\w+)',
    "php": r'(?:function|public\s+function|private\s+function)\s+(\w+)',
    "rs": r'(?:pub\s+)?(?:async\s+)?fn\s+(\w+)',
    "c cpp h hpp": r"\w\s+(\w+)\s*\([^)]*\)\s*\{",
}
FUNCTION_HEADER_ELSE = r'(?:function|def|fn|func)\s+(\w+)'
CLASS_HEADER = r'(?i)(?:class|struct|interface|enum)\s+(\w+)'
LOOP_HEADER = r'(?i)^\s*(?:for|while|loop|do)\b'
TRY_HEADER = r'(?i)^\s*(?:try|catch|except|rescue|begin)\b'
TEST_MARK = r'(?i)(?:test_|_test|spec_|_spec|Test\b|describe\(|it\(|@Test|#\[test\]|func Test)'
