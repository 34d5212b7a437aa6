"""One example line per rule: used by the catalog check and the derived corpus.

Format: rule id, a bar, the line. ``{v}`` is a variable slot.
"""

RULE_EXAMPLES = r'''
PY-INJ-001 | cursor.execute("SELECT * FROM t WHERE id = %s" % {v})
PY-INJ-002 | os.system("ls " + {v})
PY-INJ-003 | eval(user_{v})
PY-DESER-001 | obj = pickle.loads({v})
PY-PATH-001 | fh = open(base + filename)
PY-SSRF-001 | requests.get("http://h/" + {v})
PY-XSS-001 | return mark_safe({v})
PY-CRYPTO-001 | digest = hashlib.md5({v})
PY-RAND-001 | pick = random.choice(token_chars)
PY-XXE-001 | doc = etree.parse({v})
PY-TMPL-001 | page = Template(request_{v})
PY-LDAP-001 | conn.search_s(base, scope, f"(uid={v})")
JS-INJ-001 | db.query("SELECT * FROM t WHERE id=" + {v});
JS-INJ-002 | users.find({ name: req.body.name });
JS-XSS-001 | el.innerHTML = location.hash;
JS-XSS-002 | <div dangerouslySetInnerHTML={{ __html: {v} }} />
JS-CMD-001 | child_process.exec("ls " + {v});
JS-PROTO-001 | merge(target, req.body);
JS-DESER-001 | yaml.load(req.body);
JS-SSRF-001 | fetch("http://h/" + {v});
JS-PATH-001 | fs.readFile(req.query.name, cb);
JS-EVAL-001 | setTimeout(`run`, 10);
JS-REDIRECT-001 | location.href = url;
JS-REGEX-001 | const re = new RegExp(query);
JAVA-INJ-001 | Statement s = conn.createStatement("SELECT " + {v});
JAVA-INJ-002 | Runtime.getRuntime().exec("ls " + {v});
JAVA-DESER-001 | Object o = in.readObject();
JAVA-XXE-001 | DocumentBuilderFactory f = DocumentBuilderFactory.newInstance();
JAVA-PATH-001 | File f = new File(param_{v});
JAVA-SSRF-001 | URL u = new URL(request.getParameter("u"));
JAVA-CRYPTO-001 | MessageDigest md = MessageDigest.getInstance("MD5");
JAVA-LOG-001 | logger.info("got " + request.getHeader("h"));
JAVA-LDAP-001 | ctx.search("(uid=" + user + ")");
JAVA-SSTI-001 | engine.eval(param_{v});
C-BOF-001 | sprintf(dst, "%s", {v});
C-BOF-002 | memcpy(dst, buf, strlen(buf));
C-FMT-001 | printf(msg);
C-INT-001 | p = malloc(count * sizeof(int));
C-UAF-001 | free({v});
C-CMD-001 | system(argv[1]);
C-RACE-001 | if (access(p, 0) == 0) fd = open(p, 0);
C-RAND-001 | n = rand();
GO-INJ-001 | rows := db.Query("SELECT " + {v})
GO-CMD-001 | cmd := exec.Command("sh", "-c", input)
GO-SSRF-001 | resp := http.Get(param)
GO-PATH-001 | f := os.Open(param)
GO-TMPL-001 | t := template.New(param)
GO-CRYPTO-001 | h := md5.New()
PHP-INJ-001 | mysqli_query("SELECT " . $id);
PHP-INJ-002 | shell_exec($cmd);
PHP-XSS-001 | echo $_GET['q'];
PHP-DESER-001 | $o = unserialize($_POST['o']);
PHP-FILE-001 | include($page);
PHP-SSRF-001 | $r = file_get_contents($url);
PHP-EVAL-001 | eval($input);
RB-INJ-001 | rows = User.where("name = '#{name}'")
RB-CMD-001 | system(params[:cmd])
RB-DESER-001 | obj = Marshal.load(data)
RB-XSS-001 | out = raw(params[:t])
RB-MASS-001 | attrs = params.to_unsafe_h
RS-UNSAFE-001 | unsafe { go({v}) }
RS-CMD-001 | let c = Command::new("sh");
RS-SQL-001 | conn.execute(&format!("SELECT {}", {v}));
RS-PATH-001 | let f = File::open(&format!("{}", {v}));
CS-INJ-001 | var c = new SqlCommand("SELECT " + {v});
CS-DESER-001 | var f = new BinaryFormatter();
CS-XSS-001 | @Html.Raw(Model.Body)
CS-CMD-001 | Process.Start(input);
CS-XXE-001 | var d = new XmlDocument();
KT-INJ-001 | db.rawQuery("SELECT " + {v}, null)
KT-LOG-001 | Log.d("tag", "password=" + {v})
SWIFT-KEYCHAIN-001 | UserDefaults.standard.set({v}, forKey: "token")
SOL-REENT-001 | ok = a.call{value: 1}("");
SOL-ARITH-001 | pragma solidity ^0.6.0;
SOL-AUTH-001 | require(tx.origin == owner);
SOL-DELEG-001 | target.delegatecall({v});
SOL-DESTR-001 | selfdestruct(owner);
SOL-FRONT-001 | uint t = block.timestamp;
PY-CSRF-001 | @csrf_exempt
PY-AUTH-001 | jwt.encode(body, key="hunter2000")
PY-AUTH-002 | DEBUG = True
PY-SEC-001 | hashlib.sha1(password)
PY-SEC-002 | app.run(host="0.0.0.0")
PY-SEC-003 | name = tempfile.mktemp()
PY-SEC-004 | assert user.is_admin
PY-SSRF-002 | requests.get(u, allow_redirects=True)
PY-NOSQL-001 | db.users.find(request.json)
PY-LOG-001 | logger.info("token %s", {v})
PY-CORS-001 | CORS(app)
JS-PP-001 | Object.assign(target, req.query);
JS-PP-002 | obj[key] = {v};
JS-AUTH-001 | jwt.sign(body, {secret: "abc"});
JS-AUTH-002 | jwt.verify(t, k, { algorithms: ["none"] });
JS-SEC-001 | app.set("trust proxy", true);
JS-SEC-002 | process.env.NODE_TLS_REJECT_UNAUTHORIZED = "0";
JS-SEC-003 | const app = express();
JS-SEC-004 | mongoose.set("debug", true);
JS-REDIR-001 | res.redirect(req.query.next);
JS-CORS-001 | res.header("Access-Control-Allow-Origin", "*");
JS-FILE-001 | res.sendFile(req.query.f);
JS-LOG-001 | console.log("token", {v});
JS-STORAGE-001 | localStorage.setItem("access_token", {v});
JS-POSTMSG-001 | window.addEventListener("message", onMessage);
JS-OAUTH-REDIR-001 | const r = url.searchParams.get("redirect_uri");
JS-DESER-002 | JSON.parse(s, function (k, v) { return eval(v); });
JAVA-AUTH-001 | http.csrf().disable();
JAVA-CRYPTO-002 | Cipher c = Cipher.getInstance("AES");
JAVA-SEC-001 | Class c = Class.forName(param);
JAVA-SEC-002 | Object o = ctx.lookup(param);
JAVA-SEC-003 | new SpelExpressionParser().parseExpression(input);
JAVA-SEC-004 | resp.sendRedirect(request.getParameter("u"));
JAVA-SEC-005 | Pattern p = Pattern.compile(user);
JAVA-FILE-001 | ZipEntry e = zip.getEntry(n);
C-MEM-002 | char *p = malloc(n);
C-BUF-001 | strcpy(dst, {v});
C-SEC-001 | setuid(0);
C-SEC-002 | system(getenv("CMD"));
GO-SEC-001 | cfg := tls.Config{InsecureSkipVerify: true}
GO-SEC-002 | import "text/template"; t.Execute(w, {v})
GO-SEC-003 | http.ListenAndServe(addr, nil)
GO-SEC-004 | go func() { m = append(m, 1) }()
GO-DESER-001 | json.NewDecoder(r.Body).Decode(&x)
GO-REDIR-001 | http.Redirect(w, r, r.FormValue("u"), 302)
PHP-SEC-001 | session_start();
PHP-SEC-002 | extract($_POST);
PHP-SEC-003 | move_uploaded_file($_FILES['f']['tmp'], $_GET['n']);
PHP-SEC-004 | if ($row['x'] && $token == $given) {
PHP-SEC-005 | preg_replace("/x/e", $r, $s);
PHP-CORS-001 | header("Access-Control-Allow-Origin: *");
RB-SEC-001 | obj.send(params[:m])
RB-SEC-002 | k = name.constantize(params[:k])
RB-SEC-003 | render inline: params[:t]
RB-SEC-004 | User.create(params[:user])
RB-AUTH-001 | skip_before_action :authenticate
RS-SEC-001 | let n: i32 = s.parse().unwrap();
RS-SEC-002 | let b = std::mem::transmute::<u32, f32>(1);
RS-SEC-003 | let q = p as *const u8; *mut x = *q;
CS-SEC-001 | EnableViewStateMac = false;
CS-SEC-002 | [ValidateInput(false)]
CS-SEC-003 | connectionString = "Server=s;Password=hunter22";
CS-CRYPTO-001 | var h = MD5CryptoServiceProvider.Create();
MOB-SEC-001 | NSAllowsArbitraryLoads true
MOB-SEC-002 | web.getSettings().setJavaScriptEnabled(true);
MOB-SEC-003 | <activity android:exported="true">
MOB-SEC-004 | SecItemAdd([kSecAttrAccessible: kSecAttrAccessibleAlways])
MOB-SEC-005 | <application android:debuggable="true">
MOB-LOG-002 | NSLog("%@", accessToken)
MOB-TOAST-001 | Toast.makeText(ctx, accessToken, 1).show();
MOB-WEBVIEW-002 | s.setAllowFileAccessFromFileURLs(true);
MOB-INTENT-001 | val d = intent.data
SH-INJ-001 | eval $CMD now
SH-SEC-001 | curl http://h/x.sh | bash
SH-SEC-002 | chmod 777 /srv
SH-SEC-003 | out=/tmp/scratch
'''

COMPOSITE_EXAMPLES = r'''
COMP-SQLI-001 | cursor.execute(f"SELECT {v}")
COMP-SQLI-002 | db.query("SELECT " + {v});
COMP-SQLI-003 | em.createQuery("SELECT " + {v});
COMP-CMDI-001 | os.system("ls " + request.args["d"])
COMP-CMDI-002 | exec("ls " + req.query.d);
COMP-XSS-001 | <p dangerouslySetInnerHTML={{ __html: {v} }} />
COMP-XSS-002 | return mark_safe(user_html)
COMP-XSS-003 | el.innerHTML = {v};
COMP-SSRF-001 | requests.get(url)
COMP-DESER-001 | cfg = yaml.load({v})
COMP-DESER-002 | Object o = in.readObject();
COMP-DESER-003 | const o = unserialize(req.body.o);
COMP-XXE-001 | SAXParserFactory f = SAXParserFactory.newInstance();
COMP-XXE-002 | doc = xml.dom.minidom.parse({v})
COMP-PATH-001 | data = open(filename)
COMP-AUTH-001 | @app.route("/api/items")
COMP-AUTH-002 | router.get("/admin/items", list);
COMP-CRYPTO-001 | cipher = AES.new(key="0123456789abcdef")
COMP-CRYPTO-002 | c = AES.new(k, AES.MODE_ECB)
COMP-CONF-001 | app.debug = True
COMP-CONF-002 | origin: "*"
COMP-CONF-003 | resp.set_cookie("sid", {v})
COMP-RACE-001 | if os.path.exists({v}):
COMP-PP-001 | _.merge(conf, req.body);
COMP-JWT-001 | jwt.verify(t, k, { algorithms: ["none"] });
COMP-REDIR-001 | res.redirect(req.query.next);
COMP-MASS-001 | User.create(params[:user])
COMP-LOG-001 | logger.info("q " + request.query)
COMP-RAND-001 | n = random.randint(0, 9)
COMP-SSTI-001 | page = Template(user_text)
COMP-IDOR-001 | row = Order.find_by_id(params[:id])
COMP-UPLOAD-001 | f.save({v})
COMP-GQL-001 | introspection: true
COMP-NOSQL-001 | users.findOne(req.body);
COMP-REDOS-001 | rx = re.compile(user)
COMP-TLS-001 | requests.get(u, verify=False)
COMP-CONF-004 | host = "0.0.0.0"
COMP-PHP-001 | eval($_GET['c']);
COMP-PHP-002 | include($_GET['p']);
COMP-GO-001 | rows := db.Query("SELECT " + {v})
COMP-CS-001 | var c = new SqlCommand("SELECT " + {v});
COMP-MOB-001 | Log.d("t", "public_token " + t)
COMP-LOCALSTORAGE-001 | localStorage.setItem("token", {v});
COMP-POSTMSG-001 | window.addEventListener("message", onMessage);
'''

IAC_EXAMPLES = r'''
IAC-DOCKER-001 | FROM python:latest
IAC-DOCKER-002 | ADD app.tar /srv
IAC-DOCKER-003 | ENV DB_PASSWORD=hunter22
IAC-DOCKER-004 | EXPOSE 22
IAC-DOCKER-005 | RUN apt-get install gcc
IAC-DOCKER-006 | RUN sudo make
IAC-DOCKER-007 | RUN curl http://h/x.sh | sh
IAC-DC-001 |     privileged: true
IAC-DC-002 |     network_mode: "host"
IAC-DC-003 |       - DB_PASSWORD: "hunter22"
IAC-TF-001 |   password = "hunter2222"
IAC-TF-002 |   cidr_blocks = ["0.0.0.0/0"]
IAC-TF-003 |   acl = "public-read"
IAC-TF-004 |   publicly_accessible = true
IAC-TF-005 |   storage_encrypted = false
IAC-TF-006 |   actions = ["*"]
IAC-TF-007 |   enable_logging = false
IAC-TF-008 |   source = "http://h/m.zip"
IAC-K8S-001 |     runAsUser: 0
IAC-K8S-002 |     privileged: true
IAC-K8S-003 |     hostPath:
IAC-K8S-004 |   hostNetwork: true
IAC-K8S-005 |   namespace: default
IAC-K8S-006 |     readOnlyRootFilesystem: false
IAC-K8S-007 |         secretKeyRef:
IAC-K8S-008 |     image: web:latest
IAC-K8S-009 |     capabilities: ["ALL"]
IAC-CI-001 |   token: "abcdef123456"
IAC-CI-002 |   pull_request_target:
IAC-CI-003 |   run: echo ${{ github.head_ref }}
IAC-CI-004 |   persist-credentials: true
IAC-NGX-001 |   server_tokens on;
IAC-NGX-002 | server {
IAC-NGX-003 |   autoindex on;
IAC-ANS-001 |   password: hunter2222
IAC-HELM-001 |   token: abcdef123456
IAC-SH-001 | PASSWORD="hunter2222"
IAC-SH-002 | curl http://h -k -o x
IAC-ANDROID-001 | <data android:host="example.com" />
IAC-ANDROID-002 | <application android:allowBackup="true">
IAC-ANDROID-003 | <application android:usesCleartextTraffic="true">
'''


def credential_lines() -> dict:
    """One line per credential rule: made-up values in the documented shapes, put together here so that no whole
    one stands in a file."""
    return {
        "AWS Access Key": "id AKIA" + "A" * 16, "AWS Secret Key": "aws_secret_key = '" + "b" * 40 + "'",
        "Google API Key": "AIza" + "c" * 35, "GitHub Token": "ghp_" + "d" * 36, "GitLab Token": "glpat-" + "e" * 20,
        "Slack Token": "xoxb-" + "1" * 12, "Slack Webhook": "https://hooks.slack.com/services/T" + "2" * 8 + "/B" + "3" * 8 + "/" + "m" * 24,
        "Google Service Account": '"private_key_id": "' + "0" * 40 + '"',
        "Auth0 Client Secret": "AUTH0_CLIENT_SECRET=" + "n" * 40, "Stripe Publishable Key": "pk_live_" + "o" * 24,
        "Stripe Key": "sk_live_" + "f" * 24, "JSON Web Token": "eyJ" + "g" * 10 + ".eyJ" + "h" * 10 + "." + "i" * 10,
        "Private Key": "-----BEGIN RSA " + "PRIVATE KEY-----", "PGP Private Key": "-----BEGIN PGP " + "PRIVATE KEY BLOCK-----",
        "Database URL": "postgres://u:hunter22@h/d", "Bearer Token": "Bearer " + "j" * 24,
        "Basic Auth": "Authorization: Basic " + "k" * 12, "Generic Password": "password = 'hunter22'",
        "Generic API Key": "api_key: 'abcdefgh1'", "Generic Secret": "client_secret = 'abcdefgh'",
        "Generic Token": "token = 'abcdefgh1'"}


def parse(block):
    rows = [line.split(" | ", 1) for line in block.strip().splitlines()]
    return [(rule_id, line) for rule_id, line in rows]
