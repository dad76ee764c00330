"""Patterns of risky code lines."""

#: Rule id, severity, weakness id, languages, pattern (RE2 dialect; see dialect.py).
CODE_RULES = [
    ("js-eval", "HIGH", "CWE-95", "js", r"\beval\s*\("),
    ("js-new-function", "HIGH", "CWE-95", "js", r"\bnew\s+Function\s*\("),
    ("py-eval-exec", "HIGH", "CWE-95", "py", r"\b(?:eval|exec)\s*\("),
    ("ruby-eval", "HIGH", "CWE-95", "ruby", r"\b(?:eval|instance_eval|class_eval)\s*[\s(]"),
    ("php-eval", "HIGH", "CWE-95", "php", r"\beval\s*\("),
    ("py-os-command", "HIGH", "CWE-78", "py", r"\bos\.system\s*\(|\bos\.popen\s*\(|subprocess\.[A-Za-z_]+\([^)]*shell\s*=\s*True"),
    ("js-child-process", "HIGH", "CWE-78", "js", r"""child_process\.exec(?:Sync)?\s*\(|\bexec(?:Sync)?\s*\(\s*['"\x60]"""),
    ("ruby-command", "HIGH", "CWE-78", "ruby", r"\bsystem\s*\(|`[^`]*#\{|%x\(|Open3\."),
    ("php-command", "HIGH", "CWE-78", "php", r"\b(?:shell_exec|passthru|proc_open|popen)\s*\(|\b(?:system|exec)\s*\("),
    ("go-shell", "HIGH", "CWE-78", "go", r'exec\.Command\s*\(\s*"(?:sh|bash)"\s*,\s*"-c"'),
    ("py-pickle", "HIGH", "CWE-502", "py", r"\bpickle\.loads?\s*\(|\byaml\.load(?:_all)?\s*\("),
    ("ruby-marshal", "HIGH", "CWE-502", "ruby", r"Marshal\.load\s*\(|YAML\.load\s*\("),
    ("php-unserialize", "HIGH", "CWE-502", "php", r"\bunserialize\s*\("),
    ("tls-disabled", "MEDIUM", "CWE-295", "py js go", r"verify\s*=\s*False|rejectUnauthorized\s*:\s*false|InsecureSkipVerify\s*:\s*true"),
    ("js-xss-sink", "MEDIUM", "CWE-79", "js", r"dangerouslySetInnerHTML|\.innerHTML\s*=|\.outerHTML\s*=|document\.write\s*\("),
    ("php-echo-input", "HIGH", "CWE-79", "php", r"echo\s+\$_(?:GET|POST|REQUEST|COOKIE)"),
    ("py-sql-fstring", "MEDIUM", "CWE-89", "py", r"""(?:execute|executemany)\s*\(\s*f['"]"""),
    ("ruby-sql-interp", "MEDIUM", "CWE-89", "ruby", r"""\.(?:where|find_by_sql|execute)\s*\(\s*["'][^"']*#\{"""),
    ("php-sql-var", "MEDIUM", "CWE-89", "php", r"""(?:mysqli_query|->query|->exec)\s*\(\s*["'][^"']*\$"""),
    ("js-sql-concat", "MEDIUM", "CWE-89", "js", r"""(?:\.query|\.execute|\.raw|sequelize\.query)\s*\(\s*(?:['"][^'"]*['"]\s*\+|`[^`]*\$\{)"""),
    ("py-path-traversal", "MEDIUM", "CWE-22", "py", r"\b(?:open|send_file)\s*\([^)]*(?:request\.|\+)|os\.path\.join\s*\([^)]*request\."),
    ("js-path-traversal", "MEDIUM", "CWE-22", "js", r"(?:readFile|readFileSync|sendFile|createReadStream)\s*\([^)]*(?:req\.|\+\s*[A-Za-z_])"),
    ("php-path-traversal", "HIGH", "CWE-22", "php", r"\b(?:include|require|include_once|require_once|fopen|file_get_contents)\s*\(?\s*\$_(?:GET|POST|REQUEST)"),
    ("py-ssrf", "MEDIUM", "CWE-918", "py", r"""requests\.(?:get|post|put|delete|head)\s*\(\s*(?:[A-Za-z_]\w*\s*\+|f['"]|request\.)|urllib\.request\.urlopen\s*\("""),
    ("js-ssrf", "MEDIUM", "CWE-918", "js", r"(?:axios|fetch|http\.get|https\.get|request)\s*\(\s*(?:req\.|[A-Za-z_]\w*\s*\+|`[^`]*\$\{)"),
    ("weak-hash", "MEDIUM", "CWE-328", "py js go php ruby", r"""(?i)(?:hashlib\.(?:md5|sha1)|createHash\s*\(\s*['"](?:md5|sha1)|MessageDigest\.getInstance\s*\(\s*"(?:MD5|SHA-?1)|md5\s*\(|Digest::(?:MD5|SHA1))"""),
    ("insecure-random", "MEDIUM", "CWE-338", "py js go", r"Math\.random\s*\(\)|random\.random\s*\(\)|math[/]rand"),
    ("py-xxe", "MEDIUM", "CWE-611", "py", r"etree\.(?:parse|fromstring)\s*\(|xml\.dom\.minidom\.parse|xml\.sax\."),
    ("php-xxe", "MEDIUM", "CWE-611", "php", r"LIBXML_NOENT|simplexml_load_(?:string|file)\s*\("),
    ("py-ssti", "HIGH", "CWE-1336", "py", r"""(?:render_template_string|Template)\s*\(\s*(?:[A-Za-z_]\w*\s*\+|f['"]|request\.)"""),
    ("open-redirect", "MEDIUM", "CWE-601", "py js php", r"redirect\s*\(\s*(?:request\.|req\.|\$_(?:GET|POST|REQUEST))|res\.redirect\s*\(\s*req\."),
    ("nosql-where", "MEDIUM", "CWE-943", "js py", r"\$where\s*[:=]|\.find\s*\(\s*(?:req\.body|req\.query|request\.)"),
    ("jwt-none-alg", "HIGH", "CWE-347", "js py", r"""(?i)algorithms?\s*[:=]\s*\[?\s*['"]none['"]|['"]alg['"]\s*:\s*['"]none['"]"""),
    ("jwt-decode-no-verify", "HIGH", "CWE-347", "js py", r"jwt\.decode\s*\([^)]*verify\s*[:=]\s*(?:False|false)|jwt\.decode\s*\(\s*[^,)]+\)\s*$"),
    ("cookie-insecure", "MEDIUM", "CWE-614", "js py php", r"(?i)httponly\s*[:=]\s*(?:false|0)|secure\s*[:=]\s*false|session\.cookie_httponly\s*=\s*0"),
    ("hardcoded-crypto-key", "HIGH", "CWE-321", "js py go php ruby", r"""(?i)(?:secret|encryption|aes|hmac|signing|jwt)_?key\s*[:=]\s*['"][A-Za-z0-9+/=_\-]{8,}['"]|\bIV\s*[:=]\s*['"][A-Za-z0-9+/=]{8,}['"]"""),
    ("csrf-disabled", "MEDIUM", "CWE-352", "py php ruby", r"(?i)@csrf_exempt|csrf\s*[:=]\s*(?:False|false)|WTF_CSRF_ENABLED\s*=\s*False|skip_before_action\s+:verify_authenticity_token"),
    ("world-writable", "MEDIUM", "CWE-732", "py go ruby", r"chmod\s*\([^)]*0o?777|os\.chmod\([^)]*0o?666|FileMode\s*\(\s*0o?777"),
    ("ldap-injection", "MEDIUM", "CWE-90", "py js php go", r"""(?i)(?:search_s|searchfilter|ldap_search|\.search)\s*\([^)]*(?:\+\s*[A-Za-z_$]|request\.|req\.|\$_(?:GET|POST)|f['"]|#\{)"""),
    ("xpath-injection", "MEDIUM", "CWE-643", "py js php ruby go", r"""(?i)(?:xpath|\.evaluate|selectSingleNode|selectNodes|\.compile)\s*\([^)]*(?:\+\s*[A-Za-z_$]|request\.|req\.|\$_(?:GET|POST)|f['"]|#\{)"""),
    ("proto-pollution", "HIGH", "CWE-1321", "js", r"(?:Object\.assign|_\.merge|_\.mergeWith|_\.defaultsDeep|extend)\s*\([^)]*req\.(?:body|query|params)|\[[^\]]*req\.(?:body|query|params)[^\]]*\]\s*="),
    ("mass-assignment", "MEDIUM", "CWE-915", "js py ruby", r"(?i)\.(?:create|update|bulkcreate|insertmany)\s*\(\s*req\.(?:body|query)|new\s+\w+\s*\(\s*req\.body|update_attributes\s*\(\s*params\b|\.new\s*\(\s*params\s*\)|objects\.create\s*\(\s*\*\*request"),
    ("regex-from-input", "MEDIUM", "CWE-1333", "js py", r"new RegExp\s*\(\s*(?:req\.|request\.|[A-Za-z_]\w*\s*[,)])|re\.compile\s*\([^)]*(?:request\.|req\.|\+\s*[A-Za-z_])"),
    ("js-vm-run", "HIGH", "CWE-95", "js", r"vm\.(?:runInThisContext|runInNewContext|runInContext|compileFunction)\s*\(|new\s+vm\.Script\s*\("),
    ("js-child-spawn-shell", "HIGH", "CWE-78", "js", r"(?:spawn|execFile)\s*\([^)]*shell\s*:\s*true"),
    ("js-settimeout-string", "HIGH", "CWE-95", "js", r"""set(?:Timeout|Interval)\s*\(\s*['"`]"""),
    ("js-require-dynamic", "MEDIUM", "CWE-95", "js", r"\brequire\s*\([^)]*(?:req\.|request\.|\+\s*[A-Za-z_])|import\s*\([^)]*(?:req\.|`[^`]*\$\{)"),
    ("js-jwt-hardcoded-secret", "HIGH", "CWE-321", "js", r"""jwt\.sign\s*\([^)]*,\s*['"][^'"]{4,}['"]"""),
    ("oauth-redirect-uri", "HIGH", "CWE-601", "js py php", r"(?i)redirect\s*\(\s*[^)]*(?:redirect_uri|returnurl|return_to|next|callback)\b|res\.redirect\s*\(\s*req\.(?:query|body)\.(?:redirect_uri|return|next|url)"),
    ("ssrf-internal-fetch", "HIGH", "CWE-918", "js py go", r"(?i)(?:axios|fetch|requests\.(?:get|post)|http\.Get|urlopen|HttpClient|got)\s*\([^)]{0,120}(?:169\.254\.169\.254|/latest/meta-data|metadata\.google|127\.0\.0\.1|localhost|\.internal\b)"),
    ("jwt-alg-confusion", "HIGH", "CWE-347", "js py", r"(?i)algorithms?\s*[:=]\s*\[[^\]]*(?:HS256[^\]]*RS256|RS256[^\]]*HS256)"),
    ("graphql-no-limits", "MEDIUM", "CWE-770", "js py", r"(?i)(?:ApolloServer|GraphQLSchema|makeExecutableSchema|graphql_sync)\s*\("),
    ("js-spread-req-body", "MEDIUM", "CWE-915", "js", r"\{\s*\.\.\.\s*req\.body\s*\}|Object\.assign\s*\(\s*\w+\s*,\s*req\.body\s*\)"),
    ("cors-wildcard-credentials", "HIGH", "CWE-942", "js py", r"""(?i)cors\s*\(\s*\{[^}]*origin\s*:\s*(?:true|['"]\*['"])[^}]*credentials\s*:\s*true|Access-Control-Allow-Origin['"]\s*,\s*['"]\*['"][^)]*Access-Control-Allow-Credentials|origin\s*:\s*req\.headers\.origin"""),
    ("dom-xss", "HIGH", "CWE-79", "js", r"(?:innerHTML|outerHTML|document\.write|insertAdjacentHTML|\.html\s*\()\s*[^;]*(?:location\.(?:hash|search|href)|document\.URL|window\.name|document\.referrer)"),
    ("postmessage-no-origin", "MEDIUM", "CWE-346", "js", r"""addEventListener\s*\(\s*['"]message['"]"""),
    ("token-in-localstorage", "MEDIUM", "CWE-922", "js", r"""localStorage\.setItem\s*\(\s*['"][^'"]*(?i:token|jwt|secret|password|apikey|auth)"""),
    ("host-header-trust", "MEDIUM", "CWE-644", "js py php", r"""req\.(?:headers\.host|hostname)|request\.(?:host|get_host\(\))|\$_SERVER\[['"]HTTP_HOST"""),
    ("frontend-secret", "HIGH", "CWE-200", "js", r"(?:REACT_APP_|NEXT_PUBLIC_|VUE_APP_|VITE_|GATSBY_)[A-Za-z0-9_]*(?:SECRET|TOKEN|PASSWORD|PRIVATE|APIKEY|API_KEY)"),
    ("graphql-introspection", "MEDIUM", "CWE-200", "js py", r"(?i)introspection\s*:\s*true|graphiql\s*:\s*true|GraphQLView\.as_view\([^)]*graphiql\s*=\s*True"),
    ("file-upload", "MEDIUM", "CWE-434", "js py php ruby", r"\bmulter\s*\(|req\.files?\b|request\.files\b|\$_FILES\b|move_uploaded_file\s*\(|\.save\s*\([^)]*upload|params\[:file\]|FileField\s*\("),
    ("weak-tls-version", "MEDIUM", "CWE-326", "py js go", r"""(?i)SSL[v]3|TLS[v]1(?:\.0|\.1)?['"\s)]|PROTOCOL_SSL[v][23]|MinVersion\s*:\s*tls\.VersionSSL30|secureProtocol\s*:\s*['"](?:SSL[v]3|TLS[v]1)"""),
    ("react-dangerous-html", "MEDIUM", "CWE-79", "js", r"dangerouslySetInnerHTML"),
    ("zip-slip", "MEDIUM", "CWE-22", "py js", r"\.extractall\s*\(|(?:tar|adm-zip|unzipper)\b[^;\n]*\.extract(?:All)?\s*\("),
    ("ruby-insecure-deser", "HIGH", "CWE-502", "ruby", r"\bMarshal\.load\b|\bYAML\.load\s*\(|\bOj\.load\b|\bPsych\.load\s*\("),
    ("redos", "MEDIUM", "CWE-1333", "js py php", r"(?:new\s+RegExp\s*\(|re\.(?:compile|match|search|subn?|findall|fullmatch)\s*\(|preg_match(?:_all)?\s*\()[^;\n]*\([^()]*[+*][^()]*\)\s*[+*]"),
    ("ecb-mode", "MEDIUM", "CWE-327", "js py cs", r"""MODE_ECB|CipherMode\.ECB|["']aes-\d+-ecb["']|["'](?:AES|DES|DESede|TripleDES)/ECB"""),
    ("tls-verify-disabled", "HIGH", "CWE-295", "js py go", r"""InsecureSkipVerify\s*:\s*true|verify\s*=\s*False\b|check_hostname\s*=\s*False\b|ssl\._create_unverified_context|rejectUnauthorized\s*:\s*false|NODE_TLS_REJECT_UNAUTHORIZED\s*=?\s*['"]?0"""),
    ("sensitive-data-log", "MEDIUM", "CWE-532", "js py go php ruby cs", r"(?:console\.(?:log|info|debug|warn|error)|(?:_?logger?|log)\.(?:info|debug|warn|error|trace|log|Log\w+|Print\w*)|Console\.Write(?:Line)?|System\.out\.print\w*|print(?:ln|f)?|fmt\.(?:S?Print\w*))\s*\([^)]*(?:\$?\{|\+\s*|,\s*|\(\s*|\.|=\s*)\w*(?i:password|passwd|pwd|secret|token|api_?key|private_?key|access_?key|client_?secret|ssn|cvv|creditcard)"),
    ("cs-sql-raw", "HIGH", "CWE-89", "cs", r'(?:FromSqlRaw|ExecuteSqlRaw(?:Async)?|ExecuteSqlCommand|new\s+SqlCommand|new\s+NpgsqlCommand|new\s+MySqlCommand|new\s+SqliteCommand|new\s+OracleCommand)\s*\(\s*(?:\$@?"|@?"[^"]*"\s*\+|[A-Za-z_]\w*\s*\+)'),
    ("cs-command-exec", "HIGH", "CWE-78", "cs", r"Process\.Start\s*\(|new\s+ProcessStartInfo\s*\("),
    ("cs-path-traversal", "MEDIUM", "CWE-22", "cs", r'(?:File\.(?:ReadAllText|ReadAllBytes|ReadAllLines|WriteAllText|WriteAllBytes|OpenRead|OpenWrite|Delete|Copy|Move)|new\s+FileStream|new\s+StreamReader)\s*\(\s*(?:\$@?"|Path\.Combine|"[^"]*"\s*\+|[A-Za-z_][\w.]*\s*\+)'),
    ("cs-insecure-deser", "HIGH", "CWE-502", "cs", r"new\s+(?:BinaryFormatter|SoapFormatter|NetDataContractSerializer|LosFormatter|ObjectStateFormatter|JavaScriptSerializer)\b"),
    ("cs-json-typenamehandling", "HIGH", "CWE-502", "cs", r"TypeNameHandling\s*\.\s*(?:All|Auto|Objects|Arrays)"),
    ("cs-xxe", "MEDIUM", "CWE-611", "cs", r"DtdProcessing\s*\.\s*Parse|new\s+XmlTextReader\b|XmlResolver\s*=\s*new\s+XmlUrlResolver"),
    ("cs-ssrf", "MEDIUM", "CWE-918", "cs", r'(?:\.GetAsync|\.GetStringAsync|\.PostAsync|\.DownloadString|\.DownloadData)\s*\(\s*(?:\$@?"https?://|@?"https?://[^"]*"\s*\+)|WebRequest\.Create\s*\(\s*(?:\$@?"|[A-Za-z_][\w.]*|@?"https?)'),
    ("cs-open-redirect", "MEDIUM", "CWE-601", "cs", r'(?:\bRedirect|\bRedirectPermanent|new\s+RedirectResult)\s*\(\s*(?:[A-Za-z_][\w.]*\s*[)\?,]|\$@?"https?://|\$@?"\{|@?"https?://|new\s+Uri)'),
    ("cs-weak-hash", "MEDIUM", "CWE-328", "cs", r"MD5\.Create\s*\(|SHA1\.Create\s*\(|new\s+MD5CryptoServiceProvider\b|new\s+SHA1(?:CryptoServiceProvider|Managed)\b"),
    ("cs-weak-cipher", "MEDIUM", "CWE-327", "cs", r"new\s+DESCryptoServiceProvider\b|new\s+RC2CryptoServiceProvider\b|TripleDES\.Create\s*\(|\bDES\.Create\s*\("),
    ("cs-ldap-injection", "MEDIUM", "CWE-90", "cs", r'new\s+DirectorySearcher\s*\(\s*(?:\$@?"|[A-Za-z_]\w*\s*\+|"[^"]*"\s*\+)|\.Filter\s*=\s*(?:\$@?"|[^;]*\+)'),
    ("cs-razor-raw", "MEDIUM", "CWE-79", "razor", r"(?:@?Html\.Raw|new\s+HtmlString)\s*\([^)]*\b(?:Model|ViewBag|ViewData|TempData|Request|Query)\b"),
    ("cs-csrf-disabled", "MEDIUM", "CWE-352", "cs", r"\[(?:[\w.]+\.)?IgnoreAntiforgeryToken\b"),
    ("cs-mass-assignment", "MEDIUM", "CWE-915", "cs", r"\b(?:TryUpdateModelAsync|TryUpdateModel|UpdateModel)\s*\("),
    ("cs-cookie-insecure", "MEDIUM", "CWE-614", "cs", r"(?:Secure|HttpOnly)\s*=\s*false"),
    ("cs-jwt-validation-disabled", "HIGH", "CWE-347", "cs", r"(?:ValidateIssuer|ValidateAudience|ValidateLifetime|RequireExpirationTime|ValidateIssuerSigningKey|RequireSignedTokens)\s*=\s*false|RequireHttpsMetadata\s*=\s*false"),
    ("cs-cert-validation-disabled", "HIGH", "CWE-295", "cs", r"DangerousAcceptAnyServerCertificateValidator|(?:ServerCertificateCustomValidationCallback|RemoteCertificateValidationCallback)\s*(?:=|\+=)\s*(?:delegate|[^;=]*=>\s*true)"),
    ("cs-cors-permissive", "MEDIUM", "CWE-942", "cs", r"SetIsOriginAllowed\s*\(\s*[^)]*=>\s*true\s*\)|AllowAnyOrigin\s*\(\s*\)\s*\.\s*AllowCredentials"),
]

#: File endings of each language.
ENDINGS = {"js": [".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"], "py": [".py"], "ruby": [".rb"], "php": [".php"], "go": [".go"], "cs": [".cs"], "razor": [".cshtml", ".razor"]}
#: A lookup by an id of the request, a check that ties the object to its owner, the rule they make and its window.
LOOKUP = r"""(?i)(?:findById|findByPk|getById)\s*\(\s*req(?:uest)?\.(?:params|query|args)|\.findOne\s*\(\s*\{\s*_?id\s*:\s*req\.|objects\.get\s*\(\s*(?:pk|id)\s*=\s*request|get_object_or_404\s*\([^)]*request|\.find\s*\(\s*params\[:id\]|WHERE\s+id\s*=\s*['"`]?\$?\{?(?:req|request|params)"""
OWNERSHIP = r"(?i)current_user|req\.user|request\.user|session\[|\bowner|user_id|account_id|@current|\bauthorize\b|\bcan\?|pundit|policy_scope|where\([^)]*user|filter\([^)]*user="
LOOKUP_WINDOW = 8
GLOBAL_ANTIFORGERY = "AutoValidateAntiforgeryToken"
LONGEST_LINE = 1000
#: Sources of user input.
SOURCES = r"req\.(?:query|params|body|headers)\b|request\.(?:args|form|values|data|GET|POST|params)\b|\bparams\[|\$_(?:GET|POST|REQUEST|COOKIE)\b|r\.(?:FormValue|URL\.Query|PostFormValue)\b|process\.argv|sys\.argv|\binput\s*\(|Request\.(?:Query|Form|Headers|Cookies|Body|QueryString|RouteValues|Params)\b|\[From(?:Query|Route|Form|Body|Header)\]"
#: Rule, pattern, replacement of mechanical fixes, tried in order.
PATCHES = [
    ("cs-open-redirect", r"\bRedirect\s*\(", "LocalRedirect("),
    ("tls-verify-disabled", r"verify\s*=\s*False", "verify=True"),
    ("tls-verify-disabled", r"InsecureSkipVerify\s*:\s*true", "InsecureSkipVerify: false"),
    ("tls-verify-disabled", r"rejectUnauthorized\s*:\s*false", "rejectUnauthorized: true"),
    ("tls-verify-disabled", r"check_hostname\s*=\s*False", "check_hostname = True"),
    ("cookie-insecure", r"httpOnly\s*:\s*false", "httpOnly: true"),
    ("cookie-insecure", r"secure\s*:\s*false", "secure: true"),
    ("cs-cookie-insecure", r"HttpOnly\s*=\s*false", "HttpOnly = true"),
    ("cs-cookie-insecure", r"Secure\s*=\s*false", "Secure = true"),
    ("ruby-insecure-deser", r"YAML\.load\s*\(", "YAML.safe_load("),
    ("ruby-insecure-deser", r"Psych\.load\s*\(", "Psych.safe_load("),
    ("weak-hash", r"hashlib\.md5\s*\(", "hashlib.sha256("),
    ("weak-hash", r"hashlib\.sha1\s*\(", "hashlib.sha256("),
]
