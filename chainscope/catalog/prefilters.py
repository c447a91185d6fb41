"""Necessary literals of every rule, for skipping regex work.

Our own index over the catalogues: for rule R, every text R matches
contains, lower-cased, at least one literal of each group (AND of ORs).
A file whose lower-cased content fails the test cannot match R, so the
regex never runs on it.  Lower-casing keeps ASCII literals (the regexes
fold ASCII only), so the test is sound for case-insensitive rules too.
``tests/test_scan.py`` checks every group against every match found in
the snippet pool.
"""

from __future__ import annotations

SOURCE = {
    "A01-path-traversal": [["readfile", "createreadstream", "access", "stat"]],
    "A01-open-redirect": [["res.redirect", "window.location", "location.href"]],
    "A01-cors-wildcard": [["access-control-allow-origin", "allowedorigin", "cors"]],
    "A01-cors-reflect-origin": [["req.headers.origin"]],
    "A01-missing-auth-middleware": [["admin", "internal", "private", "manage", "config"]],
    "A01-directory-listing": [["express.static", "servestatic", "serve-static"]],
    "A01-idor-direct-db": [["findunique", "findone", "findbyid", "findbypk", "deleteone", "updateone"]],
    "A01-privilege-escalation": [["role", "isadmin", "permission", "privilege"]],
    "A01-insecure-object-ref": [["/api/"]],
    "A01-jwt-no-verify": [["jwt.decode"]],
    "A02-md5-hash": [["md5"]],
    "A02-sha1-hash": [["sha1"]],
    "A02-hardcoded-secret": [["secret", "key"]],
    "A02-math-random-crypto": [["math.random"]],
    "A02-cleartext-password-store": [["password"]],
    "A02-weak-cipher": [["createcipher"]],
    "A02-ecb-mode": [["-ecb"]],
    "A02-tls-reject-unauthorized": [["rejectunauthorized", "reject_unauthorized"]],
    "A02-short-key-length": [["moduluslength"]],
    "A02-createCipher-deprecated": [["crypto.createcipher"]],
    "A03-sql-concat": [["query", "execute", "raw"], ["select", "insert", "update", "delete", "drop", "alter", "create"]],
    "A03-sql-template-literal": [["query", "execute", "raw"], ["select", "insert", "update", "delete"], ["${"]],
    "A03-nosql-injection": [["find", "aggregate"], ["req"]],
    "A03-command-injection-exec": [["exec"]],
    "A03-command-injection-spawn": [["spawn", "execfile"]],
    "A03-ldap-injection": [["search", "bind"]],
    "A03-xpath-injection": [["xpath", "evaluate", "select"]],
    "A03-header-injection": [["setheader", "writehead", "res.header"]],
    "A03-log-injection": [["console.", "log"]],
    "A03-regex-dos": [["regexp"]],
    "A03-eval-injection": [["eval"]],
    "A03-template-injection": [["render", "compile", "template"]],
    "A04-race-condition": [["findone", "findunique"]],
    "A04-missing-rate-limit": [["post"], ["login", "signin", "auth", "register", "signup", "reset", "forgot", "otp",
                                         "verify"]],
    "A04-hardcoded-credentials": [["user", "admin", "root"], ["pass", "pwd"]],
    "A04-insecure-default": [["false"], ["secure", "httponly", "samesite", "signed", "encrypted", "verified"]],
    "A04-missing-input-validation": [["req.body", "req.query", "req.params"]],
    "A05-debug-enabled": [["debug", "showstackerror"]],
    "A05-verbose-error": [["res."], ["stack", "message"]],
    "A05-default-credentials": [["pass"], ["admin", "password", "123456", "root", "default", "changeme", "test",
                                           "demo", "guest"]],
    "A05-missing-security-headers": [["app.use", "app.listen", "createserver"]],
    "A05-exposed-env-file": [["express.static", "servestatic"]],
    "A05-stack-trace-exposure": [[".stack"]],
    "A05-dev-mode-production": [["node_env"]],
    "A05-permissive-cors-credentials": [["credentials"], ["origin"]],
    "A06-known-vulnerable-import": [["require"], ["event-stream", "flatmap-stream", "ua-parser-js", "colors", "faker",
                                                  "coa", "rc", "node-ipc"]],
    "A06-deprecated-api": [["buffer", "crypto.createcipher", "url.parse", "domain.create", "fs.exists"]],
    "A06-wildcard-dependency": [["*"]],
    "A06-outdated-crypto-lib": [["require"], ["crypto-js", "sjcl", "jsencrypt", "node-forge"]],
    "A06-git-dependency": [["git+", "git://", "github:", "bitbucket:"]],
    "A07-hardcoded-password": [["pass", "pwd"]],
    "A07-weak-password-policy": [["minlength", "min_length", "minimumlength"]],
    "A07-session-fixation": [["req.session"]],
    "A07-jwt-none-algorithm": [["algorithm"], ["none"]],
    "A07-insecure-cookie": [["cookie", "session"], ["false"]],
    "A07-credential-in-url": [["http"], ["@"]],
    "A07-plaintext-comparison": [["password", "token", "secret", "key"], ["==", "!="]],
    "A07-no-password-hash": [["passw"]],
    "A08-eval-from-network": [["eval"]],
    "A08-dynamic-require-url": [["require"], ["http"]],
    "A08-cdn-no-sri": [["<script"]],
    "A08-prototype-pollution": [["__proto__", "constructor"]],
    "A08-unsafe-json-parse": [["json.parse"]],
    "A08-postinstall-exec": [["install"]],
    "A09-sensitive-data-in-log": [["console.", "log"]],
    "A09-console-log-prod": [["console.log"]],
    "A09-empty-catch": [["catch"]],
    "A09-missing-auth-logging": [["login", "signin", "authenticate"]],
    "A09-error-info-leak": [["catch"], ["res."]],
    "A10-ssrf-fetch": [["fetch"]],
    "A10-ssrf-axios": [["axios"]],
    "A10-ssrf-http-request": [["http"]],
    "A10-internal-ip-access": [["http"], ["localhost", "127.0.0.1", "0.0.0.0", "10.", "172.", "192.168.", "169.254.",
                                          "::1", "metadata.google"]],
    "A10-url-redirect-follow": [["follow", "redirect"]],
    "A10-dns-rebinding": [["dns."]],
    "TS-any-abuse": [["any"]],
    "TS-ts-ignore": [["@ts-ignore"]],
    "TS-non-null-assertion": [["!"]],
    "TS-as-any-cast": [["any"]],
    "REACT-dangerous-html": [["dangerouslysetinnerhtml"]],
    "REACT-href-javascript": [["javascript:"]],
    "REACT-unescaped-user-output": [["{"], ["params", "query"]],
    "REACT-unsafe-lifecycle": [["unsafe_componentwill"]],
    "REACT-open-redirect-router": [["router.push", "router.replace", "redirect"]],
    "NODE-path-join-user": [["path.join", "path.resolve"]],
    "NODE-fs-user-path": [["fs"], ["readfile", "writefile", "unlink", "rmdir", "mkdir", "stat", "access", "readdir"]],
    "NODE-unsafe-deserialize": [["node-serialize", "serialize-javascript", "js-yaml.load"]],
    "NODE-child-process-user": [["child_process"]],
    "NODE-buffer-alloc-unsafe": [["buffer.allocunsafe"]],
    "SEC-aws-access-key": [["akia"]],
    "SEC-github-token": [["ghp_", "github_pat_", "gho_", "ghu_", "ghs_"]],
    "SEC-stripe-key": [["sk_live_", "rk_live_"]],
    "SEC-generic-api-key": [["api"]],
    "SEC-private-key-pem": [["-----begin"]],
    "SEC-jwt-secret-hardcoded": [["jwt", "token"], ["secret", "key", "signing"]],
    "SEC-database-url": [["://"], ["mongodb", "postgres", "mysql", "redis", "amqp"]],
    "SEC-password-in-assignment": [["const", "let", "var"], ["pass", "pwd", "secret", "token"]],
    "DEP-internal-scope": [["@internal/", "@private/", "@corp/", "@company/", "@org/"]],
    "DEP-file-protocol": [["file:"]],
}

BEHAVIOR = {
    "no-eval": [["eval"]],
    "no-function-constructor": [["function"]],
    "no-vm-runInContext": [["runin", "compilefunction"]],
    "no-buffer-eval": [["buffer.from"], ["eval"]],
    "no-child-process": [["child_process"]],
    "no-child-process-import": [["child_process"]],
    "no-exec-sync": [["exec", "spawn", "fork"]],
    "no-http-require": [["require"], ["http", "net", "tls", "dgram"]],
    "no-http-import": [["from"], ["http", "net", "tls", "dgram"]],
    "no-http-request": [["http"], ["request", "get"]],
    "no-fetch": [["fetch"], ["http"]],
    "no-fetch-dynamic": [["fetch"]],
    "no-dns-lookup": [["dns"]],
    "no-xmlhttprequest": [["xmlhttprequest"]],
    "no-websocket": [["websocket"]],
    "no-fs-require": [["require"], ["fs"]],
    "no-fs-import": [["from"], ["fs"]],
    "no-sensitive-path-read": [["readfile", "createreadstream"], ["/etc/", "~/.", "/proc/"]],
    "no-sensitive-path-write": [["writefile", "appendfile"], ["/etc/", "/usr/", "/bin/", "~/."]],
    "no-fs-unlink": [["unlink", "rm"]],
    "no-home-dir-readdir": [["readdir"]],
    "no-env-access": [["process.env"]],
    "no-env-sensitive": [["process.env"]],
    "no-env-exfiltrate": [["json.stringify"]],
    "no-dynamic-require": [["require"]],
    "no-dynamic-import": [["import"]],
    "no-charcode-build": [["string.fromcharcode"]],
    "no-hex-string": [["\\x"]],
    "no-unicode-escape": [["\\u"]],
    "no-atob": [["atob"]],
    "no-base64-decode": [["buffer.from"], ["base64"]],
    "no-proto-access": [["__proto__"]],
    "no-constructor-prototype": [["constructor"], ["prototype"]],
    "no-preinstall-script": [['"preinstall"']],
    "no-postinstall-script": [['"postinstall"']],
}
