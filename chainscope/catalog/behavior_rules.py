"""Package-behaviour rule catalogue and scoring weights.

FIXED VALUES: rule names, patterns, severities, categories and messages
must equal the analyzer we reproduce (findings are compared rule by rule).
All patterns are case-sensitive, JavaScript dialect, catalogue order.
"""

from __future__ import annotations

# FIXED VALUES — (rule, pattern, severity, category, message)
BEHAVIOR_RULES = [
    ("no-eval", r'''\beval\s*\(''', "critical", "code-execution",
     "eval() can execute arbitrary code"),
    ("no-function-constructor", r'''\bnew\s+Function\s*\(''', "critical", "code-execution",
     "Function constructor can execute arbitrary code"),
    ("no-vm-runInContext", r'''\bvm\s*\.\s*(runInNewContext|runInThisContext|runInContext|compileFunction)\s*\(''',
     "high", "code-execution", "vm module can execute arbitrary code"),
    ("no-buffer-eval", r'''Buffer\.from\s*\([^)]+\)\s*\.\s*toString\s*\([^)]*\)[\s\S]{0,50}eval''',
     "critical", "code-execution", "Buffer decode + eval pattern — likely obfuscated code execution"),
    ("no-child-process", r'''require\s*\(\s*['"`]child_process['"`]\s*\)''', "high", "process",
     "child_process can spawn arbitrary system commands"),
    ("no-child-process-import", r'''from\s+['"`]child_process['"`]''', "high", "process",
     "child_process import — can spawn arbitrary system commands"),
    ("no-exec-sync", r'''\b(execSync|exec|spawn|spawnSync|fork|execFile|execFileSync)\s*\(''', "high", "process",
     "Process execution function detected"),
    ("no-http-require", r'''require\s*\(\s*['"`](https?|net|tls|dgram)['"`]\s*\)''', "medium", "network",
     "Network module require"),
    ("no-http-import", r'''from\s+['"`](https?|net|tls|dgram)['"`]''', "medium", "network",
     "Network module import"),
    ("no-http-request", r'''\b(https?)\s*\.\s*(request|get)\s*\(''', "medium", "network",
     "HTTP request detected"),
    ("no-fetch", r'''\bfetch\s*\(\s*['"`]https?:''', "medium", "network",
     "fetch() call to external URL"),
    ("no-fetch-dynamic", r'''\bfetch\s*\(\s*[^'"`\s]''', "high", "network",
     "fetch() with dynamic URL — destination unknown"),
    ("no-dns-lookup", r'''\bdns\s*\.\s*(lookup|resolve|resolve4|resolve6)\s*\(''', "low", "network",
     "DNS lookup detected"),
    ("no-xmlhttprequest", r'''\bnew\s+XMLHttpRequest\s*\(''', "medium", "network",
     "XMLHttpRequest detected"),
    ("no-websocket", r'''\bnew\s+WebSocket\s*\(''', "medium", "network",
     "WebSocket connection detected"),
    ("no-fs-require", r'''require\s*\(\s*['"`]fs['"`]\s*\)''', "low", "filesystem",
     "fs module require"),
    ("no-fs-import", r'''from\s+['"`](fs|node:fs|fs\/promises|node:fs\/promises)['"`]''', "low", "filesystem",
     "fs module import"),
    ("no-sensitive-path-read",
     r'''\b(readFile|readFileSync|createReadStream)\s*\(\s*['"`](\/etc\/passwd|\/etc\/shadow|~\/\.ssh|~\/\.aws|~\/\.npmrc|~\/\.env|\/proc\/)''',
     "critical", "filesystem", "Reading sensitive system file"),
    ("no-sensitive-path-write",
     r'''\b(writeFile|writeFileSync|appendFile|appendFileSync)\s*\(\s*['"`](\/etc\/|\/usr\/|\/bin\/|~\/\.bashrc|~\/\.profile)''',
     "critical", "filesystem", "Writing to sensitive system path"),
    ("no-fs-unlink", r'''\b(unlink|unlinkSync|rmdir|rmdirSync|rm)\s*\(''', "medium", "filesystem",
     "File/directory deletion detected"),
    ("no-home-dir-readdir", r'''\b(readdir|readdirSync)\s*\(\s*['"`](~|\/home\/|\/Users\/)''', "high", "filesystem",
     "Listing home directory contents"),
    ("no-env-access", r'''process\.env\b''', "low", "environment",
     "Accesses environment variables"),
    ("no-env-sensitive",
     r'''process\.env\s*\[\s*['"`](API_KEY|SECRET|TOKEN|PASSWORD|AWS_|GITHUB_TOKEN|NPM_TOKEN|DATABASE_URL|PRIVATE_KEY)''',
     "high", "environment", "Accesses sensitive environment variable"),
    ("no-env-exfiltrate", r'''JSON\.stringify\s*\(\s*process\.env\s*\)''', "critical", "environment",
     "Serializing entire process.env — possible credential exfiltration"),
    ("no-dynamic-require", r'''require\s*\(\s*[^'"`\s)][^)]*\)''', "medium", "code-execution",
     "Dynamic require with non-literal argument"),
    ("no-dynamic-import", r'''import\s*\(\s*[^'"`\s)][^)]*\)''', "medium", "code-execution",
     "Dynamic import with non-literal argument"),
    ("no-charcode-build", r'''String\.fromCharCode\s*\(''', "high", "obfuscation",
     "String.fromCharCode — common obfuscation technique"),
    ("no-hex-string", r'''\\x[0-9a-fA-F]{2}(\\x[0-9a-fA-F]{2}){3,}''', "high", "obfuscation",
     "Long hex escape sequence — possible obfuscated string"),
    ("no-unicode-escape", r'''\\u[0-9a-fA-F]{4}(\\u[0-9a-fA-F]{4}){5,}''', "high", "obfuscation",
     "Long unicode escape sequence — possible obfuscated string"),
    ("no-atob", r'''\batob\s*\(''', "medium", "obfuscation",
     "Base64 decode — may hide malicious strings"),
    ("no-base64-decode", r'''Buffer\.from\s*\([^,]+,\s*['"`]base64['"`]\s*\)''', "medium", "obfuscation",
     "Base64 decode via Buffer — may hide malicious strings"),
    ("no-proto-access", r'''\[['"`]__proto__['"`]\]''', "high", "prototype-pollution",
     "__proto__ access — possible prototype pollution"),
    ("no-constructor-prototype", r'''\bconstructor\s*\[\s*['"`]prototype['"`]\s*\]''', "high", "prototype-pollution",
     "constructor.prototype access — possible prototype pollution"),
    ("no-preinstall-script", r'''"preinstall"\s*:\s*"''', "high", "install-script",
     "preinstall script can execute code before user reviews package"),
    ("no-postinstall-script", r'''"postinstall"\s*:\s*"''', "medium", "install-script",
     "postinstall script detected"),
]

# FIXED VALUES — severity weights of the package score
SEVERITY_WEIGHT = {"critical": 3.0, "high": 2.0, "medium": 1.0, "low": 0.3, "info": 0.0}
