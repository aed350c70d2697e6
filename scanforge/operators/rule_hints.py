"""Literal prefilters for the built-in rules (ours, not part of the rule data).

For each rule, a list of lower-case substrings such that every line the
pattern can match contains at least one of them (after ``lower`` and mapping
LONG S to ``s``, which is what RE2 case folding can reach). The regex then only
runs on lines that pass a cheap ``contains`` test; most lines never reach the
regex engine. A rule without an entry is always evaluated.

Each list was derived by hand from the pattern: it names a literal that every
alternative of the pattern must contain.
"""

from __future__ import annotations

HINTS: dict[str, tuple[str, ...]] = {
    "PY-001": ("execute",),
    "PY-002": ("os.system", "subprocess."),
    "PY-003": ("passw", "secret", "api_key", "apikey", "token"),
    "PY-004": ("hashlib.md5",),
    "PY-005": ("hashlib.sha1",),
    "PY-006": ("render_template_string",),
    "PY-007": ("pickle.load",),
    "PY-008": ("app.run",),
    "PY-009": ("eval",),
    "PY-010": ("requests.",),
    "PY-011": ("logging.", "logger."),
    "PY-012": ("len(password)",),
    "PY-013": ("except:",),
    "PY-014": ("random.",),
    "PY-015": ("verify",),
    "PY-016": ("open",),
    "PY-017": ("origins",),
    "PY-018": ("request.",),
    "PY-019": ("yaml.load",),
    "PY-020": ("-----begin ",),
    "PY-021": ("algorithms",),
    "PY-022": ("request.files", "upload"),
    "PY-023": ("secret_key",),
    "PY-024": ("except",),
    "JAVA-001": ("statement",),
    "JAVA-002": ("runtime.getruntime().exec",),
    "JAVA-003": ("passw", "secret", "apikey", "api_key"),
    "JAVA-004": ("messagedigest.getinstance",),
    "JAVA-005": ("messagedigest.getinstance",),
    "JAVA-006": ("objectinputstream",),
    "JAVA-007": ("factory.newinstance",),
    "JAVA-008": ("file",),
    "JAVA-009": (".getbytes",),
    "JAVA-010": ("dircontext", "search", "namingenumeration"),
    "JAVA-011": ("trustallcerts", "allowallhostnameverifier", "allow_all_hostname_verifier", "nullhostnameverifier"),
    "JAVA-012": ("response.getwriter().write",),
    "JAVA-013": ("request.get",),
    "JAVA-014": ("management.endpoints.web.exposure.include",),
    "JAVA-015": ("catch",),
    "JAVA-016": ("cipher.getinstance",),
    "JAVA-017": ("cipher.getinstance",),
    "JAVA-018": ("response.sendredirect",),
    "JAVA-019": ("cookie",),
    "JAVA-020": ("xpath.evaluate", "compile"),
    "JS-001": ("eval",),
    "JS-002": (".innerhtml",),
    "JS-003": ("document.write",),
    "JS-004": ("apikey", "api_key", "secret", "passw", "token"),
    "JS-005": ("__proto__", "constructor.prototype"),
    "JS-006": ("query", "execute"),
    "JS-007": ("cors",),
    "JS-008": ("ignoreexpiration", "algorithms"),
    "JS-009": ("serialize",),
    "JS-010": ("math.random",),
    "JS-011": ("express",),
    "JS-012": ("fs.",),
    "JS-013": ("console.",),
    "JS-014": (".then",),
    "JS-015": ("new regexp",),
    "JS-016": ("app.",),
    "GO-001": ("fmt.sprintf",),
    "GO-002": ("exec.command",),
    "GO-003": (":=",),
    "GO-004": ("md5.",),
    "GO-005": ("insecureskipverify",),
    "GO-006": ("os.open", "ioutil.readfile", "os.readfile"),
    "GO-007": ("rand",),
    "GO-008": ("gob.newdecoder",),
    "PHP-001": ("$_",),
    "PHP-002": ("eval",),
    "PHP-003": ("$_",),
    "PHP-004": ("$_",),
    "PHP-005": ("$_",),
    "PHP-006": ("passw", "db_pass"),
    "PHP-007": ("md5",),
    "KT-001": ("password", "secret", "apikey", "token"),
    "KT-002": ("rawquery", "execsql"),
    "KT-003": ("hostnameverifier", "allow_all", "trustallcerts", "sslsocketfactory"),
    "KT-004": ("sharedpreferences",),
    "CS-001": ("sqlcommand", "executenonquery", "executereader"),
    "CS-002": ("password", "secret", "apikey"),
    "CS-003": ("md5",),
    "CS-004": ("binaryformatter",),
    "CS-005": ("response.write",),
    "SH-001": ("eval",),
    "SH-002": ("password", "secret", "api_key", "token"),
    "SH-003": ("mktemp", "/tmp/"),
    "SH-004": ("curl", "wget"),
    "TF-001": ("password", "secret", "access_key"),
    "TF-002": ("acl",),
    "TF-003": ("cidr_blocks",),
    "TF-004": ("aws_s3_bucket",),
    "TF-005": ("storage_encrypted",),
    "K8S-001": ("runasuser:",),
    "K8S-002": ("privileged:",),
    "K8S-004": ("value", "password", "secret", "token"),
    "HTML-001": (" on", "\ton", "\ron", "\x0con"),   # \s before "on" (no LF inside a line)
    "HTML-002": ("<html",),
    "HTML-003": ("<input",),
    "GEN-001": ("-----begin ",),
    "GEN-002": ("-----begin certificate-----",),
    "GEN-003": ("todo", "fixme", "hack", "xxx"),
    "LEAK-001": ("akia",),
    "LEAK-002": ("aws_secret_access_key",),
    "LEAK-003": ("aws_session_token",),
    "LEAK-010": ("aiza",),
    "LEAK-011": ('"type":',),
    "LEAK-012": ("client_secret",),
    "LEAK-020": ("ghp_",),
    "LEAK-021": ("gho_",),
    "LEAK-022": ("ghu_", "ghs_", "ghr_"),
    "LEAK-023": ("github_pat_",),
    "LEAK-030": ("sk_live_", "sk_test_"),
    "LEAK-031": ("rk_live_", "rk_test_"),
    "LEAK-040": ("xoxb-",),
    "LEAK-041": ("xapp-",),
    "LEAK-042": ("hooks.slack.com/services/",),
    "LEAK-050": ("twilio",),
    "LEAK-060": ("sg.",),
    "LEAK-070": ("accountkey=",),
    "LEAK-071": ("defaultendpointsprotocol=https;accountname=",),
    "LEAK-080": ("-----begin rsa private key-----",),
    "LEAK-081": ("-----begin ec private key-----",),
    "LEAK-082": ("-----begin openssh private key-----",),
    "LEAK-083": ("-----begin pgp private key block-----",),
    "LEAK-084": ("-----begin dsa private key-----",),
    "LEAK-090": ("-----begin certificate-----",),
    "LEAK-100": ("eyj",),
    "LEAK-110": ("://",),
    "LEAK-111": ("mongodb",),
    "LEAK-120": ("pass", "pwd"),
    "LEAK-121": ("api_key", "apikey", "api-key"),
    "LEAK-122": ("secret",),
    "LEAK-130": ("aws_secret", "stripe_", "github_token", "slack_", "twilio_auth", "sendgrid_api",
                 "db_password", "database_url", "secret_key"),
    "LEAK-140": ("//registry.npmjs.org/:_authtoken=",),
    "LEAK-150": ("docker",),
    "LEAK-160": ('"sensitive":',),
}
