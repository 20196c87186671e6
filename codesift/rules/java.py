"""Rules for files whose language is java."""

from .model import has, has_i, lacks, routed

# The patterns below decide what is a finding.
DIGEST_NAME = r"[\"'](MD5|SHA-?1)[\"']"
RESOURCE = r"(?:Connection|Statement|ResultSet|InputStream|OutputStream|Reader|Writer)\s+(\w+)\s*="
TRY_WITH = r"try\s*\([^)]*\w+\s*="
CLOSED = r"(\w+)\.close\s*\("
FINALLY = r"finally\s*\{"
FINALLY_WINDOW = 500
EMPTY_CATCH = r"catch\s*\([^)]+\)\s*\{\s*\}"
OPEN_CATCH = r"catch\s*\([^)]+\)\s*\{"

RULES = [
    routed("JV-01", "java/sql-injection", "critical", "security",
           "SQL text is concatenated with a value.", "Use a prepared statement and bind the value.",
           line=(has(r"executeQuery\s*\(|executeUpdate\s*\(|prepareStatement\s*\("),
                 has(r"\"\s*\+\s*\w|'\s*\+\s*\w"))),
    routed("JV-02", "java/hardcoded-credentials", "critical", "security",
           "Credentials are written into the source.", "Load credentials from the environment.",
           line=(has(r"(?i:(?:password|passwd|pwd|secret|apikey|api_key)\s*=\s*[\"'][^\"']{4,}[\"'])"
                     r"|getConnection\s*\([^)]*[\"'][^\"']+[\"']\s*,\s*[\"'][^\"']+[\"']\s*,\s*[\"'][^\"']+[\"']"),)),
    routed("JV-03", "java/weak-crypto", "critical", "security",
           "The digest {} can be forged.", "Use SHA-256 or a password hash.",
           line=(has_i(r"MessageDigest\.getInstance\s*\(\s*[\"'](?:MD5|SHA-?1)[\"']\)"),), custom=True),
    routed("JV-04", "java/command-injection", "critical", "security",
           "A shell command is built from a value.", "Use ProcessBuilder with separate arguments.",
           line=(has(r"Runtime\.getRuntime\(\)\.exec\s*\("), has(r"\+\s*\w"))),
    routed("JV-05", "java/unsafe-deserialization", "critical", "security",
           "Objects are read from serialized bytes.", "Use a data format with a schema or an input filter.",
           line=(has(r"ObjectInputStream|readObject\s*\("),)),
    routed("JV-06", "java/resource-leak", "high", "reliability",
           "{} is opened and never closed.", "Open it in a try-with-resources statement.",
           line=(has(RESOURCE),), frames=((-5, 0, (lacks(TRY_WITH),)),), custom=True),
    routed("JV-07", "java/empty-catch", "high", "reliability",
           "An exception is swallowed.", "Log the exception or throw it on.",
           line=(has(OPEN_CATCH),), custom=True),
    routed("JV-08", "java/thread-explosion", "critical", "performance",
           "Threads are started inside a loop.", "Submit the work to a bounded executor.",
           line=(has(r"new\s+Thread\s*\("),), frames=((-10, -1, (has(r"for\s*\(|while\s*\("),)),)),
    routed("JV-09", "java/path-traversal", "high", "security",
           "A file path is built from a value.", "Canonicalise the path and check its parent.",
           line=(has(r"new\s+File\s*\(|new\s+FileInputStream\s*\(|new\s+FileOutputStream\s*\("),
                 has(r"\+\s*\w|args\["))),
    routed("JV-10", "java/xxe", "high", "security",
           "An XML parser may resolve external entities.", "Switch off document types and external entities.",
           line=(has(r"DocumentBuilderFactory|SAXParserFactory|XMLInputFactory"),),
           frames=((0, 9, (lacks(r"setFeature.*disallow-doctype-decl|setFeature.*external-general-entities.*false"),)),)),
    routed("JV-11", "java/insecure-random", "high", "security",
           "A guessable random number is used near a secret.", "Use SecureRandom.",
           line=(has(r"new\s+Random\s*\(|Math\.random\s*\("),),
           frames=((-5, 4, (has_i(r"token|password|secret|key|session|auth|crypt"),)),)),
    routed("JV-12", "java/null-pointer", "medium", "reliability",
           "A result is used without a null check.", "Check for null or wrap the value in Optional.",
           line=(has(r"\.getString\s*\(|\.getObject\s*\(|\.next\s*\("),),
           frames=((0, 2, (lacks(r"if\s*\(\s*\w+\s*!=\s*null|!=\s*null\s*&&|Optional"), has(r"\.\w+\s*\("))),
                   (1, 1, (has(r"\w\s*\.\s*\w+\s*\("),)))),
    routed("JV-13", "java/insecure-http", "high", "security",
           "A connection is made without transport security.", "Connect over https.",
           file=(has(r"HttpURLConnection|HttpClient|URL\s*\("), lacks(r"setHostnameVerifier|SSLContext|TrustManager"),
                 has(r"http:\/\/"))),
]
