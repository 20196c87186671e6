"""Line rules that apply to every language."""

from .model import Rule, has, has_i, lacks

# The patterns below decide what is a finding.
PUSH = r"\.push\s*\("
LENGTH_CHECK = r"\.length\s*[<>]"
REQUEST_VALUE = r"req\.(?:body|params|query)\.\w+"
VALIDATION_WORD = r"(?:validate|sanitize|check|joi|yup|zod)"
LENGTH_WINDOW = 200
VALIDATION_WINDOW = 500
VALIDATION_GAP = 10
LOOP_HEAD = r"^\s*(?:for|while)\s*\("
LOOP_CALL = r"\.(?:forEach|map|filter|reduce)\s*\("

RULES = [
    Rule("PT-01", "command-injection", "critical", "security", None,
         "exec() receives a command assembled from dynamic text.",
         "Pass arguments as a list with execFile() or accept only known commands.",
         line=(has(r"exec\s*\(\s*[`'\"].*(\+|\$\{)"),)),
    Rule("PT-02", "string-concat-in-loop", "high", "performance", None,
         "A string grows by concatenation on every loop turn.",
         "Collect the parts in an array and join them once after the loop.",
         line=(has(r"\w\s*\+=\s*['\"`]|\w\s*=\s*\w+\s*\+\s*['\"`]"),), in_loop=True),
    Rule("PT-03", "regex-in-loop", "medium", "performance", None,
         "A regular expression is built again on every loop turn.",
         "Build the expression once before the loop.",
         line=(has(r"(new\s+RegExp\(|^\s*\/.*\/[gimuy]*\.(test|exec)\()"),), in_loop=True),
    Rule("PT-04", "eqeqeq", "low", "style", None,
         "Loose equality converts types silently.",
         "Compare with === so that no conversion takes place.",
         line=(has(r"[^!=]==[^=]"), lacks(r"==="))),
    Rule("PT-05", "sql-injection", "critical", "security", None,
         "A query is put together from dynamic text.",
         "Bind values as query parameters.",
         line=(has(r"(?:query|execute|raw)\s*\(\s*[`'\"].*\$\{|\+\s*\w"
                   r"|(?:query|execute)\s*\([^)]*\+\s*(?:req\.|params\.|body\.|query\.)"),)),
    Rule("PT-06", "xss-vulnerability", "critical", "security", None,
         "Dynamic text is written into the page as markup.",
         "Assign textContent or clean the markup first.",
         line=(has(r"\.innerHTML\s*=|\.outerHTML\s*=|document\.write\s*\("), has(r"\$\{|\+"))),
    Rule("PT-07", "hardcoded-secret", "critical", "security", None,
         "A secret seems to be written into the source.",
         "Read secrets from the environment or a vault.",
         line=(has_i(r"(?:password|secret|api_?key|token|auth)\s*[:=]\s*['\"][^'\"]{8,}['\"]"),)),
    Rule("PT-08", "path-traversal", "critical", "security", None,
         "A file call uses a path taken from the request.",
         "Resolve the path and require that it stays below an allowed folder.",
         line=(has(r"(?:readFile|writeFile|unlink|rmdir|access)\s*\([^)]*(?:req\.|params\.|query\.|body\.)"),)),
    Rule("PT-09", "prototype-pollution", "high", "security", None,
         "A computed key or request object may reach a prototype.",
         "Check keys, or use a Map or a null-prototype object.",
         line=(has(r"(?:^|[\r\u2028\u2029])[^\[\r\u2028\u2029]*\[.*\]\s*=(?:[^=]|$)"
                   r"|\.__proto__|Object\.assign\s*\([^,]+,\s*(?:req\.|body\.|params\.)"),)),
    Rule("PT-10", "insecure-random", "high", "security", None,
         "A guessable random number feeds a sensitive value.",
         "Take random bytes from a cryptographic source.",
         line=(has(r"Math\.random\s*\(\)"), has_i(r"(?:token|password|secret|key|id|session)"))),
    Rule("PT-11", "empty-catch", "medium", "security", None,
         "An error is caught and dropped.",
         "Record the error or throw it again.",
         line=(has(r"\.catch\s*\(\s*\(\s*\)\s*=>\s*\{\s*\}\s*\)|catch\s*\([^)]*\)\s*\{\s*\}"),)),
    Rule("PT-12", "n-plus-one-query", "high", "performance", None,
         "A database call is made on every loop turn.",
         "Fetch all rows with one query before the loop.",
         line=(has(r"(?:db|pool|prisma|knex|sequelize|mongoose)\.\w+\s*\("),), in_loop=True),
    Rule("PT-13", "sync-file-operation", "medium", "performance", None,
         "A blocking file call stops the event loop.",
         "Use the promise or callback form.",
         line=(has(r"(?:readFileSync|writeFileSync|existsSync|readdirSync|statSync)\s*\("),)),
    Rule("PT-14", "unbounded-array", "low", "performance", None,
         "An array grows in a loop without a size check.",
         "Stop or flush when the array reaches a limit.",
         line=(has(PUSH),), in_loop=True, head=(LENGTH_WINDOW, lacks(LENGTH_CHECK))),
    Rule("PT-15", "missing-validation", "medium", "security", None,
         "Request input is used without a visible check.",
         "Validate the input against a schema first.",
         line=(has(REQUEST_VALUE),), head=(VALIDATION_WINDOW, lacks(VALIDATION_WORD)), custom=True),
]
