"""Patterns for following user input through assignments and calls."""

#: Fixed values (Python re with re.ASCII): assignments, first lines of functions and their first parameter, by file ending.
ASSIGN = r"(\$?[A-Za-z_][\w]*)\s*:?=\s*([^=].*)$"
SCRIPT = r"\bfunction\b|=>"
BOUNDARY = {
    ".py": r"^\s*def\s", ".rb": r"^\s*def\s", ".go": r"^\s*func\s", ".rs": r"\bfn\s", ".php": r"\bfunction\s",
    ".js": SCRIPT, ".jsx": SCRIPT, ".ts": SCRIPT, ".tsx": SCRIPT, ".mjs": SCRIPT, ".cjs": SCRIPT,
    ".cs": r"^\s*(?:\[Http|(?:public|private|protected|internal|static|async|override|virtual)\s)",
}
NAMED = r"function\s+(\w+)\s*\(\s*([\w$]+)"
DEFINITION = {
    ".py": r"^\s*def\s+(\w+)\s*\(\s*(?:self\s*,\s*)?(\w+)", ".rb": r"^\s*def\s+(\w+)\s*\(?\s*(\w+)", ".go": r"^\s*func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(\s*(\w+)",
    ".php": r"\bfunction\s+(\w+)\s*\(\s*\$(\w+)", ".js": NAMED, ".ts": NAMED, ".jsx": NAMED, ".tsx": NAMED,
}
#: C# actions, methods and their names; calls; words before a parenthesis that are no calls; values made safe.
CS_ACTION = r"\[Http(?:Get|Post|Put|Delete|Patch|Head|Options)\b"
CS_METHOD = r"^\s*(?:\[[^\]]*\]\s*)*(?:public|private|protected|internal)\b[^;={]*\([^;]*\)"
CS_NAME = r"(?:public|private|protected|internal)\b[^;={(]*\s(\w+)\s*\("
SEED_CALL = r"([A-Za-z_]\w*)\s*\([^)]*(?:req\.(?:query|params|body)|request\.(?:args|form|json|data|GET|POST)|\$_(?:GET|POST|REQUEST)|params\[)"
CALL = r"([A-Za-z_]\w*)\s*\("
KEYWORDS = ["if", "for", "foreach", "while", "switch", "catch", "return", "func", "function", "def", "using", "lock", "await", "yield", "sizeof"]
TYPED = r"^\s*(?:\(\s*(?:u?int|u?long|u?short|byte|float|double|decimal|bool|Guid|DateTime)\s*\)|parseInt|parseFloat|Number|Boolean|(?:u?int|u?long|u?short|byte|float|double|decimal|bool|Guid|DateTime)\.(?:Parse|TryParse)|Convert\.To(?:Int\d*|Int|Double|Decimal|Boolean|Single|Byte)|Integer\.parseInt|Long\.parseLong|Double\.parseDouble|Float\.parseFloat|Boolean\.parseBoolean|(?:int|float|bool)\s*\()"
ENCODED = r"^\s*(?:encodeURIComponent|encodeURI|escapeHtml|DOMPurify\.sanitize|sanitizeHtml|he\.encode|html\.escape|markupsafe\.escape|bleach\.clean|HtmlEncoder\.Encode|HttpUtility\.HtmlEncode|WebUtility\.HtmlEncode|AntiXss\.\w*Encode|Uri\.EscapeDataString|StringEscapeUtils\.escapeHtml\w*|HtmlUtils\.htmlEscape|ESAPI\.encoder)\s*\("
ACTION_LINES = 4
