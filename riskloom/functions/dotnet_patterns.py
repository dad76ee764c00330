"""Patterns of attribute-routed C# controllers."""

#: Fixed values (Python re with re.ASCII).
CLASS = r"\bclass\s+(\w+)"
ROUTE = r'\[Route\s*\(\s*"([^"]*)"'
VERB = r'\[Http(Get|Post|Put|Delete|Patch|Head|Options)\b(?:\s*\(\s*"([^"]*)")?'
AUTHORIZE = r"\[(?:[\w.]+\.)?(?:Authorize|Authorized|RequirePermission|RequirePolicy|RequireRole|RequireScope|RequireClaim|RequireAuthorization)\b"
ANONYMOUS = r"\[AllowAnonymous\b"
CONSTRAINT = r"\{(\w+)[:?][^}]*\}"
METHOD = r"^\s*(?:\[[^\]]*\]\s*)*(?:public|private|protected|internal)\b[^;={]*\("
ARGUMENTS = r"\[Authorize\s*\(([^)]*)\)"
ROLES = r'Roles\s*=\s*"([^"]+)"'
POLICY = r'Policy\s*=\s*"([^"]+)"'
FRAMEWORK_BASES = ["Controller", "ControllerBase", "Object", "object", "PageModel", "ComponentBase"]
LINES_AHEAD = 11
HEADER_LINES = 16
MOST_BASES = 16
GLOBAL_USER = "RequireAuthenticatedUser"
GLOBAL_FILTERS = ["AuthorizeFilter", "FallbackPolicy", "DefaultPolicy"]
MAP_ALL = r"\bMap(?:Controllers|RazorPages|DefaultControllerRoute|ControllerRoute|AreaControllerRoute)\b"
MAP_ALL_REQUIRED = r"\bMap(?:Controllers|RazorPages|DefaultControllerRoute|ControllerRoute|AreaControllerRoute)\s*\([^)]*\)\s*\.\s*RequireAuthorization"
REQUIRE_ALONE = r"^\s*\.\s*RequireAuthorization\s*\("
