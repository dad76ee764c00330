"""Patterns of HTTP routes and what stands around them."""

#: Framework, language, pattern (RE2 dialect), group of the method (0: none), group of the path, lines around that may hold a guard.
ROUTE_RULES = [
    ("Express", "js", r"""(?:app|router)\.(get|post|put|delete|patch|all)\s*\(\s*['"`]([^'"`]+)""", 1, 2, 0),
    ("Go", "go", r'\.(GET|POST|PUT|DELETE|PATCH|Any|Get|Post|Put|Delete|Patch)\s*\(\s*"([^"]+)"', 1, 2, 0),
    ("Go net/http", "go", r'(?:http\.)?(?:Handle|HandleFunc)\s*\(\s*"([^"]+)"', 0, 1, 0),
    ("Laravel", "php", r"""Route::(get|post|put|patch|delete|any)\s*\(\s*['"]([^'"]+)""", 1, 2, 0),
    ("Rails/Sinatra", "ruby", r"""^\s*(get|post|put|patch|delete|match)\s+['"]([^'"]+)""", 1, 2, 0),
    ("Django", "py", r"""(?:path|re_path|url)\s*\(\s*r?['"]([^'"]*)""", 0, 1, 0),
    ("Flask/FastAPI", "py", r"""@(?:app|bp|router|blueprint)\.(route|get|post|put|delete|patch)\s*\(\s*['"]([^'"]+)""", 1, 2, 2),
    ("ASP.NET Minimal", "cs", r'\.Map(Get|Post|Put|Delete|Patch)\s*\(\s*"([^"]+)"', 1, 2, 0),
]
#: Signs of a guard, of a rate limit, of user input on a route's line.
GUARD = r"""(?i)login_required|authenticate|requireauth|isauthenticated|ensurelogged|before_action[^#\n]*(?:authenticate|require_login)|middleware\(\s*['"]auth|@auth\b|verify_?jwt|passport\.|requiresauth|\[authorize|authorization|jwt_required|permission_required"""
RATE_LIMIT = r"(?i)rate[_-]?limit|ratelimit|throttle|slowdown|express-rate|limiter|@limiter|Throttle|bucket4j|rack-attack"
ROUTE_INPUT = r"req\.(?:query|params|body)|request\.(?:args|form|json|data|params|GET|POST)|params\[|\$_(?:GET|POST|REQUEST)|c\.(?:Query|Param|PostForm)"
RESOURCES = r"^\s*resources?\s+:(\w+)"
RESOURCE_ROUTES = [("GET", ""), ("POST", ""), ("GET", "/:id"), ("PUT", "/:id"), ("DELETE", "/:id")]
ANY_METHODS = ["ROUTE", "HANDLE", "ALL", "ANY"]
SPAN_LINES = 120
#: Endpoints worth guarding, id-like parameters, resources that belong to someone, methods that change state.
SENSITIVE = r"(?i)log[_-]?in|signin|sign-in|auth|token|password|reset|forgot|otp|verify|2fa|mfa|confirm"
ID_LIKE = r"(?i)^(?:id|.*id|guid|uuid|.*key|.*no|.*number|slug)$"
OWNED = r"(?i)user|account|order|payment|invoice|profile|admin|customer|card|wallet|transaction|document|file|report"
PATH_PARAM = r"\{[^}]*\}|:[A-Za-z_]\w*"
CHANGING = ["POST", "PUT", "PATCH", "DELETE"]
#: Private addresses, internal host names, names of request parameters.
PRIVATE_IP = r"\b(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}|127\.0\.0\.1|169\.254\.\d{1,3}\.\d{1,3})\b"
INTERNAL_HOST = r"\b(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+(?:internal|local|svc|corp|intranet|lan|home|test)\b|localhost:\d+"
PARAMETERS = [
    r"req\.(?:query|body|params)\.(\w+)",
    r"""request\.args\.get\(\s*['"](\w+)""",
    r"""request\.(?:form|values|POST|GET)\[\s*['"](\w+)""",
    r"""\$_(?:GET|POST|REQUEST|COOKIE)\[\s*['"](\w+)""",
    r"params\[:?(\w+)\]",
    r'c\.(?:Query|Param|PostForm)\(\s*"(\w+)"',
]
#: Fields of GraphQL operations; marks, paths and methods of OpenAPI files, and the lines that may hold a mark.
GRAPHQL_TYPE = r"^\s*type\s+(Query|Mutation)\b"
GRAPHQL_FIELD = r"^\s*(\w+)\s*(?:\([^)]*\))?\s*:"
OPENAPI_PATH = r"""^\s{2,}(/[^\s:"]*)\s*:"""
OPENAPI_METHOD = r"^\s{4,}(get|post|put|patch|delete)\s*:"
OPENAPI_MARK = r"""^\s*(?:openapi:|swagger:)|"openapi"|"swagger\""""
OPENAPI_LINES = 31
