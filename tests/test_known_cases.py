"""Expected rows, written out, for code bases of a few lines: taint, routes, guards, snippets, package files, reports."""

import json

import pytest
from pyspark.sql import functions as F

from riskloom.operators import compare, credentials, documents, dotnet, lines, packages, routes, taint


def code(spark, files):
    rows = [(path, n, line) for path, text in files.items() for n, line in enumerate(text.split("\n"), 1)]
    return spark.createDataFrame(rows, "path string, line_no int, line string")


TAINT = {
    "hops.py": "def ping(request):\n    host = request.args.get('h')\n    command = 'ping ' + host\n    os.system(command)",
    "fixed.py": "def tidy():\n    os.system('ls -la')",
    "scope.py": "def first(request):\n    word = request.args.get('w')\ndef second():\n    os.system(word)",
    "direct.py": "eval(request.args.get('e'))",
    "calls.js": "function entry(req, res) {\n  const uid = req.query.uid;\n  relay(uid);\n}\nfunction relay(a) {\n  store(a);\n}\nfunction store(b) {\n  db.query('SELECT ' + b);\n}",
    "plain.js": "function sum(a, b) {\n  const total = a + b;\n  return db.query('SELECT 1');\n}",
    "keyword.js": "function guard(req) {\n  if (req.query.x) { return; }\n  return 1;\n}\nfunction apart(y) {\n  return exec(y);\n}",
    "ItemsController.cs": "[Route(\"items\")]\npublic class ItemsController(IItems svc) : ControllerBase {\n  [HttpGet(\"{id}\")]\n  public IActionResult Get(string id) { return Ok(svc.FetchItem(id)); }\n}",
    "ItemService.cs": "public class ItemService {\n  public Item FetchItem(string itemId) {\n    return db.Database.ExecuteSqlRaw($\"SELECT * FROM Items WHERE Id = {itemId}\");\n  }\n}",
}


def test_taint_reaches_what_input_reaches(spark):
    reached = {(r["path"], r["line_no"]) for r in taint.taint(code(spark, TAINT)).where("tainted").collect()}
    assert {("hops.py", 4), ("direct.py", 1), ("calls.js", 9), ("ItemService.cs", 3)} <= reached
    assert not {("hops.py", 1), ("fixed.py", 2), ("scope.py", 4), ("keyword.js", 6)} & reached and not any(p == "plain.js" for p, _ in reached)


OWN = "[Route(\"orders\")]\npublic class OrdersController : ControllerBase {\n  [HttpGet(\"\")] public IActionResult L() => Ok();\n  [AllowAnonymous][HttpGet(\"public\")] public IActionResult P() => Ok();\n}"


@pytest.mark.parametrize("program,closed", [
    ("var app=X(); app.MapControllers().RequireAuthorization();", True), ("var app=X();\napp.MapControllers()\n\n   .RequireAuthorization();", True),
    ("var app=X();\napp.MapControllers();\napp.MapGet(\"/health\", h).RequireAuthorization();", False), ("app.MapControllers()\n\n\n\n  .RequireAuthorization();", False),
    ("o.Filters.Add(new AuthorizeFilter(new AuthorizationPolicyBuilder().RequireAuthenticatedUser().Build()));", True), ("app.MapGet(\"/x\", h)\n  .RequireAuthorization();", False),
])
def test_global_guards_of_controllers(spark, program, closed):
    made = {r["route"]: r["auth"] for r in dotnet.controller_routes(code(spark, {"Program.cs": program, "OrdersController.cs": OWN})).collect()}
    assert made == {"/orders": closed, "/orders/public": False}


def test_guards_come_from_bases_and_attributes(spark):
    files = {
        "Base.cs": "namespace A;\n[Authorize]\npublic class BaseController : ControllerBase {}",
        "Mid.cs": "namespace A;\npublic class MidController : BaseController {}",
        "Admin.cs": "namespace A;\n[Route(\"admin\")]\npublic class AdminController : MidController {\n  [HttpGet(\"\")] public IActionResult I() => Ok();\n}",
        "Free.cs": "namespace A;\n[Route(\"free/{id:guid}\")]\npublic class FreeController : Controller {\n  [HttpPost(\"x\")]\n  [ProducesResponseType(200)]\n  [Authorize(AuthenticationSchemes = \"M\")]\n  public IActionResult X() => Ok();\n  [HttpGet(\"open\")]\n  public IActionResult O() => Ok();\n}",
    }
    made = {(r["method"], r["route"]): (r["auth"], r["user_input"]) for r in dotnet.controller_routes(code(spark, files)).collect()}
    assert made == {("GET", "/admin"): (True, False), ("POST", "/free/{id}/x"): (True, True), ("GET", "/free/{id}/open"): (False, True)}


def test_routes_of_many_kinds(spark):
    files = {
        "m.go": "r.GET(\"/api/a\", h)\ne.POST(\"/api/b\", h)\nhttp.HandleFunc(\"/c\", h)", "web.php": "Route::get('/dash', 'C@i');", "routes.rb": "resources :posts",
        "s.graphql": "type Query {\n  users(id: ID): [User]\n}\ntype Mutation {\n  del(id: ID!): Boolean\n}", "api.yaml": "openapi: 3.0.0\npaths:\n  /api/x:\n    get:\n      summary: a\n    post:\n      summary: b",
        "r.js": "app.post('/api/login', limiter, h)\napp.post('/api/reset', h)", "OrdersController.cs": OWN,
    }
    made = {(r["method"], r["route"]): r for r in routes.every_route(code(spark, files)).collect()}
    expected = {("GET", "/api/a"), ("POST", "/api/b"), ("GET", "/dash"), ("GET", "/posts"), ("POST", "/posts"), ("GET", "/posts/:id"), ("PUT", "/posts/:id"), ("DELETE", "/posts/:id"), ("QUERY", "/graphql#users"), ("MUTATION", "/graphql#del"), ("GET", "/api/x"), ("POST", "/api/x"), ("POST", "/api/login"), ("POST", "/api/reset"), ("GET", "/orders"), ("GET", "/orders/public")}
    assert expected <= set(made) and made["POST", "/api/login"]["rate_limited"] and not made["POST", "/api/reset"]["rate_limited"] and made["QUERY", "/graphql#users"]["user_input"]


def test_snippets_keep_what_ends_a_line(spark):
    frame = code(spark, {"a.py": " \teval(x)  \t\r", "b.tf": "  acl = \"public-read\" \r"})
    assert [r["snippet"] for r in lines.code_findings(frame).collect()] == ["eval(x)  \t\r"]
    assert [r["snippet"] for r in lines.config_findings(frame).collect()] == ["acl = \"public-read\""]


def test_changed_lines_of_sections(spark):
    diff = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,0 +2,2 @@\n+one\n+two\n@@ -9 +12 @@\n-old\n+new\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n-gone\n--- a/z\n+++ b/z\n@@ -0,0 +1 @@\n+first"
    frame = spark.createDataFrame(list(enumerate(diff.split("\n"))), "ord long, text string")
    assert sorted(map(tuple, compare.changed_lines(frame).collect())) == [("x", 2), ("x", 3), ("x", 12), ("z", 1)]


def test_package_files(spark):
    files = [("site/a.dist-info/METADATA", "Name: a\nClassifier: License :: OSI Approved :: BSD License\nLicense: MIT\n"), ("site/b.egg-info/PKG-INFO", "Name: b\nLicense: GPL\nLicense-Expression: Apache-2.0\n"), ("x/node_modules/c/package.json", '{"name": "c", "license": {"type": "ISC"}}'), ("package.json", '{"name": "root"}'), ("x/node_modules/d/package.json", "{"), ("site/e.dist-info/METADATA", "License: MIT")]
    made = packages.installed_packages(spark.createDataFrame(files, "path string, content string")).collect()
    assert sorted((r["name"], r["spdx"]) for r in made) == [("a", "BSD License"), ("b", "Apache-2.0"), ("c", "ISC")]
    manifests = [(None, True), ("{", True), ('{"private": true, "license": "MIT"}', True), ('{"license": "MIT"}', False), ('{"license": "Unlicensed"}', True), ("{}", True), ('{"license": "LicenseRef-X"}', True)]
    frame = spark.createDataFrame(manifests, "text string, expected boolean")
    assert frame.where(packages.is_proprietary(F.col("text")) != F.col("expected")).count() == 0


def test_answers_of_providers(spark):
    secrets = spark.createDataFrame([("github-pat", 4, "s1", False), ("github-pat", 4, "s2", False), ("slack-token", 3, "s3", False), ("slack-token", 3, "s4", True)], "rule string, severity int, secret string, placeholder boolean")
    answers = spark.createDataFrame([("github-pat", "s1", True, "repo , gist"), ("github-pat", "s1", False, None), ("github-pat", "s2", False, ""), ("slack-token", "s1", True, "admin:x")], "rule string, secret string, live boolean, scope_header string")
    made = {r["secret"]: (r["validated"], r["live"], r["privileged"], r["real_risk"], r["confidence"], r["scopes"]) for r in credentials.judged(secrets, answers).collect()}
    assert made == {"s1": (True, True, True, 4, 2, ["repo", "gist"]), "s2": (True, False, False, 0, 1, []), "s3": (False, False, False, 3, 1, []), "s4": (False, False, False, 0, 0, [])}


def test_reports_are_documents(spark):
    rows = [("a.py", 1, "py-eval-exec", 3, "eval(\"x\")", "code", 3, 1, "f1", ""), ("b|c.js", 0, "github-pat", 4, "ghp_******ab", "secret", 4, 1, "f2", "Revoke | now."), ("z.tf", 7, "tf", 1, "x", "config", 1, 1, "f3", "")]
    frame = spark.createDataFrame(rows, "path string, line_no int, rule string, severity int, snippet string, kind string, real_risk int, confidence int, fingerprint string, fix string")
    text = lambda made: "".join(r["line"] for r in made.orderBy("part", "ord", "line").collect())
    found = json.loads(text(documents.findings_json(frame)))
    assert [(f["rule_id"], f["real_risk"]) for f in found] == [("github-pat", "CRITICAL"), ("py-eval-exec", "HIGH"), ("tf", "LOW")]
    results = json.loads(text(documents.sarif(frame)))["runs"][0]["results"]
    assert [r["level"] for r in results] == ["error", "error", "note"] and "region" not in results[0]["locations"][0]["physicalLocation"] and results[0]["message"]["text"] == "GitHub Personal Access Token Fix: Revoke | now." and results[1]["message"]["text"] == "Code injection via eval()/exec() — CWE-95 — pattern-based detection"
    assert [f["title"] for f in found] == ["GitHub Personal Access Token", "Code injection via eval()/exec()", "tf"] and found[1]["context"] == {"cwe": "CWE-95", "note": "CWE-95 — pattern-based detection"} and found[0]["context"] == {}
    assert [e["fingerprint"] for e in json.loads(text(documents.baseline(frame)))["entries"]] == ["f1", "f2", "f3"]
    assert json.loads(text(documents.findings_json(frame.where("false")))) == []
    table = [r["line"] for r in documents.markdown(frame).orderBy("part", "ord").collect()]
    assert table[0].endswith("**2 real risk(s)** · 1 filtered as noise · 3 total\n") and table[2] == "| CRITICAL | GitHub Personal Access Token | `b|c.js` | Revoke \\| now. |" and len(table) == 5 and "1 finding(s)" in table[4]
    story = spark.createDataFrame([(0, "a line"), (3, "another")], "part int, line string")
    assert [r["line"] for r in documents.markdown(frame, story).orderBy("part", "ord").collect()][1:4] == ["### Attack path", "- a line", "- another"]
    assert [r["line"] for r in documents.markdown(frame.where("false"), story.where("false")).collect()] == ["## riskloom security report\n\nNo findings — clean scan."]
