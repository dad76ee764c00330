import re

import pytest
from pyspark.sql import functions as F

from riskloom.functions import risk
from riskloom.functions.code_patterns import CODE_RULES, LOOKUP, OWNERSHIP
from riskloom.functions.config_patterns import CONFIG_RULES
from riskloom.functions.dialect import to_java
from riskloom.functions.secret_patterns import SECRET_RULES
from riskloom.operators import compare, lines, packages
from riskloom.operators.dotnet import base_class, guard_of, route_path, scan
from riskloom.operators.taint import follow, parameters


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("kind,severity,placeholder,validated,live,reachable,expected", [
    ("secret", 3, False, True, True, None, 4), ("secret", 3, False, True, False, None, 0), ("secret", 3, False, False, False, None, 3), ("secret", 3, True, False, False, None, 0),
    ("vulnerability", 4, False, False, False, True, 4), ("vulnerability", 4, False, False, False, False, 1), ("vulnerability", 3, False, False, False, None, 3), ("code", 2, False, False, False, None, 2),
])
def test_real_risk(spark, kind, severity, placeholder, validated, live, reachable, expected):
    got = risk.real_risk(F.lit(kind), F.lit(severity), F.lit(placeholder), F.lit(validated), F.lit(live), F.lit(reachable).cast("boolean"))
    assert one(spark, got) == expected


@pytest.mark.parametrize("text,expected", [("abcdefghijklmnopqrstuvwx", "abcd******wx"), ("short", "*****"), ("", "")])
def test_redact(spark, text, expected):
    assert one(spark, risk.redact(F.lit(text))) == expected


def test_entropy_and_grades(spark):
    assert one(spark, risk.entropy(F.lit("aabc"))) == pytest.approx(1.5)
    assert [one(spark, risk.grade(F.lit(s))) for s in (100, 95, 80, 0)] == ["A+", "A", "B-", "F"]
    assert one(spark, risk.audit_score(*map(F.lit, (9, 0, 0, 0, 0)))) == 0


@pytest.mark.parametrize("raw,expected", [("MIT", "permissive"), ("Apache-2.0", "permissive"), ("GPL-3.0", "strong"), ("AGPL-3.0", "strong"), ("LGPL-2.1", "weak"), ("MPL-2.0", "weak"), ("", "unknown"), ("UNLICENSED", "unknown"), (None, "unknown"), ("Custom", "unknown")])
def test_licence_risk(spark, raw, expected):
    assert one(spark, packages.licence_risk(F.lit(raw).cast("string"))) == expected


def test_patterns_mean_the_same_in_both_dialects(spark, duck):
    texts = ["eval (x)", "éeval(x)", "a\x0beval(", "new  Function(", "exec('ls')", "verify = False", "password = \"admin\"", "FROM a:latest", "FROM a:latest\r", "req.user", "owner", "jwt.decode(t)", "jwt.decode(t)\r", "PASSWORDſ='x'", "roſe token = 'abcdefghijklmnop'", "[[x]]", "a&&b", "acl = \"public-read\"", "user_id", "open('/a' + b)", "md5(1)", "MD5(2)"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1)
    patterns = [r[4] for r in CODE_RULES] + [r[3] for r in SECRET_RULES] + [r[3] for r in CONFIG_RULES] + [LOOKUP, OWNERSHIP]
    for at in range(0, len(patterns), 40):
        part = patterns[at : at + 40]
        made = frame.select("t", F.array(*[F.rlike("t", F.lit(to_java(p))) for p in part]).alias("v")).collect()
        for t, v in made:
            assert v == [duck.execute("select regexp_matches(?, ?)", [t, p]).fetchone()[0] for p in part], t


def test_comment_length_and_ownership_gates(spark):
    rows = [("a.py", 1, "eval(x)"), ("a.py", 2, "# eval(x)"), ("a.py", 3, "eval(" + "x" * 1000 + ")"), ("b.js", 1, "User.findById(req.params.id)"), ("c.js", 1, "User.findById(req.params.id)"), ("c.js", 5, "if (x.owner) y"), ("d.cs", 1, "[IgnoreAntiforgeryToken]")]
    frame = spark.createDataFrame(rows, "path string, line_no int, line string")
    found = {(r["path"], r["line_no"], r["rule"]) for r in lines.code_findings(frame).collect()}
    assert found == {("a.py", 1, "py-eval-exec"), ("b.js", 1, "idor")}
    more = spark.createDataFrame([*rows, ("e.cs", 1, "x.AutoValidateAntiforgeryTokenAttribute()")], frame.schema)
    assert ("d.cs", 1, "cs-csrf-disabled") in {(r["path"], r["line_no"], r["rule"]) for r in lines.code_findings(more).collect()}


def test_changed_lines(spark):
    text = ["diff", "+++ b/x.py", "@@ -1,0 +5,2 @@", "+a", "+b", "@@ -9 +12 @@", "-q", "+c", "+++ b/y.py", "@@ -0,0 +1 @@", "+z"]
    got = compare.changed_lines(spark.createDataFrame(list(enumerate(text)), "ord int, text string")).collect()
    assert {tuple(r) for r in got} == {("x.py", 5), ("x.py", 6), ("x.py", 12), ("y.py", 1)}


def test_inventories(spark):
    dpkg = spark.createDataFrame([("Package: a\nVersion: 1\nStatus: install ok installed\n\nPackage: b\nVersion: 2\nStatus: deinstall ok not-installed\n\nPackage: c\nVersion: 3",)], "content string")
    assert {tuple(r) for r in packages.dpkg_packages(dpkg).collect()} == {("a", "1"), ("c", "3")}
    apk = spark.createDataFrame([("P:x\nV:1.2\n\nP:y\nV:3",)], "content string")
    assert {tuple(r) for r in packages.apk_packages(apk).collect()} == {("x", "1.2"), ("y", "3")}
    assert one(spark, packages.ecosystem(F.lit('ID=alpine\nVERSION_ID=3.12.1'))) == "Alpine:v3.12"
    assert one(spark, packages.ecosystem(F.lit('ID=ubuntu\nVERSION_ID="22.04"'))) == "Ubuntu:22.04"


def test_reachability_closure(spark):
    imports = spark.createDataFrame([("a",)], "name string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "parent string, child string")
    assert {r["name"] for r in packages.reachable_packages(imports, edges).collect()} == {"a", "b", "c"}


def test_taint_within_a_file():
    reached = lambda text, end, names=(): [r[0] for r in follow(text, end, set(names))[0]]
    assert reached(["def f():", "    q = request.args.get('q')", "    b = q", "    os.system(b)"], ".py") == [False, True, True, True]
    assert reached(["x = 'safe'", "run(x)"], ".py") == [False, False]
    assert reached(["def a():", " v = input()", "def b():", " run(v)"], ".py") == [False, True, False, False]
    assert reached(["n = int(request.args['n'])", "run(n)"], ".py") == [True, False]
    assert reached(["def g(v):", " run(v)"], ".py", ["g"])[1]
    rows, _ = follow(["v = encodeURIComponent(req.query.a)", "el.innerHTML = v"], ".js", set())
    assert rows[1] == (True, True, 1)
    assert parameters("public IActionResult Run([FromForm] string cmd, Map<a, b> m, int id = 0)") == ["cmd", "m", "id"]


def test_controllers():
    assert guard_of('[Authorize(Roles = "Admin")]') == "role:Admin" and guard_of("[AllowAnonymous]") == "anonymous" and guard_of("x") is None
    assert base_class(["class A(int x) : Base<T>(x), IFoo {"], 0) == "Base" and base_class(["class A : Controller {"], 0) == ""
    assert route_path("api/[controller]", "{id:int}", "UsersController") == "/api/users/{id}" and route_path("api", "/abs", "X") == "/abs"
    routes, classes = scan(['[Route("api/[controller]")]', "[Authorize]", "public class UsersController : Base {", "[HttpGet]", "[AllowAnonymous]", "public int A() {", "[HttpPost]", "public int B() {"])
    assert classes == [("UsersController", "Base", "auth")]
    assert [(r[0], r[1], r[4]) for r in routes] == [("GET", "/api/users", "anonymous"), ("POST", "/api/users", "auth")]


def test_dialect_keeps_python_readable():
    assert re.compile(to_java(r"[a\s]$").replace("(?d)", "").replace(r"\z", r"\Z"))


def test_entry_points_need_no_session():
    import subprocess
    import sys

    root = __file__.rsplit("/tests/", 1)[0]
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 30)"], cwd=root, capture_output=True, text=True)
    assert done.stdout.strip() == "True", done.stderr
