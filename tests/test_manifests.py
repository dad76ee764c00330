"""Lockfiles as they stand in projects: what is locked, who needs whom, and what source files reach."""

import json

import pytest

from riskloom.sources import manifests

NPM = {"lockfileVersion": 3, "packages": {
    "": {"name": "app", "dependencies": {"a": "^1", "@s/x": "1"}, "devDependencies": {"d": "1"}},
    "node_modules/a": {"version": "1.0.0", "dependencies": {"b": "^2", "missing": "1"}}, "node_modules/a/node_modules/b": {"version": "2.0.0"},
    "node_modules/b": {"version": "1.0.0"}, "node_modules/@s/x": {"version": "3.0.0", "dependencies": {"b": "^1"}, "optionalDependencies": {"a": "1"}},
    "node_modules/d": {"version": "4.0.0", "dev": True}, "packages/own": {"version": "0.0.1"},
}}
NPM_1 = {"lockfileVersion": 1, "dependencies": {"a": {"version": "1.0.0", "requires": {"b": "2"}, "dependencies": {"b": {"version": "2.0.0"}}}, "b": {"version": "1.0.0"}, "c": {"version": "1.0.0", "requires": {"b": "1"}}}}
YARN = '# yarn lockfile v1\n\n\n"@s/x@^1.0.0", "@s/x@^1.1.0":\n  version "1.2.0"\n  resolved "https://r/x"\n  dependencies:\n    b "^2.0.0"\n\nb@^2.0.0:\n  version "2.1.0"\n\nlone@*:\n  version "9.0.0"\n'
BERRY = '__metadata:\n  version: 6\n\n"app@workspace:.":\n  version: 0.0.0-use.local\n  resolution: "app@workspace:."\n  dependencies:\n    "@s/x": ^1.0.0\n    b: "npm:^2.0.0"\n  languageName: unknown\n\n"@s/x@npm:^1.0.0":\n  version: 1.2.0\n  dependencies:\n    b: ^2.0.0\n  checksum: 00\n\n"b@npm:^2.0.0, b@npm:^2.1.0":\n  version: 2.1.0\n'
GEM = "PATH\n  remote: .\n  specs:\n    own (0.1)\n      rack\n\nGEM\n  remote: https://rubygems.org/\n  specs:\n    rack (2.2.3)\n    rack-test (1.1.0)\n      rack (>= 1.0, < 3)\n    nokogiri (1.13.0-x86_64-linux)\n\nPLATFORMS\n  ruby\n\nDEPENDENCIES\n  own!\n  rack-test (~> 1.1)\n"
CARGO = '[[package]]\nname = "app"\nversion = "0.1.0"\ndependencies = [\n "rand 0.8.5",\n "serde-json",\n]\n\n[[package]]\nname = "rand"\nversion = "0.7.0"\nsource = "registry+x"\n\n[[package]]\nname = "rand"\nversion = "0.8.5"\nsource = "registry+x"\ndependencies = ["libc"]\n\n[[package]]\nname = "libc"\nversion = "0.2.1"\nsource = "registry+x"\n\n[[package]]\nname = "serde-json"\nversion = "1.0.0"\nsource = "registry+x"\ndependencies = [\n "rand 0.7.0",\n]\n'
COMPOSER = {"packages": [{"name": "v/http", "version": "v6.1", "require": {"php": ">=8", "v/psr": "^1"}, "autoload": {"psr-4": {"V\\Http\\": "src/"}}}, {"name": "v/psr", "version": "1.0", "autoload": {"psr-4": {"Psr\\": ["a", "b"]}}}], "packages-dev": [{"name": "v/test", "version": "9.0"}]}
GO = "module example.com/app\n\ngo 1.21\n\nrequire github.com/one/a v1.2.3\n\nrequire (\n\tgithub.com/two/b/v2 v2.0.0 // indirect\n\tgolang.org/x/net v0.1.0\n)\n\nreplace github.com/one/a => ../a\n"
PIP = "# comment\nFlask==2.0.1\nrequests[security] == 2.25.0 ; python_version<'3'\nPyYAML==5.3 --hash=sha256:0\nloose>=1\nwild==1.*\n-e git+https://x\n"


@pytest.mark.parametrize("read,text,packages,edges", [
    (manifests._npm, json.dumps(NPM), {("a", "1.0.0", False), ("b", "2.0.0", False), ("b", "1.0.0", False), ("@s/x", "3.0.0", False), ("d", "4.0.0", True)}, {("", "a@1.0.0"), ("", "@s/x@3.0.0"), ("", "d@4.0.0"), ("a@1.0.0", "b@2.0.0"), ("@s/x@3.0.0", "b@1.0.0"), ("@s/x@3.0.0", "a@1.0.0")}),
    (manifests._npm, json.dumps(NPM_1), {("a", "1.0.0", False), ("b", "2.0.0", False), ("b", "1.0.0", False), ("c", "1.0.0", False)}, {("", "a@1.0.0"), ("", "c@1.0.0"), ("a@1.0.0", "b@2.0.0"), ("c@1.0.0", "b@1.0.0")}),
    (manifests._yarn, YARN, {("@s/x", "1.2.0", False), ("b", "2.1.0", False), ("lone", "9.0.0", False)}, {("@s/x@1.2.0", "b@2.1.0"), ("", "@s/x@1.2.0"), ("", "lone@9.0.0")}),
    (manifests._yarn, BERRY, {("@s/x", "1.2.0", False), ("b", "2.1.0", False)}, {("", "@s/x@1.2.0"), ("", "b@2.1.0"), ("@s/x@1.2.0", "b@2.1.0")}),
    (manifests._gem, GEM, {("own", "0.1", False), ("rack", "2.2.3", False), ("rack-test", "1.1.0", False), ("nokogiri", "1.13.0-x86_64-linux", False)}, {("own@0.1", "rack@2.2.3"), ("rack-test@1.1.0", "rack@2.2.3"), ("", "own@0.1"), ("", "rack-test@1.1.0")}),
    (manifests._cargo, CARGO, {("rand", "0.7.0", False), ("rand", "0.8.5", False), ("libc", "0.2.1", False), ("serde-json", "1.0.0", False)}, {("", "rand@0.8.5"), ("", "serde-json@1.0.0"), ("rand@0.8.5", "libc@0.2.1"), ("serde-json@1.0.0", "rand@0.7.0")}),
    (manifests._composer, json.dumps(COMPOSER), {("v/http", "6.1", False), ("v/psr", "1.0", False), ("v/test", "9.0", True)}, {("v/http@6.1", "v/psr@1.0"), ("", "v/http@6.1"), ("", "v/test@9.0")}),
    (manifests._go, GO, {("github.com/one/a", "1.2.3", False), ("github.com/two/b/v2", "2.0.0", False), ("golang.org/x/net", "0.1.0", False)}, {("", "github.com/one/a@1.2.3"), ("", "github.com/two/b/v2@2.0.0"), ("", "golang.org/x/net@0.1.0")}),
    (manifests._pip, PIP, {("Flask", "2.0.1", False), ("requests", "2.25.0", False), ("PyYAML", "5.3", False)}, {("", "Flask@2.0.1"), ("", "requests@2.25.0"), ("", "PyYAML@5.3")}),
])
def test_readers(read, text, packages, edges):
    assert read(text) == (packages, edges)


@pytest.mark.parametrize("read", list(manifests._READERS.values()))
@pytest.mark.parametrize("text", ["", "{", "[]", "null", '{"packages": [1, {"name": 3}], "dependencies": {"a": "x"}}', "[[package]]\n", "GEM\n      x\n", "\t\n: :\n  version\n"])
def test_broken_files_have_no_packages(read, text):
    packages, edges = read(text)
    assert all(isinstance(p[0], str) for p in packages) and isinstance(edges, set)


SOURCES = {
    "p/a.ts": "import { f } from '@s/x/deep';\nimport './own';\nconst q = require(\"d\");\nexport * from \"node:fs\";", "p/m.py": "from yaml import load\nimport os, flask.views as v", "p/m.go": 'import (\n\tb "github.com/two/b/v2/sub"\n\t"fmt"\n)',
    "p/m.rb": "require 'rack/test'\n", "p/m.rs": "use serde_json::Value;\n", "p/m.php": "use V\\Http\\Client;",
}


def _modules(spark, files):
    rows = [(p, n, line) for p, text in files.items() for n, line in enumerate(text.split("\n"), 1)]
    return manifests.imported(spark.createDataFrame(rows, "path string, line_no int, line string"))


def test_what_source_files_reach(spark):
    modules = _modules(spark, SOURCES)
    assert {(r["ecosystem"], r["module"]) for r in modules.collect()} == {("npm", "@s/x"), ("npm", "d"), ("npm", "node:fs"), ("PyPI", "yaml"), ("PyPI", "os"), ("PyPI", "flask"), ("Go", "github.com/two/b/v2/sub"), ("RubyGems", "rack/test"), ("crates.io", "serde_json"), ("Packagist", "V\\Http\\Client")}
    files = {"p/package-lock.json": json.dumps(NPM), "p/package.json": '{"dependencies": {"zzz": "^1.0.0"}}', "q/package.json": '{"dependencies": {"d": "~1.2.3", "any": "*"}}', "p/requirements.txt": PIP, "p/go.mod": GO, "p/Gemfile.lock": GEM, "p/Cargo.lock": CARGO, "p/composer.lock": json.dumps(COMPOSER), "p/node_modules/y/package.json": '{"dependencies": {"no": "1"}}', "p/broken/Cargo.lock": "[[", "p/null/yarn.lock": None}
    found = manifests.locked(spark.createDataFrame(list(files.items()), "path string, content string"))
    rows = manifests.reach(found, modules).collect()
    made = {(r["project"], f"{r['name']}@{r['version']}"): (r["steps"], r["way"]) for r in rows if r["reachable"]}
    assert made == {
        ("p", "@s/x@3.0.0"): (0, "@s/x@3.0.0"), ("p", "b@1.0.0"): (1, "@s/x@3.0.0 > b@1.0.0"), ("p", "a@1.0.0"): (1, "@s/x@3.0.0 > a@1.0.0"), ("p", "b@2.0.0"): (2, "@s/x@3.0.0 > a@1.0.0 > b@2.0.0"), ("p", "d@4.0.0"): (0, "d@4.0.0"), ("q", "d@1.2.3"): (0, "d@1.2.3"),
        ("p", "PyYAML@5.3"): (0, "PyYAML@5.3"), ("p", "Flask@2.0.1"): (0, "Flask@2.0.1"), ("p", "github.com/two/b/v2@2.0.0"): (0, "github.com/two/b/v2@2.0.0"), ("p", "rack-test@1.1.0"): (0, "rack-test@1.1.0"), ("p", "rack@2.2.3"): (0, "rack@2.2.3"),
        ("p", "serde-json@1.0.0"): (0, "serde-json@1.0.0"), ("p", "rand@0.7.0"): (1, "serde-json@1.0.0 > rand@0.7.0"), ("p", "v/http@6.1"): (0, "v/http@6.1"), ("p", "v/psr@1.0"): (1, "v/http@6.1 > v/psr@1.0"),
    }
    idle = {r["name"] for r in rows if not r["reachable"]}
    assert {"requests", "own", "nokogiri", "libc", "v/test", "golang.org/x/net"} <= idle and not {"zzz", "no"} & {r["name"] for r in rows}


def test_all_gems_count_where_all_are_loaded(spark):
    found = manifests.locked(spark.createDataFrame([("Gemfile.lock", GEM)], "path string, content string"))
    assert all(r["reachable"] for r in manifests.reach(found, _modules(spark, {"a.rb": "Bundler.require(*groups)"})).collect())
    none = manifests.reach(found, _modules(spark, {"a.rb": "# nothing"})).collect()
    assert len(none) == 4 and not any(r["reachable"] for r in none)
