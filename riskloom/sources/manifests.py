"""Dependency manifests and lockfiles of six ecosystems as one table of packages and one of edges."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import checkpointed, scratch_tables
from ..shipping import ship

#: File names that are read, their ecosystem, and the reader's key.
READ = {
    "package-lock.json": ("npm", "npm"), "yarn.lock": ("npm", "yarn"), "package.json": ("npm", "direct"), "requirements.txt": ("PyPI", "pip"), "go.mod": ("Go", "go"),
    "Gemfile.lock": ("RubyGems", "gem"), "Cargo.lock": ("crates.io", "cargo"), "composer.lock": ("Packagist", "composer"),
}
#: Python packages whose import has another name.
IMPORT_NAMES = {"pyyaml": "yaml", "beautifulsoup4": "bs4", "pillow": "PIL", "scikit-learn": "sklearn", "opencv-python": "cv2", "python-dateutil": "dateutil", "msgpack-python": "msgpack", "protobuf": "google", "attrs": "attr", "pyjwt": "jwt", "python-dotenv": "dotenv", "mysqlclient": "MySQLdb", "psycopg2-binary": "psycopg2", "djangorestframework": "rest_framework", "pycryptodome": "Crypto"}
#: The node of a project itself.
ROOT = ""


def _node(name: str, version: str) -> str:
    return f"{name}@{version}"


def _object(text: str) -> dict:
    try:
        made = json.loads(text)
    except ValueError:
        return {}
    return made if isinstance(made, dict) else {}


def _names(value) -> list[str]:
    return [k for k in value if isinstance(k, str)] if isinstance(value, dict) else []


def _npm(text: str):
    """package-lock.json: places under node_modules (2 and 3), or nested dependencies (1). A name is looked up from its user's folder upward."""
    made = _object(text)
    places: dict[tuple[str, ...], dict] = {}
    if isinstance(made.get("packages"), dict):
        wanted = []
        for place, entry in made["packages"].items():
            at = tuple(p.strip("/") for p in re.split(r"(?:^|/)node_modules/", place)[1:])
            if isinstance(entry, dict) and at:
                places[at] = entry
            elif isinstance(entry, dict):  # the project itself, and parts of it with a manifest of their own
                wanted += _names(entry.get("dependencies")) + _names(entry.get("devDependencies")) + _names(entry.get("optionalDependencies"))
        needs = lambda e: _names(e.get("dependencies")) + _names(e.get("optionalDependencies")) + _names(e.get("peerDependencies"))
    else:
        todo = [((), made.get("dependencies"))]
        while todo:
            at, inner = todo.pop()
            for name in _names(inner):
                if isinstance(inner[name], dict):
                    places[(*at, name)] = inner[name]
                    todo.append(((*at, name), inner[name].get("dependencies")))
        users = {n for e in places.values() for n in _names(e.get("requires"))}
        wanted = [p[0] for p in places if len(p) == 1 and p[0] not in users]
        needs = lambda e: _names(e.get("requires"))
    nodes = {p: (e.get("name") or p[-1], str(e["version"])) for p, e in places.items() if e.get("version")}

    def found(at: tuple[str, ...], name: str):
        return next((nodes[(*at[:k], name)] for k in range(len(at), -1, -1) if (*at[:k], name) in nodes), None)

    packages = {(*n, bool(places[p].get("dev"))) for p, n in nodes.items()}
    edges = {(ROOT, _node(*found((), n))) for n in wanted if found((), n)}
    edges |= {(_node(*nodes[p]), _node(*found(p, n))) for p in nodes for n in needs(places[p]) if found(p, n)}
    return packages, edges


def _yarn(text: str):
    """yarn.lock of both kinds: a block's head lists name@range, its dependencies are looked up by the same words. What no other block asks for is direct."""
    blocks, of = [], {}
    for raw in text.split("\n"):
        line = raw.rstrip("\r")
        if not line.strip() or line.startswith("#"):
            continue
        if not line[0].isspace():
            keys = [k.strip().strip('"') for k in line.rstrip(":").replace('"', "").split(",")]
            block = {"keys": [re.sub(r"@npm:", "@", k) for k in keys], "version": "", "needs": [], "open": False}
            blocks.append(block)
            continue
        if not blocks:
            continue
        block, word = blocks[-1], line.strip()
        if len(line) - len(line.lstrip()) == 2:
            m = re.match(r'version:? "?([^"]+)"?$', word)
            block["version"] = m[1] if m else block["version"]
            block["open"] = word in ("dependencies:", "optionalDependencies:")
        elif block["open"]:
            m = re.match(r'"?([^"\s:]+)"?:? +"?([^"]+)"?$', word)
            if m:
                block["needs"].append(f"{m[1]}@{re.sub(r'^npm:', '', m[2])}")
    for b in blocks:
        name = b["keys"][0][: max(0, b["keys"][0].rfind("@"))]
        if b["version"] and name and not any("@workspace:" in k for k in b["keys"]):
            of |= dict.fromkeys(b["keys"], (name, b["version"]))
    packages = {(*n, False) for n in of.values()}
    edges = {(_node(*of[b["keys"][0]]), _node(*of[n])) for b in blocks if b["keys"][0] in of for n in b["needs"] if n in of}
    used = {c for _, c in edges}
    own = [n for b in blocks if any("@workspace:" in k for k in b["keys"]) for n in b["needs"] if n in of]
    return packages, edges | ({(ROOT, _node(*of[n])) for n in own} if own else {(ROOT, _node(*n)) for n in of.values() if _node(*n) not in used})


def _direct(text: str):
    """package.json alone: what it asks for, at the version that its range starts with."""
    made = _object(text)
    asked = {(n, str(made[part][n]), part == "devDependencies") for part in ("dependencies", "devDependencies") for n in _names(made.get(part))}
    packages = {(n, m[0], dev) for n, v, dev in asked if (m := re.search(r"\d[^\s|]*", v))}
    return packages, {(ROOT, _node(n, v)) for n, v, _ in packages}


def _pip(text: str):
    pins = [re.match(r"\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*==\s*([^\s;,#\\]+)", line) for line in text.split("\n")]
    packages = {(m[1], m[2], False) for m in pins if m and "*" not in m[2]}
    return packages, {(ROOT, _node(n, v)) for n, v, _ in packages}


def _go(text: str):
    """go.mod names all modules, needed ones of needed ones marked; whom those serve isn't said, so all hang from the project."""
    packages, inside = set(), False
    for raw in text.split("\n"):
        line = raw.split("//")[0].strip()
        if line.startswith("require") and line.endswith("("):
            inside = True
        elif line == ")":
            inside = False
        elif m := re.match(r"(\S+)\s+v(\S+)$" if inside else r"require\s+(\S+)\s+v(\S+)$", line):
            packages.add((m[1], m[2], False))
    return packages, {(ROOT, _node(n, v)) for n, v, _ in packages}


def _gem(text: str):
    version, needs, direct, section, last = {}, [], [], "", ""
    for line in text.split("\n"):
        if line and not line[0].isspace():
            section = line.strip()
        elif section in ("GEM", "PATH", "GIT") and (m := re.match(r"    ([^\s(]+) \(([^)]+)\)$", line)):
            last = m[1]
            version[last] = m[2]
        elif section in ("GEM", "PATH", "GIT") and last and (m := re.match(r"      ([^\s(]+)", line)):
            needs.append((last, m[1]))
        elif section == "DEPENDENCIES" and (m := re.match(r"  ([^\s(!]+)", line)):
            direct.append(m[1])
    edges = {(_node(a, version[a]), _node(b, version[b])) for a, b in needs if b in version}
    return {(n, v, False) for n, v in version.items()}, edges | {(ROOT, _node(n, version[n])) for n in direct if n in version}


def _cargo(text: str):
    """Cargo.lock: packages without a source are the project's own; a dependency names a version where several are locked."""
    blocks = []
    for part in re.split(r"^\[\[package\]\]\s*$", text, flags=re.M)[1:]:
        field = lambda name, part=part: (re.search(rf'^{name} = "([^"]*)"', part, re.M) or ["", ""])[1]
        listed = re.search(r"^dependencies = \[(.*?)\]", part, re.M | re.S)
        blocks.append((field("name"), field("version"), bool(field("source")), re.findall(r'"([^"]+)"', listed[1]) if listed else []))
    versions: dict[str, list[str]] = {}
    for name, version, _, _ in blocks:
        versions.setdefault(name, []).append(version)
    foreign = {(n, v) for n, v, source, _ in blocks if source}
    edges = set()
    for name, version, source, needs in blocks:
        for need in needs:
            other, *said = need.split(" ")
            for v in [said[0]] if said else versions.get(other, [])[:1]:
                if (other, v) in foreign:
                    edges.add((_node(name, version) if source else ROOT, _node(other, v)))
    return {(n, v, False) for n, v in foreign}, edges


def _composer(text: str):
    made = _object(text)
    rows = [(p, dev) for part, dev in (("packages", False), ("packages-dev", True)) for p in (made.get(part) or []) if isinstance(p, dict) and p.get("name") and p.get("version")]
    version = {p["name"]: str(p["version"]).removeprefix("v") for p, _ in rows}
    edges = {(_node(p["name"], version[p["name"]]), _node(n, version[n])) for p, _ in rows for n in _names(p.get("require")) if n in version}
    used = {c for _, c in edges}
    return {(p["name"], version[p["name"]], dev) for p, dev in rows}, edges | {(ROOT, _node(n, v)) for n, v in version.items() if _node(n, v) not in used}


def _namespaces(text: str) -> list[tuple[str, str]]:
    """(package, namespace) of the PSR-4 entries of a composer.lock."""
    rows = [p for part in ("packages", "packages-dev") for p in (_object(text).get(part) or []) if isinstance(p, dict)]
    return [(p["name"], space.strip("\\")) for p in rows if p.get("name") for space in _names((p.get("autoload") or {}).get("psr-4"))]


_READERS = {"npm": _npm, "yarn": _yarn, "direct": _direct, "pip": _pip, "go": _go, "gem": _gem, "cargo": _cargo, "composer": _composer}


def _read(batches):
    for batch in batches:
        out = {c: [] for c in ("project", "ecosystem", "what", "name", "version", "dev", "parent", "child")}
        for project, base, content in zip(*(batch.column(c).to_pylist() for c in ("project", "base", "content")), strict=True):
            ecosystem, reader = READ[base]
            packages, edges = _READERS[reader](content or "")
            spaces = _namespaces(content or "") if reader == "composer" else []
            rows = [("package", n, v, d, None, None) for n, v, d in sorted(packages)] + [("edge", None, None, None, a, b) for a, b in sorted(edges)] + [("namespace", n, s, None, None, None) for n, s in spaces]
            for row in rows:
                for c, value in zip(out, (project, ecosystem, *row), strict=True):
                    out[c].append(value)
        yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.bool_() if c == "dev" else pa.string()) for c, v in out.items()})


def locked(files: DataFrame) -> DataFrame:
    """(project, ecosystem, what, name, version, dev, parent, child) of files(path, content): rows of packages, of edges between name@version nodes,
    of which the project's own parent is empty, and of namespaces (in version) that a package serves.

    The project is the file's folder. A package.json counts only where no lockfile stands beside it; what is in node_modules or vendor doesn't count.
    Broken files have no rows.
    """
    ship(files.sparkSession)
    base = F.regexp_extract("path", "[^/]*$", 0)
    rows = files.select(F.regexp_extract("path", "^(.*)/", 1).alias("project"), base.alias("base"), "content", "path")
    rows = rows.where(F.col("base").isin(list(READ)) & ~F.col("path").rlike("(^|/)(node_modules|vendor)/"))
    beside = rows.where(F.col("base").isin("package-lock.json", "yarn.lock")).select("project").distinct()
    alone = rows.where("base = 'package.json'").join(beside, "project", "left_anti")
    return rows.where("base <> 'package.json'").unionByName(alone).mapInArrow(_read, "project string, ecosystem string, what string, name string, version string, dev boolean, parent string, child string")


def _found(line: Column, pattern: str) -> Column:
    return F.regexp_extract_all(line, F.lit(pattern), F.lit(1))


def imported(lines: DataFrame) -> DataFrame:
    """(ecosystem, module) of lines(path, line_no, line): what source files bring in, in the words of their language; * for Ruby files that load all gems."""
    end = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    js = F.concat(_found(F.col("line"), r"""(?:\bfrom|\bimport|\brequire\s*\(|\bimport\s*\()\s*['"]([^'"./][^'"]*)['"]"""))
    js = F.transform(js, lambda m: F.when(F.startswith(m, F.lit("@")), F.regexp_extract(m, r"^(@[^/]+/[^/]+)", 1)).otherwise(F.regexp_extract(m, r"^([^/]+)", 1)))
    py = F.concat(_found(F.col("line"), r"^\s*from\s+([A-Za-z_]\w*)"), F.transform(F.split(F.regexp_extract("line", r"^\s*import\s+([\w.,\s]+)", 1), ","), lambda m: F.regexp_extract(m, r"^\s*([A-Za-z_]\w*)", 1)))
    rb = F.concat(_found(F.col("line"), r"""^\s*require\s*\(?\s*['"]([^'"]+)['"]"""), F.when(F.rlike("line", F.lit(r"\bBundler\.require\b")), F.array(F.lit("*"))).otherwise(F.array().cast("array<string>")))
    go = _found(F.col("line"), r'^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"\s]+\.[^"\s]+)"\s*$')
    rust = F.concat(_found(F.col("line"), r"^\s*(?:pub\s+)?use\s+([A-Za-z_]\w*)"), _found(F.col("line"), r"^\s*extern\s+crate\s+([A-Za-z_]\w*)"))
    php = _found(F.col("line"), r"^\s*use\s+\\?([A-Za-z_][\w\\]*)")
    kinds = {"npm": (["js", "jsx", "ts", "tsx", "mjs", "cjs"], js), "PyPI": (["py"], py), "RubyGems": (["rb"], rb), "Go": (["go"], go), "crates.io": (["rs"], rust), "Packagist": (["php"], php)}
    each = [lines.where(end.isin(ends)).select(F.lit(name).alias("ecosystem"), F.explode(found).alias("module")) for name, (ends, found) in kinds.items()]
    rows = each[0]
    for e in each[1:]:
        rows = rows.unionByName(e)
    return rows.where("module <> ''").distinct()


def _asked(packages: DataFrame, modules: DataFrame, spaces: DataFrame) -> DataFrame:
    """(project, ecosystem, name, version) of the packages that a module names: by its import name, a module path or what lies below it, or a namespace."""
    low = F.lower("name")
    alias = F.create_map(*[F.lit(x) for pair in IMPORT_NAMES.items() for x in pair])
    plain = F.when(F.col("ecosystem") == "PyPI", F.lower(F.coalesce(F.try_element_at(alias, low), F.replace("name", F.lit("-"), F.lit("_"))))).when(F.col("ecosystem") == "crates.io", F.replace("name", F.lit("-"), F.lit("_")))
    rows = packages.withColumn("module", F.coalesce(plain, F.col("name")))
    wide = modules.withColumn("module", F.when(F.col("ecosystem") == "PyPI", F.lower("module")).otherwise(F.col("module")))
    steps = F.when(F.col("ecosystem").isin("Go", "RubyGems"), F.transform(F.sequence(F.lit(1), F.size(F.split("module", "/"))), lambda n: F.array_join(F.slice(F.split("module", "/"), 1, n), "/"))).otherwise(F.array("module"))
    wide = wide.select("ecosystem", F.explode(steps).alias("module")).distinct()
    dashed = wide.where("ecosystem = 'RubyGems' and module like '%/%'").select("ecosystem", F.replace("module", F.lit("/"), F.lit("-")).alias("module"))
    hit = rows.join(wide.unionByName(dashed).distinct(), ["ecosystem", "module"], "left_semi").drop("module")
    every = modules.where("module = '*'").select("ecosystem").distinct()
    parts = F.split("module", r"\\")
    below = modules.where("ecosystem = 'Packagist'").select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "\\"))).alias("space")).distinct()
    served = spaces.join(below, "space", "left_semi").select("project", "name").distinct()
    php = packages.where("ecosystem = 'Packagist'").join(served, ["project", "name"], "left_semi")
    return hit.unionByName(packages.join(every, "ecosystem", "left_semi")).unionByName(php).distinct()


def reach(found: DataFrame, modules: DataFrame) -> DataFrame:
    """(project, ecosystem, name, version, dev, direct, reachable, steps, way) of the packages of locked() and modules(ecosystem, module).

    A package is reachable if a module names it or a reachable package needs it; steps is the least number of edges from an imported one, way the
    nodes of such a path, of equally short ones the least, and null where there is none. Edges are followed a step a round, and each node is opened once.
    """
    with scratch_tables() as keep:
        found = checkpointed(found)
        packages = found.where("what = 'package'").groupBy("project", "ecosystem", "name", "version").agg(F.min("dev").alias("dev"))
        edges = found.where("what = 'edge'").select("project", "ecosystem", "parent", "child").distinct()
        spaces = found.where("what = 'namespace'").select("project", "name", F.col("version").alias("space"))
        node = F.concat_ws("@", "name", "version")
        front = _asked(packages.select("project", "ecosystem", "name", "version"), modules, spaces).select("project", "ecosystem", node.alias("node"), F.lit(0).alias("steps"), F.array(node).alias("way"))
        front = known = checkpointed(front)
        while True:
            step = front.withColumnRenamed("node", "parent").join(edges.where("parent <> ''"), ["project", "ecosystem", "parent"])
            step = step.join(known.select("project", "ecosystem", F.col("node").alias("child")), ["project", "ecosystem", "child"], "left_anti")
            step = step.groupBy("project", "ecosystem", F.col("child").alias("node")).agg((F.min("steps") + 1).alias("steps"), F.min(F.concat("way", F.array("child"))).alias("way"))
            front = checkpointed(step)
            if front.isEmpty():
                break
            known = known.unionByName(front)
        direct = edges.where("parent = ''").select("project", "ecosystem", F.col("child").alias("node"), F.lit(True).alias("direct"))
        out = packages.withColumn("node", node).join(known, ["project", "ecosystem", "node"], "left").join(direct, ["project", "ecosystem", "node"], "left")
        return keep(out.select("project", "ecosystem", "name", "version", "dev", F.coalesce("direct", F.lit(False)).alias("direct"), F.col("steps").isNotNull().alias("reachable"), "steps", F.array_join("way", " > ").alias("way")))
