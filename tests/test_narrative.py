"""Sentences of reports for findings written out."""

import json

import pytest
from pyspark.sql import functions as F

from riskloom.operators import credentials, narrative

FINDING = "kind string, rule string, path string, live boolean, privileged boolean, identity string, access array<string>, reachable boolean, real_risk int"
SECRET = lambda rule, path="a", live=True, wide=False, who="", access=(): ("secret", rule, path, live, wide, who, list(access), None, 3)
HOLE = lambda reachable, level: ("vulnerability", "ADV-1", "", None, None, None, None, reachable, level)


@pytest.mark.parametrize("rows,lines", [
    ([], []), ([SECRET("aws-access-key", live=False), HOLE(False, 4), HOLE(True, 2)], []),
    ([SECRET("openai-key")], [(4, narrative.EXPOSED)]), ([HOLE(True, 3)], []),
    ([SECRET("x-key"), HOLE(True, 3)], [(2, narrative.FOOTHOLD)]),
    ([SECRET("github-pat", "git history @ c1 (a, 2024-01-01)"), SECRET("aws-access-key", wide=True, who="root", access=["IAM", "S3"]), SECRET("npm-token", wide=True)],
     [(0, "A live, high-privilege AWS (root) is exposed — an attacker gains IAM, S3."), (0, "A live, high-privilege npm (the account) is exposed — an attacker gains privileged access."), (1, narrative.SEVERAL[0] + "AWS, GitHub, npm" + narrative.SEVERAL[1]), (3, narrative.REMOVED)]),
])
def test_attack_story(spark, rows, lines):
    assert sorted(tuple(r) for r in narrative.attack_story(spark.createDataFrame(rows, FINDING)).collect()) == lines


TARGET = "method string, route string, path string, line_no int, auth boolean, cwe string, rank int"


def test_chains(spark):
    def lines(targets, secrets=()):
        made = narrative.chain_lines(spark.createDataFrame(targets, TARGET), spark.createDataFrame(list(secrets), "service string, live boolean"))
        return {r["part"]: r["line"] for r in made.collect()}

    one = lambda route, cwe, auth=False, rank=0: ("GET", route, "a.js", 1, auth, cwe, rank)
    assert lines([one("/a", None)]) == {} and lines([]) == {}
    made = lines([one("/e", "CWE-95"), one("/c", "CWE-78", True), one("/u", "CWE-434", True), one("/r", "CWE-22", True), one("/f", "CWE-918", True), one("/s", "CWE-89", True)], [("AWS", True), (None, False)])
    assert made[1].startswith("Unauthenticated code injection: GET /e evaluates") and "via GET /u (file upload), then have GET /r include" in made[2] and made[3].endswith("this account is reachable.") and 4 not in made and 5 in made
    made = lines([one("/z", "CWE-78", rank=-2), one("/b", "CWE-78"), one("/u", "CWE-434")], [("GitHub", True)])
    assert made[1].startswith("Unauthenticated RCE: GET /z") and made[2].startswith("Unrestricted upload: GET /u") and set(made) == {1, 2, 5}
    assert set(lines([one("/u", "CWE-434", True)], [("AWS", False)])) == set()


def test_the_gate_counts_in_one_pass(spark):
    rows = spark.createDataFrame([("a", 4), ("b", 2), ("b", 2), ("c", 1)], "fingerprint string, real_risk int")
    known = spark.createDataFrame([("a",), ("a",), ("q",)], "fingerprint string")
    kept, numbers = narrative.gated(rows, known, "medium")
    assert kept.columns == ["fingerprint", "real_risk"] and numbers == {"kept": 3, "suppressed": 1, "highest": 2, "failed": True} and kept.count() == 3
    assert narrative.gated(rows, known, "high")[1]["failed"] is False
    assert narrative.gated(rows.where("false"), known, "info")[1] == {"kept": 0, "suppressed": 0, "highest": 0, "failed": False}


def test_openapi_document_parses(spark):
    routes = [("GET", "/users/:id"), ("ANY", "users/{id}/x-{name}"), ("POST", "/users/:id"), ("QUERY", "/graphql#me"), ("MUTATION", "/graphql#pay"), ("GET", '/odd"quote')]
    found = spark.createDataFrame(routes, "method string, route string")
    text = lambda params: "".join(r["line"] for r in narrative.openapi_document(found, spark.createDataFrame(params, "param string")).orderBy("part", "ord").collect())
    made = json.loads(text([("q",), ("b",), ("q",)]))
    assert set(made["paths"]) == {"/users/{id}", "/users/{id}/x-{name}", "/graphql", '/odd"quote'} and set(made["paths"]["/users/{id}"]) == {"get", "post"}
    assert [(p["name"], p["in"], p["required"]) for p in made["paths"]["/users/{id}/x-{name}"]["get"]["parameters"]] == [("id", "path", True), ("name", "path", True), ("b", "query", False), ("q", "query", False)]
    assert "parameters" not in json.loads(text([]))["paths"]["/graphql"]["get"]


def test_partners(spark):
    sid, token, key, secret = "AC" + "ab" * 16, "cd" * 16, "AKIA" + "Z" * 16, "s/" * 20
    rows = spark.createDataFrame([(1, f"{token} {sid} {sid}"), (2, sid), (3, f"{key}\n{secret}"), (4, key), (5, None), (6, "")], "n int, text string")
    assert {(r["n"], r["rule"], r["id"], r["partner"]) for r in credentials.paired(rows).collect()} == {(1, "twilio-account-sid", sid, token), (2, "twilio-account-sid", sid, sid[:32]), (3, "aws-access-key", key, secret), (4, "aws-access-key", key, None)}


def test_texts_of_answers(spark):
    body = spark.createDataFrame([('{"email": "a@b", "name": ""}',), ('{"name": "n"}',), ("{",), (None,)], "b string")
    assert [r[0] for r in body.select(credentials.json_text(F.col("b"), "name", "email")).collect()] == ["a@b", "n", "", ""]
