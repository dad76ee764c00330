"""A corpus of source lines that Spark derives from the table orders: 24 keys are a file, a key is a line of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES_A_FILE = 24
#: (start of the path, end of the path, lines); the first line is the file's first, the others are dealt by key.
#: @K@ is the key, @M@ the key modulo 50, @H@ the md5 of the key.
KINDS = [
    ("app_", ".js", ["const express = require('express'); // unit @K@", "app.get('/users/:id', (req, res) => {", "app.post('/login_@M@', requireAuth, limiter, (req, res) => {", "app.post('/reset_@M@', (req, res) => {", "router.delete('/orders/:orderId', requireAuth, handler@K@);", "  const v@M@ = req.query.name_@M@;", "  eval(v@M@);", "  element.innerHTML = req.body.html_@M@;", "  db.query('select * from t where id=' + req.params.id);", "  const user = await User.findById(req.params.id);", "  if (user.owner !== req.user.id) return;", "  child_process.exec('ls ' + v@M@);", "  // eval(comment@K@)", "  const h = crypto.createHash('md5').update('@H@');", "  fetch('http://169.254.169.254/latest/@M@');", "  let apiToken_@M@ = \"@H@\";", "  res.cookie('s', v, { httpOnly: false });", "  const t = Math.random();", "  return total@M@;", "});", "router.all('/admin/debug_@M@', (req, res) => {", "  axios(req.body.url_@M@);", "  new RegExp(req.query.p)", "  const host@M@ = 'cache@M@.internal';"]),
    ("views_", ".py", ["import os  # unit @K@", "@app.route('/profile/@M@')", "@login_required", "def handler_@M@():", "    q = request.args.get('q_@M@')", "    os.system('ls ' + q)", "    cur.execute(f'select {q}')", "    eval(q)", "    return render_template('x.html')", "path('accounts/<int:pk>/', view_@M@),", "    pickle.loads(blob_@M@)", "    requests.get(url, verify=False)", "    hashlib.md5(b'@H@')", "    obj = Model.objects.get(pk=request.GET['id'])", "    # eval(q)", "    password = \"changeme\"", "    secret_key_@M@ = '@H@'", "    open('/tmp/' + q)", "@bp.post('/verify_@M@')", "    x@M@ = 1"]),
    ("routes_", ".rb", ["# unit @K@", "resources :invoices_@M@", "get '/health_@M@'", "post '/payments/:id'", "  system(\"ls #{params[:dir]}\")", "  User.where(\"name = #{params[:n]}\")", "  Marshal.load(data_@M@)", "  YAML.load(body_@M@)", "  Doc.find(params[:id])", "  authorize current_user", "def show_@M@", "end", "  x = Digest::MD5.hexdigest('@H@')", "  eval(code_@M@)"]),
    ("page_", ".php", ["<?php // unit @K@", "Route::get('/report/@M@', 'C@index');", "Route::post('/upload_@M@', 'C@up')->middleware('auth');", "echo $_GET['name_@M@'];", "include($_GET['page']);", "unserialize($x@M@);", "$r = mysqli_query(\"select $id\");", "$y@M@ = 2;", "shell_exec($cmd);", "move_uploaded_file($f@M@);", "# eval($z);"]),
    ("main_", ".go", ["package main // unit @K@", "\tr.GET(\"/items/:id\", h@M@)", "\thttp.HandleFunc(\"/debug/@M@\", dbg)", "\texec.Command(\"sh\", \"-c\", q)", "\ttls.Config{InsecureSkipVerify: true}", "func f@M@() {", "\tid := c.Query(\"id_@M@\")", "}", "\ts := md5(x)", "\tr.POST(\"/token_@M@\", rateLimit, issue)", "\t// InsecureSkipVerify: true"]),
    ("Ctl_", ".cs", ["using System; // unit @K@", "  app.MapGet(\"/api/c@M@/{id}\", H);", "  app.MapPost(\"/api/pay@M@\", P).RequireAuthorization();", "  Process.Start(cmd@M@);", "  var c = new SqlCommand(\"select \" + id);", "  [IgnoreAntiforgeryToken]", "  return Redirect(url@M@);", "  cookie.Secure = false;", "  var d = MD5.Create();", "  ValidateIssuer = false,", "  new BinaryFormatter();", "  int n@M@ = 3;", "  options.Filters.Add(new AutoValidateAntiforgeryTokenAttribute());", "  // Process.Start(x)"]),
    ("Api_", ".cs", ["[Route(\"api/[controller]\")] // unit @K@", "[Authorize(Roles = \"Admin@M@\")]", "public class C@M@Controller : Base@M@Controller {", "[HttpGet(\"{id:int}\")]", "[HttpPost]", "[AllowAnonymous]", "public IActionResult Run@M@([FromForm] string cmd, int n = 0) {", "  Process.Start(cmd);", "public class Base@M@Controller : ControllerBase {", "[HttpDelete(\"/all/{key?}\")]", "[Authorize]", "  svc.Handle@M@(cmd);", "}"]),
    ("svc_", ".Dockerfile", ["FROM base@M@:latest", "USER root", "RUN curl http://x/@M@ | sh", "ADD https://x/@M@ /a", "RUN chmod 777 /a", "COPY a@M@ b", "RUN echo @K@"]),
    (".github/workflows/ci_", ".yml", ["name: ci-@K@", "on: pull_request_target", "  - uses: act/x@M@@main", "  - run: echo ${{ github.event.issue.title }}", "    title: ${{ github.event.issue.title }}", "    run: ${{ github.head_ref }}", "  - uses: act/y@0a1b"]),
    ("infra_", ".tf", ["# unit @K@", "cidr_blocks = [\"0.0.0.0/0\"]", "acl = \"public-read\"", "encrypted = false", "password = \"hunter@M@hunter\"", "Action = \"*\"", "publicly_accessible = true", "name = \"n@M@\""]),
    ("deploy_", ".yaml", ["apiVersion: v1 # @K@", "kind: Pod", "  privileged: true", "  runAsNonRoot: false", "  hostNetwork: true", "  allowPrivilegeEscalation: true", "  image: x@M@"]),
    ("schema_", ".graphql", ["# unit @K@", "type Query {", "  users_@M@(id: ID): User", "  total@M@: Int", "}", "type User {", "type Mutation {", "  pay@M@(x: Int): Bool", "  # note"]),
    ("spec_", ".yml", ["openapi: 3.0.0 # unit @K@", "  /api/x@M@:", "    get:", "    post:", "      summary: s@M@", "  /users/{id}:", "    delete:", "paths:"]),
    ("config_", ".env", ["# unit @K@", "URL=postgres://u@M@:pw@M@secret@db.internal/x", "TOKEN=ghp_@H@abcd", "KEY=AKIA@M@ABCDEFGHIJKLMNOP", "MAIL=key-@H@", "HOST=10.0.@M@.7", "mailchimp=@H@-us12", "SHOP=shpat_@H@", "plain=@M@"]),
]


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, line_no, line), one row for each order."""
    kinds = spark.createDataFrame([(k, head, tail, len(lines)) for k, (head, tail, lines) in enumerate(KINDS)], "kind int, head string, tail string, n int")
    texts = spark.createDataFrame([(k, i, line) for k, (_, _, lines) in enumerate(KINDS) for i, line in enumerate(lines)], "kind int, idx int, text string")
    key = F.col("o_orderkey")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.expr(f"o_orderkey div {LINES_A_FILE}").alias("file"), (F.expr(f"o_orderkey % {LINES_A_FILE}") + 1).cast("int").alias("line_no"))
    rows = rows.withColumn("kind", (F.col("file") % len(KINDS)).cast("int")).join(F.broadcast(kinds), "kind")
    rows = rows.withColumn("idx", F.when(F.col("line_no") == 1, 0).otherwise(1 + (key * 31 + F.col("file") * 17) % (F.col("n") - 1)).cast("int")).join(F.broadcast(texts), ["kind", "idx"])
    line = F.replace(F.replace(F.replace("text", F.lit("@K@"), key.cast("string")), F.lit("@M@"), (key % 50).cast("string")), F.lit("@H@"), F.md5(key.cast("string").cast("binary")))
    path = F.concat(F.when(F.col("file") % 7 == 3, "tests/").otherwise("src/"), "head", F.col("file").cast("string"), "tail")
    return rows.select(path.alias("path"), "line_no", line.alias("line"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    return ",\n".join("(" + ", ".join(quoted(v) if isinstance(v, str) else "true" if v is True else "false" if v is False else str(v) for v in r) + ")" for r in rows)


#: The same lines in DuckDB, as common table expressions.
CODE_LINES_SQL = f"""
kinds(kind, head, tail, n) as (values {values([(k, h, t, len(x)) for k, (h, t, x) in enumerate(KINDS)])}),
line_texts(kind, idx, text) as (values {values([(k, i, x) for k, (_, _, lines) in enumerate(KINDS) for i, x in enumerate(lines)])}),
keyed as (select o_orderkey as k, o_orderkey // {LINES_A_FILE} as file, (o_orderkey % {LINES_A_FILE} + 1)::int as line_no from orders),
placed as (select *, case when line_no = 1 then 0 else 1 + (k * 31 + file * 17) % (n - 1) end as idx from keyed join kinds on kind = file % {len(KINDS)}),
code_lines as materialized (select case when file % 7 = 3 then 'tests/' else 'src/' end || head || file || tail as path, line_no,
  replace(replace(replace(text, '@K@', k::varchar), '@M@', (k % 50)::varchar), '@H@', md5(k::varchar)) as line
  from placed join line_texts using (kind, idx))
"""
