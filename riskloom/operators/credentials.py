"""What validation answers say about secrets that were found: liveness, reach, pairs, remediation, lateral moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import risk
from ..functions.fix_texts import FIXES, OTHER_FIX

#: Scopes of a token that reach far, besides all that begin with admin:.
WIDE_SCOPES = ["repo", "delete_repo", "admin:org", "workflow", "admin:enterprise", "write:packages"]
#: What a live credential opens next; {} is the service.
MOVES = [
    (["AWS"], "Live AWS credential → enumerate IAM, read S3 buckets (often DB backups), pivot to EC2/RDS via the metadata service."),
    (["GitHub", "GitLab"], "Live {} token → read private repos (more secrets & infra), push to CI, and reach deploy keys."),
    (["Stripe"], "Live Stripe key → read customer/payment data and, with a full key, issue refunds or charges."),
    (["Slack"], "Live Slack token → read internal channels (credentials are often pasted there) and DM as the bot."),
    (["npm", "Docker", "PyPI"], "Live {} token → publish a malicious package version — a supply-chain foothold in every consumer."),
    ([""], "Live {} credential → access {} data and any account it administers."),
]


def scopes(header: Column) -> Column:
    """The trimmed, non-empty parts of a comma-parted header; none of a null."""
    return F.filter(F.transform(F.split(F.coalesce(header, F.lit("")), ","), lambda s: F.trim(s)), lambda s: s != "")


def wide_scopes(listed: Column) -> Column:
    return F.exists(listed, lambda s: s.isin(WIDE_SCOPES) | F.startswith(s, F.lit("admin:")))


def admin_scopes(listed: Column) -> Column:
    return F.exists(listed, lambda s: F.contains(F.lower(s), F.lit("admin")))


def between(text: Column, start: str, end: str) -> Column:
    """What stands between the first start and the next end, else an empty text."""
    return F.regexp_extract(text, rf"(?s)^.*?\Q{start}\E(.*?)\Q{end}\E", 1)


def wide_identity(arn: Column) -> Column:
    return F.endswith(arn, F.lit(":root")) | F.contains(F.lower(arn), F.lit("admin")) | F.contains(F.lower(arn), F.lit("root"))


def fix(rule: Column) -> Column:
    out = F.lit(OTHER_FIX)
    for name, text in FIXES.items():
        out = F.when(rule == name, text).otherwise(out)
    return out


def judged(secrets: DataFrame, answers: DataFrame) -> DataFrame:
    """secrets(rule, severity, secret, placeholder, ...) with answers(rule, secret, live, scope_header) joined on both keys.

    A secret without an answer is not validated. Secrets and answers may repeat; of several answers a live one counts.
    Adds validated, live, scopes, privileged, real_risk, confidence and fix.
    """
    one = answers.groupBy("rule", "secret").agg(F.max_by(F.struct("live", "scope_header"), F.struct("live", "scope_header")).alias("a"))
    rows = secrets.join(one, ["rule", "secret"], "left")
    validated = F.col("a").isNotNull()
    live = validated & F.coalesce(F.col("a.live"), F.lit(False))
    rows = rows.withColumns({"validated": validated, "live": live, "scopes": scopes(F.col("a.scope_header"))}).drop("a")
    no = F.lit(False)
    real = risk.real_risk(F.lit("secret"), F.col("severity"), F.col("placeholder"), F.col("validated"), F.col("live"), F.lit(None).cast("boolean"))
    sure = risk.confidence(F.lit("secret"), F.col("rule"), F.lit(""), F.col("placeholder"), F.col("validated"), F.col("live"), no, F.lit(None).cast("boolean"))
    return rows.withColumns({"privileged": F.col("live") & wide_scopes(F.col("scopes")), "real_risk": real, "confidence": sure, "fix": fix(F.col("rule"))})


def partner(text: Column, own: Column, pattern: str) -> Column:
    """The first match of a pattern in the text that isn't the id itself; null if there is none."""
    return F.try_element_at(F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda s: s != own), F.lit(1))


#: Rules whose ids can be tried only with a partner: the pattern of the id, of the partner, and how many characters of the id aren't part of it.
PAIRS = {"twilio-account-sid": ("AC[0-9a-fA-F]{32}", "[0-9a-fA-F]{32}", 2), "aws-access-key": ("(?:AKIA|ASIA)[A-Z0-9]{16}", "[A-Za-z0-9/+]{40}", 0)}


def paired(texts: DataFrame) -> DataFrame:
    """texts(text, ...) with rule, id and partner, a row for each distinct id; the partner is the first match in the text that isn't the id's own part,
    or null. An id whose prefix also reads as hex digits is matched from its first letter, as in any text."""
    kind = lambda rule, own, other, skip: F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(own), F.lit(0))), lambda i: F.struct(F.lit(rule).alias("rule"), i.alias("id"), partner(F.col("text"), F.substring(i, skip + 1, 1 << 20), other).alias("partner")))
    found = F.concat(*[kind(rule, *said) for rule, said in PAIRS.items()])
    columns = [c for c in texts.columns if c != "text"]
    return texts.select(*columns, F.inline(found))


def json_text(body: Column, *fields: str) -> Column:
    """The first of these fields of a JSON object that is there and not empty, else an empty text."""
    return F.coalesce(*[F.nullif(F.get_json_object(body, f"$.{f}"), F.lit("")) for f in fields], F.lit(""))


def lateral_moves(secrets: DataFrame, services: dict[str, str]) -> DataFrame:
    """(move): what the live secrets of known services open, each once."""
    name = F.coalesce(*[F.when(F.col("rule") == r, F.lit(s)) for r, s in services.items()])
    rows = secrets.where("live").select(name.alias("service")).where("service is not null").distinct()
    move = F.lit(None).cast("string")
    for parts, text in reversed(MOVES):
        test = F.lit(False)
        for p in parts:
            test = test | F.contains("service", F.lit(p))
        move = F.when(test, F.replace(F.lit(text), F.lit("{}"), F.col("service"))).otherwise(move)
    return rows.select(move.alias("move")).distinct()
