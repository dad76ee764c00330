"""Patterns of risky configuration lines."""

#: Rule id, severity, kind of file, pattern (RE2 dialect).
CONFIG_RULES = [
    ("docker-user-root", "MEDIUM", "dockerfile", r"(?i)^\s*USER\s+root\b"),
    ("docker-latest-tag", "LOW", "dockerfile", r"(?i)^\s*FROM\s+\S+:latest\b"),
    ("docker-add-remote", "MEDIUM", "dockerfile", r"(?i)^\s*ADD\s+https?://"),
    ("docker-curl-pipe-sh", "HIGH", "dockerfile", r"(?i)(?:curl|wget)\s+[^|]*\|\s*(?:sudo\s+)?(?:sh|bash)\b"),
    ("docker-chmod-777", "MEDIUM", "dockerfile", r"chmod\s+(?:-R\s+)?0?777\b"),
    ("compose-privileged", "HIGH", "compose", r"(?i)privileged:\s*true"),
    ("compose-docker-sock", "HIGH", "compose", r"/var/run/docker\.sock"),
    ("compose-host-network", "MEDIUM", "compose", r"""(?i)network_mode:\s*["']?host"""),
    ("gha-script-injection", "HIGH", "gha", r"\$\{\{\s*github\.(?:head_ref|event\.(?:issue|pull_request|comment|review|discussion|head_commit|pages)\.)"),
    ("gha-pull-request-target", "MEDIUM", "gha", r"\bpull_request_target\b"),
    ("gha-unpinned-action", "MEDIUM", "gha", r"(?i)uses:\s*[^@\s]+@(?:main|master)\b"),
    ("tf-public-ingress", "HIGH", "terraform", r'cidr_blocks\s*=\s*\[[^\]]*"0\.0\.0\.0/0"'),
    ("tf-public-acl", "HIGH", "terraform", r'(?i)acl\s*=\s*"public-read(?:-write)?"'),
    ("tf-unencrypted", "MEDIUM", "terraform", r"(?i)(?:encrypted|encryption)\s*=\s*false"),
    ("tf-hardcoded-secret", "HIGH", "terraform", r'(?i)(?:password|secret_key|access_key|private_key)\s*=\s*"[^"$][^"]{6,}"'),
    ("tf-iam-wildcard-action", "HIGH", "terraform", r'(?i)"?(?:Action|actions)"?\s*[:=]\s*\[?\s*"\*"'),
    ("tf-iam-passrole", "HIGH", "terraform", r'(?i)"?iam:PassRole"?'),
    ("tf-iam-assume-wildcard", "HIGH", "terraform", r'(?i)"?Principal"?\s*[:=]\s*(?:"\*"|\{[^}]*"AWS"\s*[:=]\s*"\*")'),
    ("tf-public-rds", "HIGH", "terraform", r"(?i)publicly_accessible\s*=\s*true"),
    ("k8s-privileged", "HIGH", "k8s", r"(?i)privileged:\s*true"),
    ("k8s-run-as-root", "MEDIUM", "k8s", r"(?i)runAsNonRoot:\s*false"),
    ("k8s-host-namespace", "HIGH", "k8s", r"(?i)host(?:Network|PID|IPC):\s*true"),
    ("k8s-allow-priv-esc", "MEDIUM", "k8s", r"(?i)allowPrivilegeEscalation:\s*true"),
]

#: A workflow line that only assigns an expression; names of kinds.
SAFE_ASSIGNMENT = r"""^\s*([\w-]+):\s*"?\$\{\{[^}]*\}\}"?\s*$"""
KIND_NAMES = {"dockerfile": "Dockerfile", "compose": "docker-compose", "gha": "GitHub Actions", "terraform": "Terraform", "k8s": "Kubernetes"}
