"""Labels, multipliers, word lists and templates that results depend on."""

from __future__ import annotations

FAMILIES = ("trace", "git-diff", "log", "json", "yaml", "code", "build", "markdown", "html", "sql", "csv", "dockerfile", "env", "terraform", "text")

# Words added per whitespace-separated word, by family.
TOKENS_PER_WORD = {
    "json": 1.05, "yaml": 1.1, "code": 1.4, "trace": 1.35, "log": 1.25, "git-diff": 1.3, "build": 1.25, "markdown": 1.15,
    "html": 1.2, "sql": 1.15, "csv": 1.05, "dockerfile": 1.15, "env": 1.1, "terraform": 1.25, "text": 1.15,
}
TOKEN_PUNCTUATION = "{}[]():,;<>=!&|"

# Share of tokens that cleaning is expected to save, by family.
SAVINGS_RATE = {
    "trace": 0.75, "log": 0.80, "git-diff": 0.55, "json": 0.37, "yaml": 0.25, "code": 0.15, "build": 0.80, "markdown": 0.27,
    "html": 0.60, "sql": 0.15, "csv": 0.70, "dockerfile": 0.20, "env": 0.10, "terraform": 0.20, "text": 0.0,
}
PRICE_PER_1K_TOKENS = 0.005

# Names a caller may force, and the label each stands for.
FORCED = {
    "diff": "git-diff", "git": "git-diff", "patch": "git-diff", "log": "log", "logs": "log", "json": "json", "yaml": "yaml", "yml": "yaml",
    "rust": "code/rust", "python": "code/python", "py": "code/python", "js": "code/javascript", "javascript": "code/javascript", "ts": "code/typescript",
    "typescript": "code/typescript", "go": "code/go", "java": "code/java", "trace": "trace/javascript", "stack": "trace/javascript", "build": "build/cargo",
    "cargo": "build/cargo", "tsc": "build/typescript", "eslint": "build/eslint", "lint": "build/eslint", "md": "markdown", "markdown": "markdown",
    "html": "html", "xml": "html", "sql": "sql", "csv": "csv", "dockerfile": "dockerfile", "docker": "dockerfile", "env": "env", "dotenv": "env",
    "terraform": "terraform", "tf": "terraform", "hcl": "terraform",
}

# Words by which documents are classified.
SQL_SIGNS = ("SELECT ", "INSERT ", "UPDATE ", "DELETE ", "CREATE TABLE", "ALTER TABLE", "DROP TABLE", "CREATE INDEX", "BEGIN", "COMMIT", "WITH ", "JOIN ", "WHERE ", "GROUP BY", "ORDER BY", "HAVING")
DOCKER_SIGNS = ("FROM ", "RUN ", "COPY ", "ADD ", "CMD ", "ENTRYPOINT ", "EXPOSE ", "ENV ", "WORKDIR ", "ARG ", "LABEL ", "USER ", "VOLUME ", "HEALTHCHECK ")
TERRAFORM_SIGNS = ('resource "', 'variable "', 'output "', 'data "', 'module "', 'provider "', "terraform {", "locals {")
HTML_LINE_STARTS = (
    "<div", "<span", "<p", "<h1", "<h2", "<h3", "<head", "<body", "<meta", "<link", "<script", "<style", "<form", "<input", "<table", "<ul", "<ol", "<li",
    "<a ", "<img", "<br", "<nav", "<header", "<footer", "<section", "<article", "<main", "</",
)

# A variable whose upper-cased name holds one of these is a secret.
SECRET_PARTS = (
    "SECRET", "KEY", "TOKEN", "PASSWORD", "PASSWD", "PWD", "API_KEY", "APIKEY", "AUTH", "CREDENTIAL", "PRIVATE", "ACCESS_KEY", "SIGNING", "ENCRYPTION", "CERT",
    "DSN", "DATABASE_URL", "DB_PASS", "DB_PASSWORD", "STRIPE", "SENDGRID", "TWILIO", "AWS_SECRET", "GITHUB_TOKEN", "NPM_TOKEN", "FIREBASE", "JWT",
    "SESSION_SECRET", "COOKIE_SECRET", "SMTP_PASS", "MAIL_PASSWORD",
)

# SQL words and phrases that are put into capitals.
SQL_WORDS = (
    "select", "from", "where", "join", "left join", "right join", "inner join", "outer join", "cross join", "on", "and", "or", "not", "in", "between", "like",
    "order by", "group by", "having", "limit", "offset", "insert into", "values", "update", "set", "delete from", "create table", "alter table", "drop table",
    "create index", "drop index", "as", "distinct", "union", "union all", "except", "intersect", "exists", "case", "when", "then", "else", "end", "begin",
    "commit", "rollback", "with", "returning", "into", "is null", "is not null", "asc", "desc", "cascade", "primary key", "foreign key", "references",
    "default", "not null", "unique", "check", "constraint", "index", "if exists", "if not exists",
)

# HTML elements whose tags are dropped, and attributes that are dropped.
LAYOUT_TAGS = (
    "div", "span", "section", "nav", "footer", "header", "aside", "main", "article", "figure", "figcaption", "picture", "source", "meta", "link", "br", "hr",
    "input", "button", "form", "label", "fieldset", "legend", "template", "slot", "iframe", "embed", "object", "details", "summary",
)
LAYOUT_ATTRIBUTES = ("class", "style", "id", r"data-[\w-]+", r"aria-[\w-]+", "role", "tabindex", "onclick", "onload", "onchange", "onsubmit")

# Markdown sections that say nothing about the subject.
SIDE_SECTIONS = (
    "installation", "getting started", "prerequisites", "requirements", "contributing", "contributors", "code of conduct", "license", "changelog", "releases",
    "roadmap", "acknowledgements", "acknowledgments", "credits", "sponsor",
)

# JSON keys.
JSON_ERROR_KEYS = frozenset({"error", "errors", "message", "code", "status", "detail", "details", "description", "trace", "stack"})
JSON_ID_KEYS = frozenset({"id", "request_id", "trace_id", "correlation_id"})
JSON_NOISE_KEYS = frozenset({"_links", "_embedded", "@odata.context", "@odata.type", "$schema", "__typename", "createdAt", "updatedAt", "created_at", "updated_at", "modified_at", "modifiedAt"})

# YAML keys for documentation only, and pairs that are usual defaults.
YAML_DOC_KEYS = ("description", "title", "summary", "example", "examples", "$comment", "x-description")
YAML_DEFAULTS = (("enabled", "true"), ("disabled", "false"), ("replicas", "1"), ("debug", "false"), ("verbose", "false"), ("restart", "always"), ("protocol", "http"), ("ssl", "false"), ("tls", "false"))

# Runtime frames that say nothing about the program.
RUST_INTERNAL = ("std::", "core::", "alloc::", "backtrace::", "__rust_", "rust_begin_unwind", "rust_panic", "lang_start", "tokio::runtime::task", "tokio::runtime::blocking")
JAVA_INTERNAL = ("java.lang.", "java.util.", "sun.", "com.sun.", "jdk.")

# Comment marks, import words and attribute marks by language.
SLASH_LANGUAGES = frozenset({"rust", "javascript", "typescript", "js", "ts", "go", "java", "c", "cpp", "csharp", "swift", "kotlin"})
HASH_LANGUAGES = frozenset({"python", "ruby", "bash", "sh", "yaml"})
IMPORT_WORDS = {"rust": ("use ",), "python": ("import ", "from "), **dict.fromkeys(("typescript", "javascript", "js", "ts", "go", "java", "kotlin"), ("import ",))}
ATTRIBUTE_MARKS = {"rust": ("#[derive(", "#[allow(", "#[warn(", "#[serde("), **dict.fromkeys(("python", "typescript", "javascript", "ts", "js", "java", "kotlin"), ("@",))}
ACCESSOR_LANGUAGES = frozenset({"java", "typescript", "ts", "javascript", "js"})

# Prompt texts. A role by family or by language of code.
ROLES = {
    "trace": "You are a senior developer debugging a production issue.",
    "git-diff": "You are a senior developer performing a code review.",
    "log": "You are a senior SRE analyzing production logs.",
    "json": "You are a senior backend developer analyzing API data.",
    "yaml": "You are a senior DevOps engineer reviewing infrastructure config.",
    "code": "You are a senior software engineer.",
    "code/rust": "You are a senior Rust developer.",
    "code/python": "You are a senior Python developer.",
    "code/typescript": "You are a senior TypeScript developer.",
    "code/ts": "You are a senior TypeScript developer.",
    "code/javascript": "You are a senior JavaScript developer.",
    "code/js": "You are a senior JavaScript developer.",
    "code/go": "You are a senior Go developer.",
    "code/java": "You are a senior Java developer.",
    "build": "You are a senior developer diagnosing build failures.",
    "markdown": "You are a senior technical writer reviewing documentation.",
    "html": "You are a senior frontend developer.",
    "sql": "You are a senior database engineer.",
    "csv": "You are a senior data analyst.",
    "dockerfile": "You are a senior DevOps engineer reviewing container configuration.",
    "env": "You are a senior DevOps engineer reviewing environment configuration.",
    "terraform": "You are a senior infrastructure engineer reviewing IaC.",
    "text": "You are a senior software engineer.",
}
# A task by template and, where they differ, by family or language; the empty key is for all others.
TASKS = {
    "fix": {
        "trace": "Identify the root cause of this error and provide a minimal fix.",
        "build": "Fix these build errors. Address each error with the minimal change needed.",
        "code": "Identify any bugs in this code and provide fixes.",
        "git-diff": "Review this diff for bugs introduced by the changes.",
        "": "Identify the issue and provide a minimal fix.",
    },
    "explain": {
        "trace": "Explain what caused this error and why it happened.",
        "git-diff": "Explain what these changes do and their impact.",
        "code": "Explain what this code does, focusing on the core logic.",
        "": "Explain this clearly and concisely.",
    },
    "refactor": {"": "Refactor this code to improve readability and maintainability. List key changes."},
    "review": {
        "code": "Review this code for bugs, security issues, performance problems, and anti-patterns.",
        "git-diff": "Review this diff for correctness, security, and maintainability.",
        "": "Review this for issues and improvements.",
    },
    "debug": {"": "Help me debug this. Identify the most likely cause and suggest a minimal fix."},
    "test": {
        "code/rust": "Write unit tests for this code using #[test] and assert macros.",
        "code/python": "Write pytest tests for this code with clear test names.",
        **dict.fromkeys(("code/typescript", "code/ts", "code/javascript", "code/js"), "Write tests for this code using the project's test framework."),
        "code": "Write comprehensive unit tests for this code.",
        "": "Write tests that verify the behavior described in this content.",
    },
    "optimize": {"": "Identify performance bottlenecks and suggest optimizations. Focus on measurable improvements, not micro-optimizations."},
    "convert": {"": "Convert this to the most appropriate equivalent format, preserving all semantics."},
    "document": {
        "code/rust": "Generate Rustdoc documentation for all public items in this code.",
        "code/python": "Generate docstrings (Google style) for all functions and classes.",
        **dict.fromkeys(("code/typescript", "code/ts", "code/javascript", "code/js"), "Generate JSDoc documentation for all exported functions and types."),
        "code": "Generate documentation for all public functions and types.",
        "": "Generate clear, concise documentation for this content.",
    },
    "migrate": {
        "code": "Migrate this code to the target framework/language. Preserve all behavior and add comments where the migration changes semantics.",
        "yaml": "Migrate this configuration to the target format, preserving all settings.",
        "": "Migrate this to the target format, preserving all semantics and behavior.",
    },
    "security": {
        "code": "Audit this code for security vulnerabilities: injection, auth bypass, data exposure, insecure defaults.",
        "yaml": "Audit this configuration for security issues: exposed secrets, permissive RBAC, missing TLS, open ports.",
        "git-diff": "Review this diff for security regressions: new vulnerabilities, weakened auth, exposed secrets.",
        "": "Audit this for security vulnerabilities and misconfigurations.",
    },
    "": {"": "Review this and provide your analysis."},
}
_CAUSE = "Respond with:\n1. **Root cause**: one sentence\n2. **Fix**: code or config change\n3. **Prevention**: how to avoid this"
# The answer's form by template.
ANSWERS = {
    "fix": {"trace": _CAUSE, "build": _CAUSE, "": "Respond with:\n1. **Issue**: what's wrong\n2. **Fix**: the corrected code\n3. **Why**: brief explanation"},
    "review": {"": "For each issue found, respond with:\n- **Severity**: Critical / Warning / Suggestion\n- **Location**: file and line\n- **Issue**: description\n- **Fix**: suggested change"},
    "debug": {"": "Respond with:\n1. **Most likely cause**: one sentence\n2. **Evidence**: what points to this\n3. **Fix**: minimal code change"},
    "optimize": {"": "For each optimization:\n- **What**: the bottleneck\n- **Why**: impact\n- **How**: the change"},
    "refactor": {"": "Show the refactored code, then list key changes and why."},
    "migrate": {"": "Respond with:\n1. **Migrated code**: the full converted version\n2. **Breaking changes**: list any semantic differences\n3. **Manual steps**: anything that can't be auto-migrated"},
    "security": {"": "For each vulnerability:\n- **Severity**: Critical / High / Medium / Low\n- **Type**: e.g., SQL Injection, XSS, SSRF\n- **Location**: file and line\n- **Fix**: specific remediation"},
    "": {"": ""},
}
