"""Command rules as ordered tables: the first row whose programs and pattern fit decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import program_name, strip_assignments

#: Fixed values: (programs, pattern of the lower-cased command, segmentation, collapse mode). No programs: any.
PROFILES = [
    (("git",), r"^\S*git\s+(diff|show|whatchanged)(?!.*--stat)(\s|$)", "hunk", "generic"),
    (("pytest", "rspec", "phpunit", "jest", "vitest", "playwright"), "", "test", "test"),
    (("go", "npm", "yarn", "pnpm"), "test|check", "test", "test"),
    (("cargo",), r"^\S+\s+(test|nextest|bench)(\s|$)", "test", "test"),
    (("cargo",), "", "line", "build"),
    (("rustc", "make", "cmake", "gcc", "g++", "clang", "go", "pip", "pip3", "ruby", "rake", "bundle"), "", "line", "build"),
    (("docker", "podman", "kubectl", "helm", "terraform", "tofu", "aws", "gcloud", "az"), "", "line", "infra"),
    (("grep", "rg", "cat", "tail", "head", "curl"), "", "line", "log"),
    ((), r"\.log", "line", "log"),
    (("psql", "mysql", "sqlite3", "pg_dump", "pg_restore", "mongodump", "redis-cli", "clickhouse"), "", "line", "log"),
    (("java", "javac", "mvn", "gradle", "gradlew", "mvnw", "kotlin", "kotlinc"), "", "line", "build"),
    (("flutter", "dart"), "test|analyze", "test", "test"),
    (("flutter", "dart", "swift", "xcodebuild", "xcode-select", "nx", "turbo", "bazel", "pants", "buck"), "", "line", "build"),
    (("gh", "hub", "glab"), "", "line", "log"),
    (("skaffold", "argocd", "flux", "k3s", "k3d", "kind", "minikube", "kustomize", "cdk", "pulumi", "serverless", "sam"), "", "line", "infra"),
    (("semgrep", "trivy", "snyk", "hadolint", "gosec", "bandit"), "", "line", "build"),
    (("deno",), "test|check", "test", "test"),
    (("deno",), "", "line", "build"),
    (("ping", "traceroute", "nmap", "netstat", "ss", "tcpdump", "htop", "top"), "", "line", "log"),
    (("alembic", "flyway", "liquibase", "knex", "typeorm", "sequelize"), "", "line", "log"),
]

#: Fixed values: (programs, pattern of the lower-cased command, summariser).
SUMMARISERS = [
    (("git",), r"\s(ls-files|ls-tree)(\s|$)|--name-only|--name-status", "passthrough"),
    (("git",), "", "git"),
    (("psql", "mysql", "sqlite3", "pg_dump", "redis-cli"), "", "database"),
    (("semgrep", "trivy", "snyk", "hadolint", "gosec", "bandit"), "", "security"),
    (("gh", "hub", "glab"), r"\slist(\s|$)", "vcs"),
    (("gh", "hub", "glab"), "", "passthrough"),
    (("java", "javac", "mvn", "mvnw", "gradle", "gradlew"), "test", "test"),
    (("java", "javac", "mvn", "mvnw", "gradle", "gradlew"), "", "build"),
    (("flutter", "dart"), "test|analyze", "test"),
    (("flutter", "dart"), "", "build"),
    (("cargo",), r"^\S+\s+(\+\S+\s+)?(test|bench)(\s|$)", "test"),
    (("cargo",), r"^\S+\s+(\+\S+\s+)?(build|check|run|clippy|rustc|fix|doc|install)(\s|$)", "build"),
    (("cargo",), "", "passthrough"),
    (("pytest", "rspec", "phpunit"), "", "test"),
    (("cmake", "gcc", "g++", "clang", "rustc", "go", "pip", "pip3", "ruff", "mypy", "black", "rake", "rubocop", "dotnet"), "test", "test"),
    (("cmake", "gcc", "g++", "clang", "rustc", "go", "pip", "pip3", "ruff", "mypy", "black", "rake", "rubocop", "dotnet"), "", "build"),
    (("vitest", "playwright", "tsc", "eslint", "prettier", "jest", "esbuild", "vite", "npm", "npx", "pnpm", "yarn", "bun"), "", "js"),
    (("grep", "rg", "ag"), "", "filtered"),
    (("docker", "podman", "kubectl", "helm", "terraform", "tofu", "aws", "gcloud", "az", "doctl"), r"\s(-o|--output)[ =]?(json|yaml|name|jsonpath)", "passthrough"),
    (("docker", "podman", "kubectl", "helm", "terraform", "tofu", "aws", "gcloud", "az", "doctl"), "", "cloud"),
    (("curl", "wget", "sort", "uniq", "tar", "zip", "unzip", "apt", "apt-get", "brew", "yum", "dnf"), "", "system"),
]

#: Second words that make a family of their own.
FAMILIES = {
    "git": ("status", "diff", "log", "show", "grep", "blame"),
    "cargo": ("build", "test", "check", "run", "clippy"),
    "npm": ("install", "test", "build", "run", "lint"),
    "yarn": ("install", "test", "build", "run", "lint"),
    "pnpm": ("install", "test", "build", "run", "lint"),
    "bun": ("install", "test", "build", "run", "lint"),
    "kubectl": ("get", "describe", "logs", "apply", "delete"),
    "docker": ("build", "ps", "logs", "run", "images"),
}


def _first(rules: list[tuple], command: Column, column: int, default: str) -> Column:
    program, low = program_name(F.trim(command)), F.lower(strip_assignments(F.trim(command)))
    out = None
    for rule in rules:
        fits = program.isin(*rule[0]) if rule[0] else F.lit(True)
        fits = fits & low.rlike(rule[1]) if rule[1] else fits
        out = F.when(fits, rule[column]) if out is None else out.when(fits, rule[column])
    return out.otherwise(default)


def segmentation(command: Column) -> Column:
    return _first(PROFILES, command, 2, "line")


def collapse_mode(command: Column) -> Column:
    return _first(PROFILES, command, 3, "generic")


def summariser(command: Column) -> Column:
    return _first(SUMMARISERS, command, 2, "generic")


def command_family(command: Column) -> Column:
    words = F.filter(F.split(strip_assignments(F.trim(command)), r"\s+"), lambda x: x != "")
    first, second = F.coalesce(F.get(words, F.lit(0)), F.lit("")), F.coalesce(F.get(words, F.lit(1)), F.lit(""))
    own = F.when(first == "", "unknown")
    for name, seconds in FAMILIES.items():
        own = own.when((first == name) & second.isin(*seconds), F.concat_ws(" ", first, second))
    return own.otherwise(first)
