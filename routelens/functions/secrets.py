"""Secret and personal-data patterns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Pattern name, regular expression, and text that must be present for a match to be
# possible (a plain substring test that spares most lines the regular expression).
SECRET_PATTERNS = (
    ("Stripe API Key", r"(?:sk|pk)[-_](?:live|test)[-_][A-Za-z0-9]{20,}", "k"),
    ("JWT Token", r"(?U)Bearer\s+eyJ[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}", "eyJ"),
    (
        "Generic Secret",
        r"(?iU)(?:api[_-]?key|apikey|token|secret|password|passwd|pwd)\s*[=:]\s*[\"']?[A-Za-z0-9_\-]{16,}",
        "",
    ),
    ("AWS Access Key", r"AKIA[0-9A-Z]{16}", "AKIA"),
    ("GitHub Personal Token", r"ghp_[A-Za-z0-9]{36}", "ghp_"),
    ("Slack Bot Token", r"xoxb-[0-9]+-[A-Za-z0-9]+", "xoxb-"),
    ("OpenAI API Key", r"sk-[A-Za-z0-9]{20,}", "sk-"),
    ("Email Address (PII)", r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "@"),
    ("SSN Pattern (PII)", r"(?U)\b\d{3}-\d{2}-\d{4}\b", "-"),
)


def redact(match: Column) -> Column:
    """Keep the first 8 and last 4 characters of long matches, the first 4 of short ones."""
    return F.when(
        F.length(match) > 16,
        F.concat(F.substring(match, 1, 8), F.lit("..."), F.substring(match, -4, 4)),
    ).otherwise(F.concat(F.substring(match, 1, 4), F.lit("****")))


def find_secrets(lines: DataFrame, line: str, keep: list[Column | str]) -> DataFrame:
    """One row ``(*keep, secret_type, match)`` per match; the whole line is scanned.

    Patterns are expanded first and matches second.  A single explode over all matches would make
    Spark add an emptiness test that runs every regular expression a second time.
    """
    found = []
    for name, pattern, needle in SECRET_PATTERNS:
        hits = F.regexp_extract_all(F.col(line), F.lit(pattern), F.lit(0))
        if needle:
            hits = F.when(F.contains(F.col(line), F.lit(needle)), hits)
        found.append(F.struct(F.lit(name).alias("secret_type"), hits.alias("matches")))
    by_pattern = lines.select(*keep, F.inline(F.array(*found)))
    return by_pattern.withColumn("match", F.explode("matches")).drop("matches")
