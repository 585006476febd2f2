"""Text columns: visible text, words, redaction, fingerprints, flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks, and what they fold to.
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
FOLD_TO = "aaaaaaceeeeiiiinoooooouuuuyy"

#: The entities that text holds most; ``&amp;`` comes last so that nothing is decoded twice.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}

URL = r"(?i)\b(https?://)(?:[^\s/@<>\"']*@)?([^\s/?#<>\"']+)([^\s?#<>\"']*)(?:\?[^\s#<>\"']*)?(?:#[^\s<>\"']*)?"


def fold(c: Column) -> Column:
    """Lower case without marks."""
    return F.translate(F.lower(c), FOLD_FROM, FOLD_TO)


def tokens(c: Column) -> Column:
    """Folded words of letters and digits, in order."""
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def redact_urls(c: Column) -> Column:
    """URLs keep scheme, host, port and path; user, query and fragment go."""
    return F.regexp_replace(c, URL, "$1$2$3")


def visible_text(c: Column) -> Column:
    """Markup to text: scripts and styles go, block ends become line ends, entities are decoded, blanks squeezed."""
    text = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    text = F.regexp_replace(text, r"(?is)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>|</(p|div|li|tr|h1|h2|h3)>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    text = F.regexp_replace(redact_urls(text), r"[ \t\x0B\f\r\x{00a0}]+", " ")
    text = F.regexp_replace(text, r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def contains_phrase(words: Column, phrase: str) -> Column:
    """Whether the words of the phrase follow each other; parts of longer words don't count."""
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).contains(f" {phrase} ")


def fingerprint(**fields: Column) -> Column:
    """SHA-256 of the fields as JSON in the order of their names; null fields are left out."""
    return F.sha2(F.to_json(F.struct(*(fields[name].alias(name) for name in sorted(fields)))), 256)


def matched_patterns(c: Column, patterns: dict[str, str]) -> Column:
    """The names of the patterns that the text matches, in their order."""
    return F.array_compact(F.array(*(F.when(c.rlike(p), name) for name, p in patterns.items())))


#: What secrets look like.
SECRETS = {
    "aws_access_key": r"AKIA[0-9A-Z]{16}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "hex_token": r"\b[0-9a-f]{32,}\b",
    "bearer": r"(?i)bearer [a-z0-9._-]{16,}",
    "password": r"(?i)(password|passwd|secret|api_key|token) ?[:=] ?[^ ]{6,}",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}",
}


def chunk_flags(text: Column, low: int = 48) -> Column:
    """Why a chunk may need another representation: little text, dense layout, wording about dates."""
    n = F.length(text)
    separators = n - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return F.array_compact(
        F.array(
            F.when(n < low, "low_text"),
            F.when(separators >= 8, "dense_layout"),
            F.when(text.rlike(r"(?i)\b(date|time|due|deadline|week|schedule)\b"), "date_reference"),
        )
    )
