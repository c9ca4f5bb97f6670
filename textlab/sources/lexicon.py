"""A small built-in lemma dictionary (lang, token, lemma).

It stands in for a pretrained lemmatiser, which is not available offline.
A lemma of ``--`` means "keep the token" (punctuation).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values: (lang, token, lemma)
BUILTIN_LEMMAS = [
    ("de", "Dies", "dieser"),
    ("de", "sind", "sein"),
    ("de", "Sätze", "Satz"),
    ("de", "ist", "sein"),
    ("de", "zweite", "zweiter"),
    ("de", ".", "--"),
    ("de", "die", "der"),
    ("de", "das", "der"),
    ("de", "den", "der"),
    ("de", "dem", "der"),
    ("de", "des", "der"),
    ("de", "eine", "ein"),
    ("en", "is", "be"),
    ("en", "are", "be"),
    ("en", "was", "be"),
    ("en", "were", "be"),
    ("en", "has", "have"),
    ("en", "had", "have"),
    ("en", ".", "--"),
    ("fr", "les", "le"),
    ("fr", "la", "le"),
    ("fr", "est", "être"),
    ("fr", "sont", "être"),
    ("es", "los", "el"),
    ("es", "las", "el"),
    ("es", "es", "ser"),
]


def builtin_lemmas(spark: SparkSession) -> DataFrame:
    """As a VALUES relation, so that the optimizer knows how small it is (and broadcasts it)."""
    return spark.sql(f"SELECT * FROM {lemma_values_sql()}")


def lemma_values_sql() -> str:
    """The same dictionary as a SQL VALUES list (the oracle uses it too)."""
    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({q(a)}, {q(b)}, {q(c)})" for a, b, c in BUILTIN_LEMMAS)
    return f"(VALUES {rows}) AS lemma_dict(lang, token, lemma)"
