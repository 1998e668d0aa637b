"""Texts and tables that every operator has to take."""

import random
import re

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
DOCS = "doc_id long, text string, source string, lang string"


def prose(seed: int, n: int, vocabulary: int = 4000) -> str:
    r = random.Random(seed)
    return " ".join(f"k{r.randrange(vocabulary)}" for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names clash with ours."""
    same = prose(1, 80)
    rows = [
        (1, None, "a", "en"),
        (2, "", None, None),
        (3, "   \n\t ", "a", "en"),
        (4, LONG, "b", "en"),
        (5, same, "a", "en"),
        (6, same, "a", None),
        (6, same, "a", None),
        (None, same, "b", "en"),
        (None, None, None, None),
        (7, "one", "b", "en"),
        (8, "日本語 текст ☃ é́ ퟿", "c", "xx"),
        (9, "!!! ??? ... ,,,", "c", "en"),
    ]
    d = documents(spark, rows)
    for extra in ("key", "h", "score", "n_tokens", "words", "item_id", "jaccard", "hash", "start", "shard", "row", "lists"):
        d = d.selectExpr("*", f"'x' AS `{extra}`")
    return d


def empty(spark):
    return documents(spark, [])


def words(text: str) -> list[str]:
    """The words of textops, said with a regular expression."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or ("À" <= c <= "Þ" and c != "×") else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low) if w]
