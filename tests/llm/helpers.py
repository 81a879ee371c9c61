"""Small tables with the awkward cases that every text operator must survive."""

LONG = "lorem ipsum dolor sit amet " * 8_000

AWKWARD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (3, None),
    (4, ""),
    (5, "   \n\t "),
    (6, LONG),
    (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (None, None),
    (7, "one"),
    (8, "one"),
    (9, "é ü 中文 \U0001f600 Ünïcödé"),
]


def docs(spark, rows=AWKWARD):
    """Documents with columns whose names clash with the operators' own."""
    clash = "doc string, node int, key string, rep int, text_ string, a int, b int, seed int, words string, label string, component long, n_shingles string"
    values = ", ".join(f"NULL AS {c.split()[0]}" for c in clash.split(", "))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    return d.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "cast(length(text) as long) AS n_chars", *values.split(", "))


def empty(spark):
    return docs(spark, []).limit(0)
