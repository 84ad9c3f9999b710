"""Inputs that every operator has to take, and small tools."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def text(seed: int, n: int) -> str:
    """n words that no other seed shares in runs."""
    return " ".join(f"{WORDS[(seed * 7 + k * (seed % 5 + 1)) % 24]}{seed}x{k}" for k in range(n))


DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

LONG = " ".join(f"w{k % 977}" for k in range(60_000))

ODD = [
    (1, None, "en", "a", None),
    (2, "", "en", None, 0),
    (3, " \t\n ", None, "a", 4),
    (4, "one", "en", "a", 3),
    (5, text(5, 40), "en", "b", 1),
    (6, text(5, 40), "en", "b", 1),
    (6, text(5, 40), "en", "b", 1),
    (7, text(7, 30) + "\n" + text(8, 30) + "\n" + text(9, 30) + "\n\n" + text(5, 20), "de", "b", 1),
    (8, text(7, 30) + "\n" + text(8, 30) + "\n" + text(9, 30) + "\nlast line", "de", "b", 1),
    (9, "ÄÖÜ ß é   　 日本語 😀 <|endoftext|> <|startoftext|> \x00 \x1c end", "fr", "c", 9),
    (10, LONG, "en", "c", 1),
    (None, text(5, 40), "en", "b", 1),
    (None, None, None, None, None),
]


def odd(spark):
    """Documents with nulls, empty and very long texts, repeated rows and clashing extra columns."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, DOC_SCHEMA)
    extra = ["block", "h", "lines", "n_lines", "rep", "token", "_source", "_weight", "_kept", "_score", "ids", "items", "pos", "digest", "unit", "word", "c", "n", "hash", "key"]
    return df.withColumns({c: F.lit(7) for c in extra})


def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def saved(df, folder, name="documents"):
    """A data folder with one table."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def duck(sql, **tables):
    """Rows of DuckDB SQL over Spark tables, as sorted tuples with columns in name order."""
    import duckdb

    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(row[k] for k in order) for row in r.fetchall()), key=repr)


def rows(df):
    names = sorted(df.columns)
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
