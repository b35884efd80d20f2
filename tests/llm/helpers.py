import random
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgkéß"
    v = ["".join(random.Random(i).choices(letters, k=2 + i % 7)) for i in range(vocabulary)]
    return " ".join(r.choice(v) for _ in range(n))


def table(spark, rows):
    """rows: (doc_id, text, lang)."""
    full = [(i, t, lang, None if i is None else f"src{i % 3}", None if t is None else len(t)) for i, t, lang in rows]
    return spark.createDataFrame(full, SCHEMA)


#: Nulls, empties, blanks, odd characters, a repeated row, a very long text, an id that two texts share.
ODD = [
    (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (None, "a row without an id, with some words in it", "en"), (4, "...", "fr"), (5, "Ünï ©öde\r\n  日本語 🙂 \x00\x0b end", "de"),
    (6, "twice the same row " * 5, "en"), (6, "twice the same row " * 5, "en"), (7, prose(1, 60_000), "en"), (8, "x" * 50_000, "en"), (9, "one id", "en"), (9, "another text of that id", "en"), (10, "\n\n\n", "en"), (2**62, "a large id", "es"),
]


def clashing(df):
    """df with columns of names that an operator might want to use itself."""
    from pyspark.sql import functions as F

    taken = {c.lower() for c in df.columns}
    names = "n_words spans items n_lines n_dropped kept lang_pred score rejected n_tokens fits main_text pack piece start length id x y at a b root bands grams row words k __drop __row_a __k Item_Id".split()
    return df.withColumns({n: F.lit(f"own {n}") for n in names if n.lower() not in taken})
