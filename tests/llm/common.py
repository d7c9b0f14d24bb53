import re
import string

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, score string, rejected string, cell string"

#: Null, empty, blank, short and odd texts; repeated rows; columns whose names operators use inside.
ODD = [None, "", " \t\n ", "One", "two Words", "漢字 １２ ½ Ⅳ \x1c\x85", "a" * 5000, "!" * 300 + " " * 80, "Is it's I'LL don't x", "😀 emoji é è ü " * 20]


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def frame(spark, texts, start=0):
    rows = [(start + i, t, None if i % 4 == 0 else "en", "s", None if t is None else len(t), "x", "y", "z", "r", "c") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(seed, n, vocabulary=400):
    import random

    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))
