"""Fixtures and plain versions that the operators are held against."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, place string, size string"


def texts(seed=3, n=40):
    """Texts with copies, near copies, shared passages, repeats, blanks and a very long one."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(2, 6)))
    vocabulary = [word() for _ in range(120)] + ["the", "of", "and", "in"] * 10
    some = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage, out = some(70), []
    for i in range(n):
        kind = i % 8
        if kind == 0:
            out.append(some(r.randint(60, 160)))
        elif kind == 1:
            out.append(out[-1])
        elif kind == 2:
            w = out[-1].split(" ")
            w[len(w) // 2] = "changed"
            out.append(" ".join(w))
        elif kind == 3:
            out.append(some(20) + " " + passage + "\n" + some(r.randint(1, 40)))
        elif kind == 4:
            out.append((some(9) + "\t") * r.randint(1, 12))
        elif kind == 5:
            out.append("z" * r.randint(1, 400))
        elif kind == 6:
            out.append(r.choice(["", None, " \n", "one", "two words", "A b C d"]))
        else:
            out.append(passage.upper() if i % 16 == 7 else passage + some(3))
    out.append(" ".join([passage, some(6000), passage]))
    return out


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    data = [(i * 3, t, "en", ["a", "b", None][i % 3], None if t is None else len(t), "x", None, "y") for i, t in enumerate(rows)]
    return spark.createDataFrame(data, DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def empty(df):
    return df.where("false")
