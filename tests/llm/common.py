"""Small tables with every hard case, and the plain definitions that operators are held against."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators also use for themselves.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, key string, sid string, n long, salt int, component_id string, id string, `__id` string, row string, spans string, c string, bucket int"


def texts():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghiéßñ") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 160))) for _ in range(40)]
    passage = " ".join(rng.choice(words) for _ in range(70))
    line = "A Line That Many Documents Share, more than forty characters long."
    out = [*base, None, "", " ", "\n\n", "x", "  a  b", "a\tb\r\n\x0b", "é ÉÀ", "日本語 テキスト", "<|endoftext|> it's ", "don't  stop\n\n now", "a" * 3000, "ab " * 2500]
    out += base[:6] + base[:3]
    for k in range(8):
        out.append(" ".join(rng.choice(words) for _ in range(40)) + "\n" + line.upper() * (k % 2) + line * (1 - k % 2) + "\n" + passage + " " + " ".join(rng.choice(words) for _ in range(30)))
    for t in base[10:16]:
        w = t.split()
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    out.append("\n".join(["the same line again and again"] * 60))
    return out


def rows(extra=False):
    out = [(k, t, None if k % 9 == 0 else ("en", "fr")[k % 2], f"s{k % 3}", None) for k, t in enumerate(texts())]
    out += [(None, "a text without an id", "en", None, 1), (3, texts()[3], "fr", "s0", None)]
    return [r + (1, "k", "s", 2, 3, "c", "i", "j", "r", "p", "c", 4) for r in out] if extra else out


def table(spark, extra=False):
    return spark.createDataFrame(rows(extra), CLASHING if extra else SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
