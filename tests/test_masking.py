"""Equal-length masking against a plain Python version on odd texts."""

import random
import re
from urllib.parse import unquote

from pyspark.sql import functions as F

from corpusloom.functions import secrets as S

ASSIGNMENT = re.compile(r"([\"']?)" + S.SECRET_KEY + r"\1\s*[:=]\s*(?=(?P<value>\"(?:\\.|[^\"\\])*(?:\"|\\?\Z)|'(?:\\.|[^'\\])*(?:'|\\?\Z)|[^,}\r\n]*))", re.I | re.S)
URL = re.compile(S.URL_SCHEMES + r"://[^\s\"'<>`]+", re.I)


def hidden(value):
    return re.sub(r"[^\r\n]", S.MASK, value)


def plain_url(url):
    address, asked, behind = url.partition("?")
    scheme, rest = address.split("://", 1)
    authority, slash, path = rest.partition("/")
    user, at, host = authority.rpartition("@")
    query, mark, fragment = behind.partition("#")
    fields = []
    for item in query.split("&"):
        name, equals, value = item.partition("=")
        fields.append(name + equals + (hidden(value) if re.search(S.SECRET_PARAMETER, unquote(name), re.I) else value))
    return scheme + "://" + hidden(user) + at + host + slash + path + asked + "&".join(fields) + mark + fragment


def plain_mask(text):
    covered = [False] * len(text)
    for m in ASSIGNMENT.finditer(text):
        start, value = m.start("value"), m["value"]
        value = value if value[:1] in "\"'" and value else value.rstrip()
        covered[start : start + len(value)] = [True] * len(value)
    masked = "".join(hidden(ch) if c else ch for ch, c in zip(text, covered))
    return URL.sub(lambda m: plain_url(m[0]), masked)


def odd_texts():
    rng = random.Random(6)
    bits = ["token", "API_KEY", '"password"', "'secret'", "B2_X", "=", ":", " = ", ": ", '"', "'", "\\", "a b", ",", "}", "\n", "\r\n", " ", "\u00a0", "é🙂", "x1", "https://", "u:p@h", "/p?", "sig=1", "&auth=z", "#f", "api%5Fkey=9", "kept=1", "http://a@b@c/d?x", "mysql://r", "\u017fecret"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 24))) for _ in range(1500)]
    texts += ['password = token: "a,b" c', 'token="token=\\"x\\" y" z', "token='open", 'token="a\\', "", "secret:", 'API_KEY = "a\nb", token = c  \n d', "x" * 5000 + " token = " + "y" * 5000]
    return texts


def test_masks_equal_the_plain_version(spark):
    texts = odd_texts()
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string").repartition(4).select("i", S.mask_source("t").alias("m")).collect()
    got = {r.i: r.m for r in rows}
    assert got.pop(-1) is None
    wrong = [(texts[i], m, plain_mask(texts[i])) for i, m in got.items() if m != plain_mask(texts[i])]
    assert not wrong, wrong[:3]
    assert sum(plain_mask(t) != t for t in texts) > 500


def test_no_python_worker(spark):
    plan = spark.createDataFrame([("x",)], "t string").select(S.mask_source("t"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    many = "\n".join(f'token = "{i}"' for i in range(2000))
    assert spark.createDataFrame([(many,)], "t string").select(S.mask_source(F.col("t")).alias("m")).first().m == plain_mask(many)
