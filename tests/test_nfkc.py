"""NFKC of texts that need it and of those that don't."""

import re
import unicodedata

from pyspark.sql import functions as F

from skeinflow.functions import text


def test_what_stays_out_of_python_is_normal():
    known = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: re.escape(chr(int(m[1], 16))), text.COMPOSED))
    kept = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not known.match(chr(c))]
    assert len(kept) > 20_000 and all(unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) and unicodedata.normalize("NFKC", f"e{c}") == f"e{c}" for c in kept)


def test_nfkc_of_mixed_rows(spark):
    texts = ["plain", "", None, "ＡＢ", "e\u0301t\u00e9", "2²", "明天，ok", "ﬁn", "한글", "𝔘x", "a\u00a0b"]
    normal = [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]
    df = spark.createDataFrame([(i, t, [t, "ok", None]) for i, t in enumerate(texts)], "i int, t string, a array<string>").orderBy("i")
    found = df.select(text.nfkc(F.col("t")).alias("t"), text.nfkc_each(F.col("a")).alias("a")).collect()
    assert [r["t"] for r in found] == normal and [r["a"] for r in found] == [[t, "ok", None] for t in normal]


