import random
import time

from pyspark.sql import functions as F

from foliospark.functions import text as T


def brute(text, lengths):
    """Cut by cut, each the best of all places that are left to it."""
    if "\n" in text and lengths:
        return text.split("\n")
    if len(lengths) < 2:
        return [text]
    if sum(lengths) <= 0:
        return [text] + [""] * (len(lengths) - 1)
    out, start = [], 0
    for i in range(1, len(lengths)):
        most = len(text) - (len(lengths) - i)
        target = round(len(text) * (sum(lengths[:i]) / sum(lengths)))
        cut = start
        if start < most:
            near, window = min(max(target, start), most), max(8, len(text) // 12)
            worth = lambda j: abs(j - near) * 10 - (T.BEFORE.get(text[j - 1], 0) if j else 0) - T.AFTER.get(text[j : j + 1], 0)  # noqa: B023, E731
            cut = min(range(max(start, near - window), min(most, near + window) + 1), key=lambda j: (worth(j), j))
        out.append(text[start:cut])
        start = cut
    return [*out, text[start:]]


def test_distributed(spark):
    rng = random.Random(6)
    rows = [("", [3, 4]), ("a", [1, 1, 1]), ("ab", []), ("ab", [5]), ("x\ny", [1]), ("x\n\ny", [1, 2]), ("x\ny", []), ("abc", [0, 0]), ("abcdef", [0, 5, 0]), ("\U0001f600" * 30, [2, 3]), ("a, b [c] (d) " * 20, [10, 20, 5]), ("aa", [1, 1, 1, 1, 1])]
    rows += [("".join(rng.choice("abcé ,()[] \U0001f986") for _ in range(rng.randint(0, 300))), [rng.randint(0, 40) for _ in range(rng.randint(0, 9))]) for _ in range(400)]
    df = spark.createDataFrame(rows, "t string, n array<int>").select("t", "n", T.distributed(F.col("t"), F.col("n")).alias("got"))
    for r in df.collect():
        assert r.got == brute(r.t, r.n), (r.t, r.n)


def test_long_texts_take_little_time(spark):
    rng = random.Random(7)
    rows = [("".join(rng.choice("abcdefgé,()[] ") for _ in range(2000)), [rng.randint(0, 200) for _ in range(15)]) for _ in range(300)]
    df = spark.createDataFrame(rows, "t string, n array<int>").coalesce(1).select("t", "n", T.distributed(F.replace("t", F.lit("\n"), F.lit(" ")), F.transform("n", lambda x: x)).alias("got"))
    began = time.monotonic()
    found = df.collect()
    assert time.monotonic() - began < 60  # many minutes where a text is made anew for each place that a cut may have
    for r in found:
        assert r.got == brute(r.t, r.n)
