"""Small document tables with the awkward cases, and brute-force readings of the texts."""

from __future__ import annotations

import random
import re
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau ypsilon".split()


def prose(rng: random.Random, n: int, words=None) -> str:
    made = words or WORDS
    return " ".join(rng.choice(made) + rng.choice(["", "", "", str(rng.randint(0, 99))]) for _ in range(n))


def rows(seed: int = 1) -> list[tuple]:
    """Copies, near copies, shared passages, nulls, empty, white, long, non-ASCII and repeated texts."""
    rng = random.Random(seed)
    base = [prose(rng, n) for n in (40, 60, 80, 120, 200)]
    shared = prose(rng, 70)
    texts = [*base, base[0], base[1].replace("alpha", "omega", 1), base[3] + " tail end", shared + ".\n" + base[2], prose(rng, 30) + "\n" + shared]
    texts += [None, "", " \n\t ", "one", "Two Words", "ünïcödé größer straße été", "x" * 900, "ab" * 300, base[4] + "\n" + base[4], "é" * 150 + "è" * 150, prose(rng, 3000)]
    out = [(i, t, rng.choice(["en", "de", None]), f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*out, out[2], (100, base[0], None, None, None), (101, None, "en", "src0", 7)]


def table(spark, made=None, extra: bool = False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows() if made is None else made, SCHEMA)
    if extra:  # names the operators add themselves
        for name in ("score", "spans", "items", "runs", "n_words", "n_bytes", "n_tokens", "kept", "lang_pred", "kept_text", "__text", "shard", "size"):
            df = df.withColumn(name, F.lit("extra"))
    return df


def lowered(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def crc(text) -> int:
    return zlib.crc32(str(text).encode())


def brute_components(made, words, percent):
    sets, first = {}, {}
    for doc, text, *_ in made:
        own = [w for w in re.split(r"[\x20\x09-\x0d]+", lowered(text)) if w]
        sets.setdefault(doc, set()).update({tuple(own[i : i + words]) for i in range(max(1, len(own) - words + 1))} if own else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}
