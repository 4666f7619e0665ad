"""Secret scans over the given tables with planted keys and ordinary identifiers, and the control of discoveries against a plain version."""

import math
import random
import re
import string
import uuid

import pytest
from pyspark.sql import functions as F

from letterlake.llm import secrets

SF = "/root/testdata/sf0.01"
ALPHABETS = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "alnum": string.ascii_lowercase + string.digits, "ALNUM": string.ascii_uppercase + string.digits, "base62": string.ascii_letters + string.digits}


def key(rng, alphabet, size):
    while True:
        out = "".join(rng.choice(alphabet) for _ in range(size))
        # long lower-case hexadecimal runs are a known form of their own
        if re.search("[0-9]", out) and re.search("[A-Za-z]", out):
            return out


@pytest.fixture(scope="module")
def planted(spark):
    """Found random spans, keys by (alphabet, length), and identifiers: each key alone in a document, identifiers ten to a document."""
    rng = random.Random(23)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    words = [w.lower() for t in list(docs.values())[:300] for w in re.findall("[A-Za-z]{2,}", t)]
    keys = {(name, size): [key(rng, a, size) for _ in range(20)] for name, a in ALPHABETS.items() for size in (24, 31, 32, 40)}
    keys["uuid", 36] = [str(uuid.UUID(int=rng.getrandbits(128), version=4)) for _ in range(20)]
    names = []
    while len(names) < 5_000:
        first, *rest = (rng.choice(words) for _ in range(5))
        names.append(first + "".join(w.capitalize() for w in rest) + str(rng.randrange(1_000)))
    ids = list(docs)
    for k, t in enumerate([*(x for own in keys.values() for x in own), *names]):
        docs[ids[k % len(ids)]] += f"\nsee {t} here"
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    rows = secrets.scanned(df, keep_text=False).select(F.explode("spans").alias("s")).select("s.kind", "s.match").collect()
    return {r.match for r in rows}, [r.match for r in rows if r.kind == "random"], keys, set(names)


def test_keys_of_every_alphabet_are_found(planted):
    found, _, keys, _ = planted
    share = {k: sum(t in found for t in own) / len(own) for k, own in keys.items()}
    low = {k: v for k, v in share.items() if v < 0.9}
    assert not {k: v for k, v in low.items() if k[1] >= 32}, low
    assert all(v >= 0.75 for (name, _), v in share.items() if name != "base62"), low


def test_few_finds_are_false(planted):
    _, found, keys, names = planted
    true = {t for own in keys.values() for t in own}
    assert sum(t not in true for t in found) <= secrets.FALSE_SHARE * len(found)
    assert sum(t in names for t in found) <= secrets.FALSE_SHARE * len(found)


def test_missing_scores_have_the_last_step(spark):
    steps = [r[0] for r in spark.sql("SELECT explode(array(CAST(NULL AS DOUBLE), double('NaN'), 0.3D, -1e9D, 1e9D)) AS s").select(secrets.step(F.col("s"))).collect()]
    assert steps == [secrets.LAST, secrets.LAST, math.ceil(0.3 * secrets.GRAIN), -secrets.LAST, secrets.LAST]


def test_accepted_steps_against_each_token_alone():
    """Benjamini and Hochberg's rule written out over single tokens."""
    rng = random.Random(2)
    for _ in range(30):
        decoys, tokens = [round(rng.gauss(90, 12)) for _ in range(300)], [(round(rng.gauss(70, 30)), rng.random() < 0.8) for _ in range(60)]
        rows = [("base64:20", True, False, s, decoys.count(s)) for s in set(decoys)]
        rows += [("base64:20", False, ok, s, tokens.count((s, ok))) for s, ok in set(tokens)]
        steps = [s / secrets.GRAIN for s in decoys]
        # moments of all lengths, with assumed values added; then those of the class with the former added
        mean, variance = secrets.ASSUMED_MEAN, secrets.ASSUMED_VARIANCE
        for _ in range(2):
            n = len(steps) + secrets.PRIOR
            middle = (sum(steps) + secrets.PRIOR * mean) / n
            variance = max((sum((x - middle) ** 2 for x in steps) + secrets.PRIOR * (variance + (mean - middle) ** 2)) / n, 1.0)
            mean = middle
        tail = lambda s: min((1 + sum(d <= s for d in decoys)) / (1 + len(decoys)), math.erfc((mean - s / secrets.GRAIN) / math.sqrt(2 * variance)) / 2)  # noqa: B023, E731
        p = sorted((tail(s) if ok else 1.0, s) for s, ok in tokens)
        fits = [s for k, (x, s) in enumerate(p, 1) if x * len(p) <= secrets.FALSE_SHARE * k and x < 1]
        assert secrets.accepted(rows).get("base64:20") == (max(fits) if fits else None)
