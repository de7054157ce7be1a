import random
import re

from quernlight.llm.licenses import HALF, PHRASES, TEMPLATES, scan, template_tokens

SCHEMA = "doc_id long, text string, row string, labels string"


def brute(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    spots, base, more, best = [], set(), set(), 0.0
    for phrase, label in PHRASES:
        p = phrase.split()
        found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        spots += found
        base |= {label} if found else set()
    for k in range(0, len(w), HALF):
        block = set(w[k : k + 2 * HALF])
        for label, tokens in template_tokens():
            n = len(block & set(tokens))
            if n * 100 >= 80 * len(tokens):
                more.add(label)
                best = max(best, n / len(tokens))
    return (len(w), len(spots), min(spots, default=None), max(spots, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if base else best)


def test_equals_brute_force(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(150):
        parts = [" ".join(rnd.choice(["the", "of", "é", "x1", "İstanbul", "wor\u212a", "lIcense", "lİcense", "software", "license", "MIT", "cc", "by"]) for _ in range(rnd.randint(0, 90))) for _ in range(4)]
        for _ in range(rnd.randint(0, 2)):
            words = rnd.choice(TEMPLATES)[1].split()
            for _ in range(rnd.randint(0, min(6, len(words) - 2))):
                words.pop(rnd.randrange(len(words)))
            parts.insert(rnd.randrange(len(parts)), rnd.choice([" ", "\n"]).join(words).upper() + ".")
        rows.append((i, "\n".join(parts), "r", "l"))
    rows += [(900, None, None, None), (901, "", "r", None), (902, "GNU general-PUBLIC license " * 20000, "r", None), (None, "Apache License", "r", None), rows[0]]
    got = scan(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda x: str(x)
    assert sorted(((r.doc_id, *r[1:]) for r in got), key=key) == sorted(((i, *brute(t)) for i, t, _, _ in rows), key=key)
    assert scan(spark.createDataFrame([], SCHEMA)).collect() == []
