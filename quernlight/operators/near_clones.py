"""Clones with edits in them: winnowed fingerprints of short runs of tokens, chained along
neighbouring diagonals, measured by alignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import materialise
from .code import without_overlaps
from .syntax import DEFAULT, normalised, token_lines, typed_tokens

#: Tokens of a fingerprint, and fingerprints of which the least is taken: two places that
#: share GRAM + TAKE - 1 tokens in a row share a fingerprint.
GRAM, TAKE = 8, 5
#: A fingerprint with more places than this is met by runs of 2, 4 and 8 of them; places of
#: a run of 8 with more places still are met with the first place of it.
PLACES = 32
RUNS = (1, 2, 4, 8)
#: Tokens by which a chain may shift from one fingerprint to the next, and the most
#: between two fingerprints of a chain.
SHIFT, REACH = 12, 40
#: Tokens that are looked at beyond a chain's ends, and the most that may differ there
#: in either text before GRAM equal ones.
BEYOND, JUMP = 100, 6
#: Fixed least similarity of gapped and of loosely alike clones.
GAPPED, LOOSE = ("DUP003", 0.8), ("DUP004", 0.7)


def winnowed(tokens: Column) -> Column:
    """array<int>: the places (from 0) of the least of every TAKE fingerprints in a row,
    the last of equal ones; of `tokens`, their fingerprints."""
    spans = F.sequence(F.lit(0), F.greatest(F.size(tokens) - TAKE, F.lit(0)))
    least = lambda k: F.array_min(F.transform(F.slice(tokens, k + 1, F.lit(TAKE)), lambda h, j: F.struct(h.alias("h"), (-(k + j)).alias("at"))))["at"]
    return F.array_distinct(F.transform(spans, lambda k: -least(k)))


def fingerprints(tokens: DataFrame, key: str) -> DataFrame:
    """(run, print, key, at, to) of tokens (key, _norm): winnowed fingerprints as they are
    and in runs of RUNS, with the places of the first and the last of the run."""
    starts = F.sequence(F.lit(1), F.size("_norm") - GRAM + 1)
    rows = tokens.where(F.size("_norm") >= GRAM).select(key, F.transform("_norm", lambda t: F.xxhash64(t)).alias("_h"), starts.alias("_s"))
    rows = rows.select(key, F.transform("_s", lambda k: F.xxhash64(F.slice("_h", k, F.lit(GRAM)))).alias("_g"))
    rows = rows.select(key, "_g", winnowed(F.col("_g")).alias("_at"))
    rows = rows.select(key, "_at", F.transform("_at", lambda k: F.get("_g", k)).alias("_p"))
    per = lambda n: F.transform("_p", lambda p, k: F.when(k + n <= F.size("_p"), F.struct(F.xxhash64(F.slice("_p", k + 1, F.lit(n))).alias("print"), F.get("_at", k + (n - 1)).alias("to"))))
    rows = rows.select(key, F.posexplode(F.arrays_zip("_at", *[per(n).alias(f"_r{n}") for n in RUNS])).alias("_k", "_x"))
    rows = rows.select(key, F.col("_x._at").alias("at"), F.explode(F.array(*[F.struct(F.lit(n).alias("run"), F.col(f"_x._r{n}").alias("r")) for n in RUNS])).alias("_y"))
    return rows.select("_y.run", "_y.r.print", key, "at", "_y.r.to").where(F.col("print").isNotNull())


def seeds(prints: DataFrame, key: str) -> DataFrame:
    """(a, a_at, a_to, b, b_at, b_to): places that share a fingerprint. Groups of PLACES at most are
    paired whole, so a place has a bounded number of partners; places of a run of the
    longest kind with more are paired with its first. Only counts and first places are
    aggregated: no task holds the places of a common fingerprint."""
    by = prints.groupBy("run", "print").agg(F.count("*").alias("n"), F.min(F.struct(F.col(key).alias("k"), F.col("at").alias("at"), F.col("to").alias("to"))).alias("f")).where("n > 1")
    few = prints.join(by.where(F.col("n") <= PLACES).select("run", "print"), ["run", "print"])
    x = few.select("run", "print", F.col(key).alias("a"), F.col("at").alias("a_at"), F.col("to").alias("a_to"))
    y = few.select("run", "print", F.col(key).alias("b"), F.col("at").alias("b_at"), F.col("to").alias("b_to"))
    pairs = x.join(y, ["run", "print"]).select("a", "a_at", "a_to", "b", "b_at", "b_to")
    many = prints.where(F.col("run") == RUNS[-1]).join(by.where((F.col("n") > PLACES) & (F.col("run") == RUNS[-1])).select("run", "print", "f"), ["run", "print"])
    pairs = pairs.unionByName(many.select(F.col("f.k").alias("a"), F.col("f.at").alias("a_at"), F.col("f.to").alias("a_to"), F.col(key).alias("b"), F.col("at").alias("b_at"), F.col("to").alias("b_to")))
    return pairs.where((F.col("a") < F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("b_at") >= F.col("a_at") + GRAM))).distinct()


def chains(pairs: DataFrame) -> DataFrame:
    """(a, b, a_at, a_to, b_at, b_to, seeds): seeds of a pair of rows in a row in both, one
    after the other within REACH and SHIFT; each joins the longest chain that it can."""

    columns = ["a", "b", "a_at", "a_to", "b_at", "b_to", "seeds"]

    def run(batches):
        # Rows come sorted by pair; a pair's chains are handed on where the next pair begins.
        pair, open_ = None, []
        # Of a chain: its start, the start of its last seed and its end, in both, and its seeds.
        for pdf in batches:
            done: list[tuple] = []
            for key_a, key_b, a, to_a, b, to_b in zip(*(pdf[c].tolist() for c in ("a", "b", "a_at", "a_to", "b_at", "b_to"))):
                if (key_a, key_b) != pair:
                    done += [(*pair, *c) for c in open_]
                    pair, open_ = (key_a, key_b), []
                elif any(b - c[5] > REACH for c in open_):
                    done += [(*pair, *c) for c in open_ if b - c[5] > REACH]
                    open_ = [c for c in open_ if b - c[5] <= REACH]
                best = None
                for c in open_:
                    if c[1] <= a <= c[2] + REACH and c[4] <= b and abs((b - a) - (c[4] - c[1])) <= SHIFT and (best is None or c[6] > best[6]):
                        best = c
                if best is None:
                    open_.append([a, a, to_a, b, b, to_b, 1])
                else:
                    best[1:3], best[4:] = [a, max(best[2], to_a)], [b, max(best[5], to_b), best[6] + 1]
            yield frame(done)
        yield frame([(*pair, *c) for c in open_])

    def frame(done: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(done, columns=["a", "b", "a_at", "_a", "a_to", "b_at", "_b", "b_to", "seeds"])
        out[["a_to", "b_to"]] += GRAM
        return out[columns]

    kind = pairs.schema["a"].dataType.simpleString()
    rows = pairs.repartition("a", "b").sortWithinPartitions("a", "b", "b_at", "a_at", "b_to", "a_to")
    return rows.mapInPandas(run, f"a {kind}, b {kind}, a_at int, a_to int, b_at int, b_to int, seeds int")


def common(a: list, b: list, least: float) -> int:
    """The length of the longest common subsequence, or -1 if 2 * length is below `least`
    of both lengths: furthest reaching paths by number of edits."""
    n, m = len(a), len(b)
    most = int((1 - least) * (n + m) + 1e-9)
    reach = [0] * (2 * most + 3)
    for d in range(most + 1):
        for k in range(-d, d + 1, 2):
            down, on = reach[most + k + 2], reach[most + k] + 1
            x = down if k == -d or (k != d and on <= down) else on
            y = x - k
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            reach[most + k + 1] = x
            if x >= n and y >= m:
                return (n + m - d) // 2
    return -1


def extended(a: list, b: list) -> tuple[int, int]:
    """How far a and b go on alike from their starts: over equal tokens, and over JUMP
    others in each at most where GRAM equal ones follow."""
    x = y = 0
    while True:
        while x < len(a) and y < len(b) and a[x] == b[y]:
            x, y = x + 1, y + 1
        for i, j in _JUMPS:
            if x + i + GRAM <= len(a) and y + j + GRAM <= len(b) and a[x + i : x + i + GRAM] == b[y + j : y + j + GRAM]:
                x, y = x + i, y + j
                break
        else:
            return x, y


#: Few tokens first.
_JUMPS = sorted(((i, j) for i in range(JUMP + 1) for j in range(JUMP + 1) if i or j), key=lambda p: (sum(p), abs(p[0] - p[1])))


def near_clones(files: DataFrame, key: str, text: str, thresholds: tuple[int, int, float] = (DEFAULT[0], DEFAULT[1], LOOSE[1])) -> DataFrame:
    """(rule, a, a_start, a_end, b, b_start, b_end, tokens, similarity): places, by lines,
    that hold the same tokens but for some put in, left out or changed; names and values
    are put aside. Similarity is twice the common tokens in order by the tokens of both:
    GAPPED or LOOSE by its least similarity. Places without an edit aren't told:
    syntax.clones tells these. Rows whose tokens are equal throughout are one, told by the
    smallest key. Of clones that overlap in b the one with most tokens stays. Null texts and
    texts with fewer tokens than asked for have no clones."""
    size, least_lines, least = thresholds
    toks = files.select(key, typed_tokens(F.col(text)).alias("t"), token_lines(F.col(text)).alias("_n")).select(key, normalised(F.col("t")).alias("_norm"), "_n").where(F.size("_norm") >= size)
    toks = materialise(toks.withColumn("_c", F.sha2(F.array_join("_norm", " "), 256)))
    # Written, so that its size is known: few rows, as copies are left out, go to the tokens, not these to them.
    alone = materialise(toks.groupBy("_c").agg(F.min(key).alias(key)).select(key))
    toks = materialise(toks.drop("_c").join(alone, key, "left_semi"))
    found = chains(seeds(materialise(fingerprints(toks, key)), key))
    # A chain ends with its last fingerprint; GRAM + TAKE equal tokens may stand beyond it.
    edge = GRAM + TAKE
    found = found.where((F.col("b_to") - F.col("b_at") + 2 * edge >= size) & (F.col("a_to") - F.col("a_at") + 2 * edge >= size))
    for s in ("a", "b"):
        low = F.greatest(F.col(f"{s}_at") - BEYOND, F.lit(0))
        side = toks.select(F.col(key).alias(f"_{s}"), F.col("_norm").alias(f"_norm_{s}"), F.col("_n").alias(f"_n_{s}"))
        found = found.join(side, F.col(s) == F.col(f"_{s}"))
        cut = lambda c: F.slice(c, low + 1, F.col(f"{s}_to") + BEYOND - low)
        found = found.withColumns({f"_low_{s}": low, f"_w_{s}": cut(f"_norm_{s}"), f"_l_{s}": cut(f"_n_{s}")}).drop(f"_{s}", f"_norm_{s}", f"_n_{s}")

    def measure(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                a, b = list(r["_w_a"]), list(r["_w_b"])
                i, j, x, y = r["a_at"] - r["_low_a"], r["b_at"] - r["_low_b"], r["a_to"] - r["_low_a"], r["b_to"] - r["_low_b"]
                left, right = extended(a[:i][::-1], b[:j][::-1]), extended(a[x:], b[y:])
                i, j, x, y = i - left[0], j - left[1], x + right[0], y + right[1]
                tokens = min(x - i, y - j)
                equal = common(a[i:x], b[j:y], least) if tokens >= size else -1
                share = 2 * equal / (x - i + y - j) if equal >= 0 else 0.0
                if equal >= 0 and share < 1:
                    rule = GAPPED[0] if share >= GAPPED[1] else LOOSE[0]
                    out.append((rule, r["a"], int(r["_l_a"][i]), int(r["_l_a"][x - 1]), r["b"], int(r["_l_b"][j]), int(r["_l_b"][y - 1]), tokens, float(np.round(share, 6))))
            yield pd.DataFrame(out, columns=["rule", "a", "a_start", "a_end", "b", "b_start", "b_end", "tokens", "similarity"])

    kind = files.schema[key].dataType.simpleString()
    # Measuring is the dear part: by a number of parts of its own, as small rows would be put into few.
    found = found.repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b")
    rows = found.mapInPandas(measure, f"rule string, a {kind}, a_start int, a_end int, b {kind}, b_start int, b_end int, tokens int, similarity double")
    rows = rows.where((F.col("b_end") - F.col("b_start") + 1 >= least_lines) & ((F.col("a") != F.col("b")) | (F.col("a_end") < F.col("b_start")))).withColumn("_end", F.col("b_end") + 1)
    kept = without_overlaps(rows, ["a", "b"], "b_start", "_end", F.col("tokens").desc(), F.col("similarity").desc(), F.col("b_start"), F.col("a_start"))
    return kept.drop("_end")
