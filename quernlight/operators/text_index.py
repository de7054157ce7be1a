"""A positional inverted index as Parquet tables, and the match language over it.

    postings   term, key, dl (the document's length), tf, positions; each file holds some documents, sorted by
               term and key; behind the term "" stand the documents themselves
    docs       key, dl
    gone       key, gen: documents of a generation that a later one replaced or removed
    commits    gen, by which documents and tokens grew: a generation without a row here doesn't count

Each call of `add` or `remove` writes one generation; readers see it once its commit
is there, so a job that fails on the way leaves nothing to see. A search reads the
postings of its own terms only: the filter on the term goes down to the row groups and
pages of the sorted files, for a prefix too. A frequent term's postings lie in
all files, so no task holds all of them; they meet by document. Documents are dealt
to tasks by their number before they are cut into terms, each once.

Terms are those of `scalar.tokens`; positions count them. Documents of one `add` must
have different keys. A null text has no terms; a null key is left out.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..common import dealt, materialise
from ..functions import scalar as S
from .search import terms_of

NEAR = 10  # default distance of NEAR, in terms
FILE_DOCS = 8192  # documents of one file of postings

# A tree of the match language: ("and" | "or" | "not", left, right), ("near", phrases, n) or a phrase
# ("phrase", terms), each term a pair (text, whether it is a prefix).
_PIECE = re.compile(r'"(?:[^"]|"")*"|[()+*,]|[^\s()"+*,]+')


def parse_match(text: str) -> tuple | None:
    """AND, OR, NOT, parentheses, "phrases", a + b, prefix*, NEAR(a b, n). Words side by side are
    all wanted. Operators bind as NOT, AND, OR, the tightest first; words side by side bind before them.
    Words without terms count for nothing; None if nothing is left."""
    pieces, at = _PIECE.findall(text), 0

    def peek() -> str | None:
        return pieces[at] if at < len(pieces) else None

    def take(wanted: str | None = None) -> str:
        nonlocal at
        if at >= len(pieces) or (wanted is not None and pieces[at] != wanted):
            raise ValueError(f"{wanted or 'a word'} is missing in {text!r}")
        at += 1
        return pieces[at - 1]

    def binary(kind: str, lower):
        def level() -> tuple | None:
            left = lower()
            while peek() == kind.upper():
                take()
                right = lower()
                left = left if right is None else right if left is None and kind != "not" else None if left is None else (kind, left, right)
            return left

        return level

    def side_by_side() -> tuple | None:
        parts = [primary()]
        while peek() not in (None, ")", "AND", "OR", "NOT"):
            parts.append(primary())
        parts = [p for p in parts if p is not None]
        return reduce(lambda a, b: ("and", a, b), parts) if parts else None

    def primary() -> tuple | None:
        if peek() == "(":
            take()
            inside = every()
            take(")")
            return inside
        if peek() == "NEAR" and at + 1 < len(pieces) and pieces[at + 1] == "(":
            take(), take()
            phrases = []
            while peek() not in (None, ")", ","):
                phrases.append(phrase())
            n = NEAR
            if peek() == ",":
                take()
                n = int(take())
            take(")")
            phrases = [p for p in phrases if p is not None]
            return ("near", phrases, n) if len(phrases) > 1 else phrases[0] if phrases else None
        return phrase()

    def phrase() -> tuple | None:
        terms: list[tuple[str, bool]] = []
        while True:
            piece = take()
            if piece in ("(", ")", "+", "*", ",", "AND", "OR", "NOT"):
                raise ValueError(f"{piece!r} stands where a word should be in {text!r}")
            terms += [(t, False) for t in terms_of(piece.strip('"') if piece[0] == '"' else piece)]
            if peek() == "*":
                take()
                terms[-1:] = [(terms[-1][0], True)] if terms else []
            if peek() != "+":
                return ("phrase", terms) if terms else None
            take()

    every = binary("or", binary("and", binary("not", side_by_side)))
    if not pieces:
        return None
    tree = every()
    if at < len(pieces):
        raise ValueError(f"{pieces[at]!r} is one too many in {text!r}")
    return tree


def _terms(tree: tuple, positive: bool = False) -> list[tuple[str, bool]]:
    if tree[0] == "phrase":
        return list(tree[1])
    if tree[0] == "near":
        return [t for p in tree[1] for t in p[1]]
    return _terms(tree[1], positive) + ([] if positive and tree[0] == "not" else _terms(tree[2], positive))


def _condition(tree: tuple, number: dict[tuple[str, bool], int]) -> Column:
    """The tree over columns tf0, p0, tf1, p1, ... of a document."""
    if tree[0] == "phrase":
        return F.col(f"tf{number[tree[1][0]]}") > 0 if len(tree[1]) == 1 else F.size(_starts(tree, number)) > 0
    if tree[0] == "near":
        return _close([_starts(p, number) for p in tree[1]], [len(p[1]) + tree[2] for p in tree[1]])
    left, right = _condition(tree[1], number), _condition(tree[2], number)
    return left & right if tree[0] == "and" else left | right if tree[0] == "or" else left & ~right


def _starts(phrase: tuple, number: dict[tuple[str, bool], int]) -> Column:
    """Positions at which the phrase begins, in time linear in those of its terms."""
    back = lambda t, j: F.transform(f"p{number[t]}", lambda x: x - j) if j else F.col(f"p{number[t]}")
    return reduce(F.array_intersect, [back(t, j) for j, t in enumerate(phrase[1])])


def _close(starts: list[Column], reach: list[int]) -> Column:
    """Whether some start of a phrase has one of each other phrase at most its reach behind it. One pass
    from the last start to the first: the next start of every phrase is all that it remembers."""
    far = 1 << 40
    one = lambda s, k: F.transform(s, lambda x: F.struct(x.cast("long").alias("at"), F.lit(k).alias("of")))
    every = F.reverse(F.array_sort(F.concat(*[one(s, k) for k, s in enumerate(starts)])))
    first = F.struct(F.lit(False).alias("found"), *[F.lit(far).cast("long").alias(f"n{k}") for k in range(len(starts))])

    def step(held: Column, x: Column) -> Column:
        after = [F.when(x["of"] == k, x["at"]).otherwise(held[f"n{k}"]) for k in range(len(starts))]
        begins = [(after[k] == x["at"]) & reduce(lambda a, b: a & b, [o <= x["at"] + reach[k] for j, o in enumerate(after) if j != k]) for k in range(len(starts))]
        return F.struct((held["found"] | reduce(lambda a, b: a | b, begins)).alias("found"), *[o.alias(f"n{k}") for k, o in enumerate(after)])

    return F.aggregate(every, first, step, lambda held: held["found"])


def _placed(tree: tuple) -> set[tuple[str, bool]]:
    """Terms whose positions the tree asks for."""
    if tree[0] == "phrase":
        return set(tree[1]) if len(tree[1]) > 1 else set()
    return set(_terms(tree)) if tree[0] == "near" else _placed(tree[1]) | _placed(tree[2])


class TextIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _exists(self, name: str) -> bool:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return bool(folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder))

    def _generations(self) -> tuple[list[str], int, int]:
        """Committed generations (one row a call of add or remove), documents and tokens in the index."""
        if not self._exists("commits"):
            return [], 0, 0
        rows = self._table("commits").collect()
        return [r["gen"] for r in rows], sum(r["documents"] for r in rows), sum(r["tokens"] for r in rows)

    def _live(self, name: str) -> DataFrame:
        """Rows of committed generations that no later one replaced."""
        gens = self._generations()[0]
        rows = self._table(name).where(F.col("gen").isin(gens))  # the folders of a generation
        if not self._exists("gone"):
            return rows
        gone = self._table("gone").where(F.col("by").isin(gens)).select(F.col("key").alias("k"), F.col("gen").alias("g"))
        return rows.join(gone, (F.col("key") == F.col("k")) & (F.col("gen") == F.col("g")), "left_anti")

    def add(self, rows: DataFrame, key: str, text: str) -> str:
        """Index documents; those whose key is in the index replace it. Returns the generation."""
        gen, named = uuid.uuid4().hex, rows.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null")
        fields = T.StructType([
            T.StructField("term", T.StringType()), named.schema["key"], T.StructField("dl", T.IntegerType()),
            T.StructField("tf", T.IntegerType()), T.StructField("positions", T.ArrayType(T.IntegerType())),
        ])
        arrow = to_arrow_schema(fields)

        def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
                lists = batch.column(1)
                dl, coded = lists.value_lengths().to_numpy(), lists.flatten().dictionary_encode()
                doc, code = np.repeat(np.arange(len(dl)), dl), coded.indices.to_numpy()
                place = np.arange(len(doc)) - np.repeat(np.cumsum(dl) - dl, dl)
                term_of = doc * max(len(coded.dictionary), 1) + code
                order = np.argsort(term_of, kind="stable")
                first = np.flatnonzero(np.diff(term_of[order], prepend=-1))
                cuts, none = np.append(first, len(order)), np.zeros(len(dl), np.int32)
                doc, code = doc[order][first], code[order][first]
                for columns in (
                    (coded.dictionary.take(pa.array(code)), batch.column(0).take(pa.array(doc)), dl[doc], np.diff(cuts), cuts, place[order]),
                    (pa.array([""] * len(dl), pa.string()), batch.column(0), dl, none, np.zeros(len(dl) + 1), none[:0]),
                ):
                    positions = pa.ListArray.from_arrays(pa.array(columns[4].astype(np.int32)), pa.array(columns[5].astype(np.int32)))
                    counts = [pa.array(c.astype(np.int32)) for c in columns[2:4]]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip((*columns[:2], *counts, positions), arrow)], schema=arrow)

        words = dealt(named, "key", FILE_DOCS).select("key", S.tokens(F.col("text")).alias("t"))
        words.mapInArrow(postings, fields).sortWithinPartitions("term", "key").write.parquet(f"{self.path}/postings/gen={gen}")
        docs = self.spark.read.schema(fields).parquet(f"{self.path}/postings/gen={gen}").where("term = ''").select("key", "dl")
        docs.write.parquet(f"{self.path}/docs/gen={gen}")
        documents, tokens = docs.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return self._commit(gen, docs.select("key"), documents, tokens)

    def remove(self, keys: DataFrame) -> str:
        """Take documents (key) out of the index."""
        return self._commit(uuid.uuid4().hex, keys.select("key").distinct(), 0, 0)

    def _commit(self, gen: str, keys: DataFrame, documents: int, tokens: int) -> str:
        if self._generations()[0]:
            old = materialise(self._live("docs").join(keys, "key", "left_semi").select("key", "gen", "dl"))
            out, fewer = old.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
            if out:
                old.select("key", "gen", F.lit(gen).alias("by")).write.mode("append").parquet(f"{self.path}/gone")
            documents, tokens = documents - out, tokens - fewer
        row = self.spark.createDataFrame([(gen, documents, tokens)], "gen string, documents bigint, tokens bigint")
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return gen

    def postings(self, terms: list[tuple[str, bool]]) -> DataFrame:
        """Live postings of the terms: (text, whether it is a prefix)."""
        return self._live("postings").where(reduce(lambda a, b: a | b, [_is(t) for t in terms]))

    def statistics(self) -> tuple[int, float]:
        """(documents, average length)"""
        _, documents, tokens = self._generations()
        return documents, tokens / documents if documents else 0.0

    def search(self, match: str) -> DataFrame:
        """(key, rank) of the documents that match: rank is BM25 of the terms that are wanted (not
        those after NOT; terms that stand in the query twice count twice), below zero: smaller is better."""
        tree = parse_match(match)
        if tree is None or not self._generations()[0]:
            kind = self._table("docs").schema["key"].dataType.simpleString() if self._exists("docs") else "string"
            return self.spark.createDataFrame([], f"key {kind}, rank double")
        every = sorted(set(_terms(tree)))
        number = {t: k for k, t in enumerate(every)}
        documents, average = self.statistics()
        wanted = _terms(tree, positive=True)
        found = self.postings(every).groupBy("key").agg(
            F.max("dl").alias("dl"), *[F.sum(F.when(_is(t), F.col("tf")).otherwise(0)).alias(f"tf{k}") for t, k in number.items()],
            *[F.array_sort(F.flatten(F.collect_list(F.when(_is(t), F.col("positions"))))).alias(f"p{k}") for t, k in number.items() if t in _placed(tree)],
        )
        found = materialise(found)
        held = found.agg(*[F.coalesce(F.sum((F.col(f"tf{k}") > 0).cast("long")), F.lit(0)) for k in range(len(every))]).first()
        score: Column = F.lit(0.0)
        for t in sorted(set(wanted)):
            k = number[t]
            part = S.bm25_idf(F.lit(documents), F.lit(held[k])) * S.bm25_weight(F.col(f"tf{k}"), F.col("dl"), F.lit(average))
            score = score + F.lit(float(wanted.count(t))) * F.when(F.col(f"tf{k}") > 0, part).otherwise(0.0)
        return found.where(_condition(tree, number)).select("key", (-score).alias("rank"))

    def compact(self, path: str) -> TextIndex:
        """The live documents as one generation in a new folder."""
        gen, other = uuid.uuid4().hex, TextIndex(self.spark, path)
        files = max(-(-self._generations()[1] // FILE_DOCS), 1)
        self._live("postings").drop("gen").repartition(files, "key").sortWithinPartitions("term", "key").write.parquet(f"{path}/postings/gen={gen}")
        self._live("docs").drop("gen").write.parquet(f"{path}/docs/gen={gen}")
        documents, tokens = self._generations()[1:]
        other._commit(gen, self.spark.createDataFrame([], "key string"), documents, tokens)
        return other


def _is(term: tuple[str, bool]) -> Column:
    return F.col("term").startswith(term[0]) if term[1] else F.col("term") == term[0]
