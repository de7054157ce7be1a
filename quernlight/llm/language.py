"""Language identification with unigram pieces, summed over all segmentations.

A fixed public vocabulary gives the pieces. Each language has probabilities for
them, fitted by expectation maximisation (forward and backward sums over every
segmentation of a word) on labelled texts. A text's score in a language is the
sum over its words of the log of the probability of the word, which a forward
pass sums over all ways to cut it into pieces. The language with the largest
sum is predicted; the score is its posterior under equal priors.

Words are runs of letters in lower case, of any length: the forward pass scales
its sums as it goes on. The new words of a batch are scored together, all their
positions at once; their logs are added as whole multiples of 1 / UNIT, so equal
texts have equal scores in any batch.

Learning takes at most `per_language` different texts of each language (a
documented bound): of the rows whose hash falls into one of so many slots the
least hash of each slot, so repeats neither crowd out other texts nor lose a
language. Of these texts, words of at most LEARNED letters count; they come to
the fitting task as counts. Prediction covers every whole text and reads only it.

Defined cases: null texts and texts without a letter are `und` with score 0; so
is everything if no labelled text has a letter. Ties go to the smaller language
name. Rows are independent: repeated rows, null ids and extra columns change
nothing; a null doc_id is neither held out nor learned from; an empty table
stays empty.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop, kept, map_rows

PER_LANGUAGE = 400
LEARNED = 64
ROUNDS = 3
SMOOTHING = 0.1
UNKNOWN = 1e-7
WORD_MEMORY = 300_000  # words whose logs a worker keeps
AT_ONCE = 100_000  # words looked up together
SPAN = 1 << 20  # characters of a text cut into words together
RUN = 48  # letters up to which words are scored together
UNIT = 1 << 24
WORD_MARK = "▁"


_WORD = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1)
def _others() -> frozenset[str]:
    """Characters of words that str.isalpha() doesn't call letters."""
    return frozenset(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def letter_pieces(path: str) -> list[str]:
    """Lower-case letter pieces of a sentencepiece vocabulary, word mark allowed in front."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    return [p for p in pieces if (t := p.removeprefix(WORD_MARK)).isalpha() and t == t.lower()]


def words_of(text: str) -> Iterator[list[str]]:
    """The words of a text, span after span; spans end between words."""
    at = 0
    while at < len(text):
        end = at + SPAN
        if end < len(text):
            run = _WORD.match(text, end)  # letters that go on beyond the span
            end = run.end() if run else end
        part = text[at:end].lower()
        if not part.isascii() and (found := _others().intersection(part)):
            part = part.translate({ord(c): " " for c in found})
        yield _WORD.findall(part)
        at = end


def fit(words: Counter[str], pieces: list[str], rounds: int = ROUNDS) -> dict[str, float]:
    """Piece probabilities of one language by expectation maximisation."""
    vocab, longest = set(pieces), max(map(len, pieces), default=1)
    cuts: list[tuple[int, int, list[tuple[int, int, str]]]] = []
    start_counts: Counter[str] = Counter()
    for word, count in sorted(words.items()):
        n = len(word)
        found = [
            (a, b, word[a:b]) for a in range(n) for b in range(a + 1, min(n, a + longest) + 1) if word[a:b] in vocab
        ]
        cuts.append((n, count, found))
        for a, b, piece in found:
            start_counts[piece] += count * (b - a)
    total = sum(start_counts.values()) or 1
    p = {k: v / total for k, v in start_counts.items()}
    for _ in range(rounds):
        expected: dict[str, float] = dict.fromkeys(p, 0.0)
        for n, count, found in cuts:
            ahead, behind = [1.0] + [0.0] * n, [0.0] * n + [1.0]
            covered = {a for a, b, _ in found if b == a + 1}
            k = 0
            for at in range(n):
                while k < len(found) and found[k][0] == at:
                    ahead[found[k][1]] += ahead[at] * p[found[k][2]]
                    k += 1
                if at not in covered:
                    ahead[at + 1] += ahead[at] * UNKNOWN
            k = len(found) - 1
            for at in range(n - 1, -1, -1):
                while k >= 0 and found[k][0] == at:
                    behind[at] += p[found[k][2]] * behind[found[k][1]]
                    k -= 1
                if at not in covered:
                    behind[at] += UNKNOWN * behind[at + 1]
            if ahead[n] > 0:
                scale = count / ahead[n]
                for a, b, piece in found:
                    expected[piece] += scale * ahead[a] * p[piece] * behind[b]
        total = sum(expected.values()) or 1.0
        p = {k: v / total for k, v in expected.items()}
    mass = sum(words.values())
    return {k: p.get(k, 0.0) * mass for k in pieces}


def train(
    labelled: DataFrame,
    pieces: list[str],
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
) -> dict[str, dict[str, float]]:
    """{language: {piece: probability}} from labelled rows; the words of at most
    per_language texts of each language go to its one fitting task. What comes to
    the driver is one number for each piece and language."""
    rows = labelled.select(F.col(lang_col).alias("l"), F.col(text_col).alias("t")).where("l is not null and t is not null")
    rows = rows.withColumn("h", F.xxhash64("t", "l"))
    # Hashes only, combined before they move; then the rows that hold them, each text once.
    least = rows.groupBy("l", F.pmod("h", F.lit(per_language)).alias("slot")).agg(F.min("h").alias("least"))
    least = cut(least.select(F.col("l").alias("of"), "least"))
    languages = [r["of"] for r in least.select("of").distinct().collect()]  # a row for each language, as the model
    if not languages:
        drop(least)
        return {}
    # per_language rows a language at most: a bound of the model's kind.
    sample = rows.join(F.broadcast(least), (F.col("l") == F.col("of")) & (F.col("h") == F.col("least")), "left_semi")
    sample = sample.groupBy("l", "h").agg(F.first("t").alias("t"))

    def count(langs, texts):
        for lang, text in zip(langs, texts):
            counts = Counter(w for part in words_of(text) for w in part if len(w) <= LEARNED)
            yield from ((lang, WORD_MARK + w, n) for w, n in counts.items())

    counted = map_rows(sample.select("l", "t"), lambda: count, "l string, word string, n bigint", 50)
    counted = counted.groupBy("l", "word").agg(F.sum("n").alias("n"))
    shared = labelled.sparkSession.sparkContext.broadcast(pieces)

    def fit_language(frame: pd.DataFrame) -> pd.DataFrame:
        learned = fit(Counter(dict(zip(frame["word"], frame["n"]))), shared.value)
        found = [(frame["l"].iloc[0], k, v) for k, v in learned.items() if v > 0]
        return pd.DataFrame(found, columns=["l", "piece", "mass"]).astype({"l": object, "piece": object, "mass": float})

    model: dict[str, dict[str, float]] = {}
    fitted = counted.repartition(len(languages), "l").groupBy("l").applyInPandas(fit_language, "l string, piece string, mass double")
    for r in fitted.collect():  # the model: a number for each piece and language
        model.setdefault(r["l"], {})[r["piece"]] = r["mass"]
    drop(least)
    for lang, learned in model.items():
        total = sum(learned.values()) + SMOOTHING * len(pieces)
        model[lang] = {k: (learned.get(k, 0.0) + SMOOTHING) / total for k in pieces}
    return model


class Scorer:
    """Word and text scores of a model {language: {piece: probability}}."""

    def __init__(self, model: dict[str, dict[str, float]]):
        self.languages = sorted(model)
        pieces = sorted(model[self.languages[0]]) if model else []
        self.chance = np.array([[model[x][p] for x in self.languages] for p in pieces]).reshape(len(pieces), len(self.languages))
        # A trie: children of a state by letter, the piece that ends in a state.
        children: dict[tuple[int, str], int] = {}
        ends: list[int] = [-1]
        self.longest = max(map(len, pieces), default=1)
        for k, piece in enumerate(pieces):
            state = 0
            for c in piece:
                state = children.setdefault((state, c), len(ends))
                if state == len(ends):
                    ends.append(-1)
            ends[state] = k
        self.children, self.ends = children, np.array(ends)
        # The same for arrays: letters by number (from 1 on), moves sorted by state and letter.
        self.alphabet = np.unique(np.array([ord(c) for _, c in children], np.int64))
        self.width = len(self.alphabet) + 1
        number = {int(c): k + 1 for k, c in enumerate(self.alphabet)}
        moves = sorted((s * self.width + number[ord(c)], t) for (s, c), t in children.items())
        self.moves, self.targets = np.array(moves, np.int64).reshape(-1, 2).T
        self.rows: dict[str, int] = {}
        self.logs = np.zeros((WORD_MEMORY, len(self.languages)), np.int64)

    def word(self, word: str) -> np.ndarray:
        """Log probability in each language, letter after letter; scaled on the way,
        so runs of any length have one."""
        width, n = len(self.languages), len(word)
        scale, ahead = np.zeros(width), {0: np.ones(width)}
        for start in range(n):
            now = ahead.pop(start)
            if start % 8 == 7:
                top = np.max([now, *ahead.values()], axis=0)
                scale += np.log(top)
                now = now / top
                ahead = {k: v / top for k, v in ahead.items()}
            state, end, single = 0, start, False
            while end < n and (state := self.children.get((state, word[end]), -1)) >= 0:
                end += 1
                if (k := self.ends[state]) >= 0:
                    ahead[end] = ahead.get(end, 0.0) + now * self.chance[k]
                    single |= end == start + 1
            if not single:
                ahead[start + 1] = ahead.get(start + 1, 0.0) + now * UNKNOWN
        return np.log(ahead[n]) + scale

    def words(self, words: list[str]) -> np.ndarray:
        """Log probabilities of many words: (word, language)."""
        out = np.zeros((len(words), len(self.languages)))
        short = sorted((k for k in range(len(words)) if len(words[k]) <= RUN), key=lambda k: len(words[k]))
        for at in range(0, len(short), 4096):
            of = short[at : at + 4096]
            out[of] = self._together([words[k] for k in of])
        for k, w in enumerate(words):
            if len(w) > RUN:
                out[k] = self.word(w)
        return out

    def _together(self, words: list[str]) -> np.ndarray:
        """words() for words of RUN letters at most, sorted by length."""
        lengths = np.array([len(w) for w in words])
        longest, width = int(lengths[-1]), len(self.languages)
        letters = np.array(words, f"<U{longest}").view(np.uint32).reshape(len(words), longest).astype(np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, letters), max(len(self.alphabet) - 1, 0))
        codes = np.where(self.alphabet[at] == letters, at + 1, 0) if len(self.alphabet) else np.zeros_like(letters)
        ahead = np.zeros((longest + 1, len(words), width))
        ahead[0] = 1.0
        for start in range(longest):
            here = np.arange(np.searchsorted(lengths, start, "right"), len(words))  # words that reach beyond
            state, now, single = np.zeros(len(here), np.int64), ahead[start], np.zeros(len(words), bool)
            for end in range(start + 1, longest + 1):
                key = state * self.width + codes[here, end - 1]
                move = np.minimum(np.searchsorted(self.moves, key), len(self.moves) - 1)
                live = (self.moves[move] == key) if len(self.moves) else np.zeros(len(here), bool)
                here, state = here[live], self.targets[move[live]] if len(self.moves) else state[live]
                if not len(here):
                    break
                piece = self.ends[state]
                whole = piece >= 0
                ahead[end, here[whole]] += now[here[whole]] * self.chance[piece[whole]]
                if end == start + 1:
                    single[here[whole]] = True
            ahead[start + 1, ~single] += now[~single] * UNKNOWN
        return np.log(ahead[lengths, np.arange(len(words))])

    def _sum(self, words: list[str], starts: list[int]) -> np.ndarray:
        """Sums of logs of the words from each start to the next."""
        new = list(set(words).difference(self.rows))
        if len(self.rows) + len(new) > WORD_MEMORY:
            self.rows.clear()
            new = list(set(words))
        if new:
            base = len(self.rows)
            self.logs[base : base + len(new)] = np.rint(self.words([WORD_MARK + w for w in new]) * UNIT)
            self.rows.update(zip(new, range(base, base + len(new))))
        found = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        return np.add.reduceat(self.logs[found], starts, axis=0)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        sums = np.zeros((len(texts), len(self.languages)), np.int64)
        some = np.zeros(len(texts), bool)
        held: list[str] = []
        owners: list[int] = []
        starts: list[int] = []

        def flush() -> None:
            if held:
                np.add.at(sums, owners, self._sum(held, starts))
                some[owners] = True
                held.clear(), owners.clear(), starts.clear()

        for k, text in enumerate(texts if self.languages else []):
            for words in words_of(text or ""):
                for at in range(0, len(words), AT_ONCE):
                    part = words[at : at + AT_ONCE]
                    if len(held) + len(part) > AT_ONCE:
                        flush()
                    owners.append(k)
                    starts.append(len(held))
                    held += part
        flush()
        best = sums.argmax(axis=1) if self.languages else None
        out = []
        for k in range(len(texts)):
            if not some[k]:
                out.append(("und", 0.0))
                continue
            behind = (sums[k] - sums[k, best[k]]) / UNIT
            out.append((self.languages[best[k]], float(1.0 / np.exp(np.maximum(behind, -700.0)).sum())))
        return out


def predict(
    df: DataFrame, model: dict[str, dict[str, float]], id_col: str = "doc_id", text_col: str = "text",
    more: tuple[str, ...] = (),
) -> DataFrame:
    """id_col, the columns named in more, lang_pred and score for every whole text."""
    shared, key = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def factory():
        scorer = kept(key, lambda: Scorer(shared.value))
        return lambda *cols: ((*row, *found) for *row, found in zip(*cols[:-1], scorer.predict(cols[-1])))

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (id_col, *more))
    return map_rows(df.select(id_col, *more, text_col), factory, f"{kinds}, lang_pred string, score double")


def language_of(text: Column, spark, model: dict[str, dict[str, float]]) -> Column:
    """The predicted language as a column (Arrow arrays), beside a row's others."""
    shared, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def predicted(texts: pa.Array) -> pa.Array:
        scorer, out = kept(key, lambda: Scorer(shared.value)), []
        for at in range(0, len(texts), 500):
            out += [lang for lang, _ in scorer.predict(texts.slice(at, 500).to_pylist())]
        return pa.array(out, pa.string())

    predicted.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    # Nondeterministic only in name: else a filter on it would have it computed twice.
    return F.arrow_udf(predicted, "string").asNondeterministic()(text)


def learning_rows(documents: DataFrame) -> DataFrame:
    rows = documents.select("doc_id", "text", "lang")
    return rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))


def identify(documents: DataFrame, pieces: list[str], per_language: int = PER_LANGUAGE) -> DataFrame:
    """Learn from the rows with a language that aren't held out, predict all rows:
    doc_id, held_out, lang_pred, score."""
    rows = documents.select("doc_id", "text", "lang")
    model = train(learning_rows(documents), pieces, per_language=per_language)
    out = predict(rows.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
