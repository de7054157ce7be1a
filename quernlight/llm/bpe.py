"""Exact BPE encoding by dynamic programming over prefixes.

A BPE vocabulary gives every prefix of a word one possible last token: a token
that ends there (found by a suffix-matching automaton over all tokens) and that
is compatible with the last token of what stands before it. Two tokens are
compatible if merging their concatenation gives back just these two. One pass
over the word stores that token for each prefix; following the back-pointers
from the end emits the ids.

Defined cases: a null text counts as empty; an empty text has no ids and the
digests of the empty string. Rows are independent, so repeated rows, null ids
and extra columns change nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable

import ahocorasick
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .shared import kept, map_rows

#: Words that one Python worker remembers twice over: those met lately, and those met before them.
WORD_MEMORY = 110_000
#: Count of tokens, their ids and their texts, both joined by spaces.
Entry = tuple[int, str, str]
SCHEMA = {
    "ids": "array<int>",
    "n_tokens": "bigint",
    "ids_sha256": "string",
    "decoded": "string",
    "decoded_sha256": "string",
}
_BEYOND_LATIN = re.compile(r"[^\x00-ɏ]")
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\x0b\x0c\ra-z0-9]+")
#: The library's words below U+0250: letters, numbers one by one, and what is neither, nor white space.
_LATIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[0-9²³¹¼½¾]|(?:[^\w\t\n\x0b\x0c\r \x85\xa0]|_)+")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixBPE:
    """Word-end BPE of one tokenizer file, given as its JSON text."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        library = Tokenizer.from_str(source)
        self.normal, self.split = library.normalizer, library.pre_tokenizer
        vocab: dict[str, int] = model["vocab"]
        # A token's place in the order of merges; tokens of one symbol come first.
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = [a + b for a, b in pairs]
        merged = set(made)
        first = [t for t in vocab if t not in merged]
        order = {t: k for k, t in enumerate(first + made)}
        self.id_text = [str(vocab[t]) for t in first + made]
        self.token_text = first + made
        self.halves = [(k, k) for k in range(len(first))] + [(order[a], order[b]) for a, b in pairs]
        self.merge = {(order[a], order[b]): order[a + b] for a, b in pairs}
        self.fits: dict[tuple[int, int], bool] = {}
        byte = byte_symbols()
        self.ends = ahocorasick.Automaton()
        for t, k in order.items():
            ended = bool(self.end) and t.endswith(self.end) and t != self.end
            inner = t[: -len(self.end)] if ended else t
            symbols = [byte[c] for c in inner]
            if ended:
                symbols[-1] += 256
            self.ends.add_word("".join(map(chr, symbols)), (len(symbols), k))
        self.ends.make_automaton()
        self.lately: dict[str, Entry] = {}
        self.before: dict[str, Entry] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE of the two tokens' text ends in just these tokens: undo
        merges from the latest one, and see if an earlier merge would cross."""
        known = self.fits.get((a, b))
        if known is not None:
            return known
        x, y, fits = a, b, True
        x_until = y_until = len(self.halves)  # the merges that take up x and y; of equal merges the leftmost is first
        while True:
            crossing = self.merge.get((x, y))
            if crossing is not None and crossing < x_until and crossing <= y_until:
                fits = False
                break
            left_single, right_single = self.halves[x][0] == x, self.halves[y][0] == y
            if left_single and right_single:
                break
            if right_single or (not left_single and x > y):
                x_until, x = x, self.halves[x][1]
            else:
                y_until, y = y, self.halves[y][0]
        if len(self.fits) > 200_000:
            self.fits.clear()
        self.fits[a, b] = fits
        return fits

    def encode_word(self, word: str) -> list[int]:
        """The word's tokens, by their place in the order of merges."""
        symbols = word.encode("utf-8", "surrogatepass").decode("latin-1")
        if self.end:
            symbols = symbols[:-1] + chr(256 + ord(symbols[-1]))
        n, fits, compatible = len(symbols), self.fits, self.compatible
        last, back = [-1] * (n + 1), [0] * (n + 1)
        for at, (length, token) in self.ends.iter(symbols):
            at += 1
            if last[at] < 0:
                start = at - length
                if start:
                    before = last[start]
                    ok = fits.get((before, token))
                    if not (compatible(before, token) if ok is None else ok):
                        continue
                last[at], back[at] = token, start
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return out[::-1]

    def pieces(self, text: str) -> list[str]:
        """Normalised words of a text without special tokens."""
        if text.isascii():
            return _ASCII_WORDS.findall(text.lower())
        if not _BEYOND_LATIN.search(text):
            return _LATIN_WORDS.findall(text.lower())
        # Byte-level words map back to their text one to one.
        normal = self.normal.normalize_str(text)
        cuts = [span for _, span in self.split.pre_tokenize_str(normal)]
        return [normal[a:b] for a, b in cuts]

    def word(self, word: str) -> Entry:
        found = self.before.get(word)
        if found is None:
            tokens = self.encode_word(word)
            found = len(tokens), " ".join([self.id_text[k] for k in tokens]), " ".join([self.token_text[k] for k in tokens])
        if len(word) <= 64:
            if len(self.lately) >= WORD_MEMORY:
                self.before, self.lately = self.lately, {}
            self.lately[word] = found
        return found

    def encode(self, text: str | None) -> list[Entry]:
        """One entry for each word or special token."""
        out: list[Entry] = []
        for k, part in enumerate(self.cut.split(text or "") if self.cut else [text or ""]):
            if k % 2:
                out.append((1, str(self.special[part]), part))
            elif part:
                words = self.pieces(part)
                found = list(map(self.lately.get, words))
                if None in found:
                    for at, entry in enumerate(found):
                        if entry is None:
                            found[at] = self.lately.get(words[at]) or self.word(words[at])
                out += found
        return out


def decode(tokens: Iterable[str]) -> str:
    """Without a decoder in the file, tokens are joined by one space."""
    return " ".join(tokens)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def bpe_encode(
    df: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    emit: tuple[str, ...] = ("ids", "n_tokens"),
) -> DataFrame:
    """id_col and, of SCHEMA, the columns named in emit, for every whole text."""
    with open(tokenizer_path, encoding="utf-8") as f:
        source = df.sparkSession.sparkContext.broadcast(f.read())
    kind = df.schema[id_col].dataType.simpleString()

    def factory():
        text = source.value
        model = kept(("bpe", hash(text)), lambda: PrefixBPE(text))

        def run(ids, texts):
            for i, text in zip(ids, texts):
                n, numbers, tokens = zip(*found) if (found := model.encode(text)) else ((), (), ())
                row: list = [i]
                for what in emit:
                    if what == "ids":
                        row.append(list(map(int, " ".join(numbers).split())))
                    elif what == "n_tokens":
                        row.append(sum(n))
                    elif what == "ids_sha256":
                        row.append(_sha(" ".join(numbers)))
                    else:
                        decoded = decode(tokens)
                        row.append(decoded if what == "decoded" else _sha(decoded))
                yield tuple(row)

        return run

    schema = f"`{id_col}` {kind}, " + ", ".join(f"{c} {SCHEMA[c]}" for c in emit)
    return map_rows(df.select(id_col, text_col), factory, schema)
