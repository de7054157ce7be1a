"""Greedy word-piece counts in linear time.

The pieces form a trie. Each node also keeps a failure link (the node to go on
from when no child matches) and the number of pieces popped on the way, both
precomputed. A word is read once, character by character; on a mismatch the
popped count is added and the link followed, so no piece is ever built and no
character is read twice.

Words are what str.split() leaves (parted at Unicode white space); each starts with the
vocabulary's word mark.
A character that no piece starts with counts as its UTF-8 bytes, as byte
fallback does, and ends the piece before it.

Defined cases: null and empty texts count 0; rows are independent, so repeated
rows, null ids and extra columns change nothing; an empty table stays empty.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

from pyspark.sql import DataFrame

from .shared import kept, map_rows

WORD_MARK = "▁"
WORD_MEMORY = 200_000


def load_pieces(path: str) -> list[str]:
    """Ordinary pieces of a sentencepiece model: no control, unknown or byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        sp.id_to_piece(i)
        for i in range(sp.get_piece_size())
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
    ]


class LongestMatch:
    """Trie with failure links; node 0 is the root."""

    def __init__(self, pieces: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        whole = [False]
        for piece in pieces:
            node = 0
            for c in piece:
                child = self.next[node].get(c)
                if child is None:
                    child = self.next[node][c] = len(self.next)
                    self.next.append({})
                    whole.append(False)
                node = child
            whole[node] = True
        # link -1: nothing can follow without first giving up characters that no piece covers
        self.link, self.popped = [-1] * len(self.next), [0] * len(self.next)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for c, child in self.next[node].items():
                if whole[child]:
                    self.link[child], self.popped[child] = 0, 1
                else:
                    link, popped = self.link[node], self.popped[node]
                    while link >= 0 and c not in self.next[link]:
                        popped += self.popped[link]
                        link = self.link[link]
                    if link >= 0:
                        self.link[child], self.popped[child] = self.next[link][c], popped
                queue.append(child)
        self.known: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Pieces of one word, greedy longest match from the left."""
        node, total, following, link, popped = 0, 0, self.next, self.link, self.popped
        stuck = False
        for c in word:
            while node >= 0 and c not in following[node]:
                if node == 0:
                    break
                if link[node] < 0:
                    stuck = True
                    break
                total += popped[node]
                node = link[node]
            if stuck:
                return self.plain(word)
            child = following[node].get(c)
            if child is None:
                total += len(c.encode("utf-8", "surrogatepass"))
            else:
                node = child
        while node > 0:
            if link[node] < 0:
                return self.plain(word)
            total += popped[node]
            node = link[node]
        return total

    def plain(self, word: str) -> int:
        """Direct longest match, for vocabularies where a piece's own prefix can't be
        covered by pieces; it equals count() wherever both are defined."""
        total, at, n = 0, 0, len(word)
        while at < n:
            node, best, k = 0, 0, at
            while k < n and (node := self.next[node].get(word[k], -1)) >= 0:
                k += 1
                if self.link[node] == 0 and self.popped[node] == 1:
                    best = k
            total += 1 if best else len(word[at].encode("utf-8", "surrogatepass"))
            at = best or at + 1
        return total

    def text(self, text: str | None) -> int:
        known, total = self.known, 0
        for w in (text or "").split():
            n = known.get(w)
            if n is None:
                n = self.count(WORD_MARK + w)
                if len(known) >= WORD_MEMORY:
                    known.clear()
                if len(w) <= 64:
                    known[w] = n
            total += n
        return total


def count_tokens(
    df: DataFrame, pieces: list[str], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id_col and n_tokens for every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(pieces)
    kind = df.schema[id_col].dataType.simpleString()

    def factory():
        automaton = kept(("pieces", hash(tuple(shared.value))), lambda: LongestMatch(shared.value))
        return lambda ids, texts: ((i, automaton.text(t)) for i, t in zip(ids, texts))

    return map_rows(df.select(id_col, text_col), factory, f"`{id_col}` {kind}, n_tokens bigint")
