"""Token counts by linear longest match: greedy word-piece lengths without building a piece.

A trie holds the vocabulary; word-initial pieces hang below one root, continuing pieces
below another.  A node's failure link leads to where matching goes on after the longest
pieces on its path were taken off, and its popped count says how many those were.  A
word is then read once, symbol by symbol: following a failure adds the popped count, so
the work is linear in the word, however its pieces overlap.

The trie is built once from a vocabulary file (its size is the file's, whatever the
data) and broadcast.  Null texts and texts without a word have 0 tokens; a word that
cannot be cut into pieces counts as one unknown token.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEAD = -1
KNOWN_WORDS = 200_000  # word lengths a task remembers; beyond it the memory starts anew
KNOWN_SIZE = 64  # characters of the longest word that is remembered


def matcher(initial: list[str], continuing: list[str]) -> tuple[list[dict[str, int]], list[int], list[int]]:
    """Transitions, failure links and popped counts; node 0 starts words, node 1 continues them."""
    next_: list[dict[str, int]] = [{}, {}]
    final = {}
    for root, pieces in ((0, initial), (1, continuing)):
        for piece in pieces:
            at = root
            for c in piece:
                to = next_[at].get(c)
                if to is None:
                    to = len(next_)
                    next_[at][c] = to
                    next_.append({})
                at = to
            if at > 1:
                final[at] = True
    fail, popped = [DEAD] * len(next_), [0] * len(next_)
    queue = deque((0, 1))
    while queue:  # by depth, so that a node's links are known before its children's
        u = queue.popleft()
        for c, v in next_[u].items():
            if v in final:
                fail[v], popped[v] = 1, 1
            else:
                z, n = fail[u], popped[u]
                while z != DEAD and c not in next_[z]:
                    n += popped[z]
                    z = fail[z]
                if z != DEAD:
                    fail[v], popped[v] = next_[z][c], n
            queue.append(v)
    return next_, fail, popped


def word_length(word: str, next_, fail, popped) -> int:
    """Number of greedy longest-match pieces of a word; 1 if it has no such cut."""
    at = n = 0
    for c in word:
        to = next_[at].get(c)
        while to is None:
            z = fail[at]
            if z == DEAD:
                return 1
            n += popped[at]
            at = z
            to = next_[at].get(c)
        at = to
    while at > 1:
        if fail[at] == DEAD:
            return 1
        n += popped[at]
        at = fail[at]
    return n


def read_pieces(path: str, start: str = "▁") -> tuple[list[str], list[str]]:
    """Word-initial and continuing pieces of a sentence-piece file, without control pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    # the mark alone begins a word whose first symbol begins no piece
    return [p for p in plain if p.startswith(start)], [p for p in plain if not p.startswith(start)]


def token_counts(
    docs: DataFrame, key: str, text: str, initial: list[str], continuing: list[str], start: str = "▁"
) -> DataFrame:
    """doc_id, n_words, n_tokens per row.

    Words are parted by white space of any kind, that outside ASCII included, as the
    vocabulary's own library does; other operators of this folder part them at the six ASCII
    spaces only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(matcher(initial, continuing))
    kept = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("__text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = shared.value, {}
        for batch in batches:
            words, tokens = [], []
            for t in batch.column(1).to_pylist():
                parts = (t or "").split()
                n = 0
                for w in parts:
                    length = known.get(w)
                    if length is None:
                        length = word_length(start + w, *trie)
                        if len(w) <= KNOWN_SIZE:
                            if len(known) >= KNOWN_WORDS:
                                known.clear()
                            known[w] = length
                    n += length
                words.append(len(parts))
                tokens.append(n)
            cols = [batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_tokens"])

    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(count, f"doc_id {kind}, n_words long, n_tokens long")
