"""Fill-in-middle by displacement scatter: texts cut into prefix, middle and suffix and put in a new order.

A text is a sequence of lines (a line keeps its newline).  Two cuts, drawn from a hash of
its id, part them; the output holds the parts behind marks, suffix last (psm) or first
(spm), or is the text itself (plain).

All texts of a piece are laid end to end as bytes and moved at once.  The cuts are found by
one scan; every part of a text is moved by one distance, so a difference array with the
change of distance at the start of each part, summed up, gives the distance of every byte.
One scatter then writes all outputs.  The way back scans the outputs for the marks, sums the
same kind of array over the bytes of the texts, and gathers.

A text that holds a mark stays plain, so the marks of an output are its own: none can arise
where two parts meet, as a mark always stands between them.  Cuts lie behind newlines or at
the ends, never inside a character.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm.store import by_batch
from textwarden.llm.words import pieces

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
WIDTH = 3  # bytes of a mark
SEED, FIM_PERCENT, SPM_PERCENT = 7, 100, 50
FORMS = np.array(["plain", "psm", "spm"])
PLAIN, PSM, SPM = 0, 1, 2

#: The order of the parts in an output, by their number in the text: 0 prefix, 1 middle, 2 suffix.
ORDER = {PSM: (0, 2, 1), SPM: (2, 0, 1)}
MARKS = np.array([np.frombuffer(m.encode(), np.uint8) for m in (PREFIX, MIDDLE, SUFFIX)])


def drawn(ids: list, seed: int) -> np.ndarray:
    """Four numbers of 32 bits for every id: the first digits of the sha256 of seed:id; a null id is an empty one."""
    digests = [hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids]
    return np.frombuffer(b"".join(digests), ">u4").reshape(-1, 4).astype(np.int64)


def counts_before(found: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many of the (sorted) found places lie before each cut."""
    return np.searchsorted(found, cuts)


def mark_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where marks begin in the bytes, and which of MARKS they are."""
    at = np.flatnonzero(data[:-2] == ord("<")) if len(data) >= WIDTH else np.empty(0, np.int64)
    at = at[data[at + 2] == ord(">")]
    kind = np.full(256, -1)
    kind[MARKS[:, 1]] = range(len(MARKS))
    kinds = kind[data[at + 1]]
    return at[kinds >= 0], kinds[kinds >= 0]


def within(places: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Of the marks at these places, those that no text's end cuts in two."""
    return cuts[np.searchsorted(cuts, places, "right")] >= places + WIDTH if len(places) else np.empty(0, bool)


def shifts(starts: np.ndarray, moves: np.ndarray, size: int) -> np.ndarray:
    """The distance of every byte: parts begin at ``starts`` (rising, empty parts allowed) and move by ``moves``."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, starts, np.diff(moves, prepend=0))
    return np.cumsum(steps[:size])


def scatter(data: np.ndarray, cuts: np.ndarray, draws: np.ndarray, fim: int, spm: int):
    """All outputs of a piece of texts: their bytes and cuts, forms, lines per text, and the parts' borders in the text."""
    texts = len(cuts) - 1
    newlines = np.flatnonzero(data == ord("\n"))
    before = counts_before(newlines, cuts)
    full = np.diff(cuts) > 0
    open_ = full & (data[np.maximum(cuts[1:] - 1, 0)] != ord("\n")) if len(data) else full
    n = np.diff(before) + open_
    lo, hi = (f(draws[:, 0] % (n + 1), draws[:, 1] % (n + 1)) for f in (np.minimum, np.maximum))

    def border(lines: np.ndarray) -> np.ndarray:
        """The byte behind so many lines of each text."""
        if not len(newlines):
            return np.where(lines > 0, cuts[1:], cuts[:-1])
        behind = newlines[np.clip(before[:-1] + lines - 1, 0, len(newlines) - 1)] + 1
        return np.where(lines == 0, cuts[:-1], np.where(lines > np.diff(before), cuts[1:], behind))

    borders = np.stack([cuts[:-1], border(lo), border(hi), cuts[1:]], axis=1)
    places, _ = mark_places(data)
    marked = np.zeros(texts, bool)
    marked[np.searchsorted(cuts, places[within(places, cuts)], "right") - 1] = True
    forms = np.where(draws[:, 3] % 100 < spm, SPM, PSM)
    forms[~full | marked | (draws[:, 2] % 100 >= fim)] = PLAIN

    sizes = np.diff(borders, axis=1)
    out_cuts = np.r_[0, np.cumsum(np.diff(cuts) + 3 * WIDTH * (forms != PLAIN))]
    place = np.repeat(out_cuts[:-1, None], 3, axis=1)  # where each part begins in the outputs
    place[:, 1:] += np.cumsum(sizes[:, :2], axis=1)  # as it is for plain texts
    out = np.empty(out_cuts[-1], np.uint8)
    for form, order in ORDER.items():
        rows = np.flatnonzero(forms == form)
        at = out_cuts[rows]
        for part in order:
            out[at[:, None] + np.arange(WIDTH)] = MARKS[part]
            place[rows, part] = at + WIDTH
            at = at + WIDTH + sizes[rows, part]
    move = shifts(borders[:, :3].ravel(), (place - borders[:, :3]).ravel(), len(data))
    out[np.arange(len(data)) + move] = data
    return out, out_cuts, forms, n, borders


def gather(data: np.ndarray, cuts: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts behind a piece of outputs, from the outputs and their forms alone: bytes and cuts."""
    places, kinds = mark_places(data)
    keep = within(places, cuts)
    places, kinds = places[keep], kinds[keep]
    owner = np.searchsorted(cuts, places, "right") - 1
    moved = forms != PLAIN
    places, kinds, owner = (x[moved[owner]] for x in (places, kinds, owner))
    if len(places) != 3 * moved.sum() or (np.bincount(owner, minlength=len(forms))[moved] != 3).any():
        raise ValueError("an output does not hold each mark once")
    back = np.r_[0, np.cumsum(np.diff(cuts) - 3 * WIDTH * moved)]
    # parts in the order of the text, each with its place in the outputs
    ends = np.append(places[1:], len(data))
    ends = np.minimum(ends, cuts[owner + 1])
    order = np.lexsort((kinds, owner))
    starts, sizes, text = places[order] + WIDTH, (ends - places - WIDTH)[order], owner[order]
    plain = np.flatnonzero(~moved)
    starts, sizes, text = (np.r_[a, b] for a, b in ((starts, cuts[plain]), (sizes, np.diff(cuts)[plain]), (text, plain)))
    order = np.argsort(text, kind="stable")
    starts, sizes = starts[order], sizes[order]
    begins = np.r_[0, np.cumsum(sizes)][:-1]
    move = shifts(begins, starts - begins, int(back[-1]))
    return data[np.arange(back[-1]) + move], back


def strings(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Texts from their bytes and cuts."""
    return pa.LargeStringArray.from_buffers(
        len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())
    )


def joined(parts: list[pa.Array]) -> pa.Array:
    """The texts of all pieces as one column."""
    return pa.concat_arrays(parts).cast(pa.string()) if parts else pa.array([], pa.string())


def code_points(data: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Characters between neighbouring borders of each row."""
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    return np.diff(counts_before(begins, borders), axis=1)


def fill_in_middle(
    docs: DataFrame, key: str, text: str, seed: int = SEED, fim: int = FIM_PERCENT, spm: int = SPM_PERCENT
) -> DataFrame:
    """doc_id, n (lines), form, prefix_chars, middle_chars and output per row; row work, no shuffle.

    ``fim`` percent of the texts are cut, ``spm`` percent of these have the suffix first.  A
    null text is an empty one; empty texts and those with a mark in them are plain, their
    counts of characters null.  A null id draws as an empty one; rows repeated under one id
    draw alike.  Other columns are not carried, whatever they are called.
    """
    kept = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("__text"))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, outs, rows = batch.column(0).to_pylist(), [], []
        for first, data, cuts in pieces(batch.column(1)):
            draws = drawn(ids[first : first + len(cuts) - 1], seed)
            out, out_cuts, forms, n, borders = scatter(data, cuts, draws, fim, spm)
            outs.append(strings(out, out_cuts))
            rows.append((n, forms, code_points(data, borders)))
        n, forms, chars = (np.concatenate(x) for x in zip(*rows))
        plain = forms == PLAIN
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(FORMS[forms].tolist(), pa.string()),
             *(pa.array(chars[:, i], pa.int64(), mask=plain) for i in (0, 1)), joined(outs)],
            ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
        )

    kind = kept.schema["doc_id"].dataType.simpleString()
    return by_batch(
        kept, make, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restored(formed: DataFrame) -> DataFrame:
    """The rows of fill_in_middle with ``restored``: the text, rebuilt from output and form."""
    rows = formed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    number = {name: i for i, name in enumerate(FORMS.tolist())}

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        forms, backs = np.array([number[f] for f in batch.column(2).to_pylist()]), []
        for first, data, cuts in pieces(batch.column(5)):
            backs.append(strings(*gather(data, cuts, forms[first : first + len(cuts) - 1])))
        return pa.RecordBatch.from_arrays([*batch.columns, joined(backs)], [*batch.schema.names, "restored"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return by_batch(rows, make, f"{fields}, restored string")
