"""Language identification as mixture inference over character n-grams.

Training counts hashed character trigrams per language over all labelled texts; each
language is a smoothed distribution over the hash buckets.  A text is taken as drawn from
a mixture of the languages: expectation-maximisation estimates the proportions, and the
set of languages is the one of largest penalised likelihood (Schwarz's criterion).  The language of the text is the one of the largest share.

Case and everything but letters are ignored; words are framed by blanks.  A text that is
null or has no letter is ``und`` with score 0.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textwarden.llm.store import sliced

BUCKETS = 1 << 14
SMOOTHING = 0.5  # counts added to every bucket
STEPS = 2000  # of expectation-maximisation, at most
CLOSE = 0.02  # log likelihood that is still to be gained when it stops
EVERY_SET = 8  # languages up to which every set is looked at
PIECE = 1 << 20  # characters of a text looked at together
UNKNOWN = "und"


def letter_bits() -> bytes:
    """One bit per code point: is it a letter."""
    return np.packbits([chr(i).isalpha() for i in range(0x110000)]).tobytes()


def trigram_counts(text: str, letters: np.ndarray) -> np.ndarray | None:
    """Counts of the hashed trigrams of a text; None if it has no letter."""
    total = None
    for at in range(0, len(text), PIECE):
        part = text[max(0, at - 2) : at + PIECE].lower()
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        keep = letters[codes]
        if not keep.any():
            continue
        # letters, and one blank for every run of other characters
        codes = np.where(keep, codes, np.uint32(32))
        blank = ~keep
        codes = np.r_[np.uint32(32), codes[~(blank & np.r_[True, blank[:-1]])], np.uint32(32)]
        if codes[-2] == 32:
            codes = codes[:-1]
        h = (codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1]) * np.uint32(0x85EBCA77) + codes[2:]
        h = (h * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
        n = np.bincount(h, minlength=BUCKETS)
        total = n if total is None else total + n
    return total


def train(docs: DataFrame, text: str, lang: str) -> tuple[list[str], np.ndarray]:
    """The languages and their log-free bucket distributions, (BUCKETS, languages).

    Every labelled row counts.  Tasks send sums per language and bucket, so the model's
    size is that of the table of buckets, whatever the number of texts.
    """
    bits = docs.sparkSession.sparkContext.broadcast(letter_bits())
    kept = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    kept = kept.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = np.unpackbits(np.frombuffer(bits.value, np.uint8)).view(bool)
        sums: dict[str, np.ndarray] = {}
        for batch in sliced(batches):
            for lang_, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = trigram_counts(t, letters)
                if n is not None:
                    sums[lang_] = sums[lang_] + n if lang_ in sums else n
        for lang_, n in sums.items():
            at = np.flatnonzero(n)
            cols = [pa.array([lang_] * len(at)), pa.array(at), pa.array(n[at])]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "bucket", "n"])

    counts = kept.mapInArrow(count, "lang string, bucket long, n long")
    sums = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(sums.column("lang").to_pylist()))
    table = np.full((BUCKETS, len(langs)), SMOOTHING)
    column = {name: i for i, name in enumerate(langs)}
    cols = [column[x] for x in sums.column("lang").to_pylist()]
    np.add.at(table, (sums.column("bucket").to_numpy(), cols), sums.column("n").to_numpy())
    return langs, table / table.sum(axis=0)


def shares(counts: np.ndarray, likely: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the languages and the log likelihood, by expectation-maximisation.

    ``likely``: probability of each observed bucket under each language.  The likelihood is
    concave in the proportions, so its steepest slope towards a language bounds what is still to be
    gained: the steps end when that is next to nothing.
    """
    pi, n = start, counts.sum()
    for _ in range(STEPS):
        weight = (counts / (likely @ pi)) @ likely
        if weight.max() - n < CLOSE:
            break
        pi = pi * weight / n
    return pi, float(counts @ np.log(likely @ pi))


def mixture(counts: np.ndarray, likely: np.ndarray) -> dict[int, float]:
    """The language set of largest penalised likelihood, with proportions.

    One more language costs half the logarithm of the number of n-grams.  If no slope at the
    best single language exceeds that price, no other set can be better: the gain of any
    mixture is at most the largest slope.  Otherwise sets are tried by size, as long as all
    languages together would be worth the price of one more; up to EVERY_SET languages every set
    is, beyond that sets are grown and pruned one language at a time.
    """
    n, every = counts.sum(), likely.shape[1]
    price = 0.5 * np.log(n + 1)
    single = counts @ np.log(likely)
    first = int(single.argmax())
    slope = (counts / likely[:, first]) @ likely - n
    if slope.max() <= price:
        return {first: 1.0}

    def tried(chosen: tuple[int, ...]) -> tuple[float, tuple[int, ...], np.ndarray]:
        pi, value = shares(counts, likely[:, chosen], np.full(len(chosen), 1 / len(chosen)))
        return value - price * (len(chosen) - 1), chosen, pi

    best = (float(single[first]), (first,), np.ones(1))
    if every > EVERY_SET:
        best = _stepwise(best, every, tried)
    else:
        most = tried(tuple(range(every)))[0] + price * (every - 1)  # no set is likelier
        for size in range(2, every + 1):
            if most - price * (size - 1) <= best[0]:
                break
            best = max([best, *map(tried, itertools.combinations(range(every), size))], key=lambda x: x[0])
    return {i: float(p) for i, p in zip(best[1], best[2])}


def _stepwise(best: tuple, every: int, tried) -> tuple:
    """The set that no language more, less or exchanged makes better."""
    while True:
        chosen = set(best[1])
        near = [chosen | {i} for i in range(every)] + [chosen - {i} for i in chosen if len(chosen) > 1]
        near += [chosen - {i} | {j} for i in chosen for j in range(every) if len(chosen) > 1]
        found = max([best, *(tried(tuple(sorted(s))) for s in near if s != chosen)], key=lambda x: x[0])
        if found[0] <= best[0] + CLOSE:
            return best
        best = found


def background_share(counts: np.ndarray, likely: np.ndarray) -> float:
    """The proportion of a background that has all buckets alike, beside all languages."""
    every = np.c_[likely, np.full(len(likely), 1 / BUCKETS)]
    return float(shares(counts, every, np.full(every.shape[1], 1 / every.shape[1]))[0][-1])


def identify(docs: DataFrame, key: dict[str, str], text: str, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """Columns ``key`` (new name: column), lang_pred, score, ``mixture``, a map of proportions, ``gain`` and ``foreign``.

    The score is the proportion of the predicted language.  The gain is the logarithm of how
    much likelier the text is under its mixture than under a background that has all n-grams
    alike; null where nothing was inferred.  Where it is negative, ``foreign`` is the part of
    the text that goes to the background when that is one more language of the mixture; else 0.  A model without languages (no
    labelled text to learn from) predicts null, with score 0, for every text that has a letter.
    """
    langs, table = model
    context = docs.sparkSession.sparkContext
    bits, shared = context.broadcast(letter_bits()), context.broadcast((langs, table))
    kept = docs.select(*[F.col(c).alias(n) for n, c in key.items()])
    width = len(key)
    at_text = next((i for i, c in enumerate(key.values()) if c == text), width)
    if at_text == width:
        kept = docs.select(*[F.col(c).alias(n) for n, c in key.items()], F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = np.unpackbits(np.frombuffer(bits.value, np.uint8)).view(bool)
        names, likely = shared.value
        for batch in sliced(batches):
            preds, scores, maps, gains, foreign = [], [], [], [], []
            for t in batch.column(at_text).to_pylist():
                n = trigram_counts(t, letters) if t else None
                if n is None or not names:
                    preds.append(UNKNOWN if n is None else None)
                    scores.append(0.0)
                    maps.append([])
                    gains.append(None)
                    foreign.append(0.0)
                    continue
                at = np.flatnonzero(n)
                counts, seen = n[at].astype(float), likely[at]
                found = mixture(counts, seen)
                mix = seen[:, list(found)] @ np.array(list(found.values()))
                gains.append(float(counts @ np.log(mix * BUCKETS)))
                foreign.append(background_share(counts, seen) if gains[-1] < 0 else 0.0)
                top = max(found, key=lambda i: (found[i], -i))
                preds.append(names[top])
                scores.append(min(1.0, max(0.0, found[top])))
                maps.append([(names[i], p) for i, p in sorted(found.items())])
            cols = [*batch.columns[:width], pa.array(preds, pa.string()), pa.array(scores, pa.float64()),
                    pa.array(maps, pa.map_(pa.string(), pa.float64())), pa.array(gains, pa.float64()),
                    pa.array(foreign, pa.float64())]
            names_out = ["lang_pred", "score", "mixture", "gain", "foreign"]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:width], *names_out])

    told = StructType.fromDDL("lang_pred string, score double, mixture map<string,double>, gain double, foreign double")
    return kept.mapInArrow(run, StructType([*kept.schema.fields[:width], *told.fields]))
