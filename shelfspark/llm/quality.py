"""Quality rules by distribution divergence (operator 4).

A document's histogram of character classes and its histogram of common words are compared with references
by Jensen-Shannon distance (base 2, so 0 to 1).  There is one reference for each language: the mean histogram
of all its documents that pass the base rules, counted over the whole corpus.  A document belongs to the language
of COMMON of whose list most of its words are, a LEAST_SHARE at least, whatever its tag says; one below that share
belongs to the language of its tag if that has no list here.  A reference needs LEAST_DOCS documents (LEAST_TAGGED
where only the tag tells the language), so a tag can't excuse the junk under it; where there is none at all, the mean
of all documents that pass the base rules serves as the only one.  Because declared
languages can be wrong, each of a document's two distances is the least over all references (that may be one reference for
its characters and another for its words: taking the one nearest in both rejects good documents of sf0.01), and the document
is rejected if its character distance, its word distance or the mean of the two is above a limit.  Minimum lengths: each entry of
LIMITS and WORD_LIMITS holds from a number of words on, since histograms of short texts are far from any reference by chance;
documents under all of them pass.  The base rules of the contract come first.

Defined results: null and empty text have no words and fail the base rules; repeated rows are judged each;
a null tag, and one that names no language (NO_LANGUAGE), is no tag; an empty corpus gives no rows; extra columns are ignored by
``quality`` and kept by ``filter_quality``.
"""

from __future__ import annotations

import re

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.arrays import LOWER, WHITE, chunks, covered, mix, ngrams, per_document, valid_starts, word_hashes, words
from shelfspark.llm.common import bounded_batches, unused

#: Frequent function words of each language.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were her all she there would their we him been has when who will no more if out so".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son ou aux sa cette ses mais comme on tout nous été fait leur deux peut même ont".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está".split(),
}
_WORDS = sorted({w for ws in COMMON.values() for w in ws})
CLASSES = 8
GUARD_WORDS = 50
class Band(NamedTuple):
    """Limits for documents of least words or more, up to the next band; a limit of None isn't looked at. mean: of both distances."""

    least: int
    chars: float
    words: float | None
    mean: float


#: Fitted on the documents of sf0.1 with an even id that are labelled and pass the base rules: where good and junk ones lie apart (mean, from 100
#: words on) the limit is midway, else just beyond the largest good distance. The rest of sf0.1 and the other tables are for reports only.
BANDS = (Band(50, 0.29, 0.365, 0.29), Band(100, 0.29, None, 0.224), Band(300, 0.29, None, 0.186))
#: A language of COMMON: labelled good documents of sf0.1 have 16 % of their words or more in its list, 99 % of junk under 10 %.
LEAST_SHARE = 0.1
LEAST_DOCS = 10
LEAST_TAGGED = 200
#: At most so many tags without a list become references, those with most documents.
MOST_TAGGED = 64
NO_LANGUAGE = {"", "und", "unk", "unknown", "none", "null", "nan", "xx", "xxx", "zxx", "mis", "mul"}
#: The reference of all documents, used when no language has one.
POOLED = "*"
#: How many tags a worker sums before it sends them on.
FLUSH = 200
#: Histograms are summed as whole numbers of this unit, so sums don't depend on the order of rows.
UNIT = 1_000_000


def _class_table() -> np.ndarray:
    """0 small letter, 1 capital letter, 2 digit, 3 white space, 4 sentence mark, 5 symbol, 6 other ASCII, 7 start of a character beyond ASCII, 255 the rest of one."""
    out = np.full(256, 6, np.uint8)
    out[[*range(0x61, 0x7B)]] = 0
    out[[*range(0x41, 0x5B)]] = 1
    out[[*range(0x30, 0x3A)]] = 2
    out[WHITE] = 3
    out[list(b".,;:!?'\"()-")] = 4
    out[list(b"#*$%&|<>")] = 5
    out[0x80:] = 7
    out[0x80:0xC0] = 255
    return out


_CLASS = _class_table()
_STRIP = np.zeros(256, bool)
_STRIP[list(b".,;:!?'\"()")] = True


def _common_table() -> tuple[np.ndarray, np.ndarray]:
    raw = " ".join(_WORDS).encode()
    data = np.frombuffer(raw, np.uint8)
    s, e, _ = words(data, np.array([0, len(data)]))
    h = word_hashes(data, s, e)
    order = np.argsort(h)
    return h[order], order


_HASHES, _INDEX = _common_table()
_LISTED = np.array([[w in set(ws) for w in _WORDS] + [False] for ws in COMMON.values()]).T


def _tag(lang) -> str | None:
    """The language that a tag names ('pt-BR' is pt), if it is one without a list in COMMON."""
    name = re.split("[-_]", str(lang).strip().lower())[0] if lang is not None else ""
    return None if name in NO_LANGUAGE or name in COMMON else name


def class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many characters of each class each document has."""
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64) * 256, np.diff(offsets))
    return np.bincount(doc + _CLASS[data], minlength=256 * (len(offsets) - 1)).reshape(-1, 256)[:, :CLASSES]


def common_counts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often each document has each common word, in small letters and without marks at its end; last, all other words."""
    low = LOWER[data]
    n = len(at) - 1
    trim = ends - (_STRIP[data[np.maximum(ends - 1, 0)]] & (ends - starts > 1)) if len(ends) else ends
    short = np.flatnonzero(trim - starts <= 24)
    h = word_hashes(low, starts[short], trim[short])
    k = np.minimum(np.searchsorted(_HASHES, h), len(_HASHES) - 1)
    hit = _HASHES[k] == h
    doc = np.searchsorted(at, short[hit], "right") - 1
    out = np.zeros((n, len(_WORDS) + 1), np.int64)
    np.add.at(out, (doc, _INDEX[k[hit]]), 1)
    out[:, -1] = np.diff(at) - out.sum(1)
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Between each row of p and q, all summing to 1."""
    m = (p + q) / 2

    def kl(a):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log2(a / m), 0).sum(-1)

    return np.sqrt(np.maximum(0, (kl(p) + kl(np.broadcast_to(q, p.shape))) / 2))


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(1, counts.sum(1, keepdims=True))


def fit_references(docs: DataFrame, *, text: str = "text", lang: str = "lang", guard_words: int = GUARD_WORDS) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The mean histograms of each language. Summed in the workers first, so what is shuffled is a row for each bin and language, and only languages with enough documents are collected."""
    bounded_batches(docs.sparkSession)
    listed = list(COMMON)

    def rows_of(total):
        for name, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(x)), pa.array(np.arange(len(x)), pa.int32()), pa.array(x, pa.int64())], names=["lang", "bin", "n"])

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for a, _, data, offsets in chunks(batch.column(1)):
                s, e, at = words(data, offsets)
                common = common_counts(data, s, e, at)
                both = np.concatenate([_shares(class_counts(data, offsets)), _shares(common), np.ones((len(offsets) - 1, 1))], axis=1)
                both = np.rint(both * UNIT).astype(np.int64)
                hits = common @ _LISTED
                share = hits.max(1) / np.maximum(1, np.diff(at))
                for k in np.flatnonzero((np.diff(at) >= guard_words) & ~base_failed(base_counts(data, offsets))):
                    name = listed[hits[k].argmax()] if share[k] >= LEAST_SHARE else _tag(langs[a + k])
                    for x in (POOLED, name):
                        if x is not None:
                            total[x] = total.get(x, 0) + both[k]
            if len(total) > FLUSH:
                yield from rows_of(total)
                total = {}
        yield from rows_of(total)

    sums = docs.select(lang, text).mapInArrow(run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    size = F.max(F.when(F.col("bin") == CLASSES + len(_WORDS) + 1, F.col("n"))) / UNIT
    need = F.when(F.col("lang") == POOLED, 1).when(F.col("lang").isin(listed), LEAST_DOCS).otherwise(LEAST_TAGGED)
    found = sums.groupBy("lang").agg(size.alias("size"), F.collect_list(F.struct("bin", "n")).alias("bins")).where(F.col("size") >= need)
    first = F.when(F.col("lang").isin(POOLED, *listed), 0).otherwise(1)
    rows = found.orderBy(first, F.desc("size"), "lang").limit(1 + len(listed) + MOST_TAGGED).collect()
    tagged = [r for r in rows if r["lang"] not in (POOLED, *listed)][:MOST_TAGGED]
    own = [r for r in rows if r["lang"] in listed] + tagged or rows
    out = {}
    for r in sorted(own, key=lambda r: r["lang"]):
        x = np.zeros(CLASSES + len(_WORDS) + 2)
        for k, n in r["bins"]:
            x[k] = n
        out[r["lang"]] = (_shares(x[None, :CLASSES])[0], _shares(x[None, CLASSES:-1])[0])
    return out


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The contract's counts of each document of a chunk."""
    s, e, at = words(data, offsets)
    white = WHITE[data]
    first = (data & 0xC0) != 0x80
    symbol = _CLASS[data] == 5
    h = word_hashes(data, s, e)
    repeat = np.zeros(len(s), bool)
    grams = ngrams(h, 3)
    if len(grams):
        ok = np.flatnonzero(valid_starts(at, 3, len(grams)))
        key = mix(grams[ok] + np.repeat(np.arange(len(at) - 1), np.maximum(np.diff(at) - 2, 0)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = ok[count[inverse] > 1]
        repeat = covered(twice, twice + 3, len(s))
    return {"n_words": np.diff(at), "word_chars": per_document(first & ~white, offsets), "n_symbols": per_document(symbol, offsets), "n_dup_lines": dup_lines(data, offsets, s), "n_repeat_words": per_document(repeat, at)}


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


def dup_lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Lines (between line feeds) that have a word and equal an earlier line of their document."""
    n = len(offsets) - 1
    feed = np.flatnonzero(data == 0x0A)
    line_start = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], feed + 1]))
    line_start = line_start[line_start < len(data)]
    if not len(line_start):
        return np.zeros(n, np.int64)
    line_end = np.append(line_start[1:], len(data))
    line_end = line_end - (data[line_end - 1] == 0x0A)
    word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end = line_start[word], line_end[word]
    doc = np.searchsorted(offsets, line_start, "right") - 1
    key = mix(word_hashes(data, line_start, line_end) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at = np.unique(key, return_index=True)
    return np.bincount(doc, minlength=n) - np.bincount(doc[at], minlength=n)


def verdicts(data: np.ndarray, offsets: np.ndarray, references: dict, bands: tuple[Band, ...] = BANDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kept, character distance, word distance) of each document."""
    s, e, at = words(data, offsets)
    n_words = np.diff(at)
    chars, common = _shares(class_counts(data, offsets)), _shares(common_counts(data, s, e, at))
    if not references:
        return np.ones(len(n_words), bool), np.zeros(len(n_words)), np.zeros(len(n_words))
    by_chars = np.min([js_distance(chars, r[0]) for r in references.values()], axis=0)
    by_words = np.min([js_distance(common, r[1]) for r in references.values()], axis=0)
    bad = np.zeros(len(n_words), bool)
    for band, end in zip(bands, [b.least for b in bands[1:]] + [math.inf], strict=True):
        over = (by_chars > band.chars) | (by_chars + by_words > 2 * band.mean)
        if band.words is not None:
            over |= by_words > band.words
        bad |= (n_words >= band.least) & (n_words < end) & over
    return ~bad, by_chars, by_words


def quality(docs: DataFrame, references: dict, *, text: str = "text", keys: tuple[str, ...] = ("doc_id",), bands: tuple[Band, ...] = BANDS) -> DataFrame:
    """keys, the contract's counts, base_failed, kept, and both distances. Map only."""
    bounded_batches(docs.sparkSession)
    source = docs.select(*keys, F.col(text).alias(unused(list(keys), "__text")))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]) + "".join(f", {x} long" for x in names) + ", base_failed boolean, kept boolean, char_distance double, word_distance double"

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(batch.num_columns - 1)):
                counts = base_counts(data, offsets)
                failed = base_failed(counts)
                ok, by_chars, by_words = verdicts(data, offsets, references, bands)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), *(pa.array(counts[x], pa.int64()) for x in names), pa.array(failed), pa.array(ok & ~failed), pa.array(by_chars), pa.array(by_words)], names=[*batch.schema.names[:-1], *names, "base_failed", "kept", "char_distance", "word_distance"])

    return source.mapInArrow(run, schema)


def filter_quality(docs: DataFrame, references: dict, *, text: str = "text", bands: tuple[Band, ...] = BANDS) -> DataFrame:
    """The rows of docs that are kept, with all their columns. Map only."""
    bounded_batches(docs.sparkSession)
    place = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            keep = []
            for _, _, data, offsets in chunks(batch.column(place)):
                counts = base_counts(data, offsets)
                failed = base_failed(counts)
                keep.append(verdicts(data, offsets, references, bands)[0] & ~failed)
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    return docs.mapInArrow(run, docs.schema)
