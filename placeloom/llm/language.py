"""Languages of documents and of their sentences, with error-correcting output codes (problem 5).

Each language has a codeword. One binary n-gram classifier per bit predicts whether a sentence's
language has that bit set; loss-weighted decoding picks the codeword nearest to all predicted
bits and says how far the second best is. Sentences are scored in batches: characters are folded
to a small alphabet, n-grams hashed into a fixed number of buckets, and the bucket weights summed
by sentence, all in numpy.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.llm.plain import TO_LATIN

LANGUAGES = ("en", "es", "fr", "de", "it", "nl", "pt", "id", "tr", "sr")
BITS, BUCKETS, ORDERS = 15, 1 << 16, (4,)
#: The classifiers are fitted on a bounded sample: about this many labelled rows of each language.
SAMPLE_PER_LANGUAGE = 1_500
#: A line whose lead is under this share of the median lead of the sample is no text in a language.
FLOOR_SHARE = 0.25

# Codes and names that mean one of the languages, other than its two-letter code.
SPELLINGS = (
    "en:eng english; es:spa spanish español castellano; fr:fra fre french français; de:deu ger german deutsch; "
    "it:ita italian italiano; nl:nld dut dutch nederlands; pt:por portuguese português; id:ind in indonesian; "
    "tr:tur turkish türkçe; sr:srp scc serbian srpski sh"
)
LANGUAGE_OF = {w: k for k in LANGUAGES for w in [k]} | {w: p.split(":")[0].strip() for p in SPELLINGS.split(";") for w in p.split(":")[1].split()}
# Codes that name no language.
NO_LANGUAGE = ("", "und", "zxx", "unknown", "unk", "mis", "mul", "none", "null", "n/a", "na", "nan", "xx", "qme", "qst", "art", "?", "-", "other", "undefined")


def codebook(classes: int = len(LANGUAGES), bits: int = BITS, seed: int = 11) -> np.ndarray:
    """Codewords of +1 and -1: of many random balanced codes the one with the largest least distance."""
    rng, best, least = np.random.default_rng(seed), None, -1
    half = np.array([1] * (classes // 2) + [-1] * (classes - classes // 2))
    for _ in range(3000):
        code = np.array([rng.permutation(half) for _ in range(bits)]).T
        apart = (bits - code @ code.T) // 2 + np.eye(classes, dtype=int) * bits
        if apart.min() > least:
            best, least = code, apart.min()
    return best.astype(np.float32)


def _alphabet() -> np.ndarray:
    """Letter class of each code point below 0x20000: letters folded in case and look, all else 0, line end 1."""
    table = np.zeros(0x20000, np.uint32)
    for cp in (*range(0x41, 0x600), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07), *range(0xFF21, 0xFF5B), *range(0x1D400, 0x1D7CC)):
        ch = chr(cp)
        if ch.isalpha():
            low = unicodedata.normalize("NFKC", ch).lower()[:1]
            table[cp] = ord(TO_LATIN.get(low, low))
    table[0x27] = table[0x2019] = 0x27
    table[10] = 1
    return table


ALPHABET = _alphabet()
# What joins nothing and is left out before n-grams are made.
_HIDDEN = np.array([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x300, 0x370)])


def ngrams(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(line number, bucket) of every n-gram of every line. A space stands at both ends of each word."""
    text = " " + " \n ".join(lines) + " \n"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if points.max(initial=0) > 127:
        points = points[~np.isin(points, _HIDDEN)]
    code = ALPHABET[np.minimum(points, 0x1FFFF)]
    code = code[~((code == 0) & (np.concatenate([[1], code[:-1]]) == 0))]
    line = np.cumsum(code == 1) - (code == 1)
    rows, hashes = [], []
    for n in ORDERS:
        h = np.full(max(0, len(code) - n + 1), n, np.uint64)
        for i in range(n):
            h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (code[i : len(code) - n + 1 + i].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        at = line[: len(h)]
        keep = (at == line[n - 1 :]) & (code[n - 1 :] != 1)
        rows.append(at[keep])
        hashes.append(((h[keep] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1))
    return np.concatenate(rows), np.concatenate(hashes)


class LanguageModel:
    """Bit classifiers over n-gram buckets and the codewords they are decoded with."""

    def __init__(self, weights: np.ndarray, code: np.ndarray, classes: tuple[str, ...]):
        self.weights, self.code, self.classes, self.floor = weights, code, classes, 0.0

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], classes: tuple[str, ...] = LANGUAGES, rounds: int = 2) -> LanguageModel:
        """Fits one binary classifier per bit. After the first round, texts whose label the model
        contradicts are left out, so that wrong labels don't count."""
        code, labels = codebook(len(classes)), np.array(labels)
        row, bucket = ngrams([t.replace("\n", " ") for t in texts])
        model, keep = None, np.ones(len(texts), bool)
        if not len(texts):
            return cls(np.zeros((BUCKETS, code.shape[1]), np.float32), code, classes)
        for _ in range(rounds):
            use = keep[row]
            seen = np.zeros((len(classes), BUCKETS))
            np.add.at(seen, (labels[row[use]], bucket[use]), 1)
            share = (seen + 0.02) / (seen.sum(axis=1, keepdims=True) + 0.02 * BUCKETS)
            weights = np.stack([np.log(share[code[:, b] > 0].mean(axis=0)) - np.log(share[code[:, b] < 0].mean(axis=0)) for b in range(code.shape[1])], axis=1)
            model = cls(weights.astype(np.float32), code, classes)
            best, _, gap = model.decode(*model.bits_of(row, bucket, len(texts)))
            keep = best == labels
        model.floor = float(np.median(gap[keep])) * FLOOR_SHARE if keep.any() else 0.0
        return model

    def bits_of(self, row: np.ndarray, bucket: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
        """Summed evidence for each bit of each line, and the lines' numbers of n-grams."""
        total, count = np.zeros((lines, self.code.shape[1]), np.float32), np.bincount(row, minlength=lines)
        turns = np.flatnonzero(np.diff(row, prepend=-1) != 0)
        if len(turns):
            sums = np.add.reduceat(self.weights[bucket], turns, axis=0)
            np.add.at(total, row[turns], sums)
        return total, count

    def decode(self, bits: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class number, confidence, lead) by the least logistic loss over the bits.

        The lead is the evidence an n-gram gives on average for the best codeword over the second;
        under the model's floor the line is no text in any of the languages. The confidence is the
        share of the best class when each bit counts with its evidence an n-gram."""
        share = bits / np.maximum(count, 1)[:, None]
        margin = np.clip(4 * share, -30, 30)
        loss = np.logaddexp(0, -margin) @ (self.code > 0).T.astype(np.float32) + np.logaddexp(0, margin) @ (self.code < 0).T.astype(np.float32)
        like = np.exp(loss.min(axis=1, keepdims=True) - loss)
        best, score, at = loss.argmin(axis=1), share @ self.code.T, np.arange(len(bits))
        own = score[at, best]
        score[at, best] = -np.inf
        return best, 1 / like.sum(axis=1), own - score.max(axis=1, initial=-np.inf)

    def predict(self, lines: list[str], block: int = 4000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class number, confidence, lead) of each line."""
        parts = []
        for i in range(0, len(lines), block):
            some = lines[i : i + block]
            parts.append(self.decode(*self.bits_of(*ngrams(some), len(some))))
        return tuple(np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0, int), np.zeros(0), np.zeros(0))


def language_code(label: Column) -> Column:
    """The two-letter code of one of LANGUAGES that a label means; 'other' for a code of another
    language; null where it names none. Case and region don't count."""
    low = F.lower(F.trim(label))
    first = F.regexp_extract(low, "^[^-_ ]*", 0)
    known = F.create_map(*(F.lit(x) for pair in LANGUAGE_OF.items() for x in pair))
    return F.when(low.isNull() | low.isin(*NO_LANGUAGE) | first.isin(*NO_LANGUAGE), None).otherwise(F.coalesce(known[low], known[first], F.lit("other")))


def sentences(text: Column) -> Column:
    """The text without links, mentions, tags and entities, one sentence a line."""
    clean = F.regexp_replace(text, r"https?://\S+|[@#][\p{L}\p{N}_]+|&#?[A-Za-z0-9]+;|\bRT\b:?", " ")
    return F.regexp_replace(clean, r"(?<=[.!?])\s+|\n+", "\n")


def fit_languages(docs: DataFrame, text: str, label: str, sample: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """The model of a bounded sample: about `sample` rows of each labelled language, chosen by hash."""
    rows = docs.select(F.col(text).alias("t"), language_code(F.col(label)).alias("c")).where(F.col("c").isin(*LANGUAGES) & F.col("t").isNotNull())
    counts = {r["c"]: r["count"] for r in rows.groupBy("c").count().collect()}
    share = F.create_map(*(F.lit(x) for c in LANGUAGES for x in (c, min(1.0, sample / max(1, counts.get(c, 1))))))
    chosen = rows.where(F.pmod(F.xxhash64("t", F.lit(7)), F.lit(1 << 30)) < share[F.col("c")] * (1 << 30))
    got = chosen.select(sentences(F.col("t")).alias("t"), "c").limit(2 * sample * len(LANGUAGES)).collect()
    got = sorted((r["c"], r["t"]) for r in got)
    return LanguageModel.fit([t for _, t in got], [LANGUAGES.index(c) for c, _ in got])


def label_languages(docs: DataFrame, key: list[str], text: str, model: LanguageModel, least_words: int = 5) -> DataFrame:
    """(key columns, segments): segments is an array of struct<lang, confidence, sentence> with one
    entry for each language the document holds a whole sentence in, the main one first.

    A sentence counts for a second language when it has at least least_words words and its lead
    passes the model's floor. A document no sentence of which passes is judged as a whole; null,
    empty and wordless texts and lists of names get an empty array.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), "segments array<struct<lang:string,confidence:double,sentence:int>>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shipped.value
        for pdf in batches:
            split = [(t or "").split("\n") for t in pdf["_text"]]
            lines = [s for x in split for s in x]
            best, sure, lead = m.predict(lines)
            out, at = [], 0
            doubtful = []
            for d, x in enumerate(split):
                found: dict[int, list] = {}
                for k in range(at, at + len(x)):
                    words = lines[k].count(" ") + 1
                    if words >= least_words and lead[k] >= m.floor:
                        f = found.setdefault(int(best[k]), [0, 0.0, k - at])
                        f[0] += words
                        f[1] = max(f[1], float(sure[k]))
                at += len(x)
                ranked = sorted(found.items(), key=lambda f: (-f[1][0], f[0]))
                out.append([(m.classes[c], conf, first) for c, (_, conf, first) in ranked])
                if not found:
                    doubtful.append(d)
            whole = m.predict([" ".join(split[d]) for d in doubtful])
            for d, c, conf, gap in zip(doubtful, *whole):
                if gap >= m.floor:
                    out[d] = [(m.classes[c], float(conf), 0)]
            yield pdf[key].assign(segments=out)

    return docs.select(*key, sentences(F.col(text)).alias("_text")).mapInPandas(run, schema)


def label_segments(docs: DataFrame, key: list[str], text: str, model: LanguageModel, least_words: int = 5) -> DataFrame:
    """(key columns, segments): segments is an array of struct<lang, confidence, first, last>, one entry for
    each run of sentences of one language, in order; first and last number the sentences from 0.

    Every document has at least one entry, and every sentence with letters is in one. lang and
    confidence are null where a sentence's lead is under the model's floor. The confidence of sentences
    under least_words words is lowered in proportion; a run has the mean of its sentences by words.
    Lines without letters don't part a run. Where no sentence passes, the document is judged as a whole.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), "segments array<struct<lang:string,confidence:double,first:int,last:int>>"])

    def weight(words: int) -> float:
        return min(1.0, words / least_words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shipped.value
        for pdf in batches:
            split = [(t or "").split("\n") for t in pdf["_text"]]
            lines = [s for x in split for s in x]
            best, sure, lead = m.predict(lines)
            out, at, doubtful = [], 0, []
            for d, x in enumerate(split):
                runs: list[list] = []  # language, sum of confidence by words, words, first, last
                for k in range(at, at + len(x)):
                    if not any(map(str.isalpha, lines[k])):
                        continue
                    words = len(lines[k].split())
                    lang = m.classes[best[k]] if lead[k] >= m.floor else None
                    if not runs or runs[-1][0] != lang:
                        runs.append([lang, 0.0, 0, k - at, k - at])
                    runs[-1][1] += float(sure[k]) * weight(words) * words
                    runs[-1][2] += words
                    runs[-1][4] = k - at
                at += len(x)
                out.append([(lang, total / words if lang else None, first, last) for lang, total, words, first, last in runs] or [(None, None, 0, len(x) - 1)])
                if runs and all(r[0] is None for r in runs):
                    doubtful.append(d)
            wholes = [" ".join(split[d]) for d in doubtful]
            for d, t, c, conf, gap in zip(doubtful, wholes, *m.predict(wholes)):
                if gap >= m.floor:
                    out[d] = [(m.classes[c], float(conf) * weight(len(t.split())), 0, len(split[d]) - 1)]
            yield pdf[key].assign(segments=out)

    return docs.select(*key, sentences(F.col(text)).alias("_text")).mapInPandas(run, schema)
