"""Texts that were cut off before their end (problem 8).

One pass over the texts takes from each its end and its words: what is left when complete endings (tags,
links, emoji, signatures, brackets) and the remnant of a cut (a mark of omission, a broken character or
entity) are taken off, and whether that closes a sentence. From the words of all texts the corpus
vocabulary trie is made, one row a node, with the number of documents of each word, of the longer words
below it, and of those in which the word closes a sentence or line. A text that doesn't close is judged by
the node of its final token:

* `prefix`: the token is no known word but a proper prefix of known words (or so rare beside the words below
  it that it is a fragment of them): cut inside a word;
* `inner`: the token is a known word, but one that hardly ever closes a sentence: cut between words.

Where the node tells neither, length evidence does: `limit`, the text has the length at which its source's
texts pile up, or `long`, other texts and first lines of this length, of one sentence or of several like it,
hardly ever stay open in the corpus (headlines are short and single). A remnant at the cut decides where none
of these does. Other open texts are whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.session import broadcast_if_small, cut, spread

KNOWN_DOCS = 2  #: a word is known when it stands in so many documents, not as the final token of an open text
FRAGMENT = 50  #: a word is a fragment when the words below its node are in so many times as many documents
INNER_SHARE = 0.03  #: a word hardly ever closes a sentence when it does so in a lower share of its documents
OPEN_SHARE = 0.2  #: a length tells when a lower share of the other texts of its class that the trie doesn't judge is open
LIMIT_DOCS, LIMIT_SHARE = 5, 0.02  #: a source has a length limit when so many texts have just one length
SPIKE, SPIKE_REACH = 4, 10  #: and so many times as many as any length so near
WORDS_HELD = 200_000  #: words a task counts before it passes the counts on

_EMOJI = re.compile("[\U0001f000-\U0001faff☀-➿⬀-⯿️‍\U000e0020-\U000e007f]")
_TAG = re.compile(r"[#@]\w+$")
_SIGNATURE = re.compile(r"\s*[—–-]{1,2} ?[^\n.!?#@]{1,60}")
_BRACKETS = re.compile(r"\([^()\n]{1,40}\)$")
_CLOSERS = "[\"”“»«’')\\]]*"
_OMISSION = re.compile(rf"[\s\[(]*(?:…|\.\.\.+)[\s\])]*{_CLOSERS}$")
_BROKEN = re.compile(r"\s*(?:�|&#?[A-Za-z0-9]{0,8};?|<[^<>]{0,20}|\\u?[0-9a-fA-F]{0,4}|%[0-9A-Fa-f]?)$")
_SENTENCE_END = re.compile(rf"[.!?。！？؟]{_CLOSERS}$")
_NO_WORDS = re.compile(r"https?://\S+|[#@]\w+")
_WORD = re.compile(r"[^\W\d_]+")
_CLOSING_WORD = re.compile(r"[^\W\d_]+(?=[\"”“»«’')\]]*[.!?…。！？؟\n])")
_BREAK = re.compile(r"[.!?。！？؟\n]")
_AFTER_MARK = "\"”“»«’')].!?。！？؟ \n"
_MARKS = 48  #: characters that a mark at the end takes at most, closers and spaces aside


def core(text: str) -> str:
    """The text without the complete endings that may follow its last sentence. Works from the end."""
    while True:
        n = end = len(text)
        while end and (text[end - 1].isspace() or _EMOJI.match(text, end - 1)):
            end -= 1
        text = text[:end]
        at = max(text.rfind(" "), text.rfind("\n"), text.rfind("\t")) + 1
        if text.startswith(("http://", "https://"), at):
            text = text[:at]
        elif tag := _TAG.search(text, at):
            text = text[: tag.start()]
        elif text.endswith(")") and (m := _BRACKETS.search(text, max(0, len(text) - 42))) and (m.start() == 0 or text[m.start() - 1].isspace() or text[m.start() - 1] in '.!?…"”»’)'):
            text = text[: m.start()]
        elif (k := text.rfind("\n", max(0, len(text) - 72))) >= 0 and _SIGNATURE.fullmatch(text, k + 1):
            text = text[:k]
        elif len(text) == n:
            return text


def ending(text: str) -> tuple[str, bool, bool]:
    """(what stands before the cut or end, whether a remnant of a cut followed, whether it closes a sentence)."""
    body = core(text)
    tail = max(0, len(body.rstrip()) - _MARKS)
    mark = _OMISSION.search(body, tail)
    if mark and not _SENTENCE_END.search(body[: mark.start()], max(0, mark.start() - _MARKS)):
        return body[: mark.start()], True, False
    if broken := _BROKEN.search(body, tail):
        return body[: broken.start()], True, False
    return body, False, not body or bool(_SENTENCE_END.search(body, tail))


def read_ends(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """Rows of kind doc, one for each document: (key, source, n, many, open, remnant, token); of kind word:
    (word, docs, closing); and of kind line, first lines that others follow: (n, many, open, docs).

    many says that a sentence or line ends before the last one. token is the last run of letters of an open
    text, lower-case, empty where it ends otherwise. The counts of a word leave out tokens; those of several
    rows of the same word or line are to be added up."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = f"kind string, _key {kinds[key]}, _source {kinds[source]}, n long, many boolean, open boolean, remnant boolean, token string, word string, docs long, closing long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        closing: Counter[str] = Counter()
        lines: Counter[tuple[int, bool]] = Counter()
        types: list[pa.DataType] = []

        def table(kind: str, rows: int, **columns: pa.Array | list) -> pa.RecordBatch:
            names = ["_key", "_source", "n", "many", "open", "remnant", "token", "word", "docs", "closing"]
            plain = [pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            arrays = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(rows, t) for c, t in zip(names, [*types, *plain])]
            return pa.RecordBatch.from_arrays([pa.array([kind] * rows, pa.string()), *arrays], ["kind", *names])

        def counted() -> Iterator[pa.RecordBatch]:
            words, kinds = list(seen), list(lines)
            yield table("word", len(words), word=words, docs=[seen[w] for w in words], closing=[closing[w] for w in words])
            yield table("line", len(kinds), n=[n for n, _ in kinds], many=[False] * len(kinds), open=[o for _, o in kinds], docs=list(lines.values()))
            seen.clear(), closing.clear(), lines.clear()

        for batch in batches:
            types = [batch.schema.field(i).type for i in (0, 1)]
            size, several, opened, left, tokens = [], [], [], [], []
            for t in batch.column(2).to_pylist():
                size.append(None if t is None else len(t))
                body, remnant, closed = ending(t or "")
                token, words = "", t or ""
                if not closed:
                    at = len(body)
                    while at and body[at - 1].isalpha():
                        at -= 1
                    token, words = body[at:].lower(), body[:at]
                several.append(bool(_BREAK.search(body.rstrip(_AFTER_MARK)))), opened.append(not closed), left.append(remnant), tokens.append(token)
                if (end := body.find("\n")) > 0 and not _BREAK.search((line := body[:end].strip()).rstrip(_AFTER_MARK)):
                    lines[len(line), not _SENTENCE_END.search(line)] += 1
                if "#" in words or "@" in words or "http" in words:
                    words = _NO_WORDS.sub(" ", words)
                words = words.lower()
                seen.update(set(_WORD.findall(words)))
                closing.update(set(_CLOSING_WORD.findall(words if not closed else words + "\n")))
            yield table("doc", len(size), _key=batch.column(0), _source=batch.column(1), n=size, many=several, open=opened, remnant=left, token=tokens)
            if len(seen) + len(lines) > WORDS_HELD:
                yield from counted()
        if seen or lines:
            yield from counted()

    return spread(docs.select(F.col(key).alias("_key"), F.col(source).alias("_source"), F.col(text).cast("string").alias("_text"))).mapInArrow(run, schema)


def node(word: Column, length: Column) -> Column:
    """The trie node of the first letters of a word: their number and a hash of them, so that long words need
    no more space than their letters."""
    return F.struct(length.cast("int").alias("n"), F.xxhash64(F.substring(word, F.lit(1), length)).alias("h"))


def vocabulary_trie(counts: DataFrame, known_docs: int = KNOWN_DOCS) -> DataFrame:
    """(node, docs, closing, below): the trie of all words of at least known_docs documents. docs and closing
    are those of the word that ends at the node, 0 where none does; below adds up the documents of longer ones."""
    words = counts.groupBy("word").agg(F.sum("docs").alias("docs"), F.sum("closing").alias("closing")).where(F.col("docs") >= known_docs)
    at = F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i")
    nodes = words.select("word", "docs", "closing", at).withColumn("ends", F.col("i") == F.length("word"))
    here = [F.sum(F.when(F.col("ends"), F.col(c)).otherwise(0)).alias(c) for c in ("docs", "closing")]
    return nodes.groupBy(node(F.col("word"), F.col("i")).alias("node")).agg(*here, F.sum(F.when(F.col("ends"), 0).otherwise(F.col("docs"))).alias("below"))


def _limits(sizes: DataFrame) -> DataFrame:
    """(_source, limit) of (_source, n)."""
    sizes = sizes.groupBy("_source", "n").count().where("n is not null")
    around = sizes.select("_source", "count", F.explode(F.expr(f"filter(sequence(n - {SPIKE_REACH}, n + {SPIKE_REACH}), m -> m not in (n, n + 1))")).alias("n"))
    around = around.groupBy("_source", "n").agg(F.max("count").alias("near"))
    all_of = sizes.groupBy("_source").agg(F.sum("count").alias("all"))
    spikes = sizes.join(around, ["_source", "n"], "left").join(all_of, "_source")
    spikes = spikes.where((F.col("count") >= LIMIT_DOCS) & (F.col("count") >= LIMIT_SHARE * F.col("all")) & (F.col("count") >= SPIKE * F.coalesce("near", F.lit(0))))
    return spikes.groupBy("_source").agg(F.max(F.struct("count", "n")).alias("top")).select("_source", F.col("top.n").alias("limit"))


def length_limits(docs: DataFrame, text: str, source: str) -> DataFrame:
    """(_source, limit): the length of a source at which its texts pile up, whether longer ones follow or not.

    A length is a limit when many texts have just that length, SPIKE times as many as the most frequent of
    the SPIKE_REACH lengths on either side but the next shorter (some are cut a character early). Of several,
    the most frequent counts, then the longest.
    """
    return _limits(docs.select(F.col(source).alias("_source"), F.length(text).cast("long").alias("n")))


def find_truncated(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(key, source, truncated, final_token, evidence, unknown_prefix, at_limit, headline), one row for each row of docs.

    evidence is what decided: prefix, inner, limit, long or remnant; null for whole texts. headline says that
    an open text is of a length at which whole texts stay open too. Null and empty texts aren't truncated; a
    null source has no limit. Repeated rows give repeated rows, other columns are left out.
    """
    read = cut(read_ends(docs, key, text, source))
    told = read.where("kind = 'doc'").select("_key", "_source", "n", "many", "open", "remnant", "token")
    trie = vocabulary_trie(read.where("kind = 'word'").select("word", "docs", "closing"))

    asked = told.where("open and token <> ''").groupBy("token").agg(node(F.col("token"), F.length("token")).alias("node"))
    few = (F.col("docs") == 0) | (F.col("docs") * FRAGMENT < F.col("below"))
    inner = (F.col("closing") + 1) < INNER_SHARE * (F.col("docs") + 2)
    judged = asked.join(trie, "node").select("token", F.when(few & (F.col("below") > 0), "prefix").when(inner & ~few, "inner").alias("by_trie")).where("by_trie is not null")
    told = told.join(broadcast_if_small(cut(judged)), "token", "left")
    size_class = F.floor(2 * F.log2(F.col("n") + 1)).cast("int").alias("class")
    told = told.withColumn("class", size_class)
    witness = told.where("by_trie is null and not remnant and n > 0").select("class", "many", "open", F.lit(1).cast("long").alias("docs"))
    witness = witness.unionByName(read.where("kind = 'line'").select(size_class, "many", "open", "docs"))
    classes = witness.groupBy("class", "many").agg(F.sum(F.when(F.col("open"), F.col("docs")).otherwise(0)).alias("_open"), F.sum("docs").alias("_all"))
    told = told.join(broadcast_if_small(classes), ["class", "many"], "left").join(broadcast_if_small(_limits(told.select("_source", "n"))), "_source", "left")
    at_limit = F.coalesce(F.col("n").between(F.col("limit") - 1, F.col("limit")), F.lit(False))
    # Of its class a text itself is no witness.
    short = F.coalesce((F.col("_open") - 1 >= OPEN_SHARE * (F.col("_all") - 1)) & (F.col("_all") > 1), F.lit(False))
    evidence = F.when(F.col("open"), F.coalesce("by_trie", F.when(at_limit, "limit").when(F.col("remnant"), "remnant").when(~short, "long")))
    return told.select(
        F.col("_key").alias(key), F.col("_source").alias(source), evidence.isNotNull().alias("truncated"), F.col("token").alias("final_token"), evidence.alias("evidence"),
        F.coalesce(F.col("by_trie") == "prefix", F.lit(False)).alias("unknown_prefix"), at_limit.alias("at_limit"), (F.col("open") & short).alias("headline"),
    )
