"""SentencePiece encoding and decoding by a relational lattice.

Texts are cut where no piece of the vocabulary can reach across, which gives words.  The
distinct words of the corpus are a relation: their substrings up to the longest piece are exploded and
joined to the piece table on equality; the edges so found are grouped by word, and a higher-order
aggregate folds them into the path with the largest sum of piece scores (Viterbi).
The paths of the most frequent words, a fixed number of them, go to every task; documents are dealt
into groups of bounded size, and each group asks for the paths of its other words only.

The text is encoded as SentencePiece does for a unigram vocabulary: spaces become U+2581, one is put in
front, characters without a piece become bytes.  The vocabulary file is a parameter.  Scores of a
BPE vocabulary are merge ranks; the path maximises their sum, which need not be the merge order.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from shelfledger.llm.common import columns, written

SPACE = "▁"
#: Bytes of text in one group of documents.
GROUP_BYTES = 6_000_000
#: Words whose paths every task holds: the most frequent ones of at most FREQUENT_CHARS characters.
FREQUENT_WORDS = 100_000
FREQUENT_CHARS = 32
#: A longer word is folded by the same recurrence in the task that holds its document.
LONG_WORD = 256
#: How far an unknown character scores below the lowest piece.
UNKNOWN_BELOW = 10.0


@dataclass
class Vocabulary:
    """Pieces with id and score, the ids of the 256 bytes, and the cuts between words."""

    pieces: dict[str, tuple[int, float]]
    bytes: list[int]
    shown: list[bytes]
    unknown_id: int
    dummy_prefix: bool = True
    longest: int = field(init=False)
    unknown_score: float = field(init=False)
    pattern: str = field(init=False)

    def __post_init__(self):
        many = [p for p in self.pieces if len(p) > 1]
        self.longest = max(map(len, self.pieces), default=1)
        self.unknown_score = min((s for _, s in self.pieces.values()), default=0.0) - UNKNOWN_BELOW
        pairs = {(a, b) for p in many for a, b in zip(p, p[1:], strict=False)}
        inside = {b for a, b in pairs if a != SPACE and b == SPACE}

        def letter(c: str) -> bool:
            return unicodedata.category(c)[0] == "L"

        # Characters that some piece holds after a letter cannot begin a word there.
        tied = {b for a, b in pairs if letter(a) and not letter(b)} - {SPACE}
        # Numbers that count as word characters for the pattern, but may be followed by others in a piece.
        odd = {c for pair in pairs for c in pair if not letter(c) and re.match(r"[^\W\d_]", c)} - tied
        tied, odd = ("".join(map(re.escape, sorted(some))) for some in (tied, odd))
        line_end = "" if any("\n" in p for p in many) else "\n"
        rest = rf"(?:(?![{SPACE}{line_end}{tied}])[\W\d_{odd}])"
        word = rf"(?:[^\W\d_{odd}]+|[{tied}]+)" if tied else rf"(?:[^\W\d_{odd}]+)"
        if inside:  # pieces reach over spaces: only line ends cut
            self.pattern = r"\n|[^\n]+" if line_end else r"(?s:.+)"
        else:
            many_words = f"{word}*" if tied else f"{word}?"
            self.pattern = rf"{SPACE}+{rest}*{many_words}|{rest}+{many_words}|{word}+"
            self.pattern += r"|\n" if line_end else ""


def load(path: str) -> Vocabulary:
    """Vocabulary of a SentencePiece model file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, in_bytes, shown = {}, [-1] * 256, []
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        if model.is_byte(k):
            in_bytes[int(piece[3:5], 16)] = k
            shown.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
            shown.append(b"")
        else:
            pieces[piece] = (k, model.get_score(k))
            shown.append(piece.replace(SPACE, " ").encode())
    return Vocabulary(pieces, in_bytes, shown, model.unk_id())


class Cutter:
    """Words of a text under a vocabulary; the compiled pattern stays with the task."""

    def __init__(self, vocabulary: Vocabulary):
        self.pattern, self.prefix = vocabulary.pattern, SPACE if vocabulary.dummy_prefix else ""
        self.find = None

    def __getstate__(self):
        return self.__dict__ | {"find": None}

    def __call__(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.find is None:
            self.find = re.compile(self.pattern).findall
        return self.find(self.prefix + text.replace(" ", SPACE))


def viterbi(word: str, vocabulary: Vocabulary) -> list[int]:
    """Ids of the best path of one word, for words too long for the relation."""
    best, came = [0.0] + [float("-inf")] * len(word), [(0, -1)] * (len(word) + 1)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - vocabulary.longest), end):
            known = vocabulary.pieces.get(word[start:end])
            if known is None and start < end - 1:
                continue
            key, score = known or (-1, vocabulary.unknown_score)
            if best[start] + score > best[end]:
                best[end], came[end] = best[start] + score, (start, key)
    ids: list[int] = []
    end = len(word)
    while end:
        start, key = came[end]
        ids += [key] if key >= 0 else byte_ids(word[start:end], vocabulary)[::-1]
        end = start
    return ids[::-1]


def byte_ids(text: str, vocabulary: Vocabulary) -> list[int]:
    return [k if k >= 0 else vocabulary.unknown_id for k in (vocabulary.bytes[b] for b in text.encode())]


# --- lattice --------------------------------------------------------------------------------


def piece_table(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    """(piece, id, score); its size is that of the vocabulary."""
    rows = [(p, k, float(s)) for p, (k, s) in vocabulary.pieces.items()]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["piece", "id", "score"]), "piece string, id int, score double")


def lattice_edges(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(word, end, start, id, score): the pieces inside each word, and every lone character.

    A character without a piece has id null.
    """
    starts = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("s"))
    room = F.least(F.lit(longest), F.length("word") - F.col("s") + 1)
    parts = starts.select("word", "s", F.explode(F.sequence(F.lit(1), room)).alias("n"))
    parts = parts.select(
        "word",
        (F.col("s") + F.col("n") - 1).alias("end"),
        (F.col("s") - 1).alias("start"),
        F.substring("word", F.col("s"), F.col("n")).alias("piece"),
    )
    found = parts.join(F.broadcast(pieces), "piece", "left")
    return found.filter(F.col("id").isNotNull() | (F.col("end") - F.col("start") == 1))


def best_paths(words: DataFrame, pieces: DataFrame, longest: int, unknown_score: float) -> DataFrame:
    """(word, path): places (start, id) of the pieces with the largest sum of scores.

    Equal sums go to the longer last piece, as in the library.  Id -1 marks an unknown character.
    """
    edges = lattice_edges(words, pieces, longest).select(
        "word",
        F.struct(
            "end",
            "start",
            F.coalesce("id", F.lit(-1)).alias("id"),
            F.coalesce("score", F.lit(unknown_score)).alias("score"),
        ).alias("edge"),
    )
    grouped = edges.groupBy("word").agg(F.collect_list("edge").alias("edges"))
    # In order of their ends, so that one pass over the edges fills place after place.
    grouped = grouped.select("word", F.array_sort("edges").alias("edges"))

    def step(state: Column, e: Column) -> Column:
        """``done`` has for each finished place the largest sum and the edge that gives it; ``here`` is the next place."""
        done = F.when(e["end"] == F.size(state["done"]), state["done"]).otherwise(
            F.concat(state["done"], F.array(state["here"]))
        )
        total = F.get(done, e["start"])["sum"] + e["score"]
        reached = F.struct(total.alias("sum"), (-e["start"]).alias("back"), e["id"].alias("id"))
        here = F.when(e["end"] == F.size(state["done"]), F.greatest(state["here"], reached)).otherwise(reached)
        return F.struct(done.alias("done"), here.alias("here"))

    place = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("back"), F.lit(-1).alias("id"))
    none = F.array().cast("array<struct<sum:double,back:int,id:int>>")
    folded = F.aggregate("edges", F.struct(none.alias("done"), place.alias("here")), step)
    folded = grouped.select("word", folded.alias("f")).select(
        "word", F.concat("f.done", F.array("f.here")).alias("best")
    )

    def back(state: Column, k: Column) -> Column:
        here = F.get("best", k)
        hit = state["at"] == k
        edge = F.struct((-here["back"]).alias("start"), here["id"].alias("id"))
        return F.struct(
            F.when(hit, -here["back"]).otherwise(state["at"]).alias("at"),
            F.when(hit, F.concat(F.array(edge), state["path"])).otherwise(state["path"]).alias("path"),
        )

    end = F.size("best") - 1
    start = F.struct(end.alias("at"), F.array().cast("array<struct<start:int,id:int>>").alias("path"))
    path = F.aggregate(F.sequence(end, F.lit(1), F.lit(-1)), start, back)
    return folded.select("word", path["path"].alias("path"))


def piece_ids(path: Column, word: Column, vocabulary: Vocabulary) -> Column:
    """Ids along a path; an unknown character becomes the ids of its UTF-8 bytes."""
    known = [k if k >= 0 else vocabulary.unknown_id for k in vocabulary.bytes]
    table = F.array(*[F.lit(k) for k in known])

    def in_bytes(start: Column) -> Column:
        char = F.hex(F.encode(F.substring(word, start + 1, F.lit(1)), "UTF-8"))
        return F.transform(
            F.sequence(F.lit(0), F.shiftright(F.length(char), 1) - 1),
            lambda i: F.get(table, F.conv(F.substring(char, 2 * i + 1, F.lit(2)), 16, 10).cast("int")),
        )

    return F.flatten(
        F.transform(path, lambda e: F.when(e["id"] >= 0, F.array(e["id"])).otherwise(in_bytes(e["start"])))
    )


# --- operators ------------------------------------------------------------------------------


def _counted(cut: Cutter):
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            words = [w for w in seen if len(w) <= LONG_WORD]
            numbers = [seen[w] for w in words]
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array(numbers, pa.int64())], names=["word", "n"]
            )

        for batch in batches:
            for text in batch.column(0):
                seen.update(cut(text.as_py()))
            if len(seen) > 300_000:
                yield rows()
                seen.clear()
        yield rows()

    return counts


def _rare_words(cut: Cutter, frequent):
    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value[0]
        for batch in batches:
            asked: dict[int, set[str]] = {}
            for text, group in zip(batch.column("text"), batch.column("group").to_pylist(), strict=True):
                asked.setdefault(group, set()).update(w for w in cut(text.as_py()) if w not in known)
            rows = [(g, w) for g, ws in asked.items() for w in ws if len(w) <= LONG_WORD]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g for g, _ in rows], pa.int64()), pa.array([w for _, w in rows], pa.string())],
                names=["group", "word"],
            )

    return rare


def decoded(ids, vocabulary: Vocabulary) -> str:
    """Text of ids; invalid bytes become the replacement character."""
    shown = vocabulary.shown
    full = b"".join([shown[k] for k in ids]).decode("utf-8", "replace")
    return full[1:] if vocabulary.dummy_prefix and full.startswith(" ") else full


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and values of an array of lists."""
    return lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()


def _assemble(cut: Cutter, vocabulary: Vocabulary, frequent):
    def assemble(key: tuple, docs: pa.Table, paths: pa.Table) -> pa.Table:
        common, bounds, values = frequent.value
        rare_bounds, rare_values = _flat(pa.concat_arrays(
            [c.cast(pa.list_(pa.int32())) for c in paths.column("piece_ids").chunks]
            or [pa.array([], pa.list_(pa.int32()))]
        ))
        words = {w: len(common) + k for k, w in enumerate(paths.column("word").to_pylist())}
        first = np.concatenate([bounds[:-1], rare_bounds[:-1] + len(values)])
        sizes = np.concatenate([np.diff(bounds), np.diff(rare_bounds)])
        extra: list[list[int]] = []  # words beyond the relation
        ids_of_docs, counts, same = [], [], []
        values = np.concatenate([values, rare_values])

        def place(word: str) -> int:
            at = words.get(word)
            if at is None:
                at = words[word] = -len(extra) - 1
                extra.append(viterbi(word, vocabulary))
            return at

        for value in docs.column("text"):
            text = value.as_py()
            cuts = cut(text)
            places = [common.get(w, -1) for w in cuts]
            at = np.array(places, np.int64)
            long = False
            for k in np.flatnonzero(at < 0).tolist():
                at[k] = place(cuts[k])
                long = long or at[k] < 0
            if long:
                parts = [extra[-k - 1] if k < 0 else values[first[k] : first[k] + sizes[k]] for k in at.tolist()]
                ids = np.concatenate([np.asarray(part, np.int32) for part in parts])
            else:
                n = sizes[at]
                ends = np.cumsum(n)
                flat = np.repeat(first[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
                ids = values[flat]
            ids_of_docs.append(ids.astype(np.int32, copy=False))
            counts.append(len(ids))
            same.append(decoded(ids.tolist(), vocabulary) == (text or ""))
        flat_ids = np.concatenate(ids_of_docs) if ids_of_docs else np.empty(0, np.int32)
        bounds_of_docs = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(bounds_of_docs), pa.array(flat_ids, pa.int32()))
        return pa.table({"doc_id": docs.column("doc_id"), "ids": ids, "decodes": pa.array(same, pa.bool_())})

    return assemble


def encode(
    docs: DataFrame,
    vocabulary: Vocabulary,
    doc_id: str = "doc_id",
    text: str = "text",
    group_bytes: int = GROUP_BYTES,
    frequent_words: int = FREQUENT_WORDS,
) -> DataFrame:
    """(doc_id, ids, decodes) of every row; ``decodes`` says whether the ids give the text back.

    Null and empty texts have no ids.  Repeated rows are encoded each; a null id stays null.  A literal
    U+2581 is taken for a space, as the library does; only such texts do not decode.  An empty table gives no rows;
    other columns are left out.  Texts of any length are encoded whole.

    Every distinct word goes through the lattice once.  ``frequent_words`` bounds what is sent to
    each task; the paths of all other words travel to the groups of documents that hold them.
    """
    spark = docs.sparkSession
    texts = columns(docs, doc_id, text).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    cut = Cutter(vocabulary)
    words = texts.select("text").mapInArrow(_counted(cut), "word string, n bigint")
    words = written(words.groupBy("word").agg(F.sum("n").alias("n")))  # read twice: by the lattice and for its counts
    paths = best_paths(words.select("word"), piece_table(spark, vocabulary), vocabulary.longest, vocabulary.unknown_score)
    paths = paths.select("word", piece_ids(F.col("path"), F.col("word"), vocabulary).alias("piece_ids"))
    paths = written(paths.join(words, "word"))
    top = paths.where(F.length("word") <= FREQUENT_CHARS).orderBy(F.desc("n"), "word").limit(frequent_words)
    rows = top.select("word", F.col("piece_ids").cast("array<int>").alias("piece_ids")).toArrow()
    lists = pa.concat_arrays(
        [c.cast(pa.list_(pa.int32())) for c in rows.column(1).chunks] or [pa.array([], pa.list_(pa.int32()))]
    )
    numbered = {w: k for k, w in enumerate(rows.column(0).to_pylist())}
    frequent = spark.sparkContext.broadcast((numbered, *_flat(lists)))

    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = 1 + int(size // group_bytes)
    dealt = texts.withColumn("group", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups).cast("long")))
    dealt = dealt.repartition(F.col("group"))  # one shuffle of the texts serves questions and assembly
    # All columns, so that the plan has one exchange of the texts.
    asked = dealt.mapInArrow(_rare_words(cut, frequent), "group long, word string")
    met = asked.distinct().join(paths.select("word", "piece_ids"), "word")
    return (
        dealt.groupBy("group")
        .cogroup(met.groupBy("group"))
        .applyInArrow(
            _assemble(cut, vocabulary, frequent),
            dealt.select("doc_id").schema.add("ids", ArrayType(IntegerType())).add("decodes", "boolean"),
        )
    )


def decode(vocabulary: Vocabulary, ids: str) -> Column:
    """Text of an array of ids; null gives an empty text."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series(
                ["" if row is None else decoded(row, vocabulary) for row in rows], dtype=object
            )

    return text(F.col(ids))
