"""SentencePiece encoding and decoding over a relational lattice.

Words become lattices by joins: their substrings of bounded length are exploded and equi-joined to the piece table, the
edges found are grouped by word and folded with Spark's ``aggregate``. The fold follows the kind of the vocabulary: for
a unigram vocabulary it is the Viterbi path of the highest total score, for a BPE vocabulary the merge order (always the
best-scored merge of two neighbours, the leftmost of equal ones), which is what such a vocabulary is defined by.

A vocabulary in which no piece has a space mark after another character is never merged across the start of a word, so
words are encoded once and put together. Words that a first look finds often are looked up in a broadcast of bounded
size; of all others the distinct ones are encoded, and their ids are joined to the documents that hold them. No group
grows with the number of documents that share a word or a text. The split changes no result.
"""
import heapq
import re
import zlib
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators.scale import attach
from ..session import materialise, stored_rows
from .text_model import hash_share

MARK = "▁"
UNITS = f"{MARK}*[^{MARK}\\n]+|{MARK}+|\\n"
UNIT = re.compile(UNITS)
# Longest word that is folded as a lattice: its boundaries are the bits of one long. Longer ones are merged in Python.
LONGEST = 60
# Words in the broadcast, at most, and documents of the first look that chooses them.
COMMON, FIRST_LOOK = 150_000, 20_000
# Keys over which copies of a text are dealt.
COPIES = 64
# Rows of an Arrow batch: each row carries a whole text, its words and its ids.
BATCH_ROWS = 1_000
# Words whose lattices one task puts together; a word becomes some thirty rows there.
TASK_WORDS = 20_000
# First letters by which the length of substrings is bounded.
HEAD = 3
# An edge as one long: from the top the rank of its piece, where it starts and ends in the word, the id of its piece.
ID = (1 << 24) - 1
END, START, RANK = 24, 30, 36
PLACES = (1 << 6) - 1
# The mark of a fold that has ended.
DONE = -(1 << 63)
DUMMY = ("", 0, 0.0)


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with ids and scores, the ids of the 256 byte pieces (empty without byte fallback) and the unknown id."""
    pieces: list
    byte_ids: list
    unknown: int
    kind: str = "bpe"
    texts: list = field(default_factory=list)

    def __post_init__(self):
        if any(re.search(f"[^{MARK}]{MARK}|.\\n|\\n.", p, re.S) for p, _, _ in self.pieces):
            raise ValueError("pieces must not reach across the start of a word or a line")
        if any(not 0 <= i <= ID for _, i, _ in self.pieces):
            raise ValueError(f"piece ids must be between 0 and {ID}")

    @property
    def longest(self):
        return max((len(p) for p, _, _ in self.pieces), default=1)


def load_vocabulary(path, kind="bpe"):
    """The vocabulary of a model file, read on the driver. ``kind`` says whether it is a ``bpe`` or a ``unigram`` one."""
    from sentencepiece import SentencePieceProcessor
    model = SentencePieceProcessor(model_file=str(path))
    size = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(size)]
    special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(size)]
    byte_ids = [i for i in range(size) if model.is_byte(i)]
    texts = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else n.replace(MARK, " ").encode() if not model.is_unknown(i)
             else " ⁇ ".encode() for i, n in enumerate(names)]
    return Vocabulary([(n, i, model.get_score(i)) for i, n in enumerate(names) if not special[i]], byte_ids, model.unk_id(), kind, texts)


def units_of(text):
    """Words of a text with their space marks, and line feeds by themselves; none for a missing or empty text."""
    marked = F.concat(F.lit(MARK), F.replace(text, F.lit(" "), F.lit(MARK)))
    return F.when(F.length(text) > 0, F.regexp_extract_all(marked, F.lit(UNITS), 0)).otherwise(F.array().cast("array<string>"))


def let(value, body):
    """``body`` of ``value`` computed once; an expression written into a lambda is computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bit(i):
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), i)


def lattice(words, vocabulary, *carried):
    """One row per word with its ``edges``, best rank first, and the carried columns.

    An edge is one long: the rank of its piece among all, its start and end, its id (``START``, ``END``, ``ID`` say where).
    For a unigram vocabulary ``costs`` holds the costs in the order of the edges. ``words`` holds each word once and is
    best a stored table: its rows are numbered and spread by number, and exploding and the broadcast join keep them so,
    so edges are grouped by number where they are. The piece table is a vocabulary, not data; it is broadcast.
    """
    spark = words.sparkSession
    place = {r: i for i, r in enumerate(sorted({-float(s) for _, _, s in vocabulary.pieces}))}
    rows = [(p, (place[-float(s)] << RANK) + i, -float(s)) for p, i, s in vocabulary.pieces]
    pieces = F.broadcast(spark.createDataFrame(rows or [DUMMY], "piece string, code long, cost double"))
    # a start goes on only as far as some piece that begins with the same letters does
    reach = {}
    for p, _, _ in vocabulary.pieces:
        reach[p[:HEAD]] = max(len(p), reach.get(p[:HEAD], 0))
    heads = F.broadcast(spark.createDataFrame(list(reach.items()) or [("", 0)], "head string, reach int"))
    whole = F.struct("word", *carried)
    numbered = words.select(F.monotonically_increasing_id().alias("_w"), whole.alias("_whole")).repartition(tasks_for(stored_rows(words)), "_w")
    starts = (numbered.select("_w", F.col("_whole.word").alias("word"), "_whole", F.explode(F.sequence(F.lit(0), F.length("_whole.word") - 1)).alias("s"))
              .select("_w", F.when(F.col("s") == 0, F.col("_whole")).alias("_whole"), "s",
                      F.expr(f"substring(word, s + 1, {vocabulary.longest})").alias("rest"), F.expr(f"substring(word, s + 1, {HEAD})").alias("head"))
              .join(heads, "head", "left"))
    far = F.least(F.greatest(F.coalesce("reach", F.lit(0)), F.lit(HEAD - 1)), F.length("rest"))
    spans = (starts.select("_w", "_whole", "s", "rest", F.explode(F.sequence(F.lit(1), far)).alias("l"))
             .select("_w", F.when(F.col("l") == 1, F.col("_whole")).alias("_whole"), "s", "l", F.expr("substring(rest, 1, l)").alias("piece")))
    # single characters stay whether or not they are pieces: the first of them carries the word
    found = spans.join(pieces, "piece", "left").where(F.col("code").isNotNull() | F.col("_whole").isNotNull())
    start, end = F.col("s").cast("bigint"), (F.col("s") + F.col("l")).cast("bigint")
    edge = F.col("code") + start * (1 << START) + end * (1 << END)
    if vocabulary.kind == "bpe":
        edges = F.sort_array(F.collect_list(edge)).alias("edges")
    else:
        edges = F.array_sort(F.collect_list(F.when(edge.isNotNull(), F.struct(edge.alias("edge"), "cost")))).alias("edges")
    grouped = found.groupBy("_w").agg(edges, F.first("_whole", ignorenulls=True).alias("_whole"))
    columns = [F.col("_whole")[c].alias(c) for c in ("word", *carried)]
    if vocabulary.kind == "bpe":
        return grouped.select(*columns, "edges")
    return grouped.select(*columns, F.col("edges.edge").alias("edges"), F.col("edges.cost").alias("costs"))


def start_of(edge):
    return F.shiftright(edge, START).bitwiseAND(F.lit(PLACES)).cast("int")


def end_of(edge):
    return F.shiftright(edge, END).bitwiseAND(F.lit(PLACES)).cast("int")


def reaches(edges):
    """For every edge, as bits, the boundaries at its ends (``need``) and all from one to the other (``span``), and its
    start, end and id without the rank (``place``)."""
    def one(s, e, edge):
        return F.struct((bit(s) + bit(e)).alias("need"), (bit(e + 1) - bit(s)).alias("span"), edge.bitwiseAND(F.lit((1 << RANK) - 1)).alias("place"))

    return F.transform(edges, lambda edge: one(start_of(edge), end_of(edge), edge))


def merged(edges, n):
    """Boundaries that merging leaves, as bits: each step takes the best of ``reaches`` that joins exactly two neighbours."""
    def fold(longer):
        def step(mask, _):
            fits = F.filter(longer, lambda e: (mask.bitwiseAND(e["need"]) == e["need"]) & (F.bit_count(mask.bitwiseAND(e["span"])) == 3))
            # the two ends stay, what lies between goes
            joined = let(F.get(fits, F.lit(0)), lambda e: mask.bitwiseAND(F.bitwise_not(e["span"] - e["need"])))
            # the sign says that nothing fits any more; the remaining steps look at nothing
            return F.when(mask < 0, mask).otherwise(F.coalesce(joined, mask.bitwiseOR(F.lit(DONE))))

        steps = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
        return F.aggregate(steps, bit(n + 1) - 1, step).bitwiseAND(F.lit(~DONE))

    return let(F.filter(edges, lambda e: F.bit_count(e["span"]) > 2), fold)


def likeliest(edges, costs, n, unknown_cost):
    """Boundaries of the Viterbi path, as bits: edges by end and start relax the cost of their end.

    Where two paths cost the same the one whose last piece starts first is kept. A character without a piece costs
    ``unknown_cost``.
    """
    def edge(e, s, cost):
        return F.struct(e.alias("e"), s.alias("s"), cost.alias("cost"))

    single = F.transform(F.sequence(F.lit(0), n - 1), lambda i: edge(i + 1, i, F.lit(float(unknown_cost))))
    known = F.zip_with(edges, costs, lambda x, c: edge(end_of(x), start_of(x), c))
    covered = F.transform(F.filter(edges, lambda x: end_of(x) - start_of(x) == 1), start_of)
    steps = F.concat(known, F.filter(single, lambda x: ~F.array_contains(covered, x["s"])))
    state = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(
        F.when(i == 0, F.lit(0.0)).otherwise(F.lit(float("inf"))).alias("cost"), F.lit(0).cast("bigint").alias("cuts")))

    def relax(acc, x):
        before = F.get(acc, x["s"])
        cost = before["cost"] + x["cost"]
        better = F.struct(cost.alias("cost"), (before["cuts"] + bit(x["s"])).alias("cuts"))
        return F.transform(acc, lambda y, i: F.when((i == x["e"]) & (cost < y["cost"]), better).otherwise(y))

    return F.get(F.aggregate(F.array_sort(steps), state, relax), n)["cuts"] + bit(n)


def encode_words(words, vocabulary, *carried):
    """``word``, ``ids`` (4 bytes each, high byte first) and the carried columns of words of at most ``LONGEST`` characters."""
    edges, n = F.col("edges"), F.length("word")
    worst = max((-s for _, _, s in vocabulary.pieces), default=0.0)
    byte_ids = F.array(*[F.lit(f"{i:08x}") for i in vocabulary.byte_ids]) if vocabulary.byte_ids else None

    def hex_of(edge):
        return F.lpad(F.hex(edge.bitwiseAND(F.lit(ID))), 8, "0")

    def fallback(at):
        if byte_ids is None:
            return F.lit(f"{vocabulary.unknown:08x}")
        code = F.hex(F.encode(F.substring(F.col("word"), at + 1, F.lit(1)), "utf-8"))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(code), F.lit(2)),
                                        lambda i: F.get(byte_ids, F.conv(F.substring(code, i, F.lit(2)), 16, 10).cast("int"))), "")

    def named(reached, mask):
        # pieces of the path: both ends are boundaries and none lies between; put in the order of their starts
        fits = F.filter(reached, lambda e: mask.bitwiseAND(e["span"]) == e["need"])
        path = F.sort_array(F.transform(fits, lambda e: e["place"]))

        def filled(path):
            cuts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: mask.bitwiseAND(bit(i)) != 0)
            return F.transform(cuts, lambda at: F.coalesce(hex_of(F.get(F.filter(path, lambda e: start_of(e) == at), F.lit(0))), fallback(at)))

        whole = lambda path: F.size(path) == F.bit_count(mask) - 1
        return let(path, lambda path: F.array_join(F.when(whole(path), F.transform(path, hex_of)).otherwise(filled(path)), ""))

    def path_of(reached):
        mask = merged(reached, n) if vocabulary.kind == "bpe" else likeliest(edges, F.col("costs"), n, worst + 10)
        return let(mask, lambda mask: named(reached, mask))

    return lattice(words, vocabulary, *carried).select("word", F.unhex(let(reaches(edges), path_of)).alias("ids"), *carried)


class LongWords:
    """The same encoding for a word of any length, on one machine and in memory linear in the word."""

    def __init__(self, vocabulary):
        self.scores = {p: s for p, _, s in vocabulary.pieces}
        self.ids = {p: i for p, i, _ in vocabulary.pieces}
        self.byte_ids, self.unknown, self.kind, self.longest = vocabulary.byte_ids, vocabulary.unknown, vocabulary.kind, vocabulary.longest

    def cut(self, word):
        if self.kind != "bpe":
            worst = max((-s for s in self.scores.values()), default=0.0) + 10
            cost, back = [0.0] + [float("inf")] * len(word), [0] * (len(word) + 1)
            for e in range(1, len(word) + 1):
                for s in range(max(0, e - self.longest), e):
                    piece = word[s:e]
                    c = cost[s] - self.scores[piece] if piece in self.scores else cost[s] + worst if e - s == 1 else float("inf")
                    if c < cost[e]:
                        cost[e], back[e] = c, s
            ends, e = [], len(word)
            while e:
                ends.append((back[e], e))
                e = back[e]
            return [word[s:e] for s, e in reversed(ends)]
        n = len(word)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []

        def offer(s):
            e = end[s]
            if e < n and end[e] - s <= self.longest and (score := self.scores.get(word[s:end[e]])) is not None:
                heapq.heappush(queue, (-score, s, e, end[e]))

        for s in range(n - 1):
            offer(s)
        while queue:
            _, s, middle, e = heapq.heappop(queue)
            if end[s] != middle or end[middle] != e:
                continue
            end[s], end[middle] = e, 0
            if e < n:
                before[e] = s
            offer(s)
            if before[s] >= 0:
                offer(before[s])
        out, s = [], 0
        while s < n:
            out.append(word[s:end[s]])
            s = end[s]
        return out

    def encode(self, word):
        ids = []
        for piece in self.cut(word):
            known = self.ids.get(piece)
            ids += [known] if known is not None else [self.byte_ids[b] for b in piece.encode()] if self.byte_ids else [self.unknown]
        return np.array(ids, dtype=">i4").tobytes()


@contextmanager
def shuffles_deleted(spark):
    """Inside the block Spark deletes the shuffle files of a query when it ends; what it wrote stays."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


def stored(df):
    """``df`` stored; nothing else of its query stays on disk."""
    with shuffles_deleted(df.sparkSession):
        return materialise(df)


def tasks_for(words):
    """How many partitions hold ``words`` lattices. Given as a number, so Spark does not merge them by the size of the words."""
    return int(min(max(1, -(-words // TASK_WORDS)), 100_000))


def common_words(docs, vocabulary, id_col, text):
    """At most ``COMMON`` words that a bounded sample of the documents holds most often, encoded."""
    rows = docs.count()
    share = min(1.0, FIRST_LOOK / max(rows, 1))
    seen = (docs.where(hash_share(F.col(id_col), F.col(text)) < F.lit(share)).select(F.explode(units_of(F.col(text))).alias("word"))
            .where(F.length("word") <= LONGEST).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    seen = stored(seen)
    least, total = None, 0
    for row in seen.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).toLocalIterator():
        if total + row["words"] > COMMON:
            break
        total += row["words"]
        least = row["n"]
    chosen = seen.where(F.col("n") >= F.lit(least)) if least is not None else seen.limit(0)
    return stored(encode_words(chosen.select("word"), vocabulary))


def id_width(vocabulary):
    """Bytes that hold any id of the vocabulary on the way to the documents."""
    return 2 if max([vocabulary.unknown, *vocabulary.byte_ids, *(i for _, i, _ in vocabulary.pieces)]) < 1 << 16 else 4


def rare_words(keys, common, vocabulary, text):
    """For every key the words that are not common, with their ids, as one array without repeats: the number of ids in a
    byte, the ids in ``id_width`` bytes each, the word in UTF-8 with spaces for its marks.

    Rows that share a key give each word once, from the reading task on. Words are counted and the distinct ones encoded,
    so a lattice carries no keys; ``attach`` joins them back without gathering the keys of a frequent word.
    """
    width = id_width(vocabulary)
    pairs = stored(keys.select("_key", F.explode(F.array_distinct(units_of(F.col(text)))).alias("word")).where(F.length("word") <= LONGEST)
                   .join(F.broadcast(common.select("word")), "word", "left_anti").select("_key", "word"))
    counted = stored(pairs.groupBy("word").agg(F.count(F.lit(1)).alias("_n")))
    words = encode_words(counted, vocabulary, "_n")
    if width == 2:
        words = words.withColumn("ids", F.unhex(F.regexp_replace(F.hex("ids"), "....(....)", "$1")))
    words = stored(words)
    count = F.unhex(F.lpad(F.hex((F.octet_length("ids") / width).cast("int")), 2, "0"))
    pair = F.concat(count, F.col("ids"), F.encode(F.replace(F.col("word"), F.lit(MARK), F.lit(" ")), "utf-8"))
    return (attach(pairs, words, ["word"], "_n", stored=True).select("_key", pair.alias("_pair"))
            .groupBy("_key").agg(F.collect_set("_pair").alias("_pairs")))


def small_batches(spark):
    """Lowers the session's rows per Arrow batch to ``BATCH_ROWS``, where it has more or no limit."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, BATCH_ROWS)


def _packed(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else zlib.compress(t.encode(), 1) for t in texts], dtype=object)


def encode(docs, vocabulary, id_col="doc_id", text="text"):
    """``docs`` with ``ids`` (array of int) of the whole ``text`` and ``n_tokens``; columns of these names are replaced.

    A missing or empty text has no ids. All rows and other columns stay; repeated rows each get their ids. An empty table
    gives an empty table. The session's Arrow batches become small.
    """
    small_batches(docs.sparkSession)
    columns = [c for c in docs.columns if c not in ("ids", "n_tokens")]
    common = common_words(docs, vocabulary, id_col, text)
    known = docs.sparkSession.sparkContext.broadcast({r["word"]: bytes(r["ids"]) for r in common.toLocalIterator()})
    others, width = LongWords(vocabulary), id_width(vocabulary)
    # other columns travel as one, by position, so any name may occur
    rest = F.struct(F.lit(0).alias("none"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns) if c != text])
    # documents with the same key share their rare words, which changes no encoding; copies are dealt over some keys
    keys = docs.select(rest.alias("_rest"), F.col(text).alias("_text"),
                       F.xxhash64(text, F.pmod(F.xxhash64(id_col), F.lit(COPIES))).alias("_key"))
    sent = rare_words(keys, common, vocabulary, "_text")

    def code_of(word, table, own):
        found = table.get(word) or own.get(word)
        if found is None:
            if len(word) <= LONGEST:
                raise RuntimeError(f"the lattice path lost the word {word!r}")
            found = others.encode(word)
        return found

    def whole(texts: pd.Series, pairs: pd.Series) -> pd.DataFrame:
        table, plain, out = known.value, [], []
        for packed, sent_words in zip(texts, pairs, strict=True):
            t = zlib.decompress(packed).decode() if packed is not None else None
            own = {p[1 + width * p[0]:].decode().replace(" ", MARK): np.frombuffer(p, f">u{width}", p[0], 1).astype(">i4").tobytes()
                   for p in sent_words} if sent_words is not None else {}
            units = UNIT.findall(MARK + t.replace(" ", MARK)) if t else []
            code = b"".join([code_of(u, table, own) for u in units])
            plain.append(t)
            out.append(np.frombuffer(code, dtype=">i4").astype(np.int32))
        return pd.DataFrame({"text": pd.Series(plain, dtype=object), "ids": pd.Series(out, dtype=object)})

    # the text is shuffled once, to meet its rare words, and packed for that
    joined = keys.withColumn("_packed", F.pandas_udf(_packed, "binary")(F.col("_text"))).drop("_text").join(sent, "_key", "left")
    both = F.pandas_udf(whole, "text string, ids array<int>")(F.col("_packed"), F.col("_pairs"))
    joined = joined.withColumn("_whole", both)
    own = [F.col("_whole.text").alias(c) if c == text else F.col("_rest")[f"c{i}"].alias(c) for i, c in enumerate(columns)]
    return joined.select(*own, F.col("_whole.ids").alias("ids"), F.size("_whole.ids").cast("bigint").alias("n_tokens"))


def decode(docs, vocabulary, ids="ids", text="text"):
    """``docs`` with ``text`` made from ``ids``: the pieces' bytes, without the space mark that encoding puts first.

    Missing ids give a missing text; bytes that are no UTF-8 become the replacement character. A column named ``text``
    is replaced.
    """
    small_batches(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(vocabulary.texts)

    def whole(rows: pd.Series) -> pd.Series:
        texts = table.value
        return pd.Series([None if r is None else b"".join([texts[i] for i in r]).decode("utf-8", "replace").removeprefix(" ") for r in rows], dtype=object)

    return docs.withColumn(text, F.pandas_udf(whole, "string")(F.col(ids)))
