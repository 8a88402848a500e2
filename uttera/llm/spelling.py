"""Spelling variants: words one edit apart, found through a positional q-gram inverted index with a count filter.

* Counting: runs of letters are counted inside each task, a bounded table at a time; only these sums are shuffled.
* A word has len + 1 bigrams with its two ends marked. One edit leaves all but two of them (a replaced code point), or all but one
  of the shorter word's (an inserted one), in place or moved by one; so in any order of bigrams one of the first three of either
  word is shared. Words are posted under those three, rarest first, with position and length: a word of equal length meets
  it at the same position, a word one shorter at the same or the one before. Nothing else is compared.
* Inside a tile (bigram, length, position) an inverted file maps (bigram, position) to its words. A probe heap-merges its
  shortest postings, one more than the misses that one edit allows, looks the words that come out up in the longer ones by
  binary search, and keeps those within the allowed misses. They are verified.
* A tile of more than TILE words is split: one edit leaves the first or the second half of the shorter word whole, so words go to a part
  for each of their halves. A part that is still larger is probed in blocks, each with a copy of the part. No word is left out of its tile.

Bigrams are at most 92 * 92, their frequencies fit every task. Forms rise by a factor at each step, so their chains are short:
roots take the logarithm of the chain's length in joins.

Defined cases: null texts have no runs, a null id counts as empty in the hash. Repeated rows count repeatedly. An empty table gives an empty
result. Ties in n go to the smallest word in code-point order. Other columns are passed over.
"""

from __future__ import annotations

import heapq
import math
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttera.llm.common import small_batches, tidy, written

LEAST_LENGTH, LEAST_COUNT, FACTOR, HOLE = 6, 5, 5, 199
#: Words in a tile, and probes in a block of a part that can't be split further.
TILE = 2_000
#: Entries of a task's table of counts before it is passed on.
COUNTERS = 200_000
#: Latin-1 bytes of U+00C0 to U+00FF and of letters stay, A to Z are lowered, all others become blanks. "?" stands for what Latin-1 lacks.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str) -> list[bytes]:
    """Maximal runs of [A-Za-z and U+00C0-U+00FF], A to Z lowered, in Latin-1."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def with_hole(run: bytes, h: int, hole: int = HOLE) -> bytes:
    """run without the code point h % length if hole divides h."""
    if h % hole:
        return run
    h %= len(run)
    return run[:h] + run[h + 1 :]


def _counts(least: int, hole: int):
    def flushed(sums: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in sums], pa.string()), pa.array(list(sums.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for batch in batches:
            for id_, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                id_ = id_.as_py()
                before = zlib.crc32(f"{'' if id_ is None else id_}:".encode())
                for w, n in Counter(runs(text)).items():
                    if len(w) < least:  # a hole only shortens it
                        continue
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), before)
                    if h % hole == 0:
                        w = with_hole(w, h, hole)
                        if len(w) < least:
                            continue
                    sums[w] += n
                if len(sums) > COUNTERS:
                    yield flushed(sums)
                    sums = Counter()
        if sums:
            yield flushed(sums)

    return tidy("spelling", run)


def vocabulary(docs: DataFrame, id_: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, often: int = LEAST_COUNT, hole: int = HOLE) -> DataFrame:
    """word, n of the words of at least `least` code points that occur at least `often` times."""
    small_batches(docs.sparkSession)
    counted = docs.select(F.col(id_), F.col(text)).mapInArrow(_counts(least, hole), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def bigrams(word: str) -> list[str]:
    word = f" {word} "
    return [word[i : i + 2] for i in range(len(word) - 1)]


def one_edit(a: str, b: str) -> bool:
    """Whether one replaced (equal lengths) or inserted code point makes a into b, which is not shorter."""
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) > i else len(b) == len(a) + 1 and a[i:] == b[i + 1 :]


#: What a row of a tile does: it is indexed (and probes for words of its own length), or probes for words one longer.
INDEXED, SHORTER = 0, 1
_TILES = [("gram", pa.int32()), ("length", pa.int32()), ("place", pa.int32()), ("role", pa.int8()), ("word", pa.string()), ("n", pa.int64())]
_TILE_SQL = "gram int, length int, place int, role tinyint, word string, n long"


def _posted(rank: dict[str, int]):
    """From words to rows of tiles: three as indexed, six as the shorter word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                m = len(word)
                for g, p in sorted((rank[g], p) for p, g in enumerate(bigrams(word)))[:3]:
                    out += [(g, m, p, INDEXED, word, n), (g, m + 1, p, SHORTER, word, n), (g, m + 1, p + 1, SHORTER, word, n)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), _TILES, strict=True)], [c for c, _ in _TILES])

    return run


class Postings:
    """The inverted file of a tile's words, all of one length, in order."""

    def __init__(self, words: list[str]):
        self.words, self.files = words, {}
        for i, w in enumerate(words):
            for p, g in enumerate(bigrams(w)):
                self.files.setdefault((g, p), []).append(i)

    def candidates(self, word: str, shift: int, after: int = -1) -> Iterator[int]:
        """Words that hold all but 2 of the probe's bigrams in place (shift 0) or all but 1 in place or one later (shift 1).

        Only words numbered above `after` come out.
        """
        missing = 2 - shift
        lists = []
        for p, g in enumerate(bigrams(word)):
            own = [f for q in range(p, p + shift + 1) if (f := self.files.get((g, q)))]
            if own:
                lists.append(own)
            else:
                missing -= 1
                if missing < 0:
                    return
        lists.sort(key=lambda own: sum(map(len, own)))
        short, long = lists[: missing + 1], lists[missing + 1 :]
        merged = heapq.merge(*[f[bisect_left(f, after + 1) :] if after >= 0 else f for own in short for f in own])
        last = -1
        for i in merged:  # a word that no short list names misses too much
            if i == last:
                continue
            last, left = i, missing - sum(not any(_holds(f, i) for f in own) for own in short)
            for own in long:
                if left < 0:
                    break
                left -= not any(_holds(f, i) for f in own)
            if left >= 0:
                yield i


def _holds(file: list[int], i: int) -> bool:
    k = bisect_left(file, i)
    return k < len(file) and file[k] == i


def near_pairs(indexed: dict[str, int], same: list[str], shorter: dict[str, int]) -> Iterator[tuple[str, int, str, int]]:
    """Verified pairs (a, its n, b, its n) of one tile: of equal length with a in `same`, a before b, and of a `shorter` a."""
    words = sorted(indexed)
    index, at = Postings(words), {w: i for i, w in enumerate(words)}
    for w in same:
        for i in index.candidates(w, 0, at[w]):
            if one_edit(w, words[i]):
                yield w, indexed[w], words[i], indexed[words[i]]
    for w, n in shorter.items():
        for i in index.candidates(w, 1):
            if one_edit(w, words[i]):
                yield w, n, words[i], indexed[words[i]]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of rows that come sorted by tile and part, a block of probes at a time. Only one tile is held."""
    key, indexed, same, shorter, out = None, {}, [], {}, []

    def flushed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64()) * 2, strict=True)], ["a", "a_n", "b", "b_n"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("gram", "length", "place", "part", "block", "role", "word", "n", "probes")]
        for *tile, role, word, n, probes in zip(*columns, strict=True):
            if tile != key:
                if indexed:
                    out += near_pairs(indexed, same, shorter)
                key, indexed, same, shorter = tile, {}, [], {}
                if len(out) > 50_000:
                    yield flushed()
                    out = []
            if role == INDEXED:
                indexed[word] = n
                if probes:
                    same.append(word)
            else:
                shorter[word] = n
    if indexed:
        out += near_pairs(indexed, same, shorter)
    if out:
        yield flushed()


def _halves(word: Column, shorter: Column) -> Column:
    """Parts of a split tile: the kind of pair and the half of its shorter word that stays whole.

    A word of length m meets words of its length by its halves at m // 2, a longer one by those at the shorter length's.
    """
    m = F.char_length(word)

    def cut(kind: str, length: Column) -> list[Column]:
        h = F.floor(length / 2).cast("int")
        return [F.concat(F.lit(f"{kind}<"), F.substr(word, F.lit(1), h)), F.concat(F.lit(f"{kind}>"), F.substr(word, m - (length - h) + 1))]

    return F.when(shorter, F.array(*cut("+", m))).otherwise(F.array(*cut("=", m), *cut("+", m - 1)))


def _dealt(rows: DataFrame, keys: list[str], tile: int) -> tuple[DataFrame, DataFrame | None]:
    """rows of groups up to `tile` indexed words, and those of larger ones, if any, with their number of words."""
    sizes = rows.where(F.col("role") == INDEXED).groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > tile)
    sizes = written(sizes, "large_tiles")
    return (rows, None) if sizes.isEmpty() else (rows.join(sizes, keys, "left_anti"), rows.join(sizes, keys))


def one_edit_pairs(words: DataFrame, tile: int = TILE) -> DataFrame:
    """a, a_n, b, b_n: each pair of words that are one edit apart, once. words: word, n, one row a word; a written table."""
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(0), F.char_length("word")), lambda i: F.substr(F.concat(F.lit(" "), "word", F.lit(" ")), i + 1, F.lit(2)))).alias("g"))
    often = grams.groupBy("g").count().collect()  # 92 * 92 rows at most
    rank = {r["g"]: i for i, r in enumerate(sorted(often, key=lambda r: (r["count"], r["g"])))}
    rows = written(words.select("word", "n").mapInArrow(_posted(rank), _TILE_SQL), "tiles")
    keys = ["gram", "length", "place"]
    fit, large = _dealt(rows, keys, tile)
    dealt = fit.withColumns({"part": F.lit(""), "block": F.lit(0), "probes": F.lit(True)})
    if large:
        parts = written(large.drop("size").withColumn("part", F.explode(_halves(F.col("word"), F.col("role") == SHORTER))), "parts")
        fit, large = _dealt(parts, [*keys, "part"], tile)
        of_kind = F.col("part").startswith("=")  # in the other parts only shorter words probe
        dealt = dealt.unionByName(fit.withColumns({"block": F.lit(0), "probes": of_kind}))
        if large:
            blocks = F.ceil(F.col("size") / tile).cast("int")
            own = F.pmod(F.xxhash64("word"), blocks).cast("int")
            shorter = F.col("role") == SHORTER
            copies = large.withColumn("block", F.explode(F.when(shorter, F.array(own)).otherwise(F.sequence(F.lit(0), blocks - 1))))
            dealt = dealt.unionByName(copies.withColumn("probes", of_kind & ~shorter & (own == F.col("block"))).drop("size"))
    order = [*keys, "part", "block"]
    pairs = dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(tidy("spelling", _joined), "a string, a_n long, b string, b_n long")
    return pairs.dropDuplicates(["a", "b"])  # the words may share several tiles


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """word, root: forms (word, form; a written table) followed to the end; chains have at most `steps` forms."""
    out = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(1, steps)))):
        onward = out.select(F.col("word").alias("root"), F.col("root").alias("next"))
        out = written(out.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return out


def variants(docs: DataFrame, id_: str = "doc_id", text: str = "text", factor: int = FACTOR, tile: int = TILE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = written(vocabulary(docs, id_, text), "words")
    pairs = written(one_edit_pairs(words, tile), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionAll(pairs.select("b", "a", "a_n"))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    best, best_n = F.col("best.word"), -F.col("best.n")
    formed = best_n >= factor * F.col("n")
    out = words.join(near, "word", "left").select("word", F.when(formed, best).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, best_n).alias("form_n"))
    out = written(out, "forms")
    most = words.agg(F.max("n")).first()[0] or 1
    chains = roots(out.where("form is not null").select("word", "form"), math.ceil(math.log(most, factor)) + 1)
    return out.join(chains, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
