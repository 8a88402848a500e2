"""Token counts: a two-tier lookup of pre-token lengths on the map side; no pre-token is ever shuffled.

Tier 1 is a table, broadcast to every task, from frequent pre-tokens to their number of tokens. It
holds the pre-tokens most seen in a bounded sample, TABLE
entries at most. Tier 2 is a cache in each Python worker: misses of many texts are encoded by the library together and
remembered, in two generations of CACHE entries. The table and the caches only save work: a count is always what
the library gives for the whole text.

Defined cases: a null text counts as empty: 0 bytes, 0 tokens. Special strings in a text are split off and
count as the library counts them by default: one token each. Rows are independent; repeated rows repeat their
result; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, compress, repeat
from operator import not_

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttera.llm.common import Recent, small_batches, worker_cache, worker_memory

#: Entries of the broadcast table, and rows of the sample that it is filled from.
TABLE, SAMPLE_ROWS = 60_000, 4_000
#: Pre-tokens in each of the two generations that a worker remembers; longer ones than LONG characters aren't remembered.
CACHE, LONG = 150_000, 64
#: Characters of texts whose misses are encoded together.
GROUP = 250_000
LIMIT = 1024


def _load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Letters of the texts that the quick pattern serves. In texts of these, ASCII and the usual blanks alone, it splits as the full one.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_QUICK = re.compile(rf" ?[{_LATIN}]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+").findall
_SIMPLE = re.compile(rf"[\t-\r\x20-\x7e{_LATIN}×÷]*").fullmatch
#: The pattern that _QUICK stands for: that of the byte-level pre-tokenizer. Fixed value.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for U+0100 on, in order.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_ALPHABET = {b: b for b in _PRINTED} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class TokenCounter:
    """Counts the tokens of texts for a byte-level BPE tokenizer file."""

    def __init__(self, path: str, pattern: str, table: dict[str, int]):
        # tasks run on all cores already; the library's own threads only add work
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = _load(path)
        from tokenizers import pre_tokenizers

        plain = pre_tokenizers.ByteLevel(add_prefix_space=False)
        kinds = [json.loads(x.__getstate__()) if x is not None else None for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)]
        #: Whether a pre-token goes to the library's model as its bytes in the byte-level alphabet, and nothing else happens to it.
        self.byte_level = kinds[0] is None and kinds[1] == json.loads(plain.__getstate__()) | {"trim_offsets": (kinds[1] or {}).get("trim_offsets")}
        self.find = regex.compile(pattern).findall
        self.quick = pattern == BYTE_LEVEL
        self.known = Recent(CACHE, table)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = regex.compile("|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) or "(?!)").split

    def words(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text and the number of special strings between them."""
        if any(s in text for s in self.specials):
            parts = self.split(text)
            return [w for p in parts for w in self.find(p)], len(parts) - 1
        if self.quick and _SIMPLE(text):
            return _QUICK(text), 0
        return self.find(text), 0

    def encoded(self, words: set[str]) -> dict[str, int]:
        """Numbers of tokens as the library gives them."""
        if self.byte_level:
            tokenize = self.tokenizer.model.tokenize
            spelled = lambda w: w.replace(" ", "\u0120") if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(_ALPHABET)
            return {w: len(tokenize(spelled(w))) for w in words}
        words = list(words)
        return {w: len(e) for w, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True)}

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; misses of the whole list go to the library at once."""
        known, out, rest = self.known, [], []
        for text in texts:
            words, special = self.words(text) if text else ([], 0)
            lengths = list(map(known.get, words, repeat(0)))  # no pre-token has length 0
            out.append(sum(lengths) + special)
            rest.append(list(compress(words, map(not_, lengths))))
        missing = known.unknown(set(chain.from_iterable(rest)))
        known.update(self.encoded(missing))
        for k, words in enumerate(rest):
            out[k] += sum(map(known.__getitem__, words))
        for w in missing:
            if len(w) > LONG:
                del known[w]
        known.age()
        return out

    def count(self, text: str) -> int:
        return self.counts([text])[0]


_COUNTERS: dict = {}
worker_cache("token_counts", _COUNTERS.clear)


def _counter(path: str, pattern: str, table: dict[str, int], key: str) -> TokenCounter:
    """One counter for each worker and table; workers are reused between tasks, and so are their caches."""
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = TokenCounter(path, pattern, table)
    return _COUNTERS[key]


def frequent_lengths(docs: DataFrame, path: str, pattern: str, text: str = "text") -> dict[str, int]:
    """Tier 1: pre-tokens of the sample by frequency, TABLE at most, with their lengths."""
    find = regex.compile(pattern).findall

    @F.pandas_udf("map<string,int>")
    def tally(texts: pd.Series) -> pd.Series:
        out: Counter = Counter()
        for t in texts:
            out.update(find(t or ""))
        rows = [dict(out.most_common(TABLE)) if out else {}]
        return pd.Series(rows + [{}] * (len(texts) - 1))

    sample = docs.select(text).limit(SAMPLE_ROWS)
    seen: Counter = Counter()
    for row in sample.select(tally(F.col(text)).alias("m")).collect():
        seen.update(row["m"])
    counter = TokenCounter(path, pattern, {})
    words = [w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:TABLE] if len(w) <= LONG]
    return counter.encoded(set(words)) if words else {}


def tokens_column(docs: DataFrame, path: str, pattern: str, text: str = "text") -> Column:
    """A column with the number of tokens of `text`."""
    small_batches(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, pattern, text))
    key = f"{path}/{id(table)}/{len(table.value)}"

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with worker_memory("token_counts"):
            counter = _counter(path, pattern, table.value, key)
            for batch in batches:
                out, group, size = [], [], 0
                for text in batch:
                    group.append(text)
                    size += len(text or "")
                    if size >= GROUP:
                        out += counter.counts(group)
                        group, size = [], 0
                yield pd.Series(out + counter.counts(group), dtype="int64")

    return count(F.col(text))


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs (doc_id, text)."""
    n = tokens_column(docs, path, pattern)
    out = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), n.alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
