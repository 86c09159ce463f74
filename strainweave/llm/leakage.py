"""Evaluation texts leaking into training text.

One Aho-Corasick automaton over the normalised evaluation texts scans every document once. Its patterns are blocks of
SEED words at every multiple of SEED words of an item: a common run of twice as many words always holds a whole block,
so no leak is missed. A hit is extended to the longest common run around it; runs of at least `run` words, or of the
whole item, are leaks. Their places are mapped back to offsets of the original text.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
# Characters that are removed (zero-width space and joiners, byte order mark, soft hyphen).
_REMOVED = dict.fromkeys([0x200B, 0x200C, 0x200D, 0xFEFF, 0x00AD])

#: Most characters of evaluation texts in one automaton (about 100 MB a worker). A larger set is cut into several, which a
#: worker holds one at a time.
BLOCK_CHARS = 2_000_000
#: Most characters of evaluation texts altogether: they are broadcast. More is an error.
MAX_CHARS = 200_000_000
#: Characters of documents that a worker gathers before it turns to the next automaton, where there are several.
CHUNK_CHARS = 64_000_000


def normal_text(text: str) -> str:
    """text after NFKC without the removed characters, case kept."""
    return text if text.isascii() else unicodedata.normalize("NFKC", text).translate(_REMOVED)


def words_of(text: str | None) -> list[str]:
    """The words of text: runs of letters and digits, in lower case. Null has none."""
    joined = " ".join(_WORD.findall(normal_text(text or ""))).lower()
    return joined.split(" ") if joined else []


def origin_offsets(text: str) -> list[int]:
    """For every character of normal_text(text), and its end, the offset in text that it comes from.

    Text is cut where normalising the two sides apart gives the same as normalising them together.
    """
    if text.isascii():
        return list(range(len(text) + 1))
    out: list[int] = []
    start, norm = 0, lambda s: unicodedata.normalize("NFKC", s)
    for end in range(1, len(text) + 1):
        if end < len(text) and not text[end].isascii():
            piece = text[start:end]
            if norm(piece + text[end]) != norm(piece) + norm(text[end]):
                continue
        out += [start] * len(norm(text[start:end]).translate(_REMOVED))
        start = end
    return [*out, len(text)]


class Items:
    """The automaton of one block of items."""

    def __init__(self, items: list[tuple[int, str]], run: int):
        import ahocorasick

        self.run, self.seed = run, max(1, run // 2)
        self.words = {k: words_of(t) for k, t in items}
        patterns: dict[str, list[tuple[int, int, int]]] = {}
        for k, words in self.words.items():
            step = self.seed if len(words) >= run else max(1, len(words))
            for at in range(0, len(words) - step + 1, step):
                patterns.setdefault(" " + " ".join(words[at : at + step]) + " ", []).append((k, at, step))
        self.automaton = ahocorasick.Automaton()
        for p, places in patterns.items():
            self.automaton.add_word(p, (len(p), places))
        if patterns:
            self.automaton.make_automaton()
        self.empty = not patterns

    def leaks(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, words in common, start, end): the longest run of each item, start and end as offsets of text."""
        words = None if self.empty else words_of(text)
        if not words:
            return []
        joined, best, starts, done = " " + " ".join(words) + " ", {}, None, {}
        for end, (length, places) in self.automaton.iter(joined):
            if starts is None:
                starts, n = [], 1
                for w in words:
                    starts.append(n)
                    n += len(w) + 1
            at = bisect_right(starts, end - length + 2) - 1
            for item, there, size in places:
                theirs = self.words[item]
                if at < done.get((item, at - there), 0):  # inside a run that was extended before
                    continue
                a, b = 0, size
                while at - a > 0 and there - a > 0 and words[at - a - 1] == theirs[there - a - 1]:
                    a += 1
                while at + b < len(words) and there + b < len(theirs) and words[at + b] == theirs[there + b]:
                    b += 1
                done[item, at - there] = at + b
                if a + b >= min(self.run, len(theirs)) and a + b > best.get(item, (0, 0))[0]:
                    best[item] = (a + b, at - a)
        if not best:
            return []
        spans, origin = [m.span() for m in _WORD.finditer(normal_text(text))], origin_offsets(text)
        return [(item, n, origin[spans[first][0]], origin[spans[first + n - 1][1] - 1] + 1) for item, (n, first) in sorted(best.items())]


_BUILT: dict[str, Items] = {}
_HIT = ["doc_id", "eval_id", "n_words", "start_at", "end_at", "passage"]


def _automaton(key: str, items: list[tuple[int, str]], run: int) -> Items:
    """The automaton of one block; workers are used again, so the last one is kept."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Items(items, run)
    return _BUILT[key]


def _scanner(shared, run: int):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, blocks = shared.value["key"], shared.value["blocks"]

        def hits(chunk: list[pd.DataFrame]) -> pd.DataFrame:
            rows = []
            for n, block in enumerate(blocks):
                items = _automaton(f"{key}-{n}", block, run)
                rows += [(d, *leak, t[leak[2] : leak[3]]) for batch in chunk for d, t in zip(batch["doc_id"], batch["text"]) for leak in items.leaks(t)]
            return pd.DataFrame(rows, columns=_HIT)

        chunk, size = [], 0
        for batch in batches:
            chunk.append(batch)
            size += int(batch["text"].str.len().sum())
            if len(blocks) == 1 or size >= CHUNK_CHARS:
                yield hits(chunk)
                chunk, size = [], 0
        if chunk:
            yield hits(chunk)

    return scan


def _blocks(items: list[tuple[int, str]], block_chars: int) -> list[list[tuple[int, str]]]:
    """items in blocks of at most block_chars characters; an item longer than that is a block of its own."""
    blocks, size = [[]], 0
    for k, text in items:
        if blocks[-1] and size + len(text) > block_chars:
            blocks.append([])
            size = 0
        blocks[-1].append((k, text))
        size += len(text)
    return blocks


def find_leaks(docs: DataFrame, items: DataFrame, run: int = 12, block_chars: int = BLOCK_CHARS, max_chars: int = MAX_CHARS) -> DataFrame:
    """(doc_id, eval_id, n_words, start_at, end_at, passage): the longest run that a document shares with an item.

    A leak is a run of `run` consecutive words, or the whole item where it has fewer. start_at and end_at are code point
    offsets of the document's text, passage is what stands there. Null and wordless texts leak nothing; an item without
    an id or words is no pattern; repeated rows come out as often as they go in. The documents are read once, whatever
    the items' size, and never gathered. The items, a fixed evaluation set, are broadcast: their sum is checked first,
    and more than max_chars characters are an error. Up to block_chars make one automaton.
    """
    spark = docs.sparkSession
    used = items.filter(F.col("text").isNotNull() & F.col("eval_id").isNotNull()).select("eval_id", "text")
    total = used.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    if total > max_chars:
        raise ValueError(f"evaluation texts of {total} characters: more than {max_chars} cannot be broadcast, give them in several calls")
    shared = spark.sparkContext.broadcast({"key": uuid.uuid4().hex, "blocks": _blocks([(r.eval_id, r.text) for r in used.collect()], block_chars)})
    hits = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").filter("text is not null").mapInPandas(_scanner(shared, run), "doc_id string, eval_id bigint, n_words int, start_at int, end_at int, passage string")
    return hits.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))  # as text on the way: nulls would make it a float
