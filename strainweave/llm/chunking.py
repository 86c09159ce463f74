"""Splitting oversized items at natural boundaries.

A text's tokens become a shadow text of one letter a token, which says what boundary lies after the token: P paragraph,
S sentence, W word, c none, x inside a character (no piece may begin or end there). One regular expression with bounded
quantifiers then takes the pieces: its alternatives are ordered by the strength of the boundary, each consumes as many
tokens as the limit allows, and the last falls back to any character. A piece after the first takes up to limit -
overlap new tokens and looks back by the overlap. Offsets, ends and texts come from array functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainweave.llm import tokens

# Characters that end a sentence, where white space or another text without spaces follows, and marks that close after them.
_STOPS, _WIDE_STOPS, _CLOSERS = (np.array([ord(c) for c in x], dtype=np.uint32) for x in (".!?…", "。！？", "\"')]}”’»」"))
_SPACES = np.array([c for c in range(0x3001) if chr(c).isspace()], dtype=np.uint32)
#: Most tokens that a look-back grows by where it would begin inside a character (UTF-8 has four bytes at most).
_SLACK = 3


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _last(at: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """For every position the last one up to it where `at` holds; a kind: what stands there, 0 where there is none."""
    place = np.maximum.accumulate(np.where(at, np.arange(len(at)), -1))
    return np.where(place >= 0, kinds[place], 0)


def boundaries(text: str) -> np.ndarray:
    """For every offset 1 to len(text) what lies between the text before and after it: P, S, W or c, as bytes.

    All offsets are told at once, by arrays over the code points.
    """
    c = _code_points(text)
    if not len(c):
        return np.zeros(0, dtype="S1")
    space, closer = np.isin(c, _SPACES), np.isin(c, _CLOSERS)
    newline = c == 10
    before, after, after_space = c[:-1], c[1:], space[1:]
    # the last character before a newline's own that isn't other white space, and the last that isn't a closing mark
    ahead = np.concatenate([np.zeros(1, np.uint32), _last(~space | newline, c)[:-1]])
    stop = _last(~closer, c)[:-1]
    ends = np.isin(stop, _STOPS) & after_space | np.isin(stop, _WIDE_STOPS) & ~np.isin(after, _CLOSERS)
    out = np.where(space[:-1] != after_space, b"W", b"c")
    out = np.where(ends, b"S", out)
    out = np.where((before == 10) & ~after_space, np.where(ahead[:-1] == 10, b"P", b"S"), out)
    return np.append(out, b"P")


def shadow_of(text: str, path: str, limit: int) -> tuple[str | None, np.ndarray | None]:
    """(one letter a token, offset in code points at which each token ends), or nulls for a text of up to limit tokens."""
    encoding, lengths = tokens.load(path)
    ids = encoding.encode_ordinary(text)
    if len(ids) <= limit:
        return None, None
    raw = text.encode("utf-8", "replace")
    ends = np.cumsum(lengths[ids])
    data = np.frombuffer(raw, dtype=np.uint8)
    starts_char = np.append((data & 0xC0) != 0x80, True)
    chars = np.cumsum(starts_char) - 1  # code points before each byte
    whole = starts_char[ends]
    offsets = chars[ends] + ~whole
    letters = np.where(whole, boundaries(text)[np.maximum(offsets, 1) - 1], b"x")
    return letters.tobytes().decode("ascii"), offsets.astype(np.int32)


def shadows(text: Column, path: str, limit: int) -> Column:
    """STRUCT(shadow, ends) of a text; both null where it needs no cut."""

    @F.pandas_udf("shadow string, ends array<int>")
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([shadow_of(t, path, limit) for t in texts], columns=["shadow", "ends"])

    return make(text)


def piece_pattern(limit: int, overlap: int, slack: int = 0) -> str:
    """Takes one piece's new tokens; the first piece may have limit, later ones limit - overlap - slack."""

    def take(most: int) -> str:
        good = max(overlap + 1, most // 2)
        return "|".join([rf".{{{good - 1},{most - 1}}}{b}" for b in "PSW"] + [rf".{{0,{most - 1}}}{b}" for b in "PSW"] + [rf".{{0,{most - 1}}}[^x]", rf".{{1,{most}}}"])

    later = limit - overlap - slack
    if later < 1 + _SLACK:
        raise ValueError("the overlap leaves no room")
    return rf"(?:\A(?:{take(limit)}))|(?:{take(later)})"


def split_texts(docs: DataFrame, limit: int = 512, overlap: int = 64, path: str | None = None, doc_id: str = "doc_id", text: str = "text", name: str = tokens.NAME) -> DataFrame:
    """(doc_id, piece_no, token_from, token_to, start_at, end_at, n_tokens, tokenizer, piece) of every text of more than limit tokens.

    Pieces are numbered from 1, have at most limit tokens, and cover the text: each begins exactly overlap tokens before
    the end of the one before (up to three more where that lies inside a character) and all of start_at and end_at are
    code point offsets. A piece ends at the last paragraph, else sentence, else word boundary in its second half, then
    at such a boundary anywhere, then at any whole character. Texts of up to limit tokens, empty and null ones give no
    pieces. Rows repeated under one doc_id are split alike.
    """
    path = path or tokens.vocabulary(name)
    long = docs.select(doc_id, F.col(text).alias("text")).filter(F.octet_length("text") > limit)  # a token has a byte at least
    # a generator of one element: the filter after it does not have the texts tokenized again
    s = long.select(doc_id, "text", F.explode(F.array(shadows(F.col("text"), path, limit))).alias("s")).select(doc_id, "text", "s.shadow", "s.ends").filter("shadow is not null")
    pattern = F.when(F.contains("shadow", F.lit("x")), piece_pattern(limit, overlap, _SLACK)).otherwise(piece_pattern(limit, overlap))
    s = s.withColumn("sizes", F.transform(F.regexp_extract_all("shadow", pattern, F.lit(0)), F.length))
    # ends of the pieces in tokens: running sums of their sizes
    to = F.aggregate("sizes", F.array().cast("array<int>"), lambda a, n: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + n)))
    s = s.select(doc_id, "text", "shadow", "ends", F.explode(F.array(to)).alias("to"))

    def back(end: Column) -> Column:
        """The look-back from a piece's end: to the overlap, and on to the start of a character."""
        at = end - overlap
        inside = lambda k: (F.substring("shadow", at - k, F.lit(1)) == "x") & (at - k > 0)
        return F.when(~inside(0), at).when(~inside(1), at - 1).when(~inside(2), at - 2).otherwise(at - 3)

    def piece(end: Column, i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.greatest(back(F.get("to", i - 1)), F.lit(0)))
        first = F.when(start == 0, F.lit(0)).otherwise(F.get("ends", start - 1))
        last = F.get("ends", end - 1)
        return F.struct((i + 1).alias("piece_no"), start.alias("token_from"), end.alias("token_to"), first.alias("start_at"), last.alias("end_at"))

    s = s.select(doc_id, "text", F.explode(F.array(F.transform("to", piece))).alias("p"))
    s = s.select(doc_id, F.explode(F.transform("p", lambda p: F.struct(p.piece_no.alias("piece_no"), p.token_from.alias("token_from"), p.token_to.alias("token_to"), p.start_at.alias("start_at"), p.end_at.alias("end_at"), F.substring(F.col("text"), p.start_at + 1, p.end_at - p.start_at).alias("piece")))).alias("p"))
    return s.select(doc_id, "p.piece_no", "p.token_from", "p.token_to", "p.start_at", "p.end_at", (F.col("p.token_to") - F.col("p.token_from")).alias("n_tokens"), F.lit(name).alias("tokenizer"), "p.piece")
